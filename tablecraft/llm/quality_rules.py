"""Quality rules: base statistics of each text, and robust multivariate outliers per language and source.

Every text gives whole-number statistics (``text_statistics``). Texts that fail the base rule are rejected; all others
become a vector of transformed statistics. Per language and source, the minimum covariance determinant of these
vectors is estimated: starting from medians and median absolute deviations, each concentration step takes the share
``core`` of the rows with the smallest Mahalanobis distance and computes their mean and covariance anew, which never
raises the determinant. Each step runs over all rows: one aggregation for the distance that bounds the core, one for
the moments. A document is rejected when its final squared distance exceeds ``cutoff``.

Texts without symbols or repeats have no spread in those statistics, so a covariance has ``floors`` squared added on its
diagonal (a regularized determinant): the spread a statistic is allowed at least.

Sources of a language with fewer than ``least_rows`` judged rows are estimated together, languages whose rest is
still smaller are estimated together, and if even these are fewer, nothing but the base rule rejects.

Defined results: null or empty texts have no words and fail the base rule; null languages and sources are groups of
their own; rows that repeat an id are judged one by one; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablecraft.llm.common import WordHashes, keep, small, text_bytes, window_hashes, without_documents

SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("word_length", "symbol_share", "dup_lines", "repeat_share")
FLOORS = (0.06, 0.03, 0.45, 0.12)
CORE = 0.75
STEPS = 3
LEAST_ROWS = 200
# The squared distance that a normal vector of four dimensions exceeds once in a hundred thousand.
CUTOFF = 28.5
# Covariance of the core over that of all rows, for normal vectors of four dimensions and a core of three quarters.
CORE_SHRINKAGE = 0.67


def text_statistics(text: bytes | None, hashes: WordHashes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a whole text."""
    words = text.split() if text else []
    if not words:
        return 0, 0, sum(text.count(s) for s in SYMBOLS) if text else 0, 0, 0
    joined = b"".join(words)
    chars = len(joined.decode("utf-8", "replace"))
    symbols = sum(map(joined.count, (bytes([s]) for s in SYMBOLS)))
    seen, repeated = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            repeated += 1
        elif line and not line.isspace():
            seen.add(line)
    windows = window_hashes(hashes.of(words), 3)
    covered = np.zeros(len(words), bool)
    if len(windows):
        _, inverse, count = np.unique(windows, return_inverse=True, return_counts=True)
        at = np.flatnonzero(count[inverse] > 1)
        for shift in range(3):
            covered[at + shift] = True
    return len(words), chars, symbols, repeated, int(covered.sum())


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        found = [text_statistics(text, hashes) for text in text_bytes(batch, "text")]
        columns = zip(*found, strict=True) if found else [[]] * len(COUNTS)
        yield pa.record_batch(
            [*(batch.column(c) for c in ("doc_id", "lang", "source")), *(pa.array(c, pa.int64()) for c in columns)],
            ["doc_id", "lang", "source", *COUNTS],
        )


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, lang, source and the base statistics of every row."""
    plain = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(lang_col).cast("string").alias("lang"),
        F.col(source_col).cast("string").alias("source"),
        F.col(text_col).cast("string").alias("text"),
    )
    return plain.mapInArrow(_measure, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))


def _vectors(rows: DataFrame) -> DataFrame:
    words = F.greatest("n_words", F.lit(1))
    return rows.withColumns(
        {
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
            "word_length": F.log(F.greatest("word_chars", F.lit(1)) / words),
            "symbol_share": F.col("n_symbols") / words,
            "dup_lines": F.log1p("n_dup_lines"),
            "repeat_share": F.col("n_repeat_words") / words,
        }
    )


def _grouped(rows: DataFrame, least_rows: int) -> DataFrame:
    """``rows`` with the group each row is judged in, or null where there are too few rows."""
    sizes = rows.groupBy("lang", "source").agg(F.count_if(~F.col("base_failed")).alias("n"))
    rest = F.sum(F.when(F.col("n") < least_rows, F.col("n")).otherwise(0))
    sizes = sizes.withColumn("lang_rest", rest.over(Window.partitionBy("lang")))
    few = (F.col("n") < least_rows) & (F.col("lang_rest") < least_rows)
    total = sizes.agg(F.coalesce(F.sum(F.when(few, F.col("n"))), F.lit(0)).alias("all_rest"))
    sizes = sizes.join(F.broadcast(total)).select(
        F.col("lang").alias("l"),
        F.col("source").alias("s"),
        F.when(F.col("n") >= least_rows, F.concat(F.lit("source "), F.to_json(F.struct("lang", "source"))))
        .when(F.col("lang_rest") >= least_rows, F.concat(F.lit("language "), F.to_json(F.struct("lang"))))
        .when(F.col("all_rest") >= least_rows, F.lit("rest"))
        .alias("grp"),
    )
    sizes = small(keep(sizes, "groups"))
    return rows.join(sizes, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s"))).drop("l", "s")


def _distance() -> Column:
    centred = [F.col(name) - F.col("center")[i] for i, name in enumerate(FEATURES)]
    total = F.lit(0.0)
    for i, a in enumerate(centred):
        for j, b in enumerate(centred):
            total = total + a * b * F.col("precision")[i * len(FEATURES) + j]
    return total


def _inverted(floors: tuple[float, ...], shrinkage: float) -> callable:
    """(grp, moments) to (grp, center, precision): the inverse of the core's covariance with floors."""
    size = len(FEATURES)

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = batch.column("grp").to_pylist()
            centers, precisions = [], []
            for center, products in zip(batch.column("center").to_pylist(), batch.column("products").to_pylist(), strict=True):
                mean = np.array(center)
                spread = np.array(products).reshape(size, size) - np.outer(mean, mean)
                spread = (spread + spread.T) / (2 * shrinkage) + np.diag(np.square(floors))
                values, vectors = np.linalg.eigh(spread)
                values = np.maximum(values, min(floors) ** 2)
                precisions.append(((vectors / values) @ vectors.T).ravel().tolist())
                centers.append(center)
            yield pa.record_batch(
                [pa.array(groups, pa.string()), pa.array(centers, pa.list_(pa.float64())), pa.array(precisions, pa.list_(pa.float64()))],
                ["grp", "center", "precision"],
            )

    return invert


_ESTIMATE = "grp string, center array<double>, precision array<double>"


def estimates(judged: DataFrame, floors: tuple[float, ...], core: float, steps: int, shrinkage: float) -> DataFrame:
    """Center and inverse covariance of each group: (grp, center, precision)."""
    size = len(FEATURES)
    middle = judged.groupBy("grp").agg(*(F.percentile_approx(c, 0.5, 10_000).alias(f"m_{c}") for c in FEATURES))
    middle = small(keep(middle, "medians"))
    away = judged.join(middle, "grp").groupBy("grp").agg(
        F.array(*(F.first(f"m_{c}") for c in FEATURES)).alias("center"),
        *(F.percentile_approx(F.abs(F.col(c) - F.col(f"m_{c}")), 0.5, 10_000).alias(f"d_{c}") for c in FEATURES),
    )
    diagonal = [
        1 / (F.pow(1.4826 * F.col(f"d_{FEATURES[i]}"), 2) + floors[i] ** 2) if i == j else F.lit(0.0)
        for i in range(size)
        for j in range(size)
    ]
    current = keep(away.select("grp", "center", F.array(*diagonal).alias("precision")), "estimate")
    for _ in range(steps):
        near = judged.join(small(current), "grp").withColumn("distance", _distance()).drop("center", "precision")
        bound = near.groupBy("grp").agg(F.percentile_approx("distance", core, 10_000).alias("bound"))
        bound = small(keep(bound, "core-bound"))
        moments = (
            near.join(bound, "grp")
            .filter("distance <= bound")
            .groupBy("grp")
            .agg(
                F.array(*(F.avg(c) for c in FEATURES)).alias("center"),
                F.array(*(F.avg(F.col(a) * F.col(b)) for a in FEATURES for b in FEATURES)).alias("products"),
            )
        )
        current = keep(moments.mapInArrow(_inverted(floors, shrinkage), _ESTIMATE), "estimate")
    return current


def judge(
    docs: DataFrame,
    floors: tuple[float, ...] = FLOORS,
    core: float = CORE,
    steps: int = STEPS,
    least_rows: int = LEAST_ROWS,
    cutoff: float = CUTOFF,
    **columns: str,
) -> DataFrame:
    """One row per document: doc_id, lang, source, the base statistics, base_failed, distance (squared) and kept."""
    rows = keep(statistics(docs, **columns), "statistics")
    rows = _grouped(_vectors(rows), least_rows)
    judged = rows.filter("not base_failed and grp is not null").select("grp", *FEATURES)
    found = small(estimates(judged, floors, core, steps, CORE_SHRINKAGE))
    distance = F.when(~F.col("base_failed"), _distance())
    return rows.join(found, "grp", "left").select(
        "doc_id",
        "lang",
        "source",
        *COUNTS,
        "base_failed",
        distance.alias("distance"),
        (~F.col("base_failed") & (F.coalesce(distance, F.lit(0.0)) <= cutoff)).alias("kept"),
    )


def good_documents(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", **options
) -> DataFrame:
    """``docs`` without the rejected ones; rows are judged one by one, whatever their id."""
    # All that a verdict depends on: rows that agree in it share the verdict. Nulls count, as hashes pass over them.
    seen = [F.col(c).cast("string") for c in (text_col, lang_col, source_col)]
    keyed = docs.withColumn("__row", F.xxhash64(*seen, *[c.isNull() for c in seen]))
    verdicts = judge(keyed, id_col="__row", text_col=text_col, lang_col=lang_col, source_col=source_col, **options)
    return without_documents(keyed, verdicts.filter("not kept").select("doc_id"), "__row").drop("__row")
