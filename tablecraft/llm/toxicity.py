"""Toxic spans with a linear-chain conditional random field, and document scores from its marginals.

Learning, from labelled rows alone:

1. Over all labelled rows, count for every word and word beginning the toxic and the other documents it is in.
2. Weigh each by its smoothed log-odds (toxic against other documents with it, less the odds of all labelled ones where
   toxic documents are the majority). Of positive weights, those count that chance does not account for: among the terms
   in as many documents, fewer than ``BY_CHANCE`` of those at least as toxic are expected if labels were dealt at random.
   Where no term passes that, all of positive weight count.
   ``rounds`` times, choose the fewest that explain the toxic documents, the one that explains most of the unexplained
   ones first, without words chosen before (copies of one toxic text so add few). Their words are the toxic tokens; this
   turns labels of documents into labels of tokens.
3. Fit the chain by maximum likelihood on all sentences of the sample; equal ones, such as those of one length without
   any feature, count together. A token's features are its word and its beginnings, as far as they occur in toxic tokens.
4. Fit a logistic curve from the marginals of a document to its label.

Steps 2 to 4 use at most ``sample_docs`` labelled documents of each class, those with the smallest hash of their id;
step 1 and the scoring cover everything. Language, source, id and labels are never inputs of a score.

Scoring: every token of every text is looked up; sentences that have one with a feature go through the forward and
backward recursion, many side by side, and the marginals of their tokens make the score. Sentences without any such token
have marginals near zero and are not run.

Defined results: null or empty texts and texts without toxic features get the lowest score; rows that repeat an id are
scored one by one; without labelled rows of both classes every score is 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecraft.llm.common import discard, keep, small

TOKEN = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+")
BEGINNINGS = (4, 5, 6)
SAMPLE_DOCS = 4_000
CANDIDATES = 20_000
BY_CHANCE = 0.25
COVERS = 8
# Unexplained documents that a term must explain, as a share of the toxic ones of the sample; one at least.
LEAST_SHARE = 0.00075
SEQUENCE = 48
THRESHOLD = 0.7
# Marginal from which a token counts as an offending one.
TOXIC = 0.5
COUNTED_TERMS, COUNTED_SENTENCES = 150_000, 50_000
# Texts and sentences that a task runs at once.
SLICE_ROWS, AT_ONCE = 256, 4096
CACHED_WORDS = 100_000


def terms(word: str) -> list[str]:
    """The word and its beginnings, as features."""
    word = word.lower()
    return ["=" + word, *(word[:n] for n in BEGINNINGS if len(word) >= n)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> pa.RecordBatch:
        names = list(every)
        return pa.record_batch(
            [pa.array(names, pa.string()), pa.array([toxic[n] for n in names], pa.int64()), pa.array([every[n] for n in names], pa.int64())],
            ["term", "toxic", "docs"],
        )

    toxic, every = Counter(), Counter()
    for batch in batches:
        for text, label in zip(batch.column("text"), batch.column("label").to_pylist(), strict=True):
            found = {t for word in set(TOKEN.findall(text.as_py() or "")) for t in terms(word)}
            every.update(found)
            if label:
                toxic.update(found)
            if len(every) > COUNTED_TERMS:
                yield rows()
                toxic, every = Counter(), Counter()
    yield rows()


def _marked(candidates: dict[str, int]) -> Callable:
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column("text"):
                words = set(TOKEN.findall(text.as_py() or ""))
                found.append(sorted({candidates[t] for w in words for t in terms(w) if t in candidates}))
            yield pa.record_batch([pa.array(found, pa.list_(pa.int32()))], ["found"])

    return mark


def cover(found: list[list[int]], weight: list[float], least_gain: int) -> list[int]:
    """Terms that explain the documents: always the one in most unexplained documents, the heavier and longer if equal."""
    owners: dict[int, list[int]] = {}
    for doc, own in enumerate(found):
        for term in own:
            owners.setdefault(term, []).append(doc)
    weights = np.array(weight, float)
    left = np.bincount([t for own in found for t in own], minlength=len(weights)) if owners else np.zeros(len(weights), int)
    explained = [False] * len(found)
    chosen = []
    while len(left) and (most := left.max()) >= max(least_gain, 1):
        equal = np.flatnonzero(left == most)
        best = int(equal[weights[equal].argmax()])
        chosen.append(best)
        for doc in owners[best]:
            if not explained[doc]:
                explained[doc] = True
                left[found[doc]] -= 1
    return chosen


def covers(found: list[list[int]], names: list[str], weight: list[float], least_gain: int, rounds: int) -> list[int]:
    """Terms of ``rounds`` covers, each without the terms that are a beginning or a longer form of those before."""
    chosen, left = [], found
    for _ in range(rounds):
        best = cover(left, weight, least_gain)
        chosen += best
        stems = tuple(names[t].lstrip("=") for t in best)
        heads = {stem[:n] for stem in stems for n in range(1, len(stem) + 1)}
        gone = {t for t, name in enumerate(names) if (low := name.lstrip("=")) in heads or low.startswith(stems)}
        left = [[t for t in own if t not in gone] for own in left]
    return chosen


def sentences(text: str, own: list) -> list[tuple[int, int, int, int]]:
    """Sentences with a feature: where the whole sentence begins (character, token), first token and token after the last.

    ``own`` holds something true for every token of the text that has one. A sentence longer than ``SEQUENCE`` tokens is cut after them.
    """
    out, at = [], 0
    for match in SENTENCE.finditer(text):
        count = len(TOKEN.findall(match.group()))
        for first in range(at, at + count, SEQUENCE):
            last = min(first + SEQUENCE, at + count)
            if any(own[first:last]):
                out.append((match.start(), at, first, last))
        at += count
    return out


def token_spans(text: str, sentence: tuple[int, int, int, int]) -> list[tuple[int, int]]:
    """Where the tokens of a sentence begin and end."""
    begin, at, first, last = sentence
    found = islice(TOKEN.finditer(text, begin), first - at, last - at)
    return [match.span() for match in found]


class Remembered(dict):
    """What a function gives for each word, remembered up to a bound."""

    def __init__(self, function: Callable[[str], object]):
        super().__init__()
        self._function = function

    def __missing__(self, word: str) -> object:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = self._function(word)
        return value


def features_of(known: dict[str, int]) -> Remembered:
    """The numbers of the known features of a word."""
    return Remembered(lambda word: tuple(known[t] for t in terms(word) if t in known))


def forward_backward(emission: np.ndarray, mask: np.ndarray, chain: np.ndarray, times: np.ndarray | float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of label 1, pair marginals (from, to) summed over places, and log partition, for padded sequences.

    ``emission`` is the score of label 1 over label 0, (sequences, places); ``mask`` tells real places; ``chain`` holds
    the scores of starting with 1 and of the steps 0 to 1, 1 to 0 and 1 to 1 (0 to 0 is 0); ``times`` weighs sequences
    in the sum of pairs. Both recursions keep shares that sum to one at each place.
    """
    count, length = emission.shape
    start, up, down, stay = np.exp(np.clip(chain, -40, 40))
    # Odds of label 1, bounded so that products stay within the range of floats.
    odds = np.exp(np.clip(emission, -60, 60)).T
    real = mask.T
    share, scale = np.empty((length, count)), np.zeros(count)
    one = odds[0] * start
    total = 1 + one
    share[0] = one / total
    scale += np.log(total)
    for t in range(1, length):
        before = share[t - 1]
        one = odds[t] * ((1 - before) * up + before * stay)
        zero = 1 - before + before * down
        total = one + zero
        share[t] = np.where(real[t], one / total, before)
        scale += np.where(real[t], np.log(total), 0.0)
    marginal, pairs = np.zeros((length, count)), np.zeros((2, 2))
    # Weights of what follows, for label 0 and 1; only their ratio counts.
    next_0, next_1 = np.ones(count), np.ones(count)
    for t in range(length - 1, -1, -1):
        one, zero = share[t] * next_1, (1 - share[t]) * next_0
        marginal[t] = np.where(real[t], one / (one + zero), 0.0)
        if t:
            before = share[t - 1]
            to_0, to_1 = next_0, odds[t] * next_1
            both = np.stack([(1 - before) * to_0, (1 - before) * up * to_1, before * down * to_0, before * stay * to_1])
            pairs += np.where(real[t], times * both / both.sum(0), 0.0).sum(1).reshape(2, 2)
            back_0, back_1 = to_0 + up * to_1, down * to_0 + stay * to_1
            both = back_0 + back_1
            next_0, next_1 = np.where(real[t], back_0 / both, next_0), np.where(real[t], back_1 / both, next_1)
    return marginal.T, pairs, scale


def fit_chain(found: list[list[tuple[int, ...]]], labels: list[list[int]], times: list[int], size: int, **options) -> tuple[np.ndarray, np.ndarray]:
    """``fit_flat`` for sentences as the features and the labels of their tokens."""
    tokens = list(chain.from_iterable(found))
    flat = (map(len, found), map(len, tokens), chain.from_iterable(tokens), chain.from_iterable(labels), times)
    return fit_flat(*(np.fromiter(v, np.int64) for v in flat), size, **options)


def fit_flat(lengths: np.ndarray, held: np.ndarray, features: np.ndarray, labels: np.ndarray, times: np.ndarray, size: int, steps: int = 90, ridge: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the features (the last is the bias) and of the chain, by gradient ascent on the likelihood.

    ``lengths`` are the tokens of each sentence, ``held`` the features of each token; ``times`` tells how often each
    sentence occurs.
    """
    order = np.argsort(lengths, kind="stable")
    firsts, held_before = np.cumsum(lengths) - lengths, np.cumsum(held, dtype=np.int64) - held
    groups = []
    for at in range(0, len(order), AT_ONCE):
        chosen = order[at : at + AT_ONCE]
        place = np.arange(int(lengths[chosen].max()))
        mask = place < lengths[chosen][:, None]
        tokens = (firsts[chosen][:, None] + place)[mask]
        truth = np.zeros(mask.shape, bool)
        truth[mask] = labels[tokens]
        own = held[tokens].astype(np.int64)
        ends = np.cumsum(own)
        ids = features[np.repeat(held_before[tokens] - ends + own, own) + np.arange(own.sum())]
        groups.append((mask, truth, np.repeat(np.flatnonzero(mask), own), ids, times[chosen].astype(float)))
    total = float(times.sum()) or 1.0
    value = np.zeros(size + 1 + 4)
    value[size] = -3.0
    mean, square = np.zeros_like(value), np.zeros_like(value)
    for step in range(1, steps + 1):
        slope = np.zeros_like(value)
        for mask, truth, places, ids, weight in groups:
            emission = value[size] + np.bincount(places, value[ids], mask.size)
            marginal, pairs = forward_backward(emission.reshape(mask.shape), mask, value[size + 1 :], weight)[:2]
            miss = (truth - marginal) * mask * weight[:, None]
            slope[:size] += np.bincount(ids, miss.ravel()[places], size)[:size]
            slope[size] += miss.sum()
            inner = mask[:, 1:] * weight[:, None]
            first, second = truth[:, :-1], truth[:, 1:]
            seen = [(truth[:, 0] * weight).sum(), ((1 - first) * second * inner).sum(), (first * (1 - second) * inner).sum(), (first * second * inner).sum()]
            slope[size + 1 :] += np.array(seen) - [(marginal[:, 0] * weight).sum(), pairs[0, 1], pairs[1, 0], pairs[1, 1]]
        slope = slope / total - ridge / total * value
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        value = value + 0.25 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
    return value[: size + 1], value[size + 1 :]


class Tagger:
    """A fitted chain: marginals of the tokens of texts."""

    def __init__(self, known: dict[str, int], weights: list[float], chain: list[float]):
        self._bias, self._chain = weights[-1], np.array(chain)
        # Every known word of four letters or more has its first four as a feature of its own: others are told by them.
        least = BEGINNINGS[0]

        def score(word: str) -> float:
            """The score of a word's features; 0 for none, and as good as 0 where they cancel out."""
            low = word.lower()
            if (low[:least] if len(low) >= least else "=" + low) not in known:
                return 0.0
            return sum(weights[known[t]] for t in terms(word) if t in known) or 1e-9

        self._scores = Remembered(score)

    def __call__(self, texts: list[str]) -> list[tuple[list[float], list[tuple[int, int, float]]]]:
        """For each text, the marginals of the tokens of its sentences with a feature, and the spans of toxic tokens."""
        score = self._scores.__getitem__
        owners, places, emissions = [], [], []
        for number, text in enumerate(texts):
            own = list(map(score, TOKEN.findall(text)))
            if any(own):
                for sentence in sentences(text, own):
                    owners.append(number)
                    places.append(sentence)
                    emissions.append(own[sentence[2] : sentence[3]])
        lengths = np.array([len(e) for e in emissions], np.int64)
        order = np.argsort(lengths, kind="stable")
        marginals: list[list[float]] = [[]] * len(emissions)
        for at in range(0, len(order), AT_ONCE):
            chosen = order[at : at + AT_ONCE]
            mask = np.arange(int(lengths[chosen].max())) < lengths[chosen][:, None]
            emission = np.zeros(mask.shape)
            emission[mask] = list(chain.from_iterable(emissions[n] for n in chosen.tolist()))
            found, _, _ = forward_backward(emission + self._bias, mask, self._chain)
            for n, values in zip(chosen.tolist(), found, strict=True):
                marginals[n] = values[: lengths[n]].tolist()
        out: list[tuple[list, list]] = [([], []) for _ in texts]
        for number, sentence, values in zip(owners, places, marginals, strict=True):
            out[number][0].extend(values)
            if max(values) >= TOXIC:
                spans = zip(token_spans(texts[number], sentence), values, strict=True)
                out[number][1].extend((a, b, p) for (a, b), p in spans if p >= TOXIC)
        return out


def evidence(marginals: list[float]) -> tuple[float, float]:
    """Log odds of at least one toxic token, and log of one more than the expected number of them."""
    p = np.clip(marginals, 0.0, 1 - 1e-9)
    none = float(np.log1p(-p).sum())
    some = -np.expm1(none)
    return float(np.clip(np.log(max(some, 1e-6)) - none, -8.0, 8.0)), float(np.log1p(p.sum()))


def fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression with a small ridge, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    value = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-x @ value))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(value))
        value = value + np.linalg.solve(hessian, x.T @ (y - p) - 0.5 * value)
    return value


def _toxic_word(chosen: list[str]) -> Callable[[str], bool]:
    starts, words = {t for t in chosen if t[0] != "="}, {t[1:] for t in chosen if t[0] == "="}

    def is_toxic(word: str) -> bool:
        low = word.lower()
        return low in words or any(low[:n] in starts for n in BEGINNINGS)

    return is_toxic


def _known_terms(chosen: list[str]) -> Callable:
    """The features of toxic tokens."""

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, found = Remembered(_toxic_word(chosen)), set()
        for batch in batches:
            for text in batch.column("text"):
                found.update(t for word in set(TOKEN.findall(text.as_py() or "")) if toxic[word] for t in terms(word))
        yield pa.record_batch([pa.array(sorted(found), pa.string())], ["term"])

    return known


LESSONS = "features array<array<int>>, marks array<int>, times long"


def _lessons(chosen: list[str], known: dict[str, int]) -> Callable:
    """Every sentence of every text as the features of its tokens and their labels, equal ones counted together."""

    def rows(counted: Counter) -> pa.RecordBatch:
        keys = list(counted)
        return pa.record_batch(
            [
                pa.array([k[0] for k in keys], pa.list_(pa.list_(pa.int32()))),
                pa.array([k[1] for k in keys], pa.list_(pa.int32())),
                pa.array([counted[k] for k in keys], pa.int64()),
            ],
            ["features", "marks", "times"],
        )

    def lessons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, features = Remembered(_toxic_word(chosen)), features_of(known)
        counted: Counter = Counter()
        for batch in batches:
            for text, label in zip(batch.column("text"), batch.column("label").to_pylist(), strict=True):
                for part in SENTENCE.findall(text.as_py() or ""):
                    words = TOKEN.findall(part)
                    for at in range(0, len(words), SEQUENCE):
                        own = words[at : at + SEQUENCE]
                        counted[tuple(features[w] for w in own), tuple(int(bool(label) and toxic[w]) for w in own)] += 1
                if len(counted) > COUNTED_SENTENCES:
                    yield rows(counted)
                    counted = Counter()
        yield rows(counted)

    return lessons


def _fitted(size: int) -> Callable:
    def flat(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """The lessons as numbers behind each other: a Python object per token would take ten times the memory."""
        tokens = batch.column("features").flatten()
        kinds = (np.int32, np.int16, np.int32, np.int8, np.int64)
        columns = (batch.column("features").value_lengths(), tokens.value_lengths(), tokens.flatten(), batch.column("marks").flatten(), batch.column("times"))
        return tuple(column.to_numpy().astype(kind) for column, kind in zip(columns, kinds, strict=True))

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lessons = [np.concatenate(v) for v in zip(*map(flat, batches), strict=True)] or [np.zeros(0, np.int64)] * 5
        weights, steps = fit_flat(*lessons, size)
        yield pa.record_batch([pa.array([v.tolist()], pa.list_(pa.float64())) for v in (weights, steps)], ["weights", "chain"])

    return fitted


def _evidence(model: dict) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model["known"], model["weights"], model["chain"])
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                found = [evidence(values) for values, _ in tagger([t or "" for t in part.column("text").to_pylist()])]
                columns = [pa.array(v, pa.float64()) for v in zip(*found, strict=True)]
                yield pa.record_batch([part.column("label"), *columns], ["label", "some", "amount"])

    return run


def held_out(doc_id: Column) -> Column:
    """Whether a document's label may not be learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def _beyond_chance(counted: DataFrame, share: float) -> DataFrame:
    """(docs, toxic) of terms that are toxic more often than labels dealt at random explain, by Chernoff's bound."""
    same = Window.partitionBy("docs")
    part = F.col("toxic") / F.col("docs")
    rest = F.when(part < 1, (1 - part) * F.log((1 - part) / (1 - share))).otherwise(0.0)
    counts = counted.groupBy("docs", "toxic").agg(F.count("*").alias("terms"))
    counts = counts.withColumns(
        {
            "all": F.sum("terms").over(same),
            "observed": F.sum("terms").over(same.orderBy(F.desc("toxic")).rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    counts = counts.filter(part > share)
    chance = F.col("all") * F.exp(-F.col("docs") * (part * F.log(part / share) + rest))
    return counts.filter(chance < BY_CHANCE * F.col("observed")).select("docs", "toxic")


def _sampled(train: DataFrame, sizes: dict[int, int], label: int, sample_docs: int) -> DataFrame:
    """The labelled rows of the ``sample_docs`` ids with the smallest hashes; ids are chosen before texts are read."""
    place = F.pmod(F.xxhash64(F.col("id"), F.lit(7)), F.lit(10**9))
    # A bound on the hash, from the number of rows, keeps most others where they are.
    bound = int(min(1.0, 1.3 * sample_docs / max(sizes.get(label, 0), 1) + 1e-4) * 10**9) + 1
    near = train.filter((F.col("label") == label) & (place < bound))
    chosen = near.select("id", place.alias("place")).distinct().orderBy("place", "id").limit(sample_docs)
    return near.join(F.broadcast(chosen.select("id")), "id", "left_semi").select("label", "text")


def learn(
    docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, candidates: int = CANDIDATES, rounds: int = COVERS,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
) -> dict | None:
    """The model (known, weights, chain, curve), or None when a class has no labelled row.

    Bounds: ``sample_docs`` labelled documents of each class for steps 2 to 4, ``candidates`` terms to choose toxic words
    from, in ``rounds`` covers.
    """
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    marks = marks.filter("id is not null and label is not null").groupBy("id").agg((F.max("label") != 0).cast("int").alias("label"))
    marks = small(marks.filter(~held_out(F.col("id"))))
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    train = keep(plain.join(marks, "id").select("id", "label", "text"), "labelled")
    sizes = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    if len(sizes) < 2:
        discard(train)
        return None
    counted = train.mapInArrow(_count, "term string, toxic long, docs long")
    counted = keep(counted.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("docs").alias("docs")), "counted-terms")
    share = sizes[1] / (sizes[0] + sizes[1])
    odds = F.log((F.col("toxic") + 0.5) / (F.col("docs") - F.col("toxic") + 0.5))
    weighed = counted.withColumn("weight", odds - max(0.0, float(np.log(share / (1 - share))))).filter("weight > 0 and toxic > 0")
    certain = small(keep(_beyond_chance(counted, share), "certain-counts"))
    by_rank = [F.desc(F.col("toxic") * F.col("weight")), F.desc("toxic"), "term"]
    pure = weighed.join(certain, ["docs", "toxic"], "left_semi").orderBy(*by_rank).limit(candidates).collect()
    pure = pure or weighed.orderBy(*by_rank).limit(candidates).collect()
    toxic = keep(_sampled(train, sizes, 1, sample_docs), "toxic-sample")
    both = toxic.union(_sampled(train, sizes, 0, sample_docs))
    found = toxic.mapInArrow(_marked({r["term"]: i for i, r in enumerate(pure)}), "found array<int>").collect()
    least_gain = max(1, math.ceil(LEAST_SHARE * len(found)))
    chosen = covers([r["found"] for r in found], [r["term"] for r in pure], [r["weight"] for r in pure], least_gain, rounds)
    chosen = [pure[i]["term"] for i in chosen]
    # Features of the toxic tokens of the sample.
    names = toxic.mapInArrow(_known_terms(chosen), "term string").distinct().collect()
    known = {name: n for n, name in enumerate(sorted(r["term"] for r in names))}
    lessons = both.mapInArrow(_lessons(chosen, known), LESSONS).groupBy("features", "marks").agg(F.sum("times").alias("times"))
    # In one order, so that sums come out the same; Spark sorts them, which can spill.
    lessons = lessons.coalesce(1).sortWithinPartitions("features", "marks")
    fitted = lessons.mapInArrow(_fitted(len(known)), "weights array<double>, chain array<double>").first()
    model = {"known": known, "weights": list(fitted["weights"]), "chain": list(fitted["chain"])}
    seen = both.mapInArrow(_evidence(model), "label int, some double, amount double").collect()
    seen = np.array(sorted(tuple(r) for r in seen), float)
    model["curve"] = fit_curve(seen[:, 1:], seen[:, 0]).tolist()
    for stored in (counted, train, toxic):
        discard(stored)
    return model


def _scored(model: dict, name: str, carried: bool) -> Callable:
    """Scores beside the columns of the rows, or beside their id with counts and spans."""
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger, curve = Tagger(model["known"], model["weights"], model["chain"]), np.array(model["curve"])
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                found = tagger([t or "" for t in part.column(name).to_pylist()])
                x = np.array([(*evidence(values), 1.0) for values, _ in found])
                scores = pa.array(1 / (1 + np.exp(-(x @ curve))))
                if carried:
                    yield pa.record_batch([*part.columns, scores], [*part.schema.names, "__score"])
                    continue
                counts = pa.array([float(sum(values)) for values, _ in found])
                spans = [[{"start": a, "end": b, "marginal": p} for a, b, p in own] for _, own in found]
                yield pa.record_batch([part.column("doc_id"), scores, counts, pa.array(spans, spans_type)], ["doc_id", "score", "toxic_tokens", "spans"])

    return run


SCORED = "score double, toxic_tokens double, spans array<struct<start:int,end:int,marginal:double>>"


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, score, toxic_tokens (expected number) and the offending spans (code points)."""
    model = learn(docs, labels, id_col=id_col, text_col=text_col, **options)
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if model is None:
        kind = SCORED.split("spans ")[1]
        return plain.select("doc_id", F.lit(0.0).alias("score"), F.lit(0.0).alias("toxic_tokens"), F.array().cast(kind).alias("spans"))
    return plain.mapInArrow(_scored(model, "text", False), f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, {SCORED}")


def decent_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; rows are judged one by one, whatever their id."""
    model = learn(docs, labels, id_col=id_col, text_col=text_col, **options)
    if model is None:
        return docs
    scored = T.StructType([*docs.schema.fields, T.StructField("__score", T.DoubleType())])
    return docs.mapInArrow(_scored(model, text_col, True), scored).filter(F.col("__score") < threshold).drop("__score")
