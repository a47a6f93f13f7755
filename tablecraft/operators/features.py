"""Feature lookups by key and point in time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import timedelta
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecraft.operators.skew import carry, skew_join


@dataclass(frozen=True)
class FeatureLookup:
    """Which features of a table to attach, by which key and as of which time.

    ``feature_timestamp`` names the time column of the feature table when it
    differs from ``timestamp_lookup_key`` of the labels. ``default_values`` are
    keyed by the original feature names.
    """

    table_name: str
    lookup_key: str | Sequence[str]
    feature_names: Sequence[str]
    timestamp_lookup_key: str | None = None
    rename_outputs: Mapping[str, str] = field(default_factory=dict)
    lookback_window: timedelta | None = None
    default_values: Mapping[str, Any] = field(default_factory=dict)
    feature_timestamp: str | None = None

    @classmethod
    def from_config(cls, entry: Mapping[str, Any]) -> "FeatureLookup":
        """Build from a dict; ``feature_store_name`` is accepted for ``table_name``."""
        options = {k: v for k, v in entry.items() if v is not None}
        store = options.pop("feature_store_name", None)
        if store is not None:
            options.setdefault("table_name", store)
        if "table_name" not in options:
            raise ValueError("a feature lookup needs a table_name")
        days = options.get("lookback_window")
        if isinstance(days, (int, float)):
            options["lookback_window"] = timedelta(days=days)
        return cls(**options)

    @property
    def keys(self) -> list[str]:
        return [self.lookup_key] if isinstance(self.lookup_key, str) else list(self.lookup_key)

    def output_name(self, feature: str) -> str:
        return self.rename_outputs.get(feature, feature)


def _outputs(lookup: FeatureLookup, value_of) -> list[Column]:
    columns = []
    for name in lookup.feature_names:
        value = value_of(name)
        if name in lookup.default_values:
            value = F.coalesce(value, F.lit(lookup.default_values[name]))
        columns.append(value.alias(lookup.output_name(name)))
    return columns


def lookup_features(labels: DataFrame, features: DataFrame, lookup: FeatureLookup) -> DataFrame:
    """Attach the lookup's features to every label row, nulls (or defaults) where there are none."""
    clash = [lookup.output_name(f) for f in lookup.feature_names if lookup.output_name(f) in labels.columns]
    if clash:
        raise ValueError(f"labels already have columns {clash}: use rename_outputs")
    if lookup.timestamp_lookup_key:
        return _on_timeline(labels, [(lookup, features)])
    known = [F.col(k).isNotNull() for k in lookup.keys]
    picked = features.where(reduce(lambda a, b: a & b, known)).groupBy(*lookup.keys).agg(
        F.count(F.lit(1)).alias("__rows"), *[F.first(f).alias(f"__first_{f}") for f in lookup.feature_names]
    )
    picked = picked.where(F.when(F.col("__rows") == 1, F.lit(True)).otherwise(_repeated(lookup).cast("boolean"))).select(
        *lookup.keys, *[F.col(f"__first_{f}").alias(f"__feature_{f}") for f in lookup.feature_names]
    )
    joined = skew_join(labels, picked, lookup.keys, "left")
    return joined.select(*labels.columns, *_outputs(lookup, lambda f: F.col(f"__feature_{f}")))


Lookup = tuple[FeatureLookup, DataFrame]


def _repeated(lookup: FeatureLookup) -> Column:
    """Raises: one row per key, or the label rows would multiply."""
    return F.raise_error(F.lit(f"{lookup.table_name} has several rows of one key of {lookup.keys}"))


def _on_timeline(labels: DataFrame, lookups: Sequence[Lookup]) -> DataFrame:
    """Attach lookups of the same keys in one pass, the first of them as of a time.

    Labels and the features of all tables share one timeline per key, so there is one exchange for all of them, and one
    sort per time column of the labels. The newest features at or before the label's time count; those of the same
    instant as well. Features travel as one struct per lookup, so that a null feature value hides older ones instead of
    letting them through. Features without a time stand at the beginning of the timeline.
    """
    keys = lookups[0][0].keys
    key_names = [f"__key_{i}" for i in range(len(keys))]
    times = list(dict.fromkeys(lk.timestamp_lookup_key for lk, _ in lookups if lk.timestamp_lookup_key))

    def rows(df: DataFrame, instants: Mapping[str, str], side: int, content: Column) -> DataFrame:
        """A part of the timeline; ``instants`` names the column of ``df`` for each time."""
        return df.select(
            *[F.col(k).alias(n) for k, n in zip(keys, key_names)],
            *[F.col(c).alias(f"__ts_{times.index(t)}") for t, c in instants.items()],
            F.lit(side).alias("__side"),
            content,
        )

    known = reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in key_names])
    timeline = rows(labels, {t: t for t in times}, 1, F.struct(*labels.columns).alias("__label"))
    usable, values = [], {t: {} for t in times}
    for i, (lookup, features) in enumerate(lookups):
        ts = lookup.timestamp_lookup_key
        own = [F.col(f).alias(f"f_{f}") for f in lookup.feature_names]
        if ts:
            seen = lookup.feature_timestamp or ts
            instant, here = f"__ts_{times.index(ts)}", known & F.col(f"__ts_{times.index(ts)}").isNotNull()
            part = rows(features, {ts: seen}, 0, F.struct(F.col(seen).alias("ts"), *own).alias(f"__feature_{i}"))
            fresh = here
            if lookup.lookback_window is not None:
                fresh = here & (F.col(f"__found_{i}.ts") >= F.col(instant) - F.lit(lookup.lookback_window))
        else:
            part, here, fresh = rows(features, {}, 0, F.struct(*own).alias(f"__feature_{i}")), known, known
        timeline = timeline.unionByName(part.where(here), allowMissingColumns=True)
        usable.append(fresh)
        values[ts or times[0]][f"__found_{i}"] = F.col(f"__feature_{i}")
    for t in times:
        timeline = carry(timeline, key_names, [f"__ts_{times.index(t)}", "__side"], values[t])

    wanted = F.col("__side") == 1
    for i, (lookup, _) in enumerate(lookups):
        if not lookup.timestamp_lookup_key:
            again = F.col(f"__feature_{i}").isNotNull() & F.col(f"__found_{i}").isNotNull()
            wanted = F.when(again, _repeated(lookup).cast("boolean")).otherwise(wanted)
    outputs = [
        c
        for i, (lookup, _) in enumerate(lookups)
        for c in _outputs(lookup, lambda f, i=i: F.when(usable[i], F.col(f"__found_{i}.f_{f}")))
    ]
    return timeline.where(wanted).select(*[F.col(f"__label.{c}").alias(c) for c in labels.columns], *outputs)


def _shared(labels: DataFrame, lookups: Sequence[Lookup]) -> list[list[Lookup]]:
    """``lookups`` in groups that one timeline can serve: same keys in the same types, at least one as of a time."""

    def fits(lookup: FeatureLookup, features: DataFrame) -> bool:
        ts = lookup.timestamp_lookup_key
        pairs = [(k, k) for k in lookup.keys] + ([(ts, lookup.feature_timestamp or ts)] if ts else [])
        return all(
            c in labels.columns and f in features.columns and labels.schema[c].dataType == features.schema[f].dataType
            for c, f in pairs
        )

    groups: dict[Any, list[Lookup]] = {}
    for i, (lookup, features) in enumerate(lookups):
        groups.setdefault(tuple(lookup.keys) if fits(lookup, features) else i, []).append((lookup, features))
    shared = []
    for group in groups.values():
        group.sort(key=lambda g: g[0].timestamp_lookup_key is None)
        timed = group[0][0].timestamp_lookup_key is not None
        shared.extend([group] if timed else [[g] for g in group])
    return shared


def _attach_all(labels: DataFrame, lookups: Sequence[Lookup]) -> DataFrame:
    """Attach all lookups; those whose keys and time the labels have already come first, together."""
    names = [*labels.columns, *[lk.output_name(f) for lk, _ in lookups for f in lk.feature_names]]
    result, left = labels, list(lookups)
    while left:
        ready = [g for g in left if {*g[0].keys, g[0].timestamp_lookup_key} - {None} <= {*result.columns}] or left
        for group in _shared(result, ready):
            clash = [lk.output_name(f) for lk, _ in group for f in lk.feature_names if lk.output_name(f) in result.columns]
            if clash or len(group) == 1:
                for lookup, features in group:
                    result = lookup_features(result, features, lookup)
            else:
                result = _on_timeline(result, group)
        left = [g for g in left if not any(g is r for r in ready)]
    return result.select(*[f"`{n}`" for n in names])


def training_set(
    labels: DataFrame,
    lookups: Sequence[tuple[FeatureLookup, DataFrame]],
    label_column: str | None,
    exclude_columns: Sequence[str] = (),
) -> DataFrame:
    """Labels with the features of all lookups, without the excluded columns.

    Lookups of the same keys are served by one timeline, if one of them is as of a time. A lookup may use the features of
    another one as its keys.
    """
    if label_column is not None and label_column not in labels.columns:
        raise ValueError(f"label column {label_column} is missing")
    outputs = [lk.output_name(f) for lk, _ in lookups for f in lk.feature_names]
    twice = sorted({n for n in outputs if outputs.count(n) > 1})
    if twice:
        raise ValueError(f"several lookups give columns {twice}: use rename_outputs")
    result = _attach_all(labels, lookups)
    return result.drop(*[c for c in exclude_columns if c != label_column])
