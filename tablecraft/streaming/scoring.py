"""Predictions and label tallies over streams."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from tablecraft.operators.agreement import label_tally
from tablecraft.operators.scoring import predict


def predict_stream(
    rows: DataFrame,
    load_model: Callable[[], Any],
    features: Sequence[str],
    output_path: str,
    checkpoint: str,
    *,
    available_now: bool = True,
    **options: Any,
) -> StreamingQuery:
    """Append predictions for every arriving row; the same stateless map as in batch."""
    scored = predict(rows, load_model, features, **options)
    writer = (
        scored.writeStream.format("parquet")
        .outputMode("append")
        .option("path", output_path)
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def tally_stream(
    rows: DataFrame,
    value: Column,
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    *,
    available_now: bool = True,
    interval: str = "30 seconds",
) -> StreamingQuery:
    """Running count per label, handed to ``write`` after each micro-batch.

    State is one counter per distinct label. Without ``available_now`` the query
    looks for new rows every ``interval``.
    """
    writer = (
        label_tally(rows, value)
        .writeStream.outputMode("complete")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
    )
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start()
