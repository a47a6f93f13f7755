"""Measured, not estimated, decisions about what is small enough to broadcast."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SMALL_SOURCE_ROWS_CONF = "tablecraft.smallSourceRows"
DEFAULT_SMALL_SOURCE_ROWS = 1_000_000
SMALL_SOURCE_BYTES_CONF = "tablecraft.smallSourceBytes"
DEFAULT_SMALL_SOURCE_BYTES = 64 * 1024 * 1024

# Bytes a value takes beside its text, and a value of any other type as a whole.
_VALUE_BYTES = 16


def _width(field: T.StructField) -> Column:
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + _VALUE_BYTES
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + _VALUE_BYTES
    return F.lit(_VALUE_BYTES)


def is_small(df: DataFrame, rows: int | None = None) -> bool:
    """Whether a frame is within the limits of rows and bytes; ``rows`` saves counting again.

    Bytes are measured only when the number of rows is within its limit.
    """
    conf = df.sparkSession.conf
    max_rows = int(conf.get(SMALL_SOURCE_ROWS_CONF, str(DEFAULT_SMALL_SOURCE_ROWS)))
    if max_rows < 0 or (rows is not None and rows > max_rows):
        return False
    max_bytes = int(conf.get(SMALL_SOURCE_BYTES_CONF, str(DEFAULT_SMALL_SOURCE_BYTES)))
    width = reduce(lambda a, b: a + b, [_width(f) for f in df.schema.fields], F.lit(0)).cast("long")
    measured = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes")).first()
    return measured["rows"] <= max_rows and measured["bytes"] <= max_bytes
