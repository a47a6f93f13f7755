"""Places within a radius, as an equi-join on grid cells."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecraft.operators.skew import skew_join

# Default search radius and mean earth radius, both in metres.
DEFAULT_RADIUS = 11265.0
EARTH_RADIUS = 6371008.8


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres between points in degrees."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    h = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return 2 * EARTH_RADIUS * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def _band(lat: Column, height: float) -> Column:
    return F.floor((lat + 90) / height).cast("long")


def _cells_in_band(band: Column, height: float, radius: float) -> Column:
    """Cells around a latitude band, each wide enough that a match lies in the next cell at most.

    Two points within the radius differ in longitude by at most
    ``2 asin(sin(r / 2R) / cos(lat))`` at the latitude nearest a pole; the bands
    next to this one are included. Near a pole a single cell remains.
    """
    south, north = (band - 1) * height - 90, (band + 2) * height - 90
    extreme = F.least(F.greatest(F.abs(south), F.abs(north)), F.lit(90.0))
    reach = math.sin(radius / (2 * EARTH_RADIUS)) / F.greatest(F.cos(F.radians(extreme)), F.lit(1e-12))
    width = F.degrees(2 * F.asin(F.least(reach, F.lit(1.0))))
    return F.greatest(F.floor(360 / width), F.lit(1)).cast("long")


def _cell(lon: Column, n: Column) -> Column:
    return F.pmod(F.floor((lon + 180) * n / 360).cast("long"), n)


def nearby_places(
    centers: DataFrame,
    places: DataFrame,
    radius: float = DEFAULT_RADIUS,
    *,
    types: Sequence[str] | None = None,
    type_column: str = "type",
    center_columns: tuple[str, str] = ("lat", "lon"),
    place_columns: tuple[str, str] = ("lat", "lon"),
) -> DataFrame:
    """Every center with each place within ``radius`` metres, and ``distance_m``.

    Output columns are prefixed ``center_`` and ``place_``. A place lies in one
    grid cell, a center asks for the (at most nine) cells around it, so the join
    is on cell equality; places of a crowded cell are spread over tasks.
    """
    if not radius > 0:
        raise ValueError("the radius must be positive")
    if types is not None:
        places = places.where(F.col(type_column).isin(list(types)))
    # No two points are further apart than half the circumference.
    reach = min(radius, math.pi * EARTH_RADIUS)
    height = math.degrees(reach / EARTH_RADIUS) * (1 + 1e-9)

    p_lat, p_lon = F.col(place_columns[0]), F.col(place_columns[1])
    band = _band(p_lat, height)
    left = places.select(
        *[F.col(c).alias(f"place_{c}") for c in places.columns],
        band.alias("__band"),
        _cell(p_lon, _cells_in_band(band, height, reach)).alias("__cell"),
    )

    c_lat, c_lon = F.col(center_columns[0]), F.col(center_columns[1])
    own = _band(c_lat, height)
    right = centers.select(
        *[F.col(c).alias(f"center_{c}") for c in centers.columns],
        c_lon.alias("__lon"),
        F.explode(F.array(own - 1, own, own + 1)).alias("__band"),
    ).withColumn("__n", _cells_in_band(F.col("__band"), height, reach))
    at = _cell(F.col("__lon"), F.col("__n"))
    around = F.array_distinct(F.array(*[F.pmod(at + step, F.col("__n")) for step in (-1, 0, 1)]))
    right = right.withColumn("__cell", F.explode(around)).drop("__lon", "__n")

    distance = haversine(
        F.col(f"center_{center_columns[0]}"),
        F.col(f"center_{center_columns[1]}"),
        F.col(f"place_{place_columns[0]}"),
        F.col(f"place_{place_columns[1]}"),
    )
    return (
        skew_join(left, right, ["__band", "__cell"], "inner")
        .drop("__band", "__cell")
        .withColumn("distance_m", distance)
        .where(F.col("distance_m") <= radius)
    )
