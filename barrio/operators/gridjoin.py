"""Distance and box joins as equi-joins on grid keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barrio.functions.geo import distance_m, lat_step, lng_step
from barrio.operators.keyed import keyed_join, large_join

KEYS = ["_gy", "_gx"]


def with_cell(df: DataFrame, cell_m: float, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """Add the grid cell of each position."""
    row = F.floor(F.col(lat) / F.lit(lat_step(cell_m)))
    column = F.floor(F.col(lng) / lng_step(row, cell_m))
    return df.select("*", row.alias("_gy"), column.alias("_gx"))


def with_reach(
    df: DataFrame, cell_m: float, radius: Column, lat: str = "lat", lng: str = "lng"
) -> DataFrame:
    """One copy of each row per grid cell that its circle of `radius` metres can touch."""
    step = F.lit(lat_step(cell_m))
    reach_lat = radius / F.lit(110574.0)
    row_ids = F.sequence(
        F.floor((F.col(lat) - reach_lat) / step), F.floor((F.col(lat) + reach_lat) / step)
    )
    rows = df.select("*", radius.alias("_reach"), F.explode(row_ids).alias("_gy"))
    width = lng_step(F.col("_gy"), cell_m)
    # Radius in degrees, at the latitude where it spans most degrees.
    reach_lng = F.col("_reach") / F.lit(cell_m) * width
    columns = F.sequence(
        F.floor((F.col(lng) - reach_lng) / width), F.floor((F.col(lng) + reach_lng) / width)
    )
    return rows.select("*", F.explode(columns).alias("_gx"))


def within_distance(
    places: DataFrame,
    centres: DataFrame,
    radius: Column,
    cell_m: float,
    on: list[str] | None = None,
    condition: Column | None = None,
) -> DataFrame:
    """Pairs no farther apart than `radius` metres, with `distance_m`.

    `places` has lat, lng; `centres` has c_lat, c_lng and is the side copied to neighbouring
    cells. `on` adds equality keys. Cells or keys that hold many rows are left to the planner. Half of what
    shares a cell lies outside the circle's box, which is told by two comparisons before any distance is computed.
    """
    keys = [*KEYS, *(on or [])]
    # No degree of latitude is shorter than 110,574 m, none of longitude than 111,319 m times the cosine of the latitude.
    high = radius * F.lit(1.000001) / F.lit(110574.0)
    pole = F.least(F.abs("c_lat") + high, F.lit(89.99999999))
    wide = radius * F.lit(1.000001) / (F.lit(111319.0) * F.cos(F.radians(pole)))
    boxed = centres.select("*", high.alias("_high"), wide.alias("_wide"))
    in_box = (F.abs(F.col("lat") - F.col("c_lat")) <= F.col("_high")) & (F.abs(F.col("lng") - F.col("c_lng")) <= F.col("_wide"))
    pairs = large_join(
        with_cell(places, cell_m), with_reach(boxed, cell_m, radius, "c_lat", "c_lng"), keys
    ).where(in_box if condition is None else in_box & condition)
    away = distance_m(F.col("c_lat"), F.col("c_lng"), F.col("lat"), F.col("lng"))
    return (
        pairs.select("*", away.alias("distance_m"))
        .where(F.col("distance_m") <= F.col("_reach")).drop("_reach", "_high", "_wide", *KEYS)
    )


# Tiles of 2^-12 degrees are some 27 m wide; 2^9 degrees hold every box on the globe.
LEAST_LEVEL, MOST_LEVEL = -12, 9


def level_of(north: Column, south: Column, east: Column, west: Column) -> Column:
    """Tile level of a box: tiles of 2^level degrees are at least as large as the box."""
    extent = F.least(F.greatest(north - south, east - west, F.lit(2.0**LEAST_LEVEL)), F.lit(2.0**MOST_LEVEL))
    return F.ceil(F.log2(extent)).cast("int")


def in_boxes(
    places: DataFrame,
    boxes: DataFrame,
) -> DataFrame:
    """Pairs of places and boxes (north, south, east, west) that contain them.

    Each box takes the tile level that fits its size, so it touches at most four tiles, and
    places are keyed once per level. Levels run from LEAST_LEVEL to that of the whole globe.
    """
    sized = boxes.select("*", level_of(*map(F.col, ("north", "south", "east", "west"))).alias("_level"))
    tile = F.pow(F.lit(2.0), F.col("_level").cast("double"))
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / tile), F.floor(F.col(hi) / tile))
    tiled = sized.select("*", F.explode(span("south", "north")).alias("_ty"))
    tiled = tiled.select("*", F.explode(span("west", "east")).alias("_tx"))
    keyed = places.select("*", F.explode(F.array(*[F.lit(v) for v in range(LEAST_LEVEL, MOST_LEVEL + 1)])).alias("_level"))
    keyed = keyed.select(
        "*", F.floor(F.col("lat") / tile).alias("_ty"), F.floor(F.col("lng") / tile).alias("_tx")
    )
    inside = F.col("lat").between(F.col("south"), F.col("north")) & F.col("lng").between(
        F.col("west"), F.col("east")
    )
    return keyed_join(
        keyed, tiled, ["_level", "_ty", "_tx"], inside
    ).drop("_level", "_ty", "_tx")
