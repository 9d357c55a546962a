"""Wind grids, spot winds, model run schedules and freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import units as U
from .ordered import epoch

# Default publication hours in UTC and hours from init to publication.
RUN_HOURS = {"A": (7, 19), "B": (4, 10, 16, 22)}
INIT_OFFSET_HOURS = {"A": 7, "B": 4}


def dedup_points(spots: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Distinct coordinates to compute once, as ``point`` rows."""
    return spots.select(lat, lon).distinct()


def back_to_spots(spots: DataFrame, computed: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Results per point back on every spot that shares it."""
    return spots.join(computed, [lat, lon])


def grid_arrays(grid: DataFrame, keys: list[str], idx: str, speed: str, direction: str) -> DataFrame:
    """Per time step one ordered array of u and one of v.

    A map has a fixed number of points, so the arrays are bounded by the grid.
    Missing wind stays null.
    """
    uv = grid.select(*keys, F.struct(F.col(idx).alias("i"), U.wind_u(F.col(speed), F.col(direction)).alias("u"),
                                     U.wind_v(F.col(speed), F.col(direction)).alias("v")).alias("p"))
    g = uv.groupBy(*keys).agg(F.array_sort(F.collect_list("p")).alias("_p"))
    return g.select(*keys, F.transform("_p", lambda p: p["u"]).alias("u"), F.transform("_p", lambda p: p["v"]).alias("v"))


def cell_index(value: Column, origin: float, step: float) -> Column:
    """Index of the nearest line of a regular grid."""
    return F.floor((value - F.lit(float(origin))) / F.lit(float(step)) + 0.5).cast("int")


def nearest_cell(points: DataFrame, grid: DataFrame, lat0: float, lon0: float, step: float) -> DataFrame:
    """Nearest grid point by rounding to a cell: an equi join, no distances."""
    def cells(df: DataFrame) -> DataFrame:
        return df.withColumns({"_row": cell_index(F.col("lat"), lat0, step), "_col": cell_index(F.col("lon"), lon0, step)})

    g = cells(grid).withColumnRenamed("lat", "cell_lat").withColumnRenamed("lon", "cell_lon")
    return cells(points).join(g, ["_row", "_col"]).drop("_row", "_col")


def current_run(df: DataFrame, at: str, hours: tuple[int, ...], init_offset_h: int) -> DataFrame:
    """The run on offer at an instant: when published, its init time, hours to the next.

    The schedule is a handful of hours per day, so candidates of yesterday,
    today and tomorrow sit in one array on the row: no join.
    """
    day = F.unix_timestamp(F.date_trunc("day", at))
    slots = F.array(*[day + (d * 86400 + h * 3600) for d in (-1, 0, 1) for h in sorted(hours)])
    now = epoch(F.col(at))
    past = F.array_max(F.filter(slots, lambda s: s <= now))
    nxt = F.array_min(F.filter(slots, lambda s: s > now))
    init = past - init_offset_h * 3600
    return df.withColumns({
        "available_since": F.timestamp_seconds(past), "run_time": F.timestamp_seconds(init),
        "run_utc": F.date_format(F.timestamp_seconds(init), "HH'Z'"),
        "hours_to_next": F.round((nxt - now) / 3600.0, 1)})


def stale_since(ingested: Column, now: Column, hours: tuple[int, ...]) -> Column:
    """True when a publication hour lies in (ingested, now], or nothing was ingested."""
    i, n = epoch(ingested), epoch(now)
    hit = F.lit(False)
    for h in hours:
        last = F.floor((n - h * 3600) / 86400) * 86400 + h * 3600
        hit = hit | (last > i)
    return F.when(ingested.isNull(), F.lit(True)).otherwise(hit)


def regions_with_clean_wind(spot_winds: DataFrame, ratings: list[str]) -> DataFrame:
    """(region, hour) pairs in which the wind of at least one spot has one of these ratings."""
    return (spot_winds.groupBy("region", "hour_utc")
            .agg(F.count_if(F.col("rating").isin(*ratings)).alias("clean_spots"))
            .filter(F.col("clean_spots") > 0))
