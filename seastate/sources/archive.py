"""Forecast and observation archives: scan, write, compare, plan work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.ordered import latest_by
from ..session import materialise
from . import manifest, snapshots
from .fold import fold

#: Stations of one month share so many folders, so files grow in size, not in number, with the stations.
FOLDERS = 64
FORECAST_PARTITIONS = ["model", "part", "year", "month"]
OBS_PARTITIONS = ["part", "year", "month"]


def part_of(station: Column) -> Column:
    """The folder a station falls into."""
    return F.format_string("%02d", F.pmod(F.xxhash64(station), F.lit(FOLDERS)))


def read_forecasts(spark: SparkSession, root: str, models=None, stations=None, months=None,
                   columns: list[str] | None = None) -> DataFrame:
    """Archive scan. Filters on model, station and (year, month) pick folders before any file is listed; a file that cannot be read fails the scan."""
    which = F.lit(True)
    if models:
        which = which & F.col("model").isin(*models)
    if stations:
        which = which & F.col("part").isin(*[part_of(F.lit(s)) for s in stations])
    if months:
        test = F.lit(False)
        for y, m in months:
            test = test | ((F.col("year") == str(y)) & (F.col("month") == f"{m:02d}"))
        which = which & test
    df = snapshots.load(spark, root, schemas.FORECAST, FORECAST_PARTITIONS, which)
    if stations:
        df = df.filter(F.col("station").isin(*stations))
    return df.select(*columns) if columns else df.drop("part", "year", "month")


def with_folders(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumns({"part": part_of(F.col("station")), "year": F.date_format(ts, "yyyy"), "month": F.date_format(ts, "MM")})


def missing_cycles(rows: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of cycles the archive does not hold yet."""
    return rows.join(existing.select(*keys).distinct(), keys, "left_anti")


def write_forecasts(rows: DataFrame, root: str, force: bool = False) -> None:
    """Add cycles to the archive: one file set per model, month and folder of stations.

    Present cycles are skipped unless forced; forced cycles are rewritten per month together with what the month already holds.
    Either way rows are written once and become visible all at once.
    """
    spark = rows.sparkSession
    keys = ["model", "station", "cycle_utc"]
    new = with_folders(rows, "cycle_utc")
    if not snapshots.exists(spark, root):
        snapshots.append_rows(new, root, FORECAST_PARTITIONS)
        return
    old = snapshots.touched(new, root, schemas.FORECAST, FORECAST_PARTITIONS)
    if force:
        snapshots.replace_parts(missing_cycles(old, new, keys).unionByName(new.select(*old.columns)), root, FORECAST_PARTITIONS)
    else:
        snapshots.append_rows(missing_cycles(new, old, keys), root, FORECAST_PARTITIONS)


def read_observations(spark: SparkSession, roots: list[str], drifted: DataFrame | None = None) -> DataFrame:
    """Both archive roots, explicit schema, one union; files listed in ``drifted`` are left out of the scan.

    A file that cannot be read fails the scan, also beside a report: only what the report names is passed over.
    """
    if drifted is not None:
        listed = None
        for r in roots:
            one = manifest.data_files(spark, r)
            listed = one if listed is None else listed.unionByName(one)
        return manifest.read_files(spark, listed.join(drifted.select("path"), "path", "left_anti"), schemas.OBS).drop("path")
    out = None
    for r in roots:
        stored = snapshots.exists(spark, r)
        df = snapshots.load(spark, r, schemas.OBS, OBS_PARTITIONS).drop("part", "year", "month") if stored else spark.read.schema(schemas.OBS).parquet(r)
        out = df if out is None else out.unionByName(df)
    return out


def schema_drift(spark: SparkSession, roots: list[str], expected: list[str]) -> DataFrame:
    """(path, missing, error) for parquet files that lack expected columns or whose footer cannot be read."""
    return manifest.manifest(spark, roots, expected).where(manifest.faulty()).select("path", "missing", "error")


def verified_observations(spark: SparkSession, roots: list[str]) -> tuple[manifest.CountedScan, DataFrame]:
    """(the readings of all files that are whole, counted; a report of the others).

    Every file is decoded once for the report, so a spoilt page, a truncated and a missing file are all found before the scan; ``check`` on
    the scan compares the rows it gave with the manifest.
    """
    expected = [c.split()[0] for c in schemas.OBS.split(", ")]
    inside = [c for c in expected if c not in OBS_PARTITIONS]
    listed = materialise(manifest.manifest(spark, roots, inside), "manifest")
    report = materialise(manifest.verify(spark, listed, schemas.OBS), "scan-report")
    whole = listed.join(report.where("state = 'ok'").select("path"), "path", "left_semi")
    return manifest.counted(spark, whole, schemas.OBS), report.where("state != 'ok'")


OBS_KEYS = ["station", "valid_utc", "partition"]


def _obs_order() -> list[Column]:
    return [F.col("ingest_utc"), F.col("source"), F.struct("hs_m", "tp_s", "dp_deg")]


def _with_values(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("hs_m").isNotNull() | F.col("tp_s").isNotNull() | F.col("dp_deg").isNotNull())


def clean_observations(rows: DataFrame) -> DataFrame:
    """Drop all-null readings; one row per (station, valid time, partition), latest ingest wins."""
    return latest_by(_with_values(rows), OBS_KEYS, _obs_order())


def write_observations(rows: DataFrame, root: str) -> None:
    """Merge readings into the archive: stored months keep their rows, the latest ingest wins per reading."""
    fold(with_folders(_with_values(rows), "valid_utc"), root, schemas.OBS, OBS_KEYS, _obs_order(), OBS_PARTITIONS)


def pivot_samples(samples: DataFrame, keys: list[str], variable: str, value: str, names: list[str]) -> DataFrame:
    """Decoded samples (one row per variable) to one wide row per time; names fix the columns."""
    return samples.groupBy(*keys).agg(*[F.max(F.when(F.col(variable) == n, F.col(value))).alias(n) for n in names])


def work_list(stations: DataFrame, start: str, end: str, step_hours: int, done: DataFrame, key: str = "station") -> DataFrame:
    """Every (station, cycle) of a range that is not done yet.

    The cycles are a sequence exploded on each station row.
    """
    cycles = F.sequence(F.to_timestamp(F.lit(start)), F.to_timestamp(F.lit(end)), F.expr(f"INTERVAL {step_hours} HOURS"))
    return (stations.select(key).distinct().withColumn("cycle_utc", F.explode(cycles))
            .join(done.select(key, "cycle_utc").distinct(), [key, "cycle_utc"], "left_anti"))


def month_list(stations: DataFrame, start: str, end: str, done: DataFrame, key: str = "station") -> DataFrame:
    months = F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)), F.expr("INTERVAL 1 MONTH"))
    return (stations.select(key).distinct().withColumn("_m", F.explode(months))
            .select(key, F.date_format("_m", "yyyy-MM").alias("month"))
            .join(done.select(key, "month").distinct(), [key, "month"], "left_anti"))


def prefer_source(rows: DataFrame, keys: list[str], priority: Column) -> DataFrame:
    """One row per key from the source with the lowest priority number, later ingest on ties."""
    return latest_by(rows, keys, [-priority, F.col("ingest_utc"), F.struct("hs_m", "tp_s", "dp_deg")])


def load_report(rows: DataFrame, by: list[str]) -> DataFrame:
    """Counts per source and station: rows, all-null rows, rows without direction, span."""
    empty = F.col("hs_m").isNull() & F.col("tp_s").isNull() & F.col("dp_deg").isNull()
    return rows.groupBy(*by).agg(
        F.count("*").alias("rows"), F.count_if(empty).alias("empty_rows"),
        F.count_if(F.col("dp_deg").isNull()).alias("no_direction"), F.count_if(F.col("tp_s").isNull()).alias("no_period"))
