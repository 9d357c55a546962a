"""Incremental ingestion with Structured Streaming.

Sources are folders of landed files. A batch is folded into a keyed table
whose rows live in per-day partitions; only the touched days are rewritten, in a way that survives a crash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import timefn as T
from ..session import settings
from ..sources.archive import OBS_KEYS
from ..sources.fold import fold
from ..sources.snapshots import drop_parts, load, touched
from ..sources.tables import append_or_update

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_on_disk(spark: SparkSession):
    """For streams begun inside: state in RocksDB, whose memory has one limit per executor, instead of the heap."""
    return settings(spark, spark__sql__streaming__stateStore__providerClass=ROCKS, spark__sql__streaming__stateStore__rocksdb__boundedMemoryUsage="true")


def file_stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return load(spark, path, schema, ["day"])


def upsert_by_day(batch: DataFrame, path: str, schema: str, keys: list[str], ts: str, order: list[str],
                  skip_known: bool = False) -> bool:
    """Fold a batch into the table; the greatest ``order`` wins per key, whole rows deciding ties.

    Days are the unit of rewriting, so the cost follows the batch. Replaying a batch gives the same table, and a crash at
    any point loses nothing (see ``fold``). With ``skip_known`` a batch that would change nothing is not written;
    a revision of a stored reading does change something. Returns whether something was written.
    """
    new = batch.withColumn("day", F.date_format(ts, "yyyy-MM-dd"))
    rest = [c for c in batch.columns if c not in (*keys, *order, "day")]
    return fold(new, path, schema, keys, [F.col(c) for c in (*order, *rest)], ["day"], skip_known)


def run_available(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> None:
    """Process everything that has landed, then stop; restarts continue from the checkpoint."""
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def ingest_observations(stream: DataFrame, path: str, checkpoint: str, skip_known: bool = False) -> None:
    """Latest ingest wins per (station, valid time, partition), late revisions included."""
    order = ["ingest_utc", "source", "hs_m", "tp_s", "dp_deg"]
    run_available(stream, checkpoint, lambda b, _: upsert_by_day(
        b, path, schemas.OBS, OBS_KEYS, "valid_utc", order, skip_known))


def ingest_cycles(stream: DataFrame, path: str, checkpoint: str) -> None:
    """A cycle is idempotent: writing it again replaces its rows."""
    run_available(stream, checkpoint, lambda b, _: upsert_by_day(
        b, path, schemas.FORECAST, ["model", "station", "cycle_utc", "valid_utc"], "cycle_utc", ["ingest_utc"]))


def first_wins(stream: DataFrame, ts: str = "valid_utc", delay: str | None = "2 days") -> DataFrame:
    """Streaming dedupe that keeps the first copy inside the watermark.

    Rows older than the watermark are dropped. Without a ``delay`` there is none: every reading passes once, however late, and state
    grows with the readings (begin such a stream in ``state_on_disk``).
    """
    if delay is None:
        return stream.dropDuplicates(OBS_KEYS)
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(OBS_KEYS)


def hourly_window_counts(stream: DataFrame, ts: str = "valid_utc", delay: str = "2 days") -> DataFrame:
    """Hourly windows shifted by half an hour, so each reading counts for its nearest hour."""
    w = F.window(ts, "1 hour", "1 hour", "30 minutes")
    return (stream.withWatermark(ts, delay).groupBy("station", w)
            .agg(F.count("*").alias("n"), F.avg("hs_m").alias("mean_hs_m"))
            .select("station", F.timestamp_seconds(F.unix_timestamp("window.start") + 1800).alias("hour_utc"), "n", "mean_hs_m"))


def retain(table: DataFrame, ts: str, days: int = 14, now=None) -> DataFrame:
    """Rows of the last ``days`` before ``now``, or before the newest row of the table."""
    limit = F.lit(now).cast("timestamp") if now is not None else table.agg(F.max(ts)).scalar()
    return table.filter(F.col(ts) >= limit - F.expr(f"INTERVAL {days} DAYS"))


def prune_days(spark: SparkSession, path: str, keep_from: str) -> None:
    """Take whole days before a date out of a table: retention without reading or rewriting rows."""
    drop_parts(spark, path, ["day"], F.col("day") < keep_from)


def freshness(table: DataFrame, keys: list[str], ingest: str, now, max_hours: int = 24) -> DataFrame:
    """Hours since the last write per source and whether that is too long."""
    h = T.hours_between(now, F.max(ingest))
    return table.groupBy(*keys).agg(F.max(ingest).alias("last_write"), h.alias("hours_since"), (h > max_hours).alias("alarm"))


def daily_evaluation(stream: DataFrame, checkpoint: str, evaluate: Callable[[DataFrame], DataFrame], path: str, keys: list[str],
                     rows_path: str, schema: str, row_keys: list[str], ts: str, order: list[str]) -> None:
    """Keep landed rows by day and evaluate every touched day as a whole; results are stored by ``keys`` and eval_date.

    ``evaluate`` gets all stored rows of the touched days, so several batches of one day give the same result as one.
    """
    def sink(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        upsert_by_day(batch, rows_path, schema, row_keys, ts, order)
        days = batch.select(F.date_format(ts, "yyyy-MM-dd").alias("day"))
        append_or_update(spark, evaluate(touched(days, rows_path, schema, ["day"]).drop("day")), path, keys)

    run_available(stream, checkpoint, sink)
