"""Keyed state: the best row of every reading lives in the stream's own state, with a timer that retires whole days.

State is kept per series and day, so a series with a third of all rows is spread over its days and one state holds the readings of
one day. A batch passes on only what it changes, so a replay or an older copy writes nothing; a timer per day
fires when the watermark passes its end, clears the state and reports the day, and the sink drops that day's partition.
Rows older than the watermark are dropped by Spark, as the days they belong to have gone.

Times travel as microseconds: the processor sees numbers, not zones. Nulls rank lowest and NaN highest, as in Spark's ``max``.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

from ..session import delete, work_path
from ..sources.snapshots import drop_parts
from .ingest import state_on_disk, upsert_by_day

def rank(values) -> tuple:
    """Values in an order that holds for nulls and NaN."""
    return tuple((0, 0) if v is None else (2, 0) if v != v else (1, v) for v in values)


class LatestReadings(StatefulProcessor):
    """Per series and day: the greatest row of each item by ``order``, emitted when it changes; one timer retires the day."""

    def __init__(self, columns: StructType, items: list[str], order: list[str]):
        self.columns, self.items, self.order = columns, items, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getListState("best", self.columns)
        names = self.columns.fieldNames()
        self.item_at = [names.index(c) for c in self.items]
        self.order_at = [names.index(c) for c in self.order]

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        names = self.columns.fieldNames()
        held = {tuple(r[i] for i in self.item_at): tuple(r) for r in self.best.get()} if self.best.exists() else {}
        if not held:
            # Readings of a day end before its next midnight.
            self.handle.registerTimer(next_midnight_ms(key[-1]))
        changed = {}
        for r in rows:
            new = tuple(r[c] for c in names)
            item = tuple(new[i] for i in self.item_at)
            old = held.get(item)
            if old is None or rank(new[i] for i in self.order_at) > rank(old[i] for i in self.order_at):
                held[item] = changed[item] = new
        if changed:
            self.best.put(list(held.values()))
        for row in changed.values():
            yield Row(**dict(zip(names, row, strict=True)), expired_day=None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.best.clear()
        yield Row(**dict.fromkeys(self.columns.fieldNames()), expired_day=key[-1])

    def close(self) -> None:
        pass


def next_midnight_ms(day: str) -> int:
    start = datetime.strptime(day, "%Y-%m-%d").replace(tzinfo=UTC)
    return int((start + timedelta(days=1)).timestamp() * 1000)


def latest_readings(stream: DataFrame, keys: list[str], ts: str, order: list[str], days: int = 14, series: str = "station") -> DataFrame:
    """Changes of the latest-wins table (its columns), and rows whose only value is ``expired_day``.

    ``order`` ranks the rows of one key, the other columns decide ties. Rows without a time belong to no day and are passed over.
    """
    columns = stream.columns
    times = [f.name for f in stream.schema if isinstance(f.dataType, TimestampType)]
    held = StructType([StructField(f.name, LongType() if f.name in times else f.dataType) for f in stream.schema])
    output = StructType([*held.fields, StructField("expired_day", StringType())])
    rest = [c for c in columns if c not in (*keys, *order)]
    # The watermark column stays a time; the processor reads the numbers beside it.
    timed = stream.where(F.col(ts).isNotNull()).withColumn("_event", F.col(ts)).withWatermark("_event", f"{days} days")
    flat = timed.withColumns({c: F.unix_micros(c) for c in times}).withColumns(
        {"_series": F.col(series), "_day": F.date_format("_event", "yyyy-MM-dd")})
    out = flat.groupBy("_series", "_day").transformWithState(
        LatestReadings(held, keys, [*order, *rest]), output, outputMode="Update", timeMode="EventTime")
    return out.withColumns({c: F.timestamp_micros(c) for c in times})


def ingest_latest(stream: DataFrame, path: str, checkpoint: str, schema: str, keys: list[str], ts: str, order: list[str],
                  days: int = 14, series: str = "station") -> None:
    """Keep a table of the last ``days`` from a stream: changes are folded into their days, expired days leave the table.

    A batch is stored once before it is used, since reading it twice would run its state twice. A batch repeated after a crash
    folds the same rows and drops the same days again, so restarts give the same table.
    """
    def sink(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        at = work_path(spark, "changes")
        batch.write.parquet(at)
        stored = spark.read.schema(batch.schema).parquet(at)
        rows = stored.where(F.col("expired_day").isNull()).drop("expired_day")
        if not rows.isEmpty():
            upsert_by_day(rows, path, schema, keys, ts, order)
        gone = stored.agg(F.max("expired_day")).first()[0]
        if gone is not None:
            drop_parts(spark, path, ["day"], F.col("day") <= gone)
        delete(spark, [at])

    run_with_rocks(stream.sparkSession, latest_readings(stream, keys, ts, order, days, series), checkpoint, sink)


def run_with_rocks(spark: SparkSession, changes: DataFrame, checkpoint: str, sink) -> None:
    """Run what has landed with state in RocksDB, which timers need; the session's own setting comes back once the query has begun."""
    with state_on_disk(spark):
        q = changes.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
