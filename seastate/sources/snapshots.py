"""Tables as snapshots: rows are written once into a folder of their own, and one name added to a log makes them the table.

Below a table's path lie ``data/write=<id>`` (the rows of one write, in folders of the table's partition columns), ``lists/<id>`` (the
files of one snapshot, with their folders, row counts and sizes) and ``log`` (one name per snapshot, the newest counts). A folder of a write
is in use as a whole or not at all: replacing a partition lists the new folder in place of the old ones, adding to it lists both, and
dropping it lists none. A crash at any point leaves the log as it was, so readers see the table before the write, and the next write needs
no repair. One writer at a time; of two that add the same number to the log, the smaller id counts and the other one is told.

What no kept snapshot lists is deleted after each write (``KEEP`` snapshots stay, for readers that have begun). Log and deletions go through
Hadoop's file system interface, so any store will do. A read names the files it wants, so one that is
gone fails it; their addresses, no rows, go through the driver, where Spark's own listing holds them too.
"""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import children, delete, make

KEEP = 2
#: Reader options: Spark's writer stores a checksum per page; a page whose bytes changed fails the read instead of giving other values.
CHECKED = {"parquet.page.verify-checksum.enabled": "true"}


class WriteConflict(RuntimeError):
    """Another writer has put its snapshot into the log under the same number."""


def _columns(parts: list[str]) -> str:
    return "write string, " + "".join(f"`{p}` string, " for p in parts) + "folder string, file string, rows long, bytes long"


def _log(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, id) of the snapshots in the log, newest first; of one number the smaller id counts. None: no table."""
    found = sorted(c.split("-") for c in children(spark, f"{path}/log"))
    first = {int(seq): name for seq, name in reversed(found)}
    return sorted(first.items(), reverse=True)


def exists(spark: SparkSession, path: str) -> bool:
    return bool(_log(spark, path.rstrip("/")))


def files(spark: SparkSession, path: str, parts: list[str]) -> DataFrame:
    """write, the partition columns, folder, file, rows and bytes of every file of the table; the scan can be checked against it."""
    path = path.rstrip("/")
    log = _log(spark, path)
    return spark.read.schema(_columns(parts)).parquet(f"{path}/lists/{log[0][1]}") if log else spark.createDataFrame([], _columns(parts))


def _list_write(spark: SparkSession, path: str, parts: list[str], name: str) -> DataFrame:
    """The files of one write, counted by Spark from their footers: no column is read."""
    spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "false")  # a station id of digits stays a string
    df = spark.read.schema("write string, " + ", ".join(f"`{p}` string" for p in parts)).option("basePath", f"{path}/data").parquet(f"{path}/data/write={name}")
    keys = ["write", *parts]
    counted = df.groupBy(*keys, F.col("_metadata.file_path").alias("at"), F.col("_metadata.file_size").alias("bytes")).agg(F.count(F.lit(1)).alias("rows"))
    inside = F.substring_index("at", "/data/write=", -1)
    whole = F.concat(F.lit("write="), inside)
    return counted.select(*keys, F.regexp_replace(whole, "/[^/]*$", "").alias("folder"), F.substring_index(inside, "/", -1).alias("file"), "rows", "bytes")


def _store(rows: DataFrame, path: str, parts: list[str]) -> str:
    """Write rows once, the rows of one folder together; AQE splits a folder that is too large for one task."""
    name = uuid.uuid4().hex
    rows.hint("rebalance", *parts).write.partitionBy(*parts).parquet(f"{path}/data/write={name}")
    return name


def _add_to_log(spark: SparkSession, path: str, seq: int, name: str) -> None:
    """The switch: one name appears in the log, or not."""
    make(spark, f"{path}/log/{seq:012d}-{name}")


def _publish(spark: SparkSession, path: str, listed: DataFrame, log: list) -> None:
    name, seq = uuid.uuid4().hex, (log[0][0] if log else 0) + 1
    listed.coalesce(1).write.parquet(f"{path}/lists/{name}")
    _add_to_log(spark, path, seq, name)
    now = _log(spark, path)
    if now[0][1] != name:
        raise WriteConflict(f"{path}: snapshot {seq} was written by {now[0][1]}")
    _sweep(spark, path, now)


def _sweep(spark: SparkSession, path: str, log: list) -> None:
    """Delete the writes, lists and log entries that none of the newest ``KEEP`` snapshots needs."""
    kept = [name for _, name in log[:KEEP]]
    used = spark.read.schema("write string").parquet(*(f"{path}/lists/{k}" for k in kept)).distinct()
    alive = {r.write for r in used.collect()}  # one short name per write that is still in use
    below = lambda kind, dead: [f"{path}/{kind}/{c}" for c in children(spark, f"{path}/{kind}") if dead(c)]
    delete(spark, below("data", lambda c: c.startswith("write=") and c[6:] not in alive) + below("lists", lambda c: c not in kept)
           + below("log", lambda c: int(c.split("-")[0]) < log[:KEEP][-1][0]))


def _same(a: DataFrame, b: DataFrame, parts: list[str]) -> Column:
    test = F.lit(True)
    for p in parts:
        test = test & a[p].cast("string").eqNullSafe(b[p].cast("string"))
    return test


def replace_parts(rows: DataFrame, path: str, parts: list[str]) -> None:
    """Put ``rows`` in place of all rows of the partitions they fall into."""
    _change(rows, path.rstrip("/"), parts, True)


def append_rows(rows: DataFrame, path: str, parts: list[str]) -> None:
    """Add rows; what the table holds stays."""
    _change(rows, path.rstrip("/"), parts, False)


def _change(rows: DataFrame, path: str, parts: list[str], replace: bool) -> None:
    spark = rows.sparkSession
    name = _store(rows, path, parts)
    log = _log(spark, path)
    new = _list_write(spark, path, parts, name)
    if log:
        old, ours = files(spark, path, parts), new.select(*parts).distinct()
        kept = old.join(ours, _same(old, ours, parts), "left_anti") if replace else old
        new = kept.unionByName(new)
    _publish(spark, path, new, log)


def drop_parts(spark: SparkSession, path: str, parts: list[str], which: Column) -> None:
    """Take the partitions that ``which`` is true of out of the table; no row is read or written."""
    path = path.rstrip("/")
    log = _log(spark, path)
    if log:
        _publish(spark, path, files(spark, path, parts).where(~F.coalesce(which, F.lit(False))), log)


def _read(spark: SparkSession, path: str, schema: str, parts: list[str], listed: DataFrame) -> DataFrame:
    spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "false")
    extra = "".join(f", `{p}` string" for p in parts if f" {p} " not in f" {schema} ".replace(",", " ").replace("`", ""))
    found = [f"{path}/data/{unquote(r.folder)}/{r.file}" for r in listed.select("folder", "file").orderBy("folder", "file").collect()]
    if not found:
        return spark.createDataFrame([], schema + extra)
    return spark.read.schema(schema + extra).options(**CHECKED).option("basePath", f"{path}/data").parquet(*found).drop("write")


def load(spark: SparkSession, path: str, schema: str, parts: list[str], where: Column | None = None) -> DataFrame:
    """The table with its partition columns as strings. ``where`` (on partition columns) is applied before anything is listed."""
    path = path.rstrip("/")
    listed = files(spark, path, parts)
    return _read(spark, path, schema, parts, listed if where is None else listed.where(where))


def touched(new: DataFrame, path: str, schema: str, parts: list[str]) -> DataFrame:
    """The table's rows in the partitions that rows of ``new`` fall into."""
    spark, path = new.sparkSession, path.rstrip("/")
    listed, ours = files(spark, path, parts), new.select(*parts).distinct()
    return _read(spark, path, schema, parts, listed.join(ours, _same(listed, ours, parts), "left_semi"))
