"""Parquet files checked against what they should hold: footers, columns, and rows that can really be read.

A manifest has one row per file: path, rows and bytes by its footer, the expected columns it lacks, and the error if it has no readable
footer. ``verify`` decodes every column, page checksums included, and compares the rows read with the manifest; ``counted`` reads strictly and counts on the way,
so that a scan which came out short is noticed by the job that used it.
"""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import qualified
from . import snapshots

MANIFEST = "path string, base string, rows long, bytes long, missing array<string>, error string"


class ScanMismatch(RuntimeError):
    """A scan that gave other rows than its manifest; ``report`` lists the files at fault, if they can be told."""

    def __init__(self, message: str, report: list):
        super().__init__(message)
        self.report = report


def plain_path(c: Column) -> Column:
    """One spelling of a file address, whoever lists it."""
    return F.regexp_replace(c, "^([a-z0-9]+):/+", "$1:/")


def data_files(spark: SparkSession, root: str) -> DataFrame:
    """path, base (where partition folders begin), rows (null where nothing says how many) of the files below a root.

    A stored table says which files it has; any other folder is listed by Spark.
    """
    root = qualified(spark, root)
    if snapshots.exists(spark, root):
        listed = snapshots.files(spark, root, []).select(F.concat(F.lit(f"{root}/data/"), "folder", F.lit("/"), "file").alias("path"), F.lit(f"{root}/data").alias("base"), "rows")
    else:
        found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(root)
        listed = found.select("path", F.lit(root).alias("base"), F.lit(None).cast("long").alias("rows"))
    return listed.withColumn("path", plain_path(F.col("path")))


def footers(files: DataFrame, expected: list[str]) -> DataFrame:
    """The manifest of ``files`` (path, rows); footers are read inside tasks. A row count given beforehand stays; the footer must agree."""
    def read(batches):
        import pandas as pd
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs

        for pdf in batches:
            out = []
            for path, base, rows in zip(pdf["path"], pdf["base"], pdf["rows"]):
                given = None if pd.isna(rows) else int(rows)
                store, inner = fs.FileSystem.from_uri(path.replace("file:", "file://", 1) if path.startswith("file:/") else path)
                try:
                    meta = pq.read_metadata(inner, filesystem=store)
                    size = store.get_file_info(inner).size
                    missing = sorted(set(expected) - set(meta.schema.to_arrow_schema().names))
                    error = None if given in (None, meta.num_rows) else f"{meta.num_rows} rows by the footer, {given} by the list"
                    out.append((path, base, meta.num_rows if given is None else given, size, missing, error))
                except FileNotFoundError:
                    out.append((path, base, given, None, [], "missing"))
                except (pa.ArrowException, OSError) as e:  # the report is about these
                    out.append((path, base, given, None, [], str(e)[:200] or type(e).__name__))
            yield pd.DataFrame(out, columns=["path", "base", "rows", "bytes", "missing", "error"]).astype({"rows": "Int64", "bytes": "Int64"})

    return files.select("path", "base", "rows").mapInPandas(read, MANIFEST)


def manifest(spark: SparkSession, roots: list[str], expected: list[str]) -> DataFrame:
    out = None
    for r in roots:
        one = data_files(spark, r)
        out = one if out is None else out.unionByName(one)
    return footers(out, expected)


def faulty() -> Column:
    return (F.size("missing") > 0) | F.col("error").isNotNull()


def read_files(spark: SparkSession, files: DataFrame, schema: str, tolerant: bool = False) -> DataFrame:
    """The rows of the listed files with their ``path``; a file that cannot be read fails the scan unless ``tolerant``.

    Addresses of files go through the driver, where Spark's own listing holds them too.
    """
    found: dict[str, list[str]] = {}
    for r in files.select("base", "path").collect():
        found.setdefault(r.base, []).append(unquote(r.path))
    out = spark.createDataFrame([], schema + ", path string")
    names = out.columns
    for base, paths in sorted(found.items()):
        df = spark.read.schema(schema).options(**snapshots.CHECKED).option("basePath", base).option("ignoreCorruptFiles", tolerant).option("ignoreMissingFiles", tolerant).parquet(*sorted(paths))
        out = out.unionByName(df.withColumn("path", plain_path(F.col("_metadata.file_path"))).select(*names))
    return out


def verify(spark: SparkSession, listed: DataFrame, schema: str) -> DataFrame:
    """path, rows, rows_read, print, state of every file of a manifest: ok, or lacks columns, missing, unreadable, short.

    Every column of every readable file is decoded, for ``print`` (a hash over its rows). A file is ok only if it gives exactly the rows it should.
    """
    now = footers(listed, []).select("path", F.col("error").alias("error_now"))
    open_files = listed.join(now.where("error_now IS NULL"), "path", "left_semi")
    rows = read_files(spark, open_files, schema, tolerant=True)
    columns = [c for c in rows.columns if c != "path"]
    read = rows.groupBy("path").agg(F.count(F.lit(1)).alias("rows_read"), F.bit_xor(F.xxhash64(*columns)).alias("print"))
    both = listed.join(now, "path", "left").join(read.select("path", "rows_read", "print"), "path", "left")
    rows_read = F.coalesce("rows_read", F.lit(0)).cast("long")
    error = F.coalesce("error", "error_now")
    state = (F.when(error == "missing", "missing").when(error.isNotNull(), "unreadable").when(F.size("missing") > 0, "lacks columns")
             .when(rows_read != F.col("rows"), "short").otherwise("ok"))
    return both.select("path", "rows", rows_read.alias("rows_read"), "print", state.alias("state"))


@dataclass
class CountedScan:
    """``rows`` to use in one action that reads all of them, then ``check``."""

    rows: DataFrame
    listed: DataFrame
    schema: str
    seen: Observation

    def check(self) -> int:
        """The number of rows read; raises ``ScanMismatch`` unless it is the manifest's. Tasks that ran twice are told from a short scan by a second look."""
        due = self.listed.agg(F.sum("rows")).first()[0] or 0
        got = self.seen.get["n"]
        if got != due:
            bad = verify(self.rows.sparkSession, self.listed, self.schema).where("state != 'ok'").collect()
            if bad or got < due:
                raise ScanMismatch(f"{got} rows read, {due} listed", bad)
        return due


def counted(spark: SparkSession, listed: DataFrame, schema: str) -> CountedScan:
    """Strict scan of a manifest's files, counted by the action that uses it."""
    seen = Observation()
    return CountedScan(read_files(spark, listed, schema).observe(seen, F.count(F.lit(1)).alias("n")), listed, schema, seen)
