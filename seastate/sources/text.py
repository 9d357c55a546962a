"""Station and spectrum text files as DataFrames.

Readers work on lines ``(path, pos, value)``, with the file's ``header`` in the
row where the file was read whole, else looked up by file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import units as U
from ..functions.arrays import stage
from ..session import materialise

#: So many headers, one short row each, may go to every task.
BROADCAST_FILES = 50_000
# Fixed value: two-digit years from here on are in the last century.
YEAR_PIVOT = 70


def read_lines(spark: SparkSession, paths) -> DataFrame:
    """Text files to (path, pos, value); pos grows along each file."""
    raw = spark.read.text(paths)
    return raw.select(F.col("_metadata.file_path").alias("path"),
                      F.struct(F.col("_metadata.file_block_start").alias("block"),
                               F.monotonically_increasing_id().alias("line")).alias("pos"),
                      F.rtrim("value").alias("value"))


def tokens(c: Column) -> Column:
    return F.split(F.trim(c), r"\s+")


def is_comment(c: Column) -> Column:
    return F.startswith(c, F.lit("#"))


def year_of(token: Column) -> Column:
    y = token.try_cast("int")
    return F.when(y >= 100, y).when(y >= YEAR_PIVOT, y + 1900).otherwise(y + 2000)


def time_of(year: Column, month: Column, day: Column, hour: Column, minute: Column) -> Column:
    """Instant from its parts, null when the parts are no date."""
    return F.try_make_timestamp(year, month.try_cast("int"), day.try_cast("int"), hour.try_cast("int"),
                                minute.try_cast("int"), F.lit(0).cast("decimal(16,6)"))


def read_whole(spark: SparkSession, paths) -> DataFrame:
    """Small text files to (path, pos, value, header): each file is read whole and its first line goes with every other.

    No join and no shuffle; for files larger than a task's memory use ``read_lines``, where headers are looked up by file.
    """
    raw = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.split("value", "\r?\n").alias("_l"))
    lines = raw.select("path", names_of(F.get("_l", F.lit(0))).alias("header"), F.posexplode("_l").alias("pos", "value"))
    return lines.filter("pos > 0").select("path", F.col("pos").cast("long").alias("pos"), F.rtrim("value").alias("value"), "header")


def names_of(line: Column) -> Column:
    """Column names of a header line, with or without a leading '#'."""
    return tokens(F.regexp_replace(line, "^[# ]+", ""))


def headers(lines: DataFrame, plain: bool) -> DataFrame:
    """Header of each file as an array of names and its place: the first line, or the first '#' line unless ``plain``."""
    h = lines.filter(F.trim("value") != "")
    h = h if plain else h.filter(is_comment(F.col("value")))
    # Places alone are aggregated by hash; an aggregate that carries texts would sort every line.
    at = h.groupBy("path").agg(F.min("pos").alias("_at"))
    first = lines.join(at.withColumnRenamed("_at", "pos"), ["path", "pos"]).select("path", F.col("pos").alias("_at"), "value")
    return stage(first, {"header": names_of(F.col("value"))}).drop("value")


def _with_header(lines: DataFrame, plain: bool = False, of_header: dict[str, Column] | None = None) -> DataFrame:
    """Data lines with their tokens and the header of their file, and columns worked out once from each header.

    Headers are one short row a file. They are gathered and stored first; up to ``BROADCAST_FILES`` of them, as counted, go to every task, so
    that no data line is shuffled and a long file stays spread over its blocks. Beyond that they are joined on the file.
    """
    of_header = of_header or {}
    data = lines.filter(~is_comment(F.col("value")) & (F.trim("value") != ""))
    if "header" in lines.columns:
        data = stage(data, of_header)
    else:
        of = materialise(headers(lines, plain).withColumns(of_header), "headers")
        few = of.count() <= BROADCAST_FILES
        data = data.join(F.broadcast(of) if few else of, "path").filter(F.col("pos") > F.col("_at")).drop("_at")
    return stage(data, {"tok": tokens(F.col("value"))})


def place(header: Column, *names: str) -> Column:
    """Place of the first of these names in the header, from 0; null if there is none."""
    at = [F.array_position(header, F.lit(n)).cast("int") for n in names]
    return F.coalesce(*[F.when(i > 0, i - 1) for i in at])


def _by_name(lines: DataFrame, wanted: dict[str, tuple[str, ...]]) -> DataFrame:
    """Data lines with the wanted tokens as columns and the line's instant as valid_utc."""
    parts = {"_y": ("YYYY", "YY"), "_mo": ("MM",), "_dy": ("DD",), "_hr": ("hh",), "_mi": ("mm",), **wanted}
    d = _with_header(lines, plain=True, of_header={f"_at{k}": place(F.col("header"), *names) for k, names in parts.items()})
    d = stage(d, {k: F.get("tok", F.col(f"_at{k}")) for k in parts}).drop("header", "tok")
    minute = F.when(F.col("_at_mi").isNotNull(), F.col("_mi")).otherwise(F.lit("0"))
    return stage(d, {"valid_utc": time_of(year_of(F.col("_y")), F.col("_mo"), F.col("_dy"), F.col("_hr"), minute)})


def parse_station(lines: DataFrame) -> DataFrame:
    """Station observations: (path, pos, valid_utc, partition, hs_m, tp_s, dp_deg, wind columns).

    Names come from the header; minute is optional; rows without a date or a
    year column are dropped; fill marks become null per column.
    """
    d = _by_name(lines, {"_wvht": ("WVHT",), "_dpd": ("DPD",), "_mwd": ("MWD",), "_wspd": ("WSPD",), "_wdir": ("WDIR",), "_gst": ("GST",)})
    d = d.filter(F.col("valid_utc").isNotNull())
    # Step by step: the JVM compiles no method as long as all six in one would make.
    for out, tok in (("hs_m", "_wvht"), ("tp_s", "_dpd"), ("wind_ms", "_wspd"), ("gust_ms", "_gst")):
        d = stage(d, {out: U.parse_number(F.col(tok))})
    for out, tok in (("dp_deg", "_mwd"), ("wind_deg", "_wdir")):
        d = stage(d, {out: U.parse_direction(F.col(tok))})
    return d.select("path", "pos", "valid_utc", F.lit(0).alias("partition"), "hs_m", "tp_s", "dp_deg", "wind_ms", "wind_deg", "gust_ms")


def newest_usable(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Newest row with height and period, else with height only, else the newest row."""
    tier = F.when(F.col("hs_m").isNotNull() & F.col("tp_s").isNotNull(), 2).when(F.col("hs_m").isNotNull(), 1).otherwise(0)
    from ..operators.ordered import latest_by
    return latest_by(rows, keys, [tier, F.col("valid_utc"), F.struct("hs_m", "tp_s", "dp_deg")])


def parse_spectrum_pairs(lines: DataFrame, value: str, leading: int) -> DataFrame:
    """Lines of ``value (freq)`` pairs: (path, ts, bins) with bins array<struct<freq,value>>.

    Five time columns, then ``leading`` extra columns, then the pairs. The
    value keeps the name given, fills become null, bins stay in one row.
    """
    data = lines.filter(~is_comment(F.col("value")) & (F.trim("value") != ""))
    d = stage(data.select("path", "value"), {"tok": tokens(F.col("value"))})
    skip = 5 + leading
    pairs = F.floor((F.size("tok") - skip) / 2).cast("int")
    t = lambda i: F.get("tok", F.lit(i))
    fills = U.DIRECTION_FILLS if value == "dir" else ()
    bins = F.transform(F.sequence(F.lit(0), pairs - 1), lambda i: F.struct(
        F.regexp_replace(F.get("tok", F.lit(skip + 1) + i * 2), "[()]", "").try_cast("double").alias("freq"),
        U.parse_number(F.get("tok", F.lit(skip) + i * 2), fills).alias(value)))
    year = year_of(t(0))
    return (d.filter(F.size("tok") >= skip + 2)
            .select("path", time_of(year, t(1), t(2), t(3), t(4)).alias("ts"),
                    F.filter(bins, lambda b: b["freq"].isNotNull()).alias("bins"))
            .filter(F.col("ts").isNotNull() & (F.size("bins") > 0)))


def parse_spectrum_table(lines: DataFrame, value: str) -> DataFrame:
    """Frequencies in the header, one spectrum per line: (path, ts, bins).

    The header's first token between 0 and 1 starts the frequencies; fills are
    dropped; files that are a web page are left out whole.
    """
    pages = lines.groupBy("path").agg(F.min_by(F.trim("value"), "pos").alias("_first")) \
        .filter(F.startswith("_first", F.lit("<"))).select("path")
    d = _with_header(lines.join(pages, "path", "left_anti"))
    nums = F.transform("header", lambda h: h.try_cast("double"))
    is_freq = F.transform(nums, lambda f: F.coalesce((f > 0) & (f < 1), F.lit(False)))
    d = stage(d, {"_f": nums, "_n": F.array_position(is_freq, F.lit(True)).cast("int") - 1}).filter(F.col("_n") >= 0)
    d = stage(d, {"_freqs": F.filter(F.slice("_f", F.col("_n") + 1, F.size("_f")), lambda f: (f > 0) & (f < 1))})
    d = d.filter(F.size("tok") >= F.col("_n") + F.size("_freqs"))
    t = lambda i: F.get("tok", F.lit(i))
    minute = F.when(F.col("_n") >= 5, t(4)).otherwise(F.lit("0"))
    fills = (999.0, 9999.0, -999.0) if value == "dir" else U.SPECTRAL_FILLS
    bins = F.transform("_freqs", lambda f, i: F.struct(
        f.alias("freq"), U.parse_number(F.get("tok", F.col("_n") + i), fills).alias(value)))
    return (d.select("path", time_of(year_of(t(0)), t(1), t(2), t(3), minute).alias("ts"),
                     F.filter(bins, lambda b: b[value].isNotNull()).alias("bins"))
            .filter(F.col("ts").isNotNull() & (F.size("bins") > 0)))


def pair_spectra(energy: DataFrame, direction: DataFrame, keys: list[str], outer: bool = False) -> DataFrame:
    """Energy and direction of one time in one bins array, matched on frequency.

    Each side has one row per spectrum, so the join moves one row per spectrum
    and not one per bin. ``outer`` keeps energy that has no direction file.
    """
    e = energy.select(*keys, F.col("bins").alias("_e"))
    d = direction.select(*keys, F.col("bins").alias("_d"))
    j = stage(e.join(d, keys, "left" if outer else "inner"), {"_f": F.transform("_d", lambda b: b["freq"])})
    return j.select(*keys, F.transform("_e", lambda b: F.struct(
        b["freq"].alias("freq"), b["energy"].alias("energy"),
        F.get("_d", F.array_position("_f", b["freq"]).cast("int") - 1)["dir"].alias("dir"))).alias("bins"))


def parse_summary(lines: DataFrame) -> DataFrame:
    """Spectral summary: per file the newest row with a swell height, as one component or none."""
    d = _by_name(lines, {"_h": ("SwH",), "_p": ("SwP",), "_d": ("SwD",)})
    rows = d.select("path", "valid_utc", U.parse_number(F.col("_h")).alias("h"), U.parse_number(F.col("_p")).alias("p"),
                    U.parse_direction(F.col("_d")).alias("d"))
    from ..operators.ordered import latest_by
    best = latest_by(rows.filter(F.col("valid_utc").isNotNull()), ["path"],
                     [F.col("h").isNotNull(), F.col("valid_utc"), F.struct("h", "p", "d")])
    h = U.m_to_ft(F.col("h"))
    comp = F.struct(h.alias("height_ft"), F.round("p", 1).alias("period_s"), F.col("d").alias("direction_deg"),
                    U.observed_energy(h, F.col("p")).alias("energy"), F.lit("swell").alias("type"))
    keep = (F.col("h") > 0) & (F.col("p") >= 6.0)
    return best.select("path", "valid_utc", F.filter(F.array(F.when(keep, comp)), lambda c: c.isNotNull()).alias("components"))
