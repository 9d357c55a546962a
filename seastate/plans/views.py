"""The logical ocean tables, mapped from the generic test tables.

Stations are blocks of 25 users and lines are blocks of 8 suppliers, so both
grow with the data. Every view reads its whole table.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Metres per unit of event value; many digits, so that averages never sit on a rounding tie.
SCALE = 0.061803398875
USERS_PER_STATION = 25
SITES_PER_LINE = 8
FREQ0, FREQ_STEP = 0.02, 0.0075

EVENTS_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def k_of() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def station_of(user: Column) -> Column:
    return F.format_string("st%05d", F.floor(user / USERS_PER_STATION))


def obs_from_events(events: DataFrame) -> DataFrame:
    """Observations: purchase, error and signup events are partitions 0, 1 and 2."""
    k, ts = F.col("k"), F.col("ts").cast("timestamp")
    e = events.filter(F.col("event_type").isin("purchase", "error", "signup")).withColumn("k", k_of())
    part = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "error", 1).otherwise(2)
    return e.select(
        station_of(F.col("user_id")).alias("station"), ts.alias("valid_utc"), part.alias("partition"),
        (F.col("value") * SCALE).alias("hs_m"),
        F.when(k != 97, (4 + k % 18).cast("double")).alias("tp_s"),
        F.when(k != 98, ((k * 37 + F.col("user_id") * 11) % 360).cast("double")).alias("dp_deg"),
        F.when(k % 2 == 0, "realtime").otherwise("archive").alias("source"),
        F.timestamp_seconds(F.unix_timestamp(F.date_trunc("day", ts)) + (1 + k % 3) * 86400).alias("ingest_utc"))


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        """Events with the JSON field k, the station and an instant in UTC."""
        return self.table("events").select(
            "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value",
            k_of().alias("k"), station_of(F.col("user_id")).alias("station"))

    @cached_property
    def obs(self) -> DataFrame:
        return obs_from_events(self.table("events"))

    @cached_property
    def forecast(self) -> DataFrame:
        """Both models: click events are model A, view events model B; 3-hourly, two cycles per day of validity."""
        e = self.events.filter(F.col("event_type").isin("click", "view"))
        e = e.withColumns({
            "model": F.when(F.col("event_type") == "click", "A").otherwise("B"),
            "valid_utc": F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / 10800) * 10800)})
        e = e.withColumn("cycle_utc", F.timestamp_seconds(
            F.unix_timestamp(F.date_trunc("day", "valid_utc")) - (F.col("k") % 2) * 86400))
        g = e.groupBy("station", "model", "cycle_utc", "valid_utc").agg(
            F.count("*").alias("n"), F.avg("value").alias("v"), F.max("k").alias("kx"), F.min("k").alias("kn"),
            F.min("user_id").alias("u"))
        kx, kn, v, u = (F.col(c) for c in ("kx", "kn", "v", "u"))
        sw1, sw2 = kx % 7 != 0, F.col("n") > 1
        return g.select(
            "station", "model", "cycle_utc", "valid_utc",
            ((F.unix_timestamp("valid_utc") - F.unix_timestamp("cycle_utc")) / 3600).cast("int").alias("lead_hours"),
            F.when(sw1, v * (SCALE * 3.28084)).alias("sw1_height_ft"),
            F.when(sw1, (5 + kx % 14).cast("double")).alias("sw1_period_s"),
            F.when(sw1, ((kx * 37 + u * 11) % 360).cast("double")).alias("sw1_direction_deg"),
            F.when(sw2, v * (SCALE * 1.5)).alias("sw2_height_ft"),
            F.when(sw2, (4 + kn % 12).cast("double")).alias("sw2_period_s"),
            F.when(sw2, ((kn * 53 + u * 7) % 360).cast("double")).alias("sw2_direction_deg"),
            F.when(kx % 21 != 0, v * (SCALE * 1.1)).alias("combined_height_m"),
            ((4 + kx % 15) * 1.0371).alias("combined_period_s"),
            ((kx * 17) % 360).cast("double").alias("combined_direction_deg"),
            F.timestamp_seconds(F.unix_timestamp("cycle_utc") + 21600).alias("ingest_utc"))

    @cached_property
    def a(self) -> DataFrame:
        return self.forecast.filter(F.col("model") == "A")

    @cached_property
    def b(self) -> DataFrame:
        return self.forecast.filter(F.col("model") == "B")

    @cached_property
    def series(self) -> DataFrame:
        """Hourly mean value per station: a tide-like series with gaps."""
        return (self.events.groupBy("station", F.date_trunc("hour", "ts").alias("t"))
                .agg((F.avg("value") * SCALE).alias("v")))

    @cached_property
    def spectra(self) -> DataFrame:
        """One spectrum of 64 bins per embedding, every half hour per station."""
        vid = F.col("vec_id")
        return self.table("embeddings").select(
            F.format_string("sp%02d", F.col("label")).alias("station"),
            F.timestamp_seconds(F.lit(1704067200) + vid * 1800).alias("ts"),
            F.transform("embedding", lambda e, i: F.struct(
                (F.lit(FREQ0) + F.lit(FREQ_STEP) * i).alias("freq"), F.abs(e.cast("double")).alias("energy"),
                F.when((vid + i) % 29 != 0, ((vid * 7 + i * 11) % 360).cast("double")).alias("dir"))).alias("bins"))

    @cached_property
    def sites(self) -> DataFrame:
        s = F.col("s_suppkey")
        return self.table("supplier").select(
            s.alias("site"), F.format_string("ln%05d", F.floor(s / SITES_PER_LINE)).alias("line"),
            F.format_string("r%02d", F.col("s_nationkey")).alias("region"),
            (F.lit(-42.0) + (s * 7919 % 2200) / 100.0).alias("lat"),
            (F.lit(95.0) + (s * 104729 % 3000) / 100.0).alias("lon"),
            (s * 37 % 360).cast("double").alias("shore_normal"),
            (s % 41 - 20).cast("int").alias("tide_hi_offset"), (s % 31 - 15).cast("int").alias("tide_lo_offset"))

    @cached_property
    def readings(self) -> DataFrame:
        """Sensor readings from line items: ship date is the day, line number the hour."""
        return self.table("lineitem").select(
            F.col("l_suppkey").alias("site"),
            F.timestamp_seconds(F.unix_timestamp(F.col("l_shipdate").cast("timestamp")) + F.col("l_linenumber") * 10800).alias("time"),
            (F.col("l_quantity") * 0.0987654321).alias("hs_m"),
            (F.lit(10.0) + (F.col("l_orderkey") % 90) / 10.0).alias("tp_s"),
            (F.lit(200.0) + (F.col("l_partkey") % 600) / 10.0).alias("dp_deg"),
            F.col("l_orderkey").alias("rid"), F.col("l_partkey").alias("rid2"))

    @cached_property
    def latest(self) -> DataFrame:
        from ..operators.swelltrack import latest_readings
        return latest_readings(self.readings, ["site"], "time", ["rid", "rid2", "hs_m"])

    @cached_property
    def sentinels(self) -> DataFrame:
        """Sites with their latest reading and the line's newest time as 'now'."""
        s = self.sites.join(self.latest, "site")
        now = s.groupBy("line").agg(F.max("time").alias("now"))
        return s.join(now, "line")

    @cached_property
    def model_parts(self) -> DataFrame:
        """Per model (supplier) the seven metric parts, from line numbers 1 to 7."""
        names = ["sw1_height_ft", "sw1_period_s", "sw1_direction_deg", "sw2_height_ft", "sw2_period_s",
                 "sw2_direction_deg", "surfer_f1"]
        return (self.table("lineitem").groupBy("l_suppkey", "l_linenumber").agg(
            F.avg(F.col("l_discount") + F.col("l_tax") * 0.37).alias("model_value"),
            F.avg(F.col("l_discount") * 1.3).alias("ref_value"))
            .select(F.col("l_suppkey").alias("sid"),
                    F.element_at(F.array(*[F.lit(n) for n in names]), F.col("l_linenumber")).alias("variable"),
                    "model_value", "ref_value"))

    @cached_property
    def models(self) -> DataFrame:
        """Model inventory: one per supplier, scoped by the region of its nation."""
        from ..functions import timefn as T
        li = self.table("lineitem").groupBy("l_suppkey").agg(
            F.count("*").alias("n"), F.max("l_shipdate").cast("timestamp").alias("trained_utc"))
        s = li.join(self.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(
            self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        arch = F.when(F.col("s_suppkey") % 2 == 0, "baseline").otherwise("ML")
        return s.select(
            F.col("s_suppkey").alias("sid"), F.format_string("g%d", F.col("n_regionkey")).alias("scope"),
            T.model_name(arch, F.col("trained_utc"), F.lit(0.25) + (F.col("s_suppkey") % 50) / 100.0,
                         F.col("s_suppkey"), "sea").alias("name"),
            "trained_utc", (F.col("n") * (1 + F.col("s_suppkey") % 3)).alias("n_test_rows"))
