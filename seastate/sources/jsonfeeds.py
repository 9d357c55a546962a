"""Hourly forecast JSON, tide predictions and sensor GeoJSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def read_json(spark: SparkSession, paths, schema: str, multi_line: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", multi_line).json(paths)


def explode_hourly(payloads: DataFrame, keys: list[str], hourly: str = "hourly") -> DataFrame:
    """Struct of parallel arrays to one row per time.

    ``time`` leads; a missing or short array reads as null.
    """
    fields = [f.name for f in payloads.schema[hourly].dataType if f.name != "time"]
    zipped = F.transform(F.col(f"{hourly}.time"), lambda t, i: F.struct(
        t.alias("time"), *[F.get(F.col(f"{hourly}.{f}"), i).alias(f) for f in fields]))
    return payloads.select(*keys, F.explode(zipped).alias("_r")).select(*keys, "_r.*")


def explode_tide(payloads: DataFrame) -> DataFrame:
    """Prediction lists to (station, t, v, type); times are local wall clock."""
    return (payloads.select("station", F.explode("predictions").alias("p"))
            .select("station", F.try_to_timestamp("p.t", F.lit("yyyy-MM-dd HH:mm")).cast("timestamp_ntz").alias("t"),
                    F.col("p.v").try_cast("double").alias("v"), F.col("p.type").alias("type"))
            .filter(F.col("t").isNotNull() & F.col("v").isNotNull()))


def explode_features(payloads: DataFrame) -> DataFrame:
    """GeoJSON features to one reading per row; features without a site or time are dropped."""
    p = payloads.select(F.explode("features").alias("f")).select("f.properties.*")
    return p.select(F.col("site_name").alias("site"), F.try_to_timestamp("TIME").alias("time"),
                    F.col("significant_wave_height").alias("hs_m"), F.col("peak_wave_period").alias("tp_s"),
                    F.col("peak_wave_direction").alias("dp_deg"), "instrument",
                    ).filter(F.col("site").isNotNull() & F.col("time").isNotNull())


def read_model_meta(spark: SparkSession, paths) -> DataFrame:
    return read_json(spark, paths, schemas.MODEL_META, multi_line=True)
