"""Small stored tables: bias, model metadata, daily evaluation, sites, key merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import timefn as T
from ..operators.bias import DIRECTIONS, SCALARS
from .snapshots import exists, load, replace_parts, touched


def save_bias(table: DataFrame, path: str) -> None:
    table.select("station", "lead_hours", "variable", "bias", "s", "c", "n").write.mode("overwrite").parquet(path)


def load_bias(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.BIAS).parquet(path)


def model_inventory(meta: DataFrame, prefix: str) -> DataFrame:
    """Parsed model names with training time, newest first."""
    parts = T.parse_model_name(F.col("name"), prefix)
    return (meta.filter(F.startswith("name", F.lit(prefix + "+")))
            .select("*", *[c.alias(k) for k, c in parts.items()],
                    F.try_to_timestamp("trained_utc").alias("trained_ts"))
            .orderBy(F.col("trained_ts").desc_nulls_last(), "name"))


def listed(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Add ``place``, 1 for the first row of each group in a total order; sort by keys and place to print a listing."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def meta_skill_parts(meta: DataFrame, reference: str = "raw_A") -> DataFrame:
    """Model metadata to (scope, name, variable, model_value, ref_value) for the composite skill.

    The model's own block is the first present of ml, baseline and model.
    """
    from ..operators.metrics import POOLED, f1

    m = meta.withColumns({
        "_own": F.coalesce(*[F.try_element_at("metrics", F.lit(k)) for k in ("ml", "baseline", "model")]),
        "_ref": F.try_element_at("metrics", F.lit(reference))})

    def f1_of(block: str):
        c = F.try_element_at(F.col(f"{block}.surfer"), F.lit(POOLED))
        return f1(c["sens"], c["ppv"])

    parts = [F.struct(F.lit(v).alias("variable"), F.col(f"_own.{v}.mae").alias("model_value"),
                      F.col(f"_ref.{v}.mae").alias("ref_value")) for v in SCALARS + DIRECTIONS]
    parts.append(F.struct(F.lit("surfer_f1").alias("variable"), f1_of("_own").alias("model_value"),
                          f1_of("_ref").alias("ref_value")))
    return m.select("scope", "name", F.explode(F.array(*parts)).alias("_p")).select("scope", "name", "_p.*")


def replace_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows win on their keys, all other old rows stay."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def merge_counted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """replace_rows with ``change``: added, replaced or kept."""
    marks = new.select(*keys).distinct().withColumn("_n", F.lit(True))
    had = old.select(*keys).distinct().withColumn("_o", F.lit(True))
    kept = old.join(marks.select(*keys), keys, "left_anti").withColumn("change", F.lit("kept"))
    fresh = (new.join(had, keys, "left")
             .withColumn("change", F.when(F.col("_o"), "replaced").otherwise("added")).drop("_o"))
    return kept.unionByName(fresh)


def append_or_update(spark: SparkSession, rows: DataFrame, path: str, keys: list[str], key: str = "eval_date") -> None:
    """Daily evaluation sink: a rerun replaces its own rows (``keys`` and date); other models of the date stay."""
    rows = rows.withColumn(key, F.col(key).cast("string"))
    if exists(spark, path):
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != key)
        rows = replace_rows(touched(rows, path, schema, [key]).select(*rows.columns), rows, [*keys, key])
    replace_parts(rows, path, [key])


def read_evaluations(spark: SparkSession, path: str, schema: str, key: str = "eval_date") -> DataFrame:
    """The rows that ``append_or_update`` keeps; ``schema`` without the date column."""
    return load(spark, path, schema, [key])


def flatten_sites(regions: DataFrame) -> DataFrame:
    """Nested (region, buoy, spots) to one row per (region, spot); a spot may be in several regions."""
    return regions.select("region", "buoy", F.explode("spots").alias("_s")).select("region", "buoy", "_s.*")


def sites_from_config(spark: SparkSession, config: dict) -> DataFrame:
    """A region map {region: {buoy, spots: [...]}} as a DataFrame for flatten_sites."""
    schema = ("region string, buoy string, spots array<struct<name:string,lat:double,lon:double,shore_normal:double,"
              "tide_station:string,tide_hi_offset:int,tide_lo_offset:int>>")
    fields = ("name", "lat", "lon", "shore_normal", "tide_station", "tide_hi_offset", "tide_lo_offset")
    rows = [(r, c.get("buoy"), [tuple(s.get(f) for f in fields) for s in c.get("spots", [])]) for r, c in config.items()]
    return spark.createDataFrame(rows, schema)


def only_new_keys(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of a batch that are not stored yet; empty means the batch can be skipped."""
    return new.select(*keys).distinct().join(old.select(*keys).distinct(), keys, "left_anti")
