"""Model inventory: metrics rows, ranking and the short list to show."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import DAY, as_of

# Size of a holdout that may be ranked first, and its height floor.
MIN_TEST_ROWS = 1000
HEIGHT_SKILL_FLOOR = 0.0


def select_models(models: DataFrame, scope: list[str], show: int = 3, min_test_rows: int = MIN_TEST_ROWS) -> DataFrame:
    """Per scope: the best eligible model, then the most recent others.

    ``models`` has name, trained_utc, n_test_rows, composite_skill and
    sw1_height_skill. A model is eligible from ``min_test_rows`` holdout rows on. Without an eligible model the newest are shown. The best
    is found by an aggregate, and each pass of the top list keeps ``show``
    rows per task before anything is shuffled.
    """
    ok = (F.col("composite_skill").isNotNull() & (F.col("n_test_rows") >= min_test_rows)
          & (F.col("sw1_height_skill") >= HEIGHT_SKILL_FLOOR))
    rank = F.struct("composite_skill", "trained_utc", "name")
    best = models.groupBy(*scope).agg(F.max_by("name", F.when(ok, rank)).alias("_best"))
    newest = top_newest(models, scope, show)
    picked = newest.select(*models.columns).unionByName(
        models.join(best.filter(F.col("_best").isNotNull()).select(*scope, F.col("_best").alias("name")),
                    [*scope, "name"], "left_semi").select(*models.columns)).dropDuplicates([*scope, "name"])
    w = Window.partitionBy(*scope).orderBy(F.col("is_best").desc(), F.col("trained_utc").desc(), F.col("name").desc())
    return (picked.join(best, scope)
            .withColumn("is_best", F.coalesce(F.col("name") == F.col("_best"), F.lit(False)))
            .withColumn("slot", F.row_number().over(w)).filter(F.col("slot") <= show).drop("_best"))


def top_newest(models: DataFrame, scope: list[str], n: int) -> DataFrame:
    """The n newest models of each scope; Spark keeps n per task before the shuffle."""
    w = Window.partitionBy(*scope).orderBy(F.col("trained_utc").desc(), F.col("name").desc())
    return models.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def others_than_best(models: DataFrame, best: DataFrame, keys: list[str]) -> DataFrame:
    return models.join(best, keys, "left_anti")


def stale_models(models: DataFrame, cycles: DataFrame, keys: list[str], max_days: int = 120) -> DataFrame:
    """Models trained more than ``max_days`` before the newest cycle of their scope."""
    newest = cycles.groupBy(*keys).agg(F.max("cycle_utc").alias("newest_cycle"))
    age = F.floor((F.unix_timestamp("newest_cycle") - F.unix_timestamp("trained_utc")) / 86400)
    return (models.join(newest, keys).withColumn("age_days", age.cast("int"))
            .withColumn("stale", F.col("age_days") > max_days))


def unseen_cycles(cycles: DataFrame, models: DataFrame, keys: list[str], cycle: str = "cycle_utc", trained: str = "trained_utc") -> DataFrame:
    """(keys, cycle, the model's columns) for every distinct cycle and every model trained before it.

    Cycles and training times of a scope are merged in time, once: each cycle learns how many models are older, and the models of a scope
    are numbered by age, so a cycle meets models 1 to that number by equality. No pair is formed that is thrown away again.
    """
    rest = [c for c in models.columns if c not in keys]
    age = Window.partitionBy(*keys).orderBy(F.col(trained), F.struct(*rest))
    numbered = models.where(F.col(trained).isNotNull()).withColumn("_k", F.row_number().over(age))
    each = cycles.select(*keys, cycle).distinct().withColumn("_before", F.col(cycle) - F.expr("INTERVAL 1 MICROSECOND"))
    met = as_of(each, numbered, keys, "_before", trained, ["_k"], width=30 * DAY).where(F.col("before").isNotNull())
    return met.select(*keys, cycle, F.explode(F.sequence(F.lit(1), F.col("before._k"))).alias("_k")).join(numbered, [*keys, "_k"]).drop("_k")


def unseen_rows(paired: DataFrame, models: DataFrame, keys: list[str]) -> DataFrame:
    """Each model's rows for cycles later than its training time: rows meet their cycle's models by equality."""
    return paired.join(unseen_cycles(paired, models, keys), [*keys, "cycle_utc"])
