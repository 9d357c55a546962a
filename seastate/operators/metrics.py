"""Error, confusion and skill metrics, each in one aggregate pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import circular as C
from ..functions.rules import SURF_CLASSES, swell_category
from .bias import DIRECTIONS, SCALARS

POOLED = "FUN_OR_BETTER"


def error_metrics(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, variable, mae, rmse, bias, n); directions use the circular difference."""
    keys = keys or []
    aggs = []
    for v in SCALARS + DIRECTIONS:
        p, y = F.col(f"pred_{v}"), F.col(f"obs_{v}")
        d = C.diff_deg(p, y) if v in DIRECTIONS else p - y
        aggs.append(F.struct(F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"),
                             F.avg(d).alias("bias"), F.count(d).alias("n")).alias(v))
    wide = df.groupBy(*keys).agg(*aggs)
    return (wide.unpivot(keys, SCALARS + DIRECTIONS, "variable", "_m")
            .filter(F.col("_m.n") > 0).select(*keys, "variable", "_m.mae", "_m.rmse", "_m.bias", "_m.n"))


def f1(sens: Column, ppv: Column) -> Column:
    """Harmonic mean; null when either part is missing or both are 0."""
    return F.when((sens + ppv) > 0, F.lit(2.0) * sens * ppv / (sens + ppv))


def confusion(df: DataFrame, observed: str, predicted: str, keys: list[str] | None = None,
              classes=SURF_CLASSES, pooled: str = POOLED) -> DataFrame:
    """(keys, category, tp, fp, fn, tn, n, sens, spec, ppv, npv, f1) per class and pooled.

    All counts come from one aggregate over the rows as they are; the classes
    are unpivoted from the single result row of each key.
    """
    keys = keys or []
    y, p = F.col(observed), F.col(predicted)
    both = df.filter(y.isNotNull() & p.isNotNull())
    tests = [(c, y == c, p == c) for c in classes] + [(pooled, y.isin(*classes), p.isin(*classes))]
    aggs = [F.struct(F.count_if(yy & pp).alias("tp"), F.count_if(~yy & pp).alias("fp"),
                     F.count_if(yy & ~pp).alias("fn"), F.count_if(~yy & ~pp).alias("tn")).alias(c)
            for c, yy, pp in tests]
    names = [c for c, _, _ in tests]
    long = (both.groupBy(*keys).agg(*aggs).unpivot(keys, names, "category", "_c")
            .select(*keys, "category", "_c.*"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    out = long.withColumns({
        "n": tp + fp + fn + tn,
        "sens": F.try_divide(tp.cast("double"), (tp + fn).cast("double")),
        "spec": F.try_divide(tn.cast("double"), (tn + fp).cast("double")),
        "ppv": F.try_divide(tp.cast("double"), (tp + fp).cast("double")),
        "npv": F.try_divide(tn.cast("double"), (tn + fn).cast("double"))})
    return out.withColumn("f1", f1(F.col("sens"), F.col("ppv")))


def categorise_pair(df: DataFrame, bands) -> DataFrame:
    """Observed and predicted category of the primary swell, null unless all four parts exist."""
    parts = [F.col(c) for c in ("obs_sw1_height_ft", "obs_sw1_period_s", "pred_sw1_height_ft", "pred_sw1_period_s")]
    whole = parts[0].isNotNull() & parts[1].isNotNull() & parts[2].isNotNull() & parts[3].isNotNull()
    return df.withColumns({
        "obs_cat": F.when(whole, swell_category(parts[0], parts[1], bands)),
        "pred_cat": F.when(whole, swell_category(parts[2], parts[3], bands))})


# Weight of each part of the composite skill; they sum to one.
SKILL_WEIGHTS = {"sw1_height_ft": 0.25, "sw1_period_s": 0.25, "sw1_direction_deg": 0.05,
                 "sw2_height_ft": 0.05, "sw2_period_s": 0.05, "sw2_direction_deg": 0.05, "surfer_f1": 0.30}


def skill_part(variable: Column, model_value: Column, ref_value: Column) -> Column:
    """1 - mae/ref for errors; the gained share of what was left for F1."""
    err = F.when(ref_value > 0, F.lit(1.0) - model_value / ref_value)
    gain = (model_value - ref_value) / F.greatest(F.lit(0.01), F.lit(1.0) - ref_value)
    return F.when(variable == "surfer_f1", gain).otherwise(err)


def composite_skill(parts: DataFrame, keys: list[str], variable: str = "variable",
                    model_value: str = "model_value", ref_value: str = "ref_value") -> DataFrame:
    """Weighted skill per model; null unless every weighted part is present."""
    v = F.col(variable)
    weight = F.lit(None).cast("double")
    for name, w in SKILL_WEIGHTS.items():
        weight = F.when(v == name, F.lit(w)).otherwise(weight)
    s = skill_part(v, F.col(model_value), F.col(ref_value))
    d = parts.withColumns({"_w": weight, "_s": s}).filter(F.col("_w").isNotNull())
    return d.groupBy(*keys).agg(
        F.when(F.count("_s") == len(SKILL_WEIGHTS), F.sum(F.col("_w") * F.col("_s"))).alias("composite_skill"),
        F.max(F.when(v == "sw1_height_ft", F.col("_s"))).alias("sw1_height_skill"))


def evaluation_row(errors: DataFrame, classes: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """One wide row per evaluated model: every metric, pooled scores and counts."""
    aggs = []
    for v in SCALARS + DIRECTIONS:
        for m in ("mae", "rmse", "bias", "n"):
            aggs.append(F.max(F.when(F.col("variable") == v, F.col(m))).alias(f"{v}_{m}"))
    wide = errors.groupBy(*keys).agg(*aggs)
    pooled = classes.filter(F.col("category") == POOLED).select(
        *keys, F.col("sens").alias("surfer_sens"), F.col("ppv").alias("surfer_ppv"), F.col("f1").alias("surfer_f1"))
    return wide.join(pooled, keys, "left").join(counts, keys, "left")
