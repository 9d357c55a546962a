"""Additive correction by station and lead: fit, smooth, store, apply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import circular as C

SCALARS = ["sw1_height_ft", "sw1_period_s", "sw2_height_ft", "sw2_period_s"]
DIRECTIONS = ["sw1_direction_deg", "sw2_direction_deg"]


def floor_scalar(var: str) -> Column:
    """What is corrected: the mean of the two models."""
    return (F.col(f"a_{var}") + F.col(f"b_{var}")) / 2.0


def floor_direction(var: str) -> Column:
    return C.mean_of_two(F.col(f"a_{var}"), F.col(f"b_{var}"))


def fit_bias(train: DataFrame) -> DataFrame:
    """(station, lead_hours, variable, bias, s, c, n) in one aggregate pass.

    ``bias`` is set for scalars, ``s`` and ``c`` (mean sine and cosine of the
    residual) for directions. Variables are columns of one aggregate and are
    unpivoted afterwards, so the training rows are not multiplied.
    """
    aggs = []
    for v in SCALARS:
        r = F.col(f"obs_{v}") - floor_scalar(v)
        aggs.append(F.struct(F.avg(r).alias("bias"), F.lit(None).cast("double").alias("s"),
                             F.lit(None).cast("double").alias("c"), F.count(r).alias("n")).alias(v))
    for v in DIRECTIONS:
        r = C.diff_deg(F.col(f"obs_{v}"), floor_direction(v))
        aggs.append(F.struct(F.lit(None).cast("double").alias("bias"), F.avg(C.sin_deg(r)).alias("s"),
                             F.avg(C.cos_deg(r)).alias("c"), F.count(r).alias("n")).alias(v))
    wide = train.groupBy("station", "lead_hours").agg(*aggs)
    names = SCALARS + DIRECTIONS
    return (wide.unpivot(["station", "lead_hours"], names, "variable", "_v")
            .filter(F.col("_v.n") > 0)
            .select("station", "lead_hours", "variable", "_v.bias", "_v.s", "_v.c", "_v.n"))


def smooth_leads(table: DataFrame, half_width: int, step: int = 1) -> DataFrame:
    """Triangular, count-weighted mean over neighbouring leads.

    ``step`` is the distance of two neighbours in hours, as the models issue
    them; ``half_width`` counts steps. Neighbours are added up in order of their
    lead, each through a range frame of its own. One window partition holds the
    leads of one station and variable: a few hundred rows at most.
    """
    if half_width <= 0:
        return table
    w = Window.partitionBy("station", "variable").orderBy("lead_hours")

    def tri(c: Column) -> Column:
        total = F.lit(0.0)
        for k in range(-half_width, half_width + 1):
            near = F.sum(c).over(w.rangeBetween(k * step, k * step)) * (half_width + 1.0 - abs(k))
            total = total + (near if k == 0 else F.coalesce(near, F.lit(0.0)))
        return total

    terms = table.select("station", "lead_hours", "variable", "n", *[(F.col("n") * F.col(c)).alias(c) for c in ("bias", "s", "c")])
    sums = terms.select("station", "lead_hours", "variable", tri(F.col("bias")).alias("bias"), tri(F.col("s")).alias("s"), tri(F.col("c")).alias("c"),
                        tri(F.col("n")).alias("_den"), "n")
    return sums.select("station", "lead_hours", "variable", *[(F.col(c) / F.col("_den")).alias(c) for c in ("bias", "s", "c")], "n")


def bias_wide(table: DataFrame) -> DataFrame:
    """One row per (station, lead) with a column per variable, ready to join."""
    aggs = [F.max(F.when(F.col("variable") == v, F.col("bias"))).alias(f"bias_{v}") for v in SCALARS]
    for v in DIRECTIONS:
        aggs += [F.max(F.when(F.col("variable") == v, F.col(x))).alias(f"{x}_{v}") for x in ("s", "c")]
    return table.groupBy("station", "lead_hours").agg(*aggs)


def apply_bias(df: DataFrame, table: DataFrame) -> DataFrame:
    """Add pred_<variable>; a cell without a bias is left uncorrected.

    The table grows with the stations, so the join carries no broadcast hint:
    the optimizer broadcasts it only when its measured size allows.
    """
    j = df.join(bias_wide(table), ["station", "lead_hours"], "left")
    preds = {f"pred_{v}": floor_scalar(v) + F.coalesce(F.col(f"bias_{v}"), F.lit(0.0)) for v in SCALARS}
    for v in DIRECTIONS:
        turn = C.from_sincos(F.coalesce(F.col(f"s_{v}"), F.lit(0.0)), F.coalesce(F.col(f"c_{v}"), F.lit(1.0)))
        preds[f"pred_{v}"] = C.wrap360(floor_direction(v) + turn)
    return j.select(*df.columns, *[c.alias(n) for n, c in preds.items()])


def raw_predictions(df: DataFrame, model: str) -> DataFrame:
    """One model's own values as predictions, for comparison."""
    return df.select("*", *[F.col(f"{model}_{v}").alias(f"pred_{v}") for v in SCALARS + DIRECTIONS])
