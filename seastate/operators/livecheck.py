"""Stored models checked on cycles they have not seen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .bias import DIRECTIONS, SCALARS
from .metrics import categorise_pair, confusion, error_metrics, evaluation_row


def predict_unseen(rows: DataFrame, models: Sequence, scope: str = "scope", cycle: str = "cycle_utc") -> DataFrame | None:
    """name beside the observed and corrected values, for the rows of each model's scope whose cycle is later than its training.

    Each model filters the rows for itself (a pushed-down range), so no row meets a model it is not for; None if there is no model.
    """
    out = None
    for m in models:
        unseen = rows.where((F.col(scope) == m.scope) & (F.col(cycle) > F.lit(m.trained_utc)))
        p = m.predict(unseen)
        keep = [c for v in SCALARS + DIRECTIONS for c in (f"obs_{v}", f"pred_{v}")]
        p = p.select(F.lit(m.name).alias("name"), *rows.columns, *[F.col(c) if c in p.columns else F.lit(None).cast("double").alias(c) for c in keep if c not in rows.columns])
        out = p if out is None else out.unionByName(p)
    return out


def evaluate_unseen(rows: DataFrame, models: Sequence, bands, day: Column, scope: str = "scope", cycle: str = "cycle_utc") -> DataFrame | None:
    """One row per model and day with unseen cycles: every error metric, pooled class scores, rows and cycles.

    Predictions are stored once; all models share each aggregate. A model without unseen cycles has no row.
    """
    p = predict_unseen(rows, models, scope, cycle)
    if p is None:
        return None
    p = materialise(p.withColumn("eval_date", day), "live-predictions")
    keys = ["name", "eval_date"]
    counts = p.groupBy(*keys).agg(F.count("*").alias("n_live_rows"), F.count_distinct(cycle).alias("n_live_cycles"))
    row = evaluation_row(error_metrics(p, keys), confusion(categorise_pair(p, bands), "obs_cat", "pred_cat", keys), counts, keys)
    missing = counts.join(row.select(*keys), keys, "left_anti")  # days on which nothing could be compared still have their counts
    return row.unionByName(missing, allowMissingColumns=True)
