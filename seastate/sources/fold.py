"""Rows folded into a stored table: merged by key, partition by partition, committed as one snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import latest_by
from ..session import settings
from .snapshots import exists, replace_parts, touched


def fold(new: DataFrame, path: str, schema: str, keys: list[str], order: list[Column], parts: list[str], skip_known: bool = False) -> bool:
    """Merge ``new`` into the table: per key the row that is greatest by ``order`` stays. Returns whether something was written.

    With ``skip_known`` a batch that would change nothing is not written: every key is stored with an order at least as great.
    A stream with state turns adaptive execution off for its batches too; here it is on, so a large partition is split over tasks.
    """
    with settings(new.sparkSession, spark__sql__adaptive__enabled="true"):
        return _fold(new, path, schema, keys, order, parts, skip_known)


def _fold(new: DataFrame, path: str, schema: str, keys: list[str], order: list[Column], parts: list[str], skip_known: bool) -> bool:
    best = latest_by(new, keys, order)
    if exists(new.sparkSession, path):
        old = touched(new, path, schema, parts).select(*best.columns)
        if skip_known:
            rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
            had = old.select(*keys, rank.alias("_had"))
            ahead = best.withColumn("_rank", rank).join(had, keys, "left").where(F.col("_had").isNull() | (F.col("_rank") > F.col("_had")))
            if ahead.isEmpty():
                return False
        best = latest_by(old.unionByName(best), keys, order)
    replace_parts(best, path, parts)
    return True
