"""Helpers for array expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    Inside a lambda an expression is evaluated again for every element. Bound
    as the only element of an array it is a variable instead, so a body that
    looks into a computed array at many positions stays linear.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def stage(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """Add columns that later steps read as values, not as expressions.

    The optimizer may push a filter below a projection, or merge projections,
    by writing a whole formula into each place that uses it; along a chain of
    formulas that repeats work many times over. It leaves a column alone that
    depends on the task, so each one carries a test on the partition number
    that is always true. Values stay the same in every task, and the work
    stays inside whole-stage codegen.
    """
    always = F.spark_partition_id() >= 0
    return df.select(*[c for c in df.columns if c not in cols], *[F.when(always, c).alias(n) for n, c in cols.items()])
