"""Ordered work over long series, cut into time blocks.

One station may hold a third of all rows, so no window here is partitioned by
the station alone. Each series is cut into fixed-width blocks; windows run
inside (station, block), and a summary of one row per block carries values
across block edges. Gaps of any length, including empty blocks, are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3600
DAY = 24 * HOUR
WEEK = 7 * DAY


def epoch(c: Column) -> Column:
    """Seconds since 1970 as a double, microseconds kept."""
    return F.unix_micros(c) / F.lit(1e6)


def block_of(order: Column, width: float) -> Column:
    """Block number of an ordering key already expressed as a number."""
    return F.floor(order / F.lit(float(width)))


def latest_by(df: DataFrame, keys: list[str], order: list[Column], values: list[str] | None = None) -> DataFrame:
    """One row per key: the one that is greatest by ``order``.

    An aggregate, not a window: copies shrink before the shuffle, so a key
    that holds a third of all rows costs one row per map task.
    """
    values = values or [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*values), F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)]))
    return (df.groupBy(*keys).agg(best.alias("_best"))
            .select(*keys, *[F.col(f"_best.{v}").alias(v) for v in values]))


def neighbours(df: DataFrame, keys: list[str], order: Column, cols: list[str], width: float,
               before: bool = True, after: bool = True) -> DataFrame:
    """Add prev_<c> and next_<c> from the adjacent rows of each series.

    ``order`` is a numeric expression, unique within a series.
    """
    base = df.withColumn("_ord", order).withColumn("_block", block_of(F.col("_ord"), width))
    val = F.struct(*cols)
    along = Window.partitionBy(*keys).orderBy("_block")
    inside = Window.partitionBy(*keys, "_block").orderBy("_ord")
    edges = base.groupBy(*keys, "_block").agg(
        F.min_by(val, "_ord").alias("_first"), F.max_by(val, "_ord").alias("_last"))
    edge_cols, row_cols, out = [], [], []
    if before:
        edge_cols.append(F.lag("_last").over(along).alias("_edge_prev"))
        row_cols.append(F.lag(val).over(inside).alias("_row_prev"))
        out += [F.coalesce("_row_prev", "_edge_prev")[c].alias(f"prev_{c}") for c in cols]
    if after:
        edge_cols.append(F.lead("_first").over(along).alias("_edge_next"))
        row_cols.append(F.lead(val).over(inside).alias("_row_next"))
        out += [F.coalesce("_row_next", "_edge_next")[c].alias(f"next_{c}") for c in cols]
    edges = edges.select(*keys, "_block", *edge_cols)
    return (base.select("*", *row_cols).join(edges, [*keys, "_block"])
            .select(*df.columns, *out))


def running_sum(df: DataFrame, keys: list[str], order: Column, value: Column, width: float, out: str) -> DataFrame:
    """Cumulative sum along each series, the current row included."""
    base = (df.withColumn("_ord", order).withColumn("_block", block_of(F.col("_ord"), width))
            .withColumn("_v", value))
    inside = (Window.partitionBy(*keys, "_block").orderBy("_ord")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    along = (Window.partitionBy(*keys).orderBy("_block")
             .rowsBetween(Window.unboundedPreceding, -1))
    offsets = (base.groupBy(*keys, "_block").agg(F.sum("_v").alias("_t"))
               .select(*keys, "_block", F.coalesce(F.sum("_t").over(along), F.lit(0)).alias("_off")))
    return (base.withColumn("_in", F.sum("_v").over(inside)).join(offsets, [*keys, "_block"])
            .select(*df.columns, (F.col("_in") + F.col("_off")).alias(out)))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str,
          cols: list[str], width: float = DAY, collapse_copies: bool = False) -> DataFrame:
    """For each left row, the last right row at or before it and the first after.

    Adds ``before`` and ``after``: structs of (at, cols), null where the series
    has none. Linear in the input: sides are merged and read once in each
    direction, so no pair of rows is ever formed. ``right`` is first reduced to
    one row per (keys, right_ts). With ``collapse_copies`` identical left rows
    travel as one row and a count, so a pile of copies cannot fill one block.
    """
    if collapse_copies:
        packed = left.groupBy(*left.columns).agg(F.count("*").alias("_copies"))
        out = as_of(packed, right, keys, left_ts, right_ts, cols, width)
        return (out.withColumn("_one", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
                .select(*left.columns, "before", "after"))
    right = latest_by(right.select(*keys, right_ts, *cols), [*keys, right_ts], [F.struct(*cols)], cols)
    payload = F.struct(F.col(right_ts).alias("at"), *cols)
    right_rows = right.select(*keys, epoch(F.col(right_ts)).alias("_ord"), payload.alias("_r"),
                              F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_l"))
    left_rows = left.select(*keys, epoch(F.col(left_ts)).alias("_ord"),
                            F.lit(None).cast(right_rows.schema["_r"].dataType).alias("_r"),
                            F.struct(*left.columns).alias("_l"))
    both = right_rows.unionByName(left_rows).withColumn("_block", block_of(F.col("_ord"), width))

    # Rows at one instant: the right row comes first, so it counts as "before".
    up = (Window.partitionBy(*keys, "_block").orderBy(F.col("_ord"), F.col("_l").isNotNull())
          .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    down = (Window.partitionBy(*keys, "_block")
            .orderBy(F.col("_ord").desc(), F.col("_l").isNotNull().desc())
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    along = Window.partitionBy(*keys).orderBy("_block")
    edges = (both.groupBy(*keys, "_block")
             .agg(F.max_by("_r", F.when(F.col("_r").isNotNull(), F.col("_ord"))).alias("_hi"),
                  F.min_by("_r", F.when(F.col("_r").isNotNull(), F.col("_ord"))).alias("_lo"))
             .select(*keys, "_block",
                     F.last("_hi", True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_carry_up"),
                     F.last("_lo", True).over(
                         Window.partitionBy(*keys).orderBy(F.col("_block").desc())
                         .rowsBetween(Window.unboundedPreceding, -1)).alias("_carry_down")))
    seen = (both.withColumn("_before", F.last("_r", True).over(up))
            .withColumn("_after", F.last("_r", True).over(down))
            .filter(F.col("_l").isNotNull()))
    return (seen.join(edges, [*keys, "_block"])
            .select("_l.*", F.coalesce("_before", "_carry_up").alias("before"),
                    F.coalesce("_after", "_carry_down").alias("after")))


def nearest(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str,
            cols: list[str], tolerance_s: float, inclusive: bool = True, width: float = DAY) -> DataFrame:
    """Nearest right row within the tolerance; the earlier one wins a tie.

    Adds ``match_at`` and the right columns, null where nothing is near enough.
    """
    m = as_of(left, right, keys, left_ts, right_ts, cols, width)
    t = epoch(F.col(left_ts))
    gap_b = t - epoch(F.col("before.at"))
    gap_a = epoch(F.col("after.at")) - t
    near = F.when(F.col("before").isNull(), F.col("after")).when(
        F.col("after").isNull() | (gap_b <= gap_a), F.col("before")).otherwise(F.col("after"))
    m = m.withColumn("_near", near)
    gap = F.abs(epoch(F.col("_near.at")) - t)
    ok = gap <= tolerance_s if inclusive else gap < tolerance_s
    m = m.withColumn("_near", F.when(ok, F.col("_near")))
    return m.select(*left.columns, F.col("_near.at").alias("match_at"),
                    *[F.col(f"_near.{c}").alias(c) for c in cols])


def dense_position(df: DataFrame, keys: list[str], order: Column, width: float, out: str, total: str) -> DataFrame:
    """1-based position of each row in its series, and the series length.

    ``df`` holds one row per (keys, order).
    """
    one = F.lit(1)
    ranked = running_sum(df, keys, order, one, width, out)
    sizes = df.groupBy(*keys).agg(F.count("*").alias(total))
    return ranked.join(sizes, keys) if keys else ranked
