"""Forecast records: partitions to components, fallback, wide rows, densify."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import circular as C
from ..functions import timefn as T
from ..functions import units as U
from ..functions.rules import SwellWindow, window_score
from .ordered import WEEK, epoch, latest_by, neighbours

# Shorter swell is sea, and mean period to peak period.
MIN_SWELL_PERIOD_S = 5.0
MEAN_TO_PEAK = 1.20

COMPONENT = "struct<height_ft:double,period_s:double,direction_deg:double,energy:double,type:string>"


def swell_components(parts: Column, period_scale: float = 1.0) -> Column:
    """array<struct<h_m,p,d,type>> to the two components with most energy.

    The period floor applies before scaling; equal energy keeps input order.
    """
    kept = F.filter(parts, lambda c: (c["h_m"] > 0) & (c["p"] >= MIN_SWELL_PERIOD_S))

    def shape(c: Column, i: Column) -> Column:
        h, p = U.m_to_ft(c["h_m"]), c["p"] * period_scale
        return F.struct(h.alias("height_ft"), F.round(p, 1).alias("period_s"),
                        c["d"].alias("direction_deg"), U.forecast_energy(h, p).alias("energy"),
                        c["type"].alias("type"), i.alias("_i"))

    return top_components(F.transform(kept, shape))


def top_components(comps: Column, n: int = 2) -> Column:
    """The n components with most energy; a null energy counts as 0.

    Each component carries ``_i``, its input position, as the tie-break.
    """
    keyed = F.transform(comps, lambda c: F.struct(
        (-F.coalesce(c["energy"], F.lit(0.0))).alias("k"), c["_i"].alias("i"), c.alias("c")))
    return F.transform(F.slice(F.array_sort(keyed), 1, n), lambda s: F.struct(
        *[s["c"][f].alias(f) for f in ("height_ft", "period_s", "direction_deg", "energy", "type")]))


def combined_component(h_m: Column, period: Column, deg: Column) -> Column:
    """The combined sea as a stand-in component, null without a height."""
    h = U.m_to_ft(h_m)
    return F.when(h_m > 0, F.struct(h.alias("height_ft"), F.round(period, 1).alias("period_s"),
                                    deg.alias("direction_deg"), U.forecast_energy(h, period).alias("energy"),
                                    F.lit("combined").alias("type")))


def best_direction(primary: Column, *candidates: Column) -> Column:
    """The primary's bearing, else the first bearing that exists."""
    return F.coalesce(primary, *candidates)


def wave_records(df: DataFrame, keys: list[str], ts: str, parts: list[tuple[str, str, str]],
                 combined: tuple[str, str, str], period_scale: float = 1.0,
                 combined_fallback: bool = False) -> DataFrame:
    """Wide partition columns to one nested wave record per time step."""
    labels = ["swell"] + [f"swell{i}" for i in range(2, len(parts) + 1)]
    arr = F.array(*[F.struct(U.finite(F.col(h)).alias("h_m"), U.finite(F.col(p)).alias("p"),
                             U.finite(F.col(d)).alias("d"), F.lit(name).alias("type"))
                    for (h, p, d), name in zip(parts, labels)])
    ch, cp, cd = (U.finite(F.col(c)) for c in combined)
    out = df.withColumn("components", swell_components(arr, period_scale))
    primary = F.get("components", F.lit(0))
    if combined_fallback:
        primary = F.coalesce(primary, combined_component(ch, cp, cd))
    out = out.withColumn("_primary", primary)
    dirs = [F.col(d) for _, _, d in parts] + [F.col(combined[2])]
    return out.select(
        *keys, F.col(ts).alias("time"),
        F.col("_primary.height_ft").alias("wave_height_ft"),
        F.col("_primary.period_s").alias("wave_period_s"),
        F.col("_primary.direction_deg").alias("wave_direction_deg"),
        F.col("_primary.energy").alias("energy"), "components",
        best_direction(F.col("_primary.direction_deg"), *dirs).alias("raw_direction_deg"),
        ch.alias("combined_wave_height_m"), cp.alias("combined_wave_period_s"),
        cd.alias("combined_wave_direction_deg"))


def records_to_rows(records: DataFrame, station: str, model: Column, cycle: str, ingest: str) -> DataFrame:
    """Nested records to the flat forecast layout, lead included."""
    cols = [F.col(station).alias("station"), model.alias("model"), F.col(cycle).alias("cycle_utc"),
            F.col("time").alias("valid_utc"), T.lead_hours(F.col("time"), F.col(cycle)).alias("lead_hours")]
    for i in (0, 1):
        comp = F.get("components", F.lit(i))
        cols += [comp[f].alias(f"sw{i + 1}_{f}") for f in ("height_ft", "period_s", "direction_deg")]
    cols += [F.col(f"combined_wave_{a}").alias(f"combined_{a}") for a in ("height_m", "period_s", "direction_deg")]
    return records.select(*cols, F.col(ingest).alias("ingest_utc"))


def combined_fallback(df: DataFrame, prefix: str, tag: str) -> DataFrame:
    """Fill a missing primary swell from the combined sea and say which was used."""
    h, p, d = (F.col(f"{prefix}sw1_{x}") for x in ("height_ft", "period_s", "direction_deg"))
    ch, cp, cd = (F.col(f"{prefix}combined_{x}") for x in ("height_m", "period_s", "direction_deg"))
    use = h.isNull() & F.coalesce(ch > 0, F.lit(False))
    return df.withColumns({
        f"{prefix}sw1_height_ft": F.when(use, ch * U.FT_PER_M).otherwise(h),
        f"{prefix}sw1_period_s": F.when(use, cp).otherwise(p),
        f"{prefix}sw1_direction_deg": F.when(use, cd).otherwise(d),
        tag: F.when(use, "combined_fallback").when(h.isNull(), "missing").otherwise("partition"),
    })


def latest_cycle(df: DataFrame, keys: list[str], valid: str, cycle: str, values: list[str],
                 min_lead: int | None = 0, lead: str = "lead_hours") -> DataFrame:
    """Per valid time, the values of the latest cycle (leads below min_lead left out)."""
    src = df if min_lead is None else df.filter(F.col(lead) >= min_lead)
    return latest_by(src, [*keys, valid], [F.col(cycle)], [cycle, *values])


def latest_cycles(df: DataFrame, keys: list[str], valid: str, cycle: str, columns: dict[str, dict[str, str]], model: str = "model",
                  min_lead: int | None = 0, lead: str = "lead_hours") -> DataFrame:
    """The same for several models side by side, in one aggregate over one scan.

    ``columns`` names for each model the value columns and what they are called in the result; a time a model does not reach has nulls.
    """
    src = df.filter(F.col(model).isin(*columns))
    src = src if min_lead is None else src.filter(F.col(lead) >= min_lead)
    best = {m: F.max_by(F.struct(*names), F.when(F.col(model) == m, F.col(cycle))).alias(f"_{i}") for i, (m, names) in enumerate(columns.items())}
    wide = src.groupBy(*keys, valid).agg(*best.values())
    return wide.select(*keys, valid, *[F.col(f"_{i}.{c}").alias(to) for i, names in enumerate(columns.values()) for c, to in names.items()])


def densify_hourly(df: DataFrame, keys: list[str], ts: str, linear: list[str], angular: list[str],
                   width: float = WEEK) -> DataFrame:
    """Insert the hours between neighbouring rows, blending along the way."""
    cols = [ts, *linear, *angular]
    n = neighbours(df.select(*keys, *cols), keys, epoch(F.col(ts)), cols, width, before=False)
    gap = F.coalesce(F.rint(T.hours_between(F.col(f"next_{ts}"), F.col(ts))).cast("int"), F.lit(1))
    n = n.withColumn("_gap", F.greatest(gap, F.lit(1)))
    n = n.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_gap") - 1)))
    f = F.col("_k") / F.col("_gap")

    def blend(c: str, fn) -> Column:
        return F.when(F.col("_k") == 0, F.col(c)).otherwise(fn(F.col(c), F.col(f"next_{c}"), f)).alias(c)

    return n.select(*keys, F.timestamp_micros(F.unix_micros(ts) + F.col("_k").cast("long") * 3_600_000_000).alias(ts),
                    *[blend(c, C.lerp) for c in linear], *[blend(c, C.lerp_deg) for c in angular],
                    (F.col("_k") > 0).alias("interpolated"))


def pick_window_swell(comps: Column, w: SwellWindow) -> tuple[Column, Column]:
    """(best component or null, all components with score and in_window)."""
    scored = F.transform(comps, lambda c, i: F.struct(
        c["height_ft"].alias("height_ft"), c["period_s"].alias("period_s"),
        c["direction_deg"].alias("direction_deg"), c["type"].alias("type"),
        window_score(c["height_ft"], c["period_s"], c["direction_deg"], w).alias("score"),
        (window_score(c["height_ft"], c["period_s"], c["direction_deg"], w) > 0).alias("in_window"),
        i.alias("pos")))
    ranked = F.transform(F.filter(scored, lambda c: c["score"] > 0),
                         lambda c: F.struct((-c["score"]).alias("k"), c["pos"].alias("i"), c.alias("c")))
    return F.get(F.array_sort(ranked), F.lit(0))["c"], scored
