"""Pair two forecast models on lead, attach observations, count coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import timefn as T
from ..functions import units as U
from .ordered import epoch, latest_by
from .waves import combined_fallback

PAIR_KEYS = ["station", "cycle_utc", "valid_utc", "lead_hours"]
FORECAST_VALUES = [f"{p}_{x}" for p in ("sw1", "sw2") for x in ("height_ft", "period_s", "direction_deg")] + [
    "combined_height_m", "combined_period_s", "combined_direction_deg"]
SWELL_VARS = [f"{p}_{x}" for p in ("sw1", "sw2") for x in ("height_ft", "period_s", "direction_deg")]


def pair_models(a: DataFrame, b: DataFrame) -> DataFrame:
    """Inner join on station, cycle, valid time and lead; values prefixed a_ and b_."""
    def side(df: DataFrame, p: str) -> DataFrame:
        return df.select(*PAIR_KEYS, *[F.col(c).alias(f"{p}_{c}") for c in FORECAST_VALUES])

    return side(a, "a").join(side(b, "b"), PAIR_KEYS)


def hourly_obs(obs: DataFrame, partitions=(1, 2)) -> DataFrame:
    """One observation per (station, hour, partition).

    The latest ingest wins; equal ingest times fall to the reading nearest the
    hour, then to the later reading, then to the larger values.
    """
    snapped = obs.filter(F.col("partition").isin(*partitions)).withColumn("hour_utc", T.snap_hour(F.col("valid_utc")))
    near = -F.abs(epoch(F.col("valid_utc")) - epoch(F.col("hour_utc")))
    return latest_by(snapped, ["station", "hour_utc", "partition"],
                     [F.col("ingest_utc"), near, F.col("valid_utc"), F.struct("hs_m", "tp_s", "dp_deg")],
                     ["hs_m", "tp_s", "dp_deg", "valid_utc", "ingest_utc"])


def obs_wide(obs: DataFrame) -> DataFrame:
    """Hourly observations with primary and secondary swell side by side.

    Both steps are one aggregate: the pick is made per (station, hour) with a
    conditional max_by for each partition, so the data is shuffled once.
    """
    snapped = obs.filter(F.col("partition").isin(1, 2)).withColumn("hour_utc", T.snap_hour(F.col("valid_utc")))
    near = -F.abs(epoch(F.col("valid_utc")) - epoch(F.col("hour_utc")))
    value = F.struct("hs_m", "tp_s", "dp_deg")
    order = F.struct(F.col("ingest_utc"), near.alias("near"), F.col("valid_utc"), value.alias("value"))
    picks = [F.max_by(value, F.when(F.col("partition") == p, order)).alias(f"_p{p}") for p in (1, 2)]
    out = snapped.groupBy("station", "hour_utc").agg(*picks)
    cols = []
    for p in (1, 2):
        cols += [(F.col(f"_p{p}.hs_m") * U.FT_PER_M).alias(f"obs_sw{p}_height_ft"),
                 F.col(f"_p{p}.tp_s").alias(f"obs_sw{p}_period_s"),
                 F.col(f"_p{p}.dp_deg").alias(f"obs_sw{p}_direction_deg")]
    return out.select("station", "hour_utc", *cols)


def complete(prefix: str) -> Column:
    return (F.col(f"{prefix}_height_ft").isNotNull() & F.col(f"{prefix}_period_s").isNotNull()
            & F.col(f"{prefix}_direction_deg").isNotNull())


def attach_obs(paired: DataFrame, obs: DataFrame) -> DataFrame:
    """Left join the hourly observation on station and snapped hour."""
    return (paired.withColumn("hour_utc", T.snap_hour(F.col("valid_utc")))
            .join(obs_wide(obs), ["station", "hour_utc"], "left"))


def usable(df: DataFrame) -> DataFrame:
    """Rows whose primary or secondary observation is complete."""
    return df.filter(complete("obs_sw1") | complete("obs_sw2"))


def paired_dataset(a: DataFrame, b: DataFrame, obs: DataFrame, fallback: bool = True) -> DataFrame:
    """The training table: both models, the fallback on model b, a usable target."""
    p = pair_models(a, b)
    if fallback:
        p = combined_fallback(p, "b_", "b_sw1_source")
    return usable(attach_obs(p, obs))


def training_ready(obs: DataFrame) -> DataFrame:
    return obs.filter(F.col("partition").isin(1, 2) & F.col("hs_m").isNotNull()
                      & F.col("tp_s").isNotNull() & F.col("dp_deg").isNotNull())


def target_counts(df: DataFrame) -> DataFrame:
    """How many rows can train each target: (variable, n)."""
    wide = df.agg(*[F.count(f"obs_{v}").alias(v) for v in SWELL_VARS])
    return wide.unpivot([], SWELL_VARS, "variable", "n")


def cycle_coverage(a: DataFrame, b: DataFrame, obs: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Per (station, cycle): which models hold it, shared hours, hours observed, paired flag."""
    tagged = (a.select("station", "cycle_utc", "valid_utc", F.lit(1).alias("m"))
              .unionByName(b.select("station", "cycle_utc", "valid_utc", F.lit(2).alias("m"))))
    hours = tagged.groupBy("station", "cycle_utc", "valid_utc").agg(
        F.max(F.col("m") == 1).alias("in_a"), F.max(F.col("m") == 2).alias("in_b"))
    seen = (training_ready(obs).select("station", T.snap_hour(F.col("valid_utc")).alias("valid_utc"))
            .distinct().withColumn("seen", F.lit(True)))
    joined = hours.join(seen, ["station", "valid_utc"], "left")
    both = F.col("in_a") & F.col("in_b")
    out = joined.groupBy("station", "cycle_utc").agg(
        F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"),
        F.count_if(both).alias("shared"),
        F.count_if(both & F.col("seen")).alias("matched"))
    ok = (F.col("shared") > 0) & (F.col("matched") / F.col("shared") >= threshold)
    return out.withColumn("paired", F.coalesce(ok, F.lit(False)))


def station_coverage(cov: DataFrame, target_cycles: int = 365) -> DataFrame:
    """Per station: cycles per model, paired cycles and samples, span, progress."""
    paired = F.count_if("paired")
    return cov.groupBy("station").agg(
        F.count_if("in_a").alias("a_cycles"), F.count_if("in_b").alias("b_cycles"),
        paired.alias("paired_cycles"),
        F.coalesce(F.sum(F.when(F.col("paired"), F.col("matched"))), F.lit(0)).alias("paired_samples"),
        F.round(F.least(F.lit(1.0), paired / F.lit(float(target_cycles))), 3).alias("progress_target"),
        F.coalesce(F.min(F.when(F.col("in_a"), F.col("cycle_utc"))),
                   F.min(F.when(F.col("in_b"), F.col("cycle_utc")))).alias("earliest"),
        F.coalesce(F.max(F.when(F.col("in_a"), F.col("cycle_utc"))),
                   F.max(F.when(F.col("in_b"), F.col("cycle_utc")))).alias("latest"))


def doy_histogram(cov: DataFrame) -> DataFrame:
    """Cycles per calendar day, per station and pooled over all of them.

    Grouping sets in one pass; station is null on the pooled rows.
    """
    d = cov.withColumn("doy", F.date_format("cycle_utc", "MM-dd"))
    return (d.groupingSets([[F.col("station"), F.col("doy")], [F.col("doy")]], "station", "doy")
            .agg(F.count_if("paired").alias("paired_runs"), F.count_if("in_a").alias("a_runs"),
                 F.count_if("in_b").alias("b_runs")))


def coverage_fraction(cov: DataFrame) -> DataFrame:
    days = F.count_distinct(F.when(F.col("paired"), F.date_format("cycle_utc", "MM-dd")))
    return cov.agg(days.alias("paired_days"), F.round(days / F.lit(365.0), 2).alias("coverage_frac"))


def archive_summary(cov: DataFrame) -> DataFrame:
    """Mean paired cycles over stations, and the years seen in any model.

    The only collected set holds calendar years, so the archive's age bounds it.
    """
    mean = F.count_if("paired") / F.count_distinct("station")
    return cov.agg(F.round(mean, 1).alias("mean_paired_cycles"),
                   F.array_join(F.array_sort(F.collect_set(F.year("cycle_utc"))), ",").alias("years_seen"))


def split_threshold(cycles: DataFrame, fraction: float = 0.15, scope: list[str] | None = None,
                    cycle: str = "cycle_utc") -> DataFrame:
    """First test cycle of a time holdout, per scope.

    Cycles are counted by month first, so the ordered step runs over months,
    never over all cycles in one task.
    """
    scope = scope or []
    d = cycles.select(*scope, cycle).distinct().withColumn("_month", F.date_trunc("month", cycle))
    months = d.groupBy(*scope, "_month").agg(F.count("*").alias("_n"))
    later = Window.partitionBy(*(scope or [F.lit(0)])).orderBy(F.col("_month").desc())
    months = months.select(
        *scope, "_month",
        (F.sum("_n").over(later.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")).alias("_after"),
        F.sum("_n").over(later.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n_cycles"))
    inside = Window.partitionBy(*scope, "_month").orderBy(F.col(cycle).desc())
    ranked = (d.withColumn("_r", F.row_number().over(inside)).join(months, [*scope, "_month"])
              .withColumn("_back", F.col("_r") + F.col("_after")))
    # Half-even, so that exactly half a cycle rounds to the even count.
    hold = F.greatest(F.lit(1), F.bround(F.col("n_cycles") * F.lit(float(fraction)), 0).cast("int"))
    return (ranked.filter(F.col("_back") <= hold).groupBy(*scope)
            .agg(F.min(cycle).alias("test_from"), F.max("n_cycles").alias("n_cycles"),
                 F.count("*").alias("n_test_cycles")))


def time_split(df: DataFrame, fraction: float = 0.15, cycle: str = "cycle_utc") -> DataFrame:
    """Add ``is_test``: true for the last share of distinct cycles.

    The threshold enters as a scalar subquery, so the rows are not shuffled.
    """
    start = split_threshold(df, fraction, cycle=cycle).select("test_from").scalar()
    return df.withColumn("is_test", F.col(cycle) >= start)


def assert_time_split(df: DataFrame, cycle: str = "cycle_utc") -> None:
    """Raise when a training cycle is not earlier than every test cycle."""
    row = df.agg(F.max(F.when(~F.col("is_test"), F.col(cycle))).alias("hi"),
                 F.min(F.when(F.col("is_test"), F.col(cycle))).alias("lo")).first()
    if row.hi is not None and row.lo is not None and not row.hi < row.lo:
        raise ValueError(f"time split violated: {row.hi} >= {row.lo}")


def features(df: DataFrame, stations: list[str] | None = None) -> DataFrame:
    """Model inputs: direction sines and cosines, model deltas, season, one-hot."""
    from ..functions import circular as C

    cols: dict[str, Column] = {}
    for m in ("a", "b"):
        for sw in ("sw1", "sw2"):
            d = F.col(f"{m}_{sw}_direction_deg")
            cols[f"{m}_{sw}_dp_sin"], cols[f"{m}_{sw}_dp_cos"] = C.sin_deg(d), C.cos_deg(d)
    for sw in ("sw1", "sw2"):
        for v in ("height_ft", "period_s"):
            cols[f"d_{sw}_{v}"] = F.col(f"a_{sw}_{v}") - F.col(f"b_{sw}_{v}")
        cols[f"d_{sw}_dp_deg"] = C.diff_deg(F.col(f"a_{sw}_direction_deg"), F.col(f"b_{sw}_direction_deg"))
        o = F.col(f"obs_{sw}_direction_deg") if f"obs_{sw}_direction_deg" in df.columns else None
        if o is not None:
            cols[f"obs_{sw}_dp_sin"], cols[f"obs_{sw}_dp_cos"] = C.sin_deg(o), C.cos_deg(o)
    cols["doy_sin"], cols["doy_cos"] = T.doy_sin(F.col("valid_utc")), T.doy_cos(F.col("valid_utc"))
    for s in stations or []:
        cols[f"is_{s}"] = (F.col("station") == s).cast("double")
    return df.withColumns(cols)


def in_window(df: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    """Rows from start up to end; a plain range that reaches the scan."""
    c = F.col(ts)
    return df.filter((c >= F.lit(start).cast("timestamp")) & (c < F.lit(end).cast("timestamp")))


def three_way_agreement(obs: DataFrame, forecast: DataFrame, bands, min_lead: int | None = 0) -> DataFrame:
    """Whether both models put the observed hour in the observed category.

    ``obs`` has one row per (station, hour_utc) with hs_m and tp_s. The models'
    latest cycles are folded to one row per (station, hour) in the same
    aggregate that picks them, so one join serves both.
    """
    from ..functions.rules import swell_category

    src = forecast if min_lead is None else forecast.filter(F.col("lead_hours") >= min_lead)
    pick = lambda m: F.max_by(F.struct("sw1_height_ft", "sw1_period_s"), F.when(F.col("model") == m, F.col("cycle_utc")))
    both = src.groupBy("station", F.col("valid_utc").alias("hour_utc")).agg(pick("A").alias("_a"), pick("B").alias("_b"))
    d = obs.join(both, ["station", "hour_utc"], "left")
    seen = (F.col("hs_m") > 0) & (F.col("tp_s") > 0)
    d = d.withColumn("observed_cat", F.when(seen, swell_category(F.col("hs_m") * U.FT_PER_M, F.col("tp_s"), bands)))
    same, known = F.lit(True), F.col("observed_cat").isNotNull()
    for m in ("_a", "_b"):
        h, p = F.col(f"{m}.sw1_height_ft"), F.col(f"{m}.sw1_period_s")
        known = known & h.isNotNull() & p.isNotNull()
        same = same & (swell_category(h, p, bands) == F.col("observed_cat"))
    return d.withColumn("agreement", F.when(known, same)).drop("_a", "_b")
