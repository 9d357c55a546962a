"""Hourly outlook: merge sources, score sections, count good days."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import stage
from ..functions.circular import abs_diff_deg
from ..functions.rules import WindStep, _toml, curve, ladder_rating, load_wind_ladder


@dataclass(frozen=True)
class Section:
    """One part of a break: response curves and tables, all from the user's file."""
    key: str
    size: list[list[float]]
    facing: float
    off_axis: list[list[float]]
    period: list[list[float]]
    tide: dict[str, float]
    offshore: float
    standing: float


@dataclass(frozen=True)
class Break:
    """Its sections, what the parts of a score weigh, how much swell allows at all, and the wind ladder."""
    sections: list[Section]
    weights: dict[str, float]
    potential: dict[str, list[list[float]]]
    ladder: list[WindStep]
    poor_below: float


def load_break(path: str | None = None) -> Break:
    raw = _toml(path, "sections.toml")
    return Break([Section(**s) for s in raw["section"]], raw["weights"], raw["potential"], load_wind_ladder(path), raw["poor_below"])


def merge_hourly(parts: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Full outer merge of any number of sources on their keys.

    Rows are stacked and aggregated, so the merge costs one shuffle whatever
    the number of sources. Each source has one row per key and its own columns.
    """
    stacked = None
    for df in parts.values():
        stacked = df if stacked is None else stacked.unionByName(df, allowMissingColumns=True)
    values = [c for c in stacked.columns if c not in keys]
    return stacked.groupBy(*keys).agg(*[F.max(c).alias(c) for c in values])


def potential(face: Column, period: Column, b: Break) -> Column:
    """Upper limit of any score for the swell in the water; 0 without swell."""
    lift = F.coalesce(curve(period, b.potential["period"]), F.lit(1.0))
    return F.coalesce(F.least(F.lit(1.0), curve(face, b.potential["face"]) * lift), F.lit(0.0))


def section_fits(s: Section, b: Break, face: Column, period: Column, deg: Column, state: Column, wind: Column) -> dict[str, Column]:
    """Fit of each part between 0 and 1; what is unknown counts half, an unknown tide nothing against."""
    half = F.lit(0.5)
    by_tide, by_wind = F.lit(None).cast("double"), F.lit(None).cast("double")
    for name, fit in s.tide.items():
        by_tide = F.when(state == name, F.lit(float(fit))).otherwise(by_tide)
    for w in b.ladder:
        by_wind = F.when(wind == w.name, F.lit(w.fit)).otherwise(by_wind)
    return {"size": F.coalesce(curve(face, s.size), F.lit(0.0)), "angle": F.coalesce(curve(abs_diff_deg(deg, F.lit(s.facing)), s.off_axis), half),
            "period": F.coalesce(curve(period, s.period), half), "tide": F.coalesce(by_tide, F.lit(1.0)), "wind": F.coalesce(by_wind, half)}


def rank_sections(df: DataFrame, b: Break, height: str, period: str, direction: str, speed_kt: str, wind_dir: str, state: str,
                  out: str = "ranked") -> DataFrame:
    """Add the scored sections, best first; equal scores keep the order of the file.

    A score is the weighted mean of angle, period, tide and wind, scaled by the section's size fit, the potential of the
    swell and its standing. The sections are a short fixed list, so the ranking is one array per row and nothing is shuffled.
    """
    names = ("angle", "period", "tide", "wind")
    d = stage(df, {"_face": F.when(F.col(height) != 0, F.col(height)), **{
        f"_name_{i}": ladder_rating(F.col(speed_kt), F.col(wind_dir), F.lit(s.offshore), b.ladder) for i, s in enumerate(b.sections)}})
    d = stage(d, {"_potential": potential(F.col("_face"), F.col(period), b), **{
        f"_{k}_{i}": c for i, s in enumerate(b.sections)
        for k, c in section_fits(s, b, F.col("_face"), F.col(period), F.col(direction), F.col(state), F.col(f"_name_{i}")).items()}})
    mix = {}
    for i in range(len(b.sections)):
        total = F.lit(0.0)
        for k in names:
            total = total + F.col(f"_{k}_{i}") * b.weights[k]
        mix[f"_mix_{i}"] = total
    d = stage(d, mix)
    each = []
    for i, s in enumerate(b.sections):
        score = F.rint(F.col(f"_mix_{i}") * F.col(f"_size_{i}") * F.col("_potential") * (100.0 * s.standing)).cast("int")
        low = [F.when(F.col(f"_{k}_{i}") < b.poor_below, F.lit(f"poor {k}")) for k in ("size", *names)]
        each.append(F.struct(
            F.struct((-score).alias("s"), F.lit(i).alias("i")).alias("order"), F.lit(s.key).alias("section"), score.alias("score"),
            F.rint(F.col(f"_mix_{i}") * 100.0).cast("int").alias("raw_score"), F.round(f"_size_{i}", 2).alias("size_fit"),
            F.round(f"_tide_{i}", 2).alias("tide_fit"), F.col(f"_name_{i}").alias("wind"), F.array_compact(F.array(*low)).alias("reasons")))
    return d.select(*df.columns, F.sort_array(F.array(*each)).alias(out))


def best_section(ranked: str = "ranked") -> Column:
    return F.get(F.col(ranked), F.lit(0))["section"]


def stride_from_first(df: DataFrame, keys: list[str], ts: str, hours: int = 3) -> DataFrame:
    """Every third hour counted from the first row of the series.

    The first hour reaches the rows by way of one small row per day of a series, so rows meet it on the day and a long series
    is spread over its days.
    """
    day = F.to_date(ts).alias("_day")
    days = df.groupBy(*keys, day).agg(F.min(ts).alias("_first"))
    series = Window.partitionBy(*keys)
    days = days.select(*keys, "_day", F.hour(F.min("_first").over(series)).alias("_h0"))
    d = df.withColumn("_day", day)
    return d.join(days, [*keys, "_day"]).filter(F.pmod(F.hour(ts) - F.col("_h0"), F.lit(hours)) == 0).select(*df.columns)


def daylight(df: DataFrame, sun: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Hours from sunrise up to sunset; 6 to 18 where the sun table has no row."""
    d = df.withColumn("_d", F.to_date(ts)).join(
        sun.select(*keys, F.col("date").alias("_d"), "sunrise_hour", "sunset_hour"), [*keys, "_d"], "left")
    h = F.hour(ts)
    return d.filter((h >= F.coalesce("sunrise_hour", F.lit(6))) & (h < F.coalesce("sunset_hour", F.lit(18)))
                    ).drop("_d", "sunrise_hour", "sunset_hour")


def good_days(windows: DataFrame, keys: list[str], ts: str, rank_a: str, rank_b: str, cat_a: str, cat_b: str,
              wind: str, ridable: list[str], threshold: int, per_day: int = 2) -> DataFrame:
    """Days with enough windows in which both models reach the threshold and the wind is unknown or ridable."""
    low = F.least(F.when(F.col(rank_b).isNotNull(), F.col(rank_a)), F.when(F.col(rank_a).isNotNull(), F.col(rank_b)))
    cat = F.when(F.col(rank_a) <= F.col(rank_b), F.col(cat_a)).otherwise(F.col(cat_b))
    fine = F.col(wind).isNull() | F.col(wind).isin(*ridable)
    d = windows.withColumns({"_low": low, "_cat": cat, "_day": F.to_date(ts)})
    best = F.max(F.when(F.col("_low").isNotNull(), F.struct(
        F.col("_low").alias("r"), (-F.unix_micros(ts)).alias("t"), F.col("_cat").alias("c"))))
    days = d.groupBy(*keys, "_day").agg(F.count_if((F.col("_low") >= threshold) & fine).alias("_n"), best.alias("_best"))
    return days.groupBy(*keys).agg(F.count_if(F.col("_n") >= per_day).alias("good_days"),
                                   F.coalesce(F.max("_best")["c"], F.lit("FLAT")).alias("category"))


def span_days(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    span = (F.unix_timestamp(F.max(ts)) - F.unix_timestamp(F.min(ts))) / 86400.0
    return df.groupBy(*keys).agg(F.rint(span).cast("int").alias("window_days"))


def payload_status(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """populated, partial or empty, from the nulls of a group."""
    n, have = F.count(F.lit(1)), F.count(value)
    status = F.when(have == 0, "empty").when(have == n, "populated").otherwise("partial")
    return df.groupBy(*keys).agg(n.alias("n"), have.alias("present"), status.alias("status"))


def last_known_good(df: DataFrame, keys: list[str], ts: str, value: str, ok: Column, width: float) -> DataFrame:
    """Serve the last usable value where the current one is not, marked stale."""
    from .ordered import as_of

    good = df.filter(ok).select(*keys, ts, value)
    m = as_of(df, good.withColumnRenamed(ts, "_good_ts"), keys, ts, "_good_ts", [value], width)
    return m.select(*keys, ts, F.coalesce(F.when(ok, F.col(value)), F.col(f"before.{value}")).alias("served"),
                    F.when(ok, "fresh").when(F.col("before").isNotNull(), "stale").otherwise("empty").alias("status"))


def usage_counts(df: DataFrame, label: str, ts: str) -> DataFrame:
    """Calls by label and UTC day, with the day's total (label null) and the grand total."""
    d = df.withColumn("day", F.date_format(ts, "yyyy-MM-dd"))
    return d.rollup("day", label).agg(F.count("*").alias("calls"))


def boundary_table(df: DataFrame, keys: list[str], height: str, period: str, bands, height_step: float = 0.5,
                   period_step: float = 1.0, chart: tuple[float, float] | None = None) -> DataFrame:
    """Category at every cell of a height by period chart, sized by the data of each key, or by ``chart`` (height, period) for all.

    One row of limits per key, expanded by two sequences of fixed steps. With ``chart`` the number of cells does not depend on the data.
    """
    from ..functions.rules import swell_category

    if chart is None:
        lim = df.groupBy(*keys).agg(F.ceil(F.max(height)).alias("_h"), F.max(period).alias("_p"))
    else:
        lim = df.select(*keys).distinct().select(*keys, F.lit(chart[0]).alias("_h"), F.lit(chart[1]).alias("_p"))
    cells = lim.withColumn("_i", F.explode(F.sequence(F.lit(0), (F.col("_h") / height_step).cast("int"))))
    cells = cells.withColumn("_j", F.explode(F.sequence(F.lit(0), (F.col("_p") / period_step).cast("int"))))
    cells = cells.select(*keys, (F.col("_i") * height_step).alias("height_ft"), (F.col("_j") * period_step).alias("period_s"))
    return cells.withColumn("category", swell_category(F.col("height_ft"), F.col("period_s"), bands))
