"""Tide series: turning points, shifted sampling, day range, harmonic fit."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import circular as C
from ..functions import timefn as T
from ..functions import units as U
from ..session import materialise
from .ordered import WEEK, as_of, epoch, nearest, neighbours, running_sum

# Constituent speeds in degrees per mean solar hour.
CONSTITUENTS = {
    "M2": 28.9841042, "S2": 30.0, "N2": 28.4397295, "K2": 30.0821373,
    "K1": 15.0410686, "O1": 13.9430356, "P1": 14.9589314, "Q1": 13.3986609,
    "M4": 57.9682084, "MS4": 58.9841042, "MN4": 57.4238337,
    "MF": 1.0980331, "MM": 0.5443747, "SSA": 0.0821373, "SA": 0.0410686}
# Fixed value: phase reference, 2000-01-01 00:00, as epoch seconds.
PHASE_EPOCH_S = 946684800
MIN_FIT_SAMPLES = 24 * 400
MIN_OFFSET_SAMPLES = 24


def mark_turns(series: DataFrame, keys: list[str], ts: str, v: str, width: float = WEEK) -> DataFrame:
    """Every row with its ``type``: H or L where it turns against both neighbours, else null; three equal values are no turn."""
    n = neighbours(series, keys, epoch(F.col(ts)), [v], width)
    a, b, c = F.col(f"prev_{v}"), F.col(v), F.col(f"next_{v}")
    flat = (a == b) & (b == c)
    kind = F.when((b >= a) & (b >= c) & ~flat, "H").when((b <= a) & (b <= c) & ~flat, "L")
    return n.withColumn("type", kind)


def turning_points(series: DataFrame, keys: list[str], ts: str, v: str, width: float = WEEK) -> DataFrame:
    """The highs and lows alone."""
    return mark_turns(series, keys, ts, v, width).filter(F.col("type").isNotNull())


def refine_turns(turns: DataFrame, ts: str, v: str) -> DataFrame:
    """Vertex of the parabola through the turn and its neighbours: turn_ts, turn_v."""
    a, b, c = F.col(f"prev_{v}"), F.col(v), F.col(f"next_{v}")
    denom = a - b * 2.0 + c
    flat = F.abs(denom) < 1e-9
    off = F.when(flat, F.lit(0.0)).otherwise(
        F.greatest(F.lit(-0.5), F.least(F.lit(0.5), F.lit(0.5) * (a - c) / denom)))
    minutes = F.rint(off * 60).cast("long")
    return turns.withColumns({
        "turn_ts": F.timestamp_micros(F.unix_micros(ts) + minutes * 60_000_000),
        "turn_v": F.when(flat, b).otherwise(b - F.lit(0.25) * (a - c) * off)})


def collapse_turns(turns: DataFrame, keys: list[str], ts: str, v: str, within_hours: float = 3,
                   width: float = 4 * WEEK) -> DataFrame:
    """One turn per plateau: same kind within three samples forms one island.

    The most extreme turn of the island stays, the earliest of equals.
    """
    o = epoch(F.col(ts))
    n = neighbours(turns, keys, o, [ts, "type"], width, after=False)
    joined = (F.col("prev_type") == F.col("type")) & (
        T.hours_between(F.col(ts), F.col(f"prev_{ts}")) <= within_hours)
    n = n.withColumn("_new", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1))
    n = running_sum(n, keys, o, F.col("_new"), width, "_island")
    high = F.when(F.col("type") == "H", F.col(v)).otherwise(-F.col(v))
    keep = [c for c in turns.columns if c not in keys]
    best = F.max_by(F.struct(*keep), F.struct(high.alias("v"), (-F.unix_micros(ts)).alias("t")))
    return (n.groupBy(*keys, "_island").agg(best.alias("_b"))
            .select(*keys, *[F.col(f"_b.{c}").alias(c) for c in keep]))


def sample_shifted(series: DataFrame, keys: list[str], ts: str, v: str, offset_minutes: Column,
                   width: float = WEEK) -> DataFrame:
    """Value of each series at (its own time - offset), held flat past both ends."""
    want = series.withColumn("_at", F.timestamp_micros(
        F.unix_micros(ts) - (offset_minutes * 60_000_000).cast("long")))
    m = as_of(want, series, keys, "_at", ts, [v], width)
    t0, t1 = epoch(F.col("before.at")), epoch(F.col("after.at"))
    f = (epoch(F.col("_at")) - t0) / (t1 - t0)
    b, a = F.col(f"before.{v}"), F.col(f"after.{v}")
    val = F.when(b.isNull(), a).when(a.isNull(), b).otherwise(b + f * (a - b))
    return m.withColumn(f"shifted_{v}", val).select(*series.columns, f"shifted_{v}")


def day_percent(series: DataFrame, keys: list[str], ts: str, v: str, min_range: float = 0.01) -> DataFrame:
    """Share of the day's range, 50 on a flat day. A day holds at most a day of samples."""
    d = series.withColumn("_day", F.date_trunc("day", ts))
    w = Window.partitionBy(*keys, "_day")
    lo, hi = F.min(v).over(w), F.max(v).over(w)
    pct = F.when(hi - lo > min_range, F.rint((F.col(v) - lo) / (hi - lo) * 100)).otherwise(F.lit(50.0))
    return d.withColumns({"day_low": lo, "day_high": hi, "pct": pct.cast("int")}).drop("_day")


def tide_state(v: Column, lo: Column, hi: Column) -> Column:
    """Third of the day's own range; null on a flat or unknown day."""
    p = (v - lo) / (hi - lo)
    return F.when((hi > lo) & v.isNotNull(), F.when(p < 0.33, "low").when(p < 0.67, "mid").otherwise("high"))


def stamp_events(slots: DataFrame, events: DataFrame, keys: list[str], slot_ts: str, event_ts: str) -> DataFrame:
    """Each high/low event with its hourly slot, nearest and under 31 minutes away."""
    s = slots.select(*keys, slot_ts)
    m = nearest(events, s.withColumn("slot", F.col(slot_ts)), keys, event_ts, slot_ts, ["slot"],
                31 * 60, inclusive=False)
    return m.withColumn("label", T.clock_label(F.col(event_ts)))


def series_range(series: DataFrame, keys: list[str], v: str) -> DataFrame:
    return series.groupBy(*keys).agg(F.round(F.max(v) - F.min(v), 2).alias("range"))


def _basis(hours: Column, constituents: dict[str, float]) -> list[Column]:
    """1, cos and sin of each constituent at a time in hours from the phase epoch."""
    out = [F.lit(1.0)]
    for speed in constituents.values():
        # Reduced to one turn in degrees first, so large times lose no digits.
        turn = F.radians(F.pmod(hours * F.lit(speed), F.lit(360.0)))
        out += [F.cos(turn), F.sin(turn)]
    return out


def phase_hours(ts: Column) -> Column:
    return (epoch(ts) - F.lit(float(PHASE_EPOCH_S))) / 3600.0


FAN = 64
_ROWS = 4096


def _factor(blocks: list[np.ndarray]) -> np.ndarray:
    """Upper triangle R with R'R equal to the sum of the blocks' own products, without forming any square."""
    return np.linalg.qr(np.concatenate(blocks), mode="r")


def fit_harmonics(series: DataFrame, keys: list[str], ts: str, v: str,
                  constituents: dict[str, float] | None = None, min_samples: int = MIN_FIT_SAMPLES) -> DataFrame:
    """Least-squares constituents: (keys, n, rms, term, a, b).

    Each task reduces its rows of a series (basis and value side by side) to one triangular factor of fixed size; factors of ``FAN``
    tasks meet in one, level by level, until a series has one, and its triangle is solved. Nothing is squared, so terms that are hard to
    tell apart keep their digits. What is shuffled is one small factor per series and task, so a series with a third of all rows is
    spread like any other. Series under ``min_samples`` are refused. The mean is the term ``Z0``.
    """
    cons = dict(constituents or CONSTITUENTS)
    names, speeds = ["Z0", *cons], np.array(list(cons.values()))
    p = 1 + 2 * len(cons)
    good = series.filter(F.col(v).isNotNull())
    d = good.select(F.struct(*keys).alias("_key") if keys else F.struct(F.lit(0).alias("_")).alias("_key"), phase_hours(F.col(ts)).alias("_h"), F.col(v).cast("double").alias("_y"))
    kind = d.schema["_key"].dataType.simpleString()
    key_type = pa.struct([(f.name, to_arrow_type(f.dataType)) for f in d.schema["_key"].dataType.fields])
    factors = f"_key {kind}, _at long, n long, r array<double>"

    def rows_of(hours: np.ndarray, y: np.ndarray) -> np.ndarray:
        turn = np.radians(np.mod(hours[:, None] * speeds, 360.0))
        x = np.empty((len(hours), p + 1))
        x[:, 0], x[:, 1:p:2], x[:, 2:p:2], x[:, p] = 1.0, np.cos(turn), np.sin(turn), y
        return x

    def reduce_rows(batches):
        from pyspark import TaskContext

        held: dict = {}  # series: (rows, factor)
        for b in batches:
            key, hours, y = b.column(0), b.column(1).to_numpy(), b.column(2).to_numpy()
            code = pa.array([str(k) for k in key.to_pylist()]).dictionary_encode()
            order = np.argsort(code.indices.to_numpy(), kind="stable")
            cuts = np.flatnonzero(np.diff(code.indices.to_numpy()[order])) + 1
            for part in np.split(order, cuts):
                if not len(part):
                    continue
                name = code.dictionary[code.indices[int(part[0])].as_py()].as_py()
                first, n, r = held.get(name, (key[int(part[0])].as_py(), 0, np.zeros((0, p + 1))))
                for a in range(0, len(part), _ROWS):
                    some = part[a : a + _ROWS]
                    r = _factor([r, rows_of(hours[some], y[some])])
                held[name] = (first, n + len(part), r)
        at = TaskContext.get().partitionId()
        yield _factor_rows(list(held.values()), at)

    def _factor_rows(found: list, at: int):
        return pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in found], key_type), pa.array([at] * len(found), pa.int64()), pa.array([n for _, n, _ in found], pa.int64()),
                                           pa.array([r.ravel().tolist() for _, _, r in found], pa.list_(pa.float64()))], names=["_key", "_at", "n", "r"])

    def merge(table):
        r = _factor([np.array(x).reshape(-1, p + 1) for x in table["r"].to_pylist()])
        return _factor_table(table["_key"][0].as_py(), table["_at"][0].as_py() // FAN, sum(table["n"].to_pylist()), r)

    def _factor_table(key, at, n, r):
        return pa.Table.from_batches([_factor_rows([(key, n, r)], at)])

    level = materialise(d.mapInArrow(reduce_rows, factors), "factors")
    tasks = (level.agg(F.max("_at")).first()[0] or 0) + 1
    while True:
        tasks = -(-tasks // FAN)
        level = level.groupBy("_key", F.floor(F.col("_at") / FAN)).applyInArrow(lambda table: merge(table), factors)
        if tasks <= 1:
            break
    head = "".join(f"`{k}` {series.schema[k].dataType.simpleString()}, " for k in keys)

    def solve(batches):
        for pdf in batches:
            out = []
            for key, n, flat in zip(pdf["_key"], pdf["n"], pdf["r"]):
                r = np.zeros((p + 1, p + 1))
                got = np.asarray(flat, float).reshape(-1, p + 1)
                r[: len(got)] = got
                coef = np.linalg.lstsq(r[:p, :p], r[:p, p], rcond=None)[0]
                left = np.append(r[:p, p] - r[:p, :p] @ coef, r[p, p])
                base = [*([key[k] for k in keys]), int(n), math.sqrt(float(left @ left) / n)]
                out.append([*base, "Z0", float(coef[0]), 0.0])
                out += [[*base, name, float(coef[1 + 2 * i]), float(coef[2 + 2 * i])] for i, name in enumerate(names[1:])]
            yield pd.DataFrame(out, columns=[*keys, "n", "rms", "term", "a", "b"])

    return level.filter(F.col("n") >= min_samples).select("_key", "n", "r").mapInPandas(solve, f"{head}n long, rms double, term string, a double, b double")


def coefficient_arrays(fit: DataFrame, keys: list[str]) -> DataFrame:
    """Terms of one station as one row: an array of at most 16 structs."""
    return fit.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("term", "a", "b"))).alias("terms"))


def predict_harmonics(times: DataFrame, fit: DataFrame, keys: list[str], ts: str,
                      constituents: dict[str, float] | None = None, out: str = "pred") -> DataFrame:
    """Prediction at each time from the station's terms; no row is multiplied."""
    cons = dict(constituents or CONSTITUENTS)
    speeds = F.create_map(*[x for k, s in {"Z0": 0.0, **cons}.items() for x in (F.lit(k), F.lit(s))])
    h = phase_hours(F.col(ts))

    def add(acc: Column, t: Column) -> Column:
        w = F.radians(F.pmod(h * F.element_at(speeds, t["term"]), F.lit(360.0)))
        return acc + t["a"] * F.cos(w) + t["b"] * F.sin(w)

    return (times.join(coefficient_arrays(fit, keys), keys)
            .withColumn(out, F.aggregate("terms", F.lit(0.0), add)).drop("terms"))


def datum_offset(pred: DataFrame, live: DataFrame, keys: list[str], ts: str, pred_v: str, live_v: str,
                 min_samples: int = MIN_OFFSET_SAMPLES) -> DataFrame:
    """Mean of prediction minus live over their overlap; 0 where fewer than ``min_samples`` (a day) overlap."""
    j = live.filter(F.col(live_v).isNotNull()).join(pred, [*keys, ts], "left")
    n = F.count(F.col(pred_v))
    off = F.when(n >= min_samples, F.avg(F.col(pred_v) - F.col(live_v))).otherwise(F.lit(0.0))
    return j.groupBy(*keys).agg(n.alias("overlap"), off.alias("offset"))


def fill_gaps(series: DataFrame, predicted: DataFrame, keys: list[str], ts: str, v: str, pred_v: str) -> DataFrame:
    """Missing values from a predicted series; ``modelled`` marks the filled rows."""
    j = series.join(predicted.select(*keys, ts, pred_v), [*keys, ts], "left")
    fill = F.col(v).isNull() & F.col(pred_v).isNotNull()
    return j.select(*[c for c in series.columns if c != v], F.coalesce(v, pred_v).alias(v), fill.alias("modelled"))
