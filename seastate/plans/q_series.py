"""Time-series, alignment, tide, wind and outlook queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import timefn as T
from ..functions import units as U
from ..operators import outlook as O
from ..operators import pairing as P
from ..operators import tides as Td
from ..operators import waves as Wv
from ..operators import wind as Wd
from ..operators.ordered import DAY, HOUR, WEEK, as_of, epoch, latest_by, nearest, neighbours
from .ctes import (box_sql, cdiff, cosd, epoch as esql, haversine, iso, m360, r6, rint, sc2deg, sec, curve_sql, ladder_sql, sind, snap,
                   wind_sql)
from .registry import query

NEAR_S = 1800.0


@query("j03_nearest_match", f"""
WITH l AS (SELECT station, valid_utc, hs_m FROM obs WHERE partition = 0), r AS (SELECT station, valid_utc AS att, max(tp_s) AS tp_s FROM obs WHERE partition = 1 GROUP BY 1, 2)
SELECT station, {iso('valid_utc')} AS valid_utc, {r6('hs_m')} AS hs_m, {iso('att')} AS match_at, tp_s FROM (
 SELECT l.*, r.att, r.tp_s, row_number() OVER (PARTITION BY l.station, l.valid_utc ORDER BY abs(epoch_us(r.att) - epoch_us(l.valid_utc)), r.att) AS rn
 FROM l LEFT JOIN r ON r.station = l.station AND r.att BETWEEN l.valid_utc - INTERVAL 30 MINUTES AND l.valid_utc + INTERVAL 30 MINUTES) WHERE rn = 1""")
def _(v):
    """Each combined reading with the nearest primary reading within half an hour."""
    l = v.obs.filter(F.col("partition") == 0).select("station", "valid_utc", "hs_m")
    r = v.obs.filter(F.col("partition") == 1).select("station", F.col("valid_utc").alias("at"), "tp_s")
    return nearest(l, r, ["station"], "valid_utc", "at", ["tp_s"], NEAR_S)


@query("j07_stamp_events", f"""
WITH e AS (SELECT station, ts AS event_ts, event_id FROM ev WHERE event_type = 'purchase')
SELECT event_id, {iso('t')} AS slot, lower(strftime(event_ts, '%-I:%M%p')) AS label FROM (
 SELECT e.*, s.t, row_number() OVER (PARTITION BY event_id ORDER BY abs(epoch_us(s.t) - epoch_us(event_ts)), s.t) AS rn
 FROM e LEFT JOIN ser s ON s.station = e.station AND abs(epoch_us(s.t) - epoch_us(event_ts)) < 31 * 60000000) WHERE rn = 1""")
def _(v):
    e = v.events.filter(F.col("event_type") == "purchase").select("station", F.col("ts").alias("event_ts"), "event_id")
    return Td.stamp_events(v.series, e, ["station"], "t", "event_ts").select("event_id", "slot", "label")


@query("w05_turning_points", f"SELECT station, {iso('t')} AS t, {r6('v')} AS v, type FROM turns")
def _(v):
    return Td.turning_points(v.series, ["station"], "t", "v").select("station", "t", "v", "type")


_OFF = "greatest(-0.5, least(0.5, 0.5 * (pv - nv) / (pv - v * 2.0 + nv)))"


@query("w06_refined_turns", f"""
SELECT station, {iso('t')} AS t, type, {iso(f"t + to_minutes(CAST({rint(_OFF + ' * 60')} AS BIGINT))")} AS turn_ts, {r6(f'v - 0.25 * (pv - nv) * {_OFF}')} AS turn_v FROM turns""")
def _(v):
    return Td.refine_turns(Td.turning_points(v.series, ["station"], "t", "v"), "t", "v").select("station", "t", "type", "turn_ts", "turn_v")


_ISL = """WITH f AS (SELECT *, CASE WHEN lag(type) OVER w = type AND epoch(t) - epoch(lag(t) OVER w) <= 10800 THEN 0 ELSE 1 END AS fresh FROM turns
 WINDOW w AS (PARTITION BY station ORDER BY t)), g AS (SELECT *, sum(fresh) OVER (PARTITION BY station ORDER BY t) AS island FROM f),
 h AS (SELECT *, row_number() OVER (PARTITION BY station, island ORDER BY CASE WHEN type = 'H' THEN v ELSE -v END DESC, t) AS rn FROM g)"""


@query("w07_collapsed_turns", f"{_ISL} SELECT station, {iso('t')} AS t, type, {r6('v')} AS v FROM h WHERE rn = 1")
def _(v):
    return Td.collapse_turns(Td.turning_points(v.series, ["station"], "t", "v"), ["station"], "t", "v").select("station", "t", "type", "v")


@query("w10_f06_densify", f"""
WITH x AS (SELECT station, valid_utc AS t, max(hs_m) AS h, max(dp_deg) AS d FROM (SELECT station, {snap('ts')} AS valid_utc, value * 0.061803398875 AS hs_m,
 CASE WHEN k % 5 <> 0 THEN ((k * 37 + user_id * 11) % 360) * 0.9137::DOUBLE END AS dp_deg FROM ev WHERE event_type = 'error') GROUP BY 1, 2),
 n AS (SELECT *, lead(t) OVER w AS nt, lead(h) OVER w AS nh, lead(d) OVER w AS nd FROM x WINDOW w AS (PARTITION BY station ORDER BY t)),
 e AS (SELECT *, coalesce(CAST((epoch(nt) - epoch(t)) / 3600 AS INTEGER), 1) AS gap FROM n), u AS (SELECT *, unnest(range(gap)) AS k FROM e)
SELECT station, {iso('t + to_hours(k)')} AS t, {r6('CASE WHEN k = 0 THEN h ELSE h * (1.0 - k / gap::DOUBLE) + nh * (k / gap::DOUBLE) END')} AS h,
 {r6("CASE WHEN k = 0 THEN d WHEN d IS NULL THEN nd WHEN nd IS NULL THEN d ELSE " + sc2deg(f"(1.0 - k / gap::DOUBLE) * {sind('d')} + (k / gap::DOUBLE) * {sind('nd')}", f"(1.0 - k / gap::DOUBLE) * {cosd('d')} + (k / gap::DOUBLE) * {cosd('nd')}") + " END")} AS d,
 k > 0 AS interpolated FROM u""")
def _(v):
    """Sparse readings of one kind on an hourly grid, gaps filled by blending."""
    # Scaled bearings are never exactly opposite, so every blend has a direction.
    k = F.col("k")
    x = v.events.filter(F.col("event_type") == "error").select(
        "station", T.snap_hour(F.col("ts")).alias("t"), (F.col("value") * 0.061803398875).alias("h"),
        F.when(k % 5 != 0, ((k * 37 + F.col("user_id") * 11) % 360) * 0.9137).alias("d"))
    x = x.groupBy("station", "t").agg(F.max("h").alias("h"), F.max("d").alias("d"))
    return Wv.densify_hourly(x, ["station"], "t", ["h"], ["d"])


_SHIFT = f"""sh AS (SELECT s.station, s.t, s.v, s.t - INTERVAL 23 MINUTES AS att FROM ser s),
 lo AS (SELECT sh.*, b.t AS t0, b.v AS v0 FROM sh ASOF LEFT JOIN ser b ON sh.station = b.station AND sh.att >= b.t),
 hi AS (SELECT lo.*, a.t AS t1, a.v AS v1 FROM lo ASOF LEFT JOIN ser a ON lo.station = a.station AND lo.att < a.t),
 shifted AS (SELECT station, t, v, CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL THEN v0 ELSE v0 + (epoch(att) - epoch(t0)) / (epoch(t1) - epoch(t0)) * (v1 - v0) END AS sv FROM hi)"""


@query("w11_shifted_sample", f"WITH {_SHIFT} SELECT station, {iso('t')} AS t, {r6('sv')} AS shifted_v FROM shifted")
def _(v):
    return Td.sample_shifted(v.series, ["station"], "t", "v", F.lit(23.0)).select("station", "t", "shifted_v")


@query("a14_day_percent", f"""
WITH d AS (SELECT *, min(v) OVER w AS lo, max(v) OVER w AS hi FROM ser WINDOW w AS (PARTITION BY station, date_trunc('day', t)))
SELECT station, {iso('t')} AS t, {r6('lo')} AS day_low, {r6('hi')} AS day_high, CAST(CASE WHEN hi - lo > 0.01 THEN {rint('(v - lo) / (hi - lo) * 100')} ELSE 50 END AS INTEGER) AS pct FROM d""")
def _(v):
    return Td.day_percent(v.series, ["station"], "t", "v").select("station", "t", "day_low", "day_high", "pct")


_STATE = "CASE WHEN hi > lo THEN CASE WHEN (v - lo) / (hi - lo) < 0.33 THEN 'low' WHEN (v - lo) / (hi - lo) < 0.67 THEN 'mid' ELSE 'high' END END"


@query("a15_tide_state", f"""
WITH d AS (SELECT *, min(v) OVER w AS lo, max(v) OVER w AS hi FROM ser WINDOW w AS (PARTITION BY station, date_trunc('day', t)))
SELECT station, {iso('t')} AS t, {_STATE} AS state FROM d""")
def _(v):
    d = Td.day_percent(v.series, ["station"], "t", "v")
    return d.select("station", "t", Td.tide_state(F.col("v"), F.col("day_low"), F.col("day_high")).alias("state"))


@query("a19_series_range", f"SELECT station, {r6('round(max(v) - min(v), 2)')} AS range FROM ser GROUP BY station")
def _(v):
    return Td.series_range(v.series, ["station"], "v")


# The test series span a month; fitting takes about two years. So the hours are spread: each becomes eleven, by a factor in time.
_STRETCH = 11


def long_series(v):
    """Every reading at eleven times its distance from the series' epoch, so that all constituents can be told apart."""
    start = F.lit("2024-01-01").cast("timestamp")
    t = F.timestamp_seconds(F.unix_timestamp(start) + (F.unix_timestamp("t") - F.unix_timestamp(start)) * _STRETCH)
    return v.series.select("station", t.alias("t"), "v")


_LONG = f"(SELECT station, TIMESTAMP '2024-01-01' + to_seconds(CAST((epoch(t) - epoch(TIMESTAMP '2024-01-01')) * {_STRETCH} AS BIGINT)) AS t, v FROM ser)"


def fitted_tide(v):
    return Td.fit_harmonics(long_series(v), ["station"], "t", "v", min_samples=MIN_TIDE)


MIN_TIDE = 120


@query("a17_fit_harmonics", f"""
SELECT station, count(v) AS n, {len(Td.CONSTITUENTS) + 1}::BIGINT AS terms, 0.0::DOUBLE AS worst FROM ser GROUP BY station HAVING count(v) >= {MIN_TIDE}""")
def _(v):
    """All constituents fitted; a least-squares fit leaves residuals that are orthogonal to every term of its basis."""
    fit = fitted_tide(v)
    p = Td.predict_harmonics(long_series(v).filter(F.col("v").isNotNull()), fit, ["station"], "t")
    left = p.select("station", (F.col("v") - F.col("pred")).alias("r"), F.array(*Td._basis(Td.phase_hours(F.col("t")), Td.CONSTITUENTS)).alias("x"))
    n = 1 + 2 * len(Td.CONSTITUENTS)
    sums = left.groupBy("station").agg(F.count("*").alias("n"), F.array(*[F.abs(F.sum(F.col("r") * F.get("x", F.lit(i)))) for i in range(n)]).alias("s"))
    terms = fit.groupBy("station").agg(F.count("*").alias("terms"))
    return sums.join(terms, "station").select("station", "n", "terms", F.round(F.array_max("s") / F.col("n"), 6).alias("worst"))


@query("a17_fit_long_series", f"SELECT 'all' AS station, count(*) AS n, {len(Td.CONSTITUENTS) + 1}::BIGINT AS terms, 0.0::DOUBLE AS worst FROM ev HAVING count(*) >= {Td.MIN_FIT_SAMPLES}")
def _(v):
    """All events as one series under the full limit of 9,600 samples: one key holds every row, and no task holds more than its share."""
    start = F.lit("2024-01-01").cast("timestamp")
    far = F.timestamp_micros(F.unix_micros(start) + (F.unix_micros("ts") - F.unix_micros(start)) * _STRETCH)
    d = v.events.select(F.lit("all").alias("station"), far.alias("t"), (F.col("value") * 0.0618).alias("v"))
    fit = Td.fit_harmonics(d, ["station"], "t", "v")
    left = Td.predict_harmonics(d, fit, ["station"], "t").select("station", (F.col("v") - F.col("pred")).alias("r"), *[c.alias(f"x{i}") for i, c in enumerate(Td._basis(Td.phase_hours(F.col("t")), Td.CONSTITUENTS))])
    n = 1 + 2 * len(Td.CONSTITUENTS)
    sums = left.groupBy("station").agg(F.count("*").alias("n"), F.greatest(*[F.abs(F.sum(F.col("r") * F.col(f"x{i}"))) for i in range(n)]).alias("s"))
    return sums.join(fit.groupBy("station").agg(F.count("*").alias("terms")), "station").select("station", "n", "terms", F.round(F.col("s") / F.col("n"), 6).alias("worst"))


#: Fixed coefficients of a made-up tide, one pair per constituent, for the prediction alone.
_COEF = [("Z0", 0.4, 0.0)] + [(n, round(0.9 / (i + 1), 4), round(0.35 - 0.07 * i, 4)) for i, n in enumerate(Td.CONSTITUENTS)]


def _predict_sql(t: str) -> str:
    h = f"((epoch({t}) - {float(Td.PHASE_EPOCH_S)}::DOUBLE) / 3600.0::DOUBLE)"
    w = lambda s: f"radians(fmod({h} * {s}::DOUBLE, 360.0::DOUBLE))"
    return f"{_COEF[0][1]}::DOUBLE + " + " + ".join(
        f"{a}::DOUBLE * cos({w(Td.CONSTITUENTS[n])}) + {b}::DOUBLE * sin({w(Td.CONSTITUENTS[n])})" for n, a, b in _COEF[1:])


@query("f25_predict_harmonics", f"SELECT station, {iso('t')} AS t, {r6(_predict_sql('t'))} AS pred FROM {_LONG}")
def _(v):
    """The same coefficients for every station, all constituents."""
    terms = F.array(*[F.struct(F.lit(n).alias("term"), F.lit(a).alias("a"), F.lit(b).alias("b")) for n, a, b in _COEF])
    fit = v.series.select("station").distinct().select("station", F.explode(terms).alias("x")).select("station", "x.*")
    return Td.predict_harmonics(long_series(v).select("station", "t"), fit, ["station"], "t").select("station", "t", "pred")


@query("a18_datum_offset", f"""
SELECT station, count(*) AS overlap, {r6(f"CASE WHEN count(*) >= {Td.MIN_OFFSET_SAMPLES} THEN avg(({_predict_sql('t')}) - v) ELSE 0 END")} AS offset FROM {_LONG} WHERE v IS NOT NULL GROUP BY station""")
def _(v):
    """A prediction from fixed coefficients against the live series: its offset is not zero by construction."""
    terms = F.array(*[F.struct(F.lit(n).alias("term"), F.lit(a).alias("a"), F.lit(b).alias("b")) for n, a, b in _COEF])
    fit = v.series.select("station").distinct().select("station", F.explode(terms).alias("x")).select("station", "x.*")
    s = long_series(v)
    p = Td.predict_harmonics(s.select("station", "t").distinct(), fit, ["station"], "t")
    return Td.datum_offset(p, s, ["station"], "t", "pred", "v")


def _b_hours(v):
    """Per station and hour, model B's latest combined height: a second series to fill from."""
    return Wv.latest_cycle(v.b, ["station"], "valid_utc", "cycle_utc", ["combined_height_m"]).select(
        "station", F.col("valid_utc").alias("t"), F.col("combined_height_m").alias("pred"))


_LB = "(SELECT station, valid_utc AS t, combined_height_m AS pred FROM (SELECT *, row_number() OVER (PARTITION BY station, valid_utc ORDER BY cycle_utc DESC) AS rn FROM fb WHERE lead_hours >= 0) WHERE rn = 1)"


@query("j12_fill_gaps", f"""
SELECT s.station, {iso('s.t')} AS t, {r6('coalesce(CASE WHEN v >= 1 THEN v END, pred)')} AS v, (v < 1 AND pred IS NOT NULL) AS modelled
FROM ser s LEFT JOIN {_LB} p ON p.station = s.station AND p.t = s.t""")
def _(v):
    holed = v.series.withColumn("v", F.when(F.col("v") >= 1, F.col("v")))
    return Td.fill_gaps(holed, _b_hours(v), ["station"], "t", "v", "pred").select("station", "t", "v", "modelled")


@query("p10_date_slice", f"SELECT station, {iso('t')} AS t, {r6('v')} AS v FROM ser WHERE CAST(t AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'")
def _(v):
    return v.series.filter(F.to_date("t").between("2024-01-05", "2024-01-12"))


# ── merged timeline and what is built on it ────────────────────────────────

_LATEST = ("(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY station, model, valid_utc ORDER BY cycle_utc DESC) AS rn FROM fc "
           "WHERE lead_hours >= 0) WHERE rn = 1)")
_HOURS = ("(SELECT station, valid_utc AS hour_utc FROM fc WHERE lead_hours >= 0 UNION SELECT station, t FROM ser UNION SELECT station, hour_utc FROM obsh WHERE partition = 0)")
_TL = (f"tl AS (SELECT h.station, h.hour_utc, a.sw1_height_ft AS a_h, a.sw1_period_s AS a_p, a.sw1_direction_deg AS a_d, b.sw1_height_ft AS b_h, b.sw1_period_s AS b_p, "
       f"b.sw1_direction_deg AS b_d, w.spd AS wind_kt, w.deg AS wind_deg, s.v AS tide, x.type AS hilo FROM {_HOURS} h "
       f"LEFT JOIN (SELECT * FROM {_LATEST} WHERE model = 'A') a ON a.station = h.station AND a.valid_utc = h.hour_utc "
       f"LEFT JOIN (SELECT * FROM {_LATEST} WHERE model = 'B') b ON b.station = h.station AND b.valid_utc = h.hour_utc "
       "LEFT JOIN (SELECT station, hour_utc, max(hs_m) * 3 AS spd, max(dp_deg) AS deg FROM obsh WHERE partition = 0 GROUP BY 1, 2) w ON w.station = h.station AND w.hour_utc = h.hour_utc "
       "LEFT JOIN ser s ON s.station = h.station AND s.t = h.hour_utc LEFT JOIN turns x ON x.station = h.station AND x.t = h.hour_utc), "
       "tls AS (SELECT *, min(tide) OVER w AS lo, max(tide) OVER w AS hi FROM tl WINDOW w AS (PARTITION BY station, date_trunc('day', hour_utc)))")


def timeline(v):
    """Both models' latest cycle, wind, tide and turns on one hourly line per station: forecasts, readings and series are each read once."""
    names = {m: {"sw1_height_ft": f"{m.lower()}_h", "sw1_period_s": f"{m.lower()}_p", "sw1_direction_deg": f"{m.lower()}_d"} for m in ("A", "B")}
    tide = Td.mark_turns(v.series, ["station"], "t", "v")
    parts = {
        "models": Wv.latest_cycles(v.forecast, ["station"], "valid_utc", "cycle_utc", names).withColumnRenamed("valid_utc", "hour_utc"),
        "wind": (v.obs.filter(F.col("partition") == 0).groupBy("station", T.snap_hour(F.col("valid_utc")).alias("hour_utc"))
                 .agg((F.max("hs_m") * 3).alias("wind_kt"), F.max("dp_deg").alias("wind_deg"))),
        "tide": tide.select("station", F.col("t").alias("hour_utc"), F.col("v").alias("tide"), F.col("type").alias("hilo"))}
    return O.merge_hourly(parts, ["station", "hour_utc"])


@query("j09_merge_timeline", f"WITH {_TL} SELECT station, {iso('hour_utc')} AS hour_utc, " + ", ".join(
    f"{r6(c)} AS {c}" for c in ("a_h", "a_p", "a_d", "b_h", "b_p", "b_d", "wind_kt", "wind_deg", "tide")) + ", hilo FROM tl")
def _(v):
    return timeline(v)


def with_state(v):
    d = Td.day_percent(timeline(v), ["station"], "hour_utc", "tide")
    return d.withColumn("tide_state", Td.tide_state(F.col("tide"), F.col("day_low"), F.col("day_high")))


def _section_sql(m: str) -> str:
    """Score of each section written out for one model, as a list of structs."""
    out = []
    h, p, d = f"(CASE WHEN {m}_h <> 0 THEN {m}_h END)", f"{m}_p", f"{m}_d"
    st = f"(CASE WHEN hi > lo THEN CASE WHEN (tide - lo) / (hi - lo) < 0.33 THEN 'low' WHEN (tide - lo) / (hi - lo) < 0.67 THEN 'mid' WHEN tide IS NOT NULL THEN 'high' END END)"
    rule = O.load_break()
    for i, s in enumerate(rule.sections):
        wind = ladder_sql("wind_kt", "wind_deg", str(s.offshore))
        fit = {"angle": f"coalesce({curve_sql(f'abs({cdiff(d, s.facing)})', s.off_axis)}, 0.5)", "period": f"coalesce({curve_sql(p, s.period)}, 0.5)",
               "tide": "coalesce(CASE " + st + " " + " ".join(f"WHEN '{k}' THEN {x}" for k, x in s.tide.items()) + " END, 1.0)::DOUBLE",
               "wind": "coalesce(CASE " + wind + " " + " ".join(f"WHEN '{w.name}' THEN {w.fit}" for w in rule.ladder) + " END, 0.5)::DOUBLE"}
        mix = "(" + " + ".join(f"{fit[k]} * {rule.weights[k]}::DOUBLE" for k in ("angle", "period", "tide", "wind")) + ")"
        size = f"coalesce({curve_sql(h, s.size)}, 0.0)"
        most = f"coalesce(CASE WHEN {h} IS NULL THEN 0.0 ELSE least(1.0::DOUBLE, {curve_sql(h, rule.potential['face'])} * coalesce({curve_sql(p, rule.potential['period'])}, 1.0)) END, 0.0)"
        score = f"{mix} * {size} * {most} * {100.0 * s.standing!r}::DOUBLE"
        out.append(f"SELECT station, hour_utc, '{m}' AS model, '{s.key}' AS section, {i} AS pos, CAST({rint(score)} AS INTEGER) AS score, "
                   f"CAST({rint(f'{mix} * 100.0::DOUBLE')} AS INTEGER) AS raw_score, {wind} AS wind FROM tls")
    return " UNION ALL ".join(out)


_SCORES = f"WITH {_TL}, sc AS ({_section_sql('a')} UNION ALL {_section_sql('b')}), rk AS (SELECT *, row_number() OVER (PARTITION BY station, hour_utc, model ORDER BY score DESC, pos) AS rank FROM sc)"


def ranked(v):
    d, rule = with_state(v), O.load_break()
    for m in ("a", "b"):
        d = O.rank_sections(d, rule, f"{m}_h", f"{m}_p", f"{m}_d", "wind_kt", "wind_deg", "tide_state", f"{m}_ranked")
    return d


@query("f18_w12_rank_sections", f"{_SCORES} SELECT station, {iso('hour_utc')} AS hour_utc, model, section, rank::INTEGER AS rank, score, raw_score, wind FROM rk")
def _(v):
    d = ranked(v).select("station", "hour_utc", F.explode(F.array(
        *[F.struct(F.lit(m).alias("model"), F.col(f"{m}_ranked").alias("r")) for m in ("a", "b")])).alias("x"))
    d = d.select("station", "hour_utc", "x.model", F.posexplode("x.r").alias("i", "s"))
    return d.select("station", "hour_utc", "model", "s.section", (F.col("i") + 1).alias("rank"), "s.score", "s.raw_score", "s.wind")


@query("o03_best_section", f"""{_SCORES}
SELECT station, {iso('hour_utc')} AS hour_utc, max(CASE WHEN model = 'a' THEN section END) AS best_a, max(CASE WHEN model = 'b' THEN section END) AS best_b
FROM rk WHERE rank = 1 GROUP BY 1, 2""")
def _(v):
    return ranked(v).select("station", "hour_utc", O.best_section("a_ranked").alias("best_a"), O.best_section("b_ranked").alias("best_b"))


_STRIDE = f"""WITH {_TL}, base AS (SELECT station AS st, hour(min(hour_utc)) AS h0 FROM tl GROUP BY 1),
 samp AS (SELECT tl.* FROM tl JOIN base ON st = station WHERE ((hour(hour_utc) - h0) % 3 + 3) % 3 = 0)"""


def sampled(v):
    return O.stride_from_first(timeline(v), ["station"], "hour_utc")


@query("p11_stride", f"{_STRIDE} SELECT station, {iso('hour_utc')} AS hour_utc FROM samp")
def _(v):
    return sampled(v).select("station", "hour_utc")


# A sun table for the even days; the odd days use the fixed window.
_SUN = "(SELECT DISTINCT station AS s, CAST(t AS DATE) AS d, 5 + day(t) % 3 AS up, 17 + day(t) % 3 AS down FROM ser WHERE day(t) % 2 = 0)"


def sun(v):
    day = F.dayofmonth("t")
    return (v.series.filter(day % 2 == 0).select("station", F.to_date("t").alias("date"), (5 + day % 3).alias("sunrise_hour"),
                                                 (17 + day % 3).alias("sunset_hour")).distinct())


_LIT = _STRIDE + f", lit AS (SELECT samp.* FROM samp LEFT JOIN {_SUN} ON s = station AND d = CAST(hour_utc AS DATE) WHERE hour(hour_utc) >= coalesce(up, 6) AND hour(hour_utc) < coalesce(down, 18))"


@query("p12_daylight", f"{_LIT} SELECT station, {iso('hour_utc')} AS hour_utc FROM lit")
def _(v):
    return O.daylight(sampled(v), sun(v), ["station"], "hour_utc").select("station", "hour_utc")


_LADDER = R.load_box_categories()
_RIDABLE = ", ".join(f"'{w.name}'" for w in R.load_wind_ladder() if w.ridable)
_BR = lambda c: "(CASE " + " ".join(f"WHEN {c} = '{n}' THEN {i}" for i, n in enumerate(_LADDER)) + " END)"


@query("a16_w18_good_days", f"""{_LIT}, cat AS (SELECT *, {box_sql('a_h', 'a_p', 'a_d')} AS ca, {box_sql('b_h', 'b_p', 'b_d')} AS cb, {ladder_sql('wind_kt', 'wind_deg', '115.0')} AS wr FROM lit),
 rr AS (SELECT *, CASE WHEN a_h IS NOT NULL AND b_h IS NOT NULL THEN {_BR('ca')} END AS ra, CASE WHEN a_h IS NOT NULL AND b_h IS NOT NULL THEN {_BR('cb')} END AS rb FROM cat),
 dd AS (SELECT station, CAST(hour_utc AS DATE) AS d, count(*) FILTER (WHERE least(ra, rb) >= 2 AND ra IS NOT NULL AND (wr IS NULL OR wr IN ({_RIDABLE}))) AS n FROM rr GROUP BY 1, 2),
 bb AS (SELECT station, CASE WHEN ra <= rb THEN ca ELSE cb END AS c, row_number() OVER (PARTITION BY station ORDER BY least(ra, rb) DESC, hour_utc) AS rn FROM rr WHERE ra IS NOT NULL),
 sp AS (SELECT station, CAST({rint('(epoch(max(hour_utc)) - epoch(min(hour_utc))) / 86400.0')} AS INTEGER) AS window_days FROM samp GROUP BY 1)
SELECT sp.station, count(*) FILTER (WHERE dd.n >= 2) AS good_days, coalesce(max(bb.c), 'FLAT') AS category, max(window_days) AS window_days
FROM sp JOIN dd ON dd.station = sp.station LEFT JOIN (SELECT * FROM bb WHERE rn = 1) bb ON bb.station = sp.station GROUP BY 1""")
def _(v):
    s, boxes, low = sampled(v), R.load_boxes(), _LADDER[0]
    d = O.daylight(s, sun(v), ["station"], "hour_utc")
    both = F.col("a_h").isNotNull() & F.col("b_h").isNotNull()
    for m in ("a", "b"):
        d = d.withColumn(f"c{m}", R.box_category(F.col(f"{m}_h"), F.col(f"{m}_p"), F.col(f"{m}_d"), boxes, low))
        d = d.withColumn(f"r{m}", F.when(both, R.category_rank(F.col(f"c{m}"), _LADDER)))
    d = d.withColumn("wr", R.ladder_rating(F.col("wind_kt"), F.col("wind_deg"), F.lit(115.0), R.load_wind_ladder()))
    g = O.good_days(d, ["station"], "hour_utc", "ra", "rb", "ca", "cb", "wr", [w.name for w in R.load_wind_ladder() if w.ridable], threshold=2)
    return g.join(O.span_days(s, ["station"], "hour_utc"), "station")


@query("p16_payload_status", """
SELECT station, partition, count(*) AS n, count(dp_deg) AS present, CASE WHEN count(dp_deg) = 0 THEN 'empty' WHEN count(dp_deg) = count(*) THEN 'populated' ELSE 'partial' END AS status
FROM obs GROUP BY 1, 2""")
def _(v):
    return O.payload_status(v.obs, ["station", "partition"], "dp_deg")


@query("t07_last_known_good", f"""
WITH g AS (SELECT station, t AS gt, v FROM ser WHERE v >= 2)
SELECT s.station, {iso('s.t')} AS t, {r6('g.v')} AS served, CASE WHEN s.v >= 2 THEN 'fresh' WHEN g.v IS NOT NULL THEN 'stale' ELSE 'empty' END AS status
FROM ser s ASOF LEFT JOIN g ON g.station = s.station AND s.t >= g.gt""")
def _(v):
    return O.last_known_good(v.series, ["station"], "t", "v", F.col("v") >= 2, WEEK)


# ── wind, sites and runs ───────────────────────────────────────────────────

@query("j08_site_lookup", f"""
SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, site, line, region, tide_hi_offset FROM lineitem JOIN site ON site = l_suppkey""")
def _(v):
    return v.table("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", F.col("l_suppkey").alias("site")).join(
        v.sites.select("site", "line", "region", "tide_hi_offset"), "site")


# Spots share a coordinate when they round to the same half degree.
_HALF = "SELECT *, round_even(lat * 2, 0) / 2 AS plat, round_even(lon * 2, 0) / 2 AS plon FROM site"


@query("p13_compute_once", f"""
SELECT site, {r6('plat')} AS plat, {r6('plon')} AS plon, {r6(haversine('plat', 'plon', '-9.25', '114.75'))} AS km FROM ({_HALF})""")
def _(v):
    from ..functions import geo as G
    s = v.sites.withColumns({"plat": F.rint(F.col("lat") * 2) / 2, "plon": F.rint(F.col("lon") * 2) / 2})
    pts = Wd.dedup_points(s, "plat", "plon").withColumn("km", G.haversine_km(F.col("plat"), F.col("plon"), F.lit(-9.25), F.lit(114.75)))
    return Wd.back_to_spots(s, pts, "plat", "plon").select("site", "plat", "plon", "km")


@query("j16_nearest_cell", f"""
SELECT site, round(floor((lat + 42.0) / 0.5 + 0.5) * 0.5 - 42.0, 6) + 0.0 AS cell_lat, round(floor((lon - 95.0) / 0.5 + 0.5) * 0.5 + 95.0, 6) + 0.0 AS cell_lon, cells FROM site
JOIN (SELECT CAST(floor((lat + 42.0) / 0.5 + 0.5) AS INTEGER) AS r, CAST(floor((lon - 95.0) / 0.5 + 0.5) AS INTEGER) AS c, count(*) AS cells FROM site GROUP BY 1, 2)
ON r = CAST(floor((lat + 42.0) / 0.5 + 0.5) AS INTEGER) AND c = CAST(floor((lon - 95.0) / 0.5 + 0.5) AS INTEGER)""")
def _(v):
    """Each site on the half-degree grid whose occupied cells the sites themselves define."""
    ix = lambda c, o: Wd.cell_index(F.col(c), o, 0.5)
    grid = v.sites.groupBy((ix("lat", -42.0) * 0.5 - 42.0).alias("lat"), (ix("lon", 95.0) * 0.5 + 95.0).alias("lon")).agg(F.count("*").alias("cells"))
    return Wd.nearest_cell(v.sites.select("site", "lat", "lon"), grid, -42.0, 95.0, 0.5).select("site", "cell_lat", "cell_lon", "cells")


_SLOTS = "[4, 10, 16, 22]"


@query("j18_current_run", f"""
WITH c AS (SELECT event_id, ts, unnest([-1, 0, 1]) AS d FROM ev), s AS (SELECT event_id, ts, date_trunc('day', ts)::TIMESTAMP + to_days(d) + to_hours(h) AS slot
 FROM (SELECT *, unnest({_SLOTS}) AS h FROM c)), g AS (SELECT event_id, any_value(ts) AS ts, max(slot) FILTER (WHERE slot <= ts) AS past, min(slot) FILTER (WHERE slot > ts) AS nxt FROM s GROUP BY 1)
SELECT event_id, {iso('past')} AS available_since, {iso('past - INTERVAL 4 HOURS')} AS run_time, strftime(past - INTERVAL 4 HOURS, '%HZ') AS run_utc,
 {r6(f'round(({esql("nxt")} - {esql("ts")}) / 3600.0, 1)')} AS hours_to_next FROM g""")
def _(v):
    return Wd.current_run(v.events, "ts", Wd.RUN_HOURS["B"], Wd.INIT_OFFSET_HOURS["B"]).select(
        "event_id", "available_since", "run_time", "run_utc", "hours_to_next")


@query("j19_stale_since", f"""
SELECT e.event_id, EXISTS (SELECT 1 FROM (SELECT unnest([-1, 0]) AS d) a, (SELECT unnest({_SLOTS}) AS h) b
 WHERE date_trunc('day', e.ts)::TIMESTAMP + to_days(a.d) + to_hours(b.h) > e.ts - to_minutes(e.k * 5) AND date_trunc('day', e.ts)::TIMESTAMP + to_days(a.d) + to_hours(b.h) <= e.ts) AS stale FROM ev e""")
def _(v):
    ing = F.timestamp_micros(F.unix_micros("ts") - F.col("k").cast("long") * 300_000_000)
    return v.events.select("event_id", Wd.stale_since(ing, F.col("ts"), Wd.RUN_HOURS["B"]).alias("stale"))


_SPOTW = f"(SELECT site, region, {snap('time')} AS hour_utc, {wind_sql('(hs_m * 5)', 'dp_deg', 'shore_normal')} AS rating FROM rd JOIN site USING (site))"


def spot_winds(v):
    d = v.readings.join(v.sites.select("site", "region", "shore_normal"), "site")
    rating = R.shore_rating(F.col("hs_m") * 5, F.col("dp_deg"), F.col("shore_normal"), R.load_shore_ladder())
    return d.select("site", "region", T.snap_hour(F.col("time")).alias("hour_utc"), rating.alias("rating"))


_RIDABLE = ", ".join(f"'{n}'" for n in R.ridable_names(R.load_shore_ladder()))


@query("j20_clean_regions", f"SELECT region, {iso('hour_utc')} AS hour_utc, count(*) AS clean_spots FROM {_SPOTW} WHERE rating IN ({_RIDABLE}) GROUP BY 1, 2")
def _(v):
    return Wd.regions_with_clean_wind(spot_winds(v), R.ridable_names(R.load_shore_ladder()))


@query("s20_grid_arrays", f"""
SELECT station, {iso('t')} AS t, string_agg(CAST(CAST(round(u * 10000) AS BIGINT) AS VARCHAR), ',' ORDER BY i) AS u FROM (
 SELECT station, date_trunc('hour', ts)::TIMESTAMP AS t, user_id % 25 AS i, round(-max(value) * {sind('((user_id * 11) % 360)::DOUBLE')}, 4) AS u FROM ev GROUP BY station, 2, user_id) GROUP BY 1, 2""")
def _(v):
    """A station's 25 users stand for the points of its grid."""
    g = v.events.groupBy("station", F.date_trunc("hour", "ts").alias("t"), "user_id").agg(F.max("value").alias("speed"))
    g = g.select("station", "t", (F.col("user_id") % 25).alias("i"), "speed", ((F.col("user_id") * 11) % 360).cast("double").alias("deg"))
    a = Wd.grid_arrays(g, ["station", "t"], "i", "speed", "deg")
    return a.select("station", "t", F.array_join(F.transform("u", lambda x: F.round(x * 10000).cast("long").cast("string")), ",").alias("u"))


@query("t09_hourly_windows", f"SELECT station, {iso('hour_utc')} AS hour_utc, count(*) AS n, {r6('avg(hs_m)')} AS mean_hs_m FROM obsh GROUP BY 1, 2")
def _(v):
    from ..streaming.ingest import hourly_window_counts
    return hourly_window_counts(v.obs)
