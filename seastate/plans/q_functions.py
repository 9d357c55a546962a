"""Scalar functions (F) over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import circular as C
from ..functions import geo as G
from ..functions import rules as R
from ..functions import timefn as T
from ..functions import units as U
from ..operators.swelltrack import Target
from .ctes import (GROUP_KMH, bearing, box_sql, band_sql, cat_rank, cdiff, circ_mean, cosd, epoch, haversine, iso, m2ft,
                   m360, r6, rint, sc2deg, score_sql, sec, ladder_sql, sind, snap, spread, wind_sql, window_sql)
from .registry import query

TARGET = Target()
TLAT, TLON = str(TARGET.lat), str(TARGET.lon)


@query("f01_units", f"""
SELECT station, {iso('valid_utc')} AS valid_utc, partition, {r6(m2ft('hs_m'))} AS hs_ft, {r6('hs_m / 3.28084')} AS back_m,
 {r6('round(hs_m * 2.23694, 1)')} AS mph, {r6('round(hs_m * 1.94384, 1)')} AS kts FROM obs""")
def _(v):
    h = F.col("hs_m")
    return v.obs.select("station", "valid_utc", "partition", U.m_to_ft(h).alias("hs_ft"), U.ft_to_m(h).alias("back_m"),
                        U.ms_to_mph(h).alias("mph"), U.ms_to_kts(h).alias("kts"))


@query("f02_compass", f"""
SELECT event_id, CASE WHEN k = 98 THEN '?' ELSE (['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSW','SW','WSW','W','WNW','NW','NNW'])
 [CAST({rint('d / 22.5')} AS INTEGER) % 16 + 1] END AS cardinal,
 CASE WHEN k = 98 THEN '·' ELSE (['↑','↗','→','↘','↓','↙','←','↖'])[CAST({rint(m360('d + 180') + ' / 45')} AS INTEGER) % 8 + 1] END AS arrow,
 CASE WHEN k = 98 THEN NULL ELSE floor((CAST({rint('d / 22.5')} AS INTEGER) % 16) * 22.5)::DOUBLE END AS named_deg
FROM (SELECT event_id, k, ((k * 37 + user_id * 11) % 360)::DOUBLE AS d FROM ev)""")
def _(v):
    d = F.when(F.col("k") != 98, ((F.col("k") * 37 + F.col("user_id") * 11) % 360).cast("double"))
    e = v.events.select("event_id", d.alias("d"))
    return e.select("event_id", U.to_cardinal(F.col("d")).alias("cardinal"), U.to_travel_arrow(F.col("d")).alias("arrow"),
                    U.parse_direction(U.to_cardinal(F.col("d"))).alias("named_deg"))


@query("f03_wind_vector", f"""
SELECT station, {iso('valid_utc')} AS valid_utc, partition, {r6(f'round(-hs_m * {sind("dp_deg")}, 4)')} AS u,
 {r6(f'round(-hs_m * {cosd("dp_deg")}, 4)')} AS w FROM obs""")
def _(v):
    return v.obs.select("station", "valid_utc", "partition", U.wind_u(F.col("hs_m"), F.col("dp_deg")).alias("u"),
                        U.wind_v(F.col("hs_m"), F.col("dp_deg")).alias("w"))


@query("f04_f07_circular", f"""
SELECT station, {iso('cycle_utc')} AS cycle_utc, {iso('valid_utc')} AS valid_utc,
 {r6(cdiff('a_sw1_direction_deg', 'b_sw1_direction_deg'))} AS diff,
 {r6(f"abs({cdiff('a_sw1_direction_deg', 'b_sw1_direction_deg')})")} AS abs_diff,
 {r6(sind('a_sw1_direction_deg'))} AS s, {r6(cosd('a_sw1_direction_deg'))} AS c,
 {r6('CASE WHEN a_sw1_height_ft IS NULL THEN b_sw1_height_ft WHEN b_sw1_height_ft IS NULL THEN a_sw1_height_ft ELSE a_sw1_height_ft * 0.7 + b_sw1_height_ft * 0.3 END')} AS lerp,
 {r6(f"CASE WHEN a_sw1_direction_deg IS NULL THEN b_sw1_direction_deg WHEN b_sw1_direction_deg IS NULL THEN a_sw1_direction_deg ELSE {sc2deg('0.7 * ' + sind('a_sw1_direction_deg') + ' + 0.3 * ' + sind('b_sw1_direction_deg'), '0.7 * ' + cosd('a_sw1_direction_deg') + ' + 0.3 * ' + cosd('b_sw1_direction_deg'))} END")} AS lerp_deg
FROM pair""")
def _(v):
    from ..operators.pairing import pair_models
    a, b = F.col("a_sw1_direction_deg"), F.col("b_sw1_direction_deg")
    return pair_models(v.a, v.b).select(
        "station", "cycle_utc", "valid_utc", C.diff_deg(a, b).alias("diff"), C.abs_diff_deg(a, b).alias("abs_diff"),
        C.sin_deg(a).alias("s"), C.cos_deg(a).alias("c"),
        C.lerp(F.col("a_sw1_height_ft"), F.col("b_sw1_height_ft"), F.lit(0.3)).alias("lerp"),
        C.lerp_deg(a, b, F.lit(0.3)).alias("lerp_deg"))


@query("f08_weighted_direction", f"""
SELECT station, partition, {r6(sc2deg(f'sum(hs_m * {sind("dp_deg")})', f'sum(hs_m * {cosd("dp_deg")})'))} AS mean_deg
FROM obs GROUP BY station, partition""")
def _(v):
    return v.obs.groupBy("station", "partition").agg(C.weighted_mean_deg(F.col("hs_m"), F.col("dp_deg")).alias("mean_deg"))


@query("f09_f11_times", f"""
SELECT event_id, {iso(snap('ts'))} AS hour_utc, strftime(date_trunc('day', ts)::TIMESTAMP + to_hours((hour(ts) // 12) * 12), '%Y%m%dT%HZ') AS cycle,
 CAST({rint('(epoch_us(ts) - epoch_us(date_trunc(chr(100) || chr(97) || chr(121), ts)::TIMESTAMP + to_hours((hour(ts) // 12) * 12))) / 3.6e9')} AS INTEGER) AS lead,
 {iso("ts::TIMESTAMP + INTERVAL 5 HOURS")} AS from_local, {iso('ts')} AS parsed FROM ev""")
def _(v):
    # Before the March clock change New York is five hours behind UTC throughout the table.
    ts = F.col("ts")
    cyc = T.cycle_of(ts)
    return v.events.select(
        "event_id", T.snap_hour(ts).alias("hour_utc"), T.cycle_id(cyc).alias("cycle"),
        T.lead_hours(ts, T.parse_cycle_id(T.cycle_id(cyc))).alias("lead"),
        T.local_to_utc(ts, "America/New_York").alias("from_local"), T.parse_iso(T.iso_z(ts)).alias("parsed"))


@query("f12_season", f"""
SELECT o_orderkey, {r6('sin(2 * pi() * dayofyear(o_orderdate) / 365.0)')} AS doy_sin,
 {r6('cos(2 * pi() * dayofyear(o_orderdate) / 365.0)')} AS doy_cos FROM orders""")
def _(v):
    d = F.col("o_orderdate").cast("timestamp")
    return v.table("orders").select("o_orderkey", T.doy_sin(d).alias("doy_sin"), T.doy_cos(d).alias("doy_cos"))


@query("f13_swell_category", f"""
SELECT station, {iso('valid_utc')} AS valid_utc, partition, {band_sql('(hs_m * 3.28084)', 'tp_s')} AS category,
 {cat_rank(band_sql('(hs_m * 3.28084)', 'tp_s'))} AS rank FROM obs""")
def _(v):
    c = R.swell_category(F.col("hs_m") * U.FT_PER_M, F.col("tp_s"), R.load_bands())
    return v.obs.select("station", "valid_utc", "partition", c.alias("category")).withColumn("rank", R.category_rank(F.col("category")))


@query("f14_box_category", f"""
SELECT station, {iso('valid_utc')} AS valid_utc, partition, {box_sql('(hs_m * 3.28084)', 'tp_s', 'dp_deg')} AS category FROM obs""")
def _(v):
    c = R.box_category(F.col("hs_m") * U.FT_PER_M, F.col("tp_s"), F.col("dp_deg"), R.load_boxes(), R.load_box_categories()[0])
    return v.obs.select("station", "valid_utc", "partition", c.alias("category"))


@query("j10_match_boxes", f"""
SELECT station, {iso('cycle_utc')} AS cycle_utc, {iso('valid_utc')} AS valid_utc, model,
 {box_sql('sw1_height_ft', 'sw1_period_s', 'sw1_direction_deg')} AS category FROM fc""")
def _(v):
    m = R.match_boxes(v.forecast, R.load_boxes(), "sw1_height_ft", "sw1_period_s", "sw1_direction_deg", R.load_box_categories()[0])
    return m.select("station", "cycle_utc", "valid_utc", "model", "category")


_BOXES = R.load_boxes()


def _num(x):
    return "NULL" if x is None else "'Infinity'::DOUBLE" if x == float("inf") else f"{float(x)}::DOUBLE"


_MANY = """(SELECT p_partkey AS k, 'c' || p_size % 7 AS category, p_partkey * 37 % 200 / 10.0::DOUBLE AS plo, p_partkey * 37 % 200 / 10.0::DOUBLE + (5 + p_partkey % 30) / 10.0::DOUBLE AS phi,
 p_partkey * 53 % 150 / 10.0::DOUBLE AS hlo, p_partkey * 53 % 150 / 10.0::DOUBLE + (3 + p_partkey % 20) / 10.0::DOUBLE AS hhi,
 CASE WHEN p_partkey % 2 = 1 THEN (p_partkey * 11 % 270)::DOUBLE END AS dlo FROM part)"""


@query("j10_many_boxes", f"""
SELECT {iso('cycle_utc')} AS cycle_utc, {iso('valid_utc')} AS valid_utc, f.station, f.model, coalesce(arg_min(b.category, b.k), 'none') AS category FROM fc f LEFT JOIN {_MANY} b
 ON f.sw1_period_s >= b.plo AND f.sw1_period_s < b.phi AND f.sw1_height_ft >= b.hlo AND f.sw1_height_ft < b.hhi
 AND (b.dlo IS NULL OR (f.sw1_direction_deg >= b.dlo AND f.sw1_direction_deg < b.dlo + 90)) GROUP BY f.station, f.model, f.cycle_utc, f.valid_utc""")
def _(v):
    """A rule table as long as the part table, one box a part; the box with the smallest number wins."""
    k = F.col("p_partkey")
    plo, hlo, dlo = (k * 37 % 200) / 10.0, (k * 53 % 150) / 10.0, F.when(k % 2 == 1, (k * 11 % 270).cast("double"))
    boxes = v.table("part").select(k.cast("int").alias("rule_no"), F.concat(F.lit("c"), F.col("p_size") % 7).alias("category"), plo.alias("period_lo"), (plo + (5 + k % 30) / 10.0).alias("period_hi"),
                                   hlo.alias("height_lo"), (hlo + (3 + k % 20) / 10.0).alias("height_hi"), dlo.alias("dir_lo"), (dlo + 90).alias("dir_hi"))
    m = R.match_box_table(v.forecast, boxes, "sw1_height_ft", "sw1_period_s", "sw1_direction_deg", "none")
    return m.select("cycle_utc", "valid_utc", "station", "model", "category")


@query("s17_rule_table", "SELECT rule_no::INTEGER AS rule_no, r.category, height_lo, (SELECT count(*) FROM (SELECT "
       + box_sql("sw1_height_ft", "sw1_period_s", "sw1_direction_deg") + " AS c FROM fc) f WHERE f.c = r.category) AS n FROM (VALUES "
       + ", ".join(f"({b.rule_no}, '{b.category}', {_num(b.height[0])})" for b in _BOXES) + ") r(rule_no, category, height_lo)")
def _(v):
    """The rule file as rows, each with the number of forecasts that fall into its category."""
    m = R.match_boxes(v.forecast, _BOXES, "sw1_height_ft", "sw1_period_s", "sw1_direction_deg", R.load_box_categories()[0])
    n = m.groupBy("category").agg(F.count("*").alias("n"))
    rules = R.boxes_frame(v.spark, _BOXES)
    return rules.join(n, "category", "left").select("rule_no", "category", "height_lo", F.coalesce("n", F.lit(0)).alias("n"))


@query("f15_wind_rating", f"""
SELECT event_id, {wind_sql('spd', 'deg', 'normal')} AS rating FROM (SELECT event_id, CASE WHEN k = 96 THEN NULL ELSE value / 3.0 END AS spd,
 CASE WHEN k <> 98 THEN ((k * 37 + user_id * 11) % 360)::DOUBLE END AS deg, (user_id * 37 % 360)::DOUBLE AS normal FROM ev)""")
def _(v):
    e = v.events.select("event_id", F.when(F.col("k") != 96, F.col("value") / 3.0).alias("spd"),
                        F.when(F.col("k") != 98, ((F.col("k") * 37 + F.col("user_id") * 11) % 360).cast("double")).alias("deg"),
                        (F.col("user_id") * 37 % 360).cast("double").alias("normal"))
    return e.select("event_id", R.shore_rating(F.col("spd"), F.col("deg"), F.col("normal"), R.load_shore_ladder()).alias("rating"))


@query("f16_section_wind", f"""
SELECT station, {iso('valid_utc')} AS valid_utc, partition, {ladder_sql('(hs_m * 3)', 'dp_deg', '115.0')} AS rating FROM obs""")
def _(v):
    return v.obs.select("station", "valid_utc", "partition",
                        R.ladder_rating(F.col("hs_m") * 3, F.col("dp_deg"), F.lit(115.0), R.load_wind_ladder()).alias("rating"))


@query("f17_window_score", f"""
SELECT station, {iso('valid_utc')} AS valid_utc, partition, {r6(window_sql('dp_deg'))} AS weight,
 {r6(score_sql('hs_m', 'tp_s', 'dp_deg'))} AS score FROM obs""")
def _(v):
    w = R.load_window()
    return v.obs.select("station", "valid_utc", "partition", R.window_weight(F.col("dp_deg"), w).alias("weight"),
                        R.window_score(F.col("hs_m"), F.col("tp_s"), F.col("dp_deg"), w).alias("score"))


@query("f19_f21_great_circle", f"""
SELECT site, {r6(haversine('lat', 'lon', TLAT, TLON))} AS km, {r6(bearing('lat', 'lon', TLAT, TLON))} AS bearing,
 {r6(f"{haversine('lat', 'lon', TLAT, TLON)} / (tp * {GROUP_KMH})")} AS hours,
 {r6(spread('km1', haversine('lat', 'lon', TLAT, TLON)))} AS spread, {r6('lat2')} AS dest_lat,
 {r6(m360(f"lon + degrees(atan2({sind('brg')} * sin(km1 / 6371.0) * {cosd('lat')}, cos(km1 / 6371.0) - {sind('lat')} * {sind('lat2')})) + 540.0") + ' - 180.0')} AS dest_lon
FROM (SELECT *, degrees(asin({sind('lat')} * cos(km1 / 6371.0) + {cosd('lat')} * sin(km1 / 6371.0) * {cosd('brg')})) AS lat2
 FROM (SELECT *, 10.0 + site % 10 AS tp, 500.0 + site * 13 % 5000 AS km1, (site * 7 % 360)::DOUBLE AS brg FROM site))""")
def _(v):
    s = v.sites.select("*", (F.lit(10.0) + F.col("site") % 10).alias("tp"), (F.lit(500.0) + F.col("site") * 13 % 5000).alias("km1"),
                       (F.col("site") * 7 % 360).cast("double").alias("brg"))
    lat, lon, t, u = F.col("lat"), F.col("lon"), F.lit(TARGET.lat), F.lit(TARGET.lon)
    s = s.withColumns({"km": G.haversine_km(lat, lon, t, u), "dest_lat": G.destination_lat(lat, F.col("brg"), F.col("km1"))})
    return s.select("site", "km", G.bearing_deg(lat, lon, t, u).alias("bearing"), G.travel_hours(F.col("km"), F.col("tp")).alias("hours"),
                    G.spread_factor(F.col("km1"), F.col("km")).alias("spread"), "dest_lat",
                    G.destination_lon(lat, lon, F.col("brg"), F.col("km1"), F.col("dest_lat")).alias("dest_lon"))


_LEVELS, _LAST = R.load_levels()
_NAMES = [x.name for x in _LEVELS] + [_LAST]


@query("f23_a26_verdict", "SELECT *, CASE " + " ".join(f"WHEN a_verdict = '{n}' OR b_verdict = '{n}' THEN '{n}'" for n in _NAMES) + f""" END AS best_verdict FROM (
SELECT station, {iso('cycle_utc')} AS cycle_utc, {iso('valid_utc')} AS valid_utc, """ + ", ".join(
    f"CASE WHEN {m}h IS NULL AND {m}d IS NULL THEN NULL "
    + " ".join(f"WHEN coalesce(abs({m}h) <= {x.height}, TRUE) AND coalesce(abs({m}d) <= {x.direction}, TRUE) THEN '{x.name}'" for x in _LEVELS)
    + f" ELSE '{_LAST}' END AS {m}_verdict" for m in "ab")
    + " FROM (SELECT *, " + ", ".join(
    f"round(obs_sw1_height_ft - {m}_sw1_height_ft, 1) AS {m}h, {rint(cdiff('obs_sw1_direction_deg', f'{m}_sw1_direction_deg'))} AS {m}d" for m in "ab")
    + " FROM paired))")
def _(v):
    from ..operators.pairing import paired_dataset
    from ..operators.swelltrack import compare
    p = paired_dataset(v.a, v.b, v.obs).withColumns({f"{m}_{x}": F.col(f"{m}_sw1_{x}") for m in "ab" for x in ("height_ft", "direction_deg")})
    return compare(p, "obs_sw1_height_ft", "obs_sw1_direction_deg", ["a", "b"]).select(
        "station", "cycle_utc", "valid_utc", "a_verdict", "b_verdict", "best_verdict")


_PHASE = m360("x").replace("360.0", "29.530588853::DOUBLE")


@query("f24_moon", f"""
SELECT event_id, {r6('p')} AS phase, CASE WHEN p > 0.97 OR p < 0.03 THEN 'New' WHEN p < 0.22 THEN 'Waxing crescent' WHEN p < 0.28 THEN 'First quarter'
 WHEN p < 0.47 THEN 'Waxing gibbous' WHEN p < 0.53 THEN 'Full' WHEN p < 0.72 THEN 'Waning gibbous' WHEN p < 0.78 THEN 'Last quarter'
 ELSE 'Waning crescent' END AS label, p < 0.10 OR p > 0.90 OR (p > 0.40 AND p < 0.60) AS spring
FROM (SELECT event_id, {_PHASE} / 29.530588853::DOUBLE AS p FROM (SELECT event_id, ({epoch('ts')} - 947182440.0) / 86400.0 AS x FROM ev))""")
def _(v):
    from ..operators.ordered import epoch as ep
    e = v.events.select("event_id", T.moon_phase(ep(F.col("ts"))).alias("phase"))
    return e.select("event_id", "phase", T.moon_label(F.col("phase")).alias("label"), T.is_spring_tide(F.col("phase")).alias("spring"))


@query("f26_energy", f"""
SELECT station, {iso('valid_utc')} AS valid_utc, partition, {r6('round(hs_m * hs_m * tp_s, 1)')} AS forecast_energy,
 {r6('round(hs_m * tp_s * tp_s, 1)')} AS observed_energy FROM obs""")
def _(v):
    h, p = F.col("hs_m"), F.col("tp_s")
    return v.obs.select("station", "valid_utc", "partition", U.forecast_energy(h, p).alias("forecast_energy"),
                        U.observed_energy(h, p).alias("observed_energy"))


@query("f27_clock_label", """
SELECT event_id, lower(strftime(ts, '%-I:%M%p')) AS label FROM ev""")
def _(v):
    return v.events.select("event_id", T.clock_label(F.col("ts")).alias("label"))


@query("f28_features", f"""
SELECT station, {iso('cycle_utc')} AS cycle_utc, {iso('valid_utc')} AS valid_utc, """ + ", ".join(
    [f"{r6(fn(f'{m}_{sw}_direction_deg'))} AS {m}_{sw}_dp_{nm}" for m in "ab" for sw in ("sw1", "sw2") for nm, fn in (("sin", sind), ("cos", cosd))]
    + [f"{r6(f'a_{sw}_{x} - b_{sw}_{x}')} AS d_{sw}_{x}" for sw in ("sw1", "sw2") for x in ("height_ft", "period_s")]
    + [f"{r6(cdiff(f'a_{sw}_direction_deg', f'b_{sw}_direction_deg'))} AS d_{sw}_dp_deg" for sw in ("sw1", "sw2")]
    + [f"{r6('sin(2 * pi() * dayofyear(valid_utc) / 365.0)')} AS doy_sin, CASE WHEN station = 'st00000' THEN 1.0 ELSE 0.0 END::DOUBLE AS is_st00000"])
    + " FROM paired")
def _(v):
    from ..operators.pairing import features, paired_dataset
    cols = ([f"{m}_{sw}_dp_{x}" for m in "ab" for sw in ("sw1", "sw2") for x in ("sin", "cos")]
            + [f"d_{sw}_{x}" for sw in ("sw1", "sw2") for x in ("height_ft", "period_s", "dp_deg")])
    return features(paired_dataset(v.a, v.b, v.obs), ["st00000"]).select(
        "station", "cycle_utc", "valid_utc", *cols, "doy_sin", "is_st00000")


@query("f29_model_names", """
SELECT name, CASE WHEN sid % 2 = 0 THEN 'baseline' ELSE 'ML' END AS arch, strftime(trained_utc, '%y%m%d') AS date_yymmdd,
 (round(0.25::DOUBLE + (sid % 50) / 100.0::DOUBLE, 2))::DOUBLE AS coverage, 'v' || sid AS version FROM mdl""")
def _(v):
    p = T.parse_model_name(F.col("name"), "sea")
    return v.models.select("name", *[c.alias(k) for k, c in p.items()])


@query("f30_boundary_table", f"""
WITH lim AS (SELECT station, CAST(ceil(max(hs_m * 3.28084)) AS INTEGER) AS hmax, CAST(max(tp_s) AS INTEGER) AS pmax FROM obs GROUP BY station)
SELECT station, height_ft, period_s, {band_sql('height_ft', 'period_s')} AS category FROM (
 SELECT station, h / 2.0::DOUBLE AS height_ft, p::DOUBLE AS period_s FROM (SELECT *, unnest(range(pmax + 1)) AS p FROM (
  SELECT *, unnest(range(2 * hmax + 1)) AS h FROM lim)))""")
def _(v):
    """Category at every chart cell up to each station's own largest height and period."""
    from ..operators.outlook import boundary_table
    return boundary_table(v.obs.withColumn("height_ft", F.col("hs_m") * U.FT_PER_M), ["station"], "height_ft", "tp_s", R.load_bands())


@query("f31_json_fields", "SELECT event_id, k FROM ev")
def _(v):
    return v.events.select("event_id", "k")


@query("p17_clamp_windows", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, greatest(1, least(45, CAST(l_quantity AS INTEGER))) AS days,
 greatest(0, least(30, CAST(l_quantity AS INTEGER) - 5)) AS past_days, strftime(least(l_shipdate, o_orderdate), '%Y-%m-%d') AS first_day,
 strftime(least(greatest(l_shipdate, o_orderdate), least(l_shipdate, o_orderdate) + INTERVAL 14 DAYS), '%Y-%m-%d') AS last_day
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def _(v):
    j = v.table("lineitem").join(v.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    lo, hi = T.clamp_range(F.to_date("l_shipdate"), F.to_date("o_orderdate"))
    q = F.col("l_quantity").cast("int")
    return j.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", T.clamp(q, T.DAYS_LIMIT).alias("days"),
                    T.clamp(q - 5, T.PAST_DAYS_LIMIT).alias("past_days"), lo.alias("first_day"), hi.alias("last_day"))
