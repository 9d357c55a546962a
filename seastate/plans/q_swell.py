"""Swell tracing queries: readings to sources to arrivals."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..functions import circular as C
from ..operators import swelltrack as Sw
from ..operators import waves as Wv
from ..functions.rules import SwellWindow, load_tiers, load_window
from .ctes import (IN_CORE, IN_EDGE, GROUP_KMH, bearing, cdiff, cosd, epoch, haversine, iso, m2ft, m360, r6, rint, score_sql, sec, sind, spread)
from .q_functions import TARGET, TLAT, TLON
from .registry import query

_TIERS = "CASE " + " ".join(f"WHEN n >= {t.sites} AND be <= {t.bearing_err} AND ts <= {t.time_spread} THEN '{t.name}'" for t in load_tiers()) + " ELSE 'weak' END"

_CG = f"(tp_s * {GROUP_KMH})"


@query("w02_latest_reading", f"SELECT site, {iso('time')} AS time, {r6('hs_m')} AS hs_m, {r6('tp_s')} AS tp_s, {r6('dp_deg')} AS dp_deg FROM lrd")
def _(v):
    return v.latest.select("site", "time", "hs_m", "tp_s", "dp_deg")


@query("j17_sentinel_table", f"""
SELECT site, line, {iso('time')} AS time, {r6(haversine('lat', 'lon', TLAT, TLON))} AS distance_km, {r6(bearing('lat', 'lon', TLAT, TLON))} AS bearing,
 {r6('abs(' + cdiff(bearing('lat', 'lon', TLAT, TLON), '0.0') + ')')} AS north_offset, {r6(m2ft('hs_m'))} AS hs_ft,
 {r6(haversine('lat', 'lon', TLAT, TLON) + f' / {_CG}')} AS transit_hours FROM site LEFT JOIN lrd USING (site)""")
def _(v):
    return Sw.sentinel_table(v.sites, v.latest, ["site"], TARGET).select(
        "site", "line", "time", "distance_km", "bearing", "north_offset", "hs_ft", "transit_hours")


# Sources are traced over a wider range of directions than the one that scores swell, so that none near its edges is left out.
TRACED = (150.0, 265.0)
TRACE = replace(TARGET, window=SwellWindow(((TRACED[0], 0.0), *TARGET.window.rose[1:-1], (TRACED[1], 0.0)), TARGET.window.floor_s))

_SOL = f"""s0 AS (SELECT *, unnest(range(12, 193, 3)) AS tau_h FROM (SELECT r.site, s.line, s.lat, s.lon, r.time, r.hs_m, r.tp_s, r.dp_deg, r.now FROM SRC r JOIN site s USING (site))),
 s1 AS (SELECT *, {_CG} * tau_h AS src_km FROM s0),
 s2 AS (SELECT *, degrees(asin({sind('lat')} * cos(src_km / 6371.0) + {cosd('lat')} * sin(src_km / 6371.0) * {cosd('dp_deg')})) AS src_lat FROM s1),
 s3 AS (SELECT *, {m360(f"lon + degrees(atan2({sind('dp_deg')} * sin(src_km / 6371.0) * {cosd('lat')}, cos(src_km / 6371.0) - {sind('lat')} * {sind('src_lat')})) + 540.0")} - 180.0 AS src_lon
  FROM s2 WHERE src_lat BETWEEN -68 AND 5),
 s4 AS (SELECT *, {bearing(TLAT, TLON, 'src_lat', 'src_lon')} AS theta, {haversine('src_lat', 'src_lon', TLAT, TLON)} AS to_km FROM s3),
 s5 AS (SELECT *, {epoch('time')} - tau_h * 3600.0 + to_km / {_CG} * 3600.0 AS arrive_epoch FROM s4 WHERE theta BETWEEN {TRACED[0]} AND {TRACED[1]}),
 sol AS (SELECT *, (arrive_epoch - {epoch('now')}) / 3600.0 AS lead_h, theta {IN_CORE} AS in_core, {m2ft('hs_m * ' + spread('src_km', 'to_km'))} AS hs_at FROM s5
  WHERE (arrive_epoch - {epoch('now')}) / 3600.0 BETWEEN -6 AND 216)"""
_LAST = _SOL.replace("SRC", "sent")
# Every reading, with its own time as 'now': the whole history at once.
_ALL = _SOL.replace("SRC", "(SELECT *, time AS now FROM (SELECT DISTINCT site, time, hs_m, tp_s, dp_deg FROM rd))")
_BELT = "CASE WHEN round(src_lat, 2) BETWEEN -60 AND -35 THEN 0.0 ELSE least(abs(round(src_lat, 2) + 47.5) / 20.0, 2.0) END"


@query("f22_translate_readings", f"WITH {_LAST} SELECT site, tau_h::INTEGER AS tau_h, {r6('src_lat')} AS src_lat, {r6('src_lon')} AS src_lon, {r6('to_km')} AS to_km, {r6('theta')} AS theta, "
       f"{r6('lead_h')} AS lead_h, {r6('hs_at')} AS hs_ft_at_target, in_core FROM sol")
def _(v):
    return Sw.translate(v.sentinels, TRACE, "now").select("site", "tau_h", "src_lat", "src_lon", "to_km", "theta", "lead_h", "hs_ft_at_target", "in_core")


@query("w14_a25_best_solution", f"""WITH {_ALL}, rk AS (SELECT *, row_number() OVER (PARTITION BY site, time, hs_m, tp_s, dp_deg ORDER BY CASE WHEN in_core THEN 0 ELSE 1 END, {_BELT}, tau_h) AS rn FROM sol),
 ag AS (SELECT site, time, hs_m, tp_s, dp_deg, min(lead_h) AS lo, max(lead_h) AS hi, min(CAST({rint('theta')} AS INTEGER)) AS dlo, max(CAST({rint('theta')} AS INTEGER)) AS dhi, count(*) AS n
  FROM sol GROUP BY ALL)
SELECT site, {iso('time')} AS time, {r6('hs_m')} AS hs_m, {r6('tp_s')} AS tp_s, {r6('dp_deg')} AS dp_deg, r.tau_h::INTEGER AS tau_h, {r6('r.lead_h')} AS lead_h,
 {r6('lo')} AS lead_min, {r6('hi')} AS lead_max, dlo AS dir_min, dhi AS dir_max, n AS n_solutions FROM ag JOIN (SELECT * FROM rk WHERE rn = 1) r USING (site, time, hs_m, tp_s, dp_deg)""")
def _(v):
    """Every distinct reading of the history traced to its best source."""
    keys = ["site", "time", "hs_m", "tp_s", "dp_deg"]
    r = v.readings.select(*keys).distinct().join(v.sites.select("site", "lat", "lon"), "site").withColumn("now", F.col("time"))
    b = Sw.best_solution(r, TRACE, "now")
    return b.select(*keys, "tau_h", "lead_h", "lead_min", "lead_max", "dir_min", "dir_max", "n_solutions")


def _members(v):
    from ..operators.ordered import epoch as ep
    s = Sw.sentinel_table(v.sites, v.latest, ["site"], TARGET).join(v.sentinels.select("site", "now"), "site")
    return s.select("line", "now", "distance_km", "site", "lat", "lon", ep(F.col("time")).alias("t_obs"), "tp_s", "dp_deg", "hs_m")


def _groups(v):
    return Sw.group_by_period(_members(v), ["line", "now"])


_GRP = f"""RECURSIVE mem AS (SELECT *, {haversine('lat', 'lon', TLAT, TLON)} AS distance_km, row_number() OVER (PARTITION BY line ORDER BY {haversine('lat', 'lon', TLAT, TLON)}, site) AS r FROM sent),
 gs AS (SELECT line, r, [1]::BIGINT[] AS lab, [tp_s] AS tps FROM mem WHERE r = 1
  UNION ALL SELECT line, r, list_append(lab, CASE WHEN hit IS NULL THEN list_max(lab) + 1 ELSE hit END), list_append(tps, tp) FROM (
   SELECT g.line, m.r, g.lab, g.tps, m.tp_s AS tp, (SELECT min(l) FROM (SELECT l, avg(t) AS mean FROM (SELECT unnest(g.lab) AS l, unnest(g.tps) AS t) GROUP BY l) WHERE abs(mean - m.tp_s) <= 1.5) AS hit
   FROM gs g JOIN mem m ON m.line = g.line AND m.r = g.r + 1)),
 fin AS (SELECT line, unnest(lab) AS lab, unnest(range(1, len(lab) + 1)) AS r FROM (SELECT line, arg_max(lab, r) AS lab FROM gs GROUP BY 1)),
 gm AS (SELECT mem.*, lab - 1 AS cluster FROM fin JOIN mem USING (line, r))"""


@query("w17_period_groups", f"WITH {_GRP} SELECT line, cluster::INTEGER AS cluster, site FROM gm")
def _(v):
    return _groups(v).select("line", "cluster", F.explode("members.site").alias("site"))


def _grid(lat: str, lon: str, src: str, tag: str) -> str:
    """Score every candidate of a grid for every cluster and keep the best."""
    d, b = haversine("m.lat", "m.lon", "c.la", "c.lo"), bearing("m.lat", "m.lon", "c.la", "c.lo")
    return f"""{tag}0 AS ({src}),
 {tag}1 AS (SELECT c.line, c.cluster, c.la, c.lo, {d} AS km, abs({cdiff(b, 'm.dp_deg')}) AS err, {epoch('m.time')} - {d} / (m.tp_s * {GROUP_KMH}) * 3600.0 AS o FROM {tag}0 c JOIN gm m ON m.line = c.line AND m.cluster = c.cluster),
 {tag}2 AS (SELECT line, cluster, la, lo, avg(err) AS be, (max(o) - min(o)) / 3600.0 AS ts, avg(o) AS origin, avg(err) + 1.5 * (max(o) - min(o)) / 3600.0 AS score FROM {tag}1 GROUP BY 1, 2, 3, 4
  HAVING bool_and(km >= 400 AND err <= 45)),
 {tag} AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY line, cluster ORDER BY score, la, lo) AS rn FROM {tag}2) WHERE rn = 1)"""


_CL = "(SELECT DISTINCT line, cluster FROM gm)"
_FIT = (_GRP + ", " + _grid("", "", f"SELECT *, unnest(range(52)) * 2.0::DOUBLE + 30.0 AS lo FROM (SELECT *, unnest(range(21)) * 2.0::DOUBLE - 64.0 AS la FROM {_CL})", "co")
        + ", " + _grid("", "", "SELECT line, cluster, la, lo0 + unnest(range(11)) * 0.5::DOUBLE - 2.5 AS lo FROM (SELECT line, cluster, lo AS lo0, la + unnest(range(11)) * 0.5::DOUBLE - 2.5 AS la FROM co)", "fi"))


@query("j14_a24_fit_source", f"WITH {_FIT} SELECT line, cluster::INTEGER AS cluster, {r6('coalesce(fi.la, co.la)')} AS src_lat, {r6('coalesce(fi.lo, co.lo)')} AS src_lon, {r6('coalesce(fi.score, co.score)')} AS score, "
       f"{r6('coalesce(fi.be, co.be)')} AS bearing_err, {r6('coalesce(fi.ts, co.ts)')} AS time_spread FROM co LEFT JOIN fi USING (line, cluster)")
def _(v):
    return Sw.fit_source(_groups(v)).select("line", "cluster", F.col("fit.lat").alias("src_lat"), F.col("fit.lon").alias("src_lon"), "fit.score", "fit.bearing_err", "fit.time_spread")


_SUM = f"""{_FIT}, ft AS (SELECT line, cluster, coalesce(fi.la, co.la) AS la, coalesce(fi.lo, co.lo) AS lo, coalesce(fi.be, co.be) AS be, coalesce(fi.ts, co.ts) AS ts, coalesce(fi.origin, co.origin) AS origin FROM co LEFT JOIN fi USING (line, cluster)),
 cm AS (SELECT ft.line, ft.cluster, any_value(ft.la) AS la, any_value(ft.lo) AS lo, any_value(be) AS be, any_value(ts) AS ts, any_value(origin) AS origin, avg(m.tp_s) AS tp_s, count(*) AS n, any_value(m.now) AS now,
  avg(m.hs_m * {spread(haversine('m.lat', 'm.lon', 'ft.la', 'ft.lo'), haversine('ft.la', 'ft.lo', TLAT, TLON))}) AS hs FROM ft JOIN gm m ON m.line = ft.line AND m.cluster = ft.cluster GROUP BY 1, 2),
 cs AS (SELECT *, {haversine('la', 'lo', TLAT, TLON)} AS source_km, {bearing(TLAT, TLON, 'la', 'lo')} AS theta, origin + {haversine('la', 'lo', TLAT, TLON)} / {_CG} * 3600.0 AS arrive_epoch FROM cm)"""


@query("a23_cluster_summary", f"WITH {_SUM} SELECT line, cluster::INTEGER AS cluster, {r6('tp_s')} AS tp_s, n::INTEGER AS n_sites, {r6('source_km')} AS source_km, {r6(f'(arrive_epoch - {epoch(chr(110) + chr(111) + chr(119))}) / 3600.0')} AS lead_h, "
       f"{r6('theta')} AS theta, theta {IN_EDGE} AS in_window, {r6(m2ft('hs'))} AS hs_ft, {_TIERS} AS confidence FROM cs")
def _(v):
    s = Sw.cluster_summary(Sw.fit_source(_groups(v)), ["line", "now"], TARGET, "now")
    return s.select("line", "cluster", "tp_s", "n_sites", "source_km", "lead_h", "theta", "in_window", "hs_ft", "confidence")


@query("j13_model_at_arrival", f"""
WITH e AS (SELECT event_id, station, date_trunc('hour', ts + to_minutes(k * 37))::TIMESTAMP AS at_hour FROM ev WHERE event_type = 'signup'),
 m AS (SELECT station, valid_utc AS vt, max(sw1_height_ft) AS h FROM fa GROUP BY 1, 2),
 f AS (SELECT e.*, m.vt, m.h FROM e ASOF LEFT JOIN m ON m.station = e.station AND e.at_hour <= m.vt),
 l AS (SELECT station, max(vt) AS lt, arg_max(h, vt) AS lh FROM (SELECT station, vt, coalesce(h, -1) AS h FROM m) GROUP BY 1)
SELECT event_id, {iso('coalesce(vt, lt)')} AS model_at, {r6('CASE WHEN vt IS NOT NULL THEN h ELSE nullif(lh, -1) END')} AS h FROM f LEFT JOIN l USING (station)""")
def _(v):
    """Arrival hours with the model value of that hour, else the next, else the last."""
    e = v.events.filter(F.col("event_type") == "signup").select(
        "event_id", "station", F.date_trunc("hour", F.timestamp_seconds(F.unix_timestamp("ts") + F.col("k") * 2220)).alias("at_hour"))
    m = v.a.groupBy("station", F.col("valid_utc").alias("vt")).agg(F.max("sw1_height_ft").alias("h"))
    return Sw.model_at_arrival(e, m, ["station"], "at_hour", "vt", ["h"]).select("event_id", "model_at", "h")


@query("o05_pick_window_swell", f"""
WITH c AS (SELECT station, model, cycle_utc, valid_utc, 0 AS pos, sw1_height_ft AS h, sw1_period_s AS p, sw1_direction_deg AS d FROM fc UNION ALL
 SELECT station, model, cycle_utc, valid_utc, 1, sw2_height_ft, sw2_period_s, sw2_direction_deg FROM fc), s AS (SELECT *, {score_sql('h', 'p', 'd')} AS sc FROM c),
 r AS (SELECT *, row_number() OVER (PARTITION BY station, model, cycle_utc, valid_utc ORDER BY sc DESC, pos) AS rn FROM s)
SELECT station, model, {iso('cycle_utc')} AS cycle_utc, {iso('valid_utc')} AS valid_utc, {r6('h')} AS height_ft, {r6('p')} AS period_s, {r6('sc')} AS score FROM r WHERE rn = 1 AND sc > 0""")
def _(v):
    comps = F.array(*[F.struct(F.col(f"sw{i}_height_ft").alias("height_ft"), F.col(f"sw{i}_period_s").alias("period_s"),
                               F.col(f"sw{i}_direction_deg").alias("direction_deg"), F.lit(f"swell{i}").alias("type")) for i in (1, 2)])
    d = v.forecast.withColumn("comps", comps)
    best, _scored = Wv.pick_window_swell(F.col("comps"), load_window())
    d = d.withColumn("best", best).filter(F.col("best").isNotNull())
    return d.select("station", "model", "cycle_utc", "valid_utc", "best.height_ft", "best.period_s", "best.score")
