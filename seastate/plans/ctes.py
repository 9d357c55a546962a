"""DuckDB text of the logical tables, and small SQL fragments for the oracles."""

from __future__ import annotations

from ..functions import rules as R
from ..functions.rules import SWELL_CATEGORIES, load_bands, load_box_categories, load_boxes, load_shore_ladder, load_window

SCALE = "0.061803398875"
OBS_COLS = "station, valid_utc, partition, hs_m, tp_s, dp_deg, source, ingest_utc"


def r6(x: str) -> str:
    return f"(round(({x})::DOUBLE, 6) + 0.0)"


def iso(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%dT%H:%M:%SZ')"


def m360(x: str) -> str:
    return f"((({x}) % 360.0 + 360.0) % 360.0)"


def cdiff(a: str, b: str) -> str:
    return f"({m360(f'({a}) - ({b}) + 180.0')} - 180.0)"


def sind(x: str) -> str:
    return f"sin(radians({x}))"


def cosd(x: str) -> str:
    return f"cos(radians({x}))"


def sc2deg(s: str, c: str) -> str:
    return m360(f"degrees(atan2({s}, {c}))")


def circ_mean(a: str, b: str) -> str:
    return sc2deg(f"({sind(a)} + {sind(b)}) / 2.0", f"({cosd(a)} + {cosd(b)}) / 2.0")


def snap(ts: str) -> str:
    return f"date_trunc('hour', {ts} + INTERVAL 30 MINUTES)"


def sec(x: str) -> str:
    """Epoch seconds expression to a timestamp."""
    return f"make_timestamp(CAST(round(({x}) * 1000000) AS BIGINT))"


def epoch(x: str) -> str:
    return f"(epoch_us({x}) / 1000000.0)"


def rint(x: str) -> str:
    return f"round_even({x}, 0)"


def m2ft(x: str) -> str:
    return f"round(({x}) * 3.28084, 1)"


def haversine(a, b, c, d) -> str:
    return (f"(12742.0 * asin(sqrt(power(sin(radians(({c}) - ({a})) / 2), 2) + {cosd(a)} * {cosd(c)} * "
            f"power(sin(radians(({d}) - ({b})) / 2), 2))))")


def bearing(a, b, c, d) -> str:
    dl = f"radians(({d}) - ({b}))"
    return m360(f"degrees(atan2(sin({dl}) * {cosd(c)}, {cosd(a)} * {sind(c)} - {sind(a)} * {cosd(c)} * cos({dl})))")


GROUP_KMH = "(9.81 / (4 * pi()) * 3.6)"


def spread(a: str, b: str) -> str:
    def area(k: str) -> str:
        g = f"greatest(1e-6, ({k}) / 6371.0)"
        return f"(CASE WHEN {g} < pi() THEN {g} * sin({g}) ELSE 1e-6 END)"

    return f"(CASE WHEN {area(b)} > 0 THEN sqrt(greatest(0.0, {area(a)} / {area(b)})) END)"


def band_sql(h: str, p: str) -> str:
    """The period-band ladder written out branch by branch."""
    arms = [f"WHEN {h} IS NULL OR {p} IS NULL THEN '{SWELL_CATEGORIES[0]}'"]
    for band in load_bands():
        inner = []
        for rule in band.rules:
            test = {"always": "TRUE", "lt": f"{h} < {rule.bound}", "gte": f"{h} >= {rule.bound}"}[rule.op]
            inner.append(f"WHEN {test} THEN '{rule.category}'")
        ladder = f"CASE {' '.join(inner)} ELSE '{band.rules[-1].category}' END"
        cond = "TRUE" if band.period_ub == float("inf") else f"{p} < {band.period_ub}"
        arms.append(f"WHEN {cond} THEN {ladder}")
    return f"(CASE {' '.join(arms)} END)"


def cat_rank(c: str) -> str:
    return "(CASE " + " ".join(f"WHEN {c} = '{n}' THEN {i}" for i, n in enumerate(SWELL_CATEGORIES)) + " END)"


def box_sql(h: str, p: str, d: str) -> str:
    arms = [f"WHEN {h} IS NULL OR {p} IS NULL THEN '{load_box_categories()[0]}'"]
    for b in load_boxes():
        t = [f"{p} >= {b.period[0]}", f"{h} >= {b.height[0]}"]
        t += [f"{c} < {hi}" for c, hi in ((p, b.period[1]), (h, b.height[1])) if hi != float("inf")]
        if b.direction:
            t.append(f"{d} >= {b.direction[0]} AND {d} < {b.direction[1]}")
        arms.append(f"WHEN {' AND '.join(t)} THEN '{b.category}'")
    return f"(CASE {' '.join(arms)} ELSE '{load_box_categories()[0]}' END)"


def steps_sql(s: str, d: str, o: str, ladder) -> str:
    """Name of the first wind step that holds; blind steps hold without a direction."""
    off = f"abs({cdiff(d, o)})"
    rows = [f"WHEN ({off} <= {w.angle}{f' OR {d} IS NULL' if w.blind else ''})" + (f" AND {s} <= {w.speed}" if w.speed < 1e9 else "") + f" THEN '{w.name}'" for w in ladder]
    return f"(CASE WHEN {s} IS NULL OR {o} IS NULL THEN NULL {' '.join(rows)} END)"


def wind_sql(s: str, d: str, n: str) -> str:
    return steps_sql(s, d, f"(({n}) + 180.0)", load_shore_ladder())


def ladder_sql(s: str, d: str, o: str) -> str:
    return steps_sql(s, d, o, R.load_wind_ladder())


def curve_sql(x: str, points: list[list[float]]) -> str:
    """Piecewise linear value, flat beyond the ends."""
    steps = " ".join(f"WHEN {x} <= {b[0]} THEN {a[1]}::DOUBLE + ({x} - {a[0]}::DOUBLE) * {(b[1] - a[1]) / (b[0] - a[0])!r}::DOUBLE"
                     for a, b in zip(points, points[1:], strict=False))
    return f"(CASE WHEN {x} IS NULL THEN NULL WHEN {x} <= {points[0][0]} THEN {points[0][1]}::DOUBLE {steps} ELSE {points[-1][1]}::DOUBLE END)"


_WINDOW = load_window()
IN_EDGE, IN_CORE = (f"BETWEEN {lo} AND {hi}" for lo, hi in (_WINDOW.edge, _WINDOW.core))


def window_sql(d: str) -> str:
    x = m360(d)
    return f"(CASE WHEN {x} {IN_EDGE} THEN {curve_sql(x, [list(p) for p in _WINDOW.rose])} ELSE 0.0 END)"


def score_sql(h: str, p: str, d: str) -> str:
    return f"(CASE WHEN {h} > 0 AND {p} >= {_WINDOW.floor_s} THEN {h} * {h} * {p} * {window_sql(d)} ELSE 0.0 END)"


# Hours between two leads of the test forecasts, which are valid every three hours.
LEAD_STEP_H = 3

SWELL_VARS = [f"{p}_{x}" for p in ("sw1", "sw2") for x in ("height_ft", "period_s", "direction_deg")]
SCALARS = [v for v in SWELL_VARS if not v.endswith("deg")]
DIRECTIONS = [v for v in SWELL_VARS if v.endswith("deg")]
FORECAST_VALUES = SWELL_VARS + ["combined_height_m", "combined_period_s", "combined_direction_deg"]

_ab = ", ".join(f"a.{v} AS a_{v}, b.{v} AS b_{v}" for v in FORECAST_VALUES)
_ab_plain = ", ".join(f"{m}_{v}" for v in FORECAST_VALUES for m in ("a", "b")
                      if not (m == "b" and v in ("sw1_height_ft", "sw1_period_s", "sw1_direction_deg")))
_use = "(b_sw1_height_ft IS NULL AND b_combined_height_m > 0)"

CTES: dict[str, str] = {
    "ev": "SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, "
          "printf('st%05d', user_id // 25) AS station FROM events",
    "obs": "SELECT station, ts AS valid_utc, CASE event_type WHEN 'purchase' THEN 0 WHEN 'error' THEN 1 ELSE 2 END AS partition, "
           f"value * {SCALE} AS hs_m, CASE WHEN k <> 97 THEN (4 + k % 18)::DOUBLE END AS tp_s, "
           "CASE WHEN k <> 98 THEN ((k * 37 + user_id * 11) % 360)::DOUBLE END AS dp_deg, "
           "CASE WHEN k % 2 = 0 THEN 'realtime' ELSE 'archive' END AS source, "
           "date_trunc('day', ts)::TIMESTAMP + to_days(1 + k % 3) AS ingest_utc "
           "FROM ev WHERE event_type IN ('purchase', 'error', 'signup')",
    "fgroup": "SELECT station, CASE event_type WHEN 'click' THEN 'A' ELSE 'B' END AS model, "
              f"{sec('floor(epoch(ts) / 10800) * 10800')} AS valid_utc, "
              f"date_trunc('day', {sec('floor(epoch(ts) / 10800) * 10800')})::TIMESTAMP - to_days(k % 2) AS cycle_utc, "
              "count(*) AS n, avg(value) AS v, max(k) AS kx, min(k) AS kn, min(user_id) AS u "
              "FROM ev WHERE event_type IN ('click', 'view') GROUP BY ALL",
    "fc": "SELECT station, model, cycle_utc, valid_utc, "
          "CAST((epoch(valid_utc) - epoch(cycle_utc)) / 3600 AS INTEGER) AS lead_hours, "
          f"CASE WHEN kx % 7 <> 0 THEN v * ({SCALE}::DOUBLE * 3.28084::DOUBLE) END AS sw1_height_ft, "
          "CASE WHEN kx % 7 <> 0 THEN (5 + kx % 14)::DOUBLE END AS sw1_period_s, "
          "CASE WHEN kx % 7 <> 0 THEN ((kx * 37 + u * 11) % 360)::DOUBLE END AS sw1_direction_deg, "
          f"CASE WHEN n > 1 THEN v * ({SCALE}::DOUBLE * 1.5::DOUBLE) END AS sw2_height_ft, "
          "CASE WHEN n > 1 THEN (4 + kn % 12)::DOUBLE END AS sw2_period_s, "
          "CASE WHEN n > 1 THEN ((kn * 53 + u * 7) % 360)::DOUBLE END AS sw2_direction_deg, "
          f"CASE WHEN kx % 21 <> 0 THEN v * ({SCALE}::DOUBLE * 1.1::DOUBLE) END AS combined_height_m, "
          "(4 + kx % 15) * 1.0371::DOUBLE AS combined_period_s, ((kx * 17) % 360)::DOUBLE AS combined_direction_deg, "
          "cycle_utc + INTERVAL 6 HOURS AS ingest_utc FROM fgroup",
    "fa": "SELECT * FROM fc WHERE model = 'A'",
    "fb": "SELECT * FROM fc WHERE model = 'B'",
    "pair": f"SELECT station, cycle_utc, valid_utc, lead_hours, {_ab} FROM fa a JOIN fb b "
            "USING (station, cycle_utc, valid_utc, lead_hours)",
    "pairf": f"SELECT station, cycle_utc, valid_utc, lead_hours, {_ab_plain}, "
             f"CASE WHEN {_use} THEN b_combined_height_m * 3.28084 ELSE b_sw1_height_ft END AS b_sw1_height_ft, "
             f"CASE WHEN {_use} THEN b_combined_period_s ELSE b_sw1_period_s END AS b_sw1_period_s, "
             f"CASE WHEN {_use} THEN b_combined_direction_deg ELSE b_sw1_direction_deg END AS b_sw1_direction_deg, "
             f"CASE WHEN {_use} THEN 'combined_fallback' WHEN b_sw1_height_ft IS NULL THEN 'missing' "
             "ELSE 'partition' END AS b_sw1_source FROM pair",
    "obsh": f"SELECT *, {snap('valid_utc')} AS hour_utc FROM obs",
    "obsr": "SELECT *, row_number() OVER (PARTITION BY station, hour_utc, partition ORDER BY ingest_utc DESC, "
            "abs(epoch_us(valid_utc) - epoch_us(hour_utc)), valid_utc DESC) AS rn FROM obsh",
    "obsw": "SELECT station, hour_utc, "
            + ", ".join(f"max(CASE WHEN partition = {p} THEN {c} END) AS obs_sw{p}_{n}" for p in (1, 2) for c, n in (
                ("hs_m * 3.28084", "height_ft"), ("tp_s", "period_s"), ("dp_deg", "direction_deg")))
            + " FROM obsr WHERE rn = 1 AND partition IN (1, 2) GROUP BY station, hour_utc",
    "paired": "SELECT p.*, " + ", ".join(f"o.obs_{v}" for v in SWELL_VARS)
              + " FROM pairf p LEFT JOIN obsw o ON p.station = o.station AND o.hour_utc = p.valid_utc WHERE "
              + " OR ".join("(" + " AND ".join(f"o.obs_sw{p}_{x} IS NOT NULL" for x in ("height_ft", "period_s", "direction_deg"))
                            + ")" for p in (1, 2)),
    "cyc": "SELECT cycle_utc, row_number() OVER (ORDER BY cycle_utc DESC) AS back, count(*) OVER () AS n "
           "FROM (SELECT DISTINCT cycle_utc FROM paired)",
    "cut": "SELECT min(cycle_utc) AS test_from FROM cyc WHERE back <= greatest(1, round_even(n * 0.15, 0))",
    "train": "SELECT * FROM paired WHERE cycle_utc < (SELECT test_from FROM cut)",
    "test": "SELECT * FROM paired WHERE cycle_utc >= (SELECT test_from FROM cut)",
    "bias0": " UNION ALL ".join(
        [f"SELECT station, lead_hours, '{v}' AS variable, avg(obs_{v} - (a_{v} + b_{v}) / 2.0) AS bias, "
         f"NULL::DOUBLE AS s, NULL::DOUBLE AS c, count(obs_{v} - (a_{v} + b_{v}) / 2.0) AS n FROM train GROUP BY 1, 2"
         for v in SCALARS]
        + [f"SELECT station, lead_hours, '{v}' AS variable, NULL::DOUBLE AS bias, "
           f"avg({sind('d')}) AS s, avg({cosd('d')}) AS c, count(d) AS n FROM "
           f"(SELECT station, lead_hours, {cdiff(f'obs_{v}', circ_mean(f'a_{v}', f'b_{v}'))} AS d FROM train) GROUP BY 1, 2"
           for v in DIRECTIONS]),
    "bias": "SELECT * FROM bias0 WHERE n > 0",
    "biass": "SELECT x.station, x.lead_hours, x.variable, "
             + ", ".join(f"sum(w * (y.n * y.{c}) ORDER BY y.lead_hours) / sum(w * y.n) AS {c}" for c in ("bias", "s", "c")) + ", any_value(x.n) AS n "
             "FROM bias x JOIN (SELECT *, unnest([-2, -1, 0, 1, 2]) AS k FROM bias) y ON x.station = y.station AND "
             f"x.variable = y.variable AND x.lead_hours = y.lead_hours + y.k * {LEAD_STEP_H} "
             "CROSS JOIN LATERAL (SELECT 3 - abs(y.k) AS w) GROUP BY 1, 2, 3",
    "pred": "SELECT t.*, "
            + ", ".join(f"(a_{v} + b_{v}) / 2.0 + coalesce((SELECT bias FROM bias q WHERE q.station = t.station AND "
                        f"q.lead_hours = t.lead_hours AND q.variable = '{v}'), 0.0) AS pred_{v}" for v in SCALARS)
            + ", "
            + ", ".join(m360(f"{circ_mean(f'a_{v}', f'b_{v}')} + "
                             + sc2deg(f"coalesce((SELECT s FROM bias q WHERE q.station = t.station AND q.lead_hours = t.lead_hours AND q.variable = '{v}'), 0.0)",
                                      f"coalesce((SELECT c FROM bias q WHERE q.station = t.station AND q.lead_hours = t.lead_hours AND q.variable = '{v}'), 1.0)"))
                        + f" AS pred_{v}" for v in DIRECTIONS)
            + " FROM test t",
    "cov": "SELECT station, cycle_utc, bool_or(in_a) AS in_a, bool_or(in_b) AS in_b, "
           "count(*) FILTER (WHERE in_a AND in_b) AS shared, count(*) FILTER (WHERE in_a AND in_b AND seen) AS matched FROM ("
           "SELECT h.*, o.station IS NOT NULL AS seen FROM (SELECT station, cycle_utc, valid_utc, bool_or(model = 'A') AS in_a, "
           "bool_or(model = 'B') AS in_b FROM fc GROUP BY 1, 2, 3) h LEFT JOIN (SELECT DISTINCT station, hour_utc FROM obsh "
           "WHERE partition IN (1, 2) AND hs_m IS NOT NULL AND tp_s IS NOT NULL AND dp_deg IS NOT NULL) o "
           "ON h.station = o.station AND h.valid_utc = o.hour_utc) GROUP BY 1, 2",
    # The test data is sparse, so the paired share is set to a quarter instead of 95 %.
    "covp": "SELECT *, shared > 0 AND matched / shared::DOUBLE >= 0.95 AS paired FROM cov",
    "ser": f"SELECT station, date_trunc('hour', ts)::TIMESTAMP AS t, avg(value) * {SCALE} AS v FROM ev GROUP BY 1, 2",
    "serw": "SELECT *, lag(v) OVER w AS pv, lead(v) OVER w AS nv, lag(t) OVER w AS pt, lead(t) OVER w AS nt "
            "FROM ser WINDOW w AS (PARTITION BY station ORDER BY t)",
    "turns": "SELECT *, CASE WHEN v >= pv AND v >= nv THEN 'H' ELSE 'L' END AS type FROM serw "
             "WHERE pv IS NOT NULL AND nv IS NOT NULL AND NOT (pv = v AND v = nv) "
             "AND ((v >= pv AND v >= nv) OR (v <= pv AND v <= nv))",
    "spb": "SELECT printf('sp%02d', label) AS station, " + sec("1704067200 + vec_id * 1800") + " AS ts, vec_id, g.i, "
           "0.02::DOUBLE + 0.0075::DOUBLE * g.i AS freq, abs(embedding[g.i + 1]::DOUBLE) AS energy, "
           "CASE WHEN (vec_id + g.i) % 29 <> 0 THEN ((vec_id * 7 + g.i * 11) % 360)::DOUBLE END AS dir "
           "FROM embeddings, LATERAL (SELECT unnest(range(64)) AS i) g",
    "spw": "SELECT *, CASE WHEN lag(freq) OVER w IS NULL THEN lead(freq) OVER w - freq WHEN lead(freq) OVER w IS NULL "
           "THEN freq - lag(freq) OVER w ELSE (lead(freq) OVER w - lag(freq) OVER w) / 2.0 END AS bw "
           "FROM spb WINDOW w AS (PARTITION BY vec_id ORDER BY i)",
    "site": "SELECT s_suppkey AS site, printf('ln%05d', s_suppkey // 8) AS line, printf('r%02d', s_nationkey) AS region, "
            "-42.0::DOUBLE + (s_suppkey * 7919 % 2200) / 100.0::DOUBLE AS lat, 95.0::DOUBLE + (s_suppkey * 104729 % 3000) / 100.0::DOUBLE AS lon, "
            "(s_suppkey * 37 % 360)::DOUBLE AS shore_normal, (s_suppkey % 41 - 20)::INTEGER AS tide_hi_offset, "
            "(s_suppkey % 31 - 15)::INTEGER AS tide_lo_offset FROM supplier",
    "rd": "SELECT l_suppkey AS site, l_shipdate + to_hours(l_linenumber * 3) AS time, l_quantity * 0.0987654321::DOUBLE AS hs_m, "
          "10.0::DOUBLE + (l_orderkey % 90) / 10.0::DOUBLE AS tp_s, 200.0::DOUBLE + (l_partkey % 600) / 10.0::DOUBLE AS dp_deg, "
          "l_orderkey AS rid, l_partkey AS rid2 FROM lineitem",
    "lrd": "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY time DESC, rid DESC, rid2 DESC, "
           "hs_m DESC) AS rn FROM rd) WHERE rn = 1",
    "sent": "SELECT s.*, l.time, l.hs_m, l.tp_s, l.dp_deg, l.rid, l.rid2, max(l.time) OVER (PARTITION BY s.line) AS now "
            "FROM site s JOIN lrd l USING (site)",
    "mpart": "SELECT l_suppkey AS sid, (['sw1_height_ft', 'sw1_period_s', 'sw1_direction_deg', 'sw2_height_ft', 'sw2_period_s', "
             "'sw2_direction_deg', 'surfer_f1'])[l_linenumber] AS variable, avg(l_discount + l_tax * 0.37) AS model_value, "
             "avg(l_discount * 1.3) AS ref_value FROM lineitem GROUP BY l_suppkey, l_linenumber",
    "mdl": "SELECT s_suppkey AS sid, printf('g%d', n_regionkey) AS scope, printf('sea+%s_%s_%.2f_v%d', "
           "CASE WHEN s_suppkey % 2 = 0 THEN 'baseline' ELSE 'ML' END, strftime(trained_utc, '%y%m%d'), "
           "0.25::DOUBLE + (s_suppkey % 50) / 100.0::DOUBLE, s_suppkey) AS name, trained_utc, "
           "n * (1 + s_suppkey % 3) AS n_test_rows FROM (SELECT l_suppkey, count(*) AS n, max(l_shipdate) AS trained_utc "
           "FROM lineitem GROUP BY 1) JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey",
    "skill": "SELECT sid, CASE WHEN count(s) = 7 THEN sum(w * s) END AS composite_skill, "
             "max(CASE WHEN variable = 'sw1_height_ft' THEN s END) AS sw1_height_skill FROM (SELECT *, "
             "CASE variable WHEN 'sw1_height_ft' THEN 0.25 WHEN 'sw1_period_s' THEN 0.25 WHEN 'surfer_f1' THEN 0.30 ELSE 0.05 END::DOUBLE AS w, "
             "CASE WHEN variable = 'surfer_f1' THEN (model_value - ref_value) / greatest(0.01, 1.0 - ref_value) "
             "WHEN ref_value > 0 THEN 1.0 - model_value / ref_value END AS s FROM mpart) GROUP BY sid",
    "mrank": "SELECT m.*, s.composite_skill, s.sw1_height_skill FROM mdl m JOIN skill s USING (sid)",
}
