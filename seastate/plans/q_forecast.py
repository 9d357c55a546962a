"""Pairing, coverage, correction, metrics and registry queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import circular as C
from ..functions import rules as R
from ..functions import timefn as T
from ..functions import units as U
from ..operators import bias as B
from ..operators import metrics as M
from ..operators import pairing as P
from ..operators import registry as G
from ..operators import waves as Wv
from ..operators.ordered import latest_by
from ..session import materialise
from ..sources import archive as A
from ..sources import tables as Tb
from .ctes import (DIRECTIONS, FORECAST_VALUES, LEAD_STEP_H, OBS_COLS, SCALARS, SWELL_VARS, band_sql, cat_rank, cdiff, circ_mean, iso, m2ft, r6,
                   rint, snap)
from .registry import query

KEYS = f"station, {iso('cycle_utc')} AS cycle_utc, {iso('valid_utc')} AS valid_utc, lead_hours"
NOW_2024 = "2024-02-01 00:00:00"


def bands():
    return R.load_bands()


def training(v):
    return P.paired_dataset(v.a, v.b, v.obs)


def split(v):
    return P.time_split(training(v))


def stored_split(v):
    """The split on a written copy, for work that reads the training table several times."""
    return P.time_split(materialise(training(v), "paired"))


def fitted(v):
    return B.fit_bias(stored_split(v).filter(~F.col("is_test")))


def predicted(v):
    d = stored_split(v)
    return B.apply_bias(d.filter(F.col("is_test")).drop("is_test"), B.fit_bias(d.filter(~F.col("is_test"))))


def cover(v):
    return P.cycle_coverage(v.a, v.b, v.obs)


@query("flagship_agreement", f"""
SELECT station, lead_hours, count(*) AS n, {r6('avg(abs(a_sw1_height_ft - obs_sw1_height_ft))')} AS a_mae,
 {r6('avg(abs(b_sw1_height_ft - obs_sw1_height_ft))')} AS b_mae,
 count(*) FILTER (WHERE ac = oc) AS a_agree, count(*) FILTER (WHERE bc = oc) AS b_agree,
 {r6('count(*) FILTER (WHERE ac = oc AND bc = oc) / count(*)::DOUBLE')} AS both_share
FROM (SELECT *, {band_sql('a_sw1_height_ft', 'a_sw1_period_s')} AS ac, {band_sql('b_sw1_height_ft', 'b_sw1_period_s')} AS bc,
 {band_sql('obs_sw1_height_ft', 'obs_sw1_period_s')} AS oc FROM paired) GROUP BY station, lead_hours""")
def _(v):
    d = training(v)
    for p, name in (("a", "ac"), ("b", "bc"), ("obs", "oc")):
        d = d.withColumn(name, R.swell_category(F.col(f"{p}_sw1_height_ft"), F.col(f"{p}_sw1_period_s"), bands()))
    err = lambda m: F.avg(F.abs(F.col(f"{m}_sw1_height_ft") - F.col("obs_sw1_height_ft")))
    same = lambda m: F.col(f"{m}c") == F.col("oc")
    return d.groupBy("station", "lead_hours").agg(
        F.count("*").alias("n"), err("a").alias("a_mae"), err("b").alias("b_mae"),
        F.count_if(same("a")).alias("a_agree"), F.count_if(same("b")).alias("b_agree"),
        (F.count_if(same("a") & same("b")) / F.count("*")).alias("both_share"))


@query("j01_pair_models", f"SELECT {KEYS}, " + ", ".join(f"{r6(f'{m}_{x}')} AS {m}_{x}" for x in FORECAST_VALUES for m in "ab") + " FROM pair")
def _(v):
    return P.pair_models(v.a, v.b)


@query("j02_attach_obs", f"SELECT {KEYS}, " + ", ".join(f"{r6(f'obs_{x}')} AS obs_{x}" for x in SWELL_VARS) + """
 FROM pair LEFT JOIN (SELECT station AS st, hour_utc, """ + ", ".join(f"obs_{x}" for x in SWELL_VARS) + """ FROM obsw) o ON st = station AND hour_utc = valid_utc""")
def _(v):
    return P.attach_obs(P.pair_models(v.a, v.b), v.obs).select(*P.PAIR_KEYS, *[f"obs_{x}" for x in SWELL_VARS])


@query("j04_three_way_agreement", f"""
WITH lo AS (SELECT * FROM obsr WHERE rn = 1 AND partition = 1), lf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY station, model, valid_utc
 ORDER BY cycle_utc DESC) AS rn FROM fc WHERE lead_hours >= 0) WHERE rn = 1)
SELECT o.station, {iso('o.hour_utc')} AS hour_utc, oc AS observed_cat,
 CASE WHEN a.sw1_height_ft IS NOT NULL AND a.sw1_period_s IS NOT NULL AND b.sw1_height_ft IS NOT NULL AND b.sw1_period_s IS NOT NULL AND oc IS NOT NULL
 THEN {band_sql('a.sw1_height_ft', 'a.sw1_period_s')} = oc AND {band_sql('b.sw1_height_ft', 'b.sw1_period_s')} = oc END AS agreement
FROM (SELECT *, CASE WHEN hs_m > 0 AND tp_s > 0 THEN {band_sql('(hs_m * 3.28084)', 'tp_s')} END AS oc FROM lo) o
LEFT JOIN (SELECT * FROM lf WHERE model = 'A') a ON a.station = o.station AND a.valid_utc = o.hour_utc
LEFT JOIN (SELECT * FROM lf WHERE model = 'B') b ON b.station = o.station AND b.valid_utc = o.hour_utc""")
def _(v):
    """Observed category against both models' latest cycle; null where a side is missing."""
    return P.three_way_agreement(P.hourly_obs(v.obs, (1,)), v.forecast, bands()).select(
        "station", "hour_utc", "observed_cat", "agreement")


@query("p03_window_filter", f"SELECT station, {iso('valid_utc')} AS valid_utc, partition, {r6('hs_m')} AS hs_m FROM obs "
       "WHERE valid_utc >= TIMESTAMP '2024-01-10 00:00:00' AND valid_utc < TIMESTAMP '2024-01-20 00:00:00'")
def _(v):
    return P.in_window(v.obs, "valid_utc", "2024-01-10", "2024-01-20").select("station", "valid_utc", "partition", "hs_m")


@query("p04_training_ready", f"SELECT station, {iso('valid_utc')} AS valid_utc, partition, {r6('hs_m')} AS hs_m, tp_s, dp_deg FROM obs "
       "WHERE partition IN (1, 2) AND hs_m IS NOT NULL AND tp_s IS NOT NULL AND dp_deg IS NOT NULL")
def _(v):
    return P.training_ready(v.obs).select("station", "valid_utc", "partition", "hs_m", "tp_s", "dp_deg")


@query("p05_paired_dataset", f"SELECT {KEYS}, b_sw1_source, " + ", ".join(f"{r6(x)} AS {x}" for x in (
    [f"a_{s}" for s in SWELL_VARS] + [f"b_{s}" for s in SWELL_VARS] + [f"obs_{s}" for s in SWELL_VARS])) + " FROM paired")
def _(v):
    return training(v).select(*P.PAIR_KEYS, "b_sw1_source", *[f"{m}_{s}" for m in ("a", "b", "obs") for s in SWELL_VARS])


@query("p06_target_counts", " UNION ALL ".join(f"SELECT '{s}' AS variable, count(obs_{s}) AS n FROM train" for s in SWELL_VARS))
def _(v):
    return P.target_counts(stored_split(v).filter(~F.col("is_test")))


@query("p07_combined_fallback", f"SELECT {KEYS}, b_sw1_source, {r6('b_sw1_height_ft')} AS b_sw1_height_ft, {r6('b_sw1_period_s')} AS b_sw1_period_s, "
       f"{r6('b_sw1_direction_deg')} AS b_sw1_direction_deg FROM pairf")
def _(v):
    return Wv.combined_fallback(P.pair_models(v.a, v.b), "b_", "b_sw1_source").select(
        *P.PAIR_KEYS, "b_sw1_source", "b_sw1_height_ft", "b_sw1_period_s", "b_sw1_direction_deg")


def raw_parts(v):
    """Forecast rows as raw partitions in metres, the shape a feed delivers."""
    return v.forecast.select("station", "model", "cycle_utc", "valid_utc", "ingest_utc",
                             (F.col("sw1_height_ft") / 3).alias("h1"), F.col("sw1_period_s").alias("p1"), F.col("sw1_direction_deg").alias("d1"),
                             (F.col("sw2_height_ft") / 2).alias("h2"), F.col("sw2_period_s").alias("p2"), F.col("sw2_direction_deg").alias("d2"),
                             F.col("combined_height_m").alias("hc"), F.col("combined_period_s").alias("pc"), F.col("combined_direction_deg").alias("dc"))


def records(v, scale=1.0, fallback=True):
    return Wv.wave_records(raw_parts(v), ["station", "model", "cycle_utc", "ingest_utc"], "valid_utc",
                           [("h1", "p1", "d1"), ("h2", "p2", "d2")], ("hc", "pc", "dc"), scale, fallback)


_RAW = "(SELECT *, sw1_height_ft / 3 AS h1, sw2_height_ft / 2 AS h2 FROM fc)"
_COMP = f"""
 raw AS (SELECT * FROM {_RAW}),
 comp AS (SELECT station, model, cycle_utc, valid_utc, 1 AS pos, 'swell' AS type, {m2ft('h1')} AS h, round(sw1_period_s * SCL, 1) AS p, sw1_direction_deg AS d,
  round({m2ft('h1')} * {m2ft('h1')} * (sw1_period_s * SCL), 1) AS e FROM raw WHERE h1 > 0 AND sw1_period_s >= 5
  UNION ALL SELECT station, model, cycle_utc, valid_utc, 2, 'swell2', {m2ft('h2')}, round(sw2_period_s * SCL, 1), sw2_direction_deg,
  round({m2ft('h2')} * {m2ft('h2')} * (sw2_period_s * SCL), 1) FROM raw WHERE h2 > 0 AND sw2_period_s >= 5),
 top AS (SELECT *, row_number() OVER (PARTITION BY station, model, cycle_utc, valid_utc ORDER BY e DESC, pos) AS rn FROM comp)"""


@query("p08_o01_components", f"""
WITH {_COMP.replace('SCL', '1.2::DOUBLE')}
SELECT station, model, {iso('cycle_utc')} AS cycle_utc, {iso('valid_utc')} AS valid_utc, rn::INTEGER AS rank, type, {r6('h')} AS height_ft, {r6('p')} AS period_s,
 {r6('d')} AS direction_deg, {r6('e')} AS energy FROM top""")
def _(v):
    r = records(v, Wv.MEAN_TO_PEAK, False).select("station", "model", "cycle_utc", F.col("time").alias("valid_utc"),
                                                  F.posexplode("components").alias("pos", "c"))
    return r.select("station", "model", "cycle_utc", "valid_utc", (F.col("pos") + 1).alias("rank"), "c.type", "c.height_ft", "c.period_s",
                    "c.direction_deg", "c.energy")


@query("p09_wave_records", f"""
WITH {_COMP.replace('SCL', '1.0371::DOUBLE')}
SELECT station, model, {iso('cycle_utc')} AS cycle_utc, {iso('time')} AS time, {r6('h')} AS wave_height_ft, {r6('p')} AS wave_period_s, {r6('d')} AS wave_direction_deg,
 {r6('e')} AS energy, {r6('coalesce(d, sw1_direction_deg, sw2_direction_deg, combined_direction_deg)')} AS raw_direction_deg FROM (
SELECT r.station, r.model, r.cycle_utc, r.valid_utc AS time, coalesce(t.h, CASE WHEN t.rn IS NULL AND combined_height_m > 0 THEN {m2ft('combined_height_m')} END) AS h,
 coalesce(t.p, CASE WHEN t.rn IS NULL AND combined_height_m > 0 THEN round(combined_period_s, 1) END) AS p,
 coalesce(t.d, CASE WHEN t.rn IS NULL AND combined_height_m > 0 THEN combined_direction_deg END) AS d,
 coalesce(t.e, CASE WHEN t.rn IS NULL AND combined_height_m > 0 THEN round({m2ft('combined_height_m')} * {m2ft('combined_height_m')} * combined_period_s, 1) END) AS e,
 r.sw1_direction_deg, r.sw2_direction_deg, r.combined_direction_deg
FROM raw r LEFT JOIN (SELECT * FROM top WHERE rn = 1) t ON t.station = r.station AND t.model = r.model AND t.cycle_utc = r.cycle_utc AND t.valid_utc = r.valid_utc)""")
def _(v):
    return records(v, 1.0371).select("station", "model", "cycle_utc", "time", "wave_height_ft", "wave_period_s", "wave_direction_deg", "energy", "raw_direction_deg")


@query("p02_records_to_rows", f"""
WITH {_COMP.replace('SCL', '1.0::DOUBLE')}
SELECT r.station, r.model, {iso('r.cycle_utc')} AS cycle_utc, {iso('r.valid_utc')} AS valid_utc, r.lead_hours, {r6('x.h')} AS sw1_height_ft, {r6('x.p')} AS sw1_period_s,
 {r6('x.d')} AS sw1_direction_deg, {r6('y.h')} AS sw2_height_ft, {r6('y.p')} AS sw2_period_s, {r6('y.d')} AS sw2_direction_deg,
 {r6('r.combined_height_m')} AS combined_height_m FROM raw r
LEFT JOIN (SELECT * FROM top WHERE rn = 1) x ON x.station = r.station AND x.model = r.model AND x.cycle_utc = r.cycle_utc AND x.valid_utc = r.valid_utc
LEFT JOIN (SELECT * FROM top WHERE rn = 2) y ON y.station = r.station AND y.model = r.model AND y.cycle_utc = r.cycle_utc AND y.valid_utc = r.valid_utc""")
def _(v):
    return Wv.records_to_rows(records(v), "station", F.col("model"), "cycle_utc", "ingest_utc").select(
        *P.PAIR_KEYS, "model", *SWELL_VARS, "combined_height_m")


@query("p14_time_split", f"SELECT {KEYS}, cycle_utc >= (SELECT test_from FROM cut) AS is_test FROM paired")
def _(v):
    return split(v).select(*P.PAIR_KEYS, "is_test")


@query("p14_split_threshold", f"""
SELECT {iso('min(cycle_utc)')} AS test_from, max(n) AS n_cycles, count(*) AS n_test_cycles FROM cyc WHERE back <= greatest(1, round_even(n * 0.15, 0))""")
def _(v):
    return P.split_threshold(training(v))


@query("p18_raw_predictions", f"SELECT {KEYS}, " + ", ".join(f"{r6(f'a_{s}')} AS pred_{s}" for s in SWELL_VARS) + " FROM test")
def _(v):
    return B.raw_predictions(stored_split(v).filter(F.col("is_test")), "a").select(*P.PAIR_KEYS, *[f"pred_{s}" for s in SWELL_VARS])


_COVCOLS = "count(*) FILTER (WHERE in_a) AS a_cycles, count(*) FILTER (WHERE in_b) AS b_cycles, count(*) FILTER (WHERE paired) AS paired_cycles"


@query("a08_u02_paired_cycles", f"SELECT station, {iso('cycle_utc')} AS cycle_utc, in_a, in_b, shared, matched, paired FROM covp")
def _(v):
    return cover(v)


@query("a09_station_coverage", f"""
SELECT station, {_COVCOLS}, CAST(coalesce(sum(matched) FILTER (WHERE paired), 0) AS BIGINT) AS paired_samples,
 {r6('round(least(1.0, count(*) FILTER (WHERE paired) / 365.0::DOUBLE), 3)')} AS progress_target,
 {iso('coalesce(min(cycle_utc) FILTER (WHERE in_a), min(cycle_utc) FILTER (WHERE in_b))')} AS earliest,
 {iso('coalesce(max(cycle_utc) FILTER (WHERE in_a), max(cycle_utc) FILTER (WHERE in_b))')} AS latest FROM covp GROUP BY station""")
def _(v):
    return P.station_coverage(cover(v))


@query("a10_doy_histogram", """
SELECT station, strftime(cycle_utc, '%m-%d') AS doy, count(*) FILTER (WHERE paired) AS paired_runs, count(*) FILTER (WHERE in_a) AS a_runs,
 count(*) FILTER (WHERE in_b) AS b_runs FROM covp GROUP BY GROUPING SETS ((station, strftime(cycle_utc, '%m-%d')), (strftime(cycle_utc, '%m-%d')))""")
def _(v):
    return P.doy_histogram(cover(v))


@query("a11_coverage_fraction", f"""
SELECT count(DISTINCT strftime(cycle_utc, '%m-%d')) FILTER (WHERE paired) AS paired_days,
 {r6("round(count(DISTINCT strftime(cycle_utc, '%m-%d')) FILTER (WHERE paired) / 365.0, 2)")} AS coverage_frac FROM covp""")
def _(v):
    return P.coverage_fraction(cover(v))


@query("a12_archive_summary", f"""
SELECT {r6('round(count(*) FILTER (WHERE paired) / count(DISTINCT station)::DOUBLE, 1)')} AS mean_paired_cycles,
 string_agg(DISTINCT year(cycle_utc)::VARCHAR, ',' ORDER BY year(cycle_utc)::VARCHAR) AS years_seen FROM covp""")
def _(v):
    return P.archive_summary(cover(v))


_BIAS_COLS = f"station, lead_hours, variable, {r6('bias')} AS bias, {r6('s')} AS s, {r6('c')} AS c, n"


@query("a01_a02_bias_table", f"SELECT {_BIAS_COLS} FROM bias")
def _(v):
    return fitted(v)


@query("w13_smooth_leads", f"SELECT {_BIAS_COLS} FROM biass")
def _(v):
    """Each lead with its two neighbours on either side; the forecasts' leads lie three hours apart."""
    return B.smooth_leads(fitted(v), 2, LEAD_STEP_H)


@query("j11_apply_bias", f"SELECT {KEYS}, " + ", ".join(f"{r6(f'pred_{s}')} AS pred_{s}" for s in SWELL_VARS) + " FROM pred")
def _(v):
    return predicted(v).select(*P.PAIR_KEYS, *[f"pred_{s}" for s in SWELL_VARS])


_ERR = " UNION ALL ".join(
    f"SELECT '{s}' AS variable, avg(abs(d)) AS mae, sqrt(avg(d * d)) AS rmse, avg(d) AS bias, count(d) AS n FROM "
    f"(SELECT {cdiff(f'pred_{s}', f'obs_{s}') if s in DIRECTIONS else f'pred_{s} - obs_{s}'} AS d FROM pred)" for s in SWELL_VARS)


@query("a03_a04_error_metrics", f"SELECT variable, {r6('mae')} AS mae, {r6('rmse')} AS rmse, {r6('bias')} AS bias, n FROM ({_ERR}) WHERE n > 0")
def _(v):
    return M.error_metrics(predicted(v))


_CATS = (f"(SELECT *, {band_sql('obs_sw1_height_ft', 'obs_sw1_period_s')} AS oc, {band_sql('pred_sw1_height_ft', 'pred_sw1_period_s')} AS pc FROM pred "
         "WHERE obs_sw1_height_ft IS NOT NULL AND obs_sw1_period_s IS NOT NULL AND pred_sw1_height_ft IS NOT NULL AND pred_sw1_period_s IS NOT NULL)")
_CLASSES = " UNION ALL ".join(
    [f"SELECT '{c}' AS category, oc = '{c}' AS y, pc = '{c}' AS p FROM {_CATS}" for c in R.SURF_CLASSES]
    + [f"SELECT '{M.POOLED}', oc NOT IN ('FLAT', 'WEAK'), pc NOT IN ('FLAT', 'WEAK') FROM {_CATS}"])
_CONF = (f"SELECT category, count(*) FILTER (WHERE y AND p) AS tp, count(*) FILTER (WHERE NOT y AND p) AS fp, count(*) FILTER (WHERE y AND NOT p) AS fn, "
         f"count(*) FILTER (WHERE NOT y AND NOT p) AS tn, count(*) AS n FROM ({_CLASSES}) GROUP BY category")


def _ratio(a, b):
    return f"(CASE WHEN {b} <> 0 THEN ({a})::DOUBLE / ({b}) END)"


_SENS, _PPV = _ratio("tp", "(tp + fn)"), _ratio("tp", "(tp + fp)")
_F1 = f"(CASE WHEN {_SENS} + {_PPV} > 0 THEN 2.0 * {_SENS} * {_PPV} / ({_SENS} + {_PPV}) END)"


@query("a05_a06_confusion", f"""
SELECT category, tp, fp, fn, tn, n, {r6(_SENS)} AS sens, {r6(_ratio('tn', '(tn + fp)'))} AS spec, {r6(_PPV)} AS ppv, {r6(_ratio('tn', '(tn + fn)'))} AS npv,
 {r6(_F1)} AS f1 FROM ({_CONF})""")
def _(v):
    return M.confusion(M.categorise_pair(predicted(v), bands()), "obs_cat", "pred_cat")


@query("a07_composite_skill", f"SELECT sid, {r6('composite_skill')} AS composite_skill, {r6('sw1_height_skill')} AS sw1_height_skill FROM skill")
def _(v):
    return M.composite_skill(v.model_parts, ["sid"])


def ranked_models(v):
    return v.models.join(M.composite_skill(v.model_parts, ["sid"]), "sid")


@query("o02_select_models", f"""
WITH best AS (SELECT scope, name FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY composite_skill DESC, trained_utc DESC, name DESC) AS r FROM mrank
 WHERE composite_skill IS NOT NULL AND n_test_rows >= 1000 AND sw1_height_skill >= 0) WHERE r = 1)
SELECT scope, name, {r6('composite_skill')} AS composite_skill, is_best, slot::INTEGER AS slot FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY is_best DESC,
 trained_utc DESC, name DESC) AS slot FROM (SELECT m.*, coalesce(m.name = b.name, FALSE) AS is_best FROM mrank m LEFT JOIN best b USING (scope))) WHERE slot <= 3""")
def _(v):
    return G.select_models(ranked_models(v), ["scope"]).select("scope", "name", "composite_skill", "is_best", "slot")


@query("u05_others_than_best", """
SELECT scope, name FROM mrank m WHERE NOT EXISTS (SELECT 1 FROM (SELECT scope AS s, max(composite_skill) AS c FROM mrank GROUP BY 1) x
 WHERE x.s = m.scope AND x.c = m.composite_skill)""")
def _(v):
    m = ranked_models(v)
    best = latest_by(m, ["scope"], [F.col("composite_skill")], ["name"])
    return G.others_than_best(m, best, ["scope", "name"]).select("scope", "name")


@query("p15_unseen_rows", f"""
SELECT name, {KEYS.replace('station', 'p.station', 1)} FROM paired p JOIN (SELECT station, 'early' AS name, min(cycle_utc) + INTERVAL 10 DAYS AS trained_utc FROM paired GROUP BY 1
 UNION ALL SELECT station, 'late', min(cycle_utc) + INTERVAL 20 DAYS FROM paired GROUP BY 1) m ON m.station = p.station AND p.cycle_utc > m.trained_utc""")
def _(v):
    p = training(v)
    first = p.groupBy("station").agg(F.min("cycle_utc").alias("c0"))
    models = first.select("station", F.explode(F.array(F.struct(F.lit("early").alias("name"), F.lit(10).alias("d")),
                                                       F.struct(F.lit("late").alias("name"), F.lit(20).alias("d")))).alias("m"), "c0")
    models = models.select("station", "m.name", F.timestamp_seconds(F.unix_timestamp("c0") + F.col("m.d") * 86400).alias("trained_utc"))
    return G.unseen_rows(p, models, ["station"]).select("name", *P.PAIR_KEYS)


def _eval_rows(v):
    """Both raw models on the holdout as if they were two stored models."""
    d = stored_split(v).filter(F.col("is_test"))
    return (B.raw_predictions(d, "a").withColumn("name", F.lit("raw_A"))
            .unionByName(B.raw_predictions(d, "b").withColumn("name", F.lit("raw_B"))))


@query("a27_t08_evaluation_row", "WITH raw2 AS (SELECT 'raw_A' AS name, cycle_utc, " + ", ".join(f"obs_{s}, a_{s} AS p_{s}" for s in SWELL_VARS)
       + " FROM test UNION ALL SELECT 'raw_B', cycle_utc, " + ", ".join(f"obs_{s}, b_{s}" for s in SWELL_VARS) + " FROM test), d AS (SELECT name, cycle_utc, "
       + ", ".join(f"{cdiff(f'p_{s}', f'obs_{s}') if s in DIRECTIONS else f'p_{s} - obs_{s}'} AS d_{s}" for s in SWELL_VARS)
       + f", CASE WHEN obs_sw1_height_ft IS NOT NULL AND obs_sw1_period_s IS NOT NULL AND p_sw1_height_ft IS NOT NULL AND p_sw1_period_s IS NOT NULL THEN {band_sql('obs_sw1_height_ft', 'obs_sw1_period_s')} NOT IN ('FLAT', 'WEAK') END AS y"
       + f", CASE WHEN obs_sw1_height_ft IS NOT NULL AND obs_sw1_period_s IS NOT NULL AND p_sw1_height_ft IS NOT NULL AND p_sw1_period_s IS NOT NULL THEN {band_sql('p_sw1_height_ft', 'p_sw1_period_s')} NOT IN ('FLAT', 'WEAK') END AS p FROM raw2), "
       "g AS (SELECT name, count(*) AS n_live_rows, count(DISTINCT cycle_utc) AS n_live_cycles, "
       + ", ".join(f"avg(abs(d_{s})) AS {s}_mae, sqrt(avg(d_{s} * d_{s})) AS {s}_rmse, avg(d_{s}) AS {s}_bias, count(d_{s}) AS {s}_n" for s in SWELL_VARS)
       + ", count(*) FILTER (WHERE y AND p) AS tp, count(*) FILTER (WHERE NOT y AND p) AS fp, count(*) FILTER (WHERE y AND NOT p) AS fn FROM d GROUP BY name) "
       "SELECT name, n_live_rows, n_live_cycles, " + ", ".join(f"{r6(f'{s}_{m}')} AS {s}_{m}" for s in SWELL_VARS for m in ("mae", "rmse", "bias"))
       + ", " + ", ".join(f"nullif({s}_n, 0) AS {s}_n" for s in SWELL_VARS) + f", {r6(_SENS)} AS surfer_sens, {r6(_PPV)} AS surfer_ppv, {r6(_F1)} AS surfer_f1 FROM g")
def _(v):
    rows = _eval_rows(v)
    counts = rows.groupBy("name").agg(F.count("*").alias("n_live_rows"), F.count_distinct("cycle_utc").alias("n_live_cycles"))
    cats = M.categorise_pair(rows, bands())
    return M.evaluation_row(M.error_metrics(rows, ["name"]), M.confusion(cats, "obs_cat", "pred_cat", ["name"]), counts, ["name"])


@query("a20_usage_counts", """
SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS calls FROM ev GROUP BY ROLLUP (strftime(ts, '%Y-%m-%d'), event_type)""")
def _(v):
    from ..operators.outlook import usage_counts
    return usage_counts(v.events, "event_type", "ts")


@query("a21_fallback_counts", "SELECT b_sw1_source, count(*) AS n FROM paired GROUP BY 1")
def _(v):
    return training(v).groupBy("b_sw1_source").agg(F.count("*").alias("n"))


@query("w01_latest_ingest", f"SELECT station, {iso('hour_utc')} AS hour_utc, partition, {r6('hs_m')} AS hs_m, tp_s, dp_deg, {iso('valid_utc')} AS valid_utc, "
       f"{iso('ingest_utc')} AS ingest_utc FROM obsr WHERE rn = 1")
def _(v):
    return P.hourly_obs(v.obs, (0, 1, 2))


@query("w03_latest_cycle", f"""
SELECT station, model, {iso('valid_utc')} AS valid_utc, {iso('cycle_utc')} AS cycle_utc, {r6('sw1_height_ft')} AS sw1_height_ft, sw1_period_s FROM (
 SELECT *, row_number() OVER (PARTITION BY station, model, valid_utc ORDER BY cycle_utc DESC) AS rn FROM fc WHERE lead_hours >= 0) WHERE rn = 1""")
def _(v):
    return Wv.latest_cycle(v.forecast, ["station", "model"], "valid_utc", "cycle_utc", ["sw1_height_ft", "sw1_period_s"])


@query("u01_union_roots", f"SELECT source, partition, count(*) AS n, {iso('min(valid_utc)')} AS first_utc, {iso('max(valid_utc)')} AS last_utc FROM obs GROUP BY 1, 2")
def _(v):
    hist, live = v.obs.filter(F.col("source") == "archive"), v.obs.filter(F.col("source") == "realtime")
    return hist.unionByName(live).groupBy("source", "partition").agg(
        F.count("*").alias("n"), F.min("valid_utc").alias("first_utc"), F.max("valid_utc").alias("last_utc"))


@query("u03_only_new_keys", f"""
SELECT DISTINCT station, {iso('hour_utc')} AS hour_utc, partition FROM obsh n WHERE source = 'realtime' AND NOT EXISTS (SELECT 1 FROM obsh o WHERE o.source = 'archive'
 AND o.station = n.station AND o.hour_utc = n.hour_utc AND o.partition = n.partition)""")
def _(v):
    o = v.obs.withColumn("hour_utc", T.snap_hour(F.col("valid_utc")))
    return Tb.only_new_keys(o.filter(F.col("source") == "realtime"), o.filter(F.col("source") == "archive"), ["station", "hour_utc", "partition"])


@query("u04_key_overwrite_merge", f"""
WITH h AS (SELECT station, hour_utc, source, max(hs_m) AS hs_m FROM obsh GROUP BY 1, 2, 3)
SELECT station, {iso('hour_utc')} AS hour_utc, {r6('hs_m')} AS hs_m, CASE WHEN source = 'archive' THEN 'kept' WHEN EXISTS (SELECT 1 FROM h o WHERE o.source = 'archive'
 AND o.station = n.station AND o.hour_utc = n.hour_utc) THEN 'replaced' ELSE 'added' END AS change FROM h n
WHERE source = 'realtime' OR NOT EXISTS (SELECT 1 FROM h o WHERE o.source = 'realtime' AND o.station = n.station AND o.hour_utc = n.hour_utc)""")
def _(v):
    h = v.obs.groupBy("station", T.snap_hour(F.col("valid_utc")).alias("hour_utc"), "source").agg(F.max("hs_m").alias("hs_m"))
    pick = lambda s: h.filter(F.col("source") == s).drop("source")
    return Tb.merge_counted(pick("archive"), pick("realtime"), ["station", "hour_utc"])


@query("j15_holdout_membership", f"SELECT {KEYS} FROM pair WHERE cycle_utc IN (SELECT cycle_utc FROM cyc WHERE cycle_utc >= (SELECT test_from FROM cut))")
def _(v):
    """All paired forecasts whose cycle is one of the holdout cycles."""
    held = split(v).filter(F.col("is_test")).select("cycle_utc").distinct()
    return P.pair_models(v.a, v.b).join(held, "cycle_utc", "left_semi").select(*P.PAIR_KEYS)


@query("t06_freshness_alarm", f"""
SELECT station, source, {iso('max(ingest_utc)')} AS last_write, {r6("(epoch(TIMESTAMP '2024-02-01 00:00:00') - epoch(max(ingest_utc))) / 3600.0")} AS hours_since,
 (epoch(TIMESTAMP '2024-02-01 00:00:00') - epoch(max(ingest_utc))) / 3600.0 > 24 AS alarm FROM obs GROUP BY station, source""")
def _(v):
    from ..streaming.ingest import freshness
    return freshness(v.obs, ["station", "source"], "ingest_utc", F.lit(NOW_2024).cast("timestamp"))


@query("t06_stale_models", f"""
SELECT scope, name, CAST(floor((epoch(nc) - epoch(trained_utc)) / 86400) AS INTEGER) AS age_days, floor((epoch(nc) - epoch(trained_utc)) / 86400) > 120 AS stale
FROM mdl JOIN (SELECT scope, max(trained_utc) AS nc FROM mdl GROUP BY 1) USING (scope)""")
def _(v):
    newest = v.models.select("scope", F.col("trained_utc").alias("cycle_utc"))
    return G.stale_models(v.models, newest, ["scope"]).select("scope", "name", "age_days", "stale")


@query("x05_correct_cycle", f"SELECT {KEYS}, b_sw1_source, " + ", ".join(
    f"{r6(c)} AS {c}" for c in [f"{m}_{s}" for m in "ab" for s in ("sw1_height_ft", "sw1_period_s", "sw1_direction_deg")])
    + ", " + ", ".join(f"{r6(f'(a_{s} + b_{s}) / 2.0 + coalesce((SELECT bias FROM bias q WHERE q.station = t.station AND q.lead_hours = t.lead_hours AND q.variable = {chr(39)}{s}{chr(39)}), 0.0)')} AS pred_{s}" for s in SCALARS) + " FROM pairf t")
def _(v):
    """Every paired forecast row corrected, the originals beside."""
    from ..operators.mlcorrect import correct_cycle
    return correct_cycle(P.pair_models(v.a, v.b), "baseline", fitted(v)).select(
        *P.PAIR_KEYS, "b_sw1_source", *[f"{m}_{s}" for m in "ab" for s in ("sw1_height_ft", "sw1_period_s", "sw1_direction_deg")],
        *[f"pred_{s}" for s in SCALARS])
