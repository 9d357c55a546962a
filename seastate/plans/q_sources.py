"""Sources, sinks and work lists on data that Spark derives from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..functions import units as U
from ..functions.arrays import stage
from ..operators import waves as Wv
from ..session import materialise, work_path
from ..sources import archive as A
from ..sources import jsonfeeds as J
from ..sources import tables as Tb
from ..sources import text as X
from .ctes import DIRECTIONS, FORECAST_VALUES, SCALARS, SWELL_VARS, iso, m2ft, r6, rint, sind, snap
from .registry import query

CARD = "(['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSW','SW','WSW','W','WNW','NW','NNW'])"


def station_lines(v):
    """Every event as one line of a station file, a header and a units line on top of each file."""
    k, ts = F.col("k"), F.col("ts")
    deg = F.when(k % 10 == 0, U.to_cardinal(((k * 37 + F.col("user_id") * 11) % 360).cast("double"))).otherwise(
        ((k * 37 + F.col("user_id") * 11) % 360).cast("string"))
    wvht = F.when(k == 7, "MM").otherwise(F.col("value").cast("string"))
    e = stage(stage(v.events, {"_deg": deg, "_wvht": wvht}), {"_at": F.date_format(ts, "yyyy MM dd HH mm"), "_k": k.cast("string")})
    data = e.select(F.col("station").alias("path"), (F.col("event_id") + 2).alias("pos"),
                    F.concat_ws(" ", "_at", F.lit("210"), "_k", "_wvht", "_k", "_deg").alias("value"))
    names = F.array(F.struct(F.lit(0).cast("long").alias("pos"), F.lit("#YY  MM DD hh mm WDIR WSPD WVHT   DPD MWD").alias("value")),
                    F.struct(F.lit(1).cast("long").alias("pos"), F.lit("#yr  mo dy hr mn degT m/s  m      sec degT").alias("value")))
    head = v.events.select(F.col("station").alias("path")).distinct().select("path", F.explode(names).alias("h")).select("path", "h.*")
    return data.unionByName(head)


_TXT = f"""(SELECT event_id, station, ts, date_trunc('minute', ts)::TIMESTAMP AS valid_utc, CASE WHEN k = 7 OR value IN (99, 999, 9999) THEN NULL ELSE value END AS hs_m,
 CASE WHEN k <> 99 THEN k::DOUBLE END AS tp_s, CASE WHEN k % 10 = 0 THEN floor((CAST({rint('((k * 37 + user_id * 11) % 360) / 22.5')} AS INTEGER) % 16) * 22.5)
 ELSE (k * 37 + user_id * 11) % 360 END::DOUBLE AS dp_deg FROM ev)"""


@query("s01_p01_station_text", f"SELECT station, event_id, {iso('valid_utc')} AS valid_utc, {r6('hs_m')} AS hs_m, tp_s, dp_deg, CASE WHEN tp_s IS NULL THEN NULL ELSE tp_s END AS wind_ms FROM {_TXT}")
def _(v):
    return X.parse_station(station_lines(v)).select(F.col("path").alias("station"), (F.col("pos") - 2).alias("event_id"), "valid_utc", "hs_m", "tp_s", "dp_deg", "wind_ms")


@query("s01_files_round_trip", f"SELECT station, event_id, {iso('valid_utc')} AS valid_utc, {r6('hs_m')} AS hs_m, tp_s, dp_deg FROM {_TXT}")
def _(v):
    """Station files, half of them with a plain header line, written below the shared folder and read whole."""
    root = work_path(v.spark, "station-files")
    odd = F.pmod(F.xxhash64("path"), F.lit(2)) == 1
    value = F.when(odd & (F.col("pos") == 0), F.regexp_replace("value", "^#", "")).otherwise(F.col("value"))
    # The number of a reading rides along as a column of its own.
    value = F.concat_ws(" ", value, F.when(F.col("pos") == 0, F.lit("ID")).otherwise((F.col("pos") - 2).cast("string")))
    lines = station_lines(v).filter(~(odd & (F.col("pos") == 1))).select(value.alias("value"), F.col("path").alias("station"), "pos")
    lines.repartition("station").sortWithinPartitions("station", "pos").select("value", "station").write.partitionBy("station").text(root)
    read = X.read_whole(v.spark, root)
    at = F.array_position("header", F.lit("ID")).cast("int") - 1
    ids = read.filter(~X.is_comment(F.col("value"))).select("path", "pos", F.get(X.tokens(F.col("value")), at).try_cast("long").alias("event_id"))
    return (X.parse_station(read).join(ids, ["path", "pos"])
            .select(F.regexp_extract("path", "station=([^/]+)/", 1).alias("station"), "event_id", "valid_utc", "hs_m", "tp_s", "dp_deg"))


@query("w15_newest_usable", f"""SELECT station, {iso('valid_utc')} AS valid_utc, {r6('hs_m')} AS hs_m, tp_s FROM (SELECT *, row_number() OVER (PARTITION BY station ORDER BY
 CASE WHEN hs_m IS NOT NULL AND tp_s IS NOT NULL THEN 2 WHEN hs_m IS NOT NULL THEN 1 ELSE 0 END DESC, valid_utc DESC) AS rn FROM {_TXT}) WHERE rn = 1""")
def _(v):
    rows = X.parse_station(station_lines(v)).withColumnRenamed("path", "station")
    return X.newest_usable(rows, ["station"]).select("station", "valid_utc", "hs_m", "tp_s")


def spectrum_times(v):
    return v.spectra.withColumn("stamp", F.date_format("ts", "yyyy MM dd HH mm"))


@query("s02_spectrum_pairs", f"""
SELECT station, {iso('ts')} AS ts, i::INTEGER AS bin, {r6('freq')} AS freq, {r6('energy')} AS energy, dir FROM spb""")
def _(v):
    """Energy and direction written as ``value (freq)`` lines, parsed and matched on frequency."""
    d = spectrum_times(v)
    def line(field, extra):
        nums = F.array_join(F.transform("bins", lambda b: F.concat(F.coalesce(b[field], F.lit(999.0)).cast("string"), F.lit(" ("), b["freq"].cast("string"), F.lit(")"))), " ")
        return d.select(F.col("station").alias("path"), F.concat_ws(" ", "stamp", *extra, nums).alias("value"))
    e = X.parse_spectrum_pairs(line("energy", [F.lit("9.999")]), "energy", 1)
    q = X.parse_spectrum_pairs(line("dir", []), "dir", 0)
    both = X.pair_spectra(e, q, ["path", "ts"])
    return both.select(F.col("path").alias("station"), "ts", F.posexplode("bins").alias("bin", "b")).select("station", "ts", "bin", "b.freq", "b.energy", "b.dir")


@query("s03_spectrum_table", f"""
SELECT station, {iso('ts')} AS ts, {r6('freq')} AS freq, {r6('energy')} AS energy FROM spb WHERE (vec_id + i) % 29 <> 0""")
def _(v):
    """Spectra as rows under a header of frequencies; missing bins are 999 fills."""
    d = spectrum_times(v)
    data = d.select(F.col("station").alias("path"), (F.unix_timestamp("ts")).alias("pos"), F.concat_ws(" ", "stamp", F.array_join(F.transform(
        "bins", lambda b: F.when(b["dir"].isNull(), "999.0").otherwise(b["energy"].cast("string"))), " ")).alias("value"))
    head = d.groupBy(F.col("station").alias("path")).agg(F.first("bins").alias("b")).select("path", F.lit(0).cast("long").alias("pos"), F.concat(
        F.lit("#YY MM DD hh mm "), F.array_join(F.transform("b", lambda b: b["freq"].cast("string")), " ")).alias("value"))
    out = X.parse_spectrum_table(data.unionByName(head), "energy")
    return out.select(F.col("path").alias("station"), "ts", F.explode("bins").alias("b")).select("station", "ts", "b.freq", "b.energy")


@query("s04_spectrum_summary", f"""
SELECT station, {iso('valid_utc')} AS valid_utc, CASE WHEN hs_m > 0 AND p >= 6 THEN {r6(m2ft('hs_m'))} END AS height_ft, CASE WHEN hs_m > 0 AND p >= 6 THEN p END AS period_s
FROM (SELECT *, CASE WHEN tp_s IS NOT NULL THEN tp_s END AS p, row_number() OVER (PARTITION BY station ORDER BY CASE WHEN hs_m IS NOT NULL THEN 1 ELSE 0 END DESC, valid_utc DESC) AS rn FROM {_TXT}) WHERE rn = 1""")
def _(v):
    lines = station_lines(v).withColumn("value", F.when(F.col("pos") == 0, F.lit("#YY  MM DD hh mm X Y SwH SwP SwD")).otherwise(F.col("value")))
    s = X.parse_summary(lines)
    c = F.get("components", F.lit(0))
    return s.select(F.col("path").alias("station"), "valid_utc", c["height_ft"].alias("height_ft"), c["period_s"].alias("period_s"))


@query("s05_hourly_json", f"SELECT station, {iso('t')} AS time, {r6('v')} AS swell_wave_height, NULL::DOUBLE AS wave_height FROM ser")
def _(v):
    """Hourly series as one JSON payload per station and day, parsed back; absent arrays read as null."""
    day = v.series.groupBy("station", F.to_date("t").alias("d")).agg(F.array_sort(F.collect_list(F.struct("t", "v"))).alias("r"))
    js = day.select(F.to_json(F.struct("station", F.struct(
        F.transform("r", lambda x: F.date_format(x["t"], "yyyy-MM-dd'T'HH:mm")).alias("time"),
        F.transform("r", lambda x: x["v"]).alias("swell_wave_height")).alias("hourly"))).alias("j"))
    p = js.select(F.from_json("j", schemas.HOURLY_WAVES).alias("p")).select("p.*")
    return J.explode_hourly(p, ["station"]).select("station", F.try_to_timestamp("time").alias("time"), "swell_wave_height", "wave_height")


@query("s06_tide_json", f"SELECT station, {iso('t')} AS t, {r6('v')} AS v, type FROM turns")
def _(v):
    from ..operators.tides import turning_points
    tp = turning_points(v.series, ["station"], "t", "v")
    day = tp.groupBy("station", F.to_date("t").alias("d")).agg(F.collect_list(F.struct(
        F.date_format("t", "yyyy-MM-dd HH:mm").alias("t"), F.col("v").cast("string").alias("v"), "type")).alias("predictions"))
    js = day.select(F.to_json(F.struct("station", "predictions")).alias("j"))
    return J.explode_tide(js.select(F.from_json("j", schemas.TIDE).alias("p")).select("p.*"))


@query("s07_geojson_features", f"SELECT site::VARCHAR AS site, {iso('time')} AS time, {r6('hs_m')} AS hs_m, {r6('tp_s')} AS tp_s, {r6('dp_deg')} AS dp_deg FROM lrd")
def _(v):
    """One feature collection per line of sites, latest reading per site after parsing."""
    feats = v.readings.withColumn("line", F.floor(F.col("site") / 8)).groupBy("line", "site", "time").agg(
        F.max(F.struct("rid", "rid2", "hs_m", "tp_s", "dp_deg")).alias("r"))
    js = feats.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array(F.struct(F.lit("Feature").alias("type"), F.struct(
        F.col("site").cast("string").alias("site_name"), F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("TIME"),
        F.col("r.hs_m").alias("significant_wave_height"), F.col("r.tp_s").alias("peak_wave_period"),
        F.col("r.dp_deg").alias("peak_wave_direction")).alias("properties"))).alias("features"))).alias("j"))
    rows = J.explode_features(js.select(F.from_json("j", schemas.GEOJSON).alias("p")).select("p.*"))
    from ..operators.swelltrack import latest_readings
    return latest_readings(rows, ["site"], "time", ["hs_m"]).select("site", "time", "hs_m", "tp_s", "dp_deg")


@query("s08_pivot_samples", f"""
SELECT station, {iso("date_trunc('hour', ts)::TIMESTAMP")} AS hour_utc, """ + ", ".join(f"{r6(f'max(value) FILTER (WHERE event_type = {chr(39)}{t}{chr(39)})')} AS {t}" for t in ("click", "view", "error")) + " FROM ev GROUP BY station, date_trunc('hour', ts)")
def _(v):
    s = v.events.withColumn("hour_utc", F.date_trunc("hour", "ts"))
    return A.pivot_samples(s, ["station", "hour_utc"], "event_type", "value", ["click", "view", "error"])


_FCOLS = f"station, model, {iso('cycle_utc')} AS cycle_utc, {iso('valid_utc')} AS valid_utc, lead_hours, {r6('sw1_height_ft')} AS sw1_height_ft"


@query("s09_forecast_scan", f"SELECT {_FCOLS} FROM fc WHERE model = 'A' AND cycle_utc >= TIMESTAMP '2024-01-01 00:00:00' AND cycle_utc < TIMESTAMP '2024-02-01 00:00:00'")
def _(v):
    """Archive written by directory, then read with model and month pruning."""
    root = work_path(v.spark, "forecasts")
    A.write_forecasts(v.forecast, root)
    return A.read_forecasts(v.spark, root, models=["A"], months=[(2024, 1)], columns=["station", "model", "cycle_utc", "valid_utc", "lead_hours", "sw1_height_ft"])


@query("s11_t03_forecast_sink", f"SELECT {_FCOLS} FROM fc")
def _(v):
    """Two thirds of the cycles first, then everything: present cycles are skipped, new ones added."""
    root = work_path(v.spark, "forecasts")
    A.write_forecasts(v.forecast.filter(F.col("cycle_utc") < "2024-01-20"), root)
    A.write_forecasts(v.forecast, root)
    return A.read_forecasts(v.spark, root, columns=["station", "model", "cycle_utc", "valid_utc", "lead_hours", "sw1_height_ft"])


_CLEAN = f"""SELECT station, {iso('valid_utc')} AS valid_utc, partition, {r6('hs_m')} AS hs_m, tp_s, dp_deg, source, {iso('ingest_utc')} AS ingest_utc FROM (SELECT *, row_number() OVER (
 PARTITION BY station, valid_utc, partition ORDER BY ingest_utc DESC, source DESC, hs_m DESC) AS rn FROM obs) WHERE rn = 1"""


@query("s12_s10_observation_sink", _CLEAN)
def _(v):
    """Two archive roots written and read back as one."""
    roots = [work_path(v.spark, "obs-hist"), work_path(v.spark, "obs-live")]
    for r, s in zip(roots, ("archive", "realtime")):
        A.write_observations(v.obs.filter(F.col("source") == s), r)
    return A.clean_observations(A.read_observations(v.spark, roots))


@query("s12_two_batches_one_month", _CLEAN)
def _(v):
    """Readings of one month in three batches, revisions among them: the stored table equals one clean pass."""
    root = work_path(v.spark, "obs-batches")
    day = F.dayofmonth("valid_utc")
    for part in (day < 10, (day >= 10) & (F.col("source") == "archive"), (day >= 10) & (F.col("source") != "archive")):
        A.write_observations(v.obs.filter(part), root)
    return A.read_observations(v.spark, [root])


@query("s11_forced_rewrite", f"""
SELECT station, model, {iso('cycle_utc')} AS cycle_utc, {iso('valid_utc')} AS valid_utc, lead_hours,
 {r6("sw1_height_ft + CASE WHEN cycle_utc >= TIMESTAMP '2024-01-20 00:00:00' AND model = 'A' THEN 1 ELSE 0 END")} AS sw1_height_ft FROM fc""")
def _(v):
    """Some cycles of one model written again by force: they are replaced, all others of their months stay."""
    root = work_path(v.spark, "forecasts")
    A.write_forecasts(v.forecast, root)
    again = v.forecast.filter((F.col("cycle_utc") >= "2024-01-20") & (F.col("model") == "A"))
    A.write_forecasts(again.withColumn("sw1_height_ft", F.col("sw1_height_ft") + 1), root, force=True)
    return A.read_forecasts(v.spark, root, columns=["station", "model", "cycle_utc", "valid_utc", "lead_hours", "sw1_height_ft"])


@query("s15_two_models_one_date", f"""
SELECT strftime(ts, '%Y-%m-%d') AS eval_date, event_type AS model, count(*) AS n, {r6('max(value)')} AS top FROM ev GROUP BY 1, 2""")
def _(v):
    """Models of one date stored one after another, the first of them twice: none erases another."""
    path = work_path(v.spark, "live-eval")
    rows = v.events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("eval_date"), F.col("event_type").alias("model")).agg(
        F.count("*").alias("n"), F.max("value").alias("top"))
    Tb.append_or_update(v.spark, rows.filter("model = 'click'").withColumn("top", F.lit(-1.0)), path, ["model"])
    for part in ("model = 'click'", "model = 'view'", "model not in ('click', 'view')"):
        Tb.append_or_update(v.spark, rows.filter(part), path, ["model"])
    return Tb.read_evaluations(v.spark, path, "model string, n long, top double")


@query("s10_schema_drift", f"""
SELECT station, {iso('valid_utc')} AS valid_utc, partition, {r6('max(hs_m)')} AS hs_m FROM obs WHERE source = 'archive' GROUP BY station, valid_utc, partition""")
def _(v):
    """A second root whose files lack the direction is found and left out."""
    roots = [work_path(v.spark, "obs-good"), work_path(v.spark, "obs-drifted")]
    A.write_observations(v.obs.filter(F.col("source") == "archive"), roots[0])
    v.obs.filter(F.col("source") == "realtime").drop("dp_deg", "station").withColumn("station", F.lit("x")).write.parquet(roots[1])
    drift = A.schema_drift(v.spark, roots, ["hs_m", "tp_s", "dp_deg", "partition", "valid_utc"])
    rows = A.read_observations(v.spark, roots, drift)
    return rows.groupBy("station", "valid_utc", "partition").agg(F.max("hs_m").alias("hs_m"))


@query("s10_verified_scan", _CLEAN)
def _(v):
    """Both roots and a folder whose files lack a column: the report names that one, the rest is read as often as its manifest says."""
    roots = [work_path(v.spark, "obs-hist"), work_path(v.spark, "obs-live"), work_path(v.spark, "obs-other")]
    for r, s in zip(roots, ("archive", "realtime")):
        A.write_observations(v.obs.filter(F.col("source") == s), r)
    v.obs.drop("dp_deg").withColumn("station", F.lit("none")).write.parquet(roots[2])
    scan, report = A.verified_observations(v.spark, roots)
    rows = materialise(scan.rows.drop("path"), "verified")
    scan.check()
    if {r.state for r in report.select("state").distinct().collect()} != {"lacks columns"}:
        raise ValueError("the folder without directions was not reported")
    return A.clean_observations(rows)


@query("s13_bias_store", f"SELECT station, lead_hours, variable, {r6('bias')} AS bias, {r6('s')} AS s, {r6('c')} AS c, n FROM bias")
def _(v):
    from .q_forecast import fitted
    path = work_path(v.spark, "bias")
    Tb.save_bias(fitted(v), path)
    return Tb.load_bias(v.spark, path)


def _meta(v):
    """Model metadata as JSON documents, one per model."""
    parts = v.model_parts.groupBy("sid").agg(*[F.max(F.when(F.col("variable") == n, F.struct("model_value", "ref_value"))).alias(n)
                                               for n in SWELL_VARS + ["surfer_f1"]])
    def block(side):
        s = F.col(f"surfer_f1.{side}")
        return F.struct(*[F.struct(F.col(f"{n}.{side}").alias("mae")).alias(n) for n in SWELL_VARS],
                        F.create_map(F.lit("FUN_OR_BETTER"), F.struct(s.alias("sens"), s.alias("ppv"))).alias("surfer"))
    m = v.models.join(parts, "sid")
    return m.select(F.to_json(F.struct("name", "scope", F.date_format("trained_utc", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("trained_utc"), "n_test_rows",
                                       F.create_map(F.lit("ml"), block("model_value"), F.lit("raw_A"), block("ref_value")).alias("metrics"))).alias("j"))


@query("s14_model_inventory", f"""
SELECT scope, name, CASE WHEN sid % 2 = 0 THEN 'baseline' ELSE 'ML' END AS arch, strftime(trained_utc, '%y%m%d') AS date_yymmdd, 'v' || sid AS version, {iso('trained_utc')} AS trained_ts,
 {r6('composite_skill')} AS composite_skill FROM mrank""")
def _(v):
    from ..operators.metrics import composite_skill
    meta = _meta(v).select(F.from_json("j", schemas.MODEL_META).alias("m")).select("m.*")
    skill = composite_skill(Tb.meta_skill_parts(meta), ["scope", "name"])
    inv = Tb.model_inventory(meta, "sea").select("scope", "name", "arch", "date_yymmdd", "version", "trained_ts")
    return inv.join(skill, ["scope", "name"]).drop("sw1_height_skill").select("scope", "name", "arch", "date_yymmdd", "version", "trained_ts", "composite_skill")


@query("s14_meta_files", f"""
SELECT scope, name, {iso('trained_utc')} AS trained_ts, {r6('composite_skill')} AS composite_skill FROM mrank""")
def _(v):
    """Model metadata written as JSON files, one per scope, and read back by the directory reader."""
    from ..operators.metrics import composite_skill
    root = work_path(v.spark, "model-meta")
    docs = _meta(v).select(F.get_json_object("j", "$.scope").alias("scope"), "j")
    docs.groupBy("scope").agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ","), F.lit("]")).alias("value")).write.partitionBy("scope").text(root)
    meta = J.read_model_meta(v.spark, f"{root}/*")
    skill = composite_skill(Tb.meta_skill_parts(meta), ["scope", "name"])
    inv = Tb.model_inventory(meta, "sea").select("scope", "name", "trained_ts")
    return inv.join(skill, ["scope", "name"]).select("scope", "name", "trained_ts", "composite_skill")


@query("o04_listing_order", "SELECT scope, name, row_number() OVER (PARTITION BY scope ORDER BY trained_utc DESC, name)::INTEGER AS place FROM mdl")
def _(v):
    """Models of each scope, newest first, names among equals, with their place as a column."""
    return Tb.listed(v.models, ["scope"], [F.col("trained_utc").desc_nulls_last(), F.col("name")]).select("scope", "name", "place")


@query("s15_append_or_update", f"""
SELECT strftime(ts, '%Y-%m-%d') AS eval_date, station, count(*) AS n, {r6('max(value)')} AS top FROM ev GROUP BY 1, 2""")
def _(v):
    """Daily rows written with half their dates first and all of them again: one row per date and station."""
    path = work_path(v.spark, "live-eval")
    rows = v.events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("eval_date"), "station").agg(F.count("*").alias("n"), F.max("value").alias("top"))
    Tb.append_or_update(v.spark, rows.filter(F.col("eval_date") < "2024-01-15").withColumn("top", F.lit(0.0)), path, ["station"])
    Tb.append_or_update(v.spark, rows, path, ["station"])
    return Tb.read_evaluations(v.spark, path, "station string, n long, top double")


@query("s16_flatten_sites", "SELECT line AS region, 'b' || min(site) OVER (PARTITION BY line) AS buoy, 's' || site AS name, (round(shore_normal, 6) + 0.0) AS shore_normal FROM site")
def _(v):
    """Lines of at most eight sites as nested regions, flattened again."""
    nested = v.sites.groupBy(F.col("line").alias("region")).agg(
        F.concat(F.lit("b"), F.min("site")).alias("buoy"),
        F.collect_list(F.struct(F.concat(F.lit("s"), F.col("site")).alias("name"), "shore_normal")).alias("spots"))
    return Tb.flatten_sites(nested)


@query("s18_work_list", f"""
SELECT s.station, {iso('c.cycle_utc')} AS cycle_utc FROM (SELECT DISTINCT station FROM ev) s CROSS JOIN (SELECT unnest(generate_series(TIMESTAMP '2023-12-31 00:00:00', TIMESTAMP '2024-02-05 00:00:00', INTERVAL 12 HOURS)) AS cycle_utc) c
WHERE NOT EXISTS (SELECT 1 FROM fa d WHERE d.station = s.station AND d.cycle_utc = c.cycle_utc)""")
def _(v):
    return A.work_list(v.events, "2023-12-31 00:00:00", "2024-02-05 00:00:00", 12, v.a)


@query("s18_month_list", f"""
SELECT s.site, m.month FROM site s CROSS JOIN (SELECT strftime(unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-12-01', INTERVAL 1 MONTH)), '%Y-%m') AS month) m
WHERE NOT EXISTS (SELECT 1 FROM rd WHERE rd.site = s.site AND strftime(rd.time, '%Y-%m') = m.month)""")
def _(v):
    done = v.readings.select("site", F.date_format("time", "yyyy-MM").alias("month"))
    return A.month_list(v.sites, "1995-01-01", "2001-12-01", done, key="site")


@query("s19_prefer_source", f"""
SELECT station, {iso('hour_utc')} AS hour_utc, partition, source, {r6('hs_m')} AS hs_m FROM (SELECT *, row_number() OVER (PARTITION BY station, hour_utc, partition ORDER BY
 CASE source WHEN 'archive' THEN 1 ELSE 2 END, ingest_utc DESC, hs_m DESC) AS rn FROM obsh) WHERE rn = 1""")
def _(v):
    from ..functions.timefn import snap_hour
    o = v.obs.withColumn("hour_utc", snap_hour(F.col("valid_utc")))
    p = F.when(F.col("source") == "archive", 1).otherwise(2)
    return A.prefer_source(o, ["station", "hour_utc", "partition"], p).select("station", "hour_utc", "partition", "source", "hs_m")


@query("s21_load_report", """
SELECT source, station, count(*) AS rows, count(*) FILTER (WHERE hs_m IS NULL AND tp_s IS NULL AND dp_deg IS NULL) AS empty_rows, count(*) FILTER (WHERE dp_deg IS NULL) AS no_direction,
 count(*) FILTER (WHERE tp_s IS NULL) AS no_period FROM obs GROUP BY 1, 2""")
def _(v):
    return A.load_report(v.obs, ["source", "station"])
