"""Files in, files out, and streams: late rows, replays, restarts."""

import datetime as dt
import glob
import os
import shutil

import pytest
from pyspark.sql import functions as F

from seastate import schemas
from seastate.sources import archive as A
from seastate.sources import jsonfeeds as J
from seastate.sources import manifest as M
from seastate.sources import snapshots as Sn
from seastate.sources import tables as Tb
from seastate.sources import text as X
from seastate.streaming import ingest as St

T0 = dt.datetime(2024, 3, 1)

STATION = """#YY  MM DD hh mm WDIR WSPD GST  WVHT   DPD   APD MWD
#yr  mo dy hr mn degT m/s  m/s     m   sec   sec degT
2024 03 01 02 50 180  5.0  6.0    MM    MM   5.0  MM
2024 03 01 01 50 180  5.0  6.0   1.2    MM   5.0 ESE
2024 03 01 00 50 180  5.0  6.0   1.1   9.0   5.0  99
bad line here
2024 13 01 00 50 180  5.0  6.0   1.1   9.0   5.0  99
"""
LEGACY = """#YY MM DD hh WVHT DPD MWD
98 12 31 23 2.5 99.0 270
"""
PAIRS = """#YY  MM DD hh mm Sep_Freq  < spec_1 (freq_1) ... >
2024 03 01 00 00 9.999 0.10 (0.033) 0.20 (0.038) 0.05 (0.043)
2024 03 01 01 00 9.999 0.30 (0.033)
"""
DIRS = """#YY  MM DD hh mm alpha1_1 (freq_1) ...
2024 03 01 00 00 90.0 (0.033) 999.0 (0.038)
"""
TABLE = """#YY  MM DD hh mm  .0200  .0325 .0375
#yr mo dy hr mn
2024 03 01 00 00  0.10 999.00 0.30
24 03 01 01 00  0.10 0.20 0.30
2024 03 01 02 00  0.10
"""


def put(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w") as f:
        f.write(text)
    return path


def test_station_files(spark, folder):
    put(folder, "a.txt", STATION)
    put(folder, "b.txt", LEGACY)
    rows = X.parse_station(X.read_lines(spark, folder)).cache()
    got = {r.valid_utc: r for r in rows.collect()}
    assert len(got) == 4
    old = got[dt.datetime(1998, 12, 31, 23)]
    assert (old.hs_m, old.tp_s, old.dp_deg, old.partition) == (2.5, None, 270.0, 0)
    assert got[dt.datetime(2024, 3, 1, 1, 50)].dp_deg == 112.0 and got[dt.datetime(2024, 3, 1, 0, 50)].dp_deg == 99.0
    best = {os.path.basename(r.path): r.valid_utc for r in X.newest_usable(rows, ["path"]).collect()}
    assert best == {"a.txt": dt.datetime(2024, 3, 1, 0, 50), "b.txt": dt.datetime(1998, 12, 31, 23)}


def test_spectrum_files(spark, folder):
    e = X.parse_spectrum_pairs(X.read_lines(spark, put(folder, "x.data_spec", PAIRS)), "energy", 1).withColumn("path", F.lit("x"))
    d = X.parse_spectrum_pairs(X.read_lines(spark, put(folder, "x.swdir", DIRS)), "dir", 0).withColumn("path", F.lit("x"))
    inner = X.pair_spectra(e, d, ["path", "ts"]).collect()
    assert [[(b.freq, b.energy, b.dir) for b in r.bins] for r in inner] == [[(0.033, 0.1, 90.0), (0.038, 0.2, None), (0.043, 0.05, None)]]
    assert X.pair_spectra(e, d, ["path", "ts"], outer=True).count() == 2


def test_spectrum_tables_and_web_pages(spark, folder):
    put(folder, "t.txt", TABLE)
    put(folder, "err.txt", "<html>\n#YY MM DD hh mm .02\n2024 03 01 00 00 1.0\n")
    got = {r.ts: [(b.freq, b.energy) for b in r.bins] for r in X.parse_spectrum_table(X.read_lines(spark, folder), "energy").collect()}
    assert got == {dt.datetime(2024, 3, 1, 0): [(0.02, 0.1), (0.0375, 0.3)], dt.datetime(2024, 3, 1, 1): [(0.02, 0.1), (0.0325, 0.2), (0.0375, 0.3)]}


def test_summary_keeps_long_swell_only(spark, folder):
    head = "#YY MM DD hh mm WVHT SwH SwP SwD\n"
    put(folder, "a.spec", head + "2024 03 01 02 00 1 MM MM MM\n2024 03 01 01 00 1 1.0 9.0 SSE\n")
    put(folder, "b.spec", head + "2024 03 01 01 00 1 1.0 5.0 SSE\n")
    got = {os.path.basename(r.path): r.components for r in X.parse_summary(X.read_lines(spark, folder)).collect()}
    assert (got["a.spec"][0].height_ft, got["a.spec"][0].direction_deg) == (3.3, 157.0) and got["b.spec"] == []


def test_json_feeds(spark, folder):
    p = put(folder, "w.json", '{"station":"s","hourly":{"time":["2024-03-01T00:00","2024-03-01T01:00"],"swell_wave_height":[1.5]}}\n')
    rows = J.explode_hourly(J.read_json(spark, p, schemas.HOURLY_WAVES), ["station"]).orderBy("time").collect()
    assert [(r.time, r.swell_wave_height, r.wave_height) for r in rows] == [("2024-03-01T00:00", 1.5, None), ("2024-03-01T01:00", None, None)]
    t = put(folder, "t.json", '{"station":"s","predictions":[{"t":"2024-03-01 05:49","v":"1.25","type":"H"},{"t":"bad","v":"1"}]}\n')
    assert [(r.v, r.type) for r in J.explode_tide(J.read_json(spark, t, schemas.TIDE)).collect()] == [(1.25, "H")]
    g = put(folder, "g.json", '{"type":"FeatureCollection",\n"features":[{"type":"Feature","properties":{"site_name":"A","TIME":"2024-03-01T00:00:00Z","peak_wave_period":14.0}},\n'
                              '{"type":"Feature","properties":{"site_name":null}}]}')
    assert [(r.site, r.tp_s, r.hs_m) for r in J.explode_features(J.read_json(spark, g, schemas.GEOJSON, multi_line=True)).collect()] == [("A", 14.0, None)]


def obs(spark, rows):
    full = [(s, T0 + dt.timedelta(hours=h), p, v, 9.0, 100.0, "x", T0 + dt.timedelta(hours=i)) for s, h, p, v, i in rows]
    return spark.createDataFrame(full, schemas.OBS)


def test_observation_roots_and_drift(spark, folder):
    a, b = folder + "/hist", folder + "/live"
    A.write_observations(obs(spark, [("44", 0, 1, 1.0, 1), ("44", 0, 1, 2.0, 5), ("44", 5, 1, 3.0, 1)]), a)
    A.write_observations(obs(spark, [("44", 800, 1, 4.0, 900)]), b)
    got = sorted((r.station, r.hs_m) for r in A.read_observations(spark, [a, b]).collect())
    assert got == [("44", 2.0), ("44", 3.0), ("44", 4.0)]
    bad = folder + "/bad"
    spark.range(1).write.parquet(bad)
    drift = A.schema_drift(spark, [a, bad], ["hs_m"])
    assert {tuple(r.missing) for r in drift.collect()} == {("hs_m",)} and drift.filter(F.col("path").contains("/bad/")).count() == drift.count()
    assert A.read_observations(spark, [a, bad], drift).count() == 2


def test_daily_evaluation_stream(spark, folder):
    land(spark, folder, "b1", [("s", 0, 1, 1.0, 1), ("s", 1, 1, 3.0, 1)])
    land(spark, folder, "b2", [("s", 2, 1, 8.0, 1)])
    rate = lambda b: b.groupBy(F.date_format("valid_utc", "yyyy-MM-dd").alias("eval_date"), F.lit("x").alias("model")).agg(F.avg("hs_m").alias("m"))
    stream = spark.readStream.schema(schemas.OBS).parquet(folder + "/in/*")
    for ckpt in ("c1", "c2"):              # the second run evaluates the same day again
        St.daily_evaluation(stream, f"{folder}/{ckpt}", rate, folder + "/ev", ["model"], folder + "/rows", schemas.OBS, St.OBS_KEYS, "valid_utc", ["ingest_utc"])
    got = Tb.read_evaluations(spark, folder + "/ev", "m double").collect()
    assert [(r.eval_date, r.m) for r in got] == [("2024-03-01", 4.0)]   # both batches of the day


def forecasts(spark, cycles, h):
    rows = [("07", "A", T0 + dt.timedelta(hours=c), T0 + dt.timedelta(hours=c + k), k) + (h,) * 9 + (T0,) for c in cycles for k in range(3)]
    return spark.createDataFrame(rows, schemas.FORECAST)


def test_forecast_sink_skips_or_forces(spark, folder):
    root = folder + "/fc"
    A.write_forecasts(forecasts(spark, [0, 12], 1.0), root)
    A.write_forecasts(forecasts(spark, [12, 24], 2.0), root)
    read = lambda: {(r.cycle_utc, r.lead_hours): r.sw1_height_ft for r in A.read_forecasts(spark, root).collect()}
    got = read()
    assert len(got) == 9 and got[(T0 + dt.timedelta(hours=12), 0)] == 1.0 and got[(T0 + dt.timedelta(hours=24), 2)] == 2.0
    A.write_forecasts(forecasts(spark, [12], 5.0), root, force=True)
    got = read()
    assert len(got) == 9 and got[(T0 + dt.timedelta(hours=12), 0)] == 5.0 and got[(T0, 0)] == 1.0
    assert {r.station for r in A.read_forecasts(spark, root).collect()} == {"07"}


def test_daily_row_is_replaced(spark, folder):
    row = lambda d, v: spark.createDataFrame([("m", v, d)], "name string, mae double, eval_date string")
    for d, v in (("2024-03-01", 1.0), ("2024-03-02", 2.0), ("2024-03-01", 3.0)):
        Tb.append_or_update(spark, row(d, v), folder + "/ev", ["name"])
    got = Tb.read_evaluations(spark, folder + "/ev", "name string, mae double")
    assert sorted((r.eval_date, r.mae) for r in got.collect()) == [("2024-03-01", 3.0), ("2024-03-02", 2.0)]


def test_sites_in_two_regions(spark):
    spot = {"name": "S", "lat": 1.0, "lon": 2.0, "shore_normal": 90.0}
    rows = Tb.flatten_sites(Tb.sites_from_config(spark, {"r1": {"buoy": "1", "spots": [spot]}, "r2": {"buoy": "2", "spots": [spot]}})).collect()
    assert sorted((r.region, r.name, r.buoy) for r in rows) == [("r1", "S", "1"), ("r2", "S", "2")]


def land(spark, folder, name, rows):
    obs(spark, rows).coalesce(1).write.parquet(f"{folder}/in/{name}")


def table(spark, folder):
    return sorted((r.station, r.valid_utc, r.hs_m) for r in St.read_table(spark, folder + "/table", schemas.OBS).collect())


def run(spark, folder, **kw):
    stream = spark.readStream.schema(schemas.OBS).parquet(folder + "/in/*")
    St.ingest_observations(stream, folder + "/table", folder + "/ckpt", **kw)


def test_stream_late_rows_replay_and_restart(spark, folder):
    a = [("s", 0, 1, 1.0, 1), ("s", 30, 1, 2.0, 31), ("t", 0, 1, 9.0, 1)]
    land(spark, folder, "b1", a)
    run(spark, folder)
    first = table(spark, folder)
    assert len(first) == 3
    land(spark, folder, "b2", [("s", 0, 1, 7.0, 40), ("s", 60, 1, 3.0, 61), ("t", 0, 1, 8.0, 0)])
    run(spark, folder)                     # restart from the same checkpoint
    got = table(spark, folder)
    assert (("s", T0, 7.0) in got) and (("t", T0, 9.0) in got) and len(got) == 4
    batch = sorted((r.station, r.valid_utc, r.hs_m) for r in A.clean_observations(
        spark.read.schema(schemas.OBS).parquet(folder + "/in/*")).collect())
    assert got == batch
    stream = spark.readStream.schema(schemas.OBS).parquet(folder + "/in/*")
    St.ingest_observations(stream, folder + "/table", folder + "/ckpt-new")   # full replay
    assert table(spark, folder) == got


def test_revision_of_a_known_key_is_written(spark, folder):
    args = (folder + "/table", schemas.OBS, St.OBS_KEYS, "valid_utc", ["ingest_utc"])
    first = obs(spark, [("s", 0, 1, 1.0, 1)])
    assert St.upsert_by_day(first, *args, skip_known=True)
    assert not St.upsert_by_day(first, *args, skip_known=True)                                     # nothing new
    assert not St.upsert_by_day(obs(spark, [("s", 0, 1, 7.0, 0)]), *args, skip_known=True)         # older: would lose
    assert St.upsert_by_day(obs(spark, [("s", 0, 1, 5.0, 9)]), *args, skip_known=True)             # a revision
    assert St.upsert_by_day(obs(spark, [("s", 1, 1, 5.0, 9)]), *args, skip_known=True)
    assert [h for _, _, h in table(spark, folder)] == [5.0, 5.0]


STEPS = ["_store", "_list_write", "_add_to_log", "_sweep"]


def dying(name):
    """A step of a write whose job dies when it has done its work, or (the log) just before."""
    whole = getattr(Sn, name)

    def step(*args):
        if name != "_add_to_log":
            whole(*args)
        raise RuntimeError("lost")
    return step


def sinks(spark, folder):
    """(write a first and a second batch, read) of every sink."""
    key = (folder + "/t", schemas.OBS, St.OBS_KEYS, "valid_utc", ["ingest_utc"])
    row = lambda v: spark.createDataFrame([("m", v, "2024-03-01")], "name string, mae double, eval_date string")
    return {
        "observations": (lambda k: A.write_observations(obs(spark, [("s", k, 1, float(k), 1)]), folder + "/o"),
                         lambda: sorted(r.hs_m for r in A.read_observations(spark, [folder + "/o"]).collect())),
        "days": (lambda k: St.upsert_by_day(obs(spark, [("s", k, 1, float(k), 1)]), *key),
                 lambda: sorted(r.hs_m for r in St.read_table(spark, folder + "/t", schemas.OBS).collect())),
        "cycles": (lambda k: A.write_forecasts(forecasts(spark, [12 * k], float(k)), folder + "/f"),
                   lambda: sorted({r.sw1_height_ft for r in A.read_forecasts(spark, folder + "/f").collect()})),
        "forced": (lambda k: A.write_forecasts(forecasts(spark, [12 * k], float(k)), folder + "/g", force=True),
                   lambda: sorted({r.sw1_height_ft for r in A.read_forecasts(spark, folder + "/g").collect()})),
        "evaluations": (lambda k: Tb.append_or_update(spark, row(float(k)).withColumn("name", F.lit(f"m{k}")), folder + "/e", ["name"]),
                        lambda: sorted(r.mae for r in Tb.read_evaluations(spark, folder + "/e", "name string, mae double").collect())),
    }


@pytest.mark.parametrize("sink", ["observations", "days", "cycles", "forced", "evaluations"])
def test_sinks_survive_a_crash_at_each_step(spark, folder, monkeypatch, sink):
    write, read = sinks(spark, folder)[sink]
    write(1)
    for k, step in enumerate(STEPS):
        before = read()
        with monkeypatch.context() as m:
            m.setattr(Sn, step, dying(step))
            with pytest.raises(RuntimeError, match="lost"):
                write(k + 2)
        assert read() == (sorted([*before, k + 2.0]) if step == "_sweep" else before)   # before the switch, or after it
        write(k + 2)                                                                     # the next write succeeds at once
        assert read() == sorted([*before, k + 2.0])


def tree(path):
    return sorted(os.path.relpath(f, path) for f in glob.glob(path + "/data/**/*.parquet", recursive=True))


def test_rows_are_written_once_and_old_ones_go(spark, folder):
    write, read = sinks(spark, folder)["days"]
    for k in range(6):
        write(k)                                   # six times the same day, rewritten as a whole
    assert read() == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]
    assert len(tree(folder + "/t")) == Sn.KEEP     # one file per kept snapshot: nothing is stored twice, nothing piles up
    assert len(os.listdir(folder + "/t/log")) == Sn.KEEP
    listed = Sn.files(spark, folder + "/t", ["day"]).collect()
    assert [(r.day, r.rows) for r in listed] == [("2024-03-01", 6)] and listed[0].bytes > 0


def test_readers_that_have_begun_keep_their_snapshot(spark, folder):
    write, _ = sinks(spark, folder)["days"]
    write(1)
    held = St.read_table(spark, folder + "/t", schemas.OBS)
    write(2)
    assert held.count() == 1 and St.read_table(spark, folder + "/t", schemas.OBS).count() == 2


def test_two_writers_do_not_overwrite_each_other(spark, folder, monkeypatch):
    write, read = sinks(spark, folder)["days"]
    write(1)
    log = Sn._log(spark, folder + "/t")
    whole = Sn._add_to_log
    with monkeypatch.context() as m:
        m.setattr(Sn, "_add_to_log", lambda s, path, seq, name: (whole(s, path, seq, "0" * 32), whole(s, path, seq, name)))
        shutil.copytree(f"{folder}/t/lists/{log[0][1]}", f"{folder}/t/lists/" + "0" * 32)
        with pytest.raises(Sn.WriteConflict):
            write(2)
    assert read() == [1.0]
    write(2)
    assert read() == [1.0, 2.0]


def test_odd_partition_values(spark, folder):
    names = ["a b", "c:d", "e%f", "g+h", "07", None, "x=y", "é"]
    rows = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k int, p string")
    Sn.append_rows(rows, folder + "/t", ["p"])
    Sn.replace_parts(rows.where("k < 6").withColumn("k", F.col("k") + 10), folder + "/t", ["p"])
    got = {r.p: r.k for r in Sn.load(spark, folder + "/t", "k int", ["p"]).collect()}
    assert got == {n: k + 10 if k < 6 else k for k, n in enumerate(names)}
    one = Sn.load(spark, folder + "/t", "k int", ["p"], F.col("p") == "c:d").collect()
    assert [r.k for r in one] == [11] and Sn.load(spark, folder + "/t", "k int", ["p"], F.lit(False)).count() == 0
    Sn.drop_parts(spark, folder + "/t", ["p"], F.col("p").startswith("a"))
    assert Sn.load(spark, folder + "/t", "k int", ["p"]).count() == 7


def spoil(path, how):
    if how == "missing":
        os.remove(path)
    else:
        size = os.path.getsize(path)
        with open(path, "r+b") as f:
            if how == "truncated":
                f.truncate(size // 2)
            else:                                  # a data page in the middle, the footer stays good
                f.seek(size // 3)
                f.write(b"\xff" * 400)
    crc = os.path.join(os.path.dirname(path), "." + os.path.basename(path) + ".crc")
    if os.path.exists(crc):
        os.remove(crc)


@pytest.mark.parametrize("how, state", [("page", "short"), ("truncated", "unreadable"), ("missing", "missing")])
def test_damaged_files_are_reported_and_never_lost_in_silence(spark, folder, how, state):
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 4000)
    rows = spark.range(20_000).select(F.lit("s").alias("station"), F.timestamp_seconds(F.lit(1709251200) + F.col("id")).alias("valid_utc"), F.lit(1).alias("partition"),
                                      F.rand(1).alias("hs_m"), F.rand(2).alias("tp_s"), F.rand(3).alias("dp_deg"), F.lit("x").alias("source"), F.lit(T0).alias("ingest_utc"))
    try:
        A.write_observations(rows, folder + "/o")
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    listed = M.manifest(spark, [folder + "/o"], ["hs_m"]).collect()
    assert sum(r.rows for r in listed) == 20_000 and len(listed) >= 5 and not any(r.error or r.missing for r in listed)
    scan, report = A.verified_observations(spark, [folder + "/o"])
    assert scan.rows.agg(F.sum("hs_m")).count() == 1 and scan.check() == 20_000 and report.count() == 0
    hit = sorted(tree(folder + "/o"))[1]
    spoil(f"{folder}/o/{hit}", how)
    held = spark.createDataFrame(listed, M.MANIFEST)
    bad = [r for r in M.verify(spark, held, schemas.OBS).collect() if r.state != "ok"]
    assert [(os.path.basename(r.path), r.state) for r in bad] == [(os.path.basename(hit), state)] and bad[0].rows_read < bad[0].rows
    with pytest.raises(Exception):
        A.read_observations(spark, [folder + "/o"]).agg(F.sum("hs_m")).collect()        # strict
    scan, report = A.verified_observations(spark, [folder + "/o"])
    assert [r.state for r in report.collect()] == [state]
    n = scan.rows.select(F.sum("hs_m"), F.count("*").alias("n")).collect()[0].n
    assert n == scan.check() == 20_000 - bad[0].rows                                     # rows read equal the manifest
    if how != "page":
        drift = A.schema_drift(spark, [folder + "/o"], ["hs_m"])
        assert drift.count() == 1 and A.read_observations(spark, [folder + "/o"], drift).agg(F.count("hs_m")).first()[0] == n
    else:                                                                                # a good footer: the report has nothing, the scan must fail
        drift = A.schema_drift(spark, [folder + "/o"], ["hs_m"])
        assert drift.count() == 0
        with pytest.raises(Exception):
            A.read_observations(spark, [folder + "/o"], drift).agg(F.sum("hs_m")).collect()


def test_a_short_scan_is_noticed(spark, folder):
    obs(spark, [("s", k, 1, float(k), 1) for k in range(50)]).coalesce(1).write.parquet(folder + "/o")
    listed = M.manifest(spark, [folder + "/o"], ["hs_m"]).withColumn("rows", F.col("rows") + 3)
    scan = M.counted(spark, spark.createDataFrame(listed.collect(), M.MANIFEST), schemas.OBS)
    scan.rows.write.format("noop").mode("overwrite").save()
    with pytest.raises(M.ScanMismatch) as e:
        scan.check()
    assert [r.state for r in e.value.report] == ["unreadable"]      # its footer says 50


def test_truncated_file_fails_a_forced_rewrite(spark, folder):
    root = folder + "/fc"
    A.write_forecasts(forecasts(spark, [0], 1.0), root)
    A.write_forecasts(forecasts(spark, [12], 2.0), root)
    files = sorted(glob.glob(root + "/data/**/*.parquet", recursive=True), key=os.path.getmtime)
    spoil(files[-1], "truncated")
    with pytest.raises(Exception):
        A.read_forecasts(spark, root).collect()
    with pytest.raises(Exception):
        A.write_forecasts(forecasts(spark, [0], 5.0), root, force=True)
    assert all(os.path.exists(f) for f in files)


def test_retention_and_pruning(spark, folder):
    d = obs(spark, [("s", 24 * k, 1, float(k), k) for k in range(20)])
    assert St.retain(d, "valid_utc", 14).count() == 15
    St.upsert_by_day(d, folder + "/table", schemas.OBS, St.OBS_KEYS, "valid_utc", ["ingest_utc"])
    St.prune_days(spark, folder + "/table", "2024-03-11")
    assert St.read_table(spark, folder + "/table", schemas.OBS).count() == 10


def test_stream_windows_equal_batch(spark, folder):
    land(spark, folder, "b1", [("s", 0, 1, 1.0, 1), ("s", 0, 2, 3.0, 1), ("s", 200, 1, 5.0, 1)])
    stream = spark.readStream.schema(schemas.OBS).parquet(folder + "/in/*")
    out = folder + "/win"
    q = St.hourly_window_counts(stream).writeStream.outputMode("append").format("parquet").option(
        "checkpointLocation", folder + "/c").trigger(availableNow=True).start(out)
    q.awaitTermination()
    got = [(r.hour_utc, r.n, r.mean_hs_m) for r in spark.read.parquet(out).collect()]
    assert got == [(T0, 2, 2.0)]           # the newest hour stays open behind the watermark
    dd = St.first_wins(spark.readStream.schema(schemas.OBS).parquet(folder + "/in/*"))
    assert dd.isStreaming


@pytest.mark.parametrize("limit", [X.BROADCAST_FILES, 0])
def test_plain_header_lines_are_read(spark, folder, monkeypatch, limit):
    monkeypatch.setattr(X, "BROADCAST_FILES", limit)
    plain = "YY MM DD hh WVHT DPD MWD\n96 03 01 05 1.5 9.0 SE\n96 03 01 06 MM 9.0 99\n"
    put(folder, "old.txt", plain)
    put(folder, "new.txt", STATION)
    by_lines = X.parse_station(X.read_lines(spark, folder))
    whole = X.parse_station(X.read_whole(spark, folder))
    pick = lambda df: sorted((os.path.basename(r.path), r.valid_utc, r.hs_m or -1.0) for r in df.collect())
    plan = by_lines._jdf.queryExecution().executedPlan().toString()
    assert limit == 0 or "Exchange hashpartitioning" not in plan         # no data line is shuffled while the headers fit
    assert pick(by_lines) == pick(whole) and len([r for r in pick(whole) if r[0] == "old.txt"]) == 2
    assert (("old.txt", dt.datetime(1996, 3, 1, 5), 1.5)) in pick(whole)


def test_ties_do_not_depend_on_order(spark):
    from seastate.operators.pairing import hourly_obs, obs_wide
    rows = [("s", 0, 1, 2.0, 1), ("s", 0, 1, 1.0, 1)]
    for some in (rows, rows[::-1]):
        assert [r.hs_m for r in hourly_obs(obs(spark, some).coalesce(1)).collect()] == [2.0]
        assert [round(r.obs_sw1_height_ft, 2) for r in obs_wide(obs(spark, some).coalesce(1)).collect()] == [6.56]


def test_first_wins_query_passes_late_readings(spark, folder):
    """A second file, 500 days older than the first: behind any watermark of the stream, yet every reading comes once."""
    from seastate.plans.catalog import QUERIES

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").where("event_type != 'click'")
    old = events.withColumn("ts", F.col("ts") - F.expr("INTERVAL 500 DAYS"))
    events.coalesce(1).write.parquet(folder + "/events.parquet")
    one = QUERIES["t01_first_wins_stream"](spark, folder).count()
    old.unionByName(events).coalesce(1).write.parquet(folder + "/events_late.parquet")
    assert one > 0 and QUERIES["t01_first_wins_stream"](spark, folder).count() == 2 * one


def test_batches_of_a_stateful_stream_are_folded_adaptively(spark, folder, monkeypatch):
    land(spark, folder, "b1", [("s", 0, 1, 1.0, 1), ("s", 30, 2, 3.0, 1)])
    seen, store, key = [], Sn._store, "spark.sql.adaptive.enabled"
    monkeypatch.setattr(Sn, "_store", lambda rows, *a: seen.append(rows.sparkSession.conf.get(key)) or store(rows, *a))
    stream = spark.readStream.schema(schemas.OBS).parquet(folder + "/in/*")
    schema = "station string, hour_utc timestamp, n long, mean_hs_m double"
    with St.state_on_disk(spark):
        q = St.hourly_window_counts(stream).writeStream.outputMode("update").option("checkpointLocation", folder + "/c").foreachBatch(
            lambda b, _: St.upsert_by_day(b, folder + "/t", schema, ["station", "hour_utc"], "hour_utc", ["n"])).trigger(availableNow=True).start()
    q.awaitTermination()
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", "")
    assert seen and set(seen) == {"true"} and St.read_table(spark, folder + "/t", schema).count() == 2


def test_files_do_not_grow_with_the_stations(spark, folder):
    rows = [(f"s{i}", 0, 1, float(i), 1) for i in range(500)]
    A.write_observations(obs(spark, rows), folder + "/o")
    d = forecasts(spark, [0], 1.0).drop("station").crossJoin(spark.range(500).select(F.concat(F.lit("s"), F.col("id")).alias("station")))
    A.write_forecasts(d, folder + "/f")
    for sub in "of":
        assert len(glob.glob(f"{folder}/{sub}/data/**/*.parquet", recursive=True)) <= 2 * A.FOLDERS
    assert A.read_observations(spark, [folder + "/o"]).count() == 500
    assert A.read_forecasts(spark, folder + "/f").select("station").distinct().count() == 500
    some = A.read_forecasts(spark, folder + "/f", stations=["s7", "s11"])
    assert {r.station for r in some.collect()} == {"s7", "s11"} and len(some.inputFiles()) <= 4


def test_headers_are_found_without_sorting_the_lines(spark, folder):
    """Header places come from a hash aggregate; the parser looks names up once a file, not once a line."""
    put(folder, "a.txt", "#YY MM DD hh mm WVHT DPD\n2024 01 01 00 00 1.5 7\n")
    put(folder, "b.txt", "\nYY MM DD hh WVHT\n2024 01 01 05 2.5\n")
    lines = X.read_lines(spark, folder).withColumn("pos", F.col("pos.line"))
    assert "SortAggregate" not in X.headers(lines, True)._jdf.queryExecution().executedPlan().toString()
    assert "array_position" not in X.parse_station(lines)._jdf.queryExecution().executedPlan().toString()
    got = sorted((os.path.basename(r.path), r.valid_utc.hour, r.hs_m, r.tp_s) for r in X.parse_station(lines).collect())
    assert got == [("a.txt", 0, 1.5, 7.0), ("b.txt", 5, 2.5, None)]
