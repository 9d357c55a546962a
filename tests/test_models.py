"""Selection, splits, tides, trees and bias on small generated sets."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from seastate.functions import rules as R
from seastate.operators import bias as B
from seastate.operators import livecheck as L
from seastate.operators import metrics as M
from seastate.operators import mlcorrect as Ml
from seastate.operators import outlook as O
from seastate.operators import pairing as P
from seastate.operators import registry as G
from seastate.operators import tides as Td
from seastate.sources import modelstore as Ms
from seastate.sources import snapshots as Sn

T0 = dt.datetime(2022, 1, 1)
MODELS = "scope string, name string, trained_utc timestamp, n_test_rows long, composite_skill double, sw1_height_skill double"


def models(spark, rows):
    return spark.createDataFrame([("s", n, T0 + dt.timedelta(days=d), c, k, h) for n, d, c, k, h in rows], MODELS)


def chosen(df):
    return [r.name for r in G.select_models(df, ["scope"]).orderBy("slot").collect()]


def test_selection_rules(spark):
    rows = [("old_best", 1, 1000, 0.9, 0.0), ("small", 2, 999, 0.99, 0.5), ("negative", 3, 5000, 0.95, -0.01), ("new", 4, 5000, 0.1, 0.1), ("newer", 5, 10, None, None)]
    assert chosen(models(spark, rows)) == ["old_best", "newer", "new"]
    assert chosen(models(spark, rows[1:3] + rows[4:])) == ["newer", "negative", "small"]
    tie = [("a", 1, 2000, 0.5, 0.1), ("b", 2, 2000, 0.5, 0.1), ("c", 3, 1, None, None)]
    assert chosen(models(spark, tie)) == ["b", "c", "a"]


def test_stride_counts_from_the_first_row_of_a_long_series(spark):
    """Series that start at any hour, over days with gaps; the rows of a hot one meet their first hour by the day, not by the station alone."""
    rng = random.Random(2)
    rows = [(s, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), h) for s, n in (("hot", 900), ("b", 40), ("c", 1)) for h in sorted(rng.sample(range(5, 2000), n))]
    df = spark.createDataFrame([*rows, ("b", None, -1), (None, rows[0][1], -2)], "station string, t timestamp, v int")
    first = {s: min(h for x, _, h in rows if x == s) for s, _, _ in rows}
    got = O.stride_from_first(df, ["station"], "t")
    assert got.columns == df.columns
    assert sorted((r.station, r.v) for r in got.collect()) == sorted((s, h) for s, _, h in rows if (h - first[s]) % 3 == 0)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    condition = plan.split("Join Inner", 1)[1].split("\n", 1)[0]
    assert "(station#" in condition and "(_day#" in condition


def test_limits_are_parameters(spark):
    models = spark.createDataFrame([("s", "m", 1, 60, 0.5, 0.2)], "scope string, name string, trained_utc int, n_test_rows int, composite_skill double, sw1_height_skill double")
    best = lambda **k: [r.is_best for r in G.select_models(models, ["scope"], **k).collect()]
    assert best() == [False] and best(min_test_rows=60) == [True]
    obs = spark.createDataFrame([("s", 1e6, 3.0)], "station string, h double, p double")
    assert O.boundary_table(obs, ["station"], "h", "p", R.load_bands(), chart=(4.0, 2.0)).count() == 9 * 3


def test_composite_needs_every_part(spark):
    rows = [("m", v, 0.5, 1.0) for v in M.SKILL_WEIGHTS if v != "surfer_f1"] + [("m", "surfer_f1", 0.8, 0.6)]
    full = M.composite_skill(spark.createDataFrame(rows, "name string, variable string, model_value double, ref_value double"), ["name"]).first()
    assert full.composite_skill == pytest.approx(0.7 * 0.5 + 0.3 * 0.5)
    part = M.composite_skill(spark.createDataFrame(rows[1:], "name string, variable string, model_value double, ref_value double"), ["name"]).first()
    assert part.composite_skill is None


def test_rates_with_zero_denominators(spark):
    df = spark.createDataFrame([("FLAT", "FLAT"), ("FLAT", "FUN"), (None, "FUN")], "o string, p string")
    r = {x.category: x for x in M.confusion(df, "o", "p").collect()}
    assert (r["FUN"].tp, r["FUN"].fp, r["FUN"].fn, r["FUN"].tn, r["FUN"].n) == (0, 1, 0, 1, 2)
    assert r["FUN"].sens is None and r["FUN"].f1 is None and r["SOLID"].ppv is None and r["SOLID"].spec == 1.0


@pytest.mark.parametrize("n", [2, 7, 10, 61])
def test_split_counts_and_order(spark, n):
    cyc = [(T0 + dt.timedelta(days=9 * i),) for i in range(n)] * 2
    df = P.time_split(spark.createDataFrame(cyc, "cycle_utc timestamp"))
    P.assert_time_split(df)
    assert df.filter("is_test").select("cycle_utc").distinct().count() == max(1, round(n * 0.15))


def test_split_check_raises(spark):
    df = spark.createDataFrame([(T0, True), (T0 + dt.timedelta(days=1), False)], "cycle_utc timestamp, is_test boolean")
    with pytest.raises(ValueError):
        P.assert_time_split(df)


def test_smoothing_pulls_an_outlier_towards_its_neighbours(spark):
    rows = [("s", l, "v", 10.0 if l == 3 else 1.0, None, None, 1 if l == 3 else 5) for l in range(7)]
    df = spark.createDataFrame(rows, "station string, lead_hours int, variable string, bias double, s double, c double, n long")
    got = {r.lead_hours: r.bias for r in B.smooth_leads(df, 2).collect()}
    num = sum((3 - abs(k)) * (1 if k == 0 else 5) * (10.0 if k == 0 else 1.0) for k in range(-2, 3))
    den = sum((3 - abs(k)) * (1 if k == 0 else 5) for k in range(-2, 3))
    assert got[3] == pytest.approx(num / den)
    assert {r.lead_hours: r.bias for r in B.smooth_leads(df, 0).collect()}[3] == 10.0


def test_harmonic_fit_recovers_a_tide(spark):
    cons = Td.CONSTITUENTS
    rnd = random.Random(1)
    true = {n: (rnd.uniform(-1, 1), rnd.uniform(-1, 1)) for n in cons}
    hours = range(24 * 420)
    base = (T0 - dt.datetime(2000, 1, 1)).total_seconds() / 3600
    rows = []
    for h in hours:
        y = 1.5 + sum(a * math.cos(math.radians(cons[n]) * (base + h)) + b * math.sin(math.radians(cons[n]) * (base + h)) for n, (a, b) in true.items())
        rows.append(("x", T0 + dt.timedelta(hours=h), y))
    df = spark.createDataFrame(rows + [("short", T0, 1.0)], "station string, t timestamp, v double").repartition(6)
    fit = Td.fit_harmonics(df, ["station"], "t", "v")
    got = {r.term: r for r in fit.collect()}
    assert {r.station for r in got.values()} == {"x"}
    assert got["M2"].rms < 1e-4
    for n, (a, b) in true.items():
        if n not in ("SA", "SSA"):
            assert got[n].a == pytest.approx(a, abs=1e-3) and got[n].b == pytest.approx(b, abs=1e-3), n
    p = Td.predict_harmonics(df.filter("station = 'x'"), fit, ["station"], "t")
    assert p.select(F.max(F.abs(F.col("pred") - F.col("v")))).first()[0] < 1e-3
    off = Td.datum_offset(p.withColumn("pred", F.col("pred") + 0.5).select("station", "t", "pred"), df, ["station"], "t", "pred", "v")
    o = {r.station: r for r in off.collect()}
    assert o["x"].offset == pytest.approx(0.5, abs=1e-3) and o["short"].offset == 0.0


def test_harmonic_fit_keeps_its_digits_where_terms_are_hardly_apart(spark, monkeypatch):
    """9,600 samples over 120 days: K2 beside S2, P1 beside K1, half-yearly beside yearly. Factors of many tasks meet on two levels."""
    monkeypatch.setattr(Td, "FAN", 4)
    cons, rnd = Td.CONSTITUENTS, random.Random(2)
    true = {n: (rnd.uniform(-1, 1), rnd.uniform(-1, 1)) for n in cons}
    at = F.timestamp_micros(F.lit(1704067200 * 1_000_000) + (F.col("id") * 1_080_000_000))
    basis = Td._basis(Td.phase_hours(F.col("t")), cons)
    y = F.lit(0.7)
    for k, (a, b) in enumerate(true.values()):
        y = y + F.lit(a) * basis[1 + 2 * k] + F.lit(b) * basis[2 + 2 * k]
    df = spark.range(0, 9600, 1, 13).select(F.lit("x").alias("station"), at.alias("t")).withColumn("v", y)
    got = {r.term: r for r in Td.fit_harmonics(df, ["station"], "t", "v").collect()}
    assert got["Z0"].n == 9600 and got["Z0"].a == pytest.approx(0.7, abs=1e-6) and got["M2"].rms < 1e-9
    for n, (a, b) in true.items():
        assert got[n].a == pytest.approx(a, abs=1e-6) and got[n].b == pytest.approx(b, abs=1e-6), n
    # Keys of several columns, a null among them, and an empty table.
    two = df.withColumn("k", F.when(F.col("v") > 0, 1)).withColumn("v", F.lit(2.5))
    fit = Td.fit_harmonics(two, ["station", "k"], "t", "v", min_samples=100).where("term = 'Z0'").collect()
    assert {r.k for r in fit} == {None, 1} and sum(r.n for r in fit) == 9600 and all(r.a == pytest.approx(2.5) for r in fit)
    assert Td.fit_harmonics(df.limit(0), ["station"], "t", "v").collect() == []


def test_flat_top_gives_one_turn(spark):
    v = [1, 2, 3, 3, 2, 1, 1, 1, 2]
    df = spark.createDataFrame([("a", T0 + dt.timedelta(hours=i), float(x)) for i, x in enumerate(v)], "k string, t timestamp, v double")
    turns = Td.turning_points(df, ["k"], "t", "v", width=2 * 3600)
    assert [(r.t.hour, r.type) for r in turns.orderBy("t").collect()] == [(2, "H"), (3, "H"), (5, "L"), (7, "L")]
    assert [(r.t.hour, r.type) for r in Td.collapse_turns(turns, ["k"], "t", "v", width=2 * 3600).orderBy("t").collect()] == [(2, "H"), (5, "L")]


def test_flat_day_is_half(spark):
    df = spark.createDataFrame([("a", T0 + dt.timedelta(hours=i), 1.0 + 0.001 * i) for i in range(5)], "k string, t timestamp, v double")
    assert {r.pct for r in Td.day_percent(df, ["k"], "t", "v").collect()} == {50}


def test_small_surf_scores_nothing(spark):
    rule = O.load_break()
    df = spark.createDataFrame([(0.5, 15.0, 171.0, 5.0, 352.0, "mid"), (8.0, 17.0, 171.0, 3.0, 352.0, "mid"), (None, None, None, None, None, None)],
                               "h double, p double, d double, s double, w double, st string")
    r = [x.ranked for x in O.rank_sections(df, rule, "h", "p", "d", "s", "w", "st").collect()]
    assert {s.score for s in r[0]} == {0} and r[1][0].section == "wedge" and r[1][0].score > 80 and r[1][0].reasons == []
    assert all("poor size" in s.reasons and s.score == 0 for s in r[2])


def paired(spark, n=600):
    rnd = random.Random(3)
    rows = []
    for i in range(n):
        h, p, d = rnd.uniform(1, 8), rnd.uniform(6, 16), rnd.uniform(0, 360)
        st = f"s{i % 2}"
        shift = 1.0 if st == "s0" else -0.5
        rows.append((st, T0 + dt.timedelta(hours=12 * i), T0 + dt.timedelta(hours=12 * i + 6), i % 4 * 3)
                    + (h, p, d, h, p, d) * 2 + (h + shift, p + 0.5, (d + 20) % 360, h - shift, p, d))
    v = P.SWELL_VARS
    cols = "station string, cycle_utc timestamp, valid_utc timestamp, lead_hours int, " + ", ".join(
        f"{m}_{x} double" for m in ("a", "b", "obs") for x in v)
    return spark.createDataFrame(rows, cols)


def test_trees_and_bias_beat_the_raw_models(spark):
    d = P.time_split(paired(spark))
    train, test = d.filter(~F.col("is_test")), d.filter("is_test")
    raw = {r.variable: r.mae for r in M.error_metrics(B.raw_predictions(test, "a")).collect()}
    fixed = {r.variable: r.mae for r in M.error_metrics(B.apply_bias(test, B.fit_bias(train))).collect()}
    assert raw["sw1_height_ft"] > 0.4 and fixed["sw1_height_ft"] < 1e-9
    assert raw["sw1_direction_deg"] == pytest.approx(20) and fixed["sw1_direction_deg"] < 1e-6
    assert Ml.stations_of(train) == ["s0", "s1"]
    models = Ml.fit_trees(train, ["s0", "s1"], rounds=10, depth=4, step=0.3)
    assert sorted(models) == sorted(Ml.TARGETS)
    got = Ml.apply_trees(test, models, ["s0", "s1"])
    assert got.select(F.avg(F.abs(F.col("pred_sw1_height_ft") - F.col("obs_sw1_height_ft")))).first()[0] < raw["sw1_height_ft"]
    assert got.filter(F.col("pred_sw1_direction_deg").isNull() | F.col("pred_sw2_direction_deg").isNull()).count() == 0
    for t in Ml.SCALARS:  # every biased scalar gets better, none much worse
        err = Ml.features(got, ["s0", "s1"]).select(F.avg(F.abs(F.col(f"pred_{t}") - F.col(f"obs_{t}")))).first()[0]
        assert err < max(raw[t], 0.8), t
    by_kind = Ml.correct_cycle(test, "ML", models=models, stations=["s0", "s1"], fallback=False)
    assert by_kind.filter("pred_sw2_period_s is null").count() == 0
    with pytest.raises(ValueError):
        Ml.correct_cycle(test, "?", fallback=False)
    with pytest.raises(ValueError):
        Ml.check_features(models["sw1_height_ft"], ["lead_hours"])
    holed = test.limit(3).withColumn("a_sw2_period_s", F.lit(None).cast("double"))
    assert Ml.apply_trees(holed, models, ["s0", "s1"]).filter("pred_sw1_height_ft is not null").count() == 0
    assert Ml.fit_trees(train.limit(50), ["s0", "s1"]) == {}
    assert {(r.target, r.fitted) for r in Ml.fit_report(train.limit(50), ["s0", "s1"]).collect()} == {(t, False) for t in Ml.TARGETS}


def test_unknown_cell_is_left_uncorrected(spark):
    d = paired(spark, 8)
    empty = B.fit_bias(d.limit(0))
    r = B.apply_bias(d, empty).first()
    assert r.pred_sw1_height_ft == pytest.approx((r.a_sw1_height_ft + r.b_sw1_height_ft) / 2)


def test_stored_models_are_whole_checked_and_predict_the_same(spark, folder):
    d = P.time_split(paired(spark))
    train, test = d.filter(~F.col("is_test")), d.filter("is_test")
    store, stations = folder + "/models", ["s0", "s1"]
    trees = Ml.fit_trees(train, stations, ["sw1_height_ft", "sw1_dp_sin", "sw1_dp_cos"], rounds=3, depth=3)
    table = B.fit_bias(train)
    Ms.save_tree_model(spark, store, "t1", "east", trees, stations, T0 + dt.timedelta(days=9))
    Ms.save_bias_model(store, "b1", "east", table, T0 + dt.timedelta(days=3))
    assert {(r.name, r.arch) for r in Ml.detect_arch(Ms.artefacts(spark, store)).collect()} == {("t1", "ML"), ("b1", "baseline")}
    loaded = Ms.load_all(spark, store)
    assert [(m.name, m.kind) for m in loaded] == [("b1", "baseline"), ("t1", "ML")]
    keys = ["station", "cycle_utc", "lead_hours"]
    for m, before in zip(loaded, (B.apply_bias(test, table), Ml.apply_trees(test, trees, stations))):
        cols = sorted(c for c in before.columns if c.startswith("pred_"))
        want, got = (sorted(map(tuple, x.select(*keys, *cols).collect())) for x in (before, m.predict(test)))
        assert got == want and cols
    with pytest.raises(KeyError):
        Ms.load_model(spark, store, "none")
    # An artefact without its registry row is not listed: the save died on the way.
    Ms.save_bias(table, store + "/artefacts/half/bias")
    assert [m.name for m in Ms.load_all(spark, store)] == ["b1", "t1"]
    row = Ms.registry(spark, store).where("name = 't1'").first()
    for change in ({"features": row.features[::-1]}, {"features": row.features[:-1]}, {"version": 99}, {"stations": ["s1", "s0"]}, {"targets": [*row.targets, "sw2_dp_sin"]}):
        old = row.asDict() | change
        spoilt = spark.createDataFrame([tuple(old[c] for c in ("name", "scope", "version", "trained_utc", "features", "stations", "targets"))], "name string, " + Ms.REGISTRY)
        Sn.replace_parts(spoilt, store + "/registry", ["name"])
        with pytest.raises(ValueError):
            Ms.load_model(spark, store, "t1")


def test_unseen_cycles_by_brute_force(spark):
    rnd = random.Random(6)
    at = lambda h: T0 + dt.timedelta(hours=h)
    rows = [(rnd.choice("abc"), at(rnd.randrange(0, 24 * 90, 6)), k) for k in range(400)]
    models = [(rnd.choice("abd"), f"m{k}", at(rnd.randrange(-100, 24 * 100, 6))) for k in range(30)] + [("a", "twin", rows[0][1]), ("b", "never", None)]
    paired_ = spark.createDataFrame(rows, "scope string, cycle_utc timestamp, k int")
    listed = spark.createDataFrame(models, "scope string, name string, trained_utc timestamp")
    want = sorted((s, c, k, n) for s, c, k in rows for g, n, t in models if g == s and t is not None and c > t)
    got = G.unseen_rows(paired_, listed, ["scope"])
    assert sorted((r.scope, r.cycle_utc, r.k, r.name) for r in got.collect()) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert G.unseen_rows(paired_, listed.limit(0), ["scope"]).count() == 0


def test_live_check_rates_each_model_on_what_it_has_not_seen(spark, folder):
    d = paired(spark, 200).withColumn("scope", F.when(F.col("station") == "s0", "x").otherwise("y"))
    cut = lambda k: T0 + dt.timedelta(hours=12 * k)
    zero = B.fit_bias(d.limit(0))
    for name, scope, table, k in (("old", "x", zero, 99), ("new", "x", B.fit_bias(d), 149), ("other", "y", zero, 180), ("fresh", "x", zero, 500)):
        Ms.save_bias_model(folder + "/m", name, scope, table, cut(k))
    models = Ms.load_all(spark, folder + "/m")
    got = {r.name: r for r in L.evaluate_unseen(d, models, R.load_bands(), F.lit("2024-07-01")).collect()}
    assert set(got) == {"old", "new", "other"}
    assert {n: r.n_live_rows for n, r in got.items()} == {"old": 50, "new": 25, "other": 10}
    assert got["old"].sw1_height_ft_mae == pytest.approx(1.0) and got["new"].sw1_height_ft_mae == pytest.approx(0, abs=1e-9)
    assert got["other"].sw1_height_ft_mae == pytest.approx(0.5) and got["old"].sw1_direction_deg_mae == pytest.approx(20)
    assert L.evaluate_unseen(d, [], R.load_bands(), F.lit("x")) is None


def test_pruned_search_equals_the_full_grid(spark):
    from seastate.operators import swelltrack as Sw
    rnd = random.Random(8)
    rows = []
    for k in range(25):
        members = [(rnd.uniform(100, 5000), i, rnd.uniform(-42, -18), rnd.uniform(95, 125), 1.7e9 + rnd.uniform(0, 2e5), 14.0 + rnd.uniform(-1, 1), rnd.uniform(170, 260), 2.0) for i in range(rnd.randint(1, 5))]
        rows.append((k, 14.0, members))
    g = spark.createDataFrame(rows, "cluster int, tp_s double, members array<struct<distance_km:double,site:int,lat:double,lon:double,t_obs:double,tp_s:double,dp_deg:double,hs_m:double>>")
    every = F.flatten(F.transform(Sw._blocks(), lambda b: b["points"]))
    full = g.select("cluster", Sw._search(Sw._rays(F.col("members")), every).alias("f")).where("f is not null")
    want = {r.cluster: tuple(r.f) for r in full.collect()}
    assert len(want) > 5
    assert {r.cluster: tuple(r.coarse) for r in Sw.fit_source(g).collect()} == want
    least = g.select("cluster", F.explode(Sw._blocks()).alias("b"), Sw._rays(F.col("members")).alias("m"))
    bound = least.select(Sw._least_score(F.col("m"), F.col("b")).alias("lo"), Sw._search(F.col("m"), F.col("b.points"))["score"].alias("s"))
    assert bound.where("s < lo - 1e-9").count() == 0 and bound.where("s is not null").count() > 20


def test_timeline_reads_each_source_once(spark):
    from seastate.plans import q_series as Q
    from seastate.plans.views import Views
    plan = Q.timeline(Views(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    # Forecasts and readings once; the series once, and once more for the edges of its blocks, from the same exchange.
    assert plan.count("FileScan") <= 4 and plan.count("Exchange hashpartitioning") <= 9


def test_trees_hold_many_stations(spark):
    """The plan does not grow with the stations: thousands of one-hot columns overflowed the stack."""
    d = P.time_split(paired(spark))
    train, test = d.filter(~F.col("is_test")), d.filter("is_test")
    stations = ["s0", "s1"] + [f"t{i:04d}" for i in range(1500)]
    assert {r.fitted for r in Ml.fit_report(train, stations).collect()} == {True}
    models = Ml.fit_trees(train, stations, ["sw1_height_ft"], rounds=2, depth=2)
    assert models["sw1_height_ft"].stages[-1].numFeatures == len(Ml.feature_columns(stations))
    Ml.check_features(models["sw1_height_ft"], Ml.feature_columns(stations))
    with pytest.raises(ValueError):
        Ml.check_features(models["sw1_height_ft"], Ml.feature_columns(stations[::-1]))
    assert Ml.apply_trees(test, models, stations).filter("pred_sw1_height_ft is null").count() == 0
    unknown = test.withColumn("station", F.when(F.col("lead_hours") > 6, "elsewhere"))  # unknown: no station's column; null: no prediction
    got = Ml.apply_trees(unknown, models, stations)
    assert got.filter(F.col("station").isNull() != F.col("pred_sw1_height_ft").isNull()).count() == 0
