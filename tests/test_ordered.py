"""Blocked series operators against brute force, with gaps, hot series and tiny blocks."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from seastate.operators import ordered as O

T0 = dt.datetime(2024, 1, 1)


def series(seed, hot=True):
    """One hot station with most rows, some small ones, long gaps."""
    rnd = random.Random(seed)
    rows = []
    for name, n in (("hot", 300 if hot else 40), ("b", 25), ("c", 1), ("d", 40)):
        at = 0
        for _ in range(n):
            at += rnd.choice([1, 1, 1, 2, 5, 400])
            rows.append((name, T0 + dt.timedelta(minutes=at), round(rnd.random() * 10, 3)))
    return rows


SCHEMA = "k string, t timestamp, v double"


@pytest.mark.parametrize("width", [60, 3600, 10 * O.DAY])
def test_neighbours(spark, width):
    rows = series(1)
    got = {(r.k, r.t): (r.prev_v, r.next_v) for r in O.neighbours(
        spark.createDataFrame(rows, SCHEMA), ["k"], O.epoch(F.col("t")), ["v"], width).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        s = sorted(r for r in rows if r[0] == k)
        for i, r in enumerate(s):
            want[(k, r[1])] = (s[i - 1][2] if i else None, s[i + 1][2] if i + 1 < len(s) else None)
    assert got == want


@pytest.mark.parametrize("width", [120, 7200])
def test_running_sum(spark, width):
    rows = series(2)
    got = {(r.k, r.t): r.total for r in O.running_sum(
        spark.createDataFrame(rows, SCHEMA), ["k"], O.epoch(F.col("t")), F.col("v"), width, "total").collect()}
    for k in {r[0] for r in rows}:
        acc = 0.0
        for r in sorted(x for x in rows if x[0] == k):
            acc += r[2]
            assert got[(k, r[1])] == pytest.approx(acc)


@pytest.mark.parametrize("width", [60, 3600, 10 * O.DAY])
@pytest.mark.parametrize("copies", [False, True])
def test_as_of_and_nearest(spark, width, copies):
    left, right = series(3), series(4)
    if copies:
        left = left + left[:50]
    tol = 1800
    out = O.nearest(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, "k string, at timestamp, w double"), ["k"],
                    "t", "at", ["w"], tol, width=width).collect()
    assert len(out) == len(left)
    for r in out:
        cands = [(abs((x[1] - r.t).total_seconds()), x[1]) for x in right if x[0] == r.k]
        cands = [c for c in cands if c[0] <= tol]
        assert r.match_at == (min(cands)[1] if cands else None)


def test_collapse_copies_keeps_every_row(spark):
    left = [("a", T0, 1.0)] * 40 + [("a", T0 + dt.timedelta(hours=1), 2.0)]
    right = [("a", T0 - dt.timedelta(minutes=5), 7.0)]
    out = O.as_of(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, "k string, at timestamp, w double"), ["k"],
                  "t", "at", ["w"], collapse_copies=True)
    assert out.count() == 41 and out.filter(F.col("before.w") == 7.0).count() == 41


@pytest.mark.parametrize("gap,hit", [(1800, True), (1801, False)])
def test_tolerance_is_inclusive(spark, gap, hit):
    l = spark.createDataFrame([("a", T0, 1.0)], SCHEMA)
    r = spark.createDataFrame([("a", T0 + dt.timedelta(seconds=gap), 2.0)], "k string, at timestamp, w double")
    assert (O.nearest(l, r, ["k"], "t", "at", ["w"], 1800).first().w is not None) == hit


def test_earlier_wins_a_tie(spark):
    l = spark.createDataFrame([("a", T0, 1.0)], SCHEMA)
    r = spark.createDataFrame([("a", T0 + dt.timedelta(minutes=m), float(m)) for m in (-10, 10)], "k string, at timestamp, w double")
    assert O.nearest(l, r, ["k"], "t", "at", ["w"], 1800).first().w == -10.0


def test_dense_position(spark):
    rows = series(5)
    out = O.dense_position(spark.createDataFrame(rows, SCHEMA), ["k"], O.epoch(F.col("t")), 3600, "pos", "n").collect()
    for k in {r[0] for r in rows}:
        mine = sorted((r.t, r.pos, r.n) for r in out if r.k == k)
        assert [p for _, p, _ in mine] == list(range(1, len(mine) + 1))
        assert {n for _, _, n in mine} == {len(mine)}


def test_best_solution_equals_the_ranked_solutions(spark):
    """Readings traced in arrays against every solution listed by ``translate``, ranked in plain Python."""
    from seastate.operators import swelltrack as Sw

    rnd = random.Random(21)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, rnd.uniform(-60, 10), rnd.uniform(40, 170), t0 + dt.timedelta(hours=rnd.randrange(500)), rnd.uniform(0.1, 6),
             rnd.choice([None, 0.0, *[rnd.uniform(6, 22)] * 9]), rnd.uniform(0, 360)) for i in range(3000)]
    d = spark.createDataFrame(rows, "site long, lat double, lon double, time timestamp, hs_m double, tp_s double, dp_deg double").withColumn("now", F.col("time"))
    t = Sw.Target()
    core = F.when(F.col("in_core"), 0).otherwise(1)
    want = {}
    all_ = Sw.translate(d.filter("tp_s > 0"), t, "now").select("site", core.alias("core"), Sw.belt_distance(F.col("src_lat")).alias("belt"), "tau_h", "lead_h", "theta")
    for r in all_.collect():
        want.setdefault(r.site, []).append(r)
    got = {r.site: r for r in Sw.best_solution(d, t, "now").collect()}
    assert set(got) == set(want) and len(want) > 300
    for site, rs in want.items():
        best, g = min(rs, key=lambda r: (r.core, round(r.belt * 2000), r.tau_h)), got[site]
        assert (g.tau_h, g.n_solutions, g.dir_min, g.dir_max) == (best.tau_h, len(rs), min(round(r.theta) for r in rs), max(round(r.theta) for r in rs))
        assert abs(g.lead_h - best.lead_h) < 1e-9 and abs(g.lead_min - min(r.lead_h for r in rs)) < 1e-6 and abs(g.lead_max - max(r.lead_h for r in rs)) < 1e-6


def test_traced_directions_hold_the_first_ones():
    from seastate.plans import q_swell

    assert q_swell.TRACED[0] <= 165 and q_swell.TRACED[1] >= 250
    assert q_swell.TRACE.window.edge == q_swell.TRACED
