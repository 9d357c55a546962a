"""Cases that reviewers found on odd inputs."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from seastate.operators import bias as B
from seastate.plans.catalog import ORACLES, QUERIES
from tests.compare import compare, connect

T0 = dt.datetime(2024, 1, 1)


def events(folder, rows):
    """An event table of (ts, user, type, value, k) beside nothing else, as the queries read it."""
    con = duckdb.connect()
    con.execute("CREATE TABLE e (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    con.executemany("INSERT INTO e VALUES (?, ?, ?, ?, ?, ?)", [(i, t, u, e, v, f'{{"k": {k}}}') for i, (t, u, e, v, k) in enumerate(rows)])
    con.execute(f"COPY e TO '{folder}/events.parquet' (FORMAT parquet)")
    return folder


def differs(spark, name, folder):
    return compare(spark, connect(folder), QUERIES[name], ORACLES[name], folder)[0]


def test_smoothing_reaches_leads_three_hours_apart(spark):
    rows = [("s", 3 * l, "v", float(l * l), None, None, 1 + l % 3) for l in range(8)]
    df = spark.createDataFrame(rows, "station string, lead_hours int, variable string, bias double, s double, c double, n long")
    got = {r.lead_hours: r.bias for r in B.smooth_leads(df, 2, 3).collect()}
    for l in range(8):
        near = [(3 - abs(k), rows[l + k]) for k in range(-2, 3) if 0 <= l + k < 8]
        assert got[3 * l] == pytest.approx(sum(w * r[6] * r[3] for w, r in near) / sum(w * r[6] for w, r in near))


def test_registered_smoothing_changes_the_table(spark):
    sf = "/root/testdata/sf0.01"
    keys = ["station", "lead_hours", "variable"]
    raw, smooth = (QUERIES[n](spark, sf).select(*keys, F.coalesce("bias", "s").alias(n)) for n in ("a01_a02_bias_table", "w13_smooth_leads"))
    both = raw.join(smooth, keys)
    assert both.count() == raw.count() and both.where("a01_a02_bias_table <> w13_smooth_leads").count() > both.count() / 2
    assert differs(spark, "w13_smooth_leads", sf) is None


def test_first_wins_counts_times_to_the_second(spark, folder):
    at = lambda s, us: T0 + dt.timedelta(seconds=s, microseconds=us)
    rows = [(at(5, 100), 1, "purchase", 1.0, 1), (at(5, 900), 2, "purchase", 2.0, 2), (at(5, 900), 2, "error", 2.0, 2), (at(6, 0), 3, "purchase", 3.0, 3), (at(7, 0), 4, "click", 4.0, 4)]
    assert differs(spark, "t01_first_wins_stream", events(folder, rows)) is None


def test_tree_features_do_not_grow_with_the_stations(spark):
    """A feature a station made rows x stations numbers; digits keep every station apart, and the trees split on sets of them."""
    from seastate.operators import mlcorrect as Ml
    from tests.test_models import paired

    stations = [f"t{i:05d}" for i in range(21_600)]
    assert len(Ml.feature_columns(stations)) <= len(Ml.feature_columns([])) + 3
    codes = spark.createDataFrame([(s,) for s in [*stations[:1500], "elsewhere"]], "station string")
    for stage in Ml._numbering(stations):
        codes = stage.transform(codes)
    digits = [tuple(r) for r in codes.select(*Ml._digits(stations)).collect()]
    assert len(set(digits)) == 1501 and digits[-1] == (Ml.BASE,) * 3 and digits[33] == (2.0, 1.0, 0.0)
    model = Ml.fit_trees(paired(spark), ["s0", "s1"], ["sw1_height_ft"], rounds=2, depth=2)["sw1_height_ft"]
    assert " in {" in model.stages[-1].toDebugString


def test_box_lists_hold_no_box_that_cannot_win(spark):
    """Copies of a box, and boxes behind one that holds a whole cell, made lists as long as the table."""
    import random

    from seastate.functions import rules as R

    rnd = random.Random(4)
    schema = "rule_no int, category string, period_lo double, period_hi double, height_lo double, height_hi double, dir_lo double, dir_hi double"
    kinds = [(p, p + rnd.uniform(2, 4), h, h + rnd.uniform(2, 4), *((d, d + 90.0) if (d := rnd.choice([None, 20.0, 200.0])) is not None else (None, None)))
             for p in range(0, 20, 2) for h in range(0, 12, 2)]
    table = [(i, f"c{i % 7}", *map(lambda x: None if x is None else float(x), kinds[rnd.randrange(len(kinds))])) for i in range(3000)]
    boxes = spark.createDataFrame(table, schema)
    first = R.first_of_each(boxes)
    assert first.count() == len({r[2:] for r in table})
    n, axes = R._axes(first)
    assert max(r.k for r in R.box_index(first, n, axes).select(F.size("_boxes").alias("k")).collect()) <= len(kinds)
    rows = [(i, rnd.uniform(-1, 25), rnd.uniform(-1, 18), rnd.choice([None, rnd.uniform(0, 360)])) for i in range(500)] + [(500, None, 1.0, 1.0), (501, 1.0, None, 1.0)]
    df = spark.createDataFrame(rows, "id int, p double, h double, d double")

    def want(p, h, d):
        for _, c, pl, ph, hl, hh, dl, dh in table:
            if p is not None and h is not None and pl <= p < ph and hl <= h < hh and (dl is None or (d is not None and dl <= d < dh)):
                return c
        return "none"

    got = {r.id: r.category for r in R.match_box_table(df, boxes, "h", "p", "d", "none").collect()}
    assert got == {i: want(p, h, d) for i, p, h, d in rows}
    # Boxes with different extents, all of which hold the middle: only the first one is listed there.
    wide = spark.createDataFrame([(i, f"c{i}", i / 1000, 30 - i / 1000, i / 1000, 30 - i / 1000, None, None) for i in range(2000)], schema)
    n, axes = R._axes(wide)
    lists = R.box_index(wide, n, axes).where(F.col("_cell") == (n // 2) * n + n // 2).first()._boxes
    assert [b.rule_no for b in lists] == [0]


def test_opposite_residuals_cancel_as_in_sql(spark):
    """Bearings rounded alike: residuals of 143.5 and -36.5 degrees leave no direction, in SQL exactly, so nothing is turned."""
    from seastate.functions import circular as C

    rows = [(213.0, 64.0, 282.0), (273.0, 170.0, 185.0), (237.0, 340.0, 261.0), (333.0, 152.0, 215.0)]
    r = C.diff_deg(F.col("o"), C.mean_of_two(F.col("a"), F.col("b")))
    got = [x.r for x in spark.createDataFrame(rows, "a double, b double, o double").select(r.alias("r")).collect()]
    from seastate.plans.ctes import cdiff, circ_mean
    want = [duckdb.sql(f"SELECT {cdiff('o', circ_mean('a', 'b'))} FROM (SELECT {a}::DOUBLE a, {b}::DOUBLE b, {o}::DOUBLE o)").fetchall()[0][0] for a, b, o in rows]
    assert got == want
