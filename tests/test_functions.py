"""Edge cases of the column functions."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from seastate.functions import circular as C
from seastate.functions import geo as G
from seastate.functions import rules as R
from seastate.functions import timefn as T
from seastate.functions import units as U


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


@pytest.mark.parametrize("a,b,want", [(350, 10, -20), (10, 350, 20), (180, 0, -180), (0, 180, -180), (90, 90, 0)])
def test_circular_difference(spark, a, b, want):
    assert one(spark, C.diff_deg(F.lit(float(a)), F.lit(float(b)))) == want


def test_mean_of_two_wraps(spark):
    assert one(spark, C.mean_of_two(F.lit(350.0), F.lit(20.0))) == pytest.approx(5.0)
    assert one(spark, C.mean_of_two(F.lit(350.0), F.lit(None).cast("double"))) is None


def test_lerp_takes_the_side_that_exists(spark):
    none = F.lit(None).cast("double")
    assert one(spark, C.lerp(none, F.lit(2.0), F.lit(0.5))) == 2.0
    assert one(spark, C.lerp_deg(F.lit(350.0), F.lit(10.0), F.lit(0.5))) % 360 == pytest.approx(0.0, abs=1e-9)


@pytest.mark.parametrize("text,want", [("99", None), ("999.0", None), ("MM", None), ("", None), ("1.5", 1.5), ("x", None)])
def test_numbers_and_fills(spark, text, want):
    assert one(spark, U.parse_number(F.lit(text))) == want


@pytest.mark.parametrize("text,want", [("99", 99.0), ("999", None), ("ESE", 112.0), (" nnw ", 337.0), ("MM", None)])
def test_direction_keeps_99_degrees(spark, text, want):
    assert one(spark, U.parse_direction(F.lit(text))) == want


def test_snap_rounds_half_up(spark):
    at = lambda h, m, s=0: F.lit(dt.datetime(2024, 1, 1, h, m, s))
    assert one(spark, T.snap_hour(at(3, 29, 59))).hour == 3
    assert one(spark, T.snap_hour(at(3, 30))).hour == 4
    assert one(spark, T.snap_hour(F.lit(dt.datetime(2023, 12, 31, 23, 45)))) == dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("text", ["2024-01-05T06:00:00Z", "2024-01-05T06:00:00+00:00", "2024-01-05T06:00:00.000000", "2024-01-05 06:00:00"])
def test_iso_spellings(spark, text):
    assert one(spark, T.parse_iso(F.lit(text))) == dt.datetime(2024, 1, 5, 6)


def test_local_time_across_the_clock_change(spark):
    before = one(spark, T.local_to_utc(F.lit("2024-03-10 01:00:00").cast("timestamp"), "America/New_York"))
    after = one(spark, T.local_to_utc(F.lit("2024-03-10 03:00:00").cast("timestamp"), "America/New_York"))
    assert (after - before).total_seconds() == 3600


def test_negative_lead(spark):
    lead = T.lead_hours(F.lit("2024-01-01 22:00:00").cast("timestamp"), F.lit("2024-01-02 00:00:00").cast("timestamp"))
    assert one(spark, lead) == -2


def test_swell_ladder_bounds_and_nulls(spark):
    bands = R.load_bands()
    cat = lambda h, p: one(spark, R.swell_category(F.lit(h).cast("double"), F.lit(p).cast("double"), bands))
    first, second = bands[1].rules[0].bound, bands[1].period_ub - 0.1
    assert cat(first - 0.01, second) == "FLAT"
    assert cat(first, second) == "WEAK"       # a bound is not below itself
    assert [cat(100.0, b.period_ub - 0.1) for b in bands[:-1]] == [b.rules[-1].category for b in bands[:-1]]   # past every bound
    assert cat(100.0, bands[0].period_ub - 0.01) == "FLAT"
    assert cat(None, 12.0) == "FLAT" and cat(5.0, None) == "FLAT"


def test_ladder_reads_every_spelling(tmp_path, spark):
    f = tmp_path / "b.toml"
    f.write_text('[[band]]\nperiod_upper_bound = "inf"\nFLAT = "2"\nFUN = "never"\nSOLID = ">=4"\nFIRING = "junk"\n'
                 '[[band]]\nperiod_upper_bound = 5\nWEAK = "always"\n')
    bands = R.load_bands(str(f))
    assert [b.period_ub for b in bands] == [5.0, float("inf")]
    assert [(r.category, r.op) for r in bands[1].rules] == [("FLAT", "lt"), ("SOLID", "gte")]
    assert one(spark, R.swell_category(F.lit(3.0), F.lit(9.0), bands)) == "SOLID"


def test_directed_box_needs_a_direction(spark):
    boxes, low = R.load_boxes(), R.load_box_categories()[0]
    with_dir = one(spark, R.box_category(F.lit(6.0), F.lit(15.0), F.lit(200.0), boxes, low))
    without = one(spark, R.box_category(F.lit(6.0), F.lit(15.0), F.lit(None).cast("double"), boxes, low))
    assert with_dir == "DREAMY" and without == "FIRING"
    df = spark.createDataFrame([(6.0, 15.0, 200.0), (6.0, 15.0, None), (None, 15.0, 200.0)], "h double, p double, d double")
    assert [r.category for r in R.match_boxes(df, boxes, "h", "p", "d", low).collect()] == ["DREAMY", "FIRING", "FLAT"]


def test_wind_rating_without_direction(spark):
    r = R.load_shore_ladder()
    none = F.lit(None).cast("double")
    rate = lambda s, d: one(spark, R.shore_rating(s, d, F.lit(90.0), r))
    assert rate(F.lit(1.0), none) == "LULL" and rate(F.lit(20.0), none) is None and rate(none, F.lit(1.0)) is None
    assert rate(F.lit(5.0), F.lit(275.0)) == "SLICK" and rate(F.lit(40.0), F.lit(90.0)) == "TORN" and rate(F.lit(40.0), F.lit(270.0)) == "BLASTED"
    assert one(spark, R.shore_rating(F.lit(1.0), F.lit(1.0), none, r)) is None
    assert R.ridable_names(r) == ["BRUSHED", "LULL", "RUFFLED", "SLICK"]


def test_window_is_the_rose(spark):
    w = R.SwellWindow(((100.0, 0.0), (120.0, 0.8), (130.0, 0.8), (140.0, 0.2)), 7.0)
    at = lambda d: one(spark, R.window_weight(F.lit(d).cast("double"), w))
    assert w.edge == (100.0, 140.0) and w.core == (120.0, 130.0)
    assert [at(d) for d in (99.9, 110.0, 485.0, 140.0, 140.1, None)] == pytest.approx([0.0, 0.4, 0.8, 0.2, 0.0, 0.0])
    score = lambda h, p, d: one(spark, R.window_score(*(F.lit(x).cast("double") for x in (h, p, d)), w))
    assert score(2, 7, 125) == pytest.approx(4 * 7 * 0.8) and [score(2, 6.9, 125), score(None, 7, 125), score(0, 7, 125), score(2, 7, None)] == [0.0] * 4


@pytest.mark.parametrize("n, directed", [(1, True), (40, True), (10_000, True), (300, False)])
def test_box_index_equals_the_first_box_that_holds(spark, n, directed):
    rnd = random.Random(n)
    inf = math.inf
    span = lambda top, wide: (lambda a: (a, inf if rnd.random() < 0.05 else a + rnd.uniform(0, wide)))(rnd.uniform(0, top))
    boxes = [R.Box(k + 1, f"c{rnd.randrange(9)}", span(20, 4), span(15, 3), (lambda a: (a, a + 90))(rnd.uniform(0, 270)) if directed and rnd.random() < 0.5 else None)
             for k in range(n)]
    rows = [(k, rnd.choice([None, rnd.uniform(-1, 25), rnd.choice(boxes).period[0]]), rnd.choice([None, rnd.uniform(-1, 20), rnd.choice(boxes).height[0]]),
             rnd.choice([None, rnd.uniform(0, 360)])) for k in range(300)]

    def plain(p, h, d):
        if p is None or h is None:
            return "low"
        fits = lambda b: b.period[0] <= p < b.period[1] and b.height[0] <= h < b.height[1] and (b.direction is None or (d is not None and b.direction[0] <= d < b.direction[1]))
        return next((b.category for b in boxes if fits(b)), "low")

    df = spark.createDataFrame(rows, "k int, p double, h double, d double")
    got = R.match_boxes(df, boxes, "h", "p", "d", "low")
    assert {r.k: r.category for r in got.collect()} == {k: plain(p, h, d) for k, p, h, d in rows}
    if n <= 40:  # the CASE form
        case = df.select("k", R.box_category(F.col("h"), F.col("p"), F.col("d"), boxes, "low").alias("c"))
        assert {r.k: r.c for r in case.collect()} == {r.k: r.category for r in got.collect()}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_destination_returns(spark):
    lat2 = G.destination_lat(F.lit(-30.0), F.lit(215.0), F.lit(3000.0))
    lon2 = G.destination_lon(F.lit(-30.0), F.lit(110.0), F.lit(215.0), F.lit(3000.0), lat2)
    assert one(spark, G.haversine_km(F.lit(-30.0), F.lit(110.0), lat2, lon2)) == pytest.approx(3000.0, rel=1e-9)
    assert one(spark, G.bearing_deg(F.lit(-30.0), F.lit(110.0), lat2, lon2)) == pytest.approx(215.0)


def test_verdict_ignores_missing(spark):
    none = F.lit(None).cast("double")
    levels = [R.Level("agree", 1.0, 15.0), R.Level("close", 2.0, 30.0)]
    say = lambda h, d: one(spark, R.verdict(h, d, levels, "diverge"))
    assert say(none, none) is None
    assert say(F.lit(0.5), none) == "agree" and say(none, F.lit(20.0)) == "close"
    assert say(F.lit(1.5), F.lit(10.0)) == "close"
    assert say(F.lit(0.0), F.lit(31.0)) == "diverge"


def test_skill_weights_sum_to_one():
    from seastate.operators.metrics import SKILL_WEIGHTS
    assert abs(sum(SKILL_WEIGHTS.values()) - 1.0) < 1e-9


def test_curve_and_ladder(spark):
    at = lambda x: one(spark, R.curve(F.lit(x).cast("double"), [[1.0, 0.0], [3.0, 1.0], [5.0, 0.5]]))
    assert [at(x) for x in (0.0, 1.0, 2.0, 3.0, 4.0, 9.0, None)] == [0.0, 0.0, 0.5, 1.0, 0.75, 0.5, None]
    ladder = [R.WindStep("a", 180.0, 3.0, 1.0, True), R.WindStep("b", 45.0, 10.0, 1.0, True), R.WindStep("c", 180.0, float("inf"), 0.0, False)]
    rate = lambda s, d: one(spark, R.ladder_rating(F.lit(s).cast("double"), F.lit(d).cast("double"), F.lit(10.0), ladder))
    assert [rate(2, 200), rate(3, 0), rate(4, 350), rate(4, 100), rate(11, 10), rate(None, 0), rate(1, None)] == ["a", "a", "b", "c", "c", None, None]


def test_mean_of_opposite_bearings_is_that_of_the_database(spark):
    """Only the last digits of sine and cosine decide there, so these have to be the C library's."""
    import duckdb

    from seastate.plans.ctes import circ_mean

    got = {r.a: r.m for r in spark.range(360).select(F.col("id").alias("a"), C.mean_of_two(
        F.col("id").cast("double"), ((F.col("id") + 180) % 360).cast("double")).alias("m")).collect()}
    want = dict(duckdb.sql(f"SELECT a, {circ_mean('a::DOUBLE', '((a + 180) % 360)::DOUBLE')} FROM (SELECT unnest(range(360)) AS a)").fetchall())
    far = [a for a in want if abs((got[a] - want[a] + 180) % 360 - 180) > 1e-6]
    assert not far


def test_ties_at_the_sixth_decimal_fall_as_in_the_database(spark):
    import duckdb

    from seastate.plans.ctes import r6
    from seastate.plans.registry import presentable

    x = [-0.31956249999999997, 4.0094875, 1.6481874999999997, -2.5, 1e300, 1.7e308, float("inf"), 0.0]
    got = [r.x for r in presentable(spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, x double")).orderBy("i").collect()]
    assert got == [duckdb.execute(f"SELECT {r6('?')}", [v]).fetchone()[0] for v in x]
