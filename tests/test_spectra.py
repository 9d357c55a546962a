"""Spectral decomposition against a plain restatement of the method."""

import math
import random

import pytest
from pyspark.sql import functions as F

from seastate.operators import spectra as S

SCHEMA = f"id int, bins array<{S.BIN}>"


def restated(bins):
    """(height, period, direction) of the strongest two partitions."""
    bins = sorted(bins)
    n = len(bins)
    f, e, d = ([b[i] for b in bins] for i in range(3))
    width = [f[1] - f[0] if i == 0 else f[-1] - f[-2] if i == n - 1 else (f[i + 1] - f[i - 1]) / 2 for i in range(n)]
    band = [i for i in range(n) if f[i] <= 1 / 6 + 0.015]
    swell = [i for i in range(n) if f[i] <= 1 / 6]
    kept = []
    for i in band[1:-1]:
        if not (e[i] > e[i - 1] and e[i] > e[i + 1] and e[i] > 0.005):
            continue
        if kept:
            p = kept[-1]
            turn = abs((d[p] - d[i] + 180) % 360 - 180) if None not in (d[p], d[i]) else 360
            if turn < 35 and min(e[p:i + 1]) / min(e[p], e[i]) >= 0.7:
                kept[-1] = i if e[i] > e[p] else p
                continue
        kept.append(i)
    low = lambda a, b: min(range(a, b + 1), key=lambda j: e[j])
    out = []
    for r, pk in enumerate(kept):
        if pk not in swell:
            continue
        a = low(kept[r - 1], pk) + 1 if r else 0
        b = low(pk, kept[r + 1]) if r + 1 < len(kept) else swell[-1]
        part = [j for j in swell if a <= j <= b]
        m0 = sum(e[j] * width[j] for j in part)
        if m0 <= 0:
            continue
        h = round(4 * math.sqrt(m0) * 3.28084, 1)
        tm = sum(e[j] * width[j] / f[j] for j in part) / m0
        s = sum(e[j] * width[j] * math.sin(math.radians(d[j])) for j in part if d[j] is not None)
        c = sum(e[j] * width[j] * math.cos(math.radians(d[j])) for j in part if d[j] is not None)
        if h >= 0.2 and tm >= 6:
            out.append((-h * tm * tm, h, round(tm, 1), round(math.degrees(math.atan2(s, c)) % 360)))
    return [x[1:] for x in sorted(out, key=lambda x: x[0])[:2]]


def spectrum(rnd, n):
    f, bins = 0.02, []
    for _ in range(n):
        f += rnd.choice([0.005, 0.01])
        bins.append((round(f, 4), rnd.random() ** 3 * 2, rnd.choice([None, 10.0, 20.0, 200.0, 355.0, rnd.random() * 360])))
    return bins


def test_random_spectra(spark):
    rnd = random.Random(7)
    data = [(i, spectrum(rnd, rnd.choice([3, 8, 20, 40]))) for i in range(60)]
    got = {r.id: [(c.height_ft, c.period_s, c.direction_deg) for c in r.components]
           for r in S.decompose(spark.createDataFrame(data, SCHEMA), ["id"]).collect()}
    for i, bins in data:
        assert got[i] == [pytest.approx(w, abs=0.11) for w in restated(bins)], i


def case(spark, energies, dirs=None, start=0.05, step=0.01):
    bins = [(start + step * i, float(e), (dirs or [100.0] * len(energies))[i]) for i, e in enumerate(energies)]
    return S.with_peaks(spark.createDataFrame([(1, bins)], SCHEMA), ["id"]).first()


def test_two_peaks_merge_only_when_shallow_and_aligned(spark):
    shallow = [0.1, 1.0, 0.8, 1.2, 0.1, 0.1]
    assert [p.i for p in case(spark, shallow).merged] == [3]
    assert [p.i for p in case(spark, [0.1, 1.0, 0.5, 1.2, 0.1, 0.1]).merged] == [1, 3]
    assert [p.i for p in case(spark, shallow, [0.0, 0.0, 0.0, 90.0, 0.0, 0.0]).merged] == [1, 3]
    assert [p.i for p in case(spark, shallow, [350.0, 350.0, 0.0, 10.0, 0.0, 0.0]).merged] == [3]


def test_no_peak_and_edges(spark):
    assert case(spark, [5, 4, 3, 2, 1]).peaks == []
    assert case(spark, [0.001, 0.004, 0.001, 0.001]).peaks == []
    assert S.decompose(spark.createDataFrame([(1, [(0.05, 1.0, 1.0), (0.06, 2.0, 1.0)])], SCHEMA), ["id"]).first().components == []


def test_direction_is_matched_on_frequency(spark):
    e = spark.createDataFrame([(1, f, 1.0) for f in (0.1, 0.2, 0.3)], "id int, freq double, energy double")
    d = spark.createDataFrame([(1, 0.3, 30.0), (1, 0.2, 999.0)], "id int, freq double, dir double")
    got = {r.freq: r.dir for r in S.join_direction(e, d, ["id"]).collect()}
    assert got == {0.1: None, 0.2: None, 0.3: 30.0}
