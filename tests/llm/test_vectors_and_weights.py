"""Importance resampling, toxicity and vector codes, against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from seastate.llm import cellcodes, queries, resample, toxicity

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_features(text, most):
    w = WORD.findall((text or "").translate(A_TO_Z))
    return w, [" ".join(w[i : i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1)]


def plain_resample(docs, target, most=1, buckets=10_000, percent=10, min_words=20):
    bucket = lambda f: crc32(f.encode()) % buckets
    count = lambda texts: Counter(bucket(f) for t in texts for f in plain_features(t, most)[1])
    s, t = count(x for _, x in docs), count(target)
    gain = [math.floor(1000 * math.log((t[k] + 1) * (t_all := s.total() + buckets) / ((s[k] + 1) * (t.total() + buckets)))) for k in range(buckets)]
    assert t_all
    out = []
    for i, text in docs:
        ws, fs = plain_features(text, most)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in fs)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(ws) >= min_words])
    fit = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize("most", [1, 3])
def test_resampling_equals_plain_counts(spark, odd, most):
    target = ["abc def ghi " * 9, None, "", "é漢 Zß _x_ 1-2"]
    got = resample.resample(odd, spark.createDataFrame([(t,) for t in target], "text string"), most, percent=40)
    rows = sorted((tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)
    assert rows == plain_resample([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()], target, most, percent=40)
    assert [r for r in rows if r[4]] and len(rows) == odd.count()
    drawn = resample.drawn_documents(odd, got)
    assert drawn.columns == odd.columns and drawn.count() >= len([r for r in rows if r[4]])


def test_resampling_of_nothing(spark, none, odd):
    assert resample.resample(none, none).collect() == []
    assert {r.weight for r in resample.resample(odd, none).where("n_words = 0").collect()} == {0}
    assert resample.resample(none, odd).count() == 0


def test_resampling_prefers_the_target(spark):
    rng = random.Random(3)
    say = lambda ws: " ".join(rng.choices(ws, k=40))
    near, far = [f"n{k}" for k in range(50)], [f"f{k}" for k in range(50)]
    docs = spark.createDataFrame([(i, say(near if i % 10 == 0 else far)) for i in range(1000)], "doc_id long, text string")
    got = resample.resample(docs, spark.createDataFrame([(say(near),) for _ in range(30)], "text string")).where("rank is not null").collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 101)) and all(r.doc_id % 10 == 0 for r in got)


def said(rng, *more):
    ws = [f"w{rng.randrange(300)}" for _ in range(rng.randint(5, 60))] + list(more)
    rng.shuffle(ws)
    return " ".join(ws)


def sides(n):
    return [i for i in range(n) if crc32(str(i).encode()) % 3 == 1], [i for i in range(n) if crc32(str(i).encode()) % 3 != 1]


def test_toxicity_learns_pairs_that_no_sum_of_weights_can_tell(spark):
    """Each of two words alone is harmless in half the texts and toxic in the other half: only the pair tells."""
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(6000):
        a, b = rng.random() < 0.3, rng.random() < 0.3
        rows.append((i, said(rng, *(["Rotten"] if a else []), *(["zorgs"] if b else []))))
        labels.append((i, int(a and b)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    truth = dict(labels)

    def right(cfg):
        return np.mean([r.predicted == truth[r.doc_id] for r in toxicity.judge(docs, marks, cfg).where("held_out").collect()])

    assert right(toxicity.ToxicityConfig()) > 0.99
    m = toxicity.learn(docs, marks)
    terms = {w: int(toxicity.term_rows(next(toxicity.chunks(pa.array([w]))))[1][0]) for w in ("rotten", "zorgs")}
    a, b = (int(np.searchsorted(m.terms, terms[w])) for w in ("rotten", "zorgs"))
    assert m.terms[a] == terms["rotten"] and m.terms[b] == terms["zorgs"] and m.factor[a] @ m.factor[b] > 0.5


def test_toxicity_never_reads_held_out_labels(spark):
    rng = random.Random(5)
    held, mine = sides(900)
    rows = [(i, said(rng, *(["scum"] if i % 2 else []))) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    label = lambda flip: spark.createDataFrame([(i, i % 2) for i in mine] + [(i, 1 - i % 2 if flip else i % 2) for i in held], "doc_id long, toxic int")
    one, other = (sorted(map(tuple, toxicity.judge(docs, label(f)).collect())) for f in (False, True))
    assert one == other and {r[0] for r in one if r[1]} == set(held)
    assert all(r[3] == r[0] % 2 for r in one)
    assert sorted(map(tuple, toxicity.judge(docs.repartition(7), label(False).repartition(3)).collect())) == one


def test_toxicity_logits():
    """Bias, weights and all pairs of factor vectors."""
    rng = np.random.default_rng(1)
    m = toxicity.Machine(np.arange(6), 0.3, rng.normal(size=6), rng.normal(size=(6, 3)))
    row, term = np.array([0, 0, 0, 1, 1]), np.array([0, 2, 5, 1, 2])
    want = [0.3 + sum(m.weight[t] for t in s) + sum(m.factor[a] @ m.factor[b] for k, a in enumerate(s) for b in s[k + 1 :]) for s in ([0, 2, 5], [1, 2])]
    assert np.allclose(m.logits(row, term, 2), want)
    assert np.allclose(m.logits(row[:0], term[:0], 2), 0.3)


def test_toxicity_on_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(3, 1), (3, 0), (4, None), (None, 1), (9, 1), (10, 0), (77, 1)], "doc_id long, toxic int")
    got = toxicity.judge(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted in (0, 1) and r.held_out is not None for r in got)
    assert len({r.score for r in got if r.doc_id in (0, 1, 2)}) == 1
    empty = labels.limit(0)
    assert {r.score for r in toxicity.judge(odd, empty).collect()} == {0.5}
    assert toxicity.judge(none, labels).collect() == [] and toxicity.judge(none, empty).collect() == []


def test_toxicity_query_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    got = queries.QUERIES["op12_toxicity"](spark, folder)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
    held = got.where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").select("predicted", "toxic").collect()
    hits = sum(r.predicted and r.toxic for r in held)
    assert hits >= 0.97 * sum(r.predicted for r in held) and hits >= 0.7 * sum(r.toxic for r in held)


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """rows: (id, vector, label); every part against every entry."""
    fine = [(i, [math.floor(1024 * x) for x in v], g) for i, v, g in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    fine.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not fine:
        return [], None
    w = len(fine[0][1]) // parts
    x = np.array([r[1] for r in fine], np.int64).reshape(len(fine), parts, w)
    books = x[:entries].transpose(1, 0, 2).copy()
    for k in range(rounds + 1):
        d = ((x.transpose(1, 0, 2)[:, :, None] - books[:, None]) ** 2).sum(3)
        code = d.argmin(2)
        if k < rounds:
            for p in range(parts):
                for e in set(code[p].tolist()):
                    mine = x[code[p] == e, p]
                    books[p, e] = mine.sum(0) // len(mine)
    error = d.min(2).sum(0).tolist()
    total = Counter()
    for (_, _, g), e in zip(fine, error, strict=True):
        total[g] += e
    sha = hashlib.sha256(",".join(str(v) for v in books.ravel().tolist()).encode()).hexdigest()
    return sorted(((i, "".join(f"{c:02x}" for c in code[:, j]), error[j], total[g], sha) for j, (i, _, g) in enumerate(fine)), key=str), books


def spark_codes(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    codes, books = cellcodes.compress(df, **how)
    full = cellcodes.with_label_errors(codes).collect()
    return sorted(((r.vec_id, r.code, r.error, r.label_error, cellcodes.digest(books)) for r in full), key=str), codes, books


def test_codes_equal_the_plain_search(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(0, 0.2, (600, 12))
    v[100:200] = v[0]  # ties, repeated vectors
    v[200:300] = rng.normal(0, 0.01, (100, 12)) + 3  # far from all first entries
    rows = [(int(i), x.tolist(), None if i % 7 == 0 else int(i % 3)) for i, x in zip(rng.permutation(600), v, strict=True)]
    rows += [(5, rows[5][1], 1), (None, rows[7][1], None), (900, None, 1), (901, [None] + [0.0] * 11, 1), (902, [math.nan] * 12, 1), (903, [math.inf] + [0.0] * 11, 2), (904, [], 1)]
    for how in ({"entries": 32}, {"entries": 256, "rounds": 1}, {"parts": 3, "entries": 40}, {"parts": 2, "entries": 1}):
        got, codes, books = spark_codes(spark, rows, **how)
        want, plain = plain_codes(rows, **how)
        assert got == want and len(got) == 602 and (books == plain).all()
    decoded = {r.vec_id: r.x for r in cellcodes.decode(codes, books, 12).collect()}
    assert decoded[0] == [int(x) for x in np.concatenate([books[0, 0], books[1, 0]])]


@pytest.mark.parametrize("scale", [1, 40, 900, 60_000, 1 << 26])
@pytest.mark.parametrize("keep", [cellcodes.BOXES, 40])
def test_boxes_never_lose_the_nearest_entry(scale, keep):
    rng = np.random.default_rng(scale)
    book = rng.integers(-scale, scale + 1, (64, 5))
    boxes = cellcodes.Boxes(book, keep)
    for _ in range(3):
        p = np.concatenate([rng.integers(-2 * scale, 2 * scale + 1, (1500, 5)), book, book + 1])
        d = ((p[:, None] - book[None]) ** 2).sum(2)
        code, dist = boxes.nearest(p)
        assert (code == d.argmin(1)).all() and (dist == d.min(1)).all() and len(boxes.keys) <= keep


def test_boxes_are_kept_and_shorten_the_search():
    rng = np.random.default_rng(3)
    book = np.concatenate([rng.integers(0, 60, (32, 4)), 5000 + rng.integers(0, 60, (32, 4))])
    boxes = cellcodes.Boxes(book)
    p = np.repeat(rng.integers(0, 60, (50, 4)), 40, axis=0)
    lists = boxes.lists_of(boxes.cell(p))
    assert not lists[:, 32:].any() and len(boxes.keys) <= 50
    asked = []
    boxes.entry_lists = lambda cells: asked.append(len(cells)) or np.ones((len(cells), 64), bool)
    assert (boxes.lists_of(boxes.cell(p)) == lists).all() and sum(asked) == 0


def test_codes_of_odd_tables(spark):
    assert spark_codes(spark, [])[0] == []
    assert spark_codes(spark, [(1, None, 1), (2, [], None)])[0] == []
    one = spark_codes(spark, [(7, [0.5, -0.5, 0.25, 1.0], None)])[0]
    assert one == plain_codes([(7, [0.5, -0.5, 0.25, 1.0], None)])[0]
    # Another length than the smallest id's is dropped; a length that is no multiple is filled up with zeros.
    got, codes, books = spark_codes(spark, [(1, [0.1] * 6, 1), (2, [0.2] * 6, 1), (3, [0.3] * 8, 1), (4, [1e300] * 6, 2)])
    assert [r[0] for r in got] == [1, 2, 4] and books.shape == (4, 3, 2) and {r[2] for r in got} == {0}
    with pytest.raises(ValueError):
        cellcodes.compress(spark.createDataFrame([], "vec_id long, embedding array<double>, label int"), entries=300)


def test_training_rounds_share_out_every_window():
    from seastate.llm import attention as A
    from seastate.llm import lmscore

    n, row = np.array([1, 24, 25, 700]), np.array([0, 1, 1, 0])
    seen = np.concatenate([lmscore.picked(n, row, t) for t in range(lmscore.ROUNDS)])
    assert sorted(seen.tolist()) == list(range(len(A.windows(n)[0])))
