"""Operator 3, n-gram Jaccard join: texts whose sets of word n-grams are similar, through MinHash bands.

*Bands.* ``bands_for`` picks rows and bands so that a pair at the threshold shares a band with the wanted chance. Each text gets
``rows * bands`` minimum hashes; one hash per band goes into the shuffle, never the text.

*Copies.* Texts with the same words are one class; only its first document goes on. The class is found by a partial aggregate, so
thousands of copies are one row per task.

*Links.* Within a band bucket every member is compared with the bucket's first member only: as many pairs as members. A pair is
verified on the full sets of n-grams. Verified pairs join texts into groups. Buckets whose members then lie in one group are done;
in the others the members outside the first one's group are compared, block by block inside the tasks, with the members of other
groups, unless the similarities to the first member rule a link out (the Jaccard distance is a metric); only the best link to
each other group leaves the task. So any two texts that share a band end in one group or have been
compared, and no link between groups is lost, while a bucket of near copies costs no more pairs than it has members.

*Counts.* ``n_links`` counts the other texts at the threshold, all of them: every linked pair lies in one group, so inside each group all
pairs are compared, on full sets, in blocks inside tasks; only a count per text and block leaves the task.

Defined results: words are runs of non-blanks; a text of fewer than n words, but not none, is one n-gram; texts without words (null
too) have no n-grams and link to nothing; equal rows are copies of each other; a null id counts as the smallest; an empty table
gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .groups import connected
from .scan import NON_SPACE, Chunk, WordSums, chunks, mix, span_hashes, spans
from .tables import runs

N, THRESHOLD, RECALL = 5, 0.8, 0.9999
SMALLEST = -(1 << 63)
BLOCK, COLUMNS = 1024, 4096
_U = np.uint64


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, most: int = 160) -> tuple[int, int]:
    """(bands, rows): most rows per band, so fewest chance meetings, that reach the recall at the threshold within ``most`` hashes."""
    for rows in range(12, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= most:
            return bands, rows
    raise ValueError("the wanted recall needs more hashes")


@lru_cache(maxsize=4)
def _factors(k: int) -> tuple[np.ndarray, np.ndarray]:
    return mix(np.arange(1, k + 1, dtype=_U)) | _U(1), mix(np.arange(k + 1, 2 * k + 1, dtype=_U))


def ngram_sets(chunk: Chunk, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(n-gram hashes of all rows on end, how many per row, words per row, two hashes of each row's words)."""
    rows = len(chunk.begin)
    w = spans(chunk, chunk.data, NON_SPACE)
    words = np.bincount(w.row, minlength=rows)
    first = np.cumsum(words) - words
    word_hash = span_hashes(chunk.data, w.start, w.end)
    sums = WordSums(word_hash)
    size = np.minimum(n, words)
    grams = np.maximum(words - n + 1, (words > 0).astype(np.int64))
    row = np.repeat(np.arange(rows), grams)
    at = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(grams) - grams, grams)
    hashes = np.zeros(len(row), _U)
    whole = size[row] == n
    hashes[whole] = sums.windows(n, at[whole])
    for k in range(1, n):
        short = size[row] == k
        hashes[short] = sums.windows(k, at[short])
    # Two hashes of the whole word sequence, from two sets of word codes.
    whole_text = []
    for salt in (_U(0), _U(0x5851F42D4C957F2D)):
        own = sums if not salt else WordSums(mix(word_hash ^ salt))
        text = np.zeros(rows, _U)
        full = words > 0
        text[full] = (own.sums[first[full] + words[full]] - own.sums[first[full]]) * own.inv[first[full]]
        whole_text.append(mix(text + words.astype(_U)))
    return hashes, grams, words, *whole_text


def sign(docs: DataFrame, bands: int, rows: int, n: int = N) -> DataFrame:
    """The given columns but the text, two hashes of the text's words (t1, t2), n_words and one hash per band (none without words)."""
    keep = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mul, add = _factors(bands * rows)
        band = mix(np.arange(bands, dtype=_U) + _U(7))
        for b in batches:
            for c in chunks(b.column("text")):
                h, grams, words, first, second = ngram_sets(c, n)
                full = np.flatnonzero(grams)
                starts = (np.cumsum(grams) - grams)[full]
                keys = np.zeros((len(full), bands), _U)
                for k in range(bands * rows if len(full) else 0):
                    low = np.minimum.reduceat((h ^ add[k]) * mul[k], starts)
                    keys[:, k % bands] = mix(keys[:, k % bands] + low)
                off = np.append(0, np.cumsum((grams > 0) * bands)).astype(np.int32)
                old = b.slice(c.first, len(grams))
                yield pa.RecordBatch.from_arrays(
                    [*(old.column(k) for k in keep), pa.array(first.view(np.int64)), pa.array(second.view(np.int64)), pa.array(words, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(off), pa.array((keys ^ band).reshape(-1).view(np.int64)))],
                    names=[*keep, "t1", "t2", "n_words", "bands"])

    schema = ", ".join(f"{c} long" for c in keep)
    return docs.mapInArrow(run, f"{schema}, t1 long, t2 long, n_words long, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, n: int = N) -> DataFrame:
    """a, b and the Jaccard similarity of their full n-gram sets; ``texts`` has id and text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}

        def grams(key: int, text: pa.Scalar) -> np.ndarray:
            if key not in sets:
                if len(sets) >= 64:
                    sets.pop(next(iter(sets)))
                sets[key] = np.unique(ngram_sets(next(chunks(pa.array([text.as_py()], pa.string()))), n)[0])
            return sets[key]

        for b in batches:
            out = np.zeros(b.num_rows)
            for i, (x, y) in enumerate(zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True)):
                one, two = grams(y, b.column("tb")[i]), grams(x, b.column("ta")[i])
                shared = len(np.intersect1d(one, two, assume_unique=True))
                out[i] = shared / max(1, len(one) + len(two) - shared)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(out)], names=["a", "b", "similarity"])

    one = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    two = one.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    return two.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, similarity double")


def across(left: DataFrame, texts: DataFrame, threshold: float, n: int) -> DataFrame:
    """Links between groups that share a bucket: a, b, similarity; for each text set apart, the best link to every other group.

    ``left`` holds bucket, id, g (group), similarity to the bucket's lead, and apart (not of the lead's group). Large buckets are
    compared in blocks of ``BLOCK`` by ``BLOCK`` texts, as products of 0/1 matrices over the n-grams that two texts share.
    """
    gap = 1 - threshold + 1e-9
    bucket = left.groupBy("bucket").agg(
        F.min(F.when(F.col("apart"), F.col("similarity"))).alias("lo"), F.max(F.when(F.col("apart"), F.col("similarity"))).alias("hi"),
        F.ceil(F.count(F.lit(1)) / BLOCK).alias("xs"), F.ceil(F.count_if("apart") / BLOCK).alias("ys"), F.min("g").alias("g0"), F.max("g").alias("g1"))
    both = left.join(bucket.where("ys > 0 and g0 != g1").drop("g0", "g1"), "bucket").where(F.col("similarity").between(F.col("lo") - gap, F.col("hi") + gap))
    place = lambda k: F.pmod(F.xxhash64("id"), F.col(k))
    every = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.col(k) - 1))
    some = ["bucket", "id", "g", "similarity"]
    x = both.select(*some, F.lit(False).alias("asks"), place("xs").alias("bx"), every("ys").alias("by"))
    y = both.where("apart").select(*some, F.lit(True).alias("asks"), place("ys").alias("by"), every("xs").alias("bx"))
    rows = x.unionByName(y).join(texts, "id").repartition("bucket", "bx", "by").sortWithinPartitions("bucket", "bx", "by", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}
        for t in runs(batches, "bucket", "bx", "by"):
            ids, g, asks = (t[k].to_numpy() for k in ("id", "g", "asks"))
            asks = asks.astype(bool)
            if asks.all() or not asks.any():
                continue
            if len(sets) > 2 * BLOCK:
                sets.clear()
            for k, key in enumerate(ids):
                if key not in sets:
                    sets[key] = np.unique(ngram_sets(next(chunks(pa.array([t["text"][k].as_py()], pa.string()))), n)[0])
            found = _best_links([sets[k] for k in ids[asks]], [sets[k] for k in ids[~asks]], g[asks], g[~asks], threshold)
            a, b, sim = ids[asks][found[0]], ids[~asks][found[1]], found[2]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b)), pa.array(sim)], names=["a", "b", "similarity"])

    return rows.mapInArrow(run, "a long, b long, similarity double")


def _best_links(ys: list[np.ndarray], xs: list[np.ndarray], gy: np.ndarray, gx: np.ndarray, threshold: float):
    """(index into ys, index into xs, similarity): per y and group of xs, the most similar x that reaches the threshold."""
    similar = _similar(ys, xs)
    fits = (similar >= threshold) & (gy[:, None] != gx[None, :])
    i, j = np.nonzero(fits)
    order = np.lexsort((-similar[i, j], gx[j], i))
    i, j = i[order], j[order]
    first = np.ones(len(i), bool)
    first[1:] = (i[1:] != i[:-1]) | (gx[j[1:]] != gx[j[:-1]])
    return i[first], j[first], similar[i[first], j[first]]


def _similar(ys: list[np.ndarray], xs: list[np.ndarray]) -> np.ndarray:
    """The Jaccard similarity of every y (row) with every x (column)."""
    size_y, size_x = np.array([len(v) for v in ys]), np.array([len(v) for v in xs])
    _, where, count = np.unique(np.concatenate(ys + xs), return_inverse=True, return_counts=True)
    column = np.cumsum(count > 1) - 1
    column[count < 2] = -1
    column = column[where]
    row = np.repeat(np.arange(len(ys) + len(xs)), np.append(size_y, size_x))
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((len(ys), len(xs)), np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + COLUMNS])
        m = np.zeros((len(ys) + len(xs), COLUMNS), np.float32)
        m[row[a:b], column[a:b] - lo] = 1
        shared += m[: len(ys)] @ m[len(ys) :].T
    # Exact at the edge: counts are whole numbers far below the limit of float32.
    return shared / np.maximum(1, size_y[:, None] + size_x[None, :] - shared).astype(np.float64)


def link_counts(grouped: DataFrame, texts: DataFrame, threshold: float, n: int) -> DataFrame:
    """id, n_links: how many other texts of its group reach the threshold with it; ``grouped`` has id and g (group).

    The texts of a group are dealt to blocks of about ``BLOCK``, and every two blocks meet in one cell.
    """
    size = grouped.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("ks"))
    dealt = grouped.join(size, "g").withColumn("k", F.pmod(F.xxhash64("id"), F.col("ks")))
    dealt = dealt.select("g", "id", "k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ks") - 1)).alias("other"))
    dealt = dealt.select("g", "id", "k", F.least("k", "other").alias("bx"), F.greatest("k", "other").alias("by"))
    rows = dealt.join(texts, "id").repartition("g", "bx", "by").sortWithinPartitions("g", "bx", "by", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, "g", "bx", "by", least=2):
            ids, k = t["id"].to_numpy(), t["k"].to_numpy()
            sets = [np.unique(ngram_sets(next(chunks(pa.array([x.as_py()], pa.string()))), n)[0]) for x in t["text"]]
            if t["bx"][0] == t["by"][0]:
                near = (_similar(sets, sets) >= threshold).sum(1) - 1
            else:
                left = k == t["bx"][0].as_py()
                if left.all() or not left.any():
                    continue
                fits = _similar([sets[i] for i in np.flatnonzero(left)], [sets[i] for i in np.flatnonzero(~left)]) >= threshold
                near = np.zeros(len(ids), np.int64)
                near[left], near[~left] = fits.sum(1), fits.sum(0)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(near, pa.int64())], names=["id", "n_links"])

    return rows.mapInArrow(run, "id long, n_links long").groupBy("id").agg(F.sum("n_links").alias("n_links"))


def classes(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, recall: float = RECALL,
            id_col: str = "doc_id", text_col: str = "text", count_links: bool = True) -> DataFrame:
    """doc_id, x1 (hash of the text), class_id (smallest id of its group), n_copies (rows with the same words), n_links, n_words.

    Without ``count_links``, n_links is null for texts that have links.
    """
    bands, rows = bands_for(threshold, recall)
    text = F.col(text_col).cast("string")
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(SMALLEST)).alias("doc_id"),
                       F.xxhash64(text).alias("x1"), F.monotonically_increasing_id().alias("row"), text.alias("text"))
    signed = materialise(sign(docs, bands, rows, n), "signed")
    # A node is a distinct word sequence; the row numbers of the stored table name it.
    node = materialise(signed.where("n_words > 0").groupBy("t1", "t2").agg(
        F.min("row").alias("id"), F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n_copies")), "nodes")
    heads = signed.join(node.select("id"), F.col("row") == F.col("id")).select("id", "doc_id", "x1", "bands")
    members = materialise(heads.select("id", "doc_id", "x1", F.explode("bands").alias("bucket")), "members")
    bucket = members.groupBy("bucket").agg(F.min("id").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    met = materialise(members.join(bucket, "bucket"), "met")
    # Only texts that met another are fetched, once each.
    wanted = met.select("id", F.col("doc_id").alias("d"), F.col("x1").alias("x")).distinct()
    texts = docs.join(wanted, (F.col("doc_id") == F.col("d")) & (F.col("x1") == F.col("x"))).select("id", "text")
    texts = materialise(texts.dropDuplicates(["id"]), "texts")

    star = materialise(verified(met.where("id != lead").select(F.col("id").alias("a"), F.col("lead").alias("b")).distinct(), texts, n), "star")
    root = connected(star.where(F.col("similarity") >= threshold))
    # Buckets that still hold several groups: compare across groups where the distances to the lead allow a link.
    grouped = met.select("id", "bucket", "lead").join(root, "id", "left").withColumn("g", F.coalesce("root", "id")).drop("root")
    split = grouped.groupBy("bucket").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo != hi").select("bucket")
    known = star.select(F.col("a").alias("id"), F.col("b").alias("lead"), "similarity")
    left = grouped.join(split, "bucket").where("id != lead").join(known, ["id", "lead"])
    left = left.join(root.select(F.col("id").alias("lead"), F.col("root").alias("lead_root")), "lead", "left")
    left = materialise(left.withColumn("apart", F.col("g") != F.coalesce("lead_root", "lead")).drop("lead", "lead_root"), "left")
    more = materialise(across(left, texts, threshold, n).select("a", "b"), "across")
    if not more.isEmpty():
        root = connected(more.unionByName(root.select(F.col("id").alias("a"), F.col("root").alias("b"))))

    linked = root.unionByName(root.select(F.col("root").alias("id"), "root").distinct()).withColumnRenamed("root", "g")
    degree = link_counts(linked, texts, threshold, n) if count_links else linked.select("id", F.lit(None).cast("long").alias("n_links"))
    degree = degree.withColumn("has_links", F.lit(True))
    placed = node.join(root, "id", "left").withColumn("root", F.coalesce("root", "id"))
    first = placed.groupBy("root").agg(F.min("first_doc").alias("class_id"))
    placed = placed.join(first, "root").join(degree, "id", "left").select(F.col("t1").alias("u1"), F.col("t2").alias("u2"), "class_id", "n_copies",
                                                                              F.when(F.col("has_links"), F.col("n_links")).otherwise(0).alias("n_links"))
    worded = signed.where("n_words > 0").join(materialise(placed, "placed"), (F.col("t1") == F.col("u1")) & (F.col("t2") == F.col("u2")))
    out = worded.select("doc_id", "x1", "class_id", "n_copies", "n_links", "n_words")
    alone = signed.where("n_words = 0").select("doc_id", "x1", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("n_copies"),
                                               F.lit(0).cast("long").alias("n_links"), "n_words")
    back = F.when(F.col("doc_id") != SMALLEST, F.col("doc_id"))
    return out.unionByName(alone).withColumns({"doc_id": back, "class_id": F.when(F.col("class_id") != SMALLEST, F.col("class_id"))})


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each group, with all its columns: the one with the smallest id; of rows with that id and text, one."""
    found = classes(docs, count_links=False).where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("kept_id"), F.col("x1").alias("kept_x")).distinct()
    mine = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.xxhash64(F.col("text").cast("string")).alias("x"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(SMALLEST)).alias("id"))
    kept = mine.join(found, (F.col("id") == F.coalesce("kept_id", F.lit(SMALLEST))) & (F.col("x") == F.col("kept_x")))
    return kept.dropDuplicates(["id", "x"]).select("doc.*")
