"""Operator 7, language-model scoring: log10 probabilities of whole texts under a causal self-attention model trained here.

*Words and subwords.* Texts are lower-cased (A-Z) and cut into words; each distinct word is cut into byte-level subword ids once per
worker. One pass gives the ids, which are stored and read by every later one, and the word counts.

*Learning.* From all training documents: counts of words (for the baseline), of subword ids and of pairs of id classes. The attention
model learns what pairs miss from every window of every training document: each task takes steps over one of ``ROUNDS`` windows in a row, starting from
the same weights; the weights are averaged, and the next of ``ROUNDS`` rounds starts from the average with the windows next to those. Work and what is gathered
grow with the input; what reaches the driver is bounded by the vocabulary (id counts, pair table) and the model.

*Scoring.* Overlapping windows of ``WINDOW`` subwords share ``CONTEXT`` of context and score each subword once, in batches under a causal mask.

*Baseline.* Counts of the ``COMMON`` most frequent words travel to the tasks; the other words of a document meet their counts in a join. So no
key of that join is hot, and what is broadcast is bounded.

Defined results: a null text is an empty one and has its end token only; a null id belongs to training; equal rows score equally; with no
training documents the counts are 0 and the model is uniform; an empty table gives an empty result; other columns are not looked
at. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from . import attention as A
from .scan import LOWER, NON_SPACE, chunks, mix, span_hashes, spans

COMMON = 262_144
ROUNDS, BATCH = 2, 128
CACHE_WORDS = 2_000_000
SCORE_BATCH = 512
_U = np.uint64
_LOG10 = np.log(10.0)


class Subwords:
    """Ids of words under a byte-level BPE rank file, each distinct word encoded once."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tok = tiktoken.Encoding("subwords", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.end = len(ranks)
        self.clear()

    def clear(self) -> None:
        self.keys, self.slot = np.zeros(0, _U), np.zeros(0, np.int64)
        self.first, self.flat = np.zeros(1, np.int64), np.zeros(0, np.uint16)

    def encode(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all words on end, ids per word, hashes of the distinct words, which of them each word is)."""
        if not len(start):
            return np.zeros(0, np.uint16), np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, np.int64)
        keys, where, inverse = np.unique(span_hashes(data, start, end), return_index=True, return_inverse=True)
        if len(self.keys) > CACHE_WORDS:
            self.clear()
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        new = np.flatnonzero(~known)
        if len(new):
            found = [self.tok.encode_ordinary(" " + data[start[k] : end[k]].tobytes().decode("utf-8")) for k in where[new]]
            base = len(self.first) - 1
            self.first = np.append(self.first, self.first[-1] + np.cumsum([len(f) for f in found]))
            self.flat = np.append(self.flat, np.array([i for f in found for i in f], np.uint16))
            self.slot = np.insert(self.slot, at[new], base + np.arange(len(new)))
            self.keys = np.insert(self.keys, at[new], keys[new])
        slot = self.slot[np.searchsorted(self.keys, keys)][inverse]
        size = self.first[slot + 1] - self.first[slot]
        stop = np.cumsum(size)
        return self.flat[np.arange(stop[-1]) + np.repeat(self.first[slot] - (stop - size), size)], size, keys, inverse


@lru_cache(maxsize=2)
def subwords(path: str, pattern: str) -> Subwords:
    return Subwords(path, pattern)


def held_out(id_col: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == fold, F.lit(False))


class WordCounts:
    """Training and total counts of words, gathered chunk by chunk and given as rows when there are many, or at a task's end."""

    def __init__(self):
        self.keys, self.train, self.every, self.size = [], [], [], 0

    def add(self, keys: np.ndarray, inverse: np.ndarray, learn: np.ndarray) -> bool:
        self.keys.append(keys)
        self.train.append(np.bincount(inverse, weights=learn, minlength=len(keys)).astype(np.int64))
        self.every.append(np.bincount(inverse, minlength=len(keys)))
        self.size += len(keys)
        return self.size > CACHE_WORDS

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, inverse = np.unique(np.concatenate([*self.keys, np.zeros(0, _U)]), return_inverse=True)
        total = lambda parts: np.bincount(inverse, weights=np.concatenate([*parts, np.zeros(0, np.int64)]), minlength=len(keys)).astype(np.int64)
        out = keys.view(np.int64), total(self.train), total(self.every)
        self.__init__()
        return out


TEXT_COLUMNS = ["k1", "k2", "doc_id", "held_out", "n_tokens", "packed"]
_ENCODED = "k1 long, k2 long, doc_id long, held_out boolean, n_tokens long, packed binary, h long, n_train long, n_all long"


def encode_texts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One pass over all texts that gives two kinds of rows, told apart by whether ``packed`` is null.

    Texts: k1, k2 (hashes of id and text), doc_id, held_out, n_tokens (words and the end), packed subword ids with the end last. Words: h
    (word hash), n_train, n_all; each task sends a word once.
    """
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("packed", pa.binary()),
                        ("h", pa.int64()), ("n_train", pa.int64()), ("n_all", pa.int64())])

    def rows(columns: list, at: int, n: int) -> pa.RecordBatch:
        mine = dict(zip(schema.names[at : at + len(columns)], columns, strict=True))
        return pa.RecordBatch.from_arrays([mine.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, squeeze, counts = subwords(path, pattern), zstandard.ZstdCompressor(level=1), WordCounts()

        def words() -> pa.RecordBatch:
            found = [pa.array(x) for x in counts.take()]
            return rows(found, 6, len(found[0]))

        for b in batches:
            for c in chunks(b.column(4)):
                data, n = LOWER[c.data], len(c.begin)
                w = spans(c, data, NON_SPACE)
                ids, size, keys, inverse = enc.encode(data, w.start, w.end)
                stop = np.cumsum(np.bincount(w.row, weights=size, minlength=n).astype(np.int64))
                packed = [squeeze.compress(np.append(ids[s:e], np.uint16(enc.end)).tobytes()) for s, e in zip(np.append(0, stop[:-1]), stop, strict=True)]
                own = b.slice(c.first, n)
                yield rows([*own.columns[:4], pa.array(np.bincount(w.row, minlength=n) + 1, pa.int64()), pa.array(packed, pa.binary())], 0, n)
                learn = ~own.column(3).to_numpy(zero_copy_only=False).astype(bool)
                if counts.add(keys, inverse, learn[w.row]):
                    yield words()
        yield words()

    return docs.select("k1", "k2", "doc_id", "held_out", "text").mapInArrow(run, _ENCODED)


def _ids(packed: pa.Array) -> list[np.ndarray]:
    out = zstandard.ZstdDecompressor()
    return [np.frombuffer(out.decompress(p), np.uint16) for p in packed.to_pylist()]


def word_counts(encoded: DataFrame) -> DataFrame:
    """h (word hash), n_train, n_all over the rows that ``encode_texts`` gives."""
    return encoded.where("packed IS NULL").groupBy("h").agg(F.sum("n_train").alias("n_train"), F.sum("n_all").alias("n_all"))


def known_sums(docs: DataFrame, common: np.ndarray, counts: np.ndarray) -> DataFrame:
    """k1, k2, known and logs (sum of log10(c + 1)) of the common words, and arrays of the other words' hashes and numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log = np.log10(counts + 1.0)
        for b in batches:
            for c in chunks(b.column(2)):
                data, rows = LOWER[c.data], len(c.begin)
                w = spans(c, data, NON_SPACE)
                h = span_hashes(data, w.start, w.end)
                at = np.minimum(np.searchsorted(common, h), max(0, len(common) - 1))
                hit = common[at] == h if len(common) else np.zeros(len(h), bool)
                per = lambda v, k: np.bincount(w.row[k], weights=v, minlength=rows)
                known, logs = per((counts[at[hit]] > 0), hit), per(log[at[hit]], hit)
                other = np.flatnonzero(~hit)
                _, where, n = np.unique(h[other] ^ mix(w.row[other].astype(_U) + _U(1)), return_index=True, return_counts=True)
                order = np.argsort(other[where])
                each = other[where][order]
                off = pa.array(np.append(0, np.cumsum(np.bincount(w.row[each], minlength=rows))).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*b.slice(c.first, rows).columns[:2], pa.array(known.astype(np.int64)), pa.array(logs),
                     pa.ListArray.from_arrays(off, pa.array(h[each].view(np.int64))), pa.ListArray.from_arrays(off, pa.array(n[order].astype(np.int64)))],
                    names=["k1", "k2", "known", "logs", "h", "k"])

    return docs.select("k1", "k2", "text").mapInArrow(run, "k1 long, k2 long, known long, logs double, h array<long>, k array<long>")


def _sequences(ids: list[np.ndarray], class_of: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = np.array([len(i) for i in ids], np.int64)
    y = class_of[np.concatenate(ids)] if ids else np.zeros(0, np.int64)
    x = np.append(0, y[:-1])[: len(y)]
    x[np.cumsum(n) - n] = class_of[end]
    return x, y, n


def _slices(ids: list[np.ndarray], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of texts with about ``limit`` subwords."""
    a = size = 0
    for b, i in enumerate(ids):
        size += len(i)
        if size >= limit:
            yield a, b + 1
            a, size = b + 1, 0
    if a < len(ids):
        yield a, len(ids)


def table_counts(encoded: DataFrame, class_of: np.ndarray | None, end: int) -> np.ndarray:
    """Counts of ids, or of class pairs; each task sends one row per cell it has seen, the driver gets one per cell."""
    size = A.CLASSES**2 if class_of is not None else 1 << 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size, np.int64)
        for b in batches:
            ids = _ids(b.column(0))
            for lo, hi in _slices(ids):
                if class_of is None:
                    seen += np.bincount(np.concatenate(ids[lo:hi]), minlength=size)
                else:
                    x, y, _ = _sequences(ids[lo:hi], class_of, end)
                    seen += np.bincount(x * A.CLASSES + y, minlength=size)
        cell = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(seen[cell])], names=["cell", "n"])

    rows = encoded.select("packed").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    return out


def picked(n: np.ndarray, row: np.ndarray, turn: int) -> np.ndarray:
    """Windows of a round, for texts of n tokens: the rounds share all of them out, each window to one."""
    count = -(-n // A.STEP)
    return np.flatnonzero((np.arange(count.sum()) + np.repeat(row, count)) % ROUNDS == turn)


def train(encoded: DataFrame, class_of: np.ndarray, end: int, pairs: A.PairTable) -> np.ndarray:
    """Averaged weights after all rounds."""
    flat = A.initial()
    for turn in range(ROUNDS):
        def run(batches: Iterator[pa.RecordBatch], start=flat, turn=turn) -> Iterator[pa.RecordBatch]:
            mine, opt, used = start.copy(), A.Adam(), 0
            model = A.Model(mine, pairs)
            for b in batches:
                ids, row = _ids(b.column(1)), b.column(0).to_numpy() % ROUNDS
                for lo, hi in _slices(ids):
                    x, y, n = _sequences(ids[lo:hi], class_of, end)
                    at = A.windows(n)
                    pick = picked(n, row[lo:hi], turn)
                    pick = pick[np.argsort(mix(pick.astype(_U)))]
                    for i in range(0, len(pick), BATCH):
                        some = pick[i : i + BATCH]
                        _, grad = model.run(x, y, tuple(z[some] for z in at), learn=True)
                        opt.step(mine, grad)
                        used += len(some)
            if used:
                lots = np.array_split(mine, 8)
                yield pa.RecordBatch.from_arrays([pa.array(range(8), pa.int32()), pa.array([float(used)] * 8), pa.array([v.tobytes() for v in lots], pa.binary())],
                                                 names=["lot", "weight", "v"])

        def mean(table: pa.Table) -> pa.Table:
            weight = table["weight"].to_numpy()
            total = sum(w * np.frombuffer(v, np.float32).astype(np.float64) for w, v in zip(weight, table["v"].to_pylist(), strict=True))
            return pa.table({"lot": table["lot"][:1], "weight": [weight.sum()], "v": pa.array([(total / weight.sum()).astype(np.float32).tobytes()], pa.binary())})

        schema = "lot int, weight double, v binary"
        found = encoded.select("k1", "packed").mapInArrow(run, schema).withColumn("some", F.spark_partition_id() % 64)
        some = found.groupBy("lot", "some").applyInArrow(lambda t: mean(t), schema)
        rows = some.groupBy("lot").applyInArrow(mean, schema).orderBy("lot").collect()
        if rows:
            flat = np.concatenate([np.frombuffer(r.v, np.float32) for r in rows])
    return flat


def score_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_subwords."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.select(F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(1), "doc_id", "text").alias("k2"), "doc_id",
                       held_out(F.col("doc_id")).alias("held_out"), "text")
    both_kinds = materialise(encode_texts(docs, path, pattern), "subwords")
    encoded = both_kinds.where("packed IS NOT NULL").select(*TEXT_COLUMNS)
    train_rows = encoded.where("not held_out")
    n_docs, n_all = train_rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()

    # The model.
    end = subwords(path, pattern).end
    n_ids = end + 1
    ids = table_counts(train_rows, None, end)[:n_ids]
    order = np.argsort(-(ids + (np.arange(n_ids) == end) * (int(ids.sum()) + 1)), kind="stable")
    class_of = np.full(n_ids, A.OTHER)
    class_of[order[: A.OTHER]] = np.arange(A.OTHER)
    rare = np.where(class_of == A.OTHER, ids + 1.0, 0.0)
    inside = np.where(rare > 0, np.log10(np.maximum(rare, 1.0) / rare.sum()), 0.0)
    pairs = A.PairTable(table_counts(train_rows, class_of, end).reshape(A.CLASSES, A.CLASSES))
    flat = train(train_rows, class_of, end, pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = A.Model(flat, pairs)
        for b in batches:
            every, score, size = _ids(b.column("packed")), [], []
            for lo, hi in _slices(every):
                x, y, n = _sequences(every[lo:hi], class_of, end)
                at = A.windows(n)
                got = [model.run(x, y, tuple(z[i : i + SCORE_BATCH] for z in at)).sum(1, dtype=np.float64) for i in range(0, len(at[0]), SCORE_BATCH)]
                text = np.repeat(np.arange(len(n)), -(-n // A.STEP))
                own = np.bincount(text, weights=np.concatenate(got), minlength=len(n)) / _LOG10
                score.append(own + np.add.reduceat(inside[np.concatenate(every[lo:hi])], np.cumsum(n) - n))
                size.append(n)
            if score:
                yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(np.concatenate(score)), pa.array(np.concatenate(size))],
                                                 names=["k1", "k2", "doc_id", "held_out", "n_tokens", "score", "n_subwords"])

    scored = encoded.mapInArrow(run, "k1 long, k2 long, doc_id long, held_out boolean, n_tokens long, score double, n_subwords long")

    # The baseline.
    counts = materialise(word_counts(both_kinds), "words")
    n_words = counts.where("n_train > 0").count() + (n_docs > 0)
    # The common words: from the count on that keeps them within the bound; the counts' histogram has a few hundred rows.
    level = F.floor(F.log2("n_all") * 16).cast("long")
    room, least = COMMON, None
    for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("level")).collect():
        room -= r.n
        if room < 0:
            break
        least = r.level
    top = (counts.where(level >= least) if least is not None else counts.limit(0)).toArrow()
    keys = top["h"].to_numpy().view(_U)
    by_key = np.argsort(keys)
    sums = materialise(known_sums(docs, keys[by_key], top["n_train"].to_numpy()[by_key]), "known")
    other = sums.select("k1", "k2", F.explode(F.arrays_zip("h", "k")).alias("w")).select("k1", "k2", "w.h", "w.k")
    other = other.join(counts.select("h", "n_train").where("n_train > 0"), "h", "left").withColumn("n_train", F.coalesce("n_train", F.lit(0)))
    other = other.groupBy("k1", "k2").agg(F.sum(F.when(F.col("n_train") > 0, F.col("k")).otherwise(0)).alias("known_too"),
                                          F.sum(F.col("k") * F.log10(F.col("n_train") + 1.0)).alias("logs_too"))
    # Equal rows share a key and were summed together.
    sums = sums.groupBy("k1", "k2").agg(F.max("known").alias("known"), F.max("logs").alias("logs"), F.count(F.lit(1)).alias("rows")).join(other, ["k1", "k2"], "left")
    sums = sums.select("k1", "k2", (F.col("known") + F.coalesce((F.col("known_too") / F.col("rows")).cast("long"), F.lit(0))).alias("known"),
                       (F.col("logs") + F.coalesce(F.col("logs_too") / F.col("rows"), F.lit(0.0))).alias("logs"))
    both = scored.join(sums, ["k1", "k2"])
    end_log = float(np.log10(n_docs + 1.0))
    per_token = float(np.log10(n_all + n_words + 1.0))
    return both.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.lit(int(n_docs > 0))).alias("n_known"),
        F.lit(int(n_all)).cast("long").alias("train_tokens"),
        (F.col("logs") + end_log - F.col("n_tokens") * per_token).alias("base_score"), "score", "n_subwords")
