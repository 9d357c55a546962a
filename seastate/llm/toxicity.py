"""Operator 12, toxicity: a factorization machine over hashed terms.

A term is a lower-cased word, hashed to 64 bits; a text is the set of its terms. The machine's logit is a bias, one weight per term, and for
every pair of terms the dot product of their factor vectors, so that an insult beside a group mention can weigh more, or less, than the two
alone. It is trained by AdaGrad on the log loss, in numpy. Terms enter the model if enough labelled texts hold them and their share among toxic
texts differs from the rest by ``min_z`` standard errors, the strongest ``max_terms`` first; a rare word never meets a weight.

*Labels* come only from rows on the training side of the split; language, source and id are never inputs. Training takes at most
``max_rows`` labelled documents, the ones with the smallest hash of their id (a bounded sample); all of them, whole, if there are no more.

*Scale.* The sample's ids are a bounded broadcast; one scan of the documents turns the sampled texts into term sets, terms are counted by
partial aggregation, and only sets cut down to the model's terms (at most ``max_terms`` each) meet in the one training task. Scoring is one
scan without a shuffle. Retried tasks give the same model: all random draws have fixed seeds and rows are sorted first.

Defined results: a null or empty text gets the score of a text without known terms; a document with a null id is never held out and never
trained on; a document labelled twice counts with its mean label, null labels not at all; rows with equal term sets train as one, by their mean label;
repeated rows are scored alike; without any label the score is 0.5; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .scan import LOWER, Chunk, chunks, span_hashes, spans, table

WORD = table((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
FOLDS, HELD_OUT = 3, 1


@dataclass(frozen=True)
class ToxicityConfig:
    max_rows: int = 40_000
    max_terms: int = 16_384
    min_texts: int = 5
    min_z: float = 4.0
    factors: int = 8
    epochs: int = 20
    batch: int = 256
    rate: float = 0.1
    decay: float = 1e-4
    seed: int = 12
    threshold: float = 0.7


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def term_rows(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every distinct term of every text in a chunk, sorted by row."""
    data = LOWER[chunk.data]
    w = spans(chunk, data, WORD)
    h = span_hashes(data, w.start, w.end).view(np.int64)
    order = np.lexsort((h, w.row))
    row, h = w.row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]


@dataclass
class Machine:
    """terms: sorted hashes; weight and factor per term; bias."""

    terms: np.ndarray
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def logits(self, row: np.ndarray, term: np.ndarray, rows: int) -> np.ndarray:
        """``term`` are indexes into the model's terms, ``row`` the text each lies in."""
        out = self.bias + np.bincount(row, weights=self.weight[term], minlength=rows)
        for f in self.factor.T:
            v = f[term]
            out += 0.5 * (np.bincount(row, weights=v, minlength=rows) ** 2 - np.bincount(row, weights=v * v, minlength=rows))
        return out


def lookup(terms: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of the hashes are among the sorted terms, their indexes there)."""
    if not len(terms):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
    hit = np.flatnonzero(terms[at] == h)
    return hit, at[hit]


def probability(logit: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(logit, -40, 40)))


def train(terms: np.ndarray, sets: list[np.ndarray], target: np.ndarray, cfg: ToxicityConfig) -> Machine:
    """Fit on sets of term indexes and targets in [0, 1]; every row weighs the same."""
    rng = np.random.default_rng(cfg.seed)
    base = (target.sum() + 0.5) / (len(target) + 1.0)
    m = Machine(terms, float(np.log(base / (1 - base))), np.zeros(len(terms)), rng.normal(0, 0.02, (len(terms), cfg.factors)))
    if not len(terms) or not len(sets):
        return m
    seen = {"b": 1.0, "w": np.full(len(terms), 1.0), "v": np.full(m.factor.shape, 1.0)}  # AdaGrad's running squares
    size = np.array([len(s) for s in sets])
    begin, flat = np.concatenate([[0], np.cumsum(size)]), np.concatenate(sets)
    for _ in range(cfg.epochs):
        order = rng.permutation(len(sets))
        for a in range(0, len(order), cfg.batch):
            pick = order[a : a + cfg.batch]
            row = np.repeat(np.arange(len(pick)), size[pick])
            term = flat[np.repeat(begin[pick], size[pick]) + np.arange(len(row)) - np.repeat(np.cumsum(size[pick]) - size[pick], size[pick])]
            err = probability(m.logits(row, term, len(pick))) - target[pick]
            used, at = np.unique(term, return_inverse=True)
            e = err[row]
            total = np.stack([np.bincount(row, weights=f[term], minlength=len(pick)) for f in m.factor.T], axis=1)
            g = np.bincount(at, weights=e, minlength=len(used)) + cfg.decay * len(pick) * m.weight[used]
            seen["w"][used] += g * g
            gv = np.stack([np.bincount(at, weights=e * (total[row, f] - m.factor[term, f]), minlength=len(used)) for f in range(cfg.factors)], axis=1)
            gv = gv + cfg.decay * len(pick) * m.factor[used]
            seen["v"][used] += gv * gv
            m.weight[used] -= cfg.rate * 4 * g / np.sqrt(seen["w"][used])
            m.factor[used] -= cfg.rate * gv / np.sqrt(seen["v"][used])
            gb = float(err.sum())
            seen["b"] += gb * gb
            m.bias -= cfg.rate * gb / np.sqrt(seen["b"])
    return m


def sample_labels(labels: DataFrame, cfg: ToxicityConfig, id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """id, target: at most ``max_rows`` labelled ids of the training side, by the smallest hash of the id."""
    mine = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("y"))
    mine = mine.where(F.col("id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("id")))
    return mine.groupBy("id").agg(F.avg("y").alias("target")).orderBy(F.xxhash64("id", F.lit(cfg.seed)), "id").limit(cfg.max_rows)


def learn(docs: DataFrame, labels: DataFrame, cfg: ToxicityConfig | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Machine:
    cfg = cfg or ToxicityConfig()
    sample = materialise(sample_labels(labels, cfg, id_col, label_col), "toxic-sample")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b.column(0)):
                rows = len(c.begin)
                row, h = term_rows(c)
                off = np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(1).slice(c.first, rows), pa.ListArray.from_arrays(pa.array(off), pa.array(h))], names=["target", "terms"])

    # At most max_rows ids of 16 bytes: a bounded broadcast, whatever the number of documents.
    picked = texts.join(F.broadcast(sample), "id").select("text", "target")
    sets = picked.mapInArrow(hashed, "target double, terms array<long>").groupBy("terms").agg(F.avg("target").alias("target"))
    sets = materialise(sets, "toxic-terms")
    n, positive = sets.agg(F.count(F.lit(1)), F.sum("target")).first()
    if not n:
        return Machine(np.zeros(0, np.int64), 0.0, np.zeros(0), np.zeros((0, cfg.factors)))
    share = positive / n
    counts = sets.select(F.explode("terms").alias("term"), "target").groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("target").alias("toxic"))
    away = F.abs(F.col("toxic") - F.col("n") * share) / F.sqrt(F.col("n") * F.lit(max(share * (1 - share), 1e-9)))
    chosen = counts.where(F.col("n") >= cfg.min_texts).withColumn("z", away).where(F.col("z") >= cfg.min_z)
    terms = np.sort(np.array([r.term for r in chosen.orderBy(F.col("z").desc(), "term").limit(cfg.max_terms).collect()], np.int64))

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[bytes, list[float]] = {}  # a set of known terms: toxic rows, all rows
        for b in batches:
            for h, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                key = np.asarray(h.values, np.int64) if h.is_valid else np.zeros(0, np.int64)
                got.setdefault(lookup(terms, key)[1].astype(np.int32).tobytes(), []).append(y)
        keys = sorted(got)
        rows = [(np.frombuffer(k, np.int32), y) for k in keys for y in sorted(got[k])]
        m = train(terms, [r[0] for r in rows], np.array([r[1] for r in rows], float), cfg)
        yield pa.RecordBatch.from_arrays([pa.array([m.bias]), pa.array([m.weight.tobytes()]), pa.array([m.factor.tobytes()])], names=["bias", "weight", "factor"])

    # One task trains on the bounded sample, each set cut down to the model's terms on the way.
    model = sets.select("terms", "target").coalesce(1).mapInArrow(fitted, "bias double, weight binary, factor binary").first()
    return Machine(terms, model.bias, np.frombuffer(model.weight), np.frombuffer(model.factor).reshape(len(terms), cfg.factors))


def score_texts(docs: DataFrame, machine: Machine, cfg: ToxicityConfig | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    cfg = cfg or ToxicityConfig()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b.column(2)):
                rows = len(c.begin)
                data = LOWER[c.data]
                w = spans(c, data, WORD)
                hit, term = lookup(machine.terms, span_hashes(data, w.start, w.end).view(np.int64))
                one = np.unique(w.row[hit] * max(len(machine.terms), 1) + term)  # a term counts once a text
                row, term = np.divmod(one, max(len(machine.terms), 1))
                p = probability(machine.logits(row, term, rows))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(c.first, rows), b.column(1).slice(c.first, rows), pa.array(p), pa.array((p >= cfg.threshold).astype(np.int32))],
                                                 names=["doc_id", "held_out", "score", "predicted"])

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def judge(docs: DataFrame, labels: DataFrame, cfg: ToxicityConfig | None = None) -> DataFrame:
    """Learn from the labelled documents of the training side and score all documents."""
    cfg = cfg or ToxicityConfig()
    return score_texts(docs, learn(docs, labels, cfg), cfg)
