"""Operator 11, importance resampling towards a target: draw the documents whose words look like those of a target corpus.

A 256-byte table lower-cases A-Z and blanks every separator in the UTF-8 bytes, so ``bytes.split`` yields the words. The CRC-32 of a
run of words is carried on from the run that is one word shorter, and Counters reduce the runs of a text to bucket counts. Both corpora
are counted over all their texts; a bucket's gain is the log of the target's smoothed share over the corpus's. A document's weight is the
sum of its gains; adding Gumbel noise keyed on its id makes the highest scores a sample without replacement by weight (reruns agree).

*Scale.* Counting leaves at most ``buckets`` rows a task, summed by Spark; gains are ``buckets`` integers on the driver (a parameter).
Texts are read twice, so nothing the size of the corpus is shuffled: the ranking moves the eligible documents' ids and scores in
range-partitioned order, and the documents too short to be drawn never move. A text is counted whole; memory follows the longest.

Defined results: a null or empty text has no words, weight 0 and is never drawn unless ``min_words`` is 0; a null id draws its noise
as the empty string and ranks after equal scores; repeated rows are scored alike and each takes a rank of its own; an empty corpus gives
an empty result, an empty target gains from smoothing alone; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .mixing import running

BUCKETS, SEED = 10_000, 2024
_BLANKED = b"".join(bytes(range(a, b + 1)) for a, b in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)))
_UPPER = bytes(range(0x41, 0x5B))
#: A-Z to a-z, separators to blanks, every other byte (digits, a-z, parts of longer characters) as it is.
TRANSLATION = bytes.maketrans(_BLANKED + _UPPER, b" " * len(_BLANKED) + _UPPER.lower())


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TRANSLATION).split()


def bucket_counts(ws: list[bytes], most: int, buckets: int) -> Counter[int]:
    """How often each bucket is met by the runs of 1 to ``most`` words; runs are joined by one blank."""
    out: Counter[int] = Counter()
    for w, n in Counter(ws).items():
        out[crc32(w) % buckets] += n
    if most > 1 and len(ws) > 1:
        seeds, tails = [crc32(w) for w in ws], [b" " + w for w in ws]
        for k in range(1, min(most, len(ws))):
            seeds = [crc32(t, s) for s, t in zip(seeds, tails[k:])]  # the last run of the shorter length has no next word
            out.update(Counter(s % buckets for s in seeds))
    return out


def corpus_counts(docs: DataFrame, most: int = 1, buckets: int = BUCKETS, text_col: str = "text") -> DataFrame:
    """bucket, n: the features of all texts of a corpus."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[int] = Counter()
        for b in batches:
            for t in b.column(0):
                total.update(bucket_counts(words(t.as_py()), most, buckets))
        keys = sorted(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([total[k] for k in keys], pa.int64())], names=["bucket", "n"])

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Per bucket floor(1000 ln(target share / corpus share)), both smoothed by one; inputs as ``corpus_counts`` gives them."""
    s, t = ({r.bucket: r.n for r in c.collect()} for c in (corpus, target))  # at most ``buckets`` rows each
    all_s, all_t = sum(s.values()), sum(t.values())
    share = lambda k: float(t.get(k, 0) + 1) * float(all_s + buckets) / (float(s.get(k, 0) + 1) * float(all_t + buckets))
    return np.array([math.floor(1000 * math.log(share(k))) for k in range(buckets)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, most: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight: the summed gains of all runs of each whole text."""
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = gain.tolist()
        for b in batches:
            n, features, weight = [], [], []
            for t in b.column(1):
                ws = words(t.as_py())
                counts = bucket_counts(ws, most, buckets)
                n.append(len(ws))
                features.append(counts.total())
                weight.append(sum(of[k] * c for k, c in counts.items()))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (n, features, weight))],
                                             names=["doc_id", "n_words", "n_features", "weight"])

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(id_: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, floored, from the first 32 bits of SHA-256 over ``seed:id``."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def draw(weighed: DataFrame, percent: int = 10, min_words: int = 20, seed: int = SEED) -> DataFrame:
    """``weighed`` with score and rank: 1, 2, 3... for the highest scores, ties to the smaller id; null for rows not drawn."""
    scored = materialise(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scores")
    fit = F.col("n_words") >= min_words
    size = percent * scored.where(fit).count() // 100
    place = running(scored.where(fit), [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], {})
    ranked = place.withColumn("rank", F.when(F.col("place") < size, F.col("place") + 1).cast("long")).drop("place")
    return ranked.unionByName(scored.where(~fit).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, most: int = 1, buckets: int = BUCKETS, percent: int = 10, min_words: int = 20,
             seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every document of ``docs`` for the words of ``target``."""
    gain = gains(corpus_counts(docs, most, buckets), corpus_counts(target, most, buckets), buckets)
    return draw(weigh(docs, gain, most), percent, min_words, seed)


def drawn_documents(docs: DataFrame, ranks: DataFrame) -> DataFrame:
    """The documents whose id was drawn, with all their columns; rows that repeat a drawn id come with it."""
    ids = ranks.where("rank IS NOT NULL").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(ids, F.col("doc_id").cast("long").eqNullSafe(F.col("_drawn")), "left_semi")
