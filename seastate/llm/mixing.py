"""Operator 4, mixing sources to target weights by pivotal dependent rounding.

Each source gets a target in words; the ratio of target to size is the expected number of copies of each of its documents. The whole
part is certain; the fraction is rounded. Rounding goes through the documents of a source in random (hashed) order and pairs
the document still open with the next one: words move from one to the other, in a random direction with balanced chances, until
one of the two is whole. The sum of words stays as it was, so a source ends within one document of its target, and each document
keeps its expected number of copies.

*Scale.* Only (key, source, size) rows are moved. A source is cut into blocks of about ``BLOCK`` documents by hash, so a source with a
third of all rows is spread like any other; the pairing streams through sorted rows with one open document in memory. Every block
leaves at most one open document; those of ``FAN`` blocks meet on the next level, until one is left per source. Source totals
are one row per source; their order and the water level of the targets come from range-partitioned running sums.

Defined results: a null text has size 0, and a document without words is never taken; a null source is a source of its own, ranked
last; equal rows are rounded each on their own; an empty table gives an empty result; all draws hang on the rows' content and
the seed, so reruns agree whatever the partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MAX_COPIES = 1.5, 2.0
BLOCK, FAN = 4096, 64
_MASK = (1 << 64) - 1
_EDGE = 1e-9


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def row_keys(docs: DataFrame) -> list[Column]:
    """Two 64-bit hashes of a row's content (maps, which have no hash, left out)."""
    cols = [F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t and t not in ("variant", "void")]
    return [F.xxhash64(*cols).alias("h1"), F.xxhash64(F.lit(1), *cols).alias("h2")]


def running(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """``df`` with ``place`` (rows before) and, per name, the sum of a column over the rows before, in a total order.

    Rows are range-partitioned and stored; each partition sums its own, and the sums of the partitions before are added.
    """
    own = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    parts = materialise(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "running")
    totals = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("place_"), *(F.sum(c).alias(f"{k}_") for k, c in sums.items()))
    names = ["place", *sums]
    before = {k: 0 for k in names}
    rows = []
    for r in totals.orderBy("_part").collect():  # one row per partition
        rows.append((r["_part"], *before.values()))
        before = {k: before[k] + (r[f"{k}_"] or 0) for k in names}
    first = lambda k, i: F.coalesce(F.create_map(*(x for r in rows for x in (F.lit(r[0]), F.lit(r[i]))))[F.col("_part")], F.lit(0)) if rows else F.lit(0)
    inside = {"place": F.count(F.lit(1)).over(own), **{k: F.coalesce(F.sum(c).over(own), F.lit(0)) for k, c in sums.items()}}
    return parts.withColumns({k: first(k, i + 1) + inside[k] for i, k in enumerate(names)}).drop("_part")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MAX_COPIES) -> DataFrame:
    """source, source_size, n_docs, target: weights repeat over the sources in code point order, null last."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    ranked = running(totals, [F.col("source").asc_nulls_last()], {})
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", most * F.col("source_size")).withColumn("level", F.col("cap") / F.col("weight"))
    ranked = materialise(ranked.drop("place"), "sources")
    whole, all_weight = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    total = share * (whole or 0)
    # Sources fill up in order of cap per weight; the level is where the rest, shared by weight, fits under all caps left.
    filled = running(ranked, [F.col("level"), F.col("source").asc_nulls_last()], {"cap_before": "cap", "weight_before": "weight"})
    fair = (F.lit(total) - F.col("cap_before")) / (F.lit(all_weight or 0.0) - F.col("weight_before"))
    level = filled.withColumn("fair", fair).where("fair <= level").agg(F.min_by("fair", "place")).first()[0]
    return ranked.select("source", "source_size", "n_docs", F.least("cap", F.lit(level if level is not None else math.inf) * F.col("weight")).alias("target"))


def _draw(a: int, b: int, seed: int) -> float:
    h = (a * 0x9E3779B97F4A7C15 + b * 0xD1342543DE82EF95 + seed * 0xA24BAED4963EE407) & _MASK
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & _MASK
    h = (h ^ h >> 27) * 0x94D049BB133111EB & _MASK
    return ((h ^ h >> 31) >> 11) / (1 << 53)


def transfer(p: float, v: float, q: float, w: float, u: float) -> tuple[float, float]:
    """Move words between two documents of sizes v, w taken with chances p, q until one is whole; u is uniform on [0, 1)."""
    up, down = min((1 - p) * v, q * w), min(p * v, (1 - q) * w)
    d = up if u * (up + down) < down else -down
    p, q = p + d / v, q - d / w
    whole = lambda x: 0.0 if x < _EDGE else 1.0 if x > 1 - _EDGE else x
    return whole(p), whole(q)


def _pairing(seed: int, last: bool):
    """Stream sorted rows; per (source, block) at most one row leaves with a fraction, none on the last level."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group = None, None  # the open row: (one-row batch, hash, size, chance)

        def settled(row: pa.RecordBatch, p: float) -> pa.RecordBatch:
            return row.set_column(row.schema.get_field_index("p"), "p", pa.array([p], pa.float64()))

        def close() -> pa.RecordBatch:
            one, h, _, p = held
            return settled(one, p if not last else 1.0 if _draw(h, h, seed) < p else 0.0)

        for b in batches:
            key = list(zip(b.column("source").to_pylist(), b.column("block").to_pylist(), strict=True))
            h, size, p = b.column("h1").to_pylist(), b.column("size").to_pylist(), b.column("p").to_pylist()
            keep, old = [True] * b.num_rows, None  # old: where the open row lies in this batch
            for i in range(b.num_rows):
                if key[i] != group and held is not None:
                    yield close()
                    held, old = None, None
                group = key[i]
                if _EDGE < p[i] < 1 - _EDGE:
                    keep[i] = False
                    if held is None:
                        held, old = (b.slice(i, 1), h[i], size[i], p[i]), i
                        continue
                    one, g, v, r = held
                    mine, other = transfer(r, v, p[i], size[i], _draw(g, h[i], seed))
                    if 0.0 < mine < 1.0:
                        held, keep[i], p[i] = (one, g, v, mine), True, other
                        continue
                    if old is None:
                        yield settled(one, mine)
                    else:
                        keep[old], p[old] = True, mine
                    held, old = ((b.slice(i, 1), h[i], size[i], other), i) if 0.0 < other < 1.0 else (None, None)
                    if held is None:
                        keep[i], p[i] = True, other
                else:
                    p[i] = float(round(p[i]))
            yield b.set_column(b.schema.get_field_index("p"), "p", pa.array(p, pa.float64())).filter(pa.array(keep, pa.bool_()))
        if held is not None:
            yield close()

    return run


def copies(docs: DataFrame, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, h1, h2 (the row's content hashes), size, source, source_size, target, copies."""
    sized = materialise(docs.select(F.col(id_col).cast("long").alias("doc_id"), *row_keys(docs), n_words(F.col(text_col)).alias("size"),
                                    F.col(source_col).cast("string").alias("source")), "sizes")
    targets = materialise(source_targets(sized), "targets").withColumnRenamed("source", "s")
    rows = sized.join(targets, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rate = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    blocks = F.ceil(F.col("n_docs") / BLOCK).cast("long")
    rows = rows.withColumn("whole", F.floor(rate + _EDGE).cast("long")).withColumn("p", F.greatest(rate - F.col("whole"), F.lit(0.0)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("h1", F.lit(seed)), blocks)).drop("n_docs")
    most = targets.agg(F.max("n_docs")).first()[0] or 0
    n, done, open_rows = max(1, math.ceil(most / BLOCK)), [], rows
    while True:
        last = n <= 1
        spread = open_rows.repartition("source", "block").sortWithinPartitions("source", "block", "h1", "h2")
        level = materialise(spread.mapInArrow(_pairing(seed, last), open_rows.schema), "pairing")
        whole = F.col("p").isin(0.0, 1.0)
        done.append(level.where(whole))
        if last:
            break
        open_rows = level.where(~whole).withColumn("block", F.floor(F.col("block") / FAN).cast("long"))
        n = math.ceil(n / FAN)
    out = done[0]
    for level in done[1:]:
        out = out.unionByName(level)
    return out.select("doc_id", "h1", "h2", "size", "source", "source_size", "target", (F.col("whole") + F.col("p")).cast("long").alias("copies"))


def mix(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with all their columns."""
    h1, h2 = row_keys(docs)
    taken = copies(docs, seed).groupBy(F.col("h1").alias("k1"), F.col("h2").alias("k2")).agg(F.sum("copies").alias("copies")).where("copies > 0")
    struct = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), h1.alias("k1"), h2.alias("k2"))
    each = struct.dropDuplicates(["k1", "k2"]).join(taken, ["k1", "k2"])
    return each.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")
