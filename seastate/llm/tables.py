"""Reading the corpus tables; every read goes through Spark, so any store will do."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def runs(batches: Iterator[pa.RecordBatch], *keys: str, least: int = 1) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys, as one table each, across batch borders; the rows come sorted by the keys.

    Runs of fewer than ``least`` rows are passed over without being built.
    """
    held: list[pa.RecordBatch] = []  # the run that is still open
    last = None
    whole = lambda: [pa.Table.from_batches(held)] if sum(b.num_rows for b in held) >= max(1, least) else []
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(n, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        head = tuple(c[0] for c in cols)
        if last is not None and head != last:
            yield from whole()
            held = []
        cut = np.concatenate([[0], np.flatnonzero(new), [n]])
        held.append(b.slice(0, int(cut[1])))
        if len(cut) > 2:
            yield from whole()
            size = np.diff(cut[1:-1])
            for i in np.flatnonzero(size >= least):
                yield pa.Table.from_batches([b.slice(int(cut[i + 1]), int(size[i]))])
            held = [b.slice(int(cut[-2]), int(n - cut[-2]))]
        last = tuple(c[-1] for c in cols)
    yield from whole()


def whole_runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Tables of consecutive rows in which no run of equal keys is cut, about a batch each; the rows come sorted by the keys."""
    held: list[pa.RecordBatch] = []  # the run that is still open
    last = None
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(n, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        new[0] = last is not None and tuple(c[0] for c in cols) != last
        cut = np.flatnonzero(new)
        if len(cut):
            done = [*held, b.slice(0, int(cut[-1]))]
            held = [b.slice(int(cut[-1]))]
            yield pa.Table.from_batches(done)
        else:
            held.append(b)
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)
