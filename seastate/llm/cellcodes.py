"""Operator 13, vector code compression: product codes from codebooks that rounds of exact integer means refine.

A vector is cut into equal parts; each part is replaced by the index of the nearest entry of its position's codebook. The search is
exact but looks at few entries: the space of a part is a grid of boxes, a part's coarse box is hashed, and a box's entry list is kept
once found. An entry is on the list unless another entry is nearer to every point of the box: its least distance to the box exceeds
the smallest of all largest distances. Only entries on the list are evaluated, in integers. The two bounds of a new box are sums of
table rows, one row per pair of coordinates, so a box met for the first time costs no distance evaluation either.

*Scale.* Each round is one scan: tasks sum their parts per codebook entry (at most parts * entries rows a task), Spark adds the sums, and
the driver holds the codebooks, parts * entries small integer rows. No vector is shuffled in the rounds. At the end only ids, labels,
codes and errors are stored; errors are summed per label with partial aggregation, and the sums are broadcast only where their
number is below ``BROADCAST_ROWS``; beyond it the join is one adaptive execution can split. Boxes kept per task: ``BOXES`` a part.

Defined results: vectors that are null, empty, or hold a null or non-finite component are dropped, and so are those whose length differs
from that of the kept vector with the smallest id (ties: the shorter one); a length that the number of parts does not divide is filled up with zeros; integer components
are held within +-2**26 (|x| < 65,536 is exact). Null ids come last among the first entries; rows of one id stand in order of their
components. With fewer vectors than entries the codebooks are shorter. Repeated rows are each coded; an empty table gives an empty result; null labels are one label.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
MOST = 1 << 26
BOXES = 1 << 16
BROADCAST_ROWS = 100_000
_STEPS, _ROWS = 40, 1024
_U = np.uint64


def components(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are kept, their components as integers); ``width`` None takes the first kept row's length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    off = np.asarray(column.offsets).astype(np.int64) if n else np.zeros(1, np.int64)
    raw = column.values
    bad = ~np.isfinite(raw.to_numpy(zero_copy_only=False).astype(float)) if len(raw) else np.zeros(0, bool)  # a null reads as NaN
    faults = np.concatenate([[0], np.cumsum(bad)])
    size = np.diff(off)
    ok = column.is_valid().to_numpy(zero_copy_only=False) & (size > 0) & (faults[off[1:]] == faults[off[:-1]])
    if width is None:
        width = int(size[ok][0]) if ok.any() else 0
    rows = np.flatnonzero(ok & (size == width))
    values = raw.to_numpy(zero_copy_only=False).astype(float) if len(rows) else np.zeros(0)
    x = np.floor(SCALE * values[off[rows][:, None] + np.arange(width)]) if len(rows) else np.zeros((0, width))
    return rows, np.clip(x, -MOST, MOST).astype(np.int64)


def cut(x: np.ndarray, parts: int) -> np.ndarray:
    """(parts, rows, part width); the last part is filled up with zeros where the length is no multiple."""
    n, width = x.shape
    each = -(-width // parts)
    full = np.zeros((n, each * parts), np.int64)
    full[:, :width] = x
    return np.ascontiguousarray(full.reshape(n, parts, each).transpose(1, 0, 2))


class Boxes:
    """Nearest entries of one codebook through the entry lists of coarse boxes, found once and kept."""

    def __init__(self, book: np.ndarray, keep: int = BOXES):
        self.book, self.keep = book, keep
        k, d = book.shape
        spread = float(np.sqrt(book.var(axis=0).mean())) if k else 0.0
        low, high = (book.min(axis=0), book.max(axis=0)) if k else (np.zeros(d, np.int64), np.zeros(d, np.int64))
        self.shift = max(0, int(np.ceil(np.log2(max(spread / 6, 1.0)))), int(np.ceil(np.log2(max(float((high - low).max(initial=0)) / _STEPS, 1.0)))))
        self.base = low >> self.shift
        # Steps 1 to n - 2 are boxes inside the entries' range; the first and the last one are open to the outside.
        self.n = int(((high >> self.shift) - self.base).max(initial=0)) + 3
        near, far = np.zeros((d, self.n, k), np.float32), np.zeros((d, self.n, k), np.float32)
        step = np.arange(self.n) - 1
        for j in range(d):
            lo = ((self.base[j] + step) << self.shift).astype(float)
            hi = lo + (1 << self.shift) - 1
            lo[0], hi[-1] = -np.inf, np.inf
            c = book[:, j].astype(float)[None]
            near[j] = np.maximum(np.maximum(lo[:, None] - c, c - hi[:, None]), 0) ** 2
            far[j] = np.maximum(np.abs(c - lo[:, None]), np.abs(c - hi[:, None])) ** 2
        pairs = [(j, j + 1) for j in range(0, d - 1, 2)]
        self.tables = [((a, b), *((t[a][:, None] + t[b][None]).reshape(self.n**2, k) for t in (near, far))) for a, b in pairs]
        if d % 2:
            self.tables.append(((d - 1,), near[d - 1], far[d - 1]))
        rng = np.random.default_rng(13)
        self.odd = rng.integers(0, 1 << 63, max(d, 1), dtype=np.uint64) * _U(2) + _U(1)
        self.keys, self.cells, self.lists = np.zeros(0, _U), np.zeros((0, d), np.int8), np.zeros((0, k), bool)

    def cell(self, points: np.ndarray) -> np.ndarray:
        return (np.clip((points >> self.shift) - self.base, -1, self.n - 2) + 1).astype(np.int8)

    def entry_lists(self, cells: np.ndarray) -> np.ndarray:
        """Flags per box and entry: not dominated. Float32 sums of 8 or more terms are off by less than the slack."""
        out = np.empty((len(cells), len(self.book)), bool)
        slack = np.float32(1 + 1e-6 * (len(self.tables) + 4))
        for a in range(0, len(cells), _ROWS):
            c = cells[a : a + _ROWS].astype(np.int64)
            near = far = None
            for at, n, f in self.tables:
                row = c[:, at[0]] * self.n + c[:, at[1]] if len(at) == 2 else c[:, at[0]]
                near = n[row] if near is None else np.add(near, n[row], out=near)
                far = f[row] if far is None else np.add(far, f[row], out=far)
            out[a : a + _ROWS] = near <= far.min(axis=1, keepdims=True) * slack
        return out

    def lists_of(self, cells: np.ndarray) -> np.ndarray:
        """Each row's entry list: boxes already kept are looked up by hash and compared, others are bounded and kept."""
        key = (cells.astype(np.int64).view(_U) * self.odd[: cells.shape[1]]).sum(axis=1, dtype=_U)
        first, back = np.unique(key, return_index=True, return_inverse=True)[1:]
        mine, mine_key = cells[first], key[first]
        lists = np.empty((len(first), len(self.book)), bool)
        at = np.minimum(np.searchsorted(self.keys, mine_key), max(len(self.keys) - 1, 0))
        known = (self.keys[at] == mine_key) & (self.cells[at] == mine).all(axis=1) if len(self.keys) else np.zeros(len(first), bool)
        lists[known] = self.lists[at[known]]
        new = ~known
        lists[new] = self.entry_lists(mine[new])
        if new.any():
            if len(self.keys) + int(new.sum()) > self.keep:  # full: start again from this batch
                self.keys, self.cells, self.lists = self.keys[:0], self.cells[:0], self.lists[:0]
            keys = np.concatenate([self.keys, mine_key[new]])
            kept, order = np.unique(keys, return_index=True)
            order = order[: self.keep]
            self.keys = kept[: self.keep]
            self.cells = np.concatenate([self.cells, mine[new]])[order]
            self.lists = np.concatenate([self.lists, lists[new]])[order]
        out = lists[back]
        clash = (mine[back] != cells).any(axis=1)  # another box with the same hash
        if clash.any():
            out[clash] = self.entry_lists(cells[clash])
        return out

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest entry, squared distance) of every point; equal distances go to the lower index."""
        code, dist = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
        for a in range(0, len(points), _ROWS):
            p = points[a : a + _ROWS]
            row, entry = np.nonzero(self.lists_of(self.cell(p)))
            away = p[row] - self.book[entry]
            d = np.einsum("ij,ij->i", away, away)
            best = np.minimum.reduceat(d, np.searchsorted(row, np.arange(len(p))))
            hit = np.flatnonzero(d == best[row])
            code[a : a + _ROWS] = entry[hit[np.unique(row[hit], return_index=True)[1]]]
            dist[a : a + _ROWS] = best
        return code, dist


def assign(points: np.ndarray, boxes: list[Boxes]) -> tuple[np.ndarray, np.ndarray]:
    """(parts, rows) codes and squared distances."""
    found = [b.nearest(p) for b, p in zip(boxes, points, strict=True)]
    return np.stack([c for c, _ in found]), np.stack([d for _, d in found])


def _first(vectors: DataFrame, entries: int) -> tuple[np.ndarray, int]:
    """The vectors of the smallest ids (at most ``entries``) as integers, and the common length."""
    def run(batches: Iterator[pa.RecordBatch], width: int | None) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.asarray(b.column(1).value_lengths().fill_null(0)) if b.num_rows else np.zeros(0, int)
            for w in np.unique(size[size > 0]) if width is None else [width]:
                rows, x = components(b.column(1), int(w))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(np.full(len(rows), w), pa.int32()), pa.array(list(x), pa.list_(pa.int64()))],
                                                 names=["id", "size", "x"])

    def smallest(width: int | None) -> list:
        kept = vectors.select("id", "x").mapInArrow(lambda batches: run(batches, width), "id long, size int, x array<long>")
        return kept.orderBy(F.col("id").asc_nulls_last(), "size", "x").limit(entries).collect()  # ``entries`` rows

    rows = smallest(None)
    if not rows:
        return np.zeros((0, 0), np.int64), 0
    width = rows[0].size
    if any(r.size != width for r in rows):
        rows = smallest(width)
    return np.array([r.x for r in rows], np.int64), width


def _sums(vectors: DataFrame, books: np.ndarray, width: int) -> DataFrame:
    """part, entry, n and the components' sums of all parts nearest to each entry."""
    parts, k, each = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        boxes = [Boxes(b) for b in books]
        n, total = np.zeros((parts, k), np.int64), np.zeros((parts, k, each), np.int64)
        for b in batches:
            points = cut(components(b.column(0), width)[1], parts)
            code, _ = assign(points, boxes)
            for p in range(parts):
                order = np.argsort(code[p], kind="stable")
                used, at = np.unique(code[p][order], return_index=True)
                if len(used):
                    total[p, used] += np.add.reduceat(points[p][order], at, axis=0)
                n[p] += np.bincount(code[p], minlength=k)
        p, e = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(n[p, e]), *(pa.array(total[p, e, j]) for j in range(each))],
                                         names=["part", "entry", "n", *(f"s{j}" for j in range(each))])

    schema = "part int, entry int, n long, " + ", ".join(f"s{j} long" for j in range(each))
    return vectors.select("x").mapInArrow(run, schema).groupBy("part", "entry").agg(*(F.sum(c).alias(c) for c in ("n", *(f"s{j}" for j in range(each)))))


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[np.ndarray, int]:
    """(codebooks of shape parts x entries x part width, vector length) after ``rounds`` rounds over all vectors (columns id, x)."""
    first, width = _first(vectors, entries)
    if not width:
        return np.zeros((parts, 0, 0), np.int64), 0
    books = cut(first, parts)
    for _ in range(rounds):
        for r in _sums(vectors, books, width).collect():  # at most parts * entries rows
            books[r.part, r.entry] = [r[3 + j] // r.n for j in range(books.shape[2])]
    return books, width


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id",
             vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error of every kept vector, as stored; the codebooks). ``code`` has two hex digits a part."""
    if not 1 <= entries <= 256:
        raise ValueError(f"entries must be from 1 to 256, not {entries}")
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"), F.col(label_col).alias("label"))
    books, width = fit(base, parts, entries, rounds)
    digits = np.array([f"{k:02x}" for k in range(256)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        boxes = [Boxes(b) for b in books] if width else []
        for b in batches:
            rows, x = components(b.column(1), width)
            if not width or not len(rows):
                continue
            code, dist = assign(cut(x, parts), boxes)
            text = digits[code[0]].astype(object)
            for c in code[1:]:
                text = text + digits[c].astype(object)
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(2).take(at), pa.array(text, pa.string()), pa.array(dist.sum(axis=0))],
                                             names=["vec_id", "label", "code", "error"])

    kind = dict(base.dtypes)["label"]
    return materialise(base.mapInArrow(run, f"vec_id long, label {kind}, code string, error long"), "codes"), books


def decode(codes: DataFrame, books: np.ndarray, width: int) -> DataFrame:
    """vec_id, x: the components (times ``SCALE``, integers) that the codes stand for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = np.array([list(bytes.fromhex(c)) for c in b.column(1).to_pylist()], np.int64).reshape(b.num_rows, len(books))
            x = np.concatenate([books[p][code[:, p]] for p in range(len(books))], axis=1)[:, :width]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(x), pa.list_(pa.int64()))], names=["vec_id", "x"])

    return codes.select("vec_id", "code").mapInArrow(run, "vec_id long, x array<long>")


def with_label_errors(codes: DataFrame) -> DataFrame:
    """``codes`` with the error summed over equal labels; nulls are one label."""
    sums = materialise(codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "label-errors")
    few = sums.count() <= BROADCAST_ROWS
    return codes.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("_label")), "left").drop("_label")
