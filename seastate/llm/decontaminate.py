"""Operator 9, benchmark decontamination: find the words of training texts that lie inside benchmark windows.

The benchmark's texts go to the tasks, and every worker makes the hash set of their windows (``window`` consecutive normalised
words; a shorter item is one window of its own length) once: sorted arrays of hashes, item numbers and places. Every window of a
text is hashed by one subtraction of running sums; windows whose hash is in the set are compared word for word, so a chance
collision never counts. A text is scanned as a whole, in one pass without a shuffle.

The set is bounded: distinct items are dealt into blocks of about ``BLOCK_BYTES`` and ``BLOCK_WORDS``, counted beforehand, and
more than one block means one pass per block over a written table that carries the hits found so far.

Defined results: a null or empty text has no words and no hits; an item without words has no windows; rows of one item id count as one
item; an item without an id marks words and counts as the id ``""``; repeated documents are marked each; an empty benchmark leaves
every document clean; columns beside the named ones are not looked at.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .scan import LOWER, Chunk, WordSums, chunks, covered, span_hashes, spans, table

#: Bytes of ids and texts, and words, in a block: what a worker keeps is 16 bytes a word and the text once more.
BLOCK_BYTES, BLOCK_WORDS = 32 << 20, 4 << 20
WORD = table((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FILTER_BITS = 25
#: Windows found in documents whose items a worker remembers.
_VERIFIED = 1 << 15
_U = np.uint64


class Block:
    """Some items as they travel to the tasks: ids and texts as Arrow columns; every worker indexes a block once."""

    def __init__(self, ids: pa.Array, texts: pa.Array, window: int):
        self.key, self.ids, self.texts, self.window = uuid.uuid4().hex, ids, texts, window

    def index(self) -> WindowIndex:
        if self.key not in _INDEXED:
            _INDEXED.clear()
            _INDEXED[self.key] = WindowIndex(self)
        return _INDEXED[self.key]


#: The index of the block this worker scans for, by the block's key.
_INDEXED: dict[str, WindowIndex] = {}


class Windows(NamedTuple):
    """The windows of one length, ascending by hash: 16 bytes each, and a bitmap that turns most other hashes away."""

    known: np.ndarray
    item: np.ndarray
    start: np.ndarray
    seen: np.ndarray


class WindowIndex:
    """Windows of a block of items in sorted arrays, over the items' words written one after the other.

    A window is held as its hash, its item's number and the byte at which it starts. Of equal windows of one item one stays.
    """

    def __init__(self, block: Block):
        self.ids, self.verified = block.ids, {}
        parts: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        written, size = [], 0
        for c in chunks(block.texts):
            data = LOWER[c.data]
            w = spans(c, data, WORD)
            length = w.end - w.start
            at = np.cumsum(length + 1) - length - 1
            plain = np.full(int(length.sum()) + len(length), 0x20, np.uint8)
            plain[np.arange(int(length.sum())) + np.repeat(np.arange(len(length)), length)] = data[WORD[data]]
            n = np.bincount(w.row, minlength=len(c.begin))
            sums = WordSums(span_hashes(data, w.start, w.end))
            # A word starts a window if its item goes on for long enough; an item of few words is one window.
            left = np.repeat(np.cumsum(n), n) - np.arange(len(w.row))
            wide = np.minimum(n, block.window)[w.row]
            starts = np.flatnonzero(left >= wide)
            for k in np.unique(wide[starts]).tolist():
                s = starts[wide[starts] == k]
                parts.setdefault(k, []).append((sums.windows(k, s), (w.row[s] + c.first).astype(np.int32), (at[s] + size).astype(np.int64 if size >> 31 else np.int32)))
            written.append(plain)
            size += len(plain)
        self.plain = np.concatenate(written).tobytes() if written else b""
        written.clear()
        self.sizes = {k: self._sorted(parts.pop(k)) for k in sorted(parts)}

    @staticmethod
    def _sorted(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Windows:
        known, item, start = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        order = np.argsort(known, kind="stable")
        known = known[order]
        item, start = item[order], start[order]
        new = np.append(True, (known[1:] != known[:-1]) | (item[1:] != item[:-1]))  # a stable sort keeps an item's windows together
        if not new.all():
            known, item, start = known[new], item[new], start[new]
        seen = np.zeros(1 << (_FILTER_BITS - 3), np.uint8)
        np.bitwise_or.at(seen, *_bit(known))
        return Windows(known, item, start, seen)

    def candidates(self, size: int, keys: np.ndarray) -> np.ndarray:
        """Places of the keys that are hashes of windows."""
        ws = self.sizes[size]
        byte, bit = _bit(keys)
        maybe = np.flatnonzero(ws.seen[byte] & bit)
        at = np.minimum(np.searchsorted(ws.known, keys[maybe]), len(ws.known) - 1)
        return maybe[ws.known[at] == keys[maybe]]

    def items(self, size: int, key: np.uint64, text: bytes) -> frozenset[int]:
        """Numbers of the items with a window of this hash and these words, compared word for word."""
        if text not in self.verified:
            if len(self.verified) >= _VERIFIED:
                self.verified.clear()
            ws, step = self.sizes[size], len(text) + 1
            lo, hi = np.searchsorted(ws.known, key, "left"), np.searchsorted(ws.known, key, "right")
            self.verified[text] = frozenset(i for i, s in zip(ws.item[lo:hi].tolist(), ws.start[lo:hi].tolist(), strict=True) if self.plain[s : s + step] == text + b" ")
        return self.verified[text]


def _bit(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte and bit of a hash in the bitmap."""
    top = keys >> _U(64 - _FILTER_BITS)
    return (top >> _U(3)).astype(np.int64), np.left_shift(np.uint8(1), (top & _U(7)).astype(np.uint8))


def window_text(data: np.ndarray, start: np.ndarray, end: np.ndarray, first: int, size: int) -> bytes:
    return b" ".join(data[start[j] : end[j]].tobytes() for j in range(first, first + size))


def find(chunk: Chunk, known: WindowIndex) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[set[int]]]:
    """(row of each word, bytes where each word starts and ends, hit flags, item numbers per row) of one chunk."""
    data = LOWER[chunk.data]
    w = spans(chunk, data, WORD)
    n, rows = len(w.row), len(chunk.begin)
    hit, items = np.zeros(n, bool), [set() for _ in range(rows)]
    sums = WordSums(span_hashes(data, w.start, w.end))
    for size in known.sizes:
        at = np.flatnonzero(w.row[: max(0, n - size + 1)] == w.row[size - 1 :]) if n >= size else np.zeros(0, np.int64)
        keys = sums.windows(size, at)
        found = []
        for j in known.candidates(size, keys):
            s = at[j]
            numbers = known.items(size, keys[j], window_text(data, w.start, w.end, s, size))
            if numbers:
                found.append(s)
                items[w.row[s]] |= numbers
        if found:
            hit |= covered(np.array(found), size, n)
    return w.row, np.stack([w.start, w.end]), hit, items


def window_blocks(bench: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text") -> Iterator[Block]:
    """The benchmark in blocks of bounded bytes and words; a lone item is never split, so the bounds hold for all but a longer item."""
    items = bench.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).cast("string").alias("t")).where("t IS NOT NULL").distinct()
    size = items.agg(F.sum(F.octet_length("i") + F.octet_length("t") + 16), F.sum(F.regexp_count("t", F.lit(_WORDS)))).first()
    n = max(1, math.ceil((size[0] or 0) / BLOCK_BYTES), math.ceil((size[1] or 0) / BLOCK_WORDS))
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).toArrow()
        yield Block(rows["i"].combine_chunks(), rows["t"].combine_chunks(), window)


def mark_hits(docs: DataFrame, bench: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, hits (positions of the words inside benchmark windows), items (sorted ids)."""
    schema = "doc_id long, text string, n_words long, hits array<long>, items array<string>"
    state = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                        F.lit(0).cast("long").alias("n_words"), F.array().cast("array<long>").alias("hits"),
                        F.array().cast("array<string>").alias("items"))

    def scanner(block: Block, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = block.index()
            for b in batches:
                for c in chunks(b.column(1)):
                    rows = len(c.begin)
                    row, _, hit, items = find(c, known)
                    n = np.bincount(row, minlength=rows)
                    first = np.cumsum(n) - n
                    old = b.slice(c.first, rows)
                    hits, ids = old.column(3).to_pylist(), old.column(4).to_pylist()
                    at = np.flatnonzero(hit)
                    for i in np.unique(row[at]):
                        hits[i] = sorted({*hits[i], *(at[row[at] == i] - first[i]).tolist()})
                        ids[i] = sorted({*ids[i], *(known.ids[j].as_py() for j in items[i])})
                    text = pa.nulls(rows, pa.string()) if last else old.column(1).cast(pa.string())
                    yield pa.RecordBatch.from_arrays(
                        [old.column(0), text, pa.array(n, pa.int64()), pa.array(hits, pa.list_(pa.int64())),
                         pa.array(ids, pa.list_(pa.string()))], names=["doc_id", "text", "n_words", "hits", "items"])
        return run

    blocks = window_blocks(bench, window)
    block = next(blocks)
    for following in blocks:
        state = materialise(state.mapInArrow(scanner(block, False), schema), "decontaminate")
        block = following
    return state.mapInArrow(scanner(block, True), schema).drop("text")


def clean(docs: DataFrame, bench: DataFrame, window: int = 10, remove: str = "documents") -> DataFrame:
    """The documents without benchmark text: whole documents go, or (``remove="spans"``) only the words inside windows.

    All columns are kept. Removing spans cuts from the first to the last byte of each run of hit words.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove must be documents or spans, not {remove}")

    def scanner(block: Block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = block.index()
            for b in batches:
                at_text = b.schema.get_field_index("text")
                for c in chunks(b.column(at_text)):
                    rows = len(c.begin)
                    row, edge, hit, _ = find(c, known)
                    dirty = np.zeros(rows, bool)
                    dirty[row[hit]] = True
                    out = b.slice(c.first, rows)
                    if remove == "documents":
                        out = out.filter(pa.array(~dirty))
                    elif dirty.any():
                        old = out.column(at_text)
                        texts = old.to_pylist()
                        for i in np.flatnonzero(dirty):
                            j = np.flatnonzero(hit & (row == i))
                            cut = np.zeros(c.end[i] - c.begin[i], bool)
                            for run_ in np.split(j, np.flatnonzero(np.diff(j) > 1) + 1):
                                cut[edge[0, run_[0]] - c.begin[i] : edge[1, run_[-1]] - c.begin[i]] = True
                            texts[i] = c.data[c.begin[i] : c.end[i]][~cut].tobytes().decode("utf-8")
                        cols = [pa.array(texts, old.type) if k == at_text else x for k, x in enumerate(out.columns)]
                        out = pa.RecordBatch.from_arrays(cols, schema=b.schema)
                    yield out
        return run

    blocks = window_blocks(bench, window)
    block = next(blocks)
    for following in blocks:
        docs = materialise(docs.mapInArrow(scanner(block), docs.schema), "decontaminate")
        block = following
    return docs.mapInArrow(scanner(block), docs.schema)
