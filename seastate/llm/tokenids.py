"""Operator 10, token-ID output: texts as token ids in frequency-ranked, byte-aligned variable-length files.

*Format.* A folder with three tables. ``ids``: one row per document, in files that each hold a range of ascending document ids,
with two byte strings: ``data`` holds each id's frequency rank in 1 to 4 little-endian bytes, ``control`` holds two bits per id
(bytes used less one), four ids to a byte. ``ranks``: the id of every rank. ``parts``: how many ids come before each range.
Frequent ids have small ranks and take one byte. Reading looks each control byte up in a table of 256 byte masks.
Spark's writer commits the files, so a lost executor or a retried task leaves no half-written part, on any store.

*Work.* Texts are encoded where they are read. A text is cut into the pieces that the tokenizer's own splitter would give (checked
by asking it about each character once), and every distinct piece is encoded once per worker by the tokenizers library; a text that
holds the string of an added token (such as an end-of-text mark) goes through the library's own ``encode``. The
memory of pieces is emptied at ``CACHE_PIECES``. The ids are stored once, counted, dealt by document id and coded. Only compressed ids
are shuffled. The rank table has as many rows as the vocabulary, the part table as the output has partitions.

Defined results: a null text is an empty one and holds only the end id; rows without an id come first; rows with equal ids are
ordered by a hash of the text, then by their place in the input; an empty table gives empty files; ids are those of
``Tokenizer.encode(text, add_special_tokens=False)``, so an added token's string in a text is that token; other columns are not looked at. Pieces are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise
from .scan import Chunk, chunks, span_hashes

CACHE_PIECES = 2_000_000
END_ID = 0
_SPACE, _LETTER, _NUMBER, _OTHER, _NEW = 0, 1, 2, 3, 9


def _byte_chars() -> str:
    """The printable stand-in of every byte that byte-level vocabularies use: printable Latin-1 as is, the rest from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return "".join(chr(b if b in plain else next(spare)) for b in range(256))


class PieceEncoder:
    """A byte-level BPE tokenizer applied to distinct pieces, each once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.size = self.tok.get_vocab_size()
        self.added = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        self.chars = {i: c for i, c in enumerate(_byte_chars())}
        self.kind = np.full(0x110000, _NEW, np.uint8)
        self.clear()

    def clear(self) -> None:
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.first, self.flat = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _learn_kind(self, points: np.ndarray) -> None:
        split = self.tok.pre_tokenizer.pre_tokenize_str
        for p in points:
            joins = [len(split(lead + chr(p))) == 1 for lead in "A1!"]
            self.kind[p] = joins.index(True) + 1 if any(joins) else _SPACE

    def pieces(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Byte bounds of the pieces of all rows: letters, numbers or other signs with one space before, runs of blanks, and clitics."""
        data = chunk.data
        cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        n = len(cp)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        kind = self.kind[cp]
        if (kind == _NEW).any():
            self._learn_kind(np.unique(cp[kind == _NEW]))
            kind = self.kind[cp]
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        row = np.zeros(n + 1, bool)  # a row begins here
        row[np.searchsorted(lead, chunk.begin)] = True
        row[n] = True
        start = row.copy()
        start[1:n] |= kind[1:] != kind[:-1]
        # Blanks before other text give up their last one; a plain space joins what follows.
        i = np.flatnonzero(start[1:n] & ~row[1:n] & (kind[1:] != _SPACE) & (kind[:-1] == _SPACE)) + 1
        start[i - 1] = True
        start[i[cp[i - 1] == 0x20]] = False
        # 's 't 'm 'd 're 've 'll, where the apostrophe stands alone and no space joined it.
        i = np.flatnonzero((cp[: n - 1] == 0x27) & start[: n - 1] & start[1:n] & ~row[1:n])
        after = cp[i + 1]
        one = i[np.isin(after, [ord(c) for c in "stmd"])]
        start[one + 1] = False
        start[one + 2] = True
        i, after = i[i + 2 < n], after[i + 2 < n]
        then = cp[i + 2]
        two = ((after == ord("r")) | (after == ord("v"))) & (then == ord("e")) | (after == ord("l")) & (then == ord("l"))
        two = i[two & ~row[i + 2]]
        start[two + 1] = False
        start[two + 3] = True
        at = np.append(lead, len(data))[np.flatnonzero(start[: n + 1])]
        return at[:-1], at[1:]

    def _marked(self, chunk: Chunk) -> list[int]:
        """Rows that hold the string of an added token."""
        raw, rows = chunk.data.tobytes(), set()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                row = int(np.searchsorted(chunk.begin, at, side="right")) - 1
                if at + len(token) <= chunk.end[row]:
                    rows.add(row)
                    at = raw.find(token, int(chunk.end[row]))
                else:  # only where two rows meet
                    at = raw.find(token, at + 1)
        return sorted(rows)

    def encode(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows on end, number of ids per row)."""
        ids, size = self._encode_plain(chunk)
        marked = self._marked(chunk)
        if not marked:
            return ids, size
        stop, out, at = np.cumsum(size), [], 0
        size = size.copy()
        for i in marked:
            own = np.array(self.tok.encode(chunk.text(i), add_special_tokens=False).ids, np.uint32)
            out += [ids[at : stop[i] - size[i]], own]
            at, size[i] = stop[i], len(own)
        return np.concatenate([*out, ids[at:]]), size

    def _encode_plain(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, with added tokens' strings as ordinary text."""
        begin, end = self.pieces(chunk)
        rows = len(chunk.begin)
        if not len(begin):
            return np.zeros(0, np.uint32), np.zeros(rows, np.int64)
        keys, where, inverse = np.unique(span_hashes(chunk.data, begin, end), return_index=True, return_inverse=True)
        if len(self.keys) > CACHE_PIECES:
            self.clear()
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        new = np.flatnonzero(~known)
        if len(new):
            tokenize, out, size = self.tok.model.tokenize, [], np.zeros(len(new), np.int64)
            for j, w in enumerate(where[new]):
                ids = [t.id for t in tokenize(chunk.data[begin[w] : end[w]].tobytes().decode("latin-1").translate(self.chars))]
                out += ids
                size[j] = len(ids)
            base = len(self.first) - 1
            self.first = np.append(self.first, self.first[-1] + np.cumsum(size))
            self.flat = np.append(self.flat, np.array(out, np.uint32))
            self.slot = np.insert(self.slot, at[new], base + np.arange(len(new)))
            self.keys = np.insert(self.keys, at[new], keys[new])
        slot = self.slot[np.searchsorted(self.keys, keys)][inverse]
        size = self.first[slot + 1] - self.first[slot]
        stop = np.cumsum(size)
        ids = self.flat[np.arange(stop[-1]) + np.repeat(self.first[slot] - (stop - size), size)]
        total = np.append(0, stop)
        bounds = np.searchsorted(begin, np.append(chunk.begin, len(chunk.data)))
        return ids, np.diff(total[bounds])


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """One per worker, kept between tasks."""
    return PieceEncoder(path)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit ranks."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    code = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    quads = np.zeros(-(-len(code) // 4) * 4, np.uint8)
    quads[: len(code)] = code
    quads = quads.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]].tobytes()


#: For each control byte, which of the 16 bytes of its four ids are stored.
_STORED = (np.arange(4) <= (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3)[:, :, None]).reshape(256, 16)


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    out = np.zeros(4 * n, np.uint8)
    out[_STORED[np.frombuffer(control, np.uint8)].reshape(-1)[: 4 * n]] = np.frombuffer(data, np.uint8)
    return out.view("<u4")


def encode_texts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tie, row, n_tokens and the ids (unsigned 32-bit, compressed), the end id last."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, squeeze = encoder(tokenizer), zstandard.ZstdCompressor(level=1)
        for b in batches:
            for c in chunks(b.column(3)):
                ids, size = enc.encode(c)
                kind = np.uint16 if enc.size <= 1 << 16 else np.uint32
                stop = np.cumsum(size)
                packed = [squeeze.compress(np.append(ids[s - k : s], END_ID).astype(kind).tobytes()) for s, k in zip(stop, size, strict=True)]
                old = b.slice(c.first, len(c.begin))
                yield pa.RecordBatch.from_arrays([*old.columns[:3], pa.array(size + 1, pa.int64()), pa.array([kind().itemsize] * len(size), pa.int32()),
                                                  pa.array(packed, pa.binary())], names=["doc_id", "tie", "row", "n_tokens", "width", "packed"])

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("tie"),
                       F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(run, "doc_id long, tie long, row long, n_tokens long, width int, packed binary")


def _loose(width: int, packed: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint16 if width == 2 else np.uint32)


def id_counts(encoded: DataFrame) -> DataFrame:
    """id, n over all texts; each task sends one row per id it has seen."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)
        for b in batches:
            for width, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n = np.bincount(_loose(width, packed), minlength=len(seen))
                n[: len(seen)] += seen
                seen = n
        ids = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(seen[ids])], names=["id", "n"])

    return encoded.select("width", "packed").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_ids(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the token files of ``docs`` below ``path``."""
    spark = docs.sparkSession
    encoded = materialise(encode_texts(docs, tokenizer, id_col, text_col), "token-ids")
    ids = [r.id for r in id_counts(encoded).orderBy(F.desc("n"), "id").collect()]  # no longer than the vocabulary
    spark.createDataFrame(pa.table({"rank": pa.array(range(len(ids)), pa.int64()), "id": pa.array(ids, pa.int64())}))\
        .coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(max(ids, default=0) + 1, np.uint32)
    rank_of[ids] = np.arange(len(ids), dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for b in batches:
            coded = [pack(rank_of[_loose(w, p)]) for w, p in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)]
            n = b.column(1).to_numpy()
            start = before + np.cumsum(n) - n
            before += int(n.sum())
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(0), pa.array(start, pa.int64()), b.column(1), pa.array([c for c, _ in coded], pa.binary()),
                                              pa.array([d for _, d in coded], pa.binary())], names=["part", "doc_id", "part_start", "n_tokens", "control", "data"])

    ordered = encoded.repartitionByRange("doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row")
    ordered = ordered.select("doc_id", "n_tokens", F.spark_partition_id().alias("part"), "width", "packed")
    ordered.mapInArrow(run, "part int, doc_id long, part_start long, n_tokens long, control binary, data binary")\
        .write.option("compression", "none").parquet(f"{path}/ids")
    spark.read.parquet(f"{path}/ids").groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).coalesce(1).write.parquet(f"{path}/parts")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit) of the files below ``path``."""
    id_of = np.array([r.id for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()], "<u4")
    parts = {r.part: r.n_tokens for r in spark.read.parquet(f"{path}/parts").collect()}  # one row per written partition
    first = np.zeros(max(parts, default=0) + 2, np.int64)
    for k, n in parts.items():
        first[k + 1] = n
    first = np.cumsum(first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column(3).to_numpy()
            start = first[b.column(0).to_numpy()] + b.column(2).to_numpy()
            ids = [id_of[unpack(c, d, k)].tobytes() for c, d, k in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), n, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(start, pa.int64()), b.column(3), pa.array(ids, pa.binary())],
                                             names=["doc_id", "start", "n_tokens", "ids"])

    files = spark.read.parquet(f"{path}/ids").select("part", "doc_id", "part_start", "n_tokens", "control", "data")
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
