"""Operator 2, token counts: how many tokens a unigram tokenizer makes of each text, without making them.

The tokenizer is a unigram vocabulary (pieces with scores, optional byte pieces) over words that begin with a marker: spaces become
markers, a text gets one in front, and every marker starts a word. Within a word an Aho-Corasick automaton enumerates the pieces
that end at each character, longest first; dynamic programming keeps, per position, only the best score and the number
of pieces on the way there. A later piece wins only if it scores strictly more, so of equal ways the one whose last piece starts
first wins, as in the public tokenizers library (tests compare with it). A character that no single piece covers is unknown: it
costs ``UNKNOWN_COST`` more than the worst piece and counts as its bytes where the vocabulary has byte pieces, else a run of
unknown characters counts as one piece.

Each distinct word is counted once per worker; the memory of words is emptied at ``CACHE_WORDS``. One scan, no shuffle.

Defined results: a null or empty text has 0 tokens and score 0; a text without spaces is one word of any length; repeated rows are counted
each; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import Chunk, chunks, span_hashes, spans, table

CACHE_WORDS = 2_000_000
UNKNOWN_COST = 10.0
MARK = "▁"
_NON_MARK = ~table((0x20, 0x20))
_MARK_BYTES = MARK.encode()


def piece_file(path: str) -> tuple[list[tuple[str, float]], bool]:
    """(pieces with scores, whether all 256 byte pieces are there) of a sentencepiece model file; control pieces left out."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
    return [(m.id_to_piece(i), m.get_score(i)) for i in ids], sum(map(m.is_byte, ids)) == 256


class UnigramCounter:
    """Best score and piece count of words under a unigram vocabulary."""

    def __init__(self, pieces: Sequence[tuple[str, float]], byte_pieces: bool):
        self.auto = ahocorasick.Automaton()
        for piece, score in pieces:
            self.auto.add_word(piece, (len(piece), score))
        self.auto.make_automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min(s for _, s in pieces) - UNKNOWN_COST
        self.byte_pieces = byte_pieces
        self.clear()

    def clear(self) -> None:
        self.keys, self.n, self.score = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0)

    def word(self, w: str) -> tuple[int, float]:
        """(pieces, score) of one word; the empty word has none."""
        size = len(w)
        best: list = [None] * (size + 1)
        count = [0] * (size + 1)
        best[0] = 0.0
        if self.single.issuperset(w):
            for end, (length, score) in self.auto.iter(w):
                s = best[end + 1 - length] + score
                if best[end + 1] is None or s > best[end + 1]:
                    best[end + 1], count[end + 1] = s, count[end + 1 - length] + 1
            return count[size], best[size]
        open_run = [False] * (size + 1)  # the way to here ends in an unknown character
        ending: list[list] = [[] for _ in range(size)]
        for end, match in self.auto.iter(w):
            ending[end].append(match)
        for end in range(size):
            for length, score in ending[end]:
                s = best[end + 1 - length] + score
                if best[end + 1] is None or s > best[end + 1]:
                    best[end + 1], count[end + 1], open_run[end + 1] = s, count[end + 1 - length] + 1, False
            if w[end] not in self.single:
                s = best[end] + self.unknown
                if best[end + 1] is None or s > best[end + 1]:
                    more = len(w[end].encode()) if self.byte_pieces else 0 if open_run[end] else 1
                    best[end + 1], count[end + 1], open_run[end + 1] = s, count[end] + more, True
        return count[size], best[size]

    def text(self, text: str) -> tuple[int, float]:
        """The plain way: the whole text, word by word."""
        if not text:
            return 0, 0.0
        text = text.replace(" ", MARK)
        first, *rest = (text if text.startswith(MARK) else MARK + text).split(MARK)
        found = [self.word(MARK + w) for w in rest]
        return sum(n for n, _ in found), sum(s for _, s in found)

    def rows(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, score) of every row of a chunk."""
        data, rows = chunk.data, len(chunk.begin)
        w = spans(chunk, data, _NON_MARK)
        keys, where, inverse = np.unique(span_hashes(data, w.start, w.end), return_index=True, return_inverse=True)
        if len(self.keys) > CACHE_WORDS:
            self.clear()
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        new = np.flatnonzero(~known)
        found = [self.word(MARK + data[w.start[k] : w.end[k]].tobytes().decode("utf-8")) for k in where[new]]
        self.keys = np.insert(self.keys, at[new], keys[new])
        self.n = np.insert(self.n, at[new], [n for n, _ in found])
        self.score = np.insert(self.score, at[new], [s for _, s in found])
        slot = np.searchsorted(self.keys, keys)[inverse]
        n = np.bincount(w.row, weights=self.n[slot], minlength=rows).astype(np.int64)
        score = np.bincount(w.row, weights=self.score[slot], minlength=rows)
        # Spaces that no word follows are words of the marker alone.
        full = chunk.end > chunk.begin
        bare = np.zeros(rows, np.int64)
        bare[full] = data[chunk.begin[full]] != 0x20
        spaces = np.append(0, np.cumsum(data == 0x20))
        lone = spaces[chunk.end] - spaces[chunk.begin] - (np.bincount(w.row, minlength=rows) - bare)
        alone_n, alone_score = self.word(MARK)
        n += lone * alone_n
        score += lone * alone_score
        # A marker that stands in the text itself also starts a word.
        mark = np.flatnonzero((data[:-2] == _MARK_BYTES[0]) & (data[1:-1] == _MARK_BYTES[1]) & (data[2:] == _MARK_BYTES[2])) if len(data) > 2 else []
        for i in np.unique(np.searchsorted(chunk.begin, mark, side="right") - 1):
            n[i], score[i] = self.text(chunk.text(i))
        return n, score


@lru_cache(maxsize=2)
def counter(path: str) -> UnigramCounter:
    """One per worker, kept between tasks."""
    return UnigramCounter(*piece_file(path))


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and score (the best sum of piece scores) per document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = counter(vocabulary)
        for b in batches:
            for c in chunks(b.column(1)):
                n, score = model.rows(c)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(c.first, len(n)), pa.array(n), pa.array(score)], names=["doc_id", "n_tokens", "score"])

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(run, "doc_id long, n_tokens long, score double")
