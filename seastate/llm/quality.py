"""Operator 1, quality rules: how much of a text lies inside repeated n-grams and repeated lines.

Each text is scanned once. Word hashes and their running sums give the hash of every window of several lengths; windows
that occur twice or more in a text mark the words they cover, and the characters of those words are counted. Lines are
hashed the same way. Rows are independent, so the operator is a scan without a shuffle and memory follows the longest text.

Defined results: a null text counts as an empty one (no words, rejected); a text without spaces is one word; repeated rows are
judged each on their own and give equal verdicts; an empty table gives an empty result; columns other than the id and the text
are never looked at, so clashing names do no harm. Hashes have 64 bits and are compared within one text only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import NON_BREAK, NON_SPACE, Chunk, WordSums, chunks, covered, mix, repeats, span_hashes, spans, table

_U = np.uint64
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_LEADS = ~table((0x80, 0xBF))


@dataclass(frozen=True)
class QualityRules:
    """Limits: (n, largest share of word characters inside repeated n-grams), of repeated lines, of symbols to words."""

    min_words: int = 50
    max_repeat_percent: int = 50
    ngrams: tuple[tuple[int, float], ...] = ((4, 0.40), (6, 0.35), (10, 0.30))
    max_line_share: float = 0.30
    max_symbol_share: float = 0.10


def _measure(chunk: Chunk, rules: QualityRules) -> dict[str, np.ndarray]:
    rows = len(chunk.begin)
    words = spans(chunk, chunk.data, NON_SPACE)
    lead = np.zeros(len(chunk.data) + 1, np.int64)
    np.cumsum(_LEADS[chunk.data], out=lead[1:])
    length = lead[words.end] - lead[words.start]
    per_row = lambda values, at=words.row: np.bincount(at, weights=values, minlength=rows).astype(np.int64)
    n = len(words.row)
    out = {"n_words": np.bincount(words.row, minlength=rows), "word_chars": per_row(length)}
    symbols = np.zeros(len(chunk.data) + 1, np.int64)
    np.cumsum(SYMBOLS[chunk.data], out=symbols[1:])
    out["n_symbols"] = symbols[chunk.end] - symbols[chunk.begin]

    # Lines hold a word if one starts in them; equal lines of one text share a key.
    lines = spans(chunk, chunk.data, NON_BREAK)
    first_word = np.searchsorted(words.start, lines.start)
    full = first_word < np.searchsorted(words.start, lines.end)
    ls, le, lr = lines.start[full], lines.end[full], lines.row[full]
    _, later = repeats(mix(span_hashes(chunk.data, ls, le) + lr.astype(_U) * _U(0x632BE59BD9B4E019)))
    out["n_dup_lines"] = np.bincount(lr[later], minlength=rows)
    chars = np.zeros(n + 1, np.int64)
    np.cumsum(length, out=chars[1:])
    a, b = np.searchsorted(words.start, ls[later]), np.searchsorted(words.start, le[later])
    out["dup_line_chars"] = per_row(chars[b] - chars[a], lr[later])

    # Windows of one text share a key; a window may not reach into the next row.
    sums = WordSums(span_hashes(chunk.data, words.start, words.end))
    salt = mix(words.row.astype(_U) + _U(1))
    for size in dict.fromkeys([3, *(k for k, _ in rules.ngrams)]):
        at = np.flatnonzero(words.row[: max(0, n - size + 1)] == words.row[size - 1 :]) if n >= size else np.zeros(0, np.int64)
        twice, _ = repeats(sums.windows(size, at) ^ salt[at])
        inside = covered(at[twice], size, n)
        if size == 3:
            out["n_repeat_words"] = np.bincount(words.row[inside], minlength=rows)
        if any(size == k for k, _ in rules.ngrams):
            out[f"dup_{size}gram_chars"] = per_row(length[inside], words.row[inside])
    return out


def _judge(m: dict[str, np.ndarray], rules: QualityRules) -> dict[str, np.ndarray]:
    failed = (m["n_words"] < rules.min_words) | (100 * m["n_repeat_words"] > rules.max_repeat_percent * m["n_words"])
    over = m["dup_line_chars"] > rules.max_line_share * m["word_chars"]
    over |= m["n_symbols"] > rules.max_symbol_share * m["n_words"]
    for size, share in rules.ngrams:
        over |= m[f"dup_{size}gram_chars"] > share * m["word_chars"]
    return m | {"base_failed": failed, "kept": ~failed & ~over}


def measure_quality(docs: DataFrame, rules: QualityRules | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: word and symbol counts, characters inside repeated n-grams and lines, and the verdict."""
    rules = rules or QualityRules()
    extra = ["dup_line_chars", *(f"dup_{k}gram_chars" for k, _ in rules.ngrams)]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *extra]
    flags = ["base_failed", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1)):
                m = _judge(_measure(c, rules), rules)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(c.first, len(c.begin)), *(pa.array(m[k].astype(np.int64)) for k in names),
                     *(pa.array(m[k]) for k in flags)], names=["doc_id", *names, *flags])

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, " + ", ".join(f"{k} long" for k in names) + ", base_failed boolean, kept boolean"
    return base.mapInArrow(run, schema)


def keep_good(docs: DataFrame, rules: QualityRules | None = None) -> DataFrame:
    """The documents that pass, with all their columns; the verdict is joined to nothing: it travels with the row."""
    rules = rules or QualityRules()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text")).cast(pa.string())
            for c in chunks(text):
                kept = _judge(_measure(c, rules), rules)["kept"]
                yield batch.slice(c.first, len(c.begin)).filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
