"""Operators that scan texts: quality rules, token counts, decontamination, URL filters, against plain Python."""

import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from seastate.llm import decontaminate, quality, queries, tokencount, urlrules
from seastate.llm.scan import NON_SPACE, chunks, repeats, span_hashes, spans

from .conftest import texts_of

SPACES = r"[^\x20\x09-\x0D]+"


def test_chunks_and_spans_follow_the_texts():
    texts = ["a bb", None, "", " é  ccc ", "x" * 5000, "d"]
    col = pa.array(["skip", *texts], pa.string()).slice(1)
    got = []
    for limit in (1, 16, 1 << 20):
        words = []
        for c in chunks(col, limit):
            w = spans(c, c.data, NON_SPACE)
            words += [(c.first + r, c.data[s:e].tobytes().decode()) for s, e, r in zip(w.start, w.end, w.row, strict=True)]
        got.append(words)
    want = [(i, w) for i, t in enumerate(texts) for w in re.findall(SPACES, t or "")]
    assert got == [want] * 3


def test_equal_spans_hash_equally_across_blocks():
    c = next(chunks(pa.array(["ab " * 200_000 + "ba cd ab"])))
    w = spans(c, c.data, NON_SPACE)
    h = span_hashes(c.data, w.start, w.end)
    assert len(set(h.tolist())) == 3 and h[0] == h[-1] == h[150_000]
    assert repeats(np.array([3, 1, 3, 2, 3], np.uint64))[1].tolist() == [False, False, True, False, True]


def brute_quality(text):
    w = re.findall(SPACES, text or "")
    seen = Counter(zip(w, w[1:], w[2:], strict=False))
    inside = {j for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if seen[g] > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if re.search(SPACES, x)]
    out = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
           "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(inside)}
    for n, _ in quality.QualityRules().ngrams:
        grams = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
        often = Counter(grams)
        cover = {j for i, g in enumerate(grams) if often[g] > 1 for j in range(i, i + n)}
        out[f"dup_{n}gram_chars"] = sum(len(w[j]) for j in cover)
    return out


def test_quality_on_odd_rows(spark, odd, none):
    got = quality.measure_quality(odd).join(odd.select("doc_id", "text").distinct(), "doc_id").collect()
    for r in got:
        want = brute_quality(r.text)
        assert {k: r[k] for k in want} == want
        assert r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words) and not (r.kept and r.base_failed)
    assert quality.measure_quality(odd).count() == odd.count()
    assert quality.measure_quality(none).collect() == [] and quality.keep_good(none).collect() == []
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns
    good = quality.measure_quality(odd).where("kept").count()
    assert kept.count() == good > 0


@pytest.mark.parametrize("scored", ["file", "zipf", "no bytes"])
def test_counts_equal_the_library(scored):
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces, byte = tokencount.piece_file(public_tokenizers.path("piece_bpe_32k.model"))
    if scored == "zipf":
        pieces = [(p, -float(np.log(i + 3))) for i, (p, _) in enumerate(pieces)]
    if scored == "no bytes":
        pieces, byte = [p for p in pieces if not p[0].startswith("<0x") and len(p[0]) < 3], False
    tok = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces], 0, byte_fallback=byte))
    tok.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    rng = random.Random(1)
    bits = ["the", "t", " ", "  ", "\n", "é", "漢", "😀", "▁", "<0x41>", "</s>", "ing", "𓀀", "ㄱ"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 20))) for _ in range(800)] + ["", None, "x" * 3000, " " * 50, "▁", " a", "a "]
    model = tokencount.UnigramCounter(pieces, byte)
    n = np.concatenate([model.rows(c)[0] for c in chunks(pa.array(texts), 500)])
    assert n.tolist() == [len(e.ids) for e in tok.encode_batch([t or "" for t in texts])]
    assert n.tolist() == [model.text(t)[0] for t in texts]


def test_token_counts_on_odd_rows(spark, odd, none):
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = tokencount.count_tokens(odd, path).collect()
    model = tokencount.counter(path)
    texts = {r.doc_id: r.text for r in odd.collect() if r.doc_id is not None}
    assert len(got) == odd.count()
    assert all((r.n_tokens, pytest.approx(r.score)) == model.text(texts[r.doc_id]) for r in got if r.doc_id in texts)
    assert tokencount.count_tokens(none, path).collect() == []


def test_token_count_query(spark, sample):
    got = queries.QUERIES["op2_token_counts"](spark, sample).collect()
    model, texts = tokencount.counter(public_tokenizers.path("piece_bpe_32k.model")), texts_of(spark, sample)
    assert len(got) == len(texts) and all(r.n_tokens == model.text(texts[r.doc_id])[0] for r in got)


def test_decontamination_on_odd_rows(spark, odd, none, monkeypatch):
    long = odd.where("doc_id = 7").first().text.split()
    bench = spark.createDataFrame([(1, " ".join(long[500:515])), (2, "TWO, words!"), (2, "漢字"), (None, "one"), (3, None), (4, " .. ")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.mark_hits(odd, bench).collect()}
    assert got[7].hits == list(range(500, 515)) and got[7]["items"] == ["1"]
    assert got[4].hits == [0, 1] and got[4]["items"] == ["2"] and got[3]["items"] == [""] and got[11]["items"] == ["2"]
    assert got[0].n_words == 0 and not got[0].hits and not got[8].hits
    assert decontaminate.mark_hits(none, bench).collect() == []
    assert not any(r.hits for r in decontaminate.mark_hits(odd, bench.limit(0)).collect())
    clean = decontaminate.clean(odd, bench)
    assert clean.columns == odd.columns and clean.count() == odd.count() - 4
    cut = {r.doc_id: r.text for r in decontaminate.clean(odd, bench, remove="spans").collect()}
    assert cut[4] == "" and cut[7].split() == long[:500] + long[515:]
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 8)  # several blocks give the same result
    again = {r.doc_id: r for r in decontaminate.mark_hits(odd, bench).collect()}
    assert {k: (r.n_words, r.hits, r["items"]) for k, r in again.items()} == {k: (r.n_words, r.hits, r["items"]) for k, r in got.items()}
    assert decontaminate.clean(odd, bench).count() == clean.count()


def brute_hits(text, items, window=10):
    """(hit positions, ids of items with an occurring window) of one text."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    w, hits, ids = cut(text), set(), set()
    for i, t in items:
        v = cut(t)
        k = min(window, len(v))
        for g in {tuple(v[s : s + k]) for s in range(len(v) - k + 1)} if k else ():
            for s in range(len(w) - k + 1):
                if tuple(w[s : s + k]) == g:
                    hits |= set(range(s, s + k))
                    ids.add("" if i is None else str(i))
    return sorted(hits), sorted(ids)


def test_decontamination_against_brute_force_in_blocks(spark, monkeypatch):
    """Few words, so that windows are shared by items, repeat within one, and meet documents everywhere; one row is a third of the benchmark."""
    rng = random.Random(8)
    say = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choices(["a", "B", "é", "c3", "Ab"], k=n))
    items = [(i % 9, say(rng.choice([1, 3, 9, 10, 11, 40]))) for i in range(20)] + [(4, None), (5, "..."), (None, "c3 c3 c3 c3"), (7, "a " * 60)] + [(3, say(12))] * 12
    docs = [(i, say(rng.choice([0, 2, 10, 300]))) for i in range(40)] + [(40, "A " * 30), (41, None)]
    bench, texts = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = {i: brute_hits(t, items) for i, t in docs}
    for words in (decontaminate.BLOCK_WORDS, 60):
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", words)
        assert {r.doc_id: (r.hits, r["items"]) for r in decontaminate.mark_hits(texts, bench).collect()} == want
        assert {r.doc_id for r in decontaminate.clean(texts, bench).collect()} == {i for i, (h, _) in want.items() if not h}
    assert len(list(decontaminate.window_blocks(bench, 10))) > 3


def test_window_index_is_small():
    """16 bytes a word, the text once, and a bitmap per length; equal windows of an item are held once."""
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(500)) for _ in range(200)] + ["same " * 5000]
    block = decontaminate.Block(pa.array([str(i) for i in range(201)]), pa.array(texts), 10)
    index = block.index()
    held = sum(x.nbytes for w in index.sizes.values() for x in (w.known, w.item, w.start))
    assert block.index() is index and held <= 16 * 200 * 500 and len(index.plain) <= sum(map(len, texts)) + 201
    assert len(index.sizes[10].known) == 200 * 491 + 1


def test_half_of_the_pattern_rules_fire(spark):
    """On the pages of the 0.01 tables, among urls that no site rule decides."""
    got = queries.QUERIES["op8_url_filters"](spark, "/root/testdata/sf0.01")
    fired = {r.pattern for r in got.where("pattern IS NOT NULL").select("pattern").distinct().collect()}
    assert 2 * len(fired) >= len(queries.PATTERN_RULES)


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://", "http://A.com", "http://A.com/x", "http://example.com/en/", "http://www.EXAMPLE.com/en/?q", "http://wwwexample.com/en/",
            "https://x.net/es/1#t", "https://x.net/EN/", "https://best.casino.org/", "https://casinos.org/", "http://net/fr/", "a://b://c.net/fr/",
            "https://a.org/" + "x/" * 200_000 + "casino/", "https://spam.org/" + "casino" * 50_000]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls + urls[:2])] + [(None, urls[5], None)], "page_id long, url string, host string")
    got = urlrules.judge_urls(pages, queries.SITE_RULES, queries.PATTERN_RULES).collect()

    def plain(url):
        rest = (url or "").partition("://")[2]
        host = re.match(r"[^/?#]*", rest).group().lower()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        fit = [r for r in queries.SITE_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fit, key=lambda r: len(r.name), default=None)
        block = any(re.search(r.regex(), (url or "").lower()) for r in queries.PATTERN_RULES)
        return host, path, best and best.name, best.verdict if best else "block" if block else "allow"

    assert len(got) == pages.count()
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == plain((urls + urls[:2])[r.page_id] if r.page_id is not None else urls[5])
    assert {r.page_id for r in got if r.pattern} == {11, 15, 16}
    assert urlrules.judge_urls(pages.limit(0), queries.SITE_RULES).collect() == []
    assert {r.verdict for r in urlrules.judge_urls(pages, []).collect()} == {"allow"}
    lazy = urlrules.RuleIndex(queries.PATTERN_RULES, {})
    assert not lazy.compiled and lazy.matches("http://a.org/casino/") == [0] and list(lazy.compiled) == [0]
    index = urlrules.RuleIndex(queries.SITE_RULES, {"com": 9, "net": 5, "es": 1, "fr": 1, "example": 3, "en": 2, "www": 1})
    assert index.filed == {"com": [0], "en": [1], "www": [2], "es": [3], "fr": [4]} and not index.always
