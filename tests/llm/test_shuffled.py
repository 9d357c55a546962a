"""Operators that move rows: the Jaccard join, mixing, surrogates, chaining, token files, language model, and the pipeline."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from seastate.llm import attention, chaining, decontaminate, groups, jaccard, lmscore, mixing, quality, queries, scan, surrogates, tokenids

from .conftest import texts_of

SPACES = r"[^\x20\x09-\x0D]+"
BPE = public_tokenizers.path("byte_bpe_50k.json")


def shingles(text, n=5):
    w = re.findall(SPACES, text or "")
    k = min(n, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def brute_classes(texts):
    """Smallest id of each connected group at a Jaccard similarity of 0.8."""
    sets, root = {d: shingles(t) for d, t in texts.items()}, {d: d for d in texts}
    holders, shared = defaultdict(list), Counter()
    for d, s in sets.items():
        for g in s:
            shared.update((min(d, o), max(d, o)) for o in holders[g])
            holders[g].append(d)

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in shared.items():
        if n / (len(sets[a]) + len(sets[b]) - n) >= 0.8:
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    return {d: top(d) for d in texts}


def test_groups_of_paths_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 20)] + [(200, 201), (201, 202), (202, 200), (5, 5)]
    got = dict(groups.connected(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {i: 0 for i in range(1, 31)} | {100 + i: 100 for i in range(1, 20)} | {201: 200, 202: 200}
    assert groups.connected(spark.createDataFrame([], "a long, b long")).collect() == []


def test_bands_reach_the_recall():
    bands, rows = jaccard.bands_for()
    assert 1 - (1 - 0.8**rows) ** bands >= jaccard.RECALL and bands * rows <= 160


def test_join_finds_chains_of_near_copies(spark):
    """Texts that drift apart: neighbours are similar, ends are not; one group all the same, beside a group of exact copies."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    text = [word() for _ in range(200)]
    texts = {}
    for i in range(40):
        text[5 * i % 200] = word()
        texts[i] = " ".join(text)
    texts |= {100 + i: " ".join(text[:150]) for i in range(5)} | {200 + i: " ".join(word() for _ in range(50)) for i in range(20)} | {300: "", 301: "a b", 302: "a b"}
    got = jaccard.classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    want = brute_classes(texts)
    assert {r.doc_id: r.class_id for r in got} == want
    assert len({r.class_id for r in got if r.doc_id < 40}) == 1
    assert all(r.n_links > 0 for r in got if r.doc_id < 40) and {r.n_copies for r in got if 100 <= r.doc_id < 105} == {5}


def test_blocks_find_the_best_link_to_each_group():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 300).astype(np.uint64)
    some = [np.unique(np.append(base[: 300 - 7 * k], rng.integers(0, 2**63, 3 * k).astype(np.uint64))) for k in range(20)]
    g = np.arange(20) % 4
    i, j, s = jaccard._best_links(some[:8], some[8:], g[:8], g[8:], 0.8)
    want = {}
    for a in range(8):
        for b in range(8, 20):
            v = len(np.intersect1d(some[a], some[b])) / len(np.union1d(some[a], some[b]))
            if v >= 0.8 and g[a] != g[b]:
                want[a, g[b]] = max(want.get((a, g[b]), 0), v)
    assert {(a, g[8 + b]): pytest.approx(v) for a, b, v in zip(i.tolist(), j.tolist(), s.tolist(), strict=True)} == want


def test_join_counts_every_link(spark, monkeypatch):
    """Mutually similar variants, a drifting chain and exact copies, in blocks far smaller than the groups."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    base, texts = [word() for _ in range(200)], {}
    for i in range(40):
        mine = list(base)
        mine[5 * i] = word()
        texts[i] = " ".join(mine)
    text = [word() for _ in range(200)]
    for i in range(30):
        text[5 * i] = word()
        texts[100 + i] = " ".join(text)
    texts |= {200: "a b", 201: " ".join(word() for _ in range(50))}
    sets = {d: shingles(t) for d, t in texts.items()}
    want = {d: sum(e != d and len(s & o) >= 0.8 * len(s | o) for e, o in sets.items()) for d, s in sets.items()}
    assert {want[d] for d in range(40)} == {39} and 0 < min(want[100 + i] for i in range(30)) < 29
    rows = [*texts.items(), (0, texts[0])]
    got = jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_links for r in got} == want and len(got) == len(rows)


def test_join_on_odd_rows(spark, odd, none):
    got = jaccard.classes(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert by[8].class_id == by[9].class_id == by[10].class_id == 8 and by[8].n_copies == 4
    assert all(r.class_id == r.doc_id and r.n_links == 0 for r in got if r.doc_id in (0, 1, 2, 3, 4, 5, 6, 7, 11, 12))
    assert jaccard.classes(none).collect() == []
    one = jaccard.one_of_each(odd)
    assert one.columns == odd.columns and Counter(r.doc_id for r in one.collect() if r.doc_id is not None) == Counter([0, 1, 2, 3, 4, 5, 6, 7, 8, 11, 12])
    assert jaccard.one_of_each(none).collect() == []


def test_join_query(spark, sample):
    got = queries.QUERIES["op3_ngram_jaccard_join"](spark, sample).collect()
    assert {r.doc_id: r.class_id for r in got} == brute_classes(texts_of(spark, sample))


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        share = {s: 2 * sizes[s] if s in full else rest * weight[s] / sum(weight[k] for k in names if k not in full) for s in names}
        over = {s for s in names if share[s] > 2 * sizes[s]}
        if not over:
            return share
        full |= over


def test_transfer_keeps_words_and_expectation():
    rng = random.Random(4)
    for _ in range(200):
        p, q, v, w = rng.random(), rng.random(), rng.randint(1, 50), rng.randint(1, 50)
        a, b = mixing.transfer(p, v, q, w, rng.random())
        assert a * v + b * w == pytest.approx(p * v + q * w, abs=1e-6) and (a in (0.0, 1.0) or b in (0.0, 1.0)) and 0 <= min(a, b) <= max(a, b) <= 1
    mean = np.mean([mixing.transfer(0.3, 10, 0.6, 7, (i + 0.5) / 1000)[0] for i in range(1000)])
    assert mean == pytest.approx(0.3, abs=0.002)


def test_mix_of_odd_rows(spark, odd, none, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 4)  # several levels
    monkeypatch.setattr(mixing, "FAN", 2)
    got = mixing.copies(odd).collect()
    assert len(got) == odd.count() and all(r.copies in (0, 1, 2) for r in got)
    sizes = defaultdict(int)
    for r in odd.collect():
        sizes[r.source] += len(re.findall(SPACES, r.text or ""))
    want = brute_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    again = mixing.copies(odd.repartition(7)).collect()
    key = lambda rows: Counter((r.doc_id, r.h1, r.copies) for r in rows)
    assert key(got) == key(again)
    assert mixing.mix(odd).columns == odd.columns and mixing.mix(odd).count() == sum(r.copies for r in got)
    assert mixing.copies(none).collect() == [] and mixing.mix(none).collect() == []


def test_mix_query_meets_targets(spark, sample):
    got = queries.QUERIES["op4_source_mixing"](spark, sample).collect()
    sizes, taken, most = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        most[r.source] = max(most[r.source], r.size)
        assert r.taken <= 2 * r.size
    want = brute_targets(sizes)
    assert all(r.target == pytest.approx(want[r.source]) for r in got) and sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert all(abs(taken[s] - want[s]) <= most[s] for s in sizes)


def test_surrogates_keep_form_and_identity():
    key = b"k"
    text = ("Dr. Ode met Anna Brandt; BRANDT said +1 (017) 555-7713, 4539 1488 0343 6467, GB82 WEST 1234 5698 7654 32, 078-05-1120, "
            "A.b@Mail.example.com, a.b@mail.example.com, 10.1.2.3, 999.1.1.1, token = \"cf1d64a9a4c99\", Госпожа Иванова и Иванова")
    new, found = surrogates.rewrite(text, key, {})
    assert Counter(m.kind for m in found) == {"surname": 5, "given": 1, "phone": 1, "card": 1, "iban": 1, "ssn": 1, "email": 2, "ip": 1, "secret": 1}
    form = lambda t: re.sub(r"\w", "x", t.split("said")[1].split("A.b@")[0] if "A.b@" in t else t.split("said")[1])
    assert form(new).startswith(form(text))
    card = re.search(r"\d{4} \d{4} \d{4} \d{4}", new).group().replace(" ", "")
    assert surrogates.luhn(card) == 0 and card[0] == "4" and card != "4539148803436467"
    assert surrogates._iban_rest(re.search(r"GB\d\d(?: \w{2,4})+", new).group().replace(" ", "")) == 1
    mails = re.findall(r"\S+@[\w.]+", new)
    assert mails[0].lower() == mails[1] and mails[0] != mails[1] and "999.1.1.1" in new
    given, surname = re.search(r"met (\w+) (\w+);", new).groups()
    assert given in surrogates.GIVEN["latin", "f"] and given != "Anna" and surname.upper() in new
    russian = re.search(r"Госпожа (\w+) и (\w+)", new)
    assert russian.group(1) == russian.group(2) != "Иванова" and surrogates._script(russian.group(1)) == "cyrillic"
    assert surrogates.rewrite(text, key, {})[0] == new and surrogates.rewrite(text, b"other", {})[0] != new
    assert surrogates.rewrite("x" * 100_000 + "1" * 100_000, key, {})[1] == []
    for (script, gender), names in surrogates.GIVEN.items():
        mapped = {surrogates.surrogate("given", n.casefold(), key) for n in names}
        assert len(mapped) == len(names) and mapped == {n.casefold() for n in names}, (script, gender)


def test_surrogates_of_letters_of_any_script():
    key = b"k"
    for local in ("محمود.علي", "שרהכהן", "王小明李", "김민수박", "йёйёйё", "øłčøłč", "ØŁČØŁČ", "դավիթ"):
        new = surrogates.rewrite(f"to {local}@mail.example.com now", key, {})[0].split()[1].split("@")[0]
        assert new != local and len(new) == len(local) and sum(a == b for a, b in zip(new, local, strict=True) if a.isalpha()) <= 2, local
        assert [(surrogates.unicodedata.name(c).split()[0], c.isalpha(), c.isupper()) for c in new] == \
            [(surrogates.unicodedata.name(c).split()[0], c.isalpha(), c.isupper()) for c in local]
    new = surrogates.rewrite("Mr 王小明 met Mr Çelik", key, {})[0].split()
    assert new[1] != "王小明" and all(surrogates.unicodedata.name(c).startswith("CJK") for c in new[1]) and surrogates._script(new[4]) == "latin"


def found(text):
    return [(m.kind, text[m.start : m.end]) for m in surrogates.find(text)]


@pytest.mark.parametrize(("text", "want"), [
    ("at +44 20 7946 0958, 06 12 34 56 78", [("phone", "+44 20 7946 0958"), ("phone", "06 12 34 56 78")]),
    ("fe80::1ff:fe23:4567:890a at 12:30:45, a::b", [("ip", "fe80::1ff:fe23:4567:890a")]),
    ("password: hunter22x. secret: everything", [("secret", "hunter22x")]),
    ("gb82 west 1234 5698 7654 32 then", [("iban", "gb82 west 1234 5698 7654 32")]),
    ("ES91 2100 0418 4502 0005 1332 paid", [("iban", "ES91 2100 0418 4502 0005 1332")]),
    ("Maria van der Berg", [("given", "Maria"), ("surname", "Berg")]),
    ("MARIA GARCIA or Maria", [("given", "MARIA"), ("surname", "GARCIA"), ("given", "Maria")]),
    ("order 1234567890123, card 4222222222222", [("card", "4222222222222")]),
    ("Mr Long has a Long day, said Long", [("surname", "Long"), ("surname", "Long")]),
    ("Мария сказала", []),
    ("Dr Xenia Petrov", [("forename", "Xenia"), ("surname", "Petrov")]),
])
def test_forms_of_personal_data(text, want):
    assert found(text) == want


def test_surrogates_keep_gender_and_family():
    new = lambda t: surrogates.rewrite(t, b"k", {})[0].split()
    mrs, mr = new("Mrs Xenia Petrova knows Xenia"), new("Mr Xenon Petrov left")
    assert mrs[1].endswith("a") and mrs[1] == mrs[4] != "Xenia" and mr[1][-1] in "nrsl" and mrs[2] == mr[2] + "a" != "Petrova"
    she, he = new("Госпожа Иванова")[1], new("Господин Иванов")[1]
    assert she == he + "а" != "Иванова"
    assert new("Κυρία Παπαδοπούλου")[1].endswith("ου") and new("Κύριος Παπαδόπουλος")[1].endswith("ος")
    for kind, ends in (("forename_f", "a"), ("forename_m", "nrsl"), ("forename", "e")):
        drawn = {surrogates.surrogate(kind, f"n{i}", b"k") for i in range(300)}
        assert all(x[-1] in ends and x not in surrogates._KNOWN for x in drawn)


def test_surrogates_keep_the_form_of_addresses():
    for ip in ("2001:db8::1", "2001:0DB8:0000:0000:0000:ff00:0042:8329", "fe80::1ff:fe23:4567:890a"):
        new = surrogates.rewrite(ip, b"k", {})[0]
        assert new != ip and [len(g) for g in new.split(":")] == [len(g) for g in ip.split(":")]
    a, b = (surrogates.rewrite(x, b"k", {})[0] for x in ("2001:db8::1:7", "2001:0db8:0000:0000:0000:0000:0001:0007"))
    assert surrogates.IPv6Address(a) == surrogates.IPv6Address(b)


def test_surrogates_against_plain_python(spark):
    """Enough short surnames that some draw the same surrogate; every text as a loop over all entities gives it."""
    rng = random.Random(4)
    name = lambda: "".join(rng.choices("bcdfgklmnp", k=1) + rng.choices("aeiou", k=1) + rng.choices("bcdfgklmnp", k=1)).title()
    texts = [f"Mr {name()} and Mrs {name()} {name()} called +1 (0{rng.randrange(10, 99)}) 555-{rng.randrange(1000, 9999)}" for _ in range(250)]
    texts += texts[:20] + ["nothing", "", None]
    key, tried = b"k", {(m.kind, m.value): 0 for t in texts for m in surrogates.find(t) if m.kind != "given"}
    while True:
        drawn = {e: surrogates.surrogate(*e, key, n) for e, n in tried.items()}
        owner = {}
        for (kind, value), new in drawn.items():
            owner[kind, new] = min(owner.get((kind, new), (99, "")), (tried[kind, value], value))
        again = [e for e, new in drawn.items() if owner[e[0], new][1] != e[1] or (e[0], new) in tried]
        if not again:
            break
        for e in again:
            tried[e] += 1
    assert any(tried.values()) and len({(k, new) for (k, _), new in drawn.items()}) == len(drawn)
    got = surrogates.replace(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3), key)
    assert {r.doc_id: r.text for r in got.collect()} == {i: surrogates.rewrite(t, key, tried)[0] for i, t in enumerate(texts)}


def test_colliding_surrogates_draw_again(spark, monkeypatch):
    """With surrogates of few values, all entities still end apart, and none equals a value of the corpus."""
    monkeypatch.setattr(surrogates, "surrogate", lambda kind, value, key, attempt=0: f"{kind}{zlib.crc32(f'{value}/{attempt}'.encode()) % 60}")
    values = [("phone", f"phone{i}") for i in range(20)] + [("phone", f"p{i}") for i in range(10)]
    odd = surrogates.exceptions(spark.createDataFrame(values, "kind string, value string"), b"k").collect()
    attempts = {r.value: r.attempt for r in odd}
    final = [surrogates.surrogate("phone", v, b"k", attempts.get(v, 0)) for _, v in values]
    assert len(set(final)) == len(final) and not set(final) & {v for _, v in values} and odd


def test_surrogates_on_odd_rows(spark, odd, none):
    rows = odd.union(spark.createDataFrame([(50, "call +1 (017) 555-7713", "en", "a", 1, 2, 3, 4, "a", "b")], odd.schema))
    got = surrogates.replace(rows, b"k")
    assert set(got.columns) == {*odd.columns, "entities"}
    texts = {r.doc_id: r for r in got.collect()}
    assert texts[0].text is None and texts[1].text == "" and texts[50].text != "call +1 (017) 555-7713" and texts[50].entities == ["phone"]
    assert got.where("size(entities) > 0").count() == 1 and got.count() == rows.count()
    assert surrogates.replace(none, b"k").collect() == []


def test_surrogate_query_leaves_no_value(spark, sample):
    texts = texts_of(spark, sample)
    for r in queries.QUERIES["op5_pii_surrogates"](spark, sample).collect():
        old = texts[r.doc_id]
        assert (r.text == old) == (r.n_entities == 0)
        values = re.findall(r"[\w.+-]+@[\w-]+\.[\w.]+|\+\d \(\d+\) \d+-\d+|\b\d{16}\b|\b\d+\.\d+\.\d+\.\d+\b", old) + re.findall(r'token = "(\w+)"', old)
        assert not [v for v in values if v in r.text]


def test_chains_are_the_best():
    rng = np.random.default_rng(3)
    for _ in range(40):
        n = int(rng.integers(1, 9))
        pos, lead = rng.integers(0, 60, n), rng.integers(0, 60, n)
        got = chaining.chain(pos, lead)
        assert sorted(i for c in got for i in c) == list(range(n))

        def worth(c):
            gaps = sum(abs(int(pos[b] - pos[a])) + abs(int(lead[b] - lead[a])) - 2 * chaining.K for a, b in zip(c, c[1:], strict=False))
            return chaining.K * len(c) - chaining.SKIP_COST * gaps

        def best(i):
            return max([chaining.K] + [chaining.K + best(j) - chaining.SKIP_COST * (int(pos[i] - pos[j]) + int(lead[i] - lead[j]) - 2 * chaining.K)
                                       for j in range(n) if pos[j] < pos[i] and lead[j] < lead[i]])

        assert worth(got[0]) == pytest.approx(max(map(best, range(n))))
        assert all(pos[a] < pos[b] and lead[a] < lead[b] for c in got for a, b in zip(c, c[1:], strict=False))


def _plain_extend(a, b):
    """Pair by pair: over mismatches while matches outweigh them, then over words left out."""
    slips = sorted(((x, y) for x in range(chaining.SLIP + 1) for y in range(chaining.SLIP + 1) if x + y), key=sum)
    i = j = hits = 0
    while True:
        best = total = words = 0
        for k in range(min(len(a) - i, len(b) - j)):
            total += 1 if a[i + k] == b[j + k] else -1
            if total < best - chaining.DROP:
                break
            if total >= max(best, 1):
                best, words = total, k + 1
        i, j, hits = i + words, j + words, hits + (best + words) // 2
        for da, db in slips:
            x, y = a[i + da : i + da + chaining.SLIP], b[j + db : j + db + chaining.SLIP]
            if len(x) == len(y) == chaining.SLIP and x == y:
                i, j = i + da, j + db
                break
        else:
            return i, j, hits


def test_passages_extend_together_as_one_by_one():
    rng, pairs = random.Random(4), []
    for _ in range(400):
        kinds = rng.choice([3, 30, 3000])
        a = [rng.randrange(kinds) for _ in range(rng.randint(0, 90))]
        b = list(a)
        for _ in range(rng.randrange(12) if b else 0):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randint(0, 4)] = [rng.randrange(kinds) for _ in range(rng.randint(0, 4))]
        pairs.append((a, b))
    flat = [np.array([x for p in pairs for x in p[side]]) for side in (0, 1)]
    n = [np.array([len(p[side]) for p in pairs]) for side in (0, 1)]
    begin = [np.cumsum(k) - k for k in n]
    assert list(zip(*(x.tolist() for x in chaining.extend(*flat, *begin, *n, 1)), strict=True)) == [_plain_extend(a, b) for a, b in pairs]
    last = [at + k - 1 for at, k in zip(begin, n, strict=True)]
    assert list(zip(*(x.tolist() for x in chaining.extend(*flat, *last, *n, -1)), strict=True)) == [_plain_extend(a[::-1], b[::-1]) for a, b in pairs]


def test_matches_on_one_diagonal_chain_as_any_others():
    rng = random.Random(6)
    for _ in range(300):
        n = rng.randint(1, 40)
        pos = np.cumsum([rng.choice([1, 2, 6, 9, 20, 37, 50]) for _ in range(n)])
        head = [True] + [False] * (n - 1)
        chaining._line((chaining.SKIP_COST * (pos + pos + 7)).tolist(), head)
        first = [i for i in range(n) if head[i]]
        assert [list(range(i, j)) for i, j in zip(first, [*first[1:], n], strict=True)] == sorted(chaining.chain(pos, pos + 7))


def test_fuzzy_passages_are_found(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghijklm", k=5))
    passage = [word() for _ in range(120)]
    docs, at = [], {}
    for d in range(12):
        mine = list(passage)
        for _ in range(d % 6):  # up to five edits of each kind
            mine[rng.randrange(len(mine))] = word()
            del mine[rng.randrange(len(mine))]
            mine.insert(rng.randrange(len(mine)), word())
        before = [word() for _ in range(rng.randint(0, 100))]
        at[d] = (len(before), len(before) + len(mine))
        docs.append((d, " ".join(before + mine + [word() for _ in range(50)])))
    docs += [(20 + d, " ".join(word() for _ in range(200))) for d in range(5)] + [(30, " ".join(passage[:30])), (31, None)]
    got = {r.doc_id: r for r in chaining.summarise(*chaining.find_repeats(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1))).collect()}
    for d in range(1, 12):
        assert got[d].n_later_words >= 0.8 * (at[d][1] - at[d][0]), d
        assert all(p.begin >= at[d][0] - 8 and p.end <= at[d][1] + 8 for p in got[d].passages)
    assert got[0].n_later_words == 0 and got[0].n_first_words >= 100
    assert all(got[d].n_later_words == got[d].n_first_words == 0 for d in (20, 21, 22, 23, 24, 30, 31))


@pytest.mark.parametrize("before", [True, False])
def test_runs_whose_pieces_others_own_are_found(spark, before):
    """Two documents share 220 words; nine others hold overlapping pieces of 44 words, placed before both or partly between them."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghijklm", k=6))
    text = lambda mid: " ".join([word() for _ in range(40)] + mid + [word() for _ in range(30)])
    shared = [word() for _ in range(220)]
    pieces = [text(shared[22 * i : 22 * i + 44]) for i in range(9)]
    texts = [*pieces, text(shared), text(shared)] if before else [*pieces[::2], text(shared), *pieces[1::2], text(shared)]
    got = chaining.summarise(*chaining.find_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1))).collect()
    got = {r.doc_id: r for r in got}
    one, two = (9, 10) if before else (5, 10)
    assert got[two].n_later_words == 220 and got[one].n_first_words == 220 and got[one].n_later_words == 0
    assert [(p.begin, p.end, p.with_doc) for p in got[two].passages] == [(40, 260, one)]
    assert all(r.n_later_words == r.n_first_words == 0 for d, r in got.items() if d not in (one, two))


def test_every_run_longer_than_a_long_window_is_found():
    """Any two word lists with a common run of MIN_WORDS + LONG_WINDOW - 1 words keep a long seed of it in common."""
    rng = np.random.default_rng(5)
    size = chaining.MIN_WORDS + chaining.LONG_WINDOW - 1
    for _ in range(50):
        run = rng.integers(0, 2**63, size)
        kept = []
        for _side in range(2):
            words = np.concatenate([rng.integers(0, 2**63, rng.integers(0, 90)), run, rng.integers(0, 2**63, rng.integers(0, 90))]).astype(np.uint64)
            h = scan.WordSums(words).windows(chaining.MIN_WORDS)
            kept.append(set(h[chaining.minimizers(h, chaining.LONG_WINDOW)].tolist()))
        assert kept[0] & kept[1]


def test_every_exact_run_is_found_whoever_holds_its_pieces(spark):
    """Runs of 50 to 80 words between documents, while others hold pieces of them before; against every window of 50 words."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghijklm", k=6))
    texts = []
    for size in range(50, 81, 3):
        run = [word() for _ in range(size)]
        frame = lambda mid: [word() for _ in range(rng.randint(0, 40))] + mid + [word() for _ in range(rng.randint(0, 40))]
        texts += [frame(run[i : i + 49]) for i in range(0, size - 40, 4)] + [frame(run), frame(run), frame(run[: size // 2] + [word()] + run[size // 2 :])]
    pool = [word() for _ in range(600)]
    for _ in range(60):  # patchwork
        cuts = [(a, a + rng.randint(10, 120)) for a in (rng.randrange(580) for _ in range(6))]
        texts.append([x for a, b in cuts for x in [*pool[a:b], word()]])
    first, least = {}, []
    for d, w in enumerate(texts):
        later = set()
        for i in range(len(w) - 49):
            if first.setdefault(tuple(w[i : i + 50]), d) != d:
                later.update(range(i, i + 50))
        least.append(later)
    rows = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(texts)], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r for r in chaining.summarise(*chaining.find_repeats(rows)).collect()}
    for d, later in enumerate(least):
        assert later <= {i for p in got[d].passages for i in range(p.begin, p.end)}, d
        assert got[d].n_later_words >= len(later)
    assert sum(map(bool, least)) > 50


def test_windows_in_a_row_with_one_smallest_make_a_context():
    rng = np.random.default_rng(3)
    for n, span in ((50, 2**63), (51, 2**63), (300, 2**63), (300, 5)):  # the last has many ties
        sums = scan.WordSums(rng.integers(0, span, n).astype(np.uint64))
        h = sums.windows(chaining.LONG_K)
        place, first, size = chaining.contexts(h, chaining.LONG_WINDOW)
        assert first[0] == 0 and (np.diff(first) == size[:-1]).all() and size.sum() == n - chaining.MIN_WORDS + 1
        for p, f, s in zip(place, first, size, strict=True):
            assert all(i + int(np.argmin(h[i : i + chaining.LONG_WINDOW])) == p for i in range(f, f + s))
        code = chaining.context_codes(sums, first, size)
        assert (code & np.uint64(chaining._SIZE_BITS) == size).all()


def test_chaining_on_odd_rows(spark, odd, none):
    got = chaining.summarise(*chaining.find_repeats(odd)).collect()
    assert len(got) == odd.count()
    copies = [r for r in got if r.doc_id in (8, 9)]
    assert sorted(r.n_later_words for r in copies) == [0, 200, 200, 200] or sum(r.n_later_words == 0 for r in got if r.doc_id in (8, 9, 10)) == 1
    assert all(not r.passages for r in got if r.doc_id in (0, 1, 2, 3, 4, 5, 6, 11))
    assert chaining.summarise(*chaining.find_repeats(none)).collect() == []


def test_chaining_query_finds_every_exact_passage(spark, sample):
    texts, first, later = texts_of(spark, sample), {}, set()
    for d in sorted(texts):
        w = re.findall(SPACES, texts[d] or "")
        for i in range(len(w) - 49):
            if first.setdefault(tuple(w[i : i + 50]), d) != d:
                later.add(d)
    got = {r.doc_id: r for r in queries.QUERIES["op6_substring_dedup"](spark, sample).collect()}
    assert later <= {d for d, r in got.items() if r.n_later_words >= 50}
    for r in got.values():
        for p in r.passages:
            a, b = (Counter(re.findall(SPACES, texts[d])) for d in (r.doc_id, p.with_doc))
            assert p.end - p.begin >= 50 and sum((a & b).values()) >= 40


def test_codes_of_any_rank_come_back():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        r = (rng.integers(0, 2**32, n, dtype=np.uint64) >> rng.integers(0, 32, n).astype(np.uint64)).astype(np.uint32)
        assert (tokenids.unpack(*tokenids.pack(r), n) == r).all()


def expected_digest(rows):
    tok = Tokenizer.from_file(BPE)
    tok.encode_special_tokens = True
    out, start = [], 0
    for doc_id, text in rows:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_files_on_odd_rows(spark, odd, none):
    from pyspark.sql import functions as F

    got = [tuple(r) for r in queries.token_digest(odd).orderBy("start").collect()]
    ties = odd.select("doc_id", "text", F.xxhash64("text").alias("tie")).collect()
    rows = sorted(((r.doc_id, r.text, r.tie) for r in ties), key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    assert got == expected_digest([r[:2] for r in rows])
    assert queries.token_digest(none).collect() == []


def test_token_files_know_added_tokens(spark):
    tok, mark = Tokenizer.from_file(BPE), "<|endoftext|>"
    texts = [f"a {mark} b", "plain text", mark, "", f"{mark}{mark} it's{mark}\nend ", "<|endof", "text|> é", f"漢字 {mark} {mark[:-1]}"]
    want, start = [], 0
    for i, text in enumerate(texts):
        ids = np.array([*tok.encode(text, add_special_tokens=False).ids, 0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert 50256 in tok.encode(texts[0], add_special_tokens=False).ids
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert [tuple(r) for r in queries.token_digest(rows).orderBy("start").collect()] == want


def test_token_query(spark, sample):
    got = [tuple(r) for r in queries.QUERIES["op10_token_id_output"](spark, sample).orderBy("start").collect()]
    assert got == expected_digest(sorted(texts_of(spark, sample).items()))


def test_gradients_of_the_model():
    rng = np.random.default_rng(0)
    n = np.array([40, 3, 70])
    y = rng.integers(0, attention.CLASSES, n.sum())
    x = np.append(0, y[:-1])
    flat = attention.initial() + rng.standard_normal(attention.SIZE).astype(np.float32) * np.float32(0.1)
    model = attention.Model(flat, attention.PairTable(np.zeros((attention.CLASSES, attention.CLASSES))))
    at = attention.windows(n)
    _, grad = model.run(x, y, at, learn=True)
    first = 0
    for name, shape in attention._SHAPES.items():
        size = int(np.prod(shape))
        i = first + int(np.argmax(np.abs(grad[first : first + size])))
        old, loss = flat[i], []
        for step in (0.02, -0.02):
            flat[i] = old + step
            loss.append(model.run(x, y, at, learn=True)[0])
        flat[i] = old
        assert (loss[0] - loss[1]) / 0.04 == pytest.approx(grad[i], rel=0.05, abs=2e-4), name
        first += size


def test_model_is_a_causal_distribution():
    rng = np.random.default_rng(1)
    flat = attention.initial() + rng.standard_normal(attention.SIZE).astype(np.float32) * np.float32(0.2)
    pairs = attention.PairTable(rng.integers(0, 3, (attention.CLASSES, attention.CLASSES)))
    model = attention.Model(flat, pairs)
    y = rng.integers(0, attention.CLASSES, 50)
    x = np.append(7, y[:-1])
    score = model.run(x, y, attention.windows(np.array([50])))
    assert (score.reshape(-1)[50:] == 0).all() and (score.reshape(-1)[:50] < 0).all()
    total = 0.0
    for k in range(attention.CLASSES):  # all classes at one place sum to one; earlier places do not see it
        z = y.copy()
        z[30] = k
        other = model.run(np.append(7, z[:-1]), z, attention.windows(np.array([50]))).reshape(-1)
        total += math.exp(other[30])
        if k < 3:
            assert np.allclose(other[:30], score.reshape(-1)[:30], atol=1e-5)
    assert total == pytest.approx(1, abs=1e-3)


def test_learning_attends_from_scored_places_alone(monkeypatch):
    """The places before them are context: no loss is taken there, so queries and their gradients would be wasted work."""
    asked, attend = [], attention.Model._attend
    monkeypatch.setattr(attention.Model, "_attend", lambda self, cls, there, ask: asked.append(ask) or attend(self, cls, there, ask))
    model = attention.Model(attention.initial(), attention.PairTable(np.zeros((attention.CLASSES, attention.CLASSES))))
    y = np.arange(60) % attention.CLASSES
    model.run(np.append(7, y[:-1]), y, attention.windows(np.array([60])), learn=True)
    assert [len(range(attention.WINDOW)[a]) for a in asked] == [attention.STEP]


def check_scores(rows, texts):
    lower = str.maketrans({c: c + 32 for c in range(65, 91)})
    words = {d: [*re.findall(SPACES, (t or "").translate(lower)), None] for d, t in texts}
    held = {d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in texts}
    count = Counter(w for d, t in texts if not held[d] for w in [*re.findall(SPACES, (t or "").translate(lower)), None])
    n, v = sum(count.values()), len(count)
    for r in rows:
        if r.doc_id is None:
            continue
        w = words[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(w), sum(count[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w)) and r.score < 0


def test_scores_on_odd_rows(spark, odd, none, monkeypatch):
    monkeypatch.setattr(lmscore, "COMMON", 50)  # most words go through the join
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    got = lmscore.score_texts(odd, path, public_tokenizers.PATTERN).collect()
    assert len(got) == odd.count()
    check_scores(got, [(r.doc_id, r.text) for r in odd.collect()])
    assert lmscore.score_texts(none, path, public_tokenizers.PATTERN).collect() == []


def test_score_query_beats_chance_on_held_out_texts(spark, sample):
    got = queries.QUERIES["op7_lm_scoring"](spark, "/root/testdata/sf0.01").collect()
    check_scores(got, list(texts_of(spark, "/root/testdata/sf0.01").items()))
    held = [r for r in got if r.held_out]
    per_subword = sum(r.score for r in held) / sum(r.n_subwords for r in held)
    assert per_subword > -1.95, per_subword  # uniform over the subwords would be -4.7, their frequencies alone -2.4


def test_pipeline_equals_its_parts(spark, sample):
    """Every stage against plain Python on its own input."""
    docs = spark.read.parquet(f"{sample}/documents.parquet")
    bench = [re.findall(r"[a-z0-9\x80-\U0010ffff]+", r.text.lower()) for r in spark.read.parquet(f"{sample}/benchmark.parquet").collect()]
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality_rules", "ngram_jaccard_join", "benchmark_decontamination", "source_mixing", "token_ids"]
    from seastate.session import materialise

    kept = {r.doc_id for r in quality.measure_quality(docs).where("kept").collect()}
    now = materialise(steps["quality_rules"](spark, docs, sample), "t1")
    assert {r.doc_id for r in now.collect()} == kept and now.columns == docs.columns
    texts = {r.doc_id: r.text for r in now.collect()}
    now = materialise(steps["ngram_jaccard_join"](spark, now, sample), "t2")
    assert {r.doc_id for r in now.collect()} == {d for d, c in brute_classes(texts).items() if c == d}
    windows = {tuple(w[i : i + 10]) for w in bench for i in range(max(1, len(w) - 9)) if w}
    lower = str.maketrans({c: c + 32 for c in range(65, 91)})

    def dirty(text):
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.translate(lower))
        return any(tuple(w[i : i + k]) in windows for k in {len(x) for x in windows} for i in range(len(w) - k + 1))

    clean = {r.doc_id for r in now.collect() if not dirty(r.text)}
    now = materialise(steps["benchmark_decontamination"](spark, now, sample), "t3")
    assert {r.doc_id for r in now.collect()} == clean
    sizes = Counter()
    for r in now.collect():
        sizes[r.source] += len(re.findall(SPACES, r.text))
    want, biggest = brute_targets(sizes), max(len(re.findall(SPACES, r.text)) for r in now.collect())
    now = materialise(steps["source_mixing"](spark, now, sample), "t4")
    taken = Counter()
    for r in now.collect():
        taken[r.source] += len(re.findall(SPACES, r.text))
    assert all(abs(taken[s] - want[s]) <= biggest for s in sizes) and max(Counter(r.doc_id for r in now.collect()).values()) <= 2
    rows = sorted((r.doc_id, r.text) for r in now.collect())
    got = [tuple(r) for r in steps["token_ids"](spark, now, sample).orderBy("start").collect()]
    assert got == expected_digest(rows)
    assert [tuple(r) for r in corpus_pipeline.run(spark, sample).orderBy("start").collect()] == got


def test_pipeline_stages_on_odd_and_empty_rows(spark, odd, none, sample):
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sample)
            assert out.columns == docs.columns
            assert out.count() <= 2 * docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sample).count() == docs.count()
    assert decontaminate.BLOCK_BYTES > 1 << 20
