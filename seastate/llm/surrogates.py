"""Operator 5, personal data: detected entities are replaced by keyed surrogates of the same type, form, script and gender.

*Finding.* E-mail addresses, phone numbers, IPv4 and IPv6 addresses, card numbers (15 or 16 digits, or a right check digit), social
security numbers, IBANs in either case, secrets that are quoted, prefixed, or hold letters and digits after ``password:``, and people: an
honorific or a known given name before a capitalised name, with ``van der`` and the like between them, in capitals too; bare mentions of
these names in the same text count as well, but for a capital word between an article and a small word ("a Long day").

*Replacing.* A surrogate is drawn from a keyed hash of (type, canonical value, attempt), so every mention of an entity in the
corpus gets the same one without any lookup, and a name's parts are mapped one by one, so "Mr Ode" and "Ida Ode" stay one
person. Digits become digits, letters letters of the same script and case, separators stay; card numbers keep their check
status and first digit, IBANs stay valid, given names keep their gender and script: a listed one goes to another of its list, an unlisted one
(``forename``) takes the gender of the honorific before it. Surnames keep a gendered ending, and a Slavic couple shares its stem.

*Distinctness.* The distinct entities (pre-aggregated; never the texts) are checked: no two may share a surrogate, and none may be a
value that occurs in the corpus. Those that do draw again with the next attempt until all are apart. Only these exceptions
are joined back to the texts that mention them; in most corpora there are none, and the whole work is two scans.

Defined results: a null text stays null with no entities, an empty one empty; equal rows are rewritten equally; an empty table gives an
empty result; all other columns pass through unread in ``replace``.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from ipaddress import IPv6Address
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

MAX_ATTEMPTS = 64
TYPES = ("email", "phone", "ip", "card", "ssn", "iban", "secret", "given", "forename", "surname")

GIVEN = {
    ("latin", "f"): "Alice Anna Carla Clara Claire Elena Emma Frieda Greta Hannah Helga Ines Irene Isabel Julia Laura Lucia Maria Marie Martha Nadia Olga Paula Rosa Sara Sophie Teresa Ursula Vera".split(),
    ("latin", "m"): "Albert Bruno Carlos Daniel David Diego Emil Felix Franz Georg Hans Henri Hugo Ivan Jakob Javier John Jorge Karl Louis Luis Marcel Martin Miguel Oskar Pablo Paul Peter Pierre Robert Thomas Victor".split(),
    ("cyrillic", "f"): "Анна Вера Дарья Елена Ирина Мария Нина Ольга Софья Татьяна".split(),
    ("cyrillic", "m"): "Алексей Борис Виктор Дмитрий Иван Максим Николай Олег Павел Сергей".split(),
    ("greek", "f"): "Άννα Βασιλική Δήμητρα Ελένη Ειρήνη Κατερίνα Μαρία Σοφία".split(),
    ("greek", "m"): "Αντώνης Γιώργος Δημήτρης Κώστας Μιχάλης Νίκος Πέτρος Σπύρος".split(),
}
#: Titles before a name, by the gender they tell.
HONORIFICS = {
    "m": "Mr Herr Señor Monsieur Господин Κύριος".split(),
    "f": "Mrs Ms Miss Frau Señora Madame Mme Mlle Госпожа Κυρία".split(),
    "": "Dr Prof".split(),
}
#: Small words inside surnames.
PARTICLES = "van von der den de del della di da dos du la le bin ibn al el ter ten zu".split()
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se so ta te to va ve vo za ze".split(),
    "cyrillic": "ба бо ва ве га го да де жа за зо ка ко ла ле ма мо на но па пе ра ро са се та то фа ха ша".split(),
    "greek": "βα βο γα δε δο ζα θα θο κα κο λα λε μα μο να νο πα πο ρα ρο σα σε τα το φα χα".split(),
}
_LETTERS = {"latin": "abcdefghijklmnopqrstuvwxyz", "accented": "àáâäçèéêëíîïñóôöùúûü", "cyrillic": "абвгдежзиклмнопрстуфхцчшщыэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}
#: Last syllables of unlisted given names by gender; no ending of one gender is one of another.
_FORENAME_ENDS = {
    "latin": {"f": "na ra la ta".split(), "m": "n r s l".split(), "": "ne re le te".split()},
    "cyrillic": {"f": "на ра ла та".split(), "m": "н р с л".split(), "": "но ро ло то".split()},
    "greek": {"f": "να ρα λα τα".split(), "m": "νης ρης λος τος".split(), "": "νο ρο λο το".split()},
}
#: Surname endings that tell a gender: the ending, what its surrogate ends in, and what the masculine form has in its place.
_SURNAME_ENDS = {
    "latin": [("ova", "a", "ov"), ("eva", "a", "ev")],
    "cyrillic": [("ова", "а", "ов"), ("ева", "а", "ев"), ("ёва", "а", "ёв"), ("ина", "а", "ин"), ("ына", "а", "ын"), ("ая", "ая", "ий"), ("ий", "ий", "ий")],
    "greek": [("ου", "ου", "ου"), ("η", "η", "η"), ("ή", "η", "ή"), ("α", "α", "α"), ("ά", "α", "ά"), ("ος", "ος", "ος"), ("ης", "ης", "ης"), ("ας", "ας", "ας")],
}
_GENDER = {title: gender for gender, titles in HONORIFICS.items() for title in titles}
_KNOWN = {name.casefold(): key for key, names in GIVEN.items() for name in names}

_PATTERN = re.compile(
    r"""(?P<email>(?<![\w.%+-])[\w.%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+)
    |(?P<secret>(?i:(?<!\w)(?:token|api[_-]?key|secret|password)\s{0,3}[=:]\s{0,3}["'])(?P<value>[^"'\s]{8,256})(?=["']))
    |(?P<plain>(?i:(?<!\w)(?:token|api[_-]?key|secret|password|passwd|pwd)\s{0,3}[=:]\s{0,3})(?P<bare>[^\s"',;]{7,255}[^\s"',;.!?)]))
    |(?P<key>(?<!\w)(?:AKIA[0-9A-Z]{16}|ghp_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,64})(?!\w))
    |(?P<iban>(?<!\w)[A-Za-z]{2}\d{2}(?:[ ]?[0-9A-Za-z]{4}){3,7}(?:[ ]?[0-9A-Za-z]{1,3})?(?!\w))
    |(?P<ip6>(?<![\w:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:]))
    |(?P<ip>(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\w|\.\d))
    |(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))
    |(?P<card>(?<![\w+])\d(?:[ -]?\d){12,18}(?![\w]))
    |(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3}[ .-]\d{4}(?!\w)
        |(?<![\w+])\+\d{1,3}(?:[ .-]?(?:\(\d{1,4}\)|\d{2,4})){2,5}(?!\w)|(?<![\w+.-])0\d(?:[ .-]\d\d){4}(?![\w.-]?\d))""", re.X)
_TITLE = r"[^\W\d_a-z][^\W\d_]+(?:-[^\W\d_]+)?"
_CAPITAL = re.compile(r"(?<!\w)[^\W\d_a-z][^\W\d_]+(?!\w)")
_SMALL = rf"[ ](?:(?i:{'|'.join(PARTICLES)})[ ]){{0,3}}"
_AFTER_TITLE = re.compile(rf"\.?{_SMALL}(?P<first>{_TITLE})(?!\w)(?:{_SMALL}(?P<second>{_TITLE})(?!\w))?")
_AFTER_GIVEN = re.compile(rf"{_SMALL}(?P<last>{_TITLE})(?!\w)")
_ARTICLE = re.compile(r"(?<!\w)(?:[Aa]n?|[Ee]very|[Ee]ach|[Nn]o) $")
_HINT = re.compile(r"[0-9]")
_HEX = "0123456789abcdef"


class Mention(NamedTuple):
    start: int
    end: int
    kind: str
    value: str  # canonical


def luhn(digits: str) -> int:
    """The check sum modulo 10; 0 for a valid number."""
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10


def _iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _is_iban(found: str) -> bool:
    value = found.replace(" ", "").upper()
    return 15 <= len(value) <= 34 and sum(c.isdigit() for c in value) >= 8 and _iban_rest(value) == 1


def _ip6(found: str) -> str | None:
    """The short form of an IPv6 address of at least three groups; none for times, ranges and the like."""
    if sum(map(bool, found.split(":"))) < 3 or not _HINT.search(found):
        return None
    try:
        return IPv6Address(found).compressed
    except ValueError:
        return None


def _people(text: str) -> list[Mention]:
    """Names after a title or a known given name, and their bare mentions."""
    out: list[Mention] = []
    names: dict[str, tuple[str, str]] = {}
    at = 0
    for m in _CAPITAL.finditer(text):
        word = m.group()
        if m.start() < at:
            continue
        if word in _GENDER:
            t = _AFTER_TITLE.match(text, m.end())
            parts = [k for k in ("first", "second") if t and t.group(k) and not t.group(k)[0].islower()] if t and not t.group("first")[0].islower() else []
            for k in parts:
                low = t.group(k).casefold()
                kind = "surname" if k == parts[-1] else "given" if low in _KNOWN else f"forename_{_GENDER[word]}".rstrip("_")
                out.append(Mention(*t.span(k), kind, low))
        elif (word[1:].islower() or word.isupper()) and word.casefold() in _KNOWN:
            t = _AFTER_GIVEN.match(text, m.end())
            parts = ["last"] if t and not t.group("last")[0].islower() and (t.group("last").isupper() or not word.isupper()) else []
            if parts:
                out += [Mention(*m.span(), "given", word.casefold()), Mention(*t.span("last"), "surname", t.group("last").casefold())]
        else:
            continue
        if parts:
            at = t.end(parts[-1])
    for m in out:
        form = text[m.start : m.end]
        form = form.title() if form.isupper() else form
        for x in (form, form.upper()):
            if names.get(x, ("",))[0] != "surname":
                names[x] = (m.kind, m.value)
    if names:
        for m in re.finditer(rf"(?<!\w)(?:{'|'.join(map(re.escape, names))})(?!\w)", text):
            after = text[m.end() : m.end() + 2]
            if after[:1] == " " and after[1:].islower() and _ARTICLE.search(text[max(0, m.start() - 7) : m.start()]):
                continue
            out.append(Mention(*m.span(), *names[m.group()]))
    return out


def find(text: str | None) -> list[Mention]:
    """Mentions in order, none overlapping."""
    if not text:
        return []
    out: list[Mention] = []
    if _HINT.search(text) or "@" in text or '"' in text or "'" in text:
        for m in _PATTERN.finditer(text):
            kind, (a, b) = m.lastgroup, m.span()
            found = m.group()
            if m.group("value") is not None:
                kind, (a, b) = "secret", m.span("value")
                value = m.group("value")
            elif kind == "plain":
                kind, (a, b), value = "secret", m.span("bare"), m.group("bare")
                if not (re.search(r"\d", value) and re.search(r"[^\W\d_]", value)):
                    continue
            elif kind == "key":
                kind, value = "secret", found
            elif kind == "email":
                value = found.lower()
            elif kind == "ip":
                if any(int(x) > 255 for x in found.split(".")):
                    continue
                value = found
            elif kind == "ip6":
                kind, value = "ip", _ip6(found)
                if value is None:
                    continue
            elif kind == "iban":
                while not _is_iban(found) and " " in found:  # the words after it may look like its last groups
                    found = found.rpartition(" ")[0]
                if not _is_iban(found):
                    continue
                b, value = a + len(found), found.replace(" ", "").upper()
            else:
                value = re.sub(r"\D", "", found)
                if kind == "card" and len(value) not in (15, 16) and luhn(value):
                    continue
                if kind == "phone" and not 7 <= len(value) <= 15:
                    continue
            out.append(Mention(a, b, kind, value))
    out += _people(text)
    clear, at = [], 0
    for m in sorted(dict.fromkeys(out), key=lambda m: (m.start, -m.end)):
        if m.start >= at:
            clear.append(m)
            at = m.end
    return clear


class _Stream:
    """Numbers from a keyed hash of (type, value, attempt)."""

    def __init__(self, key: bytes, *parts: str):
        self.key, self.label, self.block = key, "\x1f".join(parts).encode(), 0
        self.pool, self.size = 0, 1

    def below(self, n: int) -> int:
        if self.size < 1 << 64:
            h = hashlib.blake2b(self.label + self.block.to_bytes(4, "big"), key=self.key, digest_size=64).digest()
            self.block, self.pool, self.size = self.block + 1, int.from_bytes(h, "big"), 1 << 512
        self.pool, out = divmod(self.pool, n)
        self.size //= n
        return out


def _script(word: str) -> str:
    if any("Ѐ" <= c <= "ӿ" for c in word):
        return "cyrillic"
    if any("Ͱ" <= c <= "Ͽ" for c in word):
        return "greek"
    return "latin" if any(unicodedata.name(c, "").startswith("LATIN") for c in word) else "other"


@lru_cache(maxsize=4096)
def _neighbours(c: str) -> str:
    """Letters of the same script and category among the 256 code points around an uncommon letter, whose case can be changed and back."""
    kind, script, base = unicodedata.category(c), unicodedata.name(c, "").split(" ")[0], ord(c) & ~0xFF
    return "".join(x for x in map(chr, range(base, base + 256)) if unicodedata.category(x) == kind and unicodedata.name(x, "").split(" ")[0] == script
                   and (kind != "Ll" or len(x.upper()) == 1 and x.upper() != x and x.upper().lower() == x))


def _like(c: str, s: _Stream, hexa: bool = False) -> str:
    """A character of the same kind: digit, or letter of the same script and case; others stay."""
    if c.isdigit():
        return str(s.below(10))
    if not c.isalpha():
        return c
    low = c.lower()
    pool = "abcdef" if hexa else next((p for p in _LETTERS.values() if low in p), None) or _neighbours(low[0])
    if not pool:
        return c
    new = pool[s.below(len(pool))]
    return new.upper() if c != low else new


def surrogate(kind: str, value: str, key: bytes, attempt: int = 0) -> str:
    """The canonical surrogate of a canonical value; from the ninth attempt on it may grow by a digit where its form allows."""
    s = _Stream(key, kind, value, str(attempt))
    if kind == "email":
        local, _, domain = value.partition("@")
        d = _Stream(key, "domain", domain)
        *labels, top = domain.split(".")
        labels = [x for x in labels if x != "example"] or ["mail"]  # surrogates live below the reserved name
        new = "".join(_like(c, s) for c in local) + (str(s.below(10**6)) if attempt >= 8 else "")
        return new + "@" + ".".join([*("".join(_like(c, d) for c in x) for x in labels), "example", top])
    if kind == "ip" and ":" in value:
        groups = [f"{int(g, 16):x}" if int(g, 16) else "" for g in IPv6Address(value).exploded.split(":")]
        return IPv6Address(":".join((_HEX[1 + s.below(15)] + "".join(_HEX[s.below(16)] for _ in g[1:])) if g else "0" for g in groups)).compressed
    if kind == "ip":
        first = value.split(".")[0]
        head = first if first in ("10", "127", "192") else str(1 + s.below(223))
        return ".".join([head, *(str(s.below(256)) for _ in range(3))])
    if kind == "card":
        body = value[0] + "".join(str(s.below(10)) for _ in value[1:-1])
        valid = next(str(d) for d in range(10) if luhn(body + str(d)) == 0)
        return body + (valid if luhn(value) == 0 else str((int(valid) + 1 + s.below(9)) % 10))
    if kind == "iban":
        body = "".join(_like(c, s) for c in value[4:])
        return value[:2] + f"{98 - _iban_rest(value[:2] + '00' + body):02d}" + body
    if kind in ("phone", "ssn"):
        return "".join(c if c == "0" and i == 0 else str(1 + s.below(9)) if i == 0 else str(s.below(10)) for i, c in enumerate(value))
    if kind == "secret":
        prefix = next((p for p in ("AKIA", "ghp_", "sk-") if value.startswith(p)), "")
        hexa = re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value[len(prefix) :]) is not None
        return prefix + "".join(_like(c, s, hexa) for c in value[len(prefix) :])
    if kind == "given":
        names = GIVEN[_KNOWN[value]]
        # A permutation of the list keyed by script and gender keeps given names apart.
        order = sorted(names, key=lambda n: hashlib.blake2b(n.encode(), key=key, digest_size=8).digest())
        return order[(order.index(next(n for n in names if n.casefold() == value)) + 1 + attempt % (len(names) - 1)) % len(order)].casefold()
    script = _script(value)
    if script == "other":
        return "".join(_like(c, s) for c in value + (value[-1] if attempt >= 8 else ""))
    bits = SYLLABLES[script]
    n = max(2, min(5, (len(value) + 1) // 2)) + (1 if attempt >= 8 else 0)
    if kind.startswith("forename"):
        ends = _FORENAME_ENDS[script][kind.partition("_")[2]]
        while True:
            new = "".join(bits[s.below(len(bits))] for _ in range(n - (kind != "forename_m"))) + ends[s.below(len(ends))]
            if new not in _KNOWN:
                return new
    for end, put, base in _SURNAME_ENDS[script]:
        if value.endswith(end.casefold()) and len(value) > len(end) + 1:
            man = value.removesuffix(end.casefold()) + base
            s = _Stream(key, kind, man, str(attempt))  # both forms of a couple draw the same stem
            n = max(2, min(5, (len(man) + 1) // 2)) + (1 if attempt >= 8 else 0)
            stem = "".join(bits[s.below(len(bits))] for _ in range(n))
            hard = {"latin": "nrstl", "cyrillic": "внрк", "greek": ""}[script]
            if script == "cyrillic" and put in ("ая", "ий"):
                return stem + "ск" + put
            return stem + (hard[s.below(len(hard))] if hard else "λκνρ"[s.below(4)]) + put
    tail = {"latin": "nrstl", "cyrillic": "внрк", "greek": "ς"}[script]
    return "".join(bits[s.below(len(bits))] for _ in range(n)) + tail[s.below(len(tail))]


def dress(mention: str, kind: str, new: str) -> str:
    """The canonical surrogate in the form of the mention: its separators and its case."""
    if kind == "ip" and ":" in new:
        if "::" not in mention:
            new = ":".join(f"{int(g, 16):0{len(old)}x}" for g, old in zip(IPv6Address(new).exploded.split(":"), mention.split(":"), strict=True))
        return new.upper() if mention != mention.lower() else new
    if kind in ("phone", "card", "ssn", "iban"):
        it = iter(new.lower() if mention == mention.lower() else new)
        return "".join(next(it) if c.isalnum() else c for c in mention)
    name = kind in ("given", "surname") or kind.startswith("forename")
    if (name or kind == "email") and mention.isupper():
        return new.upper()
    if name:
        return new[0].upper() + new[1:]
    if kind == "email" and len(new) == len(mention):
        return "".join(n.upper() if c.isupper() else n for c, n in zip(mention, new, strict=True))
    return new


def rewrite(text: str | None, key: bytes, attempts: dict[tuple[str, str], int]) -> tuple[str | None, list[Mention]]:
    found = find(text)
    if not found:
        return text, found
    out, at = [], 0
    for m in found:
        out += [text[at : m.start], dress(text[m.start : m.end], m.kind, surrogate(m.kind, m.value, key, attempts.get((m.kind, m.value), 0)))]
        at = m.end
    return "".join([*out, text[at:]]), found


def _drawn(entities: DataFrame, key: bytes) -> DataFrame:
    """kind, value, attempt with the surrogate drawn."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [surrogate(k, v, key, a) for k, v, a in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(new, pa.string())], names=["kind", "value", "attempt", "new"])

    return entities.mapInArrow(run, "kind string, value string, attempt int, new string")


def exceptions(entities: DataFrame, key: bytes) -> DataFrame:
    """kind, value, attempt of the entities whose first surrogate was taken; given names come from a permutation and have none."""
    now = materialise(_drawn(entities.where("kind != 'given'").select("kind", "value", F.lit(0).alias("attempt")), key), "drawn")
    real = entities.select(F.col("kind").alias("k"), F.col("value").alias("v"))
    for _ in range(MAX_ATTEMPTS):
        owner = now.groupBy("kind", "new").agg(F.min(F.struct("attempt", "value")).alias("o"), F.count(F.lit(1)).alias("n"))
        shared = owner.where("n > 1").select(F.col("kind").alias("k"), F.col("new").alias("w"), F.col("o.value").alias("keeps"))
        taken = now.join(shared, (F.col("kind") == F.col("k")) & (F.col("new") == F.col("w"))).where("value != keeps").select("kind", "value")
        real_too = now.join(real, (F.col("kind") == F.col("k")) & (F.col("new") == F.col("v")), "left_semi").select("kind", "value")
        again = materialise(taken.unionAll(real_too).distinct().withColumn("again", F.lit(1)), "again")
        if again.isEmpty():
            break
        attempts = now.join(again, ["kind", "value"], "left").select("kind", "value", (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt"))
        now = materialise(_drawn(attempts, key), "drawn")
    else:
        raise RuntimeError(f"surrogates still meet after {MAX_ATTEMPTS} draws")
    return now.where("attempt > 0").select("kind", "value", "attempt")


def replace(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """``docs`` with the text rewritten and ``entities`` (array of kinds, one per mention) added."""
    text = F.col(text_col).cast("string")
    marks = [F.xxhash64(text).alias("x1"), F.xxhash64(F.lit(1), text).alias("x2")]

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = {(x1, x2, m.kind, m.value) for x1, x2, t in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True) for m in find(t)}
            cols = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)],
                                             names=["x1", "x2", "kind", "value"])

    mentions = materialise(docs.select(*marks, text.alias("t")).mapInArrow(seen, "x1 long, x2 long, kind string, value string"), "mentions")
    odd = materialise(exceptions(mentions.select("kind", "value").distinct(), key), "exceptions")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), text.alias("t"), *marks)
    if odd.isEmpty():
        whole = whole.select("doc", "t", F.array().cast("array<struct<kind:string,value:string,attempt:int>>").alias("odd"))
    else:
        per_text = mentions.join(odd, ["kind", "value"]).distinct().groupBy("x1", "x2").agg(F.collect_list(F.struct("kind", "value", "attempt")).alias("odd"))
        whole = whole.join(materialise(per_text, "per-text"), ["x1", "x2"], "left").select("doc", "t", "odd")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new, kinds = [], []
            for t, odd_ones in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                text_, found = rewrite(t, key, {(o["kind"], o["value"]): o["attempt"] for o in odd_ones or ()})
                new.append(text_)
                kinds.append([m.kind.partition("_")[0] for m in found])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(new, pa.string()), pa.array(kinds, pa.list_(pa.string()))], names=["doc", "_new", "_kinds"])

    kind = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")).schema["doc"].dataType.simpleString()
    out = whole.mapInArrow(run, f"doc {kind}, _new string, _kinds array<string>")
    others = [F.col(f"doc.`{c}`").alias(c) for c in docs.columns if c not in (text_col, "entities")]
    return out.select(*others, F.col("_new").alias(text_col), F.col("_kinds").alias("entities"))
