"""Operator 8, URL filters: pattern rules found through their rarest literal token.

Every rule names literal tokens (runs of letters and digits between separators) that any matching URL must hold. How often those
tokens occur in the URLs at hand is counted first; each rule is then filed under its rarest token. A URL is cut into tokens,
fetches the rules filed under them, and only those rules run their regular expression, which is compiled when first needed. Rules without a bounded token are tried
on every URL.

Two kinds of rule: *site* rules (host and path prefix, subdomains included; the longest wins) decide first; URLs without one get the
*pattern* rules (``*`` any text, ``^`` a separator or an end); a matching pattern blocks or allows, blocking first, else the default holds.

Defined results: a null URL, or one without ``://``, has an empty host and path, and no site rule; patterns see an empty text for
null; rules of equal length decide by verdict (block first), then name; repeated rows are judged each; an empty rule list leaves
the default. Letters A-Z of hosts are lower-cased, paths are kept; patterns see the URL in lower case (A-Z). The rule list is
given by the caller and held in every task; ``MAX_RULES`` bounds it.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_RULES = 1_000_000
TOKEN = re.compile(r"[A-Za-z0-9]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


@dataclass(frozen=True)
class SiteRule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path

    def regex(self) -> str:
        return rf"\A(?:[^/]*\.)?{re.escape(self.host)}{re.escape(self.path)}"

    def tokens(self) -> list[str]:
        """Host labels, and path tokens that a separator closes."""
        tail = self.path if not self.path or not self.path[-1].isalnum() else TOKEN.sub("", self.path[::-1], count=1)[::-1]
        return TOKEN.findall(self.host + " " * (self.path[:1].isalnum()) + tail) if self.path and not self.path[0].isalnum() else []


@dataclass(frozen=True)
class PatternRule:
    verdict: str
    pattern: str

    def regex(self, end: str = r"\Z") -> str:
        sep = {True: r"(?:^|[^a-z0-9])", False: rf"(?:[^a-z0-9]|{end})"}
        out = []
        for i, ch in enumerate(self.pattern):
            out.append(sep[i == 0] if ch == "^" else "(?s:.*)" if ch == "*" else re.escape(ch))
        return "".join(out)

    def tokens(self) -> list[str]:
        """Literal runs with no wildcard and no open end beside them."""
        p = self.pattern
        return [m.group() for m in TOKEN.finditer(p) if m.start() > 0 and p[m.start() - 1] != "*" and m.end() < len(p) and p[m.end()] != "*"]


class RuleIndex:
    """Rules filed under their rarest token."""

    def __init__(self, rules: Sequence, counts: dict[str, int]):
        self.filed: dict[str, list[int]] = {}
        self.always: list[int] = []
        self.rules = rules
        self.compiled: dict[int, re.Pattern] = {}
        for k, r in enumerate(rules):
            tokens = r.tokens()
            if tokens:
                self.filed.setdefault(min(tokens, key=lambda t: (counts.get(t, 0), t)), []).append(k)
            else:
                self.always.append(k)

    def matches(self, text: str) -> list[int]:
        found = list(self.always)
        for t in set(TOKEN.findall(text)):
            found += self.filed.get(t, ())
        return [k for k in found if self.regex(k).search(text)]

    def regex(self, k: int) -> re.Pattern:
        """A rule's expression, compiled when the first URL fetches the rule."""
        if k not in self.compiled:
            self.compiled[k] = re.compile(self.rules[k].regex())
        return self.compiled[k]


_HELD: dict[str, tuple[RuleIndex, RuleIndex]] = {}


def _indexes(key: str, sites: Sequence, patterns: Sequence, counts: dict[str, int]) -> tuple[RuleIndex, RuleIndex]:
    """The indexes of one judgement, built once per worker process; those of an earlier judgement go."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = RuleIndex(sites, counts), RuleIndex(patterns, counts)
    return _HELD[key]


def split_url(url: str | None) -> tuple[str, str]:
    """Lower-cased host and the path; both empty without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    cut = re.search(r"[/?#]", rest)
    host, tail = (rest, "") if cut is None else (rest[: cut.start()], rest[cut.start() :])
    return host.translate(_LOWER), re.split(r"[?#]", tail, maxsplit=1)[0]


def token_counts(urls: DataFrame, wanted: frozenset[str], url_col: str) -> dict[str, int]:
    """In how many URLs each wanted token occurs; as many rows as wanted tokens reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for b in batches:
            for url in b.column(0).to_pylist():
                seen.update(wanted.intersection(TOKEN.findall("".join(split_url(url)))) | wanted.intersection(TOKEN.findall((url or "").translate(_LOWER))))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["token", "n"])

    rows = urls.select(F.col(url_col).cast("string")).mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {r.token: r.n for r in rows}


def judge_urls(pages: DataFrame, sites: Sequence[SiteRule], patterns: Sequence[PatternRule] = (), default: str = "allow",
               id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule (the site rule, else null), verdict, pattern (the pattern that decided, else null)."""
    if len(sites) + len(patterns) > MAX_RULES:
        raise ValueError(f"{len(sites) + len(patterns)} rules; at most {MAX_RULES} are held in a task")
    sites = sorted(sites, key=lambda r: (-len(r.name), r.verdict != "block", r.name))
    patterns = sorted(patterns, key=lambda r: (r.verdict != "block", r.pattern))
    counts = token_counts(pages, frozenset(t for r in (*sites, *patterns) for t in r.tokens()), url_col)
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_site, by_pattern = _indexes(key, sites, patterns, counts)
        for b in batches:
            cols: tuple[list, ...] = ([], [], [], [], [])
            for url in b.column(1).to_pylist():
                host, path = split_url(url)
                site = min(by_site.matches(host + path), default=None)
                other = min(by_pattern.matches((url or "").translate(_LOWER)), default=None) if site is None else None
                verdict = sites[site].verdict if site is not None else patterns[other].verdict if other is not None else default
                for col, x in zip(cols, (host, path, None if site is None else sites[site].name, verdict,
                                         None if other is None else patterns[other].pattern), strict=True):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.string()) for c in cols)],
                                             names=["page_id", "host", "path", "rule", "verdict", "pattern"])

    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    return base.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, pattern string")
