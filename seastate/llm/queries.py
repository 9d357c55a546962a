"""One registered query per operator, with its DuckDB text where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_path
from . import (
    cellcodes,
    chaining,
    decontaminate,
    jaccard,
    lmscore,
    mixing,
    quality,
    resample,
    surrogates,
    tokencount,
    tokenids,
    toxicity,
    urlrules,
)
from .tables import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


def quality_sql(source: str = "documents", rules: quality.QualityRules | None = None) -> str:
    """Counts, repeated windows by window functions, repeated lines by row number; columns as the operator gives them."""
    rules = rules or quality.QualityRules()
    sizes = list(dict.fromkeys([3, *(k for k, _ in rules.ngrams)]))
    gram = lambda n: " || ' ' || ".join(["word", *(f"lead(word, {j}) OVER o" for j in range(1, n))])
    over = "".join(f" OR coalesce(d{k}, 0) > {share} * word_chars" for k, share in rules.ngrams)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM {source}),
u AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i
      FROM (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d)),
g AS (SELECT doc_id, i, word, {", ".join(f"{gram(n)} AS g{n}" for n in sizes)}
      FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT doc_id, i, length(word) AS chars,
      {", ".join(f"(g{n} IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g{n}) > 1)::INT AS t{n}" for n in sizes)} FROM g),
v AS (SELECT doc_id, chars,
      {", ".join(f"max(t{n}) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS v{n}" for n in sizes)} FROM c),
w AS (SELECT doc_id, count(*) AS n_words, sum(chars) AS word_chars, sum(v3) AS n_repeat_words,
      {", ".join(f"sum(CASE WHEN v{k} = 1 THEN chars ELSE 0 END) AS d{k}" for k, _ in rules.ngrams)} FROM v GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_dup_lines, sum(chars) AS dup_line_chars FROM (
        SELECT doc_id, length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g')) AS chars,
               row_number() OVER (PARTITION BY doc_id, line) AS copy
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
        WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')) WHERE copy > 1 GROUP BY doc_id),
m AS (SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
             coalesce(dup_line_chars, 0)::BIGINT AS dup_line_chars,
             {", ".join(f"coalesce(d{k}, 0)::BIGINT AS dup_{k}gram_chars" for k, _ in rules.ngrams)}
      FROM d LEFT JOIN w ON d.doc_id = w.doc_id LEFT JOIN l ON d.doc_id = l.doc_id),
b AS (SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND NOT (dup_line_chars > {rules.max_line_share} * word_chars
       OR n_symbols > {rules.max_symbol_share} * n_words{over.replace("coalesce(d", "(dup_").replace(", 0)", "gram_chars)")}) AS kept
FROM b"""


@query("op1_quality_rules", quality_sql())
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measure_quality(read(spark, sf_dir, "documents"))


DECONTAMINATION_SQL = r"""
WITH i AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(lower_az, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
      FROM (SELECT item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az
            FROM benchmark)),
iw AS (SELECT DISTINCT item, k, array_to_string(ws[s:s + k - 1], ' ') AS win
       FROM (SELECT item, ws, least(10, len(ws)) AS k, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS s FROM i WHERE len(ws) > 0)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
dw AS (SELECT doc_id, k, s, array_to_string(ws[s:s + k - 1], ' ') AS win
       FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM iw) WHERE len(ws) >= k)),
h AS (SELECT dw.doc_id, dw.s, dw.k, iw.item FROM dw JOIN iw ON dw.win = iw.win AND dw.k = iw.k),
p AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS j FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON d.doc_id = p.doc_id LEFT JOIN t ON d.doc_id = t.doc_id"""


@query("op9_benchmark_decontamination", DECONTAMINATION_SQL)
def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.mark_hits(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    n_hit = F.size("hits").cast("long")
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


SITE_RULES = [
    urlrules.SiteRule("allow", "com"),
    urlrules.SiteRule("block", "example.com", "/en/"),
    urlrules.SiteRule("allow", "www.example.com", "/en/"),
    urlrules.SiteRule("block", "net", "/es/"),
    urlrules.SiteRule("block", "net", "/fr/"),
]
PATTERN_RULES = [
    urlrules.PatternRule("block", p)
    for p in ("^casino^", "^cheap^pills^", "^free^bets^", "^spam^", "^adult^", "^ads^track^", "^payday^loan^", "^malware^")
]


def url_sql(sites=SITE_RULES, patterns=PATTERN_RULES) -> str:
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format
    sites = sorted(sites, key=lambda r: (-len(r.name), r.verdict != "block", r.name))
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r.name}'" for r in sites) + " END"
    said = "CASE rule " + " ".join(f"WHEN '{r.name}' THEN '{r.verdict}'" for r in sites) + " END"
    hit = "CASE " + " ".join(f"WHEN regexp_matches(low, '{r.regex(chr(92) + 'z')}') THEN '{r.pattern}'"
                             for r in sorted(patterns, key=lambda r: r.pattern)) + " END"
    return f"""
WITH s AS (SELECT page_id, coalesce(url, '') AS url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, {lower("url")} AS low, rest, regexp_extract(rest, '^[^/?#]*') AS host FROM s),
p AS (SELECT page_id, low, {lower("host")} AS host, regexp_extract(substr(rest, length(host) + 1), '^[^?#]*') AS path FROM h),
r AS (SELECT *, {rule} AS rule FROM p),
q AS (SELECT *, CASE WHEN rule IS NULL THEN {hit} END AS pattern FROM r)
SELECT page_id, host, path, rule, coalesce({said}, CASE WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, pattern FROM q"""


@query("op8_url_filters", url_sql())
def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge_urls(read(spark, sf_dir, "pages"), SITE_RULES, PATTERN_RULES)


def token_digest(docs: DataFrame) -> DataFrame:
    """Write the token files of ``docs`` into the shared folder, read them back, and give one row per document."""
    path = work_path(docs.sparkSession, "token-files")
    tokenids.write_ids(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return tokenids.read_ids(docs.sparkSession, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op10_token_id_output")
def op10_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(read(spark, sf_dir, "documents"))


@query("op4_source_mixing")
def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.copies(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source")


@query("op3_ngram_jaccard_join")
def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(read(spark, sf_dir, "documents")).drop("x1")


@query("op2_token_counts")
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op7_lm_scoring")
def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score_texts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


SURROGATE_KEY = b"demonstration key: bring your own"


@query("op5_pii_surrogates")
def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = surrogates.replace(read(spark, sf_dir, "documents").select("doc_id", "text"), SURROGATE_KEY)
    counts = [(F.size("entities") - F.size(F.array_remove("entities", t))).cast("long").alias(f"n_{t}") for t in surrogates.TYPES]
    return done.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), *counts)


@query("op6_substring_dedup")
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.summarise(*chaining.find_repeats(read(spark, sf_dir, "documents")))


RESAMPLING_SQL = r"""
WITH crc AS MATERIALIZED (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
      FROM (SELECT unnest(range(256)) AS i)),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
dw AS MATERIALIZED (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(ws) AS w FROM d) GROUP BY r, w),
bw AS MATERIALIZED (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark) GROUP BY w),
h AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
y AS (SELECT w, list_transform(range(1, length(x), 2), lambda k: 16 * (strpos('0123456789ABCDEF', substr(x, k, 1)) - 1) + strpos('0123456789ABCDEF', substr(x, k + 1, 1)) - 1) AS b FROM h),
k AS MATERIALIZED (SELECT w, xor(list_reduce(list_prepend(4294967295, b), lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1])), 4294967295) % 10000 AS bucket FROM y, crc),
s AS (SELECT bucket, sum(n) AS n FROM dw JOIN k USING (w) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS n FROM bw JOIN k USING (w) GROUP BY bucket),
g AS MATERIALIZED (SELECT bucket, floor(1000 * ln(((coalesce(t.n, 0) + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM s), 0) + 10000)::DOUBLE)
             / ((s.n + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM t), 0) + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT r, sum(n * gain)::BIGINT AS weight FROM dw JOIN k USING (w) JOIN g USING (bucket) GROUP BY r),
x AS (SELECT doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
             ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::UBIGINT AS h FROM d LEFT JOIN w ON d.r = w.r),
z AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score, n_features >= 20 AS fit FROM x),
o AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) FILTER (fit) OVER () AS n FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= 10 * n // 100 THEN place END AS rank FROM o"""


@query("op11_importance_resampling", RESAMPLING_SQL)
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("n_words")


@query("op12_toxicity")
def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def codes_sql(parts: int = cellcodes.PARTS, entries: int = cellcodes.ENTRIES, rounds: int = cellcodes.ROUNDS) -> str:
    """Every part against every entry, in doubles that hold the integers exactly; tables whose vectors have one length, a multiple of ``parts``."""
    nearest = f"""SELECT r, p, min((xx - 2 * list_inner_product(x, c) + cc) * {entries} + k) AS best FROM v JOIN {{book}} USING (p) GROUP BY r, p"""
    steps = []
    for i in range(rounds):
        steps += [f"a{i} AS MATERIALIZED ({nearest.format(book=f'c{i}')})",
                  f"m{i} AS (SELECT p, k, list(q ORDER BY j) AS c FROM (SELECT p, k, j, floor(sum(e) / count(*)) AS q FROM "
                  f"(SELECT p, best % {entries} AS k, unnest(x) AS e, generate_subscripts(x, 1) AS j FROM a{i} JOIN v USING (r, p)) GROUP BY p, k, j) GROUP BY p, k)",
                  f"c{i + 1} AS MATERIALIZED (SELECT p, k, c, list_inner_product(c, c) AS cc FROM (SELECT o.p, o.k, coalesce(m{i}.c, o.c) AS c FROM c{i} o LEFT JOIN m{i} ON m{i}.p = o.p AND m{i}.k = o.k))"]
    return f"""
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda z: floor({cellcodes.SCALE} * z::DOUBLE)) AS x FROM embeddings
      WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda z: z IS NULL OR NOT isfinite(z))) = 0),
n AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, x) AS r FROM e),
v AS MATERIALIZED (SELECT r, p, x, list_inner_product(x, x) AS xx FROM (
      SELECT r, p, x[len(x) // {parts} * p + 1:len(x) // {parts} * (p + 1)] AS x FROM n, (SELECT unnest(range({parts})) AS p))),
c0 AS MATERIALIZED (SELECT p, (r - 1)::DOUBLE AS k, x AS c, xx AS cc FROM v WHERE r <= {entries}),
{", ".join(steps)},
f AS (SELECT r, string_agg(printf('%02x', (best % {entries})::INT), '' ORDER BY p) AS code, sum(floor(best / {entries}))::BIGINT AS error FROM ({nearest.format(book=f"c{rounds}")}) GROUP BY r),
h AS (SELECT sha256(string_agg(b::BIGINT::VARCHAR, ',' ORDER BY p, k, j)) AS codebooks_sha256 FROM (SELECT p, k, unnest(c) AS b, generate_subscripts(c, 1) AS j FROM c{rounds}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM n JOIN f USING (r), h"""


@query("op13_vector_codes", codes_sql())
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = cellcodes.compress(read(spark, sf_dir, "embeddings"))
    return cellcodes.with_label_errors(codes).drop("label").withColumn("codebooks_sha256", F.lit(cellcodes.digest(books)))
