"""The queries of these operators over the synthetic tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import find_leaks
from .jaccard import jaccard_components
from .langid import identify
from .packing import pack_documents
from .perplexity import classify
from .revisits import resolve_revisits
from .shared import table
from .substring import dedup_substrings
from .templates import BLANK, DEPTH, DIGITS, MAX_BRANCH, MIN_CONSTANT, MIN_DOCS, dedup_lines
from .topk import exact_top_k
from .urlfilter import filter_urls

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.expr("crc32(cast(doc_id as string)) % 4 = 2"), F.lit(False))
    learn = F.expr("crc32(cast(doc_id as string)) % 4 <> 2")
    return identify(table(spark, sf_dir, "documents"), learn, keep={"held_out": held_out})


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_substrings(table(spark, sf_dir, "documents"), with_text=False)
    return found.select("doc_id", F.explode("removed").alias("r")).select("doc_id", "r.first_doc_id", "r.start", "r.length", "r.chunks")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), RULES)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def captures(pages: DataFrame) -> DataFrame:
    """Web captures made of `pages`: a full response each, a revisit after it, and for every fifth an earlier one."""
    p, digest = F.col("page_id"), F.md5("html")
    rows = pages.select("page_id", "url", digest.alias("digest"))
    modified = F.when(p % 3 != 0, F.concat(F.lit("lm"), p.cast("string")))
    digest = F.col("digest")
    text = lambda c: c.cast("string")
    full = F.struct((4 * p).alias("record_id"), (10 * p).alias("ts"), F.lit(200).alias("status"), digest.alias("etag"), modified.alias("last_modified"), digest.alias("payload_digest"), F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("date"), text(10 * p)).alias("headers"))
    tag = F.when(p % 7 == 0, F.lit("other")).when(p % 11 != 0, digest)
    after = F.struct((4 * p + 1).alias("record_id"), (10 * p + 5).alias("ts"), F.lit(304).alias("status"), tag.alias("etag"), F.lit(None).cast("string").alias("last_modified"), F.lit(None).cast("string").alias("payload_digest"), F.create_map(F.lit("date"), text(10 * p + 5), F.lit("set-cookie"), F.lit("x")).alias("headers"))
    early = F.struct((4 * p + 2).alias("record_id"), (10 * p - 15).alias("ts"), F.lit(304).alias("status"), digest.alias("etag"), F.lit(None).cast("string").alias("last_modified"), F.lit(None).cast("string").alias("payload_digest"), F.create_map(F.lit("date"), text(10 * p - 15)).alias("headers"))
    each = F.when(p % 5 == 0, F.array(full, after, early)).otherwise(F.array(full, after))
    return rows.select("url", F.explode(each).alias("c")).select("url", "c.*")


def op7_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve_revisits(captures(table(spark, sf_dir, "pages")))
    entries = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return found.select("record_id", "canonical", "outcome", "refers_to", "etag", "last_modified", "payload_digest", F.array_join(entries, ";").alias("headers"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id")
    return classify(table(spark, sf_dir, "documents"), trusted)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", F.md5("text").alias("text_md5"), F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_top_k, op2_language_id, op3_substring_dedup, op4_url_filter, op5_jaccard_join, op6_best_fit_packing, op7_revisit_resolution, op8_quality_classifier, op9_line_dedup, op10_decontaminate)}

_OP1 = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.r <> b.r AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT CAST(query_id AS BIGINT) AS query_id, CAST(rank AS INTEGER) AS rank, CAST(vec_id AS BIGINT) AS vec_id, score FROM k WHERE rank <= 5
"""

_OP4 = r"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(rest, '(?s)^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
b AS (SELECT page_id, host, path, first(h || p ORDER BY length(h || p) DESC, length(h) DESC) AS rule, first(v ORDER BY length(h || p) DESC, length(h) DESC) AS v
  FROM s JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL)
SELECT s.page_id, s.host, s.path, b.rule, coalesce(b.v, 'allow') AS verdict FROM s LEFT JOIN (SELECT DISTINCT * FROM b) b
ON s.page_id IS NOT DISTINCT FROM b.page_id AND s.host = b.host AND s.path = b.path
"""

_OP5 = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS t FROM documents WHERE text IS NOT NULL),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(t) >= 5 THEN list_transform(range(1, len(t) - 3), lambda i: list_aggregate(t[i:i+4], 'string_agg', ' ')) WHEN len(t) > 0 THEN [list_aggregate(t, 'string_agg', ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.m, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) m ON m.a = d.doc_id
"""

_OP7 = r"""
WITH p AS (SELECT page_id, url, md5(html) AS digest FROM pages),
c AS (
  SELECT 4 * page_id AS record_id, url, 10 * page_id AS ts, 200 AS status, digest AS etag, CASE WHEN page_id % 3 <> 0 THEN 'lm' || page_id END AS last_modified, digest AS payload_digest FROM p
  UNION ALL SELECT 4 * page_id + 1, url, 10 * page_id + 5, 304, CASE WHEN page_id % 7 = 0 THEN 'other' WHEN page_id % 11 <> 0 THEN digest END, NULL, NULL FROM p
  UNION ALL SELECT 4 * page_id + 2, url, 10 * page_id - 15, 304, digest, NULL, NULL FROM p WHERE page_id % 5 = 0),
u AS (SELECT *, regexp_replace(regexp_replace(url, '(?s)#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM c),
k AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), ':(80|443)$', ''), '^(www|m)\.', '') AS host,
  regexp_replace(regexp_extract(bare, '(?s)^[^/?]*([^?]*)', 1), '/+$', '') AS path,
  list_sort(list_filter(string_split(regexp_extract(bare, '(?s)^[^?]*\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))) AS kept FROM u),
n AS (SELECT *, host || path || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical FROM k),
a AS (SELECT r.*, f.record_id AS f_id, f.ts AS f_ts, f.etag AS f_etag, f.last_modified AS f_lm, f.payload_digest AS f_digest,
    CASE WHEN f.record_id IS NULL THEN 'missing' WHEN r.etag IS NULL THEN 'no_validator' WHEN r.etag <> f.etag THEN 'mismatch' ELSE 'resolved' END AS outcome
  FROM (SELECT * FROM n WHERE status = 304) r ASOF LEFT JOIN (SELECT * FROM n WHERE status = 200) f ON r.canonical = f.canonical AND r.ts > f.ts)
SELECT record_id, canonical, 'full' AS outcome, CAST(NULL AS BIGINT) AS refers_to, etag, last_modified, payload_digest, 'content-type=text/html;date=' || ts AS headers FROM n WHERE status = 200
UNION ALL SELECT record_id, canonical, outcome, CASE WHEN outcome = 'resolved' THEN f_id END, etag, CASE WHEN outcome = 'resolved' THEN f_lm END, CASE WHEN outcome = 'resolved' THEN f_digest END,
  CASE WHEN outcome = 'resolved' THEN 'content-type=text/html;date=' || ts WHEN record_id % 4 = 1 THEN 'date=' || ts || ';set-cookie=x' ELSE 'date=' || ts END FROM a
"""

_OP9 = rf"""
WITH l AS (SELECT doc_id, md5(coalesce(text, '')) AS h, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, h, pos, regexp_replace(trim(regexp_replace(line, '{BLANK}', ' ', 'g')), '{DIGITS}', '<*>', 'g') AS masked FROM l),
t AS (SELECT *, string_split(masked, ' ') AS tok FROM k WHERE masked <> ''),
f AS (SELECT *, len(tok) || ' ' || array_to_string(tok[1:{DEPTH}], ' ') AS leaf FROM t),
o AS (SELECT leaf FROM f GROUP BY leaf HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
g AS (SELECT f.* FROM f SEMI JOIN o USING (leaf)),
e AS (SELECT DISTINCT leaf, unnest(tok) AS token, generate_subscripts(tok, 1) AS i FROM (SELECT DISTINCT leaf, tok FROM g)),
v AS (SELECT leaf, list(i) AS wild FROM (SELECT leaf, i FROM e WHERE i > {DEPTH} GROUP BY leaf, i HAVING count(*) > {MAX_BRANCH}) GROUP BY leaf),
x AS (SELECT g.*, list_transform(range(1, len(tok) + 1), lambda i: CASE WHEN list_contains(v.wild, i) THEN '<*>' ELSE tok[i] END) AS general, v.wild FROM g LEFT JOIN v USING (leaf)),
y AS (SELECT doc_id, h, pos, leaf, CASE WHEN wild IS NOT NULL AND len(list_filter(general, lambda z: z <> '<*>')) >= {MIN_CONSTANT} * len(tok) THEN array_to_string(general, ' ') ELSE masked END AS template FROM x),
m AS (SELECT leaf, template, min(doc_id) AS first FROM y GROUP BY ALL HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
d AS (SELECT doc_id, h, list(DISTINCT pos) AS drops FROM y JOIN m USING (leaf, template) WHERE doc_id IS DISTINCT FROM first GROUP BY ALL)
SELECT s.doc_id, md5(CASE WHEN d.drops IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(1, len(string_split(text, chr(10))) + 1), lambda i: NOT list_contains(d.drops, i)), lambda i: string_split(text, chr(10))[i]), chr(10)) END) AS text_md5,
  CAST(CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END AS BIGINT) AS n_lines, CAST(coalesce(len(d.drops), 0) AS BIGINT) AS n_dropped
FROM documents s LEFT JOIN d ON s.doc_id IS NOT DISTINCT FROM d.doc_id AND md5(coalesce(s.text, '')) = d.h
"""

ORACLES = {"op1_top_k": _OP1, "op4_url_filter": _OP4, "op5_jaccard_join": _OP5, "op7_revisit_resolution": _OP7, "op9_line_dedup": _OP9}
