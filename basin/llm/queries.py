"""Registered queries of the training-data operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import functions as F

from basin.llm import (alignment, ann, bpe, byte_bpe, embedding_dedup, mixing, periodic_runs, pii, quality, simhash, toxicity,
                       url_filter)
from basin.llm import token_counts as tc
from basin.llm._common import table

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql.strip()
        return fn
    return register


def vocabulary(name: str) -> str:
    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def bpe_digests(docs):
    """Ids and decoded text of every document, as counts and SHA-256 digests."""
    decoded = bpe.encode_decode(docs, vocabulary("word_bpe_49k.json"))
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                          F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op1_bpe")
def op1_bpe(spark, sf_dir):
    return bpe_digests(table(spark, sf_dir, "documents"))


@query("op8_token_counts")
def op8_token_counts(spark, sf_dir):
    counts = tc.token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), budget=512)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"),
                         "within_budget_chars")


@query("op7_toxicity")
def op7_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_simhash")
def op10_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Labelled domains and the token shares wanted of them.
TARGETS = {"clean": 0.93, "low": 0.05, "toxic": 0.02}
PIPELINE_TARGETS = {"clean": 0.95, "low": 0.05}


def labelled_domains(labels):
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean")
    return labels.select("doc_id", domain.alias("domain")).filter("domain IS NOT NULL")


def labelled_quality(labels):
    """Domains of a corpus that toxic documents have left already."""
    domain = F.when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean")
    return labels.select("doc_id", domain.alias("domain")).filter("domain IS NOT NULL")


@query("op5_mixing")
def op5_mixing(spark, sf_dir):
    return mixing.document_rates(table(spark, sf_dir, "documents"),
                                 labelled_domains(table(spark, sf_dir, "labels")), TARGETS)


#: The key of the surrogates; a deployment passes its own secret.
PII_KEY = "basin-surrogates"


@query("op6_pii")
def op6_pii(spark, sf_dir):
    return pii.replace_pii(table(spark, sf_dir, "documents"), PII_KEY)


@query("op9_embedding_dedup", """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
fit AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM fit a JOIN fit b ON a.label = b.label AND a.vec_id <> b.vec_id
    AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN least ON least.a = vec_id LEFT JOIN degree ON degree.a = vec_id""")
def op9_embedding_dedup(spark, sf_dir):
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)


@query("op3_ann")
def op3_ann(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query("op4_quality")
def op4_quality(spark, sf_dir):
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Fixed values of the query: (verdict, host, path).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]


@query("op2_url_filter", r"""
WITH RECURSIVE rules(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
  ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
parts AS (SELECT page_id, html, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)', 1), '') AS query FROM pages),
tags AS (SELECT host, path, query, unnest(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?(-->|$)', ' ', 'g'),
    '(?is)<(?:link|meta)\b(?:[^>"'']|"[^"]*"|''[^'']*'')*>')) AS tag FROM parts WHERE host <> ''),
named AS (SELECT host, path, query, regexp_matches(tag, '(?i)^<link') AS is_link,
    map_from_entries(list_transform(list_reverse(regexp_extract_all(tag, '(?is)[\s"''][a-z-]+\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s"''>]+)')),
      lambda x: {'k': lower(regexp_extract(x, '(?is)^.([a-z-]+)', 1)),
        'v': trim(regexp_replace(regexp_extract(x, '(?is)=\s*(.*)$', 1), '^["'']|["'']$', '', 'g'), E' \t\n\r')})) AS attr FROM tags),
hrefs AS (SELECT host, path, query, regexp_replace(CASE
    WHEN is_link AND list_contains(regexp_split_to_array(lower(attr['rel']), '\s+'), 'canonical') THEN attr['href']
    WHEN NOT is_link AND lower(attr['http-equiv']) = 'refresh'
      THEN trim(regexp_extract(attr['content'], '(?is)\burl\s*=\s*["'']?\s*([^"'']*)', 1)) END,
    '(?i)&(?:amp|#38|#x26);', '&', 'g') AS t FROM named),
cut AS (SELECT *, regexp_extract(t, '(?s)^([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?',
    ['scheme', 'authority', 'p', 'q']) AS r FROM hrefs WHERE t <> ''),
joined AS (SELECT host, path, query, CASE WHEN r.authority <> '' THEN lower(substr(r.authority, 3)) ELSE host END AS th,
    CASE WHEN r.authority <> '' OR starts_with(r.p, '/') THEN r.p WHEN r.p = '' THEN path
      WHEN path = '' THEN '/' || r.p ELSE regexp_replace(path, '[^/]*$', '') || r.p END AS tp,
    CASE WHEN r.authority = '' AND r.p = '' AND r.q = '' THEN query ELSE r.q END AS tq
  FROM cut WHERE r.scheme = '' OR r.authority <> ''),
sides AS (SELECT DISTINCT host, path, query, th, tp, tq FROM joined WHERE th <> ''),
paths AS (SELECT path AS raw FROM parts UNION SELECT tp FROM sides),
steps AS (SELECT raw, list_transform(string_split(raw || CASE WHEN regexp_matches(raw, '(^|/)\.\.?$') THEN '/' ELSE '' END, '/'),
    lambda x: [x]) AS s FROM paths),
clean AS (SELECT raw, CASE WHEN raw = '' THEN '/' ELSE array_to_string(list_reduce(s, lambda a, x: CASE
    WHEN x[1] = '.' THEN a WHEN x[1] = '..' THEN a[1:greatest(len(a) - 1, 1)] ELSE list_concat(a, x) END), '/') END AS p FROM steps),
links AS (SELECT DISTINCT host || c.p || query AS a, th || d.p || tq AS b FROM sides
  JOIN clean c ON c.raw = path JOIN clean d ON d.raw = tp),
pairs AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
nodes AS (SELECT DISTINCT a AS node FROM pairs),
bad AS (SELECT node FROM (SELECT node, (SELECT r.verdict FROM rules r
    WHERE (regexp_extract(node, '^[^/?]*') = r.h OR ends_with(regexp_extract(node, '^[^/?]*'), '.' || r.h))
      AND starts_with(regexp_extract(node, '^[^/?]*([^?]*)', 1), r.p)
    ORDER BY length(r.h || r.p) DESC, length(r.h) DESC LIMIT 1) AS v FROM nodes) WHERE v = 'block'),
tainted(node) AS (SELECT node FROM bad UNION SELECT pairs.b FROM tainted JOIN pairs ON pairs.a = tainted.node),
ruled AS (SELECT page_id, host, path, host || p || query AS node, (SELECT {'rule': r.h || r.p, 'verdict': r.verdict}
    FROM rules r WHERE (host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.p)
    ORDER BY length(r.h || r.p) DESC, length(r.h) DESC LIMIT 1) AS r FROM parts JOIN clean ON clean.raw = path)
SELECT page_id, host, path, r.rule AS rule,
  CASE WHEN r.verdict IS NOT NULL THEN r.verdict WHEN host <> '' AND node IN (SELECT node FROM tainted) THEN 'block'
    ELSE 'allow' END AS verdict
FROM ruled""")
def op2_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"), RULES)


def planted_runs(docs):
    """Documents whose id's CRC32 is divisible by ten repeat part of their words, as the query is defined."""
    h = F.crc32(F.col("doc_id").cast("string"))
    picked = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(
        h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("words"))
    sized = picked.withColumn("n", F.size("words")).withColumn("a", F.expr("CASE WHEN n > 0 THEN CAST(g % n AS INT) END"))
    cut = sized.withColumn("p", F.expr("CAST(1 + floor((n - a) / (3 + g % 8)) AS INT)"))
    text = F.expr("""CASE WHEN n > 0 THEN array_join(concat(slice(words, 1, a),
        slice(flatten(array_repeat(slice(words, a + 1, p), CAST(ceil((n - a) / p) AS INT))), 1, n - a)), ' ') ELSE text END""")
    return cut.select("doc_id", text.alias("text"))


@query("op11_periodic_runs")
def op11_periodic_runs(spark, sf_dir):
    return run_digests(periodic_runs.periodic_runs(planted_runs(table(spark, sf_dir, "documents"))))


def run_digests(found):
    """Number of runs, the one with the greatest exponent, digests of all runs and of the collapsed text."""
    top = F.expr(f"""aggregate(runs, CAST(NULL AS {periodic_runs.RUNS[6:-1]}),
        (m, r) -> CASE WHEN m IS NULL OR r.length * m.period > m.length * r.period THEN r ELSE m END)""")
    listing = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(
        ",", *[r[k].cast("string") for k in ("start", "length", "period")]), F.lit("\n"))))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"),
                        F.sha2(listing, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")
                        ).select("doc_id", "n_runs", "top.start", "top.length", "top.period",
                                 F.expr("top.length * 1000 div top.period").alias("exponent_milli"),
                                 "runs_sha256", "collapsed_sha256")


@query("op13_byte_bpe")
def op13_byte_bpe(spark, sf_dir):
    return byte_bpe_digests(table(spark, sf_dir, "documents"))


def byte_bpe_digests(docs):
    """Ids and decoded bytes of every document, as counts and SHA-256 digests."""
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    decoded = byte_bpe.decode(byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                          F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op12_alignment")
def op12_alignment(spark, sf_dir):
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    found = alignment.link_statistics(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), model,
                                      public_tokenizers.PATTERN, summary=lambda g: hashlib.sha256(g).hexdigest())
    return found.withColumnRenamed("groups", "groups_sha256")
