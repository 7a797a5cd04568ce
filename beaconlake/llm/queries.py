"""Registered queries of this subpackage and their DuckDB checks, over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, language_id, license_scan, line_dedup, mixing, near_dedup, phrase_mining, prefix_trie, quality_classifier, quality_rules, toxicity, url_filters
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_line_dedup(spark, sf_dir):
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    removed = F.aggregate("_removed", F.lit(0).cast("bigint"), lambda n, r: n + r["n_lines"])
    longest = F.coalesce(F.array_max(F.transform("_removed", lambda r: r["n_lines"])), F.lit(0)).cast("bigint")
    return out.select("doc_id", removed.alias("n_removed"), F.size("_removed").alias("n_runs"), longest.alias("longest_run"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


@query
def op2_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op3_bpe(spark, sf_dir):
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op4_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.score(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


@query
def op5_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.fit(docs))


@query
def op6_mixing(spark, sf_dir):
    return mixing.mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@query
def op7_quality_rules(spark, sf_dir):
    return quality_rules.quality_report(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op8_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


ORACLES["op8_exact_dedup"] = """
WITH d AS (SELECT doc_id, sha256(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, MAX(doc_id) AS keep_id, COUNT(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)"""


@query
def op9_url_filters(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("page_id")).agg((F.min("quality") == 0).alias("blocked"))
    return url_filters.url_verdicts(pages, pages.join(labels, "page_id").select("url", "blocked"))


@query
def op10_license_scan(spark, sf_dir):
    return license_scan.fit_and_scan(table(spark, sf_dir, "documents"))


@query
def op11_phrase_mining(spark, sf_dir):
    return phrase_mining.collocations(table(spark, sf_dir, "documents"))


ORACLES["op11_phrase_mining"] = r"""
WITH p AS (SELECT COALESCE(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
n AS (SELECT lang, CAST(SUM(len(ws)) AS BIGINT) AS n FROM w GROUP BY 1),
g AS (SELECT lang, 1 AS k, unnest(ws) AS phrase FROM w
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) FROM w),
f AS (SELECT lang, k, phrase, COUNT(*) AS a, string_split(phrase, ' ') AS ws FROM g GROUP BY 1, 2, 3 HAVING COUNT(*) >= 10),
c AS (SELECT lang, phrase, k, a, 1 AS cut, ws[1] AS x, array_to_string(ws[2:], ' ') AS y FROM f WHERE k > 1
  UNION ALL SELECT lang, phrase, k, a, 2, ws[1] || ' ' || ws[2], ws[3] FROM f WHERE k = 3),
s AS (SELECT c.lang, c.phrase, c.k, c.a, c.cut, x.a AS l, y.a AS r, CAST(c.a::HUGEINT * c.a * 1000000 // (x.a::HUGEINT * y.a) AS BIGINT) AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.phrase = c.x JOIN f y ON y.lang = c.lang AND y.phrase = c.y),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (SELECT lang, phrase, MAX(a) AS longer FROM (SELECT lang, ws[1] || ' ' || ws[2] AS phrase, a FROM f WHERE k = 3 UNION ALL SELECT lang, ws[2] || ' ' || ws[3], a FROM f WHERE k = 3) GROUP BY 1, 2),
t AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank
  FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE b.k = 3 OR o.longer IS NULL OR 100 * o.longer < 50 * b.a)
SELECT t.lang, rank, phrase, a, l, r, n, score FROM t JOIN n ON n.lang = t.lang WHERE rank <= 2000"""


@query
def op12_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query
def op13_prefix_trie(spark, sf_dir):
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


ORACLES["op13_prefix_trie"] = r"""
WITH RECURSIVE k(i, r, x) AS (SELECT i::BIGINT, 0, i::BIGINT FROM range(256) t(i) UNION ALL SELECT i, r + 1, xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END) FROM k WHERE r < 8),
ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
crc(c, s, i, x) AS (SELECT c, CAST(c AS VARCHAR), 1, 4294967295::BIGINT FROM ids
  UNION ALL SELECT c, s, crc.i + 1, xor(crc.x >> 8, k.x) FROM crc JOIN k ON k.r = 8 AND k.i = xor(crc.x, ascii(substr(s, crc.i, 1))) & 255 WHERE crc.i <= length(s)),
h AS (SELECT c, xor(x, 4294967295) % 4 AS h, c - c % 20 AS base FROM crc WHERE i = length(s) + 1),
o AS (SELECT conv_id AS c, COALESCE(role, '') AS role, COALESCE(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p FROM conversations WHERE conv_id IS NOT NULL),
r AS (SELECT h.c, 0 AS part, o.p, o.role, o.text FROM h JOIN o ON o.c = h.base AND o.p <= h.h UNION ALL SELECT h.c, 1, o.p, o.role, o.text FROM h JOIN o ON o.c = h.c AND o.p > h.h),
q AS (SELECT c, list({'role': role, 'text': text} ORDER BY part, p) AS l FROM r GROUP BY c),
l AS (SELECT h.c, COALESCE(q.l, []) AS l FROM h LEFT JOIN q ON q.c = h.c),
m AS (SELECT c, l, unnest(range(len(l) + 1)) AS d FROM l),
n AS (SELECT sha256(CAST(l[1:d] AS VARCHAR) || d) AS key, d, min(c) AS conv_id, count(*) AS n_convs, any_value(l[1:d]) AS l,
  COALESCE(string_agg(CASE WHEN len(l) = d THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '') AS ids FROM m GROUP BY l[1:d], d),
e AS (SELECT n.*, CASE WHEN d > 0 THEN sha256(CAST(l[1:d - 1] AS VARCHAR) || (d - 1)) END AS up, CASE WHEN d > 0 THEN (n_convs - 1) * len(regexp_extract_all(l[d].text, '[^\x20\x09-\x0D]+')) ELSE 0 END AS own FROM n),
ch AS (SELECT up, count(*) AS n FROM e GROUP BY up),
a AS (SELECT e.own, CASE WHEN ch.n IS NULL THEN 1 ELSE 0 END AS leaf, unnest(list_transform(range(e.d + 1), lambda i: sha256(CAST(e.l[1:i] AS VARCHAR) || i))) AS top FROM e LEFT JOIN ch ON ch.up = e.key),
s AS (SELECT top, sum(own) AS saved, sum(leaf) AS leaves FROM a GROUP BY top)
SELECT e.conv_id, e.d AS depth, p.conv_id AS parent_conv_id, e.n_convs, COALESCE(ch.n, 0) AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(e.ids) AS ends_sha256
FROM e LEFT JOIN e p ON p.key = e.up LEFT JOIN ch ON ch.up = e.key JOIN s ON s.top = e.key"""
