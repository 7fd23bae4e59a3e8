"""Queries of this subpackage, with DuckDB SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import format_chats
from .common import table
from .language_id import identify_languages
from .license_scan import TEMPLATES, THRESHOLD, scan_licenses
from .mixing import mix_sources
from .multi_index import approximate_top_k
from .near_dedup import near_duplicate_groups
from .packing import pack
from .suffix_dedup import repeated_spans
from .topk import exact_top_k
from .url_filter import filter_urls

#: Entries of op8's query.
BLOCK = ["spam-farm.example.org", "casino.example.com", "tionsh.example.net/de", "example.net/fr", "m.tiontion.example.com"]
ALLOW = ["blog.tionsh.example.net", "m.tiontion.example.com/en", "example.org"]


#: Searches take every vector whose id this number divides as a query, against all vectors.
QUERY_EVERY = 50


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings")
    return exact_top_k(embeddings, queries=embeddings.where(F.col("vec_id") % QUERY_EVERY == 0))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(table(spark, sf_dir, "documents"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), columns=["doc_id", "source"])


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"), embedded=True)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), ALLOW, BLOCK)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op10_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings")
    return approximate_top_k(embeddings, queries=embeddings.where(F.col("vec_id") % QUERY_EVERY == 0))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_exact_top_k,
        op2_simhash_near_dedup,
        op3_suffix_array_dedup,
        op4_source_mixing,
        op5_chat_formatting,
        op6_license_scan,
        op7_language_id,
        op8_url_filter,
        op9_best_fit_packing,
        op10_inverted_multi_index,
    )
}

SQL: dict[str, str] = {}

SQL["op3_suffix_array_dedup"] = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(text, '[^\x00-\x20]+') AS w FROM documents
), spots AS (
  SELECT doc_id, w, unnest(range(len(w) - 49)) AS pos FROM words WHERE len(w) >= 50
), windows AS (
  SELECT doc_id, pos, md5(array_to_string(w[pos + 1 : pos + 50], ' ')) AS name FROM spots
), ranked AS (
  SELECT doc_id, pos, count(*) OVER (PARTITION BY name) AS n,
         row_number() OVER (PARTITION BY name ORDER BY doc_id, pos) > 1 AS later
  FROM windows
), marked AS (
  SELECT doc_id, pos, later,
         CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id, later ORDER BY pos) + 50 THEN 0 ELSE 1 END AS head
  FROM ranked WHERE n > 1
), runs AS (
  SELECT *, sum(head) OVER (PARTITION BY doc_id, later ORDER BY pos) AS run FROM marked
)
SELECT doc_id, later, CAST(min(pos) AS INTEGER) AS start_token, CAST(max(pos) + 50 AS INTEGER) AS end_token
FROM runs GROUP BY doc_id, later, run
"""

SQL["op4_source_mixing"] = """
WITH rows AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN 'null' ELSE '=' || source END AS s, coalesce(length(text), 0) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) % 4096 AS bucket
  FROM documents
), sizes AS (
  SELECT s, CAST(sum(size) AS BIGINT) AS n FROM rows GROUP BY s
), whole AS (
  SELECT count(*)::DOUBLE AS sources, sum(n)::DOUBLE AS total FROM sizes
), each AS (
  SELECT s, CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE / sources * total / n::DOUBLE END AS e,
         CAST('0x' || substr(md5('17:' || s), 1, 15) AS HUGEINT) * 4 AS shift
  FROM sizes, whole
), rates AS (
  SELECT s, CAST(floor(e) AS BIGINT) AS whole_copies, CAST(floor((e - floor(e)) * 4611686018427387904::DOUBLE) AS HUGEINT) AS part, shift FROM each
), placed AS (
  SELECT doc_id, source, whole_copies, part, shift, CAST(row_number() OVER (PARTITION BY s ORDER BY bucket, doc_id) AS HUGEINT) AS n FROM rows JOIN rates USING (s)
), drawn AS (
  SELECT doc_id, source, CAST(whole_copies + (shift + part * n) // 4611686018427387904 - (shift + part * (n - 1)) // 4611686018427387904 AS BIGINT) AS copies FROM placed
)
SELECT doc_id, source, unnest(range(1, copies + 1)) AS copy_no FROM drawn WHERE copies > 0
"""

SQL["op1_exact_top_k"] = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_distance(a.e, b.e) AS d
  FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS n FROM pairs
)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, round(d * d, 6) AS distance FROM ranked WHERE n <= 10
"""

SQL["op5_chat_formatting"] = """
WITH turns AS (
  SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL
), chats AS (
  SELECT conv_id, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS c
  FROM turns GROUP BY conv_id
), kept AS (
  SELECT conv_id, c FROM chats AS x
  WHERE NOT EXISTS (
    SELECT 1 FROM chats AS y
    WHERE y.c[1] IS NOT DISTINCT FROM x.c[1] AND y.conv_id <> x.conv_id AND len(y.c) >= len(x.c) AND y.c[1 : len(x.c)] = x.c
      AND (len(y.c) > len(x.c) OR y.conv_id < x.conv_id)
  )
)
SELECT conv_id, CAST(len(c) AS INTEGER) AS n_turns,
       array_to_string(list_transform(c, lambda t:
         '<|' || replace(coalesce(t.r, 'unknown'), '<|', '< |') || '|>' || chr(10) || replace(coalesce(t.t, ''), '<|', '< |') || '<|end|>' || chr(10)), '') AS chat
FROM kept
"""

_TEMPLATE_ROWS = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(TEMPLATES))

SQL["op6_license_scan"] = rf"""
WITH templates(tid, license, body) AS (VALUES {_TEMPLATE_ROWS}),
twords AS (SELECT tid, license, regexp_extract_all(lower(body), '[a-z0-9]+') AS w FROM templates),
tgrams AS (SELECT DISTINCT tid, license, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM twords),
tsizes AS (SELECT tid, count(*) AS n FROM tgrams GROUP BY tid),
paragraphs AS (SELECT doc_id, unnest(string_split_regex(lower(text), '\n[ \t\r]*\n')) AS p FROM documents),
units AS (
  SELECT doc_id, lower(text) AS u FROM documents
  UNION ALL SELECT doc_id, p FROM paragraphs
  UNION ALL SELECT doc_id, unnest(string_split(p, chr(10))) FROM paragraphs
),
uwords AS (SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(u, '[a-z0-9]+') AS w FROM units),
ugrams AS (SELECT DISTINCT uid, doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM uwords WHERE len(w) > 1),
usizes AS (SELECT uid, count(*) AS n FROM ugrams GROUP BY uid),
shared AS (SELECT uid, doc_id, tid, license, count(*) AS c FROM ugrams JOIN tgrams USING (g) GROUP BY ALL),
scored AS (
  SELECT doc_id, license, CAST(2 * c AS DOUBLE) / CAST(usizes.n + tsizes.n AS DOUBLE) AS score
  FROM shared JOIN usizes USING (uid) JOIN tsizes USING (tid)
)
SELECT doc_id, license, max(score) AS score FROM scored WHERE score >= CAST({THRESHOLD} AS DOUBLE) GROUP BY doc_id, license
"""

_RULE_ROWS = ", ".join(f"('{e}', {str(a).lower()})" for a, es in ((True, ALLOW), (False, BLOCK)) for e in es)

SQL["op8_url_filter"] = rf"""
WITH listed(entry, allow) AS (VALUES {_RULE_ROWS}),
rules AS (SELECT entry, bool_and(allow) AS allow FROM listed GROUP BY entry),
parts AS (
  SELECT page_id, url,
    lower(regexp_replace(regexp_replace(regexp_replace(
      regexp_extract(url, '^\s*(?:(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//)?([^/?#]*)([^?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''), '\.$', '')) AS host,
    list_filter(string_split(regexp_replace(
      regexp_extract(url, '^\s*(?:(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//)?([^/?#]*)([^?#]*)', 2), '\s+$', ''), '/'), lambda s: s <> '') AS path
  FROM pages
), whole AS (
  SELECT *, coalesce(regexp_matches(host, '^[\p{{L}}\p{{N}}_\-]+(\.[\p{{L}}\p{{N}}_\-]+)*$'), false) AS valid, string_split(host, '.') AS labels FROM parts
), hosts AS (
  SELECT page_id, url, path, valid, a, array_to_string(labels[len(labels) - a + 1 :], '.') AS h
  FROM (SELECT *, unnest(range(1, len(labels) + 1)) AS a FROM whole WHERE valid)
), tried AS (
  SELECT page_id, url, a, b, array_to_string(list_concat([h], path[1 : b]), '/') AS entry
  FROM (SELECT *, unnest(range(0, len(path) + 1)) AS b FROM hosts)
), best AS (
  SELECT page_id, url, entry, allow, row_number() OVER (PARTITION BY page_id, url ORDER BY a DESC, b DESC) AS n
  FROM tried JOIN rules USING (entry)
)
SELECT w.page_id, w.url,
       CASE WHEN NOT valid THEN 'invalid' WHEN best.entry IS NULL THEN 'none' WHEN allow THEN 'allow' ELSE 'block' END AS decision, best.entry AS entry
FROM whole AS w LEFT JOIN best ON best.page_id = w.page_id AND best.url = w.url AND best.n = 1
"""
