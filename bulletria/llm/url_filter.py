"""URL filtering by allow and block lists.

An entry is a host, with or without a path: ``example.org``, or
``example.org/a/b``. It applies to the host and its subdomains, and to the paths
that begin with its segments. Entries make a trie over reversed host labels,
then path segments. Of those that apply the longest decides: more host labels
first, then more segments. An entry that both lists hold blocks.

The trie is broadcast while its entries have at most ``TRIE_BYTES`` characters,
about twenty times that in nested dictionaries; beyond, each URL's possible
entries are joined with the lists instead, with the same results.

Defined results: scheme, user, port, a dot at the end of the host, query and
fragment are ignored; hosts are compared in lower case, paths as they are, empty
segments dropped. A null URL, or one whose host isn't made of letters, digits,
dots, hyphens and underscores, is "invalid". Where no entry applies the decision
is "none". Null and hostless entries are ignored. Rows are decided one by one,
so repeated ones repeat. URLs of any length are matched whole. No rows, or no
entries, are fine. Columns other than page_id and url aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRIE_BYTES = 4 << 20
_URL = r"^\s*(?:(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//)?([^/?#]*)([^?#]*)"
_RULE = "struct<entry: string, allow: boolean>"

Entries = DataFrame | Iterable[str]


def _host(url: Column) -> Column:
    """Lower-case host, or null."""
    place = F.regexp_replace(F.regexp_extract(url, _URL, 1), r"^.*@", "")
    host = F.lower(F.regexp_replace(F.regexp_replace(place, r":[0-9]*$", ""), r"\.$", ""))
    return F.when(host.rlike(r"^[\p{L}\p{N}_\-]+(\.[\p{L}\p{N}_\-]+)*$"), host)


def _segments(url: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.regexp_extract(url, _URL, 2), r"\s+$", ""), "/"), lambda s: s != "")


def _entries(spark_df: DataFrame, allow: Entries, block: Entries) -> DataFrame:
    """(entry, allow): each entry once, in one spelling."""
    spark = spark_df.sparkSession

    def one(given: Entries, allowed: bool) -> DataFrame:
        rows = given if isinstance(given, DataFrame) else spark.createDataFrame([(e,) for e in given], "entry string")
        raw = rows.select(F.col(rows.columns[0]).cast("string").alias("u"))
        entry = F.concat_ws("/", F.concat(F.array(_host(F.col("u"))), _segments(F.col("u"))))
        return raw.where(_host(F.col("u")).isNotNull()).select(entry.alias("entry"), F.lit(allowed).alias("allow"))

    return one(allow, True).unionByName(one(block, False)).groupBy("entry").agg(F.min("allow").alias("allow"))


def build_trie(entries: Iterable[tuple[str, bool]]) -> dict:
    """Nested dictionaries; host labels are keys, "/" leads to the paths, "" holds the rule."""
    root: dict = {}
    for entry, allow in entries:
        host, *path = entry.split("/")
        node = root
        for label in reversed(host.split(".")):
            node = node.setdefault(label, {})
        if path:
            node = node.setdefault("/", {})
            for segment in path:
                node = node.setdefault("=" + segment, {})
        node[""] = (entry, allow)
    return root


def longest_match(trie: dict, host: str, path: list[str]) -> tuple[str, bool] | None:
    best, node = None, trie
    for label in reversed(host.split(".")):
        node = node.get(label)
        if node is None:
            break
        best = node.get("", best)
        branch = node.get("/")
        for segment in path if branch else ():
            branch = branch.get("=" + segment)
            if branch is None:
                break
            best = branch.get("", best)
    return best


def _by_trie(pages: DataFrame, rules: DataFrame) -> DataFrame:
    trie = pages.sparkSession.sparkContext.broadcast(build_trie((r["entry"], r["allow"]) for r in rules.collect()))

    def run(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        found = [longest_match(trie.value, h, p) if h is not None else None for h, p in zip(hosts.to_pylist(), paths.to_pylist())]
        return pa.array([None if f is None else {"entry": f[0], "allow": f[1]} for f in found], pa.struct([("entry", pa.string()), ("allow", pa.bool_())]))

    return pages.withColumn("_rule", F.arrow_udf(run, _RULE)("_host", "_path"))


def _by_join(pages: DataFrame, rules: DataFrame, most_labels: int, most_segments: int) -> DataFrame:
    """Entries of a URL with more labels or segments than any rule has aren't tried: they match none."""
    keyed = pages.withColumn("_row", F.monotonically_increasing_id())
    labels = F.split("_host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most_labels))), lambda n: F.struct(n.alias("a"), F.array_join(F.slice(labels, -n, n), ".").alias("h")))
    ends = F.transform(F.sequence(F.lit(0), F.least(F.size("_path"), F.lit(most_segments))), lambda n: F.struct(n.alias("b"), F.slice("_path", 1, n).alias("p")))
    tried = keyed.where("_host is not null").select("_host", "_path").distinct().select("_host", "_path", F.explode(hosts).alias("x"), ends.alias("ends"))
    tried = tried.select("_host", "_path", "x", F.explode("ends").alias("y"))
    tried = tried.select("_host", "_path", F.struct("x.a", "y.b").alias("rank"), F.concat_ws("/", F.concat(F.array("x.h"), F.col("y.p"))).alias("entry"))
    best = tried.join(rules, "entry").groupBy("_host", "_path").agg(F.max_by(F.struct("entry", "allow"), "rank").alias("_rule"))
    return keyed.join(best, ["_host", "_path"], "left").drop("_row")


def filter_urls(pages: DataFrame, allow: Entries, block: Entries, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """(page_id, url, decision, entry): allow, block, none or invalid, and the entry that decided."""
    rules = _entries(pages, allow, block).cache()
    try:
        parts = F.split("entry", "/")
        size, labels, segments = rules.agg(F.sum(F.length("entry") + 1), F.max(F.size(F.split(parts[0], r"\."))), F.max(F.size(parts) - 1)).first()
        own = pages.select("page_id", F.col("url").cast("string").alias("url"))
        own = own.withColumns({"_host": _host(F.col("url")), "_path": _segments(F.col("url"))})
        ruled = _by_trie(own, rules) if (size or 0) <= trie_bytes else _by_join(own, _entries(pages, allow, block), labels, segments)
    finally:
        rules.unpersist()
    decision = F.when(F.col("_host").isNull(), "invalid").when(F.col("_rule").isNull(), "none").when(F.col("_rule.allow"), "allow").otherwise("block")
    return ruled.select("page_id", "url", decision.alias("decision"), F.col("_rule.entry").alias("entry"))
