"""A corpus of bulletins derived from the driver's tables.

``LINES`` runs in DuckDB; in Spark the same lines are made a bulletin at a time. ``{orders}`` and the like stand for
the tables. Shapes: boxes on pages from lineitem, issues with headers (clean,
misspelt and noisy), statutory text, tables, signatures, a masthead, corrections
and a trailer from orders.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.layout import by_page, numbered

BOXES = """
SELECT CAST(l_orderkey % 500 AS BIGINT) AS doc_id, CAST(1 + (l_linenumber - 1) % 3 AS INT) AS page_no,
  CAST(row_number() OVER (PARTITION BY l_orderkey % 500, (l_linenumber - 1) % 3 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS INT) AS elem_idx,
  CASE WHEN l_linenumber = 7 AND l_returnflag = 'R' THEN 'furniture' ELSE 'body' END AS layer,
  concat('box ', CAST(l_orderkey AS VARCHAR(20)), '.', CAST(l_linenumber AS VARCHAR(20))) AS text,
  CAST(40 + (l_partkey % 7) * 70 AS DOUBLE) AS l,
  CAST(800 - (l_orderkey * 7 + l_partkey * 3) % 740 AS DOUBLE) AS t,
  CAST(least(40 + (l_partkey % 7) * 70 + CASE l_suppkey % 5 WHEN 0 THEN 60 WHEN 1 THEN 200 WHEN 2 THEN 120 WHEN 3 THEN 230 ELSE 450 END, 580) AS DOUBLE) AS r,
  CAST(800 - (l_orderkey * 7 + l_partkey * 3) % 740 - (8 + 2 * l_linenumber) AS DOUBLE) AS b,
  CAST(595 AS DOUBLE) AS width
FROM {lineitem}
"""

_LINES = [
    ("0", "concat('Total | GAZETTE NOTICE NO. ', k, ' | x')", "n % 10 = 0"),
    ("0", "concat('GAZETE NOTICE. NO. ', k)", "n % 10 = 1"),
    ("0", "concat('GAZETTE NOTICE NO. ', k)", "n % 10 > 1"),
    ("1", "''", "true"),
    ("2", "'THE CAPITAL MARKETS ACT'", "true"),
    ("3", "''", "true"),
    ("4", "'IN EXERCISE of the powers conferred by the Act, it is notified'", "true"),
    ("5", "'THE KENYA GAZETTE'", "n % 4 = 0"),
    ("6", "concat('serial  ', k, '  amount')", "n % 6 = 2"),
    ("7", "concat('no ', k, '  paid')", "n % 6 = 2"),
    ("70", "'S/No. Name'", "n % 9 = 4"),
    ("71", "'Position'", "n % 9 = 4"),
    ("72", "'1'", "n % 9 = 4"),
    ("73", "concat('K. Clerk ', k)", "n % 9 = 4"),
    ("74", "'Clerk'", "n % 9 = 4"),
    ("75", "'2 3'", "n % 9 = 4"),
    ("76", "'A. Able   B. Baker'", "n % 9 = 4"),
    ("77", "'Cook   Driver'", "n % 9 = 4"),
    ("78", "CASE WHEN n % 4 = 0 THEN '4.' ELSE '6' END", "n % 9 = 4"),
    ("79", "concat('Name ', CASE WHEN n % 5 = 0 THEN 'of somebody whose names are so many and so long that cells must have been merged' ELSE k END)", "n % 9 = 4"),
    ("80", "CASE WHEN n % 2 = 0 THEN 'Guard' ELSE 'as a guard of the stores, whose duties are set out in the second schedule to the Act that is named above' END", "n % 9 = 4"),
    ("81", "'7'", "n % 27 = 4"),
    ("82", "'L. Last'", "n % 27 = 4"),
    ("90", "'Dated the 3rd August, 2010.'", "n % 2 = 0"),
    ("91", "'A. I. HASSAN,'", "n % 5 <> 0"),
]

_HEAD = [
    ("1", "'THE KENYA GAZETTE'", "true"),
    ("2", "concat('Vol. CXI----No. ', c)", "n % 5 = 0"),
    ("2", "concat('Vol. ', CASE n % 4 WHEN 0 THEN 'CXI' WHEN 1 THEN 'CXII' WHEN 2 THEN 'CXXIV' ELSE 'CIX' END, '-No. ', c)", "n % 5 <> 0"),
    ("3", "'NAIROBI, 31st February, 2010'", "n % 7 = 0"),
    ("3", "concat('NAIROBI, ', CAST(1 + n % 28 AS VARCHAR(20)), 'th ', CASE n % 3 WHEN 0 THEN 'March' WHEN 1 THEN 'Sept' ELSE 'Brumaire' END, ', ', CAST(2000 + n % 25 AS VARCHAR(20)))", "n % 7 <> 0"),
    ("4", "concat('Supplement No. ', CAST(n % 90 AS VARCHAR(20)))", "n % 6 = 0"),
    ("5", "''", "true"),
    ("6", "'CORRIGENDA'", "n % 3 = 0"),
    ("7", "concat('IN Gazette Notice No. ', CAST(n + 7 AS VARCHAR(20)), ' of 2010, amend the expression printed as \"E', c, '\" to read \"F', c, '\"')", "n % 3 < 2"),
    ("8", "concat('Gazette Notice No. ', CAST(n + 9 AS VARCHAR(20)), ' of 2011 stands')", "n % 4 = 0"),
]

_K, _C = "(SELECT o_orderkey AS n, CAST(o_orderkey AS VARCHAR(20)) AS k, o_custkey AS doc_id FROM {orders})", "(SELECT DISTINCT o_custkey AS n, CAST(o_custkey AS VARCHAR(20)) AS c FROM {orders})"

LINES = (
    "SELECT doc_id, n AS ord, slot, line FROM ("
    + " UNION ALL ".join(f"SELECT doc_id, n, {slot} AS slot, {line} AS line FROM {_K} AS q WHERE {when}" for slot, line, when in _LINES)
    + " UNION ALL SELECT doc_id, n, 10 + i AS slot, concat('that account ', CAST((n * i) % 997 AS VARCHAR(20)), ' shall be settled') AS line FROM "
    + _K
    + " AS q CROSS JOIN {steps} AS s WHERE i BETWEEN 8 AND 56 AND i - 8 < CASE WHEN n % 3 = 0 THEN 45 ELSE 4 END"
    + "".join(f" UNION ALL SELECT n AS doc_id, -1 AS n, {slot} AS slot, {line} AS line FROM {_C} AS q WHERE {when}" for slot, line, when in _HEAD)
    + " UNION ALL SELECT n AS doc_id, 1000000000000 AS n, i AS slot, CASE WHEN i = 30 THEN 'SUBSCRIPTION CHARGES' ELSE concat('price list item ', CAST(i AS VARCHAR(20))) END AS line FROM "
    + _C
    + " AS q CROSS JOIN {steps} AS s WHERE n % 4 = 1 AND i BETWEEN 1 AND 40) AS every_line"
)


def duck(sql: str) -> str:
    return sql.format(orders="orders", lineitem="lineitem", steps="(SELECT unnest(range(1, 61)) AS i)")


#: The order that numbers boxes on their page.
BOX_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def unnumbered(spark: SparkSession, sf_dir: str, *key: str) -> DataFrame:
    """The rows of BOXES by page (or by that key), with the columns of BOX_ORDER in place of elem_idx. Only those are shuffled."""
    doc, page = "CAST(l_orderkey % 500 AS BIGINT)", "CAST(1 + (l_linenumber - 1) % 3 AS INT)"
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    narrow = lines.select(*BOX_ORDER, F.expr("CASE WHEN l_linenumber = 7 AND l_returnflag = 'R' THEN true END").alias("furniture"))
    named = {"doc_id": F.expr(doc), "page_no": F.expr(page)}
    placed = by_page(narrow, *[named[k] for k in key or named])
    made = re.sub(r"\s*CAST\(row_number\(\).*\n", "\n", BOXES).replace("l_linenumber = 7 AND l_returnflag = 'R'", "furniture")
    columns = made[made.index("SELECT") + 6 : made.index("FROM {lineitem}")].replace("VARCHAR(20)", "STRING")
    return placed.selectExpr("_page", *BOX_ORDER, *[c.strip() for c in _split(columns)])


def _split(columns: str) -> list[str]:
    """The columns of a SELECT, cut at the commas outside of brackets."""
    out, depth = [""], 0
    for c in columns:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def boxes(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] | None = None) -> DataFrame:
    """The rows of BOXES, or those columns of them."""
    names = ("doc_id", "page_no", "elem_idx", "layer", "text", "l", "t", "r", "b", "width")
    return numbered(unnumbered(spark, sf_dir), BOX_ORDER, keep or names)


def _of(sql: str, n: str) -> str:
    """An expression of LINES for the key n, as a number and as text."""
    return re.sub(r"\b[kc]\b", f"CAST({n} AS STRING)", re.sub(r"\bn\b", n, sql)).replace("VARCHAR(20)", "STRING")


def _placed(lines: list[tuple[str, str, str]], ord: str, n: str) -> str:
    """The lines of one key that its conditions let through, each with its place."""
    every = ", ".join(f"named_struct('ord', CAST({ord} AS BIGINT), 'slot', {slot}, 'line', {_of(line, n)}, 'keep', {_of(when, n)})" for slot, line, when in lines)
    return f"transform(filter(array({every}), l -> l.keep), l -> named_struct('ord', l.ord, 'slot', l.slot, 'line', l.line))"


def _joined(lines: list[tuple[str, str, str]], n: str) -> str:
    """The same lines as arguments of concat_ws, which leaves out nulls as array_join does."""
    return ", ".join(_of(line if when == "true" else f"CASE WHEN {when} THEN {line} END", n) for _, line, when in lines)


_ACCOUNTS = "transform(sequence(8, CASE WHEN n % 3 = 0 THEN 52 ELSE 11 END), i -> concat('that account ', CAST((n * i) % 997 AS STRING), ' shall be settled'))"
_PRICES = "CASE WHEN n % 4 = 1 THEN transform(sequence(1, 40), i -> CASE WHEN i = 30 THEN 'SUBSCRIPTION CHARGES' ELSE concat('price list item ', CAST(i AS STRING)) END) ELSE array() END"
_LAST = 1000000000000


def _numbered(lines: str, ord: str, first: int) -> str:
    return f"transform({lines}, (l, i) -> named_struct('ord', CAST({ord} AS BIGINT), 'slot', i + {first}, 'line', l))"


def issues(spark: SparkSession, sf_dir: str, key: str = "BIGINT") -> DataFrame:
    """(doc_id, text): one bulletin for each customer with orders, keyed by a column of that type. The lines of LINES.

    Only the keys of orders are shuffled; a bulletin's text is made where its
    keys meet, once (a generator is a bound that no filter or projection moves
    across). Keys that come twice or lie outside of 0 to 10**12 have lines that
    mix with others, and are sorted line by line.
    """
    early, late = [x for x in _LINES if int(x[0]) < 18], [x for x in _LINES if int(x[0]) > 62]
    accounts, prices = _of(_ACCOUNTS, "x.n"), _PRICES
    fast = f"concat_ws('\\n', {_joined(_HEAD, 'n')}, transform(ks, x -> concat_ws('\\n', {_joined(early, 'x.n')}, {accounts}, {_joined(late, 'x.n')})), {prices})"
    own = f"flatten(transform(ks, x -> concat({_placed(_LINES, 'x.n', 'x.n')}, {_numbered(accounts, 'x.n', 18)})))"
    every = f"concat({own}, {_placed(_HEAD, '-1', 'n')}, {_numbered(prices, str(_LAST), 1)})"
    slow = f"array_join(transform(array_sort({every}), l -> l.line), '\\n')"
    plain = f"ks[0].n >= 0 AND element_at(ks, -1).n < {_LAST} AND size(array_distinct(ks)) = size(ks)"
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").cast(key).alias("doc_id"), "o_custkey", "o_orderkey")
    # As many partitions as for the texts: by the size of the keys alone, adaptive execution would leave very few.
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    keys = orders.repartition(count, "doc_id").groupBy("doc_id").agg(F.min("o_custkey").alias("n"), F.sort_array(F.collect_list(F.struct(F.col("o_orderkey").alias("n")))).alias("ks"))
    return keys.select("doc_id", F.explode(F.array(F.expr(f"CASE WHEN {plain} THEN {fast} ELSE {slow} END"))).alias("text"))


DUCK_ISSUES = f"SELECT doc_id, string_agg(line, chr(10) ORDER BY ord, slot, line) AS text FROM ({duck(LINES)}) GROUP BY doc_id"
DUCK_BOXES = duck(BOXES)
