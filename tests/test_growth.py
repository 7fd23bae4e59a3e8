"""What must stay linear, and alike, as documents and pages grow."""

from __future__ import annotations

import random
import re
import time

from pyspark.sql import functions as F

from bulletria.functions.text import WHITE, strip
from bulletria.operators import body, layout, notices, scoring, segment
from bulletria.plans import corpus, queries


def test_strip_takes_all_white_space(spark):
    texts = [a + "x y" + b for a in WHITE for b in WHITE] + ["", " \n\x1c", "ab", "​x"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", strip(F.col("t")).alias("s"), F.regexp_replace("t", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "").alias("w")).collect()
    assert all(r.s == r.w for r in rows)


def fold_segments(lines):
    """segment_lines() a line at a time."""
    out, kind, cur = [], "", []

    def close():
        if cur:
            out.append(("table" if kind == "table" and len(cur) > 1 else "text", list(cur)))

    for x in lines:
        wide = len([p for p in re.split(" {2,}", x.strip()) if p]) >= 2
        opens = not re.match("[A-Z][a-z]", x.strip()) or bool(re.match(r"S[.]?\s*/?\s*No[.]?", x.strip(), re.I))
        if not x.strip():
            close()
            out.append(("blank", []))
            kind, cur = "", []
        elif kind == "table" and (wide or len(x) < 100):
            cur.append(x)
        elif not wide and (kind == "text" or (kind == "table" and len(cur) == 1)):
            kind, cur = "text", [*cur, x]
        else:
            close()
            kind, cur = ("table" if wide and opens else "text"), [x]
    close()
    return out


def test_segments_are_those_of_a_fold(spark):
    rng, kinds = random.Random(3), ["", "  ", "plain", "Plain  wide", "a  b", "S/No.  x", "long " * 25, "x" * 99]
    chunks = [[rng.choice(kinds) for _ in range(rng.randrange(1, 14))] for _ in range(400)] + [[rng.choice(kinds) for _ in range(30_000)]]
    began = time.time()
    rows = spark.createDataFrame(list(enumerate(chunks)), "i long, c array<string>").select("i", body.segment_lines(F.col("c")).alias("s")).collect()
    assert time.time() - began < 60
    assert all([(s.type, s.lines) for s in r.s] == fold_segments(chunks[r.i]) for r in rows)


def test_repeated_runs_are_counted(spark):
    words = ["a b c d e f " * 3 + "g", " ".join(map(str, range(99))), "a b c d e f x a b c d e f y a b c d e f"]
    rows = spark.createDataFrame([(w,) for w in words], "t string").select(scoring.repeated_grams(scoring.words_of(F.col("t"))).alias("n")).collect()
    assert [r.n for r in rows] == [6, 0, 1]


def test_one_page_of_many_boxes(spark):
    """200,000 boxes on a page: a list of all in each row, or a list copied for each box, would never end."""
    ids = spark.range(200_000).select(F.lit(1).alias("doc_id"), F.lit(1).alias("page_no"), F.col("id").alias("elem_idx"), F.lit("body").alias("layer"), F.lit("x").alias("text"), F.lit(595.0).alias("width"), (F.col("id") % 2 * 300 + 20.0).alias("l"), (F.col("id") % 2 * 300 + 200.0).alias("r"), (-5.0 * F.col("id")).alias("t"), (-5.0 * F.col("id") - 1).alias("b"))
    began = time.time()
    bands = layout.cluster_bands(ids).agg(F.max("band").alias("top"), F.count_distinct("band").alias("n")).first()
    order = layout.reading_order(ids).where("pos < 2 or pos > 199997").orderBy("pos").collect()
    assert time.time() - began < 60
    assert (bands.top, bands.n) == (199_999, 200_000) and [r.elem_idx for r in order] == [0, 2, 199_997, 199_999]


def test_bands_of_a_page():
    assert layout.fold_bands([100.0, 88.0, 60.0, 59.0, 10.0], [90.0, 70.0, 50.0, 58.0, 5.0], 1.5) == [0, 0, 0, 0, 1]
    assert layout.fold_bands([100.0, None, 1.0], [95.0, 90.0, 0.0], 1.5) == [0, 0, 1]


def test_issues_shuffle_keys_alone_and_keep_repeated_orders(spark, tmp_path):
    keys = [(5, 1), (4, 1), (20, 1), (3, 9)]
    for name, rows in (("plain", keys), ("twice", [*keys, (4, 1)])):
        spark.createDataFrame(rows, "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / name / "orders.parquet"))
        got = {r.doc_id: r.text for r in corpus.issues(spark, str(tmp_path / name)).collect()}
        assert len(got) == 2 and got[9].count("GAZETTE NOTICE NO. 3") == 1 and got[1].index("NOTICE NO. 4") < got[1].index("NOTICE NO. 5") < got[1].index("NOTICE NO. 20")
        assert got[1].count("GAZETTE NOTICE NO. 4\n") == (2 if name == "twice" else 1)
    plan = segment.split_notices(corpus.issues(spark, str(tmp_path / "plain")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan


def moved(spark, after):
    """Bytes shuffled and spilled by the stages after that one, and the last stage so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    jvm = sc._jvm
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    every = [stages.apply(i) for i in range(stages.size())]
    late = [s for s in every if s.stageId() > after]
    return sum(s.shuffleWriteBytes() + s.memoryBytesSpilled() + s.diskBytesSpilled() for s in late), max((s.stageId() for s in every), default=-1)


def test_highlighted_moves_keys_in_proportion(spark, tmp_path):
    """With lines of bulletins in the shuffle, it took about 500 bytes an order, on six copies of sf0.1 as on one."""
    took = {}
    for n in (5_000, 30_000):
        d = str(tmp_path / str(n))
        ids = spark.range(n, numPartitions=4).select(F.col("id").alias("o_orderkey"), (F.col("id") * 7 % (n // 10)).alias("o_custkey"))
        ids.write.parquet(f"{d}/orders.parquet")
        last = moved(spark, -1)[1]
        whole = F.sum(F.regexp_count("markdown", F.lit("<span style=[^>]*>GAZETTE NOTICE NO[.] [0-9]+</span>")))
        row = queries.highlighted(spark, d).agg(F.count("*").alias("docs"), whole.alias("spans"), F.sum(F.length("markdown")).alias("size")).first()
        took[n] = moved(spark, last)[0]
        assert (row.docs, row.spans) == (n // 10, n * 8 // 10) and row.size > 800 * n
        assert 0 < took[n] < 40 * n
    assert took[30_000] < 7 * took[5_000]


def test_notices_of_a_document_need_one_short_plan(spark):
    """A plan of scores by line, for each notice, took seconds to plan and 0.9 ms a notice to run; scores of both ways agree."""
    filler = ["that account 5 shall be settled", "", "a  b", "x;", "lower case", "S/No. Name", "Position", "1", "A. Able", "Clerk", "THE KENYA GAZETTE", "Dated the 3rd Ma\u0301rz, 2010.", "\u00c9t\u00e9 und mehr", "wer Und wer Dann", "A. I. HASSAN,"]
    rng, texts = random.Random(5), ["", " \n", "no header\r\nat all\x85A. SIGNATORY"]
    for _ in range(60):
        heads = ["GAZETTE NOTICE NO. 12", "| GAZETTE NOTICE NO. 13 | x", "GAZETE NOTICE NO \u0663", "GAZETTE NOTICE NO. 1234567"]
        texts.append("\n".join(x for _ in range(4) for x in [rng.choice(heads), "THE ACT", "", *rng.choices(filler, k=rng.choice([1, 5, 60]))]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    cut = segment.scored_notices(docs)
    began = time.time()
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert time.time() - began < 5 and plan.count("ArrowEvalPython [") == 1 and "Exchange" not in plan
    key = lambda r: (r.doc_id, r.notice_idx)
    got, want = sorted(cut.collect(), key=key), sorted(scoring.score_notices(segment.split_notices(docs)).select(cut.columns).collect(), key=key)
    assert got == want and len(got) > 100 and {r.header_match for r in got} == {"strict", "recovered", "none"}


def test_segments_and_titles_of_both_ways(spark):
    rng, kinds = random.Random(4), ["", "  ", "plain", "Plain  wide", "a  b", "S/No.  x", "IN EXERCISE of", "x" * 99, "x" * 100]
    chunks = [[rng.choice(kinds) for _ in range(rng.randrange(0, 14))] for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(chunks)), "i long, c array<string>").select("i", body.segment_lines(F.col("c")).alias("s"), body.title_stack(F.col("c")).alias("t")).collect()
    for r in rows:
        ps = notices.patterns_for("".join(chunks[r.i]))
        assert [(s.type, s.lines) for s in r.s] == notices.segment_lines(chunks[r.i], ps) and (r.t.titles, r.t.rest) == notices.title_stack(chunks[r.i], ps)
