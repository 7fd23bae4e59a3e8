"""Operators of bulletins on small hand-made inputs."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from bulletria.functions.text import ends_clean, round3, split_lines
from bulletria.operators import body, enhance, envelope, fields, identity, layout, report, scoring, segment
from bulletria.sources import readers, sinks


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def text_docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_round3_is_exact(spark):
    rng = random.Random(1)
    xs = [rng.randrange(2001) / 2000 for _ in range(500)] + [rng.random() for _ in range(500)] + [0.0005, 0.0015, 0.1235, 1.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", round3(F.col("x")).alias("r")).collect()
    assert all(r.r == round(r.x, 3) for r in got)


def test_lines_and_ends(spark):
    for text in ("a\r\nb\n", "", "a\x0bb\x85c d", "\n\n", "x"):
        assert one(spark, l=split_lines(F.lit(text))).l == text.splitlines()
    assert one(spark, a=ends_clean(F.lit("done. ")), b=ends_clean(F.lit("not done")), c=ends_clean(F.lit(""))).asDict() == {"a": True, "b": False, "c": False}


def test_headers_are_recovered_only_in_long_gaps(spark):
    filler = "\n".join(f"line {i}" for i in range(50))
    text = f"GAZETTE NOTICE NO. 1\n{filler}\n| GAZETTE NOTICE NO. 1 | GAZETTE NOTICE NO. 2 | x\nends in mid\nGAZETE NOTICE NO 3\nshort\n| GAZETTE NOTICE NO. 4 |\nend."
    rows = segment.notice_lines(text_docs(spark, text, " \n ", "no header here")).orderBy("doc_id", "notice_idx").collect()
    assert [(r.doc_id, r.notice_no, r.header_match) for r in rows] == [(0, "1", "strict"), (0, "2", "recovered"), (0, "3", "strict"), (2, None, "none")]
    merged = segment.split_notices(text_docs(spark, text)).orderBy("notice_idx").collect()
    assert [(r.notice_no, r.stitched_from) for r in merged] == [("1", ["2"]), ("3", [])]
    assert merged[0].line_end == 51 and merged[0].end_line == 53


def test_trailer_is_cut(spark):
    text = "GAZETTE NOTICE NO. 7\nTHE ACT\n\nIT IS notified.\n" + "\n".join(f"body {i}" for i in range(20)) + "\nSUBSCRIPTION CHARGES\nprices"
    row = segment.split_notices(text_docs(spark, text)).first()
    assert row.line_end == 24 and row.full_text.endswith("body 19") and row.title_lines == ["THE ACT"]


def test_segments_and_tables(spark):
    chunk = F.array(*[F.lit(x) for x in ["THE ACT", "", "1  a  b", "2  c  d", "", "Plain text here", "goes on", "x  y"]])
    got = [(s.type, s.lines) for s in one(spark, s=body.segment_lines(chunk)).s]
    assert got == [("text", ["THE ACT"]), ("blank", []), ("table", ["1  a  b", "2  c  d"]), ("blank", []), ("text", ["Plain text here", "goes on"]), ("text", ["x  y"])]
    table = body.parse_serial_table(["S/No. Name", "Position", "625 626", "Ann  Bob", "Chair  Clerk", "627", "Cy", "Member", "", "x"])
    assert table["rows"] == [{"s_no": "625", "name": "Ann", "position": "Chair"}, {"s_no": "626", "name": "Bob", "position": "Clerk"}, {"s_no": "627", "name": "Cy", "position": "Member"}]
    assert table["repairs"] == ["split merged row 625/626"] and body.parse_serial_table(["S/No. Name", ""]) is None


@pytest.mark.parametrize(
    "line, date, want",
    [("Vol. CXXIV-No. 282", "NAIROBI, 23rd December, 2022", ("CXXIV", 282, "2022-12-23")), ("Vol. CXI----No. 107", "NAIROBI, 31st February, 2010", (None, None, None)), ("vol cvii - no. 90", "NAIROBI, 30th Sept, 2005", ("CVII", 90, "2005-09-30"))],
)
def test_masthead(spark, line, date, want):
    row = fields.masthead(text_docs(spark, f"x\n{line}\n{date}")).first()
    assert (row.volume, row.issue_no, str(row.publication_date) if row.publication_date else None) == want


def test_corrigenda(spark):
    text = 'CORRIGENDA\nIN Gazette Notice No. 14152 of 2025, amend the expression printed as "E378 of 2024" to read "E378 of 2025"\nGAZETTE NOTICE NO. 1\nGazette Notice No. 5 of 2020'
    rows = fields.corrigenda(text_docs(spark, text)).collect()
    assert [(r.referenced_notice_no, r.referenced_year, r.error_text, r.correction_text) for r in rows] == [("14152", "2025", "E378 of 2024", "E378 of 2025")]
    assert rows[0].raw_text.startswith("Gazette Notice")


def test_identity(spark):
    row = one(
        spark,
        a=identity.issue_id(F.lit("CXI"), F.lit(100), F.lit("2009-11-20").cast("date"), F.lit(76), F.lit("ab" * 32)),
        b=identity.issue_id(F.lit("CXI"), F.lit(100), F.lit(None).cast("date"), F.lit(0), F.lit("ab" * 32)),
        c=identity.notice_id(F.lit("I"), F.lit(None).cast("string"), F.lit(6)),
    )
    assert (row.a, row.b, row.c) == ("KE-GAZ-CXI-100-2009-11-20-S76", "KE-GAZ-UNKNOWN-abababababab", "I:_orphan_6")


def test_number_ladder(spark):
    values = {"": 0.0, "12": 1.0, "12/2010": 0.6, "12A": 0.5, "1234567": 0.4, "7": 0.3, "abc": 0.1, "1-2": 0.3}
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", scoring.notice_number(F.col("v"))[0].alias("s")).collect()
    assert {r.v: r.s for r in rows} == values


def test_layout_document(spark, tmp_path):
    box = [{"self_ref": "a", "label": "title", "content_layer": "body", "text": "", "orig": "GAZETTE NOTICE NO. 1", "prov": [{"page_no": 1, "bbox": {"l": 50, "t": 700, "r": 250, "b": 680}}]}, {"text": "A short body.", "prov": [{"page_no": 1, "bbox": {"l": 50, "t": 670, "r": 250, "b": 650}}]}]
    (tmp_path / "good_one.json").write_text(json.dumps({"texts": box, "tables": [], "pages": {"1": {"page_no": 1, "size": {"width": 595, "height": 842}}}}))
    (tmp_path / "bad.json").write_text("{broken")
    docs = readers.read_layouts(spark, str(tmp_path))
    elements = layout.with_width(layout.extract_elements(docs), layout.page_sizes(docs))
    assert layout.document_text(elements).collect()[0].text == "GAZETTE NOTICE NO. 1\n\nA short body."
    info = layout.document_layout(elements).first()
    assert (info.doc_id, info.layout_confidence, info.pages[0].mode) == ("good_one", 1.0, "one_col")


def test_envelope_validates_and_is_written(spark, tmp_path):
    text = "Vol. CXI-No. 5\nNAIROBI, 3rd March, 2010\nGAZETTE NOTICE NO. 10\nTHE ACT\n\nIT IS notified for the general information of the public that this is so.\nDated the 3rd March, 2010."
    docs = text_docs(spark, text, "").withColumn("pdf_sha256", F.sha2("text", 256))
    made = envelope.build_envelopes(docs, extracted_at="2020-01-01 00:00:00").cache()
    assert [r.broken for r in envelope.violations(made).collect()] == [[], []]
    with pytest.raises(ValueError):
        envelope.conform(made.withColumn("stray", F.lit(1)))
    with pytest.raises(ValueError):
        sinks.resolve({"nonsense": True})
    with pytest.raises(ValueError):
        sinks.write_bundles(made, str(tmp_path / "x"))
    with pytest.raises(NotImplementedError):
        sinks.write_bundles(made, str(tmp_path / "x"), {"images": True})
    out = sinks.write_bundles(made, str(tmp_path / "out"), sinks.Bundles(document_index=True))
    assert spark.read.json(out["notices"]).first().gazette_notice_no == "10"
    assert set(out) == {"notices", "corrigenda", "document_index", "gazette_spatial_json"}


def test_report_and_regression(spark):
    scored = spark.createDataFrame([(i, i / 10) for i in range(11)] + [(11, None)], "doc_id long, s double")
    assert report.aggregate_confidence(scored, "s").first().asDict() == {"mean": 0.5, "min": 0.0, "fraction_high": 0.273, "n": 11}
    assert [r.doc_id for r in report.lowest(scored, "s", ["doc_id"], 2).collect()] == [0, 1]
    assert report.stratified_sample(scored, "s", "doc_id", 2).count() == 7
    then = spark.createDataFrame([(1, True, 0.9), (2, True, 0.9), (3, False, 0.9)], "doc_id long, present boolean, mean_composite double")
    now = spark.createDataFrame([(1, 0.86), (2, 0.8), (3, 0.1)], "doc_id long, mean_composite double")
    checked = report.check_regression(then, now)
    assert {r.doc_id: r.failed for r in checked.collect()} == {1: False, 2: True} and not report.regression_ok(checked).first().ok


def test_opinions_are_cached(spark):
    asked = []

    def judge(texts):
        return [{s: 0.4 for s in enhance.SUB_SCORES} | {"issues": [], "needs_human_review": False, "error": None} for _ in texts]

    rows = spark.createDataFrame([(1, "weak", 0.5), (2, "fine", 0.9), (3, " ", 0.2)], "doc_id long, full_text string, c double").withColumn("confidence_scores", F.struct(F.col("c").alias("composite")))
    got = {r.doc_id: (r.composite_enhanced, r.needs_human_review) for r in enhance.enhance(rows, judge, "m").collect()}
    assert got == {1: (0.46, True), 2: (None, False), 3: (None, True)} and not asked
