"""Whole documents through the parser, and what is written of them."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

import bulletria
from bulletria.operators import envelope, report, scoring, segment
from bulletria.sources import readers, sinks

WORDS = "IN EXERCISE of the powers conferred by the Act it is notified that the office is closed."


def layout(*lines, tables=()):
    def box(i, text):
        return {"self_ref": f"#/texts/{i}", "label": "text", "content_layer": "body", "text": text, "orig": text, "prov": [{"page_no": 1, "bbox": {"l": 50, "t": 800 - 20 * i, "r": 250, "b": 785 - 20 * i}}]}

    return json.dumps({"schema_name": "x", "version": "1", "name": "n", "texts": [box(i, t) for i, t in enumerate(lines)], "tables": list(tables), "pages": {"1": {"page_no": 1, "size": {"width": 595, "height": 842}}}})


FILES = {
    "a.json": layout("Vol. CXI-No. 7", "NAIROBI, 3rd March, 2009", "GAZETTE NOTICE NO. 12", "THE LAND ACT", "", WORDS, "GAZETTE NOTICE NO. 13", "S/No. Name", "Position", "1", "A. Able", "Clerk"),
    "b.json": layout("nothing that is a header"),
    "c.json": layout(),
    "d.json": "{ broken",
}


@pytest.fixture(scope="module")
def parsed(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("layouts")
    for name, text in FILES.items():
        (folder / name).write_text(text, encoding="utf-8")
    rows = bulletria.parse_files(spark, str(folder), extracted_at="2020-01-01 00:00:00")
    path = str(tmp_path_factory.mktemp("records") / "parsed")
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def test_files_and_bytes_give_the_same_records(spark, parsed):
    given = spark.createDataFrame([(n, bytearray(t.encode())) for n, t in FILES.items()], "name string, content binary")
    from_bytes = bulletria.parse_bytes(given, "2020-01-01 00:00:00")
    one, other = ({r.doc_id: r for r in df.collect()} for df in (parsed, from_bytes))
    assert one == other and set(one) == {"a.json", "b.json", "c.json"}
    a = one["a.json"]
    assert a.issue.gazette_issue_id == "KE-GAZ-CXI-7-2009-03-03"
    assert [(n.gazette_notice_no, n.provenance.header_match) for n in a.notices] == [("12", "strict"), ("13", "strict")]
    assert a.notices[0].title_lines == ["THE LAND ACT"] and WORDS in a.notices[0].gazette_notice_full_text
    assert a.notices[1].derived_table is None  # boxes are joined by blank lines, so the heading isn't followed by "Position"
    assert a.pdf_sha256 == hashlib.sha256(FILES["a.json"].encode()).hexdigest()
    assert a.layout_info.layout_confidence == 1.0 and len(a.layout_info.pages) == 1
    assert [n.provenance.header_match for n in one["b.json"].notices] == ["none"] and one["c.json"].notices == []
    assert envelope.violations(parsed).where(F.size("broken") > 0).count() == 0


def test_files_of_each_document(spark, parsed, tmp_path):
    nameless = parsed.where("doc_id = 'b.json'").withColumn("doc_id", F.lit(None).cast("string"))
    rows = parsed.where("doc_id = 'a.json'").unionByName(nameless)
    chosen = {"gazette_spatial_json": True, "notices": True, "corrigenda": True, "document_index": True, "tables": True, "debug_trace": True}
    paths = {r.path for r in bulletria.write_files(rows, str(tmp_path), chosen).collect()}
    sha = hashlib.sha256(FILES["b.json"].encode()).hexdigest()[:12]
    assert {"a.json/a.json_gazette_spatial.json", "a.json/a.json_notices.json", f"{sha}/{sha}_notices.json", f"{sha}/{sha}_gazette_spatial.json"} <= paths
    notices = json.loads((tmp_path / "a.json/a.json_notices.json").read_text())
    assert [n["gazette_notice_no"] for n in notices] == ["12", "13"]
    whole = spark.createDataFrame([((tmp_path / "a.json/a.json_gazette_spatial.json").read_text(),)], "value string")
    assert envelope.validate_envelope_json(whole).first().problems == []
    source = spark.createDataFrame([("a.json", "## GAZETTE NOTICE NO. 12\nx")], "doc_id string, text string")
    bulletria.write_files(rows.where("doc_id is not null"), str(tmp_path), {"spatial_markdown": True}, source)
    assert (tmp_path / "a.json/a.json_spatial.md").read_text().startswith("## <span ")
    with pytest.raises(ValueError):
        bulletria.write_files(rows, str(tmp_path), {"full_text": True})


def test_unknown_keys_at_every_level(spark, parsed):
    good = json.loads(parsed.where("doc_id = 'a.json'").select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).first()[0])

    def problems(change):
        text = json.loads(json.dumps(good))
        change(text)
        return envelope.validate_envelope_json(spark.createDataFrame([(json.dumps(text),)], "value string")).first().problems

    assert problems(lambda t: None) == []
    assert problems(lambda t: t["issue"].update(x=1)) == ["unknown: issue.x"]
    assert problems(lambda t: t["document_confidence"]["counts"].update(unknown_tier=1)) == ["unknown: document_confidence.counts.unknown_tier"]
    assert problems(lambda t: t["notices"][1]["provenance"].update(y=1)) == ["unknown: notices[].provenance.y"]
    assert problems(lambda t: t["layout_info"]["pages"][0]["bands"][0].update(z=1)) == ["unknown: layout_info.pages[].bands[].z"]
    assert problems(lambda t: t["warnings"].append({"kind": "k", "message": "m", "where": {"any": "thing"}})) == []
    assert problems(lambda t: t["issue"].pop("gazette_issue_id")) == ["missing: issue.gazette_issue_id", "invalid: issue"]
    assert problems(lambda t: t["notices"][0].update(content_sha256="short")) == ["invalid: content_sha256"]


def test_texts_that_are_not_utf8(spark, tmp_path):
    (tmp_path / "t.txt").write_bytes(b"caf\xe9 \xff ok")
    assert [tuple(r) for r in readers.read_texts(spark, str(tmp_path)).collect()] == [("t", "caf� � ok")]


def test_reasons_name_their_part(spark):
    rows = scoring.score_notices(segment.split_notices(spark.createDataFrame([(1, "GAZETTE NOTICE NO. 5\nx")], "doc_id long, text string")))
    why = rows.first().confidence_reasons
    assert why and {w.split(": ")[0] for w in why} <= {*scoring.PARTS, "table"}


def test_snapshot_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([("a", 0.9, 0.5, 1.0, 0.8, 3)], "doc_id string, mean_composite double, min_composite double, layout double, ocr_quality double, n_notices int")
    snapshot = report.regression_snapshot(spark.createDataFrame([("a",), ("b",)], "doc_id string"), docs)
    report.write_snapshot(snapshot, str(tmp_path / "s"))
    back = {r.doc_id: (r.present, r.mean_composite, r.n_notices) for r in readers.read_snapshot(spark, str(tmp_path / "s")).collect()}
    assert back == {"a": (True, 0.9, 3), "b": (False, None, None)}


def test_all_files_are_ranked_by_name(spark):
    files = spark.createDataFrame([(n,) for n in "dcabfe"], "name string")
    chosen, missing = readers.select_files(files, "all")
    assert [r.name for r in chosen.orderBy("rank").collect()] == list("abcdef") and missing == []


def test_policy_names_no_service():
    assert (sinks.ModelPolicy().model, sinks.ModelPolicy().api_key_env) == ("", "")
