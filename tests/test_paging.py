"""Layouts in passes over whole pages, against plain Python a page at a time."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa

from bulletria.operators import layout, paging
from bulletria.plans import corpus

FIELDS = "doc_id string, page_no int, elem_idx int, layer string, text string, l double, t double, r double, b double, width double"


def made(seed, n):
    rng, rows = random.Random(seed), []
    for i in range(n):
        l, t = rng.choice([40.0, 60.0, 200.0, 320.0, 400.0]), rng.choice([*map(float, range(100, 800, 35)), None])
        r = l + rng.choice([50, 100, 200, 350])
        b = None if t is None or rng.random() < 0.05 else t - rng.choice([0, 8, 20])
        rows.append((f"d{rng.randrange(6)}", rng.randrange(3), i, rng.choice(["body", "body", "body", "furniture"]), rng.choice([f"x{i}", None, ""]), l, t, r, b, 595.0))
    return [*rows, ("bare", 1, 0, "furniture", "f", 0.0, 1.0, 9.0, 0.0, 595.0)]


def side(x):
    l, r, mid, wide = x[5], x[7], x[9] / 2, x[7] - x[5]
    if l < mid < r and (wide > 495 * 0.55 or (abs((l + r) / 2 - mid) < 80 and wide < 495 * 0.45)):
        return 0
    return 2 if l >= mid else 1 if r <= mid else 1 if (l + r) / 2 < mid else 2


def ordered(boxes):
    """Boxes of a page in reading order."""
    s = {x: side(x) for x in boxes}
    single = not any(v == 1 for v in s.values()) or not any(v == 2 for v in s.values())
    tops = sorted((x[6] for x in boxes if s[x] and x[6] is not None), reverse=True)
    full = max((x[6] for x in boxes if not s[x] and x[6] is not None), default=None)
    ends = [min((x[8] for x in boxes if s[x] == k and x[8] is not None), default=None) for k in (1, 2)]
    bottom = max((e for e in ends if e is not None), default=None)
    turns = full is not None and tops and full < tops[len(tops) // 2]

    def key(x):
        t = x[6]
        moved = bool(s[x] and t is not None and (t <= full + 50 if turns else bottom is not None and t < bottom))
        zone = 0 if single else 2 if moved or not s[x] else s[x] - 1
        tie = (s[x] - 1 if s[x] else 2) if single else s[x]
        return zone, t is None, -(t or 0), tie, x[2]

    return sorted(boxes, key=key)


def pages_of(rows):
    pages = defaultdict(list)
    for x in rows:
        if x[3] != "furniture":
            pages[x[:2]].append(x)
    return pages


def test_order_text_and_bands_of_each_page(spark):
    for seed in range(3):
        rows = made(seed, 700)
        df, pages = spark.createDataFrame(rows, FIELDS), pages_of(rows)
        want = {(*p, x[2]): i for p, boxes in pages.items() for i, x in enumerate(ordered(boxes))}
        assert {(r.doc_id, r.page_no, r.elem_idx): r.pos for r in layout.reading_order(df).collect()} == want
        texts = {r.doc_id: r.text for r in layout.document_text(df).collect()}
        assert texts == {d: "\n\n".join("\n\n".join(x[4] for x in ordered(pages[d, p]) if x[4] is not None) for p in sorted({x[1] for x in rows if x[0] == d})) for d in {x[0] for x in rows}}
        bands = {}
        for p, boxes in pages.items():
            boxes = sorted(boxes, key=lambda x: (x[6] is not None, -(x[6] or 0), x[2]))
            bands |= {(*p, x[2]): b for x, b in zip(boxes, layout.fold_bands([x[6] for x in boxes], [x[8] for x in boxes], 1.5))}
        assert {(r.doc_id, r.page_no, r.elem_idx): r.band for r in layout.cluster_bands(df).collect()} == bands
        one, other = layout.classify_counts(layout.count_bands(df)), layout.classify_bands(layout.cluster_bands(df))
        assert sorted(one.collect(), key=str) == sorted(other.select(one.columns).collect(), key=str)
        bare = layout.document_layout(df).where("doc_id = 'bare'").first()
        assert bare.layout_confidence == 1.0 and [(p.mode, p.n_bands, p.bands) for p in bare.pages] == [("empty", None, [])]


def test_a_page_is_shuffled_once_and_sorted_by_one_number(spark, tmp_path):
    """Windows over pages sorted them four times, and a layout was made of two shuffles of all boxes."""
    lines = [(k, n, k % 11, k % 5, "R" if k % 3 else "N") for k in range(40) for n in range(1, 8)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    boxes = corpus.unnumbered(spark, str(tmp_path))
    for df, exchanges in ((layout.reading_order(boxes, corpus.BOX_ORDER), 1), (layout.count_bands(boxes, numbered_by=corpus.BOX_ORDER), 1), (layout.document_text(boxes, corpus.BOX_ORDER), 2)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == exchanges and plan.count("Scan parquet") == 1 and "Window" not in plan and "Sort [_page" in plan
    numbers = {(r.doc_id, r.page_no, r.elem_idx) for r in corpus.boxes(spark, str(tmp_path)).collect()}
    assert len(numbers) == len(lines) and {i for d, p, i in numbers if (d, p) == (7, 1)} == {1, 2, 3}


def test_pages_are_neither_cut_nor_mixed():
    """Blocks of few rows end between pages; pages that share a hash are told apart."""
    hashes = np.repeat([-5, 0, 3, 9], [4, 9, 1, 6])
    doc = np.r_[[1] * 4, [2, 3] * 4, [2], [4], [5] * 6]
    table = pa.table({"_page": hashes, "doc_id": doc, "page_no": np.ones(20, np.int32), "_body": np.ones(20, bool), "_by0": np.arange(20)[::-1].copy()})
    run = paging.whole_pages(paging.Number(("_by0", "elem_idx")), 1, True, ["doc_id", "page_no", "_by0", "elem_idx"], rows=5)
    got = pa.Table.from_batches(run(iter(table.to_batches(max_chunksize=3)))).to_pylist()
    want = {d: sorted(int(k) for k, x in zip(range(19, -1, -1), doc) if x == d) for d in range(1, 6)}
    assert len(got) == 20 and all(want[x["doc_id"]][x["elem_idx"] - 1] == x["_by0"] for x in got)


def test_runs_of_close_boxes_fold_as_single_ones():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 40))
        t = np.sort(rng.integers(0, 300, n).astype(float))[::-1]
        b = t - rng.integers(1, 12, n)
        starts = np.unique(np.r_[0, rng.integers(0, n, 2)])
        known = np.ones(n, bool)
        want = [x for i, j in zip(starts, np.r_[starts[1:], n]) for x in paging.fold_bands(t[i:j].tolist(), b[i:j].tolist(), 1.5)]
        assert paging.fold_pages((t, known), (b, known), starts, 1.5).tolist() == want


def test_layouts_are_read_in_their_own_row(spark):
    """Each document's boxes came from up to seven copies of its row, shuffled and joined."""
    rng = random.Random(6)

    def box(i):
        x = rng.choice([40, 200, 320])
        prov = [] if rng.random() < 0.1 else [(rng.choice([None, 1, 2]), None if rng.random() < 0.1 else (float(x), float(rng.randrange(700)), float(x + rng.choice([60, 200, 400])), float(rng.randrange(700))))]
        return rng.choice([f"t{i}", "", None, "  "]), rng.choice([f"o{i}", None]), rng.choice([None, "body", "furniture"]), prov

    prov = "array<struct<page_no:int,bbox:struct<l:double,t:double,r:double,b:double>>>"
    ddl = f"doc_id string, texts array<struct<text:string,orig:string,content_layer:string,label:string,prov:{prov}>>, tables array<struct<content_layer:string,prov:{prov},data:struct<grid:array<array<struct<text:string>>>,table_cells:array<struct<text:string>>>>>, pages map<string,struct<page_no:int,size:struct<width:double,height:double>>>"
    rows = []
    for d in range(12):
        boxes = [(t, o, layer, None, p) for t, o, layer, p in map(box, range(rng.choice([0, 3, 40])))]
        tables = None if d % 3 == 0 else [("body", [(1, (40.0, 300.0, 500.0, 200.0))], ([[("a",), (None,)]], None))]
        rows.append((f"d{d}", None if d == 5 else boxes, tables, None if d == 7 else {"1": (1, (500.0, 800.0)), "2": (2, None)}))
    docs = spark.createDataFrame(rows, ddl)
    read = layout.read_in_row(docs)
    assert "Exchange" not in read._jdf.queryExecution().executedPlan().toString()
    elements = layout.with_width(layout.extract_elements(docs), layout.page_sizes(docs))
    texts = {r.doc_id: r.text for r in layout.document_text(elements).collect()}
    info = {r.doc_id: (r.layout_confidence, r.pages) for r in layout.document_layout(elements).collect()}
    for r in read.collect():
        assert r.text == texts.get(r.doc_id, "") and (r.layout_confidence, r.layout_pages) == info.get(r.doc_id, (1.0, None))
