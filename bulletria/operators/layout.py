"""Reading order: boxes on two-column pages to text, with a confidence a page.

elements: (doc_id, page_no, elem_idx, layer, text, l, t, r, b), with the origin at
the bottom left; pages: (doc_id, page_no, width). Boxes are brought together by
page once (by_page()); what is found on a page is found by numpy, many pages at a
time (paging.py). Elements may come without elem_idx: then numbered_by names the
columns whose order on a page gives it, and it is made in the same pass.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import WHITE, is_blank, round3, settled
from . import paging

PAGE_WIDTH = 595.0
WIDE, CENTRED_WIDTH, CENTRED_REACH = 0.55, 0.45, 80
GAP = 1.5
MODES = ("full_width", "one_col", "mixed", "two_col")

_PROV = "array<struct<page_no:int,bbox:struct<l:double,t:double,r:double,b:double>>>"
LAYOUT_DOCUMENT = (
    "schema_name string, version string, name string, "
    f"texts array<struct<self_ref:string,label:string,content_layer:string,text:string,orig:string,prov:{_PROV}>>, "
    f"tables array<struct<self_ref:string,label:string,content_layer:string,prov:{_PROV},"
    "data:struct<grid:array<array<struct<text:string>>>,table_cells:array<struct<text:string>>>>>, "
    "pages map<string,struct<page_no:int,size:struct<width:double,height:double>>>"
)


def table_text(data: Column) -> Column:
    """Cells of a row joined by " | ", empty ones too; without a grid, those that have text."""

    def cell(c: Column) -> Column:
        return F.coalesce(c["text"], F.lit(""))

    rows = F.transform(data["grid"], lambda row: F.array_join(F.transform(row, cell), " | "))
    loose = F.filter(F.transform(data["table_cells"], cell), lambda c: c != "")
    return F.when(F.coalesce(F.size(data["grid"]), F.lit(0)) > 0, F.array_join(rows, "\n")).otherwise(F.coalesce(F.array_join(loose, " | "), F.lit("")))


def extract_elements(docs: DataFrame) -> DataFrame:
    """Boxes of (doc_id, texts, tables): texts first, each at its first place, blank ones left out."""
    texts = docs.select("doc_id", F.posexplode("texts").alias("elem_idx", "e"))
    own = F.coalesce(F.nullif(F.col("e.text"), F.lit("")), F.col("e.orig"), F.lit(""))
    texts = texts.select("doc_id", "elem_idx", own.alias("text"), F.col("e.label").alias("label"), F.col("e.content_layer").alias("layer"), F.col("e.prov").alias("prov"))
    tables = docs.select("doc_id", F.coalesce(F.size("texts"), F.lit(0)).alias("base"), F.posexplode("tables").alias("i", "e"))
    tables = tables.select("doc_id", (F.col("base") + F.col("i")).alias("elem_idx"), table_text(F.col("e.data")).alias("text"), F.lit("table").alias("label"), F.col("e.content_layer").alias("layer"), F.col("e.prov").alias("prov"))
    both = texts.unionByName(tables).withColumn("p", F.get("prov", F.lit(0))).where(F.col("p.bbox").isNotNull() & ~is_blank(F.col("text")))
    box = [F.coalesce(F.col(f"p.bbox.{k}"), F.lit(0.0)).alias(k) for k in "ltrb"]
    return both.select("doc_id", F.coalesce("p.page_no", F.lit(1)).alias("page_no"), "elem_idx", F.coalesce("layer", F.lit("body")).alias("layer"), F.coalesce("label", F.lit("text")).alias("label"), "text", *box)


def page_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, page_no, width, height) of the pages that state a size."""
    pages = docs.select("doc_id", F.explode(F.map_values("pages")).alias("p")).where(F.col("p.size").isNotNull() & F.col("p.page_no").isNotNull())
    return pages.select("doc_id", "p.page_no", F.coalesce("p.size.width", F.lit(PAGE_WIDTH)).alias("width"), F.coalesce("p.size.height", F.lit(842.0)).alias("height"))


def with_width(elements: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    if pages is None:
        return elements.withColumn("width", F.lit(PAGE_WIDTH))
    return elements.join(pages.select("doc_id", "page_no", "width"), ["doc_id", "page_no"], "left").withColumn("width", F.coalesce("width", F.lit(PAGE_WIDTH)))


def classify_zones(elements: DataFrame) -> DataFrame:
    """elements with zone: furniture, full, centred, left, right, or a side by the box's centre."""
    l, r, w = F.col("l"), F.col("r"), F.col("width")
    mid, area, wide = w / 2, w - 100, F.col("r") - F.col("l")
    spans = (l < mid) & (r > mid)
    zone = (
        F.when(F.col("layer") == "furniture", "furniture")
        .when(spans & (wide > area * F.lit(WIDE)), "full")
        .when(spans & (F.abs((l + r) / 2 - mid) < CENTRED_REACH) & (wide < area * F.lit(CENTRED_WIDTH)), "centred")
        .when(l >= mid, "right")
        .when(r <= mid, "left")
        .when((l + r) / 2 < mid, "left_by_centre")
        .otherwise("right_by_centre")
    )
    return elements.withColumn("zone", zone)


def by_page(rows: DataFrame, *key: str | Column) -> DataFrame:
    """rows with _page, a hash of the key; those of a page lie together. What keeps their order needs no second shuffle.

    One number is sorted by its digits, without comparing rows.
    """
    spark = rows.sparkSession
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return rows.withColumn("_page", F.xxhash64(*(key or ("doc_id", "page_no")))).repartition(count, "_page").sortWithinPartitions("_page")


def _in_pages(elements: DataFrame, run: paging.Run, columns: dict[str, Column], numbered_by: Sequence[str], out: Sequence[T.StructField], furniture: bool = False) -> DataFrame:
    """The rows that run makes of whole pages; out: its columns behind doc_id and page_no. furniture: whether a page of nothing else counts."""
    body = F.coalesce(F.col("layer") != "furniture", F.lit(False))
    if not (numbered_by or furniture):
        elements = elements.where(body)
    placed = elements if "_page" in elements.columns else by_page(elements)
    order = list(numbered_by) or (["elem_idx"] if "elem_idx" in elements.columns else [])
    inner = placed.select("_page", "doc_id", "page_no", body.alias("_body"), *[F.col(c).alias(f"_by{i}") for i, c in enumerate(order)], *[c.alias(k) for k, c in columns.items()])
    schema = T.StructType([elements.schema["doc_id"], elements.schema["page_no"], *out])
    return inner.mapInArrow(paging.whole_pages(run, len(order), bool(numbered_by), schema.fieldNames()), schema)


def _kept(df: DataFrame, keep: Sequence[str], numbered_by: Sequence[str]) -> tuple[dict[str, Column], list[T.StructField]]:
    """Columns that a pass carries along, and their fields; elem_idx is carried as what orders boxes."""
    fields = [T.StructField("elem_idx", T.IntegerType()) if c == "elem_idx" and numbered_by else df.schema[c] for c in keep if c not in ("doc_id", "page_no")]
    return {f.name: F.col(f.name) for f in fields if not (f.name == "elem_idx" and numbered_by)}, fields


def _sides(elements: DataFrame) -> DataFrame:
    """Elements with zone and _side: 1 on the left, 2 on the right, 0 on both."""
    zoned = classify_zones(elements)
    return zoned.withColumn("_side", F.when(F.col("zone").isin("left", "left_by_centre"), 1).when(F.col("zone").isin("right", "right_by_centre"), 2).otherwise(0).cast("tinyint"))


def numbered(elements: DataFrame, numbered_by: Sequence[str], keep: Sequence[str] | None = None) -> DataFrame:
    """elements, furniture too, with elem_idx, from 1 on each page."""
    keep = [*(c for c in elements.columns if c != "_page"), "elem_idx"] if keep is None else keep
    columns, fields = _kept(elements, keep, numbered_by)
    return _in_pages(elements, paging.Number(tuple(f.name for f in fields)), columns, numbered_by, fields).select(*keep)


def reading_order(elements: DataFrame, numbered_by: Sequence[str] = (), keep: Sequence[str] | None = None) -> DataFrame:
    """elements of the body with pos, from 0, in reading order on their page. keep: the columns wanted besides, all and zone by default.

    Left column, right column, then what spans both or lies under the point
    where the page turns to full width. A page without one of the columns is
    read from top to bottom. Ties keep the order of the lists that boxes came
    from: full first, then moved left and right ones, each by elem_idx.
    """
    zoned = _sides(elements)
    if keep is None:
        keep = [*(c for c in elements.columns if c != "_page"), *(["elem_idx"] if numbered_by else []), "zone"]
    columns, fields = _kept(zoned, keep, numbered_by)
    need = {"_side": F.col("_side"), "_t": F.col("t"), "_b": F.col("b")}
    run = paging.Order(tuple(f.name for f in fields))
    return _in_pages(zoned, run, columns | need, numbered_by, [*fields, T.StructField("pos", T.IntegerType())]).select(*keep, "pos")


def document_text(elements: DataFrame, numbered_by: Sequence[str] = ()) -> DataFrame:
    """(doc_id, text): boxes in reading order, joined by blank lines, page by page.

    A page with nothing but furniture adds an empty text.
    """
    need = {"text": F.col("text"), "_side": F.col("_side"), "_t": F.col("t"), "_b": F.col("b")}
    texts = _in_pages(_sides(elements), paging.Text(), need, numbered_by, [T.StructField("x", T.StringType())], furniture=True)
    whole = texts.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page_no", "x"))).alias("ps"))
    return whole.select("doc_id", F.array_join(F.transform("ps", lambda p: p["x"]), "\n\n").alias("text"))


def cluster_bands(elements: DataFrame, gap: float = GAP, numbered_by: Sequence[str] = (), keep: Sequence[str] = ("doc_id", "page_no", "elem_idx", "l", "t", "r", "b", "width")) -> DataFrame:
    """elements of the body with band, from 0, down the page.

    A band ends where the space below it exceeds gap times the height of its
    highest box. That height starts anew with each band, so this is a fold over
    the page's sorted boxes.
    """
    columns, fields = _kept(elements, keep, numbered_by)
    run = paging.Bands(gap, tuple(f.name for f in fields))
    return _in_pages(elements, run, columns | {"_t": F.col("t"), "_b": F.col("b")}, numbered_by, [*fields, T.StructField("band", T.IntegerType())]).select(*keep, "band")


fold_bands = paging.fold_bands

_COUNTS = ("n", "w", "lt", "rt")


def _flags() -> dict[str, Column]:
    """Whether a box is wide, lies on the left, lies on the right."""
    mid, wide = F.col("width") / 2, (F.col("r") - F.col("l")) > (F.col("width") - 100) * F.lit(WIDE)
    return {k: F.coalesce(c, F.lit(False)) for k, c in (("w", wide), ("lt", F.col("r") <= mid), ("rt", F.col("l") >= mid))}


def count_bands(elements: DataFrame, gap: float = GAP, numbered_by: Sequence[str] = (), empty: bool = False) -> DataFrame:
    """(doc_id, page_no, band, n, w, lt, rt): the boxes of each band, and which of them are wide, left and right.

    empty: with a row of no band for pages of nothing but furniture.
    """
    out = [T.StructField("band", T.IntegerType()), *[T.StructField(k, T.LongType()) for k in _COUNTS]]
    return _in_pages(elements, paging.Counts(gap), _flags() | {"_t": F.col("t"), "_b": F.col("b")}, numbered_by, out, furniture=empty)


def band_mode(n: Column, w: Column, lt: Column, rt: Column) -> tuple[Column, Column]:
    """Mode and confidence, not rounded, of a band of so many boxes."""
    vague = n - lt - rt - w
    full = w >= F.greatest(F.lit(1), F.floor(n / 2))
    one, mixed = (lt == 0) | (rt == 0), vague / n > 0.3
    mode = F.when(full, "full_width").when(one, "one_col").when(mixed, "mixed").otherwise("two_col")
    clear = (lt + rt) / n
    confidence = (
        F.when(full, F.when(w == n, F.lit(1.0)).otherwise(F.lit(0.8)))
        .when(one, F.greatest(F.lit(0.5), F.lit(1.0) - vague / n))
        .when(mixed, F.greatest(F.lit(0.3), clear))
        .otherwise(clear)
    )
    return mode, confidence


def classify_counts(counts: DataFrame) -> DataFrame:
    """(doc_id, page_no, band, mode, confidence, n_elements) of count_bands(); confidence isn't rounded."""
    mode, confidence = band_mode(*[F.col(c) for c in _COUNTS])
    some = F.col("n") > 0
    return counts.select("doc_id", "page_no", "band", F.when(some, mode).alias("mode"), F.when(some, confidence).alias("confidence"), F.col("n").alias("n_elements"))


def classify_bands(banded: DataFrame) -> DataFrame:
    """The same of cluster_bands()."""
    counts = banded.groupBy("doc_id", "page_no", "band").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(k) for k, c in _flags().items()])
    return classify_counts(counts)


def _page_parts(bs: Column) -> dict[str, Column]:
    """What a page is, by its bands in order: array<struct<band, mode, confidence, n_elements>>."""

    def of(mode: str) -> Column:
        return F.filter(bs, lambda b: b["mode"] == mode)

    own = [of(m) for m in MODES]
    found = F.filter(F.array(*[F.struct(F.size(x).alias("c"), (-F.get(x, F.lit(0))["band"]).alias("first"), F.lit(m).alias("mode")) for m, x in zip(MODES, own)]), lambda m: m["c"] > 0)
    top = F.array_max(found)["mode"]
    weighted = F.aggregate(bs, F.lit(0.0), lambda a, b: a + b["confidence"] * b["n_elements"])
    total = F.aggregate(bs, F.lit(0).cast("bigint"), lambda a, b: a + b["n_elements"])
    shown = F.transform(bs, lambda b: F.struct(b["mode"].alias("mode"), round3(b["confidence"]).alias("confidence"), b["n_elements"].cast("int").alias("n_elements")))
    mode = F.when(F.size(found) > 1, F.concat(F.lit("hybrid ("), top, F.lit(" dominant)"))).otherwise(top)
    return {"layout_confidence": round3(weighted / F.greatest(F.lit(1), total)), "mode": mode, "n_bands": F.size(bs), "bands": shown, "n_body": total}


def page_layout(bands: DataFrame) -> DataFrame:
    """(doc_id, page_no, layout_confidence, mode, n_bands, bands, n_body) of each page with a body."""
    some = bands.where("band is not null")
    listed = some.groupBy("doc_id", "page_no").agg(F.sort_array(F.collect_list(F.struct("band", "mode", "confidence", "n_elements"))).alias("bs"))
    return listed.select("doc_id", "page_no", *[c.alias(k) for k, c in _page_parts(F.col("bs")).items()])


def _page_struct(page_no: Column, bs: Column) -> Column:
    """A page with its place, its parts, and n; one without bands is empty, of confidence 1."""
    p, none = _page_parts(bs), F.size(bs) == 0
    one = F.struct(
        page_no.alias("page_no"), F.when(none, F.lit(1.0)).otherwise(p["layout_confidence"]).alias("layout_confidence"), F.when(none, F.lit("empty")).otherwise(p["mode"]).alias("mode"),
        F.when(~none, p["n_bands"]).alias("n_bands"), p["bands"].alias("bands"),
    )
    return F.struct(page_no.alias("page_no"), one.alias("p"), p["n_body"].alias("n"))


def _document_confidence(ps: Column) -> Column:
    weighted = F.aggregate(ps, F.lit(0.0), lambda a, x: a + x["p"]["layout_confidence"] * x["n"])
    total = F.aggregate(ps, F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    return F.when(total == 0, F.lit(1.0)).otherwise(round3(weighted / total))


def document_layout(elements: DataFrame, gap: float = GAP, numbered_by: Sequence[str] = ()) -> DataFrame:
    """(doc_id, layout_confidence, pages); pages without a body have mode "empty"."""
    bands = classify_counts(count_bands(elements, gap, numbered_by, empty=True))
    one = F.when(F.col("band").isNotNull(), F.struct("band", "mode", "confidence", "n_elements"))
    pages = bands.groupBy("doc_id", "page_no").agg(F.sort_array(F.collect_list(one)).alias("bs"))
    listed = pages.select("doc_id", _page_struct(F.col("page_no"), F.col("bs")).alias("x")).groupBy("doc_id").agg(F.sort_array(F.collect_list("x")).alias("ps"))
    return listed.select("doc_id", _document_confidence(F.col("ps")).alias("layout_confidence"), F.transform("ps", lambda x: x["p"]).alias("pages"))


_READ = "struct<text:string,lengths:array<int>,pages:array<struct<page_no:int,bands:array<struct<band:int,n:bigint,w:bigint,lt:bigint,rt:bigint>>>>>"


def read_in_row(docs: DataFrame, gap: float = GAP) -> DataFrame:
    """docs of (texts, tables, pages) with text, lengths, layout_confidence and layout_pages in their place.

    The text is that of document_text(), lengths those of the stripped texts;
    layout_confidence and layout_pages are those of document_layout(), 1 and null
    for a document without any box. All boxes of a document are in its row, so
    nothing is shuffled, and no row is made twice.
    """

    @F.arrow_udf(_READ)
    def read(texts: pa.Array, tables: pa.Array, sizes: pa.Array) -> pa.Array:
        return paging.read_layouts(texts, tables, sizes, WHITE, PAGE_WIDTH, gap, (WIDE, CENTRED_WIDTH, CENTRED_REACH))

    tables = F.transform("tables", lambda e: F.struct(table_text(e["data"]).alias("text"), e["content_layer"].alias("content_layer"), e["prov"].alias("prov")))
    stated = F.filter(F.map_values("pages"), lambda p: p["size"].isNotNull() & p["page_no"].isNotNull())
    sizes = F.transform(stated, lambda p: F.struct(p["page_no"].alias("page_no"), F.coalesce(p["size"]["width"], F.lit(PAGE_WIDTH)).alias("width")))
    rest = [c for c in docs.columns if c not in ("texts", "tables", "pages")]
    done = settled(docs.select(*rest, "texts", tables.alias("_tables"), sizes.alias("_sizes")), _read=read("texts", "_tables", "_sizes"))

    def classified(b: Column) -> Column:
        mode, confidence = band_mode(*[b[c] for c in _COUNTS])
        return F.struct(b["band"].alias("band"), mode.alias("mode"), confidence.alias("confidence"), b["n"].alias("n_elements"))

    classed = F.transform(F.col("_read.pages"), lambda p: F.struct(p["page_no"].alias("page_no"), F.transform(p["bands"], classified).alias("bs")))
    placed = settled(done.select(*rest, "_read.text", "_read.lengths", classed.alias("_classed")), _ps=F.transform("_classed", lambda p: _page_struct(p["page_no"], p["bs"])))
    some = F.size("_ps") > 0
    return placed.select(*rest, "text", "lengths", F.when(some, _document_confidence(F.col("_ps"))).otherwise(F.lit(1.0)).alias("layout_confidence"), F.when(some, F.transform("_ps", lambda x: x["p"])).alias("layout_pages"))


def listed_layouts(elements: DataFrame, numbered_by: Sequence[str]) -> DataFrame:
    """(doc_id, texts, nos): layout documents made of boxes that lie together by document, and the numbers of their pages."""
    prov = "array<struct<page_no:int,bbox:struct<l:double,t:double,r:double,b:double>>>"
    out = T.StructType.fromDDL(f"texts array<struct<label:string,content_layer:string,text:string,orig:string,prov:{prov}>>, nos array<int>").fields
    return _in_pages(elements, paging.Listed(), {k: F.col(k) for k in ("text", "layer", "l", "t", "r", "b")}, numbered_by, out).select("doc_id", "texts", "nos")
