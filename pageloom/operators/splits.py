"""Content that goes on across a page break: detectors over the last and first blocks of adjacent pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import patterns as p

_BLOCK = ("seq", "text", "x0", "y0", "x1", "y1", "font_name", "font_size", "element_type")


def page_ends(elements: DataFrame) -> DataFrame:
    """first and last block of each page."""
    row, at = F.struct(*_BLOCK), F.struct("y0", "x0", "seq")
    return elements.groupBy("doc_id", "page_number").agg(F.min_by(row, at).alias("first"), F.max_by(row, at).alias("last"))


def breaks(elements: DataFrame) -> DataFrame:
    """Adjacent pages side by side: a is the page before the break, b the one after."""
    ends = page_ends(elements)
    a = ends.select("doc_id", "page_number", F.col("first").alias("a_first"), F.col("last").alias("a_last"))
    b = ends.select("doc_id", (F.col("page_number") - 1).alias("page_number"), F.col("first").alias("b_first"), F.col("last").alias("b_last"))
    return a.join(b, ["doc_id", "page_number"])


def _box(c: Column) -> Column:
    return F.struct(*[c[n].alias(n) for n in ("x0", "y0", "x1", "y1")])


def _marker(test: Column, kind: str, source: Column, target: Column | None, confidence: float) -> Column:
    """The marker where the test holds, else null."""
    void = F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double>")
    return F.when(test, F.struct(F.lit(kind).alias("split_type"), _box(source).alias("source_bbox"), (void if target is None else _box(target)).alias("target_bbox"), F.lit(confidence).alias("confidence")))


def continuations() -> list[Column]:
    """One marker for every continuation phrase in the last or the next first block."""
    return [_marker(F.col(f"{end}.text").rlike(phrase), "CONTINUATION", F.col(end), None, 0.9) for end in ("a_last", "b_first") for phrase in p.CONTINUED]


def _alike(a: Column, b: Column, reach: float) -> Column:
    return (F.abs(a["x0"] - b["x0"]) < reach) & a["font_name"].eqNullSafe(b["font_name"])


def repeated_margins() -> list[Column]:
    out = []
    for end, kind in (("first", "SPLIT_HEADER"), ("last", "SPLIT_FOOTER")):
        a, b = F.col(f"a_{end}"), F.col(f"b_{end}")
        out.append(_marker((F.trim(a["text"]) == F.trim(b["text"])) & _alike(a, b, 20), kind, a, b, 0.8))
    return out


def split_tables() -> list[Column]:
    a, b = F.col("a_last"), F.col("b_first")
    return [_marker(a["text"].rlike(p.TABLE_MENTION) & b["text"].rlike(p.TABLE_MENTION), "SPLIT_TABLE", a, b, 0.85)]


def split_lists() -> list[Column]:
    a, b = F.col("a_last"), F.col("b_first")
    both = (a["element_type"] == "LIST_ITEM") & (b["element_type"] == "LIST_ITEM")
    return [_marker(both & (F.abs(a["x0"] - b["x0"]) < 10), "SPLIT_LIST", a, b, 0.9)]


def split_paragraphs() -> list[Column]:
    a, b = F.col("a_last"), F.col("b_first")
    both = (a["element_type"] == "TEXT") & (b["element_type"] == "TEXT")
    open_ = ~F.trim(a["text"]).rlike(r"[.!?]$") & ~F.trim(b["text"]).rlike(r"^[\x{2022}\x{25AA}\x{25AB}\x{25CB}\x{25A0}\x{25A1}\x{25CF}\x{25C6}\x{25C7}\x{25B6}\x{25B7}-]")
    return [_marker(both & open_ & _alike(a, b, 15) & (F.abs(a["font_size"] - b["font_size"]) < 0.5), "SPLIT_PARAGRAPH", a, b, 0.8)]


def split_markers(elements: DataFrame) -> DataFrame:
    """All markers of all five detectors, from one pass over the page breaks."""
    every = F.array(*continuations(), *repeated_margins(), *split_tables(), *split_lists(), *split_paragraphs())
    each = breaks(elements).select("doc_id", "page_number", F.explode(F.filter(every, lambda m: m.isNotNull())).alias("m"))
    return each.select("doc_id", "m.split_type", F.col("page_number").alias("source_page"), (F.col("page_number") + 1).alias("target_page"), "m.source_bbox", "m.target_bbox", "m.confidence")


def marker_order() -> list[Column]:
    return [F.col("source_page").asc(), F.col("source_bbox.y0").desc()]


def in_order(markers: DataFrame) -> DataFrame:
    """position: the place of each marker in its document by source page, and from the lowest source box up."""
    w = W.partitionBy("doc_id").orderBy(*marker_order(), "split_type", "target_page", F.to_json("target_bbox"))
    return markers.withColumn("position", F.row_number().over(w))


def continuing(markers: DataFrame) -> DataFrame:
    return markers.where(F.col("split_type") == "CONTINUATION")


def splitting(markers: DataFrame) -> DataFrame:
    return markers.where(F.col("split_type") != "CONTINUATION")


def of_page(markers: DataFrame, page: int) -> DataFrame:
    return markers.where((F.col("source_page") == page) | (F.col("target_page") == page))


def annotate(elements: DataFrame, markers: DataFrame, least: float = 0.7) -> DataFrame:
    """splits: the markers whose source or target box covers most of the element."""
    box = g.Box.of()

    def side(page: str, bbox: str, role: str) -> DataFrame:
        right = markers.where(F.col(bbox).isNotNull()).select(F.col("doc_id").alias("m_doc"), F.col(page).alias("m_page"), "split_type", "confidence", *[F.col(f"{bbox}.{n}").alias(f"m_{n}") for n in ("x0", "y0", "x1", "y1")])
        on = (F.col("doc_id") == F.col("m_doc")) & (F.col("page_number") == F.col("m_page")) & (g.containment(box, g.Box.of("m_")) > least)
        return elements.join(right, on).select("doc_id", "page_number", "seq", F.struct("split_type", F.lit(role).alias("role"), "confidence").alias("s"))

    both = side("source_page", "source_bbox", "source").unionAll(side("target_page", "target_bbox", "target"))
    lists = both.groupBy("doc_id", "page_number", "seq").agg(F.array_sort(F.collect_list("s")).alias("splits"))
    return elements.join(lists, ["doc_id", "page_number", "seq"], "left")
