"""Spatial joins. All are keyed by page, so overlap tests ride on hash joins and never compare documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import measures as m
from . import classify
from .pagewalk import area, fold_first, fold_runs, page_rows, shared, spread, united

PAGE = ["doc_id", "page_number"]
_SIDES = ("x0", "y0", "x1", "y1")


def _right(df: DataFrame, *columns: str) -> DataFrame:
    """Columns of the right side under names that end in r_."""
    return df.select(*[F.col(c).alias(f"r_{c}") for c in (*PAGE, *columns)])


def _same_page() -> Column:
    return (F.col("doc_id") == F.col("r_doc_id")) & (F.col("page_number") == F.col("r_page_number"))


def outside_tables(blocks: DataFrame, areas: DataFrame, share: float = 0.1) -> DataFrame:
    """Blocks of which at most ``share`` lies in a table area grown by 8 points; small fragments go too."""
    sized = areas.join(blocks.select(*PAGE, "page_width", "page_height").distinct(), PAGE)
    grown = g.expanded(g.Box.of(), F.col("page_width"), F.col("page_height"))
    right = sized.select(*PAGE, *[c.alias(n) for c, n in zip(grown, _SIDES)])
    b = g.Box.of()
    large = blocks.where((b.height >= 5) & (b.width >= 5) & (g.area(b) >= 50))
    return large.join(_right(right, *_SIDES), _same_page() & (g.containment(b, g.Box.of("r_")) > share), "left_anti")


def inside_tables(blocks: DataFrame, areas: DataFrame, share: float = 0.1) -> DataFrame:
    """Blocks that lie in a table area or overlap one, and fragments."""
    b, t = g.Box.of(), g.Box.of("r_")
    hit = g.within(b, t, 0.0) | (g.containment(b, t) > share) | (g.area(b) < 50)
    return blocks.join(_right(areas, *_SIDES), _same_page() & hit, "left_semi")


def without_nested(blocks: DataFrame, inside: float = 0.92, smaller: float = 0.9) -> DataFrame:
    """Drops blocks that lie almost wholly in a larger one of the page."""
    a, b = g.Box.of(), g.Box.of("r_")
    nested = (F.col("seq") != F.col("r_seq")) & (g.containment(a, b) > inside) & (g.area(a) < g.area(b) * smaller)
    return blocks.join(_right(blocks, "seq", *_SIDES), _same_page() & nested, "left_anti")


def last_of_duplicates(blocks: DataFrame, overlap: float = 0.9) -> DataFrame:
    """Of boxes that nearly coincide the last one stays."""
    later = (F.col("r_seq") > F.col("seq")) & (g.iou(g.Box.of(), g.Box.of("r_")) > overlap)
    return blocks.join(_right(blocks, "seq", *_SIDES), _same_page() & later, "left_anti")


def exact_duplicates_dropped(elements: DataFrame) -> DataFrame:
    """The first element of each type, box and text on a page."""
    w = W.partitionBy(*PAGE, "element_type", "text", *_SIDES).orderBy("seq")
    return elements.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def absorb_overlaps(blocks: DataFrame, share: float = 0.8) -> DataFrame:
    """Blocks that mostly cover each other become one, the first of them; greedy and not transitive."""
    own = blocks.withColumn("own", F.struct(*_SIDES))

    def covers(a: Column, b: Column) -> Column:
        both = shared(a["own"], b["own"])
        return (both / F.greatest(area(a["own"]), F.lit(1e-8)) > share) | (both / F.greatest(area(b["own"]), F.lit(1e-8)) > share)

    def merge(a: Column, b: Column) -> Column:
        return united(a, b).withField("text", F.concat(a["text"], F.lit(" "), b["text"]))

    return spread(fold_first(page_rows(own, ("seq",)), covers, merge), blocks.columns)


def merge_growing(boxes: DataFrame, overlap: float = 0.7) -> DataFrame:
    """Greedy merging in order: a box grows by each later one whose IoU with it, as grown, is high."""

    def covers(a: Column, b: Column) -> Column:
        both = shared(a, b)
        return (both > 0) & (both / (area(a) + area(b) - both) > overlap)

    return spread(fold_first(page_rows(boxes, ("seq",)), covers, united), boxes.columns)


def merge_touching(elements: DataFrame, gap: float = 5.0, overlap: float = 0.1) -> DataFrame:
    """Drawn boxes: an element joins the page's current group of its type if it is close to or overlaps any member."""
    own = elements.withColumns({"own": F.struct(*_SIDES), "boxes": F.array(F.struct(*_SIDES)), "first": F.col("seq")})

    def touches(a: Column, b: Column) -> Column:
        return (a["element_type"] == b["element_type"]) & F.exists(a["boxes"], lambda o: _touch(b["own"], o, gap, overlap))

    def merge(a: Column, b: Column) -> Column:
        # of the members the largest lends what isn't united, the first of equal ones
        larger = area(b["own"]) > area(a["own"])
        text = F.concat(a["text"], F.lit(" "), b["text"])
        boxes, first = F.concat(a["boxes"], b["boxes"]), F.least(a["first"], b["first"])
        return F.when(larger, _group(b, united(a, b), text, boxes, first)).otherwise(_group(a, united(a, b), text, boxes, first))

    return spread(fold_runs(page_rows(own, ("y0", "x0", "seq")), touches, merge), [*own.columns]).withColumn("seq", F.col("first")).select(elements.columns)


def _group(like: Column, box: Column, text: Column, boxes: Column, first: Column) -> Column:
    for side in _SIDES:
        like = like.withField(side, box[side])
    return like.withField("text", text).withField("boxes", boxes).withField("first", first)


def _touch(a: Column, b: Column, gap: float, overlap: float) -> Column:
    dx = F.greatest(a["x0"] - b["x1"], b["x0"] - a["x1"], F.lit(0.0))
    dy = F.greatest(a["y0"] - b["y1"], b["y0"] - a["y1"], F.lit(0.0))
    both = shared(a, b)
    union = area(a) + area(b) - both
    return F.when((dx == 0) & (dy == 0), F.lit(gap >= 0) | ((union > 0) & (both / union > overlap))).otherwise(F.greatest(dx, dy) <= gap)


def figure_captions(figures: DataFrame, blocks: DataFrame, nearest: int = 10) -> DataFrame:
    """The caption of each figure: the nearest likely one of the ten blocks below it, else of the ten above."""
    cap = classify.caption_score(F.col("r_text"), g.Box.of("r_"), F.col("r_x1") * 2, F.col("r_font_size"), F.lit(12.0), F.col("r_is_italic"), F.lit(False))
    pairs = figures.join(_right(blocks, "seq", "text", "font_size", "is_italic", *_SIDES), _same_page())
    below, above = F.col("r_y0") - F.col("y1"), F.col("y0") - F.col("r_y1")
    side = F.when(below >= 0, 1).when(above >= 0, 2)
    placed = pairs.withColumns({"phase": side, "distance": F.when(below >= 0, below).otherwise(above)}).where("phase is not null")
    w = W.partitionBy(*PAGE, "image_no", "phase").orderBy("distance", "r_seq")
    near = placed.withColumn("k", F.row_number().over(w)).where(F.col("k") <= nearest).where(cap["likely"])
    first = W.partitionBy(*PAGE, "image_no").orderBy("phase", "k")
    return near.withColumn("rn", F.row_number().over(first)).where("rn = 1").select(*PAGE, "image_no", F.col("r_seq").alias("caption_seq"), F.col("phase").cast("long").alias("phase"), "distance")


def columns(blocks: DataFrame, gap: float = 0.15, share: float = 0.3) -> DataFrame:
    """Column starts per page: the two widest gaps between vertically overlapping neighbours by x; a column that is too narrow joins the one before it."""
    b = g.Box.of()
    text = blocks.where((F.char_length(F.trim("text")) > 1) & (b.width > 10) & (b.height > 5))
    w = W.partitionBy(*PAGE).orderBy("x0", "seq")
    prev = text.withColumns({f"p_{s}": F.lag(s).over(w) for s in _SIDES})
    p = g.Box.of("p_")
    space = b.x0 - p.x1
    overlap = F.least(b.y1, p.y1) - F.greatest(b.y0, p.y0)
    wide = prev.where((b.y1 > p.y0) & (b.y0 < p.y1) & (space > F.col("page_width") * gap) & (overlap / F.greatest(b.height, p.height) > share))
    top = wide.withColumn("rn", F.row_number().over(W.partitionBy(*PAGE).orderBy(space.desc(), "seq"))).where("rn <= 2")
    starts = top.groupBy(*PAGE).agg(F.sort_array(F.collect_list("x0")).alias("cuts"))
    sized = blocks.select(*PAGE, "page_width").distinct().join(starts, PAGE, "left")
    edges = F.concat(F.array(F.lit(0.0)), F.coalesce("cuts", F.array().cast("array<double>")), F.array("page_width"))
    listed = sized.withColumn("edges", edges)
    least = F.col("page_width") * 0.15
    # of at most three columns one narrow one is folded into the one before it, and the next is then skipped
    e = lambda k: F.get("edges", F.lit(k))
    n = F.size("edges") - 1
    narrow2, narrow3 = (e(2) - e(1)) <= least, (e(3) - e(2)) <= least
    folded = (
        F.when(n == 1, F.array(e(0), e(1)))
        .when((n == 2) & narrow2, F.array(e(0), e(2)))
        .when(n == 2, F.array(e(0), e(1), e(2)))
        .when(narrow2, F.array(e(0), e(2), e(3)))
        .when(narrow3, F.array(e(0), e(1), e(3)))
        .otherwise(F.col("edges"))
    )
    return listed.select(*PAGE, folded.alias("edges"))


def reading_order(blocks: DataFrame) -> DataFrame:
    """Column-major order: the first column that holds a box's centre, then top down."""
    b = g.Box.of()
    text = blocks.where((F.char_length(F.trim("text")) > 0) & (b.width > 5) & (b.height > 2))
    at = text.join(columns(blocks), PAGE)
    centre = (b.x0 + b.x1) / 2
    place = F.aggregate(F.sequence(F.lit(0), F.size("edges") - 2), F.lit(-1), lambda got, k: F.when(got >= 0, got).when((F.get(F.col("edges"), k) <= centre) & (centre <= F.get(F.col("edges"), k + 1)), k).otherwise(-1))
    w = W.partitionBy(*PAGE).orderBy("column_no", "y0", F.when(F.size("edges") <= 2, F.col("x0")), "seq")
    return at.withColumn("column_no", place).where("column_no >= 0").withColumn("position", F.row_number().over(w)).drop("edges")


def repeated_texts(blocks: DataFrame, least: float = 0.85) -> DataFrame:
    """Margin blocks that recur in like wording on other pages of the document, with those pages.

    Texts are compared once each, whatever the number of pages that carry them: a running header is one text.
    """
    margin = blocks.where((F.col("y0") < F.col("page_height") * 0.1) | (F.col("y1") > F.col("page_height") * 0.9))
    texts = margin.groupBy("doc_id", "text").agg(F.collect_set("page_number").alias("on"))
    right = texts.select(F.col("doc_id").alias("r_doc_id"), F.col("text").alias("r_text"), F.col("on").alias("r_on"))
    near = F.least(F.char_length("text"), F.char_length("r_text")) * 2 >= F.greatest(F.char_length("text"), F.char_length("r_text"))
    pairs = texts.join(right, (F.col("doc_id") == F.col("r_doc_id")) & near).where((F.col("text") == F.col("r_text")) | (m.similarity(F.col("text"), F.col("r_text")) > least))
    found = pairs.groupBy("doc_id", "text").agg(F.array_distinct(F.flatten(F.collect_list("r_on"))).alias("all_pages"))
    refs = F.array_sort(F.array_remove("all_pages", F.col("page_number")))
    out = margin.select(*PAGE, "seq", "text").join(found, ["doc_id", "text"]).select(*PAGE, "seq", refs.alias("cross_page_refs"))
    return out.where(F.size("cross_page_refs") > 0)


def captions_in_sequence(figures: DataFrame, blocks: DataFrame, reach: int = 4) -> DataFrame:
    """The caption of a figure among the next four elements of its document, on whatever page, that begins below it.

    Elements are ordered by page and from the top. A caption may owe its score to the figure itself, which is
    one of the three elements before it.
    """
    b = blocks.select("doc_id", "page_number", "seq", *_SIDES, "text", "font_size", "is_italic", F.lit("TEXT").alias("element_type"))
    f = figures.select("doc_id", "page_number", F.col("image_no").alias("seq"), *_SIDES, F.lit("FIGURE").alias("element_type"))
    every = b.unionByName(f, allowMissingColumns=True)
    w = W.partitionBy("doc_id").orderBy("page_number", "y0", "x0", "element_type", "seq")
    near = F.struct(*_SIDES, "element_type")
    at = every.withColumn("before", F.collect_list(near).over(w.rowsBetween(-3, -1)))
    cap = classify.caption_score(F.col("text"), g.Box.of(), F.col("x1") * 2, F.col("font_size"), F.lit(12.0), F.col("is_italic"), classify._near_figure(F.col("before"), g.Box.of()))
    marked = at.withColumn("likely", F.coalesce((F.col("element_type") == "TEXT") & cap["likely"], F.lit(False)))
    after = marked.withColumn("after", F.collect_list(F.struct("page_number", "seq", "y0", "likely")).over(w.rowsBetween(1, reach))).where("element_type = 'FIGURE'")
    first = F.get(F.filter("after", lambda e: e["likely"] & (e["y0"] > F.col("y1"))), F.lit(0))
    return after.withColumn("c", first).where("c is not null").select("doc_id", "page_number", F.col("seq").alias("image_no"), F.col("c.page_number").alias("caption_page"), F.col("c.seq").alias("caption_seq"))
