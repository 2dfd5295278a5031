"""Rule-based classifiers as ordered CASE cascades. Scores are kept in hundredths, so thresholds are exact."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import measures as m
from ..functions import patterns as p
from . import stats

PAGE = ["doc_id", "page_number"]

#: names that are other names for the same type
ALIASES = {"PAGE_NUMBER": "TEXT", "FOOTER": "TEXT", "FOOTNOTE": "TEXT", "CAPTION": "TEXT", "CONTACT_INFO": "TEXT", "ANNOTATION": "TEXT", "NARRATIVE_TEXT": "TEXT", "HEADER": "TITLE", "TABLE_CELL": "TABLE_BODY", "UNKNOWN": "DISCARDED"}


def points(*terms: tuple[Column, int]) -> Column:
    """The sum of the points whose conditions hold."""
    return reduce(add, [F.when(c, n).otherwise(0) for c, n in terms])


def canonical_type(subtype: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    return F.coalesce(F.get(F.array(table[subtype]), F.lit(0)), subtype)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


# --- the fast parser -------------------------------------------------------------------------------


def fast_elements(blocks: DataFrame) -> DataFrame:
    """element_type and confidence by the fast cascade: page number, list item, title, margin, narrative.

    One aggregation finds each page's body font; the join back is on the page.
    """
    b, text = g.Box.of(), F.trim("text")
    at = blocks.join(stats.body_font(blocks), PAGE)
    h, w, size, body = F.col("page_height"), F.col("page_width"), F.col("font_size"), F.col("body_font_size")
    edge = F.least(h, w) * 0.1
    number = text.rlike(r"^(?:\d+|Page\s+\d+(?:\s+of\s+\d+)?|\d+\s*/\s*\d+|-\s*\d+\s*-)$") & ((b.y0 < edge) | (b.y0 > h - edge)) & (F.char_length(text) < 20) & (size <= body)
    centred = F.abs((b.x0 + b.x1) / 2 - w / 2) < w * 0.2
    large = size / body > 1.2
    title = large & (word_count(text) <= 20) & (centred | ((text != "") & ~text.rlike(r"[.!?:]$")))
    title_points = F.lit(70) + points((F.col("is_bold"), 10), (centred, 10), (size / body > 1.5, 10))
    lines = F.size(F.split("text", "\n"))
    margin = ((b.y0 < h * 0.15) | (b.y1 > h - h * 0.15)) & (lines <= 2)
    margin_points = F.lit(70) + points((F.abs(size - body) > 1.0, 10), (lines == 1, 10), (F.col("is_bold"), 10))
    kind = (
        F.when(number, "PageNumber").when(p.list_pattern(text).isNotNull(), "ListItem").when(title, "Title")
        .when(margin & (b.y0 < h / 2), "Header").when(margin, "Footer").when(text != "", "NarrativeText").otherwise("UncategorizedText")
    )
    score = F.when(number, 100).when(kind == "ListItem", 90).when(title, title_points).when(margin, margin_points).when(text != "", 70).otherwise(50)
    return at.withColumns({"element_type": kind, "confidence": score / 100})


def fast_counts(blocks: DataFrame) -> DataFrame:
    return fast_elements(blocks).groupBy(*PAGE, "element_type").agg(F.count("*").alias("n"))


# --- the main classifier ---------------------------------------------------------------------------


def caption_score(text: Column, box: g.Box, page_width: Column, font_size: Column, median_size: Column, italic: Column, near_figure: Column) -> dict[str, Column]:
    """points (hundredths) and whether the text is a likely caption."""
    text = F.trim(text)
    n = word_count(text)
    short = (n <= 40) & (F.char_length(text) <= 300) & (text != "")
    centre = (box.x0 + box.x1) / 2 / page_width
    soft = points(
        ((n >= 3) & (n <= 30), 15), ((page_width > 0) & centre.between(0.4, 0.6), 5), (near_figure, 40), ((font_size > 0) & (median_size > 0) & (font_size / median_size < 0.92), 5),
        (italic, 5), (F.lower(text).rlike(p.CAPTION_WORDS), 5), (~text.contains("\n"), 5),
    )
    score = F.when(~short, 0).when(p.matches(text, p.CAPTION), 95).otherwise(soft)
    return {"points": score, "likely": score >= 70}


def title_score(text: Column, has_style: Column, bold: Column, font_size: Column, relative_x: Column, known: dict[str, Column] | None = None) -> dict[str, Column]:
    """points (hundredths), level of a section number, and whether the text is a possible title (over 40).

    ``known`` are the measures of the trimmed text and its noun_ratio, if they are at hand.
    """
    text = F.trim(text)
    s = known or {**m.measured(text), "noun_ratio": m.noun_ratio(text)}
    section = F.regexp_extract(text, p.java(p.SECTION_NUMBER), 1)
    level = F.when(section != "", F.size(F.split(section, r"\.")))
    score = points(
        (s["word_count"] <= 8, 10), (text.rlike(r"[.:;!?]$"), -10), ((s["word_count"] > 0) & (s["noun_ratio"] > 0.5), 10), (has_style & bold, 15), (has_style & (font_size > 12.0), 10),
        (has_style & s["is_all_caps"], 10), (F.abs(relative_x - 0.5) < 0.2, 5), (level.isNotNull(), 40), (F.lower(text).rlike(p.TITLE_LOWER), 30), (s["word_count"] > 15, -20),
        (s["has_verb"], -10), (s["cap_ratio"] > 0.7, 10), (s["sentence_count"] > 2, -20), (has_style & bold & (font_size >= s["avg_word_length"] * 1.2), 5),
    )
    return {"points": score, "level": level, "is_title": (F.char_length(text) >= 2) & (score > 40)}


def isolation(above: Column, below: Column, box: g.Box, page_height: Column, median_size: Column) -> Column:
    """Whether the gaps to the nearest of the three blocks before and after are wide."""
    roof = F.coalesce(F.array_max(F.filter(F.transform(above, lambda e: e["y1"]), lambda y: y < box.y0)), F.lit(0.0))
    floor = F.coalesce(F.array_min(F.filter(F.transform(below, lambda e: e["y0"]), lambda y: y > box.y1)), page_height)
    up, down = box.y0 - roof, floor - box.y1
    return ((up > median_size * 1.5) & (down > median_size * 1.5)) | (up > median_size * 2) | (down > median_size * 2)


def with_context(elements: DataFrame) -> DataFrame:
    """before and after: the three neighbours on either side, nearest last and first."""
    w = W.partitionBy(*PAGE).orderBy("y0", "x0", "seq")
    near = F.struct("x0", "y0", "x1", "y1", "element_type")
    return elements.withColumns({"before": F.collect_list(near).over(w.rowsBetween(-3, -1)), "after": F.collect_list(near).over(w.rowsBetween(1, 3))})


def _near_figure(before: Column, box: g.Box) -> Column:
    """One of the three before is a figure or table of some size, up to 40 points above and mostly over it."""
    def over(e: Column) -> Column:
        gap = box.y0 - e["y1"]
        shared = F.greatest(F.lit(0.0), F.least(box.x1, e["x1"]) - F.greatest(box.x0, e["x0"]))
        sized = (e["x1"] - e["x0"]) * (e["y1"] - e["y0"]) >= 400
        return sized & (gap > 0) & (gap <= 40) & (box.width > 0) & (shared / box.width > 0.5) & F.lower(e["element_type"]).rlike("image|figure|table|chart")

    return F.exists(before, over)


def _beside_body(neighbours: Column, box: g.Box, reach: Column) -> Column:
    """A figure or table among the neighbours that overlaps the box and has an edge within reach."""
    def beside(e: Column) -> Column:
        other = g.Box(e["x0"], e["y0"], e["x1"], e["y1"])
        distance = F.least(F.abs(other.y1 - box.y0), F.abs(box.y1 - other.y0))
        return e["element_type"].isin("FIGURE", "TABLE_BODY") & (distance <= reach) & (g.intersection(other, box) > 0)

    return F.exists(neighbours, beside)


def main_elements(blocks: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """element_type, element_subtype, confidence and title_level by the main cascade.

    ``others`` (doc_id, page_number, seq, box, element_type) are figures and tables that serve as context.
    The document's median size is aggregated and joined back by document.
    """
    typed = blocks.withColumn("element_type", F.lit("TEXT"))
    if others is not None:
        typed = typed.unionByName(others, allowMissingColumns=True)
    medians = blocks.groupBy("doc_id").agg(F.median("font_size").alias("median_size"))
    at = with_context(typed).where(F.col("text").isNotNull()).drop("element_type").join(medians, "doc_id")
    added = list(at.columns)
    b, text, size, middle = g.Box.of(), F.col("trimmed"), F.col("font_size"), F.col("median_size")
    # the cascade names these often; as columns they are worked out once a row
    at = at.withColumn("trimmed", F.trim("text"))
    at = at.withColumns({**{f"its_{k}": v for k, v in m.measured(text).items()}, "its_noun_ratio": m.noun_ratio(text)})
    s = {c.removeprefix("its_"): F.col(c) for c in at.columns if c.startswith("its_")}
    scored = {
        "cap": caption_score(text, b, F.col("page_width"), size, middle, F.col("is_italic"), _near_figure(F.col("before"), b)),
        "title": title_score(text, F.lit(True), F.col("is_bold"), size, b.x0 / F.col("page_width"), s),
    }
    at = at.withColumns({"cap_points": scored["cap"]["points"], "score_points": scored["title"]["points"], "score_level": scored["title"]["level"]})
    cap = {"points": F.col("cap_points"), "likely": F.col("cap_points") >= 70}
    title = {"points": F.col("score_points"), "level": F.col("score_level"), "is_title": (F.char_length(text) >= 2) & (F.col("score_points") > 40)}
    lower = F.lower(text)
    attached = (F.size("before") > 0) & cap["likely"] & (cap["points"] > 70) & _beside_body(F.concat("before", "after"), b, middle * 2)
    # a figure or table caption is believed even where no body is near
    named = (F.size("before") > 0) & cap["likely"] & (cap["points"] > 70) & lower.rlike("^(?:figure|table)")
    figure, table = lower.startswith("figure"), lower.startswith("table")
    single = (s["sentence_count"] == 1) & ~s["has_verb"] & (s["word_count"] <= 8) & (size > middle * 1.1)
    lone = single & (s["cap_ratio"] >= 0.6) & (s["noun_ratio"] > 0.5) & ~text.rlike(r"[.:;!?]$") & isolation(F.col("before"), F.col("after"), b, F.col("page_height"), middle)
    listed = (size <= middle * 1.1) & ~F.col("is_bold") & p.list_item(text)
    fallen = (F.size("before") > 0) & cap["likely"] & (cap["points"] > 70)
    level_bonus = F.when(title["level"].isNotNull(), 10 * (4 - title["level"])).otherwise(0)
    title_points = F.least(F.lit(100), F.greatest(F.lit(70), F.least(F.lit(100), title["points"])) + level_bonus)
    cases = [
        (text == "", "DISCARDED", F.lit(100)), (named & figure, "FIGURE_CAPTION", F.lit(95)), (named & table, "TABLE_CAPTION", F.lit(90)), (attached, "CAPTION", cap["points"]),
        (title["is_title"], "TITLE", title_points), (lone, "TITLE", F.lit(85)), (listed, "LIST_ITEM", F.lit(90)), (p.equation(text), "BLOCK_EQUATION", F.lit(90)), (single & F.col("is_bold"), "TITLE", F.lit(75)),
    ]
    kind, score = F.lit("TEXT"), F.when(fallen, 95).otherwise(70)
    at = at.withColumns({f"case_{k}": test for k, (test, _, _) in enumerate(cases)})
    for k, (_, name, value) in reversed(list(enumerate(cases))):
        kind, score = F.when(F.col(f"case_{k}"), name).otherwise(kind), F.when(F.col(f"case_{k}"), value).otherwise(score)
    made = [c for c in at.columns if c not in added]
    out = at.withColumns({"element_subtype": kind, "points": score, "level": F.when(title["is_title"] & (title_points > 85), title["level"])})
    return out.withColumns({"element_type": canonical_type(F.col("element_subtype")), "confidence": F.col("points") / 100, "title_level": F.when(F.col("element_subtype") == "TITLE", F.col("level"))}).drop("before", "after", "points", "level", "median_size", *made)


def fallback_type(text: Column, classified: Column, bold: Column) -> Column:
    """What the pre-classification says where the classifier discards: table and figure mentions, list marks, headings."""
    return F.when(classified != "DISCARDED", classified).when(text.rlike(r"(?i)^table\s+\d+"), "TABLE_CAPTION").when(text.rlike(r"(?i)^fig(?:ure)?\.?\s+\d+"), "FIGURE_CAPTION").when(text.rlike(p.LIST_START), "LIST_ITEM").when(bold & (word_count(text) < 10), "TITLE").otherwise("TEXT")


# --- the scored analyser ---------------------------------------------------------------------------

TITLE_STARTS = r"^(?:chapter|section|part|appendix)\s+(?:\d+|[ivx]+)|^\d+(?:\.\d+)*\s+[a-z]|^(?:abstract|introduction|conclusion|references|bibliography)"
LIST_MARKS = r"^[\x{2022}\x{25CF}\x{25CB}\x{25C6}\x{25AA}-]\s|^\d+[.)]\s|^[A-Za-z][.)]\s|^\([A-Za-z0-9]+\)\s"
NOTE_MARKS = r"^\d+\s|^[*\x{2020}\x{2021}]|^\[\d+\]|^note:"


def scored_elements(blocks: DataFrame) -> DataFrame:
    """element_type and confidence by points: the first of title, list item, footnote and margin with three.

    relative_y is measured from the bottom, as the scores assume.
    """
    doc = blocks.groupBy("doc_id").agg(stats.upper_median(F.col("font_size")).alias("mid"))
    # a column that is named more than once is worked out once
    at = blocks.join(doc, "doc_id").withColumn("clean", m.scored_clean(F.col("text")))
    text, size = F.col("clean"), F.col("font_size")
    up = 1 - F.col("y1") / F.col("page_height")
    edge = (up < 0.1) | (up > 0.9)
    number = (F.char_length(text) <= 3) & text.rlike(r"^\d+$") & edge
    words, lines = word_count(text), F.size(F.split("text", "\n"))
    title = points((size > F.col("mid") * 1.2, 2), (up > 0.8, 1), (words <= 10, 1), (~text.rlike(r"[.:;?!]$"), 1), (F.col("is_bold"), 1), (F.lower(text).rlike(TITLE_STARTS), 2))
    listed = points((F.trim("text").rlike(LIST_MARKS), 2), (F.col("x0") / F.col("page_width") > 0.05, 1), (F.char_length(text) < 200, 1), (lines <= 3, 1))
    note = points((text.rlike(NOTE_MARKS), 2), (up < 0.2, 1), (size < F.col("mid"), 1))
    margin = points((edge, 2), (F.lower(text).rlike(p.MARGIN_WORDS), 2), (size < F.col("mid"), 1), (F.char_length(text) < 100, 1))
    at = at.withColumns({"of_title": title, "of_list": listed, "of_note": note, "of_margin": margin})
    title, listed, note, margin = map(F.col, ("of_title", "of_list", "of_note", "of_margin"))
    kind, score = F.lit("Text"), F.lit(0)
    # a title is taken only above 0.7; below that the block stays text, as later tests aren't made
    for s, name in ((margin, "HeaderFooter"), (note, "Footnote"), (listed, "ListItem"), (title, "Title")):
        kind, score = F.when(s >= 3, name).otherwise(kind), F.when(s >= 3, F.least(F.lit(100), 50 + 10 * s)).otherwise(score)
    kind = F.when(number, "PageNumber").otherwise(kind)
    score = F.when(number, 90).otherwise(score)
    return at.withColumns({"element_type": kind, "confidence": score / 100}).drop("mid", "clean", "of_title", "of_list", "of_note", "of_margin")


def likelihoods(blocks: DataFrame) -> DataFrame:
    """Five capped likelihoods for every block: title, list item, header or footer, footnote, annotation."""
    text, size = F.trim("text"), F.col("font_size")
    doc = blocks.groupBy("doc_id").agg(F.median("font_size").alias("mid"))
    at = blocks.join(doc, "doc_id")
    y = F.col("y0") / F.col("page_height")
    n = word_count(text)

    def capped(*terms: tuple[Column, int]) -> Column:
        return F.least(F.lit(100), points(*terms)) / 100

    return at.withColumns({
        "title": capped((size > F.col("mid") * 1.2, 30), (F.col("is_bold"), 20), (n <= 10, 20), (~text.rlike(r"[.:;?!]$"), 10), (F.lower(text).rlike(TITLE_STARTS), 30)),
        "list_item": capped((text.rlike(LIST_MARKS), 50), (F.col("x0") / F.col("page_width") > 0.05, 20), (F.char_length(text) < 200, 20)),
        "header_footer": capped(((y < 0.1) | (y > 0.9), 40), (F.lower(text).rlike(p.MARGIN_WORDS), 30), (size < F.col("mid"), 20), (F.char_length(text) < 100, 10)),
        "footnote": capped((text.rlike(NOTE_MARKS), 40), (y > 0.8, 30), (size < F.col("mid"), 30)),
        "annotation": capped((F.col("is_italic"), 30), (size < F.col("mid"), 30), (n <= 20, 20), (text.rlike(r"^[\[(]"), 20)),
    }).drop("mid")


def best_type(scores: dict[str, Column], least: Column, other: str) -> Column:
    """The name of the greatest score, the first named of equal ones; ``other`` below the least."""
    top = F.greatest(*scores.values())
    out = F.lit(other)
    for name, s in reversed(scores.items()):
        out = F.when((s == top) & (top >= least), name).otherwise(out)
    return out


def context_elements(blocks: DataFrame) -> DataFrame:
    """The greatest of the likelihoods names the type; below one half it is Text."""
    at = likelihoods(blocks)
    names = {"Title": F.col("title"), "ListItem": F.col("list_item"), "HeaderFooter": F.col("header_footer"), "Footnote": F.col("footnote"), "Annotation": F.col("annotation")}
    return at.withColumn("element_type", best_type(names, F.lit(0.5), "Text"))


def possible_narrative(text: Column, caps: float = 0.5, alpha: float = 0.5) -> Column:
    body = (m.alpha_ratio(text) >= alpha) & (m.cap_ratio(text) <= caps)
    return (F.trim(text) != "") & ~text.rlike(r"^\d+$") & body & ((m.sentence_count(text, 3) >= 2) | m.has_verb(text))


def simple_title(text: Column, bold: Column, size_ratio: Column) -> Column:
    """The utility score: short, capitalised, bold, large, without an end mark; at most 1."""
    text = F.trim(text)
    terms = points((word_count(text) <= 10, 20), (m.title_case(text) | m.all_caps(text), 20), (bold, 20), (size_ratio > 1.2, 30), (~text.rlike(r"[.!?]$"), 10))
    return F.least(F.lit(100), terms) / 100


def likely_title(text: Column, font_size: Column, median_size: Column, bold: Column, italic: Column, relative_y: Column) -> dict[str, Column]:
    """The second title score: points (hundredths, 0 to 100) and whether they are over 40."""
    text = F.trim(text)
    n = word_count(text)
    upper = m.all_caps(text)
    titled = ~upper & ~text.rlike(r"(?:^|[^\p{L}])\p{Ll}") & ~text.rlike(r"\p{L}\p{Lu}")
    numbered, lettered = text.rlike(r"^\d+\.?\d*\s+[\p{L}\p{N}_]+"), text.rlike(r"^[A-Z]\.\s+[\p{L}\p{N}_]+")
    out = (F.char_length(text) < 2) | (n > 25) | (F.size(F.split(text, r"[.!?]+", -1)) > 2)
    score = points(
        (font_size > median_size * 1.2, 30), (bold, 20), (italic, 10), (upper, 15), (titled, 10), (n <= 15, 10), (text.rlike(r"[.:;]$"), -20), (numbered, 30), (~numbered & lettered, 25),
        (F.lower(text).rlike(r"^(?:chapter|section|appendix|introduction|conclusion|abstract|summary)\s+\d*"), 25), (m.has_verb(text), -10), ((relative_y > 0.8) | (relative_y < 0.1), -15),
    )
    return {"points": F.when(out, 0).otherwise(F.least(F.lit(100), F.greatest(F.lit(0), score))), "is_title": ~out & (score > 40)}


HEADINGS = r"^(?:(?:Chapter|Section|Part)\s+\d+|\d+\.\d+\s+[A-Z]|[IVX]+\.\s+[A-Z])"


def analysed_title(text: Column, font_size: Column, body_size: Column, bold: Column) -> dict[str, Column]:
    """The text analyser's title: short, and large, capital or headed; points are 0 or 80 to 100."""
    lines = F.split(text, "\n")
    short = (F.size(lines) <= 2) & (F.char_length(F.translate(text, "\n", "")) / F.size(lines) < 100) & (F.trim(text) != "")
    large, headed = font_size / body_size > 1.2, text.rlike(HEADINGS)
    # any end is a proper one, as the end mark may be missing
    score = F.least(F.lit(100), F.lit(80) + points((large, 10), (bold, 10), (headed, 10)))
    return {"points": F.when(short & (large | m.all_caps(text) | headed), score).otherwise(0)}


def analysed_margin(text: Column, font_size: Column, body_size: Column, bold: Column) -> dict[str, Column]:
    """The text analyser's header or footer at a margin: points are 0 or 70 to 100, and it is one above 70."""
    lines = F.split(text, "\n")
    short = (F.size(lines) <= 2) & (F.char_length(F.translate(text, "\n", "")) / F.size(lines) < 80) & (F.trim(text) != "")
    return {"points": F.when(short, F.lit(70) + points((F.abs(font_size - body_size) > 0.5, 10), (bold, 10), (F.size(lines) == 1, 10))).otherwise(0)}


def pre_type(text: Column, bold: Column, has_table: Column) -> Column:
    """The type that a block has before classification; UNKNOWN where nothing tells."""
    t = F.trim(text)
    listed = t.rlike(r"^\s*\d+[.)]\s+|^\s*[\x{2022}*-]\s+")
    return (
        F.when(has_table, "TABLE_BODY").when(t.rlike(r"(?i)^table\s+\d+[:.]?\s*$"), "TABLE_CAPTION").when(t.rlike(r"(?i)^figure\s+\d+[:.]?\s*$"), "FIGURE_CAPTION")
        .when(listed, "LIST_ITEM").when(bold & (word_count(t) < 10), "HEADING").otherwise("UNKNOWN")
    )


def last_resort(text: Column) -> Column:
    """The type of a block that even the classifier leaves unknown."""
    t = F.trim(text)
    return (
        F.when(F.lower(text).rlike("table|figure|chart|diagram"), "CAPTION").when((word_count(text) < 5) & text.endswith(":"), "HEADING")
        .when(t.rlike(r"^\d{1,4}$"), "PAGE_NUMBER").when(t.rlike(r"^[\x{2022}*\x{2023}\x{2043}-]$"), "LIST_ITEM").otherwise("TEXT")
    )
