"""Ordered grouping on pages: gaps and islands as windows, and growing groups as folds over a page's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import patterns as p
from .pagewalk import Rule, fold_runs, page_rows, spread, united

PAGE = ["doc_id", "page_number"]
ORDER = ["y0", "x0", "seq"]


def islands(rows: DataFrame, starts: Column, name: str = "grp", order: list[str] | None = None) -> DataFrame:
    """Numbers the runs on a page that begin where ``starts`` holds; one sort serves lag and running sum."""
    w = W.partitionBy(*PAGE).orderBy(*(order or ORDER))
    flag = F.when(F.coalesce(starts, F.lit(True)), 1).otherwise(0)
    marked = rows.withColumn("__start", flag)
    return marked.withColumn(name, F.sum("__start").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__start")


def previous(*names: str, order: list[str] | None = None) -> dict[str, Column]:
    w = W.partitionBy(*PAGE).orderBy(*(order or ORDER))
    return {n: F.lag(n).over(w) for n in names}


def line_groups(blocks: DataFrame) -> DataFrame:
    """grp: runs of blocks on one line, close together and of one style; a centred folio begins anew."""
    q = previous("x0", "y0", "x1", "y1", "font_size", "is_bold", "is_italic")
    same_line = F.abs(q["y0"] - F.col("y0")) <= 3
    close = F.col("x0") - q["x1"] <= 60
    font = F.abs(q["font_size"] - F.col("font_size")) / F.greatest(q["font_size"], F.col("font_size")) <= 0.2
    style = (q["is_bold"] == F.col("is_bold")) & (q["is_italic"] == F.col("is_italic"))
    centred = F.abs((F.col("x0") + F.col("x1")) / 2 - F.col("page_width") / 2) < F.col("page_width") * 0.15
    folio = centred & (F.col("y0") > F.col("page_height") * 0.85) & F.trim("text").rlike(r"^\d{1,5}$")
    apart = centred & (F.abs(q["y0"] - F.col("y0")) > 30) & (F.col("y0") > q["y1"])
    joins = same_line & close & font & style & ~folio & ~apart
    with_start = blocks.withColumn("__s", F.coalesce(~joins, F.lit(True)))
    return islands(with_start, F.col("__s")).drop("__s")


def merge_groups(rows: DataFrame, joint: str = " ") -> DataFrame:
    """One row for each group: the box around it, the texts in order, the style of the largest block."""
    size = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    texts = F.array_sort(F.collect_list(F.struct("y0", "x0", "seq", "text")))
    style = F.max_by(F.struct("font_name", "font_size", "is_bold", "is_italic"), F.struct(size, -F.col("seq")))
    out = rows.groupBy(*PAGE, "grp").agg(
        F.min("seq").alias("seq"), F.array_join(F.transform(texts, lambda t: t["text"]), joint).alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.first("page_width").alias("page_width"), F.first("page_height").alias("page_height"), style.alias("style"), F.count("*").alias("item_count"),
    )
    return out.select(*PAGE, "seq", "text", "x0", "y0", "x1", "y1", "page_width", "page_height", "style.*", "item_count")


def merged_blocks(blocks: DataFrame) -> DataFrame:
    return merge_groups(line_groups(blocks))


def list_groups(elements: DataFrame, max_gap: float = 20.0, max_indent: float = 10.0, type_name: str = "LIST_ITEM") -> DataFrame:
    """list_group_id of list items: consecutive, near, aligned and of one font; null for other elements."""
    q = previous("element_type", "x0", "y1", "font_name", "font_size")
    related = (q["element_type"] == type_name) & (F.abs(q["y1"] - F.col("y0")) <= max_gap) & (F.abs(q["x0"] - F.col("x0")) <= max_indent) & (q["font_name"] == F.col("font_name")) & (F.abs(q["font_size"] - F.col("font_size")) <= 0.1)
    marked = elements.withColumn("__s", ~((F.col("element_type") == type_name) & F.coalesce(related, F.lit(False))))
    numbered = islands(marked, F.col("__s"))
    group = F.sha2(F.concat_ws(":", F.lit("list"), *PAGE, "grp"), 256)
    return numbered.withColumn("list_group_id", F.when(F.col("element_type") == type_name, group)).drop("__s", "grp")


def lists(elements: DataFrame, max_gap: float = 20.0, type_name: str = "LIST_ITEM") -> DataFrame:
    """LIST rows: consecutive list items that lie at most max_gap below each other."""
    q = previous("element_type", "y1")
    gap = F.col("y0") - q["y1"]
    goes_on = (F.col("element_type") == type_name) & (q["element_type"] == type_name) & (gap > 0) & (gap <= max_gap)
    marked = elements.withColumn("__s", ~F.coalesce(goes_on, F.lit(False)))
    items = islands(marked, F.col("__s")).where(F.col("element_type") == type_name).drop("__s")
    return merge_groups(items, "\n").withColumn("element_type", F.lit("LIST"))


def list_contexts(elements: DataFrame, type_name: str = "ListItem") -> DataFrame:
    """list_id and list_index: runs of one marker type, close below each other, whose numbers count up.

    The window form compares indents with the item before, which equals the list's head where indents are
    uniform; ``list_contexts_exact`` carries the head.
    """
    info = p.list_pattern(F.col("text"))
    at = elements.withColumns({"pattern": info["type"], "number": info["number"]})
    q = previous("element_type", "pattern", "number", "x0", "y1")
    follows = (q["element_type"] == type_name) & (q["pattern"] == F.col("pattern")) & (F.abs(F.col("y0") - q["y1"]) <= 20) & (F.abs(F.col("x0") - q["x0"]) <= 5)
    counts = (F.col("pattern") != "number") | (F.col("number") == q["number"] + 1)
    marked = at.withColumn("__s", ~((F.col("element_type") == type_name) & F.coalesce(follows & counts, F.lit(False))))
    out = islands(marked, F.col("__s"))
    listed = F.col("element_type") == type_name
    return out.withColumns({"list_id": F.when(listed, F.sha2(F.concat_ws(":", F.lit("context"), *PAGE, "grp"), 256)), "list_index": F.when(listed, F.coalesce("number", F.lit(0).cast("long")))}).drop("__s", "grp")


def list_contexts_exact(elements: DataFrame, type_name: str = "ListItem") -> DataFrame:
    """doc_id, page_number, seq, head_seq, list_index: list contexts with the head's indent carried on.

    An item goes on with the list if it has the head's marker and indent, stands close below the last item and,
    where items are numbered, counts up from it. Anything else ends the list.
    """
    info = p.list_pattern(F.col("text"))
    at = elements.select(*PAGE, *ORDER, "y1", "element_type", info["type"].alias("pattern"), info["number"].alias("number"))
    row = "struct<seq:bigint,head_seq:bigint,list_index:bigint>"
    none = "struct<seq:bigint,pattern:string,x0:double>"
    start = F.struct(F.array().cast(f"array<{row}>").alias("out"), F.lit(None).cast(none).alias("head"), F.lit(None).cast("bigint").alias("last"), F.lit(None).cast("double").alias("bottom"))

    def step(s: Column, r: Column) -> Column:
        listed = (r["element_type"] == type_name) & r["pattern"].isNotNull()
        head = s["head"]
        near = s["bottom"].isNull() | (F.abs(r["y0"] - s["bottom"]) <= 20)
        counts = (r["pattern"] != "number") | (r["number"] == s["last"] + 1)
        go = F.coalesce(head.isNotNull() & near & (r["pattern"] == head["pattern"]) & (F.abs(r["x0"] - head["x0"]) <= 5) & counts, F.lit(False))
        mine = F.when(go, head).otherwise(F.struct(r["seq"].alias("seq"), r["pattern"].alias("pattern"), r["x0"].alias("x0")))
        item = F.struct(r["seq"].alias("seq"), mine["seq"].alias("head_seq"), F.coalesce(r["number"], F.lit(0).cast("bigint")).alias("list_index"))
        return F.struct(
            F.when(listed, F.concat(s["out"], F.array(item))).otherwise(s["out"]).alias("out"), F.when(listed, mine).alias("head"), F.when(listed, r["number"]).otherwise(s["last"]).alias("last"), F.when(listed, r["y1"]).otherwise(s["bottom"]).alias("bottom")
        )

    pages = page_rows(at, tuple(ORDER)).withColumn("rows", F.aggregate("rows", start, step, lambda s: s["out"]))
    return spread(pages, [*PAGE, "seq", "head_seq", "list_index"])


def merge_runs(blocks: DataFrame, rule: Rule, joint: Rule = lambda a, b: F.concat(a, F.lit(" "), b)) -> DataFrame:
    """Walks a page in order; a block that the rule ties to the current group joins it, and the group's box grows."""

    def merge(a: Column, b: Column) -> Column:
        return united(a, b).withField("text", joint(a["text"], b["text"]))

    return spread(fold_runs(page_rows(blocks, tuple(ORDER)), rule, merge), blocks.columns)


def _small(text: Column) -> Column:
    return text.rlike(r"^\p{Ll}")


def dehyphenating(a: Column, b: Column) -> Column:
    return F.when(a.endswith("-") & _small(b), F.concat(F.substr(a, F.lit(1), F.char_length(a) - 1), b)).otherwise(F.concat(a, F.lit(" "), b))


def region_rule(a: Column, b: Column, line_height: float = 12.0, char_width: float = 6.0) -> Column:
    """Regions: a small gap, aligned left sides, one font and size."""
    return (b["y0"] - a["y1"] <= 1.5 * line_height) & (F.abs(a["x0"] - b["x0"]) <= 2 * char_width) & (F.abs(a["font_size"] - b["font_size"]) <= 0.5) & (a["font_name"] == b["font_name"])


def element_rule(a: Column, b: Column) -> Column:
    """Elements: gaps and offsets in proportion to the font."""
    return (b["y0"] - a["y1"] <= 1.5 * a["font_size"]) & (F.abs(a["x0"] - b["x0"]) < a["font_size"]) & (a["font_name"] == b["font_name"]) & (F.abs(a["font_size"] - b["font_size"]) < 0.5)


def text_block_rule(a: Column, b: Column) -> Column:
    """Text blocks: near, overlapping, of one font, and the second goes on where the first breaks off."""
    over = F.least(a["x1"], b["x1"]) > F.greatest(a["x0"], b["x0"])
    goes_on = a["text"].endswith("-") | _small(b["text"]) | ~a["text"].rlike(r"[.!?:]\s*$")
    return (b["y0"] - a["y1"]).between(0, 15) & over & (a["font_name"] == b["font_name"]) & (F.abs(a["font_size"] - b["font_size"]) < 0.5) & goes_on


def list_absorb_rule(a: Column, b: Column) -> Column:
    """List items whose box lies, but for a small slack, in the one before as grown."""
    dx, dy = (a["x1"] - a["x0"]) * 0.08, (a["y1"] - a["y0"]) * 0.12
    inside = (b["x0"] > a["x0"] - dx) & (b["x1"] < a["x1"] + dx) & (b["y0"] > a["y0"] - dy) & (b["y1"] < a["y1"] + dy)
    return (a["element_type"] == "LIST_ITEM") & (b["element_type"] == "LIST_ITEM") & inside


#: a bullet, or a number with its mark as the first word
WRAP_START = r"^[\x{2022}*\x{00B7}-]|^\d+[.:)]+(?: |$)"


def wrapped_list_rule(a: Column, b: Column) -> Column:
    """A line that goes on under the text of a list item."""
    return a["text"].rlike(WRAP_START) & ~b["text"].rlike(WRAP_START) & (F.abs(a["y1"] - b["y0"]) <= 5) & (F.abs(b["x0"] - (a["x0"] + 20)) <= 5) & (a["font_name"] == b["font_name"])


def context_list_rule(a: Column, b: Column) -> Column:
    """Context lists: the next item, or a text that continues the item before, indented by up to 50 points."""
    step = b["x0"] - a["x0"]
    item = b["element_type"] == "ListItem"
    return (b["y0"] - a["y1"]).between(0, 20) & (a["element_type"] == "ListItem") & ((item & (F.abs(step) <= 50)) | (~item & step.between(0, 50) & _small(b["text"])))


def list_levels(elements: DataFrame, type_name: str = "ListItem") -> DataFrame:
    """list_level: 1 where an item is indented 10 to 50 points beyond the item before, else 0."""
    q = previous("element_type", "x0")
    step = F.col("x0") - q["x0"]
    nested = (F.col("element_type") == type_name) & (q["element_type"] == type_name) & step.between(10, 50)
    return elements.withColumn("list_level", F.when(F.coalesce(nested, F.lit(False)), 1).otherwise(0))


def continuity(blocks: DataFrame) -> DataFrame:
    """Pair predicates with the block before: flows_on, near_font, can_merge, continues_item."""
    q = previous("text", "x0", "y0", "x1", "y1", "font_name", "font_size", "is_bold")
    same = (q["font_name"] == F.col("font_name")) & (F.abs(q["font_size"] - F.col("font_size")) < 0.1)
    ends = q["text"].rlike(r"[.!?]\s*$")
    lower = F.col("text").rlike(r"^\p{Ll}")
    size = F.col("font_size")
    gap = F.col("y0") - q["y1"]
    flags = {
        "flows_on": same & (F.abs(F.col("x0") - q["x0"]) < 5) & ~ends,
        "near_font": same & (F.abs(gap) <= size * 0.3) & (F.abs(F.col("x0") - q["x0"]) <= size * 0.6),
        "can_merge": (q["font_name"] == F.col("font_name")) & (gap < size * 1.5) & (q["text"].endswith("-") | lower | (~ends & (q["x1"] > F.col("page_width") * 0.8))),
        "continues_item": p.matches(q["text"], p.LIST_START) & (F.abs(F.col("x0") - q["x0"]) < 5) & (gap < 20) & (lower | F.col("text").rlike(r"(?i)^(?:and|or|but|nor|yet|so)\s")),
    }
    return blocks.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in flags.items()})


def listed_runs(blocks: DataFrame) -> DataFrame:
    """is_list_item: a list mark begins a run, and blocks close below each other go on with it by their wording."""
    q = previous("x0", "y1")
    marked = p.listed(F.col("text"))
    linked = (F.abs(F.col("x0") - q["x0"]) < 5) & (F.abs(F.col("y0") - q["y1"]) < 20) & p.listed_on(F.col("text"))
    out = islands(blocks.withColumns({"__m": marked, "__s": marked | ~F.coalesce(linked, F.lit(False))}), F.col("__s"))
    run = W.partitionBy(*PAGE, "grp")
    return out.withColumn("is_list_item", F.bool_or("__m").over(run)).drop("__m", "__s", "grp")
