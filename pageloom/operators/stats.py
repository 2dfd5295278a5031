"""Page, document and block statistics as group-by aggregates.

Modes take the most frequent value, and of equally frequent ones the one seen first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import measures as m

PAGE = ("doc_id", "page_number")


def body_font(blocks: DataFrame) -> DataFrame:
    """Per page: the size most characters are set in (to a tenth), the least and the greatest size."""
    sized = blocks.groupBy(*PAGE, F.round("font_size", 1).alias("size")).agg(F.sum(F.char_length("text")).alias("chars"), F.min("seq").alias("seq"), F.min("font_size").alias("lo"), F.max("font_size").alias("hi"))
    best = F.max_by("size", F.struct("chars", -F.col("seq")))
    return sized.groupBy(*PAGE).agg(best.alias("body_font_size"), F.min("lo").alias("min_font_size"), F.max("hi").alias("max_font_size"))


def mode(rows: DataFrame, keys: tuple[str, ...], value: Column, weight: Column, name: str) -> DataFrame:
    """The value with the greatest total weight per key, first seen by ``seq`` on ties."""
    each = rows.groupBy(*keys, value.alias("v")).agg(F.sum(weight).alias("w"), F.min("seq").alias("s"))
    return each.groupBy(*keys).agg(F.max_by("v", F.struct("w", -F.col("s"))).alias(name))


def page_stats(blocks: DataFrame) -> DataFrame:
    """Per page: medians of font size, line height and word spacing, with 12, 14 and 4 where there are none."""
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    glyphs = m.count_of(F.col("text"), r"\s+") * F.col("font_size") / 2
    spacing = F.when(words > 1, F.greatest(F.lit(0.0), F.col("x1") - F.col("x0") - glyphs) / (words - 1))

    def middle(c: Column, default: float) -> Column:
        return F.coalesce(F.median(F.when(c > 0, c)), F.lit(default))

    return blocks.groupBy(*PAGE).agg(
        middle(F.col("font_size"), 12.0).alias("median_font_size"), middle(F.col("y1") - F.col("y0"), 14.0).alias("median_line_height"),
        middle(spacing, 4.0).alias("median_word_spacing"), F.count("*").alias("n_blocks"), F.count_distinct("font_name").alias("unique_fonts"),
    )


def font_counts(blocks: DataFrame) -> DataFrame:
    """Blocks by page, font and style, in long form."""
    return blocks.groupBy(*PAGE, "font_name", "is_bold", "is_italic").agg(F.count("*").alias("n"))


def document_stats(blocks: DataFrame) -> DataFrame:
    """Per document: pages, medians of the page medians, and their share of bold blocks."""
    pages = page_stats(blocks)
    return pages.groupBy("doc_id").agg(F.count("*").alias("page_count"), F.median("median_font_size").alias("median_font_size"), F.median("median_line_height").alias("median_line_height"), F.median("median_word_spacing").alias("median_word_spacing"))


def top_values(blocks: DataFrame, value: Column, n: int = 5) -> DataFrame:
    """The n most frequent values per document, with their rank."""
    counts = blocks.groupBy("doc_id", value.alias("value")).agg(F.count("*").alias("n"), F.min("seq").alias("seq"))
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("n"), "seq"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= n).select("doc_id", "value", "n", F.col("rank").cast("long").alias("rank"))


def font_summary(blocks: DataFrame, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """Mean, median, population and sample deviation of size; bold and italic shares by characters."""
    chars = F.char_length("text")

    def share(flag: str) -> Column:
        return F.sum(F.when(F.col(flag), chars).otherwise(0)) / F.sum(chars)

    base = blocks.groupBy(*keys).agg(
        (F.sum(F.col("font_size") * chars) / F.sum(chars)).alias("avg_font_size"), F.median("font_size").alias("median_font_size"), F.stddev_pop("font_size").alias("std_font_size"),
        F.coalesce(F.stddev_samp("font_size"), F.lit(0.0)).alias("sample_std"), share("is_bold").alias("bold_ratio"), share("is_italic").alias("italic_ratio"), F.bool_or("is_bold").alias("any_bold"), F.sum(chars).alias("char_count"),
    )
    return base.join(mode(blocks, keys, F.col("font_name"), chars, "dominant_font"), list(keys)).withColumns({"is_bold": F.col("bold_ratio") > 0.5, "is_italic": F.col("italic_ratio") > 0.5})


def upper_median(c: Column) -> Column:
    """The element in the middle, the upper one of two."""
    s = F.sort_array(F.collect_list(c))
    return F.get(s, F.floor(F.size(s) / 2).cast("int"))


def scored_document_stats(blocks: DataFrame) -> DataFrame:
    """The scored analyser's figures: upper medians and the font that most words are set in."""
    words = F.size(F.split(F.trim("text"), r"\s+"))
    base = blocks.groupBy("doc_id").agg(upper_median(F.col("font_size")).alias("median_font_size"), upper_median(F.col("y1") - F.col("y0")).alias("median_line_height"))
    return base.join(mode(blocks, ("doc_id",), F.col("font_name"), words, "body_font"), "doc_id")


def type_summary(elements: DataFrame) -> DataFrame:
    """Elements by type with a first sample, and a total row (type null)."""
    return elements.rollup("element_type").agg(F.count("*").alias("n"), F.min_by("text", F.struct("doc_id", "seq")).alias("sample"))


def line_gaps(blocks: DataFrame) -> DataFrame:
    """Distances between the tops of consecutive lines of a page."""
    w = W.partitionBy(*PAGE).orderBy("y0", "x0", "seq")
    return blocks.withColumn("gap", F.abs(F.col("y0") - F.lag("y0").over(w))).where("gap is not null").groupBy(*PAGE).agg(F.avg("gap").alias("mean_gap"), F.coalesce(F.stddev_samp("gap"), F.lit(0.0)).alias("std_gap"), F.count("*").alias("n"))
