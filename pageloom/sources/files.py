"""File sources and sinks: parquet layouts, JSON by page, HTML pages, directories of binary documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as g


@dataclass(frozen=True)
class LayoutOptions:
    """How characters become lines and lines blocks, and the engine's thresholds."""

    line_overlap: float = 0.5
    char_margin: float = 2.0
    line_margin: float = 0.5
    word_margin: float = 0.1
    boxes_flow: float = 0.5
    detect_vertical: bool = True
    all_texts: bool = True
    max_list_gap: float = 20.0
    max_indent_diff: float = 10.0
    table_flavor: str = "lattice"


STRICT = LayoutOptions(line_overlap=0.7, char_margin=1.0, line_margin=0.3, word_margin=0.05)
LOOSE = LayoutOptions(line_overlap=0.3, char_margin=3.0, line_margin=0.7, word_margin=0.2)


def adaptive_options(page_stats: DataFrame) -> DataFrame:
    """Margins in proportion to a page's line height and word spacing, never below the strict ones."""
    return page_stats.select("doc_id", "page_number", F.greatest(F.lit(STRICT.char_margin), F.col("median_word_spacing") / 4).alias("char_margin"), F.greatest(F.lit(STRICT.line_margin), F.col("median_line_height") / 28).alias("line_margin"))


def documents_in(spark: SparkSession, folder: str, suffix: str = "*.pdf") -> DataFrame:
    """One row for each file of a folder, recursively: path, time, length and content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", suffix).option("recursiveFileLookup", "true").load(folder)


def pdf_blocks(files: DataFrame, options: LayoutOptions = LayoutOptions(), pages: tuple[int, ...] | None = None) -> DataFrame:
    """blocks of PDF files through pdfminer, if it is installed on the executors; a file is read once.

    ``options`` say how characters become lines and lines blocks; ``pages`` are the numbers (from 1) to read, all
    if none are given. A block has the style that most of its characters have and the mean of their sizes. The
    page is flipped to a top-left origin on the way in.
    """
    schema = "doc_id long, page_number long, seq long, text string, x0 double, y0 double, x1 double, y1 double, page_width double, page_height double, font_name string, font_size double, is_bold boolean, is_italic boolean"

    def run(batches):  # noqa: ANN001, ANN202
        import io
        from collections import Counter

        import pandas as pd
        from pdfminer.high_level import extract_pages
        from pdfminer.layout import LAParams, LTChar, LTTextBox, LTTextLine

        how = LAParams(line_overlap=options.line_overlap, char_margin=options.char_margin, line_margin=options.line_margin, word_margin=options.word_margin, boxes_flow=options.boxes_flow, detect_vertical=options.detect_vertical, all_texts=options.all_texts)
        for batch in batches:
            rows = []
            for doc_id, content in zip(batch["doc_id"], batch["content"]):
                wanted = None if pages is None else [n - 1 for n in pages]
                numbers = iter(sorted({*pages})) if pages is not None else None
                for k, page in enumerate(extract_pages(io.BytesIO(content), page_numbers=wanted, laparams=how), 1):
                    number = next(numbers) if numbers is not None else k
                    for seq, box in enumerate(b for b in page if isinstance(b, LTTextBox)):
                        glyphs = [c for line in box if isinstance(line, LTTextLine) for c in line if isinstance(c, LTChar)]
                        name = Counter(c.fontname for c in glyphs).most_common(1)[0][0] if glyphs else ""
                        size = sum(c.size for c in glyphs) / len(glyphs) if glyphs else 0.0
                        text = box.get_text().strip()
                        if text:
                            rows.append((doc_id, number, seq, text, box.x0, page.height - box.y1, box.x1, page.height - box.y0, page.width, page.height, name, size, "bold" in name.lower(), "italic" in name.lower() or "oblique" in name.lower()))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return files.select(F.xxhash64("path").alias("doc_id"), "content").mapInPandas(run, schema)


def html_blocks(pages: DataFrame) -> DataFrame:
    """page_id, seq, tag, text: headings, paragraphs and list items of raw HTML, tags and entities resolved."""
    body = F.regexp_replace("html", r"(?is)<(script|style|nav)[^>]*>.*?</(?:script|style|nav)>", "")
    found = F.regexp_extract_all(body, F.lit(r"(?is)<((?:h[1-6]|p|li)(?:\s[^>]*)?>.*?)</(?:h[1-6]|p|li)>"), F.lit(1))
    each = pages.select("page_id", F.posexplode(found).alias("n", "raw"))
    text = F.regexp_replace(F.regexp_replace("raw", r"(?s)^[^>]*>", ""), r"<[^>]+>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    clean = F.trim(F.regexp_replace(text, r"\s+", " "))
    return each.select("page_id", F.col("n").cast("long").alias("seq"), F.lower(F.regexp_extract("raw", r"^(\w+)", 1)).alias("tag"), clean.alias("text")).where("text <> ''")


def image_name(content: Column) -> Column:
    return F.concat(F.lit("img_"), F.substring(F.sha2(content, 256), 1, 16), F.lit(".png"))


def image_elements(images: DataFrame) -> DataFrame:
    """FIGURE elements of images of 50 by 50 pixels or more, with a name drawn from the content."""
    kept = images.where("width >= 50 and height >= 50")
    return kept.withColumns({"text": image_name(F.col("content")), "element_type": F.lit("FIGURE"), "size_kb": F.round(F.length("content") / 1024, 2)}).drop("content")


def element_id(*parts: str) -> Column:
    """A surrogate that is the same in every run."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def page_json(elements: DataFrame, *fields: str) -> DataFrame:
    """doc_id, page_number, json: the elements of a page in order, all fields or some, as one JSON text without nulls."""
    fields = fields or tuple(c for c in elements.columns if c not in ("doc_id", "page_number"))
    row = F.struct("y0", "x0", "seq", F.struct(*fields).alias("e"))
    rows = elements.groupBy("doc_id", "page_number").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    listed = F.transform("rows", lambda r: r["e"])
    return rows.select("doc_id", "page_number", F.to_json(F.struct("page_number", listed.alias("elements"))).alias("json"))


def element_json(elements: DataFrame) -> DataFrame:
    """doc_id, seq, json: every element on its own, an unknown type as TEXT, with style, coordinates and what else is known."""
    style = F.struct("font_name", "font_size", "is_bold", "is_italic")
    across, down = F.round(F.col("x0") / F.col("page_width"), 4), F.round(F.col("y0") / F.col("page_height"), 4)
    place = F.struct("x0", "y0", "x1", "y1", "page_width", "page_height", across.alias("relative_x"), down.alias("relative_y"), across.alias("indent_ratio"))
    more = [c for c in ("confidence", "title_level", "list_group_id", "cross_page_refs") if c in elements.columns]
    meta = F.struct(style.alias("style"), place.alias("coordinates"), "page_number", *more)
    kind = F.when(F.col("element_type") != "UNKNOWN", F.col("element_type"))
    row = F.struct(F.coalesce(kind, F.lit("TEXT")).alias("type"), "text", F.array("x0", "y0", "x1", "y1").alias("bbox"), "page_number", meta.alias("metadata"))
    return elements.select("doc_id", "seq", F.to_json(row).alias("json"))


def write_page_json(elements: DataFrame, path: str) -> None:
    """One JSON object a line, in folders by document."""
    fields = [c for c in elements.columns if c not in ("doc_id", "page_number")]
    row = F.struct("y0", "x0", "seq", F.struct(*fields).alias("e"))
    rows = elements.groupBy("doc_id", "page_number").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    rows.select("doc_id", "page_number", F.transform("rows", lambda r: r["e"]).alias("elements")).write.json(path)


def read_elements(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The elements of page JSON, flat again."""
    return spark.read.schema(schema).json(path).select("doc_id", "page_number", F.explode("elements").alias("e")).select("doc_id", "page_number", "e.*")


def polygon_json(elements: DataFrame, filename: str = "document", filetype: str = "application/pdf") -> DataFrame:
    """The alternate record: element id, four corner points, layout size and file facts."""
    points = g.corners(g.Box.of(), clockwise=False)
    coordinates = F.struct(points.alias("points"), F.col("page_width").alias("layout_width"), F.col("page_height").alias("layout_height"))
    meta = F.struct(coordinates.alias("coordinates"), F.lit(filename).alias("filename"), F.lit(filetype).alias("filetype"), "page_number", F.array(F.lit("eng")).alias("languages"), F.col("confidence").alias("detection_class_prob"), F.col("font_size"))
    return elements.select("doc_id", "seq", F.to_json(F.struct(element_id("doc_id", "page_number", "seq").alias("element_id"), F.col("element_type").alias("type"), "text", meta.alias("metadata"))).alias("json"))


def validate(rows: DataFrame, required: dict[str, str], arrays: dict[str, str] | None = None) -> DataFrame:
    """errors: for each JSON text, required fields that are missing or of another type, and bad array items."""
    fields = {**required, **(arrays or {})}
    parsed = F.from_json("json", T.StructType([T.StructField(n, T.StringType()) for n in fields]))
    at = rows.withColumn("__p", parsed)
    tests = [F.when(F.col("json").isNull() | F.col("__p").isNull() | ~F.trim("json").startswith("{"), "not an object")]
    for name, kind in required.items():
        value = F.col(f"__p.{name}")
        tests.append(F.when(value.isNull(), f"{name} is missing").when(value.try_cast(kind).isNull(), f"{name} is not {kind}"))
    for name, kind in (arrays or {}).items():
        items = F.from_json(f"__p.{name}", T.ArrayType(T.StringType()))
        tests.append(F.when(items.isNull(), f"{name} is not a list").when(F.exists(items, lambda x: x.try_cast(kind).isNull()), f"{name} has items that are not {kind}"))
    return at.withColumn("errors", F.filter(F.array(*tests), lambda e: e.isNotNull())).drop("__p")


COLOURS = {"TITLE": "red", "TEXT": "blue", "LIST_ITEM": "green", "TABLE_BODY": "orange", "FIGURE": "purple", "FIGURE_CAPTION": "magenta", "TABLE_CAPTION": "brown", "BLOCK_EQUATION": "cyan", "DISCARDED": "lightgrey"}


def coloured(elements: DataFrame, default: str = "grey", least: float = 0.0) -> DataFrame:
    """colour by type from a table of nine rows, for elements of enough confidence (none counts as 1)."""
    table = elements.sparkSession.createDataFrame(list(COLOURS.items()), "element_type string, colour string")
    kept = elements.where(F.coalesce("confidence", F.lit(1.0)) >= least)
    return kept.join(F.broadcast(table), "element_type", "left").withColumn("colour", F.coalesce("colour", F.lit(default)))
