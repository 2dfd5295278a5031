"""The layout contract: ``blocks``, ``pages``, ``figures`` and ``table_areas`` with a top-left origin.

Any source that gives these columns feeds the engine. ``from_documents`` lays out plain documents with
integer arithmetic, one block for each non-blank line, so that the same tables can be stated in SQL
(``SQL`` below) and every operator can be compared with another engine on the same input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_WIDTH, PAGE_HEIGHT, ROWS, KINDS = 612, 792, 10, 23
BLOCK_COLUMNS = ("doc_id", "page_number", "seq", "text", "x0", "y0", "x1", "y1", "page_width", "page_height", "font_name", "font_size", "is_bold", "is_italic")
_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: what stands before a line of each kind, {k} being its number from 1 to 9; a kind without an entry is plain
_BEFORE = {
    0: "• ", 1: "{k}. ", 2: "Figure {k}: ", 3: "Table {k}. ", 4: "1.{k} ", 6: "Note to table {k}: ", 9: "• ", 11: "[{k}] ", 12: "sent: Fri, {k} Mar 2021 11:04:09 +0000 ",
    13: "id 1234567{k}-ABCD-0000-FFFF-1234567890AB; from 10.0.0.{k}; ", 14: '<img src="https://example.org/p{k}.png"> ', 15: "Springfield, IL 6270{k} (555-867-530{k}) ", 16: '[{{"a": {k}}}] ', 17: "x = $y_{k}$ ", 18: "ﬁg.\x07 {k} caf=C3=A9 ",
    19: "• ", 20: "{k}) ", 21: "{k}. ", 22: "• ",
}
#: list items are indented; a line of kind 12 hangs under the one before, by another step; headings are large
_LISTED, _WRAPPED, _HEADINGS = (0, 1, 9, 19, 20, 21, 22), 12, (4, 5)


def _lines(documents: DataFrame) -> DataFrame:
    split = documents.where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    kept = split.select("doc_id", F.col("n").cast("long").alias("n"), F.trim("line").alias("line")).where("line <> ''")
    kind = F.pmod(F.col("doc_id") * 7 + F.col("n") * 3, F.lit(KINDS))
    at = kept.withColumns({"kind": kind, "row": F.col("n") % ROWS, "page_number": F.floor(F.col("n") / ROWS) + 1})
    return at.withColumn("halves", F.pmod(F.col("doc_id") + F.col("page_number"), F.lit(4)) == 0)


def _dressed() -> Column:
    """The text of a line as its kind has it."""
    number = ((F.col("n") % 9) + 1).cast("string")
    text = F.when(F.col("kind") == 5, F.translate("line", _LOWER, _UPPER))
    for kind, before in _BEFORE.items():
        parts = [F.lit(x) for x in before.replace("{{", "{").replace("}}", "}").split("{k}")] if "{k}" in before else [F.lit(before)]
        front = [x for part in parts for x in (number, part)][1:]
        text = text.when(F.col("kind") == kind, F.concat(*front, "line"))
    goes_on = (F.col("row") == ROWS - 1) & (F.pmod("doc_id", F.lit(5)) == 0)
    return F.concat(text.otherwise(F.col("line")), F.when(goes_on, " (continued on next page)").otherwise(""))


def from_documents(documents: DataFrame) -> DataFrame:
    """blocks(doc_id, page_number, seq, text, x0..y1, page size, font) of laid-out documents.

    A page holds ten lines, every fourth one in two columns. Every third document has a running header, every
    seventh a footer, and every page with a first line its number.
    """
    kind, halves = F.col("kind"), F.col("halves")
    at = F.when(halves, F.col("row") % (ROWS // 2)).otherwise(F.col("row"))
    right = halves & (F.col("row") >= ROWS // 2)
    heading = kind.isin(*_HEADINGS)
    x0 = F.lit(72) + F.when(kind == 22, 36).when(kind.isin(*_LISTED), 18).when(kind == _WRAPPED, 38).when(kind.isin(7, 8) & ~halves, 270).otherwise(0) + F.when(right, 258).otherwise(0)
    y0 = F.lit(72) + 30 * F.when(kind.isin(8, 10, _WRAPPED) & (at > 0), at - 1).otherwise(at) + F.when((kind == _WRAPPED) & (at > 0), 14).otherwise(0)
    size = F.when(heading, 18).when(kind == 6, 9).otherwise(12)
    height = F.when(heading, 18).otherwise(12)
    body = _lines(documents).withColumns({"text": _dressed(), "left": x0, "top": y0, "size": size, "tall": height, "is_bold": heading, "is_italic": kind == 6})
    body = body.withColumn("wide", F.least(6 * F.char_length("text"), F.when(halves, 140).otherwise(540 - F.col("left"))))
    block = F.struct((F.col("n") * 2).alias("seq"), "text", *_box("left", "top", F.col("left") + F.col("wide"), F.col("top") + F.col("tall")), _font().alias("font_name"), F.col("size").cast("double").alias("font_size"), "is_bold", "is_italic")

    def margin(before_end: int, text: Column, *sides: int) -> Column:
        seq = F.col("page_number") * 2 * ROWS - before_end
        return F.struct(seq.alias("seq"), text.alias("text"), *_box(*map(F.lit, sides)), F.lit("Times").alias("font_name"), F.lit(9.0).alias("font_size"), F.lit(False).alias("is_bold"), F.lit(False).alias("is_italic"))

    folio = margin(1, F.col("page_number").cast("string"), 300, 766, 312, 776)
    header = margin(3, F.concat(F.lit("Annual report "), F.col("doc_id").cast("string")), 72, 30, 200, 40)
    footer = margin(5, F.lit("All rights reserved"), 72, 740, 200, 750)
    first = F.concat(F.array(block, folio), F.when(F.pmod("doc_id", F.lit(3)) == 0, F.array(header)).otherwise(F.array()), F.when(F.pmod("doc_id", F.lit(7)) == 1, F.array(footer)).otherwise(F.array()))
    both = body.select("doc_id", "page_number", F.explode(F.when(F.col("row") == 0, first).otherwise(F.array(block))).alias("b"))
    size_columns = [F.lit(float(PAGE_WIDTH)).alias("page_width"), F.lit(float(PAGE_HEIGHT)).alias("page_height")]
    return both.select("doc_id", "page_number", "b.seq", "b.text", "b.x0", "b.y0", "b.x1", "b.y1", *size_columns, "b.font_name", "b.font_size", "b.is_bold", "b.is_italic")


def _box(*sides: Column | str) -> list[Column]:
    return [(F.col(s) if isinstance(s, str) else s).cast("double").alias(n) for s, n in zip(sides, ("x0", "y0", "x1", "y1"))]


def _font() -> Column:
    return F.when(F.col("is_bold"), "Times-Bold").when(F.col("is_italic"), "Times-Italic").otherwise("Times")


def pages(blocks: DataFrame) -> DataFrame:
    return blocks.select("doc_id", "page_number", F.col("page_width").alias("width"), F.col("page_height").alias("height")).distinct()


def table_areas(blocks: DataFrame) -> DataFrame:
    """A table area on every odd page of a laid-out document, and another on some."""
    one = F.struct(F.lit(1).cast("long").alias("table_no"), *_box(F.lit(60), F.lit(160), F.lit(330), F.lit(250)))
    two = F.struct(F.lit(2).cast("long").alias("table_no"), *_box(F.lit(300), F.lit(250), F.lit(560), F.lit(330)))
    here = F.concat(F.when(F.col("page_number") % 2 == 1, F.array(one)).otherwise(F.array()), F.when(F.pmod(F.col("doc_id") + F.col("page_number"), F.lit(3)) == 0, F.array(two)).otherwise(F.array()))
    return pages(blocks).select("doc_id", "page_number", F.explode(here).alias("t")).select("doc_id", "page_number", "t.*")


def figures(blocks: DataFrame) -> DataFrame:
    """A figure on every third page of a laid-out document, at one of four heights."""
    third = pages(blocks).where("page_number % 3 = 1").withColumn("top", 87 + 30 * F.pmod("doc_id", F.lit(4)))
    return third.select("doc_id", "page_number", F.lit(1).cast("long").alias("image_no"), *_box(F.lit(72), "top", F.lit(272), F.col("top") + 40))


def block_runs(blocks: DataFrame) -> DataFrame:
    """doc_id, page_number, seq, the box and runs(line_no, run_no, text, font_name, size, width, height, n): the words
    of laid-out blocks in their order, eight to a line, every seventh one in a bold monospaced font and every fifth a
    point larger. A block without words has no row.

    A run stands for ``n`` characters of one font, size, width and height; single characters are runs of one.
    """
    def run(text: Column, k: Column) -> Column:
        k = k.cast("long")
        size = F.col("font_size") + F.when(k % 5 == 4, 1.0).otherwise(0.0)
        mono = k % 7 == 6
        return F.struct(
            F.floor(k / 8).alias("line_no"), (k % 8).alias("run_no"), text.alias("text"), F.when(mono, "Courier-Bold").otherwise(F.col("font_name")).alias("font_name"),
            size.alias("size"), F.when(mono, 7.0).otherwise(6.0).alias("width"), size.alias("height"), F.char_length(text).cast("long").alias("n"),
        )

    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    return blocks.where(F.col("text").rlike(r"\S")).select("doc_id", "page_number", "seq", "x0", "y0", "x1", "y1", F.transform(words, run).alias("runs"))


def character_runs(blocks: DataFrame) -> DataFrame:
    """The runs of ``block_runs``, a row each: runs(doc_id, page_number, seq, line_no, run_no, text, font_name, ...)."""
    return block_runs(blocks).select("doc_id", "page_number", "seq", F.inline("runs"))


def load_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of the documents of a data folder; a scan of two columns."""
    return from_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _before_sql(before: str) -> str:
    parts = before.replace("{{", "{").replace("}}", "}").split("{k}")
    return " || (n % 9 + 1) || ".join("'" + p.replace("\x07", "' || chr(7) || '") + "'" for p in parts)


SQL = f"""
lines_raw AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n
    FROM documents WHERE text IS NOT NULL
), lines AS (
    SELECT doc_id, n, trim(line) AS line, ((doc_id * 7 + n * 3) % {KINDS} + {KINDS}) % {KINDS} AS kind, n % {ROWS} AS row, n // {ROWS} + 1 AS page_number, ((doc_id + n // {ROWS} + 1) % 4 + 4) % 4 = 0 AS halves
    FROM lines_raw WHERE trim(line) <> ''
), placed AS (
    SELECT *, CASE WHEN halves THEN row % {ROWS // 2} ELSE row END AS i FROM lines
), dressed AS (
    SELECT *, CASE kind WHEN 5 THEN translate(line, '{_LOWER}', '{_UPPER}') {" ".join(f"WHEN {k} THEN {_before_sql(b)} || line" for k, b in _BEFORE.items())} ELSE line END
        || CASE WHEN row = {ROWS - 1} AND doc_id % 5 = 0 THEN ' (continued on next page)' ELSE '' END AS text,
        72 + CASE WHEN kind = 22 THEN 36 WHEN kind IN {_LISTED} THEN 18 WHEN kind = {_WRAPPED} THEN 38 WHEN kind IN (7, 8) AND NOT halves THEN 270 ELSE 0 END + CASE WHEN halves AND row >= {ROWS // 2} THEN 258 ELSE 0 END AS x,
        72 + 30 * CASE WHEN kind IN (8, 10, {_WRAPPED}) AND i > 0 THEN i - 1 ELSE i END + CASE WHEN kind = {_WRAPPED} AND i > 0 THEN 14 ELSE 0 END AS y,
        CASE WHEN kind IN {_HEADINGS} THEN 18 ELSE 12 END AS tall
    FROM placed
), blocks AS (
    SELECT doc_id, page_number, n * 2 AS seq, text, x::DOUBLE AS x0, y::DOUBLE AS y0, (x + least(6 * length(text), CASE WHEN halves THEN 140 ELSE 540 - x END))::DOUBLE AS x1, (y + tall)::DOUBLE AS y1,
        {PAGE_WIDTH}::DOUBLE AS page_width, {PAGE_HEIGHT}::DOUBLE AS page_height,
        CASE WHEN kind IN {_HEADINGS} THEN 'Times-Bold' WHEN kind = 6 THEN 'Times-Italic' ELSE 'Times' END AS font_name,
        CASE WHEN kind IN {_HEADINGS} THEN 18 WHEN kind = 6 THEN 9 ELSE 12 END::DOUBLE AS font_size, kind IN {_HEADINGS} AS is_bold, kind = 6 AS is_italic
    FROM dressed
    UNION ALL
    SELECT doc_id, page_number, page_number * {2 * ROWS} - 1, page_number::VARCHAR, 300, 766, 312, 776, {PAGE_WIDTH}, {PAGE_HEIGHT}, 'Times', 9, false, false
    FROM lines WHERE row = 0
    UNION ALL
    SELECT doc_id, page_number, page_number * {2 * ROWS} - 3, 'Annual report ' || doc_id, 72, 30, 200, 40, {PAGE_WIDTH}, {PAGE_HEIGHT}, 'Times', 9, false, false
    FROM lines WHERE row = 0 AND doc_id % 3 = 0
    UNION ALL
    SELECT doc_id, page_number, page_number * {2 * ROWS} - 5, 'All rights reserved', 72, 740, 200, 750, {PAGE_WIDTH}, {PAGE_HEIGHT}, 'Times', 9, false, false
    FROM lines WHERE row = 0 AND (doc_id % 7 + 7) % 7 = 1
), pages_ AS (SELECT DISTINCT doc_id, page_number, page_width AS width, page_height AS height FROM blocks
), table_areas AS (SELECT doc_id, page_number, 1::BIGINT AS table_no, 60::DOUBLE AS x0, 160::DOUBLE AS y0, 330::DOUBLE AS x1, 250::DOUBLE AS y1 FROM pages_ WHERE page_number % 2 = 1
    UNION ALL SELECT doc_id, page_number, 2, 300, 250, 560, 330 FROM pages_ WHERE ((doc_id + page_number) % 3 + 3) % 3 = 0
), figures AS (SELECT doc_id, page_number, 1::BIGINT AS image_no, 72::DOUBLE AS x0, (87 + 30 * ((doc_id % 4 + 4) % 4))::DOUBLE AS y0, 272::DOUBLE AS x1, (127 + 30 * ((doc_id % 4 + 4) % 4))::DOUBLE AS y1 FROM pages_ WHERE page_number % 3 = 1
), words_ AS (SELECT doc_id, page_number, seq, font_name, font_size, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS ws FROM blocks
), runs AS (SELECT doc_id, page_number, seq, k // 8 AS line_no, k % 8 AS run_no, text, CASE WHEN k % 7 = 6 THEN 'Courier-Bold' ELSE font_name END AS font_name, font_size + CASE WHEN k % 5 = 4 THEN 1 ELSE 0 END AS size,
    CASE WHEN k % 7 = 6 THEN 7 ELSE 6 END::DOUBLE AS width, font_size + CASE WHEN k % 5 = 4 THEN 1 ELSE 0 END AS height, length(text) AS n FROM (SELECT doc_id, page_number, seq, font_name, font_size, unnest(ws) AS text, unnest(range(len(ws))) AS k FROM words_)
)"""


def with_layout(body: str) -> str:
    """SQL over the layout tables; a body that begins with a name goes on with more common tables."""
    return f"WITH {SQL}{body}"
