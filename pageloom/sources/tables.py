"""Table cells: cleaning of extracted cell grids and their HTML, as array expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.once import once

_VOID = ("", "nan", "NaN", "NULL")


def grid(text: Column) -> Column:
    """Cells of a text whose rows are lines and whose columns are parted by bars."""
    rows = F.filter(F.split(text, "\n"), lambda r: r.contains("|"))
    return F.transform(rows, lambda r: F.transform(F.split(r, r"\|"), lambda c: F.trim(c)))


def clean_cells(cells: Column) -> Column:
    """Trims, empties void marks, drops empty rows, then columns that are empty throughout."""
    def tidy(c: Column) -> Column:
        return F.coalesce(F.when(~F.trim(c).isin(*_VOID), F.trim(c)), F.lit(""))

    def used(rows: Column) -> Column:
        places = F.transform(rows, lambda r: F.filter(F.transform(r, lambda c, k: F.when(c != "", k)), lambda k: k.isNotNull()))
        return F.array_sort(F.array_distinct(F.flatten(places)))

    def kept(rows: Column) -> Column:
        return once(used(rows), lambda every: F.transform(rows, lambda r: F.transform(every, lambda k: F.coalesce(F.get(r, k), F.lit("")))))

    trimmed = F.transform(cells, lambda r: F.transform(r, tidy))
    return once(F.filter(trimmed, lambda r: F.exists(r, lambda c: c != "")), kept)


def to_html(cells: Column) -> Column:
    """A table whose head numbers the columns; cells aren't escaped."""
    def written(cells: Column) -> Column:
        head = F.array_join(F.transform(F.get(cells, F.lit(0)), lambda _, k: F.concat(F.lit("<th>"), k.cast("string"), F.lit("</th>"))), "")
        body = F.array_join(F.transform(cells, lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))), ""), F.lit("</tr>"))), "")
        return F.when(F.size(cells) > 0, F.concat(F.lit("<table><thead><tr>"), head, F.lit("</tr></thead><tbody>"), body, F.lit("</tbody></table>")))

    return once(cells, written)


def table_elements(tables: DataFrame) -> DataFrame:
    """``[Table n]`` elements, n counting through a document: tables(doc_id, page_number, table_no, box, cells, ...)."""
    w = W.partitionBy("doc_id").orderBy("page_number", "table_no")
    html = F.regexp_replace(to_html(clean_cells(F.col("cells"))), r"[\r\n]", "")
    out = tables.withColumns({"table_html": html, "n": F.row_number().over(w)}).where("table_html is not null")
    return out.withColumns({"text": F.format_string("[Table %d]", "n"), "element_type": F.lit("TABLE_BODY")}).drop("n", "cells")


def summary(tables: DataFrame) -> DataFrame:
    """doc_id, tables: page, box, accuracy (0 if unknown) and flavor (lattice if unknown) of a document's tables in order."""
    known = lambda name, other: F.coalesce(F.col(name), F.lit(other)) if name in tables.columns else F.lit(other)
    row = F.struct(F.col("page_number").alias("page"), F.array("x0", "y0", "x1", "y1").alias("bbox"), known("accuracy", 0.0).alias("accuracy"), known("flavor", "lattice").alias("flavor"))
    rows = tables.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "table_no", row.alias("t")))).alias("rows"))
    return rows.select("doc_id", F.col("rows.t").alias("tables"))
