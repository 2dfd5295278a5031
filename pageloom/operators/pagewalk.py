"""Greedy walks over a page as one aggregate: its rows are sorted into an array and folded in order.

The fold runs inside the JVM, on any number of pages in a task; a page must fit in memory.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = ["doc_id", "page_number"]
SIDES = ("x0", "y0", "x1", "y1")
Rule = Callable[[Column, Column], Column]


def page_rows(rows: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """doc_id, page_number, rows: a page's rows in order."""
    others = [c for c in rows.columns if c not in PAGE and c not in order]
    return rows.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct(*order, *others))).alias("rows"))


def spread(pages: DataFrame, columns: list[str]) -> DataFrame:
    return pages.select(*PAGE, F.explode("rows").alias("r")).select(*[F.col(c) if c in PAGE else F.col(f"r.{c}") for c in columns])


def united(a: Column, b: Column) -> Column:
    """a with the box of both."""
    for side, f in (("x0", F.least), ("y0", F.least), ("x1", F.greatest), ("y1", F.greatest)):
        a = a.withField(side, f(a[side], b[side]))
    return a


def shared(a: Column, b: Column) -> Column:
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def area(a: Column) -> Column:
    return (a["x1"] - a["x0"]) * (a["y1"] - a["y0"])


def fold_runs(pages: DataFrame, joins: Rule, merge: Rule) -> DataFrame:
    """Each row joins the group before it where the rule says so, and else begins one."""
    first, rest = F.get("rows", F.lit(0)), F.slice("rows", F.lit(2), F.greatest(F.size("rows") - 1, F.lit(0)))
    start = F.struct(F.slice("rows", 1, 0).alias("done"), first.alias("now"))

    def step(s: Column, r: Column) -> Column:
        goes = F.coalesce(joins(s["now"], r), F.lit(False))
        return F.struct(F.when(goes, s["done"]).otherwise(F.concat(s["done"], F.array(s["now"]))).alias("done"), F.when(goes, merge(s["now"], r)).otherwise(r).alias("now"))

    return pages.withColumn("rows", F.aggregate(rest, start, step, lambda s: F.concat(s["done"], F.array(s["now"]))))


def fold_first(pages: DataFrame, joins: Rule, merge: Rule) -> DataFrame:
    """Each row joins the first group of the page that the rule accepts, and else begins one."""

    def step(groups: Column, r: Column) -> Column:
        at = F.array_position(F.transform(groups, lambda a: joins(a, r)), F.lit(True))
        grown = F.transform(groups, lambda a, k: F.when(k + 1 == at, merge(a, r)).otherwise(a))
        return F.when(at > 0, grown).otherwise(F.concat(groups, F.array(r)))

    return pages.withColumn("rows", F.aggregate("rows", F.slice("rows", 1, 0), step))
