"""Literal cases, the golden page, properties, files and streams of the layout engine."""

import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pageloom.functions import cleaners as c
from pageloom.functions import geometry as g
from pageloom.functions import patterns as p
from pageloom.functions import measures as m
from pageloom.operators import characters, classify, grouping, spatial, splits, stats
from pageloom.sources import files, layout, tables
from pageloom.streaming import documents as stream


def ask(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("v")).first().v


def box(*sides):
    return g.Box(*[F.lit(float(s)) for s in sides])


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_geometry_literals(spark):
    assert list(value(spark, g.flip(box(10, 700, 110, 712), F.lit(792.0)).struct())) == [10, 80, 110, 92]
    assert value(spark, g.iou(box(0, 0, 10, 10), box(5, 5, 15, 15))) == pytest.approx(25 / 175)
    assert value(spark, g.iou(box(0, 0, 10, 10), box(10, 0, 20, 10))) == 0
    assert value(spark, g.iou(box(0, 0, 10, 10), box(0, 0, 10, 20))) == 0.5
    assert value(spark, g.containment(box(0, 0, 10, 10), box(0, 0, 10, 20))) == 1
    assert list(value(spark, g.expanded(box(5, 5, 610, 790), F.lit(612.0), F.lit(792.0)).struct())) == [0, 0, 612, 792]
    assert value(spark, g.area(box(5, 5, 1, 9))) == 0 and value(spark, g.raw_area(box(5, 5, 1, 9))) == -16


def test_boxes_in_general(spark):
    rows = [(float(a), float(b), float(a + w), float(b + h), float(x), float(y), float(x + 7), float(y + 5)) for a in (0, 3) for b in (0, 4) for w in (1, 6) for h in (2, 9) for x in (0, 2, 8) for y in (1, 5)]
    df = spark.createDataFrame(rows, "x0 double, y0 double, x1 double, y1 double, p_x0 double, p_y0 double, p_x1 double, p_y1 double")
    a, b = g.Box.of(), g.Box.of("p_")
    whole = g.merged(a, b)
    bad = df.where((g.iou(a, b) != g.iou(b, a)) | (g.iou(a, b) < 0) | (g.iou(a, b) > 1) | ~g.within(a, whole, 0.0) | ~g.within(b, whole, 0.0))
    assert bad.count() == 0


LISTS = [("• item", True, True), ("- item", True, True), ("-5 degrees", True, False), ("1. first", True, True), ("1. First", False, True), ("10. first", False, True), ("1) first", False, True), ("1.2.3 scope", False, False), ("a. item", True, True), ("A. Item", False, True), ("2021 was", True, False), ("plain", False, False)]


@pytest.mark.parametrize("text,item,start", LISTS)
def test_list_predicates(spark, text, item, start):
    assert ask(spark, text, p.list_item) is item
    assert ask(spark, text, lambda t: t.rlike(p.LIST_START)) is start


@pytest.mark.parametrize("text,kind,number", [("• x", "bullet", None), ("3) x", "number", 3), ("c. x", "letter", 3), ("iv. x", "roman", None), ("i. x", "letter", 9), ("-3", "bullet", None)])
def test_list_pattern(spark, text, kind, number):
    assert tuple(ask(spark, text, p.list_pattern)) == (kind, number)


def test_page_numbers_and_captions(spark):
    for t in ("12", "- 12 -", "[3]", "Page 3", "page 3 of 9", "3 / 9", "p. 4"):
        assert ask(spark, t, lambda x: x.rlike(p.PAGE_NUMBER)), t
    assert not ask(spark, "4 pages", lambda x: x.rlike(p.PAGE_NUMBER))
    for t, hit in (("Figure 1: Layout", True), ("Fig. 2.1 x", True), ("12 monkeys", True), ("Notebook", True), ("Table of contents", False)):
        assert ask(spark, t, lambda x: x.rlike(p.CAPTION)) is hit, t


CLEANERS = [
    (c.extra_whitespace, "a  b\n\n\n c ", "a b\nc"), (c.dehyphenated, "exam-\nple", "example"), (c.dehyphenated, "éa-\nàb", "éaàb"), (c.bullets, "• • item", "item"), (c.ordered_bullets, "1. Introduction text", "Introduction text"),
    (c.ordered_bullets, "1.1.2 Scope of", "Scope of"), (c.ordered_bullets, "Hello. World", "Hello. World"), (c.dashes, "a-b—c", "a b c"), (c.trailing_punctuation, "end.,;", "end"), (c.ip_addresses, "10.0.0.1 and 999.1.1.1", ["10.0.0.1", "999.1.1.1"]),
    (c.phone_numbers, "call 215-867-5309 or 555-123-4567", ["215-867-5309"]), (c.auto_paragraphs, "a\nb", "a\n\nb"), (c.ligatures, "ﬁne ½", "fine 1⁄2"), (c.mime_decoded, "caf=C3=A9", "café"), (c.mime_decoded, "=FF", "=FF"), (c.printable, "a​b\x07\n", "ab\n"),
    (c.clean, "•  exam-\nple — text.\n\n", "example   text".replace("   ", " ")), (c.broken_paragraphs, "one two three four five\nsix\n\na\nb", "one two three four five six\n\na\n\nb"), (c.mapi_ids, "x 12345678-1234-1234-1234-123456789ABC; y", ["12345678-1234-1234-1234-123456789ABC"]),
    (c.image_urls, '<img class="x" src="a.png">', ["a.png"]), (lambda t: c.text_before(t, "and", 1), "a and b and c", "a and b"), (lambda t: c.text_after(t, "and", 1), "a and b and c", "c"), (lambda t: c.text_after(t, "and", 1), "a and b", None), (lambda t: c.without_prefix(t, "SUM"), "SUM x", "x"),
]


@pytest.mark.parametrize("f,text,out", CLEANERS)
def test_cleaners(spark, f, text, out):
    assert ask(spark, text, f) == out


@pytest.mark.parametrize("text,out", [("1.1 t", ("1", "1", None)), ("a.b.c x", ("a", "b", "c")), ("1. x", ("1", None, None)), ("text", (None, None, None)), ("", (None, None, None))])
def test_ordered_bullet_parts(spark, text, out):
    assert tuple(ask(spark, text, c.ordered_bullet_parts)) == out


def test_first_date_and_moves(spark):
    assert ask(spark, "Date: Fri, 26 Mar 2021 11:04:09 +1200 x", c.first_date).isoformat() in ("2021-03-25T23:04:09",)
    got = ask(spark, " a  b\n\n c", c.extra_whitespace_moved)
    assert got.text == "a b\nc" and len(got.moved) == 5 and got.moved[0] == 1


def blocks(spark, rows):
    """(page, seq, text, x0, y0, x1, y1) and optionally size, bold, type."""
    full = [(1, r[0], r[1], r[2], *map(float, r[3:7]), 612.0, 792.0, "Times-Bold" if len(r) > 8 and r[8] else "Times", float(r[7]) if len(r) > 7 else 12.0, bool(len(r) > 8 and r[8]), False, r[9] if len(r) > 9 else "TEXT") for r in rows]
    names = "doc_id long, page_number long, seq long, text string, x0 double, y0 double, x1 double, y1 double, page_width double, page_height double, font_name string, font_size double, is_bold boolean, is_italic boolean, element_type string"
    return spark.createDataFrame(full, names)


def test_table_anti_join_thresholds(spark):
    b = blocks(spark, [(1, 1, "x", 100, 100, 200, 112)])
    area = lambda x0: spark.createDataFrame([(1, 1, 1, x0 + 8.0, 98.0, 400.0, 300.0)], "doc_id long, page_number long, table_no long, x0 double, y0 double, x1 double, y1 double")
    assert spatial.outside_tables(b, area(180.0)).count() == 0
    assert spatial.outside_tables(b, area(190.0)).count() == 1


def test_list_groups(spark):
    b = blocks(spark, [(1, 1, "- a", 72, 100, 200, 112, 12, False, "LIST_ITEM"), (1, 2, "- b", 72, 118, 200, 130, 12, False, "LIST_ITEM"), (1, 3, "- c", 90, 136, 200, 148, 12, False, "LIST_ITEM")])
    ids = {r.seq: r.list_group_id for r in grouping.list_groups(b).collect()}
    assert ids[1] == ids[2] != ids[3]


def test_absorb_and_grow(spark):
    b = blocks(spark, [(1, 1, "a", 0, 0, 100, 20), (1, 2, "b", 0, 0, 100, 22), (1, 3, "c", 300, 0, 400, 20)])
    out = {r.seq: (r.text, r.y1) for r in spatial.absorb_overlaps(b).collect()}
    assert out == {1: ("a b", 22.0), 3: ("c", 20.0)}
    assert {r.seq: r.y1 for r in spatial.merge_growing(b).collect()} == {1: 22.0, 3: 20.0}


def brute_exact_lists(rows):
    out, head, last, bottom = [], None, None, None
    for r in rows:
        if r[3] is None:
            head = None
            continue
        kind, number, x0, y0, y1 = r[3:8]
        go = head is not None and abs(y0 - bottom) <= 20 and kind == head[3] and abs(x0 - head[5]) <= 5 and (kind != "number" or number == last + 1)
        head = head if go else r
        out.append((r[2], head[2]))
        last, bottom = number, y1
    return out


def test_exact_list_contexts(spark):
    rows = [(1, k, f"{n}. x", 72 + 2 * k, 100 + 18 * k, 200, 112 + 18 * k, 12, False, "ListItem") for k, n in enumerate([1, 2, 3, 5, 6, 7])]
    got = sorted((r.seq, r.head_seq) for r in grouping.list_contexts_exact(blocks(spark, rows)).collect())
    assert got == [(0, 0), (1, 0), (2, 0), (3, 3), (4, 3), (5, 3)]
    assert [x for _, x in brute_exact_lists([(1, 1, k, "number", n, 72 + 2 * k, 100 + 18 * k, 112 + 18 * k) for k, n in enumerate([1, 2, 3, 5, 6, 7])])] == [0, 0, 0, 3, 3, 3]


def test_split_markers(spark):
    b = blocks(spark, [(1, 1, "Head", 72, 50, 200, 62), (1, 2, "to be continued", 72, 700, 200, 712), (2, 3, "Head", 91, 50, 200, 62), (2, 4, "open end", 72, 700, 200, 712), (3, 5, "other", 72, 50, 200, 62)])
    kinds = sorted((r.split_type, r.source_page) for r in splits.split_markers(b).collect())
    assert kinds == [("CONTINUATION", 1), ("SPLIT_HEADER", 1), ("SPLIT_PARAGRAPH", 2)]
    marked = splits.annotate(b, splits.split_markers(b)).where("splits is not null")
    assert {r.seq for r in marked.collect()} == {1, 2, 3, 4, 5}
    assert splits.of_page(splits.split_markers(b), 3).count() == 1


def test_title_with_section_number(spark):
    b = blocks(spark, [(1, 1, "1.2 System Overview", 72, 100, 300, 112)])
    r = classify.main_elements(b.drop("element_type")).first()
    assert (r.element_type, r.confidence, r.title_level) == ("TITLE", 0.9, 2)


def test_aliases(spark):
    assert value(spark, classify.canonical_type(F.lit("HEADER"))) == "TITLE" and value(spark, classify.canonical_type(F.lit("LIST"))) == "LIST"


def test_medians(spark):
    b = blocks(spark, [(1, k, "x", 0, 0, 10, 12, s) for k, s in enumerate((10, 12, 14, 16))])
    assert stats.scored_document_stats(b).first().median_font_size == 14
    assert stats.document_stats(b).first().median_font_size == 13


def test_folio(spark):
    b = blocks(spark, [(1, 1, "3", 300, 780, 306, 790, 9), (1, 2, "body text here.", 72, 300, 300, 312, 12)])
    assert {r.seq: (r.element_type, r.confidence) for r in classify.fast_elements(b.drop("element_type")).collect()}[1] == ("PageNumber", 1.0)


def test_golden_page(spark):
    """A page of prose and one folio comes out in full, as text, from the top down."""
    tops = [773, 702, 595, 506, 445, 412, 337, 303, 242, 208]
    rows = [(1, k, "6" if k == 0 else f"Prose of block {'abcdefghij'[k]}, which goes on for more than fifteen words so that nobody would call it a title at all.", 57 if k else 295, y, 300 if k else 301, y + 12) for k, y in enumerate(tops)]
    out = classify.main_elements(grouping.merged_blocks(blocks(spark, rows).drop("element_type")))
    got = [(r.element_type, r.confidence) for r in out.orderBy("y0").collect()]
    assert len(got) == 10 and set(got[:-1]) == {("TEXT", 0.7)}


def test_tables_to_html(spark):
    df = spark.createDataFrame([(1, 1, 1, [[" a ", "nan", "b"], ["", "NULL", ""], ["c", None, "d"]])], "doc_id long, page_number long, table_no long, cells array<array<string>>")
    r = tables.table_elements(df).first()
    assert r.text == "[Table 1]" and r.table_html.endswith("<tbody><tr><td>a</td><td>b</td></tr><tr><td>c</td><td>d</td></tr></tbody></table>")


def test_json_round_trip(spark, tmp_path):
    b = blocks(spark, [(1, 2, "later", 72, 200, 90, 212), (1, 1, "first", 72, 100, 90, 112), (2, 3, 'quoted "x"\n', 72, 100, 90, 112)])
    files.write_page_json(b, str(tmp_path / "out"))
    from pyspark.sql import types as T

    element = T.StructType([f for f in b.schema.fields if f.name not in ("doc_id", "page_number")])
    schema = T.StructType().add("doc_id", "long").add("page_number", "long").add("elements", T.ArrayType(element))
    again = files.read_elements(spark, str(tmp_path / "out"), schema)
    assert sorted(map(tuple, again.select(b.columns).collect())) == sorted(map(tuple, b.collect()))
    assert files.page_json(b).where("page_number = 1").first().json.index("first") < files.page_json(b).where("page_number = 1").first().json.index("later")


def test_validation(spark):
    df = spark.createDataFrame([('{"a": 1, "b": [1, 2]}',), ('{"a": "x", "b": ["q"]}',), ("[]",), ('{"b": 3}',)], "json string")
    errors = [r.errors for r in files.validate(df, {"a": "int"}, {"b": "int"}).collect()]
    assert errors[0] == [] and errors[1] == ["a is not int", "b has items that are not int"] and errors[2][0] == "not an object" and "a is missing" in errors[3]


def test_binary_scan_and_images(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-")
    (tmp_path / "b.txt").write_bytes(b"no")
    assert [r.length for r in files.documents_in(spark, str(tmp_path)).collect()] == [5]
    images = spark.createDataFrame([(1, 60, 50, bytearray(b"x" * 2048)), (2, 49, 80, bytearray(b"y"))], "seq long, width int, height int, content binary")
    r = files.image_elements(images).collect()
    assert len(r) == 1 and r[0].size_kb == 2.0 and r[0].text.startswith("img_")


def test_html_blocks(spark):
    df = spark.createDataFrame([(1, "<html><nav><ul><li>menu</li></ul></nav><h1>Title &amp; more</h1><p class='x'>one <b>two</b></p></html>")], "page_id long, html string")
    assert [(r.tag, r.text) for r in files.html_blocks(df).orderBy("seq").collect()] == [("h1", "Title & more"), ("p", "one two")]


def test_stream_equals_batch(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").repartition(3).write.parquet(str(tmp_path / "in"))
    query = stream.write(stream.stream_items(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select("doc_id", "seq", "element_type")
    text = F.col("text")
    kind = F.when(text.rlike(p.PAGE_NUMBER), "PageNumber").when(p.list_pattern(text).isNotNull(), "ListItem")
    batch = layout.load_blocks(spark, sf).withColumn("element_type", kind).where("element_type is not null").select("doc_id", "seq", "element_type")
    assert got.count() == batch.count() > 0 and got.exceptAll(batch).count() == 0


@pytest.mark.parametrize("rule,joined", [(grouping.region_rule, 1), (grouping.element_rule, 1), (grouping.text_block_rule, 1)])
def test_merge_runs(spark, rule, joined):
    b = blocks(spark, [(1, 1, "breaks off here-", 72, 100, 300, 112), (1, 2, "and goes on", 72, 118, 300, 130), (1, 3, "Far below.", 72, 400, 300, 412)])
    out = grouping.merge_runs(b, rule).orderBy("seq").collect()
    assert [r.seq for r in out] == [1, 3] and out[0].y1 == 130.0


def test_repartitioning_changes_nothing(spark):
    b = blocks(spark, [(pg, s, f"- t{s}", 72, 100 + 15 * s, 200, 112 + 15 * s, 12, False, "LIST_ITEM") for pg in (1, 2) for s in range(8)])
    one = sorted(map(tuple, grouping.list_groups(b.coalesce(1)).select("page_number", "seq", "list_group_id").collect()))
    assert one == sorted(map(tuple, grouping.list_groups(b.repartition(5)).select("page_number", "seq", "list_group_id").collect()))
    assert pd.DataFrame(one)[2].nunique() == 2


def test_running_text_is_all_but_page_numbers(spark):
    from pageloom.plans import elements

    rows = [(k, t, x, y, x + 40.0, y + 12.0, 612.0, 792.0) for k, (t, x, y) in enumerate([("one", 72.0, 72.0), ("two", 72.0, 102.0), ("1987", 290.0, 132.0), (None, 290.0, 760.0), ("12", 72.0, 760.0), ("12", 290.0, 766.0)])]
    blocks = spark.createDataFrame(rows, "seq long, text string, x0 double, y0 double, x1 double, y1 double, page_width double, page_height double")
    assert sorted(r.seq for r in elements._without_folios(blocks).collect()) == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("a,b,low,high", [("Same Text", "same text ", 1, 1), ("a", "abcdef", 0, 0), ("one two three", "one two four", 0.4, 0.8), ("step 12 done", "step 12 gone", 0.7, 1), ("kitten", "sitting", 0, 0.3)])
def test_weighted_similarity(spark, a, b, low, high):
    got = spark.createDataFrame([(a, b)], "a string, b string").select(m.weighted_similarity(F.col("a"), F.col("b")).alias("v")).first().v
    assert low <= got <= high


def brute_weighted(x, y):
    x, y = x.lower().strip(), y.lower().strip()
    s, t = x.split(), y.split()
    table = [[0] * (len(t) + 1) for _ in range(len(s) + 1)]
    for i, u in enumerate(s):
        for j, v in enumerate(t):
            table[i + 1][j + 1] = table[i][j] + 1 if u == v else max(table[i][j + 1], table[i + 1][j])
    sets = [({u for u in s if u not in m.STOP_WORDS}, {v for v in t if v not in m.STOP_WORDS}), *[({x[i : i + n] for i in range(len(x) - n + 1)}, {y[i : i + n] for i in range(len(y) - n + 1)}) for n in (3, 2)]]
    shares = [len(p & q) / len(p | q) if p | q else 0.0 for p, q in sets]
    digits = [re.findall("[0-9]+", v) for v in (x, y)]
    bonus = 0.3 if digits[0] and digits[0] == digits[1] else 0.0
    return min(1.0, 0.35 * shares[0] + 0.25 * shares[1] + 0.15 * shares[2] + 0.25 * table[-1][-1] / max(len(s), len(t), 1) + bonus)


def test_weighted_similarity_against_brute_force(spark):
    words, r = ["the", "red", "12", "house", "of", "7", "stone", "a"], random.Random(3)
    pairs = [(" ".join(r.choices(words, k=r.randint(3, 6))), " ".join(r.choices(words, k=r.randint(3, 6)))) for _ in range(80)]
    pairs = [(a, b) for a, b in pairs if a != b and min(len(a), len(b)) * 2 >= max(len(a), len(b))]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", m.weighted_similarity(F.col("a"), F.col("b")).alias("v")).collect()
    assert len(got) > 40 and all(x.v == pytest.approx(brute_weighted(x.a, x.b)) for x in got)


@pytest.mark.parametrize("text,out", [("• one\ntwo • three", ["one two ", " three"]), ("e first item", [" first item"]), ("plain", ["plain"]), ("•", [])])
def test_bullet_paragraphs(spark, text, out):
    got = ask(spark, text, c.bullet_paragraphs)
    assert [x.strip() for x in got] == [x.strip() for x in out]


def points(spark, columns):
    r = spark.range(1).select(*[v.alias(k) for k, v in columns.items()]).first()
    return r["points"]


def test_second_title_scores(spark):
    lit = F.lit
    score = lambda t, size=12.0, bold=False, y=0.5: points(spark, classify.likely_title(lit(t), lit(size), lit(12.0), lit(bold), lit(False), lit(y)))
    assert score("1.2 Overview", 18.0, True) == 30 + 20 + 10 + 10 + 30
    assert score("RESULTS") == 25 and score("RESULTS", y=0.05) == 10 and score("x") == 0
    assert score("One. Two. Three.") == 0 and score("A. Lone title") == 10 + 25 and score("Chapter 3") == 10 + 10 + 25
    title = lambda t, size=12.0, bold=False: points(spark, classify.analysed_title(lit(t), lit(size), lit(12.0), lit(bold)))
    assert title("Plain words") == 0 and title("Plain words", 18.0, True) == 100 and title("LOUD") == 80 and title("2.1 Methods") == 90
    margin = lambda t, size=12.0: points(spark, classify.analysed_margin(lit(t), lit(size), lit(12.0), lit(False)))
    assert margin("short", 9.0) == 90 and margin("short") == 80 and margin("x" * 90) == 0


def test_types_before_and_after_classification(spark):
    pre = lambda t, bold=False, table=False: value(spark, classify.pre_type(F.lit(t), F.lit(bold), F.lit(table)))
    assert [pre("Table 3."), pre("figure 2"), pre("1. x"), pre("• x"), pre("Short", True), pre("text"), pre("x", table=True)] == ["TABLE_CAPTION", "FIGURE_CAPTION", "LIST_ITEM", "LIST_ITEM", "HEADING", "UNKNOWN", "TABLE_BODY"]
    last = lambda t: value(spark, classify.last_resort(F.lit(t)))
    assert [last("see the chart"), last("Note:"), last("12"), last("•"), last("other words")] == ["CAPTION", "HEADING", "PAGE_NUMBER", "LIST_ITEM", "TEXT"]


def test_character_styles(spark):
    names = "doc_id long, page_number long, seq long, line_no long, run_no long, text string, font_name string, size double, width double, height double, n long"
    runs = spark.createDataFrame([(1, 1, 1, 0, 0, "abc", "Mono-Bold", 10.0, 6.0, 10.0, 3), (1, 1, 1, 0, 1, "def", "Times", 14.0, 8.0, 14.0, 3), (1, 1, 1, 1, 0, "g", "Times-Italic", 12.0, 4.0, 12.0, 1)], names)
    r = characters.styles(runs, characters.BLOCK).first()
    assert (r.font_name, r.is_bold, r.is_monospace, r.any_italic, r.is_italic, r.unique_fonts, r.char_count) == ("Mono-Bold", True, True, True, False, 3, 7)
    assert r.avg_font_size == pytest.approx(84 / 7) and r.std_font_size == pytest.approx((24 / 7) ** 0.5)
    s = characters.spacing(runs).first()
    assert (s.avg_line_height, s.std_line_height) == (14.0, 0.0) and s.avg_char_width == pytest.approx(46 / 7)
    b = characters.blocks_of_lines(characters.lines(runs)).first()
    assert b.text == "abc def\ng" and [x.line_no for x in b.lines] == [0, 1]


def test_what_goes_on_with_a_list(spark):
    b = blocks(spark, [(1, 1, "Step 1: do", 72, 100, 200, 112), (1, 2, "and more", 74, 118, 200, 130), (1, 3, "still small", 74, 136, 200, 148), (1, 4, "Capital", 74, 154, 200, 166), (1, 5, "small again", 74, 172, 200, 184)])
    assert {r.seq: r.is_list_item for r in grouping.listed_runs(b).collect()} == {1: True, 2: True, 3: True, 4: False, 5: False}


def test_captions_on_the_next_page(spark):
    b = blocks(spark, [(1, 1, "words before", 72, 50, 200, 62), (2, 2, "Running on.", 72, 50, 200, 62), (2, 3, "Figure 4: over the page", 72, 400, 300, 412)])
    f = spark.createDataFrame([(1, 1, 1, 72.0, 300.0, 200.0, 380.0)], "doc_id long, page_number long, image_no long, x0 double, y0 double, x1 double, y1 double")
    assert [tuple(r) for r in spatial.captions_in_sequence(f, b).collect()] == [(1, 1, 1, 2, 3)]


def test_marker_filters_and_order(spark):
    b = blocks(spark, [(1, 1, "Head", 72, 50, 200, 62), (1, 2, "to be continued", 72, 700, 200, 712), (2, 3, "Head", 72, 50, 200, 62), (2, 4, "cont.", 72, 600, 200, 612)])
    every = splits.in_order(splits.split_markers(b))
    assert [r.split_type for r in every.orderBy("position").collect()] == ["CONTINUATION", "SPLIT_PARAGRAPH", "SPLIT_HEADER"]
    assert splits.continuing(every).count() == 1 and splits.splitting(every).count() == 2


def brute_touching(rows, gap=5.0, overlap=0.1):
    groups = []
    for r in sorted(rows, key=lambda r: (r[4], r[3], r[1])):
        box = r[3:7]
        for g_ in groups[-1:]:
            near = [max(max(box[0] - o[2], o[0] - box[2], 0), max(box[1] - o[3], o[1] - box[3], 0)) <= gap for o in g_[1]]
            if g_[0] == r[9] and any(near):
                g_[1].append(box)
                g_[2].append(r[1])
                break
        else:
            groups.append((r[9], [box], [r[1]]))
    return sorted((min(q), min(o[0] for o in b), min(o[1] for o in b), max(o[2] for o in b), max(o[3] for o in b)) for _, b, q in groups)


@pytest.mark.parametrize("seed", range(4))
def test_touching_boxes_against_brute_force(spark, seed):
    r = random.Random(seed)
    rows = []
    for k in range(25):
        x, y = r.randint(0, 60), r.randint(0, 80)
        rows.append((1, k, "t", x, y, x + r.randint(3, 20), y + r.randint(3, 9), 12, False, r.choice(["TEXT", "TITLE"])))
    got = sorted((x.seq, x.x0, x.y0, x.x1, x.y1) for x in spatial.merge_touching(blocks(spark, rows)).collect())
    assert got == [tuple(map(float, x)) for x in brute_touching(rows)]


READER = """
class LAParams:
    def __init__(self, **kw): self.kw = kw
class LTChar:
    def __init__(self, fontname, size): self.fontname, self.size = fontname, size
class LTTextLine(list): pass
class LTTextBox(list):
    def __init__(self, text, box, lines): super().__init__(lines); self.text = text; self.x0, self.y0, self.x1, self.y1 = box
    def get_text(self): return self.text
class Page(list):
    width, height = 612.0, 792.0
def extract_pages(stream, page_numbers=None, laparams=None):
    said = stream.read().decode()
    for n in range(3):
        if page_numbers is None or n in page_numbers:
            chars = [LTChar("Times-Bold", 10.0), LTChar("Times-Bold", 10.0), LTChar("Times", 16.0)]
            yield Page([LTTextBox(f" {said} {n} {laparams.kw['char_margin']} ", (72.0, 700.0, 110.0, 712.0), [LTTextLine(chars)]), LTTextBox(" ", (0, 0, 1, 1), [])])
"""


def test_pdf_pages_are_mapped_to_blocks(spark, tmp_path):
    """A stand-in for the reader tells what it was asked; pdfminer itself isn't here."""
    import zipfile

    with zipfile.ZipFile(tmp_path / "reader.zip", "w") as z:
        z.writestr("pdfminer/__init__.py", "")
        z.writestr("pdfminer/layout.py", READER)
        z.writestr("pdfminer/high_level.py", "from pdfminer.layout import extract_pages")
    spark.sparkContext.addPyFile(str(tmp_path / "reader.zip"))
    (tmp_path / "a.pdf").write_bytes(b"body")
    found = files.documents_in(spark, str(tmp_path))
    rows = files.pdf_blocks(found).orderBy("page_number").collect()
    assert [(r.page_number, r.text) for r in rows] == [(1, "body 0 2.0"), (2, "body 1 2.0"), (3, "body 2 2.0")]
    r = rows[0]
    assert (r.y0, r.y1, r.font_name, r.font_size, r.is_bold, r.page_height) == (80.0, 92.0, "Times-Bold", 12.0, True, 792.0)
    assert [(r.page_number, r.text) for r in files.pdf_blocks(found, files.STRICT, (3,)).collect()] == [(3, "body 2 1.0")]
