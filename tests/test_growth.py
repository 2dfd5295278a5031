"""Large and odd rows: what one row costs must follow its size."""

import random
import re
import time
import unicodedata

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pageloom.functions import cleaners as c
from pageloom.functions import measures as m
from pageloom.functions import patterns as p
from pageloom.operators import characters
from pageloom.plans.catalog import QUERIES
from pageloom.sources import tables


def _plain_html(cells):
    rows = [["" if c is None or c.strip(" ") in ("", "nan", "NaN", "NULL") else c.strip(" ") for c in r] for r in cells]
    rows = [r for r in rows if any(r)]
    keep = [k for k in range(max(map(len, rows), default=0)) if any(k < len(r) and r[k] for r in rows)]
    rows = [[r[k] if k < len(r) else "" for k in keep] for r in rows]
    head = "".join(f"<th>{k}</th>" for k in range(len(keep)))
    body = "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows)
    return f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>" if rows else None


def test_large_and_ragged_tables(spark):
    """A table's time follows its cells: 500 rows of 40 cells took minutes when the columns were sought anew for each row."""
    large = [["nan" if (i * 7 + k) % 3 == 0 or k == 5 else f" {i}.{k} " for k in range(40)] for i in range(500)]
    grids = [large, [["", "x"], [], ["a", "", "", "b"], [None], ["NULL", " "]], [["", "nan"]], [[]]]
    df = spark.createDataFrame([(k, g) for k, g in enumerate(grids)], "k long, cells array<array<string>>")
    start = time.monotonic()
    got = dict(df.select("k", tables.to_html(tables.clean_cells(F.col("cells")))).collect())
    assert time.monotonic() - start < 30
    assert got == {k: _plain_html(g) for k, g in enumerate(grids)}


def test_patterns_need_no_stack(spark):
    """A line of 100,000 words, or of as many numbers, overflowed the stack of Java's recursive groups."""
    words, dotted = "word " * 100_000 + "end", "1" + ".1" * 100_000
    df = spark.createDataFrame([(words,), (words + "!",), (dotted + " x",), (dotted,)], "t string")
    flags = df.select(*[p.matches(F.col("t"), v).alias(k) for k, v in p.PATTERN_FLAGS.items()], p.listed(F.col("t")).alias("listed"), p.margin_heading(F.col("t"), F.lit(0.0)).alias("at_margin"), F.regexp_extract("t", p.java(p.SECTION_NUMBER), 1).alias("number")).collect()
    assert [r.heading_line for r in flags] == [r.at_margin for r in flags] == [True, False, False, False]
    assert [r.caption_start for r in flags] == [False, False, True, False] and [r.listed for r in flags] == [False, False, True, False]
    assert [len(r.number) for r in flags] == [0, 0, len(dotted), 0]


def test_java_forms_find_the_same(spark):
    draw = random.Random(5)
    texts = ["".join(draw.choice(["a", "B", "1", ".", "-", " ", "  ", "\t", ";", ":", "1.1", "x y", ")"]) for _ in range(draw.randrange(9))) for _ in range(4000)]
    patterns = [v for v in (*p.PATTERN_FLAGS.values(), p.LISTED, p.SECTION_NUMBER) if p.java(v) != v]
    assert len(patterns) == 5
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", *[F.struct(F.regexp_extract("t", v, 0).alias("a"), F.col("t").rlike(v).alias("b"), F.regexp_extract("t", p.java(v), 0).alias("c"), F.col("t").rlike(p.java(v)).alias("d")).alias(f"p{k}") for k, v in enumerate(patterns)]).collect()
    for k, v in enumerate(patterns):
        assert all(r[k + 1].b == r[k + 1].d and (v == p.MAPI or r[k + 1].a == r[k + 1].c) for r in found), v
        assert 20 < sum(r[k + 1].b for r in found) < 3980 or v == p.MAPI


def test_runs_in_rows_agree_with_runs_as_rows(spark):
    """Fonts that tie, lines of any length and numbers; nothing but pages' sums is moved between executors."""
    draw = random.Random(7)
    names = "doc_id long, page_number long, seq long, x0 double, y0 double, x1 double, y1 double, runs array<struct<line_no: long, run_no: long, text: string, font_name: string, size: double, width: double, height: double, n: long>>"
    rows = []
    for k in range(200):
        places = sorted({(draw.randrange(5), draw.randrange(12)) for _ in range(draw.randrange(1, 30))})
        runs = [(i, j, "w" * draw.randrange(1, 9), draw.choice(["Times", "Courier-Bold", "x-italic", "Mono"]), float(draw.randrange(8, 15)), float(draw.randrange(4, 8)), float(draw.randrange(9, 14)), draw.randrange(1, 9)) for i, j in places]
        rows.append((k % 7, k % 3, k, 0.0, 0.0, float(k % 5), 10.0, runs))
    blocks = spark.createDataFrame(rows, names)
    flat = blocks.select("doc_id", "page_number", "seq", F.inline("runs"))
    pairs = [
        (characters.block_styles(blocks.drop("x0", "y0", "x1", "y1")), characters.styles(flat, characters.BLOCK)), (characters.block_regions(blocks), characters.regions(flat, blocks)),
        (characters.block_lines(blocks), characters.blocks_of_lines(characters.lines(flat)).select("doc_id", "page_number", "seq", "lines", "text")), (characters.block_spacing(blocks), characters.spacing(flat)),
    ]
    for k, (a, b) in enumerate(pairs):
        rounded = lambda v: round(v, 9) if isinstance(v, float) else [rounded(x) for x in v] if isinstance(v, (list, tuple)) else v
        columns = sorted(a.columns)
        assert columns == sorted(b.columns) and [a.schema[c].dataType.simpleString() for c in columns] == [b.schema[c].dataType.simpleString() for c in columns]
        assert sorted(map(repr, map(rounded, a.select(columns).collect()))) == sorted(map(repr, map(rounded, b.select(columns).collect())))
        assert a._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == (k == 3)


@pytest.mark.parametrize("name", ["src06_block_lines", "a04_block_styles", "a10_regions"])
def test_styles_move_no_words(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def _plain_measures(t):
    letter, upper, lower = (lambda c: unicodedata.category(c)[0] == "L"), (lambda c: unicodedata.category(c) == "Lu"), (lambda c: unicodedata.category(c) == "Ll")
    words = [w for w in re.split(r"[ \t\n]+", t) if any(map(letter, w))]
    small = [w for w in re.sub("[^a-z]+", " ", t.lower()).split()]
    verbs = [w for w in small if w in m.VERBS or re.search(m.VERB_ENDING, w)]
    nouns = [w for w in small if w not in verbs and w not in m.STOP_WORDS]
    share = lambda a, b: a / b if b else 0.0
    return [len(words), share(sum(upper(w[0]) or not any(map(lower, w)) for w in words), len(words)), share(sum(map(len, words)), len(words)), bool(verbs), share(len(nouns), len(small))]


def test_measures_of_long_and_odd_texts(spark):
    """Against a plain version; a token of 100,000 marks was tried anew from each of them, which took minutes."""
    draw = random.Random(3)
    parts = ["A", "b", "É", "é", "9", "-", "?!", " ", "  ", "\n", "is ", "Walking ", "red", "sing", "ǅ", "中", "of "]
    texts = ["", "---", *("".join(draw.choice(parts) for _ in range(draw.randrange(25))) for _ in range(1500)), "=" * 100_000 + " Word", "Aa is " * 30_000]
    t = F.col("t")
    start = time.monotonic()
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", m.word_total(t), m.cap_ratio(t), m.average_word_length(t), m.has_verb(t), m.noun_ratio(t)).collect()
    assert time.monotonic() - start < 30
    for r in got:
        assert list(r[1:]) == pytest.approx(_plain_measures(r.t)), r.t[:80]


def test_moves_are_handed_over_in_parts(spark, monkeypatch):
    """Against the character by character search, in parts of a few characters."""
    draw = random.Random(11)
    texts = [None, "", " \n ", *("".join(draw.choice(["a", "b", "é", "𝒳", " ", "  ", "\n", "\t", "\u00a0", "\x1c"]) for _ in range(draw.randrange(30))) for _ in range(500))]
    monkeypatch.setattr(c, "_AT_ONCE", 40)
    parts = list(c.extra_whitespace_moved.func(iter([pd.Series(texts)])))
    assert len(parts) > 100 and sum(map(len, parts)) == len(texts)
    for t, (clean, moved) in zip(texts, [r for part in parts for r in part.itertuples(index=False)]):
        if t is None:
            assert clean is None and moved is None
            continue
        at, plain = 0, []
        for x in clean:
            while at < len(t) and t[at] != x and not (x.isspace() and t[at].isspace()):
                at += 1
            plain.append(at - len(plain))
            at += at < len(t)
        assert list(moved) == plain


def test_cleaning_names_the_text_once(spark):
    """Each step named the text some times, so the steps' expressions multiplied to some hundred copies."""
    plan = spark.createDataFrame([("x",)], "t string").select(c.clean(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") < 30


def test_longest_common_subsequence_of_long_texts(spark):
    """Two texts of 30,000 words each: their table has 900 million cells."""
    draw = random.Random(2)
    a = [draw.choice(["one", "two", "three", "four"]) for _ in range(30_000)]
    b = [w for k, w in enumerate(a) if k % 10]
    start = time.monotonic()
    got = m.weighted_similarity.func(pd.Series([" ".join(a)]), pd.Series([" ".join(b)]))[0]
    assert time.monotonic() - start < 20
    assert got == pytest.approx(0.35 + 0.25 * len(b) / len(a) + 0.4, abs=0.05)


def test_scored_text_is_cleaned_once(spark, sf):
    plan = QUERIES["c12_scored_elements"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 6 and "collect_list(font_size" in plan and "max_by" not in plan


def test_main_cascade_measures_once(spark, sf):
    """The measures' expressions were copied into each test of the cascade that names them."""
    plan = QUERIES["c01_main_elements"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") < 40
