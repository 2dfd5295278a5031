"""Queries over scalar functions: geometry, predicates, cleaners, extractors and measures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import cleaners as c
from ..functions import geometry as g
from ..functions import measures as m
from ..functions import patterns as p
from ..sources.layout import load_blocks, with_layout

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def lit(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def rx(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {lit(pattern)})"


def r6(x: Column) -> Column:
    return F.round(x, 6)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("doc_id", "page_number").orderBy("seq")
    b = load_blocks(spark, sf_dir)
    return b.withColumns({f"p_{n}": F.lag(n).over(w) for n in ("x0", "y0", "x1", "y1")}).where("p_x0 is not null")


_PAIRS = with_layout("""
, pairs AS (SELECT * FROM (SELECT *, lag(x0) OVER w AS p_x0, lag(y0) OVER w AS p_y0, lag(x1) OVER w AS p_x1, lag(y1) OVER w AS p_y1 FROM blocks WINDOW w AS (PARTITION BY doc_id, page_number ORDER BY seq)) WHERE p_x0 IS NOT NULL
), m AS (SELECT *, greatest(0, least(x1, p_x1) - greatest(x0, p_x0)) AS ox, greatest(0, least(y1, p_y1) - greatest(y0, p_y0)) AS oy, (x1 - x0) * (y1 - y0) AS a, (p_x1 - p_x0) * (p_y1 - p_y0) AS b FROM pairs)
""")


@query(_PAIRS + """SELECT doc_id, seq, round(ox * oy, 6) AS shared, round(CASE WHEN ox * oy > 0 THEN ox * oy / (a + b - ox * oy) ELSE 0 END, 6) AS iou,
 round(CASE WHEN a > 0 THEN ox * oy / a ELSE 0 END, 6) AS inside, round(CASE WHEN a > 0 AND ox * oy / a >= 0.7 THEN ox * oy / a ELSE 0 END, 6) AS inside7, (a > 0 AND ox * oy / a >= 0.9) AS subregion,
 (x0 >= p_x0 - 2 AND y0 >= p_y0 - 2 AND x1 <= p_x1 + 2 AND y1 <= p_y1 + 2) AS within2,
 (x0 > p_x0 - 0.08 * (p_x1 - p_x0) AND x1 < p_x1 + 0.08 * (p_x1 - p_x0) AND y0 > p_y0 - 0.12 * (p_y1 - p_y0) AND y1 < p_y1 + 0.12 * (p_y1 - p_y0)) AS near_within,
 (abs(least(y1, p_y1) - greatest(y0, p_y0)) <= 0.5 AND ox / least(x1 - x0, p_x1 - p_x0) >= 0.5) AS stacked,
 least(x0, p_x0) AS mx0, least(y0, p_y0) AS my0, greatest(x1, p_x1) AS mx1, greatest(y1, p_y1) AS my1 FROM m""")
def g05_box_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersection, IoU, containment, merging and adjacency of consecutive boxes."""
    a, b = g.Box.of(), g.Box.of("p_")
    whole = g.merged(a, b)
    return _pairs(spark, sf_dir).select(
        "doc_id", "seq", r6(g.intersection(a, b)).alias("shared"), r6(g.iou(a, b)).alias("iou"), r6(g.containment(a, b)).alias("inside"), r6(g.containment(a, b, 0.7)).alias("inside7"), g.subregion(a, b).alias("subregion"),
        g.within(a, b).alias("within2"), g.near_within(a, b, 0.08, 0.12).alias("near_within"), g.stacked(a, b).alias("stacked"), *[x.alias(f"m{n}") for x, n in zip(whole, g.Box._fields)],
    )


@query(with_layout("""SELECT doc_id, seq, 792 - y1 AS fy0, 792 - y0 AS fy1, (x1 - x0) * (y1 - y0) AS area, round(x0 / 612, 6) AS nx0, round(y0 / 792, 6) AS ny0, round(1 - y1 / 792, 6) AS bottom_margin, round(1 - x1 / 612, 6) AS right_margin,
 round((x0 / 612 + x1 / 612) / 2, 6) AS center_x, round(x0 / 612, 6) AS indent_ratio, greatest(0, x0 - 8) AS ex0, least(612, x1 + 8) AS ex1, greatest(0, y0 - 8) AS ey0, least(792, y1 + 8) AS ey1, (x0 <= x1 AND y0 <= y1) AS valid,
 x1 AS corner2_x, y0 AS corner2_y, round(x0 / 612 * 612, 6) AS back_x0 FROM blocks"""))
def g01_box_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flip, area, normalised and relative positions, expansion, corners."""
    b, w, h = g.Box.of(), F.col("page_width"), F.col("page_height")
    up, n, at, e, tour = g.flip(b, h), g.normalised(b, w, h), g.position(b, w, h), g.expanded(b, w, h), g.corners(b)
    return load_blocks(spark, sf_dir).select(
        "doc_id", "seq", up.y0.alias("fy0"), up.y1.alias("fy1"), g.area(b).alias("area"), r6(n.x0).alias("nx0"), r6(n.y0).alias("ny0"), r6(at["bottom_margin"]).alias("bottom_margin"), r6(at["right_margin"]).alias("right_margin"),
        r6(at["center_x"]).alias("center_x"), r6(g.relative(b, w, h)["indent_ratio"]).alias("indent_ratio"), e.x0.alias("ex0"), e.x1.alias("ex1"), e.y0.alias("ey0"), e.y1.alias("ey1"), g.valid(b).alias("valid"),
        tour[1]["x"].alias("corner2_x"), tour[1]["y"].alias("corner2_y"), r6(g.denormalised(n, w, h).x0).alias("back_x0"),
    )


@query(with_layout("SELECT doc_id, seq, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY y0 DESC, x0, seq) AS position FROM blocks"))
def g18_spatial_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("doc_id", "page_number").orderBy(*g.columns_order(g.Box.of()), "seq")
    return load_blocks(spark, sf_dir).select("doc_id", "seq", F.row_number().over(w).cast("long").alias("position"))


@query(with_layout("SELECT doc_id, seq, " + ", ".join(f"{rx('text', v)} AS {k}" for k, v in p.PATTERN_FLAGS.items()) + " FROM blocks"))
def p00_pattern_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pattern predicates on every block."""
    return load_blocks(spark, sf_dir).select("doc_id", "seq", *[p.matches(F.col("text"), v).alias(k) for k, v in p.PATTERN_FLAGS.items()])


_TOKEN = r"regexp_extract(trim(text), '^\S+', 0)"


def list_item_sql(text: str = "text") -> str:
    return rf"""CASE WHEN trim({text}) = '' THEN false WHEN {rx(f'trim({text})', p.BULLET)} THEN true
 WHEN {rx('tok', p.ENUMERATED)} AND rest <> '' THEN NOT (dots > 1 OR (dots > 0 AND length(tok) > 2) OR regexp_matches(tok, '[)\]]')) AND NOT regexp_matches(rest, '^\p{{Lu}}')
 ELSE {rx(f'trim({text})', p.LETTERED)} AND NOT regexp_matches(trim(substr(trim({text}), 3)), '^\p{{Lu}}') END"""


TOKENS = rf", tk AS (SELECT *, {_TOKEN} AS tok, trim(substr(trim(text), length({_TOKEN}) + 1)) AS rest, length({_TOKEN}) - length(replace({_TOKEN}, '.', '')) AS dots FROM blocks)"


@query(with_layout(rf"""{TOKENS}
SELECT doc_id, seq, {list_item_sql()} AS list_item, ({rx('trim(text)', p.PLACE)} OR {rx('trim(text)', p.ADDRESS_START)} OR {rx('trim(text)', p.PHONE_END)}) AS contact,
 ((y0 / page_height <= 0.1 OR y0 / page_height >= 0.9) AND {rx('text', p.HEADING_LINE)}) AS margin_heading, (length(trim(text)) <= 10 AND regexp_matches(trim(text), '(?i)^(?:[+-]?\d+|page\s+\d+|\d+\s*/\s*\d+|-\s*\d+\s*-|\[\d+\])$')) AS short_number,
 ({rx('text', p.FOOTNOTE_START)} AND y0 < page_height * 0.2) AS footnote_at, ({rx('text', p.LIST_START)} AND x0 / page_width <= 0.15) AS potential_item, (contains(text, '=') AND (contains(text, '\') OR contains(text, '$'))) AS equation,
 len(list_filter(string_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' '), lambda w: length(w) > 1 AND w IN ({', '.join(lit(w) for w in p.ENGLISH)}))) > 0 AS english,
 (contains(lower(font_name), 'b')) AS bold_name, (contains(lower(font_name), 'i')) AS italic_name, false AS header_name FROM tk"""))
def p05_block_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List item cascade, contact, margin, footnote, equation, English and font-name predicates."""
    t, font = F.col("text"), F.col("font_name")
    y, x = F.col("y0") / F.col("page_height"), F.col("x0") / F.col("page_width")
    return load_blocks(spark, sf_dir).select(
        "doc_id", "seq", p.list_item(t).alias("list_item"), p.contact_info(t).alias("contact"), p.margin_heading(t, y).alias("margin_heading"), p.short_page_number(t).alias("short_number"),
        p.footnote_at(t, F.col("y0"), F.col("page_height")).alias("footnote_at"), p.potential_list_item(t, x, F.lit(False)).alias("potential_item"), p.equation(t).alias("equation"), p.english_word(t).alias("english"),
        p.font_is_bold(font).alias("bold_name"), p.font_is_italic(font).alias("italic_name"), p.font_is_header(font).alias("header_name"),
    )


@query(with_layout("SELECT doc_id, seq FROM blocks WHERE x1 - x0 > 10 AND y1 - y0 > 5 AND length(text) > 1"))
def p21_noise_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = g.Box.of()
    return load_blocks(spark, sf_dir).where((b.width > 10) & (b.height > 5) & (F.char_length("text") > 1)).select("doc_id", "seq")


LIST_PATTERN_SQL = r"""CASE WHEN regexp_matches(lower(trim(text)), '^[\x{2022}*\x{2023}\x{2043}\x{204C}\x{204D}\x{2219}\x{25AA}\x{25CF}\x{25E6}\x{29BE}\x{29BF}-]') THEN 'bullet'
 WHEN regexp_matches(lower(trim(text)), '^\d+[.)]') THEN 'number' WHEN regexp_matches(lower(trim(text)), '^[a-z][.)]') THEN 'letter'
 WHEN regexp_matches(lower(trim(text)), '^(?:i|ii|iii|iv|v|vi|vii|viii|ix|x)+[.)]') THEN 'roman' END"""
LIST_NUMBER_SQL = r"""CASE WHEN regexp_matches(lower(trim(text)), '^\d+[.)]') THEN TRY_CAST(regexp_extract(lower(trim(text)), '^(\d+)[.)]', 1) AS BIGINT)
 WHEN regexp_matches(lower(trim(text)), '^[a-z][.)]') THEN (ascii(lower(trim(text))) - 96)::BIGINT END"""


@query(with_layout(f"SELECT doc_id, seq, {LIST_PATTERN_SQL} AS pattern, {LIST_NUMBER_SQL} AS number FROM blocks"))
def n09_list_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = p.list_pattern(F.col("text"))
    return load_blocks(spark, sf_dir).select("doc_id", "seq", kind["type"].alias("pattern"), kind["number"].alias("number"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where("text is not null")


_WS = r"[\s\x{1C}-\x{1F}\x{85}\p{Z}]+"
_LINES = rf"list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '{_WS}', ' ', 'g'))), lambda x: x <> '')"


@query(rf"""SELECT doc_id, array_to_string({_LINES}, chr(10)) AS whitespace, regexp_replace(text, '([\p{{L}}\p{{N}}_]+)-\n([\p{{L}}\p{{N}}_]+)', '\1\2', 'g') AS dehyphenated, regexp_replace(translate(text, '-–—', '   '), '^\s+|\s+$', '', 'g') AS dashes,
 regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '[.,:;]+$', '') AS trailing, array_to_string(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S')), chr(10) || chr(10)) AS paragraphs,
 round(len(list_filter(string_split(text, chr(10))[:2000], lambda x: NOT regexp_matches(x, '\S')))::DOUBLE / len(string_split(text, chr(10))[:2000]), 6) AS blank_ratio FROM documents WHERE text IS NOT NULL""")
def t01_document_cleaners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitespace, hyphens, dashes, trailing marks, line paragraphs and blank ratio of whole texts."""
    t = F.col("text")
    return _texts(spark, sf_dir).select("doc_id", c.extra_whitespace(t).alias("whitespace"), c.dehyphenated(t).alias("dehyphenated"), c.dashes(t).alias("dashes"), c.trailing_punctuation(t).alias("trailing"), c.line_paragraphs(t).alias("paragraphs"), r6(c.blank_ratio(t)).alias("blank_ratio"))


_BUL = r"[\x{2022}\x{2023}\x{25E6}\x{2043}\x{2219}*\x{00B7}]"
_HEAD = rf"coalesce(list_filter(regexp_split_to_array(text, '{_WS}'), lambda w: w <> '')[1], '')"
_DOTTED = "(contains(head, '.') AND NOT contains(head, '..')"
_PARTS = r"string_split(regexp_replace(head, '\.$', ''), '.')"


@query(with_layout(rf""", hd AS (SELECT doc_id, seq, text, {_HEAD} AS head, list_filter(regexp_split_to_array(text, '{_WS}'), lambda w: w <> '') AS ws FROM blocks)
SELECT doc_id, seq, CASE WHEN regexp_matches(text, '^\s*{_BUL}') THEN trim(regexp_replace(text, '^\s*(?:{_BUL}\s*)+', '')) ELSE text END AS bullets,
 CASE WHEN len(ws) >= 2 AND {_DOTTED}) AND head <> '.' AND length({_PARTS}[1]) <= 2 AND len(list_filter({_PARTS}, lambda p: NOT (p = '' OR regexp_matches(p, '^[\p{{L}}\p{{N}}]+$')))) = 0 THEN array_to_string(ws[2:], ' ') ELSE text END AS ordered,
 CASE WHEN {_DOTTED}) AND length({_PARTS}[1]) <= 2 THEN {_PARTS}[1] END AS a, CASE WHEN {_DOTTED}) AND length({_PARTS}[1]) <= 2 THEN {_PARTS}[2] END AS b, CASE WHEN {_DOTTED}) AND length({_PARTS}[1]) <= 2 THEN {_PARTS}[3] END AS c,
 regexp_replace(regexp_replace(text, '^(?:Figure \d+:)', ''), '^\s+', '') AS no_prefix, regexp_replace(regexp_replace(text, '(?:[a-z]+\.)$', ''), '\s+$', '') AS no_postfix FROM hd"""))
def t07_block_cleaners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bullets, ordered bullets and their parts, prefix and postfix."""
    t = F.col("text")
    parts = c.ordered_bullet_parts(t)
    return load_blocks(spark, sf_dir).select("doc_id", "seq", c.bullets(t).alias("bullets"), c.ordered_bullets(t).alias("ordered"), *[parts[k].alias(k) for k in "abc"], c.without_prefix(t, r"Figure \d+:").alias("no_prefix"), c.without_postfix(t, r"[a-z]+\.").alias("no_postfix"))


@query()
def t06_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole cleaning chain, with ligatures, control characters and quoted-printable."""
    return load_blocks(spark, sf_dir).select("doc_id", "seq", c.clean(F.col("text")).alias("text"))


@query()
def t02_whitespace_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", c.extra_whitespace_moved(F.col("text")).alias("w")).select("doc_id", "w.text", F.array_max("w.moved").alias("dropped"))


_PARAGRAPH = rf"""CASE WHEN regexp_matches(regexp_replace(p, '^\s+|\s+$', '', 'g'), '^(?:{_BUL}|e\s)') THEN list_transform(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(p, '^e\s', '·'), '^\s+|\s+$', '', 'g'), '{_BUL}'), lambda x: x <> ''), lambda x: replace(x, chr(10), ' '))
 WHEN len(list_filter(string_split(p, chr(10)), lambda x: len(list_filter(regexp_split_to_array(x, '{_WS}'), lambda w: w <> '')) >= 5)) = 0 THEN list_filter(string_split(p, chr(10)), lambda x: regexp_matches(x, '\S')) ELSE [replace(p, chr(10), ' ')] END"""
_BROKEN = rf"array_to_string(flatten(list_transform(list_filter(regexp_split_to_array(text, '\n\s*\n'), lambda p: regexp_matches(p, '\S')), lambda p: {_PARAGRAPH})), chr(10) || chr(10))"


@query(rf"""WITH pg AS (SELECT doc_id, text, {_BROKEN} AS broken FROM documents WHERE text IS NOT NULL)
SELECT doc_id, array_to_string(list_transform(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(text, '^e\s', '·'), '^\s+|\s+$', '', 'g'), '{_BUL}'), lambda x: x <> ''), lambda x: replace(x, chr(10), ' ')), chr(10)) AS bulleted, broken,
 CASE WHEN len(list_filter(string_split(text, chr(10))[:2000], lambda x: NOT regexp_matches(x, '\S')))::DOUBLE / len(string_split(text, chr(10))[:2000]) < 0.1 THEN array_to_string(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S')), chr(10) || chr(10)) ELSE broken END AS auto FROM pg""")
def t13_paragraph_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bullet, broken and automatic paragraph grouping."""
    t = F.col("text")
    return _texts(spark, sf_dir).select("doc_id", F.array_join(c.bullet_paragraphs(t), "\n").alias("bulleted"), c.broken_paragraphs(t).alias("broken"), c.auto_paragraphs(t).alias("auto"))


def _all(pattern: str, group: int = 0) -> str:
    return f"array_to_string(regexp_extract_all(text, {lit(pattern)}, {group}), ' ')"


@query(with_layout(rf"""SELECT doc_id, seq, {_all(c.EMAIL)} AS emails, {_all(chr(92) + 'b' + c.IP + chr(92) + 'b')} AS ips, regexp_extract(text, {lit(chr(92) + 'b' + c.PHONE + chr(92) + 'b')}, 0) AS phone,
 {_all(c.MAPI_ID, 1)} AS mapi FROM blocks"""))
def t15_extractors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses, IPs, the first phone number, MAPI ids of every block."""
    t = F.col("text")
    join = lambda x: F.array_join(x, " ")
    return load_blocks(spark, sf_dir).select("doc_id", "seq", join(c.emails(t)).alias("emails"), join(c.ip_addresses(t)).alias("ips"), join(c.phone_numbers(t)).alias("phone"), join(c.mapi_ids(t)).alias("mapi"))


@query(with_layout(f"SELECT 'block' AS place, doc_id AS id, seq, array_to_string(regexp_extract_all(text, {lit(c.IMG)}, 1), ' ') AS urls FROM blocks UNION ALL SELECT 'page', page_id, 0, array_to_string(regexp_extract_all(html, {lit(c.IMG)}, 1), ' ') FROM pages"))
def t19_image_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The images of every block and of every web page."""
    urls = lambda text: F.array_join(c.image_urls(F.col(text)), " ").alias("urls")
    web = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.lit("page").alias("place"), F.col("page_id").alias("id"), F.lit(0).cast("long").alias("seq"), urls("html"))
    return load_blocks(spark, sf_dir).select(F.lit("block").alias("place"), F.col("doc_id").alias("id"), "seq", urls("text")).unionByName(web)


@query(with_layout(r"""SELECT doc_id, seq, CASE WHEN contains(text, ', ') THEN regexp_replace(string_split(text, ', ')[1], '\s+$', '') END AS before,
 CASE WHEN contains(text, ', ') THEN regexp_replace(substr(text, instr(text, ', ') + 2), '^\s+', '') END AS after,
 epoch(try_strptime(nullif(regexp_extract(text, '[A-Za-z]{3}, ([0-9]{1,2} [A-Za-z]{3} [0-9]{4} [0-9]{2}:[0-9]{2}:[0-9]{2} [+-][0-9]{4})', 1), ''), '%d %b %Y %H:%M:%S %z'))::BIGINT AS dated FROM blocks"""))
def t21_text_around(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands before and after a pattern, and the first mail date in seconds."""
    t = F.col("text")
    return load_blocks(spark, sf_dir).select("doc_id", "seq", c.text_before(t, ", ").alias("before"), c.text_after(t, ", ").alias("after"), F.unix_timestamp(c.first_date(t)).alias("dated"))


_W = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: regexp_matches(w, '\p{L}'))"
_N = rf"nullif(len(regexp_extract_all(text, '\S')), 0)"
_PW = r"list_filter(string_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' '), lambda w: w <> '')"
_VERB = f"(w IN ({', '.join(lit(v) for v in m.VERBS)}) OR {rx('w', m.VERB_ENDING)})"
CAPS_SQL = r"(regexp_matches(text, '\p{Lu}') AND NOT regexp_matches(text, '\p{Ll}'))"
STATS_SQL = rf"""coalesce(len(regexp_extract_all(text, '\p{{L}}'))::DOUBLE / {_N}, 0) AS alpha_ratio,
 coalesce(len(list_filter({_W}, lambda w: regexp_matches(w, '^\p{{Lu}}') OR NOT regexp_matches(w, '\p{{Ll}}')))::DOUBLE / nullif(len({_W}), 0), 0) AS cap_ratio, coalesce(len(regexp_extract_all(text, '[^\p{{L}}\p{{N}}\s]'))::DOUBLE / {_N}, 0) AS special_ratio,
 len({_W}) AS word_count, len(list_filter(regexp_split_to_array(text, '[.!?]+\s+'), lambda s: trim(s) <> '')) AS sentence_count, coalesce(list_sum(list_transform({_W}, lambda w: length(w)))::DOUBLE / nullif(len({_W}), 0), 0) AS avg_word_length,
 len(list_filter({_PW}, lambda w: {_VERB})) > 0 AS has_verb, (regexp_matches(text, '\p{{Lu}}') AND NOT regexp_matches(text, '(?:^|[^\p{{L}}])\p{{Ll}}') AND NOT regexp_matches(text, '\p{{L}}\p{{Lu}}')) AS is_title_case, {CAPS_SQL} AS is_all_caps,
 coalesce(len(list_filter({_PW}, lambda w: NOT ({_VERB} OR w IN ({', '.join(lit(s) for s in m.STOP_WORDS)}))))::DOUBLE / nullif(len({_PW}), 0), 0) AS noun_ratio"""


@query(with_layout(rf""", st AS (SELECT doc_id, seq, text, {STATS_SQL} FROM blocks)
SELECT doc_id, seq, round(alpha_ratio, 6) AS alpha_ratio, round(cap_ratio, 6) AS cap_ratio, round(special_ratio, 6) AS special_ratio, word_count::BIGINT AS word_count, sentence_count::BIGINT AS sentence_count, round(avg_word_length, 6) AS avg_word_length, has_verb, is_title_case, is_all_caps,
 round(noun_ratio, 6) AS noun_ratio, CASE WHEN is_all_caps THEN true WHEN sentence_count > 1 THEN false WHEN word_count = 0 THEN true ELSE cap_ratio > 0.5 END AS exceeds_caps, (regexp_matches(text, '\S') AND alpha_ratio < 0.5) AS under_alpha,
 regexp_replace(text, '[!-/:-@\[-`{{-~]', '', 'g') AS plain FROM st"""))
def n01_text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All measures of every block."""
    t = F.col("text")
    named = m.measured(t)
    at = load_blocks(spark, sf_dir).select("doc_id", "seq", "text", *[v.alias(k) for k, v in named.items()])
    known = {k: F.col(k) for k in named}
    return at.select(
        "doc_id", "seq", *[r6(known[k]).alias(k) for k in ("alpha_ratio", "cap_ratio", "special_ratio", "avg_word_length")], *[known[k].cast("long").alias(k) for k in ("word_count", "sentence_count")],
        "has_verb", "is_title_case", "is_all_caps", r6(m.noun_ratio(t)).alias("noun_ratio"), m.exceeds_cap_ratio(t, known=known).alias("exceeds_caps"), m.under_alpha_ratio(t, known=known).alias("under_alpha"), m.without_punctuation(t).alias("plain"),
    )


_TOK = "list_filter(list_distinct(regexp_split_to_array(lower(trim({0})), '\\s+')), lambda w: w NOT IN (" + ", ".join(lit(s) for s in m.STOP_WORDS) + "))"


@query(with_layout(f""", pr AS (SELECT * FROM (SELECT doc_id, seq, text AS b, lag(text) OVER (PARTITION BY doc_id, page_number ORDER BY seq) AS a FROM blocks) WHERE a IS NOT NULL)
SELECT doc_id, seq, round(CASE WHEN lower(trim(a)) = lower(trim(b)) THEN 1 WHEN least(length(a), length(b)) * 2 >= greatest(length(a), length(b)) AND len({_TOK.format('a')}) > 0 AND len({_TOK.format('b')}) > 0
 THEN len(list_intersect({_TOK.format('a')}, {_TOK.format('b')}))::DOUBLE / len(list_distinct(list_concat({_TOK.format('a')}, {_TOK.format('b')}))) ELSE 0 END, 6) AS similarity FROM pr"""))
def n06_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word similarity of consecutive blocks."""
    w = W.partitionBy("doc_id", "page_number").orderBy("seq")
    pairs = load_blocks(spark, sf_dir).withColumn("before", F.lag("text").over(w)).where("before is not null")
    return pairs.select("doc_id", "seq", r6(m.similarity(F.col("before"), F.col("text"))).alias("similarity"))


@query()
def n07_weighted_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("doc_id", "page_number").orderBy("seq")
    pairs = load_blocks(spark, sf_dir).withColumn("before", F.lag("text").over(w)).where("before is not null")
    return pairs.select("doc_id", "seq", r6(m.weighted_similarity(F.col("before"), F.col("text"))).alias("similarity"))


SCORED_CLEAN_SQL = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '^[\x{2022}\x{25CF}\x{25CB}\x{25C6}\x{25AA}-]\s*', ''), '\\n|\s*\n\s*', ' ', 'g'), '-\s+([a-z])', '\1', 'g'), '\.\s*\.\s*\.+\s*$', ''), '\[[0-9]+\]\s*', '', 'g'), '\s+', ' ', 'g'))"


@query(with_layout(rf"SELECT doc_id, seq, {SCORED_CLEAN_SQL} AS text, length(text) AS char_count, 1::BIGINT AS line_count, {CAPS_SQL} AS is_all_caps FROM blocks"))
def n08_scored_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored analyser's cleaning and the block features."""
    f = m.block_features(F.col("text"))
    return load_blocks(spark, sf_dir).select("doc_id", "seq", m.scored_clean(F.col("text")).alias("text"), f["char_count"].cast("long").alias("char_count"), f["line_count"].cast("long").alias("line_count"), f["is_all_caps"].alias("is_all_caps"))
