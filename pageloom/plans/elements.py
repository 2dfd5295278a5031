"""Queries over statistics, joins, windows, classifiers, splits, sources and sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as p
from ..operators import classify, grouping, spatial, splits, stats
from ..operators.pagewalk import Rule
from ..sources import files, tables
from ..sources import layout
from ..sources.layout import load_blocks, with_layout
from .scalars import CAPS_SQL, LIST_NUMBER_SQL, LIST_PATTERN_SQL, SCORED_CLEAN_SQL, STATS_SQL, TOKENS, list_item_sql, lit, r6, rx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
_KEY = ("doc_id", "page_number", "seq")
_BOX = ("x0", "y0", "x1", "y1")


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


_BODY = """, body AS (SELECT doc_id, page_number, arg_max(size, (chars, -seq)) AS body_font_size, min(lo) AS min_font_size, max(hi) AS max_font_size
 FROM (SELECT doc_id, page_number, round(font_size, 1) AS size, sum(length(text)) AS chars, min(seq) AS seq, min(font_size) AS lo, max(font_size) AS hi FROM blocks GROUP BY ALL) GROUP BY ALL)"""


@query(with_layout(_BODY + " SELECT * FROM body"))
def a09_body_font(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.body_font(load_blocks(spark, sf_dir))


_PAGE_STATS = r""", ps AS (SELECT doc_id, page_number, coalesce(median(CASE WHEN font_size > 0 THEN font_size END), 12) AS median_font_size, coalesce(median(CASE WHEN y1 > y0 THEN y1 - y0 END), 14) AS median_line_height,
 coalesce(median(CASE WHEN sp > 0 THEN sp END), 4) AS median_word_spacing, count(*) AS n_blocks, count(DISTINCT font_name) AS unique_fonts
 FROM (SELECT *, CASE WHEN nw > 1 THEN greatest(0, x1 - x0 - len(regexp_extract_all(text, '\S')) * font_size / 2) / (nw - 1) END AS sp FROM (SELECT *, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS nw FROM blocks)) GROUP BY ALL)"""


@query(with_layout(_PAGE_STATS + " SELECT doc_id, page_number, median_font_size, median_line_height, round(median_word_spacing, 6) AS median_word_spacing, n_blocks, unique_fonts FROM ps"))
def a01_page_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page medians with defaults, blocks and fonts."""
    return stats.page_stats(load_blocks(spark, sf_dir)).withColumn("median_word_spacing", r6(F.col("median_word_spacing")))


@query(with_layout(_PAGE_STATS + " SELECT doc_id, count(*) AS page_count, median(median_font_size) AS median_font_size, median(median_line_height) AS median_line_height, round(median(median_word_spacing), 6) AS median_word_spacing FROM ps GROUP BY ALL"))
def a02_document_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.document_stats(load_blocks(spark, sf_dir)).withColumn("median_word_spacing", r6(F.col("median_word_spacing")))


@query(with_layout(" SELECT * FROM (SELECT doc_id, value, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, s) AS rank FROM (SELECT doc_id, round(font_size, 1) AS value, count(*) AS n, min(seq) AS s FROM blocks GROUP BY ALL)) WHERE rank <= 5"))
def o06_top_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.top_values(load_blocks(spark, sf_dir), F.round("font_size", 1))


@query(with_layout(" SELECT doc_id, page_number, font_name, is_bold, is_italic, count(*) AS n FROM blocks GROUP BY ALL"))
def a03_font_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.font_counts(load_blocks(spark, sf_dir))


@query(with_layout(""", dom AS (SELECT doc_id, page_number, arg_max(font_name, (w, -s)) AS dominant_font FROM (SELECT doc_id, page_number, font_name, sum(length(text)) AS w, min(seq) AS s FROM blocks GROUP BY ALL) GROUP BY ALL)
 SELECT b.doc_id, b.page_number, round(sum(font_size * length(text)) / sum(length(text)), 6) AS avg_font_size, median(font_size) AS median_font_size, round(stddev_pop(font_size), 6) AS std_font_size, round(coalesce(stddev_samp(font_size), 0), 6) AS sample_std,
 round(sum(CASE WHEN is_bold THEN length(text) ELSE 0 END)::DOUBLE / sum(length(text)), 6) AS bold_ratio, round(sum(CASE WHEN is_italic THEN length(text) ELSE 0 END)::DOUBLE / sum(length(text)), 6) AS italic_ratio, bool_or(is_bold) AS any_bold, sum(length(text))::BIGINT AS char_count, dominant_font
 FROM blocks b JOIN dom d ON b.doc_id = d.doc_id AND b.page_number = d.page_number GROUP BY ALL"""))
def a08_font_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Font means, deviations, shares and modes."""
    out = stats.font_summary(load_blocks(spark, sf_dir)).drop("is_bold", "is_italic")
    return out.withColumns({k: r6(F.col(k)) for k in ("avg_font_size", "std_font_size", "sample_std", "bold_ratio", "italic_ratio")})


@query(with_layout(r""", dom AS (SELECT doc_id, arg_max(font_name, (w, -s)) AS body_font FROM (SELECT doc_id, font_name, sum(len(regexp_split_to_array(trim(text), '\s+'))) AS w, min(seq) AS s FROM blocks GROUP BY ALL) GROUP BY ALL)
 SELECT b.doc_id, list_sort(list(font_size))[count(*) // 2 + 1] AS median_font_size, list_sort(list(y1 - y0))[count(*) // 2 + 1] AS median_line_height, body_font FROM blocks b JOIN dom d ON b.doc_id = d.doc_id GROUP BY ALL"""))
def a12_scored_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper medians and the font of most words."""
    return stats.scored_document_stats(load_blocks(spark, sf_dir))


@query(with_layout(" SELECT doc_id, page_number, round(avg(gap), 6) AS mean_gap, round(coalesce(stddev_samp(gap), 0), 6) AS std_gap, count(*) AS n FROM (SELECT *, abs(y0 - lag(y0) OVER (PARTITION BY doc_id, page_number ORDER BY y0, x0, seq)) AS gap FROM blocks) WHERE gap IS NOT NULL GROUP BY ALL"))
def w19_line_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.line_gaps(load_blocks(spark, sf_dir)).withColumns({k: r6(F.col(k)) for k in ("mean_gap", "std_gap")})


FAST_SQL = _BODY + rf""", f0 AS (SELECT b.*, body_font_size AS body, trim(text) AS t, font_size / body_font_size AS ratio, abs((x0 + x1) / 2 - page_width / 2) < page_width * 0.2 AS centred, len(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda w: w <> '')) AS nw,
 (y0 < page_height * 0.15 OR y1 > page_height - page_height * 0.15) AS margin, {LIST_PATTERN_SQL} AS pattern, {LIST_NUMBER_SQL} AS number FROM blocks b JOIN body USING (doc_id, page_number)
), f1 AS (SELECT *, (regexp_matches(t, '^(?:\d+|Page\s+\d+(?:\s+of\s+\d+)?|\d+\s*/\s*\d+|-\s*\d+\s*-)$') AND (y0 < 61.2 OR y0 > page_height - 61.2) AND length(t) < 20 AND font_size <= body) AS pageno,
 (ratio > 1.2 AND nw <= 20 AND (centred OR (t <> '' AND NOT regexp_matches(t, '[.!?:]$')))) AS title FROM f0
), fast AS (SELECT *, CASE WHEN pageno THEN 'PageNumber' WHEN pattern IS NOT NULL THEN 'ListItem' WHEN title THEN 'Title' WHEN margin AND y0 < page_height / 2 THEN 'Header' WHEN margin THEN 'Footer' WHEN t <> '' THEN 'NarrativeText' ELSE 'UncategorizedText' END AS element_type,
 (CASE WHEN pageno THEN 100 WHEN pattern IS NOT NULL THEN 90 WHEN title THEN 70 + 10 * is_bold::INT + 10 * centred::INT + 10 * (ratio > 1.5)::INT WHEN margin THEN 80 + 10 * (abs(font_size - body) > 1)::INT + 10 * is_bold::INT WHEN t <> '' THEN 70 ELSE 50 END) / 100.0::DOUBLE AS confidence FROM f1)"""


@query(with_layout(FAST_SQL + " SELECT doc_id, page_number, element_type, count(*) AS n FROM fast GROUP BY ALL"))
def c07_fast_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fast cascade counted by page and type."""
    return classify.fast_counts(load_blocks(spark, sf_dir))


@query(with_layout(FAST_SQL + " SELECT doc_id, page_number, seq, element_type, confidence FROM fast"))
def c08_fast_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.fast_elements(load_blocks(spark, sf_dir)).select(*_KEY, "element_type", "confidence")


@query(with_layout(FAST_SQL + " SELECT element_type, count(*) AS n, arg_min(text, (doc_id, seq)) AS sample FROM fast GROUP BY ROLLUP (element_type)"))
def a14_type_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and a first sample by type, and their total."""
    return stats.type_summary(classify.fast_elements(load_blocks(spark, sf_dir)))


_INTER = "(greatest(0, least({0}x1, {1}x1) - greatest({0}x0, {1}x0)) * greatest(0, least({0}y1, {1}y1) - greatest({0}y0, {1}y0)))"


@query(with_layout(f" SELECT doc_id, page_number, seq FROM blocks b WHERE y1 - y0 >= 5 AND x1 - x0 >= 5 AND (x1 - x0) * (y1 - y0) >= 50 AND NOT EXISTS (SELECT 1 FROM (SELECT doc_id, page_number, greatest(0, x0 - 8) AS x0, greatest(0, y0 - 8) AS y0, least(612, x1 + 8) AS x1, least(792, y1 + 8) AS y1 FROM table_areas) t WHERE t.doc_id = b.doc_id AND t.page_number = b.page_number AND {_INTER.format('b.', 't.')} / ((b.x1 - b.x0) * (b.y1 - b.y0)) > 0.1)"))
def j01_outside_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks clear of the expanded table areas (J1, J2, G17, SRC5)."""
    blocks = load_blocks(spark, sf_dir)
    return spatial.outside_tables(blocks, layout.table_areas(blocks)).select(*_KEY)


@query(with_layout(f" SELECT doc_id, page_number, seq FROM blocks b WHERE EXISTS (SELECT 1 FROM table_areas t WHERE t.doc_id = b.doc_id AND t.page_number = b.page_number AND ((b.x1 - b.x0) * (b.y1 - b.y0) < 50 OR {_INTER.format('b.', 't.')} / ((b.x1 - b.x0) * (b.y1 - b.y0)) > 0.1 OR (b.x0 >= t.x0 AND b.y0 >= t.y0 AND b.x1 <= t.x1 AND b.y1 <= t.y1)))"))
def p24_inside_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = load_blocks(spark, sf_dir)
    return spatial.inside_tables(blocks, layout.table_areas(blocks)).select(*_KEY)


@query(with_layout(f" SELECT doc_id, page_number, seq FROM blocks a WHERE NOT EXISTS (SELECT 1 FROM blocks b WHERE a.doc_id = b.doc_id AND a.page_number = b.page_number AND a.seq <> b.seq AND {_INTER.format('a.', 'b.')} / ((a.x1 - a.x0) * (a.y1 - a.y0)) > 0.92 AND (a.x1 - a.x0) * (a.y1 - a.y0) < 0.9 * (b.x1 - b.x0) * (b.y1 - b.y0))"))
def j04_without_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.without_nested(load_blocks(spark, sf_dir), 0.92).select(*_KEY)


@query(with_layout(f" SELECT doc_id, page_number, seq FROM blocks a WHERE NOT EXISTS (SELECT 1 FROM blocks b WHERE a.doc_id = b.doc_id AND a.page_number = b.page_number AND b.seq > a.seq AND {_INTER.format('a.', 'b.')} / ((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - {_INTER.format('a.', 'b.')}) > 0.9)"))
def j06_last_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.last_of_duplicates(load_blocks(spark, sf_dir), 0.9).select(*_KEY)


def _first_sql(covers: str, own: bool) -> str:
    """Rows of a page in order, each joining the first group that covers it; g holds a page's groups."""
    box = "struct_pack(seq := r.seq, text := r.text, x0 := r.x0, y0 := r.y0, x1 := r.x1, y1 := r.y1, ox0 := r.x0, oy0 := r.y0, ox1 := r.x1, oy1 := r.y1)"
    side = "o" if own else ""
    test = covers.replace("a.", f"a.{side}")
    grown = "struct_pack(seq := a.seq, text := a.text || ' ' || r.text, x0 := least(a.x0, r.x0), y0 := least(a.y0, r.y0), x1 := greatest(a.x1, r.x1), y1 := greatest(a.y1, r.y1), ox0 := a.ox0, oy0 := a.oy0, ox1 := a.ox1, oy1 := a.oy1)"
    return rf""", nr AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY seq) AS k FROM blocks
), fold AS (SELECT doc_id, page_number, k, [{box}] AS g FROM nr r WHERE k = 1
 UNION ALL SELECT doc_id, page_number, k, CASE WHEN pos IS NULL OR pos = 0 THEN list_append(g, one) ELSE list_transform(g, lambda a, i: CASE WHEN i = pos THEN {grown.replace('r.', 'one.')} ELSE a END) END FROM (
 SELECT r.doc_id, r.page_number, r.k, s.g, {box} AS one, list_position(list_transform(s.g, lambda a: {test}), true) AS pos FROM fold s JOIN nr r ON r.doc_id = s.doc_id AND r.page_number = s.page_number AND r.k = s.k + 1)
), last AS (SELECT doc_id, page_number, unnest(arg_max(g, k)) AS e FROM fold GROUP BY doc_id, page_number)
SELECT doc_id, page_number, e.seq AS seq, e.text AS text, e.x0 AS x0, e.y0 AS y0, e.x1 AS x1, e.y1 AS y1 FROM last"""


_SHARED = "(greatest(0, least(a.x1, r.x1) - greatest(a.x0, r.x0)) * greatest(0, least(a.y1, r.y1) - greatest(a.y0, r.y0)))"
_RECURSIVE = lambda body: with_layout(body).replace("WITH ", "WITH RECURSIVE ", 1)


@query(_RECURSIVE(_first_sql(f"({_SHARED} / greatest((a.x1 - a.x0) * (a.y1 - a.y0), 1e-8) > 0.8 OR {_SHARED} / greatest((r.x1 - r.x0) * (r.y1 - r.y0), 1e-8) > 0.8)", True)))
def j05_absorb_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.absorb_overlaps(load_blocks(spark, sf_dir)).select(*_KEY, "text", *_BOX)


@query(_RECURSIVE(_first_sql(f"({_SHARED} > 0 AND {_SHARED} / ((a.x1 - a.x0) * (a.y1 - a.y0) + (r.x1 - r.x0) * (r.y1 - r.y0) - {_SHARED}) > 0.7)", False).replace("e.text AS text, ", "")))
def j07_merge_growing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.merge_growing(load_blocks(spark, sf_dir)).select(*_KEY, *_BOX)


_TOUCH = """CASE WHEN greatest(r.x0 - o.x1, o.x0 - r.x1, 0) = 0 AND greatest(r.y0 - o.y1, o.y0 - r.y1, 0) = 0 THEN true ELSE greatest(r.x0 - o.x1, o.x0 - r.x1, 0) <= 5 AND greatest(r.y0 - o.y1, o.y0 - r.y1, 0) <= 5 END"""


@query(_RECURSIVE(FAST_SQL + rf""", nr AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY y0, x0, seq) AS k FROM fast
), fold AS (SELECT doc_id, page_number, k, k AS g, seq, element_type, text, [struct_pack(x0, y0, x1, y1)] AS boxes FROM nr WHERE k = 1
 UNION ALL SELECT doc_id, page_number, k, CASE WHEN tied THEN g ELSE k END, CASE WHEN tied THEN least(gs, rs) ELSE rs END, element_type, CASE WHEN tied THEN gt || ' ' || rt ELSE rt END, CASE WHEN tied THEN list_append(boxes, box) ELSE [box] END FROM (
 SELECT r.doc_id, r.page_number, r.k, s.g, s.seq AS gs, r.seq AS rs, s.text AS gt, r.text AS rt, s.boxes, r.element_type, struct_pack(x0 := r.x0, y0 := r.y0, x1 := r.x1, y1 := r.y1) AS box,
 s.element_type = r.element_type AND len(list_filter(s.boxes, lambda o: {_TOUCH})) > 0 AS tied FROM fold s JOIN nr r ON r.doc_id = s.doc_id AND r.page_number = s.page_number AND r.k = s.k + 1))
SELECT doc_id, page_number, arg_max(seq, k) AS seq, element_type, arg_max(text, k) AS text, list_min(list_transform(arg_max(boxes, k), lambda b: b.x0)) AS x0, list_min(list_transform(arg_max(boxes, k), lambda b: b.y0)) AS y0, list_max(list_transform(arg_max(boxes, k), lambda b: b.x1)) AS x1, list_max(list_transform(arg_max(boxes, k), lambda b: b.y1)) AS y1 FROM fold GROUP BY doc_id, page_number, g, element_type"""))
def j13_merge_touching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.merge_touching(classify.fast_elements(load_blocks(spark, sf_dir))).select(*_KEY, "element_type", "text", *_BOX)


_CAP_SOFT = rf"""(15 * (nw BETWEEN 3 AND 30)::INT + 5 * ((x0 + x1) / 2 / {{w}} BETWEEN 0.4 AND 0.6)::INT + 40 * ({{near}})::INT + 5 * (font_size / {{mid}} < 0.92)::INT + 5 * is_italic::INT + 5 * {rx('lower(t)', p.CAPTION_WORDS)}::INT + 5 * (NOT contains(t, chr(10)))::INT)"""
CAPTION_SQL = f"CASE WHEN NOT (nw <= 40 AND length(t) <= 300 AND t <> '') THEN 0 WHEN {rx('t', p.CAPTION)} THEN 95 ELSE {_CAP_SOFT} END"


@query(with_layout(rf""", c AS (SELECT f.image_no, b.*, trim(text) AS t, len(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda w: w <> '')) AS nw, CASE WHEN b.y0 - f.y1 >= 0 THEN 1 WHEN f.y0 - b.y1 >= 0 THEN 2 END AS phase,
 CASE WHEN b.y0 - f.y1 >= 0 THEN b.y0 - f.y1 ELSE f.y0 - b.y1 END AS distance FROM figures f JOIN blocks b ON f.doc_id = b.doc_id AND f.page_number = b.page_number
), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number, image_no, phase ORDER BY distance, seq) AS k FROM c WHERE phase IS NOT NULL)
SELECT doc_id, page_number, image_no, seq AS caption_seq, phase::BIGINT AS phase, distance FROM k WHERE k <= 10 AND {CAPTION_SQL.format(w='(x1 * 2)', near='false', mid='12')} >= 70
QUALIFY row_number() OVER (PARTITION BY doc_id, page_number, image_no ORDER BY phase, k) = 1"""))
def j03_figure_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The caption of each figure."""
    blocks = load_blocks(spark, sf_dir)
    return spatial.figure_captions(layout.figures(blocks), blocks)


@query(with_layout(""", tx AS (SELECT * FROM blocks WHERE length(trim(text)) > 1 AND x1 - x0 > 10 AND y1 - y0 > 5), pv AS (SELECT *, lag(x1) OVER w AS px1, lag(y0) OVER w AS py0, lag(y1) OVER w AS py1 FROM tx WINDOW w AS (PARTITION BY doc_id, page_number ORDER BY x0, seq)
), wd AS (SELECT * FROM pv WHERE y1 > py0 AND y0 < py1 AND x0 - px1 > page_width * 0.15 AND (least(y1, py1) - greatest(y0, py0)) / greatest(y1 - y0, py1 - py0) > 0.3), tp AS (SELECT * FROM wd QUALIFY row_number() OVER (PARTITION BY doc_id, page_number ORDER BY x0 - px1 DESC, seq) <= 2
), ct AS (SELECT doc_id, page_number, list_sort(list(x0)) AS cuts FROM tp GROUP BY ALL), eg AS (SELECT p.doc_id, p.page_number, list_concat(list_concat([0.0::DOUBLE], coalesce(cuts, []::DOUBLE[])), [width]) AS e, width * 0.15 AS least_wide FROM pages_ p LEFT JOIN ct ON p.doc_id = ct.doc_id AND p.page_number = ct.page_number
), fo AS (SELECT doc_id, page_number, CASE WHEN len(e) = 2 THEN e WHEN len(e) = 3 AND e[3] - e[2] <= least_wide THEN [e[1], e[3]] WHEN len(e) = 3 THEN e WHEN e[3] - e[2] <= least_wide THEN [e[1], e[3], e[4]] WHEN e[4] - e[3] <= least_wide THEN [e[1], e[2], e[4]] ELSE e END AS e FROM eg
), pl AS (SELECT b.*, e, CASE WHEN e[1] <= c AND c <= e[2] THEN 0 WHEN len(e) > 2 AND e[2] <= c AND c <= e[3] THEN 1 WHEN len(e) > 3 AND e[3] <= c AND c <= e[4] THEN 2 ELSE -1 END AS column_no FROM (SELECT *, (x0 + x1) / 2 AS c FROM blocks WHERE length(trim(text)) > 0 AND x1 - x0 > 5 AND y1 - y0 > 2) b JOIN fo USING (doc_id, page_number))
SELECT doc_id, page_number, seq, column_no::BIGINT AS column_no, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY column_no, y0, CASE WHEN len(e) <= 2 THEN x0 END, seq) AS position FROM pl WHERE column_no >= 0"""))
def o04_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns and column-major order."""
    return spatial.reading_order(load_blocks(spark, sf_dir)).select(*_KEY, F.col("column_no").cast("long").alias("column_no"), F.col("position").cast("long").alias("position"))


@query(with_layout(rf""", mg AS (SELECT * FROM blocks WHERE y0 < page_height * 0.1 OR y1 > page_height * 0.9), tk AS (SELECT *, list_filter(list_distinct(regexp_split_to_array(lower(trim(text)), '\s+')), lambda w: w NOT IN ('a', 'an', 'the', 'in', 'on', 'at', 'of', 'to', 'for', 'by')) AS ws FROM mg)
SELECT a.doc_id, a.page_number, a.seq, count(DISTINCT b.page_number) AS n_pages FROM tk a JOIN tk b ON a.doc_id = b.doc_id AND a.page_number <> b.page_number AND (lower(trim(a.text)) = lower(trim(b.text)) OR (least(length(a.text), length(b.text)) * 2 >= greatest(length(a.text), length(b.text))
 AND len(a.ws) > 0 AND len(b.ws) > 0 AND len(list_intersect(a.ws, b.ws))::DOUBLE / len(list_distinct(list_concat(a.ws, b.ws))) > 0.85)) GROUP BY ALL"""))
def j12_repeated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.repeated_texts(load_blocks(spark, sf_dir)).select(*_KEY, F.size("cross_page_refs").cast("long").alias("n_pages"))


@query(with_layout(FAST_SQL + " SELECT doc_id, page_number, seq, CASE element_type WHEN 'Title' THEN 'red' WHEN 'NarrativeText' THEN 'blue' WHEN 'ListItem' THEN 'green' ELSE 'grey' END AS colour FROM fast WHERE element_type = 'PageNumber' OR confidence >= 0.8 OR element_type = 'NarrativeText'"))
def j14_coloured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type colours with a default, and the confidence filter where nothing given counts as 1 (J14, P23, SRC24)."""
    kind, names = F.col("element_type"), {"Title": "TITLE", "NarrativeText": "TEXT", "ListItem": "LIST_ITEM"}
    named = F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[kind], kind)
    elements = classify.fast_elements(load_blocks(spark, sf_dir)).withColumn("confidence", F.when(~kind.isin("NarrativeText", "PageNumber"), F.col("confidence")))
    return files.coloured(elements.withColumn("element_type", named), least=0.8).select(*_KEY, "colour")


@query(with_layout(FAST_SQL + " SELECT doc_id, page_number, seq FROM fast QUALIFY row_number() OVER (PARTITION BY doc_id, page_number, element_type, text, x0, y0, x1, y1 ORDER BY seq) = 1"))
def u02_exact_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.exact_duplicates_dropped(classify.fast_elements(load_blocks(spark, sf_dir))).select(*_KEY)


_LINE_GROUPS = r""", lg AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page_number ORDER BY y0, x0, seq ROWS UNBOUNDED PRECEDING) AS grp FROM (
 SELECT *, coalesce(abs(lag(y0) OVER w - y0) <= 3 AND x0 - lag(x1) OVER w <= 60 AND abs(lag(font_size) OVER w - font_size) / greatest(lag(font_size) OVER w, font_size) <= 0.2 AND lag(is_bold) OVER w = is_bold AND lag(is_italic) OVER w = is_italic
 AND NOT (centred AND y0 > page_height * 0.85 AND regexp_matches(trim(text), '^\d{1,5}$')) AND NOT (centred AND abs(lag(y0) OVER w - y0) > 30 AND y0 > lag(y1) OVER w), false) AS joins
 FROM (SELECT *, abs((x0 + x1) / 2 - page_width / 2) < page_width * 0.15 AS centred FROM blocks) WINDOW w AS (PARTITION BY doc_id, page_number ORDER BY y0, x0, seq)))"""


@query(with_layout(_LINE_GROUPS + " SELECT doc_id, page_number, min(seq) AS seq, string_agg(text, ' ' ORDER BY y0, x0, seq) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, arg_max(font_name, ((x1 - x0) * (y1 - y0), -seq)) AS font_name, count(*) AS item_count FROM lg GROUP BY doc_id, page_number, grp"))
def w03_merged_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of one line merged."""
    return grouping.merged_blocks(load_blocks(spark, sf_dir)).select(*_KEY, "text", *_BOX, "font_name", "item_count")


def _listed(spark: SparkSession, sf_dir: str, name: str = "LIST_ITEM") -> DataFrame:
    return load_blocks(spark, sf_dir).withColumn("element_type", F.when(p.list_item(F.col("text")), name).otherwise("TEXT"))


def running_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the page numbers, which would always be a page's last block."""
    return _without_folios(_listed(spark, sf_dir))


def _without_folios(blocks: DataFrame) -> DataFrame:
    """By text and place, since ``seq`` is only an order."""
    centred = F.abs((F.col("x0") + F.col("x1")) / 2 - F.col("page_width") / 2) < F.col("page_width") * 0.15
    folio = centred & (F.col("y0") > F.col("page_height") * 0.85) & F.trim("text").rlike(r"^\d{1,5}$")
    return blocks.where(~F.coalesce(folio, F.lit(False)))


_LISTED = TOKENS + f", li AS (SELECT *, CASE WHEN {list_item_sql()} THEN 'LIST_ITEM' ELSE 'TEXT' END AS element_type FROM tk)"


@query(with_layout(_LISTED + """, g AS (SELECT *, sum(CASE WHEN go THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page_number ORDER BY y0, x0, seq ROWS UNBOUNDED PRECEDING) AS grp FROM (SELECT *, coalesce(element_type = 'LIST_ITEM' AND lag(element_type) OVER w = 'LIST_ITEM' AND abs(lag(y1) OVER w - y0) <= 20 AND abs(lag(x0) OVER w - x0) <= 10
 AND lag(font_name) OVER w = font_name AND abs(lag(font_size) OVER w - font_size) <= 0.1, false) AS go FROM li WINDOW w AS (PARTITION BY doc_id, page_number ORDER BY y0, x0, seq)))
SELECT doc_id, page_number, seq, CASE WHEN element_type = 'LIST_ITEM' THEN sha256('list:' || doc_id || ':' || page_number || ':' || grp) END AS list_group_id FROM g"""))
def w06_list_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.list_groups(_listed(spark, sf_dir)).select(*_KEY, "list_group_id")


@query(with_layout(_LISTED + """, g AS (SELECT *, sum(CASE WHEN go THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page_number ORDER BY y0, x0, seq ROWS UNBOUNDED PRECEDING) AS grp FROM (SELECT *, coalesce(element_type = 'LIST_ITEM' AND lag(element_type) OVER w = 'LIST_ITEM' AND y0 - lag(y1) OVER w > 0 AND y0 - lag(y1) OVER w <= 20, false) AS go FROM li WINDOW w AS (PARTITION BY doc_id, page_number ORDER BY y0, x0, seq)))
SELECT doc_id, page_number, min(seq) AS seq, string_agg(text, chr(10) ORDER BY y0, x0, seq) AS text, count(*) AS item_count FROM g WHERE element_type = 'LIST_ITEM' GROUP BY doc_id, page_number, grp"""))
def w07_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LIST rows of consecutive items."""
    return grouping.lists(_listed(spark, sf_dir)).select(*_KEY, "text", "item_count")


@query(with_layout(FAST_SQL + """, g AS (SELECT *, sum(CASE WHEN go THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page_number ORDER BY y0, x0, seq ROWS UNBOUNDED PRECEDING) AS grp FROM (SELECT *, coalesce(element_type = 'ListItem' AND lag(element_type) OVER w = 'ListItem' AND lag(pattern) OVER w = pattern AND abs(y0 - lag(y1) OVER w) <= 20 AND abs(x0 - lag(x0) OVER w) <= 5
 AND (pattern <> 'number' OR number = lag(number) OVER w + 1), false) AS go FROM fast WINDOW w AS (PARTITION BY doc_id, page_number ORDER BY y0, x0, seq)))
SELECT doc_id, page_number, seq, CASE WHEN element_type = 'ListItem' THEN sha256('context:' || doc_id || ':' || page_number || ':' || grp) END AS list_id, CASE WHEN element_type = 'ListItem' THEN coalesce(number, 0) END AS list_index FROM g"""))
def w08_list_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.list_contexts(classify.fast_elements(load_blocks(spark, sf_dir))).select(*_KEY, "list_id", "list_index")


@query(_RECURSIVE(FAST_SQL + """, nr AS (SELECT *, row_number() OVER w AS k, element_type = 'ListItem' AND pattern IS NOT NULL AS listed, coalesce(element_type = 'ListItem' AND lag(element_type) OVER w = 'ListItem' AND x0 - lag(x0) OVER w BETWEEN 10 AND 50, false) AS nested FROM fast WINDOW w AS (PARTITION BY doc_id, page_number ORDER BY y0, x0, seq)
), fold AS (SELECT doc_id, page_number, k, seq, listed, nested, number, CASE WHEN listed THEN seq END AS head_seq, CASE WHEN listed THEN pattern END AS head_pattern, CASE WHEN listed THEN x0 END AS head_x, CASE WHEN listed THEN number END AS last_number, CASE WHEN listed THEN y1 END AS bottom FROM nr WHERE k = 1
 UNION ALL SELECT doc_id, page_number, k, seq, listed, nested, number, CASE WHEN NOT listed THEN NULL WHEN go THEN hs ELSE seq END, CASE WHEN NOT listed THEN NULL WHEN go THEN hp ELSE pattern END, CASE WHEN NOT listed THEN NULL WHEN go THEN hx ELSE x0 END, CASE WHEN listed THEN number ELSE was END, CASE WHEN listed THEN y1 ELSE low END FROM (
 SELECT r.*, s.head_seq AS hs, s.head_pattern AS hp, s.head_x AS hx, s.last_number AS was, s.bottom AS low, coalesce(s.head_seq IS NOT NULL AND (s.bottom IS NULL OR abs(r.y0 - s.bottom) <= 20) AND r.pattern = s.head_pattern AND abs(r.x0 - s.head_x) <= 5 AND (r.pattern <> 'number' OR r.number = s.last_number + 1), false) AS go
 FROM fold s JOIN nr r ON r.doc_id = s.doc_id AND r.page_number = s.page_number AND r.k = s.k + 1))
SELECT doc_id, page_number, seq, head_seq, coalesce(number, 0) AS list_index, nested::BIGINT AS list_level FROM fold WHERE listed"""))
def w09_context_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact list contexts, continuation merging and levels."""
    elements = classify.fast_elements(load_blocks(spark, sf_dir))
    heads = grouping.list_contexts_exact(elements)
    levels = grouping.list_levels(elements).select(*_KEY, F.col("list_level").cast("long").alias("list_level"))
    return heads.join(levels, list(_KEY))


def _fold_sql(rows: str, rule: str, joint: str = "s.text || ' ' || r.text") -> str:
    """Rows of a page in order, each joining the group before it (s, as grown) where the rule says so."""
    return rf""", nr AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY y0, x0, seq) AS k FROM {rows}
), fold AS (SELECT doc_id, page_number, k, seq, text, x0, y0, x1, y1, font_name, font_size, element_type FROM nr WHERE k = 1
 UNION ALL SELECT doc_id, page_number, k, unnest.seq, unnest.text, unnest.x0, unnest.y0, unnest.x1, unnest.y1, unnest.font_name, unnest.font_size, unnest.element_type FROM (
 SELECT r.doc_id, r.page_number, r.k, CASE WHEN coalesce({rule}, false) THEN struct_pack(seq := s.seq, text := {joint}, x0 := least(s.x0, r.x0), y0 := least(s.y0, r.y0), x1 := greatest(s.x1, r.x1), y1 := greatest(s.y1, r.y1), font_name := s.font_name, font_size := s.font_size, element_type := s.element_type)
 ELSE struct_pack(seq := r.seq, text := r.text, x0 := r.x0, y0 := r.y0, x1 := r.x1, y1 := r.y1, font_name := r.font_name, font_size := r.font_size, element_type := r.element_type) END AS unnest FROM fold s JOIN nr r ON r.doc_id = s.doc_id AND r.page_number = s.page_number AND r.k = s.k + 1))
SELECT doc_id, page_number, seq, arg_max(text, k) AS text, arg_max(x0, k) AS x0, arg_max(y0, k) AS y0, arg_max(x1, k) AS x1, arg_max(y1, k) AS y1 FROM fold GROUP BY doc_id, page_number, seq"""


def _walk(name: str, rule: Rule, sql: str, type_name: str = "LIST_ITEM", **joint: str | Rule) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        more = {"joint": joint["joint"]} if joint else {}
        return grouping.merge_runs(_listed(spark, sf_dir, type_name), rule, **more).select(*_KEY, "text", *_BOX)

    QUERIES[name] = run
    typed = _LISTED.replace("'LIST_ITEM'", f"'{type_name}'")
    ORACLE[name] = with_layout(typed + _fold_sql("li", sql, *[joint["text"]] if joint else [])).replace("WITH ", "WITH RECURSIVE ", 1)


_SAME = "s.font_name = r.font_name AND abs(s.font_size - r.font_size)"
_LOW = r"regexp_matches(r.text, '^\p{Ll}')"
_walk("w04_wrapped_lines", grouping.wrapped_list_rule, f"{rx('s.text', grouping.WRAP_START)} AND NOT {rx('r.text', grouping.WRAP_START)} AND abs(s.y1 - r.y0) <= 5 AND abs(r.x0 - (s.x0 + 20)) <= 5 AND s.font_name = r.font_name", joint=lambda a, b: F.concat(a, F.lit("\n"), b), text="s.text || chr(10) || r.text")
_walk("w05_list_absorb", grouping.list_absorb_rule, "s.element_type = 'LIST_ITEM' AND r.element_type = 'LIST_ITEM' AND r.x0 > s.x0 - (s.x1 - s.x0) * 0.08 AND r.x1 < s.x1 + (s.x1 - s.x0) * 0.08 AND r.y0 > s.y0 - (s.y1 - s.y0) * 0.12 AND r.y1 < s.y1 + (s.y1 - s.y0) * 0.12")
_walk("w10_region_merge", grouping.region_rule, f"r.y0 - s.y1 <= 18 AND abs(s.x0 - r.x0) <= 12 AND {_SAME} <= 0.5")
_walk("w11_element_merge", grouping.element_rule, f"r.y0 - s.y1 <= 1.5 * s.font_size AND abs(s.x0 - r.x0) < s.font_size AND {_SAME} < 0.5")
_walk("w12_text_block_merge", grouping.text_block_rule, rf"r.y0 - s.y1 BETWEEN 0 AND 15 AND least(s.x1, r.x1) > greatest(s.x0, r.x0) AND {_SAME} < 0.5 AND (ends_with(s.text, '-') OR {_LOW} OR NOT regexp_matches(s.text, '[.!?:]\s*$'))", joint=grouping.dehyphenating, text=f"CASE WHEN ends_with(s.text, '-') AND {_LOW} THEN left(s.text, length(s.text) - 1) || r.text ELSE s.text || ' ' || r.text END")
_walk("w09_item_merge", grouping.context_list_rule, f"r.y0 - s.y1 BETWEEN 0 AND 20 AND s.element_type = 'ListItem' AND ((r.element_type = 'ListItem' AND abs(r.x0 - s.x0) <= 50) OR (r.element_type <> 'ListItem' AND r.x0 - s.x0 BETWEEN 0 AND 50 AND {_LOW}))", "ListItem")


@query(with_layout(rf""", q AS (SELECT *, lag(text) OVER w AS pt, lag(x0) OVER w AS px0, lag(x1) OVER w AS px1, lag(y1) OVER w AS py1, lag(font_name) OVER w AS pf, lag(font_size) OVER w AS ps FROM blocks WINDOW w AS (PARTITION BY doc_id, page_number ORDER BY y0, x0, seq)
), r AS (SELECT *, pf = font_name AND abs(ps - font_size) < 0.1 AS same, regexp_matches(pt, '[.!?]\s*$') AS ends, regexp_matches(text, '^\p{{Ll}}') AS low, y0 - py1 AS gap FROM q)
SELECT doc_id, page_number, seq, coalesce(same AND abs(x0 - px0) < 5 AND NOT ends, false) AS flows_on, coalesce(same AND abs(gap) <= font_size * 0.3 AND abs(x0 - px0) <= font_size * 0.6, false) AS near_font,
 coalesce(pf = font_name AND gap < font_size * 1.5 AND (ends_with(pt, '-') OR low OR (NOT ends AND px1 > page_width * 0.8)), false) AS can_merge,
 coalesce({rx('pt', p.LIST_START)} AND abs(x0 - px0) < 5 AND gap < 20 AND (low OR regexp_matches(text, '(?i)^(?:and|or|but|nor|yet|so)\s')), false) AS continues_item FROM r"""))
def w13_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair predicates with the block before."""
    return grouping.continuity(load_blocks(spark, sf_dir)).select(*_KEY, "flows_on", "near_font", "can_merge", "continues_item")


@query(with_layout(" SELECT doc_id, page_number, arg_min(seq, (y0, x0, seq)) AS first_seq, arg_max(seq, (y0, x0, seq)) AS last_seq FROM blocks GROUP BY ALL"))
def w16_page_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = splits.page_ends(load_blocks(spark, sf_dir).withColumn("element_type", F.lit("TEXT")))
    return ends.select("doc_id", "page_number", F.col("first.seq").alias("first_seq"), F.col("last.seq").alias("last_seq"))


def _main(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = load_blocks(spark, sf_dir)
    bodies = layout.table_areas(blocks).withColumnRenamed("table_no", "seq").withColumn("element_type", F.lit("TABLE_BODY"))
    shown = layout.figures(blocks).withColumnRenamed("image_no", "seq").withColumn("element_type", F.lit("FIGURE"))
    return classify.main_elements(blocks, bodies.unionByName(shown))


_TITLE_POINTS = rf"""(10 * (word_count <= 8)::INT - 10 * regexp_matches(text, '[.:;!?]$')::INT + 10 * (word_count > 0 AND noun_ratio > 0.5)::INT + 15 * is_bold::INT + 10 * (font_size > 12)::INT + 10 * is_all_caps::INT + 5 * (abs(x0 / page_width - 0.5) < 0.2)::INT + 40 * (sec <> '')::INT
 + 30 * {rx('lower(text)', p.TITLE_LOWER)}::INT - 20 * (word_count > 15)::INT - 10 * has_verb::INT + 10 * (cap_ratio > 0.7)::INT - 20 * (sentence_count > 2)::INT + 5 * (is_bold AND font_size >= avg_word_length * 1.2)::INT)"""
_MAIN = _LISTED + rf""", al AS (SELECT doc_id, page_number, seq, x0, y0, x1, y1, 'TEXT' AS kind, true AS block FROM blocks UNION ALL SELECT doc_id, page_number, table_no, x0, y0, x1, y1, 'TABLE_BODY', false FROM table_areas UNION ALL SELECT doc_id, page_number, image_no, x0, y0, x1, y1, 'FIGURE', false FROM figures
), nb AS (SELECT *, coalesce(list(struct_pack(x0, y0, x1, y1, kind)) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), []) AS bf, coalesce(list(struct_pack(x0, y0, x1, y1, kind)) OVER (w ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), []) AS af FROM al WINDOW w AS (PARTITION BY doc_id, page_number ORDER BY y0, x0, seq)
), dm AS (SELECT doc_id, median(font_size) AS mid FROM blocks GROUP BY doc_id), mb AS (SELECT l.doc_id, l.page_number, l.seq, l.text AS full_text, trim(l.text) AS text, trim(l.text) AS t, l.element_type = 'LIST_ITEM' AS is_item, l.x0, l.y0, l.x1, l.y1, l.page_width, l.page_height, l.font_size, l.is_bold, l.is_italic, mid, bf, af,
 len(list_filter(regexp_split_to_array(trim(l.text), '\s+'), lambda w: w <> '')) AS nw FROM li l JOIN nb n ON n.block AND n.doc_id = l.doc_id AND n.page_number = l.page_number AND n.seq = l.seq JOIN dm ON dm.doc_id = l.doc_id
), ms AS (SELECT *, {STATS_SQL}, regexp_extract(text, '^(\d+(?:\.\d+)+)\s+', 1) AS sec, len(list_filter(bf, lambda e: (e.x1 - e.x0) * (e.y1 - e.y0) >= 400 AND y0 - e.y1 > 0 AND y0 - e.y1 <= 40 AND greatest(0, least(x1, e.x1) - greatest(x0, e.x0)) / (x1 - x0) > 0.5 AND regexp_matches(lower(e.kind), 'image|figure|table|chart'))) > 0 AS near_figure,
 len(list_filter(list_concat(bf, af), lambda e: e.kind IN ('FIGURE', 'TABLE_BODY') AND least(abs(e.y1 - y0), abs(y1 - e.y0)) <= mid * 2 AND greatest(0, least(x1, e.x1) - greatest(x0, e.x0)) * greatest(0, least(y1, e.y1) - greatest(y0, e.y0)) > 0)) > 0 AS beside,
 y0 - coalesce(list_max(list_filter(list_transform(bf, lambda e: e.y1), lambda v: v < y0)), 0) AS up, coalesce(list_min(list_filter(list_transform(af, lambda e: e.y0), lambda v: v > y1)), page_height) - y1 AS down FROM mb
), mp AS (SELECT *, {CAPTION_SQL.format(w='page_width', near='near_figure', mid='mid')} AS cap, {_TITLE_POINTS} AS tp FROM ms
), mc AS (SELECT *, len(bf) > 0 AND cap > 70 AS caught, length(text) >= 2 AND tp > 40 AS titled, least(100, greatest(70, least(100, tp)) + CASE WHEN sec <> '' THEN 10 * (4 - len(string_split(sec, '.'))) ELSE 0 END) AS title_points,
 sentence_count = 1 AND NOT has_verb AND word_count <= 8 AND font_size > mid * 1.1 AS single, (up > mid * 1.5 AND down > mid * 1.5) OR up > mid * 2 OR down > mid * 2 AS lonely FROM mp
), mk0 AS (SELECT *, CASE WHEN text = '' THEN 'DISCARDED' WHEN caught AND starts_with(lower(text), 'figure') THEN 'FIGURE_CAPTION' WHEN caught AND starts_with(lower(text), 'table') THEN 'TABLE_CAPTION' WHEN caught AND beside THEN 'CAPTION' WHEN titled THEN 'TITLE'
 WHEN single AND cap_ratio >= 0.6 AND noun_ratio > 0.5 AND NOT regexp_matches(text, '[.:;!?]$') AND lonely THEN 'LONE' WHEN font_size <= mid * 1.1 AND NOT is_bold AND is_item THEN 'LIST_ITEM' WHEN contains(text, '=') AND (contains(text, '\') OR contains(text, '$')) THEN 'BLOCK_EQUATION' WHEN single AND is_bold THEN 'BOLD' ELSE 'TEXT' END AS hit FROM mc)"""


@query(with_layout(_MAIN + """ SELECT doc_id, page_number, seq, CASE hit WHEN 'LONE' THEN 'TITLE' WHEN 'BOLD' THEN 'TITLE' WHEN 'CAPTION' THEN 'TEXT' ELSE hit END AS element_type, CASE WHEN hit IN ('LONE', 'BOLD') THEN 'TITLE' ELSE hit END AS element_subtype,
 CASE hit WHEN 'DISCARDED' THEN 100 WHEN 'FIGURE_CAPTION' THEN 95 WHEN 'TABLE_CAPTION' THEN 90 WHEN 'CAPTION' THEN cap WHEN 'TITLE' THEN title_points WHEN 'LONE' THEN 85 WHEN 'LIST_ITEM' THEN 90 WHEN 'BLOCK_EQUATION' THEN 90 WHEN 'BOLD' THEN 75 ELSE CASE WHEN caught THEN 95 ELSE 70 END END / 100.0::DOUBLE AS confidence,
 CASE WHEN hit IN ('TITLE', 'LONE', 'BOLD') AND titled AND title_points > 85 AND sec <> '' THEN len(string_split(sec, '.'))::BIGINT END AS title_level FROM mk0"""))
def c01_main_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main cascade with its context of figures and tables."""
    return _main(spark, sf_dir).select(*_KEY, "element_type", "element_subtype", F.col("confidence"), F.col("title_level").cast("long").alias("title_level"))


@query(with_layout(rf""", st AS (SELECT doc_id, page_number, seq, text AS full_text, trim(text) AS text, font_size, is_bold, x0, page_width FROM blocks), s AS (SELECT *, {STATS_SQL} FROM st), v AS (SELECT *, regexp_extract(text, '^(\d+(?:\.\d+)+)\s+', 1) AS sec FROM s),
 t AS (SELECT *, 10 * (word_count <= 8)::INT - 10 * regexp_matches(text, '[.:;!?]$')::INT + 10 * (word_count > 0 AND noun_ratio > 0.5)::INT + 15 * is_bold::INT + 10 * (font_size > 12)::INT + 10 * is_all_caps::INT + 5 * (abs(x0 / page_width - 0.5) < 0.2)::INT + 40 * (sec <> '')::INT
 + 30 * {rx('lower(text)', p.TITLE_LOWER)}::INT - 20 * (word_count > 15)::INT - 10 * has_verb::INT + 10 * (cap_ratio > 0.7)::INT - 20 * (sentence_count > 2)::INT + 5 * (is_bold AND font_size >= avg_word_length * 1.2)::INT AS points FROM v)
SELECT doc_id, page_number, seq, points::BIGINT AS points, CASE WHEN sec <> '' THEN len(string_split(sec, '.'))::BIGINT END AS level, (length(text) >= 2 AND points > 40) AS is_title FROM t"""))
def c03_title_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = load_blocks(spark, sf_dir)
    t = classify.title_score(F.col("text"), F.lit(True), F.col("is_bold"), F.col("font_size"), F.col("x0") / F.col("page_width"))
    return blocks.select(*_KEY, t["points"].cast("long").alias("points"), t["level"].cast("long").alias("level"), t["is_title"].alias("is_title"))


@query(with_layout(rf""", c AS (SELECT *, trim(text) AS t, len(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda w: w <> '')) AS nw FROM blocks), d AS (SELECT *, {CAPTION_SQL.format(w='page_width', near='false', mid='12')} AS points FROM c)
SELECT doc_id, page_number, seq, points::BIGINT AS points, points >= 70 AS likely FROM d"""))
def c05_caption_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.geometry import Box

    cap = classify.caption_score(F.col("text"), Box.of(), F.col("page_width"), F.col("font_size"), F.lit(12.0), F.col("is_italic"), F.lit(False))
    return load_blocks(spark, sf_dir).select(*_KEY, cap["points"].cast("long").alias("points"), cap["likely"].alias("likely"))


_LIKE = rf""", dm AS (SELECT doc_id, median(font_size) AS mid FROM blocks GROUP BY doc_id), lk AS (SELECT b.*, trim(text) AS t, y0 / page_height AS y, len(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda w: w <> '')) AS nw, mid FROM blocks b JOIN dm USING (doc_id)
), ls AS (SELECT *, least(100, 30 * (font_size > mid * 1.2)::INT + 20 * is_bold::INT + 20 * (nw <= 10)::INT + 10 * (NOT regexp_matches(t, '[.:;?!]$'))::INT + 30 * {rx('lower(t)', classify.TITLE_STARTS)}::INT) / 100.0::DOUBLE AS title,
 least(100, 50 * {rx('t', classify.LIST_MARKS)}::INT + 20 * (x0 / page_width > 0.05)::INT + 20 * (length(t) < 200)::INT) / 100.0::DOUBLE AS list_item,
 least(100, 40 * (y < 0.1 OR y > 0.9)::INT + 30 * {rx('lower(t)', p.MARGIN_WORDS)}::INT + 20 * (font_size < mid)::INT + 10 * (length(t) < 100)::INT) / 100.0::DOUBLE AS header_footer,
 least(100, 40 * {rx('t', classify.NOTE_MARKS)}::INT + 30 * (y > 0.8)::INT + 30 * (font_size < mid)::INT) / 100.0::DOUBLE AS footnote,
 least(100, 30 * is_italic::INT + 30 * (font_size < mid)::INT + 20 * (nw <= 20)::INT + 20 * regexp_matches(t, '^[\[(]')::INT) / 100.0::DOUBLE AS annotation FROM lk)"""


@query(with_layout(_LIKE + """, tp AS (SELECT *, greatest(title, list_item, header_footer, footnote, annotation) AS top FROM ls)
SELECT doc_id, page_number, seq, title, list_item, header_footer, footnote, annotation, CASE WHEN top < 0.5 THEN 'Text' WHEN title = top THEN 'Title' WHEN list_item = top THEN 'ListItem' WHEN header_footer = top THEN 'HeaderFooter' WHEN footnote = top THEN 'Footnote' ELSE 'Annotation' END AS element_type FROM tp"""))
def c14_likelihoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five likelihoods and the type of the greatest."""
    return classify.context_elements(load_blocks(spark, sf_dir)).select(*_KEY, "title", "list_item", "header_footer", "footnote", "annotation", "element_type")


@query(with_layout(rf""", sm AS (SELECT doc_id, list_sort(list(font_size))[count(*) // 2 + 1] AS mid FROM blocks GROUP BY doc_id), sc AS (SELECT b.*, {SCORED_CLEAN_SQL} AS t, mid, 1 - y1 / page_height AS up FROM blocks b JOIN sm USING (doc_id)
), sd AS (SELECT *, (up < 0.1 OR up > 0.9) AS edge, len(list_filter(regexp_split_to_array(t, '\s+'), lambda w: w <> '')) AS nw FROM sc
), se AS (SELECT *, length(t) <= 3 AND regexp_matches(t, '^\d+$') AND edge AS numbered, 2 * (font_size > mid * 1.2)::INT + (up > 0.8)::INT + (nw <= 10)::INT + (NOT regexp_matches(t, '[.:;?!]$'))::INT + is_bold::INT + 2 * {rx('lower(t)', classify.TITLE_STARTS)}::INT AS ti,
 2 * {rx('trim(text)', classify.LIST_MARKS)}::INT + (x0 / page_width > 0.05)::INT + (length(t) < 200)::INT + 1 AS li, 2 * {rx('t', classify.NOTE_MARKS)}::INT + (up < 0.2)::INT + (font_size < mid)::INT AS fo,
 2 * edge::INT + 2 * {rx('lower(t)', p.MARGIN_WORDS)}::INT + (font_size < mid)::INT + (length(t) < 100)::INT AS ma FROM sd)
SELECT doc_id, page_number, seq, CASE WHEN numbered THEN 'PageNumber' WHEN ti >= 3 THEN 'Title' WHEN li >= 3 THEN 'ListItem' WHEN fo >= 3 THEN 'Footnote' WHEN ma >= 3 THEN 'HeaderFooter' ELSE 'Text' END AS element_type,
 CASE WHEN numbered THEN 90 WHEN ti >= 3 THEN least(100, 50 + 10 * ti) WHEN li >= 3 THEN least(100, 50 + 10 * li) WHEN fo >= 3 THEN least(100, 50 + 10 * fo) WHEN ma >= 3 THEN least(100, 50 + 10 * ma) ELSE 0 END / 100.0::DOUBLE AS confidence FROM se"""))
def c12_scored_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored analyser."""
    return classify.scored_elements(load_blocks(spark, sf_dir)).select(*_KEY, "element_type", "confidence")


_BLOCK_STATS = rf""", bs AS (SELECT doc_id, page_number, seq, text, trim(text) AS t, len(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda w: w <> '')) AS nw, is_bold, is_italic, font_size, y0, page_height, {STATS_SQL} FROM blocks)"""


@query(with_layout(_BLOCK_STATS + rf""" SELECT doc_id, page_number, seq, round(least(100, 20 * (nw <= 10)::INT + 20 * (is_title_case OR is_all_caps)::INT + 20 * is_bold::INT + 30 * (font_size / 12 > 1.2)::INT + 10 * (NOT regexp_matches(t, '[.!?]$'))::INT) / 100.0::DOUBLE, 6) AS title,
 (t <> '' AND NOT regexp_matches(text, '^\d+$') AND alpha_ratio >= 0.5 AND cap_ratio <= 0.5 AND (len(list_filter(regexp_split_to_array(text, '[.!?]+\s+'), lambda s: trim(s) <> '' AND len(regexp_split_to_array(trim(s), '\s+')) >= 3)) >= 2 OR has_verb)) AS narrative,
 CASE WHEN regexp_matches(text, '(?i)^table\s+\d+') THEN 'TABLE_CAPTION' WHEN regexp_matches(text, '(?i)^fig(?:ure)?\.?\s+\d+') THEN 'FIGURE_CAPTION' WHEN {rx('text', p.LIST_START)} THEN 'LIST_ITEM' WHEN is_bold AND nw < 10 THEN 'TITLE' ELSE 'TEXT' END AS fallback FROM bs"""))
def c17_utility_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The utility title score, narrative test and fallback type."""
    t = F.col("text")
    return load_blocks(spark, sf_dir).select(*_KEY, r6(classify.simple_title(t, F.col("is_bold"), F.col("font_size") / 12)).alias("title"), classify.possible_narrative(t).alias("narrative"), classify.fallback_type(t, F.lit("DISCARDED"), F.col("is_bold")).alias("fallback"))


@query(with_layout(_BLOCK_STATS + rf""", dm AS (SELECT doc_id, median(font_size) AS mid FROM blocks GROUP BY doc_id), ct AS (SELECT *, least(100, greatest(0, 30 * (font_size > mid * 1.2)::INT + 20 * is_bold::INT + 10 * is_italic::INT + 15 * is_all_caps::INT
 + 10 * (NOT is_all_caps AND NOT regexp_matches(t, '(?:^|[^\p{{L}}])\p{{Ll}}') AND NOT regexp_matches(t, '\p{{L}}\p{{Lu}}'))::INT + 10 * (nw <= 15)::INT - 20 * regexp_matches(t, '[.:;]$')::INT + 30 * regexp_matches(t, '^\d+\.?\d*\s+[\p{{L}}\p{{N}}_]+')::INT
 + 25 * (NOT regexp_matches(t, '^\d+\.?\d*\s+[\p{{L}}\p{{N}}_]+') AND regexp_matches(t, '^[A-Z]\.\s+[\p{{L}}\p{{N}}_]+'))::INT + 25 * regexp_matches(lower(t), '^(?:chapter|section|appendix|introduction|conclusion|abstract|summary)\s+\d*')::INT - 10 * has_verb::INT - 15 * (y0 / page_height > 0.8 OR y0 / page_height < 0.1)::INT)) AS raw,
 (length(t) < 2 OR nw > 25 OR len(regexp_split_to_array(t, '[.!?]+')) > 2) AS out FROM bs JOIN dm USING (doc_id))
SELECT doc_id, page_number, seq, CASE WHEN out THEN 0 ELSE raw END::BIGINT AS points, (NOT out AND raw > 40) AS is_title FROM ct"""))
def c04_likely_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second title score (C4)."""
    blocks = load_blocks(spark, sf_dir)
    at = blocks.join(blocks.groupBy("doc_id").agg(F.median("font_size").alias("mid")), "doc_id")
    c = classify.likely_title(F.col("text"), F.col("font_size"), F.col("mid"), F.col("is_bold"), F.col("is_italic"), F.col("y0") / F.col("page_height"))
    return at.select(*_KEY, c["points"].cast("long").alias("points"), c["is_title"].alias("is_title"))


@query(with_layout(_BODY + rf""", ab AS (SELECT b.*, body_font_size AS body, {CAPS_SQL} AS caps, {rx('text', classify.HEADINGS)} AS headed, len(string_split(text, chr(10))) AS nl, length(replace(text, chr(10), ''))::DOUBLE / len(string_split(text, chr(10))) AS mean_line FROM blocks b JOIN body USING (doc_id, page_number)
), ac AS (SELECT *, CASE WHEN nl <= 2 AND mean_line < 100 AND trim(text) <> '' AND (font_size / body > 1.2 OR caps OR headed) THEN least(100, 80 + 10 * (font_size / body > 1.2)::INT + 10 * is_bold::INT + 10 * headed::INT) ELSE 0 END AS title,
 CASE WHEN nl <= 2 AND mean_line < 80 AND trim(text) <> '' THEN 70 + 10 * (abs(font_size - body) > 0.5)::INT + 10 * is_bold::INT + 10 * (nl = 1)::INT ELSE 0 END AS margin FROM ab)
SELECT doc_id, page_number, seq, title::BIGINT AS title_points, title > 70 AS is_title, margin::BIGINT AS margin_points, margin > 70 AS is_margin FROM ac"""))
def c16_analysed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text analyser's title, and header or footer."""
    blocks = load_blocks(spark, sf_dir)
    at = blocks.join(stats.body_font(blocks), ["doc_id", "page_number"])
    sides = F.col("text"), F.col("font_size"), F.col("body_font_size"), F.col("is_bold")
    title, margin = classify.analysed_title(*sides)["points"], classify.analysed_margin(*sides)["points"]
    return at.select(*_KEY, title.cast("long").alias("title_points"), (title > 70).alias("is_title"), margin.cast("long").alias("margin_points"), (margin > 70).alias("is_margin"))


@query(with_layout(_LISTED + rf""", nw AS (SELECT *, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS n FROM li)
SELECT doc_id, page_number, seq, CASE WHEN regexp_matches(trim(text), '(?i)^table\s+\d+[:.]?\s*$') THEN 'TABLE_CAPTION' WHEN regexp_matches(trim(text), '(?i)^figure\s+\d+[:.]?\s*$') THEN 'FIGURE_CAPTION' WHEN regexp_matches(trim(text), '^\s*\d+[.)]\s+|^\s*[\x{{2022}}*-]\s+') THEN 'LIST_ITEM'
 WHEN is_bold AND len(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda w: w <> '')) < 10 THEN 'HEADING' ELSE 'UNKNOWN' END AS pre_type,
 CASE WHEN regexp_matches(lower(text), 'table|figure|chart|diagram') THEN 'CAPTION' WHEN n < 5 AND ends_with(text, ':') THEN 'HEADING' WHEN regexp_matches(trim(text), '^\d{{1,4}}$') THEN 'PAGE_NUMBER' WHEN regexp_matches(trim(text), '^[\x{{2022}}*\x{{2023}}\x{{2043}}-]$') THEN 'LIST_ITEM' ELSE 'TEXT' END AS last_type FROM nw"""))
def c02_fallback_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The types before classification and where it leaves a block unknown."""
    t = F.col("text")
    return load_blocks(spark, sf_dir).select(*_KEY, classify.pre_type(t, F.col("is_bold"), F.lit(False)).alias("pre_type"), classify.last_resort(t).alias("last_type"))


_SPLIT = _LISTED + """, pe AS (SELECT doc_id, page_number, arg_min(b, (b.y0, b.x0, b.seq)) AS f, arg_max(b, (b.y0, b.x0, b.seq)) AS l FROM (SELECT doc_id, page_number, struct_pack(seq, text, x0, y0, x1, y1, font_name, font_size, element_type) AS b FROM li WHERE NOT (abs((x0 + x1) / 2 - page_width / 2) < page_width * 0.15 AND y0 > page_height * 0.85 AND regexp_matches(trim(text), '^\\d{1,5}$'))) GROUP BY ALL
), br AS (SELECT a.doc_id, a.page_number, a.f AS af, a.l AS al, b.f AS bf, b.l AS bl FROM pe a JOIN pe b ON a.doc_id = b.doc_id AND a.page_number + 1 = b.page_number)"""
_CONT = " UNION ALL ".join(f"SELECT doc_id, page_number, 'CONTINUATION' AS split_type, 0.9 AS confidence, {side} AS source, NULL AS target FROM br WHERE {rx(f'{side}.text', c)}" for side in ("al", "bf") for c in p.CONTINUED)
MARKERS_SQL = _SPLIT + rf""", mk AS ({_CONT}
 UNION ALL SELECT doc_id, page_number, 'SPLIT_HEADER', 0.8, af, bf FROM br WHERE trim(af.text) = trim(bf.text) AND abs(af.x0 - bf.x0) < 20 AND af.font_name = bf.font_name
 UNION ALL SELECT doc_id, page_number, 'SPLIT_FOOTER', 0.8, al, bl FROM br WHERE trim(al.text) = trim(bl.text) AND abs(al.x0 - bl.x0) < 20 AND al.font_name = bl.font_name
 UNION ALL SELECT doc_id, page_number, 'SPLIT_TABLE', 0.85, al, bf FROM br WHERE {rx('al.text', p.TABLE_MENTION)} AND {rx('bf.text', p.TABLE_MENTION)}
 UNION ALL SELECT doc_id, page_number, 'SPLIT_LIST', 0.9, al, bf FROM br WHERE al.element_type = 'LIST_ITEM' AND bf.element_type = 'LIST_ITEM' AND abs(al.x0 - bf.x0) < 10
 UNION ALL SELECT doc_id, page_number, 'SPLIT_PARAGRAPH', 0.8, al, bf FROM br WHERE al.element_type = 'TEXT' AND bf.element_type = 'TEXT' AND NOT regexp_matches(trim(al.text), '[.!?]$') AND NOT regexp_matches(trim(bf.text), '^[\x{{2022}}\x{{25AA}}\x{{25AB}}\x{{25CB}}\x{{25A0}}\x{{25A1}}\x{{25CF}}\x{{25C6}}\x{{25C7}}\x{{25B6}}\x{{25B7}}-]') AND abs(al.x0 - bf.x0) < 15 AND al.font_name = bf.font_name AND abs(al.font_size - bf.font_size) < 0.5)"""


@query(with_layout(MARKERS_SQL + """
SELECT doc_id, page_number AS source_page, page_number + 1 AS target_page, split_type, confidence::DOUBLE AS confidence FROM mk"""))
def x06_split_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All split detectors."""
    return splits.split_markers(running_text(spark, sf_dir)).select("doc_id", "source_page", "target_page", "split_type", "confidence")


@query(with_layout(MARKERS_SQL + """, sides AS (SELECT doc_id, page_number, split_type, confidence, 'source' AS role, source AS s FROM mk UNION ALL SELECT doc_id, page_number + 1, split_type, confidence, 'target', target FROM mk WHERE target IS NOT NULL
), hit AS (SELECT e.doc_id, e.page_number, e.seq, struct_pack(split_type, role, confidence) AS m FROM li e JOIN sides USING (doc_id, page_number) WHERE NOT (abs((x0 + x1) / 2 - page_width / 2) < page_width * 0.15 AND y0 > page_height * 0.85 AND regexp_matches(trim(text), '^\\d{1,5}$'))
 AND greatest(0, least(e.x1, s.x1) - greatest(e.x0, s.x0)) * greatest(0, least(e.y1, s.y1) - greatest(e.y0, s.y0)) / ((e.x1 - e.x0) * (e.y1 - e.y0)) > 0.7)
SELECT doc_id, page_number, seq, '[' || array_to_string(list_transform(ms, lambda m: '{"split_type":"' || m.split_type || '","role":"' || m.role || '","confidence":' || m.confidence::DOUBLE || '}'), ',') || ']' AS splits FROM (SELECT doc_id, page_number, seq, list_sort(list(m)) AS ms FROM hit GROUP BY ALL)"""))
def j08_split_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers tied to the elements that they cover."""
    elements = running_text(spark, sf_dir)
    out = splits.annotate(elements, splits.split_markers(elements)).where("splits is not null")
    return out.select(*_KEY, F.to_json("splits").alias("splits"))


_GRID = r"list_transform(list_filter(string_split(text, chr(10)), lambda r: contains(r, '|')), lambda r: list_transform(string_split(r, '|'), lambda c: CASE WHEN trim(c) IN ('', 'nan', 'NaN', 'NULL') THEN '' ELSE trim(c) END))"


@query(rf"""WITH g AS (SELECT doc_id, list_filter({_GRID}, lambda r: len(list_filter(r, lambda c: c <> '')) > 0) AS rows FROM documents WHERE contains(text, '|')), h AS (SELECT doc_id, rows, coalesce(list_max(list_transform(rows, lambda r: len(r))), 0) AS wide FROM g WHERE len(rows) > 0
), k AS (SELECT doc_id, rows, list_filter(range(1, wide + 1), lambda i: len(list_filter(rows, lambda r: coalesce(r[i], '') <> '')) > 0) AS keep FROM h), c AS (SELECT doc_id, list_transform(rows, lambda r: list_transform(keep, lambda i: coalesce(r[i], ''))) AS cells FROM k)
SELECT doc_id, '<table><thead><tr>' || array_to_string(list_transform(range(len(cells[1])), lambda i: '<th>' || i || '</th>'), '') || '</tr></thead><tbody>' || array_to_string(list_transform(cells, lambda r: '<tr>' || array_to_string(list_transform(r, lambda c: '<td>' || c || '</td>'), '') || '</tr>'), '') || '</tbody></table>' AS table_html FROM c""")
def src14_table_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of barred lines cleaned and written as HTML (SRC13-SRC15, W17)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.col("text").contains("|"))
    grids = docs.select("doc_id", F.lit(1).alias("page_number"), F.lit(1).alias("table_no"), tables.grid(F.col("text")).alias("cells"))
    return tables.table_elements(grids).select("doc_id", "table_html")


@query(with_layout(FAST_SQL + """ SELECT doc_id, page_number, '{"page_number":' || page_number || ',"elements":[' || string_agg('{"seq":' || seq || ',"element_type":"' || element_type || '"}', ',' ORDER BY y0, x0, seq) || ']}' AS json FROM fast GROUP BY doc_id, page_number"""))
def src19_page_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements grouped by page as JSON (SRC17, SRC19-SRC21, O2)."""
    return files.page_json(classify.fast_elements(load_blocks(spark, sf_dir)), "seq", "element_type")


@query(with_layout(FAST_SQL + """ SELECT doc_id, seq, '{"element_id":"' || sha256(doc_id || '|' || page_number || '|' || seq) || '","type":"' || element_type || '","text":' || to_json(text)::VARCHAR || ',"metadata":{"coordinates":{"points":[{"x":' || x0 || ',"y":' || y0 || '},{"x":' || x0 || ',"y":' || y1 || '},{"x":' || x1 || ',"y":' || y1 || '},{"x":' || x1 || ',"y":' || y0
 || '}],"layout_width":' || page_width || ',"layout_height":' || page_height || '},"filename":"document","filetype":"application/pdf","page_number":' || page_number || ',"languages":["eng"],"detection_class_prob":' || confidence || ',"font_size":' || font_size || '}}' AS json FROM fast"""))
def src22_polygon_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alternate JSON record of every element (SRC22, G13)."""
    return files.polygon_json(classify.fast_elements(load_blocks(spark, sf_dir)))


@query("""SELECT event_id, len(list_filter([CASE WHEN json_extract_string(props, '$.k') IS NULL THEN 'k is missing' WHEN TRY_CAST(json_extract_string(props, '$.k') AS TINYINT) IS NULL THEN 'k is not tinyint' END, CASE WHEN json_extract_string(props, '$.v') IS NULL THEN 'v is missing' END], lambda e: e IS NOT NULL))::BIGINT AS n_errors FROM events""")
def src18_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schema errors of JSON texts (SRC18)."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("props").alias("json"))
    return files.validate(events, {"k": "tinyint", "v": "string"}).select("event_id", F.size("errors").cast("long").alias("n_errors"))


@query(r"""WITH hb AS (SELECT page_id, regexp_extract_all(regexp_replace(html, '(?is)<(?:script|style|nav)[^>]*>.*?</(?:script|style|nav)>', '', 'g'), '(?is)<((?:h[1-6]|p|li)(?:\s[^>]*)?>.*?)</(?:h[1-6]|p|li)>', 1) AS raws FROM pages
), he AS (SELECT page_id, unnest(raws) AS raw, unnest(range(len(raws))) AS seq FROM hb), ht AS (SELECT page_id, seq, lower(regexp_extract(raw, '^(\w+)', 1)) AS tag,
 trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(raw, '(?s)^[^>]*>', ''), '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM he)
SELECT * FROM ht WHERE text <> ''""")
def src05_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings, paragraphs and items of raw web pages (SRC5, SRC6)."""
    return files.html_blocks(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query(with_layout(_PAGE_STATS + " SELECT doc_id, page_number, round(greatest(1.0, median_word_spacing / 4), 6) AS char_margin, round(greatest(0.3, median_line_height / 28), 6) AS line_margin FROM ps"))
def src27_adaptive_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = files.adaptive_options(stats.page_stats(load_blocks(spark, sf_dir)))
    return out.withColumns({k: r6(F.col(k)) for k in ("char_margin", "line_margin")})


@query(with_layout(_LISTED + " SELECT doc_id, page_number, seq, text, element_type FROM li UNION ALL SELECT doc_id, page_number, table_no, '[Table ' || table_no || ']', 'TABLE_BODY' FROM table_areas UNION ALL SELECT doc_id, page_number, image_no, '[Figure ' || image_no || ']', 'FIGURE' FROM figures"))
def u01_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text, table and figure elements as one (U1, SRC7, W17)."""
    blocks = load_blocks(spark, sf_dir)
    t = layout.table_areas(blocks).select("doc_id", "page_number", F.col("table_no").alias("seq"), F.format_string("[Table %d]", "table_no").alias("text"), F.lit("TABLE_BODY").alias("element_type"))
    f = layout.figures(blocks).select("doc_id", "page_number", F.col("image_no").alias("seq"), F.format_string("[Figure %d]", "image_no").alias("text"), F.lit("FIGURE").alias("element_type"))
    return _listed(spark, sf_dir).select(*_KEY, "text", "element_type").unionByName(t).unionByName(f)
