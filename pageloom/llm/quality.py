"""Quality rules from suffix-array repetition.

The suffix array is over words, built by prefix doubling on many documents at a time: a word is hashed
with its document, so suffixes of different documents never compare equal and every step is a numpy sort
of the still unresolved suffixes. The rank arrays of all doublings are kept; comparing them from the
longest down gives the longest common prefix (LCP) of neighbours in the suffix array.

A suffix's deepest LCP interval has depth ``max(LCP to the left, LCP to the right)``: the length of the
longest maximal repeated substring that starts there. Where the depth is at least ``min_words`` the
occurrence span is covered; spans are united, and the document is rejected if the united spans hold more
than ``max_fraction`` of its words or if one repeat is longer than ``max_repeat`` words.

Defined cases: a null or empty text, and any text of fewer than ``min_words`` words, has no repeats and
is kept, with measures 0. Rows are judged one by one, so repeated rows, ties and null ids change nothing;
an empty table gives an empty table; further columns pass through ``keep_documents`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .common import narrow, positional

MIN_WORDS, MAX_FRACTION, MAX_REPEAT = 10, 0.3, 200


def _depths(token: np.ndarray, least: int) -> np.ndarray:
    """For each position the longest prefix of its suffix that occurs elsewhere, if ``least`` or longer."""
    n = len(token)
    order = np.argsort(token, kind="stable")
    rank, active = _ranked(order, token[order], n)
    levels, step = [rank], 1
    while len(active):
        follow = active + step
        second = np.where(follow < n, rank[np.minimum(follow, n - 1)], -1)
        o = np.lexsort((second, rank[active]))
        active, second = active[o], second[o]
        lead = rank[active]
        new = np.empty(len(active), bool)
        new[0] = True
        new[1:] = (lead[1:] != lead[:-1]) | (second[1:] != second[:-1])
        first = np.empty(len(active), bool)
        first[0] = True
        first[1:] = lead[1:] != lead[:-1]
        at = np.arange(len(active))
        head = np.maximum.accumulate(np.where(first, at, 0))
        mine = np.maximum.accumulate(np.where(new, at, 0))
        rank = rank.copy()
        rank[active] = lead + (mine - head)
        alone = new & np.append(new[1:], True)
        active = active[~alone]
        levels.append(rank)
        step *= 2
    sa = np.empty(n, np.int64)
    sa[rank] = np.arange(n)
    a, b = sa[:-1], sa[1:]
    floor = min(int(np.log2(max(least, 1))), len(levels) - 1)
    live = np.flatnonzero(levels[floor][a] == levels[floor][b])
    a, b, length = a[live], b[live], np.zeros(len(live), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + length, b + length
        inside = (x < n) & (y < n)
        same = inside & (levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)])
        length += same.astype(np.int64) << k
    depth = np.zeros(n, np.int64)
    np.maximum.at(depth, a, length)
    np.maximum.at(depth, b, length)
    depth[depth < least] = 0
    return depth


def _ranked(order: np.ndarray, sorted_keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    new = np.empty(n, bool)
    if n:
        new[0] = True
        new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    at = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, at, 0)) if n else at
    alone = new & np.append(new[1:], True) if n else new
    return rank, order[~alone]


def measure(column: pa.Array, least: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row: words, words in repeated spans, and the longest repeat in words."""
    data, offsets = vec.flat(column)
    n_words, covered, longest = (np.zeros(len(offsets) - 1, np.int64) for _ in range(3))
    for i, j in vec.chunks(offsets):
        part = data[offsets[i] : offsets[j]]
        h, _, bounds = vec.words(part, offsets[i : j + 1] - offsets[i])
        sizes = np.diff(bounds)
        n_words[i:j] = sizes
        if not len(h):
            continue
        row = np.repeat(np.arange(len(sizes)), sizes)
        depth = _depths(vec.mix(h ^ vec.mix(row.astype(np.uint64) + np.uint64(1))), least)
        np.maximum.at(longest[i:j], row, depth)
        hit = np.flatnonzero(depth)
        edge = np.zeros(len(h) + 1, np.int64)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + depth[hit], -1)
        covered[i:j] = np.bincount(row, weights=np.cumsum(edge[:-1]) > 0, minlength=len(sizes)).astype(np.int64)
    return n_words, covered, longest


def verdicts(docs: DataFrame, min_words: int = MIN_WORDS, max_fraction: float = MAX_FRACTION, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """doc_id, n_words, repeated_words, longest_repeat, keep: one row for each document."""
    rows = narrow(docs, "doc_id", "text")
    kind = rows.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, covered, longest = measure(batch.column(1), min_words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(covered), pa.array(longest)], names=["doc_id", "n_words", "repeated_words", "longest_repeat"])

    out = rows.mapInArrow(run, f"doc_id {kind.simpleString()}, n_words long, repeated_words long, longest_repeat long")
    return out.withColumn("keep", (F.col("repeated_words") <= F.col("n_words") * max_fraction) & (F.col("longest_repeat") <= max_repeat))


def keep_documents(docs: DataFrame, min_words: int = MIN_WORDS, max_fraction: float = MAX_FRACTION, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """The documents that pass, with all their columns: one scan, no shuffle."""
    rows, at = positional(docs), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, covered, longest = measure(batch.column(at), min_words)
            yield batch.filter(pa.array((covered <= n * max_fraction) & (longest <= max_repeat)))

    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)


def quality_rules(docs: DataFrame, **rules: float) -> DataFrame:
    """The kept documents' ids and measures."""
    return verdicts(docs, **rules).where("keep").drop("keep")
