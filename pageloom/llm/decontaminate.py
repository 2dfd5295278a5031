"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Texts are sequences of word hashes. The CGK random walk reads a window of words: in each step it emits the
word under its pointer, and a random bit of that word decides whether the pointer moves on. Walks over two
windows at a small edit distance soon fall into step again, so most of the emitted symbols agree: edit
distance becomes Hamming distance. One repetition of the LSH samples ``SAMPLES`` emitted symbols and hashes
them. Items are taken by classes of length, 1, 2 to 3, 4 to 7 words and so on; windows have the size of the
shortest item a class can hold (at most ``WINDOW`` words), an item of more words is represented by all its
windows, and a window starts at every word of every document, so an item is found through any of its
windows. The number of repetitions of a class is the least that finds at least ``recall`` of simulated copies
of its items with as many random edits as are tolerated; an error is raised where ``REPS`` don't reach it.

A key that agrees is a candidate: the words around it are compared with the whole item by exact edit
distance with free ends (the item against any stretch of the document), and the document is reported where
that is at most ``edits`` times the item's words, rounded down.

Benchmark items are collected in slices of about ``SLICE`` words, which go to every executor (8 bytes a word;
the keys are made there); the documents are scanned once for each slice, so what one scan is sent is bounded
by the slice and the longest item, whatever the tables.

Defined cases: a null or empty text, or one without words, holds nothing; an item without words (or null)
matches nothing; items of equal text are all reported. Repeated rows are judged each on its own. Empty
tables give an empty result or leave all documents. Further columns pass through ``keep_documents``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from . import vec
from .common import narrow, positional

EDITS, RECALL, WINDOW, SAMPLES, SLICE, REPS, TRIALS = 0.15, 0.98, 16, 4, 1 << 17, 1000, 200
_STEPS = 64  # a word's hash has as many coins


def walk(h: np.ndarray, start: np.ndarray, end: np.ndarray, picks: np.ndarray, salt: int) -> np.ndarray:
    """The sampled symbols of each walk, hashed to 64 bits; past ``end`` the pad symbol 0 is read.

    ``picks`` are the sampled steps in rising order; step k decides by bit k of the salted word.
    """
    coin = vec.mix(h ^ np.uint64(salt))
    at, key = start.copy(), np.full(len(start), salt, np.uint64)
    for k in range(int(picks[-1]) + 1):
        inside = at < end
        safe = np.minimum(at, max(len(h) - 1, 0))
        if k in picks:
            key = vec.mix(key ^ np.where(inside, h[safe], np.uint64(0)))
        at = at + (inside & ((coin[safe] >> np.uint64(k)) & np.uint64(1) == 1))
    return key


class Plan:
    """Items of one class of length, their window size and repetitions; everything a scan needs."""

    def __init__(self, items: list[tuple[object, np.ndarray]], edits: float = EDITS, recall: float = RECALL) -> None:
        self.items, self.edits = items, edits
        self.window = min(WINDOW, 1 << (min(len(w) for _, w in items).bit_length() - 1))
        self.draws: list[tuple[int, np.ndarray]] = []
        self.tables: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        rng = np.random.default_rng(5)
        steps = min(2 * self.window, _STEPS)
        trials = self._trials(rng)
        found = np.zeros(len(trials), bool)
        while not self.draws or found.mean() < recall:
            if len(self.draws) == REPS:
                raise ValueError(f"{REPS} repetitions find {found.mean():.3f} of the copies, not {recall}")
            picks = np.sort(rng.choice(steps, min(SAMPLES, steps), replace=False))
            salt = int(rng.integers(1, 1 << 62))
            self.draws.append((salt, picks))
            for n in np.flatnonzero(~found):
                i, copy = trials[n]
                mine = self._windows([self.items[i][1]], picks, salt)[0]
                found[n] = np.isin(self._windows([copy], picks, salt)[0], mine).any()

    def __getstate__(self) -> dict:
        return self.__dict__ | {"tables": []}

    @property
    def reps(self) -> int:
        return len(self.draws)

    def keyed(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each repetition the windows' keys in order, their items and offsets, and a bitmap of the keys."""
        if not self.tables:
            self.listed = [w.tolist() for _, w in self.items]
            for salt, picks in self.draws:
                keys, item, offset = self._windows([w for _, w in self.items], picks, salt)
                o = np.argsort(keys, kind="stable")
                bits = np.zeros(1 << 22, bool)
                bits[(keys >> np.uint64(42)).astype(np.int64)] = True
                self.tables.append((keys[o], item[o], offset[o], bits))
        return self.tables

    def _trials(self, rng: np.random.Generator) -> list[tuple[int, np.ndarray]]:
        """Copies of items with all the edits that are tolerated."""
        out = []
        for i in rng.integers(0, len(self.items), TRIALS):
            w = list(self.items[i][1])
            for _ in range(int(self.edits * len(w))):
                k, at = rng.integers(3), int(rng.integers(0, len(w)))
                w[at : at + (k > 0)] = [np.uint64(rng.integers(1, 1 << 62))] if k < 2 else []
            out.append((int(i), np.array(w, np.uint64)))
        return out

    def _windows(self, texts: list[np.ndarray], picks: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = np.concatenate(texts) if texts else np.zeros(0, np.uint64)
        bounds = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
        count = np.maximum(np.diff(bounds) - self.window + 1, (np.diff(bounds) > 0).astype(np.int64))
        item = np.repeat(np.arange(len(texts)), count)
        offset = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
        start = bounds[:-1][item] + offset
        return walk(h, start, np.minimum(start + self.window, bounds[1:][item]), picks, salt), item, offset

    def scan(self, h: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(row, item index, edits, first word) of every item found in rows of words; the best stretch of each."""
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        start = np.arange(len(h))
        end = np.minimum(start + self.window, bounds[1:][row])
        near: set[tuple[int, int, int]] = set()
        for (salt, picks), (keys, item, offset, bits) in zip(self.draws, self.keyed()):
            key = walk(h, start, end, picks, salt)
            at = np.flatnonzero(bits[(key >> np.uint64(42)).astype(np.int64)])
            lo, hi = np.searchsorted(keys, key[at], "left"), np.searchsorted(keys, key[at], "right")
            n = hi - lo
            p = np.repeat(at, n)
            q = np.repeat(lo, n) + np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n)
            near.update(zip(row[p].tolist(), item[q].tolist(), (p - bounds[:-1][row[p]] - offset[q]).tolist()))
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for r, it, shift in sorted(near):
            words = self.items[it][1]
            slack = int(self.edits * len(words))
            a, b = max(0, shift - slack), min(int(bounds[r + 1] - bounds[r]), shift + len(words) + slack)
            text = h[bounds[r] + a : bounds[r] + b] if b > a else h[:0]
            # every word of the item but those edited must be there, which is cheap to ask first
            there = set(text.tolist())
            if len(text) and sum(w in there for w in self.listed[it]) >= len(words) - slack:
                d, first = infix_distance(words, text)
                if d <= slack:
                    best[r, it] = min(best.get((r, it), (d, a + first)), (d, a + first))
        for (r, it), (d, first) in sorted(best.items()):
            yield r, it, d, first


def plans(items: list[tuple[object, np.ndarray]], edits: float = EDITS, recall: float = RECALL) -> list[Plan]:
    """One plan for each class of length."""
    classes: dict[int, list[tuple[object, np.ndarray]]] = {}
    for item in items:
        classes.setdefault(min(len(item[1]).bit_length(), WINDOW.bit_length()), []).append(item)
    return [Plan(some, edits, recall) for _, some in sorted(classes.items())]


def scan(made: list[Plan], column: pa.Array) -> Iterator[tuple[int, object, int, int]]:
    """(row, item id, edits, first word) of every item found."""
    data, offsets = vec.flat(column)
    for i, j in vec.chunks(offsets):
        h, _, bounds = vec.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        for plan in made if len(h) else ():
            for r, it, d, first in plan.scan(h, bounds):
                yield i + r, plan.items[it][0], d, first


def infix_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """The least edit distance of the item to a stretch of the text, and where the earliest such begins."""
    m = len(text)
    wide = np.int64(m + 1)
    # cost and start travel together, so that least cost and then least start win
    prev = np.arange(m + 1)
    step = np.arange(m + 1) * wide
    for n, w in enumerate(item, 1):
        cur = np.empty(m + 1, np.int64)
        cur[0] = n * wide
        cur[1:] = np.minimum(prev[1:] + wide, prev[:-1] + np.where(text == w, 0, wide))
        prev = np.minimum.accumulate(cur - step) + step
    b = int(prev.min())
    return int(b // wide), int(b % wide)


def _slices(benchmark: DataFrame) -> Iterator[list[tuple[object, np.ndarray]]]:
    """Items with their words, some at a time."""
    held: list[tuple[object, np.ndarray]] = []
    size = 0
    for r in narrow(benchmark, "item_id", "text").where("text is not null").toLocalIterator():
        data, offsets = vec.flat(pa.array([r["text"]]))
        words = vec.words(data, offsets)[0]
        if len(words):
            held.append((r["item_id"], words))
            size += len(words)
        if size >= SLICE:
            yield held
            held, size = [], 0
    if held:
        yield held


def contaminated(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, recall: float = RECALL) -> DataFrame:
    """doc_id, item_id, edits, first_word (from 1): every benchmark item found in a document."""
    rows = narrow(docs, "doc_id", "text")
    ids = narrow(benchmark, "item_id").schema["item_id"].dataType
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id {ids.simpleString()}, edits int, first_word long"
    id_type = to_arrow_type(ids)
    out = None
    for items in _slices(benchmark):
        made = plans(items, edits, recall)

        def run(batches: Iterator[pa.RecordBatch], made: list[Plan] = made) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hits = list(scan(made, batch.column(1)))
                at, it, d, first = zip(*hits) if hits else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(it, id_type), pa.array(d, pa.int32()), pa.array([f + 1 for f in first], pa.int64())], names=["doc_id", "item_id", "edits", "first_word"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else rows.sparkSession.createDataFrame([], schema)


def keep_documents(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, recall: float = RECALL) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns: no shuffle."""
    out, at = positional(docs), docs.columns.index("text")
    for items in _slices(benchmark):
        made = plans(items, edits, recall)

        def run(batches: Iterator[pa.RecordBatch], made: list[Plan] = made) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(len(batch), bool)
                clean[[r for r, *_ in scan(made, batch.column(at))]] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(run, out.schema)
    return out.toDF(*docs.columns)
