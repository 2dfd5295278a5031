"""Vector best-fit packing of documents into training bins.

A bin has three capacities: tokens, documents and attention cost (the sum of squared lengths). A piece of
``n`` tokens demands (n, 1, n * n). Pieces are taken by falling length within a shard and go to the open
bin that scores best among those with room in every dimension:

* ``dot``: the largest weighted dot product of demand and residual, both relative to the capacities;
* ``norm``: the least weighted squared norm of what the bin would have left.

Ties go to the oldest bin; where no bin has room a new one opens. A document longer than one bin's tokens,
or than its attention cost allows, is cut into full pieces and a last one, so every token is packed.

A token here is a word of ``vec`` (any length column can be passed instead). Shards are chosen by a hash of
the row and piece, about ``shard`` pieces each, so each is packed by one task, whatever the number of shards.
Rows that are repeated more than ``REPEATED`` times are spread over the shards by their place in the table.

Defined cases: a document without tokens (null or empty text) has one piece of 0 tokens, which takes up a
place only; null ids are carried; repeated rows are packed each; an empty table has no bins; other columns
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .common import cut, narrow, row_key

TOKENS, DOCUMENTS, COST = 4096, 32, 2048 * 4096
WEIGHTS = (1.0, 0.25, 0.5)
SHARD, REPEATED = 8192, 64


def piece_sizes(n: int, tokens: int, cost: int) -> tuple[int, int, int]:
    """The size of a full piece, how many there are, and what is left (0 only for an empty document or an even cut)."""
    most = min(tokens, math.isqrt(cost))
    full = max(0, n - 1) // most
    return most, full, n - full * most


def pack(sizes: np.ndarray, tokens: int = TOKENS, documents: int = DOCUMENTS, cost: int = COST, weights: tuple[float, float, float] = WEIGHTS, score: str = "dot") -> np.ndarray:
    """The bin of each piece, for pieces in the order given."""
    cap = np.array([tokens, documents, cost], np.int64)
    w = np.asarray(weights) / cap.astype(float) ** 2
    out = np.empty(len(sizes), np.int64)
    # open bins only: a bin leaves when it has no room for one more document of the least size to come
    least = np.minimum.accumulate(sizes[::-1])[::-1] if len(sizes) else sizes
    left, name, held = np.empty((64, 3), np.int64), np.empty(64, np.int64), 0
    made = 0
    for i, n in enumerate(sizes):
        need = np.array([n, 1, n * n], np.int64)
        rest = left[:held] - need
        fits = np.flatnonzero((rest >= 0).all(1))
        if len(fits):
            if score == "dot":
                best = fits[np.argmax((left[fits] * (need * w)).sum(1))]
            else:
                best = fits[np.argmin((rest[fits] * rest[fits] * w).sum(1))]
            left[best] -= need
        else:
            if held == len(left):
                left, name = np.concatenate([left, np.empty_like(left)]), np.concatenate([name, np.empty_like(name)])
            best = held
            left[best], name[best] = cap - need, made
            held += 1
            made += 1
        out[i] = name[best]
        nxt = least[i + 1] if i + 1 < len(sizes) else 0
        if (left[best] < (nxt, 1, nxt * nxt)).any():
            # order among the open bins is their age, so later ones move up
            left[best : held - 1], name[best : held - 1] = left[best + 1 : held].copy(), name[best + 1 : held].copy()
            held -= 1
    return out


def lengths(docs: DataFrame) -> DataFrame:
    """doc_id, key, tokens of every row."""
    rows = narrow(docs, "doc_id", "text").select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("key"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = vec.flat(b.column(2))
            n = np.zeros(len(b), np.int64)
            for i, j in vec.chunks(offsets):
                at = offsets[i : j + 1] - offsets[i]
                starts, _ = vec.spans(vec.fold(data[offsets[i] : offsets[j]]), at)
                n[i:j] = np.diff(np.searchsorted(starts, at))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n)], names=["doc_id", "key", "tokens"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, key long, tokens long")


def best_fit(docs: DataFrame, tokens: int = TOKENS, documents: int = DOCUMENTS, cost: int = COST, weights: tuple[float, float, float] = WEIGHTS, score: str = "dot", shard: int = SHARD) -> DataFrame:
    """doc_id, piece, start, tokens, shard, bin: where each piece of each document is packed."""
    most = min(tokens, math.isqrt(cost))
    full = F.floor((F.greatest("tokens", F.lit(1)) - 1) / most)
    sized = cut(lengths(docs).withColumns({"full": full, "row": F.monotonically_increasing_id()}), "lengths")
    shards = max(1, -(-(sized.agg(F.sum(F.col("full") + 1)).first()[0] or 0) // shard))
    kind = sized.schema["doc_id"].dataType.simpleString()
    often = sized.groupBy("key").agg(F.count("*").alias("times")).where(F.col("times") > REPEATED)
    split = sized.join(often, "key", "left").withColumn("salt", F.when(F.col("times").isNotNull(), F.col("row")).otherwise(0))
    pieces = split.select("doc_id", "key", F.explode(F.sequence(F.lit(0).cast("long"), "full")).alias("piece"), "tokens", "full", "salt")
    pieces = pieces.select("doc_id", "key", "piece", (F.col("piece") * most).alias("start"), F.when(F.col("piece") < F.col("full"), F.lit(most).cast("long")).otherwise(F.col("tokens") - F.col("full") * most).alias("tokens"), F.pmod(F.xxhash64("key", "piece", "salt"), F.lit(shards)).alias("shard"))

    def run(table: pa.Table) -> pa.Table:
        t = table.sort_by([("tokens", "descending"), ("doc_id", "ascending"), ("key", "ascending"), ("piece", "ascending")])
        bins = pack(t.column("tokens").to_numpy(), tokens, documents, cost, weights, score)
        return t.drop_columns(["key"]).append_column("bin", pa.array(bins))

    return pieces.groupBy("shard").applyInArrow(run, f"doc_id {kind}, piece long, start long, tokens long, shard long, bin long")
