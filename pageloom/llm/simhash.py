"""SimHash near-duplicates found by small-world graphs over Hamming distance.

A document's signature has 256 bits, the signs of the sums over its distinct word pairs (a text of one
word has that word). Documents of equal signature are one node. Two nodes within ``radius`` bits are near
copies, and groups are the connected components of that relation.

Search: each of a number of tables orders all nodes by drawn bits of their signatures and cuts that order
into ranges of about ``SHARD`` nodes, the shards, so that no shard is large, however the signatures lie. A
shard builds a navigable small-world graph of its nodes and takes every one of them as a query, with beams
that expand while they are full of hits (see ``smallworld``). A query is sent to the shards that can be
expected to hold its neighbours, one of each table, instead of to every shard there is: that would cost
shards times documents. A pair at the radius falls into one shard the less often the more nodes there are,
so the number of tables grows with their count: the pair is found with probability ``MEET`` at any count
(``table_count``). All edges are verified by their exact Hamming distance. ``recall_audit`` compares the
groups with exact search.

Defined cases: a null or empty text, or one without words, belongs to no group and is kept. Repeated rows
and equal texts have equal signatures and form a group. Of a group the row with the least doc_id stays
(null ids last, ties by the hash of the row; of wholly repeated rows any one). An empty table gives an
empty table. Further columns pass through ``keep_documents``, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import smallworld, vec
from .common import components, cut, narrow, positional, row_key

RADIUS, SHARD = 60, 1 << 18
#: the probability aimed at that a pair at the radius is found; borders that lie unevenly take a little of it
MEET = 0.97
_SIGNS = ("s0", "s1", "s2", "s3")
_LANES = np.uint64(0x0001000100010001)
_SALTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
_RUN = 1 << 15


def _signs(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(rows, 4) signatures of the hashes of each row; a row without hashes has zeros."""
    sizes = np.diff(bounds)
    rows = np.flatnonzero(sizes)
    out = np.zeros((len(sizes), 4), np.uint64)
    if not len(rows):
        return out
    # sums run in 16-bit lanes, so a long row is summed in runs
    runs = -(-sizes[rows] // _RUN)
    owner = np.repeat(np.arange(len(rows)), runs)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs)
    starts = bounds[rows][owner] + at * _RUN
    first = np.cumsum(runs) - runs
    for w in range(4):
        x = vec.mix(h ^ _SALTS[w])
        bits = np.zeros((len(rows), 64), np.uint8)
        for k in range(16):
            lanes = np.add.reduceat((x >> np.uint64(k)) & _LANES, starts).view(np.uint16).reshape(-1, 4).astype(np.int64)
            total = np.add.reduceat(lanes, first, axis=0)
            bits[:, k::16] = 2 * total > sizes[rows][:, None]
        out[rows, w] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def signature(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Signatures (rows, 4) and the number of features of each row."""
    data, offsets = vec.flat(column)
    sig, count = np.zeros((len(offsets) - 1, 4), np.uint64), np.zeros(len(offsets) - 1, np.int64)
    for i, j in vec.chunks(offsets):
        h, _, bounds = vec.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        g, gb = vec.grams(h, bounds, 2)
        row = np.repeat(np.arange(j - i), np.diff(gb))
        # distinct pairs of a row: 42 bits of the pair below the row's number
        key = np.unique((row.astype(np.uint64) << np.uint64(42)) | (g >> np.uint64(22)))
        of = (key >> np.uint64(42)).astype(np.int64)
        sizes = np.bincount(of, minlength=j - i)
        sig[i:j] = _signs(key & np.uint64((1 << 42) - 1), np.r_[0, np.cumsum(sizes)])
        count[i:j] = sizes
    return sig, count


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, key and the four signature words of every document that has words."""
    rows = narrow(docs, "doc_id", "text").select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("key"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig, count = signature(b.column(2))
            words = [pa.array(np.ascontiguousarray(sig[:, w]).view(np.int64)) for w in range(4)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *words], names=["doc_id", "key", *_SIGNS]).filter(pa.array(count > 0))

    return rows.mapInArrow(run, f"doc_id {kind}, key long, s0 long, s1 long, s2 long, s3 long")


def meeting(count: int, radius: int = RADIUS, shard: int = SHARD) -> float:
    """The probability that a pair at the radius falls into one shard of a table.

    Signatures that agree in the first k drawn bits and differ in the next stand about count / 2^(k+1) places
    apart, and a range's border falls between them with that probability times 1 / shard.
    """
    if count <= shard:
        return 1.0
    agree = [smallworld.agreeing(k, radius) for k in range(65)]
    return sum((agree[k] - agree[k + 1]) * max(0.0, 1 - count / shard / 2 ** (k + 1)) for k in range(64)) + agree[64]


def table_count(count: int, radius: int = RADIUS, shard: int = SHARD) -> int:
    """The tables after which a pair at the radius is missed in all with probability 1 - MEET; two at least."""
    return max(2, math.ceil(math.log(1 - MEET) / math.log(1 - smallworld.FOUND * meeting(count, radius, shard))))


def near_edges(nodes: DataFrame, count: int, radius: int = RADIUS, tables: int | None = None, shard: int = SHARD) -> DataFrame:
    """Verified edges (a, b) between the nodes: of each shard a spanning forest of its groups."""
    tables = tables or table_count(count, radius, shard)
    rng = np.random.default_rng(11)
    picks = [rng.permutation(256)[:63] for _ in range(tables)]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = np.stack([b.column(k).to_numpy() for k in range(1, 5)], axis=1).view(np.uint64)
            for t, at in enumerate(smallworld.places(sig, picks)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), t, np.int32)), pa.array(at.view(np.int64)), *b.columns], names=["t", "place", "node", *_SIGNS])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        table = pa.Table.from_batches(held)
        t, node = table.column("t").to_numpy(), table.column("node").to_numpy()
        sig = np.stack([table.column(s).to_numpy() for s in _SIGNS], axis=1).view(np.uint64)
        for k in np.unique(t):  # a range may hold the end of one table and the start of the next
            o = np.flatnonzero(t == k)
            o = o[np.argsort(node[o], kind="stable")]
            root = smallworld.neighbours(sig[o], radius, int(k)).all()
            tied = np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays([pa.array(node[o[tied]]), pa.array(node[o[root[tied]]])], names=["a", "b"])

    routed = nodes.select("node", *_SIGNS).mapInArrow(route, "t int, place long, node long, s0 long, s1 long, s2 long, s3 long")
    shards = tables * max(1, math.ceil(count / shard))
    return routed.repartitionByRange(shards, "t", "place", "node").mapInArrow(search, "a long, b long")


def members(docs: DataFrame, radius: int = RADIUS, tables: int | None = None, shard: int = SHARD) -> DataFrame:
    """doc_id, key, group: every document with words, under its group's number."""
    rows = cut(signatures(docs).withColumn("node", F.xxhash64(*_SIGNS)), "signatures")
    nodes = cut(rows.select("node", *_SIGNS).distinct(), "nodes")
    edges = near_edges(nodes, nodes.count(), radius, tables, shard)
    return rows.select("doc_id", "key", "node").join(components(edges), "node", "left").select("doc_id", "key", F.coalesce("root", "node").alias("group"))


def _decided(docs: DataFrame, **search: int) -> DataFrame:
    """The rows of groups of two or more, with the group's keeper."""
    rows = cut(members(docs, **search), "members")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    keepers = rows.groupBy("group").agg(F.count("*").alias("size"), first.alias("k")).where("size > 1")
    return rows.join(keepers, "group").select("doc_id", "key", F.col("k.doc_id").alias("kept_id"), F.col("k.key").alias("kept_key"))


def near_duplicates(docs: DataFrame, **search: int) -> DataFrame:
    """doc_id, kept_id: each document that a group loses, and the one that stays in its place."""
    rows = _decided(docs, **search)
    again = rows.groupBy("key", "doc_id", "kept_id", "kept_key").agg(F.count("*").alias("n"))
    lost = again.select("doc_id", "kept_id", (F.col("n") - (F.col("key") == F.col("kept_key")).cast("long")).alias("n")).where("n > 0")
    return lost.select("doc_id", "kept_id", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).select("doc_id", "kept_id")


def keep_documents(docs: DataFrame, **search: int) -> DataFrame:
    """One document of each group and all that are in none, with all their columns."""
    rows = _decided(docs, **search)
    act = cut(rows.groupBy("key").agg(F.count("*").alias("n"), F.max(F.col("key") == F.col("kept_key")).alias("stays")).where("not stays or n > 1"), "acts")
    wide = positional(docs)
    id_, text = (F.col(f"c{docs.columns.index(n)}") for n in ("doc_id", "text"))
    keyed = wide.withColumn("key", row_key(id_, text))
    kept = keyed.join(act.select("key"), "key", "left_anti")
    again = act.where("stays").select("key")
    if not again.isEmpty():  # wholly repeated rows of which one stays
        kept = kept.unionByName(keyed.join(again, "key", "left_semi").dropDuplicates(["key"]))
    return kept.drop("key").toDF(*docs.columns)


def recall_audit(docs: DataFrame, radius: int = RADIUS, **search: int) -> DataFrame:
    """pairs, found: node pairs within the radius by exact search, and those of them that share a group.

    Compares every two signatures (a cross join), so it is for samples and tests, not for a corpus.
    """
    rows = cut(signatures(docs).withColumn("node", F.xxhash64(*_SIGNS)), "audit")
    nodes = rows.select("node", *_SIGNS).distinct()
    groups = members(docs, radius, **search).join(rows.select("key", "node").distinct(), "key").select("node", "group").distinct()
    left = nodes.join(groups, "node")
    right = left.toDF(*[f"{c}_" for c in left.columns])
    far = sum((F.bit_count(F.col(s).bitwiseXOR(F.col(f"{s}_"))) for s in _SIGNS), F.lit(0))
    return left.join(right, (F.col("node") < F.col("node_")) & (far <= radius)).agg(F.count("*").alias("pairs"), F.count_if(F.col("group") == F.col("group_")).alias("found"))
