"""Sharding by longest-processing-time scheduling.

Documents of one group stay together. Groups, by falling size, go to the least-loaded shard through a heap
(ties: the smaller group key first, the lower shard number first). Group sizes are aggregated in Spark and
come to the driver as a histogram, one row for each distinct size: groups of equal size are alike to the
scheduler, and a run of them over levelled shards is dealt round by round, so the driver's work follows the
number of distinct sizes and shards, not the number of groups or documents. That number is at most the square
root of twice the bytes of text; the histogram is read as a stream and the plan written in parts of ``PART``
rows, so the driver holds one part. Groups of one size are numbered over sorted ranges, so a size that very
many groups share isn't one task's.

Defined cases: a null group value is a group of its own; null and empty texts have size 0; repeated rows
count each; with fewer groups than shards some shards stay empty; an empty table gives an empty table;
other columns are not read.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterable, Iterator
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, narrow, shared_dir

SHARDS, PART = 16, 1 << 16
_RUN = "size long, first long, last long, order array<int>"


def schedule(histogram: Iterable[tuple[int, int]], shards: int) -> Iterator[tuple[int, int, int, list[int]]]:
    """(size, first, last, order) for sizes by falling order: the k-th group of a size, first <= k <= last,
    goes to ``order[(k - first) % len(order)]``."""
    heap = [(0, s) for s in range(shards)]
    for size, count in histogram:
        at = 0
        while at < count:
            if size == 0:
                yield size, at, count - 1, [heap[0][1]]  # adding nothing leaves the same shard least
                break
            load, s = heap[0]
            level: list[tuple[int, int]] = []
            while heap and heap[0][0] < load + size:
                level.append(heapq.heappop(heap))
            # the shards of this level are dealt to in rounds until another one is as low
            rounds = (heap[0][0] - level[-1][0]) // size if heap else (count - at) // len(level)
            rounds = max(1, min(rounds, (count - at) // len(level)))
            take = min(rounds * len(level), count - at)
            # in a round's course no other shard may come first
            if heap and rounds == 1:
                fit = [x for x in level if x < heap[0]]
                take = min(take, len(fit))
            order = [x[1] for x in level]
            yield size, at, at + take - 1, order[: min(take, len(order))]
            for i, (was, n) in enumerate(level):
                heapq.heappush(heap, (was + size * (take // len(level) + (i < take % len(level))), n))
            at += take


def _table(spark: SparkSession, plan: Iterator[tuple[int, int, int, list[int]]]) -> DataFrame:
    """The plan as a table; where it has several parts they are written to the shared folder one by one."""
    part = list(islice(plan, PART))
    if len(part) < PART:
        return spark.createDataFrame(part, _RUN)
    path = f"{shared_dir(spark)}/pageloom-{uuid.uuid4().hex}-plan"
    while part:
        spark.createDataFrame(part, _RUN).write.mode("append").parquet(path)
        part = list(islice(plan, PART))
    return spark.read.schema(_RUN).parquet(path)


def _numbered(groups: DataFrame) -> DataFrame:
    """The groups with k, their place (from 0) among those of their size by group key."""
    ordered = groups.repartitionByRange("size", F.col("group").asc_nulls_last()).sortWithinPartitions("size", F.col("group").asc_nulls_last())
    ordered = cut(ordered.withColumn("range", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "groups")
    # of one size and range the rows stand in a row; one size has a row here for each of its ranges
    each = ordered.groupBy("size", "range").agg(F.count("*").alias("n"), F.min("at").alias("begin"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("size").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    each = each.select("size", "range", (before - F.col("begin")).alias("shift"))
    return ordered.join(each, ["size", "range"]).select("group", "size", "n_docs", (F.col("at") + F.col("shift")).alias("k"))


def shard_groups(docs: DataFrame, by: str = "source", shards: int = SHARDS) -> DataFrame:
    """group, size (bytes of text), n_docs, shard of every group."""
    rows = narrow(docs, by, "text").toDF("group", "text")
    groups = rows.groupBy("group").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).cast("long").alias("size"), F.count("*").alias("n_docs"))
    ranked = _numbered(groups)
    histogram = ranked.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("size"))
    runs = _table(docs.sparkSession, schedule(((r["size"], r["n"]) for r in histogram.toLocalIterator()), shards))
    placed = ranked.join(runs.withColumnRenamed("size", "s"), (F.col("size") == F.col("s")) & F.col("k").between(F.col("first"), F.col("last")))
    return placed.select("group", "size", "n_docs", F.get("order", ((F.col("k") - F.col("first")) % F.size("order")).cast("int")).alias("shard"))


def shard_documents(docs: DataFrame, by: str = "source", shards: int = SHARDS) -> DataFrame:
    """doc_id, group, shard of every document."""
    placed = shard_groups(docs, by, shards).select(F.col("group").alias("g"), "shard")
    rows = narrow(docs, "doc_id", by).toDF("doc_id", "group")
    return rows.join(placed, F.col("group").eqNullSafe(F.col("g"))).select("doc_id", "group", "shard")
