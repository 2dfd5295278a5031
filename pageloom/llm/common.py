"""Column picking, intermediate tables and small helpers for the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def narrow(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, taken by position: further columns may clash in name or case."""
    at = [df.columns.index(n) for n in names]
    out = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return out.select(*[F.col(f"c{i}").alias(n) for i, n in zip(at, names)])


def positional(df: DataFrame) -> DataFrame:
    """The same rows with columns c0, c1, ...; give the names back with ``toDF(*df.columns)``."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only in local mode, where the session names none.

    A cluster must name its folder, as executors don't see each other's temporary files.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that the executors of {sc.master} share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="pageloom-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, which ends its lineage.

    The files outlive the loss of any executor. They are removed when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pageloom-{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the JVM may be gone at exit; the shared folder is the cluster's to clean
        pass


def text_key() -> Column:
    """64 bits of the text; null and empty texts are told apart."""
    return F.xxhash64(F.col("text"), F.col("text").isNull())


def row_key(doc_id: Column, text: Column) -> Column:
    """64 bits that tell rows apart by id and text; repeated rows share them."""
    return F.xxhash64(doc_id, doc_id.isNull(), text, text.isNull())


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the edges (a, b): rows (node, root), the root being the least node.

    Alternating large-star and small-star rounds; each round is written to the shared folder, so neither
    lineage nor driver memory grows. Rounds are logarithmic in the longest chain in practice.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("m", "u").alias("m"))
        large = both.join(least, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down.withColumnRenamed("u", "k"), F.col("u") == F.col("k")).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
        now = cut(small.select("e.u", "e.v").where("u <> v").distinct(), "stars")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = seen
