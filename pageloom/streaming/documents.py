"""Streams of documents: every block-level operator without a page aggregate works on them unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import patterns as p
from ..sources import layout

SCHEMA = "doc_id long, text string"


def stream_blocks(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    """blocks of the parquet documents that arrive in a folder."""
    docs = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return layout.from_documents(docs)


def stream_items(spark: SparkSession, folder: str) -> DataFrame:
    """List items and page numbers, which need no other block of the page."""
    text = F.col("text")
    kind = F.when(text.rlike(p.PAGE_NUMBER), "PageNumber").when(p.list_pattern(text).isNotNull(), "ListItem")
    return stream_blocks(spark, folder).withColumn("element_type", kind).where("element_type is not null")


def write(elements: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends to parquet, each file once, and stops when the folder is read through."""
    return elements.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
