"""Structured Streaming form of source ingest (S1/S2/S4 → P1–P4): text files arriving in a folder are
chunked and appended to the chunk store, partitioned by context.

Exactly-once through the file sink's commit log; the checkpoint location must be a shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docquery.functions.text import source_kind, split_author
from docquery.operators.chunk import flatten_sources
from docquery.sources.text import markdown_text


def text_file_stream(spark: SparkSession, folder: str, context_id: str) -> DataFrame:
    """Whole text files of ``folder`` as a stream of page rows (title/author from the file name)."""
    raw = (spark.readStream.format("text").option("wholetext", "true").load(folder)
                # the file path arrives URI-encoded; decode it (a literal "+" stays "+")
                .withColumn("path", F.expr("url_decode(replace(_metadata.file_path, '+', '%2B'))")))
    kind = source_kind(F.col("path"))
    ta = split_author(F.col("path"), kind)
    return (raw.where(kind.isin(".txt", ".md"))
               .select(F.lit(context_id).alias("context_id"), ta["title"].alias("title"),
                       ta["author"].alias("author"), F.lit(0).alias("chapter"), F.lit("None").alias("chapter_title"),
                       F.lit(0).alias("page_number"), F.lit(context_id).alias("subject"),
                       F.when(kind == ".md", markdown_text(F.col("value"))).otherwise(F.col("value")).alias("text"), F.col("path").alias("source_key")))


def start_ingest(spark: SparkSession, folder: str, context_id: str, store: str, checkpoint: str,
                 available_now: bool = True) -> StreamingQuery:
    """Chunk every new file and append it to ``store`` (parquet, partitioned by ``context_id``)."""
    chunks = flatten_sources(text_file_stream(spark, folder, context_id))
    w = (chunks.writeStream.format("parquet").option("path", store).option("checkpointLocation", checkpoint)
               .partitionBy("context_id").outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
