"""S1/S4/P1 on files in a folder, in batch: chunks of one huge text file come from many tasks.

Spark's text source cuts a file into splits and gives each its whole lines, so no task holds a file.  What a split cannot
know is where its text stands in the file.  That comes from sums: lines get their place inside the split while it is read,
one row per split gives its characters, and the running sum over a file's splits (a window over split counts, not
lines) places every split.  A line is then cut at the chunk borders it crosses, and a chunk is put together from the pieces
of its range, at most ``size`` characters.

Only ``\\n`` ends a line here, and the file's own size tells whether the last line ends with one, so the chunks are those of
the whole text.  A byte order mark at the start of a file is dropped.  An empty file has no chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquery import config as C
from docquery.functions.text import source_kind, split_author
from docquery.session import broadcast_if_small, cut_lineage

TEXT_KINDS = (".txt", ".md")


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``path, size, split, line, chars, at``: the lines of every text file of the folder; ``at`` = characters of its split
    before the line."""
    lines = spark.read.option("lineSep", "\n").text(folder).select(
        F.expr("url_decode(replace(_metadata.file_path, '+', '%2B'))").alias("path"), F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("split"), F.col("value").alias("line"), (F.char_length("value") + 1).cast("long").alias("chars"))
    lines = lines.where(source_kind(F.col("path")).isin(*TEXT_KINDS))

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        last, before = None, 0  # the split that is being read, and its characters so far
        for b in batches:
            if not b.num_rows:
                continue
            keys = list(zip(b.column("path").to_pylist(), b.column("split").to_pylist()))
            chars = b.column("chars").to_numpy()
            ends = np.cumsum(chars)
            new = np.array([k != p for k, p in zip(keys, [last, *keys])])
            # characters of the batch before the split that the row belongs to (before the batch, for one that goes on)
            first = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
            base = np.where(np.maximum.accumulate(new), ends[first] - chars[first], -before)
            at = ends - chars - base
            last, before = keys[-1], int(at[-1] + chars[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int64())], names=[*b.schema.names, "at"])

    return lines.mapInArrow(place, "path string, size long, split long, line string, chars long, at long")


def file_chunks(spark: SparkSession, folder: str, size: int = C.CHUNK_SIZE) -> DataFrame:
    """``path, chunk_number, chunk_text`` of every ``.txt`` and ``.md`` file of a folder (Markdown as written); ``chunk_number`` is the
    character offset, as in :func:`docquery.operators.chunk.explode_chunks`."""
    lines = read_lines(spark, folder)
    splits = cut_lineage(lines.groupBy("path", "split").agg(F.sum("chars").alias("chars"), F.sum(F.octet_length("line") + 1).alias("bytes"),
                                                            F.max("size").alias("size"), F.max("at").alias("last")))
    by_file = Window.partitionBy("path")
    # bytes of lines with their newlines: one more than the file has if its last line ends without one
    splits = splits.select("path", "split", "last", (F.sum("chars").over(by_file.orderBy("split")) - F.col("chars")).alias("base"),
                           (F.max("split").over(by_file) == F.col("split")).alias("final"), (F.sum("bytes").over(by_file) > F.col("size")).alias("open_end"))
    placed = lines.join(broadcast_if_small(cut_lineage(splits)), ["path", "split"])
    no_newline = F.col("final") & F.col("open_end") & (F.col("at") == F.col("last"))
    text = F.when(no_newline, F.col("line")).otherwise(F.concat("line", F.lit("\n")))
    placed = placed.select("path", (F.col("base") + F.col("at")).alias("start"), text.alias("text")).where("text != ''")
    first = F.floor(F.col("start") / size)
    last = F.floor((F.col("start") + F.char_length("text") - 1) / size)
    pieces = placed.select("path", "start", "text", F.explode(F.sequence(first, last)).alias("no"))
    low = F.greatest(F.col("start"), F.col("no") * size)
    cut = F.substring("text", (low - F.col("start") + 1).cast("int"), (F.least(F.col("start") + F.char_length("text"), (F.col("no") + 1) * size) - low).cast("int"))
    return (pieces.select("path", "no", F.struct(low.alias("low"), cut.alias("text")).alias("piece"))
                  .groupBy("path", "no").agg(F.sort_array(F.collect_list("piece")).alias("p"))
                  .select("path", (F.col("no") * size).alias("chunk_number"), F.array_join(F.transform("p", lambda x: x["text"]), "").alias("chunk_text")))


def folder_chunks(spark: SparkSession, folder: str, context_id: str, size: int = C.CHUNK_SIZE) -> DataFrame:
    """Chunk rows of a folder of text files, ready for :func:`docquery.operators.store.load_contexts`."""
    from docquery.operators.chunk import CHUNK_COLUMNS, chunk_id
    from docquery.functions.text import strip_all

    rows = file_chunks(spark, folder, size)
    ta = split_author(F.col("path"), source_kind(F.col("path")))
    rows = rows.select("path", F.lit(context_id).alias("context_id"), strip_all(ta["title"]).alias("title"), ta["author"].alias("author"), F.lit(0).alias("chapter"),
                       F.lit(C.NO_CHAPTER_TITLE).alias("chapter_title"), F.lit(0).alias("page_number"), F.col("chunk_number").cast("long").alias("chunk_number"),
                       "chunk_text", F.lit(context_id).alias("subject"))
    return rows.withColumn("chunk_id", chunk_id(source_key="path")).select(*CHUNK_COLUMNS)
