"""S11/U2/U3/U4 on a store: messages in hash buckets of the chat id, in committed versions.

Layout below ``path`` (a shared folder)::

    messages/load=<id>/bucket=<n>/...   rows of one append or rewrite
    versions/<number>.json              the loads of every bucket, and the last batch of every source

The version file is written last (:mod:`docquery.operators.store`), so a write killed before it changes nothing and a reader
stays with the version it opened.  There is a fixed number of buckets, however many chats there are.

* An append names its source and a batch number.  A batch that is not above the last one of its source has been
  committed before, so a repeated append changes nothing.
* Renaming and deleting rewrite the buckets of the chats concerned (copy on write) and no others.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquery.functions.vectors import with_embedding
from docquery.operators import store as ST

BUCKETS = 64
MESSAGE = ("chat_id string, id string, datetime timestamp_ntz, summary string, prompt string, response string, "
           "prompt_vector array<struct<b:int,c:int>>, prompt_norm2 bigint")


def bucket(chat_id: str) -> Column:
    return F.pmod(F.xxhash64(chat_id), F.lit(BUCKETS)).cast("int")


@dataclass(frozen=True)
class Messages:
    """One committed version."""

    spark: SparkSession
    path: str
    version: int
    buckets: dict  # bucket -> loads that hold its rows
    applied: dict  # source -> its last committed batch

    def rows(self, buckets: set[int] | None = None) -> DataFrame:
        """Messages of the given buckets, or all; only their folders are read."""
        named = sorted(b for b in self.buckets if buckets is None or b in buckets)
        folders = [f"{self.path}/messages/load={load}/bucket={b}" for b in named for load in self.buckets[b]]
        schema = f"{MESSAGE}, load string, bucket int"
        if not folders:
            return self.spark.createDataFrame([], schema).drop("load", "bucket")
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/messages").parquet(*folders)
        return rows.where(F.col("bucket").isin(*named)).drop("load", "bucket")

    def of_chats(self, chats: DataFrame) -> DataFrame:
        """Messages of the listed chats (``chat_id``), from their buckets alone."""
        return self.rows(_buckets_of(chats)).join(chats.select("chat_id").distinct(), "chat_id", "left_semi")


def _buckets_of(chats: DataFrame, column: str = "chat_id") -> set[int]:
    """Buckets of a table of chats: at most ``BUCKETS`` numbers come to the driver."""
    return {r["b"] for r in chats.select(bucket(column).alias("b")).distinct().collect()}


def open_messages(spark: SparkSession, path: str, version: int | None = None) -> Messages:
    """The newest committed version, or the one given; an empty store if there is none yet."""
    path = path.rstrip("/")
    there = ST.versions(spark, path)
    if version is not None and version not in there:
        raise ValueError(f"version {version} is not committed in {path}")
    if not there:
        return Messages(spark, path, 0, {}, {})
    content = ST.read_version(spark, path, there[-1] if version is None else version)
    return Messages(spark, path, content["version"], {int(b): v for b, v in content["buckets"].items()}, content["applied"])


def _write(spark: SparkSession, rows: DataFrame, path: str) -> tuple[str, list[int]]:
    """Write one load; its id and the buckets that have rows in it.  ``rebalance`` gathers a bucket's rows in few files and
    lets adaptive execution split a bucket that holds a hot chat."""
    load = uuid.uuid4().hex
    folder = f"{path}/messages/load={load}"
    rows.withColumn("bucket", bucket("chat_id")).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(folder)
    return load, [b for b in range(BUCKETS) if ST.exists(spark, f"{folder}/bucket={b}")]


def _commit(old: Messages, buckets: dict, applied: dict) -> Messages:
    content = {"version": old.version + 1, "buckets": {b: v for b, v in buckets.items() if v}, "applied": applied}
    ST.commit(old.spark, old.path, old.version + 1, content)
    return open_messages(old.spark, old.path, old.version + 1)


def append(spark: SparkSession, messages: DataFrame, path: str, source: str, batch: int) -> Messages:
    """Append a batch of message rows; a batch that its source has committed before is left out.

    The timestamp is cut to milliseconds (P19) and the vector of the prompt is stored with the row, so the
    nearest-prompt search need not embed stored prompts again.  Rows without a chat are stored under the null chat."""
    path, load = path.rstrip("/"), None
    while True:
        old = open_messages(spark, path)
        if batch <= old.applied.get(source, -1):
            return old
        if load is None:
            rows = with_embedding(messages.withColumn("datetime", F.date_trunc("MILLISECOND", "datetime").cast("timestamp_ntz")),
                                  "prompt", "prompt_vector", "prompt_norm2")
            load, filled = _write(spark, rows.select(*[c.split()[0] for c in MESSAGE.split(", ")]), path)
        try:
            return _commit(old, {**old.buckets, **{b: [*old.buckets.get(b, []), load] for b in filled}}, {**old.applied, source: batch})
        except ST.CommitConflict:
            continue  # another writer was faster: the rows are written, only the version is made again


def _rewrite(spark: SparkSession, path: str, chats: DataFrame, change: Callable[[DataFrame], DataFrame]) -> Messages:
    """Commit a version in which the buckets of ``chats`` hold ``change`` of their rows; changed rows may move to other buckets."""
    path = path.rstrip("/")
    while True:
        old = open_messages(spark, path)
        touched = _buckets_of(chats) & set(old.buckets)
        if not touched:
            return old
        load, filled = _write(spark, change(old.rows(touched)), path)
        buckets = {b: v for b, v in old.buckets.items() if b not in touched}
        for b in filled:
            buckets[b] = [*buckets.get(b, []), load]
        try:
            return _commit(old, buckets, old.applied)
        except ST.CommitConflict:
            continue  # the rows may have changed: rewrite the newest version


def rename(spark: SparkSession, path: str, renames: DataFrame) -> Messages:
    """U2 on the store: ``renames(chat_id, new_chat_id, new_summary)``; ids, timestamps, texts and vectors are kept."""
    r = renames.select(F.col("chat_id").alias("old_id"), "new_chat_id", "new_summary")

    def change(rows: DataFrame) -> DataFrame:
        moved = F.col("old_id").isNotNull()
        out = rows.join(r, F.col("chat_id") == F.col("old_id"), "left")
        return out.select(F.when(moved, F.col("new_chat_id")).otherwise(F.col("chat_id")).alias("chat_id"), "id", "datetime",
                          F.when(moved, F.col("new_summary")).otherwise(F.col("summary")).alias("summary"),
                          "prompt", "response", "prompt_vector", "prompt_norm2")

    return _rewrite(spark, path, renames, change)


def delete(spark: SparkSession, path: str, deletions: DataFrame) -> Messages:
    """U3 on the store: the listed chats (``chat_id``) lose every row."""
    return _rewrite(spark, path, deletions, lambda rows: rows.join(deletions.select("chat_id").distinct(), "chat_id", "left_anti"))


def delete_all(spark: SparkSession, path: str) -> Messages:
    """U4 on the store: a version without rows; sources keep their last batch, so old batches do not come back."""
    while True:
        old = open_messages(spark, path)
        try:
            return _commit(old, {}, old.applied)
        except ST.CommitConflict:
            continue
