"""The chunk store and its search index, kept by context, in committed versions.

Layout below ``path`` (a shared folder)::

    chunks/load=<id>/context_id=<id>/...       rows of one load of one context, each with the distinct tokens of its text
                                               (the tables "chunks" and "postings": chunk_id, tokens)
    twice/load=<id>/context_id=<id>/...        ids that more than one chunk of the load has
    vocabulary/load=<id>/context_id=<id>/...   token, df (chunks that hold it)
    grams/load=<id>/context_id=<id>/...        gram, n (occurrences in the context's vocabulary)
    versions/<number>.json                     which load serves which context

A load writes its folders under a new id and then one small version file, last, by a rename that fails
if the number is taken.  Until that rename nobody sees the new rows: a load killed before it leaves the last version as
it was, and two loads that race cannot both commit the same number (the later one takes the next version
and keeps the other's contexts).  A reader is pinned to the version it opened: later loads only add folders, and
:func:`vacuum` removes what no kept version names.  Only the loaded contexts are written; the others keep their folders.

Version files hold one entry per context (load id, number of chunks, tables with rows), never rows.  Reading goes through Spark
with ``context_id`` as a partition column, so a search in some contexts lists and reads only those.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquery.functions.vectors import tokens
from docquery.operators.contexts import delete_contexts
from docquery.operators.match import gram_counts, vocabulary
from docquery.operators.scan import shared_ids, whole_chunks
from docquery.session import cut_lineage, shuffles_dropped

TABLES = ("chunks", "postings", "vocabulary", "grams")
FOLDERS = {"chunks": "chunks", "postings": "chunks", "twice": "twice", "vocabulary": "vocabulary", "grams": "grams"}  # tokens lie in the row of their text
DERIVED = {
    "twice": "chunk_id string",
    "postings": "chunk_id string, tokens array<string>",
    "vocabulary": "token string, df long",
    "grams": "gram string, n long",
}


class CommitConflict(RuntimeError):
    """The version number was committed by another load."""


# ---------------------------------------------------------------- version files
def _hadoop_path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _file_context(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = _hadoop_path(spark, path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    qualified = p.getFileSystem(conf).makeQualified(p)
    return jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified.toUri(), conf)


def _escaped(spark: SparkSession, value: str) -> str:
    """A partition value as Spark's writer names its folder."""
    return spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)


def exists(spark: SparkSession, path: str) -> bool:
    p = _hadoop_path(spark, path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Committed version numbers, ascending."""
    folder = _hadoop_path(spark, f"{path}/versions")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json"))


def read_version(spark: SparkSession, path: str, number: int) -> dict:
    p = _hadoop_path(spark, f"{path}/versions/{number:012d}.json")
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode("utf-8"))
    finally:
        stream.close()


def commit(spark: SparkSession, path: str, number: int, content: dict) -> None:
    """Write the version file beside its place, then rename it there; a taken number is a conflict."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    target = _hadoop_path(spark, f"{path}/versions/{number:012d}.json")
    draft = _hadoop_path(spark, f"{path}/versions/_{uuid.uuid4().hex}.draft")
    fs = target.getFileSystem(conf)
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(content, sort_keys=True).encode("utf-8")))
    out.close()
    if fs.exists(target):
        fs.delete(draft, False)
        raise CommitConflict(str(number))
    none = jvm.java.lang.reflect.Array.newInstance(jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
    try:
        _file_context(spark, path).rename(fs.makeQualified(draft), fs.makeQualified(target), none)
    except Exception as e:
        fs.delete(draft, False)
        if "FileAlreadyExists" in str(e):
            raise CommitConflict(str(number)) from e
        raise


# ---------------------------------------------------------------- readers
@dataclass(frozen=True)
class Store:
    """One committed version: ``contexts`` maps a context to its load and its number of chunks."""

    spark: SparkSession
    path: str
    version: int
    contexts: dict
    schema: str

    def table(self, name: str, context_ids: list[str] | None = None) -> DataFrame:
        """Rows of a table, of the given contexts or of all; only their folders are read."""
        named = self._named(name, context_ids)
        return self._rows(name, self.schema if name == "chunks" else DERIVED[name], named)

    def _named(self, name: str, context_ids: list[str] | None) -> list[str]:
        return sorted(c for c in (self.contexts if context_ids is None else set(context_ids)) if name in self.contexts.get(c, {}).get("tables", ()))

    def _rows(self, name: str, columns: str, named: list[str]) -> DataFrame:
        own = T._parse_datatype_string(columns)
        schema = T.StructType([*own.fields, T.StructField("load", T.StringType()), T.StructField("context_id", T.StringType())])
        if not named:
            return self.spark.createDataFrame([], schema).drop("load")
        base = f"{self.path}/{FOLDERS[name]}"
        folders = [f"{base}/load={self.contexts[c]['load']}/context_id={_escaped(self.spark, c)}" for c in named]
        rows = self.spark.read.schema(schema).option("basePath", base).parquet(*folders)
        return rows.where(F.col("context_id").isin(*named)).drop("load")

    def whole_chunks(self, context_ids: list[str] | None = None) -> DataFrame:
        """``context_id, chunk_id, tokens, texts`` of the contexts, one row per chunk (:func:`docquery.operators.scan.whole_chunks`)."""
        rows = self._rows("chunks", "chunk_id string, chunk_text string, tokens array<string>", self._named("chunks", context_ids))
        return whole_chunks(rows, self.table("twice", context_ids))

    def postings(self, context_ids: list[str] | None = None) -> DataFrame:
        """``context_id, chunk_id, token`` of the contexts: one row per distinct token of a chunk, the rows of a chunk in one task."""
        return self.table("postings", context_ids).repartition("chunk_id").select("context_id", "chunk_id", F.explode("tokens").alias("token"))

    def vocabulary(self, context_ids: list[str] | None = None) -> DataFrame:
        """Distinct tokens of the contexts, spread over tasks and stored for the joins of one batch."""
        return cut_lineage(vocabulary(self.table("vocabulary", context_ids)))

    def gram_counts(self, context_ids: list[str] | None = None) -> DataFrame:
        return self.table("grams", context_ids).groupBy("gram").agg(F.sum("n").alias("n"))

    def n_chunks(self, context_ids: list[str] | None = None) -> int:
        """Chunks of the contexts, from the version file."""
        return sum(v["chunks"] for c, v in self.contexts.items() if context_ids is None or c in context_ids)

    def asked(self, queries: DataFrame) -> list[str] | None:
        """The stored contexts that a table of queries names; None (all of them) if some query names none.

        At most one value per stored context comes to the driver."""
        known = self.spark.createDataFrame([(c,) for c in self.contexts], "context_id string")
        if not queries.where("context_id IS NULL").isEmpty():
            return None
        return sorted(r["context_id"] for r in queries.select("context_id").distinct().join(known, "context_id").collect())


def open_store(spark: SparkSession, path: str, version: int | None = None) -> Store:
    """The newest committed version, or the one given; an empty store if there is none yet."""
    path = path.rstrip("/")
    there = versions(spark, path)
    if version is not None and version not in there:
        raise ValueError(f"version {version} is not committed in {path}")
    if not there:
        return Store(spark, path, 0, {}, "chunk_id string")
    content = read_version(spark, path, there[-1] if version is None else version)
    return Store(spark, path, content["version"], content["contexts"], content["schema"])


# ---------------------------------------------------------------- loads
def _publish(spark: SparkSession, path: str, change: dict, schema: str | None) -> Store:
    """Commit a version in which ``change`` (context -> entry, or None to drop it) is applied to the newest one."""
    while True:
        old = open_store(spark, path)
        contexts = {**old.contexts, **change}
        content = {"version": old.version + 1, "schema": schema or old.schema, "contexts": {c: v for c, v in contexts.items() if v}}
        try:
            commit(spark, path, old.version + 1, content)
            return open_store(spark, path, old.version + 1)
        except CommitConflict:
            continue  # another load took the number: apply the change to what it left


def _schema_text(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != "context_id")


def load_contexts(spark: SparkSession, chunks: DataFrame, path: str, context_ids: list[str] | None = None) -> Store:
    """Replace the named contexts by their rows in ``chunks``, and build their part of the index.

    ``context_ids`` is the short list of contexts being (re)loaded, a parameter; by default those that ``chunks`` holds.  A named
    context without rows becomes empty, every other one keeps its folders.  Rows without a context belong to no
    context and are not stored.  Texts are tokenised once, here.
    """
    path, load = path.rstrip("/"), uuid.uuid4().hex
    folder = {t: f"{path}/{f}/load={load}" for t, f in FOLDERS.items()}
    own = chunks.where("context_id IS NOT NULL")
    if context_ids is not None:
        own = own.where(F.col("context_id").isin(*context_ids)) if context_ids else own.limit(0)
    own = own.withColumn("tokens", F.array_distinct(tokens(F.col("chunk_text"))))
    own.write.partitionBy("context_id").option("compression", "zstd").parquet(folder["chunks"])
    string = "context_id string"
    post = spark.read.schema(f"{DERIVED['postings']}, {string}").parquet(folder["postings"])
    with shuffles_dropped(spark):
        shared_ids(post).write.partitionBy("context_id").parquet(folder["twice"])
    by_context = post.select("context_id", F.explode("tokens").alias("token")).groupBy("context_id", "token").agg(F.count(F.lit(1)).alias("df"))
    with shuffles_dropped(spark):
        by_context.select("token", "df", "context_id").write.partitionBy("context_id").parquet(folder["vocabulary"])
    vocab = spark.read.schema(f"{DERIVED['vocabulary']}, {string}").parquet(folder["vocabulary"])
    with shuffles_dropped(spark):
        gram_counts(vocab, ["context_id"]).select("gram", "n", "context_id").write.partitionBy("context_id").parquet(folder["grams"])
    counts = {r["context_id"]: r["n"] for r in post.groupBy("context_id").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per loaded context
    entry = lambda c: {"load": load, "chunks": counts.get(c, 0), "tables": [t for t in FOLDERS if exists(spark, f"{folder[t]}/context_id={_escaped(spark, c)}")]}
    return _publish(spark, path, {c: entry(c) for c in (counts if context_ids is None else context_ids)}, _schema_text(chunks))


def drop_contexts(spark: SparkSession, path: str, context_ids: list[str]) -> Store:
    """S10 on the store: a version without the named contexts."""
    return _publish(spark, path.rstrip("/"), dict.fromkeys(context_ids), None)


def unload_contexts(spark: SparkSession, registry: DataFrame, names: DataFrame, path: str) -> DataFrame:
    """S13 delete with its effect on the store: the named contexts lose their chunks, then their entries.

    The names being deleted are a parameter of the call (a short list), so their ids come to the driver."""
    gone = registry.join(names.select(F.col("name").alias("display_name")).distinct(), "display_name", "left_semi").select("context_id")
    drop_contexts(spark, path, [r["context_id"] for r in gone.collect()])
    return delete_contexts(registry, names)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Remove versions before the newest ``keep`` and loads that no kept version names; the number of folders removed.

    Readers of removed versions, and loads that have not committed yet, must be over before."""
    path = path.rstrip("/")
    there = versions(spark, path)
    kept = there[-keep:] if keep else []
    used = {v["load"] for n in kept for v in read_version(spark, path, n)["contexts"].values()}
    conf, removed = spark.sparkContext._jsc.hadoopConfiguration(), 0
    for t in dict.fromkeys(FOLDERS.values()):
        folder = _hadoop_path(spark, f"{path}/{t}")
        fs = folder.getFileSystem(conf)
        for status in fs.listStatus(folder) if fs.exists(folder) else []:
            if status.getPath().getName().removeprefix("load=") not in used:
                fs.delete(status.getPath(), True)
                removed += 1
    for n in there:
        if n not in kept:
            p = _hadoop_path(spark, f"{path}/versions/{n:012d}.json")
            p.getFileSystem(conf).delete(p, False)
    return removed
