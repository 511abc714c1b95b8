"""P17 on a store: vectors by text digest, so a text is embedded once, however often it is loaded.

Layout below ``path`` (a shared folder): ``vectors/load=<id>/...`` and ``versions/<number>.json``, which names the loads and
the width of the vectors and is written last (:mod:`docquery.operators.store`).

The default vectors are the hashed token counts of :mod:`docquery.functions.vectors`, made in Spark.  A model goes into the
slot ``model``: a function from an iterator of batches of texts to an iterator of equally long batches of
vectors, so it is set up once per task; a vector of another width than the store's fails the load.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquery import config as C
from docquery.functions.text import flatten_newlines
from docquery.functions.vectors import with_embedding
from docquery.operators import store as ST

SPARSE = "digest string, vector array<struct<b:int,c:int>>, norm2 bigint"
DENSE = "digest string, vector array<float>, norm2 double"
Model = Callable[[Iterator[list[str]]], Iterator[list[list[float]]]]


def text_digest(text: Column) -> Column:
    """Key of a text: the digest of what is embedded (newlines as blanks); null for a null text."""
    return F.sha2(flatten_newlines(text), 256)


@dataclass(frozen=True)
class Vectors:
    """One committed version."""

    spark: SparkSession
    path: str
    version: int
    loads: list
    width: int
    dense: bool

    def rows(self) -> DataFrame:
        """``digest, vector, norm2``: one row per digest."""
        schema = DENSE if self.dense else SPARSE
        if not self.loads:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/vectors/load={x}" for x in self.loads])

    def attach(self, df: DataFrame, text_col: str = "chunk_text") -> DataFrame:
        """``df`` plus ``vector`` and ``norm2`` of its text (J4: null where the store has none)."""
        return df.withColumn("digest", text_digest(F.col(text_col))).join(self.rows(), "digest", "left").drop("digest")


def open_vectors(spark: SparkSession, path: str) -> Vectors:
    path = path.rstrip("/")
    there = ST.versions(spark, path)
    if not there:
        return Vectors(spark, path, 0, [], 0, False)
    c = ST.read_version(spark, path, there[-1])
    return Vectors(spark, path, c["version"], c["loads"], c["width"], c["dense"])


def _modelled(missing: DataFrame, model: Model, width: int) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        kept: list = []

        def texts():
            for b in batches:
                kept.append(b.column("digest"))
                yield b.column("text").to_pylist()

        for vectors in model(texts()):
            digests = kept.pop(0)
            if len(vectors) != len(digests) or any(len(v) != width for v in vectors):
                raise ValueError(f"the model must give a vector of {width} numbers for every text")
            yield pa.RecordBatch.from_arrays([digests, pa.array(vectors, pa.list_(pa.float32())),
                                              pa.array([float(sum(x * x for x in v)) for v in vectors], pa.float64())], names=["digest", "vector", "norm2"])

    return missing.mapInArrow(run, DENSE)


def embed_new(spark: SparkSession, texts: DataFrame, path: str, text_col: str = "chunk_text", model: Model | None = None,
              width: int = C.EMBED_BUCKETS) -> Vectors:
    """Embed the texts whose digest the store does not hold, each distinct text once; nothing is written if there is none.

    Null texts are left out.  The width and the kind of vectors are those of the first load; another one is an error."""
    path = path.rstrip("/")
    while True:
        old = open_vectors(spark, path)
        if old.version and (old.width != width or old.dense != (model is not None)):
            raise ValueError(f"the store holds {'dense' if old.dense else 'hashed'} vectors of width {old.width}")
        text = flatten_newlines(F.col(text_col))
        distinct = texts.where(F.col(text_col).isNotNull()).select(text_digest(F.col(text_col)).alias("digest"), text.alias("text")).dropDuplicates(["digest"])
        missing = distinct.join(old.rows().select("digest"), "digest", "left_anti")
        made = with_embedding(missing, "text", "vector", "norm2").drop("text") if model is None else _modelled(missing, model, width)
        load = uuid.uuid4().hex
        made.write.parquet(f"{path}/vectors/load={load}")
        if spark.read.schema(DENSE if model else SPARSE).parquet(f"{path}/vectors/load={load}").isEmpty():
            return old
        try:
            ST.commit(spark, path, old.version + 1, {"version": old.version + 1, "loads": [*old.loads, load], "width": width, "dense": model is not None})
            return open_vectors(spark, path)
        except ST.CommitConflict:
            continue  # another load was faster: embed what it left
