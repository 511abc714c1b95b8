"""Helpers shared by the operators: input tables, shared-folder stages, batch sizes, files."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ARROW_ROWS = 512  # rows per Arrow batch: keeps a batch of long texts small in a Python worker


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session that names none gets a scratch folder of its own; elsewhere that is an error,
    because executors do not share a machine-local folder.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="docquery-shared-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder (never reused, so a rerun cannot mix with older files)."""
    return f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there, and the files
    survive the loss of executors.  The write's shuffle files serve nothing later and go as soon as it is done."""
    spark = df.sparkSession
    path = new_path(spark, name)
    schema = df.schema
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(DROP_SHUFFLES) if before is None else spark.conf.set(DROP_SHUFFLES, before)
    return spark.read.schema(schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound the rows per Arrow batch, never raising a lower bound that the session has."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def row_key(id_col: str, text_col: str) -> list[Column]:
    """Columns that tell rows apart by id and text, for joins that must not mix rows sharing an id.

    Rows equal in both get the same per-row result, so joining their distinct key back is exact.
    """
    return [F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_th"),
            F.coalesce(F.octet_length(text_col), F.lit(-1)).alias("_tl")]


def open_fs(uri: str):
    """(filesystem, path) of a URI or a plain path, through pyarrow's filesystems."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_file(uri: str, data: bytes) -> None:
    """Create one file; the caller's manifest row is what makes it count."""
    f, path = open_fs(uri)
    f.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with f.open_output_stream(path) as out:
        out.write(data)


def read_file(uri: str) -> bytes:
    f, path = open_fs(uri)
    with f.open_input_stream(path) as src:
        return src.read()


def partition_id() -> int:
    from pyspark import TaskContext

    ctx = TaskContext.get()
    return ctx.partitionId() if ctx else 0


_held: dict[str, tuple] = {}  # of a worker process: operator -> its caches


def hold(owner: str, *caches) -> None:
    """Say in a task whose caches (functions under ``functools.cache``) the worker process keeps from here on: those of other
    operators are emptied, so a chain of operators holds the memory of one."""
    others = [k for k in _held if k != owner]
    for other in others:
        for c in _held.pop(other):
            c.cache_clear()
    _held[owner] = caches
    if others:
        give_back()


def give_back() -> None:
    """Return freed memory of the worker process to the system, where its C library can."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def arrow_rows(batches: Iterator, *columns: str) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples of Python values."""
    for b in batches:
        yield from zip(*(b.column(c).to_pylist() for c in columns))
