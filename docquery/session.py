"""Session helpers: sensible defaults for large jobs, and the checkpoint folder."""

from __future__ import annotations

import contextlib
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Broadcast only what AQE has measured to be small; 64 MB keeps the build side bounded.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
}


def get_session(master: str | None = None, app: str = "docquery",
                shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with AQE, skew-join handling and the UI off."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
        if master.startswith("local"):
            # single JVM: the driver heap is the executor heap (cluster jobs size this at submit time)
            b = b.config("spark.driver.memory", os.environ.get("DOCQUERY_DRIVER_MEMORY", "16g"))
    for k, v in _DEFAULTS.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: the one the caller set, else the one ``spark.checkpoint.dir`` names.

    Only a local session that names none gets a scratch folder of its own; elsewhere that is an error,
    because a machine-local folder is not shared by the executors.
    """
    d = spark.sparkContext.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="docquery-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """Shuffle files of what is run inside go as soon as it is done, not when the driver next collects its garbage.

    For plans that are run once, to store their rows."""
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(DROP_SHUFFLES) if before is None else spark.conf.set(DROP_SHUFFLES, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss; never ``localCheckpoint``).

    Measured against writing the intermediate as parquet and reading it back, the checkpoint was the
    faster of the two on the headline queries.  The shuffle files of the run serve nothing later and go with it.
    """
    checkpoint_dir(df.sparkSession)
    with shuffles_dropped(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a new DataFrame: it takes the setting when it is made


def value_bytes(df: DataFrame) -> int:
    """About the bytes that the values of ``df`` (a stored table) take."""
    width = F.lit(0)
    for name, kind in df.dtypes:
        width = width + (F.coalesce(F.octet_length(name), F.lit(0)) if kind == "string" else F.lit(0)) + F.lit(24)
    return df.agg(F.sum(width.cast("long"))).first()[0] or 0


def broadcast_if_small(df: DataFrame, most: int = 16 << 20) -> DataFrame:
    """``df`` (a stored table) with a broadcast hint if its values take at most ``most`` bytes, else unchanged.

    A checkpoint tells the planner no size, so a join with one shuffles both sides whatever it holds.  The bytes are counted
    here; beyond the bound the join stays a shuffle join.
    """
    return F.broadcast(df) if value_bytes(df) <= most else df
