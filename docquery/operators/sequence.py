"""Order within a group without a per-group window.

A window ``PARTITION BY chat_id`` sends a whole chat to one task; when one chat holds a third of all
rows that task holds a third of the data.  These helpers number rows in ``(keys, order)`` order
globally instead:

1. ``repartitionByRange`` on the full sort key (keys *and* order columns) so a hot key's rows are cut
   into many range partitions, each sorted inside its task;
2. a per-partition position (``monotonically_increasing_id`` after the sort) plus the row count of all
   earlier partitions gives a dense global position ``_g``.  The count table has one row per
   partition, so broadcasting it is bounded by the partition count;
3. the next or previous row of a group is then an equi-join on ``(keys, _g ± 1)`` – unique keys, no skew – and a frame of
   several rows a window over blocks of positions with a halo (:func:`preceding_rows`).

The numbered table is checkpointed: the range bounds come from a sample, and the numbering must not
change if a lost partition is recomputed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquery.session import cut_lineage

G = "_g"
BLOCK = 4096  # positions of a block in preceding_rows


def ordered_index(df: DataFrame, keys: list[str], order: list[Column | str],
                  num_partitions: int | None = None) -> DataFrame:
    """``df`` plus ``_g``: 0-based position in ``(keys, order)`` order. ``order`` must make rows unique."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sort_key = [F.col(k) for k in keys] + [F.col(o) if isinstance(o, str) else o for o in order]
    s = (df.repartitionByRange(n, *sort_key).sortWithinPartitions(*sort_key)
           .withColumn("_pid", F.spark_partition_id())
           .withColumn("_mid", F.monotonically_increasing_id()))
    s = cut_lineage(s)
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_off"))
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return (s.join(F.broadcast(offsets), "_pid")
             .select(*df.columns, (F.col("_off") + local).alias(G)))


def group_position(idx: DataFrame, keys: list[str]) -> DataFrame:
    """``idx`` plus ``_pos``: 1-based position inside its group.

    The first position of every group comes from a partial (map-side) ``min`` per key; the join back
    on the key is left to AQE (skewed partitions of ``idx`` are split).
    """
    first = idx.groupBy(*keys).agg(F.min(G).alias("_g0"))
    return idx.join(first, keys).withColumn("_pos", F.col(G) - F.col("_g0") + 1).drop("_g0")


def shifted_row(idx: DataFrame, keys: list[str], cols: list[str], offset: int, prefix: str) -> DataFrame:
    """``lead(col, offset)`` (``lag`` for a negative offset) inside each group: ``idx`` plus
    ``prefix + col`` of the row at ``_g + offset``; null past either end of the group."""
    other = idx.select(*keys, (F.col(G) - offset).alias(G), *[F.col(c).alias(prefix + c) for c in cols])
    return idx.join(other, keys + [G], "left")


def next_row(idx: DataFrame, keys: list[str], cols: list[str], prefix: str = "next_") -> DataFrame:
    return shifted_row(idx, keys, cols, 1, prefix)


def previous_row(idx: DataFrame, keys: list[str], cols: list[str], prefix: str = "prev_") -> DataFrame:
    return shifted_row(idx, keys, cols, -1, prefix)


def preceding_rows(idx: DataFrame, keys: list[str], payload: Column, frame: int, out: str, block: int = BLOCK) -> DataFrame:
    """``collect_list(payload) OVER (… ROWS BETWEEN frame PRECEDING AND 1 PRECEDING)`` per group.

    Positions are cut into blocks, and the last ``frame`` rows of a block are copied into the next one, where they are
    seen but not kept.  The window then runs over (group, block): rows move once, a hot group is many tasks, and only
    ``frame`` of ``block`` rows are copied.
    """
    at, own = F.floor(F.col(G) / block), F.lit(False).alias("halo")
    here = F.struct(F.floor(F.col(G) / block).alias("block"), own)
    after = F.struct((at + 1).alias("block"), F.lit(True).alias("halo"))
    cells = F.when(F.pmod(F.col(G), F.lit(block)) >= block - frame, F.array(here, after)).otherwise(F.array(here))
    rows = idx.withColumn("_p", payload).withColumn("_cell", F.explode(cells)).withColumns({"_block": F.col("_cell.block"), "_halo": F.col("_cell.halo")})
    w = Window.partitionBy(*keys, "_block").orderBy(G).rowsBetween(-frame, -1)
    seen = F.transform(F.collect_list(F.struct("_p")).over(w), lambda e: e["_p"])
    return rows.withColumn(out, seen).where("NOT _halo").drop("_p", "_cell", "_block", "_halo")
