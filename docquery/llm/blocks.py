"""Comparison of the members of groups inside tasks, without a row per compared pair.

Rows are (key, node, label, n, ...) of groups with ``m`` members; a pair of a group counts if its labels differ.  Small
groups share a cell, a group of over ``CHUNK`` members is cut into blocks of ``CHUNK`` times ``CHUNK`` by hash, and only pairs
that pass the caller's filter become rows.

:func:`may_link` is a filter that never drops a link.  A set's elements are counted in ``BUCKETS`` buckets by their lowest bits, up
to 255 each; the absolute differences of two histograms add up to at most the number of elements that only one of the sets holds.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 512
CELL_ROWS = 4096   # rows of small groups that are compared in one cell
BUCKETS = 256      # of a histogram
PAIRS = 1 << 15    # pairs whose histograms are compared at once

ROW, PARTNER, BOTH = 0, 1, 2


def histograms(sets: pa.Array) -> pa.Array:
    """The histogram of each list of 64-bit hashes, as bytes."""
    sizes = np.asarray(sets.value_lengths().fill_null(0)).astype(np.int64)
    values = np.asarray(sets.flatten()).astype(np.int64) & (BUCKETS - 1)
    counts = np.bincount(np.repeat(np.arange(len(sizes)), sizes) * BUCKETS + values, minlength=len(sizes) * BUCKETS)
    rows = np.minimum(counts, 255).astype(np.uint8).reshape(len(sizes), BUCKETS)
    return pa.array([r.tobytes() for r in rows], pa.binary())


def may_link(rows: dict, partners: dict, r: np.ndarray, p: np.ndarray, percent: int, size: str = "n") -> np.ndarray:
    """Whether the pairs (r, p) can reach the threshold by their histograms; ``size``: the number of elements counted in them."""
    out = np.zeros(len(r), bool)
    for at in range(0, len(r), PAIRS):
        i, j = r[at:at + PAIRS], p[at:at + PAIRS]
        apart = np.abs(rows["hist"][i].astype(np.int16) - partners["hist"][j]).sum(1, dtype=np.int64)
        most = (rows[size][i] + partners[size][j] - apart) // 2  # shared elements
        out[at:at + PAIRS] = most * (100 + percent) >= percent * (rows["n"][i] + partners["n"][j])
    return out


def cells(rows: DataFrame, turn: int, every: bool, count: int, columns: list[str], chunk: int = CHUNK) -> DataFrame:
    """The rows of every cell: key, chunk, block, kind and the given columns; large groups are cut into blocks.

    With ``every`` a group's members meet those outside its largest component ``big``, else (in large groups) about ``chunk``
    members that change with ``turn``."""
    small = F.col("m") <= chunk
    zero = F.lit(0).cast("long")
    base = ["key", "node", "label", "big", *columns]
    lone = rows.filter(small).select(F.pmod("key", F.lit(count)).alias("cell"), *base, zero.alias("chunk"), zero.alias("block"), F.lit(BOTH).alias("kind"))
    large = rows.filter(~small)
    chunks = F.ceil(F.col("m") / chunk)
    blocks = F.ceil(F.col("outside") / chunk) if every else F.lit(1).cast("long")
    stands = F.col("label") != F.col("big") if every else F.pmod(F.xxhash64("node", F.lit(turn)), F.col("m")) < chunk
    own = large.select(*base, F.pmod(F.xxhash64("node"), chunks).alias("chunk"), F.explode(F.sequence(zero, blocks - 1)).alias("block"), F.lit(ROW).alias("kind"))
    partners = large.filter(stands).select(*base, F.explode(F.sequence(zero, chunks - 1)).alias("chunk"),
                                           F.pmod(F.xxhash64("node", F.lit(-1)), blocks).alias("block"), F.lit(PARTNER).alias("kind"))
    return lone.unionByName(own.unionByName(partners).withColumn("cell", F.xxhash64("key", "chunk", "block")))


def arrays(table: pa.Table, binary: dict[str, tuple[type, int]]) -> dict[str, np.ndarray]:
    """The columns of a cell as arrays; ``binary``: type and number of values of the columns of bytes."""
    c = {k: table.column(k).to_numpy() for k in table.column_names if k not in binary}
    return c | {k: np.frombuffer(b"".join(table.column(k).to_pylist()), t).reshape(-1, width) for k, (t, width) in binary.items()}


def groups(c: dict[str, np.ndarray]) -> tuple[np.ndarray, list[int]]:
    """(order of the rows of a cell, where its groups begin and end in it)."""
    order = np.lexsort((c["block"], c["chunk"], c["key"]))
    place = np.stack([c[k][order] for k in ("key", "chunk", "block")])
    return order, [0, *(np.nonzero((place[:, 1:] != place[:, :-1]).any(0))[0] + 1).tolist(), len(order)]


def pairs_within(sizes: np.ndarray, most: int = 1 << 20):
    """(r, p) of all pairs of the groups of these sizes whose rows lie one after the other, about ``most`` at a time."""
    ends = np.repeat(np.cumsum(sizes), sizes)
    follow = ends - np.arange(len(ends)) - 1  # rows of the group after this one
    total = np.cumsum(follow)
    at = 0
    while at < len(follow):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        count = follow[at:to]
        r = np.repeat(np.arange(at, to), count)
        yield r, r + 1 + np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)
        at = to


def compared(rows: DataFrame, turn: int, every: bool, count: int, columns: list[str], run: Callable[[pa.Table], pa.Table], result: str,
             chunk: int = CHUNK) -> DataFrame:
    """The rows that ``run`` makes of every cell."""
    return cells(rows, turn, every, count, columns, chunk).groupBy("cell").applyInArrow(run, result)
