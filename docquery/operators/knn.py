"""Nearest neighbours and cosine over vector columns.

Searches with one probe per key are an equi-join on that key (chat, label), so the work is linear in the table.  A table of
probes is compared cell by cell, in blocks (:func:`knn_probes`).  No all-pairs within a group, no cross join.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquery import config as C
from docquery.functions.text import unwrap_dollars
from docquery.functions.vectors import dense_cosine, dense_norm2, with_embedding, with_sparse_cosine
from docquery.session import cut_lineage

SALTS = 32  # parts of a chat in the nearest-prompt search
REPEAT_LEAD = "This question was answered earlier in this chat; the earlier answer follows:"  # our wording


def semantic_repeat(questions: DataFrame, messages: DataFrame, threshold: float = C.REPEAT_COSINE) -> DataFrame:
    """For each chat's current question, the stored prompt with the highest cosine (ties: smallest
    id) and whether it exceeds ``threshold`` (strict).  Vectors are N9; the stored prompt vector is of
    the ``$$``-wrapped text, which has the same tokens as the plain text.  Where ``messages`` come from the message
    store, the vector stored with each prompt is used and no stored text is read."""
    q = with_embedding(questions.select("chat_id", F.col("id").alias("question_id"), "message"),
                       "message", "qv", "qn")
    if "prompt_vector" in messages.columns:
        m = messages.select("chat_id", "id", F.col("prompt_vector").alias("mv"), F.col("prompt_norm2").alias("mn"))
    else:
        m = with_embedding(messages.select("chat_id", "id", "prompt"), "prompt", "mv", "mn")
    # the messages of a chat are dealt over a fixed number of salts, with its one question at each, so a
    # chat holding a third of all messages is many tasks; the best of each salt, then the best of those
    m = m.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    q = q.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    j = with_sparse_cosine(q.join(m, ["chat_id", "_salt"]), "qv", "mv", "qn", "mn", "cosine")
    nearest = F.struct((-F.col("cosine")).alias("nc"), "id")
    some = j.groupBy("chat_id", "question_id", "_salt").agg(F.min_by(F.struct("id", "cosine"), nearest).alias("b"))
    best = some.groupBy("chat_id", "question_id").agg(F.min_by("b", F.struct((-F.col("b.cosine")).alias("nc"), F.col("b.id").alias("id"))).alias("b"))
    return best.select("chat_id", "question_id", F.col("b.id").alias("nearest_id"),
                       F.round("b.cosine", 6).alias("cosine"), (F.col("b.cosine") > F.lit(threshold)).alias("repeated"))


def repeat_answers(repeats: DataFrame, messages: DataFrame) -> DataFrame:
    """Repeated questions → the stored response (``$$`` removed) behind a fixed lead-in."""
    r = repeats.where("repeated").select("chat_id", "question_id", F.col("nearest_id").alias("id"))
    return (r.join(messages.select("chat_id", "id", "response"), ["chat_id", "id"])
             .select("chat_id", "question_id", F.col("id").alias("answered_by"),
                     F.concat(F.lit(REPEAT_LEAD + "\n\n"), unwrap_dollars(F.col("response"))).alias("text")))


def label_centroids(vectors: DataFrame, key: str = "label", vec: str = "embedding") -> DataFrame:
    """Mean vector per key: ``posexplode`` + grouped average (map-side partial sums), re-assembled."""
    e = vectors.select(key, F.posexplode(vec).alias("i", "x"))
    g = e.groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return (g.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("c"))
             .select(key, F.transform("c", lambda s: s["m"]).alias("centroid")))


def vector_cosine(vectors: DataFrame, key: str = "label", vec: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """Cosine of every vector with the centroid of its own key."""
    c = label_centroids(vectors, key, vec).withColumn("cn", dense_norm2("centroid"))
    v = vectors.select(id_col, key, vec).withColumn("vn", dense_norm2(vec))
    return (v.join(c, key)
             .select(id_col, key, dense_cosine(vec, "centroid", "vn", "cn").alias("cosine")))


def knn_exact(vectors: DataFrame, k: int = 4, key: str = "label", vec: str = "embedding",
              id_col: str = "vec_id") -> DataFrame:
    """J7 exact: the ``k`` vectors nearest (cosine) to their key's centroid; ties by id.

    ``row_number() <= k`` is planned as a partial window-group-limit, so only k rows per key and
    partition reach the shuffle even when one key holds most of the rows.
    """
    cs = vector_cosine(vectors, key, vec, id_col)
    w = Window.partitionBy(key).orderBy(F.desc("cosine"), F.asc(id_col))
    return (cs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
              .select(key, "rank", id_col, F.round("cosine", 6).alias("cosine")))


# ---------------------------------------------------------------------------------------------
# J7 for a table of probes: coarse cells
# ---------------------------------------------------------------------------------------------
CELL_SAMPLE = 20_000   # rows on which the centres are fitted at most
CELL_ROUNDS = 8        # rounds of the fit
BLOCK_ROWS = 8_192     # rows of a cell that one group compares at most (by hash; large cells are many groups)
FIRST_CELLS = 4        # cells that a probe visits first


def _unit(a: np.ndarray) -> np.ndarray:
    n = np.sqrt((a * a).sum(1, keepdims=True))
    return np.divide(a, n, out=np.zeros_like(a), where=n > 0)


def _matrix(column, width: int) -> np.ndarray:
    """Unit rows of a list column; rows that are null or of another length count as zero vectors."""
    rows = [x if x is not None and len(x) == width and None not in x else [0.0] * width for x in column.to_pylist()]
    return _unit(np.array(rows, np.float64).reshape(-1, width))


def fit_cells(vectors: DataFrame, cells: int, vec: str = "embedding", id_col: str = "vec_id") -> np.ndarray:
    """Unit centres by Lloyd rounds on at most ``CELL_SAMPLE`` rows (the smallest id hashes, so the same rows every time).

    The sample and the centres are bounded by parameters and come to the driver; every row is assigned in tasks."""
    rows = vectors.where(F.col(vec).isNotNull()).orderBy(F.xxhash64(id_col), F.col(id_col)).limit(CELL_SAMPLE).select(vec).collect()
    width = max((len(r[0]) for r in rows), default=1)
    x = _unit(np.array([r[0] for r in rows if len(r[0]) == width and None not in r[0]], np.float64).reshape(-1, width))
    x = x[(x != 0).any(1)]
    if not len(x):
        return np.eye(1, width)
    centres = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)]
    for _ in range(CELL_ROUNDS):
        own = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        moved = _unit(sums)
        centres = np.where((moved != 0).any(1, keepdims=True), moved, centres)
    return np.unique(centres, axis=0)


def in_cells(vectors: DataFrame, centres: np.ndarray, vec: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """``id, vec, cell, far`` of every row: its nearest centre and the distance of the unit vectors; zero vectors are cell -1."""
    schema = f"id {dict(vectors.dtypes)[id_col]}, vec {dict(vectors.dtypes)[vec]}, cell int, far double"

    def run(batches):
        import pyarrow as pa

        for b in batches:
            x = _matrix(b.column("vec"), centres.shape[1])
            near = x @ centres.T
            some = (x != 0).any(1)
            cell = np.where(some, near.argmax(1), -1).astype(np.int32)
            far = np.where(some, np.sqrt(np.maximum(2 - 2 * near.max(1), 0)), 0.0)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("vec"), pa.array(cell), pa.array(far)], names=["id", "vec", "cell", "far"])

    return vectors.select(F.col(id_col).alias("id"), F.col(vec).alias("vec")).mapInArrow(run, schema)


def _visits(probes: DataFrame, centres: np.ndarray, reach: np.ndarray, first: int, bounded: bool) -> DataFrame:
    """``pid, pvec, cell``: the cells that a probe visits first, or (``bounded``) the later ones that its k-th similarity ``low``
    does not rule out: a vector of a cell is at least as far as its centre less the cell's radius."""
    schema = f"pid {dict(probes.dtypes)['pid']}, pvec {dict(probes.dtypes)['pvec']}, cell int"

    def run(batches):
        import pyarrow as pa

        for b in batches:
            x = _matrix(b.column("pvec"), centres.shape[1])
            near = x @ centres.T
            order = np.argsort(-near, axis=1, kind="stable")
            if bounded:
                low = np.array([-2.0 if v is None else v for v in b.column("low").to_pylist()])
                gap = np.sqrt(np.maximum(2 - 2 * near, 0)) - reach[None, :-1]
                open_ = gap <= np.sqrt(np.maximum(2 - 2 * low, 0))[:, None] + 1e-9
                open_ |= ~(x != 0).any(1)[:, None]  # a zero probe is as near to all
                np.put_along_axis(open_, order[:, :first], False, axis=1)
                open_ = np.concatenate([open_, (low <= 1e-9)[:, None]], axis=1)  # zero vectors have similarity 0
            else:
                open_ = np.zeros((len(x), near.shape[1] + 1), bool)
                np.put_along_axis(open_, order[:, :first], True, axis=1)
            row, cell = np.nonzero(open_)
            cell = np.where(cell == near.shape[1], -1, cell).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("pid").take(pa.array(row)), b.column("pvec").take(pa.array(row)), pa.array(cell)], names=["pid", "pvec", "cell"])

    return probes.mapInArrow(run, schema)


def _nearest_in_cells(visits: DataFrame, rows: DataFrame, blocks: DataFrame, k: int, width: int) -> DataFrame:
    """``pid, id, sim``: of every (probe, block of a visited cell) the ``k`` most similar rows, by products of matrices."""
    cell_rows = rows.join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).select("cell", "block", "id", "vec")
    at_blocks = visits.join(blocks, "cell").select("pid", "pvec", F.col("cell").alias("pcell"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("pblock"))
    schema = f"pid {dict(visits.dtypes)['pid']}, id {dict(rows.dtypes)['id']}, sim double"

    def run(own, asked):
        import pyarrow as pa

        pids, ids, sims = [], [], []
        if len(own) and len(asked):
            names = np.array(own.column("id").to_pylist())
            x = _matrix(own.column("vec"), width)
            for lo in range(0, len(asked), 512):
                part = asked.slice(lo, 512)
                near = np.round(_matrix(part.column("pvec"), width) @ x.T, 9)
                for pid, line in zip(part.column("pid").to_pylist(), near):
                    best = np.lexsort((names, -line))[:k]
                    pids += [pid] * len(best)
                    ids += names[best].tolist()
                    sims += line[best].tolist()
        return pa.table([pa.array(pids, asked.schema.field("pid").type), pa.array(ids, own.schema.field("id").type), pa.array(sims, pa.float64())], names=["pid", "id", "sim"])

    return cell_rows.groupBy("cell", "block").cogroup(at_blocks.groupBy("pcell", "pblock")).applyInArrow(run, schema)


def knn_probes(vectors: DataFrame, probes: DataFrame, k: int = 4, vec: str = "embedding", id_col: str = "vec_id",
               cells: int | None = None, first: int = FIRST_CELLS, exact: bool = True) -> DataFrame:
    """J7 for a table of probes (``id_col``, ``vec``): the ``k`` vectors of highest cosine of every probe, itself left out.

    Every vector belongs to the cell of its nearest centre (about the square root of the rows as many).  A probe first compares with its
    ``first`` nearest cells; with ``exact`` then with every other cell that its k-th similarity so far does not rule
    out by the cell's radius, so the answer is that of a full comparison; without, the first cells are all (approximate).
    Cells are cut into blocks by hash, and a block gives at most k rows per probe, so a hot cell is many tasks and pairs are
    never rows.  The found pairs are scored again with :func:`dense_cosine`, and ties go to the smaller id.

    Null vectors and vectors of another length than the fitted ones count as zero vectors (cosine 0).
    """
    n = vectors.count()
    centres = fit_cells(vectors, cells or max(4, min(1024, math.isqrt(n))), vec, id_col)
    rows = cut_lineage(in_cells(vectors, centres, vec, id_col))
    sizes = cut_lineage(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("reach")))
    reach = np.full(len(centres) + 1, -np.inf)  # a row per centre, at most 1,024; an empty cell is out of reach
    for r in sizes.where("cell >= 0").collect():
        reach[r["cell"]] = r["reach"]
    blocks = F.broadcast(sizes.select("cell", F.ceil(F.col("n") / BLOCK_ROWS).alias("blocks")))  # a row per centre
    asked = probes.select(F.col(id_col).alias("pid"), F.col(vec).alias("pvec"))
    width, other = centres.shape[1], F.col("pid") != F.col("id")
    found = cut_lineage(_nearest_in_cells(_visits(asked, centres, reach, first, False), rows, blocks, k + 1, width).where(other))
    if exact:
        kth = found.groupBy("pid").agg(F.sort_array(F.collect_list("sim"), asc=False).alias("s")).select("pid", F.get("s", F.lit(k - 1)).alias("low"))
        later = _visits(asked.join(kth, "pid", "left"), centres, reach, first, True)
        found = found.unionByName(_nearest_in_cells(later, rows, blocks, k + 1, width).where(other))
    w = Window.partitionBy("pid").orderBy(F.desc("sim"), "id")
    found = found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= 2 * k).select("pid", "id")
    side = {s: v.select(F.col(id_col).alias(s), F.col(vec).alias(s + "v"), dense_norm2(vec).alias(s + "n")) for s, v in (("pid", probes), ("id", vectors))}
    scored = found.join(side["pid"], "pid").join(side["id"], "id").select("pid", "id", dense_cosine("pidv", "idv", "pidn", "idn").alias("cosine"))
    last = Window.partitionBy("pid").orderBy(F.desc("cosine"), "id")
    return (scored.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
            .select(F.col("pid").alias("probe_id"), "rank", F.col("id").alias(id_col), F.round("cosine", 6).alias("cosine")))
