"""Near duplicates by MinHash bands, sequential Bayesian verification and an exact check of the survivors.

A set is the distinct word shingles of a text; equal sets are one node (128-bit digest).  A node's signature has
256 minima, 16 bits of each kept.

1. Bands.  Four minima in a row make a band key; 24 bands.  A pair at the threshold 0.85 shares a band but for
   0.478**24 = 2e-8.  Only keys that several nodes share go on; nodes without one are done.
2. Sequential verification.  Pairs of a band compare their signatures in batches of 32 minima.  With m of n minima
   equal and a uniform prior, similarity is Beta(m + 1, n - m + 1); a pair whose posterior probability of reaching the
   threshold falls below ``MISS`` is pruned at once, most of them after the first batch.
3. Exact check.  What is left after all batches is compared on the full sets, whose shingles are made again from the
   texts of those nodes only.

Which pairs are compared: in a round every node of a band names its most similar partner in another
component (of a band of over ``CHUNK`` nodes about that many, other ones every round, stand as partners); the best of a node's partners is
checked, components are joined, and bands of one component leave.  Rounds end when at most one of ``LITTLE`` pairs of one is a link.  Then every pair of
different components that shares a band is compared, members of a band's largest component only with others, and all its survivors
that can reach the threshold by the histograms of their full sets (a bound that drops no link) are checked.  So no pair of a band is left out, while members of one component are not compared again and again.

Comparisons run inside tasks on blocks of at most ``CHUNK`` times ``CHUNK`` signatures (:mod:`blocks`): small bands share a task, a large band is cut into
blocks by hash, and only survivors are rows.  A large band of unlinked nodes costs the square of its nodes in
comparisons of a few bytes, in as many tasks as there are blocks.

Cases: null and word-less texts are empty sets, linked with nothing (their component is their own id, they are kept); a text with
fewer words than a shingle is one shingle.  Rows that share an id are all listed; a null id is never the
smallest of a component unless all are null.  Extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks, common
from .jaccard_join import LITTLE, merged, shingles

WORDS, PERCENT = 5, 85
MINIMA, BANDS, BAND = 256, 24, 4  # minima of a signature; bands and minima of a band
BATCH, MISS = 32, 1e-6            # minima of a batch; posterior probability below which a pair is pruned
CHUNK = blocks.CHUNK
CELL_ROWS = blocks.CELL_ROWS      # rows of small bands that are compared in one group

MEMBERS = "doc_id long, _th long, _tl int, digest binary, n int, sig binary"


# ---------------------------------------------------------------- signatures
def multipliers(count: int = MINIMA) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 2 ** 31, count).astype(np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2 ** 32, count, dtype=np.uint64).astype(np.uint32)


A, B = multipliers()


def signature(s: np.ndarray) -> np.ndarray:
    """The least value of each hash function over the set, lower 16 bits."""
    x, least = (s >> np.uint64(32)).astype(np.uint32), np.full(MINIMA, 2 ** 32 - 1, np.uint32)
    for i in range(0, len(x), 512):
        np.minimum(least, (x[i:i + 512][None, :] * A[:, None] + B[:, None]).min(1), out=least)
    return least.astype(np.uint16)


def set_digest(s: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes())


def members(texts: DataFrame, n: int) -> DataFrame:
    """(doc_id, _th, _tl, digest, n, sig) of every row, stored; empty sets have no signature."""
    schema = pa.schema([("doc_id", pa.int64()), ("_th", pa.int64()), ("_tl", pa.int32()), ("digest", pa.binary()), ("n", pa.int32()), ("sig", pa.binary())])

    def run(batches):
        for b in batches:
            sets = [shingles(t, n) for t in b.column("_t").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("_th"), b.column("_tl"), pa.array([set_digest(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int32()),
                 pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary())], schema=schema)

    return common.staged(texts.mapInArrow(run, MEMBERS), "minhash-members")


def shared_bands(nodes: DataFrame) -> DataFrame:
    """(key, band, node) of the band keys that several nodes share, stored."""
    size = 2 * BAND
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring("sig", b * size + 1, size)))
    rows = nodes.select("node", F.posexplode(keys).alias("band", "key"))
    several = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("key")
    return common.staged(rows.join(several, "key").select("key", "band", "node"), "minhash-bands")


def full_sets(texts: DataFrame, nodes: DataFrame, bands: DataFrame, n: int) -> DataFrame:
    """(node, n, tokens, hist) of the nodes that share a band, from the text of one row of each, stored."""
    wanted = nodes.join(bands.select("node").distinct(), "node").select("node", *[F.col(f"rep.{c}").alias("r" + c) for c in ("doc_id", "_th", "_tl")])
    # the list grows with the corpus, so it is never broadcast, whatever its size here
    kept = texts.join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("rdoc_id")) & (F.col("_th") == F.col("r_th")) & (F.col("_tl") == F.col("r_tl")))

    def run(batches):
        for b in batches:
            sets = [shingles(t, n).astype(np.int64) for t in b.column("_t").to_pylist()]
            tokens = pa.array(sets, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([len(s) for s in sets], pa.int32()), tokens, blocks.histograms(tokens)],
                                             names=["node", "n", "tokens", "hist"])

    sets = kept.dropDuplicates(["node"]).select("node", "_t").mapInArrow(run, "node long, n int, tokens array<long>, hist binary")
    return common.staged(sets, "minhash-sets")


# ---------------------------------------------------------------- sequential verification
@functools.cache
def least_equal(n: int, percent: int, miss: float = MISS) -> int:
    """The least number of equal minima among ``n`` with which a pair stays: P(similarity >= t) = P(Bin(n + 1, t) <= m)."""
    t, below = percent / 100, 0.0
    for m in range(n + 1):
        below += math.comb(n + 1, m) * t ** m * (1 - t) ** (n + 1 - m)
        if below >= miss:
            return m
    return n


def survivors(rows: np.ndarray, partners: np.ndarray, allowed: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, partner, equal minima) of the allowed pairs that no batch prunes."""
    equal = np.zeros(allowed.shape, np.int16)
    for i in range(BATCH):
        equal += rows[:, i][:, None] == partners[:, i][None, :]
    r, p = np.nonzero(allowed & (equal >= least_equal(BATCH, percent)))
    equal = equal[r, p].astype(np.int32)
    for at in range(BATCH, MINIMA, BATCH):
        equal += (rows[r, at:at + BATCH] == partners[p, at:at + BATCH]).sum(1)
        stay = equal >= least_equal(at + BATCH, percent)
        r, p, equal = r[stay], p[stay], equal[stay]
    return r, p, equal


def block_pairs(rows: dict, partners: dict, every: bool, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, equal) of one block of a band: the best partner of every row, or every surviving pair."""
    n, m = rows["n"][:, None].astype(np.int64), partners["n"][None, :].astype(np.int64)
    allowed = (rows["label"][:, None] != partners["label"][None, :]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
    if every:  # a pair of two nodes outside the largest component comes up from both sides
        outside = rows["label"] != rows["big"]
        allowed &= ~outside[:, None] | (rows["node"][:, None] < partners["node"][None, :])
    if not allowed.any():
        none = np.zeros(0, np.int64)
        return none, none, none
    r, p, equal = survivors(rows["sig"], partners["sig"], allowed, percent)
    if every:  # a pair counts in the first band that it shares
        words = rows["sig"].view(np.uint64)[r, :BANDS] == partners["sig"].view(np.uint64)[p, :BANDS]
        stay = words.any(1) & (words.argmax(1) == rows["band"][r])
        r, p, equal = r[stay], p[stay], equal[stay]
        stay = blocks.may_link(rows, partners, r, p, percent)
        r, p, equal = r[stay], p[stay], equal[stay]
    else:
        order = np.lexsort((partners["node"][p], -equal, r))
        first = order[np.unique(r[order], return_index=True)[1]] if len(order) else order
        r, p, equal = r[first], p[first], equal[first]
    return rows["node"][r], partners["node"][p], equal


def compared(rows: DataFrame, turn: int, every: bool, percent: int, cells: int) -> DataFrame:
    """(a, b, equal) from rows (key, band, node, label, n, sig, m, big, outside; with ``every`` hist) of the open bands."""
    binary = {"sig": (np.uint16, MINIMA)} | ({"hist": (np.uint8, blocks.BUCKETS)} if every else {})

    def run(table: pa.Table) -> pa.Table:
        c = blocks.arrays(table, binary)
        order, cuts = blocks.groups(c)
        found = []
        for lo, hi in zip(cuts, cuts[1:]):
            at = order[lo:hi]
            kind = c["kind"][at]
            left, right = at[kind != blocks.PARTNER], at[(c["label"][at] != c["big"][at]) if every and kind[0] == blocks.BOTH else (kind != blocks.ROW)]
            if len(left) and len(right):
                found.append(block_pairs({k: v[left] for k, v in c.items()}, {k: v[right] for k, v in c.items()}, every, percent))
        a, b, equal = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "equal": pa.array(equal, pa.int32())})

    return blocks.compared(rows, turn, every, cells, ["band", "n", *binary], run, "a long, b long, equal int", CHUNK)


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough, stored."""
    side = {s: sets.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("tokens").alias(f"t_{s}")) for s in "ab"}
    both = F.size(F.array_intersect("t_a", "t_b"))
    checked = pairs.join(side["a"], "a").join(side["b"], "b").select("a", "b", "n_a", "n_b", both.alias("both"))
    return common.staged(checked.filter(100 * F.col("both") >= percent * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b"), "minhash-links")


def components(nodes: DataFrame, bands: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, label) of the nodes that have links; the label is the least node of the component."""
    labels = nodes.select("node", F.col("node").alias("label")).limit(0)
    cells, turn, every = bands.count() // CELL_ROWS + 1, 0, False
    while True:
        turn += 1
        now = bands.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        parts = now.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
        state = parts.groupBy("key").agg(F.sum("c").alias("m"), F.max_by("label", F.struct("c", "label")).alias("big"),
                                         (F.sum("c") - F.max("c")).alias("outside")).filter("outside > 0")
        # bands of one component leave
        bands = common.staged(now.join(state, "key"), "minhash-open")
        rows = bands.join(nodes.select("node", "n", "sig"), "node")
        if every:
            rows = rows.join(sets.select("node", "hist"), "node")
        pairs = compared(rows, turn, every, percent, cells)
        if not every:  # the best partner of each node
            pairs = pairs.groupBy("a").agg(F.max_by("b", F.struct("equal", "b")).alias("b"))
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = common.staged(pairs, "minhash-pairs")
        found = linked(pairs, sets, percent)
        links = found.count()
        if links:
            labels = merged(labels, found)
        if every:
            return labels
        bands, every = bands.select("key", "band", "node"), links * LITTLE <= pairs.count()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    common.small_batches(docs.sparkSession)
    ident, th, tl = common.row_key(id_col, text_col)
    texts = docs.select(ident.cast("long").alias("doc_id"), th, tl, common.text_or_empty(text_col).alias("_t"))
    rows = members(texts, n)
    nodes = rows.filter("n > 0").groupBy("digest").agg(F.max("n").alias("n"), F.min("sig").alias("sig"), F.min(F.struct("doc_id", "_th", "_tl")).alias("rep"))
    nodes = common.staged(nodes.withColumn("node", F.monotonically_increasing_id()), "minhash-nodes")
    bands = shared_bands(nodes)
    labels = components(nodes, bands, full_sets(texts, nodes, bands, n), percent)
    labelled = nodes.select("digest", "node").join(labels, "node", "left").select("digest", F.coalesce("label", "node").alias("label"))
    rows = rows.select("doc_id", "digest", "n").join(labelled, "digest", "left")  # empty sets have no label
    least = rows.filter("n > 0").groupBy("label").agg(F.min("doc_id").alias("least"))
    return rows.join(least, "label", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle counts, near-duplicate components and the document that stays of each, of all documents."""
    return near_duplicates(common.table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT r, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS g
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT r, count(*) AS n FROM s GROUP BY r
), pair AS (
  SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r
), link AS (
  SELECT x, y FROM pair JOIN n nx ON x = nx.r JOIN n ny ON y = ny.r WHERE 100 * c >= 85 * (nx.n + ny.n - c)
), reach AS (
  SELECT r AS x, r AS y FROM n
  UNION
  SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x
), comp AS (
  SELECT reach.x AS r, min(d.doc_id) AS component_id FROM reach JOIN d ON reach.y = d.r GROUP BY reach.x
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id,
  d.doc_id IS NOT DISTINCT FROM coalesce(component_id, d.doc_id) AS kept
FROM d LEFT JOIN n ON d.r = n.r LEFT JOIN comp ON d.r = comp.r
"""
