"""Merkle manifest of a table: a forest of 8-ary hash trees, proofs, and versions by path copying.

Rows are leaves; one tree per value of the tree column (ascending by id), and one tree over the roots of those
trees.  Eight consecutive nodes (the last run may have fewer, even one) become one node, until one is left.

How it is spread:

1. Leaf digests are made in Spark functions and stored: from there on texts are not moved.  Leaves are range-partitioned by
   (tree, id, digest), so one hot tree is many tasks, and get their place in the tree from the row counts of
   earlier partitions (a table of at most one row per tree and partition).
2. A tree is cut into aligned blocks of 8**3 leaves, whose three levels of runs lie in no other block.  One
   aggregate per level of blocks gives the block roots, which are the leaves of the next level of blocks, so a
   tree of n leaves takes log(n)/log(512) passes over tables that shrink 512-fold.
3. From the top down every block root gets its path: what stands left and right of it in each run up to the root.
4. Each leaf block is then a persistent tree in one task.  A tampered leaf makes a new version: the nodes
   from the leaf to the block root are copied, all other nodes are those of the first version.  The
   version goes on above the block by the path of the block root: only its ancestors are hashed anew.

A block has at most 512 rows whatever the data, so tasks and memory are bounded, and no list of all nodes is
ever in one place.

Cases: a null value is ``-`` in the leaf; null trees are one tree, before all others; null ids come first and are never
tampered.  Rows with the same id are ordered by digest; rows equal in every column give equal leaves side by side.  A tree
of one leaf has the leaf as its root.  Empty texts and texts of any length are leaves like others.  Extra columns are
ignored; an empty table gives none.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

FAN = 8                # nodes of a run
HEIGHT = 3             # levels of runs in a block
BLOCK = FAN ** HEIGHT  # leaves of a block
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
PATH = "array<struct<l:string,r:string>>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


def height(n: int) -> int:
    """Levels of runs above ``n`` nodes inside one block."""
    h = 0
    while FAN ** h < min(n, BLOCK):
        h += 1
    return h


class Versions:
    """A persistent tree over the leaves of one block.  Nodes are never changed: a version is the number of its root
    node, and versions share every node that does not lie above a changed leaf."""

    def __init__(self, leaves: list[str], n: int):
        """``n``: nodes of the whole tree on the level of the leaves, which sets how high the block goes."""
        self.digests, self.children, self.height = list(leaves), [()] * len(leaves), height(n)
        level = list(range(len(leaves)))
        for _ in range(self.height):
            level = [self._node(tuple(level[i:i + FAN])) for i in range(0, len(level), FAN)]
        self.root = level[0]

    def _node(self, children: tuple[int, ...]) -> int:
        self.digests.append(digest("".join(self.digests[c] for c in children)))
        self.children.append(children)
        return len(self.digests) - 1

    def line(self, version: int, at: int) -> list[tuple[tuple[int, ...], int]]:
        """(children, place among them) from the root of the version down to leaf ``at``."""
        node, down = version, []
        for level in reversed(range(self.height)):
            place = at // FAN ** level % FAN
            down.append((self.children[node], place))
            node = self.children[node][place]
        return down

    def siblings(self, version: int, at: int) -> list[tuple[str, str]]:
        """What stands left and right of the leaf's ancestors in their runs, from the leaf up."""
        join = lambda nodes: "".join(self.digests[c] for c in nodes)
        return [(join(c[:k]), join(c[k + 1:])) for c, k in reversed(self.line(version, at))]

    def with_leaf(self, version: int, at: int, leaf: str) -> int:
        """A version with another leaf: copies of its ancestors, all other nodes shared."""
        self.digests.append(leaf)
        self.children.append(())
        node = len(self.digests) - 1
        for children, k in reversed(self.line(version, at)):
            node = self._node(children[:k] + (node,) + children[k + 1:])
        return node


def fold(node: str, path) -> str:
    """The digest at the end of a path of (left, right) that starts at a node."""
    for left, right in path:
        node = digest(left + node + right)
    return node


# ---------------------------------------------------------------- leaves and their places
def field(c: Column) -> Column:
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]).cast("binary"), 256)


def tree_key(c: Column) -> Column:
    """A string per tree that sorts null first, then by bytes."""
    return F.coalesce(F.concat(F.lit("1"), c.cast("string")), F.lit("0"))


def placed(nodes: DataFrame, order: list[str], spread: bool = True) -> DataFrame:
    """``nodes`` plus ``pos`` (place in its tree from 0) and ``n`` (nodes of the tree), stored."""
    spark, key = nodes.sparkSession, ["_tree", *order]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions")) if spread else 1
    # stored before it is counted: the bounds of the ranges come from a sample and must not move later
    rows = common.staged(nodes.repartitionByRange(parts, *key).sortWithinPartitions(*key).withColumns(
        {"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "merkle-sorted")
    counts = rows.groupBy("_part", "_tree").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_c"))
    tree = Window.partitionBy("_tree")
    counts = counts.select("_part", "_tree", (F.sum("_c").over(tree.orderBy("_part")) - F.col("_c") - F.col("_first")).alias("_shift"),
                           F.sum("_c").over(tree).alias("n"))
    return common.staged(rows.join(counts, ["_part", "_tree"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop(
        "_part", "_at", "_shift"), "merkle-placed")


# ---------------------------------------------------------------- roots upwards, paths downwards
def runs_up(digests: str) -> Column:
    """Digests of the runs of eight of an array of digests."""
    a = F.col(digests)
    return F.transform(F.sequence(F.lit(0), F.size(a) - 1, F.lit(FAN)), lambda i: F.sha2(F.array_join(F.slice(a, i + 1, FAN), "").cast("binary"), 256))


def block_roots(nodes: DataFrame) -> DataFrame:
    """(_tree, pos, n, digest) of the blocks of (_tree, pos, n, digest)."""
    blocks = nodes.groupBy("_tree", F.floor(F.col("pos") / BLOCK).alias("block")).agg(
        F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "digest"))).alias("r"))
    blocks = blocks.select("_tree", "block", "n", F.transform("r", lambda x: x["digest"]).alias("d0"))
    for level in range(HEIGHT):  # as many levels as the whole tree needs
        blocks = blocks.withColumn(f"d{level + 1}", F.when(F.col("n") > FAN ** level, runs_up(f"d{level}")).otherwise(F.col(f"d{level}")))
    return blocks.select("_tree", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), F.element_at(f"d{HEIGHT}", 1).alias("digest"))


def climb(nodes: DataFrame) -> list[DataFrame]:
    """Block roots of the nodes, of those, and so on until every tree has one: the last table holds the roots."""
    levels = []
    while True:
        nodes = common.staged(block_roots(nodes), "merkle-roots")
        levels.append(nodes)
        if nodes.filter("n > 1").isEmpty():
            return levels


def inner_paths(nodes: DataFrame) -> DataFrame:
    """(_tree, pos, path) of every node: its path up to the root of its block."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["pos"])
        tree = Versions([r["digest"] for r in rows], rows[0]["n"])
        return pa.table({"_tree": [r["_tree"] for r in rows], "pos": [r["pos"] for r in rows],
                         "path": pa.array([[{"l": a, "r": b} for a, b in tree.siblings(tree.root, k)] for k in range(len(rows))],
                                          pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())])))},
                        schema=pa.schema([("_tree", pa.string()), ("pos", pa.int64()),
                                          ("path", pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())])))]))

    return nodes.withColumn("_block", F.floor(F.col("pos") / BLOCK)).groupBy("_tree", "_block").applyInArrow(run, f"_tree string, pos long, path {PATH}")


def descend(levels: list[DataFrame], top: DataFrame) -> DataFrame:
    """Paths of the nodes of ``levels[0]`` to the very top, from the paths ``top`` (_tree, path, ...) of the trees' roots."""
    above = levels[-1].select("_tree", "pos").join(top, "_tree")
    for nodes in reversed(levels[:-1]):
        inner = inner_paths(nodes).withColumnsRenamed({"pos": "at", "path": "inner"})
        above = inner.join(above, (inner["_tree"] == above["_tree"]) & (F.floor(inner["at"] / BLOCK) == above["pos"])).select(
            above["_tree"], F.col("at").alias("pos"), F.concat("inner", "path").alias("path"), *top.columns[2:])
        above = common.staged(above, "merkle-paths")
    return above


def manifest(docs: DataFrame, id_col: str = "doc_id", tree_col: str = "lang", fields: tuple[str, ...] = FIELDS, text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: leaf, root of its tree, root, digest of its proof, the root folded from the leaf (of the
    lower-cased text where 3 divides crc32 of the id), and whether that is the root."""
    common.small_batches(docs.sparkSession)
    forged = leaf([F.translate(F.col(c), UPPER, LOWER) if c == text_col else F.col(c) for c in fields])
    leaves = common.staged(docs.select(tree_key(F.col(tree_col)).alias("_tree"), F.col(id_col).cast("long").alias("doc_id"), leaf([F.col(c) for c in fields]).alias("digest"),
                                       F.when(F.crc32(F.col(id_col).cast("string")) % 3 == 0, forged).alias("forged")), "merkle-leaves")
    rows = placed(leaves, ["doc_id", "digest"])
    blocks = climb(rows.select("_tree", "pos", "n", "digest"))
    # the tree over the roots of the trees: places by the trees' names
    subroots = blocks[-1].select("_tree", F.col("digest").alias("subroot"))
    tops = placed(subroots.select(F.lit("").alias("_tree"), F.col("_tree").alias("name"), F.col("subroot").alias("digest")), ["name"])
    upper = climb(tops.select("_tree", "pos", "n", "digest"))
    crown = upper[-1].select("_tree", F.array().cast(PATH).alias("path"), F.col("digest").alias("root"))
    crown = descend([tops.select("_tree", "pos", "n", "digest"), *upper], crown)
    named = tops.join(crown.drop("_tree"), "pos").select(F.col("name").alias("_tree"), "path", F.col("digest").alias("subroot"), "root")
    paths = descend(blocks, named).withColumnRenamed("pos", "_block")

    def run(block: pa.Table, paths: pa.Table) -> pa.Table:
        rows, above = sorted(block.to_pylist(), key=lambda r: r["pos"]), paths.to_pylist()[0]
        up = [(p["l"], p["r"]) for p in above["path"]]
        tail, tree, out = "".join(a + b for a, b in up), Versions([r["digest"] for r in rows], rows[0]["n"]), []
        for k, r in enumerate(rows):
            version = tree.root if r["forged"] is None else tree.with_leaf(tree.root, k, r["forged"])
            proof = digest("".join(a + b for a, b in tree.siblings(tree.root, k)) + tail)
            folded = fold(tree.digests[version], up)
            out.append((r["doc_id"], r["digest"], above["subroot"], above["root"], proof, folded, folded == above["root"]))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), *[pa.string()] * 5, pa.bool_()])], names=names)

    names = [f.split()[0] for f in RESULT.split(", ")]
    left = rows.withColumn("_block", F.floor(F.col("pos") / BLOCK)).groupBy("_tree", "_block")
    return left.cogroup(paths.groupBy("_tree", "_block")).applyInArrow(run, RESULT)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots, proof digest and folded root of every document."""
    return manifest(common.table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, text, CAST(doc_id AS VARCHAR) AS id, source, CAST(n_chars AS VARCHAR) AS nc, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM documents
), f AS (
  SELECT doc_id, lang,
    coalesce(strlen(id) || ':' || id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(nc) || ':' || nc, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS body, coalesce(strlen(low) || ':' || low, '-') AS forged,
    xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(id, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
      lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))), 4294967295::BIGINT) % 3 = 0 AS tampered
  FROM d
), leaf AS (
  SELECT row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, sha256(head || body)) - 1 AS pos, doc_id, lang,
    sha256(head || body) AS leaf, CASE WHEN tampered THEN sha256(head || forged) ELSE sha256(head || body) END AS shown
  FROM f
), tree AS (
  SELECT 0 AS lvl, lang, pos, leaf AS digest, count(*) OVER (PARTITION BY lang) AS n FROM leaf
  UNION ALL
  SELECT lvl + 1, lang, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (max(n) + 7) // 8 FROM tree WHERE n > 1 GROUP BY lvl, lang, pos // 8
), subroot AS (
  SELECT lang, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM tree WHERE n = 1
), crown AS (
  SELECT 0 AS lvl, pos, digest, count(*) OVER () AS n FROM subroot
  UNION ALL
  SELECT lvl + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (max(n) + 7) // 8 FROM crown WHERE n > 1 GROUP BY lvl, pos // 8
), side AS (
  SELECT a.lvl, a.lang, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS l,
    coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS r
  FROM tree a JOIN tree b ON a.lvl = b.lvl AND a.lang IS NOT DISTINCT FROM b.lang AND a.pos // 8 = b.pos // 8 WHERE a.n > 1 GROUP BY a.lvl, a.lang, a.pos
), upside AS (
  SELECT a.lvl, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS l,
    coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS r
  FROM crown a JOIN crown b ON a.lvl = b.lvl AND a.pos // 8 = b.pos // 8 WHERE a.n > 1 GROUP BY a.lvl, a.pos
), low AS (
  SELECT 0 AS lvl, lang, pos AS own, pos, doc_id, leaf, shown AS node, '' AS proof FROM leaf
  UNION ALL
  SELECT low.lvl + 1, low.lang, own, low.pos // 8, doc_id, leaf, sha256(l || node || r), proof || l || r
  FROM low JOIN side ON low.lvl = side.lvl AND low.lang IS NOT DISTINCT FROM side.lang AND low.pos = side.pos
), ended AS (
  SELECT lang, own, max(lvl) AS lvl FROM low GROUP BY lang, own
), high AS (
  SELECT 0 AS lvl, s.pos, low.lang, low.own, doc_id, leaf, s.digest AS subroot, node, proof
  FROM low JOIN ended e ON low.lang IS NOT DISTINCT FROM e.lang AND low.own = e.own AND low.lvl = e.lvl JOIN subroot s ON low.lang IS NOT DISTINCT FROM s.lang
  UNION ALL
  SELECT high.lvl + 1, high.pos // 8, lang, own, doc_id, leaf, subroot, sha256(l || node || r), proof || l || r
  FROM high JOIN upside ON high.lvl = upside.lvl AND high.pos = upside.pos
)
SELECT doc_id, leaf, subroot, (SELECT digest FROM crown WHERE n = 1) AS root, sha256(proof) AS proof_sha256, node AS folded_root,
  node = (SELECT digest FROM crown WHERE n = 1) AS verified
FROM high WHERE lvl = (SELECT max(lvl) FROM crown)
"""
