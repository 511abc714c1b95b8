"""Merkle manifest against a plain tree over lists."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from docquery.llm import merkle


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row, text):
    parts = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in parts))


def plain_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i:i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def plain_path(levels, at):
    path = []
    for level in levels[:-1]:
        run = level[at // 8 * 8:at // 8 * 8 + 8]
        path.append((run[:at % 8], run[at % 8 + 1:]))
        at //= 8
    return path


def plain_manifest(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r["lang"], []).append(r)
    names = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    built = {}
    for k in names:
        own = sorted(trees[k], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r, r["text"])))
        built[k] = own, plain_levels([plain_leaf(r, r["text"]) for r in own])
    crown = plain_levels([built[k][1][-1][0] for k in names])
    root, out = crown[-1][0] if names else None, []
    for t, k in enumerate(names):
        own, levels = built[k]
        for at, r in enumerate(own):
            path = plain_path(levels, at) + plain_path(crown, t)
            forged = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
            text = r["text"] if r["text"] is None or not forged else r["text"].encode().lower().decode()
            node = plain_leaf(r, text)
            for left, right in path:
                node = h("".join(left) + node + "".join(right))
            out.append((r["doc_id"], levels[0][at], levels[-1][0], root, h("".join("".join(a + b) for a, b in path)), node, node == root))
    return out


def same(df):
    got = [tuple(r) for r in merkle.manifest(df).collect()]
    want = plain_manifest(df.select("doc_id", "source", "lang", "n_chars", "text").collect())
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    return got


def test_odd_rows(spark, odd, none):
    rows = same(odd.withColumn("lang", F.when(F.col("doc_id") % 5 == 0, None).when(F.col("doc_id") % 4 == 1, "é").otherwise(F.col("lang"))))
    assert any(not r[-1] for r in rows) and any(r[-1] for r in rows)
    assert merkle.manifest(none).count() == 0


def test_hot_tree_of_several_blocks(spark):
    rnd = random.Random(3)
    rows = [(k, f"Text {rnd.random()}" if k % 7 else "no capitals", None if k % 900 == 5 else "en" if k % 40 else f"l{k % 11}", "s", k)
            for k in rnd.sample(range(100_000), 1700)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    got = same(df)
    assert len(got) == 1700 and all(r[-1] or zlib.crc32(str(r[0]).encode()) % 3 == 0 for r in got)


def test_more_trees_than_a_block(spark):
    df = spark.range(1300).select(F.col("id").alias("doc_id"), F.concat(F.lit("A"), F.col("id")).alias("text"), F.concat(F.lit("l"), F.col("id") % 600).alias("lang"),
                                  F.lit("s").alias("source"), F.lit(None).cast("long").alias("n_chars"))
    assert len(same(df)) == 1300


def test_versions_share_untouched_nodes():
    leaves = [h(str(k)) for k in range(300)]
    tree = merkle.Versions(leaves, 5000)
    before, nodes = list(tree.digests), len(tree.digests)
    version = tree.with_leaf(tree.root, 77, h("other"))
    assert len(tree.digests) - nodes == 1 + tree.height  # the leaf and its ancestors, nothing else
    assert tree.digests[:nodes] == before and tree.digests[tree.root] == before[tree.root]
    level = leaves[:77] + [h("other")] + leaves[78:]
    for _ in range(3):
        level = [h("".join(level[i:i + 8])) for i in range(0, len(level), 8)]
    assert tree.digests[version] == level[0]
    assert merkle.fold(h("other"), tree.siblings(tree.root, 77)) == tree.digests[version]
    old, new = set(), set()

    def walk(node, seen):
        seen.add(node)
        for c in tree.children[node]:
            walk(c, seen)

    walk(tree.root, old), walk(version, new)
    assert len(new - old) == 1 + tree.height


def test_places_of_a_hot_tree(spark):
    df = spark.range(0, 4000, 1, 6).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    parts = merkle.placed(df.select(merkle.tree_key(F.col("lang")).alias("_tree"), "doc_id", F.lit("d").alias("digest")), ["doc_id"])
    assert parts.select(F.max("pos"), F.max("n"), F.countDistinct("pos")).first()[:] == (3999, 4000, 4000)
