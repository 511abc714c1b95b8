"""Exact n-gram Jaccard join and its components, by prefix filters under several token orders.

Sets are the distinct word shingles of a text (64-bit hashes); equal sets are one node (a 64-bit key of the
sorted hashes), so exact copies never meet as pairs.  With threshold t, a linked set has at least
o = ceil(t*n) of its n shingles in the other set.  That gives filters under any order of the shingles:

1. Hash order.  All nodes emit their shingles of the lowest quarter of the hash range.  A shingle that only
   one node holds matches nothing, so a node with more than n - o such shingles has no link.  One
   aggregate by shingle (least and greatest node), one by node; most nodes end here.
2. The nodes left emit all shingles.  Shingles of one node are dropped as matchless, so a node keeps m of n
   shingles and any linked pair shares one of the first m - o + 1, rarest first.  Each of these has a list of its nodes;
   candidates are the pairs of a list that fit in size, and a candidate is compared exactly.
3. Candidates are drawn in rounds.  In a round every shingle's list names a few pivots, and every node is compared with
   that one of the pivots in other components with which it shares most lists: a pair a node, and large groups of near
   copies connect in a few rounds.  When few open pairs are left, or a round connects little, all pairs of a list that are
   still in different components are compared inside tasks (:mod:`blocks`): by histograms of the sets, a bound that drops
   no link, then exactly.  Only links that connect components leave a task.  No pair is left out, none within a component is spent.

Components by iterated least labels with pointer jumping; every round's tables are written to the shared
folder.  Memory per task is bounded by texts and by set sizes; hot shingles and hot nodes only meet partial
aggregates and joins that adaptive execution can split.

Keys and hashes have 64 bits: among N sets fewer than N*N/2**65 pairs are expected to share a key by chance.

Cases: null and word-less texts are empty sets, linked with nothing (their component is their own id); a
text with fewer words than a shingle is one shingle.  Rows that share an id are all kept; rows equal in id
and text are one document.  A null id is never the smallest of a component unless all are null.  Extra
columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks, common

WORDS, PERCENT = 4, 85
QUARTER = 62          # shingles whose hash is below 2**62 (as unsigned 64 bits) form the prefix in hash order
OPEN_PER_ROW = 1      # open pairs per row of all lists from which on all of them are compared at once
LITTLE = 20           # a round in which at most one of so many pairs is a link is the last of its kind
PIVOTS = 3            # pivots of a list in a round
CELL_TOKENS = 1 << 20 # shingles of the sets that are compared exactly in one cell
MEMO_WORDS = 300_000

MIX = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def word_hashes() -> dict[bytes, int]:
    return {}


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str, n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams; all words as one if there are fewer."""
    import xxhash

    words = text.encode("utf-8", "replace").lower().split()  # bytes: only A-Z change, only ASCII blanks split
    if not words:
        return np.zeros(0, np.uint64)
    memo, digest = word_hashes(), xxhash.xxh3_64_intdigest
    if len(memo) > MEMO_WORDS:
        memo.clear()
    w = np.fromiter((memo.get(x) or memo.setdefault(x, digest(x)) for x in words), np.uint64, len(words))
    size = min(n, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for k in range(size):
        h = mixed(h * MIX + w[k:len(w) - size + 1 + k])
    return np.unique(h)


def set_key(s: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64))


def need(n: Column | int, percent: int):
    """Least number of shingles a linked set shares: ceil(percent * n / 100)."""
    return F.ceil(n * percent / 100) if isinstance(n, Column) else -(-n * percent // 100)


def members(docs: DataFrame, n: int) -> DataFrame:
    """(_row, doc_id, _th, _tl, node, n_shingles) of every row, stored once."""
    schema = pa.schema([("doc_id", pa.int64()), ("_th", pa.int64()), ("_tl", pa.int32()), ("node", pa.int64()), ("n_shingles", pa.int64())])

    def run(batches):
        common.hold("jaccard", word_hashes)
        for b in batches:
            sets = [shingles(t, n) for t in b.column("_t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_th"), b.column("_tl"), pa.array([set_key(s) for s in sets], pa.int64()),
                                              pa.array([len(s) for s in sets], pa.int64())], schema=schema)

    return common.staged(docs.mapInArrow(run, "doc_id long, _th long, _tl int, node long, n_shingles long"), "jaccard-members")


def emitted(texts: DataFrame, n: int, lowest: int | None) -> DataFrame:
    """(h, node, n) of the shingles of every text, or of those below ``2**lowest``."""
    schema = pa.schema([("h", pa.int64()), ("node", pa.int64()), ("n", pa.int32())])

    def run(batches):
        common.hold("jaccard", word_hashes)
        for b in batches:
            hs, nodes, sizes = [], [], []
            for t in b.column("_t").to_pylist():
                s = shingles(t, n)
                if not len(s):
                    continue
                part = s if lowest is None else s[:np.searchsorted(s, np.uint64(1 << lowest))]
                hs.append(part.astype(np.int64))
                nodes.append(np.full(len(part), set_key(s), np.int64))
                sizes.append(np.full(len(part), len(s), np.int32))
            if hs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (hs, nodes, sizes)], schema=schema)

    return texts.select("_t").mapInArrow(run, "h long, node long, n int")


def open_nodes(texts: DataFrame, sets: DataFrame, n: int, percent: int) -> DataFrame:
    """Nodes that may have a link by the filter in hash order: (node, n_shingles, doc_id, _th, _tl of one row)."""
    alone = (emitted(texts, n, QUARTER).groupBy("h").agg(F.min("node").alias("node"), F.max("node").alias("other"))
             .filter("node = other").groupBy("node").agg(F.count(F.lit(1)).alias("alone")))
    one = F.min(F.struct("doc_id", "_th", "_tl"))
    nodes = sets.filter("n_shingles > 0").groupBy("node").agg(F.max("n_shingles").alias("n"), one.alias("r"))
    left = nodes.join(alone, "node", "left").filter(F.coalesce("alone", F.lit(0)) <= F.col("n") - need(F.col("n"), percent))
    return common.staged(left.select("node", "n", "r.doc_id", "r._th", "r._tl"), "jaccard-open")


def reduced_sets(texts: DataFrame, left: DataFrame, n: int, percent: int) -> DataFrame:
    """(node, n, m, tokens, rare, hist): matchable shingles of the open nodes and their rarest ones, the first m - o + 1.

    ``tokens`` are sorted by hash; ``m`` is their number.
    """
    # the list grows with the corpus, so it is never broadcast, whatever its size here
    kept = texts.join(left.select(*[F.col(c).alias("r" + c) for c in ("doc_id", "_th", "_tl")]).hint("merge"),
                      F.col("doc_id").eqNullSafe(F.col("rdoc_id")) & (F.col("_th") == F.col("r_th")) & (F.col("_tl") == F.col("r_tl")))
    # rows repeated as a whole go; texts and shared shingles are stored one after the other, so the shuffles of one step at a time are on disk
    kept = common.staged(kept.dropDuplicates(["doc_id", "_th", "_tl"]).select("_t"), "jaccard-texts")
    rows = emitted(kept, n, None).select("h", "node", "n")
    shared = common.staged(rows.groupBy("h").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "jaccard-shared")
    sets = rows.join(shared, "h").groupBy("node").agg(F.max("n").alias("n"), F.collect_list(F.struct("df", "h")).alias("t"))
    first = (F.size("t") - need(F.col("n"), percent) + 1).cast("int")
    sets = sets.filter(F.size("t") >= need(F.col("n"), percent))
    hashes = lambda t: F.transform(t, lambda x: x["h"])
    sets = sets.select("node", "n", F.size("t").alias("m"), F.array_sort(hashes(F.col("t"))).alias("tokens"),
                       hashes(F.slice(F.array_sort("t"), F.lit(1), first)).alias("rare"))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, blocks.histograms(b.column("tokens"))], names=[*b.schema.names, "hist"])

    return common.staged(sets.mapInArrow(run, "node long, n int, m int, tokens array<long>, rare array<long>, hist binary"), "jaccard-sets")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links by the exact count."""
    full = {s: sets.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("tokens").alias(f"t_{s}")) for s in "ab"}
    both = F.size(F.array_intersect("t_a", "t_b"))
    return (pairs.join(full["a"], "a").join(full["b"], "b").withColumn("both", both)
            .filter(100 * F.col("both") >= percent * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b"))


def fits(n: Column, other: Column, percent: int) -> Column:
    return 100 * F.least(n, other) >= percent * F.greatest(n, other)


def pivot_pairs(lists: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """(a, b): every node with that pivot of its lists, in another component, with which it shares most of them."""
    met = lists.join(groups.select("h", F.explode("p").alias("p")), "h").filter((F.col("label") != F.col("p.label")) & fits(F.col("n"), F.col("p.n"), percent))
    best = (met.groupBy("node", F.col("p.node").alias("other")).agg(F.count(F.lit(1)).alias("c"))
            .groupBy("node").agg(F.max_by("other", F.struct("c", "other")).alias("other")))
    return best.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))


def cell_pairs(c: dict, percent: int) -> np.ndarray:
    """(i, j): the pairs of rows of a cell in two components that can be links by their sizes and histograms, each pair of nodes once."""
    order, cuts = blocks.groups(c)

    def kept(r: np.ndarray, p: np.ndarray) -> np.ndarray:
        n, m = c["n"][r].astype(np.int64), c["n"][p].astype(np.int64)
        stay = (c["label"][r] != c["label"][p]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
        r, p = r[stay], p[stay]
        stay = blocks.may_link(c, c, r, p, percent, "held")
        return np.stack([r[stay], p[stay]], 1)

    found = [np.zeros((0, 2), np.int64)]
    if c["kind"][0] == blocks.BOTH:  # whole lists
        found += [kept(order[r], order[p]) for r, p in blocks.pairs_within(np.diff(cuts))]
    else:  # one block of a large list
        own, partners = (np.nonzero(c["kind"] == kind)[0] for kind in (blocks.ROW, blocks.PARTNER))
        found += [kept(np.repeat(own[at:at + blocks.CHUNK], len(partners)), np.tile(partners, len(own[at:at + blocks.CHUNK])))
                  for at in range(0, len(own), blocks.CHUNK)]
    pairs = np.concatenate(found)
    nodes = np.sort(c["node"][pairs], axis=1)
    return pairs[np.unique(nodes, axis=0, return_index=True)[1]]


def spanning_links(c: dict, sets: list[np.ndarray], pairs: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links among the pairs by the exact count, without those whose components earlier ones connect: fewer than there are rows."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    label, n, links = c["label"].tolist(), c["n"].tolist(), []
    for i, j in pairs.tolist():
        a, b = root(label[i]), root(label[j])
        if a != b:
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= percent * (n[i] + n[j] - both):
                up[a] = b
                links.append((i, j))
    return links


def open_pairs(lists: DataFrame, groups: DataFrame, sets: DataFrame, percent: int, rows: int) -> DataFrame:
    """(a, b): links that connect the components of every list that links of its nodes connect.

    Histograms first say which rows of a list have a pair that can be a link; only those bring their sets, and a cell
    compares its pairs exactly.  Both steps give at most as many rows as they read."""
    members = (lists.join(groups.select("h", F.col("c").alias("m"), F.col("top.label").alias("big"), (F.col("c") - F.col("top.c")).alias("outside")), "h")
               .withColumnRenamed("h", "key").join(sets.select("node", F.col("m").alias("held"), "hist"), "node"))

    def with_pairs(table: pa.Table) -> pa.Table:
        c = blocks.arrays(table, {"hist": (np.uint8, blocks.BUCKETS)})
        return table.select(["key", "node", "n", "label", "big"]).take(pa.array(np.unique(cell_pairs(c, percent)), pa.int64()))

    kept = blocks.compared(members, 0, True, rows // blocks.CELL_ROWS + 1, ["n", "held", "hist"], with_pairs, "key long, node long, n int, label long, big long")
    kept = common.staged(kept.distinct(), "jaccard-kept")
    sizes = (kept.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.count_if(F.col("label") != F.col("big")).alias("outside"),
                                     *[F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"of{k}") for k in range(2)])
             # lists left with the same nodes have the same pairs: one of them brings its sets
             .groupBy("m", "of0", "of1").agg(F.min_by(F.struct("key", "outside"), "key").alias("one")).select("one.*", "m"))
    full = kept.join(sizes, "key").join(sets.select("node", F.col("m").alias("held"), "tokens"), "node")
    held = full.agg(F.sum("held")).first()[0] or 0

    def run(table: pa.Table) -> pa.Table:
        tokens = table.column("tokens").combine_chunks()
        c = blocks.arrays(table.drop_columns("tokens").append_column("hist", blocks.histograms(tokens)), {"hist": (np.uint8, blocks.BUCKETS)})
        values, ends = np.asarray(tokens.flatten()), np.cumsum(np.asarray(tokens.value_lengths()))
        links = spanning_links(c, np.split(values, ends[:-1]), cell_pairs(c, percent), percent)
        nodes = np.sort(c["node"][np.array(links, np.int64).reshape(-1, 2)], axis=1)
        return pa.table({"a": pa.array(nodes[:, 0], pa.int64()), "b": pa.array(nodes[:, 1], pa.int64())})

    return blocks.compared(full, 0, True, held // CELL_TOKENS + 1, ["n", "held", "tokens"], run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of the edges (a, b): the least node of the component."""
    both = common.staged(edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
                         .unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"))), "jaccard-edges")
    labels = common.staged(both.groupBy("node").agg(F.least("node", F.min("other")).alias("label")), "jaccard-labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("seen"))
        near = labels.join(seen, "node").select("node", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        step = common.staged(near.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("next", "label")).alias("label")), "jaccard-labels")
        if step.filter("old != label").isEmpty():
            return step.select("node", "label")
        labels = step.select("node", "label")


def merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels after joining the components that the new edges connect; only labels take part in the search."""
    by = {s: labels.select(F.col("node").alias(s), F.col("label").alias(f"l{s}")) for s in "ab"}
    between = (edges.join(by["a"], "a", "left").join(by["b"], "b", "left")
               .select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).filter("a != b").distinct())
    new = components(between).withColumnsRenamed({"node": "was", "label": "now"})
    kept = labels.join(new, labels["label"] == new["was"], "left").select("node", F.coalesce("now", "label").alias("label"))
    added = new.join(labels, new["was"] == labels["node"], "left_anti").select(F.col("was").alias("node"), F.col("now").alias("label"))
    return common.staged(kept.unionByName(added), "jaccard-labels")


def links(sets: DataFrame, percent: int) -> DataFrame:
    """(node, label) of the nodes that have links; the label is the least node of the component."""
    lists = common.staged(sets.select(F.explode("rare").alias("h"), "node", "n").withColumn("label", F.col("node")), "jaccard-lists")
    rows = lists.count()
    labels = sets.select("node", F.col("node").alias("label")).limit(0)
    stuck, turn = False, 0
    while True:
        turn += 1
        parts = lists.groupBy("h", "label").agg(F.count(F.lit(1)).alias("c"), F.min_by(F.struct("node", "n"), F.xxhash64("node", F.lit(turn))).alias("r"))
        # up to PIVOTS pivots a list, from as many shares of its components
        shares = parts.groupBy("h", F.pmod(F.xxhash64("label", F.lit(turn)), F.lit(PIVOTS)).alias("share")).agg(
            F.count(F.lit(1)).alias("parts"), F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("cc"), F.max(F.struct("c", "label")).alias("top"),
            F.min_by(F.struct("r.node", "r.n", "label"), F.xxhash64("r.node", F.lit(turn))).alias("p"))
        groups = shares.groupBy("h").agg(F.sum("parts").alias("parts"), F.sum("c").alias("c"), F.sum("cc").alias("cc"), F.max("top").alias("top"),
                                         F.collect_list("p").alias("p")).filter("parts > 1")
        groups = common.staged(groups, "jaccard-groups")
        still = groups.agg(F.sum((F.col("c") * F.col("c") - F.col("cc")) / 2).alias("open")).first()["open"]
        if not still:
            return labels
        last = stuck or still <= OPEN_PER_ROW * rows
        pairs = open_pairs(lists, groups, sets, percent, rows) if last else pivot_pairs(lists, groups, percent).distinct()
        pairs = common.staged(pairs, "jaccard-pairs")
        found = common.staged(verified(pairs, sets, percent), "jaccard-links")
        links = found.count()
        if links:
            labels = merged(labels, found)
        if last:
            return labels
        stuck = links * LITTLE <= pairs.count()
        # only lists with nodes of several components stay
        now = lists.join(groups.select("h"), "h", "left_semi").select("h", "node", "n").join(labels, "node", "left")
        lists = common.staged(now.select("h", "node", "n", F.coalesce("label", "node").alias("label")), "jaccard-lists")


def labelled(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, _th, _tl, node, and the label of its component."""
    common.small_batches(docs.sparkSession)
    ident, th, tl = common.row_key(id_col, text_col)
    texts = docs.select(ident.cast("long").alias("doc_id"), th, tl, common.text_or_empty(text_col).alias("_t"))
    rows = members(texts, n)
    sets = reduced_sets(texts, open_nodes(texts, rows, n, percent), n, percent)
    labels = links(sets, percent)
    return rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (and the row's _th, _tl)."""
    rows = labelled(docs, id_col, text_col, n, percent)
    least = rows.filter("n_shingles > 0").groupBy("label").agg(F.min("doc_id").alias("least"))
    return rows.join(least, "label", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"), "_th", "_tl")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each component, all columns unchanged: that of the least id (a null one last), then of the
    least text hash; of rows equal in id and text one stays.  Rows without words are no component and stay."""
    rows = common.staged(labelled(docs, id_col, text_col, n, percent).filter("n_shingles > 0").groupBy("label", "doc_id", "_th", "_tl")
                         .agg(F.count(F.lit(1)).alias("times")), "jaccard-rows")
    place = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_th"), F.col("_tl"))
    kept = rows.groupBy("label").agg(F.min(place).alias("kept"))
    marked = rows.join(kept, "label").withColumn("stays", place.eqNullSafe(F.col("kept"))).filter("not stays or times > 1")
    marked = common.staged(marked.select(F.col("doc_id").alias("r_id"), F.col("_th").alias("r_th"), F.col("_tl").alias("r_tl"), "stays"), "jaccard-gone")
    ident, th, tl = common.row_key(id_col, text_col)
    keyed = docs.select(F.struct("*").alias("_row"), ident, th, tl)
    same = F.col("_id").eqNullSafe(F.col("r_id")) & (F.col("_th") == F.col("r_th")) & (F.col("_tl") == F.col("r_tl"))
    repeated = keyed.join(marked.filter("stays"), same, "left_semi").groupBy("_id", "_th", "_tl").agg(
        F.min_by("_row", F.xxhash64(F.to_json("_row"))).alias("_row"))
    # the list grows with the corpus, so it is never broadcast, whatever its size here
    return keyed.join(marked.hint("merge"), same, "left_anti").select("_row.*").unionByName(repeated.select("_row.*"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle counts and near-duplicate components of all documents."""
    return near_duplicates(common.table(spark, sf_dir, "documents")).drop("_th", "_tl")


SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT r, array_to_string(w[i:i + least(4, len(w)) - 1], ' ') AS g
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 0) + 2)) AS i FROM d WHERE len(w) > 0)
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
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id
FROM d LEFT JOIN n ON d.r = n.r LEFT JOIN comp ON d.r = comp.r
"""
