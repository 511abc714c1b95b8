"""Benchmark decontamination by winnowing, in DataFrame functions only.

An item's windows are its ``window`` consecutive words, or all its words if it has fewer.  With k-grams of
``k`` words, the least hash of every ``window - k + 1`` consecutive k-grams is kept as a fingerprint (all
positions that hold it, on both sides), so texts that share ``window`` words in a row share a fingerprint
at the same place of that row.  Steps:

1. Fingerprints of the items are stored; documents emit theirs (about two of seven positions) and are
   joined on the hash.  A match gives an item and a diagonal: where the item would start in the document.
   Items shorter than a window emit the hash of all their words, documents those of every run as long.
2. Matches are reduced to distinct (document, item, diagonal).
3. Each diagonal is extended: the item's words are compared with the document's words along it, and runs of
   equal words that are at least a window long are hits.  Hashes only propose, words decide.

The item side is stored first, so Spark sees its true size when it chooses between a broadcast (below its
threshold) and a shuffle join; the same holds for the list of diagonals against the texts.

Cases: null or word-less texts have no words and no hits; word-less items have no window; items with equal
text all count.  Rows that share an id are told apart by text; rows equal in both get the same result.  Null
ids of items are left out of the list of ids but their words count as hit.  Extra columns are ignored; empty
tables give no rows, or no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW, K = 10, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = "".join(chr(c) for c in (*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)))  # ASCII marks and blanks
KEYS = ["_id", "_th", "_tl"]


def words(col: str) -> Column:
    """Lower-cased words: one pass turns every mark into a blank, one cuts at blanks (a pattern takes five times as long)."""
    return F.array_remove(F.split(F.translate(common.text_or_empty(col), UPPER + BETWEEN, LOWER + " " * len(BETWEEN)), " "), "")


def gram_hashes(hashes: str, n: int) -> Column:
    """Hashes of the runs of ``n`` words from the array of word hashes (none if there are fewer words)."""
    h = F.col(hashes)
    return F.when(F.size(h) >= n, F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*[h[i + j] for j in range(n)]))
                  ).otherwise(F.array().cast("array<bigint>"))


def word_hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def fingerprints(hashed: DataFrame, keys: list[str], window: int, k: int) -> DataFrame:
    """(keys, hash, at) of the winnowed k-grams of the array column ``_h`` of word hashes.

    Texts shorter than a window end as empty arrays, not by a filter: Spark would move that below the projection
    and cut the words twice.
    """
    span = window - k + 1
    df = hashed.select(*keys, gram_hashes("_h", k).alias("_g"))
    g, none = F.col("_g"), F.array().cast("array<bigint>")
    df = df.select(*keys, "_g", F.when(F.size(g) >= span, F.transform(
        F.sequence(F.lit(0), F.size(g) - span), lambda i: F.least(*[g[i + j] for j in range(span)]) if span > 1 else g[i])).otherwise(none).alias("_m"))
    m = F.col("_m")
    # a position is kept if it holds the minimum of any window over it: the largest of those minima is its hash
    kept = F.when(F.size(m) > 0, F.filter(F.sequence(F.lit(0), F.size(g) - 1), lambda i: F.array_max(
        F.slice(m, F.greatest(i - (span - 2), F.lit(1)), F.least(F.lit(span), i + 1))) == g[i])).otherwise(F.array().cast("array<int>"))
    df = df.select(*keys, "_g", F.explode(kept).alias("_at"))
    return df.select(*keys, F.element_at("_g", F.col("_at") + 1).alias("_hash"), "_at")


def runs_of(hashed: DataFrame, keys: list[str], n: int) -> DataFrame:
    """(keys, hash, at) of every run of ``n`` words."""
    return hashed.select(*keys, F.posexplode(gram_hashes("_h", n)).alias("_at", "_hash"))


def equal_runs(a: Column, b: Column, least: Column) -> Column:
    """(start, end) of the runs of at least ``least`` equal elements of two arrays of one length."""
    breaks = F.concat(F.array(F.lit(-1)), F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: a[i] != b[i]), F.array(F.size(a)))
    # the array is bound to a variable so that it is computed once, not for every element
    return F.filter(F.flatten(F.transform(F.array(breaks), lambda br: F.transform(
        F.sequence(F.lit(0), F.size(br) - 2), lambda i: F.struct((br[i] + 1).alias("s"), br[i + 1].alias("e"))))),
        lambda r: (r["e"] - r["s"]) >= least)


def covered(intervals: Column) -> Column:
    """Positions in the union of the intervals."""
    return F.aggregate(F.array_sort(intervals), F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
                       lambda acc, r: F.struct((acc["n"] + F.greatest(r["e"] - F.greatest(r["s"], acc["to"]), F.lit(0))).alias("n"),
                                               F.greatest(acc["to"], r["e"]).alias("to")), lambda acc: acc["n"].cast("long"))


def find_hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
              item_text_col: str = "text", window: int = WINDOW, k: int = K) -> DataFrame:
    """Verified hits, one row per document with any: keys of the row, intervals of words, ids of the items."""
    spark = docs.sparkSession
    item = common.staged(items.select(F.col(item_col).cast("string").alias("_item"), words(item_text_col).alias("_w"))
                         .filter(F.size("_w") > 0).withColumn("_no", F.xxhash64("_item", "_w")).distinct(), "items")
    hashed = docs.select(*common.row_key(id_col, text_col), word_hashes(words(text_col)).alias("_h"))
    of_item = ["_no", "_n"]
    with_n = item.select("_no", F.size("_w").alias("_n"), word_hashes(F.col("_w")).alias("_h"))
    short = [r["_n"] for r in with_n.filter(F.col("_n") < window).select("_n").distinct().collect()]  # at most window - 1 numbers
    sides = [(fingerprints(hashed, KEYS, window, k), fingerprints(with_n, of_item, window, k))]
    sides += [(runs_of(hashed, KEYS, n), runs_of(with_n.filter(F.col("_n") == n), of_item, n)) for n in sorted(short)]
    matches = None
    for doc_side, item_side in sides:
        found = doc_side.join(common.staged(item_side.withColumnRenamed("_at", "_item_at"), "item-fingerprints"), "_hash").select(
            *KEYS, "_no", "_n", (F.col("_at") - F.col("_item_at")).alias("_diag"))
        matches = found if matches is None else matches.unionByName(found)
    diagonals = common.staged(matches.groupBy(*[F.col(c).alias("r" + c) for c in KEYS])
                              .agg(F.collect_set(F.struct("_no", "_n", "_diag")).alias("_d")), "diagonals")
    same_row = F.col("_id").eqNullSafe(F.col("r_id")) & (F.col("_th") == F.col("r_th")) & (F.col("_tl") == F.col("r_tl"))
    diag, n = F.col("_d._diag"), F.col("_d._n")
    # the words of the few rows with a diagonal only, so they are cut after the join
    texts = docs.select(*common.row_key(id_col, text_col), F.col(text_col).alias("_t")).join(diagonals, same_row)
    placed = texts.select(*KEYS, words("_t").alias("_w"), "_d").select(*KEYS, "_w", F.explode("_d").alias("_d")).select(
        *KEYS, F.col("_d._no").alias("_no"), F.greatest(diag, F.lit(0)).alias("_from"), F.greatest(-diag, F.lit(0)).alias("_skip"),
        F.slice("_w", F.greatest(diag, F.lit(0)) + 1, F.least(n, n + diag)).alias("_part"))
    runs = placed.join(item.withColumnRenamed("_w", "_full"), "_no").select(
        *KEYS, "_item", "_from", equal_runs(F.col("_part"), F.slice("_full", F.col("_skip") + 1, F.size("_part")),
                                            F.least(F.lit(window), F.size("_full"))).alias("_r"))
    runs = runs.filter(F.size("_r") > 0).select(*KEYS, "_item", F.transform(
        "_r", lambda r: F.struct((r["s"] + F.col("_from")).alias("s"), (r["e"] + F.col("_from")).alias("e"))).alias("_r"))
    return runs.groupBy(*KEYS).agg(F.flatten(F.collect_list("_r")).alias("spans"), F.collect_set("_item").alias("items"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", window: int = WINDOW, k: int = K) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    rows = docs.select(F.col(id_col).alias("doc_id"), *common.row_key(id_col, text_col), F.size(words(text_col)).cast("long").alias("n_words"))
    hits = find_hits(docs, items, id_col, text_col, item_col, item_text_col, window, k).withColumnsRenamed({c: "r" + c for c in KEYS})
    same_row = F.col("_id").eqNullSafe(F.col("r_id")) & (F.col("_th") == F.col("r_th")) & (F.col("_tl") == F.col("r_tl"))
    found = F.coalesce("items", F.array().cast("array<string>"))
    return rows.join(hits, same_row, "left").select(
        "doc_id", "n_words", F.coalesce(covered(F.col("spans")), F.lit(0)).cast("long").alias("n_hit"),
        F.size(found).cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort(found), ",").cast("binary"), 256).alias("items_sha256"),
        F.col("spans").isNotNull().alias("contaminated"))


def without_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                         item_text_col: str = "text", window: int = WINDOW, k: int = K) -> DataFrame:
    """``docs`` without the documents that hold a window of an item, all columns unchanged."""
    hits = common.staged(find_hits(docs, items, id_col, text_col, item_col, item_text_col, window, k)
                         .select(*[F.col(c).alias("r" + c) for c in KEYS]), "contaminated")
    ident, th, tl = common.row_key(id_col, text_col)
    keyed = docs.select(F.struct("*").alias("_row"), ident, th, tl)
    same_row = F.col("_id").eqNullSafe(F.col("r_id")) & (F.col("_th") == F.col("r_th")) & (F.col("_tl") == F.col("r_tl"))
    return keyed.join(hits, same_row, "left_anti").select("_row.*")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in windows of ``benchmark``."""
    return contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH dw AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), iw AS (
  SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM iw WHERE len(w) > 0)
), grams AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
), found AS (
  SELECT r, grams.n, i, item_id FROM grams JOIN win ON grams.n = win.n AND grams.g = win.g
), hit AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY r
), its AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit ON dw.r = hit.r LEFT JOIN its ON dw.r = its.r
"""
