"""The four-tier keyword search cascade as one batch plan over many queries.

Semantics (N8/N10 of the survey).  For a query with ``k`` keywords, ``kw'`` = keyword with ``'`` → ``?``
and ``K`` = Python-title-case of ``kw'``.  Flags on a chunk ``c``:

* ``I(x)``   – ``c LIKE '%x%'`` (case-sensitive, ``?`` = one character);
* ``Fd(x)``  – some token of ``c`` contains ``x`` or is within edit distance ``d`` of ``x``;
* ``O(x,y)`` – ``c LIKE '%x%y%'``.

=====  ===========  =======================================================  ==============================
tier   runs when    patterns (in order)                                      score of a chunk
=====  ===========  =======================================================  ==============================
1      k > 3        one: all K                                               Σ F1(Kᵢ)
2      k > 2        (K0,K1,K2) and (K0,K2,K1), if the three differ           2ΣF1 + O(b,c)+O(a,b)+O(c,a)
3      k > 1        ordered pairs (a,b) of all K with a ≠ b, loop order      O(a,b)+2F1(a)+2F1(b)+I(a)+I(b)
4      k = 1        one: kw'                                                 3I(kw')+F2(kw')+I(up)+I(low)+I(cap)
=====  ===========  =======================================================  ==============================

Every pattern keeps its top ``N`` chunks with score ≥ 1 (score desc, ``chunk_id`` asc).  A chunk's first
appearance is its smallest ``(tier, pattern_no, rank)``; the first ``M`` by first appearance are the hits.
(The other four tier-2 permutations are rotations of these two and never add a hit.)

Plan shape.  Search terms are matched against the vocabulary by equi-joins (see :mod:`docquery.operators.match`) and become
bit masks per (token, query): bit ``kw_no`` of ``fm`` for ``F``, of ``im`` for ``I``.  A chunk's tokens lie in one row with its text; the masks of a
block of queries are broadcast and joined by (query, chunk) with ``bit_or`` in the task that reads the chunk (:mod:`docquery.operators.scan`).  These
rows, queries times chunks in number, are made twice and neither shuffled nor stored.  Everything after that works on classes of chunks with equal masks:

* every pattern is an expression over the masks, so its score is the same for all chunks of a class;
* ``O`` needs the text.  Per pattern, the N-th largest score without ``O`` is a floor, and only chunks of classes whose
  largest possible score reaches a floor have their text read, in the same task: ``O(x, y)`` holds if the first ``x``
  ends before the last ``y`` begins;
* of chunks with equal masks and equal ``O`` only the N smallest ids can enter any top N, so the rest leaves before
  patterns are expanded.

Terms of wildcards only hold for a chunk by its lengths alone: the N smallest chunks per outcome stand for all others, so they
never make a row for every query and chunk.  Queries with such terms join the postings, dealt by chunk, in blocks of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquery.config import RetrievalConfig
from docquery.functions.keywords import capitalize, like_body, py_title, wildcard_form
from docquery.operators.match import _longest_run, match_terms, postings, vocabulary
from docquery.operators.scan import count_classes, masks_by_token, reach_of, reached_chunks, whole_chunks
from docquery.session import broadcast_if_small, cut_lineage, value_bytes

ALL_TIERS = (1, 2, 3, 4)
BLOCK_BYTES = 256 << 20  # token masks of the queries that are served together, as counted by value_bytes; as arrays they take a fifth and are broadcast
JOIN_BYTES = 16 << 20  # the same for queries that join the postings: their masks are broadcast as rows

def keyword_table(queries: DataFrame) -> DataFrame:
    """``query_id, context_id, nk, kw_no, kw, kwp, kt`` (nk = keyword count, kt = title form) – one row per keyword position (narrow)."""
    q = queries.select("query_id", "context_id", F.col("keywords"), F.size("keywords").alias("nk"))
    kw = q.select("query_id", "context_id", "nk", F.posexplode("keywords").alias("kw_no", "kw"))
    return (kw.withColumn("kwp", wildcard_form("kw"))
              .withColumn("kt", py_title(F.col("kwp"))))


def term_requests(kw: DataFrame) -> DataFrame:
    """``query_id, context_id, bit, term, d`` – the search terms of a query; bit = keyword number, or for the one keyword of a
    query its forms as written, upper, lower and capitalised."""
    multi = kw.where("nk >= 2").select("query_id", "context_id", F.col("kw_no").alias("bit"), F.col("kt").alias("term"), F.lit(1).alias("d"))
    forms = [(F.col("kwp"), 2), (F.upper("kwp"), 0), (F.lower("kwp"), 0), (capitalize(F.col("kwp")), 0)]
    single = kw.where("nk = 1").select("query_id", "context_id", F.posexplode(F.array(*[
        F.struct(term.alias("term"), F.lit(d).alias("d")) for term, d in forms])).alias("bit", "r")).select("query_id", "context_id", "bit", "r.term", "r.d")
    return multi.unionByName(single)


def tier3_pairs(kw: DataFrame) -> DataFrame:
    """U5 (pairs): ``query_id, pattern_no, a_no, b_no`` for i ≠ j and Kᵢ ≠ Kⱼ, numbered in loop order."""
    a = kw.where("nk > 1").select("query_id", F.col("kw_no").alias("a_no"), F.col("kt").alias("a"))
    b = kw.where("nk > 1").select("query_id", F.col("kw_no").alias("b_no"), F.col("kt").alias("b"))
    w = Window.partitionBy("query_id").orderBy("a_no", "b_no")
    return (a.join(b, "query_id").where("a_no != b_no AND a != b")
             .withColumn("pattern_no", F.row_number().over(w))
             .select("query_id", "pattern_no", "a_no", "b_no"))


def tier2_triples(kw: DataFrame) -> DataFrame:
    """U5 (triples): ordered triples of the first three keywords, pairwise different, loop order."""
    f3 = kw.where("nk > 2 AND kw_no < 3").select("query_id", "kw_no", "kt")
    a = f3.select("query_id", F.col("kw_no").alias("a_no"), F.col("kt").alias("a"))
    b = f3.select("query_id", F.col("kw_no").alias("b_no"), F.col("kt").alias("b"))
    c = f3.select("query_id", F.col("kw_no").alias("c_no"), F.col("kt").alias("c"))
    w = Window.partitionBy("query_id").orderBy("a_no", "b_no", "c_no")
    return (a.join(b, "query_id").join(c, "query_id")
             .where("a != b AND a != c AND b != c")
             .withColumn("pattern_no", F.row_number().over(w))
             .select("query_id", "pattern_no", "a", "b", "c"))


def search_patterns(kw: DataFrame, tiers: tuple[int, ...] = ALL_TIERS) -> DataFrame:
    """``query_id, tier, pattern_no, a, b, c`` – the patterns of every query; a, b, c are keyword numbers (tiers 2 and 3)."""
    one = kw.where("kw_no = 0").select("query_id", "nk")
    none = F.lit(None).cast("int")
    parts = []
    if 1 in tiers:
        parts.append(one.where("nk > 3").select("query_id", F.lit(1).alias("tier"), F.lit(1).alias("pattern_no"),
                                                none.alias("a"), none.alias("b"), none.alias("c")))
    if 2 in tiers:
        three = kw.where("nk > 2 AND kw_no < 3").groupBy("query_id").agg(F.countDistinct("kt").alias("n")).where("n = 3")
        turns = F.array(*[F.struct(F.lit(p).alias("pattern_no"), F.lit(0).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c"))
                          for p, b, c in [(1, 1, 2), (2, 2, 1)]])
        parts.append(three.select("query_id", F.lit(2).alias("tier"), F.explode(turns).alias("t")).select("query_id", "tier", "t.*"))
    if 3 in tiers:
        parts.append(tier3_pairs(kw).select("query_id", F.lit(3).alias("tier"), "pattern_no", F.col("a_no").alias("a"),
                                            F.col("b_no").alias("b"), none.alias("c")))
    if 4 in tiers:
        parts.append(one.where("nk = 1").select("query_id", F.lit(4).alias("tier"), F.lit(1).alias("pattern_no"),
                                                none.alias("a"), none.alias("b"), none.alias("c")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _at(i) -> Column:
    """The mask with bit ``i`` alone."""
    return F.call_function("shiftleft", F.lit(1), i)


def _bit(mask: Column, i) -> Column:
    return F.call_function("shiftright", mask, i if isinstance(i, Column) else F.lit(i)).bitwiseAND(F.lit(1))


def pattern_score(fm: Column, im: Column, order) -> Column:
    """Score of the row's pattern (``tier, a, b, c``) from the masks; ``order(x, y)`` gives ``O(x, y)`` as 0 or 1."""
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    f = lambda k: _bit(fm, k)
    i = lambda k: _bit(im, k)
    return (F.when(F.col("tier") == 1, F.bit_count(fm))
             .when(F.col("tier") == 2, 2 * (f(a) + f(b) + f(c)) + order(b, c) + order(a, b) + order(c, a))
             .when(F.col("tier") == 3, order(a, b) + 2 * f(a) + 2 * f(b) + i(a) + i(b))
             .otherwise(3 * i(0) + f(0) + i(1) + i(2) + i(3))).cast("int")


def token_masks(req: DataFrame, matches: DataFrame) -> DataFrame:
    """``token, query_id, q_ctx, fm, im, cm`` – what a token means for a query.

    ``cm`` marks terms with a wildcard whose longest literal run the token holds: their chunk-level ``LIKE`` is
    still to be checked on the text.
    """
    bit = _at(F.col("bit"))
    r = req.withColumnRenamed("context_id", "q_ctx")
    zero = F.lit(0)
    wild = F.col("term").contains("?")
    near = F.col("tok_contains") | (F.coalesce("lev", F.lit(99)) <= F.col("d"))
    own = r.join(matches, "term").select("token", "query_id", "q_ctx", F.when(near, bit).otherwise(zero).alias("fm"),
                                         F.when(F.col("tok_contains") & ~wild, bit).otherwise(zero).alias("im"), zero.alias("cm"))
    held = (r.where(wild).withColumn("term", _longest_run(F.col("term"))).where("term != ''")
             .join(matches.where("tok_contains"), "term")
             .select("token", "query_id", "q_ctx", zero.alias("fm"), zero.alias("im"), bit.alias("cm")))
    return (own.unionByName(held).groupBy("token", "query_id", "q_ctx")
               .agg(*[F.bit_or(m).alias(m) for m in ("fm", "im", "cm")]).where("(fm | im | cm) != 0"))


def _lengths_flags(n: Column, d: Column) -> tuple[Column, Column]:
    """(F, I) of a term of ``n`` wildcards for a chunk with ``clen, longest, shortest`` (characters, token lengths)."""
    f = (F.col("longest") >= n) | ((n <= d) & (F.col("shortest") <= d))
    return F.coalesce(f, F.lit(False)), F.col("clen") >= n


def wildcard_rows(wild: DataFrame, chunks: DataFrame, post: DataFrame, reach: int, n: int) -> tuple[DataFrame, DataFrame]:
    """Terms of up to ``reach`` wildcards only (``query_id, context_id, bit, term, d``): (mask rows of the chunks that stand for all,
    lengths of every chunk).

    What such terms give a chunk, alone or in order, follows from its length, its longest and its shortest token, as far
    as those matter.  A chunk that other terms hit too never scores less, so of a context's chunks equal in these
    lengths the ``n`` smallest ids bring up everything that can enter a top ``n``.
    """
    lengths = (chunks.select("context_id", "chunk_id", F.char_length("chunk_text").alias("clen"))
               .join(post.groupBy("chunk_id").agg(F.max(F.char_length("token")).alias("longest"), F.min(F.char_length("token")).alias("shortest")),
                     "chunk_id", "left"))
    alike = ["context_id", F.least("clen", F.lit(2 * reach)), F.least("longest", F.lit(reach)), F.least("shortest", F.lit(3))]
    least = lengths.withColumn("r", F.row_number().over(Window.partitionBy(*alike).orderBy("chunk_id"))).where(F.col("r") <= n).drop("r")
    asked = wild.withColumnRenamed("context_id", "q_ctx")
    scoped = asked.where("q_ctx IS NOT NULL").join(least, F.col("q_ctx") == F.col("context_id"))
    everywhere = asked.where("q_ctx IS NULL").withColumn("one", F.lit(1)).join(least.withColumn("one", F.lit(1)), "one").drop("one")
    f, i = _lengths_flags(F.char_length("term"), F.col("d"))
    bit = _at(F.col("bit"))
    rows = scoped.unionByName(everywhere).select("query_id", "chunk_id", F.when(f, bit).otherwise(0).alias("fm"),
                                                 F.when(i, bit).otherwise(0).alias("im"), F.lit(0).alias("cm")).where("(fm | im) != 0")
    return rows, lengths


def query_masks(kw: DataFrame, vocab: DataFrame, grams: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(:func:`token_masks` of all queries, stored; the terms of wildcards only, ``query_id, context_id, bit, term, d``)."""
    req = term_requests(kw)
    wild = req.where(_longest_run(F.col("term")) == "")
    req = req.where(_longest_run(F.col("term")) != "")
    runs = req.where(F.col("term").contains("?")).select(_longest_run(F.col("term")).alias("term"), F.lit(0).alias("d"))
    return cut_lineage(token_masks(req, match_terms(req.select("term", "d").unionByName(runs), vocab, grams))), cut_lineage(wild)


def chunk_masks(masks: DataFrame, wild: DataFrame, chunks: DataFrame, post: DataFrame, n: int = RetrievalConfig().max_results_per_search) -> DataFrame:
    """``query_id, chunk_id, fm, im, cm`` of every chunk with a flag.

    With postings that lie by chunk (:meth:`Store.postings`) and masks that are broadcast, nothing is shuffled: the rows of a
    query and a chunk meet in the task that holds the chunk."""
    reach = wild.agg(F.max(F.char_length("term"))).first()[0]  # null: no such term (one number comes to the driver)
    rows = (post.join(masks, "token").where("q_ctx IS NULL OR q_ctx = context_id")
                .select("query_id", "chunk_id", "fm", "im", "cm"))
    if reach:
        least, lengths = wildcard_rows(wild, chunks, post, reach, n)
        rows = rows.unionByName(least)
    out = rows.groupBy("query_id", "chunk_id").agg(*[F.bit_or(m).alias(m) for m in ("fm", "im", "cm")])
    if reach:  # the chunks that other terms brought up
        f, i = _lengths_flags(F.char_length("term"), F.col("d"))
        bit = _at(F.col("bit"))
        add = (out.select("query_id", "chunk_id").join(wild.select("query_id", "bit", "term", "d"), "query_id").join(lengths, "chunk_id")
               .groupBy("query_id", "chunk_id").agg(F.bit_or(F.when(f, bit).otherwise(0)).alias("wf"), F.bit_or(F.when(i, bit).otherwise(0)).alias("wi")))
        zero = F.lit(0)
        out = out.join(add, ["query_id", "chunk_id"], "left").select(
            "query_id", "chunk_id", F.col("fm").bitwiseOR(F.coalesce("wf", zero)).alias("fm"), F.col("im").bitwiseOR(F.coalesce("wi", zero)).alias("im"), "cm")
    return out


MASKS = ["query_id", "fm", "im", "cm"]


def classes_in_reach(sizes: DataFrame, patterns: DataFrame, n: int) -> DataFrame:
    """Of the classes with their numbers of ``chunks``, those (``query_id, fm, im, cm, open``) that reach the floor of some pattern, the n-th largest score that is certain;
    ``open``: some such pattern's score is open, so the chunks of the class need their text."""
    most = F.col("im").bitwiseOR(F.col("cm"))
    scored = sizes.join(patterns, "query_id").select(
        *MASKS, "chunks", "tier", "pattern_no", pattern_score(F.col("fm"), F.col("im"), lambda x, y: F.lit(0)).alias("low"),
        pattern_score(F.col("fm"), most, lambda x, y: _bit(most, x) * _bit(most, y)).alias("high")).where("high >= 1")
    down = Window.partitionBy("query_id", "tier", "pattern_no").orderBy(F.desc("low"))
    counted = scored.withColumn("upto", F.sum("chunks").over(down.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    every = Window.partitionBy("query_id", "tier", "pattern_no")
    floor = F.coalesce(F.max(F.when(F.col("upto") >= n, F.col("low"))).over(every), F.lit(1))
    return (counted.withColumn("floor", floor).where("high >= floor")
            .groupBy(*MASKS).agg(F.max(F.col("high") > F.col("low")).alias("open")))


def read_orders(rows: DataFrame, terms: DataFrame, chunks: DataFrame) -> DataFrame:
    """``query_id, chunk_id, fm, im, o``; of ``open`` rows from the texts: open wildcard terms decided, and ``o[x]`` has bit ``y``
    where ``O(x, y)``.  Other rows are not joined with a text and have an empty ``o``."""
    text = chunks.select(F.col("chunk_id").alias("_id"), "chunk_text")
    t, x = F.col("chunk_text"), F.col("x")
    # the first and the last place of every keyword (1-based, 0 if absent)
    rows = rows.join(terms, "query_id").join(text, (F.col("chunk_id") == F.col("_id")) & F.col("open"), "left")
    rows = rows.where("NOT open OR _id IS NOT NULL")
    rows = rows.withColumn("back", F.reverse("chunk_text"))
    first = lambda k: F.position(k, t)
    last = lambda k: F.char_length(t) - F.position(F.reverse(k), F.col("back")) - F.char_length(k) + 2
    rows = rows.withColumn("p", F.transform("terms", lambda k: F.struct(
        k.alias("k"), first(k).alias("first"), F.when(first(k) > 0, last(k)).otherwise(0).alias("last"))))
    rows = rows.withColumn("im", F.aggregate(
        F.sequence(F.lit(0), F.size("terms") - 1), F.col("im").cast("int"),
        lambda acc, i: F.when((_bit(F.col("cm"), i) == 1) & F.like(t, F.concat(F.lit("%"), like_body(F.get("terms", i)), F.lit("%"))),
                              acc.bitwiseOR(_at(i))).otherwise(acc)))
    im = F.col("im")

    def ordered(a, b):
        wild = a["k"].contains("?") | b["k"].contains("?")
        pattern = F.concat(F.lit("%"), like_body(a["k"]), F.lit("%"), like_body(b["k"]), F.lit("%"))
        plain = (a["first"] > 0) & (b["last"] > 0) & (a["first"] + F.char_length(a["k"]) <= b["last"])
        return F.when(wild, F.like(t, pattern)).otherwise(plain)

    o = F.transform("p", lambda a, i: F.aggregate(
        F.transform("p", lambda b, j: F.when((i != j) & (_bit(im, i) == 1) & (_bit(im, j) == 1) & ordered(a, b), _at(j)).otherwise(0)),
        F.lit(0), lambda acc, v: acc.bitwiseOR(v)))
    return rows.select("query_id", "chunk_id", "fm", "im", F.when(F.col("open"), o).otherwise(F.array().cast("array<int>")).alias("o"))


def best_of(found: DataFrame, patterns: DataFrame, n: int) -> DataFrame:
    """Top n of every pattern among the ``found`` rows (``query_id, chunk_id, fm, im, o``)."""
    alike = Window.partitionBy("query_id", "fm", "im", "o").orderBy("chunk_id")
    found = found.withColumn("r", F.row_number().over(alike)).where(F.col("r") <= n).drop("r")
    order = lambda x, y: F.coalesce(_bit(F.get("o", x), y), F.lit(0))
    scored = (found.join(patterns, "query_id").withColumn("score", pattern_score(F.col("fm"), F.col("im"), order)).where("score >= 1")
              .select("query_id", "tier", "pattern_no", "chunk_id", "score"))
    w = Window.partitionBy("query_id", "tier", "pattern_no").orderBy(F.desc("score"), F.asc("chunk_id"))
    return (scored.withColumn("rank", F.row_number().over(w))
                  .where(F.col("rank") <= n)
                  .select("query_id", "tier", "pattern_no", "rank", "score", "chunk_id"))


def scan_hits(masks: DataFrame, patterns: DataFrame, terms: DataFrame, whole: DataFrame, n: int) -> DataFrame:
    """Top n of the patterns of one block of queries, stored.

    The chunks are read twice, first to count the classes, then for those in reach.  Masks and classes of the block go to
    the tasks as arrays."""
    sc = masks.sparkSession.sparkContext
    arrays = masks_by_token(masks)
    kind = masks.schema["query_id"].dataType.simpleString()
    sent = sc.broadcast(arrays)
    counted = whole.select("context_id", "tokens").mapInArrow(lambda batches: count_classes(batches, sent.value), f"query_id {kind}, fm int, im int, cm int, chunks long")
    classes = cut_lineage(classes_in_reach(counted.groupBy(*MASKS).agg(F.sum("chunks").alias("chunks")), patterns, n))
    near = sc.broadcast(reach_of(classes, terms, arrays))
    found = whole.sortWithinPartitions("chunk_id").mapInArrow(lambda batches: reached_chunks(batches, sent.value, near.value, n),
                                                              f"query_id {kind}, chunk_id string, fm int, im int, o array<int>")
    hits = cut_lineage(best_of(found, patterns, n))
    sent.destroy()
    near.destroy()
    return hits


def block_hits(masks: DataFrame, wild: DataFrame, patterns: DataFrame, terms: DataFrame, chunks: DataFrame, post: DataFrame, n: int) -> DataFrame:
    """Top n of the patterns of one block of queries, some of whose terms are wildcards only.

    The rows of (query, chunk) are made where they are used and never stored: first counted by class, then made again for the
    classes in reach; what leaves a task are class counts and at most n chunks of a class."""
    rows = chunk_masks(masks, wild, chunks, post, n)
    classes = broadcast_if_small(cut_lineage(classes_in_reach(rows.groupBy(*MASKS).agg(F.count(F.lit(1)).alias("chunks")), patterns, n)))
    found = rows.join(classes, MASKS)
    if classes.where("open").isEmpty():
        found = found.select("query_id", "chunk_id", "fm", "im", F.array().cast("array<int>").alias("o"))
    else:
        found = read_orders(found, broadcast_if_small(terms), chunks)
    return best_of(found, patterns, n)


def pattern_hits(queries: DataFrame, chunks: DataFrame, cfg: RetrievalConfig = RetrievalConfig(),
                 post: DataFrame | None = None, vocab: DataFrame | None = None, grams: DataFrame | None = None,
                 tiers: tuple[int, ...] = ALL_TIERS, block_bytes: int = BLOCK_BYTES, whole: DataFrame | None = None) -> DataFrame:
    """``query_id, tier, pattern_no, rank, score, chunk_id`` – top N of every search pattern of the given tiers.

    ``post, vocab, grams, whole``: a stored index of ``chunks`` (:mod:`docquery.operators.store`); without it the chunks are tokenised here.
    Queries whose token masks take more than ``block_bytes`` together are served in blocks, one after the other.
    """
    n = cfg.max_results_per_search
    served = [{1: "nk > 3", 2: "nk > 2", 3: "nk > 1", 4: "nk = 1"}[t] for t in tiers]
    # keyword rows, patterns and token masks are read several times below: materialise them once in the shared checkpoint
    # folder (also bounds recomputation after an executor loss and keeps plans small)
    kw = cut_lineage(keyword_table(queries).where(" OR ".join(served)))
    patterns = cut_lineage(search_patterns(kw, tiers))
    post = cut_lineage(postings(chunks)) if post is None else post
    vocab = cut_lineage(vocabulary(post)) if vocab is None else vocab
    masks, wild = query_masks(kw, vocab, grams)
    terms = cut_lineage(term_requests(kw).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("bit", "term"))).alias("t"))
                        .select("query_id", F.transform("t", lambda e: e["term"]).alias("terms")))
    whole = whole_chunks(chunks) if whole is None else whole
    # queries with terms of wildcards only need rows from two sides: they are blocks of their own, so the others stay unshuffled
    odd = F.broadcast(wild.select("query_id").distinct())
    kinds = [""] if wild.isEmpty() else ["left_anti", "left_semi"]
    out = None
    for kind in kinds:
        parts = [p.join(odd, "query_id", kind) if kind else p for p in (masks, wild, patterns, terms)]
        most = min(block_bytes, JOIN_BYTES) if kind == "left_semi" else block_bytes
        blocks = value_bytes(parts[0]) // most + 1
        of = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
        for k in range(blocks):
            own = [p.where(of == k) for p in parts]
            if kind == "left_semi":
                hits = cut_lineage(block_hits(broadcast_if_small(own[0], 2 * most), *own[1:], chunks, post, n))
            else:
                hits = scan_hits(own[0], own[2], own[3], whole, n)
            out = hits if out is None else out.unionByName(hits)
    return out


def search_cascade(queries: DataFrame, chunks: DataFrame, cfg: RetrievalConfig = RetrievalConfig(),
                   post: DataFrame | None = None, vocab: DataFrame | None = None, grams: DataFrame | None = None,
                   whole: DataFrame | None = None) -> DataFrame:
    """``query_id, pos, tier, pattern_no, rank, score, chunk_id`` – first M hits per query.

    ``queries``: ``query_id, context_id (null = every context), keywords array<string>``.
    """
    ph = cut_lineage(pattern_hits(queries, chunks, cfg, post, vocab, grams, whole=whole))
    first = (ph.groupBy("query_id", "chunk_id")
               .agg(F.min(F.struct("tier", "pattern_no", "rank", "score")).alias("f")))
    w = Window.partitionBy("query_id").orderBy("f.tier", "f.pattern_no", "f.rank")
    return (first.withColumn("pos", F.row_number().over(w))
                 .where(F.col("pos") <= cfg.max_search_results)
                 .select("query_id", "pos", "f.tier", "f.pattern_no", "f.rank", "f.score", "chunk_id"))


def missing_vectors(hits: DataFrame, vectors: DataFrame) -> DataFrame:
    """J4 report: hits whose chunk has no stored vector (``query_id, pos, chunk_id``)."""
    have = vectors.where("chunk_vector IS NOT NULL").select("chunk_id")
    return hits.join(have, "chunk_id", "left_anti").select("query_id", "pos", "chunk_id")


def attach_chunks(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hit rows + chunk columns + ``page_text`` (newline-flattened). Inner equi-join on chunk_id."""
    from docquery.functions.text import flatten_newlines
    return (hits.join(chunks, "chunk_id")
                .withColumn("page_text", flatten_newlines(F.col("chunk_text"))))
