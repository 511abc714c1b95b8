"""Vocabulary, postings and the keyword × token theta join.

A search term ``x`` (ASCII, ``?`` = one-character wildcard) matches a vocabulary token ``t`` when
``t LIKE '%x%'`` (*contains*) or ``levenshtein(t, x) <= d`` (*fuzzy*, d ∈ {1, 2}).  Neither test is
evaluated as vocabulary × terms: both are turned into equi-joins that Spark can hash-partition,

* fuzzy: symmetric deletion neighbourhoods (every string reachable by deleting up to ``d``
  characters) of term and token share a member whenever the edit distance is ≤ d; the join on that
  member gives a small candidate set which ``levenshtein(t, x, d)`` then verifies exactly;
* contains: a token containing ``x`` contains every 3-gram of ``x``'s literal runs.  A term joins on the one
  that the fewest tokens hold (their numbers are stored with the vocabulary), with filters on the length of
  the token and the place of the gram in it; the place also says where ``x`` would start, and only there it is verified.  Terms without a
  3-character literal run join on a 1- or 2-gram of their longest run, or – all wildcards – on a length
  key; there is no nested loop and no cross join anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquery.functions.vectors import tokens
from docquery.session import broadcast_if_small, cut_lineage


def postings(chunks: DataFrame) -> DataFrame:
    """J2 input: one row per distinct token per chunk: ``context_id, chunk_id, token``. Narrow."""
    return chunks.select("context_id", "chunk_id",
                         F.explode(F.array_distinct(tokens(F.col("chunk_text")))).alias("token"))


def build_search_index(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings and vocabulary of a chunk table for one session, each materialised once in the checkpoint folder.

    :mod:`docquery.operators.store` keeps them by context, over sessions; pass either to every query batch
    (``search_cascade(..., post=, vocab=)``) instead of re-tokenising the chunks per batch.
    """
    post = cut_lineage(postings(chunks))
    return post, cut_lineage(vocabulary(post))


def vocabulary(post: DataFrame) -> DataFrame:
    """Distinct tokens (map-side partial distinct, one shuffle on ``token``), spread over
    ``spark.sql.shuffle.partitions`` tasks.

    The distinct vocabulary is small in bytes, so AQE would coalesce it into a couple of partitions;
    the deletion-variant and n-gram explodes that follow multiply every token by up to ~50 rows, so
    the vocabulary is re-spread with a fixed partition count (which AQE does not coalesce).
    """
    n = int(post.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return post.select("token").distinct().repartition(n)


def _deletion_rows(df: DataFrame, s: str, d: str, out: str = "variant") -> DataFrame:
    """One row per way of deleting up to ``d`` (0..2) characters of ``s``: ``df`` columns + ``out``.

    Deletion positions come from two ``explode``s over position sequences (``i = 0`` means no
    deletion), and the variant is a ``concat`` of ``substring``s – plain expressions that stay inside
    whole-stage code generation.  Duplicates (repeated letters) are left in; the caller's verified
    matches are de-duplicated by their grouping.
    """
    n = F.char_length(F.col(s))
    i, j, x = F.col("_i"), F.col("_j"), F.col(s)
    # i = first deleted position (0: none); j = second deleted position, j = i meaning none
    pos = (df.withColumn("_i", F.explode(F.sequence(F.lit(0), F.when(F.col(d) >= 1, n).otherwise(F.lit(0)))))
             .withColumn("_j", F.explode(F.sequence(i, F.when((F.col(d) >= 2) & (i >= 1), n).otherwise(i)))))
    big = F.lit(1 << 30)
    one = F.concat(F.substring(x, 1, i - 1), F.substring(x, i + 1, big))
    two = F.concat(F.substring(x, 1, i - 1), F.substring(x, i + 1, j - i - 1), F.substring(x, j + 1, big))
    v = F.when(i == 0, x).when(j == i, one).otherwise(two)
    return pos.withColumn(out, v).drop("_i", "_j")


def _longest_run(term: Column) -> Column:
    """The first longest ``?``-free run of a search term (empty when the term is all wildcards)."""
    runs = F.split(term, r"\?")
    return F.aggregate(runs, F.lit(""), lambda acc, r: F.when(F.char_length(r) > F.char_length(acc), r)
                       .otherwise(acc))


def token_grams(vocab: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``gram, place, token, tlen`` (and ``keys``) – every 3-gram of every token with its 1-based place."""
    keys = keys or []
    v = vocab.select(*keys, "token", F.char_length("token").alias("tlen")).where("tlen >= 3")
    return (v.select(*keys, "token", "tlen", F.explode(F.sequence(F.lit(1), F.col("tlen") - 2)).alias("place"))
             .select(*keys, F.substring("token", F.col("place"), 3).alias("gram"), "place", "token", "tlen"))


def gram_counts(vocab: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``gram, n`` (by ``keys``) – how often a 3-gram occurs in the vocabulary (stored beside it by the index)."""
    return token_grams(vocab, keys).groupBy(*(keys or []), "gram").agg(F.count(F.lit(1)).alias("n"))


def rarest_grams(terms: DataFrame, counts: DataFrame) -> DataFrame:
    """``term, gram, place, xlen`` – of each term the literal 3-gram that occurs least (ties: the first); terms without one are left out."""
    x = terms.select("term", F.char_length("term").alias("xlen")).where("xlen >= 3")
    own = (x.select("term", "xlen", F.explode(F.sequence(F.lit(1), F.col("xlen") - 2)).alias("place"))
            .select("term", "xlen", "place", F.substring("term", F.col("place"), 3).alias("gram")).where(~F.col("gram").contains("?")))
    return (own.join(counts, "gram", "left").groupBy("term", "xlen")
               .agg(F.min_by(F.struct("gram", "place"), F.struct(F.coalesce("n", F.lit(0)).alias("n"), "place")).alias("g"))
               .select("term", "xlen", "g.gram", "g.place"))


def match_terms(terms: DataFrame, vocab: DataFrame, grams: DataFrame | None = None) -> DataFrame:
    """Theta join of ``terms(term, d)`` with ``vocab(token)``; ``grams`` = stored :func:`gram_counts` of the vocabulary.

    Returns ``term, token, tok_contains boolean, lev int`` (``lev`` null when only contained).
    """
    t = cut_lineage(terms.groupBy("term").agg(F.max("d").alias("d")))
    v = vocab.select("token", F.char_length("token").alias("tlen"))

    # -- contains, terms with a literal 3-gram: equi-join on the rarest ------------------------------
    anchored = broadcast_if_small(cut_lineage(rarest_grams(t, gram_counts(vocab) if grams is None else grams)))
    start = F.col("place") - F.col("at") + 1
    c1 = (token_grams(vocab).join(anchored.withColumnRenamed("place", "at"), "gram")
          .where((F.col("tlen") >= F.col("xlen")) & (start >= 1) & (F.col("tlen") - start + 1 >= F.col("xlen")))
          .where(F.like(F.substring("token", start, F.col("xlen")), F.replace("term", F.lit("?"), F.lit("_"))))
          .select("term", "token"))
    # -- contains, other terms: equi-join on a short key -----------------------------------------
    # longest literal run of 1 or 2 characters → that run as a 1-/2-gram key; only wildcards → a
    # length key (a token of length n carries L:1 .. L:n).  Candidates are verified by LIKE.
    run = _longest_run(F.col("term"))
    short = cut_lineage(t.join(anchored.select("term"), "term", "left_anti")
              .select("term", F.when(F.char_length(run) == 0,
                                     F.concat(F.lit("L:"), F.char_length("term").cast("string")))
                               .otherwise(F.concat(F.char_length(run).cast("string"), F.lit(":"), run))
                       .alias("key")))
    o = F.col("_o")
    # tokens carry only the kinds of keys that the terms ask for (at most three kinds)
    carried = {"1": F.concat(F.lit("1:"), F.substring("token", o, 1)),
               "2": F.when(o < F.col("tlen"), F.concat(F.lit("2:"), F.substring("token", o, 2))),
               "L": F.concat(F.lit("L:"), o.cast("string"))}
    kinds = sorted(r["kind"] for r in short.select(F.substring("key", 1, 1).alias("kind")).distinct().collect())
    contains = c1
    if kinds:
        tkeys = (v.select("token", "tlen", F.explode(F.sequence(F.lit(1), F.col("tlen"))).alias("_o"))
                  .select("token", F.explode(F.array(*[carried[k] for k in kinds])).alias("key"))
                  .where("key IS NOT NULL"))
        contains = c1.unionByName(tkeys.join(broadcast_if_small(short), "key")
                                  .where(F.expr("token LIKE concat('%', replace(term, '?', '_'), '%')"))
                                  .select("term", "token"))
    contains = contains.select("term", "token", F.lit(True).alias("tok_contains"),
                                         F.lit(None).cast("int").alias("lev"))

    # -- fuzzy: symmetric deletion neighbourhoods, equi-join, verify ------------------------------
    ft = t.where("d >= 1").select("term", "d", F.char_length("term").alias("xlen"))
    need = (ft.select(F.explode(F.sequence(F.greatest(F.col("xlen") - F.col("d"), F.lit(1)),
                                           F.col("xlen") + F.col("d"))).alias("tlen"), "d")
              .groupBy("tlen").agg(F.max("d").alias("vd")))
    tv = broadcast_if_small(cut_lineage(_deletion_rows(ft.select("term", "d"), "term", "d").distinct()))
    # ``need`` holds one row per token length a term can reach (at most the longest term + 2 rows),
    # so it is broadcast: a shuffle join on the ~30 distinct lengths would pack the vocabulary into a
    # few tasks right before its largest explode
    vv = _deletion_rows(v.join(F.broadcast(need), "tlen").select("token", "vd"), "token", "vd") \
        .select("token", "variant")
    fuzzy = (vv.join(tv, "variant")
               .select("term", "token", F.expr("levenshtein(token, term, d)").alias("lev"))
               .where("lev >= 0")
               .select("term", "token", F.lit(False).alias("tok_contains"), "lev"))

    return (contains.unionByName(fuzzy)
                    .groupBy("term", "token")
                    .agg(F.max("tok_contains").alias("tok_contains"), F.min("lev").alias("lev")))
