"""Cosine re-rank of hits with threshold, top-k, score collisions and citations.

N12 (the reference keeps answers in a dict keyed by score): keep hits with score > threshold; a score
survives when fewer than ``answers_limit`` hits score strictly higher (rank with duplicates counted);
equal scores collapse to one row – the one with the largest position – shown at the smallest position
of that score.  Verdicts (model yes/no per hit) filter survivors; answer numbers follow position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquery.config import RetrievalConfig
from docquery.functions.text import citation, flatten_newlines, split_response, verdict_flag
from docquery.functions.vectors import with_embedding, with_sparse_cosine
from docquery.session import broadcast_if_small, cut_lineage

HIT_IDS = 64 << 20  # bytes of the hits' chunk ids up to which they are broadcast (760,000 ids of 64 characters)


def score_hits(hits: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """P18 on hits: ``relevance`` = cosine of the query text and the hit's page text (N9 vectors).

    Only hit chunks are read back (join on ``chunk_id``): the others leave where they are read, unless the ids of the hits exceed
    ``HIT_IDS``, when the texts of all are shuffled once.  Chunk vectors are taken from the chunk table
    when present, otherwise computed for the hits alone.
    """
    cols = ["chunk_id", "title", "author", "chapter", "page_number", "chunk_number", "chunk_text"]
    if "chunk_vector" in chunks.columns:
        cols += ["chunk_vector", "vector_norm2"]
    ids = cut_lineage(hits.select("chunk_id").distinct())
    few = broadcast_if_small(ids, HIT_IDS)
    h = hits.join(chunks.select(*cols) if few is ids else chunks.select(*cols).join(few, "chunk_id", "left_semi"), "chunk_id")
    if "chunk_vector" not in chunks.columns:
        h = with_embedding(h, "chunk_text", "chunk_vector", "vector_norm2")
    qv = with_embedding(queries.select("query_id", "query_text"), "query_text", "query_vector", "query_norm2")
    j = with_sparse_cosine(h.join(qv, "query_id"), "query_vector", "chunk_vector", "query_norm2", "vector_norm2",
                           "relevance")
    out = (j.withColumn("page_text", flatten_newlines(F.col("chunk_text")))
            .drop("chunk_vector", "query_vector", "query_norm2", "vector_norm2", "chunk_text", "query_text"))
    # Materialise (at most M rows per query): a later filter on ``relevance`` would otherwise be pushed
    # through the projections and re-inline the staged vector arrays into per-element lambdas.
    return cut_lineage(out)


def rerank(scored: DataFrame, cfg: RetrievalConfig = RetrievalConfig(),
           verdicts: DataFrame | None = None, responses: DataFrame | None = None) -> DataFrame:
    """``query_id, answer_no, pos, chunk_id, relevance, source, text`` – answers per query.

    ``scored``: hits with ``pos, relevance`` and chunk columns.  ``verdicts``: optional
    ``(query_id, chunk_id, text)`` model verdicts; without it every survivor is kept.  ``responses``: optional
    ``(query_id, chunk_id, text)`` model answers (J8); a hit with one shows it instead of its page text.
    """
    kept = scored.where(F.col("relevance") > F.lit(cfg.score_threshold))
    w = Window.partitionBy("query_id").orderBy(F.desc("relevance"))
    top = kept.withColumn("r", F.rank().over(w)).where(F.col("r") <= cfg.answers_limit)
    payload = F.struct("pos", "chunk_id", "title", "author", "chapter", "page_number", "page_text")
    coll = (top.groupBy("query_id", "relevance")
               .agg(F.min("pos").alias("out_pos"), F.max_by(payload, F.col("pos")).alias("p"))
               .select("query_id", "relevance", "out_pos", "p.*"))
    if verdicts is not None:
        yes = verdicts.where(verdict_flag(F.col("text"))).select("query_id", "chunk_id").distinct()
        coll = coll.join(yes, ["query_id", "chunk_id"], "left_semi")
    if responses is not None:
        said = responses.groupBy("query_id", "chunk_id").agg(F.min("text").alias("said"))
        coll = (coll.join(said, ["query_id", "chunk_id"], "left")
                    .withColumn("page_text", F.coalesce("said", "page_text")).drop("said"))
    wn = Window.partitionBy("query_id").orderBy("out_pos")
    return (coll.withColumn("answer_no", F.row_number().over(wn))
                .select("query_id", "answer_no", F.col("out_pos").alias("pos"), "chunk_id", "relevance",
                        citation().alias("source"), F.col("page_text").alias("text")))


def answer_context(answers: DataFrame) -> DataFrame:
    """A4: per query, the answer texts (N5 split) joined as ``'\\n' + text + '\\n'`` in answer order, and sources."""
    agg = answers.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("answer_no", "text", "source"))).alias("a"))
    return agg.select("query_id",
                      F.array_join(F.transform("a", lambda e: F.concat(F.lit("\n"), split_response(e["text"]), F.lit("\n"))), "")
                      .alias("context_text"),
                      F.transform("a", lambda e: e["source"]).alias("sources"),
                      F.size("a").alias("n_answers"))
