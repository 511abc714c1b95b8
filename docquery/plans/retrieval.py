"""Ingest, query keywords, batch retrieval and batch re-rank as DataFrame plans."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquery.config import RetrievalConfig
from docquery.functions.keywords import sanitize_keywords
from docquery.functions.vectors import tokens
from docquery.operators.chunk import document_chunks
from docquery.operators.search import ALL_TIERS, pattern_hits, search_cascade
from docquery.operators.store import Store, load_contexts
from docquery.session import checkpoint_dir, cut_lineage

def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def rank_keywords(texts: DataFrame, store: Store, cfg: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """R2: ``query_id, context_id, query_text, keywords`` from ``texts`` (``query_id, query_text``).

    All words of the text are ranked by tf·idf over the chunks (ties: first place in the text) and go
    through N7, which keeps ``keywords_limit`` of them.  Word frequencies come from the stored vocabulary.  The context is the one whose chunks hold most of
    the text's words (ties: smallest id; null, meaning every context, if none holds any).
    """
    words = texts.select("query_id", F.posexplode(tokens(F.col("query_text"))).alias("pos", "token"))
    tf = cut_lineage(words.groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("tf"), F.min("pos").alias("pos")))
    found = cut_lineage(store.table("vocabulary").join(tf.select("token").distinct(), "token").select("token", "context_id", "df"))
    n = store.n_chunks()
    df = found.groupBy("token").agg(F.sum("df").alias("df"))
    weight = F.round(F.col("tf") * F.log(F.lit(n + 1.0) / (F.coalesce("df", F.lit(0)) + F.lit(1.0))), 9)
    ranked = (tf.join(df, "token", "left").groupBy("query_id")
              .agg(F.array_sort(F.collect_list(F.struct((-weight).alias("w"), "pos", "token"))).alias("ws"))
              .select("query_id", F.array_join(F.transform("ws", lambda x: x["token"]), ", ").alias("raw")))
    held = tf.join(found, "token").groupBy("query_id", "context_id").agg(F.count(F.lit(1)).alias("held"))
    context = held.groupBy("query_id").agg(F.min_by("context_id", F.struct((-F.col("held")).alias("h"), "context_id")).alias("context_id"))
    out = texts.select("query_id", "query_text").join(ranked, "query_id", "left").join(context, "query_id", "left")
    return out.select("query_id", "context_id", "query_text",
                      sanitize_keywords(F.coalesce("raw", F.lit("")), None, F.lit(cfg.keywords_limit)).alias("keywords"))


def benchmark_queries(benchmark: DataFrame, store: Store, cfg: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """Every benchmark text as a query with its context and keywords (:func:`rank_keywords`)."""
    texts = benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    return cut_lineage(rank_keywords(texts, store, cfg))


def single_keyword_queries(queries: DataFrame) -> DataFrame:
    """One query per keyword (``query_id * 100 + keyword number``): tier 4 serves queries of one keyword."""
    one = queries.select("query_id", "context_id", "query_text", F.posexplode("keywords").alias("no", "kw"))
    return one.select((F.col("query_id") * 100 + F.col("no")).alias("query_id"), "context_id", "query_text", F.array("kw").alias("keywords"))


def corpus_chunks(spark: SparkSession, sf_dir: str, with_vectors: bool = False,
                  keep_doc_id: bool = False) -> DataFrame:
    return document_chunks(load(spark, sf_dir, "documents"), with_vectors=with_vectors, keep_doc_id=keep_doc_id)


def indexed(spark: SparkSession, sf_dir: str, keep_doc_id: bool = False) -> Store:
    """Every document loaded into a new store (S9) in the shared folder: chunks and their index by context."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
    return load_contexts(spark, corpus_chunks(spark, sf_dir, keep_doc_id=keep_doc_id), path)


def _index_of(queries: DataFrame, store: Store) -> dict[str, DataFrame]:
    """Chunks, postings, vocabulary, gram counts and tokenised chunks of the contexts that the queries name (F6: only those are read)."""
    named = store.asked(queries)
    return {"chunks": store.table("chunks", named), "post": store.postings(named), "vocab": store.vocabulary(named),
            "grams": store.gram_counts(named), "whole": store.whole_chunks(named)}


def retrieve(queries: DataFrame, store: Store, cfg: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """Hits of every query (``query_id, pos, tier, pattern_no, rank, score, chunk_id``) in one version of the store."""
    return search_cascade(queries, cfg=cfg, **_index_of(queries, store))


def search_hits(queries: DataFrame, store: Store, cfg: RetrievalConfig = RetrievalConfig(), tiers: tuple[int, ...] = ALL_TIERS) -> DataFrame:
    """Top N of every pattern of the given tiers."""
    return pattern_hits(queries, cfg=cfg, tiers=tiers, **_index_of(queries, store))


def retrieve_and_rerank(queries: DataFrame, store: Store, cfg: RetrievalConfig = RetrievalConfig(),
                        verdicts: DataFrame | None = None) -> DataFrame:
    """R3 + R4: hits, cosine scores, threshold/top-k/collisions, verdicts, citations."""
    from docquery.operators.rerank import rerank, score_hits
    hits = retrieve(queries, store, cfg)
    return rerank(score_hits(hits, queries, store.table("chunks", store.asked(queries))), cfg, verdicts)


def label_verdicts(labels: DataFrame, hits: DataFrame, chunk_docs: DataFrame) -> DataFrame:
    """Fixture stand-in for the model's yes/no verdict (F9): a hit's verdict is ``Yes`` when the
    ``labels`` row of its document has ``quality = 1``; documents without a label get ``No``."""
    j = (hits.select("query_id", "chunk_id").join(chunk_docs, "chunk_id")
             .join(labels.select("doc_id", "quality"), "doc_id", "left"))
    return j.select("query_id", "chunk_id",
                    F.when(F.col("quality") == 1, F.lit("Assistant: Yes")).otherwise(F.lit("Assistant: No"))
                    .alias("text"))
