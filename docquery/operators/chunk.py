"""Fixed-width chunking, flattening of sources into chunk rows, deterministic ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquery import config as C
from docquery.functions.text import strip_all
from docquery.functions.vectors import with_embedding

CHUNK_COLUMNS = ["context_id", "chunk_id", "title", "author", "chapter", "chapter_title",
                 "page_number", "chunk_number", "chunk_text", "subject"]


def chunk_id(context_id="context_id", title="title", chapter="chapter", page="page_number",
             chunk="chunk_number", source_key: str | None = None) -> Column:
    """Deterministic row id (sha-256 of the row's key) instead of a random uuid.

    ``source_key`` (path or position of the file) keeps the ids of sources that share a title apart."""
    keys = (context_id, *([source_key] if source_key else []), title, chapter, page, chunk)
    cols = [F.col(c) if isinstance(c, str) else c for c in keys]
    return F.sha2(F.concat_ws(C.ID_SEPARATOR, *[c.cast("string") for c in cols]), 256)


def explode_chunks(df: DataFrame, text_col: str = "text", size: int = C.CHUNK_SIZE,
                   keep: list[str] | None = None) -> DataFrame:
    """One row per ``size``-character slice; ``chunk_number`` is the character offset.

    The last slice may be short; an empty text yields no rows. Narrow (no shuffle).
    """
    keep = [c for c in (keep if keep is not None else df.columns) if c != text_col]
    n = F.char_length(F.col(text_col))
    offsets = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size)))
    return (df.select(*keep, F.col(text_col), F.explode(offsets).alias("chunk_number"))
              .select(*keep, F.col("chunk_number"),
                      F.substring(F.col(text_col), F.col("chunk_number") + 1, size).alias("chunk_text")))


def flatten_sources(pages: DataFrame, size: int = C.CHUNK_SIZE, with_vectors: bool = False,
                    extra: list[str] | None = None) -> DataFrame:
    """P2 + P3 + P4: page rows → chunk rows.

    ``pages``: ``context_id, title, author, chapter, chapter_title, page_number, subject, text``.
    Titles are stripped here (after the registry keyed them unstripped). ``extra`` columns pass through.
    A ``source_key`` column, where there is one, is part of the ids.
    """
    extra = list(extra or [])
    key = "source_key" if "source_key" in pages.columns else None
    base = pages.select(*extra, *([key] if key else []), "context_id", strip_all(F.col("title")).alias("title"), "author",
                        F.col("chapter").cast("int").alias("chapter"), "chapter_title",
                        F.col("page_number").cast("int").alias("page_number"), "subject", "text")
    ch = explode_chunks(base, "text", size)
    out = ch.select(*extra, "context_id", chunk_id(source_key=key).alias("chunk_id"), "title", "author", "chapter", "chapter_title",
                    "page_number", F.col("chunk_number").cast("int").alias("chunk_number"), "chunk_text", "subject")
    if with_vectors:
        out = with_chunk_vectors(out)
    return out


def with_chunk_vectors(chunks: DataFrame, text_col: str = "chunk_text") -> DataFrame:
    """Attach the N9 vector (and its squared norm) of the newline-flattened chunk text.

    Tokens never contain a newline or space, so the vector of ``chunk_text`` equals the vector of
    ``page_text``; it is computed once at ingest instead of once per hit.
    """
    return with_embedding(chunks, text_col, "chunk_vector", "vector_norm2")


def documents_as_pages(documents: DataFrame) -> DataFrame:
    """Fixture mapping: every ``documents`` row is a plain-text source in context ``lang``,
    titled ``source-doc_id``, one page 0 in chapter 0, author unknown."""
    return documents.select(
        "doc_id", F.col("lang").alias("context_id"),
        F.concat(F.col("source"), F.lit("-"), F.col("doc_id").cast("string")).alias("title"),
        F.lit(C.UNKNOWN_AUTHOR).alias("author"),
        F.lit(0).alias("chapter"), F.lit(C.NO_CHAPTER_TITLE).alias("chapter_title"),
        F.lit(0).alias("page_number"), F.col("lang").alias("subject"), F.col("text"))


def document_chunks(documents: DataFrame, with_vectors: bool = False, keep_doc_id: bool = False) -> DataFrame:
    out = flatten_sources(documents_as_pages(documents), extra=["doc_id"])
    if with_vectors:
        out = with_chunk_vectors(out)
    return out if keep_doc_id else out.drop("doc_id")
