"""Ingest a corpus of files into chunk rows (S1 → S3 → per-kind reader → P2/P3/P4).

As in the reference flow, the registry keeps one file per (unstripped) title – the later file wins –
and only that file is read; its kind picks the reader.  Everything is one plan: the winner per title
is a partial aggregate, the readers are column expressions (text, Markdown, paged) or an Arrow-batched
parser (HTML, chaptered items), and the result is the chunk table partitioned by ``context_id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquery.operators.chunk import flatten_sources
from docquery.sources import files as FL
from docquery.sources import text as TX

TEXT_KINDS = [".txt", ".docx", ".doc"]
NATIVE_KINDS = TEXT_KINDS + [".md", ".pdf"]
ALL_KINDS = NATIVE_KINDS + [".html", ".epub"]


def registered_books(files: DataFrame) -> DataFrame:
    """``file_pos, kind, title, author, subject, context_id, content`` – the winning file of every title.

    ``files``: ``file_pos, path, context, content`` (``content`` = the file's text; for paged kinds the
    pages separated by ``page_sep``).
    """
    ta = FL.title_author(files, ["context", "content"])
    win = ta.groupBy("title").agg(F.max("file_pos").alias("file_pos")).select("file_pos")
    return (ta.join(win, "file_pos")
              .select("file_pos", F.col("path").alias("source_key"), "kind", "title", "author", F.col("context").alias("subject"),
                      F.col("context").alias("context_id"), "content"))


def book_pages(books: DataFrame, kinds: list[str] = ALL_KINDS, page_sep: str = "\n",
               epub_items: DataFrame | None = None) -> DataFrame:
    """Page rows of the registered books whose kind is in ``kinds`` (one reader per kind).

    ``epub_items``: ``file_pos, item_no, item_name, html`` – the items of chaptered (.epub) books; the
    container itself is not decoded here.
    """
    src = books.select("file_pos", "source_key", "kind", "context_id", "title", "author", "subject",
                       F.col("content").alias("text"))
    parts = []

    def of(ks):
        return src.where(F.col("kind").isin(*ks)).drop("file_pos", "kind")

    if any(k in kinds for k in TEXT_KINDS):
        parts.append(TX.text_pages(of([k for k in TEXT_KINDS if k in kinds])))
    if ".md" in kinds:
        parts.append(TX.markdown_pages(of([".md"])))
    if ".pdf" in kinds:
        parts.append(TX.paged_pages(of([".pdf"]), page_sep))
    if ".html" in kinds:
        from docquery.sources.html import with_html_text
        h = of([".html"]).withColumnRenamed("text", "html")
        parts.append(TX.text_pages(with_html_text(h, "html", "text")))
    if ".epub" in kinds and epub_items is not None:
        from docquery.sources.html import with_html_paragraphs
        b = src.where(F.col("kind") == ".epub").select("file_pos", "source_key", "context_id", "title", "author", "subject")
        items = b.join(epub_items.select("file_pos", "item_no", "item_name", "html"), "file_pos").drop("file_pos")
        parts.append(TX.chaptered_pages(with_html_paragraphs(items, "html", "paragraphs")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ingest_corpus(files: DataFrame, kinds: list[str] = ALL_KINDS, page_sep: str = "\n",
                  epub_items: DataFrame | None = None, with_vectors: bool = False) -> DataFrame:
    """Files → chunk rows (``CHUNK_COLUMNS``), ready for :func:`docquery.operators.contexts.load_context`."""
    pages = book_pages(registered_books(files), kinds, page_sep, epub_items)
    return flatten_sources(pages, with_vectors=with_vectors)
