"""S4/S6/S7/S8 inputs as page tables: ``context_id, title, author, chapter, chapter_title, page_number,
subject, text`` (chunked by :func:`docquery.operators.chunk.flatten_sources`)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquery import config as C
from docquery.operators.sequence import group_position, ordered_index


def _key(df: DataFrame) -> list[str]:
    """The column that tells sources with one title apart, where there is one."""
    return [c for c in ("source_key",) if c in df.columns]


def text_pages(sources: DataFrame) -> DataFrame:
    """A whole text is one page 0 of chapter 0 (``sources``: context_id, title, author, subject, text)."""
    return sources.select(*_key(sources), "context_id", "title", "author", F.lit(0).alias("chapter"),
                          F.lit(C.NO_CHAPTER_TITLE).alias("chapter_title"), F.lit(0).alias("page_number"),
                          "subject", "text")


# Markdown → text rules, applied in this order (multi-line mode); a subset of Markdown:
# fences, headings, images, links, strong/emphasis with '*', inline code, list and quote marks, rules.
MARKDOWN_RULES = [
    (r"(?m)^\s*```[^\n]*$", ""),
    (r"(?m)^[ ]{0,3}#{1,6}[ \t]+", ""),
    (r"(?m)^[ ]{0,3}([-*_][ \t]*){3,}$", ""),
    (r"!\[([^\]\n]*)\]\([^)\n]*\)", "$1"),
    (r"\[([^\]\n]*)\]\([^)\n]*\)", "$1"),
    (r"\*\*([^*\n]+)\*\*", "$1"),
    (r"\*([^*\n]+)\*", "$1"),
    (r"`([^`\n]*)`", "$1"),
    (r"(?m)^[ ]{0,3}>[ ]?", ""),
    (r"(?m)^[ ]{0,3}([-*+]|[0-9]+\.)[ \t]+", ""),
]


def markdown_text(md) -> F.Column:
    """Markdown source → plain text by a native regex chain (JVM-side, no Python)."""
    out = md
    for pat, rep in MARKDOWN_RULES:
        out = F.regexp_replace(out, pat, rep)
    return out


def markdown_pages(sources: DataFrame) -> DataFrame:
    return text_pages(sources.withColumn("text", markdown_text(F.col("text"))))


def paged_pages(sources: DataFrame, page_sep: str = "\n") -> DataFrame:
    """One page per physical page, numbered from 0 (fixture: pages are the text's lines)."""
    e = sources.select(*_key(sources), "context_id", "title", "author", "subject",
                       F.posexplode(F.split(F.col("text"), page_sep)).alias("page_number", "text"))
    return e.select(*_key(sources), "context_id", "title", "author", F.lit(0).alias("chapter"),
                    F.lit(C.NO_CHAPTER_TITLE).alias("chapter_title"), F.col("page_number").cast("int"),
                    "subject", "text")


def chaptered_pages(items: DataFrame) -> DataFrame:
    """S8 (N3): items whose lower-cased name contains ``chapter`` become chapters numbered from 2 in
    item order, titled by the item name; the text is the item's paragraphs joined by ``\\n`` (D1),
    all on page 0.  ``items``: context_id, title, author, subject, item_no, item_name, paragraphs."""
    ch = items.where(F.lower(F.col("item_name")).contains("chapter"))
    book = _key(items) or ["context_id", "title"]
    pos = group_position(ordered_index(ch, book, ["item_no"]), book)
    return pos.select(*_key(items), "context_id", "title", "author", (F.col("_pos") + 1).cast("int").alias("chapter"),
                     F.col("item_name").alias("chapter_title"), F.lit(0).alias("page_number"), "subject",
                     F.array_join("paragraphs", "\n").alias("text"))
