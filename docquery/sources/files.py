"""Source discovery, title/author from file names, the source registry, page counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquery.functions.text import source_kind, split_author

# Fixture rule for a file list derived from ``documents`` (the test tables hold no file names): one folder
# per document, named by its first word, a digest of its text and its source, so files share a title only
# where their texts are equal.
FIXTURE_EXTENSIONS = [".html", ".pdf", ".epub", ".txt", ".docx", ".doc", ".md", ".xyz", ".PDF", ".Txt"]
FIXTURE_KINDS = [".html", ".pdf", ".epub", ".txt", ".docx", ".doc", ".md"]


def document_files(documents: DataFrame, extra: list[str] | None = None, ext: str | list[str] | None = None,
                   turns: list[str] | None = None) -> DataFrame:
    """``file_pos, path, context, n_lines`` (+ ``extra`` columns).

    ``ext``: one extension for every document, or a list of which each document gets every one; by
    default the kinds ``turns`` take turns over the documents (a mixed corpus of every document).
    """
    turns = turns or FIXTURE_KINDS
    first = F.regexp_extract("text", r"[\p{L}\p{N}'-]+", 0)
    stem = F.concat(F.when(first == "", F.lit("untitled")).otherwise(first), F.lit(" "), F.substring(F.md5("text"), 1, 12))
    m = F.pmod(F.col("doc_id"), F.lit(3))
    name = (F.when(m == 0, F.concat(stem, F.lit(" Author "), F.col("source")))
             .when(m == 1, stem).otherwise(F.concat(stem, F.lit(" author "), F.col("source"))))
    if isinstance(ext, str):
        suffix = F.lit(ext)
    elif ext:
        suffix = F.explode(F.array(*[F.lit(e) for e in ext]))
    else:
        suffix = F.element_at(F.array(*[F.lit(e) for e in turns]), (F.pmod(F.col("doc_id"), F.lit(len(turns))) + 1).cast("int"))
    return (documents.withColumn("_name", name).withColumn("_ext", suffix)
            .select(F.col("doc_id").alias("file_pos"),
                    F.concat(F.lit("/corpus/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit("/"), F.col("_name"),
                             F.col("_ext")).alias("path"),
                    F.col("lang").alias("context"), F.size(F.split(F.col("text"), "\n")).alias("n_lines"), *(extra or [])))


def source_dispatch(files: DataFrame) -> DataFrame:
    """``path`` → ``kind`` (first matching suffix in dispatch order); unknown suffixes skipped."""
    return files.withColumn("kind", source_kind(F.col("path"))).where("kind IS NOT NULL")


def title_author(files: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """S2 (N1): title and author from the path and the dispatched suffix (+ ``extra`` columns). Titles stay unstripped.

    Where ``files`` has ``meta_title`` / ``meta_author`` (container metadata), ``.epub`` files take those."""
    d = source_dispatch(files)
    ta = split_author(F.col("path"), F.col("kind"))

    def of(column: str, from_name):  # chaptered books carry title and creator in their container
        if column not in files.columns:
            return from_name
        return F.when((F.col("kind") == ".epub") & (F.col(column) != ""), F.col(column)).otherwise(from_name)

    return d.select("file_pos", "path", "kind", of("meta_title", ta["title"]).alias("title"), of("meta_author", ta["author"]).alias("author"),
                    *(extra or []))


def source_registry(files: DataFrame) -> DataFrame:
    """S3: one entry per (unstripped) title; the later file's values win, the first position is kept.

    ``pages``: page/item count for paged kinds (the file's line count in the fixture), else 1."""
    ta = title_author(files, ["context", "n_lines"])
    ta = ta.withColumn("pages", F.when(F.col("kind").isin(".pdf", ".epub"), F.col("n_lines")).otherwise(F.lit(1)))
    v = F.struct("author", "pages", F.col("context").alias("subject"), F.col("path").alias("file"))
    return (ta.groupBy("title")
              .agg(F.max_by(v, F.col("file_pos")).alias("v"), F.min("file_pos").alias("file_pos"))
              .select("title", "v.author", F.col("v.pages").cast("int").alias("pages"), "v.subject", "v.file",
                      "file_pos"))


def source_page_counts(pages: DataFrame) -> DataFrame:
    """Pages per source (distinct page numbers); sources that share a title stay apart."""
    return pages.groupBy("source_key", "title").agg(F.countDistinct("page_number").cast("int").alias("pages"))
