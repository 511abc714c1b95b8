"""Substring deduplication by hashing lines or paragraphs.

Texts are cut into units (lines, or paragraphs separated by blank lines).  A unit is normalised (case of
A-Z, runs of blanks, blanks at the ends) and hashed to 128 bits (MD5, as a plain digest).  Digests are grouped over the whole corpus;
the occurrence of least rank (rank column, then id, then place) is kept and every other one is removed, with
its offsets in the original text and the place of the kept one.

The grouping is a partial aggregate (count, least rank), so a unit found in a third of all texts costs one
row per task; only digests found twice go on, and the occurrences are joined to them by digest, which
adaptive execution can split for a hot one.  Texts are not shuffled to find spans.

Units of fewer than ``min_words`` words are never removed (headings, list marks and one-word lines repeat by
chance in clean texts).  Offsets count code points, ends are exclusive and leave out the separator.

Cases: null and empty texts have no units.  Ties of rank and id are broken by place, then by text, so one
occurrence stays.  Rows equal in rank, id and text are one document: their common occurrence is kept in each.  A text of any
length is cut whole.  Extra columns are ignored; an empty table gives none.
"""

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_WORDS = 5
SEPARATORS = {"line": re.compile(r"\n"), "paragraph": re.compile(r"\n(?:[ \t\r]*\n)+")}
UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz    ")


def normalised(unit: str) -> list[bytes]:
    """Words of the unit in the form that is compared."""
    return unit.encode("utf-8", "replace").translate(UPPER).split()


def units(text: str, kind: str = "line", min_words: int = MIN_WORDS):
    """(start, end, digest) of the units that are long enough."""
    at = 0
    for m in [*SEPARATORS[kind].finditer(text), None]:
        end = m.start() if m else len(text)
        if end > at:
            words = normalised(text[at:end])
            if len(words) >= min_words:
                yield at, end, hashlib.md5(b" ".join(words), usedforsecurity=False).digest()
        at = m.end() if m else end


def occurrences(docs: DataFrame, id_col: str, text_col: str, rank_col: str | None, kind: str, min_words: int) -> DataFrame:
    """(digest, rank, doc_id, start, end, _th) of every unit."""
    schema = pa.schema([("digest", pa.binary()), ("rank", pa.int64()), ("doc_id", pa.int64()), ("_th", pa.int64()),
                        ("start", pa.int64()), ("end", pa.int64())])
    rank = F.col(rank_col).cast("long") if rank_col else F.lit(0).cast("long")
    rows = docs.select(rank.alias("rank"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("_th"),
                       common.text_or_empty(text_col).alias("text"))

    def run(batches):
        for b in batches:
            found, counts = [], []
            for text in b.column("text").to_pylist():
                u = list(units(text, kind, min_words))
                found += u
                counts.append(len(u))
            if found:
                starts, ends, digests = zip(*found)
                row = pa.array(np.repeat(np.arange(len(counts)), counts))
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), *(b.column(c).take(row) for c in ("rank", "doc_id", "_th")),
                                                  pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], schema=schema)

    return rows.mapInArrow(run, "digest binary, rank long, doc_id long, _th long, start long, end long")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_col: str | None = None, kind: str = "line",
                   min_words: int = MIN_WORDS) -> DataFrame:
    """One row per removed occurrence: doc_id, start, end, digest, copies, kept_doc_id, kept_start (and the row's _th)."""
    common.small_batches(docs.sparkSession)
    found = occurrences(docs, id_col, text_col, rank_col, kind, min_words)
    place = F.struct(F.col("rank"), F.col("doc_id"), F.col("start"), F.col("_th"))
    groups = (found.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min(place).alias("kept")).filter("copies > 1")
              .select(F.col("digest").alias("_digest"), "copies", "kept"))
    return found.join(groups, F.col("digest") == F.col("_digest")).filter(~place.eqNullSafe(F.col("kept"))).select(
        "doc_id", "start", "end", F.lower(F.hex("digest")).alias("digest"), "copies", F.col("kept.doc_id").alias("kept_doc_id"),
        F.col("kept.start").alias("kept_start"), "_th")


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans and without the newline after each."""
    out, at = [], 0
    for start, end in sorted(spans):
        out.append(text[at:start])
        at = end + (text[end:end + 1] == "\n")
    return "".join(out) + text[at:]


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_col: str | None = None, kind: str = "line",
                    min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the removed units cut from the text, and column ``removed_spans`` (replacing one of that
    name) with their original offsets, null where nothing was removed."""
    spans = (repeated_spans(docs, id_col, text_col, rank_col, kind, min_words).groupBy(F.col("doc_id").alias("r_id"), F.col("_th").alias("r_th"))
             .agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("removed_spans")))
    keyed = docs.select(F.struct("*").alias("_row"), F.col(id_col).cast("long").alias("_id"), F.xxhash64(F.col(text_col)).alias("_th"))
    joined = keyed.join(spans, F.col("_id").eqNullSafe(F.col("r_id")) & (F.col("_th") == F.col("r_th")), "left")

    @F.pandas_udf("string")
    def cut_texts(texts: pd.Series, removed: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or s is None else cut(t, [(x["start"], x["end"]) for x in s]) for t, s in zip(texts, removed)])

    new = joined.select("_row", cut_texts(F.col("_row").getField(text_col), F.col("removed_spans")).alias("_new"), "removed_spans")
    return new.select(*[F.col("_new").alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in docs.columns if c != "removed_spans"],
                      "removed_spans")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every removed line of ``documents`` with its original offsets and the place of the kept one."""
    return repeated_spans(common.table(spark, sf_dir, "documents")).drop("_th")


SQL = r"""
WITH l AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), u AS (
  SELECT doc_id, i, line, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(line) - 1 AS start,
    regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM l)
), n AS (
  SELECT doc_id, CAST(start AS BIGINT) AS start, CAST(start + length(line) AS BIGINT) AS "end", array_to_string(w, ' ') AS unit
  FROM u WHERE len(w) >= 5
), g AS (
  SELECT *, count(*) OVER (PARTITION BY unit) AS copies, row_number() OVER (PARTITION BY unit ORDER BY doc_id, start) AS k,
    first_value(doc_id) OVER (PARTITION BY unit ORDER BY doc_id, start) AS kept_doc_id,
    first_value(start) OVER (PARTITION BY unit ORDER BY doc_id, start) AS kept_start FROM n
)
SELECT doc_id, start, "end", md5(unit) AS digest, copies, kept_doc_id, kept_start FROM g WHERE k > 1
"""
