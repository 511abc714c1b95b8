"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Base counts of every text come first.  A document that passes the base rules goes through the cascade: one
``CASE`` whose branches are rules, so Spark stops at the first that rejects.  The order of the branches comes
from a sample: each rule's cost (seconds of a run over the stored sample, less the run without rules) and
its share of rejected documents there; rules with most rejections per cost come first.  The order changes
which rule is named first and the time, never the verdict.

Cases: null and empty texts have no words and fail the base rule on words.  Rules whose denominator is zero
do not reject.  Repeated rows get repeated results; extra columns are ignored; an empty table gives none
(and keeps the rules in the order given).
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BLANK = "[\\x20\\x09-\\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SAMPLE_ROWS = 2000  # rows the order is estimated on (about; a bound on the sample, not on the verdicts)
SAMPLE_SEED = 7


@dataclass(frozen=True)
class Rule:
    """``rejects`` is a condition over the text ``_t`` and the base counts."""

    name: str
    rejects: Column


def default_rules() -> list[Rule]:
    """Rules after the base ones; each looks at another trait, thresholds leave ordinary prose alone."""
    t = F.col("_t")
    letters = F.length(F.regexp_replace(t, "[^\\p{L}]", ""))
    upper = F.length(F.regexp_replace(t, "[^\\p{Lu}]", ""))
    digits = F.length(F.regexp_replace(t, "[^0-9]", ""))
    lines = F.size(F.split(t, "\n"))
    return [
        Rule("symbols", 10 * F.col("n_symbols") > F.col("n_words")),
        Rule("duplicate_lines", 5 * F.col("n_dup_lines") > 3 * lines),
        Rule("word_length", ~(F.col("word_chars")).between(2 * F.col("n_words"), 15 * F.col("n_words"))),
        Rule("upper_case", 10 * upper > 4 * letters),
        Rule("few_letters", 2 * letters < F.col("word_chars")),
        Rule("digits", 10 * digits > 3 * F.col("word_chars")),
        Rule("exclamations", 10 * F.regexp_count(t, F.lit("[!?]")) > F.col("n_words")),
        Rule("ellipses", 10 * F.regexp_count(t, F.lit("(\\.\\.\\.|…)(\n|\\z)")) > 3 * lines),
        Rule("bullets", 10 * F.regexp_count(t, F.lit("(^|\n) *[-•*·] ")) > 9 * lines),
    ]


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row, even inside other lambdas."""
    return F.transform(F.array(value), use)[0]


def repeat_words(words: Column) -> Column:
    """Words that lie in 3-word windows found twice or more, from the array of words."""
    def spread(seen):  # sorted (hash, place) of all windows -> places of those next to an equal hash
        again = F.filter(seen, lambda x, i: (x["h"] == F.get(seen, i - 1)["h"]) | (x["h"] == F.get(seen, i + 1)["h"]))
        return bound(F.array_sort(F.transform(again, lambda x: x["p"])), lambda at: F.aggregate(
            F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3)))), F.lit(0), lambda s, x: s + x))

    def counted(hashes):
        distinct = F.size(F.array_distinct(hashes)) == F.size(hashes)
        return F.when(distinct, F.lit(0)).otherwise(bound(
            F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p")))), spread))

    def windows(w):
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))

    return F.when(F.size(words) < 3, F.lit(0)).otherwise(bound(words, lambda w: bound(windows(w), counted)))


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the text as ``_t``, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    df = docs.select(F.col(id_col).alias("doc_id"), common.text_or_empty(text_col).alias("_t"))
    t = F.col("_t")
    df = df.withColumn("_w", F.filter(F.split(t, BLANK), lambda x: x != ""))
    df = df.withColumn("_l", F.filter(F.split(t, "\n"), lambda x: F.translate(x, BLANKS, "") != ""))
    df = df.select("doc_id", "_t", F.size("_w").cast("long").alias("n_words"),
                   F.length(F.translate(t, BLANKS, "")).cast("long").alias("word_chars"),
                   (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
                   (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
                   repeat_words(F.col("_w")).cast("long").alias("n_repeat_words"))
    return df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                         | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def rejected_by(rules: list[Rule]) -> Column:
    """Name of the first rule that rejects, or null; later rules are not evaluated."""
    chain = F.when(F.lit(False), F.lit(""))
    for r in rules:
        chain = chain.when(F.coalesce(r.rejects, F.lit(False)), F.lit(r.name))
    return chain


def order_rules(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text",
                sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """(rule, cost in seconds, share rejected), best rejection per cost first."""
    n = docs.select(id_col).count()
    picked = docs.select(id_col, text_col).sample(fraction=min(1.0, sample_rows / max(n, 1)), seed=SAMPLE_SEED)
    # the scan has all its tasks; only the sample is one file then, so that costs are those of one task
    sample = common.staged(base_counts(picked, id_col, text_col).filter("not base_failed"), "rules-sample")
    sample = common.staged(sample.coalesce(1), "rules-sample-file")

    def run(rule: Rule | None) -> tuple[float, float]:
        hit = F.coalesce(rule.rejects, F.lit(False)) if rule else F.length("_t") < 0
        at = time.perf_counter()
        r = sample.agg(F.avg(hit.cast("double")).alias("share")).first()
        return time.perf_counter() - at, r["share"] or 0.0

    run(None)  # the first run also opens the files
    idle = run(None)[0]
    found = [(rule, *run(rule)) for rule in rules]
    found = [(rule, max(cost - idle, 1e-3), share) for rule, cost, share in found]
    return sorted(found, key=lambda x: -x[2] / x[1])


def judge(docs: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text",
          sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Base counts, ``base_failed``, ``kept`` and ``rejected_by`` (the base, or the first rule in cascade order)."""
    rules = default_rules() if rules is None else rules
    ordered = [r for r, _, _ in order_rules(docs, rules, id_col, text_col, sample_rows)]
    df = base_counts(docs, id_col, text_col)
    df = df.withColumn("rejected_by", F.when(F.col("base_failed"), F.lit("base")).otherwise(rejected_by(ordered)))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                     F.col("rejected_by").isNull().alias("kept"), "rejected_by")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    return judge(common.table(spark, sf_dir, "documents")).drop("rejected_by")


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), b AS (
  SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, string_split(t, chr(10)) AS lines,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d
), tri AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM b WHERE len(w) >= 3)
), rep AS (
  SELECT r, count(DISTINCT p) AS n FROM (
    SELECT r, unnest(range(i, i + 3)) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM tri) WHERE c > 1) GROUP BY r
), c AS (
  SELECT doc_id, t, lines, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
    length(regexp_replace(t, '[^\p{L}]', '', 'g')) AS letters, length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) AS upper,
    length(regexp_replace(t, '[^0-9]', '', 'g')) AS digits, length(regexp_replace(t, '[^!?]', '', 'g')) AS marks,
    len(regexp_extract_all(t, '(\.\.\.|…)(\n|\z)')) AS dots, len(regexp_extract_all(t, '(^|\n) *[-•*·] ')) AS bullets
  FROM b LEFT JOIN rep USING (r)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 5 * n_dup_lines > 3 * len(lines)
    OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * upper > 4 * letters OR 2 * letters < word_chars
    OR 10 * digits > 3 * word_chars OR 10 * marks > n_words OR 10 * dots > 3 * len(lines) OR 10 * bullets > 9 * len(lines)) AS kept
FROM f
"""
