"""Golden rows for the row-wise rules."""

from pyspark.sql import functions as F

from docquery.functions.keywords import capitalize, py_title, sanitize_keywords, wildcard_form
from docquery.functions.text import (citation, context_slug, final_answer, source_kind, split_author,
                                     split_response, summary_text, tail_trim, unwrap_dollars, verdict_flag,
                                     wrap_dollars)
from docquery.functions.vectors import with_embedding, with_sparse_cosine
from docquery.operators.chunk import explode_chunks


def one(spark, col, data, schema="x string"):
    return [r[0] for r in spark.createDataFrame(data, schema).select(col).collect()]


def test_split_author(spark):
    rows = [("/x/The Old Man and the Sea Author Ernest Hemingway.pdf", ".pdf"), ("/x/Notes.PDF", ".pdf"),
            ("/x/Coauthor Bob.txt", ".txt"), ("/a.pdf.d/b.pdf", ".pdf")]
    out = spark.createDataFrame(rows, "p string, e string").select(split_author(F.col("p"), F.col("e")).alias("s")) \
        .select("s.title", "s.author").collect()
    assert [tuple(r) for r in out] == [("The Old Man and the Sea ", "Ernest Hemingway"), ("Notes.PDF", "Unknown"),
                                       ("Co", "Bob"), ("a", "Unknown")]


def test_source_kind(spark):
    assert one(spark, source_kind(F.col("x")), [("a.docx",), ("b.doc",), ("c.xyz",), ("D.PDF",)]) == \
        [".docx", ".doc", None, ".pdf"]


def test_context_slug(spark):
    got = one(spark, context_slug(F.col("x")), [("Vegan Cooking",), ("3D-print",), ("Élan Vital-3",), ("!!!",)])
    assert got == ["vegancooking", "context_3dprint", "élanvital3", None]


def test_split_response(spark):
    assert one(spark, split_response(F.col("x")), [("x Assistant: y Assistant: z",), ("plain",)]) == ["y ", "plain"]
    assert one(spark, verdict_flag(F.col("x")), [("Assistant: YES it does",), ("Assistant: No",)]) == [True, False]


def test_citation(spark):
    rows = [("T", 0, 0, "Unknown"), ("T", 0, 3, "A"), ("T", 2, 0, "Unknown")]
    df = spark.createDataFrame(rows, "title string, chapter int, page_number int, author string")
    assert [r[0] for r in df.select(citation()).collect()] == ["T", "T, Page 3, Author A", "T, Chapter 2, Page 0"]


def test_sanitize_keywords(spark):
    df = spark.createDataFrame([("1. Foo, Bär o'neil-x  ,Baz",)], "x string")
    got = df.select(sanitize_keywords(F.col("x"), F.array(F.lit("Baz")), 6)).collect()[0][0]
    assert got == ["1", "Foo", "Br", "o'neil-x"]


def test_keyword_variants(spark):
    got = one(spark, py_title(wildcard_form(F.col("x"))), [("foo-bar",), ("o'neil",), ("3d",), ("ABC",)])
    assert got == ["Foo-Bar", "O?Neil", "3D", "Abc"]
    assert one(spark, capitalize(F.col("x")), [("hELLO",)]) == ["Hello"]


def test_chunks(spark):
    df = spark.createDataFrame([(1, "a" * 2300), (2, "")], "id int, text string")
    rows = explode_chunks(df, "text").orderBy("id", "chunk_number").collect()
    assert [(r.chunk_number, len(r.chunk_text)) for r in rows] == [(0, 1000), (1000, 1000), (2000, 300)]


def test_dollars_and_summary(spark):
    assert one(spark, wrap_dollars(F.col("x")), [("a$$$b",)]) == ["$$a$b$$"]
    assert one(spark, unwrap_dollars(F.col("x")), [("$$a$b$$",)]) == ["a$b"]
    assert one(spark, summary_text(F.col("x")), [("x" * 101,)]) == ["x" * 100 + "..."]
    assert one(spark, summary_text(F.col("x")), [('Sure, message: "hi"',)]) == ["hi"]


def test_tail_trim_and_final(spark):
    assert one(spark, tail_trim(F.col("x"), 3), [("abcdef",), ("ab",)]) == ["def", "ab"]
    assert one(spark, tail_trim(F.col("x"), 4.5), [("abcdef",)]) == ["cdef"]
    df = spark.createDataFrame([("ans", ["A", "A"]), ("x", [])], "t string, s array<string>")
    assert [r[0] for r in df.select(final_answer(F.col("t"), F.col("s"))).collect()] == \
        ["ans\n\nSources:\nA\nA\n", "x\n"]


def test_hashed_cosine(spark):
    df = spark.createDataFrame([("Foo bar foo", "foo baz"), ("", "x")], "a string, b string")
    df = with_embedding(with_embedding(df, "a", "va", "na"), "b", "vb", "nb")
    got = with_sparse_cosine(df, "va", "vb", "na", "nb", "cos").select("na", "nb", "cos").collect()
    # foo counted twice (case-folded); baz and bar may share a bucket only by hash collision
    assert got[0].na in (5, 9) and got[0].nb in (2, 4)
    assert got[1].cos == 0.0
