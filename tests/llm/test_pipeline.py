"""The pipeline against a plain version of its stages, and the registered SQL of this subpackage."""

import base64
import os

import pytest

import __spark_entry__ as E
import corpus_pipeline
from docquery.llm import bpe, common, quality, queries, secrets
from tests.llm.test_operators import plain_components, plain_hits

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.exists(SF), reason="test data absent")


@needs_data
def test_pipeline_equals_plain_stages(spark):
    import public_tokenizers
    import tiktoken

    docs = common.table(spark, SF, "documents")
    good = {r["doc_id"] for r in quality.classify(docs, common.table(spark, SF, "labels")).collect() if r["predicted"] == 1}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in good]
    first = {i for i, _, c in map(eval, plain_components(rows, 5, 80)) if i == c}
    rows = [(i, t) for i, t in rows if i in first]
    items = [(r["item_id"], r["text"]) for r in common.table(spark, SF, "benchmark").collect()]
    rows = [(i, t) for i, t in rows if not plain_hits(t, items)[-1]]
    model = secrets.GuessCost()
    with open(bpe.default_ranks(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for i, t in rows:
        want[i] = library.encode_ordinary(secrets.redact(t, secrets.base_spans(t) + secrets.value_spans(t, model, secrets.MIN_COST), "<SECRET>"))
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"]: r["ids"] for r in got} == want and len(got) == len(want)
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in got)


def test_stages_keep_columns_and_take_odd_rows(spark, odd, none, tmp_path):
    labels = spark.createDataFrame([(1, 1), (8, 1), (9, 1), (10, 0)], "doc_id long, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "no words of this are there at all, so nothing is found")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for start in (odd, none):
        docs = start
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = common.staged(stage(spark, docs, str(tmp_path)), f"test-stage-{k}")
            if k < len(corpus_pipeline.STAGES) - 1:
                assert docs.columns == start.columns
        assert docs.count() <= start.count()
    n = corpus_pipeline.secret_scan(spark, odd, str(tmp_path)).filter("coalesce(length(text), 0) != n_chars").count()
    assert n == 0


def test_names_and_stages():
    assert {f"op{n}_" for n in range(1, 14)} == {name.split("_")[0] + "_" for name in queries.QUERIES}
    assert set(queries.QUERIES) <= set(E.queries()) and "pipeline" in E.queries()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "jaccard_join", "decontamination", "secret_scan", "bpe_codec"]


@needs_data
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    import duckdb

    from scripts.oracle_check import TABLES, norm

    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    rel = con.sql(queries.SQL[name])
    columns = sorted(df.columns)
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert sorted(repr([norm(r[c]) for c in columns]) for r in df.collect()) == sorted(repr([norm(r[k]) for k in at]) for r in rel.fetchall())


def test_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default: None)

    with pytest.raises(ValueError):
        common.shared_dir(Session())
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
