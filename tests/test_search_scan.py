"""Search by reading each chunk once a pass: what is shuffled and kept, shared ids, many keywords."""

import random
import time
import uuid

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from docquery.operators import scan, search
from docquery.operators import store as ST
from docquery.session import DROP_SHUFFLES, checkpoint_dir, cut_lineage, value_bytes


def stored_blocks(spark) -> int:
    return spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().size()


def test_a_cut_leaves_no_shuffle_files(spark):
    before = stored_blocks(spark)
    made = cut_lineage(spark.range(1000).repartition(7))
    until = time.time() + 20
    while stored_blocks(spark) > before and time.time() < until:
        time.sleep(0.2)
    assert stored_blocks(spark) <= before
    assert made.count() == 1000 and spark.conf.get(DROP_SHUFFLES, "false") == "false"


def test_blocks_shuffle_neither_tokens_nor_texts(spark, monkeypatch):
    rnd = random.Random(4)
    words = ["Alpha", "Beta", "Gamma", "Delta", "x", "y"]
    rows = [(str(i), " ".join(rnd.choice(words) for _ in range(6)), "ab"[i % 2]) for i in range(40)]
    rows += [("7", "Delta alone", "b"), ("8", "Beta Gamma", "a")]  # ids that come twice in a context
    chunks = spark.createDataFrame(rows, "chunk_id string, chunk_text string, context_id string")
    s = ST.load_contexts(spark, chunks, f"{checkpoint_dir(spark).rstrip('/')}/scan-{uuid.uuid4().hex}")
    queries = spark.createDataFrame([(k, [None, "a", "b"][k % 3], [w.lower() for w in rnd.sample(words[:4], 1 + k % 4)]) for k in range(12)],
                                    "query_id long, context_id string, keywords array<string>")
    plans = []

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut_lineage(df)

    plain = sorted(map(tuple, search.pattern_hits(queries, chunks).collect()))
    monkeypatch.setattr(search, "cut_lineage", noted)
    vocab, grams = s.vocabulary(), s.gram_counts()
    masks, _ = search.query_masks(search.keyword_table(queries), vocab, grams)
    plans.clear()
    found = sorted(map(tuple, search.pattern_hits(queries, s.table("chunks"), post=s.postings(), vocab=vocab, grams=grams, whole=s.whole_chunks(),
                                                  block_bytes=value_bytes(masks) // 2).collect()))
    assert found == plain and found
    assert not any("hashpartitioning(chunk_id" in p for p in plans)
    both = {r.chunk_id: (len(r.texts), sorted(r.tokens)) for r in s.whole_chunks().where("chunk_id IN ('7', '8', '9')").collect()}
    assert {k: n for k, (n, _) in both.items()} == {"7": 2, "8": 2, "9": 1} and "alone" in both["7"][1]


@pytest.mark.parametrize("bits", [3, 20])
def test_masks_of_chunks_in_slices(monkeypatch, bits):
    rnd = random.Random(bits)
    vocab, ids = [f"t{k}" for k in range(12)], [10, 20, 30]
    held = sorted((rnd.randrange(12), rnd.randrange(3), rnd.choice([-1, 0, 1]), rnd.getrandbits(3 * bits)) for _ in range(40))
    start = np.searchsorted([h[0] for h in held], range(13))
    column = lambda k: np.array([h[k] for h in held], dtype=np.int64)
    m = scan.Masks(pa.array(ids), pa.array(vocab), start, column(1), column(2), column(3), pa.array(["a", "b"]), bits)
    rows = [(rnd.choice(["a", "b", None]), rnd.sample([*vocab, "other"], rnd.randrange(5))) for _ in range(30)] + [("a", None)]
    batch = pa.RecordBatch.from_pydict({"context_id": pa.array([c for c, _ in rows]), "tokens": pa.array([t for _, t in rows], pa.list_(pa.string()))})
    want = {}
    for c, (context, words) in enumerate(rows):
        for token, query, asked, mask in held:
            if vocab[token] in (words or []) and asked in (-1, {"a": 0, "b": 1}.get(context)):
                want[c, query] = want.get((c, query), 0) | mask
    for size in (scan.SLICE, 5):
        monkeypatch.setattr(scan, "SLICE", size)
        parts = list(scan.chunk_rows(batch, m))
        got = {(c, q): v for part in parts for c, q, v in zip(*(x.tolist() for x in part))}
        assert got == want and sum(len(p[0]) for p in parts) == len(want)
    assert len(parts) > 3


def test_places_and_orders_of_terms():
    assert scan._places("foo fo0 foo", "fo?") == (0, 8) and scan._places("aaa", "a?") == (0, 1) and scan._places("x\ny", "x?y") == (0, 0)
    assert scan._places("a.b", "a?c") == (-1, -1) and scan._places("foo", "o") == (1, 2)
    im, o, full = scan.text_flags("Foo Bar Foo", ["Foo", "Bar", "B?r"], 0b011, 0b100, {})
    assert (im, o, full) == (0b111, [0b110, 0b001, 0b001], False)  # Bar and B?r share their only place
    assert scan.text_flags("Foo Bar Foo", ["Foo", "Bar"], 0b11, 0, {}) == (0b11, [0b10, 0b01], True)


def test_only_hit_chunks_are_shuffled_for_their_scores(spark, monkeypatch):
    from docquery.operators import rerank
    chunks = spark.createDataFrame([(f"c{i}", f"foo bar{i} baz") for i in range(30)] + [("c3", "foo again")], "chunk_id string, chunk_text string")
    for name in ("title", "author", "chapter", "page_number", "chunk_number"):
        chunks = chunks.withColumn(name, F.lit(1))
    chunks = cut_lineage(chunks)
    hits = cut_lineage(spark.createDataFrame([(1, 1, "c3"), (1, 2, "c4"), (2, 1, "c4"), (2, 2, "gone")], "query_id int, pos int, chunk_id string"))
    queries = spark.createDataFrame([(1, "foo"), (2, "bar4 baz")], "query_id int, query_text string")
    plans = []

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut_lineage(df)

    monkeypatch.setattr(rerank, "cut_lineage", noted)
    row = lambda r: (r.query_id, r.pos, r.chunk_id, r.page_text, round(r.relevance, 6))
    few = sorted(map(row, rerank.score_hits(hits, queries, chunks).collect()))
    assert "LeftSemi" in plans[-1] and "BroadcastHashJoin" in plans[-1]
    monkeypatch.setattr(rerank, "HIT_IDS", 0)
    assert sorted(map(row, rerank.score_hits(hits, queries, chunks).collect())) == few and len(few) == 4
    assert "LeftSemi" not in plans[-1]


def test_single_keywords_make_no_row_of_a_query_and_a_chunk(spark, monkeypatch):
    chunks = spark.createDataFrame([(f"c{i}", "c", f"word{i % 5} Other words here") for i in range(20)], "chunk_id string, context_id string, chunk_text string")
    s = ST.load_contexts(spark, chunks, f"{checkpoint_dir(spark).rstrip('/')}/scan-{uuid.uuid4().hex}")
    queries = spark.createDataFrame([(1, "c", ["other"]), (2, "c", ["word3"])], "query_id long, context_id string, keywords array<string>")
    vocab, grams, plans = s.vocabulary(), s.gram_counts(), []

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut_lineage(df)

    monkeypatch.setattr(search, "cut_lineage", noted)
    found = search.pattern_hits(queries, s.table("chunks"), post=s.postings(), vocab=vocab, grams=grams, whole=s.whole_chunks(), tiers=(4,))
    got = sorted((r.query_id, r.rank, r.score, r.chunk_id) for r in found.collect())
    # Other: F within two edits and capitalised as it stands; word3: all its forms but the upper and the capitalised one
    assert [g for g in got if g[0] == 1] == [(1, k + 1, 2, c) for k, c in enumerate(["c0", "c1", "c10", "c11"])]
    assert [g for g in got if g[0] == 2] == [(2, k + 1, 5, c) for k, c in enumerate(["c13", "c18", "c3", "c8"])]
    assert any("MapInArrow" in p for p in plans) and not any("Generate explode(tokens" in p for p in plans)
