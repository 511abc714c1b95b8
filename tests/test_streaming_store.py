"""Streaming ingest and the replace semantics of the chunk store."""

import os
import tempfile

from pyspark.sql import functions as F

from docquery.operators import message_store as MS
from docquery.operators import store as ST
from docquery.operators import vector_store as VS
from docquery.streaming.ingest import start_ingest


def test_stream_ingest(spark):
    d = tempfile.mkdtemp(prefix="dq-stream-")
    src = os.path.join(d, "in")
    os.makedirs(src)
    with open(os.path.join(src, "Tales Author Ann.txt"), "w") as f:
        f.write("x" * 2500)
    with open(os.path.join(src, "skip.bin"), "w") as f:
        f.write("nope")
    q = start_ingest(spark, src, "books", os.path.join(d, "store"), os.path.join(d, "ckpt"))
    q.awaitTermination(120)
    out = spark.read.parquet(os.path.join(d, "store")).orderBy("chunk_number").collect()
    assert [(r.title, r.author, r.chunk_number, len(r.chunk_text)) for r in out] == \
        [("Tales", "Ann", 0, 1000), ("Tales", "Ann", 1000, 1000), ("Tales", "Ann", 2000, 500)]


def _chunks(spark, *rows):
    return spark.createDataFrame(list(rows), "context_id string, chunk_id string, chunk_text string")


def _path():
    return os.path.join(tempfile.mkdtemp(prefix="dq-store-"), "store")


def _ids(store, *contexts):
    return sorted((r.context_id, r.chunk_id) for r in store.table("chunks", list(contexts) or None).collect())


def test_load_context_replaces_only_named(spark):
    path = _path()
    first = ST.load_contexts(spark, _chunks(spark, ("a", "1", "x"), ("b", "2", "y"), (None, "0", "no context")), path)
    new = _chunks(spark, ("a", "9", "z"))
    second = ST.load_contexts(spark, new, path, ["a"])
    assert _ids(second) == [("a", "9"), ("b", "2")]
    assert first.contexts["b"] == second.contexts["b"]  # not written again
    third = ST.load_contexts(spark, new.where(F.lit(False)), path, ["a"])
    assert _ids(third) == [("b", "2")] and third.version == 3 and third.table("postings", ["a"]).count() == 0
    # readers stay with the version they opened
    assert _ids(first) == [("a", "1"), ("b", "2")] and _ids(ST.open_store(spark, path, 2)) == [("a", "9"), ("b", "2")]


def test_index_tables_of_a_load(spark):
    s = ST.load_contexts(spark, _chunks(spark, ("a", "1", "foo bar foo"), ("a", "2", "foo"), ("b", "3", "barn"), ("c", "4", "!!")), _path())
    assert sorted(map(tuple, s.postings().select("context_id", "token", "chunk_id").collect())) == [
        ("a", "bar", "1"), ("a", "foo", "1"), ("a", "foo", "2"), ("b", "barn", "3")]
    assert sorted(map(tuple, s.table("vocabulary").select("context_id", "token", "df").collect())) == [("a", "bar", 1), ("a", "foo", 2), ("b", "barn", 1)]
    assert sorted(map(tuple, s.gram_counts().collect())) == [("arn", 1), ("bar", 2), ("foo", 1)]
    assert s.n_chunks() == 4 and s.n_chunks(["a"]) == 2 and s.contexts["c"]["chunks"] == 1


def test_only_asked_contexts_are_read(spark):
    s = ST.load_contexts(spark, _chunks(spark, ("007", "1", "word"), ("a/b c=1", "2", "words"), ("é", "3", "else")), _path())
    assert _ids(s, "007") == [("007", "1")] and _ids(s, "a/b c=1", "é") == [("a/b c=1", "2"), ("é", "3")] and _ids(s, "none") == []
    for name in ST.TABLES:
        plan = s.table(name, ["007"])._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [" in plan and "context_id" in plan.split("PartitionFilters: [")[1].split("]")[0], plan
        assert len(s.table(name, ["007"]).inputFiles()) < len(s.table(name).inputFiles())
    q = spark.createDataFrame([(1, "007"), (2, "unknown"), (3, "007")], "query_id int, context_id string")
    assert s.asked(q) == ["007"] and s.asked(q.unionByName(q.withColumn("context_id", F.lit(None).cast("string")))) is None


def test_a_load_killed_before_its_commit_changes_nothing(spark, monkeypatch):
    path = _path()
    ST.load_contexts(spark, _chunks(spark, ("a", "1", "x")), path)

    def killed(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(ST, "commit", killed)
    for call in (lambda: ST.load_contexts(spark, _chunks(spark, ("a", "9", "z")), path, ["a"]), lambda: ST.drop_contexts(spark, path, ["a"])):
        try:
            call()
            raise AssertionError("not reached")
        except KeyboardInterrupt:
            pass
        assert ST.versions(spark, path) == [1] and _ids(ST.open_store(spark, path)) == [("a", "1")]
    monkeypatch.undo()
    assert ST.vacuum(spark, path) == 4  # the folders of the killed load
    assert _ids(ST.open_store(spark, path)) == [("a", "1")]


def test_racing_loads_both_count(spark, monkeypatch):
    path = _path()
    ST.load_contexts(spark, _chunks(spark, ("a", "1", "x")), path)
    commit, raced = ST.commit, []

    def other_first(*args):
        if not raced:
            raced.append(1)
            ST.load_contexts(spark, _chunks(spark, ("b", "2", "y")), path, ["b"])
        return commit(*args)

    monkeypatch.setattr(ST, "commit", other_first)
    last = ST.load_contexts(spark, _chunks(spark, ("c", "3", "z")), path, ["c"])
    assert _ids(last) == [("a", "1"), ("b", "2"), ("c", "3")] and ST.versions(spark, path) == [1, 2, 3]


def test_unload_and_vacuum(spark):
    path = _path()
    ST.load_contexts(spark, _chunks(spark, ("a/b c", "1", "x"), ("b", "2", "y")), path)
    ST.load_contexts(spark, _chunks(spark, ("b", "3", "y")), path, ["b"])
    reg = spark.createDataFrame([("a/b c", "A", None), ("b", "B", None)], "context_id string, display_name string, omit_keywords array<string>")
    left = ST.unload_contexts(spark, reg, spark.createDataFrame([("A",)], "name string"), path)
    assert [r.context_id for r in left.collect()] == ["b"] and _ids(ST.open_store(spark, path)) == [("b", "3")]
    assert ST.vacuum(spark, path, keep=1) == 4 and _ids(ST.open_store(spark, path)) == [("b", "3")]
    assert ST.open_store(spark, _path()).contexts == {} and ST.drop_contexts(spark, _path(), ["x"]).contexts == {}


def _message(spark, *rows):
    return spark.createDataFrame(list(rows), "chat_id string, id string, summary string, prompt string, response string").withColumn(
        "datetime", F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00.123456'"))


def _held(store):
    return sorted((r.chat_id, r.id, r.summary, r.prompt) for r in store.rows().collect())


def test_message_store(spark):
    path = _path()
    MS.append(spark, _message(spark, ("c1", "1", "s", "$$foo bar$$", "$$x$$")), path, "app", 0)
    second = MS.append(spark, _message(spark, ("c2", "1", "s", "$$foo$$", "$$x$$"), ("c1", "2", "s", "$$a b c$$", "$$y$$")), path, "app", 1)
    rows = second.rows().orderBy("chat_id", "id").collect()
    assert [(r.chat_id, r.id, r.datetime.microsecond, len(r.prompt_vector), r.prompt_norm2) for r in rows] == [
        ("c1", "1", 123000, 2, 2), ("c1", "2", 123000, 3, 3), ("c2", "1", 123000, 1, 1)]
    chats = spark.createDataFrame([("c2",), ("none",)], "chat_id string")
    assert [r.chat_id for r in second.of_chats(chats).collect()] == ["c2"]
    assert set(second.buckets) == MS._buckets_of(second.rows())


def test_a_repeated_append_changes_nothing(spark):
    path = _path()
    m = _message(spark, ("c1", "1", "s", "p", "r"))
    first = MS.append(spark, m, path, "app", 7)
    assert MS.append(spark, m, path, "app", 7).version == first.version == MS.append(spark, m, path, "app", 3).version
    other = MS.append(spark, m, path, "import", 0)  # another source has batches of its own
    assert len(_held(other)) == 2 and len(_held(first)) == 1  # a reader stays with its version


def test_rename_and_delete_rewrite_their_buckets(spark):
    path = _path()
    base = MS.append(spark, _message(spark, *[(f"c{k}", str(j), f"s{k}", "$$p$$", "r") for k in range(40) for j in range(3)]), path, "app", 0)
    moves = spark.createDataFrame([("c1", "c1-new", "new"), ("c2", "c3", "joined"), ("absent", "x", "y")], "chat_id string, new_chat_id string, new_summary string")
    done = MS.rename(spark, path, moves)
    want = {(("c1-new", "new") if c == "c1" else ("c3", "joined") if c == "c2" else (c, s), i) for c, i, s, _ in _held(base)}
    assert {((c, s), i) for c, i, s, _ in _held(done)} == want and len(_held(done)) == 120
    touched = MS._buckets_of(moves) | MS._buckets_of(moves, "new_chat_id")
    assert all(done.buckets[b] == base.buckets[b] for b in base.buckets if b not in touched)
    gone = MS.delete(spark, path, spark.createDataFrame([("c3",), ("c4",)], "chat_id string"))
    assert {c for c, *_ in _held(gone)} == {c for (c, _), _ in want} - {"c3", "c4"}
    assert MS.delete(spark, path, spark.createDataFrame([("absent-too",)], "chat_id string")).version >= gone.version
    assert _held(MS.delete_all(spark, path)) == [] and len(_held(base)) == 120
    assert MS.append(spark, _message(spark, ("c1", "1", "s", "p", "r")), path, "app", 0).buckets == {}


def test_a_message_write_killed_before_its_commit_changes_nothing(spark, monkeypatch):
    path = _path()
    m = _message(spark, ("c1", "1", "s", "p", "r"))
    MS.append(spark, m, path, "app", 0)

    def killed(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(ST, "commit", killed)
    one = spark.createDataFrame([("c1", "c9", "t")], "chat_id string, new_chat_id string, new_summary string")
    for call in (lambda: MS.append(spark, m, path, "app", 1), lambda: MS.rename(spark, path, one), lambda: MS.delete(spark, path, one)):
        try:
            call()
            raise AssertionError("not reached")
        except KeyboardInterrupt:
            pass
        assert _held(MS.open_messages(spark, path)) == [("c1", "1", "s", "p")]
    monkeypatch.undo()
    assert len(_held(MS.append(spark, m, path, "app", 1))) == 2  # the batch was not committed, so it counts now


def test_racing_message_writes_both_count(spark, monkeypatch):
    path = _path()
    MS.append(spark, _message(spark, ("c1", "1", "s", "p", "r")), path, "app", 0)
    commit, raced = ST.commit, []

    def other_first(*args):
        if not raced:
            raced.append(1)
            MS.append(spark, _message(spark, ("c1", "2", "s", "p", "r")), path, "app", 1)
        return commit(*args)

    monkeypatch.setattr(ST, "commit", other_first)
    one = spark.createDataFrame([("c1", "c9", "t")], "chat_id string, new_chat_id string, new_summary string")
    assert [r[:2] for r in _held(MS.rename(spark, path, one))] == [("c9", "1"), ("c9", "2")]


def test_answers_and_container_metadata(spark):
    from docquery.operators.rerank import rerank
    from docquery.operators.search import missing_vectors
    from docquery.sources.files import title_author
    hit = "query_id int, pos int, chunk_id string, relevance double, title string, author string, chapter int, page_number int, page_text string"
    scored = spark.createDataFrame([(1, 1, "a", .9, "T", "Unknown", 0, 0, "page a"), (1, 2, "b", .8, "T", "Unknown", 0, 0, "page b")], hit)
    said = spark.createDataFrame([(1, "b", "answer b")], "query_id int, chunk_id string, text string")
    assert [r.text for r in rerank(scored, responses=said).orderBy("answer_no").collect()] == ["page a", "answer b"]
    vec = spark.createDataFrame([("a", [1])], "chunk_id string, chunk_vector array<int>")
    assert [r.chunk_id for r in missing_vectors(scored, vec).collect()] == ["b"]
    files = spark.createDataFrame([(1, "/c/x.epub", "Book", "Ann"), (2, "/c/y.txt", "no", "no"), (3, "/c/z.epub", "", None)],
                                  "file_pos int, path string, meta_title string, meta_author string")
    assert [(r.title, r.author) for r in title_author(files).orderBy("file_pos").collect()] == [("Book", "Ann"), ("y", "Unknown"), ("z", "Unknown")]


def test_vectors_are_made_once_per_text(spark):
    from docquery.functions.vectors import with_embedding
    path = _path()
    df = spark.createDataFrame([("1", "foo bar"), ("2", "foo\nbar"), ("3", ""), ("4", None), ("5", "foo bar")], "chunk_id string, chunk_text string")
    first = VS.embed_new(spark, df, path)
    assert first.rows().count() == 2 and first.version == 1  # equal texts, also after flattening, are one
    assert VS.embed_new(spark, df, path).version == 1         # nothing new: nothing embedded, nothing written
    more = VS.embed_new(spark, df.union(spark.createDataFrame([("6", "new text here")], df.schema)), path)
    assert more.version == 2 and more.rows().count() == 3
    got = {r.chunk_id: (r.vector, r.norm2) for r in more.attach(df).collect()}
    want = {r.chunk_id: (r.v, r.n) for r in with_embedding(df.where("chunk_text IS NOT NULL"), "chunk_text", "v", "n").collect()}
    assert got.pop("4") == (None, None) and got == want


def test_vector_model_slot(spark):
    path, told = _path(), os.path.join(tempfile.mkdtemp(prefix="dq-model-"), "calls")

    def model(batches):
        for texts in batches:
            with open(told, "a") as f:
                f.write("".join(t + "\n" for t in texts))
            yield [[float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([("1", "abc"), ("2", "de"), ("3", "abc")], "chunk_id string, chunk_text string")
    VS.embed_new(spark, df, path, model=model, width=2)
    again = VS.embed_new(spark, df, path, model=model, width=2)
    assert sorted(open(told).read().split()) == ["abc", "de"]  # the second load embeds nothing
    assert {r.chunk_id: (list(r.vector), r.norm2) for r in again.attach(df).collect()} == {"1": ([3.0, 1.0], 10.0), "2": ([2.0, 1.0], 5.0), "3": ([3.0, 1.0], 10.0)}
    for other in (lambda: VS.embed_new(spark, df, path, model=model, width=3), lambda: VS.embed_new(spark, df, path)):
        try:
            other()
            raise AssertionError("not reached")
        except ValueError:
            pass
    try:  # the model gives another width than the load asks for
        VS.embed_new(spark, df, _path(), model=model, width=3)
        raise AssertionError("not reached")
    except Exception as e:
        assert "3 numbers" in str(e)


def test_chunks_of_huge_files_come_from_many_tasks(spark):
    import random

    from docquery.operators.chunk import explode_chunks
    from docquery.sources.huge import file_chunks, folder_chunks, read_lines
    rnd, folder = random.Random(6), tempfile.mkdtemp(prefix="dq-files-")
    words = ["a", "né", "你好", "🙂", "long" * 30, "", "x\r", "\t", " "]
    big = "".join(rnd.choice(words) + rnd.choice([" ", "\n", "\n\n"]) for _ in range(9000))
    files = {"Big Author Ann+Co.txt": big, "open end.txt": big[:5000].rstrip("\n") + "end", "newline.txt": "\n", "empty.txt": "", "one line.md": "y" * 2500,
             "exact.txt": "z" * 1999 + "\n", "skip.bin": "no"}
    for name, text in files.items():
        with open(os.path.join(folder, name), "w", newline="", encoding="utf-8") as f:
            f.write(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        tasks = read_lines(spark, folder).where("path LIKE '%Big%'").select(F.spark_partition_id().alias("p")).distinct().count()
        got = sorted((os.path.basename(r.path), r.chunk_number, r.chunk_text) for r in file_chunks(spark, folder).collect())
        rows = folder_chunks(spark, folder, "books").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    whole = spark.createDataFrame([(k, v) for k, v in files.items() if k != "skip.bin"], "path string, text string")
    want = sorted((r.path, r.chunk_number, r.chunk_text) for r in explode_chunks(whole).collect())
    assert tasks > 5 and got == want
    assert len({r.chunk_id for r in rows}) == len(want) and {(r.title, r.author) for r in rows} >= {("Big", "Ann+Co"), ("one line", "Unknown")}


def test_search_rows_stay_in_the_task_of_their_chunk(spark):
    from docquery.operators.search import chunk_masks, keyword_table, pattern_hits, query_masks
    from docquery.session import broadcast_if_small, value_bytes

    texts = ["Alpha beta gamma", "beta Alpha O'Neil", "gamma delta Beta alpha", "Delta", "alpha gamma'beta", "x Alpha Gamma y Beta"]
    s = ST.load_contexts(spark, _chunks(spark, *[("ab"[i % 2], str(i), t) for i, t in enumerate(texts)]), _path())
    queries = spark.createDataFrame([(1, None, ["alpha", "beta", "gamma"]), (2, "a", ["delta"]), (3, None, ["alpha", "o'neil"]),
                                     (5, "b", ["beta", "gamma", "alpha", "delta"])], "query_id long, context_id string, keywords array<string>")
    chunks, vocab, grams = s.table("chunks"), s.vocabulary(), s.gram_counts()
    masks, wild = query_masks(keyword_table(queries), vocab, grams)
    plan = chunk_masks(broadcast_if_small(masks), wild, chunks, s.postings(), 4)._jdf.queryExecution().executedPlan().toString()
    # the stored postings are dealt by chunk; no row of a query and a chunk is shuffled
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(chunk_id" in plan
    whole, halves = (sorted(map(tuple, pattern_hits(queries, chunks, post=s.postings(), vocab=vocab, grams=grams, block_bytes=b).collect()))
                     for b in (1 << 24, value_bytes(masks)))
    assert whole == halves and {h[0] for h in whole} == {1, 2, 3, 5}
