"""Goldens and brute-force comparisons for the relational operators."""

import itertools
import random

import pytest

from pyspark.sql import functions as F

from docquery.config import RetrievalConfig
from docquery.operators import chats as CH
from docquery.operators.rerank import rerank
from docquery.operators.search import pattern_hits, search_cascade
from docquery.operators.chunk import flatten_sources


def test_rerank_collisions(spark):
    rows = [(1, 1, "c1", 0.5), (1, 2, "c2", 0.9), (1, 3, "c3", 0.5), (1, 4, "c4", 0.16)]
    df = spark.createDataFrame(rows, "query_id int, pos int, chunk_id string, relevance double") \
        .withColumn("title", F.col("chunk_id")).withColumn("author", F.lit("Unknown")) \
        .withColumn("chapter", F.lit(0)).withColumn("page_number", F.lit(0)).withColumn("page_text", F.lit("t"))
    out = rerank(df, RetrievalConfig()).orderBy("answer_no").collect()
    # 0.5 keeps row 3 (largest position) shown at position 1; 0.16 is not > 0.16
    assert [(r.answer_no, r.pos, r.chunk_id) for r in out] == [(1, 1, "c3"), (2, 2, "c2")]


def _ref_rerank(scores, thr, k):
    pages = {}
    for p, s in enumerate(scores, 1):
        pages[s] = p
    kept = sorted([s for s in scores if s > thr], reverse=True)[:k]
    order = []
    seen = set()
    for p, s in enumerate(scores, 1):
        if s in kept and s not in seen:
            seen.add(s)
            order.append((pages[s], s))
    return [x[0] for x in order]


def test_rerank_property(spark):
    rnd = random.Random(7)
    rows, expect = [], {}
    for q in range(60):
        n = rnd.randint(0, 15)
        scores = [rnd.choice([0.1, 0.2, 0.3, 0.5, 0.7, 0.9]) for _ in range(n)]
        for p, s in enumerate(scores, 1):
            rows.append((q, p, f"q{q}p{p}", s))
        expect[q] = _ref_rerank(scores, 0.16, 4)
    df = spark.createDataFrame(rows, "query_id int, pos int, chunk_id string, relevance double") \
        .withColumn("title", F.lit("t")).withColumn("author", F.lit("Unknown")) \
        .withColumn("chapter", F.lit(0)).withColumn("page_number", F.lit(0)).withColumn("page_text", F.lit("t"))
    got = {}
    for r in rerank(df, RetrievalConfig()).orderBy("query_id", "answer_no").collect():
        got.setdefault(r.query_id, []).append(int(r.chunk_id.split("p")[1]))
    for q, e in expect.items():
        assert got.get(q, []) == e, q


# ---- brute-force search on a small fixture ----------------------------------------------------
WORDS = ["foo", "Foo", "bar", "baz", "qux", "fooo", "barz", "o'neil", "oneil", "xyzzy", "Bar-Baz", "café"]


def _tokens(t):
    import regex
    return regex.findall(r"[\p{L}\p{N}'-]+", t)


def _lev(a, b):
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        cur = [i]
        for j, cb in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb)))
        prev = cur
    return prev[-1]


def _like_in(x, s):
    import re
    pat = "".join("." if c == "?" else re.escape(c) for c in x)
    return re.search(pat, s, re.S) is not None


def _F(x, c, d):
    return any(_like_in(x, t) or _lev(t, x) <= d for t in _tokens(c))


def _O(x, y, c):
    import re
    p = lambda z: "".join("." if ch == "?" else re.escape(ch) for ch in z)
    return re.search(p(x) + ".*" + p(y), c, re.S) is not None


def _title(s):
    return s.title()


def _ref_search(keywords, chunks, n=4, m=15):
    kws = [k.replace("'", "?") for k in keywords]
    K = [_title(k) for k in kws]
    k = len(kws)
    pats = []
    if k > 3:
        pats.append((1, lambda c: sum(_F(x, c, 1) for x in K)))
    if k > 2:
        f3 = K[:3]
        trip = [t for t in itertools.product(f3, repeat=3) if t[0] != t[1] and t[0] != t[2] and t[1] != t[2]]
        for a, b, cc in trip:
            pats.append((2, lambda c, a=a, b=b, cc=cc: 2 * (_F(a, c, 1) + _F(b, c, 1) + _F(cc, c, 1))
                         + _O(b, cc, c) + _O(a, b, c) + _O(cc, a, c)))
    if k > 1:
        for a in K:
            for b in K:
                if a != b:
                    pats.append((3, lambda c, a=a, b=b: _O(a, b, c) + 2 * _F(a, c, 1) + 2 * _F(b, c, 1)
                                 + _like_in(a, c) + _like_in(b, c)))
    if k == 1:
        w = kws[0]
        pats.append((4, lambda c, w=w: 3 * _like_in(w, c) + _F(w, c, 2) + _like_in(w.upper(), c)
                     + _like_in(w.lower(), c) + _like_in(w.capitalize(), c)))
    found = []
    for _, score in pats:
        sc = sorted(((-score(t), cid) for cid, t in chunks if score(t) >= 1))[:n]
        for _, cid in sc:
            if cid not in found:
                found.append(cid)
    return found[:m]


def test_search_matches_brute_force(spark):
    rnd = random.Random(3)
    chunks = [(f"c{i:03d}", " ".join(rnd.choice(WORDS + ["the", "and", "x"]) for _ in range(rnd.randint(1, 12))))
              for i in range(80)]
    queries = [(q, [rnd.choice(["foo", "bar", "baz", "o'neil", "cafe", "Qux", "zz", "foo"]) for _ in range(rnd.randint(1, 5))])
               for q in range(25)]
    cdf = spark.createDataFrame(chunks, "chunk_id string, chunk_text string").withColumn("context_id", F.lit("c"))
    qdf = spark.createDataFrame(queries, "query_id int, keywords array<string>") \
        .withColumn("context_id", F.lit(None).cast("string"))
    got = {}
    for r in search_cascade(qdf, cdf).orderBy("query_id", "pos").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    for q, kws in queries:
        assert got.get(q, []) == _ref_search(kws, chunks), (q, kws)


def test_rolling_context_and_history(spark):
    conv = [(1, t, "user" if t % 2 == 0 else "assistant", f"m{t}") for t in range(15)]
    c = spark.createDataFrame(conv, "conv_id long, turn long, role string, text string")
    m = CH.messages_from_conversations(c)
    q = CH.current_questions(c)
    rc = CH.rolling_context(m, q, 9000).where("is_question").collect()
    assert len(rc) == 1
    # pairs 3..7 of 7 stored pairs, joined by blank lines
    assert rc[0].history == "\n\n".join(f"m{t}" for t in range(4, 14))
    h = CH.chat_history(m).orderBy("seq").collect()
    assert [r.prompt for r in h][:2] == ["m0", "m2"]


def test_history_tie_keeps_largest_id(spark):
    from datetime import datetime
    ts = datetime(2024, 1, 1)
    m = spark.createDataFrame([("c", "a", ts, "s", "$$p1$$", "$$r1$$"), ("c", "b", ts, "s", "$$p2$$", "$$r2$$")],
                              "chat_id string, id string, datetime timestamp_ntz, summary string, prompt string, response string")
    assert [r.prompt for r in CH.chat_history(m).collect()] == ["p2"]


def test_flatten_sources_ids_stable(spark):
    pages = spark.createDataFrame([("c", " T ", "Unknown", 0, "None", 0, "s", "x" * 1500)],
                                  "context_id string, title string, author string, chapter int, chapter_title string, page_number int, subject string, text string")
    a = flatten_sources(pages).select("chunk_id", "title").collect()
    b = flatten_sources(pages).select("chunk_id", "title").collect()
    assert a == b and a[0].title == "T" and len(a) == 2


def test_hot_chat_is_split_and_exact(spark):
    """One chat holding half of all rows: positions span several range partitions, and the rolling
    context and pairing equal a plain Python walk over each chat."""
    from docquery.operators.sequence import ordered_index

    rnd = random.Random(3)
    rows = []
    for conv, n in [(0, 400)] + [(c, rnd.randint(1, 12)) for c in range(1, 60)]:
        roles = [rnd.choice(["user", "user", "assistant", "system"]) for _ in range(n)]
        rows += [(conv, t, roles[t], f"c{conv}t{t}") for t in range(n)]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")

    idx = ordered_index(c, ["conv_id"], ["turn"], num_partitions=8)
    g = sorted((r.conv_id, r.turn, r._g) for r in idx.collect())
    assert [x[2] for x in g] == list(range(len(rows)))
    hot = (c.repartitionByRange(8, "conv_id", "turn").where("conv_id = 0")
            .select(F.spark_partition_id().alias("p")).distinct().count())
    assert hot >= 3

    # reference walk
    want_pairs, want_hist = set(), {}
    by_conv = {}
    for conv, t, role, text in rows:
        by_conv.setdefault(conv, []).append((t, role, text))
    for conv, turns in by_conv.items():
        ts = [x for x in sorted(turns) if x[1] != "system"]
        stored = []
        for i, (t, role, text) in enumerate(ts):
            if role != "user":
                continue
            nxt = ts[i + 1] if i + 1 < len(ts) else None
            resp = nxt[2] if nxt and nxt[1] == "assistant" else None
            want_pairs.add((conv, t, text, resp))
            if resp is not None:
                want_hist[(f"chat_{conv}", len(stored) + 1)] = "\n\n".join(
                    x for p in stored[-5:] for x in p)
                stored.append((text, resp))
    got_pairs = {(r.conv_id, r.turn, r.prompt, r.response) for r in CH.pair_turns(c).collect()}
    assert got_pairs == want_pairs
    m = CH.messages_from_conversations(c)
    rc = CH.rolling_context(m, CH.current_questions(c), 9000).where("NOT is_question").collect()
    got_hist = {(r.chat_id, int(r.ref)): r.history for r in rc}
    assert got_hist == want_hist


def test_ingest_reads_only_the_winning_file(spark):
    from docquery.plans.ingest import ingest_corpus
    files = spark.createDataFrame([
        (1, "/c/Book Author Ann.txt", "ctx", "old text"),
        (2, "/c/Book Author Bob.md", "ctx", "# new *text*"),
        (3, "/c/Other.html", "ctx", "<p>a &amp; b</p>"),
        (4, "/c/Skip.xyz", "ctx", "never read"),
    ], "file_pos int, path string, context string, content string")
    got = sorted((r.title, r.author, r.chunk_text) for r in ingest_corpus(files).collect())
    assert got == [("Book", "Bob", "new text"), ("Other", "Unknown", "a & b")]


def test_search_short_and_wildcard_terms_brute_force(spark):
    """Terms without a 3-character literal run (1–2 characters, ``a?b?c``, only wildcards) take the
    short-key and chunk-length joins; the answer must equal the brute force."""
    rnd = random.Random(11)
    words = WORDS + ["a", "b", "ab", "abc", "a'b", "zz", "!!", "--", "x-y", "o"]
    chunks = [(f"c{i:03d}", " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 6)))) for i in range(70)]
    chunks += [("d001", "!!"), ("d002", "a b c"), ("d003", "")]
    kws = ["o", "ba", "b'z", "'", "''", "a'", "f'o'o", "x", "a'b'c", "''''", "zz", "Foo"]
    queries = [(q, [rnd.choice(kws) for _ in range(rnd.randint(1, 4))]) for q in range(30)]
    queries += [(100 + i, [k]) for i, k in enumerate(kws)]
    cdf = spark.createDataFrame(chunks, "chunk_id string, chunk_text string").withColumn("context_id", F.lit("c"))
    qdf = spark.createDataFrame(queries, "query_id int, keywords array<string>") \
        .withColumn("context_id", F.lit(None).cast("string"))
    got = {}
    for r in search_cascade(qdf, cdf).orderBy("query_id", "pos").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    for q, ks in queries:
        assert got.get(q, []) == _ref_search(ks, chunks), (q, ks)


def test_prebuilt_index_gives_same_hits(spark):
    from docquery.operators.match import build_search_index
    rnd = random.Random(5)
    chunks = [(f"c{i:03d}", " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(1, 8)))) for i in range(40)]
    queries = [(q, [rnd.choice(["foo", "bar", "o'neil", "baz"]) for _ in range(rnd.randint(1, 4))]) for q in range(12)]
    cdf = spark.createDataFrame(chunks, "chunk_id string, chunk_text string").withColumn("context_id", F.lit("c"))
    qdf = spark.createDataFrame(queries, "query_id int, keywords array<string>") \
        .withColumn("context_id", F.lit(None).cast("string"))
    post, vocab = build_search_index(cdf)
    a = sorted(search_cascade(qdf, cdf).collect())
    b = sorted(search_cascade(qdf, cdf, post=post, vocab=vocab).collect())
    assert a == b and len(a) > 0


def test_vocabulary_keeps_its_partitions(spark):
    from docquery.operators.match import postings, vocabulary
    ch = spark.createDataFrame([("c", "x1", "foo bar baz foo")], "context_id string, chunk_id string, chunk_text string")
    v = vocabulary(postings(ch))
    assert v.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted(r.token for r in v.collect()) == ["bar", "baz", "foo"]


def test_wildcard_terms_on_chunks_of_any_length(spark):
    chunks = [("c1", "a" * 1999 + "'"), ("c2", "b" * 1800), ("c3", ""), ("c4", "'")]
    cdf = spark.createDataFrame(chunks, "chunk_id string, chunk_text string").withColumn("context_id", F.lit("c"))
    qdf = spark.createDataFrame([(1, None, ["'"])], "query_id int, context_id string, keywords array<string>")
    got = [r.chunk_id for r in search_cascade(qdf, cdf).orderBy("pos").collect()]
    assert got == _ref_search(["'"], chunks) and "c2" in got


def test_search_keeps_to_its_context(spark):
    rnd = random.Random(21)
    chunks = [(f"c{i:03d}", " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(1, 8))), "ab"[i % 2]) for i in range(80)]
    cdf = spark.createDataFrame(chunks, "chunk_id string, chunk_text string, context_id string")
    queries = [(q, [None, "a", "b", "none"][q % 4], [rnd.choice(["foo", "bar", "o'neil", "baz", "'"]) for _ in range(rnd.randint(1, 4))]) for q in range(24)]
    got = {}
    for r in search_cascade(spark.createDataFrame(queries, "query_id int, context_id string, keywords array<string>"), cdf).orderBy("query_id", "pos").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    for q, ctx, ks in queries:
        assert got.get(q, []) == _ref_search(ks, [(i, t) for i, t, c in chunks if ctx in (None, c)]), (q, ctx, ks)


def test_chunk_ids_are_unique_for_every_reader(spark):
    from docquery.plans.registry import REGISTRY
    for name in ("ingest_text", "ingest_markdown", "ingest_paged", "ingest_html", "ingest_chaptered", "ingest_corpus", "load_context", "chunk_documents"):
        ids = REGISTRY[name](spark, "/root/testdata/sf0.001").select("chunk_id")
        assert ids.count() == ids.distinct().count(), name


def test_nearest_prompt_of_a_hot_chat(spark):
    from docquery.operators import knn as KN
    rnd = random.Random(2)
    m = [("hot", f"m{i:04d}", "$$" + " ".join(rnd.choice(WORDS) for _ in range(5)) + "$$") for i in range(400)] + [("cold", "x", "$$foo bar$$")]
    q = [("hot", "q1", m[37][2].strip("$")), ("cold", "q2", "bar foo"), ("none", "q3", "foo")]
    mdf = spark.createDataFrame(m, "chat_id string, id string, prompt string")
    got = {r.chat_id: (r.nearest_id, r.cosine, r.repeated) for r in KN.semantic_repeat(spark.createDataFrame(q, "chat_id string, id string, message string"), mdf).collect()}
    same = sorted(m[37][2].strip("$").lower().split())
    first = min(i for c, i, p in m if c == "hot" and sorted(p.strip("$").lower().split()) == same)
    assert got == {"hot": (first, 1.0, True), "cold": ("x", 1.0, True)}


def test_nested_paragraphs():
    from docquery.sources.html import html_paragraphs
    assert html_paragraphs("<p>a<p>b") == ["ab", "b"]
    assert html_paragraphs("<p>a<br>b</p>c<p>d</p>") == ["ab", "d"]


def test_checkpoint_folder_of_the_caller_is_kept(spark):
    from docquery.session import checkpoint_dir
    assert checkpoint_dir(spark) == checkpoint_dir(spark)

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default: None)

    with pytest.raises(ValueError):
        checkpoint_dir(Session())


def _knn_rows(rnd, n, d=16, groups=6):
    centres = [[rnd.gauss(0, 1) for _ in range(d)] for _ in range(groups)]
    rows = []
    for k in range(n):
        c = centres[rnd.randrange(groups) if k % 3 else 0]  # one group holds over a third
        rows.append((k, [x + rnd.gauss(0, 0.4) for x in c]))
    return rows


def _brute_knn(rows, probes, k):
    def cos(a, b):
        na, nb = sum(x * x for x in a), sum(x * x for x in b)
        return sum(x * y for x, y in zip(a, b)) / (na * nb) ** 0.5 if na * nb > 0 else 0.0
    return {p: [i for _, i in sorted((-cos(pv, v), i) for i, v in rows if i != p)[:k]] for p, pv in probes}


def test_knn_probes_equals_brute_force(spark, monkeypatch):
    from docquery.operators import knn as KN
    monkeypatch.setattr(KN, "BLOCK_ROWS", 50)  # hot cells are cut into blocks
    rnd = random.Random(11)
    rows = _knn_rows(rnd, 500)
    rows += [(1000 + k, rows[3][1]) for k in range(120)]                       # equal vectors: ties go to the smaller id
    rows += [(2000 + k, [0.0] * 16) for k in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    probes = [r for r in rows if r[0] % 50 == 0]
    got = {}
    for r in KN.knn_probes(df, df.where("vec_id % 50 = 0"), 4).orderBy("probe_id", "rank").collect():
        got.setdefault(r.probe_id, []).append(r.vec_id)
    assert got == _brute_knn(rows, probes, 4)


def test_knn_probes_negative_similarities_and_nulls(spark):
    from docquery.operators.knn import knn_probes
    rows = [(0, [1.0, 0.0]), (1, [-1.0, 0.1]), (2, None), (3, [-1.0, 0.0]), (4, [0.0, 0.0]), (5, [-0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [r.vec_id for r in knn_probes(df, df.where("vec_id = 0"), 3, first=1).orderBy("rank").collect()]
    assert got == [2, 4, 5]  # a null vector counts as zero: cosine 0
    assert knn_probes(df, df.limit(0)).count() == 0 and knn_probes(df.limit(0), df.limit(0)).count() == 0


def test_knn_first_cells_recall(spark):
    """Without the exact round, a few cells already hold most neighbours."""
    from docquery.operators.knn import knn_probes
    rnd = random.Random(5)
    rows = _knn_rows(rnd, 1500, groups=20)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    probes = [r for r in rows if r[0] % 50 == 0]
    want, hit = _brute_knn(rows, probes, 4), 0
    for r in knn_probes(df, df.where("vec_id % 50 = 0"), 4, first=8, exact=False).collect():
        hit += r.vec_id in want[r.probe_id]
    assert hit >= 0.9 * 4 * len(probes)


def test_preceding_rows_across_blocks(spark):
    """Frames that reach over block borders and group borders, nulls in the payload, a frame as long as a block."""
    from docquery.operators.sequence import ordered_index, preceding_rows
    rnd = random.Random(4)
    rows = [(g, k, None if rnd.random() < 0.2 else f"{g}-{k}") for g, n in (("hot", 53), ("a", 1), ("b", 6), ("c", 17)) for k in range(n)]
    df = spark.createDataFrame(rows, "g string, k int, t string").repartition(3)
    for frame, block in ((5, 8), (3, 3), (5, 1000), (1, 2)):
        out = preceding_rows(ordered_index(df, ["g"], ["k"], num_partitions=4), ["g"], F.col("t"), frame, "prev", block).collect()
        assert len(out) == len(rows)
        by = {(g, k): t for g, k, t in rows}
        for r in out:
            assert r.prev == [by[(r.g, j)] for j in range(max(0, r.k - frame), r.k)], (frame, block, r)


def test_registry_pairs_no_documents_of_a_source(spark, tmp_path):
    """The last document of a source names its omit list; documents of one source never meet as pairs."""
    from docquery.plans.registry import q_context_has_sources, q_context_registry
    rows = [(k, f"text {k}", "en" if k % 3 else "fr", f"s{k % 2}", 6) for k in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    registry = q_context_registry(spark, str(tmp_path))
    assert "Join Inner" not in registry._jdf.queryExecution().optimizedPlan().toString()
    got = {r.display_name: r.omit_keywords for r in registry.collect()}
    assert got == {"en": None, "fr": None, "Source s0": ["en", "s0"], "Source s1": ["fr", "s1"]}
    flags = {r.display_name: r.has_sources for r in q_context_has_sources(spark, str(tmp_path)).collect()}
    assert flags == {"en": True, "fr": True, "Source s0": False, "Source s1": False}
