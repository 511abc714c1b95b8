"""Cross-tokenizer alignment against the libraries on whole texts and plain loops."""

import functools
import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docquery.llm import cross_tokens as ct


@pytest.fixture(scope="module")
def paths():
    return ct.default_paths()


@functools.cache
def libraries(paths):
    import sentencepiece
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(paths[0])
    tk.encode_special_tokens = True
    return tk, sentencepiece.SentencePieceProcessor(model_file=paths[1])


def test_no_piece_spans_a_cut(paths):
    sp = libraries(paths)[1]
    for k in range(sp.get_piece_size()):
        text = sp.id_to_piece(k).replace(ct.WORD_MARK, " ")
        assert sp.is_byte(k) or not (ct.CUT.search(text) or re.search(r"\S[ \n]", text))


def plain_groups(text, paths):
    """Groups and links of one whole text, byte by byte; None if it has no tokens."""
    if not text:
        return None
    bytes_a, bytes_b = ct.tokenizer_a(paths[0])[1], ct.tokenizer_b(paths[1])[1]
    tk, sp = libraries(paths)
    a, b = tk.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
    want = (" " + text).encode()
    if b"".join(bytes_a[i] for i in a) != want or b"".join(bytes_b[i] for i in b) != want:
        return None
    spans, ends = [], []
    for ids, table in ((a, bytes_a), (b, bytes_b)):
        at, own = 0, []
        for i in ids:
            own.append((at, at + len(table[i]), i))
            at += len(table[i])
        spans.append(own)
        ends.append({e for _, e, _ in own})
    common, groups, low = sorted(ends[0] & ends[1]), [], 0
    for high in common:
        groups.append([[i for s, e, i in own if low <= s and e <= high] for own in spans])
        low = high
    links = [(i, j) for s, e, i in spans[0] for x, y, j in spans[1] if s < y and x < e]
    return len(a), len(b), groups, links


def plain(rows, paths):
    held = [(k, plain_groups(t, paths)) for k, t in rows]
    counts = Counter(p for _, g in held if g for p in set(g[3]))
    most = {}
    for (a, _), c in counts.items():
        most[a] = max(most.get(a, 0), c)
    out = []
    for k, g in held:
        if g is None:
            out.append((k, 0, 0, 0, 0, 0, 0, ""))
            continue
        shown = ";".join("|".join(",".join(map(str, side)) for side in group) for group in g[2])
        out.append((k, g[0], g[1], len(g[2]), len(g[3]), sum(counts[p] == most[p[0]] for p in g[3]), sum(counts[p] for p in g[3]),
                    hashlib.sha256(shown.encode()).hexdigest()))
    return out


def same(df, paths):
    got = [tuple(r) for r in ct.align_documents(df, *paths).collect()]
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, plain(rows, paths)))
    return got


def test_odd_rows(spark, odd, none, paths):
    short = odd.withColumn("text", F.substring("text", 1, 900))  # the plain loops are quadratic
    rows = same(short, paths)
    assert len(rows) == odd.count() and any(r[1] == 0 for r in rows)
    whole = ct.align_documents(odd, *paths).collect()
    assert len(whole) == len(rows) and max(r["n_a"] for r in whole) > 20_000
    assert ct.align_documents(none, *paths).count() == 0


def test_random_texts_cut_like_whole_ones(spark, paths, monkeypatch):
    monkeypatch.setattr(ct, "BLOCK_CHARS", 300)
    rnd = random.Random(8)
    pool = [" ", "  ", "\n", "\r\n", "\t", " ", "　", "\x1c", "\x85", "\x00", "▁", "<s>", "<0x41>", "</s>", "<unk>", "<|endoftext|>", "don't", "it's", "'ll", "word", "Words",
            "naïve", "你好", "🙂", "👩‍👩‍👧", "1234", "!!!", "...", "a.b", "{\r", "});", "ſ", "é", "é", "ffi", "don", "end.", "x,y", "a!!b", "²;", "½:", "e\u0301.", "No.5", "$5", "#tag", "a|b", "'", "-", "_", "=" * 9, "x" * 70]
    rows = [(k, "".join(rnd.choice(pool) + rnd.choice(["", " ", ""]) for _ in range(rnd.randint(1, 25)))) for k in range(250)]
    got = same(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), paths)
    assert sum(r[1] > 0 for r in got) > 100 and sum(r[1] == 0 for r in got) > 20


def test_repeated_rows_count_as_documents(spark, paths):
    rows = [(1, "the same text")] * 5 + [(2, "the other text"), (None, "the same")]
    got = same(spark.createDataFrame(rows, "doc_id long, text string"), paths)
    assert len(got) == 7


def test_memo_changes_nothing(paths, monkeypatch):
    ct.worker_memo.cache_clear()
    texts = ["alpha beta, gamma\nalpha  beta " * 3, "alpha", "beta\n", "gamma delta"]
    first = ct.measured(texts, *paths)
    again = ct.measured(texts, *paths)
    monkeypatch.setattr(ct, "MEMO_PARTS", 1)
    ct.worker_memo.cache_clear()
    small = [ct.measured([t], *paths)[0] for t in texts]
    for x, y, z in zip(first, again, small):
        assert x[0] == y[0] == z[0] and (x[1] == y[1]).all() and (x[2] == z[2]).all()
    ct.worker_memo.cache_clear()


def test_units_are_the_text():
    rnd = random.Random(2)
    for _ in range(2000):
        text = "".join(rnd.choice(["a", "b.", " ", " ", "\n", "\t", "\u3000", "\x1c"]) for _ in range(rnd.randint(1, 12)))
        texts = [ct.text_of(u) for u in ct.units_of(text)]
        assert "".join(texts) == " " + text and texts == re.split(r"(?<=\S)(?=[ \n])", " " + text)


def test_memo_is_bounded():
    memo = ct.Memo(10)
    for k in range(100):
        memo.add(str(k), k)
    assert len(memo.new) + len(memo.old) <= 20 and memo.known({"99", "0"}) == {"99": 99}
