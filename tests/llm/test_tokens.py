"""Token operators against the public libraries, file round trips and plain Python."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest

from docquery.llm import bpe, common, token_binary, token_counts
from docquery.llm.pieces import Pieces

POOL = "aab the  \n\n\t's 'll x1 23ÄÖüñ你好🙂🙃‍́é\x1c\x85　 <|endoftext|>=-/_ANDand,.!"


def random_texts(n, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(POOL) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    with open(bpe.default_ranks(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_transducer_equals_library(library):
    codec = bpe.Codec(bpe.default_ranks(), bpe.default_pattern())
    for t in random_texts(4000) + ["a" * 4000, "ab" * 2000, " " * 2000, "=-" * 1000, "0" * 999, "é" * 500, "thethe" * 400]:
        ids = codec.encode(t)
        assert ids == library.encode_ordinary(t)
        assert codec.decode(ids) == t


def test_transducer_forgets_states(library):
    machine = bpe.Transducer(bpe.read_ranks(bpe.default_ranks()), max_states=20)
    for w in ["internationalisation", "Donaudampfschiff", "zzzqqq", "antidisestablishment"] * 3:
        assert list(machine.encode(w.encode())) == library.encode_ordinary(w)


def test_stream_decoder_is_a_replacing_decoder():
    rnd = random.Random(3)
    some = [0x41, 0x80, 0xC3, 0xE0, 0xA0, 0xED, 0x9F, 0xF0, 0x90, 0xF4, 0x8F, 0xFF, 0xE4, 0xBD, 0xBF, 0xC0, 0xF5]
    for _ in range(4000):
        data = bytes(rnd.choice(some) for _ in range(rnd.randint(0, 9)))
        d = bpe.StreamDecoder({i: bytes([i]) for i in range(256)})
        assert "".join(d.feed([b]) for b in data) + d.close() == data.decode("utf-8", "replace")


def test_bpe_documents(odd, none, library):
    rows = bpe.encode_documents(odd, bpe.default_ranks(), bpe.default_pattern(), with_ids=True).collect()
    want = []
    for r in odd.collect():
        ids = library.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((r["text"] or "").encode()).hexdigest(), True, ids))
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want))
    assert bpe.encode_documents(none, bpe.default_ranks(), bpe.default_pattern()).count() == 0


def test_pieces_join_to_the_text():
    parts = Pieces(lambda s: s + "", limit=50)
    for t in random_texts(3000, 5):
        assert "".join(parts.values(t)) == t


@pytest.mark.parametrize("bits", [8, 16])
def test_dac_codes(bits):
    rnd = np.random.default_rng(2)
    ids = (2.0 ** rnd.uniform(0, 31.9, 3000)).astype(np.uint32)
    ids[::7] = 0
    blob = token_binary.pack([(5, ids[:1200].astype("<u4")), (None, ids[1200:1200].astype("<u4")), (9, ids[1200:].astype("<u4"))], bits)
    f = token_binary.TokenFile(blob)
    assert f.all_ids().tolist() == ids.tolist()
    assert [f.token(i) for i in range(len(ids))] == ids.tolist()
    assert f.document(0) == ids[:1200].tolist() and f.document(1) == [] and f.document(2) == ids[1200:].tolist()
    assert [d for d, _, _ in f.documents()] == [5, None, 9]
    assert token_binary.TokenFile(token_binary.pack([])).all_ids().tolist() == []


def test_token_files(spark, odd, none):
    tk = token_binary.load_tokenizer(token_binary.default_tokenizer())
    manifest = token_binary.write_tokens(odd, common.new_path(spark, "test-tokens"), token_binary.default_tokenizer(), roll_tokens=500)
    assert manifest.count() > 2
    got = sorted(map(tuple, token_binary.read_tokens(manifest).collect()), key=lambda r: r[1])
    want, start = [], 0
    for doc_id, text in sorted(((r["doc_id"], r["text"] or "") for r in odd.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode())):
        ids = np.array(tk.encode(text, add_special_tokens=False).ids + [2], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    empty = token_binary.write_tokens(none, common.new_path(spark, "test-tokens"), token_binary.default_tokenizer())
    assert token_binary.read_tokens(empty).count() == 0


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(spark, odd, none, rule):
    tk = token_binary.load_tokenizer(token_binary.default_tokenizer())
    got = {}
    for r in token_counts.count_tokens(odd, token_binary.default_tokenizer(), rule).collect():
        got.setdefault(r["doc_id"], []).append((r["section_no"], r["start"], r["end"], round(r["n_tokens"], 6), r["n_crossing"]))
    want = {}
    for row in odd.collect():
        text, sections, at = row["text"] or "", [], 0
        for line in text.split("\n"):
            sections.append([at, min(at + len(line) + 1, len(text)), 0.0, 0])
            at += len(line) + 1
        for s, e in tk.encode(text, add_special_tokens=False).offsets:
            held = [max(0, min(e, b) - max(s, a)) for a, b, _, _ in sections]
            touched = [k for k, h in enumerate(held) if h]
            first, last = touched[0], touched[-1]
            sections[first][3] += first != last
            if rule == "split":
                for k in touched:
                    sections[k][2] += held[k] / sum(held)
            else:
                sections[{"first": first, "last": last, "largest": held.index(max(held))}[rule]][2] += 1
        want.setdefault(row["doc_id"], []).extend((k, a, b, round(n, 6), c) for k, (a, b, n, c) in enumerate(sections))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert token_counts.count_tokens(none, token_binary.default_tokenizer(), rule).count() == 0


def test_crossing_tokens_are_attributed():
    starts, ends, sections = np.array([0, 2, 5]), np.array([2, 5, 6]), np.array([0, 3])
    for rule, want in {"first": [2, 1], "last": [1, 2], "largest": [1, 2], "split": [1 + 1 / 3, 1 + 2 / 3]}.items():
        counts, crossing = token_counts.attribute(starts, ends, sections, 6, rule)
        assert np.allclose(counts, want) and crossing.tolist() == [1, 0]


def test_unknown_rule(odd):
    with pytest.raises(ValueError):
        token_counts.count_tokens(odd, token_binary.default_tokenizer(), "other")


def test_worker_keeps_the_caches_of_one_operator():
    import functools

    from docquery.llm import common

    @functools.cache
    def a():
        return object()

    @functools.cache
    def b():
        return object()

    first = a()
    common.hold("a", a)
    common.hold("a", a)
    assert a() is first
    common.hold("b", b)
    kept = b()
    assert a.cache_info().currsize == 0 and b() is kept
    common.hold("none")
    assert b.cache_info().currsize == 0


def test_parts_of_the_half_before_are_not_encoded_again():
    told = []

    def encode(s):
        told.append(s)
        return s

    pieces = Pieces(encode, limit=8)  # halves of four
    pieces.values("a b c d e")        # the first part of a text is not kept
    told.clear()
    assert "".join(pieces.values("x b c d e f")) == "x b c d e f" and told == ["x", " f"]
    assert len(pieces.memo) <= 4 and len(pieces.old) <= 4


def test_kept_parts_are_bytes_and_memory_is_given_back():
    codec = bpe.Codec(bpe.default_ranks(), bpe.default_pattern())
    codec.encode("one two three two")
    assert all(isinstance(v, bytes) and len(v) % 4 == 0 for v in codec.pieces.memo.values())
    common.give_back()
