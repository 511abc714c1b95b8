"""Parts that are new in a run of texts are encoded together (op9), with the ids of the library."""

import random

import numpy as np
import pytest

from docquery.llm import token_binary
from docquery.llm.pieces import BatchPieces

POOLS = ["aab the  \n\n\t's 'll x1 23ÄÖüñ你好🙂🙃‍́é\x1c\x85　=-/_ANDand,.!\x00\r\x0b²ª", ["<|endoftext|>", " a", "word,", "\n\n", "word", "|"],
         [" ", "\n", "a", "b,", "\t"]]


def random_runs(n, seed=5):
    rnd = random.Random(seed)
    for k in range(n):
        pool = POOLS[k % len(POOLS)]
        yield ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 40))) for _ in range(rnd.randint(0, 20))]


@pytest.mark.parametrize("limit", [800_000, 40, 6])
def test_runs_of_texts_equal_the_library(limit):
    own = token_binary.worker_pieces(token_binary.default_tokenizer())
    library = token_binary.load_tokenizer(token_binary.default_tokenizer())
    pieces = BatchPieces(own.encode, own.encode_many, limit)
    for texts in [["\ta\t\tb,b,a\n\t", "", " ", "\n", "x", "x\t", "x \n\n y", "\tx"], *random_runs(150)]:
        got = [np.frombuffer(b, "<u4").tolist() for b in pieces.many(texts)]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(pieces.memo) <= limit // 2


def test_new_parts_are_encoded_together_and_once():
    told = []

    def encode_many(parts):
        told.append(sorted(parts))
        return [p.encode() for p in parts]

    pieces = BatchPieces(str.encode, encode_many, limit=100)
    texts = ["one two three, two", "two four\n\nfive three.", "one four,"]
    assert [b.decode() for b in pieces.many(texts)] == texts
    assert told == [sorted(["\none", "\ntwo", " two", " three", " four", "\n\nfive"])]
    assert [b.decode() for b in pieces.many(texts)] == texts
    assert told[1:] == [[]]


def test_joined_parts_are_cut_at_token_ends():
    own = token_binary.worker_pieces(token_binary.default_tokenizer())
    parts = [f" wört{k}!" if k % 3 else f"\n\n你好{k}" for k in range(2 * token_binary.JOINED + 1)]
    assert own.encode_many(parts) == [own.encode(p) for p in parts]
    assert own.encode_many([]) == []


def test_a_run_of_texts_is_bounded():
    rows = [(1, "aaaa"), (2, ""), (3, "bb"), (4, "c" * 50), (5, "d")]
    assert list(token_binary.together(iter(rows), 6)) == [rows[:3], rows[3:4], rows[4:]]
    assert list(token_binary.together(iter([]), 6)) == []
