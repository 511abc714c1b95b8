"""The codec's table of states holds what a large share of a corpus needs, so states are not made again and again."""

import random

from docquery.llm import bpe


def test_130_000_states_are_kept():
    machine = bpe.Transducer(bpe.read_ranks(bpe.default_ranks()))
    rng = random.Random(3)
    most = 0
    while most < 130_000:
        machine.encode(bytes(rng.choice(b"abcdefghijklmnopqrstuvwxyz") for _ in range(24)))
        assert len(machine.name) >= most  # never emptied on the way
        most = len(machine.name)
