"""Pairs of large groups that are compared inside tasks: none is lost, few become rows."""
import random

import numpy as np
import pyarrow as pa

from docquery.llm import blocks, jaccard_join, minhash


def unlinked_copies(edits, copies=120, words=200):
    rnd = random.Random(9)
    base, rows = [f"w{k}" for k in range(words)], []
    for k in range(copies):
        w = list(base)
        for at in rnd.sample(range(6, words - 6), edits):
            w[at] = f"new{k}-{at}"
        rows.append((k, " ".join(w)))
    return rows


def counted(monkeypatch, module, name):
    """The number of pairs that each call of the exact check gets."""
    sizes, check = [], getattr(module, name)

    def run(pairs, *rest):
        sizes.append(pairs.count())
        return check(pairs, *rest)

    monkeypatch.setattr(module, name, run)
    return sizes


def test_unlinked_copies_are_not_checked_in_all_pairs(spark, monkeypatch):
    sizes = counted(monkeypatch, jaccard_join, "verified")
    jaccard_join.near_duplicates(spark.createDataFrame(unlinked_copies(3), "doc_id long, text string")).count()
    assert sizes and sum(sizes) < 1000  # of 7140
    sizes = counted(monkeypatch, minhash, "linked")
    minhash.near_duplicates(spark.createDataFrame(unlinked_copies(3), "doc_id long, text string")).count()
    assert sizes and sum(sizes) < 1000


def test_linked_copies_connect_without_all_pairs(spark, monkeypatch):
    sizes = counted(monkeypatch, jaccard_join, "verified")
    got = jaccard_join.near_duplicates(spark.createDataFrame(unlinked_copies(1), "doc_id long, text string"))
    assert {r["component_id"] for r in got.collect()} == {0} and sum(sizes) < 1000


def test_large_lists_are_cut_into_blocks(spark, monkeypatch):
    rows = unlinked_copies(2, copies=60)
    want = sorted(map(tuple, jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id").collect()))
    cells = blocks.cells
    monkeypatch.setattr(blocks, "cells", lambda *a: cells(*a[:5], 7))
    monkeypatch.setattr(jaccard_join, "OPEN_PER_ROW", 10 ** 9)
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, got)) == want


def test_histograms_drop_no_link():
    rnd = np.random.default_rng(3)
    for size in (3, 40, 700, 90_000):
        base = rnd.integers(0, 2 ** 63, size)
        sets = []
        for _ in range(40 if size < 1000 else 6):
            s = base.copy()
            at = rnd.integers(0, size, rnd.integers(0, size // 6 + 2))
            s[at] = rnd.integers(0, 2 ** 63, len(at))
            sets.append(np.unique(s))
        hist = blocks.histograms(pa.array(sets, pa.list_(pa.int64())))
        c = {"n": np.array([len(s) for s in sets]), "hist": np.stack([np.frombuffer(h, np.uint8) for h in hist.to_pylist()])}
        r, p = np.triu_indices(len(sets), 1)
        may = blocks.may_link(c, c, r, p, 85)
        both = np.array([len(np.intersect1d(sets[i], sets[j])) for i, j in zip(r, p)])
        assert may[100 * both >= 85 * (c["n"][r] + c["n"][p] - both)].all()


def test_pairs_within_groups():
    sizes = np.array([1, 4, 2, 1, 7])
    got = [(int(i), int(j)) for most in (1, 5, 1000) for r, p in blocks.pairs_within(sizes, most) for i, j in zip(r, p)]
    group = np.repeat(np.arange(5), sizes)
    want = [(i, j) for i in range(15) for j in range(i + 1, 15) if group[i] == group[j]]
    assert got == want * 3


def test_rows_of_the_last_round_do_not_exceed_the_nodes(spark, monkeypatch):
    # copies that all link: every pair passes the histograms, and the last round comes first
    monkeypatch.setattr(jaccard_join, "OPEN_PER_ROW", 10 ** 9)
    sizes = counted(monkeypatch, jaccard_join, "verified")
    runs, compared = [], blocks.compared

    def spied(*args):
        out = compared(*args).cache()
        runs.append((args[0].count(), out.count()))
        return out

    monkeypatch.setattr(blocks, "compared", spied)
    got = jaccard_join.near_duplicates(spark.createDataFrame(unlinked_copies(1, copies=60), "doc_id long, text string"))
    assert {r["component_id"] for r in got.collect()} == {0}
    assert runs and all(made <= read for read, made in runs) and sum(sizes) < 60 * len(runs)
