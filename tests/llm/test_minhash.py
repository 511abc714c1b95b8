"""MinHash near duplicates against all pairs of plain sets."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from docquery.llm import minhash


def plain_words(text):
    blank = " \t\n\x0b\x0c\r"
    return "".join(" " if c in blank else c.lower() if c.isascii() else c for c in text or "").split(" ")


def plain_set(text):
    w = [x for x in plain_words(text) if x]
    return {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def plain(rows):
    sets = [plain_set(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                label[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    out = []
    for i, (k, _) in enumerate(rows):
        c = least.get(root(i)) if sets[i] else k
        out.append((k, len(sets[i]), c, k == c))
    return sorted(map(repr, out))


def same(df):
    got = minhash.near_duplicates(df).collect()
    assert sorted(repr(tuple(r)) for r in got) == plain([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])
    return got


def copies(rnd, base, most):
    w = list(base)
    for _ in range(rnd.randint(0, most)):
        w[rnd.randrange(len(w))] = f"new{rnd.random()}"
    return " ".join(w)


def test_odd_rows(spark, odd, none):
    assert len(same(odd)) == odd.count()
    assert minhash.near_duplicates(none).count() == 0


def test_large_group_of_near_copies(spark, monkeypatch):
    """Copies at all distances around the threshold, linked in chains or not at all, in bands beyond the block size."""
    monkeypatch.setattr(minhash, "CHUNK", 40)
    monkeypatch.setattr(minhash, "CELL_ROWS", 64)
    rnd = random.Random(5)
    base, other = [[f"w{rnd.randrange(10 ** 6)}" for _ in range(120)] for _ in range(2)]
    rows = [(k, copies(rnd, base, 6)) for k in range(300)] + [(300 + k, copies(rnd, other, 3)) for k in range(40)]
    rows += [(400 + k, rows[7][1]) for k in range(30)] + [(500 + k, " ".join(rnd.sample(base, 40))) for k in range(20)]
    rnd.shuffle(rows)
    got = same(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert len({r["component_id"] for r in got}) > 30 and sum(not r["kept"] for r in got) > 60


def test_chain_of_copies_is_one_component(spark):
    w = [f"c{k}" for k in range(400)]
    rows = [(k, " ".join(w[k * 6:k * 6 + 150])) for k in range(40)]
    assert {r["component_id"] for r in same(spark.createDataFrame(rows, "doc_id long, text string"))} == {0}


def test_posterior_bound():
    for n, m in ((32, 14), (64, 40), (256, 190)):
        x = np.linspace(0, 1, 200_001)
        density = x ** m * (1 - x) ** (n - m)
        reached = density[x >= 0.85].sum() / density.sum()
        below = sum(math.comb(n + 1, k) * 0.85 ** k * 0.15 ** (n + 1 - k) for k in range(m + 1))
        assert abs(reached - below) <= 1e-3 * max(reached, 1e-9) + 1e-9
        assert (reached < minhash.MISS) == (m < minhash.least_equal(n, 85)) or abs(reached - minhash.MISS) < 1e-8


def test_signatures_estimate_similarity():
    rnd = np.random.default_rng(1)
    for share in (0.5, 0.85, 0.95):
        error = []
        for _ in range(60):
            x = rnd.integers(0, 2 ** 63, 600).astype(np.uint64)
            cut = int(600 * (1 - share) / (1 + share) / 2 * 2)
            y = np.concatenate([x[cut:], rnd.integers(0, 2 ** 63, cut).astype(np.uint64)])
            true = (600 - cut) / (600 + cut)
            error.append((minhash.signature(x) == minhash.signature(y)).mean() - true)
        assert abs(np.mean(error)) < 0.012 and np.std(error) < 0.045


def test_small_and_large_blocks_find_the_same_pairs():
    rnd = np.random.default_rng(2)
    base = rnd.integers(0, 2 ** 63, 200).astype(np.uint64)
    sets = []
    for _ in range(80):
        s = base.copy()
        at = rnd.integers(0, 200, rnd.integers(0, 30))
        s[at] = rnd.integers(0, 2 ** 63, len(at)).astype(np.uint64)
        sets.append(np.unique(s))
    sig = np.stack([minhash.signature(s) for s in sets])
    allowed = ~np.eye(80, dtype=bool)
    r, p, equal = minhash.survivors(sig, sig, allowed, 85)
    kept = set(zip(r.tolist(), p.tolist()))
    for i in range(80):
        for j in range(80):
            both = len(np.intersect1d(sets[i], sets[j]))
            if i != j and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                assert (i, j) in kept
    assert len(kept) < 80 * 79 and ((sig[r] == sig[p]).sum(1) == equal).all()


def test_reading_stage_has_many_tasks(spark):
    df = spark.range(0, 400, 1, 5).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b c d e f "), F.col("id")).alias("text"))
    texts = df.select("doc_id", F.xxhash64("text").alias("_th"), F.octet_length("text").alias("_tl"), F.col("text").alias("_t"))
    assert minhash.members(texts, 5).select(F.input_file_name()).distinct().count() == 5
