"""Operators on texts and pages against plain Python, with odd rows, hot groups and empty tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquery.llm import common, decontaminate, jaccard_join, line_dedup, quality, rules, secrets, token_binary, warc

BLANK = " \t\n\x0b\x0c\r"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def ascii_lower(text):
    return (text or "").encode().lower().decode()


# ---------------------------------------------------------------- quality classifier
def labelled(spark):
    rnd = random.Random(4)
    vocab = ["".join(rnd.choice("aeioulnrst") for _ in range(rnd.randint(2, 8))) for _ in range(300)]
    docs, labels = [], []
    for i in range(600):
        good = i % 5 != 0
        w = [rnd.choice(vocab) for _ in range(rnd.randint(20, 120))]
        docs.append((i, " ".join(w) + "." if good else " ".join(x.upper() + rnd.choice(["!!", "&&&", "***"]) for x in w)))
        if i % 2 == 0:
            labels.append((i, int(good)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_quality_held_out_accuracy(spark):
    docs, labels = labelled(spark)
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == 600
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == int(r["doc_id"] % 5 != 0) for r in held) / len(held) > 0.95


def test_quality_prior(spark):
    docs, labels = labelled(spark)
    assert abs(quality.fit(quality.feature_table(docs), labels).prior - 0.8) < 0.12


def test_quality_learns_nothing_from_held_out_labels(spark):
    docs, labels = labelled(spark)
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")).cast("int"))
    a = {r["doc_id"]: r["score"] for r in quality.classify(docs, labels).collect()}
    b = {r["doc_id"]: r["score"] for r in quality.classify(docs, flipped).collect()}
    assert all(abs(a[k] - b[k]) < 1e-6 for k in a)


def test_quality_odd_rows(spark, odd, none):
    _, labels = labelled(spark)
    rows = quality.classify(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["score"] == 0.5 for r in quality.classify(odd, labels.limit(0)).collect())
    assert quality.classify(none, labels).count() == 0
    kept = quality.keep_good(odd, labels)
    assert kept.columns == odd.columns and kept.count() == sum(r["score"] >= 0.5 for r in rows)


def test_non_negative_branch_is_finite(spark):
    docs, labels = labelled(spark)
    table = quality.feature_table(docs.limit(40))
    rows = table.select("x", (F.col("doc_id") % 2 == 0).alias("positive"))
    mean, scale, _, _ = quality.standardise(rows)
    assert np.isfinite(quality.fit_non_negative(rows, mean, scale, 0.95)).all()


# ---------------------------------------------------------------- quality rules
def plain_counts(text):
    t = text or ""
    w = words(t)
    seen, grams = {}, [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    at = {p for i, g in enumerate(grams) if seen[g] > 1 for p in range(i, i + 3)}
    lines = [x for x in t.split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(at),
            len(w) < 50 or 100 * len(at) > 50 * len(w))


def test_rules_counts(odd, none):
    rows = rules.judge(odd).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = sorted((repr((r["doc_id"], *(r[c] for c in names))) for r in rows))
    assert got == sorted(repr((r["doc_id"], *plain_counts(r["text"]))) for r in odd.collect())
    assert all(not r["kept"] for r in rows if r["base_failed"])
    assert rules.judge(none).count() == 0


def test_rule_order_never_changes_the_verdict(spark):
    rnd = random.Random(9)
    texts = [" ".join(rnd.choice(["plain", "WORD", "a&b", "x!", "12345", "line\n", "other", "text"]) + str(rnd.randint(0, 50) if i % 3 else "")
                      for _ in range(rnd.randint(40, 90))) for i in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    some = rules.default_rules()
    counts = rules.base_counts(docs).cache()
    verdicts = [counts.select("doc_id", rules.rejected_by(order).isNull().alias("k")).collect() for order in (some, some[::-1])]
    assert sorted(verdicts[0]) == sorted(verdicts[1]) and {v["k"] for v in verdicts[0]} == {True, False}
    ordered = rules.order_rules(docs, some)
    gain = [share / cost for _, cost, share in ordered]
    assert gain == sorted(gain, reverse=True) and {r.name for r, _, _ in ordered} == {r.name for r in some}


# ---------------------------------------------------------------- secrets
def test_secret_base_spans(odd, none):
    rows = {r["doc_id"]: r for r in secrets.scan(odd.filter("doc_id = 8 or doc_id = 2")).collect()}
    text = odd.filter("doc_id = 8").first()["text"]
    token, key = text.index("token ="), text.index("AKIA")
    hexa = text.index("ffc31")
    base = f"assign:{token}:{hexa + 40},hex:{hexa}:{hexa + 40},access:{key}:{key + 20}"
    assert (rows[8]["n_assign"], rows[8]["n_access"], rows[8]["n_hex"]) == (1, 1, 1)
    assert rows[8]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
    value = text.index("x9!K")
    assert f"value:{value}:{value + 11}" in rows[8]["spans"].split(",") and set(base.split(",")) <= set(rows[8]["spans"].split(","))
    assert rows[2]["spans"] == "" and rows[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert secrets.scan(odd).count() == odd.count() and secrets.scan(none).count() == 0


def test_short_matches_use_up_their_text():
    assert secrets.base_spans("secret:token:abcdefgh") == []
    assert secrets.base_spans("TOKEN='abcdef'") == [(0, 0, 13)]
    assert secrets.base_spans("ſecret=abcdefgh") == []  # only A-Z and a-z match in either case


def brute_cost(model, value):
    """Least cost over all segmentations, by recursion over the same moves."""
    n, best = len(value), {0: 0.0}
    alike = [0] * (secrets.MAX_UNIT + 1)
    moves = {i: [(i + 1, secrets.char_cost(value[i]))] + [(e, c) for e, c, _ in model.spans(value, i)] for i in range(n)}
    for i in range(n):
        m = secrets.DATE.match(value, i)
        if m:
            moves[i].append((m.end(), np.log10(365 * 60)))
        for unit in range(1, min(secrets.MAX_UNIT, i) + 1):
            alike[unit] = alike[unit] + 1 if value[i] == value[i - unit] else 0
            if alike[unit] >= unit:
                k = alike[unit] // unit + 1
                moves[i + 1 - unit].append((i + 1, np.log10(k) - np.log10(max(1, k - 1)) + (np.log10(2) if k == 2 else 0)))
    for i in range(n):
        for end, cost in moves[i]:
            best[end] = min(best.get(end, np.inf), best[i] + cost)
    return best[n]


def test_guess_cost():
    model = secrets.GuessCost()
    assert model.cost("password123")[0] < 5 < 10 < model.cost("xK9#mQ2$vL7!")[0]
    assert model.cost("aaaaaaaaaaaaaaaaaaaa")[0] < 5 and model.cost("qwertyuiop")[0] < 5 and model.cost("19870412")[0] < 6
    assert model.cost("ffc3105535f423f352535e4ac53b5fefe076ac6d")[0] > 30
    rnd = random.Random(5)
    for _ in range(300):
        v = "".join(rnd.choice(["a", "b", "1", "pass", "2024", "qwe", "#", "secret"]) for _ in range(rnd.randint(1, 8)))
        cost, parts = model.cost(v)
        assert cost <= brute_cost(model, v) + 1e-9
        assert [p[0] for p in parts] == [0, *[p[1] for p in parts[:-1]]] and parts[-1][1] == len(v)
    assert model.cost("Zq7" * 4000)[0] < 50  # long values are scored whole


def test_redaction(odd, none):
    out = secrets.redacted(odd)
    assert out.columns == odd.columns and out.count() == odd.count() and secrets.redacted(none).count() == 0
    text = out.filter("doc_id = 8").first()["text"]
    assert "ffc31" not in text and "AKIA" not in text and "x9!K" not in text and text.startswith('a client_secret: "<SECRET>"')
    assert out.filter("doc_id = 2").first()["text"] is None
    assert secrets.redact("abcdef", [(1, 0, 4), (2, 2, 3), (3, 0, 5)], "#") == "a#f"


# ---------------------------------------------------------------- Jaccard join
def plain_components(rows, n=4, percent=85):
    """doc_id -> list of (n_shingles, component) per row, from all pairs."""
    sets = []
    for doc_id, text in rows:
        w = words(ascii_lower(text))
        sets.append((doc_id, {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()))
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least.setdefault(root(i), []).append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in least.items()}
    return sorted(repr((d, len(s), least[root(i)] if s else d)) for i, (d, s) in enumerate(sets))


def near_copies(seed, groups, copies, edits):
    rnd, rows = random.Random(seed), []
    vocab = ["".join(rnd.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    for _ in range(groups):
        base = [rnd.choice(vocab) for _ in range(rnd.randint(30, 120))]
        for _ in range(rnd.randint(1, copies)):
            w = list(base)
            for _ in range(rnd.randint(0, edits)):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            rows.append((len(rows), " ".join(w)))
    return rows


@pytest.mark.parametrize("seed,groups,copies,edits", [(1, 30, 6, 4), (2, 2, 60, 3), (3, 40, 3, 1)])
def test_jaccard_equals_all_pairs(spark, seed, groups, copies, edits):
    rows = near_copies(seed, groups, copies, edits)
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id")
    assert sorted(repr(tuple(r)) for r in got.collect()) == plain_components(rows)


@pytest.mark.parametrize("open_per_row", [0, 10 ** 9])
def test_jaccard_rounds_and_all_open_pairs_agree(spark, monkeypatch, open_per_row):
    monkeypatch.setattr(jaccard_join, "OPEN_PER_ROW", open_per_row)
    rows = near_copies(7, 3, 40, 4)
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id")
    assert sorted(repr(tuple(r)) for r in got.collect()) == plain_components(rows)


def test_jaccard_odd_rows(odd, none):
    got = jaccard_join.near_duplicates(odd).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(repr(tuple(r)) for r in got) == plain_components([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert jaccard_join.near_duplicates(none).count() == 0
    kept = jaccard_join.one_of_each(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in odd.collect()} - {7, 12}


# ---------------------------------------------------------------- decontamination
def plain_hits(text, items, window=10):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))
    hit, found = set(), set()
    for item_id, item in items:
        iw = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(item))
        size = min(window, len(iw))
        for s in range(len(iw) - size + 1 if iw else 0):
            for d in range(len(w) - size + 1):
                if w[d:d + size] == iw[s:s + size]:
                    hit |= set(range(d, d + size))
                    found.add(str(item_id))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


ITEMS = [(1, "The quick brown fox jumps over the lazy dog and runs away from it"), (2, "seven words are in this short item"), (10, "word"),
         (3, None), (4, "..."), (5, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (6, "a a a a a a a a a a a a"), (7, "Ünï 你好 çode")]


def test_decontamination_equals_plain_search(spark):
    rnd = random.Random(8)
    pool = [w for _, t in ITEMS if t for w in t.split()] + ["filler", "more", "x-y"]
    texts = [" ".join(rnd.choice(pool) for _ in range(rnd.randint(0, 40))) for _ in range(60)]
    texts += ["so THE quick, brown fox jumps over the lazy dog and runs! end", "quick brown fox jumps over the lazy dog and runs away from",
              "the quick brown fox jumps over the lazy dog", "a " * 40, "ünï 你好 ÇODE Ünï 你好 çode", "it says seven words are in this short item."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.contamination(docs, items).collect()
    assert sorted(map(tuple, got)) == sorted((i, *plain_hits(t, ITEMS)) for i, t in enumerate(texts))
    clean = decontaminate.without_contaminated(docs, items)
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in got if not r["contaminated"]}


def test_decontamination_odd_rows(spark, odd, none):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.contamination(odd, items).collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(repr((r["doc_id"], *plain_hits(r["text"][:20000] if r["doc_id"] != 11 and r["text"] else r["text"], ITEMS)))
                                                         for r in odd.collect())
    assert decontaminate.contamination(none, items).count() == 0
    assert all(not r["contaminated"] for r in decontaminate.contamination(odd, items.limit(0)).collect())
    assert decontaminate.without_contaminated(odd, items).columns == odd.columns


def test_decontamination_is_native(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = decontaminate.contamination(docs, spark.createDataFrame(ITEMS, "item_id long, text string"))._jdf.queryExecution().toString()
    plan += rules.judge(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


# ---------------------------------------------------------------- line deduplication
def plain_repeats(rows, min_words=line_dedup.MIN_WORDS):
    first, out = {}, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        at = 0
        for line in (text or "").split("\n"):
            w = words(ascii_lower(line))
            if len(w) >= min_words:
                unit = " ".join(w)
                if unit in first:
                    out.append((doc_id, at, at + len(line), hashlib.md5(unit.encode()).hexdigest(), *first[unit]))
                else:
                    first[unit] = (doc_id, at)
            at += len(line) + 1
    return sorted(map(repr, out))


def test_line_dedup(odd, none):
    rows = odd.filter("doc_id != 12").select("doc_id", "text").collect()
    got = line_dedup.repeated_spans(odd.filter("doc_id != 12")).collect()
    assert sorted(repr((r["doc_id"], r["start"], r["end"], r["digest"], r["kept_doc_id"], r["kept_start"])) for r in got) == plain_repeats(map(tuple, rows))
    assert line_dedup.repeated_spans(none).count() == 0
    cleaned = {r["doc_id"]: r for r in line_dedup.without_repeats(odd.filter("doc_id != 12 and doc_id != 6")).collect()}
    assert cleaned[7]["text"] == "short\n" * 6 and len(cleaned[7]["removed_spans"]) == 6 and cleaned[2]["text"] is None
    assert cleaned[1]["text"].count("alpha") == 1


def test_line_dedup_rank_and_paragraphs(spark):
    p = "one two three four five six"
    docs = spark.createDataFrame([(1, f"{p}\nseven\n\nrest", 9), (2, f"x\n\n{p}\nseven", 1)], "doc_id long, text string, importance long")
    got = line_dedup.repeated_spans(docs, rank_col="importance", kind="paragraph").collect()
    assert [(r["doc_id"], r["start"], r["end"], r["kept_doc_id"], r["kept_start"]) for r in got] == [(1, 0, len(p) + 6, 2, 3)]


# ---------------------------------------------------------------- WARC
def test_warc_round_trip(spark):
    html = ["<p>a</p>", "<p>a</p>", None, "", "\r\n\r\nWARC/1.1\r\n\r\n", "ünï", "<p>a</p>", "big" * 100000]
    pages = spark.createDataFrame([(i, f"http://h/{i}\r\nX: y", h) for i, h in enumerate(html)] + [(6, "http://h/6", html[6]), (None, None, "<p>a</p>")],
                                  "page_id long, url string, html string").withColumn("winner", F.lit(1)).repartition(2)
    for least, empty_type in ((0, "revisit"), (1, "response")):
        manifest = warc.write_archives(pages, common.new_path(spark, "test-warc"), min_bytes=least, roll_bytes=1000)
        got = sorted(warc.read_archives(manifest).collect(), key=lambda r: (r["page_id"] is None, r["page_id"]))
        assert len(got) == 10 and manifest.agg(F.sum("n_records")).first()[0] == 10
        by = {r["page_id"]: r for r in got}
        assert by[0]["record_type"] == by[1]["record_type"] == by[None]["record_type"] == "revisit" and by[0]["refers_to"] == 6
        assert sum(r["page_id"] == 6 and r["record_type"] == "response" for r in got) == 2
        assert by[2]["record_type"] == empty_type and by[3]["record_type"] == "response" and by[2]["refers_to"] == (3 if least == 0 else None)
        for r in got:
            payload = (html[r["page_id"]] if r["page_id"] is not None else "<p>a</p>") or ""
            assert r["payload_bytes"] == len(payload.encode()) and r["payload_digest"] == warc.digest_of(payload.encode())
    empty = warc.write_archives(pages.limit(0), common.new_path(spark, "test-warc"))
    assert warc.read_archives(empty).count() == 0


def test_warc_headers():
    data = warc.record_bytes(3, "http://a/b c", b"x", 9, True)
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: revisit") and b"WARC-Refers-To: " + warc.record_id(9, warc.digest_of(b"x")).encode() in data
    assert b"http://a/b%20c" in data and data.endswith(b"\r\n\r\n")


def test_files_are_read_back_by_as_many_tasks(spark, monkeypatch):
    """A number of partitions that adaptive execution does not fold into one."""
    paths = common.staged(spark.range(40).select(F.concat(F.lit("file:///x/"), F.col("id")).alias("path"), F.col("id").alias("part"),
                                                 F.col("id").alias("seq"), F.lit(1).alias("n_tokens")), "paths")
    monkeypatch.setattr(common, "staged", lambda df, name: df)  # plans only: there are no such files
    for df in (warc.read_archives(paths), token_binary.read_tokens(paths)):
        assert "REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString()
        assert ", 40), REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString()


def test_rules_sample_is_scanned_by_many_tasks(spark):
    docs = spark.range(0, 800, 1, 8).select(F.col("id").alias("doc_id"), F.lit("some words here " * 30).alias("text"))
    ordered = rules.order_rules(docs, rules.default_rules())
    assert {r.name for r, _, _ in ordered} == {r.name for r in rules.default_rules()}
