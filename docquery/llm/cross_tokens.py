"""Alignment of the tokens of two tokenizers over the same bytes, and corpus-wide counts of linked token ids.

A and B tokens of a text are intervals of the bytes of space+text.  All intervals are sorted by start and the
greatest end so far runs along them; where a start reaches it, both tokenizers have ended and a new group begins.
Within a group every A token is linked with the B tokens that overlap it.

Both tokenizers cut where a blank or a newline follows a character that is no white space, and between a letter and
one of some marks (no pre-token of A and no piece of B holds such a place), so a text is cut there first.  Parts repeat
far more often than texts: new parts of a block are encoded as few long texts and aligned together, and their groups
and links stay in a bounded memo of the worker.  Parts whose bytes a tokenizer does not give back make their texts token-less.

How it is spread: a task cuts its rows into blocks of bounded length.  A block gives one row per document (digest of
its groups, and its distinct links as places in the block's dictionary with their numbers) and one dictionary row (the distinct id
pairs of the block, each with the number of its documents).  Counts are a partial aggregate of dictionary entries by id
pair; then the entries of each dictionary are joined with them and come back to their block, where documents
only look up places.  An id pair occurs once in a block, however frequent it is, so no key is hot, and the links
of the corpus are never rows of a shuffle.

Cases: null and empty texts, and texts that either tokenizer changes, have no tokens: zeros and an empty digest.
Rows that share an id, or are equal, are documents of their own.  Null ids are kept.  Extra columns are ignored; an
empty table gives none.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
BLOCK_CHARS = 4_000_000  # a block ends with the document that reaches this length
MEMO_PARTS = 250_000     # parts in each of the two halves of a worker's memo
MEMO_CHARS = 60          # longer parts are not kept
JOINED = 1_000           # parts that are encoded as one text
# between a letter and a mark (superscripts are no letters here: B has a piece of one and a full stop)
CUT = re.compile("(?<=[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f])(?=[.,;:!?&%$#*|])")
WORD_MARK = "\u2581"     # how B writes a blank

STAGED = ("block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, place binary, times binary, "
          "pairs array<long>, docs array<int>")
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER_A), public_tokenizers.path(TOKENIZER_B)


# ---------------------------------------------------------------- the two tokenizers
def byte_of_sign() -> dict[str, int]:
    """Signs of byte-level vocabularies: printable Latin-1 characters are their own byte, all other bytes follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {**{chr(b): b for b in own}, **{chr(0x100 + k): b for k, b in enumerate(rest)}}


def in_merge_order(model: dict) -> bool:
    """Do ids follow the merges, one merge per token?  Then the lowest id that two neighbours make is the first merge."""
    vocab = model["vocab"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    made = [vocab.get("".join(p)) for p in pairs]
    single = [k for t, k in vocab.items() if len(t) == 1]
    return None not in made and all(x < y for x, y in zip(made, made[1:])) and len(single) == 256 and max(single) < made[0]


@functools.cache
def tokenizer_a(path: str):
    """(encode a text to ids, bytes of each id).

    The library's own encoder keeps offsets of every token; where the ids follow the merges, the ranks of the same file in the
    rank-based library give the same ids in a fraction of the time.
    """
    import json
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(path)
    tk.encode_special_tokens = True
    signs, table = byte_of_sign(), [b""] * tk.get_vocab_size()
    for token, k in tk.get_vocab().items():
        table[k] = bytes(signs[c] for c in token) if all(c in signs for c in token) else token.encode()
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    if not in_merge_order(model):
        return (lambda text: tk.encode(text, add_special_tokens=False).ids), table
    ranks = {table[k]: k for t, k in model["vocab"].items() if all(c in signs for c in t) and (len(t) == 1 or k < 256 + len(model["merges"]))}
    return tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, table


@functools.cache
def tokenizer_b(path: str):
    """The same for B, which puts a blank before every text: a text that begins with one loses it first, another loses the token."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    table = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace(WORD_MARK, " ").encode()
             for p in (sp.id_to_piece(k) for k in range(sp.get_piece_size()))]
    blank = sp.piece_to_id(WORD_MARK)

    def encode(text: str) -> list[int]:
        if text[:1] != " ":
            # its own blank joins no newline; a mark could be joined to it, so it stands behind a newline
            return sp.encode(text)[1:] if text[:1] == "\n" else sp.encode("\n" + text)[2:]
        return sp.encode(text[1:]) if len(text) > 1 else [blank]

    return encode, table


def units_of(text: str) -> list[str]:
    """A blank and the text, cut before every blank or newline that follows a character that is no white space.

    A unit of one blank and no white space at its end is named without the blank, any other by its text.
    """
    pieces = text.replace("\n", " \n").split(" ")  # a newline begins a piece and stands for itself, other pieces follow a blank
    if "" not in pieces and not any(p[-1].isspace() for p in pieces):
        return pieces
    out, held = [], ""  # white space waits for what follows
    for p in pieces:
        if not p or p[-1].isspace():
            held += p if p[:1] == "\n" else " " + p
        else:
            out.append(held + (p if p[:1] == "\n" else " " + p) if held else p)
            held = ""
    return [*out, held] if held else out


def text_of(unit: str) -> str:
    return unit if unit[0] in " \n" else " " + unit


# ---------------------------------------------------------------- interval coalescing
def coalesced(starts_a, ends_a, starts_b, ends_b) -> tuple[np.ndarray, np.ndarray]:
    """Group numbers of the A and of the B intervals."""
    start, end = np.concatenate([starts_a, starts_b]), np.concatenate([ends_a, ends_b])
    order = np.lexsort((np.repeat([0, 1], [len(starts_a), len(starts_b)]), start))
    reach = np.maximum.accumulate(end[order])
    begins = np.ones(len(order), bool)
    begins[1:] = start[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(begins) - 1
    return group[:len(starts_a)], group[len(starts_a):]


def overlaps(starts_a, ends_a, starts_b, ends_b) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the A and B intervals of every overlapping pair; both sides are sorted and free of gaps."""
    first, last = np.searchsorted(ends_b, starts_a, "right"), np.searchsorted(starts_b, ends_a, "left")
    times = last - first
    a = np.repeat(np.arange(len(starts_a)), times)
    return a, np.arange(len(a)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first, times)


Part = tuple[int, str, bytes]  # numbers of A tokens, B tokens and groups in one integer, groups as text, links as 32-bit numbers
SHIFT = 40                       # bits of each of the three numbers


def flat_ids(parts: list[str], encode, table: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of all parts in order, their number in each part, which parts the tokenizer gives back).

    Parts that begin with a blank and end without are encoded as one text, in which the same cuts hold; others, and
    texts whose parts do not come back, one by one.
    """
    lengths = np.array([len(b) for b in table], np.int64)
    ids, counts, whole = [], np.zeros(len(parts), np.int64), np.ones(len(parts), bool)

    def alone(k: int) -> None:
        own = encode(parts[k])
        ids.append(np.array(own, np.uint32))
        counts[k], whole[k] = len(own), b"".join([table[i] for i in own]) == parts[k].encode("utf-8", "replace")

    at = 0
    while at < len(parts):
        to = at
        while to < len(parts) and to - at < JOINED and parts[to][0] == " " and not parts[to][-1].isspace():
            to += 1
        if to == at:
            alone(at)
            at += 1
            continue
        own = encode("".join(parts[at:to]))
        plain = [p.encode("utf-8", "replace") for p in parts[at:to]]
        own_ids = np.array(own, np.uint32)
        ends, stops = np.cumsum(lengths[own_ids]), np.cumsum([len(b) for b in plain])
        last = np.minimum(np.searchsorted(ends, stops), len(ends) - 1)
        if b"".join([table[i] for i in own]) == b"".join(plain) and (ends[last] == stops).all():
            ids.append(own_ids)
            counts[at:to] = np.diff(last, prepend=-1)
        else:
            for k in range(at, to):
                alone(k)
        at = to
    return np.concatenate(ids) if ids else np.zeros(0, np.uint32), counts, whole


def aligned(parts: list[str], path_a: str, path_b: str) -> list[Part | None]:
    """What the parts hold; None for those that a tokenizer changes."""
    order = sorted(range(len(parts)), key=lambda k: parts[k][0] != " " or parts[k][-1].isspace())
    tables = [tokenizer_a(path_a), tokenizer_b(path_b)]
    sides = [flat_ids([parts[k] for k in order], *t) for t in tables]
    keep = sides[0][2] & sides[1][2]
    out: list[Part | None] = [None] * len(parts)
    if not keep.any():
        return out
    # the parts one after the other: their ends are common ends of both sides
    (a, start_a, end_a, from_a), (b, start_b, end_b, from_b) = (
        (own := ids[np.repeat(keep, counts)], np.concatenate([[0], (ends := np.cumsum(np.array([len(x) for x in table], np.int64)[own]))[:-1]]), ends,
         np.concatenate([[0], np.cumsum(counts[keep])])) for (ids, counts, _), (_, table) in zip(sides, tables))
    group_a, group_b = coalesced(start_a, end_a, start_b, end_b)
    left, right = overlaps(start_a, end_a, start_b, end_b)
    links = (a[left] << np.uint32(16) | b[right]).astype("<u4")
    number = np.arange(group_a[-1] + 2)
    cut_a, cut_b = np.searchsorted(group_a, number).tolist(), np.searchsorted(group_b, number).tolist()
    text_a, text_b = [str(i) for i in a.tolist()], [str(i) for i in b.tolist()]
    shown = [",".join(text_a[i:j]) + "|" + ",".join(text_b[k:m]) for i, j, k, m in zip(cut_a, cut_a[1:], cut_b, cut_b[1:])]
    from_group = np.concatenate([group_a[from_a[:-1]], [len(shown)]])
    numbers = zip(np.diff(from_a).tolist(), np.diff(from_b).tolist(), np.diff(from_group).tolist())
    from_link, from_group, stored = (4 * np.searchsorted(left, from_a)).tolist(), from_group.tolist(), links.tobytes()
    for n, (k, (x, y, z)) in enumerate(zip(np.array(order)[keep].tolist(), numbers)):
        out[k] = (x | y << SHIFT | z << 2 * SHIFT, ";".join(shown[from_group[n]:from_group[n + 1]]), stored[from_link[n]:from_link[n + 1]])
    return out


class Memo:
    """Values of a worker in two halves: one found in the old half moves to the new one, and a full new half becomes the old."""

    def __init__(self, limit: int):
        self.limit, self.new, self.old = limit, {}, {}

    def add(self, key: str, value) -> None:
        if len(key) > MEMO_CHARS:
            return
        if len(self.new) >= self.limit:
            self.new, self.old = {}, self.new
        self.new[key] = value

    def known(self, keys: set[str]) -> dict:
        """The values of those keys that are kept."""
        new, old = self.new, self.old
        found = {k: new[k] for k in keys if k in new}
        again = {k: old[k] for k in keys if k in old and k not in found}
        for k, v in again.items():
            self.add(k, v)
        return {**found, **again}


@functools.cache
def worker_memo(path_a: str, path_b: str) -> tuple[Memo, Memo]:
    """Of units, and of what follows the first cut of a unit."""
    return Memo(MEMO_PARTS), Memo(MEMO_PARTS // 4)


def joined(values: list[Part | None]) -> Part | None:
    if None in values:
        return None
    numbers, shown, links = zip(*values)
    return sum(numbers), ";".join(shown), b"".join(links)


def unit_values(units: set[str], path_a: str, path_b: str) -> dict[str, Part | None]:
    """What the units hold: kept values, values put together from kept parts, and newly aligned ones."""
    heads, tails = worker_memo(path_a, path_b)
    values = heads.known(units)
    cut = {u: CUT.split(text_of(u)) for u in units if u not in values}
    head_of = {u: c[0][1:] if u[0] not in " \n" else c[0] for u, c in cut.items()}
    wanted_heads, wanted_tails = set(head_of.values()), {t for c in cut.values() for t in c[1:]}
    head_values = {h: values[h] for h in wanted_heads if h in values}
    head_values |= heads.known(wanted_heads - head_values.keys())
    tail_values = tails.known(wanted_tails)
    new_heads, new_tails = list(wanted_heads - head_values.keys()), list(wanted_tails - tail_values.keys())
    found = aligned([*map(text_of, new_heads), *new_tails], path_a, path_b) if new_heads or new_tails else []
    for memo, table, keys, own in ((heads, head_values, new_heads, found[:len(new_heads)]), (tails, tail_values, new_tails, found[len(new_heads):])):
        table.update(zip(keys, own))
        for k, v in zip(keys, own):
            memo.add(k, v)
    for u, c in cut.items():
        if len(c) == 1:
            values[u] = head_values[head_of[u]]
        else:
            values[u] = joined([head_values[head_of[u]], *[tail_values[t] for t in c[1:]]])
            heads.add(u, values[u])
    return values


EMPTY = ((0, 0, 0, 0, ""), np.zeros(0, np.uint32), np.zeros(0, np.int64))


def measured(texts: list[str], path_a: str, path_b: str) -> list[tuple[tuple, np.ndarray, np.ndarray]]:
    """Of each text: (n_a, n_b, n_groups, n_links, groups_sha256), its distinct links and how often each occurs."""
    cut = [units_of(t) if t else [] for t in texts]
    values = unit_values(set().union(*cut), path_a, path_b)
    out = []
    for units in cut:
        whole = joined([values[u] for u in units]) if units else None
        if whole is None:
            out.append(EMPTY)
            continue
        total, shown, links = whole
        links, mask = np.frombuffer(links, "<u4"), (1 << SHIFT) - 1
        ids, times = np.unique(links, return_counts=True)
        out.append(((total & mask, total >> SHIFT & mask, total >> 2 * SHIFT, len(links), hashlib.sha256(shown.encode()).hexdigest()), ids, times))
    return out


# ---------------------------------------------------------------- blocks and counts
def block_rows(block: int, doc_ids: list, texts: list[str], paths: tuple[str, str], schema: pa.Schema) -> pa.RecordBatch:
    """A row per document, and the block's dictionary."""
    docs = measured(texts, *paths)
    ids, place, number = np.unique(np.concatenate([d[1] for d in docs]), return_inverse=True, return_counts=True)
    cuts = np.cumsum([0] + [len(d[1]) for d in docs])
    rows = [{"block": block, "doc_id": k, "n_a": m[0], "n_b": m[1], "n_groups": m[2], "n_links": m[3], "groups_sha256": m[4],
             "place": place[cuts[n]:cuts[n + 1]].astype("<u4").tobytes(), "times": times.astype("<u4").tobytes()}
            for n, (k, (m, _, times)) in enumerate(zip(doc_ids, docs))]
    rows.append({"block": block, "pairs": ids.astype(np.int64), "docs": number.astype(np.int32)})
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def block_table(docs: DataFrame, id_col: str, text_col: str, paths: tuple[str, str]) -> DataFrame:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in STAGED.split(", "))])

    def run(batches):
        part, seq, ids, texts, chars = common.partition_id() << 32, 0, [], [], 0
        for doc_id, text in common.arrow_rows(batches, "doc_id", "_t"):
            ids.append(doc_id)
            texts.append(text)
            chars += len(text)
            if chars >= BLOCK_CHARS:
                yield block_rows(part + seq, ids, texts, paths, schema)
                seq, ids, texts, chars = seq + 1, [], [], 0
        if ids:
            yield block_rows(part + seq, ids, texts, paths, schema)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_or_empty(text_col).alias("_t"))
    return common.staged(texts.mapInArrow(run, STAGED), "cross-blocks")


def pair_counts(dictionary: DataFrame) -> DataFrame:
    """(pair, count, best): documents that hold the id pair linked, and whether none of the A id's pairs has more."""
    counts = common.staged(dictionary.groupBy("pair").agg(F.sum("docs").alias("count")), "cross-counts")
    a = F.shiftright("pair", 16)
    most = counts.groupBy(a.alias("a")).agg(F.max("count").alias("most"))
    return counts.withColumn("a", a).join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def align_documents(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    common.small_batches(docs.sparkSession)
    table = block_table(docs, id_col, text_col, (path_a, path_b))
    dictionary = table.filter("pairs IS NOT NULL").select("block", F.posexplode(F.arrays_zip("pairs", "docs")).alias("at", "e")).select(
        F.col("block").alias("of"), "at", F.col("e.pairs").alias("pair"), F.col("e.docs").alias("docs"))
    looked_up = dictionary.join(pair_counts(dictionary), "pair").select("of", "at", "count", "best")
    rows = table.filter("pairs IS NULL").drop("pairs", "docs")

    def run(own: pa.Table, entries: pa.Table) -> pa.Table:
        counts, best = np.zeros(len(entries), np.int64), np.zeros(len(entries), np.int64)
        at = entries.column("at").to_numpy()
        counts[at], best[at] = entries.column("count").to_numpy(), entries.column("best").to_numpy(zero_copy_only=False)
        places, times = ([np.frombuffer(v, "<u4").astype(np.int64) for v in own.column(c).to_pylist()] for c in ("place", "times"))
        sums = [[int((x[p] * t).sum()) for p, t in zip(places, times)] for x in (best, counts)]
        return pa.Table.from_arrays([own.column("doc_id"), *[own.column(c) for c in ("n_a", "n_b", "n_groups", "n_links")],
                                     *[pa.array(s, pa.int64()) for s in sums], own.column("groups_sha256")], names=[f.split()[0] for f in RESULT.split(", ")])

    return rows.groupBy("block").cogroup(looked_up.groupBy("of")).applyInArrow(run, RESULT)


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups, links and link counts of two tokenizers over every document."""
    return align_documents(common.table(spark, sf_dir, "documents"), *default_paths())
