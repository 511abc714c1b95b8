"""Masks of many queries on every chunk, made in the task that reads the chunk: Arrow batches in, classes and few chunks out.

The masks of a block of queries (see :func:`docquery.operators.search.token_masks`) are turned into arrays by token and broadcast.
A task reads a chunk's tokens, brings up the masks of each token, and joins them by (chunk, query) with ``bit_or`` in numpy.
These rows, queries times chunks in number, live in memory for one slice of a batch; no row of theirs is written, shuffled or sent to the JVM.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquery.functions.vectors import tokens
from docquery.session import broadcast_if_small, cut_lineage

SLICE = 1 << 21  # masks that a task holds at once, but for one chunk


# ---------------------------------------------------------------- chunks
def shared_ids(chunks: DataFrame) -> DataFrame:
    """``chunk_id, context_id`` of ids that more than one row has."""
    return chunks.groupBy("context_id", "chunk_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("chunk_id", "context_id")


def whole_chunks(chunks: DataFrame, shared: DataFrame | None = None) -> DataFrame:
    """``context_id, chunk_id, tokens, texts`` – one row per chunk: rows that share an id bring their tokens and texts together.

    Only those rows are shuffled.  ``shared``: stored :func:`shared_ids`; a ``tokens`` column is taken as it is."""
    token = F.col("tokens") if "tokens" in chunks.columns else F.array_distinct(tokens(F.col("chunk_text")))
    rows = chunks.select("context_id", "chunk_id", token.alias("tokens"), F.array("chunk_text").alias("texts"))
    shared = cut_lineage(shared_ids(chunks) if shared is None else shared)
    if shared.isEmpty():
        return rows
    ids = broadcast_if_small(shared.select(F.col("chunk_id").alias("_id"), F.col("context_id").alias("_ctx")))
    same = (F.col("chunk_id") == F.col("_id")) & F.col("context_id").eqNullSafe(F.col("_ctx"))
    together = rows.join(ids, same, "left_semi").groupBy("context_id", "chunk_id").agg(
        F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("tokens"), F.flatten(F.collect_list("texts")).alias("texts"))
    return rows.join(ids, same, "left_anti").unionByName(cut_lineage(together))


# ---------------------------------------------------------------- masks of a block of queries
@dataclass
class Masks:
    """Masks by token: those of ``tokens[t]`` are ``query[start[t]:start[t + 1]]`` and so on; a mask holds ``fm, im, cm``, ``bits`` each."""

    ids: pa.Array  # query ids; a query is its place here
    tokens: pa.Array
    start: np.ndarray
    query: np.ndarray
    context: np.ndarray  # place in contexts, -1: every context
    mask: np.ndarray
    contexts: pa.Array
    bits: int


def masks_by_token(masks: DataFrame) -> Masks:
    """``token, query_id, q_ctx, fm, im, cm`` of one block, whose bytes are bounded, as arrays."""
    t = masks.where("query_id IS NOT NULL").toArrow()

    def coded(name):
        c = t.column(name).combine_chunks()
        values = pc.unique(c).drop_null()
        return values, np.asarray(pc.fill_null(pc.index_in(c, value_set=values), -1), dtype=np.int64)

    token, at = coded("token")
    ids, query = coded("query_id")
    contexts, context = coded("q_ctx")
    fm, im, cm = (np.asarray(t.column(c), dtype=np.int64) for c in ("fm", "im", "cm"))
    bits = max(1, *(int(x.max(initial=0)).bit_length() for x in (fm, im, cm)))
    order = np.argsort(at, kind="stable")
    start = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(token)))])
    mask = fm | im << bits | cm << 2 * bits
    return Masks(ids, token, start, query[order].astype(np.int32), context[order].astype(np.int32), mask[order], contexts, bits)


def _joined(cell: np.ndarray, mask: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The cells, ascending, and the ``bit_or`` of their masks."""
    if int(cell.max(initial=0)).bit_length() + bits <= 62:
        both = np.sort(cell << bits | mask)
        cell, mask = both >> bits, both & ((1 << bits) - 1)
    else:
        order = np.argsort(cell, kind="stable")
        cell, mask = cell[order], mask[order]
    if not len(cell):
        return cell, mask
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    return cell[first], np.bitwise_or.reduceat(mask, first)


def chunk_rows(batch: pa.RecordBatch, m: Masks) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunk, query, mask) of a batch with ``context_id, tokens``, slice by slice, by chunk."""
    lists = batch.column("tokens")
    flat, ends = lists.flatten(), np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(lists), 0), dtype=np.int64))
    at = np.asarray(pc.fill_null(pc.index_in(flat, value_set=m.tokens), -1), dtype=np.int64)
    chunk = np.searchsorted(ends, np.arange(len(at)), side="right")
    chunk, at = chunk[at >= 0], at[at >= 0]
    held = m.start[at + 1] - m.start[at]
    upto = np.cumsum(np.bincount(chunk, weights=held, minlength=batch.num_rows).astype(np.int64))  # masks of the chunks up to this
    context = np.asarray(pc.fill_null(pc.index_in(batch.column("context_id"), value_set=m.contexts), -2), dtype=np.int64)
    first, n = 0, len(m.ids)
    while first < batch.num_rows:
        done = upto[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(upto, done + SLICE, side="right")))
        a, b = np.searchsorted(chunk, [first, last])
        size = held[a:b]
        ends_at = np.cumsum(size)
        place = np.arange(ends_at[-1] if b > a else 0) - np.repeat(ends_at - size, size) + np.repeat(m.start[at[a:b]], size)
        row = np.repeat(chunk[a:b], size)
        asked = m.context[place]
        own = (asked < 0) | (asked == context[row])
        if not own.all():
            place, row = place[own], row[own]
        cell, mask = _joined(row * n + m.query[place], m.mask[place], 3 * m.bits)
        if len(cell):
            yield cell // n, cell % n, mask
        first = last


def _split(mask: np.ndarray, bits: int) -> list[pa.Array]:
    return [pa.array((mask >> k * bits & ((1 << bits) - 1)).astype(np.int32)) for k in range(3)]


def count_classes(batches: Iterator[pa.RecordBatch], m: Masks) -> Iterator[pa.RecordBatch]:
    """``query_id, fm, im, cm, chunks`` of each slice."""
    for batch in batches:
        for _, query, mask in chunk_rows(batch, m):
            code, values = pd.factorize(mask)
            place, found = pd.factorize(query * len(values) + code)
            yield pa.RecordBatch.from_arrays(
                [m.ids.take(pa.array(found // len(values))), *_split(values[found % len(values)], m.bits), pa.array(np.bincount(place).astype(np.int64))],
                names=["query_id", "fm", "im", "cm", "chunks"])


# ---------------------------------------------------------------- chunks of the classes in reach
@dataclass
class Reach:
    """Classes in reach (places of :class:`Masks`) with their kind, and the terms of every query by bit."""

    masks: np.ndarray
    keys: np.ndarray  # query * len(masks) + place of the mask
    open: np.ndarray
    terms: list


def reach_of(classes: DataFrame, terms: DataFrame, m: Masks) -> Reach:
    """``query_id, fm, im, cm, open`` and ``query_id, terms`` of one block as arrays."""
    c, t = classes.toArrow(), terms.toArrow()
    query = np.asarray(pc.index_in(c.column("query_id").combine_chunks(), value_set=m.ids), dtype=np.int64)
    fm, im, cm = (np.asarray(c.column(x), dtype=np.int64) for x in ("fm", "im", "cm"))
    values, code = np.unique(fm | im << m.bits | cm << 2 * m.bits, return_inverse=True)
    said = dict(zip(t.column("query_id").to_pylist(), t.column("terms").to_pylist()))
    return Reach(values, query * max(1, len(values)) + code, np.asarray(c.column("open").to_pylist(), dtype=bool), [said.get(q, []) for q in m.ids.to_pylist()])


def _places(text: str, term: str) -> tuple[int, int]:
    """The first and the last place of a term (``?``: any one character), -1 if absent."""
    if "?" not in term:
        return text.find(term), text.rfind(term)
    found = [x.start() for x in re.finditer("(?=" + ".".join(map(re.escape, term.split("?"))) + ")", text, re.DOTALL)]
    return (found[0], found[-1]) if found else (-1, -1)


def text_flags(text: str, terms: list[str], im: int, cm: int, seen: dict) -> tuple[int, list[int], bool]:
    """``im`` with the open terms decided, ``o`` (``o[x]`` has bit ``y`` where ``O(x, y)``), and whether no order is missing."""
    def at(k):
        if terms[k] not in seen:
            seen[terms[k]] = _places(text, terms[k])
        return seen[terms[k]]

    for k in range(len(terms)):
        if cm >> k & 1 and at(k)[0] >= 0:
            im |= 1 << k
    o, full = [0] * len(terms), True
    there = [k for k in range(len(terms)) if im >> k & 1]
    for x in there:
        first = at(x)[0]
        for y in there:
            if x != y:
                if 0 <= first and first + len(terms[x]) <= at(y)[1]:
                    o[x] |= 1 << y
                else:
                    full = False
    return im, o, full


def reached_chunks(batches: Iterator[pa.RecordBatch], m: Masks, reach: Reach, n: int) -> Iterator[pa.RecordBatch]:
    """``query_id, chunk_id, fm, im, o`` of chunks in reach, which come by ascending id.

    Of a class that is not open the first n of the task are enough.  An open class needs the text: the first n of equal ``fm, im, o`` are enough,
    and none is needed after n that have all their terms in every order, as no score is higher."""
    if not len(reach.keys):
        return
    masks, keys = pd.Index(reach.masks), pd.Index(reach.keys)
    enough = np.zeros(len(keys), dtype=np.int64)  # chunks of a class after which no other counts
    alike = defaultdict(int)
    low = (1 << m.bits) - 1
    for batch in batches:
        out = [], [], [], [], []

        def add(query, chunk, fm, im, o):
            for column, value in zip(out, (query, chunk, fm, im, o)):
                column.extend(value)

        for chunk, query, mask in chunk_rows(batch, m):
            code = masks.get_indexer(mask)
            known = code >= 0
            place = np.full(len(mask), -1, dtype=np.int64)
            place[known] = keys.get_indexer(query[known] * len(masks) + code[known])
            need = np.flatnonzero((place >= 0) & (enough[place] < n))
            chunk, query, mask, place = chunk[need], query[need], mask[need], place[need]
            opened = reach.open[place]
            # closed classes: number the slice's chunks of each class on from those before
            own = np.flatnonzero(~opened)
            by = own[np.argsort(place[own], kind="stable")]
            if len(by):
                first = np.flatnonzero(np.concatenate([[True], place[by][1:] != place[by][:-1]]))
                size = np.diff(np.concatenate([first, [len(by)]]))
                nth = np.arange(len(by)) - np.repeat(first, size) + enough[place[by]]
                enough[place[by][first]] += size
                by = by[nth < n]
                add(query[by], chunk[by], mask[by] & low, mask[by] >> m.bits & low, [[]] * len(by))
            last, texts, seen = -1, [], []
            for c, q, v, p in zip(*(x[opened].tolist() for x in (chunk, query, mask, place))):
                if enough[p] >= n:
                    continue
                if c != last:
                    last, texts = c, [text or "" for text in batch.column("texts")[c].as_py()]
                    seen = [{} for _ in texts]
                for text, places in zip(texts, seen):
                    im, o, full = text_flags(text, reach.terms[q], v >> m.bits & low, v >> 2 * m.bits, places)
                    group = p, im, tuple(o)
                    if alike[group] < n:
                        alike[group] += 1
                        add([q], [c], [v & low], [im], [o])
                    enough[p] += full and v >> 2 * m.bits == 0
        if out[0]:
            yield pa.RecordBatch.from_arrays(
                [m.ids.take(pa.array(out[0], pa.int64())), batch.column("chunk_id").take(pa.array(out[1], pa.int64())), pa.array(out[2], pa.int32()),
                 pa.array(out[3], pa.int32()), pa.array(out[4], pa.list_(pa.int32()))], names=["query_id", "chunk_id", "fm", "im", "o"])
