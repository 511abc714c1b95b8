"""Token counts per section by offset-mapped attribution.

Each document is encoded once as a whole; the character spans of its tokens are joined to the intervals of
its sections by binary search over the sorted section starts.  A token that lies across a boundary is given
to sections by an explicit rule:

- ``first``: to the section of its first character,
- ``last``: to the section of its last character,
- ``largest``: to the section that holds most of its characters, the earlier one of equals,
- ``split``: to every section it touches, in proportion to the characters there.

Counts of a document always add up to its tokens.  Sections are the pieces of the text that end with the
separator (a section includes its separator; the last one has none), or the fields of a record, which are
rendered into one text (``render_fields``) and so encoded with the context they are trained in.

Cases: null is the empty text; an empty text has one empty section without tokens.  A text that ends with
the separator has a last empty section.  Texts of any length are encoded whole.  Extra columns are ignored;
repeated rows give repeated results; an empty table gives none.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .pieces import Pieces
from .token_binary import default_tokenizer, load_tokenizer

RULES = ("first", "last", "largest", "split")
SEPARATOR = "\n"
MEMO_PARTS = 400_000

SCHEMA = "doc_id long, section_no int, start long, end long, n_tokens double, n_crossing long"


@functools.cache
def worker_spans(path: str) -> Pieces:
    """Memo of token spans of the parts of texts: (starts, ends, characters, tokens)."""
    tk = load_tokenizer(path)

    def spans(s: str):
        offsets = np.array(tk.encode(s, add_special_tokens=False).offsets, "<i4").reshape(-1, 2)
        return offsets[:, 0].tobytes(), offsets[:, 1].tobytes(), len(s), len(offsets)

    return Pieces(spans, MEMO_PARTS)


def token_spans(parts: Pieces, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive), in code points, of every token of the whole text."""
    values = parts.values(text)
    if not values:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lengths = np.fromiter((v[2] for v in values), np.int64, len(values))
    counts = np.fromiter((v[3] for v in values), np.int64, len(values))
    base = np.repeat(np.cumsum(lengths) - lengths, counts)
    return (np.frombuffer(b"".join([v[0] for v in values]), "<i4") + base,
            np.frombuffer(b"".join([v[1] for v in values]), "<i4") + base)


def section_starts(text: str, separator: str) -> np.ndarray:
    lengths = [len(x) + len(separator) for x in text.split(separator)]
    return np.cumsum([0, *lengths[:-1]])


def attribute(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray, size: int, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) of each section; sections are given by their starts, the text has ``size`` characters.

    A crossing token is counted as such in the section of its first character.
    """
    first = np.searchsorted(sections, starts, "right") - 1
    last = np.searchsorted(sections, np.maximum(ends - 1, starts), "right") - 1
    crossing = first != last
    n_crossing = np.bincount(first[crossing], minlength=len(sections))
    home = last if rule == "last" else first
    counts = np.bincount(home[~crossing] if rule in ("largest", "split") else home, minlength=len(sections)).astype(float)
    if rule in ("largest", "split"):
        bounds = np.append(sections, size)
        for k in np.flatnonzero(crossing):
            touched = np.arange(first[k], last[k] + 1)
            held = np.minimum(bounds[touched + 1], ends[k]) - np.maximum(bounds[touched], starts[k])
            if rule == "largest":
                counts[touched[np.argmax(held)]] += 1
            else:
                counts[touched] += held / held.sum()
    return counts, n_crossing


def render_fields(*names: str) -> Column:
    """One text of several columns, each ended by the separator (null fields are empty)."""
    return F.concat(*[F.concat(common.text_or_empty(n), F.lit(SEPARATOR)) for n in names])


def count_tokens(docs: DataFrame, tokenizer: str, rule: str = "first", separator: str = SEPARATOR, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per section of each document: doc_id, section_no, start, end, n_tokens, n_crossing."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {', '.join(RULES)}")
    common.small_batches(docs.sparkSession)

    def run(batches):
        parts = worker_spans(tokenizer)
        for b in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                starts, ends = token_spans(parts, text)
                sections = section_starts(text, separator)
                counts, crossing = attribute(starts, ends, sections, len(text), rule)
                n = len(sections)
                for c, v in zip(cols, ([doc_id] * n, np.arange(n), sections, np.append(sections[1:], len(text)), counts, crossing)):
                    c.append(v)
            if cols[0]:
                ids = [x for c in cols[0] for x in c]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(np.concatenate(cols[1]).astype(np.int32)),
                     *(pa.array(np.concatenate(c).astype(np.int64)) for c in cols[2:4]),
                     pa.array(np.concatenate(cols[4])), pa.array(np.concatenate(cols[5]).astype(np.int64))],
                    names=["doc_id", "section_no", "start", "end", "n_tokens", "n_crossing"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document, boundary-crossing tokens given to the line they start in."""
    counted = count_tokens(common.table(spark, sf_dir, "documents"), default_tokenizer(), "first")
    return counted.withColumn("n_tokens", F.col("n_tokens").cast("long"))
