"""Secret scan: fixed patterns, and guess cost of values in credential contexts.

Patterns (kinds ``assign``, ``access``, ``hex``) are matched over the whole text, leftmost and without
overlap per kind; matches that are too short are dropped.  The method adds kind ``value``: the value that
follows a credential word (``client_secret: ...``, ``pwd = ...``, ``Authorization: Bearer ...``) when the
cheapest way to guess it costs at least ``min_cost`` (log10 of guesses).  That cost is the minimum over all
segmentations into known words, dates, repeats, keyboard walks and brute-force characters, found by dynamic
programming over positions in time linear in the value for bounded word and unit lengths.

Unquoted values without a digit may be prose, so they are scored with the words of two public vocabularies
added to the known ones; they need the same ``min_cost``.  Prose of several joined words can reach it.

Offsets count code points, ends are exclusive.  Null is the empty text.  A value of any length is scored
whole.  Repeated rows give repeated results; extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("assign", "access", "hex", "value")  # order among spans with one start
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret(?:[_-]?key)?|token|credentials?|(?:api|access|private|auth)[_-]?key|authorization|bearer)"""
    r"""["']?\s*(?:=>|[:=])\s*(?:(?:bearer|basic)\s+)?(?:"([^"\r\n]{6,})"|'([^'\r\n]{6,})'|([^\s"'<>]{6,}))""", re.I | re.A)
MIN_ASSIGN, MIN_ACCESS = 6, 20
MIN_COST = 10.0  # log10 of guesses from which a value is taken for a secret

# Words that are tried first, most common first.
WORDS = """password passwd secret admin welcome letmein changeme default example test login master
hello monkey dragon football baseball sunshine princess shadow superman trustno access pass user root
guest public private service server system token key api demo sample value string none null true false
your here insert enter replace todo xxxx love iloveyou summer winter spring autumn monday friday
january february march april june july august september october november december""".split()
# Neighbouring keys of a common keyboard, and runs of the alphabet and of digits.
WALKS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "abcdefghijklmnopqrstuvwxyz", "qazwsxedcrfvtgb", "!@#$%^&*()")
DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?"
                  r"|(?:0?[1-9]|[12]\d|3[01])[-/.](?:0?[1-9]|1[0-2])[-/.](?:19|20)?\d\d"
                  r"|(?:0[1-9]|[12]\d|3[01])(?:0[1-9]|1[0-2])(?:19|20)\d\d")
NEXT_KEY = {a + b for w in WALKS for s in (w, w[::-1]) for a, b in zip(s, s[1:])}
MIN_WALK, MAX_UNIT = 3, 8
VOCABULARIES = ("byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken")
MIN_PROSE = 4  # letters of a vocabulary's word; shorter ones are pieces as often as words


def char_cost(c: str) -> float:
    """log10 of the alphabet a brute-force guess of this character draws from."""
    size = 10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 33 if c.isascii() else 1000
    return math.log10(size)


class GuessCost:
    def __init__(self, words: list[str] = WORDS):
        self.rank = {}
        for k, w in enumerate(words):
            self.rank.setdefault(w.lower(), k + 1)
        self.longest = max(map(len, self.rank), default=0)

    def spans(self, value: str, i: int):
        """(end, cost, kind) of the patterns that start at position ``i``."""
        low, n = value.lower(), len(value)
        for size in range(3, min(self.longest, n - i) + 1):
            r = self.rank.get(low[i:i + size])
            if r:
                part = value[i:i + size]
                yield i + size, math.log10(r + 1) + (0 if part == part.lower() else math.log10(2 if part.istitle() else 2 ** size)), "word"
        end = i + 1
        while end < n and low[end - 1] + low[end] in NEXT_KEY:
            end += 1
            if end - i >= MIN_WALK:
                yield end, math.log10(47 * 2 * (end - i)), "walk"

    def cost(self, value: str) -> tuple[float, list[tuple[int, int, str]]]:
        """Least log10 guesses of the value, and its segments (start, end, kind)."""
        n = len(value)
        best = [0.0] + [math.inf] * n
        came: list[tuple[int, str]] = [(0, "")] * (n + 1)
        alike = [0] * (MAX_UNIT + 1)  # per unit length, characters up to here that equal those a unit before

        def offer(start: int, end: int, cost: float, kind: str) -> None:
            if best[start] + cost < best[end]:
                best[end], came[end] = best[start] + cost, (start, kind)

        for i in range(n):
            offer(i, i + 1, char_cost(value[i]), "brute")
            for unit in range(1, min(MAX_UNIT, i) + 1):
                alike[unit] = alike[unit] + 1 if value[i] == value[i - unit] else 0
                if alike[unit] >= unit:  # the unit before once more, known but for the number of times
                    times = alike[unit] // unit + 1
                    offer(i + 1 - unit, i + 1, math.log10(times) - math.log10(max(1, times - 1)) + (math.log10(2) if times == 2 else 0), "repeat")
            for end, cost, kind in self.spans(value, i):
                offer(i, end, cost, kind)
            m = DATE.match(value, i)
            if m:
                offer(i, m.end(), math.log10(365 * 60), "date")
        segments, at = [], n
        while at:
            start, kind = came[at]
            if segments and kind == "brute" == segments[-1][2]:
                segments[-1] = (start, segments[-1][1], kind)
            else:
                segments.append((start, at, kind))
            at = start
        return best[n], segments[::-1]


def prose_words() -> list[str]:
    """The fixed words, then those that begin a word in the public vocabularies, most common first."""
    import public_tokenizers

    rank: dict[str, int] = {}
    for name in VOCABULARIES:
        with open(public_tokenizers.path(name), "rb") as f:
            if name.endswith(".json"):
                tokens = [(t.replace("\u0120", " ").encode("utf-8"), k) for t, k in json.load(f)["model"]["vocab"].items()]
            else:
                tokens = [(base64.b64decode(t), int(k)) for t, k in map(bytes.split, f)]
        for token, k in tokens:
            word = token.decode("utf-8", "replace").lower()
            if len(word) > MIN_PROSE and word[0] == " " and word[1:].isalpha():
                rank[word[1:]] = min(k, rank.get(word[1:], k))
    return WORDS + sorted(rank, key=lambda w: (rank[w], w))


@functools.cache
def prose_model() -> GuessCost:
    """One model per worker process for values that may be prose."""
    return GuessCost(prose_words())


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the fixed patterns as (start, rank of the kind, end)."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def value_spans(text: str, model: GuessCost, min_cost: float) -> list[tuple[int, int, int]]:
    if ":" not in text and "=" not in text:
        return []
    out = []
    for m in CONTEXT.finditer(text):
        k = m.lastindex
        start, end = m.span(k)
        judge = model
        if k == 3:
            while end > start and text[end - 1] in ".,;:!?)]}":
                end -= 1
            if not any(c.isdigit() for c in text[start:end]):
                judge = prose_model()
        if end - start >= MIN_ASSIGN and judge.cost(text[start:end])[0] >= min_cost:
            out.append((start, 3, end))
    return out


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """The text with the union of the spans replaced by the mark."""
    out, at, open_until = [], 0, -1
    for s, _, e in sorted(spans):
        if s >= open_until:
            out += [text[at:s], mark]
        at = open_until = max(open_until, e)
    return "".join(out) + text[at:]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_cost: float = MIN_COST) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_value."""
    common.small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()),
                        ("base_sha256", pa.string()), ("spans", pa.string()), ("n_value", pa.int64())])

    def run(batches):
        common.hold("secrets", prose_model)
        model = GuessCost()
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                base = base_spans(text)
                added = value_spans(text, model, min_cost)
                count = [sum(k == i for _, k, _ in base) for i in range(3)]
                rows.append((doc_id, *count, hashlib.sha256(listed(base).encode()).hexdigest(), listed(sorted(base + added)), len(added)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_value long")


def redacted(docs: DataFrame, text_col: str = "text", mark: str = "<SECRET>", min_cost: float = MIN_COST) -> DataFrame:
    """``docs`` with every found span of the text replaced; all other columns stay, null text stays null."""
    common.small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        common.hold("secrets", prose_model)
        model = GuessCost()
        for b in batches:
            texts = []
            for text in b.column(at).to_pylist():
                if text:
                    spans = base_spans(text) + value_spans(text, model, min_cost)
                    text = redact(text, spans, mark) if spans else text
                texts.append(text)
            yield b.set_column(at, b.schema.field(at).name, pa.array(texts, pa.string()))

    return docs.mapInArrow(run, docs.schema)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    return scan(common.table(spark, sf_dir, "documents"))
