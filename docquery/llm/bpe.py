"""Byte-level BPE as a lazily determinised transducer, and streaming decode by a UTF-8 state machine.

Encoding.  Any stretch of tokens of a BPE encoding is the encoding of its own bytes.  So the encoding of
each prefix of a piece is the encoding of a shorter prefix plus one last token, and a machine that reads
bytes only needs, for the positions at which a later token may still start, the last token before them.  Positions at which no token of the
vocabulary can be under way are dead; what all live positions have in common is emitted.  The lookahead is
therefore below the length of the longest token.

What follows a token boundary is encoded as if it stood alone, so a state is named by the bytes after the
last emitted token.  States and transitions are made when a text first needs them and kept in a bounded
table.  A piece that is a token as a whole is emitted at once,
as the public library does.

Decoding.  A machine whose state is the bytes of an unfinished character maps (state, token) to (text,
state); transitions are again made on demand.

Cases: null is the empty text (no ids, hash of nothing).  Texts of any length are encoded whole; special
strings are ordinary text.  Extra columns are ignored; repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from array import array
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .pieces import Pieces

RANKS = "byte_bpe_multi_50k.tiktoken"
MAX_STATES = 250_000   # states kept per worker; the table is emptied when full
MAX_DECODE = 200_000   # decode transitions kept per worker
MEMO_PARTS = 300_000   # parts of texts whose ids are kept per worker, as bytes


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(tok): int(rank) for tok, rank in map(bytes.split, f)}


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Plain BPE of a short piece: join the neighbours of lowest rank, leftmost first."""
    parts = [piece[i:i + 1] for i in range(len(piece))]
    none = len(ranks)
    joint = [ranks.get(piece[i:i + 2], none) for i in range(len(piece) - 1)]  # rank of each pair of neighbours
    while joint and (best := min(joint)) < none:
        i = joint.index(best)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
        del joint[i]
        if i:
            joint[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        if i < len(joint):
            joint[i] = ranks.get(parts[i] + parts[i + 1], none)
    return [ranks[p] for p in parts]


class Transducer:
    """Encoder of pre-tokens; ``encode(piece)`` gives the ids."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks, self.max_states = ranks, max_states
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.under_way = {t[:n] for t in ranks for n in range(1, len(t))}  # proper beginnings of tokens
        self.longest = max(map(len, ranks))
        self.reset()

    def reset(self) -> None:
        self.name: list[bytes] = []                   # state -> bytes after the last emitted token
        self.last: list[tuple[int, ...]] = []         # state -> last token of each prefix of those bytes
        self.index: dict[bytes, int] = {}
        self.step: list[dict[int, tuple[int, tuple[int, ...]]]] = []
        self.rest: list[tuple[int, ...] | None] = []  # state -> ids to emit when the piece ends here, once needed
        self.start = self.state(b"", ())

    def state(self, tail: bytes, last: tuple[int, ...]) -> int:
        s = self.index.get(tail)
        if s is None:
            s = self.index[tail] = len(self.name)
            self.name.append(tail)
            self.last.append(last)
            self.step.append({})
            self.rest.append(None)
        return s

    def path(self, last: tuple[int, ...], at: int) -> tuple[int, ...]:
        """Tokens from the start of the tail to position ``at``."""
        out = []
        while at:
            out.append(last[at - 1])
            at -= len(self.bytes_of[out[-1]])
        return tuple(reversed(out))

    def transition(self, s: int, byte: int) -> tuple[int, tuple[int, ...]]:
        last, tail = self.last[s], self.name[s] + bytes([byte])
        n = len(tail)
        last = (*last, merge_bytes(tail, self.ranks)[-1])
        # positions at which a later token may start: the end, and those before bytes that begin a token
        live = [n] + [i for i in range(max(0, n - self.longest + 1), n) if tail[i:] in self.under_way]
        if 0 in live:
            done: tuple[int, ...] = ()
        else:  # what the paths to all live positions begin with
            paths = sorted(self.path(last, i) for i in live)
            low, high = paths[0], paths[-1]
            same = next((k for k, (a, b) in enumerate(zip(low, high)) if a != b), min(len(low), len(high)))
            done = low[:same]
        if done:
            cut = sum(len(self.bytes_of[t]) for t in done)
            tail, last = tail[cut:], last[cut:]
        to = (self.state(tail, last), done)
        self.step[s][byte] = to
        return to

    def encode(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        if len(self.name) > self.max_states:
            self.reset()
        s, out, step = self.start, [], self.step
        for byte in piece:
            to = step[s].get(byte)
            s, done = to if to is not None else self.transition(s, byte)
            if done:
                out += done
        rest = self.rest[s]
        if rest is None:
            rest = self.rest[s] = self.path(self.last[s], len(self.last[s]))
        return (*out, *rest)


def utf8_step(pending: bytes, more: bytes) -> tuple[str, bytes]:
    """Text completed by ``more`` after the unfinished character ``pending``, and what is unfinished now.

    Bytes that cannot be part of a character become U+FFFD, as in a replacing decoder.
    """
    data = pending + more
    cut = len(data)
    for back in range(1, min(3, len(data)) + 1):  # an unfinished character is at most three bytes
        b = data[-back]
        if b >= 0xC0:
            need = 2 if b < 0xE0 else 3 if b < 0xF0 else 4
            try:
                (data[len(data) - back:] + b"\x80" * (need - back)).decode("utf-8")
                possible = True
            except UnicodeDecodeError:  # overlong or surrogate lead: other continuations may still fit
                possible = b in (0xE0, 0xED, 0xF0, 0xF4) and back < need and data[-back:].decode("utf-8", "replace") == "�"
            if back < need and possible:
                cut = len(data) - back
            break
        if b < 0x80:
            break
    return data[:cut].decode("utf-8", "replace"), data[cut:]


class StreamDecoder:
    """Decodes ids one after the other; ``feed`` returns the characters completed so far."""

    def __init__(self, bytes_of: dict[int, bytes], limit: int = MAX_DECODE):
        self.bytes_of, self.limit, self.memo, self.pending = bytes_of, limit, {}, b""

    def feed(self, ids) -> str:
        out, memo, at = [], self.memo, self.pending
        for i in ids:
            to = memo.get((at, i)) if at else memo.get(i)
            if to is None:
                if len(memo) >= self.limit:
                    memo.clear()
                to = memo[(at, i) if at else i] = utf8_step(at, self.bytes_of[i])
            out.append(to[0])
            at = to[1]
        self.pending = at
        return "".join(out)

    def close(self) -> str:
        rest, self.pending = self.pending, b""
        return rest.decode("utf-8", "replace")


class Codec:
    def __init__(self, ranks_path: str, pattern: str):
        import regex

        self.machine = Transducer(read_ranks(ranks_path))
        split, encode = regex.compile(pattern).findall, self.machine.encode
        self.pieces = Pieces(lambda s: array("I", chain.from_iterable(encode(p.encode()) for p in split(s))).tobytes(), MEMO_PARTS)
        self.decoder = StreamDecoder(self.machine.bytes_of)
        self.digits = {r: str(r) for r in self.machine.bytes_of}

    def encode(self, text: str) -> list[int]:
        return array("I", b"".join(self.pieces.values(text))).tolist()

    def decode(self, ids: list[int]) -> str:
        return self.decoder.feed(ids) + self.decoder.close()


@functools.cache
def worker_codec(ranks_path: str, pattern: str) -> Codec:
    """One codec per worker process, kept over its tasks."""
    return Codec(ranks_path, pattern)


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path(RANKS)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                     with_ids: bool = False) -> DataFrame:
    """Encode and decode each text; digests of both, and with ``with_ids`` the ids themselves."""
    common.small_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean"
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
              ("decoded_sha256", pa.string()), ("round_trip", pa.bool_())]
    if with_ids:
        schema += ", ids array<int>"
        fields.append(("ids", pa.list_(pa.int32())))

    def run(batches):
        common.hold("bpe", worker_codec)
        codec = worker_codec(ranks_path, pattern)
        digits = codec.digits.__getitem__
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids = codec.encode(text)
                back = codec.decode(ids)
                row = (doc_id, len(ids), hashlib.sha256(",".join(map(digits, ids)).encode()).hexdigest(),
                       hashlib.sha256(back.encode()).hexdigest(), back == text)
                rows.append(row + ((ids,) if with_ids else ()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)],
                                                 schema=pa.schema(fields))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, schema)


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every document, as digests."""
    return encode_documents(common.table(spark, sf_dir, "documents"), default_ranks(), default_pattern())
