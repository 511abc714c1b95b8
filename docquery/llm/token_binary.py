"""Token-id files with directly addressable codes (DAC).

An id is split into chunks of ``bits`` bits, lowest first.  Level 0 holds the lowest chunk of every id,
level 1 the next chunk of those ids that have one, and so on.  Each level has a continuation bitmap (one
bit per entry: the id goes on in the next level) and a rank directory (set bits before each block of 512
entries), so the entry of an id in the next level is found by one rank query, and any token is read
without decoding a block.

Layout of a file: magic, length of the header, JSON header (counts, and offset, length and type of each
section), then the sections: document ids, document offsets, and data, bitmap and ranks of each level.

Writing: the documents are range-partitioned by id (only the partitioner's sample sees ids ahead), each
task encodes and writes its part in order, rolling to a new file after ``roll_tokens``.  The manifest of
finished files is written as a table, and only files listed there count: a task that runs again after the
loss of an executor writes new files, and the unfinished ones are never read.

Cases: null text is the empty text (only the end id).  Rows that share an id are kept, ordered by text.
A null id sorts first.  An empty table gives no file and an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import functools
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .pieces import BatchPieces

MAGIC = b"DACT0001"
BLOCK = 512               # entries per rank block
CHUNK_BITS = 8            # bits per chunk; 8 or 16
ROLL_TOKENS = 8_000_000   # ids per file
JOINED = 100              # new parts that are encoded as one text
TEXT_CHARS = 2_000_000    # texts are encoded together up to this length; a longer one is encoded alone
END_ID = 2                # id appended to each document by the registered query
TOKENIZER = "byte_bpe_50k.json"

MANIFEST = ("part int, seq int, path string, n_docs long, n_tokens long")
DOCUMENT = ("doc_id long, start long, n_tokens long, ids_crc32 long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def load_tokenizer(path: str):
    """The tokenizer with the library's own settings: added tokens (``<|endoftext|>``) in a text give their ids."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def worker_pieces(path: str) -> BatchPieces:
    """One memo of parts per tokenizer and worker process, kept over its tasks; values are id bytes."""
    tk = load_tokenizer(path)
    sizes = np.zeros(1 + max(tk.get_vocab().values()), np.int64)  # bytes of each token: a sign of a byte-level vocabulary is a byte
    for token, k in tk.get_vocab().items():
        sizes[k] = len(token)

    def encode(s: str) -> bytes:
        return np.array(tk.encode(s, add_special_tokens=False).ids, "<u4").tobytes()

    def encode_many(parts: list[str]) -> list[bytes]:
        out = []
        for k in range(0, len(parts), JOINED):
            some = parts[k:k + JOINED]
            ids = np.array(tk.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, "<u4")
            token_ends, part_ends = np.cumsum(sizes[ids]), np.cumsum([len(s.encode()) for s in some])
            last = np.searchsorted(token_ends, part_ends)  # of each part, its last token
            if last[-1] + 1 == len(ids) and (token_ends[last] == part_ends).all():
                blob, bounds = ids.tobytes(), [0, *(4 * (last + 1)).tolist()]
                out += [blob[i:j] for i, j in zip(bounds, bounds[1:])]
            else:  # tokens do not give back these bytes
                out += [encode(s) for s in some]
        return out

    return BatchPieces(encode, encode_many)


def together(rows: Iterator[tuple], chars: int = TEXT_CHARS) -> Iterator[list[tuple]]:
    """Runs of (id, text) of bounded length."""
    some, size = [], 0
    for row in rows:
        if some and size + len(row[1]) > chars:
            yield some
            some, size = [], 0
        some.append(row)
        size += len(row[1])
    if some:
        yield some


# ---------------------------------------------------------------- codec
def encode_levels(ids: np.ndarray, bits: int = CHUNK_BITS) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(data, bitmap, ranks) of each level."""
    dtype, mask = (np.uint8, 0xFF) if bits == 8 else (np.uint16, 0xFFFF)
    rest, levels = ids.astype(np.uint32), []
    while True:
        more = rest >> np.uint32(bits)
        goes_on = more > 0
        ones = np.add.reduceat(goes_on, np.arange(0, len(rest), BLOCK), dtype=np.int64) if len(rest) else np.zeros(0, np.int64)
        ranks = np.concatenate([[0], np.cumsum(ones)]).astype("<u4")
        levels.append(((rest & np.uint32(mask)).astype(dtype), np.packbits(goes_on, bitorder="little"), ranks))
        if not goes_on.any():
            return levels
        rest = more[goes_on]


def decode_levels(levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], bits: int = CHUNK_BITS) -> np.ndarray:
    out = np.zeros(0, np.uint32)
    for data, bitmap, _ in reversed(levels):
        cur = data.astype(np.uint32)
        if len(out):
            on = np.unpackbits(bitmap, count=len(data), bitorder="little").astype(bool)
            cur[on] |= out << np.uint32(bits)
        out = cur
    return out.astype("<u4")


def pack(docs: list[tuple[int | None, np.ndarray]], bits: int = CHUNK_BITS) -> bytes:
    """One file from (document id, token ids) in order."""
    ids = np.concatenate([x for _, x in docs]) if docs else np.zeros(0, "<u4")
    offsets = np.concatenate([[0], np.cumsum([len(x) for _, x in docs])]).astype("<i8")
    null = np.array([d is None for d, _ in docs], dtype=np.uint8)
    sections = [("doc_ids", np.array([d or 0 for d, _ in docs], dtype="<i8")), ("doc_null", null), ("offsets", offsets)]
    for k, (data, bitmap, ranks) in enumerate(encode_levels(ids, bits)):
        sections += [(f"data{k}", data), (f"more{k}", bitmap), (f"rank{k}", ranks)]
    at, listed, blobs = 0, {}, []
    for name, arr in sections:
        blob = arr.tobytes()
        listed[name] = [at, len(arr), arr.dtype.str]
        blobs.append(blob)
        at += len(blob)
    head = json.dumps({"bits": bits, "n_docs": len(docs), "n_tokens": len(ids), "sections": listed}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *blobs])


class TokenFile:
    """A file's bytes; ``token(i)`` reads one id by rank queries alone, ``document(k)`` one document."""

    def __init__(self, blob: bytes):
        if blob[:8] != MAGIC:
            raise ValueError("not a token file")
        n = struct.unpack_from("<I", blob, 8)[0]
        self.head = json.loads(blob[12:12 + n])
        base = 12 + n
        self.section = {k: np.frombuffer(blob, dtype=t, count=c, offset=base + at) if c else np.zeros(0, t)
                        for k, (at, c, t) in self.head["sections"].items()}
        self.bits = self.head["bits"]
        self.depth = sum(k.startswith("data") for k in self.section)

    def token(self, i: int) -> int:
        value = 0
        for k in range(self.depth):
            value |= int(self.section[f"data{k}"][i]) << (self.bits * k)
            bitmap = self.section[f"more{k}"]
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK
            first = block * BLOCK // 8
            before = int.from_bytes(bitmap[first:(i >> 3) + 1].tobytes(), "little") & ((1 << (i - block * BLOCK)) - 1)
            i = int(self.section[f"rank{k}"][block]) + before.bit_count()
        return value

    def document(self, k: int) -> list[int]:
        lo, hi = self.section["offsets"][k:k + 2]
        return [self.token(i) for i in range(int(lo), int(hi))]

    def all_ids(self) -> np.ndarray:
        return decode_levels([tuple(self.section[f"{s}{k}"] for s in ("data", "more", "rank"))
                              for k in range(self.depth)], self.bits)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(document id, start within the file, ids) of every document."""
        ids, off = self.all_ids(), self.section["offsets"]
        for k, (d, null) in enumerate(zip(self.section["doc_ids"].tolist(), self.section["doc_null"].tolist())):
            yield None if null else d, int(off[k]), ids[off[k]:off[k + 1]]


# ---------------------------------------------------------------- Spark
def write_tokens(docs: DataFrame, out: str, tokenizer: str, end_id: int | None = END_ID, id_col: str = "doc_id",
                 text_col: str = "text", bits: int = CHUNK_BITS, roll_tokens: int = ROLL_TOKENS) -> DataFrame:
    """Write ``docs`` as token files below ``out`` in ascending id order; return the stored manifest."""
    spark = docs.sparkSession
    common.small_batches(spark)
    ordered = (docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_or_empty(text_col).alias("text"))
               .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text"))
    tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def write(batches):
        parts = worker_pieces(tokenizer)
        part, seq, held, n, rows = common.partition_id(), 0, [], 0, []

        def flush():
            uri = f"{out}/part-{part:06d}-{seq:05d}-{uuid.uuid4().hex}.dact"
            common.write_file(uri, pack(held, bits))
            return (part, seq, uri, len(held), n)

        for some in together(common.arrow_rows(batches, "doc_id", "text")):
            for (doc_id, _), blob in zip(some, parts.many([text for _, text in some])):
                ids = np.frombuffer(blob + tail, "<u4")
                held.append((doc_id, ids))
                n += len(ids)
                if n >= roll_tokens:
                    rows.append(flush())
                    seq, held, n = seq + 1, [], 0
        if held:
            rows.append(flush())
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(("part", "seq", "path", "n_docs", "n_tokens"), r)) for r in rows],
                                             schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()),
                                                               ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    return common.staged(ordered.mapInArrow(write, MANIFEST), "token-manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """One row per document from the files of a manifest: id, global start, ids counted, crc32."""
    common.small_batches(manifest.sparkSession)
    # one row per file: the running sum over files gives each file its global start
    order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("path", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("base"))
    # as many partitions as files: without a number, adaptive execution puts the few bytes of the manifest into one task
    files = files.repartition(max(1, manifest.count()), "path")

    def read(batches):
        for uri, base in common.arrow_rows(batches, "path", "base"):
            found = [(d, base + at, len(ids), zlib.crc32(ids.tobytes())) for d, at, ids in
                     TokenFile(common.read_file(uri)).documents()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)],
                                             names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(read, DOCUMENT)


def op9_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of ``documents``, read back: doc_id, start, n_tokens, ids_crc32."""
    out = common.new_path(spark, "tokens")
    return read_tokens(write_tokens(common.table(spark, sf_dir, "documents"), out, default_tokenizer()))
