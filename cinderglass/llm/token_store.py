"""Token ids in files of directly addressable codes.

An id is cut into chunks of 8 bits.  Level 0 has the lowest chunk of every id, level
k+1 the next chunk of those ids that go on, and a bitmap per level says which do.  A
rank directory counts the bitmap's ones before every 512th bit, so token i is read
with one rank query a level, without decoding its block.

A store is a folder of Parquet files, which any storage of Spark's holds: each row is
a block with whole texts, in order of shard and block: ``shard, block, doc_ids,
lengths, codes``.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinderglass.llm import words as W
from cinderglass.llm.bpe import default_path, worker_codec
from cinderglass.llm.shared import parts, stash, table

END_ID = 2
#: Ids from which a block is closed (a random read fetches one block); characters that a shard should hold.
BLOCK_IDS = 100_000
SHARD_CHARS = 24_000_000

#: Pieces that an encoder remembers.
MEMO = 800_000

_RANK_BITS = 512
_HEAD = struct.Struct("<4sBQ")
_MAGIC = b"DAC1"
_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)


def pack(ids: np.ndarray) -> bytes:
    """Code unsigned 32-bit ids."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        low, rest = (rest & 0xFF).astype(np.uint8), rest >> 8
        more = rest > 0
        bits = np.packbits(more, bitorder="little")
        bits = np.append(bits, np.zeros(-len(bits) % (_RANK_BITS // 8), np.uint8))
        ones = _ONES[bits].reshape(-1, _RANK_BITS // 8).sum(axis=1, dtype=np.uint32)
        ranks = np.append(np.uint32(0), np.cumsum(ones, dtype=np.uint32))[:-1] if len(ones) else np.zeros(0, np.uint32)
        levels.append((len(low), low.tobytes(), bits.tobytes(), ranks.astype("<u4").tobytes()))
        if not more.any():
            break
        rest = rest[more]
    return _HEAD.pack(_MAGIC, len(levels), len(ids)) + b"".join(struct.pack("<Q", n) + low + bits + ranks for n, low, bits, ranks in levels)


class Codes:
    """Random access to packed ids."""

    def __init__(self, data: bytes):
        magic, count, self.size = _HEAD.unpack_from(data)
        if magic != _MAGIC:
            raise ValueError("not a block of token codes")
        at, self.levels = _HEAD.size, []
        for _ in range(count):
            (n,) = struct.unpack_from("<Q", data, at)
            blocks = -(-n // _RANK_BITS)
            low = np.frombuffer(data, np.uint8, n, at + 8)
            bits = np.frombuffer(data, np.uint8, blocks * _RANK_BITS // 8, at + 8 + n)
            ranks = np.frombuffer(data, "<u4", blocks, at + 8 + n + len(bits))
            at += 8 + n + len(bits) + 4 * blocks
            self.levels.append((low, bits, ranks))

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.size:
            raise IndexError(i)
        value = 0
        for k, (low, bits, ranks) in enumerate(self.levels):
            value |= int(low[i]) << (8 * k)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            base = i // _RANK_BITS * (_RANK_BITS // 8)
            i = int(ranks[i // _RANK_BITS]) + int(_ONES[bits[base : i >> 3]].sum()) + bin(int(bits[i >> 3]) & ((1 << (i & 7)) - 1)).count("1")
        return value

    def all(self) -> np.ndarray:
        out = np.zeros(self.size, np.uint32)
        at = np.arange(self.size)
        for k, (low, bits, _) in enumerate(self.levels):
            out[at] |= low.astype(np.uint32) << np.uint32(8 * k)
            at = at[np.unpackbits(bits, count=len(low), bitorder="little").view(bool)]
        return out


_BLOCK = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("codes", pa.binary())])


def _write(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        codec, shard, block = worker_codec(path, MEMO), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        docs, lengths, held, size = [], [], [], 0

        def close() -> pa.RecordBatch:
            codes = pack(np.frombuffer(b"".join(held), "<u4"))
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([size], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([codes], pa.binary())], schema=_BLOCK)

        for batch in batches:
            for piece in W.chunks(batch, "text"):
                for doc, raw in zip(piece.column("doc_id").to_pylist(), codec.encode(piece.column("text").to_pylist()), strict=True):
                    docs.append(doc)
                    lengths.append(len(raw) // 4 + 1)
                    held += [raw, end]
                    size += lengths[-1]
                    if size >= BLOCK_IDS:
                        yield close()
                        block += 1
                        docs, lengths, held, size = [], [], [], 0
        if docs:
            yield close()

    return run


def write_tokens(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encode ``docs(doc_id, text)`` in ascending doc_id order into a store; return its blocks.

    A null doc_id comes first; rows of one doc_id are ordered by text, and those that
    begin differently can go to several tasks.  Null and empty texts hold the end id alone.  Other columns are ignored.  An empty table gives an
    empty store.
    """
    spark = docs.sparkSession
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    volume = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    ordered = rows.repartitionByRange(parts(spark, volume, SHARD_CHARS), F.col("doc_id"), F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    return stash(ordered.mapInArrow(_write(path or default_path(), end_id), "shard int, block int, n_ids long, doc_ids array<long>, lengths array<long>, codes binary"), "tokens")


def read_tokens(blocks: DataFrame, digests: bool = False) -> DataFrame:
    """Per text of a store: ``doc_id, start, n_tokens`` and its ``ids`` (or ``ids_crc32``)."""
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.coalesce(F.sum("n_ids").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select("shard", "block", within.alias("within")).join(shards.select("shard", before.alias("before")), "shard").select("shard", "block", (F.col("within") + F.col("before")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_ids, lengths, codes, start in zip(*(batch.column(c).to_pylist() for c in ("doc_ids", "lengths", "codes", "start")), strict=True):
                ids = Codes(codes).all().astype("<u4")
                ends = np.cumsum(lengths)
                begins = ends - lengths
                own = [ids[a:b] for a, b in zip(begins, ends, strict=True)]
                last = pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64()) if digests else pa.array([x.astype(np.int64) for x in own], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(begins + start, pa.int64()), pa.array(lengths, pa.int64()), last], names=["doc_id", "start", "n_tokens", "ids_crc32" if digests else "ids"])

    last = "ids_crc32 long" if digests else "ids array<long>"
    return blocks.join(starts, ["shard", "block"]).select("doc_ids", "lengths", "codes", "start").mapInArrow(run, f"doc_id long, start long, n_tokens long, {last}")


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: encode, store, read back; start, count and checksum per document."""
    return read_tokens(write_tokens(table(spark, sf_dir, "documents")), digests=True)
