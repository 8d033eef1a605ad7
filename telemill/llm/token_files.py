"""Token ids as files: concatenated id arrays with Elias-Fano coded document boundaries.

A file set is a Parquet table of blocks, written by Spark into any store. A block holds whole documents in ascending
order of their id, about ``BLOCK_IDS`` ids of them: the ids as little-endian unsigned integers of the narrowest fitting
width, and the document ends in the Elias-Fano code, n * (2 + log2(u / n)) bits instead of 64 n. Its select structure
(every ``SAMPLE``-th one of the unary part) gives any document's place without decoding the others.

Defined cases: a null or empty text has the end id only; rows with null ids come first and keep them; rows of equal id
are ordered by their text's hash and text; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.llm.runtime import partitions, ship
from telemill.llm.tokens import encoder
from telemill.llm.words import LARGE_BLOCK, blocks

BLOCK_IDS = 1 << 16
SAMPLE = 32
SCHEMA = "shard int, first long, n_ids long, width int, doc_ids array<long>, ids binary, bounds binary"
_HEAD = struct.Struct("<QQBI")


class EliasFano:
    """An ascending sequence of integers below or at ``universe``, with random access."""

    def __init__(self, n: int, universe: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray, low_bits: int):
        self.n, self.universe, self.low, self.high = n, universe, low, high
        self.samples, self.low_bits = samples, low_bits

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        bits = max(0, (universe // n).bit_length() - 1) if n else 0
        low = ((values[:, None] >> np.arange(bits)) & 1).astype(np.uint8).ravel()
        at = (values >> bits) + np.arange(n)
        high = np.zeros(n + (universe >> bits) + 1, np.uint8)
        high[at] = 1
        return cls(n, universe, np.packbits(low, bitorder="little"), np.packbits(high, bitorder="little"),
                   at[::SAMPLE].astype(np.uint32), bits)

    def to_bytes(self) -> bytes:
        return (_HEAD.pack(self.n, self.universe, self.low_bits, len(self.low))
                + self.low.tobytes() + self.samples.tobytes() + self.high.tobytes())

    @classmethod
    def from_bytes(cls, raw: bytes) -> EliasFano:
        n, universe, bits, low = _HEAD.unpack_from(raw)
        at, samples = _HEAD.size, -(-n // SAMPLE)
        return cls(n, universe, np.frombuffer(raw, np.uint8, low, at),
                   np.frombuffer(raw, np.uint8, -1, at + low + 4 * samples),
                   np.frombuffer(raw, np.uint32, samples, at + low), bits)

    def select(self, k: int) -> int:
        """The k-th value, from 0."""
        start = int(self.samples[k // SAMPLE])
        first, ones = start // 8, k % SAMPLE + 1
        span = 64
        while True:  # a few bytes on from the sampled one
            bits = np.unpackbits(self.high[first:first + span], bitorder="little")
            bits[:start % 8] = 0
            at = np.flatnonzero(bits)
            if len(at) >= ones:
                break
            span *= 4
        value = (first * 8 + int(at[ones - 1]) - k) << self.low_bits
        if self.low_bits:
            a = k * self.low_bits
            got = np.unpackbits(self.low[a // 8:(a + self.low_bits + 7) // 8], bitorder="little")[a % 8:][:self.low_bits]
            value |= int((got.astype(np.int64) << np.arange(self.low_bits)).sum())
        return value

    def values(self) -> np.ndarray:
        """All of them at once."""
        at = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[:self.n]
        low = np.unpackbits(self.low, bitorder="little")[:self.n * self.low_bits].reshape(self.n, self.low_bits)
        return ((at - np.arange(self.n)) << self.low_bits) | (low.astype(np.int64) << np.arange(self.low_bits)).sum(1)


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id",
                      text_col: str = "text") -> None:
    """Encode every text, append ``end_id`` and write blocks in ascending order of the id column.

    The texts are shuffled once, by range of the id; a lost task encodes its range again.
    """
    spark = docs.sparkSession
    ship(spark)

    def run(batches):
        shard, first = TaskContext.get().partitionId(), 0
        own = encoder(tokenizer_path)
        kind = own.kind if end_id <= np.iinfo(own.kind).max else np.uint32
        for rows, data, offsets in blocks(batches, "text", LARGE_BLOCK):
            flat, bounds = own.encode(data, offsets)
            ends = bounds[1:] + np.arange(1, len(bounds))
            all_ids = np.full(int(ends[-1]), end_id, kind)
            keep = np.ones(len(all_ids), bool)
            keep[ends - 1] = False
            all_ids[keep] = flat
            ids = rows.column(0).to_pylist()
            done = 0
            while done < len(ids):
                base = int(ends[done - 1]) if done else 0
                last = max(done + 1, int(np.searchsorted(ends, base + BLOCK_IDS, "right")))
                size = int(ends[last - 1]) - base
                yield pa.RecordBatch.from_pylist([{
                    "shard": shard, "first": first, "n_ids": size, "width": all_ids.itemsize, "doc_ids": ids[done:last],
                    "ids": all_ids[base:base + size].tobytes(),
                    "bounds": EliasFano.build(ends[done:last] - base, size).to_bytes()}], schema=arrow)
                first, done = first + size, last

    arrow = pa.schema([("shard", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("width", pa.int32()),
                       ("doc_ids", pa.list_(pa.int64())), ("ids", pa.binary()), ("bounds", pa.binary())])
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    (source.repartitionByRange(partitions(spark), F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
     .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
     .mapInArrow(run, SCHEMA).write.mode("overwrite").parquet(path))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start (ids before it), n_tokens, ids_crc32, from the files alone.

    Only one number per file shard comes to the driver: the ids in it.
    """
    ship(spark)
    stored = spark.read.schema(SCHEMA).parquet(path)
    total, bases = 0, []
    for shard, n in sorted(stored.groupBy("shard").agg(F.sum("n_ids")).collect()):
        bases.append((shard, total))
        total += n
    bases = spark.createDataFrame(bases, "shard int, base long")

    def run(batches):
        for batch in batches:
            for first, width, base, ids, raw, at in zip(*(batch.column(c).to_pylist() for c in (
                    "first", "width", "base", "doc_ids", "ids", "bounds"))):
                flat = np.frombuffer(raw, f"<u{width}").astype("<u4")
                ends = EliasFano.from_bytes(at).values()
                starts = np.concatenate([[0], ends[:-1]])
                crc = [zlib.crc32(flat[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(starts + first + base), pa.array(ends - starts),
                     pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # a row per shard, as many as there are tasks
    return stored.join(F.broadcast(bases), "shard").select("first", "width", "base", "doc_ids", "ids", "bounds") \
        .mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def document_ids(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of every stored document with this id, found by select in its blocks."""
    out = []
    rows = spark.read.schema(SCHEMA).parquet(path).filter(F.array_contains("doc_ids", F.lit(doc_id).cast("long")))
    for row in rows.toLocalIterator():
        bounds = EliasFano.from_bytes(bytes(row.bounds))
        for k in [k for k, d in enumerate(row.doc_ids) if d == doc_id]:
            a, b = bounds.select(k - 1) if k else 0, bounds.select(k)
            out.append(np.frombuffer(row.ids, f"<u{row.width}")[a:b].tolist())
    return out
