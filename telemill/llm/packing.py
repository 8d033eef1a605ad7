"""Packing token sequences into windows: non-negative least squares over length combinations.

Every document is encoded, ended by one id and cut into full windows and a rest. Rests are packed by recipes: all pairs
and many triples of lengths that fill a window exactly. Non-negative least squares fits the repeats of the recipes to the
histogram of lengths, which has as many bins as a window has tokens, whatever the corpus; repeats are rounded down.
What no recipe takes is cut at the powers of two in its length and packed greedily, largest first, which leaves one
window at most with padding. Checksums of both cuts are made while encoding, so no id is stored or read again.

Defined cases: a null or empty text has the end id only; null ids of rows stay null; repeated rows are packed each; an
empty table gives an empty result; a text of any length is cut into as many windows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telemill.llm.runtime import keep, ship
from telemill.llm.tokens import encoder
from telemill.llm.words import blocks

SALTS = 64  # one length may hold most pieces; they are numbered in this many shares
FREQUENT = 64  # lengths whose triples are all tried


def powers_of_two(n: int) -> list[int]:
    """The powers of two that sum to n, largest first."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def cut_documents(docs: DataFrame, tokenizer_path: str, end_id: int, window: int, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens per piece; for a rest also ``parts``, its cut at powers of two."""
    ship(docs.sparkSession)
    part = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    arrow = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                       ("doc_tokens", pa.int64()), ("parts", pa.list_(part))])

    def run(batches):
        for rows, data, offsets in blocks(batches, "text"):
            flat, bounds = encoder(tokenizer_path).encode(data, offsets)
            columns: list[list] = [[] for _ in arrow]
            for doc_id, a, b in zip(rows.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                ids = np.empty(b - a + 1, "<u4")
                ids[:-1], ids[-1] = flat[a:b], end_id
                for start in range(0, len(ids), window):
                    piece = ids[start:start + window]
                    parts, at = [], 0
                    if len(piece) < window:
                        for n in powers_of_two(len(piece)):
                            parts.append({"start": start + at, "length": n, "ids_crc32": zlib.crc32(piece[at:at + n])})
                            at += n
                    for column, value in zip(columns, (doc_id, start, len(piece), zlib.crc32(piece), len(ids), parts)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, arrow)], schema=arrow)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return source.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
                                  "parts array<struct<start:long,length:long,ids_crc32:long>>")


def combinations(histogram: np.ndarray, window: int) -> list[tuple[int, ...]]:
    """Lengths that fill a window: itself, all pairs, and all triples with one of the most frequent lengths."""
    have = histogram > 0
    found = {(window,)} if have[window] else set()
    found |= {(a, window - a) for a in np.flatnonzero(have[:window // 2 + 1]).tolist() if a and have[window - a]}
    frequent = [a for a in np.argsort(-histogram, kind="stable")[:FREQUENT].tolist() if 0 < a < window and have[a]]
    for a in frequent:
        b = np.arange(1, window - a)
        b = b[have[b] & have[window - a - b]]
        found |= {tuple(sorted((a, x, window - a - x))) for x in b.tolist()}
    return sorted(found, key=lambda c: (len(c), c))


def solve_repeats(histogram: np.ndarray, recipes: list[tuple[int, ...]], sweeps: int = 3) -> list[int]:
    """Repeats x >= 0 that minimise |A x - histogram|, by coordinate descent, rounded to what the bins hold."""
    columns = [sorted((length, recipe.count(length)) for length in set(recipe)) for recipe in recipes]
    rest, x = histogram.astype(float).tolist(), [0.0] * len(recipes)
    for _ in range(sweeps):
        for j, column in enumerate(columns):
            step = sum(m * rest[a] for a, m in column) / sum(m * m for _, m in column)
            new = max(0.0, x[j] + step)
            if new != x[j]:
                for a, m in column:
                    rest[a] -= m * (new - x[j])
                x[j] = new
    left, whole = histogram.astype(np.int64).tolist(), []
    for value, column in zip(x, columns):
        n = min([int(value + 1e-9), *(left[a] // m for a, m in column)])
        for a, m in column:
            left[a] -= n * m
        whole.append(n)
    # what rounding left over is taken by the first recipes that still fit
    for j, column in enumerate(columns):
        n = min(left[a] // m for a, m in column)
        if n:
            for a, m in column:
                left[a] -= n * m
            whole[j] += n
    return whole


def _numbered(pieces: DataFrame, order: list) -> tuple[DataFrame, DataFrame]:
    """Adds ``rank``, from 0 among the pieces of a length; and the counts per length.

    Pieces are numbered in shares; only counts per length and share, a bounded number, are summed up across shares.
    """
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(SALTS)))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")
    shares = counts.select("length", "salt", before.alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy(*order)) - 1
    ranked = (salted.withColumn("own", own)
              .join(F.broadcast(shares), ["length", "salt"])  # SALTS rows per length at most
              .withColumn("rank", F.col("before") + F.col("own")).drop("salt", "own", "before"))
    return ranked, counts.groupBy("length").agg(F.sum("n").alias("n"))


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, window: int = 2048, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = keep(cut_documents(docs, tokenizer_path, end_id, window, id_col, text_col), "pieces")
    order = ["doc_id", "start", "ids_crc32", "doc_tokens"]
    ranked, counts = _numbered(pieces, order)
    histogram = np.zeros(window + 1, np.int64)
    for length, n in counts.collect():  # a row per length
        histogram[length] = n
    recipes = combinations(histogram, window)
    plan, used, sequence = [(0, 0, 0, 0, 0)], np.zeros(window + 1, np.int64), 0
    for recipe, n in zip(recipes, solve_repeats(histogram, recipes)):
        if n:
            at = 0
            for length in sorted(recipe, reverse=True):
                plan.append((length, int(used[length]), int(used[length]) + n, sequence, at))
                used[length] += n
                at += length
            sequence += n
    plan = spark.createDataFrame(plan, "slot long, low long, high long, base long, at long")
    placed = ranked.join(F.broadcast(plan),  # a few rows per length
                         (F.col("length") == F.col("slot")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")),
                         "left")
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    by_recipe = placed.filter(F.col("slot").isNotNull()).select(
        *out, (F.col("base") + F.col("rank") - F.col("low")).alias("sequence_id"), F.col("at").alias("offset"))
    # a full window always has its recipe, so what remains are rests with parts
    parts = keep(placed.filter(F.col("slot").isNull()).select("doc_id", "doc_tokens", F.explode("parts").alias("part"))
                 .select("doc_id", "part.*", "doc_tokens"), "parts")
    ranked, counts = _numbered(parts, order)
    sizes, at = [(0, 0)], 0
    for length, n in sorted(counts.collect(), reverse=True):  # a row per power of two
        sizes.append((length, at))
        at += length * n
    place = F.col("at") + F.col("rank") * F.col("length")
    greedy = ranked.join(F.broadcast(spark.createDataFrame(sizes, "length long, at long")), "length").select(
        *out, (F.lit(sequence) + F.floor(place / window)).cast("long").alias("sequence_id"),
        F.pmod(place, F.lit(window)).cast("long").alias("offset"))
    return by_recipe.unionByName(greedy)
