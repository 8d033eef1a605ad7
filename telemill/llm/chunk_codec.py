"""Byte-pair encoding and decoding with content-defined chunks.

A rolling hash over ``WINDOW`` bytes cuts every text at places that its content alone decides, so documents that share a
passage share its chunks. A chunk is encoded once per worker and then reused. A word that a chunk boundary cuts is
repaired: the window from the word before to the word behind is encoded again and accepted when it agrees exactly with
the ids of both neighbours; else it is widened word by word, to the whole text at last.

Defined cases: a null or empty text has no ids and decodes to ''; null ids of rows stay null; repeated rows are encoded
each (from the same chunks); an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.llm.runtime import held, ship
from telemill.llm.tokens import Encoder
from telemill.llm.words import LARGE_BLOCK, Hasher, Memo, blocks, pick, sums, words

WINDOW = 16


class ChunkCodec:
    def __init__(self, encoder: Encoder, mean_bytes: int = 2048, limit: int = 20_000):
        if not encoder.by_word:
            raise ValueError("joins are repaired between words; this tokenizer keeps white space")
        self.encoder, self.limit = encoder, limit
        self.mask = np.uint64((1 << max(1, mean_bytes.bit_length() - 1)) - 1)
        self.memo = Memo(encoder.kind, limit)
        tokens = [encoder.tokenizer.id_to_token(i) or "" for i in range(encoder.size)]
        self.tokens = tokens if encoder.tokenizer.decoder is None else None

    def chunks(self, data: np.ndarray, offsets: np.ndarray, hasher: Hasher) -> np.ndarray:
        """Ascending chunk starts; texts begin new chunks."""
        mark = np.zeros(len(data) + 1, bool)
        value = hasher.windows(WINDOW)
        mark[np.flatnonzero((value & self.mask) == 0) + WINDOW] = True
        mark[offsets] = True
        return np.flatnonzero(mark[:-1])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the bounds of each text in them."""
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(0, self.encoder.kind), np.zeros(n + 1, np.int64)
        hasher = Hasher(data)
        starts = self.chunks(data, offsets, hasher)
        ends = np.append(starts[1:], len(data))
        keys, first, back = np.unique(hasher.ranges(starts, ends), return_index=True, return_inverse=True)
        at, size = self.memo.find(keys)
        if (at < 0).any():
            if self.memo.full(int((at < 0).sum())):
                self.memo.clear()
                at[:] = -1
            new = np.flatnonzero(at < 0)
            f = first[new]
            lengths = ends[f] - starts[f]
            flat, bounds = self.encoder.encode(pick(data, starts[f], lengths), np.concatenate([[0], np.cumsum(lengths)]))
            self.memo.add(keys[new], flat, np.diff(bounds))
            at, size = self.memo.find(keys)
        at, size = at[back], size[back].astype(np.int64)
        # words that a chunk's end cuts, and their parts in the chunks
        w_start, w_end = words(data, offsets)
        inner = starts[~np.isin(starts, offsets)]
        k = np.searchsorted(w_start, inner, "right") - 1
        cut = (k >= 0) & (w_start[np.maximum(k, 0)] < inner) & (w_end[np.maximum(k, 0)] > inner)
        broken = np.unique(k[cut])
        parts = np.unique(np.concatenate([w_start[broken], inner[cut]]))
        part_end = np.minimum(np.append(parts[1:], len(data)), w_end[np.searchsorted(w_start, parts, "right") - 1])
        _, bounds = self.encoder.encode(pick(data, parts, part_end - parts),
                                        np.concatenate([[0], np.cumsum(part_end - parts)]))
        owner = np.searchsorted(starts, parts, "right") - 1
        taken, head = np.zeros((2, len(starts)), np.int64)
        np.add.at(taken, owner, np.diff(bounds))
        leading = parts == starts[owner]
        head[owner[leading]] = np.diff(bounds)[leading]
        repaired, whole = self._repair(data, offsets, w_start, w_end, broken)
        # in order: the rest of each chunk, then the word that begins in it and is cut by its end
        pieces_at, pieces_size = np.zeros((2, 2 * len(starts)), np.int64)
        pieces_at[0::2], pieces_size[0::2] = at + head, size - taken
        from_chunk = np.searchsorted(starts, w_start[broken], "right") - 1
        lengths = np.fromiter(map(len, repaired), np.int64, len(repaired))
        base = len(self.memo.flat)
        pieces_at[2 * from_chunk + 1] = base + np.cumsum(lengths) - lengths
        pieces_size[2 * from_chunk + 1] = lengths
        extra = np.concatenate([np.array(r, self.encoder.kind) for r in repaired]) if repaired else self.memo.flat[:0]
        flat = pick(np.concatenate([self.memo.flat, extra]), pieces_at, pieces_size)
        counts = sums(pieces_size, 2 * np.searchsorted(starts, offsets, "left"))
        bounds = np.concatenate([[0], np.cumsum(counts)])
        if whole:
            lists = [flat[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            for i, ids in whole.items():
                lists[i] = np.array(ids, self.encoder.kind)
            flat, bounds = np.concatenate(lists), np.concatenate([[0], np.cumsum([len(x) for x in lists])])
        return flat, bounds

    def _repair(self, data, offsets, w_start, w_end, broken):
        """Ids of the cut words; and whole texts' ids where a window never agreed with both neighbours."""
        if not len(broken):
            return [], {}
        text = np.searchsorted(offsets, w_start[broken], "right") - 1
        low = np.searchsorted(w_start, offsets[text], "left")
        high = np.searchsorted(w_start, offsets[text + 1], "left") - 1
        found: list[list[int]] = [[] for _ in broken]
        whole: dict[int, list[int]] = {}
        todo, reach = np.arange(len(broken)), 1
        library = self.encoder.tokenizer.encode_batch_fast
        raw = data.tobytes()

        def ids(from_word, to_word):
            spans = zip(w_start[from_word].tolist(), w_end[to_word].tolist())
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in spans]
            return [e.ids for e in library(texts, add_special_tokens=False)]

        while len(todo):
            k = broken[todo]
            left, right = np.maximum(k - reach, low[todo]), np.minimum(k + reach, high[todo])
            window = ids(left, right)
            has_left, has_right = left < k, right > k
            before, behind = iter(ids(left[has_left], k[has_left] - 1)), iter(ids(k[has_right] + 1, right[has_right]))
            again = []
            for i, w, a, b, stop in zip(todo.tolist(), window, has_left.tolist(), has_right.tolist(),
                                        ((left == low[todo]) & (right == high[todo])).tolist()):
                a, b = next(before) if a else [], next(behind) if b else []
                if len(a) + len(b) <= len(w) and w[:len(a)] == a and w[len(w) - len(b):] == b:
                    found[i] = w[len(a):len(w) - len(b)]
                elif stop:
                    whole[int(text[i])] = w
                else:
                    again.append(i)
            todo, reach = np.array(again, np.int64), reach * 4
        return found, whole

    def decode(self, ids: list[int]) -> str:
        """As the library's ``decode(ids, skip_special_tokens=False)``."""
        if self.tokens is None:
            return self.encoder.tokenizer.decode(ids, skip_special_tokens=False)
        return " ".join(map(self.tokens.__getitem__, ids))


def codec(path: str) -> ChunkCodec:
    """One per worker process, kept for its later tasks."""
    return held(("codec", path), lambda: ChunkCodec(Encoder(path)))


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every text. One narrow pass, no shuffle."""
    def run(batches):
        for rows, data, offsets in blocks(batches, "text", LARGE_BLOCK):
            flat, bounds = codec(tokenizer_path).encode(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat.astype(np.int32)))],
                ["doc_id", "ids"])

    return _source(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of every row of ids; null ids give ''."""
    ship(tokens.sparkSession)

    def run(batches):
        for batch in batches:
            texts = [codec(tokenizer_path).decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")) \
        .mapInArrow(run, "doc_id long, text string")


def codec_digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids (decimal, joined by one space) and of the decoded text.

    Encodes and decodes in one pass, so that no id leaves the worker.
    """
    def run(batches):
        numbers: list[str] = []
        for rows, data, offsets in blocks(batches, "text", LARGE_BLOCK):
            own = codec(tokenizer_path)
            numbers = numbers or list(map(str, range(own.encoder.size)))
            flat, bounds = own.encode(data, offsets)
            ids_hash, text_hash = [], []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                ids = flat[a:b].tolist()
                ids_hash.append(hashlib.sha256(" ".join(map(numbers.__getitem__, ids)).encode()).hexdigest())
                text_hash.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(np.diff(bounds)), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _source(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
