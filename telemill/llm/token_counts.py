"""Token counts of whole texts by heap-and-linked-list byte-pair merging; no token id is made.

A text is cut into units that no piece of the vocabulary crosses, so merging one unit never depends on another. In a unit
every character is a symbol; the adjacent pair whose joint piece has the lowest rank is merged, leftmost first, until no
pair is a piece. The count is the number of symbols less the number of merges; a character outside the vocabulary counts
as its UTF-8 bytes. Equal units are counted once per worker.

Defined cases: a null or empty text has 0 bytes and 0 tokens; null ids stay null; repeated rows are counted each; an
empty table gives an empty result; all other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.llm.runtime import held, ship
from telemill.llm.words import LARGE_BLOCK, Memo, blocks, remembered, sums

SPACE = "▁"  # how the vocabulary writes a space
_SPACE_BYTES = SPACE.encode()


class PieceCounter:
    """Counts the pieces that a byte-pair model with byte fallback makes of a text."""

    def __init__(self, model_path: str, limit: int = 1_500_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.ranks = {model.id_to_piece(i): -model.get_score(i) for i in range(model.get_piece_size())
                      if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
        if any(SPACE in piece.lstrip(SPACE) for piece in self.ranks):
            raise ValueError("a piece of this vocabulary goes on after a space; texts can't be cut at spaces")
        self.cut_lines = not any("\n" in piece for piece in self.ranks)
        self.memo = Memo(np.int32, limit)

    def unit(self, text: str) -> int:
        """Pieces of one unit, spaces already written as the vocabulary writes them."""
        ranks, n = self.ranks, len(text)
        symbols, after, before = list(text), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            rank = ranks.get(text[i:i + 2])
            if rank is not None:
                heap.append((rank, i, 2))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, length = heapq.heappop(heap)
            left = symbols[i]
            if left is None:
                continue
            j = after[i]
            if j >= n or len(left) + len(symbols[j]) != length:
                continue  # one of the two has been merged since
            merges += 1
            symbols[i] = left = left + symbols[j]
            symbols[j] = None
            after[i] = j = after[j]
            if j < n:
                before[j] = i
                rank = ranks.get(left + symbols[j])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, length + len(symbols[j])))
            j = before[i]
            if j >= 0:
                rank = ranks.get(symbols[j] + left)
                if rank is not None:
                    heapq.heappush(heap, (rank, j, length + len(symbols[j])))
        extra = sum(len(s.encode()) - 1 for s in symbols if s is not None and len(s) == 1 and s not in ranks)
        return n - merges + extra

    def _new(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        unit = self.unit
        counts = [unit(p.decode("utf-8", "replace").replace(" ", SPACE)) for p in parts]
        return np.array(counts, np.int32), np.ones(len(counts), np.int64)

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Pieces of every text of a block."""
        if _SPACE_BYTES in (raw := data.tobytes()):
            texts = [raw[a:b].replace(_SPACE_BYTES, b" ") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            data = np.frombuffer(b"".join(texts), np.uint8)
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        # every text that isn't empty is led by one more space
        led = np.diff(offsets) > 0
        shift = np.concatenate([[0], np.cumsum(led)])
        out = np.full(len(data) + int(shift[-1]), 32, np.uint8)
        keep = np.ones(len(out), bool)
        keep[(offsets + shift)[:-1][led]] = False
        out[keep] = data
        data, offsets = out, offsets + shift
        if not len(data):
            return np.zeros(len(offsets) - 1, np.int64)
        space = data == 32
        mark = space.copy()
        mark[1:] &= ~space[:-1]
        if self.cut_lines:
            line = data == 10
            mark |= line
            mark[1:] |= line[:-1]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        starts = np.flatnonzero(mark | edge[:-1])
        counts, _ = remembered(self.memo, data, starts, np.append(starts[1:], len(data)), self._new)
        return sums(counts, np.searchsorted(starts, offsets, "left"))


def counter(model_path: str) -> PieceCounter:
    """One per worker process, kept for its later tasks."""
    return held(("counter", model_path), lambda: PieceCounter(model_path))


def count_tokens(docs: DataFrame, model_path: str, limit: int, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more tokens than ``limit``). One narrow pass, no shuffle."""
    ship(docs.sparkSession)

    def run(batches):
        for rows, data, offsets in blocks(batches, "text", LARGE_BLOCK):
            counts = counter(model_path).count(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(np.diff(offsets)), pa.array(counts.astype(np.int64)),
                 pa.array(counts > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
