"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text.

Every text is cut into windows, runs of letters; a window is compressed with either dictionary, and the difference of the
lengths says which kind of text it is nearer to. Before compression each letter is written as four bytes that depend on
it alone: zstandard matches three bytes at least and counts whole bytes, so that single letters of a short window tell.

Each dictionary is trained on all windows of its kind of document: those that at least two documents have, the most
frequent last, where references are short, as many as fit. Nothing compares the two kinds before compression does.
A window is suspicious if its toxic length is at most ``longest`` and shorter by ``least`` bytes than its ordinary length.
These thresholds, the size of the toxic dictionary and the logistic mapping from a document's suspicious windows to its
score are calibrated on lengths that no window's own document had a part in: documents are dealt into ``FOLDS`` folds,
equal ones together, and a fold is measured with dictionaries of the others.

Defined cases: a null or empty text has no windows and gets the score of the intercept; without labelled rows of both
kinds every score is 0; null ids of rows stay null and are not held out; repeated rows are scored each; an empty table
gives an empty result; texts of any length are scored whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import dataclasses
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.llm.runtime import discard, filter_texts, held, keep, partitions, ship
from telemill.llm.words import LOWER, Memo, blocks, remembered, sums, words

SAMPLE_DOCS = 8000  # labelled documents learnt from, at most
ORDINARY_BYTES = 1 << 19  # of the ordinary dictionary, at most
TOXIC_BYTES = (1 << 14, 1 << 15, 3 << 14, 1 << 16)  # sizes to choose from for the toxic one
LEAST_DOCS = 2  # documents that have a window of a dictionary, at least
FOLDS = 4
THRESHOLD = 0.3  # score from which a document counts as toxic

_NO_LETTER = np.ones(256, bool)
_NO_LETTER[97:123] = _NO_LETTER[128:] = False
_JUNK = re.compile(r"[\W\d_]+")


def _code(letter: str) -> bytes:
    return hashlib.blake2b(letter.encode(), digest_size=4).digest()


class Codes(dict):
    def __missing__(self, letter: str) -> bytes:
        self[letter] = code = _code(letter)
        return code


_CODES = Codes()


def spell(window: str) -> bytes:
    """A window as it is compressed: four bytes a letter, with marks for its beginning and end."""
    return b"".join([_CODES[c] for c in f"^{window}$"])


def _windows(data: np.ndarray, offsets: np.ndarray):
    lowered = LOWER[data]
    return lowered, *words(lowered, offsets, _NO_LETTER)


def _letters(raw: bytes) -> str:
    return _JUNK.sub("", raw.decode("utf-8", "replace").lower())


class Distance:
    """Compressed lengths of windows with the two dictionaries."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        import zstandard as zstd

        def compressor(content: bytes):
            log = max(len(content).bit_length() + 1, 12)
            parameters = zstd.ZstdCompressionParameters(
                window_log=20, hash_log=log - 1, chain_log=log, search_log=5, min_match=4, target_length=64,
                strategy=zstd.STRATEGY_BTLAZY2, format=zstd.FORMAT_ZSTD1_MAGICLESS, write_content_size=0,
                write_checksum=0, write_dict_id=0)
            dictionary = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            return zstd.ZstdCompressor(dict_data=dictionary, compression_params=parameters).compress

        self.ordinary, self.toxic = compressor(ordinary), compressor(toxic)
        self.memo = Memo(np.int16, 500_000)

    def window(self, letters: str) -> tuple[int, int]:
        """Its ordinary and its toxic length."""
        spelled = spell(letters)
        return len(self.ordinary(spelled)), len(self.toxic(spelled))

    def _new(self, parts: list[bytes]):
        found = np.array([self.window(_letters(p)) for p in parts], np.int64).clip(0, 30000)
        return found.astype(np.int16).ravel(), np.full(len(parts), 2)

    def of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of all windows of a block; and the bounds of each text in them."""
        lowered, starts, ends = _windows(data, offsets)
        lengths, _ = remembered(self.memo, lowered, starts, ends, self._new)
        return lengths.reshape(-1, 2).astype(np.int64), np.searchsorted(starts, offsets, "left")


@dataclasses.dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    least: int
    longest: int
    weights: np.ndarray  # intercept, gain of the best suspicious window (in 20 bytes), log of their number
    distance: Distance | None = None

    def __getstate__(self):
        return self.__dict__ | {"distance": None}

    def key(self) -> bytes:
        parts = (self.ordinary, self.toxic, b"%d %d" % (self.least, self.longest), self.weights.tobytes())
        return hashlib.blake2b(b"".join(parts)).digest()

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        self.distance = self.distance or Distance(self.ordinary, self.toxic)
        lengths, bounds = self.distance.of(data, offsets)
        return 1 / (1 + np.exp(-(document_features(gains(lengths, self.least, self.longest), bounds) @ self.weights)))


def _kept(model: Model) -> Model:
    """The same model of an earlier task of this worker, with what it remembers."""
    return held(("toxicity", model.key()), lambda: model)


def gains(lengths: np.ndarray, least: int, longest: int) -> np.ndarray:
    """Bytes that the toxic dictionary saves on suspicious windows, else 0."""
    gain = lengths[:, 0] - lengths[:, 1]
    return np.where((gain >= least) & (lengths[:, 1] <= longest), gain, 0)


def document_features(gain: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    out = np.zeros((len(bounds) - 1, 3))
    out[:, 0] = 1
    some = np.diff(bounds) > 0
    if some.any():
        out[some, 1] = np.maximum.reduceat(gain, bounds[:-1][some]) / 20
        out[:, 2] = np.log1p(sums(gain > 0, bounds))
    return out


def _dictionary(windows: list[str], counts: np.ndarray, size: int) -> bytes:
    """The windows that documents share, the most frequent last, and a tail that zstandard doesn't index."""
    ranked = sorted(np.flatnonzero(counts >= LEAST_DOCS).tolist(), key=lambda i: (-counts[i], windows[i]))
    content, used = [], 0
    for i in ranked:
        spelled = spell(windows[i])
        used += len(spelled)
        if used > size:
            break
        content.append(spelled)
    return b"".join(reversed(content)) + bytes(range(16))


def calibrate(label: np.ndarray, row: np.ndarray, pairs: np.ndarray) -> tuple[int, int, int, np.ndarray]:
    """Dictionary (index into TOXIC_BYTES), ``least``, ``longest`` and weights from windows measured by other folds.

    ``pairs`` holds (dictionary, gain, toxic length, windows) of positive gain, ``row`` the document that each is of.
    """
    best, chosen, dictionary = -1.0, (0, 1, 0), pairs[:, 0]
    for n in range(len(TOXIC_BYTES)):
        of, gain, length = row[dictionary == n], pairs[dictionary == n, 1], pairs[dictionary == n, 2]
        for longest in range(int(length.min(initial=0)), int(length.min(initial=0)) + 16):
            top = np.zeros(len(label), np.int64)
            np.maximum.at(top, of[length <= longest], gain[length <= longest])
            for least in range(1, 16):  # the thresholds with the best F1, a document being toxic by one suspicious window
                hit = top >= least
                f1 = 2 * (hit & (label > 0)).sum() / max(hit.sum() + label.sum(), 1)
                if f1 > best:
                    best, chosen = f1, (n, least, longest)
    n, least, longest = chosen
    use = (dictionary == n) & (pairs[:, 1] >= least) & (pairs[:, 2] <= longest)
    features = np.zeros((len(label), 3))
    features[:, 0] = 1
    np.maximum.at(features[:, 1], row[use], pairs[use, 1] / 20)
    features[:, 2] = np.log1p(np.bincount(row[use], pairs[use, 3], len(label)))
    return n, least, longest, logistic(features, label.astype(float)).round(6)


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Logistic regression with a small ridge penalty, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w = w + np.linalg.solve(hessian, x.T @ (y - p) - 1e-2 * w)
    return w


def held_out(doc_id) -> F.Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", sample_docs: int = SAMPLE_DOCS,
        id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """A model of at most ``sample_docs`` labelled documents that aren't held out, those with the smallest hashed ids.

    Windows are counted and measured by Spark. The driver gets those that two documents share, for the dictionaries, and
    per document its distinct pairs of lengths.
    """
    spark = docs.sparkSession
    ship(spark)
    chosen = (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
              .dropna().filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs))

    def cut(batches):
        for rows, data, offsets in blocks(batches, "text"):
            lowered, starts, ends = _windows(data, offsets)
            text, bounds = lowered.tobytes(), np.searchsorted(starts, offsets, "left").tolist()
            spans = list(zip(starts.tolist(), ends.tolist()))
            out = [sorted({_letters(text[s:e]) for s, e in spans[a:b]} - {""}) for a, b in zip(bounds, bounds[1:])]
            fold = [zlib.crc32(" ".join(w).encode()) % FOLDS for w in out]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(fold, pa.int32()), rows.column(2),
                                              pa.array(out, pa.list_(pa.string()))], ["doc_id", "fold", "label", "windows"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    sample = keep(source.join(F.broadcast(chosen), "doc_id")  # sample_docs rows at most
                  .select("doc_id", "text", F.least(F.greatest("label", F.lit(0)), F.lit(1)).alias("label"))
                  .mapInArrow(cut, "doc_id long, fold int, label int, windows array<string>"), "toxicity")
    if sample.agg(F.min("label"), F.max("label")).first()[:] != (0, 1):
        return None
    kinds = [(x, k) for x in (0, 1) for k in range(FOLDS)]
    counted = (sample.select("label", "fold", F.explode("windows").alias("window")).groupBy("window")
               .agg(*[F.sum(((F.col("label") == x) & (F.col("fold") == k)).cast("int")).alias(f"n{x}{k}") for x, k in kinds])
               .filter(" OR ".join(f"{' + '.join(f'n{x}{k}' for k in range(FOLDS))} >= {LEAST_DOCS}" for x in (0, 1)))
               .toArrow())
    windows = counted.column("window").to_pylist()
    count = np.array([counted.column(f"n{x}{k}").to_numpy() for x, k in kinds], np.int64).reshape(2, FOLDS, -1)

    def trained(x: int, size: int, without: int | None = None) -> bytes:
        return _dictionary(windows, count[x].sum(0) - (0 if without is None else count[x, without]), size)

    others = [(trained(0, ORDINARY_BYTES, k), [trained(1, size, k) for size in TOXIC_BYTES]) for k in range(FOLDS)]

    def measure(batches):
        at, known, distances = None, {}, []
        for batch in batches:
            out = []
            for fold, held_windows in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                if fold != at:
                    at, known = fold, {}
                    distances = [Distance(others[fold][0], toxic) for toxic in others[fold][1]]
                found: Counter = Counter()
                for window in held_windows:
                    if window not in known:
                        spelled = spell(window)
                        ordinary = len(distances[0].ordinary(spelled))
                        lengths = [len(d.toxic(spelled)) for d in distances]
                        known[window] = [(n, ordinary - x, x) for n, x in enumerate(lengths) if x < ordinary]
                    found.update(known[window])
                out.append([y for key in sorted(found) for y in (*key, found[key])])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.list_(pa.int32()))],
                                             ["doc_id", "label", "pairs"])

    measured = (sample.repartition(partitions(spark), "fold", F.xxhash64("doc_id") % 8).sortWithinPartitions("fold")
                .mapInArrow(measure, "doc_id long, label int, pairs array<int>").toArrow().sort_by("doc_id"))
    discard(sample)
    pairs = measured.column("pairs").combine_chunks()
    sizes = pairs.value_lengths().to_numpy().astype(np.int64) // 4
    flat = pairs.flatten().to_numpy().astype(np.int64).reshape(-1, 4)
    n, least, longest, weights = calibrate(measured.column("label").to_numpy(), np.repeat(np.arange(len(sizes)), sizes), flat)
    return Model(trained(0, ORDINARY_BYTES), trained(1, TOXIC_BYTES[n]), least, longest, weights)


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score, predicted. One narrow pass, no shuffle."""
    ship(docs.sparkSession)

    def run(batches):
        own = _kept(model) if model else None
        for rows, data, offsets in blocks(batches, "text"):
            value = own.score(data, offsets) if own else np.zeros(len(offsets) - 1)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(value)], ["doc_id", "score"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    scored = source.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_ordinary(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows whose texts score below the threshold, with all their columns."""
    def prepare():
        own = _kept(model) if model else None
        return lambda data, offsets: own.score(data, offsets) < threshold if own else np.ones(len(offsets) - 1, bool)

    return filter_texts(docs, text_col, prepare)
