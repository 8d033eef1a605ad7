"""Quality rules: base counts of a text and a linear-chain conditional random field over its lines.

Every line with a word is described by a few shares (symbols, capitals, separators, repeats, ...). A two-state chain,
content or boilerplate, is trained on lines of labelled documents, a line taking its document's label; Viterbi decoding
marks the lines of every text, and the share of words in content lines decides retention.

Defined cases: a null or empty text has zero counts and fails the base rules; without labelled documents of both kinds
every line counts as content; null ids of rows stay null; repeated rows are judged each; an empty table gives an empty
result; texts of any length are decoded whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.llm.runtime import drop_held, filter_texts, ship
from telemill.llm.words import WHITE, Hasher, blocks, mix, sums, words

SAMPLE_DOCS = 4000  # labelled documents that the chain is trained on, at most
SYMBOLS = b"#*$%&|<>"

_SYMBOL, _UPPER, _DIGIT, _PUNCT = np.zeros((4, 256), bool)
_SYMBOL[list(SYMBOLS)] = True
_UPPER[65:91] = True
_DIGIT[48:58] = True
_PUNCT[list(b"!?=_~^@/\\[]{}")] = True
FEATURES = ("bias", "symbols", "capitals", "digits", "marks", "repeated words", "repeated line", "long words",
            "short line", "bare words")


@dataclasses.dataclass
class Measures:
    """Base counts per text and features per line with a word."""
    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    features: np.ndarray
    line_words: np.ndarray
    line_bounds: np.ndarray  # of each text in the lines


def measure(data: np.ndarray, offsets: np.ndarray) -> Measures:
    """All counts of a block of texts."""
    starts, ends = words(data, offsets)
    hasher = Hasher(data)
    n_texts = len(offsets) - 1
    text_words = np.searchsorted(starts, offsets, "left")
    lead = (data & 0xC0) != 0x80  # bytes that begin a character
    solid = ~WHITE[data]
    # words in three-word windows that a text has twice
    repeated = np.zeros(len(starts), bool)
    if len(starts) >= 3:
        value = hasher.ranges(starts, ends)
        owner = np.repeat(np.arange(n_texts), np.diff(text_words))
        same = owner[:-2] == owner[2:]
        key = mix(mix(value[:-2] + np.uint64(1)) + value[1:-1] * np.uint64(0x9E3779B97F4A7C15)) + value[2:]
        key = mix(mix(key) + owner[:-2].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))[same]
        _, back, times = np.unique(key, return_inverse=True, return_counts=True)
        at = np.flatnonzero(same)[times[back] > 1]
        for k in range(3):
            repeated[at + k] = True
    # lines
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    feed = np.flatnonzero(data == 10)
    edge[feed + 1] = True
    l_start = np.flatnonzero(edge[:-1])
    l_end = np.append(l_start[1:], len(data))
    l_end = l_end - ((l_end > l_start) & (data[l_end - 1] == 10)) if len(l_start) else l_end
    n_line_words = np.searchsorted(starts, l_end, "left") - np.searchsorted(starts, l_start, "left")
    l_start, l_end, line_words = (x[n_line_words > 0] for x in (l_start, l_end, n_line_words))
    line_bounds = np.searchsorted(l_start, offsets, "left")
    owner = np.repeat(np.arange(n_texts), np.diff(line_bounds))
    key = mix(hasher.ranges(l_start, l_end) + owner.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    duplicate = np.ones(len(key), bool)
    duplicate[np.unique(key, return_index=True)[1]] = False

    count = np.int32 if len(data) < 1 << 31 else np.int64

    def per_line(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flags) + 1, count)
        np.cumsum(flags, out=total[1:])
        return total[l_end] - total[l_start]

    chars = np.maximum(per_line(lead & solid), 1)
    first_word = np.searchsorted(starts, l_start, "left")
    total = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(repeated, out=total[1:])
    again = total[first_word + line_words] - total[first_word]
    upper = _UPPER[data]
    upper[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    spaced = np.zeros(len(data), bool)  # words of one sign
    one = ends - starts == 1
    spaced[starts[one]] = ~(upper | _DIGIT[data] | ((data >= 97) & (data < 123)))[starts[one]]
    features = np.stack([
        np.ones(len(l_start)), per_line(_SYMBOL[data]) / chars, per_line(upper) / chars, per_line(_DIGIT[data]) / chars,
        per_line(_PUNCT[data]) / chars, again / np.maximum(line_words, 1), duplicate.astype(float),
        np.minimum(chars / np.maximum(line_words, 1) / 20, 1.0), (line_words < 4).astype(float),
        per_line(spaced) / np.maximum(line_words, 1)], axis=1) if len(l_start) else np.zeros((0, len(FEATURES)))
    return Measures(np.diff(text_words), sums(lead & solid, offsets), sums(_SYMBOL[data], offsets),
                    sums(duplicate, line_bounds), sums(repeated, text_words), features, line_words, line_bounds)


@dataclasses.dataclass
class Chain:
    """A linear chain with states content (0) and boilerplate (1): the emission weights of the second, transitions."""
    weights: np.ndarray
    transitions: np.ndarray

    def decode(self, features: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Viterbi: is each line boilerplate? All texts of a block step by step at once."""
        states = np.zeros(len(features), np.int8)
        order, first, counts = _by_length(bounds)
        if not len(order):
            return states
        emission, t = features @ self.weights, self.transitions
        back = np.zeros((len(features), 2), np.int8)
        steps = int(counts[0])
        active = np.searchsorted(-counts, -np.arange(steps), "left")
        score = np.zeros((len(order), 2))
        for k in range(steps):
            n = active[k]
            at = first[:n] + k
            if k:
                both = score[:n, :, None] + t[None]
                back[at] = both.argmax(1)
                score[:n] = both.max(1)
            score[:n, 1] += emission[at]
        now = score.argmax(1).astype(np.int8)
        for k in range(steps - 1, -1, -1):
            n = active[k]
            at = first[:n] + k
            states[at] = now[:n]
            if k:
                now[:n] = back[at, now[:n]]
        return states


def _by_length(bounds: np.ndarray):
    counts = np.diff(bounds)
    order = np.argsort(-counts, kind="stable")
    order = order[counts[order] > 0]
    return order, bounds[:-1][order], counts[order]


def _soft(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis))


def train(features: np.ndarray, bounds: np.ndarray, labels: np.ndarray, rounds: int = 150) -> Chain:
    """Maximum likelihood with a small ridge penalty, by forward-backward and Adam steps."""
    order, first, counts = _by_length(bounds)
    steps = int(counts[0])
    active = np.searchsorted(-counts, -np.arange(steps), "left")
    theta, slope, square = np.zeros((3, features.shape[1] + 4))
    true = np.zeros_like(theta)
    true[:-4] = features[labels == 1].sum(0)
    inner = np.ones(len(features), bool)
    inner[bounds[:-1][np.diff(bounds) > 0]] = False
    at = np.flatnonzero(inner)
    np.add.at(true, features.shape[1] + 2 * labels[at - 1] + labels[at], 1)
    for step in range(1, rounds + 1):
        t = theta[-4:].reshape(2, 2)
        emission = np.zeros((len(features), 2))
        emission[:, 1] = features @ theta[:-4]
        alpha, beta = emission.copy(), np.zeros_like(emission)
        for k in range(1, steps):
            at = first[:active[k]] + k
            alpha[at] += _soft(alpha[at - 1][:, :, None] + t[None], 1)
        for k in range(steps - 1, 0, -1):
            at = first[:active[k]] + k
            beta[at - 1] = _soft(t[None] + (emission[at] + beta[at])[:, None, :], 2)
        log_z = np.zeros(len(features))
        for a, n in zip(first, counts):
            log_z[a:a + n] = np.logaddexp(*alpha[a + n - 1])
        marginal = np.exp(alpha[:, 1] + beta[:, 1] - log_z)
        expected = np.zeros_like(theta)
        expected[:-4] = features.T @ marginal
        at = np.flatnonzero(inner)
        pair = np.exp(alpha[at - 1][:, :, None] + t[None] + (emission[at] + beta[at])[:, None, :] - log_z[at][:, None, None])
        expected[-4:] = pair.sum(0).ravel()
        gradient = (true - expected) / len(features) - 1e-4 * theta
        slope = 0.9 * slope + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient ** 2
        theta = theta + 0.3 * slope / (1 - 0.9 ** step) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-8)
    return Chain(theta[:-4], theta[-4:].reshape(2, 2))


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))


def fit_chain(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample_docs: int = SAMPLE_DOCS,
              id_col: str = "doc_id", text_col: str = "text") -> Chain | None:
    """A chain trained on at most ``sample_docs`` labelled documents, those with the smallest hashed ids.

    Only the lines' features of the sample come to the driver. None without documents of both labels.
    """
    ship(docs.sparkSession)
    chosen = (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
              .dropna().groupBy("doc_id").agg(F.min("label").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs))

    def run(batches):
        for rows, data, offsets in blocks(batches, "text"):
            m = measure(data, offsets)
            values = m.features.astype(np.float32)
            cut = [values[a:b].tobytes() for a, b in zip(m.line_bounds[:-1].tolist(), m.line_bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(cut, pa.binary())],
                                             ["doc_id", "label", "lines"])

    found = (_source(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id")  # sample_docs rows at most
             .select("doc_id", "text", "label").mapInArrow(run, "doc_id long, label int, lines binary")
             .toPandas().sort_values("doc_id", kind="stable"))
    lines = [np.frombuffer(x, np.float32).reshape(-1, len(FEATURES)).astype(float) for x in found["lines"]]
    label = np.array([0 if x else 1 for x in found["label"]], np.int64)
    sizes = np.array([len(x) for x in lines], np.int64)
    per_line = np.repeat(label, sizes) if len(sizes) else label
    if len(np.unique(per_line)) < 2:
        return None
    return train(np.concatenate(lines), np.concatenate([[0], np.cumsum(sizes)]), per_line)


def verdicts(m: Measures, chain: Chain | None, content_share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base_failed, share of words in content lines, kept."""
    boiler = chain.decode(m.features, m.line_bounds) if chain else np.zeros(len(m.features), np.int8)
    content = sums(m.line_words * (boiler == 0), m.line_bounds)
    share = content / np.maximum(m.n_words, 1)
    failed = (m.n_words < 50) | (100 * m.n_repeat_words > 50 * m.n_words)
    return failed, share, ~failed & (share >= content_share)


def judge(docs: DataFrame, chain: Chain | None, content_share: float = 0.5, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """Per row the base counts, base_failed, content_share (of words) and kept. One narrow pass, no shuffle."""
    ship(docs.sparkSession)

    def run(batches):
        drop_held()
        for rows, data, offsets in blocks(batches, "text"):
            m = measure(data, offsets)
            failed, share, kept = verdicts(m, chain, content_share)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), *(pa.array(x.astype(np.int64)) for x in (
                    m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words)), pa.array(failed),
                 pa.array(share), pa.array(kept)],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                 "content_share", "kept"])

    return _source(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
             "base_failed boolean, content_share double, kept boolean")


def keep_good(docs: DataFrame, chain: Chain | None, content_share: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows that ``judge`` keeps, with all their columns."""
    def prepare():
        drop_held()
        return lambda data, offsets: verdicts(measure(data, offsets), chain, content_share)[2]

    return filter_texts(docs, text_col, prepare)
