"""Removal of repeated passages by a depth-limited radix sort of suffixes.

A byte that lies in a ``width``-byte string which also starts in a document of smaller id is removed. The suffixes of all
documents are grouped by most-significant-digit passes, only as deep as ``width`` bytes:

1. The first digit of a suffix is taken from its first ``width`` bytes: their smallest ``GRAM``-byte string by hash (its
   anchor). Successive suffixes mostly share an anchor, so one row stands for such a run of suffixes. Rows are shuffled
   by this digit; digits of one document only are dropped, which is the bulk of all suffixes.
2. The runs that remain take their bytes along, are shuffled by the digit again, and are parted by their distance to the
   anchor and then by eight bytes a pass. A group that has become one document's is dropped at once. After the last pass
   equal groups are exactly the repeated strings; all but those of the smallest id are covered.

A digit of more than ``HOT`` runs isn't left to one task: its suffixes are shuffled by a hash of all their ``width`` bytes.
Tasks settle what they hold first and send a string for its smallest document only.

Within a block of documents a run that repeats is sent once for its smallest id, and a digit that several documents of
the block share is sent for two of them, so that frequent passages don't gather in one task.

Defined cases: a null text is empty; texts shorter than ``width`` lose nothing; rows of null id neither lose nor cover
anything; rows of equal id don't cover each other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telemill.llm.runtime import drop_held, free_shuffles, keep, partitions, ship, spare_name
from telemill.llm.words import LARGE_BLOCK, Hasher, blocks, mix

GRAM = 16
SALTS = 64
RUNS_AT_ONCE = 20_000
HOT = 1 << 15  # runs of a digit that one task resolves, in about 100 MB
SMALL = 100_000  # hot digits that are broadcast, eight bytes each; more are joined by a shuffle
SETTLED = LARGE_BLOCK  # bytes of text whose repeats are settled with each other before anything is shuffled


class Runs:
    """Runs of suffixes of a block that share their anchor."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, width: int):
        grams = Hasher(data).windows(GRAM)
        n = len(data) - width + 1
        self.start = self.end = self.anchor = np.zeros(0, np.int64)
        self.digit = np.zeros(0, np.uint64)
        if n <= 0:
            return
        low = np.uint64((1 << len(data).bit_length()) - 1)
        best = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)  # of equal hashes the leftmost wins
        reach, left = 1, width - GRAM + 1
        while reach < left:  # the smallest of `reach` successive ones
            step = min(reach, left - reach)
            best = np.minimum(best[:-step], best[step:])
            reach += step
        anchor = (best[:n] & low).astype(np.int64)
        inside = np.zeros(n, bool)
        whole = np.diff(offsets) >= width
        edges = np.zeros(n + 1, np.int64)
        np.add.at(edges, offsets[:-1][whole], 1)
        np.add.at(edges, offsets[1:][whole] - width + 1, -1)
        inside[np.cumsum(edges)[:n] > 0] = True
        new = np.ones(n, bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | ~inside[:-1]
        begins = np.zeros(n, bool)
        begins[offsets[:-1][whole]] = True
        self.start = np.flatnonzero(inside & (new | begins))
        last = np.flatnonzero(inside & np.append(new[1:] | begins[1:] | ~inside[1:], True))
        self.end = last + width  # of the bytes
        self.anchor = anchor[self.start]
        self.digit = grams[self.anchor]


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    ship(docs.sparkSession)
    text = F.col(text_col).cast("binary")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), _text_hash(text).alias("text_hash"))


def _text_hash(text) -> F.Column:
    """Tells rows of equal id apart."""
    return F.hash(text)


def _doc_ids(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    ids = rows.column(0)
    return ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False)


def shared_digits(source: DataFrame, width: int) -> DataFrame:
    """First pass: doc_id and starts (array) of the runs whose digit several documents have, and the smallest digit."""
    def run(batches):
        drop_held()
        for rows, data, offsets in blocks(batches, "text", SETTLED):
            runs = Runs(data, offsets, width)
            text = np.searchsorted(offsets, runs.start, "right") - 1
            ids, valid = _doc_ids(rows)
            use = valid[text]
            digit, at, doc = runs.digit[use], (runs.start - offsets[text])[use], ids[text[use]]
            order = np.lexsort((doc, digit))
            digit, at, doc = digit[order], at[order], doc[order]
            first = np.ones(len(digit), bool)
            first[1:] = digit[1:] != digit[:-1]
            last = np.append(first[1:], True)[:len(first)]
            group = np.cumsum(first) - 1
            low, high = doc[first], doc[last]
            sure = (low < high)[group] if len(digit) else first
            salt = np.where(sure & ~first & ~last, 1 + np.arange(len(digit)) % SALTS, 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(digit.view(np.int64)), pa.array(doc), pa.array(at), pa.array(sure),
                 pa.array(salt.astype(np.int32))], ["digit", "doc_id", "at", "sure", "salt"])

    rows = source.mapInArrow(run, "digit long, doc_id long, at long, sure boolean, salt int")
    same = Window.partitionBy("digit", "salt")
    shared = rows.select("doc_id", "at", "sure", "digit", F.min("doc_id").over(same).alias("low"),
                         F.max("doc_id").over(same).alias("high")).filter("sure OR low < high")
    return shared.groupBy("doc_id").agg(F.collect_list("at").alias("starts"), F.min("digit").alias("family"))


def carried_runs(source: DataFrame, shared: DataFrame, width: int) -> DataFrame:
    """The shared runs with their bytes; runs that repeat within a block are covered at once and carry none.

    Copies mostly have the same smallest digit, so documents are dealt by it: most of what copies share is settled within
    a block. Spark splits the partitions of large families.
    """
    def run(batches):
        drop_held()
        for rows, data, offsets in blocks(batches, "text", SETTLED):
            runs = Runs(data, offsets, width)
            text = np.searchsorted(offsets, runs.start, "right") - 1
            ids, _ = _doc_ids(rows)
            starts = rows.column(rows.schema.get_field_index("starts"))
            counts = starts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            hints = starts.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            use = np.isin(runs.start, hints + np.repeat(offsets[:-1], counts))
            start, end, anchor, text = runs.start[use], runs.end[use], runs.anchor[use], text[use]
            digit, doc = runs.digit[use], ids[text]
            raw = data.tobytes()
            span = [raw[a:b] for a, b in zip(start.tolist(), end.tolist())]
            # the smallest document first; the rest of equal runs is covered
            seen: dict[bytes, int] = {}
            covered = np.zeros(len(span), bool)
            for i in np.argsort(doc, kind="stable").tolist():
                covered[i] = seen.setdefault(span[i], doc[i]) < doc[i]
            at = start - offsets[text]
            yield pa.RecordBatch.from_arrays(
                [pa.array(digit.view(np.int64)), pa.array(doc), pa.array(at), pa.array(at + end - start),
                 pa.array((anchor - start).astype(np.int32)), rows.column(names.index("text_hash")).take(pa.array(text)),
                 pa.array([None if c else s for s, c in zip(span, covered.tolist())], pa.binary())],
                ["digit", "doc_id", "start", "end", "anchor", "text_hash", "span"])

    names = ["doc_id", "text", "text_hash", "starts"]
    dealt = source.join(shared, "doc_id").select(*names, "family").hint("rebalance", "family")
    return dealt.sortWithinPartitions("family", "doc_id").mapInArrow(
        run, "digit long, doc_id long, start long, end long, anchor int, text_hash int, span binary")


def radix_passes(digit: np.ndarray, doc: np.ndarray, anchor: np.ndarray, spans: pa.Array, width: int) -> np.ndarray:
    """Which suffixes repeat one of a smaller document: a flag per suffix, run after run, by passes of eight bytes."""
    offsets = np.frombuffer(spans.buffers()[1], np.int32)[spans.offset:spans.offset + len(spans) + 1].astype(np.int64)
    data = np.frombuffer(spans.buffers()[2], np.uint8)
    count = np.diff(offsets) - width + 1
    total = int(count.sum())
    row = np.repeat(np.arange(len(digit)), count)
    step = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
    at, who = offsets[:-1][row] + step, doc[row]
    covered, alive = np.zeros(total, bool), np.arange(total)
    _, group = np.unique(digit, return_inverse=True)
    group = group[row] * (width + 1) + (anchor[row] - step)
    words = np.lib.stride_tricks.sliding_window_view(data, 8)
    depths = [None, *range(0, width - 8, 8), width - 8]
    for depth in depths:
        if not len(alive):
            break
        key = group if depth is None else words[at[alive] + depth].copy().view(np.uint64).ravel()
        order = np.argsort(key, kind="stable") if depth is None else np.lexsort((key, group))
        alive, key, group = alive[order], key[order], group[order]
        first = np.ones(len(alive), bool)
        first[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        group, at_first, members = np.cumsum(first) - 1, np.flatnonzero(first), who[alive]
        several = (np.minimum.reduceat(members, at_first) < np.maximum.reduceat(members, at_first))[group]
        alive, group = alive[several], group[several]
    if len(alive):
        first = np.ones(len(alive), bool)
        first[1:] = group[1:] != group[:-1]
        smallest = np.minimum.reduceat(who[alive], np.flatnonzero(first))[np.cumsum(first) - 1]
        covered[alive] = who[alive] > smallest
    return covered


def covered_ranges(carried: DataFrame, width: int) -> DataFrame:
    """Second and later passes: doc_id, text_hash, start, end of the bytes that repeat a smaller document's."""
    def resolve(table: pa.Table):
        doc, start, anchor, digit = (table.column(c).to_numpy() for c in ("doc_id", "start", "anchor", "digit"))
        spans = table.column("span").combine_chunks()
        covered = radix_passes(digit, doc, anchor, spans, width)
        count = pc.binary_length(spans).to_numpy() - width + 1
        row = np.repeat(np.arange(len(doc)), count)
        step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        new = covered.copy()
        new[1:] &= ~covered[:-1] | (step[1:] == 0)
        done = covered.copy()
        done[:-1] &= ~covered[1:] | (step[1:] == 0)
        a, b = np.flatnonzero(new), np.flatnonzero(done)
        kind = table.column("text_hash").to_numpy()
        return pa.RecordBatch.from_arrays(
            [pa.array(doc[row[a]]), pa.array(kind[row[a]]), pa.array(start[row[a]] + step[a]),
             pa.array(start[row[b]] + step[b] + width)], ["doc_id", "text_hash", "start", "end"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held)
            if table.num_rows >= RUNS_AT_ONCE:
                digit = table.column("digit").to_numpy()
                cut = int(np.searchsorted(digit, digit[-1], "left"))  # the last digit may go on
                if cut:
                    yield resolve(table.slice(0, cut))
                    held = table.slice(cut).combine_chunks().to_batches()
        if held and sum(b.num_rows for b in held):
            yield resolve(pa.Table.from_batches(held))

    runs = carried.filter("span IS NOT NULL").select("digit", "doc_id", "text_hash", "start", "anchor", "span")
    hot = keep(runs.groupBy("digit").count().filter(F.col("count") > HOT).select("digit"), "hot")
    covered, many = carried.filter("span IS NULL").select("doc_id", "text_hash", "start", "end"), hot.count()
    if many:
        side = F.broadcast(hot) if many <= SMALL else hot
        covered = covered.unionByName(hot_ranges(runs.join(side, "digit", "left_semi"), width))
        runs = runs.join(side, "digit", "left_anti")
    found = (runs.repartition(partitions(carried.sparkSession), "digit").sortWithinPartitions("digit")
             .mapInArrow(run, "doc_id long, text_hash int, start long, end long"))
    return found.unionByName(covered)


def hot_ranges(runs: DataFrame, width: int) -> DataFrame:
    """The ranges that ``covered_ranges`` gives, of digits with too many runs for a task.

    Strings are told apart by 96 bits: 64 of the string and 32 of its digit.
    """
    def settle(table: pa.Table):
        spans = table.column("span").combine_chunks()
        offsets = np.frombuffer(spans.buffers()[1], np.int32)[spans.offset:spans.offset + len(spans) + 1].astype(np.int64)
        data = np.frombuffer(spans.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
        count = np.diff(offsets) - width + 1
        row = np.repeat(np.arange(len(count)), count)
        step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        digit, doc, text, start = (table.column(c).to_numpy() for c in ("digit", "doc_id", "text_hash", "start"))
        key = Hasher(data).windows(width)[(offsets[:-1] - offsets[0])[row] + step]
        also, who, at = digit[row].astype(np.int32), doc[row], start[row] + step
        order = np.lexsort((who, also, key))
        first = np.ones(len(order), bool)
        first[1:] = (key[order][1:] != key[order][:-1]) | (also[order][1:] != also[order][:-1])
        covered = np.zeros(len(order), bool)
        covered[order] = who[order] > who[order][first][np.cumsum(first) - 1]
        new, last = covered.copy(), covered.copy()
        new[1:] &= ~covered[:-1] | (step[1:] == 0)
        last[:-1] &= ~covered[1:] | (step[1:] == 0)
        done, kept = np.flatnonzero(new), np.flatnonzero(~covered)
        use = np.concatenate([done, kept])
        spread = mix(at[done].astype(np.uint64) + mix(who[done].astype(np.uint64)))  # they need to meet no other row
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([spread, key[kept]]).view(np.int64)), pa.array(also[use]), pa.array(who[use]),
             pa.array(text[row[use]]), pa.array(at[use]),
             pa.array(np.concatenate([at[np.flatnonzero(last)], at[kept]]) + width),
             pa.array(np.arange(len(use)) < len(done))], ["key", "also", "doc_id", "text_hash", "start", "end", "done"])

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= RUNS_AT_ONCE:
                yield settle(pa.Table.from_batches(held))
                held, rows = [], 0
        if rows:
            yield settle(pa.Table.from_batches(held))

    sent = runs.mapInArrow(run, "key long, also int, doc_id long, text_hash int, start long, end long, done boolean")
    low = F.min(F.when(~F.col("done"), F.col("doc_id"))).over(Window.partitionBy("key", "also"))
    return sent.withColumn("low", low).filter("done OR doc_id > low").select("doc_id", "text_hash", "start", "end")


def repeated_ranges(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash and ranges (array of start, end in bytes; they may overlap) that repeat a smaller document's bytes."""
    source = _source(docs, id_col, text_col)
    shared = keep(shared_digits(source, width), "digits")
    free_shuffles(docs.sparkSession)
    carried = keep(carried_runs(source, shared, width), "runs")
    free_shuffles(docs.sparkSession)
    found = covered_ranges(carried, width)
    ranges = keep(found.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "end")).alias("ranges")), "ranges")
    del found
    free_shuffles(docs.sparkSession)
    return ranges


def _covered(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, name: str = "ranges") -> np.ndarray:
    ranges = rows.column(rows.schema.get_field_index(name))
    counts = ranges.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = ranges.flatten()
    base = np.repeat(offsets[:-1], counts)
    edges = np.zeros(len(data) + 1, np.int64)
    if len(flat):
        np.add.at(edges, flat.field("start").to_numpy() + base, 1)
        np.add.at(edges, flat.field("end").to_numpy() + base, -1)
    return np.cumsum(edges)[:-1] > 0


def removal_digests(docs: DataFrame, ranges: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256."""
    def run(batches):
        for rows, data, offsets in blocks(batches, "text", LARGE_BLOCK):
            gone = _covered(rows, data, offsets)
            new = gone.copy()
            new[1:] &= ~gone[:-1]
            new[offsets[:-1][offsets[:-1] < len(data)]] |= gone[offsets[:-1][offsets[:-1] < len(data)]]
            removed, spans = (np.diff(np.concatenate([[0], np.cumsum(x)])[offsets]) for x in (gone, new))
            left = data[~gone].tobytes()
            bounds = np.concatenate([[0], np.cumsum(np.diff(offsets) - removed)]).tolist()
            digest = [hashlib.sha256(left[a:b]).hexdigest() for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(np.diff(offsets)), pa.array(removed.astype(np.int64)),
                 pa.array(spans.astype(np.int64)), pa.array(digest, pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return (_source(docs, id_col, text_col).join(ranges, ["doc_id", "text_hash"], "left").select("doc_id", "text", "ranges")
            .mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))


def remove_ranges(docs: DataFrame, ranges: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns, the text without the characters that the ranges cover whole. A null text stays null."""
    ship(docs.sparkSession)
    schema, place = docs.schema, docs.columns.index(text_col)
    key = spare_name(docs, "range_id")
    found = spare_name(docs, "ranges")
    kind = spare_name(docs, "range_text")
    named = ranges.select(F.col("doc_id").alias(key), F.col("text_hash").alias(kind), F.col("ranges").alias(found))

    def run(batches):
        for rows, data, offsets in blocks(batches, text_col, LARGE_BLOCK):
            gone = _covered(rows, data, offsets, found)
            lead = (data & 0xC0) != 0x80
            lead[offsets[:-1][offsets[:-1] < len(data)]] = True
            first = np.flatnonzero(lead)
            if len(first):
                gone = np.repeat(np.minimum.reduceat(gone, first), np.diff(np.append(first, len(data))))
            left = data[~gone].tobytes()
            removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[offsets])
            bounds = np.concatenate([[0], np.cumsum(np.diff(offsets) - removed)]).tolist()
            null = rows.column(place).is_null().to_pylist()
            texts = [None if z else left[a:b].decode("utf-8", "replace") for a, b, z in zip(bounds[:-1], bounds[1:], null)]
            columns = list(rows.columns[:len(schema)])
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, rows.schema.names[:len(schema)])

    joined = docs.join(named, (F.col(id_col).cast("long") == F.col(key))
                       & (_text_hash(F.col(text_col).cast("binary")) == F.col(kind)), "left")
    return joined.select(*[F.col(c) for c in docs.columns], found).mapInArrow(run, schema)
