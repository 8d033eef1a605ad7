"""Near-duplicates: b-bit MinHash signatures, a multi-index Hamming join, and confirmation on full shingle sets.

A signature has ``SYMBOLS`` symbols of 16 bits in ``CHUNKS`` chunks of five. Two signatures that differ in at most
``REACH`` = 2 * CHUNKS - 1 symbols have a chunk with one error at most (pigeonhole). Every chunk is therefore entered five
times, each time with another symbol left out: all pairs under the signature distance meet in a bucket. Documents of
similarity 0.8 differ in 16 of 80 symbols on average; more than 31 is 4.3 standard deviations off.

1. Documents of equal shingle sets are one class; only its smallest id goes on.
2. In each bucket documents name their nearest partner; the best one of each document is confirmed on full sets.
   Confirmed links give first components.
3. In buckets that still hold several components every pair across components under the distance is looked at, in the
   first bucket that it shares: documents with such a pair bring their full sets to that bucket, where shared shingles
   are counted exactly and only links that join two components are returned. Pairs within a component can't change it,
   so no link is lost.

A bucket of more than ``BLOCK`` documents is dealt into blocks, so that no work holds more than about two of them: partners
are sought within a block, where the bucket's smallest document is a hub of each, and step 3 looks at pairs of blocks.

Defined cases: texts without words (null ones too) are empty and linked with nothing; rows of null id are linked with
nothing, their component is null and they are kept; rows of equal id share a component if their sets do, and are kept
together; an empty table gives an empty result; texts of any length are used whole; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telemill.llm.runtime import drop_held, free_shuffles, keep, partitions, ship, spare_name
from telemill.llm.words import LOWER, Hasher, blocks, mix, pick, words

CHUNKS, WIDTH = 16, 5
SYMBOLS, REACH = CHUNKS * WIDTH, 2 * CHUNKS - 1
ALL_PAIRS = 256  # in larger buckets the nearest partner is sought among HUBS members
HUBS = 32
BLOCK = 4096  # documents of a bucket whose full sets meet in a task, at most twice as many

_RANDOM = np.random.default_rng(7)
_A = _RANDOM.integers(1, 2**63, SYMBOLS, dtype=np.uint64) | np.uint64(1)
_B = _RANDOM.integers(1, 2**63, SYMBOLS, dtype=np.uint64)
_KEY = _RANDOM.integers(1, 2**63, (CHUNKS, WIDTH, WIDTH), dtype=np.uint64) | np.uint64(1)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles of every text, ascending, and the bounds of each text in them."""
    data = LOWER[data]
    starts, ends = words(data, offsets)
    value = Hasher(data).ranges(starts, ends)
    bounds = np.searchsorted(starts, offsets, "left")
    counts = np.diff(bounds)
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    text = np.repeat(np.arange(len(counts)), n)
    first = np.repeat(bounds[:-1], n) + np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    size = np.minimum(counts, width)[text]
    out = size.astype(np.uint64)
    for k in range(width):
        use = size > k
        out[use] = mix(out[use] + value[first[use] + k])
    order = np.lexsort((out, text))
    out, text = out[order], text[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (text[1:] != text[:-1])
    out, text = out[new], text[new]
    return out, np.searchsorted(text, np.arange(len(counts) + 1), "left")


def signatures(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of symbols per text; zeros for empty ones."""
    out = np.zeros((len(bounds) - 1, SYMBOLS), np.uint16)
    some = np.diff(bounds) > 0
    if some.any():
        at = bounds[:-1][some]
        for k in range(SYMBOLS):
            least = np.minimum.reduceat(values * _A[k] + _B[k], at)
            out[some, k] = (mix(least) >> np.uint64(48)).astype(np.uint16)
    return out


def bucket_keys(signature: np.ndarray) -> np.ndarray:
    """The CHUNKS * WIDTH bucket keys of each signature, chunk by chunk, one symbol left out in turn."""
    symbols = signature.reshape(-1, CHUNKS, WIDTH).astype(np.uint64) + np.uint64(1)
    keys = np.zeros((len(signature), CHUNKS, WIDTH), np.uint64)
    for left_out in range(WIDTH):
        total = np.zeros((len(signature), CHUNKS), np.uint64)
        for k in range(WIDTH):
            if k != left_out:
                total += mix(symbols[:, :, k] * _KEY[:, left_out, k])
        keys[:, :, left_out] = mix(total + np.arange(CHUNKS, dtype=np.uint64) * np.uint64(8 * 2654435761) + np.uint64(left_out))
    return keys.reshape(len(signature), -1)


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"),
                       _md5(text_col).alias("text_md5"))


def _md5(text_col: str) -> F.Column:
    """Tells rows of equal id apart."""
    return F.unhex(F.md5(F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))))


def describe(source: DataFrame, width: int) -> DataFrame:
    """doc_id, text_md5, n_shingles, two hashes of the shingle set, signature."""
    def run(batches):
        drop_held()
        for rows, data, offsets in blocks(batches, "text"):
            values, bounds = shingles(data, offsets, width)
            total = [np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)])
                     for x in (values, mix(values ^ np.uint64(0x5DEECE66D)))]
            one, two = ((t[bounds[1:]] - t[bounds[:-1]]).view(np.int64) for t in total)
            signature = [s.tobytes() for s in signatures(values, bounds)]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(2), pa.array(np.diff(bounds)), pa.array(one), pa.array(two),
                 pa.array(signature, pa.binary())],
                ["doc_id", "text_md5", "n_shingles", "set_1", "set_2", "signature"])

    return source.mapInArrow(run, "doc_id long, text_md5 binary, n_shingles long, set_1 long, set_2 long, signature binary")


def buckets(classes: DataFrame) -> DataFrame:
    """bucket and place (number of the key) for each class; the signature isn't taken along."""
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if n:
                signature = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(n, SYMBOLS)
                ids = np.repeat(batch.column(0).to_numpy(), SYMBOLS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket_keys(signature).view(np.int64).ravel()),
                     pa.array(np.tile(np.arange(SYMBOLS, dtype=np.int32), n)), pa.array(ids)],
                    ["bucket", "place", "doc_id"])

    return classes.select("doc_id", "signature").mapInArrow(run, "bucket long, place int, doc_id long")


def _groups(batches, keys: list[str]):
    """Tables of whole runs of rows with equal keys, from sorted rows as they come; and the edges of the runs."""
    def edges(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows + 1, bool)
        new[[0, -1]] = True
        for key in keys:
            value = table.column(key).to_numpy()
            new[1:-1] |= value[1:] != value[:-1]
        return np.flatnonzero(new)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held)
        cut = int(edges(table)[-2])  # the last run may go on
        if cut:
            yield (done := table.slice(0, cut)), edges(done)
            held = table.slice(cut).combine_chunks().to_batches()
    if held:
        yield (done := pa.Table.from_batches(held)), edges(done)


def _by_bucket(frame: DataFrame, work, columns: list[str]) -> DataFrame:
    """Calls ``work(bucket, place, docs, components, signatures)`` for each part of a bucket; returns its columns of longs."""
    def run(batches):
        for table, edge in _groups(batches, ["bucket", "part"]):
            bucket, place, doc, component = (table.column(c).to_numpy() for c in ("bucket", "place", "doc_id", "component"))
            raw = b"".join(table.column("signature").to_pylist())
            signature = np.frombuffer(raw, np.uint16).reshape(len(bucket), SYMBOLS)
            found = [work(int(bucket[a]), int(place[a]), doc[a:b], component[a:b], signature[a:b])
                     for a, b in zip(edge[:-1], edge[1:])]
            found = [f for f in found if f is not None and len(f[0])]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*found)], columns)

    taken = ["bucket", "part", "place", "doc_id", "component", "signature"]
    return (frame.select(*taken).repartition(partitions(frame.sparkSession), "bucket", "part")
            .sortWithinPartitions("bucket", "part", "doc_id")
            .mapInArrow(run, ", ".join(f"{c} long" for c in columns)))


def _in_blocks(entries: DataFrame) -> DataFrame:
    """Entries with the part (block) of their bucket; its smallest document is in all of them."""
    blocks_, block = _block()
    every = F.sequence(F.lit(0).cast("long"), blocks_ - 1)
    return entries.withColumn("part", F.explode(F.when(F.col("doc_id") == F.col("low"), every).otherwise(F.array(block))))


def _in_pairs(entries: DataFrame) -> DataFrame:
    """Entries with the parts (pairs of blocks) of their bucket that their block is in."""
    blocks_, block = _block()
    other = F.explode(F.sequence(F.lit(0).cast("long"), blocks_ - 1))
    dealt = entries.withColumn("blocks", blocks_).withColumn("block", block).withColumn("other", other)
    return dealt.withColumn("part", F.least("block", "other") * F.col("blocks") + F.greatest("block", "other"))


def _block() -> tuple[F.Column, F.Column]:
    """The number of blocks of a bucket of ``size`` documents, and a document's block."""
    blocks_ = F.ceil(F.col("size") / F.lit(BLOCK)).cast("long")
    return blocks_, F.pmod(F.xxhash64("doc_id"), blocks_)


def _nearest(bucket: int, place: int, doc: np.ndarray, component: np.ndarray, signature: np.ndarray):
    """Each document with its nearest partner (a, b, distance)."""
    n = len(doc)
    if n < 2:
        return None
    hubs = np.arange(n) if n <= ALL_PAIRS else np.unique(np.linspace(0, n - 1, HUBS).astype(np.int64))
    best, partner = np.full(n, SYMBOLS + 1, np.int32), np.zeros(n, np.int64)
    for h in hubs.tolist():
        distance = (signature != signature[h]).sum(1).astype(np.int32)
        distance[h] = SYMBOLS + 1
        better = distance < best
        best[better], partner[better] = distance[better], doc[h]
    near = best <= REACH
    return doc[near], partner[near], best[near]


def _across(bucket: int, place: int, doc: np.ndarray, component: np.ndarray, signature: np.ndarray):
    """Documents with a pair across components whose first shared bucket this is (bucket, doc_id, component)."""
    names, index, counts = np.unique(component, return_inverse=True, return_counts=True)
    if len(names) < 2:
        return None
    chunk, left_out = divmod(place, WIDTH)
    involved = np.zeros(len(doc), bool)
    for x in np.flatnonzero(index != np.argmax(counts)).tolist():  # a pair has a document outside the main component
        differ = signature != signature[x]
        y = np.flatnonzero((differ.sum(1) <= REACH) & (index != index[x]))
        if not len(y):
            continue
        errors = differ[y].reshape(len(y), CHUNKS, WIDTH)
        first = np.argmax(errors.sum(2) <= 1, axis=1)
        wrong = errors[np.arange(len(y)), first]
        # the first bucket that both are in leaves out the wrong symbol, or the first one if none is wrong
        mine = y[(first == chunk) & (np.where(wrong.any(1), wrong.argmax(1), 0) == left_out)]
        involved[mine] = True
        involved[x] |= len(mine) > 0
    return np.full(int(involved.sum()), bucket), doc[involved], component[involved]


def joining_links(doc: np.ndarray, component: np.ndarray, values: np.ndarray, bounds: np.ndarray, share: int) -> list[tuple[int, int]]:
    """Links between documents of different components, by exact counts of shared shingles; no more than join them."""
    n, size = len(doc), np.diff(bounds)
    owner = np.repeat(np.arange(n), size)
    _, value = np.unique(values, return_inverse=True)
    order = np.argsort(value, kind="stable")
    posted = owner[order]
    at = np.concatenate([[0], np.cumsum(np.bincount(value))])
    _, label = np.unique(component, return_inverse=True)
    found = []
    main = np.argmax(np.bincount(label))
    for x in np.flatnonzero(label != main).tolist():
        own = value[bounds[x]:bounds[x + 1]]
        both = np.bincount(pick(posted, at[own], at[own + 1] - at[own]), minlength=n)
        linked = np.flatnonzero((100 * both >= share * (size + size[x] - both)) & (label != label[x]))
        for y in linked.tolist():
            if label[y] != label[x]:
                found.append((int(doc[x]), int(doc[y])))
                label[label == label[y]] = label[x]
    return found


def links_across(involved: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Links (a, b) between components among the documents of each bucket."""
    in_bucket = Window.partitionBy("bucket")
    block = F.floor((F.row_number().over(in_bucket.orderBy("doc_id")) - 1) / BLOCK).cast("int")
    blocks_ = involved.withColumn("block", block).withColumn("last", F.max("block").over(in_bucket))
    partners = F.explode(F.sequence(F.lit(0), F.col("last")))
    dealt = blocks_.withColumn("other", partners).select(
        "bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "doc_id", "component")
    keys = ["bucket", "low", "high"]

    def run(batches):
        for table, edge in _groups(batches, keys):
            doc, component = (table.column(c).to_numpy() for c in ("doc_id", "component"))
            shingle = table.column("shingles").combine_chunks()
            flat = shingle.flatten().to_numpy()
            bounds = np.concatenate([[0], np.cumsum(shingle.value_lengths().to_numpy())])
            found = []
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                found += joining_links(doc[a:b], component[a:b], flat[bounds[a]:bounds[b]], bounds[a:b + 1] - bounds[a], share)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])

    return (dealt.join(sets, "doc_id").select(*keys, "doc_id", "component", "shingles")
            .repartition(partitions(sets.sparkSession), *keys).sortWithinPartitions(*keys, "doc_id")
            .mapInArrow(run, "a long, b long"))


def confirm(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Those pairs (a, b) whose full sets have 100 * intersection >= share * union."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - both
    return pairs.select("a", "b").join(left, "a").join(right, "b").filter(100 * both >= share * union).select("a", "b")


def shingle_sets(source: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """doc_id and full shingle set (array of hashes) of the wanted ids; one of rows that share an id and a set."""
    def run(batches):
        for rows, data, offsets in blocks(batches, "text"):
            values, bounds = shingles(data, offsets, width)
            total = np.concatenate([[np.uint64(0)], np.cumsum(values, dtype=np.uint64)])
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64)),
                 pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values.view(np.int64)))],
                ["doc_id", "set_1", "shingles"])

    made = source.join(wanted, "doc_id", "left_semi").mapInArrow(run, "doc_id long, set_1 long, shingles array<long>")
    return made.join(wanted, ["doc_id", "set_1"], "left_semi").select("doc_id", "shingles")


def components(links: DataFrame) -> DataFrame:
    """doc_id and component (smallest reachable id) of all ids in links (a, b); minima spread, then labels jump."""
    both = keep(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
                .distinct(), "links")
    label = keep(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = (both.join(label.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near")))
        spread = label.join(near, "a").select("a", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = label.select(F.col("a").alias("label"), F.col("label").alias("next"))
        new = keep(spread.join(jump, "label").select("a", "old", F.least("label", "next").alias("label")), "labels")
        if new.filter("old != label").isEmpty():
            return label.select(F.col("a").alias("doc_id"), F.col("label").alias("component"))
        label = new.select("a", "label")


def near_duplicates(docs: DataFrame, width: int = 5, share: int = 80, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest id reachable by links), kept, class_id (its equal sets)."""
    return _near_duplicates(docs, width, share, id_col, text_col).drop("text_md5")


def _near_duplicates(docs: DataFrame, width: int, share: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    source = _source(docs, id_col, text_col)
    described = keep(describe(source, width), "signatures")
    same = ["set_1", "set_2", "n_shingles"]
    classes = keep(described.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*same)
                   .agg(F.min("doc_id").alias("doc_id"), F.min("signature").alias("signature")), "classes")
    shared = buckets(classes)
    several = shared.groupBy("bucket").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("size")).filter("low < high")
    entries = keep(shared.join(several.drop("high"), "bucket"), "buckets")
    free_shuffles(spark)
    signature = classes.select("doc_id", "signature")
    named = _by_bucket(_in_blocks(entries).withColumn("component", F.col("doc_id")).join(signature, "doc_id"), _nearest,
                       ["a", "b", "distance"])
    best = named.groupBy("a").agg(F.min(F.struct("distance", "b")).alias("best")).select("a", F.col("best.b").alias("b"))
    pairs = keep(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    wanted = classes.join(entries.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "set_1")
    sets = keep(shingle_sets(source, wanted, width), "sets")
    free_shuffles(spark)
    links = keep(confirm(pairs, sets, share), "links")
    found = components(links)
    labelled = entries.join(found, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    open_ = labelled.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    involved = keep(_by_bucket(_in_pairs(labelled.join(open_, "bucket", "left_semi")).join(signature, "doc_id"), _across,
                               ["bucket", "doc_id", "component"]).distinct(), "involved")
    free_shuffles(spark)
    more = keep(links_across(involved, sets, share), "links")
    if not more.isEmpty():
        found = components(links.unionByName(more))
    label = classes.join(found, "doc_id", "left").select(
        *same, F.col("doc_id").alias("class_id"), F.coalesce("component", "doc_id").alias("component_id"))
    return _labelled(described, label, same)


def _labelled(described: DataFrame, label: DataFrame, same: list[str]) -> DataFrame:
    """Components of all rows; rows of one class may be very many, so a class is looked up in SALTS copies of itself."""
    salts = 16
    linked = described.filter("n_shingles > 0 AND doc_id IS NOT NULL").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    copies = label.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    alone = described.filter("n_shingles = 0 OR doc_id IS NULL").select(
        "doc_id", "text_md5", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"),
        F.col("doc_id").alias("class_id"))
    return linked.join(copies, [*same, "salt"]).select(
        "doc_id", "text_md5", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"), "class_id") \
        .unionByName(alone)


def keep_first(docs: DataFrame, width: int = 5, share: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that ``near_duplicates`` keeps, with all their columns; rows of one id may differ in that by their texts."""
    name, text = spare_name(docs, "dropped_id"), spare_name(docs, "dropped_text")
    dropped = (_near_duplicates(docs, width, share, id_col, text_col).filter("NOT kept")
               .select(F.col("doc_id").alias(name), F.col("text_md5").alias(text)).distinct())
    return docs.join(dropped, (F.col(id_col).cast("long") == F.col(name)) & (_md5(text_col) == F.col(text)), "left_anti")
