"""Prefix trie of conversations, with subtree totals rolled up by centroid decomposition.

A node is a sequence of turns that some conversation starts with. The smallest of these conversations and the number of
turns name it: at one depth a conversation passes through one node only. A *path table* has, for every conversation and
depth, the names of its node and of the node above; it answers "is u above v?" by one look-up, however deep the trie is.

Subtree totals need no walk from level to level. The parent edges are a forest of one component at first. In every round
each component finds its centroid (the deepest node with more than half of the component's weight below it), the totals
of the part below are summed up and added to all nodes from the centroid to the component's top, and the component falls
apart into the part above and one part per child, none larger than half. So rounds grow with the logarithm of the size,
also for a chain of a million turns, and each round is a few joins and aggregations over all components at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemill.llm.runtime import discard, free_shuffles, keep, partitions
from telemill.operators.ordered import FIRST, Order, running_totals

PIECE = 16_384  # conversation ids joined to one text at most, before texts are hashed one after the other
FREE_AFTER = 3  # rounds, before the driver and the disk are relieved of what finished ones have left: broadcasts, plans, shuffles
_SUMS = [f"_sum{i}" for i in range(4)]


@dataclass(frozen=True)
class TurnOrder(Order):
    """Turns by number, nulls first."""

    @property
    def at(self) -> Column:
        return F.coalesce(F.col(self.ts).cast("bigint"), F.lit(FIRST + 1))


def rebuild(turns: DataFrame, family: int = 100, modulus: int = 6, id_col: str = "conv_id", turn_col: str = "turn",
            role_col: str = "role", text_col: str = "text", max_rows: int = 100_000) -> DataFrame:
    """Conversations that start like the first of their family: rows conv_id, depth, turn (digest), n_chars, n_turns.

    Conversation c gets the first h turns of conversation c - c % family (all it has, none if it is absent), then its own
    turns after its first h, with h = crc32(decimal c) % modulus. Every conversation has a row of depth 0, so turnless
    ones are there too. Only digests of turns are shuffled, and a conversation with a large share of all rows is numbered
    in slices of ``max_rows``.

    Turns are ordered by number (null first), equal ones by role and then by digest; null roles and texts are empty;
    repeated rows are turns of their own; rows without a conversation id are left out; further columns are not looked at.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = keep(turns.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("conv_id"), F.col(turn_col).cast("bigint").alias("number"),
        F.concat(role, F.lit("\n"), digest).alias("seq"), F.length(text).cast("bigint").alias("n_chars")), "trie-turns")
    numbered = running_totals(rows, TurnOrder(("conv_id",), "number", "seq", max_rows), {"pos": F.lit(1)})
    numbered = numbered.select("conv_id", "pos", F.unhex(F.right("seq", F.lit(64))).alias("turn"), "n_chars")
    sizes = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("size"))
    convs = sizes.withColumns({"skip": F.crc32(F.col("conv_id").cast("string").cast("binary")) % modulus,
                               "base": F.col("conv_id") - F.col("conv_id") % family})
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("size").alias("there"))
    convs = convs.join(bases, "base", "left").withColumn("lead", F.least("skip", F.coalesce("there", F.lit(0))))
    convs = convs.select("conv_id", "base", "skip", "lead",
                         (F.col("lead") + F.greatest(F.lit(0), F.col("size") - F.col("skip"))).alias("n_turns"))
    own = numbered.join(convs, "conv_id").where("pos > skip").select(
        "conv_id", (F.col("pos") - F.col("skip") + F.col("lead")).alias("depth"), "turn", "n_chars", "n_turns")
    starts = numbered.where((F.col("conv_id") % family == 0) & (F.col("pos") < modulus)).select(
        F.col("conv_id").alias("base"), F.col("pos").alias("depth"), "turn", "n_chars")
    led = starts.join(convs, "base").where("depth <= lead").select("conv_id", "depth", "turn", "n_chars", "n_turns")
    none = convs.select("conv_id", F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("binary").alias("turn"),
                        F.lit(0).cast("bigint").alias("n_chars"), "n_turns")
    return own.unionByName(led).unionByName(none)


def _paths(rebuilt: DataFrame, max_rows: int) -> tuple[DataFrame, DataFrame]:
    """The path table (conv_id, depth, node, above, last) and the nodes (conv_id, depth, above, n_convs, n_chars).

    A prefix is told by four running sums of 32-bit hashes of (depth, turn digest), 128 bits in all: a conversation needs
    no chain of hashes, and a long one can be summed in slices.
    """
    parts = {name: F.when(F.col("depth") > 0, F.xxhash64("turn", "depth", F.lit(i)).bitwiseAND(F.lit(0xFFFFFFFF)))
             .otherwise(0) for i, name in enumerate(_SUMS)}
    summed = running_totals(keep(rebuilt, "trie-rebuilt").select("*", *[c.alias(f"{n}_own") for n, c in parts.items()]),
                            TurnOrder(("conv_id",), "depth", "depth", max_rows), {n: F.col(f"{n}_own") for n in _SUMS})
    before = F.md5(F.concat_ws(" ", F.col("depth") - 1, *[F.col(n) - F.col(f"{n}_own") for n in _SUMS]).cast("binary"))
    rows = keep(summed.select(
        "conv_id", "depth", "n_chars", (F.col("depth") == F.col("n_turns")).alias("last"),
        F.unhex(F.md5(F.concat_ws(" ", "depth", *_SUMS).cast("binary"))).alias("prefix"),
        F.unhex(before).alias("before")), "trie-prefixes")
    found = keep(rows.groupBy("depth", "prefix").agg(
        F.min("conv_id").alias("node"), F.count(F.lit(1)).alias("n_convs"), F.min("n_chars").alias("n_chars"),
        F.min("before").alias("before")), "trie-found")
    root = found.where("depth = 0").select("node").scalar()  # most first turns differ: their look-up would be one hot key
    uppers = found.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("before"), F.col("node").alias("above"))
    low, deep = found.where("depth <= 1"), found.where("depth > 1")
    named = low.withColumn("above", F.when(F.col("depth") == 1, root)).unionByName(deep.join(uppers, ["depth", "before"]))
    named = keep(named.select("depth", "prefix", "node", "above", "n_convs", "n_chars"), "trie-named")
    top = rows.where("depth = 0").select("conv_id", "depth", root.alias("node"), F.lit(None).cast("bigint").alias("above"), "last")
    deeper = rows.where("depth > 0").join(named.select("depth", "prefix", "node", "above"), ["depth", "prefix"])
    paths = keep(deeper.select("conv_id", "depth", "node", "above", "last").unionByName(top), "trie-paths")
    discard(rows)
    discard(found)
    return paths, named.select(F.col("node").alias("conv_id"), "depth", "above", "n_convs", "n_chars")


def _split(forest: DataFrame, paths: DataFrame) -> DataFrame:
    """One round: every node with its component's centroid and its place towards it.

    ``place``: 'centroid', 'path' (above it), 'below' or 'beside'. ``part``: of a node below, the child of the centroid
    that it belongs to.
    """
    heaviest = forest.groupBy("top", "top_depth", "depth").agg(F.max(F.struct("weight", "conv_id")).alias("most"))
    total = F.first("most.weight").over(Window.partitionBy("top", "top_depth").orderBy("depth"))  # of a row per depth
    centroids = (heaviest.withColumn("total", total).where("2 * most.weight > total")
                 .groupBy("top", "top_depth").agg(F.max(F.struct(
                     F.col("depth").alias("depth"), F.col("most.conv_id").alias("conv_id"),
                     F.col("most.weight").alias("weight"))).alias("centroid")))
    rows = forest.join(centroids, ["top", "top_depth"])
    under = F.col("depth") > F.col("centroid.depth")
    rows = rows.withColumns({
        "at_conv": F.when(under, F.col("conv_id")).otherwise(F.col("centroid.conv_id")),
        "at_depth": F.when(under, F.col("centroid.depth") + 1).otherwise(F.col("depth"))})
    look_up = paths.select(F.col("conv_id").alias("at_conv"), F.col("depth").alias("at_depth"), "node", "above")
    place = (F.when(under & (F.col("above") == F.col("centroid.conv_id")), "below").when(under, "beside")
             .when(F.col("node") != F.col("conv_id"), "beside").when(F.col("depth") < F.col("centroid.depth"), "path")
             .otherwise("centroid"))
    return rows.join(look_up, ["at_conv", "at_depth"]).select(
        *forest.columns, F.col("centroid.depth").alias("cut_depth"), F.col("centroid.weight").alias("cut_weight"),
        place.alias("place"), F.col("node").alias("part"))


def subtree_totals(nodes: DataFrame, paths: DataFrame, values: list[str]) -> DataFrame:
    """Sums of ``values`` over the subtree of every node, itself included: conv_id, depth and the sums under their names.

    ``nodes`` has conv_id, depth, n_convs and the values; weights are conversations, so a subtree's weight at the start is
    the number of (conversation, depth) rows in it, which one aggregation of ``paths`` gives.
    """
    weights = paths.join(paths.where("last").select("conv_id", F.col("depth").alias("n_turns")), "conv_id").groupBy(
        F.col("node").alias("conv_id"), "depth").agg(F.sum(F.col("n_turns") - F.col("depth") + 1).alias("weight"))
    top = nodes.where("depth = 0").select("conv_id").scalar()
    forest = nodes.join(weights, ["conv_id", "depth"]).select(
        "conv_id", "depth", "weight", top.alias("top"), F.lit(0).cast("bigint").alias("top_depth"), *values,
        *[F.lit(0).cast("bigint").alias(f"{v}_cut") for v in values])
    columns, done, last = forest.columns, [], None
    while True:
        if len(done) % FREE_AFTER == 0:
            free_shuffles(nodes.sparkSession)
        split = keep(_split(forest, paths), "trie-round")
        if last is not None:
            discard(last)
        last = split

        def of_centroid(name: str) -> Column:
            return F.max(F.when(F.col("place") == "centroid", F.col(name)))

        sums = keep(split.where("place IN ('centroid', 'below')").groupBy("top", "top_depth").agg(
            of_centroid("conv_id").alias("conv_id"), of_centroid("depth").alias("depth"),
            *[F.sum(v).alias(f"{v}_sum") for v in values],
            *[(F.sum(v) + of_centroid(f"{v}_cut")).alias(v) for v in values]), "trie-done")
        done.append(sums)
        if split.where("place <> 'centroid'").isEmpty():
            break
        above = split.where("place = 'path'").join(
            sums.select("top", "top_depth", *[f"{v}_sum" for v in values]), ["top", "top_depth"]).withColumns(
            {"weight": F.col("weight") - F.col("cut_weight"), **{f"{v}_cut": F.col(f"{v}_cut") + F.col(f"{v}_sum") for v in values}})
        below = split.where("place = 'below'").withColumns({"top": F.col("part"), "top_depth": F.col("cut_depth") + 1})
        forest = (split.where("place = 'beside'").select(columns).unionByName(below.select(columns))
                  .unionByName(above.select(columns)))
    discard(last)
    return nodes.sparkSession.read.schema(done[0].schema).parquet(*[part.kept_at for part in done]).select(
        "conv_id", "depth", *values)


def _ends_digests(ends: DataFrame) -> DataFrame:
    """Per node the SHA-256 of the ids that end there, in numerical order, joined by commas.

    Ids are joined to pieces by range first, in parallel; one node's pieces are then hashed as a stream.
    """
    number = F.floor(F.col("id") / PIECE)
    pieces = ends.groupBy("conv_id", "depth", number.alias("piece")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda i: i.cast("string")), ",").alias("ids"))
    placed = pieces.repartition(partitions(ends.sparkSession), "conv_id", "depth").sortWithinPartitions("conv_id", "depth", "piece")

    def run(batches):
        import hashlib

        node, digest = None, None

        def row():
            return pa.RecordBatch.from_pydict({"conv_id": pa.array([node[0]], pa.int64()), "depth": pa.array([node[1]], pa.int64()),
                                               "ends_sha256": [digest.hexdigest()]})

        for batch in batches:
            for conv, depth, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
                if node == (conv, depth):
                    digest.update(b",")
                else:
                    if node:
                        yield row()
                    node, digest = (conv, depth), hashlib.sha256()
                digest.update(ids.encode())
        if node:
            yield row()

    return placed.mapInArrow(run, "conv_id long, depth long, ends_sha256 string")


def prefix_trie(rebuilt: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """One row per node of the trie over conversations as ``rebuild`` returns them; no conversations give no nodes.

    conv_id (smallest member), depth, parent_conv_id (root: null), n_convs (members), n_children, n_leaves (childless nodes
    in the subtree), saved_tokens (over the subtree: characters of the node's last turn times members beyond the first),
    ends_sha256 (of the ids of members that end here).
    """
    paths, nodes = _paths(rebuilt, max_rows)
    children = nodes.where("depth > 0").groupBy(F.col("above").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(
        F.count(F.lit(1)).alias("n_children"))
    nodes = keep(nodes.join(children, ["conv_id", "depth"], "left").withColumns({
        "n_children": F.coalesce("n_children", F.lit(0)),
        "n_leaves": F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("bigint"),
        "saved_tokens": (F.col("n_convs") - 1) * F.col("n_chars")}), "trie-nodes")
    if nodes.isEmpty():
        totals = nodes.select("conv_id", "depth", "n_leaves", "saved_tokens")
    else:
        totals = subtree_totals(nodes, paths, ["n_leaves", "saved_tokens"])
    ends = _ends_digests(paths.where("last").select(F.col("node").alias("conv_id"), "depth", F.col("conv_id").alias("id")))
    return (nodes.drop("n_leaves", "saved_tokens").join(totals, ["conv_id", "depth"]).join(ends, ["conv_id", "depth"], "left")
            .select("conv_id", "depth", F.col("above").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")))
