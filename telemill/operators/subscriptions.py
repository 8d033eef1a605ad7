"""Messages matched to topic filters.

Filters are the paths of a trie: a node is what filters begin with, an edge is a literal level or ``+``. A topic walks the
trie level by level. Its frontier of nodes is joined with the nodes one level deeper, by equality of paths: a literal child
by the topic's own level, the ``+`` child where the node is marked to have one. A filter that ends in ``#`` is found at its
parent node. So a topic's cost follows its depth and the filters that it falls under, not their number or their kinds.

With many filters not topics but their distinct beginnings walk, each with the list of nodes that it falls under. A list
goes one level down by one join of its nodes with their children and one of the beginning with the longer ones. Topics
that share a beginning share that work, and what is shuffled is a row per beginning and node, not one per topic and filter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.functions.topics import topic_matches
from telemill.session import scratch_path

SEPARATOR = "/"
SMALL = 50_000  # filters up to this many are sent to every task, with at most so many nodes a level each
OPEN, EXACT, GOES_ON = 1, 2, 4  # what a node is: the parent of a #, a filter, the parent of other nodes
WIDE = 64  # children of a node up to this many go with it as a list, more are looked up one by one


def filter_table(spark, filters: list[str]) -> DataFrame:
    """A list of filters as a one-column table."""
    return spark.range(1).select(F.explode(F.array(*[F.lit(f) for f in filters])).alias("filter"))


def _levels(text: Column) -> Column:
    return F.split(text, SEPARATOR)


def _beginning(text: Column, at: Column) -> Column:
    """The first levels as a path; that of no levels is empty."""
    return F.when(at == 0, "").otherwise(F.concat(F.lit(SEPARATOR), F.call_function("substring_index", text, F.lit(SEPARATOR), at)))


def filter_nodes(filters: DataFrame) -> DataFrame:
    """The trie: a row per node with its path and whether it has a ``+`` child, a filter of its own, a ``#`` filter.

    The root's path is empty, a child's is its parent's, a slash and the level. ``#`` is a wildcard as the last level only.
    """
    text, at = F.col("filter"), F.col("_at")
    paths = (filters.select("filter").distinct().where(text.isNotNull())
             .select("filter", ((text == "#") | F.endswith(text, F.lit("/#"))).alias("_open"))
             .select("*", (F.size(_levels(text)) - F.col("_open").cast("int")).alias("_size"))
             .select("*", F.explode(F.sequence(F.lit(0), "_size")).alias("_at")))
    at_end, step = at == F.col("_size"), F.substring_index(_beginning(text, at + 1), SEPARATOR, -1)
    return paths.groupBy(_beginning(text, at).alias("path")).agg(
        F.bool_or(~at_end & (step == "+")).alias("has_plus"),
        F.bool_or(at_end & ~F.col("_open")).alias("is_filter"), F.bool_or(at_end & F.col("_open")).alias("has_rest"))


def _walk(rows: DataFrame, topic: str, nodes: DataFrame, depth: int) -> DataFrame:
    """Rows and the filters they fall under, by one join a level. A filter that is found waits under a key no node has."""
    columns, found = rows.columns, F.concat(F.lit("#"), F.col(topic))
    path, text = F.col("path"), F.col(topic)
    now = rows.where(text.isNotNull()).select(
        *columns, _levels(text).alias("_levels"), F.substring(text, 1, 0).alias("_key"),  # no literal: joins are by equality
        F.lit(None).cast("string").alias("filter"))
    for at in range(depth + 1):
        level, more = F.get("_levels", F.lit(at)), F.size("_levels") > at
        wild = ~F.startswith(text, F.lit("$")) if at == 0 else F.lit(True)

        def ends(condition: Column, name: Column) -> Column:
            return F.when(condition, F.struct(name.alias("filter"), found.alias("_key")))

        def goes_on(condition: Column, step: Column) -> Column:
            return F.when(condition, F.struct(F.lit(None).cast("string").alias("filter"),
                                              F.concat(path, F.lit(SEPARATOR), step).alias("_key")))

        named = F.substring(path, 2, 1 << 30)
        next_ = F.array_compact(F.array(
            ends(F.col("filter").isNotNull(), F.col("filter")),
            ends(F.col("has_rest") & wild, F.substring(F.concat(path, F.lit("/#")), 2, 1 << 30)),
            ends(F.col("is_filter") & ~more, named),
            goes_on(path.isNotNull() & more & (level != "+"), level),
            goes_on(F.col("has_plus") & more & wild, F.lit("+"))))
        now = (now.join(nodes, F.col("_key") == path, "left").where(path.isNotNull() | F.col("filter").isNotNull())
               .select(*columns, "_levels", F.explode(next_).alias("_next"))
               .select(*columns, "_levels", "_next._key", "_next.filter"))
    return now.where(F.col("filter").isNotNull()).select(*columns, "filter")


def _stored(frame: DataFrame, name: str) -> DataFrame:
    """A frame that several levels read, written once to the shared folder."""
    path = scratch_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def _named(path: Column) -> Column:
    return F.substring(path, 2, 1 << 30)


def _texts(found: Column) -> list[Column]:
    """Of nodes with their kinds: the paths that go on, the filters that end in ``#``, the filters that end here."""
    def of(kind: int, text) -> Column:
        return F.transform(F.filter(found, lambda n: n["kind"].bitwiseAND(F.lit(kind)) != 0), lambda n: text(n["path"]))

    return [of(GOES_ON, lambda path: path).alias("paths"),
            of(OPEN, lambda path: _named(F.concat(path, F.lit("/#")))).alias("open"), of(EXACT, _named).alias("exact")]


def _joined(rows: DataFrame) -> DataFrame:
    return rows.groupBy("prefix").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("paths", "open", "exact")])


def _down(now: DataFrame, longer: DataFrame, nodes: DataFrame, wild: Column, some_wide: bool) -> DataFrame:
    """Beginnings of one more level and what they fall under; ``nodes`` are of the lower level."""
    each = now.select("prefix", F.explode("paths").alias("parent"))
    children = nodes.where(~F.col("wide") | (F.col("level") == "+")).groupBy("parent").agg(
        F.map_from_entries(F.collect_list(F.struct("level", "kind"))).alias("children"))
    parts = int(now.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much to do: not to be put together
    under = each.join(children, "parent").repartition(parts, "prefix").groupBy("prefix").agg(
        F.collect_list(F.struct("parent", "children")).alias("under"))

    def step(level: Column) -> Column:
        return F.transform(F.filter("under", lambda u: u["children"][level].isNotNull()), lambda u: F.struct(
            F.concat(u["parent"], F.lit(SEPARATOR), level).alias("path"), u["children"][level].alias("kind")))

    plus = under.select("prefix", "under", step(F.lit("+")).alias("plus")).select(  # the same for all that begin so
        F.col("prefix").alias("above"), "under", F.struct(*_texts(F.col("plus"))).alias("plus"))
    own = longer.join(plus, "above").select(
        "longer", "plus", F.when(F.col("step") != "+", step(F.col("step"))).otherwise(F.array()).alias("own"), wild.alias("wild"))
    found = own.select(F.col("longer").alias("prefix"), "plus", F.struct(*_texts(F.col("own"))).alias("own"), "wild").select("prefix", *[
        F.when(F.col("wild"), F.concat(f"plus.{c}", f"own.{c}")).otherwise(F.col(f"own.{c}")).alias(c)
        for c in ("paths", "open", "exact")])
    if some_wide:
        one_by_one = nodes.where(F.col("wide") & (F.col("level") != "+"))
        of_wide = each.join(one_by_one.select("parent").distinct(), "parent", "left_semi")
        looked_up = (of_wide.join(longer, F.col("above") == F.col("prefix")).select("parent", F.col("step").alias("level"), "longer")
                     .join(one_by_one, ["parent", "level"]).groupBy(F.col("longer").alias("prefix"))
                     .agg(F.collect_list(F.struct("path", "kind")).alias("own")).select("prefix", *_texts(F.col("own"))))
        found = _joined(found.unionByName(looked_up))
    return found


def _lists(topics: DataFrame, topic: str, filters: DataFrame) -> DataFrame:
    """Distinct topics with the list of filters they fall under, ``filters``; those under none are left out."""
    level = F.substring_index("path", SEPARATOR, -1)
    nodes = filter_nodes(filters).select(
        "path", (F.size(_levels(F.col("path"))) - 1).alias("at"), level.alias("level"), F.when(
            F.col("path") != "", F.left("path", F.length("path") - F.length(level) - 1)).alias("parent"),
        (F.when(F.col("has_rest"), OPEN).otherwise(0) + F.when(F.col("is_filter"), EXACT).otherwise(0)).alias("kind"))
    nodes = _stored(nodes, "filter-nodes")
    families = nodes.where("parent IS NOT NULL").groupBy("parent").agg((F.count("*") > WIDE).alias("wide"))
    above = families.select(F.col("parent").alias("path"), F.lit(GOES_ON).alias("more"))
    nodes = _stored(nodes.join(families, "parent", "left").join(above, "path", "left").select(
        "parent", "level", "path", "at", (F.col("kind") + F.coalesce("more", F.lit(0))).alias("kind"),
        F.coalesce("wide", F.lit(False)).alias("wide")), "filter-children")
    some_wide = dict(nodes.groupBy("at").agg(F.bool_or(F.col("wide") & (F.col("level") != "+"))).collect())
    depth = max(some_wide, default=0)
    topics = _stored(topics.select(F.col(topic).alias("topic")).where("topic IS NOT NULL").distinct(), "filter-topics")
    split = topics.select("topic", F.size(_levels(F.col("topic"))).alias("size"))
    now = nodes.where("at = 0").groupBy(F.col("path").alias("prefix")).agg(
        F.collect_list(F.struct("path", "kind")).alias("found")).select("prefix", *_texts(F.col("found")))
    lists = now
    for at in range(1, depth + 1):
        beginning, above = (_beginning(F.col("topic"), F.lit(i)) for i in (at, at - 1))
        longer = split.where(F.col("size") >= at).select(beginning.alias("longer"), above.alias("above"), F.substring_index(
            beginning, SEPARATOR, -1).alias("step")).distinct()
        wild = ~F.startswith(F.col("step"), F.lit("$")) if at == 1 else F.lit(True)
        now = _down(now, longer, nodes.where(F.col("at") == at), wild, some_wide[at])
        now = now if at == depth else _stored(now, "filter-walk")
        lists = lists.unionByName(now)
    first = F.when(F.startswith("topic", F.lit("$")), 1).otherwise(0)  # no wildcard at the first level
    last = F.least("size", F.lit(depth))
    places = split.where(first <= last).select("topic", "size", F.explode(F.sequence(first, last)).alias("at")).select(
        "topic", _beginning(F.col("topic"), F.col("at")).alias("prefix"), (F.col("at") == F.col("size")).alias("whole"))
    found = places.join(lists.drop("paths"), "prefix").select(
        "topic", F.when(F.col("whole"), F.concat("open", "exact")).otherwise(F.col("open")).alias("filters"))
    return found.groupBy(F.col("topic").alias(topic)).agg(
        F.flatten(F.collect_list("filters")).alias("filters")).where(F.size("filters") > 0)


def match_subscriptions(messages: DataFrame, filters: DataFrame, topic: str = "topic", listed: bool = False) -> DataFrame:
    """One row per (message, filter it falls under); ``filters`` has a column ``filter``.

    Few filters are sent to every task, and messages walk the trie without a shuffle. With more than ``SMALL`` filters the
    beginnings of the distinct topics walk, and messages are joined with their topic's list of filters at the end.
    ``listed`` keeps that form: one row per message that falls under any filter, with the list ``filters``. A list is one
    value: the filters of one topic fit into a task's memory.
    """
    if not listed:
        sizes = filters.agg(F.count("*").alias("n"), F.max(F.size(_levels(F.col("filter")))).alias("depth")).first()
        if sizes["n"] <= SMALL:
            return _walk(messages, topic, F.broadcast(filter_nodes(filters)), sizes["depth"] or 0)
    found = messages.join(_lists(messages, topic, filters), topic)
    if listed:
        return found.select(*messages.columns, "filters")
    return found.select(*messages.columns, F.explode("filters").alias("filter"))


def subscribed(messages: DataFrame, filters: list[str], topic: str = "topic") -> DataFrame:
    """Messages that fall under at least one filter, each once."""
    return messages.where(reduce(lambda a, b: a | b, [topic_matches(F.col(topic), f) for f in filters]))
