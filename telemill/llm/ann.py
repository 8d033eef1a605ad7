"""Approximate nearest neighbours: a forest of random-projection trees, one priority queue, exact reranking.

The split planes of all trees are fitted on a sample that grows with the table, as far as it fits the driver; every vector
is then indexed, by the leaf it falls into in each tree. A query walks all trees through one shared priority queue, always
on to the branch whose plane it is nearest to, until the leaves reached hold ``visit`` vectors by the sample's count.
Distances to all vectors in these leaves are exact, in double precision. Equal vectors are indexed once, with the smallest
of their ids.

How many vectors have to be looked at depends on the table's size and structure. It is measured: MEASURED of the queries are
compared with all vectors, and ``visit`` is what reaches the share RECALL of their true neighbours through the forest. On a
table with no more entries than SEARCH every leaf is reached, so the result is exact there.

Defined cases: vectors that are null, zero, hold nulls or non-finite numbers, or differ in dimension from the most
frequent one, take no part, nor do rows of null id; repeated ids are rows of their own, and a query never finds its own
id; fewer candidates than neighbours give all of them; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import dataclasses
import heapq
from collections.abc import Iterator
from itertools import takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemill.llm.runtime import keep, partitions, ship

SAMPLE, SAMPLED = 20_000, 0.4  # vectors that the planes are fitted on: so many at least, else this share of all
SAMPLE_VALUES = 16_000_000  # numbers in a sample of more than SAMPLE vectors, at most
TREES, LEAF = 12, 32  # LEAF: sampled vectors per leaf
SEARCH = 40_000  # vectors, over all trees, whose leaves a query looks at, at least
RECALL, MEASURED = 0.98, 128  # share of the true neighbours of so many queries that has to be reached


@dataclasses.dataclass
class Forest:
    """Complete binary trees; node k has the children 2k + 1 and 2k + 2, the last level are leaves."""
    planes: np.ndarray  # tree, node, dimension
    offsets: np.ndarray  # tree, node
    depth: int
    counts: np.ndarray  # tree, leaf: sampled vectors
    scale: float  # vectors per sampled vector

    @classmethod
    def fit(cls, sample: np.ndarray, total: int, trees: int, leaf: int, seed: int = 11) -> Forest:
        random = np.random.default_rng(seed)
        n, dimension = sample.shape
        depth = max(0, int(np.ceil(np.log2(max(n, 1) / leaf))))
        nodes = (1 << depth) - 1
        planes, offsets = np.zeros((trees, nodes, dimension)), np.zeros((trees, nodes))
        counts = np.zeros((trees, 1 << depth), np.int64)
        for t in range(trees):
            members = {0: np.arange(n)}
            for k in range(nodes):
                own = members.pop(k)
                plane = random.standard_normal(dimension)
                if len(own) > 1:
                    a, b = random.choice(own, 2, replace=False)
                    if (sample[a] != sample[b]).any():
                        plane = sample[a] - sample[b]
                plane /= np.linalg.norm(plane)
                side = sample[own] @ plane
                offset = float(np.median(side)) if len(own) else 0.0
                planes[t, k], offsets[t, k] = plane, offset
                members[2 * k + 1], members[2 * k + 2] = own[side <= offset], own[side > offset]
            counts[t] = [len(members[nodes + i]) for i in range(1 << depth)]
        return cls(planes, offsets, depth, counts, total / max(n, 1))

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        out = np.zeros((len(vectors), len(self.planes)), np.int64)
        for t in range(len(self.planes)):
            node = np.zeros(len(vectors), np.int64)
            for _ in range(self.depth):
                side = np.einsum("ij,ij->i", vectors, self.planes[t, node])
                node = 2 * node + 1 + (side > self.offsets[t, node])
            out[:, t] = node - ((1 << self.depth) - 1)
        return out

    def walk(self, vector: np.ndarray) -> Iterator[tuple[int, float]]:
        """tree * leaves + leaf, in the order of the shared queue, and the vectors in the leaves before."""
        margin = np.einsum("tnd,d->tn", self.planes, vector) - self.offsets
        margin = [m.tolist() for m in margin]
        counts = [c.tolist() for c in self.counts]
        leaves, nodes = 1 << self.depth, (1 << self.depth) - 1
        queue = [(0.0, t, 0) for t in range(len(self.planes))]  # distance to the farthest plane crossed so far
        seen = 0.0
        while queue:
            distance, tree, node = heapq.heappop(queue)
            while node < nodes:
                m = margin[tree][node]
                near, far = (2 * node + 2, 2 * node + 1) if m > 0 else (2 * node + 1, 2 * node + 2)
                heapq.heappush(queue, (max(distance, abs(m)), tree, far))
                node = near
            yield tree * leaves + node - nodes, seen
            seen += counts[tree][node - nodes] * self.scale

    def reached(self, vector: np.ndarray, search: float) -> list[int]:
        return [place for place, _ in takewhile(lambda x: x[1] < search, self.walk(vector))]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and vector (array of double) of the rows that take part."""
    vector = F.col("vector")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.filter(
        F.col("vec_id").isNotNull() & vector.isNotNull()
        & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(vector, lambda x: x != 0))
    sizes = rows.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("rows"))
    usual = sizes.orderBy(F.desc("rows"), "n").limit(1).collect()
    return rows.filter(F.size("vector") == (usual[0].n if usual else 0))


def distinct_vectors(rows: DataFrame, most: int) -> DataFrame:
    """Each vector once, with the ``most`` smallest of its ids; only so many rows of a vector are shuffled per task."""
    order = Window.partitionBy("vector").orderBy("vec_id")
    first = rows.distinct().withColumn("k", F.row_number().over(order)).filter(F.col("k") <= most)
    return first.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def _matrix(array: pa.Array) -> np.ndarray:
    array = array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array
    return array.flatten().to_numpy(zero_copy_only=False).reshape(len(array), -1) if len(array) else np.zeros((0, 0))


def closest(points: np.ndarray, names: np.ndarray, asked: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each vector asked for the ``most`` nearest points (names, distances), by distance and name.

    A product of matrices leaves those that can be among them, by a bound of its rounding error; only their distances are
    computed in order, like in a plain loop. What overflows is left in.
    """
    with np.errstate(all="ignore"):
        square = np.einsum("ij,ij->i", points, points)
        step = max(1, 4_000_000 // max(len(points), 1))
        for a in range(0, len(asked), step):
            some = asked[a:a + step]
            length = np.einsum("ij,ij->i", some, some)
            rough = square + length[:, None] - 2 * (some @ points.T)
            slack = (points.shape[1] + 16) * 2.0 ** -50 * (square.max() + length) + 1e-300
            if len(points) > most:
                limit = np.partition(rough, most - 1, axis=1)[:, most - 1] + 2 * slack
            else:
                limit = np.full(len(some), np.inf)
            for i in range(len(some)):
                at = np.flatnonzero(~(rough[i] > limit[i]))
                distance = np.sqrt(np.cumsum((points[at] - some[i]) ** 2, axis=1)[:, -1])
                order = np.lexsort((names[at], distance))[:most]
                yield names[at][order], distance[order]


class Best:
    """The nearest found so far, by query."""

    def __init__(self, most: int):
        self.most, self.found = most, {}

    def add(self, query: int, ids: np.ndarray, distance: np.ndarray) -> None:
        if query in self.found:
            ids = np.concatenate([ids, self.found[query][0]])
            distance = np.concatenate([distance, self.found[query][1]])
        ids, first = np.unique(ids, return_index=True)
        order = np.lexsort((ids, distance[first]))[:self.most]
        self.found[query] = ids[order], distance[first][order]

    def batches(self) -> Iterator[pa.RecordBatch]:
        for query, (ids, distance) in self.found.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), query)), pa.array(ids), pa.array(distance)],
                                             ["query", "own", "score"])


FOUND = "query long, own long, score double"


def _first(found: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy("score", "own")
    return found.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= most).select("query", "own", "score")


def needed(distinct: DataFrame, asked: DataFrame, forest: Forest, most: int) -> float:
    """Vectors to look at so that RECALL of the true neighbours of some queries are reached.

    The queries (``asked`` holds their own) are taken by hash. They are compared with all vectors.
    """
    chosen = asked.orderBy(F.xxhash64("own"), "own").limit(MEASURED)
    chosen = distinct.join(chosen, "own").select("own", "vector").toArrow().sort_by("own")  # bounded by MEASURED
    names, points = chosen.column("own").to_pylist(), _matrix(chosen.column("vector"))

    def run(batches):
        best = Best(most)
        for batch in batches:
            if batch.num_rows:
                found = closest(_matrix(batch.column(1)), batch.column(0).to_numpy(), points, most)
                for query, (ids, distance) in zip(names, found):
                    best.add(query, ids, distance)
        yield from best.batches()

    true = _first(distinct.select("own", "vector").mapInArrow(run, FOUND), most).filter("query != own")
    true = true.join(distinct.select("own", "vector"), "own").select("query", "vector").toArrow()
    if not true.num_rows:
        return 0.0
    query, size = true.column("query").to_numpy(), 1 << forest.depth
    places = forest.leaves(_matrix(true.column("vector"))) + np.arange(len(forest.planes)) * size
    before = np.full(len(query), np.inf)
    for name, point in zip(names, points):
        at = {}  # the leaves of the query's neighbours
        for i in np.flatnonzero(query == name).tolist():
            for place in places[i].tolist():
                at.setdefault(place, []).append(i)
        open_ = {i for found in at.values() for i in found}
        for place, seen in forest.walk(point):
            for i in open_.intersection(at.get(place, ())):
                before[i] = seen
                open_.remove(i)
            if not open_:
                break
    # a leaf is looked at if less than `visit` vectors are before it
    return float(np.nextafter(np.sort(before)[int(np.ceil(RECALL * len(before))) - 1], np.inf))


def search(vectors: DataFrame, is_query: Column, neighbours: int = 10, id_col: str = "vec_id",
           vector_col: str = "embedding", trees: int = TREES, leaf: int = LEAF, sample: int | None = None,
           visit: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance) of the nearest found; ``is_query`` is a condition on vec_id.

    ``sample`` and ``visit`` are derived from the table unless given.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = usable(vectors, id_col, vector_col)
    most = neighbours + 1
    distinct = keep(distinct_vectors(rows, most).select(F.element_at("ids", 1).alias("own"), "ids", "vector"), "vectors")
    queries = keep(rows.filter(is_query).select("vec_id", "vector").distinct()
                   .join(distinct.select("own", "vector"), "vector").select("vec_id", "own"), "queries")
    asked = queries.select("own").distinct()
    total = distinct.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dimension = distinct.select(F.size("vector")).first()[0]
    fit_on = max(SAMPLE, min(int(SAMPLED * total), SAMPLE_VALUES // dimension)) if sample is None else sample
    order = F.xxhash64("own")
    fitted = distinct.orderBy(order).limit(fit_on).select("own", "vector").toArrow().sort_by("own")
    forest = Forest.fit(_matrix(fitted.column("vector")), total, trees, leaf)
    if visit is None:
        visit = SEARCH if total * trees <= SEARCH else max(SEARCH, needed(distinct, asked, forest, most))
    forest = spark.sparkContext.broadcast(forest)  # bounded by the sample

    def entries(batches):
        for batch in batches:
            points, own, asked = _matrix(batch.column(1)), batch.column(0), batch.column(2).to_pylist()
            if not len(own):
                continue
            f = forest.value
            places = f.leaves(points) + np.arange(trees) * (1 << f.depth)
            at = np.repeat(np.arange(len(own)), trees)
            yield pa.RecordBatch.from_arrays(
                [pa.array(places.ravel()), pa.array(np.ones(len(at), bool)), own.take(pa.array(at)),
                 batch.column(1).take(pa.array(at))], ["place", "stored", "own", "vector"])
            for i in [i for i, a in enumerate(asked) if a]:
                reached = f.reached(points[i], visit)
                at = pa.array(np.full(len(reached), i))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(reached, pa.int64()), pa.array(np.zeros(len(reached), bool)), own.take(at),
                     batch.column(1).take(at)], ["place", "stored", "own", "vector"])

    def nearest(batches):
        best = Best(most)
        held: list[pa.RecordBatch] = []

        def look(table: pa.Table) -> None:
            place, stored, own = (table.column(c).to_numpy() for c in ("place", "stored", "own"))
            points = _matrix(table.column("vector"))
            edge = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1], [True]]))
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                cut = a + int(stored[a:b].argmax()) if stored[a:b].any() else b  # queries come first
                if a < cut < b:
                    for query, found in zip(own[a:cut].tolist(), closest(points[cut:b], own[cut:b], points[a:cut], most)):
                        best.add(query, *found)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if batch.column(0)[-1] == held[0].column(0)[0]:  # a place that goes on
                continue
            table = pa.Table.from_batches(held)
            place = table.column("place").to_numpy()
            cut = int(np.searchsorted(place, place[-1], "left"))
            look(table.slice(0, cut))
            held = table.slice(cut).combine_chunks().to_batches()
        if held:
            look(pa.Table.from_batches(held))
        yield from best.batches()

    source = distinct.join(asked.withColumn("asked", F.lit(True)), "own", "left").select("own", "vector", "asked")
    met = (source.mapInArrow(entries, "place long, stored boolean, own long, vector array<double>")
           .repartition(partitions(spark), "place").sortWithinPartitions("place", "stored"))
    found = _first(met.mapInArrow(nearest, FOUND).distinct(), most)
    copies = found.join(distinct.select("own", "ids"), "own").select("query", "score", F.explode("ids").alias("vec_id"))
    pairs = (queries.select(F.col("vec_id").alias("query_id"), F.col("own").alias("query")).join(copies, "query")
             .filter("query_id != vec_id"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= neighbours) \
        .select("query_id", "rank", "vec_id", "score")
