"""Running values per key over a total order, safe for keys that hold a large share of all rows.

``Window.partitionBy(key)`` sorts all rows of a key in one task. That is fine for most keys; the rows of a key with
more than ``max_rows`` are cut into *slices* that follow the order, at split points taken from a sample of the key's
rows. Slices are the unit of the shuffle and of the window. What a slice needs to know about the slices before it
(a count so far, a last timestamp) arrives as one *seed* row that sorts first; seeds come from per-slice aggregates,
which Spark combines before the shuffle. Keys that are not cut need neither.

A slice is a function of the row alone, so a recomputed task reproduces it. Splitting changes how the work is
spread, never the result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

AT, PART, KIND = "_at", "_part", "_kind"
SEED, MARKER, ROW = -1, 0, 1

FIRST, LAST = -(2 ** 63), 2 ** 63 - 1

# Splitting makes at most about this many slices over all keys, whatever the input: it bounds the broadcast split points
# to a few megabytes.
MOST_SPLITS = 131072
# Slices per key, and the rows sampled for each of them.
MOST_PARTS = 65536
SAMPLES_PER_PART = 64
# Split points are looked up in two levels of at most so many, a power of two, whatever their number.
FAN = 256


@dataclass(frozen=True)
class Order:
    """Total order of rows within a key: ``ts`` with nulls last, then the unique ``seq``.

    A key with more than ``max_rows`` rows is cut into slices of about that size.
    """

    keys: tuple[str, ...]
    ts: str = "ts"
    seq: str = "seq"
    max_rows: int = 100_000

    @property
    def at(self) -> Column:
        return F.coalesce(F.unix_micros(F.col(self.ts)), F.lit(LAST))

    @property
    def slice_columns(self) -> list[str]:
        return [*self.keys, PART]

    def window(self) -> WindowSpec:
        """One slice in order: its seed, then markers and rows."""
        return Window.partitionBy(*self.slice_columns).orderBy(AT, self.seq, KIND)

    def earlier_slices(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)


def _join_small(rows: DataFrame, small: DataFrame, keys: tuple[str, ...], how: str) -> DataFrame:
    """Broadcast join on null-safe keys; ``small`` is bounded by MOST_SPLITS."""
    renamed = small.withColumnsRenamed({n: f"_of_{n}" for n in keys})
    same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"_of_{n}")) for n in keys])
    return rows.join(F.broadcast(renamed), same, how).drop(*[f"_of_{n}" for n in keys])


def split_points(df: DataFrame, order: Order) -> DataFrame:
    """Split points of the keys that are too large for one slice: a row per key, its points in runs of at most FAN.

    ``_coarse`` has the first point of every run but the first, ``_fine`` the runs. One read of the key, timestamp and
    ``seq``, of which rows are taken by a hash of ``seq``: the sample is the same in every run. It tells about how many rows
    a key has, so only keys with more than ``max_rows`` are cut; a slice is ``max_rows`` on average, give or take an eighth.
    Should that be more than MOST_SPLITS points, every second, third, ... of them is left out.
    """
    stride = max(1, order.max_rows // SAMPLES_PER_PART)
    sample = (df.select(*order.keys, order.at.alias(AT), order.seq)
              .where(F.pmod(F.xxhash64(order.seq), F.lit(stride)) == 0))
    of_key = Window.partitionBy(*order.keys)
    parts = F.least(F.lit(MOST_PARTS), F.ceil(F.col("_size") * stride / order.max_rows))
    step = F.floor(F.col("_rank") * F.col("_parts") / F.col("_size"))
    step_before = F.floor((F.col("_rank") - 1) * F.col("_parts") / F.col("_size"))
    points = (sample.withColumns({"_rank": F.row_number().over(of_key.orderBy(AT, order.seq)),
                                  "_size": F.count("*").over(of_key)})
              .withColumn("_parts", parts)
              .where((step > step_before) & (F.col("_rank") < F.col("_size")))
              .select(*order.keys, F.struct(AT, order.seq).alias("_point"), step.alias("_step")))
    thin = F.greatest(F.lit(1), F.ceil(points.agg(F.count("*")).scalar() / MOST_SPLITS))  # of the same sample, once shuffled
    runs = (points.where(F.col("_step") % thin == 0)
            .withColumn("_run", F.floor((F.floor(F.col("_step") / thin) - 1) / FAN))
            .groupBy(*order.keys, "_run").agg(F.sort_array(F.collect_list("_point")).alias("_points"))
            .groupBy(*order.keys).agg(F.sort_array(F.collect_list(F.struct("_run", "_points"))).alias("_runs")))
    fine = F.transform("_runs", lambda run: run["_points"])
    return runs.select(*order.keys, fine.alias("_fine"), F.transform(
        F.slice(fine, F.lit(2), F.size("_runs")), lambda run: F.get(run, F.lit(0))).alias("_coarse"))


def _passed(points: Column, here: Column) -> Column:
    """How many of at most FAN ordered points are at or before ``here``, by steps of halving size."""
    steps = F.array(*[F.lit(FAN >> i) for i in range(FAN.bit_length())])
    return F.when(points.isNotNull(), F.aggregate(
        steps, F.lit(0), lambda n, step: F.when(F.get(points, n + step - 1) <= here, n + step).otherwise(n)))


def with_slices(df: DataFrame, order: Order, points: DataFrame, only_split: bool = False) -> DataFrame:
    """Add the order column and the slice of every row, or keep the rows of split keys only.

    A row meets the coarse points of its key, then those of one run: its cost doesn't grow with the number of slices.
    """
    rows = df.withColumn(AT, order.at)
    here = F.struct(F.col(AT), F.col(order.seq))
    found = _join_small(rows, points, order.keys, "inner" if only_split else "left").withColumn("_run", _passed(F.col("_coarse"), here))
    part = F.col("_run") * FAN + F.coalesce(_passed(F.get("_fine", F.col("_run")), here), F.lit(0))
    return found.select(*rows.columns, F.coalesce(part, F.lit(0)).alias(PART))


def with_seeds(rows: DataFrame, seeds: DataFrame) -> DataFrame:
    """Rows plus one leading seed row per slice, told apart by ``_kind``."""
    seeds = seeds.withColumns({AT: F.lit(FIRST), KIND: F.lit(SEED)})
    return rows.unionByName(seeds, allowMissingColumns=True)


def running_totals(
    df: DataFrame,
    order: Order,
    increments: dict[str, Column],
    markers: DataFrame | None = None,
) -> DataFrame:
    """Exact running sums per key, the current row included.

    ``increments`` maps an output column to what each row of ``df`` adds to it. ``markers`` holds further
    additions (keys, ts, seq and any of the output columns) that take effect at their place in the order: just
    before the row with the same ``seq``, or before all rows of that instant where ``seq`` is null.
    """
    marked = [] if markers is None else [c for c in markers.columns if c not in (*order.keys, order.ts, order.seq)]
    names = list(dict.fromkeys([*increments, *marked]))
    zero = F.lit(0).cast("bigint")
    kept = df.columns
    rows = df.withColumns({**{n: increments.get(n, zero).cast("bigint") for n in names}, KIND: F.lit(ROW)})
    if markers is not None:
        added = {n: (F.col(n).cast("bigint") if n in marked else zero) for n in names}
        rows = rows.unionByName(
            markers.select(*order.keys, order.ts, order.seq, *[c.alias(n) for n, c in added.items()],
                           F.lit(MARKER).alias(KIND)), allowMissingColumns=True)
    points = split_points(df, order)
    totals = with_slices(rows, order, points, only_split=True).groupBy(*order.slice_columns).agg(
        *[F.sum(n).alias(n) for n in names])
    before = {n: F.coalesce(F.sum(n).over(order.earlier_slices()), zero) for n in names}
    seeded = with_seeds(with_slices(rows, order, points), totals.withColumns(before))
    so_far = order.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (seeded.withColumns({n: F.sum(n).over(so_far) for n in names})
            .where(F.col(KIND) == ROW)
            .select(*kept, *names))


def first_occurrences(df: DataFrame, order: Order, column: str, name: str) -> DataFrame:
    """Markers worth one at the first row of each distinct ``column`` value (null counts as a value)."""
    first = F.min(F.struct(order.at.alias(AT), F.col(order.seq), F.col(order.ts))).alias("_first")
    return (df.groupBy(*order.keys, column).agg(first)
            .select(*order.keys, f"_first.{order.ts}", f"_first.{order.seq}", F.lit(1).alias(name)))


def previous_ts(df: DataFrame, order: Order, name: str = "prev_ts") -> DataFrame:
    """Add the timestamp of the preceding row of the same key; null for the first."""
    points = split_points(df, order)
    last = with_slices(df, order, points, only_split=True).groupBy(*order.slice_columns).agg(
        F.max(order.ts).alias(order.ts))
    seeds = last.withColumn(order.ts, F.max(order.ts).over(order.earlier_slices()))
    rows = with_slices(df, order, points).withColumn(KIND, F.lit(ROW))
    return (with_seeds(rows, seeds)
            .withColumn(name, F.lag(order.ts).over(order.window()))
            .where(F.col(KIND) == ROW)
            .select(*df.columns, name))


def last_state(df: DataFrame, order: Order, state: Column, name: str) -> DataFrame:
    """Add the latest non-null ``state`` strictly before each row of the same key."""
    points = split_points(df, order)
    stated = df.withColumn("_state", state)
    place = F.when(F.col("_state").isNotNull(), F.struct(F.col(AT), F.col(order.seq)))
    last = with_slices(stated, order, points, only_split=True).groupBy(*order.slice_columns).agg(
        F.max_by("_state", place).alias("_state"))
    seeds = last.withColumn("_state", F.last("_state", ignorenulls=True).over(order.earlier_slices()))
    rows = with_slices(stated, order, points).withColumn(KIND, F.lit(ROW))
    before = order.window().rowsBetween(Window.unboundedPreceding, -1)
    return (with_seeds(rows, seeds)
            .withColumn(name, F.last("_state", ignorenulls=True).over(before))
            .where(F.col(KIND) == ROW)
            .select(*df.columns, name))
