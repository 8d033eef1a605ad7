"""Sliced windows equal plain windows, whatever the slices."""

import pytest
from helpers import feature_rows, random_features
from pyspark.sql import Window
from pyspark.sql import functions as F

from telemill.operators import detection, features, ordered, windows
from telemill.operators.detection import Rules
from telemill.operators.ordered import Order

SLICINGS = [
    {},                 # no key is large enough to be cut
    {"max_rows": 150},  # the dominant key is cut
    {"max_rows": 20},   # every key is cut
    {"max_rows": 2},    # slices of a row or two
]


def plain_window():
    return Window.partitionBy("client_id").orderBy(F.col("ts").asc_nulls_last(), "seq")


def same_rows(left, right):
    columns = left.columns
    return left.exceptAll(right.select(*columns)).count() == 0 and left.count() == right.count()


@pytest.fixture(scope="module", params=[1, 2])
def rows(spark, request):
    return feature_rows(spark, random_features(request.param, 700)).repartition(5).persist()


@pytest.mark.parametrize("slicing", SLICINGS)
def test_running_totals(rows, slicing):
    order = Order(("client_id",), **slicing)
    fresh = ordered.first_occurrences(rows, order, "topic", "topics")
    got = ordered.running_totals(rows, order, {"n": F.lit(1), "q": (F.coalesce("qos", F.lit(0)) == 2).cast("int")}, fresh)
    up_to = plain_window().rowsBetween(Window.unboundedPreceding, 0)
    expected = (rows.withColumn("n", F.count("*").over(up_to))
                .withColumn("q", F.count_if(F.col("qos") == 2).over(up_to))
                .withColumn("topics", F.size(F.collect_set(F.struct("topic")).over(up_to)).cast("bigint")))
    assert same_rows(got, expected)


@pytest.mark.parametrize("slicing", SLICINGS)
def test_previous_ts(rows, slicing):
    got = ordered.previous_ts(rows, Order(("client_id",), **slicing))
    gap = F.unix_micros("ts") - F.unix_micros("prev_ts")
    expected = rows.withColumn("prev_ts", F.lag("ts").over(plain_window()))
    assert same_rows(got.select("seq", gap.alias("g")), expected.select("seq", gap.alias("g")))


@pytest.mark.parametrize("slicing", SLICINGS)
def test_last_state(rows, slicing):
    state = F.when(F.col("qos") == 2, F.struct("seq", "topic"))
    got = ordered.last_state(rows, Order(("client_id",), **slicing), state, "before")
    before = plain_window().rowsBetween(Window.unboundedPreceding, -1)
    assert same_rows(got, rows.withColumn("before", F.last(state, ignorenulls=True).over(before)))


def test_slices_are_bounded_and_deterministic(spark):
    rows = spark.range(20000).select(
        F.lit("hot").alias("client_id"), F.timestamp_seconds(F.lit(0)).alias("ts"), F.col("id").alias("seq"))
    order = Order(("client_id",), max_rows=500)
    points = ordered.split_points(rows, order)
    sizes = ordered.with_slices(rows, order, points).groupBy(*order.slice_columns).count()
    largest, slices = sizes.agg(F.max("count"), F.count("*")).first()
    assert largest < 1500 and slices >= 35
    shuffled = rows.repartition(7, "seq")
    again = ordered.with_slices(shuffled, order, ordered.split_points(shuffled, order)).groupBy(*order.slice_columns).count()
    assert same_rows(sizes, again)


def records(spark):
    """Input records and shuffled records of all stages so far."""
    context = spark.sparkContext
    scala, java = context._jsc.sc(), context._jvm.java.util.ArrayList
    scala.listenerBus().waitUntilEmpty(30_000)
    nothing = context._gateway.new_array(context._jvm.double, 0)
    stages = scala.statusStore().stageList(java(), False, False, nothing, java())
    return tuple(sum(getattr(stages.apply(i), name)() for i in range(stages.size()))
                 for name in ("inputRecords", "shuffleWriteRecords"))


def costs(df, work):
    """How often the rows of ``df`` are read, and records shuffled per row, when the result of ``work(df)`` is read."""
    n, before = df.count(), records(df.sparkSession)
    work(df).write.format("noop").mode("overwrite").save()
    return tuple((now - then) / n for now, then in zip(records(df.sparkSession), before))


@pytest.fixture(scope="module")
def stored(rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored") / "rows")
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


@pytest.mark.parametrize("slicing, reads, shuffled", [({}, 2, 1.1), ({"max_rows": 50}, 3, 2.5)])
def test_input_is_read_few_times(stored, slicing, reads, shuffled):
    order = Order(("client_id",), **slicing)
    stated = F.when(F.col("qos") == 2, F.col("seq"))
    found = {
        "previous_ts": costs(stored, lambda df: ordered.previous_ts(df, order)),
        "running_totals": costs(stored, lambda df: ordered.running_totals(df, order, {"n": F.lit(1)})),
        "last_state": costs(stored, lambda df: ordered.last_state(df, order, stated, "before")),
        "flood": costs(stored, lambda df: detection.detect(df, checks=["flood_detection"], **slicing)),
        "inter_arrival": costs(stored, lambda df: features.inter_arrival(df, order))}
    assert max(cost[0] for cost in found.values()) <= reads, found
    assert max(cost[1] for cost in found.values()) <= shuffled, found


def test_sliding_windows_share_a_sweep(stored):
    wide = Rules().override(qos_abuse={"window_seconds": 120}, retain_abuse={"window_seconds": 7200})
    two, three = (costs(stored, lambda df: windows.detect_sliding(df, r)) for r in (Rules(), wide))
    assert two[0] == three[0] <= 4, (two, three)  # whatever the number of widths
