"""Repeated passages, near duplicates and neighbours against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from telemill.llm import ann, minhash, suffix_dedup

SCHEMA = "doc_id long, text string, ranges string, component_id string, shingles string"


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(i, t, "x", "x", "x") for i, t in rows], SCHEMA).repartition(parts)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["an", "the", "on", "ér", "st", "ou"]) for _ in range(r.randint(1, 4))) for _ in range(n))


def repeated(rows, width=50):
    """Which bytes of each row lie in a string that starts in a smaller document, too."""
    first, masks = {}, []
    for i, t in rows:
        raw = (t or "").encode()
        for k in range(len(raw) - width + 1):
            if i is not None:
                w = raw[k:k + width]
                first[w] = min(first.get(w, i), i)
    for i, t in rows:
        raw = (t or "").encode()
        mask = np.zeros(len(raw), bool)
        for k in range(len(raw) - width + 1):
            if i is not None and first[raw[k:k + width]] < i:
                mask[k:k + width] = True
        masks.append((i, raw, mask))
    return masks


@pytest.fixture(scope="module")
def passages():
    shared = [prose(k, 30) for k in range(5)]
    rows = []
    for i in range(60):
        r = random.Random(i)
        rows.append((i, " ".join([prose(1000 + i, r.randint(0, 40)), r.choice(shared)[r.randint(0, 9):], prose(2000 + i, 9),
                                  r.choice(shared)[:r.randint(20, 90)]])))
    rows += [(60, "ab" * 400), (61, "x" + "ab" * 90), (62, "aaaa" * 60), (63, "aaaa" * 20), (64, None), (65, ""),
             (None, shared[0]), (None, shared[0]), (-5, shared[1] + shared[2]), (7, "same id " + shared[3]), (66, "é" * 60),
             (67, "zé" + "é" * 80), (68, shared[0][:50]), (69, shared[0][:49])]
    return rows


@pytest.mark.parametrize("hot, small, at_once", [(4096, 100_000, 20_000), (0, 100_000, 20_000), (8, 0, 20), (2, 100_000, 1)])
def test_suffix_dedup(spark, passages, monkeypatch, hot, small, at_once):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "SMALL", small)
    monkeypatch.setattr(suffix_dedup, "RUNS_AT_ONCE", at_once)
    docs = frame(spark, passages)
    ranges = suffix_dedup.repeated_ranges(docs, 50)
    got = sorted((tuple(r) for r in suffix_dedup.removal_digests(docs, ranges).collect()), key=str)
    want = []
    for i, raw, mask in repeated(passages):
        spans = int((mask & ~np.concatenate([[False], mask[:-1]])).sum()) if len(mask) else 0
        kept = np.frombuffer(raw, np.uint8)[~mask].tobytes()
        want.append((i, len(raw), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest()))
    assert got == sorted(want, key=str)
    removed = {r.doc_id: r.text for r in suffix_dedup.remove_ranges(docs, ranges).collect() if r.doc_id == 63}
    assert removed[63] == "" and suffix_dedup.remove_ranges(docs, ranges).columns == docs.columns


def test_suffix_dedup_of_nothing(spark):
    docs = frame(spark, [])
    assert suffix_dedup.removal_digests(docs, suffix_dedup.repeated_ranges(docs, 50)).count() == 0


def test_small_batches_give_the_same(spark, passages, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "RUNS_AT_ONCE", 7)
    docs = frame(spark, passages, 9)
    got = suffix_dedup.removal_digests(docs, suffix_dedup.repeated_ranges(docs, 50)).agg(F.sum("n_removed")).first()[0]
    assert got == sum(int(m.sum()) for _, _, m in repeated(passages))


def shingle_set(text, width):
    w = [x.lower() for x in (text or "").encode().split()]
    return frozenset(tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute_components(rows, width, share):
    sets = [(i, shingle_set(t, width)) for i, t in rows]
    label = {i: i for i, _ in rows if i is not None}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, s in sets:
        for b, t in sets:
            if a is not None and b is not None and a < b and s and t and 100 * len(s & t) >= share * len(s | t):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {i: root(i) for i in label}, dict(sets)


def family(seed, n, edits, words=120):
    """A text and copies with some words replaced."""
    r = random.Random(seed)
    base = prose(seed, words).split()
    for k in range(n):
        copy = list(base)
        for _ in range(r.randint(0, edits)):
            copy[r.randrange(len(copy))] = f"new{seed}x{k}x{r.random()}"
        yield " ".join(copy)


@pytest.mark.parametrize("block", [4096, 5])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "ALL_PAIRS", 16)
    monkeypatch.setattr(minhash, "HUBS", 3)
    texts = [*family(1, 60, 9), *family(2, 12, 3), *family(3, 5, 0), *[prose(100 + k, 50) for k in range(20)]]
    texts += [None, "", " \n", "one two", "One TWO", "one two three four", "É é", "é É", "q " * 30000]
    random.Random(4).shuffle(texts)
    rows = [(3 * k - 50, t) for k, t in enumerate(texts)] + [(None, texts[0]), (None, None)]
    label, sets = brute_components(rows, 4, 80)
    got = minhash.near_duplicates(frame(spark, rows), 4, 80).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), label[r.doc_id], label[r.doc_id] == r.doc_id)
    kept = minhash.keep_first(frame(spark, rows), 4, 80)
    assert {r.doc_id for r in kept.collect()} == {i for i in label if label[i] == i} | {None}


def test_large_buckets_are_dealt_before_signatures_meet(spark, monkeypatch, tmp_path):
    """No call holds a whole bucket of differing near copies, and the components are the same."""
    monkeypatch.setattr(minhash, "BLOCK", 20)

    def told(name):
        work = getattr(minhash, name)

        def run(bucket, place, doc, component, signature):
            (tmp_path / f"{name}_{len(doc)}").touch()
            return work(bucket, place, doc, component, signature)

        monkeypatch.setattr(minhash, name, run)

    told("_nearest")
    told("_across")
    rows = list(enumerate([*family(1, 200, 12), *[prose(100 + k, 50) for k in range(20)]]))
    label, _ = brute_components(rows, 4, 80)
    got = minhash.near_duplicates(frame(spark, rows), 4, 80).collect()
    assert {r.doc_id: r.component_id for r in got} == label
    sizes = [int(p.name.rsplit("_", 1)[1]) for p in tmp_path.iterdir()]
    assert 2 < max(sizes) <= 100


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(frame(spark, [])).count() == 0
    assert minhash.near_duplicates(frame(spark, [(1, None), (2, "")])).count() == 2


def test_signatures_meet_within_reach():
    r = np.random.default_rng(1)
    for _ in range(200):
        a = r.integers(0, 1 << 16, minhash.SYMBOLS).astype(np.uint16)
        b = a.copy()
        wrong = r.choice(minhash.SYMBOLS, minhash.REACH, replace=False)
        b[wrong] += 1
        keys = minhash.bucket_keys(np.stack([a, b]))
        assert (keys[0] == keys[1]).any()


def neighbours(points, query, n):
    found = sorted((float(np.sqrt(np.cumsum((v - points[query]) ** 2)[-1])), i) for i, v in points.items() if i != query)
    return [(query, k + 1, i, d) for k, (d, i) in enumerate(found[:n])]


@pytest.mark.parametrize("sample", [20_000, 50])
def test_search(spark, sample):
    r = np.random.default_rng(2)
    points = {i: r.normal(size=6) for i in range(0, 600)}
    points |= {1000 + i: points[100] for i in range(300)}  # a third of all rows are one vector
    bad = [(2000, None), (2001, [0.0] * 6), (2002, [1.0] * 5), (2003, [float("nan")] * 6), (2004, [None] + [1.0] * 5),
           (2005, [float("inf")] * 6), (None, [1.0] * 6)]
    rows = [(i, [float(x) for x in v], "x", "x") for i, v in points.items()] + [(i, v, "x", "x") for i, v in bad]
    made = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string, score string").repartition(5)
    got = sorted(map(tuple, ann.search(made, F.col("vec_id") % 100 == 0, visit=10**6, sample=sample).collect()))
    want = [x for i in points if i % 100 == 0 for x in neighbours(points, i, 10)]
    assert got == sorted(want)


def test_search_recall_and_small_tables(spark):
    r = np.random.default_rng(3)
    points = {i: r.normal(size=16) for i in range(2000)}
    made = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in points.items()], "vec_id long, embedding array<double>")
    got = ann.search(made, F.col("vec_id") % 100 == 0, visit=4000).collect()
    want = {(q, i) for k in points if k % 100 == 0 for q, _, i, _ in neighbours(points, k, 10)}
    assert len({(g.query_id, g.vec_id) for g in got} & want) >= 0.9 * len(want)
    assert ann.search(made.limit(0), F.lit(True)).count() == 0
    few = made.where("vec_id < 3")
    assert sorted((g.query_id, g.vec_id) for g in ann.search(few, F.lit(True)).collect()) == [
        (0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)]


def random_vectors(spark, folder, n, dimension, seed=5):
    r = np.random.default_rng(seed)
    points = r.normal(size=(n, dimension)).astype(np.float32)
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    values = pa.array(points.ravel())
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(values, dimension).cast(
        pa.list_(pa.float32()))}), f"{folder}/vectors.parquet", row_group_size=n // 8)
    return points.astype(np.float64), spark.read.parquet(f"{folder}/vectors.parquet")


def recall(got, points, queries):
    found = {(g.query_id, g.vec_id) for g in got}
    true = {(q, int(i)) for q in queries for i in np.argsort(((points - points[q]) ** 2).sum(1), kind="stable")[1:11]}
    assert len(got) == len(true)
    return len(found & true) / len(true)


@pytest.mark.parametrize("n", [5_000, 51_000, 130_000, 200_000])
def test_search_recall_does_not_fall_with_the_table(spark, tmp_path, n):
    points, made = random_vectors(spark, tmp_path, n, 64)
    got = ann.search(made, F.col("vec_id") % (n // 40) == 0).collect()
    reached = recall(got, points, range(0, n, n // 40))
    print("RECALL", n, reached)
    assert reached >= 0.95


def test_visit_is_measured(spark, tmp_path, monkeypatch):
    n = 20_000
    monkeypatch.setattr(ann, "SEARCH", 100)  # so that the least is far too little
    points, made = random_vectors(spark, tmp_path, n, 24)
    got = ann.search(made, F.col("vec_id") % 100 == 0).collect()
    assert recall(got, points, range(0, n, 100)) >= 0.95
    less = ann.search(made, F.col("vec_id") % 100 == 0, visit=1000).collect()
    assert recall(less, points, range(0, n, 100)) < 0.95


def test_small_tables_are_searched_whole(spark, tmp_path):
    points, made = random_vectors(spark, tmp_path, 900, 6)
    rows = {i: p for i, p in enumerate(points)}
    got = sorted(map(tuple, ann.search(made, F.col("vec_id") % 20 == 0).collect()))
    assert got == sorted(x for i in range(0, 900, 20) for x in neighbours(rows, i, 10))
