"""The registered queries against their check SQL, and the pipeline against brute force, on the smallest tables."""

import os
import re

import duckdb
import numpy as np
import pytest
from test_llm_corpus import brute_components, repeated

import __spark_entry__ as entry
import corpus_pipeline
from check import TABLES, differences
from telemill.llm import quality, queries, toxicity
from telemill.llm.runtime import keep

FOLDER = entry.SMALL
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="supplied tables not present")


def test_registered():
    names = [re.match(r"op(\d+)_", n).group(1) for n in queries.QUERIES]
    assert sorted(map(int, names)) == list(range(1, 14)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    sql = db.execute(queries.ORACLES[name]).df()
    found = queries.QUERIES[name](spark, FOLDER).toPandas()
    assert set(sql.columns) <= set(found.columns)
    assert differences(found[list(sql.columns)], sql).startswith("ok")


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    left = {r.doc_id: r for r in docs.collect()}
    toxic = {r.doc_id for r in toxicity.score(docs, toxicity.fit(docs, labels)).where("predicted = 1").collect()}
    now = keep(corpus_pipeline.drop_toxic(spark, docs, FOLDER), "test")
    assert {r.doc_id for r in now.collect()} == set(left) - toxic
    chain = quality.fit_chain(now, labels)
    good = {r.doc_id for r in quality.judge(now, chain).where("kept").collect()}
    now = keep(corpus_pipeline.drop_low_quality(spark, now, FOLDER), "test")
    assert {r.doc_id for r in now.collect()} == good
    rows = sorted((r.doc_id, r.text) for r in now.collect())
    label, _ = brute_components(rows, 5, 80)
    now = keep(corpus_pipeline.drop_near_duplicates(spark, now, FOLDER), "test")
    assert {r.doc_id for r in now.collect()} == {i for i in label if label[i] == i}
    rows = sorted((r.doc_id, r.text) for r in now.collect())
    want = {}
    for i, raw, mask in repeated(rows):
        lead = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
        gone = np.repeat(np.minimum.reduceat(mask, lead), np.diff(np.append(lead, len(raw)))) if len(lead) else mask
        want[i] = np.frombuffer(raw, np.uint8)[~gone].tobytes().decode()
    now = keep(corpus_pipeline.remove_repeated_passages(spark, now, FOLDER), "test")
    assert now.columns == docs.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in now.collect()} == {i: (t, len(t)) for i, t in want.items()}
    packed = corpus_pipeline.pack_sequences(spark, now, FOLDER).toPandas()
    assert set(packed.doc_id) == set(want) and (packed.groupby("sequence_id")["length"].sum() <= 2048).all()
    assert corpus_pipeline.run(spark, FOLDER).count() == len(packed)
