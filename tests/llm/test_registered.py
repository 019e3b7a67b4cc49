"""Registered text queries against their SQL, and the pipeline stage by stage."""

import os
import re

import pytest

duckdb = pytest.importorskip("duckdb")

import check_queries

import corpus_pipeline
from duelgauge.llm import queries as Q
from duelgauge.llm import quality
from duelgauge.runtime import cut_lineage
from tests.llm import test_jaccard, test_line_dedup, test_mixing

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not mounted")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in check_queries.TABLES:
        connection.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_agrees_with_sql(spark, con, name):
    got = Q.QUERIES[name](spark, DATA).toPandas()
    note = check_queries.compare(got, con.execute(Q.ORACLES[name]).df())
    assert not note, note


def test_every_operator_has_one_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in Q.QUERIES) == list(range(1, 14))


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, made = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = cut_lineage(stage(spark, docs, DATA))
        made[name] = (before, docs.collect())
        assert name == "packed_sequences" or docs.columns == columns
    before, after = made["quality_filter"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = {r.doc_id for r in after}
    scores = quality.score(spark.createDataFrame(before), quality.train(spark.createDataFrame(before), spark.read.parquet(f"{DATA}/labels.parquet")))
    assert kept == {r.doc_id for r in scores.collect() if r.score >= quality.THRESHOLD}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in good) >= 0.97 * len(good) and len(kept) < len(before)
    before, after = made["shared_lines"]
    want = {r[0]: r[3] for r in test_line_dedup.brute([(r.doc_id, r.text) for r in before], 10)}
    import hashlib

    assert {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in after} == want
    before, after = made["near_copies"]
    want = {i for i, _, c in test_jaccard.brute([(r.doc_id, r.text) for r in before]) if i == c}
    assert {r.doc_id for r in after} == want
    before, after = made["source_mix"]
    sizes = {}
    for r in before:
        sizes[r.source] = sizes.get(r.source, 0) + test_mixing.words(r.text)
    taken, copies, largest = {}, {}, {}
    for r in after:
        taken[r.source] = taken.get(r.source, 0) + test_mixing.words(r.text)
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    for r in before:
        largest[r.source] = max(largest.get(r.source, 0), test_mixing.words(r.text))
    assert max(copies.values()) <= 3
    assert all(abs(taken.get(s, 0) - t) <= 1.5 * largest[s] + 1 for s, t in test_mixing.targets(sizes).items())
    before, after = made["packed_sequences"]
    fill = {}
    for r in after:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 2048 and sorted({r.doc_id for r in after}) == sorted({r.doc_id for r in before})
    assert len(fill) <= -(-sum(fill.values()) // 2048) + 1
