"""Exact and graph search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duelgauge.llm import hnsw, topk
from duelgauge.llm import vectors as V

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("dim", T.StringType()), T.StructField("block", T.StringType())])


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA)


def awkward(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4) / 4]) for i in range(300)]  # many ties
    rows += [(300, None), (301, []), (302, [1.0, None, 1.0, 1.0]), (303, [float("nan")] * 4), (304, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4)]
    rows += [(400, [1.0, 2.0]), (500, [3.0, -1.0]), (600, [0.5]), (700, [0.0] * 4), (20, rows[20][1])]
    return frame(spark, rows), {i: v for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}


def brute(rows, step, k, scale=None, nonzero=False):
    if nonzero:
        rows = {i: v for i, v in rows.items() if any(v)}
    value = {i: np.floor(scale * np.array(v)) if scale else np.array(v) for i, v in rows.items()}
    out = []
    for q in sorted(i for i in value if i % step == 0):
        same = [i for i in value if i != q and len(value[i]) == len(value[q])]
        best = sorted(same, key=lambda i: (-float(value[i] @ value[q]), i))[:k]
        out += [(q, r + 1, i, float(value[i] @ value[q])) for r, i in enumerate(best)]
    return out


def listed(df):
    return sorted((r.query_id, r["rank"], r.vec_id, float(r.score)) for r in df.collect())


@pytest.mark.parametrize("block", [16_384, 37])
def test_exact_top_k(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK_ROWS", block)
    monkeypatch.setattr(topk, "QUERY_ROWS", 2)
    monkeypatch.setattr(topk, "FIRST_LOOK", 8)
    df, rows = awkward(spark)
    assert listed(topk.exact_top_k(df, F.col("vec_id") % 100 == 0)) == brute(rows, 100, 10, scale=1024)


def test_elimination_skips_far_candidates():
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 1, (20, 16))
    x = np.floor(1024 * (np.repeat(centres, 100, 0) + rng.normal(0, 0.05, (2000, 16))))
    pivots = x[::100][:20]
    table = topk.pivot_distances(x, pivots)
    ids, scores, looked = topk.search_block(x[7], 7, table[7], x, np.arange(2000), table, (x * x).sum(1), 10)
    product = (x @ x[7]).astype(int)
    product[7] = np.iinfo(int).min
    assert scores.tolist() == sorted(product.tolist(), reverse=True)[:10] and looked < 2000


def test_large_components_use_whole_numbers():
    x = np.full((3, 2), 2.0**30)
    assert topk.scores(x, x[0]).tolist() == [2**61] * 3


def test_graph_search_of_small_tables_is_exact(spark):
    df, rows = awkward(spark)
    got = hnsw.nearest(df, F.col("vec_id") % 20 == 0, beam=400)
    assert listed(got) == brute(rows, 20, 20, nonzero=True)


def test_empty_tables(spark):
    none = frame(spark, []) if False else spark.createDataFrame([], SCHEMA)
    assert topk.exact_top_k(none, F.col("vec_id") % 100 == 0).count() == 0
    assert hnsw.nearest(none, F.col("vec_id") % 20 == 0).count() == 0


def test_graph_recall_and_arrays():
    rng = np.random.default_rng(7)
    x = rng.normal(0, 1, (3000, 32)) * rng.uniform(0.5, 2.0, (3000, 1))  # lengths differ
    layers = hnsw.unflat(hnsw.flat(hnsw.build_graph(x)), len(x))
    q = x[::20]
    found = hnsw.search_graph(x, layers, q, hnsw.SEARCH_BEAM)
    hits = 0
    for k, nodes in enumerate(found):
        product = x @ q[k]
        product[20 * k] = -np.inf
        hits += len(set(np.argsort(-product)[:20]) & set(nodes.tolist()))
    assert hits / (20 * len(q)) >= 0.9


def test_recall_on_the_driver_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = {r.vec_id: np.array(r.embedding, float) for r in df.collect()}
    got = hnsw.nearest(df, F.col("vec_id") % 20 == 0).collect()
    ids = np.array(sorted(rows))
    x = np.array([rows[i] for i in ids])
    hits = 0
    for q in ids[ids % 20 == 0]:
        s = x @ rows[q]
        s[ids == q] = -np.inf
        hits += len(set(ids[np.argsort(-s)[:20]].tolist()) & {r.vec_id for r in got if r.query_id == q})
    assert hits / len(got) >= 0.9
    assert all(abs(r.score - float(rows[r.vec_id] @ rows[r.query_id])) < 1e-12 for r in got[:200])


def test_one_vector_per_id(spark):
    df = frame(spark, [(1, [2.0]), (1, [1.0]), (2, [5.0])])
    assert {r.vec_id: r.vector for r in V.usable(df).collect()} == {1: [1.0], 2: [5.0]}


def test_graph_search_with_a_third_of_equal_rows(spark):
    rng = np.random.default_rng(8)
    x = rng.integers(-64, 65, (8_192, 16)) / 64
    x[rng.permutation(8_192)[: 8_192 // 3]] = x[0]
    alike = np.flatnonzero((x == x[0]).all(1)).tolist()
    got = hnsw.nearest(frame(spark, enumerate(x.tolist())), F.col("vec_id") % 20 == 0).collect()
    for q in [i for i in alike if i % 20 == 0]:
        assert sorted(r.vec_id for r in got if r.query_id == q) == [i for i in alike if i != q][:20]
