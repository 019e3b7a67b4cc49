"""Vectors as blocks: cleaning, dealing into bounded blocks, meeting of query groups and blocks, top k."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelgauge.runtime import cut_lineage

BLOCKS = "dim int, block int, ids binary, vectors binary, extra binary"
FOUND = "query_id long, vec_id long, score {}"


def usable(embeddings: DataFrame, nonzero: bool = False) -> DataFrame:
    """vec_id, dim and vector (doubles) of the rows that take part.

    Left out: null ids, null or empty vectors, vectors with null or non-finite components and, on request,
    zero vectors. Of several rows with one vec_id the smallest vector counts. Vectors meet only vectors
    of their own length.
    """
    value = F.col("embedding").cast("array<double>")
    kept = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), value.alias("vector"))
    kept = kept.filter(F.col("vec_id").isNotNull() & (F.size("vector") > 0))
    kept = kept.filter(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    if nonzero:
        kept = kept.filter(F.exists("vector", lambda x: x != 0))
    one = kept.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    return one.withColumn("dim", F.size("vector"))


def dealt(rows: DataFrame, per_block: int) -> DataFrame:
    """Adds `block`: every length is dealt by a hash of vec_id into blocks of about `per_block` rows."""
    counts = {r["dim"]: r["count"] for r in rows.groupBy("dim").count().collect()}  # one row per vector length
    blocks = {d: max(1, -(-n // per_block)) for d, n in counts.items()} or {0: 1}
    number = F.create_map(*[F.lit(x) for item in sorted(blocks.items()) for x in item])[F.col("dim")]
    return rows.withColumn("blocks", number).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))


def meet(queries: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every group of queries with every block of its vector length. Both are packed, bounded rows; the
    work is what an exact or sharded search of a stated query set against all rows has to do."""
    counts = blocks.groupBy("dim").agg((F.max("block") + 1).alias("n"))
    spread = queries.join(F.broadcast(counts), "dim").select(
        "dim", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("block"), F.col("ids").alias("query_ids"), F.col("vectors").alias("queries")
    )
    return spread.join(blocks, ["dim", "block"])


def packed(rows: DataFrame, per_block: int, build, schema: str = BLOCKS) -> DataFrame:
    """One stored row per block, made by `build(frame)` from the block's rows in vec_id order."""
    return cut_lineage(dealt(rows, per_block).groupBy("dim", "block").applyInPandas(build, schema))


def matrix(vectors) -> np.ndarray:
    return np.array([np.asarray(v) for v in vectors], np.float64)


def best(found: DataFrame, k: int, score: Column | None = None) -> DataFrame:
    """The k best of what the blocks found for each query: highest score, then smallest vec_id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def top(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))][:k]
