"""Exact top-k by inner product with pivot-table elimination.

Vectors are scaled to integers. Their distances to a few dozen pivots are computed once per block. For
a query q and a candidate x the triangle inequality gives |q - x| >= max over pivots |d(q,p) - d(x,p)|,
hence an upper bound of the inner product, (|q|^2 + |x|^2 - bound^2) / 2. Candidates are evaluated in the
order of that bound; the search in a block stops, exactly, when the next bound lies below the k-th score
found. Blocks are independent and bounded; their k best are merged by Spark.

Pivots are PIVOTS rows, the first in hash order: a bounded sample that can change the speed only.
Scores are exact while their partial sums stay below 2^53, which floating matrix products represent;
larger vectors are multiplied as 64-bit integers, exact below 2^63.

Defined cases: see vectors.usable; a query that no other row can answer has no rows; fewer than k
candidates give all of them; ties go to the smaller vec_id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelgauge.llm import vectors as V
from duelgauge.llm.common import ship
from duelgauge.runtime import cut_lineage

PIVOTS = 32
BLOCK_ROWS = 16_384
QUERY_ROWS = 1_024
FIRST_LOOK = 256
EXACT = float(2**53)


def scaled(x: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(x * scale)


def pivot_distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2.0 * (x @ pivots.T)
    return np.sqrt(np.maximum(squares, 0.0))


def scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of x with q."""
    if len(x) and float(np.abs(x).max()) * float(np.abs(q).max()) * x.shape[1] < EXACT:
        return (x @ q).astype(np.int64)
    return x.astype(np.int64) @ q.astype(np.int64)


def search_block(q: np.ndarray, q_id: int, q_pivots: np.ndarray, x: np.ndarray, ids: np.ndarray, x_pivots: np.ndarray, x_squares: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(ids, scores, evaluated): the block's k best for one query, other than its own row."""
    bound = np.zeros(len(x))
    for p in range(x_pivots.shape[1]):
        np.maximum(bound, np.abs(x_pivots[:, p] - q_pivots[p]), out=bound)
    both = x_squares + float(q @ q)
    upper = (both - bound * bound) / 2 + both * 1e-9 + 1.0  # room for rounding of the distances
    upper[ids == q_id] = -np.inf
    order = np.argsort(-upper)
    at, step = 0, FIRST_LOOK
    best_ids, best_scores = np.empty(0, np.int64), np.empty(0, np.int64)
    while at < len(order) and upper[order[at]] > -np.inf:
        if len(best_scores) >= k and upper[order[at]] < best_scores[-1]:
            break
        look = order[at : at + step]
        look = look[upper[look] > -np.inf]
        got_ids = np.concatenate([best_ids, ids[look]])
        got = np.concatenate([best_scores, scores(x[look], q)])
        keep = V.top(got_ids, got, k)
        best_ids, best_scores = got_ids[keep], got[keep]
        at, step = at + step, step * 2
    return best_ids, best_scores, at


def exact_top_k(embeddings: DataFrame, is_query: Column, k: int = 10, scale: float = 1024.0) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query row."""
    ship(__name__)
    ship("duelgauge.llm.vectors")
    rows = cut_lineage(V.usable(embeddings))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).select("dim", "vector").collect()
    pivots: dict[int, np.ndarray] = {}
    for d in {r["dim"] for r in sample}:
        pivots[d] = scaled(V.matrix([r["vector"] for r in sample if r["dim"] == d]), scale)

    def distances(x: np.ndarray) -> np.ndarray:
        own = pivots.get(x.shape[1])
        return pivot_distances(x, own) if own is not None else np.zeros((len(x), 1))

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("vec_id")
        x = scaled(V.matrix(frame["vector"]), scale)
        first = frame.iloc[0]
        return pd.DataFrame(
            {
                "dim": [int(first["dim"])],
                "block": [int(first["block"])],
                "ids": [frame["vec_id"].to_numpy(np.int64).tobytes()],
                "vectors": [x.tobytes()],
                "extra": [distances(x).tobytes()],
            }
        )

    blocks = V.packed(rows, BLOCK_ROWS, build)
    queries = V.packed(rows.filter(is_query), QUERY_ROWS, build)

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        for batch in batches:
            for cell in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                ids, q_ids = (np.frombuffer(cell[c], np.int64) for c in ("ids", "query_ids"))
                x, q = (np.frombuffer(cell[c]).reshape(-1, cell["dim"]) for c in ("vectors", "queries"))
                table, squares, q_table = np.frombuffer(cell["extra"]).reshape(len(x), -1), (x * x).sum(1), distances(q)
                found = [search_block(q[i], int(q_ids[i]), q_table[i], x, ids, table, squares, k) for i in range(len(q))]
                of = np.repeat(q_ids, [len(f[0]) for f in found])
                columns = [of, np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    found = V.meet(queries, blocks).mapInArrow(search, V.FOUND.format("long"))
    return V.best(found, k)
