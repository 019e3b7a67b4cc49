"""Approximate nearest neighbours: one navigable small-world graph with layers per shard.

Equal vectors are one node, which carries the k + 1 smallest of their vec_ids: no query can be given more of
them, its own left out. Every node is in exactly one shard, dealt by hash, of at most about SHARD_ROWS. A shard's graph is
stored as flat arrays: per layer the node numbers and a matrix of neighbour numbers (-1: none). Layers are
built from the top down; a layer's nodes are inserted in batches: the layers above give the entry, a beam
search in the layer built so far gives candidates, and a node is linked to those that are closer to it
than to any neighbour already chosen. Queries run through all shards in batches (the beam search of a
whole batch is a few array operations per step); Spark merges what the shards found.

Largest inner product is made a distance by one more dimension, sqrt(M^2 - |x|^2) with M the shard's
largest norm, in which the closest point is the one with the largest product. Scores that are returned
are inner products of the original vectors in double precision.

Defined cases: see vectors.usable (zero vectors take no part either); fewer than k candidates give all;
ties go to the smaller vec_id; shards of at most `beam` rows are searched whole, so that small tables
are exact; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelgauge.llm import vectors as V
from duelgauge.llm.common import ship
from duelgauge.runtime import cut_lineage

SHARD_ROWS = 8_192
QUERY_ROWS = 1_024
LINKS = 16
BATCH = 256
BUILD_BEAM = 64
SEARCH_BEAM = 160
EXPAND = 4

Layer = tuple[np.ndarray, np.ndarray]  # node numbers, neighbours by node number


def lifted(x: np.ndarray) -> np.ndarray:
    """Rows with one more component, so that all have one norm and the smallest distance is the largest product."""
    squares = (x * x).sum(1)
    rest = np.sqrt(np.maximum(squares.max() - squares, 0.0))
    return np.concatenate([x, rest[:, None]], axis=1).astype(np.float32)


def distances_to(points: np.ndarray, squares: np.ndarray, q: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Squared distance, less |q|^2, of each row of q to its row of nodes (-1: infinite)."""
    near = points[nodes]
    d = squares[nodes] - 2.0 * np.matmul(near, q[:, :, None])[:, :, 0]
    d[nodes < 0] = np.inf
    return d


def beam_search(points: np.ndarray, squares: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, beam: int, expand: int = EXPAND) -> tuple[np.ndarray, np.ndarray]:
    """Best `beam` nodes for each row of q: (nodes, distances), nearest first, -1 where fewer were reached."""
    rows = np.arange(len(q))
    width = max(beam, entry.shape[1])
    nodes = np.full((len(q), width), -1, np.int32)
    dist = np.full((len(q), width), np.inf, np.float32)
    done = np.ones((len(q), width), bool)
    seen = np.zeros((len(q), len(points) + 1), bool)  # the last column takes the -1
    nodes[:, : entry.shape[1]] = entry
    dist[:, : entry.shape[1]] = distances_to(points, squares, q, entry)
    done[:, : entry.shape[1]] = entry < 0
    seen[rows[:, None], entry] = True
    while len(rows):
        waiting = np.where(done[rows], np.inf, dist[rows])
        step = min(expand, width)
        pick = np.argpartition(waiting, step - 1, axis=1)[:, :step]
        open_ = np.isfinite(np.take_along_axis(waiting, pick, 1))
        alive = open_.any(1)
        rows, pick, open_ = rows[alive], pick[alive], open_[alive]
        if not len(rows):
            break
        chosen = np.where(open_, nodes[rows[:, None], pick], -1)
        marked = done[rows]
        np.put_along_axis(marked, pick, True, 1)
        done[rows] = marked
        found = np.where(chosen[:, :, None] >= 0, links[chosen], -1).reshape(len(rows), -1)
        found = np.where(seen[rows[:, None], found], -1, found)
        found.sort(axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        seen[rows[:, None], found] = True
        d = distances_to(points, squares, q[rows], found)
        all_nodes = np.concatenate([nodes[rows], found], axis=1)
        all_dist = np.concatenate([dist[rows], d], axis=1)
        all_done = np.concatenate([done[rows], found < 0], axis=1)
        keep = np.argpartition(all_dist, width - 1, axis=1)[:, :width]
        nodes[rows] = np.take_along_axis(all_nodes, keep, 1)
        dist[rows] = np.take_along_axis(all_dist, keep, 1)
        done[rows] = np.take_along_axis(all_done, keep, 1)
    order = np.argsort(dist, axis=1, kind="stable")[:, :beam]
    return np.take_along_axis(nodes, order, 1), np.take_along_axis(dist, order, 1)


def choose_links(points: np.ndarray, squares: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, limit: int) -> np.ndarray:
    """Up to `limit` neighbours per node: nearest first, those closer to the node than to a chosen one;
    then the nearest of the others while there is room. Candidates are distinct; -1 stands for none."""
    d = distances_to(points, squares, points[nodes], candidates) + squares[nodes][:, None]
    order = np.argsort(d, axis=1, kind="stable")
    candidates, d = np.take_along_axis(candidates, order, 1), np.take_along_axis(d, order, 1)
    near = points[candidates]
    own = squares[candidates]
    apart = own[:, :, None] + own[:, None, :] - 2.0 * np.matmul(near, near.transpose(0, 2, 1))
    taken = np.zeros(candidates.shape, bool)
    closest = np.full(candidates.shape, np.inf, np.float32)  # distance to the nearest chosen one
    for c in range(candidates.shape[1]):
        good = (candidates[:, c] >= 0) & (d[:, c] < closest[:, c]) & (taken.sum(1) < limit)
        taken[:, c] = good
        closest[good] = np.minimum(closest[good], apart[good, c])
    rank = np.where(taken, 0, np.where(candidates >= 0, 1, 2)) * candidates.shape[1] + np.arange(candidates.shape[1])
    order = np.argsort(rank, axis=1)[:, :limit]
    out = np.take_along_axis(candidates, order, 1)
    if out.shape[1] < limit:
        out = np.concatenate([out, np.full((len(out), limit - out.shape[1]), -1, out.dtype)], axis=1)
    return out


def add_back_links(points: np.ndarray, squares: np.ndarray, links: np.ndarray, new: np.ndarray) -> None:
    """Link the chosen neighbours back to the new nodes, choosing anew where a list is full."""
    limit = links.shape[1]
    source = np.repeat(new, limit)
    target = links[new].ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    hosts, start, count = np.unique(target, return_index=True, return_counts=True)
    for at in range(0, len(hosts), BATCH):
        h, s, c = hosts[at : at + BATCH], start[at : at + BATCH], count[at : at + BATCH]
        added = np.full((len(h), c.max()), -1, np.int32)
        place = np.arange(c.max())[None, :] < c[:, None]
        added[place] = source[(s[:, None] + np.arange(c.max()))[place]]
        both = np.concatenate([links[h], added], axis=1)
        both.sort(axis=1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        links[h] = choose_links(points, squares, h, both, limit)


def build_graph(x: np.ndarray, links: int = LINKS, beam: int = BUILD_BEAM, seed: int = 7) -> list[Layer]:
    """Layers from the top to the ground; a node's highest layer is geometric with ratio 1 / links."""
    points = lifted(x)
    squares = (points * points).sum(1)
    n = len(points)
    height = np.floor(-np.log(1.0 - np.random.default_rng(seed).random(n)) / np.log(links)).astype(int)
    order = np.argsort(-height, kind="stable").astype(np.int32)
    layers: list[Layer] = []
    for level in range(int(height.max()), -1, -1):
        members = order[: int((height >= level).sum())]
        limit = links * 2 if level == 0 else links
        graph = np.full((n + 1, limit), -1, np.int32)  # the last row answers -1
        begin = min(len(members), max(BATCH, len(layers[-1][0]) if layers else 0))
        for at in range(0, begin, BATCH):  # the first nodes see each other all
            part = members[at : min(at + BATCH, begin)]
            near = squares[members[:begin]][None, :] - 2.0 * (points[part] @ points[members[:begin]].T)
            near[np.arange(len(part)), np.arange(at, at + len(part))] = np.inf
            keep = np.argpartition(near, min(beam, begin - 1) - 1, axis=1)[:, : min(beam, begin - 1)] if begin > 1 else np.empty((1, 0), int)
            if keep.shape[1]:
                graph[part] = choose_links(points, squares, part, members[:begin][keep].astype(np.int32), limit)
        if begin > 1:
            add_back_links(points, squares, graph, members[:begin])
        for at in range(begin, len(members), BATCH):
            part = members[at : at + BATCH]
            q = points[part]
            entry = descend(points, squares, layers, q) if layers else np.repeat(members[None, :1], len(q), 0)
            found, _ = beam_search(points, squares, graph, q, entry, beam)
            same = squares[part][None, :] - 2.0 * (q @ q.T)
            np.fill_diagonal(same, np.inf)
            mates = part[np.argsort(same, axis=1)[:, : min(links, len(part) - 1)]]
            graph[part] = choose_links(points, squares, part, np.concatenate([found, mates], axis=1), limit)
            add_back_links(points, squares, graph, part)
        layers.append((members, graph))
    return layers


def descend(points: np.ndarray, squares: np.ndarray, layers: list[Layer], q: np.ndarray) -> np.ndarray:
    """Entry nodes for the next layer: a narrow search down the given layers."""
    entry = np.repeat(layers[0][0][None, :1], len(q), 0)
    for _, graph in layers:
        entry, _ = beam_search(points, squares, graph, q, entry, 4)
    return entry


def search_graph(x: np.ndarray, layers: list[Layer], q: np.ndarray, beam: int) -> np.ndarray:
    """Node numbers found for each row of q (-1: none)."""
    if len(x) <= beam:
        return np.repeat(np.arange(len(x), dtype=np.int32)[None, :], len(q), 0)
    points = lifted(x)
    squares = (points * points).sum(1)
    q = np.concatenate([q, np.zeros((len(q), 1))], axis=1).astype(np.float32)
    entry = descend(points, squares, layers[:-1], q) if len(layers) > 1 else np.repeat(layers[0][0][None, :1], len(q), 0)
    return beam_search(points, squares, layers[-1][1], q, entry, beam)[0]


def flat(layers: list[Layer]) -> bytes:
    """All layers in one run of 32-bit numbers: layer count, then per layer sizes, nodes and their neighbours."""
    parts = [np.array([len(layers)], np.int32)]
    for members, graph in layers:
        parts += [np.array([len(members), graph.shape[1]], np.int32), members.astype(np.int32), graph[members].ravel()]
    return np.concatenate(parts).tobytes()


def unflat(raw: bytes, n: int) -> list[Layer]:
    data, at, layers = np.frombuffer(raw, np.int32), 1, []
    for _ in range(int(data[0])):
        size, limit = int(data[at]), int(data[at + 1])
        members = data[at + 2 : at + 2 + size]
        at += 2 + size
        graph = np.full((n + 1, limit), -1, np.int32)
        graph[members] = data[at : at + size * limit].reshape(size, limit)
        at += size * limit
        layers.append((members, graph))
    return layers


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """One row per vector: its smallest vec_id, and its k + 1 smallest (each task keeps no more of a vector)."""
    order = Window.partitionBy("vector").orderBy("vec_id")
    first = rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1)
    one = first.groupBy("vector").agg(F.min("vec_id").alias("vec_id"), F.sort_array(F.collect_list("vec_id")).alias("copies"))
    return cut_lineage(one.withColumn("dim", F.size("vector")))


def build_index(nodes: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One stored row per shard: ids of all nodes, vectors, and number of ids of each node before the graph."""
    ship(__name__)
    ship("duelgauge.llm.vectors")

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("vec_id")
        x, first = V.matrix(frame["vector"]), frame.iloc[0]
        row = {"dim": int(first["dim"]), "block": int(first["block"]), "ids": np.concatenate(list(frame["copies"])).astype(np.int64).tobytes()}
        counts = np.array([len(c) for c in frame["copies"]], np.int32)
        return pd.DataFrame([row | {"vectors": x.tobytes(), "extra": counts.tobytes() + flat(build_graph(x))}])

    return V.packed(nodes, shard_rows, build)


def nearest(embeddings: DataFrame, is_query: Column, k: int = 20, beam: int = SEARCH_BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found for each query row, its own row left out."""
    rows = cut_lineage(V.usable(embeddings, nonzero=True))
    index = build_index(distinct_vectors(rows, k))

    def gather(frame: pd.DataFrame) -> pd.DataFrame:
        frame, first = frame.sort_values("vec_id"), frame.iloc[0]
        row = {"dim": int(first["dim"]), "block": int(first["block"]), "ids": frame["vec_id"].to_numpy(np.int64).tobytes()}
        return pd.DataFrame([row | {"vectors": V.matrix(frame["vector"]).tobytes(), "extra": b""}])

    queries = V.packed(rows.filter(is_query), QUERY_ROWS, gather)

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        for batch in batches:
            for cell in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                ids, q_ids = (np.frombuffer(cell[c], np.int64) for c in ("ids", "query_ids"))
                x, q = (np.frombuffer(cell[c]).reshape(-1, cell["dim"]) for c in ("vectors", "queries"))
                counts = np.frombuffer(cell["extra"], np.int32, len(x))
                start = np.cumsum(counts) - counts
                layers = unflat(cell["extra"][counts.nbytes :], len(x))
                of, got, score = [], [], []
                for at in range(0, len(q), BATCH):
                    found = search_graph(x, layers, q[at : at + BATCH], beam)
                    for i, nodes in enumerate(found):
                        nodes = nodes[nodes >= 0]
                        n = counts[nodes]
                        copy = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                        named = ids[np.repeat(start[nodes], n) + copy]
                        products = np.repeat(x[nodes] @ q[at + i], n)
                        named, products = named[named != q_ids[at + i]], products[named != q_ids[at + i]]
                        keep = V.top(named, products, k)
                        of.append(np.full(len(keep), q_ids[at + i]))
                        got.append(named[keep])
                        score.append(products[keep])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (of, got, score)], schema=schema)

    return V.best(V.meet(queries, index).mapInArrow(search, V.FOUND.format("double")), k)
