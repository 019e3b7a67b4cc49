"""Best-fit packing of documents into sequences, improved by swap-based local search.

A document is its ids and an end id. One longer than a sequence is cut from its end into full pieces,
so only its first piece may be shorter. Full pieces are sequences of their own. The others are dealt at
random into shards of bounded size; each shard is packed best-fit, longest first, and then improved:
from the emptiest bins, documents move to fuller ones, are exchanged one for one, or one for two, where
this makes the fuller bin fuller (the sum of squared fills rises), until a bin is empty. A shard stops
when it needs as few bins as its tokens allow, when no exchange helps, or after PASSES rounds of its bins. The bins that stay underfull
in their shards are opened again and packed together, so that what is lost is a few bins per round.

Defined cases: a null or empty text is the end id alone; repeated doc_ids are packed row by row; a null
doc_id stays null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelgauge.llm.common import chunks, ship
from duelgauge.llm.tokens import BLOCK_BYTES, PieceEncoder
from duelgauge.runtime import cut_lineage

CAPACITY = 2048
SHARD_ROWS = 40_000
PASSES = 8  # of the search over the underfull bins of a shard; it mostly ends before
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, slot long"
PACKED = PIECES + ", sequence_id long, offset long, fill long"


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, spaces: bool = True) -> DataFrame:
    """Pieces of at most `capacity` ids with the checksum of their ids, and a number of the piece."""
    ship(__name__)
    ship("duelgauge.llm.tokens")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = PieceEncoder(vocabulary, spaces)
        end = np.array([end_id], "<u4").tobytes()
        seen, seed = 0, TaskContext.get().partitionId() << 40
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        schema = pa.schema(list(zip(("doc_id", "piece", "start", "length", "ids_crc32", "slot"), types)))
        for part in chunks(batches, "text", BLOCK_BYTES):
            rows = []
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(part.column("text"))):
                ids += end
                count = len(ids) // 4
                first = count % capacity or capacity
                edges = [0, *range(first, count + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    rows.append((doc_id, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])))
            columns = list(zip(*rows))
            slots = np.arange(seed + seen, seed + seen + len(rows), dtype=np.int64)
            seen += len(rows)
            arrays = [pa.array(c, t) for c, t in zip([*columns, slots], types)]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing. Bins by room left; the smallest sufficient room is the lowest set bit of a mask."""
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    bins: list[list[int]] = []
    for item in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[item])
        fitting = mask >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            target = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
        else:
            room, target = capacity, len(bins)
            bins.append([])
        bins[target].append(item)
        room -= size
        if room:
            rooms[room].append(target)
            mask |= 1 << room
    return bins


def _exchange(size: np.ndarray, bin_of: np.ndarray, fill: np.ndarray, victim: int, capacity: int) -> bool:
    """One improving move of a document out of the victim bin; False if there is none.

    A change that carries d tokens from a bin filled v to one filled t >= v raises the sum of squared
    fills by 2d(t - v + d) > 0.
    """
    own = np.flatnonzero(bin_of == victim)
    room = capacity - fill
    others = (bin_of != victim) & (fill[bin_of] >= fill[victim]) & (room[bin_of] > 0)
    hosts = np.unique(bin_of[others])
    if not len(hosts):
        return False
    for item in own[np.argsort(-size[own], kind="stable")]:
        fits = hosts[room[hosts] >= size[item]]
        if len(fits):
            host = fits[np.argmin(room[fits])]
            bin_of[item] = host
            fill[host] += size[item]
            fill[victim] -= size[item]
            return True
    there = np.flatnonzero(others)
    for item in own[np.argsort(-size[own], kind="stable")]:
        gain = size[item] - size[there]
        good = np.flatnonzero((gain > 0) & (gain <= room[bin_of[there]]))
        if len(good):
            other = there[good[np.argmax(gain[good])]]
            host, moved = bin_of[other], size[item] - size[other]
            bin_of[item], bin_of[other] = host, victim
            fill[host] += moved
            fill[victim] -= moved
            return True
    # One for two: a document of the victim against two of one host.
    largest = size[own].max()
    order = there[np.argsort(bin_of[there], kind="stable")]
    for group in np.split(order, np.flatnonzero(np.diff(bin_of[order])) + 1):
        host = bin_of[group[0]]
        small = group[size[group] < largest]
        if len(small) < 2:
            continue
        a, b = np.triu_indices(len(small), 1)
        both = size[small[a]] + size[small[b]]
        for item in own:
            gain = size[item] - both
            good = np.flatnonzero((gain > 0) & (gain <= room[host]))
            if len(good):
                k = good[np.argmax(gain[good])]
                bin_of[item] = host
                bin_of[small[a[k]]] = bin_of[small[b[k]]] = victim
                fill[host] += gain[k]
                fill[victim] -= gain[k]
                return True
    # Two for one: two documents of the victim against one of a host.
    if len(own) >= 2:
        a, b = np.triu_indices(len(own), 1)
        for x, y in zip(own[a], own[b]):
            gain = size[x] + size[y] - size[there]
            good = np.flatnonzero((gain > 0) & (gain <= room[bin_of[there]]))
            if len(good):
                k = good[np.argmax(gain[good])]
                other, host = there[k], bin_of[there[k]]
                bin_of[x] = bin_of[y] = host
                bin_of[other] = victim
                fill[host] += gain[k]
                fill[victim] -= gain[k]
                return True
    return False


def local_search(lengths: np.ndarray, bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Empty bins by exchanges among the underfull ones until as few are left as the tokens allow."""
    fills = np.array([lengths[b].sum() for b in bins], np.int64)
    fewest = -(-int(lengths.sum()) // capacity)
    spare = len(bins) - fewest
    open_bins = np.flatnonzero(fills < capacity)
    if spare <= 0 or len(open_bins) < 2:
        return bins
    items = np.concatenate([bins[b] for b in open_bins])
    bin_of = np.repeat(np.arange(len(open_bins)), [len(bins[b]) for b in open_bins])
    size, fill = lengths[items].astype(np.int64), fills[open_bins].copy()
    for _ in range(PASSES):
        before = int((fill * fill).sum())
        for victim in np.argsort(fill, kind="stable").tolist():
            held = fill[victim]
            while fill[victim] and _exchange(size, bin_of, fill, victim, capacity):
                pass
            if held and not fill[victim]:
                spare -= 1
                if not spare:
                    break
        if not spare or int((fill * fill).sum()) == before:
            break
    kept = [bins[b] for b in np.flatnonzero(fills == capacity)]
    order = np.argsort(bin_of, kind="stable")
    edges = np.flatnonzero(np.diff(bin_of[order])) + 1
    return kept + [g.tolist() for g in np.split(items[order], edges) if len(g)]


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    return local_search(lengths, best_fit(lengths, capacity), capacity) if len(lengths) else []


def _round(rows: DataFrame, capacity: int, number: int) -> DataFrame:
    """Pack the rows in shards of about SHARD_ROWS; sequence ids hold the round and the shard."""
    count = rows.count()
    shards = max(1, -(-count // SHARD_ROWS))

    def pack_shard(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "slot", "doc_id", "piece"], ignore_index=True)
        lengths = frame["length"].to_numpy()
        shard = int(frame["shard"].iloc[0])
        sequence, offset, fill = (np.zeros(len(frame), np.int64) for _ in range(3))
        for k, members in enumerate(pack_lengths(lengths, capacity)):
            sizes = lengths[members]
            sequence[members] = ((shard * 4 + number) << 24) + k
            offset[members] = np.cumsum(sizes) - sizes
            fill[members] = sizes.sum()
        frame["sequence_id"], frame["offset"], frame["fill"] = sequence, offset, fill
        return frame.drop(columns="shard")

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("slot", F.lit(number)), F.lit(shards)).cast("int"))
    return cut_lineage(dealt.groupBy("shard").applyInPandas(pack_shard, PACKED))


def pack(docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece with its sequence and its place there."""
    ship(__name__)
    cut = cut_lineage(pieces(docs, vocabulary, end_id, capacity))
    alone = cut.filter(F.col("length") == capacity)
    # A full piece needs no partner: its number, negative, is its sequence.
    alone = alone.withColumns({"sequence_id": -F.col("slot") - 1, "offset": F.lit(0).cast("long")})
    first = _round(cut.filter(F.col("length") < capacity), capacity, 1)
    tight = F.col("fill") >= capacity - capacity // 64
    again = _round(first.filter(~tight).drop("sequence_id", "offset", "fill"), capacity, 2)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return alone.select(columns).unionByName(first.filter(tight).select(columns)).unionByName(again.select(columns))


