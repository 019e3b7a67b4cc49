"""Removal of lines that many documents share, through a sharded minimal perfect hash.

A line's key is the line without blanks at both ends, A-Z lower-cased. Keys are hashed to 128 bits.
Hashes found in two or more documents are dealt to shards by their leading bits; each shard is stored
as a minimal perfect hash (bit vectors by level, numbered by rank) over two compact arrays, the 64
other hash bits as fingerprint and the number of documents. Documents are not joined with lines: each
task hashes the lines of a block of documents and probes the arrays. A line of one document only is not
in the arrays, and its fingerprint differs from the one in the slot it is led to.

The arrays reach the tasks in groups of at most GROUP_BYTES (so broadcasts are bounded); a task probes
one group at a time for a block of documents and then lets go of it, however many groups there are.

Defined cases: a null or empty text is one empty line; empty keys (blank lines) are never dropped, for
a key needs at least one character; a line that a document repeats counts once for that document;
repeated rows are documents of their own; an empty table gives no rows; any other columns are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duelgauge.llm.common import chunks, encoded, mixed, ship
from duelgauge.runtime import cut_lineage

MIN_DOCS = 10
SHARD_KEYS = 500_000
GROUP_BYTES = 48 << 20
BLOCK_BYTES = 8 << 20
STRIP = b" \t\n\x0b\x0c\r"
COUNTED = "hi long, lo long, docs long"
SHARDS = "shard int, keys long, index binary"


def line_keys(text: bytes) -> list[bytes]:
    """Keys of all lines of a text; bytes.lower changes A-Z alone."""
    return [line.strip(STRIP) for line in text.lower().split(b"\n")]


def key_hashes(keys: list[bytes]) -> np.ndarray:
    """128-bit hashes as rows of two unsigned 64-bit numbers."""
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(k) for k in keys]), ">u8").astype(np.uint64).reshape(-1, 2)


def count_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """Number of documents that hold each line, summed per block of documents before the shuffle."""
    ship(__name__)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in chunks(batches, text, BLOCK_BYTES):
            found = [k for doc in encoded(block.column(text).combine_chunks()) for k in set(line_keys(doc)) if k]
            if found:
                pairs = np.ascontiguousarray(key_hashes(found)).view([("hi", np.uint64), ("lo", np.uint64)])
                keys, n = np.unique(pairs, return_counts=True)
                yield pa.RecordBatch.from_pydict({"hi": keys["hi"].view(np.int64), "lo": keys["lo"].view(np.int64), "docs": n.astype(np.int64)})

    counted = docs.select(text).mapInArrow(count, COUNTED)
    return counted.groupBy("hi", "lo").agg(F.sum("docs").alias("docs"))


# --- the minimal perfect hash of one shard -------------------------------------------------------


def _position(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
    turn = np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    return (mixed(hi ^ mixed(lo + turn)) % np.uint64(size)).astype(np.int64)


def build_index(hi: np.ndarray, lo: np.ndarray, docs: np.ndarray) -> bytes:
    """Levels of bit vectors: a key that is alone at its position owns that bit, the others go a level down.

    A key's slot is the rank of its bit over all levels, so n keys fill slots 0..n-1.
    """
    sizes, vectors, slots = [], [], np.zeros(len(hi), np.int64)
    left, used, level = np.arange(len(hi)), 0, 0
    while len(left):
        size = max(64, len(left) + len(left) // 4)
        at = _position(hi[left], lo[left], level, size)
        alone = np.bincount(at, minlength=size) == 1
        rank = np.cumsum(alone) - 1
        placed = alone[at]
        slots[left[placed]] = used + rank[at[placed]]
        sizes.append(size)
        vectors.append(np.packbits(alone, bitorder="little"))
        used += int(alone.sum())
        left, level = left[~placed], level + 1
    fingerprint, counts = np.zeros(len(hi), np.uint64), np.zeros(len(hi), np.uint32)
    fingerprint[slots] = lo
    counts[slots] = np.minimum(docs, 0xFFFFFFFF)
    head = np.array([len(hi), len(sizes), *sizes], "<i8")
    return b"".join([head.tobytes(), *[v.tobytes() for v in vectors], fingerprint.tobytes(), counts.tobytes()])


class LineIndex:
    """Probes the arrays of one shard."""

    def __init__(self, raw: bytes):
        n, levels = np.frombuffer(raw, "<i8", 2)
        self.sizes = np.frombuffer(raw, "<i8", levels, 16).tolist()
        at, self.levels, used = 16 + 8 * int(levels), [], 0
        for size in self.sizes:
            bits = np.frombuffer(raw, np.uint8, (size + 7) // 8, at)
            ones = np.bitwise_count(bits)
            self.levels.append((bits, used + np.cumsum(ones, dtype=np.int64) - ones))
            used += int(ones.sum())
            at += len(bits)
        self.fingerprint = np.frombuffer(raw, np.uint64, n, at)
        self.counts = np.frombuffer(raw, np.uint32, n, at + 8 * int(n))

    def documents(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Number of documents per key; 0 for keys that are not in the arrays."""
        out = np.zeros(len(hi), np.int64)
        left = np.arange(len(hi))
        for level, (size, (bits, base)) in enumerate(zip(self.sizes, self.levels)):
            if not len(left):
                break
            at = _position(hi[left], lo[left], level, size)
            byte, bit = at >> 3, (at & 7).astype(np.uint8)
            here = (bits[byte] >> bit) & 1 == 1
            below = bits[byte[here]] & ((np.uint8(1) << bit[here]) - np.uint8(1))
            slot = base[byte[here]] + np.bitwise_count(below)
            same = self.fingerprint[slot] == lo[left[here]]
            out[left[here]] = np.where(same, self.counts[slot], 0)
            left = left[~here]
        return out


def build_shards(counted: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, int]:
    """The stored shards over all lines that more than one document holds, and their number."""
    ship(__name__)
    repeated = cut_lineage(counted.filter(F.col("docs") >= min(2, min_docs)))
    shards = max(1, -(-repeated.count() // SHARD_KEYS))

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["hi", "lo"])
        hi, lo = (frame[c].to_numpy(np.int64).view(np.uint64) for c in ("hi", "lo"))
        raw = build_index(hi, lo, frame["docs"].to_numpy())
        return pd.DataFrame({"shard": [int(frame["shard"].iloc[0])], "keys": [len(frame)], "index": [raw]})

    dealt = repeated.withColumn("shard", shard_of(F.col("hi"), shards))
    return cut_lineage(dealt.groupBy("shard").applyInPandas(build, SHARDS)), shards


def shard_of(hi, shards: int):
    return F.pmod(F.shiftright(hi, 20), F.lit(shards)).cast("int")


Group = list[tuple[int, bytes]]


def grouped_shards(spark: SparkSession, stored: DataFrame) -> list[Broadcast[Group]]:
    """Broadcast the shards in groups of bounded size; the driver holds one group at a time."""
    sizes = stored.select("shard", F.length("index").alias("bytes")).orderBy("shard").collect()
    groups: list[list[int]] = [[]]
    held = 0
    for row in sizes:
        if held and held + row["bytes"] > GROUP_BYTES:
            groups.append([])
            held = 0
        groups[-1].append(row["shard"])
        held += row["bytes"]
    out = []
    for members in groups:
        rows = stored.filter(F.col("shard").isin(members)).select("shard", "index").collect() if members else []
        out.append(spark.sparkContext.broadcast([(r["shard"], bytes(r["index"])) for r in rows]))
    return out


def line_counts(hashes: np.ndarray, groups: list[Broadcast[Group]], shards: int) -> np.ndarray:
    """Documents per hash, probing group after group."""
    hi, lo = hashes[:, 0], hashes[:, 1]
    shard = (hi.view(np.int64) >> 20) % shards
    out = np.zeros(len(hashes), np.int64)
    for group in groups:
        for number, raw in group.value:
            mine = np.flatnonzero(shard == number)
            if len(mine):
                out[mine] = LineIndex(raw).documents(hi[mine], lo[mine])
        if len(groups) > 1:
            group.__dict__.pop("_value", None)  # read again from the executor's disk for the next block
    return out


Emit = Callable[[pa.Table, list[list[bytes]], list[np.ndarray]], pa.Table]


def _probed(docs: DataFrame, index: tuple[list[Broadcast[Group]], int], min_docs: int, emit: Emit, schema: T.StructType, text: str) -> DataFrame:
    groups, shards = index

    def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in chunks(batches, text, BLOCK_BYTES):
            texts = encoded(block.column(text).combine_chunks())
            keys = [line_keys(t) for t in texts]
            distinct = list({k for ks in keys for k in ks if k})
            frequent = set()
            if distinct:
                counts = line_counts(key_hashes(distinct), groups, shards)
                frequent = {distinct[i] for i in np.flatnonzero(counts >= min_docs)}
            dropped = [np.array([k in frequent for k in ks], bool) for ks in keys]
            yield from emit(block, [t.split(b"\n") for t in texts], dropped).to_batches()

    return docs.mapInArrow(probe, schema)


def line_index(docs: DataFrame, min_docs: int = MIN_DOCS, text: str = "text") -> tuple[list[Broadcast[Group]], int]:
    """Count, build and hand out the arrays: what the probing functions take as `index`."""
    stored, shards = build_shards(count_documents(docs, text), min_docs)
    return grouped_shards(docs.sparkSession, stored), shards


def _kept(lines: list[bytes], drop: np.ndarray) -> bytes:
    return b"\n".join([line for line, d in zip(lines, drop.tolist()) if not d])


def digest(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Per document: lines, dropped lines and the hash of what is left."""
    ship(__name__)
    docs = docs.select("doc_id", "text")
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_sha256", T.StringType())])

    def emit(block: pa.Table, lines: list[list[bytes]], dropped: list[np.ndarray]) -> pa.Table:
        return pa.table(
            {
                "doc_id": block.column("doc_id"),
                "n_lines": pa.array([len(x) for x in lines], pa.int64()),
                "n_dropped": pa.array([int(d.sum()) for d in dropped], pa.int64()),
                "kept_sha256": [hashlib.sha256(_kept(x, d)).hexdigest() for x, d in zip(lines, dropped)],
            }
        )

    return _probed(docs, line_index(docs, min_docs), min_docs, emit, schema, "text")


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """The documents without their shared lines, all columns kept; documents that lose nothing keep
    their text as it is (also null), and n_chars, where there is such a column, follows the text."""
    ship(__name__)

    def emit(block: pa.Table, lines: list[list[bytes]], dropped: list[np.ndarray]) -> pa.Table:
        old = block.column("text").to_pylist()
        new = [_kept(x, d).decode() if d.any() else t for t, x, d in zip(old, lines, dropped)]
        block = block.set_column(block.schema.get_field_index("text"), "text", pa.array(new, pa.string()))
        if "n_chars" in block.schema.names:
            at = block.schema.get_field_index("n_chars")
            sizes = [n if t is o else len(t) for n, t, o in zip(block.column("n_chars").to_pylist(), new, old)]
            block = block.set_column(at, "n_chars", pa.array(sizes, block.schema.field(at).type))
        return block

    return _probed(docs, line_index(docs, min_docs), min_docs, emit, docs.schema, "text")
