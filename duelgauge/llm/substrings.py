"""Removal of repeated passages by seed and extend over words.

Of every window of `window` consecutive words that also starts earlier (in a document that comes before, or
further up in the same one) all words are removed.

*Seeds.* Of the ANCHOR-word sequences of a window the one with the least hash (the rightmost of equals) is its anchor, so
equal windows have equal anchors at equal places. Consecutive windows with one anchor are a run: a seed with as
many words to both sides as its windows reach. A document of n words has about 2 n / (window - ANCHOR + 2) runs.

*Join and extend.* Documents are joined on anchors that occur at least twice. An occurrence whose whole run was seen before
is extended to both ends of the run at once. The first occurrence of a run, where its anchor also stands in other runs, is
extended word by word: each of its windows is looked up among those of the other runs. Pairs are never listed: partners
are found by aggregation (the earliest occurrence of a run, of a window), so work is linear in occurrences however many
share an anchor. Adjoining extensions over the length are united to maximal repeats.

*Skew.* Counts are combined before the shuffle. At most HOT_KEYS anchors can hold more than 1 / HOT_KEYS of all
occurrences each; those are joined by a broadcast (bounded for that reason), all others by a shuffle in which no key is large.
A task never holds more than one block of documents, or the marks of one document, which its own length bounds.

Equal 128-bit hashes stand for equal word sequences.

Defined cases: a null or empty text has no words; documents without doc_id come after all others; rows that share a
doc_id are ordered by a hash of the text, equal rows in any order (all but one of them count as repeats);
an empty table gives no rows; other columns are kept by `without_repeats` and ignored by `digest`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duelgauge.llm.common import chunks, encoded, mixed, ship
from duelgauge.runtime import cut_lineage

WINDOW = 20
ANCHOR = 8
HOT_KEYS = 20_000
BLOCK_BYTES = 4 << 20
BASE = 0x9E3779B97F4A7C15
RUNS = "no long, place long, anchor long, run long"


def inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


def powers(of: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, of, np.uint64)]))


class Words:
    """The words of some documents as hashes in two lanes, with sums that give the hash of any sequence of them."""

    def __init__(self, texts: list[list[bytes]]):
        index: dict[bytes, int] = {}
        self.bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        n = int(self.bounds[-1])
        ids = np.fromiter((index.setdefault(w, len(index)) for t in texts for w in t), np.int64, n)
        lanes = np.frombuffer(b"".join([xxhash.xxh3_128_digest(w) for w in index]), ">u8").astype(np.uint64).reshape(-1, 2)
        ups, self.downs = powers(BASE, n), powers(inverse(BASE), n)
        self.sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(lanes[ids, lane] * ups[:n])]) for lane in (0, 1)]

    def hashes(self, lane: int, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
        total = self.sums[lane]
        return mixed((total[starts + lengths] - total[starts]) * self.downs[starts])


def runs(texts: list[list[bytes]], window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(document, start, windows, anchor hash, run hash) of all runs."""
    words = Words(texts)
    n = int(words.bounds[-1])
    nothing = np.zeros(0, np.int64)
    if n < window:
        return nothing, nothing, nothing, nothing.astype(np.uint64), nothing.astype(np.uint64)
    anchors = words.hashes(0, np.arange(n - anchor + 1), anchor)
    starts = np.arange(n - window + 1)
    least, at = anchors[: len(starts)].copy(), np.zeros(len(starts), np.int64)
    for step in range(1, window - anchor + 1):
        other = anchors[step : step + len(starts)]
        lower = other <= least
        least[lower] = other[lower]
        at[lower] = step
    document = np.searchsorted(words.bounds, starts, side="right") - 1
    inside = np.flatnonzero(starts + window <= words.bounds[document + 1])
    chosen = inside + at[inside]
    fresh = np.ones(len(inside), bool)
    fresh[1:] = (inside[1:] != inside[:-1] + 1) | (chosen[1:] != chosen[:-1])
    first = np.flatnonzero(fresh)
    start, size = inside[first], np.diff(np.append(first, len(inside)))
    shape = mixed((size * (window + 1) + chosen[first] - start).astype(np.uint64))
    run = words.hashes(1, start, size + window - 1) ^ shape
    document = document[start]
    return document, start - words.bounds[document], size, least[start], run


def numbered(docs: DataFrame) -> DataFrame:
    """Adds `no`, unique and rising in the order of documents: doc_id itself where ids are unique, else a place in a stored sorted copy."""
    id_ = F.col("doc_id").cast("long")
    ids = docs.groupBy(id_.alias("no")).count()
    if ids.filter((F.col("count") > 1) | F.col("no").isNull()).isEmpty():
        return docs.withColumn("no", id_)
    keys = [id_.asc_nulls_last(), F.xxhash64("text"), F.monotonically_increasing_id()]
    return cut_lineage(docs.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("no", F.monotonically_increasing_id()))


def all_runs(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """no, place (start * window + windows of the run), anchor, run."""
    ship(__name__)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in chunks(batches, "text", BLOCK_BYTES):
            no = block.column("no").to_numpy()
            document, start, size, seed, run = runs([t.split() for t in encoded(block.column("text").combine_chunks())], window, anchor)
            if len(start):
                yield pa.RecordBatch.from_pydict({"no": no[document], "place": start * window + size, "anchor": seed.view(np.int64), "run": run.view(np.int64)})

    return docs.select("no", "text").mapInArrow(work, RUNS)


def seeded(found: DataFrame) -> DataFrame:
    """The runs whose anchor occurs at least twice, with its number of occurrences."""
    counts = cut_lineage(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("occurrences")).filter("occurrences > 1"))
    total = counts.agg(F.sum("occurrences")).first()[0] or 0
    large = F.col("occurrences") > max(total // HOT_KEYS, 256)  # fewer than HOT_KEYS anchors
    hot = F.broadcast(counts.filter(large))
    by_broadcast = found.join(hot, "anchor")
    by_shuffle = found.join(F.broadcast(counts.filter(large).select("anchor")), "anchor", "left_anti").join(counts.filter(~large), "anchor")
    return cut_lineage(by_broadcast.unionByName(by_shuffle))


def packed_texts(docs: DataFrame, *columns: str) -> DataFrame:
    """The texts compressed, as they go through the joins."""
    ship(__name__)
    schema = T.StructType([docs.schema["no"], *[docs.schema[c] for c in columns], T.StructField("size", T.LongType()), T.StructField("packed", T.BinaryType())])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=3)
        for batch in batches:
            texts = encoded(batch.column("text"))
            packed = [codec.compress(t, asbytes=True) for t in texts]
            arrays = [batch.column(c) for c in ("no", *columns)] + [pa.array([len(t) for t in texts], pa.int64()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return docs.select("no", "text", *columns).mapInArrow(work, schema)


def unpacked(batch: pa.RecordBatch) -> Iterator[list[bytes]]:
    codec = pa.Codec("zstd")
    for size, packed in zip(batch.column("size").to_pylist(), batch.column("packed")):
        yield codec.decompress(packed.as_buffer(), decompressed_size=size, asbytes=True).split() if size else []


def windows_of(docs: DataFrame, open_runs: DataFrame, window: int) -> DataFrame:
    """Every window of the runs in `open_runs` (no, open): hi, lo, no, start."""
    ship(__name__)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans: list[list[bytes]] = []
            where: list[tuple[int, int, int]] = []
            for no, places, words in zip(batch.column("no").to_pylist(), batch.column("open").to_pylist(), unpacked(batch)):
                for place in places:
                    start, size = (place - 1) // window, (place - 1) % window + 1
                    spans.append(words[start : start + size + window - 1])
                    where.append((no, start, size))
                if len(spans) >= 50_000:
                    yield hashed(spans, where)
                    spans, where = [], []
            if spans:
                yield hashed(spans, where)

    def hashed(spans: list[list[bytes]], where: list[tuple[int, int, int]]) -> pa.RecordBatch:
        table = Words(spans)
        no, start, size = np.array(where, np.int64).T
        span = np.repeat(np.arange(len(spans)), size)
        step = np.arange(len(span)) - np.repeat(np.cumsum(size) - size, size)
        at = table.bounds[span] + step
        hi, lo = (table.hashes(lane, at, window).view(np.int64) for lane in (0, 1))
        return pa.RecordBatch.from_pydict({"hi": hi, "lo": lo, "no": no[span], "start": (start[span] + step)})

    packed = packed_texts(docs).join(open_runs, "no")
    return packed.select("no", "size", "packed", "open").mapInArrow(work, "hi long, lo long, no long, start long")


def repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Per document of `numbered` rows with any: no, whole (places of runs seen before), open (places of runs looked
    up by window), first (starts of windows in open runs that nothing earlier equals)."""
    seeds = seeded(all_runs(docs, window, anchor))
    earliest = seeds.groupBy("anchor", "run").agg(
        F.min(F.struct("no", "place")).alias("at"), F.count(F.lit(1)).alias("copies"), F.first("occurrences").alias("occurrences")
    )
    alone = F.when(F.col("copies") == F.col("occurrences"), 2).otherwise(1)
    firsts = earliest.select("at.no", "at.place", alone.alias("kind"))
    kinds = seeds.select("no", "place", F.lit(0).alias("kind")).unionByName(firsts).repartition("no").groupBy("no", "place").agg(F.max("kind").alias("kind"))
    listed = [F.collect_list(F.when(F.col("kind") == k, F.col("place"))).alias(name) for k, name in ((0, "whole"), (1, "open"))]
    marks = cut_lineage(kinds.groupBy("no").agg(*listed))
    windows = windows_of(docs, marks.filter(F.size("open") > 0).select("no", "open"), window)
    own = windows.groupBy("hi", "lo").agg(F.min(F.struct("no", "start")).alias("at")).groupBy(F.col("at.no").alias("no")).agg(F.collect_list("at.start").alias("first"))
    return marks.join(own, "no", "left")


def removed(n: int, whole: list[int], open_: list[int], first: list[int] | None, window: int) -> np.ndarray:
    """Which of n words lie in a window that was seen before."""
    edges = np.zeros(n + 1, np.int64)
    runs_ = (np.array(whole, np.int64) - 1).reshape(-1)
    np.add.at(edges, runs_ // window, 1)
    np.add.at(edges, runs_ // window + runs_ % window + window, -1)
    spans = (np.array(open_, np.int64) - 1).reshape(-1)
    size = spans % window + 1
    starts = np.repeat(spans // window, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    starts = np.setdiff1d(starts, np.array(first or [], np.int64))
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return np.cumsum(edges[:n]) > 0


def _cut(docs: DataFrame, columns: list[str], emit, extra: str, window: int, anchor: int) -> DataFrame:
    """Rows of `columns` with what emit(words, gone) gives for each document."""
    ship(__name__)
    rows = numbered(docs)
    marked = packed_texts(rows, *columns).join(repeats(rows, window, anchor), "no", "left")
    schema = T.StructType([docs.schema[c] for c in columns] + T._parse_datatype_string(extra).fields)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            lists = [batch.column(c).to_pylist() for c in ("whole", "open", "first")]
            for words, whole, open_, first in zip(unpacked(batch), *lists):
                gone = removed(len(words), whole, open_, first, window) if whole or open_ else np.zeros(len(words), bool)
                out.append(emit(words, gone))
            arrays = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(list(c)) for c in zip(*out)], names=schema.names)

    return marked.drop("no").mapInArrow(work, schema)


def kept_text(words: list[bytes], gone: np.ndarray) -> bytes:
    return b" ".join([w for w, g in zip(words, gone.tolist()) if not g])


def digest(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Per document: doc_id, n_words, n_removed and the hash of the words that stay."""

    def emit(words: list[bytes], gone: np.ndarray) -> tuple:
        return len(words), int(gone.sum()), hashlib.sha256(kept_text(words, gone)).hexdigest()

    return _cut(docs.select("doc_id", "text"), ["doc_id"], emit, "n_words long, n_removed long, kept_sha256 string", window, anchor)


def without_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """The documents, all columns kept; where words go, the text is what stays, joined by single spaces, and n_chars follows."""
    columns = [c for c in docs.columns if c != "text"]
    inner = {c: f"c{k}" for k, c in enumerate(columns) if c != "doc_id"}  # names that cannot clash
    plain = docs.select("doc_id", "text", *[F.col(c).alias(n) for c, n in inner.items()])

    def emit(words: list[bytes], gone: np.ndarray) -> tuple:
        return (kept_text(words, gone).decode() if gone.any() else None,)

    given = [c for c in plain.columns if c not in ("doc_id", "text")]
    plain = plain.withColumn("original", F.col("text"))
    made = _cut(plain, ["doc_id", *given, "original"], emit, "kept string", window, anchor)
    text = F.coalesce("kept", "original")
    out = {"doc_id": F.col("doc_id"), "text": text} | {c: F.col(n) for c, n in inner.items()}
    if "n_chars" in inner:
        field = docs.schema["n_chars"]
        out["n_chars"] = F.when(F.col("kept").isNotNull(), F.length("kept").cast(field.dataType)).otherwise(F.col(inner["n_chars"]))
    return made.select(*[out[c].alias(c) for c in docs.columns])
