"""N-gram Jaccard join: size-aware, with subsets for light sets and inverted lists for heavy ones.

A document's set holds the 64-bit hashes of its distinct five-word shingles. Two sets link when
100 |A and B| >= 80 |A or B|, so a set of size s shares at least o = ceil(0.8 s) shingles with any partner.

1. Classes. Documents with one set are one class; all further work is on classes.
2. Screening. In hash order the first s - o + c shingles of a set (c about a twentieth of s) hold at least c
   common ones with any partner. Classes with fewer than c of theirs in other classes' prefixes are alone.
3. Order. For the classes that are left the number of classes per shingle is counted; shingles of one class
   can match nothing and go, and so do classes with fewer than o others. Rare shingles come first.
4. Keys. A light set gives every 2-subset of its first m - o + 2 shingles (m: those left): partners have
   the two first common ones in both. A heavy set gives its first m - o + 1 shingles as entries of
   inverted lists, and so do the light sets that are large enough for a heavy partner. The size up to
   which sets are light is the one with the least cost, subsets against the lengths of the lists.
5. Links. Every class is compared with the centre of its size that shares most keys with it; this joins
   groups of near copies without forming their pairs. Then at each key stay the classes that sizes and
   overlap bounds allow to link with one of another component there. In rounds, classes outside the
   largest component of a key (pivots, a bounded number) are compared with all others of the key, which
   lie in salted cells, and leave it; links join components, so that fewer classes stay for the next
   round. No row but a pivot is repeated, and pivots are a quarter of a cell. Every link joins two classes
   that are in one component or become so.

Comparisons are exact on the full sets. Blocks, lists and cells that Python holds are bounded; what has
to meet is shuffled by shingle, class or key.

Defined cases: null, empty and blank texts have no set: they link with nothing; a text of one to four
words is one shingle; repeated rows are one class; a null doc_id belongs to its class but is no
component's name unless all are null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duelgauge.llm.common import chunks, encoded, mixed, ship
from duelgauge.runtime import cut_lineage, shuffle_width

WORDS = 5
PERCENT = 80
BLOCK_BYTES = 6 << 20
SHARD_SHINGLES = 1_000_000
CELL_ROWS = 16_384  # members of a key that one cell holds, on average
PIVOTS = CELL_ROWS // 4  # members of a key that meet all others in one round
CENTRE_KEYS = 16  # keys by which a class looks for its centre; exact rounds follow
PAIR_ROWS = 128
FILTER_WORDS = 1 << 17  # 64-bit words of the filter of doc_ids: one megabyte, whatever the data
REMEMBERED = 200_000
SETS = "doc_id long, class long, n_shingles long, prefix binary"
POSTED = "shard int, shingles binary, classes binary"
BUCKETS = "bucket int, classes binary, numbers binary"


def needed(size):
    """Least number of common shingles with any partner."""
    return -(-PERCENT * size // 100)


def screen(size: int) -> int:
    """Common shingles that the longer prefix has to hold."""
    return max(1, size // 20)


class WordHashes(dict):
    """64-bit hashes of words; what does not fit the memory is computed anew."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < REMEMBERED:
            self[word] = h
        return h


def shingle_set(text: bytes, known: WordHashes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes; bytes.lower and bytes.split know ASCII alone."""
    found = text.lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    span = min(words, len(h))
    mix = np.full(len(h) - span + 1, span, np.uint64)
    for k in range(span):
        mix = mixed(mix ^ h[k : len(h) - span + 1 + k]) + np.uint64(k)
    return np.unique(mix)


def class_of(tokens: np.ndarray) -> int:
    """Identity of a set."""
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def _sharded(tokens: np.ndarray, classes: np.ndarray, shards: int) -> pa.RecordBatch:
    """Postings of a block, one row per shard."""
    shard = (tokens >> np.uint64(7)) % np.uint64(shards)
    order = np.argsort(shard, kind="stable")
    numbers, starts = np.unique(shard[order], return_index=True)
    t, c = tokens[order], classes[order]
    ends = [*starts[1:].tolist(), len(t)]
    return pa.RecordBatch.from_pydict(
        {
            "shard": pa.array(numbers.astype(np.int32)),
            "shingles": pa.array([t[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
            "classes": pa.array([c[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
        }
    )


def _postings(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (shingle, class) pairs of a shard whose shingle has several classes, and their number."""
    t = np.frombuffer(b"".join(frame["shingles"]), np.uint64)
    c = np.frombuffer(b"".join(frame["classes"]), np.int64)
    order = np.lexsort((c, t))
    t, c = t[order], c[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (c[1:] != c[:-1])
    t, c = t[new], c[new]
    starts = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1]))) if len(t) else np.empty(0, int)
    counts = np.diff([*starts, len(t)])
    df = np.repeat(counts, counts)
    return t[df > 1], c[df > 1], df[df > 1]


def _by_bucket(classes: np.ndarray, values: np.ndarray, buckets: int) -> pd.DataFrame:
    """Numbers of classes on their way back to them, one row per bucket of classes."""
    bucket = classes % buckets
    order = np.argsort(bucket, kind="stable")
    numbers, starts = np.unique(bucket[order], return_index=True)
    c, v = classes[order], values[order]
    ends = [*starts[1:].tolist(), len(c)]
    return pd.DataFrame(
        {
            "bucket": numbers.astype(np.int32),
            "classes": [c[a:b].tobytes() for a, b in zip(starts, ends)],
            "numbers": [v[a:b].tobytes() for a, b in zip(starts, ends)],
        }
    )


def _of_bucket(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(frame["classes"]), np.int64), np.frombuffer(b"".join(frame["numbers"]), np.int64)


# --- 1 and 2: classes and screening -----------------------------------------------------------------


def document_sets(docs: DataFrame) -> DataFrame:
    """doc_id, class and size of the set of every document, stored; class is null for empty sets.

    prefix: the first shingles in hash order that screening counts, once per class and block.
    """

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for block in chunks(batches, "text", BLOCK_BYTES):
            classes, sizes, prefixes, seen = [], [], [], set()
            for text in encoded(block.column("text").combine_chunks()):
                s = shingle_set(text, known)
                n, c = len(s), class_of(s) if len(s) else None
                classes.append(c)
                sizes.append(n)
                # Sets of up to three shingles link with equal ones only.
                prefixes.append(s[: n - needed(n) + screen(n)].tobytes() if n > 3 and c not in seen else None)
                seen.add(c)
            arrays = [block.column("doc_id").combine_chunks().cast(pa.int64()), pa.array(classes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(prefixes, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "class", "n_shingles", "prefix"])

    return cut_lineage(docs.select("doc_id", "text").mapInArrow(read, SETS))


def screened(sets: DataFrame) -> DataFrame:
    """Classes that can have a partner: enough of their hash-order prefix occurs in another class's."""
    found = sets.filter("prefix IS NOT NULL").select("class", "prefix")
    totals = (found.agg(F.sum(F.length("prefix"))).first()[0] or 0) // 8
    shards = max(shuffle_width(sets.sparkSession), totals // SHARD_SHINGLES)

    def prefixes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in chunks(batches, "prefix", BLOCK_BYTES):
            raw = block.column("prefix").to_pylist()
            classes = np.repeat(block.column("class").to_numpy(), [len(p) // 8 for p in raw])
            yield _sharded(np.frombuffer(b"".join(raw), np.uint64), classes, shards)

    def shared(frame: pd.DataFrame) -> pd.DataFrame:
        classes, counts = np.unique(_postings(frame)[1], return_counts=True)
        return _by_bucket(classes, counts, shards)

    def total(frame: pd.DataFrame) -> pd.DataFrame:
        c, counts = _of_bucket(frame)
        classes, place = np.unique(c, return_inverse=True)
        return pd.DataFrame({"class": classes, "shared": np.bincount(place, counts, len(classes)).astype(np.int64)})

    posted = found.mapInArrow(prefixes, POSTED)
    back = posted.groupBy("shard").applyInPandas(shared, BUCKETS)
    counted = back.groupBy("bucket").applyInPandas(total, "class long, shared long")
    sizes = sets.filter("class IS NOT NULL").groupBy("class").agg(F.first("n_shingles").alias("n"), F.min("doc_id").alias("doc_id"))
    enough = F.col("shared") >= F.greatest(F.lit(1), F.floor(F.col("n") / 20))
    return cut_lineage(counted.join(sizes, "class").filter(enough).select("class", "n", "doc_id"))


def id_filter(ids: DataFrame) -> np.ndarray:
    """Bits of hashed ids: a fixed number of words, built by Spark. A set bit may belong to another id."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_WORDS * 64))
    words = ids.select(place.alias("p")).groupBy((F.col("p") / 64).cast("int").alias("word"))
    rows = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits")).toArrow()
    out = np.zeros(FILTER_WORDS, np.int64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return out.view(np.uint64)


def sets_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """class, n and full set of the chosen classes, one row each, stored."""
    bits = docs.sparkSession.sparkContext.broadcast(id_filter(chosen))
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(FILTER_WORDS * 64))

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = WordHashes(), set()
        for block in chunks(batches, "text", BLOCK_BYTES):
            p = block.column("place").to_numpy().astype(np.int64)
            hit = (bits.value[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) == 1
            sets = {}
            for text in encoded(block.column("text").combine_chunks().filter(pa.array(hit))):
                s = shingle_set(text, known)
                if len(s) > 3 and (c := class_of(s)) not in seen:
                    sets[c] = s
            if len(seen) < REMEMBERED:
                seen.update(sets)
            yield pa.RecordBatch.from_pydict({"class": pa.array(list(sets), pa.int64()), "tokens": pa.array([s.tobytes() for s in sets.values()], pa.binary())})

    found = docs.select(place.alias("place"), "text").mapInArrow(read, "class long, tokens binary")
    return cut_lineage(found.join(chosen.select("class", "n"), "class").dropDuplicates(["class"]))


# --- 3: order by rarity -----------------------------------------------------------------------------


def ordered(spark: SparkSession, sets: DataFrame) -> DataFrame:
    """Sets without shingles of one class, rare ones first, with the numbers of classes; stored."""
    totals = sets.agg(F.sum("n")).first()[0] or 0
    shards = max(shuffle_width(spark), totals // SHARD_SHINGLES)

    def post(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in chunks(batches, "tokens", BLOCK_BYTES):
            raw = block.column("tokens").to_pylist()
            classes = np.repeat(block.column("class").to_numpy(), [len(t) // 8 for t in raw])
            yield _sharded(np.frombuffer(b"".join(raw), np.uint64), classes, shards)

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        t, c, df = _postings(frame)
        return _by_bucket(c, np.stack([df.astype(np.int64), t.view(np.int64)], 1), shards)

    def sort(frame: pd.DataFrame) -> pd.DataFrame:
        c, pairs = _of_bucket(frame)
        df, t = pairs.reshape(-1, 2).T
        order = np.lexsort((t, df, c))
        c, df, t = c[order], df[order].astype(np.int32), t[order]
        starts = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1]))) if len(c) else np.empty(0, int)
        ends = [*starts[1:].tolist(), len(c)]
        return pd.DataFrame(
            {
                "class": c[starts],
                "tokens": [t[a:b].tobytes() for a, b in zip(starts, ends)],
                "counts": [df[a:b].tobytes() for a, b in zip(starts, ends)],
            }
        )

    posted = sets.select("class", "tokens").mapInArrow(post, POSTED)
    back = posted.groupBy("shard").applyInPandas(count, BUCKETS)
    sorted_sets = back.groupBy("bucket").applyInPandas(sort, "class long, tokens binary, counts binary")
    enough = F.length("tokens") / 8 * 100 >= F.col("n") * PERCENT
    return cut_lineage(sorted_sets.join(sets.select("class", "n"), "class").filter(enough).select("class", "n", "tokens", "counts"))


# --- 4: keys ----------------------------------------------------------------------------------------


def light_limit(rows: DataFrame) -> int:
    """Largest size whose sets give subsets: the least of subsets (light) plus list lengths (heavy).

    Sizes are summed up in some eighty bands; each band costs its 2-subsets if light, and if heavy one
    visit to every entry of the lists of its prefix.
    """

    def cost(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            band, light, heavy = [], [], []
            for n, raw in zip(batch.column("n").to_pylist(), batch.column("counts").to_pylist()):
                counts = np.frombuffer(raw, np.int32)
                first = len(counts) - needed(n) + 1
                band.append(int(np.log(n) / np.log(1.25)))
                light.append(float((first + 1) * first // 2))
                heavy.append(float(counts[:first].sum()))
            yield pa.RecordBatch.from_pydict({"band": pa.array(band, pa.int32()), "light": light, "heavy": heavy})

    costs = rows.select("n", "counts").mapInArrow(cost, "band int, light double, heavy double")
    table = costs.groupBy("band").agg(F.sum("light").alias("light"), F.sum("heavy").alias("heavy")).toPandas().sort_values("band")
    if table.empty:
        return 0
    # A key row costs about as much as twenty entries of a list that is scanned.
    total = np.concatenate(([0.0], np.cumsum(20 * table["light"].to_numpy()))) + np.concatenate((np.cumsum(table["heavy"].to_numpy()[::-1])[::-1], [0.0]))
    best = int(np.argmin(total))
    return int(1.25 ** (int(table["band"].iloc[best - 1]) + 1)) if best else 0


def may_link(bound: str, n: str, other: str) -> Column:
    """An overlap of at most `bound` can be enough for two sets of these sizes."""
    return F.col(bound) * (100 + PERCENT) >= (F.col(n) + F.col(other)) * PERCENT


def keys(rows: DataFrame, limit: int) -> DataFrame:
    """key, class, n, own, rest, members: subsets and list entries, and how many classes the key has.

    own: shingles that no other class has; rest bounds the overlap of partners that meet here first. Left
    out is what is too large to link here even with the key's smallest class.
    """

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], [], []]

            def add(key: np.ndarray, c: int, n: int, own: int, rest: np.ndarray) -> None:
                for column, values in zip(out, (key, np.full(len(key), c), np.full(len(key), n), np.full(len(key), own), rest)):
                    column.append(values.astype(np.int64))

            for c, n, raw in zip(*[batch.column(k).to_pylist() for k in ("class", "n", "tokens")]):
                t = np.frombuffer(raw, np.uint64)
                first = len(t) - needed(n) + 1
                if n <= limit:
                    head = t[: first + 1]
                    a, b = np.triu_indices(len(head), 1)
                    add(mixed(mixed(head[a]) + head[b]).view(np.int64), c, n, n - len(t), len(t) - a)
                if n > limit or needed(limit + 1) <= n:
                    add(mixed(t[:first] ^ np.uint64(0x5851F42D4C957F2D)).view(np.int64), c, n, n - len(t), len(t) - np.arange(first))
            arrays = [pa.array(np.concatenate(x) if x else np.empty(0, np.int64)) for x in out]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "class", "n", "own", "rest"])

    made = cut_lineage(rows.select("class", "n", "tokens").mapInArrow(emit, "key long, class long, n long, own long, rest long"))
    counts = made.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("n").alias("least")).filter("members > 1")
    return cut_lineage(made.join(counts, "key").filter(may_link("rest", "n", "least")).drop("least"))


# --- 5: links ---------------------------------------------------------------------------------------


def linked(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that link, by comparing their sets."""
    left = rows.select(F.col("class").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = rows.select(F.col("class").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for ta, na, tb, nb in zip(*[batch.column(k).to_pylist() for k in ("ta", "na", "tb", "nb")]):
                common = len(np.intersect1d(np.frombuffer(ta, np.uint64), np.frombuffer(tb, np.uint64), assume_unique=True))
                keep.append(100 * common >= PERCENT * (na + nb - common))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], names=["a", "b"])

    return cut_lineage(pairs.join(left, "a").join(right, "b").mapInArrow(compare, "a long, b long"))


def centre_pairs(keyed: DataFrame) -> DataFrame:
    """One pair per class: with the centre that shares most keys with it.

    The centre of the classes of one size band at a key is the one with the fewest shingles of its own,
    as the text that others were copied from has; all pairs lead to a smaller (own, class). A class looks
    for it at the keys that it shares with most others, CENTRE_KEYS at most: what this misses, the rounds
    of pivots find.
    """
    band = F.floor(F.log(F.col("n")) / F.log(F.lit(1.25))).cast("int")
    banded = keyed.select("key", "class", "own", band.alias("band"))
    least = F.min(F.struct("own", "class"))["class"]
    widest = Window.partitionBy("class").orderBy(F.desc("members"), "key")
    asked = keyed.select("key", "class", band.alias("band"), F.row_number().over(widest).alias("place")).filter(F.col("place") <= CENTRE_KEYS).drop("place")
    centre = banded.groupBy("key", "band").agg(least.alias("centre"), F.count(F.lit(1)).alias("met")).filter("met > 1").drop("met")
    met = asked.join(centre, ["key", "band"]).filter("class <> centre").groupBy("class", "centre").agg(F.count(F.lit(1)).alias("keys"))
    return met.groupBy(F.col("class").alias("a")).agg(F.max_by("centre", F.struct("keys", "centre")).alias("b"))


def components(links: DataFrame) -> DataFrame:
    """class and component (its smallest class) of every class with a link.

    Alternating stars: each class's larger neighbours are hung on its smallest neighbour, then its smaller
    ones too, until nothing changes; the rounds grow with the logarithm of the longest path.
    """
    edges = cut_lineage(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        large = cut_lineage(large)
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        joined = large.join(low, "a")
        small = joined.filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        after = cut_lineage(small.unionByName(low.select("a", F.col("low").alias("b"))).filter("a <> b").distinct())
        changed = after.exceptAll(edges).limit(1).count() + edges.exceptAll(after).limit(1).count()
        edges = after
        if not changed:
            break
    roots = edges.select(F.col("b").alias("class")).distinct().withColumn("component", F.col("class"))
    return cut_lineage(edges.select(F.col("a").alias("class"), F.col("b").alias("component")).unionByName(roots))


def forest_components(pairs: DataFrame) -> DataFrame:
    """Components where every class has one pair at most and no pairs form a circle: pointers jump to the root."""
    parents = cut_lineage(pairs.select(F.col("a").alias("class"), F.col("b").alias("component")))
    while True:
        above = parents.select(F.col("class").alias("component"), F.col("component").alias("up"))
        jumped = cut_lineage(parents.join(above, "component", "left").select("class", F.coalesce("up", "component").alias("component"), "up"))
        parents = jumped.drop("up")
        if not jumped.filter("up IS NOT NULL").limit(1).count():
            break
    roots = parents.select(F.col("component").alias("class")).distinct().withColumn("component", F.col("class"))
    return cut_lineage(parents.unionByName(roots))


def with_component(rows: DataFrame, comps: DataFrame) -> DataFrame:
    return rows.join(comps, "class", "left").withColumn("component", F.coalesce("component", "class"))


def partnered(keyed: DataFrame, comps: DataFrame) -> DataFrame:
    """Rows of keys, stored, that may link with a class of another component at the key.

    Necessary is enough overlap for the smallest size, and by the largest bound, of the other components;
    these come from the two best components of a key, so a key's rows need not meet.
    """
    placed = cut_lineage(with_component(keyed.select("key", "class", "n", "rest"), comps))
    parts = placed.groupBy("key", "component").agg(F.min("n").alias("low"), F.max("rest").alias("high"), F.count(F.lit(1)).alias("members"))
    best = parts.groupBy("key").agg(
        F.min(F.struct("low", "component")).alias("small"), F.max(F.struct("high", "component")).alias("strong"),
        F.max(F.struct("members", "component"))["component"].alias("largest"), F.count(F.lit(1)).alias("components"),
    ).filter("components > 1")
    both = cut_lineage(parts.join(best, "key"))
    second = both.groupBy("key").agg(
        F.min(F.when(F.col("component") != F.col("small.component"), F.col("low"))).alias("low_2"),
        F.max(F.when(F.col("component") != F.col("strong.component"), F.col("high"))).alias("high_2"),
    )
    low = F.when(F.col("component") == F.col("small.component"), F.col("low_2")).otherwise(F.col("small.low"))
    high = F.when(F.col("component") == F.col("strong.component"), F.col("high_2")).otherwise(F.col("strong.high"))
    bounds = both.join(second, "key").select("key", "component", "largest", low.alias("other_n"), high.alias("other_rest"))
    met = placed.join(bounds, ["key", "component"])
    return cut_lineage(met.filter(may_link("rest", "n", "other_n") & may_link("other_rest", "n", "other_n")).drop("other_n", "other_rest"))


def pivots_of(open_rows: DataFrame) -> DataFrame:
    """Per key, the first classes outside its largest component, PIVOTS at most."""
    order = Window.partitionBy("key").orderBy(F.xxhash64("key", "class"), "class")
    outside = open_rows.filter("component <> largest").select("key", "class", F.row_number().over(order).alias("place"))
    return cut_lineage(outside.filter(F.col("place") <= PIVOTS).drop("place"))


def pivot_pairs(open_rows: DataFrame, pivots: DataFrame, width: int) -> DataFrame:
    """Distinct pairs (a, b) of a pivot and a class of another component at its key that may link."""
    cells = open_rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).cast("int").alias("cells"))
    known = open_rows.join(cells, "key").join(pivots.withColumn("pivot", F.lit(True)), ["key", "class"], "left")
    known = cut_lineage(known.withColumn("pivot", F.col("pivot").isNotNull()).drop("largest"))
    mine = F.pmod(F.xxhash64("class"), F.col("cells")).cast("int")
    members = known.withColumn("pivot", F.lit(False)).withColumn("cell", mine)
    repeated = known.filter("pivot").withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    names = ["key", "cell", "pivot", "class", "n", "rest", "component"]
    dealt = members.select(*names).unionByName(repeated.select(*names))
    dealt = dealt.repartition(width, "key", "cell").sortWithinPartitions("key", "cell", F.desc("pivot"))

    def pairs_of(g: dict[str, np.ndarray], a: int, b: int) -> np.ndarray:
        """Open pairs of one cell, a few pivots against all members at a time."""
        first = a + int(g["pivot"][a:b].sum())
        found = [np.empty((0, 2), np.int64)]
        for start in range(a, first, PAIR_ROWS):
            i, j = np.arange(start, min(start + PAIR_ROWS, first))[:, None], np.arange(first, b)[None, :]
            one, two = np.nonzero(g["component"][i] != g["component"][j])
            one, two = start + one, first + two
            good = np.minimum(g["rest"][one], g["rest"][two]) * (100 + PERCENT) >= PERCENT * (g["n"][one] + g["n"][two])
            one, two = g["class"][one[good]], g["class"][two[good]]
            found.append(np.stack([np.maximum(one, two), np.minimum(one, two)], 1))
        return np.concatenate(found)

    def pair_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def close(g: dict[str, np.ndarray], last: bool) -> tuple[pa.RecordBatch, dict[str, np.ndarray]]:
            size = len(g["key"])
            change = np.flatnonzero((g["key"][1:] != g["key"][:-1]) | (g["cell"][1:] != g["cell"][:-1])) + 1
            edges = [0, *change.tolist(), *([size] if last else [])]
            found = [pairs_of(g, a, b) for a, b in zip(edges, edges[1:]) if b - a > 1 and g["pivot"][a]]
            pairs = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)
            rest = {k: v[edges[-1] :] for k, v in g.items()}
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"]), rest

        for batch in batches:
            new = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in names}
            held = {k: np.concatenate([held[k], new[k]]) for k in names} if held else new
            if len(held["key"]):
                made, held = close(held, last=False)
                yield made
        if held and len(held["key"]):
            yield close(held, last=True)[0]

    return cut_lineage(dealt.mapInArrow(pair_up, "a long, b long").distinct())


def merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Components after further links between classes."""
    left = with_component(links.select(F.col("a").alias("class"), "b"), comps).select(F.col("component").alias("a"), F.col("b").alias("class"))
    above = components(with_component(left, comps).select("a", F.col("component").alias("b")))
    above = above.select(F.col("class").alias("component"), F.col("component").alias("top"))
    known = comps.unionByName(above.select(F.col("component").alias("class"), "component").join(comps, "class", "left_anti"))
    return cut_lineage(known.join(above, "component", "left").select("class", F.coalesce("top", "component").alias("component")))


def class_components(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """class and component of all classes that link with another one."""
    spark = docs.sparkSession
    rows = ordered(spark, sets_of(docs, screened(sets)))
    keyed = keys(rows, light_limit(rows))
    comps = forest_components(linked(centre_pairs(keyed), rows))
    open_rows = partnered(keyed, comps)
    # Where no pivot is left, all open classes of every key are of one component.
    while not (pivots := pivots_of(open_rows)).isEmpty():
        comps = merged(comps, linked(pivot_pairs(open_rows, pivots, shuffle_width(spark)), rows))
        left = open_rows.select("key", "class", "n", "rest").join(pivots, ["key", "class"], "left_anti")
        open_rows = partnered(left, comps)
    return comps


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id per document."""
    ship(__name__)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = document_sets(docs)
    comps = class_components(docs, sets)
    lowest = sets.filter("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("low"))
    grouped = with_component(lowest, comps)
    names = grouped.groupBy("component").agg(F.min("low").alias("component_id"))
    of_class = cut_lineage(grouped.join(names, "component").select("class", "component_id"))
    joined = sets.drop("prefix").join(of_class, "class", "left")
    return joined.select("doc_id", "n_shingles", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group stays, the one that names its component, with its columns.

    Rows that share the naming doc_id are one document and stay together; rows without doc_id stay.
    """
    found = near_duplicates(docs)
    away = found.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("near_away")).distinct()
    return docs.join(away, docs["doc_id"] == away["near_away"], "left_anti")
