"""Exact ordered operators (ranks, running totals, quantiles, draws) that no single key can block.

A plain window sorts a whole key inside one task. Here every key is cut into segments that follow
the order; a segment is the unit of work, and a small table of segment totals carries the sums
from one segment to the next. Keys that fit one segment pay only for an empty carry join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


SEGMENT = "_segment"


def _names(keys: Sequence[str]) -> list[str]:
    return list(keys)


def id_levels(column: Column) -> list[Column]:
    """Blocks of 8,192 consecutive ids, in blocks of 8,192 of those: at most 8,192 totals meet in a task for ids below 2^39."""
    return [F.shiftright(column.cast("bigint"), 26), F.shiftright(column.cast("bigint"), 13)]


def _carried(sums: DataFrame, keys: list[str], levels: list[str], totals: Sequence[str]) -> DataFrame:
    """keys, levels and `_carry_*`: sum of the totals of all segments of the key that come before.

    A task adds up the totals inside one segment of the level above; the sums of those are carried in the same way.
    """
    *upper, last = levels
    whole = [*keys, *upper] or [F.lit(0)]
    before = W.partitionBy(*whole).orderBy(last).rowsBetween(W.unboundedPreceding, -1)
    position = W.partitionBy(*whole).orderBy(last)
    inside = sums.select(
        *keys, *levels, F.row_number().over(position).alias("_nth"), *[F.sum(f"_sum_{n}").over(before).alias(f"_carry_{n}") for n in totals]
    )
    if not upper:
        return inside.filter(F.col("_nth") > 1).drop("_nth")
    above = _carried(sums.groupBy(*keys, *upper).agg(*[F.sum(f"_sum_{n}").alias(f"_sum_{n}") for n in totals]), keys, upper, totals)
    above = above.select(*keys, *upper, *[F.col(f"_carry_{n}").alias(f"_above_{n}") for n in totals])
    both = inside.join(above, [*keys, *upper], "left")
    added = [F.coalesce(f"_carry_{n}", F.lit(0)) + F.coalesce(f"_above_{n}", F.lit(0)) for n in totals]
    return both.select(*keys, *levels, *[v.alias(f"_carry_{n}") for n, v in zip(totals, added)])


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    segment: Column | Sequence[Column],
    totals: dict[str, Column],
    inclusive: bool = True,
) -> DataFrame:
    """Add running sums of `totals` per key. `segment` must not decrease along `order`.

    A sequence of segments goes from coarse to fine, each cutting the one before it, so that the totals
    of the segments are themselves summed in pieces.
    """
    keys = _names(keys)
    columns = list(segment) if isinstance(segment, (list, tuple)) else [segment]
    levels = [f"{SEGMENT}{k}" for k in range(len(columns))]
    rows = df.select("*", *[c.alias(n) for c, n in zip(columns, levels)])
    frame = W.partitionBy(*keys, *levels).orderBy(*order).rowsBetween(
        W.unboundedPreceding, 0 if inclusive else -1
    )
    local = rows.select("*", *[F.sum(v).over(frame).alias(f"_local_{n}") for n, v in totals.items()])
    sums = rows.groupBy(*keys, *levels).agg(*[F.sum(v).alias(f"_sum_{n}") for n, v in totals.items()])
    joined = local.join(_carried(sums, keys, levels, list(totals)), [*keys, *levels], "left")
    return joined.select(
        *df.columns,
        *[
            (F.coalesce(F.col(f"_local_{n}"), F.lit(0)) + F.coalesce(F.col(f"_carry_{n}"), F.lit(0))).alias(n)
            for n in totals
        ],
    )


def row_numbers(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    segment: Column | Sequence[Column],
    name: str = "rn",
) -> DataFrame:
    return running_totals(df, keys, order, segment, {name: F.lit(1).cast("bigint")})


def running_last(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    segment: Column,
    values: dict[str, Column],
) -> DataFrame:
    """Forward fill: the latest non-null value so far per key, across segments."""
    keys = _names(keys)
    rows = df.withColumn(SEGMENT, segment)
    frame = W.partitionBy(*keys, SEGMENT).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    local = rows.select(
        "*", *[F.last(v, ignorenulls=True).over(frame).alias(f"_local_{n}") for n, v in values.items()]
    )
    ends = rows.groupBy(*keys, SEGMENT).agg(
        *[F.max_by(v, F.when(v.isNotNull(), F.col(order))).alias(f"_end_{n}") for n, v in values.items()]
    )
    before = W.partitionBy(*keys).orderBy(SEGMENT).rowsBetween(W.unboundedPreceding, -1)
    position = W.partitionBy(*keys).orderBy(SEGMENT)
    carry = (
        ends.select(
            *keys,
            SEGMENT,
            F.row_number().over(position).alias("_nth"),
            *[F.last(f"_end_{n}", ignorenulls=True).over(before).alias(f"_carry_{n}") for n in values],
        )
        .filter(F.col("_nth") > 1)
        .drop("_nth")
    )
    return local.join(carry, [*keys, SEGMENT], "left").select(
        *df.columns, *[F.coalesce(f"_local_{n}", f"_carry_{n}").alias(n) for n in values]
    )


# Hash order -------------------------------------------------------------------------------------


def hash_text(seed: str, *parts: str | Column) -> Column:
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws(":", F.lit(seed), *[c.cast("string") for c in columns]))


def hash_int(seed: str, *parts: str | Column) -> Column:
    """Sixty hash bits as a non-negative BIGINT."""
    return F.conv(F.substring(hash_text(seed, *parts), 1, 15), 16, 10).cast("bigint")


def second_hash_int(seed: str, *parts: str | Column) -> Column:
    """Another sixty bits of the same digest."""
    return F.conv(F.substring(hash_text(seed, *parts), 16, 15), 16, 10).cast("bigint")


# Moduli and multipliers of the two multiplicative generators that are combined.
MODULI = (2147483647, 2147483399)
MULTIPLIERS = (48271, 40692)


def generator_powers(count: int) -> list[tuple[int, int]]:
    """The first powers of both multipliers: the nth output of a generator is state times power."""
    return [tuple(pow(g, i + 1, p) for g, p in zip(MULTIPLIERS, MODULI)) for i in range(count)]


def combined_draw(states: tuple[Column, Column], powers: tuple[Column, Column]) -> Column:
    """Sixty-two random bits from two hashed states; plain integer arithmetic, no overflow."""
    high, low = ((s % p) * g % p for s, g, p in zip(states, powers, MODULI))
    return high * MODULI[1] + low


def hash_unit(seed: str, *parts: str | Column) -> Column:
    """Uniform double in [0, 1) from 52 hash bits."""
    bits = F.conv(F.substring(hash_text(seed, *parts), 1, 13), 16, 10).cast("bigint")
    return bits.cast("double") / F.lit(float(2**52))


def hash_ranks(
    df: DataFrame, keys: Sequence[str], ids: Sequence[str], seed: str, name: str = "rn"
) -> DataFrame:
    """Dense 1-based rank of every row within its group in hash order.

    The leading hash digits are the segment, so a group is spread evenly over 256 pieces.
    """
    hashed = df.withColumn("_hash", hash_text(seed, *ids))
    ranked = row_numbers(hashed, keys, ["_hash", *ids], F.substring("_hash", 1, 2), name)
    return ranked.drop("_hash")


def hash_sample_ranks(df: DataFrame, keys: Sequence[str], ids: Sequence[str], seed: str, k: int, name: str = "rn") -> DataFrame:
    """The first k rows of each group in hash order with their rank.

    For many groups and a small k: the rank filter becomes a group limit before the shuffle, so a
    hot group sends only k rows per task.
    """
    ordered = W.partitionBy(*keys).orderBy(hash_text(seed, *ids), *ids)
    ranked = df.withColumn(name, F.row_number().over(ordered)).filter(F.col(name) <= k)
    return ranked.withColumn(name, F.col(name).cast("bigint"))


def hash_sample(df: DataFrame, keys: Sequence[str], ids: Sequence[str], seed: str, k: int) -> DataFrame:
    """Uniform sample of at most k rows per group."""
    return hash_sample_ranks(df, keys, ids, seed, k, "_rank").drop("_rank")


FINE_DIGITS = 3


def hash_first(
    df: DataFrame, keys: Sequence[str], ids: Sequence[str], seed: str, k: int, name: str = "rn"
) -> DataFrame:
    """The first k rows of each group in hash order with their rank, for a large k and few groups.

    A first pass counts rows per group and leading hash digits. Only slices that begin before rank k
    go on, so what is shuffled and sorted is little more than the sample, not the corpus. Whether the
    slice table is broadcast is left to Spark, which measures it.
    """
    keys = _names(keys)
    hashed = df.withColumn("_hash", hash_text(seed, *ids)).withColumn(SEGMENT, F.substring("_hash", 1, FINE_DIGITS))
    counted = hashed.groupBy(*keys, SEGMENT).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy(SEGMENT).rowsBetween(W.unboundedPreceding, -1)
    starts = counted.select(*keys, SEGMENT, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    starts = starts.filter(F.col("_start") < k)
    inside = W.partitionBy(*keys, SEGMENT).orderBy("_hash", *ids)
    ranked = hashed.join(starts, [*keys, SEGMENT]).withColumn(name, F.col("_start") + F.row_number().over(inside))
    return ranked.filter(F.col(name) <= k).select(*df.columns, name)


# Exact quantiles --------------------------------------------------------------------------------


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], width: float
) -> DataFrame:
    """Exact linearly interpolated quantiles per key from global ranks; NULL values are left out.

    Values are cut into slices of `width`, so one group is sorted by many tasks.
    """
    keys = _names(keys)
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    ranked = row_numbers(rows, keys, ["_v"], F.floor(F.col("_v") / width), "_rn")
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    if keys:
        sized = ranked.join(sizes, keys)
    else:
        sized = ranked.withColumn("_n", sizes.scalar())
    index = F.col("_rn") - 1
    parts = []
    for name, p in probs.items():
        at = F.lit(p) * (F.col("_n") - 1)
        low, high, share = F.floor(at), F.ceil(at), at - F.floor(at)
        parts += [
            F.max(F.when(index == low, F.col("_v"))).alias(f"_lo_{name}"),
            F.max(F.when(index == high, F.col("_v"))).alias(f"_hi_{name}"),
            F.max(share).alias(f"_share_{name}"),
        ]
    touched = F.lit(False)
    for p in probs.values():
        at = F.lit(p) * (F.col("_n") - 1)
        touched = touched | index.between(F.floor(at), F.ceil(at))
    picked = sized.filter(touched).groupBy(*keys).agg(*parts)
    return picked.select(
        *keys,
        *[
            (
                F.col(f"_lo_{n}") + F.col(f"_share_{n}") * (F.col(f"_hi_{n}") - F.col(f"_lo_{n}"))
            ).alias(n)
            for n in probs
        ],
    )


def median(df: DataFrame, keys: Sequence[str], value: str, name: str, width: float) -> DataFrame:
    return quantiles(df, keys, value, {name: 0.5}, width)
