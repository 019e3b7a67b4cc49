"""Resampled sums without drawn rows: counts of draws are split down a tree over the rows' hashes.

A replicate of a group of n rows draws n times with replacement. Its draws are not produced and looked
up; the number that falls in a part of the group is binomial, so the n draws of the root are split
between the halves of the hash space until parts of about LEAF rows are left, and only there single
draws are made, among rows that lie together. What travels is one row per leaf, whatever the number of replicates.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelgauge.operators import ordered
from duelgauge.runtime import broadcast_if_small, cut_lineage

LEAF = 64
# Up to so many draws are counted one by one; a larger binomial is a rounded normal.
COUNTED = 256
HASH_BITS = 60
# Nodes above this level have many leaves each, but are few.
TOP_LEVELS = 10


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _states(text: Column) -> Column:
    """Two generator states from one digest."""
    part = lambda digest, at, modulus: F.conv(F.substring(digest, at, 15), 16, 10).cast("bigint") % (modulus - 1) + 1
    one, two = ordered.MODULI
    return _let(F.md5(text), lambda h: F.struct(part(h, 1, one).alias("a"), part(h, 16, two).alias("b")))


def _powers() -> Column:
    pairs = ", ".join(f"named_struct('a', {a}L, 'b', {b}L)" for a, b in ordered.generator_powers(COUNTED))
    return F.expr(f"array({pairs})")


def _draws(text: Column, count: Column) -> Column:
    """`count` random integers; every block of COUNTED hashes its name once."""
    last = ((count - 1) / COUNTED).cast("bigint")
    block = lambda b: _let(
        _states(F.concat_ws(":", text, b.cast("string"))),
        lambda s: F.transform(
            F.slice(_powers(), F.lit(1), F.least(F.lit(COUNTED), count - b * COUNTED).cast("int")),
            lambda g: ordered.combined_draw((s["a"], s["b"]), (g["a"], g["b"])),
        ),
    )
    return F.flatten(F.transform(F.sequence(F.lit(0).cast("bigint"), last), block))


def binomial(text: Column, count: Column, part: Column, whole: Column) -> Column:
    """How many of `count` draws from `whole` rows fall in `part` of them, as named by `text`.

    Up to COUNTED draws the number is exact. Above, it is a normal of the same mean and deviation, rounded
    and kept within 0..count; its distribution function is off by less than 0.56 |1 - 2p| / sqrt(count p (1 - p)) + 1 / count.
    """
    few = F.size(F.filter(_draws(text, count), lambda v: v % whole < part)).cast("bigint")
    share = part.cast("double") / whole
    unit = lambda state, modulus: state.cast("double") / modulus
    normal = lambda s: F.sqrt(-2.0 * F.ln(unit(s["a"], ordered.MODULI[0]))) * F.cos(2.0 * math.pi * unit(s["b"], ordered.MODULI[1]))
    near = _let(_states(text), lambda s: F.floor(count * share + normal(s) * F.sqrt(count * share * (1.0 - share)) + 0.5))
    return F.when(count <= COUNTED, few).otherwise(F.least(count, F.greatest(F.lit(0).cast("bigint"), near)))


def _leaves(rows: DataFrame, group: str, ids: Sequence[str], values: Sequence[str], leaf: int) -> DataFrame:
    """One row per leaf: the group's rows and tree depth, the leaf's number and its rows in hash order."""
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    over = ((F.col("_n") - 1) / leaf).cast("bigint")
    sizes = sizes.withColumn("_depth", F.when(over == 0, 0).otherwise(F.length(F.bin(over))))
    hashed = rows.withColumn("_hash", ordered.hash_text("tree", *ids)).join(sizes, group)
    bits = F.conv(F.substring("_hash", 1, HASH_BITS // 4), 16, 10).cast("bigint")
    shifted = hashed.withColumn("_bits", bits).withColumn("_leaf", F.expr(f"shiftright(_bits, {HASH_BITS} - _depth)"))
    held = F.struct("_hash", *[F.col(c).alias(f"_id{i}") for i, c in enumerate(ids)], *[F.coalesce(c, F.lit(0)).cast("double").alias(f"v{i}") for i, c in enumerate(values)])
    return shifted.groupBy(group, "_n", "_depth", "_leaf").agg(F.sort_array(F.collect_list(held)).alias("_rows"))


def _paths(leaves: DataFrame, group: str) -> DataFrame:
    """Per leaf below a root that is split: rows of each node on its path and of that node's left half.

    Nodes near the root are shared by many leaves, but there are few of them: that part is broadcast where it is
    small. A node below has at most a share of 1 in 2^TOP_LEVELS of the leaves, which a shuffle spreads.
    """
    steps = leaves.filter("_depth > 0").select(
        group, "_depth", "_leaf", F.size("_rows").cast("bigint").alias("_m"), F.explode(F.sequence(F.lit(0), F.col("_depth") - 1)).alias("_level")
    ).select("*", F.expr("shiftright(_leaf, _depth - _level)").alias("_node"), F.expr("shiftright(_leaf, _depth - _level - 1) & 1").alias("_side"))
    nodes = steps.groupBy(group, "_level", "_node").agg(
        F.sum("_m").alias("_whole"), F.sum(F.when(F.col("_side") == 0, F.col("_m")).otherwise(0)).alias("_left")
    )
    top = nodes.filter(F.col("_level") < TOP_LEVELS)
    known = steps.drop("_m")
    upper = known.filter(F.col("_level") < TOP_LEVELS).join(broadcast_if_small(top, top), [group, "_level", "_node"])
    lower = known.filter(F.col("_level") >= TOP_LEVELS).join(nodes.filter(F.col("_level") >= TOP_LEVELS), [group, "_level", "_node"])
    step = F.struct("_level", "_node", "_side", "_whole", "_left")
    return upper.unionByName(lower).groupBy(group, "_leaf").agg(F.sort_array(F.collect_list(step)).alias("_path"))


def bootstrap_sums(
    rows: DataFrame, group: str, ids: Sequence[str], values: Sequence[str], replicates: int, seed: str, leaf: int = LEAF
) -> DataFrame:
    """(group, replicate, sums of `values`): each replicate draws as many rows as the group has, with replacement.

    `ids` name a row; rows that share them share a leaf. A null value counts as 0, a null group is left out.
    The same rows, seed and leaf size give the same sums on every run. Empty input gives no rows.
    """
    needed = rows.select(group, *ids, *values).filter(F.col(group).isNotNull())
    leaves = cut_lineage(_leaves(needed, group, ids, values, leaf))
    pathed = leaves.join(_paths(leaves, group), [group, "_leaf"], "left")
    name = lambda *parts: F.concat_ws(":", F.lit(seed), *[p.cast("string") for p in parts])

    def fallen(replicate: Column) -> Column:
        """Draws of a replicate that reach this leaf."""
        def follow(count: Column, step: Column) -> Column:
            text = name(F.col(group), step["_level"], step["_node"], replicate)
            left = binomial(text, count, step["_left"], step["_whole"])
            return F.when(step["_side"] == 0, left).otherwise(count - left)

        return F.aggregate(F.coalesce("_path", F.array().cast(pathed.schema["_path"].dataType)), F.col("_n"), follow)

    def summed(replicate: Column) -> Column:
        places = lambda count: F.transform(_draws(name(F.lit("leaf"), F.col(group), F.col("_leaf"), replicate), count), lambda v: v % F.size("_rows"))
        zero = F.struct(*[F.lit(0.0).alias(f"v{i}") for i in range(len(values))])
        add = lambda at, row: F.struct(*[(at[f"v{i}"] + row[f"v{i}"]).alias(f"v{i}") for i in range(len(values))])
        total = lambda count: F.aggregate(places(count), zero, lambda at, j: _let(F.get(F.col("_rows"), j.cast("int")), lambda row: add(at, row)))
        return _let(fallen(replicate), total)

    per_leaf = pathed.select(
        group, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(replicates - 1)), summed)).alias("replicate", "_s")
    )
    return per_leaf.groupBy(group, "replicate").agg(*[F.sum(f"_s.v{i}").alias(c) for i, c in enumerate(values)])
