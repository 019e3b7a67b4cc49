"""Training target expressions: value rescale, discrete values, policies, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the linear share of the value rescale.
EPSILON = 0.001


def rescale(x: Column) -> Column:
    return F.signum(x) * (F.sqrt(F.abs(x) + 1.0) - 1.0) + EPSILON * x


def invert_rescale(y: Column) -> Column:
    root = (F.sqrt(1.0 + 4 * EPSILON * (F.abs(y) + 1.0 + EPSILON)) - 1.0) / (2 * EPSILON)
    return F.signum(y) * (root * root - 1.0)


def two_hot(x: Column, size: int) -> Column:
    """Value spread over its two neighbouring integers, clamped to the ends of the support."""
    shift = size // 2
    clamp = lambda v: F.least(F.greatest(v + shift, F.lit(0)), F.lit(size - 1))
    low, high = F.floor(x), F.ceil(x)
    return F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)),
        lambda i: F.when((i == clamp(low)) & (low == high), 1.0)
        .when(i == clamp(high), x - low)
        .when(i == clamp(low), high - x)
        .otherwise(0.0),
    )


def expected_value(probabilities: Column, size: int) -> Column:
    """Mean of a discrete value distribution over the centred support, before the inverse rescale."""
    support = F.sequence(F.lit(-(size // 2)), F.lit(size - 1 - size // 2))
    terms = F.zip_with(probabilities, support, lambda p, s: p.cast("double") * s)
    return F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)


def one_hot(index: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(i == index, 1.0).otherwise(0.0))


def policy(visits: Column, action: Column, size: int) -> Column:
    """Visit text `id:count,…` as a normalised vector; no visits give the played move, past the end uniform."""
    counts = F.str_to_map(visits, F.lit(","), F.lit(":"))
    total = F.aggregate(F.map_values(counts), F.lit(0.0), lambda acc, c: acc + c.cast("double"))
    share = F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)),
        lambda i: F.coalesce(F.get(F.transform(F.array(i), lambda k: counts[k.cast("string")]), F.lit(0)).cast("double"), F.lit(0.0)) / total,
    )
    uniform = F.array_repeat(F.lit(1.0 / size), size)
    return (
        F.when(action.isNull(), uniform)
        .when(visits.isNull() | (visits == ""), one_hot(action, size))
        .otherwise(share)
    )


def priority(target: Column, value: Column, floor: float = 0.0) -> Column:
    return F.abs(target - value) + floor
