"""Corpus preparation: bins, first-failing-reason classification, held-out exclusion, sampling."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duelgauge.operators import ordered


@dataclass(frozen=True)
class Bins:
    """Half-open rating range cut into equal bins."""

    min_elo: int = 1000
    max_elo: int = 2600
    width: int = 200

    @property
    def count(self) -> int:
        return (self.max_elo - self.min_elo) // self.width


@dataclass(frozen=True)
class ContextPolicy:
    """Which games may be predicted or serve as context; the rating range is closed."""

    context_size: int = 8
    max_context_age_days: int | None = None
    min_context_age_seconds: int = 1
    allowed_events: tuple[str, ...] = ("Blitz",)
    min_elo: int = 1000
    max_elo: int = 3000
    require_both_ratings: bool = True
    max_predictions_per_player: int | None = None


CORPUS_REASONS = ("missing_rating", "rating_out_of_range", "players_in_different_bins", "held_out_game")

# The exclusion keys of an example build, all reported even when zero.
EXCLUSION_KEYS = (
    "unsupported_event",
    "invalid_result",
    "missing_player",
    "missing_rating",
    "rating_out_of_range",
    "duplicate_game",
    "white_insufficient_context",
    "black_insufficient_context",
    "context_too_old",
    "ambiguous_same_day_order",
    "max_predictions_per_player",
)


def elo_bin(rating: Column, bins: Bins) -> Column:
    """Bin number of a rating, NULL outside [min, max)."""
    inside = (rating >= bins.min_elo) & (rating < bins.max_elo)
    return F.when(inside, F.floor((rating - bins.min_elo) / bins.width))


def classify(games: DataFrame, bins: Bins, held_out: Column | None = None) -> DataFrame:
    """Add `bin` and `reason`: exactly one of them is set."""
    white, black = F.col("white_elo"), F.col("black_elo")
    missing = lambda rating: rating.isNull() | (rating <= 0)
    wbin, bbin = elo_bin(white, bins), elo_bin(black, bins)
    held = F.coalesce(held_out, F.lit(False)) if held_out is not None else F.lit(False)
    reason = (
        F.when(missing(white) | missing(black), "missing_rating")
        .when(wbin.isNull() | bbin.isNull(), "rating_out_of_range")
        .when(wbin != bbin, "players_in_different_bins")
        .when(held, "held_out_game")
    )
    return games.withColumn("reason", reason).withColumn("bin", F.when(F.col("reason").isNull(), wbin))


def digest(line: Column) -> Column:
    """Fingerprint of a record, blind to surrounding white space."""
    return F.md5(F.regexp_replace(line, r"^\s+|\s+$", ""))


def flag_held_out(records: DataFrame, held_out: DataFrame, name: str = "held_out") -> DataFrame:
    """Mark records whose digest occurs in the held-out set; one row per record is kept."""
    keys = held_out.select("digest").distinct().withColumn("_hit", F.lit(True))
    joined = records.join(keys, "digest", "left")
    return joined.withColumn(name, F.col("_hit").isNotNull()).drop("_hit")


def exclude_held_out(records: DataFrame, held_out: DataFrame) -> DataFrame:
    return records.join(held_out.select("digest"), "digest", "left_anti")


def policy_reason(policy: ContextPolicy) -> Column:
    white, black = F.col("white_elo"), F.col("black_elo")
    rated = F.lit(policy.require_both_ratings) & ((white <= 0) | (black <= 0))
    outside = ~(white.between(policy.min_elo, policy.max_elo) & black.between(policy.min_elo, policy.max_elo))
    return (
        F.when(~F.col("event").isin(*policy.allowed_events), "unsupported_event")
        .when(rated, "missing_rating")
        .when(outside, "rating_out_of_range")
    )


def eligible_for_corpus(bins: Bins, min_plies: int = 22) -> Column:
    """Standard start, long enough, both ratings inside the range and in one bin."""
    same = elo_bin(F.col("white_elo"), bins) == elo_bin(F.col("black_elo"), bins)
    return F.coalesce(F.col("fen").isNull() & (F.col("plies") >= min_plies) & same, F.lit(False))


def counts_with_zeros(counts: DataFrame, key: str, keys: Sequence[str], name: str = "n") -> DataFrame:
    """A count per listed key, zero where nothing was counted."""
    spark = counts.sparkSession
    listed = spark.range(1).select(F.explode(F.array(*[F.lit(k) for k in keys])).alias(key))
    return listed.join(counts, key, "left").select(key, F.coalesce(name, F.lit(0)).cast("bigint").alias(name))


def reason_counts(classified: DataFrame, reasons: Sequence[str] = CORPUS_REASONS) -> DataFrame:
    counted = classified.filter(F.col("reason").isNotNull()).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return counts_with_zeros(counted, "reason", reasons)


def bin_counts(classified: DataFrame, bins: Bins, eval_quota: int) -> DataFrame:
    """Games per bin, zero-filled, with a flag on bins that the evaluation quota would empty."""
    counted = classified.filter(F.col("bin").isNotNull()).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    spark = classified.sparkSession
    return (
        spark.range(bins.count)
        .withColumnRenamed("id", "bin")
        .join(counted, "bin", "left")
        .select("bin", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
        .withColumn("within_quota", F.col("n") <= eval_quota)
    )


def interval_retention(games: DataFrame, bins: Bins, compare_width: int) -> DataFrame:
    """Kept games at the working bin width and at a second width, in one pass."""
    other = Bins(bins.min_elo, bins.max_elo, compare_width)
    kept = lambda b: elo_bin(F.col("white_elo"), b) == elo_bin(F.col("black_elo"), b)
    return games.agg(
        F.count(F.lit(1)).alias("games"),
        F.count_if(kept(bins)).alias("kept"),
        F.count_if(kept(other)).alias("kept_at_compare_interval"),
    )


def rank_bands(df: DataFrame, keys: Sequence[str], ids: Sequence[str], seed: str, bands: dict[str, int | None]) -> DataFrame:
    """Disjoint uniform samples per group: the first n1 hash ranks, the next n2, and so on.

    A size of None, for the last band, takes all that is left; without such a band the rows beyond the
    bands are left out (`left_out` counts them). Only the hash slices that hold the finite bands are
    shuffled; where all rows stay, they are labelled by the last hash of each band of their group.
    """
    finite = {name: size for name, size in bands.items() if size is not None}
    rest = [name for name, size in bands.items() if size is None]
    if rest and rest != [list(bands)[-1]]:
        raise ValueError("only the last band can take all that is left")
    ranked = ordered.hash_first(df, keys, ids, seed, sum(finite.values()), "_rank")
    label, start = F.lit(None).cast("string"), 0
    for name, size in finite.items():
        label = F.when(F.col("_rank").between(start + 1, start + size), name).otherwise(label)
        start += size
    sampled = ranked.withColumn("split", label).drop("_rank")
    if not rest:
        return sampled
    place = F.struct(ordered.hash_text(seed, *ids).alias("h"), *[F.col(c) for c in ids])
    ends = sampled.groupBy(*keys).agg(*[F.max(F.when(F.col("split") == n, place)).alias(f"_end_{n}") for n in finite])
    split = F.lit(rest[0])
    for name in reversed(finite):
        split = F.when(place <= F.col(f"_end_{name}"), name).otherwise(split)
    return df.join(ends, list(keys), "left").withColumn("split", split).select(*df.columns, "split")


def left_out(df: DataFrame, keys: Sequence[str], bands: dict[str, int | None]) -> DataFrame:
    """Rows per group that no band takes."""
    total = None if None in bands.values() else sum(bands.values())
    beyond = F.lit(0) if total is None else F.greatest(F.count(F.lit(1)) - total, F.lit(0))
    return df.groupBy(*keys).agg(beyond.cast("bigint").alias("left_out"))


def large_groups(df: DataFrame, keys: Sequence[str], minimum: int) -> DataFrame:
    """Rows of the groups that reach a minimum size."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= minimum).drop("_n")
    return df.join(sizes, list(keys), "left_semi")


def sides(games: DataFrame, *keep: str) -> DataFrame:
    """Two player rows per game."""
    side = lambda me, other, sign: F.struct(
        F.lit(me).alias("color"),
        F.col(me).alias("player"),
        F.col(other).alias("opponent"),
        F.col(f"{me}_elo").alias("elo"),
        F.col(f"{other}_elo").alias("opponent_elo"),
        (F.col("result") * sign).alias("outcome"),
    )
    rows = games.select(
        "game_id", *keep, F.explode(F.array(side("white", "black", 1), side("black", "white", -1))).alias("s")
    )
    return rows.select("game_id", *keep, "s.*")


def rating_distribution(player_sides: DataFrame, width: int = 100) -> DataFrame:
    """Games per rating band over both players. Shares divide by games, so they add up to 200 %."""
    games = player_sides.agg((F.count(F.lit(1)) / 2).alias("n")).scalar()
    low = (F.floor(F.col("elo") / width) * width).alias("low")
    counted = player_sides.groupBy(low).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("percent", F.round(F.col("n") / games * 100, 6))


def player_activity(player_sides: DataFrame) -> DataFrame:
    return player_sides.groupBy("player").agg(F.count(F.lit(1)).alias("n"))


def activity_totals(activity: DataFrame) -> DataFrame:
    return activity.agg(
        F.count(F.lit(1)).alias("players"),
        *[F.count_if(F.col("n") >= limit).alias(f"over_{limit}") for limit in (100, 500, 1000)],
    )


def corpus_qa(games: DataFrame) -> DataFrame:
    """Scan counters of a parsed corpus."""
    return games.agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(F.col("result") != 0).alias("decisive"),
        F.count_if(F.col("result") == 0).alias("draws"),
        F.count_if((F.col("white_elo") <= 0) | (F.col("black_elo") <= 0)).alias("rating_skip"),
    )
