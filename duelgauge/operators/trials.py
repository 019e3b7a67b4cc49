"""Resampled evaluation: trials with replacement, bucket prediction, ordering accuracy, bootstrap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelgauge.operators import calibration as K
from duelgauge.operators import ordered
from duelgauge.runtime import broadcast_if_small, shuffle_width


def draw_pool(entries: DataFrame, group: str, ids: Sequence[str], seed: str = "pool") -> DataFrame:
    """Entries with a dense draw index 1..n per group."""
    return ordered.hash_ranks(entries, [group], ids, seed, "draw")


def pool_sizes(entries: DataFrame, group: str) -> DataFrame:
    return entries.groupBy(group).agg(F.count(F.lit(1)).alias("pool"))


def draws(sizes: DataFrame, group: str, per_trial: Sequence[int], trials: int, seed: str) -> DataFrame:
    """Uniform draws with replacement: (group, size, trial, nth) -> draw index.

    Built from one row per group; the (group, size, trial) cells are spread over all tasks before
    the draws of a cell are produced, so no task holds more than its share. Each cell hashes its
    name once; its draws then come from two combined multiplicative generators.
    """
    spark = sizes.sparkSession
    cells = sizes.select(
        group, "pool", F.explode(F.array(*[F.lit(s) for s in per_trial])).alias("size")
    ).select(group, "pool", "size", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial"))
    spread = cells.repartition(shuffle_width(spark), group, "size", "trial")
    stated = spread.select(
        "*",
        (ordered.hash_int(seed, "size", group, "trial") % (ordered.MODULI[0] - 1) + 1).alias("_s1"),
        (ordered.second_hash_int(seed, "size", group, "trial") % (ordered.MODULI[1] - 1) + 1).alias("_s2"),
    )
    pairs = ", ".join(f"named_struct('a', {a}L, 'b', {b}L)" for a, b in ordered.generator_powers(max(per_trial)))
    powers = F.expr(f"array({pairs})")
    listed = stated.select("*", F.posexplode(F.slice(powers, F.lit(1), F.col("size"))).alias("nth", "_g"))
    value = ordered.combined_draw((F.col("_s1"), F.col("_s2")), (F.col("_g.a"), F.col("_g.b")))
    return listed.select(group, "size", "trial", "nth", (value % F.col("pool") + 1).alias("draw"))


GROUP_SHIFT = 40


def join_pool(drawn: DataFrame, entries: DataFrame, group: str, ids: Sequence[str]) -> DataFrame:
    """Look drawn entries up by (group, draw) packed in one integer key.

    A pool that was counted and found small is broadcast, which keeps the draws where they are; a
    larger pool is joined by a shuffle on the key, which is uniform by construction.
    """
    key = lambda: F.shiftleft(F.col(group).cast("bigint"), GROUP_SHIFT) + F.col("draw")
    pool = draw_pool(entries, group, ids).withColumn("_key", key()).drop(group, "draw")
    return drawn.withColumn("_key", key()).join(broadcast_if_small(pool, entries), "_key").drop("_key", "draw")


def run_trials(
    entries: DataFrame, calibration: DataFrame, per_trial: Sequence[int], trials: int, seed: str
) -> DataFrame:
    """One row per (size, bucket, trial): mean score, mean rating, estimate, predicted bucket.

    Entries are (low, game_id, color, score, moves, rating).
    """
    drawn = draws(pool_sizes(entries, "low"), "low", per_trial, trials, seed)
    return score_trials(join_pool(drawn, entries, "low", ["game_id", "color"]), calibration)


def score_trials(drawn: DataFrame, calibration: DataFrame) -> DataFrame:
    grouped = drawn.groupBy("size", "low", "trial").agg(
        F.try_divide(F.sum(F.col("score") * F.col("moves")), F.sum("moves")).alias("score"),  # null: no move drawn
        F.avg("rating").alias("true_elo"),
    )
    return with_prediction(grouped, calibration)


def with_prediction(grouped: DataFrame, calibration: DataFrame) -> DataFrame:
    held = grouped.withColumn("_buckets", K.buckets_constant(calibration)).withColumn(
        "_line", K.line_constant(K.fit_line(calibration))
    )
    return held.withColumn("_near", K.nearest_bucket(F.col("score"), F.col("_buckets"))).select(
        *grouped.columns,
        K.line_elo(F.col("score"), F.col("_line")).alias("estimated_elo"),
        F.col("_near.index").alias("predicted_index"),
        K.bucket_index(F.col("low"), F.col("_buckets")).alias("true_index"),
    )


def _gap() -> Column:
    return F.abs(F.col("predicted_index") - F.col("true_index"))


def overall_summary(results: DataFrame) -> DataFrame:
    error = F.col("estimated_elo") - F.col("true_elo")
    return results.groupBy(F.col("size").alias("games_averaged")).agg(
        F.avg((_gap() == 0).cast("double")).alias("accuracy_exact"),
        F.avg((_gap() <= 1).cast("double")).alias("accuracy_within_one_bucket"),
        F.avg(error).alias("mean_signed_error"),
        F.avg(F.abs(error)).alias("mean_absolute_error"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.regr_slope("estimated_elo", "true_elo").alias("slope_estimated_vs_true"),
    )


def bucket_summary(results: DataFrame) -> DataFrame:
    error = F.col("estimated_elo") - F.col("true_elo")
    return results.groupBy(F.col("size").alias("games_averaged"), "low").agg(
        F.avg(error).alias("mean_signed_error"),
        F.stddev_pop(error).alias("error_std"),
        F.avg(F.abs(error)).alias("mean_absolute_error"),
        F.avg((_gap() == 0).cast("double")).alias("accuracy_exact"),
    )


def pairwise_ordering(results: DataFrame) -> DataFrame:
    """Share of trials where the higher bucket scores higher, per bucket gap.

    Each row looks up the buckets below it in the same trial through an equi-join.
    """
    lower = results.select("size", "trial", F.col("true_index").alias("below"), F.col("score").alias("low_score"))
    upper = results.filter("true_index > 0").select(
        "size", "trial", "true_index", "score", F.explode(F.sequence(F.lit(0), F.col("true_index") - 1)).alias("below")
    )
    won = (F.col("score") > F.col("low_score")).cast("double")
    pairs = upper.join(lower, ["size", "trial", "below"]).groupBy(
        F.col("size").alias("games_averaged"), (F.col("true_index") - F.col("below")).alias("bucket_gap"), "below"
    ).agg(F.avg(won).alias("won"))
    return pairs.groupBy("games_averaged", "bucket_gap").agg(F.avg("won").alias("ordering_accuracy"))


# Which signed bucket misses each tolerance mode also accepts.
TOLERANCE = {"+/-0": (), "+/-1": (1, -1), "+1": (1,), "-1": (-1,)}


def tolerant_hit(mode: str) -> Column:
    miss = F.col("predicted_index") - F.col("true_index")
    return miss.isin(0, *TOLERANCE[mode]).cast("double")


def accuracy_curve(results: DataFrame, mode: str = "+/-0") -> DataFrame:
    """Accuracy per bucket and number of games, with the macro average under bucket -1."""
    per = results.groupBy("size", "low").agg(F.avg(tolerant_hit(mode)).alias("accuracy"))
    both = F.explode(F.array(F.col("low").cast("bigint"), F.lit(-1).cast("bigint")))
    return per.select("size", both.alias("low"), "accuracy").groupBy("size", "low").agg(F.avg("accuracy").alias("accuracy"))


def two_stage_trials(
    games: DataFrame, calibration: DataFrame, per_trial: Sequence[int], trials: int, seed: str
) -> DataFrame:
    """Like run_trials, with the game drawn first and then one of its sides."""
    drawn = draws(pool_sizes(games, "low"), "low", per_trial, trials, seed).withColumn(
        "_white", ordered.hash_int(f"{seed}-side", "size", "low", "trial", "nth") % 2 == 0
    )
    joined = join_pool(drawn, games, "low", ["game_id"])
    pick = lambda what: F.when(F.col("_white"), F.col(f"white_{what}")).otherwise(F.col(f"black_{what}")).alias(what)
    return score_trials(joined.select("size", "low", "trial", pick("score"), pick("moves"), pick("rating")), calibration)


def bootstrap_draws(rows: DataFrame, group: str, ids: Sequence[str], replicates: int, seed: str) -> DataFrame:
    """Every replicate draws as many rows as the group has, with replacement; returns drawn rows.

    Draw numbers come from the rows themselves (one per row and replicate), so the work is spread
    as the rows are and no task builds a whole replicate.
    """
    pool = draw_pool(rows, group, ids)
    sizes = pool_sizes(rows, group)
    numbered = pool.select(group, F.col("draw").alias("nth")).join(sizes, group)
    picks = numbered.select(
        group, "pool", "nth", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate")
    ).select(
        group, "replicate", (ordered.hash_int(seed, group, "replicate", "nth") % F.col("pool") + 1).alias("draw")
    )
    return picks.join(pool, [group, "draw"])
