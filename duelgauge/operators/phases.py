"""Game phases: totals, per-phase ratings, gaps and phase-restricted accuracy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duelgauge.operators import calibration as K
from duelgauge.operators import trials as T
from duelgauge.operators.resample import bootstrap_sums
from duelgauge.runtime import constant_list

PHASES = ("opening", "midgame", "endgame")


def phase_totals(move_scores: DataFrame) -> DataFrame:
    return move_scores.groupBy("game_id", "color", "phase").agg(
        F.sum("score").alias("score_sum"), F.count(F.lit(1)).alias("n_moves")
    )


def phase_table(move_scores: DataFrame) -> DataFrame:
    """Mean score and move count per phase; an empty phase keeps its row."""
    listed = move_scores.sparkSession.range(1).select(F.explode(F.array(*[F.lit(p) for p in PHASES])).alias("phase"))
    found = move_scores.groupBy("phase").agg(F.avg("score").alias("average_strength"), F.count(F.lit(1)).alias("n"))
    return listed.join(found, "phase", "left").select(
        "phase", "average_strength", F.coalesce("n", F.lit(0)).cast("bigint").alias("move_count")
    )


def position_map(move_scores: DataFrame) -> DataFrame:
    return move_scores.groupBy("fen_before", "move").agg(
        F.avg("score").alias("average_strength"), F.count(F.lit(1)).alias("n")
    )


def phase_ratings(totals: DataFrame, calibration: DataFrame, *by: str) -> DataFrame:
    """Interpolated rating of the pooled mean score per phase (and per `by`)."""
    pooled = totals.groupBy(*by, "phase").agg(
        (F.sum("score_sum") / F.sum("n_moves")).alias("mean_score"), F.sum("n_moves").alias("n_moves")
    )
    return K.with_estimate(pooled, calibration).drop("estimate_status", "nearest_bucket")


def phase_reference(totals: DataFrame, calibration: DataFrame) -> DataFrame:
    """Reference rating per phase with the mean over the three phases (three rows)."""
    rated = phase_ratings(totals, calibration)
    mean = F.avg("estimated_elo").over(W.partitionBy(F.lit(0)))
    return rated.select("phase", F.col("estimated_elo").alias("phase_elo"), mean.alias("mean_elo"))


def shift_by_reference(rated: DataFrame, reference: DataFrame) -> DataFrame:
    """Add the reference mean and take off the phase's reference; an unknown phase is an error."""
    packed = constant_list(reference, "phase", "phase_elo", "mean_elo")
    held = rated.withColumn("_ref", packed)
    mine = F.get(F.filter(F.col("_ref"), lambda r: r["phase"] == F.col("phase")), F.lit(0))
    known = F.when(mine.isNull(), F.raise_error(F.lit("phase missing in the reference"))).otherwise(mine)
    return held.withColumn("_mine", known).select(
        *rated.columns,
        (F.col("estimated_elo") - F.col("_mine.phase_elo") + F.col("_mine.mean_elo")).alias("phase_norm_elo"),
    )


def phase_report(totals: DataFrame, calibration: DataFrame, reference: DataFrame, by: str = "player") -> DataFrame:
    """Wide report per player; the total is set only when all three phases are present."""
    rated = shift_by_reference(phase_ratings(totals, calibration, by), reference)
    cell = lambda phase, c: F.max(F.when(F.col("phase") == phase, F.col(c)))
    complete = F.count("estimated_elo") == len(PHASES)
    return rated.groupBy(by).agg(
        *[cell(p, "estimated_elo").alias(f"{p}_elo") for p in PHASES],
        *[cell(p, "phase_norm_elo").alias(f"{p}_norm_elo") for p in PHASES],
        *[F.coalesce(cell(p, "n_moves"), F.lit(0)).alias(f"{p}_moves") for p in PHASES],
        F.when(complete, F.avg("estimated_elo")).alias("total_elo"),
    )


def phase_gap_ranking(report: DataFrame) -> DataFrame:
    complete = report.filter(F.col("total_elo").isNotNull())
    gap = F.col("midgame_norm_elo") - F.col("endgame_norm_elo")
    return complete.withColumn("midgame_minus_endgame", gap).orderBy(F.desc("midgame_minus_endgame"))


def site_ratings(player_sides: DataFrame, first: int = 20) -> DataFrame:
    """Mean rating over a player's first games in file order (the rank filter prunes before the shuffle)."""
    order = W.partitionBy("player").orderBy("line_no")
    head = player_sides.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= first)
    return head.groupBy("player").agg(F.avg("elo").alias("site_rating"))


def phase_calibrations(bucket_totals: DataFrame) -> DataFrame:
    return bucket_totals.groupBy("phase", "low", "high").agg(
        ((F.first("low") + F.first("high")) / 2).alias("center"),
        F.try_divide(F.sum("score_sum"), F.sum("n_moves")).alias("mean_score"),
    )


def _line_of(phase: Column, lines: Column) -> Column:
    return F.get(F.filter(lines, lambda l: l["phase"] == phase), F.lit(0))


def lines_constant(lines: DataFrame) -> Column:
    return constant_list(lines, "phase", "slope", "intercept")


def same_line_for_all(line: DataFrame) -> DataFrame:
    return line.select(F.explode(F.array(*[F.lit(p) for p in PHASES])).alias("phase"), "slope", "intercept")


def _estimates(pooled: DataFrame, lines: DataFrame, *by: str) -> DataFrame:
    held = pooled.withColumn("_lines", lines_constant(lines)).withColumn("_line", _line_of(F.col("phase"), F.col("_lines")))
    rated = held.withColumn("estimated_elo", K.line_elo(F.col("mean_phase_score"), F.col("_line")))
    mean = F.avg("estimated_elo").over(W.partitionBy(*by))
    return rated.withColumn("gap_vs_phase_average", F.col("estimated_elo") - mean).drop("_lines", "_line")


def phase_gaps(bucket_totals: DataFrame, lines: DataFrame) -> DataFrame:
    """Per bucket and phase: rating, error, gap to the bucket's phase average, centred gap."""
    pooled = bucket_totals.groupBy("low", "high", "phase").agg(
        F.sum("n_moves").alias("moves"), F.try_divide(F.sum("score_sum"), F.sum("n_moves")).alias("mean_phase_score")
    )
    ratings = (
        bucket_totals.select("low", "game_id", "white_rating", "black_rating")
        .distinct()
        .groupBy("low")
        .agg(F.avg((F.col("white_rating") + F.col("black_rating")) / 2).alias("true_rating"), F.count(F.lit(1)).alias("games"))
    )
    gaps = _estimates(pooled, lines, "low").join(ratings, "low")
    return gaps.withColumn("error_vs_true_rating", F.col("estimated_elo") - F.col("true_rating")).withColumn(
        "gap_centered",
        F.col("gap_vs_phase_average") - F.avg("gap_vs_phase_average").over(W.partitionBy("phase")),
    )


def gap_errors(bucket_totals: DataFrame, lines: DataFrame, replicates: int, seed: str) -> DataFrame:
    """Bootstrap standard error of the gap, resampling the games of each bucket.

    A replicate without a move of a phase has no rating of that phase, and its average is over the others.
    """
    cell = lambda p, c: F.sum(F.when(F.col("phase") == p, F.col(c)).otherwise(0)).alias(f"{p}_{c}")
    games = bucket_totals.groupBy("low", "game_id").agg(*[cell(p, c) for p in PHASES for c in ("score_sum", "n_moves")])
    summed = bootstrap_sums(games, "low", ["game_id"], [f"{p}_{c}" for p in PHASES for c in ("score_sum", "n_moves")], replicates, seed)
    long = summed.select(
        "low",
        "replicate",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(p).alias("phase"), F.try_divide(f"{p}_score_sum", f"{p}_n_moves").alias("mean_phase_score"))
                    for p in PHASES
                ]
            )
        ).alias("r"),
    ).select("low", "replicate", "r.*")
    return _estimates(long, lines, "low", "replicate").groupBy("low", "phase").agg(
        F.stddev_pop("gap_vs_phase_average").alias("gap_se")
    )


def phase_summary(gaps: DataFrame) -> DataFrame:
    return gaps.groupBy("phase").agg(
        F.avg("gap_vs_phase_average").alias("mean_gap"),
        F.avg(F.abs("gap_vs_phase_average")).alias("mean_abs_gap"),
        F.avg("error_vs_true_rating").alias("mean_error_vs_true_rating"),
    )


def phase_pivot(gaps: DataFrame, value: str) -> DataFrame:
    return gaps.groupBy("low").pivot("phase", list(PHASES)).agg(F.first(value))


def phase_entries(bucket_totals: DataFrame) -> DataFrame:
    """Player-games in wide form, as phase_accuracy takes them."""
    cell = lambda p, c: F.sum(F.when(F.col("phase") == p, F.col(c)).otherwise(0)).alias(f"{p}_{c}")
    own = F.when(F.col("color") == "white", F.col("white_rating")).otherwise(F.col("black_rating"))
    return bucket_totals.groupBy("low", "game_id", "color").agg(
        F.max(own).alias("rating"), *[cell(p, c) for p in PHASES for c in ("score_sum", "n_moves")]
    )


def phase_accuracy(
    entries: DataFrame, calibrations: DataFrame, per_trial: Sequence[int], trials: int, seed: str
) -> DataFrame:
    """Predict the bucket from the moves of one phase only.

    Entries are player-games in wide form: (low, game_id, color, rating, <phase>_score_sum,
    <phase>_n_moves). The same draws serve all phases; trials without a move in the phase drop out.
    """
    drawn = T.draws(T.pool_sizes(entries, "low"), "low", per_trial, trials, seed)
    drawn = T.join_pool(drawn, entries, "low", ["game_id", "color"])
    summed = drawn.groupBy("size", "low", "trial").agg(
        F.avg("rating").alias("true_elo"),
        *[F.sum(f"{p}_{c}").alias(f"{p}_{c}") for p in PHASES for c in ("score_sum", "n_moves")],
    )
    long = summed.select(
        "size",
        "low",
        "trial",
        "true_elo",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(p).alias("phase"),
                        F.col(f"{p}_n_moves").alias("n_moves"),
                        F.when(F.col(f"{p}_n_moves") > 0, F.col(f"{p}_score_sum") / F.col(f"{p}_n_moves")).alias("score"),
                    )
                    for p in PHASES
                ]
            )
        ).alias("r"),
    ).select("size", "low", "trial", "true_elo", "r.*")
    held = long.withColumn("_all", constant_list(calibrations, "phase", "low", "high", "center", "mean_score")).withColumn(
        "_lines", lines_constant(K.fit_line(calibrations, "phase"))
    )
    mine = F.filter(F.col("_all"), lambda b: b["phase"] == F.col("phase"))
    rated = (
        held.withColumn("_buckets", mine)
        .withColumn("_near", K.nearest_bucket(F.col("score"), F.col("_buckets")))
        .withColumn("_gap", F.abs(F.col("_near.index") - K.bucket_index(F.col("low"), F.col("_buckets"))))
        .withColumn("_error", K.line_elo(F.col("score"), _line_of(F.col("phase"), F.col("_lines"))) - F.col("true_elo"))
    )
    used = F.col("n_moves") > 0
    return rated.groupBy("phase", F.col("size").alias("games_averaged")).agg(
        F.avg(F.when(used, (F.col("_gap") == 0).cast("double"))).alias("accuracy_exact"),
        F.avg(F.when(used, (F.col("_gap") <= 1).cast("double"))).alias("accuracy_within_one_bucket"),
        F.avg(F.when(used, F.col("_error"))).alias("mean_signed_error"),
        F.avg(F.when(used, F.abs("_error"))).alias("mean_absolute_error"),
        F.avg(used.cast("double")).alias("fraction_trials_with_phase_moves"),
    )
