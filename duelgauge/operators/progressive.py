"""Prefix scores, live blending with context, trajectories and their curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelgauge.functions import rating as R
from duelgauge.operators import ordered
from duelgauge.operators.predict import metrics, with_prediction

SEGMENT_PLIES = 512
CONTEXT_MOVES = 40.0
LIVE_WEIGHT = 8.0


def _segment() -> Column:
    return F.floor(F.col("ply") / SEGMENT_PLIES)


def prefix_means(move_scores: DataFrame) -> DataFrame:
    """Running mean of each side's own moves at its plies, with the move number of that side.

    Scoring every prefix of a game equals one running sum over its per-move scores.
    """
    sums = ordered.running_totals(
        move_scores, ["game_id", "color"], ["ply"], _segment(), {"_sum": F.col("score"), "n": F.lit(1).cast("bigint")}
    )
    return sums.withColumn("prefix_mean", F.col("_sum") / F.col("n")).drop("_sum")


def instantaneous(prefixes: DataFrame) -> DataFrame:
    """Single-move score recovered from prefix means: n·mean(n) − (n−1)·mean(n−1).

    The previous prefix is found by an equi-join on the move number, so game length does not matter.
    """
    before = prefixes.select("game_id", "color", (F.col("n") + 1).alias("n"), F.col("prefix_mean").alias("_before"))
    joined = prefixes.join(before, ["game_id", "color", "n"], "left")
    value = F.col("n") * F.col("prefix_mean") - (F.col("n") - 1) * F.coalesce("_before", F.lit(0.0))
    return joined.withColumn("instantaneous", value).drop("_before")


def last_known(move_scores: DataFrame) -> DataFrame:
    """Latest score of both sides at every ply."""
    side = lambda c: F.when(F.col("color") == c, F.col("score"))
    return ordered.running_last(
        move_scores, ["game_id"], "ply", _segment(), {"white_last": side("white"), "black_last": side("black")}
    )


def observed_prefixes(move_scores: DataFrame) -> DataFrame:
    """Both sides' running means and counts after each observed ply."""
    mine = lambda c, v: F.when(F.col("color") == c, v)
    sums = ordered.running_totals(
        move_scores,
        ["game_id"],
        ["ply"],
        _segment(),
        {
            "_ws": F.coalesce(mine("white", F.col("score")), F.lit(0.0)),
            "white_seen": F.coalesce(mine("white", F.lit(1)), F.lit(0)).cast("bigint"),
            "_bs": F.coalesce(mine("black", F.col("score")), F.lit(0.0)),
            "black_seen": F.coalesce(mine("black", F.lit(1)), F.lit(0)).cast("bigint"),
        },
    )
    mean = lambda total, n: F.when(F.col(n) > 0, F.col(total) / F.col(n))
    return sums.select(
        "game_id",
        (F.col("ply") + 1).alias("observed_plies"),
        mean("_ws", "white_seen").alias("white_current_strength"),
        mean("_bs", "black_seen").alias("black_current_strength"),
        "white_seen",
        "black_seen",
    )


def trajectories(
    examples: DataFrame,
    move_scores: DataFrame,
    context_moves: float = CONTEXT_MOVES,
    live_weight: float = LIVE_WEIGHT,
    line: tuple[float, float] = R.DEFAULT_LINE,
) -> DataFrame:
    """Context-only row at ply 0, then a blended prediction at every observed ply from 2 on.

    Examples carry game_id, result, total_plies, {white,black}_context_strength and
    {white,black}_context_games.
    """
    blank = [
        F.lit(0).cast("bigint").alias("observed_plies"),
        *[F.lit(None).cast("double").alias(f"{s}_current_strength") for s in ("white", "black")],
        *[F.lit(0).cast("bigint").alias(f"{s}_seen") for s in ("white", "black")],
    ]
    seen = observed_prefixes(move_scores).filter("observed_plies >= 2")
    rows = examples.select("*", *blank).unionByName(examples.join(seen, "game_id"))
    for side in ("white", "black"):
        held = F.col(f"{side}_context_games") * context_moves
        live = F.col(f"{side}_seen") * live_weight
        total = held + live
        context = F.col(f"{side}_context_strength")
        blended = (held * context + live * F.coalesce(f"{side}_current_strength", F.lit(0.0))) / total
        rows = rows.withColumn(f"{side}_blended_strength", F.when(total > 0, blended).otherwise(context)).withColumn(
            f"{side}_current_game_fraction", F.when(total > 0, live / total).otherwise(0.0)
        )
        rows = rows.withColumn(f"{side}_estimated_elo", R.score_to_elo(F.col(f"{side}_blended_strength"), line))
    rows = rows.withColumn("is_recorded_endpoint", F.col("observed_plies") == F.col("total_plies"))
    return with_prediction(rows, R.elo_to_probs(F.col("white_estimated_elo"), F.col("black_estimated_elo")))


def with_baseline(rows: DataFrame, line: tuple[float, float] = R.DEFAULT_LINE) -> DataFrame:
    """Attach each example's context-only prediction (what its ply-0 row says) to all its rows.

    Every row carries the context strengths, so the ply-0 prediction is recomputed in place instead
    of joining the trajectory with itself.
    """
    elo = lambda side: R.score_to_elo(F.col(f"{side}_context_strength"), line)
    rated = rows.withColumn("base_white_estimated_elo", elo("white")).withColumn("base_black_estimated_elo", elo("black"))
    held = rated.withColumn(
        "_base", R.elo_to_probs(F.col("base_white_estimated_elo"), F.col("base_black_estimated_elo"))
    )
    keep = ("p_white", "p_draw", "p_black", "predicted")
    return held.select("*", *[F.col("_base")[c].alias(f"base_{c}") for c in keep]).drop("_base")


def metrics_by_ply(rows: DataFrame) -> DataFrame:
    """Progressive and context-only metrics at every observed ply."""
    joined = with_baseline(rows)
    keep = ("p_white", "p_draw", "p_black", "predicted")
    either = joined.select(
        "observed_plies",
        "result",
        F.explode(
            F.array(
                F.struct(F.lit("progressive").alias("estimate"), *keep),
                F.struct(F.lit("context_only").alias("estimate"), *[F.col(f"base_{c}").alias(c) for c in keep]),
            )
        ).alias("e"),
    ).select("observed_plies", "result", "e.*")
    return metrics(either, "observed_plies", "estimate")


def export_rows(rows: DataFrame, line: tuple[float, float] = R.DEFAULT_LINE) -> DataFrame:
    """The flat progressive export of decisive games, seen from the winner."""
    won = with_baseline(rows.filter("result != 0"), line)
    sign = R.winner_sign(F.col("result"))
    diff = F.col("white_estimated_elo") - F.col("black_estimated_elo")
    base = F.col("base_white_estimated_elo") - F.col("base_black_estimated_elo")
    return won.select(
        F.col("game_id").alias("example_id"),
        "game_id",
        "observed_plies",
        (F.col("observed_plies") / 2).alias("observed_full_moves"),
        F.col("total_plies").alias("game_length_plies"),
        F.when(F.col("total_plies") > 0, F.col("observed_plies") / F.col("total_plies")).otherwise(0.0).alias("game_progress"),
        F.when(F.col("result") > 0, "WHITE_WIN").otherwise("BLACK_WIN").alias("actual_result"),
        F.when(F.col("result") > 0, "white").otherwise("black").alias("winner_color"),
        "is_recorded_endpoint",
        "white_context_strength",
        "black_context_strength",
        "white_current_strength",
        "black_current_strength",
        "white_blended_strength",
        "black_blended_strength",
        "white_estimated_elo",
        "black_estimated_elo",
        diff.alias("white_elo_difference"),
        (sign * base).alias("context_only_winner_elo_difference"),
        (sign * diff).alias("winner_elo_difference"),
        F.col("p_white").alias("white_win_probability"),
        F.col("p_draw").alias("draw_probability"),
        F.col("p_black").alias("black_win_probability"),
        R.winner_probability(F.col("result"), F.col("p_white"), F.col("p_black")).alias("winner_probability"),
        "white_current_game_fraction",
        "black_current_game_fraction",
        F.lit(LIVE_WEIGHT).alias("current_move_weight"),
        F.lit(CONTEXT_MOVES).alias("typical_moves_per_player_per_game"),
        F.lit(line == R.LEGACY_LINE).alias("legacy_calibration"),
    )


def estimates_long(export: DataFrame, slope: float = R.DEFAULT_LINE[0]) -> DataFrame:
    """Three estimates per row: progressive, context only, and current game only where it exists."""
    sign = F.when(F.col("winner_color") == "white", 1).otherwise(-1)
    current = (F.col("white_current_strength") - F.col("black_current_strength")) * slope * sign
    wide = export.select(
        "example_id",
        "observed_plies",
        "game_progress",
        F.col("winner_elo_difference").alias("Progressive"),
        F.col("context_only_winner_elo_difference").alias("Context only"),
        current.alias("Current game only"),
    )
    ids = ["example_id", "observed_plies", "game_progress"]
    long = wide.unpivot(ids, ["Progressive", "Context only", "Current game only"], "estimate", "elo_difference")
    return long.filter(F.col("elo_difference").isNotNull())


def curve(long: DataFrame, key: Column, name: str) -> DataFrame:
    sd = F.coalesce(F.stddev_samp("elo_difference"), F.lit(0.0))
    return long.groupBy(key.alias(name), "estimate").agg(
        F.avg("elo_difference").alias("mean"), (sd / F.sqrt(F.count(F.lit(1)))).alias("standard_error"), F.count(F.lit(1)).alias("n")
    )


def progress_bin(percent: int) -> Column:
    width = percent / 100.0
    return F.least(F.greatest(F.bround(F.col("game_progress") / width, 0) * percent, F.lit(0.0)), F.lit(100.0))


def games_by_ply(export: DataFrame) -> DataFrame:
    return export.groupBy("observed_plies").agg(F.count_distinct("example_id").alias("games"))
