"""Self-play statistics, match results, rating ladders, training curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duelgauge.functions.rating import step_elo


def current_model_only(records: DataFrame, model: str = "model_step", current: str = "iteration") -> DataFrame:
    """Drop records that were not made by the model of their iteration."""
    return records.filter(F.col(model) == F.col(current))


def iteration_stats(records: DataFrame) -> DataFrame:
    """Per iteration; length and return statistics cover finished games only."""
    done = F.col("is_terminal")
    finished = lambda c: F.when(done, F.col(c)).cast("double")
    out = []
    for name, c in (("length", "game_length"), ("return", "ret")):
        v = finished(c)
        out += [
            F.min(v).alias(f"min_{name}"),
            F.max(v).alias(f"max_{name}"),
            F.avg(v).alias(f"avg_{name}"),
            F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias(f"std_{name}"),
        ]
    return records.groupBy("iteration").agg(
        F.count(F.lit(1)).alias("games"), F.count_if(done).alias("finished_games"), *out, F.avg("data_length").alias("avg_data_length")
    )


def match_summary(rows: DataFrame, first_is_white: bool = False) -> DataFrame:
    """Per model pair: player-1 wins by colour, draws, duplicates, win rate with half-draws.

    `alt` says whether colours were swapped; `res_b` is the result seen from Black, as a number or
    as B+… / W+… for a resignation.
    """
    white_alt = 0 if first_is_white else 1
    resign = "W+" if first_is_white else "B+"
    as_white = F.col("alt") == white_alt
    resigned = F.col("res_b").contains(resign)
    drawn = F.col("res_b").isin("0.000000", "0")
    white_win = as_white & ((F.col("res_b") == "-1.000000") | resigned)
    black_win = ~as_white & ((F.col("res_b") == "1.000000") | resigned)
    wins = F.count_if(white_win) + F.count_if(black_win)
    return rows.groupBy("p1", "p2").agg(
        F.count_if(black_win).alias("black_wins"),
        F.count_if(white_win).alias("white_wins"),
        F.count_if(drawn).alias("draws"),
        F.count_if(F.col("dup") != "-").alias("duplicates"),
        F.count(F.lit(1)).alias("total"),
        F.round((wins + F.count_if(drawn) / 2) / F.count(F.lit(1)), 4).alias("win_rate"),
    )


def elo_ladder(summary: DataFrame) -> DataFrame:
    """Cumulative rating over successive models (one row per model pair, so one small window)."""
    order = W.partitionBy(F.lit(0)).orderBy("p1", "p2").rowsBetween(W.unboundedPreceding, 0)
    return summary.withColumn("elo", F.round(F.sum(F.round(step_elo(F.col("win_rate")), 3)).over(order), 3))


def opponent_elo(summary: DataFrame, known: DataFrame) -> DataFrame:
    """Player-2 rating from player 1's known rating at the same step; unknown steps stay NULL."""
    joined = summary.join(known.select(F.col("p1"), F.col("elo").alias("p1_elo")), "p1", "left")
    return joined.withColumn("p2_elo", F.round(F.col("p1_elo") + step_elo(F.lit(1.0) - F.col("win_rate")), 3))


def metric_curves(values: DataFrame) -> DataFrame:
    return values.groupBy("step", "metric").agg(F.avg("value").alias("value"))


def iteration_durations(log: DataFrame) -> DataFrame:
    """Total, optimisation and self-play seconds per iteration from marked log events."""
    at = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("ts")))
    stamps = log.groupBy("iteration").agg(
        at("iteration_start").alias("a"), at("optimization_start").alias("b"), at("optimization_finish").alias("c")
    )
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    seconds = lambda later, earlier: (micros(later) - micros(earlier)) / F.lit(1e6)
    return stamps.filter("c IS NOT NULL").select(
        "iteration",
        seconds("c", "a").alias("total_s"),
        seconds("c", "b").alias("optimization_s"),
        seconds("b", "a").alias("selfplay_s"),
    )


def sweep_table(accuracies: DataFrame, games: list[int]) -> DataFrame:
    """One row per model step, one column per number of games."""
    return accuracies.groupBy("step").pivot("games", games).agg(F.first("accuracy"))


def sweep_long(table: DataFrame, games: list[int]) -> DataFrame:
    return table.unpivot(["step"], [str(g) for g in games], "games", "accuracy").select(
        "step", F.col("games").cast("bigint").alias("games"), "accuracy"
    )
