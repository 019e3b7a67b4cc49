"""Move-level evaluation: frames, rank strength, move agreement, class votes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duelgauge.operators import ordered
from duelgauge.operators import trials as T


def go_rank(text: Column) -> Column:
    """Dan ranks as they are, kyu ranks folded to 0 (1-2k) or -1 (3k and weaker); empty is 0."""
    number = F.regexp_extract(text, r"^(\d+)", 1).try_cast("int")
    kyu = F.when(1 - number <= -2, -1).when(1 - number <= 0, 0).otherwise(1 - number)
    return F.when(text.isNull() | (text == ""), 0).when(text.rlike("[kK]"), kyu).otherwise(number)


def select_frame(
    move_scores: DataFrame, frame: str, parity: int | None = None, seed: str = "frame", max_positions: int | None = None
) -> DataFrame:
    """Positions of a game inside a frame: all, first_50, last_50 or one hash-chosen move of those there are.

    `max_positions` drops later plies where a caller wants that.
    """
    rows = move_scores
    if frame == "last_50":
        rows = rows.join(rows.groupBy("game_id").agg(F.count(F.lit(1)).alias("_len")), "game_id")
    if frame == "one_move":
        first = F.min(F.struct(ordered.hash_text(seed, "game_id", "ply"), "ply"))["ply"]
        rows = rows.join(rows.groupBy("game_id").agg(first.alias("_one")), "game_id")
    ply = F.col("ply")
    inside = {
        "all": F.lit(True),
        "first_50": ply < 50,
        "last_50": ply >= F.col("_len") - 50 if frame == "last_50" else None,
        "one_move": ply == F.col("_one") if frame == "one_move" else None,
    }[frame]
    if max_positions is not None:
        inside = inside & (ply < max_positions)
    kept = rows.filter(inside).drop("_len", "_one")
    return kept if parity is None else kept.filter(ply % 2 == parity)


def rank_strength(framed: DataFrame) -> DataFrame:
    """Plain mean of the per-move scores of both sides, per rank."""
    return framed.groupBy("rank").agg(F.avg("score").alias("mean_score"), F.count(F.lit(1)).alias("positions"))


def strength_by_ply(rows: DataFrame) -> DataFrame:
    return rows.groupBy("rank", "ply").agg(
        (F.sum(F.col("score") * F.col("weight")) / F.sum("weight")).alias("strength"), F.count(F.lit(1)).alias("n")
    )


def played_order(policy: Column, played: Column) -> Column:
    """1 + number of moves the policy prefers strictly to the played one."""
    mine = F.get(policy, played)
    return F.size(F.filter(policy, lambda p: p > mine)) + 1


def agreement_curve(rows: DataFrame) -> DataFrame:
    """Cumulative share of played moves within the policy's best k, per rank and overall (`all`).

    Input has (rank STRING, played_order). The histogram has one row per order, at most the policy
    size, so the cumulative windows are small.
    """
    counted = rows.groupBy("rank", F.col("played_order").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    ranks = F.explode(F.array(F.col("rank"), F.lit("all"))).alias("rank")
    both = counted.select(ranks, "k", "n").groupBy("rank", "k").agg(F.sum("n").alias("n"))
    upto = W.partitionBy("rank").orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy("rank")
    return both.select("rank", "k", (F.sum("n").over(upto) / F.sum("n").over(whole)).alias("accuracy"))


def class_totals(positions: DataFrame, mode: str) -> DataFrame:
    """Per (game, parity, class): summed probability, or the number of positions won by the class."""
    if mode == "max_prob":
        rows = positions.select("game_id", (F.col("ply") % 2).alias("parity"), F.posexplode("classes").alias("class", "value"))
    elif mode == "max_num":
        winner = F.array_position("classes", F.array_max("classes")).cast("int") - 1
        rows = positions.select("game_id", (F.col("ply") % 2).alias("parity"), winner.alias("class"), F.lit(1.0).alias("value"))
    else:
        raise ValueError(f"unknown vote mode {mode}")
    return rows.groupBy("game_id", "parity", "class").agg(F.sum(F.col("value").cast("double")).alias("value"))


def class_trials(
    games: DataFrame, positions: DataFrame, mode: str, per_trial: Sequence[int], trials: int, seed: str, offset: int = 1
) -> DataFrame:
    """Predicted class per (size, rank, trial) from drawn games and a drawn side of each.

    Votes are summed per game and side before the draws join them, so a drawn game brings one row
    per class, not one per position.
    """
    drawn = T.draws(T.pool_sizes(games, "rank"), "rank", per_trial, trials, seed).withColumn(
        "parity", ordered.hash_int(f"{seed}-side", "size", "rank", "trial", "nth") % 2
    )
    votes = T.join_pool(drawn, games, "rank", ["game_id"]).join(class_totals(positions, mode), ["game_id", "parity"])
    summed = votes.groupBy("size", "rank", "trial", "class").agg(F.sum("value").alias("value"))
    best = summed.groupBy("size", "rank", "trial").agg(
        F.min_by("class", F.struct((-F.col("value")).alias("v"), F.col("class").alias("c"))).alias("best")
    )
    return best.select(
        "size", "rank", "trial", (F.col("best") - offset).alias("predicted_index"), F.col("rank").alias("true_index")
    )


def class_accuracy(results: DataFrame, mode: str) -> DataFrame:
    return results.groupBy("size", "rank").agg(F.avg(T.tolerant_hit(mode)).alias("accuracy"))


def search_agreement(rows: DataFrame) -> DataFrame:
    """Share of chosen actions equal to the recorded one by simulation count and temperature."""
    match = (F.col("chosen") == F.col("actual")).cast("double")
    return rows.groupBy("simulation", "temperature").agg(F.avg(match).alias("accuracy"), F.count(F.lit(1)).alias("n"))
