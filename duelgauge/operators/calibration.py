"""Score calibration: bucket means, fitted line, interpolation, nearest bucket, player reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duelgauge.functions.rating import invert_line
from duelgauge.runtime import constant_list, constant_row

COLORS = ("white", "black")


def bucket_means(scores: DataFrame) -> DataFrame:
    """Move-weighted mean score of both sides per bucket."""
    total = F.col("white_score") * F.col("white_moves") + F.col("black_score") * F.col("black_moves")
    return scores.groupBy("low", "high").agg(
        ((F.first("low") + F.first("high")) / 2).alias("center"),
        F.count(F.lit(1)).alias("games"),
        F.sum(F.col("white_moves") + F.col("black_moves")).alias("moves"),
        (F.sum(total) / F.sum(F.col("white_moves") + F.col("black_moves"))).alias("mean_score"),
    )


def fit_line(calibration: DataFrame, *by: str) -> DataFrame:
    """Least squares: mean score as a line over bucket centers."""
    return calibration.groupBy(*by).agg(
        F.regr_slope("mean_score", "center").alias("slope"),
        F.regr_intercept("mean_score", "center").alias("intercept"),
    )


def line_constant(line: DataFrame) -> Column:
    return constant_row(line, "slope", "intercept")


def line_elo(score: Column, line: Column) -> Column:
    return invert_line(score, line["slope"], line["intercept"])


def line_quality(calibration: DataFrame) -> DataFrame:
    fitted = calibration.withColumn("_line", line_constant(fit_line(calibration)))
    residual = line_elo(F.col("mean_score"), F.col("_line")) - F.col("center")
    return fitted.agg(
        (F.max(F.col("_line")["slope"]) * 100).alias("score_per_100_elo"),
        F.max(F.abs(residual)).alias("max_abs_bucket_residual_elo"),
        F.sqrt(F.avg(residual * residual)).alias("rms_bucket_residual_elo"),
    )


def order_violations(calibration: DataFrame) -> DataFrame:
    """Adjacent buckets whose means do not increase. One row per bucket: a tiny ordered window."""
    after = W.partitionBy(F.lit(0)).orderBy("low")
    follow = calibration.select(
        "low", "high", "mean_score", F.lead("low").over(after).alias("next_low"), F.lead("mean_score").over(after).alias("next_mean")
    )
    return follow.filter(F.col("mean_score") >= F.col("next_mean"))


def same_buckets(left: DataFrame, right: DataFrame) -> DataFrame:
    """Buckets that only one of two corpora has; empty means they agree."""
    a, b = left.select("low").distinct(), right.select("low").distinct()
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def buckets_constant(calibration: DataFrame) -> Column:
    """Buckets in rating order, attached to rows as a constant array."""
    return constant_list(calibration, "low", "high", "center", "mean_score")


def nearest_bucket(score: Column, buckets: Column) -> Column:
    """Struct (gap, index, low, high) of the bucket with the closest mean; the lowest wins a tie."""
    return F.array_min(
        F.transform(
            buckets,
            lambda b, i: F.struct(
                F.abs(score - b["mean_score"]).alias("gap"),
                i.alias("index"),
                b["low"].alias("low"),
                b["high"].alias("high"),
            ),
        )
    )


def bucket_index(low: Column, buckets: Column) -> Column:
    """0-based position of a bucket, NULL for a bucket that was not calibrated."""
    return F.nullif(F.array_position(F.transform(buckets, lambda b: b["low"]), low), F.lit(0)).cast("int") - 1


def segments_constant(calibration: DataFrame) -> Column:
    """Line segments between neighbouring bucket means, ordered by mean score."""
    pair = lambda left, right: F.struct(
        left["mean_score"].alias("s0"), left["center"].alias("e0"), right["mean_score"].alias("s1"), right["center"].alias("e1")
    )
    neighbours = lambda v: F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1), pair)
    return constant_list(calibration, "mean_score", "center", shape=neighbours)


def interpolated_elo(score: Column, segments: Column) -> Column:
    """Struct (estimated_elo, status): linear between buckets, end segments extended."""
    reachable = F.filter(segments, lambda s: score <= s["s1"])
    seg = F.when(F.size(reachable) > 0, F.get(reachable, F.lit(0))).otherwise(F.element_at(segments, -1))
    status = (
        F.when(score < F.get(segments, F.lit(0))["s0"], "extrapolated_below")
        .when(score > F.element_at(segments, -1)["s1"], "extrapolated_above")
        .otherwise("interpolated")
    )
    width = F.when(seg["s1"] == seg["s0"], F.raise_error(F.lit("neighbouring buckets have equal means"))).otherwise(
        seg["s1"] - seg["s0"]
    )
    elo = seg["e0"] + (score - seg["s0"]) / width * (seg["e1"] - seg["e0"])
    return F.when(score.isNotNull(), F.struct(elo.alias("estimated_elo"), status.alias("estimate_status")))


def with_estimate(df: DataFrame, calibration: DataFrame, score: str = "mean_score") -> DataFrame:
    held = df.withColumn("_seg", segments_constant(calibration)).withColumn("_buckets", buckets_constant(calibration))
    near = nearest_bucket(F.col(score), F.col("_buckets"))
    return (
        held.withColumn("_e", interpolated_elo(F.col(score), F.col("_seg")))
        .withColumn("_n", near)
        .select(
            *df.columns,
            "_e.estimated_elo",
            "_e.estimate_status",
            F.concat_ws("-", F.col("_n.low").cast("string"), F.col("_n.high").cast("string")).alias("nearest_bucket"),
        )
    )


def side_scores(scores: DataFrame) -> DataFrame:
    """Wide game scores to one row per (game, colour)."""
    side = lambda c: F.struct(
        F.lit(c).alias("color"),
        F.col(f"{c}_score").alias("score"),
        F.col(f"{c}_moves").alias("moves"),
        F.col(f"{c}_rating").alias("rating"),
    )
    return scores.select("game_id", "low", F.explode(F.array(*[side(c) for c in COLORS])).alias("s")).select(
        "game_id", "low", "s.*"
    )


def score_problem(score: Column, plies: Column) -> Column:
    """Why a scored game cannot be used, or NULL."""
    bad = score.isNull() | F.isnan(score) | (F.abs(score) == float("inf"))
    return F.when(plies < 2, "too_short").when(bad, "non_finite_score")


def player_report(rows: DataFrame) -> DataFrame:
    """Per player: matched, analysed and skipped games, moves, weighted mean, median rating.

    Ratings are small integers, so the exact median keeps at most a few thousand counters.
    """
    good = F.col("problem").isNull()
    weight = F.when(good, F.col("moves"))
    return rows.groupBy("player").agg(
        F.count(F.lit(1)).alias("matched_games"),
        F.count_if(good).alias("analyzed_games"),
        F.count_if(~good).alias("skipped_games"),
        F.coalesce(F.sum(weight), F.lit(0)).alias("moves"),
        (F.sum(F.when(good, F.col("score") * F.col("moves"))) / F.sum(weight)).alias("mean_score"),
        F.percentile("rating", 0.5).alias("median_recorded_rating"),
    )
