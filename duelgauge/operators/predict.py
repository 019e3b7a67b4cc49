"""Outcome predictions and their evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelgauge.functions import rating as R
from duelgauge.runtime import require

PROBABILITIES = ("p_white", "p_draw", "p_black")


def with_prediction(df: DataFrame, triple: Column) -> DataFrame:
    return df.withColumn("_p", triple).select("*", "_p.*").drop("_p")


def strength_predictions(
    strengths: DataFrame, draw_rate: float = R.DRAW_RATE, line: tuple[float, float] = R.DEFAULT_LINE
) -> DataFrame:
    rated = strengths.select(
        "*", *[R.score_to_elo(F.col(f"{s}_strength"), line).alias(f"{s}_estimated_elo") for s in ("white", "black")]
    )
    return with_prediction(
        rated, R.elo_to_probs(F.col("white_estimated_elo"), F.col("black_estimated_elo"), draw_rate)
    )


def probability_violations(predictions: DataFrame) -> DataFrame:
    """Rows whose probabilities leave [0, 1] or do not add up to one."""
    outside = F.lit(False)
    for p in PROBABILITIES:
        outside = outside | ~F.col(p).between(0.0, 1.0)
    off = F.abs(F.col("p_white") + F.col("p_draw") + F.col("p_black") - 1.0) > 1e-5
    return predictions.filter(outside | off)


def join_violations(examples: DataFrame, predictions: DataFrame, key: str = "game_id") -> DataFrame:
    """Counts of duplicate, missing and unknown prediction ids."""
    want = examples.groupBy(key).agg(F.count(F.lit(1)).alias("_want"))
    have = predictions.groupBy(key).agg(F.count(F.lit(1)).alias("_have"))
    return want.join(have, key, "full_outer").agg(
        F.count_if(F.col("_have") > 1).alias("duplicate"),
        F.count_if(F.col("_have").isNull()).alias("missing"),
        F.count_if(F.col("_want").isNull()).alias("unknown"),
    )


def strict_join(examples: DataFrame, predictions: DataFrame, key: str = "game_id") -> DataFrame:
    """One prediction for every example and nothing else; any violation fails the job."""
    have = predictions.groupBy(key).agg(
        F.count(F.lit(1)).alias("_have"), *[F.any_value(c).alias(c) for c in predictions.columns if c != key]
    )
    joined = examples.withColumn("_example", F.lit(True)).join(have, key, "full_outer")
    good = F.coalesce(F.col("_example") & (F.col("_have") == 1), F.lit(False))
    return require(joined, good, "predictions must match examples one to one").drop("_example", "_have")


def _metric_columns() -> list[Column]:
    triple = [F.col("result"), *[F.col(p) for p in PROBABILITIES]]
    hit = (F.col("predicted") == F.col("result")).cast("double")
    return [
        F.count(F.lit(1)).alias("n_examples"),
        F.round(F.avg(hit), 6).alias("accuracy"),
        F.round(F.avg((F.col("result") == 0).cast("double")), 6).alias("draw_rate"),
        F.round(F.avg(R.log_loss(*triple)), 6).alias("log_loss"),
        F.round(F.avg(R.brier(*triple)), 6).alias("brier_score"),
    ]


def metrics(scored: DataFrame, *by: str) -> DataFrame:
    return scored.groupBy(*by).agg(*_metric_columns())


SLICES = {
    "elo_bucket": lambda: R.elo_bucket(F.col("white_elo"), F.col("black_elo")),
    "elo_diff_bucket": lambda: R.difference_bucket(F.col("white_elo"), F.col("black_elo")),
    "month": lambda: R.month_bucket(F.col("played_at")),
    "context_size": lambda: F.col("context_size").cast("string"),
}


def slice_metrics(scored: DataFrame, minimum: int = 20, slices: dict | None = None) -> DataFrame:
    """Accuracy per bucket of every slice in one pass (grouping sets); small buckets are dropped."""
    slices = slices or SLICES
    names = list(slices)
    keyed = scored.select(
        (F.col("predicted") == F.col("result")).cast("double").alias("_hit"),
        *[key().alias(name) for name, key in slices.items()],
    )
    grouped = keyed.groupingSets([[F.col(n)] for n in names], *[F.col(n) for n in names]).agg(
        F.round(F.avg("_hit"), 6).alias("accuracy"),
        F.count(F.lit(1)).alias("n"),
        F.grouping_id(*[F.col(n) for n in names]).alias("_set"),
    )
    slice_name, bucket = None, None
    everything = (1 << len(names)) - 1
    for i, name in enumerate(names):
        mine = F.col("_set") == (everything ^ (1 << (len(names) - 1 - i)))
        slice_name = F.when(mine, name) if slice_name is None else slice_name.when(mine, name)
        bucket = F.when(mine, F.col(name)) if bucket is None else bucket.when(mine, F.col(name))
    low = F.regexp_extract("bucket", r"^(\d+)", 1).try_cast("bigint")
    return (
        grouped.filter(F.col("n") >= minimum)
        .select(slice_name.alias("slice"), bucket.alias("bucket"), "accuracy", "n")
        .orderBy("slice", low, "bucket")
    )
