"""Corpus overlap, bag matching, positional comparison and cohort comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelgauge.operators import ordered

ERROR_SLICE = 10.0


def game_key(result: Column, white: Column, black: Column, day: Column, moves: Column) -> Column:
    """Digest identifying one exact game; names compare without case."""
    return F.md5(F.concat_ws("|", result.cast("string"), F.lower(white), F.lower(black), day.cast("string"), moves))


def overlap_by_owner(corpus: DataFrame, owned: DataFrame) -> DataFrame:
    """How many lines of a corpus are games of each owner; the latest owner of a key wins.

    The corpus is counted per key before the join, so copies of one game travel as one row.
    """
    owner = owned.groupBy("key").agg(F.max_by("owner", "line_no").alias("owner"))
    lines = corpus.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return lines.join(owner, "key").groupBy("owner").agg(F.sum("n").alias("overlaps"))


def bag_match(original: DataFrame, legacy: DataFrame, key: str = "key", order: str = "line_no") -> DataFrame:
    """Original rows matched against the legacy bag: a key matches as often as it occurs there."""
    quota = legacy.groupBy(key).agg(F.count(F.lit(1)).alias("_quota"))
    known = original.join(quota, key)
    ranked = ordered.row_numbers(known, [key], [order], ordered.id_levels(F.col(order)), "_rn")
    return ranked.filter(F.col("_rn") <= F.col("_quota")).drop("_rn", "_quota")


def bag_summary(original: DataFrame, legacy: DataFrame, key: str = "key") -> DataFrame:
    have = original.groupBy(key).agg(F.count(F.lit(1)).alias("_have"))
    want = legacy.groupBy(key).agg(F.count(F.lit(1)).alias("_want"))
    both = want.join(have, key, "left")
    hit = F.least(F.col("_want"), F.coalesce("_have", F.lit(0)))
    return both.agg(F.sum(hit).alias("matched"), F.sum(F.col("_want") - hit).alias("unmatched_legacy"))


def first_differences(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per line of two aligned corpora: the first ply that differs, with `<end>` past the shorter game.

    Inputs are (line_no, ply, move); identical games give a NULL ply. Both corpora are shuffled once,
    by line; the groups by ply lie within that layout.
    """
    a = old.select("line_no", "ply", F.col("move").alias("old"), F.lit(None).cast("string").alias("new"))
    b = new.select("line_no", "ply", F.lit(None).cast("string").alias("old"), F.col("move").alias("new"))
    together = a.unionByName(b).repartition("line_no")
    merged = together.groupBy("line_no", "ply").agg(F.max("old").alias("old"), F.max("new").alias("new"))
    differs = ~F.col("old").eqNullSafe(F.col("new"))
    at = F.when(differs, F.col("ply"))
    pair = F.struct(F.coalesce("old", F.lit("<end>")).alias("old"), F.coalesce("new", F.lit("<end>")).alias("new"))
    first = merged.groupBy("line_no").agg(F.min(at).alias("ply"), F.min_by(pair, at).alias("_pair"))
    return first.select(
        "line_no",
        "ply",
        F.when(F.col("ply").isNotNull(), F.col("_pair.old")).alias("old"),
        F.when(F.col("ply").isNotNull(), F.col("_pair.new")).alias("new"),
    )


def difference_totals(first: DataFrame) -> DataFrame:
    return first.agg(
        F.count(F.lit(1)).alias("games"),
        F.count_if(F.col("ply").isNull()).alias("identical"),
        F.count_if(F.col("ply").isNotNull()).alias("different"),
    )


def difference_histogram(first: DataFrame) -> DataFrame:
    return first.filter("ply IS NOT NULL").groupBy("old", "new").agg(F.count(F.lit(1)).alias("n"))


def overlapping_window(rows: DataFrame, player: str, kind: str, day: str, left: str, right: str) -> DataFrame:
    """Rows inside the period both kinds of a player's games cover; players without one drop out."""
    edge = lambda fn, k: fn(F.when(F.col(kind) == k, F.col(day)))
    spans = rows.groupBy(player).agg(
        edge(F.min, left).alias("_a0"), edge(F.max, left).alias("_a1"), edge(F.min, right).alias("_b0"), edge(F.max, right).alias("_b1")
    )
    windows = spans.filter("_a0 IS NOT NULL AND _b0 IS NOT NULL").select(
        player, F.greatest("_a0", "_b0").alias("start"), F.least("_a1", "_b1").alias("end")
    )
    return rows.join(windows.filter("start <= end"), player).filter(F.col(day).between(F.col("start"), F.col("end")))


def cohort_candidates(sides: DataFrame) -> DataFrame:
    """Games and exact median rating per player (ratings are small integers, the counters bounded)."""
    return sides.groupBy("player").agg(F.count(F.lit(1)).alias("games"), F.percentile("elo", 0.5).alias("median_rating"))


def most_active(candidates: DataFrame, low: float, high: float, k: int = 8) -> DataFrame:
    inside = (F.col("median_rating") >= low) & (F.col("median_rating") < high)
    return candidates.filter(inside).orderBy(F.desc("games"), "player").limit(k)


def cohort_games(sides: DataFrame, cohort: DataFrame) -> DataFrame:
    """Games in which either player belongs to the cohort, each once."""
    return sides.join(cohort.select("player"), "player", "left_semi").select("game_id").distinct()


def paired_deltas(errors: DataFrame, player: str, kind: str, left: str, right: str) -> DataFrame:
    """Per player the difference of the errors of two kinds; incomplete pairs are dropped."""
    wide = errors.groupBy(player).pivot(kind, [left, right]).agg(F.first("error"))
    return wide.filter(F.col(left).isNotNull() & F.col(right).isNotNull()).select(
        player, (F.col(left) - F.col(right)).alias("delta")
    )


def delta_summary(deltas: DataFrame) -> DataFrame:
    middle = ordered.median(deltas, [], "delta", "median_delta", ERROR_SLICE)
    return deltas.agg(F.count(F.lit(1)).alias("paired_players"), F.avg("delta").alias("mean_delta")).withColumn(
        "median_delta", middle.scalar()
    )


def error_report(rows: DataFrame, predicted: str, actual: str) -> DataFrame:
    """Mean and median signed error, absolute error, RMSE and correlation over players."""
    errors = rows.select((F.col(predicted) - F.col(actual)).alias("error"), predicted, actual)
    middle = ordered.median(errors, [], "error", "m", ERROR_SLICE)
    e = F.col("error")
    return errors.agg(
        F.count(F.lit(1)).alias("players"),
        F.avg(e).alias("mean_error"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.corr(predicted, actual).alias("correlation"),
    ).withColumn("median_error", middle.scalar())


def side_comparison(target_rows: DataFrame) -> DataFrame:
    """Weighted mean score of a player's own side, of the opponents, and of both pooled.

    Input has (player, role, score, moves) with role target or opponent.
    """
    grouped = target_rows.groupingSets(
        [[F.col("player"), F.col("role")], [F.col("player")]], F.col("player"), F.col("role")
    ).agg(
        (F.sum(F.col("score") * F.col("moves")) / F.sum("moves")).alias("mean_score"),
        F.grouping(F.col("role")).alias("_all"),
    )
    return grouped.select(
        "player", F.when(F.col("_all") == 1, "pooled").otherwise(F.col("role")).alias("role"), "mean_score"
    )


def filter_effect(rows: DataFrame) -> DataFrame:
    """Per player: games, kept games and share, median absolute rating gap, mean score before and after.

    Input has (player, kept, gap, score, moves); gaps are small integers.
    """
    kept = F.col("kept")
    mean = lambda cond: F.sum(F.when(cond, F.col("score") * F.col("moves"))) / F.sum(F.when(cond, F.col("moves")))
    return rows.groupBy("player").agg(
        F.count(F.lit(1)).alias("total_games"),
        F.count_if(kept).alias("kept_games"),
        (F.count_if(kept) / F.count(F.lit(1))).alias("kept_fraction"),
        F.percentile("gap", 0.5).alias("median_absolute_rating_gap"),
        mean(F.lit(True)).alias("baseline_score"),
        mean(kept).alias("filtered_score"),
    )


def opponents_left(sides: DataFrame, done: DataFrame) -> DataFrame:
    """Distinct names on either side that are not done yet."""
    return sides.select("player").distinct().join(done.select("player"), "player", "left_anti")


def eligible_players(records: DataFrame, max_rating: int, min_games: int) -> DataFrame:
    """Rating records of open, established, unflagged players below a rating."""
    return records.filter(
        (F.col("rating") < max_rating)
        & ~F.coalesce("prov", F.lit(False))
        & (F.col("games") >= min_games)
        & ~F.coalesce("closed", F.lit(False))
        & ~F.coalesce("tosViolation", F.lit(False))
    )
