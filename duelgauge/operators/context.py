"""Context join: the N most recent earlier games of both players of every game."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duelgauge.operators import ordered
from duelgauge.operators.corpus import EXCLUSION_KEYS, ContextPolicy, policy_reason, reason_counts, sides
from duelgauge.runtime import cut_lineage, require

DAY_SECONDS = 86_400


def player_contexts(games: DataFrame, policy: ContextPolicy, newest_first: Sequence[Column] | None = None) -> DataFrame:
    """The latest N eligible games before every (player, day) on which the player has one.

    Dates have day precision, so all games of a player on one day share one context: the work is
    done per (player, day), not per game. A day keeps at most its N newest games (a group limit
    that prunes before the shuffle), so a very active player is at most N rows per playing day, and
    a context is one bounded frame over them.
    `newest_first` is the selection order among the games of one day.
    """
    n = policy.context_size
    latest = list(newest_first) if newest_first else [F.desc("game_id")]
    eligible = sides(games.filter(policy_reason(policy).isNull()), "played_at")
    in_day = W.partitionBy("player", "played_at").orderBy(*latest)
    kept = eligible.withColumn("_back", F.row_number().over(in_day)).filter(F.col("_back") <= n)
    item = F.struct(
        F.col("game_id"),
        F.col("color").alias("target_color"),
        F.col("elo").alias("target_elo_at_game"),
        F.col("opponent_elo").alias("opponent_elo_at_game"),
        F.col("outcome"),
        F.col("played_at"),
    )
    # In time order the games before the first one of a day are the context of that day.
    by_game = W.partitionBy("player").orderBy("played_at", F.desc("_back"))
    min_days = max(1, -(-policy.min_context_age_seconds // DAY_SECONDS))
    if min_days == 1:
        new_day = ~F.lag("played_at").over(by_game).eqNullSafe(F.col("played_at"))
        before = F.collect_list(item).over(by_game.rowsBetween(-n, -1))
        found = kept.select("player", "played_at", new_day.alias("_first"), before.alias("context")).filter("_first")
    else:
        by_day = W.partitionBy("player").orderBy("_day")
        tail = F.collect_list(item).over(by_game.rowsBetween(-(n - 1), 0))
        tails = kept.select("player", "played_at", "_back", tail.alias("_tail")).filter("_back = 1")
        numbered = (
            tails.withColumn("_day", F.datediff("played_at", F.lit("1970-01-01")))
            .withColumn("_nth", F.row_number().over(by_day))
            .withColumn("_upto", F.count(F.lit(1)).over(by_day.rangeBetween(W.unboundedPreceding, -min_days)))
        )
        source = numbered.select("player", F.col("_nth").alias("_upto"), F.col("_tail").alias("context"))
        found = numbered.select("player", "played_at", "_upto").join(source, ["player", "_upto"], "left")
    full = F.size("context") == n
    if policy.max_context_age_days is not None:
        oldest = F.get("context", F.lit(0))["played_at"]
        full = full & (F.datediff("played_at", oldest) <= policy.max_context_age_days)
    return found.filter(full).select("player", "played_at", "context")


def attach_contexts(games: DataFrame, contexts: DataFrame) -> DataFrame:
    """Both contexts of every game. `_white_found` and `_black_found` tell whether there is one without reading it."""
    out = games
    for side in ("white", "black"):
        out = out.join(
            contexts.select(
                F.col("player").alias(side), "played_at", F.col("context").alias(f"{side}_context"), F.col("player").alias(f"_{side}_found")
            ),
            [side, "played_at"],
            "left",
        )
    return out


def context_reason() -> Column:
    return F.when(F.col("_white_found").isNull(), "white_insufficient_context").when(
        F.col("_black_found").isNull(), "black_insufficient_context"
    )


def build_examples(
    games: DataFrame,
    policy: ContextPolicy,
    strict_cap: bool = False,
    newest_first: Sequence[Column] | None = None,
) -> DataFrame:
    """All games with both contexts and the first failing `reason` (NULL for an example).

    The player contexts are stored once, since White and Black both look them up.
    """
    first = W.partitionBy("game_id").orderBy("played_at", "white", "black")
    unique = games.withColumn("_copy", F.row_number().over(first))
    contexts = cut_lineage(player_contexts(games, policy, newest_first))
    tagged = attach_contexts(unique, contexts)
    base = F.when(F.col("_copy") > 1, "duplicate_game").otherwise(policy_reason(policy))
    tagged = tagged.withColumn("_policy", base).withColumn("_context", context_reason()).drop("_copy", "_white_found", "_black_found")
    if policy.max_predictions_per_player is None:
        return tagged.withColumn("reason", F.coalesce("_policy", "_context")).drop("_policy", "_context")
    capped = capped_predictions if strict_cap else rank_capped_predictions
    return capped(tagged, policy.max_predictions_per_player)


def exclusion_counts(examples: DataFrame) -> DataFrame:
    return reason_counts(examples, EXCLUSION_KEYS)


def _prior_counts(rows: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """Per game, for both players, sums of the measures over that player's earlier games."""
    flags = [c for c in rows.columns if c.startswith("_is_")]
    both = rows.select("game_id", "played_at", *flags, F.explode(F.array("white", "black")).alias("player"))
    running = ordered.running_totals(
        both, ["player"], ["played_at", "game_id"], F.col("played_at"), measures, inclusive=False
    )
    return running.groupBy("game_id").agg(*[F.max(n).alias(n) for n in measures])


def _without_contexts(tagged: DataFrame) -> DataFrame:
    """The narrow columns the cap needs, stored so that the contexts are not built again for them."""
    usable = F.col("_policy").isNull() & F.col("_context").isNull()
    return cut_lineage(
        tagged.filter("_policy IS NULL").select("game_id", "played_at", "white", "black", usable.alias("usable"))
    )


def rank_capped_predictions(tagged: DataFrame, cap: int) -> DataFrame:
    """Relaxed cap, one pass: a game is refused once either player has `cap` earlier usable games."""
    slim = _without_contexts(tagged).withColumn("_is_usable", F.col("usable").cast("bigint"))
    prior = _prior_counts(slim, {"_prior": F.col("_is_usable")})
    joined = tagged.join(prior, "game_id", "left")
    over = F.when(F.col("_policy").isNull() & (F.col("_prior") >= cap), "max_predictions_per_player")
    return joined.withColumn("reason", F.coalesce("_policy", over, "_context")).drop("_policy", "_context", "_prior")


TAIL_ROWS = 4_096


def _positions(games: DataFrame) -> DataFrame:
    """Per player the places in time of these games, at most about `cap` of them if they are accepted ones."""
    place = F.struct("played_at", "game_id").alias("place")
    both = games.select(place, F.explode(F.array("white", "black")).alias("player"))
    return both.groupBy("player").agg(F.sort_array(F.collect_list("place")).alias("places"))


def _with_places(games: DataFrame, places: DataFrame) -> DataFrame:
    """Add the places of both players and, as `_white_before` and `_black_before`, how many come before the game."""
    place = F.struct("played_at", "game_id")
    for side in ("white", "black"):
        own = places.select(F.col("player").alias(side), F.col("places").alias(f"_{side}_places"))
        before = F.coalesce(F.size(F.filter(f"_{side}_places", lambda p: p < place)), F.lit(0)).cast("bigint")
        games = games.join(own, side, "left").withColumn(f"_{side}_before", F.when(F.col(f"_{side}_places").isNull(), 0).otherwise(before))
    return games


def _walked(cap: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The greedy rule itself over a bounded number of games."""

    def walk(games: pd.DataFrame) -> pd.DataFrame:
        taken: dict[str, int] = {}
        accepted = []
        for game_id, white, black, white_used, black_used in games.sort_values(["played_at", "game_id"])[
            ["game_id", "white", "black", "white_used", "black_used"]
        ].itertuples(index=False):
            if max(taken.get(white, 0) + white_used, taken.get(black, 0) + black_used) < cap:
                accepted.append(game_id)
                for player in (white, black):
                    taken[player] = taken.get(player, 0) + 1
        return pd.DataFrame({"game_id": accepted})

    return walk


def accepted_games(usable: DataFrame, cap: int, tail_rows: int = TAIL_ROWS) -> DataFrame:
    """Exact greedy cap in time order over (game_id, played_at, white, black): ids of the accepted games.

    Rounds work on the open games only. Each carries how many accepted games of its two players came before it. A game is
    accepted once that number and the open games before it together stay below the cap for both players: it is then among
    a player's first `cap` open games, so a window that keeps no more finds it. The open games add what was accepted before
    them, and those that reach the cap leave as refused. The earliest open game is always settled. The last `tail_rows`
    open games, at most, are walked in one task.
    """
    zero = F.lit(0).cast("bigint")
    frontier = cut_lineage(usable.select("game_id", "played_at", "white", "black", zero.alias("white_used"), zero.alias("black_used")))
    settled = [frontier.select("game_id").limit(0)]
    left = frontier.count()
    in_time = W.partitionBy("player").orderBy("played_at", "game_id")
    while left > tail_rows:
        side = lambda color: F.struct(F.col(color).alias("player"), F.col(f"{color}_used").alias("used"))
        rows = frontier.select("game_id", "played_at", "white", "black", F.explode(F.array(side("white"), side("black"))).alias("s"))
        first = rows.select("game_id", "played_at", "white", "black", "s.*").withColumn("_nth", F.rank().over(in_time)).filter(F.col("_nth") <= cap)
        sure = first.filter(F.col("used") + F.col("_nth") <= cap).groupBy("game_id", "played_at", "white", "black").agg(F.count(F.lit(1)).alias("_sides"))
        accepted = cut_lineage(sure.filter("_sides = 2 AND game_id IS NOT NULL").drop("_sides"))
        settled.append(accepted.select("game_id"))
        counted = _with_places(frontier.filter("game_id IS NOT NULL"), _positions(accepted))
        used = {f"{c}_used": F.col(f"{c}_used") + F.col(f"_{c}_before") for c in ("white", "black")}
        taken = F.coalesce(F.array_contains("_white_places", F.struct("played_at", "game_id")), F.lit(False))
        open_games = counted.filter(~taken).withColumns(used).filter((F.col("white_used") < cap) & (F.col("black_used") < cap))
        frontier = cut_lineage(open_games.select("game_id", "played_at", "white", "black", "white_used", "black_used"))
        left = frontier.count()
    if left:
        settled.append(cut_lineage(frontier.groupBy().applyInPandas(_walked(cap), frontier.select("game_id").schema)))
    return reduce(DataFrame.unionByName, settled)


def capped_predictions(tagged: DataFrame, cap: int) -> DataFrame:
    """Exact greedy cap in time order, where only accepted games count."""
    narrow = _without_contexts(tagged)
    accepted = narrow.join(accepted_games(narrow.filter("usable"), cap), "game_id", "left_semi")
    # The greedy rule gives a player no more than `cap` games, so their places are a short list.
    counted = _with_places(narrow, _positions(accepted))
    itself = (F.col("white") == F.col("black")) & F.array_contains("_white_places", F.struct("played_at", "game_id"))
    prior = F.greatest("_white_before", "_black_before") + F.coalesce(itself, F.lit(False)).cast("bigint")
    refused = counted.filter(prior >= cap).select("game_id", F.lit(True).alias("_over"))
    over = F.when(F.col("_policy").isNull() & F.col("_over"), "max_predictions_per_player")
    return (
        tagged.join(refused, "game_id", "left")
        .withColumn("reason", F.coalesce("_policy", over, "_context"))
        .drop("_policy", "_context", "_over")
    )


def context_rows(examples: DataFrame) -> DataFrame:
    """Long form: one row per (example, side, context game), oldest first from rn = 1."""
    side = lambda name: F.transform(
        F.col(f"{name}_context"),
        lambda c, i: F.struct(
            F.lit(name).alias("side"), (i + 1).alias("rn"), c["game_id"].alias("context_id"), c["target_color"].alias("color")
        ),
    )
    both = F.concat(side("white"), side("black"))
    return examples.select("game_id", F.explode(both).alias("c")).select("game_id", "c.*")


def context_strength(examples: DataFrame, side_scores: DataFrame, how: str = "mean") -> DataFrame:
    """White and black context strength per example.

    `side_scores` has (game_id, color, score). Weights follow recency: the oldest game counts 1,
    the newest N. The group per (example, side) holds at most N rows. A context game without a score
    fails the job.
    """
    rows = context_rows(examples)
    scores = side_scores.select(F.col("game_id").alias("context_id"), "color", "score")
    joined = require(rows.join(scores, ["context_id", "color"], "left"), F.col("score").isNotNull(), "a context game has no score")
    if how == "median":
        value = F.percentile("score", 0.5)
    elif how == "recency_weighted":
        value = F.sum(F.col("rn") * F.col("score")) / F.sum("rn")
    elif how == "mean":
        value = F.avg("score")
    else:
        raise ValueError(f"unknown aggregate {how}")
    per_side = joined.groupBy("game_id", "side").agg(value.alias("strength"))
    return per_side.groupBy("game_id").agg(
        *[F.max(F.when(F.col("side") == s, F.col("strength"))).alias(f"{s}_strength") for s in ("white", "black")]
    )
