"""Assembling training batches from ranks, chains and phase examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duelgauge.functions import targets as V
from duelgauge.operators import ordered
from duelgauge.operators import trials as T
from duelgauge.runtime import BROADCAST_BYTES, constant_list, row_bytes, shuffle_width


def groups(spark, count: int) -> DataFrame:
    return spark.range(0, count, 1, shuffle_width(spark)).withColumnRenamed("id", "grp")


def choose_ranks(batch: DataFrame, ranks: DataFrame, k: int, seed: str) -> DataFrame:
    """k of the present ranks per group without replacement, numbered in rank order.

    The ranks (a handful) come as a constant array, hashed and cut inside the row.
    """
    keyed = F.transform(
        F.col("_ranks"),
        lambda r: F.struct(
            F.md5(F.concat_ws(":", F.lit(seed), F.col("grp").cast("string"), r["rank"].cast("string"))).alias("h"),
            r["rank"].alias("rank"),
        ),
    )
    chosen = F.sort_array(F.transform(F.slice(F.sort_array(keyed), 1, k), lambda s: s["rank"]))
    held = batch.withColumn("_ranks", constant_list(ranks, "rank"))
    return held.select("grp", F.posexplode(chosen).alias("slot", "rank"))


def draw_game(slots: DataFrame, games: DataFrame, seed: str, *by: str) -> DataFrame:
    """One uniform game of the slot's rank."""
    pool = T.draw_pool(games.select("rank", "game_id"), "rank", ["game_id"])
    sizes = T.pool_sizes(games, "rank")
    drawn = slots.join(sizes, "rank").withColumn("draw", ordered.hash_int(seed, *by) % F.col("pool") + 1)
    return drawn.join(pool, ["rank", "draw"]).drop("draw", "pool")


def side_of(seed: str, *by: str | Column) -> Column:
    return F.when(ordered.hash_int(seed, *by) % 2 == 0, "white").otherwise("black")


def join_positions(drawn: DataFrame, rows: int, positions: DataFrame) -> DataFrame:
    """Positions of the drawn games and sides, of which there are `rows` at most.

    Positions may be exploded from games, and Spark sizes exploded rows like the rows they come from: left to
    itself it may broadcast every position. The drawn side is broadcast while it is small, positions never.
    """
    if rows * row_bytes(drawn) <= BROADCAST_BYTES:
        return positions.join(F.broadcast(drawn), ["game_id", "color"])
    return drawn.join(positions.hint("merge"), ["game_id", "color"])


def pick_positions(slots: DataFrame, rows: int, positions: DataFrame, p: int, seed: str, keys: list[str]) -> DataFrame:
    """p distinct positions of the game and side of each of at most `rows` slots; the rank limit prunes before the shuffle."""
    joined = join_positions(slots, rows, positions)
    order = W.partitionBy(*keys).orderBy(ordered.hash_text(seed, *keys, "ply"), "ply")
    return joined.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= p).drop("_rn")


def ranking_groups(
    spark, games: DataFrame, positions: DataFrame, n_groups: int, k: int, p: int, seed: str, same_game: bool = True
) -> DataFrame:
    """Groups of k ranks, each with p positions: of one side of one game, or independently drawn."""
    slots = choose_ranks(groups(spark, n_groups), games.select("rank").distinct(), k, f"{seed}-ranks")
    if same_game:
        drawn = draw_game(slots, games, f"{seed}-game", "grp", "rank")
        sided = drawn.withColumn("color", side_of(f"{seed}-side", "grp", "rank"))
        return pick_positions(sided, n_groups * k, positions, p, f"{seed}-position", ["grp", "slot"]).select("grp", "slot", "rank", "game_id", "ply")
    many = slots.select("*", F.explode(F.sequence(F.lit(0), F.lit(p - 1))).alias("nth"))
    drawn = draw_game(many, games, f"{seed}-game", "grp", "rank", "nth")
    return draw_position(drawn, positions, f"{seed}-position", "grp", "rank", "nth").select("grp", "slot", "rank", "nth", "game_id", "ply")


def draw_position(drawn: DataFrame, positions: DataFrame, seed: str, *by: str) -> DataFrame:
    """One uniform position of the drawn game among those it has; its plies of the table, in one sorted array."""
    wanted = positions.join(drawn.select("game_id").distinct(), "game_id", "left_semi")
    listed = wanted.groupBy("game_id").agg(F.sort_array(F.collect_list("ply")).alias("_plies"))
    nth = (ordered.hash_int(seed, *by) % F.size("_plies")).cast("int")
    return drawn.join(listed, "game_id").withColumn("ply", F.get("_plies", nth)).drop("_plies")


def uniform_positions(spark, games: DataFrame, positions: DataFrame, count: int, seed: str) -> DataFrame:
    """Independent draws of a rank, then a game, then a position."""
    ranks = constant_list(games.select("rank").distinct(), "rank")
    batch = groups(spark, count).withColumn("_r", ranks)
    pick = (ordered.hash_int(f"{seed}-rank", "grp") % F.size("_r")).cast("int")
    slots = batch.select("grp", F.get("_r", pick)["rank"].alias("rank"))
    drawn = draw_game(slots, games, f"{seed}-game", "grp")
    return draw_position(drawn, positions, f"{seed}-position", "grp").select("grp", "rank", "game_id", "ply")


def slot_positions(slots: DataFrame, positions: DataFrame, *ids: str) -> DataFrame:
    """Positions of each slot's side in its game; a side without moves falls back to all moves.

    Only the games in use are counted, and whether to fall back is settled from those counts before
    the positions are joined.
    """
    used = positions.join(slots.select("game_id").distinct(), "game_id", "left_semi")
    counts = used.groupBy("game_id").agg(
        F.count_if(F.col("color") == "white").alias("_w"), F.count_if(F.col("color") == "black").alias("_b")
    )
    own = F.when(F.col("color") == "white", F.col("_w")).otherwise(F.col("_b"))
    decided = slots.join(counts, "game_id").select(
        *ids, "game_id", F.when(own > 0, F.col("color")).alias("_want"), F.when(own > 0, own).otherwise(F.col("_w") + F.col("_b")).alias("available")
    )
    joined = decided.join(used.hint("merge"), "game_id")  # see join_positions
    return joined.filter(F.col("_want").isNull() | (F.col("_want") == F.col("color"))).drop("_want", "color")


def chain_batch(spark, slots: DataFrame, positions: DataFrame, batch: int, p: int, seed: str) -> DataFrame:
    """Chains drawn with replacement; p positions per slot, cycling when the slot has fewer."""
    chains = slots.select("attempt").distinct()
    pool = ordered.hash_ranks(chains, [], ["attempt"], f"{seed}-pool", "draw")
    total = slots.agg(F.count_distinct("attempt").alias("n")).scalar()
    drawn = groups(spark, batch).withColumn("draw", ordered.hash_int(seed, "grp") % total + 1).join(pool, "draw")
    rows = slot_positions(drawn.join(slots, "attempt"), positions, "grp", "slot")
    order = W.partitionBy("grp", "slot").orderBy(ordered.hash_text(f"{seed}-position", "grp", "slot", "ply"), "ply")
    ranked = rows.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= p)
    reused = F.sequence(F.col("_rn") - 1, F.lit(p - 1), F.least(F.col("available"), F.lit(p)).cast("int"))
    return ranked.select("grp", "slot", "game_id", "ply", F.explode(reused).alias("nth"))


def phase_batch(spark, examples: DataFrame, positions: DataFrame, n_groups: int, k: int, p: int, seed: str) -> DataFrame:
    """Groups of k bins: one phase example per bin, one eligible side, p distinct positions of it."""
    usable = examples.filter("white_ok OR black_ok").withColumnRenamed("bin", "rank")
    pool = T.draw_pool(usable, "rank", ["game_id", "phase"])
    slots = choose_ranks(groups(spark, n_groups), usable.select("rank").distinct(), k, f"{seed}-ranks")
    drawn = slots.join(T.pool_sizes(usable, "rank"), "rank").withColumn(
        "draw", ordered.hash_int(f"{seed}-example", "grp", "rank") % F.col("pool") + 1
    )
    chosen = drawn.join(pool, ["rank", "draw"]).withColumn(
        "color",
        F.when(F.col("white_ok") & F.col("black_ok"), side_of(f"{seed}-side", "grp", "rank"))
        .when(F.col("white_ok"), "white")
        .otherwise("black"),
    )
    inside = join_positions(chosen, n_groups * k, positions).filter("ply >= start AND ply < stop")
    order = W.partitionBy("grp", "slot").orderBy(ordered.hash_text(f"{seed}-position", "grp", "slot", "ply"), "ply")
    return (
        inside.withColumn("_rn", F.row_number().over(order))
        .filter(F.col("_rn") <= p)
        .select("grp", "slot", "rank", "phase", "game_id", "color", "ply")
    )


def rank_labels(games: DataFrame) -> DataFrame:
    """Dense label of every rank present (a handful of rows)."""
    order = W.partitionBy(F.lit(0)).orderBy("rank")
    return games.select("rank").distinct().withColumn("label", F.dense_rank().over(order) - 1)


def position_targets(moves: DataFrame, games: DataFrame, actions: int, rank_size: int) -> DataFrame:
    """Training row per position: policy, game result, rank label and its one-hot vector."""
    labels = constant_list(rank_labels(games), "rank", "label")
    labelled = games.withColumn("_l", labels).select(
        "game_id",
        F.col("result").cast("double").alias("value"),
        F.get(F.filter("_l", lambda r: r["rank"] == F.col("rank")), F.lit(0))["label"].alias("label"),
    )
    return moves.select("game_id", "ply", "visits", "action").join(labelled, "game_id").select(
        "game_id",
        "ply",
        V.policy(F.col("visits"), F.col("action"), actions).alias("policy"),
        "value",
        "label",
        V.one_hot(F.col("label"), rank_size).alias("rank_vector"),
    )


def listwise_ranking(scores: DataFrame) -> DataFrame:
    """Ranking loss and accuracy over groups of (grp, slot, score), weakest slot first.

    For every prefix of a group: minus the log-softmax of its last score, and whether that score is
    strictly the largest. A group holds one row per slot, so its array is short; the maximum is
    taken out before exponentials.
    """
    packed = scores.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("slot", "score"))).alias("s"))
    values = F.transform("s", lambda x: x["score"])

    def loss(i: Column) -> Column:
        head = F.slice(values, 1, i)
        top = F.array_max(head)
        spread = F.aggregate(head, F.lit(0.0), lambda acc, v: acc + F.exp(v - top))
        return top + F.ln(spread) - F.element_at(values, i)

    def hit(i: Column) -> Column:
        before = F.array_max(F.slice(values, 1, i - 1))
        return F.when(F.element_at(values, i) > before, 1.0).otherwise(0.0)

    steps = packed.filter(F.size("s") >= 2).select(
        F.explode(F.transform(F.sequence(F.lit(2), F.size("s")), lambda i: F.struct(loss(i).alias("loss"), hit(i).alias("hit")))).alias("r")
    )
    return steps.agg(F.avg("r.loss").alias("loss"), F.avg("r.hit").alias("accuracy"), F.count(F.lit(1)).alias("terms"))
