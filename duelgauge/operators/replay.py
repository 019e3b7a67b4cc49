"""Replay buffer: retention, n-step targets, unrolled targets, prioritised draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duelgauge.operators import ordered
from duelgauge.runtime import constant_list, constant_row, cut_lineage, shuffle_width

SEGMENT_PLIES = 512


CUT_SLICES = 1_024
OLDEST = -(1 << 62)


def _as_number(df: DataFrame, name: str) -> Column:
    """An order-preserving whole number for integers, dates and times; nulls below all."""
    kind = df.schema[name].dataType.typeName()
    number = {"date": F.unix_date, "timestamp": F.unix_micros}.get(kind, lambda c: F.col(c).cast("bigint"))(name)
    return F.coalesce(number.cast("bigint"), F.lit(OLDEST))


def cut_value(df: DataFrame, number: Column, keep: int) -> tuple[int, int]:
    """(v, rest): fewer than `keep` rows lie above v, and `rest` of the rows equal to v complete them.

    Histograms of at most CUT_SLICES slices narrow the range of v down to one value; nothing is sorted.
    """
    rows = df.select(number.alias("v"))
    low, high = rows.agg(F.min("v"), F.max("v")).first()
    while low < high:
        width = -(-(high - low + 1) // CUT_SLICES)
        slices = rows.filter(F.col("v").between(low, high)).groupBy(F.expr(f"(v - {low}L) div {width}L").alias("s")).count()
        for row in sorted(slices.collect(), key=lambda r: -r["s"]):
            if row["count"] >= keep:
                low, high = low + row["s"] * width, min(high, low + (row["s"] + 1) * width - 1)
                break
            keep -= row["count"]
    return low, keep


def newest_games(games: DataFrame, keep: int, arrival: str = "arrival") -> DataFrame:
    """The last `keep` games to arrive, ties to the larger id: a filter on the arrival (and id) at which they begin.

    A null arrival is the oldest. Rows equal in both are kept as far as needed.
    """
    if keep <= 0:
        return games.limit(0)
    if games.count() <= keep:
        return games
    when, which = _as_number(games, arrival), _as_number(games, "game_id")
    day, rest = cut_value(games, when, keep)
    tied = games.filter(when == day)
    first, equal = cut_value(tied, which, rest)
    return games.filter((when > day) | ((when == day) & (which > first))).unionByName(tied.filter(which == first).limit(equal))


def with_following(rows: DataFrame, key: str, width: int, item: Column, name: str) -> DataFrame:
    """Add the array of `item` over a row and the next `width` rows of its key.

    A long key is cut into segments of plies; the first rows of a segment are also copied to the one
    before it, so every frame is complete inside its segment.
    """
    segment = F.floor(F.col("ply") / SEGMENT_PLIES)
    copies = F.filter(
        F.array(segment, F.when(F.col("ply") % SEGMENT_PLIES < width, segment - 1)), lambda s: s.isNotNull() & (s >= 0)
    )
    spread = rows.withColumn("_own", segment).withColumn("_segment", F.explode(copies))
    frame = W.partitionBy(key, "_segment").orderBy("ply").rowsBetween(0, width)
    return (
        spread.withColumn(name, F.collect_list(item).over(frame))
        .filter(F.col("_segment") == F.col("_own"))
        .drop("_own", "_segment")
    )


def n_step_returns(rows: DataFrame, n: int, discount: float, life_loss: bool = False) -> DataFrame:
    """Discounted reward sum over n moves plus the discounted value at move n, when it exists.

    With life_loss, a move that lost a life with lives left ends the sum before its own reward, and
    the partial sum is the result; a bootstrap move that itself lost a life adds nothing. Rows are
    (game_id, ply, reward, value, lives) where `lives` is NULL unless the move lost a life.
    """
    framed = with_following(rows, "game_id", n, F.struct("reward", "value", F.coalesce("lives", F.lit(-1)).alias("lives")), "_ahead")
    start = F.struct(
        F.lit(0.0).alias("total"), F.lit(1.0).alias("factor"), F.lit(False).alias("stopped")
    )

    def step(acc: Column, item: Column) -> Column:
        stop = acc["stopped"] | (F.lit(life_loss) & (item["lives"] > 0))
        return F.struct(
            F.when(stop, acc["total"]).otherwise(acc["total"] + acc["factor"] * item["reward"]).alias("total"),
            (acc["factor"] * discount).alias("factor"),
            stop.alias("stopped"),
        )

    summed = framed.withColumn("_sum", F.aggregate(F.slice("_ahead", 1, n), start, step))
    last = F.get("_ahead", F.lit(n))
    usable = last.isNotNull() & ~F.col("_sum.stopped") & ~(F.lit(life_loss) & (last["lives"] >= 0))
    boot = F.when(usable, F.lit(discount**n) * last["value"]).otherwise(0.0)
    return summed.withColumn("n_step", F.col("_sum.total") + boot).drop("_ahead", "_sum")


def unrolled_targets(rows: DataFrame, k: int, actions: int, seed: str) -> DataFrame:
    """K actions and rewards, K+1 values and policies from each position on.

    Past the end of the game: value and reward 0, a uniform policy (NULL action here) and a
    hash-chosen action. Rows are (game_id, ply, action, reward, value).
    """
    framed = with_following(rows, "game_id", k, F.struct("action", "reward", "value"), "_ahead")
    steps = F.sequence(F.lit(0), F.lit(k))
    at = lambda i: F.get("_ahead", i)
    random = lambda i: (
        F.conv(
            F.substring(
                F.md5(F.concat_ws(":", F.lit(seed), F.col("game_id").cast("string"), (F.col("ply") + i).cast("string"))), 1, 15
            ),
            16,
            10,
        ).cast("bigint")
        % actions
    )
    unrolled = F.slice(steps, 1, k)
    return framed.select(
        "game_id",
        "ply",
        F.transform(unrolled, lambda i: F.coalesce(at(i)["action"], random(i))).alias("actions"),
        F.transform(unrolled, lambda i: F.coalesce(at(i)["reward"], F.lit(0.0))).alias("rewards"),
        F.transform(steps, lambda i: F.coalesce(at(i)["value"], F.lit(0.0))).alias("values"),
        F.transform(steps, lambda i: at(i)["action"]).alias("policy_actions"),
    )


def prioritised(rows: DataFrame, alpha: float) -> DataFrame:
    return rows.withColumn("weight", F.pow(F.col("priority"), F.lit(alpha)))


def locate(draws: DataFrame, marks: DataFrame, keys: list[str], value: str, upto: str) -> DataFrame:
    """Every draw with the first mark of its key whose `upto` lies above the draw's value.

    Draws and marks are laid out together in order, so nothing is paired. A value that rounding put
    above the last mark takes that mark: no draw is lost. Returns structs `d` and `m`.
    """
    mark, draw = F.struct(*marks.columns), F.struct(*draws.columns)
    both = draws.select(*keys, F.col(value).alias("_v"), F.lit(1).alias("_is_draw"), draw.alias("d")).unionByName(
        marks.select(*keys, F.col(upto).alias("_v"), F.lit(0).alias("_is_draw"), mark.alias("m")), allowMissingColumns=True
    )
    order = W.partitionBy(*keys).orderBy("_v", "_is_draw")
    ahead = F.first("m", ignorenulls=True).over(order.rowsBetween(0, W.unboundedFollowing))
    behind = F.last("m", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    return both.select("d", F.coalesce(ahead, behind).alias("m")).filter("d IS NOT NULL")


def weighted_draws(rows: DataFrame, count: int, seed: str, beta: float) -> DataFrame:
    """Draws proportional to `weight`, with the importance weight (N·p)^−β.

    Three levels of cumulative weight: 4096 hash blocks (a constant array), the games of a block,
    the positions of a game. A draw is located level by level among the marks of its key, so the
    buffer is never ordered as a whole. The weighted rows are stored once; every level reads them.
    """
    spark = rows.sparkSession
    rows = cut_lineage(rows.select("game_id", "ply", "weight"))
    placed = rows.withColumn("_gh", ordered.hash_text("replay", "game_id")).withColumn("_block", F.substring("_gh", 1, 3))
    games = placed.groupBy("_block", "_gh", "game_id").agg(F.sum("weight").alias("_w"), F.count(F.lit(1)).alias("_n"))
    in_block = W.partitionBy("_block").orderBy("_gh", "game_id").rowsBetween(W.unboundedPreceding, 0)
    games = cut_lineage(games.withColumn("_upto", F.sum("_w").over(in_block)))
    blocks = games.groupBy("_block").agg(F.sum("_w").alias("_bw"))
    over = W.partitionBy(F.lit(0)).orderBy("_block").rowsBetween(W.unboundedPreceding, 0)
    blocks = blocks.withColumn("_end", F.sum("_bw").over(over)).withColumn("_start", F.col("_end") - F.col("_bw"))
    totals = games.agg(F.sum("_w").alias("total"), F.sum("_n").alias("n"))
    drawn = (
        spark.range(0, count, 1, shuffle_width(spark))
        .withColumnRenamed("id", "draw")
        .withColumn("_t", constant_row(totals, "total", "n"))
        .withColumn("_blocks", constant_list(blocks, "_block", "_start", "_end"))
        .withColumn("_u", ordered.hash_unit(seed, "draw") * F.col("_t.total"))
    )
    reached = F.filter("_blocks", lambda b: b["_end"] > F.col("_u"))
    block = F.coalesce(F.get(reached, F.lit(0)), F.element_at("_blocks", -1))
    drawn = drawn.withColumn("_b", block).select(
        "draw", "_t", F.col("_b._block").alias("_block"), (F.col("_u") - F.col("_b._start")).alias("_u")
    )
    game = cut_lineage(
        locate(drawn, games.select("_block", "game_id", "_w", "_upto"), ["_block"], "_u", "_upto").select(
            "d.draw", "d._t", "m.game_id", (F.col("d._u") - (F.col("m._upto") - F.col("m._w"))).alias("_u")
        )
    )
    used = rows.join(game.select("game_id").distinct(), "game_id", "left_semi")
    steps = ordered.running_totals(used, ["game_id"], ["ply"], F.floor(F.col("ply") / SEGMENT_PLIES), {"_pos": F.col("weight")})
    chance = F.col("m.weight") / F.col("d._t.total")
    return locate(game, steps.select("game_id", "ply", "weight", "_pos"), ["game_id"], "_u", "_pos").select(
        "d.draw", "d.game_id", "m.ply", F.pow(F.col("d._t.n") * chance, F.lit(-beta)).alias("loss_scale")
    )
