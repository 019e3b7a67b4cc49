"""Phase boundaries of games and what follows from them: labels, ranges, tags, examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelgauge.functions import board as B
from duelgauge.runtime import require

MIDGAME_PIECES, ENDGAME_PIECES, MIXED = 10, 6, 150


def phase_starts(positions: DataFrame) -> DataFrame:
    """(game_id, middle, end) from the occupancy masks after every ply.

    Positions are (game_id, ply, white, black, kings, pawns). A plain aggregate: partial minima are
    taken before the shuffle. A game that drops straight into the endgame has no midgame.
    """
    w, b = F.col("white"), F.col("black")
    pieces = B.piece_count(w, b, F.col("kings"), F.col("pawns"))
    opened = (pieces <= MIDGAME_PIECES) | B.back_rank_sparse(w, b) | (B.mixedness(w, b) > MIXED)
    starts = positions.groupBy("game_id").agg(
        F.min(F.when(opened, F.col("ply"))).alias("_middle"),
        F.min(F.when(pieces <= ENDGAME_PIECES, F.col("ply"))).alias("end"),
    )
    return starts.select(
        "game_id", F.when(~F.col("_middle").eqNullSafe(F.col("end")), F.col("_middle")).alias("middle"), "end"
    )


def phase_of(ply: Column, middle: Column, end: Column) -> Column:
    return F.when(ply >= end, "endgame").when(ply >= middle, "midgame").otherwise("opening")


def label_plies(plies: DataFrame, starts: DataFrame) -> DataFrame:
    joined = plies.join(starts, "game_id", "left")
    return joined.withColumn("phase", phase_of(F.col("ply"), F.col("middle"), F.col("end"))).drop("middle", "end")


def phase_ranges(moves: Column, middle: Column, end: Column) -> Column:
    """Array of (phase, start, stop) with empty ranges dropped."""
    span = lambda name, start, stop: F.struct(
        F.lit(name).alias("phase"), start.cast("bigint").alias("start"), stop.cast("bigint").alias("stop")
    )
    parts = F.array(
        span("opening", F.lit(0), F.coalesce(middle, end, moves)),
        span("midgame", middle, F.coalesce(end, moves)),
        span("endgame", end, moves),
    )
    return F.filter(parts, lambda p: F.coalesce(p["stop"] > p["start"], F.lit(False)))


def tag_status(middle_tag: Column, end_tag: Column, moves: Column) -> Column:
    """`missing`, `invalid` or `ok` for the two phase tags of a record."""
    middle, end = middle_tag.try_cast("bigint"), end_tag.try_cast("bigint")
    empty = lambda t: t.isNull() | (t == "")
    middle_ok = middle.between(-1, moves - 1)
    end_ok = end.between(-1, moves - 1) & ((end == -1) | ((middle != -1) & (middle < end)))
    return (
        F.when(empty(middle_tag) | empty(end_tag), "missing")
        .when(F.coalesce(middle_ok & end_ok, F.lit(False)), "ok")
        .otherwise("invalid")
    )


def side_positions(start: Column, stop: Column, parity: int) -> Column:
    """How many plies of one parity lie in [start, stop)."""
    below = lambda x: F.floor((x + (1 if parity == 0 else 0)) / 2)
    return below(stop) - below(start)


def phase_examples(games: DataFrame, positions: int) -> DataFrame:
    """Per game and phase: the range and which sides have at least `positions` moves in it.

    Games are (game_id, bin, moves, middle_tag, end_tag); the result keeps examples without an
    eligible side so that they can be counted.
    """
    tag = lambda c: F.nullif(F.col(c).try_cast("bigint"), F.lit(-1))
    good = games.filter(tag_status(F.col("middle_tag"), F.col("end_tag"), F.col("moves")) == "ok")
    rows = good.select(
        "game_id", "bin", F.explode(phase_ranges(F.col("moves"), tag("middle_tag"), tag("end_tag"))).alias("r")
    ).select("game_id", "bin", "r.*")
    enough = lambda parity: side_positions(F.col("start"), F.col("stop"), parity) >= positions
    return rows.withColumn("white_ok", enough(0)).withColumn("black_ok", enough(1))


def loader_statistics(games: DataFrame, positions: int, bins: int) -> DataFrame:
    """Per bin: games, tag problems, and per phase the usable and too-short examples; no bin is left out."""
    status = tag_status(F.col("middle_tag"), F.col("end_tag"), F.col("moves"))
    base = games.groupBy("bin").agg(
        F.count(F.lit(1)).alias("games"),
        F.count_if(status == "missing").alias("missing_tags"),
        F.count_if(status == "invalid").alias("invalid_tags"),
    )
    usable = F.col("white_ok") | F.col("black_ok")
    cells = []
    for phase in ("opening", "midgame", "endgame"):
        mine = F.col("phase") == phase
        cells += [F.count_if(mine & usable).alias(f"{phase}_examples"), F.count_if(mine & ~usable).alias(f"{phase}_too_few")]
    made = phase_examples(games, positions).groupBy("bin").agg(*cells)
    listed = games.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return listed.join(base, "bin", "left").join(made, "bin", "left").na.fill(0)


def require_examples(statistics: DataFrame) -> DataFrame:
    """The statistics; a bin without any usable example fails the job."""
    examples = F.col("opening_examples") + F.col("midgame_examples") + F.col("endgame_examples")
    return require(statistics, examples > 0, "a bin has no usable example")
