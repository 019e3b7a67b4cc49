"""Batches drawn from many positions: the positions stay where they are, only the draws travel."""

import pytest
from pyspark.sql import functions as F

from duelgauge.operators import training as TR

GAMES, PLIES = 40_000, 40


@pytest.fixture
def small_broadcasts(spark):
    """Spark refuses to broadcast a table above this size."""
    spark.conf.set("spark.sql.maxBroadcastTableSize", "48m")  # the least page of a table counts 32 MiB
    yield
    spark.conf.unset("spark.sql.maxBroadcastTableSize")


@pytest.fixture
def games(spark):
    return spark.range(GAMES).select(F.col("id").alias("game_id"), (F.col("id") % 6).alias("rank"))


@pytest.fixture
def positions(games):
    """All plies of the games; the plan of the exploded rows looks as small as the games."""
    rows = games.select("game_id", F.explode(F.sequence(F.lit(0), F.lit(PLIES - 1))).alias("ply"))
    return rows.withColumn("color", F.when(F.col("ply") % 2 == 0, "white").otherwise("black"))


def test_ranking_groups_do_not_broadcast_positions(spark, small_broadcasts, games, positions):
    rows = TR.ranking_groups(spark, games, positions, 10, 4, 3, "t").collect()
    assert len(rows) == 10 * 4 * 3
    assert all(len({(r.game_id, r.ply % 2) for r in rows if (r.grp, r.slot) == key}) == 1 for key in {(r.grp, r.slot) for r in rows})


def test_phase_batches_do_not_broadcast_positions(spark, small_broadcasts, games, positions):
    examples = games.select(
        "game_id", F.col("rank").alias("bin"), F.lit("midgame").alias("phase"), F.lit(10).cast("bigint").alias("start"),
        F.lit(30).cast("bigint").alias("stop"), F.lit(True).alias("white_ok"), F.lit(True).alias("black_ok"),
    )
    rows = TR.phase_batch(spark, examples, positions, 10, 4, 3, "t").collect()
    assert len(rows) == 10 * 4 * 3 and all(10 <= r.ply < 30 for r in rows)


def test_slot_positions_do_not_broadcast_positions(spark, small_broadcasts, games, positions):
    slots = games.select((F.col("game_id") % 500).alias("attempt"), F.floor(F.col("game_id") / 500).cast("int").alias("slot"), "game_id", F.lit("white").alias("color"))
    assert TR.slot_positions(slots, positions, "attempt", "slot").count() == GAMES * PLIES // 2


def test_a_large_draw_is_joined_by_a_shuffle(spark, games, positions):
    drawn = games.filter("game_id < 7").withColumn("color", F.lit("black"))
    small = TR.join_positions(drawn, 7, positions)
    large = TR.join_positions(drawn, 10**9, positions)
    key = lambda rows: sorted((r.game_id, r.ply, r.rank) for r in rows.collect())
    assert key(small) == key(large) and large.count() == 7 * PLIES // 2
