"""Ordered operators against plain pandas, with one key holding most of the rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from duelgauge.operators import ordered


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(5)
    keys = np.where(rng.random(6000) < 0.6, "hot", rng.integers(0, 40, 6000).astype(str))
    frame = pd.DataFrame({"k": keys, "id": np.arange(6000), "v": rng.normal(0, 50, 6000)})
    frame["gap"] = frame["v"].where(frame["id"] % 7 == 0)
    return spark.createDataFrame(frame).withColumn("gap", F.nanvl("gap", F.lit(None))), frame


def test_row_numbers_and_running_totals_cross_segments(skewed):
    df, frame = skewed
    got = ordered.running_totals(
        df, ["k"], ["id"], F.floor(F.col("id") / 100), {"rn": F.lit(1).cast("bigint"), "total": F.col("v")}
    ).toPandas().sort_values("id").reset_index(drop=True)
    grouped = frame.groupby("k")
    assert (got["rn"].to_numpy() == grouped.cumcount().to_numpy() + 1).all()
    np.testing.assert_allclose(got["total"], grouped["v"].cumsum(), atol=1e-6)


def test_exclusive_totals_start_at_zero(skewed):
    df, frame = skewed
    got = ordered.running_totals(df, [], ["id"], F.floor(F.col("id") / 50), {"before": F.lit(1)}, inclusive=False)
    assert got.agg(F.sum((F.col("before") != F.col("id")).cast("int"))).first()[0] == 0


def test_running_last_carries_over_empty_segments(skewed):
    df, frame = skewed
    got = ordered.running_last(df, ["k"], "id", F.floor(F.col("id") / 3), {"seen": F.col("gap")}).toPandas()
    got = got.sort_values("id").reset_index(drop=True)
    want = frame.groupby("k")["gap"].ffill()
    np.testing.assert_allclose(got["seen"].astype(float), want.astype(float), equal_nan=True)


def test_hash_ranks_are_dense_permutations(skewed):
    df, frame = skewed
    got = ordered.hash_ranks(df, ["k"], ["id"], "seed").toPandas()
    for key, ranks in got.groupby("k")["rn"]:
        assert sorted(ranks) == list(range(1, len(ranks) + 1))
    again = ordered.hash_ranks(df.repartition(7), ["k"], ["id"], "seed").toPandas()
    assert got.set_index("id")["rn"].sort_index().equals(again.set_index("id")["rn"].sort_index())


def test_hash_sample_equals_the_first_ranks(skewed):
    df, _ = skewed
    ranked = ordered.hash_ranks(df, ["k"], ["id"], "s").filter("rn <= 5").select("id")
    sampled = ordered.hash_sample(df, ["k"], ["id"], "s", 5).select("id")
    assert ranked.exceptAll(sampled).count() == 0 and sampled.exceptAll(ranked).count() == 0


@pytest.mark.parametrize("p", [0.0, 0.01, 0.5, 0.99, 1.0])
def test_quantiles_are_exact(skewed, p):
    df, frame = skewed
    got = ordered.quantiles(df, ["k"], "v", {"q": p}, 5.0).toPandas().set_index("k")["q"].sort_index()
    want = frame.groupby("k")["v"].quantile(p).sort_index()
    np.testing.assert_allclose(got, want, atol=1e-9)


def test_combined_draws_are_uniform(spark):
    from duelgauge.operators import trials

    sizes = spark.createDataFrame([(1, 10)], "g bigint, pool bigint")
    drawn = trials.draws(sizes, "g", (100,), 500, "u").groupBy("draw").count().toPandas()
    assert sorted(drawn["draw"]) == list(range(1, 11))
    assert abs(drawn["count"] - 5000).max() < 350


def test_hash_first_equals_full_ranks(skewed):
    df, _ = skewed
    first = ordered.hash_first(df, ["k"], ["id"], "s", 1500).select("id", "rn")
    full = ordered.hash_ranks(df, ["k"], ["id"], "s").filter("rn <= 1500").select("id", "rn")
    assert first.exceptAll(full).count() == 0 and full.exceptAll(first).count() == 0


def test_bands_keep_all_or_count_what_they_leave(skewed):
    from duelgauge.operators import corpus

    df, _ = skewed
    full = ordered.hash_ranks(df, ["k"], ["id"], "b")
    some, whole = {"eval": 30, "train": 50}, {"eval": 30, "test": 50, "train": None}
    want = full.selectExpr("id", "CASE WHEN rn <= 30 THEN 'eval' WHEN rn <= 80 THEN 'test' ELSE 'train' END AS split")
    got = corpus.rank_bands(df, ["k"], ["id"], "b", whole).select("id", "split")
    assert got.exceptAll(want).count() == 0 and got.count() == df.count()
    kept = corpus.rank_bands(df, ["k"], ["id"], "b", some)
    lost = corpus.left_out(df, ["k"], some).agg({"left_out": "sum"}).first()[0]
    assert kept.count() + lost == df.count() and corpus.left_out(df, ["k"], whole).filter("left_out > 0").count() == 0


def test_a_context_game_without_score_fails(spark):
    from duelgauge.operators import context

    one = "array(named_struct('game_id', 7L, 'target_color', 'white'), named_struct('game_id', 8L, 'target_color', 'black'))"
    examples = spark.sql(f"SELECT 1L AS game_id, {one} AS white_context, {one} AS black_context")
    scores = spark.createDataFrame([(7, "white", 1.0), (8, "black", 3.0)], "game_id long, color string, score double")
    row = context.context_strength(examples, scores).first()
    assert (row.white_strength, row.black_strength) == (2.0, 2.0)
    with pytest.raises(Exception, match="no score"):
        context.context_strength(examples, scores.limit(1)).collect()


def test_drawn_positions_exist_in_games_with_gaps(spark):
    from duelgauge.operators import training

    positions = spark.range(0, 60, 2).selectExpr("1L AS game_id", "id AS ply")  # one side's moves only
    drawn = spark.range(300).selectExpr("id AS grp", "1L AS game_id")
    plies = {r.ply for r in training.draw_position(drawn, positions, "s", "grp").collect()}
    assert plies <= set(range(0, 60, 2)) and len(plies) > 25


def test_both_sides_of_the_broadcast_switch_agree(spark, monkeypatch):
    from duelgauge import runtime
    from duelgauge.operators import trials

    entries = spark.range(200).selectExpr("id % 3 AS g", "id AS game_id", "id * 1.5D AS score")
    drawn = trials.draws(trials.pool_sizes(entries, "g"), "g", (5,), 20, "x")
    rows = lambda: sorted(map(tuple, trials.join_pool(drawn, entries, "g", ["game_id"]).collect()))
    small = rows()
    monkeypatch.setattr(trials, "broadcast_if_small", lambda df, sized_by: runtime.broadcast_if_small(df, sized_by, 10))
    assert rows() == small


def test_no_weighted_draw_is_lost(spark):
    from duelgauge.operators import replay

    rows = spark.range(900).selectExpr("id % 7 AS game_id", "id AS ply", "0.1D + (id % 11) / 3.0D AS weight")
    drawn = replay.weighted_draws(rows, 3000, "w", 0.4)
    assert drawn.count() == 3000 and drawn.select("draw").distinct().count() == 3000
    assert drawn.filter("ply % 7 <> game_id").count() == 0


@pytest.mark.parametrize("inclusive", [True, False])
def test_nested_segments_equal_one_running_sum(spark, inclusive):
    rng = np.random.default_rng(3)
    ids = np.unique(np.r_[rng.integers(-(2**30), 2**41, 300), rng.integers(0, 40_000, 300)])
    frame = pd.DataFrame({"k": np.where(ids % 3 == 0, "hot", (ids % 5).astype(str)), "id": ids, "v": rng.integers(-9, 9, len(ids))})
    rows = spark.createDataFrame(frame).repartition(5)
    for keys in ([], ["k"]):
        got = ordered.running_totals(rows, keys, ["id"], ordered.id_levels(F.col("id")), {"s": F.col("v")}, inclusive).toPandas().sort_values("id")
        sums = frame.groupby("k")["v"].cumsum() if keys else frame["v"].cumsum()
        assert (got["s"].to_numpy() == (sums if inclusive else sums - frame["v"]).to_numpy()).all()


def test_no_task_holds_many_segment_totals(spark):
    """Ten billion consecutive ids: the totals that meet in one window of each level, counted without the rows."""
    blocks = spark.range(0, 10**10, 8_192)
    fine, coarse = ordered.id_levels(F.col("id"))[::-1]
    per_task = blocks.select(coarse.alias("c"), fine.alias("f")).distinct().groupBy("c").count()
    assert per_task.agg(F.max("count")).first()[0] <= 8_192 and per_task.count() <= 8_192
    plan = ordered.row_numbers(spark.range(10), [], ["id"], ordered.id_levels(F.col("id")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 3  # rows in a fine segment, fine totals in a coarse one, coarse totals
