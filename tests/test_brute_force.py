"""Distributed jobs against straightforward Python on small, skewed fixtures."""

import collections
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from duelgauge.operators import context as X
from duelgauge.operators import corpus as C
from duelgauge.operators import graph as G
from duelgauge.operators import replay as RB


@pytest.fixture(scope="module")
def games():
    """400 games of 12 players on 40 days; one player takes part in over half of them."""
    rng = random.Random(3)
    names = ["hot"] + [f"p{i}" for i in range(11)]
    rows = []
    for i in range(400):
        white = "hot" if rng.random() < 0.35 else rng.choice(names)
        black = rng.choice([n for n in names if n != white])
        if rng.random() < 0.3 and white != "hot":
            black = "hot"
        day = pd.Timestamp("2024-01-01") + pd.Timedelta(days=rng.randrange(40))
        rows.append((i, day.date(), rng.choice(["Blitz"] * 9 + ["Rapid"]), white, black, rng.randrange(950, 1800), rng.randrange(950, 1800), rng.choice([1, 0, -1])))
    return pd.DataFrame(rows, columns=["game_id", "played_at", "event", "white", "black", "white_elo", "black_elo", "result"])


def reason_of(g, policy):
    if g.event not in policy.allowed_events:
        return "unsupported_event"
    ok = policy.min_elo <= g.white_elo <= policy.max_elo and policy.min_elo <= g.black_elo <= policy.max_elo
    return None if ok else "rating_out_of_range"


def walk(games, policy):
    """One pass in catalog order, as a person would do it."""
    ordered = sorted(games.itertuples(), key=lambda g: (g.played_at, g.game_id))
    done, out = collections.Counter(), {}
    for g in ordered:
        reason, contexts = reason_of(g, policy), {}
        if reason is None and policy.max_predictions_per_player is not None:
            if max(done[g.white], done[g.black]) >= policy.max_predictions_per_player:
                reason = "max_predictions_per_player"
        if reason is None:
            for side in ("white", "black"):
                name = getattr(g, side)
                ages = lambda o: (g.played_at - o.played_at).days
                usable = [
                    o for o in ordered
                    if name in (o.white, o.black) and reason_of(o, policy) is None and o.played_at < g.played_at
                    and ages(o) * 86400 >= policy.min_context_age_seconds
                    and (policy.max_context_age_days is None or ages(o) <= policy.max_context_age_days)
                ]
                if len(usable) < policy.context_size:
                    reason = f"{side}_insufficient_context"
                    break
                contexts[side] = [o.game_id for o in usable[-policy.context_size :]]
        if reason is None:
            done[g.white] += 1
            done[g.black] += 1
        out[g.game_id] = (reason, contexts if reason is None else None)
    return out


@pytest.mark.parametrize(
    "policy, strict",
    [
        (C.ContextPolicy(context_size=4), False),
        (C.ContextPolicy(context_size=3, max_context_age_days=9), False),
        (C.ContextPolicy(context_size=3, min_context_age_seconds=4 * 86400), False),
        (C.ContextPolicy(context_size=2, min_context_age_seconds=2 * 86400, max_context_age_days=12), False),
        (C.ContextPolicy(context_size=3, max_predictions_per_player=5), True),
    ],
)
def test_examples_match_a_sequential_walk(spark, games, policy, strict):
    made = X.build_examples(spark.createDataFrame(games), policy, strict_cap=strict).collect()
    want = walk(games, policy)
    assert len(made) == len(want)
    for row in made:
        reason, contexts = want[row.game_id]
        assert row.reason == reason, row
        if reason is None:
            for side in ("white", "black"):
                assert [c.game_id for c in row[f"{side}_context"]] == contexts[side]


def test_duplicate_ids_are_reported_once_per_copy(spark, games):
    twice = pd.concat([games, games.head(5)])
    made = X.build_examples(spark.createDataFrame(twice), C.ContextPolicy(context_size=1))
    assert X.exclusion_counts(made).filter("reason = 'duplicate_game'").first().n == 5


@pytest.mark.parametrize("caps", [(16, 32), (None, None), (2, 3)])
def test_chains_are_simple_paths_of_real_wins(spark, games, caps):
    df = spark.createDataFrame(games)
    index = G.chain_index(df, *caps)
    chains = G.sample_chains(index, 5, 200, 1_000, "t").collect()
    by_id = games.set_index("game_id")
    assert chains
    for chain in chains:
        assert len(set(chain.players)) == 5
        edge_ids = [e.game_id for e in chain.edges]
        for weak, strong, game_id in zip(chain.players, chain.players[1:], edge_ids):
            g = by_id.loc[game_id]
            assert (g.white, g.black) == ((strong, weak) if g.result > 0 else (weak, strong)) and g.result != 0
        picked = [t.game_id for t in chain.training]
        assert len(set(picked)) == 5 and not set(picked) & set(edge_ids)
        for player, t in zip(chain.players, chain.training):
            assert by_id.loc[t.game_id][t.color] == player


def test_draws_are_uniform_over_what_is_usable(spark):
    """b beat c 30 times and d once; a beat b. From a, the third player is c in 30 of 31 draws, and d can only end a path."""
    rows = [("a", "b")] + [("b", "c")] * 30 + [("b", "d"), ("c", "a"), ("c", "b")]
    table = pd.DataFrame(rows, columns=["white", "black"]).assign(game_id=range(len(rows)), result=1, white_elo=1500, black_elo=1400, event="x", played_at=pd.Timestamp("2024-01-01"))
    index = G.chain_index(spark.createDataFrame(table), None, None)
    paths = [tuple(r.players) for r in G.sample_paths(G.chain_seeds(index, 0, 3_000), index, 3, "u").collect()]
    from_a = [p for p in paths if p[0] == "a"]
    assert {p[:2] for p in from_a} == {("a", "b")} and 0.94 < sum(p[2] == "c" for p in from_a) / len(from_a) < 0.99
    assert {p for p in paths if p[0] == "c"} == {("c", "a", "b"), ("c", "b", "d")}  # b cannot go back to c, d has no win
    assert {p for p in paths if p[0] == "b"} == {("b", "c", "a")}


def test_draws_do_not_shuffle_the_index(spark, games):
    index = G.chain_index(spark.createDataFrame(games))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # no table counts as small by itself
    try:
        paths = G.sample_paths(G.chain_seeds(index, 0, 300), index, 3, "s")
        plan = G.pick_training_games(G.weak_to_strong(paths), index, 3)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert plan.count("BroadcastHashJoin") >= 3 and "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_large_rounds_give_the_same_chains(spark, games, monkeypatch):
    index = G.chain_index(spark.createDataFrame(games))
    draw = lambda: sorted(tuple(r) for r in G.sample_chains(index, 4, 400, 400, "r").select("attempt", "players").collect())
    few = draw()
    monkeypatch.setattr(G, "_asked", lambda rows, few: rows)
    assert draw() == few and few
    monkeypatch.undo()
    monkeypatch.setattr(G, "ROUND_ATTEMPTS", 150)
    assert draw() == few


def test_rounds_do_not_change_the_chains(spark, games):
    index = G.chain_index(spark.createDataFrame(games))
    made = [G.keep_first(G.sample_chains(index, 4, 900, 50, "r", rate=rate), 50).select("attempt", "players").collect() for rate in (0.04, 1.0)]
    assert sorted(made[0]) == sorted(made[1]) and made[0]


def test_concentration_and_lorenz_against_numpy(spark):
    rng = np.random.default_rng(0)
    counts = np.sort(rng.zipf(1.8, 500).clip(max=2000))
    df = spark.createDataFrame(pd.DataFrame({"player": np.arange(500), "n": counts}))
    row = G.concentration(df).first()
    n, total = len(counts), counts.sum()
    gini = 2 * (np.arange(1, n + 1) * counts).sum() / (n * total) - (n + 1) / n
    share = np.insert(counts.cumsum() / total * 100, 0, 0)
    assert row.gini == pytest.approx(gini)
    assert row.share_top1 == pytest.approx(100 - share[int(n * 0.99)])
    assert row.share_top10 == pytest.approx(100 - share[int(n * 0.90)])


@pytest.fixture(scope="module")
def long_game():
    rng = np.random.default_rng(9)
    sizes = {1: 1300, 2: 7, 3: 40}
    parts = [pd.DataFrame({"game_id": g, "ply": np.arange(n)}) for g, n in sizes.items()]
    frame = pd.concat(parts, ignore_index=True)
    frame["reward"], frame["value"] = rng.normal(size=len(frame)), rng.normal(size=len(frame))
    frame["lives"] = np.where(rng.random(len(frame)) < 0.1, rng.integers(0, 3, len(frame)), -1)
    return frame


@pytest.mark.parametrize("life_loss", [False, True])
def test_n_step_returns_across_segments(spark, long_game, life_loss):
    df = spark.createDataFrame(long_game).withColumn("lives", F.when(F.col("lives") >= 0, F.col("lives")))
    got = RB.n_step_returns(df, 5, 0.9, life_loss).select("game_id", "ply", "n_step").toPandas()
    got = got.set_index(["game_id", "ply"])["n_step"]
    for game_id, game in long_game.groupby("game_id"):
        r, v, lost = game["reward"].to_numpy(), game["value"].to_numpy(), game["lives"].to_numpy()
        for ply in range(len(game)):
            total, end = 0.0, min(ply + 5, len(game))
            for i in range(ply, end):
                if life_loss and lost[i] > 0:
                    break
                total += 0.9 ** (i - ply) * r[i]
            else:
                if ply + 5 < len(game) and not (life_loss and lost[ply + 5] >= 0):
                    total += 0.9**5 * v[ply + 5]
            assert got[(game_id, ply)] == pytest.approx(total)


def test_weighted_draws_follow_the_weights(spark):
    rows = [(g, p, float(1 + (g == 0) * 30)) for g in range(20) for p in range(10)]
    df = spark.createDataFrame(rows, "game_id bigint, ply bigint, weight double")
    drawn = RB.weighted_draws(df, 4000, "w", 1.0)
    assert drawn.count() == 4000
    hot = drawn.filter("game_id = 0").count() / 4000
    assert hot == pytest.approx(31 / 50, abs=0.03)
    scale = drawn.filter("game_id = 0").first().loss_scale
    assert scale == pytest.approx(500 / (200 * 31))
