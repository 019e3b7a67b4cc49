"""The prediction cap by a shrinking frontier, and retention by threshold, against plain Python."""

import datetime
import random

import pytest

from duelgauge.operators import boundaries as D
from duelgauge.operators import context as X
from duelgauge.operators import corpus as C
from duelgauge.operators import replay as RB


def greedy(rows, cap):
    taken, out = {}, set()
    for game_id, _, white, black in sorted(rows, key=lambda r: (r[1], r[0])):
        if taken.get(white, 0) < cap and taken.get(black, 0) < cap:
            out.add(game_id)
            for player in (white, black):
                taken[player] = taken.get(player, 0) + 1
    return out


@pytest.mark.parametrize("tail_rows", [0, 40, 10_000])
def test_cap_equals_the_greedy_rule(spark, tail_rows):
    pick = random.Random(tail_rows)
    day = datetime.date(2024, 1, 1)
    rows = []
    for game_id in range(400):
        white = "star" if game_id % 3 == 0 else f"p{pick.randrange(25)}"
        black = pick.choice([f"p{pick.randrange(25)}", f"q{pick.randrange(200)}"])
        if white != black:
            rows.append((game_id, day + datetime.timedelta(days=pick.randrange(60)), white, black))
    games = spark.createDataFrame(rows, "game_id long, played_at date, white string, black string").repartition(5)
    for cap in (1, 4):
        got = [r.game_id for r in X.accepted_games(games, cap, tail_rows).collect()]
        assert len(got) == len(set(got)) and set(got) == greedy(rows, cap)


def test_cap_of_no_games(spark):
    games = spark.createDataFrame([], "game_id long, played_at date, white string, black string")
    assert X.accepted_games(games, 3).collect() == []


@pytest.mark.parametrize("kind", ["date", "timestamp", "long"])
def test_newest_games_equal_a_sort(spark, kind):
    pick = random.Random(5)
    made = {
        "date": lambda: datetime.date(2024, 1, 1) + datetime.timedelta(days=pick.randrange(9)),
        "timestamp": lambda: datetime.datetime(2024, 1, 1) + datetime.timedelta(microseconds=pick.randrange(10**12)),
        "long": lambda: pick.choice([-(2**40), 0, 7, 2**50]),
    }[kind]
    rows = [(k * 977 % 1_009, made() if pick.random() < 0.9 else None) for k in range(300)]
    games = spark.createDataFrame(rows, f"game_id long, arrival {kind}").repartition(4)
    ranked = sorted(rows, key=lambda r: (False, 0, r[0]) if r[1] is None else (True, r[1], r[0]), reverse=True)
    for keep in (0, 1, 57, 290, 300, 1_000):
        got = sorted(r.game_id for r in RB.newest_games(games, keep).collect())
        assert got == sorted(r[0] for r in ranked[:keep])


def test_newest_games_are_a_filter(spark):
    games = spark.createDataFrame([(k, k % 5) for k in range(100)], "game_id long, arrival long")
    plan = RB.newest_games(games, 30)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "Sort" not in plan


def test_a_bin_without_examples_fails(spark):
    rows = [(k, k % 2, 60, "20", "40") for k in range(4)]
    games = spark.createDataFrame(rows, "game_id long, bin long, moves long, middle_tag string, end_tag string")
    assert D.require_examples(D.loader_statistics(games, 6, 2)).count() == 2
    with pytest.raises(Exception, match="no usable example"):
        D.require_examples(D.loader_statistics(games, 6, 3)).collect()


def test_refused_games_leave_in_the_round_that_refuses_them(spark, monkeypatch):
    day = datetime.date(2024, 1, 1)
    rows = [(k, day + datetime.timedelta(days=k // 3), "star", f"p{k}") for k in range(30)]
    games = spark.createDataFrame(rows, "game_id long, played_at date, white string, black string")
    stored = []
    kept = X.cut_lineage
    monkeypatch.setattr(X, "cut_lineage", lambda df: stored.append(df) or kept(df))
    got = {r.game_id for r in X.accepted_games(games, 2, 0).collect()}
    assert got == greedy(rows, 2) == {0, 1}
    assert len(stored) == 3  # all games, the accepted ones, no open ones


def test_reasons_are_found_without_reading_contexts(spark):
    pick = random.Random(3)
    day = datetime.date(2024, 1, 1)
    rows = []
    for k in range(120):
        white, black = pick.sample(["a", "b", "c", "d", "e"], 2)
        rows.append((k, day + datetime.timedelta(days=k // 2), "Blitz", white, black, 1500, 1500, 1))
    games = spark.createDataFrame(rows, "game_id long, played_at date, event string, white string, black string, white_elo long, black_elo long, result long")
    made = X.build_examples(games, C.ContextPolicy(context_size=2, max_predictions_per_player=4), strict_cap=True)
    plan = made.select("game_id", "reason")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and "context:array" not in plan
    full = {r.game_id: r for r in made.collect()}
    for game_id, played_at, _, white, black, *_ in rows:
        for side, player in (("white", white), ("black", black)):
            earlier = [r[0] for r in sorted(rows, key=lambda r: (r[1], r[0])) if player in r[3:5] and r[1] < played_at][-2:]
            held = full[game_id][f"{side}_context"]
            assert [c.game_id for c in held or []] == (earlier if len(earlier) == 2 else [])
