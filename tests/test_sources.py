"""Readers and writers on small files written by the tests."""

import pytest
from pyspark.sql import functions as F

from duelgauge import schemas
from duelgauge.operators import corpus as C
from duelgauge.operators import scoring as S
from duelgauge.plans import jobs as J
from duelgauge.sources import records as RD
from duelgauge.sources import sinks as SK
from duelgauge.sources import tables as TB

GOOD = "(;GM[chess]RE[1.0]EV[Blitz]PW[Ann]PB[Bob]DT[2024.01.02]WR[1500]BR[1400];B[e2e4]TM[300];W[e7e5]TM[299])"


def test_scan_counts_every_kind_of_line(spark, tmp_path):
    path = tmp_path / "games.txt"
    lines = [
        GOOD.encode(),
        GOOD.replace("RE[1.0]", "RE[0.0]").encode(),
        GOOD.replace("RE[1.0]", "RE[0.5]").encode(),
        GOOD.replace("WR[1500]", "").encode(),
        b"(;RE[1.0]PW[\xff\xfe]PB[b])",
        b"(;RE[?]PW[a]PB[b])",
    ]
    path.write_bytes(b"\n".join(lines) + b"\n")
    row = RD.scan_counters(RD.read_records(spark, str(path))).first()
    assert (row.lines, row.decisive, row.draws, row.parse_skip, row.rating_skip) == (6, 2, 1, 3, 1)


def test_catalog_ids_and_defaults(spark, tmp_path):
    path = tmp_path / "club.sgf"
    bare = "(;GM[chess]RE[-1]EV[]PW[C]PB[D]DT[2024.02.03];B[d2d4])"
    path.write_text("preamble\n" + GOOD + "\n\n" + bare + "\n(;GM[chess]PW[broken]\n" + GOOD + "\n")
    rows = sorted(RD.read_catalog(spark, str(path)).collect(), key=lambda r: int(r.game_id.split(":")[2]))
    assert [r.game_id.split(":")[::2] for r in rows] == [["club", "0"], ["club", "1"], ["club", "2"]]
    assert rows[0].game_id.split(":")[1] == rows[2].game_id.split(":")[1] and len(rows[0].game_id.split(":")[1]) == 12
    assert (rows[1].event, rows[1].white_elo, rows[1].black_elo, rows[1].result) == ("Blitz", 0, 0, -1)
    assert str(rows[0].played_at) == "2024-01-02" and rows[0].record == GOOD


def test_variations_and_escapes_stay_off_the_main_line(spark):
    text = r"(;PW[a(b];B[e2e4]C[x\]y (z)](;W[c7c5];B[g1f3])(;W[e7e6]);W[e7e5]TM[9]TM[8])"
    rows = RD.explode_moves(spark.createDataFrame([(1, text)], "game_id int, value string")).orderBy("ply").collect()
    assert [(r.ply, r.color, r.move, r.clock_s) for r in rows] == [(0, "white", "e2e4", None), (1, "black", "e7e5", 9)]
    assert rows[0].props == {"C": "x]y (z)"}


PGN = """﻿[Event "Rated Blitz game"]
[White "Ann"]
[Black "Bob"]
[Result "1-0"]
[UTCDate "2024.01.02"]
[WhiteElo "1500"]
[BlackElo "1400"]
[TimeControl "180+2"]

{moves} 1-0

[Event "Rated Rapid game"]
[White "Ann"]
[Black "Bob"]
[Result "0-1"]

1. e4 e5 0-1

[Event "Rated Blitz game"]
[White "Ann"]
[Black "?"]
[Result "1/2-1/2"]
[WhiteElo "1500"]
[BlackElo "?"]

1. e4 e5 1/2-1/2
"""


def test_pgn_headers_and_eligibility(spark, tmp_path):
    moves = " ".join(f"{i}. Nf3! {{ [%clk 0:02:{i:02d}] }} {i}... Nc6?? {{ [%clk 0:01:{i:02d}] }}" for i in range(1, 12))
    path = tmp_path / "games.pgn"
    path.write_text(PGN.replace("{moves}", moves), encoding="utf-8")
    pgn = RD.read_pgn(spark, str(path))
    assert [r.tags["Event"] for r in pgn.orderBy("line_no").collect()] == ["Rated Blitz game", "Rated Rapid game", "Rated Blitz game"]
    rows = RD.pgn_corpus(pgn).orderBy("line_no").collect()
    assert [r.reason for r in rows] == [None, "event", "missing_player"]
    good = rows[0]
    assert (good.result, len(good.moves), good.moves[0], good.moves[1]) == (1, 22, "Nf3", "Nc6")
    assert (good.time_control.base_s, good.time_control.increment_s, good.clocks[0], good.clocks[1]) == (180, 2, 121, 61)


def test_bucket_files_give_their_bounds(spark, tmp_path):
    (tmp_path / "1000_1200.txt").write_text("a\n\n  \nb\n")
    (tmp_path / "1200_1400.txt").write_text("c\n")
    (tmp_path / "notes_x.txt").write_text("skip\n")
    got = {(r.low, r.high): r["count"] for r in RD.read_buckets(spark, str(tmp_path)).groupBy("low", "high").count().collect()}
    assert got == {(1000, 1200): 2, (1200, 1400): 1}


def test_inputs_must_exist(spark, tmp_path):
    (tmp_path / "b.txt").write_text("x")
    (tmp_path / "a.txt").write_text("x")
    assert [p.rsplit("/", 1)[1] for p in RD.select_inputs(spark, str(tmp_path))] == ["a.txt", "b.txt"]
    with pytest.raises(FileNotFoundError):
        RD.select_inputs(spark, [])


def test_guard_rejects_another_configuration(spark):
    table = spark.createDataFrame([("step-1",)], "checkpoint string")
    assert TB.guard(table, checkpoint="step-1").count() == 1
    with pytest.raises(Exception, match="does not match"):
        TB.guard(table, checkpoint="step-2").collect()


def test_score_cache_computes_once(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.createDataFrame([(1, 2, 3, 4, 0.5, 6, 0.7, 8)], schemas.GAME_SCORES)

    for _ in range(2):
        assert TB.score_cache(spark, str(tmp_path / "cache"), schemas.GAME_SCORES, compute).first().white_score == 0.5
    assert calls == [1]


def test_record_lines_round_trip(spark):
    games = spark.createDataFrame(
        [(1, "A[1]", "B(2)", "Blitz", 1500, 0, 1)], "game_id int, white string, black string, event string, white_elo int, black_elo int, result int"
    ).withColumn("played_at", F.to_date(F.lit("2024-01-02")))
    moves = spark.createDataFrame([(1, 0, "white", "e2e4", 300), (1, 1, "black", "e7e5", None)], "game_id int, ply int, color string, move string, clock_s int")
    line = SK.record_lines(games, moves).first().value
    assert line == r"(;GM[chess]RE[1.0]EV[Blitz]PW[A\[1\]]PB[B\(2\)]DT[2024.01.02]WR[1500];B[e2e4]TM[300];W[e7e5])"


def test_partitioned_write_keeps_all_rows(spark, tmp_path):
    rows = spark.range(1000).select("id", F.when(F.col("id") < 900, "hot").otherwise("cold").alias("bin"))
    SK.write_partitioned(rows, str(tmp_path / "out"), "bin")
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("bin").count().filter("bin = 'hot'").first()["count"] == 900


def test_evaluation_rejects_incomplete_models(spark):
    examples = spark.createDataFrame([(1, 1500, 1400, 1), (2, 1500, 1600, -1)], "game_id int, white_elo int, black_elo int, result int")
    slices = {"favourite": lambda: F.when(F.col("white_elo") > F.col("black_elo"), "white").otherwise("black")}
    report = J.evaluate(examples, J.rating_model(), slices, minimum=1)
    assert report["metrics"].first().accuracy == 1.0 and report["slices"].count() == 2
    for bad in (lambda e: J.rating_model()(e).filter("game_id = 1"), lambda e: J.rating_model()(e).unionAll(J.rating_model()(e))):
        with pytest.raises(Exception, match="one to one"):
            J.evaluate(examples, bad, slices)["metrics"].collect()


def test_scorer_output_and_means(spark):
    def constant(batches):
        import pandas as pd

        for batch in batches:
            rows = [(g, i, ("white", "black")[i % 2], (0.5, 0.25)[i % 2]) for g, m in zip(batch["game_id"], batch["moves"]) for i in range(len(m))]
            yield pd.DataFrame(rows, columns=["game_id", "ply", "color", "score"])

    games = spark.createDataFrame([(7, ["e2e4", "e7e5", "g1f3"])], "game_id bigint, moves array<string>")
    got = {r.color: (r.score, r.moves) for r in S.side_means(S.score_games(games, constant)).collect()}
    assert got == {"white": (0.5, 2), "black": (0.25, 1)}


def test_broken_replay_is_reported(spark):
    games = spark.createDataFrame([(1, ["e2e4", "e7e5"]), (2, ["e2e4", "e4e5"])], "game_id bigint, moves array<string>")
    clean, broken = S.split_replay(S.replay_positions(games))
    assert [r.game_id for r in clean.select("game_id").distinct().collect()] == [1]
    assert [(r.game_id, r.reason) for r in broken.collect()] == [(2, "illegal_move_replay")]


def test_prepare_corpus_splits_are_disjoint(spark):
    games = spark.range(500).select(F.col("id").alias("game_id"), (F.lit(1000) + F.col("id") % 7).alias("white_elo"), F.lit(1010).alias("black_elo"))
    made = J.prepare_corpus(games, C.Bins(1000, 1400, 200), {"eval": 30, "train": 100})
    assert {r.split: r["count"] for r in made["splits"].groupBy("split").count().collect()} == {"eval": 30, "train": 100}
    assert made["splits"].select("game_id").distinct().count() == 130


def test_stored_tables_go_with_their_scope(spark):
    import os

    from duelgauge import runtime

    with runtime.stored_tables(spark):
        before = set(os.listdir(runtime.shared_dir(spark).removeprefix("file:")))
        assert runtime.cut_lineage(spark.range(5)).count() == 5
        during = set(os.listdir(runtime.shared_dir(spark).removeprefix("file:")))
    after = set(os.listdir(runtime.shared_dir(spark).removeprefix("file:")))
    assert len(during - before) == 1 and not (during - before) & after


def test_stream_state_is_compacted(spark, monkeypatch, tmp_path):
    from pyspark.sql import functions as F

    from duelgauge.streaming import streams

    monkeypatch.setattr(streams, "COMPACT_EVERY", 3)
    source = f"{tmp_path}/in"
    for k in range(7):
        spark.createDataFrame([(k % 2, k)], "key long, v long").coalesce(1).write.mode("append").parquet(source)
    rows = spark.readStream.schema("key long, v long").option("maxFilesPerTrigger", 1).parquet(source)
    changed = rows.groupBy("key").agg(F.sum("v").alias("total"))
    streams._run_updates(changed, f"{tmp_path}/out", f"{tmp_path}/check", ("key",))
    assert sorted(map(tuple, streams.latest(spark, f"{tmp_path}/out", "key").collect())) == [(0, 12), (1, 9)]
    assert len(streams._folders(spark, f"{tmp_path}/out")) <= 3
