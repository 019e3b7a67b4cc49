"""PGN files: each text is searched once, whatever is asked of the games, and files are compressed and bounded."""

import os

from pyspark.sql import functions as F

from duelgauge.plans import catalog
from duelgauge.plans import jobs as J
from duelgauge.plans import source_queries as SQ
from duelgauge.sources import records as RD

GAMES = [
    '\ufeff[Event "Rated Blitz game"]\r\n[White "A"]\r\n[Black "B"]\r\n[WhiteElo "1510"]\r\n[BlackElo "1490"]\r\n\r\n' + "Nf3! {[%clk 0:00:01]}\r\n" * 22 + "1-0\r\n",
    '\n[Event "b"]\n[White "x\ny"] \n[Site "s"]x\n[WhiteElo "1"] [BlackElo "2"]\n\n1. e4 { [%cal "q"] } \t d4!! [A "b"] 1-0',
    '\n[Event "c"]\n[White "x"]\n[White "z"]\n\n\n\n1. d4\n\n\n[Odd "late"]\nNf3 0-1\n\n',
    "\n\n[Event no tag",
    '\n\n[Event "only"]',
]


def written(tmp_path):
    path = tmp_path / "x.pgn"
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write("\n".join(GAMES))
    return str(path)


def test_odd_texts_keep_their_tags_and_moves(spark, tmp_path):
    rows = RD.read_pgn(spark, written(tmp_path)).orderBy("line_no").collect()
    assert [(r.line_no, r.movetext) for r in rows[1:]] == [(1, '[White "x y"] [Site "s"]x [WhiteElo "1"] [BlackElo "2"] 1. e4 { [%cal "q"] } d4!! [A "b"] 1-0'), (2, "1. d4 Nf3 0-1"), (4, "")]
    assert [r.tags for r in rows[1:]] == [{"Event": "b", "White": "x\ny", "Site": "s", "WhiteElo": "1"}, {"Event": "c", "White": "x", "Odd": "late"}, {"Event": "only"}]
    assert rows[0].tags["BlackElo"] == "1490" and rows[0].movetext.startswith("Nf3! {[%clk 0:00:01]} Nf3!")


def test_moves_and_clocks_of_odd_texts(spark):
    text = "\u00a0 Nf3 Bb5\u3000c4 {[%clk 1:02:03]} 00:7:99999999999999999999] 5:6:7:8] _d3 x!y! ?!Nc3 2.Nf3 Qh5?!? a\u0085b 1-0"
    pgn = spark.createDataFrame([("f", 0, {"Event": "x"}, text)], "file string, line_no bigint, tags map<string, string>, movetext string")
    row = RD.pgn_corpus(pgn).first()
    assert row.moves == ["Nf3", "Bb5\u3000c4", "xy", "Qh5", "a\u0085b"] and row.clocks == [3723, None, 22028]


def test_conditions_on_games_do_not_search_the_tags_again(spark, tmp_path, capsys):
    made = J.pgn_corpus(spark, written(tmp_path))
    made["distribution"].select("low", "n").explain()
    assert capsys.readouterr().out.count("map_from_entries") == 1
    assert sorted((r.low, r.n) for r in made["distribution"].collect()) == [(1400, 1), (1500, 1)]
    assert {r.reason: r.n for r in made["reasons"].collect()} == {None: 1, "event": 3}


def test_pgn_files_are_compressed_and_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(SQ.SK, "LINES_PER_FILE", 40)
    keys = spark.range(-150, 150).select(F.when(F.col("id") % 50 != 0, F.col("id")).alias("k"))
    keys.select(
        F.col("k").alias("o_orderkey"), (F.col("k") % 30).alias("o_custkey"), F.lit("2024-01-02").cast("timestamp").alias("o_orderdate"),
        F.when(F.col("k") % 2 == 0, "5-LOW").otherwise("1-URGENT").alias("o_orderpriority"),
    ).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(30).select(F.col("id").alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    path = SQ.written_pgn(spark, str(tmp_path))
    files = [f for f in os.listdir(path.removeprefix("file:")) if f.startswith("part-")]
    assert len(files) >= 8 and all(f.endswith(".txt.gz") for f in files)
    found = RD.pgn_corpus(RD.read_pgn(spark, path)).drop("file", "line_no")
    plain = RD.pgn_corpus(RD.read_pgn(spark, SQ.written(spark, "pgn", SQ.pgn_lines(spark, str(tmp_path))))).drop("file", "line_no")
    assert sorted(map(str, found.collect())) == sorted(map(str, plain.collect())) and found.count() > 200
    assert catalog.QUERIES["src_04_pgn_headers"](spark, str(tmp_path)).count() == found.count()
