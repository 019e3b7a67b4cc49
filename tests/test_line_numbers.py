"""Line numbers of whole files, PGN tags, capped chain index: no text or list is sorted for them."""

import pytest
from pyspark.sql import functions as F

from duelgauge.operators import graph as G
from duelgauge.operators import ordered
from duelgauge.sources import records as RD


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_lines_are_numbered_over_the_blocks_of_their_file(spark, small_blocks, tmp_path):
    for name, count in (("a", 700), ("b", 3)):
        (tmp_path / f"{name}.log").write_text("".join(f"{i}\n" for i in range(count)))
    lines = RD.numbered_lines(spark, str(tmp_path))
    assert lines.select("file", "block").distinct().count() > 2
    rows = RD.with_whole_file_numbers(lines)
    assert rows.columns == ["value", "file", "line_no"]
    assert rows.count() == 703 and rows.filter(F.col("value").cast("bigint") != F.col("line_no")).count() == 0


def test_pgn_text_is_not_shuffled(spark, tmp_path, capsys):
    game = lambda i: f'[Event "Rated Blitz game"]\n[White "w{i}"]\n[White "again"]\n[Black "b"]\n\n1. e4 {{ [%clk 0:01:00] }} 1-0\n'
    (tmp_path / "x.pgn").write_text("\n".join(game(i) for i in range(20)))
    games = RD.read_pgn(spark, str(tmp_path / "x.pgn"))
    games.explain()
    assert "hashpartitioning" not in capsys.readouterr().out
    rows = sorted(games.collect(), key=lambda r: r.line_no)
    assert [(r.line_no, r.tags["White"], len(r.tags)) for r in rows] == [(i, f"w{i}", 3) for i in range(20)]
    assert rows[0].movetext == "1. e4 { [%clk 0:01:00] } 1-0"


def test_capped_ranks_are_the_first_of_all_ranks(spark):
    rows = spark.range(3_000).select((F.col("id") % 7).alias("player"), F.col("id").alias("game_id"))
    capped = ordered.hash_sample_ranks(rows, ["player"], ["game_id"], "s", 32, "pos")
    full = ordered.hash_ranks(rows, ["player"], ["game_id"], "s", "pos").filter("pos <= 32")
    assert capped.schema == full.schema and capped.count() == 7 * 32
    assert capped.exceptAll(full).count() == 0


def test_capped_and_uncapped_indexes_agree_below_the_caps(spark):
    games = spark.range(60).select(
        F.col("id").alias("game_id"), F.concat(F.lit("p"), F.col("id") % 9).alias("white"), F.concat(F.lit("p"), (F.col("id") * 5 + 1) % 9).alias("black"),
        F.lit(1500).cast("bigint").alias("white_elo"), F.lit(1600).cast("bigint").alias("black_elo"), (F.col("id") % 3 - 1).cast("bigint").alias("result"),
        F.lit("Blitz").alias("event"), F.lit("2024-01-01").cast("date").alias("played_at"),
    )
    capped, full = G.chain_index(games, 60, 120), G.chain_index(games, None, None)
    for a, b in zip(capped, full):
        key = lambda rows: sorted(map(str, rows.collect()))
        assert key(a) == key(b)
