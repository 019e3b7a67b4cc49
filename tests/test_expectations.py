"""Hand-checked values of the rules the engine must keep."""

import pytest
from pyspark.sql import functions as F

from duelgauge.functions import board as B
from duelgauge.functions import rating as R
from duelgauge.functions import records as T
from duelgauge.functions import targets as V
from duelgauge.operators import boundaries as D
from duelgauge.operators import calibration as K
from duelgauge.operators import corpus as C
from duelgauge.operators import phases as PH
from duelgauge.operators import scoring as S
from duelgauge.operators import selfplay as SP

BINS_100 = C.Bins(1000, 2600, 100)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


EDGES = [
    (1000, 1000, 0, None),
    (1099, 1000, 0, None),
    (1099, 1100, None, "players_in_different_bins"),
    (1100, 1100, 1, None),
    (2599, 2500, 15, None),
    (999, 1000, None, "rating_out_of_range"),
    (2600, 2599, None, "rating_out_of_range"),
    (0, 1500, None, "missing_rating"),
]


def test_bin_edges_and_first_failing_reason(spark):
    rows = spark.createDataFrame([(w, b) for w, b, *_ in EDGES], "white_elo int, black_elo int")
    got = {(r.white_elo, r.black_elo): (r.bin, r.reason) for r in C.classify(rows, BINS_100).collect()}
    assert got == {(w, b): (bin_, reason) for w, b, bin_, reason in EDGES}


def test_held_out_record_is_found_despite_white_space(spark):
    rows = spark.createDataFrame([(1, " game A\n"), (2, "game B")], "id int, line string").withColumn("digest", C.digest(F.col("line")))
    held = spark.createDataFrame([("game A",)], "line string").select(C.digest(F.col("line")).alias("digest"))
    assert [r.id for r in C.exclude_held_out(rows, held).collect()] == [2]


def test_closed_policy_range_and_event(spark):
    rows = spark.createDataFrame(
        [("Blitz", 1000, 3000), ("Blitz", 999, 1500), ("Rapid", 0, 0), ("Blitz", 0, 1500)], "event string, white_elo int, black_elo int"
    )
    got = [r.r for r in rows.select(C.policy_reason(C.ContextPolicy()).alias("r")).collect()]
    assert got == [None, "rating_out_of_range", "unsupported_event", "missing_rating"]


@pytest.mark.parametrize("plies, white, black", [(9, 5, 4), (10, 5, 5), (0, 0, 0)])
def test_moves_per_side(spark, plies, white, black):
    assert value(spark, R.color_move_count(F.lit(plies), "white")) == white
    assert value(spark, R.color_move_count(F.lit(plies), "black")) == black


TWO = [(1000, 1200, 1100.0, -1.0), (1200, 1400, 1300.0, 1.0)]
THREE = TWO + [(1400, 1600, 1500.0, 2.0)]


@pytest.mark.parametrize(
    "buckets, score, elo, status, nearest",
    [
        (TWO, 0.0, 1200.0, "interpolated", "1000-1200"),
        (THREE, -2.0, 1000.0, "extrapolated_below", "1000-1200"),
        (THREE, 3.0, 1700.0, "extrapolated_above", "1400-1600"),
        (THREE, 1.0, 1300.0, "interpolated", "1200-1400"),
    ],
)
def test_interpolation_and_extrapolation(spark, buckets, score, elo, status, nearest):
    calibration = spark.createDataFrame(buckets, "low int, high int, center double, mean_score double")
    row = K.with_estimate(spark.createDataFrame([(score,)], "mean_score double"), calibration).first()
    assert (row.estimated_elo, row.estimate_status, row.nearest_bucket) == (elo, status, nearest)


def test_equal_bucket_means_are_an_error(spark):
    flat = spark.createDataFrame([(0, 1, 0.5, 1.0), (1, 2, 1.5, 1.0)], "low int, high int, center double, mean_score double")
    with pytest.raises(Exception, match="equal means"):
        K.with_estimate(spark.createDataFrame([(1.0,)], "mean_score double"), flat).collect()


def test_weighted_player_mean_and_median(spark):
    rows = spark.createDataFrame(
        [("a", 1.0, 10, 1200, None), ("a", 0.0, 30, 1234, None), ("a", 9.0, 5, 1300, "too_short")],
        "player string, score double, moves int, rating int, problem string",
    )
    row = K.player_report(rows).first()
    assert (row.matched_games, row.analyzed_games, row.moves, row.mean_score, row.median_recorded_rating) == (3, 2, 40, 0.25, 1234.0)


def test_castling_reaches_the_known_position():
    board = bytearray(S.START)
    for ply, move in enumerate("e2e4 e7e5 g1f3 b8c6 f1c4 g8f6 e1h1 f8c5 d2d3 e8h8".split()):
        assert S.apply_move(board, move, ply % 2 == 0)
    ranks = [board[8 * r : 8 * r + 8].decode() for r in range(7, -1, -1)]
    assert ranks == ["r bq rk ", "pppp ppp", "  n  n  ", "  b p   ", "  B P   ", "   P N  ", "PPP  PPP", "RNBQ RK "]


def test_en_passant_promotion_and_wrong_side():
    board = bytearray(b" " * 64)
    board[S._square("e5")], board[S._square("d5")] = ord("P"), ord("p")
    assert S.apply_move(board, "e5d6", True) and board[S._square("d5")] == ord(" ")
    for suffix, piece in (("", "N"), ("q", "Q")):
        board[S._square("a7")] = ord("P")
        assert S.apply_move(board, "a7a8" + suffix, True) and board[S._square("a8")] == ord(piece)
    assert not S.apply_move(board, "a8a7", False)
    assert not S.apply_move(board, "h4h5", True)


def placed(text):
    """Masks of a position given as ranks from the eighth down."""
    board = bytearray(b" " * 64)
    for row, rank in enumerate(text.split("/")):
        file = 0
        for c in rank:
            if c.isdigit():
                file += int(c)
            else:
                board[8 * (7 - row) + file] = ord(c)
                file += 1
    return {k: int(v[0]) for k, v in S._masks([bytes(board)]).items()}


START = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR"
KINGS = "4k3/8/8/8/8/8/8/4K3"
MIDDLE = "rnbqk3/8/8/8/8/8/8/RNBQK3"
END = "r2qk3/8/8/8/8/8/8/R2QK3"


@pytest.mark.parametrize(
    "boards, middle, end",
    [([START], None, None), ([START, KINGS], None, 1), ([START, MIDDLE, END], 1, 2), ([START, MIDDLE], 1, None)],
)
def test_phase_starts(spark, boards, middle, end):
    rows = [(1, ply, m["white"], m["black"], m["kings"], m["pawns"]) for ply, m in enumerate(map(placed, boards))]
    df = spark.createDataFrame(rows, "game_id bigint, ply bigint, white bigint, black bigint, kings bigint, pawns bigint")
    row = D.phase_starts(df).first()
    assert (row.middle, row.end) == (middle, end)


def test_mixedness_counts_regions(spark):
    m = placed(START)
    # two full ranks per side: seven regions of four own pieces, seven of two, on either side
    white_home = sum(B.REGION_WORTH[(4, 0)][r] for r in (0,)) * 7 + B.REGION_WORTH[(2, 0)][1] * 7
    black_home = B.REGION_WORTH[(0, 4)][6] * 7 + B.REGION_WORTH[(0, 2)][5] * 7
    got = value(spark, B.mixedness(F.lit(m["white"]).cast("bigint"), F.lit(m["black"]).cast("bigint")))
    assert got == white_home + black_home


@pytest.mark.parametrize(
    "moves, middle, end, want",
    [
        (10, 4, 8, [("opening", 0, 4), ("midgame", 4, 8), ("endgame", 8, 10)]),
        (10, None, None, [("opening", 0, 10)]),
        (10, 4, None, [("opening", 0, 4), ("midgame", 4, 10)]),
        (10, None, 6, [("opening", 0, 6), ("endgame", 6, 10)]),
        (10, 0, 5, [("midgame", 0, 5), ("endgame", 5, 10)]),
    ],
)
def test_phase_ranges_partition_the_game(spark, moves, middle, end, want):
    lit = lambda x: F.lit(x).cast("bigint")
    got = value(spark, D.phase_ranges(lit(moves), lit(middle), lit(end)))
    assert [tuple(r) for r in got] == want


@pytest.mark.parametrize(
    "middle, end, want",
    [("4", "8", "ok"), ("-1", "-1", "ok"), ("-1", "8", "invalid"), ("8", "4", "invalid"), ("", "3", "missing"), ("10", "-1", "invalid"), ("x", "1", "invalid")],
)
def test_phase_tag_status(spark, middle, end, want):
    assert value(spark, D.tag_status(F.lit(middle), F.lit(end), F.lit(10))) == want


def test_phase_tags_sit_before_the_first_move(spark):
    record = "(;GM[chess]WR[1500]BR[1500];B[e2e4];W[e7e5])"
    lit = lambda x: F.lit(x).cast("bigint")
    tagged = value(spark, T.insert_phase_tags(F.lit(record), lit(None), lit(7)))
    assert tagged == "(;GM[chess]WR[1500]BR[1500]PM[-1]PE[7];B[e2e4];W[e7e5])"


def test_centering_keeps_the_mean(spark):
    rated = spark.createDataFrame([("opening", 1700.0), ("midgame", 1500.0), ("endgame", 1300.0)], "phase string, estimated_elo double")
    reference = spark.createDataFrame([("opening", 1800.0, 1500.0), ("midgame", 1500.0, 1500.0), ("endgame", 1200.0, 1500.0)], "phase string, phase_elo double, mean_elo double")
    got = PH.shift_by_reference(rated, reference).agg(F.avg("phase_norm_elo")).first()[0]
    assert got == pytest.approx(1500.0)
    odd = spark.createDataFrame([("overtime", 1.0)], "phase string, estimated_elo double")
    with pytest.raises(Exception, match="phase missing"):
        PH.shift_by_reference(odd, reference).collect()


def test_probability_ties_prefer_white_then_draw(spark):
    assert value(spark, R.strength_to_probs(F.lit(0.0), F.lit(0.0), 0.0))["predicted"] == 1
    assert value(spark, R.strength_to_probs(F.lit(0.0), F.lit(0.0), 0.5))["predicted"] == 0
    assert value(spark, R.elo_to_probs(F.lit(1500.0), F.lit(1900.0), 0.0))["p_white"] == pytest.approx(1 / 11)


@pytest.mark.parametrize("rate, step", [(1.0, 1000.0), (0.0, -1000.0), (0.5, 0.0), (0.75, 190.849), (1e-9, -1000.0)])
def test_step_elo(spark, rate, step):
    assert round(value(spark, SP.step_elo(F.lit(rate))), 3) + 0.0 == step


@pytest.mark.parametrize("x", [-300.0, -1.5, 0.0, 0.25, 2.0, 299.5])
def test_rescale_round_trip_and_two_hot_mean(spark, x):
    assert value(spark, V.invert_rescale(V.rescale(F.lit(x)))) == pytest.approx(x, abs=1e-6)
    vector = V.two_hot(F.lit(x), 601)
    assert value(spark, V.expected_value(vector, 601)) == pytest.approx(x, abs=1e-9)


def test_symmetries_are_distinct_permutations(spark):
    rows = spark.range(9).select("id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("s"))
    got = rows.select("id", "s", B.symmetric_index(F.col("id"), F.col("s"), 3).alias("to")).collect()
    maps = {}
    for r in got:
        maps.setdefault(r.s, {})[r.id] = int(r.to)
    assert len({tuple(m[i] for i in range(9)) for m in maps.values()}) == 8
    assert all(sorted(m.values()) == list(range(9)) for m in maps.values())


def test_clock_tags_prefix_and_tail(spark):
    record = F.lit("(;GM[chess]PW[a];B[e2e4]TM[300];W[e7e5]TM[299];B[g1f3])")
    assert value(spark, T.clock_seconds(F.lit("1:02:03"))) == 3723
    assert value(spark, T.prefix(record, 2)) == "(;GM[chess]PW[a];B[e2e4]TM[300];W[e7e5]TM[299])"
    assert value(spark, T.last_moves(record, 1)) == "(;GM[chess]PW[a];B[g1f3])"
    assert value(spark, T.last_moves(record, 9)) == "(;GM[chess]PW[a];B[e2e4]TM[300];W[e7e5]TM[299];B[g1f3])"
    with pytest.raises(Exception, match="more plies"):
        value(spark, T.prefix(record, 4))
