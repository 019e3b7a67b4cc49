"""Adapters from the driver's star-schema tables to the engine's domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from duelgauge.operators import ordered
from duelgauge.operators.corpus import Bins, elo_bin

CANDIDATES_PER_BIN = 20
BINS_200 = Bins(1000, 2600, 200)


_SCHEMAS: dict[str, StructType] = {}


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A driver table; its schema is read from the files once and then reused."""
    path = f"{sf}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def games(spark: SparkSession, sf: str) -> DataFrame:
    customers = read(spark, sf, "customer").agg(F.count(F.lit(1)).alias("n")).scalar()
    gid, white = F.col("o_orderkey"), F.col("o_custkey")
    base = (
        read(spark, sf, "orders")
        .select(
            gid.alias("game_id"),
            F.to_date("o_orderdate").alias("played_at"),
            white.alias("w"),
            ((white + 1 + gid % 97) % customers).alias("b"),
            F.when(F.col("o_orderpriority") == "5-LOW", "Rapid").otherwise("Blitz").alias("event"),
        )
        .withColumn("we", F.lit(950) + (F.col("w") * 37) % 1700 + F.col("game_id") % 41)
        .withColumn("be", F.lit(950) + (F.col("b") * 37) % 1700 + F.col("game_id") % 43)
    )
    g = F.col("game_id")
    return base.select(
        "game_id",
        "played_at",
        "event",
        F.concat(F.lit("p"), "w").alias("white"),
        F.concat(F.lit("p"), "b").alias("black"),
        F.when(g % 211 == 0, 0).otherwise(F.col("we")).cast("bigint").alias("white_elo"),
        F.col("be").cast("bigint").alias("black_elo"),
        F.when(g % 20 == 0, 0)
        .when(F.col("we") - F.col("be") + (g * 7919) % 1201 - 600 > 0, 1)
        .otherwise(-1)
        .cast("bigint")
        .alias("result"),
        (F.lit(14) + g % 60).cast("bigint").alias("plies"),
        F.when(g % 53 == 0, "custom").alias("fen"),
    )


def moves(spark: SparkSession, sf: str) -> DataFrame:
    """One move per event; a user's events in time order are the plies of one game."""
    events = read(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
    numbered = ordered.row_numbers(events, ["user_id"], ["ts", "event_id"], F.to_date("ts"))
    ply = F.col("rn") - 1
    files = F.lit("abcdefgh")
    letter = lambda i: F.substring(files, (F.lit(1) + i % 8).cast("int"), F.lit(1))
    return numbered.select(
        F.col("user_id").alias("game_id"),
        ply.alias("ply"),
        F.when(ply % 2 == 0, "white").otherwise("black").alias("color"),
        F.concat(
            letter(F.col("event_id")),
            (F.lit(1) + ply % 8).cast("string"),
            letter(F.col("event_id") + ply),
            (F.lit(1) + (ply * 3) % 8).cast("string"),
        ).alias("move"),
        F.greatest(F.lit(600) - ply * 5, F.lit(0)).cast("bigint").alias("clock_s"),
        "event_id",
        "event_type",
        "value",
    )


def move_scores(spark: SparkSession, sf: str) -> DataFrame:
    ply = F.col("ply")
    return moves(spark, sf).select(
        "game_id",
        "ply",
        "color",
        F.when(ply < 20, "opening").when(ply < 45, "midgame").otherwise("endgame").alias("phase"),
        F.concat_ws("/", "event_type", (ply % 8).cast("string")).alias("fen_before"),
        "move",
        (
            ((F.col("game_id") * 37) % 1600 - 800) / F.lit(500.0) + (F.col("value") - 100) / F.lit(503.0)
        ).alias("score"),
    )


def scored_games(spark: SparkSession, sf: str) -> DataFrame:
    """Games of the games table that also have moves."""
    lengths = read(spark, sf, "events").groupBy(F.col("user_id").alias("game_id")).agg(
        F.count(F.lit(1)).alias("n_moves")
    )
    return games(spark, sf).join(lengths, "game_id")


def game_scores(spark: SparkSession, sf: str) -> DataFrame:
    """One score and move count per side, for games whose players share a 200-point bin."""
    g = games(spark, sf)
    low = F.lit(1000) + 200 * elo_bin(F.col("white_elo"), BINS_200)
    same = elo_bin(F.col("white_elo"), BINS_200) == elo_bin(F.col("black_elo"), BINS_200)
    score = lambda side: F.lit(0.002) * (F.col(f"{side}_elo") - 1500) + (
        (F.col("game_id") * 7919 + F.substring(side, 2, 20).cast("bigint") * (31 if side == "white" else 37)) % 1001
        - 500
    ) / F.lit(2503.0)
    return g.filter(same).select(
        "game_id",
        low.alias("low"),
        (low + 200).alias("high"),
        F.col("white_elo").alias("white_rating"),
        F.col("black_elo").alias("black_rating"),
        score("white").alias("white_score"),
        (F.lit(20) + F.col("game_id") % 30).alias("white_moves"),
        score("black").alias("black_score"),
        (F.lit(20) + F.col("game_id") % 30 - F.col("game_id") % 2).alias("black_moves"),
    )


def candidate_scores(spark: SparkSession, sf: str) -> DataFrame:
    """A few games per bin: the rank limit prunes before the shuffle, the corpus is not ranked."""
    return ordered.hash_sample(game_scores(spark, sf), ["low"], ["game_id"], "cand", CANDIDATES_PER_BIN)


def query_scores(spark: SparkSession, sf: str) -> DataFrame:
    chosen = candidate_scores(spark, sf).select("game_id")
    return game_scores(spark, sf).join(chosen, "game_id", "left_anti")


def positions(spark: SparkSession, sf: str) -> DataFrame:
    """Every ply of every game of the games table; some games keep White's moves only."""
    rows = games(spark, sf).select("game_id", F.explode(F.sequence(F.lit(0), F.col("plies") - 1)).alias("ply"))
    side = F.when(F.col("ply") % 2 == 0, "white").otherwise("black")
    return rows.withColumn("color", side).filter(~((F.col("game_id") % 17 == 0) & (F.col("color") == "black")))


def ranked_games(spark: SparkSession, sf: str) -> DataFrame:
    rank = elo_bin(F.col("black_elo"), BINS_200).cast("bigint")
    return games(spark, sf).withColumn("rank", rank).filter("rank IS NOT NULL")


def occupancy(spark: SparkSession, sf: str) -> DataFrame:
    """Pseudo positions: occupancy masks per ply that thin out as a game goes on."""
    mask = lambda name: ordered.hash_int(name, "game_id", "ply")
    settled = F.col("ply") < F.lit(10) + F.col("game_id") % 20
    thin = F.when(F.col("ply") >= F.lit(35) + F.col("game_id") % 30, mask("t")).otherwise(F.lit(-1))
    white = mask("a").bitwiseAND(mask("b")).bitwiseAND(mask("c")).bitwiseAND(thin).bitwiseOR(
        F.when(settled, F.lit(255)).otherwise(F.lit(15)).cast("bigint")
    )
    top = F.when(settled, F.lit(-(1 << 56))).otherwise(F.lit(15 << 56)).cast("bigint")
    black = mask("d").bitwiseAND(mask("e")).bitwiseAND(mask("f")).bitwiseAND(thin).bitwiseOR(top)
    rows = moves(spark, sf).select("game_id", "ply", white.alias("white"), black.alias("b0"))
    black_only = F.col("b0").bitwiseAND(F.bitwise_not(F.col("white")))
    return rows.select(
        "game_id",
        "ply",
        "white",
        black_only.alias("black"),
        F.lit(1 << 4).cast("bigint").alias("kings"),
        F.col("white").bitwiseOR(black_only).bitwiseAND(mask("g")).bitwiseAND(mask("h")).alias("pawns"),
    )


def replay_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rewards, values, life losses, actions and visit texts from events."""
    e = F.col("event_id")
    cast = lambda c: c.cast("string")
    visits = F.concat_ws(
        ",", F.concat_ws(":", cast(e % 9), cast(F.lit(1) + e % 5)), F.concat_ws(":", cast((e + 3) % 9), cast(F.lit(2) + e % 3))
    )
    return moves(spark, sf).select(
        "game_id",
        "ply",
        "event_id",
        (e % 9).alias("action"),
        F.when(e % 7 == 0, "").otherwise(visits).alias("visits"),
        (F.col("value") / 10.3).alias("reward"),
        (F.col("value") / 3.1).alias("value"),
        F.when(F.col("event_type") == "error", e % 3).alias("lives"),
    )
