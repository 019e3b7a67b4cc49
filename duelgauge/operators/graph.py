"""Win graph: an index of edges and games per player, simple paths, training games, chain statistics."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duelgauge.operators import ordered
from duelgauge.operators.corpus import sides
from duelgauge.runtime import cut_lineage, shuffle_width

MAX_OUT_EDGES = 16
MAX_GAMES_PER_PLAYER = 32
ROUND_ATTEMPTS = 25_000  # of one round; its open paths are sent to every task, at about 1 KB each
EDGE = "array<struct<game_id: bigint, winner_elo: bigint, loser_elo: bigint, winner_pos: bigint, loser_pos: bigint>>"
PICK = "array<struct<game_id: bigint, color: string, opponent: string, opponent_pos: bigint>>"


class ChainIndex(NamedTuple):
    """Stored adjacency: every edge of a winner and every game of a player has a position, 1 up to their number.

    A uniform draw is a lookup of one (player, position), so no list of edges or games is ever gathered, whatever a
    player's number of them. What a draw must leave out is known as positions, too, and skipped by counting.
    """

    edges: DataFrame  # winner, pos, loser, game_id, both ratings, both positions of the game
    players: DataFrame  # player, degree (number of edges), listed (number of games)
    games: DataFrame  # player, pos, game_id, color, opponent, opponent_pos
    starters: DataFrame  # pick, winner, degree, listed


def chain_index(games: DataFrame, edge_cap: int | None = MAX_OUT_EDGES, game_cap: int | None = MAX_GAMES_PER_PLAYER, seed: str = "chain") -> ChainIndex:
    """The index of all games; caps keep a uniform sample of a player's wins or games (None: all of them)."""
    appearances = sides(games).select("player", "game_id", "color")
    if game_cap is None:
        ranked = cut_lineage(ordered.hash_ranks(appearances, ["player"], ["game_id", "color"], "reservoir", "pos"))
    else:
        ranked = cut_lineage(ordered.hash_sample_ranks(appearances, ["player"], ["game_id", "color"], "reservoir", game_cap, "pos"))
    at = lambda color: ranked.filter(F.col("color") == color).select("game_id", F.col("pos").alias(f"{color}_pos"))
    both = cut_lineage(
        games.select("game_id", "white", "black", "white_elo", "black_elo", "result").join(at("white"), "game_id", "left").join(at("black"), "game_id", "left")
    )

    def listed(own: str, other: str) -> DataFrame:
        kept = both.filter(F.col(f"{own}_pos").isNotNull())
        columns = [F.col(own).alias("player"), F.col(f"{own}_pos").alias("pos"), "game_id", F.lit(own).alias("color")]
        return kept.select(*columns, F.col(other).alias("opponent"), F.col(f"{other}_pos").alias("opponent_pos"))

    game_rows = listed("white", "black").unionByName(listed("black", "white"))
    won = F.col("result") > 0
    pick = lambda a, b: F.when(won, F.col(a)).otherwise(F.col(b))
    edges = both.filter("result != 0").select(
        pick("white", "black").alias("winner"),
        pick("black", "white").alias("loser"),
        "game_id",
        pick("white_elo", "black_elo").alias("winner_elo"),
        pick("black_elo", "white_elo").alias("loser_elo"),
        pick("white_pos", "black_pos").alias("winner_pos"),
        pick("black_pos", "white_pos").alias("loser_pos"),
    )
    if edge_cap is not None:
        edges = ordered.hash_sample(edges, ["winner"], ["game_id"], "edges", edge_cap)
    # Edges to one opponent are neighbours: order by opponent (in hash order), then game.
    hashed = edges.withColumn("_hash", ordered.hash_text("index", "loser"))
    place = ["_hash", "loser", "game_id"]
    if edge_cap is None:
        placed = ordered.row_numbers(hashed, ["winner"], place, F.substring("_hash", 1, 3), "pos")
    else:  # a capped list is short, and the cap has put it in one task already
        placed = hashed.withColumn("pos", F.row_number().over(W.partitionBy("winner").orderBy(*place)).cast("bigint"))
    placed = cut_lineage(placed.drop("_hash"))
    degrees = placed.groupBy(F.col("winner").alias("player")).agg(F.count(F.lit(1)).alias("degree"))
    lists = ranked.groupBy("player").agg(F.count(F.lit(1)).alias("listed"))
    players = cut_lineage(degrees.join(lists, "player", "full").select("player", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("degree", "listed")]))
    starters = players.filter("degree > 0").withColumnRenamed("player", "winner")
    return ChainIndex(
        placed,
        players,
        game_rows,
        cut_lineage(ordered.hash_ranks(starters, [], ["winner"], f"{seed}-starters", "pick")),
    )


def chain_seeds(index: ChainIndex, begin: int, end: int, seed: str = "chain") -> DataFrame:
    """Uniform starters of the attempts begin to end - 1, among the players with an outgoing edge."""
    starters = index.starters
    total = starters.agg(F.count(F.lit(1)).alias("n")).scalar()
    spark = starters.sparkSession
    tries = spark.range(begin, end, 1, shuffle_width(spark)).withColumnRenamed("id", "attempt")
    drawn = tries.withColumn("pick", ordered.hash_int(seed, "attempt") % total + 1)
    return drawn.join(starters, "pick").select("attempt", F.col("winner").alias("start"), "degree", "listed")


def _skipping(drawn: Column, gone: Column) -> Column:
    """Position of the `drawn`-th element, counting past the positions in `gone` (sorted structs of first, n)."""
    return F.aggregate(gone, drawn, lambda at, g: F.when(at >= g["first"], at + g["n"]).otherwise(at))


def _asked(rows: DataFrame, few: bool) -> DataFrame:
    """Rows that look up the index: few are sent to where the index is read, so that it is not shuffled for them."""
    return F.broadcast(rows) if few else rows


def sample_paths(seeds: DataFrame, index: ChainIndex, length: int, seed: str) -> DataFrame:
    """Simple paths of `length` players, strong to weak: each hop draws uniformly among the edges to unused players.

    The edges back to the players of the path are looked up by pair and their positions, which are neighbours, left out
    of the draw, so a draw never fails and a path without a usable edge is dropped at once. The paths are stored after each hop.
    """
    paths = cut_lineage(seeds.select(
        "attempt", F.col("start").alias("at"), "degree", F.array("start").alias("players"), F.array("listed").alias("listed"), F.expr(f"cast(array() as {EDGE})").alias("edges")
    ))
    few = paths.count() <= ROUND_ATTEMPTS
    nothing = F.expr("cast(array() as array<struct<first: bigint, n: bigint>>)")
    reached = index.players.select(F.col("player").alias("loser"), F.col("degree").alias("loser_degree"), F.col("listed").alias("loser_listed"))
    for hop in range(1, length):
        used = paths.select("attempt", F.col("at").alias("winner"), F.explode("players").alias("loser"))
        pairs = _asked(used, few).join(index.edges.select("winner", "loser", "pos"), ["winner", "loser"]).groupBy("attempt", "loser").agg(
            F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")
        )
        back = pairs.groupBy("attempt").agg(F.sort_array(F.collect_list(F.struct("first", "n"))).alias("gone"), F.sum("n").alias("lost"))
        aimed = paths.join(back, "attempt", "left").withColumn("free", F.col("degree") - F.coalesce("lost", F.lit(0))).filter("free > 0")
        drawn = ordered.hash_int(seed, "attempt", F.lit(hop)) % F.col("free") + 1
        aimed = aimed.select("attempt", "players", "listed", "edges", F.col("at").alias("winner"), _skipping(drawn, F.coalesce("gone", nothing)).alias("pos"))
        taken = _asked(aimed, few).join(index.edges, ["winner", "pos"])
        edge = F.struct("game_id", "winner_elo", "loser_elo", "winner_pos", "loser_pos")
        taken = taken.select("attempt", "loser", F.array_append("players", F.col("loser")).alias("players"), "listed", F.array_append("edges", edge).alias("edges"))
        paths = cut_lineage(
            _asked(taken, few).join(reached, "loser").select(
                "attempt",
                F.col("loser").alias("at"),
                F.col("loser_degree").alias("degree"),
                "players",
                F.array_append("listed", F.col("loser_listed")).alias("listed"),
                "edges",
            )
        )
    return paths.drop("at", "degree")


def weak_to_strong(paths: DataFrame) -> DataFrame:
    return paths.select("attempt", *[F.reverse(c).alias(c) for c in ("players", "listed", "edges")])


def pick_training_games(chains: DataFrame, index: ChainIndex, length: int, seed: str = "train") -> DataFrame:
    """For every slot, weak to strong, a uniform game of its player that is neither an edge nor taken before.

    Only two edges can be games of a slot's player, and a game taken before only if the player was the opponent in it; all three
    carry their position among the player's games, so a slot is one lookup. A chain with an empty slot is dropped.
    """
    few = chains.count() <= ROUND_ATTEMPTS
    chains = chains.withColumn("training", F.expr(f"cast(array() as {PICK})"))
    for slot in range(length):
        own = F.col("players")[slot]
        barred = F.transform(F.filter("training", lambda t: t["opponent"] == own), lambda t: t["opponent_pos"])
        if slot < length - 1:
            barred = F.array_append(barred, F.col("edges")[slot]["loser_pos"])
        if slot > 0:
            barred = F.array_append(barred, F.col("edges")[slot - 1]["winner_pos"])
        known = F.array_sort(F.array_distinct(F.filter(barred, lambda p: p.isNotNull())))
        aimed = chains.withColumn("_gone", F.transform(known, lambda p: F.struct(p.alias("first"), F.lit(1).cast("bigint").alias("n"))))
        aimed = aimed.withColumn("_free", F.col("listed")[slot] - F.size("_gone")).filter("_free > 0")
        drawn = ordered.hash_int(seed, "attempt", F.lit(slot)) % F.col("_free") + 1
        aimed = aimed.withColumn("player", own).withColumn("pos", _skipping(drawn, F.col("_gone"))).drop("_gone", "_free")
        taken = _asked(aimed, few).join(index.games, ["player", "pos"])
        pick = F.struct("game_id", "color", "opponent", "opponent_pos")
        chains = taken.select("attempt", "players", "listed", "edges", F.array_append("training", pick).alias("training"))
    return chains.drop("listed")


def sample_chains(index: ChainIndex, length: int, attempts: int, max_chains: int, seed: str = "chain", rate: float = 0.5) -> DataFrame:
    """Accepted chains, stored: all of the attempts 0 up to the one that completes `max_chains`, or all `attempts`.

    Attempts are made in rounds of as many as the success rate so far (`rate` at first) lets expect to be enough, and no
    more than ROUND_ATTEMPTS; the result does not depend on the rounds. A round may accept more than are asked for; see keep_first.
    """
    made: DataFrame | None = None
    begin, have = 0, 0
    while begin < attempts and (made is None or have < max_chains):
        end = min(attempts, begin + min(ROUND_ATTEMPTS, max(1_000, int(1.05 * (max_chains - have) / rate))))
        paths = sample_paths(chain_seeds(index, begin, end, seed), index, length, seed)
        found = cut_lineage(pick_training_games(weak_to_strong(paths), index, length))
        have += found.count()
        made = found if made is None else made.unionByName(found)
        begin, rate = end, max(have / end, 0.01)
    if made is None:
        raise ValueError("no attempts asked for")
    return made


def keep_first(chains: DataFrame, max_chains: int) -> DataFrame:
    """The first accepted chains in attempt order, by their number within blocks of attempts."""
    numbered = ordered.row_numbers(chains, [], ["attempt"], ordered.id_levels(F.col("attempt")), "_nth")
    return numbered.filter(F.col("_nth") <= max_chains).drop("_nth")


def chain_slots(chains: DataFrame) -> DataFrame:
    """One row per slot with its player, training game and edge rating.

    Slot 0 takes the loser's rating on the first edge, every later slot the winner's rating on the
    edge below it.
    """
    rated = F.concat(
        F.transform(F.slice("edges", 1, 1), lambda e: e["loser_elo"]), F.transform("edges", lambda e: e["winner_elo"])
    )
    rows = chains.select(
        "attempt", F.posexplode(F.arrays_zip("players", F.col("training"), rated.alias("elo"))).alias("slot", "s")
    )
    return rows.select(
        "attempt",
        "slot",
        F.col("s.players").alias("player"),
        F.col("s.training.game_id").alias("game_id"),
        F.col("s.training.color").alias("color"),
        F.col("s.elo").alias("elo"),
    )


def chain_edges(chains: DataFrame) -> DataFrame:
    """Weak-to-strong rating difference of every edge."""
    rows = chains.select("attempt", F.posexplode("edges").alias("link", "e"))
    return rows.select(
        "attempt",
        "link",
        F.col("e.game_id").alias("game_id"),
        F.col("e.loser_elo").alias("src_elo"),
        F.col("e.winner_elo").alias("dest_elo"),
        (F.col("e.winner_elo") - F.col("e.loser_elo")).alias("diff"),
    )


def relative_elo(slots: DataFrame) -> DataFrame:
    """Mean and sample deviation of the rating relative to slot 0, per slot (slots per chain are few)."""
    base = F.first("elo").over(W.partitionBy("attempt").orderBy("slot"))
    return slots.withColumn("_rel", F.col("elo") - base).groupBy("slot").agg(
        F.avg("_rel").alias("mean"), F.coalesce(F.stddev_samp("_rel"), F.lit(0.0)).alias("sd"), F.count(F.lit(1)).alias("n")
    )


def color_balance(slots: DataFrame) -> DataFrame:
    share = F.avg((F.col("color") == "white").cast("double"))
    return slots.groupBy("slot").agg(
        share.alias("p_white"), F.sqrt(share * (1 - share) / F.count(F.lit(1))).alias("se"), F.count(F.lit(1)).alias("n")
    )


def sampling_yield(chains: DataFrame, attempts: int, max_chains: int) -> DataFrame:
    """Attempts stop counting at the attempt that fills the quota."""
    kept = keep_first(chains.select("attempt"), max_chains)
    counted = kept.agg(F.count(F.lit(1)).alias("chains"), F.max("attempt").alias("last"))
    tried = F.when(F.col("chains") >= max_chains, F.col("last") + 1).otherwise(F.lit(attempts)).cast("bigint")
    return counted.select(
        "chains",
        tried.alias("attempts"),
        (F.col("chains") / tried).alias("success_rate"),
        (F.lit(max_chains) - F.col("chains")).cast("bigint").alias("shortfall"),
    )


def moments(df: DataFrame, value: Column, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(value).alias("n"),
        F.sum(value).alias("sum"),
        F.sum(value * value).alias("sum_sq"),
        F.avg(value).alias("mean"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"),
    )


def fixed_histogram(df: DataFrame, value: Column, lo: float, hi: float, bins: int) -> DataFrame:
    """Counts per bin with underflow in bin 0 and overflow in bin n+1; every bin has a row."""
    slot = (
        F.when(value < lo, F.lit(0))
        .when(value >= hi, F.lit(bins + 1))
        .otherwise(F.least(F.floor((value - lo) / (hi - lo) * bins), F.lit(bins - 1)) + 1)
        .cast("bigint")
    )
    counted = df.groupBy(slot.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spark = df.sparkSession
    listed = spark.range(bins + 2).withColumnRenamed("id", "bin")
    return listed.join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def lorenz_steps(appearances: DataFrame) -> DataFrame:
    """Players sorted by count, folded to one row per distinct count (`n`, players, cumulative sums).

    Distinct counts are at most about the square root of twice the games, so the ordered window over
    them stays small however many players there are.
    """
    by_count = appearances.groupBy("n").agg(F.count(F.lit(1)).alias("players"))
    upto = W.partitionBy(F.lit(0)).orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    return by_count.select(
        "n",
        "players",
        F.sum("players").over(upto).alias("cum_players"),
        F.sum(F.col("n") * F.col("players")).over(upto).alias("cum_games"),
    )


def lorenz_curve(appearances: DataFrame) -> DataFrame:
    steps = lorenz_steps(appearances)
    totals = appearances.agg(F.count(F.lit(1)).alias("players"), F.sum("n").alias("games"))
    held = steps.withColumn("_t", totals.select(F.struct("players", "games").alias("v")).scalar())
    return held.select(
        "n",
        (F.col("cum_players") / F.col("_t.players")).alias("player_share"),
        (F.col("cum_games") / F.col("_t.games")).alias("game_share"),
    )


def concentration(appearances: DataFrame) -> DataFrame:
    """Gini coefficient and the shares of the top 1 % and 10 % of players, from the folded curve.

    Within a run of equal counts the ranks are consecutive, so the rank sum has a closed form and
    the cumulative count at any rank is linear.
    """
    steps = lorenz_steps(appearances)
    totals = appearances.agg(F.count(F.lit(1)).alias("players"), F.sum("n").alias("games"))
    held = steps.withColumn("_t", totals.select(F.struct("players", "games").alias("v")).scalar())
    first = F.col("cum_players") - F.col("players") + 1
    rank_sum = (first + F.col("cum_players")) * F.col("players") / 2
    size, total = F.max("_t.players"), F.max("_t.games")

    def held_at(share: float) -> Column:
        rank = F.floor(F.col("_t.players") * share)
        inside = rank.between(first - 1, F.col("cum_players"))
        below = F.col("cum_games") - F.col("n") * F.col("players")
        return F.max(F.when(inside, below + F.col("n") * (rank - first + 1)))

    return held.agg(
        size.alias("players"),
        total.alias("games"),
        (2 * F.sum(rank_sum * F.col("n")) / (size * total) - (size + 1) / size).alias("gini"),
        (100 - held_at(0.99) / total * 100).alias("share_top1"),
        (100 - held_at(0.90) / total * 100).alias("share_top10"),
    )


def stride_chains(slots: DataFrame, stride: int) -> DataFrame:
    """Every stride-th slot, renumbered; chains left with fewer than two slots are dropped."""
    kept = slots.filter(F.col("slot") % stride == 0).withColumn("slot", F.floor(F.col("slot") / stride))
    size = kept.groupBy("attempt").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= 2)
    return kept.join(size.select("attempt"), "attempt", "left_semi")


def length_histogram(slots: DataFrame) -> DataFrame:
    sizes = slots.groupBy("attempt").agg(F.count(F.lit(1)).alias("length"))
    return sizes.groupBy("length").agg(F.count(F.lit(1)).alias("chains"))


def dense_by_first_use(slots: DataFrame) -> DataFrame:
    """Dense game ids in the order (attempt, slot) of first use: (game_id, idx)."""
    first = slots.groupBy("game_id").agg(F.min(F.struct("attempt", "slot")).alias("_first"))
    spread = first.select("game_id", F.col("_first.attempt").alias("_a"), F.col("_first.slot").alias("_s"))
    ranked = ordered.row_numbers(spread, [], ["_a", "_s"], ordered.id_levels(F.col("_a")), "idx")
    return ranked.select("game_id", (F.col("idx") - 1).alias("idx"))


def dense_by_old_id(slots: DataFrame) -> DataFrame:
    """Dense game ids in ascending order of the old id: (game_id, idx)."""
    used = slots.select("game_id").distinct()
    ranked = ordered.row_numbers(used, [], ["game_id"], ordered.id_levels(F.col("game_id")), "idx")
    return ranked.select("game_id", (F.col("idx") - 1).alias("idx"))


def missing_games(slots: DataFrame, games: DataFrame) -> DataFrame:
    return slots.select("game_id").distinct().join(games.select("game_id"), "game_id", "left_anti")


def chain_lines(slots: DataFrame, ids: DataFrame) -> DataFrame:
    """Text form of every chain: `idx:W idx:B …`, weakest first."""
    token = F.concat_ws(":", F.col("idx").cast("string"), F.when(F.col("color") == "white", "W").otherwise("B"))
    joined = slots.join(ids, "game_id").select("attempt", F.struct("slot", token.alias("t")).alias("s"))
    ordered_tokens = F.transform(F.sort_array(F.collect_list("s")), lambda s: s["t"])
    return joined.groupBy("attempt").agg(F.concat_ws(" ", ordered_tokens).alias("value"))


def parse_chain_lines(lines: DataFrame) -> DataFrame:
    """Text chains to slots; one bad token rejects the whole chain."""
    token = F.posexplode(F.split(F.trim("value"), r"\s+"))
    rows = lines.filter(F.length(F.trim("value")) > 0).select("attempt", token.alias("slot", "token"))
    parsed = rows.select(
        "attempt",
        "slot",
        F.regexp_extract("token", r"^(\d+):[WBwb]", 1).try_cast("bigint").alias("game_id"),
        F.upper(F.regexp_extract("token", r"^\d+:([WBwb])", 1)).alias("color"),
    )
    good = parsed.groupBy("attempt").agg(F.bool_and(F.col("game_id").isNotNull()).alias("_ok")).filter("_ok")
    return parsed.join(good.select("attempt"), "attempt", "left_semi")
