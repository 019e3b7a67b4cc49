"""Registered queries: filters, bins, sampling, held-out joins, player activity."""

from pyspark.sql import functions as F

from duelgauge import fixtures as fx
from duelgauge.operators import corpus as C
from duelgauge.plans.registry import query, table

BINS = fx.BINS_200
POLICY = C.ContextPolicy()

table("held_out", "games", "SELECT md5(CAST(game_id AS VARCHAR)) AS digest FROM games WHERE md5('held:' || game_id) < '2'")
table("classified", "binned held_out", """
 SELECT *, CASE WHEN white_elo <= 0 OR black_elo <= 0 THEN 'missing_rating'
   WHEN wbin IS NULL OR bbin IS NULL THEN 'rating_out_of_range'
   WHEN wbin <> bbin THEN 'players_in_different_bins'
   WHEN md5(CAST(game_id AS VARCHAR)) IN (SELECT digest FROM held_out) THEN 'held_out_game' END AS reason FROM binned""")
table("policy", "games", """
 SELECT *, CASE WHEN event NOT IN ('Blitz') THEN 'unsupported_event' WHEN white_elo <= 0 OR black_elo <= 0 THEN 'missing_rating'
   WHEN white_elo < 1000 OR white_elo > 3000 OR black_elo < 1000 OR black_elo > 3000 THEN 'rating_out_of_range' END AS reason FROM games""")


def with_digest(games):
    return games.withColumn("digest", C.digest(F.concat(F.lit(" "), F.col("game_id").cast("string"), F.lit(" "))))


def held_out(spark, sf):
    picked = fx.games(spark, sf).filter(F.md5(F.concat(F.lit("held:"), F.col("game_id").cast("string"))) < "2")
    return with_digest(picked).select("digest")


def classified(spark, sf):
    flagged = C.flag_held_out(with_digest(fx.games(spark, sf)), held_out(spark, sf))
    return C.classify(flagged, BINS, F.col("held_out"))


def sides(spark, sf, *keep):
    return C.sides(fx.games(spark, sf), *(keep or ("played_at", "event")))


@query("flt_01_elo_bin", "binned", "SELECT game_id, coalesce(wbin, -1) AS wbin, coalesce(bbin, -1) AS bbin FROM binned")
def _(spark, sf):
    return fx.games(spark, sf).select(
        "game_id",
        *[F.coalesce(C.elo_bin(F.col(f"{s}_elo"), BINS), F.lit(-1)).cast("bigint").alias(f"{s[0]}bin") for s in ("white", "black")],
    )


@query("flt_02_classify", "classified", """
SELECT game_id, coalesce(reason, 'ok') AS reason, CASE WHEN reason IS NULL THEN wbin ELSE -1 END AS bin FROM classified""")
def _(spark, sf):
    return classified(spark, sf).select(
        "game_id", F.coalesce("reason", F.lit("ok")).alias("reason"), F.coalesce("bin", F.lit(-1)).cast("bigint").alias("bin")
    )


@query("flt_03_compare_interval", "binned", """
SELECT count(*) AS games, count(*) FILTER (wbin = bbin) AS kept,
  count(*) FILTER (wbin IS NOT NULL AND bbin IS NOT NULL AND floor((white_elo - 1000) / 100.0) = floor((black_elo - 1000) / 100.0)) AS kept_at_compare_interval FROM binned""")
def _(spark, sf):
    return C.interval_retention(fx.games(spark, sf), BINS, 100)


@query("flt_04_policy_filter", "policy", "SELECT game_id, coalesce(reason, 'ok') AS reason FROM policy")
def _(spark, sf):
    return fx.games(spark, sf).select("game_id", F.coalesce(C.policy_reason(POLICY), F.lit("ok")).alias("reason"))


@query("flt_05_corpus_eligibility", "binned", "SELECT game_id FROM binned WHERE fen IS NULL AND plies >= 22 AND wbin = bbin")
def _(spark, sf):
    return fx.games(spark, sf).filter(C.eligible_for_corpus(BINS)).select("game_id")


@query("flt_07_decisive_games", "games", "SELECT game_id, result FROM games WHERE result <> 0")
def _(spark, sf):
    return fx.games(spark, sf).filter("result != 0").select("game_id", "result")


@query("flt_08_player_in_game", "sides", """
SELECT game_id, color FROM sides WHERE lower(CASE WHEN game_id % 3 = 0 THEN upper(player) ELSE player END) IN (SELECT lower('P' || c_custkey) FROM customer WHERE c_mktsegment = 'BUILDING')""")
def _(spark, sf):
    written = F.when(F.col("game_id") % 3 == 0, F.upper("player")).otherwise(F.col("player"))
    wanted = fx.read(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(
        F.lower(F.concat(F.lit("P"), "c_custkey")).alias("name")
    )
    rows = sides(spark, sf).withColumn("name", F.lower(written))
    return rows.join(wanted, "name", "left_semi").select("game_id", "color")


@query("flt_11_black_rank_bin", "binned", "SELECT game_id, coalesce(bbin, -1) AS rank FROM binned")
def _(spark, sf):
    return fx.games(spark, sf).select("game_id", F.coalesce(C.elo_bin(F.col("black_elo"), BINS), F.lit(-1)).cast("bigint").alias("rank"))


@query("flt_18_minimum_group_size", "classified", """
SELECT game_id, wbin AS bin FROM (SELECT *, count(*) OVER (PARTITION BY wbin) AS n FROM classified WHERE reason IS NULL) WHERE n >= 20""")
def _(spark, sf):
    kept = classified(spark, sf).filter("reason IS NULL").select("game_id", "bin")
    return C.large_groups(kept, ["bin"], 20).select("game_id", F.col("bin").cast("bigint").alias("bin"))


@query("flt_20_indexable_games", "scored_games", """
SELECT count(*) FILTER (ok) AS indexed, count(*) FILTER (NOT ok) AS skipped FROM (
 SELECT black_elo >= 1000 AND black_elo < 2600 AND game_id % 7 <> 0 AS ok FROM scored_games)""")
def _(spark, sf):
    first_is_white = F.col("game_id") % 7 != 0
    ok = C.elo_bin(F.col("black_elo"), BINS).isNotNull() & first_is_white
    return fx.scored_games(spark, sf).agg(F.count_if(ok).alias("indexed"), F.count_if(~ok).alias("skipped"))


@query("jn_01_held_out_anti_join", "games held_out", "SELECT game_id FROM games WHERE md5(CAST(game_id AS VARCHAR)) NOT IN (SELECT digest FROM held_out)")
def _(spark, sf):
    return C.exclude_held_out(with_digest(fx.games(spark, sf)), held_out(spark, sf)).select("game_id")


@query("unn_04_sides", "sides", "SELECT game_id, color, player, opponent, elo, opponent_elo, outcome FROM sides")
def _(spark, sf):
    return sides(spark, sf).drop("played_at", "event")


@query("agg_01_exclusion_counts", "policy", """
SELECT k.reason, count(p.game_id) AS n FROM (VALUES ('unsupported_event'), ('invalid_result'), ('missing_player'), ('missing_rating'), ('rating_out_of_range'),
 ('duplicate_game'), ('white_insufficient_context'), ('black_insufficient_context'), ('context_too_old'), ('ambiguous_same_day_order'), ('max_predictions_per_player')) k(reason)
 LEFT JOIN policy p ON p.reason = k.reason GROUP BY 1""")
def _(spark, sf):
    tagged = fx.games(spark, sf).withColumn("reason", C.policy_reason(POLICY))
    return C.reason_counts(tagged, C.EXCLUSION_KEYS)


@query("agg_02_bin_counts", "classified", """
SELECT b.bin, count(c.game_id) AS n, count(c.game_id) <= 100 AS within_quota FROM (SELECT CAST(range AS BIGINT) AS bin FROM range(8)) b
 LEFT JOIN classified c ON c.reason IS NULL AND c.wbin = b.bin GROUP BY b.bin""")
def _(spark, sf):
    return C.bin_counts(classified(spark, sf), BINS, 100)


@query("agg_19_rating_distribution", "sides", """
SELECT CAST(floor(elo / 100.0) * 100 AS BIGINT) AS low, count(*) AS n, round(count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM games) * 100, 6) AS percent FROM sides WHERE elo > 0 GROUP BY 1""".replace("(SELECT CAST(count(*) AS DOUBLE) FROM games)", "(SELECT count(*) / 2.0 FROM sides WHERE elo > 0)"))
def _(spark, sf):
    return C.rating_distribution(sides(spark, sf).filter("elo > 0"))


@query("agg_20_player_activity", "sides", """
SELECT count(*) AS players, count(*) FILTER (n >= 100) AS over_100, count(*) FILTER (n >= 500) AS over_500, count(*) FILTER (n >= 1000) AS over_1000
 FROM (SELECT player, count(*) AS n FROM sides GROUP BY 1)""")
def _(spark, sf):
    return C.activity_totals(C.player_activity(sides(spark, sf)))


@query("top_01_catalog_order", "games", """
SELECT game_id, ROW_NUMBER() OVER (ORDER BY played_at, game_id) AS position FROM games""")
def _(spark, sf):
    from duelgauge.operators import ordered

    g = fx.games(spark, sf).select("game_id", "played_at")
    segments = [F.col("played_at"), *ordered.id_levels(F.col("game_id"))]
    return ordered.row_numbers(g, [], ["played_at", "game_id"], segments, "position").select("game_id", "position")


@query("top_02_most_frequent_players", "sides", "SELECT player, count(*) AS n FROM sides GROUP BY 1 ORDER BY n DESC, player LIMIT 500")
def _(spark, sf):
    return C.player_activity(sides(spark, sf)).orderBy(F.desc("n"), "player").limit(500)


@query("top_06_first_games", "games", "SELECT game_id, CAST(played_at AS VARCHAR) AS played_at FROM games ORDER BY games.played_at, game_id LIMIT 100")
def _(spark, sf):
    g = fx.games(spark, sf).select("game_id", "played_at").orderBy("played_at", "game_id").limit(100)
    return g.withColumn("played_at", F.col("played_at").cast("string"))


@query("win_01_bounded_sample", "sides", """
SELECT player, game_id, color FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY player ORDER BY md5('reservoir:' || game_id || ':' || color), game_id, color) AS rn FROM sides) WHERE rn <= 32""")
def _(spark, sf):
    from duelgauge.operators import ordered

    return ordered.hash_sample(sides(spark, sf), ["player"], ["game_id", "color"], "reservoir", 32).select("player", "game_id", "color")


table("kept", "classified", "SELECT game_id, wbin AS bin FROM classified WHERE reason IS NULL")


@query("smp_01_quota_and_training", "kept", """
SELECT game_id, bin, CASE WHEN rn <= 2200 THEN 'eval' ELSE 'train' END AS split FROM (
 SELECT *, ROW_NUMBER() OVER (PARTITION BY bin ORDER BY md5('quota:' || game_id), game_id) AS rn FROM kept)""")
def _(spark, sf):
    kept = classified(spark, sf).filter("reason IS NULL").select("game_id", F.col("bin").cast("bigint").alias("bin"))
    return C.rank_bands(kept, ["bin"], ["game_id"], "quota", {"eval": 2200, "train": None})


@query("smp_01_small_quota_and_training", "kept", """
SELECT game_id, bin, CASE WHEN rn <= 100 THEN 'eval' ELSE 'train' END AS split FROM (
 SELECT *, ROW_NUMBER() OVER (PARTITION BY bin ORDER BY md5('quota:' || game_id), game_id) AS rn FROM kept)""")
def _(spark, sf):
    """The quota of the query above leaves nothing for training on small tables; this one leaves most."""
    kept = classified(spark, sf).filter("reason IS NULL").select("game_id", F.col("bin").cast("bigint").alias("bin"))
    return C.rank_bands(kept, ["bin"], ["game_id"], "quota", {"eval": 100, "train": None})


@query("smp_02_candidate_query_split", "kept", """
SELECT game_id, bin, CASE WHEN rn <= 200 THEN 'cand' ELSE 'test' END AS split FROM (
 SELECT *, ROW_NUMBER() OVER (PARTITION BY bin ORDER BY md5('split:' || game_id), game_id) AS rn FROM kept) WHERE rn <= 2200""")
def _(spark, sf):
    kept = classified(spark, sf).filter("reason IS NULL").select("game_id", F.col("bin").cast("bigint").alias("bin"))
    return C.rank_bands(kept, ["bin"], ["game_id"], "split", {"cand": 200, "test": 2000})


@query("smp_03_guarded_split", "kept", """
SELECT game_id, bin, CASE WHEN rn <= 110 THEN 'query' ELSE 'cand' END AS split FROM (
 SELECT *, ROW_NUMBER() OVER (PARTITION BY bin ORDER BY md5('qc:' || game_id), game_id) AS rn, count(*) OVER (PARTITION BY bin) AS n FROM kept) WHERE n >= 122 AND rn <= 122""")
def _(spark, sf):
    kept = classified(spark, sf).filter("reason IS NULL").select("game_id", F.col("bin").cast("bigint").alias("bin"))
    return C.rank_bands(C.large_groups(kept, ["bin"], 122), ["bin"], ["game_id"], "qc", {"query": 110, "cand": 12})


@query("src_18_first_games_by_order", "games", "SELECT game_id FROM games ORDER BY played_at, game_id LIMIT 1000")
def _(spark, sf):
    return fx.games(spark, sf).select("game_id", "played_at").orderBy("played_at", "game_id").limit(1000).select("game_id")
