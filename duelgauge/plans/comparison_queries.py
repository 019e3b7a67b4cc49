"""Registered queries: overlap, cohorts, self-play, matches, move-level evaluation."""

from pyspark.sql import functions as F

from duelgauge import fixtures as fx
from duelgauge.operators import calibration as K
from duelgauge.operators import compare as M
from duelgauge.operators import corpus as C
from duelgauge.operators import native_eval as N
from duelgauge.operators import ordered
from duelgauge.operators import selfplay as S
from duelgauge.plans import evaluation_queries as E
from duelgauge.plans.evaluation_queries import draws_sql, estimate_sql, rounded
from duelgauge.plans.registry import query, table

# Overlap ----------------------------------------------------------------------------------------


def keyed(games, upper=False):
    name = (lambda c: F.upper(c)) if upper else (lambda c: F.col(c))
    return games.withColumn("key", M.game_key(F.col("result"), name("white"), name("black"), F.col("played_at"), F.lit("e2e4"))).withColumn(
        "line_no", F.col("game_id")
    )


@query("jn_03_exact_overlap", "games", """
, o AS (SELECT result, white, black, played_at, arg_max('o' || game_id % 5, game_id) AS owner FROM games WHERE md5('own:' || game_id) < '4' GROUP BY 1, 2, 3, 4)
SELECT owner, count(*) AS overlaps FROM games JOIN o USING (result, white, black, played_at) GROUP BY 1""")
def _(spark, sf):
    g = fx.games(spark, sf)
    mine = g.filter(F.md5(F.concat(F.lit("own:"), F.col("game_id").cast("string"))) < "4")
    owned = keyed(mine, upper=True).withColumn("owner", F.concat(F.lit("o"), (F.col("game_id") % 5).cast("string")))
    return M.overlap_by_owner(keyed(g), owned)


def bag(games, keep):
    return games.filter(keep).select("game_id", F.concat_ws("|", "white", "event", "result").alias("key"), F.col("game_id").alias("line_no"))


table("bag_old", "games", "SELECT white || '|' || event || '|' || result AS key, count(*) AS quota FROM games WHERE game_id % 3 = 0 GROUP BY 1")


@query("jn_04_bag_match", "games bag_old", """
SELECT game_id FROM (SELECT game_id, key, ROW_NUMBER() OVER (PARTITION BY key ORDER BY game_id) AS rn FROM (SELECT game_id, white || '|' || event || '|' || result AS key FROM games WHERE game_id % 2 = 0)) JOIN bag_old USING (key) WHERE rn <= quota""")
def _(spark, sf):
    g = fx.games(spark, sf)
    return M.bag_match(bag(g, F.col("game_id") % 2 == 0), bag(g, F.col("game_id") % 3 == 0)).select("game_id")


@query("jn_04_bag_summary", "games bag_old", """
, h AS (SELECT white || '|' || event || '|' || result AS key, count(*) AS have FROM games WHERE game_id % 2 = 0 GROUP BY 1)
SELECT CAST(sum(least(quota, coalesce(have, 0))) AS BIGINT) AS matched, CAST(sum(quota - least(quota, coalesce(have, 0))) AS BIGINT) AS unmatched_legacy FROM bag_old LEFT JOIN h USING (key)""")
def _(spark, sf):
    g = fx.games(spark, sf)
    return M.bag_summary(bag(g, F.col("game_id") % 2 == 0), bag(g, F.col("game_id") % 3 == 0))


table("old_moves", "moves", "SELECT game_id AS line_no, ply, move FROM moves")
table("new_moves", "moves", "SELECT game_id AS line_no, ply, CASE WHEN event_id % 97 = 0 THEN 'e1g1' ELSE move END AS move FROM moves WHERE NOT (game_id % 10 = 0 AND ply >= 40)")
table("first_diff", "old_moves new_moves", """
 SELECT line_no, min(ply) FILTER (d) AS ply, arg_min(old, ply) FILTER (d) AS old, arg_min(new, ply) FILTER (d) AS new FROM (
  SELECT line_no, ply, coalesce(o.move, '<end>') AS old, coalesce(n.move, '<end>') AS new, o.move IS DISTINCT FROM n.move AS d FROM old_moves o FULL JOIN new_moves n USING (line_no, ply)) GROUP BY 1""")


def first_differences(spark, sf):
    m = fx.moves(spark, sf).withColumnRenamed("game_id", "line_no")
    new = m.filter(~((F.col("line_no") % 10 == 0) & (F.col("ply") >= 40))).withColumn(
        "move", F.when(F.col("event_id") % 97 == 0, "e1g1").otherwise(F.col("move"))
    )
    return M.first_differences(m, new)


@query("jn_05_first_difference", "first_diff", "SELECT line_no, ply, old, new FROM first_diff WHERE ply IS NOT NULL")
def _(spark, sf):
    return first_differences(spark, sf).filter("ply IS NOT NULL")


@query("agg_38_difference_totals", "first_diff", "SELECT count(*) AS games, count(*) FILTER (ply IS NULL) AS identical, count(*) FILTER (ply IS NOT NULL) AS different FROM first_diff")
def _(spark, sf):
    return M.difference_totals(first_differences(spark, sf))


@query("top_05_first_differences", "first_diff", "SELECT old, new, count(*) AS n FROM first_diff WHERE ply IS NOT NULL GROUP BY 1, 2 ORDER BY n DESC, old, new LIMIT 15")
def _(spark, sf):
    return M.difference_histogram(first_differences(spark, sf)).orderBy(F.desc("n"), "old", "new").limit(15)


# Cohorts ----------------------------------------------------------------------------------------

table("spans", "sides", """
 SELECT player, greatest(min(played_at) FILTER (event = 'Rapid'), min(played_at) FILTER (event = 'Blitz')) AS s, least(max(played_at) FILTER (event = 'Rapid'), max(played_at) FILTER (event = 'Blitz')) AS e,
  count(*) FILTER (event = 'Rapid') AS r, count(*) FILTER (event = 'Blitz') AS b FROM sides GROUP BY 1""")


@query("flt_06_overlapping_window", "sides spans", """
SELECT game_id, color, CAST(s AS VARCHAR) AS start_day, CAST(e AS VARCHAR) AS end_day FROM sides JOIN spans USING (player) WHERE r > 0 AND b > 0 AND s <= e AND played_at BETWEEN s AND e""")
def _(spark, sf):
    rows = C.sides(fx.games(spark, sf), "played_at", "event")
    out = M.overlapping_window(rows, "player", "event", "played_at", "Rapid", "Blitz")
    return out.select("game_id", "color", F.col("start").cast("string").alias("start_day"), F.col("end").cast("string").alias("end_day"))


table("rated_sides", "sides", "SELECT * FROM sides WHERE elo > 0 AND opponent_elo > 0")
table("cohort_stats", "rated_sides", "SELECT player, count(*) AS games, median(elo) AS median_rating FROM rated_sides GROUP BY 1")
table("cohort", "cohort_stats", "SELECT * FROM cohort_stats WHERE median_rating >= 1500 AND median_rating < 2100 ORDER BY games DESC, player LIMIT 8")


def rated_sides(spark, sf):
    return C.sides(fx.games(spark, sf)).filter("elo > 0 AND opponent_elo > 0")


@query("agg_27_cohort_stats", "cohort_stats", "SELECT player, games, median_rating FROM cohort_stats")
def _(spark, sf):
    return M.cohort_candidates(rated_sides(spark, sf))


@query("top_03_most_active_cohort", "cohort", "SELECT player, games, median_rating FROM cohort")
def _(spark, sf):
    return M.most_active(M.cohort_candidates(rated_sides(spark, sf)), 1500, 2100)


@query("jn_09_cohort_games", "sides cohort", "SELECT DISTINCT game_id FROM sides WHERE player IN (SELECT player FROM cohort)")
def _(spark, sf):
    cohort = M.most_active(M.cohort_candidates(rated_sides(spark, sf)), 1500, 2100)
    return M.cohort_games(C.sides(fx.games(spark, sf)), cohort)


table("timed_report", "scored_sides games", """
 SELECT s.player, g.event, sum(s.score * s.moves) / sum(s.moves) AS mean_score, median(s.rating) AS rating FROM scored_sides s JOIN games g USING (game_id) WHERE s.game_id % 101 <> 0 GROUP BY 1, 2""")
table("timed_errors", "timed_report segments", f"SELECT player, event, estimated_elo, rating, estimated_elo - rating AS error FROM ({estimate_sql('timed_report')})")
table("deltas", "timed_errors", "SELECT r.player, r.error - b.error AS delta FROM timed_errors r JOIN timed_errors b USING (player) WHERE r.event = 'Rapid' AND b.event = 'Blitz'")


def timed_errors(spark, sf):
    events = fx.games(spark, sf).select("game_id", "event")
    rows = E.player_sides_scored(spark, sf).filter("problem IS NULL").join(events, "game_id")
    report = rows.groupBy("player", "event").agg(
        (F.sum(F.col("score") * F.col("moves")) / F.sum("moves")).alias("mean_score"), F.percentile("rating", 0.5).alias("rating")
    )
    rated = K.with_estimate(report, E.calibration(spark, sf))
    return rated.withColumn("error", F.col("estimated_elo") - F.col("rating"))


@query("jn_18_paired_deltas", "deltas", "SELECT player, round(delta, 5) AS delta FROM deltas")
def _(spark, sf):
    return rounded(M.paired_deltas(timed_errors(spark, sf), "player", "event", "Rapid", "Blitz"), digits=5)


@query("jn_18_delta_summary", "deltas", "SELECT count(*) AS paired_players, round(avg(delta), 5) AS mean_delta, round(median(delta), 5) AS median_delta FROM deltas")
def _(spark, sf):
    return rounded(M.delta_summary(M.paired_deltas(timed_errors(spark, sf), "player", "event", "Rapid", "Blitz")), digits=5)


@query("agg_39_error_report", "timed_errors", """
SELECT count(*) AS players, round(avg(error), 5) AS mean_error, round(avg(abs(error)), 5) AS mae, round(sqrt(avg(error * error)), 5) AS rmse, round(corr(estimated_elo, rating), 5) AS correlation, round(median(error), 5) AS median_error FROM timed_errors""")
def _(spark, sf):
    return rounded(M.error_report(timed_errors(spark, sf), "estimated_elo", "rating"), digits=5)


table("role_rows", "scored_sides", """
 SELECT a.player, 'target' AS role, a.score, a.moves FROM scored_sides a UNION ALL
 SELECT a.player, 'opponent', b.score, b.moves FROM scored_sides a JOIN scored_sides b ON a.game_id = b.game_id AND a.color <> b.color""")


@query("agg_37_side_comparison", "role_rows", """
SELECT player, role, round(sum(score * moves) / sum(moves), 6) AS mean_score FROM role_rows GROUP BY 1, 2 UNION ALL SELECT player, 'pooled', round(sum(score * moves) / sum(moves), 6) FROM role_rows GROUP BY 1""")
def _(spark, sf):
    rows = fx.game_scores(spark, sf).join(fx.games(spark, sf).select("game_id", "white", "black"), "game_id")
    part = lambda who, role, c: F.struct(F.col(who).alias("player"), F.lit(role).alias("role"), F.col(f"{c}_score").alias("score"), F.col(f"{c}_moves").alias("moves"))
    long = rows.select(F.explode(F.array(
        part("white", "target", "white"), part("white", "opponent", "black"), part("black", "target", "black"), part("black", "opponent", "white"))).alias("r")).select("r.*")
    return rounded(M.side_comparison(long))


table("effect_rows", "scored_sides games binned", """
 SELECT s.player, s.score, s.moves, abs(b.white_elo - b.black_elo) AS gap, b.fen IS NULL AND b.plies >= 22 AS kept FROM scored_sides s JOIN binned b USING (game_id)""")


@query("agg_40_filter_effect", "effect_rows", """
SELECT player, count(*) AS total_games, count(*) FILTER (kept) AS kept_games, round(count(*) FILTER (kept) / count(*)::DOUBLE, 6) AS kept_fraction, median(gap) AS median_absolute_rating_gap,
 round(sum(score * moves) / sum(moves), 6) AS baseline_score, round(sum(score * moves) FILTER (kept) / sum(moves) FILTER (kept), 6) AS filtered_score FROM effect_rows GROUP BY 1""")
def _(spark, sf):
    g = fx.games(spark, sf)
    kept = g.select("game_id", C.eligible_for_corpus(fx.BINS_200).alias("kept"), F.abs(F.col("white_elo") - F.col("black_elo")).alias("gap"))
    return rounded(M.filter_effect(
        K.side_scores(fx.game_scores(spark, sf)).join(g.select("game_id", "white", "black"), "game_id").join(kept, "game_id").select(
            F.when(F.col("color") == "white", F.col("white")).otherwise(F.col("black")).alias("player"), "kept", "gap", "score", "moves")))


@query("unn_02_opponents_left", "sides", "SELECT DISTINCT player FROM sides WHERE player NOT IN (SELECT 'p' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def _(spark, sf):
    done = fx.read(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("p"), "c_custkey").alias("player"))
    return M.opponents_left(C.sides(fx.games(spark, sf)), done)


@query("flt_09_eligible_players", "", """
SELECT c_custkey FROM (SELECT c_custkey, 800 + CAST(floor(c_acctbal / 10) AS BIGINT) AS rating, c_custkey % 5 = 0 AS prov, c_custkey % 60 AS games, c_custkey % 17 = 0 AS closed, c_custkey % 23 = 0 AS tos FROM customer)
 WHERE rating < 1300 AND NOT prov AND games >= 20 AND NOT closed AND NOT tos""")
def _(spark, sf):
    k = F.col("c_custkey")
    records = fx.read(spark, sf, "customer").select(
        "c_custkey", (F.lit(800) + F.floor(F.col("c_acctbal") / 10)).alias("rating"), (k % 5 == 0).alias("prov"), (k % 60).alias("games"),
        (k % 17 == 0).alias("closed"), (k % 23 == 0).alias("tosViolation"),
    )
    return M.eligible_players(records, 1300, 20).select("c_custkey")


@query("unn_01_merged_splits", "kept", """
SELECT bin, count(*) AS n FROM (SELECT game_id, bin FROM kept WHERE game_id % 2 = 0 UNION ALL SELECT game_id, bin FROM kept WHERE game_id % 2 = 1) GROUP BY 1""")
def _(spark, sf):
    from duelgauge.plans.corpus_queries import classified

    kept = classified(spark, sf).filter("reason IS NULL").select("game_id", F.col("bin").cast("bigint").alias("bin"))
    merged = kept.filter(F.col("game_id") % 2 == 0).unionByName(kept.filter(F.col("game_id") % 2 == 1))
    return merged.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


# Self-play, matches, curves ---------------------------------------------------------------------

table("selfplay", "games", """
 SELECT game_id // 500 AS iteration, CASE WHEN game_id % 29 = 0 THEN game_id // 500 - 1 ELSE game_id // 500 END AS model_step, game_id % 9 <> 0 AS is_terminal, 20 + game_id % 60 AS game_length,
  10 + game_id % 30 AS data_length, CAST(result AS DOUBLE) AS ret FROM games""")


def selfplay(spark, sf):
    g = F.col("game_id")
    it = F.floor(g / 500)
    return fx.games(spark, sf).select(
        it.alias("iteration"), F.when(g % 29 == 0, it - 1).otherwise(it).alias("model_step"), (g % 9 != 0).alias("is_terminal"),
        (F.lit(20) + g % 60).alias("game_length"), (F.lit(10) + g % 30).alias("data_length"), F.col("result").cast("double").alias("ret"),
    )


@query("flt_13_current_model_only", "selfplay", "SELECT iteration, count(*) AS n FROM selfplay WHERE model_step = iteration GROUP BY 1")
def _(spark, sf):
    return S.current_model_only(selfplay(spark, sf)).groupBy("iteration").agg(F.count(F.lit(1)).alias("n"))


@query("agg_33_selfplay_stats", "selfplay", """
SELECT iteration, count(*) AS games, count(*) FILTER (is_terminal) AS finished_games, """ + ", ".join(
    f"min({c}) FILTER (is_terminal)::DOUBLE AS min_{n}, max({c}) FILTER (is_terminal)::DOUBLE AS max_{n}, round(avg({c}) FILTER (is_terminal), 6) AS avg_{n}, round(coalesce(stddev_samp({c}) FILTER (is_terminal), 0), 6) AS std_{n}"
    for n, c in (("length", "game_length"), ("return", "ret"))) + """, round(avg(data_length), 6) AS avg_data_length FROM selfplay WHERE model_step = iteration GROUP BY 1""")
def _(spark, sf):
    return rounded(S.iteration_stats(S.current_model_only(selfplay(spark, sf))))


table("match_rows", "games", """
 SELECT (year(played_at) - 1995) * 12 + month(played_at) AS p1, (year(played_at) - 1995) * 12 + month(played_at) - 1 AS p2, game_id % 2 AS alt, CASE WHEN game_id % 41 = 0 THEN 'B+R' WHEN result > 0 THEN '1.000000' WHEN result < 0 THEN '-1.000000' ELSE '0.000000' END AS res_b,
  CASE WHEN game_id % 37 = 0 THEN '5' ELSE '-' END AS dup FROM games""")
table("match_summary", "match_rows", """
 SELECT p1, p2, bw AS black_wins, ww AS white_wins, d AS draws, dup AS duplicates, n AS total, round((bw + ww + d / 2.0::DOUBLE) / n, 4) AS win_rate FROM (
  SELECT p1, p2, count(*) FILTER (alt <> 1 AND (res_b = '1.000000' OR res_b LIKE '%B+%')) AS bw, count(*) FILTER (alt = 1 AND (res_b = '-1.000000' OR res_b LIKE '%B+%')) AS ww,
   count(*) FILTER (res_b IN ('0.000000', '0')) AS d, count(*) FILTER (dup <> '-') AS dup, count(*) AS n FROM match_rows GROUP BY 1, 2)""")
STEP_SQL = "CASE WHEN {0} >= 1 THEN 1000 WHEN {0} <= 0 THEN -1000 ELSE -greatest(least(1000, 400 * log10((1 - {0}) / {0})), -1000) END"
table("ladder", "match_summary", f"SELECT *, round(sum(round({STEP_SQL.format('win_rate')}, 3)) OVER (ORDER BY p1, p2), 3) AS elo FROM match_summary")


def match_rows(spark, sf):
    step = (F.year("played_at") - 1995) * 12 + F.month("played_at")
    g = F.col("game_id")
    res = F.when(g % 41 == 0, "B+R").when(F.col("result") > 0, "1.000000").when(F.col("result") < 0, "-1.000000").otherwise("0.000000")
    return fx.games(spark, sf).select(
        step.cast("bigint").alias("p1"), (step - 1).cast("bigint").alias("p2"), (g % 2).alias("alt"), res.alias("res_b"),
        F.when(g % 37 == 0, "5").otherwise("-").alias("dup"),
    )


@query("agg_34_match_summary", "match_summary", "SELECT * FROM match_summary")
def _(spark, sf):
    return S.match_summary(match_rows(spark, sf))


@query("win_10_elo_ladder", "ladder", "SELECT p1, p2, win_rate, elo FROM ladder")
def _(spark, sf):
    return S.elo_ladder(S.match_summary(match_rows(spark, sf))).select("p1", "p2", "win_rate", "elo")


@query("scl_09_step_elo", "match_summary", f"SELECT p1, p2, round({STEP_SQL.format('win_rate')}, 3)::DOUBLE AS step FROM match_summary")
def _(spark, sf):
    from duelgauge.functions.rating import step_elo

    return S.match_summary(match_rows(spark, sf)).select("p1", "p2", F.round(step_elo(F.col("win_rate")), 3).alias("step"))


@query("jn_16_opponent_elo", "match_summary ladder", f"""
SELECT s.p1, s.p2, l.elo AS p1_elo, round(l.elo + {STEP_SQL.format('(1 - s.win_rate)')}, 3) AS p2_elo FROM match_summary s LEFT JOIN (SELECT p1, elo FROM ladder WHERE p1 % 7 <> 0) l USING (p1)""")
def _(spark, sf):
    summary = S.match_summary(match_rows(spark, sf))
    known = S.elo_ladder(summary).filter(F.col("p1") % 7 != 0)
    return S.opponent_elo(summary, known).select("p1", "p2", "p1_elo", "p2_elo")


@query("agg_35_training_curves", "", "SELECT event_id // 100 AS step, event_type AS metric, round(avg(value), 6) AS value FROM events GROUP BY 1, 2")
def _(spark, sf):
    rows = fx.read(spark, sf, "events").select(F.floor(F.col("event_id") / 100).alias("step"), F.col("event_type").alias("metric"), "value")
    return rounded(S.metric_curves(rows))


@query("win_16_iteration_durations", "", """
SELECT it AS iteration, round((c - a) / 1e6, 6) AS total_s, round((c - b) / 1e6, 6) AS optimization_s, round((b - a) / 1e6, 6) AS selfplay_s FROM (
 SELECT event_id // 50 AS it, max(epoch_us(ts)) FILTER (event_id % 50 = 0) AS a, max(epoch_us(ts)) FILTER (event_id % 50 = 20) AS b, max(epoch_us(ts)) FILTER (event_id % 50 = 49) AS c FROM events GROUP BY 1) WHERE c IS NOT NULL""")
def _(spark, sf):
    i = F.col("event_id") % 50
    kind = F.when(i == 0, "iteration_start").when(i == 20, "optimization_start").when(i == 49, "optimization_finish")
    log = fx.read(spark, sf, "events").select(F.floor(F.col("event_id") / 50).alias("iteration"), kind.alias("kind"), "ts")
    return rounded(S.iteration_durations(log))


table("sweep", "", "SELECT event_id // 100 AS step, 1 + event_id % 5 AS games, avg(value) AS accuracy FROM events GROUP BY 1, 2")


def sweep(spark, sf):
    e = F.col("event_id")
    return fx.read(spark, sf, "events").groupBy(F.floor(e / 100).alias("step"), (F.lit(1) + e % 5).alias("games")).agg(F.avg("value").alias("accuracy"))


@query("snk_10_accuracy_sweep", "sweep", "SELECT step, " + ", ".join(f'round(max(accuracy) FILTER (games = {g}), 6) AS "{g}"' for g in range(1, 6)) + " FROM sweep GROUP BY 1")
def _(spark, sf):
    return rounded(S.sweep_table(sweep(spark, sf), [1, 2, 3, 4, 5]))


@query("unn_06_sweep_long", "sweep", "SELECT step, games, round(accuracy, 6) AS accuracy FROM sweep")
def _(spark, sf):
    return rounded(S.sweep_long(S.sweep_table(sweep(spark, sf), [1, 2, 3, 4, 5]), [1, 2, 3, 4, 5]))


# Move-level evaluation --------------------------------------------------------------------------


@query("flt_10_go_rank", "games", """
SELECT game_id, CAST(CASE WHEN game_id % 13 = 0 THEN 0 WHEN game_id % 2 = 0 THEN n ELSE CASE WHEN 1 - n <= -2 THEN -1 WHEN 1 - n <= 0 THEN 0 ELSE 1 - n END END AS BIGINT) AS rank FROM (SELECT game_id, 1 + game_id % 9 AS n FROM games)""")
def _(spark, sf):
    g = F.col("game_id")
    text = F.when(g % 13 == 0, "").otherwise(F.concat((F.lit(1) + g % 9).cast("string"), F.when(g % 2 == 0, "d").otherwise("k")))
    return fx.games(spark, sf).select("game_id", N.go_rank(text).cast("bigint").alias("rank"))


table("lengths", "move_scores", "SELECT game_id, count(*) AS len FROM move_scores GROUP BY 1")
for _frame, _cond in (
    ("all", "TRUE"), ("first_50", "ply < 50"), ("last_50", "ply >= len - 50"),
    ("one_move", "ply = (SELECT arg_min(o.ply, md5('frame:' || o.game_id || ':' || o.ply)) FROM move_scores o WHERE o.game_id = move_scores.game_id)"),
):

    def _select(spark, sf, frame=_frame):
        return rounded(N.select_frame(fx.move_scores(spark, sf), frame).select("game_id", "ply", "score"))

    query(f"flt_12_frame_{_frame}", "move_scores lengths", f"SELECT game_id, ply, round(score, 6) AS score FROM move_scores JOIN lengths USING (game_id) WHERE {_cond}")(_select)

table("ranked_moves", "move_scores binned", "SELECT m.*, b.bbin AS rank, 1 + m.ply % 3 AS weight FROM move_scores m JOIN binned b USING (game_id) WHERE b.bbin IS NOT NULL")


def ranked_moves(spark, sf):
    ranks = fx.games(spark, sf).select("game_id", C.elo_bin(F.col("black_elo"), fx.BINS_200).alias("rank")).filter("rank IS NOT NULL")
    return fx.move_scores(spark, sf).join(ranks, "game_id").withColumn("weight", (F.lit(1) + F.col("ply") % 3))


@query("agg_04_rank_strength", "ranked_moves lengths", "SELECT rank, round(avg(score), 6) AS mean_score, count(*) AS positions FROM ranked_moves JOIN lengths USING (game_id) WHERE ply >= len - 50 GROUP BY 1")
def _(spark, sf):
    return rounded(N.rank_strength(N.select_frame(ranked_moves(spark, sf), "last_50")))


@query("agg_31_strength_by_ply", "ranked_moves", "SELECT rank, ply, round(sum(score * weight) / sum(weight), 6) AS strength, count(*) AS n FROM ranked_moves GROUP BY 1, 2")
def _(spark, sf):
    return rounded(N.strength_by_ply(ranked_moves(spark, sf)))


table("agreement", "", """
 SELECT CAST(vec_id % 3 AS VARCHAR) AS rank, 1 + len(list_filter(embedding, lambda p: p > embedding[1 + CAST(vec_id % 64 AS INT)])) AS k FROM embeddings""")


@query("agg_28_move_agreement", "agreement", """
, c AS (SELECT rank, k, count(*) AS n FROM agreement GROUP BY 1, 2 UNION ALL SELECT 'all', k, count(*) FROM agreement GROUP BY 2)
SELECT rank, CAST(k AS INT) AS k, round(sum(n) OVER (PARTITION BY rank ORDER BY k) / sum(n) OVER (PARTITION BY rank)::DOUBLE, 6) AS accuracy FROM c""")
def _(spark, sf):
    rows = fx.read(spark, sf, "embeddings").select(
        (F.col("vec_id") % 3).cast("string").alias("rank"), N.played_order(F.col("embedding"), (F.col("vec_id") % 64).cast("int")).alias("played_order")
    )
    return rounded(N.agreement_curve(rows))


@query("win_08_cumulative_accuracy", "agreement", """
SELECT CAST(k AS INT) AS k, round(sum(n) OVER (ORDER BY k) / sum(n) OVER ()::DOUBLE, 6) AS accuracy FROM (SELECT k, count(*) AS n FROM agreement GROUP BY 1)""")
def _(spark, sf):
    rows = fx.read(spark, sf, "embeddings").select(
        (F.col("vec_id") % 3).cast("string").alias("rank"), N.played_order(F.col("embedding"), (F.col("vec_id") % 64).cast("int")).alias("played_order")
    )
    return rounded(N.agreement_curve(rows).filter("rank = 'all'").drop("rank"))


CLASS_SIZES = "(VALUES (1), (5), (10), (25), (50), (100)) s(size)"
table("class_positions", "", "SELECT vec_id // 4 AS game_id, vec_id % 4 AS ply, (vec_id // 4 * 7) % 9 AS rank, embedding AS classes FROM embeddings")
table("class_pool", "class_positions", "SELECT *, ROW_NUMBER() OVER (PARTITION BY rank ORDER BY md5('pool:' || game_id), game_id) AS draw, count(*) OVER (PARTITION BY rank) AS pool FROM (SELECT DISTINCT rank, game_id FROM class_positions)")
table("class_draws0", "class_pool", draws_sql("class_pool", "rank", "class", CLASS_SIZES, 500))
table("class_draws", "class_draws0", "SELECT *, CAST('0x' || substr(md5(concat_ws(':', 'class-side', size, rank, trial, nth)), 1, 15) AS BIGINT) % 2 AS parity FROM class_draws0")
table("prob_votes", "class_positions", "SELECT game_id, ply % 2 AS parity, unnest(range(64)) AS class, unnest(classes)::DOUBLE AS v FROM class_positions")
table("num_votes", "class_positions", "SELECT game_id, ply % 2 AS parity, list_position(classes, list_max(classes)) - 1 AS class, 1.0::DOUBLE AS v FROM class_positions")
for _mode, _votes in (("max_prob", "prob_votes"), ("max_num", "num_votes")):

    def _classes(spark, sf, mode=_mode):
        v = F.col("vec_id")
        gid = F.floor(v / 4)
        positions = fx.read(spark, sf, "embeddings").select(gid.alias("game_id"), (v % 4).alias("ply"), (gid * 7 % 9).alias("rank"), F.col("embedding").alias("classes"))
        results = N.class_trials(positions.select("game_id", "rank").distinct(), positions, mode, (1, 5, 10, 25, 50, 100), 500, "class")
        return rounded(N.class_accuracy(results, "+/-1"))

    query(f"agg_29_class_vote_{_mode}", f"class_draws class_pool {_votes}", f"""
, s AS (SELECT d.size, d.rank, d.trial, v.class, sum(v.v) AS v FROM class_draws d JOIN class_pool p USING (rank, draw) JOIN {_votes} v ON v.game_id = p.game_id AND v.parity = d.parity GROUP BY 1, 2, 3, 4),
b AS (SELECT size, rank, trial, arg_min(class, (-v, class)) - 1 AS pred FROM s GROUP BY 1, 2, 3)
SELECT CAST(size AS INT) AS size, rank, round(avg(CAST(pred - rank IN (0, 1, -1) AS DOUBLE)), 6) AS accuracy FROM b GROUP BY 1, 2""")(_classes)


@query("agg_32_search_agreement", "", """
SELECT l_linenumber AS simulation, l_returnflag AS temperature, round(avg(CAST(l_partkey % 7 = l_suppkey % 7 AS DOUBLE)), 6) AS accuracy, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def _(spark, sf):
    rows = fx.read(spark, sf, "lineitem").select(
        F.col("l_linenumber").alias("simulation"), F.col("l_returnflag").alias("temperature"), (F.col("l_partkey") % 7).alias("chosen"), (F.col("l_suppkey") % 7).alias("actual")
    )
    return rounded(N.search_agreement(rows))
