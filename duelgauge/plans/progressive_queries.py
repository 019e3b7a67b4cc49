"""Registered queries: prefix windows, trajectories, curves."""

from pyspark.sql import functions as F

from duelgauge import fixtures as fx
from duelgauge.functions import rating as R
from duelgauge.operators import progressive as G
from duelgauge.plans.evaluation_queries import rounded
from duelgauge.plans.registry import query, table

SLOPE, INTERCEPT = (f"{v!r}::DOUBLE" for v in R.DEFAULT_LINE)

table("prefixes", "move_scores", """
 SELECT *, ROW_NUMBER() OVER s AS n, avg(score) OVER s AS prefix_mean FROM move_scores
 WINDOW s AS (PARTITION BY game_id, color ORDER BY ply ROWS UNBOUNDED PRECEDING)""")
table("live", "move_scores", """
 SELECT game_id, ply + 1 AS observed_plies, avg(CASE WHEN color = 'white' THEN score END) OVER s AS w, avg(CASE WHEN color = 'black' THEN score END) OVER s AS b,
  count(CASE WHEN color = 'white' THEN 1 END) OVER s AS wn, count(CASE WHEN color = 'black' THEN 1 END) OVER s AS bn FROM move_scores
 WINDOW s AS (PARTITION BY game_id ORDER BY ply ROWS UNBOUNDED PRECEDING)""")
table("live_examples", "scored_games", """
 SELECT game_id, result, n_moves AS total_plies, (white_elo - 1374) / 2099.0::DOUBLE AS wc, (black_elo - 1374) / 2099.0::DOUBLE AS bc,
  8 - game_id % 3 AS wg, 8 - game_id % 2 AS bg FROM scored_games""")
table("live_rows", "live_examples live", """
 SELECT e.*, 0::BIGINT AS observed_plies, NULL::DOUBLE AS w, NULL::DOUBLE AS b, 0::BIGINT AS wn, 0::BIGINT AS bn FROM live_examples e
 UNION ALL SELECT e.*, l.observed_plies, l.w, l.b, l.wn, l.bn FROM live_examples e JOIN live l USING (game_id) WHERE l.observed_plies >= 2""")
table("trajectories", "live_rows", f"""
 SELECT *, 0.96::DOUBLE * ex AS p_white, 0.04::DOUBLE AS p_draw, 0.96::DOUBLE * (1 - ex) AS p_black, CAST(CASE WHEN ex >= 1 - ex THEN 1 ELSE -1 END AS BIGINT) AS predicted FROM (
 SELECT *, 1 / (1 + pow(10.0::DOUBLE, (belo - welo) / 400)) AS ex FROM (
 SELECT *, {SLOPE} * wb + {INTERCEPT} AS welo, {SLOPE} * bb + {INTERCEPT} AS belo FROM (
 SELECT *, (wg * 40 * wc + wn * 8 * coalesce(w, 0)) / (wg * 40 + wn * 8) AS wb, (bg * 40 * bc + bn * 8 * coalesce(b, 0)) / (bg * 40 + bn * 8) AS bb,
  wn * 8 / (wg * 40 + wn * 8)::DOUBLE AS wf, bn * 8 / (bg * 40 + bn * 8)::DOUBLE AS bf FROM live_rows)))""")
table("traj_base", "trajectories", """
 SELECT t.*, b.welo AS bwelo, b.belo AS bbelo, b.p_white AS bp_white, b.p_draw AS bp_draw, b.p_black AS bp_black, b.predicted AS bpredicted
 FROM trajectories t JOIN (SELECT * FROM trajectories WHERE observed_plies = 0) b USING (game_id)""")
table("curves", "traj_base", f"""
 SELECT game_id AS example_id, observed_plies, observed_plies / total_plies::DOUBLE AS game_progress, 'Progressive' AS estimate, result * (welo - belo) AS d FROM traj_base WHERE result <> 0
 UNION ALL SELECT game_id, observed_plies, observed_plies / total_plies::DOUBLE, 'Context only', result * (bwelo - bbelo) FROM traj_base WHERE result <> 0
 UNION ALL SELECT game_id, observed_plies, observed_plies / total_plies::DOUBLE, 'Current game only', (w - b) * {SLOPE} * result FROM traj_base WHERE result <> 0 AND w IS NOT NULL""")


def live_examples(spark, sf):
    unit = lambda c: ((F.col(c) - 1374) / F.lit(2099.0))
    return fx.scored_games(spark, sf).select(
        "game_id", "result", F.col("n_moves").alias("total_plies"),
        unit("white_elo").alias("white_context_strength"), unit("black_elo").alias("black_context_strength"),
        (F.lit(8) - F.col("game_id") % 3).alias("white_context_games"), (F.lit(8) - F.col("game_id") % 2).alias("black_context_games"),
    )


def trajectories(spark, sf):
    return G.trajectories(live_examples(spark, sf), fx.move_scores(spark, sf))


@query("win_03_prefix_means", "prefixes", "SELECT game_id, ply, color, n, round(prefix_mean, 6) AS prefix_mean FROM prefixes")
def _(spark, sf):
    return rounded(G.prefix_means(fx.move_scores(spark, sf)), "game_id", "ply", "color", "n", "prefix_mean")


@query("win_04_instantaneous_scores", "prefixes", "SELECT game_id, ply, round(score, 6) AS score, round(score, 6) AS instantaneous FROM prefixes")
def _(spark, sf):
    return rounded(G.instantaneous(G.prefix_means(fx.move_scores(spark, sf))), "game_id", "ply", "score", "instantaneous")


@query("win_05_last_known_scores", "move_scores", """
SELECT game_id, ply, round(last_value(CASE WHEN color = 'white' THEN score END IGNORE NULLS) OVER s, 6) AS white_last, round(last_value(CASE WHEN color = 'black' THEN score END IGNORE NULLS) OVER s, 6) AS black_last
FROM move_scores WINDOW s AS (PARTITION BY game_id ORDER BY ply ROWS UNBOUNDED PRECEDING)""")
def _(spark, sf):
    return rounded(G.last_known(fx.move_scores(spark, sf)), "game_id", "ply", "white_last", "black_last")


@query("win_06_progressive_blend", "trajectories", """
SELECT game_id, observed_plies, round(wb, 6) AS white_blended_strength, round(bf, 6) AS black_current_game_fraction, round(p_white, 6) AS p_white, predicted, observed_plies = total_plies AS is_recorded_endpoint FROM trajectories""")
def _(spark, sf):
    return rounded(trajectories(spark, sf), "game_id", "observed_plies", "white_blended_strength", "black_current_game_fraction", "p_white", "predicted", "is_recorded_endpoint")


@query("jn_11_baseline_self_join", "traj_base", "SELECT game_id, observed_plies, round(bwelo, 6) AS base_white_estimated_elo, round(bp_white, 6) AS base_p_white, bpredicted AS base_predicted FROM traj_base")
def _(spark, sf):
    return rounded(G.with_baseline(trajectories(spark, sf)), "game_id", "observed_plies", "base_white_estimated_elo", "base_p_white", "base_predicted")


@query("agg_15_metrics_by_ply", "traj_base", """
, e AS (SELECT observed_plies, result, 'progressive' AS estimate, p_white, p_draw, p_black, predicted FROM traj_base UNION ALL SELECT observed_plies, result, 'context_only', bp_white, bp_draw, bp_black, bpredicted FROM traj_base)
SELECT observed_plies, estimate, count(*) AS n_examples, round(avg(CAST(predicted = result AS DOUBLE)), 6) AS accuracy, round(avg(CAST(result = 0 AS DOUBLE)), 6) AS draw_rate,
 round(avg(-ln(greatest(CASE WHEN result > 0 THEN p_white WHEN result = 0 THEN p_draw ELSE p_black END, 1e-15))), 6) AS log_loss,
 round(avg(pow(CAST(result > 0 AS INT) - p_white, 2) + pow(CAST(result = 0 AS INT) - p_draw, 2) + pow(CAST(result < 0 AS INT) - p_black, 2)), 6) AS brier_score FROM e GROUP BY 1, 2""")
def _(spark, sf):
    return G.metrics_by_ply(trajectories(spark, sf))


@query("unn_03_estimates_long", "curves", "SELECT example_id, observed_plies, round(game_progress, 6) AS game_progress, estimate, round(d, 6) AS elo_difference FROM curves")
def _(spark, sf):
    return rounded(G.estimates_long(G.export_rows(trajectories(spark, sf))))


@query("agg_44_curve_by_ply", "curves", """
SELECT observed_plies, estimate, round(avg(d), 6) AS mean, round(coalesce(stddev_samp(d), 0) / sqrt(count(*)), 6) AS standard_error, count(*) AS n FROM curves GROUP BY 1, 2""")
def _(spark, sf):
    long = G.estimates_long(G.export_rows(trajectories(spark, sf)))
    return rounded(G.curve(long, F.col("observed_plies"), "observed_plies"))


@query("agg_44_curve_by_progress", "curves", """
SELECT least(greatest(round_even(game_progress / 0.05::DOUBLE, 0) * 5, 0), 100) AS progress, estimate, round(avg(d), 6) AS mean, round(coalesce(stddev_samp(d), 0) / sqrt(count(*)), 6) AS standard_error, count(*) AS n FROM curves GROUP BY 1, 2""")
def _(spark, sf):
    long = G.estimates_long(G.export_rows(trajectories(spark, sf)))
    return rounded(G.curve(long, G.progress_bin(5), "progress"))


@query("agg_42_games_by_ply", "traj_base", "SELECT observed_plies, count(DISTINCT game_id) AS games FROM traj_base WHERE result <> 0 GROUP BY 1")
def _(spark, sf):
    return G.games_by_ply(G.export_rows(trajectories(spark, sf)))


@query("agg_42_distinct_positions", "move_scores scored_games sides", """
SELECT (SELECT count(*) FROM (SELECT DISTINCT fen_before, move FROM move_scores)) AS positions, (SELECT count(DISTINCT player) FROM sides) AS players""")
def _(spark, sf):
    from duelgauge.operators import corpus as C

    positions = fx.move_scores(spark, sf).select("fen_before", "move").distinct().agg(F.count(F.lit(1)).alias("positions"))
    players = C.sides(fx.games(spark, sf)).agg(F.count_distinct("player").alias("n")).scalar()
    return positions.select("positions", players.alias("players"))


@query("snk_09_progressive_export", "traj_base", """
SELECT game_id AS example_id, game_id, observed_plies, observed_plies / 2.0::DOUBLE AS observed_full_moves, CASE WHEN result > 0 THEN 'white' ELSE 'black' END AS winner_color,
 round(result * (welo - belo), 6) AS winner_elo_difference, round(result * (bwelo - bbelo), 6) AS context_only_winner_elo_difference, round(CASE WHEN result > 0 THEN p_white ELSE p_black END, 6) AS winner_probability, false AS legacy_calibration FROM traj_base WHERE result <> 0""")
def _(spark, sf):
    out = G.export_rows(trajectories(spark, sf))
    return rounded(out, "example_id", "game_id", "observed_plies", "observed_full_moves", "winner_color", "winner_elo_difference", "context_only_winner_elo_difference", "winner_probability", "legacy_calibration")
