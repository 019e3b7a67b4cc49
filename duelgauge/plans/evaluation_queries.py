"""Registered queries: calibration, trials, phases."""

from pyspark.sql import functions as F

from duelgauge import fixtures as fx
from duelgauge.operators import calibration as K
from duelgauge.operators import corpus as C
from duelgauge.operators import ordered
from duelgauge.operators import phases as PH
from duelgauge.operators import resample as RS
from duelgauge.operators import trials as T
from duelgauge.plans.registry import query, table
from duelgauge.runtime import cut_lineage

SIZES = (1, 10, 25, 50, 75, 100)
TRIALS = 500
SIZES_SQL = "(VALUES (1), (10), (25), (50), (75), (100)) s(size)"


def rounded(df, *keep, digits=6):
    doubles = {f.name for f in df.schema.fields if f.dataType.typeName() == "double"}
    return df.select(*[F.round(c, digits).alias(c) if c in doubles else F.col(c) for c in (keep or df.columns)])


def calibration(spark, sf):
    return K.bucket_means(fx.candidate_scores(spark, sf))


def score_tables(spark, sf):
    """Query entries and calibration as stored tables: scoring is done once and its result kept."""
    return cut_lineage(K.side_scores(fx.query_scores(spark, sf))), cut_lineage(calibration(spark, sf))


def player_sides_scored(spark, sf):
    """Per game and player: score, moves, recorded rating and the reason a score is unusable."""
    g = fx.games(spark, sf).select("game_id", "white", "black")
    rows = K.side_scores(fx.game_scores(spark, sf)).join(g, "game_id")
    score = F.when(F.col("game_id") % 101 == 0, F.lit(float("nan"))).otherwise(F.col("score"))
    return rows.select(
        "game_id", "low", "color", score.alias("score"), "moves", "rating",
        F.when(F.col("color") == "white", F.col("white")).otherwise(F.col("black")).alias("player"),
    ).withColumn("problem", K.score_problem(F.col("score"), F.col("moves") * 2))


table("scored_sides", "game_scores games", """
 SELECT s.game_id, s.low, 'white' AS color, g.white AS player, s.white_score AS score, s.white_moves AS moves, s.white_rating AS rating FROM game_scores s JOIN games g USING (game_id)
 UNION ALL SELECT s.game_id, s.low, 'black', g.black, s.black_score, s.black_moves, s.black_rating FROM game_scores s JOIN games g USING (game_id)""")
table("player_report", "scored_sides", """
 SELECT player, count(*) AS matched_games, count(*) FILTER (game_id % 101 <> 0) AS analyzed_games, count(*) FILTER (game_id % 101 = 0) AS skipped_games,
        CAST(coalesce(sum(moves) FILTER (game_id % 101 <> 0), 0) AS BIGINT) AS moves,
        sum(score * moves) FILTER (game_id % 101 <> 0) / sum(moves) FILTER (game_id % 101 <> 0) AS mean_score, median(rating) AS median_recorded_rating FROM scored_sides GROUP BY 1""")
table("segments", "calibration", """
 SELECT * FROM (SELECT mean_score AS s0, center AS e0, lead(mean_score) OVER (ORDER BY mean_score) AS s1, lead(center) OVER (ORDER BY mean_score) AS e1,
   ROW_NUMBER() OVER (ORDER BY mean_score) AS k, count(*) OVER () AS n FROM calibration) WHERE s1 IS NOT NULL""")


def estimate_sql(source, score="mean_score"):
    """SQL of an interpolated rating for every row of `source`."""
    return f"""SELECT x.*, g.e0 + (x.{score} - g.s0) / (g.s1 - g.s0) * (g.e1 - g.e0) AS estimated_elo,
     CASE WHEN x.{score} < (SELECT min(s0) FROM segments) THEN 'extrapolated_below' WHEN x.{score} > (SELECT max(s1) FROM segments) THEN 'extrapolated_above' ELSE 'interpolated' END AS estimate_status
     FROM {source} x JOIN segments g ON g.k = coalesce((SELECT min(k) FROM segments WHERE x.{score} <= s1), g.n - 1)"""


@query("agg_03_calibration", "calibration", "SELECT low, high, center, games, moves, round(mean_score, 6) AS mean_score FROM calibration")
def _(spark, sf):
    return rounded(calibration(spark, sf))


@query("agg_18_calibration_line", "calibration line", """
SELECT round(max(slope) * 100, 6) AS score_per_100_elo, round(max(abs(r)), 6) AS max_abs_bucket_residual_elo, round(sqrt(avg(r * r)), 6) AS rms_bucket_residual_elo
FROM (SELECT slope, (mean_score - intercept) / slope - center AS r FROM calibration, line)""")
def _(spark, sf):
    return rounded(K.line_quality(calibration(spark, sf)))


@query("win_09_order_violations", "game_scores", """
, b AS (SELECT low + (game_id % 4) * 50 AS fine, sum(white_score * white_moves) / sum(white_moves) AS m FROM game_scores GROUP BY 1),
c AS (SELECT fine, m, lead(fine) OVER (ORDER BY fine) AS next_fine, lead(m) OVER (ORDER BY fine) AS next_m FROM b)
SELECT fine AS low, round(m, 6) AS mean_score, next_fine AS next_low, round(next_m, 6) AS next_mean FROM c WHERE m >= next_m""")
def _(spark, sf):
    fine = (F.col("low") + F.col("game_id") % 4 * 50).alias("low")
    means = fx.game_scores(spark, sf).groupBy(fine).agg(
        (F.sum(F.col("white_score") * F.col("white_moves")) / F.sum("white_moves")).alias("mean_score")
    ).withColumn("high", F.col("low") + 50)
    return rounded(K.order_violations(means), "low", "mean_score", "next_low", "next_mean")


@query("jn_12_interpolated_elo", "scored_sides segments calibration", ", e AS (" + estimate_sql("scored_sides", "score") + """)
SELECT game_id, color, round(estimated_elo, 6) AS estimated_elo, estimate_status FROM e""")
def _(spark, sf):
    rows = K.side_scores(fx.game_scores(spark, sf))
    return rounded(K.with_estimate(rows, calibration(spark, sf), "score"), "game_id", "color", "estimated_elo", "estimate_status")


@query("jn_13_nearest_bucket", "scored_sides calibration", """
SELECT s.game_id, s.color, arg_min(c.low, (abs(s.score - c.mean_score), c.low)) AS nearest FROM scored_sides s, calibration c GROUP BY 1, 2""")
def _(spark, sf):
    rows = K.side_scores(fx.game_scores(spark, sf)).withColumn("_b", K.buckets_constant(calibration(spark, sf)))
    return rows.select("game_id", "color", K.nearest_bucket(F.col("score"), F.col("_b"))["low"].alias("nearest"))


@query("jn_15_same_buckets", "cand queries", """
SELECT count(*) AS mismatches FROM ((SELECT DISTINCT low FROM cand EXCEPT SELECT DISTINCT low FROM queries) UNION ALL (SELECT DISTINCT low FROM queries EXCEPT SELECT DISTINCT low FROM cand))""")
def _(spark, sf):
    return K.same_buckets(fx.candidate_scores(spark, sf), fx.query_scores(spark, sf)).agg(F.count(F.lit(1)).alias("mismatches"))


@query("agg_05_player_report", "player_report", """
SELECT player, matched_games, analyzed_games, skipped_games, moves, round(mean_score, 6) AS mean_score, median_recorded_rating FROM player_report""")
def _(spark, sf):
    return rounded(K.player_report(player_sides_scored(spark, sf)))


@query("job_06_player_estimate", "player_report segments calibration", ", p AS (SELECT * FROM player_report WHERE mean_score IS NOT NULL), e AS (" + estimate_sql("p") + """),
 n AS (SELECT p.player, arg_min(c.low, (abs(p.mean_score - c.mean_score), c.low)) AS low FROM p, calibration c GROUP BY 1)
SELECT e.player, round(estimated_elo, 6) AS estimated_elo, estimate_status, n.low || '-' || (n.low + 200) AS nearest_bucket FROM e JOIN n USING (player)""")
def _(spark, sf):
    report = K.player_report(player_sides_scored(spark, sf)).filter("mean_score IS NOT NULL")
    return rounded(K.with_estimate(report, calibration(spark, sf)), "player", "estimated_elo", "estimate_status", "nearest_bucket")


@query("flt_19_non_finite_scores", "scored_sides", """
SELECT CASE WHEN game_id % 101 = 0 THEN 'non_finite_score' ELSE 'ok' END AS problem, count(*) AS n FROM scored_sides GROUP BY 1""")
def _(spark, sf):
    rows = player_sides_scored(spark, sf)
    return rows.groupBy(F.coalesce("problem", F.lit("ok")).alias("problem")).agg(F.count(F.lit(1)).alias("n"))


# Trials -----------------------------------------------------------------------------------------

table("entries", "queries", """
 SELECT low, game_id, 'white' AS color, white_score AS score, white_moves AS moves, white_rating AS rating FROM queries
 UNION ALL SELECT low, game_id, 'black', black_score, black_moves, black_rating FROM queries""")
table("pool", "entries", """
 SELECT *, ROW_NUMBER() OVER (PARTITION BY low ORDER BY md5('pool:' || game_id || ':' || color), game_id, color) AS draw, count(*) OVER (PARTITION BY low) AS pool FROM entries""")


def draws_sql(pool, group, seed, sizes=SIZES_SQL, trials=TRIALS):
    (p1, p2), powers = ordered.MODULI, ordered.generator_powers(max(SIZES))
    one, two = [a for a, _ in powers], [b for _, b in powers]
    cell = f"md5(concat_ws(':', '{seed}', s.size, p.{group}, t.trial))"
    return f"""SELECT {group}, size, trial, nth, ((s1 * {one}[nth + 1] % {p1}) * {p2} + s2 * {two}[nth + 1] % {p2}) % pool + 1 AS draw FROM (
     SELECT p.{group}, p.pool, s.size, t.trial, n.nth, CAST('0x' || substr({cell}, 1, 15) AS BIGINT) % {p1 - 1} + 1 AS s1, CAST('0x' || substr({cell}, 16, 15) AS BIGINT) % {p2 - 1} + 1 AS s2
     FROM (SELECT DISTINCT {group}, pool FROM {pool}) p, {sizes}, (SELECT range AS trial FROM range({trials})) t, LATERAL (SELECT unnest(range(s.size)) AS nth) n)"""


table("trial_draws", "pool", draws_sql("pool", "low", "trial"))
table("trial_means", "trial_draws pool", """
 SELECT d.size, d.low, d.trial, sum(p.score * p.moves) / sum(p.moves) AS score, avg(p.rating) AS true_elo FROM trial_draws d JOIN pool p USING (low, draw) GROUP BY 1, 2, 3""")
table("buckets", "calibration", "SELECT *, ROW_NUMBER() OVER (ORDER BY low) - 1 AS idx FROM calibration")


def trial_results_sql(means):
    return f"""SELECT m.*, (m.score - l.intercept) / l.slope AS estimated_elo, (SELECT arg_min(b.idx, (abs(m.score - b.mean_score), b.idx)) FROM buckets b) AS predicted_index,
      (SELECT idx FROM buckets b WHERE b.low = m.low) AS true_index FROM {means} m, line l"""


table("trial_results", "trial_means buckets line", trial_results_sql("trial_means"))


def trials(spark, sf):
    entries, stored = score_tables(spark, sf)
    return T.run_trials(entries, stored, SIZES, TRIALS, "trial")


OVERALL_SQL = """SELECT CAST(size AS INT) AS games_averaged, round(avg(CAST(predicted_index = true_index AS DOUBLE)), 6) AS accuracy_exact,
 round(avg(CAST(abs(predicted_index - true_index) <= 1 AS DOUBLE)), 6) AS accuracy_within_one_bucket, round(avg(estimated_elo - true_elo), 6) AS mean_signed_error,
 round(avg(abs(estimated_elo - true_elo)), 6) AS mean_absolute_error, round(sqrt(avg(pow(estimated_elo - true_elo, 2))), 6) AS rmse,
 round(regr_slope(estimated_elo, true_elo), 6) AS slope_estimated_vs_true FROM {} GROUP BY size"""


@query("smp_05_trials", "trial_results", """
SELECT CAST(size AS INT) AS size, low, CAST(trial AS INT) AS trial, round(score, 6) AS score, round(true_elo, 6) AS true_elo, round(estimated_elo, 5) AS estimated_elo, CAST(predicted_index AS INT) AS predicted_index FROM trial_results""")
def _(spark, sf):
    out = trials(spark, sf)
    return out.select(
        "size", "low", "trial", F.round("score", 6).alias("score"), F.round("true_elo", 6).alias("true_elo"),
        F.round("estimated_elo", 5).alias("estimated_elo"), "predicted_index",
    )


@query("agg_16_trial_summary", "trial_results", OVERALL_SQL.format("trial_results"))
def _(spark, sf):
    return rounded(T.overall_summary(trials(spark, sf)))


@query("agg_17_bucket_summary", "trial_results", """
SELECT CAST(size AS INT) AS games_averaged, low, round(avg(estimated_elo - true_elo), 6) AS mean_signed_error, round(stddev_pop(estimated_elo - true_elo), 6) AS error_std,
 round(avg(abs(estimated_elo - true_elo)), 6) AS mean_absolute_error, round(avg(CAST(predicted_index = true_index AS DOUBLE)), 6) AS accuracy_exact FROM trial_results GROUP BY 1, 2""")
def _(spark, sf):
    return rounded(T.bucket_summary(trials(spark, sf)))


@query("jn_14_pairwise_ordering", "trial_results", """
SELECT CAST(size AS INT) AS games_averaged, CAST(gap AS INT) AS bucket_gap, round(avg(w), 6) AS ordering_accuracy FROM (
 SELECT a.size, a.true_index - b.true_index AS gap, b.true_index, avg(CAST(a.score > b.score AS DOUBLE)) AS w FROM trial_results a JOIN trial_results b
  ON a.size = b.size AND a.trial = b.trial AND b.true_index < a.true_index GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def _(spark, sf):
    return rounded(T.pairwise_ordering(trials(spark, sf)))


table("game_pool", "queries", """
 SELECT *, ROW_NUMBER() OVER (PARTITION BY low ORDER BY md5('pool:' || game_id), game_id) AS draw, count(*) OVER (PARTITION BY low) AS pool FROM queries""")
table("two_stage_draws", "game_pool", draws_sql("game_pool", "low", "two"))
table("two_stage_means", "two_stage_draws game_pool", """
 SELECT size, low, trial, sum(score * moves) / sum(moves) AS score, avg(rating) AS true_elo FROM (
  SELECT d.size, d.low, d.trial, CASE WHEN w THEN white_score ELSE black_score END AS score, CASE WHEN w THEN white_moves ELSE black_moves END AS moves, CASE WHEN w THEN white_rating ELSE black_rating END AS rating
  FROM (SELECT *, CAST('0x' || substr(md5(concat_ws(':', 'two-side', size, low, trial, nth)), 1, 15) AS BIGINT) % 2 = 0 AS w FROM two_stage_draws) d JOIN game_pool p USING (low, draw)) GROUP BY 1, 2, 3""")
table("two_stage_results", "two_stage_means buckets line", trial_results_sql("two_stage_means"))


@query("smp_06_game_then_side", "two_stage_results", OVERALL_SQL.format("two_stage_results"))
def _(spark, sf):
    games = fx.query_scores(spark, sf)
    return rounded(T.overall_summary(T.two_stage_trials(games, calibration(spark, sf), SIZES, TRIALS, "two")))


for _mode, _allowed in T.TOLERANCE.items():

    def _curve(spark, sf, mode=_mode):
        return rounded(T.accuracy_curve(trials(spark, sf), mode))

    _set = ", ".join(str(x) for x in (0, *_allowed))
    _name = {"+/-0": "exact", "+/-1": "within_one", "+1": "plus_one", "-1": "minus_one"}[_mode]
    query(f"agg_30_accuracy_curve_{_name}", "trial_results", f"""
, a AS (SELECT CAST(size AS INT) AS size, low, avg(CAST(predicted_index - true_index IN ({_set}) AS DOUBLE)) AS accuracy FROM trial_results GROUP BY 1, 2)
SELECT size, low, round(accuracy, 6) AS accuracy FROM a UNION ALL SELECT size, -1, round(avg(accuracy), 6) FROM a GROUP BY 1""")(_curve)


# Phases -----------------------------------------------------------------------------------------

table("phase_totals", "move_scores", "SELECT game_id, color, phase, sum(score) AS score_sum, count(*) AS n_moves FROM move_scores GROUP BY 1, 2, 3")
table("phase_rows", "phase_totals binned", """
 SELECT t.*, 1000 + 200 * bbin AS low, 1200 + 200 * bbin AS high, b.white_elo AS white_rating, b.black_elo AS black_rating, b.white, b.black,
  CASE WHEN t.game_id % 3 = 0 THEN 'cand' ELSE 'query' END AS split FROM phase_totals t JOIN binned b USING (game_id) WHERE bbin IS NOT NULL""")


def phase_rows(spark, sf):
    totals = PH.phase_totals(fx.move_scores(spark, sf))
    low = F.lit(1000) + 200 * C.elo_bin(F.col("black_elo"), fx.BINS_200)
    g = fx.games(spark, sf).select(
        "game_id", low.alias("low"), (low + 200).alias("high"), F.col("white_elo").alias("white_rating"),
        F.col("black_elo").alias("black_rating"), "white", "black",
    ).filter("low IS NOT NULL")
    return totals.join(g, "game_id").withColumn("split", F.when(F.col("game_id") % 3 == 0, "cand").otherwise("query"))


@query("agg_07_phase_table", "move_scores", "SELECT phase, round(avg(score), 6) AS average_strength, count(*) AS move_count FROM move_scores GROUP BY 1")
def _(spark, sf):
    return rounded(PH.phase_table(fx.move_scores(spark, sf)))


@query("agg_06_position_map", "move_scores", "SELECT fen_before, move, round(avg(score), 6) AS average_strength, count(*) AS n FROM move_scores GROUP BY 1, 2")
def _(spark, sf):
    return rounded(PH.position_map(fx.move_scores(spark, sf)))


@query("agg_08_phase_totals", "phase_totals", "SELECT game_id, color, phase, round(score_sum, 6) AS score_sum, n_moves FROM phase_totals")
def _(spark, sf):
    return rounded(PH.phase_totals(fx.move_scores(spark, sf)))


table("phase_pooled", "phase_rows", """
 SELECT player, phase, sum(score_sum) / sum(n_moves) AS mean_score, CAST(sum(n_moves) AS BIGINT) AS n_moves FROM (
  SELECT *, CASE WHEN color = 'white' THEN white ELSE black END AS player FROM phase_rows WHERE split = 'query') GROUP BY 1, 2""")
table("phase_elo", "phase_pooled segments", estimate_sql("phase_pooled"))
table("reference_pooled", "phase_rows", "SELECT phase, sum(score_sum) / sum(n_moves) AS mean_score FROM phase_rows WHERE split = 'cand' GROUP BY 1")
table("reference", "reference_pooled segments", f"SELECT phase, estimated_elo AS phase_elo, avg(estimated_elo) OVER () AS mean_elo FROM ({estimate_sql('reference_pooled')})")
table("phase_norm", "phase_elo reference", "SELECT e.*, e.estimated_elo - r.phase_elo + r.mean_elo AS norm FROM phase_elo e JOIN reference r USING (phase)")
table("phase_report", "phase_norm", "SELECT player, " + ", ".join(
    f"max(estimated_elo) FILTER (phase = '{p}') AS {p}_elo, max(norm) FILTER (phase = '{p}') AS {p}_norm_elo, CAST(coalesce(max(n_moves) FILTER (phase = '{p}'), 0) AS BIGINT) AS {p}_moves" for p in PH.PHASES
) + ", CASE WHEN count(*) = 3 THEN avg(estimated_elo) END AS total_elo FROM phase_norm GROUP BY 1")


def phase_report(spark, sf):
    rows, cal = phase_rows(spark, sf), calibration(spark, sf)
    reference = PH.phase_reference(rows.filter("split = 'cand'"), cal)
    mine = rows.filter("split = 'query'").withColumn("player", F.when(F.col("color") == "white", F.col("white")).otherwise(F.col("black")))
    return PH.phase_report(mine, cal, reference)


@query("agg_09_phase_report", "phase_report", "SELECT player, " + ", ".join(
    f"round({p}_elo, 5) AS {p}_elo, round({p}_norm_elo, 5) AS {p}_norm_elo, {p}_moves" for p in PH.PHASES) + ", round(total_elo, 5) AS total_elo FROM phase_report")
def _(spark, sf):
    return rounded(phase_report(spark, sf), digits=5)


@query("jn_17_phase_shift", "phase_norm", "SELECT player, phase, round(norm, 5) AS phase_norm_elo FROM phase_norm")
def _(spark, sf):
    rows, cal = phase_rows(spark, sf), calibration(spark, sf)
    reference = PH.phase_reference(rows.filter("split = 'cand'"), cal)
    mine = rows.filter("split = 'query'").withColumn("player", F.when(F.col("color") == "white", F.col("white")).otherwise(F.col("black")))
    out = PH.shift_by_reference(PH.phase_ratings(mine, cal, "player"), reference)
    return rounded(out, "player", "phase", "phase_norm_elo", digits=5)


@query("top_04_phase_gap_ranking", "phase_report", """
SELECT player, round(midgame_norm_elo - endgame_norm_elo, 5) AS midgame_minus_endgame FROM phase_report WHERE total_elo IS NOT NULL ORDER BY 2 DESC""")
def _(spark, sf):
    return rounded(PH.phase_gap_ranking(phase_report(spark, sf)), "player", "midgame_minus_endgame", digits=5)


@query("win_21_site_rating", "sides", """
SELECT player, round(avg(elo), 6) AS site_rating FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY player ORDER BY game_id) AS rn FROM sides) WHERE rn <= 20 GROUP BY 1""")
def _(spark, sf):
    rows = C.sides(fx.games(spark, sf)).withColumn("line_no", F.col("game_id"))
    return rounded(PH.site_ratings(rows))


table("phase_cal", "phase_rows", """
 SELECT phase, low, high, (low + high) / 2.0::DOUBLE AS center, sum(score_sum) / sum(n_moves) AS mean_score FROM phase_rows WHERE split = 'cand' GROUP BY 1, 2, 3""")
table("phase_lines", "phase_cal", "SELECT phase, regr_slope(mean_score, center) AS slope, regr_intercept(mean_score, center) AS intercept FROM phase_cal GROUP BY 1")
table("one_line", "line", "SELECT phase, slope, intercept FROM line, (VALUES ('opening'), ('midgame'), ('endgame')) p(phase)")
table("gap_pooled", "phase_rows", "SELECT low, high, phase, CAST(sum(n_moves) AS BIGINT) AS moves, sum(score_sum) / sum(n_moves) AS mean_phase_score FROM phase_rows WHERE split = 'query' GROUP BY 1, 2, 3")
table("gap_ratings", "phase_rows", "SELECT low, avg((white_rating + black_rating) / 2.0) AS true_rating, count(*) AS games FROM (SELECT DISTINCT low, game_id, white_rating, black_rating FROM phase_rows WHERE split = 'query') GROUP BY 1")
table("phase_gaps", "gap_pooled gap_ratings one_line", """
 SELECT *, estimated_elo - true_rating AS error_vs_true_rating, gap_vs_phase_average - avg(gap_vs_phase_average) OVER (PARTITION BY phase) AS gap_centered FROM (
  SELECT p.*, r.true_rating, r.games, (mean_phase_score - intercept) / slope AS estimated_elo, (mean_phase_score - intercept) / slope - avg((mean_phase_score - intercept) / slope) OVER (PARTITION BY low) AS gap_vs_phase_average
  FROM gap_pooled p JOIN gap_ratings r USING (low) JOIN one_line l USING (phase))""")


def phase_gaps(spark, sf):
    rows = phase_rows(spark, sf).filter("split = 'query'")
    return PH.phase_gaps(rows, PH.same_line_for_all(K.fit_line(calibration(spark, sf))))


@query("agg_10_phase_calibrations", "phase_cal", "SELECT phase, low, high, center, round(mean_score, 6) AS mean_score FROM phase_cal")
def _(spark, sf):
    return rounded(PH.phase_calibrations(phase_rows(spark, sf).filter("split = 'cand'")))


@query("agg_11_phase_gaps", "phase_gaps", """
SELECT low, phase, games, moves, round(mean_phase_score, 6) AS mean_phase_score, round(estimated_elo, 5) AS estimated_elo, round(true_rating, 5) AS true_rating, round(error_vs_true_rating, 5) AS error_vs_true_rating, round(gap_vs_phase_average, 5) AS gap_vs_phase_average FROM phase_gaps""")
def _(spark, sf):
    out = phase_gaps(spark, sf)
    five = [F.round(c, 5).alias(c) for c in ("estimated_elo", "true_rating", "error_vs_true_rating", "gap_vs_phase_average")]
    return out.select("low", "phase", "games", "moves", F.round("mean_phase_score", 6).alias("mean_phase_score"), *five)


@query("win_20_centred_gap", "phase_gaps", "SELECT low, phase, round(gap_centered, 5) AS gap_centered FROM phase_gaps")
def _(spark, sf):
    return rounded(phase_gaps(spark, sf), "low", "phase", "gap_centered", digits=5)


@query("agg_12_phase_summary", "phase_gaps", """
SELECT phase, round(avg(gap_vs_phase_average), 5) AS mean_gap, round(avg(abs(gap_vs_phase_average)), 5) AS mean_abs_gap, round(avg(error_vs_true_rating), 5) AS mean_error_vs_true_rating FROM phase_gaps GROUP BY 1""")
def _(spark, sf):
    return rounded(PH.phase_summary(phase_gaps(spark, sf)), digits=5)


@query("unn_05_bucket_phase_pivot", "phase_gaps", "SELECT low, " + ", ".join(f"max(round(gap_vs_phase_average, 5)) FILTER (phase = '{p}') AS {p}" for p in PH.PHASES) + " FROM phase_gaps GROUP BY 1")
def _(spark, sf):
    return rounded(PH.phase_pivot(phase_gaps(spark, sf), "gap_vs_phase_average"), digits=5)


BOOT = 200
table("boot_games", "phase_rows", "SELECT low, game_id, " + ", ".join(
    f"sum(CASE WHEN phase = '{p}' THEN score_sum ELSE 0 END) AS {p}_s, sum(CASE WHEN phase = '{p}' THEN n_moves ELSE 0 END) AS {p}_n" for p in PH.PHASES) + " FROM phase_rows WHERE split = 'query' GROUP BY 1, 2")
table("boot_pool", "boot_games", f"""
 SELECT *, ROW_NUMBER() OVER (PARTITION BY low, leaf ORDER BY h, game_id) - 1 AS place, count(*) OVER (PARTITION BY low, leaf) AS m FROM (
  SELECT *, bits >> ({RS.HASH_BITS} - depth) AS leaf FROM (
   SELECT *, CASE WHEN (pool - 1) // {RS.LEAF} = 0 THEN 0 ELSE length(bin((pool - 1) // {RS.LEAF})) END AS depth FROM (
    SELECT *, md5('tree:' || game_id) AS h, CAST('0x' || substr(md5('tree:' || game_id), 1, 15) AS BIGINT) AS bits, count(*) OVER (PARTITION BY low) AS pool FROM boot_games)))""")
table("boot_node", "boot_pool", f"""
 SELECT low, level, bits >> ({RS.HASH_BITS} - level) AS node, count(*) AS whole, count(*) FILTER (((bits >> ({RS.HASH_BITS - 1} - level)) & 1) = 0) AS lft
 FROM boot_pool JOIN (SELECT range AS level FROM range({RS.HASH_BITS})) ON level < depth GROUP BY 1, 2, 3""")


def boot_draws_sql():
    """Counts of draws from the root of each group to its leaves, then the draws inside the leaves."""
    (p1, p2), powers = ordered.MODULI, ordered.generator_powers(RS.COUNTED)
    one, two = [a for a, _ in powers], [b for _, b in powers]
    state = lambda text, at, p: f"CAST('0x' || substr(md5({text}), {at}, 15) AS BIGINT) % {p - 1} + 1"
    node = "concat_ws(':', 'boot', low, level, node, replicate)"
    value = lambda k: f"((s1 * {one}[{k} + 1] % {p1}) * {p2} + s2 * {two}[{k} + 1] % {p2})"
    table("boot_split", "boot_node", f"""WITH RECURSIVE t AS (
     SELECT DISTINCT low, replicate, 0::BIGINT AS level, 0::BIGINT AS node, pool AS d, depth FROM boot_pool, (SELECT range AS replicate FROM range({BOOT}))
     UNION ALL SELECT low, replicate, level + 1, node * 2 + side, CASE side WHEN 0 THEN b ELSE d - b END, depth FROM (
      SELECT *, CASE WHEN d <= {RS.COUNTED} THEN len(list_filter(range(d), lambda k: {value('k')} % whole < lft))
       ELSE least(d, greatest(0, CAST(floor(d * (lft::DOUBLE / whole) + z * sqrt(d * (lft::DOUBLE / whole) * (1.0::DOUBLE - lft::DOUBLE / whole)) + 0.5::DOUBLE) AS BIGINT))) END AS b FROM (
       SELECT t.*, whole, lft, {state(node + " || ':0'", 1, p1)} AS s1, {state(node + " || ':0'", 16, p2)} AS s2,
        sqrt(-2.0::DOUBLE * ln(({state(node, 1, p1)})::DOUBLE / {p1})) * cos(2 * pi() * (({state(node, 16, p2)})::DOUBLE / {p2})) AS z
       FROM t JOIN boot_node USING (low, level, node))), (VALUES (0), (1)) v(side))
     SELECT low, replicate, node AS leaf, d FROM t WHERE level = depth""")
    text = f"concat_ws(':', 'boot', 'leaf', low, leaf, replicate, k // {RS.COUNTED})"
    table("boot_draws", "boot_split", f"""
     SELECT low, replicate, leaf, {value(f'k % {RS.COUNTED}')} % m AS place FROM (
      SELECT *, {state(text, 1, p1)} AS s1, {state(text, 16, p2)} AS s2 FROM (SELECT *, unnest(range(d)) AS k FROM boot_split JOIN (SELECT DISTINCT low, leaf, m FROM boot_pool) USING (low, leaf)))""")


boot_draws_sql()
table("boot_sums", "boot_draws", f"""
 SELECT low, replicate, {', '.join(f'sum({p}_s) / sum({p}_n) AS {p}' for p in PH.PHASES)} FROM boot_draws JOIN boot_pool USING (low, leaf, place) GROUP BY 1, 2""")


@query("smp_07_bootstrap_gap_error", "boot_sums one_line", """
, long AS (SELECT low, replicate, phase, (CASE phase WHEN 'opening' THEN opening WHEN 'midgame' THEN midgame ELSE endgame END - intercept) / slope AS e FROM boot_sums, one_line),
g AS (SELECT low, phase, e - avg(e) OVER (PARTITION BY low, replicate) AS gap FROM long)
SELECT low, phase, round(stddev_pop(gap), 4) AS gap_se FROM g GROUP BY 1, 2""")
def _(spark, sf):
    rows = phase_rows(spark, sf).filter("split = 'query'")
    lines = PH.same_line_for_all(K.fit_line(calibration(spark, sf)))
    return rounded(PH.gap_errors(rows, lines, BOOT, "boot"), digits=4)


table("phase_entries", "phase_rows", "SELECT low, game_id, color, max(CASE WHEN color = 'white' THEN white_rating ELSE black_rating END) AS rating, " + ", ".join(
    f"sum(CASE WHEN phase = '{p}' THEN score_sum ELSE 0 END) AS {p}_s, sum(CASE WHEN phase = '{p}' THEN n_moves ELSE 0 END) AS {p}_n" for p in PH.PHASES) + " FROM phase_rows WHERE split = 'query' GROUP BY 1, 2, 3")
table("phase_pool", "phase_entries", "SELECT *, ROW_NUMBER() OVER (PARTITION BY low ORDER BY md5('pool:' || game_id || ':' || color), game_id, color) AS draw, count(*) OVER (PARTITION BY low) AS pool FROM phase_entries")
table("phase_draws", "phase_pool", draws_sql("phase_pool", "low", "phase"))
table("phase_trials", "phase_draws phase_pool", "SELECT size, low, trial, avg(rating) AS true_elo, " + ", ".join(f"sum({p}_s) AS {p}_s, sum({p}_n) AS {p}_n" for p in PH.PHASES) + " FROM phase_draws JOIN phase_pool USING (low, draw) GROUP BY 1, 2, 3")
table("phase_long", "phase_trials", " UNION ALL ".join(f"SELECT size, low, trial, true_elo, '{p}' AS phase, {p}_n AS n, CASE WHEN {p}_n > 0 THEN {p}_s / {p}_n END AS score FROM phase_trials" for p in PH.PHASES))
table("phase_buckets", "phase_cal", "SELECT *, ROW_NUMBER() OVER (PARTITION BY phase ORDER BY low) - 1 AS idx FROM phase_cal")


@query("agg_43_phase_accuracy", "phase_long phase_buckets phase_lines", """
, r AS (SELECT l.*, (SELECT arg_min(b.idx, (abs(l.score - b.mean_score), b.idx)) FROM phase_buckets b WHERE b.phase = l.phase) AS pred, (SELECT idx FROM phase_buckets b WHERE b.phase = l.phase AND b.low = l.low) AS truth,
  (l.score - n.intercept) / n.slope - l.true_elo AS err FROM phase_long l JOIN phase_lines n USING (phase))
SELECT phase, CAST(size AS INT) AS games_averaged, round(avg(CAST(pred = truth AS DOUBLE)) FILTER (n > 0), 6) AS accuracy_exact, round(avg(CAST(abs(pred - truth) <= 1 AS DOUBLE)) FILTER (n > 0), 6) AS accuracy_within_one_bucket,
 round(avg(err) FILTER (n > 0), 4) AS mean_signed_error, round(avg(abs(err)) FILTER (n > 0), 4) AS mean_absolute_error, round(avg(CAST(n > 0 AS DOUBLE)), 6) AS fraction_trials_with_phase_moves FROM r GROUP BY 1, 2""")
def _(spark, sf):
    rows = phase_rows(spark, sf)
    entries = PH.phase_entries(rows.filter("split = 'query'"))
    out = PH.phase_accuracy(entries, PH.phase_calibrations(rows.filter("split = 'cand'")), SIZES, TRIALS, "phase")
    four = {"mean_signed_error", "mean_absolute_error"}
    return out.select(*[F.round(c, 4 if c in four else 6).alias(c) if c not in ("phase", "games_averaged") else F.col(c) for c in out.columns])
