"""Registered queries: rating functions, context join, predictions, metrics."""

from pyspark.sql import functions as F

from duelgauge import fixtures as fx
from duelgauge.functions import rating as R
from duelgauge.operators import context as X
from duelgauge.operators import corpus as C
from duelgauge.operators import predict as P
from duelgauge.plans.registry import query, table

N = 8
POLICY = C.ContextPolicy(context_size=N)
CAP = 3

table("baseline", "games", """
 SELECT *, 0.96::DOUBLE / (1 + exp(-((white_elo - black_elo) / 400.0::DOUBLE))) AS p_white, 0.04::DOUBLE AS p_draw,
        0.96::DOUBLE / (1 + exp((white_elo - black_elo) / 400.0::DOUBLE)) AS p_black FROM games""")
table("predicted", "baseline", """
 SELECT *, CAST(CASE WHEN p_white >= p_draw AND p_white >= p_black THEN 1 WHEN p_draw >= p_black THEN 0 ELSE -1 END AS BIGINT) AS predicted,
        -ln(greatest(CASE WHEN result > 0 THEN p_white WHEN result = 0 THEN p_draw ELSE p_black END, 1e-15)) AS ll,
        pow(CAST(result > 0 AS INT) - p_white, 2) + pow(CAST(result = 0 AS INT) - p_draw, 2) + pow(CAST(result < 0 AS INT) - p_black, 2) AS br FROM baseline""")
table("eligible", "sides", """
 SELECT s.*, ROW_NUMBER() OVER (PARTITION BY player ORDER BY played_at, game_id) AS rn FROM sides s
 WHERE event = 'Blitz' AND elo BETWEEN 1000 AND 3000 AND opponent_elo BETWEEN 1000 AND 3000""")
table("targets", "policy eligible", """
 SELECT g.game_id, g.played_at, s.color AS side, s.player,
        (SELECT count(*) FROM eligible e WHERE e.player = s.player AND e.played_at < g.played_at) AS n_before
 FROM policy g JOIN sides s USING (game_id) WHERE g.reason IS NULL""")
table("context", "targets eligible", f"""
 SELECT t.game_id, t.side, e.game_id AS context_id, e.color, e.outcome, e.rn, e.rn - (t.n_before - {N}) AS weight
 FROM targets t JOIN eligible e ON e.player = t.player AND e.rn > t.n_before - {N} AND e.rn <= t.n_before WHERE t.n_before >= {N}""")
table("example_reasons", "policy targets", f"""
 SELECT g.game_id, g.played_at, g.white, g.black, coalesce(g.reason, CASE WHEN w.n_before < {N} THEN 'white_insufficient_context' WHEN b.n_before < {N} THEN 'black_insufficient_context' END) AS reason,
        g.reason AS policy_reason
 FROM policy g LEFT JOIN targets w ON w.game_id = g.game_id AND w.side = 'white' LEFT JOIN targets b ON b.game_id = g.game_id AND b.side = 'black'""")
table("side_scores", "games", """
 SELECT game_id, 'white' AS color, (white_elo - 1400) / 2011.0::DOUBLE + ((game_id * 31) % 101 - 50) / 1013.0::DOUBLE AS score FROM games
 UNION ALL SELECT game_id, 'black', (black_elo - 1400) / 2011.0::DOUBLE + ((game_id * 37) % 101 - 50) / 1013.0::DOUBLE FROM games""")


def side_scores(spark, sf):
    """A closed-form per-side game score standing in for the supplied scorer."""
    part = lambda s, k: F.struct(
        F.lit(s).alias("color"),
        ((F.col(f"{s}_elo") - 1400) / F.lit(2011.0) + ((F.col("game_id") * k) % 101 - 50) / F.lit(1013.0)).alias("score"),
    )
    rows = fx.games(spark, sf).select("game_id", F.explode(F.array(part("white", 31), part("black", 37))).alias("s"))
    return rows.select("game_id", "s.*")


def baseline(spark, sf):
    return P.with_prediction(fx.games(spark, sf), R.rating_baseline(F.col("white_elo"), F.col("black_elo")))


def examples(spark, sf, **kw):
    return X.build_examples(fx.games(spark, sf), POLICY, **kw)


@query("scl_04_strength_to_probs", "games", """
SELECT game_id, round(0.9::DOUBLE / (1 + exp(-d)), 6) AS p_white, 0.1::DOUBLE AS p_draw, round(0.9::DOUBLE / (1 + exp(d)), 6) AS p_black,
 CAST(CASE WHEN 0.9::DOUBLE / (1 + exp(-d)) >= 0.9::DOUBLE / (1 + exp(d)) THEN 1 ELSE -1 END AS BIGINT) AS predicted FROM (SELECT game_id, 0.5::DOUBLE * ((white_elo - 1500) / 300.0::DOUBLE - (black_elo - 1500) / 300.0::DOUBLE) + 0.05::DOUBLE AS d FROM games)""")
def _(spark, sf):
    unit = lambda c: (F.col(c) - 1500) / F.lit(300.0)
    triple = R.strength_to_probs(unit("white_elo"), unit("black_elo"), 0.1, 0.5, 0.05)
    out = P.with_prediction(fx.games(spark, sf).select("game_id", "white_elo", "black_elo"), triple)
    return out.select("game_id", F.round("p_white", 6).alias("p_white"), "p_draw", F.round("p_black", 6).alias("p_black"), "predicted")


@query("scl_05_elo_to_probs", "games", """
SELECT game_id, round(0.96::DOUBLE * e, 6) AS p_white, round(0.96::DOUBLE * (1 - e), 6) AS p_black FROM (
 SELECT game_id, 1 / (1 + pow(10.0::DOUBLE, (black_elo - white_elo) / 400.0::DOUBLE)) AS e FROM games)""")
def _(spark, sf):
    out = P.with_prediction(fx.games(spark, sf), R.elo_to_probs(F.col("white_elo"), F.col("black_elo")))
    return out.select("game_id", F.round("p_white", 6).alias("p_white"), F.round("p_black", 6).alias("p_black"))


@query("scl_06_rating_baseline", "predicted", "SELECT game_id, round(p_white, 6) AS p_white, p_draw, round(p_black, 6) AS p_black, predicted FROM predicted")
def _(spark, sf):
    return baseline(spark, sf).select("game_id", F.round("p_white", 6).alias("p_white"), "p_draw", F.round("p_black", 6).alias("p_black"), "predicted")


@query("scl_02_result_parse", "games", "SELECT game_id, CASE WHEN game_id % 2 = 0 THEN result ELSE result END AS sign FROM games")
def _(spark, sf):
    pgn = F.when(F.col("result") > 0, "1-0").when(F.col("result") < 0, "0-1").otherwise("1/2-1/2")
    raw = F.when(F.col("game_id") % 2 == 0, pgn).otherwise(F.col("result").cast("double").cast("string"))
    return fx.games(spark, sf).select("game_id", R.result_sign(raw).alias("sign"))


@query("scl_03_target_perspective", "sides", """
SELECT game_id, color, elo, opponent_elo, CASE WHEN outcome > 0 THEN 'win' WHEN outcome < 0 THEN 'loss' ELSE 'draw' END AS outcome FROM sides""")
def _(spark, sf):
    return C.sides(fx.games(spark, sf)).select("game_id", "color", "elo", "opponent_elo", R.outcome_name(F.col("outcome")).alias("outcome"))


@query("scl_10_buckets", "games", """
SELECT game_id, CAST(e AS VARCHAR) || '-' || CAST(e + 200 AS VARCHAR) AS elo_bucket, CAST(d AS VARCHAR) || '-' || CAST(d + 30 AS VARCHAR) AS diff_bucket, m AS month
FROM (SELECT game_id, CAST(floor(floor((white_elo + black_elo) / 2.0) / 200.0) * 200 AS BIGINT) AS e, CAST(floor(abs(white_elo - black_elo) / 30.0) * 30 AS BIGINT) AS d, strftime(played_at, '%Y-%m') AS m FROM games)""")
def _(spark, sf):
    w, b = F.col("white_elo"), F.col("black_elo")
    return fx.games(spark, sf).select(
        "game_id", R.elo_bucket(w, b).alias("elo_bucket"), R.difference_bucket(w, b).alias("diff_bucket"), R.month_bucket(F.col("played_at")).alias("month")
    )


@query("scl_11_loss_terms", "predicted", "SELECT game_id, round(ll, 6) AS log_loss, round(br, 6) AS brier FROM predicted")
def _(spark, sf):
    t = [F.col(c) for c in ("result", *P.PROBABILITIES)]
    return baseline(spark, sf).select("game_id", F.round(R.log_loss(*t), 6).alias("log_loss"), F.round(R.brier(*t), 6).alias("brier"))


@query("scl_24_winner_view", "predicted", """
SELECT game_id, result AS sign, round(CASE WHEN result > 0 THEN p_white ELSE p_black END, 6) AS winner_probability FROM predicted WHERE result <> 0""")
def _(spark, sf):
    won = baseline(spark, sf).filter("result != 0")
    return won.select(
        "game_id", R.winner_sign(F.col("result")).alias("sign"),
        F.round(R.winner_probability(F.col("result"), F.col("p_white"), F.col("p_black")), 6).alias("winner_probability"),
    )


@query("flt_17_probability_checks", "predicted", """
SELECT count(*) AS violations FROM predicted WHERE p_white < 0 OR p_white > 1 OR p_black < 0 OR p_black > 1 OR abs(p_white + p_draw + p_black - 1) > 1e-5""")
def _(spark, sf):
    return P.probability_violations(baseline(spark, sf)).agg(F.count(F.lit(1)).alias("violations"))


@query("jn_10_strict_prediction_join", "games", """
SELECT count(*) FILTER (have > 1) AS duplicate, count(*) FILTER (have = 0) AS missing, 0::BIGINT AS unknown FROM (
 SELECT CASE WHEN game_id % 97 = 0 THEN 0 WHEN game_id % 89 = 0 THEN 2 ELSE 1 END AS have FROM games)""")
def _(spark, sf):
    g = fx.games(spark, sf).select("game_id")
    copies = F.when(F.col("game_id") % 97 == 0, 0).when(F.col("game_id") % 89 == 0, 2).otherwise(1)
    predictions = g.select("game_id", F.explode(F.array_repeat(F.lit(1), copies)).alias("p"))
    return P.join_violations(g, predictions)


@query("agg_13_prediction_metrics", "predicted", """
SELECT count(*) AS n_examples, round(avg(CAST(predicted = result AS DOUBLE)), 6) AS accuracy, round(avg(CAST(result = 0 AS DOUBLE)), 6) AS draw_rate,
 round(avg(ll), 6) AS log_loss, round(avg(br), 6) AS brier_score FROM predicted""")
def _(spark, sf):
    return P.metrics(baseline(spark, sf))


@query("agg_14_slice_metrics", "predicted", """
SELECT * FROM (
 SELECT 'elo_bucket' AS slice, e || '-' || (e + 200) AS bucket, round(avg(hit), 6) AS accuracy, count(*) AS n FROM (SELECT CAST(floor(floor((white_elo + black_elo) / 2.0) / 200.0) * 200 AS BIGINT) AS e, CAST(predicted = result AS DOUBLE) AS hit FROM predicted) GROUP BY e
 UNION ALL SELECT 'elo_diff_bucket', d || '-' || (d + 30), round(avg(hit), 6), count(*) FROM (SELECT CAST(floor(abs(white_elo - black_elo) / 30.0) * 30 AS BIGINT) AS d, CAST(predicted = result AS DOUBLE) AS hit FROM predicted) GROUP BY d
 UNION ALL SELECT 'month', strftime(played_at, '%Y-%m'), round(avg(CAST(predicted = result AS DOUBLE)), 6), count(*) FROM predicted GROUP BY 2
 UNION ALL SELECT 'context_size', '8', round(avg(CAST(predicted = result AS DOUBLE)), 6), count(*) FROM predicted) WHERE n >= 20""")
def _(spark, sf):
    return P.slice_metrics(baseline(spark, sf).withColumn("context_size", F.lit(N)))


@query("jn_02_context_join", "context", "SELECT game_id, side, context_id, color, outcome FROM context WHERE game_id IN (SELECT game_id FROM context GROUP BY 1 HAVING count(DISTINCT side) = 2)")
def _(spark, sf):
    made = examples(spark, sf).filter("reason IS NULL")
    return X.context_rows(made).join(
        C.sides(fx.games(spark, sf)).select(F.col("game_id").alias("context_id"), "color", "outcome"), ["context_id", "color"]
    ).select("game_id", "side", "context_id", "color", "outcome")


@query("win_02_last_n_games", "context", """
SELECT game_id, side, string_agg(CAST(context_id AS VARCHAR), ',' ORDER BY rn) AS context_ids FROM context
 WHERE game_id IN (SELECT game_id FROM context GROUP BY 1 HAVING count(DISTINCT side) = 2) GROUP BY 1, 2""")
def _(spark, sf):
    made = examples(spark, sf).filter("reason IS NULL")
    listed = lambda s: F.struct(F.lit(s).alias("side"), F.concat_ws(",", F.transform(F.col(f"{s}_context"), lambda c: c.game_id.cast("string"))).alias("context_ids"))
    return made.select("game_id", F.explode(F.array(listed("white"), listed("black"))).alias("r")).select("game_id", "r.*")


@query("job_04_example_exclusions", "example_reasons", """
SELECT k.reason, count(e.game_id) AS n FROM (VALUES ('unsupported_event'), ('invalid_result'), ('missing_player'), ('missing_rating'), ('rating_out_of_range'),
 ('duplicate_game'), ('white_insufficient_context'), ('black_insufficient_context'), ('context_too_old'), ('ambiguous_same_day_order'), ('max_predictions_per_player')) k(reason)
 LEFT JOIN example_reasons e USING (reason) GROUP BY 1""")
def _(spark, sf):
    return X.exclusion_counts(examples(spark, sf))


table("aged", "policy eligible", """
 SELECT g.game_id, s.color AS side, string_agg(CAST(e.game_id AS VARCHAR), ',' ORDER BY e.rn) AS ids, min(e.played_at) AS oldest, any_value(g.played_at) AS day FROM policy g JOIN sides s USING (game_id)
 JOIN eligible e ON e.player = s.player AND e.played_at <= g.played_at - 3 AND e.rn > (SELECT count(*) FROM eligible x WHERE x.player = s.player AND x.played_at <= g.played_at - 3) - 2 WHERE g.reason IS NULL GROUP BY 1, 2 HAVING count(*) = 2""")


@query("jn_02_context_age_window", "aged", """
SELECT w.game_id, w.ids AS white_ids, b.ids AS black_ids FROM aged w JOIN aged b USING (game_id) WHERE w.side = 'white' AND b.side = 'black' AND w.day - w.oldest <= 400 AND b.day - b.oldest <= 400""")
def _(spark, sf):
    policy = C.ContextPolicy(context_size=2, min_context_age_seconds=200_000, max_context_age_days=400)
    made = X.build_examples(fx.games(spark, sf), policy).filter("reason IS NULL")
    ids = lambda s: F.concat_ws(",", F.transform(F.col(f"{s}_context"), lambda c: c.game_id.cast("string"))).alias(f"{s}_ids")
    return made.select("game_id", ids("white"), ids("black"))


@query("win_13_prediction_cap", "example_reasons", f"""
, usable AS (SELECT game_id, played_at, p.player FROM example_reasons e, LATERAL (SELECT e.white AS player UNION ALL SELECT e.black) p WHERE e.reason IS NULL),
asked AS (SELECT game_id, played_at, p.player FROM example_reasons e, LATERAL (SELECT e.white AS player UNION ALL SELECT e.black) p WHERE e.policy_reason IS NULL),
prior AS (SELECT a.game_id, a.player, count(u.game_id) AS n FROM asked a LEFT JOIN usable u ON u.player = a.player AND (u.played_at < a.played_at OR (u.played_at = a.played_at AND u.game_id < a.game_id)) GROUP BY 1, 2)
SELECT r.game_id, CASE WHEN r.policy_reason IS NULL AND m.n >= {CAP} THEN 'max_predictions_per_player' ELSE coalesce(r.reason, 'ok') END AS reason
FROM example_reasons r LEFT JOIN (SELECT game_id, max(n) AS n FROM prior GROUP BY 1) m USING (game_id)""")
def _(spark, sf):
    policy = C.ContextPolicy(context_size=N, max_predictions_per_player=CAP)
    made = X.build_examples(fx.games(spark, sf), policy)
    return made.select("game_id", F.coalesce("reason", F.lit("ok")).alias("reason"))


table("cap_walk", "example_reasons", f"""
 WITH RECURSIVE u AS (SELECT ROW_NUMBER() OVER (ORDER BY played_at, game_id) AS i, game_id, white, black FROM example_reasons WHERE reason IS NULL),
 walk AS (SELECT 0::BIGINT AS i, -1::BIGINT AS game_id, false AS ok, MAP([]::VARCHAR[], []::INT[]) AS c
  UNION ALL SELECT x.i, x.game_id, x.ok, CASE WHEN x.ok THEN map_concat(x.c, MAP([x.white, x.black], [x.wn + 1, x.bn + 1])) ELSE x.c END FROM (
   SELECT u.i, u.game_id, u.white, u.black, w.c, coalesce(w.c[u.white], 0) AS wn, coalesce(w.c[u.black], 0) AS bn, greatest(coalesce(w.c[u.white], 0), coalesce(w.c[u.black], 0)) < {CAP} AS ok
   FROM walk w JOIN u ON u.i = w.i + 1) x)
 SELECT game_id FROM walk WHERE ok""")


@query("win_13_prediction_cap_strict", "example_reasons cap_walk", f"""
, usable AS (SELECT game_id, played_at, p.player FROM example_reasons e JOIN cap_walk USING (game_id), LATERAL (SELECT e.white AS player UNION ALL SELECT e.black) p),
asked AS (SELECT game_id, played_at, p.player FROM example_reasons e, LATERAL (SELECT e.white AS player UNION ALL SELECT e.black) p WHERE e.policy_reason IS NULL),
prior AS (SELECT a.game_id, a.player, count(u.game_id) AS n FROM asked a LEFT JOIN usable u ON u.player = a.player AND (u.played_at < a.played_at OR (u.played_at = a.played_at AND u.game_id < a.game_id)) GROUP BY 1, 2)
SELECT r.game_id, CASE WHEN r.policy_reason IS NULL AND m.n >= {CAP} THEN 'max_predictions_per_player' ELSE coalesce(r.reason, 'ok') END AS reason
FROM example_reasons r LEFT JOIN (SELECT game_id, max(n) AS n FROM prior GROUP BY 1) m USING (game_id)""")
def _(spark, sf):
    policy = C.ContextPolicy(context_size=N, max_predictions_per_player=CAP)
    made = X.build_examples(fx.games(spark, sf), policy, strict_cap=True)
    return made.select("game_id", F.coalesce("reason", F.lit("ok")).alias("reason"))


for _how, _sql in (
    ("mean", "avg(s.score)"),
    ("median", "median(s.score)"),
    ("recency_weighted", "sum(c.weight * s.score) / sum(c.weight)"),
):

    def _strength(spark, sf, how=_how):
        made = examples(spark, sf).filter("reason IS NULL")
        out = X.context_strength(made, side_scores(spark, sf), how)
        return out.select("game_id", *[F.round(f"{s}_strength", 6).alias(f"{s}_strength") for s in ("white", "black")])

    query(f"win_14_context_{_how}", "context side_scores", f"""
SELECT w.game_id, round(w.v, 6) AS white_strength, round(b.v, 6) AS black_strength FROM
 (SELECT c.game_id, {_sql} AS v FROM context c JOIN side_scores s ON s.game_id = c.context_id AND s.color = c.color WHERE c.side = 'white' GROUP BY 1) w JOIN
 (SELECT c.game_id, {_sql} AS v FROM context c JOIN side_scores s ON s.game_id = c.context_id AND s.color = c.color WHERE c.side = 'black' GROUP BY 1) b USING (game_id)""")(_strength)

table("strengths", "context side_scores", """
 SELECT c.game_id, avg(s.score) FILTER (c.side = 'white') AS white_strength, avg(s.score) FILTER (c.side = 'black') AS black_strength
 FROM context c JOIN side_scores s ON s.game_id = c.context_id AND s.color = c.color GROUP BY 1 HAVING count(DISTINCT c.side) = 2""")


def strength_predictions(spark, sf, line=R.DEFAULT_LINE):
    made = examples(spark, sf).filter("reason IS NULL")
    return P.strength_predictions(X.context_strength(made, side_scores(spark, sf)), line=line)


for _name, _line in (("default", R.DEFAULT_LINE), ("legacy", R.LEGACY_LINE)):

    def _rated(spark, sf, line=_line):
        cols = ("white_estimated_elo", "black_estimated_elo", "p_white", "p_black")
        return strength_predictions(spark, sf, line).select("game_id", *[F.round(c, 6).alias(c) for c in cols], "predicted")

    query(f"scl_07_strength_prediction_{_name}", "strengths", f"""
SELECT game_id, round(w, 6) AS white_estimated_elo, round(b, 6) AS black_estimated_elo, round(0.96::DOUBLE * e, 6) AS p_white, round(0.96::DOUBLE * (1 - e), 6) AS p_black,
 CAST(CASE WHEN e >= 0.5 THEN 1 ELSE -1 END AS BIGINT) AS predicted FROM (SELECT *, 1 / (1 + pow(10.0::DOUBLE, (b - w) / 400)) AS e FROM (
 SELECT game_id, {_line[0]!r}::DOUBLE * white_strength + {_line[1]!r}::DOUBLE AS w, {_line[0]!r}::DOUBLE * black_strength + {_line[1]!r}::DOUBLE AS b FROM strengths))""")(_rated)


@query("job_05_strength_evaluation", "strengths games", f"""
, p AS (SELECT s.game_id, result, 1 / (1 + pow(10.0::DOUBLE, {R.DEFAULT_LINE[0]!r}::DOUBLE * (black_strength - white_strength) / 400)) AS e FROM strengths s JOIN games USING (game_id)),
q AS (SELECT *, 0.96::DOUBLE * e AS w, 0.96::DOUBLE * (1 - e) AS b FROM p)
SELECT count(*) AS n_examples, round(avg(CAST(result = CASE WHEN e >= 0.5 THEN 1 ELSE -1 END AS DOUBLE)), 6) AS accuracy, round(avg(CAST(result = 0 AS DOUBLE)), 6) AS draw_rate,
 round(avg(-ln(CASE WHEN result > 0 THEN w WHEN result = 0 THEN 0.04 ELSE b END)), 6) AS log_loss,
 round(avg(pow(CAST(result > 0 AS INT) - w, 2) + pow(CAST(result = 0 AS INT) - 0.04::DOUBLE, 2) + pow(CAST(result < 0 AS INT) - b, 2)), 6) AS brier_score FROM q""")
def _(spark, sf):
    made = examples(spark, sf).filter("reason IS NULL")
    strengths = X.context_strength(made, side_scores(spark, sf))
    predictions = P.strength_predictions(strengths)
    return P.metrics(P.strict_join(made.select("game_id", "result"), predictions))
