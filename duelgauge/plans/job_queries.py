"""Registered queries: the composed jobs and the extension points."""

from pyspark.sql import functions as F

from duelgauge import fixtures as fx
from duelgauge.functions import rating as R
from duelgauge.operators import corpus as C
from duelgauge.operators import context as X
from duelgauge.operators import boundaries as D
from duelgauge.operators import phases as PH
from duelgauge.plans import comparison_queries as CQ
from duelgauge.plans import evaluation_queries as E
from duelgauge.plans import graph_queries as GQ
from duelgauge.plans import jobs as J
from duelgauge.plans import predict_queries as PQ
from duelgauge.plans import source_queries as SQ
from duelgauge.plans import training_queries as TQ
from duelgauge.plans.corpus_queries import held_out, with_digest
from duelgauge.plans.evaluation_queries import rounded
from duelgauge.plans.registry import ORACLES, query, table


@query("job_01_prepare_corpus", "classified", """
SELECT 'split:' || CASE WHEN rn <= 2200 THEN 'eval' ELSE 'train' END || ':' || wbin AS item, count(*) AS n FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY wbin ORDER BY md5('quota:' || game_id), game_id) AS rn FROM classified WHERE reason IS NULL) GROUP BY 1
UNION ALL SELECT 'reason:' || reason, count(*) FROM classified WHERE reason IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    made = J.prepare_corpus(with_digest(fx.games(spark, sf)), fx.BINS_200, {"eval": 2200, "train": None}, held_out(spark, sf), "quota")
    splits = made["splits"].groupBy(F.concat_ws(":", F.lit("split"), "split", F.col("bin").cast("string")).alias("item")).agg(F.count(F.lit(1)).alias("n"))
    return splits.unionByName(made["exclusions"].select(F.concat_ws(":", F.lit("reason"), "reason").alias("item"), "n"))


@query("job_02_build_win_chains", "full_slots", """
SELECT CAST(slot AS INT) AS slot, round(avg(CAST(color = 'white' AS DOUBLE)), 6) AS p_white, round(avg(rel), 6) AS mean, round(avg(elo), 6) AS elo, round(stddev_samp(elo), 6) AS sd, count(*) AS n FROM (
 SELECT *, elo - first_value(elo) OVER (PARTITION BY attempt ORDER BY slot) AS rel FROM full_slots) GROUP BY 1""")
def _(spark, sf):
    made = J.build_win_chains(fx.games(spark, sf), GQ.LENGTH, GQ.MAX_CHAINS)
    elos = made["slot_elo"].select("slot", F.col("mean").alias("elo"), "sd", "n")
    return rounded(made["color_balance"].select("slot", "p_white").join(made["relative_elo"].select("slot", "mean"), "slot").join(elos, "slot"))


@query("job_02_chain_pool", "chain_slots first_use games", """
SELECT idx, game_id, white, black, result, (SELECT count(*) FROM chain_slots) AS slots, (SELECT count(DISTINCT player) FROM chain_slots) AS players FROM first_use JOIN games USING (game_id)""")
def _(spark, sf):
    made = J.build_win_chains(fx.games(spark, sf), GQ.LENGTH, GQ.POOL_CHAINS)
    counted = made["appearances"].agg(F.struct(F.sum("n").alias("slots"), F.count(F.lit(1)).alias("players")).alias("v")).scalar()
    pool = made["pool"].select("idx", "game_id", "white", "black", "result").withColumn("v", counted)
    return pool.select("idx", "game_id", "white", "black", "result", "v.slots", "v.players")


@query("job_02_chain_edges", "chains", """
, e AS (SELECT i, CAST(es[i + 1].winner_elo - es[i + 1].loser_elo AS DOUBLE) AS d FROM chains, (SELECT range AS i FROM range(7)))
SELECT CAST(i AS BIGINT) AS item, round(avg(d), 6) AS mean, round(stddev_samp(d), 6) AS sd, count(*) AS n FROM e GROUP BY 1
UNION ALL SELECT 1000 + CASE WHEN d < -1500 THEN 0 WHEN d >= 1500 THEN 121 ELSE CAST(floor((d + 1500) / 3000.0 * 120) AS BIGINT) + 1 END, 0.0, 0.0, count(*) FROM e GROUP BY 1""")
def _(spark, sf):
    made = J.build_win_chains(fx.games(spark, sf), GQ.LENGTH, GQ.POOL_CHAINS)
    links = made["edge_elo"].select(F.col("link").cast("bigint").alias("item"), "mean", "sd", "n")
    bins = made["edge_histogram"].filter("n > 0").select((F.col("bin") + 1000).alias("item"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("sd"), "n")
    return rounded(links.unionByName(bins))


@query("job_03_stride_chains", "games", """
, s AS (SELECT g.game_id AS attempt, i, g.game_id + i AS game_id FROM games g, (SELECT range AS i FROM range(4)) WHERE i % 2 = 0),
d AS (SELECT game_id, ROW_NUMBER() OVER (ORDER BY game_id) - 1 AS idx FROM (SELECT DISTINCT game_id FROM s))
SELECT attempt, string_agg(idx || ':' || CASE WHEN s.game_id % 2 = 0 THEN 'W' ELSE 'B' END, ' ' ORDER BY i) AS value FROM s JOIN d USING (game_id) GROUP BY 1""")
def _(spark, sf):
    part = lambda i: F.concat((F.col("game_id") + i).cast("string"), F.when((F.col("game_id") + i) % 2 == 0, ":W").otherwise(":b"))
    lines = fx.games(spark, sf).select(F.col("game_id").alias("attempt"), F.concat_ws(" ", *[part(i) for i in range(4)]).alias("value"))
    return J.stride_chains(lines, fx.games(spark, sf), 2)["lines"]


@query("job_05_progressive_evaluation", "trajectories", """
SELECT observed_plies, count(*) AS n_examples, round(avg(CAST(predicted = result AS DOUBLE)), 6) AS accuracy FROM trajectories GROUP BY 1""")
def _(spark, sf):
    from duelgauge.plans.progressive_queries import live_examples

    made = J.evaluate_progressive(live_examples(spark, sf), fx.move_scores(spark, sf))
    return made["by_ply"].filter("estimate = 'progressive'").select("observed_plies", "n_examples", "accuracy")


@query("job_07_evaluate_bins", "", f"""
SELECT games_averaged, 'overall' AS part, accuracy_exact AS value FROM ({ORACLES['agg_16_trial_summary']})
UNION ALL SELECT games_averaged, 'gap ' || bucket_gap, ordering_accuracy FROM ({ORACLES['jn_14_pairwise_ordering']})""")
def _(spark, sf):
    made = J.evaluate_bins(fx.candidate_scores(spark, sf), fx.query_scores(spark, sf), E.SIZES, E.TRIALS, "trial")
    overall = made["overall"].select("games_averaged", F.lit("overall").alias("part"), F.col("accuracy_exact").alias("value"))
    pairs = made["pairwise"].select("games_averaged", F.concat_ws(" ", F.lit("gap"), F.col("bucket_gap").cast("string")).alias("part"), F.col("ordering_accuracy").alias("value"))
    return rounded(overall.unionByName(pairs))


@query("job_08_evaluate_phase_bins", "", f"""
SELECT low, phase, gap_vs_phase_average, gap_se FROM ({ORACLES['agg_11_phase_gaps']}) JOIN ({ORACLES['smp_07_bootstrap_gap_error']}) USING (low, phase)""")
def _(spark, sf):
    rows = E.phase_rows(spark, sf).filter("split = 'query'")
    made = J.evaluate_phase_bins(rows, E.calibration(spark, sf), E.BOOT, "boot")
    return made["gaps"].select("low", "phase", F.round("gap_vs_phase_average", 5).alias("gap_vs_phase_average"), F.round("gap_se", 4).alias("gap_se"))


def phase_bins(spark, sf):
    rows = E.phase_rows(spark, sf)
    return J.evaluate_phase_bins(rows.filter("split = 'query'"), E.calibration(spark, sf), E.BOOT, "boot", rows.filter("split = 'cand'"), E.SIZES, E.TRIALS)


@query("job_08_phase_accuracy", "", ORACLES["agg_43_phase_accuracy"])
def _(spark, sf):
    out = phase_bins(spark, sf)["accuracy"]
    four = {"mean_signed_error", "mean_absolute_error"}
    return out.select(*[F.round(c, 4 if c in four else 6).alias(c) if c not in ("phase", "games_averaged") else F.col(c) for c in out.columns])


@query("job_08_phase_summary", "", f"""
SELECT phase, mean_gap, mean_abs_gap, buckets FROM (
 SELECT phase, round(avg(gap_vs_phase_average), 4) AS mean_gap, round(avg(abs(gap_vs_phase_average)), 4) AS mean_abs_gap FROM ({ORACLES['agg_11_phase_gaps']}) GROUP BY 1)
 JOIN (SELECT phase, count(*) AS buckets FROM ({ORACLES['agg_10_phase_calibrations']}) GROUP BY 1) USING (phase)""")
def _(spark, sf):
    made = phase_bins(spark, sf)
    counted = made["calibrations"].groupBy("phase").agg(F.count(F.lit(1)).alias("buckets"))
    return made["summary"].join(counted, "phase").select("phase", F.round("mean_gap", 4).alias("mean_gap"), F.round("mean_abs_gap", 4).alias("mean_abs_gap"), "buckets")


@query("job_09_move_analysis", "move_scores segments calibration", f"""
, e AS ({E.estimate_sql('move_scores', 'score')})
SELECT phase, round(quantile_cont(estimated_elo, 0.01), 4) AS p01, round(quantile_cont(estimated_elo, 0.5), 4) AS p50, round(quantile_cont(estimated_elo, 0.99), 4) AS p99 FROM e GROUP BY 1""")
def _(spark, sf):
    return rounded(J.move_analysis(fx.move_scores(spark, sf), E.calibration(spark, sf))["distribution"], digits=4)


@query("job_10_corpus_comparison", "", f"""
SELECT 'overlap ' || owner AS item, "overlaps" AS n FROM ({ORACLES['jn_03_exact_overlap']}) UNION ALL SELECT 'matched', matched FROM ({ORACLES['jn_04_bag_summary']})
UNION ALL SELECT 'different', different FROM ({ORACLES['agg_38_difference_totals']})""")
def _(spark, sf):
    g = fx.games(spark, sf)
    mine = g.filter(F.md5(F.concat(F.lit("own:"), F.col("game_id").cast("string"))) < "4")
    owned = CQ.keyed(mine, upper=True).withColumn("owner", F.concat(F.lit("o"), (F.col("game_id") % 5).cast("string")))
    overlap = J.corpus_overlap(CQ.keyed(g), owned).select(F.concat_ws(" ", F.lit("overlap"), "owner").alias("item"), F.col("overlaps").alias("n"))
    bag = J.match_subset(CQ.bag(g, F.col("game_id") % 2 == 0), CQ.bag(g, F.col("game_id") % 3 == 0))["summary"]
    m = fx.moves(spark, sf).withColumnRenamed("game_id", "line_no")
    new = m.filter(~((F.col("line_no") % 10 == 0) & (F.col("ply") >= 40))).withColumn("move", F.when(F.col("event_id") % 97 == 0, "e1g1").otherwise(F.col("move")))
    totals = J.compare_conversions(m, new)["totals"]
    return overlap.unionByName(bag.select(F.lit("matched").alias("item"), F.col("matched").alias("n"))).unionByName(totals.select(F.lit("different").alias("item"), F.col("different").alias("n")))


@query("job_11_compare_cohorts", "timed_errors", """
SELECT event, count(*) AS players, round(avg(error), 5) AS mean_error, round(avg(abs(error)), 5) AS mae, round(median(error), 5) AS median_error FROM timed_errors GROUP BY 1""")
def _(spark, sf):
    made = J.compare_cohorts(CQ.timed_errors(spark, sf), "event", "Rapid", "Blitz")
    return rounded(made["errors"], "event", "players", "mean_error", "mae", "median_error", digits=5)


table("framed", "ranked_moves", "SELECT * FROM ranked_moves WHERE ply < 50")
table("framed_strength", "framed", "SELECT rank, avg(score) AS mean_score FROM framed WHERE game_id % 3 = 0 GROUP BY 1")
table("framed_games", "framed", """
 SELECT rank, game_id, coalesce(avg(score) FILTER (color = 'white'), 0) AS ws, coalesce(avg(score) FILTER (color = 'black'), 0) AS bs, count(*) FILTER (color = 'white') AS wm, count(*) FILTER (color = 'black') AS bm FROM framed WHERE game_id % 3 <> 0 GROUP BY 1, 2""")
table("framed_pool", "framed_games", "SELECT *, rank AS low, ROW_NUMBER() OVER (PARTITION BY rank ORDER BY md5('pool:' || game_id), game_id) AS draw, count(*) OVER (PARTITION BY rank) AS pool FROM framed_games")
table("framed_draws", "framed_pool", E.draws_sql("framed_pool", "low", "native"))
table("framed_means", "framed_draws framed_pool", """
 SELECT size, low, trial, sum(s * m) / sum(m) AS score FROM (SELECT d.size, d.low, d.trial, CASE WHEN w THEN ws ELSE bs END AS s, CASE WHEN w THEN wm ELSE bm END AS m FROM (
  SELECT *, CAST('0x' || substr(md5(concat_ws(':', 'native-side', size, low, trial, nth)), 1, 15) AS BIGINT) % 2 = 0 AS w FROM framed_draws) d JOIN framed_pool p USING (low, draw)) GROUP BY 1, 2, 3""")


@query("job_12_native_evaluation", "framed_means framed_strength", """
, i AS (SELECT *, ROW_NUMBER() OVER (ORDER BY rank) - 1 AS idx FROM framed_strength),
r AS (SELECT m.size, m.low, (SELECT arg_min(i.idx, (abs(m.score - i.mean_score), i.idx)) FROM i) AS pred, (SELECT idx FROM i WHERE i.rank = m.low) AS truth FROM framed_means m),
a AS (SELECT CAST(size AS INT) AS size, low, avg(CAST(abs(pred - truth) <= 1 AS DOUBLE)) AS accuracy FROM r GROUP BY 1, 2)
SELECT size, low, round(accuracy, 6) AS accuracy FROM a UNION ALL SELECT size, -1, round(avg(accuracy), 6) FROM a GROUP BY 1""")
def _(spark, sf):
    rows = CQ.ranked_moves(spark, sf).withColumn("rank", F.col("rank").cast("bigint"))
    cand = F.col("game_id") % 3 == 0
    return rounded(J.native_evaluation(rows.filter(cand), rows.filter(~cand), "first_50", E.SIZES, E.TRIALS, "native", "+/-1")["curve"])


@query("job_13_training_batches", "", " UNION ALL ".join(
    f"SELECT '{kind}' AS kind, count(*) AS n, count(DISTINCT game_id) AS games, CAST(sum(ply) AS BIGINT) AS plies FROM ({ORACLES[name]})"
    for kind, name in (("rank", "smp_08_ranking_groups"), ("chain", "smp_09_chain_batch"), ("phase", "smp_10_phase_batch"))))
def _(spark, sf):
    positions = fx.positions(spark, sf)
    made = {
        "rank": J.assemble_training_batches(spark, "rank", fx.ranked_games(spark, sf), positions, TQ.GROUPS, TQ.RANKS, TQ.P, "rg"),
        "chain": J.assemble_training_batches(spark, "chain", GQ.chain_slots(spark, sf), positions, TQ.BATCH, 0, TQ.CHAIN_P, "cb"),
        "phase": J.assemble_training_batches(spark, "phase", D.phase_examples(TQ.tagged(spark, sf), 6), positions, TQ.GROUPS, TQ.RANKS, TQ.P, "pb"),
    }
    out = None
    for kind, rows in made.items():
        part = rows.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"), F.count_distinct("game_id").alias("games"), F.sum("ply").alias("plies"))
        out = part if out is None else out.unionByName(part)
    return out


@query("job_14_training_targets", "cumulative nstep_plain", f"""
, d AS (SELECT range AS draw, CAST('0x' || substr(md5('per:' || range), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE * (SELECT any_value(total) FROM cumulative) AS u FROM range({TQ.DRAWS}))
SELECT draw, c.game_id, c.ply, round(sign(n_step) * (sqrt(abs(n_step) + 1) - 1) + 0.001::DOUBLE * n_step, 6) AS target FROM d JOIN cumulative c ON u < upto AND u >= upto - weight JOIN nstep_plain p ON p.game_id = c.game_id AND p.ply = c.ply""")
def _(spark, sf):
    targets = J.training_targets(fx.replay_rows(spark, sf), TQ.NSTEP, TQ.DISCOUNT, 601)
    return rounded(J.sample_replay(targets, TQ.DRAWS, TQ.ALPHA, TQ.BETA, "per"), "draw", "game_id", "ply", "target")


@query("job_15_match_elo", "ladder", "SELECT p1, p2, total, win_rate, elo FROM ladder")
def _(spark, sf):
    return J.match_elo(CQ.match_rows(spark, sf)).select("p1", "p2", "total", "win_rate", "elo")


@query("job_15_selfplay_stats", "", f"SELECT iteration, games, avg_length, std_return FROM ({ORACLES['agg_33_selfplay_stats']})")
def _(spark, sf):
    return rounded(J.selfplay_stats(CQ.selfplay(spark, sf)), "iteration", "games", "avg_length", "std_return")


@query("job_16_pgn_corpus", "games", """
, k AS (SELECT * FROM games WHERE event = 'Blitz' AND game_id % 43 <> 0 AND white_elo > 0 AND plies >= 22),
s AS (SELECT white_elo AS elo FROM k UNION ALL SELECT black_elo FROM k)
SELECT CAST(floor(elo / 100.0) * 100 AS BIGINT) AS low, count(*) AS n FROM s GROUP BY 1""")
def _(spark, sf):
    made = J.pgn_corpus(spark, SQ.written_pgn(spark, sf))
    return made["distribution"].select("low", "n")


@query("udf_02_prediction_model", "example_reasons predicted", """
SELECT count(*) AS n_examples, round(avg(CAST(predicted = result AS DOUBLE)), 6) AS accuracy, round(avg(CAST(result = 0 AS DOUBLE)), 6) AS draw_rate, round(avg(ll), 6) AS log_loss, round(avg(br), 6) AS brier_score
FROM predicted JOIN (SELECT game_id FROM example_reasons WHERE reason IS NULL) USING (game_id)""")
def _(spark, sf):
    made = J.build_examples(fx.games(spark, sf), PQ.POLICY)["examples"].withColumn("context_size", F.size("white_context"))
    slim = made.select("game_id", "white_elo", "black_elo", "result", "played_at", "context_size")
    return J.evaluate(slim, lambda e: J.rating_model()(e))["metrics"]


table("reversed", "sides", """
 SELECT s.*, ROW_NUMBER() OVER (PARTITION BY player ORDER BY played_at, game_id DESC) AS rn FROM sides s
 WHERE event = 'Blitz' AND elo BETWEEN 1000 AND 3000 AND opponent_elo BETWEEN 1000 AND 3000""")


@query("udf_03_context_selector", "targets reversed", f"""
, c AS (SELECT t.game_id, t.side, string_agg(CAST(e.game_id AS VARCHAR), ',' ORDER BY e.rn) AS context_ids FROM targets t JOIN reversed e ON e.player = t.player AND e.rn > t.n_before - {PQ.N} AND e.rn <= t.n_before WHERE t.n_before >= {PQ.N} GROUP BY 1, 2)
SELECT w.game_id, w.context_ids AS white_ids, b.context_ids AS black_ids FROM c w JOIN c b USING (game_id) WHERE w.side = 'white' AND b.side = 'black'""")
def _(spark, sf):
    made = X.build_examples(fx.games(spark, sf), PQ.POLICY, newest_first=[F.asc("game_id")]).filter("reason IS NULL")
    ids = lambda s: F.concat_ws(",", F.transform(F.col(f"{s}_context"), lambda c: c.game_id.cast("string"))).alias(f"{s}_ids")
    return made.select("game_id", ids("white"), ids("black"))


@query("udf_04_slice_functions", "predicted", """
SELECT 'event' AS slice, event AS bucket, round(avg(CAST(predicted = result AS DOUBLE)), 6) AS accuracy, count(*) AS n FROM predicted GROUP BY 2 HAVING count(*) >= 20
UNION ALL SELECT 'favourite', CASE WHEN white_elo >= black_elo THEN 'white' ELSE 'black' END, round(avg(CAST(predicted = result AS DOUBLE)), 6), count(*) FROM predicted GROUP BY 2 HAVING count(*) >= 20""")
def _(spark, sf):
    from duelgauge.operators import predict as P

    slices = {"event": lambda: F.col("event"), "favourite": lambda: F.when(F.col("white_elo") >= F.col("black_elo"), "white").otherwise("black")}
    return P.slice_metrics(PQ.baseline(spark, sf), slices=slices)


@query("job_12_class_vote", "", ORACLES["agg_29_class_vote_max_prob"])
def _(spark, sf):
    positions = fx.read(spark, sf, "embeddings").select(
        F.floor(F.col("vec_id") / 4).alias("game_id"), (F.col("vec_id") % 4).alias("ply"), (F.floor(F.col("vec_id") / 4) * 7 % 9).alias("rank"), F.col("embedding").alias("classes")
    )
    return rounded(J.native_class_evaluation(positions, "max_prob", "+/-1", (1, 5, 10, 25, 50, 100), 500, "class"))


@query("job_12_move_prediction", "", ORACLES["agg_28_move_agreement"])
def _(spark, sf):
    policies = fx.read(spark, sf, "embeddings").select((F.col("vec_id") % 3).alias("rank"), F.col("embedding").alias("policy"), (F.col("vec_id") % 64).cast("int").alias("played"))
    return rounded(J.move_prediction(policies))


@query("job_14_unrolled_targets", "", ORACLES["win_23_unrolled_targets"])
def _(spark, sf):
    rows = J.training_sets(fx.replay_rows(spark, sf), fx.ranked_games(spark, sf), TQ.NSTEP, TQ.DISCOUNT, 601, TQ.K, 9, 8, "pad")["unrolled"]
    weigh = lambda c: F.aggregate(F.transform(c, lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return rounded(rows.select(
        "game_id", "ply", F.concat_ws(",", F.transform("actions", lambda a: a.cast("string"))).alias("actions"),
        weigh("rewards").alias("reward_check"), weigh("values").alias("value_check"),
        F.size(F.filter("policy_actions", lambda a: a.isNull())).cast("bigint").alias("padded"),
    ))


@query("job_14_policy_targets", "", ORACLES["win_24_position_targets"])
def _(spark, sf):
    rows = J.training_sets(fx.replay_rows(spark, sf), fx.ranked_games(spark, sf), TQ.NSTEP, TQ.DISCOUNT, 601, TQ.K, 9, 8, "pad")["positions"]
    return rounded(rows.select("game_id", "ply", F.posexplode("policy").alias("idx", "policy"), "value", "label"), "game_id", "ply", "idx", "policy", "value", "label")


@query("job_14_symmetries", "", """
SELECT vec_id, CAST(s AS INT) AS symmetry, CAST(ty * 8 + tx AS INT) AS point, round(p, 6) AS policy FROM (
 SELECT *, CASE s % 4 WHEN 0 THEN x WHEN 1 THEN r WHEN 2 THEN 7 - x ELSE 7 - r END AS tx, CASE s % 4 WHEN 0 THEN r WHEN 1 THEN 7 - x WHEN 2 THEN 7 - r ELSE x END AS ty FROM (
  SELECT vec_id, s, p, i % 8 AS x, CASE WHEN s >= 4 THEN 7 - i // 8 ELSE i // 8 END AS r FROM (
   SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS p FROM embeddings), (SELECT range AS s FROM range(8))))""")
def _(spark, sf):
    rows = fx.read(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("policy"))
    return rounded(J.augmented_policies(rows, 8).select("vec_id", "symmetry", F.posexplode("policy").alias("point", "policy")), "vec_id", "symmetry", "point", "policy")
