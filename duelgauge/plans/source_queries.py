"""Registered queries: text sources, sinks, scorers, streams. Inputs are text that Spark writes from the tables."""

from pyspark.sql import functions as F

from duelgauge import fixtures as fx
from duelgauge import schemas
from duelgauge.functions import records as T
from duelgauge.operators import boundaries as D
from duelgauge.operators import corpus as C
from duelgauge.operators import graph as G
from duelgauge.operators import predict as P
from duelgauge.operators import scoring as S
from duelgauge.operators import selfplay as SP
from duelgauge.plans import evaluation_queries as E
from duelgauge.plans import predict_queries as PQ
from duelgauge.plans.evaluation_queries import rounded
from duelgauge.plans.registry import query, table
from duelgauge.runtime import scratch_path
from duelgauge.sources import records as RD
from duelgauge.sources import sinks as SK
from duelgauge.sources import tables as TB
from duelgauge.streaming import streams as ST


def lines(spark, sf):
    return SK.record_lines(fx.games(spark, sf), fx.moves(spark, sf))


def written(spark, name, frame, **layout):
    path = scratch_path(spark, name)
    SK.write_text(frame, path, **layout)
    return path


GAME_COLUMNS = "white, black, CASE WHEN white_elo > 0 THEN white_elo ELSE 0 END AS white_elo, black_elo, result, CAST(played_at AS VARCHAR) AS played_at, event"


@query("src_01_record_scan", "games", """
SELECT count(*) AS lines, count(*) FILTER (game_id % 31 <> 0 AND result <> 0) AS decisive, count(*) FILTER (game_id % 31 <> 0 AND result = 0) AS draws,
 count(*) FILTER (game_id % 31 = 0) AS parse_skip, count(*) FILTER (game_id % 31 <> 0 AND white_elo = 0) AS rating_skip FROM games""")
def _(spark, sf):
    broken = F.when(F.col("game_id") % 31 == 0, F.regexp_replace("value", r"RE\[[^\]]*\]", "RE[?]")).otherwise(F.col("value"))
    path = written(spark, "records", lines(spark, sf).select(broken.alias("value")))
    return RD.scan_counters(RD.read_records(spark, path))


@query("src_01_record_rows", "games", f"SELECT {GAME_COLUMNS} FROM games")
def _(spark, sf):
    rows = RD.read_records(spark, written(spark, "records", lines(spark, sf)))
    return rows.select("white", "black", F.coalesce("white_elo", F.lit(0)).alias("white_elo"), "black_elo", "result", F.col("played_at").cast("string").alias("played_at"), "event")


@query("src_02_catalog", "games", f"SELECT {GAME_COLUMNS}, true AS well_formed_id FROM games")
def _(spark, sf):
    rows = RD.read_catalog(spark, written(spark, "catalog", lines(spark, sf)))
    return rows.select("white", "black", "white_elo", "black_elo", "result", F.col("played_at").cast("string").alias("played_at"), "event", F.col("game_id").rlike("^part-.*:[0-9a-f]{12}:[0-9]+$").alias("well_formed_id"))


@query("src_03_main_line_moves", "moves games", """
SELECT m.game_id, m.ply, m.color, m.move, m.clock_s FROM moves m JOIN games USING (game_id)""")
def _(spark, sf):
    nested = F.when(F.col("game_id") % 4 == 0, F.regexp_replace("value", r"^(.*);([BW])\[([^\]]*)\](.*)$", r"$1(;W[x\\]y];B[z])(;B[q](;W[r]));$2[$3]$4")).otherwise(F.col("value"))
    path = scratch_path(spark, "variations")
    lines(spark, sf).select("game_id", nested.alias("value")).write.parquet(path)
    return RD.explode_moves(spark.read.parquet(path)).select("game_id", "ply", "color", "move", "clock_s")


def pgn_lines(spark, sf):
    """PGN text: header block, blank line, movetext with clocks."""
    g = F.col("game_id")
    games = fx.games(spark, sf)
    san = F.array_join(F.transform(F.sequence(F.lit(0), F.col("plies") - 1), lambda p: F.concat(
        F.when(p % 2 == 0, F.concat((F.floor(p / 2) + 1).cast("string"), F.lit(". "))).otherwise(F.concat((F.floor(p / 2) + 1).cast("string"), F.lit("... "))),
        F.lit("Nf3! { [%clk 0:0"), (p % 10).cast("string"), F.lit(":0"), (p % 7).cast("string"), F.lit("] }"))), " ")
    # The movetext depends on the number of plies alone: it is made once per number, not once per game.
    movetexts = games.select("plies").distinct().withColumn("san", san)
    score = F.when(F.col("result") > 0, "1-0").when(F.col("result") < 0, "0-1").otherwise("1/2-1/2")
    head = lambda k, v: F.concat(F.lit(f'[{k} "'), v, F.lit('"]\n'))
    return games.join(F.broadcast(movetexts), "plies", "left").select(F.concat(
        head("Event", F.concat(F.lit("Rated "), F.col("event"), F.lit(" game"))), head("White", F.when(g % 43 == 0, "?").otherwise(F.col("white"))), head("Black", F.col("black")),
        head("Result", score), head("UTCDate", F.date_format("played_at", "yyyy.MM.dd")), head("WhiteElo", F.when(F.col("white_elo") > 0, F.col("white_elo").cast("string")).otherwise("?")),
        head("BlackElo", F.col("black_elo").cast("string")), head("TimeControl", F.concat((F.lit(60) + g % 5).cast("string"), F.lit("+"), (g % 3).cast("string"))),
        F.lit("\n"), "san", F.lit(" "), score, F.lit("\n")).alias("value"))


def written_pgn(spark, sf):
    """PGN files as they are passed around: compressed, each with a bounded number of games."""
    return written(spark, "pgn", pgn_lines(spark, sf), compression="gzip", lines_per_file=SK.LINES_PER_FILE)


@query("src_04_pgn_headers", "games", """
SELECT CASE WHEN game_id % 43 = 0 THEN '?' ELSE white END AS white, black, strftime(played_at, '%Y.%m.%d') AS utc_date, CAST(8 AS INT) AS n_tags FROM games""")
def _(spark, sf):
    rows = RD.read_pgn(spark, written_pgn(spark, sf))
    return rows.select(F.col("tags.White").alias("white"), F.col("tags.Black").alias("black"), F.col("tags.UTCDate").alias("utc_date"), F.size("tags").alias("n_tags"))


@query("src_05_pgn_corpus", "games", """
SELECT CASE WHEN game_id % 43 = 0 THEN '?' ELSE white END AS white, black, result, CASE WHEN event <> 'Blitz' THEN 'event' WHEN game_id % 43 = 0 THEN 'missing_player' WHEN white_elo = 0 THEN 'rating' WHEN plies < 22 THEN 'too_short' ELSE 'ok' END AS reason,
 60 + game_id % 5 AS base_s, game_id % 3 AS increment_s, plies AS n_moves, (SELECT CAST(sum(60 * (p % 10) + p % 7) AS BIGINT) FROM (SELECT unnest(range(plies)) AS p)) AS clock_sum FROM games""")
def _(spark, sf):
    rows = RD.pgn_corpus(RD.read_pgn(spark, written_pgn(spark, sf)))
    return rows.select("white", "black", "result", F.coalesce("reason", F.lit("ok")).alias("reason"), "time_control.base_s", "time_control.increment_s", F.size("moves").cast("bigint").alias("n_moves"), F.aggregate("clocks", F.lit(0).cast("bigint"), lambda a, c: a + c).alias("clock_sum"))


@query("src_06_go_records", "games", """
SELECT white, black, CASE WHEN result > 0 THEN 1 ELSE -1 END::BIGINT AS result, (1 + game_id % 9) || 'd' AS black_rank, 6.5::DOUBLE AS komi FROM games WHERE game_id % 4 <> 0""")
def _(spark, sf):
    g = F.col("game_id")
    text = F.format_string("(;GM[go]SZ[%d]KM[6.5]RE[%s]PB[%s]PW[%s]BR[%dd]WR[3k];B[pd];W[dp])", F.when(g % 4 == 0, 9).otherwise(19), F.when(F.col("result") > 0, "B+R").otherwise("W+2.5"), F.col("black"), F.col("white"), F.lit(1) + g % 9)
    rows = RD.read_go_records(spark, written(spark, "go", fx.games(spark, sf).select(text.alias("value"))))
    return rows.select("white", "black", "result", "black_rank", "komi")


@query("src_07_bucket_files", "kept", "SELECT 1000 + 200 * bin AS low, 1200 + 200 * bin AS high, count(*) AS n FROM kept GROUP BY 1, 2")
def _(spark, sf):
    from duelgauge.plans.corpus_queries import classified

    kept = classified(spark, sf).filter("reason IS NULL").select((F.lit(1000) + 200 * F.col("bin")).alias("low"), F.col("game_id").cast("string").alias("value"))
    root = scratch_path(spark, "buckets")
    kept.hint("rebalance", "low").write.partitionBy("low").text(root)
    name_buckets(spark, root)
    return RD.read_buckets(spark, root).groupBy("low", "high").agg(F.count(F.lit(1)).alias("n"))


def name_buckets(spark, root):
    """Give every written part the LOW_HIGH.txt name of its directory (one rename per file)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(conf)
    for status in fs.globStatus(path(f"{root}/low=*/part-*")):
        low = int(status.getPath().getParent().getName().split("=")[1])
        folder = f"{root}/{status.getPath().getName()[:10]}"
        fs.mkdirs(path(folder))
        fs.rename(status.getPath(), path(f"{folder}/{low}_{low + 200}.txt"))


@query("src_10_score_cache", "cand", """
SELECT low, count(*) AS n, round(sum(white_score * white_moves + black_score * black_moves), 6) AS total FROM cand GROUP BY 1""")
def _(spark, sf):
    wanted = [f.name for f in schemas.GAME_SCORES.fields]
    path = scratch_path(spark, "cache")
    compute = lambda: fx.candidate_scores(spark, sf).select(*wanted)
    TB.score_cache(spark, path, schemas.GAME_SCORES, compute)
    again = TB.score_cache(spark, path, schemas.GAME_SCORES, lambda: 1 / 0)
    return rounded(again.groupBy("low").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("white_score") * F.col("white_moves") + F.col("black_score") * F.col("black_moves")).alias("total")))


@query("src_11_calibration_json", "calibration", "SELECT low, high, center, games, round(mean_score, 6) AS mean_score FROM calibration")
def _(spark, sf):
    path = scratch_path(spark, "calibration")
    E.calibration(spark, sf).withColumn("checkpoint", F.lit("step-1")).write.json(path)
    stored = spark.read.schema(schemas.CALIBRATION.add("checkpoint", "string")).json(path)
    return rounded(TB.guard(stored, checkpoint="step-1"), "low", "high", "center", "games", "mean_score")


table("slice_rows", "predicted", """
 SELECT event AS run, d || '-' || (d + 30) AS bucket, d + 15.0::DOUBLE AS midpoint, round(avg(hit), 6) AS accuracy, count(*) AS n FROM (SELECT event, CAST(floor(abs(white_elo - black_elo) / 30.0) * 30 AS BIGINT) AS d, CAST(predicted = result AS DOUBLE) AS hit FROM predicted) GROUP BY 1, d HAVING count(*) >= 20""")


@query("src_12_metric_reports", "slice_rows", "SELECT bucket, midpoint, accuracy, n FROM slice_rows")
def _(spark, sf):
    scored = PQ.baseline(spark, sf)
    slices = {"elo_diff_bucket": P.SLICES["elo_diff_bucket"]}
    reports = None
    for event in ("Rapid", "Blitz"):
        part = scored.filter(F.col("event") == event)
        doc = SK.metrics_document(P.metrics(part), P.slice_metrics(part, slices=slices), part.select("game_id", "p_white"))
        reports = doc if reports is None else reports.unionByName(doc)
    return TB.read_metric_reports(spark, written(spark, "metrics", reports)).select("bucket", "midpoint", "accuracy", "n")


@query("src_13_accuracy_table", "trial_results", """
, a AS (SELECT CAST(size AS BIGINT) AS games, low, avg(CAST(predicted_index = true_index AS DOUBLE)) AS accuracy FROM trial_results GROUP BY 1, 2)
SELECT games, CAST(low AS VARCHAR) AS rank, round(accuracy, 6) AS accuracy FROM a""")
def _(spark, sf):
    from duelgauge.operators import trials as TT

    curve = rounded(TT.accuracy_curve(E.trials(spark, sf))).filter("low >= 0")
    table_rows = curve.groupBy("size").agg(F.sort_array(F.collect_list(F.struct("low", "accuracy"))).alias("c"))
    body = table_rows.select(F.col("size").alias("at"), F.concat_ws("\t", F.col("size").cast("string"), F.array_join(F.transform("c", lambda s: s["accuracy"].cast("string")), "\t")).alias("value"))
    head = table_rows.limit(1).select(F.lit(0).alias("at"), F.concat(F.lit("\t"), F.array_join(F.transform("c", lambda s: s["low"].cast("string")), "\t")).alias("value"))
    note = spark.range(1).select(F.lit(-1).alias("at"), F.lit("[2026/01/01] Summarizing accuracy ...").alias("value"))
    log = note.unionByName(head).unionByName(body).repartition(1).sortWithinPartitions("at")
    return TB.read_accuracy_table(spark, written(spark, "evaluator", log)).drop("file")


def log_folder(iteration):
    """Folder of an iteration, as the name of its lines in a bundle."""
    return F.concat(F.lit("iteration="), F.coalesce(F.col(iteration).cast("string"), F.lit("none")), F.lit("/"))


def log_lines(spark, sf):
    """One log per block of events, in time order."""
    i = F.col("event_id") % 50
    stamp = F.date_format("ts", "yyyy/MM/dd_HH:mm:ss.SSS")
    text = (
        F.when(i == 0, F.format_string("[%s] [Iteration] =====%d=====", stamp, F.col("event_id")))
        .when(i == 20, F.format_string("[%s] [Optimization] Start.", stamp))
        .when(i == 49, F.format_string("[%s] [Optimization] Finished.", stamp))
        .when(i % 2 == 0, F.format_string("\tloss_policy: %.4f", F.abs("value") % 10))
        .otherwise(F.format_string("[%s] [SelfPlay Avg. Game Lengths] %.2f", stamp, F.col("value")))
    )
    return fx.read(spark, sf, "events").select("event_id", F.floor(F.col("event_id") / 50).alias("iteration"), text.alias("value"))


@query("src_14_training_log", "", """
SELECT event_id // 50 AS iteration, CASE WHEN event_id % 2 = 0 THEN 'loss_policy' ELSE 'SelfPlay Avg. Game Lengths' END AS metric, count(*) AS n FROM events WHERE event_id % 50 NOT IN (0, 20, 49) GROUP BY 1, 2""")
def _(spark, sf):
    # One log per iteration: too many and too small for files of their own.
    ready = log_lines(spark, sf).repartition("iteration").sortWithinPartitions("iteration", "event_id")
    path = written(spark, "training-log", RD.bundle_lines(ready, log_folder("iteration")))
    parsed = TB.read_training_log(spark, path, bundles=True).filter("kind = 'metric'")
    folder = F.regexp_extract("file", r"iteration=(\d+)/", 1).cast("bigint").alias("iteration")
    return parsed.groupBy(folder, "metric").agg(F.count(F.lit(1)).alias("n"))


@query("src_15_match_rows", "match_rows", "SELECT p1, p2, count(*) AS n, count(*) FILTER (dup <> '-') AS duplicates, count(*) FILTER (alt = 1) AS swapped FROM match_rows GROUP BY 1, 2")
def _(spark, sf):
    from duelgauge.plans.comparison_queries import match_rows

    rows = match_rows(spark, sf)
    body = rows.select("p1", F.lit(2).alias("at"), F.concat_ws("\t", F.lit("0"), "res_b", F.lit("?"), F.lit("?"), F.col("alt").cast("string"), "dup", *[F.lit("0")] * 6).alias("value"))
    heads = rows.select("p1", "p2").distinct().select("p1", F.explode(F.array(
        F.struct(F.lit(0).alias("at"), F.format_string("# BlackCommand: play weight_iter_%d.pt", "p1").alias("value")),
        F.struct(F.lit(0).alias("at"), F.format_string("# WhiteCommand: play weight_iter_%d.pt", "p2").alias("value")),
        F.struct(F.lit(1).alias("at"), F.lit("#GAME\tRES_B\tERR_MSG").alias("value")))).alias("s")).select("p1", "s.*")
    path = scratch_path(spark, "matches")
    heads.unionByName(body).repartition("p1").sortWithinPartitions("p1", "at").select("p1", "value").write.partitionBy("p1").text(path)
    parsed = TB.read_match_rows(spark, path)
    return parsed.groupBy("p1", "p2").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("dup") != "-").alias("duplicates"), F.count_if(F.col("alt") == 1).alias("swapped"))


table("annotated", "replay", "SELECT * FROM replay")


def annotated_lines(spark, sf):
    """Records with visit counts, values, rewards and a data range."""
    r = fx.replay_rows(spark, sf)
    node = F.format_string(";%s[%d]P[%s]V[%.6f]R[%.6f]", F.when(F.col("ply") % 2 == 0, "B").otherwise("W"), "action", "visits", "value", "reward")
    return r.select("game_id", F.struct("ply", node.alias("n")).alias("m")).groupBy("game_id").agg(
        F.concat(F.lit("(;GM[atari]DLEN[3-30]OBS[00ffee]"), F.array_join(F.transform(F.sort_array(F.collect_list("m")), lambda m: m["n"]), ""), F.lit(")")).alias("value"))


@query("src_16_annotated_records", "annotated", """
SELECT game_id, ply, action, visits, round(value, 6) AS value, round(reward, 6) AS reward FROM annotated WHERE ply BETWEEN 3 AND 30""")
def _(spark, sf):
    rows = annotated_lines(spark, sf)
    ranges = rows.select("game_id", T.data_range(T.tag(F.col("value"), "DLEN"), T.move_count(F.col("value"))).alias("r"))
    moves = RD.explode_moves(rows).join(ranges, "game_id").filter("ply BETWEEN r.first AND r.last")
    number = lambda k: F.col("props")[k].cast("double")
    return moves.select("game_id", "ply", F.col("move").cast("bigint").alias("action"), F.col("props")["P"].alias("visits"), number("V").alias("value"), number("R").alias("reward"))


@query("flt_15_data_range", "scored_games", """
SELECT game_id, CASE WHEN game_id % 2 = 0 THEN 2 ELSE 0 END::BIGINT AS first, CASE WHEN game_id % 2 = 0 THEN plies // 2 ELSE plies - 1 END AS last FROM games""")
def _(spark, sf):
    dlen = F.when(F.col("game_id") % 2 == 0, F.concat(F.lit("2-"), F.floor(F.col("plies") / 2).cast("string")))
    return fx.games(spark, sf).select("game_id", T.data_range(dlen, F.col("plies")).alias("r")).select("game_id", "r.*")


@query("flt_14_payload_strip", "moves0", "SELECT user_id AS game_id, 'OBS[]' AS obs, count(*) AS moves FROM events GROUP BY 1")
def _(spark, sf):
    stripped = annotated_lines(spark, sf).select("game_id", T.blank_observations(F.col("value")).alias("value"))
    return stripped.select("game_id", F.regexp_extract("value", r"OBS\[[^\]]*\]", 0).alias("obs"), T.move_count(F.col("value")).cast("bigint").alias("moves"))


@query("src_17_player_records", "", """
SELECT 'p' || c_custkey AS id, 800 + CAST(floor(c_acctbal / 10) AS BIGINT) AS rating, c_custkey % 60 AS games, c_custkey % 5 = 0 AS prov, c_custkey % 17 = 0 AS closed FROM customer""")
def _(spark, sf):
    k = F.col("c_custkey")
    rapid = F.struct((F.lit(800) + F.floor(F.col("c_acctbal") / 10)).alias("rating"), F.when(k % 5 == 0, True).alias("prov"), (k % 60).alias("games"))
    doc = fx.read(spark, sf, "customer").select(F.concat(F.lit("p"), k).alias("id"), F.struct(rapid.alias("rapid")).alias("perfs"), F.when(k % 17 == 0, True).alias("closed"))
    path = scratch_path(spark, "players")
    doc.write.json(path)
    rows = TB.read_player_records(spark, path)
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return rows.select("id", "rating", "games", flag("prov"), flag("closed"))


# Text functions ---------------------------------------------------------------------------------


@query("scl_12_line_digest", "games", "SELECT game_id, md5(CAST(game_id AS VARCHAR)) AS digest FROM games")
def _(spark, sf):
    return fx.games(spark, sf).select("game_id", C.digest(F.concat(F.lit("  "), F.col("game_id").cast("string"), F.lit(" "))).alias("digest"))


@query("scl_13_root_tags", "games moves", """
SELECT g.game_id, g.white, strftime(g.played_at, '%Y.%m.%d') AS day, count(m.ply) AS moves FROM games g LEFT JOIN moves m USING (game_id) GROUP BY 1, 2, 3""")
def _(spark, sf):
    v = F.col("value")
    return lines(spark, sf).select("game_id", T.tag(v, "PW").alias("white"), T.tag(v, "DT").alias("day"), T.move_count(v).cast("bigint").alias("moves"))


table("node_text", "moves", "SELECT game_id, ply, ';' || CASE WHEN color = 'white' THEN 'B' ELSE 'W' END || '[' || move || ']TM[' || clock_s || ']' AS node FROM moves")


@query("scl_14_prefix_and_tail", "node_text scored_games", """
SELECT game_id, string_agg(node, '' ORDER BY ply) FILTER (ply < 10) || ')' AS prefix, string_agg(node, '' ORDER BY ply) FILTER (ply >= n_moves - 5) || ')' AS tail FROM node_text JOIN scored_games USING (game_id) GROUP BY 1""")
def _(spark, sf):
    v = F.col("value")
    rows = lines(spark, sf).join(fx.scored_games(spark, sf).select("game_id"), "game_id", "left_semi")
    body = lambda c: F.regexp_replace(c, r"^\(;GM.*?(?=;[BW]\[)", "")
    return rows.select("game_id", body(T.prefix(v, 10)).alias("prefix"), body(T.last_moves(v, 5)).alias("tail"))


@query("scl_15_phase_tags", "starts scored_games", """
SELECT game_id, 'PM[' || coalesce(middle, -1) || ']PE[' || coalesce("end", -1) || '];B[' AS inserted FROM starts JOIN scored_games USING (game_id)""")
def _(spark, sf):
    rows = lines(spark, sf).join(D.phase_starts(fx.occupancy(spark, sf)), "game_id")
    tagged = T.insert_phase_tags(F.col("value"), F.col("middle"), F.col("end"))
    return rows.select("game_id", F.regexp_extract(tagged, r"PM\[-?\d+\]PE\[-?\d+\];B\[", 0).alias("inserted"))


@query("scl_16_clocks", "games", """
SELECT game_id, (game_id % 3) * 3600 + (game_id % 60) * 60 + game_id % 59 AS seconds, 60 + game_id % 5 AS base_s, game_id % 4 AS increment_s FROM games""")
def _(spark, sf):
    g = F.col("game_id")
    clock = F.format_string("%d:%02d:%02d", g % 3, g % 60, g % 59)
    control = F.format_string("%d+%d", F.lit(60) + g % 5, g % 4)
    return fx.games(spark, sf).select("game_id", T.clock_seconds(clock).alias("seconds"), T.time_control(control).alias("t")).select("game_id", "seconds", "t.*")


# Sinks ------------------------------------------------------------------------------------------


@query("snk_01_partitioned_corpus", "kept", """
SELECT CASE WHEN rn <= 2200 THEN 'eval' ELSE 'train' END AS split, bin, count(*) AS n FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY bin ORDER BY md5('quota:' || game_id), game_id) AS rn FROM kept) GROUP BY 1, 2""")
def _(spark, sf):
    from duelgauge.plans.registry import QUERIES

    path = scratch_path(spark, "corpus")
    SK.write_partitioned(QUERIES["smp_01_quota_and_training"](spark, sf), path, "split", "bin")
    return spark.read.parquet(path).groupBy("split", F.col("bin").cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("snk_03_markdown_report", "calibration", """
SELECT '| ' || low || ' | ' || high || ' | ' || printf('%.3f', center) || ' | ' || games || ' | ' || moves || ' | ' || printf('%.3f', mean_score) || ' |' AS value FROM calibration""")
def _(spark, sf):
    report = E.calibration(spark, sf)
    path = scratch_path(spark, "report")
    SK.write_report(report, path)
    stored = spark.read.option("header", True).schema(report.schema).csv(path)
    return SK.markdown_rows(stored)


@query("snk_04_qa_document", "games", """
SELECT count(*) AS lines, count(*) FILTER (result <> 0) AS decisive, count(*) FILTER (result = 0) AS draws, count(*) FILTER (abs(white_elo - black_elo) < 25) AS first_bin FROM games""")
def _(spark, sf):
    g = fx.games(spark, sf)
    gap = F.abs(F.col("white_elo") - F.col("black_elo")).cast("double")
    doc = SK.qa_document(G.moments(g, gap, "event"), G.fixed_histogram(g, gap, 0.0, 2000.0, 80), C.corpus_qa(g))
    path = written(spark, "qa", doc)
    read = spark.read.schema("lines bigint, decisive bigint, draws bigint, histogram array<bigint>").json(path)
    return read.select("lines", "decisive", "draws", F.get("histogram", F.lit(1)).alias("first_bin"))


@query("snk_05_metrics_document", "predicted", """
SELECT count(*) AS n_examples, round(avg(CAST(predicted = result AS DOUBLE)), 6) AS accuracy, CAST(10 AS INT) AS samples FROM predicted""")
def _(spark, sf):
    scored = PQ.baseline(spark, sf).withColumn("context_size", F.lit(8))
    doc = SK.metrics_document(P.metrics(scored), P.slice_metrics(scored), scored.select("game_id", "p_white", "p_draw", "p_black", "predicted"))
    path = written(spark, "metrics", doc)
    read = spark.read.schema("n_examples bigint, accuracy double, sample_predictions array<struct<game_id: bigint>>").json(path)
    return read.select("n_examples", "accuracy", F.size("sample_predictions").alias("samples"))


@query("snk_06_position_map_json", "move_scores", "SELECT fen_before || ' | ' || move AS key, count(*) AS n FROM move_scores GROUP BY 1")
def _(spark, sf):
    from duelgauge.operators import phases as PH

    named = PH.position_map(fx.move_scores(spark, sf)).withColumn("key", F.concat_ws(" | ", "fen_before", "move"))
    path = written(spark, "positions", SK.json_document(named, "key", F.struct("average_strength", F.col("n").alias("count"))))
    return spark.read.schema("key string, v struct<average_strength: double, count: bigint>").json(path).select("key", F.col("v.count").alias("n"))


@query("snk_07_activity_list", "appearances", "SELECT player || ' ' || n AS value FROM appearances")
def _(spark, sf):
    counts = C.player_activity(C.sides(fx.games(spark, sf)))
    path = written(spark, "activity", counts.select(F.concat_ws(" ", "player", F.col("n").cast("string")).alias("value")))
    return spark.read.text(path)


@query("snk_08_record_lines", "games node_text", """
SELECT g.game_id, md5('(;GM[chess]RE[' || result || '.0]EV[' || event || ']PW[' || white || ']PB[' || black || ']DT[' || strftime(played_at, '%Y.%m.%d') || ']' || CASE WHEN white_elo > 0 THEN 'WR[' || white_elo || ']' ELSE '' END || 'BR[' || black_elo || ']' || coalesce(m.body, '') || ')') AS digest
FROM games g LEFT JOIN (SELECT game_id, string_agg(node, '' ORDER BY ply) AS body FROM node_text GROUP BY 1) m USING (game_id)""")
def _(spark, sf):
    return lines(spark, sf).select("game_id", F.md5("value").alias("digest"))


# Scorers and streams ----------------------------------------------------------------------------


def parity_scorer(batches):
    """A closed-form scorer: the score of a move depends only on its ply and text."""
    import pandas as pd

    for batch in batches:
        long = batch.explode("moves").reset_index(drop=True)
        ply = long.groupby("game_id").cumcount()
        points = long["moves"].str[1].astype(int) - long["moves"].str[3].astype(int)
        yield pd.DataFrame({"game_id": long["game_id"], "ply": ply, "color": (ply % 2).map({0: "white", 1: "black"}), "score": points / 7.0 + ply / 101.0})


@query("udf_01_supplied_scorer", "moves", """
SELECT game_id, color, round(avg((CAST(substr(move, 2, 1) AS INT) - CAST(substr(move, 4, 1) AS INT)) / 7.0::DOUBLE + ply / 101.0::DOUBLE), 6) AS score, count(*) AS moves FROM moves GROUP BY 1, 2""")
def _(spark, sf):
    games = S.game_moves(fx.moves(spark, sf).select("game_id", "ply", "move"))
    return rounded(S.side_means(S.score_games(games, parity_scorer)))


# Short move lists used as openings of the replayed games.
OPENINGS = (
    "e2e4 e7e5 g1f3 b8c6 f1c4 g8f6 e1h1 f8c5 d2d3 e8h8",
    "d2d4 d7d5 c2c4 e7e6 b1c3 g8f6 c1g5 f8e7 e2e3 e8h8",
    "e2e4 d7d5 e4d5 d8d5 b1c3 d5a5 d2d4 c7c6 g1f3 g8f6",
    "e2e4 a7a6 e4e5 d7d5 e5d6 c7d6 d2d4 e2e4",
)


def opening_games(spark, sf):
    """Every game plays one of the openings, cut to a length that its event count decides."""
    book = F.array(*[F.split(F.lit(line), " ") for line in OPENINGS])
    picked = F.get(book, (F.col("game_id") % len(OPENINGS)).cast("int"))
    return fx.games(spark, sf).select("game_id", F.slice(picked, 1, F.lit(4) + (F.col("game_id") % 7).cast("int")).alias("moves"))


@query("udf_05_position_replay", "games", """
SELECT CASE WHEN game_id % 4 = 3 AND 4 + game_id % 7 >= 8 THEN 'illegal_move_replay' ELSE 'ok' END AS status, count(*) AS games FROM games GROUP BY 1""")
def _(spark, sf):
    clean, broken = S.split_replay(S.replay_positions(opening_games(spark, sf)))
    ok = clean.filter("ply = 0").select(F.lit("ok").alias("status"))
    return ok.unionByName(broken.select(F.col("reason").alias("status"))).groupBy("status").agg(F.count(F.lit(1)).alias("games"))


table("selfplay_marked", "games", """
 SELECT game_id // 500 AS iteration, CASE WHEN game_id % 29 = 0 THEN game_id // 500 - 1 ELSE game_id // 500 END AS model_step, game_id % 9 <> 0 AS is_terminal, 20 + game_id % 60 AS game_length,
  10 + game_id % 30 AS data_length, CAST(result AS DOUBLE) AS ret, CASE WHEN game_id % 101 = 0 OR game_id % 103 = 0 THEN 1 ELSE 0 END AS broken FROM games""")


@query("st_01_selfplay_intake", "selfplay_marked", """
SELECT iteration, count(*) AS games, count(*) FILTER (is_terminal) AS finished_games, round(avg(game_length) FILTER (is_terminal), 6) AS avg_length, round(coalesce(stddev_samp(ret) FILTER (is_terminal), 0), 6) AS std_return, round(avg(data_length), 6) AS avg_data_length
FROM selfplay_marked WHERE model_step = iteration AND broken = 0 GROUP BY 1""")
def _(spark, sf):
    g = F.col("game_id")
    it = F.floor(g / 500)
    step = F.when(g % 29 == 0, it - 1).otherwise(it)
    head = F.format_string("SelfPlay %s %d %d %.1f (;EV[weight_iter_%d]) #", (g % 9 != 0).cast("string"), F.lit(10) + g % 30, F.lit(20) + g % 60, F.col("result").cast("double"), step)
    text = F.when(g % 101 == 0, F.concat(head, F.lit(" SelfPlay"))).when(g % 103 == 0, F.substring_index(head, " #", 1)).otherwise(head)
    messages = fx.games(spark, sf).select(it.alias("iteration"), text.alias("value"))
    source = written(spark, "selfplay", RD.bundle_lines(messages, log_folder("iteration")), lines_per_file=SK.LINES_PER_FILE)
    out = ST.selfplay_intake(spark, source, scratch_path(spark, "stats"), scratch_path(spark, "stream"), files_per_batch=20)
    return rounded(out, "iteration", "games", "finished_games", "avg_length", "std_return", "avg_data_length")


@query("st_02_live_prediction", "trajectories", """
SELECT game_id, observed_plies, round(p_white, 6) AS p_white, predicted FROM trajectories WHERE observed_plies = total_plies AND observed_plies > 0""")
def _(spark, sf):
    from duelgauge.plans.progressive_queries import live_examples

    source = scratch_path(spark, "live-moves")
    fx.move_scores(spark, sf).select("game_id", "ply", "color", "score").repartition(6, "ply").write.parquet(source)
    out = ST.live_predictions(spark, source, schemas.MOVE_SCORES, live_examples(spark, sf), scratch_path(spark, "live"), scratch_path(spark, "stream"), files_per_batch=2)
    return rounded(out, "game_id", "observed_plies", "p_white", "predicted")
