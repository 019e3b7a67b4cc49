"""Registered queries: targets, boards, phases, replay, training batches."""

from pyspark.sql import functions as F

from duelgauge import fixtures as fx
from duelgauge.functions import board as B
from duelgauge.functions import rating as R
from duelgauge.functions import targets as V
from duelgauge.operators import boundaries as D
from duelgauge.operators import replay as RB
from duelgauge.operators import training as TR
from duelgauge.plans.evaluation_queries import rounded
from duelgauge.plans.registry import query, table


def h(seed, *parts):
    return f"CAST('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(parts)})), 1, 15) AS BIGINT)"


table("positions", "games", """
 SELECT game_id, ply, color FROM (SELECT game_id, p.ply, CASE WHEN p.ply % 2 = 0 THEN 'white' ELSE 'black' END AS color FROM games, LATERAL (SELECT unnest(range(plies)) AS ply) p) WHERE NOT (game_id % 17 = 0 AND color = 'black')""")
table("ranked_games", "binned", "SELECT *, bbin AS rank FROM binned WHERE bbin IS NOT NULL")
table("occupancy0", "moves", f"""
 SELECT game_id, ply, ({h('a', 'game_id', 'ply')} & {h('b', 'game_id', 'ply')} & {h('c', 'game_id', 'ply')} & CASE WHEN ply >= 35 + game_id % 30 THEN {h('t', 'game_id', 'ply')} ELSE -1 END) | CASE WHEN ply < 10 + game_id % 20 THEN 255 ELSE 15 END AS white,
  ({h('d', 'game_id', 'ply')} & {h('e', 'game_id', 'ply')} & {h('f', 'game_id', 'ply')} & CASE WHEN ply >= 35 + game_id % 30 THEN {h('t', 'game_id', 'ply')} ELSE -1 END) | CASE WHEN ply < 10 + game_id % 20 THEN {-(1 << 56)} ELSE {15 << 56} END AS b0,
  {h('g', 'game_id', 'ply')} & {h('h', 'game_id', 'ply')} AS pm FROM moves""")
table("occupancy", "occupancy0", "SELECT game_id, ply, white, b0 & ~white AS black, 16::BIGINT AS kings, (white | (b0 & ~white)) & pm AS pawns FROM occupancy0")


def mixedness_sql():
    terms = []
    for rank in range(1, 8):
        row = [0] * 25
        for (w, b), values in B.REGION_WORTH.items():
            row[w * 5 + b] = values[rank - 1]
        for file in range(7):
            m = B.signed(B.region_mask(rank, file))
            terms.append(f"{row}[1 + 5 * bit_count(white & ({m})::BIGINT) + bit_count(black & ({m})::BIGINT)]")
    return " + ".join(terms)


table("measured", "occupancy", f"""
 SELECT game_id, ply, {mixedness_sql()} AS mix, bit_count((white | black) & ~(kings | pawns)) AS pieces,
  bit_count(white & 255) < 4 OR bit_count(black & ({-(1 << 56)})) < 4 AS sparse FROM occupancy""")
table("starts", "measured", """
 SELECT game_id, CASE WHEN m IS DISTINCT FROM e THEN m END AS middle, e AS "end" FROM (
  SELECT game_id, min(ply) FILTER (pieces <= 10 OR sparse OR mix > 150) AS m, min(ply) FILTER (pieces <= 6) AS e FROM measured GROUP BY 1)""")


@query("scl_17_mixedness", "measured", "SELECT game_id, ply, CAST(mix AS INT) AS mixedness, CAST(pieces AS INT) AS pieces FROM measured")
def _(spark, sf):
    w, b = F.col("white"), F.col("black")
    return fx.occupancy(spark, sf).select(
        "game_id", "ply", B.mixedness(w, b).cast("int").alias("mixedness"), B.piece_count(w, b, F.col("kings"), F.col("pawns")).cast("int").alias("pieces")
    )


@query("win_07_phase_boundaries", "starts", 'SELECT game_id, coalesce(middle, -1) AS middle, coalesce("end", -1) AS "end" FROM starts')
def _(spark, sf):
    out = D.phase_starts(fx.occupancy(spark, sf))
    return out.select("game_id", *[F.coalesce(c, F.lit(-1)).cast("bigint").alias(c) for c in ("middle", "end")])


@query("win_07_phase_labels", "starts moves", """
SELECT m.game_id, m.ply, CASE WHEN m.ply >= s."end" THEN 'endgame' WHEN m.ply >= s.middle THEN 'midgame' ELSE 'opening' END AS phase FROM moves m LEFT JOIN starts s USING (game_id)""")
def _(spark, sf):
    return D.label_plies(fx.moves(spark, sf).select("game_id", "ply"), D.phase_starts(fx.occupancy(spark, sf))).select("game_id", "ply", "phase")


table("phase_spans", "starts scored_games", """
 SELECT game_id, phase, s AS start, e AS stop FROM (
  SELECT game_id, 'opening' AS phase, 0 AS s, coalesce(middle, "end", n_moves) AS e FROM starts JOIN scored_games USING (game_id)
  UNION ALL SELECT game_id, 'midgame', middle, coalesce("end", n_moves) FROM starts JOIN scored_games USING (game_id)
  UNION ALL SELECT game_id, 'endgame', "end", n_moves FROM starts JOIN scored_games USING (game_id)) WHERE e > s""")


@query("win_19_phase_ranges", "phase_spans", "SELECT game_id, phase, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM phase_spans")
def _(spark, sf):
    starts = D.phase_starts(fx.occupancy(spark, sf)).join(fx.scored_games(spark, sf).select("game_id", "n_moves"), "game_id")
    return starts.select("game_id", F.explode(D.phase_ranges(F.col("n_moves"), F.col("middle"), F.col("end"))).alias("r")).select("game_id", "r.*")


table("tagged", "ranked_games", """
 SELECT game_id, rank AS bin, plies AS moves, CASE WHEN game_id % 19 = 0 THEN '' WHEN game_id % 7 = 0 THEN '-1' ELSE CAST(plies // 3 AS VARCHAR) END AS middle_tag,
  CASE WHEN game_id % 5 = 0 THEN '-1' WHEN game_id % 23 = 0 THEN CAST(plies + 2 AS VARCHAR) ELSE CAST(plies * 2 // 3 AS VARCHAR) END AS end_tag FROM ranked_games""")
table("tag_status", "tagged", """
 SELECT *, CASE WHEN middle_tag = '' OR end_tag = '' THEN 'missing' WHEN m BETWEEN -1 AND moves - 1 AND e BETWEEN -1 AND moves - 1 AND (e = -1 OR (m <> -1 AND m < e)) THEN 'ok' ELSE 'invalid' END AS status
 FROM (SELECT *, TRY_CAST(middle_tag AS BIGINT) AS m, TRY_CAST(end_tag AS BIGINT) AS e FROM tagged)""")
table("examples0", "tag_status", """
 SELECT game_id, bin, phase, s AS start, t AS stop FROM (
  SELECT game_id, bin, 'opening' AS phase, 0 AS s, CASE WHEN m >= 0 THEN m WHEN e >= 0 THEN e ELSE moves END AS t FROM tag_status WHERE status = 'ok'
  UNION ALL SELECT game_id, bin, 'midgame', m, CASE WHEN e >= 0 THEN e ELSE moves END FROM tag_status WHERE status = 'ok' AND m >= 0
  UNION ALL SELECT game_id, bin, 'endgame', e, moves FROM tag_status WHERE status = 'ok' AND e >= 0) WHERE t > s""")
table("examples", "examples0", "SELECT *, (stop + 1) // 2 - (start + 1) // 2 >= 6 AS white_ok, stop // 2 - start // 2 >= 6 AS black_ok FROM examples0")


def tagged(spark, sf):
    g, p = F.col("game_id"), F.col("plies")
    text = lambda c: c.cast("bigint").cast("string")
    return fx.ranked_games(spark, sf).select(
        "game_id", F.col("rank").alias("bin"), p.alias("moves"),
        F.when(g % 19 == 0, "").when(g % 7 == 0, "-1").otherwise(text(F.floor(p / 3))).alias("middle_tag"),
        F.when(g % 5 == 0, "-1").when(g % 23 == 0, text(p + 2)).otherwise(text(F.floor(p * 2 / 3))).alias("end_tag"),
    )


@query("flt_16_phase_tag_status", "tag_status", "SELECT game_id, status FROM tag_status")
def _(spark, sf):
    return tagged(spark, sf).select("game_id", D.tag_status(F.col("middle_tag"), F.col("end_tag"), F.col("moves")).alias("status"))


@query("agg_36_loader_statistics", "tag_status examples", """
SELECT b.bin, count(t.game_id) AS games, count(*) FILTER (status = 'missing') AS missing_tags, count(*) FILTER (status = 'invalid') AS invalid_tags, """ + ", ".join(
    f"(SELECT count(*) FROM examples x WHERE x.bin = b.bin AND phase = '{p}' AND (white_ok OR black_ok)) AS {p}_examples, (SELECT count(*) FROM examples x WHERE x.bin = b.bin AND phase = '{p}' AND NOT (white_ok OR black_ok)) AS {p}_too_few"
    for p in ("opening", "midgame", "endgame")) + " FROM (SELECT CAST(range AS BIGINT) AS bin FROM range(8)) b LEFT JOIN tag_status t USING (bin) GROUP BY 1")
def _(spark, sf):
    return D.require_examples(D.loader_statistics(tagged(spark, sf), 6, 8))


# Scalar targets ---------------------------------------------------------------------------------


@query("scl_18_value_rescale", "", """
SELECT event_id, round(sign(value) * (sqrt(abs(value) + 1) - 1) + 0.001::DOUBLE * value, 6) AS rescaled, round(value, 6) AS restored FROM events""")
def _(spark, sf):
    v = V.rescale(F.col("value"))
    return rounded(fx.read(spark, sf, "events").select("event_id", v.alias("rescaled"), V.invert_rescale(v).alias("restored")))


@query("scl_19_two_hot", "", """
SELECT event_id, i AS idx, round(CASE WHEN floor(x) = ceil(x) AND i = greatest(least(floor(x) + 10, 20), 0) THEN 1 WHEN i = greatest(least(ceil(x) + 10, 20), 0) THEN x - floor(x) WHEN i = greatest(least(floor(x) + 10, 20), 0) THEN ceil(x) - x ELSE 0 END, 6)::DOUBLE AS p
FROM (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 3.0 ELSE (value - 50) / 6 END::DOUBLE AS x FROM events), (SELECT CAST(range AS INT) AS i FROM range(21))""")
def _(spark, sf):
    x = F.when(F.col("event_id") % 10 == 0, F.lit(3.0)).otherwise((F.col("value") - 50) / 6)
    rows = fx.read(spark, sf, "events").select("event_id", F.posexplode(V.two_hot(x, 21)).alias("idx", "p"))
    return rounded(rows)


table("replay", "moves", """
 SELECT game_id, ply, event_id, event_id % 9 AS action, CASE WHEN event_id % 7 = 0 THEN '' ELSE (event_id % 9) || ':' || (1 + event_id % 5) || ',' || ((event_id + 3) % 9) || ':' || (2 + event_id % 3) END AS visits,
  value / 10.3::DOUBLE AS reward, value / 3.1::DOUBLE AS value, CASE WHEN event_type = 'error' THEN event_id % 3 END AS lives FROM moves""")
table("policies", "replay", """
 SELECT event_id, game_id, ply, CAST(i AS INT) AS idx, CASE WHEN event_id % 11 = 0 THEN 1 / 9.0::DOUBLE WHEN visits = '' THEN CAST(i = action AS INT)::DOUBLE
  ELSE (CASE WHEN i = event_id % 9 THEN 1 + event_id % 5 WHEN i = (event_id + 3) % 9 THEN 2 + event_id % 3 ELSE 0 END) / (3 + event_id % 5 + event_id % 3)::DOUBLE END AS p FROM replay, (SELECT range AS i FROM range(9))""")


@query("scl_20_policy", "policies", "SELECT event_id, idx, round(p, 6) AS p FROM policies")
def _(spark, sf):
    action = F.when(F.col("event_id") % 11 != 0, F.col("action"))
    rows = fx.replay_rows(spark, sf).select("event_id", F.posexplode(V.policy(F.col("visits"), action, 9)).alias("idx", "p"))
    return rounded(rows)


@query("scl_22_board_points", "", """
SELECT event_id, CASE WHEN p = 361 THEN 'PASS' ELSE substr('ABCDEFGHJKLMNOPQRST', CAST(p % 19 + 1 AS BIGINT), 1) || (p // 19 + 1) END AS coordinate,
 CASE WHEN p = 361 THEN '' ELSE chr(CAST(97 + p % 19 AS INT)) || chr(CAST(97 + 18 - p // 19 AS INT)) END AS record, p AS from_coordinate, p AS from_record FROM (SELECT event_id, event_id % 362 AS p FROM events)""")
def _(spark, sf):
    rows = fx.read(spark, sf, "events").select("event_id", (F.col("event_id") % 362).alias("p")).select(
        "event_id", B.index_to_coordinate(F.col("p"), 19).alias("coordinate"), B.index_to_record(F.col("p"), 19).alias("record")
    )
    return rows.select(
        "event_id", "coordinate", "record", B.coordinate_to_index(F.col("coordinate"), 19).cast("bigint").alias("from_coordinate"),
        B.record_to_index(F.col("record"), 19).cast("bigint").alias("from_record"),
    )


@query("scl_23_one_hot_rank", "ranked_games", "SELECT game_id, CAST(i AS INT) AS idx, CAST(i = rank AS INT)::DOUBLE AS p FROM ranked_games, (SELECT range AS i FROM range(8))")
def _(spark, sf):
    return fx.ranked_games(spark, sf).select("game_id", F.posexplode(V.one_hot(F.col("rank"), 8)).alias("idx", "p"))


@query("scl_25_expected_value", "", """
SELECT vec_id, round(list_sum(list_transform(range(64), lambda i: embedding[i + 1]::DOUBLE * (i - 32))), 6) AS value FROM embeddings""")
def _(spark, sf):
    return rounded(fx.read(spark, sf, "embeddings").select("vec_id", V.expected_value(F.col("embedding"), 64).alias("value")))


@query("scl_01_color_move_count", "games", "SELECT game_id, (plies + 1) // 2 AS white_moves, plies // 2 AS black_moves FROM games")
def _(spark, sf):
    return fx.games(spark, sf).select("game_id", *[R.color_move_count(F.col("plies"), c).alias(f"{c}_moves") for c in ("white", "black")])


@query("scl_08_inverse_line", "scored_sides line", "SELECT game_id, color, round((score - intercept) / slope, 5) AS elo FROM scored_sides, line")
def _(spark, sf):
    from duelgauge.operators import calibration as K
    from duelgauge.plans.evaluation_queries import calibration

    rows = K.side_scores(fx.game_scores(spark, sf)).withColumn("_line", K.line_constant(K.fit_line(calibration(spark, sf))))
    return rows.select("game_id", "color", F.round(K.line_elo(F.col("score"), F.col("_line")), 5).alias("elo"))


@query("smp_13_symmetries", "", """
SELECT event_id, s AS symmetry, CAST(CASE WHEN p = 81 THEN 81 ELSE ty * 9 + tx END AS BIGINT) AS point FROM (
 SELECT *, CASE s % 4 WHEN 0 THEN x WHEN 1 THEN r WHEN 2 THEN 8 - x ELSE 8 - r END AS tx, CASE s % 4 WHEN 0 THEN r WHEN 1 THEN 8 - x WHEN 2 THEN 8 - r ELSE x END AS ty FROM (
  SELECT event_id, p, CAST(s AS INT) AS s, p % 9 AS x, CASE WHEN s >= 4 THEN 8 - p // 9 ELSE p // 9 END AS r FROM (SELECT event_id, event_id % 82 AS p FROM events), (SELECT range AS s FROM range(8))))""")
def _(spark, sf):
    rows = fx.read(spark, sf, "events").select("event_id", (F.col("event_id") % 82).alias("p"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("symmetry"))
    return rows.select("event_id", "symmetry", B.symmetric_index(F.col("p"), F.col("symmetry"), 9).cast("bigint").alias("point"))


# Replay -----------------------------------------------------------------------------------------

NSTEP, DISCOUNT = 5, 0.9
table("nstep_plain", "replay", f"""
 SELECT a.game_id, a.ply, any_value(a.value) AS value, sum(CASE WHEN b.ply < a.ply + {NSTEP} THEN pow({DISCOUNT}::DOUBLE, b.ply - a.ply) * b.reward ELSE pow({DISCOUNT}::DOUBLE, {NSTEP}) * b.value END) AS n_step
 FROM replay a JOIN replay b ON a.game_id = b.game_id AND b.ply BETWEEN a.ply AND a.ply + {NSTEP} GROUP BY 1, 2""")
table("nstep_life", "replay", f"""
 SELECT a.game_id, a.ply, coalesce(sum(CASE WHEN b.ply < a.ply + {NSTEP} THEN pow({DISCOUNT}::DOUBLE, b.ply - a.ply) * b.reward WHEN b.lives IS NULL THEN pow({DISCOUNT}::DOUBLE, {NSTEP}) * b.value END) FILTER (s.stop IS NULL OR b.ply < s.stop), 0) AS n_step
 FROM replay a JOIN replay b ON a.game_id = b.game_id AND b.ply BETWEEN a.ply AND a.ply + {NSTEP}
 LEFT JOIN (SELECT a.game_id, a.ply, min(c.ply) AS stop FROM replay a JOIN replay c ON a.game_id = c.game_id AND c.ply >= a.ply AND c.ply < a.ply + {NSTEP} AND c.lives > 0 GROUP BY 1, 2) s ON s.game_id = a.game_id AND s.ply = a.ply GROUP BY 1, 2""")


@query("win_17_n_step_return", "nstep_plain", "SELECT game_id, ply, round(n_step, 6) AS n_step FROM nstep_plain")
def _(spark, sf):
    return rounded(RB.n_step_returns(fx.replay_rows(spark, sf), NSTEP, DISCOUNT), "game_id", "ply", "n_step")


@query("win_17_n_step_life_loss", "nstep_life", "SELECT game_id, ply, round(n_step, 6) AS n_step FROM nstep_life")
def _(spark, sf):
    return rounded(RB.n_step_returns(fx.replay_rows(spark, sf), NSTEP, DISCOUNT, life_loss=True), "game_id", "ply", "n_step")


@query("scl_21_priority", "nstep_plain", "SELECT game_id, ply, round(abs(n_step - value) + 1e-6, 6) AS priority FROM nstep_plain")
def _(spark, sf):
    rows = RB.n_step_returns(fx.replay_rows(spark, sf), NSTEP, DISCOUNT)
    return rounded(rows.select("game_id", "ply", V.priority(F.col("n_step"), F.col("value"), 1e-6).alias("priority")))


@query("win_18_replay_retention", "games", "SELECT game_id FROM games ORDER BY played_at DESC, game_id DESC LIMIT 2000")
def _(spark, sf):
    return RB.newest_games(fx.games(spark, sf).select("game_id", "played_at"), 2000, "played_at").select("game_id")


K = 4
table("unrolled", "replay", f"""
 SELECT a.game_id, a.ply, i, r.action, coalesce(r.action, {h('pad', 'a.game_id', 'a.ply + i')} % 9) AS any_action, coalesce(r.reward, 0) AS reward, coalesce(r.value, 0) AS value
 FROM replay a JOIN (SELECT range AS i FROM range({K + 1})) s ON TRUE LEFT JOIN replay r ON r.game_id = a.game_id AND r.ply = a.ply + i""")


@query("win_23_unrolled_targets", "unrolled", f"""
SELECT game_id, ply, string_agg(any_action, ',' ORDER BY i) FILTER (i < {K}) AS actions, round(sum(reward * (i + 1)) FILTER (i < {K}), 6) AS reward_check, round(sum(value * (i + 1)), 6) AS value_check, count(*) FILTER (action IS NULL) AS padded FROM unrolled GROUP BY 1, 2""")
def _(spark, sf):
    rows = RB.unrolled_targets(fx.replay_rows(spark, sf), K, 9, "pad")
    weigh = lambda c: F.aggregate(F.transform(c, lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return rounded(rows.select(
        "game_id", "ply", F.concat_ws(",", F.transform("actions", lambda a: a.cast("string"))).alias("actions"),
        weigh("rewards").alias("reward_check"), weigh("values").alias("value_check"),
        F.size(F.filter("policy_actions", lambda a: a.isNull())).cast("bigint").alias("padded"),
    ))


@query("win_22_rank_labels", "ranked_games", "SELECT rank, CAST(ROW_NUMBER() OVER (ORDER BY rank) - 1 AS INT) AS label FROM (SELECT DISTINCT rank FROM ranked_games)")
def _(spark, sf):
    return TR.rank_labels(fx.ranked_games(spark, sf))


@query("win_24_position_targets", "policies ranked_games", """
, l AS (SELECT rank, ROW_NUMBER() OVER (ORDER BY rank) - 1 AS label FROM (SELECT DISTINCT rank FROM ranked_games))
SELECT game_id, ply, idx, round(CASE WHEN event_id % 11 = 0 THEN CASE WHEN event_id % 7 = 0 THEN CAST(idx = event_id % 9 AS INT)::DOUBLE ELSE (CASE WHEN idx = event_id % 9 THEN 1 + event_id % 5 WHEN idx = (event_id + 3) % 9 THEN 2 + event_id % 3 ELSE 0 END) / (3 + event_id % 5 + event_id % 3)::DOUBLE END ELSE p END, 6) AS policy,
 CAST(result AS DOUBLE) AS value, CAST(label AS INT) AS label FROM policies JOIN ranked_games USING (game_id) JOIN l USING (rank)""")
def _(spark, sf):
    rows = TR.position_targets(fx.replay_rows(spark, sf), fx.ranked_games(spark, sf), 9, 8)
    return rounded(rows.select("game_id", "ply", F.posexplode("policy").alias("idx", "policy"), "value", "label"), "game_id", "ply", "idx", "policy", "value", "label")


ALPHA, BETA, DRAWS = 0.6, 0.4, 500
table("weights", "nstep_plain", f"SELECT game_id, ply, pow(abs(n_step - value) + 1e-6, {ALPHA}::DOUBLE) AS weight FROM nstep_plain")
table("cumulative", "weights", """
 SELECT *, sum(weight) OVER (ORDER BY md5('replay:' || game_id), game_id, ply ROWS UNBOUNDED PRECEDING) AS upto, sum(weight) OVER () AS total, count(*) OVER () AS n FROM weights""")


@query("smp_11_prioritised_draws", "cumulative", f"""
, d AS (SELECT range AS draw, CAST('0x' || substr(md5('per:' || range), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE * (SELECT any_value(total) FROM cumulative) AS u FROM range({DRAWS}))
SELECT draw, game_id, ply, round(pow(n * weight / total, -{BETA}::DOUBLE), 6) AS loss_scale FROM d JOIN cumulative ON u < upto AND u >= upto - weight""")
def _(spark, sf):
    rows = RB.n_step_returns(fx.replay_rows(spark, sf), NSTEP, DISCOUNT)
    ready = RB.prioritised(rows.withColumn("priority", V.priority(F.col("n_step"), F.col("value"), 1e-6)), ALPHA)
    return rounded(RB.weighted_draws(ready.select("game_id", "ply", "weight"), DRAWS, "per", BETA))


# Batches ----------------------------------------------------------------------------------------

GROUPS, RANKS, P = 60, 4, 3
table("rank_pool", "ranked_games", "SELECT rank, game_id, ROW_NUMBER() OVER (PARTITION BY rank ORDER BY md5('pool:' || game_id), game_id) AS draw, count(*) OVER (PARTITION BY rank) AS pool FROM ranked_games")


def choose_sql(seed, source="ranked_games", col="rank"):
    return f"""SELECT grp, ROW_NUMBER() OVER (PARTITION BY grp ORDER BY rank) - 1 AS slot, rank FROM (
      SELECT g.range AS grp, r.rank, ROW_NUMBER() OVER (PARTITION BY g.range ORDER BY md5(concat_ws(':', '{seed}', g.range, r.rank))) AS rn FROM range({GROUPS}) g, (SELECT DISTINCT {col} AS rank FROM {source}) r) WHERE rn <= {RANKS}"""


table("rg_slots", "ranked_games", choose_sql("rg-ranks"))
table("rg_games", "rg_slots rank_pool", f"SELECT s.*, p.game_id, CASE WHEN {h('rg-side', 's.grp', 's.rank')} % 2 = 0 THEN 'white' ELSE 'black' END AS color FROM rg_slots s JOIN rank_pool p ON p.rank = s.rank AND p.draw = {h('rg-game', 's.grp', 's.rank')} % p.pool + 1")


@query("smp_08_ranking_groups", "rg_games positions", f"""
SELECT grp, CAST(slot AS INT) AS slot, rank, game_id, ply FROM (SELECT g.*, p.ply, ROW_NUMBER() OVER (PARTITION BY grp, slot ORDER BY md5(concat_ws(':', 'rg-position', grp, slot, p.ply)), p.ply) AS rn FROM rg_games g JOIN positions p USING (game_id, color)) WHERE rn <= {P}""")
def _(spark, sf):
    return TR.ranking_groups(spark, fx.ranked_games(spark, sf), fx.positions(spark, sf), GROUPS, RANKS, P, "rg")


table("numbered_positions", "positions", "SELECT game_id, ply, ROW_NUMBER() OVER (PARTITION BY game_id ORDER BY ply) - 1 AS i, count(*) OVER (PARTITION BY game_id) AS len FROM positions")


@query("smp_08_independent_positions", "rg_slots rank_pool numbered_positions", f"""
SELECT grp, CAST(slot AS INT) AS slot, rank, CAST(nth AS INT) AS nth, game_id, ply FROM (
 SELECT s.*, n.range AS nth, p.game_id FROM rg_slots s JOIN range({P}) n ON TRUE JOIN rank_pool p ON p.rank = s.rank AND p.draw = {h('rg-game', 's.grp', 's.rank', 'n.range')} % p.pool + 1) JOIN numbered_positions USING (game_id) WHERE i = {h('rg-position', 'grp', 'rank', 'nth')} % len""")
def _(spark, sf):
    return TR.ranking_groups(spark, fx.ranked_games(spark, sf), fx.positions(spark, sf), GROUPS, RANKS, P, "rg", same_game=False)


@query("smp_12_uniform_positions", "rank_pool numbered_positions", f"""
, r AS (SELECT rank, ROW_NUMBER() OVER (ORDER BY rank) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT rank FROM rank_pool)),
b AS (SELECT g.range AS grp, r.rank FROM range({GROUPS}) g JOIN r ON r.i = {h('up-rank', 'g.range')} % r.n),
d AS (SELECT b.grp, b.rank, p.game_id FROM b JOIN rank_pool p ON p.rank = b.rank AND p.draw = {h('up-game', 'b.grp')} % p.pool + 1)
SELECT grp, rank, game_id, ply FROM d JOIN numbered_positions USING (game_id) WHERE i = {h('up-position', 'grp')} % len""")
def _(spark, sf):
    return TR.uniform_positions(spark, fx.ranked_games(spark, sf), fx.positions(spark, sf), GROUPS, "up")


table("side_counts", "positions", "SELECT game_id, count(*) FILTER (color = 'white') AS w, count(*) FILTER (color = 'black') AS b FROM positions GROUP BY 1")
table("slot_positions", "chain_slots positions side_counts", """
 SELECT s.attempt, s.slot, s.game_id, p.ply FROM (
  SELECT attempt, slot, game_id, unnest(CASE WHEN (color = 'white' AND w > 0) OR (color = 'black' AND b > 0) THEN [color] ELSE ['white', 'black'] END) AS want FROM chain_slots JOIN side_counts USING (game_id)) s
 JOIN positions p ON p.game_id = s.game_id AND p.color = s.want""")


@query("jn_19_slot_positions", "slot_positions", "SELECT attempt, CAST(slot AS INT) AS slot, game_id, ply FROM slot_positions")
def _(spark, sf):
    from duelgauge.plans.graph_queries import chain_slots

    return TR.slot_positions(chain_slots(spark, sf), fx.positions(spark, sf), "attempt", "slot").select("attempt", "slot", "game_id", "ply")


BATCH, CHAIN_P = 20, 30
table("chain_pool", "chain_slots", "SELECT attempt, ROW_NUMBER() OVER (ORDER BY md5('cb-pool:' || attempt), attempt) AS draw, count(*) OVER () AS n FROM (SELECT DISTINCT attempt FROM chain_slots)")


@query("smp_09_chain_batch", "slot_positions chain_pool", f"""
, d AS (SELECT g.range AS grp, p.attempt FROM range({BATCH}) g JOIN chain_pool p ON p.draw = {h('cb', 'g.range')} % p.n + 1),
r AS (SELECT d.grp, s.slot, s.game_id, s.ply, ROW_NUMBER() OVER (PARTITION BY d.grp, s.slot ORDER BY md5(concat_ws(':', 'cb-position', d.grp, s.slot, s.ply)), s.ply) - 1 AS i, count(*) OVER (PARTITION BY d.grp, s.slot) AS n FROM d JOIN slot_positions s USING (attempt))
SELECT grp, CAST(slot AS INT) AS slot, game_id, ply, j.range AS nth FROM r JOIN range({CHAIN_P}) j ON j.range % least(r.n, {CHAIN_P}) = r.i""")
def _(spark, sf):
    from duelgauge.plans.graph_queries import chain_slots

    return TR.chain_batch(spark, chain_slots(spark, sf), fx.positions(spark, sf), BATCH, CHAIN_P, "cb").withColumn("nth", F.col("nth").cast("bigint"))


table("usable_examples", "examples", "SELECT *, bin AS rank, ROW_NUMBER() OVER (PARTITION BY bin ORDER BY md5('pool:' || game_id || ':' || phase), game_id, phase) AS draw, count(*) OVER (PARTITION BY bin) AS pool FROM examples WHERE white_ok OR black_ok")
table("pb_slots", "usable_examples", choose_sql("pb-ranks", "usable_examples"))


@query("smp_10_phase_batch", "pb_slots usable_examples positions", f"""
, c AS (SELECT s.grp, s.slot, s.rank, e.phase, e.game_id, e.start, e.stop, CASE WHEN white_ok AND black_ok THEN CASE WHEN {h('pb-side', 's.grp', 's.rank')} % 2 = 0 THEN 'white' ELSE 'black' END WHEN white_ok THEN 'white' ELSE 'black' END AS color
 FROM pb_slots s JOIN usable_examples e ON e.rank = s.rank AND e.draw = {h('pb-example', 's.grp', 's.rank')} % e.pool + 1)
SELECT grp, CAST(slot AS INT) AS slot, rank, phase, game_id, color, ply FROM (
 SELECT c.*, p.ply, ROW_NUMBER() OVER (PARTITION BY grp, slot ORDER BY md5(concat_ws(':', 'pb-position', grp, slot, p.ply)), p.ply) AS rn FROM c JOIN positions p USING (game_id, color) WHERE p.ply >= c.start AND p.ply < c.stop) WHERE rn <= {P}""")
def _(spark, sf):
    return TR.phase_batch(spark, D.phase_examples(tagged(spark, sf), 6), fx.positions(spark, sf), GROUPS, RANKS, P, "pb")


table("list_scores", "rg_games side_scores", "SELECT g.grp, g.slot, s.score FROM rg_games g JOIN side_scores s USING (game_id, color)")


@query("agg_41_listwise_ranking", "list_scores", """
, w AS (SELECT *, ln(sum(exp(score)) OVER s) - score AS loss, score > max(score) OVER (PARTITION BY grp ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hit FROM list_scores WINDOW s AS (PARTITION BY grp ORDER BY slot ROWS UNBOUNDED PRECEDING))
SELECT round(avg(loss), 6) AS loss, round(avg(CAST(hit AS DOUBLE)), 6) AS accuracy, count(*) AS terms FROM w WHERE slot >= 1""")
def _(spark, sf):
    from duelgauge.plans.predict_queries import side_scores

    games = fx.ranked_games(spark, sf)
    slots = TR.choose_ranks(TR.groups(spark, GROUPS), games.select("rank").distinct(), RANKS, "rg-ranks")
    drawn = TR.draw_game(slots, games, "rg-game", "grp", "rank").withColumn("color", TR.side_of("rg-side", "grp", "rank"))
    return rounded(TR.listwise_ranking(drawn.join(side_scores(spark, sf), ["game_id", "color"]).select("grp", "slot", "score")))
