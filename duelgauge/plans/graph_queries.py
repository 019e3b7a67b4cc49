"""Registered queries: win graph, chains and their statistics."""

from pyspark.sql import functions as F

from duelgauge import fixtures as fx
from duelgauge.operators import corpus as C
from duelgauge.operators import graph as G
from duelgauge.plans.evaluation_queries import rounded
from duelgauge.plans.registry import query, table
from duelgauge.runtime import cut_lineage, require

LENGTH = 8
MAX_CHAINS = 50_000
ATTEMPTS = 20 * MAX_CHAINS
FIRST_ATTEMPTS = 90_000  # the SQL walks further attempts only where these give too few chains
STRIDE = 3

table("listed_games", "sides", """
 SELECT player, opponent, game_id, color, ROW_NUMBER() OVER (PARTITION BY player ORDER BY md5('reservoir:' || game_id || ':' || color), game_id, color) AS pos FROM sides""")
table("won_games", "games", """
 SELECT winner, loser, game_id, winner_elo, loser_elo, ROW_NUMBER() OVER (PARTITION BY winner ORDER BY md5('edges:' || game_id), game_id) AS rn FROM (
  SELECT CASE WHEN result > 0 THEN white ELSE black END AS winner, CASE WHEN result > 0 THEN black ELSE white END AS loser, game_id,
   CASE WHEN result > 0 THEN white_elo ELSE black_elo END AS winner_elo, CASE WHEN result > 0 THEN black_elo ELSE white_elo END AS loser_elo FROM games WHERE result <> 0)""")


def _hash(seed: str, *columns: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(columns)})), 1, 15) AS BIGINT)"


def chain_tables(name: str, edge_cap: int | None, game_cap: int | None, max_chains: int, attempts: int, first: int) -> None:
    """SQL of the chain builder: each draw is the n-th of all usable edges or games, listed and counted."""
    under = lambda column, cap: "TRUE" if cap is None else f"{column} <= {cap}"
    table(f"{name}_games", "listed_games", f"SELECT * FROM listed_games WHERE {under('pos', game_cap)}")
    table(f"{name}_edges", "won_games", f"SELECT *, ROW_NUMBER() OVER (PARTITION BY winner ORDER BY md5('index:' || loser), loser, game_id) AS pos FROM won_games WHERE {under('rn', edge_cap)}")
    table(f"{name}_starters", f"{name}_edges", f"SELECT winner, ROW_NUMBER() OVER (ORDER BY md5('chain-starters:' || winner), winner) AS pick, count(*) OVER () AS total FROM (SELECT DISTINCT winner FROM {name}_edges)")
    rounds = [("a", f"range({first})"), ("b", f"range({first}, CASE WHEN (SELECT count(*) FROM {name}_a_chains) >= {max_chains} THEN {first} ELSE {attempts} END)")]
    for part, tries in rounds:
        n = f"{name}_{part}"
        needs = f"{name}_starters" if part == "a" else f"{name}_starters {name}_a_chains"
        table(f"{n}_seeds", needs, f"SELECT a.range AS attempt, s.winner AS start FROM {tries} a JOIN {name}_starters s ON s.pick = {_hash('chain', 'a.range')} % s.total + 1")
        table(f"{n}_hop0", f"{n}_seeds", "SELECT attempt, start AS here, [start] AS players, []::STRUCT(loser VARCHAR, game_id BIGINT, winner_elo BIGINT, loser_elo BIGINT)[] AS es FROM " + f"{n}_seeds")
        for i in range(1, LENGTH):
            table(f"{n}_hop{i}", f"{n}_hop{i - 1} {name}_edges", f"""
 SELECT a.attempt, e.loser AS here, list_append(a.players, e.loser) AS players, list_append(a.es, struct_pack(loser := e.loser, game_id := e.game_id, winner_elo := e.winner_elo, loser_elo := e.loser_elo)) AS es FROM (
  SELECT p.attempt, any_value(p.here) AS here, any_value(p.players) AS players, any_value(p.es) AS es, list_sort(list(e.pos))[{_hash('chain', 'p.attempt', str(i))} % count(*) + 1] AS pos
  FROM {n}_hop{i - 1} p JOIN {name}_edges e ON e.winner = p.here WHERE NOT list_contains(p.players, e.loser) GROUP BY p.attempt) a JOIN {name}_edges e ON e.winner = a.here AND e.pos = a.pos""")
        table(f"{n}_slot0", f"{n}_hop{LENGTH - 1}", f"""
 SELECT attempt, list_reverse(players) AS players, list_reverse(es) AS es, list_transform(es, lambda e: e.game_id) AS forbidden, []::STRUCT(game_id BIGINT, color VARCHAR)[] AS picked FROM {n}_hop{LENGTH - 1}""")
        for i in range(LENGTH):
            table(f"{n}_slot{i + 1}", f"{n}_slot{i} {name}_games", f"""
 SELECT a.attempt, a.players, a.es, list_append(a.forbidden, g.game_id) AS forbidden, list_append(a.picked, struct_pack(game_id := g.game_id, color := g.color)) AS picked FROM (
  SELECT p.attempt, any_value(p.players) AS players, any_value(p.es) AS es, any_value(p.forbidden) AS forbidden, any_value(p.picked) AS picked, list_sort(list(g.pos))[{_hash('train', 'p.attempt', str(i))} % count(*) + 1] AS pos
  FROM {n}_slot{i} p JOIN {name}_games g ON g.player = p.players[{i + 1}] WHERE NOT list_contains(p.forbidden, g.game_id) GROUP BY p.attempt) a JOIN {name}_games g ON g.player = a.players[{i + 1}] AND g.pos = a.pos""")
        table(f"{n}_chains", f"{n}_slot{LENGTH}", f"SELECT attempt, players, es, picked FROM {n}_slot{LENGTH}")
    table(f"{name}_all", f"{name}_a_chains {name}_b_chains", f"SELECT * FROM {name}_a_chains UNION ALL SELECT * FROM {name}_b_chains")
    table(name, f"{name}_all", f"SELECT * FROM {name}_all ORDER BY attempt LIMIT {max_chains}")


def slots_table(name: str, chains: str) -> None:
    table(name, chains, f"""
 SELECT attempt, s.slot, players[s.slot + 1] AS player, picked[s.slot + 1].game_id AS game_id, picked[s.slot + 1].color AS color,
  CASE WHEN s.slot = 0 THEN es[1].loser_elo ELSE es[s.slot].winner_elo END AS elo FROM {chains}, (SELECT range AS slot FROM range({LENGTH})) s""")


# The builder runs at full size; what reads chains is checked on a smaller pool, built in the same way.
POOL_CHAINS = 5_000
FIRST_POOL_ATTEMPTS = 9_000
OPEN_CHAINS = 2_000
chain_tables("full_chains", G.MAX_OUT_EDGES, G.MAX_GAMES_PER_PLAYER, MAX_CHAINS, ATTEMPTS, FIRST_ATTEMPTS)
chain_tables("chains", G.MAX_OUT_EDGES, G.MAX_GAMES_PER_PLAYER, POOL_CHAINS, 20 * POOL_CHAINS, FIRST_POOL_ATTEMPTS)
slots_table("full_slots", "full_chains")
slots_table("chain_slots", "chains")
chain_tables("open_chains", None, None, OPEN_CHAINS, 20 * OPEN_CHAINS, 4_000)
table("first_use", "chain_slots", "SELECT game_id, ROW_NUMBER() OVER (ORDER BY a, s) - 1 AS idx FROM (SELECT game_id, arg_min(attempt, (attempt, slot)) AS a, arg_min(slot, (attempt, slot)) AS s FROM chain_slots GROUP BY 1)")


def all_chains(spark, sf, max_chains=POOL_CHAINS):
    return G.sample_chains(G.chain_index(fx.games(spark, sf)), LENGTH, 20 * max_chains, max_chains)


def chain_slots(spark, sf):
    """The accepted chains as a stored table, as the builder hands them to its readers."""
    return cut_lineage(G.chain_slots(G.keep_first(all_chains(spark, sf), POOL_CHAINS)))


@query("smp_04_chain_seeds", "full_chains_starters", f"SELECT a.range AS attempt, s.winner AS start FROM range({FIRST_POOL_ATTEMPTS}) a JOIN full_chains_starters s ON s.pick = {_hash('chain', 'a.range')} % s.total + 1")
def _(spark, sf):
    return G.chain_seeds(G.chain_index(fx.games(spark, sf)), 0, FIRST_POOL_ATTEMPTS).select("attempt", "start")


@query("jn_06_win_paths", "chains_a_hop7", "SELECT attempt, array_to_string(list_reverse(players), '>') AS players FROM chains_a_hop7")
def _(spark, sf):
    index = G.chain_index(fx.games(spark, sf))
    paths = G.weak_to_strong(G.sample_paths(G.chain_seeds(index, 0, FIRST_POOL_ATTEMPTS), index, LENGTH, "chain"))
    return paths.select("attempt", F.concat_ws(">", "players").alias("players"))


@query("jn_06_win_paths_all_edges", "open_chains", "SELECT attempt, array_to_string(players, '>') AS players, array_to_string(list_transform(picked, lambda p: p.game_id || p.color[1]), ' ') AS training FROM open_chains")
def _(spark, sf):
    index = G.chain_index(fx.games(spark, sf), None, None)
    chains = G.keep_first(G.sample_chains(index, LENGTH, 20 * OPEN_CHAINS, OPEN_CHAINS), OPEN_CHAINS)
    tokens = F.transform("training", lambda t: F.concat(t["game_id"].cast("string"), F.substring(t["color"], 1, 1)))
    return chains.select("attempt", F.concat_ws(">", "players").alias("players"), F.concat_ws(" ", tokens).alias("training"))


@query("jn_07_training_games", "full_slots", "SELECT attempt, CAST(slot AS INT) AS slot, player, game_id, color FROM full_slots")
def _(spark, sf):
    return G.chain_slots(G.keep_first(all_chains(spark, sf, MAX_CHAINS), MAX_CHAINS)).drop("elo")


@query("jn_08_edge_elos", "chains", """
SELECT attempt, CAST(i AS INT) AS link, es[i + 1].game_id AS game_id, es[i + 1].loser_elo AS src_elo, es[i + 1].winner_elo AS dest_elo, es[i + 1].winner_elo - es[i + 1].loser_elo AS diff FROM chains, (SELECT range AS i FROM range(7))""")
def _(spark, sf):
    return G.chain_edges(G.keep_first(all_chains(spark, sf), POOL_CHAINS))


@query("agg_21_moments", "games", """
SELECT event, count(*) AS n, round(sum(abs(white_elo - black_elo)), 6)::DOUBLE AS sum, round(sum(pow(abs(white_elo - black_elo), 2)), 6) AS sum_sq, round(avg(abs(white_elo - black_elo)), 6) AS mean, round(stddev_samp(abs(white_elo - black_elo)), 6) AS sd FROM games GROUP BY 1""")
def _(spark, sf):
    gap = F.abs(F.col("white_elo") - F.col("black_elo")).cast("double")
    return rounded(G.moments(fx.games(spark, sf), gap, "event"))


@query("agg_22_elo_gap_histogram", "games", """
SELECT b.bin, count(g.game_id) AS n FROM (SELECT CAST(range AS BIGINT) AS bin FROM range(82)) b LEFT JOIN (
 SELECT game_id, CASE WHEN d >= 2000 THEN 81 ELSE CAST(floor(d / 2000.0 * 80) AS BIGINT) + 1 END AS bin FROM (SELECT game_id, abs(white_elo - black_elo) AS d FROM games)) g USING (bin) GROUP BY 1""")
def _(spark, sf):
    return G.fixed_histogram(fx.games(spark, sf), F.abs(F.col("white_elo") - F.col("black_elo")), 0.0, 2000.0, 80)


@query("agg_22_edge_histogram", "chains", """
, d AS (SELECT CAST(es[i + 1].winner_elo - es[i + 1].loser_elo AS BIGINT) AS d FROM chains, (SELECT range AS i FROM range(7)))
SELECT b.bin, count(d.d) AS n FROM (SELECT CAST(range AS BIGINT) AS bin FROM range(122)) b LEFT JOIN d
 ON b.bin = CASE WHEN d < -1500 THEN 0 WHEN d >= 1500 THEN 121 ELSE CAST(floor((d + 1500) / 3000.0 * 120) AS BIGINT) + 1 END GROUP BY 1""")
def _(spark, sf):
    edges = G.chain_edges(G.keep_first(all_chains(spark, sf), POOL_CHAINS))
    return G.fixed_histogram(edges, F.col("diff"), -1500.0, 1500.0, 120)


@query("agg_23_relative_elo", "chain_slots", """
SELECT CAST(slot AS INT) AS slot, round(avg(rel), 6) AS mean, round(coalesce(stddev_samp(rel), 0), 6) AS sd, count(*) AS n FROM (
 SELECT slot, elo - first_value(elo) OVER (PARTITION BY attempt ORDER BY slot) AS rel FROM chain_slots) GROUP BY 1""")
def _(spark, sf):
    return rounded(G.relative_elo(chain_slots(spark, sf)))


@query("agg_24_color_balance", "chain_slots", """
SELECT CAST(slot AS INT) AS slot, round(p, 6) AS p_white, round(sqrt(p * (1 - p) / n), 6) AS se, n FROM (SELECT slot, avg(CAST(color = 'white' AS DOUBLE)) AS p, count(*) AS n FROM chain_slots GROUP BY 1)""")
def _(spark, sf):
    return rounded(G.color_balance(chain_slots(spark, sf)))


@query("agg_25_sampling_yield", "full_chains", f"""
SELECT n AS chains, a AS attempts, round(n / a::DOUBLE, 6) AS success_rate, {MAX_CHAINS} - n AS shortfall FROM (
 SELECT count(*) AS n, CAST(CASE WHEN count(*) >= {MAX_CHAINS} THEN max(attempt) + 1 ELSE {ATTEMPTS} END AS BIGINT) AS a FROM full_chains)""")
def _(spark, sf):
    return rounded(G.sampling_yield(all_chains(spark, sf, MAX_CHAINS), ATTEMPTS, MAX_CHAINS))


table("appearances", "sides", "SELECT player, count(*) AS n FROM sides GROUP BY 1")


@query("win_15_lorenz_curve", "appearances", """
SELECT n, round(max(i) / (SELECT count(*) FROM appearances)::DOUBLE, 6) AS player_share, round(max(cum) / (SELECT sum(n) FROM appearances)::DOUBLE, 6) AS game_share FROM (
 SELECT n, ROW_NUMBER() OVER w AS i, sum(n) OVER (ORDER BY n, player ROWS UNBOUNDED PRECEDING) AS cum FROM appearances WINDOW w AS (ORDER BY n, player)) GROUP BY n""")
def _(spark, sf):
    return rounded(G.lorenz_curve(C.player_activity(C.sides(fx.games(spark, sf)))))


@query("agg_26_player_concentration", "appearances", """
, r AS (SELECT n, ROW_NUMBER() OVER (ORDER BY n, player) AS i, sum(n) OVER (ORDER BY n, player ROWS UNBOUNDED PRECEDING) AS cum, count(*) OVER () AS players, sum(n) OVER () AS games FROM appearances)
SELECT max(players) AS players, CAST(max(games) AS BIGINT) AS games, round(2 * sum(i * n) / (max(players) * max(games))::DOUBLE - (max(players) + 1) / max(players)::DOUBLE, 6) AS gini,
 round(100 - max(cum) FILTER (i = floor(players * 0.99::DOUBLE)) / max(games)::DOUBLE * 100, 6) AS share_top1, round(100 - max(cum) FILTER (i = floor(players * 0.9::DOUBLE)) / max(games)::DOUBLE * 100, 6) AS share_top10 FROM r""")
def _(spark, sf):
    return rounded(G.concentration(C.player_activity(C.sides(fx.games(spark, sf)))))


@query("win_11_chain_stride", "chain_slots", f"SELECT attempt, CAST(slot // {STRIDE} AS BIGINT) AS slot, game_id, color FROM chain_slots WHERE slot % {STRIDE} = 0")
def _(spark, sf):
    out = G.stride_chains(chain_slots(spark, sf), STRIDE)
    return out.select("attempt", F.col("slot").cast("bigint").alias("slot"), "game_id", "color")


@query("win_11_chain_lengths", "chain_slots", f"""
SELECT 'input' AS stage, n AS length, count(*) AS chains FROM (SELECT count(*) AS n FROM chain_slots GROUP BY attempt) GROUP BY 2
UNION ALL SELECT 'output', n, count(*) FROM (SELECT count(*) AS n FROM chain_slots WHERE slot % {STRIDE} = 0 GROUP BY attempt) GROUP BY 2""")
def _(spark, sf):
    slots = chain_slots(spark, sf)
    before = G.length_histogram(slots).withColumn("stage", F.lit("input"))
    return before.unionByName(G.length_histogram(G.stride_chains(slots, STRIDE)).withColumn("stage", F.lit("output")))


@query("win_12_dense_ids_first_use", "first_use", "SELECT game_id, idx FROM first_use")
def _(spark, sf):
    return G.dense_by_first_use(chain_slots(spark, sf))


@query("win_12_dense_ids_old_order", "chain_slots", "SELECT game_id, ROW_NUMBER() OVER (ORDER BY game_id) - 1 AS idx FROM (SELECT DISTINCT game_id FROM chain_slots)")
def _(spark, sf):
    return G.dense_by_old_id(chain_slots(spark, sf))


@query("snk_02_chain_lines", "chain_slots first_use", """
SELECT attempt, string_agg(idx || ':' || CASE WHEN color = 'white' THEN 'W' ELSE 'B' END, ' ' ORDER BY slot) AS value FROM chain_slots JOIN first_use USING (game_id) GROUP BY 1""")
def _(spark, sf):
    slots = chain_slots(spark, sf)
    return G.chain_lines(slots, G.dense_by_first_use(slots))


@query("src_08_parse_chain_lines", "sides", """
SELECT g.game_id AS attempt, CAST(i AS INT) AS slot, g.game_id + i AS game_id, CASE WHEN (g.game_id + i) % 2 = 0 THEN 'W' ELSE 'B' END AS color FROM games g, (SELECT range AS i FROM range(4)) WHERE g.game_id % 11 <> 0""")
def _(spark, sf):
    part = lambda i: F.concat(
        (F.col("game_id") + i).cast("string"), F.lit(":"),
        F.when((F.col("game_id") + i) % 2 == 0, "w").otherwise("B"),
    )
    bad = F.when(F.col("game_id") % 11 == 0, "x:W").otherwise(part(1))
    lines = fx.games(spark, sf).select(F.col("game_id").alias("attempt"), F.concat_ws(" ", part(0), bad, part(2), part(3)).alias("value"))
    return G.parse_chain_lines(lines)


@query("src_09_positional_pool", "games", "SELECT ROW_NUMBER() OVER (ORDER BY game_id) - 1 AS line_no, game_id FROM games")
def _(spark, sf):
    from duelgauge.operators import ordered

    used = fx.games(spark, sf).select("game_id")
    numbered = ordered.row_numbers(used, [], ["game_id"], ordered.id_levels(F.col("game_id")), "line_no")
    return numbered.select((F.col("line_no") - 1).alias("line_no"), "game_id")


@query("jn_20_late_record_lookup", "chain_slots games", "SELECT DISTINCT game_id, white, black, result FROM games WHERE game_id IN (SELECT game_id FROM chain_slots)")
def _(spark, sf):
    wanted = chain_slots(spark, sf).select("game_id").distinct()
    found = wanted.join(fx.games(spark, sf), "game_id", "left")
    return require(found, F.col("white").isNotNull(), "a chain names an unknown game").select("game_id", "white", "black", "result")
