"""Shared SQL table expressions (DuckDB text) that mirror duelgauge.fixtures."""

from duelgauge.plans.registry import table

table("games0", "", """
 SELECT o_orderkey AS game_id, CAST(o_orderdate AS DATE) AS played_at, o_custkey AS w,
        (o_custkey + 1 + (o_orderkey % 97)) % (SELECT count(*) FROM customer) AS b,
        CASE WHEN o_orderpriority = '5-LOW' THEN 'Rapid' ELSE 'Blitz' END AS event FROM orders""")
table("games1", "games0", """
 SELECT *, 950 + (w * 37) % 1700 + game_id % 41 AS we, 950 + (b * 37) % 1700 + game_id % 43 AS be FROM games0""")
table("games", "games1", """
 SELECT game_id, played_at, event, 'p' || w AS white, 'p' || b AS black,
        CAST(CASE WHEN game_id % 211 = 0 THEN 0 ELSE we END AS BIGINT) AS white_elo, CAST(be AS BIGINT) AS black_elo,
        CAST(CASE WHEN game_id % 20 = 0 THEN 0 WHEN we - be + (game_id * 7919) % 1201 - 600 > 0 THEN 1 ELSE -1 END AS BIGINT) AS result,
        CAST(14 + game_id % 60 AS BIGINT) AS plies, CASE WHEN game_id % 53 = 0 THEN 'custom' END AS fen FROM games1""")
table("binned", "games", """
 SELECT *, CASE WHEN white_elo >= 1000 AND white_elo < 2600 THEN CAST(floor((white_elo - 1000) / 200.0) AS BIGINT) END AS wbin,
        CASE WHEN black_elo >= 1000 AND black_elo < 2600 THEN CAST(floor((black_elo - 1000) / 200.0) AS BIGINT) END AS bbin FROM games""")
table("sides", "games", """
 SELECT game_id, played_at, event, 'white' AS color, white AS player, black AS opponent, white_elo AS elo, black_elo AS opponent_elo, result AS outcome FROM games
 UNION ALL
 SELECT game_id, played_at, event, 'black', black, white, black_elo, white_elo, -result FROM games""")
table("moves0", "", """
 SELECT user_id AS game_id, event_id, event_type, value,
        ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ply FROM events""")
table("moves", "moves0", """
 SELECT *, CASE WHEN ply % 2 = 0 THEN 'white' ELSE 'black' END AS color,
        substr('abcdefgh', CAST(1 + event_id % 8 AS BIGINT), 1) || CAST(1 + ply % 8 AS VARCHAR)
        || substr('abcdefgh', CAST(1 + (event_id + ply) % 8 AS BIGINT), 1) || CAST(1 + (ply * 3) % 8 AS VARCHAR) AS move,
        CAST(greatest(600 - ply * 5, 0) AS BIGINT) AS clock_s FROM moves0""")
table("move_scores", "moves", """
 SELECT game_id, ply, color, CASE WHEN ply < 20 THEN 'opening' WHEN ply < 45 THEN 'midgame' ELSE 'endgame' END AS phase,
        event_type || '/' || CAST(ply % 8 AS VARCHAR) AS fen_before, move,
        CAST((game_id * 37) % 1600 - 800 AS DOUBLE) / 500 + (value - 100) / CAST(503 AS DOUBLE) AS score FROM moves""")
table("scored_games", "games", """
 SELECT g.*, e.n_moves FROM games g JOIN (SELECT user_id AS game_id, count(*) AS n_moves FROM events GROUP BY 1) e USING (game_id)""")
table("game_scores", "binned", """
 SELECT game_id, 1000 + 200 * wbin AS low, 1200 + 200 * wbin AS high, white_elo AS white_rating, black_elo AS black_rating,
        CAST(0.002 AS DOUBLE) * (white_elo - 1500) + CAST((game_id * 7919 + CAST(substr(white, 2) AS BIGINT) * 31) % 1001 - 500 AS DOUBLE) / 2503 AS white_score,
        20 + game_id % 30 AS white_moves,
        CAST(0.002 AS DOUBLE) * (black_elo - 1500) + CAST((game_id * 7919 + CAST(substr(black, 2) AS BIGINT) * 37) % 1001 - 500 AS DOUBLE) / 2503 AS black_score,
        20 + game_id % 30 - game_id % 2 AS black_moves
 FROM binned WHERE wbin = bbin""")
table("split_scores", "game_scores", """
 SELECT *, CASE WHEN ROW_NUMBER() OVER (PARTITION BY low ORDER BY md5('cand:' || game_id), game_id) <= 20 THEN 'cand' ELSE 'query' END AS split FROM game_scores""")
table("cand", "split_scores", "SELECT * FROM split_scores WHERE split = 'cand'")
table("queries", "split_scores", "SELECT * FROM split_scores WHERE split = 'query'")
table("calibration", "cand", """
 SELECT low, high, CAST((low + high) / 2.0 AS DOUBLE) AS center, count(*) AS games, CAST(sum(white_moves + black_moves) AS BIGINT) AS moves,
        sum(white_score * white_moves + black_score * black_moves) / sum(white_moves + black_moves) AS mean_score FROM cand GROUP BY low, high""")
table("line", "calibration", "SELECT regr_slope(mean_score, center) AS slope, regr_intercept(mean_score, center) AS intercept FROM calibration")
