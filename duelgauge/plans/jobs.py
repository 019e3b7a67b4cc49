"""Composed jobs: the public entry points, each a chain of operators over DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelgauge.functions import board as B
from duelgauge.functions import rating as R
from duelgauge.functions import targets as V
from duelgauge.operators import boundaries as D
from duelgauge.operators import calibration as K
from duelgauge.operators import compare as M
from duelgauge.operators import context as X
from duelgauge.operators import corpus as C
from duelgauge.operators import graph as G
from duelgauge.operators import native_eval as N
from duelgauge.operators import ordered
from duelgauge.operators import phases as PH
from duelgauge.operators import predict as P
from duelgauge.operators import progressive as PR
from duelgauge.operators import replay as RB
from duelgauge.operators import selfplay as S
from duelgauge.operators import training as TR
from duelgauge.operators import trials as T
from duelgauge.runtime import cut_lineage
from duelgauge.sources import records as RD

Model = Callable[[DataFrame], DataFrame]


def prepare_corpus(
    games: DataFrame, bins: C.Bins, quota: dict[str, int | None], held_out: DataFrame | None = None, seed: str = "corpus"
) -> dict[str, DataFrame]:
    """Classify, drop held-out games, sample disjoint splits per bin, and report every exclusion.

    A quota of None, for the last split, keeps all that is left; `left_out` counts what finite quotas leave.
    With `held_out`, games carry a `digest` column. Write `splits` with sinks.write_partitioned.
    """
    flagged = games if held_out is None else C.flag_held_out(games, held_out)
    tagged = C.classify(flagged, bins, None if held_out is None else F.col("held_out"))
    kept = tagged.filter("reason IS NULL")
    return {
        "splits": C.rank_bands(kept, ["bin"], ["game_id"], seed, quota),
        "left_out": C.left_out(kept, ["bin"], quota),
        "exclusions": C.reason_counts(tagged),
        "bins": C.bin_counts(tagged, bins, next(iter(quota.values()))),
    }


def build_win_chains(
    games: DataFrame,
    length: int = 8,
    max_chains: int = 50_000,
    attempts: int | None = None,
    edge_cap: int | None = G.MAX_OUT_EDGES,
    game_cap: int | None = G.MAX_GAMES_PER_PLAYER,
    seed: str = "chain",
) -> dict[str, DataFrame]:
    """Chains of distinct players, each beaten by the next, with a training game per slot, and all reports about them.

    attempts: 20 per chain unless given. Caps bound how many wins and games of a player take part (None: all).
    The index and the chains are stored once; every result reads them.
    """
    attempts = max(20 * max_chains, 1_000) if attempts is None else attempts
    index = G.chain_index(games, edge_cap, game_cap, seed)
    found = G.sample_chains(index, length, attempts, max_chains, seed)
    kept = cut_lineage(G.keep_first(found, max_chains))
    slots = cut_lineage(G.chain_slots(kept))
    edges = G.chain_edges(kept)
    ids = cut_lineage(G.dense_by_first_use(slots))
    gap = F.abs(F.col("white_elo") - F.col("black_elo"))
    return {
        "slots": slots,
        "edges": edges,
        "pool": ids.join(games, "game_id"),
        "lines": G.chain_lines(slots, ids),
        "yield": G.sampling_yield(found, attempts, max_chains),
        "relative_elo": G.relative_elo(slots),
        "color_balance": G.color_balance(slots),
        "slot_elo": G.moments(slots, F.col("elo").cast("double"), "slot"),
        "edge_elo": G.moments(edges, F.col("diff").cast("double"), "link"),
        "edge_histogram": G.fixed_histogram(edges, F.col("diff"), -1500.0, 1500.0, 120),
        "gap_histogram": G.fixed_histogram(games, gap, 0.0, 2000.0, 80),
        "appearances": slots.groupBy("player").agg(F.count(F.lit(1)).alias("n")),
    }


def stride_chains(lines: DataFrame, games: DataFrame, stride: int) -> dict[str, DataFrame]:
    """Thin text chains to every stride-th slot and renumber the games they still use."""
    slots = G.parse_chain_lines(lines)
    kept = G.stride_chains(slots, stride)
    ids = G.dense_by_old_id(kept)
    recolored = kept.withColumn("color", F.when(F.col("color") == "W", "white").otherwise("black"))
    return {
        "lines": G.chain_lines(recolored, ids),
        "ids": ids,
        "missing": G.missing_games(kept, games),
        "input_lengths": G.length_histogram(slots),
        "output_lengths": G.length_histogram(kept),
    }


def build_examples(games: DataFrame, policy: C.ContextPolicy, strict_cap: bool = False) -> dict[str, DataFrame]:
    made = X.build_examples(games, policy, strict_cap)
    return {"examples": made.filter("reason IS NULL"), "exclusions": X.exclusion_counts(made)}


def rating_model(draw_rate: float = R.DRAW_RATE) -> Model:
    """Predicts from the two recorded ratings."""
    return lambda examples: P.with_prediction(
        examples.select("game_id", "white_elo", "black_elo"), R.rating_baseline(F.col("white_elo"), F.col("black_elo"), draw_rate)
    ).select("game_id", *P.PROBABILITIES, "predicted")


def strength_model(side_scores: DataFrame, how: str = "mean", line: tuple[float, float] = R.DEFAULT_LINE) -> Model:
    """Predicts from the players' mean scores in their context games."""
    return lambda examples: P.strength_predictions(X.context_strength(examples, side_scores, how), line=line).select(
        "game_id", *P.PROBABILITIES, "predicted"
    )


def evaluate(examples: DataFrame, model: Model, slices: dict | None = None, minimum: int = 20) -> dict[str, DataFrame]:
    """Any model that maps examples to one prediction each; mismatched ids fail the job."""
    scored = P.strict_join(examples, model(examples))
    return {"predictions": scored, "metrics": P.metrics(scored), "slices": P.slice_metrics(scored, minimum, slices)}


def evaluate_progressive(examples: DataFrame, move_scores: DataFrame) -> dict[str, DataFrame]:
    rows = PR.trajectories(examples, move_scores)
    export = PR.export_rows(rows)
    return {"trajectories": rows, "by_ply": PR.metrics_by_ply(rows), "export": export, "estimates": PR.estimates_long(export)}


def player_report(rows: DataFrame, calibration: DataFrame) -> DataFrame:
    """Rating estimate per player; a player whose games were all skipped keeps a row without estimate."""
    return K.with_estimate(K.player_report(rows), calibration)


def evaluate_bins(
    candidates: DataFrame, queries: DataFrame, per_trial: Sequence[int], trials: int, seed: str
) -> dict[str, DataFrame]:
    """Calibrate on candidates, then test how well groups of query games find their bucket.

    The scored entries, the calibration and the trial results are stored once; all reports read them.
    Candidates and queries must have the same buckets.
    """
    alone = K.same_buckets(candidates, queries).limit(1).collect()
    if alone:
        raise ValueError(f"bucket {alone[0]['low']} is in one of candidates and queries only")
    calibration = cut_lineage(K.bucket_means(candidates))
    entries = cut_lineage(K.side_scores(queries))
    results = cut_lineage(T.run_trials(entries, calibration, per_trial, trials, seed))
    return {
        "calibration": calibration,
        "line_quality": K.line_quality(calibration),
        "violations": K.order_violations(calibration),
        "overall": T.overall_summary(results),
        "by_bucket": T.bucket_summary(results),
        "pairwise": T.pairwise_ordering(results),
    }


def evaluate_phase_bins(
    bucket_totals: DataFrame,
    calibration: DataFrame,
    replicates: int,
    seed: str,
    candidates: DataFrame | None = None,
    per_trial: Sequence[int] = (),
    trials: int = 0,
    trial_seed: str = "phase",
) -> dict[str, DataFrame]:
    """Gaps between the phases of a bucket with their errors; with `candidates` (totals like bucket_totals), also a
    calibration per phase and how well groups of games find their bucket from one phase alone."""
    lines = PH.same_line_for_all(K.fit_line(calibration))
    gaps = PH.phase_gaps(bucket_totals, lines).join(PH.gap_errors(bucket_totals, lines, replicates, seed), ["low", "phase"])
    made = {"gaps": gaps, "summary": PH.phase_summary(gaps), "pivot": PH.phase_pivot(gaps, "gap_vs_phase_average")}
    if candidates is None:
        return made
    calibrations = cut_lineage(PH.phase_calibrations(candidates))
    accuracy = PH.phase_accuracy(PH.phase_entries(bucket_totals), calibrations, per_trial, trials, trial_seed)
    return made | {"calibrations": calibrations, "accuracy": accuracy}


def rank_phase_gap(totals: DataFrame, calibration: DataFrame, reference: DataFrame) -> DataFrame:
    return PH.phase_gap_ranking(PH.phase_report(totals, calibration, reference))


ELO_SLICE = 25.0


def move_analysis(move_scores: DataFrame, calibration: DataFrame) -> dict[str, DataFrame]:
    """Position map, phase table, and the middle and 1-99 % range of single-move ratings per phase."""
    rated = K.with_estimate(move_scores.select("phase", "score"), calibration, "score").select("phase", "estimated_elo")
    return {
        "positions": PH.position_map(move_scores),
        "phases": PH.phase_table(move_scores),
        "distribution": ordered.quantiles(rated, ["phase"], "estimated_elo", {"p01": 0.01, "p50": 0.5, "p99": 0.99}, ELO_SLICE),
    }


def corpus_overlap(corpus: DataFrame, owned: DataFrame) -> DataFrame:
    return M.overlap_by_owner(corpus, owned)


def match_subset(original: DataFrame, legacy: DataFrame) -> dict[str, DataFrame]:
    return {"matched": M.bag_match(original, legacy), "summary": M.bag_summary(original, legacy)}


def compare_conversions(old: DataFrame, new: DataFrame, top: int = 15) -> dict[str, DataFrame]:
    first = M.first_differences(old, new)
    return {
        "totals": M.difference_totals(first),
        "top": M.difference_histogram(first).orderBy(F.desc("n"), "old", "new").limit(top),
        "first": first,
    }


def compare_cohorts(rated: DataFrame, kind: str, left: str, right: str) -> dict[str, DataFrame]:
    """Errors of two kinds of games of the same players, each against the recorded rating."""
    deltas = M.paired_deltas(rated, "player", kind, left, right)
    report = lambda value: M.error_report(rated.filter(F.col(kind) == value), "estimated_elo", "rating").withColumn(kind, F.lit(value))
    return {"deltas": deltas, "summary": M.delta_summary(deltas), "errors": report(left).unionByName(report(right))}


def native_evaluation(
    candidates: DataFrame, queries: DataFrame, frame: str, per_trial: Sequence[int], trials: int, seed: str, mode: str = "+/-0"
) -> dict[str, DataFrame]:
    """Rank games from the moves of a frame: candidates with both sides, queries with one drawn side.

    Inputs are ranked move scores (rank, game_id, ply, color, score).
    """
    strength = N.rank_strength(N.select_frame(candidates, frame))
    calibration = strength.select(
        F.col("rank").alias("low"), F.col("rank").alias("high"), F.col("rank").cast("double").alias("center"), "mean_score"
    )
    side = lambda c, v: F.when(F.col("color") == c, v)
    games = (
        N.select_frame(queries, frame)
        .groupBy("rank", "game_id")
        .agg(
            *[F.coalesce(F.avg(side(c, F.col("score"))), F.lit(0.0)).alias(f"{c}_score") for c in K.COLORS],
            *[F.count(side(c, F.lit(1))).alias(f"{c}_moves") for c in K.COLORS],
        )
        .select(F.col("rank").alias("low"), "*", *[F.col("rank").alias(f"{c}_rating") for c in K.COLORS])
        .drop("rank")
    )
    results = T.two_stage_trials(games, calibration, per_trial, trials, seed)
    return {"strength": strength, "curve": T.accuracy_curve(results, mode), "by_ply": N.strength_by_ply(queries.withColumn("weight", F.lit(1.0)))}


def native_class_evaluation(
    positions: DataFrame, mode: str, tolerance: str, per_trial: Sequence[int], trials: int, seed: str
) -> DataFrame:
    """Accuracy per rank and number of games where the class is voted by (or summed over) the positions of drawn games.

    positions: rank, game_id, ply, classes.
    """
    games = positions.select("rank", "game_id").distinct()
    return N.class_accuracy(N.class_trials(games, positions, mode, per_trial, trials, seed), tolerance)


def move_prediction(policies: DataFrame) -> DataFrame:
    """Share of moves among the k likeliest of the policy, per rank and over all. policies: rank, policy, played."""
    ordered_moves = policies.select(F.col("rank").cast("string").alias("rank"), N.played_order(F.col("policy"), F.col("played")).alias("played_order"))
    return N.agreement_curve(ordered_moves)


def assemble_training_batches(
    spark: SparkSession,
    kind: str,
    source: DataFrame,
    positions: DataFrame,
    count: int,
    k: int,
    p: int,
    seed: str,
    same_game: bool = True,
    statistics: DataFrame | None = None,
) -> DataFrame:
    """Batches from ranks (games), chains (slots) or phases (examples).

    same_game: whether the p positions of a rank come from one game. With `statistics` (boundaries.loader_statistics),
    a bin without a usable phase example fails the job before anything is drawn.
    """
    if kind == "rank":
        return TR.ranking_groups(spark, source, positions, count, k, p, seed, same_game)
    if kind == "chain":
        return TR.chain_batch(spark, source, positions, count, p, seed)
    if kind == "phase":
        if statistics is not None:
            D.require_examples(statistics).count()
        return TR.phase_batch(spark, source, positions, count, k, p, seed)
    raise ValueError(f"unknown batch kind {kind}")


def training_targets(rows: DataFrame, n: int, discount: float, size: int, life_loss: bool = False) -> DataFrame:
    """n-step target, its rescaled two-hot form, and the replay priority of every position."""
    returns = RB.n_step_returns(rows, n, discount, life_loss)
    rescaled = V.rescale(F.col("n_step"))
    return returns.select(
        "*", rescaled.alias("target"), V.two_hot(rescaled, size).alias("target_vector"),
        V.priority(F.col("n_step"), F.col("value"), 1e-6).alias("priority"),
    )


def training_sets(
    rows: DataFrame, games: DataFrame, n: int, discount: float, size: int, k: int, actions: int, rank_size: int, seed: str
) -> dict[str, DataFrame]:
    """All training inputs of a replay table: value targets, k-step unrolled targets, and policy, result and rank targets."""
    return {
        "values": training_targets(rows, n, discount, size),
        "unrolled": RB.unrolled_targets(rows, k, actions, seed),
        "positions": TR.position_targets(rows, games, actions, rank_size),
    }


def augmented_policies(rows: DataFrame, size: int) -> DataFrame:
    """Every row under the eight symmetries of its board; `policy` has one entry per point, and one for a pass if longer."""
    turned = rows.withColumn("symmetry", F.explode(F.sequence(F.lit(0), F.lit(7))))
    moved = F.transform("policy", lambda p, i: F.struct(B.symmetric_index(i, F.col("symmetry"), size).alias("at"), p.alias("p")))
    return turned.withColumn("policy", F.transform(F.array_sort(moved), lambda m: m["p"]))


def sample_replay(targets: DataFrame, count: int, alpha: float, beta: float, seed: str) -> DataFrame:
    drawn = RB.weighted_draws(RB.prioritised(targets, alpha).select("game_id", "ply", "weight"), count, seed, beta)
    return drawn.join(targets, ["game_id", "ply"])


def selfplay_stats(records: DataFrame) -> DataFrame:
    return S.iteration_stats(S.current_model_only(records))


def match_elo(rows: DataFrame) -> DataFrame:
    return S.elo_ladder(S.match_summary(rows))


def training_curves(log: DataFrame) -> dict[str, DataFrame]:
    """Mean of every logged metric and the durations, per file and iteration."""
    metrics = log.filter("kind = 'metric'").groupBy("file", "iteration", "metric").agg(F.avg("value").alias("value"))
    return {"metrics": metrics, "durations": S.iteration_durations(log)}


def pgn_corpus(spark: SparkSession, path: str | list[str]) -> dict[str, DataFrame]:
    """Convertible blitz games of PGN files, with player activity and the rating distribution."""
    rows = RD.pgn_corpus(RD.read_pgn(spark, path))
    kept = rows.filter("reason IS NULL")
    numbered = kept.withColumn("game_id", F.concat_ws(":", "file", F.col("line_no").cast("string")))
    player_sides = C.sides(numbered)
    return {
        "games": kept,
        "reasons": rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n")),
        "activity": C.player_activity(player_sides),
        "distribution": C.rating_distribution(player_sides),
    }
