"""Time the headline queries: prints one JSON line. Each query is warmed up once on the same data."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from duelgauge import fixtures as fx  # noqa: E402
from duelgauge.operators import trials as T  # noqa: E402
from duelgauge.plans import catalog  # noqa: E402
from duelgauge.plans import evaluation_queries as E  # noqa: E402
from duelgauge.runtime import stored_tables  # noqa: E402

HEADLINE = (
    "agg_14_slice_metrics",
    "flt_02_classify",
    "smp_01_quota_and_training",
    "jn_02_context_join",
    "job_05_strength_evaluation",
    "agg_03_calibration",
    "agg_05_player_report",
    "jn_13_nearest_bucket",
    "agg_16_trial_summary",
    "agg_09_phase_report",
    "win_03_prefix_means",
    "win_05_last_known_scores",
    "win_06_progressive_blend",
    "win_07_phase_boundaries",
    "win_17_n_step_return",
    "agg_26_player_concentration",
    "job_02_build_win_chains",
    "jn_05_first_difference",
    "smp_11_prioritised_draws",
    "agg_40_filter_effect",
)
CURVE_GAMES, CURVE_TRIALS = 100, 500


def prepare_curve(spark, sf):
    """Scored entries and calibration as stored tables: the published time starts from loaded scores."""
    return E.score_tables(spark, sf)


def accuracy_curve(entries, calibration):
    """The full 1..100 games x 500 trials curve: the one workload with a published time."""
    sizes = tuple(range(1, CURVE_GAMES + 1))
    return T.accuracy_curve(T.run_trials(entries, calibration, sizes, CURVE_TRIALS, "curve"))


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("duelgauge-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    work = {name: catalog.QUERIES[name] for name in HEADLINE}
    stored = prepare_curve(spark, sf)
    work["agg_30_full_accuracy_curve"] = lambda spark, sf: accuracy_curve(*stored)
    times = {}
    for name, fn in work.items():
        with stored_tables(spark):
            run(fn(spark, sf))
            start = time.perf_counter()
            run(fn(spark, sf))
            times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    buckets = fx.game_scores(spark, sf).select(F.count_distinct("low")).first()[0]
    drawn = buckets * CURVE_TRIALS * CURVE_GAMES * (CURVE_GAMES + 1) // 2
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf.rstrip("/")),
                "curve_draws_per_sec": int(drawn / times["agg_30_full_accuracy_curve"]),
            }
        )
    )


if __name__ == "__main__":
    main()
