"""Published numbers that can be recomputed without a model."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from duelgauge.operators import calibration as K
from duelgauge.operators import progressive as G

# Mean scores of sixteen 100-point buckets from 1000 on.
MEANS = (
    -1.5927252008024235, -1.595367146628367, -1.3501985680078408, -1.063674176602494,
    -0.9623291731970544, -0.6921443195963761, -0.5291957237657623, -0.38046493829163347,
    -0.1770163851590163, 0.06994926604758167, 0.3313892672982022, 0.6679429527039323,
    0.8464855845929078, 0.9669453593917461, 1.1397324472512513, 1.175540074010614,
)

# Observed plies, prefix means and single-move scores of the first plies of one game.
PREFIXES = (
    (2, 0.05228227749466896, 0.03152209520339966, 0.05228227749466896, 0.03152209520339966),
    (3, 0.32194450683891773, 0.03152209520339966, 0.5916067361831665, 0.03152209520339966),
    (4, 0.3219453990459442, 0.3048362322151661, 0.5916067361831665, 0.5781503692269325),
    (5, 0.43183426310618717, 0.3048681151121855, 0.6516119912266731, 0.5781503692269325),
    (6, 0.43187959492206573, 0.3183894616862138, 0.6516119912266731, 0.3454321548342705),
    (7, 0.3782980293035507, 0.3183894616862138, 0.21755333244800568, 0.3454321548342705),
    (8, 0.3782980293035507, 0.3680537538602948, 0.21755333244800568, 0.5170466303825378),
)


@pytest.fixture(scope="module")
def calibration(spark):
    rows = [(1000 + 100 * i, 1100 + 100 * i, 1050.0 + 100 * i, m) for i, m in enumerate(MEANS)]
    return spark.createDataFrame(rows, "low int, high int, center double, mean_score double")


def test_line_quality_matches_the_report(calibration):
    row = K.line_quality(calibration).first()
    assert row.score_per_100_elo == pytest.approx(0.20336875181343697, abs=1e-12)
    assert row.max_abs_bucket_residual_elo == pytest.approx(75.30896250152136, abs=1e-9)
    assert row.rms_bucket_residual_elo == pytest.approx(40.90106501124223, abs=1e-9)


def test_one_order_violation(calibration):
    assert [(r.low, r.next_low) for r in K.order_violations(calibration).collect()] == [(1000, 1100)]


def test_single_move_scores_follow_from_prefix_means(spark):
    """Every published prefix carries its own mean, so n·mean(n) − (n−1)·mean(n−1) must return the score."""
    frame = pd.DataFrame(PREFIXES, columns=["plies", "wm", "bm", "ws", "bs"])
    rows = []
    for side, first in (("w", 1), ("b", 0)):
        moved = frame[frame["plies"] % 2 == first]
        if side == "w":
            moved = pd.concat([frame.head(1), moved])
        for n, (_, r) in enumerate(moved.iterrows(), start=1):
            before = frame[frame["plies"] == r["plies"] - 1]
            rows.append((side, n, float(r[f"{side}m"]), float(r[f"{side}s"]), None if before.empty else float(before[f"{side}m"].iloc[0])))
    prefixes = spark.createDataFrame(
        [(1, s, n, m, score) for s, n, m, score, _ in rows], "game_id int, color string, n bigint, prefix_mean double, score double"
    )
    got = G.instantaneous(prefixes)
    worst = got.agg(F.max(F.abs(F.col("instantaneous") - F.col("score")))).first()[0]
    assert worst < 1e-3
