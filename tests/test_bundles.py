"""Logs and messages of many iterations: few files hold them, and what they say stays the same."""

import os

import pytest
from pyspark.sql import functions as F

from duelgauge.plans import catalog
from duelgauge.plans import source_queries as SQ
from duelgauge.sources import records as RD
from duelgauge.sources import tables as TB
from duelgauge.streaming import streams as ST


@pytest.fixture
def folders(monkeypatch):
    """Scratch folders by name."""
    made, make = {}, SQ.scratch_path
    monkeypatch.setattr(SQ, "scratch_path", lambda spark, name: made.setdefault(name, make(spark, name)))
    return made


def files(path):
    return [f for _, _, names in os.walk(path.removeprefix("file:")) for f in names if f.startswith("part-")]


def test_training_logs_share_files(spark, folders, tmp_path):
    events = spark.range(10_000).filter("id % 50 <> 0 OR id % 200 = 0").unionByName(spark.range(40, 45)).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("ts"), (F.col("id") % 7).cast("double").alias("value"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    got = {(r.iteration, r.metric): r.n for r in catalog.QUERIES["src_14_training_log"](spark, str(tmp_path)).collect()}
    want = {(i, m): n for i in range(200) for m, n in (("loss_policy", 23), ("SelfPlay Avg. Game Lengths", 24))}
    assert got == want | {(0, "loss_policy"): 26, (0, "SelfPlay Avg. Game Lengths"): 26}
    assert len(files(folders["training-log"])) < 20


def test_a_bundled_log_counts_its_own_iterations(spark, tmp_path):
    logs = {"a": ["[Iteration] =====1=====", "\tloss_policy: 0.5", "[Iteration] =====2=====", "\tloss_policy: 0.25"], "b": ["\tloss_policy: 0.75", "noise\tx", "[Iteration] =====9====="]}
    for name, rows in logs.items():
        (tmp_path / f"{name}.log").write_text("\n".join(rows) + "\n")
    mixed = [f"{n}{RD.NAME_END}{x}" for k in range(4) for n, rows in logs.items() for x in rows[k : k + 1]]
    (tmp_path / "bundle").write_text("\n".join(mixed) + "\n")
    rows = lambda log: sorted((r.file[-5:].removesuffix(".log")[-1], r.iteration, r.kind, r.metric or "", r.value) for r in log.collect())
    apart = rows(TB.read_training_log(spark, f"{tmp_path}/*.log"))
    assert rows(TB.read_training_log(spark, f"{tmp_path}/bundle", bundles=True)) == apart and len(apart) == 6


def messages(spark):
    head = lambda it, i, end=" #": (it, f"SelfPlay {'true' if i % 3 else 'false'} {i} {20 + i} {i % 2}.0 (;EV[weight_iter_{it if i % 5 else it + 1}]){end}")
    return spark.createDataFrame([head(it, i, " # SelfPlay" if i == 8 else " #") for it in range(60) for i in range(1, 10)] + [(7, None)], "iteration bigint, value string")


def test_bundled_messages_count_as_those_in_folders(spark, tmp_path):
    rows = messages(spark)
    rows.write.partitionBy("iteration").text(f"{tmp_path}/apart")
    RD.bundle_lines(rows, SQ.log_folder("iteration")).write.text(f"{tmp_path}/bundled")
    read = lambda kind: ST.selfplay_intake(spark, f"{tmp_path}/{kind}", f"{tmp_path}/{kind}-out", f"{tmp_path}/{kind}-check", 1000).orderBy("iteration").collect()
    bundled, apart = read("bundled"), read("apart")
    assert len(apart) == len(bundled) == 60
    assert all(tuple(a) == pytest.approx(tuple(b)) for a, b in zip(apart, bundled))


def test_selfplay_messages_share_files(spark, folders, tmp_path):
    spark.range(40_000).select(
        F.col("id").alias("o_orderkey"), (F.col("id") % 30).alias("o_custkey"), F.lit("2024-01-02").cast("timestamp").alias("o_orderdate"), F.lit("1-URGENT").alias("o_orderpriority"),
    ).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(30).select(F.col("id").alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    rows = {r.iteration: r.games for r in catalog.QUERIES["st_01_selfplay_intake"](spark, str(tmp_path)).collect()}
    keeps = lambda g: g % 29 and g % 101 and g % 103
    assert rows == {it: sum(1 for g in range(500 * it, 500 * it + 500) if keeps(g)) for it in range(80)}
    assert 2 <= len(files(folders["selfplay"])) < 20
