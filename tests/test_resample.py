"""Resampled sums by split counts: against a replay in plain Python, and against drawn rows."""

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from duelgauge.operators import ordered
from duelgauge.operators import resample as RS
from duelgauge.operators import trials as T


def replay_draws(text, count):
    out = []
    for k in range(count):
        digest = hashlib.md5(f"{text}:{k // RS.COUNTED}".encode()).hexdigest()
        (p1, p2), (g1, g2) = ordered.MODULI, ordered.MULTIPLIERS
        s1, s2 = int(digest[:15], 16) % (p1 - 1) + 1, int(digest[15:30], 16) % (p2 - 1) + 1
        power = k % RS.COUNTED + 1
        out.append(s1 * pow(g1, power, p1) % p1 * p2 + s2 * pow(g2, power, p2) % p2)
    return out


def replay_binomial(text, count, part, whole):
    if count <= RS.COUNTED:
        return sum(v % whole < part for v in replay_draws(text, count))
    digest = hashlib.md5(text.encode()).hexdigest()
    u, v = (int(digest[a : a + 15], 16) % (p - 1) + 1 for a, p in zip((0, 15), ordered.MODULI))
    z = math.sqrt(-2 * math.log(u / ordered.MODULI[0])) * math.cos(2 * math.pi * v / ordered.MODULI[1])
    share = part / whole
    return min(count, max(0, math.floor(count * share + z * math.sqrt(count * share * (1 - share)) + 0.5)))


def replay(rows, group, replicates, seed, leaf):
    """rows: [(id, value)] of one group; counts are split recursively, each half of the hash space at a time."""
    hashed = sorted((hashlib.md5(f"tree:{i}".encode()).hexdigest(), i, v) for i, v in rows)
    over = (len(rows) - 1) // leaf
    depth = over.bit_length()
    sums = []
    for r in range(replicates):
        def visit(part, level, node, count):
            if not part:
                assert count == 0
                return 0.0
            if level == depth:
                return sum(part[d % len(part)][2] or 0.0 for d in replay_draws(f"{seed}:leaf:{group}:{node}:{r}", count))
            bit = lambda row: int(row[0][:15], 16) >> (RS.HASH_BITS - 1 - level) & 1
            left = [x for x in part if not bit(x)]
            fallen = replay_binomial(f"{seed}:{group}:{level}:{node}:{r}", count, len(left), len(part))
            return visit(left, level + 1, node * 2, fallen) + visit([x for x in part if bit(x)], level + 1, node * 2 + 1, count - fallen)

        sums.append(visit(hashed, 0, 0, len(rows)))
    return sums


def test_sums_equal_a_replay(spark):
    sizes = {"hot": 900, "b": 65, "c": 64, "d": 1}
    rows = [(g, i, None if i % 11 == 0 else float(i % 17)) for g, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "g string, id bigint, v double").withColumn("replicate", F.lit("other"))
    for leaf in (64, 8):
        got = RS.bootstrap_sums(df, "g", ["id"], ["v"], 3, "s", leaf).toPandas()
        assert len(got) == 3 * len(sizes)
        for g in sizes:
            mine = got[got["g"] == g].sort_values("replicate")["v"].tolist()
            assert np.allclose(mine, replay([(i, v) for h, i, v in rows if h == g], g, 3, "s", leaf)), (leaf, g)


def test_every_replicate_draws_as_many_rows_as_the_group_has(spark):
    df = spark.createDataFrame([("a", i, 1.0) for i in range(500)] + [("b", i, 1.0) for i in range(3)] + [(None, 1, 1.0)], "g string, id bigint, one double")
    got = RS.bootstrap_sums(df, "g", ["id"], ["one"], 20, "n").groupBy("g").agg(F.min("one").alias("lo"), F.max("one").alias("hi"), F.count("*").alias("k"))
    assert {tuple(r) for r in got.collect()} == {("a", 500.0, 500.0, 20), ("b", 3.0, 3.0, 20)}
    assert RS.bootstrap_sums(df.limit(0), "g", ["id"], ["one"], 2, "n").count() == 0
    same = RS.bootstrap_sums(df.filter("id < 1").union(df.filter("id < 1")), "g", ["id"], ["one"], 2, "n")
    assert {r["one"] for r in same.collect()} == {2.0}


def test_deviation_is_that_of_drawn_rows(spark):
    n, replicates = 2000, 400
    frame = pd.DataFrame({"g": 1, "id": np.arange(n), "v": np.random.default_rng(3).exponential(10, n)})
    df = spark.createDataFrame(frame)
    split = RS.bootstrap_sums(df, "g", ["id"], ["v"], replicates, "x").toPandas()["v"]
    drawn = T.bootstrap_draws(df, "g", ["id"], replicates, "x").groupBy("replicate").agg(F.sum("v").alias("v")).toPandas()["v"]
    true = frame["v"].std(ddof=0) * math.sqrt(n)
    for sums in (split, drawn):
        assert abs(sums.std() / true - 1) < 4 / math.sqrt(2 * replicates)
        assert abs(sums.mean() - frame["v"].sum()) < 4 * true / math.sqrt(replicates)


def test_nothing_as_long_as_the_draws_is_shuffled(spark):
    df = spark.range(3000).select(F.lit(1).alias("g"), "id", F.lit(1.0).alias("v"))
    plan = RS.bootstrap_sums(df, "g", ["id"], ["v"], 50, "p")._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    above = plan[: plan.index("Join")] if joins else plan
    assert above.count("Generate") == 1 and "Generate" not in plan[plan.index("Generate") + 8 : plan.index("Join")]
