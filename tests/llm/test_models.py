"""Quality classifier and personal data: gradients, identities, held-out accuracy, awkward documents."""

import numpy as np

from duelgauge.llm import pii as P
from duelgauge.llm import quality as Q
from tests.llm.cases import TEXTS, documents, empty


def test_linear_time_identity():
    rng = np.random.default_rng(1)
    model = Q.Machine(0.3, rng.normal(0, 1, (Q.SIZE, 1 + Q.FACTORS)))
    index, weight = np.array([3, 70_000 % Q.SIZE, 9]), np.array([0.5, -1.0, 2.0])
    pairs = sum(
        weight[a] * weight[b] * (model.table[index[a], 1:] @ model.table[index[b], 1:]) for a in range(3) for b in range(a)
    )
    want = 0.3 + weight @ model.table[index, 0] + pairs
    assert abs(model.raw(index, weight, np.array([0]))[0][0] - want) < 1e-9


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = Q.scored(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    got = got[got.held_out]
    rank = got.score.rank()
    good, bad = got.quality == 1, got.quality == 0
    area = (rank[good].mean() - (good.sum() + 1) / 2) / bad.sum()
    assert area > 0.95 and (got.score[good] >= Q.THRESHOLD).mean() > 0.98 and (got.score[bad] < Q.THRESHOLD).mean() > 0.8


def test_quality_of_awkward_documents(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(0, 1), (1, 0), (3, 1), (7, 0), (8, None), (None, 1), (999, 1), (4, 1)], "doc_id long, quality int")
    got = Q.scored(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and (r.doc_id is not None or not r.held_out) for r in got.collect())
    none = Q.scored(docs, labels.limit(0)).collect()
    assert {r.score for r in none} != set() and all(0 <= r.score <= 1 for r in none)
    assert Q.keep_good(docs, labels).columns == docs.columns and Q.scored(empty(spark), labels).count() == 0
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.collect() if r.doc_id is not None)


def test_base_spans():
    text = TEXTS[10]
    got = [(P.KINDS[k], text[a:b]) for a, k, b in P.base_spans(text)]
    assert got == [("email", "jo.x@mail.example.com"), ("phone", "+1 (415) 555-1234"), ("ip", "10.0.0.255"), ("card", "4111 1111 1111 1111")]
    assert P.base_spans("0.0.0.256 1.2.3 000255.1.1.1 a@b") == [(16, 1, 28)]


def numbers():
    rng = np.random.default_rng(2)
    x = rng.integers(1, 100, (3, P.WINDOW))
    tags = np.zeros((3, P.WINDOW), int)
    tags[0, 5], tags[0, 6:20], tags[1, 30], tags[1, 31:50] = 1, 2, 7, 8
    return x, tags


def test_gradients_of_the_character_model():
    x, tags = numbers()
    w = {k: v.astype(np.float64) for k, v in P.new_weights(1).items()}

    def loss():
        s, _ = P.emissions(w, x)
        cross = w["cross"] + P.allowed()
        ahead = s[:, 0]
        for t in range(1, P.WINDOW):
            ahead = s[:, t] + P.log_sum(ahead[:, :, None] + cross[None], 1)
        own = np.take_along_axis(s, tags[:, :, None], 2).sum((1, 2)) + cross[tags[:, :-1], tags[:, 1:]].sum(1)
        return (P.log_sum(ahead, 1) - own).mean()

    slopes = P.slopes(w, x, tags)
    for name in w:
        at = np.unravel_index(np.argmax(np.abs(slopes[name])), w[name].shape)
        w[name][at] += 1e-2
        up = loss()
        w[name][at] -= 2e-2
        down = loss()
        w[name][at] += 1e-2
        assert abs((up - down) / 2e-2 - slopes[name][at]) < 1e-2 * max(1, abs(slopes[name][at]))


def test_best_tags_are_the_best():
    rng = np.random.default_rng(3)
    scores, cross = rng.normal(0, 1, (1, 4, 3)), rng.normal(0, 1, (3, 3))
    from itertools import product

    best = max(product(range(3), repeat=4), key=lambda p: sum(scores[0, t, k] for t, k in enumerate(p)) + sum(cross[a, b] for a, b in zip(p, p[1:])))
    assert tuple(P.best_tags(scores, cross)[0]) == best


def test_windows_cover_and_join():
    text = "x" * 300 + "1" * 500 + " a@b " + "y" * 100
    cuts = P.windows(text)
    assert all(b - a <= P.WINDOW for a, b in cuts) and {i for a, b in cuts for i in range(a, b)} >= set(range(300, 805))
    tags = []
    for a, b in cuts:
        t = P.tags_of([(310, 2, 420)], a, b)
        tags.append(t)
    sure = [np.ones(P.WINDOW)] * len(cuts)
    assert P.reconciled(text, cuts, tags, sure) == [(310, 2, 420)]


def test_personal_data_end_to_end(spark):
    rows = []
    for k in range(120):
        rows.append(f"words before {k} me{k}@mail{k % 7}.example.com and after")
        rows.append(f"call +1 ({200 + k}) 555-{1000 + 7 * k} about it {k}")
        rows.append(f"host {k}.{k + 3}.1.{k + 9} went down, id {k * 977}")
    docs = documents(spark, extra=rows)
    got = P.find(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    held = 0
    for r in got.collect():
        if r.doc_id is None:
            continue
        base = P.base_spans(texts[r.doc_id] or "")
        spans = [s for s in r.spans.split(",") if s]
        assert set(P.written(base).split(",")) - {""} <= set(spans)
        assert r.base_sha256 == __import__("hashlib").sha256(P.written(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in base) for k in range(4)]
        held += len(base)
    assert held > 300 and P.find(empty(spark)).count() == 0
    weights = P.train(docs)
    sample = [t for t in rows if P.base_spans(t)]
    hits = sum(set(P.base_spans(t)) == set(f) for t, f in zip(sample, P.model_spans(weights, sample)))
    assert hits > 0.7 * len(sample)


def test_rare_spans_are_learnt(spark):
    """One text in 100 holds a span; the others hold dates and prices."""
    rows = [(f"on 2024-{1 + k % 12:02d}-{1 + k % 28:02d} item {k} cost {k % 97}.50 and was sold",) for k in range(8_000)]
    rows += [(f"please write to name{k}@mail{k % 7}.example.com about it",) for k in range(40)]
    rows += [(f"call +1 ({200 + k}) 555-{1000 + 7 * k} about it {k}",) for k in range(40)]
    docs = spark.createDataFrame(rows, "text string").repartition(5)
    texts = {r.text for r in P.sampled(docs).collect()}
    assert {t for t, in rows if P.base_spans(t)} <= texts and len(texts) == 80 + P.SAMPLE // 4
    assert {r.text for r in P.sampled(docs.repartition(2), 20).collect()} == {r.text for r in P.sampled(docs, 20).collect()}
    marks = [r.kind for r in P.to_learn(P.sampled(docs)).collect()]
    assert marks.count(-1) > 100 and marks.count(0) >= 40 and marks.count(3) >= 40
    extra = [f"call ({300 + k}) 555-{2000 + 7 * k} about it {k}" for k in range(30)]  # no country code
    found = P.model_spans(P.train(docs), extra)
    assert sum([(5, 3, 19)] == f for f in found) >= 15
    dates = P.model_spans(P.train(docs), [t for t, in rows[:200]])
    assert sum(map(bool, dates)) <= 5


def test_windows_without_spans_have_their_share(spark):
    rows = [(f"{k} me{k}@mail.example.com" + " filler words here" * 9 + f" item {k}",) for k in range(1_500)]
    marks = [r.kind for r in P.to_learn(P.sampled(spark.createDataFrame(rows, "text string"), 1_500)).collect()]
    assert marks.count(-1) == P.WINDOWS // P.BARE and len(marks) <= P.WINDOWS


def test_shares():
    assert P.shares([5, 0, 900, 900], 800) == [5, 0, 397, 398] and P.shares([1, 2, 3, 4], 800) == [1, 2, 3, 4] and P.shares([9] * 4, 20) == [5] * 4
