"""The join against brute force: near copies, hot groups, tiny sets, common passages."""

import random
from itertools import combinations

from duelgauge.llm import jaccard as J
from tests.llm.cases import documents, empty


def shingles(text):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", words) if w]
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, (_, s)), (b, (_, t)) in combinations(enumerate(sets), 2):
        common = len(s & t)
        if s and t and 100 * common >= 80 * (len(s) + len(t) - common):
            parent[root(a)] = root(b)
    groups = {}
    for k, (i, s) in enumerate(sets):
        groups.setdefault(root(k), []).append(i)
    lowest = {r: min((i for i in g if i is not None), default=None) for r, g in groups.items()}
    return sorted(((i, len(s), lowest[root(k)] if s else i) for k, (i, s) in enumerate(sets)), key=str)


def texts(seed):
    """Chains of edits, groups around a base, a passage in many documents, short texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, out = draw(30), []
    for size in (4, 6, 8, 12, 20, 40, 90, 200):
        base = draw(size)
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, size // 12))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(" ".join(copy))
            if rng.random() < 0.3:
                base = copy  # links that form a chain
    for _ in range(60):
        out.append(" ".join(draw(rng.randint(2, 8)) + passage + draw(rng.randint(2, 8))))
    return out


def joined(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return sorted(map(tuple, J.near_duplicates(df).collect()), key=str)


def test_against_brute_force(spark):
    rows = list(enumerate(texts(1)))
    assert joined(spark, rows) == brute(rows)


def test_heavy_lists_and_small_cells(spark, monkeypatch):
    rows = list(enumerate(texts(2)))
    monkeypatch.setattr(J, "CELL_ROWS", 4)
    monkeypatch.setattr(J, "PIVOTS", 2)
    monkeypatch.setattr(J, "light_limit", lambda rows: 10)  # both kinds of keys meet
    assert joined(spark, rows) == brute(rows)


def test_awkward_documents(spark):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, J.near_duplicates(docs).collect()), key=str) == brute(rows)
    kept = J.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 8 in ids and 9 not in ids and ids.count(None) == 2
    assert J.near_duplicates(empty(spark)).count() == 0


def test_links_by_size():
    assert [J.needed(s) for s in (1, 4, 5, 6, 10, 100)] == [1, 4, 4, 5, 8, 80]
