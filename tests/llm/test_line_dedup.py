"""Line removal against a brute-force version, and the perfect hash by itself."""

import hashlib
from collections import Counter

import numpy as np

from duelgauge.llm import line_dedup as L
from tests.llm.cases import BLANKS, documents, empty

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least):
    key = lambda line: line.strip(BLANKS).translate(LOWER)
    texts = [(i, t or "") for i, t in rows]
    counts = Counter(k for _, t in texts for k in {key(line) for line in t.split("\n")})
    out = []
    for i, t in texts:
        lines = t.split("\n")
        kept = [line for line in lines if not key(line) or counts[key(line)] < least]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_digest_agrees_with_brute_force(spark):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for least in (1, 2, 3, 10):
        got = sorted(map(tuple, L.digest(docs, least).collect()), key=str)
        assert got == brute(rows, least)


def test_many_shards_and_groups(spark, monkeypatch):
    monkeypatch.setattr(L, "SHARD_KEYS", 3)
    monkeypatch.setattr(L, "GROUP_BYTES", 200)
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, L.digest(docs, 2).collect()), key=str) == brute(rows, 2)


def test_columns_stay_and_lines_go(spark):
    docs = documents(spark)
    out = L.dedup_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    by_id = {r.doc_id: r for r in out.collect() if r.doc_id is not None}
    assert by_id[0].text is None and by_id[10_001].text.startswith("row number 1")
    assert by_id[10_001].n_chars in (None, len(by_id[10_001].text))
    assert L.dedup_lines(empty(spark)).count() == 0 and L.digest(empty(spark)).count() == 0


def test_perfect_hash_is_minimal_and_rejects_strangers():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 5000):
        hi, lo = rng.integers(0, 2**63, (2, n)).astype(np.uint64)
        docs = np.arange(2, n + 2)
        index = L.LineIndex(L.build_index(hi, lo, docs))
        assert len(index.counts) == n and sorted(index.counts.tolist()) == docs.tolist()
        assert index.documents(hi, lo).tolist() == docs.tolist()
        assert not index.documents(hi + np.uint64(1), lo + np.uint64(1)).any()
