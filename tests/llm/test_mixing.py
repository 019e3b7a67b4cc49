"""Mixing against a step-by-step version of the targets, and the rules of the sample."""

import re

import pytest

from duelgauge.llm import mixing as M
from tests.llm.cases import documents, empty


def targets(sizes):
    """Share by weight; what is above three times a source's size is shared again among the others."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    out, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        full = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not full:
            return out | share
        for s in full:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
            open_.discard(s)
    return out


def words(text):
    return len([w for w in re.split("[\x20\x09-\x0d]+", text or "") if w])


def check(rows, docs):
    sizes = {}
    for r in docs.collect():
        sizes[r.source] = sizes.get(r.source, 0) + words(r.text)
    want, taken, largest = targets(sizes), {}, {}
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], abs=1e-6)
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[r.source] = taken.get(r.source, 0) + r.taken
        largest[r.source] = max(largest.get(r.source, 0), r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 3 * largest[s] / 2 + 1


def test_awkward_documents(spark):
    docs = documents(spark)
    rows = M.report(docs).collect()
    assert len(rows) == docs.count()
    check(rows, docs)
    again = M.report(docs.repartition(7)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert M.report(empty(spark)).count() == 0 and M.mix(empty(spark)).count() == 0


def test_one_source_holds_most(spark):
    rows = [(i, "w " * (1 + i * 37 % 90), "big" if i % 3 else f"s{i % 5}") for i in range(1500)]
    rows += [(9000, "w " * 20_000, "huge"), (9001, "", "nothing")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = M.report(docs).collect()
    check(got, docs)
    taken = {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.taken
    target = {r.source: r.target for r in got}
    assert all(abs(taken[s] - target[s]) <= 0.03 * target[s] + 60 for s in target if s != "huge")


def test_mix_repeats_rows_as_the_report_says(spark):
    docs = documents(spark)
    out = M.mix(docs)
    assert out.columns == docs.columns
    total = {}
    for r in out.collect():
        total[r.source] = total.get(r.source, 0) + words(r.text)
    want = {}
    for r in M.report(docs).collect():
        want[r.source] = want.get(r.source, 0) + r.taken
    assert {k: v for k, v in total.items() if v} == {k: v for k, v in want.items() if v}
