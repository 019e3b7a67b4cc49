"""Passage removal against a dictionary of all windows."""

import hashlib
import random
import re

import pytest

from duelgauge.llm import substrings as S
from tests.llm.cases import SCHEMA, documents, empty

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, window=20):
    """rows: (doc_id, text) in document order. [(doc_id, words, removed, hash)]"""
    first, out = set(), []
    for doc, text in rows:
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            if key in first:
                gone[s : s + window] = [True] * window
            first.add(key)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((doc, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def order(row):
    return row[0] is None, row[0] or 0


def frame(spark, rows, parts=3):
    full = [(i, t, "en", "s", len(t or ""), *["c"] * 10) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


def result(found):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found.collect()), key=lambda r: (order(r), r))


def corpus(seed, docs, vocabulary):
    """Few different words, so that windows agree in part; passages shared at other places and with other ends."""
    pick = random.Random(seed)

    def draw(n):
        return [f"w{pick.randrange(vocabulary)}" for _ in range(n)]

    passages = [draw(pick.randint(15, 90)) for _ in range(8)]
    rows = []
    for k in range(docs):
        words = draw(pick.randint(0, 60))
        for _ in range(pick.randint(0, 4)):
            p = passages[min(pick.randrange(8), pick.randrange(8))]
            a, b = sorted((pick.randrange(len(p)), pick.randint(1, len(p))))
            words += p[a:b] if pick.random() < 0.5 else p
            words += draw(pick.choice([0, 1, 3, 30]))
        rows.append((3 * k - 40, pick.choice([" ", "\n", " \t"]).join(words)))
    return rows


@pytest.mark.parametrize("vocabulary", [2, 3_000])
def test_equals_a_dictionary_of_all_windows(spark, vocabulary):
    rows = corpus(vocabulary, 60, vocabulary)
    rows += [(1_000, "again " * 50), (1_001, "again " * 19), (1_002, rows[7][1]), (1_003, None), (1_004, "")]
    assert result(S.digest(frame(spark, rows))) == sorted(brute(rows), key=lambda r: (order(r), r))


@pytest.mark.parametrize("window,anchor", [(5, 2), (6, 6), (30, 8)])
def test_other_lengths(spark, window, anchor):
    rows = corpus(9, 40, 4)
    assert result(S.digest(frame(spark, rows), window, anchor)) == sorted(brute(rows, window), key=lambda r: (order(r), r))


def test_a_passage_in_a_third_of_all_documents_goes_by_broadcast(spark, monkeypatch):
    pick = random.Random(2)
    passage = " ".join(f"p{k}" for k in range(60))
    rows = []
    for k in range(900):
        own = [" ".join(f"x{pick.randrange(10**6)}" for _ in range(25)) for _ in range(2)]
        rows.append((k, f"{own[0]} {passage} {own[1]}" if k % 3 == 0 else " ".join(own)))
    monkeypatch.setattr(S, "HOT_KEYS", 20)
    assert result(S.digest(frame(spark, rows))) == sorted(brute(rows), key=lambda r: (order(r), r))


def test_repeated_and_missing_ids_and_awkward_texts(spark):
    long = " ".join(f"q{k}" for k in range(45))
    docs = documents(spark, extra=[long, long + " more", long[:-4]])
    extra = [(500, long), (500, long), (500, "z " + long), (None, long), (None, None)]
    docs = docs.unionByName(frame(spark, extra))
    import xxhash

    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]

    def place(row):
        h = 42 if row[1] is None else xxhash.xxh64(row[1].encode(), seed=42).intdigest()
        return (*order(row), h - (1 << 64) if h >= 1 << 63 else h)

    rows.sort(key=place)
    assert result(S.digest(docs)) == sorted(brute(rows), key=lambda r: (order(r), r))


def test_texts_are_returned_with_all_columns(spark):
    long = " ".join(f"q{k}" for k in range(45))
    docs = frame(spark, [(1, f"start {long}  end"), (2, f"other\n{long}"), (3, None), (4, " keeps  its blanks ")])
    found = {r.doc_id: r for r in S.without_repeats(docs).collect()}
    assert S.without_repeats(docs).columns == docs.columns
    assert [found[k].text for k in (1, 2, 3, 4)] == [f"start {long}  end", "other", None, " keeps  its blanks "]
    assert (found[2].n_chars, found[4].n_chars, found[2].mix_c) == (5, 19, "c")


def test_empty_table(spark):
    assert S.digest(empty(spark)).collect() == []
