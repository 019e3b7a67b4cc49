"""Packing: pieces cover their documents, sequences hold, and the search empties bins."""

import zlib

import numpy as np
import pytest

from duelgauge.llm import packing as P
from duelgauge.llm.tokens import PieceEncoder, vocabulary_path
from tests.llm.cases import LONG, TEXTS, documents, empty

ODD = [" ", "  a", "a  b", "a \n b", "a\n\nb", "tab\tx\t\ty", " x   y   z", "a\x1cb \x1c c", "| a | b|c ||", "<|endoftext|> x", "é é ́x", "12 345 6.7%", "\n\n\n", "σς ΑΣ.", "it's I'LL  x"]


@pytest.mark.parametrize("name,spaces", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_piecewise_ids_are_the_ids_of_the_whole(name, spaces):
    encoder = PieceEncoder(vocabulary_path(name), spaces)
    texts = [t or "" for t in TEXTS] + ODD
    want = [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encoder.encode(texts) == want and encoder.encode(texts) == want
    assert encoder.encode([None]) == [b""]


def test_full_memory_changes_nothing(monkeypatch):
    from duelgauge.llm import tokens

    monkeypatch.setattr(tokens, "MEMORY_BYTES", 0)
    encoder = PieceEncoder(vocabulary_path("byte_bpe_50k.json"), True)
    assert encoder.encode(ODD) == [encoder._whole(t) for t in ODD]


@pytest.mark.parametrize("capacity,shard", [(64, 40_000), (64, 10), (2048, 40_000)])
def test_pack_holds_every_id_once(spark, monkeypatch, capacity, shard):
    monkeypatch.setattr(P, "SHARD_ROWS", shard)
    docs = documents(spark)
    path = vocabulary_path("byte_bpe_50k.json")
    rows = P.pack(docs, path, end_id=0, capacity=capacity).collect()
    fills = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert 0 < r.length <= capacity and r.offset == fills.get(r.sequence_id, 0)
        fills[r.sequence_id] = r.offset + r.length
    assert max(fills.values()) <= capacity
    encoder = PieceEncoder(path, True)
    ids = encoder._whole(LONG) + bytes(4)
    own = sorted((r for r in rows if r.doc_id == TEXTS.index(LONG)), key=lambda r: r.piece)
    assert [r.length for r in own[1:]] == [capacity] * (len(own) - 1) and sum(r.length for r in own) * 4 == len(ids)
    assert all(r.ids_crc32 == zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)]) for r in own)
    assert sum(1 for r in rows if r.doc_id == 3) >= 3 and sum(1 for r in rows if r.doc_id is None) >= 2
    if shard > 1000:
        assert len(fills) <= -(-sum(r.length for r in rows) // capacity) + 1


def test_pack_of_nothing(spark):
    assert P.pack(empty(spark), vocabulary_path("byte_bpe_50k.json")).count() == 0


def check(lengths, bins, capacity):
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(lengths[b].sum() <= capacity for b in bins)


def test_search_empties_bins_that_best_fit_leaves():
    lengths = np.array([4, 4, 3, 3, 3, 3])  # best-fit puts 4+4, 3+3+3 and 3; 4+3+3 twice is perfect
    plain = P.best_fit(lengths, 10)
    better = P.local_search(lengths, plain, 10)
    check(lengths, better, 10)
    assert (len(plain), len(better)) == (3, 2)
    saved = 0
    rng = np.random.default_rng(3)
    for _ in range(60):
        capacity = int(rng.integers(20, 100))
        edges = np.sort(rng.integers(1, capacity, (int(rng.integers(5, 25)), 2)), axis=1)
        parts = np.stack([edges[:, 0], edges[:, 1] - edges[:, 0], capacity - edges[:, 1]], 1).ravel()
        lengths = parts[parts > 0]  # three parts fill a bin
        plain = P.best_fit(lengths, capacity)
        better = P.local_search(lengths, plain, capacity)
        check(lengths, plain, capacity)
        check(lengths, better, capacity)
        assert len(better) <= len(plain)
        saved += len(plain) - len(better)
    assert saved > 0


def test_random_texts_need_no_more_than_one_extra_bin():
    rng = np.random.default_rng(4)
    lengths = np.minimum(rng.lognormal(6.3, 1.0, 5000).astype(int) + 1, 2047)
    bins = P.pack_lengths(lengths)
    check(lengths, bins, 2048)
    assert len(bins) <= -(-int(lengths.sum()) // 2048) + 1


def test_full_memory_keeps_pieces_that_return(monkeypatch):
    import tokenizers

    from duelgauge.llm import tokens

    monkeypatch.setattr(tokenizers, "_known_pieces", {}, raising=False)
    monkeypatch.setattr(tokens, "MEMORY_BYTES", 100_000)
    encoder = tokens.PieceEncoder(tokens.vocabulary_path("word_bpe_49k.json"), False)
    for k in range(200):
        text = " ".join([f"q{k}x{j}" for j in range(10)] + ["late"] * (k >= 150))
        assert encoder.encode([text]) == [encoder._whole(text)]
    assert "late" in encoder.known and encoder.kept["bytes"] <= 100_000


VOCABULARIES = [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)]


@pytest.mark.parametrize(("name", "spaces"), VOCABULARIES)
def test_words_are_learned_apart_from_their_marks(monkeypatch, name, spaces):
    import tokenizers

    from duelgauge.llm import tokens

    monkeypatch.setattr(tokenizers, "_known_pieces", {}, raising=False)
    encoder = tokens.PieceEncoder(tokens.vocabulary_path(name), spaces)
    text = " ".join(f"{'abcdéfgh'[k]}lorn{mark}" for k in range(8) for mark in (",", "!!", "***", ".&", "|"))
    assert encoder.encode([text]) == [encoder._whole(text)]
    assert len(encoder.known) <= 8 + 5 + 1  # not 8 times 5; the first word has no space


@pytest.mark.parametrize(("name", "spaces"), VOCABULARIES)
def test_ids_of_cut_texts_are_those_of_whole_texts(name, spaces):
    import pyarrow as pa

    from duelgauge.llm import tokens

    parts = ["the", "The", "É", "é", "İ", "Σ", "Я", "×", "中", "文", "’", "…", "'s", "'t", "'", ".", ",", "***", "|", "3", "½", "q5x3", "ﬁ", "ǰ", "J̌"]
    parts += [" ", "  ", "\n", "\n\n", " \n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", " ", " ", "　", "᠎", "​", "\x00"]
    parts += ["́", "̸", ">", "=", "_", "😀", "हि", "각", "ᄀ", "ᅡ", "<|endoftext|>", "<|startoftext|>", "<|endoftext", "|>", "҂", "÷,"]
    rng = np.random.default_rng(11)
    texts = ["".join(rng.choice(parts, int(n))) for n in rng.integers(0, 12, 4000)] + ["", " ", "\n \n", "<|endoftext|>"]
    encoder = tokens.PieceEncoder(tokens.vocabulary_path(name), spaces)
    assert encoder.cuts
    expected = [encoder._whole(t) if t else b"" for t in texts]
    for at in range(0, len(texts), 500):
        part = [None, *texts[at : at + 500], "after"]
        assert encoder.encode(pa.array(part).slice(0, len(part) - 1)) == [b"", *expected[at : at + 500]]
        assert encoder.encode(part)[1:-1] == expected[at : at + 500]
    assert encoder.encode([]) == [] and encoder.encode([None, ""]) == [b"", b""]
