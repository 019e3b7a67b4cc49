"""Record files: round trip, damage, order."""

import os
import random
import zlib

import numpy as np
import pytest

from duelgauge.llm import records as R
from duelgauge.llm.tokens import PieceEncoder, vocabulary_path
from tests.llm.cases import documents, empty

PATH = vocabulary_path("word_bpe_49k.json")


def expected(docs):
    encoder = PieceEncoder(PATH, False)
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    out, at = [], 0
    for doc_id, text in rows:
        ids = encoder._whole(text or "") + np.array([1], "<u4").tobytes()
        out.append((doc_id, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    return out


@pytest.mark.parametrize("size", [64 << 20, 500])
def test_written_and_read(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(R, "FILE_BYTES", size)
    docs = documents(spark)
    got = R.written_and_read(docs, PATH, 1, f"file://{tmp_path}").collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected(docs)
    assert len([f for f in os.listdir(tmp_path) if f.endswith(".rec")]) >= (1 if size > 500 else 3)


def test_nothing(spark, tmp_path):
    assert R.written_and_read(empty(spark), PATH, 1, f"file://{tmp_path}").count() == 0


def test_random_order_and_damage(tmp_path):
    file = R.RecordFile(f"file://{tmp_path}")
    rows = [(k if k % 5 else None, np.arange(k, dtype="<u4") * (70_000 if k % 2 else 1)) for k in range(40)]
    for doc_id, ids in rows:
        file.add(doc_id, ids.tobytes())
    file.close()
    want = [(d, i.tobytes()) for d, i in rows]
    assert list(R.read_file(f"file://{tmp_path}", file.name)) == want
    mixed = list(R.read_file(f"file://{tmp_path}", file.name, random.Random(1)))
    assert mixed != want and sorted(mixed, key=str) == sorted(want, key=str)
    path = tmp_path / (file.name + ".rec")
    raw = bytearray(path.read_bytes())
    raw[len(raw) // 2] ^= 1
    path.write_bytes(raw)
    with pytest.raises(ValueError):
        list(R.read_file(f"file://{tmp_path}", file.name))
