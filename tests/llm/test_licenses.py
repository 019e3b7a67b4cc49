"""License scan against every template without pruning."""

from duelgauge.llm import licenses as L
from tests.llm.cases import TEXTS, documents, empty


def brute(text):
    out = set()
    for a, b in L.units(text or ""):
        own = L.bigrams(L.word_list(text[a:b]))
        for name, body in L.TEMPLATES:
            other = L.bigrams(L.word_list(body))
            if own and 2 * len(own & other) / (len(own) + len(other)) >= L.THRESHOLD:
                out.add((name, a, b))
    return out


MIXED = "Intro text\n\n" + L.TEMPLATES[2][1].replace(", ", ",\n", 4) + "\n\n  \nReleased under the mit license!\nLicensed under CC BY-NC 4.0"


def test_scan(spark):
    docs = documents(spark, extra=[MIXED, L.TEMPLATES[3][1].upper(), L.TEMPLATES[7][1] * 40])
    rows = L.scan(docs).collect()
    assert len(rows) == docs.count()
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    for r in rows:
        if r.doc_id is not None:
            assert {(m.license, m.start, m.stop) for m in r.matches} == brute(texts[r.doc_id])
    found = {m.license for r in rows if r.doc_id == len(TEXTS) for m in r.matches}
    assert found == {"MIT", "CC-BY-NC-4.0"}
    assert L.scan(empty(spark)).count() == 0


def found(text):
    known = L.Templates(L.TEMPLATES + L.FURTHER + L.FULL, L.THRESHOLD)
    return {known.sets[m[2]][0] for m in known.matches(text)}


def commented(text, mark):
    words = text.split()
    lines = [" ".join(words[k : k + 9]) for k in range(0, len(words), 9)]
    return "\n".join(f"{mark} {line}" for line in lines)


PROSE = "The morning was cold and the river lay still under the old bridge while children ran along the bank. " * 5


def test_notices_inside_longer_text():
    for name, body in L.TEMPLATES + L.FURTHER:
        assert name in found(PROSE + body + " " + PROSE), body
        assert name in found("/*\n * Copyright 2020 A. Person\n *\n" + commented(body, " *") + "\n *\n" + commented(PROSE, " *") + "\n */"), body
    assert found(PROSE) == set()


def test_best_license_where_several_overlap():
    for text, name in [
        ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "CC-BY-4.0"),
        (L.GNU.format("program", "GNU General Public", "; ", "2"), "GPL-2.0-or-later"),
        (L.GNU.format("program", "GNU General Public", ", ", "3"), "GPL-3.0-or-later"),
        (L.GNU.format("program", "GNU Affero General Public", ", ", "3"), "AGPL-3.0-or-later"),
    ]:
        assert found(text) == found(PROSE + text) == found(PROSE + "\n" + text + "\n" + PROSE) == {name}


def test_full_texts():
    for name, body in L.FULL:
        assert found(body) == found(PROSE + body + PROSE) == {name}


def test_windows_against_a_plain_count():
    import numpy as np

    rng = np.random.default_rng(4)
    values = rng.integers(0, 6, 60)
    before = np.array([max([j for j in range(i) if values[j] == values[i]], default=-1) for i in range(60)])
    for width in (1, 2, 7, 60):
        for counts in (np.ones(60, bool), values < 3):
            want = [len({v for v, c in zip(values[p : p + width], counts[p : p + width]) if c}) for p in range(61 - width)]
            assert L.distinct(before, counts, width).tolist() == want
