"""Conversation repair against a search over whole edit sequences."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import types as T

from duelgauge.llm import conversations as C

BLANKS = " \t\n\x0b\x0c\r"
SCHEMA = T.StructType(
    [T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]
    + [T.StructField(n, T.StringType()) for n in ("conv", "piece", "node", "cost", "held", "new")]
)
AFTER = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def cheapest(symbols):
    """(cost, audit) by comparing the whole remaining texts, from the last row backwards."""
    later = None
    for k in range(len(symbols), -1, -1):
        now = {}
        for _ in range(4):  # inserts lead from state to state, at most three in a row
            for s in range(4):
                options = [now[s]] if s in now else []
                for letter in "ua":
                    t = AFTER.get((s, letter))
                    if t in now:
                        options.append((now[t][0] + 3, "I" + now[t][1]))
                if k == len(symbols):
                    if s in (0, 3):
                        options.append((0, ""))
                else:
                    initial, fault = symbols[k]
                    options.append((4 + later[s][0], "D" + later[s][1]))
                    if fault != 2:
                        for letter, cost, name in [(initial, 0, "K"), ("u", 3, "R"), ("a", 3, "R")]:
                            if (s, letter) in AFTER:
                                t = AFTER[s, letter]
                                options.append((cost + 3 * (fault == 1) + later[t][0], name + later[t][1]))
                if options:
                    now[s] = min(options)
        later = now
    return later[0]


def brute(rows):
    """rows: (conv_id, turn, role, text). Results by conv_id."""
    convs = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        convs.setdefault(conv, []).extend([(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1))
    out = {}
    for conv, have in convs.items():
        have.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, symbols, n = set(), [], [0, 0, 0]
        for turn, role, text in have:
            body = text.strip(BLANKS)
            fault = 0 if not body else 1 if (role, text) in seen else 2 if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                n[fault] += 1
            symbols.append((role[:1], {None: 0, 2: 1}.get(fault, 2)))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(have, have[1:]))
        cost, audit = cheapest(symbols)
        state, left, lines = 0, iter(have), []
        for letter in audit:
            row = None if letter == "I" else next(left)
            if letter != "D":
                role = row[1] if letter == "K" else "assistant" if state == 2 else "user"
                lines.append(role + ":" + (row[2] if row else ""))
                state = AFTER[state, role[0]]
        turns = [t for t, _, _ in have if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *n, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def random_rows(seed, convs, longest):
    pick = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "Assistant", "super"]
    texts = ["Yes.", "No!", "cut off", "", " \t\n", None, "Why?", "x" * 50, "Größe。", "end. \n"]
    rows = []
    for c in range(convs):
        turn = pick.choice([0, 5])
        for k in range(pick.randint(1, longest)):
            turn += pick.choice([0, 1, 1, 1, 1, 3])
            role = ["user", "assistant"][k % 2] if pick.random() < 0.6 else pick.choice(roles)
            text = f"Message {pick.random()}." if pick.random() < 0.6 else pick.choice(texts)
            rows.append((c if c % 11 else None, turn if pick.random() < 0.95 else None, role, text))
    return rows


def frame(spark, rows, parts):
    return spark.createDataFrame([(*r, *["c"] * 6) for r in rows], SCHEMA).repartition(parts)


def result(found):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return {r.conv_id: tuple(r[n] for n in names) for r in found.collect()}


@pytest.mark.parametrize("limits", [{}, {"chunk_rows": 3, "fan_bits": 1}, {"chunk_bytes": 1}])
def test_equals_a_search_over_whole_edit_sequences(spark, limits):
    rows = random_rows(7, 60, 14) + [(1, 2, "user", "Twice?"), (1, 2, "user", "Twice?")]
    rows += [(999, t, ["user", "assistant"][t % 3 % 2], f"Turn {t % 40}.") for t in range(90)]  # runs, repeats far apart
    got = result(C.digest(frame(spark, rows, 3), **limits))
    want = brute(rows)
    assert got.keys() == want.keys()
    assert [(k, got[k]) for k in want if got[k] != want[k]] == []


def test_products_of_powers_equal_single_rows():
    pick = random.Random(3)
    for _ in range(200):
        symbols = []
        for _ in range(pick.randint(1, 6)):
            symbols += [(pick.choice(["s", "u", "a", ""]), pick.randint(0, 2))] * pick.choice([1, 1, 2, 7, 30])
        assert C.solve(tuple(symbols)) == cheapest(symbols)


def test_a_long_run_costs_a_few_products():
    C.power.cache.clear()
    stretch = C.Stretch([("u", 0)] * 100_000)
    assert len(stretch.factors) <= 17 and len(C.power.cache) <= 17
    cost, state = C.last_state(stretch.total)
    assert len(stretch.audit(0, state)) >= 100_000 and cost == 3 * 50_000


def test_dropped_conversations_empty_tables_and_null_columns(spark):
    lost = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(lost, 0, "user", "All gone."), (None, None, None, None)]
    empty = hashlib.sha256(b"").hexdigest()
    got = result(C.digest(frame(spark, rows, 2)))
    assert got[lost] == (0, 0, 0, 0, 0, 0, "", empty)
    assert got == brute(rows)
    assert C.digest(frame(spark, rows, 1).limit(0)).collect() == []


def test_repaired_messages_are_returned(spark):
    rows = [(c, t, r, x) for c in (5, 6) for t, (r, x) in enumerate([("system", "Be brief."), ("user", "Hi there."), ("user", "And this?"), ("assistant", "Done.")])]
    whole, pieces = C.repair(C.damaged(frame(spark, rows, 1)).withColumn("times", C.F.lit(1)))
    for r in [*whole.collect(), *pieces.collect()]:
        assert [m.role[0] for m in r.messages] in (list("suaua"), list("sua"))
