"""Repair of conversation structure by a run-length dynamic programme.

A conversation must read `(s?(ua)+)?` in its role initials. A row is kept (0), given the role user or
assistant (3) or deleted (4, the only choice for blank and duplicate rows); empty user or assistant
messages may be inserted anywhere (3 each); a truncated row that stays costs 3 more. The cheapest
edits are found over an automaton of four states, ties going to the audit that is least in ASCII.

*Transitions.* One row is a min-plus matrix over pairs of states: cost of the cheapest way, and the rank
of its audit text among the sixteen. Inserts belong to the row they precede, so the texts of one stretch of
rows form a prefix-free code and ranks compose: text of a product is least where first the left rank, then the
right rank is least. Equal consecutive (role initial, fault) symbols are one run; a run is advanced
through cached binary powers of its symbol's matrix, and the chosen middle states are unrolled for the audit.

*Spark.* Rows are sorted globally by conversation and turn, so that no conversation has to fit into a task.
A task solves the conversations that lie wholly inside its partition. Others (at most two a partition, and those above
CHUNK_ROWS rows or CHUNK_BYTES bytes) become chunks: what an earlier chunk already said is found by an aggregation,
each chunk is reduced to its matrix, the matrices are multiplied in groups of at most 2^FAN_BITS, and the states
chosen at the top are handed down to the chunks, which then write their pieces. The digest of a
conversation in pieces streams them through one task in order, since a SHA-256 cannot be put together from parts;
the task holds one piece at a time and the audit, which is one value of the result.

Defined cases: null roles and texts are one space, also null ids and turns in the damage key; null turns come
first; rows of one turn stand in the order of role, then text (its first 32 characters, then a hash); repeated rows
are rows of their own (the later one a duplicate); a null conv_id is a conversation of its own; a role without
letters has no initial and cannot be kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duelgauge.llm.common import BLANKS, key_of, ship
from duelgauge.runtime import cut_lineage

CHUNK_ROWS = 2_048
CHUNK_BYTES = 4 << 20
FAN_BITS = 12

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3
NEVER = 1 << 40
# Automaton of (s?(ua)+)?: 0 start, 1 after s, 2 after u, 3 after a; 0 and 3 accept.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NEXT_ROLE = {0: "user", 1: "user", 2: "assistant", 3: "user"}
ENDS = {0: "", 1: "II", 2: "I", 3: ""}
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
GOOD, TRUNCATED, DOOMED = 0, 1, 2

Symbol = tuple[str, int]  # role initial (s, u, a or empty for others), GOOD, TRUNCATED or DOOMED
Shape = tuple[tuple[int, ...], tuple[int, ...]]  # costs less their least, ranks of the audits


class Product(NamedTuple):
    base: int  # added to all costs
    shape: Shape
    middle: tuple[int, ...]  # state between the factors, by 4 * entry + exit


def remembered(limit: int) -> Callable:
    """Results by arguments, forgotten when there are `limit` of them; plain functions travel to executors by value."""

    def wrap(fn: Callable) -> Callable:
        cache: dict[tuple, object] = {}

        def call(*key):
            if key not in cache:
                if len(cache) >= limit:
                    cache.clear()
                cache[key] = fn(*key)
            return cache[key]

        call.cache = cache
        return call

    return wrap


def _shaped(best: dict[int, tuple]) -> tuple[int, Shape]:
    """best: by 4 * entry + exit, (cost, anything that orders the audits)."""
    base = min(c for c, _ in best.values())
    order = {text: k for k, text in enumerate(sorted({text for _, text in best.values()}))}
    costs = tuple(best[i][0] - base if i in best else NEVER for i in range(16))
    return base, (costs, tuple(order[best[i][1]] if i in best else 16 for i in range(16)))


@remembered(64)
def row_choices(symbol: Symbol) -> dict[int, tuple[int, str]]:
    """Cheapest (cost, audit) of one row and the inserts before it, by 4 * entry + exit."""
    initial, fault = symbol
    best: dict[int, tuple[int, str]] = {}
    for entry in range(4):
        state = entry
        for inserts in range(4):
            options = [(DELETE, "D", state)]
            if fault != DOOMED:
                late = CUT_OFF if fault == TRUNCATED else 0
                if (state, initial) in STEP:
                    options.append((KEEP + late, "K", STEP[state, initial]))
                options.append((REROLE + late, "R", STEP[state, NEXT_ROLE[state][0]]))
            for cost, letter, leave in options:
                found = (cost + INSERT * inserts, "I" * inserts + letter)
                at = 4 * entry + leave
                best[at] = min(best.get(at, found), found)
            state = STEP[state, NEXT_ROLE[state][0]]
    return best


@remembered(1 << 16)
def product(left: Shape, right: Shape) -> Product:
    best: dict[int, tuple[int, tuple[int, int]]] = {}
    middle = [0] * 16
    for entry in range(4):
        for leave in range(4):
            found = None
            for m in range(4):
                a, b = 4 * entry + m, 4 * m + leave
                cost = left[0][a] + right[0][b]
                if cost < NEVER:
                    way = (cost, (left[1][a], right[1][b]), m)
                    found = way if found is None else min(found, way)
            if found:
                best[4 * entry + leave] = found[:2]
                middle[4 * entry + leave] = found[2]
    base, shape = _shaped(best)
    return Product(base, shape, tuple(middle))


@remembered(1_024)
def power(symbol: Symbol, bit: int) -> Product:
    """2^bit rows of one symbol."""
    if bit == 0:
        base, shape = _shaped(row_choices(symbol))
        return Product(base, shape, (0,) * 16)
    half = power(symbol, bit - 1)
    twice = product(half.shape, half.shape)
    return twice._replace(base=twice.base + 2 * half.base)


@remembered(8_192)
def power_audit(symbol: Symbol, bit: int, entry: int, leave: int) -> str:
    at = 4 * entry + leave
    if bit == 0:
        return row_choices(symbol)[at][1]
    m = power(symbol, bit).middle[at]
    return power_audit(symbol, bit - 1, entry, m) + power_audit(symbol, bit - 1, m, leave)


class Stretch:
    """Product of consecutive rows, kept factor by factor so that its choices can be unrolled."""

    def __init__(self, symbols: Iterable[Symbol]):
        self.factors: list[tuple[Symbol, int]] = []
        self.steps: list[Product] = []
        for symbol, run in groupby(symbols):
            length = sum(1 for _ in run)
            self.factors += [(symbol, bit) for bit in reversed(range(length.bit_length())) if length >> bit & 1]
        for symbol, bit in self.factors:
            now = power(symbol, bit)
            if self.steps:
                before = self.steps[-1]
                both = product(before.shape, now.shape)
                now = both._replace(base=both.base + before.base + now.base)
            self.steps.append(now)

    @property
    def total(self) -> Product:
        return self.steps[-1]

    def audit(self, entry: int, leave: int) -> str:
        out = []
        for k in range(len(self.factors) - 1, -1, -1):
            m = self.steps[k].middle[4 * entry + leave] if k else entry
            out.append(power_audit(*self.factors[k], m, leave))
            leave = m
        return "".join(reversed(out))


def last_state(total: Product) -> tuple[int, int]:
    """(cost, state) at the end of a conversation that began in state 0, inserts after the last row included."""
    ends = [(total.shape[0][t] + INSERT * len(ENDS[t]), (total.shape[1][t], ENDS[t]), t) for t in range(4)]
    cost, _, state = min(ends)
    return cost + total.base, state


@remembered(1 << 14)
def solve(symbols: tuple[Symbol, ...]) -> tuple[int, str]:
    """Cost and audit of one whole conversation."""
    if not symbols:
        return 0, ""
    stretch = Stretch(symbols)
    cost, state = last_state(stretch.total)
    return cost, stretch.audit(0, state) + ENDS[state]


# --- rows ------------------------------------------------------------------------------------------


class Row(NamedTuple):
    turn: int | None
    role: str
    text: str


def initial(role: str) -> str:
    return role[:1] if role[:1] in ("s", "u", "a") else ""


def faults(rows: list[Row], said_before: set[int]) -> list[int]:
    """0 none, 1 blank, 2 duplicate, 3 truncated. said_before: rows that an earlier chunk already holds."""
    seen: set[tuple[str, str]] = set()
    out = []
    for k, row in enumerate(rows):
        body = row.text.strip(BLANKS)
        key = (row.role, row.text)
        out.append(1 if not body else 2 if key in seen or k in said_before else 0 if body[-1] in ".!?" else 3)
        seen.add(key)
    return out


def symbols_of(rows: list[Row], found: list[int]) -> tuple[Symbol, ...]:
    return tuple((initial(r.role), GOOD if f == 0 else TRUNCATED if f == 3 else DOOMED) for r, f in zip(rows, found))


class Summary(NamedTuple):
    """What of a stretch of rows can be added to that of the next."""

    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    first: str | None = None  # role initials of the first and last row, None without rows
    last: str | None = None
    least: int | None = None  # turns
    most: int | None = None
    turns: int = 0

    def plus(self, other: Summary) -> Summary:
        crossing = self.last is not None and other.first is not None and (self.last, other.first) not in LEGAL
        shared = self.most is not None and self.most == other.least
        return Summary(
            self.blank + other.blank,
            self.duplicate + other.duplicate,
            self.truncated + other.truncated,
            self.illegal + other.illegal + int(crossing),
            other.first if self.first is None else self.first,
            self.last if other.last is None else other.last,
            other.least if self.least is None else self.least,
            self.most if other.most is None else other.most,
            self.turns + other.turns - int(shared),
        )

    def counts(self) -> dict[str, int]:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return {"gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal}


def summary(rows: list[Row], found: list[int]) -> Summary:
    if not rows:
        return Summary()
    letters = [r.role[:1] for r in rows]
    turns = sorted({r.turn for r in rows if r.turn is not None})
    bad = sum(pair not in LEGAL for pair in zip(letters, letters[1:]))
    least, most = (turns[0], turns[-1]) if turns else (None, None)
    return Summary(found.count(1), found.count(2), found.count(3), bad, letters[0], letters[-1], least, most, len(turns))


def repaired(rows: list[Row], audit: str, state: int = 0) -> list[tuple[str, str]]:
    """The messages that the audit's edits leave, entering in `state`."""
    out, left = [], iter(rows)
    for letter in audit:
        row = None if letter == "I" else next(left)
        if letter == "D":
            continue
        role = row.role if letter == "K" else NEXT_ROLE[state]
        out.append((role, row.text if row else ""))
        state = STEP[state, role[0]]
    return out


# --- Spark -----------------------------------------------------------------------------------------

COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")
MESSAGES = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
RESULT = [*[(c, pa.int64()) for c in (*COUNTS, "cost")], ("audit", pa.string()), ("messages", MESSAGES)]
RESULT_DDL = ", ".join(f"{c} long" for c in (*COUNTS, "cost")) + ", audit string, messages array<struct<role:string,text:string>>"
HELD = pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]))
HELD_DDL = "array<struct<turn:long,role:string,text:string>>"
SUMMARY_DDL = "blank long, duplicate long, truncated long, illegal long, first string, last string, least string, most string, turns long"  # turns as text: a null keeps others exact in pandas
NODE_DDL = f"conv string, node long, base long, costs array<long>, ranks array<int>, {SUMMARY_DDL}"
CHOSEN_DDL = "conv string, node long, entry int, leave int"


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, conv (its non-null key), turn, role, text and times: how often the row stands after the damage (0: dropped)."""
    space = F.lit(" ")
    turn, role, text = F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), space), F.coalesce(F.col("text").cast("string"), space)
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(turn.cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    return conversations.select(
        "conv_id",
        key_of("conv_id").alias("conv"),
        turn.alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind.isin(0, 1), F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("times"),
    )


def _ordered(rows: DataFrame) -> DataFrame:
    """Globally sorted, any group of equal keys split over partitions where it has to be."""
    keys = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, 32), F.xxhash64("text"), F.col("apart")]
    return rows.withColumn("apart", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("apart")


def _solved_or_held(rows: DataFrame, chunk_rows: int, chunk_bytes: int) -> DataFrame:
    """Results of the conversations inside a partition; chunks of `held` rows of all others."""
    ship(__name__)
    id_type = rows.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", id_type), *T._parse_datatype_string(f"conv string, piece long, {RESULT_DDL}, held {HELD_DDL}").fields])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        arrow: pa.Schema | None = None
        out: list[dict] = []
        out_bytes = 0
        open_rows: list[Row] = []
        size, conv, conv_id, alone = 0, None, None, False  # alone: the conversation began in here and has no chunk yet

        def close(ended: bool) -> None:
            nonlocal number, open_rows, size
            row = {"conv_id": conv_id, "conv": conv, "piece": number}
            if ended and alone:
                found = faults(open_rows, set())
                cost, audit = solve(symbols_of(open_rows, found))
                made = [{"role": a, "text": b} for a, b in repaired(open_rows, audit)]
                row |= {**summary(open_rows, found).counts(), "cost": cost, "audit": audit, "messages": made}
            else:
                row |= {"held": [r._asdict() for r in open_rows]}
            out.append(row)
            number, open_rows, size = number + 1, [], 0

        for batch in batches:
            arrow = arrow or pa.schema([batch.schema.field("conv_id"), ("conv", pa.string()), ("piece", pa.int64()), *RESULT, ("held", HELD)])
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "conv", "turn", "role", "text", "times")]
            for row_id, row_conv, turn, role, text, times in zip(*columns):
                if row_conv != conv:
                    if conv is not None:
                        close(ended=True)
                    alone, conv, conv_id = conv is not None, row_conv, row_id
                elif len(open_rows) >= chunk_rows or size >= chunk_bytes:
                    close(ended=False)
                    alone = False
                open_rows += [Row(turn, role, text)] * times
                size += len(text)
                out_bytes += len(text)
            if out and out_bytes >= 4 << 20:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out, out_bytes = [], 0
        if conv is not None:
            close(ended=False)  # may go on in the next partition
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return rows.mapInArrow(work, schema)


def _with_repeats(held: DataFrame) -> DataFrame:
    """Adds `before`: places in the chunk of the rows that an earlier chunk of the conversation says as well."""
    ship(__name__)

    def keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv, piece, rows in zip(*[batch.column(c).to_pylist() for c in ("conv", "piece", "held")]):
                places: dict[bytes, int] = {}
                for k, r in enumerate(rows):
                    places.setdefault(xxhash.xxh3_128_digest(f"{len(r['role'])}:{r['role']}{r['text']}".encode(errors="surrogatepass")), k)
                if places:
                    n = len(places)
                    yield pa.RecordBatch.from_pydict(
                        {"conv": [conv] * n, "said": pa.array(list(places), pa.binary()), "piece": pa.array([piece] * n, pa.int64()), "place": pa.array(list(places.values()), pa.int32())}
                    )

    said = held.select("conv", "piece", "held").mapInArrow(keys, "conv string, said binary, piece long, place int")
    first = said.groupBy("conv", "said").agg(F.min(F.struct("piece", "place")).alias("at"))
    per_chunk = first.groupBy("conv", F.col("at.piece").alias("piece")).agg(F.collect_list("at.place").alias("new"))  # at most one per row of the chunk
    return held.join(per_chunk, ["conv", "piece"], "left")


def _live(rows: list[dict], new: list[int] | None) -> tuple[list[Row], list[int]]:
    live = [Row(r["turn"], r["role"], r["text"]) for r in rows]
    return live, faults(live, set(range(len(live))) - set(new or []))


def _nodes(chunks: DataFrame) -> DataFrame:
    """Each chunk as one matrix with its counts; a chunk without rows is the identity and left out."""
    ship(__name__)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, piece, rows, new in zip(*[batch.column(c).to_pylist() for c in ("conv", "piece", "held", "new")]):
                live, found = _live(rows, new)
                if live:
                    total = Stretch(symbols_of(live, found)).total
                    out.append({"conv": conv, "node": piece, **_node(total, summary(live, found))})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=NODE_ARROW)

    return chunks.select("conv", "piece", "held", "new").mapInArrow(work, NODE_DDL)


NODE_ARROW = pa.schema(
    [("conv", pa.string()), ("node", pa.int64()), ("base", pa.int64()), ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int32()))]
    + [(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")]
    + [(c, pa.string()) for c in ("first", "last", "least", "most")]
    + [("turns", pa.int64())]
)


def _node(total: Product, counts: Summary) -> dict:
    bounds = {c: None if getattr(counts, c) is None else str(getattr(counts, c)) for c in ("least", "most")}
    return {"base": total.base, "costs": list(total.shape[0]), "ranks": list(total.shape[1]), **counts._asdict(), **bounds}


def _frame_nodes(frame: pd.DataFrame) -> tuple[list[int], list[Product], list[Summary]]:
    frame = frame.sort_values("node")
    shapes = [Product(int(b), (tuple(map(int, c)), tuple(map(int, r))), (0,) * 16) for b, c, r in zip(frame["base"], frame["costs"], frame["ranks"])]
    texts = ("first", "last")
    columns = [[None if v is None else v if c in texts else int(v) for v in frame[c].tolist()] for c in Summary._fields]
    counts = [Summary(*values) for values in zip(*columns)]
    return frame["node"].tolist(), shapes, counts


def _multiplied(shapes: list[Product]) -> list[Product]:
    steps = shapes[:1]
    for now in shapes[1:]:
        both = product(steps[-1].shape, now.shape)
        steps.append(both._replace(base=both.base + steps[-1].base + now.base))
    return steps


def _ways(nodes: list[int], steps: list[Product], entry: int, leave: int) -> list[tuple[int, int, int]]:
    """(node, entry, exit) of every factor."""
    out = []
    for k in range(len(nodes) - 1, -1, -1):
        m = steps[k].middle[4 * entry + leave] if k else entry
        out.append((nodes[k], m, leave))
        leave = m
    return out


def _sum(counts: list[Summary]) -> Summary:
    total = Summary()
    for c in counts:
        total = total.plus(c)
    return total


def _states(nodes: DataFrame, fan_bits: int) -> tuple[DataFrame, DataFrame]:
    """(conv, node, entry, leave) of every chunk, and the counts, cost and end of every conversation.

    Neighbours are multiplied in groups of at most 2^fan_bits, level by level, until every conversation has one group.
    """
    ship(__name__)
    levels = [cut_lineage(nodes)]
    while (levels[-1].groupBy("conv").count().agg(F.max("count")).first()[0] or 0) > 1 << fan_bits:

        def up(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            _, shapes, counts = _frame_nodes(frame)
            row = {"conv": key[0], "node": int(key[1]), **_node(_multiplied(shapes)[-1], _sum(counts))}
            return pa.Table.from_pylist([row], schema=NODE_ARROW).to_pandas()

        grouped = levels[-1].withColumn("parent", F.shiftright("node", fan_bits)).groupBy("conv", "parent")
        levels.append(cut_lineage(grouped.applyInPandas(up, NODE_DDL)))

    def top(frame: pd.DataFrame) -> pd.DataFrame:
        nodes, shapes, counts = _frame_nodes(frame)
        steps = _multiplied(shapes)
        cost, leave = last_state(steps[-1])
        ways = _ways(nodes, steps, 0, leave)
        made = pd.DataFrame(ways, columns=["node", "entry", "leave"]).assign(conv=frame["conv"].iloc[0], ending="", cost=cost, **_sum(counts).counts())
        made.loc[made["node"] == nodes[-1], "ending"] = ENDS[leave]
        return made

    totals_ddl = ", ".join(f"{c} long" for c in (*COUNTS, "cost"))
    chosen = cut_lineage(levels[-1].groupBy("conv").applyInPandas(top, f"{CHOSEN_DDL}, ending string, {totals_ddl}"))
    totals = chosen.groupBy("conv").agg(F.max("ending").alias("ending"), *[F.first(c).alias(c) for c in (*COUNTS, "cost")])

    def down(frame: pd.DataFrame) -> pd.DataFrame:
        nodes, shapes, _ = _frame_nodes(frame)
        ways = _ways(nodes, _multiplied(shapes), int(frame["entry"].iloc[0]), int(frame["leave"].iloc[0]))
        return pd.DataFrame(ways, columns=["node", "entry", "leave"]).assign(conv=frame["conv"].iloc[0])

    states = chosen.select("conv", "node", "entry", "leave")
    for level in reversed(levels[:-1]):
        parents = states.withColumnRenamed("node", "parent")
        joined = level.withColumn("parent", F.shiftright("node", fan_bits)).join(parents, ["conv", "parent"])
        states = joined.groupBy("conv", "parent").applyInPandas(down, CHOSEN_DDL)
    return states, totals


def _pieces(held: DataFrame, fan_bits: int) -> DataFrame:
    """The held chunks with their part of the audit and of the repaired messages."""
    ship(__name__)
    chunks = cut_lineage(_with_repeats(held))
    states, totals = _states(_nodes(chunks), fan_bits)
    final = chunks.groupBy("conv").agg(F.max("piece").alias("final"))
    sized = final.join(totals, "conv", "left")  # a conversation without rows has no totals
    ready = chunks.join(states.withColumnRenamed("node", "piece"), ["conv", "piece"], "left").join(sized, "conv")
    schema = T.StructType([held.schema["conv_id"], *T._parse_datatype_string(f"conv string, piece long, {RESULT_DDL}").fields])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                live, found = _live(row["held"], row["new"])
                audit = Stretch(symbols_of(live, found)).audit(row["entry"], row["leave"]) if live else ""
                made = repaired(live, audit, row["entry"] or 0)
                if row["ending"] and row["piece"] == row["final"]:
                    state = {"I": 2, "II": 1}[row["ending"]]
                    made += repaired([], row["ending"], state)
                    audit += row["ending"]
                counts = {c: row[c] or 0 for c in (*COUNTS, "cost")}
                out.append({"conv_id": row["conv_id"], "conv": row["conv"], "piece": row["piece"], **counts, "audit": audit, "messages": [{"role": a, "text": b} for a, b in made]})
            arrow = pa.schema([batch.schema.field("conv_id"), ("conv", pa.string()), ("piece", pa.int64()), *RESULT])
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return ready.select("conv_id", "conv", "piece", "held", "new", "entry", "leave", "ending", "final", *COUNTS, "cost").mapInArrow(work, schema)


def repair(rows: DataFrame, chunk_rows: int = CHUNK_ROWS, chunk_bytes: int = CHUNK_BYTES, fan_bits: int = FAN_BITS) -> tuple[DataFrame, DataFrame]:
    """Repaired conversations: (those in one piece, pieces of the others in the order of `piece`).

    rows: conv_id, conv, turn, role, text, times, as `damaged` gives them. Both results have conv_id, conv, piece,
    gaps, blank, duplicate, truncated, illegal, cost (of the whole conversation), audit and messages (of the piece).
    """
    made = cut_lineage(_solved_or_held(_ordered(rows), chunk_rows, chunk_bytes))
    whole = made.filter(F.col("held").isNull()).drop("held")
    held = made.filter(F.col("held").isNotNull()).select("conv_id", "conv", "piece", "held")
    return whole, _pieces(held, fan_bits)


def digest(conversations: DataFrame, chunk_rows: int = CHUNK_ROWS, chunk_bytes: int = CHUNK_BYTES, fan_bits: int = FAN_BITS) -> DataFrame:
    """Per conversation: what the damage left wrong, cost and audit of the repair, and the hash of the repaired text."""
    ship(__name__)
    whole, pieces = repair(damaged(conversations), chunk_rows, chunk_bytes, fan_bits)
    keep = ["conv_id", *COUNTS, "cost", "audit"]
    lines = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n")
    direct = whole.select(*keep, F.sha2(lines, 256).alias("repaired_sha256"))

    def stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict | None = None
        arrow = None

        def done() -> pa.RecordBatch:
            row = held["row"] | {"audit": "".join(held["audit"]), "repaired_sha256": held["hash"].hexdigest()}
            return pa.RecordBatch.from_pylist([{f.name: row[f.name] for f in arrow}], schema=arrow)

        for batch in batches:
            arrow = pa.schema([batch.schema.field(c) for c in keep] + [("repaired_sha256", pa.string())])
            for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                if held is None or held["row"]["conv"] != row["conv"]:
                    if held:
                        yield done()
                    held = {"row": row | {"messages": None}, "audit": [], "hash": hashlib.sha256(), "lines": 0}
                held["audit"].append(row["audit"])
                for m in row["messages"]:
                    held["hash"].update((b"\n" if held["lines"] else b"") + f"{m['role']}:{m['text']}".encode(errors="surrogatepass"))
                    held["lines"] += 1
        if held:
            yield done()

    together = pieces.repartition("conv").sortWithinPartitions("conv", "piece")
    return direct.unionByName(together.mapInArrow(stream, direct.schema))
