"""Expressions over one-line game records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shapes of record text. A property value may hold escaped characters.
VALUE = r"((?:\\.|[^\]\\])*)"
MOVE_NODE = r";([BW])\[" + VALUE + r"\]((?:[A-Za-z]+\[(?:\\.|[^\]\\])*\])*)"
FIRST_MOVE = r";[BW]\["
UCI_NODE = r";[BW]\[([a-h][1-8][a-h][1-8][qrbn]?)\]"


def tag(record: Column, name: str) -> Column:
    """Value of a root tag (the text before the first move), NULL when absent."""
    found = F.regexp_extract(root(record), r"(?<![A-Za-z])" + name + r"\[([^\]]*)\]", 0)
    value = F.regexp_extract(root(record), r"(?<![A-Za-z])" + name + r"\[([^\]]*)\]", 1)
    return F.when(found != "", value)


def root(record: Column) -> Column:
    return F.regexp_extract(record, r"(?s)^(.*?)(?:;[BW]\[|$)", 1)


def move_nodes(record: Column) -> Column:
    return F.regexp_extract_all(record, F.lit("(" + MOVE_NODE + ")"), F.lit(1))


def move_count(record: Column) -> Column:
    return F.regexp_count(record, F.lit(FIRST_MOVE))


def prefix(record: Column, plies: int) -> Column:
    """Root and the first moves; asking for more moves than the game has is an error."""
    nodes = move_nodes(record)
    held = F.when(F.size(nodes) < plies, F.raise_error(F.lit("more plies than the game has"))).otherwise(nodes)
    return F.concat(root(record), F.array_join(F.slice(held, 1, plies), ""), F.lit(")"))


def last_moves(record: Column, count: int) -> Column:
    nodes = move_nodes(record)
    keep = F.least(F.lit(count), F.size(nodes))
    return F.concat(root(record), F.array_join(F.slice(nodes, F.size(nodes) - keep + 1, keep), ""), F.lit(")"))


def insert_phase_tags(record: Column, middle: Column, end: Column) -> Column:
    """Phase tags before the first move, -1 for a phase the game never reaches."""
    number = lambda c: F.coalesce(c, F.lit(-1)).cast("string")
    tags = F.concat(F.lit("PM["), number(middle), F.lit("]PE["), number(end), F.lit("]"))
    return F.concat(root(record), tags, F.substr(record, F.length(root(record)) + 1))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([()\[\]\\])", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(.)", "$1")


def blank_observations(line: Column) -> Column:
    """Drop the observation payload; a line without one is an error."""
    present = line.rlike(r"OBS\[[^\]]*\]")
    stripped = F.regexp_replace(line, r"OBS\[[^\]]*\]", "OBS[]")
    return F.when(present, stripped).otherwise(F.raise_error(F.lit("record without OBS tag")))


def data_range(dlen: Column, moves: Column) -> Column:
    """Struct (first, last) of usable positions from a `first-last` tag, by default the whole game."""
    parts = F.split(dlen, "-")
    given = dlen.isNotNull() & (dlen != "")
    return F.struct(
        F.when(given, F.get(parts, F.lit(0)).try_cast("bigint")).otherwise(0).alias("first"),
        F.when(given, F.get(parts, F.size(parts) - 1).try_cast("bigint"))
        .otherwise(F.greatest(moves - 1, F.lit(0)))
        .alias("last"),
    )


def clock_seconds(clock: Column) -> Column:
    """`h:m:s` to seconds."""
    p = F.split(clock, ":")
    n = lambda i: F.get(p, F.lit(i)).try_cast("bigint")
    return n(0) * 3600 + n(1) * 60 + n(2)


def all_clock_seconds(clocks: Column) -> Column:
    """The same for a list of clocks with exactly three parts, without making lists of the parts."""
    n = lambda part: part.try_cast("bigint")
    first_two = lambda c: F.substring_index(c, ":", 2)
    return F.transform(clocks, lambda c: n(F.substring_index(c, ":", 1)) * 3600 + n(F.substring_index(first_two(c), ":", -1)) * 60 + n(F.substring_index(c, ":", -1)))


def time_control(text: Column) -> Column:
    """`base+increment` to a struct of seconds."""
    p = F.split(text, r"\+")
    n = lambda i: F.get(p, F.lit(i)).try_cast("bigint")
    return F.struct(n(0).alias("base_s"), n(1).alias("increment_s"))
