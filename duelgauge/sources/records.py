"""Readers of record text: one-line games, catalogs, annotated records, PGN, Go records, buckets."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duelgauge.functions import rating as R
from duelgauge.functions import records as T
from duelgauge.operators import ordered
from duelgauge.runtime import broadcast_if_small, cut_lineage

# Fixed value: the header of a catalogued record, tags in this order.
CATALOG_HEADER = (
    r"^\(;GM\[chess\]RE\[(-?\d+(?:\.\d+)?)\]EV\[([^\]]*)\]PW\[([^\]]*)\]PB\[([^\]]*)\]"
    r"DT\[(\d{4}\.\d{2}\.\d{2})\](?:WR\[(\d+)\])?(?:BR\[(\d+)\])?"
)
RECORD_START = "(;GM[chess]"
TAG_END = '"]'


def select_inputs(spark: SparkSession, paths: str | Sequence[str]) -> list[str]:
    """An explicit list, or the sorted files of a directory; no file at all is an error."""
    if not isinstance(paths, str):
        chosen = list(paths)
    else:
        files = spark.read.format("binaryFile").load(paths).select("path").orderBy("path")
        chosen = [row.path for row in files.toLocalIterator()]
    if not chosen:
        raise FileNotFoundError(f"no input files in {paths}")
    return chosen


def numbered_lines(spark: SparkSession, path: str | list[str], separator: str | None = None) -> DataFrame:
    """Text lines with their file and position (block, offset order within the block)."""
    reader = spark.read if separator is None else spark.read.option("lineSep", separator)
    return reader.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )


# Fixed value: ends the name that a line of a bundle begins with.
NAME_END = "\t"


def bundle_lines(lines: DataFrame, name: Column) -> DataFrame:
    """Lines of many small files for files that hold many of them: each line begins with the name of its own.

    A line without a name or text gets an empty one in its place.
    """
    return lines.select(F.concat(F.coalesce(name, F.lit("")), F.lit(NAME_END), F.coalesce("value", F.lit(""))).alias("value"))


def unbundled(lines: DataFrame) -> DataFrame:
    """Lines of bundles as `value`, with the name they had as the last part of `file`."""
    end = F.locate(NAME_END, F.col("value"))
    file = F.concat_ws("/", "file", F.substr("value", F.lit(1), end - 1))
    return lines.withColumn("file", file).withColumn("value", F.substr("value", end + 1))


def with_line_numbers(lines: DataFrame, name: str = "line_no") -> DataFrame:
    """0-based number of each line in its file. Blocks of a file are numbered apart and then joined up."""
    numbered = ordered.row_numbers(lines, ["file"], ["at"], F.col("block"), name)
    return numbered.withColumn(name, F.col(name) - 1).drop("block", "at")


def with_whole_file_numbers(lines: DataFrame, name: str = "line_no") -> DataFrame:
    """The same numbers for lines of which none was left out: `at` counts by one inside a block, so the first one
    and the number of lines of every block are enough, and the text itself is neither shuffled nor sorted.
    """
    blocks = lines.groupBy("file", "block").agg(F.min("at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = cut_lineage(blocks.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))))
    inside = F.col("at") - F.col("_first")
    known = F.when((inside >= 0) & (inside < F.col("_n")), inside + F.col("_before")).otherwise(
        F.raise_error(F.lit("the files were cut into other blocks on the second reading")).cast("bigint")
    )
    joined = lines.join(broadcast_if_small(starts, starts), ["file", "block"], "left")
    return joined.select(*[c for c in lines.columns if c not in ("block", "at")], known.alias(name))


def parse_records(lines: DataFrame) -> DataFrame:
    """Tags of one-line records with the reason a line is unusable (`parse_skip`) or NULL."""
    value = F.col("value")
    outcome = T.tag(value, "RE").try_cast("double")
    bad = (
        ~F.is_valid_utf8(value)
        | T.tag(value, "PW").isNull()
        | T.tag(value, "PB").isNull()
        | outcome.isNull()
        | ~outcome.isin(1.0, 0.0, -1.0)
    )
    number = lambda name: T.tag(value, name).try_cast("bigint")
    return lines.select(
        "*",
        T.tag(value, "PW").alias("white"),
        T.tag(value, "PB").alias("black"),
        number("WR").alias("white_elo"),
        number("BR").alias("black_elo"),
        outcome.cast("bigint").alias("result"),
        F.to_date(T.tag(value, "DT"), "yyyy.MM.dd").alias("played_at"),
        T.tag(value, "EV").alias("event"),
        F.when(F.coalesce(bad, F.lit(True)), "parse_skip").alias("problem"),
    )


def scan_counters(parsed: DataFrame) -> DataFrame:
    good = F.col("problem").isNull()
    unrated = F.col("white_elo").isNull() | F.col("black_elo").isNull()
    return parsed.agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(good & (F.col("result") != 0)).alias("decisive"),
        F.count_if(good & (F.col("result") == 0)).alias("draws"),
        F.count_if(~good).alias("parse_skip"),
        F.count_if(good & unrated).alias("rating_skip"),
    )


def read_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_records(spark.read.text(path))


def read_catalog(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Many records per file, found by their header; ids are stem:digest:index.

    The record start is the separator of the text source, so large files stay splittable.
    """
    pieces = numbered_lines(spark, path, RECORD_START)
    record = F.make_valid_utf8(F.concat(F.lit(RECORD_START), F.col("value")))
    header = F.regexp_extract("record", CATALOG_HEADER, 0)
    found = pieces.withColumn("record", record).drop("value").withColumn("header", header).filter("header != ''")
    indexed = with_line_numbers(found, "idx")
    part = lambda i: F.regexp_extract("header", CATALOG_HEADER, i)
    stem = F.regexp_extract("file", r"([^/]+?)(?:\.[^./]*)?$", 1)
    digest = F.substring(F.sha1("header"), 1, 12)
    return indexed.select(
        F.concat_ws(":", stem, digest, F.col("idx").cast("string")).alias("game_id"),
        F.col("file").alias("source"),
        F.to_date(part(5), "yyyy.MM.dd").alias("played_at"),
        F.coalesce(F.nullif(part(2), F.lit("")), F.lit("Blitz")).alias("event"),
        part(3).alias("white"),
        part(4).alias("black"),
        F.coalesce(part(6).try_cast("bigint"), F.lit(0)).alias("white_elo"),
        F.coalesce(part(7).try_cast("bigint"), F.lit(0)).alias("black_elo"),
        R.result_sign(part(1)).alias("result"),
        F.regexp_replace("record", r"\s+$", "").alias("record"),
    )


_TOKEN = re.compile(r"\[(?:\\.|[^\]\\])*\]|[()]|[^\[()]+", re.S)


def _without_variations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def main_line(text: str) -> str:
        depth, kept = 0, []
        for token in _TOKEN.findall(text):
            depth += (token == "(") - (token == ")")
            if depth <= 1 and not (token == ")" and depth == 1):
                kept.append(token)
        return "".join(kept)

    for batch in batches:
        batch["value"] = batch["value"].map(main_line)
        yield batch


def main_lines(records: DataFrame, key: str = "game_id") -> DataFrame:
    """Records without variations. Only records that contain some go through Python."""
    rows = records.select(key, "value")
    bare = F.regexp_replace("value", r"\[(?:\\.|[^\]\\])*\]", "")
    nested = F.regexp_count(bare, F.lit(r"\(")) > 1
    plain = rows.filter(~nested)
    return plain.unionByName(rows.filter(nested).mapInPandas(_without_variations, rows.schema))


def explode_moves(records: DataFrame, key: str = "game_id") -> DataFrame:
    """One row per main-line move: ply, colour, move, clock and all other properties of the node."""
    lines = main_lines(records, key)
    nodes = lines.select(key, F.posexplode(T.move_nodes(F.col("value"))).alias("ply", "node"))
    names = F.regexp_extract_all("node", F.lit(r"([A-Za-z]+)\[" + T.VALUE + r"\]"), F.lit(1))
    values = F.regexp_extract_all("node", F.lit(r"([A-Za-z]+)\[" + T.VALUE + r"\]"), F.lit(2))
    first = F.regexp_extract("node", "^" + T.MOVE_NODE, 1)
    pairs = F.arrays_zip(F.slice(names, 2, F.size(names)).alias("k"), F.slice(values, 2, F.size(values)).alias("v"))
    kept = F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda q: q["k"]), p["k"]) == i + 1)
    props = F.map_from_entries(F.transform(kept, lambda p: F.struct(p["k"], T.unescape(p["v"]))))
    return nodes.select(
        key,
        F.col("ply").cast("bigint").alias("ply"),
        F.when(first == "B", "white").otherwise("black").alias("color"),
        T.unescape(F.get(values, F.lit(0))).alias("move"),
        props.alias("props"),
    ).withColumn("clock_s", F.col("props")["TM"].try_cast("bigint"))


def read_pgn(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """PGN games: tag map and movetext. The blank line before an Event tag separates games."""
    pieces = numbered_lines(spark, path, "\n\n[Event ")
    marked = F.col("value").startswith("\ufeff")
    text = F.replace(F.when(marked, F.substr("value", F.lit(2))).otherwise(F.col("value")), F.lit("\r"), F.lit(""))
    # All tags end before the rest of the last line that ends one: patterns for tags need not search the moves.
    rest = F.length(F.substring_index("_text", TAG_END, -1))
    cut = F.length("_text") - rest + 1
    split = pieces.withColumn("_text", text).withColumn("_cut", cut).drop("value")
    opened = F.concat(F.lit("[Event "), F.regexp_replace(F.substr("_text", F.lit(1), F.col("_cut")), r"^\s*\[Event ", ""))
    rows = with_whole_file_numbers(split.withColumn("_head", opened).withColumn("_rest", F.substr("_text", F.col("_cut") + 1)).drop("_text", "_cut"))
    found = lambda group: F.regexp_extract_all("_head", F.lit(r'(?m)^\[(\w+) "([^"]*)"\]'), F.lit(group))
    # Columns of their own: each text is searched once per group, not once per tag and use.
    named = rows.withColumn("_names", found(1)).withColumn("_values", found(2))
    pairs = F.arrays_zip(F.col("_names").alias("k"), F.col("_values").alias("v"))
    kept = F.filter(pairs, lambda p, i: F.array_position("_names", p["k"]) == i + 1)
    tags = F.map_from_entries(F.transform(kept, lambda p: F.struct(p["k"], p["v"])))
    # A list of one: a condition on tags stays above it, pushed below it would make the tags anew for every use.
    tagged = named.select("file", "line_no", "_head", "_rest", F.explode(F.array(tags)).alias("tags")).filter(F.size("tags") > 0)
    moves = F.concat(F.regexp_replace("_head", r'(?m)^\[\w+ "[^"]*"\]$', ""), "_rest")
    return tagged.select("file", "line_no", "tags", F.trim(F.regexp_replace(moves, r"\s+", " ")).alias("movetext"))


# Half-open lower and closed upper bound of convertible ratings, and the least plies.
PGN_RATING = (0, 3500)
PGN_MIN_PLIES = 22


def pgn_corpus(pgn: DataFrame) -> DataFrame:
    """Convertible blitz games with result, time control, SAN tokens and clock seconds.

    `reason` is NULL for games that pass all tests.
    """
    tag = lambda name: F.col("tags")[name]
    rating = lambda name: tag(name).try_cast("bigint")
    # What begins with a letter behind a space or at the start.
    tokens = F.regexp_extract_all("movetext", F.lit(r"\b[A-Za-z](?<=^.| .)[^ ]*"), F.lit(0))
    moves = F.transform("_tokens", lambda t: F.replace(F.replace(t, F.lit("?"), F.lit("")), F.lit("!"), F.lit("")))
    clocks = T.all_clock_seconds(F.regexp_extract_all("movetext", F.lit(r"(\d+:\d+:\d+)\]"), F.lit(1)))
    absent = lambda name: F.coalesce(tag(name).isin("", "?"), F.lit(True))
    outside = lambda name: ~F.coalesce((rating(name) > PGN_RATING[0]) & (rating(name) <= PGN_RATING[1]), F.lit(False))
    reason = (
        F.when(~F.coalesce(tag("Event").contains("Blitz"), F.lit(False)), "event")
        .when(absent("White") | absent("Black"), "missing_player")
        .when(outside("WhiteElo") | outside("BlackElo"), "rating")
        .when(F.size("_tokens") < PGN_MIN_PLIES, "too_short")
    )
    return (
        pgn.withColumn("_tokens", tokens)
        .withColumn("moves", moves)
        .withColumn("clocks", clocks)
        .withColumn("reason", reason)
        .select(
            "file",
            "line_no",
            tag("White").alias("white"),
            tag("Black").alias("black"),
            rating("WhiteElo").alias("white_elo"),
            rating("BlackElo").alias("black_elo"),
            F.to_date(F.coalesce(tag("UTCDate"), tag("Date")), "yyyy.MM.dd").alias("played_at"),
            F.when(F.col("movetext").contains("1-0"), 1).when(F.col("movetext").contains("0-1"), -1).otherwise(0).cast("bigint").alias("result"),
            T.time_control(tag("TimeControl")).alias("time_control"),
            "moves",
            "clocks",
            "reason",
        )
    )


def read_go_records(spark: SparkSession, path: str | list[str], size: int = 19) -> DataFrame:
    """Go records on one board size; the result is a Black win or not."""
    value = F.col("value")
    rows = spark.read.text(path).filter(T.tag(value, "SZ").try_cast("int") == size)
    return rows.select(
        "value",
        T.tag(value, "KM").try_cast("double").alias("komi"),
        F.when(T.tag(value, "RE").startswith("B"), 1).otherwise(-1).cast("bigint").alias("result"),
        *[T.tag(value, t).alias(n) for t, n in (("PB", "black"), ("PW", "white"), ("BR", "black_rank"), ("WR", "white_rank"))],
    )


def read_buckets(spark: SparkSession, directory: str) -> DataFrame:
    """Lines of LOW_HIGH.txt files with the bucket from the file name; blank lines are left out."""
    lines = spark.read.option("pathGlobFilter", "*_*.txt").option("recursiveFileLookup", "true").text(directory)
    name = F.col("_metadata.file_name")
    pattern = r"^(\d+)_(\d+)\.txt$"
    rows = lines.select(
        "value",
        F.regexp_extract(name, pattern, 1).try_cast("bigint").alias("low"),
        F.regexp_extract(name, pattern, 2).try_cast("bigint").alias("high"),
    )
    return rows.filter(F.col("low").isNotNull() & F.col("value").rlike(r"\S"))
