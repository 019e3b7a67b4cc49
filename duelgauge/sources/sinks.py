"""Writers: record lines, partitioned corpora, chain pools, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelgauge.functions.records import escape


def record_lines(games: DataFrame, moves: DataFrame) -> DataFrame:
    """One text line per game, tags before the first move and special characters escaped."""
    special = lambda c: escape(F.col(c).cast("string"))
    node = F.concat(
        F.lit(";"), F.when(F.col("color") == "white", "B").otherwise("W"), F.lit("["), special("move"), F.lit("]"),
        F.coalesce(F.concat(F.lit("TM["), F.col("clock_s").cast("string"), F.lit("]")), F.lit("")),
    )
    bodies = (
        moves.select("game_id", F.struct("ply", node.alias("node")).alias("m"))
        .groupBy("game_id")
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list("m")), lambda m: m["node"]), "").alias("body"))
    )
    tag = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}["), value, F.lit("]")), F.lit(""))
    rating = lambda c: F.when(F.col(c) > 0, F.col(c).cast("string"))
    root = F.concat(
        F.lit("(;GM[chess]"),
        tag("RE", F.col("result").cast("double").cast("string")),
        tag("EV", special("event")),
        tag("PW", special("white")),
        tag("PB", special("black")),
        tag("DT", F.date_format("played_at", "yyyy.MM.dd")),
        tag("WR", rating("white_elo")),
        tag("BR", rating("black_elo")),
    )
    return games.join(bodies, "game_id", "left").select(
        "game_id", F.concat(root, F.coalesce("body", F.lit("")), F.lit(")")).alias("value")
    )


def write_partitioned(df: DataFrame, path: str, *by: str) -> None:
    """One directory per partition value. Rebalancing splits a partition that holds most of the rows
    over several tasks and files, and packs small ones together."""
    df.hint("rebalance", *by).write.mode("overwrite").partitionBy(*by).parquet(path)


# Fixed value: lines of a file that only one task can read, as it is compressed.
LINES_PER_FILE = 20_000


def write_text(lines: DataFrame, path: str, compression: str = "none", lines_per_file: int = 0) -> None:
    """Text files, `lines_per_file` lines at most in each (0: any number)."""
    lines.select("value").write.mode("overwrite").option("maxRecordsPerFile", lines_per_file).text(path, compression=compression)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def markdown_rows(df: DataFrame, digits: int = 3) -> DataFrame:
    """A report table as Markdown lines; numbers with fractions get fixed digits."""
    real = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float", "decimal")}
    cell = lambda c: F.format_string(f"%.{digits}f", F.col(c)) if c in real else F.col(c).cast("string")
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in df.columns]), F.lit(" |")).alias("value"))


def markdown_header(df: DataFrame) -> list[str]:
    return ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]


def json_document(df: DataFrame, key: str, value: Column) -> DataFrame:
    """Rows (key, value) as JSON lines in key order."""
    return df.select(F.col(key).alias("key"), value.alias("v")).orderBy("key").select(F.to_json(F.struct("key", "v")).alias("value"))


def qa_document(moments: DataFrame, histogram: DataFrame, counts: DataFrame) -> DataFrame:
    """One JSON row with moments, histogram counts and scan counters; all three inputs are small."""
    bins = histogram.agg(F.transform(F.sort_array(F.collect_list(F.struct("bin", "n"))), lambda s: s["n"]).alias("v")).scalar()
    packed = moments.agg(F.sort_array(F.collect_list(F.struct(*moments.columns))).alias("v")).scalar()
    return counts.withColumn("histogram", bins).withColumn("moments", packed).select(F.to_json(F.struct("*")).alias("value"))


def metrics_document(metrics: DataFrame, slices: DataFrame, predictions: DataFrame, sample: int = 10) -> DataFrame:
    """One JSON row: overall metrics, slice maps and the first predictions in id order."""
    per_slice = slices.groupBy("slice").agg(
        F.map_from_entries(F.collect_list(F.struct("bucket", F.array(F.col("accuracy"), F.col("n").cast("double"))))).alias("m")
    )
    nested = per_slice.agg(F.map_from_entries(F.collect_list(F.struct("slice", "m"))).alias("v")).scalar()
    first = predictions.orderBy("game_id").limit(sample).agg(F.sort_array(F.collect_list(F.struct(*predictions.columns))).alias("v")).scalar()
    return metrics.withColumn("slices", nested).withColumn("sample_predictions", first).select(F.to_json(F.struct("*")).alias("value"))
