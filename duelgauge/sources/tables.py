"""Readers of score caches, calibrations, metric reports, logs and match tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duelgauge import schemas
from duelgauge.runtime import require
from duelgauge.sources.records import numbered_lines, unbundled, with_line_numbers, with_whole_file_numbers


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def score_cache(spark: SparkSession, path: str, schema: T.StructType, compute: Callable[[], DataFrame]) -> DataFrame:
    """Read the score table when it exists, else compute and write it; always read back what is stored."""
    if not path_exists(spark, f"{path}/_SUCCESS"):
        compute().write.mode("overwrite").option("header", True).csv(path)
    return spark.read.schema(schema).option("header", True).csv(path)


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CALIBRATION).option("multiLine", True).json(path)


def guard(table: DataFrame, **expected) -> DataFrame:
    """Fail when a stored table was made under other settings."""
    same = F.lit(True)
    for name, value in expected.items():
        same = same & F.col(name).eqNullSafe(F.lit(value))
    return require(table, same, f"stored table does not match this run: {expected}")


def read_metric_reports(spark: SparkSession, path: str) -> DataFrame:
    """One report per line, exploded to (run, slice, bucket, low, high, midpoint, accuracy, n)."""
    lines = with_line_numbers(numbered_lines(spark, path).filter(F.col("value").rlike(r"\S")), "run")
    parsed = lines.select("run", F.from_json("value", schemas.METRICS).alias("m"))
    slices = parsed.select("run", F.explode("m.slices").alias("slice", "buckets"))
    buckets = slices.select("run", "slice", F.explode("buckets").alias("bucket", "v"))
    edge = lambda i: F.get(F.split("bucket", "-"), F.lit(i)).try_cast("double")
    return buckets.select(
        "run",
        "slice",
        "bucket",
        ((edge(0) + edge(1)) / 2).alias("midpoint"),
        F.get("v", F.lit(0)).alias("accuracy"),
        F.get("v", F.lit(1)).cast("bigint").alias("n"),
    )


def read_accuracy_table(spark: SparkSession, path: str, max_games: int | None = None) -> DataFrame:
    """Accuracy table of an evaluator log: (games, rank, accuracy) after the summary marker."""
    lines = with_whole_file_numbers(numbered_lines(spark, path))
    marker = lines.filter(F.col("value").contains("Summarizing accuracy")).groupBy("file").agg(F.min("line_no").alias("_at"))
    after = lines.join(marker, "file").filter(F.col("line_no") > F.col("_at"))
    cells = F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\s+")
    header = after.filter(F.col("line_no") == F.col("_at") + 1).select("file", cells.alias("ranks"))
    rows = after.filter(F.get(cells, F.lit(0)).try_cast("int").between(1, max_games or 2**31 - 1) & (F.size(cells) > 2))
    named = rows.select("file", "line_no", "_at", cells.alias("c")).filter(F.col("line_no") > F.col("_at") + 1).join(header, "file")
    return named.select(
        "file", F.get("c", F.lit(0)).cast("bigint").alias("games"), F.posexplode("ranks").alias("i", "rank"), "c"
    ).select("file", "games", "rank", F.get("c", F.col("i") + 1).try_cast("double").alias("accuracy"))


# Log line shapes.
STAMP = r"\[(\d{4}/\d{2}/\d{2}_\d{2}:\d{2}:\d{2}\.\d{3})\]"
METRIC = r"((?:loss|accuracy)_(?:value|policy|reward)(?:_\d)?):\s(\d+\.\d+)"
SELFPLAY = r"\[(SelfPlay (?:Min|Max|Avg)\. (?:Game )?(?:Lengths|Returns))\]\s(-?\d+(?:\.\d+)?)"


def _stamp(value: Column) -> Column:
    return F.to_timestamp(F.regexp_extract(value, STAMP, 1), "yyyy/MM/dd_HH:mm:ss.SSS")


def read_training_log(spark: SparkSession, path: str, bundles: bool = False) -> DataFrame:
    """Log lines as (line_no, kind, metric, value, ts, iteration).

    The iteration of a line is the number of iteration starts up to it. With `bundles`, a file holds the lines of many
    logs, those of a log in order; `file` then also names the log, and lines are numbered in the bundle.
    """
    from duelgauge.operators import ordered

    v = F.col("value")
    kind = (
        F.when(v.rlike(METRIC), "metric")
        .when(v.rlike(SELFPLAY), "metric")
        .when(v.rlike(r"\[Iteration\] =+\d+=+"), "iteration_start")
        .when(v.contains("[Optimization] Start."), "optimization_start")
        .when(v.contains("[Optimization] Finished."), "optimization_finish")
    )
    numbered = with_whole_file_numbers(numbered_lines(spark, path))
    lines = (unbundled(numbered) if bundles else numbered).withColumn("kind", kind).filter("kind IS NOT NULL")
    named = lines.select(
        "file",
        "line_no",
        "kind",
        F.when(v.rlike(METRIC), F.regexp_extract(v, METRIC, 1)).when(v.rlike(SELFPLAY), F.regexp_extract(v, SELFPLAY, 1)).alias("metric"),
        F.when(v.rlike(METRIC), F.regexp_extract(v, METRIC, 2)).when(v.rlike(SELFPLAY), F.regexp_extract(v, SELFPLAY, 2)).try_cast("double").alias("value"),
        F.when(v.rlike(STAMP), _stamp(v)).alias("ts"),
    )
    started = (F.col("kind") == "iteration_start").cast("bigint")
    return ordered.running_totals(named, ["file"], ["line_no"], F.floor(F.col("line_no") / 65536), {"iteration": started})


def read_match_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of match result files after the header line, with both model steps from the command lines."""
    lines = with_whole_file_numbers(numbered_lines(spark, path))
    v = F.col("value")
    step = lambda side: F.max(F.when(v.contains(f"{side}Command"), F.regexp_extract(v, r"weight_iter_(\d+)", 1).try_cast("bigint")))
    heads = lines.groupBy("file").agg(
        F.min(F.when(v.endswith("ERR_MSG"), F.col("line_no"))).alias("_at"),
        F.coalesce(step("Black"), F.lit(0)).alias("black_step"),
        F.coalesce(step("White"), F.lit(0)).alias("white_step"),
    )
    rows = lines.join(heads, "file").filter(F.col("line_no") > F.col("_at"))
    cell = lambda i: F.get(F.split(v, "\t"), F.lit(i))
    return rows.filter(F.size(F.split(v, "\t")) >= 12).select(
        F.col("black_step").alias("p1"),
        F.col("white_step").alias("p2"),
        cell(1).alias("res_b"),
        cell(4).try_cast("bigint").alias("alt"),
        cell(5).alias("dup"),
        cell(11).alias("err"),
    )


def read_player_records(spark: SparkSession, path: str) -> DataFrame:
    """Player records flattened to the rapid rating and the account flags."""
    rows = spark.read.schema(schemas.PLAYER_RECORD).json(path)
    return rows.select(
        "id",
        F.col("perfs.rapid.rating").alias("rating"),
        F.col("perfs.rapid.prov").alias("prov"),
        F.col("perfs.rapid.games").alias("games"),
        "closed",
        "tosViolation",
    )
