"""File-source streams: self-play intake and live progressive prediction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelgauge.functions import rating as R
from duelgauge.operators import progressive as G
from duelgauge.operators.predict import with_prediction
from duelgauge.operators.selfplay import current_model_only, iteration_stats
from duelgauge.runtime import delete_path
from duelgauge.sources.records import NAME_END

RECORD = r"^SelfPlay (true|false) (\d+) (\d+) (-?\d+(?:\.\d+)?) (\S+) #$"


def parse_selfplay(lines: DataFrame) -> DataFrame:
    """Complete self-play messages; a doubled header or a missing end mark drops the message.

    The iteration is the directory a message arrived in, the model step is named in its record.
    """
    part = lambda i: F.regexp_extract("value", RECORD, i)
    whole = lines.filter(F.col("value").rlike(RECORD) & (F.regexp_count("value", F.lit("SelfPlay")) == 1))
    return whole.select(
        "iteration",
        (part(1) == "true").alias("is_terminal"),
        part(2).cast("bigint").alias("data_length"),
        part(3).cast("bigint").alias("game_length"),
        part(4).cast("double").alias("ret"),
        F.regexp_extract(part(5), r"weight_iter_(\d+)", 1).try_cast("bigint").alias("model_step"),
        part(5).alias("record"),
    )


COMPACT_EVERY = 16


def _folders(spark: SparkSession, out: str) -> list[tuple[str, int]]:
    """(kind, number) of the folders in use: the newest base and the batches after it."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    found = sorted((k, int(n)) for k, n in (x.split("=") for x in names if "=" in x))
    base = max((n for k, n in found if k == "base"), default=-1)
    return [(k, n) for k, n in found if (k == "base" and n == base) or (k == "batch" and n > base)]


def _newest(spark: SparkSession, out: str, keys: tuple[str, ...]) -> DataFrame:
    rows = spark.read.parquet(*[f"{out}/{k}={n}" for k, n in _folders(spark, out)])
    values = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("v")).select(*keys, "v.*")


def _run_updates(
    changed: DataFrame, out: str, checkpoint: str, keys: tuple[str, ...], enrich=lambda rows: rows, partitions: int | None = None
) -> None:
    """Run all available input; every batch's changed rows are enriched and written inside the batch.

    Every batch loads and stores each partition of the state, full or not, so keys that are few want few `partitions`
    (None: as many as the session shuffles into). A restart keeps the number of the checkpoint.

    Every COMPACT_EVERY batches the newest row per key becomes the base and older folders go, so what
    is kept is bounded by the keys and a few batches. Repeating a batch overwrites its own folder.
    """
    spark = changed.sparkSession

    def save(batch: DataFrame, number: int) -> None:
        enrich(batch).withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")
        if number % COMPACT_EVERY == COMPACT_EVERY - 1:
            old = _folders(spark, out)
            _newest(spark, out, keys).write.mode("overwrite").parquet(f"{out}/base={number}")
            for kind, n in old:
                if (kind, n) != ("base", number):
                    delete_path(spark, f"{out}/{kind}={n}")

    writer = (
        changed.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(save)
    )
    width = "spark.sql.shuffle.partitions"
    session = spark.conf.get(width)
    try:
        spark.conf.set(width, str(partitions or session))
        query = writer.start()  # takes its own copy of the settings
    finally:
        spark.conf.set(width, session)
    query.awaitTermination()


def latest(spark: SparkSession, out: str, *keys: str) -> DataFrame:
    """Newest version of every key."""
    return _newest(spark, out, keys).drop("_batch")


def selfplay_intake(spark: SparkSession, source: str, out: str, checkpoint: str, files_per_batch: int = 1000) -> DataFrame:
    """Keep per-iteration statistics current while messages arrive as files under iteration=N/.

    Files outside such folders are bundles of messages, each named by the folder it arrived in.
    """
    arrived = (
        spark.readStream.option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch)
        .text(source)
        .select("value", F.col("_metadata.file_path").alias("file"))
    )
    own = r"iteration=(\d+)/"
    bundled = ~F.col("file").rlike(own) & F.contains("value", F.lit(NAME_END))
    iteration = lambda text: F.regexp_extract(text, own, 1)
    named = F.substring_index("value", NAME_END, 1)
    lines = arrived.select(
        F.when(bundled, F.substr("value", F.length(named) + 2)).otherwise(F.col("value")).alias("value"),
        F.when(bundled, iteration(named)).otherwise(iteration("file")).cast("bigint").alias("iteration"),
    )
    stats = iteration_stats(current_model_only(parse_selfplay(lines)))
    # One small row per iteration: one partition of the state per task slot, no more than the session has.
    slots = min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    _run_updates(stats, out, checkpoint, ("iteration",), partitions=slots)
    return latest(spark, out, "iteration")


def live_predictions(
    spark: SparkSession,
    source: str,
    schema,
    examples: DataFrame,
    out: str,
    checkpoint: str,
    files_per_batch: int = 1000,
) -> DataFrame:
    """Blend arriving move scores with each game's context. Only moves seen so far count.

    Every batch emits the predictions of the games that it changed.
    """
    moves = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    mine = lambda c, v: F.sum(F.when(F.col("color") == c, v).otherwise(F.lit(0)))
    seen = moves.groupBy("game_id").agg(
        mine("white", F.col("score")).alias("ws"),
        mine("white", F.lit(1)).alias("white_seen"),
        mine("black", F.col("score")).alias("bs"),
        mine("black", F.lit(1)).alias("black_seen"),
    )

    def predict(changed: DataFrame) -> DataFrame:
        state = changed.join(examples, "game_id")
        for side, total in (("white", "ws"), ("black", "bs")):
            held = F.col(f"{side}_context_games") * G.CONTEXT_MOVES
            live = F.col(f"{side}_seen") * G.LIVE_WEIGHT
            blended = (held * F.col(f"{side}_context_strength") + G.LIVE_WEIGHT * F.col(total)) / (held + live)
            state = state.withColumn(f"{side}_estimated_elo", R.score_to_elo(blended))
        rated = with_prediction(state, R.elo_to_probs(F.col("white_estimated_elo"), F.col("black_estimated_elo")))
        return rated.withColumn("observed_plies", F.col("white_seen") + F.col("black_seen"))

    _run_updates(seen, out, checkpoint, ("game_id",), predict)
    return latest(spark, out, "game_id")
