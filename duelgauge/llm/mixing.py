"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target number of words. Within a source a document's expected number of copies is
proportional to its preference (the bit length of its size unless told otherwise) and at most `cap`.
The whole part of that number is certain; for the fraction f, documents are ranked by random odds over
inclusion odds, u/(1-u) : f/(1-f), and the lowest ranks are taken until the source's remaining words
are used up, so the size of the sample is fixed in words and not random.

Defined cases: a null text has size 0 and is taken 0 times; a null source is a source of its own, last
in order; rows with equal doc_id share one random number and are taken or left together (all of them
or none at the cut); a null doc_id counts as one more id; an empty table gives no rows; other columns
are not read. The random number is a hash of doc_id, so reruns and other partitionings agree.

Only per-source tables leave the documents: words by source and size class, words by 1024 rank bands,
and the rows of the one band in which a source's cut falls. No window holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelgauge.llm.common import WORD, key_of
from duelgauge.runtime import cut_lineage

BANDS = 1024
CAP = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def with_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source and size of every document."""
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))


def _class(size: Column) -> Column:
    """Bit length of the size: 0 for empty documents."""
    return F.when(size > 0, F.length(F.bin(size))).otherwise(F.lit(0)).cast("int")


def targets(classes: DataFrame, cap: float = CAP) -> DataFrame:
    """Target words of each source: weight 1, 2, 3, ... by order, at most `cap` times its own words.

    What a full source cannot hold is shared again by weight: with sources ordered by their room per
    unit of weight, the common level of the others is (all - room of the full ones) / weight of the others,
    and the full ones are those whose room per weight lies below it. One row per source throughout.
    """
    sources = classes.groupBy("skey").agg(F.first("source").alias("source"), F.sum("words").alias("source_size"))
    everywhere = Window.partitionBy(F.lit(1))
    order = everywhere.orderBy(F.asc_nulls_last("source"))
    by_room = everywhere.orderBy("room_per_weight", "skey")
    ranked = (
        sources.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("double"))
        .withColumn("room", F.col("source_size") * F.lit(float(cap)))
        .withColumn("room_per_weight", F.col("room") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everywhere).cast("double"))
        .withColumn("before", F.coalesce(F.sum("room").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weights_left", F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level_here", (F.col("total") - F.col("before")) / F.col("weights_left"))
        .withColumn("fits", F.when(F.col("level_here") <= F.col("room_per_weight"), F.struct("room_per_weight", "skey", "level_here")))
        .withColumn("level", F.min("fits").over(everywhere)["level_here"])
    )
    target = F.when(F.col("level").isNull(), F.col("room")).otherwise(F.least("room", F.col("level") * F.col("weight")))
    return ranked.select("skey", "source_size", target.alias("target"))


def expected_copies(classes: DataFrame, sources: DataFrame, cap: float = CAP) -> DataFrame:
    """Expected copies per (source, class): min(cap, c * preference), with c such that the words meet the target."""
    falling = Window.partitionBy("skey").orderBy(F.desc("class"))
    held = (
        classes.filter("class > 0")
        .join(sources, "skey")
        .withColumn("full", F.coalesce(F.sum("words").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * F.lit(float(cap)))
        .withColumn("open", F.sum(F.col("words") * F.col("class")).over(falling.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("c_here", (F.col("target") - F.col("full")) / F.col("open"))
    )
    fits = held.filter(F.col("c_here") * F.col("class") <= cap).groupBy("skey").agg(F.max_by("c_here", "class").alias("c"))
    copies = F.least(F.lit(float(cap)), F.coalesce(F.col("c") * F.col("class"), F.lit(float(cap))))
    return (
        classes.join(sources, "skey")
        .join(fits, "skey", "left")
        .select("skey", "class", "words", "source_size", "target", F.when(F.col("class") > 0, copies).otherwise(F.lit(0.0)).alias("copies"))
    )


def _rank_and_band(share: Column, mean_share: Column) -> tuple[Column, Column]:
    """Pareto rank variable of a row, and its band: a monotone map of the rank that spreads a source evenly."""
    u = (F.conv(F.substring(F.md5(key_of("doc_id")), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52))
    share = F.when(share > 0, share)
    rank = (u / (1 - u)) / (share / (1 - share))
    levelled = rank * mean_share / (1 - mean_share)
    return rank, F.floor(levelled / (1 + levelled) * BANDS).cast("int")


def plan(sizes: DataFrame, cap: float = CAP) -> DataFrame:
    """One row per (source, size class): copies that are certain, the fraction, and the source's cut."""
    keyed = sizes.select("doc_id", "source", key_of("source").alias("skey"), "size", _class(F.col("size")).alias("class"))
    classes = cut_lineage(
        keyed.groupBy("skey", "class").agg(F.first("source").alias("source"), F.sum("size").alias("words"))
    )
    copies = expected_copies(classes, targets(classes, cap), cap)
    of_source = Window.partitionBy("skey")
    shares = (
        copies.withColumn("whole", F.floor("copies").cast("int"))
        .withColumn("share", F.col("copies") - F.floor("copies"))
        .withColumn("left_words", F.col("target") - F.sum(F.col("whole") * F.col("words")).over(of_source))
        .withColumn("mean_share", F.sum(F.col("share") * F.col("words")).over(of_source) / F.sum(F.when(F.col("share") > 0, F.col("words"))).over(of_source))
    )
    shares = cut_lineage(shares)
    rank, band = _rank_and_band(F.col("share"), F.col("mean_share"))
    open_rows = keyed.join(shares.drop("words"), ["skey", "class"]).filter("share > 0")
    ranked = open_rows.withColumns({"rank": rank, "band": band})
    bands = cut_lineage(ranked.groupBy("skey", "band").agg(F.first("left_words").alias("left_words"), F.sum("size").alias("words")))
    rising = Window.partitionBy("skey").orderBy("band")
    first_cut = (
        bands.withColumn("upto", F.sum("words").over(rising))
        .filter("upto > left_words")
        .groupBy("skey")
        .agg(F.min("band").alias("cut_band"), F.min_by(F.col("upto") - F.col("words"), F.col("band")).alias("taken_before"))
    )
    inside = ranked.join(first_cut, (ranked.skey == first_cut.skey) & (F.col("band") == F.col("cut_band"))).drop(first_cut.skey)
    tied = inside.groupBy("skey", "rank", key_of("doc_id").alias("id_key")).agg(
        F.sum("size").alias("words"), F.first("left_words").alias("left_words"), F.first("taken_before").alias("taken_before")
    )
    upto = F.col("taken_before") + F.sum("words").over(Window.partitionBy("skey").orderBy("rank", "id_key"))
    cuts = (
        tied.withColumn("upto", upto)
        .filter(F.col("upto") - F.col("words") / 2 <= F.col("left_words"))
        .groupBy("skey")
        .agg(F.max(F.struct("rank", "id_key")).alias("cut"))
    )
    return cut_lineage(
        shares.select("skey", "class", "source_size", "target", "whole", "share", "mean_share")
        .join(first_cut.select("skey", "cut_band"), "skey", "left")
        .join(cuts, "skey", "left")
    )


def decide(docs: DataFrame, made: DataFrame) -> DataFrame:
    """Adds `mix`: struct of source_size, target and copies. The plan is joined, no row moves by source
    unless the plan is too large for Spark's own broadcast limit. `docs` needs doc_id, source and mix_size."""
    named = made.select(*[F.col(c).alias(f"mix_{c}") for c in made.columns])
    joined = docs.withColumns({"mix_k": key_of("source"), "mix_c": _class(F.col("mix_size"))}).join(
        named, (F.col("mix_k") == F.col("mix_skey")) & (F.col("mix_c") == F.col("mix_class")), "left"
    )
    rank, band = _rank_and_band(F.col("mix_share"), F.col("mix_mean_share"))
    below = band < F.coalesce(F.col("mix_cut_band"), F.lit(BANDS + 1))
    at_cut = (band == F.col("mix_cut_band")) & (F.struct(rank.alias("rank"), key_of("doc_id").alias("id_key")) <= F.col("mix_cut"))
    extra = F.when((F.col("mix_share") > 0) & (below | F.coalesce(at_cut, F.lit(False))), 1).otherwise(0)
    chosen = F.struct(
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_whole") + extra).cast("int").alias("copies"),
    )
    return joined.withColumn("mix", chosen).drop("mix_k", "mix_c", *named.columns)


def mix(docs: DataFrame, cap: float = CAP) -> DataFrame:
    """The mixed corpus: every document as often as the mix takes it, with the columns of `docs`."""
    made = plan(cut_lineage(with_sizes(docs)), cap)
    # The row travels as one struct, so that no column of it can be taken for one of ours.
    sized = docs.select(F.struct("*").alias("mix_row"), "doc_id", "source", word_count(F.col("text")).alias("mix_size"))
    copies = F.array_repeat(F.lit(0), F.col("mix.copies"))
    return decide(sized, made).filter("mix.copies > 0").select("mix_row", F.explode(copies)).select("mix_row.*")


def report(docs: DataFrame, cap: float = CAP) -> DataFrame:
    """Per document: its size, its source's size and target, and the words the mix takes of it."""
    sizes = cut_lineage(with_sizes(docs))
    chosen = decide(sizes.withColumnRenamed("size", "mix_size"), plan(sizes, cap))
    return chosen.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        "source",
        F.col("mix.source_size").alias("source_size"),
        F.col("mix.target").alias("target"),
        (F.col("mix.copies") * F.col("mix_size")).cast("long").alias("taken"),
    )
