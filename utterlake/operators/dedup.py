"""Promotion of recordings to one split, content duplicates, and leak checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.text import col, prompt

# Splits by precedence.
PRIORITY = {"train": 0, "validation": 1, "test": 2}


def priority(split: Column | str) -> Column:
    c = col(split)
    return F.when(c == "test", 2).when(c == "validation", 1).otherwise(0)


def promote(rows: DataFrame, group: str = "source_id") -> DataFrame:
    """Every row gets the highest split of its recording; original_split keeps the first one it had."""
    first = F.coalesce("original_split", "split") if "original_split" in rows.columns else F.col("split")
    # Recordings are few beside rows; a hot recording is pre-aggregated before the join instead of one window task.
    top = rows.groupBy(group).agg(F.max(priority("split")).alias("_top"))
    named = F.element_at(F.array(*[F.lit(s) for s in PRIORITY]), F.col("_top") + 1)
    joined = rows.withColumn("original_split", first).join(top.withColumnRenamed(group, "_group"), rows[group].eqNullSafe(F.col("_group")))
    return joined.withColumn("split", named).drop("_group", "_top")


def keep_first(rows: DataFrame, key: str = "pcm_sha256", order: str = "ordinal") -> DataFrame:
    """Add kept: true for the first row of each content key by split precedence, then order, and for rows without a key.

    The first row of a key is found by a partial aggregate, so that a key of many rows is no large group.
    """
    first = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(-priority("split"), F.col(order))).alias("_first"))
    first = first.select(F.col(key).alias("_key"), F.col("_first")[order].alias("_order"))
    return rows.join(first, rows[key] == F.col("_key"), "left").withColumn("kept", F.col(key).isNull() | (F.col(order) == F.col("_order"))).drop("_key", "_order")


def remove_leakage(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows after promotion and content deduplication, and the removed rows with their reason."""
    flagged = keep_first(promote(rows))
    removed = flagged.where("not kept").select("id", F.lit("duplicate canonical PCM audio").alias("reason"), "split")
    return flagged.where("kept").drop("kept"), removed


def split_stats(rows: DataFrame) -> DataFrame:
    """Samples, hours and recordings of each split."""
    return rows.groupBy("split").agg(F.count("*").alias("samples"), (F.sum("duration") / 3600).alias("hours"), F.countDistinct("source_id").alias("source_recordings"))


def publish(rows: DataFrame) -> DataFrame:
    """split_stats after remove_leakage; it fails if a split is empty."""
    stats = split_stats(remove_leakage(rows)[0])
    return stats.withColumn("samples", F.when(F.size(F.collect_set("split").over(Window.partitionBy(F.lit(1)))) == len(PRIORITY), F.col("samples")).otherwise(F.raise_error(F.lit("a split is empty"))))


def with_prompts(rows: DataFrame) -> DataFrame:
    """Rows whose text is the label of a speech model."""
    return rows.withColumn("text", prompt("language", "text"))


def leak_pairs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """For each key column and pair of splits the number of values in both: key, split_a, split_b, shared."""
    found = None
    for key in keys:
        sides = rows.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.bool_or(F.col("split") == s).alias(s) for s in PRIORITY])
        pairs = [("train", "validation"), ("train", "test"), ("validation", "test")]
        counts = sides.agg(*[F.count_if(F.col(a) & F.col(b)).alias(f"{a}_{b}") for a, b in pairs])
        one = counts.select(F.explode(F.array(*[F.struct(F.lit(key).alias("key"), F.lit(a).alias("split_a"), F.lit(b).alias("split_b"), F.col(f"{a}_{b}").alias("shared")) for a, b in pairs])).alias("x")).select("x.*")
        found = one if found is None else found.unionByName(one)
    return found


def leaked_keys(rows: DataFrame, key: str) -> DataFrame:
    """Values of a key that occur in more than one split, with the number of splits."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.countDistinct("split").alias("splits")).where("splits > 1")


def duplicate_keys(rows: DataFrame, key: str) -> DataFrame:
    """Values that occur more than once, with their count."""
    return rows.groupBy(key).agg(F.count("*").alias("times")).where("times > 1")
