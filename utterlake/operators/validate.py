"""Checks of finished corpora: each gives the rows that break it, and a suite counts them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.text import col
from .blocks import with_blocks

DISJOINT = ["source_id", "source_audio_sha256", "pcm_sha256", "split_group"]


def substring_errors(chunks: DataFrame, texts: DataFrame, key: str = "source_id", start: str = "text_start_char", end: str = "text_end_char", sentence: str = "sentence") -> DataFrame:
    """Chunks whose sentence is not the stretch of their recording's text (key, text) between their character offsets, or that have no recording."""
    whole = texts.select(F.col(key).alias("_key"), F.col("text").alias("_text"))
    stretch = F.substring(F.col("_text"), (F.col(start) + 1).cast("int"), (F.col(end) - F.col(start)).cast("int"))
    return chunks.join(whole, F.col(key) == F.col("_key"), "left").where(F.col("_text").isNull() | ~stretch.eqNullSafe(F.col(sentence))).drop("_key", "_text")


def missing(rows: DataFrame, files: DataFrame, path: str = "audio") -> DataFrame:
    """Rows whose file is not among files (path)."""
    return rows.join(files.select(F.col("path").alias(path)).distinct(), path, "left_anti")


def unmatched(rows: DataFrame, inventory: DataFrame, key: str) -> DataFrame:
    """Distinct keys that the inventory lacks."""
    return rows.select(key).where(F.col(key).isNotNull()).distinct().join(inventory.select(key), key, "left_anti")


def length_errors(chunks: DataFrame, start: str = "start", end: str = "end", slack: float = 1e-6) -> DataFrame:
    """Chunks whose duration is not the length of their stretch."""
    return chunks.where(F.abs(F.col(end) - F.col(start) - F.col("duration")) >= slack)


def prompt_errors(manifest: DataFrame, prompts: DataFrame, order: str = "ordinal", language: str = "Persian") -> DataFrame:
    """Places at which prompts (order, audio, text) are not the labels of the manifest (order, audio, sentence), or one has no row."""
    label = F.concat(F.lit(f"language {language}<asr_text>"), "sentence")
    a = manifest.select(order, F.col("audio").alias("_audio"), label.alias("_label"))
    joined = a.join(prompts.select(order, "audio", "text"), order, "full")
    return joined.where(~F.col("_audio").eqNullSafe(F.col("audio")) | ~F.col("_label").eqNullSafe(F.col("text"))).select(order)


def shared_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Values of keys that stand in more than one split: key, value; one pass for all pairs of splits."""
    each = rows.where(F.col("split").isNotNull()).select("split", F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys])).alias("x"))
    return each.where("x.value is not null").groupBy("x.key", "x.value").agg((F.min("split") != F.max("split")).alias("shared")).where("shared").drop("shared")


def suite(checks: dict[str, DataFrame]) -> DataFrame:
    """check and violations, one row each; a corpus passes if all are zero."""
    counts = None
    for name, broken in checks.items():
        one = broken.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check"), "violations")
        counts = one if counts is None else counts.unionByName(one)
    return counts


def next_in_blocks(rows: DataFrame, by: str, order: str, tie: str, block: float) -> DataFrame:
    """Add next_start: order of the row after each in its group, by order and tie.

    Groups are cut into blocks of order, so that a group of a tenth of all rows is no single sort: inside a block a window tells the next
    row, the last one of a block gets the first of the next block that has any.
    """
    head = {"_head": F.min(order)}
    told = with_blocks(rows, by, order, block, head, {"_after": ("_head", lambda c, w: F.lead(c).over(w))})
    inner = Window.partitionBy(by, "_block").orderBy(order, tie)
    return told.withColumn("next_start", F.coalesce(F.lead(order).over(inner), F.col("_after"))).drop("_block", "_after")


def overlap_violations(rows: DataFrame, by: str, start: str, end: str, tie: str, block: float = 600.0, slack: float = 1e-6) -> DataFrame:
    """Rows that end after the next one of their group begins."""
    return next_in_blocks(rows, by, start, tie, block).where(F.col(end) > F.col("next_start") + slack)


def aligned_lines(texts: DataFrame, chunks: DataFrame, by: str, order: str) -> DataFrame:
    """Texts and audio chunks of the same place; a group's last text has no audio and is left out; problem where the others are not as many.

    texts: by, order, text; chunks: by, order, audio.  Result: by, order, text, audio, problem.
    """
    sizes = texts.groupBy(by).agg((F.count("*") - 1).alias("_texts"), F.max(order).alias("_last")).join(chunks.groupBy(by).agg(F.count("*").alias("_chunks")), by, "full")
    sizes = sizes.fillna(0, ["_texts", "_chunks"]).withColumn("problem", F.when(F.col("_texts") != F.col("_chunks"), F.concat(F.col("_texts").cast("string"), F.lit(" texts, "), F.col("_chunks").cast("string"), F.lit(" chunks"))))
    lines = texts.join(sizes.select(by, "_last"), by).where(F.col(order) < F.col("_last")).drop("_last")
    return lines.join(chunks, [by, order], "full").join(sizes.select(by, "problem"), by)


def conditions_hold(checks: dict[str, Column], rows: DataFrame) -> DataFrame:
    """check and violations for conditions that each row must meet, counted in one pass; null breaks a condition."""
    counts = rows.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(f"c{k}") for k, c in enumerate(checks.values())])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(name).alias("check"), col(f"c{k}").alias("violations")) for k, name in enumerate(checks)])).alias("x")).select("x.*")
