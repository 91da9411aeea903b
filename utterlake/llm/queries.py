"""Queries of the operators for training data over the project's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import not_blank
from .group_split import assign_splits, torn_groups
from .leakage import leaked, paraphrased
from .mixing import mix, mix_shares
from .overlap import overlap_classes, overlap_counts, split_overlap
from .packing import containers
from .page_quality import list_pages
from .pieces import take_pieces
from .visual_form import visual_form

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return take_pieces(table(spark, folder, "takes")).where("pieces > 1").select("take_id").distinct()


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return take_pieces(table(spark, folder, "takes"))


def p1_cover(spark: SparkSession, folder: str) -> DataFrame:
    """What the pieces of each take are together."""
    pieces = take_pieces(table(spark, folder, "takes"))
    return pieces.groupBy("take_id").agg(
        F.min("start_sample").alias("first_sample"), F.max("end_sample").alias("last_sample"), F.max(F.col("end_sample") - F.col("start_sample") > 16 * 16_000).alias("too_long"),
        (F.sum(F.col("end_sample") - F.col("start_sample")) - (F.max("end_sample") + 8_000 * (F.count("*") - 1))).alias("beside_overlap"), (F.count("*") == F.max("pieces")).alias("numbered"),
    )


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaked(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p2_paraphrases(spark: SparkSession, folder: str) -> DataFrame:
    found = paraphrased(table(spark, folder, "documents"), table(spark, folder, "eval_items"))
    return found.withColumns({c: F.round(c, 4) for c in ("words", "answer")})


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = split_overlap(table(spark, folder, "utterances"))
    return pairs.select(F.least("train_id", "eval_id").alias("id_a"), F.greatest("train_id", "eval_id").alias("id_b")).distinct()


def p3_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "utterances")
    return overlap_counts(split_overlap(rows), rows)


def p3_classes(spark: SparkSession, folder: str) -> DataFrame:
    return overlap_classes(table(spark, folder, "utterances")).withColumn("coverage", F.round("coverage", 6))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "utterances").select("id", "text", "sentence").where(not_blank("text") & not_blank("sentence") & (F.col("text") != F.col("sentence")))
    forms = rows.select("id", visual_form("text").alias("a"), visual_form("sentence").alias("b"))
    return forms.where("a = b and a <> ''").select("id").distinct()


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return torn_groups(table(spark, folder, "utterances"), table(spark, folder, "recordings")).select("source_id").distinct()


def p5_splits(spark: SparkSession, folder: str) -> DataFrame:
    return assign_splits(table(spark, folder, "utterances"), table(spark, folder, "recordings"))


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    return containers(table(spark, folder, "documents"))


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    targets = table(spark, folder, "mix_targets")
    return mix_shares(mix(table(spark, folder, "documents"), targets), targets)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return list_pages(table(spark, folder, "documents")).select("doc_id").distinct()


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_pieces, p1_cover, p2_found, p2_paraphrases, p3_found, p3_classes, p3_counts, p4_found, p5_found, p5_splits, p6_containers, p7_mix, p7_shares, p8_found)}


def oracle_sql() -> dict[str, str]:
    """SQL where it can say the same over whole tables."""
    return {
        "p1_found": """
            SELECT take_id FROM (
                SELECT take_id, greatest(CASE WHEN duration > 0 AND NOT isnan(duration) THEN duration END, list_max(list_transform(regions, lambda r: r.end_sample)) / 16000.0) AS seconds FROM takes
            ) WHERE take_id IS NOT NULL GROUP BY take_id HAVING max(seconds) > 16
        """,
        "p1_cover": """
            SELECT take_id, CAST(0 AS BIGINT) AS first_sample, max(size) AS last_sample, false AS too_long, CAST(0 AS BIGINT) AS beside_overlap, true AS numbered FROM (
                SELECT take_id, greatest(CASE WHEN duration > 0 AND NOT isnan(duration) THEN CAST(ceil(duration * 16000) AS BIGINT) END, list_max(list_filter(list_transform(regions, lambda r: r.end_sample), lambda x: x > 0))) AS size FROM takes
            ) WHERE take_id IS NOT NULL AND size IS NOT NULL GROUP BY take_id
        """,
    }
