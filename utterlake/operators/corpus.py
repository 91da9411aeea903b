"""Corpora as unions of sources, increments, vocabularies and completeness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import col

# Named compositions of sources.
COMPOSITIONS = {
    "public": ["mozilla", "filimo", "ganjoor"],
    "public_without_ganjoor": ["mozilla", "filimo"],
    "public_elderly": ["mozilla", "filimo", "ganjoor", "elderly"],
    "public_senior": ["mozilla", "filimo", "ganjoor", "seniortalk"],
    "public_elderly_senior": ["mozilla", "filimo", "ganjoor", "elderly", "seniortalk"],
}


def union(parts: list[DataFrame]) -> DataFrame:
    """All rows of all parts; columns a part lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def compose(rows: DataFrame, name: str) -> DataFrame:
    """The rows of a composition's sources: one filter that reaches the scan, no union of re-reads."""
    return rows.where(F.col("source").isin(COMPOSITIONS[name]))


def readiness(rows: DataFrame) -> DataFrame:
    """Each composition with its sources, those that have no rows, and whether it is ready."""
    spark = rows.sparkSession
    wanted = spark.createDataFrame([(n, s) for n, members in COMPOSITIONS.items() for s in members], "composition string, source string")
    have = rows.select("source").distinct().withColumn("there", F.lit(True))
    return wanted.join(have, "source", "left").groupBy("composition").agg(
        F.count("*").alias("sources"), F.array_sort(F.collect_list(F.when(F.col("there").isNull(), F.col("source")))).alias("missing")
    ).withColumn("ready", F.size("missing") == 0)


def checked_merge(base: DataFrame, increment: DataFrame, key: str) -> DataFrame:
    """Base and the increment; other columns, or a key that both have, stop it, with the first ten of them."""
    if base.columns != increment.columns:
        raise ValueError(f"columns differ: {sorted(set(base.columns) ^ set(increment.columns)) or 'in their order'}")
    if both := increment_conflicts(base, increment, key).orderBy(key).limit(10).collect():
        raise ValueError(f"keys in both: {[r[0] for r in both]}")
    return base.unionByName(increment)


def merge_increment(base: DataFrame, increment: DataFrame, key: str) -> DataFrame:
    """Base and the rows of the increment whose key is new."""
    return base.unionByName(increment.join(base.select(key), key, "left_anti"), allowMissingColumns=True)


def increment_conflicts(base: DataFrame, increment: DataFrame, key: str) -> DataFrame:
    """Keys that are in both."""
    return increment.select(key).intersect(base.select(key))


def vocabulary(texts: DataFrame, text: str, *by: str) -> DataFrame:
    """Distinct characters with a number from 0 in code point order, by group; groups are small: a script's characters."""
    from pyspark.sql import Window

    chars = texts.select(*by, F.explode(F.array_distinct(F.split(col(text), ""))).alias("character")).where("character <> ''").distinct()
    order = Window.partitionBy(*by).orderBy("character") if by else Window.orderBy("character")
    return chars.withColumn("number", (F.row_number().over(order) - 1).cast("bigint"))


def ctc_vocabulary(texts: DataFrame, text: str) -> DataFrame:
    """The characters of texts with their number in code point order, a bar in the place of the blank, then the marks of unknown and padding."""
    known = vocabulary(texts, text).select(F.when(F.col("character") == " ", "|").otherwise(F.col("character")).alias("character"), "number")
    n = known.agg(F.count("*").alias("n"))
    # The special tokens.
    marks = n.select(F.posexplode(F.array(F.lit("[UNK]"), F.lit("[PAD]"))).alias("k", "character"), "n").select("character", (F.col("n") + F.col("k")).alias("number"))
    return known.unionByName(marks)


def composition_audit(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Each composition with its sources without rows, values of keys in more than one split, and status: missing_data, failed or passed."""
    spark = rows.sparkSession
    wanted = spark.createDataFrame([(n, s) for n, members in COMPOSITIONS.items() for s in members], "composition string, source string")
    member = rows.join(F.broadcast(wanted), "source")
    each = member.select("composition", "split", F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys])).alias("x")).where("x.value is not null")
    leaks = each.groupBy("composition", "x.key", "x.value").agg((F.min("split") != F.max("split")).alias("torn")).groupBy("composition").agg(F.count_if("torn").alias("leaks"))
    ready = readiness(rows).select("composition", F.size("missing").cast("bigint").alias("missing"))
    status = F.when(F.col("missing") > 0, "missing_data").when(F.col("leaks") > 0, "failed").otherwise("passed")
    return ready.join(leaks, "composition", "left").select("composition", "missing", F.coalesce("leaks", F.lit(0)).alias("leaks"), status.alias("status"))


def joined_text(chunks: DataFrame, by: str, order: str, text: str) -> DataFrame:
    """The texts of each recording in order, joined by blanks; a chunk without text is an empty one."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(text, F.lit("")).alias("t"))))
    return chunks.groupBy(by).agg(F.array_join(F.transform(parts, lambda x: x["t"]), " ").alias("joined"))


def incomplete(chunks: DataFrame, whole: DataFrame, by: str, order: str, text: str, full: str) -> DataFrame:
    """Recordings whose chunks together are not the full transcript, blanks aside."""
    from ..functions.text import squeeze

    joined = joined_text(chunks, by, order, text).join(whole.select(by, full), by)
    return joined.where(~squeeze(F.col("joined")).eqNullSafe(squeeze(F.col(full)))).select(by)


def zipped(left: DataFrame, right: DataFrame, by: str, order: str) -> DataFrame:
    """Rows of the same place in either table."""
    return left.join(right, [by, order])


def project_training(rows: DataFrame) -> DataFrame:
    """The five training columns with their defaults; a missing audio or text is an error."""
    must = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{c} must be a string"))).otherwise(F.col(c))
    filled = lambda c, default: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default))
    have = rows if "prompt" in rows.columns else rows.withColumn("prompt", F.lit(""))
    return have.select(must("audio").alias("audio"), must("text").alias("text"), filled("language", "Persian").alias("language"), filled("prompt", "").alias("prompt"), F.coalesce("duration", F.lit(0.0)).alias("duration"))


def status_histogram(jobs: DataFrame, status: str, domain: list[str]) -> DataFrame:
    """Counts of a fixed set of states, zero where there is none."""
    counts = jobs.agg(*[F.count_if(F.col(status) == s).alias(f"c{k}") for k, s in enumerate(domain)])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(s).alias("status"), F.col(f"c{k}").alias("jobs")) for k, s in enumerate(domain)])).alias("x")).select("x.*")


def runnable(jobs: DataFrame) -> DataFrame:
    """Pending jobs all of whose dependencies are complete, by priority and id."""
    needs = jobs.where("status = 'pending'").select("id", F.explode("dependencies").alias("needs"))
    open_ = needs.join(jobs.where("status = 'complete'").select(F.col("id").alias("needs")), "needs", "left_anti").select("id").distinct()
    return jobs.where("status = 'pending'").join(open_, "id", "left_anti").orderBy("priority", "id")


def pair_files(audio: DataFrame, text: DataFrame, key: str) -> DataFrame:
    """Audio and text files of one key, and problem where there is not exactly one of each."""
    a = audio.groupBy(key).agg(F.count("*").alias("audios"), F.min("path").alias("audio"))
    t = text.groupBy(key).agg(F.count("*").alias("texts"), F.min("path").alias("text"))
    both = a.join(t, key, "full").fillna(0, ["audios", "texts"])
    return both.withColumn("problem", F.when(F.col("audios") != 1, "audio files").when(F.col("texts") != 1, "text files"))


def cache_hits(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Requests, distinct keys and requests answered from the cache."""
    n = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    return n.agg(F.sum("n").alias("requests"), F.count("*").alias("predicted"), (F.sum("n") - F.count("*")).alias("reused"))


def noise_plan(rows: DataFrame, key: str, conditions: list[str], backgrounds: int, rooms: int, seed: str = "42") -> DataFrame:
    """Each row under each noise condition with its seed, the signal-to-noise ratio, and the numbers of its background and room where the condition has one."""
    each = rows.select(key, F.explode(F.array(*[F.lit(c) for c in conditions])).alias("condition"))
    digest = F.sha2(F.concat_ws(":", F.col(key), F.col("condition"), F.lit(seed)), 256)
    noisy = F.col("condition").startswith("snr") | (F.col("condition") == "combined")
    ratio = F.when(F.col("condition").startswith("snr"), F.substring("condition", 4, 9).try_cast("int")).when(F.col("condition") == "combined", 10)
    return each.withColumn("seed", F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")).withColumns({
        "snr": ratio, "background": F.when(noisy, F.col("seed") % backgrounds), "room": F.when(F.col("condition").isin("rir", "combined"), F.col("seed") % rooms)
    })


def noise_audit(originals: DataFrame, noisy: DataFrame, key: str, fields: list[str], conditions: list[str]) -> DataFrame:
    """Per condition its rows, originals without one, rows without or with more than one original, and rows whose fields differ from their original's."""
    each = originals.select(key, F.struct(*fields).alias("_a"), F.explode(F.array(*[F.lit(c) for c in conditions])).alias("condition"))
    n = noisy.groupBy(key, "condition").agg(F.count("*").alias("_n"), F.min(F.struct(*fields)).alias("_b"), F.max(F.struct(*fields)).alias("_c"))
    joined = each.join(n, [key, "condition"], "full")
    return joined.groupBy("condition").agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("samples"), F.count_if(F.col("_b").isNull()).alias("missing"), F.count_if(F.col("_a").isNull() | (F.col("_n") > 1)).alias("unknown"),
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull() & (~F.col("_a").eqNullSafe(F.col("_b")) | ~F.col("_a").eqNullSafe(F.col("_c")))).alias("changed"),
    )

def equal_sets(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Counts of a full comparison: keys on one side only, and keys whose fields differ."""
    a = left.select(key, F.struct(*fields).alias("_a"))
    b = right.select(key, F.struct(*fields).alias("_b"))
    j = a.join(b, key, "full")
    return j.agg(F.count_if(F.col("_b").isNull()).alias("left_only"), F.count_if(F.col("_a").isNull()).alias("right_only"), F.count_if(F.col("_a") != F.col("_b")).alias("differ"))
