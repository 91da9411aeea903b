"""Corpora into one form: rows by source, materialised audio with reasons, volume compositions and the final export."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import bucket_split
from ..functions.text import col, padded_id, squeeze, stem
from ..plans.lineage import written
from ..sources.readers import recording_of, speaker_of
from .corpus import COMPOSITIONS, union
from .dedup import keep_first, remove_leakage
from .filters import first_reason, human_verified
from .graph import components
from .splits import first_share, strata_split


@dataclass(frozen=True)
class Source:
    """What differs between corpora: language, bounds in seconds, and whether their own split stands or one by hash."""

    language: str
    least: float
    most: float
    own_split: bool


# The corpora.
SOURCES = {
    "elderly": Source("Persian", 0.25, 30, True),
    "ganjoor": Source("Persian", 2, 20, False),
    "filimo": Source("Persian", 2, 20, False),
    "mozilla": Source("Persian", 2, 20, True),
    "seniortalk": Source("Chinese", 0.25, 30, True),
}


def or_unknown(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown"))


def source_rows(raw: DataFrame, source: str, split_map: DataFrame | None = None) -> DataFrame:
    """Rows of one corpus in the uniform form: id, source, source_id, speaker_id, language, text, split, human_verified, original_audio, least, most.

    raw: audio (path), text, and where the corpus has them source_id, speaker_id, split and ordinal.  split_map (audio, split, ordinal)
    gives elderly clips their split by the stem of the file; of equal stems the last one counts, and clips it doesn't name are out.
    """
    kind = SOURCES[source]
    name = stem("audio")
    have = lambda c: F.col(c) if c in raw.columns else F.lit(None).cast("string")
    group = F.concat(F.lit("elderly:"), "source_id") if source == "elderly" else recording_of(source, F.col("audio"))
    speaker = {
        "elderly": or_unknown(have("speaker_id")), "ganjoor": or_unknown(squeeze(have("speaker_id"))), "filimo": F.lit("unknown"),
        "mozilla": or_unknown(have("speaker_id")), "seniortalk": speaker_of(F.col("audio")),
    }[source]
    ident = padded_id(F.lit("ganjoor"), "ordinal", 6, "_") if source == "ganjoor" else F.concat(F.lit(f"{source}_"), name)
    rows = raw.select(
        ident.alias("id"), F.lit(source).alias("source"), group.alias("source_id"), speaker.alias("speaker_id"), F.lit(kind.language).alias("language"), "text",
        have("split").alias("split"), F.col("audio").alias("original_audio"), F.lit(float(kind.least)).alias("least"), F.lit(float(kind.most)).alias("most"), name.alias("_stem"),
    )
    if not kind.own_split:
        rows = rows.withColumn("split", bucket_split("source_id"))
    if source == "elderly" and split_map is not None:
        last = split_map.groupBy(stem("audio").alias("_stem")).agg(F.max_by("split", "ordinal").alias("_split"))
        rows = rows.join(last, "_stem").withColumn("split", F.col("_split")).drop("_split")
    verified = human_verified("speaker_id") if source == "elderly" else F.lit(False)
    return rows.withColumn("human_verified", verified).drop("_stem")


def materialize(rows: DataFrame, known: DataFrame | None = None, rate: int = 16_000) -> tuple[DataFrame, DataFrame]:
    """Rows whose decoded audio is good, with duration and pcm_sha256; and the others with the first reason.

    rows: id, text, source, pcm (16-bit samples, null where they could not be decoded), least and most seconds.  Reasons in order: decode,
    duration, empty_text, silent_audio, id_collision: the id has other content in known (id, pcm_sha256), or in a row before it by
    digest.  Of rows with the same id and content one stays.
    """
    digest = F.sha2("pcm", 256)
    # Silent: nothing is left once zero bytes are trimmed.
    silent = F.length(F.regexp_replace(F.hex("pcm"), "^(00)+$", "")) == 0
    flagged = first_reason(rows.withColumns({"duration": F.octet_length("pcm") / F.lit(2.0 * rate), "pcm_sha256": digest}), F.col("least"), F.col("most"), F.col("pcm").isNull(), silent)
    first = flagged.where("reason is null").groupBy("id").agg(F.min("pcm_sha256").alias("_own"))
    if known is not None:
        before = known.groupBy("id").agg(F.min("pcm_sha256").alias("_known"))
        first = first.join(before, "id", "left").select("id", F.coalesce("_known", "_own").alias("_own"))
    told = flagged.join(first.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left").withColumn(
        "reason", F.coalesce("reason", F.when(F.col("pcm_sha256") != F.col("_own"), "id_collision"))
    )
    good = told.where("reason is null").drop("reason", "_own", "_id", "least", "most").dropDuplicates(["id", "pcm_sha256"])
    return good, told.where("reason is not null").select("id", "reason", "source")


def volume_composition(rows: DataFrame, share: float) -> DataFrame:
    """The public corpus with the first share of elderly training rows in hash order and all elderly validation and test rows, after leakage removal."""
    public = rows.where(F.col("source").isin(COMPOSITIONS["public"]))
    elderly = rows.where("source = 'elderly'")
    ids = elderly.where("split = 'train'").select("id").distinct().withColumn("_k", F.concat(F.lit("volume42"), "id"))
    chosen = first_share(ids, "_k", share, None).select("id")
    part = elderly.where("split = 'train'").join(chosen, "id", "left_semi")
    return remove_leakage(union([public, part, elderly.where("split <> 'train'")]))[0]


def final_export(rows: DataFrame, recordings: DataFrame) -> DataFrame:
    """Rows with split, split_group and reasons of the final corpus: accepted ones have a split, the others their reasons.

    rows: ordinal, source_id, speaker_id, pcm_sha256, reasons (array).  Accepted rows of repeated content after the first get the reason duplicate_pcm.
    Recordings (source_id, audio_sha256, text_sha256) that share a digest are one group; groups are split by rank in the strata of the sorted
    speakers of their accepted rows.
    """
    accepted = keep_first(rows.where(F.size("reasons") == 0).withColumn("split", F.lit("train")), "pcm_sha256", "ordinal").drop("split")
    repeated = accepted.where("not kept").drop("kept").withColumn("reasons", F.array(F.lit("duplicate_pcm")))
    accepted = accepted.where("kept").drop("kept")
    keys = F.explode(F.array(F.concat(F.lit("audio:"), "audio_sha256"), F.concat(F.lit("text:"), "text_sha256"))).alias("key")
    tied = components(recordings.select(F.col("source_id").alias("node"), keys)).select(F.col("node").alias("_node"), "component")
    grouped = written(accepted.join(tied, F.col("source_id") == F.col("_node"), "left").withColumn("split_group", F.coalesce("component", "source_id")).drop("_node", "component"))
    strata = grouped.groupBy("split_group").agg(F.array_join(F.array_sort(F.collect_set(F.coalesce("speaker_id", F.lit("None")))), "|").alias("speakers"))
    chosen = strata_split(strata, "split_group", "speakers").select("split_group", "split")
    others = union([repeated, rows.where(F.size("reasons") > 0)]).withColumns({"split_group": F.lit(None).cast("string"), "split": F.lit(None).cast("string")})
    return grouped.join(chosen, "split_group").unionByName(others)


def two_tier_pairs(audio: DataFrame, texts: DataFrame) -> DataFrame:
    """Audio files with their text: the one of the same path but suffix, else the one of the same pair key; problem where that is not exactly one.

    audio, texts: path.  Result: audio, text, problem.
    """
    from ..functions.text import pair_key

    bare = lambda c: F.regexp_replace(col(c), r"\.[^./]*$", "")
    same = texts.where(F.col("path").endswith(".txt")).select(bare("path").alias("_bare"), F.col("path").alias("_same")).distinct()
    by_key = texts.groupBy(pair_key(stem("path")).alias("_key")).agg(F.countDistinct("path").alias("_n"), F.min("path").alias("_text"))
    rows = audio.select(F.col("path").alias("audio")).distinct().withColumns({"_bare": bare("audio"), "_key": pair_key(stem("audio"))})
    joined = rows.join(same, "_bare", "left").join(by_key, "_key", "left")
    n = F.when(F.col("_same").isNotNull(), 1).otherwise(F.coalesce("_n", F.lit(0)))
    return joined.select(
        "audio", F.when(n == 1, F.coalesce("_same", "_text")).alias("text"), F.when(n != 1, F.concat(n.cast("string"), F.lit(" matching texts"))).alias("problem")
    )


def first_existing(rows: DataFrame, files: DataFrame, candidates: dict[str, Column], name: str = "audio") -> DataFrame:
    """Rows with name set to the first of the candidate paths that is among files (path), else to the first candidate."""
    out, found = rows, []
    for k, (label, path) in enumerate(candidates.items()):
        here = files.select(F.col("path").alias(f"_{label}")).distinct()
        out = out.withColumn(f"_p{k}", path).join(here, F.col(f"_p{k}") == F.col(f"_{label}"), "left")
        found.append(f"_{label}")
    drop = [*found, *[f"_p{k}" for k in range(len(found))]]
    return out.withColumn(name, F.coalesce(*found, "_p0")).drop(*drop)
