"""Filters that record their reasons, review updates and feasibility checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, normalize_eval, squeeze, standardize

# Answers that approve a review.
APPROVED = ["1", "true", "yes", "y", "بله", "تایید", "تأیید"]
VERIFIED_SPEAKERS = ["speaker_1", "1"]
# Kernel and stride of the acoustic front end's layers.
CONVOLUTIONS = [(10, 5), (3, 2), (3, 2), (3, 2), (3, 2), (2, 2), (2, 2)]


def blank(c: Column | str) -> Column:
    return F.coalesce(squeeze(col(c)), F.lit("")) == ""


def first_reason(rows: DataFrame, least: float | Column, most: float | Column, undecoded: Column | None = None, silent: Column | None = None, collides: Column | None = None) -> DataFrame:
    """Add reason: the first of decode error, duration, empty text, silent audio and id collision that holds, else null."""
    within = F.coalesce(F.col("duration").between(least, most), F.lit(False))
    checks = [(undecoded, "decode"), (~within, "duration"), (blank("text"), "empty_text"), (silent, "silent_audio"), (collides, "id_collision")]
    return rows.withColumn("reason", F.coalesce(*[F.when(c, F.lit(name)) for c, name in checks if c is not None]))


def reasons_of(checks: dict[str, Column]) -> Column:
    """Names of the checks that hold, in order."""
    return F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in checks.items()]), lambda x: x.isNotNull())


def all_reasons(rows: DataFrame, least: float = 1, most: float = 16, most_cer: float = 0.45, unsupported: Column | None = None, silent: Column | None = None, compose: bool = True) -> DataFrame:
    """Add reasons: every failing check of the final corpus, in order (duration, nothing left of the text in evaluation form, characters the aligner lacks, error rate, silence).

    unsupported and silent are conditions on the rows, where they can be told; compose as of normalize_eval().
    """
    # The names of the reasons.
    checks = {
        "duration_outside_1_16_seconds": ~F.coalesce(F.col("duration").between(least, most), F.lit(False)),
        "empty_normalized_text": F.coalesce(normalize_eval("text", compose), F.lit("")) == "",
        "unsupported_alignment_character": unsupported,
        "alignment_cer_above_0.45": F.col("alignment_cer") > most_cer,
        "silent_audio": silent,
    }
    return rows.withColumn("reasons", reasons_of({k: c for k, c in checks.items() if c is not None}))


def quality_gate(rows: DataFrame, least: float = 1, most: float = 20, most_wer: float = 0.55, include_review: bool = False) -> DataFrame:
    """Add reasons of the data set builder: verified rows skip the score and review checks; a null score fails."""
    open_ = ~F.coalesce("human_verified", F.lit(False))
    return rows.withColumn("reasons", reasons_of({
        "duration": ~F.coalesce(F.col("duration").between(least, most), F.lit(False)),
        "alignment_wer": open_ & (F.col("alignment_wer").isNull() | (F.col("alignment_wer") > most_wer)),
        "needs_review": open_ & F.coalesce("needs_review", F.lit(False)) & F.lit(not include_review),
        "empty_text": blank("sentence"),
    }))


def needs_review(target: Column, score: Column, most: float = 0.55) -> Column:
    """True where there is no text or no score, or the score is above most."""
    return blank(target) | score.isNull() | F.coalesce(score > most, F.lit(True))


def teacher_filter(rows: DataFrame, wer: str, below: float = 0.2) -> DataFrame:
    """Add accepted; rows of both kinds stay."""
    return rows.withColumn("accepted", F.coalesce(F.col(wer) < below, F.lit(False)))


def human_verified(speaker: Column | str) -> Column:
    return F.coalesce(F.lower(F.trim(col(speaker))).isin(VERIFIED_SPEAKERS), F.lit(False))


def approved(answer: Column | str) -> Column:
    return F.coalesce(F.lower(squeeze(col(answer))).isin(APPROVED), F.lit(False))


def apply_reviews(rows: DataFrame, reviews: DataFrame, order: str = "reviewed_at") -> DataFrame:
    """Rows with the last approved review of their chunk_id: its sentence, human_verified and not needs_review.

    reviews: chunk_id, sentence, approved and order; of equal order the greater sentence counts.
    """
    last = reviews.where(approved("approved")).select(squeeze(F.col("chunk_id")).alias("_chunk"), squeeze(F.col("sentence")).alias("_sentence"), order)
    last = last.groupBy("_chunk").agg(F.max(F.struct(order, "_sentence")).alias("_r")).select("_chunk", F.col("_r._sentence").alias("_sentence"))
    joined = rows.join(last, F.col("chunk_id") == F.col("_chunk"), "left")
    hit = F.col("_chunk").isNotNull()
    return joined.withColumns({
        "sentence": F.when(hit, F.col("_sentence")).otherwise(F.col("sentence")),
        "needs_review": F.when(hit, False).otherwise(F.col("needs_review")),
        "human_verified": F.when(hit, True).otherwise(F.col("human_verified")),
    }).drop("_chunk", "_sentence")


def review_errors(rows: DataFrame, reviews: DataFrame) -> DataFrame:
    """Approved reviews of unknown chunks or without text: chunk_id, problem."""
    ok = reviews.where(approved("approved")).select(squeeze(F.col("chunk_id")).alias("chunk_id"), "sentence")
    unknown = ok.join(rows.select("chunk_id").distinct(), "chunk_id", "left_anti").select("chunk_id", F.lit("unknown chunk_id").alias("problem"))
    return unknown.unionByName(ok.where(blank("sentence")).select("chunk_id", F.lit("approved text is empty").alias("problem"))).distinct()


def conv_frames(samples: Column, layers: list[tuple[int, int]] = CONVOLUTIONS) -> Column:
    """Acoustic frames of so many samples, folded over the layers."""
    for kernel, stride in layers:
        samples = F.floor((samples - kernel) / stride) + 1
    return samples.cast("bigint")


def label_frames(text: Column | str) -> Column:
    """Frames that a label needs: its code points and one more for each that repeats the one before."""
    chars = F.split(col(text), "")
    repeats = F.aggregate(F.zip_with(chars, F.slice(chars, 2, F.greatest(F.size(chars) - 1, F.lit(0))), lambda a, b: F.coalesce(a == b, F.lit(False)).cast("int")), F.lit(0), lambda a, x: a + x)
    return F.when(F.length(col(text)) == 0, 0).otherwise(F.size(chars) + repeats).cast("bigint")


def valid_item(duration: Column | str, text: Column | str) -> Column:
    """Longer than 2 s and at most 10 s, with more than 5 characters in standard form."""
    return F.coalesce((col(duration) > 2) & (col(duration) <= 10) & (F.length(standardize(text)) > 5), F.lit(False))


def analysable(pcm: Column | str, rate: int = 16_000, most: float = 60) -> Column:
    """Why an upload is not analysed, or null: it is empty, longer than most seconds, or silent."""
    size = F.octet_length(pcm)
    silent = F.length(F.regexp_replace(F.hex(pcm), "^(00)+$", "")) == 0
    return F.when(F.coalesce(size, F.lit(0)) == 0, "empty").when(size / F.lit(2.0 * rate) > most, "too long").when(silent, "silent")


def feasible_counts(rows: DataFrame, *by: str) -> DataFrame:
    """Rows before and after the feasibility check, excluded ones and empty labels, from ctc_feasible()."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("before"), F.count_if("feasible").alias("kept"), F.count_if(~F.col("feasible")).alias("excluded"), F.count_if(F.col("needed") == 0).alias("empty")
    )


def ctc_feasible(rows: DataFrame, text: str, rate: int = 16_000, mask_length: int = 0) -> DataFrame:
    """Add needed and available frames and feasible; an empty label is not feasible; masking needs mask_length frames at least."""
    frames = F.when(label_frames(text) > 0, F.greatest(label_frames(text), F.lit(mask_length))).otherwise(0).cast("bigint")
    ready = rows.withColumns({"needed": frames, "available": conv_frames(F.bround(F.col("duration") * rate))})
    return ready.withColumn("feasible", (F.length(text) > 0) & F.coalesce(F.col("needed") <= F.col("available"), F.lit(False)))


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The latest delivery of each key; ties by the whole row."""
    others = [c for c in rows.columns if c not in (key, order)]
    best = rows.groupBy(key).agg(F.max(F.struct(order, *others)).alias("_r"))
    return best.select(key, "_r.*").select(*rows.columns)


def violations(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Rows that break a rule, once for each rule: the row and rule."""
    return rows.withColumn("rule", F.explode(reasons_of(checks)))

