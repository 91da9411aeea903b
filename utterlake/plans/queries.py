"""Queries of the core operators over the project's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, metrics, text
from ..operators import audio, augment, corpus, dedup, filters, graph, prepare, segments, splits, validate
from ..sources import readers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def utterances(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Utterances in their first delivery; split names in one spelling, null split as train."""
    u = table(spark, folder, "utterances")
    name = F.lower(F.trim("split"))
    split = F.when(name.isin("dev", "valid"), "validation").otherwise(F.coalesce(F.nullif(name, F.lit("")), F.lit("train")))
    kept = [c for c in (columns or u.columns) if c not in ("id", "ordinal", "split")]
    return u.select("id", "ordinal", *kept, split.alias("split"))


@query
def manifest_training(spark: SparkSession, folder: str) -> DataFrame:
    u = utterances(spark, folder, "audio", "text", "language", "duration").where("text is not null")
    return corpus.project_training(u)


@query
def latest_delivery(spark: SparkSession, folder: str) -> DataFrame:
    return filters.latest(table(spark, folder, "utterances").select("id", "ingested_at", "ordinal"), "id", "ingested_at")


@query
def prompt_text(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.with_prompts(utterances(spark, folder, "language", "text").select("ordinal", "language", "text"))


@query
def plain_labels(spark: SparkSession, folder: str) -> DataFrame:
    labels = dedup.with_prompts(utterances(spark, folder, "language", "text").select("ordinal", "language", "text"))
    return labels.select("ordinal", text.plain_text("text").alias("plain"), text.after_marker("text").alias("after"))


@query
def reform_text(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "utterances").select("ordinal", text.reform("sentence").alias("reformed"))


@query
def standard_text(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "utterances").select("ordinal", text.standardize("sentence").alias("standard"))


@query
def norm_ctc(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", text.normalize_ctc("text").alias("form"))


@query
def norm_eval(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "utterances").select("ordinal", text.normalize_eval("sentence").alias("form"))


@query
def norm_eval_composed(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "utterances").select("ordinal", text.normalize_eval("sentence", compose=False).alias("form"))


@query
def norm_chunk_composed(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "takes").select("take_id", text.normalize_chunk("sentence", compose=False).alias("form")).distinct()


@query
def safe_ids(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "recordings").select("source_id", text.safe_id("source_id").alias("safe"), text.stem("audio").alias("stem"), text.relocate("audio", "portable").alias("moved")).distinct()


@query
def group_split_bucket(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "utterances").select("source_id").distinct().select("source_id", hashing.bucket("source_id").alias("bucket"), hashing.bucket_split("source_id").alias("split"))


@query
def promote_split(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.promote(utterances(spark, folder, "source_id")).select("ordinal", "source_id", "original_split", "split")


@query
def keep_first_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = utterances(spark, folder, "source_id", "pcm_sha256")
    return dedup.keep_first(dedup.promote(rows)).select("ordinal", "id", "split", "kept")


@query
def publish_stats(spark: SparkSession, folder: str) -> DataFrame:
    rows = utterances(spark, folder, "source_id", "pcm_sha256", "duration")
    return dedup.publish(rows).withColumn("hours", F.round("hours", 4))


@query
def first_reason(spark: SparkSession, folder: str) -> DataFrame:
    return filters.first_reason(utterances(spark, folder, "text", "duration"), 1, 20).select("ordinal", "reason")


@query
def all_reasons(spark: SparkSession, folder: str) -> DataFrame:
    # In the tables audio without content has the digest of empty input; the aligner has the letters of the standard form.
    odd = F.regexp_replace(text.normalize_ctc("text"), f"[{text.STANDARD_LETTERS} ]", "") != ""
    silent = F.lower("pcm_sha256") == F.sha2(F.lit(""), 256)
    rows = filters.all_reasons(utterances(spark, folder, "text", "duration", "alignment_cer", "pcm_sha256"), unsupported=odd, silent=silent, compose=False)
    return rows.select("ordinal", F.array_join("reasons", ",").alias("reasons"))


@query
def quality_gate(spark: SparkSession, folder: str) -> DataFrame:
    rows = filters.quality_gate(utterances(spark, folder, "sentence", "duration", "alignment_wer", "human_verified", "needs_review").withColumn("human_verified", F.col("human_verified").cast("boolean")))
    return rows.select("ordinal", F.array_join("reasons", ",").alias("reasons"))


@query
def apply_reviews(spark: SparkSession, folder: str) -> DataFrame:
    rows = utterances(spark, folder, "chunk_id", "sentence", "needs_review", "human_verified")
    return filters.apply_reviews(rows, table(spark, folder, "reviews")).select("ordinal", "chunk_id", "sentence", "needs_review", "human_verified")


@query
def review_errors(spark: SparkSession, folder: str) -> DataFrame:
    return filters.review_errors(table(spark, folder, "utterances"), table(spark, folder, "reviews"))


@query
def leak_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.leak_pairs(utterances(spark, folder, "source_id", "pcm_sha256", "speaker_id"), ["source_id", "pcm_sha256", "speaker_id"])


@query
def leaked_sources(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.leaked_keys(utterances(spark, folder, "source_id"), "source_id")


@query
def duplicate_ids(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.duplicate_keys(table(spark, folder, "utterances"), "id")


@query
def recording_components(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "recordings")
    edges = r.select(F.col("source_id").alias("node"), F.explode(F.array(F.concat(F.lit("audio:"), "audio_sha256"), F.concat(F.lit("text:"), "text_sha256"))).alias("key"))
    return graph.components(edges)


@query
def rank_split(spark: SparkSession, folder: str) -> DataFrame:
    return splits.group_split(utterances(spark, folder, "speaker_id", "source_id")).select("ordinal", "speaker_id", "split")


@query
def strata_split(spark: SparkSession, folder: str) -> DataFrame:
    groups = table(spark, folder, "recordings").where("speaker_id is not null").groupBy("source_id").agg(F.array_join(F.array_sort(F.collect_set("speaker_id")), "|").alias("speakers"))
    return splits.strata_split(groups, "source_id", "speakers").select("source_id", "speakers", "split")


@query
def volumes(spark: SparkSession, folder: str) -> DataFrame:
    rows = utterances(spark, folder, "source").where("source = 'elderly' and split = 'train'").select("id").distinct()
    # The order is of the digest of the seed and the id without a joint.
    parts = [splits.first_share(rows.withColumn("_k", F.concat(F.lit("volume42"), "id")), "_k", share, None).drop("_k").withColumn("volume", F.lit(name)) for name, share in (("025", 0.25), ("050", 0.5), ("075", 0.75))]
    return corpus.union(parts)


@query
def asset_holdout(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "part").groupBy("p_name").agg(F.min("p_partkey").alias("p_partkey"))
    return splits.first_share(names, "p_name", 0.2, None).select("p_partkey", "p_name")


@query
def matched_sample(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "utterances").select("id", "source", "needs_review").distinct()
    sizes = rows.where("needs_review").groupBy("source").agg(F.count("*").alias("n"))
    return splits.matched_sample(rows.select("id", "source").distinct(), sizes).select("id", "source")


@query
def compose_public(spark: SparkSession, folder: str) -> DataFrame:
    rows = corpus.compose(utterances(spark, folder, "source", "source_id", "pcm_sha256", "duration"), "public")
    return dedup.split_stats(dedup.remove_leakage(rows)[0]).withColumn("hours", F.round("hours", 4))


@query
def composition_readiness(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.readiness(table(spark, folder, "utterances")).withColumn("missing", F.array_join("missing", ","))


def scored(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "utterances").where("asr_prediction is not null").select("ordinal", "source", F.coalesce("text", F.lit("")).alias("reference"), F.col("asr_prediction").alias("prediction"))


@query
def wer_rows(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.row_errors(scored(spark, folder), form="ctc").select("ordinal", "word_errors", "words", "char_errors", "chars")


@query
def wer_cer_corpus(spark: SparkSession, folder: str) -> DataFrame:
    rates = metrics.error_rates(metrics.row_errors(scored(spark, folder), form="ctc"), "source")
    return rates.withColumns({c: F.round(c, 6) for c in ("wer", "cer")})


@query
def high_wer(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.row_errors(scored(spark, folder), form="ctc").where("word_errors > 0.4 * words").select("ordinal", "word_errors", "words")


@query
def result_table(spark: SparkSession, folder: str) -> DataFrame:
    errors = scored(spark, folder)
    raw, normal = (metrics.error_rates(metrics.row_errors(errors, form=f), "source").select("source", F.round("wer", 6).alias(f"{f}_wer"), F.round("cer", 6).alias(f"{f}_cer")) for f in ("raw", "normalized"))
    return metrics.result_table(raw.join(normal, "source"), "source")


@query
def wer_raw_corpus(spark: SparkSession, folder: str) -> DataFrame:
    rates = metrics.error_rates(metrics.row_errors(scored(spark, folder), form="raw"), "source")
    return rates.withColumns({c: F.round(c, 6) for c in ("wer", "cer")})


@query
def teacher_filter(spark: SparkSession, folder: str) -> DataFrame:
    rows = metrics.row_errors(scored(spark, folder), form="ctc").withColumn("wer", F.try_divide(F.col("word_errors").cast("double"), F.col("words")))
    return filters.teacher_filter(rows, "wer").groupBy("source").agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"))


@query
def sessions_greedy(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9).alias("start")).withColumn("end", F.col("start") + 0.25)
    return segments.sessions(e, "user_id", "start", "end", "event_id").groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("items").cast("bigint").alias("most_items"))


@query
def speech_spans(spark: SparkSession, folder: str) -> DataFrame:
    # Of repeated rows of a take the last one counts, ties by content.
    one = table(spark, folder, "takes").where("regions is not null").groupBy("take_id").agg(F.max(F.struct("ingested_at", "regions")).alias("r")).select("take_id", "r.regions")
    regions = F.array_sort(F.array_distinct(F.transform("regions", lambda r: F.struct(r["start_sample"].alias("start"), r["end_sample"].alias("end")))))
    total = F.array_max(F.transform("regions", lambda r: r["end_sample"]))
    return one.select("take_id", F.explode(segments.speech_regions(regions, total)).alias("s")).select("take_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"))


@query
def fixed_windows(spark: SparkSession, folder: str) -> DataFrame:
    one = table(spark, folder, "takes").where("duration > 0").select("take_id", F.floor(F.col("duration") * 16000).cast("bigint").alias("n")).distinct()
    return one.select("take_id", "n", F.explode(segments.fixed_windows(F.col("n"), 16 * 16000)).alias("w")).select("take_id", "n", F.col("w.start").alias("start"), F.col("w.end").alias("end"))


@query
def context_windows(spark: SparkSession, folder: str) -> DataFrame:
    one = table(spark, folder, "takes").where("duration > 0").select("take_id", F.floor(F.col("duration") * 50).cast("bigint").alias("n")).distinct()
    return one.select("take_id", "n", F.explode(segments.context_windows(F.col("n"))).alias("w")).select("take_id", "n", "w.*")


@query
def region_pairs(spark: SparkSession, folder: str) -> DataFrame:
    one = table(spark, folder, "takes").select("take_id", F.array_sort(F.array_distinct(F.transform("regions", lambda r: r["start_sample"]))).alias("starts")).where("starts is not null").distinct()
    return one.select("take_id", F.explode(segments.consecutive_pairs(F.col("starts"))).alias("p")).select("take_id", "p.*").distinct()


@query
def overlap_check(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "utterances").where("original_start is not null").groupBy("source_id", "id").agg(F.min("original_start").alias("start"), F.min("original_end").alias("end"))
    return validate.overlap_violations(rows, "source_id", "start", "end", "id").select("source_id", "id", "end", "next_start")


@query
def proportional_bounds(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.lit(100).alias("words")).groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"), F.max("words").alias("words"))
    return segments.proportional_bounds(lines, "l_orderkey", "l_linenumber", "l_quantity", "words").select("l_orderkey", "l_linenumber", "from_word", "to_word")


@query
def vocabulary_by_language(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "utterances").where("text is not null").select(F.coalesce("language", F.lit("?")).alias("language"), "text")
    return corpus.vocabulary(rows, "text", "language")


@query
def ctc_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.ctc_vocabulary(table(spark, folder, "utterances").select(text.normalize_ctc("text").alias("t")).where("t is not null"), "t")


@query
def composition_audit(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.composition_audit(utterances(spark, folder, "source", "source_id", "pcm_sha256"), ["source_id", "pcm_sha256"])


@query
def ctc_feasible(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "utterances").select("ordinal", F.coalesce(F.when(F.col("duration") > 0, F.col("duration")), F.lit(0.0)).alias("duration"), text.normalize_ctc(F.coalesce("text", F.lit(""))).alias("label"))
    return filters.ctc_feasible(rows, "label").select("ordinal", "needed", "available", "feasible")


@query
def ctc_greedy_decode(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", F.array_join(segments.greedy_decode(F.col("embedding"), 8), ",").alias("symbols"))


@query
def signal_levels(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", *[F.round(c, 4).alias(n) for n, c in segments.signal_levels("embedding").items()])


@query
def zipped_lines(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    b = table(spark, folder, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("next_partkey"))
    return corpus.zipped(a, b, "l_orderkey", "l_linenumber")


@query
def partition_complete(spark: SparkSession, folder: str) -> DataFrame:
    chunks = table(spark, folder, "utterances").where("chunk_id is not null").groupBy("source_id", "chunk_id").agg(F.min("text").alias("text"))
    return corpus.joined_text(chunks, "source_id", "chunk_id", "text").select("source_id", F.length("joined").cast("bigint").alias("chars"), F.sha2("joined", 256).alias("digest"))


@query
def incomplete_recordings(spark: SparkSession, folder: str) -> DataFrame:
    """Recordings whose prepared chunks together are not what was delivered."""
    chunks = table(spark, folder, "utterances").where("chunk_id is not null").groupBy("source_id", "chunk_id").agg(F.min("text").alias("text"), F.min("sentence").alias("sentence"))
    whole = corpus.joined_text(chunks, "source_id", "chunk_id", "sentence")
    return corpus.incomplete(chunks, whole.withColumnRenamed("joined", "full"), "source_id", "chunk_id", "text", "full")


@query
def review_flags(spark: SparkSession, folder: str) -> DataFrame:
    u = table(spark, folder, "utterances")
    return u.select("ordinal", filters.needs_review(F.col("sentence"), F.col("alignment_wer")).alias("needs_review"), filters.human_verified("speaker_id").alias("human_verified"))


@query
def merge_increment(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    base, new = o.where("o_orderstatus <> 'P'"), o.where("o_totalprice > 150000")
    return corpus.merge_increment(base, new, "o_orderkey")


@query
def increment_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return corpus.increment_conflicts(o.where("o_orderstatus <> 'P'"), o.where("o_totalprice > 150000"), "o_orderkey")


@query
def status_zero_fill(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.status_histogram(table(spark, folder, "orders"), "o_orderstatus", ["F", "O", "P", "X"])


JOBS = [("prepare", "complete", 0, []), ("train_a", "pending", 1, ["prepare"]), ("train_b", "pending", 1, ["prepare", "train_a"]), ("eval_a", "pending", 2, ["train_a"]), ("report", "pending", 3, [])]


@query
def runnable_jobs(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.runnable(spark.createDataFrame(JOBS, "id string, status string, priority int, dependencies array<string>")).select("id", "priority")


CONDITIONS = ["snr20", "snr10", "snr5", "rir", "channel", "combined"]


@query
def noise_plan(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "utterances").where("source = 'seniortalk'").select("id").distinct()
    return corpus.noise_plan(rows, "id", CONDITIONS, 37, 11)


@query
def prediction_cache(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.cache_hits(table(spark, folder, "utterances").select("audio", "language"), ["audio", "language"])


@query
def equal_sets(spark: SparkSession, folder: str) -> DataFrame:
    u = table(spark, folder, "utterances").groupBy("source_id").agg(F.min("source").alias("source"))
    r = table(spark, folder, "recordings").groupBy("source_id").agg(F.min("source").alias("source"))
    return corpus.equal_sets(u, r, "source_id", ["source"])


@query
def processing_summary(spark: SparkSession, folder: str) -> DataFrame:
    u = utterances(spark, folder, "source_id", "speaker_id", "duration")
    return u.groupBy("split").agg(F.count("*").alias("samples"), F.round(F.sum("duration") / 3600, 4).alias("hours"), F.countDistinct("source_id").alias("sources"), F.countDistinct("speaker_id").alias("speakers"))


@query
def unreferenced_recordings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "recordings").select("source_id").distinct().join(table(spark, folder, "utterances").select("source_id"), "source_id", "left_anti")


@query
def delivery_days(spark: SparkSession, folder: str) -> DataFrame:
    from ..streaming.merge import delivery_counts

    return delivery_counts(table(spark, folder, "utterances")).select("day", "source", "rows", F.round(F.col("seconds") * 10_000).cast("bigint").alias("seconds_e4"))


@query
def align_beam(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "utterances").where("asr_prediction is not null and text is not null and chunk_id is not null and duration > 0").groupBy("source_id", "chunk_id").agg(
        F.min("text").alias("text"), F.min("asr_prediction").alias("prediction"), F.min("duration").alias("duration")
    )
    whole = corpus.joined_text(parts, "source_id", "chunk_id", "text")
    chunks = parts.select(F.col("source_id").alias("recording"), F.regexp_extract("chunk_id", r"(\d+)$", 1).cast("bigint").alias("chunk"), "prediction", "duration")
    return segments.align_chunks(chunks, whole.select(F.col("source_id").alias("recording"), F.col("joined").alias("transcript")))


@query
def adapter_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Every corpus in the uniform form."""
    u = table(spark, folder, "utterances").select("ordinal", "audio", "text", F.regexp_replace("source_id", "^elderly:", "").alias("source_id"), "speaker_id", "split", "source")
    parts = [prepare.source_rows(u.where(F.col("source") == s).drop("source"), s, u.where(F.col("source") == s).select("audio", "split", "ordinal")) for s in prepare.SOURCES]
    return corpus.union(parts).select("id", "source_id", "speaker_id", "language", "split", "human_verified", "least", "most").distinct()


@query
def materialize_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Materialised rows and rejected ones; the bytes of the sentence stand for decoded audio."""
    u = table(spark, folder, "utterances").select("id", "text", "source", F.encode("sentence", "UTF-8").alias("pcm"), F.lit(0.002).alias("least"), F.lit(0.008).alias("most"))
    good, bad = prepare.materialize(u)
    kept = good.select("id", F.lit(None).cast("string").alias("reason"), "pcm_sha256", F.lit(1).cast("bigint").alias("rows"))
    return kept.unionByName(bad.groupBy("id", "reason").agg(F.count("*").alias("rows")), allowMissingColumns=True)


@query
def validation_checks(spark: SparkSession, folder: str) -> DataFrame:
    u = utterances(spark, folder, "audio", "text", "duration", "needs_review", "human_verified", "speaker_id", "original_start", "original_end")
    return validate.conditions_hold({
        "audio": F.col("audio").isNotNull(), "text": text.normalize_eval("text", compose=False) != "", "duration": F.col("duration").between(1, 16), "reviewed": ~F.col("needs_review").cast("boolean"),
        "verified": F.col("human_verified").cast("boolean") == filters.human_verified("speaker_id"), "stretch": F.abs(F.col("original_end") - F.col("original_start") - F.col("duration")) < 1e-6,
    }, u)


@query
def shared_split_keys(spark: SparkSession, folder: str) -> DataFrame:
    return validate.shared_keys(utterances(spark, folder, "source_id", "pcm_sha256", "speaker_id"), ["source_id", "pcm_sha256", "speaker_id"])


@query
def final_export(spark: SparkSession, folder: str) -> DataFrame:
    rows = filters.all_reasons(utterances(spark, folder, "text", "duration", "alignment_cer", "source_id", "speaker_id", "pcm_sha256").drop("split"), compose=False)
    r = table(spark, folder, "recordings").select("source_id", "audio_sha256", "text_sha256")
    done = prepare.final_export(rows.select("ordinal", "source_id", "speaker_id", "pcm_sha256", "reasons"), r)
    return done.select("ordinal", "split_group", "split", F.array_join("reasons", ",").alias("reasons"))


@query
def dataset_projection(spark: SparkSession, folder: str) -> DataFrame:
    return readers.dataset_columns(table(spark, folder, "utterances").withColumn("human_verified", F.col("human_verified").cast("boolean")))


@query
def pairs_two_tier(spark: SparkSession, folder: str) -> DataFrame:
    """Recordings with their texts: files of some corpora lie beside the audio, of others in a folder of their own, of seniortalk nowhere."""
    r = table(spark, folder, "recordings").select("source", F.col("audio").alias("path")).distinct()
    bare = F.regexp_replace("path", r"\.[^./]*$", "")
    beside = r.where("source in ('mozilla', 'filimo')").select(F.concat(bare, F.lit(".txt")).alias("path"))
    apart = r.where("source in ('elderly', 'ganjoor')").select(F.concat(F.lit("texts/Text_"), text.stem("path"), F.lit(".srt")).alias("path"))
    return prepare.two_tier_pairs(r.select("path"), beside.unionByName(apart))


@query
def path_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Clips at the first place that has them: a portable folder for verified ones, their own place for those to be reviewed."""
    u = table(spark, folder, "utterances").select("ordinal", "audio", F.col("human_verified").cast("boolean").alias("v"), F.col("needs_review").cast("boolean").alias("n"))
    files = u.where("v").select(text.relocate("audio", "portable").alias("path")).unionByName(u.where("n").select(F.col("audio").alias("path")))
    places = {"portable": text.relocate("audio", "portable"), "own": F.col("audio")}
    return prepare.first_existing(u.select("ordinal", "audio"), files, places, "found").select("ordinal", "found")


@query
def valid_items(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "utterances").where(filters.valid_item("duration", "sentence")).select("ordinal")


@query
def chat_prefixes(spark: SparkSession, folder: str) -> DataFrame:
    u = table(spark, folder, "utterances").select("ordinal", "source", text.language_name("language").alias("name"))
    return u.select("ordinal", text.chat_prefix(F.col("source"), F.col("name")).alias("prefix"))


@query
def percent_slice(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "utterances").select("ordinal")
    least = o.agg(F.min("ordinal")).first()[0] or 0
    return o.where(splits.ordinal_slice(o.withColumn("_n", F.col("ordinal") - least), "ordinal", 0.9) if least == 0 else F.col("ordinal") - least < round(o.count() * 0.9))


@query
def ctc_feasible_counts(spark: SparkSession, folder: str) -> DataFrame:
    u = utterances(spark, folder, "text", "duration")
    rows = u.select("split", F.coalesce(F.when(F.col("duration") > 0, F.col("duration")), F.lit(0.0)).alias("duration"), text.normalize_ctc(F.coalesce("text", F.lit(""))).alias("label"))
    return filters.feasible_counts(filters.ctc_feasible(rows, "label", mask_length=10), "split")


@query
def split_speakers(spark: SparkSession, folder: str) -> DataFrame:
    u = utterances(spark, folder, "speaker_id").groupBy("split").agg(F.array_sort(F.collect_set("speaker_id")).alias("s"))
    return u.select("split", F.sha2(F.array_join("s", "|"), 256).alias("speakers"), F.size("s").cast("bigint").alias("n"))


@query
def noise_suite(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors as short sounds under every condition, a fifth of them, held out by digest, as backgrounds and rooms: how many samples each has."""
    e = table(spark, folder, "embeddings").select(F.col("vec_id").cast("string").alias("id"), audio.pcm_of_samples("embedding").alias("pcm"))
    assets = splits.hash_rank(splits.first_share(e, "id", 0.2, None), "id", None).select((F.col("rank") - 1).alias("number"), "pcm", "total")
    n = (assets.agg(F.max("total")).first()[0]) or 1
    made = audio.noise_suite(e, corpus.noise_plan(e, "id", CONDITIONS, n, n), assets, assets)
    return made.select("id", "condition", (F.octet_length("pcm") / 2).cast("bigint").alias("samples"))


@query
def noise_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Suites of noisy rows against their originals; the noisy rows are the later deliveries."""
    u = table(spark, folder, "utterances").where("source = 'seniortalk' and id is not null")
    first = u.groupBy("id").agg(F.min(F.struct("ingested_at", "ordinal", "text", "source_id", "pcm_sha256")).alias("r")).select("id", "r.text", "r.source_id", "r.pcm_sha256")
    last = u.groupBy("id").agg(F.max(F.struct("ingested_at", "ordinal", "text", "source_id", "pcm_sha256")).alias("r")).select("id", "r.text", "r.source_id", "r.pcm_sha256")
    noisy = last.join(corpus.noise_plan(first.select("id"), "id", CONDITIONS, 37, 11).select("id", "condition"), "id")
    return corpus.noise_audit(first, noisy, "id", ["text", "source_id", "pcm_sha256"], CONDITIONS)


@query
def augmentation_plan(spark: SparkSession, folder: str) -> DataFrame:
    rows = augment.plan(utterances(spark, folder).select("ordinal", "id", "split").where("id is not null"), exclude=["TimeStretch", "rir"])
    return rows.select("ordinal", "apply_augmentation", F.array_join("augmentation", ",").alias("augmentation"))


@query
def eval_suites(spark: SparkSession, folder: str) -> DataFrame:
    """Summaries by suite; rows without a prediction failed, a tenth of the duration was spent, and later deliveries are answered from the cache."""
    u = table(spark, folder, "utterances").select("source", "ordinal", "id", "asr_prediction", F.when(F.col("duration") > 0, F.col("duration")).alias("duration"))
    first = u.groupBy("id").agg(F.min("ordinal").alias("first"))
    rows = u.join(first, "id").select("source", "duration", F.when(F.col("asr_prediction").isNull(), F.lit("no prediction")).alias("error"), (F.col("duration") * 0.1).alias("elapsed"), (F.col("ordinal") > F.col("first")).alias("cached"))
    return metrics.eval_summary(rows, "source").withColumn("real_time_factor", F.round("real_time_factor", 6))


@query
def volume_stats(spark: SparkSession, folder: str) -> DataFrame:
    rows = utterances(spark, folder, "source", "source_id", "pcm_sha256", "duration")
    parts = [dedup.split_stats(prepare.volume_composition(rows, share)).withColumn("volume", F.lit(name)) for name, share in (("025", 0.25), ("050", 0.5), ("075", 0.75))]
    return corpus.union(parts).withColumn("hours", F.round("hours", 4))


@query
def mean_confidence(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", (F.round(segments.mean_confidence("embedding"), 4) + 0.0).alias("confidence"))


@query
def unknown_recordings(spark: SparkSession, folder: str) -> DataFrame:
    """Recordings of test utterances that the inventory lacks."""
    held = utterances(spark, folder, "source_id").where("split = 'test'")
    return validate.unmatched(held, table(spark, folder, "recordings"), "source_id")


@query
def page_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Verses of pages, made of the texts that have lines; marks of HTML are taken out of the texts first."""
    d = table(spark, folder, "documents").where("text is not null").select("doc_id", F.split(F.regexp_replace("text", r"[<>&\r\x{0b}\x{0c}\x{1c}-\x{1f}\x{85}\x{2028}\x{2029}]", ""), "\n").alias("lines"))
    block = F.transform("lines", lambda x: F.concat(F.lit('<div class="b"><div class="m1"><p>'), x, F.lit("</p></div></div>")))
    page = F.concat(F.lit('<html><div class="poem">'), F.array_join(block, ""), F.lit('</div><div class="b"><p>no</p></div></html>'))
    found = d.select("doc_id", F.posexplode(readers.verses(page)).alias("verse", "line"))
    return found.select("doc_id", F.col("verse").cast("bigint").alias("verse"), F.sha2("line", 256).alias("digest"))


@query
def substring_offsets(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks that are no stretch of their recording's text: chunks are laid out one after another, as far as their texts go."""
    parts = table(spark, folder, "utterances").where("chunk_id is not null").groupBy("source_id", "chunk_id").agg(F.min("text").alias("text"), F.min("sentence").alias("sentence"))
    whole = corpus.joined_text(parts, "source_id", "chunk_id", "text").withColumnRenamed("joined", "text")
    head = parts.groupBy("source_id").agg(F.min(F.struct("chunk_id", "sentence", "text")).alias("r")).select("source_id", "r.chunk_id", "r.sentence", F.lit(0).cast("bigint").alias("text_start_char"), F.coalesce(F.length("r.text"), F.lit(0)).cast("bigint").alias("text_end_char"))
    return validate.substring_errors(head, whole).select("source_id", "chunk_id")


@query
def prompt_places(spark: SparkSession, folder: str) -> DataFrame:
    """Places where the prompts of the prepared texts are not the labels of the delivered sentences."""
    u = table(spark, folder, "utterances")
    prompts = u.where("text is not null").select("ordinal", "audio", text.prompt(F.lit("Persian"), F.col("text")).alias("text"))
    return validate.prompt_errors(u.select("ordinal", "audio", "sentence"), prompts)


@query
def aligned_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of an order as texts, and those that were sent by air as chunks."""
    l = table(spark, folder, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("place"), F.col("l_partkey").cast("string").alias("text"), "l_quantity").groupBy("l_orderkey", "place").agg(F.min("text").alias("text"), F.max("l_quantity").alias("q"))
    chunks = l.where("q > 10").select("l_orderkey", "place", F.concat(F.lit("chunk_"), F.col("place").cast("string")).alias("audio"))
    return validate.aligned_lines(l.select("l_orderkey", "place", "text"), chunks, "l_orderkey", "place").select("l_orderkey", "place", "text", "audio", "problem")


@query
def cut_takes(spark: SparkSession, folder: str) -> DataFrame:
    """Takes cut between groups of regions, regions standing for words."""
    one = table(spark, folder, "takes").where("size(regions) > 0").groupBy("take_id").agg(F.max(F.struct("ingested_at", "regions")).alias("r")).select("take_id", "r.regions")
    words = F.array_sort(F.array_distinct(F.transform("regions", lambda r: F.struct((r["start_sample"] / 16000).alias("start"), (r["end_sample"] / 16000).alias("end")))))
    rows = one.select("take_id", words.alias("words"), (F.array_max(F.transform("regions", lambda r: r["end_sample"])) / 16000).alias("seconds"))
    return segments.cut_recordings(rows, "take_id", "words", "seconds", "struct<start:double,end:double>").select("take_id", F.col("chunk").cast("bigint").alias("chunk"), "start_sample", "end_sample")
