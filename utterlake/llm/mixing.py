"""Mixing sources to target shares of tokens: a multivariate-hypergeometric splitting tree.

Each source's documents stand in one permuted order on an axis of tokens, once for each copy, and the axis is cut
into blocks.  How many blocks of each source the mix takes is exact; a tree splits these quotas between the
halves of the output shards by multivariate hypergeometric draws, down to single shards, so that every shard is
as a random draw without replacement from the whole mix.  Shards then take disjoint blocks from a permutation of
each source's blocks, and are shuffled by themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..plans.lineage import written
from .tokens import token_count


#: Shards whose quotas one task draws.
SHARDS_A_TASK = 4096


def leaves(quotas: np.ndarray, shards: int, seed: int, low: int, high: int, first: int = 0, before: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Shards low to high of the tree below a node: shard, its first place in each source's order of blocks, and its quotas.

    Every node's draw has a seed of its own, so any part of the tree can be drawn by itself, wherever it is needed.
    """
    before = np.zeros_like(quotas) if before is None else before
    if first >= high or first + shards <= low:
        return
    if shards == 1:
        yield first, before, quotas
        return
    left, total = shards // 2, int(quotas.sum())
    rng = np.random.default_rng([seed, first, shards])
    mine = rng.multivariate_hypergeometric(quotas, total * left // shards, method="marginals") if total else np.zeros_like(quotas)
    yield from leaves(mine, left, seed, low, high, first, before)
    yield from leaves(quotas - mine, shards - left, seed, low, high, first + left, before + mine)


def split_quotas(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Quotas of blocks by shard: shards by sources, columns add up to quotas, rows differ in sum by one at most."""
    return np.stack([own for _, _, own in leaves(quotas, shards, int(rng.integers(1 << 62)), 0, shards)])


def shard_places(spark: SparkSession, names: list[str], quotas: np.ndarray, shards: int, seed: int) -> DataFrame:
    """The shard of every place in each source's order of blocks: source, place, shard.  Drawn by the executors, a part of the tree a task."""
    schema = pa.schema([("source", pa.string()), ("place", pa.int64()), ("shard", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch["id"].to_pylist():
                for shard, start, own in leaves(quotas, shards, seed, part * SHARDS_A_TASK, (part + 1) * SHARDS_A_TASK):
                    source = np.repeat(np.arange(len(names)), own)
                    place = np.arange(len(source)) - np.repeat(np.cumsum(own) - own, own) + np.repeat(start, own)
                    yield pa.RecordBatch.from_arrays([pa.array(names).take(pa.array(source)), pa.array(place), pa.array(np.full(len(source), shard, np.int32))], schema=schema)

    parts = -(-shards // SHARDS_A_TASK)
    return spark.range(0, parts, 1, parts).mapInArrow(run, "source string, place bigint, shard int")


def coprime(n: int, seed: int) -> int:
    """A number below n without a common factor, about the golden share of n: n's places taken so far apart are all its places."""
    k = max(1, int(n * 0.6180339887) + seed % 97) % max(1, n)
    while math.gcd(max(1, k), n) != 1:
        k += 1
    return max(1, k % max(2, n))


def mix(
    documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, shard_tokens: int = 8_000_000, blocks: int = 64, bucket_rows: int = 1_000_000, fillings: int = 4, seed: int = 11, size: str | None = None
) -> DataFrame:
    """A mix in which each source has its target share of the tokens: doc_id, source, copy, tokens, shard, position.

    documents: doc_id, text, source (or a column named by size instead of text); targets: source,
    target_share, max_repeats, a table of parameters.  The mix is as large as the scarcest source allows with no
    document more often than max_repeats, or total_tokens if that is less.  The share of a target without documents
    cannot be met; the others keep their proportions.  Sources without a target, null sources and texts without tokens
    are out; a null or non-positive share or max_repeats is no target; of targets given twice the first by share counts.
    No source gets more than its due; what its last whole document leaves is filled up by fillings more documents at most.
    """
    spark = documents.sparkSession
    rows = {}
    for r in targets.where("source is not null and target_share > 0 and max_repeats > 0").orderBy("source", F.desc("target_share"), F.desc("max_repeats")).collect():
        rows.setdefault(r["source"], (float(r["target_share"]), int(r["max_repeats"])))
    names = spark.createDataFrame([(k,) for k in rows], "source string")
    wanted = documents.where("doc_id is not null and source is not null").join(F.broadcast(names), "source", "left_semi")
    tokens = token_count("text") if size is None else F.col(size)
    order = F.xxhash64(F.lit(seed), "doc_id")
    sized = written(wanted.select("doc_id", "source", tokens.cast("bigint").alias("tokens")).where("tokens > 0").groupBy("doc_id", "source").agg(F.max("tokens").alias("tokens")))
    buckets = min(16_384, max(256, sized.count() // bucket_rows))
    sized = sized.withColumn("order", order).withColumn("bucket", F.pmod(F.shiftright("order", 20), F.lit(buckets)).cast("int"))
    sums = {(r["source"], r["bucket"]): r["n"] for r in sized.groupBy("source", "bucket").agg(F.sum("tokens").alias("n")).collect()}
    have = {s: sum(sums.get((s, b), 0) for b in range(buckets)) for s in rows}
    rows = {s: v for s, v in rows.items() if have[s]}
    empty = "doc_id bigint, source string, copy bigint, tokens bigint, shard int, position bigint"
    if not rows:
        return spark.createDataFrame([], empty)
    whole = sum(share for share, _ in rows.values())
    total = min(have[s] * most * whole / share for s, (share, most) in rows.items())
    total = min(total, total_tokens or math.inf)
    need = {s: total * share / whole for s, (share, _) in rows.items()}
    shards = max(1, math.ceil(total / shard_tokens))
    block = max(1, math.ceil(total / (shards * blocks)))
    # Where each bucket of a source begins on its axis, and what the source gives.
    before = []
    for s in rows:
        at = 0
        for b in range(buckets):
            before.append((s, b, at, have[s], need[s], rows[s][1]))
            at += sums.get((s, b), 0)
    starts = spark.createDataFrame(before, "source string, bucket int, start bigint, have bigint, need double, most bigint")
    order_of = list(rows)
    # The last document begins before the due's end, so these are exactly the blocks that have any.
    quotas = np.array([max(1, math.ceil(need[s] / block)) for s in order_of], np.int64)
    blocks_of = dict(zip(order_of, quotas.tolist()))
    step = spark.createDataFrame([(s, n, coprime(n, seed)) for s, n in blocks_of.items()], "source string, blocks bigint, step bigint")
    place = shard_places(spark, order_of, quotas, shards, seed)
    place_of = F.col("start") + F.sum("tokens").over(Window.partitionBy("source", "bucket").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")
    axis = sized.join(F.broadcast(starts), ["source", "bucket"]).withColumn("at", place_of)
    copies = F.least(F.col("most"), F.greatest(F.lit(0), F.ceil((F.col("need") - F.col("at") - F.col("tokens") + 1) / F.col("have"))))
    turn = written(axis.select("doc_id", "source", "tokens", "order", "at", "have", "most", copies.cast("bigint").alias("copies")))
    # What whole documents leave of a source's due is filled with its largest documents that still fit and may be repeated.
    extra = []
    for _ in range(fillings):
        got = {r["source"]: r["n"] for r in turn.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("n")).collect()} if not extra else got
        left = {s: need[s] - got[s] - sum(x[2] for x in extra if x[1] == s) for s in rows}
        gaps = F.broadcast(spark.createDataFrame(list(left.items()), "source string, gap double"))
        used = F.broadcast(spark.createDataFrame([(x[0], x[1]) for x in extra] or [(None, None)], "doc_id bigint, source string"))
        fits = turn.where("copies < most").join(used, ["doc_id", "source"], "left_anti").join(gaps, "source").where("tokens <= gap")
        best = fits.groupBy("source").agg(F.max_by(F.struct("doc_id", "tokens", "copies"), F.struct("tokens", "order", "doc_id")).alias("b")).collect()
        extra += [(r["b"]["doc_id"], r["source"], r["b"]["tokens"], r["b"]["copies"]) for r in best]
        if not best:
            break
    rng = np.random.default_rng(seed)
    more = spark.createDataFrame([(d, s, t, c, int(rng.integers(blocks_of[s]))) for d, s, t, c in extra], "doc_id bigint, source string, tokens bigint, copy bigint, block bigint")
    drawn = (
        turn.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)))
        .withColumn("block", F.floor((F.col("at") + F.col("copy") * F.col("have")) / block)).select("doc_id", "source", "tokens", "copy", "block")
        .unionByName(more).join(F.broadcast(step), "source").withColumn("place", F.col("block") * F.col("step") % F.col("blocks"))
        .join(place, ["source", "place"])
    )
    shuffled = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "copy"), "doc_id", "copy")
    return drawn.select("doc_id", "source", "copy", "tokens", "shard", F.row_number().over(shuffled).cast("bigint").alias("position"))


def mix_shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Target and actual shares by source, documents, copies and the most copies of one document."""
    once = mixed.groupBy("source", "doc_id").agg(F.count("*").alias("times"), F.sum("tokens").alias("tokens"))
    got = once.groupBy("source").agg(F.count("*").alias("documents"), F.sum("times").alias("copies"), F.max("times").alias("most_times"), F.sum("tokens").alias("tokens"))
    total = got.agg(F.sum("tokens").alias("total"))
    wanted = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    return (
        wanted.join(got, "source", "full").crossJoin(F.broadcast(total))
        .select("source", "target_share", (F.coalesce("tokens", F.lit(0)) / F.col("total")).alias("actual_share"), "max_repeats", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("most_times", "documents", "copies", "tokens")])
    )
