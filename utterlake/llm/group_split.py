"""Splits that keep related records together.

Recordings and the keys they share form adjacency lists, hash-partitioned by either end.  Frontier
breadth-first search runs from many seeds at once: every recording with the smallest hash around it is a
seed, and labels spread until all are reached.  Where labels of different seeds collide, the labels become
the nodes of a smaller graph; every round at least halves the nodes that still have neighbours.  A graph that is
small by its count of edges is merged in one task, a larger one is solved the same way again.  Components get their split by the order of their hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..plans.lineage import written
from .common import split_name
from .visual_form import visual_form

# Speaker names that name nobody.
NOBODY = ["unknown", "نامشخص", "-"]
SPLITS = ["test", "validation", "train"]


def speaker_key(raw: Column) -> Column:
    """A speaker's name in one form, without case; null where it names nobody."""
    name = F.lower(raw)
    return F.when((name != "") & ~name.isin(NOBODY), name)


def ties(utterances: DataFrame, recordings: DataFrame) -> DataFrame:
    """Distinct pairs of a recording and a key it has: its speakers in either table and its digests."""
    names = utterances.select("source_id", "speaker_id").unionByName(recordings.select("source_id", "speaker_id")).where("source_id is not null and speaker_id is not null").distinct()
    forms = names.select("speaker_id").distinct().select("speaker_id", speaker_key(visual_form("speaker_id")).alias("name")).where("name is not null")
    speakers = names.join(forms, "speaker_id").select("source_id", F.concat(F.lit("speaker:"), "name").alias("key"))
    digests = recordings.where("source_id is not null").select(
        "source_id", F.explode(F.array(*[F.when(F.trim(c) != "", F.concat(F.lit(f"{c}:"), F.lower(F.trim(c)))) for c in ("audio_sha256", "text_sha256")])).alias("key")
    )
    return speakers.unionByName(digests.where("key is not null")).distinct()


def components(edges: DataFrame, small: int = 100_000) -> DataFrame:
    """Connected components of a bipartite graph: node, key bigint -> node, component (a node of it).

    Nodes whose keys nobody shares are left out: they are components of their own.  Null ends are no edges.
    A graph of colliding labels with at most small edges is merged in one task.
    """
    graph, chain = edges.where("node is not null and key is not null"), None
    while True:
        # A key of one node ties nothing.
        shared = graph.groupBy("key").agg((F.min("node") != F.max("node")).alias("ties")).where("ties").select("key")
        graph = written(graph.join(shared, "key").select("node", "key").distinct())
        edges_left = graph.count()
        if not edges_left:
            break
        last = chain is not None and edges_left <= small
        labels = written(merge_labels(graph) if last else spread_labels(graph))
        chain = labels if chain is None else written(
            chain.withColumnRenamed("label", "via").join(labels.withColumnRenamed("node", "via"), "via", "left").select("node", F.coalesce("label", "via").alias("label"))
        )
        if last:
            break
        # Colliding labels are the nodes of the next, smaller graph.
        graph = graph.join(labels, "node").select(F.col("label").alias("node"), "key").distinct()
    if chain is None:
        return edges.sparkSession.createDataFrame([], "node bigint, component bigint")
    return chain.select("node", F.col("label").alias("component"))


def merge_labels(graph: DataFrame) -> DataFrame:
    """Label every node of a graph of bounded size with the smallest node of its component, in one task: node, label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), pa.schema([("node", pa.int64()), ("key", pa.int64())]))
        nodes, node = np.unique(table["node"].to_numpy(), return_inverse=True)
        order = np.argsort(table["key"].to_numpy(), kind="stable")
        key, node = table["key"].to_numpy()[order], node[order]
        # Nodes of one key follow each other: linking neighbours links them all.
        link = np.flatnonzero(key[1:] == key[:-1])
        label = np.arange(len(nodes))
        while True:
            a, b = label[node[link]], label[node[link + 1]]
            least = np.minimum(a, b)
            before = label.copy()
            np.minimum.at(label, a, least)
            np.minimum.at(label, b, least)
            while (label[label] != label).any():
                label = label[label]
            if (label == before).all():
                break
        yield pa.RecordBatch.from_pydict({"node": nodes, "label": nodes[label]})

    return graph.select("node", "key").coalesce(1).mapInArrow(run, "node bigint, label bigint")


def spread_labels(graph: DataFrame) -> DataFrame:
    """Label every node with a seed of its component, by breadth-first search from all seeds at once: node, label."""
    least = graph.groupBy("key").agg(F.min("node").alias("least"))
    around = graph.join(least, "key").groupBy("node").agg(F.min("least").alias("least"))
    seeds = F.when(F.col("node") == F.col("least"), F.col("node"))
    labels, turn = written(around.select("node", seeds.alias("label"), F.lit(0).alias("turn"))), 0
    while not labels.where("label is null").isEmpty():
        # Keys that the frontier reaches pass its smallest label on to their nodes without one.
        reached = graph.join(labels.where(F.col("turn") == turn).where("label is not null"), "node").groupBy("key").agg(F.min("label").alias("found"))
        new = graph.join(labels.where("label is null").select("node"), "node").join(reached, "key").groupBy("node").agg(F.min("found").alias("found"))
        turn += 1
        labels = written(
            labels.join(new, "node", "left").select("node", F.coalesce("label", "found").alias("label"), F.when(F.col("label").isNull(), turn).otherwise(F.col("turn")).alias("turn"))
        )
    return labels.select("node", "label")


def groups(utterances: DataFrame, recordings: DataFrame) -> DataFrame:
    """Every recording of either table with its group: source_id, component bigint (the smallest hash in it)."""
    node = F.xxhash64("source_id")
    edges = written(ties(utterances, recordings).select(node.alias("node"), F.xxhash64("key").alias("key")))
    tied = written(components(edges))
    every = utterances.select("source_id").unionByName(recordings.select("source_id")).where("source_id is not null").distinct()
    return every.withColumn("node", node).join(tied, "node", "left").select("source_id", F.coalesce("component", "node").alias("component"))


def torn_groups(utterances: DataFrame, recordings: DataFrame) -> DataFrame:
    """Recordings of groups whose utterances lie in more than one split: source_id, component.

    utterances: source_id, speaker_id, split; recordings: source_id, speaker_id, audio_sha256,
    text_sha256; other columns are left out.  Two recordings are tied if they share a speaker, in form and
    without case, or a digest; ties are transitive.  Null, blank and placeholder speakers and null or blank digests tie
    nothing; utterances without a split count for ties only; null recordings are out.  Empty tables give no rows.
    """
    member = written(groups(utterances, recordings))
    places = utterances.select("source_id", split_name("split").alias("split")).where("source_id is not null and split is not null").distinct()
    torn = places.join(member, "source_id").groupBy("component").agg((F.min("split") != F.max("split")).alias("torn")).where("torn").select("component")
    return member.join(torn, "component", "left_semi").select("source_id", "component")


def assign_splits(utterances: DataFrame, recordings: DataFrame, shares: tuple[float, float, float] = (0.8, 0.1, 0.1), large: float = 0.01, buckets: int = 4096) -> DataFrame:
    """One split for each group, near shares (train, validation, test) of the utterance rows: source_id, component, split.

    Groups of more than large of all rows, at most 1 / large of them, go one by one to the split that lacks most.
    All others are laid out by the order of their hash and cut at the rows that are left for test and
    validation; the layout is a prefix sum over buckets of hashes.  Recordings without utterances count no rows.
    """
    if min(shares) < 0 or abs(sum(shares) - 1) > 1e-9:
        raise ValueError("shares must be non-negative and sum to 1")
    spark = utterances.sparkSession
    member = written(groups(utterances, recordings))
    rows = utterances.where("source_id is not null").groupBy("source_id").agg(F.count("*").alias("rows"))
    sizes = written(
        member.join(rows, "source_id", "left").groupBy("component").agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))
        .withColumn("at", F.xxhash64(F.lit("split"), "component")).withColumn("bucket", F.pmod(F.shiftright("at", 16), F.lit(buckets)).cast("int"))
    )
    total = sizes.agg(F.sum("rows")).first()[0] or 0
    target = dict(zip(("train", "validation", "test"), (s * total for s in shares)))
    big = sizes.where(F.col("rows") > large * total).orderBy(F.desc("rows"), "component").select("component", "rows").collect()
    fixed = {}
    for r in big:
        goal = max(target, key=lambda k: (target[k], k == "train"))
        target[goal] -= r["rows"]
        fixed[r["component"]] = goal
    rest = sizes.where(F.col("rows") <= large * total)
    sums = {r["bucket"]: r["n"] for r in rest.groupBy("bucket").agg(F.sum("rows").alias("n")).collect()}
    offset, before = 0, []
    for b in range(buckets):
        before.append((b, offset))
        offset += sums.get(b, 0)
    # What large groups took from a share beyond its due is taken from the others in proportion.
    room = {k: max(0.0, v) for k, v in target.items()}
    scale = offset / sum(room.values()) if sum(room.values()) else 0.0
    cuts = (room["test"] * scale, (room["test"] + room["validation"]) * scale)
    starts = F.broadcast(spark.createDataFrame(before, "bucket int, start bigint"))
    place = F.col("start") + F.sum("rows").over(Window.partitionBy("bucket").orderBy("at", "component").rowsBetween(Window.unboundedPreceding, 0)) - F.col("rows") / 2
    chosen = rest.join(starts, "bucket").withColumn("place", place).select(
        "component", F.when(F.col("place") < cuts[0], "test").when(F.col("place") < cuts[1], "validation").otherwise("train").alias("split")
    )
    if fixed:
        chosen = chosen.unionByName(spark.createDataFrame(list(fixed.items()), "component bigint, split string"))
    return member.join(chosen, "component").select("source_id", "component", "split")
