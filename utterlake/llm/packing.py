"""Filling fixed-capacity containers: hierarchical residual packing.

Partitions pack their items by best fit; bins that are nearly full are done.  Underfull bins become the
items of the next round, which packs them in groups of bounded size, each taking the bins of several earlier
ones, until one group is left or a round no longer brings them together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import written
from .tokens import token_count


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item, largest items first, each into the fullest bin that takes it.

    Open bins are kept by the room they have left, rooms that occur as bits of one integer.
    """
    order = np.argsort(-sizes, kind="stable").tolist()
    size, out = sizes.tolist(), np.zeros(len(sizes), np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    present, bins = 0, 0
    for k in order:
        s = size[k]
        fitting = present >> s
        if fitting:
            room = s + (fitting & -fitting).bit_length() - 1
            own = rooms[room].pop()
            if not rooms[room]:
                present &= ~(1 << room)
        else:
            own, room, bins = bins, capacity, bins + 1
        out[k] = own
        if left := room - s:
            rooms[left].append(own)
            present |= 1 << left
    return out


def packed(batches: Iterator[pa.RecordBatch], capacity: int, most_items: int) -> Iterator[pa.RecordBatch]:
    """Rows name, size with the bin they are in: a bin has the name of its first item and the sizes' sum."""

    def pack(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        sizes = table["size"].to_numpy()
        own = best_fit(sizes, capacity)
        first = np.full(own.max() + 1, len(own))
        np.minimum.at(first, own, np.arange(len(own)))
        used = np.bincount(own, weights=sizes).astype(np.int64)
        names = table["name"].combine_chunks()
        return pa.RecordBatch.from_arrays([names, pa.array(sizes), names.take(pa.array(first[own])), pa.array(used[own])], names=["name", "size", "bin", "used"])

    parts, n = [], 0
    for batch in batches:
        if batch.num_rows:
            parts.append(batch)
            n += batch.num_rows
            if n >= most_items:
                yield pack(parts)
                parts, n = [], 0
    if parts:
        yield pack(parts)


SCHEMA = "name string, size bigint, bin string, used bigint"


def pack_items(items: DataFrame, capacity: int, full: float = 0.98, most_items: int = 50_000, rounds: int = 12) -> DataFrame:
    """Bins of items: name string, size bigint (1 to capacity) -> name, size, bin; names must be distinct."""
    first = written(items.mapInArrow(lambda b: packed(b, capacity, most_items), SCHEMA))
    loose = first.where(F.col("used") < full * capacity).select(F.col("bin").alias("name"), F.col("used").alias("size")).distinct()
    moved = None
    loose = written(loose)
    n = loose.count()
    for _ in range(rounds):
        if n < 2:
            break
        groups = -(-n // most_items)
        turn = written(loose.repartition(groups, F.xxhash64("name", F.lit(n))).mapInArrow(lambda b: packed(b, capacity, 1 << 62), SCHEMA))
        step = turn.select("name", "bin")
        moved = step if moved is None else written(
            moved.join(step.withColumnRenamed("name", "bin").withColumnRenamed("bin", "later"), "bin", "left").select("name", F.coalesce("later", "bin").alias("bin"))
        )
        loose = written(turn.where(F.col("used") < full * capacity).select(F.col("bin").alias("name"), F.col("used").alias("size")).distinct())
        before, n = n, loose.count()
        if groups == 1 or n > 0.95 * before:
            break
    if moved is None:
        return first.select("name", "size", "bin")
    later = moved.select(F.col("name").alias("bin"), F.col("bin").alias("later"))
    return first.join(later, "bin", "left").select("name", "size", F.coalesce("later", "bin").alias("bin"))


def containers(documents: DataFrame, capacity: int = 2048, size: Column | None = None) -> DataFrame:
    """Texts in containers of capacity tokens, with as little room left as possible: doc_id, piece, start_token, tokens, container.

    documents: doc_id, text; other columns are left out.  Only texts above the capacity are divided, into
    pieces of the whole capacity and a rest.  Texts of no tokens (null, empty) need no room and give no row.  Of rows
    that repeat a doc_id the largest counts; a container has the name of one of its pieces.
    """
    sized = documents.where("doc_id is not null and text is not null").select("doc_id", (token_count("text") if size is None else size).alias("all"))
    sized = sized.groupBy("doc_id").agg(F.max("all").alias("all"))
    pieces = sized.where(F.col("all") > 0).select(
        "doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.expr(f"(all - 1) div {capacity}")), lambda k: F.least(F.lit(capacity), F.col("all") - k * capacity))).alias("piece", "size")
    )
    named = pieces.select(F.concat_ws(":", "doc_id", "piece").alias("name"), F.col("size").cast("bigint").alias("size"))
    bins = pack_items(named, capacity)
    part = F.split("name", ":")
    return bins.select(
        part[0].cast("bigint").alias("doc_id"), part[1].cast("bigint").alias("piece"), (part[1].cast("bigint") * capacity).alias("start_token"), F.col("size").alias("tokens"), F.col("bin").alias("container")
    )


def fill(packed_items: DataFrame, capacity: int = 2048) -> DataFrame:
    """Containers, tokens, least possible containers and share of the room that is used."""
    return packed_items.groupBy("container").agg(F.sum("tokens").alias("used")).agg(
        F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("most"),
        F.ceil(F.sum("used") / capacity).alias("least"), (F.sum("used") / (F.count("*") * capacity)).alias("filled"),
    )
