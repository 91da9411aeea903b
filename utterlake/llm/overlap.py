"""Same or near-same records across splits.

Letters of evaluation texts are cut into d + 1 passages, d being the most edits any near-same partner may
have; with d edits or fewer at least one passage stands unchanged in the partner, near its own place.
Aho-Corasick automata over shards of the evaluation passages scan all training texts.  The matched
intervals of each pair are merged into a coverage of the evaluation record; pairs that match fewer
passages than their own number of edits leaves untouched are out, the rest are measured exactly.
Shards hold evaluation texts of one band of lengths, and a training text is sent to the bands that a partner of it
may have only.  No pair within the threshold is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cores, written
from .common import row_slices, split_name
from .visual_form import code_points, letters

EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
#: Training texts that are looked up together, the hits times groups of entries that are held at once, and the letters
#: of texts that are measured together.
SLICE, GROUPS, LETTERS = 512, 1 << 19, 1 << 20


def most_edits(longer: np.ndarray, share: float) -> np.ndarray:
    """Edits allowed between two texts of which the longer has so many letters."""
    return np.floor(np.asarray(longer) * share + 1e-9).astype(np.int64)


class Sketch:
    """Letter counts of texts, in full and as unary bits: an edit moves at most two of either."""

    def __init__(self, points: np.ndarray, offsets: np.ndarray) -> None:
        n = len(offsets) - 1
        row = np.repeat(np.arange(n), np.diff(offsets))
        slot = (points.astype(np.int64) * 0x9E3779B1 >> 7) % 64
        self.counts = np.minimum(np.bincount(row * 64 + slot, minlength=n * 64).reshape(n, 64), 127).astype(np.int8)
        self.bits = np.zeros((4, n), np.uint64)
        for level in range(4):
            self.bits[level] = ((self.counts > level).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(1, dtype=np.uint64)


def edit_distances(a: np.ndarray, a_len: np.ndarray, b: np.ndarray, b_len: np.ndarray, most: int) -> np.ndarray:
    """Edit distances of row pairs of two zero-padded matrices, in a band of most edits; above that, most + 1."""
    n, width = len(a), 2 * most + 1
    shifted = np.zeros((n, a.shape[1] + width + 1), np.uint32)
    cols = min(b.shape[1], shifted.shape[1] - most - 1)
    shifted[:, most + 1 : most + 1 + cols] = b[:, :cols]
    step = np.arange(width, dtype=np.int16)
    big = np.int16(most + 1)
    band = np.broadcast_to(np.where(step >= most, step - most, big), (n, width)).astype(np.int16)
    out = np.full(n, big, np.int16)
    last = b_len - a_len + most
    rows = np.arange(n)
    done = (a_len == 0) & (last < width) & (last >= 0)
    out[done] = band[done, last[done]]
    for i in range(1, a.shape[1] + 1):
        window = shifted[:, i : i + width]
        new = band + (window != a[:, i - 1 : i])
        new[:, :-1] = np.minimum(new[:, :-1], band[:, 1:] + 1)
        # the column of b before its first letter
        new = np.where((i + step - most < 0)[None, :], big, new)
        if 0 <= most - i:
            new[:, most - i] = np.minimum(i, big)
        band = np.minimum(np.minimum.accumulate(new - step, axis=1) + step, big)
        ends = rows[(a_len == i) & (last >= 0) & (last < width)]
        out[ends] = band[ends, last[ends]]
    return out


def padded(points: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = offsets[rows + 1] - offsets[rows]
    out = np.zeros((len(rows), int(sizes.max(initial=0))), np.uint32)
    at = np.arange(out.shape[1])[None, :] < sizes[:, None]
    out[at] = points[np.repeat(offsets[rows], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)]
    return out, sizes


class Passages:
    """An automaton over the passages of a shard of evaluation texts."""

    def __init__(self, texts: list[str], points: np.ndarray, offsets: np.ndarray, share: float) -> None:
        import ahocorasick

        self.points, self.offsets = points, offsets
        self.size = np.diff(offsets)
        #: The longest partner of n letters has n / (1 - share) of them.
        self.parts = most_edits(np.floor(self.size / (1 - share) + 1e-9), share) + 1
        self.parts = np.maximum(1, np.minimum(self.parts, self.size))
        row = np.repeat(np.arange(len(texts)), self.parts)
        part = np.arange(len(row)) - np.repeat(np.cumsum(self.parts) - self.parts, self.parts)
        start = part * self.size[row] // self.parts[row]
        stop = (part + 1) * self.size[row] // self.parts[row]
        words = [texts[r][a:b] for r, a, b in zip(row.tolist(), start.tolist(), stop.tolist())]
        numbers: dict[str, int] = {}
        word = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
        self.length = np.array([len(w) for w in numbers], np.int32)
        self.automaton = ahocorasick.Automaton()
        for w, k in numbers.items():
            self.automaton.add_word(w, k)
        if numbers:
            self.automaton.make_automaton()
        # Entries by word, place in the order of passages, and the start, or for first passages the size of the
        # whole text: a hit looks only near its own place, by a table of the entries before each coordinate.
        at = np.where(part == 0, self.size[row], start)
        order = np.lexsort((at, part, word))
        self.row, self.part, self.start = row[order], part[order], start[order]
        word, at = word[order], at[order]
        self.span = (stop - start)[order]
        first = np.ones(len(order), bool)
        first[1:] = (word[1:] != word[:-1]) | (self.part[1:] != self.part[:-1])
        heads = np.flatnonzero(first)
        self.group_part = self.part[heads].astype(np.int32)
        self.groups = np.searchsorted(word[heads], np.arange(len(numbers) + 1))
        last = np.append(heads[1:], len(order)) - 1
        self.least, width = at[heads].astype(np.int32), (at[last] - at[heads] + 2).astype(np.int32)
        self.table_at = (np.cumsum(width) - width).astype(np.int32)
        counts = np.bincount(np.repeat(self.table_at, last + 1 - heads) + at - np.repeat(self.least, last + 1 - heads) + 1, minlength=int(width.sum()))
        self.width, self.before = width, np.cumsum(counts).astype(np.int32)
        # What a candidate is first judged by, in as few bytes as may be.
        self.starts, self.sizes = self.start.astype(np.int32), self.size[self.row].astype(np.int32)
        self.after = (self.parts[self.row] - 1 - self.part).astype(np.int32)

    def entries(self, group: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First entry of each group at coordinate low or above, and first above high."""
        at, least, width = self.table_at[group], self.least[group], self.width[group] - 1
        return self.before[at + np.clip(low - least, 0, width)], self.before[at + np.clip(high - least + 1, 0, width)]


def near_entries(shard: Passages, sketch: Sketch, mine: Sketch, x: int, y: int, many: np.ndarray, text: np.ndarray, word: np.ndarray, start: np.ndarray, size: np.ndarray, base: int, allowed: np.ndarray) -> tuple[np.ndarray, ...]:
    """For the hits x to y of some texts: texts, rows of the shard and entries that place, length and letter counts allow."""
    many, own = many[x:y], word[x:y]
    hit = np.repeat(np.arange(x, y, dtype=np.int32), many)
    group = np.arange(len(hit), dtype=np.int32) + np.repeat((shard.groups[own] - np.cumsum(many) + many).astype(np.int32), many)
    reach, began, whole = shard.group_part[group], start[hit], size[text[hit]]
    inner = reach > 0
    ok = np.flatnonzero(inner | (began == 0))
    hit, group, inner = hit[ok], group[ok], inner[ok]
    reach = np.where(inner, reach[ok], allowed[2 * whole[ok]])
    centre = np.where(inner, began[ok], whole[ok])
    low, high = shard.entries(group, centre - reach, centre + reach)
    many = high - low
    hit = np.repeat(hit, many)
    entry = np.arange(len(hit), dtype=np.int32) + np.repeat(low - np.cumsum(many, dtype=np.int32) + many, many)
    # Edits before the passage move it, edits after it must bring the ends together.
    moved = start[hit] - shard.starts[entry]
    t = text[hit]
    rest = np.abs(size[t] - shard.sizes[entry] - moved)
    ok = np.flatnonzero(rest <= shard.after[entry])
    entry, moved, rest, t = entry[ok], np.abs(moved[ok]), rest[ok], t[ok]
    most = allowed[np.maximum(size[t], shard.sizes[entry])]
    ok = np.flatnonzero(moved + rest <= most)
    t, most, entry = t[ok], most[ok], entry[ok]
    e = shard.row[entry]
    moves = np.zeros(len(t), np.int32)
    for level in range(4):
        moves += np.bitwise_count(mine.bits[level, t + base] ^ sketch.bits[level, e])
        ok = np.flatnonzero(moves <= 2 * most)
        t, e, most, entry, moves = t[ok], e[ok], most[ok], entry[ok], moves[ok]
    return t, e, entry


def candidates(shard: Passages, sketch: Sketch, mine: Sketch, texts: list[str], size: np.ndarray, base: int, allowed: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pairs of texts, numbered from base in mine, and rows of the shard that may be near-same: text, row, coverage."""
    hits = [list(shard.automaton.iter(t)) for t in texts]
    n = sum(map(len, hits))
    flat = np.fromiter(chain.from_iterable(chain.from_iterable(hits)), np.int32, 2 * n).reshape(n, 2)
    text = np.repeat(np.arange(len(texts), dtype=np.int32), [len(h) for h in hits])
    word = flat[:, 1]
    start = flat[:, 0] - shard.length[word] + 1
    # Each hit meets the groups of entries with its word, one for each place in the order of passages; so many at once.
    many = shard.groups[word + 1] - shard.groups[word]
    bounds = np.searchsorted(np.cumsum(many), np.arange(0, int(many.sum()) + GROUPS, GROUPS), side="left") if n else np.zeros(1, np.int64)
    bounds[-1] = n
    near = [near_entries(shard, sketch, mine, x, y, many, text, word, start, size, base, allowed) for x, y in zip(bounds[:-1], bounds[1:])]
    t, e, entry = (np.concatenate(x) for x in zip(*near)) if near else (np.zeros(0, np.int32),) * 3
    # Merge the matched intervals of a pair; passages are apart from each other, so lengths add up.
    pair, inverse = np.unique(t.astype(np.int64) * len(shard.size) + e, return_inverse=True)
    once = np.unique(inverse * (1 << 32) + shard.start[entry], return_index=True)[1]
    matched = np.bincount(inverse[once], minlength=len(pair))
    covered = np.bincount(inverse[once], weights=shard.span[entry[once]], minlength=len(pair))
    t, e = pair // len(shard.size), pair % len(shard.size)
    most = allowed[np.maximum(size[t], shard.size[e])]
    coverage = covered / np.maximum(shard.size[e], 1)
    ok = matched >= shard.parts[e] - most
    t, e, most, coverage = t[ok], e[ok], most[ok], coverage[ok]
    more = mine.counts[t + base].astype(np.int16) - sketch.counts[e]
    ok = np.maximum(np.maximum(more, 0).sum(1), np.maximum(-more, 0).sum(1)) <= most
    return t[ok] + base, e[ok], coverage[ok]


def scan(shard: Passages, sketch: Sketch, texts: list[str], points: np.ndarray, offsets: np.ndarray, share: float) -> tuple[np.ndarray, ...]:
    """Near-same pairs of training rows and rows of the shard: training row, shard row, edits, coverage."""
    if not len(shard.row) or not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    mine, size = Sketch(points, offsets), np.diff(offsets).astype(np.int32)
    allowed = most_edits(np.arange(2 * (int(size.max()) + int(shard.size.max())) + 1), share).astype(np.int32)
    parts = [candidates(shard, sketch, mine, texts[k : k + SLICE], size[k : k + SLICE], k, allowed) for k in range(0, len(texts), SLICE)]
    t, e, coverage = (np.concatenate(x) for x in zip(*parts))
    most = allowed[np.maximum(size[t], shard.size[e])]
    edits = np.zeros(len(t), np.int64)
    for d in np.unique(most):
        own = np.flatnonzero(most == d)
        # No more at once than matrices of bounded size hold; texts of one d differ little in length.
        width = int(max(size[t[own]].max(), shard.size[e[own]].max())) + 2 * int(d) + 2
        for at in np.array_split(own, -(-len(own) * width // LETTERS)):
            a, a_len = padded(points, offsets, t[at])
            b, b_len = padded(shard.points, shard.offsets, e[at])
            edits[at] = edit_distances(a, a_len, b, b_len, int(d))
    ok = edits <= most
    return t[ok], e[ok], edits[ok], coverage[ok]


def scan_cells(share: float):
    """Scans of training texts against the shard of their cell: rows come sorted by cell, the shard's before the training texts."""
    schema = pa.schema([("train_key", pa.int64()), ("eval_key", pa.int64()), ("edits", pa.int64()), ("coverage", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, parts, shard = None, [], None
        for batch in batches:
            cells, sides = batch["cell"].to_numpy(), batch["side"].to_numpy()
            edges = [0, *(np.flatnonzero((cells[1:] != cells[:-1]) | (sides[1:] != sides[:-1])) + 1).tolist(), batch.num_rows]
            for x, y in zip(edges[:-1], edges[1:]):
                if x == y:
                    continue
                part = batch[x:y]
                if cells[x] != cell:
                    cell, parts, shard = cells[x], [], None
                if sides[x] == 0:
                    parts.append(part)
                    continue
                if shard is None and parts:
                    held = pa.Table.from_batches(parts).combine_chunks()
                    column = held["letters"].combine_chunks()
                    points, offsets = code_points(column)
                    shard, parts = (Passages(column.to_pylist(), points, offsets, share), Sketch(points, offsets), held["key"].to_numpy()), []
                if shard is None:
                    continue
                for a, b in row_slices(part["letters"]):
                    texts = part["letters"][a:b]
                    points, offsets = code_points(texts)
                    t, e, edits, coverage = scan(shard[0], shard[1], texts.to_pylist(), points, offsets, share)
                    yield pa.RecordBatch.from_arrays([pa.array(part["key"][a:b].to_numpy()[t]), pa.array(shard[2][e]), pa.array(edits), pa.array(coverage)], schema=schema)

    return run


def near_classes(classes: DataFrame, share: float = 0.15, shard_letters: int = 6_000_000, chunk_letters: int = 24_000_000, least_chunk: int = 1_500_000) -> DataFrame:
    """Near-same pairs between different texts of the training side and of the evaluation side.

    classes: key bigint, letters string, trains, evals boolean (a text may be on both sides).
    Result: train_key, eval_key bigint, edits bigint, coverage double; equal texts are left to a join.
    The evaluation side is the stated query set: neighbouring bands of lengths share a shard of bounded size, larger bands have several.
    A text of n letters has partners of (1 - share) n to n / (1 - share) letters, so the training texts of three bands meet the shards
    of one, in chunks; each cell of a chunk and a shard is one partition, whose training texts pass by in batches.
    """
    spark = classes.sparkSession
    ratio = -math.log(1 - share) if share > 0 else 1.0
    band = F.floor(F.log(F.length("letters").cast("double")) / ratio).cast("int")
    texts = classes.where("letters <> ''").withColumn("band", band)
    sides = texts.groupBy("band").agg(*[F.coalesce(F.sum(F.when(F.col(c), F.length("letters"))), F.lit(0)).alias(c) for c in ("trains", "evals")]).collect()  # a band is a sixth longer than the one before: few rows
    trains, evals = ({r["band"]: int(r[c]) for r in sides} for c in ("trains", "evals"))
    # Neighbouring bands that one shard can hold go together; a band that is larger has several shards.
    runs: list[list[int]] = []
    for b in sorted(b for b, n in evals.items() if n):
        if runs and sum(evals[x] for x in runs[-1]) + evals[b] <= shard_letters:
            runs[-1].append(b)
        else:
            runs.append([b])
    run_of = {b: k for k, run in enumerate(runs) for b in run}
    plan, cells = {}, 0
    least = max(1, sum(trains.values()) // (2 * cores(spark)))
    for k, run in enumerate(runs):
        meets = sum(trains.get(b, 0) for b in {b + d for b in run for d in (-1, 0, 1)})
        if not meets:
            continue
        shards = -(-sum(evals[b] for b in run) // shard_letters)
        # As many chunks as keep all cores busy, unless texts are few; more where they are many.
        chunks = max(-(-meets // chunk_letters), min(-(-meets // least), -(-meets // least_chunk)), 1)
        plan[k] = (cells, shards, chunks)
        cells += shards * chunks
    if not cells:
        return spark.createDataFrame([], "train_key bigint, eval_key bigint, edits bigint, coverage double")
    run_map = F.create_map(*[F.lit(x) for b, k in run_of.items() for x in (b, k)])
    value = lambda k: F.element_at(F.create_map(*[F.lit(x) for b, v in plan.items() for x in (b, v[k])]), F.col("goal"))
    base, shards, chunks = value(0), value(1), value(2)
    part = lambda n: F.pmod(F.xxhash64("key"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))

    def rows(side: DataFrame, number: int, goals: Column, chunk, shard) -> DataFrame:
        planned = side.select("key", "letters", goals.alias("goal")).where(F.col("goal").isin(list(plan)))
        placed = planned.select("key", "letters", base.alias("base"), shards.alias("shards"), chunk(chunks).alias("chunk"), F.col("goal"))
        placed = placed.select("key", "letters", "base", "shards", "chunk", shard(shards).alias("shard"))
        return placed.select((F.col("base") + F.col("chunk") * F.col("shards") + F.col("shard")).cast("int").alias("cell"), F.lit(number).alias("side"), "key", "letters")

    held = rows(texts.where("evals"), 0, F.element_at(run_map, F.col("band")), every, part)
    near_runs = F.array_distinct(F.array(*[F.try_element_at(run_map, F.col("band") + d) for d in (-1, 0, 1)]))
    train = rows(texts.where("trains"), 1, F.explode(near_runs), part, every)
    placed = held.unionByName(train).repartitionById(cells, F.col("cell")).sortWithinPartitions("cell", "side")
    return placed.mapInArrow(scan_cells(share), "train_key bigint, eval_key bigint, edits bigint, coverage double").where("train_key <> eval_key")


def members(utterances: DataFrame, least_letters: int) -> tuple[DataFrame, DataFrame]:
    """Distinct members of either side by what they have: texts (key, other, letters, id, train) and digests (sha, id, train)."""
    side = split_name("split")
    rows = utterances.where(F.col("id").isNotNull()).select(
        "id", "text", F.lower(F.trim("pcm_sha256")).alias("sha"), F.when(side == "train", True).when(side.isin("validation", "test"), False).alias("train")
    ).where("train is not null")
    texts = (
        rows.where("text is not null")
        .select("id", "train", letters("text").alias("letters"))
        .where(F.length("letters") >= least_letters)
        .withColumns({"key": F.xxhash64("letters"), "other": F.hash("letters")})
        .distinct()
    )
    digests = rows.where((F.col("sha") != "") & (F.col("sha") != EMPTY_SHA256)).select("sha", "id", "train").distinct()
    return written(texts), digests


def text_links(texts: DataFrame, share: float) -> DataFrame:
    """Near-same pairs of different texts of either side, from the members by text: train_key, eval_key, edits, coverage."""
    return near_classes(texts.groupBy("key", "letters").agg(F.max("train").alias("trains"), F.max(~F.col("train")).alias("evals")), share)


def overlap_classes(utterances: DataFrame, share: float = 0.15, least_letters: int = 25) -> DataFrame:
    """Links between classes of equal texts or digests, with their members counted instead of paired: kind, train_key, eval_key, edits, coverage, trains, evals.

    kind is near (two texts within share), same (one text on both sides) or digest (one digest on both sides); keys are hashes of the text's letters or
    the digest.  The number of rows grows with the different texts, however many copies each has.  Cases as of split_overlap(); a link of one utterance with itself counts.
    """
    texts, digests = members(utterances, least_letters)
    count = lambda df, *by: df.groupBy(*by).agg(F.count_if("train").alias("trains"), F.count_if(~F.col("train")).alias("evals"))
    sizes = count(texts, "key", "other")
    both = "trains > 0 and evals > 0"
    row = lambda kind, a, b, edits, coverage: [F.lit(kind).alias("kind"), F.col(a).alias("train_key"), F.col(b).alias("eval_key"), edits.cast("bigint").alias("edits"), coverage.cast("double").alias("coverage"), "trains", "evals"]
    by_key = sizes.groupBy("key").agg(F.sum("trains").alias("trains"), F.sum("evals").alias("evals"))
    near = (
        text_links(texts, share).join(by_key.select(F.col("key").alias("train_key"), "trains"), "train_key").join(by_key.select(F.col("key").alias("eval_key"), "evals"), "eval_key")
        .select(*row("near", "train_key", "eval_key", F.col("edits"), F.col("coverage")))
    )
    same = sizes.where(both).select(*row("same", "key", "key", F.lit(0), F.lit(1.0)))
    shared = count(digests, "sha").where(both).withColumn("key", F.xxhash64("sha")).select(*row("digest", "key", "key", F.lit(None), F.lit(None)))
    return near.unionByName(same).unionByName(shared)


def split_overlap(utterances: DataFrame, share: float = 0.15, least_letters: int = 25) -> DataFrame:
    """Pairs of an utterance of split train and one of validation or test that are the same or nearly so.

    utterances: id, text, split, pcm_sha256; other columns are left out.  A pair is taken if both have
    the same pcm_sha256 (case aside; null, blank and the digest of empty input don't count) or if both
    texts have least_letters letters and their letters are within share of the longer in edits.
    Result, distinct: train_id, eval_id, edits (0 for equal letters, null for a pair by digest only),
    coverage (share of the evaluation text in unchanged passages; null by digest only).  Rows with null id
    or split are out; repeated rows count once; no rows give no rows.  Every member of a class is paired, as the result asks for
    pairs; overlap_classes() has the same without.
    """
    texts, digests = members(utterances, least_letters)
    trains = texts.where("train").select(F.col("key").alias("train_key"), F.col("other").alias("train_other"), F.col("id").alias("train_id"))
    evals = texts.where("not train").select(F.col("key").alias("eval_key"), F.col("other").alias("eval_other"), F.col("id").alias("eval_id"))
    by_near = text_links(texts, share).join(trains, "train_key").join(evals, "eval_key").select("train_id", "eval_id", "edits", "coverage")
    # Texts are told by two hashes, 96 bits together.
    same = trains.join(evals, (F.col("train_key") == F.col("eval_key")) & (F.col("train_other") == F.col("eval_other"))).select("train_id", "eval_id", F.lit(0).cast("bigint").alias("edits"), F.lit(1.0).alias("coverage"))
    by_digest = (
        digests.where("train").select("sha", F.col("id").alias("train_id"))
        .join(digests.where("not train").select("sha", F.col("id").alias("eval_id")), "sha")
        .select("train_id", "eval_id", F.lit(None).cast("bigint").alias("edits"), F.lit(None).cast("double").alias("coverage"))
    )
    return (
        by_near.unionByName(same).unionByName(by_digest).where("train_id <> eval_id")
        .groupBy("train_id", "eval_id").agg(F.min("edits").alias("edits"), F.max("coverage").alias("coverage"))
    )


def overlap_counts(pairs: DataFrame, utterances: DataFrame) -> DataFrame:
    """Overlaps by evaluation split, evaluation source and training source: pairs, evaluation and training records."""
    one = lambda side: utterances.groupBy("id").agg(F.min(split_name("split")).alias("split"), F.min("source").alias("source")).select(
        F.col("id").alias(f"{side}_id"), F.col("split").alias(f"{side}_split"), F.col("source").alias(f"{side}_source")
    )
    return (
        pairs.select("train_id", "eval_id").join(one("eval"), "eval_id").join(one("train").drop("train_split"), "train_id")
        .groupBy("eval_split", "eval_source", "train_source")
        .agg(F.count("*").alias("pairs"), F.countDistinct("eval_id").alias("eval_records"), F.countDistinct("train_id").alias("train_records"))
    )
