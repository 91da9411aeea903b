"""Splitting long takes at natural boundaries.

Every take gives a table of boundaries: its ends, its pauses, and places for hard cuts where no pause is in
reach.  Each boundary is joined to its farthest legal successor, the overlap included, by one sorted merge
over all takes of a batch; the successor tables are then squared until every greedy cut is marked, which
takes as many rounds as the longest take has binary digits of pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_filter, may_hold, row_slices
from .visual_form import code_points, tables, to_strings

RATE = 16_000
# Marks that end a sentence.
SENTENCE_ENDS = ".!?؟。！？…\n"
HARD, PAUSE, SENTENCE = 0, 1, 2


def speech(begin: np.ndarray, end: np.ndarray, row: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """Regions of all rows, cut to their take, sorted and with overlaps merged."""
    end = np.minimum(end, size[row])
    begin = np.maximum(begin, 0)
    ok = end > begin
    begin, end, row = begin[ok], end[ok], row[ok]
    order = np.lexsort((begin, row))
    begin, end, row = begin[order], end[order], row[order]
    if not len(row):
        return begin, end, row
    # The running end of a row: rows lie apart on one axis, so one running maximum serves all.
    shift = row * (int(size.max()) + 2)
    top = np.maximum.accumulate(end + shift) - shift
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (begin[1:] > top[:-1])
    heads = np.flatnonzero(first)
    tails = np.append(heads[1:], len(row)) - 1
    return begin[heads], top[tails], row[heads]


def sentence_places(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places after a sentence end, and after a blank or between letters of scripts without blanks, as offsets; their rows."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    ends = np.isin(points, np.array([ord(c) for c in SENTENCE_ENDS], np.uint32))
    stop = np.zeros(len(points), bool)
    stop[:-1] = ends[:-1] & ~ends[1:] & (row[:-1] == row[1:])
    blank = (tables().flags[points] & 1) > 0
    han = (points >= 0x3400) & (points < 0xA000)
    word = np.zeros(len(points), bool)
    word[:-1] = ((blank[:-1] & ~blank[1:]) | (han[:-1] & han[1:])) & (row[:-1] == row[1:])
    s, w = np.flatnonzero(stop) + 1, np.flatnonzero(word) + 1
    return s, row[s - 1] if len(s) else s, w, row[w - 1] if len(w) else w


def nearest(at: np.ndarray, goal: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each goal the nearest value of sorted at within [low, high], else -1."""
    if not len(at):
        return np.full(len(goal), -1, np.int64)
    k = np.searchsorted(at, goal)
    left, right = at[np.maximum(k - 1, 0)], at[np.minimum(k, len(at) - 1)]
    out = np.where((np.abs(left - goal) <= np.abs(right - goal)) | (k >= len(at)), left, right)
    out = np.where((k == 0), right, out)
    other = np.where(out == left, right, left)
    out = np.where((out >= low) & (out <= high), out, other)
    return np.where((out >= low) & (out <= high), out, -1)


def greedy_marks(first: np.ndarray, successor: np.ndarray) -> np.ndarray:
    """The boundaries met by following successors from first, by squaring the successor table."""
    marks = np.zeros(len(successor), bool)
    marks[first] = True
    jump = successor
    while True:
        met = jump[np.flatnonzero(marks)]
        if marks[met].all():
            return marks
        marks[met] = True
        jump = jump[jump]


def cut_batch(size: np.ndarray, begin: np.ndarray, end: np.ndarray, row: np.ndarray, points: np.ndarray, offsets: np.ndarray, limit: int, overlap: int, near: float) -> tuple[np.ndarray, ...]:
    """Pieces of takes of positive size: take, number, start, end, kind of its end, text start and end (code points)."""
    n = len(size)
    begin, end, row = speech(begin, end, row, size)
    step = limit - overlap
    # Pauses: between regions, at their middle.
    inner = np.flatnonzero(row[1:] == row[:-1]) if len(row) else np.zeros(0, np.int64)
    pause, pause_row = (end[inner] + begin[inner + 1]) // 2, row[inner]
    # Places of the transcript: the share of speech before a boundary is the share of the text before it.
    spoken = np.bincount(row, weights=(end - begin), minlength=n)
    chars = np.diff(offsets)

    def text_at(at: np.ndarray, of: np.ndarray) -> np.ndarray:
        shift = row * (int(size.max()) + 2)
        k = np.searchsorted(begin + shift, at + of * (int(size.max()) + 2), side="right")
        whole = np.concatenate([[0], np.cumsum(end - begin)])
        head = np.searchsorted(row, of)
        last = np.maximum(k - 1, 0)
        over = np.where(k > head, np.maximum(end[last] - np.maximum(at, begin[last]), 0), 0) if len(row) else 0
        said = np.where(k > head, whole[k] - whole[head] - over, 0)
        part = np.where(spoken[of] > 0, said / np.maximum(spoken[of], 1), at / size[of])
        return offsets[of] + np.rint(part * chars[of]).astype(np.int64)

    s, _, w, _ = sentence_places(points, offsets)
    goal = text_at(pause, pause_row)
    slack = np.maximum(1, (chars[pause_row] * limit * near / size[pause_row]).astype(np.int64))
    tied = nearest(s, goal, np.maximum(goal - slack, offsets[pause_row] + 1), np.minimum(goal + slack, offsets[pause_row + 1]))
    kind = np.where(tied >= 0, SENTENCE, PAUSE)
    # Hard places: from each natural boundary, one step after another as far as the next one.
    starts = np.concatenate([np.zeros(n, np.int64), pause])
    start_row = np.concatenate([np.arange(n), pause_row])
    start_kind = np.concatenate([np.full(n, SENTENCE), kind])
    start_text = np.concatenate([offsets[:-1], tied])
    stop = np.concatenate([starts, size])
    stop_row = np.concatenate([start_row, np.arange(n)])
    stop_kind = np.concatenate([start_kind, np.full(n, SENTENCE)])
    stop_text = np.concatenate([start_text, offsets[1:]])
    order = np.lexsort((stop, stop_row))
    stop, stop_row, stop_kind, stop_text = stop[order], stop_row[order], stop_kind[order], stop_text[order]
    gap = np.zeros(len(stop), np.int64)
    gap[:-1] = np.where(stop_row[:-1] == stop_row[1:], stop[1:] - stop[:-1], 0)
    reach = np.where(stop == 0, limit, step)
    hard = np.where(gap > reach, (gap - reach - 1) // step + 1, 0)
    k = np.repeat(np.arange(len(stop)), hard)
    turn = np.arange(len(k)) - np.repeat(np.cumsum(hard) - hard, hard)
    hard_at = stop[k] + reach[k] + turn * step
    stop, stop_row = np.concatenate([stop, hard_at]), np.concatenate([stop_row, stop_row[k]])
    stop_kind, stop_text = np.concatenate([stop_kind, np.full(len(k), HARD)]), np.concatenate([stop_text, np.full(len(k), -1)])
    order = np.lexsort((-stop_kind, stop, stop_row))
    stop, stop_row, stop_kind, stop_text = stop[order], stop_row[order], stop_kind[order], stop_text[order]
    ok = np.ones(len(stop), bool)
    ok[1:] = (stop_row[1:] != stop_row[:-1]) | (stop[1:] != stop[:-1])
    stop, stop_row, stop_kind, stop_text = stop[ok], stop_row[ok], stop_kind[ok], stop_text[ok]
    # Farthest legal successor: the last boundary within reach; among those in the second half of the reach a
    # sentence end before a pause, and any natural one before a hard one.
    axis = stop + stop_row * (2 * int(size.max()) + 4 * limit)
    far = np.where(stop == 0, limit, step)
    index = np.arange(len(stop))
    last_of = np.append(np.flatnonzero(stop_row[1:] != stop_row[:-1]), len(stop) - 1)
    take_last = last_of[stop_row]

    def farthest(which: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(which)
        if not len(at):
            return np.full(len(axis), -1)
        k = np.searchsorted(axis[at], axis + most, side="right") - 1
        found = at[np.maximum(k, 0)]
        ok = (k >= 0) & (found > index) & (found <= take_last) & (axis[found] >= axis + least)
        return np.where(ok, found, -1)

    zero = np.zeros(len(stop), np.int64)
    succ = farthest(np.ones(len(stop), bool), far, zero)
    for which, least in ((stop_kind >= PAUSE, zero), (stop_kind >= SENTENCE, far // 2)):
        better = farthest(which, far, least)
        succ = np.where(better >= 0, better, succ)
    succ = np.where(axis[take_last] <= axis + far, take_last, succ)  # the rest fits
    succ = np.where(index == take_last, index, succ)
    first = np.append(0, last_of[:-1] + 1)
    marks = np.flatnonzero(greedy_marks(first, succ))
    at = marks[marks != take_last[marks]]
    to = succ[at]
    take = stop_row[at]
    number = np.arange(len(at)) - np.searchsorted(take, take)
    start = np.maximum(stop[at] - overlap, 0)
    finish = stop[to]
    # Text of a boundary: its sentence end, else the word boundary nearest to the share of speech.
    text = stop_text.copy()
    open_ = np.flatnonzero(text < 0)
    goal = text_at(stop[open_], stop_row[open_])
    word = nearest(w, goal, offsets[stop_row[open_]], offsets[stop_row[open_] + 1])
    text[open_] = np.where(word >= 0, word, goal)
    text = np.maximum.accumulate(text)
    return take, number, start, finish, stop_kind[to], text[at], text[to]


KINDS = np.array(["hard", "pause", "sentence"])


def piece_batches(limit: int, overlap: int, near: float):
    schema = pa.schema([
        ("take_id", pa.string()), ("audio", pa.string()), ("piece", pa.int64()), ("pieces", pa.int64()), ("start_sample", pa.int64()), ("end_sample", pa.int64()),
        ("cut", pa.string()), ("sentence", pa.string()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part[a:b] for part in batches for a, b in row_slices(part["sentence"])):
            size = batch["size"].to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(size):
                continue
            regions = batch["regions"]
            flat = pc.list_flatten(regions)
            row = pc.list_parent_indices(regions).to_numpy()
            ok = pc.is_valid(flat)
            begin, end = (pc.fill_null(pc.struct_field(flat, k), 0).to_numpy() for k in ("start_sample", "end_sample"))
            ok = ok.to_numpy(zero_copy_only=False)
            points, offsets = code_points(batch["sentence"])
            take, number, start, finish, kind, a, b = cut_batch(size, begin[ok], end[ok], row[ok], points, offsets, limit, overlap, near)
            b = np.maximum(a, b)
            many = b - a
            at = np.repeat(a, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            text = to_strings(points[at], np.concatenate([[0], np.cumsum(many)]))
            null = np.asarray(batch["sentence"].is_null())[take]
            text = pc.if_else(pa.array(null), None, pc.utf8_trim_whitespace(text))
            count = np.bincount(take, minlength=len(size))[take]
            rows = pa.array(take)
            yield pa.RecordBatch.from_arrays(
                [batch["take_id"].take(rows), batch["audio"].take(rows), pa.array(number), pa.array(count), pa.array(start), pa.array(finish), pa.array(KINDS[kind]), text], schema=schema
            )

    return run


def take_pieces(takes: DataFrame, limit_seconds: float = 16.0, overlap_seconds: float = 0.5, near: float = 0.125) -> DataFrame:
    """Ordered pieces of each take, none longer than limit_seconds, that cover it, neighbours overlapping by overlap_seconds.

    takes: take_id, audio, sentence, duration (s), regions (array of start_sample, end_sample); other
    columns are left out.  Size is the greater of a positive duration and the largest end_sample; rows with neither, or
    with null take_id, give no piece.  Of repeated rows of a take the largest counts, ties by content.  Cuts are made in
    pauses between regions, at a pause near the estimated place of a sentence end where one is in the second
    half of reach, and after the full step where there is no pause.  near: how far from its estimated
    place, as a share of the limit, a sentence end is still tied to a pause.  The transcript is cut at that
    sentence end, else at a word boundary; its pieces together are the whole transcript.
    Result: take_id, audio, piece (from 0), pieces, start_sample, end_sample, cut (what the piece's end is),
    sentence (null where the take has none).  A take within the limit is one piece.
    """
    limit, overlap = round(limit_seconds * RATE), round(overlap_seconds * RATE)
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be shorter than the limit")
    last = F.array_max(F.transform("regions", lambda r: r["end_sample"]))
    size = F.greatest(F.when((F.col("duration") > 0) & ~F.isnan("duration"), F.ceil(F.col("duration") * RATE)), F.when(last > 0, last)).cast("bigint")
    sized = takes.where("take_id is not null").select("take_id", "audio", "sentence", "regions", size.alias("size")).where("size is not null")
    # Only takes that may have several rows are brought together, by a filter of fixed size made of those that do; the others stay where they are.
    several = may_hold("take_id", id_filter(sized.groupBy("take_id").agg(F.count("*").alias("n")).where("n > 1"), "take_id"))
    content = F.struct("size", F.xxhash64("audio", "sentence", "regions"), "audio", "sentence")
    best = sized.where(several).groupBy("take_id").agg(F.max_by(F.struct("audio", "sentence", "regions", "size"), content).alias("r")).select("take_id", "r.*")
    one = sized.where(~several).unionByName(best)
    return one.mapInArrow(
        piece_batches(limit, overlap, near), "take_id string, audio string, piece bigint, pieces bigint, start_sample bigint, end_sample bigint, cut string, sentence string"
    )
