"""Take pieces: cover, bounds, overlap, text, and greedy marks against a loop."""

import random

import numpy as np
import pytest

from utterlake.llm.pieces import greedy_marks, take_pieces

SCHEMA = "take_id string, audio string, sentence string, duration double, regions array<struct<start_sample:bigint,end_sample:bigint>>, piece int"


def test_doubling_equals_walking():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = int(rng.integers(1, 80))
        succ = np.minimum(np.arange(n) + rng.integers(1, 6, n), n - 1)
        marks, at = np.zeros(n, bool), 0
        while not marks[at]:
            marks[at] = True
            at = succ[at]
        assert (greedy_marks(np.array([0]), succ) == marks).all()


def takes(n, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        at, regions = 0, []
        for _ in range(rng.randrange(0, 14)):
            a = at + rng.choice([0, 2000, 9000, 40000])
            at = a + rng.choice([8000, 60000, 200000, 700000])
            regions.append({"start_sample": a, "end_sample": at})
        if rng.random() < 0.2:
            rng.shuffle(regions)
            regions += regions[:1]
        text = rng.choice([None, "", "یک دو. سه چهار؟ پنج " * rng.randrange(1, 9), "一二三四。五六七" * rng.randrange(1, 9), "x" * 50])
        rows.append((f"t{k}", "a", text, rng.choice([None, 0.0, -1.0, float("nan"), at / 16000 + 3, at / 16000, 2.0]), rng.choice([regions, regions, None, [], [None]]), 5))
    return rows


def test_pieces(spark):
    rows = takes(120, 3)
    df = spark.createDataFrame(rows + rows[:20], SCHEMA)
    got = {}
    for r in take_pieces(df).orderBy("take_id", "piece").collect():
        got.setdefault(r.take_id, []).append(r)
    for take, _, text, duration, regions, _ in rows:
        last = max((r["end_sample"] for r in regions or [] if r), default=0)
        size = max(last, int(np.ceil(duration * 16000)) if duration and duration == duration and duration > 0 else 0)
        if size <= 0:
            assert take not in got
            continue
        ps = got[take]
        assert [p.piece for p in ps] == list(range(len(ps))) and {p.pieces for p in ps} == {len(ps)}
        assert ps[0].start_sample == 0 and ps[-1].end_sample == size
        assert all(0 < p.end_sample - p.start_sample <= 256000 for p in ps)
        assert all(b.start_sample == max(0, a.end_sample - 8000) for a, b in zip(ps, ps[1:]))
        assert (len(ps) > 1) == (size > 256000)
        if text is None:
            assert {p.sentence for p in ps} == {None}
        else:
            assert "".join("".join(p.sentence.split()) for p in ps) == "".join(text.split())
        ends = sorted((r["start_sample"], r["end_sample"]) for r in regions or [] if r)
        for p in ps[:-1]:
            if p.cut != "hard":  # a cut in a pause is in no region
                assert not any(a < p.end_sample < b for a, b in ends)


def test_empty_and_parameters(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert take_pieces(empty).count() == 0
    with pytest.raises(ValueError):
        take_pieces(empty, 1.0, 1.0)
    long = spark.createDataFrame([("t", "a", "a. " * 100_000, 100_000.0, [{"start_sample": k * 48000, "end_sample": k * 48000 + 40000} for k in range(30_000)], 1)], SCHEMA)
    pieces = take_pieces(long).collect()
    assert len(pieces) == pieces[0].pieces > 6000 and max(p.end_sample - p.start_sample for p in pieces) <= 256000
