"""Cross-split overlap against all pairs."""

import random

import pytest

from utterlake.llm.overlap import EMPTY_SHA256, overlap_classes, overlap_counts, split_overlap
from utterlake.operators.segments import edits

SCHEMA = "id string, text string, split string, pcm_sha256 string, source string, key string, train_id int"


def brute(rows, share=0.15, least=25):
    out = set()
    names = {"dev": "validation", "valid": "validation"}
    side = lambda s: names.get((s or "").strip().lower(), (s or "").strip().lower())
    only = lambda t: "".join(c for c in (t or "").lower() if c.isalpha())
    for a in rows:
        for b in rows:
            if side(a[2]) == "train" and side(b[2]) in ("validation", "test") and a[0] != b[0] and a[0] and b[0]:
                x, y = only(a[1]), only(b[1])
                near = min(len(x), len(y)) >= least and edits(list(x), list(y)) <= share * max(len(x), len(y))
                p, q = (a[3] or "").lower().strip(), (b[3] or "").lower().strip()
                if near or (p and p == q and p != EMPTY_SHA256):
                    out.add((a[0], b[0]))
    return out


def mutate(rng, text, n):
    chars = list(text)
    for _ in range(n):
        k = rng.randrange(len(chars) + 1)
        what = rng.randrange(3)
        if what == 0 and k < len(chars):
            chars[k] = rng.choice("abcxyz")
        elif what == 1 and k < len(chars):
            del chars[k]
        else:
            chars.insert(k, rng.choice("abcxyz"))
    return "".join(chars)


@pytest.mark.parametrize("shards", [None, 60])
def test_equals_all_pairs(spark, shards, monkeypatch):
    rng = random.Random(9)
    if shards:  # many small shards and chunks
        import utterlake.llm.overlap as overlap

        whole = overlap.near_classes
        monkeypatch.setattr(overlap, "near_classes", lambda c, s: whole(c, s, 400, 2000, 1000))
    base = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(20, 70))) for _ in range(20)]
    base += ["ab" * rng.randrange(12, 40) for _ in range(6)] + ["a" * 40, "a" * 44, "سلام" * 9]
    rows = []
    for k in range(260):
        text = rng.choice(base)
        text = mutate(rng, text, rng.choice([0, 0, 1, 3, 6, 9, 12]))
        rows.append((f"u{k}", rng.choice([text, text.upper(), " ".join(text), None, ""]), rng.choice(["train", "Train ", "train", "dev", "TEST", None, ""]), rng.choice([None, "", EMPTY_SHA256, f"H{rng.randrange(40)}", f"h{rng.randrange(40)}"]), "s", None, 1))
    rows += rows[:10] + [(None, base[0], "train", "h1", "s", None, 1), ("same", base[0], "train", "h1", "s", None, 1), ("same", base[0], "test", "h1", "s", None, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    pairs = split_overlap(df)
    got = {(r.train_id, r.eval_id) for r in pairs.collect()}
    assert got == brute(rows)
    # Links of classes count the same pairs, one utterance with itself aside, without making them.
    links = overlap_classes(df).collect()
    by_text = pairs.where("edits is not null").count()
    itself = sum(1 for r in rows[-1:] for q in rows[-2:-1] if r[0] == q[0] and len(r[1]) >= 25)
    assert sum(r.trains * r.evals for r in links if r.kind != "digest") == by_text + itself
    assert all(r.edits == 0 for r in links if r.kind == "same") and all(r.edits > 0 for r in links if r.kind == "near")
    counts = overlap_counts(pairs, df).collect()
    assert sum(r.pairs for r in counts) >= len(got) - 5


def test_empty(spark):
    assert split_overlap(spark.createDataFrame([], SCHEMA)).count() == 0
    rng = random.Random(1)
    long = "".join(rng.choice("abcdefghijklmnop") for _ in range(12_000))
    rows = [("a", "x" * 3000, "train"), ("b", "x" * 2900, "test"), ("c", long, "train"), ("d", mutate(rng, long, 900), "dev"), ("e", long[::-1], "dev")]
    df = spark.createDataFrame([(*r, None, None, None, 1) for r in rows], SCHEMA)
    assert {(r.train_id, r.eval_id) for r in split_overlap(df).collect()} == {("a", "b"), ("c", "d")}


def test_letters_of_ligatures(spark):
    # 24 code points with 25 letters and more, as lam-alef, Latin and Arabic word ligatures stand for several.
    rows = [("a", "بپتجچحخدرزسشصطعغفقکگمنوﻻ", "train"), ("b", "بپتجچحخدرزسشصطعغفقکگمنولا", "test"), ("c", "ﬁ" * 13, "train"), ("d", "fi" * 13, "dev"), ("e", "abcdefghijklmnopqrstuvwx", "train"), ("f", "abcdefghijklmnopqrstuvwx", "test")]
    df = spark.createDataFrame([(*r, None, None, None, 1) for r in rows], SCHEMA)
    assert {(r.train_id, r.eval_id) for r in split_overlap(df).collect()} == {("a", "b"), ("c", "d")}
