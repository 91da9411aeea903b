"""Materialising, export, pairing, validation, augmentation plans, sinks and emissions on small fixtures."""

import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from utterlake.operators import augment, prepare, segments, validate
from utterlake.operators.filters import analysable
from utterlake.operators.predict import emissions
from utterlake.sources import readers, writers


def test_materialize(spark):
    loud = lambda n, v=5: np.full(n, v, "<i2").tobytes()
    rows = [
        ("a", "x", loud(16_000)), ("a", "x", loud(16_000)), ("b", "x", None), ("c", "x", loud(100)), ("d", " ", loud(16_000)), ("e", "x", loud(16_000, 0)),
        ("f", "x", loud(16_000, 1)), ("f", "x", loud(16_000, 2)), ("g", "x", loud(16_000)), ("h", None, None),
    ]
    df = spark.createDataFrame([(i, t, "s", p, 0.5, 2.0) for i, t, p in rows], "id string, text string, source string, pcm binary, least double, most double")
    known = spark.createDataFrame([("g", "other")], "id string, pcm_sha256 string")
    good, bad = prepare.materialize(df, known)
    assert sorted((r.id, r.duration) for r in good.collect()) == [("a", 1.0), ("f", 1.0)]
    assert sorted((r.id, r.reason) for r in bad.collect()) == [("b", "decode"), ("c", "duration"), ("d", "empty_text"), ("e", "silent_audio"), ("f", "id_collision"), ("g", "id_collision"), ("h", "decode")]
    assert prepare.materialize(df.limit(0))[0].count() == 0
    up = spark.createDataFrame([(loud(10),), (b"",), (None,), (loud(10, 0),), (loud(16_000 * 61),)], "p binary")
    assert [r[0] for r in up.select(analysable("p")).collect()] == [None, "empty", "empty", "silent", "too long"]


def test_two_tier_pairs(spark):
    one = lambda xs: spark.createDataFrame([(x,) for x in xs], "path string")
    got = {r.audio: (r.text, r.problem) for r in prepare.two_tier_pairs(one(["a/x.wav", "a/Voice_1.m4a", "a/q.wav", "a/z.wav"]), one(["a/x.txt", "b/text-1.srt", "b/z.txt", "c/Z.txt", "b/x.txt"])).collect()}
    assert got == {"a/x.wav": ("a/x.txt", None), "a/Voice_1.m4a": ("b/text-1.srt", None), "a/q.wav": (None, "0 matching texts"), "a/z.wav": (None, "2 matching texts")}


def test_next_in_blocks_equals_one_window(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), f"i{k}", rng.choice([rng.uniform(0, 5000), 600.0, 1200.0])) for k in range(300)]
    df = spark.createDataFrame(rows, "g string, id string, start double")
    got = {r.id: r.next_start for r in validate.next_in_blocks(df, "g", "start", "id", 600.0).collect()}
    want = {}
    for g in ("a", "b", None):
        own = sorted((s, i) for gg, i, s in rows if gg == g)
        want |= {i: (own[k + 1][0] if k + 1 < len(own) else None) for k, (_, i) in enumerate(own)}
    assert got == want


def test_checks(spark):
    chunks = spark.createDataFrame([("r", "c1", "ab", 0, 2), ("r", "c2", "zz", 2, 4), ("q", "c3", "x", 0, 1)], "source_id string, chunk_id string, sentence string, text_start_char int, text_end_char int")
    texts = spark.createDataFrame([("r", "abcd")], "source_id string, text string")
    assert {r.chunk_id for r in validate.substring_errors(chunks, texts).collect()} == {"c2", "c3"}
    rows = spark.createDataFrame([("a.wav",), ("b.wav",)], "audio string")
    assert [r[0] for r in validate.missing(rows, spark.createDataFrame([("a.wav",)], "path string")).collect()] == ["b.wav"]
    lengths = spark.createDataFrame([(0.0, 1.0, 1.0), (0.0, 1.0, 0.9)], "start double, end double, duration double")
    got = {r.check: r.violations for r in validate.suite({"lengths": validate.length_errors(lengths), "files": validate.missing(rows, rows.withColumnRenamed("audio", "path"))}).collect()}
    assert got == {"lengths": 1, "files": 0}


def test_augmentation(spark):
    assert list(augment.groups(["InsertPause", "rir"])) == ["background", "gain", "speed", "distortion", "frequency"]
    with pytest.raises(ValueError, match="echo"):
        augment.groups(["echo"])
    rows = spark.createDataFrame([(f"i{k}", "train" if k % 2 else "test") for k in range(2000)], "id string, split string")
    got = augment.plan(rows, probability=0.5).collect()
    assert all(not r.augmentation for r in got if r.split == "test")
    on = [r for r in got if r.augmentation]
    assert 400 < len(on) < 600 and 0.65 < np.mean(["background" in r.augmentation for r in on]) < 0.85
    assert augment.plan(rows, enabled=False).where(F.size("augmentation") > 0).count() == 0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", None, 1), ("b", "سلام", 2)], "id string, text string, n int")
    writers.tsv(df, str(tmp_path / "t"), ["id", "text", "other"], bom=True)
    lines = [x for p in sorted((tmp_path / "t").glob("*.csv")) for x in p.read_text(encoding="utf-8").splitlines()]
    assert "﻿id\ttext\tother" in lines and "b\tسلام\t" in lines
    assert readers.tsv(spark, str(tmp_path / "t")).columns == ["id", "text", "other"]
    writers.document(df.where("n = 2"), str(tmp_path / "d.json"))
    writers.document(df.where("n = 2"), str(tmp_path / "d.json"))
    assert json.loads((tmp_path / "d.json").read_text()) == {"id": "b", "text": "سلام", "n": 2}
    with pytest.raises(ValueError):
        writers.document(df, str(tmp_path / "d.json"))
    writers.report(df, str(tmp_path / "r.md"), "Rows")
    assert "| a | — | 1 |" in (tmp_path / "r.md").read_text()
    df.write.parquet(str(tmp_path / "p"))
    writers.add_new(spark.createDataFrame([("b", "سلام", 2), ("c", "x", 3)], df.schema), str(tmp_path / "p"), "id", "n")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3
    with pytest.raises(ValueError, match="'a'"):
        writers.add_new(spark.createDataFrame([("a", "x", 9)], df.schema), str(tmp_path / "p"), "id", "n")
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "1.wav").write_bytes(b"sound")
    audio = readers.files(spark, str(tmp_path / "w"), content=True)
    path = audio.first().path
    writers.embedded(spark.createDataFrame([(path, "train")], "audio string, split string"), audio, str(tmp_path / "e"))
    got = spark.read.parquet(str(tmp_path / "e")).first().audio
    assert bytes(got.bytes) == b"sound" and got.path == "1.wav"
    with pytest.raises(Exception, match="no file for"):
        writers.embedded(spark.createDataFrame([("none.wav", "train")], "audio string, split string"), audio, str(tmp_path / "f"))


def test_readers(spark, tmp_path):
    for split, names in (("train", ["b.arrow", "a.arrow"]), ("test", ["c.arrow"])):
        (tmp_path / "ds" / split).mkdir(parents=True)
        (tmp_path / "ds" / split / "state.json").write_text(json.dumps({"_data_files": [{"filename": n} for n in names], "_split": split}))
        for k, n in enumerate(names):
            t = pa.table({"id": [f"{split}{k}{j}" for j in range(2)]})
            with pa.ipc.new_stream(str(tmp_path / "ds" / split / n), t.schema) as w:
                w.write_table(t)
    got = readers.dataset_folder(spark, str(tmp_path / "ds"), "id string")
    assert sorted(map(tuple, got.collect())) == [("test00", "test", 0), ("test01", "test", 0), ("train00", "train", 0), ("train01", "train", 0), ("train10", "train", 1), ("train11", "train", 1)]
    (tmp_path / "m.csv").write_text("audio,text,speaker_id,source_id\nx/Voice_1.wav,/t.txt, ,\ny.wav,t.txt,s,Q 1\n")
    rows = readers.csv_pairs(spark, str(tmp_path / "m.csv"), base="/base").orderBy("text").collect()
    assert [(r.audio, r.text, r.speaker_id, r.source_id) for r in rows] == [("/base/y.wav", "/base/t.txt", "s", "Q_1"), ("/base/x/Voice_1.wav", "/t.txt", "unknown", "1")]
    refs = spark.createDataFrame([("a", "language fa<asr_text> hi "), ("b", "language fa<asr_text> "), ("c", None)], "audio string, text string")
    assert [tuple(r) for r in readers.references(refs).collect()] == [("a", "hi")]
    refs.write.parquet(str(tmp_path / "sh"))
    assert readers.peek(refs.where("audio = 'a'"))["audio"] == "a" and readers.peek(refs.limit(0)) is None


def test_emissions_are_those_of_the_whole(spark):
    rng = np.random.default_rng(2)
    sounds = {"a": rng.integers(-900, 900, 320 * 57).astype("<i2"), "b": rng.integers(-900, 900, 320 * 10).astype("<i2")}
    df = spark.createDataFrame([(k, bytearray(v.tobytes())) for k, v in sounds.items()], "id string, pcm binary")

    def load():
        return lambda parts: [np.stack([p.reshape(-1, 320).mean(1), p.reshape(-1, 320).std(1)], 1) for p in parts]

    got = {}
    for r in emissions(df, load, "id", "pcm", core=10, context=2).orderBy("id", "window").collect():
        got.setdefault(r.id, []).extend(r.scores)
    for k, v in sounds.items():
        x = (v.astype(np.float32) / 32768).reshape(-1, 320)
        assert np.allclose(got[k], np.stack([x.mean(1), x.std(1)], 1), atol=1e-6)


def test_cut_recordings(spark):
    words = [(0.5, 1.0), (1.1, 2.0), (4.0, 5.0), (5.05, 5.5)]
    df = spark.createDataFrame([("r", words, 6.0)], "id string, w array<struct<start:double,end:double>>, s double")
    got = segments.cut_recordings(df, "id", "w", "s", "struct<start:double,end:double>").orderBy("chunk").collect()
    assert [(r.start_sample, r.end_sample, len(r.words)) for r in got] == [(6720, 33280, 2), (62720, 89280, 2)]
    assert [r[0] for r in spark.createDataFrame([([0.5, 1.0],), ([],), (None,)], "c array<double>").select(segments.mean_confidence("c")).collect()] == [0.75, None, None]


def test_blocks_equal_one_window(spark):
    from pyspark.sql import Window

    from utterlake.operators.blocks import previous, running_sum

    rng = random.Random(3)
    df = spark.createDataFrame([(rng.choice(["a", "a", "b", None]), rng.randrange(400), k, rng.choice([None, 1, 2, 5])) for k in range(500)], "g string, o int, t int, v int")
    w = Window.partitionBy("g").orderBy("o", "t")
    want = df.withColumns({"p": F.lag("v").over(w), "s": F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))})
    got = running_sum(previous(df, "g", "o", "t", "v", 37, "p"), "g", "o", "t", "v", 37, "s")
    key = lambda r: (r.t, r.p, r.s or 0)
    assert sorted(map(key, got.collect()), key=str) == sorted(map(key, want.collect()), key=str)


def test_checked_merge_and_counts(spark, tmp_path):
    from utterlake.operators import corpus

    base, more = (spark.createDataFrame([(k, "x") for k in keys], "id string, t string") for keys in (["a", "b"], ["c"]))
    assert corpus.checked_merge(base, more, "id").count() == 3
    with pytest.raises(ValueError, match="'a'"):
        corpus.checked_merge(base, base.where("id = 'a'"), "id")
    with pytest.raises(ValueError, match="columns differ"):
        corpus.checked_merge(base, more.withColumn("n", F.lit(1)), "id")
    base.coalesce(1).write.parquet(str(tmp_path / "p"))
    assert [r.rows for r in readers.shard_counts(spark, str(tmp_path / "p")).collect()] == [2]
