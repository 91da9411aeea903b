"""Readers, sinks and streams."""

import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from utterlake.sources import readers, writers
from utterlake.streaming import merge


def test_jsonl(spark, tmp_path):
    path = tmp_path / "m.jsonl"
    path.write_text('{"id": "a", "text": "سلام", "alignment_method": {"name": "x"}}\n\n{"id": "b", "alignment_method": "plain"}\n', encoding="utf-8")
    got = {r.id: r.alignment_method for r in readers.jsonl(spark, str(path)).collect()}
    assert json.loads(got["a"]) == {"name": "x"} and got["b"] == "plain"
    path.write_text("{broken\n")
    with pytest.raises(Exception):
        readers.jsonl(spark, str(path)).collect()


def test_tables(spark, tmp_path):
    path = tmp_path / "cv.tsv"
    path.write_text('path\tsentence\tage\nx.mp3\tsaid "hi"\t\n', encoding="utf-8")
    assert [tuple(r) for r in readers.tsv(spark, str(path), quoted=False).collect()] == [("x.mp3", 'said "hi"', "")]
    path.write_text("audio,text,speaker_id\na,b, \n")
    assert readers.csv_pairs(spark, str(path)).first().speaker_id == "unknown"
    with pytest.raises(ValueError, match="speaker_id"):
        path.write_text("audio,text\na,b\n")
        readers.csv_pairs(spark, str(path))


def test_arrow_stream(spark, tmp_path):
    table = pa.table({"id": ["a", "b"], "n": [1, 2]})
    for k in range(2):
        with pa.ipc.new_stream(str(tmp_path / f"{k}.arrow"), table.schema) as w:
            w.write_table(table)
    assert readers.arrow_streams(spark, str(tmp_path), "id string, n bigint").groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").collect() == [("a", 2), ("b", 4)]


def test_sync_and_pages(spark):
    xml = "<R><SyncInfo><VerseOrder>-1</VerseOrder><AudioMiliseconds>1</AudioMiliseconds></SyncInfo><SyncInfo><VerseOrder>0</VerseOrder><AudioMiliseconds>100</AudioMiliseconds></SyncInfo></R>"
    html = '<div class="poem"><div class="b"><div class="m1"><p>one</p></div><p> two<br>three</p></div><div class="x"><p>no</p></div></div><div class="b"><p>out</p></div><audio src="u.mp3"></audio>'
    df = spark.createDataFrame([(xml, html)], "x string, h string")
    r = df.select(readers.sync_times("x"), readers.verses("h"), readers.media_links("h")).first()
    assert r[0] == [100] and r[1] == ["one", "twothree"] and r[2] == ["u.mp3"]


def test_wave_round_trip(spark):
    pcm = (np.arange(-500, 500) * 60).astype("<i2").tobytes()
    df = spark.createDataFrame([(pcm,), (None,)], "p binary").withColumn("w", readers.encode_wave("p"))
    got = [r[0] for r in df.select(readers.decode_wave("w")).collect()]
    assert got[0] == pcm and got[1] is None
    assert spark.createDataFrame([(b"junk",)], "w binary").select(readers.decode_wave("w")).first()[0] is None
    part = spark.createDataFrame([(pcm,)], "p binary").select(readers.pcm_slice("p", F.lit(10), F.lit(12)), readers.pcm_seconds("p")).first()
    assert bytes(part[0]) == pcm[20:24] and part[1] == 1000 / 16000


@pytest.mark.parametrize(("source", "path", "want"), [("ganjoor", "x/p1_chunk_3.wav", "ganjoor:p1"), ("filimo", "f/1234567890.wav", "filimo:12345"), ("filimo", "f/abc.wav", "filimo:f"), ("seniortalk", "Elderly0001S0002W0003.wav", "seniortalk:Elderly0001"), ("seniortalk", "x.wav", "seniortalk:x"), ("mozilla", "a/b.mp3", "mozilla:b")])
def test_recordings(spark, source, path, want):
    assert spark.range(1).select(readers.recording_of(source, F.lit(path))).first()[0] == want


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "train", ["x"], None), ("b", "test", [], "سلام")], "id string, split string, reasons array<string>, text string")
    writers.accepted_and_rejected(df, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/accepted")).first().split == "test"
    assert spark.read.json(str(tmp_path / "out/rejected")).first().id == "a"
    with pytest.raises(Exception):
        writers.accepted_and_rejected(df, str(tmp_path / "out"))
    writers.tsv(df, str(tmp_path / "t"), ["id", "text"])
    assert sorted(readers.tsv(spark, str(tmp_path / "t"), quoted=False).collect()) == [("a", ""), ("b", "سلام")]


def test_merge_stream(spark, tmp_path):
    for k, ids in enumerate((["a", "b"], ["b", "c", "c"])):
        spark.createDataFrame([(x, k) for x in ids], "id string, k int").write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id string, k int").parquet(str(tmp_path / "in"))
        merge.merge_stream(stream, str(tmp_path / "out"), "id", str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


def test_stream_counts_equal_batch(spark, folder, tmp_path):
    schema = spark.read.parquet(f"{folder}/utterances.parquet").schema
    spark.read.parquet(f"{folder}/utterances.parquet").repartition(2).write.parquet(str(tmp_path / "u"))
    stream = merge.delivery_counts(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "u")).withColumn("ingested_at", F.col("ingested_at").cast("timestamp")), late="3650 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = merge.delivery_counts(spark.read.parquet(f"{folder}/utterances.parquet").withColumn("ingested_at", F.col("ingested_at").cast("timestamp")))
    pick = lambda df: sorted((r.day, r.source, r.rows) for r in df.collect())
    assert pick(spark.table("counts")) == pick(batch)


@pytest.mark.parametrize(("own", "rate"), [(44_100, 16_000), (48_000, 16_000), (8_000, 16_000), (22_050, 16_000)])
def test_resampling(own, rate):
    t = np.arange(own) / own
    low = 0.5 * np.sin(2 * np.pi * 440 * t)
    got = readers.resampled(low, own, rate)
    want = 0.5 * np.sin(2 * np.pi * 440 * np.arange(len(got)) / rate)
    assert len(got) == rate and np.abs(got - want)[200:-200].max() < 2e-3
    if own > 2 * 10_000:  # a tone above the new Nyquist frequency goes instead of coming back as another tone
        assert np.abs(readers.resampled(np.sin(2 * np.pi * 9_900 * t), own, rate))[200:-200].max() < 0.02
    # The same as the filter written out for each output.
    x = np.random.default_rng(3).standard_normal(60)
    g = np.gcd(own, rate)
    up, down = rate // g, own // g
    half = 10 * max(up, down)
    window = np.sinc(np.arange(-half, half + 1) / max(up, down)) * np.kaiser(2 * half + 1, 5.0)
    window *= up / window.sum()
    stuffed = np.zeros(len(x) * up)
    stuffed[::up] = x
    whole = np.convolve(stuffed, window)[half:]
    assert np.allclose(readers.resampled(x, own, rate), whole[: len(x) * up : down][: -(-len(x) * up // down)])


def test_wave_of_24_bits():
    import io
    import wave

    samples = np.array([0, 1 << 22, -(1 << 23), (1 << 23) - 1])
    raw = b"".join(int(x).to_bytes(3, "little", signed=True) for x in samples)
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setparams((1, 3, 16_000, 0, "NONE", ""))
        w.writeframes(raw)
    assert np.frombuffer(readers.pcm_of_wave(out.getvalue()), "<i2").tolist() == [0, 1 << 14, -(1 << 15), (1 << 15) - 1]


def test_distinct_deliveries(spark, tmp_path):
    import datetime as dt

    day = lambda d: dt.datetime(2024, 1, d)
    for k, rows in enumerate(([("a", day(1)), ("b", day(2)), ("a", day(2))], [("a", day(3)), ("c", day(3))])):
        spark.createDataFrame(rows, "id string, ingested_at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id string, ingested_at timestamp").parquet(str(tmp_path / "in"))
        q = merge.distinct_deliveries(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]
