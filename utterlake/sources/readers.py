"""Readers of manifests, tables, pages, sync files and waves."""

from __future__ import annotations

import io
import math
import wave
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import after_marker, pair_key, safe_id, stem
from .schema import DATASET, MANIFEST

KINDS = dict(x.strip().rsplit(" ", 1) for x in MANIFEST.replace("\n", " ").split(","))


def jsonl(spark: SparkSession, path: str, schema: str = MANIFEST) -> DataFrame:
    """A JSON-lines manifest; blank lines are skipped, a broken line fails, an object in a string column is its JSON text."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """df, if it has the columns."""
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"columns missing: {missing}")
    return df


def resolved(path: Column | str, base: str) -> Column:
    """A path as it is where it is absolute, else below base."""
    c = F.col(path) if isinstance(path, str) else path
    return F.when(c.rlike("^(/|[a-z0-9]+:)"), c).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), c))


def csv_pairs(spark: SparkSession, path: str, default_speaker: str = "unknown", base: str | None = None) -> DataFrame:
    """Audio and text pairs: relative paths are below base; a blank speaker_id is default_speaker, a blank source_id the safe pair key of the audio."""
    df = require(spark.read.csv(path, header=True, escape='"'), ["audio", "text", "speaker_id"])
    given = F.nullif(F.trim("source_id"), F.lit("")) if "source_id" in df.columns else F.lit(None).cast("string")
    df = df.withColumns({"speaker_id": F.coalesce(F.nullif(F.trim("speaker_id"), F.lit("")), F.lit(default_speaker)), "source_id": safe_id(F.coalesce(given, pair_key(stem("audio"))))})
    return df if base is None else df.withColumns({c: resolved(c, base) for c in ("audio", "text")})


def references(rows: DataFrame, audio: str = "audio", text: str = "text") -> DataFrame:
    """audio and reference, the text after the marker, of rows that have one."""
    plain = F.trim(after_marker(text))
    return rows.select(F.col(audio).alias("audio"), plain.alias("reference")).where("reference <> ''")


def parquet_split(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """Parquet shards of a split, told by the file names: split-*.parquet."""
    return spark.read.option("pathGlobFilter", f"{split}-*.parquet").parquet(folder).withColumn("split", F.lit(split))


def dataset_folder(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A data set on disk: Arrow stream shards in a folder for each split, which a state file beside the shards names in order.

    Result: the columns of the schema, with the shard's split and number.
    """
    state = "_data_files array<struct<filename: string>>"
    named = spark.read.schema(state).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "state.json").json(folder)
    shards = named.select(F.regexp_extract("_metadata.file_path", "^(.*)/[^/]*$", 1).alias("dir"), F.posexplode("_data_files").alias("shard", "f"))
    paths = shards.select(F.concat("dir", F.lit("/"), "f.filename").alias("path"), F.regexp_extract("dir", "[^/]*$", 0).alias("split"), "shard")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path, split, shard in zip(*(batch[c].to_pylist() for c in ("path", "split", "shard"))):
                system, name = fs.FileSystem.from_uri(path)
                with system.open_input_stream(name) as data, pa.ipc.open_stream(data) as reader:
                    for rows in reader:
                        yield rows.append_column("split", pa.array([split] * rows.num_rows)).append_column("shard", pa.array([shard] * rows.num_rows, pa.int32()))

    fixed = paths.withColumn("path", F.regexp_replace("path", "^file:/+", "file:///"))
    return fixed.repartition(spark.sparkContext.defaultParallelism, "path").mapInArrow(read, f"{schema}, split string, shard int")


def shard_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of each Parquet file below a folder, with its name; no column is read."""
    files = spark.read.option("recursiveFileLookup", True).parquet(folder)
    return files.select(F.col("_metadata.file_name").alias("file")).groupBy("file").agg(F.count("*").alias("rows"))


def peek(df: DataFrame) -> dict | None:
    """The first row, read without the rest."""
    row = df.first()
    return row.asDict(recursive=True) if row else None


def csv_files(spark: SparkSession, pattern: str) -> DataFrame:
    """Several CSV files with the path of each row's file."""
    return spark.read.csv(pattern, header=True, escape='"').withColumn("file", F.col("_metadata.file_path"))


def tsv(spark: SparkSession, path: str, quoted: bool = True) -> DataFrame:
    """A table with tabs, all strings; without quoting empty cells are kept as empty strings."""
    if quoted:
        return spark.read.csv(path, sep="\t", header=True, escape='"')
    df = spark.read.csv(path, sep="\t", header=True, quote="")
    return df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in df.columns])


def texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files without a byte order mark: path, text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^\\x{feff}", "").alias("text"))


def files(spark: SparkSession, folder: str, pattern: str = "*", content: bool = False) -> DataFrame:
    """Files below a folder: path, length and, if wanted, content."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return df.select("path", "length", *(["content"] if content else []))


def arrow_streams(spark: SparkSession, folder: str, schema: str, pattern: str = "*.arrow") -> DataFrame:
    """Rows of Arrow IPC stream files, batch by batch; the files are the unit of work and are opened where they are read."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path in batch["path"].to_pylist():
                system, name = fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{path}")
                with system.open_input_stream(name) as data, pa.ipc.open_stream(data) as reader:
                    yield from reader

    found = files(spark, folder, pattern).select(F.regexp_replace("path", "^file:/+", "file:///").alias("path"))
    return found.repartition(spark.sparkContext.defaultParallelism, "path").mapInArrow(read, schema)


def dataset_columns(rows: DataFrame) -> DataFrame:
    """The fixed columns of the built data set, those that rows lack null."""
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(KINDS[c]).alias(c) for c in DATASET])


def split_of_file(path: Column) -> Column:
    """The split in a file's name."""
    return F.regexp_extract(path, r"([^/]+?)[-_.][^/]*$", 1)


def sync_times(xml: Column | str) -> Column:
    """Milliseconds of the sync entries whose verse order is not negative."""
    return F.transform(F.xpath(xml, F.lit("//SyncInfo[VerseOrder>=0]/AudioMiliseconds/text()")), lambda x: F.trim(x).cast("bigint"))


class Verses(HTMLParser):
    """Paragraph texts inside verse blocks of a poem."""

    def __init__(self) -> None:
        super().__init__()
        self.open: list[tuple[str, set[str]]] = []
        self.found: list[str] = []
        self.text: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("br", "img", "input", "meta", "link", "hr", "source"):
            return
        self.open.append((tag, set((dict(attrs).get("class") or "").split())))
        names = [c for t, c in self.open if t == "div"]
        poem = next((k for k, c in enumerate(names) if "poem" in c), None)
        if tag == "p" and poem is not None and any(c & {"b", "b2"} for c in names[poem + 1 :]):
            self.text = []

    def handle_endtag(self, tag: str) -> None:
        if tag == "p" and self.text is not None:
            if text := "".join(self.text).strip():
                self.found.append(text)
            self.text = None
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break

    def handle_data(self, data: str) -> None:
        if self.text is not None:
            self.text.append(data.strip())


@F.pandas_udf(T.ArrayType(T.StringType()))
def verses(pages: pd.Series) -> pd.Series:
    """Verses of poem pages, in order."""

    def one(page: str | None) -> list[str]:
        parser = Verses()
        parser.feed(page or "")
        return parser.found

    return pages.map(one)


def media_links(page: Column | str) -> Column:
    """Addresses in src attributes of audio elements."""
    return F.regexp_extract_all(page, F.lit(r'<(?:audio|source)[^>]*\ssrc="([^"]+)"'), 1)


def resampled(samples: np.ndarray, own: int, rate: int, lobes: int = 10, beta: float = 5.0) -> np.ndarray:
    """Samples at another rate: polyphase filtering by a Kaiser-windowed sinc of unit gain, cut off at the lower of both Nyquist frequencies.

    Output k is the band-limited signal at time k * own / rate; beyond both ends the signal is zero.
    """
    common = math.gcd(own, rate)
    up, down = rate // common, own // common
    if up == down or not len(samples):
        return samples
    half = lobes * max(up, down)
    taps = np.arange(-half, half + 1)
    window = np.sinc(taps / max(up, down)) * np.kaiser(2 * half + 1, beta)
    window *= up / window.sum()
    n = -(-len(samples) * up // down)
    out = np.zeros(n)
    at = np.arange(n) * down
    # One phase of the filter a turn: all outputs that use it are one product.
    for phase in range(up):
        own_out = np.flatnonzero(at % up == phase)
        if not len(own_out):
            continue
        tap = window[(phase + half) % up :: up]
        first = (at[own_out] + half) // up
        index = first[:, None] - np.arange(len(tap))[None, :]
        ok = (index >= 0) & (index < len(samples))
        out[own_out] = (np.where(ok, samples[np.clip(index, 0, len(samples) - 1)], 0) * tap).sum(1)
    return out


def pcm_of_wave(data: bytes, rate: int = 16_000) -> bytes | None:
    """16-bit mono samples at one rate of a PCM wave file of 8, 16, 24 or 32 bits; null if it can't be read."""
    try:
        with wave.open(io.BytesIO(data)) as w:
            channels, width, own, raw = w.getnchannels(), w.getsampwidth(), w.getframerate(), w.readframes(w.getnframes())
    except (wave.Error, EOFError):
        return None
    if width == 3:
        # Three bytes a sample become the upper three of four.
        wide = np.zeros((len(raw) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(raw, np.uint8)[: len(raw) // 3 * 3].reshape(-1, 3)
        samples = wide.view("<i4").ravel() / float(1 << 31)
    else:
        samples = np.frombuffer(raw, {1: np.uint8, 2: "<i2", 4: "<i4"}[width]).astype(np.float64)
        samples = (samples - 128) / 128 if width == 1 else samples / float(1 << (8 * width - 1))
    mono = resampled(samples[: len(samples) // channels * channels].reshape(-1, channels).mean(axis=1), own, rate)
    return np.rint(np.clip(mono, -1, 1 - 1 / 32768) * 32768).astype("<i2").tobytes()


@F.pandas_udf(T.BinaryType())
def decode_wave(data: pd.Series) -> pd.Series:
    """PCM samples of wave files (16 kHz, mono, 16 bits); null where they can't be read."""
    return data.map(lambda x: None if x is None else pcm_of_wave(bytes(x)))


@F.pandas_udf(T.BinaryType())
def encode_wave(pcm: pd.Series) -> pd.Series:
    """Wave files of PCM samples at 16 kHz."""

    def one(x: bytes | None) -> bytes | None:
        if x is None:
            return None
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setparams((1, 2, 16_000, 0, "NONE", ""))
            w.writeframes(bytes(x))
        return out.getvalue()

    return pcm.map(one)


def pcm_seconds(pcm: Column | str, rate: int = 16_000) -> Column:
    return F.octet_length(pcm) / F.lit(2 * rate)


def pcm_slice(pcm: Column | str, start: Column, end: Column) -> Column:
    """Samples from start to end."""
    return F.substring(pcm, (start * 2 + 1).cast("int"), ((end - start) * 2).cast("int"))


def recording_of(source: str, path: Column) -> Column:
    """The recording a clip belongs to, by the corpus it comes from, with the corpus before it."""
    name = F.regexp_replace(F.regexp_extract(path, r"[^/]*$", 0), r"(?<=.)\.[^.]*$", "")
    if source == "ganjoor":
        group = F.regexp_replace(name, "_chunk_.*$", "")
    elif source == "filimo":
        group = F.when(name.rlike(r"^\d{10}$"), F.substring(name, 1, 5)).otherwise(F.regexp_extract(path, r"([^/]+)/[^/]*$", 1))
    elif source == "seniortalk":
        # The recording is the first group alone: both speakers of one are one recording.
        group = F.coalesce(F.nullif(F.regexp_extract(name, r"^(Elderly\d+)(S\d+)", 1), F.lit("")), name)
    else:
        group = name
    return F.concat(F.lit(f"{source}:"), group)


def speaker_of(path: Column) -> Column:
    """The speaker in a two-part clip name, or unknown."""
    name = F.regexp_extract(path, r"[^/]*$", 0)
    return F.coalesce(F.nullif(F.regexp_extract(name, r"^(Elderly\d+)(S\d+)", 2), F.lit("")), F.lit("unknown"))
