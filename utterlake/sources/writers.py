"""Sinks. All refuse to write over what is there; Spark's committer makes each one whole or nothing."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import prompt


def jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


BOM = "\ufeff"


def marked(df: DataFrame, bom: bool) -> DataFrame:
    """df with a byte order mark before its header, as every file begins with the header."""
    return df.withColumnRenamed(df.columns[0], BOM + df.columns[0]) if bom else df


def tsv(df: DataFrame, path: str, columns: list[str], mode: str = "errorifexists", bom: bool = False) -> None:
    """The columns as text with tabs, null and missing ones as empty."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")
    marked(df.select(*[cell(c).alias(c) for c in columns]), bom).write.mode(mode).csv(path, sep="\t", header=True, emptyValue="")


def csv(df: DataFrame, path: str, mode: str = "errorifexists", bom: bool = False) -> None:
    marked(df, bom).write.mode(mode).csv(path, header=True, escape='"')


def document(df: DataFrame, path: str) -> None:
    """The one row of df as a JSON document in one file, written beside its place and moved there whole; it replaces an older one."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a document is one row")
    whole(df, path, json.dumps(rows[0].asDict(recursive=True), ensure_ascii=False, indent=2, default=str))


def report(df: DataFrame, path: str, title: str, most: int = 1000) -> None:
    """A small table as Markdown; more than most rows are an error, not a shorter report."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    cell = lambda v: "—" if v is None else str(v).replace("|", "\\|")
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]
    whole(df, path, "\n".join(lines) + "\n")


def whole(df: DataFrame, path: str, text: str) -> None:
    """Text in a file of any file system, moved into place when it is complete."""
    context = df.sparkSession.sparkContext
    jvm = context._jvm
    target, draft = (jvm.org.apache.hadoop.fs.Path(x) for x in (path, f"{path}.tmp"))
    system = target.getFileSystem(context._jsc.hadoopConfiguration())
    out = system.create(draft, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if system.exists(target):
        system.delete(target, False)
    if not system.rename(draft, target):
        raise OSError(f"{path} could not be put in place")


def embedded(df: DataFrame, audio: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A corpus whose audio column is the file's bytes and name: audio has path and content; a row without its file is an error."""
    file = audio.select(F.col("path").alias("_path"), "content")
    name = F.regexp_extract("audio", r"[^/]*$", 0)
    content = F.coalesce("content", F.raise_error(F.concat(F.lit("no file for "), F.col("audio"))).cast("binary"))
    joined = df.join(file, F.col("audio") == F.col("_path"), "left").withColumn("audio", F.struct(content.alias("bytes"), name.alias("path"))).drop("_path", "content")
    corpus(joined, path, mode)


def corpus(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet with a folder for each split."""
    df.write.mode(mode).partitionBy("split").parquet(path)


def prompts(df: DataFrame, path: str, language: str | None = None, text: str = "text", mode: str = "errorifexists") -> None:
    """audio and the label of a speech model, as JSON lines."""
    label = prompt(F.lit(language) if language else F.col("language"), F.col(text))
    jsonl(df.select("audio", label.alias("text")), path, mode)


def accepted_and_rejected(df: DataFrame, path: str, reasons: str = "reasons", mode: str = "errorifexists") -> None:
    """Rows without reasons as a corpus, the others with their reasons as JSON lines; the plan is run once, to a flagged table, and both are read from it."""
    spark = df.sparkSession
    flagged = f"{path}/flagged"
    df.withColumn("_accepted", F.size(reasons) == 0).write.mode(mode).partitionBy("_accepted").parquet(flagged)
    kept = spark.read.schema(df.schema.add("_accepted", "boolean")).parquet(flagged)
    corpus(kept.where("_accepted").drop("_accepted", reasons), f"{path}/accepted", mode)
    jsonl(kept.where("not _accepted").drop("_accepted"), f"{path}/rejected", mode)


def conflicts(new: DataFrame, old: DataFrame, key: str, digest: str) -> DataFrame:
    """Keys written before with other content."""
    return new.join(old.select(key, F.col(digest).alias("_old")), key).where(F.col(digest) != F.col("_old")).select(key)


def add_new(new: DataFrame, path: str, key: str, digest: str) -> None:
    """Append the rows whose key is not at path yet; a key that is there with other content stops it before anything is written."""
    old = new.sparkSession.read.parquet(path).select(key, digest)
    if bad := conflicts(new, old, key, digest).limit(10).collect():
        raise ValueError(f"written before with other content: {sorted(r[0] for r in bad)}")
    new.join(old.select(key), key, "left_anti").write.mode("append").parquet(path)
