"""Predictions by an injected function: each distinct request once, failures recorded or fatal."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .segments import context_windows

Predictor = Callable[[str, str], str]
BatchPredictor = Callable[[list[tuple[str, str]]], list[str]]


Scorer = Callable[[list[np.ndarray]], list[np.ndarray]]


def emissions(rows: DataFrame, load: Callable[[], Scorer], key: str, pcm: str, core: int = 1000, context: int = 100, hop: int = 320, batch: int = 8) -> DataFrame:
    """Frame scores of whole recordings by an injected scorer, window by window: key, window, scores (frames by symbols).

    Windows hold core frames with context on either side on one grid of hop samples; the scorer takes a list of windows' samples and gives one matrix for each, of
    which the context's frames are cut off.  Windows are rows, so that a long recording is spread over tasks.
    """
    frames = F.greatest(F.floor(F.octet_length(pcm) / F.lit(2 * hop)), F.lit(1))
    window = F.explode(context_windows(frames, core, context)).alias("w")
    stretch = F.substring(F.col(pcm), (F.col("w.start") * (2 * hop) + 1).cast("int"), ((F.col("w.end") - F.col("w.start")) * (2 * hop)).cast("int"))
    parts = rows.where(F.col(pcm).isNotNull()).select(F.col(key).cast("string").alias("key"), pcm, window).select(
        "key", (F.col("w.core_start") / core).cast("bigint").alias("window"), (F.col("w.core_start") - F.col("w.start")).alias("skip"), (F.col("w.core_end") - F.col("w.core_start")).alias("size"), stretch.alias("part")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = load()
        for frame in batches:
            for a in range(0, len(frame), batch):
                some = frame.iloc[a : a + batch]
                got = score([np.frombuffer(x, "<i2").astype(np.float32) / 32768 for x in some["part"]])
                cut = [g[s : s + n].astype(np.float64).tolist() for g, s, n in zip(got, some["skip"], some["size"])]
                yield pd.DataFrame({key: some["key"].to_numpy(), "window": some["window"].to_numpy(), "scores": cut})

    return parts.mapInPandas(run, f"{key} string, window bigint, scores array<array<double>>")


def predict(rows: DataFrame, load: Callable[[], Predictor | BatchPredictor], policy: str = "abort", keys: tuple[str, str] = ("audio", "language"), batch: int | None = None) -> DataFrame:
    """Rows with prediction, error and elapsed; load makes the predictor once for each task.

    policy: abort ends the query at a failure, count_as_empty records it with an empty prediction.  With batch the predictor takes
    a list of so many pairs of keys and gives a list of texts; if it fails, the items of the batch are asked one by one to tell which one failed.
    """
    if policy not in ("abort", "count_as_empty"):
        raise ValueError(policy)
    a, b = keys

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        model = load()
        ask = model if batch else lambda pairs: [model(*p) for p in pairs]

        def answers(pairs: list[tuple[str, str]]) -> list[tuple]:
            start = time.monotonic()
            try:
                texts = list(ask(pairs))
                if len(texts) != len(pairs):
                    raise RuntimeError("not one prediction for each request")
            except Exception as e:
                if policy == "abort":
                    raise
                if len(pairs) > 1:
                    return [row for p in pairs for row in answers([p])]
                return [(*pairs[0], "", f"{type(e).__name__}: {e}", time.monotonic() - start)]
            each = (time.monotonic() - start) / len(pairs)
            return [(*p, t, None, each) for p, t in zip(pairs, texts)]

        for frame in batches:
            pairs = list(zip(frame[a], frame[b]))
            out = [row for k in range(0, len(pairs), batch or 1) for row in answers(pairs[k : k + (batch or 1)])]
            yield pd.DataFrame(out, columns=["_a", "_b", "prediction", "error", "elapsed"])

    asked = rows.select(a, b).distinct().mapInPandas(run, "_a string, _b string, prediction string, error string, elapsed double")
    return rows.join(asked, F.col(a).eqNullSafe(F.col("_a")) & F.col(b).eqNullSafe(F.col("_b"))).drop("_a", "_b")
