"""Readings that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: All blanks, for patterns.
BLANKS = r"(?U)\s+"


def split_name(split: Column | str) -> Column:
    """train, validation or test: case and outer blanks are dropped, dev and valid mean validation; blank is null."""
    c = F.col(split) if isinstance(split, str) else split
    name = F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    return F.when(name.isin("dev", "valid"), "validation").when(name != "", name)


def not_blank(text: Column | str) -> Column:
    """True where a text has something but blanks; null is blank."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(c.rlike(r"(?U)\S"), F.lit(False))


def row_slices(texts: pa.Array, most_bytes: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts together have about most_bytes at most; a longer text is alone."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(sizes):
        done = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, done + most_bytes, side="right")))
        yield start, stop
        start = stop


#: Words of 64 bits of a filter of keys.
FILTER_WORDS = 1 << 18


def id_filter(rows: DataFrame, key: str) -> np.ndarray:
    """A bit for the hash of every key, in a table of fixed size (2 MB)."""
    at = F.xxhash64(key)
    word = rows.select(F.shiftrightunsigned(at, 6).bitwiseAND(F.lit(FILTER_WORDS - 1)).cast("int").alias("word"), at.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    got = word.groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits")).toArrow()  # at most FILTER_WORDS rows
    bits = np.zeros(FILTER_WORDS, np.uint64)
    bits[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return bits


def may_hold(key: str, bits: np.ndarray) -> Column:
    """False only for keys that are not in the filter."""

    def run(hashes: pa.Array) -> pa.Array:
        h = hashes.to_numpy().view(np.uint64)
        return pa.array((bits[(h >> np.uint64(6)).astype(np.int64) & (FILTER_WORDS - 1)] >> (h & np.uint64(63))) & np.uint64(1) > 0)

    return F.arrow_udf(run, "boolean")(F.xxhash64(key))
