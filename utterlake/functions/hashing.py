"""Seeded hashing and rounding that equal the plain-Python ones."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def seeded(key: Column | str, seed: str | None = "42", joint: str = ":") -> Column:
    """Hex digest of seed:key, or of the bare key without a seed; its order is the order of the number."""
    return F.sha2(col(key) if seed is None else F.concat(F.lit(f"{seed}{joint}"), col(key)), 256)


def bucket(key: Column | str, seed: str = "42") -> Column:
    """A number from 0 to 99: the first 48 bits of the digest of seed:key, modulo 100."""
    return F.conv(F.substring(seeded(key, seed), 1, 12), 16, 10).cast("bigint") % 100


def bucket_split(key: Column | str, test: int = 10, validation: int = 20) -> Column:
    """Split by hash bucket: below test, below validation, or train."""
    b = bucket(key)
    return F.when(b < test, "test").when(b < validation, "validation").otherwise("train")


def python_round(c: Column | str, digits: int) -> Column:
    """Half-even rounding of the exact binary value, as Python's round()."""

    def run(x: pa.Array) -> pa.Array:
        return pa.array([None if v is None else round(v, digits) for v in x.to_pylist()], pa.float64())

    return F.arrow_udf(run, "double")(c)
