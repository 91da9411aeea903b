"""Augmentation as a plan over rows: which named groups change a row is decided by seeded digests, so any task may draw it again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The groups in order, with the probability of each, and other names for them.
GROUPS = {"background": 0.75, "gain": 0.8, "speed": 0.9, "pause": 0.7, "rir": 0.5, "distortion": 0.8, "frequency": 0.8}
ALIASES = {"TimeStretch": "speed", "InsertPause": "pause", "AddBackgroundNoise": "background", "ApplyImpulseResponse": "rir", "Gain": "gain", "quality": "distortion", "filters": "frequency"}


def groups(exclude: list[str]) -> dict[str, float]:
    """The groups that are left, in order; an unknown exclusion is an error."""
    out = {ALIASES.get(x, x) for x in exclude}
    if unknown := sorted(out - set(GROUPS)):
        raise ValueError(f"unknown augmentation exclusions: {unknown}")
    return {g: p for g, p in GROUPS.items() if g not in out}


def uniform(key: Column | str, label: str, seed: int) -> Column:
    """A number from 0 to 1 (exclusive) of 32 bits, by the digest of key, label and seed."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", key, F.lit(label), F.lit(str(seed))), 256), 1, 8), 16, 10).cast("double") / float(1 << 32)


def plan(rows: DataFrame, key: str = "id", exclude: list[str] | None = None, probability: float = 0.5, seed: int = 42, enabled: bool = True) -> DataFrame:
    """Add augmentation: the names of the groups to apply, in order; only training rows are augmented."""
    left = groups(exclude or []) if enabled else {}
    chosen = F.filter(F.array(*[F.when(uniform(key, g, seed) < p, F.lit(g)) for g, p in left.items()]).cast("array<string>"), lambda x: x.isNotNull())
    on = (F.col("split") == "train") & (uniform(key, "any", seed) < probability)
    return rows.withColumns({"apply_augmentation": F.col("split") == "train", "augmentation": F.when(on, chosen).otherwise(F.array().cast("array<string>"))})
