"""Split assignment by hash rank, and hash-ordered samples.

Ranks over a whole table don't use one global window: keys are ranked inside ranges of their digest's
first hex digits, and ranges are counted first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.hashing import seeded
from ..functions.text import col


def hash_rank(df: DataFrame, key: str, seed: str | None = "42", by: list[str] | None = None, prefix: int = 2) -> DataFrame:
    """Add rank (from 1) in the order of the digest of seed:key, and total, over all rows or within by.

    Two passes: rows by digest prefix (256 counters a group), then ranks within a prefix.  Equal keys are ordered by key.
    """
    by = by or []
    hashed = df.withColumn("_digest", seeded(key, seed)).withColumn("_range", F.substring("_digest", 1, prefix))
    names = [f"_by{k}" for k in range(len(by))]
    hashed = hashed.withColumns(dict(zip(names, map(F.col, by)))) if by else hashed
    counts = hashed.groupBy(*names, "_range").agg(F.count("*").alias("_n"))
    ahead = (Window.partitionBy(*names) if by else Window.partitionBy()).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*names) if by else Window.partitionBy()  # at most 16 ** prefix rows a group
    counts = counts.withColumns({"_before": F.coalesce(F.sum("_n").over(ahead), F.lit(0)), "total": F.sum("_n").over(whole)})
    right = counts.select(*[F.col(c).alias(f"{c}_") for c in [*names, "_range"]], "_before", "total")
    same = F.col("_range") == F.col("_range_")
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_"))
    inside = Window.partitionBy(*names, "_range").orderBy("_digest", key)
    ranked = hashed.join(right, same).withColumn("rank", (F.col("_before") + F.row_number().over(inside)).cast("bigint"))
    return ranked.drop("_digest", "_range", "_range_", "_before", *names, *[f"{c}_" for c in names])


def group_split(rows: DataFrame, group_by: str = "speaker_id", validation: float = 0.1, test: float = 0.1, seed: str = "42") -> DataFrame:
    """Rows with a split by group: the first groups in hash order are test, the next validation.

    Where all speakers are blank or unknown, groups are source_id.  Rows without a group are one group, named None.  With three
    groups or more test gets one at least, validation too if two are left; validation shrinks until train is not empty.
    """
    if validation < 0 or test < 0 or validation + test >= 1:
        raise ValueError("ratios must be non-negative and sum to less than 1")
    if group_by == "speaker_id":
        known = rows.where(~F.coalesce(F.trim("speaker_id"), F.lit("")).isin("", "unknown"))
        if known.isEmpty():
            group_by = "source_id"
    name = F.coalesce(F.col(group_by).cast("string"), F.lit("None"))
    names = hash_rank(rows.select(name.alias("_name")).distinct(), "_name", seed)
    n = F.col("total")
    t = F.when((n >= 3) & F.lit(test > 0), F.greatest(F.lit(1), F.bround(n * F.lit(test)))).otherwise(F.bround(n * F.lit(test)))
    v = F.when((n - t >= 2) & F.lit(validation > 0), F.greatest(F.lit(1), F.bround(n * F.lit(validation)))).otherwise(F.bround(n * F.lit(validation)))
    v = F.greatest(F.lit(0), F.least(v, n - t - 1))
    split = F.when(F.col("rank") <= t, "test").when(F.col("rank") <= t + v, "validation").otherwise("train")
    chosen = names.select("_name", split.alias("split"))
    return rows.drop("split").withColumn("_group", name).join(chosen, F.col("_group") == F.col("_name")).drop("_name", "_group")


def strata_split(groups: DataFrame, group: str, stratum: str, share: float = 0.1, least: int = 3, seed: str = "42") -> DataFrame:
    """Groups with a split: in each stratum of least groups or more the first share (one at least) in hash order is test, the next as many validation."""
    ranked = hash_rank(groups, group, seed, by=[stratum])
    n = F.greatest(F.lit(1), F.bround(F.col("total") * F.lit(share)))
    split = F.when(F.col("total") < least, "train").when(F.col("rank") <= n, "test").when(F.col("rank") <= 2 * n, "validation").otherwise("train")
    return ranked.withColumn("split", split).drop("rank", "total")


def first_share(df: DataFrame, key: str, share: float, seed: str | None) -> DataFrame:
    """The first share of the rows in hash order, one at least; without a seed the order is of the bare key's digest."""
    ranked = hash_rank(df, key, seed)
    return ranked.where(F.col("rank") <= F.greatest(F.lit(1), F.bround(F.col("total") * F.lit(share)))).drop("rank", "total")


def matched_sample(rows: DataFrame, sizes: DataFrame, key: str = "id", by: str = "source", seed: str = "42") -> DataFrame:
    """As many rows of each source as sizes (by, n) names, first in hash order."""
    return hash_rank(rows, key, seed, by=[by]).join(sizes.withColumnRenamed("n", "_n"), by).where("rank <= _n").drop("rank", "total", "_n")


def ordinal_slice(df: DataFrame, ordinal: str, share: float) -> Column:
    """True for the rows of the first share by ordinal, the border rounded to the nearest row; ordinals run from 0 without gaps."""
    n = df.count()
    return col(ordinal) < F.lit(round(n * share))
