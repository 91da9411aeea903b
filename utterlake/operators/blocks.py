"""Windows over groups of any size: a group is cut into blocks of its order, and blocks are joined by a small table of their own.

A window over a whole group puts a recording of a tenth of all rows into one task.  Here windows run inside (group, block), and a second
window runs over one row a block.  The order must be a number; block is the width of a block on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def with_blocks(rows: DataFrame, by: str, order: str, block: float, heads: dict[str, Column], carried: dict[str, tuple[str, object]]) -> DataFrame:
    """Rows with _block and, by block, the carried columns: heads are aggregates of a block, carried windows over a group's blocks of one of them."""
    cut = rows.withColumn("_block", F.floor(F.col(order) / block))
    table = cut.groupBy(by, "_block").agg(*[c.alias(n) for n, c in heads.items()])
    along = Window.partitionBy(by).orderBy("_block")
    table = table.select(F.col(by).alias("_by"), F.col("_block").alias("_own"), *[make(F.col(n), along).alias(out) for out, (n, make) in carried.items()])
    return cut.join(table, F.col(by).eqNullSafe(F.col("_by")) & F.col("_block").eqNullSafe(F.col("_own")), "left").drop("_by", "_own")


def previous(rows: DataFrame, by: str, order: str, tie: str, value: str, block: float, name: str = "previous") -> DataFrame:
    """Add the value of the row before, in the order of order and tie; null for the first row of a group."""
    last = {"_last": F.max_by(F.struct(value), F.struct(order, tie))}
    told = with_blocks(rows, by, order, block, last, {"_before": ("_last", lambda c, w: F.lag(c).over(w))})
    inner = Window.partitionBy(by, "_block").orderBy(order, tie)
    first = F.row_number().over(inner) == 1
    return told.withColumn(name, F.when(first, F.col(f"_before.{value}")).otherwise(F.lag(value).over(inner))).drop("_block", "_before")


def running_sum(rows: DataFrame, by: str, order: str, tie: str, value: str, block: float, name: str = "running") -> DataFrame:
    """Add the sum of value up to each row of its group, in the order of order and tie; null adds nothing."""
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    told = with_blocks(rows, by, order, block, {"_sum": F.sum(value)}, {"_before": ("_sum", before)})
    inner = Window.partitionBy(by, "_block").orderBy(order, tie).rowsBetween(Window.unboundedPreceding, 0)
    return told.withColumn(name, F.col("_before") + F.coalesce(F.sum(value).over(inner), F.lit(0))).drop("_block", "_before")
