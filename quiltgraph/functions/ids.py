"""Canonical ids: a partition in the upper 32 bits, a rank in the lower."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiltgraph.plans.storage import materialise

#: Rows up to which a group is ranked by one window; larger tables are ranked range by range.
WINDOW_ROWS = 1_000_000


def packed_id(partition: Column, rank: Column) -> Column:
    return F.shiftleft(partition.cast("bigint"), 32).bitwiseOR(rank.cast("bigint"))


def partition_of(packed: Column) -> Column:
    return F.shiftright(packed, 32).cast("int")


def with_rank(df: DataFrame, group: str, order: list[str], name: str, window_rows: int = WINDOW_ROWS, weight: str | None = None) -> DataFrame:
    """df with the rank from 0 of each row in its group, by the order columns (ties must not matter); or, with a weight, the sum
    of that column over the rows before.

    A few groups may hold all rows, so a large table is cut into sorted ranges of (group, order), ranked
    within each, and the sizes of the ranges before are added; no task holds a whole group.
    """
    def before(*groups: str) -> Column:
        w = Window.partitionBy(*groups).orderBy(*order)
        if weight is None:
            return F.row_number().over(w) - 1
        return F.coalesce(F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    if df.count() <= window_rows:
        return df.withColumn(name, before(group))
    ranged = materialise(df.repartitionByRange(group, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy(group, "_range").agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("_n"))
    earlier = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    ranked = ranged.withColumn("_own", before(group, "_range"))
    return ranked.join(sizes, [group, "_range"]).withColumn(name, F.col("_before") + F.col("_own")).select(*df.columns, name)
