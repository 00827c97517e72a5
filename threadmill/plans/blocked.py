"""Ordered operators over groups of any size: windows run over blocks of positions, and blocks are joined up.

A window partitioned by a session puts a session that holds a third of all rows into one task. Here a group is parted
into blocks of WIDTH positions; each block is a window partition of its own, and a small table with one row per block
carries what crosses the seams (sums so far, the last row before).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Positions in a block.
WIDTH = 4096


def _blocks(df: DataFrame, pos: str, width: int) -> DataFrame:
    return df.withColumn("_blk", F.floor(F.col(pos) / width))


def running_sum(df: DataFrame, keys: list[str], pos: str, value: Column, out: str, width: int = WIDTH) -> DataFrame:
    """df with out: the sum of value over the group's rows up to and with this one, by position (positions are unique)."""
    d = _blocks(df, pos, width).withColumn("_v", value.cast("long"))
    inside = Window.partitionBy(*keys, "_blk").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    before = d.groupBy(*keys, "_blk").agg(F.sum("_v").alias("_s")).select(*keys, "_blk", F.coalesce(F.sum("_s").over(across), F.lit(0)).alias("_before"))
    return (
        d.withColumn("_in", F.sum("_v").over(inside)).join(before, [*keys, "_blk"])
        .withColumn(out, F.col("_before") + F.coalesce("_in", F.lit(0))).drop("_blk", "_v", "_in", "_before")
    )


def previous(df: DataFrame, keys: list[str], pos: str, value: Column, out: str, width: int = WIDTH) -> DataFrame:
    """df with out: value on the row before in the group, by position; null on the first."""
    d = _blocks(df, pos, width).withColumn("_v", F.struct(value.alias("v")))
    inside = Window.partitionBy(*keys, "_blk").orderBy(pos)
    across = Window.partitionBy(*keys).orderBy("_blk")
    before = d.groupBy(*keys, "_blk").agg(F.max_by("_v", pos).alias("_last")).select(*keys, "_blk", F.lag("_last").over(across).alias("_before"))
    return (
        d.withColumn("_lag", F.lag("_v").over(inside)).join(before, [*keys, "_blk"])
        .withColumn(out, F.coalesce("_lag", "_before")["v"]).drop("_blk", "_v", "_lag", "_before")
    )


def rank_from_end(df: DataFrame, keys: list[str], pos: str, out: str, width: int = WIDTH) -> DataFrame:
    """df with out: 1 on the last row of the group, 2 on the one before, and so on."""
    d = _blocks(df, pos, width)
    inside = Window.partitionBy(*keys, "_blk").orderBy(F.desc(pos))
    across = Window.partitionBy(*keys).orderBy(F.desc("_blk")).rowsBetween(Window.unboundedPreceding, -1)
    after = d.groupBy(*keys, "_blk").agg(F.count("*").alias("_n")).select(*keys, "_blk", F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_after"))
    return d.withColumn("_rn", F.row_number().over(inside)).join(after, [*keys, "_blk"]).withColumn(out, F.col("_after") + F.col("_rn")).drop("_blk", "_rn", "_after")
