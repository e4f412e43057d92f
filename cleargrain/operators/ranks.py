"""Exact medians of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cleargrain.sources.versions import settled


def grouped_median(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """keys and the median of value (double; null where a group has no value): one row per group, nulls among the keys included.

    Equal values of a group are counted first. What is left is dealt by ranges of (group, value), so a group of any size spreads over tasks; a
    prefix sum over the ranges' counts says in which range of each group the middle ranks lie, and only those are sorted.
    """
    group = F.struct(*[F.col(f"`{k}`") for k in keys]) if keys else F.struct(F.lit(0).alias("whole"))
    counted = rows.select(group.alias("_group"), F.col(f"`{value}`").cast("double").alias("_value")).groupBy("_group", "_value").agg(F.count("*").alias("_n"))
    counted = settled(counted.repartitionByRange("_group", "_value").withColumn("_part", F.spark_partition_id()))
    filled = counted.where("_value is not null")
    before = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = filled.groupBy("_group", "_part").agg(F.sum("_n").alias("_size"))
    ranges = ranges.select(
        "_group", "_part", "_size", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"), F.sum("_size").over(Window.partitionBy("_group")).alias("_total")
    )
    holds = lambda rank, start, size: (rank >= start) & (rank < start + size)
    middle = [F.expr("(_total - 1) div 2"), F.expr("_total div 2")]
    wanted = ranges.where(holds(middle[0], F.col("_start"), F.col("_size")) | holds(middle[1], F.col("_start"), F.col("_size")))
    inside = Window.partitionBy("_group", "_part").orderBy("_value").rowsBetween(Window.unboundedPreceding, 0)
    placed = filled.join(wanted, ["_group", "_part"]).withColumn("_first", F.col("_start") + F.sum("_n").over(inside) - F.col("_n"))
    picked = placed.where(holds(middle[0], F.col("_first"), F.col("_n")) | holds(middle[1], F.col("_first"), F.col("_n"))).select("_group", F.col("_value").alias("_pick"))
    every = counted.select("_group", F.lit(None).cast("double").alias("_pick"))
    found = picked.unionByName(every).groupBy("_group").agg((F.min("_pick") + (F.max("_pick") - F.min("_pick")) * 0.5).alias(name))
    if not keys:
        return found.agg(F.max(name).alias(name))
    return found.select(*[F.col(f"_group.`{k}`").alias(k) for k in keys], name)
