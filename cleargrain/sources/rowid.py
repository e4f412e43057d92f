"""Stable row numbers without a single-partition window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROW_ID = "_row_id"


def with_row_ids(df: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """Adds dense row numbers from 0.

    With order_by the numbers follow that order, ties in the order of a hash of the whole row: rows are range-partitioned once by both, so the rows
    of one key spread over tasks, and written to the checkpoint folder, so that the partition counts and the numbers see the same rows. Rows equal in
    every column stay together. Without order_by, numbers follow the order of the partitions as they are.
    """
    from cleargrain.sources.versions import settled

    ordered = df
    if order_by:
        hashed = [f"`{f.name.replace('`', '``')}`" for f in df.schema.fields if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
        keys = [*order_by, F.xxhash64(*[x for c in hashed for x in (F.col(c).isNull(), F.col(c))])]
        ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = settled(ordered.withColumn("_mono", F.monotonically_increasing_id()))
    pid = F.shiftright("_mono", 33)
    counts = placed.groupBy(pid.alias("_pid")).agg(F.count("*").alias("_n"))  # one row per partition
    starts = counts.select("_pid", F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    inside = F.col("_mono") - F.shiftleft(F.col("_pid"), 33)
    numbered = placed.withColumn("_pid", pid).join(F.broadcast(starts), "_pid")
    return numbered.withColumn(ROW_ID, F.col("_start") + inside).select(ROW_ID, *df.columns)
