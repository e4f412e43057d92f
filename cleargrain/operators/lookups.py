"""Left joins with a table of keys, of which a few may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cleargrain.operators.profile import quoted
from cleargrain.sources.rowid import ROW_ID
from cleargrain.sources.versions import settled

#: Tables are broadcast up to this size, with ROW_BYTES for each row besides its texts.
BROADCAST_BYTES, ROW_BYTES = 4_000_000, 64
#: A key is hot if it has more than the HOT_KEYS-th part of the rows, so no more than that many are.
HOT_KEYS = 1_000


def _bytes(table: DataFrame) -> Column:
    texts = [F.coalesce(F.octet_length(quoted(f.name)), F.lit(0)) for f in table.schema.fields if isinstance(f.dataType, T.StringType)]
    return sum(texts, F.lit(ROW_BYTES))


def hot_keys(table: DataFrame, total: int) -> DataFrame:
    """The rows of the hot keys, the most frequent first, as far as they fit a broadcast."""
    order = Window.orderBy(F.desc("_rows"), "_k").rowsBetween(Window.unboundedPreceding, 0)
    few = table.where(F.col("_rows") * HOT_KEYS > total)  # HOT_KEYS rows at most, so one window may take them
    return few.withColumn("_size", F.sum(_bytes(table)).over(order)).where(F.col("_size") <= BROADCAST_BYTES).drop("_size")


def looked_up(df: DataFrame, table: DataFrame, key: Column) -> DataFrame:
    """df left joined with table on key, under the table's own column names.

    table holds _k (as key, a struct of two hashes; each once), _rows (how many rows of df have it) and the columns to add; a frequent key that
    has nothing to add is listed with nulls. Small tables are broadcast. Of larger ones the hot keys are, and their rows, like those with a null
    key, take a key of their own through the shuffle that joins the others: no key, however frequent, meets in one task.
    """
    table = settled(table)
    added = [c for c in table.columns if c not in ("_k", "_rows")]
    size, total = table.agg(F.sum(_bytes(table)), F.sum("_rows")).first()
    keyed = df.withColumn("_k", key)
    if (size or 0) <= BROADCAST_BYTES:
        return keyed.join(F.broadcast(table.drop("_rows")), "_k", "left").select(*map(quoted, df.columns), *added)
    row = F.col(ROW_ID) if ROW_ID in df.columns else F.monotonically_increasing_id()
    own = F.struct(F.xxhash64(F.lit(2), row).alias("a"), F.xxhash64(F.lit(3), row).alias("b"))
    hot = hot_keys(table, total).select(F.col("_k").alias("_hot_k"), F.struct(*added).alias("_hot"))
    rest = table.select(F.col("_k").alias("_rest_k"), F.struct(*added).alias("_rest"))
    spread = keyed.join(F.broadcast(hot), F.col("_k") == F.col("_hot_k"), "left").withColumn("_k", F.when(F.col("_hot_k").isNotNull() | F.col("_k").isNull(), own).otherwise(F.col("_k")))
    joined = spread.join(rest, F.col("_k") == F.col("_rest_k"), "left")
    return joined.withColumn("_found", F.when(F.col("_hot_k").isNotNull(), F.col("_hot")).otherwise(F.col("_rest"))).select(*map(quoted, df.columns), "_found.*")
