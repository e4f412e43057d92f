"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key. Within a source the documents stand in key order; the leading
hex digits of the key cut a source into buckets of about equal size, so that a source with a third of
all rows is ranked by many tasks. Prefix sums over the (source, bucket) totals give each bucket its start,
a running sum inside the bucket gives each document its own, and the cut falls at the source's exact budget.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cleargrain.llm.common import WORD, cut_lineage, hash_key

BUCKET_DIGITS = 3
CYCLE = (5, 2, 1)
MAX_EPOCHS = 3


def source_targets(totals: DataFrame, cycle=CYCLE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Share the sum of all sizes among sources by weight; none gets more than max_epochs times its size.

    totals holds one row per source (no_source, source_name, source_size). Sorted by cap over weight, the
    capped sources are a prefix; the rest share what is left. The level is the largest that a source
    at the head of the rest can still hold. Empty input gives no rows.
    """
    order = Window.orderBy("no_source", "source_name")
    weights = F.array(*[F.lit(w) for w in cycle])
    weighed = totals.withColumn(
        "weight", F.element_at(weights, ((F.row_number().over(order) - 1) % len(cycle) + 1).cast("int")).cast("long")
    )
    everything = Window.partitionBy()
    cap = max_epochs * F.col("source_size")
    by_ratio = Window.orderBy((cap / F.col("weight")).asc(), "no_source", "source_name")
    level = (
        weighed.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("before", F.coalesce(F.sum(cap).over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weights_left", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("holds", (F.col("total") - F.col("before")) * F.col("weight") <= cap * F.col("weights_left"))
        .withColumn("level", (F.col("total") - F.col("before")).cast("double") / F.col("weights_left"))
        .withColumn("level", F.max(F.when(F.col("holds"), F.col("level"))).over(everything))
    )
    target = F.least(cap.cast("double"), F.col("level") * F.col("weight"))
    return level.select("no_source", "source_name", "source_size", target.alias("target"))


def mix_rows(docs: DataFrame, seed: int = 17, cycle=CYCLE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """doc_id, text_md5, source, size (words), source_size, target, taken (words, repeats counted): one row per document.

    A source below its size is taken in key order up to the budget floor(target); one above it is taken
    whole floor(budget / size) times and then in key order. The document on the cut gives the words that are left.
    Null or empty text: size 0, taken 0. Null source: a source of its own, last in order. Rows with equal
    ids keep apart rows. The key comes from doc_id and text, so rows equal in both share a bucket and a key. Other columns are ignored. Same seed, same result.
    """
    sized = cut_lineage(
        docs.select(
            "doc_id",
            F.col("source").isNull().alias("no_source"),
            F.coalesce("source", F.lit("")).alias("source_name"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"),
        )
        .withColumn("key", hash_key(seed, F.col("doc_id"), F.col("text_md5")))
        .withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    )
    buckets = sized.groupBy("no_source", "source_name", "bucket").agg(F.sum("size").alias("bucket_size"))
    earlier = Window.partitionBy("no_source", "source_name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0))).drop("bucket_size")
    totals = buckets.groupBy("no_source", "source_name").agg(F.sum("bucket_size").alias("source_size"))
    targets = source_targets(totals, cycle, max_epochs)
    own = Window.partitionBy("no_source", "source_name", "bucket").orderBy("key", "doc_id", "size")
    placed = (
        sized.join(starts, ["no_source", "source_name", "bucket"])
        .withColumn("inside", F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .join(targets, ["no_source", "source_name"])
    )
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size")
    last = F.least(F.col("size"), F.greatest(F.lit(0), rest - F.col("bucket_start") - F.col("inside")))
    return placed.select(
        "doc_id",
        "text_md5",
        F.when(~F.col("no_source"), F.col("source_name")).alias("source"),
        "size",
        "source_size",
        "target",
        (epochs * F.col("size") + last).alias("taken"),
    )


def mix_sources(docs: DataFrame, seed: int = 17, cycle=CYCLE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: one row per document, as mix_rows() finds them."""
    return mix_rows(docs, seed, cycle, max_epochs).drop("text_md5")


#: The same law in DuckDB SQL, over a table or view named documents.
MIX_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
         md5('17:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS key
  FROM documents),
totals AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS weight
  FROM sized GROUP BY source),
steps AS (
  SELECT *, sum(source_size) OVER ()::BIGINT AS total,
         coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
         sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS left_over
  FROM totals WINDOW o AS (ORDER BY 3 * source_size / weight, source ASC NULLS LAST)),
level AS (
  SELECT max((total - before)::DOUBLE / left_over) AS level FROM steps
  WHERE (total - before) * weight <= 3 * source_size * left_over),
targets AS (
  SELECT source, source_size, least((3 * source_size)::DOUBLE, level * weight) AS target FROM steps, level),
placed AS (
  SELECT s.*, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY key, doc_id, s.size ROWS UNBOUNDED PRECEDING)::BIGINT - s.size AS prefix
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target,
       (CASE WHEN source_size > 0 THEN budget // source_size * size
          + least(size, greatest(0, budget - budget // source_size * source_size - prefix)) ELSE 0 END)::BIGINT AS taken
FROM placed
"""
