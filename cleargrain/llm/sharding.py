"""Sharding by proportional stratified interleaving, with DataFrame functions only.

Rows of a source are shuffled by a seeded hash key and ranked; the fractional rank (r - 1/2) / n spreads every
source evenly over [0, 1). All rows sorted by it and cut into equal runs give shards that match the mixture.
Both ranks are found in buckets (leading key digits, then leading bits of the fraction) plus prefix sums of
the bucket counts, so that no source and no shard passes through one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cleargrain.llm.common import cut_lineage, hash_key

BUCKET_DIGITS = 3
FRACTION_BUCKETS = 4096


def shard_documents(docs: DataFrame, n_shards: int = 8, seed: int = 17) -> DataFrame:
    """doc_id, source, size, text_crc32, law, shard, slot, grown_shard: one row per document.

    Law `rows`: shard sizes in rows differ by one at most. size is UTF-8 bytes + 1 (null text: 1) and
    text_crc32 that of the bytes (null text: of none, 0). A null source is a source of its own. Equal fractions
    go by source; rows with equal ids keep apart slots. An empty table gives no rows. Other columns are ignored.
    """
    sized = cut_lineage(
        docs.select(
            "doc_id",
            F.col("source").isNull().alias("no_source"),
            F.coalesce("source", F.lit("")).alias("source_name"),
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        )
        .withColumn("key", hash_key(seed, F.col("doc_id"), F.col("text_crc32")))
        .withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    )
    stratum = ["no_source", "source_name"]
    counts = sized.groupBy(*stratum, "bucket").agg(F.count("*").alias("n"))
    in_source = Window.partitionBy(*stratum)
    starts = counts.select(
        *stratum,
        "bucket",
        F.coalesce(F.sum("n").over(in_source.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("n").over(in_source).alias("in_source"),
    )
    own = Window.partitionBy(*stratum, "bucket").orderBy("key", "doc_id", "text_crc32", "size")
    ranked = (
        sized.join(starts, [*stratum, "bucket"])
        .withColumn("rank", F.row_number().over(own) + F.col("before"))
        .withColumn("fraction", (2 * F.col("rank") - 1) / (2 * F.col("in_source")))
        .withColumn("cell", F.floor(F.col("fraction") * FRACTION_BUCKETS))
        .drop("before", "in_source", "bucket")
    )
    ranked = cut_lineage(ranked)
    cells = ranked.groupBy("cell").agg(F.count("*").alias("n"))
    offsets = cells.select(
        "cell",
        F.coalesce(F.sum("n").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("n").over(Window.partitionBy()).alias("rows"),
    )
    in_cell = Window.partitionBy("cell").orderBy("fraction", *stratum, "key", "doc_id", "text_crc32", "size")
    place = F.row_number().over(in_cell) - 1 + F.col("before")
    placed = ranked.join(F.broadcast(offsets), "cell").withColumn("place", place)  # FRACTION_BUCKETS rows at most
    placed = placed.withColumn("shard", F.expr(f"cast(place * {n_shards} div rows as int)"))
    first = F.expr(f"(shard * rows + {n_shards - 1}) div {n_shards}")
    return placed.select(
        "doc_id",
        F.when(~F.col("no_source"), F.col("source_name")).alias("source"),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("place") - first).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


#: The same law in DuckDB SQL. The table of CRC-32 steps is built from its polynomial.
SHARD_SQL = r"""
WITH steps AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)),
                          lambda c, bit: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) r(i))),
sized AS (
  SELECT doc_id, source, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size,
         xor(list_reduce(list_prepend(4294967295::BIGINT,
               list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
             lambda c, b: xor(c >> 8, steps.t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM documents, steps),
keyed AS (SELECT *, md5('17:' || coalesce(doc_id::VARCHAR, 'null') || ':' || text_crc32::VARCHAR) AS key FROM sized),
ranked AS (
  SELECT *, (2 * row_number() OVER (PARTITION BY source ORDER BY key, doc_id, text_crc32, size) - 1)::DOUBLE
            / (2 * count(*) OVER (PARTITION BY source)) AS fraction
  FROM keyed),
placed AS (
  SELECT *, row_number() OVER (ORDER BY fraction, source IS NULL, source, key, doc_id, text_crc32, size) - 1 AS place,
         count(*) OVER () AS n FROM ranked),
cut AS (SELECT *, (place * 8 // n)::INTEGER AS shard FROM placed)
SELECT doc_id, source, size, text_crc32, 'rows' AS law, shard,
       (place - (shard * n + 7) // 8)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM cut
"""
