"""dirty_sales: orders and customers with planted faults, by key arithmetic; the same text runs in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cleargrain.sources.rowid import with_row_ids
from cleargrain.sources.versions import stored

CTE = """
WITH base AS (
  SELECT o.o_orderkey AS k, c.c_name AS nm, c.c_mktsegment AS seg, o.o_totalprice AS price, CAST(CAST(o.o_orderdate AS DATE) AS STRING) AS d
  FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey),
dirty AS (
  SELECT k AS order_id,
    CASE WHEN k % 10 = 3 THEN '  ' || nm || ' ' ELSE nm END AS full_name,
    CASE WHEN k % 17 = 0 THEN 'bad@@invalid' WHEN k % 23 = 0 THEN NULL ELSE lower(replace(nm, '#', '.')) || '@example.com' END AS email,
    CASE WHEN k % 13 = 0 THEN 'call me' WHEN k % 5 = 0 THEN '5550100' ELSE '+1 (555) 012-3456' END AS phone,
    CASE WHEN k % 19 = 0 THEN 'nope' ELSE 'https://shop.example.com/o/' || CAST(k AS STRING) END AS site_url,
    CASE WHEN k % 11 = 0 THEN lower(seg) WHEN k % 29 = 0 THEN seg || ' ' ELSE seg END AS segment,
    CASE WHEN k % 12 = 0 THEN NULL WHEN k % 41 = 0 THEN -price WHEN k % 101 = 0 THEN price * 50 ELSE price END AS revenue,
    CASE WHEN k % 7 = 0 THEN 'two' ELSE CAST(1 + k % 9 AS STRING) END AS quantity,
    CASE WHEN k % 31 = 0 THEN 'not a date' WHEN k % 3 = 0 THEN substr(d, 9, 2) || '/' || substr(d, 6, 2) || '/' || substr(d, 1, 4)
         WHEN k % 3 = 1 THEN replace(d, '-', '/') ELSE d END AS order_date,
    CASE WHEN k % 6 = 0 THEN '  ' WHEN k % 4 = 0 THEN NULL WHEN k % 37 = 0 THEN 'caf' || chr(1) ELSE 'VIP' END AS notes,
    CAST(k % 50 AS STRING) AS code_text,
    CASE WHEN k % 3 = 0 THEN 'A' WHEN k % 3 = 1 THEN 'B' ELSE 'C' END AS tier,
    CASE WHEN k % 3 = 0 THEN 'A' WHEN k % 3 = 1 THEN 'B' ELSE 'C' END AS tier_copy,
    'APAC' AS region
  FROM base),
d AS (SELECT * FROM dirty UNION ALL SELECT * FROM dirty WHERE order_id % 97 = 0)
"""
COLUMNS = ("order_id", "full_name", "email", "phone", "site_url", "segment", "revenue", "quantity", "order_date", "notes", "code_text", "tier", "tier_copy", "region")
DUCK = CTE.format(orders="orders", customer="customer")


def dirty_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer")}
    return spark.sql(CTE + "SELECT * FROM d", **tables)


def dirty_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written once and without row numbers, for checks that only count."""
    return stored(dirty_sales(spark, sf_dir))


def dirty_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With row numbers by order_id; rows of one order are equal, so ties don't matter."""
    return with_row_ids(dirty_sales(spark, sf_dir), ["order_id"])
