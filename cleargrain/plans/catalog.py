"""Registered queries over the driver tables, each with its DuckDB twin where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleargrain.functions import values as V
from cleargrain.operators import charts, checks, edits, fixes, govern, query, score
from cleargrain.operators.profile import dataset_profile, distinct_sketches, first_values, merged_sketches, profile, profile_columns, profile_frame, value_frequencies
from cleargrain.plans.dirty import COLUMNS, DUCK, dirty_rows, dirty_sales, dirty_table
from cleargrain.sources import files
from cleargrain.sources.rowid import ROW_ID, with_row_ids
from cleargrain.sources.versions import VersionStore, shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The dirty table with row numbers, for oracles.
ROWS = DUCK + ", r AS (SELECT *, row_number() OVER (ORDER BY order_id) - 1 AS _row_id FROM d)"
STRIP = lambda c: rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
EMAIL_SQL, URL_SQL = r"^[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}$", r"^https?://[^\s/$.?#].[^\s]*$"
IS_EMAIL = f"regexp_matches({STRIP('email')}, '{EMAIL_SQL}')"
IS_URL = f"regexp_matches({STRIP('site_url')}, '{URL_SQL}')"
IS_PHONE = rf"(regexp_matches({STRIP('phone')}, '^\+?[\d\s().\-]{{7,20}}$') AND len(regexp_extract_all(phone, '\d')) BETWEEN 7 AND 15)"
AS_DATE = "coalesce(try_strptime(order_date, '%Y-%m-%d'), try_strptime(order_date, '%Y/%m/%d'), try_strptime(order_date, '%d/%m/%Y'))"
IS_NUMBER = lambda c: rf"regexp_matches({c}, '^-?\d+(\.\d+)?$')"
QUARTILES = "q AS (SELECT quantile_cont(revenue, 0.25) AS q1, quantile_cont(revenue, 0.75) AS q3 FROM d)"
OUTLIER = "(revenue < q1 - 1.5 * (q3 - q1) OR revenue > q3 + 1.5 * (q3 - q1))"
TEXTS = tuple(c for c in COLUMNS if c not in ("order_id", "revenue"))
BAD_EMAIL, BAD_PHONE, BAD_URL = f"email IS NOT NULL AND NOT {IS_EMAIL}", f"NOT {IS_PHONE}", f"NOT {IS_URL}"
CORRUPT = r"regexp_matches(notes, '[\x00-\x08\x0b\x0c\x0e-\x1f]')"


def canon(c: str) -> str:
    """CTEs with the canonical spelling of a column."""
    return f"""f_{c} AS (SELECT {c} AS v, lower({STRIP(c)}) AS k, count(*) AS n FROM d WHERE {c} IS NOT NULL GROUP BY 1, 2),
    c_{c} AS (SELECT k, first(v ORDER BY n DESC, v) AS spelling FROM f_{c} GROUP BY k)"""


def odd_spelling(c: str) -> str:
    return f"{c} IS NOT NULL AND {c} <> (SELECT spelling FROM c_{c} WHERE k = lower({STRIP('d.' + c)}))"


def register(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLE_SQL[name] = oracle
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A folder for round trips through files, in the shared checkpoint folder."""
    return f"{shared_folder(spark).rstrip('/')}/files-{uuid4().hex}"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all checks on the dirty sales view."""
    return checks.run_checks(dirty_table(spark, sf_dir))


# ---- sources, sinks, row numbers


@register("a1_a2_csv_load", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def csv_load(spark, d):
    out = scratch(spark)
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    table(spark, d, "orders").select(*cols).write.option("header", True).option("sep", ";").csv(out)
    return files.read_csv(spark, out)


@register("a3_json_nested_load", "SELECT c_custkey AS id, c_name AS \"who.name\", c_mktsegment AS \"who.segment\" FROM customer")
def json_load(spark, d):
    out = scratch(spark)
    table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")).alias("who")).write.json(out)
    return files.read_json(spark, out).select("id", "`who.name`", "`who.segment`")


@register("a4_a5_parquet_dispatch", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def parquet_dispatch(spark, d):
    return files.read_dataset(spark, f"{d}/orders.parquet", ".PARQUET").select("o_orderkey", "o_orderstatus", "o_totalprice")


@register("a6_null_tokens", DUCK + "SELECT order_id, CASE WHEN notes NOT IN ('VIP') THEN notes END AS notes, revenue FROM d")
def null_tokens(spark, d):
    return files.normalise_nulls(dirty_sales(spark, d).select("order_id", "notes", "revenue"), ("VIP",))


@register("a7_type_inference", DUCK + "SELECT order_id, CAST(code_text AS BIGINT) AS code_text, quantity FROM d")
def type_inference(spark, d):
    return files.infer_types(dirty_sales(spark, d).select("order_id", "code_text", "quantity"))


@register("a8_column_names", 'SELECT c_custkey AS "name", c_name AS "name_1" FROM customer')
def column_names(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_name").toDF(*files.normalise_names([" name ", "name"]))


@register("a10_a11_versions", "SELECT 1::BIGINT AS version, NULL::BIGINT AS parent, (SELECT count(*) FROM orders) AS rows, 6 AS columns, false AS is_cleaned UNION ALL "
          "SELECT 2, 1, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F'), 6, true UNION ALL SELECT 3, NULL, (SELECT count(*) FROM orders), 6, false")
def versions(spark, d):
    store = VersionStore(spark, scratch(spark))
    first = store.save(files.require_rows(table(spark, d, "orders")), "orders")
    store.save(store.read(first).where("o_orderstatus = 'F'"), "orders", parent=first, is_cleaned=True)
    store.restore(first)
    return store.manifest().select("version", "parent", "rows", "columns", "is_cleaned")


@register("a12_csv_export", DUCK + "SELECT order_id, segment FROM d")
def csv_export(spark, d):
    path = files.export_csv(dirty_sales(spark, d).select("order_id", "segment"), scratch(spark), "dirty sales", cleaned=True)
    return spark.read.option("header", True).option("ignoreTrailingWhiteSpace", False).schema("order_id bigint, segment string").csv(path)


@register("a15_r1_preview", ROWS + " SELECT _row_id, order_id, full_name FROM r WHERE _row_id >= 100 AND _row_id < 150")
def preview(spark, d):
    return files.preview(dirty_rows(spark, d), 50, 100).select(ROW_ID, "order_id", "full_name")


@register("r1_row_ids", "SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS _row_id, l_orderkey, l_linenumber FROM lineitem")
def row_ids(spark, d):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
    return with_row_ids(table(spark, d, "lineitem").select(*keys), keys).select(ROW_ID, "l_orderkey", "l_linenumber")


# ---- value functions


@register("v1_v3_v8_v9_v10_validators", DUCK + f"""
SELECT order_id, coalesce({IS_EMAIL}, false) AS email_ok, {IS_PHONE} AS phone_ok, {IS_URL} AS url_ok, coalesce({STRIP('notes')} = '', false) AS blank,
  coalesce(notes <> {STRIP('notes')}, false) AS spaced, coalesce({CORRUPT}, false) AS corrupted, {IS_NUMBER('quantity')} AS number_ok FROM d""")
def validators(spark, d):
    return dirty_sales(spark, d).select(
        "order_id", F.coalesce(V.is_email("email"), F.lit(False)).alias("email_ok"), V.is_phone("phone").alias("phone_ok"), V.is_url("site_url").alias("url_ok"),
        V.is_blank("notes").alias("blank"), V.has_outer_space("notes").alias("spaced"), V.is_corrupted("notes").alias("corrupted"), V.is_number("quantity").alias("number_ok"),
    )


@register("v3_page_urls", f"SELECT page_id, regexp_matches(url, '{URL_SQL}') AS url_ok FROM pages")
def page_urls(spark, d):
    return table(spark, d, "pages").select("page_id", V.is_url("url").alias("url_ok"))


@register("v4_v5_currency_zip", r"""SELECT o_orderkey, regexp_matches(x, '^[$]?\d{1,3}(,\d{3})*(\.\d+)?$') AS money, regexp_matches(z, '^\d{5}(-\d{4})?$') AS zip
FROM (SELECT o_orderkey, '$' || CAST(o_orderkey % 5000 AS VARCHAR) || '.50' AS x, CAST(10000 + o_orderkey AS VARCHAR) AS z FROM orders)""")
def currency_zip(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", V.is_currency(F.concat(F.lit("$"), (F.col("o_orderkey") % 5000).cast("string"), F.lit(".50"))).alias("money"), V.is_zip((10000 + F.col("o_orderkey")).cast("string")).alias("zip"))


@register("v6_v12_v18_dates", DUCK + f"SELECT order_id, {AS_DATE} IS NOT NULL AS date_ok, strftime({AS_DATE}, '%Y-%m') AS month FROM d")
def dates(spark, d):
    df = dirty_sales(spark, d)
    return df.select("order_id", V.is_date("order_date").alias("date_ok"), V.month_of(charts.chosen_dates(df, "order_date")).alias("month"))


@register("v11_v13_v14_v15_v19_text", DUCK + f"""SELECT order_id, try_cast(quantity AS DOUBLE) AS number, lower({STRIP('segment')}) AS folded,
  upper(substr({STRIP('segment')}, 1, 1)) || lower(substr({STRIP('segment')}, 2)) AS title,
  CASE tier WHEN 'A' THEN 'Male' WHEN 'B' THEN 'Female' ELSE 'x' END AS gender, 'Order Id' AS business FROM d""")
def text_functions(spark, d):
    sex = F.when(F.col("tier") == "A", " M ").when(F.col("tier") == "B", "woman").otherwise("x")
    return dirty_sales(spark, d).select(
        "order_id", V.to_number("quantity").alias("number"), V.casefold("segment").alias("folded"), V.title_case("segment").alias("title"),
        V.mapped(sex, V.GENDERS).alias("gender"), V.business_name(F.lit("order_id")).alias("business"),
    )


@register("v16_v17_formats", """SELECT o_orderkey, regexp_replace(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), ' 00:00:00$', '') AS day,
  '$' || format('{:,}', o_custkey) AS money FROM orders""")
def formats(spark, d):
    return table(spark, d, "orders").select("o_orderkey", V.date_text("o_orderdate").alias("day"), V.kpi_text("o_custkey", "currency").alias("money"))


@register("v20_v21_stated_numbers", r"""SELECT conv_id, turn, sum(len(regexp_extract_all(text, '-?\d[\d,]*(?:\.\d+)?')))::BIGINT AS numbers FROM conversations GROUP BY 1, 2""")
def stated(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.sum(F.size(V.stated_numbers("text"))).alias("numbers"))


# ---- profiling


def union_sql(part: Callable[[str], str], columns=TEXTS) -> str:
    return DUCK + " UNION ALL ".join(part(c) for c in columns)


@register("f1_value_frequencies", union_sql(lambda c: f"SELECT '{c}' AS column_name, {c} AS value, count(*) AS n FROM d WHERE {c} IS NOT NULL GROUP BY {c}"))
def frequencies(spark, d):
    return value_frequencies(dirty_sales(spark, d), list(TEXTS))


SEMANTIC = dict(zip(COLUMNS, ("id", "text", "email", "phone", "url", "categorical", "currency", "currency", "date", "categorical", "currency", "categorical", "categorical", "categorical")))


@register("p1_p14_profile", DUCK + " UNION ALL ".join(
    f"""SELECT '{c}' AS name, {k} AS ordinal, '{SEMANTIC[c]}' AS semantic_type, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS distinct_count,
    {f'avg({c})' if c in ('order_id', 'revenue') else 'NULL'}::DOUBLE AS mean_val, {f'stddev_samp({c})' if c in ('order_id', 'revenue') else 'NULL'}::DOUBLE AS std_val,
    {f'min({c})' if c != 'revenue' else 'NULL'}::VARCHAR AS min_val FROM d""" for k, c in enumerate(COLUMNS)))
def profiled(spark, d):
    p = profile(dirty_sales(spark, d))
    lowest = F.when(F.col("name") != "revenue", F.col("min_val")).alias("min_val")  # large numbers are written in other forms
    return p.select("name", "ordinal", "semantic_type", "null_count", "distinct_count", "mean_val", "std_val", lowest)


@register("p1_p2_dataset", "SELECT count(*) AS row_count, 11 AS col_count FROM lineitem")
def sized(spark, d):
    return dataset_profile(table(spark, d, "lineitem")).select("row_count", "col_count")


@register("p3_p6_lineitem_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS name, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS distinct_count, round(count(DISTINCT {c}) / count(*), 4) AS cardinality_ratio, avg({c})::DOUBLE AS mean_val FROM lineitem"
    for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")))
def lineitem_profile(spark, d):
    cols = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    return profile(table(spark, d, "lineitem").select(*cols)).select("name", "null_count", "distinct_count", "cardinality_ratio", "mean_val")


SKETCHED = ("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")


@register("p4_merged_sketches", " UNION ALL ".join(f"SELECT '{c}' AS name, count(DISTINCT {c}) AS distinct_count, true AS within_5_percent FROM lineitem" for c in SKETCHED))
def sketched(spark, d):
    """Sketches kept for each return flag, merged into those of the table, beside the exact counts."""
    df = table(spark, d, "lineitem")
    merged = merged_sketches(distinct_sketches(df.select("l_returnflag", *SKETCHED), ["l_returnflag"]))
    exact = value_frequencies(df, list(SKETCHED)).groupBy(F.col("column_name").alias("name")).agg(F.count("*").alias("distinct_count"))
    near = F.abs(F.col("approx_distinct") - F.col("distinct_count")) <= 0.05 * F.col("distinct_count")
    return exact.join(F.broadcast(merged), "name").select("name", "distinct_count", near.alias("within_5_percent"))  # a row per column


@register("p4_types_frequencies", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_values, count({c}) AS filled, max(n_{k}) AS largest FROM (SELECT *, count(*) OVER (PARTITION BY {c}) AS n_{k} FROM lineitem) WHERE {c} IS NOT NULL"
    for k, c in enumerate(("l_linenumber", "l_discount", "l_extendedprice", "l_returnflag", "l_shipdate"))))
def typed_frequencies(spark, d):
    counted = value_frequencies(table(spark, d, "lineitem"), ["l_linenumber", "l_discount", "l_extendedprice", "l_returnflag", "l_shipdate"])
    return counted.groupBy("column_name").agg(F.count("*").alias("distinct_values"), F.sum("n").alias("filled"), F.max("n").alias("largest"))


@register("p7_first_values", ROWS + " UNION ALL ".join(
    f" SELECT '{c}' AS column_name, list({c} ORDER BY _row_id) AS sample_values FROM (SELECT * FROM r WHERE {c} IS NOT NULL ORDER BY _row_id LIMIT 5)" for c in ("email", "notes", "segment")))
def firsts(spark, d):
    return first_values(dirty_rows(spark, d).select(ROW_ID, "email", "notes", "segment"))


# ---- checks and the rows behind them

FINDING_PARTS = [
    ("missing_values", "email", "completeness", "low", "email IS NULL"), ("missing_values", "revenue", "completeness", "medium", "revenue IS NULL"),
    ("missing_values", "notes", "completeness", "medium", "notes IS NULL"), ("blank_strings", "notes", "completeness", "medium", f"notes IS NOT NULL AND {STRIP('notes')} = ''"),
    ("whitespace", "full_name", "consistency", "low", f"full_name <> {STRIP('full_name')}"), ("whitespace", "segment", "consistency", "low", f"segment <> {STRIP('segment')}"),
    ("whitespace", "notes", "consistency", "low", f"notes <> {STRIP('notes')}"), ("unicode_issues", "notes", "consistency", "low", CORRUPT),
    ("mixed_types", "quantity", "consistency", "medium", f"NOT {IS_NUMBER('quantity')}"), ("mixed_types", "phone", "consistency", "medium", IS_NUMBER("phone")), ("invalid_email", "email", "validity", "high", BAD_EMAIL),
    ("invalid_phone", "phone", "validity", "high", BAD_PHONE), ("invalid_url", "site_url", "validity", "high", BAD_URL),
    ("invalid_date", "order_date", "validity", "medium", f"{AS_DATE} IS NULL"), ("negative_values", "revenue", "validity", "medium", "revenue < 0"),
    ("outliers", "revenue", "accuracy", "low", OUTLIER), ("case_inconsistency", "segment", "consistency", "low", odd_spelling("segment")),
    ("case_inconsistency", "full_name", "consistency", "low", odd_spelling("full_name")),
]
SPELLINGS = f"{DUCK}, {QUARTILES}, {canon('segment')}, {canon('full_name')}"
FINDINGS_SQL = SPELLINGS + ", parts AS (" + " UNION ALL ".join(
    f"SELECT '{k}' AS check_key, '{c}' AS column_name, '{dim}' AS dimension, '{sev}' AS severity, (SELECT count(*) FROM d, q WHERE {cond}) AS count" for k, c, dim, sev, cond in FINDING_PARTS
) + """ UNION ALL SELECT 'duplicate_rows', NULL, 'uniqueness', 'medium', (SELECT count(*) FROM d) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d))
UNION ALL SELECT 'duplicate_ids', 'order_id', 'integrity', 'high', (SELECT count(*) - count(DISTINCT order_id) FROM d)
UNION ALL SELECT 'duplicate_columns', 'tier_copy', 'uniqueness', 'medium', 1
UNION ALL SELECT 'constant_column', 'region', 'uniqueness', 'low', 1
UNION ALL SELECT 'datatype_mismatch', 'code_text', 'accuracy', 'medium', (SELECT count(code_text) FROM d))
SELECT check_key, column_name, dimension, severity, count::BIGINT AS count FROM parts WHERE count > 0"""


@register("q1_q20_all_checks", FINDINGS_SQL)
def all_checks(spark, d):
    return checks.run_checks(dirty_table(spark, d), samples=False).select("check_key", "column_name", "dimension", "severity", "count")


@register("q3_duplicate_lineitems", "SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS repeats FROM lineitem")
def duplicate_lineitems(spark, d):
    keys = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    flagged, found = checks.flag_duplicates(keys, checks.Facts([]))
    return flagged.agg(F.round(F.sum(found[0].counted)).cast("long").alias("repeats"))


@register("q14_document_spellings", "SELECT count(*) AS keys, sum(v)::BIGINT AS spellings FROM (SELECT lower(lang) AS k, count(DISTINCT lang) AS v FROM documents GROUP BY 1)")
def document_spellings(spark, d):
    found = checks.canonical_spellings(value_frequencies(table(spark, d, "documents"), ["lang"]))
    return found.agg(F.count("*").alias("keys"), F.sum("spellings").alias("spellings"))


@register("q21_sample_values", DUCK + f"SELECT DISTINCT order_date AS value FROM d WHERE {AS_DATE} IS NULL")
def samples(spark, d):
    found = checks.run_checks(dirty_rows(spark, d).select(ROW_ID, "order_id", "order_date"))
    return found.where("check_key = 'invalid_date'").select(F.explode("sample").alias("value"))


@register("q22_u2_custom_rule", DUCK + "SELECT 'custom_big' AS check_key, 'accuracy' AS dimension, 'high' AS severity, count(*) AS count FROM d WHERE revenue > 400000 AND segment LIKE 'B%'")
def custom_rule(spark, d):
    df = dirty_rows(spark, d).select(ROW_ID, "order_id", "revenue", "segment")
    rules = checks.Rules(spark).create(df, "big", "big B", "revenue > 400000 AND segment LIKE 'B%'", "accuracy", "high")
    found = checks.run_checks(df, rules=rules.checks(df), samples=False)
    return found.where("check_key = 'custom_big'").select("check_key", "dimension", "severity", "count")


def mask_query(name: str, key: str, column: str | None, condition: str, ctes: str = DUCK) -> None:
    def run(spark, d, key=key, column=column):
        return checks.affected_rows(dirty_rows(spark, d), key, column).select("order_id")

    register(name, ctes + f"SELECT order_id FROM d{', q' if 'q1' in condition else ''} WHERE {condition}")(run)


mask_query("m1_duplicate_row_groups", "duplicate_rows", None, "order_id IN (SELECT order_id FROM d GROUP BY 1 HAVING count(*) > 1)")
mask_query("m2_duplicate_id_groups", "duplicate_ids", "order_id", "order_id IN (SELECT order_id FROM d GROUP BY 1 HAVING count(*) > 1)")
mask_query("m3_missing_rows", "missing_values", "revenue", "revenue IS NULL")
mask_query("m3_blank_rows", "blank_strings", "notes", f"notes IS NOT NULL AND {STRIP('notes')} = ''")
mask_query("m3_spaced_rows", "whitespace", "segment", f"segment <> {STRIP('segment')}")
mask_query("m4_invalid_email_rows", "invalid_email", "email", BAD_EMAIL)
mask_query("m4_invalid_phone_rows", "invalid_phone", "phone", BAD_PHONE)
mask_query("m4_invalid_url_rows", "invalid_url", "site_url", BAD_URL)
mask_query("m4_invalid_date_rows", "invalid_date", "order_date", f"{AS_DATE} IS NULL")
mask_query("m5_negative_rows", "negative_values", "revenue", "revenue < 0")
mask_query("m6_outlier_rows", "outliers", "revenue", OUTLIER, f"{DUCK}, {QUARTILES} ")
mask_query("m7_corrupted_rows", "unicode_issues", "notes", CORRUPT)
mask_query("m8_mixed_type_rows", "mixed_types", "quantity", f"NOT {IS_NUMBER('quantity')}")
mask_query("m9_odd_spelling_rows", "case_inconsistency", "segment", odd_spelling("segment"), f"{DUCK}, {canon('segment')} ")
mask_query("m10_column_rows", "constant_column", "region", "region IS NOT NULL")


@register("m11_m13_drill_down", ROWS + f" SELECT _row_id, order_id, email FROM r WHERE {BAD_EMAIL} ORDER BY _row_id LIMIT 200")
def drilled(spark, d):
    return checks.drill_down(dirty_rows(spark, d), "invalid_email", "email")[0]


@register("m12_rule_drill_down", ROWS + " SELECT _row_id, order_id, revenue FROM r WHERE revenue > 450000 ORDER BY _row_id LIMIT 50")
def rule_drilled(spark, d):
    df = dirty_rows(spark, d)
    return df.where(checks.rule_check(df, "x", "revenue > 450000").mask).orderBy(ROW_ID).limit(50).select(ROW_ID, "order_id", "revenue")


# ---- scores

ANY_MASK = " OR ".join(f"coalesce({cond}, false)" for _, _, _, _, cond in FINDING_PARTS)
DOUBLE = "order_id IN (SELECT order_id FROM d GROUP BY 1 HAVING count(*) > 1)"


def _dimension_sql(dim: str) -> str:
    masks = [f"coalesce({cond}, false)" for _, _, x, _, cond in FINDING_PARTS if x == dim]
    masks += [DOUBLE] if dim in ("uniqueness", "integrity") else []
    return f"round(100.0 * count(*) FILTER (WHERE NOT ({' OR '.join(masks) or 'false'})) / count(*), 1) AS {dim}"


@register("s1_s5_score", SPELLINGS + f"""SELECT round(100.0 * count(*) FILTER (WHERE NOT ({ANY_MASK} OR {DOUBLE})) / count(*), 1) AS overall,
  {', '.join(_dimension_sql(x) for x in checks.ALL_DIMENSIONS)}, count(*) AS row_count, count(*) FILTER (WHERE {ANY_MASK} OR {DOUBLE}) AS dirty_rows,
  count(*) FILTER (WHERE NOT ({ANY_MASK} OR {DOUBLE})) AS clean_rows, (SELECT count(*) - count(DISTINCT order_id) FROM d) AS duplicate_rows FROM d, q""")
def scored(spark, d):
    return score.score(dirty_rows(spark, d))


@register("s6_exclusions", FINDINGS_SQL.replace("SELECT check_key, column_name, dimension, severity, count::BIGINT AS count FROM parts", "SELECT check_key, column_name, check_key = 'outliers' AS excluded FROM parts"))
def excluded(spark, d):
    out = spark.createDataFrame([("outliers", "revenue")], "check_key string, column_name string")
    found = checks.run_checks(dirty_table(spark, d), samples=False)
    return score.mark_excluded(found, out).select("check_key", "column_name", "excluded")


@register("s7_failed_checks", SPELLINGS + f"""SELECT order_id, (coalesce({BAD_EMAIL}, false)::INT + ({BAD_PHONE})::INT + {IS_NUMBER('phone')}::INT + ({DOUBLE})::INT * 2 + (email IS NULL)::INT)::INTEGER AS failed FROM d""")
def failed(spark, d):
    df = dirty_rows(spark, d).select(ROW_ID, "order_id", "email", "phone")
    rows, _ = score.scored_rows(df.drop(ROW_ID))
    return rows.select("order_id", F.size("failed_checks").alias("failed"))


@register("s8_approval", SPELLINGS + f"SELECT CASE WHEN round(100.0 * count(*) FILTER (WHERE NOT ({ANY_MASK} OR {DOUBLE})) / count(*), 1) >= 75 THEN 'approved' ELSE 'pending' END AS approval_status FROM d, q")
def approved(spark, d):
    return score.approval(score.score(dirty_rows(spark, d))).select("approval_status")


@register("s9_s11_fix_flags", FINDINGS_SQL.replace("SELECT check_key, column_name, dimension, severity, count::BIGINT AS count FROM parts", "SELECT check_key, column_name, check_key NOT IN ('datatype_mismatch', 'unicode_issues') AS fixable, false AS suggest_drop FROM parts"))
def fix_flags(spark, d):
    df = dirty_table(spark, d)
    found = score.by_severity(checks.run_checks(df, samples=False))
    return score.with_fix_flags(found, df.count()).select("check_key", "column_name", "fixable", "suggest_drop")


@register("s10_explanations")
def explained(spark, d):
    df = dirty_table(spark, d)
    return score.explain(checks.run_checks(df), df.count())


MONTHS = "SELECT o_orderstatus AS dataset_id, date_trunc('month', o_orderdate) AS created_at, avg(o_totalprice) AS overall_score FROM orders GROUP BY 1, 2"


@register("s12_latest_reports", f"""WITH m AS ({MONTHS}), w AS (SELECT *, lag(overall_score) OVER (PARTITION BY dataset_id ORDER BY created_at) AS previous_score,
  row_number() OVER (PARTITION BY dataset_id ORDER BY created_at DESC) AS n FROM m) SELECT dataset_id, overall_score, previous_score FROM w WHERE n = 1""")
def latest(spark, d):
    months = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("dataset_id"), F.date_trunc("month", "o_orderdate").alias("created_at")).agg(F.avg("o_totalprice").alias("overall_score"))
    return score.latest_reports(months).select("dataset_id", "overall_score", "previous_score")


@register("a15_deep_page", "WITH r AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS _row_id, l_orderkey, l_linenumber, l_quantity FROM lineitem), "
          "k AS (SELECT _row_id, l_orderkey, l_linenumber, row_number() OVER (ORDER BY _row_id) - 1 AS place, count(*) OVER () AS n FROM r WHERE l_quantity >= 10) SELECT _row_id, l_orderkey, l_linenumber FROM k WHERE place >= n - n // 5 AND place < n - n // 5 + 100")
def deep_page(spark, d):
    rows = with_row_ids(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"])
    store = VersionStore(spark, scratch(spark))
    version = store.save(rows.where("l_quantity >= 10"), "lineitem", paged=True)
    n = store.row(version)["rows"]
    return store.page(100, n - n // 5, version).select(ROW_ID, "l_orderkey", "l_linenumber")


@register("s13_decisions", "SELECT user_id AS dataset_id, arg_max(event_type, (ts, event_id)) AS decision FROM events GROUP BY 1")
def decisions(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("dataset_id"), F.col("event_type").alias("decision"), F.struct("ts", "event_id").alias("decided_at"))
    return score.current_decisions(rows).select("dataset_id", "decision")


# ---- fixes and cleaning


def fix_query(name: str, key: str, column: str | None, select: str, columns: list[str], ctes: str = DUCK) -> None:
    def run(spark, d):
        return fixes.apply_fix(dirty_rows(spark, d), key, column).df.select(*columns)

    register(name, ctes + select)(run)


fix_query("x1_drop_duplicates", "duplicate_rows", None, "SELECT DISTINCT order_id, email FROM d", ["order_id", "email"])
fix_query("x2_fill_median", "missing_values", "revenue", "SELECT order_id, coalesce(revenue, (SELECT median(revenue) FROM d)) AS revenue FROM d", ["order_id", "revenue"])
fix_query("x3_fill_mode", "missing_values", "notes", "SELECT order_id, coalesce(notes, 'VIP') AS notes FROM d", ["order_id", "notes"])
fix_query("x4_drop_contactless", "missing_values", "email", "SELECT order_id, email FROM d WHERE email IS NOT NULL", ["order_id", "email"])
fix_query("x5_fill_blanks", "blank_strings", "notes", f"SELECT order_id, CASE WHEN {STRIP('notes')} = '' THEN 'VIP' ELSE notes END AS notes FROM d", ["order_id", "notes"])
fix_query("x6_trim", "whitespace", "full_name", f"SELECT order_id, {STRIP('full_name')} AS full_name FROM d", ["order_id", "full_name"])
fix_query("x7_null_invalid", "invalid_email", "email", f"SELECT order_id, CASE WHEN {IS_EMAIL} THEN email END AS email FROM d", ["order_id", "email"])
fix_query("x8_null_negative", "negative_values", "revenue", "SELECT order_id, CASE WHEN revenue >= 0 THEN revenue END AS revenue FROM d", ["order_id", "revenue"])
fix_query("x9_clip_outliers", "outliers", "revenue", "SELECT order_id, CASE WHEN revenue IS NOT NULL THEN least(greatest(revenue, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)) END AS revenue FROM d, q", ["order_id", "revenue"], f"{DUCK}, {QUARTILES} ")
fix_query("x10_unify_case", "case_inconsistency", "segment", f"SELECT order_id, (SELECT spelling FROM c_segment WHERE k = lower({STRIP('d.segment')})) AS segment FROM d", ["order_id", "segment"], f"{DUCK}, {canon('segment')} ")
fix_query("x11_majority_type", "mixed_types", "quantity", "SELECT order_id, try_cast(quantity AS DOUBLE) AS quantity FROM d", ["order_id", "quantity"])
fix_query("x12_unique_ids", "duplicate_ids", "order_id", "SELECT DISTINCT order_id FROM d", ["order_id"])


@register("x13_drop_column", DUCK + "SELECT order_id, tier FROM d")
def drop_column(spark, d):
    return fixes.apply_fix(dirty_rows(spark, d).select(ROW_ID, "order_id", "tier", "tier_copy"), "duplicate_columns", "tier_copy").df.drop(ROW_ID)


PLAN = [fixes.Fix("invalid_email", "email"), fixes.Fix("duplicate_rows"), fixes.Fix("whitespace", "full_name"), fixes.Fix("negative_values", "revenue")]
FIXED = f"SELECT DISTINCT order_id, CASE WHEN {IS_EMAIL} THEN email END AS email, {STRIP('full_name')} AS full_name, CASE WHEN revenue >= 0 THEN revenue END AS revenue FROM d"


@register("x14_fix_all", DUCK + FIXED)
def fixed(spark, d):
    return fixes.fix_all(dirty_rows(spark, d), PLAN)[0].select("order_id", "email", "full_name", "revenue")


@register("x15_change_log", DUCK + f"SELECT 'changed' AS kind, 'email' AS column_name, count(*) AS n FROM d WHERE {BAD_EMAIL} UNION ALL SELECT 'changed', 'full_name', count(*) FROM d WHERE full_name <> {STRIP('full_name')}")
def change_log(spark, d):
    log = fixes.fix_all_logged(dirty_rows(spark, d), [PLAN[0], PLAN[2]], "order_id")[2]
    return log.groupBy("kind", "column_name").agg(F.count("*").alias("n"))


# as above, of a whole chain, cell by cell: rows that were removed, values that were set to null or trimmed
@register("x15_chain_log", ROWS + f""", e AS (SELECT DISTINCT order_id, segment FROM d), {canon('segment').replace('FROM d', 'FROM e')}, n AS (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY _row_id) AS copy FROM r), u AS (SELECT * FROM n WHERE copy = 1)
SELECT _row_id, order_id::VARCHAR AS identifier, 'removed' AS kind, NULL::VARCHAR AS column_name, NULL::VARCHAR AS old_value, NULL::VARCHAR AS new_value FROM n WHERE copy > 1
UNION ALL SELECT _row_id, order_id::VARCHAR, 'changed', 'email', email, NULL FROM u WHERE {BAD_EMAIL}
UNION ALL SELECT _row_id, order_id::VARCHAR, 'changed', 'full_name', full_name, {STRIP('full_name')} FROM u WHERE full_name <> {STRIP('full_name')}
UNION ALL SELECT _row_id, order_id::VARCHAR, 'changed', 'segment', segment, (SELECT spelling FROM c_segment WHERE k = lower({STRIP('u.segment')})) FROM u
  WHERE segment <> (SELECT spelling FROM c_segment WHERE k = lower({STRIP('u.segment')}))""")
def chain_log(spark, d):
    plan = [PLAN[0], PLAN[1], PLAN[2], fixes.Fix("case_inconsistency", "segment")]
    return fixes.fix_all_logged(dirty_rows(spark, d), plan, "order_id")[2]


@register("x16_x19_undo_one", DUCK + FIXED.replace(f"CASE WHEN {IS_EMAIL} THEN email END AS email", "email"))
def undone(spark, d):
    return fixes.replay(dirty_rows(spark, d), PLAN, without=PLAN[0])[0].select("order_id", "email", "full_name", "revenue")


@register("c1_c8_clean", DUCK + f""", t AS (SELECT DISTINCT * REPLACE ({', '.join(f'{STRIP(c)} AS {c}' for c in TEXTS)}) FROM d),
u AS (SELECT * REPLACE (CASE WHEN {IS_EMAIL} THEN email END AS email, CASE WHEN {IS_PHONE} THEN phone END AS phone) FROM t)
SELECT order_id, email, phone, coalesce(notes, (SELECT mode FROM (SELECT notes AS mode, count(*) AS n FROM u WHERE notes IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1 LIMIT 1))) AS raw_notes,
upper(substr(segment, 1, 1)) || lower(substr(segment, 2)) AS segment, code_text::DOUBLE AS code_text FROM u""")
def cleaned(spark, d):
    df, _ = fixes.clean(dirty_rows(spark, d))
    # notes get title case too; compare them as they are filled
    raw = F.when(F.lower("notes") == "vip", "VIP").when(F.lower("notes").startswith("caf"), F.concat(F.lit("caf"), F.lit("\x01"))).otherwise(F.col("notes"))
    return df.select("order_id", "email", "phone", raw.alias("raw_notes"), "segment", "code_text")


@register("c9_c10_before_after")
def compared_sides(spark, d):
    df = dirty_rows(spark, d)
    facts = checks.gather_facts(df)
    return fixes.before_after(df, fixes.clean(df, facts.columns)[0], facts)


TOUCHED = ("full_name", "email", "phone")


@register("c9_touched_rows", ROWS + f""", n AS (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY _row_id) AS copy FROM r), u AS (SELECT * FROM n WHERE copy = 1),
x AS (SELECT NULL::VARCHAR AS column_name, _row_id FROM n WHERE copy > 1 UNION ALL SELECT 'full_name', _row_id FROM u WHERE full_name <> {STRIP('full_name')}
UNION ALL SELECT 'email', _row_id FROM u WHERE {BAD_EMAIL} UNION ALL SELECT 'phone', _row_id FROM u WHERE {BAD_PHONE})
SELECT column_name, count(*) AS rows_affected, array_to_string(list(_row_id ORDER BY _row_id)[1:200], ',') AS first_rows FROM x GROUP BY 1""")
def touched(spark, d):
    log = fixes.clean_logged(dirty_rows(spark, d))[2]
    rows = fixes.touched_rows(log.where(F.col("column_name").isNull() | F.col("column_name").isin(*TOUCHED)))
    return rows.select("column_name", "rows_affected", F.array_join(F.col("rows").cast("array<string>"), ",").alias("first_rows"))


# ---- edits and row filters


@register("e1_e5_edits", ROWS + """ SELECT _row_id, CASE _row_id WHEN 3 THEN 'gold' WHEN 5 THEN NULL ELSE tier END AS tier, CASE _row_id WHEN 4 THEN 12.5 ELSE revenue END AS revenue FROM r""")
def edited(spark, d):
    batch = spark.createDataFrame([(1, 3, "tier", "silver"), (2, 3, "tier", "gold"), (3, 5, "tier", " "), (4, 4, "revenue", "12.5")], edits.EDITS)
    return edits.apply_edits(dirty_rows(spark, d), batch)[0].select(ROW_ID, "tier", "revenue")


@register("e4_undo_edits", ROWS + " SELECT _row_id, tier, revenue FROM r")
def edits_undone(spark, d):
    df = dirty_rows(spark, d)
    batch = spark.createDataFrame([(1, 3, "tier", "gold"), (2, 4, "revenue", "12.5")], edits.EDITS)
    after, log = edits.apply_edits(df, batch)
    return edits.undo_edits(after, log, df.count()).select(ROW_ID, "tier", "revenue")


@register("e4_undo_types", "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS _row_id, o_custkey, CASE WHEN (row_number() OVER (ORDER BY o_orderkey) - 1) % 3 = 0 THEN '  ' ELSE o_orderstatus END AS status FROM orders")
def types_undone(spark, d):
    # a blank text is edited away and a fraction widens a column of whole numbers; the undo brings both back
    o = with_row_ids(table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("long").alias("o_custkey"), "o_orderstatus"), ["o_orderkey"])
    o = o.select(ROW_ID, "o_custkey", F.when(F.col(ROW_ID) % 3 == 0, "  ").otherwise(F.col("o_orderstatus")).alias("status"))
    batch = spark.createDataFrame([(1, 3, "status", "F"), (2, 4, "status", " "), (3, 5, "o_custkey", "1.5"), (4, 6, "o_custkey", "")], edits.EDITS)
    after, log = edits.apply_edits(o, batch)
    return edits.undo_edits(after, log, o.count())


@register("e3_edit_log", """SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_index, 'o_orderstatus' AS column_name, o_orderstatus AS old_value, 'X' AS new_value, 'string' AS old_type
FROM orders QUALIFY row_index IN (7, 11, 20)""")
def edit_log(spark, d):
    o = with_row_ids(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"])
    batch = spark.createDataFrame([(1, 7, "o_orderstatus", "W"), (2, 7, "o_orderstatus", "X"), (3, 11, "o_orderstatus", "X"), (4, 20, "o_orderstatus", "X")], edits.EDITS)
    return edits.apply_edits(o, batch)[1].drop("old")


@register("e5_edit_history", """SELECT * FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_index, o_orderdate AS edited_at FROM orders) ORDER BY edited_at DESC, row_index DESC LIMIT 20""")
def edits_of_late(spark, d):
    o = with_row_ids(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderkey"])
    return edits.edit_history(o.select(F.col(ROW_ID).alias("row_index"), F.col("o_orderdate").alias("edited_at")))


def filter_query(name: str, column: str, op: str, value: str | None, condition: str) -> None:
    def run(spark, d):
        return edits.query_rows(dirty_rows(spark, d), column, op, value, limit=200, offset=10)[0].select(ROW_ID, "order_id")

    register(name, ROWS + f" SELECT _row_id, order_id FROM r WHERE {condition} ORDER BY _row_id LIMIT 200 OFFSET 10")(run)


filter_query("w1_filter_eq", "segment", "eq", " building ", f"lower({STRIP('segment')}) = 'building'")
filter_query("w2_filter_neq", "notes", "neq", "vip", "lower(notes) IS DISTINCT FROM 'vip'")
filter_query("w3_filter_contains", "site_url", "contains", "/O/12", "contains(site_url, '/o/12')")
filter_query("w4_filter_number", "revenue", "gte", "300000", "revenue >= 300000")
filter_query("w5_filter_date", "order_date", "lt", "1995-06-01", f"coalesce(try_strptime(order_date, '%Y-%m-%d'), try_strptime(order_date, '%Y/%m/%d'), try_strptime(order_date, '%m/%d/%Y'), try_strptime(order_date, '%d/%m/%Y')) < TIMESTAMP '1995-06-01'")
filter_query("w6_filter_empty", "notes", "empty", None, f"notes IS NULL OR {STRIP('notes')} = ''")


@register("w7_filter_counts", DUCK + "SELECT count(*) FILTER (WHERE revenue > 100000) AS matched, count(*) AS total FROM d")
def filter_counts(spark, d):
    return edits.query_rows(dirty_rows(spark, d), "revenue", "gt", "100000")[1]


# ---- KPIs and charts

SQL_AGGS = {"sum": "sum({})", "avg": "avg({})", "median": "median({})", "min": "min({})", "max": "max({})", "stddev": "stddev_samp({})", "variance": "var_samp({})", "count": "count({})", "count_distinct": "count(DISTINCT {})"}


@register("g1_u3_kpis", " UNION ALL ".join(f"SELECT 'kpi:{a}:l_quantity' AS id, round({s.format('l_quantity')}, 2)::DOUBLE AS value FROM lineitem" for a, s in SQL_AGGS.items()))
def kpis(spark, d):
    li, out = table(spark, d, "lineitem"), None
    for a in charts.AGGREGATIONS:
        one = charts.kpi(li, a, "l_quantity").select("id", "value")
        out = one if out is None else out.unionByName(one)
    return out


@register("g2_g3_kpi_pool", "SELECT 'kpi:rows' AS id, count(*)::DOUBLE AS value FROM orders UNION ALL SELECT 'kpi:cols', 2 UNION ALL " + " UNION ALL ".join(
    f"SELECT 'kpi:{a}:o_totalprice', round({a}(o_totalprice), 2) FROM orders" for a in ("avg", "sum", "max")))
def kpi_pool(spark, d):
    df = table(spark, d, "orders").select("o_totalprice", "o_orderstatus")
    return charts.kpi_pool(df, profile_columns(df)).select("id", "value")


for _a, _s in SQL_AGGS.items():
    def _chart(spark, d, a=_a):
        return charts.category_chart(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", a)

    register(f"g4_category_{_a}", f"SELECT l_returnflag AS name, {_s.format('l_extendedprice')}::DOUBLE AS value FROM lineitem GROUP BY 1")(_chart)


@register("g5_count_by_category", "SELECT event_type AS name, count(*)::DOUBLE AS value FROM events GROUP BY 1")
def counts(spark, d):
    return charts.category_chart(table(spark, d, "events"), "event_type")


TOP50 = "WITH g AS (SELECT CAST(l_suppkey AS VARCHAR) AS name, {}::DOUBLE AS value FROM lineitem GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY value DESC, name) AS n FROM g) SELECT name, value FROM r WHERE n <= 50"


@register("g6_other_slice", TOP50.format("sum(l_quantity)") + " UNION ALL SELECT 'Other', sum(value) FROM r WHERE n > 50 HAVING count(*) > 0")
def other_slice(spark, d):
    return charts.category_chart(table(spark, d, "lineitem"), "l_suppkey", "l_quantity")


@register("g7_top_only", TOP50.format("max(l_extendedprice)"))
def top_only(spark, d):
    return charts.category_chart(table(spark, d, "lineitem"), "l_suppkey", "l_extendedprice", "max")


@register("g8_undefined_spread", DUCK + "SELECT email AS name, stddev_samp(revenue) AS value FROM d WHERE email IS NOT NULL AND revenue IS NOT NULL GROUP BY 1 HAVING count(*) > 1 ORDER BY 2 DESC, 1 LIMIT 50")
def spread(spark, d):
    return charts.category_chart(dirty_sales(spark, d), "email", "revenue", "stddev")


@register("g9_monthly_trend", DUCK + f"SELECT strftime({AS_DATE}, '%Y-%m') AS x, sum(revenue) AS y FROM d WHERE {AS_DATE} IS NOT NULL AND revenue IS NOT NULL GROUP BY 1")
def trend(spark, d):
    return charts.line_chart(dirty_sales(spark, d), "order_date", "revenue")


@register("g10_scatter", """WITH p AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n, o_totalprice AS x, o_custkey::DOUBLE AS y FROM orders)
SELECT x, y FROM p WHERE n <= 5000 OR i % (n // 5000 + 1) = 0""")
def scatter(spark, d):
    return charts.scatter_chart(with_row_ids(table(spark, d, "orders"), ["o_orderkey"]), "o_totalprice", "o_custkey")


@register("g11_histogram", """WITH s AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 10 AS w FROM orders),
b AS (SELECT least(greatest(ceil((o_totalprice - lo) / w), 1), 10)::INTEGER AS bin FROM orders, s)
SELECT i::INTEGER AS bin, (SELECT count(*) FROM b WHERE bin = i) AS value FROM range(1, 11) t(i)""")
def hist(spark, d):
    return charts.histogram(table(spark, d, "orders"), "o_totalprice").select("bin", "value")


@register("g12_g20_coverage", DUCK + f"""SELECT count(*) FILTER (WHERE revenue IS NOT NULL AND {AS_DATE} IS NOT NULL) AS rows_used, count(*) AS rows_total,
  count(*) FILTER (WHERE revenue IS NOT NULL AND {AS_DATE} IS NOT NULL) / count(*) AS confidence,
  count(*) FILTER (WHERE revenue IS NOT NULL AND {AS_DATE} IS NOT NULL) / count(*) < 0.6 AS needs_review,
  count(*) FILTER (WHERE {AS_DATE} IS NULL) AS missing_order_date, count(*) FILTER (WHERE revenue IS NULL) AS missing_revenue FROM d""")
def covered(spark, d):
    return charts.coverage(dirty_sales(spark, d), {"order_date": "date", "revenue": "number"})


@register("g13_g14_chart_type", "SELECT CASE WHEN count(DISTINCT l_returnflag) <= 4 THEN 'pie' ELSE 'bar' END AS type, 'Total l_quantity by l_returnflag' AS title FROM lineitem")
def typed(spark, d):
    points = charts.category_chart(table(spark, d, "lineitem"), "l_returnflag", "l_quantity")
    return charts.chart_type(points).withColumn("title", F.lit(charts.chart_title("l_returnflag", "l_quantity")[0]))


@register("g15_auto_dashboard")
def dashboard(spark, d):
    out = None
    for widget, data in charts.dashboard(dirty_rows(spark, d)).items():
        one = data.agg(F.count("*").alias("points")).select(F.lit(widget).alias("widget"), "points")
        out = one if out is None else out.unionByName(one)
    return out


@register("g16_g17_default_widgets")
def default_widgets(spark, d):
    pool = charts.chart_pool(profile_columns(dirty_sales(spark, d)))
    rows = spark.createDataFrame([(k, i, t) for k, (i, t) in enumerate(pool)], "ord int, id string, type string")
    return charts.default_selection(rows)


@register("g18_widget", "SELECT o_orderpriority AS name, avg(o_totalprice) AS value FROM orders GROUP BY 1")
def widget(spark, d):
    return charts.build_widget(table(spark, d, "orders"), "chart:bar:o_orderpriority:avg(o_totalprice)")


# ---- SQL over a dataset


@register("k1_k3_guarded_sql", "SELECT o_orderpriority, count(*) AS n, avg(CAST(o_totalprice AS DOUBLE)) AS mean FROM orders WHERE o_orderpriority LIKE '%I%' GROUP BY 1")
def guarded(spark, d):
    q = """SELECT "o_orderpriority", COUNT(*) AS n, AVG(TRY_CAST(CAST(o_totalprice AS VARCHAR) AS DOUBLE)) AS mean FROM dataset WHERE regexp_matches("o_orderpriority", 'I') GROUP BY 1 ORDER BY 2"""
    return query.run_sql(table(spark, d, "orders"), q)


@register("k4_windows_in_sql", "SELECT o_orderkey, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey)::INTEGER AS r FROM orders QUALIFY rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) <= 100")
def windows(spark, d):
    return query.run_sql(table(spark, d, "orders"), "WITH x AS (SELECT o_orderkey, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS r FROM dataset) SELECT * FROM x WHERE r <= 100")


@register("k5_query_frame", DUCK + f"SELECT 'order_date' AS column_name, count(*) FILTER (WHERE {AS_DATE} IS NULL) AS unparsed FROM d")
def framed(spark, d):
    df = dirty_sales(spark, d).select("order_date", "revenue")
    return query.query_frame(df, profile_columns(df))[1]


@register("k6_same_text", DUCK + f"SELECT order_id FROM d WHERE lower({STRIP('segment')}) = 'furniture'")
def same_text(spark, d):
    return dirty_sales(spark, d).where(query.same_text("segment", "Furniture ")).select("order_id")


@register("k7_top_categories", "SELECT o_custkey, sum(o_totalprice) AS sum_o_totalprice FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top(spark, d):
    return query.top_categories(table(spark, d, "orders"), "o_custkey", "o_totalprice")


@register("k8_by_category", "SELECT o_orderpriority, max(o_totalprice) AS max_o_totalprice FROM orders GROUP BY 1")
def by_cat(spark, d):
    return query.by_category(table(spark, d, "orders"), "o_orderpriority", "o_totalprice", "max")


@register("k9_frequency_table", "SELECT source, count(*) AS count FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25")
def freq(spark, d):
    return query.frequency_table(table(spark, d, "documents"), "source")


@register("k10_raw_trend", "SELECT o_orderdate, sum(o_totalprice) AS sum_o_totalprice FROM orders GROUP BY 1 ORDER BY 1 LIMIT 500")
def raw(spark, d):
    return query.raw_trend(table(spark, d, "orders"), "o_orderdate", "o_totalprice")


@register("k12_summary", "SELECT min(value) AS min_value, max(value) AS max_value, avg(value) AS avg_value FROM events")
def summary(spark, d):
    return query.measure_summary(table(spark, d, "events"), "value")


@register("k13_k14_filtered", "SELECT count(*) AS count FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000")
def filtered(spark, d):
    o = table(spark, d, "orders")
    return query.filtered(o, query.rule(o, "o_orderstatus", "=", "f") & query.rule(o, "o_totalprice", ">", 200000), "count")


@register("k14_row_count", "SELECT count(*) AS row_count FROM events")
def rows(spark, d):
    return query.row_count(table(spark, d, "events"))


@register("k15_find_value", "SELECT DISTINCT 'lang' AS column_name, lang AS value FROM documents WHERE lower(lang) = 'de'")
def find(spark, d):
    df = table(spark, d, "documents").select("lang", "source")
    return query.find_value(df, profile_columns(df), "How many rows are in de?")


@register("k16_variants", "SELECT lower(source) AS variant, count(*) AS n FROM documents WHERE starts_with(lower(source), 'src1') AND lower(source) <> 'src1' GROUP BY 1")
def variants(spark, d):
    return query.spelling_variants(table(spark, d, "documents"), "source", "src1")


@register("k17_result_facts", """WITH g AS (SELECT o_orderpriority AS label, sum(o_totalprice) AS value FROM orders GROUP BY 1),
r AS (SELECT row_number() OVER (ORDER BY value DESC)::INTEGER AS rank, label, value, value / sum(value) OVER () * 100 AS share, sum(value) OVER () AS total, count(*) OVER () AS rows FROM g)
SELECT * FROM r WHERE rank <= 3 OR rank = rows""")
def facts(spark, d):
    return query.result_facts(table(spark, d, "orders").groupBy("o_orderpriority").agg(F.sum("o_totalprice").alias("v")))


@register("k19_ungrounded_numbers", "SELECT o_orderkey, round(o_totalprice + 7, 2) AS value FROM orders WHERE o_orderkey % 10 = 3")
def grounded(spark, d):
    # an answer states its order's price, rounded to one decimal or two; every tenth one states another number
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    text = F.when(F.col("o_orderkey") % 10 == 3, F.format_number(F.col("o_totalprice") + 7, 2)).when(F.col("o_orderkey") % 2 == 0, F.format_number("o_totalprice", 2)).otherwise(F.format_number("o_totalprice", 1))
    said = o.select("o_orderkey", F.concat(F.lit("It comes to "), text, F.lit(" in all.")).alias("text"))
    return query.ungrounded(said, o.select("o_orderkey", F.col("o_totalprice").alias("value")), "o_orderkey")


@register("k19_any_fact", r"""WITH f AS (SELECT o_totalprice AS v FROM orders UNION ALL SELECT count(*)::DOUBLE FROM orders UNION ALL SELECT 2.0),
s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 3 THEN round(o_totalprice * 3, 2) ELSE round(o_totalprice, 2) END AS value, 2 AS d FROM orders
  UNION ALL SELECT o_orderkey, n::DOUBLE AS value, 0 FROM orders, (SELECT count(*) AS n FROM orders)),
p AS (SELECT *, unnest([greatest(d - 1, 0), d, d + 1]) AS p FROM s)
SELECT o_orderkey, value FROM s EXCEPT ALL SELECT DISTINCT o_orderkey, value FROM p
WHERE (p, floor(value * pow(10, p) + 0.5 + 1e-9)) IN (SELECT (p, floor(v * pow(10, p) + 0.5 + 1e-9)) FROM f, (SELECT unnest(range(4)) AS p))""")
def grounded_anywhere(spark, d):
    # an answer states the number of rows and a price, every tenth one a triple price; any order's price grounds it
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    price = F.when(F.col("o_orderkey") % 10 == 3, F.col("o_totalprice") * 3).otherwise(F.col("o_totalprice"))
    said = o.select("o_orderkey", F.concat(F.lit(f"Of {o.count():,} rows one costs "), F.format_number(price, 2), F.lit(".")).alias("text"))
    return query.ungrounded(said, o.select(F.col("o_totalprice").alias("value")), "o_orderkey", table=o)


@register("k11_pairs", "SELECT l_quantity, l_extendedprice FROM lineitem WHERE l_orderkey = (SELECT min(l_orderkey) FROM lineitem)")
def number_pairs(spark, d):
    rows = table(spark, d, "lineitem")
    return query.pairs(rows.join(rows.agg(F.min("l_orderkey").alias("l_orderkey")), "l_orderkey"), "l_quantity", "l_extendedprice")


@register("k18_truncation", """SELECT * FROM (VALUES ('capped', 'The table stops at 1,000 rows; sums over it leave the others out.'), ('cut', 'LIMIT 7 cut the list without an order; count the rows for a total.'),
('ordered', NULL), ('whole', NULL)) t(query, note) WHERE (SELECT count(*) FROM orders) > 1000""")
def truncation_notes(spark, d):
    asked = {"capped": "SELECT * FROM dataset", "cut": "SELECT o_orderkey FROM dataset LIMIT 7", "ordered": "SELECT o_orderkey FROM dataset ORDER BY o_totalprice LIMIT 7", "whole": "SELECT o_orderstatus, count(*) AS n FROM dataset GROUP BY 1;"}
    o = table(spark, d, "orders")
    return spark.createDataFrame([(k, query.truncation_note(query.run_sql(o, q))) for k, q in asked.items()], "query string, note string")


@register("k2_refused_queries", "SELECT * FROM (VALUES ('file', false), ('java', false), ('other view', false), ('subquery', false), ('semicolon', true), ('named query', true)) t(query, runs) WHERE (SELECT count(*) FROM orders) > 0")
def refused(spark, d):
    asked = {
        "file": "SELECT * FROM text.`/etc/hostname`", "java": "SELECT reflect('java.lang.System', 'currentTimeMillis') FROM dataset", "other view": "SELECT * FROM other", "semicolon": "SELECT count(*) FROM dataset;",
        "subquery": "SELECT o_orderkey FROM dataset WHERE o_orderkey IN (SELECT o_orderkey FROM other)", "named query": "WITH x AS (SELECT o_orderkey FROM dataset) SELECT count(*) FROM x",
    }
    o = table(spark, d, "orders")
    o.createOrReplaceTempView("other")
    out = []
    for name, q in asked.items():
        try:
            out.append((name, query.run_sql(o, q).count() > 0))
        except query.UnsafeQueryError:
            out.append((name, False))
    return spark.createDataFrame(out, "query string, runs boolean")


@register("g4_median_by_supplier", "SELECT CAST(l_suppkey AS VARCHAR) AS name, median(l_extendedprice)::DOUBLE AS value FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def median_by_supplier(spark, d):
    return charts.category_chart(table(spark, d, "lineitem"), "l_suppkey", "l_extendedprice", "median")


@register("g9_monthly_median", "SELECT strftime(o_orderdate, '%Y-%m') AS x, median(o_totalprice) AS y FROM orders GROUP BY 1")
def monthly_median(spark, d):
    return charts.line_chart(table(spark, d, "orders"), "o_orderdate", "o_totalprice", "median")


@register("s1_failing_rule", "SELECT round(100.0 * count(*) FILTER (WHERE o_totalprice <= 300000) / count(*), 1) AS overall, count(*) FILTER (WHERE o_totalprice > 300000) AS dirty_rows FROM orders")
def score_beside_failing_rules(spark, d):
    # one rule divides by zero on some row and is left out; the others count
    o = with_row_ids(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"])
    rules = [checks.rule_check(o, k, c) for k, c in enumerate(("o_totalprice > 300000", "1 / (o_orderkey - 1) < 0", "o_totalprice < 0;"))]
    facts = checks.gather_facts(o)
    only = {(x.key, x.column) for x in checks.row_checks(o, facts)}
    return score.score(o, facts, rules, only).select("overall", "dirty_rows")


@register("k20_result_chart", "SELECT o_orderpriority AS name, count(*)::DOUBLE AS value FROM orders GROUP BY 1 ORDER BY 1 LIMIT 12")
def result_chart(spark, d):
    return query.result_chart(table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")))[0]


@register("k21_k23_rules", DUCK + "SELECT count(*) FILTER (WHERE try_cast(quantity AS DOUBLE) > 5) AS matched, count(*) AS total FROM d")
def rule_preview(spark, d):
    return checks.preview_rule(dirty_sales(spark, d), query.heal_condition('"quantity" > 5'))[0]


@register("k24_k25_sentence", "SELECT 'n over 3 groups: most in ' || arg_min(s, (-n, s)) || ' (' || format('{:,}', max(n)) || '), least in ' || arg_min(s, (n, s)) || ' (' || format('{:,}', min(n)) || ').' AS answer FROM (SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1) HAVING count(*) = 3")
def said(spark, d):
    return query.sentence(table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n")))


# ---- governance, comparison, insights, history


@register("h1_h6_governance", f"""WITH c AS (SELECT name, i FROM (SELECT unnest({list(COLUMNS)!r}) AS name, generate_subscripts({list(COLUMNS)!r}, 1) AS i)
WHERE regexp_matches(lower(name), '{"|".join(govern.PII_HINTS)}')) SELECT 'pii' AS classification, list(name ORDER BY i) AS pii_columns, 'Personal by name or meaning: ' || string_agg(name, ', ' ORDER BY i) AS rationale FROM c""")
def governed(spark, d):
    return govern.classify(profile(dirty_sales(spark, d)))


@register("h2_flags", f"""SELECT name, regexp_matches(name, '{"|".join(govern.PII_HINTS)}') AS is_pii, regexp_matches(name, '{"|".join(govern.FINANCIAL_HINTS)}') AS is_financial, regexp_matches(name, '{"|".join(govern.HEALTH_HINTS)}') AS is_health
FROM (SELECT unnest(['c_custkey', 'customer_name', 'account_balance', 'blood_group', 'patient_income']) AS name) WHERE (SELECT count(*) FROM customer) > 0""")
def flagged_columns(spark, d):
    c = table(spark, d, "customer")
    c = c.select("c_custkey", F.col("c_name").alias("customer_name"), F.col("c_acctbal").alias("account_balance"), F.when(F.col("c_custkey") % 2 == 0, "A").otherwise("B").alias("blood_group"), (F.col("c_acctbal") * 2).alias("patient_income"))
    return govern.flag_columns(profile(c)).select("name", "is_pii", "is_financial", "is_health")


@register("h1_health_data", "SELECT 'healthcare' AS classification, count(*) > 0 AS filled FROM customer")
def health_data(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("patient"), F.col("c_acctbal").alias("salary"))
    return govern.classify(profile(c)).select("classification", (F.size("pii_columns") >= 0).alias("filled"))


@register("q6_q7_cardinality", "SELECT 'high_cardinality' AS check_key, 'remark' AS column_name, count(DISTINCT o_orderkey) AS count FROM orders UNION ALL SELECT 'low_cardinality', 'part', count(DISTINCT o_orderkey % 2) FROM orders")
def cardinality(spark, d):
    o = with_row_ids(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"])
    o = o.select(ROW_ID, F.concat(F.lit("said of order "), F.col("o_orderkey").cast("string"), F.lit(" by the clerk")).alias("remark"), (F.col("o_orderkey") % 2).cast("int").alias("part"))
    return checks.run_checks(o, samples=False).where("check_key like '%cardinality'").select("check_key", "column_name", "count")


@register("p13_p14_kinds", """SELECT * FROM (SELECT 'done' AS name, 'boolean' AS physical_type, 'boolean' AS semantic_type, 0::BIGINT AS null_count, 0.0::DOUBLE AS null_pct, count(DISTINCT o_orderstatus = 'F') AS distinct_count FROM orders
UNION ALL SELECT 'at', 'timestamp', 'datetime', count(*) FILTER (WHERE o_orderkey % 10 = 0), round(100.0 * count(*) FILTER (WHERE o_orderkey % 10 = 0) / count(*), 2), count(DISTINCT o_orderdate) FILTER (WHERE o_orderkey % 10 <> 0) FROM orders
UNION ALL SELECT 'nothing', 'string', 'text', count(*), 100.0, 0 FROM orders)""")
def kinds_of_columns(spark, d):
    o = table(spark, d, "orders").select((F.col("o_orderstatus") == "F").alias("done"), F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderdate").cast("timestamp")).alias("at"), F.lit(None).cast("string").alias("nothing"))
    return profile(o).select("name", "physical_type", "semantic_type", "null_count", "null_pct", "distinct_count")


@register("s4_empty_table", "SELECT 0.0::DOUBLE AS overall, count(*) AS row_count, count(*) AS dirty_rows, 0.0::DOUBLE AS validity FROM orders WHERE o_orderkey < 0")
def score_of_nothing(spark, d):
    o = table(spark, d, "orders").where("o_orderkey < 0")
    return score.score(with_row_ids(o, ["o_orderkey"])).select("overall", "row_count", "dirty_rows", "validity")


@register("h4_tier", SPELLINGS + f", s AS (SELECT round(100.0 * count(*) FILTER (WHERE NOT ({ANY_MASK} OR {DOUBLE})) / count(*), 1) AS overall FROM d, q) SELECT overall, CASE WHEN overall >= 80 THEN 'gold' WHEN overall >= 60 THEN 'silver' ELSE 'bronze' END AS ingestion_tier FROM s")
def tiers(spark, d):
    return govern.tier(score.score(dirty_rows(spark, d)), True).select("overall", "ingestion_tier")


KINDS = dict(zip(COLUMNS, ("id", "text", "email", "phone", "url", "categorical", "currency", "currency", "date", "categorical", "currency", "categorical", "categorical", "categorical")))
META = " UNION ALL ".join(f"SELECT '{c}' AS name, '{k}' AS kind, arg_min({c}::VARCHAR, order_id) FILTER (WHERE {c} IS NOT NULL) AS sample_value FROM d" for c, k in KINDS.items())


@register("h5_column_metadata", DUCK + f""", m AS ({META}), p AS (SELECT *, kind IN ('email', 'phone') OR regexp_matches(name, '{"|".join(govern.PII_HINTS)}') AS is_pii FROM m)
SELECT name, array_to_string(list_transform(string_split(name, '_'), lambda x: upper(x[1]) || x[2:]), ' ') AS business_name, kind || ' column' AS description,
CASE WHEN is_pii THEN 'pii' ELSE 'internal' END AS sensitivity, is_pii, sample_value FROM p""")
def metadata(spark, d):
    return govern.column_metadata(profile(dirty_rows(spark, d)))


def halves(spark, d):
    o = table(spark, d, "orders")
    return o.where("o_orderkey % 2 = 0").drop("o_orderpriority"), o.where("o_orderkey % 2 = 1").withColumn("extra", F.lit(1))


@register("d1_schema_diff", "SELECT * FROM (VALUES ('o_orderkey', 'common'), ('o_custkey', 'common'), ('o_orderstatus', 'common'), ('o_totalprice', 'common'), ('o_orderdate', 'common'), ('o_orderpriority', 'added'), ('extra', 'added')) t(column_name, status) WHERE (SELECT count(*) FROM orders) > 0")
def schema_diff(spark, d):
    return govern.schema_diff(*halves(spark, d))


DRIFT = " UNION ALL ".join(f"SELECT '{c}' AS column_name, avg({c}) FILTER (WHERE o_orderkey % 2 = 0) AS left_mean, avg({c}) FILTER (WHERE o_orderkey % 2 = 1) AS right_mean FROM orders" for c in ("o_orderkey", "o_custkey", "o_totalprice"))


@register("d2_d3_drift", f"SELECT *, (right_mean - left_mean) / abs(left_mean) * 100 AS mean_change_pct FROM ({DRIFT})")
def drifted(spark, d):
    a, b = halves(spark, d)
    return govern.top_shifts(govern.drift(a, b)).select("column_name", "left_mean", "right_mean", "mean_change_pct")


@register("d4_d5_compare", """WITH s AS (SELECT round(100 * avg((o_orderstatus = 'F')::INT) FILTER (WHERE o_orderkey % 2 = 0), 1) AS a,
  round(100 * avg((o_orderstatus = 'F')::INT) FILTER (WHERE o_orderkey % 2 = 1 AND o_orderkey % 3 <> 0 OR o_orderkey % 2 = 1 AND o_orderstatus = 'F'), 1) AS b FROM orders)
SELECT (count(*) FILTER (WHERE o_orderkey % 2 = 1) - count(*) FILTER (WHERE o_orderkey % 2 = 0))::BIGINT AS row_delta, 2::BIGINT AS added, 0::BIGINT AS removed, 5::BIGINT AS common,
round(b - a, 1) AS score_delta, CASE WHEN b - a >= 2 THEN 'improved' WHEN b - a <= -2 THEN 'regressed' ELSE 'equivalent' END AS verdict FROM orders, s GROUP BY a, b""")
def compared(spark, d):
    # as scores the shares of closed orders, the second half without a third of its open ones
    a, b = halves(spark, d)
    share = lambda x: x.agg(F.round(100 * F.avg((F.col("o_orderstatus") == "F").cast("int")), 1).alias("overall"))
    scores = share(a), share(b.where("o_orderkey % 3 <> 0 or o_orderstatus = 'F'"))
    return govern.compare(a, b, *scores).select("row_delta", "added", "removed", "common", "score_delta", "verdict")


@register("d6_comparison_text")
def narrated(spark, d):
    a, b = halves(spark, d)
    sa, sb = score.score(a), score.score(b)
    return govern.comparison_text("even", "odd", govern.compare(a, b, sa, sb), govern.top_shifts(govern.drift(a, b)))


@register("i1_insights")
def insight(spark, d):
    df = dirty_rows(spark, d)
    facts = checks.gather_facts(df, samples=True)
    return govern.insights(profile_frame(spark, facts.columns), score.score(df, facts))


NULL_SHARES = " UNION ALL ".join(f"SELECT '{c}' AS name, round(100.0 * count(*) FILTER (WHERE {c} IS NULL) / count(*), 2) AS pct FROM d" for c in COLUMNS)


@register("i2_story", SPELLINGS + f""", s AS (SELECT count(*) AS n, count(*) FILTER (WHERE NOT ({ANY_MASK} OR {DOUBLE})) AS clean FROM d, q), g AS ({NULL_SHARES}),
o AS (SELECT n, clean, round(100.0 * clean / n, 1) AS overall, (SELECT arg_max(name, pct) FROM g) AS gap, (SELECT max(pct) FROM g) AS pct FROM s)
SELECT concat_ws(chr(10), 'Table dirty_sales: ' || format('{{:,}}', n) || ' rows by {len(COLUMNS)} columns.', 'Score ' || overall || ', ' || format('{{:,}}', clean) || ' rows pass all checks.',
'Most nulls: ' || gap || ' with ' || pct || ' %.', '{sum(k == "currency" for k in KINDS.values())} measures, {sum(k in ("categorical", "text") for k in KINDS.values())} groupings.',
'Next: ' || CASE WHEN overall < 90 THEN 'clean the table.' ELSE 'query or chart the table.' END) AS story FROM o""")
def story(spark, d):
    df = dirty_rows(spark, d)
    facts = checks.gather_facts(df, samples=True)
    return govern.data_story("dirty_sales", profile_frame(spark, facts.columns), score.score(df, facts))


@register("i3_questions")
def questions(spark, d):
    return spark.createDataFrame([(q,) for q in govern.starter_questions(profile_columns(dirty_sales(spark, d)))], "question string")


@register("i4_explain_points", "SELECT 'price: most in ' || arg_min(p, (-v, p)) || ' (' || format('{:,.2f}', max(v)) || '), least in ' || arg_min(p, (v, p)) || ' (' || format('{:,.2f}', min(v)) || ').' AS explanation FROM (SELECT o_orderpriority AS p, sum(o_totalprice) AS v FROM orders GROUP BY 1)")
def explained_points(spark, d):
    return govern.explain_points(charts.category_chart(table(spark, d, "orders"), "o_orderpriority", "o_totalprice"), "price")


@register("t1_activity", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 20 OFFSET 40")
def activity(spark, d):
    log = table(spark, d, "events").withColumn("at", F.struct("ts", "event_id"))
    return govern.activity_page(log, 20, 40)[0].select("event_id", "event_type")


@register("t2_catalogue", "SELECT 2::BIGINT AS version, 25::BIGINT AS rows UNION ALL SELECT 1, 5")
def catalogue(spark, d):
    store = VersionStore(spark, scratch(spark))
    store.save(table(spark, d, "region"), "region")
    store.save(table(spark, d, "nation"), "nation")
    return store.catalogue()[0].select("version", "rows")


# ---- identity with nulls, forms of dates, exports, rules, cleaned names


SWAPPED = """WITH s AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'v' || CAST(c_custkey % 100 // 2 AS VARCHAR) END AS a, CASE WHEN c_custkey % 2 = 1 THEN 'v' || CAST(c_custkey % 100 // 2 AS VARCHAR) END AS b FROM customer) """


def swapped_nulls(spark: SparkSession, d: str) -> DataFrame:
    """Rows (x, null) and (null, x) for the same x."""
    value = F.concat(F.lit("v"), F.floor(F.col("c_custkey") % 100 / 2).cast("string"))
    odd = F.col("c_custkey") % 2 == 1
    rows = table(spark, d, "customer").select("c_custkey", F.when(~odd, value).alias("a"), F.when(odd, value).alias("b"))
    return with_row_ids(rows, ["c_custkey"]).drop("c_custkey")


@register("q3_m1_swapped_nulls", SWAPPED + "SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT a, b FROM s)) AS repeats, (SELECT count(*) FROM s JOIN (SELECT a, b FROM s GROUP BY a, b HAVING count(*) > 1) g ON s.a IS NOT DISTINCT FROM g.a AND s.b IS NOT DISTINCT FROM g.b) AS listed FROM s")
def swapped_counts(spark, d):
    df = swapped_nulls(spark, d)
    found = checks.run_checks(df, samples=False).where("check_key = 'duplicate_rows'").select(F.col("count").alias("repeats"), F.lit(1).alias("_k"))
    listed = checks.affected_rows(df, "duplicate_rows").agg(F.count(F.lit(1)).alias("listed")).withColumn("_k", F.lit(1))
    return found.join(listed, "_k").drop("_k")


@register("x1_swapped_nulls", SWAPPED + "SELECT DISTINCT a, b FROM s")
def swapped_first(spark, d):
    return fixes.apply_fix(swapped_nulls(spark, d), "duplicate_rows").df.select("a", "b")


@register("x12_first_of_each_id", "SELECT l_orderkey, first(l_linenumber ORDER BY l_linenumber, l_partkey) AS l_linenumber, first(l_partkey ORDER BY l_linenumber, l_partkey) AS l_partkey FROM lineitem GROUP BY 1")
def first_of_id(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return fixes.apply_fix(with_row_ids(rows, ["l_orderkey", "l_linenumber", "l_partkey"]), "duplicate_ids", "l_orderkey").df.drop(ROW_ID)


DATE_FORMS = (
    "M/d/yyyy", "d MMMM yyyy", "MMMM d, yyyy", "yyyyMMdd", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy/M/d", "d MMM yyyy", "yyyy-M-d H:mm", "M/d/yyyy h:mm a", "M/d/yy", "M.d.yyyy", "MMM yyyy", "MMMM d yyyy H:mm",
    "EEE, dd MMM yyyy", "yyyyMMdd'T'HHmmss", "yyyy/MM/dd HH:mm:ss'Z'", "MMM d'th', yyyy", "EEEE, MMMM d, yyyy", "d-MMM-yy", "dd-MMM-yyyy HH:mm", "yyyy-MM-dd'T'HH:mm:ss'+00:00'", "yyyy-MM", "yyyy MMM d", "d'th' MMMM yyyy",
)


def dates_in_forms(spark, d):
    """Order dates, each in one of the forms by its key; two of 26 keys have no date. September is Sept where it is short."""
    kind = F.col("o_orderkey") % 26
    text = F.when(kind == 24, "32/13/2024").when(kind == 25, "some day")
    for k, form in enumerate(DATE_FORMS):
        text = text.when(kind == k, F.date_format("o_orderdate", form))
    return table(spark, d, "orders").select("o_orderkey", F.regexp_replace(text, r"\bSep\b", "Sept").alias("t"))


@register("v6_forms_of_dates", """SELECT o_orderkey, o_orderkey % 26 < 24 AS date_ok, CASE WHEN o_orderkey % 26 < 24 THEN strftime(o_orderdate, '%Y-%m') END AS month FROM orders""")
def date_forms(spark, d):
    return dates_in_forms(spark, d).select("o_orderkey", V.is_date("t").alias("date_ok"), V.month_of(V.date_reading("t", day_first=False)).alias("month"))


@register("x7_forms_of_dates", "SELECT o_orderkey, o_orderkey % 26 >= 24 AS cleared FROM orders")
def fixed_date_forms(spark, d):
    fixed = fixes.apply_fix(with_row_ids(dates_in_forms(spark, d)), "invalid_date", "t").df
    return fixed.select("o_orderkey", F.col("t").isNull().alias("cleared"))


@register("q14_many_spellings", "SELECT 'Part ' || CAST(k AS VARCHAR) || ' x' AS value, 1::BIGINT AS n FROM (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS k FROM lineitem) WHERE k % 1000 = 1")
def many_spellings(spark, d):
    # twice as many spellings as rows of lineitem, two for every key that ends in 001
    keys = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string").alias("k")).distinct()
    upper = keys.select(F.concat(F.lit("PART "), "k", F.lit(" X")).alias("t"))
    more = keys.select(F.concat(F.lit("other "), "k").alias("t"))
    odd = keys.where("cast(k as long) % 1000 = 1").select(F.concat(F.lit("Part "), "k", F.lit(" x")).alias("t"))
    return checks.odd_spellings(value_frequencies(upper.unionByName(more).unionByName(odd), ["t"])).select("value", "n")


@register("a13_issue_report", FINDINGS_SQL.replace("SELECT check_key, column_name, dimension, severity, count::BIGINT AS count FROM parts", "SELECT check_key, column_name, severity, count::BIGINT AS count FROM parts"))
def issue_report(spark, d):
    df, out = dirty_rows(spark, d), scratch(spark)
    files.export_issues(checks.run_checks(df, samples=False), out, df.count())
    return spark.read.option("header", True).schema("check_key string, column_name string, severity string, count long, recommended_fix string").csv(out).drop("recommended_fix")


@register("a14_report_payload", "SELECT o_orderpriority AS name, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT o_orderstatus, count(*) FROM orders GROUP BY 1")
def payload(spark, d):
    o = table(spark, d, "orders")
    parts = {k: o.groupBy(F.col(c).alias("name")).agg(F.count("*").alias("n")) for k, c in (("priorities", "o_orderpriority"), ("states", "o_orderstatus"))}
    read = lambda k: F.from_json(F.get_json_object("payload", f"$.{k}"), "array<struct<name string, n long>>")
    return files.report_payload(**parts).select(F.explode(F.concat(read("priorities"), read("states"))).alias("r")).select("r.*")


@register("s4_score_with_rules", SPELLINGS + f"SELECT round(100.0 * count(*) FILTER (WHERE NOT ({ANY_MASK} OR {DOUBLE} OR order_id % 4 = 1)) / count(*), 1) AS overall, round(100.0 * count(*) FILTER (WHERE order_id % 4 <> 1) / count(*), 1) AS kept FROM d, q")
def scored_with_rules(spark, d):
    df = dirty_rows(spark, d)
    rule = checks.rule_check(df, "fourth", "order_id % 4 = 1", "accuracy", "high")
    facts = checks.gather_facts(df)
    others = {(x.key, x.column) for x in score.scored_rows(df, facts)[1]}
    alone = score.score(df, facts, rules=[rule], excluded=others).select(F.col("overall").alias("kept"), F.lit(1).alias("_k"))
    return score.score(df, facts, rules=[rule]).select("overall", F.lit(1).alias("_k")).join(alone, "_k").drop("_k")


@register("s3_total_issues", FINDINGS_SQL.replace("SELECT check_key, column_name, dimension, severity, count::BIGINT AS count FROM parts", "SELECT sum(count)::BIGINT AS total_issues FROM parts"))
def issue_total(spark, d):
    df = dirty_table(spark, d)
    return score.with_issue_total(spark.createDataFrame([(0,)], "overall int"), checks.run_checks(df, samples=False)).select("total_issues")


@register("u1_registered_check", "SELECT 'big_orders' AS check_key, count(*) AS count FROM orders WHERE o_totalprice > 300000")
def registered(spark, d):
    def big(df, facts):
        return [checks.RowCheck("big_orders", "o_totalprice", F.col("o_totalprice") > 300000, "accuracy", "info")]

    def broken(df, facts):
        raise RuntimeError("a user's mistake")

    def unknown(df, facts):
        return [checks.RowCheck("unknown", None, F.col("no_such_column") > 0, "accuracy", "info")]

    own = [checks.register_check(f) for f in (broken, unknown, big)]
    try:
        found = checks.run_checks(with_row_ids(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"]), samples=False)
        return found.where("check_key in ('big_orders', 'unknown')").select("check_key", "count")
    finally:
        for f in own:
            checks.CHECKS.remove(f)


@register("c4_c6_c8_clean_names", """WITH c AS (SELECT c_custkey AS customer_id, CASE c_custkey % 4 WHEN 0 THEN 'm' WHEN 1 THEN 'Male' WHEN 2 THEN 'f' ELSE 'woman' END AS gender,
  CASE c_custkey % 3 WHEN 0 THEN 'usa' WHEN 1 THEN 'UK' ELSE 'Peru' END AS country, CASE WHEN c_custkey % 50 = 7 THEN NULL WHEN c_custkey % 97 = 0 THEN c_acctbal * 1000 ELSE c_acctbal END AS amount FROM customer),
f AS (SELECT * REPLACE (coalesce(amount, (SELECT median(amount) FROM c)) AS amount) FROM c), q AS (SELECT quantile_cont(amount, 0.25) AS a, quantile_cont(amount, 0.75) AS b FROM f)
SELECT customer_id, CASE gender WHEN 'm' THEN 'Male' WHEN 'Male' THEN 'Male' ELSE 'Female' END AS gender, CASE country WHEN 'usa' THEN 'United States' WHEN 'UK' THEN 'United Kingdom' ELSE 'Peru' END AS country,
  least(greatest(amount, a - 1.5 * (b - a)), b + 1.5 * (b - a)) AS amount FROM f, q""")
def cleaned_names(spark, d):
    k, of = F.col("c_custkey"), lambda c, *v: F.element_at(F.array(*map(F.lit, v)), (c + 1).cast("int"))
    amount = F.when(k % 50 == 7, None).when(k % 97 == 0, F.col("c_acctbal") * 1000).otherwise(F.col("c_acctbal"))
    rows = table(spark, d, "customer").select(k.alias("customer_id"), of(k % 4, "m", "Male", "f", "woman").alias("gender"), of(k % 3, "usa", "UK", "Peru").alias("country"), amount.alias("amount"))
    return fixes.clean(with_row_ids(rows, ["customer_id"]))[0].drop(ROW_ID)


@register("x18_baseline", "SELECT o_orderkey, o_orderstatus FROM orders")
def baseline(spark, d):
    store = VersionStore(spark, scratch(spark))
    first = store.save(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "orders")
    store.save(store.read(first).where("o_orderstatus = 'F'"), "orders", parent=first, is_cleaned=True)
    return store.read(store.baseline())


@register("x19_newest_changes", "SELECT o_orderdate AS at, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 20")
def newest(spark, d):
    return fixes.newest_first(table(spark, d, "orders").groupBy(F.col("o_orderdate").alias("at")).agg(F.count("*").alias("n")))


@register("s10_texts", FINDINGS_SQL.replace("SELECT check_key, column_name, dimension, severity, count::BIGINT AS count FROM parts", "SELECT check_key, column_name, column_name || ': ' || count || ' of ' || (SELECT count(*) FROM d) || ' rows (' || printf('%.1f', round(count * 100.0 / (SELECT count(*) FROM d), 1)) || ' %) are flagged: ' || cause || '.' AS why FROM parts JOIN (VALUES "
          + ", ".join("('" + k + "', '" + v[0] + "')" for k, v in score.EXPLANATIONS.items()) + ") w(key, cause) ON key = check_key") + f" AND column_name IS NOT NULL AND check_key NOT IN {checks.COLUMN_LEVEL}")
def texts(spark, d):
    df = dirty_table(spark, d)
    told = score.explain(checks.run_checks(df, samples=False), df.count())
    return told.where(F.col("column_name").isNotNull() & ~F.col("check_key").isin(*checks.COLUMN_LEVEL)).select("check_key", "column_name", "why")
