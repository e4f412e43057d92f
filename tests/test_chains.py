"""Chains of fixes against single fixes, their logs against a comparison of tables, hot keys, pages by files, and frequencies by type."""

from datetime import date
from decimal import Decimal

import pytest
from golden import SCHEMA, golden_rows
from pyspark.sql import functions as F

from cleargrain.operators import fixes, lookups, profile
from cleargrain.operators.profile import row_key
from cleargrain.sources.rowid import ROW_ID, with_row_ids
from cleargrain.sources.versions import VersionStore

EVERY_FIX = [
    ("whitespace", "notes"), ("missing_values", "email"), ("blank_strings", "notes"), ("invalid_email", "email"), ("duplicate_rows", None), ("case_inconsistency", "state"),
    ("negative_values", "revenue"), ("missing_values", "revenue"), ("outliers", "revenue"), ("duplicate_ids", "customer_id"), ("mixed_types", "quantity"), ("constant_column", "region"),
    ("invalid_date", "order_date"), ("duplicate_columns", "tier_copy"), ("constant_column", "region"), ("unicode_issues", "notes"),
]
PLAN = [fixes.Fix(*f) for f in EVERY_FIX]


@pytest.fixture(scope="module")
def golden(spark):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(golden_rows())], f"{ROW_ID} long, {SCHEMA}").cache()


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


def one_by_one(df, plan):
    done = []
    for f in plan:
        try:
            result = fixes.apply_fix(df, f.key, f.column)
        except fixes.UnfixableIssueError:
            continue
        if result.rows_affected:
            done.append((result.op, result.rows_affected, result.detail))
            df = result.df.checkpoint()
    return df, done


@pytest.mark.parametrize("plan", [PLAN, PLAN[::-1], PLAN[5:] + PLAN[:5]])
def test_a_chain_does_what_its_fixes_do_one_by_one(golden, plan):
    expected, done = one_by_one(golden, plan)
    got, results, log = fixes.fix_all_logged(golden, plan, "customer_id")
    assert got.dtypes == expected.dtypes and rows(got) == rows(expected)
    assert [(r.op, r.rows_affected, r.detail) for r in results] == done
    # a change of type alone is no change of a cell
    assert set(rows(log)) <= set(rows(fixes.changes(golden, expected, "customer_id")))
    touched = {(r[0], r[1]) for r in log.where("kind = 'changed'").select(ROW_ID, "column_name").collect()}
    before, after = {r[ROW_ID]: r for r in golden.collect()}, {r[ROW_ID]: r for r in expected.collect()}
    assert touched == {(k, c) for k, r in after.items() for c in expected.columns if str(r[c]) != str(before[k][c]) and not (isinstance(r[c], float) and r[c] == float(before[k][c] or "nan"))}
    assert {r[0] for r in log.where("kind = 'removed'").select(ROW_ID).collect()} == set(before) - set(after)


def test_a_chain_with_a_table_level_fix_takes_few_jobs(spark, golden):
    tracker, plan = spark.sparkContext.statusTracker(), [PLAN[0], PLAN[3], PLAN[4], PLAN[6]]
    spark.sparkContext.setJobGroup("chain", "")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # which splits a query into a job per shuffle
    try:
        fixes.fix_all(golden, plan)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        jobs = len(tracker.getJobIdsForGroup("chain"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # the groups are written and measured, the table is written; each checkpoint counts its rows as a job of its own, and the groups are broadcast
    assert jobs <= 6


def test_chains_of_no_rows_and_no_fixes(golden):
    empty = golden.limit(0)
    df, done, log = fixes.fix_all_logged(empty, PLAN)
    assert df.count() == 0 and {r.op for r in done} <= {"drop_column"} and log.where("kind != 'dropped column'").count() == 0
    df, done = fixes.fix_all(golden, [])
    assert rows(df) == rows(golden) and not done
    assert rows(fixes.replay(golden, PLAN[:3], without=PLAN[1])[0]) == rows(fixes.fix_all(golden, [PLAN[0], PLAN[2]])[0])


def test_cleaning_logs_what_it_changes(golden):
    df, ops, log = fixes.clean_logged(golden, identifier="customer_id")
    plain, plain_ops = fixes.clean(golden)
    assert rows(df) == rows(plain) and rows(ops) == rows(plain_ops)
    assert set(rows(log)) <= set(rows(fixes.changes(golden, df, "customer_id")))
    counts = {r[0]: r[1] for r in fixes.touched_rows(log).select("column_name", "rows_affected").collect()}
    assert counts[None] == 2 and counts["notes"] >= 3 and counts["email"] == 3


@pytest.mark.parametrize("bytes_broadcast", [lookups.BROADCAST_BYTES, 200, 0])
def test_hot_keys_are_found_by_each_way_of_the_join(spark, monkeypatch, bytes_broadcast):
    """A third of all rows under one key, a third under a frequent key that is not in the table's answers, some under null."""
    monkeypatch.setattr(lookups, "BROADCAST_BYTES", bytes_broadcast)
    df = spark.range(9_000).selectExpr(f"id as {ROW_ID}", "case when id % 3 = 0 then 'hot' when id % 3 = 1 then 'plain' when id % 7 = 0 then null else concat('v', id % 500) end as v")
    answers = df.where("v is not null").groupBy(row_key(["v"]).alias("_k"), "v").agg(F.count("*").alias("_rows")).select("_k", "_rows", F.when(F.col("v") != "plain", F.concat(F.lit("<"), "v", F.lit(">"))).alias("answer"))
    key = F.when(F.col("v").isNotNull(), row_key(["v"]))
    got = lookups.looked_up(df, answers, key)
    assert got.columns == [ROW_ID, "v", "answer"] and got.count() == 9_000
    assert got.where("not (answer <=> case when v != 'plain' then concat('<', v, '>') end)").count() == 0


def test_a_hot_key_is_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(lookups, "BROADCAST_BYTES", 200)
    df = spark.range(40_000).selectExpr(f"id as {ROW_ID}", "case when id % 3 = 0 then 'hot' else concat('v', id % 5000) end as v")
    answers = df.groupBy(row_key(["v"]).alias("_k")).agg(F.count("*").alias("_rows"), F.min(ROW_ID).alias("first"))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sizes = [r[1] for r in lookups.looked_up(df, answers, row_key(["v"])).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive[0])
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", adaptive[1])
    assert sum(sizes) == 40_000 and max(sizes) < 1.3 * 40_000 / len(sizes)


def test_a_deep_page_reads_its_file_alone(spark, tmp_path):
    store = VersionStore(spark, str(tmp_path / "store"))
    df = spark.range(0, 100_000, 1, 5).selectExpr(f"(id * 7919) % 100000 as {ROW_ID}", "id as x").where(f"{ROW_ID} % 3 != 0")  # row numbers with gaps, in no order
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # or such a small table takes one file
    try:
        version = store.save(df, "t", paged=True)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    kept = [k for k in range(100_000) if k % 3]
    assert len(store.read(version).inputFiles()) > 2
    for offset in (0, 17, 60_000, 66_660):
        page = store.page(20, offset, version)
        assert [r[ROW_ID] for r in page.collect()] == kept[offset : offset + 20] and len(page.inputFiles()) <= 2
    assert store.page(20, 70_000, version).count() == 0
    plain = store.save(df, "t", parent=version)
    assert [r[ROW_ID] for r in store.page(3, 50, plain).collect()] == kept[50:53]


def test_writers_never_share_a_version(spark, tmp_path, monkeypatch):
    one, two = (VersionStore(spark, str(tmp_path / "store")) for _ in range(2))
    first = one.save(spark.range(3).toDF("x"), "t")
    empty = spark.createDataFrame([], one.manifest().schema)
    monkeypatch.setattr(two, "manifest", lambda: empty)  # as if it had looked before the other one wrote
    assert (first, two.save(spark.range(4).toDF("x"), "t"), one.restore(first)) == (1, 2, 3)


def test_rows_of_one_key_spread_over_tasks(spark):
    """A key with a third of all rows takes several ranges, and numbers still follow the order, the same in each run."""
    df = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("key"), F.concat(F.lit("t"), "id").alias("text"), F.create_map(F.lit("a"), "id").alias("m"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = with_row_ids(df, ["key"])
        sizes = [r[0] for r in got.groupBy(F.spark_partition_id()).count().select("count").collect()]
        assert max(sizes) < 2 * sum(sizes) / len(sizes) and len(sizes) > 2
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    rows = sorted(got.select("_row_id", "key", "text").collect())
    assert [r[0] for r in rows] == list(range(60_000)) and [r[1] for r in rows] == sorted(r[1] for r in rows)
    assert rows == sorted(with_row_ids(df.repartition(5), ["key"]).select("_row_id", "key", "text").collect())


def test_frequencies_of_every_type(spark):
    """Each type is counted as it is and written as Spark writes it; whole numbers of all widths share a pass; nulls count nowhere."""
    kinds = "`a b` tinyint, i int, l bigint, d double, f float, n decimal(9,2), t date, s string, o boolean, z array<int>, e string"
    row = (1, 2, 3, 0.1, 0.5, Decimal("1.50"), date(2024, 1, 5), "x", True, [1, None], None)
    df = spark.createDataFrame([row, row, (None,) * 11, (2, 2, 3, -0.0, 0.5, None, None, " ", False, [], None), (None, None, None, 0.0, None, None, None, None, None, None, None)], kinds)
    got = {(r[0], r[1]): r[2] for r in profile.value_frequencies(df).collect()}
    assert got == {
        ("a b", "1"): 2, ("a b", "2"): 1, ("i", "2"): 3, ("l", "3"): 3, ("d", "0.1"): 2, ("d", "0.0"): 2, ("f", "0.5"): 3, ("n", "1.50"): 2, ("t", "2024-01-05"): 2,
        ("s", "x"): 2, ("s", " "): 1, ("o", "true"): 2, ("o", "false"): 1, ("z", "[1, null]"): 2, ("z", "[]"): 1,
    }
    assert profile.value_frequencies(df, []).count() == 0
    by_name = {c.name: c.distinct_count for c in profile.profile_columns(df, samples=False)}
    assert by_name == {"a b": 2, "i": 1, "l": 1, "d": 2, "f": 1, "n": 1, "t": 1, "s": 2, "o": 2, "z": 2, "e": 0}


def test_sketches_merge(spark):
    df = spark.range(40_000).select((F.col("id") % 4).alias("part"), (F.col("id") % 9_000).alias("k"), F.lit(None).cast("string").alias("none"))
    merged = profile.merged_sketches(profile.distinct_sketches(df, ["part"])).collect()
    got = {r["name"]: r["approx_distinct"] for r in merged}
    assert got["none"] == 0 and abs(got["k"] - 9_000) < 450
    assert profile.merged_sketches(profile.distinct_sketches(df.limit(0), ["part"])).count() == 0
