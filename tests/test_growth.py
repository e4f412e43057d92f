"""Work of the checks that must not grow with the rows: patterns on distinct values, facts gathered once, fine shuffles."""

import re

from golden import SCHEMA, golden_rows
from pyspark.sql import functions as F

from cleargrain.functions import values as V
from cleargrain.operators import checks, fixes, query, score
from cleargrain.operators.profile import value_frequencies
from cleargrain.plans import catalog
from cleargrain.sources.rowid import ROW_ID


def golden_table(spark):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(golden_rows())], f"{ROW_ID} long, {SCHEMA}")


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_scores_match_no_patterns_on_rows(spark):
    golden = golden_table(spark)
    facts = checks.gather_facts(golden)
    scores = score.score(golden, facts)
    assert "RLIKE" not in optimized(scores)
    assert scores.first()["dirty_rows"] == 16
    # the masks that name values say what the patterns say, and stay as they are where many values fail
    plain = checks.row_checks(golden, facts)
    for named in (checks.known_values(facts, plain), _with_few(0, facts, plain)):
        counts = [golden.agg(*[F.count_if(x.mask).alias(f"c{i}") for i, x in enumerate(some)]).first() for some in (plain, named)]
        assert counts[0] == counts[1]


def _with_few(n, facts, plain):
    most, checks.FEW_VALUES = checks.FEW_VALUES, n
    try:
        return checks.known_values(facts, plain)
    finally:
        checks.FEW_VALUES = most


def test_facts_are_gathered_once(spark, monkeypatch):
    gathered = []
    real = checks.gather_facts
    for module in (checks, score, fixes):
        monkeypatch.setattr(module, "gather_facts", lambda *a, **k: gathered.append(1) or real(*a, **k))
    catalog.QUERIES["s4_score_with_rules"](spark, "/root/testdata/sf0.001")
    assert len(gathered) == 1


def test_wide_expressions_are_split(spark):
    checks.gather_facts(golden_table(spark))
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8_000


def test_space_and_dates_by_their_ends(spark):
    texts = ["", " ", "a", " a", "a ", "a b", " a", "a ", "a\n", "\x1ca", "a\x85", "　", "é x", "\U0001f600 ", "a​"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    old = F.regexp_replace("t", f"^{V._SPACE}+|{V._SPACE}+$", "")
    for r in df.select("t", V.strip("t").alias("new"), old.alias("old"), V.has_outer_space("t").alias("spaced")).collect():
        assert (r["new"], r["spaced"]) == (r["old"], r["old"] != r["t"]), r
    # years of five digits, signs, weekdays, days beyond 12 in either order, and texts that only look like a date's start
    dates = {"13/01/2024": True, "01/13/2024": True, "13/13/2024": False, "0/1/2024": False, "31-12-2024 5:06": True, "Tuesday, 5 March 2024": True, "5th of March 2024": True,
             "sept 5, 2024": True, "march": False, "monday": False, "+2024-01-05": True, "x2024-01-05": False}
    df = spark.createDataFrame(list(dates.items()), "t string, want boolean")
    wrong = [r["t"] for r in df.select("t", "want", V.is_date("t").alias("got")).collect() if r["want"] != r["got"]]
    assert not wrong
    months = spark.createDataFrame([("13/01/2024",), ("01/02/2024",), ("12/12/2024",)], "t string").select(V.month_of(V.date_reading("t", day_first=False)).alias("m"))
    assert [r["m"] for r in months.collect()] == ["2024-01", "2024-01", "2024-12"]


def test_cleared_values_are_tested_once(spark):
    chain = fixes.Chain(golden_table(spark))
    chain.fix("invalid_email", "email")
    assert len(re.findall("RLIKE [^ ]*A-Za-z0-9._%", optimized(chain.table.select("email")))) <= 1
    assert chain.finish()[0].where("email is null").count() == 5

def test_shuffles_of_spellings_and_numbers_start_fine(spark):
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    spark.conf.unset(name)
    words = spark.createDataFrame([("Ab",), ("Ab",), ("aB",)], "t string")
    odd = checks.odd_spellings(value_frequencies(words, ["t"]))
    assert [tuple(r) for r in odd.collect()] == [("t", "aB", 1, "Ab")]
    assert ", 1000)" in odd._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset(name)
    said = spark.createDataFrame([(1, "It is 2.5 or 7.")], "id long, text string")
    open_ = query.ungrounded(said, spark.createDataFrame([(2.5,)], "value double"))
    assert [tuple(r) for r in open_.collect()] == [(1, 7.0)]
    assert ", 1000)" in open_._jdf.queryExecution().executedPlan().toString()


def test_findings_need_no_join_and_no_second_pass_of_values(spark, monkeypatch):
    golden = golden_table(spark).drop(ROW_ID)
    facts = checks.gather_facts(golden)
    mine = checks.row_checks(golden, facts)
    plain = golden.agg(*[F.count_if(x.mask).alias(f"c{i}") for i, x in enumerate(mine)]).first()
    assert all(x.known == n for x, n in zip(mine, plain) if x.test or x.key == "missing_values")
    flagged, doubles = checks.flag_duplicates(golden, facts)
    want = {(r[0], r[4]): (r[3], r[5]) for r in checks.run_checks(golden, facts).collect()}

    def refused(*a, **k):
        raise AssertionError("not for counts")

    for name in ("looked_up", "failing_values"):
        monkeypatch.setattr(checks, name, refused)
    got = {(r[0], r[4]): r[3] for r in checks.run_checks(golden, facts, samples=False).collect()}
    assert got == {k: v[0] for k, v in want.items()}
    assert [got[x.key, x.column] for x in doubles] == checks.count_checks(flagged, doubles) == [2, 2]
    # counts of the profile are those of its own table; facts without frequencies are counted on the rows
    assert all(x.known is None for x in checks.row_checks(golden, checks.Facts(facts.columns)))


def test_duplicates_of_values_that_texts_do_not_tell_apart(spark):
    """Arrays with a null and with the word null are one text and two ids; NaN, both zeros and nulls count as groups do."""
    odd = spark.sql("SELECT * FROM VALUES (array(null), 0.0D, 1), (array('null'), -0.0D, 1), (array('null'), double('NaN'), 1), (array('a'), double('NaN'), 1), (null, null, 1), (null, null, 1) AS t(set_id, x_id, one)")
    facts = checks.gather_facts(odd)
    for c in facts.columns:
        c.semantic_type = "id"
    flagged, masks = checks.flag_duplicates(odd, facts)
    own = checks.duplicate_checks(odd, facts)
    assert [(x.key, x.column, x.known) for x in own] == [(x.key, x.column, n) for x, n in zip(masks, checks.count_checks(flagged, masks))]
    assert [x.known for x in own] == [1, 1, 2, 5]


def test_only_columns_that_may_be_twins_are_compared(spark):
    golden = golden_table(spark)
    facts = checks.gather_facts(golden)
    assert checks.possible_twins(golden, [c for c in facts.columns if c.name != "revenue"]) == ["customer_id", "order_date", "tier", "tier_copy"]
    assert checks.duplicate_column_pairs(golden, facts.columns) == [("tier_copy", "tier")]
    # both zeros are one value and two texts; rows that occur twice leave no trace in an exclusive or
    zeros = spark.createDataFrame([(0.0, "0.0", "a", "c"), (-0.0, "-0.0", "b", "d"), (1.5, "1.5", "a", "c"), (1.5, "1.5", "a", "c")], "x double, y string, z string, w string")
    assert checks.duplicate_column_pairs(zeros, checks.gather_facts(zeros).columns) == [("y", "x")]


def test_phones_and_control_characters_by_plain_patterns(spark):
    texts = ["", "5550100", "555010", "+1 (555) 012-3456", "123456789012345", "1234567890123456", "1-2-3-4-5-6-7", "call 5550100", "5550100x", "(((((((", *[f"a{chr(k)}b" for k in range(1, 0xA0)], "a�b", "é"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    phone = F.col("t").rlike(V.PHONE) & F.regexp_count("t", F.lit(r"\d")).between(7, 15)
    corrupted = F.col("t").rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f�]")
    got = df.select("t", V._phone(F.col("t")).alias("p"), phone.alias("p0"), V.is_corrupted("t").alias("c"), corrupted.alias("c0"))
    assert all(r["p"] == r["p0"] and r["c"] == r["c0"] for r in got.collect())
    assert "regexp_extract_all" not in optimized(df.where(V.is_phone("t"))) and "regexp_count" not in optimized(df.where(V.is_phone("t")))


def test_profile_of_texts_reads_no_rows(spark):
    """Least and greatest value and nulls of texts come from the values, those of other columns from the rows."""
    rows = spark.createDataFrame([(2, "b", None), (None, "é", None), (1, None, None)], "n int, t string, e string")
    got = {p.name: (p.min_val, p.max_val, p.null_count, p.distinct_count) for p in checks.gather_facts(rows).columns}
    assert got == {"n": ("1", "2", 1, 2), "t": ("b", "é", 1, 2), "e": (None, None, 3, 0)}


def _numbers_no_rows(spark, monkeypatch, query):
    def refused(*a, **k):
        raise AssertionError("counts need no row numbers")

    for name in ("dirty_rows", "with_row_ids"):
        monkeypatch.setattr(catalog, name, refused)
    return catalog.QUERIES[query](spark, "/root/testdata/sf0.001").collect()


def test_explanations_number_no_rows(spark, monkeypatch):
    told = {(r["check_key"], r["column_name"]): r for r in _numbers_no_rows(spark, monkeypatch, "s10_explanations")}
    assert len(told) == 23 and told["invalid_email", "email"]["sample"] == ["bad@@invalid"] and told["duplicate_columns", "tier_copy"]["sample"] == ["tier"]


def test_texts_of_findings_number_no_rows(spark, monkeypatch):
    assert len(_numbers_no_rows(spark, monkeypatch, "s10_texts")) == 19
