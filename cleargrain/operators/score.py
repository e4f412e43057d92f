"""Scores as shares of clean rows, the approval gate, exclusions, explanations and trends."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cleargrain.operators.checks import ALL_DIMENSIONS, COLUMN_LEVEL, SEVERITY_ORDER, Facts, RowCheck, flag_duplicates, flag_spellings, gather_facts, known_values, made_by_users, row_checks, unsound

APPROVED_FROM = 75.0

# Checks that a fix exists for.
FIXABLE = (
    "missing_values", "blank_strings", "whitespace", "duplicate_rows", "invalid_email", "invalid_phone", "invalid_url", "invalid_date",
    "negative_values", "outliers", "case_inconsistency", "mixed_types", "duplicate_ids", "constant_column", "duplicate_columns",
)
#: Cause, effect and repair of each finding; {col} stands for the column.
EXPLANATIONS = {
    "missing_values": ("nothing is stored there", "Means, counts and groups by {col} rest on part of the rows only.", "Fill the gaps in {col}, or leave out rows without a value."),
    "blank_strings": ("the text is empty or holds spaces alone", "{col} looks better filled than it is.", "Turn blanks in {col} into nulls and treat them as missing."),
    "whitespace": ("spaces stand before or after the value", "Joins and groups treat the padded value as another one.", "Strip {col}."),
    "duplicate_rows": ("all their values equal those of an earlier row", "Sums and counts take the same fact more than once.", "Keep the first row of each group."),
    "duplicate_ids": ("their id is also the id of another row", "A join on {col} multiplies rows.", "Keep one row for each {col}, or give the others ids of their own."),
    "invalid_email": ("the text has not the form of an e-mail address", "Mail to these rows cannot arrive.", "Correct {col} where the address is known, else set it to null."),
    "invalid_phone": ("the text has not the form of a phone number", "These rows cannot be called.", "Bring {col} into one form; set to null what is no number."),
    "invalid_url": ("the text has not the form of a web address", "Links from these rows lead nowhere.", "Correct the addresses in {col} or set them to null."),
    "invalid_date": ("the text is no date in any known form", "Rows without a date fall out of every series over time.", "Write {col} in one date form; set to null what is no date."),
    "negative_values": ("the number is below zero", "Sums over {col} come out too low.", "Find out whether {col} may be negative; else set such values to null."),
    "outliers": ("the number lies beyond one and a half quartile ranges", "Means of {col} follow a few rows, and charts flatten the rest.", "Check the extremes of {col}; clip those that are wrong."),
    "case_inconsistency": ("another spelling of the same word is more frequent", "One group of {col} appears as several.", "Use the most frequent spelling throughout {col}."),
    "mixed_types": ("the value is a number among texts, or a text among numbers", "{col} can neither be summed nor sorted.", "Keep the type that most values of {col} have."),
    "constant_column": ("no row differs", "{col} tells rows apart in no way.", "Leave {col} out, unless more values are expected."),
    "duplicate_columns": ("another column has the same values", "The same data is stored, and may be counted, twice.", "Leave out one of both."),
    "high_cardinality": ("nearly each row has a value of its own", "Groups by {col} have about one row each, and values may identify persons.", "Use {col} as a label, not for groups."),
    "low_cardinality": ("two values at most occur", "{col} is a flag rather than a measure.", "Treat {col} as a category."),
    "unicode_issues": ("the text holds control characters or replacement marks", "Such texts neither match nor print well.", "Load {col} again with the encoding of its source."),
    "datatype_mismatch": ("the values are numbers kept as text", "Sorting {col} puts 10 before 9.", "Cast {col} to a number."),
    "empty_dataset": ("the table has columns and no rows", "There is nothing to check.", "Load the data again."),
}
OTHER_EXPLANATION = ("a rule on this table flags them", "What the rule guards against may be the case here.", "Look through the rows in {col}.")


def flagged_rows(df: DataFrame, facts: Facts, rules: list[RowCheck], excluded: set) -> tuple[DataFrame, list[RowCheck]]:
    """df with what the masks of the checks read, and the checks that count."""
    flagged, doubles = flag_duplicates(df, facts)
    flagged, casings = flag_spellings(flagged, facts)
    checks = [x for x in (*row_checks(df, facts), *casings, *doubles, *rules) if (x.key, x.column) not in excluded]
    checks = known_values(facts, checks)
    bad = set(map(id, unsound(flagged, made_by_users(checks))))
    return flagged, [x for x in checks if id(x) not in bad]


def scored_rows(df: DataFrame, facts: Facts | None = None, rules: list[RowCheck] = (), excluded: set = frozenset()) -> tuple[DataFrame, list[RowCheck]]:
    """df with failed_checks, the keys of the checks that flag each row; and the checks. excluded: pairs (key, column).

    Users' checks that cannot take some value of the rows are left out; one scan of their masks tells.
    """
    facts = facts or gather_facts(df)
    flagged, checks = flagged_rows(df, facts, rules, excluded)
    marks = F.array(*[F.when(x.mask, F.lit(x.key)) for x in checks]) if checks else F.array().cast("array<string>")
    return flagged.select(*[F.col(f"`{c}`") for c in df.columns], F.array_distinct(F.array_compact(marks)).alias("failed_checks")), checks


def any_of(masks: list[Column]) -> Column:
    return reduce(or_, masks, F.lit(False))


def score(df: DataFrame, facts: Facts | None = None, rules: list[RowCheck] = (), excluded: set = frozenset()) -> DataFrame:
    """One row: overall and per dimension the share of rows that no check flags, dirty and clean rows, duplicates.

    A row is dirty once, however many checks flag it. Checks on whole columns flag no row. No rows: all scores 0. Users' checks that cannot
    take some value of the rows are left out; one scan of their masks tells.
    """
    facts = facts or gather_facts(df)
    flagged, checks = flagged_rows(df, facts, rules, excluded)
    # each mask is worked out once, in a projection of its own
    counted = [x.counted.alias("_extra") for x in checks if x.key == "duplicate_rows"]
    rows = flagged.select(F.lit(0).alias("_none"), *[x.mask.alias(f"_m{k}") for k, x in enumerate(checks)], *counted)
    dirty = any_of([F.col(f"_m{k}") for k in range(len(checks))])
    n = F.count(F.lit(1))
    share = lambda clean: F.coalesce(F.round(100 * clean / F.nullif(n, F.lit(0)), 1), F.lit(0.0))

    def clean_in(dimension: str):
        bad = any_of([F.col(f"_m{k}") for k, x in enumerate(checks) if x.dimension == dimension])
        return share(F.count_if(~bad)).alias(dimension)

    doubles = F.coalesce(F.round(F.sum("_extra")).cast("long"), F.lit(0)) if counted else F.lit(0)
    return rows.agg(
        share(F.count_if(~dirty)).alias("overall"), *[clean_in(d) for d in ALL_DIMENSIONS], n.alias("row_count"), F.count_if(dirty).alias("dirty_rows"),
        F.count_if(~dirty).alias("clean_rows"), doubles.cast("long").alias("duplicate_rows"),
    )


def with_issue_total(scores: DataFrame, findings: DataFrame) -> DataFrame:
    """Adds total_issues, the sum of all counts; findings on whole columns count too."""
    total = findings.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total_issues"))
    return scores.withColumn("_one", F.lit(1)).join(total.withColumn("_one", F.lit(1)), "_one").drop("_one")


def approval(scores: DataFrame) -> DataFrame:
    return scores.withColumn("approval_status", F.when(F.col("overall") >= APPROVED_FROM, "approved").otherwise("pending"))


def mark_excluded(findings: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Adds excluded: such findings stay listed, but don't count in the score and have no fix."""
    marks = exclusions.select("check_key", "column_name", F.lit(True).alias("_out")).distinct()
    same = findings["check_key"].eqNullSafe(marks["check_key"]) & findings["column_name"].eqNullSafe(marks["column_name"])
    joined = findings.join(marks, same, "left").select(findings["*"], F.coalesce("_out", F.lit(False)).alias("excluded"))
    return joined


def for_scoring(findings: DataFrame, exclusions: DataFrame) -> DataFrame:
    return mark_excluded(findings, exclusions).where("not excluded").drop("excluded")


def with_fix_flags(findings: DataFrame, total: int) -> DataFrame:
    """Adds fixable and suggest_drop (a column without any value)."""
    usable = ~F.col("excluded") if "excluded" in findings.columns else F.lit(True)
    return findings.withColumns({
        "fixable": F.col("check_key").isin(*FIXABLE) & usable,
        "suggest_drop": F.col("check_key").isin("missing_values", "blank_strings") & (F.col("count") >= total) & F.lit(total > 0),
    })


def explain(findings: DataFrame, total: int) -> DataFrame:
    """Adds title, why, business_impact and recommended_fix with the column, count and percentage of each finding."""
    spark = findings.sparkSession
    words = spark.createDataFrame([(k, *v) for k, v in EXPLANATIONS.items()], "check_key string, cause string, impact string, fix string")
    f = findings.join(F.broadcast(words), "check_key", "left")
    col, n = F.col("column_name"), F.col("count")
    fill = lambda c: F.replace(c, F.lit("{col}"), F.coalesce(col, F.lit("the table")))
    cause, impact, fix = (F.coalesce(c, F.lit(d)) for c, d in zip(("cause", "impact", "fix"), OTHER_EXPLANATION))
    empty = F.col("check_key").isin("missing_values", "blank_strings") & (n >= total) & F.lit(total > 0)
    twin = F.when(F.col("check_key") == "duplicate_columns", F.get("sample", 0))
    share = F.format_number(n / total * 100, 1) if total else F.lit("0.0")
    why = (
        F.when(empty, F.concat(col, F.lit(f": no value in any of {total} rows.")))
        .when(twin.isNotNull(), F.concat(col, F.lit(": the values are those of "), twin, F.lit(".")))
        .when(F.col("check_key").isin(*COLUMN_LEVEL), F.concat(col, F.lit(": "), cause, F.lit(".")))
        .otherwise(F.concat(F.coalesce(F.concat(col, F.lit(": ")), F.lit("")), n.cast("string"), F.lit(f" of {total} rows ("), share, F.lit(" %) are flagged: "), cause, F.lit(".")))
    )
    repair = F.when(empty, F.concat(F.lit("Drop "), col, F.lit("; there is nothing to fill it from."))).when(twin.isNotNull(), F.concat(F.lit("Drop "), col, F.lit(" or "), twin, F.lit("."))).otherwise(fill(fix))
    title = F.concat_ws(": ", F.initcap(F.replace("check_key", F.lit("_"), F.lit(" "))), col)
    added = {"title": title, "why": why, "business_impact": fill(impact), "recommended_fix": repair}
    return f.withColumns(added).select(*findings.columns, *added)


def severity_rank(c="severity"):
    return F.array_position(F.array(*map(F.lit, SEVERITY_ORDER)), F.col(c)) - 1


def by_severity(findings: DataFrame) -> DataFrame:
    return findings.orderBy(severity_rank(), F.desc("count"), "check_key", "column_name")


def latest_reports(reports: DataFrame) -> DataFrame:
    """reports (dataset_id, created_at, overall_score, ...): the latest of each dataset with the score before it."""
    w = Window.partitionBy("dataset_id").orderBy("created_at")
    seen = reports.withColumn("previous_score", F.lag("overall_score").over(w))
    last = F.row_number().over(Window.partitionBy("dataset_id").orderBy(F.desc("created_at")))
    return seen.withColumn("_n", last).where("_n = 1").drop("_n").withColumn("trend", F.round(F.col("overall_score") - F.col("previous_score"), 1))


def current_decisions(decisions: DataFrame) -> DataFrame:
    """decisions (dataset_id, decision, reviewer, note, decided_at): the latest of each dataset wins."""
    last = F.row_number().over(Window.partitionBy("dataset_id").orderBy(F.desc("decided_at")))
    return decisions.withColumn("_n", last).where("_n = 1").drop("_n")


