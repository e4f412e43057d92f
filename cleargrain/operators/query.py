"""Guarded SQL over one table, ready-made queries, and facts and notes about their results."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cleargrain.functions import values as V
from cleargrain.operators.charts import AGGREGATIONS, aggregated, chosen_dates, usable
from cleargrain.operators.guard import UnsafeQueryError, check_tree
from cleargrain.operators.profile import ColumnProfile, data_columns, is_text, quoted, value_frequencies
from cleargrain.sources.versions import fine_shuffles

VIEW = "dataset"
MAX_ROWS = 1_000

# Words that a read-only query doesn't hold, and words of result names.
WRITE_WORDS = (
    "insert", "update", "delete", "drop", "create", "alter", "truncate", "replace", "merge", "copy", "attach", "detach", "install", "load", "pragma", "call",
    "export", "import", "grant", "revoke", "vacuum", "set", "refresh", "cache", "uncache",
)
ROW_NAMES = ("count", "count_star", "n", "rows", "row_count", "num_rows")
SYNONYMS = {"total": "sum", "mean": "avg"}
DIALECT = ((r"\bVARCHAR\b(?!\s*\()", "STRING"), (r"\bregexp_matches\s*\(", "regexp_like("), (r'"([^"]+)"', r"`\1`"))


def guard(sql: str) -> str:
    """The query in Spark's dialect, if it is one SELECT or WITH without writing words. A semicolon may end it."""
    sql = re.sub(r"\s*;\s*$", "", sql)
    bare = re.sub(r"'(?:[^']|'')*'", "''", sql)
    if not sql.strip():
        raise UnsafeQueryError("empty query")
    if ";" in bare:
        raise UnsafeQueryError("one statement only")
    if not re.match(r"\s*(select|with)\b", bare, re.I):
        raise UnsafeQueryError("only SELECT and WITH")
    named = re.sub(r'"[^"]*"|`[^`]*`', "x", bare)
    bad = re.search(rf"\b({'|'.join(WRITE_WORDS)})\b(?!\s*\()", named, re.I)
    if bad:
        raise UnsafeQueryError(f"{bad[1]} is not allowed")
    parts = re.split(r"('(?:[^']|'')*')", sql.strip())
    for k in range(0, len(parts), 2):
        for pattern, new in DIALECT:
            parts[k] = re.sub(pattern, new, parts[k], flags=re.I)
    return "".join(parts)


def run_sql(df: DataFrame, sql: str, limit: int = MAX_ROWS) -> DataFrame:
    """A guarded query over the view dataset, of limit rows at most. It reads that view and its own named queries, no file, table or other view."""
    query = guard(sql)
    check_tree(df.sparkSession, query, (VIEW,))
    df.createOrReplaceTempView(VIEW)
    return df.sparkSession.sql(query).limit(limit)


def query_frame(df: DataFrame, columns: list[ColumnProfile]) -> tuple[DataFrame, DataFrame]:
    """df with text date columns as timestamps, and a row per such column with the values that are no dates."""
    dates = [c.name for c in columns if c.semantic_type in ("date", "datetime") and is_text(df.schema[c.name].dataType)]
    out = df.withColumns({c: chosen_dates(df, c) for c in dates}) if dates else df
    lost = [F.struct(F.lit(c).alias("column_name"), F.count_if(quoted(c).isNotNull() & chosen_dates(df, c).isNull()).alias("unparsed")) for c in dates]
    if not lost:
        return out, df.sparkSession.createDataFrame([], "column_name string, unparsed long")
    return out, df.agg(F.array(*lost).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def same_text(column: str, value: str) -> Column:
    """Equality regardless of case and outer space."""
    return V.casefold(quoted(column)) == value.strip().lower()


def top_categories(df: DataFrame, category: str, measure: str, agg: str = "sum", n: int = 10) -> DataFrame:
    rows = df.select(quoted(category), usable(df, measure, agg).alias("_m"))
    return aggregated(rows, [category], agg, "_m", f"{agg}_{measure}").orderBy(F.desc(quoted(f"{agg}_{measure}")), quoted(category)).limit(min(n, 100))


def by_category(df: DataFrame, category: str, measure: str, agg: str = "sum") -> DataFrame:
    return top_categories(df, category, measure, agg, 25)


def frequency_table(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(quoted(column)).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), quoted(column)).limit(25)


def raw_trend(df: DataFrame, time: str, measure: str) -> DataFrame:
    return df.groupBy(quoted(time)).agg(F.sum(usable(df, measure, "sum")).alias(f"sum_{measure}")).orderBy(quoted(time)).limit(500)


def pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(V.to_number(quoted(a)).alias(a), V.to_number(quoted(b)).alias(b)).where(quoted(a).isNotNull() & quoted(b).isNotNull()).limit(200)


def measure_summary(df: DataFrame, measure: str) -> DataFrame:
    x = V.to_number(quoted(measure))
    return df.agg(F.min(x).alias(f"min_{measure}"), F.max(x).alias(f"max_{measure}"), F.avg(x).alias(f"avg_{measure}"))


def filtered(df: DataFrame, mask: Column, agg: str | None = None, measure: str | None = None) -> DataFrame:
    """Rows under a mask: an aggregate, their count, or the first 50."""
    rows = df.where(mask)
    if agg == "count":
        return rows.agg(F.count(F.lit(1)).alias("count"))
    if agg:
        return aggregated(rows.select(usable(df, measure, agg).alias("_m")), [], agg, "_m", f"{agg}_{measure}")
    return rows.limit(50)


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def find_value(df: DataFrame, columns: list[ColumnProfile], question: str, max_distinct: int = 60) -> DataFrame:
    """column_name, value: which text column with few values holds one that the question names; the longest wins, a plural s may follow."""
    names = [c.name for c in columns if is_text(df.schema[c.name].dataType) and 0 < c.distinct_count <= max_distinct]
    asked = F.lit(f" {re.sub(r'[^\w]+', ' ', question.lower()).strip()} ")
    word = F.concat(F.lit(" "), F.trim(F.regexp_replace(V.casefold("value"), r"[^\w]+", " ")))
    hit = (F.length(word) > 2) & (asked.contains(F.concat(word, F.lit(" "))) | asked.contains(F.concat(word, F.lit("s "))))
    return value_frequencies(df, names).where(hit).orderBy(F.desc(F.length("value")), "column_name", "value").limit(1).select("column_name", "value")


def spelling_variants(df: DataFrame, column: str, value: str) -> DataFrame:
    """variant, n: other values that the value begins, or that begin with it."""
    low = value.strip().lower()
    v = F.col("variant")
    kin = (v != low) & (v != "") & (v.startswith(low) | F.lit(low).startswith(v))
    return value_frequencies(df, [column]).groupBy(V.casefold("value").alias("variant")).agg(F.sum("n").alias("n")).where(kin).orderBy("variant")


def result_facts(result: DataFrame) -> DataFrame:
    """rank, label, value, share (of the sum), total, rows: the first three and the last of a result of two columns.

    A result with repeated labels, fewer than two numbers, or other than two columns has no ranks: no rows.
    """
    if len(result.columns) != 2:
        return result.sparkSession.createDataFrame([], "rank int, label string, value double, share double, total double, rows long")
    label, value = result.columns
    r = result.select(quoted(label).cast("string").alias("label"), V.to_number(quoted(value)).alias("value")).where("value is not null")
    one = Window.partitionBy()  # results have MAX_ROWS rows at most
    ranked = r.limit(MAX_ROWS).withColumns({
        "rank": F.row_number().over(one.orderBy(F.desc("value"), "label")), "total": F.sum("value").over(one), "rows": F.count("*").over(one),
        "labels": F.size(F.collect_set(F.coalesce("label", F.lit("None"))).over(one)),
    })
    share = F.when(F.col("total") != 0, F.col("value") / F.col("total") * 100).otherwise(0.0)
    kept = ranked.where("rows >= 2 and labels = rows and (rank <= 3 or rank = rows)")
    return kept.select("rank", "label", "value", share.alias("share"), "total", "rows").orderBy("rank")


def truncation_note(result: DataFrame, cap: int = MAX_ROWS) -> str | None:
    """What a reader of a result should know of its length, read off its plan: the row cap, or a limit over rows in no order, cut it."""
    plan = result._jdf.queryExecution().optimizedPlan()
    limits, ordered = [], False
    while plan is not None:  # down from the top as long as no two inputs meet
        kind = plan.getClass().getSimpleName()
        ordered = ordered or kind == "Sort"
        limits += [int(plan.limitExpr().toString())] if kind == "GlobalLimit" else []
        plan = plan.children().apply(0) if plan.children().size() == 1 else None
    if not limits:
        return None
    shown = result.count()
    if shown >= cap:
        return f"The table stops at {cap:,} rows; sums over it leave the others out."
    if shown == min(limits) and not ordered:
        return f"LIMIT {min(limits)} cut the list without an order; count the rows for a total."
    return None


def _bands(value: Column, places: Column) -> Column:
    """Structs (place, band): the value rounded to each number of decimals; those that are out of a long's range have none."""
    # half a unit of the place, with room for binary fractions
    scaled = lambda p: value * F.pow(F.lit(10.0), p) + 0.5 + 1e-9
    found = F.transform(places, lambda p: F.struct(p.cast("int").alias("place"), F.when(F.abs(scaled(p)) < 9e18, F.floor(scaled(p))).alias("band")))
    return F.filter(found, lambda b: b.band.isNotNull())


def ungrounded(answers: DataFrame, facts: DataFrame, key: str = "id", table: DataFrame | None = None) -> DataFrame:
    """key, value: numbers stated in answers (key, text) that no fact grounds.

    A fact grounds a number that is its rounding to the decimals shown, or one more or less; a fact of 0 only 0. Facts with the column key
    hold for the answer of that key, facts (value) without it for all answers, as do the numbers of rows and columns of table. Both sides
    are cut into bands, one for each number of decimals that matters, and meet where a band is equal: an equi-join, whatever the number of facts.
    """
    fine_shuffles(answers.sparkSession)
    id_, keyed = quoted(key), key in facts.columns
    stated = answers.select(id_.alias("_id"), F.posexplode(V.stated_numbers("text")).alias("_at", "_x")).select("_id", "_at", F.col("_x.value").alias("value"), F.col("_x.decimals").alias("decimals"))
    stated = stated.where("value is not null")
    zero = F.array(F.struct(F.lit(-1).alias("place"), F.lit(0).cast("long").alias("band")))
    own = _bands(F.col("value"), F.array_distinct(F.array(F.greatest(F.col("decimals") - 1, F.lit(0)), F.col("decimals"), F.col("decimals") + 1)))
    asked = stated.withColumn("b", F.explode(F.when(F.abs("value") < 1e-6, F.concat(own, zero)).otherwise(own))).select("_id", "_at", "b.place", "b.band")
    most = stated.agg(F.max("decimals")).first()[0] or 0
    truth = F.col("value").cast("double")
    every = F.when(F.abs(truth) < 1e-9, zero).otherwise(_bands(truth, F.sequence(F.lit(0), F.lit(most + 1))))
    bands = lambda rows, *ids: rows.select(*ids, F.explode(every).alias("b")).select(*[F.col(c) for c in ("_id",) if ids], "b.place", "b.band").distinct()
    shared = None if keyed else facts.select("value")
    if table is not None:
        sizes = table.agg(F.count(F.lit(1)).cast("double").alias("rows")).select(F.explode(F.array("rows", F.lit(float(len(data_columns(table)))))).alias("value"))
        shared = sizes if shared is None else shared.unionByName(sizes)
    grounded = []
    if keyed:
        grounded.append(asked.join(bands(facts.select(id_.alias("_id"), "value"), "_id"), ["_id", "place", "band"], "left_semi").select("_id", "_at"))
    if shared is not None:
        grounded.append(asked.join(bands(shared), ["place", "band"], "left_semi").select("_id", "_at"))
    found = reduce(DataFrame.unionByName, grounded).distinct()
    return stated.join(found, ["_id", "_at"], "left_anti").select(F.col("_id").alias(key), "value")


def result_chart(result: DataFrame, forced: str | None = None) -> tuple[DataFrame, str] | None:
    """The data and type of a chart of a two-column result: 12 bars (a pie up to 6), or up to 300 points."""
    if len(result.columns) != 2:
        return None
    a, b = result.columns
    numeric = {c: isinstance(result.schema[c].dataType, T.NumericType) for c in (a, b)}
    if forced == "scatter" and all(numeric.values()):
        points = result.select(quoted(a).cast("double").alias("x"), quoted(b).cast("double").alias("y")).where("x is not null and y is not null")
        return points.limit(300), "scatter"
    if not any(numeric.values()):
        return None
    cat, measure = (b, a) if numeric[a] and not numeric[b] else (a, b)
    data = result.select(quoted(cat).cast("string").alias("name"), quoted(measure).cast("double").alias("value")).where("value is not null").limit(12)
    return data, forced if forced in ("bar", "pie", "line") else "pie" if data.count() <= 6 else "bar"


def rule(df: DataFrame, column: str, op: str, value: str | float | None = None) -> Column:
    """A rule from its parts; comparisons with numbers read the column leniently."""
    c = quoted(column)
    if op in ("is null", "is not null"):
        return c.isNull() if op == "is null" else c.isNotNull()
    compare = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}[op]
    try:
        return F.coalesce(compare(V.to_number(c), F.lit(float(value))), F.lit(False))
    except (TypeError, ValueError):
        return F.coalesce(compare(V.casefold(c.cast("string")), F.lit(str(value).strip().lower())), F.lit(False))


#: A condition's tokens: quoted texts, quoted names, comparisons, numbers, anything else.
CONDITION_TOKENS = re.compile(r"""(?P<text>'(?:[^']|'')*')|(?P<name>"[^"]+"|`[^`]+`)|(?P<compare>[<>!]=|<>|[<>=])|(?P<number>(?<![\w.])-?\d+(?:\.\d+)?(?![\w.]))|(?P<space>\s+)|(?P<other>\w+|.)""", re.S)


def heal_condition(condition: str) -> str:
    """The condition with a lenient cast around every quoted column that is compared with a number, on either side; texts stay as they are."""
    tokens = [(m.lastgroup, m[0]) for m in CONDITION_TOKENS.finditer(condition)]
    solid = [i for i, (kind, _) in enumerate(tokens) if kind != "space"]
    words = [word for _, word in tokens]
    for left, middle, right in zip(solid, solid[1:], solid[2:]):
        kinds = tuple(tokens[i][0] for i in (left, middle, right))
        if kinds in (("name", "compare", "number"), ("number", "compare", "name")):
            at = left if kinds[0] == "name" else right
            words[at] = f"try_cast(`{words[at][1:-1]}` AS DOUBLE)"
    return "".join(words)


def sentence(result: DataFrame) -> DataFrame:
    """answer: single values read out; of two-column groups the highest and lowest (ties: the least name); else the number of rows."""
    rows = F.count(F.lit(1))
    number = lambda c: F.when(c == F.floor(c), F.format_number(c, 0)).otherwise(F.format_number(c, 2))
    if len(result.columns) == 2 and isinstance(result.schema[result.columns[1]].dataType, T.NumericType):
        label, value = result.columns
        name, x = quoted(label).cast("string"), quoted(value).cast("double")
        most, least = (F.min(F.when(x.isNotNull(), F.struct(v.alias("x"), name.alias("name"))))["name"] for v in (-x, x))
        groups = F.format_string("%s over %d groups: most in %s (%s), least in %s (%s).", F.lit(value), rows, most, number(F.max(x)), least, number(F.min(x)))
        plain = F.format_string("Rows: %d.", rows)
        return result.agg(F.when((rows >= 2) & (F.count_distinct(F.coalesce(name, F.lit("None"))) == rows), groups).otherwise(plain).alias("answer"))
    parts = []
    for c in result.columns:
        v = F.first(quoted(c))
        text = number(F.first(quoted(c).cast("double"))) if isinstance(result.schema[c].dataType, T.NumericType) else v.cast("string")
        parts.append(F.concat(F.lit(f"{axis_label(c)}: "), F.coalesce(text, F.lit("no value"))))
    said = F.concat(F.concat_ws("; ", *parts), F.lit("."))
    return result.agg(F.when(rows == 1, said).otherwise(F.format_string("Rows: %d.", rows)).alias("answer"))


def axis_label(name: str) -> str:
    """A result column in words: the aggregation's word (Total, Average, Number of values) and the column; row counts in full."""
    words = name.replace("(*)", "").replace("(", "_").replace(")", "").replace("_", " ").split()
    if "_".join(words).lower() in ROW_NAMES:
        return "Number of rows"
    spec = AGGREGATIONS.get(SYNONYMS.get(words[0].lower(), words[0].lower())) if len(words) > 1 else None
    return spec.word.format(m=" ".join(words[1:])) if spec else " ".join(words)
