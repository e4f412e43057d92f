"""Cell edits by row number, and row filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cleargrain.functions import values as V
from cleargrain.operators.profile import data_columns, is_numeric, quoted
from cleargrain.sources.rowid import ROW_ID

EDITS = "edit_no long, row_index long, column_name string, value string"
#: A change log: old values as they were, whatever their type, and the type of their column.
LOG = "row_index long, column_name string, old_value string, new_value string, old variant, old_type string"
MAX_EDITS = 100


def coerced(value: Column, kind: T.DataType) -> Column:
    """An edit's text as a value of the column's type; blank text clears. Null also stands for a text that doesn't fit."""
    text = F.when(V.is_blank(value), None).otherwise(value)
    if isinstance(kind, T.BooleanType):
        return F.lower(V.strip(text)).isin("true", "1", "yes", "y") & text.isNotNull()
    if is_numeric(kind):
        return V.to_number(V.strip(text))
    if isinstance(kind, (T.TimestampType, T.DateType)):
        return V.strip(text).try_cast(kind)
    return text


def rejected_edits(df: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits that name no column or row of df, or whose text is no value of the column's type, with the reason."""
    kinds = {f.name: f.dataType for f in data_columns(df)}
    rows = df.agg(F.max(ROW_ID)).first()[0]
    numeric = [n for n, k in kinds.items() if is_numeric(k)]
    bad_number = F.col("column_name").isin(numeric) & ~V.is_blank("value") & F.col("value").isNotNull() & V.to_number(V.strip("value")).isNull()
    reason = (
        F.when(~F.col("column_name").isin(list(kinds)), "unknown column")
        .when((F.col("row_index") < 0) | (F.col("row_index") > F.lit(-1 if rows is None else rows)), "row out of range")
        .when(bad_number, "not a number")
    )
    return edits.withColumn("reason", reason).where("reason is not null")


def last_edits(edits: DataFrame) -> DataFrame:
    """One edit per cell: the last one wins."""
    w = Window.partitionBy("row_index", "column_name").orderBy(F.desc("edit_no"))
    return edits.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def apply_edits(df: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edited table, and the log (LOG: old_value and new_value to be read, old to be put back). A batch has 100 edits at most.

    Whole-number columns become doubles when an edit clears a cell or puts a fraction there.
    """
    if edits.limit(MAX_EDITS + 1).count() > MAX_EDITS:
        raise ValueError(f"more than {MAX_EDITS} edits")
    bad = rejected_edits(df, edits).collect()
    if bad:
        raise ValueError("; ".join(f"{r['column_name']}[{r['row_index']}]: {r['reason']}" for r in bad))
    last = last_edits(edits)
    touched = [r[0] for r in last.select("column_name").distinct().collect()]
    if not touched:
        return df, df.sparkSession.createDataFrame([], LOG)
    cells = last.groupBy("row_index").pivot("column_name", touched).agg(F.first(F.struct("value")))
    cells = cells.select(F.col("row_index").alias(ROW_ID), *[quoted(c).alias(f"_e{k}") for k, c in enumerate(touched)])
    joined = df.join(F.broadcast(cells), ROW_ID, "left")  # MAX_EDITS rows at most
    wide = joined.agg(*[F.count_if(F.col(f"_e{k}").isNotNull() & (V.to_number(F.col(f"_e{k}.value")).isNull() | (V.to_number(F.col(f"_e{k}.value")) % 1 != 0))).alias(f"w{k}") for k in range(len(touched))]).first()
    out = {}
    for k, c in enumerate(touched):
        kind = df.schema[c].dataType
        new = coerced(F.col(f"_e{k}.value"), kind)
        old = quoted(c)
        if isinstance(kind, T.IntegralType):
            new, old = (new, old.cast("double")) if wide[k] else (new.cast(kind), old)
        out[c] = F.when(F.col(f"_e{k}").isNotNull(), new).otherwise(old)
    edited = joined.select(*[(out[c].alias(c) if c in out else quoted(c)) for c in df.columns])

    def entry(k: int, c: str) -> Column:
        kind = df.schema[c].dataType.simpleString()
        old = (quoted(c).cast("string").alias("old_value"), F.col(f"_e{k}.value").alias("new_value"), quoted(c).cast("variant").alias("old"), F.lit(kind).alias("old_type"))
        return F.when(F.col(f"_e{k}").isNotNull(), F.struct(F.lit(c).alias("column_name"), *old))

    pairs = [entry(k, c) for k, c in enumerate(touched)]
    log = joined.select(F.col(ROW_ID).alias("row_index"), F.explode(F.array_compact(F.array(*pairs))).alias("x")).select("row_index", "x.*")
    return edited, log


def undo_edits(df: DataFrame, log: DataFrame, rows_then: int) -> DataFrame:
    """Old values back as they were, blanks and nulls too, and columns that an edit widened in their old type; refused if rows were added or removed since.

    A column stays wide where a later edit left a fraction in it. A log has MAX_EDITS entries at most; columns that df lacks are passed over.
    """
    if df.count() != rows_then:
        raise ValueError("the number of rows has changed since the edit")
    kinds = {c: kind for c, kind in log.select("column_name", "old_type").distinct().limit(MAX_EDITS).collect() if c in df.columns}
    if not kinds:
        return df
    cells = log.groupBy(F.col("row_index").alias(ROW_ID)).agg(*[F.max(F.when(F.col("column_name") == c, F.struct(F.lit(1), F.col("old").cast(kind).alias("old")))).alias(f"_u{k}") for k, (c, kind) in enumerate(kinds.items())])
    joined = df.join(F.broadcast(cells), ROW_ID, "left")  # MAX_EDITS rows at most
    back = {c: F.when(F.col(f"_u{k}").isNotNull(), F.col(f"_u{k}.old").cast(df.schema[c].dataType)).otherwise(quoted(c)) for k, c in enumerate(kinds)}
    wider = [c for c, kind in kinds.items() if df.schema[c].dataType.simpleString() == "double" and kind in ("tinyint", "smallint", "int", "bigint")]
    if wider:
        fractions = joined.agg(*[F.count_if(back[c] % 1 != 0) for c in wider]).first()
        back |= {c: back[c].cast(kinds[c]) for c, n in zip(wider, fractions) if not n}
    return joined.select(*[(back[c].alias(c) if c in back else quoted(c)) for c in df.columns])


def edit_history(log: DataFrame, limit: int = 20) -> DataFrame:
    """The latest entries of a log with edited_at; of one time those of higher rows first."""
    return log.orderBy(F.desc("edited_at"), F.desc("row_index")).limit(limit)


def row_filter(df: DataFrame, column: str, op: str, value: str | None = None) -> Column | None:
    """The predicate of a row filter, or None if the column or operator is unknown (all rows pass).

    eq and neq compare trimmed text regardless of case, neq with nulls; contains takes the text literally; gt, gte, lt, lte
    compare numbers if the value is one, else dates; empty and not_empty look for nulls and blanks.
    """
    if column not in [f.name for f in data_columns(df)]:
        return None
    c = quoted(column)
    text = c.cast("string")
    blank = c.isNull() | V.is_blank(text)
    if op == "empty":
        return blank
    if op == "not_empty":
        return ~blank
    if value is None:
        return None
    if op == "contains":
        return F.coalesce(F.lower(text).contains(value.lower()), F.lit(False))
    if op in ("eq", "neq"):
        same = F.coalesce(V.casefold(text).eqNullSafe(V.casefold(F.lit(value))), F.lit(False))
        return same if op == "eq" else ~same
    compare = {"gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b}.get(op)
    if compare is None:
        return None
    try:
        target = float(value)
        left = V.to_number(c)
        return F.coalesce(compare(left, F.lit(target)), F.lit(False))
    except ValueError:
        when = V.date_reading(F.lit(value), day_first=False)
        left = c if isinstance(df.schema[column].dataType, (T.TimestampType, T.DateType)) else V.date_reading(text, day_first=False)
        return F.coalesce(compare(left.cast("timestamp"), when), F.lit(False))


def query_rows(df: DataFrame, column: str | None = None, op: str | None = None, value: str | None = None, limit: int = 50, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """A page of the filtered rows with their numbers, and (matched, total) in one row."""
    mask = row_filter(df, column, op, value) if column and op else None
    mask = F.lit(True) if mask is None else mask
    page = df.where(mask).orderBy(ROW_ID).offset(offset).limit(limit)
    return page, df.agg(F.count_if(mask).alias("matched"), F.count(F.lit(1)).alias("total"))
