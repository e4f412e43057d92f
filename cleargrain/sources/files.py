"""Readers and writers: format dispatch, delimiter detection, null and type normalisation, names, exports."""

from __future__ import annotations

import csv
import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cleargrain.sources.rowid import ROW_ID

# Delimiters in order of preference, and texts that a table reader takes for missing.
DELIMITERS = (",", ";", "\t", "|", "~", ":", "^")
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)
#: A first line of so many characters is read by lines, whatever it holds.
LONG_LINE = 1_000_000
FORMATS = {"csv": "csv", "txt": "csv", "tsv": "csv", "json": "json", "parquet": "parquet", "pq": "parquet"}


def detect_delimiter(header: str) -> str:
    """The most frequent delimiter of a header line; ties go to the first of the list, none to a comma."""
    counts = [header.count(d) for d in DELIMITERS]
    return DELIMITERS[counts.index(max(counts))] if max(counts) else ","


def normalise_names(names: list[str]) -> list[str]:
    """Stripped names; empty ones become column, repeats get _1, _2 and so on."""
    out, seen = [], {}
    for name in names:
        base = str(name).strip() or "column"
        k = seen.get(base, 0)
        seen[base] = k + 1
        out.append(f"{base}_{k}" if k else base)
    return out


def normalise_nulls(df: DataFrame, tokens=NA_TOKENS) -> DataFrame:
    """Missing-value texts and NaN become null; texts of spaces stay."""

    def clean(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            c = F.when(~c.isin(list(tokens)), c)
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c)
        return c.alias(f.name)

    return df.select(*[clean(f) for f in df.schema.fields])


def infer_types(df: DataFrame) -> DataFrame:
    """Texts whose every value reads as a whole number, number or boolean become such; mixed ones stay text. One pass decides."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    whole, number, truth = r"^\s*[+-]?\d{1,18}\s*$", r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$", r"^(?i:true|false)$"
    tests = []
    for k, name in enumerate(texts):
        c = F.col(f"`{name}`")
        tests += [F.count(c).alias(f"n{k}"), *[F.count_if(c.rlike(p)).alias(f"{t}{k}") for t, p in (("i", whole), ("d", number), ("b", truth))]]
    seen = df.agg(*tests).first()
    out = {}
    for k, name in enumerate(texts):
        n = seen[f"n{k}"]
        kind = next((t for t, p in (("bigint", "i"), ("double", "d"), ("boolean", "b")) if n and seen[f"{p}{k}"] == n), None)
        if kind:
            out[name] = F.trim(F.col(f"`{name}`")).cast(kind)
    return df.withColumns(out) if out else df


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None, encoding: str = "UTF-8", multi_line: bool | None = None) -> DataFrame:
    """A header line, then records; the delimiter is found from the first line that isn't blank.

    multi_line: whether quoted values may hold line ends, which makes a file one task. If None, a scan looks for a line with an odd number of quotes.
    """
    text = spark.read.option("encoding", encoding).text(path)
    lines = text.where(F.trim("value") != "").limit(1).collect()
    if multi_line is None:
        multi_line = not text.where(F.length(F.translate("value", '"', "")) % 2 != F.length("value") % 2).isEmpty()
    header = lines[0][0] if lines else ""
    delimiter = delimiter or detect_delimiter(header)
    raw = spark.read.option("header", True).option("sep", delimiter).option("encoding", encoding).option("multiLine", multi_line).option("escape", '"').csv(path)
    names = next(csv.reader([header], delimiter=delimiter), [])
    names = names if len(names) == len(raw.columns) else raw.columns
    return infer_types(normalise_nulls(raw.toDF(*normalise_names(names))))


def flatten(df: DataFrame) -> DataFrame:
    """Structs become columns a.b, to any depth; arrays and maps become JSON text."""
    while any(isinstance(f.dataType, T.StructType) for f in df.schema.fields):
        out = []
        for f in df.schema.fields:
            if isinstance(f.dataType, T.StructType):
                out += [F.col(f"`{f.name}`.`{x.name}`").alias(f"{f.name}.{x.name}") for x in f.dataType.fields]
            else:
                out.append(F.col(f"`{f.name}`"))
        df = df.select(*out)
    return df.select(*[(F.to_json(F.col(f"`{f.name}`")) if isinstance(f.dataType, (T.ArrayType, T.MapType)) else F.col(f"`{f.name}`")).alias(f.name) for f in df.schema.fields])


def _is_whole(line: str) -> bool:
    """Whether a line is a JSON value by itself; one of LONG_LINE characters and more is taken for one."""
    try:
        return len(line) >= LONG_LINE or isinstance(json.loads(line), (dict, list))
    except ValueError:
        return False


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """One record a line, an array of records, one record, or an object with the records under "data"; nested records are flattened.

    Files whose first line is a whole value are read by lines, so they can be split; others as one value each.
    """
    first = spark.read.text(path).where(F.trim("value") != "").select(F.substring("value", 1, LONG_LINE).alias("value")).limit(1).collect()
    raw = spark.read.option("multiLine", not _is_whole(first[0][0] if first else "")).json(path)
    if raw.columns == ["data"] and isinstance(raw.schema["data"].dataType, T.ArrayType):
        raw = raw.select(F.explode("data").alias("r")).select("r.*")
    out = flatten(raw)
    return normalise_nulls(out.toDF(*normalise_names(out.columns)))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    return normalise_nulls(df.toDF(*normalise_names(df.columns)))


def read_dataset(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Read by format, or by the path's extension; an unknown one is an error."""
    kind = (fmt or path.rstrip("/").rpartition(".")[2]).lower().lstrip(".")
    if kind not in FORMATS:
        raise ValueError(f"unsupported format: {kind}")
    return {"csv": read_csv, "json": read_json, "parquet": read_parquet}[FORMATS[kind]](spark, path)


def require_rows(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise ValueError("the dataset has no rows")
    return df


def export_name(name: str, cleaned: bool = False) -> str:
    """A safe file name with .csv, marked if the data was cleaned."""
    return (re.sub(r"[^\w.-]+", "_", name).strip("_.") or "dataset") + ("_cleaned" if cleaned else "") + ".csv"


def export_csv(df: DataFrame, folder: str, name: str, cleaned: bool = False) -> str:
    path = f"{folder.rstrip('/')}/{export_name(name, cleaned)}"
    df.drop(ROW_ID).write.options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).mode("overwrite").csv(path)
    return path


def export_issues(findings: DataFrame, path: str, total: int = 0) -> None:
    """The issue report as CSV: check, column, severity, count, fix. total: the rows of the table, by which a column without any value is known."""
    from cleargrain.operators.score import explain

    explain(findings, total).select("check_key", "column_name", "severity", "count", "recommended_fix").write.option("header", True).mode("overwrite").csv(path)


def report_payload(**parts: DataFrame) -> DataFrame:
    """One row of JSON text with each part as an array of records. The parts are reports of bounded size."""
    out = None
    for name, df in parts.items():
        records = F.to_json(F.coalesce(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in df.columns])), F.array()))
        one = df.agg(records.alias("records")).select(F.concat(F.lit(f'"{name}":'), "records").alias("part"))
        out = one if out is None else out.unionByName(one)
    return out.agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list("part")), ","), F.lit("}")).alias("payload"))


def preview(df: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of rows in row order."""
    return df.orderBy(ROW_ID).offset(offset).limit(limit)


