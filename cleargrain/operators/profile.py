"""Column profiles: one wide aggregate, one table of value frequencies, and rules over both."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from functools import reduce
from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cleargrain.functions import values as V
from cleargrain.sources.rowid import ROW_ID
from cleargrain.sources.versions import settled

# Parts of column names, in order, and the meaning that they suggest.
NAME_HINTS = (
    ("email", "email"), ("e-mail", "email"), ("phone", "phone"), ("mobile", "phone"), ("contact", "phone"), ("zip", "zip"), ("postal", "zip"),
    ("url", "url"), ("website", "url"), ("link", "url"), ("lat", "latitude"), ("latitude", "latitude"), ("lon", "longitude"), ("lng", "longitude"),
    ("longitude", "longitude"), ("price", "currency"), ("amount", "currency"), ("salary", "currency"), ("revenue", "currency"), ("cost", "currency"),
    ("id", "id"), ("date", "date"), ("created", "datetime"),
)
NUMERIC_HINTS = ("currency", "latitude", "longitude", "zip", "id")
PATTERN_SHARE = 0.7
SAMPLES = 5
PATTERNS = tuple(V.TRIMMED_TESTS.items())
#: What a profile tells of each value of a text, besides the patterns.
MARKS = ("num", "blank", "spaced", "corrupted")


@dataclass
class ColumnProfile:
    name: str
    ordinal: int
    physical_type: str
    semantic_type: str
    null_count: int
    null_pct: float
    distinct_count: int
    cardinality_ratio: float
    min_val: str | None = None
    max_val: str | None = None
    mean_val: float | None = None
    std_val: float | None = None
    sample_values: list = field(default_factory=list)
    rows: int = 0
    number_share: float = 0.0
    #: Of a text: the rows whose value matches each pattern and bears each mark.
    matches: dict[str, int] = field(default_factory=dict)

    @property
    def filled(self) -> int:
        return self.rows - self.null_count


SCHEMA = (
    "name string, ordinal int, physical_type string, semantic_type string, null_count long, null_pct double, distinct_count long, "
    "cardinality_ratio double, min_val string, max_val string, mean_val double, std_val double, sample_values array<string>"
)


def data_columns(df: DataFrame) -> list[T.StructField]:
    return [f for f in df.schema.fields if f.name != ROW_ID]


def quoted(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def row_key(names: list[str]) -> Column:
    """Two 64-bit hashes of a row's values. A null counts at its own place: the hash passes nulls over, so their marks go in too."""
    parts = [x for n in names for x in (quoted(n).isNull(), quoted(n))]
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(1), *parts).alias("b"))


def is_text(kind: T.DataType) -> bool:
    return isinstance(kind, T.StringType)


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def _counted_as(kind: T.DataType) -> str:
    """The type under which values of a column are counted: whole numbers as long, other atomic ones as they are, the rest as text."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        return "bigint"
    plain = is_numeric(kind) or isinstance(kind, (T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType))
    return kind.simpleString() if plain else "string"


def counts_exactly(kind: T.DataType) -> bool:
    """Whether value_frequencies() tells values of a type apart as they compare: not texts of another collation, nor what it turns into text."""
    return kind == T.StringType() or _counted_as(kind) != "string"


def value_frequencies(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column_name, value (text), n: how often each non-null value of each column occurs.

    Columns of one type are expanded and counted together, as values of that type; only distinct ones are written as text. Each type reads its
    own columns alone. Both zeros of floating-point numbers count as one value.
    """
    names = columns if columns is not None else [f.name for f in data_columns(df)]
    if not names:
        return df.sparkSession.createDataFrame([], "column_name string, value string, n long")
    by_type: dict[str, list[str]] = {}
    for name in names:
        by_type.setdefault(_counted_as(df.schema[name].dataType), []).append(name)
    parts = []
    for kind, own in by_type.items():
        long = df.select(*[quoted(c).cast(kind).alias(c) for c in own]).unpivot([], [quoted(c) for c in own], "column_name", "value")
        counted = long.where("value is not null").groupBy("column_name", "value").agg(F.count("*").alias("n"))
        parts.append(counted.select("column_name", F.col("value").cast("string").alias("value"), "n"))
    return reduce(DataFrame.unionByName, parts)


def distinct_sketches(df: DataFrame, by: list[str] | None = None, lg_k: int = 12) -> DataFrame:
    """by, name, sketch: a HyperLogLog sketch (of 2^lg_k registers) of the non-null values of each column, in one scan without a shuffle of values.

    Sketches are binary, may be stored beside a version or a day of data and are merged by merged_sketches(). A column without values has a sketch of none.
    """
    own = [f.name for f in data_columns(df) if f.name not in (by or [])]
    seen = df.groupBy(*map(quoted, by or [])).agg(*[F.hll_sketch_agg(F.when(quoted(c).isNotNull(), F.xxhash64(quoted(c))), F.lit(lg_k)).alias(c) for c in own])
    return seen.unpivot([quoted(c) for c in by or []], [quoted(c) for c in own], "name", "sketch")


def merged_sketches(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, name, sketch, approx_distinct: sketches of parts of a table merged into those of the whole, and their estimates (within some 3 % at 2^12 registers)."""
    whole = sketches.groupBy(*(by or []), "name").agg(F.hll_union_agg("sketch").alias("sketch"))
    return whole.withColumn("approx_distinct", F.hll_sketch_estimate("sketch"))


def exact_quantiles(frequencies: DataFrame, shares: list[float]) -> dict[str, list[float]]:
    """Exact quantiles, with linear interpolation, of the numbers among the values of each column.

    Distinct values are dealt to tasks by ranges; prefix sums of the ranges' counts tell where each rank lies, so no task holds a column.
    """
    n_ranges = int(frequencies.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbers = frequencies.select("column_name", V.to_number("value").alias("x"), "n").where("x is not null")
    ranged = settled(numbers.repartitionByRange(n_ranges, "column_name", "x").withColumn("part", F.spark_partition_id()))
    parts = ranged.groupBy("column_name", "part").agg(F.sum("n").alias("m"))  # n_ranges rows a column at most
    before = Window.partitionBy("column_name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("column_name", "part", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("start"), F.sum("m").over(Window.partitionBy("column_name")).alias("total"))
    inside = Window.partitionBy("column_name", "part").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    ends = ranged.join(starts, ["column_name", "part"]).withColumn("end", F.col("start") + F.sum("n").over(inside))
    place = lambda share: F.lit(share) * (F.col("total") - 1)
    ranks = F.array(*[r(place(s)).cast("long") for s in shares for r in (F.floor, F.ceil)])
    held = F.filter(ranks, lambda r: (r < F.col("end")) & (r >= F.col("end") - F.col("n")))
    found: dict[str, dict[int, float]] = {}
    totals: dict[str, int] = {}
    for name, x, total, own in ends.select("column_name", "x", "total", held.alias("r")).where(F.size("r") > 0).collect():  # two rows a share and column at most
        totals[name] = total
        found.setdefault(name, {}).update(dict.fromkeys(own, x))
    out = {}
    for name, by_rank in found.items():
        places = [s * (totals[name] - 1) for s in shares]
        out[name] = [by_rank[floor(p)] + (p - floor(p)) * (by_rank[ceil(p)] - by_rank[floor(p)]) for p in places]
    return out


def first_values(df: DataFrame, k: int = SAMPLES) -> DataFrame:
    """column_name, sample_values: the first k non-null values by row number."""
    pairs = [F.struct(F.lit(f.name).alias("column_name"), quoted(f.name).cast("string").alias("value")) for f in data_columns(df)]
    rows = df.select(ROW_ID, F.explode(F.array(*pairs)).alias("p")).select(ROW_ID, "p.*").where("value is not null")
    place = F.row_number().over(Window.partitionBy("column_name").orderBy(ROW_ID))
    top = rows.withColumn("place", place).where(F.col("place") <= k)
    listed = F.array_sort(F.collect_list(F.struct("place", "value")))
    return top.groupBy("column_name").agg(F.transform(listed, lambda x: x["value"]).alias("sample_values"))


def leading_values(df: DataFrame, k: int = SAMPLES, head: int = 1_000) -> dict[str, list[str]]:
    """As first_values(): from the first rows and, for columns with fewer than k values there, from all."""
    fields = [f.name for f in data_columns(df)]
    top = df.orderBy(ROW_ID).limit(head).select(*[quoted(c).cast("string") for c in fields]).collect()
    out = {c: [v for r in top if (v := r[i]) is not None][:k] for i, c in enumerate(fields)}
    short = [c for c in fields if len(out[c]) < k] if len(top) == head else []
    if short:
        out |= {r[0]: r[1] for r in first_values(df.select(ROW_ID, *map(quoted, short)), k).collect()}
    return out


def frequency_facts(frequencies: DataFrame, texts: list[str]) -> dict[str, dict]:
    """The number of distinct values of each column that has any and, for texts, the rows that are filled, that match each pattern and that bear each mark,
    and the least and greatest value; a distinct value is trimmed and tested once."""
    own = F.col("column_name").isin(texts)
    counts = frequencies.where(~own).groupBy("column_name").agg(F.count("*").alias("distinct"))
    if texts:
        rows = frequencies.where(own).select("column_name", "value", "n", V.has_outer_space("value").alias("spaced"))
        rows = rows.withColumn("s", V.strip("value", "spaced"))
        tests = {"num": V.is_number("value"), "blank": F.col("s") == "", "spaced": F.col("spaced"), "corrupted": V.is_corrupted("value")}
        tests |= {p: test(F.col("s")) for p, test in PATTERNS}
        rows = rows.select("column_name", "value", "n", *[test.alias(p) for p, test in tests.items()])
        matched = [F.sum(F.when(F.col(p), F.col("n")).otherwise(0)).alias(p) for p in tests]
        ends = [F.sum("n").alias("filled"), F.min("value").alias("lo"), F.max("value").alias("hi")]
        counts = rows.groupBy("column_name").agg(F.count("*").alias("distinct"), *ends, *matched).unionByName(counts, allowMissingColumns=True)
    return {r["column_name"]: r.asDict() for r in counts.collect()}  # a row per column


def name_hint(name: str, allowed=None) -> str | None:
    low = name.lower()
    return next((kind for part, kind in NAME_HINTS if part in low and (allowed is None or kind in allowed)), None)


def semantic_type(name: str, kind: T.DataType, filled: int, distinct: int, shares: dict[str, float]) -> str:
    """The meaning of a column: by type, by the first pattern with 70 % of the values, by few distinct values, by name."""
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if is_numeric(kind):
        whole = isinstance(kind, T.IntegralType)
        return name_hint(name, NUMERIC_HINTS) or ("integer" if whole else "numeric")
    if filled:
        found = next((p for p, _ in PATTERNS if shares.get(p, 0) >= PATTERN_SHARE), None)
        if found:
            return found
        if distinct / filled < 0.5 and distinct <= 50:
            return "categorical"
    return name_hint(name) or "text"


def profile_columns(df: DataFrame, samples: bool = True, first_rows: int | None = None, frequencies: DataFrame | None = None) -> list[ColumnProfile]:
    """A profile per column. Patterns are tested on all rows, or on the first_rows first values by row number.

    frequencies: value_frequencies(df), if they are there already.
    """
    fields = data_columns(df)
    aggs = [F.count(F.lit(1)).alias("rows")]
    by_value = {f.name for f in fields if f.dataType == T.StringType()}  # the order of other texts may be another one than that of their values
    for k, f in enumerate(fields):
        if f.name in by_value:
            continue
        c = quoted(f.name)
        aggs += [F.count(c).alias(f"n{k}"), F.min(c).cast("string").alias(f"lo{k}"), F.max(c).cast("string").alias(f"hi{k}")]
        if is_numeric(f.dataType):
            aggs += [F.avg(c).cast("double").alias(f"mean{k}"), F.stddev_samp(c).cast("double").alias(f"std{k}")]
    seen = df.agg(*aggs).first()
    own = frequencies if frequencies is not None else value_frequencies(df)  # read once
    known = frequency_facts(own, [f.name for f in fields if is_text(f.dataType)])
    firsts = leading_values(df) if samples and ROW_ID in df.columns else {}
    head = _first_shares(df, fields, first_rows) if first_rows and ROW_ID in df.columns else {}
    rows, out = seen["rows"], []
    for k, f in enumerate(fields):
        mine = known.get(f.name, {})
        filled, lo, hi = (mine.get("filled", 0), mine.get("lo"), mine.get("hi")) if f.name in by_value else (seen[f"n{k}"], seen[f"lo{k}"], seen[f"hi{k}"])
        d = mine.get("distinct", 0)
        text = is_text(f.dataType)
        share = lambda p: known[f.name][p] / filled if filled and f.name in known else 0.0  # noqa: B023, E731
        shares = head.get(f.name) or ({p: share(p) for p, _ in PATTERNS} if text else {})
        numeric = is_numeric(f.dataType)
        out.append(
            ColumnProfile(
                f.name, k, f.dataType.simpleString(), semantic_type(f.name, f.dataType, filled, d, shares),
                rows - filled, round((rows - filled) / rows * 100, 2) if rows else 0.0, d, round(d / rows, 4) if rows else 0.0,
                lo, hi, seen[f"mean{k}"] if numeric else None,
                (seen[f"std{k}"] or 0.0) if numeric and filled else None, firsts.get(f.name, []), rows, share("num") if text else 0.0,
                {p: mine.get(p, 0) for p in (*MARKS, *(p for p, _ in PATTERNS))} if text else {},
            )
        )
    return out


def _first_shares(df: DataFrame, fields, n: int) -> dict[str, dict[str, float]]:
    """Pattern shares among the first n values of each text column."""
    out = {}
    for f in fields:
        if is_text(f.dataType):
            head = df.where(quoted(f.name).isNotNull()).orderBy(ROW_ID).limit(n)
            row = head.agg(*[F.avg(F.coalesce(test(V.strip(quoted(f.name))), F.lit(False)).cast("double")).alias(p) for p, test in PATTERNS]).first()
            out[f.name] = {p: row[p] or 0.0 for p, _ in PATTERNS}
    return out


def profile_frame(spark, columns: list[ColumnProfile]) -> DataFrame:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(asdict(c)[n] for n in names) for c in columns], SCHEMA)


def profile(df: DataFrame) -> DataFrame:
    """One row per column."""
    return profile_frame(df.sparkSession, profile_columns(df))


def dataset_profile(df: DataFrame) -> DataFrame:
    """row_count, col_count, storage_bytes (of the files read; null for other sources)."""
    size = None
    try:
        files = df.select("_metadata.file_path", "_metadata.file_size").distinct()
        size = files.agg(F.sum("file_size")).first()[0]
    except Exception as e:
        if "UNRESOLVED_COLUMN" not in str(e) and "cannot be resolved" not in str(e):
            raise
    return df.agg(F.count(F.lit(1)).alias("row_count")).select("row_count", F.lit(len(data_columns(df))).alias("col_count"), F.lit(size).cast("long").alias("storage_bytes"))
