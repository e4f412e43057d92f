"""Twenty quality checks as row masks, so that all of them are counted in one scan, and the rows behind each finding."""

from __future__ import annotations

import re
import warnings
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cleargrain.functions import values as V
from cleargrain.operators.guard import check_tree
from cleargrain.operators.lookups import BROADCAST_BYTES, HOT_KEYS, ROW_BYTES, looked_up
from cleargrain.operators.profile import ColumnProfile, counts_exactly, data_columns, exact_quantiles, is_numeric, is_text, profile_columns, quoted, row_key, value_frequencies
from cleargrain.sources.rowid import ROW_ID
from cleargrain.sources.versions import fine_shuffles, settled, stored

# Dimension of each check, checks on a whole column, order of severities.
DIMENSIONS = {
    "missing_values": "completeness", "blank_strings": "completeness", "duplicate_rows": "uniqueness", "duplicate_columns": "uniqueness",
    "constant_column": "uniqueness", "high_cardinality": "uniqueness", "low_cardinality": "uniqueness", "invalid_email": "validity",
    "invalid_phone": "validity", "invalid_url": "validity", "invalid_date": "validity", "negative_values": "validity", "whitespace": "consistency",
    "case_inconsistency": "consistency", "mixed_types": "consistency", "unicode_issues": "consistency", "outliers": "accuracy",
    "datatype_mismatch": "accuracy", "duplicate_ids": "integrity", "empty_dataset": "integrity",
}
ALL_DIMENSIONS = ("completeness", "uniqueness", "validity", "consistency", "accuracy", "integrity")
SEVERITIES = {
    "blank_strings": "medium", "duplicate_columns": "medium", "constant_column": "low", "high_cardinality": "info", "low_cardinality": "info",
    "invalid_email": "high", "invalid_phone": "high", "invalid_url": "high", "invalid_date": "medium", "negative_values": "medium", "whitespace": "low",
    "case_inconsistency": "low", "mixed_types": "medium", "unicode_issues": "low", "outliers": "low", "datatype_mismatch": "medium",
    "duplicate_ids": "high", "empty_dataset": "critical",
}
COLUMN_LEVEL = ("constant_column", "duplicate_columns", "high_cardinality", "low_cardinality", "datatype_mismatch")
#: Checks whose findings show no values.
UNSHOWN = ("missing_values", "duplicate_rows", "duplicate_ids")
#: Masks name the values that fail a check if a column has no more of them, and no more bytes in them.
FEW_VALUES, FEW_BYTES = 50, 10_000
SEVERITY_ORDER = ("critical", "high", "medium", "low", "info")
VALIDATORS = {"email": V.is_email, "phone": V.is_phone, "url": V.is_url, "date": V.is_date}
NUMERIC_TYPES = ("numeric", "integer", "currency")
FINDINGS = "check_key string, dimension string, severity string, count long, column_name string, sample array<string>"


@dataclass
class RowCheck:
    """A check that flags rows: the mask, the count if it is not that of the mask, and what makes a finding of it."""

    key: str
    column: str | None
    mask: Column
    dimension: str
    severity: str | Callable[[int, int], str]
    counted: Column | None = None
    #: The mask as a function of the column's text, if it depends on that alone: it is then counted on distinct values.
    test: Callable[[Column], Column] | None = None
    #: The rows that it flags, if the profile has counted them.
    known: int | None = None


@dataclass
class Facts:
    """What masks need to know of a table besides its profile."""

    columns: list[ColumnProfile]
    quartiles: dict[str, tuple[float, float]] = field(default_factory=dict)
    odd: DataFrame | None = None
    #: Columns with odd spellings, and the bytes that these take.
    cased: dict[str, int] = field(default_factory=dict)
    frequencies: DataFrame | None = None

    def __getitem__(self, name: str) -> ColumnProfile:
        return next(c for c in self.columns if c.name == name)


#: User checks: functions of (df, facts) that return a list of RowCheck.
CHECKS: list[Callable[[DataFrame, Facts], list[RowCheck]]] = []


def register_check(fn):
    """Adds a check; its masks are counted in the same scan as all others."""
    CHECKS.append(fn)
    return fn


def canonical_spellings(frequencies: DataFrame) -> DataFrame:
    """column_name, key, spelling, spellings: the most frequent spelling of each casefold key, ties to the smallest text."""
    keyed = frequencies.withColumn("key", V.casefold("value"))
    best = F.min_by("value", F.struct(-F.col("n"), F.col("value")))
    return keyed.groupBy("column_name", "key").agg(best.alias("spelling"), F.count("*").alias("spellings"))


def odd_spellings(frequencies: DataFrame) -> DataFrame:
    """column_name, value, n, spelling: the spellings that are not the canonical one of their key, which is given beside them."""
    fine_shuffles(frequencies.sparkSession)
    several = canonical_spellings(frequencies).where("spellings > 1")
    keyed = frequencies.withColumn("key", V.casefold("value"))
    return keyed.join(several, ["column_name", "key"]).where("value != spelling").select("column_name", "value", "n", "spelling")


def spelling_table(odd: DataFrame, frequencies: DataFrame, add: Column) -> DataFrame:
    """For looked_up() on row_key([column]): the odd spellings of one column with what to add, and its frequent other ones without."""
    key = row_key(["value"])  # the same as that of the column, since only values are hashed
    rows = frequencies.agg(F.sum("n").alias("all"))
    frequent = frequencies.join(F.broadcast(rows), F.col("n") * HOT_KEYS > F.col("all")).join(odd.select("value"), "value", "left_anti")
    entries = odd.select(key.alias("_k"), F.col("n").alias("_rows"), add)
    return entries.unionByName(frequent.select(key.alias("_k"), F.col("n").alias("_rows")), allowMissingColumns=True)


def quartiles(df: DataFrame, names: list[str], frequencies: DataFrame | None = None) -> dict[str, tuple[float, float]]:
    """Exact first and third quartiles, from value frequencies, so equal values count once."""
    if not names:
        return {}
    own = value_frequencies(df, names) if frequencies is None else frequencies.where(F.col("column_name").isin(names))
    return {name: tuple(q) for name, q in exact_quantiles(own, [0.25, 0.75]).items()}


def gather_facts(df: DataFrame, columns: list[ColumnProfile] | None = None, samples: bool = False) -> Facts:
    """Profiles, quartiles and odd spellings, all from one table of value frequencies that is computed once."""
    frequencies = stored(value_frequencies(df))
    columns = profile_columns(df, samples, frequencies=frequencies) if columns is None else columns
    facts = Facts(columns, frequencies=frequencies)
    facts.quartiles = quartiles(df, [c.name for c in columns if c.semantic_type in NUMERIC_TYPES and is_numeric(df.schema[c.name].dataType)], frequencies)
    texts = [c.name for c in columns if c.semantic_type in ("categorical", "text") and is_text(df.schema[c.name].dataType) and c.distinct_count]
    if texts:
        facts.odd = stored(odd_spellings(frequencies.where(F.col("column_name").isin(texts))))
        sizes = {r[0]: r[1] for r in facts.odd.groupBy("column_name").agg(F.sum(F.octet_length("value") + ROW_BYTES)).collect()}  # a row per column
        facts.cased = {c: sizes[c] for c in texts if c in sizes}
    return facts


def _false_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def outlier_bounds(q: tuple[float, float]) -> tuple[float, float]:
    spread = q[1] - q[0]
    return q[0] - 1.5 * spread, q[1] + 1.5 * spread


def with_odd_spelling(df: DataFrame, name: str) -> DataFrame:
    """Rows whose spelling is not the canonical one; odd spellings are joined, never collected."""
    frequencies = settled(value_frequencies(df, [name]))
    entries = spelling_table(settled(odd_spellings(frequencies)), frequencies, F.lit(True).alias("_odd"))
    return looked_up(df, entries, row_key([name])).where("_odd").drop("_odd")


def row_checks(df: DataFrame, facts: Facts) -> list[RowCheck]:
    """All checks that flag rows and apply to the table, but for those of flag_spellings() and flag_duplicates()."""
    out: list[RowCheck] = []

    def add(key: str, column: str, mask, severity=None, known=None) -> None:
        test = (lambda c: _false_if_null(mask(c))) if callable(mask) else None
        whole = test(quoted(column)) if test else _false_if_null(mask)
        out.append(RowCheck(key, column, whole, DIMENSIONS[key], severity or SEVERITIES[key], test=test, known=known))

    for p in facts.columns:
        c, kind, text = quoted(p.name), p.semantic_type, is_text(df.schema[p.name].dataType)
        has = p.matches.get if facts.frequencies is not None else lambda mark: None
        lacks = lambda mark: None if has(mark) is None else p.filled - has(mark)  # noqa: B023, E731
        if p.null_count:
            pct = p.null_count / p.rows * 100
            severity = "critical" if pct > 50 else "high" if pct > 20 else "medium" if pct > 5 else "low"
            add("missing_values", p.name, c.isNull(), severity, p.null_count if facts.frequencies is not None else None)
        if text:
            add("blank_strings", p.name, V.is_blank, known=has("blank"))
            add("whitespace", p.name, V.has_outer_space, known=has("spaced"))
            add("unicode_issues", p.name, V.is_corrupted, known=has("corrupted"))
            if 0.1 < p.number_share < 0.9:
                numbers = p.number_share >= 0.5
                add("mixed_types", p.name, (lambda c: ~V.is_number(c)) if numbers else V.is_number, known=lacks("num") if numbers else has("num"))
        if kind in VALIDATORS and text:
            add(f"invalid_{kind}", p.name, lambda c, valid=VALIDATORS[kind]: c.isNotNull() & ~_false_if_null(valid(c)), known=lacks(kind))
        if kind in ("currency", "zip") and is_numeric(df.schema[p.name].dataType):
            add("negative_values", p.name, c < 0)
        if p.name in facts.quartiles and is_numeric(df.schema[p.name].dataType) and p.filled >= 10:
            lo, hi = outlier_bounds(facts.quartiles[p.name])
            if lo != hi:
                add("outliers", p.name, (c < lo) | (c > hi))
    for fn in CHECKS:
        out += user_checks(df, facts, fn)
    return out


def user_checks(df: DataFrame, facts: Facts, fn: Callable[[DataFrame, Facts], list[RowCheck]]) -> list[RowCheck]:
    """The checks of a registered function; one that raises, or whose mask Spark cannot analyse, is left out with a warning."""
    try:
        found = list(fn(df, facts))
    except Exception as e:  # whatever a user's function raises must not end the run
        warnings.warn(f"check {getattr(fn, '__name__', fn)} left out: {e}", stacklevel=2)
        return []
    out = []
    for x in found:
        try:
            df.select(x.mask, *([] if x.counted is None else [x.counted])).schema  # noqa: B018  analysis only
            out.append(x)
        except AnalysisException as e:
            warnings.warn(f"check {x.key} left out: {e}", stacklevel=2)
    return out


def flag_spellings(df: DataFrame, facts: Facts) -> tuple[DataFrame, list[RowCheck]]:
    """df with a column per column in facts.cased that is null but in rows with an odd spelling, and the checks on them.

    Odd spellings are joined back by value, however many they are, and however many rows one of them has.
    """
    checks: list[RowCheck] = []
    for k, (name, size) in enumerate(facts.cased.items()):
        odd = facts.odd.where(F.col("column_name") == name)
        if size <= BROADCAST_BYTES or facts.frequencies is None:
            right = odd.select(F.col("value").alias(f"_odd{k}"))
            df = df.join(F.broadcast(right) if size <= BROADCAST_BYTES else right, quoted(name).cast("string") == F.col(f"_odd{k}"), "left")
        else:
            entries = spelling_table(odd, facts.frequencies.where(F.col("column_name") == name), F.lit(True).alias(f"_odd{k}"))
            df = looked_up(df, entries, row_key([name]))
        checks.append(RowCheck("case_inconsistency", name, F.col(f"_odd{k}").isNotNull(), DIMENSIONS["case_inconsistency"], SEVERITIES["case_inconsistency"]))
    return df, checks


def known_values(facts: Facts, checks: list[RowCheck]) -> list[RowCheck]:
    """The checks; the mask of one on a text alone that few values fail names these values, so that rows need no patterns.

    Values are tested once each, as value_findings() does. Columns in which more than FEW_VALUES values, or long ones, fail keep their masks.
    """
    tests: dict[str, list[RowCheck]] = {}
    for x in checks:
        if x.test and x.key in DIMENSIONS:
            tests.setdefault(x.column, []).append(x)
    if not tests or facts.frequencies is None:
        return checks
    failing = settled(failing_values(facts.frequencies, [x for own in tests.values() for x in own]).drop("n"))
    sizes = failing.groupBy("column_name").agg(F.count("*").alias("values"), F.sum(F.octet_length("value")).alias("bytes")).collect()  # a row per column
    many = {r[0] for r in sizes if r[1] > FEW_VALUES or r[2] > FEW_BYTES}
    few: dict[str, list] = {r[0]: [] for r in sizes if r[0] not in many}
    for name, text, found in failing.where(F.col("column_name").isin(list(few))).collect() if few else []:  # FEW_VALUES rows a column at most
        few[name].append((text, found))
    masks = {}
    for name, own in tests.items():
        for j, x in enumerate(own if name not in many else []):
            bad = [text for text, found in few.get(name, []) if found >> j & 1]
            masks[id(x)] = _false_if_null(quoted(name).cast("string").isin(bad)) if bad else F.lit(False)
    return [replace(x, mask=masks[id(x)]) if id(x) in masks else x for x in checks]


def flag_duplicates(df: DataFrame, facts: Facts) -> tuple[DataFrame, list[RowCheck]]:
    """df with the size of each row's group of equal rows and of equal ids, and the checks on them.

    Sizes are aggregated first and joined back on a hash, so that a group with very many copies meets in no one task. Masks take all members of a group; counts leave one of each group out.
    """
    names = [f.name for f in data_columns(df)]
    checks: list[RowCheck] = []
    sizes = lambda rows, key, name: rows.groupBy(key.alias("_k")).agg(F.count("*").alias("_rows")).where("_rows > 1").withColumn(name, F.col("_rows"))
    extra = lambda size: F.when(size > 1, (size - 1) / size).otherwise(0.0)  # noqa: E731  sums to copies - 1 over a group
    whole = row_key(names) if names else F.lit(None).cast("struct<a:long,b:long>")
    keyed = looked_up(df, sizes(df, whole, "_copies"), whole)
    checks.append(RowCheck("duplicate_rows", None, _false_if_null(F.col("_copies") > 1), "uniqueness", lambda n, rows: "high" if n > 0.05 * rows else "medium", extra(F.col("_copies"))))
    for k, p in enumerate(x for x in facts.columns if x.semantic_type == "id"):
        own = row_key([p.name])
        keyed = looked_up(keyed, sizes(df.where(quoted(p.name).isNotNull()), own, f"_same{k}"), F.when(quoted(p.name).isNotNull(), own))
        checks.append(RowCheck("duplicate_ids", p.name, _false_if_null(F.col(f"_same{k}") > 1), "integrity", "high", extra(F.col(f"_same{k}"))))
    return keyed, checks


def duplicate_checks(df: DataFrame, facts: Facts) -> list[RowCheck]:
    """The checks of flag_duplicates() with their counts, copies - 1 of each group, for which nothing is joined. Ids are counted from the profile where values compare as it counts them."""
    names = [f.name for f in data_columns(df)]
    exact = {c.name for c in facts.columns if facts.frequencies is not None and counts_exactly(df.schema[c.name].dataType)}

    def extra(rows: DataFrame, own: list[str]) -> int:
        return rows.groupBy(row_key(own).alias("_k")).agg((F.count("*") - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    unique = not names or any(c.name in exact and c.distinct_count == c.rows for c in facts.columns)
    severity = lambda n, rows: "high" if n > 0.05 * rows else "medium"
    out = [RowCheck("duplicate_rows", None, F.lit(True), "uniqueness", severity, known=0 if unique else extra(df, names))]
    for p in facts.columns:
        if p.semantic_type == "id":
            n = p.filled - p.distinct_count if p.name in exact else extra(df.where(quoted(p.name).isNotNull()), [p.name])
            out.append(RowCheck("duplicate_ids", p.name, F.lit(True), "integrity", "high", known=n))
    return out


def possible_twins(df: DataFrame, columns: list[ColumnProfile]) -> list[str]:
    """Columns that may be equal as text to another one: as many nulls and, where values and their texts are the same in number, as many distinct values."""
    alike: dict[int, list[ColumnProfile]] = {}
    for c in columns:
        if c.distinct_count >= 2:
            alike.setdefault(c.null_count, []).append(c)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    loose = (T.FloatType, T.DoubleType, T.TimestampType)  # two texts for both zeros, one for two instants when clocks go back
    exact = {n: all(counts_exactly(kinds[c.name]) and not isinstance(kinds[c.name], loose) for c in own) for n, own in alike.items()}
    key = lambda c: (c.null_count, c.distinct_count if exact[c.null_count] else None)
    sizes = Counter(key(c) for own in alike.values() for c in own)
    return [c.name for c in columns if c.distinct_count >= 2 and sizes[key(c)] > 1]


def duplicate_column_pairs(df: DataFrame, columns: list[ColumnProfile]) -> list[tuple[str, str]]:
    """(column, earlier twin) of columns that are equal as text, nulls included, and hold two values at least.

    An order-free fingerprint of (row number, value) finds the pairs, which are then compared row by row.
    """
    names = possible_twins(df, columns)
    if not names:
        return []
    row = quoted(ROW_ID) if ROW_ID in df.columns else F.xxhash64(*map(quoted, names))
    own = [F.xxhash64(row, quoted(c).cast("string")) for c in names]
    # without row numbers, rows that occur an even number of times leave no trace in the first print
    found = df.agg(*[p.alias(f"p{k}{i}") for k, h in enumerate(own) for i, p in enumerate((F.bit_xor(h), F.sum(F.shiftright(h, 40))))]).first()
    prints = [found[2 * k : 2 * k + 2] for k in range(len(names))]
    maybe = [(names[j], names[i]) for j in range(len(names)) for i in range(j) if prints[i] == prints[j]]
    if not maybe:
        return []
    differ = df.agg(*[F.count_if(~quoted(a).cast("string").eqNullSafe(quoted(b).cast("string"))).alias(f"d{k}") for k, (a, b) in enumerate(maybe)]).first()
    out: dict[str, str] = {}
    for k, (a, b) in enumerate(maybe):
        if differ[k] == 0:
            out.setdefault(a, b)
    return list(out.items())


def column_findings(df: DataFrame, facts: Facts) -> list[tuple]:
    rows: list[tuple] = []

    def add(key: str, p: str, count: int, sample: list[str]) -> None:
        rows.append((key, DIMENSIONS[key], SEVERITIES[key], count, p, sample))

    for a, b in duplicate_column_pairs(df, facts.columns):
        add("duplicate_columns", a, 1, [b])
    for p in facts.columns:
        if p.distinct_count <= 1 and p.rows > 1:
            add("constant_column", p.name, 1, [p.min_val] if p.min_val is not None else [])
        if p.semantic_type in ("text", "categorical") and p.rows > 20 and p.distinct_count / p.rows > 0.9:
            add("high_cardinality", p.name, p.distinct_count, [])
        if p.semantic_type in ("numeric", "integer") and p.distinct_count <= 2 and p.rows > 20:
            add("low_cardinality", p.name, p.distinct_count, [])
        if is_text(df.schema[p.name].dataType) and p.filled and p.number_share >= 0.95:
            add("datatype_mismatch", p.name, p.filled, [])
    return rows


def run_checks(df: DataFrame, facts: Facts | None = None, rules: list[RowCheck] = (), samples: bool = True) -> DataFrame:
    """Findings: one row per check and column with a count above 0. A broken rule is left out, the others run.

    Checks on a text alone are counted, and sampled, on distinct values with their frequencies, most of them while the profile is made; duplicates
    by groups of equal rows; the others in one scan of the rows.
    """
    facts = facts or gather_facts(df)
    spark = df.sparkSession
    n = facts.columns[0].rows if facts.columns else df.count()
    if not n:
        return spark.createDataFrame([("empty_dataset", "integrity", "critical", 1, None, [])], FINDINGS)
    mine = row_checks(df, facts)
    by_value, by_row = [x for x in mine if x.test], [*[x for x in mine if not x.test], *duplicate_checks(df, facts), *rules]
    found = value_findings(facts, df, by_value, samples)
    counts = count_checks(df, by_row)
    shown = sample_values(df, [x for x, c in zip(by_row, counts) if c and x.column and x.counted is None and x.key not in UNSHOWN]) if samples else {}
    found += [(x, c, shown.get((x.key, x.column), [])) for x, c in zip(by_row, counts)]
    rows = column_findings(df, facts)
    for x, c, sample in found:
        if c:
            rows.append((x.key, x.dimension, x.severity(c, n) if callable(x.severity) else x.severity, c, x.column, sample))
    return spark.createDataFrame(rows, FINDINGS)


def bits_of(checks: list[RowCheck]) -> list[int]:
    """A bit for each check that no other one on its column has."""
    seen: Counter = Counter()
    out = []
    for x in checks:
        out.append(1 << seen[x.column])
        seen[x.column] += 1
    return out


def failing_values(frequencies: DataFrame, checks: list[RowCheck]) -> DataFrame:
    """column_name, value, n, bits: the values that fail checks on texts alone, with the bits_of() these."""
    own: dict[str, list[Column]] = {}
    for x, bit in zip(checks, bits_of(checks)):
        own.setdefault(x.column, []).append(F.when(x.test(F.col("value")), F.lit(bit)).otherwise(F.lit(0)))
    bits = F
    for name, marks in own.items():
        bits = bits.when(F.col("column_name") == name, sum(marks[1:], marks[0]))
    return frequencies.where(F.col("column_name").isin(list(own))).select("column_name", "value", "n", bits.alias("bits")).where("bits > 0")


def value_findings(facts: Facts, df: DataFrame, checks: list[RowCheck], samples: bool, k: int = 5) -> list[tuple[RowCheck, int, list[str]]]:
    """(check, rows, up to k distinct offending values) of checks on texts, and of odd spellings."""
    frequencies = facts.frequencies if facts.frequencies is not None else value_frequencies(df, list(dict.fromkeys(x.column for x in checks)))
    cased = [RowCheck("case_inconsistency", c, F.lit(True), DIMENSIONS["case_inconsistency"], SEVERITIES["case_inconsistency"]) for c in facts.cased]
    named = [*checks, *cased]
    counts = {i: x.known for i, x in enumerate(checks) if x.known is not None}
    # values are tested again for samples of what was found, and for counts that the profile does not have
    tested = {i: x for i, x in enumerate(checks) if x.known is None or (samples and x.known)}
    hits = None
    if tested:
        failing = stored(failing_values(frequencies, [*tested.values()]))
        marks = [F.when((F.col("column_name") == x.column) & (F.col("bits").bitwiseAND(bit) != 0), F.lit(i)) for (i, x), bit in zip(tested.items(), bits_of([*tested.values()]))]
        hits = failing.select("value", "n", F.explode(F.array_compact(F.array(*marks))).alias("i"))
    if cased:
        number = F.create_map(*[F.lit(v) for j, x in enumerate(cased) for v in (x.column, len(checks) + j)])
        odd = facts.odd.where(F.col("column_name").isin(list(facts.cased))).select("value", "n", F.element_at(number, F.col("column_name")).alias("i"))
        hits = odd if hits is None else hits.unionByName(odd)
    if hits is not None:
        counts = {r[0]: r[1] for r in hits.groupBy("i").agg(F.sum("n")).collect()} | counts  # a row per check
    shown: dict[int, list[str]] = {}
    if samples and hits is not None:
        place = F.row_number().over(Window.partitionBy("i").orderBy("value"))
        for i, value in hits.withColumn("place", place).where(F.col("place") <= k).orderBy("i", "place").select("i", "value").collect():
            shown.setdefault(i, []).append(value)
    return [(x, counts.get(i, 0), shown.get(i, [])) for i, x in enumerate(named)]


def unsound(flagged: DataFrame, checks: list[RowCheck]) -> list[RowCheck]:
    """The checks whose masks end a scan on some value of the rows, found by halving: a failing one takes about log2 of their number in scans."""

    def search(some: list[RowCheck]) -> list[RowCheck]:
        if not some:
            return []
        try:
            flagged.agg(*[F.count_if(x.mask).alias(f"c{k}") for k, x in enumerate(some)]).collect()
            return []
        except PySparkException as e:
            if len(some) == 1:
                warnings.warn(f"check {some[0].key} left out: {e}", stacklevel=2)
                return some
        return search(some[: len(some) // 2]) + search(some[len(some) // 2 :])

    return search(checks)


def made_by_users(checks: list[RowCheck]) -> list[RowCheck]:
    return [x for x in checks if x.key not in DIMENSIONS]


def count_checks(flagged: DataFrame, checks: list[RowCheck]) -> list[int]:
    """Rows that each check flags, in one scan, which those with a known count need not. If it fails, the users' checks that cannot take some value are searched out and count none."""
    if any(x.known is not None for x in checks):
        counted = iter(count_checks(flagged, [x for x in checks if x.known is None]))
        return [next(counted) if x.known is None else x.known for x in checks]

    def count(some: list[RowCheck]) -> list[int]:
        return list(flagged.agg(*[(F.round(F.sum(x.counted)) if x.counted is not None else F.count_if(x.mask)).cast("long").alias(f"c{k}") for k, x in enumerate(some)]).first()) if some else []

    try:
        return count(checks)
    except PySparkException:
        bad = set(map(id, unsound(flagged, made_by_users(checks))))
        if not bad:
            raise
        sound = [x for x in checks if id(x) not in bad]
        found = dict(zip(map(id, sound), count(sound)))
        return [found.get(id(x), 0) for x in checks]


def sample_values(df: DataFrame, checks: list[RowCheck], k: int = 5) -> dict[tuple[str, str], list[str]]:
    """Up to k distinct offending values of each check."""
    if not checks:
        return {}
    pairs = [F.when(x.mask, F.struct(F.lit(i).alias("i"), quoted(x.column).cast("string").alias("value"))) for i, x in enumerate(checks)]
    found = df.select(F.explode(F.array(*pairs)).alias("p")).where("p.value is not null").select("p.*").distinct()
    place = F.row_number().over(Window.partitionBy("i").orderBy("value"))
    out: dict[tuple[str, str], list[str]] = {}
    for i, value in found.withColumn("place", place).where(F.col("place") <= k).orderBy("i", "place").select("i", "value").collect():
        out.setdefault((checks[i].key, checks[i].column), []).append(value)
    return out


def rule_check(df: DataFrame, rule_id, condition: str, dimension: str = "validity", severity: str = "medium", column: str | None = None) -> RowCheck:
    """A user's SQL condition as a check. It is analysed alone first, so a bad one fails here and not in the scan."""
    condition = condition.strip().removesuffix(";")
    if ";" in re.sub(r"'(?:[^']|'')*'", "", condition):
        raise ValueError("a condition is one expression")
    check_tree(df.sparkSession, condition, (), whole=False)
    mask = F.expr(condition)
    df.where(mask).schema  # noqa: B018  analysis only
    return RowCheck(f"custom_{rule_id}", column, _false_if_null(mask), dimension, severity)


class Rules:
    """Stored rules (id, name, condition, dimension, severity, active) as a DataFrame, with create, list, delete."""

    SCHEMA = "rule_id string, name string, condition string, dimension string, severity string, active boolean"

    def __init__(self, spark, rows: DataFrame | None = None):
        self.rows = rows if rows is not None else spark.createDataFrame([], self.SCHEMA)

    def create(self, df: DataFrame, rule_id: str, name: str, condition: str, dimension: str = "validity", severity: str = "medium") -> Rules:
        rule_check(df, rule_id, condition)
        new = df.sparkSession.createDataFrame([(rule_id, name, condition, dimension, severity, True)], self.SCHEMA)
        return Rules(None, self.rows.where(F.col("rule_id") != rule_id).unionByName(new))

    def delete(self, rule_id: str) -> Rules:
        return Rules(None, self.rows.where(F.col("rule_id") != rule_id))

    def checks(self, df: DataFrame) -> list[RowCheck]:
        out = []
        for r in self.rows.where("active").collect():
            try:
                out.append(rule_check(df, r["rule_id"], r["condition"], r["dimension"], r["severity"]))
            except (AnalysisException, ValueError) as e:
                warnings.warn(f"rule {r['rule_id']} left out: {e}", stacklevel=2)
        return out


def preview_rule(df: DataFrame, condition: str, limit: int = 10) -> tuple[DataFrame, DataFrame]:
    """(matched, total) in one row, and sample rows."""
    mask = rule_check(df, "preview", condition).mask
    return df.agg(F.count_if(mask).alias("matched"), F.count(F.lit(1)).alias("total")), df.where(mask).limit(limit)


def affected_rows(df: DataFrame, key: str, column: str | None = None, facts: Facts | None = None) -> DataFrame:
    """The rows behind a finding. Unknown keys and columns have none; duplicates are whole groups; column checks take all filled rows."""
    names = [f.name for f in data_columns(df)]
    if column is not None and column not in names:
        return df.limit(0)
    if key in ("duplicate_rows", "duplicate_ids"):
        ids = [ColumnProfile(column, 0, "", "id", 0, 0.0, 0, 0.0)] if column else facts.columns if facts else []
        flagged, checks = flag_duplicates(df, Facts(ids))
        mask = next((x.mask for x in checks if x.key == key), F.lit(False))
        return flagged.where(mask).select(*[quoted(c) for c in df.columns])
    if column is None:
        return df.limit(0)
    if key == "case_inconsistency":
        return with_odd_spelling(df, column)
    # the facts of one column are enough
    own = facts or Facts(profile_columns(df.select(quoted(column)), samples=False) if key == "mixed_types" else [])
    return df.where(mask_of(df, own, key, column))


def mask_of(df: DataFrame, facts: Facts, key: str, column: str) -> Column:
    """The mask of a check on a column, whether or not the check would be made there."""
    c = quoted(column)
    number = V.to_number(c)
    if key == "outliers":
        q = facts.quartiles.get(column) or quartiles(df, [column]).get(column)
        lo, hi = outlier_bounds(q) if q else (0.0, 0.0)
        mask = (number < lo) | (number > hi) if q and lo != hi else F.lit(False)
    elif key == "mixed_types":
        mask = c.isNotNull() & (~V.is_number(c.cast("string")) if facts[column].number_share >= 0.5 else V.is_number(c.cast("string")))
    elif key.removeprefix("invalid_") in VALIDATORS:
        mask = c.isNotNull() & ~_false_if_null(VALIDATORS[key.removeprefix("invalid_")](c.cast("string")))
    elif key in COLUMN_LEVEL:
        mask = c.isNotNull()
    else:
        tests = {
            "missing_values": c.isNull(), "blank_strings": V.is_blank(c.cast("string")), "whitespace": V.has_outer_space(c.cast("string")),
            "negative_values": number < 0, "unicode_issues": V.is_corrupted(c.cast("string")),
        }
        mask = tests.get(key, F.lit(False))
    return _false_if_null(mask)


def identifier_column(columns: list[ColumnProfile]) -> str | None:
    """The column that names rows: an id by meaning, else nearly unique, else by name."""
    by_type = next((c.name for c in columns if c.semantic_type == "id"), None)
    unique = next((c.name for c in columns if c.cardinality_ratio >= 0.999), None)
    named = next((c.name for c in columns if c.name.lower() in ("id", "pin", "pin16") or c.name.lower().endswith(("_id", "_key", "pin", "pin16"))), None)
    return by_type or unique or named


def drill_down(df: DataFrame, key: str, column: str | None, facts: Facts | None = None, twin: str | None = None, limit: int = 200) -> tuple[DataFrame, int]:
    """A finding's rows by number, identifier and offending column (and its twin), or all columns; and the exact total."""
    facts = facts or gather_facts(df)
    rows = affected_rows(df, key, column, facts)
    own = identifier_column(facts.columns)
    if column is None:
        shown = [ROW_ID, *[f.name for f in data_columns(df)]]
    else:
        shown = list(dict.fromkeys([ROW_ID, *([own] if own else []), column, *([twin] if twin else [])]))
    return rows.select(*[quoted(c) for c in shown]).orderBy(ROW_ID).limit(limit), rows.count()
