"""Targeted fixes, one-click cleaning, replayable chains of fixes and their change logs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from cleargrain.functions import values as V
from cleargrain.operators.checks import VALIDATORS, Facts, gather_facts, odd_spellings, outlier_bounds, quartiles, spelling_table
from cleargrain.operators.lookups import looked_up
from cleargrain.operators.profile import data_columns, exact_quantiles, is_numeric, is_text, profile_columns, quoted, row_key, value_frequencies
from cleargrain.operators.score import FIXABLE, severity_rank
from cleargrain.sources.rowid import ROW_ID
from cleargrain.sources.versions import settled

CHANGES = "_row_id long, identifier string, kind string, column_name string, old_value string, new_value string"
NO_FILL_TYPES = ("email", "phone", "url", "id")


class UnfixableIssueError(ValueError):
    """The check has no automatic fix."""


@dataclass(frozen=True)
class Fix:
    """A fix to apply; a chain of them over a baseline is a version."""

    key: str
    column: str | None = None


@dataclass
class FixResult:
    df: DataFrame | None
    op: str
    rows_affected: int
    detail: str
    column: str | None = None
    #: The fix removed rows rather than values.
    value_free: bool = False


def never_filled(name: str) -> bool:
    """Contact and identifier columns are not given guessed values."""
    low = name.lower()
    return any(x in low for x in ("email", "phone", "url")) or low == "id" or low.endswith(("_id", " id"))


def with_first(df: DataFrame, names: list[str]) -> DataFrame:
    """Adds _first: the least row number of the rows with equal values, nulls being equal; null where no other row is equal."""
    groups = df.groupBy(row_key(names).alias("_k")).agg(F.count("*").alias("_rows"), F.min(ROW_ID).alias("_first")).where("_rows > 1")
    return looked_up(df, groups, row_key(names))


def keep_first(df: DataFrame, names: list[str]) -> DataFrame:
    """The first row by number of each group of equal values; nulls are equal."""
    return with_first(df, names).where(F.coalesce(F.col("_first") == F.col(ROW_ID), F.lit(True))).drop("_first")


def typical_value(df: DataFrame, name: str) -> tuple[object, str]:
    """What fills a gap: the median of numbers, the most frequent text (smallest of ties) that isn't blank, or Unknown."""
    c = quoted(name)
    if is_numeric(df.schema[name].dataType):
        found = exact_quantiles(value_frequencies(df, [name]), [0.5])
        return (found[name][0] if found else None), "median"
    values = value_frequencies(df, [name]).where(~V.is_blank("value"))
    best = values.agg(F.min_by("value", F.struct(-F.col("n"), F.col("value")))).first()[0]
    return ("Unknown", "Unknown") if best is None else (best, "mode")


@dataclass
class Step:
    """What a fix does to one table: rows in mask get a new value in column or, without a value, go; or rows equal in unique but the first go."""

    op: str
    detail: str
    column: str | None = None
    value: Column | None = None
    mask: Column | None = None
    unique: list[str] | None = None
    #: Table and key for looked_up(); its column _found_value may be used by value and mask.
    lookup: tuple[DataFrame, Column] | None = None
    #: The new value is of another type, so the step must not be made where it changes no row.
    retypes: bool = False
    #: The new value is null in mask and the old one elsewhere, so value needs no work of its own.
    clears: bool = False


def keeps_type(kind, value_type: str) -> bool:
    return kind.simpleString() == value_type


def planned(df: DataFrame, key: str, column: str | None = None, facts: Facts | None = None) -> Step:
    """The step that mends a finding, with the statistics that it needs of the table as it is."""
    if key == "duplicate_rows":
        return Step("drop_duplicates", "kept the first of each group", unique=[f.name for f in data_columns(df)])
    if key not in FIXABLE or column is None or column not in df.columns:
        raise UnfixableIssueError(f"{key} on {column}")
    c, kind = quoted(column), df.schema[column].dataType
    if key == "missing_values":
        if never_filled(column):
            return Step("drop_rows", "rows without a value dropped", column, mask=c.isNull())
        value, how = typical_value(df, column)
        if value is None:
            return Step("fill", "nothing to fill from", column, c, F.lit(False))
        wide = F.lit(value) if is_text(kind) else F.lit(value).cast("double")
        filled = F.coalesce(c if is_text(kind) else c.cast("double"), wide)
        return Step("fill", f"{how}: {value}", column, filled, c.isNull(), retypes=not (is_text(kind) or keeps_type(kind, "double")))
    if key == "blank_strings":
        if never_filled(column):
            return Step("drop_rows", "blank rows dropped", column, mask=V.is_blank(c))
        value, how = typical_value(df, column)
        return Step("fill_blanks", f"{how}: {value}", column, F.when(V.is_blank(c), F.lit(value)).otherwise(c), V.is_blank(c))
    if key == "whitespace":
        return Step("trim", "outer space removed", column, V.strip(c), V.has_outer_space(c))
    if key.startswith("invalid_"):
        valid = F.coalesce(VALIDATORS[key.removeprefix("invalid_")](c), F.lit(False))
        return Step("null_invalid", "invalid values set to null", column, F.when(valid, c), c.isNotNull() & ~valid, clears=True)
    if key == "negative_values":
        bad = F.coalesce(V.to_number(c) < 0, F.lit(False))
        return Step("null_negative", "negative values set to null", column, F.when(~bad, c), bad)
    if key == "outliers":
        q = (facts.quartiles.get(column) if facts else None) or quartiles(df, [column]).get(column)
        if not q or q[0] == q[1]:
            return Step("clip", "no spread", column, c, F.lit(False))
        lo, hi = outlier_bounds(q)
        x = c.cast("double")
        clipped = F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))
        return Step("clip", f"to {lo:g} … {hi:g}", column, clipped, (x < lo) | (x > hi), retypes=not keeps_type(kind, "double"))
    if key == "case_inconsistency":
        frequencies = settled(value_frequencies(df, [column]))
        names = spelling_table(settled(odd_spellings(frequencies)), frequencies, F.col("spelling").alias("_found_value"))
        found = F.col("_found_value")
        return Step("unify_case", "most frequent spelling", column, F.coalesce(found, c), found.isNotNull(), lookup=(names, row_key([column])))
    if key == "mixed_types":
        numbers = V.is_number(c)
        share = df.agg(F.avg(numbers.cast("double"))).first()[0] or 0.0
        if share >= 0.5:
            return Step("to_number", "text set to null", column, F.when(numbers, c.try_cast("double")), ~numbers, retypes=True)
        return Step("to_text", "numbers set to null", column, F.when(~numbers, c), numbers)
    if key == "duplicate_ids":
        return Step("drop_duplicate_ids", "kept the first row of each id", column, unique=[column])
    return Step("drop_column", f"column {column} dropped", column)


class Chain:
    """A table with row numbers under a series of steps that are put off as long as they can be.

    Steps on single rows become projections; each marks the rows that it touches, and rows that it removes stay, marked, to the end of the
    section. A section ends where a step needs statistics of, or compares, rows that hang on a join: the table is then written to the
    checkpoint folder, and all counts of the section are observed in that one pass. logged: the original values of changed columns travel
    with the rows, so the change log is read off them without a join.
    """

    #: Steps in a section at most, so that plans stay short.
    LONGEST = 12

    def __init__(self, df: DataFrame, identifier: str | None = None, logged: bool = False):
        self.start, self.names, self.logged = df.schema, list(df.columns), logged
        self.frame = df.withColumn("_gone", F.lit(None).cast("int"))
        if logged:
            self.frame = self.frame.withColumn("_own", quoted(identifier).cast("string") if identifier else F.lit(None).cast("string"))
        self.results: list[FixResult] = []
        self.pending: dict[str, FixResult] = {}
        self.old: dict[str, str] = {}
        self.removed: list[DataFrame] = []
        self.joined = False

    @property
    def table(self) -> DataFrame:
        """The rows that are left, as the steps so far make them."""
        return self.frame.where("_gone is null").select(*map(quoted, self.names))

    def fix(self, key: str, column: str | None = None) -> FixResult:
        """One more fix. What it touched is counted by the end of its section."""
        if self.joined and key in ("missing_values", "blank_strings", "outliers", "case_inconsistency", "mixed_types"):
            self.settle()
        return self.put(planned(self.table, key, column))

    def put(self, step: Step) -> FixResult:
        result = FixResult(None, step.op, 0, step.detail, step.column)
        if step.retypes and self.table.where(step.mask).isEmpty():
            return result
        self.results.append(result)
        if step.unique is None and step.mask is None:
            result.rows_affected = 1
            self.names.remove(step.column)
            self.frame = self.frame.drop(step.column)
            return result
        if len(self.pending) >= self.LONGEST or (step.unique is not None and self.joined):
            self.settle()
        hit, left = f"_hit{len(self.pending)}", F.col("_gone").isNull()
        if step.unique is not None:
            # rows that earlier steps removed must be no one's first
            if any(r.value_free for r in self.pending.values()):
                self.settle()
            self.frame, self.joined = with_first(self.frame, step.unique), True
            mask = F.col("_first") != F.col(ROW_ID)
            if step.column is not None:
                mask = mask & quoted(step.column).isNotNull()
        else:
            if step.lookup is not None:
                self.frame, self.joined = looked_up(self.frame, *step.lookup), True
            mask = step.mask
        self.frame = self.frame.withColumn(hit, F.coalesce(mask, F.lit(False)) & left)
        if step.value is None:
            result.value_free = True
            self.frame = self.frame.withColumn("_gone", F.when(F.col(hit), F.lit(len(self.results))).otherwise(F.col("_gone")))
        else:
            if self.logged:
                value = F.when(F.col(hit), F.struct(quoted(step.column).cast("string").alias("value")))  # a change of type alone is none
                name = self.old.setdefault(step.column, f"_old{len(self.old)}")
                self.frame = self.frame.withColumn(name, F.coalesce(F.col(name), value) if name in self.frame.columns else value)
            self.frame = self.frame.withColumn(step.column, F.when(~F.col(hit), quoted(step.column)) if step.clears else step.value)
        self.frame = self.frame.drop("_first", "_found_value")
        self.pending[hit] = result
        return result

    def settle(self) -> None:
        """End of a section: one pass writes the table and counts what each step touched."""
        if not self.pending and not self.joined:
            return
        seen = Observation()
        written = settled(self.frame.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(h)).alias(h) for h in self.pending]))
        counts = seen.get
        for hit, result in self.pending.items():
            result.rows_affected = counts[hit]
        if self.logged and any(r.value_free for r in self.pending.values()):
            self.removed.append(written.where("_gone is not null").select(ROW_ID, F.col("_own").alias("identifier")))
        self.frame = written.where("_gone is null").drop(*self.pending)
        self.pending, self.joined = {}, False

    def finish(self) -> tuple[DataFrame, list[FixResult]]:
        """The table, and the steps that touched something."""
        self.settle()
        return self.table, [r for r in self.results if r.rows_affected]

    def log(self) -> DataFrame:
        """As changes() between the first table and the last."""
        self.settle()
        if not self.logged:
            raise ValueError("the chain keeps no log")
        none = F.lit(None).cast("string")
        out = self.frame.sparkSession.createDataFrame(
            [(None, None, "dropped column", c.name, None, None) for c in self.start.fields if c.name not in self.names], CHANGES)
        for rows in self.removed:
            out = out.unionByName(rows.select(ROW_ID, "identifier", F.lit("removed").alias("kind"), none.alias("column_name"), none.alias("old_value"), none.alias("new_value")))
        kept = [(c, o) for c, o in self.old.items() if c in self.names]
        if kept:
            cells = [
                F.when(
                    F.col(o).isNotNull() & ~F.col(f"{o}.value").eqNullSafe(quoted(c).cast("string")),
                    F.struct(F.lit(c).alias("column_name"), F.col(f"{o}.value").alias("old_value"), quoted(c).cast("string").alias("new_value")),
                )
                for c, o in kept
            ]
            cells = F.explode(F.array_compact(F.array(*cells))).alias("x")
            out = out.unionByName(self.frame.select(ROW_ID, F.col("_own").alias("identifier"), cells).select(ROW_ID, "identifier", F.lit("changed").alias("kind"), "x.*"))
        return out


def apply_fix(df: DataFrame, key: str, column: str | None = None, facts: Facts | None = None) -> FixResult:
    """Apply one fix to a table with row numbers. Other rows and columns stay as they are."""
    step = planned(df, key, column, facts)
    if step.unique is not None:
        out = keep_first(df, step.unique) if column is None else keep_first(df.where(quoted(column).isNotNull()), step.unique).unionByName(df.where(quoted(column).isNull()))
        return FixResult(out, step.op, df.count() - out.count(), step.detail, step.column)
    if step.mask is None:
        return FixResult(df.drop(column), step.op, 1, step.detail, step.column)
    wide, mask = looked_up(df, *step.lookup) if step.lookup else df, F.coalesce(step.mask, F.lit(False))
    out = wide.where(~mask) if step.value is None else wide.withColumn(column, step.value)
    return FixResult(out.select(*map(quoted, df.columns)), step.op, wide.where(mask).count(), step.detail, step.column)


def plan_fixes(findings: DataFrame) -> list[Fix]:
    """Fixable findings by severity, repeats left out."""
    rows = findings.where(F.col("check_key").isin(*FIXABLE)).orderBy(severity_rank(), F.desc("count"), "check_key", "column_name").select("check_key", "column_name")
    return list(dict.fromkeys(Fix(r[0], r[1]) for r in rows.collect()))  # a row per check and column


def fix_all(df: DataFrame, fixes: list[Fix]) -> tuple[DataFrame, list[FixResult]]:
    """Each fix on the result of the one before; those that no longer apply or change nothing are left out."""
    return _folded(Chain(df), fixes).finish()


def fix_all_logged(df: DataFrame, fixes: list[Fix], identifier: str | None = None) -> tuple[DataFrame, list[FixResult], DataFrame]:
    """As fix_all(), with the change log from the first table to the last, which the fixes write down as they go."""
    chain = _folded(Chain(df, identifier, logged=True), fixes)
    return *chain.finish(), chain.log()


def _folded(chain: Chain, fixes: list[Fix], kept: list[Fix] | None = None) -> Chain:
    for fix in fixes:
        try:
            chain.fix(fix.key, fix.column)
        except UnfixableIssueError:
            continue
        if kept is not None:
            kept.append(fix)
    return chain


def replay(baseline: DataFrame, fixes: list[Fix], without: Fix | None = None) -> tuple[DataFrame, list[Fix]]:
    """Undo one fix: the others, in order, over the baseline; statistics are found anew. Also the fixes that still applied."""
    others, kept = list(fixes), []
    if without in others:
        others.remove(without)
    return _folded(Chain(baseline), others, kept).finish()[0], kept


def changes(before: DataFrame, after: DataFrame, identifier: str | None = None) -> DataFrame:
    """row_id, identifier, kind (removed, dropped column, changed), column_name, old_value, new_value; by row number."""
    own = (lambda d: quoted(identifier).cast("string")) if identifier else (lambda d: F.lit(None).cast("string"))
    removed = before.join(after.select(ROW_ID), ROW_ID, "left_anti").select(
        ROW_ID, own(before).alias("identifier"), F.lit("removed").alias("kind"), F.lit(None).cast("string").alias("column_name"),
        F.lit(None).cast("string").alias("old_value"), F.lit(None).cast("string").alias("new_value"),
    )
    names = [f.name for f in data_columns(before)]
    kept = [c for c in names if c in after.columns]
    b = before.select(ROW_ID, own(before).alias("identifier"), F.struct(*[quoted(c).cast("string").alias(f"c{k}") for k, c in enumerate(kept)]).alias("b"))
    a = after.select(ROW_ID, F.struct(*[quoted(c).cast("string").alias(f"c{k}") for k, c in enumerate(kept)]).alias("a"))
    cells = [
        F.when(~F.col(f"b.c{k}").eqNullSafe(F.col(f"a.c{k}")), F.struct(F.lit(c).alias("column_name"), F.col(f"b.c{k}").alias("old_value"), F.col(f"a.c{k}").alias("new_value")))
        for k, c in enumerate(kept)
    ]
    changed = b.join(a, ROW_ID).select(ROW_ID, "identifier", F.explode(F.array_compact(F.array(*cells))).alias("x")).select(ROW_ID, "identifier", F.lit("changed").alias("kind"), "x.*")
    out = removed.unionByName(changed)
    gone = [c for c in names if c not in after.columns]
    if gone:
        rows = [(None, None, "dropped column", c, None, None) for c in gone]
        out = out.unionByName(before.sparkSession.createDataFrame(rows, out.schema))
    return out


def newest_first(log: DataFrame, limit: int = 20) -> DataFrame:
    return log.orderBy(F.desc("at")).limit(limit)


def clean(df: DataFrame, columns=None) -> tuple[DataFrame, DataFrame]:
    """One-click cleaning, in fixed order, with the meanings that columns had before: the table, and one row per step that changed it.

    Trim; drop repeated rows; null invalid contacts and dates; fill gaps; title case; country and gender names; text
    numbers to numbers; clip outliers. Steps list the rows that each touched. The table is written twice, before gaps are filled and at the end.
    """
    chain = _cleaned(Chain(df), df, columns)
    return chain.finish()[0], _operations(chain)


def clean_logged(df: DataFrame, columns=None, identifier: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As clean(), with the change log, which the steps write down as they go."""
    chain = _cleaned(Chain(df, identifier, logged=True), df, columns)
    return chain.finish()[0], _operations(chain), chain.log()


def _operations(chain: Chain) -> DataFrame:
    rows = [(r.op, r.column, r.rows_affected, r.detail) for r in chain.results if r.rows_affected]
    return chain.frame.sparkSession.createDataFrame(rows, "op string, column_name string, rows_affected long, detail string")


def _cleaned(chain: Chain, df: DataFrame, columns) -> Chain:
    kind = {c.name: c.semantic_type for c in columns or profile_columns(df, samples=False)}
    fields = lambda test: [f.name for f in data_columns(chain.table) if test(f.dataType)]
    for name in fields(is_text):
        chain.put(Step("trim_whitespace", "outer space removed", name, V.strip(quoted(name)), V.has_outer_space(quoted(name))))
    chain.put(Step("remove_duplicates", "kept the first of each group", unique=[f.name for f in data_columns(df)]))
    for name in fields(is_text):
        if kind.get(name) in VALIDATORS:
            ok = F.coalesce(VALIDATORS[kind[name]](quoted(name)), F.lit(False))
            chain.put(Step("quarantine_invalid", "invalid values set to null", name, F.when(ok, quoted(name)), quoted(name).isNotNull() & ~ok, clears=True))
    chain.settle()
    for name, (value, step_type) in _gap_values(chain.table, kind).items():
        c = quoted(name) if step_type == "string" else quoted(name).cast("double")
        retypes = step_type != "string" and not keeps_type(chain.table.schema[name].dataType, "double")
        chain.put(Step("fill_missing", "median, mode or Unknown", name, F.coalesce(c, F.lit(value)), quoted(name).isNull(), retypes=retypes))
    for name in fields(is_text):
        c = quoted(name)
        if kind.get(name) == "categorical":
            chain.put(Step("standardize_case", "title case", name, V.title_case(c), c != V.title_case(c)))
        names = V.COUNTRIES if "country" in name.lower() else V.GENDERS if "gender" in name.lower() or name.lower() == "sex" else None
        if names:
            chain.put(Step("normalize_names", "country and gender names", name, V.mapped(c, names), c != V.mapped(c, names)))
    texts = fields(is_text)
    shares = chain.table.agg(*[F.avg(V.is_number(quoted(c)).cast("double")).alias(c) for c in texts]).first().asDict() if texts else {}
    for name in texts:
        if (shares[name] or 0) >= 0.95:
            chain.put(Step("convert_numeric", "text to number", name, V.to_number(quoted(name)), quoted(name).isNotNull()))
    measures = [c for c in fields(is_numeric) if kind.get(c) in ("numeric", "integer", "currency")]
    filled = chain.table.agg(*[F.count(quoted(c)).alias(c) for c in measures]).first().asDict() if measures else {}
    for name, q in quartiles(chain.table, measures).items():
        lo, hi = outlier_bounds(q)
        if filled[name] >= 10 and lo != hi:
            x = quoted(name).cast("double")
            clipped = F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))
            chain.put(Step("cap_outliers", "clipped to the quartile bounds", name, clipped, (x < lo) | (x > hi), retypes=not keeps_type(chain.table.schema[name].dataType, "double")))
    return chain


def _gap_values(df: DataFrame, kind: dict[str, str]) -> dict[str, tuple[object, str]]:
    """What fills the gaps of each column that has some: medians as doubles, the most frequent texts, which may be blank after a trim, or Unknown."""
    fields = [f for f in data_columns(df) if kind.get(f.name) not in NO_FILL_TYPES and (is_text(f.dataType) or is_numeric(f.dataType))]
    if not fields:
        return {}
    missing = df.agg(*[F.count_if(quoted(f.name).isNull()).alias(f"c{k}") for k, f in enumerate(fields)]).first()
    gaps = [f for k, f in enumerate(fields) if missing[k]]
    if not gaps:
        return {}
    frequencies = settled(value_frequencies(df, [f.name for f in gaps]))
    numbers, texts = [f.name for f in gaps if is_numeric(f.dataType)], [f.name for f in gaps if is_text(f.dataType)]
    medians = exact_quantiles(frequencies.where(F.col("column_name").isin(numbers)), [0.5]) if numbers else {}
    best = F.min_by("value", F.struct(-F.col("n"), F.col("value")))
    modes = {r[0]: r[1] for r in frequencies.where(F.col("column_name").isin(texts)).groupBy("column_name").agg(best).collect()} if texts else {}  # a row per column
    out = {c: (medians[c][0], "double") for c in numbers if c in medians} | {c: (modes.get(c, "Unknown"), "string") for c in texts}
    return {f.name: out[f.name] for f in gaps if f.name in out}


def touched_rows(log: DataFrame, limit: int = 200) -> DataFrame:
    """column_name (null: removed rows), rows: the first row numbers of a change log that a column was changed in, and how many there are."""
    place = F.row_number().over(Window.partitionBy("column_name").orderBy(ROW_ID))
    counts = log.groupBy("column_name").agg(F.count("*").alias("rows_affected"))
    first = log.withColumn("_n", place).where(F.col("_n") <= limit).groupBy("column_name").agg(F.array_sort(F.collect_list(ROW_ID)).alias("rows"))
    same = counts["column_name"].eqNullSafe(first["column_name"])
    return counts.join(first, same).select(counts["*"], "rows")


def before_after(before: DataFrame, after: DataFrame, facts: Facts | None = None) -> DataFrame:
    """Two rows, before and after: score, rows, columns, duplicates, mean share of nulls. facts: those of the table before, if they are there already."""
    from cleargrain.operators.score import score

    def side(df: DataFrame, name: str, facts: Facts | None = None) -> DataFrame:
        nulls = df.agg(F.round(sum(F.avg(quoted(f.name).isNull().cast("double")) for f in data_columns(df)) / max(1, len(data_columns(df))) * 100, 2)).first()[0]
        s = score(df, facts or gather_facts(df)).select("overall", "row_count", "duplicate_rows")
        return s.select(F.lit(name).alias("side"), "*", F.lit(len(data_columns(df))).alias("col_count"), F.lit(nulls).alias("avg_null_pct"))

    return side(before, "before", facts).unionByName(side(after, "after"))


