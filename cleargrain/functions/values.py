"""Value functions: trimming, validators, lenient parsers and number checks, all as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns and formats that decide what is valid.
EMAIL = r"^[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}$"
PHONE = r"^\+?[\d\s().\-]{7,20}$"
PHONE_DIGITS = r"^(?:\D*\d){7,15}\D*$"
URL = r"(?i)^https?://[^\s/$.?#].[^\s]*$"
CURRENCY = r"^[\s]*[$€£₹¥]?\s?-?\d{1,3}(,\d{3})*(\.\d+)?\s*[$€£₹¥]?\s*$"
ZIP = r"^\d{5}(-\d{4})?$"
NUMBER = r"^-?\d+(\.\d+)?$"
#: Character by character, which the JVM looks up in a table; ranges are compared one by one.
CORRUPTED = "[" + "".join(rf"\x{k:02x}" for k in range(0x20) if k not in (0x09, 0x0A, 0x0D)) + "�]"
COUNTRIES = {
    "usa": "United States", "us": "United States", "u.s.a.": "United States", "united states of america": "United States",
    "uk": "United Kingdom", "u.k.": "United Kingdom", "uae": "United Arab Emirates",
}
GENDERS = {"m": "Male", "male": "Male", "f": "Female", "female": "Female", "man": "Male", "woman": "Female"}

_SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
_TIME, _TIME_FORMAT = r"\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?", "H:mm[:ss[.SSSSSSSSS]]"
#: Common shapes of dates and the formats for each; a text is parsed by those of its own shape alone, as parsers are slow to fail.
#: Day and month may have one digit or two. {order} takes d and M in the order of the reading.
_COMMON = (
    (rf"^\d{{4}}-\d{{1,2}}-\d{{1,2}}(?:[T ]{_TIME})?$", (f"yyyy-M-d['T'][ ][{_TIME_FORMAT}]",)),
    (rf"^\d{{4}}/\d{{1,2}}/\d{{1,2}}(?: {_TIME})?$", (f"yyyy/M/d[ {_TIME_FORMAT}]",)),
    (rf"^\d{{1,2}}/\d{{1,2}}/\d{{4}}(?: {_TIME})?$", (f"{{order/}}/yyyy[ {_TIME_FORMAT}]",)),
    (rf"^\d{{1,2}}-\d{{1,2}}-\d{{4}}(?: {_TIME})?$", (f"{{order-}}-yyyy[ {_TIME_FORMAT}]",)),
    (r"^\d{8}$", ("yyyyMMdd",)),
    (r"^\d{1,2} (?!(?i:sept) )[A-Za-z]{3,9} \d{4}$", ("d MMM yyyy", "d MMMM yyyy")),
    (r"^\d{1,2}-(?!(?i:sept)-)[A-Za-z]{3,9}-\d{4}$", ("d-MMM-yyyy", "d-MMMM-yyyy")),
    (r"^(?!(?i:sept) )[A-Za-z]{3,9} \d{1,2},? \d{4}$", ("MMM d[,] yyyy", "MMMM d[,] yyyy")),
)
#: Names in other shapes; a clock of 12 hours, with its hours that change and by how much.
_MONTH = "(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
_WEEKDAY = r"(?:(?:mon|tues?|wed(?:nes)?|thu(?:rs?)?|fri|sat(?:ur)?|sun)(?:day)?[.,]* +)?"
_HALF_DAY = r"(?i)\b((?:0?[1-9]|1[0-2]):\d\d(?::\d\d)?) *[ap]\.?m\.?$"
_HALF_DAY_SHIFTS = ((r"(?i)\b(?:0?[1-9]|1[01]):[0-9:]+ *p\.?m\.?$", 12), (r"(?i)\b12:[0-9:]+ *a\.?m\.?$", -12))
_NAMED = rf"(?i)^{_WEEKDAY}(?:\d{{1,2}}(?:st|nd|rd|th)?[ .-]+(?:of +)?|\d{{4}}[ -])?{_MONTH}\b"
#: What makes a date with a named month "d MMM yyyy", step by step.
_NAMED_STEPS = (
    (_HALF_DAY, "$1"), (rf"(?i)^{_WEEKDAY}", ""), (r"(?i)\b(\d{1,2})(?:st|nd|rd|th)\b", "$1"), (rf"(?i)\b{_MONTH}\b\.?", "$1"), (r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*", "$1"),
    (r"(?i)(?:[,.]| of\b| at\b|(?<=[a-z])-|-(?=[a-z])) *", " "), (" +", " "), (r"(?i)^([a-z]{3}) (\d{1,2}) ", "$2 $1 "), (r"(?i)^([a-z]{3} \d{4})$", "1 $1"), (r"(?i)^(\d{4}) ([a-z]{3})[ -](\d{1,2})\b", "$3 $2 $1"),
    (r"(?i)^(\d{1,2} [a-z]{3}) (69|[7-9]\d)(?= |$)", "$1 19$2"), (r"(?i)^(\d{1,2} [a-z]{3}) (\d{2})(?= |$)", "$1 20$2"),
)
_NAMED_FORMAT = f"d MMM yyyy[ {_TIME_FORMAT}]"
#: What makes a date of numbers "yyyy-M-d"; {order} is where month and day stand.
_NUMBERED = r"^(?:\d{1,2}([-/.])\d{1,2}\1(?:\d{4}|\d{2})|\d{4}[-/.]\d{1,2}(?:[-/.]\d{1,2})?|\d{8}T\d{6})(?![0-9.])"
_NUMBERED_STEPS = (
    (_HALF_DAY, "$1"), (r"^(\d{4})(\d\d)(\d\d)T(\d\d)(\d\d)(\d\d)", "$1-$2-$3 $4:$5:$6"), (r"^(\d{1,2})([-/.])(\d{1,2})\2(69|[7-9]\d)(?!\d)", "$1-$3-19$4"), (r"^(\d{1,2})([-/.])(\d{1,2})\2(\d{2})(?!\d)", "$1-$3-20$4"), (r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})", "$3-{order}"),
    (r"^(\d{4})[/.](\d{1,2})[/.](\d{1,2})", "$1-$2-$3"), (r"^(\d{4})/(\d{1,2})$", "$1-$2"), (", *| +at +", " "), (r" *([+-]\d\d):?(\d\d)$(?<=:\d\d[+-]\d\d:?\d\d| [+-]\d\d:?\d\d)", "$1:$2"),
)
#: How every text that reads as a date begins; most texts end their test here.
_DATE_START = r"(?i)^(?:[0-9+-]|(?=[mtwfsjaond])(?:mon|tue|wed|thu|fri|sat|sun|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec))"
#: Where a month can stand in a date of numbers, by order; the parser is spared dates that cannot be of an order, as it is slow to fail.
_MONTH_PLACE = {"Md": r"^(?:0?\d|1[0-2])[-/]", "dM": r"^\d{1,2}[-/](?:0?\d|1[0-2])[-/]"}
#: What else may read as a timestamp, one with a zone above all.
_WIDE = r"^[+-]?\d{1,6}[-/ .T:]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str, spaced: Column | str | None = None) -> Column:
    """Without Unicode space at either end. Only texts that have some there are searched from end to end; spaced: has_outer_space(c), if it is there already."""
    value = _col(c)
    ends = _ends_in_space(value) if spaced is None else _col(spaced)
    return F.when(ends, F.regexp_replace(value, f"^{_SPACE}+|{_SPACE}+$", "")).otherwise(value)


def _ends_in_space(value: Column) -> Column:
    return F.concat(F.substring(value, 1, 1), F.substring(value, -1, 1)).rlike(_SPACE)


def is_blank(c: Column | str) -> Column:
    """Not null, but nothing is left after strip."""
    return F.coalesce(strip(c) == "", F.lit(False))


def has_outer_space(c: Column | str) -> Column:
    return F.coalesce(_ends_in_space(_col(c)), F.lit(False))


# The tests of trimmed text; the public ones trim first.


def _email(value: Column) -> Column:
    return value.rlike(EMAIL)


def _phone(value: Column) -> Column:
    # two patterns: Spark works out what between() compares before it looks at the first
    return value.rlike(PHONE) & value.rlike(PHONE_DIGITS)


def _url(value: Column) -> Column:
    return value.rlike(URL)


def _currency(value: Column) -> Column:
    return value.rlike(CURRENCY) & value.rlike(r"\d")


def _zip(value: Column) -> Column:
    return value.rlike(ZIP)


def _stepped(value: Column, steps: tuple, **names: str) -> Column:
    for pattern, new in steps:
        value = F.regexp_replace(value, pattern, new.format(**names) if "{" in new else new)
    return value


def _reading(value: Column, orders: tuple[str, ...]) -> Column:
    """The timestamp of trimmed text, or null. orders: "Md", "dM" or both, for dates that do not tell day from month."""
    out = F.when(~value.rlike(_DATE_START), F.lit(None).cast("timestamp"))
    parsed = lambda f: F.try_to_timestamp(value, F.lit(f))
    for shape, formats in _COMMON:
        tried = []
        for f in formats:
            for mark in "/-":
                if f"{{order{mark}}}" in f:
                    tried += [F.when(value.rlike(_MONTH_PLACE[o]), parsed(f.replace(f"{{order{mark}}}", mark.join(o)))) for o in orders]
                    break
            else:
                tried.append(parsed(f))
        out = out.when(value.rlike(shape), F.coalesce(*tried))
    # other shapes are first brought to one; a clock of 12 hours is read as it stands and then moved
    hours = F
    for pattern, shift in _HALF_DAY_SHIFTS:
        hours = hours.when(value.rlike(pattern), shift)
    moved = F.make_dt_interval(F.lit(0), hours.otherwise(0))
    out = out.when(value.rlike(_NAMED), F.try_to_timestamp(_stepped(value, _NAMED_STEPS), F.lit(_NAMED_FORMAT)) + moved)
    places = {"Md": "$1-$2", "dM": "$2-$1"}
    out = out.when(value.rlike(_NUMBERED), F.coalesce(*[_stepped(value, _NUMBERED_STEPS, order=places[o]).try_cast("timestamp") for o in orders]) + moved)
    return out.when(value.rlike(_WIDE) & (F.length(value) >= 8), value.try_cast("timestamp"))


def _date(value: Column) -> Column:
    return value.isNotNull() & _reading(value, ("Md", "dM")).isNotNull()


#: Meanings by the pattern of trimmed text, in the order in which they are tried; a date of digits would pass for a phone number.
TRIMMED_TESTS = {"email": _email, "url": _url, "date": _date, "zip": _zip, "phone": _phone, "currency": _currency}


def is_email(c: Column | str) -> Column:
    return _email(strip(c))


def is_phone(c: Column | str) -> Column:
    return _phone(strip(c))


def is_url(c: Column | str) -> Column:
    return _url(strip(c))


def is_currency(c: Column | str) -> Column:
    return _currency(strip(c))


def is_zip(c: Column | str) -> Column:
    return _zip(strip(c))


def is_number(c: Column | str) -> Column:
    return _col(c).rlike(NUMBER)


def is_corrupted(c: Column | str) -> Column:
    """Holds a replacement mark or a control character other than tab and line ends."""
    return F.coalesce(_col(c).rlike(CORRUPTED), F.lit(False))


def is_date(c: Column | str) -> Column:
    """A date or timestamp: numbers of year, month and day in any usual order, with one digit or two, compact (20240105), with a named month, with a
    weekday or an ordinal, a month of a year (its first day); with a time of 24 or 12 hours, or a zone. Years of two digits are 1969 to 2068."""
    return _date(strip(c))


def to_number(c: Column | str) -> Column:
    """The number that a text states, or null; numbers pass."""
    return F.nanvl(_col(c).try_cast("double"), F.lit(None).cast("double"))


def date_reading(c: Column | str, day_first: bool) -> Column:
    """The timestamp of a text under one reading of ambiguous dates; the other one still helps where the first fails."""
    return _reading(strip(c), ("dM", "Md") if day_first else ("Md", "dM"))


def strict_reading(c: Column | str, day_first: bool) -> Column:
    """As date_reading, but without help from the other order; its hits decide which reading a column gets."""
    return _reading(strip(c), ("dM",) if day_first else ("Md",))


def casefold(c: Column | str) -> Column:
    return F.lower(strip(c))


def title_case(c: Column | str) -> Column:
    return F.initcap(strip(c))


def mapped(c: Column | str, names: Mapping[str, str]) -> Column:
    """The mapped name of a value, by casefold; other values stay."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.element_at(table, casefold(c)), _col(c))


def date_text(c: Column | str) -> Column:
    """A timestamp as text; midnight is left out."""
    return F.regexp_replace(F.date_format(_col(c), "yyyy-MM-dd HH:mm:ss"), " 00:00:00$", "")


def kpi_text(value: Column | str, kind: Column | str = "number") -> Column:
    """1,234 for whole numbers, 1,234.50 for others, with a dollar sign if kind is currency."""
    v = _col(value)
    sign = F.when((F.lit(kind) if isinstance(kind, str) else kind) == "currency", "$").otherwise("")
    return F.concat(sign, F.when(v == F.floor(v), F.format_number(v, 0)).otherwise(F.format_number(v, 2)))


def month_of(c: Column | str) -> Column:
    return F.date_format(_col(c), "yyyy-MM")


def business_name(c: Column | str) -> Column:
    return F.initcap(F.replace(_col(c), F.lit("_"), F.lit(" ")))


def is_faithful(stated: Column, decimals: Column, truth: Column) -> Column:
    """The stated number is the truth, rounded to the decimals shown or one more or less; near 0 it must be 0."""
    # a decimal at a time: half a unit of the place, with room for binary fractions
    places = [F.greatest(decimals - 1, F.lit(0)), decimals, decimals + 1]
    at = lambda x, p: F.floor(x * F.pow(F.lit(10.0), p) + 0.5 + 1e-9)
    same = places and (at(stated, places[0]) == at(truth, places[0])) | (at(stated, places[1]) == at(truth, places[1])) | (at(stated, places[2]) == at(truth, places[2]))
    return F.when(F.abs(truth) < 1e-9, F.abs(stated) < 1e-6).otherwise(same)


def stated_numbers(text: Column | str) -> Column:
    """Array of structs (value, decimals) of the numbers written in a text."""
    found = F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(r"-?\d[\d,]*(?:\.\d+)?"), F.lit(0))
    plain = F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")))
    return F.transform(
        plain,
        lambda x: F.struct(
            x.try_cast("double").alias("value"),
            F.when(F.instr(x, ".") > 0, F.length(x) - F.instr(x, ".")).otherwise(0).cast("int").alias("decimals"),
        ),
    )
