"""Values of cells as Column expressions: numbers, dates, durations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import MONTH_WORD, NUMBER_INSIDE

# Month names by their first three letters.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def clean_number(raw: Column) -> Column:
    """Text of a number without blanks, percent sign and thousands commas."""
    return F.regexp_replace(F.regexp_replace(raw, r"^[ %]+|[ %]+$", ""), "[, ]", "")


def parse_number(raw: Column) -> Column:
    """The number of a cell; a percentage is not divided by 100."""
    return clean_number(raw).try_cast("double")


def parse_numbers(raw: Column) -> Column:
    """All numbers inside a text, in order."""
    return F.transform(F.regexp_extract_all(raw, F.lit(NUMBER_INSIDE), F.lit(0)), parse_number)


def number_count(raw: Column) -> Column:
    return F.regexp_count(raw, F.lit(NUMBER_INSIDE))


_MON = r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"
_TIME = r"(?: (\d{1,2}):(\d{2})(?::(\d{2})(?:\.\d+)?)? ?(am|pm)?)?"
# Date notations, tried in this order, and where year, month and day stand in them. ``?`` marks numbers
# with the month first (the day first only when the first number cannot be a month).
DATE_FORMS = [
    (rf"^{_MON} (\d{{1,2}})(?: (\d{{4}}|\d{{2}}))?{_TIME}$", "$3|$1|$2|$4|$5|$6|$7|"),
    (rf"^(\d{{1,2}}) {_MON}(?: (\d{{4}}|\d{{2}}))?{_TIME}$", "$3|$2|$1|$4|$5|$6|$7|"),
    (rf"^{_MON} (\d{{4}}){_TIME}$", "$2|$1||$3|$4|$5|$6|"),
    (rf"^(\d{{4}}) {_MON} (\d{{1,2}}){_TIME}$", "$1|$2|$3|$4|$5|$6|$7|"),
    (rf"^(\d{{4}}) {_MON}{_TIME}$", "$1|$2||$3|$4|$5|$6|"),
    (rf"^{_MON}{_TIME}$", "|$1||$2|$3|$4|$5|"),
    (rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}}){_TIME}$", "$1|$2|$3|$4|$5|$6|$7|"),
    (rf"^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}}|\d{{2}}){_TIME}$", "$3|$1|$2|$4|$5|$6|$7|?"),
]
_INSIDE = (
    rf"(?:\d{{4}} )?{_MON} \d{{1,2}}(?: \d{{4}})?|\d{{1,2}} {_MON}(?: \d{{4}})?|{_MON}(?: \d{{4}})?|\d{{4}}[-/.]\d{{1,2}}[-/.]\d{{1,2}}"
    r"|\d{1,2}[-/.]\d{1,2}[-/.]\d{4}"
)


NUMERIC_DATE = r"\d\s*[-/.]\s*\d+\s*[-/.]\s*\d"


def may_be_date(raw: Column) -> Column:
    """Cheap test that spares most cells the date notations."""
    return raw.rlike(MONTH_WORD) | raw.rlike(NUMERIC_DATE)


def _normal_date(raw: Column) -> Column:
    text = F.lower(raw)
    text = F.regexp_replace(text, r"\b(mon|tues?|wed(nes)?|thu(rs)?|fri|sat(ur)?|sun)(day)?\b", " ")
    text = F.regexp_replace(text, r"(\d)(st|nd|rd|th)\b", "$1")
    text = F.regexp_replace(text, r"([a-z])\.", "$1 ")
    text = F.regexp_replace(text, r"(\d)t(\d)", "$1 $2")
    text = F.regexp_replace(text, r"[,]|\bof\b|\bat\b", " ")
    text = F.regexp_replace(text, r"\s*([-/.])\s*", "$1")
    text = F.regexp_replace(text, r"(?<=[a-z])[-/]|[-/](?=[a-z])", " ")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named there.

    Steps inside stay out of the generated code, whose methods would grow beyond what the JVM compiles.
    """
    return F.transform(F.array(value), use)[0]


def _whole_date(text: Column, base: str) -> Column:
    """The timestamp that a normalised text is."""
    base_year, _, base_day = base.split("-")
    forms = F.coalesce(*[F.when(text.rlike(p), F.regexp_replace(text, p, order)) for p, order in DATE_FORMS])
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")

    def numbers(parts: Column) -> Column:
        # only written numbers are cast: a failing cast is an exception, which is slow
        number = lambda i: F.when(parts[i] != "", parts[i].cast("int"))
        month_name = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), parts[1]).cast("int")
        month, hour = F.when(month_name > 0, month_name).otherwise(number(1)), F.coalesce(number(3), F.lit(0))
        year, swap = F.coalesce(number(0), F.lit(int(base_year))), (parts[7] == "?") & (month > 12)
        return F.struct(
            F.when(F.length(parts[0]) != 2, year).when(year < 69, year + 2000).otherwise(year + 1900).alias("y"),
            F.when(swap, number(2)).otherwise(month).alias("m"), F.when(swap, month).otherwise(number(2)).alias("d"),
            F.when((parts[6] == "pm") & (hour < 12), hour + 12).when((parts[6] == "am") & (hour == 12), 0).otherwise(hour).alias("h"),
            F.coalesce(number(4), F.lit(0)).alias("min"), F.coalesce(number(5), F.lit(0)).alias("s"))

    def stamp(x: Column) -> Column:
        start = F.concat_ws("-", pad(x["y"], 4), pad(x["m"], 2), F.lit("01")).try_cast("date")
        day = F.coalesce(x["d"], F.least(F.lit(int(base_day)), F.dayofmonth(F.last_day(start))))
        date = F.concat(pad(x["y"], 4), F.lit("-"), pad(x["m"], 2), F.lit("-"), pad(day, 2), F.lit(" "))
        clock = F.concat(pad(x["h"], 2), F.lit(":"), pad(x["min"], 2), F.lit(":"), pad(x["s"], 2))
        return F.concat(date, clock).try_cast("timestamp_ntz")

    return _let(forms, lambda f: F.when(f.isNotNull(), _let(F.split(f, r"\|", -1), lambda p: _let(numbers(p), stamp))))


def _dates(raw: Column, base: str, maybe: Column, month: Column) -> Column:
    """(whole, inside) of a cell; null without a look where it cannot be a date."""
    def both(text: Column) -> Column:
        found = F.regexp_extract(text, rf"\b({_INSIDE})\b", 1)
        inside = lambda whole: F.when(whole.isNull() & month, _let(found, lambda f: _whole_date(f, base)))
        return _let(_whole_date(text, base), lambda whole: F.struct(whole.alias("whole"), inside(whole).alias("inside")))

    return F.when(maybe & raw.isNotNull(), _let(_normal_date(raw), both))


def add_dates(
    df: DataFrame, raw: Column, whole: str, inside: str, base: str,
    maybe: Column | None = None, month: Column | None = None,
) -> DataFrame:
    """Add ``whole``, the date a cell is, and ``inside``, the first date in a cell that is none but
    names a month. Dates need a month; a missing year or day comes from ``base`` (yyyy-mm-dd).
    ``maybe`` (cells worth a look) and ``month`` (cells that name one) may be given when known."""
    dates = _dates(raw, base, may_be_date(raw) if maybe is None else maybe, raw.rlike(MONTH_WORD) if month is None else month)
    # A filter on a date must not be pushed below, which would look for it twice: it stops at the generator of this one-row array.
    found = df.select("*", F.explode(F.array(dates)).alias("__dates"))
    return found.select(*df.columns, F.col("__dates.whole").alias(whole), F.col("__dates.inside").alias(inside))


def parse_dates(df: DataFrame, raw: Column, out: str, base: str) -> DataFrame:
    """Add ``out``: the date of a cell, else the first date inside it. Without use of it no date is looked for."""
    dates = _dates(raw, base, may_be_date(raw), raw.rlike(MONTH_WORD))
    return df.withColumn(out, _let(dates, lambda x: F.coalesce(x["whole"], x["inside"])))


_CLOCK = r"^\s*([+-])?\s*(?:(?:(?:(\d+):)?(\d+):)?(\d{1,2}))?:(\d{2}(?:\.\d+)?)\s*$"
_UNITS = (
    r"(?i)^\s*([+-])?\s*(?:(\d+)\s*(?:weeks?|wks?|w)\s*(?:[,/]\s*)?)?(?:(\d+)\s*(?:days?|dys?|d)\s*(?:[,/]\s*)?)?"
    r"(?:(\d+)\s*(?:hours?|hrs?|h)\s*(?:[,/]\s*)?)?(?:(\d+)\s*(?:minutes?|mins?|m)\s*(?:[,/]\s*)?)?"
    r"(?:(\d+(?:\.\d+)?)\s*(?:seconds?|secs?|s))?\s*$"
)


_CLOCK_CELL = r"^\s*[+-]?\s*(?:\d{1,2}|\d+:\d{2}|\d+:\d{2}:\d{2})?:\d{2}(?:\.\d+)?\s*$"


def is_duration(raw: Column) -> Column:
    return raw.rlike(_CLOCK_CELL) | (raw.rlike(r"\d") & raw.rlike(_UNITS))


def _weighted(raw: Column, pattern: str, weights: list[int]) -> Column:
    """Sum of the numbers a pattern finds, each in seconds; group 1 is the sign."""
    groups = F.transform(
        F.array(*[F.regexp_extract(raw, pattern, i + 2) for i in range(len(weights))]),
        lambda g: F.when(g != "", g.cast("double")).otherwise(0.0),
    )
    seconds = F.zip_with(groups, F.array(*[F.lit(float(w)) for w in weights]), lambda g, w: g * w)
    sign = F.when(F.regexp_extract(raw, pattern, 1) == "-", -1.0).otherwise(1.0)
    return sign * F.aggregate(seconds, F.lit(0.0), lambda a, x: a + x)


def parse_duration(raw: Column) -> Column:
    """Seconds of a duration: ``33:45``, ``1:02:03.5``, ``2h 30m``; null when it is none."""
    return (
        F.when(raw.rlike(_CLOCK_CELL), _weighted(raw, _CLOCK, [86400, 3600, 60, 1]))
        .when(raw.rlike(r"\d") & raw.rlike(_UNITS), _weighted(raw, _UNITS, [604800, 86400, 3600, 60, 1]))
    )


def parse_seconds(raw: Column) -> Column:
    """A duration, else plain seconds."""
    return F.coalesce(parse_duration(raw), F.trim(raw).try_cast("double"))
