"""Dates of listings and births.

A birth date is an interval (from, to, precision, approximate) with ISO strings, both ends in it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names, and the words and signs of published dates.
MONTHS = ("JANUARY", "FEBRUARY", "MARCH", "APRIL", "MAY", "JUNE", "JULY", "AUGUST", "SEPTEMBER", "OCTOBER", "NOVEMBER", "DECEMBER")
QUALIFIER = r"(?i)\b(approx\.?|approximately|circa|ca\.|c\.)\s*"
EXPLICIT_RANGE = r"(?i)\(\s*range\s+(\d{4}-\d{2}-\d{2})\s*[–—-]\s*(\d{4}-\d{2}-\d{2})\s*\)"
RANGE = r"(?i)\s+to\s+|\s*[–—]\s*"
#: Forms of a single date and the places of year, month and day in them (0: not stated); slashed dates are day first.
FORMS = (
    (r"^(\d{4})-(\d{1,2})-(\d{1,2})$", (1, 2, 3)),
    (r"^(\d{4})-(\d{1,2})$", (1, 2, 0)),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4})$", (3, 2, 1)),
    (r"^(\d{1,2})\s+([A-Za-z]+)\.?\s+(\d{4})$", (3, 2, 1)),
    (r"^([A-Za-z]+)\.?\s+(\d{4})$", (2, 1, 0)),
    (r"^(\d{4})$", (1, 0, 0)),
)
SPACE = r"(?U)\s+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _month_number(name: Column) -> Column:
    """1 to 12 of a number or a name, full or short; null if it is neither."""
    forms = {form: i for i, m in enumerate(MONTHS, 1) for form in (m, m[:3])} | {"SEPT": 9}
    known = F.map_from_arrays(F.array(*map(F.lit, forms)), F.array(*map(F.lit, forms.values())))
    return F.coalesce(name.try_cast("int"), F.try_element_at(known, F.upper(name)))


def _span(y: Column, m: Column, d: Column) -> Column:
    """The narrowest of day, month and year that the calendar has, for years from 1000 to 2999; else null."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    made = lambda day: F.try_to_date(F.concat_ws("-", y.cast("string"), two(m), day), "yyyy-MM-dd")
    interval = lambda a, b, how: F.struct(a.cast("string").alias("from"), b.cast("string").alias("to"), F.lit(how).alias("precision"))
    whole = F.when(y.between(1000, 2999), interval(F.concat(y.cast("string"), F.lit("-01-01")), F.concat(y.cast("string"), F.lit("-12-31")), "year"))
    month = lambda first: F.when(first.isNotNull() & y.between(1000, 2999), interval(first, F.last_day(first), "month")).otherwise(whole)
    day = F.when((m > 0) & (d > 0), made(two(d)))
    return let(day, lambda one: F.when(one.isNotNull() & y.between(1000, 2999), interval(one, one, "day")).otherwise(let(F.when(m.between(1, 12), made(F.lit("01"))), month)))


def parse_single(raw: Column) -> Column:
    """struct(from, to, precision) of one date without range or qualifier, or null; 00 is an unknown part."""

    def read(s: Column) -> Column:
        parts = None
        for form, places in FORMS:
            found = [F.regexp_extract(s, form, k) if k else F.lit("0") for k in places]
            here = F.array(*found)
            parts = F.when(s.rlike(form), here) if parts is None else parts.when(s.rlike(form), here)
        return let(parts, lambda p: let(_month_number(p[1]), lambda m: F.when(p.isNotNull() & m.isNotNull(), _span(p[0].try_cast("int"), m, p[2].try_cast("int")))))

    return let(F.trim(raw), read)


def parse_date_value(raw: Column) -> Column:
    """struct(from, to, precision, approximate) that a published date states, or null; an explicit range wins as it stands."""

    def pair(parts: Column) -> Column:
        lower = lambda x, y: F.when(x["from"] <= y["from"], F.struct(x["from"].alias("from"), y["to"].alias("to"), F.lit("range").alias("precision"))).otherwise(F.struct(y["from"].alias("from"), x["to"].alias("to"), F.lit("range").alias("precision")))
        ends = F.transform(parts, parse_single)
        return let(ends, lambda e: F.when(e[0].isNotNull() & e[1].isNotNull(), lower(e[0], e[1])).otherwise(F.coalesce(e[0], e[1])))

    def bare(s: Column) -> Column:
        parts = F.filter(F.transform(F.split(s, RANGE), lambda x: F.trim(x)), lambda x: x != "")
        return let(parts, lambda p: F.when(F.size(p) == 2, pair(p)).otherwise(parse_single(s)))

    def stated(s: Column) -> Column:
        explicit = F.struct(F.regexp_extract(s, EXPLICIT_RANGE, 1).alias("from"), F.regexp_extract(s, EXPLICIT_RANGE, 2).alias("to"), F.lit("range").alias("precision"))
        return F.when(s.rlike(EXPLICIT_RANGE), explicit).otherwise(let(F.trim(F.regexp_replace(s, r"\s*\([^)]*\)\s*$", "")), bare))

    def read(s: Column) -> Column:
        found = let(F.trim(F.regexp_replace(s, QUALIFIER, "")), stated)
        return let(found, lambda x: F.when(x.isNotNull(), F.struct(x["from"].alias("from"), x["to"].alias("to"), x["precision"].alias("precision"), s.rlike(QUALIFIER).alias("approximate"))))

    return let(F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), SPACE, " ")), read)


def parse_date_values(raw: Column) -> Column:
    """The intervals of an array's values, without those that state none."""
    return F.filter(F.transform(F.coalesce(raw, F.array().cast("array<string>")), parse_date_value), lambda x: x.isNotNull())


def covers_year(interval: Column, year: Column) -> Column:
    return F.coalesce((F.substring(interval["from"], 1, 4) <= year) & (year <= F.substring(interval["to"], 1, 4)), F.lit(False))


def normalize_date(raw: Column) -> Column:
    """ISO prefix or D/M/YYYY as a date, null if the calendar has no such day."""
    s = F.trim(F.coalesce(raw, F.lit("")))
    iso, slash = r"^(\d{4}-\d{2}-\d{2})", r"^(\d{1,2})/(\d{1,2})/(\d{4})"
    made = F.concat_ws("-", F.regexp_extract(s, slash, 3), F.lpad(F.regexp_extract(s, slash, 2), 2, "0"), F.lpad(F.regexp_extract(s, slash, 1), 2, "0"))
    return F.when(s.rlike(iso), F.try_to_date(F.regexp_extract(s, iso, 1), "yyyy-MM-dd")).when(s.rlike(slash), F.try_to_date(made, "yyyy-MM-dd"))


def short_date(raw: Column) -> Column:
    """'05 Mar 1990', or the raw text where it isn't a date."""
    return F.coalesce(F.date_format(normalize_date(raw), "dd MMM yyyy"), raw)


def age_text(hours: Column) -> Column:
    """How long ago, in words."""
    return (
        F.when(hours < 1, "just now")
        .when(hours < 24, F.concat(F.floor(hours).cast("string"), F.lit(" h ago")))
        .otherwise(F.concat(F.floor(hours / 24).cast("string"), F.lit(" d ago")))
    )
