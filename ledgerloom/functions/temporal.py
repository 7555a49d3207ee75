"""Instants written as ISO 8601 text, read JVM-side into whole epoch seconds (UTC).

Extended and basic forms, week and ordinal-free calendar dates, any offset, fractions and outer white space are
read; without zone the text is UTC, a date alone is midnight UTC, fractions are cut (rounded down). A text that
cannot be read gives null.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Outer white space as Python's str.strip() sees it.
_WS = r"[\s\x1c-\x1f\x0b\x85   -     　]"
TRIM = rf"^{_WS}+|{_WS}+$"

#: Calendar or week date, then time to the hour, minute or second, fraction and zone as far as they are given.
INSTANT = (
    r"^(\d{4}-\d{2}-\d{2}|\d{8}|\d{4}-?W\d{2}(-?[1-7])?)"
    r"([ -~]\d{2}(:?\d{2}(:?\d{2}([.,]\d+)?)?)?([Zz]|[+-]\d{2}(:?\d{2}(:?\d{2})?)?)?)?$"
)
_USUAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"
#: What turns the time part into THH:mm:ss and a zone of the form +HH:mm, in this order.
_TIME_FORMS = [
    (r"^.(\d{2})(?=$|[Zz+-])", "T$1:00"),
    (r"^.(\d{2}):?(\d{2})(?=$|[Zz+-])", "T$1:$2:00"),
    (r"^.(\d{2}):?(\d{2}):?(\d{2})([.,]\d+)?", "T$1:$2:$3"),
    (r"(:\d{2}[+-]\d{2})$", "$1:00"),
    (r"([+-]\d{2}):?(\d{2})$", "$1:$2"),
    (r"z$", "Z"),
]

NEVER_BEFORE = -(2**62)
NEVER_AFTER = 2**62


def strip(c: Column) -> Column:
    return F.regexp_replace(c, TRIM, "")


def is_blank(c: Column) -> Column:
    """Null, empty or nothing but white space."""
    return c.isNull() | (strip(c) == "")


def _week_date(s: Column) -> Column:
    """yyyy-MM-dd of an ISO week date at the start of s; null where that year has no such week."""
    year = F.substring(s, 1, 4)
    week = F.regexp_extract(s, r"^\d{4}-?W(\d{2})", 1).cast("int")
    day = F.coalesce(F.regexp_extract(s, r"^\d{4}-?W\d{2}-?([1-7])", 1).try_cast("int"), F.lit(1))
    monday = F.date_trunc("week", F.concat(year, F.lit("-01-04")).try_cast("date")).cast("date")
    last = F.weekofyear(F.concat(year, F.lit("-12-28")).try_cast("date"))
    return F.when((week >= 1) & (week <= last), F.date_add(monday, (week - 1) * 7 + day - 1).cast("string"))


def _canonical(s: Column) -> Column:
    date = F.when(s.rlike(r"^\d{4}-?W"), _week_date(s)).otherwise(F.regexp_replace(F.regexp_extract(s, r"^(\d{4}-\d{2}-\d{2}|\d{8})", 1), r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"))
    time = F.regexp_replace(s, r"^(\d{4}-\d{2}-\d{2}|\d{8}|\d{4}-?W\d{2}(-?[1-7])?)", "")
    for pattern, form in _TIME_FORMS:
        time = F.regexp_replace(time, pattern, form)
    return F.concat(date, F.when(time == "", "T00:00:00").otherwise(time))


def epoch_seconds(c: Column) -> Column:
    """Whole seconds since 1970 UTC, null where the text is null or cannot be read.

    The usual form yyyy-MM-ddTHH:mm:ssZ is cast as it stands; the others are brought to it first. Offsets reach 18
    hours. The session's time zone must be UTC.
    """
    def read(s: Column) -> Column:
        text = F.when(s.rlike(_USUAL), s).when(s.rlike(INSTANT), _canonical(s))
        return F.unix_seconds(F.when(~s.startswith("0000"), text).try_cast("timestamp"))

    # a lambda's argument is evaluated once, and its body is no part of the generated code, which it would swell
    return F.element_at(F.transform(F.array(strip(c)), read), 1)


def instant_text(seconds: Column) -> Column:
    """Epoch seconds as yyyy-MM-ddTHH:mm:ssZ."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def month_text(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM")


def contains_instant(start: Column, end: Column, at: Column) -> Column:
    """Half-open containment; a null bound is open."""
    return (start.isNull() | (start <= at)) & (end.isNull() | (at < end))


def overlaps(ls: Column, le: Column, rs: Column, re: Column) -> Column:
    """Half-open overlap; a null bound is open."""
    return (ls.isNull() | re.isNull() | (ls < re)) & (rs.isNull() | le.isNull() | (rs < le))


def reference_key(c: Column) -> Column:
    """An id as references compare it: trimmed and lower-cased, null when blank."""
    k = F.lower(strip(c))
    return F.when(k != "", k)
