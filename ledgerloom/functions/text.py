"""Line model, quotes and digests as JVM column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Line ends of the source model; CRLF counts once.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def source_lines(content: Column) -> Column:
    """Lines without their ends; no extra line after a final separator, none for an empty text."""
    parts = F.split(content, LINE_END, -1)
    n = F.size(parts)
    return F.when(content.isNull(), F.lit(None).cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, 1, n - 1)).otherwise(parts)


def line_count(content: Column) -> Column:
    return F.when(content.isNull(), F.lit(None).cast("bigint")).otherwise(F.size(source_lines(content)).cast("bigint"))


def line_quote(lines: Column, start: Column, end: Column) -> Column:
    """Lines start..end (1-based, inclusive) joined by LF; null when the range does not lie within the lines."""
    ok = (start >= 1) & (end >= start) & (end <= F.size(lines))
    return F.when(ok, F.array_join(F.slice(lines, F.when(ok, start).otherwise(1).cast("int"), F.when(ok, end - start + 1).otherwise(0).cast("int")), "\n"))


def lf(quote: Column) -> Column:
    return F.regexp_replace(quote, r"\r\n?", "\n")


def quote_sha256(quote: Column) -> Column:
    return F.sha2(lf(quote), 256)


def plain_digest(c: Column) -> Column:
    """A SHA-256 in any accepted spelling as 64 lower-case hex digits, else null."""
    d = F.regexp_replace(F.lower(F.trim(c)), "^sha256:", "")
    return F.when(d.rlike("^[0-9a-f]{64}$"), d)


def stable_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 24))
