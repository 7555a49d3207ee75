"""Canonical JSON and digests of rows and sets of rows."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def canonical_number(x: pd.Series) -> pd.Series:
    """A double as canonical JSON writes it (shortest form, -0.0 as 0.0); JVM and Python print doubles differently."""
    return x.map(lambda v: None if pd.isna(v) else json.dumps(0.0 if v == 0 else float(v), allow_nan=False))


def _quoted(c: Column) -> Column:
    """A string as JSON: control characters in lower-case escapes, other characters as they are."""
    text = F.get_json_object(F.to_json(F.struct(c.alias("x"))), "$.x")  # validates nothing, keeps nulls
    esc = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for code, short in ((8, "\\b"), (9, "\\t"), (10, "\\n"), (12, "\\f"), (13, "\\r")):
        esc = F.replace(esc, F.lit(chr(code)), F.lit(short))
    for code in [*range(8), 11, *range(14, 32)]:
        esc = F.replace(esc, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return F.concat(F.lit('"'), esc, F.lit('"'))


def canonical_json(df: DataFrame, fields: list[str]) -> Column:
    """The fields of a row as JSON with sorted names, no blanks, nulls kept."""
    types = dict(df.dtypes)
    parts = []
    for f in sorted(fields):
        c = F.col(f)
        value = canonical_number(c) if types[f] in ("double", "float") else c.cast("string") if types[f] in ("bigint", "int", "boolean") else _quoted(c)
        parts.append(F.concat(F.lit(f'"{f}":'), F.coalesce(value, F.lit("null"))))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def row_digests(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, digest: SHA-256 of each row's canonical JSON."""
    return df.select(key, F.sha2(canonical_json(df, fields), 256).alias("digest"))


#: Rows of one owner whose digests are gathered (64 MB of digests); more fail.
MAX_SET_ROWS = 1_000_000


def set_digests(df: DataFrame, owner: str, fields: list[str], max_rows: int = MAX_SET_ROWS) -> DataFrame:
    """owner, n, digest: digest of each owner's set of rows, whatever their order, repeats kept.

    Rows are digested first and only digests are gathered. They are counted before (combined before the shuffle), and
    an owner with more than max_rows fails the call.
    """
    if df.groupBy(owner).agg(F.count("*").alias("n")).where(F.col("n") > max_rows).limit(1).count():
        raise ValueError(f"more than {max_rows} rows of one owner")
    rows = df.select(owner, F.sha2(canonical_json(df, fields), 256).alias("d"))
    return rows.groupBy(owner).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list("d")), "\n"), 256).alias("digest"))
