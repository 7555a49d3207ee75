"""Checks before a write, in place of constraints and triggers: rows that break a rule come out as issues."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F


@dataclass(frozen=True)
class Rule:
    """A code and the SQL condition under which a row breaks it."""

    code: str
    broken_if: str


def broken_rows(df: DataFrame, key: str, rules: list[Rule]) -> DataFrame:
    """code, key: one row per broken rule, in one scan. A condition that is null is not broken."""
    codes = F.array_compact(F.array(*[F.when(F.expr(r.broken_if), F.lit(r.code)) for r in rules]))
    return df.select(F.explode(codes).alias("code"), F.col(key).cast("string").alias("key"))


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def foreign_key_issues(child: DataFrame, child_key: str, column: F.Column, parent: DataFrame, parent_column: F.Column, code: str) -> DataFrame:
    """code, key: rows whose non-null reference has no parent (anti join on ids alone)."""
    c = child.select(F.col(child_key).cast("string").alias("key"), column.alias("ref")).where("ref is not null").distinct()
    p = parent.select(parent_column.alias("ref")).where("ref is not null").distinct()
    return c.join(p, "ref", "left_anti").select(F.lit(code).alias("code"), "key")


def split_quarantine(df: DataFrame, key: str, bad: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, quarantined): df parted by the keys of `bad`."""
    keys = bad.select(F.col("key").alias(key)).distinct()
    return df.join(keys, key, "left_anti"), df.join(keys, key, "left_semi")


def schema_fingerprint(df: DataFrame) -> str:
    """A digest of names and types, independent of column order and nullability."""
    import hashlib

    return hashlib.sha256("\n".join(sorted(f"{n} {t}" for n, t in df.dtypes)).encode()).hexdigest()


#: What a claim needs before it may be proposed; intervals are told by report.interval_issues.
CLAIM_SHAPE = [
    Rule("PERSONA_REQUIRED", "persona_id is null or trim(persona_id) = ''"),
    Rule("CONTINUITY_REQUIRED", "continuity is null or trim(continuity) = ''"),
    Rule("TEXT_REQUIRED", "text is null or trim(text) = ''"),
    Rule("CONFIDENCE_RANGE", "not coalesce(confidence between 0 and 1, false)"),
]

#: The fields that a payload from outside may fill; fixed values.
PAYLOAD_FIELDS = "persona_id continuity text subject predicate object_value valid_from valid_to knowledge_from knowledge_to access_policy confidence rationale".split()


def payload_rows(df: DataFrame, key: str, payload: str, constants: dict[str, str]) -> DataFrame:
    """key and the allowed fields of a JSON payload; all others, those of authority among them, are dropped.

    constants: columns that the caller sets (a status, who proposed). A payload that is no JSON object has nulls.
    """
    kinds = ", ".join(f"{f} {'double' if f == 'confidence' else 'string'}" for f in PAYLOAD_FIELDS)
    return df.select(key, F.from_json(F.col(payload), kinds).alias("p")).select(key, "p.*", *[F.lit(v).alias(c) for c, v in constants.items()])


def outside(rows: DataFrame, allowed: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct keys of rows that are not among the allowed ones (empty: rows keep to their scope)."""
    return rows.select(*keys).distinct().join(allowed.select(*keys).distinct(), keys, "left_anti")


def over_ceilings(tables: dict[str, DataFrame], most: int, total: int) -> DataFrame:
    """table_name, n of tables with more than `most` rows, and of '' (all together) with more than `total`."""
    from functools import reduce

    counts = reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n") for t, df in tables.items()])
    return counts.where(F.col("n") > most).unionByName(counts.agg(F.sum("n").alias("n")).select(F.lit("").alias("table_name"), "n").where(F.col("n") > total))
