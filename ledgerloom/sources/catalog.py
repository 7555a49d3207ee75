"""What tables there are, of which layout, and whether two sets of them are equal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerloom.functions.temporal import is_blank

# Columns of the project's tables and of the first layout; fixed values.
COLUMNS = {
    "schema_metadata": "singleton schema_version migrated_at migration_notes",
    "sources": "source_id source_key continuity created_at updated_at",
    "source_snapshots": "snapshot_id source_id version content_hash content media_type origin_path previous_snapshot_id line_count created_at",
    "claim_proposals": "claim_id persona_id continuity text subject predicate object_value valid_from valid_to knowledge_from knowledge_to access_policy confidence status proposed_by proposal_model rationale created_at updated_at",
    "evidence_refs": "evidence_id claim_id snapshot_id start_line end_line start_char end_char quote content_hash created_at",
    "governance_decisions": "decision_id claim_id from_status to_status reviewer reason decided_at",
    "narrative_events": "event_id persona_id continuity event_type title summary details_json valid_from valid_to knowledge_from knowledge_to access_policy created_at",
    "event_evidence_refs": "evidence_id event_id snapshot_id start_line end_line start_char end_char quote content_hash created_at",
    "event_ledger": "sequence entry_id event_type aggregate_type aggregate_id payload_json previous_hash entry_hash created_at",
    "legacy_records": "legacy_record_id original_table legacy_key payload_json migrated_entity_type migrated_entity_id migrated_at",
}
#: Bytes of a text that reports show, and its unsafe characters (C0, C1 and bidirectional marks); fixed values.
MAX_METADATA_BYTES = 1_024
METADATA_UNSAFE = "[\\x00-\\x1f\\x7f-\\x9f\\u061c\\u200e\\u200f\\u202a-\\u202e\\u2066-\\u2069]"


def columns(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, column_name, type, position of every table."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(t, c, kind, i) for t, df in tables.items() for i, (c, kind) in enumerate(df.dtypes, 1)]
    return spark.createDataFrame(rows, "table_name string, column_name string, type string, position int")


def layout(tables: dict[str, list[str]]) -> str:
    """EMPTY, CURRENT (all tables, exact columns), READABLE (no events yet), FIRST (the two oldest tables), PARTIAL (some
    tables of the project, or other columns) or UNKNOWN."""
    if not tables:
        return "EMPTY"
    exact = {t for t, c in tables.items() if t in COLUMNS and set(c) == set(COLUMNS[t].split())}
    if exact == set(COLUMNS) == set(tables):
        return "CURRENT"
    if exact == set(tables) and set(COLUMNS) - set(tables) <= {"event_evidence_refs", "narrative_events", "schema_metadata"}:
        return "READABLE"
    if set(tables) == {"source_snapshots", "claims"} and len(tables["source_snapshots"]) == 6 and len(tables["claims"]) == 17:
        return "FIRST"
    return "PARTIAL" if set(tables) & set(COLUMNS) else "UNKNOWN"


def open_tables(spark: SparkSession, folder: str, names: list[str], expected: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """The named tables of a folder; one that lacks a column of `expected` (by default COLUMNS) fails."""
    expected = COLUMNS if expected is None else expected
    out = {}
    for n in names:
        df = spark.read.parquet(f"{folder}/{n}.parquet")
        if missing := set(expected.get(n, "").split()) - set(df.columns):
            raise ValueError(f"table {n} has no columns {sorted(missing)}")
        out[n] = df
    return out


def row_text(df: DataFrame) -> Column:
    """All columns of a row in one text in which no two different rows of texts and numbers look alike."""
    part = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    return F.concat_ws(",", *[part(c) for c in sorted(df.columns)])


def table_digests(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, n, digest: equal for tables of the same rows in any order (a sum over row digests; not for security)."""
    def one(name: str, df: DataFrame) -> DataFrame:
        word = F.conv(F.substring(F.sha2(row_text(df), 256), 1, 12), 16, 10).cast("decimal(38,0)")
        return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(word), F.lit(0)).cast("string").alias("digest")).select(F.lit(name).alias("table_name"), "n", "digest")

    return reduce(DataFrame.unionByName, [one(n, df) for n, df in tables.items()])


def verified_copy(df: DataFrame, path: str) -> None:
    """df written to a new path and read again; a copy that differs fails (an existing path is refused)."""
    df.write.mode("error").parquet(path)
    again = df.sparkSession.read.parquet(path)
    a, b = (table_digests({"t": x}).first() for x in (df, again))
    if a != b:
        raise OSError(f"the copy at {path} differs: {a.n} and {b.n} rows")


def redacted(c: Column) -> Column:
    """What a report may say of a text it must not show: type, length and digest; null for null."""
    return F.when(c.isNotNull(), F.struct(F.lit("str").alias("type"), F.length(c).cast("bigint").alias("length"), F.sha2(c, 256).alias("sha256")))


def shown(c: Column, most: int = 256) -> Column:
    """A text as it is when it is short, no path and free of control characters; else null (see redacted)."""
    return F.when((F.length(c) <= most) & ~c.startswith("/") & ~c.rlike(METADATA_UNSAFE), c)


def metadata_problem(c: Column, most: int = MAX_METADATA_BYTES) -> Column:
    """Why a text may not stand in a report; null when it may."""
    return (
        F.when(c.isNull() | (c == ""), "REPORT_METADATA_INVALID")
        .when(~F.is_valid_utf8(c), "REPORT_METADATA_INVALID_UNICODE")
        .when(F.octet_length(c) > most, "REPORT_METADATA_BYTES_LIMIT_EXCEEDED")
        .when(c.rlike(METADATA_UNSAFE), "REPORT_METADATA_CONTROL_CHARACTER")
    )


#: Limits in UTF-8 bytes; fixed values.
CLAIM_LIMITS = {"text": 262_144, "rationale": 262_144, "subject": 4_096, "predicate": 4_096, "object_value": 4_096, "proposed_by": 4_096, "proposal_model": 4_096}
EVENT_LIMITS = {"title": 16_384, "summary": 262_144, "details_json": 1_048_576}


def over_limits(df: DataFrame, key: str, limits: dict[str, int]) -> DataFrame:
    """key, field, bytes of every field that is over its limit."""
    over = F.array_compact(F.array(*[F.when(F.octet_length(f) > n, F.struct(F.lit(f).alias("field"), F.octet_length(f).cast("bigint").alias("bytes"))) for f, n in limits.items()]))
    return df.select(F.col(key).cast("string").alias("key"), F.inline(over))


def proposal_text(text: Column, subject: Column, predicate: Column, object_value: Column) -> Column:
    """A claim's text; where it is blank, its subject, predicate and object in one line."""
    return F.when(is_blank(text), F.concat_ws(" ", subject, predicate, object_value)).otherwise(text)
