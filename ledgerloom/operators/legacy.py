"""Older tables brought to the present ones: aliases, clamps, stable ids, and rows set aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions.temporal import epoch_seconds, instant_text, strip
from ledgerloom.functions.text import stable_id
from ledgerloom.operators.ordered import with_previous
from ledgerloom.operators.revisions import allocate


# Older words of statuses and access policies; fixed values. Present words stand for themselves.
STATUS = {"AUTHORIZED": "AUTHORIZED", "REJECTED": "REJECTED", "PROPOSED": "PROPOSED", "DISPUTED": "DISPUTED", "ACCEPTED": "AUTHORIZED", "APPROVED": "AUTHORIZED", "ACTIVE": "AUTHORIZED", "DENIED": "REJECTED", "INVALID": "REJECTED", "PENDING": "PROPOSED", "CONFLICTED": "DISPUTED"}
ACCESS = {"AGENT_ACCESSIBLE": "agent_accessible", "HUMAN_ONLY": "human_only", "HIDDEN": "hidden", "AGENT": "agent_accessible", "ACCESSIBLE": "agent_accessible", "PUBLIC": "agent_accessible", "HUMAN": "human_only", "PRIVATE": "human_only", "NONE": "hidden"}


def first_filled(*columns: Column) -> Column:
    """The first column that is neither null nor blank."""
    return F.coalesce(*[F.when(strip(c) != "", c) for c in columns])


def enum_key(c: Column) -> Column:
    """An enumeration's name or value in one spelling: upper case, hyphens and blanks as underscores."""
    return F.regexp_replace(F.upper(F.trim(c)), "[- ]", "_")


def mapped(c: Column, table: dict[str, str], otherwise: str, blank: str) -> Column:
    """c looked up by its enum_key; unknown spellings and blanks get their own values."""
    k = enum_key(c)
    out = F.when(c.isNull() | (F.trim(c) == ""), F.lit(blank))
    for name, value in table.items():
        out = out.when(k == name, F.lit(value))
    return out.otherwise(F.lit(otherwise))


def unit_interval(c: Column, default: float = 1.0) -> Column:
    """A number within 0..1, clamped; the default where it is missing or cannot be read."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c.try_cast("double"), F.lit(default))))


def converted_snapshots(rows: DataFrame, key: str, continuity: str, order: str, id_col: str, text: str) -> DataFrame:
    """source_id, snapshot_id, version, previous_snapshot_id, content_hash: older single texts as revisions of sources.

    Ids are digests of what identifies a row, so a second conversion gives the same ids.
    """
    r = allocate(rows, [key, continuity], order, id_col, text)
    source = stable_id("src", F.col(key), F.col(continuity))
    snapshot = lambda c: F.when(c.isNotNull(), stable_id("snp", F.col(key), F.col(continuity), c.cast("string")))
    return r.select(source.alias("source_id"), snapshot(F.col("id")).alias("snapshot_id"), "version", snapshot(F.col("previous_id")).alias("previous_snapshot_id"), "content_hash")


#: Other names of a column in older tables, in the order in which they are looked for; fixed values.
CLAIM_NAMES = {
    "claim_id": "claim_id id", "persona_id": "persona_id character_id persona", "continuity": "continuity worldline timeline", "subject": "subject", "predicate": "predicate relation",
    "object_value": "object_value object value", "text": "text content claim statement", "status": "status governance_status", "created_at": "created_at proposed_at",
    "updated_at": "updated_at authorized_at", "confidence": "confidence", "valid_from": "valid_from valid_start", "valid_to": "valid_to valid_until valid_end",
    "knowledge_from": "knowledge_from knowledge_start known_from", "knowledge_to": "knowledge_to knowledge_until knowledge_end known_to", "access_policy": "access_policy access visibility",
    "proposed_by": "proposed_by created_by", "proposal_model": "proposal_model model", "rationale": "rationale notes", "snapshot_id": "snapshot_id source_snapshot_id source_id",
    "start_line": "start_line line_start source_line_start", "end_line": "end_line line_end source_line_end", "quote": "quote source_text", "content_hash": "quote_sha256 evidence_hash",
}
EVENT_NAMES = {
    "event_id": "event_id id", "persona_id": "persona_id", "continuity": "continuity worldline timeline", "event_type": "event_type type", "title": "title name", "summary": "summary text content",
    "details_json": "details details_json metadata", "valid_from": "valid_from valid_start", "valid_to": "valid_to valid_until valid_end", "knowledge_from": "knowledge_from knowledge_start",
    "knowledge_to": "knowledge_to knowledge_until knowledge_end", "access_policy": "access_policy access", "created_at": "created_at",
}


def renamed(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns of `names`, each as text from the first of its older names that is filled; null where there is none.

    Names compare without case; columns that are not named are left out.
    """
    have = {c.lower(): c for c in rows.columns}

    def column(candidates: str) -> Column:
        found = [F.col(f"`{have[n]}`").cast("string") for n in candidates.split() if n in have]
        return F.coalesce(*[F.when(c != "", c) for c in found]) if found else F.lit(None).cast("string")

    return rows.select(*[column(c).alias(n) for n, c in names.items()])


def _instant(c: Column) -> Column:
    return instant_text(epoch_seconds(c))


def converted_claims(rows: DataFrame, snapshots: DataFrame, at: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(claims, decisions, evidence) of older claims that carry their source span in the same row.

    snapshots: old_id, snapshot_id, line_count of the converted snapshots. `at` (an instant as text) stands for a missing
    creation time. Claims come in as what their status says (blank: AUTHORIZED, unknown: DISPUTED), with one decision
    for those that are not PROPOSED; a span outside its snapshot makes no evidence. Repeated ids count once (the row
    whose text form is least). Ids are digests, so a second conversion gives the same rows.
    """
    r = renamed(rows, CLAIM_NAMES).where("claim_id is not null")
    r = r.groupBy("claim_id").agg(F.min(F.struct(*[c for c in CLAIM_NAMES if c != "claim_id"])).alias("x")).select("claim_id", "x.*")
    created = F.coalesce(_instant(F.col("created_at")), F.lit(at))
    status = mapped(F.col("status"), STATUS, "DISPUTED", "AUTHORIZED")
    claims = r.select(
        "claim_id", F.coalesce("persona_id", F.lit("default")).alias("persona_id"), F.coalesce("continuity", F.lit("default")).alias("continuity"),
        F.coalesce("text", F.concat_ws(" ", "subject", "predicate", "object_value")).alias("text"), "subject", "predicate", "object_value",
        *[_instant(F.col(c)).alias(c) for c in ("valid_from", "valid_to", "knowledge_from", "knowledge_to")],
        mapped(F.col("access_policy"), ACCESS, "hidden", "agent_accessible").alias("access_policy"), unit_interval(F.col("confidence")).alias("confidence"), status.alias("status"),
        F.coalesce("proposed_by", F.lit("migration")).alias("proposed_by"), "proposal_model", "rationale", created.alias("created_at"), F.coalesce(_instant(F.col("updated_at")), created).alias("updated_at"),
    )
    decided = claims.where("status <> 'PROPOSED'")
    decisions = decided.select(stable_id("dec", F.lit("migration"), F.col("claim_id")).alias("decision_id"), "claim_id", F.lit("PROPOSED").alias("from_status"), F.col("status").alias("to_status"), F.lit("migration").alias("reviewer"), F.col("updated_at").alias("decided_at"))
    start = F.coalesce(F.col("start_line").try_cast("bigint"), F.lit(1))
    spans = r.select("claim_id", F.col("snapshot_id").alias("old_id"), start.alias("start_line"), F.coalesce(F.col("end_line").try_cast("bigint"), start).alias("end_line"), "quote", "content_hash", created.alias("created_at"))
    cited = spans.join(snapshots.select("old_id", "snapshot_id", "line_count"), "old_id").where("start_line >= 1 and start_line <= end_line and end_line <= line_count")
    evidence = cited.select(stable_id("evr", F.col("claim_id"), F.col("snapshot_id"), F.col("start_line").cast("string"), F.col("end_line").cast("string")).alias("evidence_id"), "claim_id", "snapshot_id", "start_line", "end_line", "quote", "content_hash", "created_at")
    return claims, decisions, evidence


def converted_events(rows: DataFrame, at: str) -> DataFrame:
    """Narrative events of older tables; details that are no JSON are kept as text under legacy_value."""
    r = renamed(rows, EVENT_NAMES).where("event_id is not null")
    r = r.groupBy("event_id").agg(F.min(F.struct(*[c for c in EVENT_NAMES if c != "event_id"])).alias("x")).select("event_id", "x.*")
    details = F.when(F.col("details_json").isNull(), F.lit("{}")).when(F.try_parse_json("details_json").isNotNull(), F.col("details_json")).otherwise(F.to_json(F.struct(F.col("details_json").alias("legacy_value"))))
    filled = {"persona_id": "default", "continuity": "default", "event_type": "narrative", "title": "", "summary": ""}
    return r.select(
        "event_id", *[F.coalesce(c, F.lit(x)).alias(c) for c, x in filled.items()], details.alias("details_json"),
        *[_instant(F.col(c)).alias(c) for c in ("valid_from", "valid_to", "knowledge_from", "knowledge_to")],
        mapped(F.col("access_policy"), ACCESS, "hidden", "agent_accessible").alias("access_policy"), F.coalesce(_instant(F.col("created_at")), F.lit(at)).alias("created_at"),
    )


def missing_entries(rows: DataFrame, key: str, ledger: DataFrame, event_type: str, aggregate_type: str, payload: Column) -> DataFrame:
    """Ledger entries, without their links, for the rows of which the ledger has none: what a backfill appends.

    payload: JSON text over the columns of rows, which has created_at. Rows are ordered by created_at and key
    (n, from 0), ready for ledger.appended.
    """
    known = ledger.where((F.col("aggregate_type") == aggregate_type) & (F.col("event_type") == event_type)).select(F.col("aggregate_id").alias(key)).distinct()
    new = rows.join(known, key, "left_anti")
    entry = new.select(stable_id("led", F.lit(event_type), F.col(key)).alias("entry_id"), F.lit(event_type).alias("event_type"), F.lit(aggregate_type).alias("aggregate_type"), F.col(key).alias("aggregate_id"), payload.alias("payload_json"), "created_at")
    blocked = entry.withColumn("at", F.coalesce(epoch_seconds(F.col("created_at")), F.lit(-(2**40))))
    return with_previous(blocked, [], ["at", "aggregate_id"], {"before": "aggregate_id"}, 30 * 86_400, number="n").withColumn("n", F.col("n") - 1).drop("at", "before")
