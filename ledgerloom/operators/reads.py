"""Reads of a project's tables: listings in their fixed orders, lookups that must find one row, bounds that fail.

Listings are lazy plans. Lookups (`one`) and bounds (`at_most`) look at no more rows than they need and raise instead
of guessing or cutting off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions.temporal import contains_instant, epoch_seconds, reference_key


class NotFound(LookupError):
    """No row where one is asked for."""


class Ambiguous(LookupError):
    """Several rows where one is asked for."""


class LimitExceeded(ValueError):
    """More rows than a read may give."""


def one(df: DataFrame, what: str):
    """The only row of df."""
    rows = df.limit(2).collect()
    if not rows:
        raise NotFound(f"no {what}")
    if len(rows) > 1:
        raise Ambiguous(f"several {what}")
    return rows[0]


def at_most(df: DataFrame, limit: int, what: str = "rows") -> DataFrame:
    """df, if it has no more than `limit` rows."""
    if df.limit(limit + 1).count() > limit:
        raise LimitExceeded(f"more than {limit} {what}")
    return df


def _equal(df: DataFrame, **wanted: object) -> DataFrame:
    for name, value in wanted.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def sources(table: DataFrame, *, source_id: str | None = None, source_key: str | None = None, continuity: str | None = None) -> DataFrame:
    """Sources once each, by key and continuity."""
    s = table.select("source_id", "source_key", "continuity").distinct()
    return _equal(s, source_id=source_id, source_key=source_key, continuity=continuity).orderBy("source_key", "continuity")


def find_source(table: DataFrame, source_id: str | None = None, *, source_key: str | None = None, continuity: str | None = None):
    """The source of an id, or of a key; a key that stands in several continuities is ambiguous unless one is named."""
    if (source_id is None) == (source_key is None):
        raise TypeError("name either source_id or source_key")
    return one(sources(table, source_id=source_id, source_key=source_key, continuity=continuity), "source")


_METADATA = ["snapshot_id", "source_id", "version", "content_hash", "media_type", "origin_path", "previous_snapshot_id", "line_count", "created_at"]


def snapshot_metadata(snapshots: DataFrame) -> DataFrame:
    """Snapshots once each (per column the largest delivered value), without their contents."""
    return snapshots.where("snapshot_id is not null").groupBy("snapshot_id").agg(*[F.max(c).alias(c) for c in _METADATA[1:]])


def snapshots(table: DataFrame, owners: DataFrame, *, source_id: str | None = None, source_key: str | None = None, continuity: str | None = None, version: int | None = None) -> DataFrame:
    """Snapshots of known sources with source_key and continuity, without contents, by key, continuity and version."""
    j = snapshot_metadata(table).join(sources(owners), "source_id")
    return _equal(j, source_id=source_id, source_key=source_key, continuity=continuity, version=version).orderBy("source_key", "continuity", "version", "snapshot_id")


def lineage(table: DataFrame, source_id: str, from_version: int, to_version: int, limit: int = 10_000) -> DataFrame:
    """Metadata of the revisions of a stretch, at most `limit` of them, else the read fails."""
    s = snapshot_metadata(table.where((F.col("source_id") == source_id) & F.col("version").between(from_version, to_version)))
    return at_most(s.orderBy("version", "snapshot_id"), limit, "revisions")


def bodies(table: DataFrame, source_id: str, versions: list[int], max_bytes: int) -> DataFrame:
    """The contents of some revisions, after a check of their sizes that does not load them to the driver."""
    s = table.where((F.col("source_id") == source_id) & F.col("version").isin(versions))
    at_most(s.where(F.octet_length("content") > max_bytes).select("snapshot_id"), 0, f"bytes than {max_bytes} in a content")
    return s.groupBy("snapshot_id", "version").agg(F.max("content").alias("content"))


def claims(table: DataFrame, *, persona_id: str | None = None, continuity: str | None = None, status: str | None = None, access_policy: str | None = None, cites: DataFrame | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Claims (once each) by created_at and id. cites: claim_key of the claims that are meant (EXISTS, a semi join)."""
    c = _equal(table, persona_id=persona_id, continuity=continuity, status=status, access_policy=access_policy)
    if cites is not None:
        c = c.join(cites.select("claim_key").distinct(), F.lower("claim_id") == F.col("claim_key"), "left_semi")
    c = c.withColumn("created", epoch_seconds(F.col("created_at"))).orderBy("created", "claim_id")
    if offset > 0:
        c = c.offset(offset)
    return c if limit is None else c.limit(max(0, limit))


def citing(evidence: DataFrame, snapshot_ids: DataFrame, owner: str = "claim_id", key: str = "claim_key") -> DataFrame:
    """key of the claims (or, by another owner column, events) with evidence in the snapshots (column snapshot_id)."""
    keys = snapshot_ids.select(reference_key(F.col("snapshot_id")).alias("snapshot_key")).distinct()
    e = evidence.select(reference_key(F.col(owner)).alias(key), reference_key(F.col("snapshot_id")).alias("snapshot_key")).where(F.col(key).isNotNull()).distinct()
    return e.join(keys, "snapshot_key", "left_semi").select(key).distinct()


def find(table: DataFrame, key: str, value: str):
    """The row of an id, whichever table it is; ids compare after trimming and lower-casing, redeliveries are one row."""
    rows = table.where(F.lower(key) == value.strip().lower()).dropDuplicates([key])
    return one(rows, f"row with {key} {value}")


_SPAN = ["evidence_id", "start_line", "end_line", "start_char", "end_char", "quote", "content_hash", "created_at"]


def evidence(of_claims: DataFrame, of_events: DataFrame | None = None, *, snapshot_id: str | None = None, claim_id: str | None = None, event_id: str | None = None) -> DataFrame:
    """Evidence of claims and of events in one list (kind, owner_key), by snapshot, lines and id; redeliveries once.

    Naming a claim leaves out evidence of events and the other way round; naming both is refused.
    """
    if claim_id is not None and event_id is not None:
        raise TypeError("name a claim or an event")

    def side(df: DataFrame, kind: str, owner: str) -> DataFrame:
        rows = df.select(F.lit(kind).alias("kind"), reference_key(F.col(owner)).alias("owner_key"), reference_key(F.col("snapshot_id")).alias("snapshot_key"), *_SPAN)
        return rows.dropDuplicates(["evidence_id"])

    parts = []
    if event_id is None:
        parts.append(_equal(side(of_claims, "claim", "claim_id"), owner_key=claim_id and claim_id.strip().lower()))
    if of_events is not None and claim_id is None:
        parts.append(_equal(side(of_events, "event", "event_id"), owner_key=event_id and event_id.strip().lower()))
    if not parts:
        raise TypeError("evidence of events is asked for, and there is no table of it")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return _equal(out, snapshot_key=snapshot_id and snapshot_id.strip().lower()).orderBy("snapshot_key", "start_line", "end_line", "evidence_id")


def find_evidence(of_claims: DataFrame, of_events: DataFrame, evidence_id: str):
    """The evidence of an id, whichever table has it; an id in both is ambiguous."""
    return one(evidence(of_claims, of_events).where(F.col("evidence_id") == evidence_id), "evidence")


def decisions(table: DataFrame, claim_id: str | None = None) -> DataFrame:
    """Decisions in the order in which they were stored (row_seq), which clocks cannot disturb."""
    return _equal(table, claim_id=claim_id).orderBy("row_seq")


def legacy_records(table: DataFrame, original_table: str | None = None) -> DataFrame:
    return _equal(table, original_table=original_table).orderBy("legacy_record_id")


def first_event_time() -> Column:
    return F.coalesce(epoch_seconds(F.col("valid_from")), epoch_seconds(F.col("knowledge_from")), epoch_seconds(F.col("created_at")))


def events(table: DataFrame, *, persona_id: str | None = None, continuity: str | None = None, known_at: int | None = None, valid_at: int | None = None, access: list[str] | None = None) -> DataFrame:
    """Narrative events by the first of valid_from, knowledge_from and created_at, and id.

    known_at and valid_at (epoch seconds) keep what an instant's half-open intervals hold; null bounds are open. An
    empty access list gives nothing.
    """
    e = _equal(table, persona_id=persona_id, continuity=continuity)
    for at, name in ((known_at, "knowledge"), (valid_at, "valid")):
        if at is not None:
            e = e.where(contains_instant(epoch_seconds(F.col(f"{name}_from")), epoch_seconds(F.col(f"{name}_to")), F.lit(at)))
    if access is not None:
        e = e.where(F.col("access_policy").isin(access)) if access else e.where("false")
    return e.withColumn("first", first_event_time()).orderBy("first", "event_id")


def evidence_spec(c: Column) -> Column:
    """SNAPSHOT:START:END as a struct; null where it cannot be read or is no span. A snapshot may hold colons."""
    part = lambda i: F.regexp_extract(c, r"^(.+):\s*(\d+)\s*:\s*(\d+)\s*$", i)
    start, end = part(2).try_cast("bigint"), part(3).try_cast("bigint")
    return F.when((start >= 1) & (end >= start), F.struct(part(1).alias("snapshot_id"), start.alias("start_line"), end.alias("end_line")))
