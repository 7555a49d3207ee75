"""Audit material: the canonical form of claims, events and evidence, and the digests that bind them.

The digests are SHA-256 of canonical JSON (sorted names, no blanks, nulls kept) of an envelope with the material
version, as the ledger stores them; so a digest made here can be held against one made anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.operators.material import canonical_json

# Version of the material and the fields of each kind; fixed values.
MATERIAL_VERSION = 2
CLAIM_FIELDS = (
    "access_policy claim_id confidence continuity created_at knowledge_from knowledge_to object_value persona_id predicate "
    "proposal_model proposed_by rationale status subject text updated_at valid_from valid_to"
).split()
EVENT_FIELDS = "access_policy continuity created_at details event_id event_type knowledge_from knowledge_to persona_id summary title valid_from valid_to".split()
EVIDENCE_FIELDS = "claim_id content_hash created_at end_char end_line event_id evidence_id quote snapshot_id start_char start_line".split()
DIGEST_KEYS = ["aggregate_sha256", "evidence_set_sha256", "material_version"]
ATTESTATION_KEYS = sorted([*DIGEST_KEYS, "attested_entry_id", "attested_event_type", "migration_source_kind"])

#: Bytes of the evidence material of one owner; its digest is one SHA-256 over all of it, so more fails.
MAX_OWNER_BYTES = 64 * 1024 * 1024


def _envelope(kind: str, name: str, body: Column) -> Column:
    """The envelope's JSON; the names around the body are in order because both sort before it or after it."""
    if name == "aggregate":
        return F.concat(F.lit('{"aggregate":'), body, F.lit(f',"aggregate_type":"{kind}","material_version":{MATERIAL_VERSION}}}'))
    return F.concat(F.lit(f'{{"aggregate_type":"{kind}","evidence":['), body, F.lit(f'],"material_version":{MATERIAL_VERSION}}}'))


def claim_material(claims: DataFrame) -> DataFrame:
    """claim_id, aggregate_sha256 of every claim as it was proposed: status PROPOSED, updated_at as created_at."""
    c = claims.withColumn("status", F.lit("PROPOSED")).withColumn("updated_at", F.col("created_at"))
    return c.select("claim_id", F.sha2(_envelope("claim", "aggregate", canonical_json(c, CLAIM_FIELDS)), 256).alias("aggregate_sha256"))


def event_material(events: DataFrame) -> DataFrame:
    """event_id, aggregate_sha256. details_json has to be canonical JSON and stands in the material as it is."""
    rest = [f for f in EVENT_FIELDS if f != "details"]
    # the fields before and after details in the order of names
    before, after = [f for f in rest if f < "details"], [f for f in rest if f > "details"]
    inner = lambda fields: F.regexp_replace(canonical_json(events, fields), r"^\{|\}$", "")
    body = F.concat(F.lit("{"), inner(before), F.lit(',"details":'), F.coalesce("details_json", F.lit("{}")), F.lit(","), inner(after), F.lit("}"))
    return events.select("event_id", F.sha2(_envelope("narrative_event", "aggregate", body), 256).alias("aggregate_sha256"))


def evidence_json(evidence: DataFrame, owner: str) -> DataFrame:
    """owner (claim_id or event_id as given), evidence_id, created_at, body: each evidence as canonical JSON."""
    return evidence.select(F.col(owner), "evidence_id", "created_at", evidence_body(evidence).alias("body"))


def _bounded(rows: DataFrame, owner: str, most: int) -> None:
    size = rows.groupBy(owner).agg(F.sum(F.octet_length("body").cast("bigint")).alias("bytes"))
    if size.where(F.col("bytes") > most).limit(1).count():
        raise ValueError(f"evidence of more than {most} bytes with one owner")


def evidence_set_material(evidence: DataFrame, owner: str, kind: str, max_bytes: int = MAX_OWNER_BYTES) -> DataFrame:
    """owner, n, evidence_set_sha256: digest of an owner's evidence, whatever its order, repeats kept.

    The digest is one SHA-256 over all material of an owner, so this has to stand in one row: sizes are summed first
    (combined before the shuffle), and an owner over max_bytes fails the call.
    """
    rows = evidence_json(evidence, owner).where(F.col(owner).isNotNull())
    _bounded(rows, owner, max_bytes)
    body = F.array_join(F.array_sort(F.collect_list("body")), ",")
    return rows.groupBy(owner).agg(F.count("*").alias("n"), F.sha2(_envelope(kind, "evidence", body), 256).alias("evidence_set_sha256"))


def evidence_checkpoints(evidence: DataFrame, owner: str, kind: str, order: list[str], max_bytes: int = MAX_OWNER_BYTES) -> DataFrame:
    """owner, evidence_id, position, evidence_set_sha256: the digest of an owner's evidence after each addition.

    order has the columns of `evidence` that evidence was added by (nulls first). Bounded as evidence_set_material.
    """
    rows = evidence.select(F.col(owner).alias("_owner"), F.struct(*order, "evidence_id").alias("_order"), evidence_body(evidence).alias("body")).where("_owner is not null")
    _bounded(rows, "_owner", max_bytes)
    sets = rows.groupBy("_owner").agg(F.array_sort(F.collect_list(F.struct("_order", "body"))).alias("all"))
    prefix = lambda i: F.array_join(F.array_sort(F.transform(F.slice("all", 1, i), lambda x: x["body"])), ",")
    step = lambda i: F.struct(F.element_at("all", i)["_order"]["evidence_id"].alias("evidence_id"), i.cast("bigint").alias("position"), F.sha2(_envelope(kind, "evidence", prefix(i)), 256).alias("evidence_set_sha256"))
    return sets.select(F.col("_owner").alias(owner), F.inline(F.transform(F.sequence(F.lit(1), F.size("all")), step)))


def evidence_body(evidence: DataFrame) -> Column:
    """The canonical JSON of each row; a missing owner column is null."""
    missing = [f for f in ("claim_id", "event_id") if f not in evidence.columns]
    if not missing:
        return canonical_json(evidence, EVIDENCE_FIELDS)
    name = missing[0]
    text = canonical_json(evidence, [f for f in EVIDENCE_FIELDS if f != name])
    if name == "claim_id":
        return F.concat(F.lit('{"claim_id":null,'), F.substring(text, 2, 2**31 - 1))
    return F.replace(text, F.lit(',"evidence_id":'), F.lit(',"event_id":null,"evidence_id":'))


def material_digests(payload: Column) -> Column:
    """problem of a ledger payload's digest fields: null when there are none or all are sound.

    INCOMPLETE (one or two of the three), VERSION (material_version is not the number 2), DIGEST (not 64 lower-case
    hex digits), NOT_JSON.
    """
    keys = F.json_object_keys(payload)
    present = F.size(F.array_intersect(keys, F.array(*[F.lit(k) for k in DIGEST_KEYS])))
    hexed = lambda k: F.coalesce(F.get_json_object(payload, f"$.{k}").rlike("^[0-9a-f]{64}$"), F.lit(False))
    whole = payload.rlike(rf'"material_version"\s*:\s*{MATERIAL_VERSION}\s*[,}}]')
    return (
        F.when(payload.isNull() | keys.isNull(), "NOT_JSON")
        .when(present == 0, F.lit(None).cast("string"))
        .when(present < len(DIGEST_KEYS), "INCOMPLETE")
        .when(~whole, "VERSION")
        .when(~(hexed(DIGEST_KEYS[0]) & hexed(DIGEST_KEYS[1])), "DIGEST")
    )


def attestation(aggregate: Column, evidence_set: Column, event_type: Column, entry_id: Column, source_kind: Column) -> Column:
    """The payload that attests the material of an older creation entry, as JSON with sorted names."""
    values = {"aggregate_sha256": aggregate, "attested_entry_id": entry_id, "attested_event_type": event_type, "evidence_set_sha256": evidence_set, "material_version": F.lit(MATERIAL_VERSION), "migration_source_kind": source_kind}
    return F.to_json(F.struct(*[values[k].alias(k) for k in ATTESTATION_KEYS]), {"ignoreNullFields": "false"})


def attestation_problem(payload: Column, event_type: Column, entry_id: Column, source_kinds: list[str]) -> Column:
    """Why a payload does not attest a creation entry; null when it does."""
    keys = F.array_sort(F.json_object_keys(payload))
    field = lambda k: F.get_json_object(payload, f"$.{k}")
    return (
        F.when(~keys.eqNullSafe(F.array(*[F.lit(k) for k in ATTESTATION_KEYS])), "FIELDS")
        .when(material_digests(payload).isNotNull(), material_digests(payload))
        .when(~field("attested_event_type").eqNullSafe(event_type), "EVENT_TYPE")
        .when(~field("attested_entry_id").eqNullSafe(entry_id), "ENTRY")
        .when(~field("migration_source_kind").isin(source_kinds), "SOURCE_KIND")
    )
