"""Queries of reads, audit material and reports over the supplied tables, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.functions.temporal import reference_key
from ledgerloom.functions.text import line_count
from ledgerloom.operators import audit as A, constraints as K, evidence as E, legacy as G, reads, replay as R, report as P
from ledgerloom.operators.ledger import chain_issues, entries, material_sizes
from ledgerloom.plans.kernel import KNOWN_AT, VALID_AT, _ledger, _t, project_issues
from ledgerloom.runtime import Scratch, table
from ledgerloom.sources import catalog as C, strict_json
from ledgerloom.sources.tables import current_claims

PROJECT = ("sources", "source_snapshots", "claim_proposals", "evidence_refs", "legacy_records")


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Narrative events; the supplied tables have none, so every claim stands for one that tells the same."""
    c = current_claims(table(spark, d, "claim_proposals"))
    details = F.concat(F.lit('{"confidence_known":'), F.when(F.col("confidence").isNull(), F.lit("false")).otherwise(F.lit("true")), F.lit("}"))
    return c.select(
        F.regexp_replace("claim_id", "^clm_", "evt_").alias("event_id"), "persona_id", "continuity", F.coalesce("predicate", F.lit("told")).alias("event_type"), F.coalesce("subject", F.lit("untitled")).alias("title"),
        F.col("text").alias("summary"), details.alias("details_json"), "valid_from", "valid_to", "knowledge_from", "knowledge_to", "access_policy", "created_at",
    )


def _event_evidence(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "evidence_refs")
    key = F.regexp_replace(reference_key(F.col("claim_id")), "^clm_", "evt_")
    return e.withColumn("event_id", key).withColumn("evidence_id", F.concat(F.lit("ev"), F.substring("evidence_id", 4, 64))).drop("claim_id")


# -- reads -------------------------------------------------------------------------------------------------------


def snapshots_listed(spark, d):
    s, o = _t(spark, d, "source_snapshots", "sources")
    return reads.snapshots(s, o).select("snapshot_id", "source_key", "continuity", "version")


def snapshots_of_version(spark, d):
    s, o = _t(spark, d, "source_snapshots", "sources")
    return reads.snapshots(s, o, version=2, continuity="alder").select("snapshot_id", "source_key", "media_type")


def claims_listed(spark, d):
    """Authorized claims open to agents that cite a later revision than the first."""
    c, e, s = _t(spark, d, "claim_proposals", "evidence_refs", "source_snapshots")
    cites = reads.citing(e, s.where("version > 1"))
    return reads.claims(current_claims(c), status="AUTHORIZED", access_policy="agent_accessible", cites=cites).select("claim_id", "persona_id", "continuity", "created")


def evidence_listed(spark, d):
    (e,) = _t(spark, d, "evidence_refs")
    return reads.evidence(e, _event_evidence(spark, d)).select("kind", "owner_key", "snapshot_key", "evidence_id", "start_line", "end_line")


def events_listed(spark, d):
    return reads.events(_events(spark, d), known_at=KNOWN_AT, valid_at=VALID_AT, access=["agent_accessible", "human_only"]).select("event_id", "persona_id", "event_type", "title", "first")


def event_evidence_issues(spark, d):
    """What is wrong with the evidence of events."""
    s, o = _t(spark, d, "source_snapshots", "sources")
    owners = _events(spark, d).withColumnRenamed("event_id", "claim_id")
    return E.issues(owners, _event_evidence(spark, d).withColumnRenamed("event_id", "claim_id"), s, o).select("code", F.col("claim_id").alias("event_id"), "evidence_id")


def legacy_listed(spark, d):
    return reads.legacy_records(table(spark, d, "legacy_records"), "claim_proposals").select("legacy_record_id", "legacy_key", "migrated_entity_id")


def ledger_of_aggregate(spark, d):
    return entries(_ledger(spark, d), aggregate_type="user", aggregate_id="7").select("sequence", "event_type", "entry_id")


def ledger_sizes(spark, d):
    return material_sizes(_ledger(spark, d), max_payload=9)


def evidence_specs(spark, d):
    """SNAPSHOT:START:END written and read again; spans that cannot be are left out."""
    (e,) = _t(spark, d, "evidence_refs")
    one = e.dropDuplicates(["evidence_id"]).select("evidence_id", reads.evidence_spec(F.concat_ws(":", reference_key(F.col("snapshot_id")), F.col("start_line").cast("string"), F.col("end_line").cast("string"))).alias("x"))
    return one.where("x is not null").select("evidence_id", "x.snapshot_id", "x.start_line", "x.end_line")


# -- audit material ----------------------------------------------------------------------------------------------


def claim_material(spark, d):
    return A.claim_material(current_claims(table(spark, d, "claim_proposals")))


def event_material(spark, d):
    return A.event_material(_events(spark, d))


def _one_each(e: DataFrame) -> DataFrame:
    """Evidence once each under the key it refers by; of the forms of a redelivered row the least."""
    rest = [c for c in e.columns if c not in ("evidence_id", "claim_id")]
    return e.groupBy("evidence_id").agg(F.min(reference_key(F.col("claim_id"))).alias("claim_id"), *[F.min(c).alias(c) for c in rest])


def evidence_material(spark, d):
    rows = A.evidence_json(_one_each(table(spark, d, "evidence_refs")), "claim_id")
    return rows.select("evidence_id", F.sha2("body", 256).alias("digest"))


def evidence_set_material(spark, d):
    return A.evidence_set_material(_one_each(table(spark, d, "evidence_refs")), "claim_id", "claim")


def evidence_checkpoints(spark, d):
    """The digest of each claim's evidence after each piece of evidence was added."""
    return A.evidence_checkpoints(_one_each(table(spark, d, "evidence_refs")), "claim_id", "claim", ["created_at"])


def material_payloads(spark, d):
    """What is wrong with digests in payloads: those of all evidence sets, damaged in turn."""
    sets = evidence_set_material(spark, d).withColumn("i", F.pmod(F.length("claim_id") + F.col("n"), F.lit(5)))
    digest = F.when(F.col("i") == 1, F.upper("evidence_set_sha256")).otherwise(F.col("evidence_set_sha256"))
    version = F.when(F.col("i") == 2, F.lit('"2"')).otherwise(F.lit("2"))
    whole = F.concat(F.lit('{"aggregate_sha256":"'), F.sha2("claim_id", 256), F.lit('","evidence_set_sha256":"'), digest, F.lit('","material_version":'), version, F.lit("}"))
    payload = F.when(F.col("i") == 3, F.concat(F.lit('{"material_version":2}'))).when(F.col("i") == 4, F.lit('{"note":1}')).otherwise(whole)
    return sets.select("claim_id", A.material_digests(payload).alias("problem")).where("problem is not null")


# -- reports -----------------------------------------------------------------------------------------------------


def _pairs(spark, d) -> DataFrame:
    """The newest revision of every source against the one before it."""
    (s,) = _t(spark, d, "source_snapshots")
    return P.endpoints(s, P.version_pairs(s))


def impact_endpoints(spark, d):
    return _pairs(spark, d)


def _impact_report(spark, d) -> DataFrame:
    c, e, s = _t(spark, d, "claim_proposals", "evidence_refs", "source_snapshots")
    return P.source_impact(current_claims(c), e, s, Scratch(spark).save(_pairs(spark, d)))


def impact_between(spark, d):
    """What the newest revision of every source does to the evidence of the one before."""
    r = P.ordered(_impact_report(spark, d))
    return r.withColumn("candidates", F.array_join(F.col("candidates").cast("array<string>"), ","))


def impact_totals(spark, d):
    return P.impact_totals(_impact_report(spark, d))


def project_findings(spark, d):
    """All rule streams: those of project_issues, intervals that are none, sources of another continuity, the ledger."""
    c, s, o = _t(spark, d, "claim_proposals", "source_snapshots", "sources")
    out = project_issues(spark, d).unionByName(P.interval_issues(current_claims(c), "claim_id", "claim")).unionByName(P.interval_issues(_events(spark, d), "event_id", "event"))
    events = event_evidence_issues(spark, d).select("code", F.lit("error").alias("severity"), F.lit("event").alias("kind"), F.col("event_id").alias("id")).distinct()
    homeless = s.select("snapshot_id", "source_id").distinct().join(o.select("source_id").distinct(), "source_id", "left_anti")
    lost = homeless.select(F.lit("SOURCE_CONTINUITY_MISMATCH").alias("code"), F.lit("error").alias("severity"), F.lit("snapshot").alias("kind"), F.col("snapshot_id").alias("id"))
    broken = chain_issues(_ledger(spark, d)).limit(1).select(F.lit("EVENT_LEDGER_INVALID").alias("code"), F.lit("error").alias("severity"), F.lit("ledger").alias("kind"), F.lit(None).cast("string").alias("id"))
    return out.unionByName(events).unionByName(lost).unionByName(broken)


def project_totals(spark, d):
    return P.totals(project_findings(spark, d))


def _pack(spark, d) -> tuple[DataFrame, DataFrame]:
    c, e, s, o = _t(spark, d, "claim_proposals", "evidence_refs", "source_snapshots", "sources")
    return P.memory_pack(c, e, s, o, KNOWN_AT, VALID_AT)


def memory_pack(spark, d):
    """The claims of a pack under all their names, with the provenance that stands first."""
    p = _pack(spark, d)[0]
    return p.withColumn("n_provenance", F.size("provenance").cast("bigint")).withColumn("start_line", F.col("source_span.start_line")).drop("source_span", "provenance", "kf", "vf")


def memory_pack_events(spark, d):
    """The events of the pack whose evidence is sound, by valid_from and id."""
    e = reads.events(_events(spark, d), known_at=KNOWN_AT, valid_at=VALID_AT).where("access_policy <> 'hidden'")
    bad = event_evidence_issues(spark, d).select("event_id").distinct()
    return e.join(bad, "event_id", "left_anti").select("event_id", "title", "persona_id", "continuity", "access_policy", "details_json").orderBy("event_id")


def memory_pack_statistics(spark, d):
    packed, diagnostics = _pack(spark, d)
    return P.pack_statistics(packed, diagnostics, memory_pack_events(spark, d))


# -- tables and texts --------------------------------------------------------------------------------------------


def json_issues(spark, d):
    """Payloads that are not strictly JSON: those of older records, damaged in turn (as supplied all are sound)."""
    r = table(spark, d, "legacy_records")
    cut = F.expr("substring(payload_json, 1, length(payload_json) - 1)")
    turn = F.col("legacy_record_id") % 6
    damaged = (
        F.when(turn == 1, F.concat(cut, F.lit(', "reason": 1}')))
        .when(turn == 2, F.concat(cut, F.lit(', "x": NaN}')))
        .when(turn == 3, cut)
        .when(turn == 4, F.concat(cut, F.lit(', "x": "\\u001b"}')))
        .when(turn == 5, F.concat(cut, F.lit(', "x": [[[[[[1]]]]]]}')))
        .otherwise(F.col("payload_json"))
    )
    return strict_json.json_issues(r.select("legacy_record_id", damaged.alias("payload")), "legacy_record_id", "payload", max_depth=6)


def table_columns(spark, d):
    return C.columns({t: table(spark, d, t) for t in PROJECT}).select("table_name", "column_name", F.col("position").cast("bigint").alias("position"))


def table_digests(spark, d):
    return C.table_digests({t: table(spark, d, t) for t in PROJECT if t != "claim_proposals"})


def redacted_quotes(spark, d):
    (e,) = _t(spark, d, "evidence_refs")
    one = e.groupBy("evidence_id").agg(F.min("quote").alias("quote")).where("quote is not null")
    return one.select("evidence_id", C.redacted(F.col("quote")).alias("r")).select("evidence_id", "r.type", "r.length", "r.sha256")


def metadata_problems(spark, d):
    """Texts of documents that no report may show."""
    x = table(spark, d, "documents")
    return x.select("doc_id", C.metadata_problem(F.col("text")).alias("problem")).where("problem is not null")


#: Limits of long_fields; those of the project (catalog.CLAIM_LIMITS) are far beyond the tables.
SHORT = {"text": 120, "rationale": 40, "subject": 18, "predicate": 8, "object_value": 14, "proposed_by": 10, "proposal_model": 10}


def long_fields(spark, d):
    return C.over_limits(current_claims(table(spark, d, "claim_proposals")), "claim_id", SHORT)


def proposal_texts(spark, d):
    c = current_claims(table(spark, d, "claim_proposals"))
    blank = F.when(F.length("text") % 3 == 0, F.lit(" ")).otherwise(F.col("text"))
    return c.select("claim_id", C.proposal_text(blank, F.col("subject"), F.col("predicate"), F.col("object_value")).alias("text"))


def legacy_status(spark, d):
    """Older status words of orders as present ones; unknown words are disputed, blanks authorized."""
    (o,) = _t(spark, d, "orders")
    word = F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "O", " Pending").otherwise(F.col("o_orderstatus"))
    return o.groupBy(G.mapped(word, G.STATUS, "DISPUTED", "AUTHORIZED").alias("status")).agg(F.count("*").alias("n"))


# -- older tables ------------------------------------------------------------------------------------------------

#: A creation time for older rows that have none.
MOVED_AT = "2026-01-01T00:00:00Z"


def _older_claims(spark, d) -> DataFrame:
    """The claims as an older table had them: other names and words, one source span in the same row."""
    c, e = _t(spark, d, "claim_proposals", "evidence_refs")
    span = e.select(reference_key(F.col("claim_id")).alias("ck"), F.struct("evidence_id", reference_key(F.col("snapshot_id")).alias("sk"), "start_line", "end_line").alias("x")).where("ck is not null").groupBy("ck").agg(F.min("x").alias("x"))
    j = current_claims(c).join(span, F.lower("claim_id") == F.col("ck"), "left")
    word = F.when(F.col("status") == "AUTHORIZED", "Accepted").when(F.col("status") == "PROPOSED", "pending").when(F.col("status") == "REJECTED", "").otherwise(F.lower("status"))
    access = F.when(F.col("access_policy") == "agent_accessible", "public").when(F.col("access_policy") == "human_only", "Human-Only").otherwise(F.lit("unknown"))
    return j.select(
        F.col("claim_id").alias("ID"), F.col("persona_id").alias("character_id"), F.col("continuity").alias("worldline"), F.when(F.length("text") % 2 == 0, F.col("text")).alias("statement"), "subject",
        F.col("predicate").alias("relation"), F.col("object_value").alias("object"), word.alias("status"), access.alias("visibility"), (F.col("confidence") * 1.25).alias("confidence"),
        F.col("valid_from").alias("valid_start"), F.col("valid_to").alias("valid_until"), F.col("knowledge_from").alias("known_from"), F.col("created_at"), F.col("x.sk").alias("source_snapshot_id"),
        F.col("x.start_line").alias("line_start"), F.col("x.end_line").alias("line_end"),
    )


def _converted(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    s = table(spark, d, "source_snapshots").groupBy("snapshot_id").agg(F.max(line_count(F.col("content"))).alias("line_count"))
    return G.converted_claims(_older_claims(spark, d), s.select(F.lower("snapshot_id").alias("old_id"), "snapshot_id", "line_count"), MOVED_AT)


def converted_claims(spark, d):
    return _converted(spark, d)[0].select("claim_id", "persona_id", "text", "predicate", "valid_from", "valid_to", "knowledge_from", "access_policy", F.round("confidence", 6).alias("confidence"), "status", "proposed_by", "created_at", "updated_at")


def converted_decisions(spark, d):
    return _converted(spark, d)[1]


def converted_evidence(spark, d):
    return _converted(spark, d)[2].select("evidence_id", "claim_id", "snapshot_id", "start_line", "end_line")


def converted_events(spark, d):
    """Narrative events of an older table made of the stream of events."""
    (e,) = _t(spark, d, "events")
    kind = F.when(F.col("event_type") != "error", F.col("event_type"))
    details = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.lit("no json"))
    older = e.select(F.col("event_id").alias("id"), F.col("user_id").alias("persona_id"), kind.alias("type"), F.concat_ws(" ", F.lit("event"), "event_id").alias("name"), details.alias("metadata"), F.lit("private").alias("access"))
    return G.converted_events(older, MOVED_AT).select("event_id", "persona_id", "continuity", "event_type", "title", "details_json", "access_policy", "created_at")


def missing_entries(spark, d):
    """Creation entries that a ledger lacks of half of the claims."""
    c = current_claims(table(spark, d, "claim_proposals")).select("claim_id", "persona_id", "created_at")
    have = c.where("length(persona_id) > 6").select(F.lit("claim.proposed").alias("event_type"), F.lit("claim").alias("aggregate_type"), F.col("claim_id").alias("aggregate_id"))
    return G.missing_entries(c, "claim_id", have, "claim.proposed", "claim", F.concat(F.lit('{"persona_id":"'), F.col("persona_id"), F.lit('"}'))).select("n", "entry_id", "aggregate_id", "payload_json")


def claim_shape_issues(spark, d):
    """Claims that may not be proposed, of claims with blanked texts and raised confidences."""
    c = current_claims(table(spark, d, "claim_proposals"))
    worse = c.withColumn("text", F.when(F.length("text") % 5 == 0, F.lit(" ")).otherwise(F.col("text"))).withColumn("confidence", F.col("confidence") + 0.25)
    return K.broken_rows(worse, "claim_id", K.CLAIM_SHAPE)


def payload_claims(spark, d):
    """Claims read from payloads that also name a status, which is not taken."""
    c = current_claims(table(spark, d, "claim_proposals"))
    text = F.to_json(F.struct("persona_id", "subject", "confidence", F.lit("AUTHORIZED").alias("status"), F.lit("me").alias("reviewer")))
    return K.payload_rows(c.select("claim_id", text.alias("payload")), "claim_id", "payload", {"status": "PROPOSED", "proposed_by": "model:any"}).select("claim_id", "persona_id", "subject", "text", "confidence", "status", "proposed_by")


def clock_steps_back(spark, d):
    """Events of a user whose number is not above that of the event that happened before."""
    (e,) = _t(spark, d, "events")
    x = e.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), (F.col("event_id") + F.when(F.col("event_id") % 7 == 0, -40).otherwise(0)).alias("seq"))
    return R.out_of_order(x, "user_id", "us", "seq", width=3_600_000_000).select("user_id", "seq")


def opening_problems(spark, d):
    """Users whose log does not start with a signup."""
    (e,) = _t(spark, d, "events")
    return R.not_first(e, "user_id", "event_id", "event_type", "signup")


def beyond_scope(spark, d):
    """Personas and continuities that claims name and no authorized claim has."""
    c = current_claims(table(spark, d, "claim_proposals"))
    return K.outside(c.where("status <> 'AUTHORIZED'"), c.where("status = 'AUTHORIZED'"), ["persona_id", "continuity", "predicate"])


def over_ceilings(spark, d):
    return K.over_ceilings({t: table(spark, d, t) for t in PROJECT}, 500, 2_000)


_NAMES = """snapshots_listed snapshots_of_version claims_listed evidence_listed events_listed event_evidence_issues legacy_listed
ledger_of_aggregate ledger_sizes evidence_specs claim_material event_material evidence_material evidence_set_material evidence_checkpoints
material_payloads impact_endpoints impact_between impact_totals project_findings project_totals memory_pack memory_pack_events
memory_pack_statistics json_issues table_columns table_digests redacted_quotes metadata_problems long_fields proposal_texts legacy_status
converted_claims converted_decisions converted_evidence converted_events missing_entries claim_shape_issues payload_claims
clock_steps_back opening_problems beyond_scope over_ceilings"""
QUERIES = {n: globals()[n] for n in _NAMES.split()}
