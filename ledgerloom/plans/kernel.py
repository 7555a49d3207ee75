"""Queries of the provenance kernels over the supplied tables, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.functions.temporal import epoch_seconds, instant_text, reference_key
from ledgerloom.functions.text import line_count, source_lines
from ledgerloom.operators import constraints as C, contradictions, evidence as E, impact as M, ledger as L, legacy as G, material, pack, replay, revisions as R
from ledgerloom.operators.ordered import with_previous
from ledgerloom.runtime import Scratch, table
from ledgerloom.sources import ingest
from ledgerloom.sources.tables import current_claims, current_snapshots

#: 2025-01-01 and 2024-07-01 (UTC) in epoch seconds: cutoffs of the pack queries.
KNOWN_AT, VALID_AT = 1_735_689_600, 1_719_792_000
#: 24 cutoffs of 30 days from 2024-01-01.
FIRST, STEP, CUTOFFS = 1_704_067_200, 30 * 86_400, 24


def _t(spark: SparkSession, d: str, *names: str) -> list[DataFrame]:
    return [table(spark, d, n) for n in names]


# -- packs and scans ---------------------------------------------------------------------------------------------


def pack_asof_claims(spark, d):
    (c,) = _t(spark, d, "claim_proposals")
    p = pack.ordered(pack.visible(c, KNOWN_AT, VALID_AT))
    return p.select("claim_id", "persona_id", "continuity", "access_policy", instant_text(F.col("kf")).alias("known_from"), instant_text(F.col("vf")).alias("valid_since"))


def pack_asof_known_only(spark, d):
    (c,) = _t(spark, d, "claim_proposals")
    return pack.visible(c, KNOWN_AT, access=["agent_accessible"]).groupBy("persona_id").agg(F.count("*").alias("claims"), F.max("confidence").alias("best"))


def pack_batch_cutoffs(spark, d):
    (c,) = _t(spark, d, "claim_proposals")
    return pack.visible_counts(c, FIRST, STEP, CUTOFFS)


def pack_provenance(spark, d):
    """The claims of a pack with the list of what they rest on, in order."""
    c, e, s, o = _t(spark, d, "claim_proposals", "evidence_refs", "source_snapshots", "sources")
    claims = pack.visible(c, KNOWN_AT, VALID_AT).select(F.lower("claim_id").alias("ck"), "claim_id")
    ids = e.select(reference_key(F.col("claim_id")).alias("ck"), reference_key(F.col("snapshot_id")).alias("sk"), "evidence_id", "start_line", "end_line").dropDuplicates(["evidence_id"])
    snaps = s.select(F.lower("snapshot_id").alias("sk"), "source_id", "version").dropDuplicates(["sk"])
    keys = o.select("source_id", "source_key").dropDuplicates(["source_id"])
    j = claims.join(ids, "ck").join(snaps, "sk").join(keys, "source_id")
    item = F.struct("sk", "start_line", "end_line", "evidence_id", "source_key", "version")
    items = F.array_sort(F.collect_list(item))
    text = F.array_join(F.transform(items, lambda x: F.concat_ws(":", x["source_key"], x["version"].cast("string"), x["start_line"].cast("string"), x["end_line"].cast("string"))), ";")
    return j.groupBy("claim_id").agg(text.alias("provenance"), F.count("*").alias("n"))


def claims_page(spark, d):
    """One page of a listing (a paging feature)."""
    (c,) = _t(spark, d, "claim_proposals")
    page = current_claims(c).where("status = 'PROPOSED'").select("claim_id", "persona_id", epoch_seconds(F.col("created_at")).alias("created"))
    return page.orderBy("created", "claim_id").offset(50).limit(25)


def claims_with_evidence(spark, d):
    """Claims that cite a first revision: EXISTS as a semi join."""
    c, e, s = _t(spark, d, "claim_proposals", "evidence_refs", "source_snapshots")
    firsts = s.where("version = 1").select(F.lower("snapshot_id").alias("sk")).distinct()
    cites = e.select(reference_key(F.col("claim_id")).alias("ck"), reference_key(F.col("snapshot_id")).alias("sk")).distinct().join(firsts, "sk", "left_semi").select("ck")
    return c.select("claim_id", "persona_id", F.lower("claim_id").alias("ck")).distinct().join(cites, "ck", "left_semi").select("claim_id", "persona_id")


def scope_semi_orders(spark, d):
    o, l = _t(spark, d, "orders", "lineitem")
    large = l.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q")).where("q > 150").select(F.col("l_orderkey").alias("o_orderkey"))
    return o.join(large, "o_orderkey", "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


def source_listing(spark, d):
    s, o = _t(spark, d, "source_snapshots", "sources")
    n = s.groupBy("source_id").agg(F.count_distinct("snapshot_id").alias("snapshots"), F.max("version").alias("newest"))
    return o.select("source_id", "source_key", "continuity").distinct().join(n, "source_id", "left").select("source_key", "continuity", F.coalesce("snapshots", F.lit(0)).alias("snapshots"), "newest")


def ambiguous_source_keys(spark, d):
    """Keys that stand in several continuities, so that a lookup by key alone is ambiguous."""
    (o,) = _t(spark, d, "sources")
    return o.groupBy("source_key").agg(F.count_distinct("continuity").alias("continuities")).where("continuities > 1")


def lineage_interval(spark, d):
    """Metadata of revisions 2 to 4 of each source; no content is read."""
    (s,) = _t(spark, d, "source_snapshots")
    return s.where("version between 2 and 4").select("snapshot_id", "source_id", "version", "media_type").distinct()


# -- revisions and lines -----------------------------------------------------------------------------------------


def revision_chain(spark, d):
    (x,) = _t(spark, d, "documents")
    keyed = x.withColumn("lang", F.coalesce("lang", F.lit("none")))
    return R.allocate(keyed, ["source", "lang"], "doc_id", "doc_id", "text").withColumnRenamed("id", "doc_id")


def revision_latest(spark, d):
    return R.latest(_t(spark, d, "source_snapshots")[0])


def lineage_breaks(spark, d):
    return R.lineage_issues(_t(spark, d, "source_snapshots")[0])


def source_line_counts(spark, d):
    (s,) = _t(spark, d, "source_snapshots")
    n = line_count(F.col("content"))
    return current_snapshots(s, "content", "line_count").select("snapshot_id", n.alias("lines"), (F.col("line_count").isNotNull() & (F.col("line_count") != n)).alias("wrong"))


def document_lines(spark, d):
    """How often each line stands, over all documents."""
    (x,) = _t(spark, d, "documents")
    return x.where("text is not null").select(F.explode(source_lines(F.col("text"))).alias("line")).groupBy(F.sha2("line", 256).alias("line_digest")).agg(F.count("*").alias("n"))


def ingest_issues(spark, d):
    (x,) = _t(spark, d, "documents")
    return ingest.text_issues(x, "doc_id", "text", max_bytes=20_000, max_lines=150, max_line_bytes=2_000)


def built_evidence(spark, d):
    """Quotes and digests rebuilt from the cited lines."""
    e, s = _t(spark, d, "evidence_refs", "source_snapshots")
    return E.built(e, s).where("quote is not null").select("evidence_id", "content_hash", F.length("quote").cast("bigint").alias("chars"))


def evidence_issues(spark, d):
    c, e, s, o = _t(spark, d, "claim_proposals", "evidence_refs", "source_snapshots", "sources")
    return E.issues(c, e, s, o)


def evidence_issue_counts(spark, d):
    return evidence_issues(spark, d).groupBy("code").agg(F.count("*").alias("n"), F.count_distinct("claim_id").alias("claims"))


# -- claims ------------------------------------------------------------------------------------------------------


def contradiction_pairs(spark, d):
    return contradictions.pairs(_t(spark, d, "claim_proposals")[0], None, None)


def proposal_conflicts(spark, d):
    """Proposals that an authorized claim contradicts."""
    return contradictions.pairs(_t(spark, d, "claim_proposals")[0], "PROPOSED", "AUTHORIZED")


def claim_field_issues(spark, d):
    (c,) = _t(spark, d, "claim_proposals")
    rules = [
        C.Rule("CONFIDENCE_RANGE", "confidence < 0 or confidence > 1"),
        C.Rule("TEXT_BYTES", "octet_length(text) > 200"),
        C.Rule("SUBJECT_MISSING", "subject is null"),
        C.Rule("PREDICATE_MISSING", "predicate is null"),
        C.Rule("RATIONALE_MISSING", "rationale is null and status = 'REJECTED'"),
    ]
    return C.broken_rows(current_claims(c), "claim_id", rules)


def claim_digests(spark, d):
    (c,) = _t(spark, d, "claim_proposals")
    return material.row_digests(current_claims(c), "claim_id", ["claim_id", "persona_id", "continuity", "text", "subject", "predicate", "object_value", "access_policy", "confidence"])


def evidence_set_digests(spark, d):
    (e,) = _t(spark, d, "evidence_refs")
    rows = e.select(reference_key(F.col("claim_id")).alias("claim_key"), "evidence_id", "start_line", "end_line").where("claim_key is not null").distinct()
    return material.set_digests(rows, "claim_key", ["evidence_id", "start_line", "end_line"])


def foreign_keys(spark, d):
    c, e, s, o = _t(spark, d, "claim_proposals", "evidence_refs", "source_snapshots", "sources")
    a = C.foreign_key_issues(e, "evidence_id", reference_key(F.col("claim_id")), c, F.lower("claim_id"), "EVIDENCE_CLAIM")
    b = C.foreign_key_issues(e, "evidence_id", reference_key(F.col("snapshot_id")), s, F.lower("snapshot_id"), "EVIDENCE_SNAPSHOT")
    return a.unionByName(b).unionByName(C.foreign_key_issues(s, "snapshot_id", F.col("source_id"), o, F.col("source_id"), "SNAPSHOT_SOURCE"))


def quarantine(spark, d):
    """Snapshots set aside for a malformed digest, and the evidence that follows them."""
    e, s = _t(spark, d, "evidence_refs", "source_snapshots")
    bad = C.broken_rows(current_snapshots(s, "content_hash", "origin_path"), "snapshot_id", [C.Rule("HASH", "content_hash is null or not (regexp_replace(lower(trim(content_hash)), '^sha256:', '') rlike '^[0-9a-f]{64}$')"), C.Rule("ORIGIN", "origin_path is null")])
    keys = bad.select(F.lower("key").alias("sk")).distinct()
    follow = e.select("evidence_id", reference_key(F.col("snapshot_id")).alias("sk")).distinct().join(keys, "sk", "left_semi")
    return bad.unionByName(follow.select(F.lit("DEPENDENT").alias("code"), F.col("evidence_id").alias("key")))


def alias_map(spark, d):
    (o,) = _t(spark, d, "orders")
    access = G.mapped(F.substring("o_orderpriority", 3, 20), {"LOW": "agent_accessible", "NOT_SPECIFIED": "hidden", "HIGH": "human_only"}, "hidden", "agent_accessible")
    rate = G.unit_interval(F.when(F.col("o_orderkey") % 7 != 0, (F.col("o_totalprice") / 300000).cast("string")))
    return o.select("o_orderkey", access.alias("access_policy"), F.round(rate, 3).alias("confidence"))


# -- logs --------------------------------------------------------------------------------------------------------


def _log(spark, d) -> DataFrame:
    (e,) = _t(spark, d, "events")
    return e.select(F.col("user_id").alias("claim"), F.col("event_id").alias("seq"), F.col("event_type").alias("to_status"), F.when(F.col("event_id") % 3 == 0, "view").when(F.col("event_id") % 3 == 1, "click").otherwise("error").alias("from_status"), "value")


def state_chain(spark, d):
    """Steps of each log, and those whose from-state is not the state before."""
    x = replay.chain(_log(spark, d), "claim", "seq", "from_status", "to_status", "view", width=1_000)
    return x.groupBy("claim").agg(F.count("*").alias("steps"), F.count_if("broken").alias("broken"))


def final_states(spark, d):
    return replay.final_states(_log(spark, d), "claim", "seq", "to_status")


def state_in_force(spark, d):
    """The decision in force at every other event: the last purchase or signup before it."""
    x = _log(spark, d).withColumn("decision", F.when(F.col("to_status").isin("purchase", "signup"), F.col("to_status")))
    return replay.state_in_force(x, "claim", "seq", "decision", "none", width=1_000).groupBy("claim", "in_force").agg(F.count("*").alias("n"))


def last_valid_value(spark, d):
    """A fold: only steps from the state reached so far count."""
    return replay.last_valid(_log(spark, d), "claim", "seq", "from_status", "to_status", "value", "view", width=1_000)


def log_reconcile(spark, d):
    """Two records of the same events against each other: missing, repeated and differing ones."""
    (e,) = _t(spark, d, "events")
    left = e.where("event_id % 11 <> 0").select("event_id", "event_type", "user_id")
    right = e.where("event_id % 13 <> 0").select("event_id", F.when(F.col("event_id") % 17 == 0, "other").otherwise(F.col("event_type")).alias("event_type"), "user_id")
    right = right.unionByName(right.where("event_id % 19 = 0"))
    return replay.reconcile(left, right, "event_id", ["event_type", "user_id"])


def set_difference(spark, d):
    """Claims that cite the first revision of a source against those that cite its newest one, per source."""
    e, s = _t(spark, d, "evidence_refs", "source_snapshots")
    snaps = s.where("snapshot_id is not null and source_id is not null and version is not null").select(F.lower("snapshot_id").alias("sk"), "source_id", "version").distinct()
    ends = snaps.groupBy("source_id").agg(F.min("version").alias("first"), F.max("version").alias("newest"))
    cites = e.select(reference_key(F.col("claim_id")).alias("claim_key"), reference_key(F.col("snapshot_id")).alias("sk")).where("claim_key is not null and sk is not null").distinct()
    j = cites.join(snaps, "sk").join(ends, "source_id")
    return replay.set_difference(j.where("version = first"), j.where("version = newest"), "source_id", "claim_key")


def _ledger(spark, d) -> DataFrame:
    """A linked ledger of the events, afterwards damaged at fixed places: altered links and payloads, missing entries."""
    (e,) = _t(spark, d, "events")
    rows = e.select("event_id", F.concat(F.lit("e"), F.col("event_id")).alias("entry_id"), "event_type", F.lit("user").alias("aggregate_type"), F.col("user_id").cast("string").alias("aggregate_id"), F.col("props").alias("payload_json"), F.lit("2024-01-01T00:00:00Z").alias("created_at"))
    sound = L.appended(rows, "event_id", Scratch(spark))
    seq = F.col("sequence")
    link = F.when(seq % 97 == 0, F.lit("f" * 64)).otherwise(F.col("previous_hash"))
    payload = F.when(seq % 89 == 0, F.concat("payload_json", F.lit(" "))).otherwise(F.col("payload_json"))
    return sound.withColumn("previous_hash", link).withColumn("payload_json", payload).where("sequence % 101 <> 0")


def ledger_links(spark, d):
    return L.chain_issues(_ledger(spark, d))


def ledger_digests(spark, d):
    """The digest of every entry's fields."""
    return _ledger(spark, d).select("sequence", L.entry_digest().alias("digest"))


def ledger_bounds(spark, d):
    return L.bounds(_ledger(spark, d))


def ledger_incremental(spark, d):
    return L.entries(_ledger(spark, d), after=500, event_types=["purchase", "signup"], aggregate_type="user").select("sequence", "event_type", "aggregate_id")


def event_gaps(spark, d):
    """Microseconds since the event before, over all events, without a global window."""
    (e,) = _t(spark, d, "events")
    rows = e.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return with_previous(rows, [], ["event_id"], {"before": "us"}, 10_000).select("event_id", (F.col("us") - F.col("before")).alias("gap"))


# -- impact ------------------------------------------------------------------------------------------------------


def _impact(spark, d) -> DataFrame:
    """Every evidence against the newest revision of the source it cites."""
    e, s = _t(spark, d, "evidence_refs", "source_snapshots")
    newest = R.latest(s).select("source_id", F.col("snapshot_id").alias("target_id"))
    of = s.select(F.lower("snapshot_id").alias("sk"), "source_id").distinct().join(newest, "source_id").select("sk", "target_id")
    ev = e.dropDuplicates(["evidence_id"]).select("evidence_id", "snapshot_id", "start_line", "end_line", "quote", "content_hash", reference_key(F.col("snapshot_id")).alias("sk"))
    asked = M.anchors(ev.join(of, "sk"))
    targets = s.select(F.col("snapshot_id").alias("target_id"), "content").dropDuplicates(["target_id"])
    return M.classify(asked, targets)


def impact_report(spark, d):
    return _impact(spark, d).select("evidence_id", "target_id", "outcome", "n_candidates", F.array_join(F.col("candidates").cast("array<string>"), ",").alias("candidates"))


def impact_summary(spark, d):
    return M.summary(_impact(spark, d))


def anchor_errors(spark, d):
    (e,) = _t(spark, d, "evidence_refs")
    return M.anchors(e.dropDuplicates(["evidence_id"])).where("error is not null").select("evidence_id", "error")


# -- reports -----------------------------------------------------------------------------------------------------


def table_counts(spark, d):
    out = None
    for t in ("sources", "source_snapshots", "claim_proposals", "evidence_refs", "legacy_records"):
        n = table(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n")
        out = n if out is None else out.unionByName(n)
    return out


def scalar_bundle(spark, d):
    """Counts and byte sums that gate a report, in one pass over evidence."""
    (e,) = _t(spark, d, "evidence_refs")
    size = F.octet_length(F.coalesce("quote", F.lit(""))).cast("bigint")
    return e.agg(F.count("*").alias("entries"), F.count_distinct("evidence_id").alias("ids"), F.sum(size).alias("quote_bytes"), F.max(size).alias("largest"), F.count_if(F.col("content_hash").isNull()).alias("no_hash"))


def provenance_union(spark, d):
    """Evidence of claims and evidence of events, told apart by what their id names."""
    (e,) = _t(spark, d, "evidence_refs")
    ids = e.select("evidence_id", reference_key(F.col("claim_id")).alias("k"), reference_key(F.col("snapshot_id")).alias("sk")).distinct()
    kind = lambda p, name: ids.where(F.col("k").startswith(p)).select(F.lit(name).alias("kind"), "evidence_id", F.col("k").alias("owner"), F.col("sk").alias("snapshot_key"))
    return kind("clm_", "claim").unionByName(kind("evt_", "event"))


def project_issues(spark, d):
    """All rules in one list: errors first, then code and id."""
    s, c = _t(spark, d, "source_snapshots", "claim_proposals")
    status = current_claims(c).select("claim_id", "status")
    ev = evidence_issues(spark, d).select("code", "claim_id").distinct().join(status, "claim_id")
    sev = F.when(F.col("status") == "AUTHORIZED", "error").otherwise("warning")
    a = ev.where("status <> 'REJECTED'").select("code", sev.alias("severity"), F.lit("claim").alias("kind"), F.col("claim_id").alias("id"))
    b = R.lineage_issues(s).select("code", F.lit("error").alias("severity"), F.lit("snapshot").alias("kind"), F.col("snapshot_id").alias("id"))
    digest = current_snapshots(s, "content", "content_hash").where(F.sha2("content", 256) != F.regexp_replace(F.lower(F.trim("content_hash")), "^sha256:", ""))
    x = digest.select(F.lit("SNAPSHOT_HASH_MISMATCH").alias("code"), F.lit("error").alias("severity"), F.lit("snapshot").alias("kind"), F.col("snapshot_id").alias("id"))
    y = contradictions.pairs(c).select(F.lit("AUTHORIZED_CLAIM_CONTRADICTION").alias("code"), F.lit("error").alias("severity"), F.lit("claim").alias("kind"), F.col("claim_id").alias("id"))
    return a.unionByName(b).unionByName(x).unionByName(y).orderBy(F.when(F.col("severity") == "error", 0).otherwise(1), "code", "id")


_NAMES = """pack_asof_claims pack_asof_known_only pack_batch_cutoffs pack_provenance claims_page claims_with_evidence scope_semi_orders
source_listing ambiguous_source_keys lineage_interval revision_chain revision_latest lineage_breaks source_line_counts document_lines
ingest_issues built_evidence evidence_issues evidence_issue_counts contradiction_pairs proposal_conflicts claim_field_issues
claim_digests evidence_set_digests foreign_keys quarantine alias_map state_chain final_states state_in_force last_valid_value
log_reconcile set_difference ledger_links ledger_digests ledger_bounds ledger_incremental event_gaps impact_report impact_summary
anchor_errors table_counts scalar_bundle provenance_union project_issues"""
QUERIES = {n: globals()[n] for n in _NAMES.split()}
