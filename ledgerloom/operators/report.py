"""Reports over a project: what a new revision does to evidence, the memory pack, and totals of issues."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerloom.functions.temporal import epoch_seconds, is_blank, reference_key
from ledgerloom.functions.text import lf, line_count, line_quote, plain_digest
from ledgerloom.operators import evidence as E, impact as M, pack
from ledgerloom.operators.reads import snapshot_metadata

#: Evidence rows of one report and candidates of all of them; more fail it, none is cut off. Fixed values.
MAX_AFFECTED, MAX_REPORT_CANDIDATES = 10_000, 50_000


def version_pairs(snapshots: DataFrame, from_version: int | None = None, to_version: int | None = None) -> DataFrame:
    """source_id, from_version, to_version: the asked stretch of every source; by default its newest revision against
    the one numbered before. Sources that do not reach the stretch are left out."""
    s = snapshots.where("source_id is not null and version is not null").groupBy("source_id").agg(F.max("version").alias("newest"))
    to = F.lit(to_version).cast("bigint") if to_version is not None else F.col("newest")
    start = F.lit(from_version).cast("bigint") if from_version is not None else F.col("to_version") - 1
    return s.withColumn("to_version", to).withColumn("from_version", start).where("from_version >= 1 and from_version < to_version and to_version <= newest").select("source_id", "from_version", "to_version")


def endpoints(snapshots: DataFrame, pairs: DataFrame) -> DataFrame:
    """source_id, from_version, to_version, from_id, to_id, problem: the first reason why a stretch cannot be reported.

    SNAPSHOT_LINEAGE_MISSING (a version of the stretch is absent or stands twice), SNAPSHOT_LINEAGE_INVALID (a
    revision does not name the one before), then for the two ends SNAPSHOT_CONTENT_MISSING, INVALID_CONTENT_HASH,
    SNAPSHOT_LINE_COUNT_MISMATCH and SNAPSHOT_CONTENT_HASH_MISMATCH. Only the ends' contents are read, where they
    lie; revisions between are told by their metadata.
    """
    p = pairs.select("source_id", "from_version", "to_version")
    meta = snapshot_metadata(snapshots).join(p, "source_id").where("version between from_version and to_version")
    before = meta.select("source_id", "from_version", "to_version", (F.col("version") + 1).alias("version"), F.lower("snapshot_id").alias("was")).groupBy("source_id", "from_version", "to_version", "version").agg(F.collect_set("was").alias("was"))
    step = meta.join(before, ["source_id", "from_version", "to_version", "version"], "left")
    broken = (F.col("version") > F.col("from_version")) & F.col("was").isNotNull() & ~F.coalesce(F.array_contains("was", reference_key(F.col("previous_snapshot_id"))), F.lit(False))
    line = step.groupBy("source_id", "from_version", "to_version").agg(
        F.count("*").alias("n"), F.count_distinct("version").alias("versions"), F.max(broken).alias("broken"),
        F.max(F.when(F.col("version") == F.col("from_version"), F.col("snapshot_id"))).alias("from_id"),
        F.max(F.when(F.col("version") == F.col("to_version"), F.col("snapshot_id"))).alias("to_id"),
    )
    want = F.col("to_version") - F.col("from_version") + 1
    line = line.withColumn("chain", F.when((F.col("n") != want) | (F.col("versions") != want), "SNAPSHOT_LINEAGE_MISSING").when(F.col("broken"), "SNAPSHOT_LINEAGE_INVALID"))
    ends = line.where("chain is null").select(F.explode(F.array("from_id", "to_id")).alias("snapshot_id")).distinct()
    digest = plain_digest(F.col("content_hash"))
    bad = (
        F.when(F.col("content").isNull(), "SNAPSHOT_CONTENT_MISSING")
        .when(digest.isNull(), "INVALID_CONTENT_HASH")
        .when(~F.col("line_count").eqNullSafe(line_count(F.col("content"))), "SNAPSHOT_LINE_COUNT_MISMATCH")
        .when(digest != F.sha2("content", 256), "SNAPSHOT_CONTENT_HASH_MISMATCH")
    )
    # of repeated deliveries one that is sound counts
    checked = snapshots.select("snapshot_id", F.coalesce(bad, F.lit("")).alias("bad")).groupBy("snapshot_id").agg(F.min("bad").alias("bad"))
    checked = checked.join(ends, "snapshot_id", "left_semi")
    of = lambda name: checked.select(F.col("snapshot_id").alias(name), F.col("bad").alias(f"{name}_bad"))
    j = line.join(of("from_id"), "from_id", "left").join(of("to_id"), "to_id", "left")
    problem = F.coalesce(F.col("chain"), F.when(F.col("from_id_bad") != "", F.col("from_id_bad")), F.when(F.col("to_id_bad") != "", F.col("to_id_bad")))
    return j.select("source_id", "from_version", "to_version", "from_id", "to_id", problem.alias("problem"))


def derived_anchors(evidence: DataFrame, snapshots: DataFrame) -> DataFrame:
    """evidence rows with quote and content_hash as their lines give them, and the columns of impact.anchors.

    error: INVALID_LINE_RANGE, QUOTE_MISMATCH or CONTENT_HASH_MISMATCH where what is stored disagrees with the cited
    lines; what is missing is filled in from them.
    """
    j = E.with_lines(E.cited(evidence, snapshots), snapshots)
    expected = line_quote(F.col("lines"), F.col("start_line"), F.col("end_line"))
    j = j.withColumn("expected", expected)
    error = (
        F.when(F.col("expected").isNull(), "INVALID_LINE_RANGE")
        .when(F.col("quote").isNotNull() & (lf(F.col("quote")) != F.col("expected")), "QUOTE_MISMATCH")
        .when(F.col("content_hash").isNotNull() & ~plain_digest(F.col("content_hash")).eqNullSafe(F.sha2("expected", 256)), "CONTENT_HASH_MISMATCH")
    )
    return j.select("evidence_id", "claim_key", "snapshot_key", "start_line", "end_line", error.alias("error"), (F.col("end_line") - F.col("start_line") + 1).alias("width"), F.sha2("expected", 256).alias("key"))


def source_impact(claims: DataFrame, evidence: DataFrame, snapshots: DataFrame, pairs: DataFrame) -> DataFrame:
    """What the later revision of each sound pair does to the evidence that cites the earlier one.

    source_id, from_id, to_id, aggregate_type, aggregate_id, evidence_id, persona_id, governance_status, start_line,
    end_line, outcome, n_candidates, candidates; by aggregate, lines and evidence. pairs: the result of `endpoints`;
    pairs with a problem give no rows. Evidence that disagrees with its lines is INVALID_EVIDENCE. Ids join first,
    texts last.
    """
    sound = pairs.where("problem is null").select("source_id", F.lower("from_id").alias("snapshot_key"), "from_id", F.col("to_id").alias("target_id"))
    cites = evidence.withColumn("snapshot_key", reference_key(F.col("snapshot_id"))).join(sound.select("snapshot_key"), "snapshot_key", "left_semi").drop("snapshot_key")
    asked = derived_anchors(cites, snapshots).join(sound, "snapshot_key")
    of = snapshots.select(F.col("snapshot_id").alias("target_id"), "content").join(sound.select("target_id").distinct(), "target_id", "left_semi")
    targets = of.groupBy("target_id").agg(F.max("content").alias("content"))
    found = M.classify(asked.select("evidence_id", "target_id", "start_line", "error", "width", "key"), targets)
    owner = claims.select(F.lower("claim_id").alias("claim_key"), F.col("claim_id").alias("aggregate_id"), "persona_id", F.col("status").alias("governance_status"))
    rows = asked.select("evidence_id", "claim_key", "source_id", "from_id", F.col("target_id").alias("to_id"), "start_line", "end_line").join(owner, "claim_key")
    out = rows.join(found.drop("target_id"), "evidence_id")
    cols = ["source_id", "from_id", "to_id", F.lit("claim").alias("aggregate_type"), "aggregate_id", "evidence_id", "persona_id", "governance_status", "start_line", "end_line", "outcome", "n_candidates", "candidates"]
    return out.select(*cols)


def ordered(report: DataFrame) -> DataFrame:
    """A report in its fixed order."""
    return report.orderBy("aggregate_type", "aggregate_id", F.coalesce("start_line", F.lit(0)), F.coalesce("end_line", F.lit(0)), "evidence_id")


def impact_totals(report: DataFrame, max_affected: int = MAX_AFFECTED, max_candidates: int = MAX_REPORT_CANDIDATES) -> DataFrame:
    """source_id, affected, claims, candidates, one column per outcome (zeros included), and limit: the bound that the
    report of a source breaks, else null."""
    t = report.groupBy("source_id").agg(F.count("*").alias("affected"), F.count_distinct("aggregate_id").alias("claims"), F.sum("n_candidates").alias("candidates"), *[F.count_if(F.col("outcome") == o).alias(o.lower()) for o in M.OUTCOMES])
    limit = F.when(F.col("affected") > max_affected, "AFFECTED_EVIDENCE_LIMIT_EXCEEDED").when(F.col("candidates") > max_candidates, "IMPACT_REPORT_CANDIDATE_LIMIT_EXCEEDED")
    return t.withColumn("limit", limit)


def interval_issues(rows: DataFrame, key: str, kind: str) -> DataFrame:
    """code, severity, kind, id: bounds that cannot be read, or that are not in order."""
    bad = F.lit(False)
    for axis in ("valid", "knowledge"):
        lo, hi = F.col(f"{axis}_from"), F.col(f"{axis}_to")
        a, b = epoch_seconds(lo), epoch_seconds(hi)
        bad = bad | (~is_blank(lo) & a.isNull()) | (~is_blank(hi) & b.isNull()) | F.coalesce(a >= b, F.lit(False))
    return rows.where(bad).select(F.lit("INVALID_TEMPORAL_INTERVAL").alias("code"), F.lit("error").alias("severity"), F.lit(kind).alias("kind"), F.col(key).alias("id"))


def totals(issues: DataFrame) -> DataFrame:
    """errors, warnings, is_valid: one row, also for no issues."""
    t = issues.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    return t.withColumn("is_valid", F.col("errors") == 0)


def memory_pack(claims: DataFrame, evidence: DataFrame, snapshots: DataFrame, sources: DataFrame, known_at: int, valid_at: int | None = None, access: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(pack, diagnostics) of all personas and continuities at a cutoff (a filter of both frames gives one of them).

    pack: the visible claims whose evidence is sound, under the names a pack has, the first provenance hoisted, and
    provenance as an array in the order of snapshot and lines. diagnostics: code, claim_id of visible claims that are
    kept out (EVIDENCE_INVALID).
    """
    c = pack.visible(claims, known_at, valid_at, access=access)
    seen = c.select("claim_id")
    bad = E.issues(claims.join(seen, "claim_id", "left_semi"), evidence, snapshots, sources).select("claim_id").distinct()
    diagnostics = bad.select(F.lit("EVIDENCE_INVALID").alias("code"), "claim_id")
    e = evidence.select(reference_key(F.col("claim_id")).alias("ck"), reference_key(F.col("snapshot_id")).alias("sk"), "evidence_id", "start_line", "end_line", "start_char", "end_char", "quote", "content_hash").dropDuplicates(["evidence_id"])
    s = snapshot_metadata(snapshots).select(F.lower("snapshot_id").alias("sk"), "snapshot_id", "source_id", F.col("version").alias("snapshot_version"), F.col("content_hash").alias("snapshot_sha256"))
    o = sources.select("source_id", "source_key").dropDuplicates(["source_id"])
    kept = c.join(bad, "claim_id", "left_anti").withColumn("ck", F.lower("claim_id"))
    span = F.struct("start_line", "end_line", "start_char", "end_char").alias("source_span")
    item = F.struct("sk", "start_line", "end_line", "evidence_id", F.struct("source_id", "source_key", "snapshot_id", "snapshot_version", "snapshot_sha256", span, "quote", F.col("content_hash").alias("quote_sha256")).alias("p"))
    proof = kept.select("ck").join(e, "ck").join(s, "sk").join(o, "source_id").groupBy("ck").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["p"]).alias("provenance"))
    first = F.element_at("provenance", 1)
    j = kept.join(proof, "ck")
    names = {
        "id": "claim_id", "claim": "text", "text": "text", "persona_id": "persona_id", "continuity": "continuity", "subject": "subject", "predicate": "predicate",
        "object": "object_value", "object_value": "object_value", "valid_from": "valid_from", "valid_until": "valid_to", "valid_to": "valid_to",
        "knowledge_from": "knowledge_from", "knowledge_until": "knowledge_to", "knowledge_to": "knowledge_to", "visibility": "access_policy", "access_policy": "access_policy",
        "confidence": "confidence", "governance_status": "status",
    }
    out = j.select(
        *[F.col(old).alias(new) for new, old in names.items()], F.lit("supported").alias("status"), first["source_id"].alias("source_id"),
        first["snapshot_id"].alias("source_snapshot_id"), first["source_span"].alias("source_span"), "provenance", "kf", "vf",
    )
    return out, diagnostics


def pack_statistics(packed: DataFrame, diagnostics: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """claims, events, excluded_with_diagnostics: one row, in one pass over the kinds of what a pack has."""
    kind = lambda df, name: df.select(F.lit(name).alias("kind"))
    rows = kind(packed, "claim").unionByName(kind(diagnostics, "diagnostic"))
    if events is not None:
        rows = rows.unionByName(kind(events, "event"))
    return rows.agg(F.count_if(F.col("kind") == "claim").alias("claims"), F.count_if(F.col("kind") == "event").alias("events"), F.count_if(F.col("kind") == "diagnostic").alias("excluded_with_diagnostics"))


def write_pack(packed: DataFrame, path: str) -> None:
    """One JSON object per line and claim, in the pack's order, to a new folder (an existing one is refused)."""
    rows = packed.orderBy(F.coalesce("kf", F.lit(-(2**62))), F.coalesce("vf", F.lit(-(2**62))), "id").drop("kf", "vf")
    rows.write.mode("error").option("ignoreNullFields", "false").json(path)
