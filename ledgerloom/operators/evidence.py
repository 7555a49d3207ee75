"""Validation of evidence against the lines it cites, and spans that are built from lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerloom.functions.temporal import reference_key, strip
from ledgerloom.sources.tables import current_snapshots
from ledgerloom.functions.text import lf, line_quote, plain_digest, source_lines

# Codes of the issues; fixed values.
CODES = (
    "EVIDENCE_REQUIRED CLAIM_CONTINUITY_MISSING SNAPSHOT_ID_REQUIRED INVALID_LINE_RANGE SNAPSHOT_NOT_FOUND SNAPSHOT_CONTENT_MISSING "
    "SNAPSHOT_CONTINUITY_MISSING CONTINUITY_MISMATCH SNAPSHOT_LINE_COUNT_MISMATCH LINE_RANGE_OUT_OF_BOUNDS INVALID_QUOTE QUOTE_MISMATCH "
    "INVALID_CONTENT_HASH CONTENT_HASH_MISMATCH"
).split()


def cited(evidence: DataFrame, snapshots: DataFrame) -> DataFrame:
    """evidence_id, claim_key, snapshot_key, span, quote, content_hash with line_count, source_id and there (the snapshot
    is). One row per evidence id (redeliveries once); no content is moved."""
    e = evidence.select(
        "evidence_id", reference_key(F.col("claim_id")).alias("claim_key"), reference_key(F.col("snapshot_id")).alias("snapshot_key"),
        "start_line", "end_line", "quote", "content_hash",
    ).dropDuplicates(["evidence_id"])
    s = current_snapshots(snapshots, "source_id", "line_count").select(F.lower("snapshot_id").alias("snapshot_key"), "source_id", "line_count", F.lit(True).alias("there"))
    return e.join(s, "snapshot_key", "left")


def with_lines(rows: DataFrame, snapshots: DataFrame) -> DataFrame:
    """rows (with a snapshot_key) with the lines of the snapshot: the last join, so texts move once.

    A content is split into lines once per snapshot, before the join; a snapshot that very many rows cite is split
    over tasks by the adaptive skew join.
    """
    s = current_snapshots(snapshots, "content").select(F.lower("snapshot_id").alias("snapshot_key"), source_lines(F.col("content")).alias("lines"))
    return rows.join(s, "snapshot_key", "left")


def issues(claims: DataFrame, evidence: DataFrame, snapshots: DataFrame, sources: DataFrame) -> DataFrame:
    """code, claim_id, evidence_id: everything that is wrong with the evidence of each claim.

    Evidence of unknown claims is left out. A row stops at a missing snapshot id, range, snapshot or content, at an
    impossible range and at one beyond the text; otherwise all its issues come out. Continuities compare exactly.
    A claim without evidence has one issue with a null evidence_id.
    """
    c = claims.select(F.lower("claim_id").alias("claim_key"), "claim_id", "continuity").dropDuplicates(["claim_key"])
    owner = sources.select("source_id", F.col("continuity").alias("source_continuity")).dropDuplicates(["source_id"])
    # the short columns of sources and claims meet ids only; the texts follow once
    j = with_lines(cited(evidence, snapshots).join(owner, "source_id", "left").join(c, "claim_key"), snapshots)
    j = j.withColumn("n", F.when(F.col("lines").isNotNull(), F.size("lines")))
    ranged = F.col("start_line").isNotNull() & F.col("end_line").isNotNull()
    possible = (F.col("start_line") >= 1) & (F.col("end_line") >= F.col("start_line"))
    inside = possible & (F.col("end_line") <= F.col("n"))
    blank = lambda x: F.coalesce(strip(F.col(x)) == "", F.lit(True))
    expected = line_quote(F.col("lines"), F.col("start_line"), F.col("end_line"))
    j = j.withColumn("expected", expected)
    stored = plain_digest(F.col("content_hash"))
    issue = lambda cond, code: F.when(cond, F.lit(code))
    early = F.when(F.col("snapshot_key").isNull(), "SNAPSHOT_ID_REQUIRED").when(~ranged, "INVALID_LINE_RANGE").when(F.col("there").isNull(), "SNAPSHOT_NOT_FOUND").when(F.col("lines").isNull(), "SNAPSHOT_CONTENT_MISSING")
    rest = F.array(
        issue(blank("source_continuity"), "SNAPSHOT_CONTINUITY_MISSING"),
        issue(~blank("source_continuity") & ~blank("continuity") & (F.col("source_continuity") != F.col("continuity")), "CONTINUITY_MISMATCH"),
        issue(F.col("line_count") != F.col("n"), "SNAPSHOT_LINE_COUNT_MISMATCH"),
        issue(~possible, "INVALID_LINE_RANGE"),
        issue(possible & (F.col("end_line") > F.col("n")), "LINE_RANGE_OUT_OF_BOUNDS"),
        issue(inside & ~F.is_valid_utf8("quote"), "INVALID_QUOTE"),
        issue(inside & F.is_valid_utf8("quote") & (lf(F.col("quote")) != F.col("expected")), "QUOTE_MISMATCH"),
        issue(inside & F.col("content_hash").isNotNull() & stored.isNull(), "INVALID_CONTENT_HASH"),
        issue(inside & (stored != F.sha2("expected", 256)), "CONTENT_HASH_MISMATCH"),
    )
    codes = F.when(early.isNotNull(), F.array(early)).otherwise(F.array_compact(rest))
    found = j.select(F.explode(codes).alias("code"), "claim_id", "evidence_id")
    homeless = c.where(blank("continuity")).select(F.lit("CLAIM_CONTINUITY_MISSING").alias("code"), "claim_id", F.lit(None).cast("string").alias("evidence_id"))
    named = evidence.select(reference_key(F.col("claim_id")).alias("claim_key")).where("claim_key is not null").distinct()
    bare = c.join(named, "claim_key", "left_anti").select(F.lit("EVIDENCE_REQUIRED").alias("code"), "claim_id", F.lit(None).cast("string").alias("evidence_id"))
    return found.unionByName(homeless).unionByName(bare)


def built(spans: DataFrame, snapshots: DataFrame) -> DataFrame:
    """evidence_id, quote, content_hash built from the cited lines; nulls where the span cannot be read."""
    j = with_lines(cited(spans, snapshots), snapshots)
    q = line_quote(F.col("lines"), F.col("start_line"), F.col("end_line"))
    return j.select("evidence_id", q.alias("quote")).withColumn("content_hash", F.sha2("quote", 256))
