"""Where quoted lines stand in another revision: exact line-sequence search for many patterns at once.

Every window of lines of a target, for each width that is asked of that target, has a digest; quotes meet windows in
one equi join on (target, width, digest). Equal quotes are searched once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ledgerloom.functions.temporal import strip
from ledgerloom.functions.text import lf, plain_digest, source_lines

# Outcomes and anchor errors; fixed values.
OUTCOMES = ["SAME_POSITION", "EXACT_MOVED_UNIQUE", "EXACT_MOVED_AMBIGUOUS", "NO_EXACT_MATCH", "INVALID_EVIDENCE"]
#: Places at which one quote may stand; more fail the report, none is cut off. A fixed value.
MAX_CANDIDATES = 10_000
#: Bytes and lines of a quote at most; longer ones are reported, not searched.
MAX_BYTES, MAX_LINES = 16 * 1024 * 1024, 200_000


def anchors(evidence: DataFrame) -> DataFrame:
    """evidence with error (why it cannot be an anchor, the first reason in a fixed order), width and key.

    evidence: evidence_id, snapshot_id, start_line, end_line, quote, content_hash. A quote is split at LF only, after
    CRLF and CR have become LF: an empty quote is one blank line.
    """
    q = lf(F.col("quote"))
    width = (F.length(q) - F.length(F.replace(q, F.lit("\n"), F.lit(""))) + 1).cast("bigint")
    span = F.col("end_line") - F.col("start_line") + 1
    stored = plain_digest(F.col("content_hash"))
    error = (
        F.when(F.col("snapshot_id").isNull() | (strip(F.col("snapshot_id")) == ""), "SNAPSHOT_ID_REQUIRED")
        .when(F.col("start_line").isNull() | F.col("end_line").isNull() | (F.col("start_line") < 1) | (F.col("end_line") < F.col("start_line")), "INVALID_LINE_RANGE")
        .when(F.col("quote").isNull(), "QUOTE_REQUIRED")
        .when(~F.is_valid_utf8("quote"), "INVALID_UNICODE_QUOTE")
        .when(F.octet_length(q) > MAX_BYTES, "QUOTE_BYTES_LIMIT")
        .when(width > MAX_LINES, "QUOTE_LINES_LIMIT")
        .when(width != span, "QUOTE_SPAN_MISMATCH")
        .when(F.col("content_hash").isNotNull() & stored.isNull(), "INVALID_CONTENT_HASH")
        .when(stored != F.sha2(q, 256), "CONTENT_HASH_MISMATCH")
    )
    return evidence.withColumn("error", error).withColumn("width", width).withColumn("key", F.sha2(q, 256))


def windows(targets: DataFrame, asked: DataFrame) -> DataFrame:
    """target_id, width, key, start_line of each window of each asked width. targets: target_id, content."""
    widths = asked.select("target_id", "width").distinct().groupBy("target_id").agg(F.collect_set("width").alias("widths"))
    t = targets.join(widths, "target_id").select("target_id", source_lines(F.col("content")).alias("lines"), F.explode("widths").alias("width"))
    t = t.withColumn("last", F.size("lines") - F.col("width") + 1).where("last >= 1")
    # digests are made while the lines lie in one row; no window carries the text
    window = lambda i: F.struct(F.sha2(F.array_join(F.slice("lines", i, F.col("width").cast("int")), "\n"), 256).alias("key"), i.cast("bigint").alias("start_line"))
    return t.select("target_id", "width", F.inline(F.transform(F.sequence(F.lit(1), F.col("last").cast("int")), window)))


def classify(asked: DataFrame, targets: DataFrame, max_candidates: int = MAX_CANDIDATES) -> DataFrame:
    """evidence_id, target_id, outcome, n_candidates, candidates (sorted start lines) of each anchor in its target.

    asked: the columns of `anchors` with target_id. Overlapping occurrences all count; a quote that stands at more than
    max_candidates places fails the query (CANDIDATE_LIMIT) when its rows are read, before its places are gathered. Anchors with an error are
    INVALID_EVIDENCE; a target without text has no match.
    """
    good = asked.where("error is null")
    patterns = good.select("target_id", "width", "key").distinct()
    hits = windows(targets, patterns).join(patterns, ["target_id", "width", "key"])
    # a task gathers within a block of lines first, so that counts are known before places are put together
    part = hits.groupBy("target_id", "width", "key", F.floor(F.col("start_line") / max_candidates).alias("block")).agg(F.collect_list("start_line").alias("some"), F.count("*").alias("n"))
    most = F.sum("n").over(W.partitionBy("target_id", "width", "key"))
    part = part.withColumn("all", most).withColumn("some", F.when(F.col("all") <= max_candidates, F.col("some")).otherwise(F.raise_error(F.lit("CANDIDATE_LIMIT")).cast("array<bigint>")))
    found = part.groupBy("target_id", "width", "key").agg(F.array_sort(F.flatten(F.collect_list("some"))).alias("candidates"))
    j = good.join(found, ["target_id", "width", "key"], "left")
    n = F.coalesce(F.size("candidates"), F.lit(0))
    n = F.when(n < 0, 0).otherwise(n)
    outcome = F.when(F.array_contains("candidates", F.col("start_line")), OUTCOMES[0]).when(n == 1, OUTCOMES[1]).when(n > 1, OUTCOMES[2]).otherwise(OUTCOMES[3])
    out = j.select("evidence_id", "target_id", outcome.alias("outcome"), n.cast("bigint").alias("n_candidates"), F.coalesce("candidates", F.array().cast("array<bigint>")).alias("candidates"))
    bad = asked.where("error is not null").select("evidence_id", "target_id", F.lit(OUTCOMES[4]).alias("outcome"), F.lit(0).cast("bigint").alias("n_candidates"), F.array().cast("array<bigint>").alias("candidates"))
    return out.unionByName(bad)


def summary(report: DataFrame) -> DataFrame:
    """One row with the number of each outcome, zeros included."""
    return report.agg(*[F.count_if(F.col("outcome") == o).alias(o.lower()) for o in OUTCOMES])
