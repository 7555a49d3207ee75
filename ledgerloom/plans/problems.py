"""Queries of the general problems (p2, p3, p5, p6), each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.operators import hierarchy as H, intervals as I, orphans as O, snapshot_diff as D
from ledgerloom.runtime import Scratch, table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    t = H.hierarchy(table(spark, d, "source_snapshots").select("snapshot_id", "previous_snapshot_id"), "snapshot_id", "previous_snapshot_id")
    return t.select(F.col("id").alias("snapshot_id"), F.col("root_id").alias("root_snapshot_id"), "depth")


def p2_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Entry-exit interval and number of descendants of each snapshot."""
    t = H.hierarchy(table(spark, d, "source_snapshots").select("snapshot_id", "previous_snapshot_id"), "snapshot_id", "previous_snapshot_id")
    return t.select(F.col("id").alias("snapshot_id"), "root_id", "depth", "entry", "exit", "n_descendants")


def p2_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Depth and number of descendants of each snapshot, from the intervals."""
    t = H.hierarchy(table(spark, d, "source_snapshots").select("snapshot_id", "previous_snapshot_id"), "snapshot_id", "previous_snapshot_id")
    return t.select(F.col("id").alias("snapshot_id"), "root_id", "depth", "n_descendants", ((F.col("exit") - F.col("entry") + 1) / 2).cast("bigint").alias("n_subtree"))


def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    """Path from the root of each snapshot."""
    p = H.paths(table(spark, d, "source_snapshots").select("snapshot_id", "previous_snapshot_id"), "snapshot_id", "previous_snapshot_id")
    return p.select(F.col("id").alias("snapshot_id"), "root_id", "depth", F.array_join("path", "/").alias("path"))


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    """All ancestor-descendant pairs."""
    scratch = Scratch(spark)
    snaps = table(spark, d, "source_snapshots").select("snapshot_id", "previous_snapshot_id")
    return H.descendants(scratch.save(H.hierarchy(snaps, "snapshot_id", "previous_snapshot_id", scratch)))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    registers = table(spark, d, "sources").where(F.col("source_key").startswith("register/")).select("source_id")
    return D.register_changes(table(spark, d, "source_snapshots"), registers)


def _p5(spark: SparkSession, d: str, run) -> DataFrame:
    tables = {t: table(spark, d, t) for t in ("source_snapshots", "claim_proposals", "evidence_refs")}
    return run(tables, O.PROJECT_REFERENCES, O.PROJECT_TARGETS, table(spark, d, "legacy_records"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _p5(spark, d, O.orphan_references)


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return _p5(spark, d, O.orphan_report)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return I.claim_gaps(table(spark, d, "claim_proposals"))


def p6_periods(spark: SparkSession, d: str) -> DataFrame:
    return I.claim_periods(table(spark, d, "claim_proposals"))


QUERIES = {f.__name__: f for f in (p2_found, p2_intervals, p2_sizes, p2_paths, p2_descendants, p3_found, p5_found, p5_report, p6_found, p6_periods)}
