"""Rows that repeat an id are redeliveries of one record; these give the record once, whatever order rows came in."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerloom.functions.temporal import epoch_seconds


def current_claims(claims: DataFrame) -> DataFrame:
    """One row per claim: the latest by updated_at; ties go to the larger values, nulls count least."""
    rest = [c for c in claims.columns if c != "claim_id"]
    first = ["status", "access_policy", "confidence", "rationale", "valid_from", "valid_to", "knowledge_from", "knowledge_to"]
    order = [c for c in first if c in rest] + sorted(c for c in rest if c not in first)
    row = F.struct(epoch_seconds(F.col("updated_at")).alias("_at"), *order)
    return claims.where("claim_id is not null").groupBy("claim_id").agg(F.max(row).alias("_r")).select("claim_id", *[F.col(f"_r.{c}").alias(c) for c in rest])


def current_snapshots(snapshots: DataFrame, *columns: str) -> DataFrame:
    """One row per snapshot with the named columns, each the largest of its deliveries (contents do not differ)."""
    return snapshots.where("snapshot_id is not null").groupBy("snapshot_id").agg(*[F.max(c).alias(c) for c in columns])
