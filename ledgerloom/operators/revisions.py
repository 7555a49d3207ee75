"""Revisions of sources: adjacent duplicates dropped, versions allocated, lineage checked."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerloom.functions.temporal import reference_key
from ledgerloom.operators.ordered import with_previous

#: Numeric order values per block of a source.
BLOCK = 20_000


def allocate(df: DataFrame, keys: list[str], order: str, id_col: str, text_col: str, width: int = BLOCK) -> DataFrame:
    """keys, id, content_hash, version, previous_id: the revisions that a run of deliveries leaves.

    A delivery equal to the one before it in its source makes no revision; A, B, A makes three. Null texts count as
    empty. order is a unique number per source.
    """
    rows = df.select(*keys, F.col(order).cast("long").alias("_o"), F.col(id_col).alias("_id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("content_hash"))
    seen = with_previous(rows, keys, ["_o"], {"_was": "content_hash"}, width)
    kept = seen.where("_was is null or _was <> content_hash").drop("_was")
    numbered = with_previous(kept, keys, ["_o"], {"previous_id": "_id"}, width, number="version")
    return numbered.select(*keys, F.col("_id").alias("id"), "content_hash", "version", "previous_id")


def one_per_snapshot(snapshots: DataFrame, *columns: str) -> DataFrame:
    """Redelivered snapshots once, with the named columns."""
    first = snapshots.groupBy("snapshot_id").agg(*[F.min(c).alias(c) for c in columns])
    return first


def latest(snapshots: DataFrame) -> DataFrame:
    """source_id, snapshot_id, version of the newest revision of each source (ties: the larger id)."""
    s = F.max(F.struct("version", "snapshot_id")).alias("x")
    return snapshots.where("source_id is not null and version is not null").groupBy("source_id").agg(s).select("source_id", "x.snapshot_id", "x.version")


def lineage_issues(snapshots: DataFrame) -> DataFrame:
    """code, snapshot_id: gaps in versions and predecessors that are not the version before in the same source.

    SNAPSHOT_VERSION_GAP: no snapshot of the source has the version before (above version 1).
    SNAPSHOT_CHAIN_BROKEN: the named predecessor is not a snapshot of that version, or one is named at version 1, or
    none is named above it. An equi self-join on (source, version - 1): no ordered window over a hot source.
    """
    s = snapshots.groupBy("snapshot_id").agg(F.min("source_id").alias("source_id"), F.min("version").alias("version"), F.min(reference_key(F.col("previous_snapshot_id"))).alias("prev"))
    before = s.select("source_id", (F.col("version") + 1).alias("version"), F.lower("snapshot_id").alias("was"))
    before = before.groupBy("source_id", "version").agg(F.collect_set("was").alias("was"))
    j = s.join(before, ["source_id", "version"], "left")
    gap = (F.col("version") > 1) & F.col("was").isNull()
    fine = F.when(F.col("version") == 1, F.col("prev").isNull()).otherwise(F.coalesce(F.array_contains(F.col("was"), F.col("prev")), F.lit(False)))
    codes = F.array_compact(F.array(F.when(gap, "SNAPSHOT_VERSION_GAP"), F.when(~fine, "SNAPSHOT_CHAIN_BROKEN")))
    return j.select(F.explode(codes).alias("code"), "snapshot_id")


def upsert(newest: DataFrame, deliveries: DataFrame, keys: list[str], order: str, id_col: str, text_col: str, width: int = BLOCK) -> DataFrame:
    """The revisions that a batch of deliveries adds to sources that may have some: the columns of `allocate`.

    newest: keys, id, version, content_hash of each source's newest revision (at most one per source; others start at
    version 1). A delivery equal to what its source has already makes no revision. Append the result; nothing is
    rewritten.
    """
    cols = [*keys, "_o", "_id", "content_hash", "_version"]
    rows = deliveries.select(*keys, F.col(order).cast("long").alias("_o"), F.col(id_col).cast("string").alias("_id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("content_hash"), F.lit(None).cast("long").alias("_version"))
    same = [F.col(f"n.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys]
    on = same[0]
    for c in same[1:]:
        on = on & c
    first = rows.groupBy(*keys).agg((F.min("_o") - 1).alias("_o"))
    seeds = newest.alias("n").join(first.alias("t"), on).select(*[F.col(f"n.{k}").alias(k) for k in keys], F.col("t._o").alias("_o"), F.col("n.id").cast("string").alias("_id"), F.col("n.content_hash").alias("content_hash"), F.col("n.version").cast("long").alias("_version"))
    seen = with_previous(rows.select(*cols).unionByName(seeds.select(*cols)), keys, ["_o"], {"_was": "content_hash"}, width)
    kept = seen.where("_version is not null or _was is null or _was <> content_hash").drop("_was")
    numbered = with_previous(kept, keys, ["_o"], {"previous_id": "_id"}, width, number="_n")
    base = seeds.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], (F.col("_version") - 1).alias("_base"))
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = numbered.where("_version is null").join(base, on, "left")
    return out.select(*keys, F.col("_id").alias("id"), "content_hash", (F.col("_n") + F.coalesce("_base", F.lit(0))).alias("version"), "previous_id")
