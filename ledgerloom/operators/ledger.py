"""A hash-linked ledger: verification without a global window, bounds, and incremental reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerloom.runtime import Scratch

GENESIS = "0" * 64
#: The hashed fields, in the order of their names; fixed values.
MATERIAL = ["aggregate_id", "aggregate_type", "created_at", "entry_id", "event_type", "payload_json", "previous_hash", "sequence"]


def entry_digest() -> F.Column:
    """SHA-256 of the entry's fields as JSON with sorted names; null fields are kept."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in MATERIAL]), {"ignoreNullFields": "false"}), 256)


def chain_issues(ledger: DataFrame) -> DataFrame:
    """sequence, code: broken places of the chain.

    SEQUENCE_GAP (the entry before is missing), LINK_MISMATCH (previous_hash is not its hash; for entry 1 the genesis
    hash), DIGEST_MISMATCH (the entry's own hash is not that of its fields). The entry before is found by an equi
    join on sequence - 1, so no task sees the whole ledger. Repeated sequences are checked each on their own.
    """
    before = ledger.select((F.col("sequence") + 1).alias("sequence"), F.col("entry_hash").alias("was")).groupBy("sequence").agg(F.min("was").alias("was"))
    j = ledger.withColumn("digest", entry_digest()).select("sequence", "entry_hash", "previous_hash", "digest").join(before, "sequence", "left")
    first = F.col("sequence") == 1
    expected = F.when(first, F.lit(GENESIS)).otherwise(F.col("was"))
    codes = F.array_compact(
        F.array(
            F.when(~first & F.col("was").isNull(), "SEQUENCE_GAP"),
            F.when(expected.isNotNull() & ~F.col("previous_hash").eqNullSafe(expected), "LINK_MISMATCH"),
            F.when(~F.col("entry_hash").eqNullSafe(F.col("digest")), "DIGEST_MISMATCH"),
        )
    )
    return j.select("sequence", F.explode(codes).alias("code"))


def bounds(ledger: DataFrame) -> DataFrame:
    """entries, payload_bytes, largest_payload in one pass."""
    size = F.octet_length(F.coalesce("payload_json", F.lit(""))).cast("bigint")
    return ledger.agg(F.count("*").alias("entries"), F.coalesce(F.sum(size), F.lit(0)).alias("payload_bytes"), F.coalesce(F.max(size), F.lit(0)).alias("largest_payload"))


def entries(ledger: DataFrame, *, after: int = 0, event_types: list[str] | None = None, aggregate_type: str | None = None, aggregate_id: str | None = None, limit: int | None = None) -> DataFrame:
    """The entries after a sequence, filtered, in order: an incremental read."""
    out = ledger.where(F.col("sequence") > after)
    if event_types:
        out = out.where(F.col("event_type").isin(event_types))
    if aggregate_type:
        out = out.where(F.col("aggregate_type") == aggregate_type)
    if aggregate_id is not None:
        out = out.where(F.col("aggregate_id") == aggregate_id)
    out = out.orderBy("sequence")
    return out if limit is None else out.limit(limit)


#: Entries of one append; a chain of hashes is sequential, so a batch is linked by one task and has to be small.
MAX_BATCH = 250_000


def linked(batch: DataFrame, order: str, last_sequence: int, last_hash: str = GENESIS) -> DataFrame:
    """The entries of a batch with sequence, previous_hash and entry_hash, ready to append after last_sequence.

    batch has the other columns of MATERIAL and an order column. More than MAX_BATCH entries are refused; verification
    (`chain_issues`) has no such bound.
    """
    import hashlib
    import json

    import pandas as pd

    n = batch.count()
    if n > MAX_BATCH:
        raise ValueError(f"{n} entries in one append; link at most {MAX_BATCH} at a time")
    own = [c for c in MATERIAL if c not in ("sequence", "previous_hash")]

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        seq, before, out = last_sequence, last_hash, []
        for r in rows.sort_values(order)[own].to_dict("records"):
            seq += 1
            entry = {k: (None if pd.isna(v) else v) for k, v in r.items()} | {"previous_hash": before, "sequence": seq}
            before = hashlib.sha256(json.dumps(entry, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
            out.append(entry | {"entry_hash": before})
        return pd.DataFrame(out, columns=[*MATERIAL, "entry_hash"])

    schema = ", ".join(f"{c} {'bigint' if c == 'sequence' else 'string'}" for c in [*MATERIAL, "entry_hash"])
    rows = batch.select(F.col(order), F.lit(1).alias("one_batch"), *[F.col(c).cast("string").alias(c) for c in own])
    return rows.groupBy("one_batch").applyInPandas(link, schema)


#: Event types that only their own operations may append; fixed values.
RESERVED = ("claim.proposed", "claim.evidence_added", "claim.material_attested", "narrative_event.created", "narrative_event.material_attested")


def appended(batch: DataFrame, order: str, scratch: Scratch, *, last_sequence: int = 0, last_hash: str = GENESIS, step: int = MAX_BATCH, reserved: tuple[str, ...] = ()) -> DataFrame:
    """A batch of any size linked in steps of at most `step` entries, each starting from the hash the step before ended
    with. order is a dense integer column. Rows of a reserved event type fail the call."""
    if reserved and batch.where(F.col("event_type").isin(list(reserved))).limit(1).count():
        raise ValueError(f"event types {reserved} are reserved")
    lo, hi = batch.agg(F.min(order), F.max(order)).first()
    out = None
    for at in range(lo, hi + 1, step) if lo is not None else ():
        some = batch.where((F.col(order) >= at) & (F.col(order) < at + step))
        one = scratch.save(linked(some, order, last_sequence, last_hash))
        end = one.agg(F.max("sequence"), F.max_by("entry_hash", "sequence")).first()
        if end[0] is not None:
            last_sequence, last_hash = end
        out = one if out is None else out.unionByName(one)
    return linked(batch, order, last_sequence, last_hash) if out is None else out


def material_sizes(ledger: DataFrame, *, max_entries: int = MAX_BATCH, max_bytes: int = 64 * 1024 * 1024, max_payload: int = 2 * 1024 * 1024) -> DataFrame:
    """entries, payload_bytes, largest_payload, problem: the first bound that a verification would break, else null."""
    problem = F.when(F.col("entries") > max_entries, "LEDGER_ENTRY_LIMIT_EXCEEDED").when(F.col("largest_payload") > max_payload, "LEDGER_PAYLOAD_LIMIT_EXCEEDED").when(F.col("payload_bytes") > max_bytes, "LEDGER_BYTES_LIMIT_EXCEEDED")
    return bounds(ledger).withColumn("problem", problem)
