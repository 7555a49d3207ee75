"""Claims that exclude each other: same subject and predicate, other object, overlapping validity."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerloom.functions.temporal import epoch_seconds, overlaps
from ledgerloom.sources.tables import current_claims

KEYS = ["persona_id", "continuity", "subject", "predicate"]
#: Claims of one key that one task compares with another such block.
BLOCK = 2_000


def _atoms(claims: DataFrame) -> DataFrame:
    c = current_claims(claims).where("subject <> '' and predicate <> '' and object_value is not null and persona_id is not null and continuity is not null")
    c = c.select("claim_id", *KEYS, "object_value", "status", epoch_seconds(F.col("created_at")).alias("at"), epoch_seconds(F.col("valid_from")).alias("f"), epoch_seconds(F.col("valid_to")).alias("t"))
    return c


def pairs(claims: DataFrame, left_status: str | None = "AUTHORIZED", right_status: str | None = "AUTHORIZED") -> DataFrame:
    """claim_id, other_id: contradicting claims; with equal statuses each pair once, the earlier claim first.

    Unreadable and null bounds are open. The join has equi keys and blocks: a key that holds very many claims is
    compared block against block, and claims with the same object never meet in the result.
    """
    c = _atoms(claims)
    size = c.groupBy(*KEYS).agg(F.count("*").alias("m"), F.count_distinct("object_value").alias("objects")).where("objects > 1")
    c = c.join(size.select(*KEYS, F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), KEYS)
    mine = F.pmod(F.xxhash64("claim_id"), F.col("blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = c if left_status is None else c.where(F.col("status") == left_status)
    right = c if right_status is None else c.where(F.col("status") == right_status)
    left = left.withColumn("i", mine).withColumn("j", every)
    right = right.withColumn("j", mine).withColumn("i", every)
    r = right.select(*KEYS, "i", "j", F.col("claim_id").alias("other_id"), F.col("object_value").alias("o2"), F.col("at").alias("at2"), F.col("f").alias("f2"), F.col("t").alias("t2"))
    j = left.join(r, [*KEYS, "i", "j"]).where(F.col("object_value") != F.col("o2")).where(overlaps(F.col("f"), F.col("t"), F.col("f2"), F.col("t2")))
    if left_status == right_status:
        none = F.lit(-(2**62))
        j = j.where(F.struct(F.coalesce("at", none), "claim_id") < F.struct(F.coalesce("at2", none), "other_id"))
    return j.select("claim_id", "other_id")
