"""Who may know what, when: bitemporal cutoffs over claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerloom.functions.temporal import contains_instant, epoch_seconds
from ledgerloom.sources.tables import current_claims


def readable(claims: DataFrame) -> DataFrame:
    """claims once per id, with kf, kt, vf, vt as epoch seconds (null: open or unreadable)."""
    c = current_claims(claims)
    for new, old in (("kf", "knowledge_from"), ("kt", "knowledge_to"), ("vf", "valid_from"), ("vt", "valid_to")):
        c = c.withColumn(new, epoch_seconds(F.col(old)))
    return c


def visible(claims: DataFrame, known_at: int, valid_at: int | None = None, *, status: str = "AUTHORIZED", access: list[str] | None = None) -> DataFrame:
    """The claims of a status whose knowledge interval holds known_at and, if given, whose valid interval valid_at.

    Hidden claims never come out, whatever access lists.
    """
    c = readable(claims).where((F.col("status") == status) & (F.col("access_policy") != "hidden"))
    if access is not None:
        c = c.where(F.col("access_policy").isin([a for a in access if a != "hidden"]))
    c = c.where(contains_instant(F.col("kf"), F.col("kt"), F.lit(known_at)))
    if valid_at is not None:
        c = c.where(contains_instant(F.col("vf"), F.col("vt"), F.lit(valid_at)))
    return c


def ordered(pack: DataFrame) -> DataFrame:
    return pack.orderBy(F.coalesce("kf", F.lit(-(2**62))), F.coalesce("vf", F.lit(-(2**62))), "claim_id")


def visible_counts(claims: DataFrame, first: int, step: int, n: int) -> DataFrame:
    """persona_id, cutoff (epoch seconds), claims: how many authorized claims are known at each of n even cutoffs.

    The cutoffs inside an interval are an arithmetic range, so the interval join is an unrolled sequence of at most n
    cutoffs per claim, not a cross or theta join.
    """
    c = readable(claims).where("status = 'AUTHORIZED' and access_policy <> 'hidden'")
    lo = F.greatest(F.lit(0), F.ceil((F.coalesce("kf", F.lit(first)) - first) / step)).cast("int")
    hi = F.least(F.lit(n - 1), F.ceil((F.coalesce("kt", F.lit(first + step * n)) - first) / step) - 1).cast("int")
    at = c.withColumn("lo", lo).withColumn("hi", hi).where("lo <= hi").select("persona_id", F.explode(F.sequence("lo", "hi")).alias("i"))
    return at.groupBy("persona_id", (F.lit(first) + F.col("i") * step).cast("bigint").alias("cutoff")).agg(F.count("*").alias("claims"))
