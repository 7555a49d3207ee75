"""Overlapping and gapped intervals: continuous periods per entity and the gaps between them.

Intervals are sorted by start and each start is compared with the running maximum of the ends before it. An entity
with very many rows is cut into days: rows with one start keep only their latest end (so a day holds at most 86,400
rows), the latest end of each day is carried to the days after it, and islands are labelled within days plus the
number of islands of the days before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ledgerloom.functions.temporal import NEVER_AFTER, NEVER_BEFORE, epoch_seconds, instant_text, is_blank

DAY = 86_400


def _edges(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, s, e (epoch seconds) -> keys, day, s, e, prev_end, starts (does a new period begin here), label."""
    one = df.groupBy(*keys, "s").agg(F.max("e").alias("e"))
    one = one.withColumn("day", F.floor(F.col("s") / DAY))
    in_day = W.partitionBy(*keys, "day").orderBy("s")
    before = in_day.rowsBetween(W.unboundedPreceding, -1)
    days = one.groupBy(*keys, "day").agg(F.max("e").alias("day_end"))
    carried = days.withColumn("carry", F.max("day_end").over(W.partitionBy(*keys).orderBy("day").rowsBetween(W.unboundedPreceding, -1)))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "day"]]
    on = same[0]
    for c in same[1:]:
        on = on & c
    joined = one.alias("l").join(carried.alias("r"), on).select("l.*", "r.carry")
    prev = F.greatest(F.max("e").over(before), F.col("carry"))
    return joined.withColumn("prev_end", prev).withColumn("starts", F.col("prev_end").isNull() | (F.col("s") > F.col("prev_end")))


def gaps(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """keys, gap_from, gap_to (epoch seconds): the gaps between neighbouring periods of each entity.

    start and end are epoch seconds; null is open. Rows whose start is not before their end are left out, touching
    intervals are continuous, null keys form one entity like any other value. Repeated rows count once; an empty
    table has no gaps. Other columns are ignored.
    """
    e = _edges(_bounded(df, keys, start, end), keys)
    return e.where("starts and prev_end is not null").select(*keys, F.col("prev_end").alias("gap_from"), F.col("s").alias("gap_to"))


def periods(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """keys, period_no (1..), period_from, period_to, n_starts: the merged periods; null is open. See `gaps`."""
    e = _edges(_bounded(df, keys, start, end), keys)
    e = e.withColumn("in_day", F.sum(F.col("starts").cast("long")).over(W.partitionBy(*keys, "day").orderBy("s").rowsBetween(W.unboundedPreceding, 0)))
    per_day = e.groupBy(*keys, "day").agg(F.sum(F.col("starts").cast("long")).alias("n_in_day"))
    offset = per_day.withColumn("offset", F.coalesce(F.sum("n_in_day").over(W.partitionBy(*keys).orderBy("day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    on = F.lit(True)
    for k in [*keys, "day"]:
        on = on & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    labelled = e.alias("l").join(offset.alias("r"), on).select("l.*", (F.col("l.in_day") + F.col("r.offset")).alias("period_no"))
    out = labelled.groupBy(*keys, "period_no").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count("*").alias("n_starts"))
    return out.select(
        *keys,
        "period_no",
        F.when(F.col("s") > NEVER_BEFORE, F.col("s")).alias("period_from"),
        F.when(F.col("e") < NEVER_AFTER, F.col("e")).alias("period_to"),
        "n_starts",
    )


def _bounded(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    d = df.select(*keys, F.coalesce(F.col(start).cast("long"), F.lit(NEVER_BEFORE)).alias("s"), F.coalesce(F.col(end).cast("long"), F.lit(NEVER_AFTER)).alias("e"))
    return d.where("s < e")


CLAIM_KEYS = ["persona_id", "continuity", "subject", "predicate", "axis"]


def claim_intervals(claims: DataFrame) -> DataFrame:
    """CLAIM_KEYS, s, e: both axes of claim_proposals as readable intervals.

    A null or blank bound is open; a bound that is there but cannot be read, or a start not before its end, leaves
    the row out of that axis; a null subject or predicate leaves it out of both.
    """
    def axis(name: str, lo: str, hi: str) -> F.Column:
        read = [epoch_seconds(F.col(c)).alias(a) for c, a in ((lo, "s"), (hi, "e"))]
        blank = [is_blank(F.col(c)).alias(a) for c, a in ((lo, "lo_open"), (hi, "hi_open"))]
        return F.struct(F.lit(name).alias("axis"), *read, *blank)

    # conditions on what a generator gives are not pushed below it, so each text is read once
    c = claims.where("subject is not null and predicate is not null").select(
        "persona_id", "continuity", "subject", "predicate",
        F.inline(F.array(axis("valid", "valid_from", "valid_to"), axis("knowledge", "knowledge_from", "knowledge_to"))),
    )
    c = c.where("(lo_open or s is not null) and (hi_open or e is not null)")
    return c.where("s is null or e is null or s < e").select(*CLAIM_KEYS, "s", "e")


def claim_gaps(claims: DataFrame) -> DataFrame:
    g = gaps(claim_intervals(claims), CLAIM_KEYS, "s", "e")
    return g.select(*CLAIM_KEYS, instant_text(F.col("gap_from")).alias("gap_from"), instant_text(F.col("gap_to")).alias("gap_to"))


def claim_periods(claims: DataFrame) -> DataFrame:
    p = periods(claim_intervals(claims), CLAIM_KEYS, "s", "e")
    return p.select(*CLAIM_KEYS, "period_no", instant_text(F.col("period_from")).alias("period_from"), instant_text(F.col("period_to")).alias("period_to"))
