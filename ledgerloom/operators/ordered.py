"""Row numbers and predecessors in ordered groups, however large one group is.

A window over a whole group would put a group that holds a third of all rows into one task. Here the order is cut
into blocks: windows run within (group, block), and a second window over one row per block carries numbers and last
values from block to block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def _same(l: str, r: str, keys: list[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"{l}.{k}").eqNullSafe(F.col(f"{r}.{k}"))
    return on


def blocked(df: DataFrame, order: Column, width: int) -> DataFrame:
    """df with the column _block: rows whose numeric order lies in one stretch of width."""
    return df.withColumn("_block", F.floor(order / F.lit(width)).cast("long"))


def with_previous(df: DataFrame, keys: list[str], order: list[str], values: dict[str, str], width: int, number: str | None = None) -> DataFrame:
    """df with, for each new column of `values`, the named column's value in the row before (null in a group's first).

    order[0] is numeric and not null; the further order columns break its ties, rows equal in all of them keep no
    defined order. With `number`, rows are also numbered 1.. within their group. An empty table stays empty.
    """
    b = blocked(df, F.col(order[0]), width)
    at = [*keys, "_block"]
    inside = W.partitionBy(*at).orderBy(*order)
    b = b.withColumn("_rn", F.row_number().over(inside).cast("long"))
    for new, old in values.items():
        b = b.withColumn(new, F.lag(old).over(inside))
    last = F.max_by(F.struct(*[F.col(v).alias(n) for n, v in values.items()], F.lit(1).alias("_one")), F.struct(*order))
    ends = b.groupBy(*at).agg(last.alias("_last"), F.count("*").alias("_n"))
    across = W.partitionBy(*keys).orderBy("_block") if keys else W.partitionBy(F.lit(0)).orderBy("_block")
    ends = ends.withColumn("_before", F.lag("_last").over(across)).withColumn("_at", F.coalesce(F.sum("_n").over(across.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    j = b.alias("l").join(ends.select(*at, "_before", "_at").alias("r"), _same("l", "r", at))
    out = j.select("l.*", "r._before", "r._at")
    for new in values:
        out = out.withColumn(new, F.when(F.col("_rn") == 1, F.col(f"_before.{new}")).otherwise(F.col(new)))
    if number:
        out = out.withColumn(number, F.col("_rn") + F.col("_at"))
    return out.drop("_block", "_rn", "_before", "_at")
