"""Replaying logs: chains of states, states in force, folds, and reconciliation of two records of the same facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ledgerloom.operators.ordered import with_previous

#: Log sequence numbers per block of an aggregate.
BLOCK = 50_000


def chain(log: DataFrame, key: str, order: str, from_col: str, to_col: str, first: str, width: int = BLOCK) -> DataFrame:
    """log with expected (the state the row before left, `first` at the start) and broken (it is another than said)."""
    out = with_previous(log, [key], [order], {"expected": to_col}, width)
    out = out.withColumn("expected", F.coalesce("expected", F.lit(first)))
    return out.withColumn("broken", ~F.col(from_col).eqNullSafe(F.col("expected")))


def final_states(log: DataFrame, key: str, order: str, to_col: str) -> DataFrame:
    """key, state, steps: the last state of each aggregate; a plain aggregate, combined before the shuffle."""
    return log.groupBy(key).agg(F.max_by(to_col, order).alias("state"), F.count("*").alias("steps"))


def state_in_force(log: DataFrame, key: str, order: str, state_col: str, first: str, width: int = BLOCK) -> DataFrame:
    """log with in_force: the last non-null state strictly before each row, `first` where there is none."""
    b = log.withColumn("_block", F.floor(F.col(order) / F.lit(width)).cast("long"))
    inside = W.partitionBy(key, "_block").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    b = b.withColumn("_in", F.last(state_col, ignorenulls=True).over(inside))
    ends = b.groupBy(key, "_block").agg(F.max_by(state_col, F.when(F.col(state_col).isNotNull(), F.col(order))).alias("_end"))
    ends = ends.withColumn("_carry", F.last("_end", ignorenulls=True).over(W.partitionBy(key).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)))
    j = b.alias("l").join(ends.alias("r"), F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}")) & (F.col("l._block") == F.col("r._block"))).select("l.*", "r._carry")
    return j.withColumn("in_force", F.coalesce("_in", "_carry", F.lit(first))).drop("_block", "_in", "_carry")


#: States of one fold; a block's effect is told for each of them.
MAX_STATES = 100


def last_valid(log: DataFrame, key: str, order: str, from_col: str, to_col: str, value_col: str, first: str, width: int = BLOCK) -> DataFrame:
    """key, state, value: a fold that advances only on rows whose from-state is the state reached so far.

    Whether a row counts depends on all rows before it. The log of an aggregate is cut into blocks of `width` order
    numbers; each block is folded from every state there is (at most MAX_STATES, else the call fails), all at the same
    time, and a second fold over one row per block follows the states through. So no task holds more of an aggregate
    than a block and the list of its blocks. Null keys are an aggregate of their own; a null order counts as 0.
    """
    pairs = log.select(F.explode(F.array_compact(F.array(from_col, to_col))).alias("s")).distinct().limit(MAX_STATES + 1).collect()
    if len(pairs) > MAX_STATES:
        raise ValueError(f"a fold over more than {MAX_STATES} states")
    states = sorted({r.s for r in pairs} | {first})
    kind = dict(log.dtypes)[value_col]
    # seen: whether the block has set the value, which may be null
    start = lambda s: F.struct(s.alias("state"), F.lit(None).cast(kind).alias("value"), F.lit(False).alias("seen"))
    step = lambda acc, x: F.when(x["f"] == acc["state"], F.struct(x["t"].alias("state"), x["v"].alias("value"), F.lit(True).alias("seen"))).otherwise(acc)
    b = log.select(F.col(key).alias("_key"), F.floor(F.coalesce(F.col(order), F.lit(0)) / F.lit(width)).cast("long").alias("_block"), F.struct(F.col(order).alias("o"), F.col(from_col).alias("f"), F.col(to_col).alias("t"), F.col(value_col).alias("v")).alias("_row"))
    rows = b.groupBy("_key", "_block").agg(F.array_sort(F.collect_list("_row")).alias("rows"))
    effects = rows.select("_key", "_block", F.transform(F.array(*[F.lit(s) for s in states]), lambda s: F.aggregate("rows", start(s), step)).alias("ends"))
    blocks = effects.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_block", "ends"))).alias("blocks"))
    # states may be left for null, from which no row leads on
    at = lambda acc: F.array_position(F.array(*[F.lit(s) for s in states]), acc["state"]).cast("int")

    def follow(acc, x):
        end = F.element_at(x["ends"], at(acc))
        value = F.when(end["seen"], end["value"]).otherwise(acc["value"])
        return F.when(acc["state"].isNull(), acc).otherwise(F.struct(end["state"].alias("state"), value.alias("value"), F.lit(True).alias("seen")))

    return blocks.select(F.col("_key").alias(key), F.aggregate("blocks", start(F.lit(first)), follow).alias("r")).select(key, "r.state", "r.value")


def reconcile(left: DataFrame, right: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """key, verdict: MISSING_RIGHT, MISSING_LEFT, DUPLICATE or DIFFERENT; keys that agree are left out.

    Both sides are aggregated before they meet, so a repeated key makes no product.
    """
    digest = lambda: F.sha2(F.to_json(F.struct(*compared), {"ignoreNullFields": "false"}), 256)
    side = lambda df, n: df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(f"n{n}"), F.min(digest()).alias(f"d{n}"))
    j = side(left, 1).join(side(right, 2), key, "full_outer")
    verdict = (
        F.when(F.col("n2").isNull(), "MISSING_RIGHT").when(F.col("n1").isNull(), "MISSING_LEFT").when((F.col("n1") > 1) | (F.col("n2") > 1), "DUPLICATE").when(F.col("d1") != F.col("d2"), "DIFFERENT")
    )
    return j.select(key, verdict.alias("verdict")).where("verdict is not null")


def set_difference(left: DataFrame, right: DataFrame, owner: str, member: str) -> DataFrame:
    """owner, member, only_in (left or right): the symmetric difference of two sets per owner."""
    side = lambda df, n: df.select(owner, member, F.lit(n).alias("side")).where(F.col(owner).isNotNull() & F.col(member).isNotNull())
    both = side(left, 1).unionByName(side(right, 2)).groupBy(owner, member).agg(F.max(F.col("side") == 1).alias("l"), F.max(F.col("side") == 2).alias("r"))
    return both.where("not (l and r)").select(owner, member, F.when(F.col("l"), "left").otherwise("right").alias("only_in"))


def out_of_order(log: DataFrame, key: str, order: str, sequence: str, width: int = BLOCK) -> DataFrame:
    """The rows whose sequence is not above that of the row before them in the order (of one key); ties of the order
    are broken by the sequence."""
    seen = with_previous(log, [key], [order, sequence], {"_was": sequence}, width)
    return seen.where(F.col("_was") >= F.col(sequence)).drop("_was")


def not_first(log: DataFrame, key: str, sequence: str, kind_col: str, opening: str) -> DataFrame:
    """The keys whose opening entry is missing, repeated, or not before all others; one aggregate, no window.

    key, problem: OPENING_MISSING, OPENING_REPEATED or OPENING_LATE.
    """
    is_open = F.col(kind_col).eqNullSafe(F.lit(opening))
    g = log.groupBy(key).agg(F.count_if(is_open).alias("n"), F.min(F.when(is_open, F.col(sequence))).alias("at"), F.min(F.when(~is_open, F.col(sequence))).alias("rest"))
    problem = F.when(F.col("n") == 0, "OPENING_MISSING").when(F.col("n") > 1, "OPENING_REPEATED").when(F.col("rest") < F.col("at"), "OPENING_LATE")
    return g.select(key, problem.alias("problem")).where("problem is not null")
