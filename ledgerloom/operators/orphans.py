"""References to records that do not exist, were withdrawn, or came later.

References are pre-aggregated per key and period: how many there are, the first and the last. A group is an orphan as a
whole, or not at all, but for the one period in which its key was born: there only the rows before that instant are
late, and only such groups are opened again. Keys named by more than one reference in HEAVY_SHARE are heavy; there can
be at most HEAVY_SHARE of them, so their state is small enough to broadcast whatever the data (the bound is checked).
All other keys meet their targets in a shuffle join; both parts are united.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ledgerloom.functions.temporal import epoch_seconds, month_text, reference_key
from ledgerloom.runtime import Scratch

#: A key is heavy when it has more than 1/HEAVY_SHARE of all references: so there are fewer than HEAVY_SHARE of them.
HEAVY_SHARE = 1_000


@dataclass(frozen=True)
class Reference:
    """A column that names rows of another table."""

    field: str
    table: str
    row_key: str
    column: str
    target: str


@dataclass(frozen=True)
class Target:
    table: str
    key: str


def references(tables: dict[str, DataFrame], refs: list[Reference]) -> DataFrame:
    """ref_field, row_key, key, target, at: one row per referring row and field; redeliveries count once."""
    out = None
    for table in dict.fromkeys((r.table, r.row_key) for r in refs):
        own = [r for r in refs if (r.table, r.row_key) == table]
        df = tables[table[0]].select(F.col(table[1]).cast("string").alias("row_key"), epoch_seconds(F.col("created_at")).alias("at"), *[reference_key(F.col(r.column)).alias(f"k{i}") for i, r in enumerate(own)])
        df = df.groupBy("row_key").agg(F.min("at").alias("at"), *[F.min(f"k{i}").alias(f"k{i}") for i in range(len(own))])
        wide = F.inline(F.array(*[F.struct(F.lit(r.field).alias("ref_field"), F.lit(r.target).alias("target"), F.col(f"k{i}").alias("key")) for i, r in enumerate(own)]))
        part = df.select("row_key", "at", wide).where("key is not null")
        out = part if out is None else out.unionByName(part)
    return out


def key_states(tables: dict[str, DataFrame], targets: list[Target], withdrawn: DataFrame) -> DataFrame:
    """target, key, born (null: no such row), gone (withdrawn)."""
    out = withdrawn.select(F.col("original_table").alias("target"), reference_key(F.col("legacy_key")).alias("key"), F.lit(None).cast("long").alias("born"), F.lit(False).alias("there"), F.lit(True).alias("gone"))
    for t in targets:
        out = out.unionByName(tables[t.table].select(F.lit(t.table).alias("target"), reference_key(F.col(t.key).cast("string")).alias("key"), epoch_seconds(F.col("created_at")).alias("born"), F.lit(True).alias("there"), F.lit(False).alias("gone")))
    return out.where("key is not null").groupBy("target", "key").agg(F.min("born").alias("born"), F.max("there").alias("there"), F.max("gone").alias("gone"))


def _grouped(refs: DataFrame) -> DataFrame:
    """ref_field, target, key, period, n, first, last: references per key and month."""
    return refs.groupBy("ref_field", "target", "key", month_text(F.col("at")).alias("period")).agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last"))


def _orphan_groups(groups: DataFrame, states: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """The groups with an orphan: their columns, born and kind (`split`: late are the rows before born); and heavy keys."""
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    counts = groups.groupBy("target", "key").agg(F.sum("n").alias("refs"))
    heavy = scratch.save(counts.where(F.col("refs") * HEAVY_SHARE > F.lit(total)).select("target", "key"))
    n_heavy = heavy.count()
    if n_heavy > HEAVY_SHARE:
        raise AssertionError(f"{n_heavy} heavy keys; by their definition there are at most {HEAVY_SHARE}")
    if n_heavy == 0:
        heavy, resolved = None, groups.join(states, ["target", "key"], "left")
    else:
        few = F.broadcast(heavy)
        # at most one row for each heavy key
        heavy_states = scratch.save(states.join(few, ["target", "key"], "left_semi"))
        known = groups.join(few, ["target", "key"], "left_semi").join(F.broadcast(heavy_states), ["target", "key"], "left")
        resolved = known.unionByName(groups.join(few, ["target", "key"], "left_anti").join(states, ["target", "key"], "left"))
    there = F.coalesce(F.col("there"), F.lit(False))
    kind = (
        F.when(there & (F.col("born") > F.col("last")), "late")
        .when(there & (F.col("born") > F.col("first")), "split")
        .when(there, F.lit(None))
        .when(F.coalesce(F.col("gone"), F.lit(False)), "deleted")
        .otherwise("missing")
    )
    return resolved.select("ref_field", "target", "key", "period", "n", "born", kind.alias("kind")).where("kind is not null"), heavy


#: Parts that the rows of a heavy key and period are cut into where they meet their group in a shuffle.
PARTS = 64


def _opened(refs: DataFrame, groups: DataFrame, heavy: DataFrame | None) -> DataFrame:
    """ref_field, row_key, kind, period of the rows of orphan groups; late rows of split groups are told one by one.

    Rows of heavy keys are cut into PARTS by their own key, each part with a copy of the group, so no task gets all.
    """
    own = groups.select("ref_field", "target", "key", F.coalesce("period", F.lit("")).alias("p"), "born", "kind")
    rows = refs.withColumn("period", month_text(F.col("at"))).withColumn("p", F.coalesce("period", F.lit("")))
    on = ["ref_field", "target", "key", "p"]
    if heavy is None:
        j = rows.join(own, on)
    else:
        few = F.broadcast(heavy)
        name = ["target", "key"]
        cut = rows.join(few, name, "left_semi").withColumn("part", F.pmod(F.xxhash64("row_key"), F.lit(PARTS)).cast("int"))
        copies = own.join(few, name, "left_semi").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        j = rows.join(few, name, "left_anti").join(own.join(few, name, "left_anti"), on).unionByName(cut.join(copies, [*on, "part"]).drop("part"))
    late = F.when(F.col("kind") != "split", F.col("kind")).when(F.col("born") > F.col("at"), "late")
    return j.select("ref_field", "row_key", late.alias("kind"), "period").where("kind is not null")


def orphan_references(tables: dict[str, DataFrame], refs: list[Reference], targets: list[Target], withdrawn: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """ref_field, row_key, kind, period: the referring rows whose reference is deleted, missing or late.

    Null and blank references refer to nothing. A referring row without a readable time has a null period and is
    never late; so is a reference to a row without a readable time. Null row keys are kept as one row key.
    """
    scratch = scratch or Scratch(withdrawn.sparkSession)
    rows = scratch.save(references(tables, refs))
    groups, heavy = _orphan_groups(scratch.save(_grouped(rows)), key_states(tables, targets, withdrawn), scratch)
    return _opened(rows, groups, heavy)


def orphan_report(tables: dict[str, DataFrame], refs: list[Reference], targets: list[Target], withdrawn: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """ref_field, period, kind, n: orphan references per table field and month, from references per key and period."""
    scratch = scratch or Scratch(withdrawn.sparkSession)
    rows = scratch.save(references(tables, refs))
    groups, heavy = _orphan_groups(scratch.save(_grouped(rows)), key_states(tables, targets, withdrawn), scratch)
    groups = scratch.save(groups)
    whole = groups.where("kind <> 'split'").select("ref_field", "period", "kind", "n")
    late = _opened(rows, groups.where("kind = 'split'"), heavy).select("ref_field", "period", "kind", F.lit(1).cast("bigint").alias("n"))
    return whole.unionByName(late).groupBy("ref_field", "period", "kind").agg(F.sum("n").alias("n"))


PROJECT_REFERENCES = [
    Reference("evidence_refs.snapshot_id", "evidence_refs", "evidence_id", "snapshot_id", "source_snapshots"),
    Reference("evidence_refs.claim_id", "evidence_refs", "evidence_id", "claim_id", "claim_proposals"),
    Reference("source_snapshots.previous_snapshot_id", "source_snapshots", "snapshot_id", "previous_snapshot_id", "source_snapshots"),
]
PROJECT_TARGETS = [Target("source_snapshots", "snapshot_id"), Target("claim_proposals", "claim_id")]
