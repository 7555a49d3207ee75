"""Queries of the subpackage's problems, each over its whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.llm import chunking, mixing, packing, spans, subjects
from ledgerloom.runtime import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "source_snapshots").select("snapshot_id", "content")
    return chunking.oversized_lines(s, "snapshot_id", "content").withColumnRenamed("id", "snapshot_id")


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All pieces of the snapshots over a limit."""
    s = table(spark, d, "source_snapshots").select("snapshot_id", "content")
    return chunking.split_oversized(s, "snapshot_id", "content", keep_small=False).withColumnRenamed("id", "snapshot_id")


def _span_records(spark: SparkSession, d: str) -> DataFrame:
    snaps = table(spark, d, "source_snapshots").select("snapshot_id", "source_id", "content")
    return spans.project_records(snaps, table(spark, d, "evidence_refs").select("evidence_id", "snapshot_id", "quote"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_pairs(_span_records(spark, d))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """In how many groups of records with a common passage each record is, and how many records the largest has."""
    g = spans.shared_groups(_span_records(spark, d))
    return g.groupBy("key").agg(F.count("*").alias("groups"), F.max("n").alias("most_records"))


def p4_shared(spark: SparkSession, d: str) -> DataFrame:
    """How much of each record is shared elsewhere."""
    return spans.shared_coverage(_span_records(spark, d))


def _shares(spark: SparkSession, d: str) -> dict[str, float]:
    """Target shares by source; a few rows by definition (more are refused)."""
    rows = table(spark, d, "mix_targets").where("source is not null and target_share > 0").groupBy("source").agg(F.max("target_share").alias("share")).limit(packing.MAX_SOURCES + 1).collect()
    if len(rows) > packing.MAX_SOURCES:
        raise ValueError(f"a mixture of more than {packing.MAX_SOURCES} sources")
    return {r["source"]: r["share"] for r in rows}


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container, slot and token range of every piece of every text, steered to the target shares."""
    packed = packing.pack_documents(table(spark, d, "documents"), _shares(spark, d))
    return packed.withColumnRenamed("id", "doc_id")


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Tokens used and left in each container, and how far its sources are from the target shares."""
    return packing.fill(p7_containers(spark, d), _shares(spark, d))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """What each source has of each packing partition, against its target share."""
    return packing.part_shares(p7_containers(spark, d), _shares(spark, d))


#: Relative weight of a collection at the start and the end of training, linear between; others are flat.
CURRICULUM = {"field_log": (1.4, 0.6), "transcript": (1.2, 0.8), "lore": (0.6, 1.4), "letters": (0.8, 1.2)}


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sized = mixing.sized_texts(table(spark, d, "documents"), "doc_id", "text", "source")
    return mixing.mix(sized, table(spark, d, "mix_targets"), curriculum=CURRICULUM)


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0].withColumnRenamed("id", "doc_id")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def _subject_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "subject_labels"), table(spark, d, "subject_areas")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.subjects(*_subject_tables(spark, d)).withColumnRenamed("id", "doc_id")


def p9_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Sentences and documents of the corpus by area."""
    s = subjects.subject_shares(*_subject_tables(spark, d))
    deals = (F.col("hits") + 1e-9 >= F.col("sentences") * subjects.SHARE).cast("bigint")
    return s.groupBy("subject").agg(F.sum("hits").alias("sentences"), F.sum(deals).alias("documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_pieces, p4_found, p4_groups, p4_shared, p7_containers, p7_fill, p7_shares, p8_mix, p8_shares, p9_found, p9_corpus)}
_EOL = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
_PARTS = f"regexp_split_to_array(content, '{_EOL}')"
_CITED = r"nullif(lower(regexp_replace(e.snapshot_id, '^[\s\x0b\x1c-\x1f\x{85}\x{a0}]+|[\s\x0b\x1c-\x1f\x{85}\x{a0}]+$', '', 'g')), '')"
_RUNS = f"""with rec as (select false probe, snapshot_id "key", any_value(source_id) "owner", max(content) t from source_snapshots where source_id is not null and length(content) >= 180 group by 2
  union all select true, evidence_id, min(o.source_id), max(quote) from evidence_refs e join (select lower(snapshot_id) k, min(source_id) source_id from source_snapshots where source_id is not null group by 1) o on {_CITED} = o.k where length(quote) >= 180 group by 2),
win as (select probe, "key", "owner", i, hash(substr(t, i, 180)) h from (select *, unnest(range(1, length(t) - 178)) i from rec)),
hot as (select h from win group by h having count(distinct "owner") > 1),"""
SQL: dict[str, str] = {
    "p1_found": f"""with s as (select snapshot_id, max(content) as content from source_snapshots group by 1),
l as (select snapshot_id, content, case when {_PARTS}[-1] = '' then {_PARTS}[:-2] else {_PARTS} end ln from s),
o as (select * from l where octet_length(encode(content)) > 3000 or len(ln) > 60)
select snapshot_id, 0::bigint line_no from o union all select snapshot_id, i from (select snapshot_id, unnest(ln) x, generate_subscripts(ln, 1) i from o) where octet_length(encode(x)) > 3000""",
    # every run of 180 characters of every record, hashed
    "p4_found": f"""{_RUNS} w as (select distinct probe, "key", "owner", h from win where h in (select h from hot)),
g as (select h, list(distinct "key" order by "key") ks from w group by h), one as (select min(h) h from g group by ks)
select distinct a."key" key_a, b."key" key_b from (select * from w where h in (select h from one)) a join w b on a.h = b.h and a."key" < b."key" and a."owner" <> b."owner" and not (a.probe and b.probe)""",
    "p4_groups": f"""{_RUNS} w as (select distinct probe, "key", h from win where h in (select h from hot)),
g as (select list(distinct "key" order by "key") ks from w group by h having not bool_and(probe)), u as (select distinct ks from g)
select "key", count(*) "groups", max(n) most_records from (select unnest(ks) "key", len(ks) n from u) group by 1""",
    "p4_shared": f"""{_RUNS} p as (select "key", i from win where h in (select h from hot)),
c as (select "key", sum(least(180, coalesce(nx - i, 180))) shared_chars from (select *, lead(i) over (partition by "key" order by i) nx from p) group by 1)
select c."key", length(t) n_chars, cast(shared_chars as bigint) shared_chars, shared_chars / length(t) "share" from c join rec using ("key")""",
}
