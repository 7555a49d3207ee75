"""Mixing sources to target shares of all tokens, along a curriculum.

Each source has a weight schedule over training time [0, 1]. Its integral is the source's cumulative token demand;
inverting it at the cumulative tokens of the source's texts (in a hashed order, pass after pass up to max_repeats)
gives every copy of a text its training position, and the mix is range-sorted by position.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ledgerloom.llm.tokens import TOKENIZER, encoding
from ledgerloom.runtime import Scratch, slices

#: Sources of one mix; more is refused. Tables of one row per source are broadcast under this bound.
MAX_SOURCES = 10_000
#: Texts per block of a source when cumulative tokens are summed.
BLOCK_ROWS = 20_000


def sized_texts(df: DataFrame, id_col: str, text_col: str, source_col: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """id, source, n_tokens, digest of every row with an id; null texts count as empty."""
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(tokenizer).encode_ordinary
        for b in slices(batches, "text"):
            texts = [t or "" for t in b.column("text").to_pylist()]
            n = pa.array([len(encode(t)) for t in texts], pa.int64())
            d = pa.array([hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("source"), n, d], names=["id", "source", "n_tokens", "digest"])

    return rows.mapInArrow(run, "id bigint, source string, n_tokens bigint, digest binary")


def _demand(pool: DataFrame, targets: DataFrame, total_tokens: int | None, curriculum: dict[str, tuple[float, float]], scratch: Scratch) -> DataFrame:
    """One row per targeted source: supply, cap, demand and the ends of its schedule."""
    t = targets.where("source is not null").groupBy("source").agg(F.max(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("target_share"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).cast("bigint").alias("max_repeats"))
    t = t.withColumn("share", F.try_divide(F.col("target_share"), F.sum("target_share").over(W.partitionBy(F.lit(0)))))
    supply = pool.groupBy("source").agg(F.sum("n_tokens").alias("supply"), F.count("*").alias("texts"))
    d = t.join(supply, "source", "left").fillna({"supply": 0, "texts": 0})
    whole = F.lit(float(total_tokens)) if total_tokens is not None else F.sum("supply").over(W.partitionBy(F.lit(0))).cast("double")
    d = d.withColumn("wanted", F.coalesce(F.col("share"), F.lit(0.0)) * whole).withColumn("demand", F.least("wanted", (F.col("supply") * F.col("max_repeats")).cast("double")))
    a = b = F.lit(1.0)
    for s, (lo, hi) in curriculum.items():
        a, b = F.when(F.col("source") == s, F.lit(float(lo))).otherwise(a), F.when(F.col("source") == s, F.lit(float(hi))).otherwise(b)
    d = scratch.save(d.withColumn("w0", a).withColumn("w1", b), partitions=1)
    if d.count() > MAX_SOURCES:
        raise ValueError(f"a mix of more than {MAX_SOURCES} sources")
    return d


def mix(sized: DataFrame, targets: DataFrame, *, total_tokens: int | None = None, curriculum: dict[str, tuple[float, float]] | None = None, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(mix, shares). mix: position, source, id, copy, n_tokens sorted by position; shares: what each source reached.

    * Exact copies of a text are one text, kept under its smallest id among the targeted sources, so no text is used
      more than max_repeats times. Sources without a target have no part; targets without texts reach nothing.
    * total_tokens defaults to the tokens of all targeted texts. A source whose share cannot be reached gives all
      its texts max_repeats times; the others keep their share of total_tokens.
    * curriculum has the relative weight of a source at the start and at the end of training, linear between; sources
      without one are flat.
    * A copy is taken when the middle of its tokens lies within the source's demand, so a source ends within one text
      of it. Target shares are scaled to sum to 1; null shares are 0, null max_repeats 1.
    """
    scratch = scratch or Scratch(sized.sparkSession)
    named = targets.where("source is not null").select("source").distinct()
    if named.limit(MAX_SOURCES + 1).count() > MAX_SOURCES:
        raise ValueError(f"a mix of more than {MAX_SOURCES} sources")
    own = sized.join(F.broadcast(named), "source", "left_semi")
    pool = own.groupBy("digest").agg(F.min(F.struct("id", "source", "n_tokens")).alias("t")).select("t.*")
    pool = scratch.save(pool)
    d = _demand(pool, targets, total_tokens, curriculum or {}, scratch)
    blocks = max(1, -(-pool.count() // BLOCK_ROWS))
    p = pool.withColumn("h", F.xxhash64(F.lit(7), "id")).withColumn("b", F.pmod("h", F.lit(blocks)))
    in_block = W.partitionBy("source", "b").orderBy("h", "id").rowsBetween(W.unboundedPreceding, -1)
    sums = p.groupBy("source", "b").agg(F.sum("n_tokens").alias("m"))
    starts = sums.select("source", "b", F.coalesce(F.sum("m").over(W.partitionBy("source").orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("at"))
    p = p.withColumn("c", F.coalesce(F.sum("n_tokens").over(in_block), F.lit(0))).join(starts, ["source", "b"])
    p = p.join(F.broadcast(d.select("source", "supply", "max_repeats", "demand", "w0", "w1")), "source").where("demand > 0")
    passes = F.least(F.col("max_repeats"), F.ceil(F.try_divide(F.col("demand"), F.col("supply").cast("double")))).cast("int")
    p = p.withColumn("copy", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), passes) - 1)))
    mid = F.col("copy") * F.col("supply") + F.col("at") + F.col("c") + F.col("n_tokens") / 2
    p = p.withColumn("u", F.try_divide(mid, F.col("demand"))).where("u < 1")
    # W(t) = (w0 t + (w1 - w0) t^2 / 2) / ((w0 + w1) / 2) = u
    bend = F.col("w1") - F.col("w0")
    t = F.when(F.abs(bend) < 1e-9, F.col("u")).otherwise((F.sqrt(F.col("w0") ** 2 + (F.col("w1") ** 2 - F.col("w0") ** 2) * F.col("u")) - F.col("w0")) / bend)
    out = scratch.save(p.select(t.alias("position"), "source", "id", F.col("copy").cast("bigint").alias("copy"), "n_tokens"))
    got = out.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("uses"), (F.max("copy") + 1).alias("most_uses"))
    shares = d.join(got, "source", "left").fillna({"tokens": 0, "uses": 0, "most_uses": 0})
    whole = F.sum("tokens").over(W.partitionBy(F.lit(0)))
    shares = shares.select("source", "target_share", F.coalesce(F.try_divide(F.col("tokens"), whole), F.lit(0.0)).alias("actual_share"), "tokens", "supply", "texts", "uses", "most_uses", "max_repeats", (F.col("demand") >= F.col("wanted")).alias("reached"))
    return out.orderBy("position", "source", "id", "copy"), shares
