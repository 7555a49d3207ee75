"""Filling fixed-capacity containers with texts, steered to target proportions of their sources.

One schedule is made for all texts: at every place of the token stream the sources that are not yet used up have their
shares, scaled to sum to 1, so all texts come out and the proportions hold as long as each source lasts. A text's place
follows from the tokens of its source before it, and packing partitions are stretches of the stream. In each partition
a deficit round robin over the source queues fills one window after another: a window grants each source its share of
the capacity, the source with the largest deficit places the largest of its texts that still fits, and what the
sources are owed is carried to the next window. Partitions pack at the same time: what a partition's sources are owed
at its start is the schedule less what the partitions before have got, known before packing starts.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ledgerloom.llm.tokens import TOKENIZER, token_counts
from ledgerloom.runtime import Scratch, small

CAPACITY = 2_048
#: Tokens and texts per packing partition.
PART_TOKENS = 4_000_000
PART_ROWS = 50_000
#: Source queues of one mixture; more is refused, never cut.
MAX_SOURCES = 10_000

_OUT = "part bigint, container bigint, slot bigint, id bigint, piece_no bigint, token_start bigint, n_tokens bigint, source string"


def pack_queues(items: list[tuple[int, int, int, int, str]], shares: dict[str, float], carried: dict[str, float], capacity: int) -> list[list[tuple[int, int, int, int, str]]]:
    """Windows of items (n_tokens, id, piece_no, token_start, source), none over capacity, none left out."""
    queues: dict[str, list] = {}
    for item in sorted(items):
        queues.setdefault(item[4], []).append(item)
    owed = {s: carried.get(s, 0.0) for s in queues}
    left, windows = len(items), []
    while left:
        room, window = capacity, []
        # sources that are used up leave their share to the others
        whole = sum(shares.get(s, 0.0) for s, q in queues.items() if q)
        for s, q in queues.items():
            if q and whole:
                owed[s] += shares.get(s, 0.0) / whole * capacity
        while left:
            best = None
            for steer in (True, False):
                for s, q in queues.items():
                    if not q or steer and owed[s] <= 0:
                        continue
                    i = bisect_right(q, (room, float("inf"))) - 1
                    if i < 0:
                        continue
                    # owed sources in the order of their deficits; else whatever leaves the least room
                    rank = (owed[s], q[i][0]) if steer else (q[i][0], owed[s])
                    if best is None or rank > best[0]:
                        best = (rank, s, i)
                if best:
                    break
            if best is None:
                break
            item = queues[best[1]].pop(best[2])
            owed[item[4]] -= item[0]
            room -= item[0]
            left -= 1
            window.append(item)
        windows.append(window)
    return windows


def _pack_part(shares: dict[str, float], capacity: int):
    def run(key, docs: pd.DataFrame, carry: pd.DataFrame) -> pd.DataFrame:
        items = []
        for i, source, n in zip(docs["id"], docs["source"], docs["n_tokens"]):
            for no, at in enumerate(range(0, max(n, 1), capacity)):
                items.append((min(capacity, n - at), i, no, at, source))
        carried = dict(zip(carry["source"], carry["carried"]))
        rows = [
            (key[0], w, slot, i, no, at, n, source)
            for w, window in enumerate(pack_queues(items, shares, carried, capacity))
            for slot, (n, i, no, at, source) in enumerate(window)
        ]
        return pd.DataFrame(rows, columns=["part", "container", "slot", "id", "piece_no", "token_start", "n_tokens", "source"])

    return run


#: Buckets of a source per packing partition; the texts of a bucket have one place in the stream.
BUCKETS = 8


@dataclass
class Schedule:
    """Who is served when: time runs at the same rate for all sources, and a source gets share tokens per unit of it."""

    sources: list[str]
    shares: np.ndarray
    supply: np.ndarray

    def __post_init__(self):
        self.ends = self.supply / self.shares
        self.times = np.unique(np.concatenate([[0.0], self.ends]))
        self.tokens = np.array([np.minimum(self.shares * t, self.supply).sum() for t in self.times])

    def place(self, time: np.ndarray) -> np.ndarray:
        """Tokens of all sources until a time."""
        return np.interp(time, self.times, self.tokens)

    def got(self, place: np.ndarray) -> np.ndarray:
        """Tokens of each source (columns) until places of the stream."""
        time = np.interp(place, self.tokens, self.times)
        return np.minimum(self.shares[None, :] * time[:, None], self.supply[None, :])


def _part_of(schedule: Schedule, part_tokens: int):
    """The partition in which each bucket of a source lies: that of the middle of its tokens."""
    number = {s: i for i, s in enumerate(schedule.sources)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = np.array([number[s] for s in b.column("source").to_pylist()], np.int64)
            middle = b.column("before").to_numpy() + b.column("got").to_numpy() / 2
            part = (schedule.place(middle / schedule.shares[i]) // part_tokens).astype(np.int64) if len(i) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("source"), b.column("bucket"), b.column("got"), pa.array(part)], names=["source", "bucket", "got", "part"])

    return run


def schedule_of(own: dict[str, int], shares: dict[str, float]) -> Schedule:
    """The schedule of sources with so many tokens. Sources without a share get their part of all tokens."""
    total = sum(own.values())
    wanted = {s: max(shares.get(s, n / total if total else 1.0), 1e-9) for s, n in own.items()}
    scale = sum(wanted.values())
    return Schedule(list(own), np.array([w / scale for w in wanted.values()]), np.array([float(n) for n in own.values()]))


def pack_sized(sized: DataFrame, shares: dict[str, float], *, capacity: int = CAPACITY, scratch: Scratch | None = None, part_tokens: int = PART_TOKENS, part_rows: int = PART_ROWS) -> DataFrame:
    """part, container, slot, id, piece_no, token_start, n_tokens, source: where every text lies.

    `sized` has id, source, n_tokens. A container is (part, container). A text over capacity is cut into full pieces
    and a rest; every other text is one piece. Texts without tokens take a slot of size 0. Sources absent from
    `shares` get their part of the corpus, and all shares are scaled to sum to 1; a source with a share of 0 comes
    last. A null source is the source ''. Rows without an id, which no result could name, are left out; repeated rows
    are packed as often as they stand.
    """
    scratch = scratch or Scratch(sized.sparkSession)
    docs = sized.where("id is not null").select(F.col("id").cast("bigint").alias("id"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce(F.col("n_tokens"), F.lit(0)).cast("bigint").alias("n_tokens"))
    docs = scratch.save(docs)
    own = docs.groupBy("source").agg(F.sum("n_tokens").alias("got"), F.count("*").alias("rows")).limit(MAX_SOURCES + 1).toPandas()
    if len(own) > MAX_SOURCES:
        raise ValueError(f"a mixture of more than {MAX_SOURCES} sources")
    total, rows = int(own["got"].sum()), int(own["rows"].sum())
    schedule = schedule_of(dict(zip(own["source"], (int(n) for n in own["got"]))), shares)
    parts = max(1, -(-total // part_tokens), -(-rows // part_rows))
    stretch = max(1, -(-total // parts))
    docs = docs.withColumn("bucket", F.pmod(F.xxhash64("id", "n_tokens"), F.lit(BUCKETS * parts)).cast("bigint"))
    buckets = docs.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("got"))
    before = F.coalesce(F.sum("got").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = scratch.save(buckets.withColumn("before", before).mapInArrow(_part_of(schedule, stretch), "source string, bucket bigint, got bigint, part bigint"))
    supply = scratch.save(placed.groupBy("part", "source").agg(F.sum("got").alias("got")))
    carry = _carried(supply, schedule)
    with_part = docs.join(small(placed.select("source", "bucket", "part")), ["source", "bucket"])
    return with_part.groupBy("part").cogroup(carry.groupBy("part")).applyInPandas(_pack_part(dict(zip(schedule.sources, schedule.shares)), capacity), _OUT)


def _carried(supply: DataFrame, schedule: Schedule) -> DataFrame:
    """part, source, carried: what each source is owed at the start of each partition."""
    spark = supply.sparkSession
    number = spark.createDataFrame([(s, i) for i, s in enumerate(schedule.sources)], "source string, i int") if schedule.sources else spark.createDataFrame([], "source string, i int")
    at = supply.groupBy("part").agg(F.sum("got").alias("all")).withColumn("start", F.coalesce(F.sum("all").over(W.partitionBy(F.lit(0)).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    # one row for each partition and source, at most MAX_SOURCES a partition
    full = at.select("part", "start", F.explode(F.array(*[F.lit(s) for s in schedule.sources]) if schedule.sources else F.array(F.lit(""))).alias("source")).join(supply, ["part", "source"], "left")
    had = F.coalesce(F.sum(F.coalesce("got", F.lit(0))).over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    known = full.withColumn("had", had).join(F.broadcast(number), "source")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            start, place = np.unique(b.column("start").to_numpy(), return_inverse=True)
            owed = schedule.got(start)[place, b.column("i").to_numpy()] - b.column("had").to_numpy() if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("source"), pa.array(owed, pa.float64())], names=["part", "source", "carried"])

    return known.select("part", "source", "start", "had", "i").mapInArrow(run, "part bigint, source string, carried double")


def pack_documents(df: DataFrame, shares: dict[str, float], *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """Pack whole texts, sized in tokens; see pack_sized. Repeated rows are packed as often as they stand."""
    return pack_sized(token_counts(df, id_col, text_col, [source_col], tokenizer).withColumnRenamed(source_col, "source"), shares, capacity=capacity)


def fill(packed: DataFrame, shares: dict[str, float], capacity: int = CAPACITY) -> DataFrame:
    """part, container, pieces, used, left_over, off_target of each container.

    off_target is the part of a container's tokens that would have to be of other sources for it to have the shares
    (0: as asked; sources without a share count as asked for with 0); null for a container without tokens. Late
    containers are off as sources run out.
    """
    whole = sum(shares.values()) or 1.0
    per = packed.groupBy("part", "container", "source").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("k"))
    want = F.lit(0.0)
    for s, x in shares.items():
        want = F.when(F.col("source") == s, F.lit(x / whole)).otherwise(want)
    used = F.sum("n").over(W.partitionBy("part", "container"))
    over = F.greatest(F.lit(0.0), F.try_divide(F.col("n"), F.col("used")) - want)
    out = per.withColumn("used", used).withColumn("over", over).groupBy("part", "container").agg(F.sum("k").alias("pieces"), F.first("used").alias("used"), F.sum("over").alias("off_target"))
    return out.select("part", "container", "pieces", "used", (F.lit(capacity) - F.col("used")).alias("left_over"), "off_target")


def part_shares(packed: DataFrame, shares: dict[str, float]) -> DataFrame:
    """part, source, tokens, share, target_share: what each source has of each packing partition.

    The partitions follow the schedule, so the shares are the targets until a source runs out; what is left over of
    the larger sources fills the last partitions. Sources without a target have a null one.
    """
    whole = sum(shares.values()) or 1.0
    want = F.lit(None).cast("double")
    for s, x in shares.items():
        want = F.when(F.col("source") == s, F.lit(x / whole)).otherwise(want)
    per = packed.groupBy("part", "source").agg(F.sum("n_tokens").alias("tokens"))
    return per.select("part", "source", "tokens", F.try_divide(F.col("tokens"), F.sum("tokens").over(W.partitionBy("part"))).alias("share"), want.alias("target_share"))
