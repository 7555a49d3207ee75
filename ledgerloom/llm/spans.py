"""Long exact spans shared between records of different owners.

Texts become tokens (words with what follows them; stretches without a word start give one token per character), and
token k-mers of at least KMER_CHARS characters are the edges of a De Bruijn graph. Of these, the minima of every
window of starts are kept, sized so that any shared run of min_chars characters holds at least one kept k-mer in
both records. Edges that stand with two owners are joined to their neighbours and nonbranching paths are compacted
by pointer doubling. Source coordinates of the compacted paths then lead back into the texts, where every run of
min_chars characters around a path's ends is hashed anew from the text and compared (see PRIME for what two different
runs' chance of equal hashes is): no shared run is missed, and none shorter is reported.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ledgerloom.runtime import Scratch, slices, small

#: Characters of a token k-mer at least, and the longest stretch without a token start.
KMER_CHARS = 72
TOKEN_CHARS = 24
#: Characters that are worked on at once.
BATCH_CHARS = 1_500_000
#: Records whose numbers may be broadcast (8 bytes each); beyond it the texts are joined by shuffle.
BROADCAST_RECORDS = 500_000
#: Members of one span's group that one task pairs with another such block.
PAIR_BLOCK = 500

_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Texts are hashed as polynomials modulo this prime at random bases, two for a k-mer and four for a run: whatever the
#: texts, two different runs of n characters have equal hashes with a chance below (n / PRIME) ** 4, 2 ** -93 for 180.
PRIME = (1 << 31) - 1
_P = np.uint64(PRIME)


def random_bases() -> tuple[int, ...]:
    """Drawn anew for each call, on the driver, so that no text can be made to collide."""
    return tuple(1_000_000 + secrets.randbelow(PRIME - 2_000_000) for _ in range(4))


def _powers(base: int, n: int) -> np.ndarray:
    """base**i mod PRIME for i < n."""
    p = np.ones(n, np.uint64)
    done, step = 1, base % PRIME
    while done < n:
        more = min(done, n - done)
        p[done : done + more] = p[:more] * np.uint64(step) % _P
        done, step = done + more, step * step % PRIME
    return p


class _Roller:
    """Hashes of any window of a code point array, by prefix sums."""

    def __init__(self, codes: np.ndarray, base: int, powers: dict):
        n = len(codes) + 1
        if base not in powers or len(powers[base][0]) < n:
            size = max(n, BATCH_CHARS + 1)
            powers[base] = _powers(base, size), _powers(pow(base, -1, PRIME), size)
        up, self.down = powers[base]
        self.sums = np.zeros(n, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: n - 1] % _P, out=self.sums[1:])

    def hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.sums[b] - self.sums[a]) % _P * self.down[a] % _P


def _hash62(codes: np.ndarray, bases: tuple[int, ...], a: np.ndarray, b: np.ndarray, powers: dict) -> np.ndarray:
    """Two hashes of the windows [a, b) in one number."""
    one, two = (_Roller(codes, x, powers).hash(a, b) for x in bases)
    return (one << np.uint64(31)) | two


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def _sliding(x: np.ndarray, width: int, f) -> np.ndarray:
    """f (np.minimum or np.maximum) over every window of width; len(x) - width + 1 values."""
    w = 1
    while 2 * w <= width:
        x = f(x[:-w], x[w:])
        w *= 2
    return f(x[: len(x) - (width - w)], x[width - w :]) if w < width else x


def token_starts(codes: np.ndarray, token_chars: int = TOKEN_CHARS) -> np.ndarray:
    """Positions where a token starts: at a word, and everywhere once no word has started for token_chars."""
    word = (codes >= 128) | ((codes >= 48) & (codes <= 57)) | ((codes >= 65) & (codes <= 90)) | ((codes >= 97) & (codes <= 122))
    start = word.copy()
    start[1:] &= ~word[:-1]
    at = np.where(start, np.arange(len(codes)), -1)
    since = np.arange(len(codes)) - np.maximum.accumulate(at)
    none = np.maximum.accumulate(at) < 0
    return np.flatnonzero(start | (since >= token_chars) | (none & (np.arange(len(codes)) >= token_chars)))


def _kept_in_parts(text: str, min_chars: int, powers: dict, bases: tuple[int, ...]) -> tuple[np.ndarray, ...]:
    """kept_kmers of one very long text, part by part; the parts overlap so that any run lies within one."""
    h, pos, size = [], [], []
    for a in range(0, len(text), BATCH_CHARS):
        _, x, p, n = kept_kmers([text[a : a + BATCH_CHARS + 2 * min_chars]], min_chars, powers, bases)
        h.append(x)
        pos.append(p + a)
        size.append(n)
    pos, at = np.unique(np.concatenate(pos), return_index=True)
    return np.zeros(len(pos), np.int64), np.concatenate(h)[at], pos, np.concatenate(size)[at]


def _window(min_chars: int) -> int:
    """The number of neighbouring places of whose k-mers the least is kept.

    Whether a token starts in the first TOKEN_CHARS of a run hangs on what stands before it, and a k-mer may end
    TOKEN_CHARS after its least length: the k-mers that start at the places between are the same in any surroundings.
    No window is wider than a k-mer, so each kept k-mer of a record touches or overlaps the next and a path's
    characters all lie in its k-mers.
    """
    return min(KMER_CHARS, min_chars - KMER_CHARS - 2 * TOKEN_CHARS)


def kept_kmers(texts: list[str], min_chars: int, powers: dict, bases: tuple[int, ...]) -> tuple[np.ndarray, ...]:
    """(record index, k-mer hash, position in the record, length) of the kept k-mers of each text, in order."""
    codes = _codes(texts)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    window = _window(min_chars)
    starts = np.concatenate([token_starts(codes[a:b]) + a for a, b in zip(bounds[:-1], bounds[1:])] or [np.zeros(0, np.int64)])
    nxt = np.searchsorted(starts, starts + KMER_CHARS)
    ok = nxt < len(starts)
    p, q = starts[ok], starts[nxt[ok]]
    rec = np.searchsorted(bounds, p, "right") - 1
    ok = q < bounds[rec + 1]
    p, q, rec = p[ok], q[ok], rec[ok]
    if not len(p):
        z = np.zeros(0, np.int64)
        return z, z.astype(np.uint64), z, z
    h = _mix(_hash62(codes, bases[:2], p, q, powers) ^ ((q - p).astype(np.uint64) << np.uint64(40)))
    h = np.minimum(h, _NONE - np.uint64(1))
    at = np.full(len(codes) + 2 * window, _NONE, np.uint64)
    at[p + window] = h
    low = _sliding(at, window, np.minimum)
    low = np.where(low == _NONE, np.uint64(0), low)
    # a k-mer is kept when it is the least of some window it lies in
    best = _sliding(low, window, np.maximum)[p + 1]
    keep = h == best
    p, q, rec, h = p[keep], q[keep], rec[keep], h[keep]
    return rec, h, p - bounds[rec], q - p


def _in_batches(keys: list, texts: list[str]) -> Iterator[tuple[list, list[str]]]:
    a, n = 0, 0
    for i, t in enumerate(texts):
        if n and n + len(t) > BATCH_CHARS:
            yield keys[a:i], texts[a:i]
            a, n = i, 0
        n += len(t)
    if a < len(texts):
        yield keys[a:], texts[a:]


def _kmer_rows(min_chars: int, bases: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers: dict = {}
        for b in slices(batches, "text"):
            ids = np.stack([b.column("rec").to_numpy(), b.column("owner").to_numpy()], axis=1)
            for part, texts in _in_batches(list(range(len(ids))), b.column("text").to_pylist()):
                long = len(texts) == 1 and len(texts[0]) > BATCH_CHARS + 2 * min_chars
                rec, h, pos, size = _kept_in_parts(texts[0], min_chars, powers, bases) if long else kept_kmers(texts, min_chars, powers, bases)
                own = ids[np.asarray(part, np.int64)[rec]] if len(rec) else np.zeros((0, 2), np.int64)
                first = np.searchsorted(rec, rec)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[:, 0]), pa.array(own[:, 1]), pa.array(h.view(np.int64)), pa.array((np.arange(len(rec)) - first).astype(np.int32)), pa.array(pos.astype(np.int32)), pa.array(size.astype(np.int32))],
                    names=["rec", "owner", "h", "seq", "pos", "size"],
                )

    return run


def _run_hashes(text: str, a: np.ndarray, min_chars: int, powers: dict, bases: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (four, in two numbers) of the runs that start at the sorted places a, stretch by stretch of the text."""
    out1, out2 = [], []
    at = 0
    while at < len(a):
        to = int(np.searchsorted(a, a[at] + BATCH_CHARS))
        codes = _codes([text[a[at] : a[to - 1] + min_chars]])
        p = a[at:to] - a[at]
        for out, two in ((out1, bases[:2]), (out2, bases[2:])):
            out.append(_hash62(codes, two, p, p + min_chars, powers).view(np.int64))
        at = to
    return np.concatenate(out1), np.concatenate(out2)


def _run_rows(min_chars: int, once: bool, bases: tuple[int, ...]):
    """The runs of min_chars around the ends of each compacted path, with their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers: dict = {}
        for b in slices(batches, "text"):
            recs, spans, texts = b.column("rec").to_pylist(), b.column("spans").to_pylist(), b.column("text").to_pylist()
            out = []
            for rec, span, text in zip(recs, spans, texts):
                n = len(text)
                at = np.zeros(n + 1, np.int64)
                for s in span:
                    for a, z in ((s["pos"], s["pos"] + s["size"]), (s["last"], s["end"])):
                        # runs that hold [a, z)
                        lo, hi = max(0, z - min_chars), min(a, n - min_chars)
                        if lo <= hi:
                            at[lo] += 1
                            at[hi + 1] -= 1
                a = np.flatnonzero(np.cumsum(at)[:n] > 0)
                if not len(a):
                    continue
                h1, h2 = _run_hashes(text, a, min_chars, powers, bases)
                if once:
                    order = np.lexsort((h2, h1))
                    new = np.ones(len(order), bool)
                    new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
                    keep = order[new]
                    a, h1, h2 = a[keep], h1[keep], h2[keep]
                out.append((np.full(len(a), rec, np.int64), a.astype(np.int32), h1, h2))
            if out:
                rec, a, h1, h2 = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(rec), pa.array(a), pa.array(h1), pa.array(h2)], names=["rec", "at", "h1", "h2"])

    return run


@dataclass
class Shared:
    """What the passes leave behind: records involved, paths with their coordinates, and the texts they lead to."""

    records: DataFrame
    paths: DataFrame
    min_chars: int
    bases: tuple[int, ...]
    scratch: Scratch

    def runs(self, once: bool) -> DataFrame:
        """rec, at, h1, h2 of the runs at the ends of paths."""
        spans = self.paths.groupBy("rec").agg(F.collect_list(F.struct("pos", "size", "last", "end")).alias("spans"))
        texts = self.records
        involved = self.scratch.save(spans.select("rec"))
        if involved.count() <= BROADCAST_RECORDS:
            texts = texts.join(F.broadcast(involved), "rec", "left_semi")
        texts = texts.select("rec", "text").dropDuplicates(["rec"])
        return texts.join(spans, "rec").select("rec", "text", "spans").mapInArrow(_run_rows(self.min_chars, once, self.bases), "rec bigint, at int, h1 bigint, h2 bigint")


def shared_paths(records: DataFrame, min_chars: int = 180, scratch: Scratch | None = None) -> Shared:
    """Compacted paths of repeated token k-mers. records: rec (64-bit number), owner (64-bit number), text."""
    # a window holds a token start when it has TOKEN_CHARS places
    if _window(min_chars) < TOKEN_CHARS:
        raise ValueError(f"min_chars must be at least {KMER_CHARS + 3 * TOKEN_CHARS}")
    scratch = scratch or Scratch(records.sparkSession)
    bases = random_bases()
    long_enough = records.where(F.length("text") >= min_chars)
    kmers = scratch.save(long_enough.select("rec", "owner", "text").mapInArrow(_kmer_rows(min_chars, bases), "rec bigint, owner bigint, h bigint, seq int, pos int, size int"))
    edges = kmers.groupBy("h").agg(F.min("owner").alias("lo"), F.max("owner").alias("hi")).where("lo <> hi").select("h")
    # one shuffle by record serves both the repeated rows and the neighbours
    occ = kmers.join(edges, "h", "left_semi").repartition("rec").dropDuplicates(["rec", "seq"])
    along = W.partitionBy("rec").orderBy("seq")
    near = lambda f, step: F.when(f("seq").over(along) == F.col("seq") + step, F.struct(f("h").over(along).alias("h"), (F.abs(f("pos").over(along) - F.col("pos"))).alias("d")))
    occ = scratch.save(occ.select("rec", "owner", "h", "pos", "size", near(F.lead, 1).alias("next"), near(F.lag, -1).alias("prev")))
    scratch.drop(kmers)
    steps = occ.select("h", "size", "next", "prev")
    sides = steps.groupBy("h").agg(
        F.max("size").alias("size"), F.count("*").alias("n"),
        *[f(c).alias(f"{c}_{name}") for c in ("next", "prev") for f, name in ((F.count, "n"), (F.min, "lo"), (F.max, "hi"))],
    )
    one = lambda c: F.when((F.col(f"{c}_n") == F.col("n")) & (F.col(f"{c}_lo") == F.col(f"{c}_hi")), F.col(f"{c}_lo"))
    nodes = scratch.save(sides.select("h", "size", one("next").alias("next"), one("prev").alias("prev")))
    # an edge of the compacted graph: the only way on from one k-mer and the only way back from the other
    ahead = nodes.where("next is not null").select(F.col("h").alias("from"), F.col("next.h").alias("h"), F.col("next.d").alias("d"))
    back = nodes.where("prev is not null").select("h", F.col("prev.h").alias("from"), F.col("prev.d").alias("d"))
    links = ahead.join(back, ["h", "from", "d"]).select("h", F.col("from").alias("a"), F.col("d").cast("long").alias("d"))
    state = nodes.select("h").join(links, "h", "left")
    state = scratch.save(state.select("h", F.coalesce("a", "h").alias("a"), F.coalesce("d", F.lit(0)).cast("long").alias("d"), F.col("a").isNull().alias("done")))
    left = None
    while True:
        open_now = state.where("not done").count()
        if open_now in (0, left):
            break  # what is left runs in circles (periodic text) and stays uncompacted
        left = open_now
        step = state.select(F.col("h").alias("a"), F.col("a").alias("a2"), F.col("d").alias("d2"), F.col("done").alias("done2"))
        moved = state.where("not done").join(step, "a").select("h", F.col("a2").alias("a"), (F.col("d") + F.col("d2")).alias("d"), F.col("done2").alias("done"))
        new = scratch.save(state.where("done").unionByName(moved))
        scratch.drop(state)
        state = new
    head = state.select("h", F.when(F.col("done"), F.col("a")).otherwise(F.col("h")).alias("path"), F.when(F.col("done"), F.col("d")).otherwise(0).alias("d"))
    joined = head.join(nodes.select("h", "size"), "h")
    shape = joined.groupBy("path").agg(F.max("d").alias("to_last"), F.max(F.col("d") + F.col("size")).alias("length"))
    at = occ.select(F.col("h").alias("path"), "rec", "owner", "pos", "size").join(shape, "path")
    paths = at.select("path", "rec", "owner", "pos", "size", (F.col("pos") + F.col("to_last")).cast("int").alias("last"), (F.col("pos") + F.col("length")).cast("int").alias("end"))
    paths = scratch.save(paths)
    scratch.drop(occ, nodes, state)
    return Shared(records, paths, min_chars, bases, scratch)


def shared_groups(records: DataFrame, min_chars: int = 180, scratch: Scratch | None = None) -> DataFrame:
    """group, key, owner, probe, rec, n: the records of each group, n of them, that have a run of min_chars characters in
    common, one group for each set of records, however many runs they share.

    Two records of different owners share a run if and only if they are together in some group; so this is the whole
    result in rows that grow with the members, not with their pairs. Only groups of several owners come out. Input and
    edge cases as for shared_pairs (a group of probes alone is none).
    """
    s = shared_paths(records, min_chars, scratch)
    scratch = s.scratch
    who = scratch.save(s.paths.select("rec").distinct().join(records.select("rec", "owner", "probe", "key"), "rec").dropDuplicates(["rec"]))
    runs = scratch.save(s.runs(once=True))
    owned = runs.join(who.select("rec", "owner", "probe"), "rec")
    # runs with the same members are one group, known by two hashes over its members: keep one of them
    sig = owned.groupBy("h1", "h2").agg(F.min("owner").alias("lo"), F.max("owner").alias("hi"), F.min("probe").alias("probes"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("rec")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "rec")).alias("y")).where("lo <> hi and not probes")
    groups = sig.groupBy("n", "x", "y").agg(F.min(F.struct("h1", "h2")).alias("h")).select(F.col("h.h1").alias("h1"), F.col("h.h2").alias("h2"), "n", F.concat(F.lower(F.hex("x")), F.lit("-"), F.lower(F.hex("y"))).alias("group"))
    return scratch.save(runs.select("h1", "h2", "rec").join(groups, ["h1", "h2"]).join(who, "rec").select("group", "key", "owner", "probe", "rec", "n"))


def shared_pairs(records: DataFrame, min_chars: int = 180, scratch: Scratch | None = None) -> DataFrame:
    """(key_a, key_b), key_a < key_b: records of different owners with an identical run of min_chars characters.

    records: key, probe (boolean), rec, owner, text. Two probes are never paired, so probes (quotes) only meet full
    records. Rows that repeat a rec count once; null and shorter texts share nothing; ties and repeats inside a text
    change nothing. Owner null never differs from anything, so such records should be left out before. As many rows
    as there are pairs; `shared_groups` has the same in fewer.
    """
    members = shared_groups(records, min_chars, scratch)
    # large groups are paired block against block
    blocks = F.ceil(F.col("n") / PAIR_BLOCK).cast("int")
    left = members.select("group", "key", "owner", "probe", F.pmod(F.xxhash64(F.lit(2), "rec"), blocks).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("j"))
    right = members.select("group", F.col("key").alias("key2"), F.col("owner").alias("owner2"), F.col("probe").alias("probe2"), F.pmod(F.xxhash64(F.lit(2), "rec"), blocks).cast("int").alias("j"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("i"))
    pairs = left.join(right, ["group", "i", "j"]).where("key < key2 and owner <> owner2 and not (probe and probe2)")
    return pairs.select(F.col("key").alias("key_a"), F.col("key2").alias("key_b")).distinct()


def shared_coverage(records: DataFrame, min_chars: int = 180, scratch: Scratch | None = None) -> DataFrame:
    """key, n_chars, shared_chars, share: how much of each record with a shared span stands with another owner.

    A character is shared when it lies in a run of min_chars characters that another owner has too.
    """
    s = shared_paths(records, min_chars, scratch)
    scratch = s.scratch
    who = scratch.save(s.paths.select("rec").distinct().join(records.select("rec", "owner", "key", F.length("text").alias("n_chars")), "rec").dropDuplicates(["rec"]))
    runs = scratch.save(s.runs(once=False))
    shared = runs.join(who.select("rec", "owner"), "rec").groupBy("h1", "h2").agg(F.min("owner").alias("lo"), F.max("owner").alias("hi")).where("lo <> hi")
    ends = runs.join(shared, ["h1", "h2"]).select("rec", F.col("at").alias("s"), (F.col("at") + min_chars).alias("e"))
    inner = s.paths.where(F.col("end") - F.col("pos") >= min_chars).select("rec", F.col("pos").alias("s"), F.col("end").alias("e"))
    spans = ends.unionByName(inner).groupBy("rec", "s").agg(F.max("e").alias("e"))
    before = W.partitionBy("rec").orderBy("s").rowsBetween(W.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("e") - F.greatest(F.col("s"), F.coalesce(F.max("e").over(before), F.lit(0))))
    total = spans.withColumn("new", new).groupBy("rec").agg(F.sum("new").cast("bigint").alias("shared_chars"))
    return total.join(who, "rec").select("key", F.col("n_chars").cast("bigint").alias("n_chars"), "shared_chars", (F.col("shared_chars") / F.col("n_chars")).alias("share"))


def project_records(snapshots: DataFrame, evidence: DataFrame, min_chars: int = 180, scratch: Scratch | None = None) -> DataFrame:
    """key, probe, rec, owner, text: snapshots with their source, and quotes with the source they cite.

    Evidence whose cited snapshot is absent is left out, as are texts shorter than min_chars and rows without an id
    or a source.
    """
    from ledgerloom.functions.temporal import reference_key

    scratch = scratch or Scratch(snapshots.sparkSession)
    full = snapshots.where((F.length("content") >= min_chars) & F.col("snapshot_id").isNotNull() & F.col("source_id").isNotNull()).select(F.col("snapshot_id").alias("key"), F.lit(False).alias("probe"), F.xxhash64("source_id").alias("owner"), F.col("content").alias("text"))
    owners = snapshots.where("source_id is not null").select(F.lower("snapshot_id").alias("k"), F.xxhash64("source_id").alias("owner")).groupBy("k").agg(F.min("owner").alias("owner"))
    long_quotes = evidence.where(F.length("quote") >= min_chars)
    # the text is joined by the evidence's own id, which no hot snapshot can crowd
    cited = long_quotes.select("evidence_id", reference_key(F.col("snapshot_id")).alias("k")).distinct().join(owners, "k").groupBy("evidence_id").agg(F.min("owner").alias("owner"))
    quotes = scratch.save(long_quotes.select("evidence_id", "quote").join(cited, "evidence_id").select(F.col("evidence_id").alias("key"), F.lit(True).alias("probe"), "owner", F.col("quote").alias("text")))
    # all ids are numbered: their texts need not be read for it
    ids = snapshots.where("snapshot_id is not null").select(F.lit(False).alias("probe"), F.col("snapshot_id").alias("key")).unionByName(quotes.select("probe", "key"))
    return numbered(full.unionByName(quotes), ids, scratch)


def numbered(records: DataFrame, ids: DataFrame, scratch: Scratch) -> DataFrame:
    """records (key, probe, ...) with rec, a 64-bit number that no two of them share. ids: their key and probe at least.

    The number is a hash; keys whose hashes clash, some few among billions, are looked for and hashed again until
    none are left. They are broadcast (their number is checked).
    """
    ids, seed = ids.select("probe", "key").distinct(), 0
    out = records.withColumn("rec", F.xxhash64(F.lit(seed), "probe", "key"))
    ids = ids.withColumn("rec", F.xxhash64(F.lit(seed), "probe", "key"))
    while True:
        seed += 1
        twice = ids.groupBy("rec").agg(F.count("*").alias("n"), F.min(F.struct("probe", "key")).alias("stays")).where("n > 1")
        clash = scratch.save(ids.join(twice, "rec").where(F.struct("probe", "key") != F.col("stays")).select(F.col("probe").alias("p2"), F.col("key").alias("k2")))
        if clash.limit(1).count() == 0:
            return out
        same = (F.col("probe") == F.col("p2")) & (F.col("key") == F.col("k2"))
        again = F.when(F.col("k2").isNotNull(), F.xxhash64(F.lit(seed), "probe", "key")).otherwise(F.col("rec"))
        out, ids = (x.join(small(clash), same, "left").withColumn("rec", again).drop("p2", "k2") for x in (out, ids))
