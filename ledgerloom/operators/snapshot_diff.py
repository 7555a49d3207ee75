"""What changed between full snapshots of a register.

Each content is read into entries sorted by key and cut into content-defined chunks: a chunk ends at a key whose hash
hits a fixed pattern, so an insertion moves no other boundary. Chunks of a snapshot and its predecessor with equal
digests are dropped without opening them; only entries of unmatched chunks are joined by key and classified.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerloom.functions.temporal import reference_key
from ledgerloom.runtime import Scratch, slices, small

#: One key in so many ends a chunk.
CHUNK_KEYS = 16

_CELL = re.compile(r"(?<!\\)\|")


def _text(v: object) -> str:
    if v is None:
        return ""
    if isinstance(v, str):
        return v.strip()
    if isinstance(v, bool):
        return "true" if v else "false"
    return json.dumps(v, ensure_ascii=False, sort_keys=True).strip()


class _Number(str):
    """A JSON number as it is written."""


def _refuse(name: str) -> None:
    raise ValueError(name)


@dataclass(frozen=True)
class Layout:
    """How entries are named: the column or field that is their key, those compared, and the list within an object."""

    key: str = "entry"
    fields: tuple[str, ...] = ("item", "holder", "place", "count", "note")
    under: str = "entries"


def json_entries(content: str, layout: Layout = Layout()) -> list[dict[str, str]] | None:
    """The entries of a JSON register; None when the text is not valid JSON."""
    try:
        doc = json.loads(content.removeprefix("﻿"), parse_int=_Number, parse_float=_Number, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return None
    if isinstance(doc, dict):
        doc = doc.get(layout.under)
    rows = doc if isinstance(doc, list) else []
    return [{k: _text(r.get(k)) for k in (layout.key, *layout.fields)} for r in rows if isinstance(r, dict)]


def table_entries(content: str, layout: Layout = Layout()) -> list[dict[str, str]]:
    """The entries of a Markdown register: the table whose header names the key column."""
    header: list[str] | None = None
    out = []
    for line in content.splitlines():
        line = line.strip()
        if "|" not in line:
            if header and out:
                header = None if not line else header
            continue
        cells = [c.replace("\\|", "|").strip() for c in _CELL.split(line.removeprefix("|"))]
        if line.endswith("|") and not line.endswith("\\|"):
            cells = cells[:-1]
        if header is None:
            names = [c.lower() for c in cells]
            if layout.key in names:
                header = names
            continue
        if all(re.fullmatch(r":?-+:?", c) for c in cells):
            continue
        row = dict(zip(header, cells))
        out.append({k: row.get(k, "") for k in (layout.key, *layout.fields)})
    return out


def _digest(parts: list[str]) -> bytes:
    h = hashlib.blake2b(digest_size=16)
    for p in parts:
        b = p.encode("utf-8", "surrogatepass")
        h.update(len(b).to_bytes(8, "little"))
        h.update(b)
    return h.digest()


def chunks_of(entries: list[dict[str, str]], chunk_keys: int = CHUNK_KEYS, layout: Layout = Layout()) -> list[tuple[bytes, list[tuple[str, bytes]]]]:
    """(digest, [(key, value digest)]) of each content-defined chunk of the key-sorted entries.

    An entry without a key is left out; of entries that repeat a key, the first counts.
    """
    by_key: dict[str, bytes] = {}
    for e in entries:
        if e[layout.key] and e[layout.key] not in by_key:
            by_key[e[layout.key]] = _digest([e[f] for f in layout.fields])
    out, run = [], []
    for k in sorted(by_key):
        run.append((k, by_key[k]))
        if int.from_bytes(hashlib.blake2b(k.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little") % chunk_keys == 0:
            out.append((_digest([x for key, v in run for x in (key, v.hex())]), run))
            run = []
    if run:
        out.append((_digest([x for key, v in run for x in (key, v.hex())]), run))
    return out


_CHUNK_SCHEMA = "id string, prev string, media string, ok boolean, digest binary, chunks array<struct<digest:binary,rows:array<struct<k:string,d:binary>>>>"


def _parsed(layout: Layout):
    row = pa.struct([("k", pa.string()), ("d", pa.binary())])
    chunk = pa.struct([("digest", pa.binary()), ("rows", pa.list_(row))])
    kind = pa.schema([("id", pa.string()), ("prev", pa.string()), ("media", pa.string()), ("ok", pa.bool_()), ("digest", pa.binary()), ("chunks", pa.list_(chunk))])

    def read(b: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, list] = {f.name: [] for f in kind}
        for i, prev, media, content in zip(*(b.column(c).to_pylist() for c in ("id", "prev", "media_type", "content"))):
            entries = (json_entries if "json" in (media or "").lower() else table_entries)(content or "", layout)
            chunks = [] if entries is None else chunks_of(entries, layout=layout)
            values = (i, prev, media, entries is not None, _digest([d.hex() for d, _ in chunks]), [{"digest": d, "rows": [{"k": k, "d": v} for k, v in rows]} for d, rows in chunks])
            for name, v in zip(out, values):
                out[name].append(v)
        return pa.RecordBatch.from_pydict(out, schema=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "content"):
            yield read(b)

    return run


def register_changes(snapshots: DataFrame, registers: DataFrame, layout: Layout = Layout(), scratch: Scratch | None = None) -> DataFrame:
    """snapshot_id, entry, change (added, removed or changed) of each register snapshot against its predecessor.

    `snapshots` has snapshot_id, source_id, previous_snapshot_id, media_type, content; `registers` has the source_id
    of the registers. Only pairs whose two snapshots are registers in the table are compared; if a JSON content of
    either is not valid JSON the pair gives no rows. Null contents are empty. Repeated snapshots count once. A
    snapshot that names itself has no changes. Predecessors compare after trimming and lower-casing.

    Contents are read where they lie (the sources that are registers come by a checked broadcast, beyond it the rows
    are joined); only chunk digests are moved, and the entries of chunks that have no counterpart.
    """
    scratch = scratch or Scratch(snapshots.sparkSession)
    wanted = small(scratch.save(registers.select("source_id").distinct()))
    own = snapshots.join(wanted, "source_id", "left_semi").where("snapshot_id is not null")
    own = own.select(F.col("snapshot_id").alias("id"), reference_key(F.col("previous_snapshot_id")).alias("prev"), "media_type", "content")
    read = own.mapInArrow(_parsed(layout), _CHUNK_SCHEMA)
    one = scratch.save(read.groupBy("id").agg(F.min("prev").alias("prev"), F.min(F.struct("media", "digest", "ok", "chunks")).alias("x")).select("id", "prev", "x.ok", "x.chunks"))
    readable = one.where("ok")
    pairs = scratch.save(
        readable.where("prev is not null").select(F.col("id").alias("pair"), "prev").join(readable.select(F.lower("id").alias("prev"), F.col("id").alias("old")), "prev").select("pair", "old")
    )
    body = readable.select("id", F.inline("chunks"))
    mark = readable.select("id", F.explode("chunks.digest").alias("digest"))
    new = pairs.select("pair", F.col("pair").alias("id"), F.lit(1).alias("side"))
    old = pairs.select("pair", F.col("old").alias("id"), F.lit(2).alias("side"))
    # a chunk digest stands at most once on each side; on both it is unchanged
    sides = new.unionByName(old).join(mark, "id").groupBy("pair", "digest").agg(F.sum("side").alias("sides"), F.max("id").alias("id")).where("sides < 3")
    rows = sides.join(body, ["id", "digest"]).select("pair", "sides", F.inline("rows"))
    both = rows.groupBy("pair", "k").agg(F.max(F.when(F.col("sides") == 1, F.col("d"))).alias("new"), F.max(F.when(F.col("sides") == 2, F.col("d"))).alias("old"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return both.select(F.col("pair").alias("snapshot_id"), F.col("k").alias("entry"), change.alias("change")).where("change is not null")
