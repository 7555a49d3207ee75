"""JSON read strictly: no repeated names, no numbers that are none, bounded depth, no unsafe characters in values.

The engine's own readers keep the last of repeated names and accept NaN, so the check runs in Arrow batches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerloom.runtime import slices
from ledgerloom.sources.ingest import MAX_FILE_BYTES

# Codes of the problems; fixed values.
CODES = "FILE_BYTES UNSAFE_CONTROL DUPLICATE_JSON_KEY NONFINITE_JSON_NUMBER INVALID_JSON JSON_NESTING_LIMIT".split()
#: Depth of a source's JSON and of an event's details; fixed values.
MAX_DEPTH, MAX_DETAILS_DEPTH = 256, 128
_UNSAFE = re.compile("[\x00\x1b\x9b\u061c\u200e\u200f\u202a-\u202e\u2066-\u2069]")


class _Problem(ValueError):
    pass


def _pairs(items: list[tuple[str, object]]) -> dict[str, object]:
    out = dict(items)
    if len(out) < len(items):
        raise _Problem("DUPLICATE_JSON_KEY")
    return out


def _no_constant(_: str) -> None:
    raise _Problem("NONFINITE_JSON_NUMBER")


def problem(text: str | None, max_depth: int = MAX_DEPTH, max_bytes: int = MAX_FILE_BYTES) -> str | None:
    """The first problem of a JSON text; None when it is sound or null."""
    if text is None:
        return None
    if len(text.encode("utf-8", "surrogatepass")) > max_bytes:
        return "FILE_BYTES"
    if _UNSAFE.search(text):
        return "UNSAFE_CONTROL"
    try:
        value = json.loads(text, object_pairs_hook=_pairs, parse_constant=_no_constant)
    except _Problem as e:
        return str(e)
    except RecursionError:
        return "JSON_NESTING_LIMIT"
    except ValueError:
        return "INVALID_JSON"
    waiting = [(value, 1)]
    while waiting:
        item, depth = waiting.pop()
        if depth > max_depth:
            return "JSON_NESTING_LIMIT"
        if isinstance(item, str) and _UNSAFE.search(item):
            return "UNSAFE_CONTROL"
        if isinstance(item, dict):
            waiting += [(k, depth + 1) for k in item] + [(v, depth + 1) for v in item.values()]
        elif isinstance(item, list):
            waiting += [(v, depth + 1) for v in item]
    return None


def json_issues(df: DataFrame, key: str, text: str, max_depth: int = MAX_DEPTH, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """key, code of the rows whose text is no sound JSON. Null texts are left out; texts that are too long are told by
    the engine and never handed to Python."""
    rows = df.where(F.col(text).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    long = F.octet_length("text") > max_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            found = [problem(t, max_depth, max_bytes) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(found, pa.string())], names=["key", "code"])

    some = rows.where(~long).mapInArrow(run, "key string, code string").where("code is not null")
    return some.unionByName(rows.where(long).select("key", F.lit("FILE_BYTES").alias("code")))
