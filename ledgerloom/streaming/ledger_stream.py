"""An extension: verifying an append-only log per aggregate while it grows, with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "aggregate_id string, sequence bigint, code string"


def _verify(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, last_hash = state.get if state.exists else (0, None)
    rows = []
    # a micro-batch of one aggregate; across batches only (sequence, hash) is kept
    batch = pd.concat(list(frames)).sort_values("sequence")
    for seq, before, own in zip(batch["sequence"], batch["previous_hash"], batch["entry_hash"]):
        if seq <= last:
            rows.append((key[0], int(seq), "OUT_OF_ORDER"))
            continue
        if last_hash is not None and before != last_hash:
            rows.append((key[0], int(seq), "LINK_MISMATCH"))
        last, last_hash = int(seq), own
    state.update((last, last_hash))
    yield pd.DataFrame(rows, columns=["aggregate_id", "sequence", "code"])


def chain_stream(entries: DataFrame) -> DataFrame:
    """aggregate_id, sequence, code of a stream of aggregate_id, sequence, previous_hash, entry_hash.

    Each aggregate is a chain of its own. Late entries (not after the last one verified) are reported, not applied.
    """
    return entries.groupBy("aggregate_id").applyInPandasWithState(_verify, _OUT, "sequence bigint, entry_hash string", "append", GroupStateTimeout.NoTimeout)
