"""Token counts of texts under a public tokenizer, whose file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerloom.runtime import slices

#: Name of the vocabulary among the public tokenizers; any path to a .tiktoken file may stand instead.
TOKENIZER = "byte_bpe_50k.tiktoken"


@lru_cache(maxsize=2)
def encoding(tokenizer: str = TOKENIZER):
    """The tokenizer as a tiktoken Encoding, once per Python worker."""
    import public_tokenizers
    import tiktoken

    path = tokenizer if "/" in tokenizer else public_tokenizers.path(tokenizer)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, id_col: str, text_col: str, carry: list[str], tokenizer: str = TOKENIZER) -> DataFrame:
    """id, the carried columns, n_tokens of each row; a null text has 0 tokens, like an empty one; rows without an id are left out."""
    kept = [F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(carry)]
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), *kept, F.col(text_col).alias("text"))
    names = ["id", *(f"c{i}" for i in range(len(carry)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(tokenizer).encode_ordinary
        for b in slices(batches, "text"):
            n = pa.array([len(encode(t)) if t else 0 for t in b.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), n], names=[*names, "n_tokens"])

    ddl = "id bigint, " + "".join(f"{c} string, " for c in names[1:]) + "n_tokens bigint"
    out = rows.mapInArrow(run, ddl)
    return out.select("id", *(F.col(f"c{i}").alias(c) for i, c in enumerate(carry)), "n_tokens")
