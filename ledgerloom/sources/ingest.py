"""Reading text files into rows: formats, decoding, limits and unsafe characters."""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerloom.functions.text import source_lines
from ledgerloom.runtime import slices

# Media types by extension; fixed values.
MEDIA_TYPES = {".txt": "text/plain", ".md": "text/markdown", ".markdown": "text/markdown", ".json": "application/json", ".srt": "application/x-subrip"}
# Limits of a source; fixed values.
MAX_FILE_BYTES, MAX_LINES, MAX_LINE_BYTES = 16 * 1024 * 1024, 200_000, 1024 * 1024
# NUL, ESC, CSI and the bidirectional formatting characters; fixed values.
UNSAFE = "[\\x00\\x1b\\x9b\\u061c\\u200e\\u200f\\u202a-\\u202e\\u2066-\\u2069]"
# Byte order marks, longest first; fixed values.
_MARKS = [(codecs.BOM_UTF32_LE, "utf-32-le"), (codecs.BOM_UTF32_BE, "utf-32-be"), (codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")]


def decode(data: bytes, encoding: str | None = None) -> str | None:
    """Text of a file: the named codec, else the byte order mark's (which is dropped), else UTF-8; None if invalid."""
    try:
        if encoding:
            return data.decode(encoding)
        for mark, codec in _MARKS:
            if data.startswith(mark):
                return data[len(mark) :].decode(codec)
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return None


def read_texts(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """path, media_type, n_bytes, content, problem of each file of a known format under path.

    Files over the byte limit are listed without content (FILE_TOO_LARGE) and never opened. A file whose bytes are not
    valid text has UNDECODABLE; an unknown codec raises LookupError here.
    """
    if encoding:
        codecs.lookup(encoding)  # an unknown codec is the caller's error, told before any file is read
    kinds = "{" + ",".join(f"*{e}" for e in MEDIA_TYPES) + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", kinds).option("recursiveFileLookup", "true").load(path)
    media = F.coalesce(*[F.when(F.lower("path").endswith(e), m) for e, m in MEDIA_TYPES.items()])
    # the reader is given the size limit and the columns, so larger files are listed and never opened
    some = files.where(F.col("length") <= MAX_FILE_BYTES).select("path", media.alias("media_type"), F.col("length").alias("n_bytes"), F.col("content").alias("data"))
    large = files.where(F.col("length") > MAX_FILE_BYTES).select("path", media.alias("media_type"), F.col("length").alias("n_bytes"), F.lit(None).cast("string").alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "data"):
            text = [None if d is None else decode(d, encoding) for d in b.column("data").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("media_type"), b.column("n_bytes"), pa.array(text, pa.string())], names=["path", "media_type", "n_bytes", "content"])

    out = some.mapInArrow(run, "path string, media_type string, n_bytes bigint, content string").unionByName(large)
    problem = F.when(F.col("n_bytes") > MAX_FILE_BYTES, "FILE_TOO_LARGE").when(F.col("content").isNull(), "UNDECODABLE")
    return out.withColumn("problem", problem)


def texts_in_memory(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    """The columns of read_texts for a few texts at hand: (path, media_type, content)."""
    df = spark.createDataFrame(rows, "path string, media_type string, content string")
    size = F.octet_length("content").cast("bigint")
    return df.select("path", "media_type", size.alias("n_bytes"), F.when(size <= MAX_FILE_BYTES, F.col("content")).alias("content"), F.when(size > MAX_FILE_BYTES, "FILE_TOO_LARGE").alias("problem"))


def unsafe_offset(content: Column) -> Column:
    """0-based place of the first unsafe character, null when there is none."""
    at = F.regexp_instr(content, F.lit(UNSAFE))
    return F.when(at > 0, (at - 1).cast("bigint"))


def text_issues(df: DataFrame, key: str, text: str, *, max_bytes: int = MAX_FILE_BYTES, max_lines: int = MAX_LINES, max_line_bytes: int = MAX_LINE_BYTES) -> DataFrame:
    """key, code, at: limits a text breaks and its first unsafe character. Null texts have no issues."""
    lines = source_lines(F.col(text))
    none = F.lit(None).cast("bigint")
    issue = lambda cond, code, at=none: F.when(cond, F.struct(F.lit(code).alias("code"), at.alias("at")))
    found = F.array_compact(
        F.array(
            issue(F.octet_length(text) > max_bytes, "FILE_BYTES"),
            issue(F.size(lines) > max_lines, "LINES", F.size(lines).cast("bigint")),
            issue(F.exists(lines, lambda x: F.octet_length(x) > max_line_bytes), "LINE_BYTES"),
            issue(unsafe_offset(F.col(text)).isNotNull(), "UNSAFE_CONTROL", unsafe_offset(F.col(text))),
        )
    )
    return df.where(F.col(text).isNotNull()).select(key, F.inline(found))
