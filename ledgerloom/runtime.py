"""Session helpers: table access and tables kept in the cluster's shared folder."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings sources source_snapshots "
    "claim_proposals evidence_refs legacy_records subject_labels subject_areas mix_targets"
).split()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application, wherever the driver was started."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="ledgerloom-")) / "ledgerloom.zip"
    with zipfile.ZipFile(out, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(out))
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir where the session names one.

    Only a session on a local master (tests, a laptop), whose executors are the driver itself, may go without that
    setting and gets a folder of its own; on any other master each executor would write to its own disk, so it is
    refused.
    """
    sc = spark.sparkContext
    root = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {sc.master} share")
        root = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        sc.setCheckpointDir(root)
        root = sc.getCheckpointDir()
    return root.rstrip("/")


#: Rows of a few short columns (some 50 MB) that may be broadcast, after they have been counted.
BROADCAST_ROWS = 500_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if it was counted to have at most so many rows, else to be joined as it is.

    df has to be a written table (see Scratch.save), so that the count is cheap and holds.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Bytes of one column that Python works on at once.
SLICE_BYTES = 3_000_000


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that a text or binary column has about `size` bytes in each, one row at least."""
    for b in batches:
        ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(b.column(column)), 0).cast(pa.int64())).to_numpy(zero_copy_only=False) if b.num_rows else []
        at = 0
        while at < b.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(ends.searchsorted(done + size, "right")))
            yield b.slice(at, to - at)
            at = to


class Scratch:
    """Intermediate tables written to the shared folder, which cuts lineage and survives lost executors.

    A table is dropped as soon as its successor is written (`drop`), the rest when the application ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_root(spark)}/ledgerloom-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(self._delete, self.base)

    def save(self, df: DataFrame, *, partitions: int | None = None, count: dict[str, Column] | None = None) -> DataFrame:
        """df, written and read again. With `count`, how many rows meet each condition is told by the write itself
        (see `counted`), not by another job."""
        self._n += 1
        path = f"{self.base}/t{self._n}"
        if partitions:
            df = df.coalesce(partitions)
        seen = Observation() if count else None
        rows = df.observe(seen, *[F.count_if(c).alias(k) for k, c in count.items()]) if count else df
        rows.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        if count:
            got = seen.get
            # a plan that was found to be empty while it ran may have lost its counters
            out._counted = {k: got[k] if got.get(k) is not None else out.where(c).count() for k, c in count.items()}
        return out

    @staticmethod
    def counted(df: DataFrame, name: str) -> int:
        return df._counted[name]

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            if path := getattr(df, "_scratch_path", None):
                self._delete(path)

    def _delete(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM has gone: nothing left to tidy
            pass


def local_session(cpus: int | None = None, app: str = "ledgerloom", **conf: str) -> SparkSession:
    n = cpus or os.cpu_count() or 8
    builder = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
