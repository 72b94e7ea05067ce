"""Where operators keep what later stages read: the folder that the cluster shares between driver and executors.

The folder is the session's ``spark.checkpoint.dir``.  Only where that is unset and the master is local, as in tests, a local one is set;
on a cluster a session without one is refused, as each executor would write to a folder of its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_FOLDER = "/tmp/checkpoints"
#: Characters of text that a Python task turns at a time.
BATCH_CHARS = 500_000
#: Rows that go to Python in one Arrow batch while a table is staged: few, as texts are long.
BATCH_ROWS = 1_000
_ROWS_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: A table is broadcast up to this number of short rows, counted first; beyond it it's joined by shuffle.
FEW_ROWS = 250_000


def shared_folder(spark: SparkSession) -> str:
    """The shared folder as a URI; sets the checkpoint folder where the session has none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        own = spark.sparkContext.getCheckpointDir()
        if not own and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = own or f"file://{DEFAULT_FOLDER}"
        if not own:
            spark.sparkContext.setCheckpointDir(folder)
    return folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/kinfold/{what}-{uuid.uuid4().hex}"


def staged(df: DataFrame, what: str) -> DataFrame:
    """The rows written as Parquet in the shared folder and read again: cuts the lineage, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = new_folder(spark, what)
    with _small_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


@contextmanager
def _small_batches(spark: SparkSession):
    """Small Arrow batches as long as a table of ours is written; then the session's setting holds again."""
    before = spark.conf.get(_ROWS_CONF)
    spark.conf.set(_ROWS_CONF, str(min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(_ROWS_CONF, before)


def remove(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing will read again."""
    for df in tables:
        jvm, spark = df.sparkSession._jvm, df.sparkSession
        path = jvm.org.apache.hadoop.fs.Path(df._staged_at)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def bounded(df: DataFrame, most: int | None = None) -> DataFrame:
    """df with a hint for its join: to broadcast it if it has few rows, which is counted, and to sort and merge else."""
    most = FEW_ROWS if most is None else most
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df.hint("merge")


def open_fs(uri: str):
    """(file system, path) of a URI, usable on any executor."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("file:///", "/") if uri.startswith("file:///") else uri)


class Writer:
    """One file that appears under its name only when whole; names carry a random part, so a repeated task never meets its own leavings."""

    def __init__(self, folder: str, stem: str, suffix: str):
        self.uri = f"{folder}/{stem}-{uuid.uuid4().hex[:12]}{suffix}"
        self.fs, self.path = open_fs(self.uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.path + ".part", compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> str:
        self.out.close()
        self.fs.move(self.path + ".part", self.path)
        return self.uri


def arrow_map(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow.  Batches are bounded by bytes (spark.sql.execution.arrow.maxBytesPerBatch); ``slices`` cuts them further.

    A worker gives back the memory that a task has freed, as it will wait for the next one beside others.
    """

    def tidy(batches):
        yield from run(batches)
        import ctypes

        import pyarrow as pa

        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library, which has no such call
            pass

    return df.mapInArrow(tidy, schema)


def rows_of(batches, columns, most: int = 256) -> Iterator[tuple]:
    """The rows of Arrow batches as tuples of the columns, few at a time."""
    for batch in batches:
        for a in range(0, batch.num_rows, most):
            part = batch.slice(a, most)
            yield from zip(*(part[c].to_pylist() for c in columns))


def slices(batches, column: str, most: int = BATCH_CHARS) -> Iterator:
    """Arrow batches cut so that the texts of one have about ``most`` bytes at most (one text may have more)."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
        upto, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            base = upto[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(upto, base + most, side="right")))
            yield batch.slice(start, end - start)
            start = end


def partitions_for(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def as_long(c) -> F.Column:
    return F.col(c).cast("long") if isinstance(c, str) else c.cast("long")
