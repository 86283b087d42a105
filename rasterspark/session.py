"""Session helpers: worker import path, shared scratch folder, materialised steps."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settings of Python workers: Arrow's memory from the C library, in one arena, so that `release` gives it back and a worker
# between tasks holds little (91 instead of 145 MB after encoding text).
_WORKERS = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "1"}
BATCH_BYTES = str(8 << 20)
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_ROOT = str(Path(__file__).resolve().parent.parent)


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it, and bound what they hold at a time.

    On a cluster the package is installed on every node and the extra entry is harmless. Arrow batches get BATCH_BYTES, beside
    their bound in rows, unless the session has a bound of its own: so a batch of very long texts stays small.
    """
    if spark.conf.get(_BATCH, None) in (None, "67108864b", "64m", "64MB"):  # Spark's own
        spark.conf.set(_BATCH, BATCH_BYTES)
    env = spark.sparkContext.environment
    for name, value in _WORKERS.items():
        env.setdefault(name, value)
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *parts])
    return spark


def is_local(master: str) -> bool:
    """Whether driver and executors are one process; local-cluster is not."""
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset a local session uses a folder of this process; on a cluster it is an error.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not is_local(sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="rasterspark-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def _filesystem(spark: SparkSession, path: str):
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def make_dirs(spark: SparkSession, path: str) -> None:
    fs, jpath = _filesystem(spark, path)
    fs.mkdirs(jpath)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of ours through Hadoop, whatever store it is in."""
    fs, jpath = _filesystem(spark, path)
    fs.delete(jpath, True)


_live: list["Scratch"] = []


@contextmanager
def released() -> Iterator[None]:
    """Scratch folders that the block makes go when it ends, so what it leaves must be written elsewhere by then. For one thread."""
    first = len(_live)
    try:
        yield
    finally:
        for scratch in _live[first:]:
            scratch._close()
        del _live[first:]


class Scratch:
    """A folder below the shared one for the intermediate tables of one job.

    `table` writes a DataFrame as Parquet and reads it back, which cuts lineage in a
    way that survives lost executors. The folder goes when the driver process ends, or a `released` block that it
    was made in; `drop` removes a table that no later step reads.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.names: set[str] = set()
        self.path = f"{shared_dir(spark)}/rasterspark/{label}-{uuid.uuid4().hex}"
        make_dirs(spark, self.path)
        _live.append(self)
        atexit.register(self._close)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        at = f"{self.path}/{name}"
        self.names.add(name)
        df.write.option("compression", "zstd").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, name: str) -> None:
        self.names.discard(name)
        remove(self.spark, f"{self.path}/{name}")

    def drop_all_but(self, *kept: str) -> None:
        """Remove every table that no returned plan reads any more."""
        for name in self.names - set(kept):
            self.drop(name)

    def _close(self) -> None:
        try:
            remove(self.spark, self.path)
        except Exception:  # noqa: BLE001 - the JVM may be gone at interpreter exit
            pass
