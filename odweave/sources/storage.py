"""Frames written to the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar
from functools import cache, wraps

import numpy as np
from pyspark.sql import DataFrame, SparkSession


@cache
def _own_folder() -> str:
    """A folder of this process, for a local master; it goes with the process."""
    path = tempfile.mkdtemp(prefix="odweave-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where driver and executors are one process, on a cluster an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return _own_folder()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/odweave/{name}-{uuid.uuid4().hex}"


#: Whether shuffle files go as soon as the job that wrote them has ended; else they stay until the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Bytes of rows in one Arrow batch: kernels work on pieces of a megabyte, and a batch is held by the JVM and by Python, twice while it grows.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


#: Where the frames lie that the innermost call of a ``passing`` function has stored; None outside of any.
_scope: ContextVar[list[str] | None] = ContextVar("frames", default=None)


def store(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it again: what follows outlives any executor, and nothing before runs twice.

    Nobody reads the shuffles of the write again, so their files go with it. Arrow batches of the session are
    bounded from then on, unless it was started with a bound of its own.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, "frame")
    if not spark.sparkContext.getConf().contains(BATCH):
        spark.conf.set(BATCH, BATCH_BYTES)
    if (mine := _scope.get()) is not None:
        mine.append(path)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def passing(f: Callable) -> Callable:
    """``f``, whose result (a frame, or a tuple of them) is stored; the frames that it has stored on its way go, for nothing else reads them."""

    @wraps(f)
    def settled(*args, **kwargs):
        frames: list[str] = []
        token = _scope.set(frames)
        try:
            try:
                out = f(*args, **kwargs)
            finally:
                _scope.reset(token)
            return tuple(map(store, out)) if isinstance(out, tuple) else store(out)
        finally:
            if frames:
                context = SparkSession.active().sparkContext
                for path in frames:
                    where = context._jvm.org.apache.hadoop.fs.Path(path)
                    where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)

    return settled


def mapped(a: np.ndarray) -> np.ndarray:
    """The array read from a file of this process alone; the file has no name and goes with its last reader."""
    if not a.size:
        return a
    with tempfile.TemporaryFile() as f:
        np.ascontiguousarray(a).tofile(f)
        f.flush()
        return np.memmap(f, a.dtype, "r", shape=a.shape)
