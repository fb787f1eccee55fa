"""Builds of many batches that can be stopped anywhere and taken up again: a log of finished batches, and a fence against runs that were given up."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Of a build's folder: data of all attempts, the log of finished batches, and the runs so far.
DATA, LOG, RUNS = "data", "log", "runs"


class Superseded(RuntimeError):
    """A later run has taken the build over."""


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _created(spark: SparkSession, path: str, text: str) -> bool:
    """Whether this call made the file: of several at once only one does."""
    fs, at = _fs(spark, path)
    if fs.exists(at):
        return False
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(own, True)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.rename(own, at):  # whole or not at all, and not onto a file that is there
        return _read(spark, path) == text
    fs.delete(own, False)
    return False


def _read(spark: SparkSession, path: str) -> str:
    fs, at = _fs(spark, path)
    f = fs.open(at)
    try:
        return bytes(b & 0xFF for b in f.readAllBytes()).decode()
    finally:
        f.close()


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, at = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(at) if not s.getPath().getName().endswith(".tmp")] if fs.exists(at) else []


def finished(spark: SparkSession, root: str) -> dict[int, tuple[int, str]]:
    """The run and attempt that finished each batch so far."""
    out = {}
    for name in _names(spark, f"{root}/{LOG}"):
        run, attempt = _read(spark, f"{root}/{LOG}/{name}").split()
        out[int(name)] = (int(run), attempt)
    return out


def begun(spark: SparkSession, root: str) -> int:
    """A new run's number. From now on no earlier run of the build can finish a batch."""
    run = max([0, *map(int, _names(spark, f"{root}/{RUNS}"))]) + 1
    while not _created(spark, f"{root}/{RUNS}/{run:09d}", uuid.uuid4().hex):
        run += 1
    return run


def build(rows: DataFrame, root: str, batch: Column, batches: int, prepare: Callable[[DataFrame], DataFrame] = lambda df: df, most: int | None = None, check: Callable[[int], None] = lambda k: None) -> int:
    """Prepares and writes those of the ``batches`` batches of ``rows`` (``batch`` gives a row's number, from 0) that no run has finished; returns how many it did.

    Each attempt at a batch writes to a folder of its own and is then entered in the log by one rename; what is not in the log does not count, so a stop at any point leaves whole batches
    only, and the next run takes up where this one ended. Each run has a number; one that sees a greater number raises Superseded before it enters anything, and a batch that is in the log is
    never entered again, so a run that hangs and wakes up adds nothing twice. ``most`` ends the run after so many batches; ``check`` is called with each batch before it is entered (disk and
    memory guards go here). Rows whose batch is null or out of range are an error.
    """
    spark = rows.sparkSession
    run, done = begun(spark, root), finished(spark, root)
    numbered = rows.withColumn("_batch", batch.cast("int"))
    if numbered.where(F.col("_batch").isNull() | (F.col("_batch") < 0) | (F.col("_batch") >= batches)).limit(1).count():
        raise ValueError("rows outside of all batches")
    n = 0
    for k in (k for k in range(batches) if k not in done):
        if most is not None and n >= most:
            break
        attempt = f"{k:09d}-{uuid.uuid4().hex}"
        prepare(numbered.where(F.col("_batch") == k).drop("_batch")).write.parquet(f"{root}/{DATA}/{attempt}")
        check(k)
        if max(map(int, _names(spark, f"{root}/{RUNS}"))) != run:
            raise Superseded(f"run {run}")
        n += _created(spark, f"{root}/{LOG}/{k:09d}", f"{run} {attempt}")
    return n


def built(spark: SparkSession, root: str) -> DataFrame:
    """All rows of finished batches, with ``batch`` and the ``run`` that finished it. LookupError before any is finished."""
    done = finished(spark, root)
    if not done:
        raise LookupError(root)
    rows = spark.read.parquet(*[f"{root}/{DATA}/{attempt}" for _, attempt in done.values()])
    named = spark.createDataFrame([(attempt, k, run) for k, (run, attempt) in done.items()], "_attempt string, batch int, run int")
    attempt = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return rows.withColumn("_attempt", attempt).join(F.broadcast(named), "_attempt").drop("_attempt")
