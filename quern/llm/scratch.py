"""Intermediate tables of the training-text operators, and what keeps their batches small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from quern.sources.tables import bucketed, drop, mark, release, shared_dir, written

__all__ = ["BATCH_BYTES", "bounded", "bucketed", "drop", "fresh", "mark", "release", "shared_dir", "shuffled", "written"]

BATCH_BYTES = 4 << 20


def bounded(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches hold at most BATCH_BYTES, so that long texts don't fill a Python worker. Spark reads this setting when a
    result is worked out, so it stays; a session that sets ``spark.sql.execution.arrow.maxBytesPerBatch`` to less keeps its own value."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    given = str(conf.get(name)).lower().removesuffix("b")
    if not (given.isdigit() and 0 < int(given) <= BATCH_BYTES):
        conf.set(name, str(BATCH_BYTES))
    return df


def shuffled(left: DataFrame, right: DataFrame, on: str | list[str] | Column, how: str = "inner") -> DataFrame:
    """The join with both sides shuffled, whatever their sizes and ``spark.sql.autoBroadcastJoinThreshold``: a broadcast side is built on the driver, and what
    a small file holds may take many times its bytes there."""
    return left.join(right.hint("merge"), on, how)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores put before it until ``df`` has no such column, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
