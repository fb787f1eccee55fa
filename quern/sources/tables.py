"""Intermediate tables and folders in the place that all executors and the driver share, and their end."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_catalogued: dict[str, str] = {}
_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; on a local master without one, a temporary folder of this process.

    Raises ValueError on a cluster that names no shared folder: a machine-local one would lose rows. The session's settings stay as they are.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="quern-"))
    return _local[0]


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which :func:`release` deletes with all that is written there."""
    path = f"{shared_dir(spark)}/quern-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def written(df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: lineage ends here, a lost executor costs a re-read."""
    spark = df.sparkSession
    path = folder(spark, name)
    (df.coalesce(partitions) if partitions else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quern_path = path
    return out


def bucketed(df: DataFrame, name: str, by: str, buckets: int) -> DataFrame:
    """``df`` written once as a table of ``buckets`` buckets by ``by`` in the shared folder: grouping and joining by that column moves no row of it."""
    spark = df.sparkSession
    path = folder(spark, name)
    table = path.rpartition("/")[2].replace("-", "_")
    df.write.bucketBy(buckets, by).option("path", path).format("parquet").saveAsTable(table)
    _catalogued[path] = table
    out = spark.table(table)
    out._quern_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by :func:`written` or :func:`bucketed` that no later plan reads."""
    for table in tables:
        path = getattr(table, "_quern_path", None)
        if path:
            _delete(table.sparkSession, path)
            _written[:] = [w for w in _written if w[1] != path]


def mark() -> int:
    """A point to release from."""
    return len(_written)


def release(since: int = 0, keep: Sequence[DataFrame] = ()) -> None:
    """Delete the tables and folders made since ``since`` (see :func:`mark`), or all, but for ``keep``. Results read them when they are worked out, so call this
    after the last action on any result that reads them."""
    stay = {getattr(t, "_quern_path", None) for t in keep}
    for spark, path in _written[since:]:
        if path not in stay and spark.sparkContext._jsc is not None:
            _delete(spark, path)
    _written[since:] = [w for w in _written[since:] if w[1] in stay]


def _delete(spark: SparkSession, path: str) -> None:
    if path in _catalogued:
        spark.sql(f"DROP TABLE IF EXISTS {_catalogued.pop(path)}")
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clean() -> None:
    try:
        release()
    except Exception:  # noqa: BLE001  the session may be gone at exit
        return
