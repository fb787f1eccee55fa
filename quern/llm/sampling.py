"""Bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import scratch


def smallest_hashes(rows: DataFrame, key: str, k: int) -> DataFrame:
    """The ``k`` distinct values of column ``key`` with the smallest hashes (all, if there are fewer), with the least of the row's other columns:
    one row a value, the same ones whatever the partitions are and however often a value repeats. Null keys are left out.

    An estimate of the distinct values gives the hash below which about 2k of them lie, so that tasks send a share of those and not k rows each;
    if fewer than k lie there, the bound is doubled.
    """
    rest = [c for c in rows.columns if c != key]
    rows = rows.where(F.col(key).isNotNull())
    n = rows.agg(F.approx_count_distinct(key, 0.02).alias("n")).first()["n"]
    share = 2.0 * k / max(1, n)
    while True:
        some = rows if share >= 1 else rows.where(F.xxhash64(key) <= F.lit(-(2**63) + int(2**64 * share)))
        one = some.groupBy(key).agg(F.min(F.struct(*rest)).alias("_r")).select(key, "_r.*") if rest else some.distinct()
        chosen = scratch.written(one.orderBy(F.xxhash64(key), key).limit(k), "sample")
        if share >= 1 or chosen.count() >= k:
            return chosen
        scratch.drop(chosen)
        share *= 2
