"""Ranks, running sums and order statistics of groups of any size: no task holds a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.sources import tables


def running_sums(rows: DataFrame, by: Sequence[str], order: Sequence[Column], amounts: dict[str, Column]) -> DataFrame:
    """``rows`` with, for each of ``amounts``, its running sum within the groups ``by`` in the given order, and ``all_<name>``, the group's sum.

    Rows are dealt into ranges of (group, order), written once, and summed within each range; what lies before a range is a sum over ranges, a
    table of at most groups x ranges that one group touches. The order must be total within a group, or rows that tie take an arbitrary turn.
    """
    ranged = rows.withColumns({f"_amount_{k}": c for k, c in amounts.items()})
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = tables.written(ranged.repartitionByRange(n, *[F.col(c) for c in by], *order).withColumn("_range", F.spark_partition_id()), "ranges")
    ends = ranged.groupBy(*by, "_range").agg(*[F.sum(f"_amount_{k}").alias(f"_in_{k}") for k in amounts])
    group = Window.partitionBy(*by)
    earlier = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_range").alias("_own"), *[x for k in amounts for x in (F.coalesce(F.sum(f"_in_{k}").over(earlier), F.lit(0)).alias(f"_before_{k}"), F.sum(f"_in_{k}").over(group).alias(f"all_{k}"))])
    local = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ranged.withColumns({k: F.sum(f"_amount_{k}").over(local) for k in amounts})
    same = F.col("_range") == F.col("_own")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    out = out.join(ends, same).withColumns({k: F.col(k) + F.col(f"_before_{k}") for k in amounts})
    return out.select(*[c for c in rows.columns if c not in amounts], *amounts, *[f"all_{k}" for k in amounts])


def ranked(rows: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """``rows`` with their place from 1 within the groups ``by``, and ``all_<name>``, the group's rows; the order must be total."""
    return running_sums(rows, by, order, {name: F.lit(1).cast("bigint")})


def quantiles(rows: DataFrame, by: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """One row a group with the exact quantiles of ``value``, by linear interpolation between order statistics; NULL values are left out.

    Values are first counted with map-side sums, then placed by running sums over ranges, so neither a group's rows nor its distinct values meet in one task.
    """
    key = list(by)
    counts = rows.where(F.col(value).isNotNull()).groupBy(*key, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    placed = running_sums(counts, key, [F.col("_v").asc()], {"_to": F.col("_n")})
    outs = []
    for name, p in shares.items():
        at = (F.col("all__to") - 1) * F.lit(float(p))
        low, high = F.floor(at), F.ceil(at)
        holds = lambda k: (k >= F.col("_to") - F.col("_n")) & (k < F.col("_to"))  # noqa: E731  places from 0
        a, b = F.max(F.when(holds(low), F.col("_v"))), F.max(F.when(holds(high), F.col("_v")))
        outs.append((a + (b - a) * F.max(at - low)).alias(name))
    return placed.groupBy(*key).agg(*outs)
