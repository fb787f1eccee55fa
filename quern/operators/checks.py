"""Constraints as queries that return what breaks them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(rows: DataFrame, id_col: str, rules: Mapping[str, Column]) -> DataFrame:
    """``id, violation`` of rows that break a rule, named by the first one broken. Rules hold where they are NULL."""
    named = F.coalesce(*[F.when(bad, name) for name, bad in rules.items()])
    return rows.select(id_col, named.alias("violation")).where("violation is not null")


def index_report(vectors: DataFrame, rows: DataFrame, vector_id: str, row_id: str, vector: str, dimension: int) -> DataFrame:
    """Counts of repeated vector ids, rows without a vector and vectors of another dimension."""
    own = vectors.agg((F.count("*") - F.count_distinct(vector_id)).alias("n")).select(F.lit("repeated ids").alias("violation"), "n")
    lost = rows.join(vectors.select(F.col(vector_id).alias(row_id)), row_id, "left_anti").agg(F.count("*").alias("n")).select(F.lit("without vector").alias("violation"), "n")
    odd = vectors.agg(F.count_if(F.size(vector) != dimension).alias("n")).select(F.lit("wrong dimension").alias("violation"), "n")
    return own.unionByName(lost).unionByName(odd)


def splits(made: DataFrame, rows: DataFrame, id_col: str) -> DataFrame:
    """``split, n, shared`` of a table of splits (rows and ids that another split has too), and a row 'missing': ids of ``rows`` in no split, and ids in several."""
    own = made.select(id_col, "split").distinct()
    times = own.groupBy(id_col).agg(F.count("*").alias("_splits"))
    each = made.join(times, id_col).groupBy("split").agg(F.count("*").alias("n"), F.count_if(F.col("_splits") > 1).alias("shared"))
    lost = rows.select(id_col).distinct().join(own, id_col, "left_anti").agg(F.count("*").alias("n"))
    return each.unionByName(lost.join(F.broadcast(times.agg(F.count_if(F.col("_splits") > 1).alias("shared")))).select(F.lit("missing").alias("split"), "n", "shared"))


def release_report(vectors: DataFrame, chunks: DataFrame, manifest: DataFrame, vector_id: str, chunk_vector: str) -> DataFrame:
    """``rule, holds`` of an index release: its vectors, its chunks (``chunk_vector``: NULL where a chunk has no vector), and the one row of
    ``manifest(vector_count, chunk_count, orphan_vector_count, vectors_seen)``. NULL in the manifest: 0 orphans, and all vectors and orphans seen."""
    counts = vectors.agg(F.count(vector_id).alias("v")).join(F.broadcast(chunks.agg(F.count("*").alias("c"), F.count(chunk_vector).alias("m")))).join(F.broadcast(manifest))
    orphans = F.coalesce("orphan_vector_count", F.lit(0))
    rules = {
        "vectors = mapped = chunks": (F.col("v") == F.col("m")) & (F.col("m") == F.col("c")), "manifest vectors": F.col("vector_count") == F.col("v"),
        "manifest chunks": F.col("chunk_count") == F.col("c"), "seen = indexed + orphans": F.coalesce("vectors_seen", F.col("v") + orphans) == F.col("v") + orphans,
    }
    stack = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.coalesce(c, F.lit(False)).alias("holds")) for k, c in rules.items()])).alias("r")
    return counts.select(stack).select("r.*")


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that only one of two manifests has."""
    count = lambda a, b, name: a.subtract(b).agg(F.count("*").alias("n")).select(F.lit(name).alias("change"), "n")
    return count(before, after, "gone").unionByName(count(after, before, "new"))


def structures(lines: DataFrame, key: str) -> DataFrame:
    """Counts, extent and centre of fixed-width atom lines, for each key."""
    at = lambda a, n: F.trim(F.substring("line", a, n))
    atoms = lines.where(F.col("line").startswith("ATOM") | F.col("line").startswith("HETATM"))
    atoms = atoms.select(key, at(22, 1).alias("chain"), at(23, 4).alias("residue"), at(31, 8).try_cast("double").alias("x"))
    return atoms.groupBy(key).agg(
        F.count("*").alias("atoms"), F.count_distinct("chain", "residue").alias("residues"), F.count_distinct("chain").alias("chains"),
        F.round(F.max("x") - F.min("x"), 3).alias("box_x"), F.round(F.avg("x"), 3).alias("centre_x"),
    )
