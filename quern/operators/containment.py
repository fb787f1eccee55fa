"""Which texts contain which terms, as literal text: terms meet texts by the rarest run of bytes that each term has, and are then looked for exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.sources import tables

#: Bytes of a run; shorter terms are one run of their own length.
WIDTH = 8
#: Distinct runs that every worker holds; more come in blocks, each another pass over the texts.
HELD = 2_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def runs(raw: bytes, width: int) -> np.ndarray:
    """A number for each run of ``width`` bytes of ``raw``, in order; equal runs have equal numbers."""
    if width == 0:
        return np.zeros(1, np.uint64)
    n = len(raw) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    data = np.frombuffer(raw, np.uint8)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = (out << np.uint64(8)) | data[k : k + n]
    return (out + np.uint64(width)) * _STEP


def _term_runs(terms: DataFrame, term: str) -> DataFrame:
    """``term, width, run`` of every run of every distinct term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said, widths, found = [], [], []
            for t in batch.column(0).to_pylist():
                raw = t.encode("utf-8", "surrogatepass")
                own = np.unique(runs(raw, min(WIDTH, len(raw))))
                said += [t] * len(own)
                widths += [min(WIDTH, len(raw))] * len(own)
                found.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(said, pa.string()), pa.array(widths, pa.int32()), pa.array(np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64))], names=["term", "width", "run"])

    return terms.select(F.col(term).cast("string").alias("term")).where("term is not null").distinct().mapInArrow(run, "term string, width int, run bigint")


def _met(rows: DataFrame, body: str, widths: list[int], wanted, out_col: str) -> DataFrame:
    """``rows`` with those of the ``wanted`` runs (a broadcast, ascending) that the text in ``body`` holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = wanted.value
        for batch in batches:
            lists = []
            for t in batch.column(batch.schema.get_field_index(body)).cast(pa.large_binary()).to_pylist():
                found = np.concatenate([np.empty(0, np.uint64), *[np.unique(runs(t, w)) for w in widths]]) if t is not None else np.empty(0, np.uint64)
                at = np.minimum(np.searchsorted(some, found), max(0, len(some) - 1))
                lists.append(np.unique(found[some[at] == found]).view(np.int64) if len(some) else found.view(np.int64))
            ends = pa.array(np.cumsum([0, *map(len, lists)]), pa.int32())
            column = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.empty(0, np.int64), *lists])))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, out_col])

    return rows.mapInArrow(run, f"{rows._jdf.schema().toDDL()}, {out_col} array<bigint>")


def containing(rows: DataFrame, body: str, terms: DataFrame, term: str, how: str = "inner", held: int = HELD) -> DataFrame:
    """Rows whose ``body`` contains a term, as literal text: with the row of ``terms`` (``how`` inner), or once each (left_semi).

    Of each term's runs of WIDTH bytes the one that the fewest texts hold stands for it (counted over all texts), so a term meets only texts with that run, in an equi-join, and is then
    looked for in them. Work grows with texts plus terms plus what they share. An empty term is in every text that is not null; null terms and texts hold nothing. Rows that repeat count each.
    """
    spark = rows.sparkSession
    own = tables.written(_term_runs(terms, term), "runs")
    widths = [r["width"] for r in own.select("width").distinct().collect()]
    n = own.select("run").distinct().count()
    blocks = max(1, -(-n // held))
    texts = rows.select(F.col(body).cast("string").alias("_body"))
    counts = None
    for b in range(blocks):
        part = own.where(F.pmod(F.xxhash64("run"), F.lit(blocks)) == b).select("run").distinct()
        known = spark.sparkContext.broadcast(np.sort(part.toArrow().column("run").to_numpy().view(np.uint64)))
        one = _met(texts, "_body", widths, known, "_runs").select(F.explode("_runs").alias("run")).groupBy("run").agg(F.count("*").alias("n"))
        counts = one if counts is None else counts.unionByName(one)
    best = own.join(counts, "run").groupBy("term").agg(F.min_by("run", F.struct("n", "run")).alias("run"), F.count("*").alias("met"))
    # a term one of whose runs no text holds is in no text
    best = tables.written(best.join(own.groupBy("term").agg(F.count("*").alias("of")), "term").where("met = of").select(F.col("term").alias("_term"), F.col("run").alias("_run")), "rarest")
    found = None
    for b in range(blocks):
        part = best.where(F.pmod(F.xxhash64("_run"), F.lit(blocks)) == b)
        known = spark.sparkContext.broadcast(np.sort(np.unique(part.select("_run").toArrow().column("_run").to_numpy()).view(np.uint64)))
        numbered = rows.withColumn("_row", F.monotonically_increasing_id())
        met = _met(numbered, body, widths, known, "_runs").where(F.size("_runs") > 0).withColumn("_run", F.explode("_runs")).drop("_runs")
        met = met.join(part, "_run").where(F.contains(F.col(body), F.col("_term"))).drop("_run")
        found = met if found is None else found.unionByName(met)
    if how == "left_semi":
        return found.dropDuplicates(["_row"]).select(*rows.columns)
    return found.join(terms, F.col("_term") == terms[term]).select(*[found[c] for c in rows.columns], *[terms[c] for c in terms.columns])
