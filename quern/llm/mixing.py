"""Mixing sources to target weights: Sainte-Laguë block quotas per source and shard, then seeded block selection."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm import scratch

#: A mix names its sources: more distinct ones than this is an error, as their sizes come to the driver.
MAX_SOURCES = 100_000
#: Words that a shard of a source aims at, and the most shards that one source is split into.
SHARD_WORDS, MAX_SHARDS = 2_000_000, 4096
BLOCK_WORDS = 32
SEED = 7
#: Cuts, one row a shard, of at most this number are broadcast; more are joined by shuffle.
BROADCAST_CUTS = 100_000


def words_in(text: Column) -> Column:
    """Number of runs of characters other than space and \\t to \\r; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint"), F.lit(0).cast("bigint"))


def cycled(sources: Sequence[str | None], weights: Sequence[float] = (3.0, 1.0, 2.0)) -> list[float]:
    """``weights`` dealt out to the sources in order, again and again."""
    return [float(weights[i % len(weights)]) for i in range(len(sources))]


def targets(sizes: Sequence[int], weights: Sequence[float], share: float, most: float) -> list[float]:
    """``share`` of all words dealt by weight; a target stops at ``most`` times its source's size, the excess is dealt again by weight."""
    out, caps = [0.0] * len(sizes), [most * s for s in sizes]
    left, open_ = min(share * sum(sizes), sum(caps)), [i for i in range(len(sizes)) if weights[i] > 0]
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total > caps[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = caps[i]
        left -= sum(caps[i] for i in full)
        gone = set(full)
        open_ = [i for i in open_ if i not in gone]
    return out


def apportion(votes: Sequence[float], seats: int) -> list[int]:
    """Sainte-Laguë: seats go to the highest quotients votes / (2 * held + 1), ties to the first.

    A bisected divisor gives nearly all seats at once; a heap of quotients deals out the rest, so the cost
    depends on the number of parties and not of seats. No votes or seats: all zero.
    """
    total = sum(votes)
    if total <= 0 or seats <= 0:
        return [0] * len(votes)
    held = lambda d: [int(v / d + 0.5) for v in votes]
    low, high = total / (seats + len(votes) + 1.0), 2.0 * total + 1.0
    for _ in range(200):
        mid = (low + high) / 2
        if sum(held(mid)) <= seats:
            high = mid
        else:
            low = mid
        if high - low <= high * 1e-15:
            break
    out = held(high)
    rest = seats - sum(out)
    queue = [(-v / (2 * out[i] + 1), i) for i, v in enumerate(votes) if v > 0]
    heapq.heapify(queue)
    for _ in range(rest):
        _, i = heapq.heappop(queue)
        out[i] += 1
        heapq.heappush(queue, (-votes[i] / (2 * out[i] + 1), i))
    return out


def mix(docs: DataFrame, id_col: str = "doc_id", **kwargs) -> DataFrame:
    """``<id_col>, size, source_size, target, taken`` of every row of ``docs(<id_col>, text, source)``: see :func:`mixed`, whose parameters it takes.

    Other columns are ignored and texts are read once, for their number of words."""
    sized = scratch.written(_sized(docs.select(F.col(id_col).alias("id"), "source", "text"), "id", kwargs.get("seed", SEED)).drop("text"), "mix")
    return _taken(sized, sized, "id", **kwargs).select(F.col("id").alias(id_col), "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, id_col: str = "doc_id", **kwargs) -> DataFrame:
    """All columns of ``docs(<id_col>, text, source, ...)`` with ``size, source_size, target, taken``: how many words of every document a mix takes.

    ``weights`` gives a weight for each of the sources, which it gets sorted by code point with null last. They share
    ``share`` times all words (see :func:`targets`). The mix is cut into blocks of ``block_words`` words;
    :func:`apportion` gives each source, then each of its shards, a whole number of blocks. The blocks of a shard are those of its documents strung together
    in an order drawn from ``seed``: it takes whole passes over them and, of one pass more, the first blocks of that order, so the seeded choice is
    one of documents, and only the document at the cut is taken in part.

    Null text: size 0, nothing taken. Rows that repeat an id are documents of their own; equal rows share what falls on them evenly, less a remainder.
    Null source: a source like others. Columns of these four names are replaced; others stay. An empty table gives no rows. Reruns agree.

    Sources come to the driver (ValueError over MAX_SOURCES); shards of one source, at most MAX_SHARDS, meet in one
    task as counts. A source of any size is split into shards by a hash of the id, so no task holds a source, and texts are not shuffled to find the
    cuts: each shard's cut is one row, which its documents are held against.
    """
    kept = docs.drop("size", "source_size", "target", "taken")
    row = F.struct(*[f"`{c}`" for c in kept.columns]).alias("_row")  # so that no name of theirs meets one of the steps'
    rows = _sized(kept.select(row, F.col(id_col).alias("id"), "source", "text"), "id", kwargs.get("seed", SEED)).drop("text")
    sized = scratch.written(rows.drop("_row"), "mix")
    return _taken(rows, sized, "id", **kwargs).select("_row.*", "size", "source_size", "target", "taken")


def _sized(docs: DataFrame, id_col: str, seed: int) -> DataFrame:
    return docs.withColumns({"size": words_in(F.col("text")), "_draw": F.xxhash64(F.col(id_col), F.lit(seed))})


def _taken(
    rows: DataFrame,
    sized: DataFrame,
    id_col: str,
    weights: Callable[[Sequence[str | None]], Sequence[float]] = cycled,
    share: float = 1.5,
    most: float = 2.0,
    block_words: int = BLOCK_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """``rows`` with what the mix takes, planned on ``sized(id, source, size, _draw)`` of the same rows."""
    spark = rows.sparkSession
    totals = sized.groupBy("source").agg(F.sum("size").alias("words")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    totals.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    names, sizes = [r["source"] for r in totals], [r["words"] for r in totals]
    goals = targets(sizes, list(weights(names)), share, most)
    blocks = apportion(goals, round(sum(goals) / block_words))
    shards = [min(MAX_SHARDS, max(1, math.ceil(s / SHARD_WORDS))) for s in sizes]
    plan = spark.createDataFrame(
        list(zip(range(len(names)), names, sizes, goals, blocks, shards)),
        "_no int, _source string, source_size bigint, target double, _blocks bigint, _shards int",
    )

    def dealt(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(plan), F.expr("source <=> _source")).withColumn("_shard", F.pmod(F.shiftright("_draw", 20), F.col("_shards")).cast("int"))

    def quotas(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("_shard")
        batch["quota"] = [min(n * block_words, int(most * w)) for n, w in zip(apportion(batch["words"].tolist(), int(batch["_blocks"].iloc[0])), batch["words"])]
        return batch[["_no", "_shard", "words", "quota"]]

    where = ["_no", "_shard"]
    equal = dealt(sized).groupBy(*where, "_draw", "id", "size").agg(F.count("*").alias("n"), F.first("_blocks").alias("_blocks"))
    equal = scratch.written(equal, "mix-equal")  # read twice below
    quota = equal.groupBy(*where).agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.first("_blocks").alias("_blocks"))
    quota = quota.groupBy("_no").applyInPandas(quotas, "_no int, _shard int, words bigint, quota bigint")
    quota = quota.where("words > 0").select(*where, F.expr("quota div words").alias("_passes"), F.expr("quota % words").alias("rest"))
    order = Window.partitionBy(*where).orderBy("_draw", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    strung = equal.withColumn("upto", F.sum(F.col("size") * F.col("n")).over(order)).join(quota, where)
    before = F.col("upto") - F.col("size") * F.col("n")
    cut = F.when((before < F.col("rest")) & (F.col("rest") <= F.col("upto")), F.struct("_draw", "id", "size"))
    part = F.when(cut.isNotNull(), F.expr("(rest - upto + size * n) div n"))
    cuts = strung.groupBy(*where).agg(F.first("_passes").alias("_passes"), F.max(cut).alias("_cut"), F.max(part).alias("_part"))
    own = F.struct("_draw", F.col(id_col).alias("id"), "size")
    extra = F.when(own < F.col("_cut"), F.col("size")).when(own == F.col("_cut"), F.col("_part")).otherwise(0)
    if sum(shards) <= BROADCAST_CUTS:  # one row a shard, so their number is known
        cuts = F.broadcast(cuts)
    out = dealt(rows).join(cuts, where, "left")
    return out.withColumn("taken", F.coalesce(F.col("_passes") * F.col("size") + extra, F.lit(0)).cast("bigint"))
