"""Ranked lexical search: documents in shards, put in order by recursive graph bisection, and visited cluster by cluster in the order of their bounds until none can matter."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import scratch, words

#: Documents of a shard, which one task holds as numbers, and of a cluster.
SHARD_DOCS, CLUSTER_DOCS = 4096, 64
#: Swaps are tried this many times at each bisection.
ROUNDS = 6
#: Query terms that every worker holds; items of more terms than that come in blocks, each with its own index.
BLOCK_TERMS = 400_000
#: Items whose bounds a task works out at a time.
BLOCK_ITEMS = 128

#: ASCII letters in lower case, digits and all bytes of other characters are parts of terms; all else stands between terms.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row and term number of every term occurrence, and the distinct terms. Nulls have none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    texts = texts.take(pa.array(np.arange(len(texts))))  # no offset into a larger array
    _, ends, data = texts.buffers()
    plain = pa.LargeStringArray.from_buffers(len(texts), ends, pa.py_buffer((data.to_pybytes() if data else b"").translate(_BYTES)))
    lists = pc.ascii_split_whitespace(plain)
    flat = lists.flatten().dictionary_encode()
    row, at = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), flat.indices.to_numpy(zero_copy_only=False)
    empty = pc.index(flat.dictionary, pa.scalar("", flat.dictionary.type)).as_py()
    if empty >= 0:  # what stands before or after leading and trailing space
        keep = at != empty
        row, at = row[keep], at[keep]
    return row, at, flat.dictionary


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id, term``, distinct, of ``items(item_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in words.parts(batch.column("text").cast(pa.large_string())):
                row, at, vocabulary = _terms(part)
                yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(first + row)), vocabulary.take(pa.array(at)).cast(pa.string())], names=["item_id", "term"])

    rows = items.select("item_id", F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    schema = rows.select("item_id", F.col("text").alias("term")).schema
    return rows.transform(scratch.bounded).mapInArrow(run, schema).distinct()


def counted(docs: DataFrame, vocabulary: Broadcast) -> DataFrame:
    """``doc_id, n, terms, times`` of every row of ``docs(doc_id, text)``: all its terms with repeats, and of those in the vocabulary their numbers and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(vocabulary.value, pa.large_string())
        for batch in batches:
            row, at, here = _terms(batch.column("text"))
            n = len(batch)
            number = pc.fill_null(pc.index_in(here, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)[at]
            keys, times = np.unique((row[number >= 0] << 32) | number[number >= 0], return_counts=True)
            ends = pa.array(np.searchsorted(keys >> 32, np.arange(n + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (keys & 0xFFFFFFFF, times)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.bincount(row, minlength=n).astype(np.int64)), *lists], names=["doc_id", "n", "terms", "times"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.transform(scratch.bounded).mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, times array<int>")


def bisected(owner: np.ndarray, term: np.ndarray, n: int, least: int = CLUSTER_DOCS, rounds: int = ROUNDS) -> np.ndarray:
    """An order of ``n`` documents in which those with common terms stand together; ``owner`` and ``term`` are all (document, term) pairs.

    Recursive graph bisection: a range is cut into halves, and documents are swapped in pairs between them while that lowers the bits that the gaps of
    both halves' posting lists would take, d * log2(size / (d + 1)) for a term in d documents; then each half is cut in the same way, down to ``least`` documents.
    """
    order = np.arange(n)
    todo = [(0, n, owner, term)]
    while todo:
        low, high, docs, terms = todo.pop()
        size = high - low
        if size <= least:
            continue
        half = -(-size // 2)
        local = np.full(n, -1)
        members = order[low:high]
        local[members] = np.arange(size)
        doc = local[docs]
        seen, t, count = np.unique(terms, return_inverse=True, return_counts=True)
        keep = (count > 1)[t]  # a term of one document weighs nothing
        doc, t = doc[keep], t[keep]
        left = np.arange(size) < half
        nl, nr = half, size - half
        total = count.astype(float)
        for _ in range(rounds):
            in_left = np.bincount(t[left[doc]], minlength=len(seen)).astype(float)
            bits = lambda d: d * np.log2(nl / (d + 1)) + (total - d) * np.log2(nr / (total - d + 1))
            now = bits(in_left)
            leave, enter = now - bits(np.maximum(in_left - 1, 0)), now - bits(np.minimum(in_left + 1, total))
            gain = np.bincount(doc, np.where(left[doc], leave[t], enter[t]), size)
            a, b = np.flatnonzero(left), np.flatnonzero(~left)
            a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
            m = min(len(a), len(b))
            swaps = int((gain[a[:m]] + gain[b[:m]] > 1e-9).sum())
            if not swaps:
                break
            left[a[:swaps]], left[b[:swaps]] = False, True
        order[low:high] = np.r_[members[left], members[~left]]
        side = left[local[docs]]
        todo += [(low, low + half, docs[side], terms[side]), (low + half, high, docs[~side], terms[~side])]
    return order


_INDEX = "shard int, ids array<bigint>, keys array<bigint>, starts array<int>, places array<int>, impacts array<int>, most array<int>"


def indexed(rows: DataFrame, total: int, length: int, cluster: int = CLUSTER_DOCS) -> DataFrame:
    """One row for each shard of ``rows(shard, doc_id, n, terms, times)``: its documents' ids in their new order (place p lies in cluster p // ``cluster``), and
    the postings sorted by ``keys`` (cluster << 32 | term): from ``starts``, the places and impacts of a key's documents, with the highest impact (``most``).

    An impact is what a document's occurrences of a term count, in whole numbers; a term's weight is left to the search. A null id is written as the largest."""

    def build(batch: pa.Table) -> pa.Table:
        lists = batch.column("terms").combine_chunks()
        owner = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        term, tf = lists.flatten().to_numpy().astype(np.int64), batch.column("times").combine_chunks().flatten().to_numpy().astype(np.int64)
        n = batch.column("n").to_numpy().astype(np.int64)
        m = 100 - 90 + (90 * n * total) // max(1, length)
        order = bisected(owner, term, batch.num_rows, cluster)
        place = np.empty(batch.num_rows, np.int64)
        place[order] = np.arange(batch.num_rows)
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[owner])
        at = place[owner]
        key = ((at // cluster) << 32) | term
        by = np.lexsort((at, key))
        keys, starts = np.unique(key[by], return_index=True)
        ids = pc.fill_null(batch.column("doc_id"), 2**63 - 1).to_numpy()[order]
        most = np.maximum.reduceat(impact[by], starts) if len(starts) else np.empty(0, np.int64)
        arrays = (ids, keys, np.r_[starts, len(by)].astype(np.int32), at[by].astype(np.int32), impact[by].astype(np.int32), most.astype(np.int32))
        return pa.table([pa.array([batch.column("shard")[0].as_py()], pa.int32()), *[pa.array([x.tolist()], pa.list_(pa.int64() if i < 2 else pa.int32())) for i, x in enumerate(arrays)]], names=[f.split()[0] for f in _INDEX.split(", ")])

    return rows.select("shard", "doc_id", "n", "terms", "times").groupBy("shard").applyInArrow(build, _INDEX)


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of these lengths: the run of each element, and its number within the run."""
    run = np.repeat(np.arange(len(counts)), counts)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts)


class Shard:
    """One row of :func:`indexed`, searched by items given as ``starts, terms, weights`` (an item's terms are ``terms[starts[i] : starts[i + 1]]``)."""

    def __init__(self, batch: pa.RecordBatch, row: int, cluster: int) -> None:
        one = lambda c: batch.column(c)[row].values.to_numpy().astype(np.int64)
        self.ids, self.keys, self.starts, self.places, self.impacts, self.most = (one(c) for c in ("ids", "keys", "starts", "places", "impacts", "most"))
        self.size, self.clusters = cluster, -(-len(self.ids) // cluster)
        self.by_term = np.argsort(self.keys & 0xFFFFFFFF, kind="stable")
        self.terms, self.first = np.unique(self.keys[self.by_term] & 0xFFFFFFFF, return_index=True)
        self.first = np.r_[self.first, len(self.keys)]

    def bounds(self, starts: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Items by clusters: what no document of the cluster scores more than."""
        item, _ = _spread(np.diff(starts))
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        hit = self.terms[at] == terms
        item, at, weight = item[hit], at[hit], weights[hit]
        run, k = _spread(self.first[at + 1] - self.first[at])
        entry = self.by_term[self.first[at][run] + k]
        return np.bincount(item[run] * self.clusters + (self.keys[entry] >> 32), weight[run] * self.most[entry], (len(starts) - 1) * self.clusters).reshape(-1, self.clusters)

    def scores(self, items: np.ndarray, clusters: np.ndarray, starts: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item, place and score (over 0) of the documents in these (item, cluster) pairs."""
        pair, k = _spread(np.diff(starts)[items])
        at = starts[items][pair] + k
        want = (clusters[pair] << 32) | terms[at]
        entry = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        hit = self.keys[entry] == want
        pair, at, entry = pair[hit], at[hit], entry[hit]
        run, k = _spread(self.starts[entry + 1] - self.starts[entry])
        post = self.starts[entry][run] + k
        total = np.bincount(pair[run] * self.size + self.places[post] % self.size, weights[at][run] * self.impacts[post], len(items) * self.size)
        found = np.flatnonzero(total)
        return items[found // self.size], clusters[found // self.size] * self.size + found % self.size, total[found].astype(np.int64)


class Best:
    """The best ``k`` (score, id) of each item so far; ``least`` is what a score must reach to count."""

    def __init__(self, items: int, k: int, least: np.ndarray) -> None:
        self.k, self.least = k, least.copy()
        self.item, self.score, self.doc = (np.empty(0, np.int64) for _ in range(3))

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        keep = score >= self.least[item]
        item, score, doc = np.r_[self.item, item[keep]], np.r_[self.score, score[keep]], np.r_[self.doc, doc[keep]]
        by = np.lexsort((doc, -score, item))
        item, score, doc = item[by], score[by], doc[by]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        last = rank == self.k - 1
        self.least[item[last]] = np.maximum(self.least[item[last]], score[last])
        self.item, self.score, self.doc = (x[rank < self.k] for x in (item, score, doc))


def visit(index: DataFrame, items: Broadcast, k: int, cluster: int, first_only: bool = False) -> DataFrame:
    """``item, doc_id, score``: the ``k`` best documents of each item among those that each task of ``index`` has visited.

    Items are ``(starts, terms, weights, least)``; ``least`` is a score that at least ``k`` documents are known to reach, or 1. A shard's clusters are visited in the order of
    their bounds, some more each time, until the bound of the next one is less than the item's least score: no document beyond can be among the best,
    and one that ties is still looked at. With ``first_only`` each shard gives its first cluster only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, terms, weights, least = items.value
        best = Best(len(least), k, least)
        for batch in batches:
            for row in range(len(batch)):
                shard = Shard(batch, row, cluster)
                if not len(shard.keys):
                    continue
                for low in range(0, len(least), BLOCK_ITEMS):
                    high = min(low + BLOCK_ITEMS, len(least))
                    own, cut = starts[low : high + 1] - starts[low], slice(starts[low], starts[high])
                    bounds = shard.bounds(own, terms[cut], weights[cut])
                    turn = np.argsort(-bounds, axis=1, kind="stable")
                    sorted_bounds = np.take_along_axis(bounds, turn, 1)
                    done, step = 0, 1
                    while done < shard.clusters and (done == 0 or not first_only):
                        ahead = sorted_bounds[:, done : done + step]
                        who, which = np.nonzero((ahead > 0) & (ahead >= best.least[low:high, None]))
                        if not len(who):
                            break
                        item, place, score = shard.scores(who, turn[who, done + which], own, terms[cut], weights[cut])
                        best.add(item + low, score, shard.ids[place])
                        done, step = done + step, step * 2
        yield pa.RecordBatch.from_arrays([pa.array(best.item.astype(np.int32)), pa.array(best.doc), pa.array(best.score)], names=["item", "doc_id", "score"])

    return index.transform(scratch.bounded).mapInArrow(run, "item int, doc_id bigint, score bigint")


def ranked(found: DataFrame, by: str, k: int) -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, shard_docs: int = SHARD_DOCS, cluster_docs: int = CLUSTER_DOCS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of ``docs(doc_id, text)`` for each item of ``items(item_id, text)``, score over 0, equal scores by ascending doc_id.

    Terms are runs of characters that are no ASCII signs, A-Z lower-cased. Over N documents with a term and their L terms, a term in df documents weighs
    ``w = floor(1000 * ln((2N + 2) / (2df + 1)))``; a document of n terms has ``m = 10 + (90 * n * N) div L`` and scores the sum of ``w * ((10**9 * tf) div (1000 * tf + 8 * m))`` over the
    item's distinct terms. All of it is exact: see :func:`visit` for why clusters left out can't hold a result.

    Null texts have no terms; items without terms, or whose id is null, have no rows; item rows of one id are one item with the terms of all. Documents that repeat an id are ranked each; null ids
    come last among equals. Other columns are ignored; an empty table on either side gives no rows.

    Items are the stated query set: their terms go to every worker, in blocks of about ``block_terms``, each with an index of its own terms. The first cluster of every shard gives each item a least score,
    with which all shards are then visited; a task sends ``k`` rows an item at most.
    """
    spark = docs.sparkSession
    asked = scratch.written(item_terms(items), "lexical-items")
    n = asked.count()
    blocks = max(1, -(-n // block_terms))
    out = None
    for block in range(blocks):
        part = _block(spark, docs, asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block), k, shard_docs, cluster_docs)
        out = part if out is None else out.unionByName(part)
    return out


def _block(spark: SparkSession, docs: DataFrame, asked: DataFrame, k: int, shard_docs: int, cluster: int) -> DataFrame:
    held = asked.orderBy("item_id", "term").toArrow()
    ids = pc.unique(held.column("item_id"))
    vocabulary = pc.unique(held.column("term"))
    context = spark.sparkContext
    rows = counted(docs, context.broadcast(vocabulary.to_pylist())).withColumn("no", F.monotonically_increasing_id())
    rows = scratch.written(rows.where("n > 0"), "lexical-terms")
    sums = rows.agg(F.count("*").alias("total"), F.sum("n").alias("length"), F.count_if(F.size("terms") > 0).alias("live")).first()
    total, length = sums["total"], sums["length"] or 0
    df = np.zeros(len(vocabulary), np.int64)
    for t, c in rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).toLocalIterator():
        df[t] = c
    weight = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    term = pc.index_in(held.column("term"), value_set=vocabulary).to_numpy().astype(np.int64)
    starts = np.r_[0, np.cumsum(pc.value_counts(held.column("item_id")).field("counts").to_numpy())].astype(np.int64)
    shards = max(1, -(-(sums["live"] or 0) // shard_docs))
    dealt = rows.where(F.size("terms") > 0).withColumn("shard", F.pmod(F.xxhash64("no"), F.lit(shards)).cast("int"))
    index = scratch.written(indexed(dealt, total, length, cluster), "lexical-index")
    first = visit(index, context.broadcast((starts, term, weight[term], np.ones(len(ids), np.int64))), k, cluster, first_only=True)
    least = np.ones(len(ids), np.int64)
    for i, s in ranked(first, "item", k).where(F.col("rank") == k).select("item", "score").toLocalIterator():
        least[i] = max(1, s)
    found = visit(index, context.broadcast((starts, term, weight[term], least)), k, cluster)
    found = ranked(found, "item", k)
    names = spark.createDataFrame(pa.table({"item": pa.array(range(len(ids)), pa.int32()), "item_id": ids}))
    return found.join(F.broadcast(names), "item").select("item_id", "rank", F.nullif("doc_id", F.lit(2**63 - 1)).alias("doc_id"), "score")
