"""SimHash fingerprints of documents, and permuted block tables that find all fingerprints within a Hamming radius."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import scratch
from quern.llm.words import hashed, hashes, mixed, windows, words

BITS = 64
#: Near copies (5-word Jaccard of 0.8) differ in more than 3 bits as a rule.
RADIUS, BLOCKS = 8, 10
#: Weight of one word against that of a pair of neighbours.
WORD_WEIGHT = 0.5


def simhash(text: str | None) -> int:
    """Signed 64-bit SimHash of a whole text: words and neighbour pairs vote on each bit with the root of their count; 0 without a word."""
    return voted(hashed(words(text)))


def voted(h: np.ndarray) -> int:
    """SimHash of the hashes of a text's words."""
    if not len(h):
        return 0
    ones, n1 = np.unique(h, return_counts=True)
    pairs, n2 = np.unique(windows(h, 2), return_counts=True)
    terms = np.concatenate([mixed(ones), pairs])
    weight = np.concatenate([WORD_WEIGHT * np.sqrt(n1), np.sqrt(n2)]).astype(np.float32)
    votes = np.zeros(BITS, np.float64)
    for i in range(0, len(terms), 4096):
        bits = np.unpackbits(terms[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += weight[i : i + 4096] @ bits.astype(np.float32)
    return int(np.packbits(votes * 2 > weight.sum(dtype=np.float64), bitorder="little").view(np.int64)[0])


def hexed(print_: int) -> str:
    return f"{print_ & 0xFFFFFFFFFFFFFFFF:016x}"


def likeness(a: int, b: int) -> float:
    """Share of equal bits."""
    return 1.0 - ((a ^ b) & 0xFFFFFFFFFFFFFFFF).bit_count() / BITS


def fingerprinted(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """``docs`` with the SimHash of every whole text as a bigint column; null and empty texts: 0. Equal texts have equal fingerprints.

    One narrow pass, no shuffle. Repeated rows stay as they are; an empty table gives no rows; a column named ``out_col`` is replaced, others stay.
    """
    kept = docs.drop(out_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = pa.array([voted(h) for h in hashes(b.column(text_col))], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, prints], names=[*b.schema.names, out_col])

    return kept.transform(scratch.bounded).mapInArrow(run, _with(kept, f"{out_col} bigint"))


def _with(df: DataFrame, ddl: str):
    from pyspark.sql import types as T

    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(ddl).fields])


def masks(radius: int = RADIUS, blocks: int = BLOCKS) -> list[int]:
    """Of ``blocks`` blocks at least blocks - radius agree in two fingerprints within ``radius``: one mask for each such choice, signed."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    found = [sum(block[i] for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def within(queries: DataFrame, corpus: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """All fingerprints of ``corpus(fingerprint)`` within ``radius`` bits of each of ``queries(fingerprint)``.

    Returns distinct ``fingerprint, other, distance, copies`` (copies: rows of the corpus that have ``other``), equal ones included.
    Null fingerprints match nothing; empty tables give no rows. Each side is reduced to distinct fingerprints first, so
    exact copies cost one row. A pair is compared in every table where its key agrees and given by the first such table only.
    """
    if not 0 <= radius < blocks <= BITS:
        raise ValueError("0 <= radius < blocks <= 64")
    chosen = masks(radius, blocks)
    tables = F.array(*[F.lit(m).cast("bigint") for m in chosen])

    def dealt(df: DataFrame, name: str, *more: str) -> DataFrame:
        return df.select(F.col("fingerprint").alias(name), *more, F.explode(tables).alias("m"))  # a table is known by its mask

    asked = dealt(queries.where("fingerprint is not null").select("fingerprint").distinct(), "q")
    held = dealt(corpus.where("fingerprint is not null").groupBy("fingerprint").agg(F.count("*").alias("copies")), "other", "copies")
    x = F.col("q").bitwiseXOR(F.col("other"))
    first: Column = F.lit(None).cast("bigint")
    for m in reversed(chosen):
        first = F.when(x.bitwiseAND(F.lit(m).cast("bigint")) == 0, F.lit(m).cast("bigint")).otherwise(first)
    key = (F.col("a.m") == F.col("b.m")) & (F.col("q").bitwiseAND(F.col("a.m")) == F.col("other").bitwiseAND(F.col("b.m")))
    # sizes are estimated before the explode, so a broadcast would be larger than its limit: the join is told to shuffle
    near = asked.alias("a").hint("merge").join(held.alias("b"), key & (F.bit_count(x) <= radius) & (F.col("a.m") == first))
    return near.select(F.col("q").alias("fingerprint"), "other", F.bit_count(x).cast("int").alias("distance"), "copies")


def edited(text: str, following: str) -> str:
    """The last quarter (rounded down) of the code points replaced by the first as many, or all, of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def neighbours(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows of ``docs(doc_id, text)`` dealt into ordered ranges of (id, hash of the text), each range followed by a copy of the next one's first row.

    Columns ``bucket, ghost, doc_id, tie, text``, sorted in each partition, so that a stream over a partition meets each row's successor
    right after it; the last range is followed by the very first row. Null ids come first. An id that many rows repeat, or lack, takes as many
    ranges of the hash as its share of the rows asks for. One shuffle of the texts; a few numbers for each of ``buckets`` come to the driver.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.select("doc_id", F.xxhash64("text").alias("tie"), "text")
    shares = [i / buckets for i in range(1, buckets)] or [0.5]
    found = docs.agg(F.percentile_approx("doc_id", shares, max(10_000, 10 * buckets)).alias("q"), F.count("*").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("none")).first()
    edges, repeats = np.unique(np.array((found["q"] if buckets > 1 else None) or [], np.int64), return_counts=True)
    none = max(1, math.ceil(buckets * found["none"] / max(1, found["n"])))
    # a range ends at each edge; an edge that many quantiles share has ranges of its own before that end
    hot = {int(e): int(r) for e, r in zip(edges, repeats) if r > 1}
    before = np.cumsum([0] + [1 + hot.get(int(e), 0) for e in edges])  # ranges that lie before those of each gap

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, ties = b.column("doc_id").fill_null(0).to_numpy(), b.column("tie").to_numpy()
            at = np.searchsorted(edges, ids, "left")
            out = before[at] + none
            part = lambda ties, n: np.minimum((ties.astype(np.float64) / 2.0**64 + 0.5) * n, n - 1).astype(np.int64)
            for e, r in hot.items():
                own = ids == e
                if own.any():
                    out[own] += 1 + part(ties[own], r)
            lacks = np.asarray(b.column("doc_id").is_null())
            if lacks.any():
                out[lacks] = part(ties[lacks], none)
            yield pa.RecordBatch.from_arrays([pa.array(out.astype(np.int32)), *b.columns], names=["bucket", *b.schema.names])

    least = F.min(F.struct("doc_id", "tie")).alias("h")
    heads = docs.select("doc_id", "tie").transform(scratch.bounded).mapInArrow(place, "bucket int, doc_id bigint, tie bigint").groupBy("bucket").agg(least).collect()
    heads = [(r["bucket"], r["h"]["doc_id"], r["h"]["tie"]) for r in sorted(heads, key=lambda r: r["bucket"])]
    placed = docs.transform(scratch.bounded).mapInArrow(place, "bucket int, doc_id bigint, tie bigint, text string").select("bucket", F.lit(False).alias("ghost"), "doc_id", "tie", "text")
    after = [(i, t, b) for (_, i, t), (b, _, _) in zip(heads, [heads[-1], *heads[:-1]])] if heads else []
    ghosts = docs.sparkSession.createDataFrame(after, "head bigint, head_tie bigint, bucket int")
    ghosts = docs.join(F.broadcast(ghosts), F.expr("doc_id <=> head and tie = head_tie"))
    ghosts = ghosts.groupBy("bucket", "doc_id", "tie").agg(F.min("text").alias("text")).select("bucket", F.lit(True).alias("ghost"), "doc_id", "tie", "text")
    return placed.unionByName(ghosts).repartition("bucket").sortWithinPartitions("bucket", "ghost", "doc_id", "tie", "text")


def edit_likeness(docs: DataFrame) -> DataFrame:
    """SimHash of every text of ``docs(doc_id, text)``, of its edited text (see :func:`edited`), and how near they come.

    The following document is the next by ascending id (null ids first; rows of one id by the xxhash64 of the text, then the text), after the
    last the first; a single document follows itself. Null text: empty. Returns ``doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint`` (16 hex digits), ``near_edited, near_next`` and ``bits``, the fingerprint as a bigint; one row for each input row, repeated
    rows included. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    buckets = min(20_000, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "bits"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # bucket, doc_id, text and fingerprint of a row whose successor is still to come
        for b in batches:
            rows, changes = [], []
            for bucket, ghost, doc_id, text, h in zip(*(b.column(c).to_pylist() for c in ("bucket", "ghost", "doc_id", "text")), hashes(b.column("text"))):
                if ghost and (held is None or held[0] != bucket):
                    continue
                own = voted(h)
                if held is not None:
                    _, at, mine, print_ = held
                    changed = edited(mine, text)
                    changes.append(changed)
                    rows.append((at, len(mine), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), print_, own))
                held = None if ghost else (bucket, doc_id, text, own)
            if rows:
                out = []
                for (at, n, digest, print_, own), h in zip(rows, hashes(pa.array(changes, pa.large_string()))):
                    other = voted(h)
                    out.append((at, n, digest, hexed(print_), hexed(other), likeness(print_, other), likeness(print_, own), print_))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, bits bigint"
    return neighbours(docs, buckets).transform(scratch.bounded).mapInArrow(run, schema)
