"""Exact duplicates: partitions send Golomb-coded fingerprints to owners, get bitmaps of the repeated ones back, and only suspects are shuffled with their texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import scratch

#: Bits of a fingerprint beyond those that number the rows: one row in 2 ** SPARE_BITS is a suspect by chance.
SPARE_BITS = 10
#: Rows that an owner answers for, at most about; few rows have as many owners as there are shuffle partitions, each of at least LEAST_OWNED.
MOST_OWNED, LEAST_OWNED = 1 << 20, 1 << 8
#: Slots of a sender's filter for each fingerprint that it holds: how many rows become suspects by sharing a slot.
SLOTS_EACH = 8

#: Groups, the largest ones, that every task gets; of all others none has more than one row in LARGE_GROUPS.
LARGE_GROUPS = 1000


def golomb(gaps: np.ndarray) -> bytes:
    """Golomb-Rice code of whole numbers of 0 or more: one byte with the number k of low bits, the count in eight, then all quotients ``gap >> k`` in unary
    (that many ones and a zero), then all low parts. k is the one for the mean."""
    mean = float(gaps.mean()) if len(gaps) else 0.0
    k = max(0, int(np.log2(max(mean * 0.69, 1.0))))
    high, low = (gaps >> np.uint64(k)).astype(np.int64), gaps & np.uint64((1 << k) - 1)
    unary = np.ones(int(high.sum()) + len(gaps), np.uint8)
    unary[np.cumsum(high + 1) - 1] = 0
    bits = ((low[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel() if k else np.empty(0, np.uint8)
    return bytes([k]) + len(gaps).to_bytes(8, "little") + np.packbits(np.r_[unary, bits]).tobytes()


def ungolomb(code: bytes) -> np.ndarray:
    """The numbers that :func:`golomb` coded."""
    k, n = code[0], int.from_bytes(code[1:9], "little")
    bits = np.unpackbits(np.frombuffer(code, np.uint8, offset=9))
    stops = np.flatnonzero(bits == 0)[:n]
    high = np.diff(np.r_[-1, stops]) - 1
    at = int(stops[-1]) + 1 if n else 0
    low = bits[at : at + n * k].reshape(n, k).astype(np.uint64) @ (np.uint64(1) << np.arange(k, dtype=np.uint64)) if k else np.zeros(n, np.uint64)
    return (high.astype(np.uint64) << np.uint64(k)) | low.astype(np.uint64)


def coded(values: np.ndarray) -> bytes:
    """An ascending array of distinct numbers as the code of its gaps."""
    return golomb(np.diff(values, prepend=np.uint64(0)))


def decoded(code: bytes) -> np.ndarray:
    return np.cumsum(ungolomb(code), dtype=np.uint64)


def normalised(text: Column) -> Column:
    """The text without space and \\t to \\r; null is empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", "")


def _cuts(width: int, owners: int) -> np.ndarray:
    return np.arange(1, owners, dtype=np.uint64) * np.uint64(width)


def repeated(rows: DataFrame, bits: int, owners: int) -> DataFrame:
    """``sender, mask, words``: for each sender of ``rows(sender, print)`` that holds a fingerprint more than once, or one that another sender holds too, a filter of
    these: bit ``print & mask`` of ``words`` is set. Only the first ``bits`` bits of the 64 of ``print`` are exchanged.

    Every sender cuts its sorted distinct fingerprints by owner, a range of values each, and sends each owner the Golomb code of its part; an owner
    answers each message with a bitmap of the values that came in more than one. A value comes once from a sender, so no group of copies makes a message large.
    """
    width, down = -(-(1 << bits) // owners), np.uint64(64 - bits)

    def held(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct fingerprints, how often each occurs here, and where each owner's part ends."""
        values, n = np.unique(batch["print"].to_numpy(np.int64).view(np.uint64) >> down, return_counts=True)
        return values, n, np.r_[0, np.searchsorted(values, _cuts(width, owners)), len(values)]

    def send(batch: pd.DataFrame) -> pd.DataFrame:
        values, _, at = held(batch)
        to = np.flatnonzero(np.diff(at))
        codes = [coded(values[at[o] : at[o + 1]] - np.uint64(int(o) * width)) for o in to]
        return pd.DataFrame({"sender": np.full(len(to), batch["sender"].iloc[0], np.int32), "owner": to.astype(np.int32), "code": codes})

    def answer(batch: pd.DataFrame) -> pd.DataFrame:
        parts = [decoded(c) for c in batch["code"]]
        values, n = np.unique(np.concatenate(parts), return_counts=True)
        twice = values[n > 1]
        return pd.DataFrame({"sender": batch["sender"], "owner": batch["owner"], "bitmap": [np.packbits(np.isin(p, twice, assume_unique=True)).tobytes() for p in parts]})

    def receive(batch: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"sender": np.empty(0, np.int32), "mask": np.empty(0, np.int64), "words": np.empty(0, object)})
        if not len(batch):
            return none
        values, n, at = held(batch)
        again = n > 1
        for o, bitmap in zip(answers["owner"], answers["bitmap"]):
            size = at[o + 1] - at[o]
            again[at[o] : at[o + 1]] |= np.unpackbits(np.frombuffer(bitmap, np.uint8))[:size].astype(bool)
        if not again.any():
            return none
        slots = max(64, 1 << int(SLOTS_EACH * len(values) - 1).bit_length())
        prints = batch["print"].to_numpy(np.int64).view(np.uint64)
        hit = prints[again[np.searchsorted(values, prints >> down)]] & np.uint64(slots - 1)
        words = np.zeros(slots // 64, np.uint64)
        np.bitwise_or.at(words, (hit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (hit & np.uint64(63)))
        return pd.DataFrame({"sender": [batch["sender"].iloc[0]], "mask": [slots - 1], "words": [words.view(np.int64)]})

    rows = rows.select("sender", "print")
    sent = rows.groupBy("sender").applyInPandas(send, "sender int, owner int, code binary")
    answers = sent.groupBy("owner").applyInPandas(answer, "sender int, owner int, bitmap binary")
    return rows.groupBy("sender").cogroup(answers.groupBy("sender")).applyInPandas(receive, "sender int, mask bigint, words array<bigint>")


#: The longest text first, then the smallest id; null ids last.
_RANK = "cast(n_chars as decimal(10,0)) * 36893488147419103232BD + if(doc_id is null, 0BD, 9223372036854775808BD - cast(doc_id as decimal(19,0)))"


def duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row of ``docs(doc_id, text)``.

    Rows are equal when their texts are, byte for byte, without space and \\t to \\r. Of equal rows one is kept: the one with the most code points in the original
    text, then the smallest doc_id. ``text_sha256`` is the digest of the normalised text. Null text counts as empty, and so equals every text of white space. Null ids are rows like
    others and lose to any id. Rows that repeat an id, or a whole row, count each; one of them is kept. Other columns are ignored; an empty table gives no rows.

    Each input partition is a sender (see :func:`repeated`). Rows with their normalised texts are written once, bucketed by sender, so that the filters
    come to the texts and not the texts to the filters: only suspects leave their bucket. Those are grouped by fingerprint and text, which Spark compares as bytes; copies are
    counted before the shuffle, so a group of any size sends one row from each task. Rows of the LARGE_GROUPS largest groups are told their group where they are, so no large key is shuffled
    to learn it. The rest are alone in their group.
    """
    spark = docs.sparkSession
    text = normalised(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.length(F.col("text").cast("string")), F.lit(0)).alias("n_chars"), text.alias("norm"))
    rows = rows.withColumns({"print": F.xxhash64("norm"), "text_sha256": F.sha2("norm", 256), "sender": F.spark_partition_id(), "no": F.monotonically_increasing_id()})
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = scratch.bucketed(rows, "exact", "sender", buckets)
    n = rows.count()
    bits = min(63, max(16, n.bit_length() + SPARE_BITS))
    owners = max(1, -(-n // MOST_OWNED), min(buckets, -(-n // LEAST_OWNED)))
    filters = scratch.written(repeated(rows, bits, owners), "exact-filters")
    slot = F.col("print").bitwiseAND(F.col("mask"))
    word = F.get("words", F.shiftright(slot, 6).cast("int"))
    hit = F.expr("shiftright(_word, cast(_slot & 63 as int)) & 1") == 1
    rows = rows.join(filters.hint("shuffle_hash"), "sender", "left").withColumns({"_slot": slot, "_word": word}).withColumn("suspect", F.coalesce(hit, F.lit(False)))

    rank = F.expr(_RANK)
    same = rows.where("suspect").groupBy("print", "norm").agg(F.count("*").alias("group_size"), F.max_by("doc_id", rank).alias("keep_id"), F.max_by("no", rank).alias("keep_no"))
    same = scratch.written(same.where("group_size > 1").select(F.sha2("norm", 256).alias("text_sha256"), "keep_id", "keep_no", "group_size"), "exact-groups")
    suspects = rows.where("suspect").select("doc_id", "no", "text_sha256")
    large = suspects.join(F.broadcast(same.orderBy(F.desc("group_size"), "text_sha256").limit(LARGE_GROUPS)), "text_sha256", "left")
    rest = large.where("keep_no is null").select("doc_id", "no", "text_sha256").join(same.hint("merge"), "text_sha256", "left")
    suspects = large.where("keep_no is not null").unionByName(rest)
    alone = rows.where("not suspect").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    single = F.col("keep_no").isNull()
    kept = suspects.select("doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), (single | (F.col("no") == F.col("keep_no"))).alias("kept"), "text_sha256")
    return kept.unionByName(alone)
