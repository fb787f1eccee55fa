"""Two tokenizers over the same texts: which tokens end together, and how often two ids are linked in the whole corpus."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import scratch

#: Vocabulary files and their folder; other files of the same two kinds can be given.
FOLDER, BYTE_FILE, PIECE_FILE = "/opt/tokenizers", "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Id pairs whose counts every worker holds: the most frequent ones. All others are joined by shuffle, where none of them is frequent.
HELD_PAIRS = 400_000
#: Bits of an id: a row of a batch and two ids fit in 63 bits.
ID_BITS, LARGEST = 21, (1 << 21) - 1
#: Distinct units after which a worker forgets those it knows, and the bytes of their groups' texts after which it does.
KEPT_UNITS, KEPT_BYTES = 250_000, 32 << 20
#: Bytes of a text that both tokenizers get at a time; a longer unit is one text.
CHUNK_BYTES = 4000
#: Where a text may be cut, unless a piece of the vocabulary reaches over such a place.
CUTS = " \n"


@dataclass
class Overlaps:
    """Elementary intervals of two tokenisations of one text, each interval the overlap of one A and one B token."""

    a: np.ndarray  # index of the A token of each interval
    b: np.ndarray  # index of the B token
    end: np.ndarray  # byte where the interval ends
    shared: np.ndarray  # whether an A and a B token both end there, which closes a group
    group: np.ndarray  # number of the interval's group

    def links(self, kind: str = "ends") -> tuple[np.ndarray, np.ndarray]:
        """Token pairs: those that end together (``ends``), that overlap (``overlaps``) or that lie in one group (``groups``: each group's product)."""
        if kind == "ends":
            return self.a[self.shared], self.b[self.shared]
        if kind == "overlaps":
            return self.a, self.b
        first = np.flatnonzero(np.r_[True, self.group[1:] != self.group[:-1]]) if len(self.group) else np.empty(0, np.int64)
        last = np.r_[first[1:], len(self.group)] - 1 if len(first) else first
        wide, high = self.a[last] - self.a[first] + 1, self.b[last] - self.b[first] + 1
        n = wide * high
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(self.a[first], n) + k // np.repeat(high, n), np.repeat(self.b[first], n) + k % np.repeat(high, n)


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> Overlaps:
    """The intervals between neighbours in the union of both ascending arrays of end bytes, each with the tokens that own it."""
    end = np.union1d(ends_a, ends_b)
    a, b = np.searchsorted(ends_a, end), np.searchsorted(ends_b, end)
    shared = (ends_a[a] == end) & (ends_b[b] == end) if len(end) else np.empty(0, bool)
    return Overlaps(a, b, end, shared, np.cumsum(shared) - shared)


class Pair:
    """Both tokenizers, with the byte length of every token, and whether texts may be cut at white space before they are encoded."""

    def __init__(self, folder: str = FOLDER, byte_file: str = BYTE_FILE, piece_file: str = PIECE_FILE) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has its own core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(f"{folder}/{byte_file}")
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{piece_file}")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level BPE writes as themselves; the others follow from U+0100 on
        byte_of = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in set(shown))}
        entries = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.bytes_a = [bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t in entries]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        one = [int(p[3:5], 16) if self.b.is_byte(i) else -1 for i, p in enumerate(pieces)]
        self.bytes_b = [bytes([x]) if x >= 0 else p.replace("▁", " ").encode() for x, p in zip(one, pieces)]
        most = max(len(entries), len(pieces))
        if most > LARGEST:
            raise ValueError(f"a vocabulary of more than {LARGEST} ids")
        self.signs = [f"{i}{c}" for i in range(most) for c in ",|,;"]
        self.size_a, self.size_b = (np.array([len(t) for t in x]) for x in (self.bytes_a, self.bytes_b))
        plain = [p.replace("▁", " ") for p in pieces]
        reached = {y for p in plain for x, y in zip(p, p[1:]) if y in CUTS and not x.isspace()}
        cuts = "".join(c for c in CUTS if c not in reached)
        self.cut = re.compile(rf"(?<=[^\s\u180e])(?=[{cuts}])") if type(self.a.pre_tokenizer).__name__ == "ByteLevel" and " " in cuts else None

    def units(self, text: str) -> list[str]:
        return self.cut.split(text) if self.cut else [text]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both sides for texts that begin with white space, None where a side's bytes are not the text's."""
        found = self.a.encode_batch_fast(texts, add_special_tokens=False)
        out: list[tuple[np.ndarray, np.ndarray] | None] = []
        for text, x, y in zip(texts, found, self.b.encode([t[1:] for t in texts], num_threads=1)):
            ids, raw = x.ids, text.encode()
            same = b"".join([self.bytes_a[i] for i in ids]) == raw and b"".join([self.bytes_b[i] for i in y]) == raw
            out.append((np.array(ids, np.int64), np.array(y, np.int64)) if same else None)
        return out


_pairs: dict[tuple[str, str, str], Pair] = {}


def pair(folder: str = FOLDER, byte_file: str = BYTE_FILE, piece_file: str = PIECE_FILE) -> Pair:
    """The tokenizers of a worker, loaded once."""
    key = (folder, byte_file, piece_file)
    if key not in _pairs:
        _pairs[key] = Pair(*key)
    return _pairs[key]


class Units:
    """What the alignment of distinct units gives, by number: ``counts`` (A tokens, B tokens, groups), whether both sides give the unit back (``ok``), its groups as
    text (``said``), and its links ``A id << ID_BITS | B id``, those of unit i from ``starts[i]`` up to ``starts[i + 1]``."""

    def __init__(self, tokenizers: Pair, kind: str = "ends") -> None:
        self.tokenizers, self.kind = tokenizers, kind
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.said: list[str] = []
        self.counts, self.ok = np.zeros((0, 3), np.int64), np.zeros(0, bool)
        self.links, self.starts = np.empty(0, np.int64), np.zeros(1, np.int64)

    def numbers(self, units: list[str]) -> np.ndarray:
        """The number of each unit; new ones are aligned."""
        new = [u for u in units if u not in self.number]
        if new:
            self.number.update(zip(new, range(len(self.said), len(self.said) + len(new))))
            counts, ok, said, links, sizes = aligned(self.tokenizers, new, self.kind)
            self.said += said
            self.counts, self.ok, self.links = np.concatenate([self.counts, counts]), np.r_[self.ok, ok], np.r_[self.links, links]
            self.starts = np.r_[self.starts, self.starts[-1] + np.cumsum(sizes)]
        return np.fromiter(map(self.number.__getitem__, units), np.int64, len(units))


def _said(tokenizers: Pair, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, shared: np.ndarray) -> list[str]:
    """The tokens of all groups in the order of ``a1,a2|b1;a3|b2,b3``, each with the sign that follows it."""
    group_a, group_b = np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)
    upto_a, upto_b = np.searchsorted(ends_a, shared, "right"), np.r_[0, np.searchsorted(ends_b, shared, "right")]
    code = np.empty(len(a) + len(b), np.int64)
    code[np.arange(len(a)) + upto_b[group_a]] = 4 * a + (ends_a == shared[group_a])
    code[np.arange(len(b)) + upto_a[group_b]] = 4 * b + 2 + (ends_b == shared[group_b])
    return list(map(tokenizers.signs.__getitem__, code.tolist()))


def aligned(tokenizers: Pair, units: list[str], kind: str = "ends") -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray]:
    """Counts, whether both sides give it back, groups, links and number of links of every unit. Units that end without white space are encoded many at a
    time, as no token reaches over their borders; where such a text is not given back byte for byte, its units are encoded alone."""
    n = len(units)
    counts, ok, said, sizes, found_links = np.zeros((n, 3), np.int64), np.zeros(n, bool), [""] * n, np.zeros(n, np.int64), {}
    chunks: list[tuple[int, int]] = []
    lengths = [len(u.encode()) for u in units]
    begin = filled = 0
    for i, u in enumerate(units):
        alone = not tokenizers.cut or u[-1:].isspace()
        if begin < i and (alone or filled >= CHUNK_BYTES):
            chunks.append((begin, i))
            begin, filled = i, 0
        filled += CHUNK_BYTES if alone else lengths[i]
    chunks += [(begin, n)] if n else []
    # a chunk begins with a unit of its own, as a unit may begin with a line break, and the piece tokenizer puts a space there
    first = " ." if tokenizers.cut else ""
    while chunks:
        again: list[tuple[int, int]] = []
        for (i, j), found in zip(chunks, tokenizers.encode([first + "".join(units[i:j]) for i, j in chunks])):
            if found is None:
                again += [(k, k + 1) for k in range(i, j)] if j > i + 1 else []
                continue
            a, b = found
            ends_a, ends_b = np.cumsum(tokenizers.size_a[a]), np.cumsum(tokenizers.size_b[b])
            o = overlaps(ends_a, ends_b)
            x, y = o.links(kind)
            shared = o.end[o.shared]
            stops = len(first) + np.cumsum([0, *lengths[i:j]])
            ka, kb, kg, kl = (np.searchsorted(e, stops, "right") for e in (ends_a, ends_b, shared, np.maximum(ends_a[x], ends_b[y])))
            parts, at = _said(tokenizers, a, b, ends_a, ends_b, shared), (ka + kb).tolist()
            said[i:j] = ["".join(parts[k:m])[:-1] for k, m in zip(at, at[1:])]
            counts[i:j], sizes[i:j], ok[i:j] = np.column_stack([np.diff(ka), np.diff(kb), np.diff(kg)]), np.diff(kl), True
            found_links[i] = ((a[x] << ID_BITS) | b[y])[kl[0] :]
        chunks = again
    return counts, ok, said, np.concatenate([np.empty(0, np.int64), *[found_links[i] for i in sorted(found_links)]]), sizes


_FOUND = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, a array<int>, b array<int>, times array<int>"


def align(docs: DataFrame, kind: str = "ends", folder: str = FOLDER, byte_file: str = BYTE_FILE, piece_file: str = PIECE_FILE) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: ``doc_id, n_a, n_b, n_groups, n_links, groups_sha256`` and its distinct linked id pairs
    ``a, b`` with how often each occurs (``times``).

    A space is put before the text; both tokenizers encode it without special tokens. Bytes where tokens of both end cut the tokens into groups;
    ``groups_sha256`` is the digest of ``a1,a2|b1;a3|b2,b3``. Links are token pairs of a ``kind`` (see :meth:`Overlaps.links`). Null and empty texts, and texts
    that a tokenizer does not give back byte for byte, have no tokens: zeros, an empty digest and empty arrays. Repeated rows and ids are rows of their own;
    null ids stay; other columns are ignored; an empty table gives no rows.

    No token of either vocabulary reaches from other characters into a space or line break (checked when it is loaded, else a text is one unit), so a text is
    cut there into units that are aligned on their own, each distinct unit of a batch once. The folder must be at the same place on every machine.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = pair(folder, byte_file, piece_file)
        known, size = Units(tokenizers, kind), 0
        for batch in batches:
            raw = batch.column("text").cast(pa.large_binary()).to_pylist()
            texts = [" " + t.decode("utf-8", "replace") if t else "" for t in raw]
            split = [tokenizers.units(t) if t else [] for t in texts]
            flat = pa.array([u for s in split for u in s], pa.large_string()).dictionary_encode()
            if len(known.said) > KEPT_UNITS or size > KEPT_BYTES:
                known.forget()
                size = 0
            since = len(known.said)
            at, n = known.numbers(flat.dictionary.to_pylist())[flat.indices.to_numpy(zero_copy_only=False)], len(raw)
            size += sum(map(len, known.said[since:]))
            row = np.repeat(np.arange(n), [len(s) for s in split])
            bad = np.array([bool(t) and x[1:].encode() != t for t, x in zip(raw, texts)], bool)
            bad[row[~known.ok[at]]] = True
            per = np.diff(known.starts)[at]
            sums = [np.bincount(row, x, n).astype(np.int64) * ~bad for x in (*known.counts[at].T, per)]
            said, digests, k = list(map(known.said.__getitem__, at.tolist())), [], 0
            for s, b in zip(split, bad.tolist()):
                digests.append(hashlib.sha256(";".join(said[k : k + len(s)]).encode()).hexdigest() if s and not b else "")
                k += len(s)
            place = np.repeat(known.starts[at] - (np.cumsum(per) - per), per) + np.arange(per.sum())
            owner = np.repeat(row, per)
            live = ~bad[owner]
            keys, times = np.unique((owner[live] << 2 * ID_BITS) | known.links[place[live]], return_counts=True)
            a, b, offsets = (keys >> ID_BITS) & LARGEST, keys & LARGEST, np.searchsorted(keys >> 2 * ID_BITS, np.arange(n + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.astype(np.int32))) for x in (a, b, times)]
            columns = [batch.column("doc_id"), *map(pa.array, sums), pa.array(digests, pa.string()), *lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a", "b", "times"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.transform(scratch.bounded).mapInArrow(run, _FOUND)


def pair_counts(found: DataFrame) -> DataFrame:
    """``a, b, n, best`` of every id pair in the rows of :func:`align`: links in the whole corpus, and whether no other pair of the same ``b`` has more."""
    each = found.select(F.explode(F.arrays_zip("a", "b", "times")).alias("p")).groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.sum("p.times").alias("n"))
    counts = scratch.written(each, "align-counts")
    return counts.join(counts.groupBy("b").agg(F.max("n").alias("most")), "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def scored(docs: DataFrame, held_pairs: int = HELD_PAIRS, **kwargs) -> DataFrame:
    """The rows of :func:`align`, which takes ``kwargs``, without the pairs, with ``n_best`` (links whose pair is the most frequent one of its B id, ties
    included) and ``count_sum`` (over links, the number of links in the corpus that link the same two ids).

    Texts are tokenised once; the written rows hold numbers only. The ``held_pairs`` most frequent pairs go to every worker, which leaves few links whose pair must be
    looked up in the rest by a join, and no frequent key in that join.
    """
    found = scratch.written(align(docs, **kwargs).withColumn("_no", F.monotonically_increasing_id()), "align")
    counts = scratch.written(pair_counts(found), "align-pairs")
    spark = docs.sparkSession
    some = counts.count() > held_pairs
    top = counts.orderBy(F.desc("n"), "a", "b").limit(held_pairs) if some else counts
    held = top.toArrow()
    keys = (held.column("a").to_numpy().astype(np.int64) << 32) | held.column("b").to_numpy()
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast((keys[order], held.column("n").to_numpy()[order].astype(np.int64), held.column("best").to_numpy(zero_copy_only=False)[order].astype(bool)))
    plain = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "_no"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = shared.value
        for batch in batches:
            offsets = batch.column("a").offsets.to_numpy()
            a, b, times = (pc.list_flatten(batch.column(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("a", "b", "times"))
            want, row = (a << 32) | b, np.repeat(np.arange(len(batch)), np.diff(offsets))
            at = np.minimum(np.searchsorted(known, want), max(0, len(known) - 1))
            hit = known[at] == want if len(known) else np.zeros(len(want), bool)
            sums = [np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)]
            np.add.at(sums[0], row[hit], (times * best[at])[hit]) if len(known) else None
            np.add.at(sums[1], row[hit], (times * n[at])[hit]) if len(known) else None
            left = np.r_[0, np.cumsum(np.bincount(row[~hit], minlength=len(batch)))].astype(np.int32)
            rest = [pa.ListArray.from_arrays(pa.array(left), pa.array(x[~hit].astype(np.int32))) for x in (a, b, times)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in plain], *map(pa.array, sums), *rest], names=[*plain, "n_best", "count_sum", "a", "b", "times"])

    schema = f"{_FOUND.partition(', a array')[0]}, _no bigint, n_best bigint, count_sum bigint, a array<int>, b array<int>, times array<int>"
    out = found.select(*plain, "a", "b", "times").transform(scratch.bounded).mapInArrow(run, schema)
    if not some:
        return out.drop("_no", "a", "b", "times")
    out = scratch.written(out, "align-held")
    last = top.agg(F.min("n").alias("n")).first()["n"]
    rare = counts.where(F.col("n") <= last)  # pairs beyond the held ones are no more frequent than the last of those
    more = out.select("_no", F.explode(F.arrays_zip("a", "b", "times")).alias("p")).select("_no", "p.*").join(rare, ["a", "b"])
    more = more.groupBy("_no").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more_sum"))
    plus = lambda c, d: (F.col(c) + F.coalesce(d, F.lit(0))).alias(c)
    return out.join(more, "_no", "left").select(*plain[:-1], plus("n_best", "more_best"), plus("count_sum", "more_sum"))
