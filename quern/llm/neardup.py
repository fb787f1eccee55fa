"""Near-duplicate documents: b-bit MinHash signatures, band candidates, exact confirmation on full shingle sets, components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import scratch
from quern.llm.components import components, roots
from quern.llm.scratch import shuffled
from quern.llm.words import hashed, hashes, mixed, windows, words

#: 42 bands of 6 minima miss a pair of similarity 0.8 with a probability of 3e-6; two bits of each minimum are kept.
BANDS, ROWS, BITS = 42, 6, 2
HASHES = BANDS * ROWS
LONGS = math.ceil(HASHES * BITS / 64)
#: A pair is confirmed exactly unless its estimate lies this many standard deviations below the threshold.
SIGMAS = 4.5

_rng = np.random.default_rng(20)
_XOR = _rng.integers(0, 2**32, HASHES, dtype=np.uint32)[:, None]
_MUL = _rng.integers(0, 2**31, HASHES, dtype=np.uint32)[:, None] * np.uint32(2) + np.uint32(1)


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of ``size`` words; of fewer words the whole sequence is one; without words empty."""
    return shingled(hashed(words(text)), size)


def shingled(h: np.ndarray, size: int) -> np.ndarray:
    return np.unique(windows(h, min(size, len(h)))) if len(h) else np.empty(0, np.uint64)


def minima(s: np.ndarray) -> np.ndarray:
    """Minimum of the set under each of HASHES permutations of 32-bit values."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 512):
        np.minimum(out, ((x[None, i : i + 512] ^ _XOR) * _MUL).min(axis=1), out=out)
    return out


def signature(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and the packed low bits of the (mixed) minima, as signed 64-bit numbers."""
    full = mixed(m.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    bands = np.arange(BANDS, dtype=np.uint64)
    grid = full.reshape(BANDS, ROWS)
    for k in range(ROWS):
        bands = mixed(bands * np.uint64(0x9E3779B97F4A7C15) + grid[:, k])
    low = np.zeros(LONGS * 64 // BITS, np.uint64)
    low[:HASHES] = full & np.uint64(2**BITS - 1)
    packed = (low.reshape(LONGS, -1) << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64)
    return bands.view(np.int64), packed.view(np.int64)


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, text``: with the id, the 128-bit digest names a text, also where an id repeats."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.select("doc_id", digest(F.col("text")).alias("text_key"), "text")


def digest(text: Column) -> Column:
    """128 bits that name a text."""
    return F.unhex(F.md5(text.cast("string").cast("binary")))


def signed(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, text_key, n_shingles, set_key, bands, sig`` of every row; an empty set has null in the last three."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, key, bands, sig = [], [], [], []
            for h in hashes(b.column("text")):
                s = shingled(h, size)
                n.append(len(s))
                if not len(s):
                    key.append(None), bands.append(None), sig.append(None)
                    continue
                x, y = signature(minima(s))
                key.append(xxhash.xxh3_128_digest(s.tobytes())), bands.append(x), sig.append(y)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_key"), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.list_(pa.int64()))],
                names=["doc_id", "text_key", "n_shingles", "set_key", "bands", "sig"],
            )

    return keyed(docs).transform(scratch.bounded).mapInArrow(run, "doc_id bigint, text_key binary, n_shingles bigint, set_key binary, bands array<bigint>, sig array<bigint>")


def estimate(a: str, b: str) -> Column:
    """Similarity of two signatures by counts of equal low bits, corrected for chance hits: (m - 2^-b) / (1 - 2^-b)."""
    low = sum(1 << i for i in range(0, 64, BITS))
    differ = F.lit(0)
    for i in range(LONGS):
        x = F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))
        folded = x
        for k in range(1, BITS):
            folded = folded.bitwiseOR(F.shiftrightunsigned(x, k))
        differ = differ + F.bit_count(folded.bitwiseAND(F.lit(low).cast("bigint")))
    chance = 2.0**-BITS
    return (1 - differ / F.lit(float(HASHES)) - chance) / (1 - chance)


def floor_of(threshold: float) -> float:
    """The least estimate at which a pair is still confirmed on its full sets."""
    chance = 2.0**-BITS
    hit = threshold + (1 - threshold) * chance
    return threshold - SIGMAS * math.sqrt(hit * (1 - hit) / HASHES) / (1 - chance)


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of ``pairs(u, v)`` whose full shingle sets have 100 * intersection >= percent * union."""
    both = shuffled(pairs, texts.select(F.col("id").alias("u"), F.col("text").alias("a")), "u")
    both = shuffled(both, texts.select(F.col("id").alias("v"), F.col("text").alias("b")), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, t = (None, None)
        for batch in batches:
            us, vs = [], []
            for u, v, a, b in zip(batch.column("u"), batch.column("v"), hashes(batch.column("a")), hashes(batch.column("b"))):
                if v.as_py() != last:
                    last, t = v.as_py(), shingled(b, size)
                s = shingled(a, size)
                common = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * common >= percent * (len(s) + len(t) - common):
                    us.append(u.as_py()), vs.append(v.as_py())
            yield pa.RecordBatch.from_pydict({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return both.select("u", "v", "a", "b").transform(scratch.bounded).mapInArrow(run, "u bigint, v bigint")


def full_sets(texts: DataFrame, size: int) -> DataFrame:
    """``id, members``: the whole shingle set of every row of ``texts(id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingled(h, size).view(np.int64) for h in hashes(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(sets, pa.list_(pa.int64()))], names=["id", "members"])

    return texts.select("id", "text").transform(scratch.bounded).mapInArrow(run, "id bigint, members array<bigint>")


def groups(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Near-duplicate groups of ``docs(doc_id, text)`` by distinct ``size``-word shingles (A-Z lower-cased words).

    Rows link when 100 * intersection >= percent * union of their sets; components of links are groups. Returns
    ``doc_id, n_shingles, component_id`` (smallest doc_id of the group), ``kept`` (doc_id = component_id), one row for each input row.

    Null or wordless texts have empty sets and link with nothing. A null doc_id links with nothing, has a null
    component and stays. Of rows that repeat an id with different texts each links by its own set, and the id alone links
    none of them, so they may differ in component. Other columns are ignored; an empty table gives no rows.

    See :func:`placed` for how groups are found; pairs inside one component are never made, whatever a group's size.
    """
    rows, found = placed(docs, size, percent)
    out = shuffled(rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key")), found, "set_key", "left")
    component = F.coalesce("component.doc_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def leaders(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, text_key``, distinct, of the rows to keep so that one of each group stays: the smallest id's, of an id's different texts the one of the
    smallest ``text_key`` (see :func:`keyed`). Rows without words and rows without an id that repeat no other text are kept; null ids come last in a group."""
    last = F.lit(2**63 - 1)
    rows, found = placed(docs.withColumn("doc_id", F.coalesce(F.col("doc_id").cast("bigint"), last)), size, percent)
    rows = rows.select("doc_id", "text_key", "set_key").distinct()
    kept = shuffled(rows, found, "set_key", "left").where("component is null or (component.doc_id = doc_id and component.text_key <=> text_key)")
    return kept.select(F.nullif("doc_id", last).alias("doc_id"), "text_key")


#: Rows of a side that a cell of a bucket holds, about.
CELL = 1024


def dealt(rows: DataFrame, few: bool, size: int = CELL) -> DataFrame:
    """One side of a join by ``key, line, column``: ``rows(key, id, ..., n_few, n_all)`` with the bucket's number of rows on the few side and on all.

    A bucket of many rows is a table of lines of ``size`` few rows and columns of ``size`` rows of all: a row has its own line, or column, by a hash of the
    id, and is repeated along it. So each pair meets in one cell and no task holds a bucket.
    """
    lines, columns = (F.ceil(F.col(n) / size).cast("int") for n in ("n_few", "n_all"))
    own, other = ("line", "column") if few else ("column", "line")
    mine = F.pmod(F.xxhash64("id"), lines if few else columns).cast("int")
    return rows.withColumn(own, mine).withColumn(other, F.explode(F.sequence(F.lit(0), (columns if few else lines) - 1)))


def placed(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs(doc_id, text)`` with their set (see :func:`signed`), and ``set_key, component`` of each set of rows that have an id:
    the least (doc_id, text_key) of the sets that it reaches.

    Equal sets collapse to one numbered node first; its text is one of its smallest id's. Every node then goes to its bucket's smallest member in each band,
    never to all of them; the best partner by estimate is confirmed on full sets, then others that still join two components. At last, in
    buckets where components still differ, members outside of the bucket's main component meet all members of other ones, in cells of bounded size (see
    :func:`dealt`), so no candidate pair is given up: the join itself holds estimate and full sets against the threshold and puts out links only.
    """
    rows = scratch.written(signed(docs, size), "near-sets")
    least = F.min(F.struct("doc_id", "text_key")).alias("least")
    nodes = rows.where("doc_id is not null and set_key is not null").groupBy("set_key").agg(least, F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    named = [F.monotonically_increasing_id().alias("id"), "set_key", "least", F.col("least.doc_id").alias("rep"), F.col("least.text_key").alias("text_key")]
    nodes = scratch.written(nodes.select(*named, "n", "bands", *[F.col("sig")[i].alias(f"s{i}") for i in range(LONGS)]), "near-nodes")
    reps = scratch.written(nodes.select("id", "set_key", "least"), "near-reps")
    banded = nodes.select("id", F.explode("bands").alias("key"))
    firsts = banded.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("members")).where("members > 1").select("key", "rep")
    shared = scratch.written(shuffled(banded, firsts, "key"), "near-shared")  # rows of buckets with company
    company = shuffled(nodes, shared.select("id").distinct(), "id", "left_semi").select("id", F.col("rep").alias("doc_id"), "text_key")
    texts = shuffled(keyed(docs).where("text is not null"), company, ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"])
    texts = scratch.written(texts.select("id", "text"), "near-texts")
    lowest, share = floor_of(percent / 100), percent / 100
    sigs = nodes.select("id", "n", *[f"s{i}" for i in range(LONGS)])

    def likely(a: str, b: str) -> Column:
        close = (F.col(f"{a}.n") >= F.col(f"{b}.n") * share) & (F.col(f"{b}.n") >= F.col(f"{a}.n") * share)
        return close & (estimate(a, b) >= lowest)

    stars = shared.where("id <> rep").select("id", "rep").distinct().alias("p")
    stars = shuffled(shuffled(stars, sigs.alias("a"), F.expr("p.id = a.id")), sigs.alias("b"), F.expr("p.rep = b.id")).where(likely("a", "b"))
    stars = scratch.written(stars.select(F.col("p.id").alias("u"), F.col("p.rep").alias("v"), estimate("a", "b").alias("est")), "near-stars")
    best = stars.groupBy("u").agg(F.max_by("v", F.struct("est", -F.col("v"))).alias("v"))
    linked = lambda found: found.select(F.col("id").alias("u"), F.col("component").alias("v"))
    found = roots(confirmed(best, texts, size, percent))  # a bucket's first has its smallest id
    open_ = shuffled(across(stars.select("u", "v"), found), best, ["u", "v"], "left_anti")
    found = components(linked(found).unionByName(confirmed(open_, texts, size, percent)))

    member = shuffled(shared.select("key", "id"), found, "id", "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    counts = member.groupBy("key", "c").agg(F.count("*").alias("n"))
    mains = counts.groupBy("key").agg(F.max_by("c", F.struct("n", "c")).alias("main"), F.count("*").alias("kinds"), F.sum("n").alias("n_all"), (F.sum("n") - F.max("n")).alias("n_few"))
    light = scratch.written(shuffled(shuffled(member, mains.where("kinds > 1").drop("kinds"), "key"), sigs, "id"), "near-light")
    few, all_ = dealt(light.where("c <> main"), True).alias("a"), dealt(light, False).alias("b")
    cross = (F.col("a.key") == F.col("b.key")) & (F.col("a.line") == F.col("b.line")) & (F.col("a.column") == F.col("b.column")) & (F.col("a.c") != F.col("b.c"))
    meets = cross & likely("a", "b")
    asking, asked = shuffled(few, all_, meets, "left_semi").select("key", "id"), shuffled(all_, few, meets, "left_semi").select("key", "id")
    live = scratch.written(shuffled(asking.unionByName(asked).distinct(), light, ["key", "id"]), "near-live")
    sets = scratch.written(full_sets(shuffled(texts, live.select("id").distinct(), "id", "left_semi"), size), "near-full")
    whole = shuffled(live, shuffled(nodes.select("id", "bands"), sets, "id"), "id")
    few, all_ = dealt(whole.where("c <> main"), True, 4 * CELL).alias("a"), dealt(whole, False, 4 * CELL).alias("b")
    once = F.array_position(F.zip_with("a.bands", "b.bands", lambda x, y: x == y), True) == F.array_position(F.col("a.bands"), F.col("a.key"))
    turn = (F.col("b.c") == F.col("b.main")) | (F.col("a.id") < F.col("b.id"))
    common = F.size(F.array_intersect("a.members", "b.members"))
    alike = 100 * common >= percent * (F.col("a.n") + F.col("b.n") - common)
    more = shuffled(few, all_, cross & turn & likely("a", "b") & once & alike).select(F.col("a.c").alias("u"), F.col("b.c").alias("v"))
    merged = components(more).select(F.col("id").alias("c"), F.col("component").alias("root"))  # of components, no longer of their members

    out = shuffled(reps, found, "id", "left").select("set_key", "least", F.coalesce("component", "id").alias("c"))
    out = shuffled(out, merged, "c", "left").select("set_key", "least", F.coalesce("root", "c").alias("c"))
    # written, so that the join's other side is a shuffle of its own, which Spark can split where one component holds many sets
    leasts = scratch.written(out.groupBy("c").agg(F.min("least").alias("component")), "near-leasts")
    out = shuffled(out, leasts, "c").select("set_key", "component")
    scratch.drop(shared, texts, stars, light, nodes, live, sets)
    return rows, out


def across(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Those of ``pairs(u, v)`` whose ends lie in different components of ``found(id, component)``."""
    a = found.select(F.col("id").alias("u"), F.col("component").alias("cu"))
    b = found.select(F.col("id").alias("v"), F.col("component").alias("cv"))
    both = shuffled(shuffled(pairs, a, "u", "left"), b, "v", "left")
    return both.where(F.coalesce("cu", "u") != F.coalesce("cv", "v")).select("u", "v")
