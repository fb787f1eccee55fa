"""Exact vector retrieval: top-k, merging of query variants, thresholds, diversification, grouping by paper."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.numbers import threshold_grid
from quern.functions.vectors import dot, dot_with
from quern.operators import cells
from quern.sources import tables

#: Query vectors that one plan may unroll; more are joined.
MAX_UNROLLED = 16
#: A query table of at most this many rows is broadcast to the vectors; a larger one is searched in blocks.
BLOCK = 4096
#: Vectors that meet a block of queries at a time, and rows of a batch that is put out.
STRIPE, OUT = 32768, 65536


def top_k(vectors: DataFrame, query: Sequence[float], k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` vectors with the greatest inner product: a narrow scan with generated arithmetic and a bounded heap in each task."""
    return vectors.select(id_col, dot_with(F.col(vector_col), list(query)).alias("score")).orderBy(F.desc("score"), id_col).limit(max(1, k))


def met(rows: DataFrame, queries: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every row with every one of ``queries(query_id, ...)``, a stated set that is counted first and broadcast in blocks of about ``block`` rows; the rows
    are scanned once a block and never moved. Filter or rank what comes of it before anything else moves."""
    blocks = max(1, -(-queries.count() // block))
    if blocks == 1:
        return rows.join(F.broadcast(queries))
    numbered, out = queries.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")), None
    for b in range(blocks):
        part = rows.join(F.broadcast(numbered.where(F.col("_block") == b).drop("_block")))
        out = part if out is None else out.unionByName(part)
    return out


def scores(vectors: DataFrame, queries: DataFrame, keep: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """``query_id, vec_id, score`` of every vector for every row of ``queries(query_id, query)``: see :func:`met`."""
    pairs = met(vectors.select("vec_id", "embedding", *keep), queries.select("query_id", "query"), block)
    return pairs.select("query_id", "vec_id", dot(F.col("embedding"), F.col("query")).alias("score"), *keep)


class _Best:
    """The ``k`` best rows of each query so far: greatest score first (not-a-number before numbers, NULL after them), then the row that came first.

    A product of single-precision matrices, with a bound on its error, tells which pairs may matter; only those are scored, in double precision and in the vectors' own
    order of terms, as :func:`quern.functions.vectors.dot` scores them. Vectors with NULL, infinite, huge or not-a-number elements or of another length are scored without that product.
    """

    def __init__(self, queries: list, k: int, least: float | None):
        self.k, self.least, self.n = k, least, len(queries)
        self.queries = [None if q is None or any(x is None for x in q) else np.array(q, dtype=float) for q in queries]
        sizes = Counter(len(q) for q in self.queries if q is not None)
        self.width = sizes.most_common(1)[0][0] if sizes else 0
        self.usual = np.array([i for i, q in enumerate(self.queries) if q is not None and len(q) == self.width and _tame(q[None])[0]], dtype=np.int64)
        self.odd = [i for i in range(self.n) if i not in set(self.usual.tolist())]
        own = np.array([self.queries[i] for i in self.usual]).reshape(len(self.usual), self.width)
        self.terms, self.single, self.size = np.ascontiguousarray(own.T), own.astype(np.float32), np.sqrt((own * own).sum(axis=1))
        self.reset()

    def reset(self) -> None:
        shape = (self.n, self.k)
        self.score, self.kind, self.came = np.zeros(shape), np.zeros(shape, dtype=np.int8), np.full(shape, -1, dtype=np.int64)
        self.bar = np.full(self.n, -np.inf if self.least is None else self.least)

    def add(self, vectors: pa.Array, at: int) -> None:
        """``vectors``, the first of which is the ``at``-th row."""
        flat, width = vectors.flatten(), self.width
        lengths = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
        if not flat.null_count and (lengths == width).all():
            rows, own = np.arange(len(vectors)), flat.to_numpy(zero_copy_only=False).reshape(-1, width).astype(float)
            others = []
        else:
            listed = [None if v is None or any(x is None for x in v) else np.array(v, dtype=float) for v in vectors.to_pylist()]
            rows = np.array([i for i, v in enumerate(listed) if v is not None and len(v) == width], dtype=np.int64)
            own = np.array([listed[i] for i in rows]).reshape(len(rows), width)
            others = [(i, v) for i, v in enumerate(listed) if v is None or len(v) != width]
        tame = _tame(own)
        others += [(int(i), v) for i, v in zip(rows[~tame], own[~tame])]
        rows, own = rows[tame], own[tame]
        found = [self._pairs(own, rows + at)] if len(rows) and len(self.usual) else []
        blank = [i + at for i, v in sorted((i, v is None) for i, v in others) if v][: self.k]  # of rows whose score is NULL for all, the first can matter
        if self.least is None:
            found += [(np.full(len(blank), q), np.zeros(len(blank)), np.zeros(len(blank), dtype=np.int8), np.array(blank, dtype=np.int64)) for q in range(self.n) if blank]
        for i, v in others:
            if v is not None:
                found.append(self._one(v, np.arange(self.n), self.queries, np.full(self.n, i + at)))
        for q in self.odd:
            if self.queries[q] is None:
                found.append(self._one(None, np.full(len(rows), q), own, rows + at))
            else:
                found.append(self._one(self.queries[q], np.full(len(rows), q), own, rows + at))
        if found:
            self._merge(*[np.concatenate(x) for x in zip(*found)])

    def _pairs(self, own: np.ndarray, came: np.ndarray) -> tuple:
        terms, single, size = np.ascontiguousarray(own.T), own.astype(np.float32).T, np.sqrt((own * own).sum(axis=1)).max()
        out = []
        for i in range(0, len(self.usual), 256):
            mine = self.usual[i : i + 256]
            near = self.single[i : i + 256] @ single
            wide = (self.width + 8) * 1.2e-7 * self.size[i : i + 256] * size + 1e-30
            bar = self.bar[mine]
            new = self.came[mine, -1] < 0
            if self.k <= near.shape[1] and new.any():  # the k-th of these is no better than the k-th of all
                bar[new] = np.maximum(bar[new], np.partition(near[new], -self.k, axis=1)[:, -self.k] - wide[new])
            bar = np.nextafter((bar - wide).astype(np.float32), np.float32(-np.inf))
            q, v = np.divmod(np.flatnonzero(near >= bar[:, None]), near.shape[1])
            for j in range(0, len(q), 1 << 20):
                a, b = q[j : j + (1 << 20)], v[j : j + (1 << 20)]
                score = np.zeros(len(a))
                for x, y in zip(self.terms, terms):
                    score += x[a + i] * y[b]
                keep = score >= self.bar[mine[a]]
                out.append((mine[a[keep]], score[keep], np.ones(keep.sum(), dtype=np.int8), came[b[keep]]))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else tuple(np.zeros(0, dtype=t) for t in (np.int64, float, np.int8, np.int64))

    def _one(self, v: np.ndarray | None, queries: np.ndarray, others: Sequence, came: np.ndarray) -> tuple:
        """Scores of ``v`` with each of ``others``; NULL where a side is missing or has another length."""
        fits = np.array([v is not None and o is not None and len(o) == len(v) for o in others], dtype=bool)
        score = np.zeros(len(others))
        with np.errstate(all="ignore"):
            both = np.array([o for o, f in zip(others, fits) if f]).reshape(fits.sum(), 0 if v is None else len(v))
            for j in range(both.shape[1]):
                score[fits] += both[:, j] * v[j]
        kind = np.where(fits, np.where(np.isnan(score), 2, 1), 0).astype(np.int8)
        keep = np.ones(len(others), dtype=bool) if self.least is None else (kind == 2) | ((kind == 1) & (score >= self.least))
        return queries[keep], np.where(kind == 1, score, 0.0)[keep], kind[keep], came[keep]

    def _merge(self, q: np.ndarray, score: np.ndarray, kind: np.ndarray, came: np.ndarray) -> None:
        touched = np.unique(q)
        held = self.came[touched] >= 0
        q = np.concatenate([q, np.broadcast_to(touched[:, None], held.shape)[held]])
        score, kind, came = (np.concatenate([new, old[touched][held]]) for new, old in ((score, self.score), (kind, self.kind), (came, self.came)))
        order = np.lexsort((came, -score, -kind, q))
        q, score, kind, came = q[order], score[order], kind[order], came[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < self.k
        q, place = q[keep], place[keep]
        self.score[q, place], self.kind[q, place], self.came[q, place] = score[keep], kind[keep], came[keep]
        full = touched[self.came[touched, -1] >= 0]
        last = self.kind[full, -1]
        self.bar[full] = np.where(last == 2, np.inf, np.where(last == 1, self.score[full, -1], -np.inf))

    def found(self) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Query, row and score of all that is held."""
        q, place = np.nonzero(self.came >= 0)
        kind = self.kind[q, place]
        return q, self.came[q, place], pa.array(np.where(kind == 2, np.nan, self.score[q, place]), pa.float64(), mask=kind == 0)


def _tame(vectors: np.ndarray) -> np.ndarray:
    """Rows whose products stay in single precision's range."""
    return (np.abs(vectors) < 1e15).all(axis=1)


def _best(vectors: DataFrame, queries: DataFrame, k: int, keep: Sequence[str], block: int, group: Sequence[str] = (), least: float | None = None) -> DataFrame:
    """``query_id, vec_id, score`` and ``keep``: for each part of the vectors the ``k`` best of each query and group (columns of ``keep``)."""
    kinds = {f.name: f.dataType for f in vectors.schema.fields}
    kept = list(dict.fromkeys(["vec_id", *keep]))
    rows, asked = vectors.select(*kept, "embedding"), queries.select("query_id", "query")
    size = cells.grid(rows, asked, block)
    schema = ", ".join([f"query_id {asked.schema['query_id'].dataType.simpleString()}", *[f"`{c}` {kinds[c].simpleString()}" for c in kept], "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, own, best = [], [], None
        held, waiting, at, last = [], [], 0, None

        def flush(over: bool) -> None:
            nonlocal at, waiting
            if waiting and (over or sum(map(len, waiting)) >= STRIPE):
                best.add(pa.concat_arrays(waiting), at)
                at, waiting = at + sum(map(len, waiting)), []

        def out() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            q, came, score = best.found()
            table = pa.Table.from_batches(held).combine_chunks()
            for i in range(0, len(q), OUT):
                some = table.take(pa.array(came[i : i + OUT])).combine_chunks()
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(q[i : i + OUT])), *[c.chunk(0) for c in some.columns], score.slice(i, OUT)], names=["query_id", *kept, "score"])

        for batch in batches:
            theirs = batch.column("r").is_valid()
            n = pc.sum(pc.invert(theirs)).as_py() or 0
            if n:
                first = batch.slice(0, n).column("q")
                own.append(first)
            if n == batch.num_rows or not own:
                continue  # rows that no query of this cell meets
            if best is None:
                asked_ = pa.concat_arrays(own).flatten()
                ids, best = asked_[0], _Best(asked_[1].to_pylist(), k, least)
            part = batch.slice(n).column("r").flatten()
            values = dict(zip([*kept, "embedding"], part))
            lead = pa.RecordBatch.from_arrays([values[c] for c in kept], names=kept)
            starts = [0]
            if group:
                keys = list(zip(*[values[c].to_pylist() for c in group]))
                starts = [i for i, x in enumerate(keys) if x != (keys[i - 1] if i else last)]
                if not starts or starts[0]:
                    starts.insert(0, 0)
                fresh, last = keys[0] != last, keys[-1]
            for a, b in zip(starts, [*starts[1:], lead.num_rows]):
                if group and (a or fresh) and held:
                    flush(True)
                    yield from out()
                    best.reset()
                    held, at = [], 0
                held.append(lead.slice(a, b - a))
                waiting.append(values["embedding"].slice(a, b - a))
                flush(False)
        if best is not None:
            flush(True)
            yield from out()

    order = [F.col(f"r.{c}") for c in [*group, "vec_id"]]
    return cells.crossed(rows, "vec_id", asked, "query_id", size, order, run, schema)


def search(vectors: DataFrame, queries: DataFrame, k: int, keep: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """``query_id, vec_id, score, rank`` of the ``k`` best vectors for each query (ties: smaller id; NULL scores last).

    Vectors and queries meet as matrices in a grid of cells (see :mod:`quern.operators.cells`), each of which puts out k rows a query, so what moves is bounded by parts x queries x k and never by pairs.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = _best(vectors, queries, k, keep, block)
    return found.select("query_id", "vec_id", "score", *keep).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_each(vectors: DataFrame, queries: DataFrame, group: Sequence[str], most: int, least: float, block: int = BLOCK) -> DataFrame:
    """``query_id, vec_id, score, rn`` and ``group``: of each query and group of vectors the ``most`` best that score at least ``least``."""
    found = _best(vectors, queries, most, group, block, group, least)
    return capped(found.select("query_id", "vec_id", "score", *group), ["query_id", *group], most, "vec_id")


def merged(hits: DataFrame, keys: Sequence[str], total: int | None = None) -> DataFrame:
    """Best hit for each key over all queries (ties: earlier query, then rank), and the ``total`` best of those."""
    best = hits.groupBy(*keys).agg(F.max(F.struct("score", (-F.col("query_id")).alias("q"), (-F.col("rank")).alias("r"))).alias("b")).select(*keys, "b.score", (-F.col("b.q")).alias("query_id"))
    return best if total is None else best.orderBy(F.desc("score"), *keys).limit(total)


def passes(threshold: float, overlap: Column | None = None, concept_hits: Column | None = None) -> Column:
    """Score at the threshold, or the lexical signals that override it."""
    ok = F.col("score") >= threshold
    if overlap is not None:
        ok |= overlap >= 2
    if concept_hits is not None:
        ok |= concept_hits > 0
    return ok


def capped(chunks: DataFrame, group: Sequence[str], most: int, id_col: str) -> DataFrame:
    """At most ``most`` chunks of each group, best score first."""
    order = Window.partitionBy(*group).orderBy(F.desc("score"), id_col)
    return chunks.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= most)


def diversified(chunks: DataFrame, query: str, paper: str, id_col: str, per_paper: int, target: int) -> DataFrame:
    """Capped by paper, in score order, up to the first row at which both enough papers and enough chunks are in.

    Meant for the hits of a query, which a retrieval bounds; the running counts are windows by ``query``.
    """
    target = max(1, target)
    enough = max(target * per_paper * 3, target * 2)
    rows = capped(chunks, [query, paper], per_paper, id_col)
    order = Window.partitionBy(query).orderBy(F.desc("score"), id_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"taken": F.count("*").over(order), "papers": F.sum((F.col("rn") == 1).cast("int")).over(order)})
    done = ((F.col("papers") >= target) & (F.col("taken") >= enough)).cast("int")
    before = Window.partitionBy(query).orderBy(F.desc("score"), id_col).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_done", F.coalesce(F.max(done).over(before), F.lit(0))).where("_done = 0").drop("_done")


def by_paper(chunks: DataFrame, keys: Sequence[str], id_col: str, text_col: str | None = None) -> DataFrame:
    """One row a paper: best score, number of chunks, their ids by score, and a sample of the best one."""
    first = F.struct((-F.col("score")).alias("s"), F.col(id_col))
    out = [F.max("score").alias("max_score"), F.count("*").alias("n_chunks"), F.array_join(F.transform(F.array_sort(F.collect_list(first)), lambda x: x[id_col].cast("string")), ",").alias("chunk_ids")]
    if text_col:
        out.append(F.min_by(text_col, first).alias("sample"))
    return chunks.groupBy(*keys).agg(*out)


def relaxed_threshold(chunks: DataFrame, query: str, paper: str, start: float, step: float, least: float, target: int, signal: Column | None = None) -> DataFrame:
    """``query, effective_threshold, fallback_used``: where a loop that lowers the threshold would stop, without the loop.

    Each paper enters at its best score (or at once, by a signal); the ``target``-th best of those decides which value of the
    grid is the first to let enough papers in. If none does, the last grid value is reported and the caller falls back to all chunks.
    """
    grid = threshold_grid(start, step, least)
    value = F.col("score") if signal is None else F.when(signal, F.lit(float("inf"))).otherwise(F.col("score"))
    papers = chunks.groupBy(query, paper).agg(F.max(value).alias("v"))
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("v"), paper))
    kth = papers.withColumn("rn", rank).where(F.col("rn") <= target).groupBy(query).agg(F.count_if(F.col("rn") == target).alias("full"), F.max(F.when(F.col("rn") == target, F.col("v"))).alias("kth"))
    first = F.get(F.filter(F.array(*[F.lit(g) for g in grid]), lambda g: g <= F.col("kth")), F.lit(0))
    return kth.select(query, F.coalesce(first, F.lit(grid[-1])).alias("effective_threshold"), first.isNull().alias("fallback_used"))


def relaxed(chunks: DataFrame, query: str, paper: str, start: float, step: float, least: float, target: int) -> DataFrame:
    """Chunks over their query's effective threshold, or all of them where that still leaves too few papers; they are written once and read twice."""
    chunks = tables.written(chunks, "chunks")
    t = relaxed_threshold(chunks, query, paper, start, step, least, target)
    return chunks.join(t, query).where(F.col("fallback_used") | (F.col("score") >= F.col("effective_threshold")))
