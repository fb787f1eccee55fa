"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text, normalised by length, with exception phrases."""

from __future__ import annotations

import heapq
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import scratch
from quern.llm.sampling import smallest_hashes

#: The lexicon and its calibration are fitted on at most this many labelled rows, those with the smallest hash of the id.
FIT_ROWS = 20_000
PREFIXES = range(4, 9)
#: Lengths of patterns inside runs of scripts that write no spaces between words.
INNER = range(2, 5)
_UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]+")
#: How much likelier than any row a row with a pattern must be toxic, for the pattern to be worth an entry.
LEAST_LIFT = 2.0
#: Entries that each toxic row of the fit should match, where that many are worth it.
COVER = 4
#: Share of the toxic rows that an entry must add to.
LEAST_SHARE = 0.015
EXPONENTS = (0.0, 0.25, 0.5, 0.75, 1.0)

# Letters that look like Latin ones, then digits and signs that stand for letters.
HOMOGLYPHS = dict(zip("абвгеёіїјкмнопрстухуѕԁһԛԝαβγεηικμνορτυχωℓıø", "abbreeiijkmhonpctyxysdhqwabyenikmvoptuxwlio"))
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}


class _Fold(dict):
    """For str.translate: lower case, look-alikes, digits that stand for letters; accents and marks go, what is no letter parts words."""

    def __missing__(self, code: int) -> str:
        ch = chr(code).lower()
        base = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
        base = "".join(HOMOGLYPHS.get(c, SUBSTITUTES.get(c, c)) for c in base)
        if not base and unicodedata.combining(chr(code)) or unicodedata.category(chr(code)) == "Cf":
            out = ""
        else:
            out = "".join(c if c.isalnum() else " " for c in base) or " "
        if len(self) < 20_000:
            self[code] = out
        return out


_FOLD = _Fold()


def folded(text: str | None) -> str:
    """Space-parted folded words with a space at either end."""
    return " " + " ".join((text or "").translate(_FOLD).split()) + " "


@dataclass
class Lexicon:
    """Weights of patterns (a leading space: start of a word; a trailing one: its end), exception phrases, and the calibration
    score = logistic(slope * log(1 + 100 * weight / words ** exponent) + bias)."""

    weights: dict[str, float]
    exceptions: set[str] = field(default_factory=set)
    exponent: float = 0.5
    slope: float = 1.0
    bias: float = -2.0


class Matcher:
    def __init__(self, lexicon: Lexicon):
        self.automaton = ahocorasick.Automaton()
        for p, w in lexicon.weights.items():
            self.automaton.add_word(p, (len(p), w, p))
        for p in lexicon.exceptions:
            self.automaton.add_word(f" {p} ", (len(p) + 2, None, p))
        if len(self.automaton):
            self.automaton.make_automaton()

    def hits(self, text: str) -> dict[int, tuple[float, str]]:
        """By a word's start, the heaviest pattern that matches there outside of exception phrases."""
        found: dict[int, tuple[float, str]] = {}
        excepted: list[tuple[int, int]] = []  # they end in order
        if len(self.automaton):
            for end, (n, w, p) in self.automaton.iter(text):
                start = end - n + 1
                if w is None:
                    excepted.append((start, end))
                elif start not in found or w > found[start][0]:
                    found[start] = (w, p)
        if not excepted:
            return found
        # one sweep over both in order of their starts
        out, spans, upto = {}, iter(sorted(excepted)), -1
        following = next(spans, None)
        for at in sorted(found):
            while following is not None and following[0] <= at:
                upto = max(upto, following[1])
                following = next(spans, None)
            if at >= upto:
                out[at] = found[at]
        return out


def feature(weight: float, words: int, exponent: float) -> float:
    return math.log1p(100.0 * weight / max(1, words) ** exponent)


def _rates(lexicon: Lexicon, text: str | None, matcher: Matcher) -> tuple[float, int, dict[int, tuple[float, str]], str]:
    t = folded(text)
    hits = matcher.hits(t)
    return sum(w for w, _ in hits.values()), _length(t), hits, t


def _length(t: str) -> int:
    """Words of a folded text; of runs without spaces between words, every two characters are one."""
    return t.count(" ") - 1 + (sum(len(r) // 2 for r in _UNSPACED.findall(t)) if not t.isascii() else 0)


def _patterns(text: str | None) -> dict[str, int]:
    """How often each word, word beginning and, of scripts without spaces, each run of two to four characters occurs."""
    out: dict[str, int] = {}
    for w, n in Counter(folded(text).split()).items():
        found = [f" {w} ", *(f" {w[:k]}" for k in PREFIXES if k <= len(w))]
        if not w.isascii():
            found += [r[i : i + k] for r in _UNSPACED.findall(w) for k in INNER for i in range(len(r) - k + 1)]
        for p in found:
            out[p] = out.get(p, 0) + n
    return out


def training_rows(docs: DataFrame, labels: DataFrame, train: Column, fit_rows: int) -> DataFrame:
    """``text, toxic`` of ``fit_rows`` labelled ids where ``train`` holds, by hash of the id. An id labelled twice counts as toxic if one label is 1;
    of the rows of ``docs`` that repeat an id the one with the least text counts."""
    chosen = labels.where("doc_id is not null and toxic in (0, 1)").where(train).select("doc_id", (-F.col("toxic").cast("int")).alias("clean"))
    chosen = smallest_hashes(chosen, "doc_id", fit_rows)
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen.select("doc_id", (-F.col("clean")).alias("toxic"))), "doc_id")
    out = scratch.written(rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic"), "toxic-fit")
    scratch.drop(chosen)
    return out


def fit(docs: DataFrame, labels: DataFrame, train: Column, fit_rows: int = FIT_ROWS, exceptions: Sequence[str] = ()) -> Lexicon:
    """Learn a lexicon from ``labels(doc_id, toxic)`` of the rows where ``train`` holds.

    Patterns are words and word beginnings; those found in toxic rows and hardly in others enter greedily, each for the
    toxic rows that it adds. Weights are smoothed log odds. Word pairs round a hit that occur in clean rows only
    become exception phrases. Without a toxic row the lexicon is empty and every score is the share of toxic rows.
    Null ids, labels and texts are left out; ``toxic`` may be any number type. Executors count. What comes to the driver is bounded by the fit: the
    patterns that could add to LEAST_SHARE of the toxic rows (as many as a toxic row has on average, over that share, at most), for each of at most ``fit_rows`` fitted texts three numbers
    and those patterns of a toxic one, and the exception phrases met three times. As an entry adds to that share of rows, each counted COVER times at most, cover ends the lexicon at COVER / LEAST_SHARE
    entries; no other limit drops any.
    """
    sample = training_rows(docs, labels, train, fit_rows)
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = n.get(1, 0), n.get(0, 0)
    if not n_pos:
        scratch.drop(sample)
        return Lexicon({}, set(), 0.5, 0.0, math.log(0.5 / (n_neg + 1.0)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}

        def flush() -> pa.RecordBatch:
            cols = list(zip(*seen.values())) or [(), (), (), ()]
            out = pa.RecordBatch.from_pydict({"pattern": pa.array(list(seen), pa.string())} | {k: pa.array(c, pa.int64()) for k, c in zip(("neg", "pos", "neg_n", "pos_n"), cols)})
            seen.clear()
            return out

        for b in batches:
            for text, y in zip(b["text"], b["toxic"]):
                y = y.as_py()
                for p, n in _patterns(text.as_py()).items():
                    c = seen.setdefault(p, [0, 0, 0, 0])
                    c[y] += 1
                    c[2 + y] += n
                if len(seen) > 80_000:
                    yield flush()
        yield flush()

    cost = min(1.0, LEAST_LIFT * n_pos / max(1, n_neg))
    counted = sample.transform(scratch.bounded).mapInArrow(count, "pattern string, neg bigint, pos bigint, neg_n bigint, pos_n bigint").groupBy("pattern").agg(*[F.sum(c).alias(c) for c in ("neg", "pos", "neg_n", "pos_n")])
    counted = counted.where(F.col("pos") >= 2).withColumn("worth", F.col("pos") - F.lit(cost) * F.col("neg")).where(F.col("worth") >= _least(n_pos))
    candidates = {r["pattern"]: r for r in counted.orderBy(F.desc("worth"), "pattern").collect()}
    names = list(candidates)
    number = {p: i for i, p in enumerate(names)}

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted(number[p] for p in _patterns(t.as_py()) if p in number) for t in b["text"]]
            yield pa.RecordBatch.from_pydict({"found": pa.array(found, pa.list_(pa.int32()))})

    rows = [r["found"] for r in sample.where("toxic = 1").select("text").transform(scratch.bounded).mapInArrow(matched, "found array<int>").collect()]
    words = sample.groupBy("toxic").agg(F.sum(F.length("text")).alias("n")).collect()
    per = {r["toxic"]: max(1, r["n"]) for r in words}
    odds = lambda r: math.log((r["pos_n"] + 0.5) / per[1]) - math.log((r["neg_n"] + 0.5) / per.get(0, 1))
    chosen = _cover(names, [candidates[p]["neg"] * cost for p in names], rows, n_pos)
    weights = {p: w for p in chosen if (w := odds(candidates[p])) > 0}
    draft = Lexicon(weights, set(exceptions))

    def context(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(draft)
        for b in batches:
            out = []
            for t in b["text"]:
                w, words, hits, text = _rates(draft, t.as_py(), m)
                near = set()
                for at in hits:
                    start = text.rfind(" ", 0, at + 1)  # the word in which the hit begins, and those round it
                    stop = text.index(" ", start + 1)
                    before = text[text.rfind(" ", 0, start) + 1 : start] if start > 0 else ""
                    after = text[stop + 1 : text.find(" ", stop + 1)] if stop + 1 < len(text) else ""
                    word = text[start + 1 : stop]
                    near |= {x for x in ((f"{before} {word}" if before else ""), (f"{word} {after}" if after else "")) if x}
                out.append((w, words, sorted(near)))
            yield pa.RecordBatch.from_pydict({"w": pa.array([x[0] for x in out], pa.float64()), "words": pa.array([x[1] for x in out], pa.int64()), "near": pa.array([x[2] for x in out], pa.list_(pa.string())), "toxic": b["toxic"].cast(pa.int32())})

    near = sample.transform(scratch.bounded).mapInArrow(context, "w double, words bigint, near array<string>, toxic int").withColumn("p", F.explode("near"))
    learned = near.groupBy("p").agg(F.sum("toxic").alias("pos"), F.count("*").alias("n")).where("pos = 0 and n >= 3").collect()
    draft.exceptions |= {r["p"] for r in learned}
    scored = sample.transform(scratch.bounded).mapInArrow(context, "w double, words bigint, near array<string>, toxic int").groupBy("w", "words", "toxic").count().collect()
    scratch.drop(sample)
    return _calibrated(draft, [(r["w"], r["words"], r["toxic"], r["count"]) for r in scored])


def _least(n_pos: int) -> float:
    """Toxic rows that an entry must add."""
    return max(2.0, LEAST_SHARE * n_pos)


def _cover(names: Sequence[str], costs: Sequence[float], rows: Sequence[Sequence[int]], n_pos: int) -> list[str]:
    """Greedy cover of every toxic row up to COVER times: the pattern that adds most toxic rows less its cost in clean ones; of equals
    the longest beginning of a word. A beginning or continuation of a chosen pattern is not chosen."""
    where: dict[int, set[int]] = {}
    for i, found in enumerate(rows):
        for k in found:
            where.setdefault(k, set()).add(i)
    rank = lambda k: (len(names[k].strip()), not names[k].endswith(" "), names[k])
    worth = {k: len(v) - costs[k] for k, v in where.items()}
    least, out, covered = _least(n_pos), [], [0] * len(rows)
    queue = [(-g, [-x for x in rank(k)[:2]], names[k], k) for k, g in worth.items()]
    heapq.heapify(queue)
    while queue:
        g, r, name, k = heapq.heappop(queue)
        gain = sum(covered[i] < COVER for i in where[k]) - costs[k]
        if gain < least or any(name.startswith(x.rstrip()) or x.startswith(name.rstrip()) for x in out):
            continue
        if gain < -g:
            heapq.heappush(queue, (-gain, r, name, k))
            continue
        out.append(name)
        for i in where[k]:
            covered[i] += 1
    return out


def _calibrated(lexicon: Lexicon, rows: Sequence[tuple[float, int, int, int]]) -> Lexicon:
    """Logistic fit by Newton steps, with a little shrinkage; the length exponent with the best likelihood stays."""
    total = sum(n for *_, n in rows)
    best = None
    for e in EXPONENTS:
        xs = [(feature(w, words, e), y, n / total) for w, words, y, n in rows]
        a, b = 0.0, 0.0
        for _ in range(60):
            ga, gb, haa, hab, hbb = -1e-3 * a, 0.0, 1e-3, 0.0, 1e-6
            for x, y, n in xs:
                p = 1 / (1 + math.exp(-max(-40, min(40, a * x + b))))
                d, v = n * (y - p), n * p * (1 - p)
                ga, gb, haa, hab, hbb = ga + d * x, gb + d, haa + v * x * x, hab + v * x, hbb + v
            det = haa * hbb - hab * hab
            if det <= 1e-18:
                break
            da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
            scale = min(1.0, 5.0 / max(1e-9, abs(da), abs(db)))
            a, b = a + scale * da, b + scale * db
            if abs(da) + abs(db) < 1e-6:
                break
        loss = sum(n * math.log1p(math.exp(-max(-40, min(40, (a * x + b) * (1 if y else -1))))) for x, y, n in xs)
        if best is None or loss < best[0] - 1e-9:
            best = (loss, e, a, b)
    _, lexicon.exponent, lexicon.slope, lexicon.bias = best
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with ``out_col`` (0 to 1) added, by its whole text; one narrow pass, no shuffle.

    Null and empty texts score as texts without a hit; a text of any length is matched once from end to end. Repeated rows score alike; an empty table
    gives no rows. A column named ``out_col`` is replaced; others stay as they are.
    """
    schema = docs.drop(out_col).schema.add(out_col, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(lexicon)
        for b in batches:
            out = []
            for t in b.column(text_col):
                w, words, _, _ = _rates(lexicon, t.as_py(), m)
                z = lexicon.slope * feature(w, words, lexicon.exponent) + lexicon.bias
                out.append(1 / (1 + math.exp(-max(-40.0, min(40.0, z)))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], names=[*b.schema.names, out_col])

    return docs.drop(out_col).transform(scratch.bounded).mapInArrow(run, schema)
