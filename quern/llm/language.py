"""Language identification by hyperdimensional profiles of letter trigrams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import scratch
from quern.llm.sampling import smallest_hashes

DIM = 1024
#: Prototypes are bundled from at most this many labelled rows, those with the smallest hash of the id.
FIT_ROWS = 20_000
#: Their sums come to the driver.
MAX_LANGUAGES = 2_000
#: Trigram vectors that a worker keeps; the table starts anew when it is full.
MAX_TRIGRAMS = 12_000
_SPACE = 0


def _letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text; each run of other characters than letters is one 0, also at both ends."""
    code = np.frombuffer(("\x00" + text.lower() + "\x00").encode("utf-32-le", "surrogatepass"), np.uint32)
    keep = np.zeros(len(code), bool)
    low = code < 0x250
    keep[low] = _LATIN[code[low]]
    high = np.flatnonzero(~low)
    if len(high):
        values, back = np.unique(code[high], return_inverse=True)
        keep[high] = np.array([chr(c).isalpha() for c in values.tolist()])[back]
    out = np.where(keep, code, _SPACE)
    first = np.ones(len(out), bool)
    first[1:] = (out[1:] != _SPACE) | (out[:-1] != _SPACE)
    return out[first]


_LATIN = np.array([chr(c).isalpha() for c in range(0x250)])


class Encoder:
    """Random signs for each letter, drawn from the code point; a trigram binds its letters' vectors, rotated by their place."""

    def __init__(self, dim: int = DIM, seed: int = 11):
        self.dim, self.seed = dim, seed
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.table = np.empty((MAX_TRIGRAMS, dim), np.int8)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            if len(self.letters) > 5000:
                self.letters.clear()
            rng = np.random.default_rng([self.seed, code])
            self.letters[code] = (rng.integers(0, 2, self.dim, dtype=np.int8) * 2 - 1).astype(np.int8)
        return self.letters[code]

    def _add(self, key: int) -> int:
        a, b, c = key >> 42, key >> 21 & 0x1FFFFF, key & 0x1FFFFF
        at = self.rows[key] = len(self.rows)
        self.table[at] = np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)
        return at

    def encode(self, text: str | None) -> np.ndarray | None:
        """The bundled trigram vectors of a whole text; None if it has no letter."""
        if not text:
            return None
        s = _letters(text).astype(np.int64)
        if not s.any():
            return None
        keys, counts = np.unique((s[:-2] << 42) | (s[1:-1] << 21) | s[2:], return_counts=True)
        out = np.zeros(self.dim, np.float32)
        step = MAX_TRIGRAMS // 4
        for i in range(0, len(keys), step):  # a text of many scripts comes in parts
            part = keys[i : i + step].tolist()
            if len(self.rows) + len(part) > MAX_TRIGRAMS:
                self.rows.clear()
            known = self.rows.get
            rows = [at if (at := known(k)) is not None else self._add(k) for k in part]
            out += np.sqrt(counts[i : i + step]).astype(np.float32) @ self.table[rows].astype(np.float32)
        return out


@dataclass
class Profiles:
    """A prototype for each language, and the mean of all languages, which is taken from prototypes and documents alike."""

    prototypes: dict[str, np.ndarray] = field(default_factory=dict)
    mean: np.ndarray | None = None


def training_rows(docs: DataFrame, train: Column, fit_rows: int) -> DataFrame:
    """``text, lang`` of ``fit_rows`` ids with a language and a text where ``train`` holds, by hash of the id; of an id's rows the one of least text and language."""
    usable = docs.where("doc_id is not null and lang is not null and text is not null").where(train)
    ids = smallest_hashes(usable.select("doc_id"), "doc_id", fit_rows)
    rows = usable.select("doc_id", "text", "lang").join(F.broadcast(ids), "doc_id")
    out = scratch.written(rows.groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("r")).select("r.text", "r.lang"), "lang-fit")
    scratch.drop(ids)
    return out


def fit(docs: DataFrame, train: Column, fit_rows: int = FIT_ROWS, dim: int = DIM) -> Profiles:
    """Profiles of the languages of ``docs(doc_id, text, lang)``: bundles of the unit vectors of at most ``fit_rows`` rows where ``train`` holds.

    Executors bundle; a vector of ``dim`` sums for each language comes to the driver (ValueError over MAX_LANGUAGES). A language may be
    any string, the empty one too. Repeated ids count once; null ids, languages and texts not at all. No fitting row: no prototype.
    """

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sums = Encoder(dim), {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"lang": list(sums), "sums": pa.array([s.tolist() for s in sums.values()], pa.list_(pa.float64()))})
            sums.clear()
            return out

        for b in batches:
            for text, lang in zip(b["text"], b["lang"]):
                v = encoder.encode(text.as_py())
                if v is not None:
                    s = sums.setdefault(lang.as_py(), np.zeros(dim + 1))
                    s[:dim] += v / max(1e-9, np.linalg.norm(v))
                    s[dim] += 1
            if len(sums) > 200:
                yield flush()
        if sums:
            yield flush()

    sample = training_rows(docs, train, fit_rows)
    parts = sample.transform(scratch.bounded).mapInArrow(bundle, "lang string, sums array<double>")
    summed = parts.select("lang", F.posexplode("sums").alias("i", "v")).groupBy("lang", "i").agg(F.sum("v").alias("v"))
    found = summed.limit((MAX_LANGUAGES + 1) * (dim + 1)).toArrow()
    scratch.drop(sample)
    if found.num_rows > MAX_LANGUAGES * (dim + 1):
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    langs = found.column("lang").combine_chunks().dictionary_encode()
    table = np.zeros((len(langs.dictionary), dim + 1))
    table[langs.indices.to_numpy(), found.column("i").to_numpy()] = found.column("v").to_numpy()
    unit = {k: table[i, :dim] / table[i, dim] for k, i in sorted((k, i) for i, k in enumerate(langs.dictionary.to_pylist())) if table[i, dim]}
    mean = sum(unit.values()) / len(unit) if len(unit) > 1 else None
    return Profiles({k: v if mean is None else v - mean for k, v in unit.items()}, mean)


def predict(docs: DataFrame, profiles: Profiles, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1: softmax over the cosines) by the whole text; one narrow pass, no shuffle.

    Null text, or one without a letter: ``und`` and 0. Ties go to the first language in code-point order. Without prototypes all is ``und``.
    Repeated rows get the same answer; an empty table gives no rows. Columns that have these names are replaced; others stay as they are.
    """
    names, mean = list(profiles.prototypes), profiles.mean
    dim = len(next(iter(profiles.prototypes.values()))) if names else DIM
    matrix = np.array([v / max(1e-9, np.linalg.norm(v)) for v in profiles.prototypes.values()], np.float32)
    kept = docs.drop("lang_pred", "score")
    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(dim)
        for b in batches:
            langs, scores = [], []
            for t in b.column(text_col):
                v = encoder.encode(t.as_py()) if names else None
                if v is None:
                    langs.append("und"), scores.append(0.0)
                    continue
                v = v / max(1e-9, np.linalg.norm(v))
                if mean is not None:
                    v = v - mean
                cos = matrix @ v / max(1e-9, np.linalg.norm(v))
                e = np.exp(8.0 * (cos - cos.max()))
                k = int(cos.argmax())
                langs.append(names[k]), scores.append(float(e[k] / e.sum()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    return kept.transform(scratch.bounded).mapInArrow(run, schema)
