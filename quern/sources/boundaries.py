"""Where outside software plugs in: encoders of text, chemistry toolkits, remote catalogs. The engine defines what goes in and comes out."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def hashing_encoder(dimension: int = 64) -> Callable[[Sequence[str]], list[list[float]]]:
    """A stand-in for a sentence encoder: signed hashed words, unit length. Deterministic, without a model."""

    def encode(texts: Sequence[str]) -> list[list[float]]:
        import zlib

        import numpy as np

        out = np.zeros((len(texts), dimension))
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % dimension] += 1 if h >> 31 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(n > 0, n, 1)).tolist()

    return encode


def embedded(rows: DataFrame, text_col: str, load: Callable[[], Callable[[Sequence[str]], list[list[float]]]], out_col: str = "embedding") -> DataFrame:
    """Adds a vector for each text; ``load`` runs once a task and returns the encoder, which gets Arrow batches of texts. NULL texts count as empty."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for s in batches:
            yield pd.Series(encode(s.fillna("").tolist()))

    return rows.withColumn(out_col, run(F.col(text_col)))


STANDARD = "struct<valid:boolean,reason:string,canonical:string,key:string,mass:double,atoms:int>"


def standardised(rows: DataFrame, col: str, load: Callable[[], Callable[[str], dict]], out_col: str = "standard") -> DataFrame:
    """Adds what a chemistry toolkit says of each molecule; what it raises becomes the reason of an invalid row. NULL input: invalid."""
    names = [f.name for f in T.StructType.fromDDL("s " + STANDARD)["s"].dataType]

    @F.pandas_udf(STANDARD)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        fn = load()
        for s in batches:
            out = []
            for x in s:
                try:
                    out.append({"valid": True, "reason": None, **fn(x)} if x else {"valid": False, "reason": "empty"})
                except Exception as e:  # noqa: BLE001  a toolkit may raise anything for a bad molecule
                    out.append({"valid": False, "reason": type(e).__name__})
            found = pd.DataFrame(out, columns=names, dtype=object)
            yield found.where(found.notna(), None)

    return rows.withColumn(out_col, run(F.col(col)))


def cached_lookup(rows: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows with what a pre-fetched table of a remote catalog knows of their key, and the keys still to be fetched."""
    side = cache.withColumnRenamed(key, "_key")
    found = rows.join(side, F.lower(F.col(key)) == F.lower("_key"), "left")
    missing = found.where("_key is null").select(key).where(f"{key} is not null").distinct()
    return found.drop("_key"), missing
