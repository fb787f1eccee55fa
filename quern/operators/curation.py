"""Merging and curating sources: schemas, keyed deduplication, upserts, lookups with fallbacks, groups of duplicates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.sources import tables

#: The molecule table's 18 columns, in order.
MOLECULES = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("mol_id", "name", "smiles_raw", "smiles_canonical", "inchi", "inchi_key", "source_db", "source_id", "source_refs", "pubchem_cid", "cas_number", "taste_class_raw", "taste_class")]
    + [T.StructField("is_sweet", T.ByteType()), T.StructField("label_confidence", T.StringType()), T.StructField("is_natural", T.ByteType()), T.StructField("mw", T.DoubleType()), T.StructField("n_heavy_atoms", T.IntegerType())]
)


def conformed(df: DataFrame, schema: T.StructType, strict: bool = True) -> DataFrame:
    """Exactly the schema's columns, in order and cast; missing ones are NULL. ``strict``: columns outside of the schema raise."""
    extra = set(df.columns) - set(schema.names)
    if strict and extra:
        raise ValueError(f"columns outside of the schema: {sorted(extra)}")
    have = set(df.columns)
    return df.select(*[(F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


def first_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order; NULL keys group too. The rank limit runs before the shuffle as well, so a task sends one row a key."""
    rest = [c for c in df.columns if c not in keys]
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rn = 1").select(*keys, *rest)


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str], how: str = "replace") -> DataFrame:
    """``new`` into ``old`` by key: 'replace' lets new rows win, 'ignore' old ones. A table without a merge command is rewritten."""
    if how == "ignore":
        return old.unionByName(new.join(old.select(*keys).distinct(), list(keys), "left_anti"))
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def merged_sources(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """All of ``first`` and the rows of ``second`` whose key it lacks."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def looked_up(rows: DataFrame, keys: Sequence[str], sources: Sequence[DataFrame], value: str) -> DataFrame:
    """``value`` of the first table that has the row's key: keys[i] of the rows against column 'key' of sources[i], which must be unique."""
    out = rows
    for i, (k, table) in enumerate(zip(keys, sources)):
        out = out.join(table.select(F.col("key").alias(f"_k{i}"), F.col(value).alias(f"_v{i}")), F.col(k) == F.col(f"_k{i}"), "left")
    found = F.coalesce(*[F.col(f"_v{i}") for i in range(len(sources))])
    tier = F.coalesce(*[F.when(F.col(f"_k{i}").isNotNull(), F.lit(i)) for i in range(len(sources))])
    return out.select(*rows.columns, found.alias(value), tier.alias("tier"))


def enriched(rows: DataFrame, remote: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Non-empty remote columns override local ones of the same lower-cased key."""
    side = remote.select(F.lower(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = rows.join(side, F.lower(F.col(key)) == F.col("_key"), "left")
    return joined.select(*[F.coalesce(F.nullif(f"_{c}", F.lit("")), F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns])


def orphans(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """How many keys both sides have, and how many only one has."""
    a, b = left.select(F.col(key).alias("a")).distinct(), right.select(F.col(key).alias("b")).distinct()
    both = a.join(b, F.col("a") == F.col("b"), "full_outer")
    return both.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("mapped"), F.count_if(F.col("b").isNull()).alias("left_only"), F.count_if(F.col("a").isNull()).alias("right_only"))


def linked_by_keys(rows: DataFrame, id_col: str, keys: Mapping[str, Column]) -> DataFrame:
    """Edges from each row to the smallest id that shares one of the keys; NULL keys link nothing. One map-side combined minimum a key."""
    parts = []
    for name, key in keys.items():
        keyed = rows.select(F.col(id_col).alias("u"), key.alias("key")).where("key is not null")
        least = keyed.groupBy("key").agg(F.min("u").alias("v"), F.count("*").alias("n")).where("n > 1").select("key", "v")
        parts.append(keyed.join(least, "key").where("u <> v").select("u", "v", F.lit(name).alias("reason")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def groups_of(edges: DataFrame) -> DataFrame:
    """``id, group`` (smallest id reachable over ``edges(u, v)``) of every id on an edge.

    Each round links the greater neighbours of an id with its smallest one, then the smaller ones, so that edges become stars in a logarithmic number of
    rounds; no id's neighbours meet in one list, and a count and a sum of hashes tell when nothing changes any more.
    """
    ends = edges.where("u is not null and v is not null")
    now = tables.written(ends.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "loop")
    before = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state["n"] == 0 or state == before:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("w")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        small = large.join(least, F.col("u") == F.col("w")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = tables.written(small.unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct(), "loop")
        tables.drop(now)
        now, before = new, state
    ids = ends.select(F.col("u").alias("id")).unionByName(ends.select(F.col("v").alias("id"))).distinct()
    return ids.join(now.select(F.col("u").alias("id"), F.col("v").alias("group")), "id", "left").select("id", F.coalesce("group", "id").alias("group"))


#: Endings that mark a copy of a file, a year in a name's middle, and how generic downloads begin.
COPY_MARK = r"(?i)(?:\s*\(\d+\)|[ _-]copy|\s*副本)$"
DATED = r"\s-\s(?:19|20)\d{2}\s-\s"
DOWNLOADED = "1-s2.0-"


def keeper_rank(path: Column, title: Column, pages: Column, size: Column) -> Column:
    """What makes a file the one to keep of its copies, as a struct to take the greatest of: no copy mark, pages, no generic name, likeness of name and title
    (difflib ratio of their letters and digits), author and year in the name, size."""

    @F.pandas_udf("double")
    def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([SequenceMatcher(None, x, y).ratio() if y else 0.0 for x, y in zip(a, b)], dtype="float64")

    stem = F.regexp_replace(F.regexp_extract(path, r"[^/]*$", 0), r"(?<=.)\.[^.]*$", "")
    key = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "")
    return F.struct(
        (~F.regexp_like(stem, F.lit(COPY_MARK))).cast("int").alias("unmarked"), pages.alias("pages"), (~F.lower(stem).startswith(DOWNLOADED)).cast("int").alias("named"),
        likeness(key(F.regexp_replace(stem, COPY_MARK, "")), key(title)).alias("likeness"), F.regexp_like(stem, F.lit(DATED)).cast("int").alias("dated"), size.alias("size"),
    )


def kept_copies(rows: DataFrame, by: str, path: str, title: str, pages: str, size: str) -> DataFrame:
    """``<by>, kept``: of the files of each group the path with the greatest :func:`keeper_rank`; of equals the smallest path."""
    ranked = rows.select(by, F.col(path).alias("_path"), keeper_rank(F.col(path), F.col(title), F.col(pages), F.col(size)).alias("_rank"))
    best = ranked.groupBy(by).agg(F.max("_rank").alias("_best"))
    return ranked.join(best, by).where(F.col("_rank") == F.col("_best")).groupBy(by).agg(F.min("_path").alias("kept"))
