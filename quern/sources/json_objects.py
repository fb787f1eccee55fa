"""Entries of JSON objects of any size, read by as many tasks as their files have splits."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.sources import tables


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    """``file, split, text``: what stands between quotes, in order within a split. Spark's text reader cuts a file at any separator, so it cuts it anywhere."""
    rows = spark.read.option("lineSep", '"').text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").alias("text"))


def _quote_counts(text: str) -> bool:
    """Whether the quote after ``text`` opens or ends a string: not if a backslash stands before it that is none of a pair."""
    return (len(text) - len(text.rstrip("\\"))) % 2 == 0


def _opened(text: str) -> int:
    return text.count("{") + text.count("[") - text.count("}") - text.count("]")


def _states(found: DataFrame) -> DataFrame:
    """``file, split, inside, depth, begun`` of each split: whether it starts within a string, under how many brackets, and right where an entry of the outermost object begins.

    A task works out for its split what both ways to start would lead to; a scan over the splits, one row each, tells which it was."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, {}
        for batch in batches:
            for file, split, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if now != (file, split):
                    now = (file, split)
                    sums[now] = [0, 0, 0, "", 0]
                s = sums[now]
                s[1 + s[0] % 2] += _opened(text)  # fragments at even places are outside of strings if the first one is
                s[3], s[4] = text.rstrip()[-1:], s[0] % 2
                s[0] += _quote_counts(text)
        rows = [(f, k, *s) for (f, k), s in sums.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()))], names=["file", "split", "quotes", "even", "odd", "last", "side"])

    sums = found.mapInArrow(run, "file string, split bigint, quotes bigint, even bigint, odd bigint, last string, side bigint")
    order = Window.partitionBy("file").orderBy("split")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = sums.withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    placed = placed.withColumn("opened", F.when(F.col("inside") == 0, F.col("even")).otherwise(F.col("odd")))
    placed = placed.withColumns({"depth": F.coalesce(F.sum("opened").over(before), F.lit(0)), "out": F.col("side") == F.col("inside")})
    ends = F.col("out") & F.col("last").isin("{", ",") & (F.col("depth") + F.col("opened") == 1)
    return placed.select("file", "split", (F.col("inside") == 1).alias("inside"), "depth", F.coalesce(F.lag(ends).over(order), F.lit(False)).alias("begun"))


def entries(spark: SparkSession, path: str, under: str | None = None) -> DataFrame:
    """``file, key, value`` of every entry of the JSON object in each file of ``path`` (or of the object that it has ``under`` a key): the key, and the value as JSON text.

    A file is read twice by splits of ``spark.sql.files.maxPartitionBytes``, whatever its size, and never held whole: a first pass counts quotes and brackets, a scan over splits
    carries on whether a split starts within a string and how deep, and a second pass cuts entries. Those that lie in one split are done there; only the two pieces at
    each border are put together by a shuffle. Repeated keys give a row each. An empty object gives no rows; a file must hold one valid object, in UTF-8.
    """
    found = _fragments(spark, path)
    states = tables.written(_states(found), "json-states")
    level = 1 if under is None else 2
    names = ["file", "split", "entry", "parent", "last", "text", "key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        inside = depth = entry = parent = of = 0
        begun, live, parts = False, False, []

        def put(last: bool) -> None:
            if live:
                out.append((*now, entry, of, last, '"'.join(parts), None))

        def end() -> None:
            put(True)
            out.append((*now, -2 - entry, parent, True, None, None))  # how many entries and parents began in the split

        for batch in batches:
            for file, split, text, start, deep, first in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if now != (file, split):
                    if now:
                        end()
                    now, inside, depth, begun, live, parts = (file, split), bool(start), deep, first, deep >= level, []
                    entry = parent = of = 0
                if inside:
                    if begun and level == 2:
                        out.append((*now, -1, parent, False, None, text))
                    begun = False
                    parts.append(text)
                else:
                    before, depth = depth, depth + _opened(text)
                    tail = text.rstrip()[-1:]
                    begun = tail in ("{", ",") and depth == 1
                    parent += begun
                    if live and before >= level > depth:  # the object that holds the entry ends here
                        at = next(i for i, c in enumerate(text) if c in "}]" and before + _opened(text[: i + 1]) < level)
                        parts.append(text[:at])
                        put(False)
                        live, parts = False, []
                    elif tail in ("{", ",") and depth == level:
                        parts.append(text.rstrip()[:-1])
                        put(False)
                        entry, of, live, parts = entry + 1, parent, True, [""]
                    else:
                        parts.append(text)
                inside ^= _quote_counts(text)
            if len(out) > 1000:
                yield batch_of(out)
                out = []
        if now:
            end()
        yield batch_of(out)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, kinds)], names=names)

    # one row a split, so few that they go to every task
    pieces = found.join(F.broadcast(states), ["file", "split"]).select("file", "split", "text", "inside", "depth", "begun")
    pieces = tables.written(pieces.mapInArrow(run, "file string, split bigint, entry bigint, parent bigint, last boolean, text string, key string"), "json-pieces")
    own = pieces.where("entry >= 0")
    totals = pieces.where("entry <= -2").select("file", "split", (-2 - F.col("entry")).alias("entries"), F.col("parent").alias("parents"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    totals = tables.written(totals.select("file", "split", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in ("entries", "parents")]), "json-totals")
    numbered = lambda df: df.join(F.broadcast(totals), ["file", "split"]).withColumns({"no": F.col("_entries") + F.col("entry"), "of": F.col("_parents") + F.col("parent")})
    border = F.col("last") | (F.col("entry") == 0)
    done = numbered(own.where(~border)).select("file", "no", "of", "text")
    parts = F.array_sort(F.collect_list(F.struct("split", "of", "text")))  # a piece for each split that an entry reaches over
    # a split's first piece ends in the quote before its first fragment, so pieces meet at quotes
    joined = numbered(own.where(border)).groupBy("file", "no").agg(parts.alias("p")).select("file", "no", F.element_at("p", 1)["of"].alias("of"), F.array_join(F.transform("p", lambda x: x["text"]), '"').alias("text"))
    all_ = done.unionByName(joined)
    if under is not None:
        keys = numbered(pieces.where("key is not null")).select(F.col("file").alias("_file"), F.col("of").alias("_of"), "key")
        wanted = keys.where(F.get_json_object(F.concat(F.lit('["'), F.col("key"), F.lit('"]')), "$[0]") == under)
        all_ = all_.join(F.broadcast(wanted), (F.col("file") == F.col("_file")) & (F.col("of") == F.col("_of"))).select("file", "no", "of", "text")
    key = F.regexp_extract("text", r'^\s*"((?:[^"\\]|\\.)*)"\s*:', 1)
    rest = F.regexp_replace("text", r'^\s*"(?:[^"\\]|\\.)*"\s*:\s*', "")
    return all_.where(F.trim("text") != "").select("file", F.get_json_object(F.concat(F.lit('["'), key, F.lit('"]')), "$[0]").alias("key"), F.trim(rest).alias("value"))
