"""Matrices of fixed-width rows in files: ``.npy`` arrays and flat vector indexes, read by offset by many tasks, and folders of ``.npy`` parts written by many."""

from __future__ import annotations

import ast
import io
import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from quern.operators.ranges import ranked

#: Bytes that a task reads at least, rows of an Arrow batch, and rows of a written part.
SPLIT_BYTES, BATCH_ROWS, PART_ROWS = 64 << 20, 4096, 65_536
MANIFEST = "_parts.json"
# How a flat index of inner products or of distances begins.
FLAT = {b"IxFI", b"IxF2"}


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Shape:
    """Where a file's numbers begin, their type, and how many rows and columns there are."""

    start: int
    dtype: str
    rows: int
    width: int


def shape_of(path: str) -> Shape:
    """The shape that a file's header states. ValueError where the file is neither kind, or longer or shorter than its header says."""
    system, at = _at(path)
    with system.open_input_file(at) as f:
        head, size = f.read(8), f.size()
        if head[:6] == b"\x93NUMPY":
            wide = head[6] > 1
            length = struct.unpack("<I" if wide else "<H", f.read(4 if wide else 2))[0]
            said = ast.literal_eval(f.read(length).decode("utf-8" if head[6] > 2 else "latin-1"))
            if said["fortran_order"] or not 1 <= len(said["shape"]) <= 2 or np.dtype(said["descr"]).hasobject:
                raise ValueError(f"{path}: not rows of numbers")
            out = Shape(f.tell(), said["descr"], said["shape"][0], said["shape"][1] if len(said["shape"]) == 2 else 1)
        elif head[:4] in FLAT:
            rest = head[4:] + f.read(37)
            width, rows, _, _, _, _, count = struct.unpack("<iqqq?iQ", rest)
            if count != rows * width:
                raise ValueError(f"{path}: {count} numbers for {rows} rows of {width}")
            out = Shape(45, "<f4", rows, width)
        else:
            raise ValueError(f"{path}: no matrix")
    stated = out.start + out.rows * out.width * np.dtype(out.dtype).itemsize
    if size != stated:
        raise ValueError(f"{path}: {size} bytes where its header states {stated}")
    return out


@dataclass
class Span(InputPartition):
    path: str
    shape: Shape
    low: int
    high: int
    first: int  # number of the file's first row in the whole matrix


class MatrixReader(DataSourceReader):
    def __init__(self, path: str, split: int) -> None:
        self.path, self.split = path, split

    def partitions(self) -> list[Span]:
        system, at = _at(self.path)
        if system.get_file_info(at).type == fs.FileType.Directory:
            with system.open_input_file(f"{at}/{MANIFEST}") as f:
                parts = [(f"{self.path}/{p['file']}", p["first"], p["rows"]) for p in json.loads(f.read())]
        else:
            parts = [(self.path, 0, None)]
        out = []
        for path, first, rows in sorted(parts, key=lambda p: p[1]):
            shape = shape_of(path)
            if rows is not None and rows != shape.rows:
                raise ValueError(f"{path}: {shape.rows} rows where {rows} were written")
            step = max(1, self.split // max(1, shape.width * np.dtype(shape.dtype).itemsize))
            out += [Span(path, shape, k, min(k + step, shape.rows), first) for k in range(0, shape.rows, step)]
        return out

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        if not isinstance(span, Span):  # Spark reads a source without splits by one empty split
            return
        system, at = _at(span.path)
        s, kind = span.shape, np.dtype(span.shape.dtype)
        with system.open_input_file(at) as f:
            for k in range(span.low, span.high, BATCH_ROWS):
                n = min(BATCH_ROWS, span.high - k)
                raw = f.read_at(n * s.width * kind.itemsize, s.start + k * s.width * kind.itemsize)
                flat = np.frombuffer(raw, kind).astype(np.float64)
                ends = pa.array(np.arange(n + 1) * s.width, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, k + n) + span.first, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(flat))], names=["row", "values"])


@dataclass
class Written(WriterCommitMessage):
    parts: list[dict]


class MatrixWriter(DataSourceWriter):
    def __init__(self, path: str, dtype: str) -> None:
        self.path, self.dtype = path, dtype

    def write(self, iterator) -> Written:
        system, at = _at(self.path)
        system.create_dir(at, recursive=True)
        parts, held, first = [], [], 0

        def flush() -> None:
            if held:
                data, name = io.BytesIO(), f"rows-{first:020d}.npy"
                np.save(data, np.array(held, self.dtype))
                with system.open_output_stream(f"{at}/{name}") as f:
                    f.write(data.getvalue())
                parts.append({"file": name, "first": first, "rows": len(held)})

        for row in iterator:
            if not held or row["row"] != first + len(held) or len(held) >= PART_ROWS:
                flush()
                held, first = [], row["row"]
            held.append(row["values"])
        flush()
        return Written(parts)

    def commit(self, messages: list[Written | None]) -> None:
        system, at = _at(self.path)
        system.create_dir(at, recursive=True)
        with system.open_output_stream(f"{at}/{MANIFEST}") as f:
            f.write(json.dumps(sorted((p for m in messages if m for p in m.parts), key=lambda p: p["first"])).encode())

    def abort(self, messages: list[Written | None]) -> None:
        system, at = _at(self.path)
        for p in (p for m in messages if m for p in m.parts):
            system.delete_file(f"{at}/{p['file']}")


class MatrixSource(DataSource):
    """``spark.read.format("quern_matrix")``: ``row, values`` of a matrix file or of a folder of parts that the same format wrote."""

    @classmethod
    def name(cls) -> str:
        return "quern_matrix"

    def schema(self) -> str:
        return "row bigint, values array<double>"

    def reader(self, schema) -> MatrixReader:
        return MatrixReader(self.options["path"].rstrip("/"), int(self.options.get("splitBytes", SPLIT_BYTES)))

    def writer(self, schema, overwrite: bool) -> MatrixWriter:
        return MatrixWriter(self.options["path"].rstrip("/"), self.options.get("dtype", "<f4"))


def read(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``row, values`` of a matrix: a ``.npy`` file of numbers, a flat vector index, or a folder of parts. Rows are read by their offset, ``split_bytes`` a task. A file whose length is not
    what its header states is refused before anything is read. The path must be one that the workers can open."""
    spark.dataSource.register(MatrixSource)
    return spark.read.format("quern_matrix").option("splitBytes", str(split_bytes)).load(path)


def write(rows: DataFrame, path: str, id_col: str, values: str, dtype: str = "<f4") -> None:
    """The vectors in ``values`` as a folder of ``.npy`` parts in the order of ``id_col``, and the ids with their row numbers as Parquet in ``<path>-ids``.

    Rows are dealt into ranges of the id and numbered by running sums over ranges, so every task writes rows that follow each other, and none holds them all. The list of parts is written when all
    tasks are done: a folder without it is no matrix, so a write that stopped is never read. Vectors of unlike lengths are an error.
    """
    spark = rows.sparkSession
    spark.dataSource.register(MatrixSource)
    numbered = ranked(rows.select(F.col(id_col).alias("id"), F.col(values).alias("values")), [], [F.col("id").asc()], "_r")
    numbered = numbered.select((F.col("_r") - 1).alias("row"), "id", F.col("values").cast("array<double>").alias("values"))
    widths = numbered.agg(F.count_distinct(F.coalesce(F.size("values"), F.lit(-1))).alias("n")).first()["n"]
    if widths > 1:
        raise ValueError("vectors of unlike lengths")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered.select("row", "values").repartitionByRange(parts, "row").sortWithinPartitions("row").write.format("quern_matrix").option("dtype", dtype).mode("append").save(path)
    numbered.select("row", "id").write.parquet(f"{path}-ids")


def with_ids(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``id, values`` of a matrix that :func:`write` wrote."""
    return read(spark, path, split_bytes).join(spark.read.parquet(f"{path}-ids"), "row").select("id", "values")
