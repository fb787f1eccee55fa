"""Workbooks of sheets (zipped XML): typed tables in and out."""

from __future__ import annotations

import datetime
import json
import re
import shutil
import tempfile
import zipfile
from collections.abc import Iterable, Iterator, Mapping
from itertools import groupby, islice
from typing import IO
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

# Names of the format, and the most rows and characters of a cell that it allows.
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"
MOST_ROWS, MOST_CHARS, MOST_NAME = 1_048_576, 32_767, 31
#: Name, local to a sheet that goes on where a full one ends, that refers to the first sheet of that table.
_CONTINUES = "continues"
#: Rows of an Arrow batch, and bytes of a sheet's text that a task reads.
BATCH_ROWS, SPAN = 4096, 16 << 20
_MARK = re.compile(rb"<row(?=[\s/>])|</sheetData")
_REF = re.compile(r"([A-Z]+)(\d+)")
_ESCAPED = re.compile(r"_x([0-9A-Fa-f]{4})_")
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]|_(?=x[0-9A-Fa-f]{4}_)")


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _letters(n: int) -> str:
    """Name of the n-th column, from 0."""
    out = ""
    n += 1
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


def _number(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n - 1


def _text(node: ElementTree.Element) -> str:
    """The text of a string with or without runs; phonetic readings are no part of it."""
    own = [t.text or "" for t in node.findall(f"{{{_MAIN}}}t")] + [t.text or "" for r in node.findall(f"{{{_MAIN}}}r") for t in r.findall(f"{{{_MAIN}}}t")]
    return _ESCAPED.sub(lambda m: chr(int(m[1], 16)), "".join(own))


def sheet_parts(book: zipfile.ZipFile) -> dict[str, str]:
    """Sheets in their order, with the part that holds each."""
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{{{_MAIN}}}sheets")
    part = lambda target: target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    return {s.get("name"): part(links[s.get(f"{{{_REL}}}id")]) for s in sheets}


def continued(book: zipfile.ZipFile) -> dict[str, list[str]]:
    """Sheets that hold the further rows of a table, by the name of the table's first sheet; other programs' workbooks have none."""
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    names = [s.get("name") for s in root.find(f"{{{_MAIN}}}sheets")]
    out: dict[str, list[str]] = {}
    for n in root.iterfind(f"{{{_MAIN}}}definedNames/{{{_MAIN}}}definedName"):
        if n.get("name") == _CONTINUES and n.get("localSheetId") is not None and n.text:
            out.setdefault(n.text.rpartition("!")[0].strip("'").replace("''", "'"), []).append(names[int(n.get("localSheetId"))])
    return out


def shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as f:
        for _, node in ElementTree.iterparse(f):
            if node.tag == f"{{{_MAIN}}}si":
                out.append(_text(node))
                node.clear()
    return out


def cells(book: zipfile.ZipFile, part: str) -> Iterator[dict[int, str]]:
    """The rows of a sheet, one after the other: text of each cell that has a value, by column. Rows that are left out are empty."""
    strings = shared_strings(book)
    with book.open(part) as f:
        yield from _rows(ElementTree.iterparse(f, ("start", "end")), strings)


def _rows(events: Iterable[tuple[str, ElementTree.Element]], strings: list[str], upto: int | None = 0) -> Iterator[dict[int, str]]:
    """Rows after row ``upto``; None: whatever the first one's number is."""
    above = None
    for event, node in events:
        if event == "start":
            if node.tag == f"{{{_MAIN}}}sheetData":
                above = node
            continue
        if node.tag != f"{{{_MAIN}}}row":
            continue
        at = int(node.get("r") or (upto or 0) + 1)
        if upto is not None:
            for _ in range(at - upto - 1):
                yield {}
        row, column = {}, -1
        for c in node.findall(f"{{{_MAIN}}}c"):
            ref = _REF.match(c.get("r") or "")
            column = _number(ref[1]) if ref else column + 1
            kind, v = c.get("t"), c.find(f"{{{_MAIN}}}v")
            if kind == "inlineStr":
                row[column] = _text(c.find(f"{{{_MAIN}}}is"))
            elif v is not None and v.text is not None and kind != "e":  # an error is no value
                row[column] = strings[int(v.text)] if kind == "s" else {"0": "false", "1": "true"}[v.text] if kind == "b" else _ESCAPED.sub(lambda m: chr(int(m[1], 16)), v.text) if kind == "str" else v.text
        yield row
        upto = at
        above.clear()  # its rows, or a long sheet's would add up


def _span(f: IO[bytes], start: int, end: int) -> tuple[bytes, bytes, bytes] | None:
    """What a sheet has before its rows, its first row, and the rows that begin at its bytes ``start`` to ``end``. None where rows can't be told by bytes: a wide encoding,
    prefixed names, comments, marked sections, no rows. All spans of a sheet look at all that comes before its rows' end, so they agree on that."""
    opening, own, at, tail, going = bytearray(), bytearray(), 0, b"", True
    while block := f.read(1 << 20):
        seen = tail + block
        if b"\x00" in block or b"<!" in seen or b"<?" in (seen if at else seen[8:]):
            return None
        if (over := seen.find(b"</sheetData")) >= 0:
            block = seen[len(tail) : over + len(b"</sheetData")]
        if sum(1 for _ in islice(_MARK.finditer(opening), 2)) < 2:
            opening += block
        if going and at + len(block) > start:
            own += block[max(0, start - at) :]
            going = not (start + len(own) > end and _MARK.search(own, end - start))
        if over >= 0:
            break
        at, tail = at + len(block), seen[-16:]
    marks = [m.start() for m in islice(_MARK.finditer(opening), 2)]
    if len(marks) < 2 or opening[marks[0] : marks[0] + 2] == b"</":
        return None
    first, last = _MARK.search(own), _MARK.search(own, end - start)
    some = first and first[0] != b"</sheetData" and start + first.start() < end
    return bytes(opening[: marks[0]]), bytes(opening[marks[0] : marks[1]]), bytes(own[first.start() : last.start() if last else len(own)]) if some else b""


def _fed(*parts: bytes) -> Iterator[tuple[str, ElementTree.Element]]:
    pull = ElementTree.XMLPullParser(("start", "end"))
    for part in parts:
        for i in range(0, len(part), 1 << 20):
            pull.feed(part[i : i + (1 << 20)])
            yield from pull.read_events()


def _plain(text: str | None) -> str | None:
    """A number as an id has it: without the point that a spreadsheet gives whole numbers."""
    return text[:-2] if text and re.fullmatch(r"-?\d+\.0", text) else text


class Sheet(InputPartition):
    """The rows of a sheet that begin at bytes ``start`` to ``end`` of its text."""

    def __init__(self, path: str, part: str, start: int, end: int) -> None:
        self.path, self.part, self.start, self.end = path, part, start, end


class WorkbookReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: Mapping[str, str]) -> None:
        self.schema, self.path, self.sheet = schema, options["path"], options.get("sheet")

    def partitions(self) -> list[Sheet]:
        system, at = _at(self.path)
        info = system.get_file_info(at)
        files = [self.path] if info.type == fs.FileType.File else [f"{self.path.rstrip('/')}/{x.base_name}" for x in system.get_file_info(fs.FileSelector(at)) if x.base_name.endswith(".xlsx") and not x.base_name.startswith(("~", "."))]
        out = []
        for path in sorted(files):
            with _at(path)[0].open_input_file(_at(path)[1]) as f, zipfile.ZipFile(f) as book:
                parts, more = sheet_parts(book), continued(book)
                first = [n for n in ([self.sheet] if self.sheet else list(parts)[:1]) if n in parts]
                for part in (parts[n] for one in first for n in (one, *more.get(one, []))):
                    out += [Sheet(path, part, i, i + SPAN) for i in range(0, max(1, book.getinfo(part).file_size), SPAN)]
        if not out:
            raise ValueError(f"{self.path}: no sheet {self.sheet}")
        return out

    def read(self, split: Sheet) -> Iterator[pa.RecordBatch]:
        wanted = [(f.name, f.dataType.simpleString()) for f in self.schema.fields]
        system, at = _at(split.path)
        with system.open_input_file(at) as f, zipfile.ZipFile(f) as book:
            with book.open(split.part) as text:
                found = _span(text, split.start, split.end) if book.getinfo(split.part).file_size > SPAN else None
            if found is None:
                if split.start:  # the first span's task reads them all
                    return
                rows = cells(book, split.part)
                top = next(rows, {})
            else:
                head, first, own = found
                strings = shared_strings(book)
                top = next(_rows(_fed(head, first), strings), {})
                rows = _rows(_fed(head, own), strings, None if split.start else 0)
                if not split.start:
                    next(rows, None)
            header = {v.strip(): k for k, v in top.items()}
            held: list[list[str | None]] = []
            for row in rows:
                if row:
                    held.append([row.get(header.get(n, -1)) for n, _ in wanted])
                if len(held) >= BATCH_ROWS:
                    yield self._batch(held, wanted)
                    held = []
            yield self._batch(held, wanted)

    def _batch(self, held: list[list[str | None]], wanted: list[tuple[str, str]]) -> pa.RecordBatch:
        columns = [[r[i] for r in held] for i in range(len(wanted))]
        return pa.RecordBatch.from_arrays([_typed(c, kind) for c, (_, kind) in zip(columns, wanted)], names=[n for n, _ in wanted])


def _typed(values: list[str | None], kind: str) -> pa.Array:
    """Cells as a column of a Spark type; what does not read as the type is null. Dates are days since the end of 1899."""

    def read(f, blank: bool = True):
        def one(v: str | None):
            try:
                return None if v is None or (blank and not v.strip()) else f(v)
            except (ValueError, OverflowError):
                return None

        return [one(v) for v in values]

    if kind in ("tinyint", "smallint", "int", "bigint"):
        return pa.array(read(lambda v: int(float(v)) if float(v) == int(float(v)) else None), {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64()}[kind])
    if kind in ("float", "double"):
        return pa.array(read(float), pa.float32() if kind == "float" else pa.float64())
    if kind == "boolean":
        return pa.array(read(lambda v: {"true": True, "false": False, "1": True, "0": False}.get(v.strip().lower())), pa.bool_())
    if kind == "date":
        return pa.array(read(lambda v: datetime.date(1899, 12, 30) + datetime.timedelta(days=int(float(v)))), pa.date32())
    if kind != "string":
        raise ValueError(f"a cell is no {kind}")
    return pa.array(read(_plain, False), pa.string())


class Made(WriterCommitMessage):
    pass


class WorkbookWriter(DataSourceWriter):
    """``sheet_no, sheet, names, no, made`` of one workbook (see :func:`_made`), sorted, in one task: the format is one zip file. A table of more rows than a sheet takes goes on in further sheets."""

    def __init__(self, path: str, tables: list[str], most: int = MOST_ROWS) -> None:
        self.path, self.tables, self.most = path, tables, most

    def write(self, iterator) -> Made:
        sheets: list[tuple[str, str]] = []  # name, and name of the table's first sheet
        with tempfile.TemporaryFile() as data:
            with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as book:
                for (table, names), chunks in groupby(iterator, lambda r: (r["sheet"], r["names"])):
                    rows = (row for r in chunks if r["made"] is not None for row in bytes(r["made"]).split(_BREAK))
                    row = next(rows, None)
                    while row is not None or not any(t == table for _, t in sheets):
                        sheets.append((self._free(table, {s for s, _ in sheets}), table))
                        with book.open(f"xl/worksheets/sheet{len(sheets)}.xml", "w", force_zip64=True) as f:
                            f.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN}"><sheetData>'.encode())
                            f.write(_row(names, ["string"] * len(names)).replace(_NUMBER, b"1"))
                            n = 2
                            while row is not None and n <= self.most:
                                own = [row, *islice(rows, min(BATCH_ROWS, self.most + 1 - n) - 1)]
                                f.write(b"".join(r.replace(_NUMBER, b"%d" % i) for i, r in enumerate(own, n)))
                                row, n = next(rows, None), n + len(own)
                            f.write(b"</sheetData></worksheet>")
                if not sheets:
                    return Made()
                for name, text in _frame(sheets).items():
                    book.writestr(name, text)
            data.seek(0)
            system, at = _at(self.path)
            system.create_dir(at.rpartition("/")[0], recursive=True)
            with system.open_output_stream(at) as f:
                shutil.copyfileobj(data, f, 1 << 20)
        return Made()

    def _free(self, table: str, used: set[str]) -> str:
        """The table's name for its first sheet; then a name that no other sheet has, whatever its case."""
        if table not in used:
            return table
        taken, k = {n.lower() for n in used.union(self.tables)}, 2
        while (name := f"{table[: MOST_NAME - len(f' ({k})')]} ({k})").lower() in taken:
            k += 1
        return name

    def commit(self, messages: list) -> None:
        return

    def abort(self, messages: list) -> None:
        return


#: In the place of a row's number until it is known, and between rows; neither can stand in the text of a cell.
_NUMBER, _BREAK = b"\x00", b"\x01"


def _row(values: list[str | None], kinds: list[str]) -> bytes:
    out = []
    for i, (v, kind) in enumerate(zip(values, kinds)):
        if v is None:
            continue
        at = f"{_letters(i)}\x00"
        if kind == "number":
            out.append(f'<c r="{at}"><v>{v}</v></c>')
        elif kind == "boolean":
            out.append(f'<c r="{at}" t="b"><v>{int(v == "true")}</v></c>')
        else:
            if len(v) > MOST_CHARS:
                raise ValueError(f"column {_letters(i)}: {len(v)} characters; a cell holds {MOST_CHARS}")
            said = _CONTROL.sub(lambda m: f"_x{ord(m[0]):04X}_", v).replace("\r", "_x000D_")
            out.append(f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(said)}</t></is></c>')
    return f'<row r="\x00">{"".join(out)}</row>'.encode()


def _made(rows: DataFrame, kinds: list[str]) -> DataFrame:
    """``made``: the text of up to BATCH_ROWS rows of ``rows(cells)`` each, made where the rows are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH_ROWS):
                own = batch.column("cells").slice(i, BATCH_ROWS).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([_BREAK.join(_row(r, kinds) for r in own)], pa.binary())], names=["made"])

    n = max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(n).mapInArrow(run, "made binary")  # a small file would be one task, and making text takes far longer than moving its cells


def _quoted(name: str) -> str:
    return "'" + name.replace("'", "''") + "'"


def _frame(sheets: list[tuple[str, str]]) -> dict[str, str]:
    """The parts of a workbook besides its sheets, which come as (name, name of the table's first sheet)."""
    head, office = '<?xml version="1.0" encoding="UTF-8"?>', "application/vnd.openxmlformats-officedocument.spreadsheetml"
    n, names = range(1, len(sheets) + 1), [s for s, _ in sheets]
    more = "".join(f'<definedName name="{_CONTINUES}" localSheetId="{i}" hidden="1">{escape(_quoted(t))}!$A$1</definedName>' for i, (s, t) in enumerate(sheets) if s != t)
    return {
        "[Content_Types].xml": f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        f'<Override PartName="/xl/workbook.xml" ContentType="{office}.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{office}.worksheet+xml"/>' for i in n) + "</Types>",
        "_rels/.rels": f'{head}<Relationships xmlns="{_PACKAGE}"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{head}<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>' + "".join(f'<sheet name={quoteattr(s)} sheetId="{i}" r:id="rId{i}"/>' for i, s in zip(n, names)) + "</sheets>" + (f"<definedNames>{more}</definedNames>" if more else "") + "</workbook>",
        "xl/_rels/workbook.xml.rels": f'{head}<Relationships xmlns="{_PACKAGE}">' + "".join(f'<Relationship Id="rId{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in n) + "</Relationships>",
    }


class WorkbookSource(DataSource):
    """``quern_workbook``: a sheet of a workbook, or of each workbook of a folder, a task for each span of it, by a schema of the reader's."""

    @classmethod
    def name(cls) -> str:
        return "quern_workbook"

    def schema(self) -> str:
        raise ValueError("a sheet is read by a schema")

    def reader(self, schema: T.StructType) -> WorkbookReader:
        return WorkbookReader(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(self.options["path"], json.loads(self.options["tables"]), int(self.options["most"]))


def read(spark: SparkSession, path: str, schema: str | T.StructType, sheet: str | None = None) -> DataFrame:
    """A sheet (the first one, if not named) of a workbook, or of every workbook in a folder: the columns of ``schema``, found by the header in the sheet's first row.

    Cells are typed by the schema and not by the sheet: an id column read as a string keeps leading zeros, and a whole number's ``.0`` goes. Columns that a sheet lacks and cells that do not read as
    their type are null, rows without any cell are left out. Each span of a sheet is one task's stream of rows, which inflates the sheet and parses what is its own; sheets whose rows can't be told
    by bytes are one task's. A table that :func:`write` continued in further sheets is read whole by its first sheet's name.
    """
    spark.dataSource.register(WorkbookSource)
    reader = spark.read.format("quern_workbook").schema(schema)
    return (reader.option("sheet", sheet) if sheet else reader).load(path)


def write(sheets: Mapping[str, DataFrame], path: str) -> None:
    """One workbook with a sheet for each table, in order, its columns' names in the first row; numbers and truth values are typed cells, all else is text. Sheets hold the rows in no order of their own: add a column to sort by.

    A workbook is one file of one zip archive: rows' text is made where they are, one task numbers and packs it. A table of more than MOST_ROWS rows, the header counted, goes on in further sheets
    named ``name (2)`` and so on (or the next number that is free), each with the header; a hidden name in each tells which sheet it continues.
    """
    out = None
    spark = next(iter(sheets.values())).sparkSession
    for i, (name, df) in enumerate(sheets.items()):
        number = (T.NumericType,)
        kinds = ["number" if isinstance(f.dataType, number) else "boolean" if isinstance(f.dataType, T.BooleanType) else "string" for f in df.schema.fields]
        plain = lambda c: F.when(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")), c.cast("string"))
        values = [plain(F.col(f"`{f.name}`")) if k == "number" else F.col(f"`{f.name}`").cast("string") for f, k in zip(df.schema.fields, kinds)]
        same = [F.lit(i).alias("sheet_no"), F.lit(name).alias("sheet"), F.array(*map(F.lit, df.columns)).alias("names")]
        rows = _made(df.select(F.array(*values).alias("cells")), kinds).select(*same, F.monotonically_increasing_id().alias("no"), "made")
        head = spark.range(1).select(*same, F.lit(-1).cast("bigint").alias("no"), F.lit(None).cast("binary").alias("made"))  # an empty table has a sheet too
        rows = head.unionByName(rows)
        out = rows if out is None else out.unionByName(rows)
    spark.dataSource.register(WorkbookSource)
    out.repartition(1).sortWithinPartitions("sheet_no", "no").write.format("quern_workbook").mode("append").option("tables", json.dumps(list(sheets))).option("most", MOST_ROWS).save(path)
