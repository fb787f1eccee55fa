"""Workbooks: typed round trips, cells as other programs write them, limits."""

import datetime
import zipfile

import pytest

from quern.sources import workbooks

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def test_round_trip_of_two_sheets(spark, tmp_path):
    odd = 'a <b> & "c" é 日 \n line\ttab \r return \x01 _x0041_ _x'
    first = spark.createDataFrame([("007", 1, 2.5, True, odd), ("0010", None, float("nan"), None, None), ("x", -3, 1e-9, False, "")], "`ID` string, n bigint, x double, ok boolean, note string")
    second = spark.createDataFrame([], "a string, b int")
    path = str(tmp_path / "books" / "b.xlsx")
    workbooks.write({"one": first.repartition(2), "two & <more>": second, "three": first.select("ID")}, path)
    got = workbooks.read(spark, path, "ID string, n bigint, x double, ok boolean, note string, lacks string").collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted([("007", 1, 2.5, True, odd, None), ("0010", None, None, None, None, None), ("x", -3, 1e-9, False, "", None)], key=str)
    assert workbooks.read(spark, path, "a string, b int", "two & <more>").collect() == []
    assert sorted(r["ID"] for r in workbooks.read(spark, path, "ID string", "three").collect()) == ["0010", "007", "x"]
    with pytest.raises(Exception, match="no sheet"):
        workbooks.read(spark, path, "a string", "four").collect()


def foreign(path, sheet, strings=""):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="4" r:id="rId9"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId9" Type="t" Target="/xl/worksheets/other.xml"/></Relationships>')
        z.writestr("xl/worksheets/other.xml", f"<worksheet {MAIN}><sheetData>{sheet}</sheetData></worksheet>")
        if strings:
            z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>{strings}</sst>")


def test_cells_of_other_programs(spark, tmp_path):
    strings = "<si><t>id</t></si><si><t> when </t></si><si><r><t>ri</t></r><r><t>ch</t></r><rPh><t>no</t></rPh></si>"
    rows = '<row r="1"><c r="B1" t="s"><v>0</v></c><c r="D1" t="s"><v>1</v></c><c r="AA1" t="inlineStr"><is><t>far</t></is></c></row>'
    rows += '<row r="4"><c r="B4"><v>12.0</v></c><c r="D4" s="3"><v>45000.25</v></c><c r="AA4" t="s"><v>2</v></c></row>'
    rows += '<row r="5"><c r="B5" t="str"><f>A1</f><v>=x</v></c><c r="D5" t="e"><v>#N/A</v></c><c r="AA5" t="b"><v>1</v></c></row><row r="6"/>'
    foreign(tmp_path / "a.xlsx", rows, strings)
    foreign(tmp_path / "b.xlsx", '<row><c t="inlineStr"><is><t>id</t></is></c></row><row><c><v>7</v></c></row>')
    (tmp_path / "~lock.xlsx").write_text("no book")
    found = workbooks.read(spark, str(tmp_path), "id string, when date, far string").collect()
    assert sorted((tuple(r) for r in found), key=str) == sorted([("12", datetime.date(2023, 3, 15), "rich"), ("=x", None, "true"), ("7", None, None)], key=str)


def test_limits(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([("x" * (workbooks.MOST_CHARS + 1),)], "a string")
    with pytest.raises(Exception, match="a cell holds"):
        workbooks.write({"s": df}, str(tmp_path / "x.xlsx"))
