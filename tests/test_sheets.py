"""Spreadsheets: what is written is read again, by ranges and sheets; files of other writers; a distance matrix."""

import io
import zipfile
from collections import Counter

import pytest

from textmill.operators import places
from textmill.sources import sheets

ROWS = [
    (1, "a", 1.5, True), (2, " two  blanks ", -0.25, False), (3, None, None, None), (4, "", 1e300, True), (5, "<&>\"'", 0.1, None), (6, "line\nbreak\ttab\rreturn", 3.0, None),
    (7, "\x01\x1f control _x0041_ ￾", 2.0, None), (8, "é漢\U0001f600", 1 / 3, None), (9, "x" * 70_000, 5e-324, None), (10, "12", 12.0, None),
]
SCHEMA = "k long, t string, x double, b boolean"


@pytest.fixture(scope="module")
def source(spark):
    spark.dataSource.register(sheets.SheetSource)
    return spark


def read(spark, path, schema=SCHEMA, **options):
    reader = spark.read.format("sheets").options(**options)
    return (reader.schema(schema) if schema else reader).load(str(path))


@pytest.mark.parametrize("rows", [1, 3, 1000])
def test_round_trip(source, tmp_path, rows):
    df = source.createDataFrame(ROWS * 3, SCHEMA).repartition(4)
    df.write.format("sheets").mode("append").save(str(tmp_path / "out.xlsx"))
    got = read(source, tmp_path / "out.xlsx", range_rows=rows)
    # a row of nulls is no row in a sheet, the others are; null and empty texts stay apart
    assert Counter(map(tuple, got.collect())) == Counter(r for r in ROWS * 3)
    if rows == 1:
        assert got.rdd.getNumPartitions() == 30
    guessed = read(source, tmp_path / "out.xlsx", None)
    assert guessed.dtypes == [("k", "double"), ("t", "string"), ("x", "double"), ("b", "boolean")]
    df.limit(2).write.format("sheets").mode("overwrite").save(str(tmp_path / "out.xlsx"))
    assert read(source, tmp_path / "out.xlsx").count() == 2


def test_many_sheets(source, tmp_path):
    out = io.BytesIO()
    sheets.write_workbook(out, ["k", "t"], ((i, f"r{i}") for i in range(25)), "Data & more", sheet_rows=11)
    (tmp_path / "a.xlsx").write_bytes(out.getvalue())
    assert sorted(r.k for r in read(source, tmp_path / "a.xlsx", "k long, t string", sheet="*").collect()) == list(range(25))
    assert [r.k for r in read(source, tmp_path / "a.xlsx", "k long, t string").orderBy("k").collect()] == list(range(10))
    assert read(source, tmp_path / "a.xlsx", None, sheet="Data & more 3").count() == 5
    with pytest.raises(Exception, match="no sheet"):
        read(source, tmp_path / "a.xlsx", None, sheet="other").count()


def test_file_of_another_writer(source, tmp_path):
    """Shared and rich strings, formulas, errors, cells without references, rows left out, absolute targets."""
    main = sheets.MAIN.strip("{}")
    sheet = f"""<worksheet xmlns="{main}"><dimension ref="A1:D9"/><sheetData>
    <row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row>
    <row r="3"><c r="A3"><v>1</v></c><c r="B3" t="str"><f>A3</f><v>x_x000D_</v></c><c r="C3" t="e"><v>#N/A</v></c><c r="AB3" t="b"><v>1</v></c></row>
    <row><c t="s"><v>1</v></c><c><v>2.5E3</v></c></row><row r="9"/></sheetData></worksheet>"""
    book = f'<workbook xmlns="{main}" xmlns:r="{sheets.LINKS.strip("{}")}"><sheets><sheet name="S" sheetId="1" r:id="a"/></sheets></workbook>'
    links = f'<Relationships xmlns="{sheets.PACKAGE.strip("{}")}"><Relationship Id="a" Target="/xl/worksheets/s.xml"/></Relationships>'
    strings = f'<sst xmlns="{main}"><si><t>name</t></si><si><r><t>ri</t></r><r><t>ch</t></r><rPh sb="0" eb="1"><t>no</t></rPh></si></sst>'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        for name, text in (("xl/workbook.xml", book), ("xl/_rels/workbook.xml.rels", links), ("xl/worksheets/s.xml", sheet), ("xl/sharedStrings.xml", strings)):
            z.writestr(name, text)
    got = read(source, tmp_path / "b.xlsx", None)
    assert got.columns[:4] == ["name", "_1", "rich", "_3"] and len(got.columns) == 28
    rows = sorted((tuple(r[:3]), r[27]) for r in got.collect())
    assert rows == [(("1", "x\r", None), True), (("rich", "2500", None), None)]


def test_empty_table(source, tmp_path):
    source.createDataFrame([], SCHEMA).write.format("sheets").mode("append").save(str(tmp_path / "e"))
    assert read(source, tmp_path / "e").count() == 0


def test_distance_matrix_with_an_index(source, tmp_path):
    """A matrix as spreadsheets hold it, as rows (origin, destination, km)."""
    out = io.BytesIO()
    sheets.write_workbook(out, ["", "A", "B"], [("A", 0, 12.5), ("B", 12.5, 0)], "km")
    (tmp_path / "m.xlsx").write_bytes(out.getvalue())
    matrix = read(source, tmp_path / "m.xlsx", None, index="true")
    got = sorted(map(tuple, matrix.unpivot("index", ["A", "B"], "destination", "km").collect()))
    assert got == [("A", "A", 0.0), ("A", "B", 12.5), ("B", "A", 12.5), ("B", "B", 0.0)]
    routes = source.createDataFrame([("A", "B"), ("A", "C")], "o string, d string")
    long = matrix.unpivot("index", ["A", "B"], "destination", "km").withColumnRenamed("index", "origin")
    from pyspark.sql import functions as F

    assert {r.d: r.km for r in places.with_distance(routes, long, "o", "d", F.lit(99.0)).collect()} == {"B": 12.5, "C": 99.0}
