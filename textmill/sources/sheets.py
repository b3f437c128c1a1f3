"""Spreadsheets (.xlsx) as a data source: sheets and ranges of rows are partitions, and writers write one workbook each.

    spark.dataSource.register(SheetSource)
    spark.read.format("sheets").option("sheet", "Routes").load(path)
    df.write.format("sheets").mode("append").save(folder)

Options: ``sheet`` (a name, or * for all sheets of equal columns; the first one if unset), ``header`` (true), ``range_rows`` (rows of a partition), ``index`` (true: the
first column is an index, named ``index`` where its header is empty). Paths must be seen by the driver and all executors; they are opened through pyarrow's file
systems. A folder stands for the .xlsx files in it.

Cells are numbers, texts, booleans, or null where they are empty or errors; dates are the numbers that the file holds. Without a schema a column is double or boolean if
all its cells are, else string.
"""

from __future__ import annotations

import posixpath
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

from pyarrow import fs
from pyspark.sql import Row
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINKS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"
#: The format's own bounds, and the rows of a partition when read.
SHEET_ROWS, RANGE_ROWS = 1_048_576, 100_000
HIDDEN = re.compile(r"_x([0-9A-Fa-f]{4})_")
FORBIDDEN = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\r￾￿]|_(?=x[0-9A-Fa-f]{4}_)")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path within it."""
    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parts.path) if parts.scheme else path
    return fs.FileSystem.from_uri(path)


def workbooks(path: str) -> list[str]:
    files, inner = opened(path)
    if files.get_file_info(inner).type == fs.FileType.Directory:
        found = files.get_file_info(fs.FileSelector(inner))
        return sorted(x.path for x in found if x.type == fs.FileType.File and x.base_name.endswith(".xlsx") and not x.base_name.startswith((".", "_")))
    return [inner]


def column_of(reference: str) -> int:
    """The place (from 0) of a cell reference such as AB12."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def column_name(place: int) -> str:
    out, n = "", place + 1
    while n:
        n, rest = divmod(n - 1, 26)
        out = chr(65 + rest) + out
    return out


class Workbook:
    """Sheets of an open .xlsx file."""

    def __init__(self, file) -> None:
        self.zip = zipfile.ZipFile(file)
        links = {x.get("Id"): x.get("Target") for x in self.xml("xl/_rels/workbook.xml.rels").iter(f"{PACKAGE}Relationship")}
        self.sheets = {}
        for x in self.xml("xl/workbook.xml").iter(f"{MAIN}sheet"):
            target = links[x.get(f"{LINKS}id")]
            self.sheets[x.get("name")] = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")
        self.shared: list[str] | None = None

    def xml(self, name: str) -> ElementTree.Element:
        with self.zip.open(name) as f:
            return ElementTree.parse(f).getroot()

    def said(self, x: ElementTree.Element) -> str:
        """Text of a string item: its own, or that of its runs, without phonetic marks."""
        texts = [t.text or "" for t in x.findall(f"{MAIN}t")] + [t.text or "" for t in x.findall(f"{MAIN}r/{MAIN}t")]
        return HIDDEN.sub(lambda m: chr(int(m[1], 16)), "".join(texts))

    def string(self, place: int) -> str:
        if self.shared is None:
            known = "xl/sharedStrings.xml" in self.zip.namelist()
            self.shared = [self.said(x) for x in self.xml("xl/sharedStrings.xml").findall(f"{MAIN}si")] if known else []
        return self.shared[place]

    def rows(self, sheet: str, first: int = 0, last: int | None = None) -> Iterator[tuple[int, dict[int, object]]]:
        """(place, cells by place) of the rows first to last (from 0, last left out), as they stream by; rows that the file leaves out are not given."""
        with self.zip.open(self.sheets[sheet]) as f:
            row, at = -1, None
            for event, x in ElementTree.iterparse(f, ("start", "end")):
                if event == "start" and x.tag == f"{MAIN}sheetData":
                    at = x
                if event != "end" or x.tag != f"{MAIN}row":
                    continue
                row = int(x.get("r")) - 1 if x.get("r") else row + 1
                if last is not None and row >= last:
                    return
                if row >= first:
                    cells, place = {}, -1
                    for c in x.findall(f"{MAIN}c"):
                        place = column_of(c.get("r")) if c.get("r") else place + 1
                        cells[place] = self.value(c)
                    yield row, cells
                at.clear()  # what has been read is let go

    def value(self, c: ElementTree.Element) -> object:
        kind, v = c.get("t", "n"), c.find(f"{MAIN}v")
        if kind == "inlineStr":
            inline = c.find(f"{MAIN}is")
            return self.said(inline) if inline is not None else None
        if v is None or v.text is None or kind == "e":
            return "" if kind == "str" and v is not None else None
        if kind == "s":
            return self.string(int(v.text))
        if kind == "b":
            return v.text.strip() == "1"
        return HIDDEN.sub(lambda m: chr(int(m[1], 16)), v.text) if kind == "str" else float(v.text)


@dataclass
class Range(InputPartition):
    path: str
    sheet: str
    first: int
    last: int

    def __post_init__(self) -> None:
        super().__init__((self.path, self.sheet, self.first, self.last))


def converted(value: object, kind: T.DataType) -> object:
    """A cell as a value of the column's type; ValueError if it is not one."""
    if value is None:
        return None
    if isinstance(kind, T.StringType):
        return str(value).lower() if isinstance(value, bool) else f"{value:.0f}" if isinstance(value, float) and value.is_integer() and abs(value) < 1e15 else str(value)
    if isinstance(kind, T.BooleanType):
        return value if isinstance(value, bool) else {"true": True, "false": False}[str(value).lower()]
    if isinstance(kind, T.IntegralType):
        number = float(value)
        if not number.is_integer():
            raise ValueError(f"{value} is no whole number")
        return int(value) if isinstance(value, str) and value.strip().lstrip("+-").isdigit() else int(number)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return float(value)
    raise ValueError(f"no cells of type {kind.simpleString()}")


class Sheets(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict) -> None:
        self.kinds, self.options = schema, options

    def partitions(self) -> list[Range]:
        size = int(self.options.get("range_rows", RANGE_ROWS))
        return [Range(path, sheet, low, min(low + size, high)) for path, sheet, begin, high in places(self.options) for low in range(begin, high, size)]

    def read(self, part: Range | None) -> Iterator[tuple]:
        if part is None:  # nothing to read is one partition of nothing
            return
        files, _ = opened(self.options["path"])
        with files.open_input_file(part.path) as f:
            for _, cells in Workbook(f).rows(part.sheet, part.first, part.last):
                row = tuple(converted(cells.get(i), k.dataType) for i, k in enumerate(self.kinds.fields))
                if any(v is not None for v in row):
                    yield row


def flag(options: dict, name: str, default: bool) -> bool:
    return str(options.get(name, default)).lower() == "true"


def places(options: dict) -> list[tuple[str, str, int, int]]:
    """(path, sheet, first row, last row) of what is to be read; rows are counted as the sheets stream by."""
    files, _ = opened(options["path"])
    out = []
    for path in workbooks(options["path"]):
        with files.open_input_file(path) as f:
            book = Workbook(f)
            wanted = options.get("sheet")
            names = list(book.sheets) if wanted == "*" else [wanted] if wanted else list(book.sheets)[:1]
            for name in names:
                if name not in book.sheets:
                    raise ValueError(f"no sheet {name!r} in {path}")
                end = max((r for r, _ in book.rows(name)), default=-1) + 1
                out.append((path, name, min(int(flag(options, "header", True)), end), end))
    return out


class Writer(DataSourceWriter):
    """Each task writes one workbook, under a name that is final once the job commits."""

    def __init__(self, options: dict, schema: T.StructType, overwrite: bool) -> None:
        self.options, self.kinds, self.overwrite = options, schema, overwrite
        files, folder = opened(options["path"])
        self.before = workbooks(options["path"]) if files.get_file_info(folder).type == fs.FileType.Directory else []
        files.create_dir(folder, recursive=True)

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        files, folder = opened(self.options["path"])
        name = f"{folder.rstrip('/')}/_part-{uuid.uuid4().hex}.xlsx"
        with files.open_output_stream(name) as f:
            write_workbook(f, self.kinds.fieldNames(), rows, self.options.get("sheet", "Sheet"))
        return Written(name)

    def commit(self, messages: list) -> None:
        files, _ = opened(self.options["path"])
        for m in messages:
            head, tail = posixpath.split(m.name)
            files.move(m.name, f"{head}/{tail.lstrip('_')}")
        if self.overwrite:
            for path in self.before:
                files.delete_file(path)

    def abort(self, messages: list) -> None:
        files, _ = opened(self.options["path"])
        for m in messages:
            if m is not None and files.get_file_info(m.name).type == fs.FileType.File:
                files.delete_file(m.name)


@dataclass
class Written(WriterCommitMessage):
    name: str


def cell(place: int, row: int, value: object) -> str:
    at = f'{column_name(place)}{row}'
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)) and abs(value) < float("inf") and (isinstance(value, float) or abs(value) <= 1 << 53):
        return f'<c r="{at}"><v>{value!r}</v></c>'
    text = FORBIDDEN.sub(lambda m: f"_x{ord(m[0]):04X}_", str(value))
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def write_workbook(file, header: list[str], rows: Iterator, sheet: str, sheet_rows: int = SHEET_ROWS) -> None:
    """A workbook of as many sheets as the rows need, written as they come: sheet, sheet 2, and so on, each with the header."""
    said = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    main, links = MAIN.strip("{}"), LINKS.strip("{}")
    names: list[str] = []
    with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as z:
        rows, more = iter(rows), True
        while more:
            names.append(sheet if not names else f"{sheet} {len(names) + 1}")
            with z.open(f"xl/worksheets/sheet{len(names)}.xml", "w", force_zip64=True) as out:
                put = lambda x: out.write(x.encode())  # noqa: B023, E731
                put(f'{said}<worksheet xmlns="{main}"><sheetData><row r="1">{"".join(cell(i, 1, h) for i, h in enumerate(header))}</row>')
                n, more = 1, False
                for row in rows:
                    n += 1
                    put(f'<row r="{n}">{"".join(cell(i, n, v) for i, v in enumerate(row))}</row>')
                    if n == sheet_rows:
                        more = True
                        break
                put("</sheetData></worksheet>")
        listed = "".join(f'<sheet name={quoteattr(name)} sheetId="{i}" r:id="rId{i}"/>' for i, name in enumerate(names, 1))
        z.writestr("xl/workbook.xml", f'{said}<workbook xmlns="{main}" xmlns:r="{links}"><sheets>{listed}</sheets></workbook>')
        kind = f"{links}/worksheet"
        targets = "".join(f'<Relationship Id="rId{i}" Type="{kind}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
        package = PACKAGE.strip("{}")
        z.writestr("xl/_rels/workbook.xml.rels", f'{said}<Relationships xmlns="{package}">{targets}</Relationships>')
        z.writestr("_rels/.rels", f'{said}<Relationships xmlns="{package}"><Relationship Id="rId1" Type="{links}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        types = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{types}.worksheet+xml"/>' for i in range(1, len(names) + 1))
        z.writestr(
            "[Content_Types].xml",
            f'{said}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
            f'<Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{types}.sheet.main+xml"/>{parts}</Types>',
        )


class SheetSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sheets"

    def schema(self) -> T.StructType:
        """Names from the header of the first sheet that is read, types from all its cells."""
        files, _ = opened(self.options["path"])
        found = places(self.options)
        if not found:
            raise ValueError(f"no workbook in {self.options['path']}")
        path, sheet, begin, end = found[0]
        with files.open_input_file(path) as f:
            book = Workbook(f)
            header = next((cells for r, cells in book.rows(sheet, 0, 1)), {}) if begin else {}
            kinds: dict[int, set] = {}
            for _, cells in book.rows(sheet, begin, end):
                for i, v in cells.items():
                    if v is not None:
                        kinds.setdefault(i, set()).add(type(v))
        fields, used = [], set()
        for i in range(max([*header, *kinds], default=-1) + 1):
            name = str(header[i]) if header.get(i) not in (None, "") else "index" if i == 0 and flag(self.options, "index", False) else f"_{i}"
            while name.lower() in used:
                name += f"_{i}"
            used.add(name.lower())
            kind = {frozenset([float]): T.DoubleType(), frozenset([bool]): T.BooleanType()}.get(frozenset(kinds.get(i, ())), T.StringType())
            fields.append(T.StructField(name, kind))
        return T.StructType(fields)

    def reader(self, schema: T.StructType) -> Sheets:
        return Sheets(schema, dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        return Writer(dict(self.options), schema, overwrite)
