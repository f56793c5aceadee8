"""Workbooks (XLSX) as a Spark data source, on the standard library's zip and XML readers.

`spark.read.format("workbook")` gives a sheet as typed rows: one task a file (a sheet
is one compressed stream), rows parsed one by one and sent on in Arrow batches, so a
sheet is never held whole. Many workbooks are read in parallel through a glob or a
folder. Options: sheet (name or index from 0), header (row from 0, or "none"), table,
useColumns (names, indices, letters such as "A:C,E"), skipRows, nRows, sampleRows,
dtypes (name=type,…), strict, whitespaceAsNull, skipTail. `catalog`, `formulas`,
`merges` and `cell_errors` are the other relations of a workbook.
"""

from __future__ import annotations

import datetime
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree as ET
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..plans.parser import column_number, reference

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"

#: Built-in number formats that show dates or times (fixed values).
_DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 27, 28, 29, 30, 31, 32, 33, 34, 35, 36, 45, 46, 47, 50, 51, 52, 53, 54, 55, 56, 57, 58}

EPOCH, EPOCH_1904 = datetime.datetime(1899, 12, 30), datetime.datetime(1904, 1, 1)

TYPES = {"null": "string", "int": "bigint", "float": "double", "string": "string", "boolean": "boolean", "datetime": "timestamp_ntz", "date": "date", "duration": "interval day to second"}


@dataclass(frozen=True)
class CellError:
    code: str


class Book:
    """A workbook package: parts, sheets, shared strings and styles, each read when first asked for."""

    def __init__(self, data: bytes | str):
        self.zip = zipfile.ZipFile(io.BytesIO(data) if isinstance(data, bytes) else data)
        root = ET.fromstring(self.zip.read("xl/workbook.xml"))
        rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        self.sheets = [(s.get("name"), posixpath.normpath(posixpath.join("xl", rels[s.get(f"{_REL}id")].lstrip("/").removeprefix("xl/"))), s.get("state", "visible")) for s in root.iter(f"{_MAIN}sheet")]
        pr = root.find(f"{_MAIN}workbookPr")
        self.epoch = EPOCH_1904 if pr is not None and pr.get("date1904") in ("1", "true") else EPOCH
        self.names = [(n.get("name"), (n.text or "")) for n in root.iter(f"{_MAIN}definedName")]
        self._strings: list[str] | None = None
        self._dates: list[bool] | None = None

    @property
    def strings(self) -> list[str]:
        if self._strings is None:
            self._strings = []
            if "xl/sharedStrings.xml" in self.zip.namelist():
                with self.zip.open("xl/sharedStrings.xml") as f:
                    for _, e in ET.iterparse(f):
                        if e.tag == f"{_MAIN}si":
                            self._strings.append("".join(t.text or "" for t in e.iter(f"{_MAIN}t")))
                            e.clear()
        return self._strings

    @property
    def date_styles(self) -> list[bool]:
        if self._dates is None:
            self._dates = []
            if "xl/styles.xml" in self.zip.namelist():
                root = ET.fromstring(self.zip.read("xl/styles.xml"))
                own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iter(f"{_MAIN}numFmt")}
                bare = lambda code: re.sub(r'"[^"]*"|\\.|\[(?![hms])[^\]]*\]', "", code)
                dated = lambda i: i in _DATE_FORMATS or (i in own and bool(re.search(r"(?i)[ymdhs]", bare(own[i]))) and not re.search(r"[0#?]", bare(own[i])))
                xfs = root.find(f"{_MAIN}cellXfs")
                self._dates = [dated(int(x.get("numFmtId", "0"))) for x in (xfs if xfs is not None else [])]
        return self._dates

    def part(self, sheet: str | int) -> str:
        if isinstance(sheet, int) or str(sheet).isdigit():
            return self.sheets[int(sheet)][1]
        found = [p for n, p, _ in self.sheets if n == sheet]
        if not found:
            raise ValueError(f"no sheet named {sheet!r}")
        return found[0]

    def cells(self, sheet: str | int) -> Iterator[tuple[int, list[tuple[int, object, str | None]]]]:
        """(row from 1, [(column from 1, value, formula)]) for each row, as the stream is parsed."""
        with self.zip.open(self.part(sheet)) as f:
            yield from _Rows(self).read(f)

    def value(self, kind: str, style: int, text: str):
        """A cell's value from its type, style and text."""
        if kind == "n":
            n = float(text)
            return self.epoch + datetime.timedelta(milliseconds=round(n * 86_400_000)) if style < len(self.date_styles) and self.date_styles[style] else n
        if kind == "s":
            return self.strings[int(text)]
        if kind == "b":
            return text == "1"
        if kind == "e":
            return CellError(text)
        return datetime.datetime.fromisoformat(text) if kind == "d" else text

    def tables(self) -> list[tuple[str, str, str, list[str]]]:
        """(table, sheet, ref, columns)."""
        out = []
        for name, part, _ in self.sheets:
            rels = posixpath.join(posixpath.dirname(part), "_rels", posixpath.basename(part) + ".rels")
            if rels in self.zip.namelist():
                for r in ET.fromstring(self.zip.read(rels)):
                    if r.get("Type", "").endswith("/table"):
                        t = ET.fromstring(self.zip.read(posixpath.normpath(posixpath.join(posixpath.dirname(part), r.get("Target")))))
                        out.append((t.get("displayName") or t.get("name"), name, t.get("ref"), [c.get("name") for c in t.iter(f"{_MAIN}tableColumn")]))
        return out

    def merges(self, sheet: str | int) -> list[str]:
        with self.zip.open(self.part(sheet)) as f:
            return [e.get("ref") for _, e in ET.iterparse(f) if e.tag == f"{_MAIN}mergeCell"]


class _Rows:
    """Rows from the events of an XML stream, without building a tree."""

    def __init__(self, book: Book):
        self.book, self.done = book, []
        self.row, self.col = 0, 0
        self.cells: list = []
        self.part, self.text = None, []
        self.kind, self.style, self.raw, self.formula = "n", 0, None, None

    def read(self, f) -> Iterator[tuple[int, list]]:
        p = expat.ParserCreate(namespace_separator=" ")
        p.buffer_text = True
        p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = self.start, self.end, self.data
        while block := f.read(1 << 16):
            p.Parse(block, False)
            done, self.done = self.done, []
            yield from done
        p.Parse(b"", True)
        yield from self.done

    def start(self, tag: str, a: dict) -> None:
        tag = tag.rpartition(" ")[2]
        if tag == "c":
            ref = a.get("r")
            self.col = column_number(ref.rstrip("0123456789")) if ref else self.col + 1
            self.kind, self.style, self.raw, self.formula = a.get("t", "n"), int(a.get("s", 0)), None, None
        elif tag in ("v", "t", "f"):
            self.part, self.text = tag, []
        elif tag == "row":
            self.row, self.col, self.cells = int(a.get("r") or self.row + 1), 0, []

    def data(self, text: str) -> None:
        if self.part:
            self.text.append(text)

    def end(self, tag: str) -> None:
        tag = tag.rpartition(" ")[2]
        if tag == self.part:
            text, self.part = "".join(self.text), None
            if tag == "f":
                self.formula = text
            elif tag == "t":
                self.raw = (self.raw or "") + text
            else:
                self.raw = text
        elif tag == "c":
            value = None
            if self.raw is not None and (self.raw != "" or self.kind in ("str", "inlineStr")):
                value = self.book.value(self.kind, self.style, self.raw)
            elif self.kind == "str":
                value = ""
            if value is not None or self.formula is not None:
                self.cells.append((self.col, value, self.formula))
        elif tag == "row":
            self.done.append((self.row, self.cells))


_OFFICE, _TABLE, _TEXT = ("{urn:oasis:names:tc:opendocument:xmlns:%s:1.0}" % n for n in ("office", "table", "text"))


class OpenDocument:
    """An ODS package with the same face as `Book`; repeated rows and cells are expanded, trailing blank repeats are not."""

    def __init__(self, data: bytes | str):
        self.zip = zipfile.ZipFile(io.BytesIO(data) if isinstance(data, bytes) else data)
        with self.zip.open("content.xml") as f:
            self.sheets = [(e.get(f"{_TABLE}name"), e.get(f"{_TABLE}name"), "visible") for ev, e in ET.iterparse(f, ("start",)) if e.tag == f"{_TABLE}table"]
        self.names: list = []

    part = Book.part

    def tables(self) -> list:
        return []

    def merges(self, sheet) -> list:
        return []

    def cells(self, sheet) -> Iterator[tuple[int, list]]:
        name, inside, row = self.part(sheet), False, 0
        with self.zip.open("content.xml") as f:
            for event, e in ET.iterparse(f, ("start", "end")):
                if e.tag == f"{_TABLE}table":
                    if event == "start":
                        inside = e.get(f"{_TABLE}name") == name
                    elif inside:
                        return
                elif event == "end" and inside and e.tag == f"{_TABLE}table-row":
                    col, got = 0, []
                    for c in e:
                        times = int(c.get(f"{_TABLE}number-columns-repeated", 1))
                        v = self.value(c)
                        if v is not None:
                            got += [(col + k + 1, v, None) for k in range(times)]
                        col += times
                    times = int(e.get(f"{_TABLE}number-rows-repeated", 1))
                    for k in range(times if got else 0):
                        yield row + k + 1, got
                    row += times
                    e.clear()

    def value(self, c: ET.Element):
        kind = c.get(f"{_OFFICE}value-type")
        if kind in ("float", "percentage", "currency"):
            return float(c.get(f"{_OFFICE}value"))
        if kind == "boolean":
            return c.get(f"{_OFFICE}boolean-value") == "true"
        if kind == "date":
            d = datetime.datetime.fromisoformat(c.get(f"{_OFFICE}date-value"))
            return d
        if kind == "time":
            m = re.fullmatch(r"PT(?:(\d+)H)?(?:(\d+)M)?(?:([\d.]+)S)?", c.get(f"{_OFFICE}time-value"))
            return datetime.timedelta(hours=int(m[1] or 0), minutes=int(m[2] or 0), seconds=float(m[3] or 0))
        return "\n".join("".join(p.itertext()) for p in c.iter(f"{_TEXT}p")) if kind == "string" else None


def open_book(data: bytes | str) -> Book | OpenDocument:
    """A workbook by what it is, not by its name."""
    if is_encrypted(data):
        raise ValueError("the workbook is encrypted or of the old binary format")
    with zipfile.ZipFile(io.BytesIO(data) if isinstance(data, bytes) else data) as z:
        return OpenDocument(data) if "content.xml" in z.namelist() else Book(data)


def is_encrypted(data: bytes | str) -> bool:
    """Whether the package is a compound file, as encrypted workbooks (and those of the old binary format) are."""
    if isinstance(data, str):
        with open(data, "rb") as f:
            data = f.read(8)
    return data[:8] == bytes.fromhex("d0cf11e0a1b11ae1")


def cell_type(v) -> str | None:
    """The observed type of a cell; None for an empty one."""
    if v is None:
        return None
    return {bool: "boolean", float: "float", int: "int", datetime.datetime: "datetime", datetime.date: "date", datetime.timedelta: "duration"}.get(type(v), "string")


def resolve(seen: set[str], strict: bool = False) -> str:
    """One type for a column: the type itself, numbers widened, or text."""
    seen = seen - {"null"}
    if len(seen) <= 1:
        return next(iter(seen), "string")
    if strict:
        raise ValueError(f"mixed types {sorted(seen)}")
    if "duration" in seen:
        raise ValueError(f"durations mix with nothing: {sorted(seen)}")
    if seen <= {"int", "boolean"}:
        return "int"
    if seen <= {"int", "float", "boolean"}:
        return "float"
    return "string"


def number_text(x: float) -> str:
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else f"{x:.9f}".rstrip("0").rstrip(".")


def cast(v, kind: str):
    """A cell as `kind`, or None where it cannot be."""
    if v is None:
        return None
    try:
        if kind == "string":
            if isinstance(v, bool):
                return str(v).lower()
            if isinstance(v, float):
                return number_text(v)
            return v.code if isinstance(v, CellError) else v.strftime("%Y-%m-%d %H:%M:%S") if isinstance(v, datetime.datetime) else str(v)
        if isinstance(v, CellError):
            return None
        if kind == "float":
            return (v - EPOCH).total_seconds() / 86400 if isinstance(v, datetime.datetime) else float(v)
        if kind == "int":
            return int(float(v))
        if kind == "boolean":
            return v if isinstance(v, bool) else v != 0 if isinstance(v, (int, float)) else {"true": True, "false": False}.get(str(v).lower())
        if kind in ("datetime", "date"):
            d = v if isinstance(v, datetime.datetime) else EPOCH + datetime.timedelta(days=v) if isinstance(v, float) else datetime.datetime.fromisoformat(v)
            return d.date() if kind == "date" else d
    except (ValueError, TypeError, OverflowError):
        return None
    return v


def aliases(names: list[str]) -> list[str]:
    """Names made unique by suffixes _1, _2 …"""
    out: list[str] = []
    for n in names:
        name, k = n, 0
        while name in out:
            k += 1
            name = f"{n}_{k}"
        out.append(name)
    return out


def selected(use: str | None, names: list[str]) -> list[int]:
    """Places of the columns that `use` asks for: names, indices from 0 or letter ranges, in its order."""
    if not use:
        return list(range(len(names)))
    out: list[int] = []
    for part in (p.strip() for p in use.split(",")):
        if part in names:
            out.append(names.index(part))
        elif part.isdigit():
            out.append(int(part))
        elif m := re.fullmatch(r"([A-Za-z]{0,3}):([A-Za-z]{0,3})", part):
            a = column_number(m[1]) - 1 if m[1] else 0
            z = column_number(m[2]) if m[2] else len(names)
            if z <= a + 1 and m[1] and m[2]:
                raise ValueError(f"empty range {part}")
            out += range(a, min(z, len(names)))
        elif re.fullmatch(r"[A-Za-z]{1,3}", part) and column_number(part) <= len(names):
            out.append(column_number(part) - 1)
        else:
            raise ValueError(f"no column {part!r}")
    return out


@dataclass
class Plan:
    """What a scan reads: header row, first data row, columns with names and types."""

    names: list[str]
    columns: list[int]
    kinds: list[str]
    first: int
    last: int | None
    left: int = 1


def plan_of(book: Book, o: dict) -> tuple[Plan, str | int]:
    table, sheet = o.get("table"), o.get("sheet", "0")
    left, top, bottom, headers = 1, 1, None, None
    if table:
        name, sheet, ref, headers = next(t for t in book.tables() if t[0] == table)
        r = reference(ref)
        left, top, bottom = r.left, r.top, r.bottom
    header = o.get("header", "0")
    skip, limit = int(o.get("skiprows", 0)), int(o["nrows"]) if o.get("nrows") else None
    sample = int(o.get("samplerows", 1000)) if str(o.get("samplerows", "1000")).lower() != "all" else None
    blank = str(o.get("whitespaceasnull", "false")).lower() == "true"
    head_row = None if str(header).lower() == "none" else top + int(header)
    first = (head_row + 1 if head_row is not None else top) + skip
    names: dict[int, str] = {}
    seen: dict[int, set[str]] = {}
    width, rows = (len(headers) if headers else 0), 0
    for row, cells in book.cells(sheet):
        if bottom and row > bottom:
            break
        for col, v, _ in cells:
            at = col - left
            if at < 0 or (headers and at >= len(headers)):
                continue
            width = max(width, at + 1)
            if row == head_row and v is not None:
                names[at] = str(cast(v, "string")).replace("\0", "")
            elif row >= first and (sample is None or rows < sample) and not (blank and isinstance(v, str) and not v.strip()) and (k := cell_type(v)):
                seen.setdefault(at, set()).add(k)
        rows += row >= first
        if sample is not None and rows >= sample:
            break
    given = o["columnnames"].split(",") if o.get("columnnames") else None
    titles = aliases([(given[i] if given and i < len(given) else headers[i] if headers else names.get(i) or f"__UNNAMED__{i}") for i in range(width)])
    want = dict(p.split("=") for p in o["dtypes"].split(",")) if o.get("dtypes") else {}
    columns = selected(o.get("usecolumns"), titles)
    strict = str(o.get("strict", "false")).lower() == "true"
    kinds = [want.get(str(c), want.get(titles[c])) or resolve(seen.get(c, set()), strict) for c in columns]
    last = min(x for x in (bottom, first + limit - 1 if limit is not None else None) if x is not None) if bottom or limit is not None else None
    return Plan([titles[c] for c in columns], columns, kinds, first, last, left), sheet


class File(InputPartition):
    def __init__(self, path: str, data: bytes | None):
        self.path, self.data = path, data


class WorkbookReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType, paths: list[str]):
        self.options, self.schema, self.paths = options, schema, paths

    def partitions(self):
        return [File(p, None) for p in self.paths]

    def read(self, partition):
        book = open_book(partition.path)
        plan, sheet = plan_of(book, self.options)
        kinds = [{"bigint": "int", "double": "float", "string": "string", "boolean": "boolean", "timestamp_ntz": "datetime", "date": "date", "interval day to second": "duration"}[f.dataType.simpleString()] for f in self.schema.fields if f.name != "row_id"]
        blank = str(self.options.get("whitespaceasnull", "false")).lower() == "true"
        types = {"int": pa.int64(), "float": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "datetime": pa.timestamp("us"), "date": pa.date32(), "duration": pa.duration("us")}
        place = {c: i for i, c in enumerate(plan.columns)}

        def batch(rows: list, ids: list) -> pa.RecordBatch:
            cols = [pa.array([cast(r[i], k) for r in rows], types[k]) for i, k in enumerate(kinds)]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *cols], names=self.schema.names)

        rows, ids, at = [], [], plan.first
        for row, cells in book.cells(sheet):
            if row < plan.first or (plan.last and row > plan.last):
                continue
            while at < row:  # rows that the sheet leaves out are rows of blanks
                rows.append([None] * len(kinds))
                ids.append(at - plan.first)
                at += 1
            values: list = [None] * len(kinds)
            for col, v, _ in cells:
                i = place.get(col - plan.left)
                if i is not None and not (blank and isinstance(v, str) and not v.strip()):
                    values[i] = v
            rows.append(values)
            ids.append(row - plan.first)
            at = row + 1
            if len(rows) >= 5000:
                yield batch(rows, ids)
                rows, ids = [], []
        if rows:
            if str(self.options.get("skiptail", "false")).lower() == "true":
                while rows and all(v is None or (isinstance(v, str) and not v.strip()) for v in rows[-1]):
                    rows.pop(), ids.pop()
            yield batch(rows, ids)


class WorkbookSource(DataSource):
    """`workbook`: see the module."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def _paths(self) -> list[str]:
        import glob
        import os

        path = self.options["path"].removeprefix("file://")
        return sorted(glob.glob(os.path.join(path, "*.xls[xm]")) + glob.glob(os.path.join(path, "*.ods")) if os.path.isdir(path) else glob.glob(path))

    def schema(self) -> str:
        plan, _ = plan_of(open_book(self._paths()[0]), {k.lower(): v for k, v in self.options.items()})
        return "row_id bigint, " + ", ".join(f"`{n}` {TYPES[k]}" for n, k in zip(plan.names, plan.kinds, strict=True))

    def reader(self, schema: StructType) -> WorkbookReader:
        return WorkbookReader({k.lower(): v for k, v in self.options.items()}, schema, self._paths())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WorkbookSource)


def load_sheet(spark: SparkSession, path: str, sheet: str | int = 0, **options) -> DataFrame:
    """A sheet as a frame; options as in the module's text."""
    register(spark)
    return spark.read.format("workbook").options(sheet=str(sheet), **{k: str(v) for k, v in options.items()}).load(path)


def load_table(spark: SparkSession, path: str, table: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format("workbook").options(table=table, **{k: str(v) for k, v in options.items()}).load(path)


def views(spark: SparkSession, path: str, prefix: str = "") -> list[str]:
    """A temporary view for every sheet and table of a workbook; their names."""
    names = []
    book = open_book(path)
    for n, _, _ in book.sheets:
        load_sheet(spark, path, n).createOrReplaceTempView(f"`{prefix}{n}`")
        names.append(prefix + n)
    for t, *_ in book.tables():
        load_table(spark, path, t).createOrReplaceTempView(f"`{prefix}{t}`")
        names.append(prefix + t)
    return names


def batches(path: str, sheet: str | int = 0, size: int = 5000, top: int = 1, bottom: int | None = None, left: int = 1, right: int | None = None) -> Iterator[list[list[object]]]:
    """Rows of a window of a sheet as they stand, each cell with its own type, in lists of `size`; memory holds one list."""
    out: list[list[object]] = []
    for row, got in open_book(path).cells(sheet):
        if row < top or (bottom and row > bottom):
            continue
        width = right or max((c for c, _, _ in got), default=left - 1)
        line: list[object] = [None] * max(0, width - left + 1)
        for c, v, _ in got:
            if left <= c <= width:
                line[c - left] = v
        out.append(line)
        if len(out) == size:
            yield out
            out = []
    if out:
        yield out


def cell(path: str, sheet: str | int, row: int, column: int):
    """One cell by its 1-based place; reading stops there."""
    for r, got in open_book(path).cells(sheet):
        if r >= row:
            return next((v for c, v, _ in got if r == row and c == column), None)
    return None


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """(kind, name, sheet, detail): sheets with their visibility, tables with their ranges, defined names."""
    b = open_book(path)
    rows = [("sheet", n, n, state) for n, _, state in b.sheets] + [("table", t, s, ref) for t, s, ref, _ in b.tables()] + [("name", n, None, text) for n, text in b.names]
    return spark.createDataFrame(rows, "kind string, name string, sheet string, detail string")


def formulas(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """(row, col, formula) of a sheet."""
    return spark.createDataFrame([(r, c, f) for r, cells in open_book(path).cells(sheet) for c, _, f in cells if f is not None], "row long, col long, formula string")


def cell_errors(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """(row, col, code) of cells that hold an error."""
    return spark.createDataFrame([(r, c, v.code) for r, cells in open_book(path).cells(sheet) for c, v, _ in cells if isinstance(v, CellError)], "row long, col long, code string")


def cast_report(df: DataFrame, column: str, kind: str) -> DataFrame:
    """(row_id, detail): cells of `column` that do not become `kind` (a Spark type) and would be null."""
    from pyspark.sql import functions as F

    return df.where(F.col(column).isNotNull() & F.col(column).try_cast(kind).isNull()).select("row_id", F.col(column).cast("string").alias("detail"))
