"""Writing workbooks: rows stream from the executors through the driver into one package, sheet by sheet.

A workbook is one file, so its rows pass one process by nature; they are fetched a
partition at a time and written as they come. For more rows than a sheet holds, or
for parallel output, write one workbook per partition (`write_parts`).
"""

from __future__ import annotations

import datetime
import os
import tempfile
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

from .workbook import EPOCH

MOST_ROWS = 1_048_576

_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_STYLES = f'{_HEAD}<styleSheet {_NS}><numFmts count="1"><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd hh:mm:ss"/></numFmts><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3"><xf numFmtId="0"/><xf numFmtId="14" applyNumberFormat="1"/><xf numFmtId="164" applyNumberFormat="1"/></cellXfs></styleSheet>'


def letters(n: int) -> str:
    out = ""
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


def cell(ref: str, v) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, float)):
        return f'<c r="{ref}"><v>{v!r}</v></c>' if v == v and abs(v) != float("inf") else f'<c r="{ref}" t="e"><v>#NUM!</v></c>'
    if isinstance(v, datetime.datetime):
        return f'<c r="{ref}" s="2"><v>{(v.replace(tzinfo=None) - EPOCH).total_seconds() / 86400!r}</v></c>'
    if isinstance(v, datetime.date):
        return f'<c r="{ref}" s="1"><v>{(v - EPOCH.date()).days}</v></c>'
    text = str(v)
    if text.startswith("=") and len(text) > 1:
        return f'<c r="{ref}"><f>{escape(text[1:])}</f></c>'
    clean = "".join(c for c in text if c >= " " or c in "\t\n\r")
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(clean)}</t></is></c>'


def package(path: str, sheets: list[tuple[str, list[str], object]]) -> None:
    """(name, header, iterable of rows) sheets into a package at `path`, by a file beside it that is renamed at the end."""
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    fd, beside = tempfile.mkstemp(dir=os.path.dirname(path) or ".", suffix=".part")
    os.close(fd)
    try:
        with zipfile.ZipFile(beside, "w", zipfile.ZIP_DEFLATED) as z:
            parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
            z.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/>{parts}</Types>')
            z.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{_R}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            z.writestr("xl/workbook.xml", f'{_HEAD}<workbook {_NS} xmlns:r="{_R}"><sheets>' + "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, (n, _, _) in enumerate(sheets, 1)) + "</sheets></workbook>")
            z.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{_R}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + f'<Relationship Id="rIdS" Type="{_R}/styles" Target="styles.xml"/></Relationships>')
            z.writestr("xl/styles.xml", _STYLES)
            for i, (_, header, rows) in enumerate(sheets, 1):
                with z.open(f"xl/worksheets/sheet{i}.xml", "w", force_zip64=True) as out:
                    out.write(f"{_HEAD}<worksheet {_NS}><sheetData>".encode())
                    r = 0
                    for values in ([header] if header else []):
                        r += 1
                        out.write(f'<row r="{r}">{"".join(cell(f"{letters(k)}{r}", v) for k, v in enumerate(values, 1))}</row>'.encode())
                    for values in rows:
                        r += 1
                        if r > MOST_ROWS:
                            raise ValueError(f"a sheet holds {MOST_ROWS} rows; use write_parts")
                        out.write(f'<row r="{r}">{"".join(cell(f"{letters(k)}{r}", v) for k, v in enumerate(values, 1))}</row>'.encode())
                    out.write(b"</sheetData></worksheet>")
        os.replace(beside, path)
    except BaseException:
        os.unlink(beside)
        raise


def write(path: str, sheets: dict[str, DataFrame], header: bool = True) -> None:
    """Frames as the sheets of one workbook; order rows beforehand where order matters."""
    package(path, [(n, df.columns if header else [], df.toLocalIterator(prefetchPartitions=True)) for n, df in sheets.items()])


def write_bytes(sheets: dict[str, DataFrame], header: bool = True) -> bytes:
    with tempfile.TemporaryDirectory() as d:
        write(f"{d}/book.xlsx", sheets, header)
        with open(f"{d}/book.xlsx", "rb") as f:
            return f.read()


def write_parts(df: DataFrame, folder: str, sheet: str = "Sheet1", rows_per_book: int = 500_000) -> DataFrame:
    """One workbook for each bounded run of rows of a partition, written by the executors; (path, rows) of each. `folder` must be shared."""
    names = df.columns

    def save(batches):
        import itertools

        from pyspark import TaskContext

        rows = (r for b in batches for r in b.to_pylist())
        os.makedirs(folder, exist_ok=True)
        for k in itertools.count():
            part = list(itertools.islice(rows, rows_per_book))
            if not part:
                return
            path = f"{folder}/part-{TaskContext.get().partitionId():05d}-{k:03d}.xlsx"
            package(path, [(sheet, names, ([r[n] for n in names] for r in part))])
            import pyarrow as pa

            yield pa.RecordBatch.from_pydict({"path": [path], "rows": [len(part)]})

    return df.mapInArrow(save, "path string, rows long")
