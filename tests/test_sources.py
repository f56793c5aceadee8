import datetime
import zipfile

import pytest

from tessella.sources import delimited, workbook, workbook_writer
from tessella.streaming import windows


@pytest.fixture(scope="module")
def book(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("books") / "book.xlsx")
    when = datetime.datetime(2024, 2, 29, 12, 30)
    rows = [(1, 2.5, "a<b", True, when.date(), when), (2, None, "", False, None, None), (3, -1.0, "  ", None, when.date(), when)]
    workbook_writer.package(path, [("Data", ["id", "x", "s", "flag", "day", "at"], rows), ("Mixed", ["m", "m", None], [(1, "t", 3), ("=A2+1", True, None)])])
    workbook.register(spark)
    return path


def test_round_trip(spark, book):
    df = spark.read.format("workbook").option("sheet", "Data").load(book).orderBy("row_id")
    assert df.columns == ["row_id", "id", "x", "s", "flag", "day", "at"]
    first = df.first()
    assert (first["id"], first["x"], first["s"], first["flag"]) == (1.0, 2.5, "a<b", True)
    assert first["at"] == datetime.datetime(2024, 2, 29, 12, 30) and first["day"] == datetime.datetime(2024, 2, 29)
    assert df.count() == 3 and df.where("x IS NULL").count() == 1


def test_options(spark, book):
    read = lambda **o: spark.read.format("workbook").options(sheet="Data", **o).load(book)
    assert read(useColumns="A:B").columns == ["row_id", "id", "x"]
    assert read(useColumns="x,id").columns == ["row_id", "x", "id"]
    assert read(skipRows=1, nRows=1).collect()[0]["id"] == 2.0
    assert read(header="none").columns[1] == "__UNNAMED__0" and read(header="none").count() == 4
    assert read(dtypes="id=string").first()["id"] == "1"
    assert read(whitespaceAsNull="true").where("s IS NULL").count() == 2


def test_duplicate_and_unnamed_headers(spark, book):
    df = spark.read.format("workbook").option("sheet", "1").load(book)
    assert df.columns == ["row_id", "m", "m_1", "__UNNAMED__2"]
    assert dict(df.dtypes)["m_1"] == "string"


def test_metadata(spark, book):
    assert [r["name"] for r in workbook.catalog(spark, book).collect()] == ["Data", "Mixed"]
    assert workbook.formulas(spark, book, "Mixed").collect() == [(3, 1, "A2+1")]


@pytest.mark.parametrize(("seen", "want"), [({"int"}, "int"), ({"int", "boolean"}, "int"), ({"int", "float"}, "float"), ({"string", "float"}, "string"), (set(), "string")])
def test_resolve(seen, want):
    assert workbook.resolve(seen) == want


def test_resolve_refuses():
    with pytest.raises(ValueError):
        workbook.resolve({"duration", "int"})
    with pytest.raises(ValueError):
        workbook.resolve({"int", "string"}, strict=True)


def test_shared_strings_tables_and_errors(spark, tmp_path):
    path = str(tmp_path / "t.xlsx")
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets><definedNames><definedName name="n">S!$A$1</definedName></definedNames></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>k</t></si><si><r><t>he</t></r><r><t>llo</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="2"><c r="B2" t="s"><v>0</v></c><c r="C2" t="str"><v>v</v></c></row><row r="3"><c r="B3" t="s"><v>1</v></c><c r="C3" t="e"><v>#N/A</v></c></row></sheetData><mergeCells><mergeCell ref="B5:C6"/></mergeCells></worksheet>')
        z.writestr("xl/worksheets/_rels/sheet1.xml.rels", f'<Relationships><Relationship Id="x" Type="{rel}/table" Target="../tables/table1.xml"/></Relationships>')
        z.writestr("xl/tables/table1.xml", f'<table {ns} displayName="T" ref="B2:C3"><tableColumns><tableColumn name="k"/><tableColumn name="v"/></tableColumns></table>')
    workbook.register(spark)
    row = spark.read.format("workbook").option("table", "T").load(path).first()
    assert (row["k"], row["v"]) == ("hello", "#N/A")
    assert workbook.cell_errors(spark, path).collect() == [(3, 3, "#N/A")]
    assert workbook.Book(path).merges(0) == ["B5:C6"]


def test_write_parts(spark, tmp_path):
    out = workbook_writer.write_parts(spark.range(25), str(tmp_path / "parts"), rows_per_book=10).collect()
    assert sum(r["rows"] for r in out) == 25
    workbook.register(spark)
    assert spark.read.format("workbook").load(str(tmp_path / "parts")).count() == 25


def test_csv_rules(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('id,code,n,e\r\n1,007,1.5,""\r\n2,123,2,\r\n')
    df = delimited.read_csv(spark, str(p), infer=True)
    assert dict(df.dtypes) == {"id": "bigint", "code": "string", "n": "double", "e": "string"}
    assert [r["e"] for r in df.orderBy("id").collect()] == ["", None]
    delimited.write_csv(df.coalesce(1), str(tmp_path / "out"))
    text = b"".join(f.read_bytes() for f in (tmp_path / "out").glob("part-*"))
    assert text.count(b"\r\n") == 3


def test_json_shapes(spark, tmp_path):
    p = tmp_path / "a.ndjson"
    p.write_text('{"a": 1, "b": {"c": 2}}\n{"a": 2, "z": "x"}\n')
    df = delimited.read_json(spark, str(p))
    assert dict(df.dtypes)["a"] == "bigint" and df.where("b IS NOT NULL").first()["b"] == '{"c":"2"}'
    big = tmp_path / "b.ndjson"
    big.write_text('{"i": 9007199254740993}\n')
    assert delimited.read_json(spark, str(big)).first()["i"] == "9007199254740993"
    cols = tmp_path / "c.json"
    cols.write_text('{"x": [1, 2], "y": ["p", null]}')
    assert sorted((r["x"], r["y"]) for r in delimited.read_json(spark, str(cols), "columns").collect()) == [(1, "p"), (2, None)]
    for shape in ("records", "columns", "ndjson"):
        delimited.write_json(spark.createDataFrame([(1, None), (2, "q")], "x long, y string"), str(tmp_path / shape), shape)
        text = "".join(f.read_text() for f in (tmp_path / shape).glob("part-*"))
        assert "null" in text and '"q"' in text


def test_stream_equals_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    src = str(tmp_path / "in")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(src)
    table = spark.read.parquet(src)
    batch = sorted(windows.tumbling(table, "ts", "1 day", ["event_type"], F.count(F.lit(1)).alias("n")).collect())
    stream = spark.readStream.schema(table.schema).parquet(src).withColumn("ts", F.col("ts").cast("timestamp"))
    got = []
    q = windows.tumbling(stream, "ts", "1 day", ["event_type"], F.count(F.lit(1)).alias("n")).writeStream.outputMode("complete").foreachBatch(lambda d, i: got.extend(d.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((str(r["window_start"]), r["event_type"], r["n"]) for r in got) == sorted((str(r["window_start"]), r["event_type"], r["n"]) for r in batch)


def test_open_document(spark, tmp_path):
    ns = " ".join(f'xmlns:{n}="urn:oasis:names:tc:opendocument:xmlns:{n}:1.0"' for n in ("office", "table", "text"))
    row = '<table:table-row><table:table-cell office:value-type="string"><text:p>{}</text:p></table:table-cell><table:table-cell office:value-type="{}" {}/></table:table-row>'
    body = row.format("a", "float", 'office:value="1.5"') + row.format("b", "float", 'office:value="2"') + '<table:table-row table:number-rows-repeated="1000"><table:table-cell table:number-columns-repeated="9"/></table:table-row>'
    head = '<table:table-row><table:table-cell office:value-type="string"><text:p>k</text:p></table:table-cell><table:table-cell office:value-type="string"><text:p>v</text:p></table:table-cell></table:table-row>'
    path = str(tmp_path / "a.ods")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("content.xml", f'<office:document-content {ns}><office:body><office:spreadsheet><table:table table:name="T">{head}{body}</table:table></office:spreadsheet></office:body></office:document-content>')
    assert sorted((r["k"], r["v"]) for r in workbook.load_sheet(spark, path, "T").collect()) == [("a", 1.5), ("b", 2.0)]
    assert workbook.cell(path, "T", 3, 2) == 2.0 and workbook.cell(path, 0, 99, 1) is None


def test_windows_of_rows_and_views(spark, book):
    lines = [line for part in workbook.batches(book, "Data", size=2, top=2, left=2, right=3) for line in part]
    assert lines == [[2.5, "a<b"], [None, ""], [-1.0, "  "]]
    assert workbook.cell(book, "Data", 2, 4) is True
    assert workbook.views(spark, book, "wb_") == ["wb_Data", "wb_Mixed"]
    assert spark.sql("SELECT count(*) AS n FROM `wb_Data`").first()["n"] == 3
    assert not workbook.is_encrypted(book) and workbook.is_encrypted(bytes.fromhex("d0cf11e0a1b11ae1") + b"x")
