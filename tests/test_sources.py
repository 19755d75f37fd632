"""Readers on files built in memory, sinks, streams."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import files as S
from corpusloom.sources import pdf as R
from corpusloom.streaming import cards


def archive(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOCX = archive({
    "word/document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>第一段</w:t></w:r><w:r><w:delText>删</w:delText></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>甲</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>乙</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>",
    "docProps/core.xml": '<c:p xmlns:c="c" xmlns:dc="d"><dc:title>题名</dc:title></c:p>',
})
XLSX = archive({
    "xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="表" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
    "xl/sharedStrings.xml": "<sst><si><t>名</t></si></sst>",
    "xl/styles.xml": '<styleSheet><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
    "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>2.5</v></c></row><row r="2"><c r="B2" s="1"><v>45000</v></c><c r="C2" t="b"><v>1</v></c><c r="D2" t="inlineStr"><is><t>行内</t></is></c></row></sheetData></worksheet>',
})
PPTX = archive({f"ppt/slides/slide{n}.xml": f'<p:sld xmlns:p="p" xmlns:a="a"><a:p><a:r><a:t>页{n}</a:t></a:r></a:p></p:sld>' for n in (1, 2, 10)})
PDF = b"%PDF-1.4\n1 0 obj <</Length 40>>\nstream\nBT (Hello) Tj T* [(Wor) 5 (ld)] TJ ET\nendstream\nendobj"


def test_readers():
    assert S.read_docx(DOCX) == ("题名", ["第一段", "甲\t乙"])
    assert list(S.read_xlsx(XLSX)) == [("表", 1, 0, "text", "名"), ("表", 1, 2, "number", "2.5"), ("表", 2, 1, "date", "45000"), ("表", 2, 2, "bool", "TRUE"), ("表", 2, 3, "text", "行内")]
    assert S.sheet_text(list(S.read_xlsx(XLSX))) == "## 表\n名\t\t2.5\t\n\t45000\tTRUE\t行内"
    assert [n for n, _ in S.read_pptx(PPTX)] == [1, 2, 10]
    assert S.read_pdf(PDF) == ("Hello\nWorld", False)
    assert R.code_map(b"1 beginbfrange <01> <03> [<0041> <0042> <0043>] endbfrange") == (1, {1: "A", 2: "B", 3: "C"})
    assert R.decode_stream(b"/Filter [/AHx]", b"48 65>") == b"He" and R.decode_stream(b"/Filter /A85", b"87cURDZ~>") == b"Hello" and R.decode_stream(b"/Filter /LZWDecode", b"") is None
    with pytest.raises(ValueError, match="scanned"):
        S.read_pdf(b"%PDF-1.4\n1 0 obj <</Subtype /Image>> endobj")
    with pytest.raises(ValueError, match="no PDF"):
        S.read_pdf(b"x")
    assert S.decode_bytes("中文".encode("gbk")) == "中文" and S.decode_bytes("﻿a\r\nb".encode()) == "a\nb" and S.decode_bytes("é".encode("utf-16")) == "é"
    assert S.looks_binary(b"a\0b") and not S.looks_binary(b"") and S.column_index("AB3") == 27


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "node_modules").mkdir()
    for name, body in {"a.docx": DOCX, "b.xlsx": XLSX, "c.doc": b"x", "d.md": "正文".encode(), "e.html": b"<p>x</p>", "f.bin": b"\0", "sub/g.pptx": b"broken", "node_modules/h.md": b"no"}.items():
        (tmp_path / name).write_bytes(body)
    listed = S.list_files(spark, str(tmp_path))
    assert [r.rel for r in listed.select("rel").collect()] == ["a.docx", "b.xlsx", "c.doc", "d.md", "e.html", "sub/g.pptx"]
    rows = {r.rel: r for r in S.extract_text(listed, 10).collect()}
    assert rows["a.docx"].text == "第一段\n甲\t乙" and rows["a.docx"].title == "题名" and rows["e.html"].text == "x"
    assert not rows["sub/g.pptx"].ok and rows["c.doc"].note == "legacy_office" and rows["b.xlsx"].truncated
    row = S.ingest_summary(S.extract_text(listed)).first()
    assert (row.files, row.ok, row.failed) == (6, 4, 2)
    assert S.xlsx_cells(listed.filter("kind = 'xlsx'")).count() == 5
    assert [r.rel for r in S.list_files(spark, str(tmp_path), ["md"]).collect()] == ["d.md"]


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert S.write_new(a, path, "k").count() == 0
    assert [r.k for r in S.write_new(spark.createDataFrame([(2, "z"), (3, "c")], "k int, v string"), path, "k").collect()] == [2]
    assert {tuple(r) for r in spark.read.parquet(path).collect()} == {(1, "a"), (2, "b"), (3, "c")}
    S.append_log(a, path)
    assert spark.read.parquet(path).count() == 5
    S.write_report(a, path)
    assert spark.read.parquet(path).count() == 2
    parts = [spark.createDataFrame([("f", n, "t"), ("g" + n, n, "t")], "file string, label string, text string") for n in ("1", "2")]
    got = S.assemble_corpus(*parts, exclude=spark.createDataFrame([("g2",)], "file string"))
    assert {(r.file, r.label) for r in got.collect()} == {("f", "1"), ("g1", "1")}


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    rows = spark.createDataFrame([("a", "x", 1), ("a", "x", 2), ("a", "y", 3), ("b", None, 4), (None, "x", 5), ("b", "x", 6)], "k string, state string, seq long")
    rows.coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema(rows.schema).parquet(str(source))
    q = cards.changed_only(stream, "k", "state").writeStream.format("memory").queryName("changes").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("changes").collect())) == [("a", "x"), ("a", "y"), ("b", "x")]
    facts = spark.createDataFrame([("alpha.a", "查重阈值 0.3")], "key string, value string")
    messages = spark.createDataFrame([("agent", 1, "请帮我调整查重阈值")], "agent_id string, message_id int, text string")
    assert {r.key for r in cards.recall_stream(messages, facts).collect()} == {"alpha.a"}
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:10:00", "a")], "t string, k string").withColumn("t", F.to_timestamp("t"))
    assert sorted(r.n for r in cards.windowed_counts(events, "t", "k").collect()) == [1, 2]


def test_state_is_forgotten(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x", 1), ("a", "x", 2)], "k string, state string, seq long")
    source = tmp_path / "in"
    rows.coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema(rows.schema).parquet(str(source))
    q = cards.changed_only(stream, "k", "state", ["seq"], 1).writeStream.format("memory").queryName("forgotten").outputMode("append").trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            if spark.table("forgotten").count():
                break
            q.awaitTermination(1)
        q.awaitTermination(3)  # the state ends meanwhile
        rows.coalesce(1).write.mode("append").parquet(str(source))
        for _ in range(60):
            if spark.table("forgotten").count() > 1:
                break
            q.awaitTermination(1)
    finally:
        q.stop()
    assert [tuple(r) for r in spark.table("forgotten").collect()] == [("a", "x", 1), ("a", "x", 1)]
