"""Queries of the readers and sinks: small files are built, written to the shared folder, and read from there."""

from __future__ import annotations

import io
import zipfile
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.plans import sql as Q
from corpusloom.plans.catalog import query
from corpusloom.functions import text as T
from corpusloom.operators import profile as P
from corpusloom.runtime import materialize, new_path, table, write_bytes
from corpusloom.sources import bibliography as B
from corpusloom.sources import files as S


def archive(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOCX = archive({
    "word/document.xml": f"<w:document {_W}><w:body><w:p><w:r><w:t>第一段</w:t></w:r><w:r><w:delText>删</w:delText></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>甲</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>乙</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>",
    "docProps/core.xml": '<c:p xmlns:c="c" xmlns:dc="d"><dc:title>题名</dc:title></c:p>',
})
XLSX = archive({
    "xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="表" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
    "xl/sharedStrings.xml": "<sst><si><t>名</t></si></sst>",
    "xl/styles.xml": '<styleSheet><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
    "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>2.5</v></c></row><row r="2"><c r="B2" s="1"><v>45000</v></c><c r="AA2" t="b"><v>1</v></c></row></sheetData></worksheet>',
})
PPTX = archive({f"ppt/slides/slide{n}.xml": f'<p:sld xmlns:p="p" xmlns:a="a"><a:p><a:r><a:t>{"" if n == 1 else f"页{n}"}</a:t></a:r></a:p></p:sld>' for n in (1, 10, 2)})
_MAP = b"1 beginbfchar <0001> <4E2D> endbfchar 1 beginbfrange <0002> <0003> <6587> endbfrange"
_SHOW = zlib.compress(b"BT /F1 12 Tf <00010002> Tj 0 -14 Td /F2 12 Tf [(Wor) 5 (l\\144)] TJ ET")
PDF = b"%%PDF-1.4\n1 0 obj <</Font <</F1 2 0 R /F2 5 0 R>>>> endobj\n2 0 obj <</Type /Font /ToUnicode 3 0 R>> endobj\n3 0 obj <</Length %d>>\nstream\n%s\nendstream endobj\n4 0 obj <</Filter /FlateDecode>>\nstream\n%s\nendstream endobj\n5 0 obj <</Type /Font>> endobj" % (len(_MAP), _MAP, _SHOW)
FILES: dict[str, bytes] = {
    "a.docx": DOCX,
    "b.xlsx": XLSX,
    "c.doc": b"x",
    "d.md": "正文".encode(),
    "e.html": "<html><script>var p = '</p>'</script><!-- no --><p>甲&mdash;乙&#8212;&amp;lt;</p><table><tr><td>1</td><td>2</td></tr></table>x<br>y</html>".encode(),
    "f.txt": "国标".encode("gbk"),
    "g.csv": "a,b\r\n1,2".encode("utf-16"),
    "h.txt": b"a\0b",
    "i.pdf": PDF,
    "j.pdf": b"%PDF-1.4\n1 0 obj <</Encrypt 2 0 R>> endobj",
    "k.pptx": PPTX,
    "l.xyz": b"x",
    "sub/m.pptx": b"broken",
    "sub/n.py": b"x = 1\n",
    "node_modules/o.md": b"no",
}
READ = [
    ("a.docx", "docx", True, "第一段\n甲\t乙", "题名", None, False),
    ("b.xlsx", "xlsx", True, "## 表\n名\t\t2.5" + "\t" * 24 + "\n\t45000" + "\t" * 25 + "TRUE", None, None, False),
    ("c.doc", "unsupported", False, "", None, "legacy_office", False),
    ("d.md", "text", True, "正文", None, None, False),
    ("e.html", "text", True, "甲—乙—&lt;\n1\t2\n\nx\ny", None, None, False),
    ("f.txt", "text", True, "国标", None, None, False),
    ("g.csv", "text", True, "a,b\n1,2", None, None, False),
    ("h.txt", "text", False, "", None, "binary", False),
    ("i.pdf", "pdf", True, "中文\nWorld", None, None, False),
    ("j.pdf", "pdf", False, "", None, "ValueError: encrypted", False),
    ("k.pptx", "pptx", True, "## 1\n\n\n## 2\n页2\n\n## 10\n页10", None, None, False),
    ("sub/m.pptx", "pptx", False, "", None, "BadZipFile: File is not a zip file", False),
    ("sub/n.py", "code", True, "x = 1\n", None, None, False),
]


def _folder(spark: SparkSession) -> str:
    root = new_path(spark, "files")
    for name, body in FILES.items():
        write_bytes(spark, f"{root}/{name}", body)
    return root


@query(f"SELECT rel, kind FROM {Q.values([(r[0], r[1]) for r in READ], 'rel, kind')}")
def list_files(spark: SparkSession, d: str) -> DataFrame:
    return S.list_files(spark, _folder(spark), most=None).select("rel", "kind")


@query(f"SELECT * FROM {Q.values(READ, 'rel, kind, ok, text, title, note, doubtful')}")
def read_files(spark: SparkSession, d: str) -> DataFrame:
    """Text of every kind of file: office formats, PDF with a code map, HTML, GBK, UTF-16, and those that cannot be read."""
    return S.extract_text(S.list_files(spark, _folder(spark), most=None), None).select("rel", "kind", "ok", "text", "title", "note", "doubtful")


@query("SELECT 13 AS files, 9 AS ok, 4 AS failed, 0 AS truncated, 0 AS doubtful")
def ingest_summary(spark: SparkSession, d: str) -> DataFrame:
    return S.ingest_summary(S.extract_text(S.list_files(spark, _folder(spark), most=None), None))


@query("SELECT * FROM (VALUES ('b.xlsx', '表', 1, 0, 'text', '名'), ('b.xlsx', '表', 1, 2, 'number', '2.5'), ('b.xlsx', '表', 2, 1, 'date', '45000'), ('b.xlsx', '表', 2, 26, 'bool', 'TRUE')) v(rel, sheet, \"row\", col, kind, value)")
def sheet_cells(spark: SparkSession, d: str) -> DataFrame:
    files = spark.createDataFrame([("b.xlsx", XLSX), ("x.xlsx", b"broken")], "rel string, content binary")
    return S.xlsx_cells(files)


@query("SELECT * FROM (VALUES ('l.xyz', 'unknown_format'), ('c.doc', 'legacy_office')) v(rel, reason)")
def unsupported_files(spark: SparkSession, d: str) -> DataFrame:
    names = spark.createDataFrame([(n,) for n in FILES], "rel string")
    return names.select("rel", P.unsupported_reason(F.col("rel")).alias("reason")).filter("reason IS NOT NULL")


@query("SELECT * FROM (VALUES ('d.md', 'd', '正文'), ('f.txt', 'own', '改写'), ('g.csv', 'g', 'a,b' || chr(10) || '1,2')) v(file, label, text)")
def corpus_assembly(spark: SparkSession, d: str) -> DataFrame:
    """A folder scan after an explicit list: each file once, the list first, excluded files and unreadable ones left out."""
    read, skipped = S.corpus_files(spark, _folder(spark))
    listed = spark.createDataFrame([("f.txt", "own", "改写"), ("z.md", "z", "出")], "file string, label string, text string")
    return S.assemble_corpus(listed, read, exclude=spark.createDataFrame([("z.md",)], "file string"))


@query("SELECT 'h.txt' AS file, 'binary' AS note")
def corpus_skipped(spark: SparkSession, d: str) -> DataFrame:
    return S.corpus_files(spark, _folder(spark))[1]


@query("SELECT doc_id, text FROM documents")
def report_overwrite(spark: SparkSession, d: str) -> DataFrame:
    """The last written report is the one that is read."""
    path = new_path(spark, "report")
    docs = table(spark, d, "documents").select("doc_id", "text")
    S.write_report(docs.filter("text IS NULL"), path)
    S.write_report(docs, path)
    return spark.read.parquet(path)


@query("SELECT doc_id, text FROM documents WHERE lower(trim(source)) = 'chapter'")
def report_backup(spark: SparkSession, d: str) -> DataFrame:
    """What an overwritten report held is kept beside it."""
    path = new_path(spark, "report")
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    S.write_report(docs.filter(F.lower(F.trim("source")) == "chapter").drop("source"), path)
    S.write_report(docs.drop("source"), path, keep_backup=True)
    return spark.read.parquet(f"{path}.bak")


@query("SELECT workspace, min(risk_id) AS risk_id, count(*) > 0 AS kept FROM risk_items WHERE risk_level = 'high' GROUP BY workspace UNION ALL SELECT workspace, min(risk_id), false FROM risk_items WHERE workspace NOT IN (SELECT workspace FROM risk_items WHERE risk_level = 'high') GROUP BY workspace")
def write_once(spark: SparkSession, d: str) -> DataFrame:
    """A second write adds only keys that are not there yet."""
    path = new_path(spark, "once")
    first = lambda df, kept: df.groupBy("workspace").agg(F.min("risk_id").alias("risk_id"), F.lit(kept).alias("kept"))
    risks = table(spark, d, "risk_items")
    S.write_new(first(risks.filter("risk_level = 'high'"), True), path, "workspace")
    S.write_new(first(risks, False), path, "workspace")
    return spark.read.parquet(path)


@query("SELECT risk_id, risk_level FROM risk_items UNION ALL SELECT risk_id, risk_level FROM risk_items WHERE risk_level = 'low'")
def log_append(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "log")
    risks = table(spark, d, "risk_items").select("risk_id", "risk_level")
    S.append_log(risks, path)
    S.append_log(risks.filter("risk_level = 'low'"), path)
    return spark.read.parquet(path)


_ATOM = "<feed><entry><id>http://arxiv.org/abs/2401.00001v2</id><title>A &amp; B</title><summary>Short\n text</summary><name>Ann Lee</name><name>Bo Li</name><published>2024-01-02T00:00:00Z</published></entry><entry><id>x</id><title></title></entry></feed>"


@query("SELECT 'A & B' AS title, 'Short text' AS abstract, 'Ann Lee; Bo Li' AS authors, '2401.00001' AS arxiv_id, 2024 AS pub_year")
def atom_entries(spark: SparkSession, d: str) -> DataFrame:
    feed = spark.createDataFrame([(_ATOM,)], "text string")
    return B.atom_entries(feed).select("title", "abstract", F.array_join("authors", "; ").alias("authors"), "arxiv_id", "pub_year")


_ANSWERS = {
    "scholar": '{"data": [{"title": "One", "authors": [{"name": "Ann Lee"}], "year": 2020, "venue": "Journal of X", "url": "u", "citationCount": 3, "externalIds": {"DOI": "10.1/a"}}]}',
    "crossref": '{"message": {"items": [{"DOI": "10.1/b", "title": ["Two"], "author": [{"given": "Bo", "family": "Li"}], "issued": {"date-parts": [[2019, 3]]}, "container-title": ["Y"], "type": "book", "URL": "v"}, {"title": ["no DOI"]}]}}',
    "dblp": '{"result": {"hits": {"hit": {"info": {"title": "Three.", "authors": {"author": [{"text": "Cy Wu"}, {"text": "0001"}]}, "year": "2018", "venue": "CoRR", "type": "Informal Publications", "ee": "w"}}}}}',
}


@query("SELECT * FROM (VALUES ('One', 'Ann Lee', 2020, 'article', 'semantic-scholar'), ('Two', 'Bo Li', 2019, 'book', 'crossref'), ('Three.', 'Cy Wu', 2018, 'misc', 'dblp')) v(title, authors, pub_year, lit_type, lit_source)")
def service_answers(spark: SparkSession, d: str) -> DataFrame:
    """Recorded answers of three services as one table."""
    body = lambda name: spark.createDataFrame([(_ANSWERS[name],)], "body string")
    every = B.scholar_records(body("scholar")).unionByName(B.crossref_records(body("crossref"))).unionByName(B.dblp_records(body("dblp")))
    return every.select("title", F.array_join("authors", "; ").alias("authors"), "pub_year", "lit_type", "lit_source")


@query("SELECT rec_id FROM lit_records WHERE pub_year IS NULL OR pub_year >= 2015")
def year_floor(spark: SparkSession, d: str) -> DataFrame:
    from corpusloom.operators import literature as L

    return L.since(table(spark, d, "lit_records"), 2015).select("rec_id")


_BIB = "@article{lee2020,\n  title = {One},\n  doi = {10.1/A}\n}\n@book{li2019two,\n  title = {Two, a Book},\n  year = \"2019\"\n}\n"


@query("SELECT * FROM (VALUES (1, 'lee2020'), (2, 'li2019two')) v(number, cite_key)")
def bib_keys(spark: SparkSession, d: str) -> DataFrame:
    return B.bib_keys(spark.createDataFrame([(1, _BIB)], "id int, text string"), "id").select("number", "cite_key")


@query("SELECT 'book' AS kind, 'Two, a Book' AS title, '2019' AS pub_year")
def bib_entry(spark: SparkSession, d: str) -> DataFrame:
    rows = B.bib_entry(spark.createDataFrame([(1, _BIB)], "id int, text string"), "id", "li2019two")
    return rows.select("kind", F.element_at("fields", "title").alias("title"), F.element_at("fields", "year").alias("pub_year"))


@query("SELECT 1 AS version, 'g2' AS stage")
def embedded_state(spark: SparkSession, d: str) -> DataFrame:
    """A JSON block in a Markdown comment; a text without it gives no row."""
    docs = spark.createDataFrame([(1, '# 台账\n<!-- thesis:state\n{"version": 1, "stage": "g2"}\n-->\n'), (2, "none")], "id int, text string")
    return B.embedded_state(docs, "thesis:state", "version int, stage string").select("state.version", "state.stage")


@query("SELECT 2 AS version, 'a' AS key")
def state_file(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "state")
    write_bytes(spark, f"{path}/state.json", b'{"version": 2,\n "entries": [{"key": "a"}]}')
    return B.read_state(spark, path, "version int, entries array<struct<key: string>>").select("version", F.get("entries", F.lit(0))["key"].alias("key"))


@query("SELECT item_id, text FROM eval_items")
def html_text(spark: SparkSession, d: str) -> DataFrame:
    """Texts set as HTML with references and tags come back as they were."""
    items = table(spark, d, "eval_items").select("item_id", "text")
    escaped = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("\n"), F.lit("<br/>"))
    page = F.concat(F.lit("<html><style>p {}</style><body><div>"), escaped, F.lit("</div><script>1 < 2</script></body></html>"))
    return materialize(items.select("item_id", T.html_to_text(page).alias("text")), "html")
