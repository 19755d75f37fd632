"""File inputs: enumeration, byte decoding, office documents, spreadsheets, slides, PDF text.

Files come from Spark's binary reader, so listing and reading are distributed; formats without a reader are parsed per
Arrow batch. A file that cannot be read becomes a row with ``ok`` false and a reason, never an exception.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from typing import NamedTuple
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import profile as P
from corpusloom.runtime import materialize, move, remove
from corpusloom.sources.pdf import read_pdf

MAX_DEPTH, MAX_FILES, MAX_BYTES, MAX_CHARS = 6, 200, 32 << 20, 60_000
MAX_ENTRIES, MAX_ROWS, MAX_SLIDES = 4096, 5000, 500


def list_files(spark: SparkSession, root: str, extensions: list[str] | None = None, most: int | None = MAX_FILES, depth: int = MAX_DEPTH) -> DataFrame:
    """``(path, rel, kind, length, content)`` of the files below ``root``, at most ``depth`` folders down, by path.

    Folders of build output and version control are skipped; legacy office files are kept, they fail later with a
    reason; empty files have no row (the reader leaves them out); other unreadable kinds are left out unless asked for by extension. ``most`` keeps the first files by path;
    None keeps all.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), "^" + re.escape(root.removeprefix("file://").rstrip("/")) + "/+", "")
    rows = files.select("path", rel.alias("rel"), P.file_kind(F.col("path")).alias("kind"), "length", "content")
    parts = F.split("rel", "/")
    rows = rows.filter((F.size(parts) <= depth + 1) & (F.size(F.array_intersect(F.slice(parts, 1, F.size(parts) - 1), F.array(*map(F.lit, P.SKIP_DIRS)))) == 0))
    ext = P.extension(F.col("rel"))
    rows = rows.filter(ext.isin([e.lower().lstrip("*.") for e in extensions])) if extensions else rows.filter((F.col("kind") != "unsupported") | ext.isin(P.LEGACY))
    return rows.orderBy("rel").limit(most) if most else rows


def decode_bytes(raw: bytes) -> str:
    """UTF-16 by its mark, else UTF-8, else GBK if that leaves fewer unreadable characters; line ends to LF."""
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        text = raw.decode("utf-16", "replace")
    else:
        text = raw.decode("utf-8-sig", "replace")
        if "�" in text:
            other = raw.decode("gbk", "replace")
            text = other if other.count("�") < text.count("�") else text
    return text.replace("\r\n", "\n").replace("\r", "\n")


def looks_binary(raw: bytes) -> bool:
    """A NUL or more than a twentieth control bytes among the first 4096."""
    head = raw[:4096]
    return b"\0" in head or sum(b < 9 or 13 < b < 32 for b in head) > 0.05 * len(head)


def open_zip(raw: bytes) -> dict[str, Callable[[], bytes]]:
    """Entries of an archive by name; too many entries, too large ones and broken checksums are errors."""
    archive = zipfile.ZipFile(io.BytesIO(raw))
    infos = archive.infolist()
    if len(infos) > MAX_ENTRIES:
        raise ValueError("too many entries")

    def reader(info: zipfile.ZipInfo) -> Callable[[], bytes]:
        def read() -> bytes:
            if info.file_size > MAX_BYTES:
                raise ValueError("entry too large")
            return archive.read(info)

        return read

    return {entry_name(i).replace("\\", "/"): reader(i) for i in infos}


def entry_name(info: zipfile.ZipInfo) -> str:
    """The name of an archive entry: UTF-8 where it says so, else UTF-8 or GBK if its bytes are, else as CP437."""
    if info.flag_bits & 0x800 or info.filename.isascii():
        return info.filename
    raw = info.filename.encode("cp437", "replace")
    for encoding in ("utf-8", "gbk"):
        try:
            return raw.decode(encoding)
        except UnicodeDecodeError:
            continue
    return info.filename


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _docx_text(node: ElementTree.Element) -> str:
    """Text of a paragraph: tabs and breaks kept, field codes and deleted runs left out."""
    out = []
    for child in node:
        name = _local(child.tag)
        if name in ("instrText", "delText", "del"):
            continue
        out.append(child.text or "" if name == "t" else "\t" if name == "tab" else "\n" if name in ("br", "cr") else _docx_text(child))
    return "".join(out)


def read_docx(raw: bytes) -> tuple[str | None, list[str]]:
    """Title and paragraphs; a table row is one paragraph with its cells set off by tabs."""
    entries = open_zip(raw)
    if "word/document.xml" not in entries:
        raise ValueError("no word document")
    out: list[str] = []

    def walk(node: ElementTree.Element) -> None:
        for child in node:
            name = _local(child.tag)
            if name == "p":
                out.append(_docx_text(child).strip())
            elif name == "tr":
                out.append("\t".join(" ".join(filter(None, (_docx_text(p).strip() for p in cell.iter() if _local(p.tag) == "p"))) for cell in child if _local(cell.tag) == "tc"))
            else:
                walk(child)

    walk(ElementTree.fromstring(entries["word/document.xml"]()))
    title = None
    if "docProps/core.xml" in entries:
        title = next((n.text for n in ElementTree.fromstring(entries["docProps/core.xml"]()).iter() if _local(n.tag) == "title" and n.text), None)
    return title, [p for p in out if p.strip()]


def column_index(reference: str) -> int:
    """Number from 0 of the column letters a cell reference begins with; -1 without letters."""
    n = 0
    for c in re.match(r"[A-Za-z]*", reference)[0].upper():
        n = n * 26 + ord(c) - 64
    return n - 1


def _is_date_format(code: str) -> bool:
    return bool(re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code.lower())))


def read_xlsx(raw: bytes, most_rows: int | None = None) -> Iterator[tuple[str, int, int, str, str]]:
    """``(sheet, row, column, kind, value)`` of the cells of all sheets; kinds are text, number, date and bool.

    Dates stay serial numbers, flagged by their format. ``most_rows`` keeps the first rows of a sheet and ends a cut sheet
    with a cell of kind ``cut``; None keeps all.
    """
    entries = open_zip(raw)
    xml = lambda name: ElementTree.fromstring(entries[name]()) if name in entries else None
    book = xml("xl/workbook.xml")
    if book is None:
        raise ValueError("no workbook")
    children = lambda node, name: [n for n in node.iter() if _local(n.tag) == name] if node is not None else []
    shared = ["".join(t.text or "" for t in children(si, "t")) for si in children(xml("xl/sharedStrings.xml"), "si")]
    styles = xml("xl/styles.xml")
    custom = {n.get("numFmtId"): n.get("formatCode", "") for n in children(styles, "numFmt")}
    formats = [x.get("numFmtId", "0") for g in children(styles, "cellXfs") for x in g]
    dated = [14 <= int(f) <= 22 or 45 <= int(f) <= 47 or (f in custom and _is_date_format(custom[f])) for f in formats]
    targets = {n.get("Id"): n.get("Target", "") for n in children(xml("xl/_rels/workbook.xml.rels"), "Relationship")}
    for number, sheet in enumerate(children(book, "sheet"), 1):
        rid = next((v for k, v in sheet.attrib.items() if _local(k) == "id"), "")
        target = targets.get(rid, f"worksheets/sheet{number}.xml")
        tree = xml(target.lstrip("/") if target.startswith("/") else f"xl/{target}")
        for place, row in enumerate(children(tree, "row"), 1):
            if most_rows is not None and place > most_rows:
                yield sheet.get("name", ""), place, 0, "cut", ""
                break
            for spot, cell in enumerate(n for n in row if _local(n.tag) == "c"):
                kind, style = cell.get("t", "n"), int(cell.get("s", "0") or 0)
                value = next((n.text or "" for n in cell if _local(n.tag) == "v"), "")
                if kind == "s":
                    kind, value = "text", shared[int(value)] if value.isdigit() and int(value) < len(shared) else ""
                elif kind in ("inlineStr", "str", "e"):
                    kind, value = "text", value or "".join(t.text or "" for t in children(cell, "t"))
                elif kind == "b":
                    kind, value = "bool", "TRUE" if value == "1" else "FALSE"
                else:
                    kind = "date" if style < len(dated) and dated[style] and value else "number"
                if value:
                    column = column_index(cell.get("r", ""))
                    yield sheet.get("name", ""), int(row.get("r", place)), column if column >= 0 else spot, kind, value


def sheet_text(cells: list[tuple[str, int, int, str, str]]) -> str:
    """Sheets as tab-separated lines under their names, short rows filled up by column."""
    sheets: dict[str, dict[int, dict[int, str]]] = {}
    for sheet, row, column, kind, value in cells:
        if kind == "cut":
            continue
        sheets.setdefault(sheet, {}).setdefault(row, {})[column] = re.sub(r"\s+", " ", value)
    blocks = []
    for name, rows in sheets.items():
        width = max(max(r) for r in rows.values()) + 1
        blocks.append("\n".join([f"## {name}", *("\t".join(rows[k].get(c, "") for c in range(width)) for k in sorted(rows))]))
    return "\n\n".join(blocks)


def read_pptx(raw: bytes) -> list[tuple[int, str]]:
    """``(slide number, text)`` of all slides, in numeric order."""
    entries = open_zip(raw)
    slides = sorted((int(m[1]), n) for n in entries if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    if not slides:
        raise ValueError("no slides")
    out = []
    for number, name in slides:
        lines = ["".join(t.text or "" for t in p.iter() if _local(t.tag) == "t") for p in ElementTree.fromstring(entries[name]()).iter() if _local(p.tag) == "p"]
        out.append((number, "\n".join(x for x in lines if x.strip())))
    return out


class Limits(NamedTuple):
    """What is kept of one file; a file that is cut says so. None keeps all."""

    bytes: int | None = MAX_BYTES
    rows: int | None = MAX_ROWS
    slides: int | None = MAX_SLIDES


def _extract(kind: str, name: str, raw: bytes, limits: Limits) -> tuple[bool, str, str | None, str | None, bool, bool]:
    """Whether it was read, text, title, note, whether it was cut, whether the text is doubtful."""
    failed = lambda note: (False, "", None, note, False, False)
    if limits.bytes is not None and len(raw) > limits.bytes:
        return failed("too_large")
    try:
        if kind == "docx":
            title, parts = read_docx(raw)
            return True, "\n".join(parts), title, None, False, False
        if kind == "xlsx":
            cells = list(read_xlsx(raw, limits.rows))
            return True, sheet_text(cells), None, None, any(c[3] == "cut" for c in cells), False
        if kind == "pptx":
            slides = read_pptx(raw)
            kept = slides if limits.slides is None else slides[: limits.slides]
            empty = sum(not text for _, text in kept)
            return True, "\n\n".join(f"## {n}\n{t}" for n, t in kept), None, None, len(kept) < len(slides), empty * 2 > len(kept)
        if kind == "pdf":
            text, doubtful = read_pdf(raw)
            return True, text, None, None, False, doubtful
        if kind in ("text", "code"):
            if raw[:2] not in (b"\xff\xfe", b"\xfe\xff") and looks_binary(raw):
                return failed("binary")
            return True, decode_bytes(raw), None, None, False, False
        return failed("legacy_office" if name.lower().endswith(tuple("." + e for e in P.LEGACY)) else "unknown_format")
    except Exception as error:  # a broken file is a row of its own
        return failed(f"{type(error).__name__}: {error}"[:200])


def extract_text(files: DataFrame, most_chars: int | None = MAX_CHARS, limits: Limits = Limits()) -> DataFrame:
    """``(rel, kind, ok, text, title, note, truncated, doubtful)`` for every file ``(rel, kind, content)``.

    Null content fails with a note, an empty file gives empty text. HTML is turned to plain text. ``most_chars`` cuts the
    text, ``limits`` rows and slides, and ``truncated`` says so; None keeps all. ``doubtful`` marks slides of which most
    are empty and PDF text that is partly unreadable.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(rel, kind, *(_extract(kind, rel, raw, limits) if raw is not None else (False, "", None, "missing", False, False))) for rel, kind, raw in zip(pdf.rel, pdf.kind, pdf.content, strict=True)]
            yield pd.DataFrame(rows, columns=["rel", "kind", "ok", "text", "title", "note", "truncated", "doubtful"])

    out = files.select("rel", "kind", "content").mapInPandas(run, "rel string, kind string, ok boolean, text string, title string, note string, truncated boolean, doubtful boolean")
    out = out.withColumn("text", F.when(P.extension(F.col("rel")).isin("html", "htm"), T.html_to_text(F.col("text"))).otherwise(F.col("text")))
    if most_chars is None:
        return out
    return out.withColumn("truncated", F.col("truncated") | (F.char_length("text") > most_chars)).withColumn("text", F.substring("text", 1, most_chars))


def corpus_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = ("md", "txt", "tex", "csv")) -> tuple[DataFrame, DataFrame]:
    """``(file, label, text)`` of the plain texts directly in a folder, and ``(file, note)`` of those that cannot be read.

    Hidden files are left out. A folder that is missing or empty gives no rows.
    """
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "[!.]*").load(root)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        files = spark.createDataFrame([], "path string, content binary")
    named = files.select(F.substring_index("path", "/", -1).alias("rel"), F.lit("text").alias("kind"), "content").filter(P.extension(F.col("rel")).isin(*extensions))
    read = materialize(extract_text(named, None), "corpus")
    return read.filter("ok").select(F.col("rel").alias("file"), F.regexp_replace("rel", r"\.[^.]+$", "").alias("label"), "text"), read.filter("NOT ok").select(F.col("rel").alias("file"), "note")


def xlsx_cells(files: DataFrame) -> DataFrame:
    """``(rel, sheet, row, col, kind, value)`` of all cells of spreadsheets ``(rel, content)``; broken files give none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for rel, raw in zip(pdf.rel, pdf.content, strict=True):
                try:
                    rows += [(rel, *cell) for cell in read_xlsx(raw)]
                except Exception:
                    continue
            yield pd.DataFrame(rows, columns=["rel", "sheet", "row", "col", "kind", "value"])

    return files.select("rel", "content").mapInPandas(run, "rel string, sheet string, row int, col int, kind string, value string")


def ingest_summary(extracted: DataFrame) -> DataFrame:
    """One row: files read, failed, cut and doubtful."""
    return extracted.agg(F.count(F.lit(1)).alias("files"), F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"), F.count_if("truncated").alias("truncated"), F.count_if("doubtful").alias("doubtful"))


def assemble_corpus(*parts: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """Union of parts ``(file, label, text)``, each file once (the first part that has it), without the excluded files."""
    numbered = [p.select("file", "label", "text").withColumn("part", F.lit(n)) for n, p in enumerate(parts)]
    every = numbered[0]
    for more in numbered[1:]:
        every = every.unionByName(more)
    if exclude is not None:
        every = every.join(exclude.select("file"), "file", "left_anti")
    best = every.groupBy("file").agg(F.min_by(F.struct("label", "text"), F.struct("part", "label")).alias("first"))
    return best.select("file", "first.label", "first.text")


def write_report(df: DataFrame, path: str, keep_backup: bool = False) -> None:
    """Overwrite a report table: written beside it first, then put in its place; with ``keep_backup`` the old one stays as ``.bak``."""
    spark, fresh = df.sparkSession, f"{path}.new"
    df.write.mode("overwrite").parquet(fresh)
    remove(spark, f"{path}.bak")
    move(spark, path, f"{path}.bak")
    move(spark, fresh, path)
    if not keep_backup:
        remove(spark, f"{path}.bak")


def write_new(df: DataFrame, path: str, key: str) -> DataFrame:
    """Append rows whose key is not there yet; returns the keys that were skipped."""
    spark = df.sparkSession
    try:
        there = spark.read.parquet(path).select(key).distinct()
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        there = spark.createDataFrame([], df.select(key).schema)
    kept_out = materialize(df.select(key).distinct().join(there, key, "left_semi"), "skipped")
    df.join(there, key, "left_anti").write.mode("append").parquet(path)
    return kept_out


def append_log(df: DataFrame, path: str) -> None:
    """Append audit rows."""
    df.write.mode("append").parquet(path)
