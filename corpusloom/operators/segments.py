"""Segmentation of texts into lines and paragraphs.

A text is one row, so it is cut where it is read: one Arrow pass without a shuffle, in memory that follows the longest
text of a batch. Lines as rows, where an operator wants them, are an explode in the JVM.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T

_HALF = str.maketrans(T.HALF_FROM[: len(T.HALF_TO)], T.HALF_TO, T.HALF_FROM[len(T.HALF_TO) :])
_DROP = re.compile(T.NOT_TOKEN)
_SIGN = re.compile(T.MATH_SIGNS)
_BLANK = re.compile(r"[ \t\n\x0b\f\r]+")
_HEADING = re.compile(r"#{1,6}[ \t]")
_kinds = [(name, re.compile(pattern.replace(r"\s", r"[ \t\n\x0b\f\r]").replace(r"\S", r"[^ \t\n\x0b\f\r]").replace(r"\d", "[0-9]"), re.A)) for name, pattern in T.LINE_KINDS.items() if name != "formula"]
_formula = re.compile(T.LINE_KINDS["formula"].replace(r"\s", r"[ \t\n\x0b\f\r]"))
# a line that begins with a letter or an ideograph is text unless it is one of the few kinds that can begin so
_plain = re.compile(r"[A-Za-z一-鿿]")
_rare = re.compile(r"[$\\=]|(?i:参考文献|引用文献|reference|bibliography|-->)|^(?:TODO|TBD|FIXME)")


def half(text: str) -> str:
    """``functions.text.half_width`` for one string."""
    return text.translate(_HALF).replace("\r\n", "\n").replace("\r", "\n")


def line_kind(line: str) -> str:
    """``functions.text.line_kind`` for one string."""
    if not _BLANK.sub("", line):
        return "blank"
    if _plain.match(line) and not _rare.search(line):
        return "text"
    for name, pattern in _kinds[:3]:
        if pattern.search(line):
            return name
    packed = _BLANK.sub("", line)
    if _formula.search(line) or (re.search(r"[$\\=]", line) and len(_SIGN.findall(packed)) >= 0.5 * len(packed)):
        return "formula"
    return next((name for name, pattern in _kinds[3:] if pattern.search(line)), "text")


def cut_paragraphs(text: str) -> Iterator[tuple[int, int, str]]:
    """``(first line, last line, raw)`` of the runs of neighbouring text lines, lines from 1."""
    fenced, start, run = False, 0, []
    for number, line in enumerate(half(text).split("\n"), 1):
        kind = line_kind(line)
        if kind == "fence":
            fenced = not fenced
        elif kind == "text" and not fenced:
            start = start or number
            run.append(line)
            continue
        if run:
            yield start, start + len(run) - 1, "\n".join(run)
            start, run = 0, []
        if kind == "reference_heading" and not fenced:
            return
    if run:
        yield start, start + len(run) - 1, "\n".join(run)


def cut_style_paragraphs(text: str) -> Iterator[tuple[int, str]]:
    """``(first line, text)`` of blocks between blank lines and headings: trimmed lines run together, no tables or lists."""
    start, block = 0, []
    for number, line in enumerate([*text.replace("\r\n", "\n").split("\n"), ""], 1):
        trimmed = line.strip()
        if trimmed and not _HEADING.match(line):
            start = start or number
            if not trimmed.startswith(("|", "- ")):
                block.append(trimmed)
            continue
        if start:
            yield start, "".join(block)
        start, block = 0, []


def text_lines(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``(key, line_no, line, kind)`` from 1, of the half-width text. A null text has no lines, an empty one one line."""
    lines = df.select(key, F.posexplode(F.split(T.half_width(F.col(text)), "\n")).alias("pos", "line"))
    return lines.select(key, (F.col("pos") + 1).alias("line_no"), "line", T.line_kind(F.col("line")).alias("kind"))


def _cut(df: DataFrame, key: str, text: str, schema: str, rows_of) -> DataFrame:
    """Run ``rows_of(text)`` per row within Arrow batches and put the key before each of its rows."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.string() if c.endswith("string") else pa.int64() for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners: list[int] = []
            columns: list[list] = [[] for _ in names]
            size = 0
            texts = batch.column("text")
            for place in range(batch.num_rows):
                value = texts[place].as_py()
                size += len(value or "")
                for row in rows_of(value) if value else ():
                    owners.append(place)
                    for column, x in zip(columns, row, strict=True):
                        column.append(x)
                if owners and (size > 4_000_000 or place == batch.num_rows - 1):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owners, pa.int64())), *map(pa.array, columns, kinds)], names=["key", *names])
                    owners, columns, size = [], [[] for _ in names], 0

    source = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, {schema}").withColumnRenamed("key", key)


def paragraphs(df: DataFrame, key: str, text: str = "text", min_chars: int = 30) -> DataFrame:
    """``(key, line_start, line_end, raw, normalised, n_chars)``: runs of neighbouring text lines.

    Blank and structural lines, fenced code and everything after a reference heading break a paragraph. Paragraphs of
    fewer than ``min_chars`` normalised characters are left out. Null and empty texts have none.
    """

    def rows(value: str) -> Iterator[tuple]:
        for first, last, raw in cut_paragraphs(value):
            normalised = _DROP.sub(lambda m: m[1] or "", raw).lower()
            if len(normalised) >= min_chars:
                yield first, last, raw, normalised, len(normalised)

    return _cut(df, key, text, "line_start bigint, line_end bigint, raw string, normalised string, n_chars bigint", rows)


def segment_counts(df: DataFrame, key: str, text: str = "text", min_chars: int = 30) -> DataFrame:
    """``(key, kept, skipped_short)`` of every row: paragraphs long enough, and those left out as too short."""
    every = paragraphs(df, key, text, 0).groupBy(key).agg(F.count_if(F.col("n_chars") >= min_chars).alias("kept"), F.count_if(F.col("n_chars") < min_chars).alias("skipped_short"))
    return df.select(key).distinct().join(every, key, "left").na.fill(0, ["kept", "skipped_short"])


def style_paragraphs(df: DataFrame, key: str, text: str = "text", least: int = 20) -> DataFrame:
    """``(key, line_start, raw)``: body paragraphs of a chapter for the style rules, of more than ``least`` characters.

    Blank lines and headings break a paragraph; table and list lines are dropped, the others trimmed and run together.
    """

    def rows(value: str) -> Iterator[tuple]:
        return ((first, block) for first, block in cut_style_paragraphs(value) if len(block) > least)

    return _cut(df, key, text, "line_start bigint, raw string", rows)


def written_chapters(chapters: DataFrame, key: str, template_chars: str, text: str = "text", margin: int = 100) -> DataFrame:
    """``(key, n_cjk, state)`` of chapters: missing (no text), template (hardly more than the template) or written.

    A chapter counts as written with a ticked box or with more than ``margin`` ideographs above ``template_chars``.
    """
    n = T.cjk_count(F.col(text))
    done = F.col(text).rlike(r"(?m)^\s*- \[x\]") | (n > F.col(template_chars) + margin)
    return chapters.select(key, n.cast("bigint").alias("n_cjk"), F.when(F.col(text).isNull() | (F.trim(text) == ""), "missing").when(done, "written").otherwise("template").alias("state"))


def style_text(df: DataFrame, key: str, text: str = "text", least: int = 20) -> DataFrame:
    """``(key, whole, body)``: each text with LF line ends, and its style paragraphs a line each."""

    def rows(value: str) -> Iterator[tuple]:
        yield value.replace("\r\n", "\n"), "\n".join(block for _, block in cut_style_paragraphs(value) if len(block) > least)

    return _cut(df, key, text, "whole string, body string", rows)


def opening_runs(df: DataFrame, key: str, text: str = "text", prefix: int = 6, least: int = 3) -> DataFrame:
    """``(key, opening, line_start, n_paragraphs)``: ``least`` or more style paragraphs in a row that open alike."""

    def rows(value: str) -> Iterator[tuple]:
        paragraphs = [(first, block) for first, block in cut_style_paragraphs(value) if len(block) > 20]
        for opening, run in itertools.groupby(paragraphs, lambda p: p[1][:prefix]):
            if len(run := list(run)) >= least:
                yield opening, run[0][0], len(run)

    return _cut(df, key, text, "opening string, line_start bigint, n_paragraphs bigint", rows)
