"""Citations, numbered objects, headings and terms of chapters, reconciled with a library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import text as T


def cited(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``(key, number)``: a row per distinct number a text cites."""
    return df.select(key, F.explode(T.cited_numbers(F.col(text))).alias("number"))


def reconcile(citations: DataFrame, library: DataFrame, group: str) -> DataFrame:
    """``(group, number, state)`` with state cited, out_of_range or uncited.

    ``citations (group, number)`` are the numbers used, ``library (group, number)`` the positions there are.
    """
    a = citations.select(group, "number").distinct().withColumn("used", F.lit(True))
    b = library.select(group, "number").distinct().withColumn("there", F.lit(True))
    state = F.when(F.col("there").isNull(), "out_of_range").when(F.col("used").isNull(), "uncited").otherwise("cited")
    return a.join(b, [group, "number"], "full").select(group, "number", state.alias("state"))


def first_gap(df: DataFrame, group: str, number: str) -> DataFrame:
    """``(group, first_gap)``: the smallest number missing from 1 to the group's largest; groups without gap are left out.

    Numbers are ranked, not enumerated: the first one greater than its rank tells the gap, whatever their size.
    """
    distinct = df.filter(F.col(number) >= 1).select(group, F.col(number).alias("number")).distinct()
    ranked = distinct.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy("number")))
    return ranked.filter("number > place").groupBy(group).agg(F.min("place").cast("bigint").alias("first_gap"))


def numbered_objects(df: DataFrame, key: str, chapter: str, kind: str, text: str = "text") -> DataFrame:
    """``(key, n_own, largest, first_gap, foreign)`` for objects written ``<kind> chapter-number``.

    ``foreign`` lists numbers of other chapters in order; a text without any has zeros and an empty list.
    """
    found = F.regexp_extract_all(text, F.lit(rf"{kind}\s*(\d+[-–]\d+)"), 1)
    pairs = F.transform(found, lambda x: F.transform(F.split(x, "[-–]"), lambda v: v.cast("int")))
    own = F.array_sort(F.array_distinct(F.transform(F.filter(pairs, lambda p: p[0] == F.col(chapter)), lambda p: p[1])))
    other = F.array_distinct(F.transform(F.filter(pairs, lambda p: p[0] != F.col(chapter)), lambda p: F.concat_ws("-", p[0].cast("string"), p[1].cast("string"))))
    base = df.select(key, own.alias("own"), F.array_join(F.array_sort(other), "、").alias("foreign"))
    largest = F.coalesce(F.array_max("own"), F.lit(0))
    gap = F.array_min(F.filter(F.transform("own", lambda v, i: F.when(v > i + 1, i + 1)), lambda v: v.isNotNull()))
    return base.select(key, F.size("own").alias("n_own"), largest.alias("largest"), gap.alias("first_gap"), "foreign")


def heading_numbers(lines: DataFrame, key: str) -> DataFrame:
    """``(key, number)`` of numbered headings, from ``text_lines`` output."""
    number = F.regexp_extract("line", r"^#{1,6}\s+(\d+(?:\.\d+)*)\s", 1)
    return lines.select(key, number.alias("number")).filter("number <> ''").distinct()


def missing_headings(required: DataFrame, headings: DataFrame, key: str) -> DataFrame:
    """Rows of ``required (key, number)`` that no heading bears."""
    return required.join(headings, [key, "number"], "left_anti")


def terms_before_definition(df: DataFrame, group: str, place: str, text: str = "text") -> DataFrame:
    """``(group, term, defined_at, used_at)``: abbreviations used in a text that stands before their first definition.

    A definition is a name followed by the abbreviation in full-width brackets. Uses count where the abbreviation stands
    free of letters and ideographs.
    """
    defined = df.select(group, place, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit("[一-鿿]{2,20}（([A-Z]{2,10})）"), 1))).alias("term"))
    defined = defined.groupBy(group, "term").agg(F.min(place).alias("defined_at"))
    plain = F.regexp_replace(text, "（[A-Z]{2,10}）", "（）")
    used = df.select(group, F.col(place).alias("used_at"), F.explode(F.array_distinct(F.regexp_extract_all(plain, F.lit("(?:^|[^A-Za-z一-鿿])([A-Z]{2,10})(?=[^A-Za-z一-鿿]|$)"), 1))).alias("term"))
    return defined.join(used, [group, "term"]).filter("used_at < defined_at").groupBy(group, "term", "defined_at").agg(F.min("used_at").alias("used_at"))


def range_check(count: Column, low: Column, high: Column) -> Column:
    """How far a count is outside a range: negative below, positive above, 0 inside, null without a range."""
    return F.when(count < low, count - low).when(count > high, count - high).when(low.isNotNull() & high.isNotNull(), 0)


def table_rows(lines: DataFrame, key: str) -> DataFrame:
    """``(key, line_no, cells)`` of the rows of Markdown tables, from ``text_lines`` output; rulers are left out.

    Cells are trimmed; a row needs no closing bar.
    """
    inner = F.regexp_replace(F.trim("line"), r"^\||\|$", "")
    rows = lines.filter(F.col("line").rlike(r"^\s*\|") & ~F.col("line").rlike(r"^[\s|:-]+$"))
    return rows.select(key, "line_no", F.transform(F.split(inner, r"\|"), lambda c: F.trim(c)).alias("cells"))
