"""Harmonising, deduplicating, ranking and exporting literature records."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.runtime import materialize, numbered

# Words by which a venue is a journal or a conference.
JOURNAL = "journal|transactions|review|letters|magazine|quarterly|acta|annals"
CONFERENCE = "conference|symposium|workshop|proceedings|meeting|congress"
SOURCE_ORDER = ["semantic-scholar", "dblp", "arxiv", "crossref"]


def record_id(doi: Column, url: Column, title: Column) -> Column:
    """Sixteen hex digits of the SHA-1 of the first of DOI, address and title, trimmed and in lower case."""
    return F.substring(F.sha1(F.lower(F.trim(F.coalesce(doi, url, title))).cast("binary")), 1, 16)


def venue_type(venue: Column, is_preprint: Column) -> Column:
    """article, inproceedings or misc, by the words of the venue."""
    v = F.lower(F.coalesce(venue, F.lit("")))
    return F.when(v.rlike(JOURNAL), "article").when(v.rlike(CONFERENCE), "inproceedings").when(is_preprint, "misc").otherwise("article")


def clean_abstract(text: Column, most: int = 600) -> Column:
    """Abstract without tags, cut at ``most`` characters; null if nothing is left."""
    plain = T.strip_tags(text)
    return F.when(plain == "", None).when(F.char_length(plain) > most, F.concat(F.substring(plain, 1, most), F.lit("…"))).otherwise(plain)


def plain_doi(doi: Column) -> Column:
    """A DOI in lower case without resolver or label; null where none is in it."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(doi)), r"(10\.\d{4,9}/\S+)", 1), F.lit(""))


def source_name(source: Column) -> Column:
    """A source as typed, in lower case with hyphens and no outer blanks."""
    return F.regexp_replace(F.lower(F.trim(source)), r"\s+", "-")


def first_by_id(records: DataFrame, key: str, order: list) -> DataFrame:
    """The first record of each key in the given order; null keys stay single and take part in no grouping."""
    first = F.min_by(F.struct(*records.columns), F.struct(*order)).alias("first")
    keyed = records.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("group_key")).agg(first).select("first.*")
    return keyed.unionByName(records.filter(F.col(key).isNull()))


def first_source(records: DataFrame, group: str, source: str, order: list[str] = SOURCE_ORDER) -> DataFrame:
    """Per group only the records of the first source in ``order`` that has any."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col(source)), F.lit(0))
    ranked = records.withColumn("rank", rank).filter("rank > 0")
    best = ranked.groupBy(group).agg(F.min("rank").alias("rank"))
    return ranked.join(best, [group, "rank"]).drop("rank")


def rank_records(records: DataFrame, group: str, most: int) -> DataFrame:
    """The ``most`` records per group by citations, or by year where these are unknown; ties by id."""
    score = F.coalesce("citation_count", "pub_year", F.lit(0))
    place = W.partitionBy(group).orderBy(score.desc(), "rec_id")
    return records.withColumn("score", score).withColumn("place", F.row_number().over(place)).filter(F.col("place") <= most)


def since(records: DataFrame, year: int | None, column: str = "pub_year") -> DataFrame:
    """Records of a year or later, and those of unknown year; all of them for no year."""
    return records if year is None else records.filter(F.col(column).isNull() | (F.col(column) >= year))


def new_records(found: DataFrame, library: DataFrame, key: str, order: list) -> DataFrame:
    """``found`` records whose key is not in the library yet, the first of equal keys; null keys are all kept."""
    fresh = found.join(library.select(key).distinct(), key, "left_anti")
    return first_by_id(fresh, key, order)


def _folded(text: str) -> str:
    plain = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not "̀" <= c <= "ͯ")
    return re.sub(r"[^a-z0-9一-鿿]+", "", plain)


def cite_key(author: str | None, year, title: str | None) -> str:
    """Citation key of the first author's last word, the year and the first word or four ideographs of the title."""
    name = (author or "").strip()
    head = (_folded(name.split()[-1]) or _folded(name)) if name else "anon"
    han = "".join(re.findall(r"[一-鿿]+", title or ""))
    words = (w for w in (title or "").split() if w.lower() not in {"a", "an", "the", "on", "of", "for", "and"})
    word = han[:4] or next((f for f in map(_folded, words) if f), "paper")
    return f"{head}{'' if year is None or pd.isna(year) else int(year)}{word}"[:40]


def cite_keys(records: DataFrame) -> DataFrame:
    """``(rec_id, base_key, cite_key)``: keys made unique by a letter in the order of ``rec_id``."""

    @F.pandas_udf("string")
    def base(author: pd.Series, year: pd.Series, title: pd.Series) -> pd.Series:
        return pd.Series([cite_key(a, y, t) for a, y, t in zip(author, year, title, strict=True)], dtype="object")

    keyed = materialize(records.select("rec_id", base(F.get("authors", F.lit(0)), "pub_year", "title").alias("base_key")), "keys")
    place = F.col("place") - 2
    suffix = F.when(place < 0, "").when(place < 26, F.char(F.lit(97) + place)).otherwise(F.concat(F.lit("x"), place.cast("string")))
    return numbered(keyed, "base_key", "rec_id").select("rec_id", "base_key", F.concat("base_key", suffix).alias("cite_key"))


def bibtex_entry(key: Column, kind: Column, authors: Column, title: Column, venue: Column, year: Column, doi: Column, url: Column) -> Column:
    """A BibTeX entry; empty and null fields are left out, an unknown venue is said to be so."""
    place = F.when(kind == "inproceedings", "booktitle").when(kind == "book", "publisher").when(kind == "phdthesis", "school").when(kind == "misc", "howpublished").otherwise("journal")
    where = F.coalesce(F.nullif(venue, F.lit("")), F.when(kind == "misc", "Preprint").otherwise("unknown"))
    line = lambda name, value: F.concat(F.lit("  "), name if isinstance(name, Column) else F.lit(name), F.lit(" = {"), value, F.lit("}"))
    names = F.array_join(F.filter(F.transform(authors, lambda a: F.trim(a)), lambda a: a != ""), " and ")
    lines = F.array(line("author", F.coalesce(names, F.lit(""))), line("title", F.coalesce(title, F.lit(""))), line(place, where), line("year", F.coalesce(year.cast("string"), F.lit(""))), F.when(doi != "", line("doi", doi)), F.when(url != "", line("url", url)))
    return F.concat(F.lit("@"), kind, F.lit("{"), key, F.lit(",\n"), F.array_join(lines, ",\n"), F.lit("\n}"))
