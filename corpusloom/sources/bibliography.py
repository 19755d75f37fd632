"""Bibliographic inputs: BibTeX, Atom, and recorded answers of literature services."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import literature as L


def bib_keys(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``(key, number, cite_key)``: entries of BibTeX texts in order; the place is the citation number from 1."""
    found = F.regexp_extract_all(text, F.lit(r"(?m)^@\w+\s*\{\s*([^,\s]+)"), 1)
    return df.select(key, F.posexplode(found).alias("pos", "cite_key")).select(key, (F.col("pos") + 1).alias("number"), "cite_key")


def bib_entry(df: DataFrame, key: str, cite_key: str, text: str = "text") -> DataFrame:
    """``(key, kind, fields)`` of the entry a BibTeX text has under a key: its kind and a map of its braced or quoted fields."""
    entries = F.split(text, r"(?m)^(?=@\w+\s*\{)")
    found = F.filter(entries, lambda e: F.regexp_extract(e, r"^@\w+\s*\{\s*([^,\s]+)", 1) == cite_key)
    rows = df.select(key, F.get(found, F.lit(0)).alias("entry")).filter("entry IS NOT NULL")
    field = r'(?m)^\s*(\w+)\s*=\s*[{"](.*?)[}"],?\s*$'
    names, values = (F.regexp_extract_all("entry", F.lit(field), n) for n in (1, 2))
    return rows.select(key, F.lower(F.regexp_extract("entry", r"^@(\w+)", 1)).alias("kind"), F.map_from_arrays(F.transform(names, F.lower), values).alias("fields"))


def bib_dois(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``(key, doi)``: the distinct DOIs of BibTeX texts, in lower case."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)doi\s*=\s*[{\"]([^}\"\s]+)[}\"]"), 1)
    return df.select(key, F.explode(F.array_distinct(F.transform(found, F.lower))).alias("doi"))


def atom_entries(df: DataFrame, text: str = "text") -> DataFrame:
    """Records of Atom feeds: ``(title, abstract, authors, arxiv_id, doi, pub_year, rec_key)``."""
    blocks = df.select(F.explode(F.slice(F.split(text, "<entry"), 2, 1 << 20)).alias("block"))
    grab = lambda tag: F.nullif(T.strip_tags(F.regexp_extract("block", rf"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1)), F.lit(""))
    names = F.filter(F.transform(F.regexp_extract_all("block", F.lit(r"(?s)<name>(.*?)</name>"), 1), T.strip_tags), lambda n: n != "")
    arxiv = F.regexp_replace(F.substring_index(grab("id"), "/abs/", -1), r"v\d+$", "")
    out = blocks.select(grab("title").alias("title"), L.clean_abstract(F.regexp_extract("block", r"(?s)<summary[^>]*>(.*?)</summary>", 1)).alias("abstract"), names.alias("authors"), arxiv.alias("arxiv_id"), grab("(?:arxiv:)?doi").alias("doi"), F.substring(grab("published"), 1, 4).try_cast("int").alias("pub_year"))
    return out.filter("title IS NOT NULL").withColumn("rec_key", L.record_id(F.col("doi"), F.concat(F.lit("https://arxiv.org/abs/"), "arxiv_id"), F.col("title")))


SCHOLAR = "data ARRAY<STRUCT<paperId STRING, title STRING, authors ARRAY<STRUCT<name STRING>>, year INT, venue STRING, abstract STRING, url STRING, citationCount INT, externalIds STRUCT<DOI STRING, ArXiv STRING>>>"
CROSSREF = "message STRUCT<items ARRAY<STRUCT<DOI STRING, title ARRAY<STRING>, author ARRAY<STRUCT<given STRING, family STRING, name STRING>>, issued STRUCT<`date-parts` ARRAY<ARRAY<INT>>>, `container-title` ARRAY<STRING>, type STRING, abstract STRING, URL STRING>>>"
DBLP = "result STRUCT<hits STRUCT<hit ARRAY<STRUCT<info STRUCT<title STRING, authors STRUCT<author STRING>, year STRING, venue STRING, type STRING, doi STRING, url STRING, ee STRING>>>>>"
COLUMNS = ["rec_key", "title", "authors", "pub_year", "venue", "lit_type", "doi", "url", "abstract", "citation_count", "lit_source"]


def _record(df: DataFrame, source: str) -> DataFrame:
    keyed = df.withColumn("title", T.strip_tags(F.col("title"))).filter("title <> ''").withColumn("lit_source", F.lit(source))
    return keyed.withColumn("rec_key", L.record_id(F.col("doi"), F.col("url"), F.col("title"))).select(COLUMNS)


def scholar_records(answers: DataFrame) -> DataFrame:
    """Records of recorded answers ``(body)`` with a ``data`` list; a body that is no JSON fails the query."""
    r = answers.select(F.explode(F.from_json("body", SCHOLAR, {"mode": "FAILFAST"})["data"]).alias("r")).select("r.*")
    return _record(r.select("title", F.transform("authors", lambda a: a["name"]).alias("authors"), F.col("year").alias("pub_year"), F.coalesce("venue", F.lit("")).alias("venue"), L.venue_type(F.col("venue"), F.col("externalIds.ArXiv").isNotNull()).alias("lit_type"), F.col("externalIds.DOI").alias("doi"), "url", L.clean_abstract(F.col("abstract")).alias("abstract"), F.col("citationCount").alias("citation_count")), "semantic-scholar")


def crossref_records(answers: DataFrame, year_from: int | None = None) -> DataFrame:
    """Records of recorded answers ``(body)`` with ``message.items``; items without a DOI are left out."""
    r = answers.select(F.explode(F.from_json("body", CROSSREF, {"mode": "FAILFAST"})["message"]["items"]).alias("r")).select("r.*").filter("DOI IS NOT NULL")
    # Types of the service and ours.
    kinds = {"journal-article": "article", "proceedings-article": "inproceedings", "book": "book", "monograph": "book", "dissertation": "phdthesis", "posted-content": "misc"}
    kind = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in kinds.items() for x in p)), F.coalesce("type", F.lit(""))), F.lit("article"))
    names = F.filter(F.transform("author", lambda a: F.trim(F.coalesce(a["name"], F.concat_ws(" ", a["given"], a["family"])))), lambda n: n != "")
    year = F.get(F.get(F.col("issued")["date-parts"], F.lit(0)), F.lit(0))
    rows = r.select(F.get("title", F.lit(0)).alias("title"), names.alias("authors"), year.alias("pub_year"), F.coalesce(F.get("`container-title`", F.lit(0)), F.lit("")).alias("venue"), kind.alias("lit_type"), F.col("DOI").alias("doi"), F.col("URL").alias("url"), L.clean_abstract(F.col("abstract")).alias("abstract"), F.lit(None).cast("int").alias("citation_count"))
    return _record(rows if year_from is None else rows.filter(F.col("pub_year").isNull() | (F.col("pub_year") >= year_from)), "crossref")


def dblp_records(answers: DataFrame) -> DataFrame:
    """Records of recorded answers ``(body)`` with ``result.hits.hit``, a list or a single hit; preprints are misc."""
    listed = F.regexp_replace("body", r'(?s)"hit"\s*:\s*(\{.*\})(\s*\}\s*\}\s*\}\s*)$', '"hit":[$1]$2')
    body = F.when(F.col("body").rlike(r'"hit"\s*:\s*\{'), listed).otherwise(F.col("body"))
    r = answers.select(F.explode(F.from_json(body, DBLP, {"mode": "FAILFAST"})["result"]["hits"]["hit"]).alias("r")).select("r.info.*")
    names = F.regexp_extract_all(F.concat_ws(",", F.col("authors.author")), F.lit(r'"text"\s*:\s*"([^"]+)"'), 1)
    plain = F.when(F.col("authors.author").isNull(), F.array().cast("array<string>")).when(~F.col("authors.author").rlike(r'^[\[{]'), F.array("authors.author")).when(F.size(names) > 0, names).otherwise(F.coalesce(F.from_json("authors.author", "array<string>"), F.array().cast("array<string>")))
    people = F.filter(plain, lambda n: (n != "") & ~n.rlike(r"^\s*\d{4}(-\d{4}){0,3}\s*$"))
    kinds = F.when(F.lower("venue").rlike("corr|arxiv"), "misc").when(F.col("type") == "Conference and Workshop Papers", "inproceedings").when(F.col("type") == "Journal Articles", "article").when(F.col("type") == "Books and Theses", "book").when(F.col("doi").isNotNull(), "article").otherwise("inproceedings")
    return _record(r.select("title", people.alias("authors"), F.col("year").try_cast("int").alias("pub_year"), F.coalesce("venue", F.lit("")).alias("venue"), kinds.alias("lit_type"), "doi", F.coalesce("ee", "url").alias("url"), F.lit(None).cast("string").alias("abstract"), F.lit(None).cast("int").alias("citation_count")), "dblp")


def read_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON state file against a fixed schema: a file that does not fit fails, it never becomes a default."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def embedded_state(df: DataFrame, marker: str, schema: str, text: str = "text") -> DataFrame:
    """The JSON block a Markdown comment holds (``<!-- marker ... -->``), parsed; texts without it are left out."""
    body = F.regexp_extract(text, rf"(?s)<!-- {marker}\s*\n(.*?)\n\s*-->", 1)
    return df.filter(body != "").select("*", F.from_json(body, schema, {"mode": "FAILFAST"}).alias("state"))
