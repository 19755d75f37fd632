"""The queries of the training-data operators, over whole tables."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import leakage, lookalike, matching, mixing, name_variants, reading, representative, shared_spans
from corpusloom.runtime import materialize, spread, table


def _records(spark: SparkSession, d: str) -> list[DataFrame]:
    return shared_spans.record_batches(table(spark, d, "fingerprinted_texts"), table(spark, d, "risk_items"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.shared_spans(_records(spark, d))


def p1_shared_amount(spark: SparkSession, d: str) -> DataFrame:
    batches = _records(spark, d)
    every = batches[0].unionByName(batches[1])
    return shared_spans.shared_amount(shared_spans.shared_spans(batches), every)


def _linked(spark: SparkSession, d: str) -> DataFrame:
    authors = table(spark, d, "lit_records").select(F.explode("authors").alias("name"))
    return materialize(name_variants.link_variants(authors), "linked")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return name_variants.variant_pairs(_linked(spark, d))


def p2_authors(spark: SparkSession, d: str) -> DataFrame:
    return _linked(spark, d)


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return representative.judged_values(*(table(spark, d, name) for name in ("lit_records", "dup_groups", "source_trust")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return representative.sole_best(_judged(spark, d))


def p3_survivors(spark: SparkSession, d: str) -> DataFrame:
    return representative.surviving_records(_judged(spark, d))


def _looks(spark: SparkSession, d: str) -> DataFrame:
    texts = lookalike.normalize_lookalikes(spread(table(spark, d, "fingerprinted_texts")), "fp_id", "text")
    return texts.unionByName(lookalike.normalize_lookalikes(spread(table(spark, d, "docx_contents")), "docx_id", "text"))


def p4_normal_forms(spark: SparkSession, d: str) -> DataFrame:
    return _looks(spark, d).select("text_id", "normal_form", "visual_key")


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.class_links(lookalike.lookalike_classes(_looks(spark, d)))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.lookalike_pairs(_looks(spark, d))


def _matches(spark: SparkSession, d: str) -> DataFrame:
    bib = table(spark, d, "bib_entries").select(F.col("bib_id").alias("id"), "title", F.array("authors").alias("authors"), F.col("pub_year").alias("year"), "venue")
    lit = table(spark, d, "lit_records").select(F.col("rec_id").alias("id"), "title", "authors", F.col("pub_year").cast("string").alias("year"), "venue")
    return matching.match(bib, lit)


def p5_matches(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d).filter("confidence > 0.5").select(F.col("entry_id").alias("bib_id"), F.col("record_id").alias("rec_id")).distinct()


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaking_documents(_leaks(spark, d))


def p6_removal_spans(spark: SparkSession, d: str) -> DataFrame:
    spans = _leaks(spark, d).select("doc_id", "item_id", "leaked_share", F.explode("spans").alias("span"))
    return spans.select("doc_id", "item_id", "leaked_share", "span.span_start", "span.span_end")


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p7_classifier(spark: SparkSession, d: str) -> DataFrame:
    return mixing.classifier_report(table(spark, d, "documents"))


def _levels(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return reading.reading_levels(docs, reading.fit_levels(docs, table(spark, d, "reading_labels")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.demanding_documents(_levels(spark, d))


def p8_levels(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d)


def p8_profile(spark: SparkSession, d: str) -> DataFrame:
    return reading.level_profile(_levels(spark, d), table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_shared_amount": p1_shared_amount,
    "p2_found": p2_found,
    "p2_authors": p2_authors,
    "p3_found": p3_found,
    "p3_survivors": p3_survivors,
    "p4_found": p4_found,
    "p4_normal_forms": p4_normal_forms,
    "p4_classes": p4_classes,
    "p5_found": p5_found,
    "p5_matches": p5_matches,
    "p6_found": p6_found,
    "p6_removal_spans": p6_removal_spans,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p7_classifier": p7_classifier,
    "p8_found": p8_found,
    "p8_levels": p8_levels,
    "p8_profile": p8_profile,
}

# The same results in plain SQL, where it can say them; p3 and p1 by their definitions, without the operators' methods.
_P1 = """WITH recs AS (SELECT fp_id AS rec_id, text FROM fingerprinted_texts UNION ALL SELECT risk_id, excerpt FROM risk_items),
w AS (SELECT rec_id, unnest(range(0, length(text) - 79)) AS s, text FROM recs WHERE length(text) >= 80),
x AS (SELECT rec_id, s, text[s + 1:s + 80] AS piece FROM w),
shared AS (SELECT piece FROM x GROUP BY piece HAVING min(rec_id) <> max(rec_id)),
hits AS (SELECT rec_id, s FROM x SEMI JOIN shared USING (piece)),
f AS (SELECT *, CASE WHEN s <= lag(s) OVER (PARTITION BY rec_id ORDER BY s) + 80 THEN 0 ELSE 1 END AS fresh FROM hits),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY rec_id ORDER BY s) AS island FROM f),
spans AS (SELECT rec_id, min(s) AS span_start, max(s) + 80 AS span_end FROM i GROUP BY rec_id, island)"""
_DOI = "regexp_extract(lower(trim(doi)), '^(?:https?://)?(?:(?:dx\\.|www\\.)?doi\\.org/)?(?:doi:?\\s*)?(10\\.\\d{4,9}(?:\\.\\d+)*/\\S*[^\\s/.])$', 1)"
_SOURCE = "regexp_replace(lower(trim(lit_records.lit_source)), '[\\s_-]+', '-', 'g')"
_PLAIN = "trim(regexp_replace(regexp_replace(abstract, '<[^<>]{1,60}>', ' ', 'g'), '\\s+', ' ', 'g'))"
SQL: dict[str, str] = {
    "p1_found": f"{_P1} SELECT rec_id, span_start, span_end FROM spans",
    "p1_shared_amount": f"{_P1}, t AS (SELECT rec_id, count(*) AS n_spans, sum(span_end - span_start)::BIGINT AS shared_chars FROM spans GROUP BY rec_id) SELECT rec_id, coalesce(length(text), 0) AS n_chars, coalesce(n_spans, 0) AS n_spans, coalesce(shared_chars, 0) AS shared_chars, CASE WHEN coalesce(length(text), 0) = 0 THEN 0 ELSE coalesce(shared_chars, 0) / length(text)::DOUBLE END AS shared_share FROM recs LEFT JOIN t USING (rec_id)",
    "p3_found": f"""WITH r AS (SELECT group_id, rec_id, {_DOI} AS doi, {_PLAIN} AS abstract, citation_count, retrieved_at, t.trust_rank FROM lit_records JOIN dup_groups USING (rec_id) LEFT JOIN source_trust t ON t.lit_source = {_SOURCE}),
v AS (SELECT group_id, rec_id, 'doi' AS field_name, 0 AS score FROM r WHERE doi <> ''
UNION ALL SELECT group_id, rec_id, 'abstract', 0 FROM r a WHERE regexp_matches(abstract, '[.。!！?？]$') AND NOT regexp_matches(abstract, '\\.\\.+$') AND lower(abstract) NOT IN ('no abstract available.') AND NOT EXISTS (SELECT 1 FROM r b WHERE b.group_id = a.group_id AND length(b.abstract) > length(a.abstract) AND starts_with(b.abstract, a.abstract))
UNION ALL SELECT group_id, rec_id, 'citation_count', epoch_us(retrieved_at) FROM r WHERE citation_count >= 0
UNION ALL SELECT group_id, rec_id, 'lit_source', -trust_rank FROM r WHERE trust_rank IS NOT NULL),
b AS (SELECT *, max(score) OVER (PARTITION BY group_id, field_name) AS best FROM v)
SELECT group_id, field_name, min(rec_id) AS rec_id FROM b WHERE score = best GROUP BY group_id, field_name HAVING count(*) = 1""",
}


# Characters that look alike, written out for the comparing engine: its own table, not the operator's.
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_NARROW = "".join(map(chr, range(0x21, 0x7F)))
_BLANKS = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
_OTHER = "АВЕЅІЈКМНОРСТУХаеорсухѕіјΑΒΕΖΗΙΚΜΝΟΡΤΥΧοѐёїΐӓӗ"
_LATIN = "ABESIJKMHOPCTYXaeopcyxsijABEZHIKMNOPTYXoèëïΐäĕ"
_RADICALS = "".join(map(chr, range(0x2F00, 0x2FD6)))
_GONE = "[\u00ad\u034f\u061c\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff]"


def _look_sql() -> str:
    """Pairs by a visual form made with the engine's own functions: characters mapped one by one, then composed."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    text = f"nfc_normalize(translate(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '{_GONE}', '', 'g'), {quote(_WIDE + _BLANKS + _OTHER + _RADICALS)}, {quote(_NARROW + ' ' * len(_BLANKS) + _LATIN + unicodedata.normalize('NFKC', _RADICALS))}))"
    for ligature, letters in {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "…": "..."}.items():
        text = f"replace({text}, '{ligature}', '{letters}')"
    return f"WITH t AS (SELECT fp_id AS id, text FROM fingerprinted_texts UNION ALL SELECT docx_id, text FROM docx_contents), v AS (SELECT id, text, md5({text}) AS look FROM t)"


SQL["p4_found"] = f"{_look_sql()} SELECT a.id AS text_id_a, b.id AS text_id_b FROM v a JOIN v b ON a.look = b.look AND a.id < b.id AND a.text <> b.text"
