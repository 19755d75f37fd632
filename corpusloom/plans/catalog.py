"""Queries of the core over whole tables, each with its SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import citations as C
from corpusloom.operators import facts as K
from corpusloom.operators import literature as L
from corpusloom.operators import overlap as O
from corpusloom.operators import profile as P
from corpusloom.operators import segments as S
from corpusloom.operators import style as Y
from corpusloom.plans import fixtures as X
from corpusloom.plans import sql as Q
from corpusloom.runtime import materialize, new_path, spread, table
from corpusloom.streaming import cards

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
THRESHOLD = 0.3


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text", "source", "workspace", "file_path"))


def _with_fixtures(spark: SparkSession, d: str, texts: list[tuple[int, str]]) -> DataFrame:
    """``(doc_id, text)`` of the documents and of a few literal texts, for rules that the tables seldom meet."""
    return _docs(spark, d).select("doc_id", "text").unionByName(spark.createDataFrame(texts, "doc_id bigint, text string"))


def _paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return S.paragraphs(_docs(spark, d), "doc_id").withColumn("segment_id", F.concat_ws(":", "doc_id", "line_start"))


# text


@query(f"SELECT doc_id, md5({Q.norm('text')}) AS digest, length({Q.norm('text')}) AS n_chars FROM documents")
def normalize_text(spark, d):
    rows = _docs(spark, d).select("doc_id", T.normal(F.col("text")).alias("n"))
    return rows.select("doc_id", F.md5("n").alias("digest"), F.char_length("n").cast("bigint").alias("n_chars"))


@query(f"{Q.LINES} SELECT kind, count(*) AS n_lines FROM lines GROUP BY kind")
def line_kinds(spark, d):
    return S.text_lines(_docs(spark, d), "doc_id").groupBy("kind").agg(F.count(F.lit(1)).alias("n_lines"))


@query(f"{Q.PARAGRAPHS} SELECT doc_id, line_start, line_end, n_chars, md5(raw) AS digest FROM paragraphs")
def segment_paragraphs(spark, d):
    return _paragraphs(spark, d).select("doc_id", "line_start", "line_end", "n_chars", F.md5("raw").alias("digest"))


@query(f"{Q.ALL_PARAGRAPHS}, n AS (SELECT doc_id, count(*) FILTER (n_chars >= 30) AS kept, count(*) FILTER (n_chars < 30) AS skipped_short FROM every_paragraph GROUP BY doc_id) SELECT doc_id, coalesce(kept, 0) AS kept, coalesce(skipped_short, 0) AS skipped_short FROM documents LEFT JOIN n USING (doc_id)")
def segment_short_counts(spark, d):
    return S.segment_counts(_docs(spark, d), "doc_id")


@query(f"{Q.style('documents')} SELECT doc_id, line_start, md5(raw) AS digest, length(raw) AS n_chars FROM style_paragraphs")
def style_segments(spark, d):
    return S.style_paragraphs(_docs(spark, d), "doc_id").select("doc_id", "line_start", F.md5("raw").alias("digest"), F.char_length("raw").cast("bigint").alias("n_chars"))


@query(f"SELECT doc_id, {Q.cjk('text')} AS n_cjk, CASE WHEN text IS NULL OR trim(text) = '' THEN 'missing' WHEN regexp_matches(text, '(?m)^\\s*- \\[x\\]') OR {Q.cjk('text')} > 300 THEN 'written' ELSE 'template' END AS state FROM documents WHERE lower(trim(source)) = 'chapter'")
def chapter_states(spark, d):
    chapters = _docs(spark, d).filter(F.lower(F.trim("source")) == "chapter").withColumn("template", F.lit(200))
    return S.written_chapters(chapters, "doc_id", "template")


@query(f"WITH n AS MATERIALIZED (SELECT doc_id, {Q.norm('text')} AS n FROM documents), g AS (SELECT DISTINCT doc_id, substring(n, i, 4) AS piece FROM (SELECT doc_id, n, unnest(range(1, greatest(length(n) - 2, 2))) AS i FROM n WHERE n <> '')) SELECT doc_id, count(piece) AS n_shingles FROM documents LEFT JOIN g USING (doc_id) GROUP BY doc_id")
def shingle_counts(spark, d):
    rows = _docs(spark, d).select("doc_id", T.normal(F.coalesce("text", F.lit(""))).alias("n"))
    return rows.select("doc_id", F.size(T.shingles(F.col("n"), 4)).cast("bigint").alias("n_shingles"))


@query("WITH t AS (SELECT DISTINCT title AS label FROM lit_records WHERE title <> '' UNION SELECT 'a😀b'), u AS (SELECT label, flatten(list_transform(list_transform(string_split(label, ''), lambda c: unicode(c)::BIGINT), lambda p: CASE WHEN p > 65535 THEN [55296 + ((p - 65536) >> 10), 56320 + ((p - 65536) & 1023)] ELSE [p] END)) AS units FROM t) SELECT label, list_reduce(list_prepend(2166136261::BIGINT, units), lambda h, x: (xor(h, x) * 16777619) & 4294967295) AS hash FROM u")
def shingle_hash_fnv(spark, d):
    titles = table(spark, d, "lit_records").filter("title <> ''").select(F.col("title").alias("label")).union(spark.createDataFrame([("a😀b",)], "label string")).distinct()
    return titles.select("label", T.fnv1a(F.col("label")).alias("hash"))


@query(f"SELECT doc_id, {Q.cjk('text')} AS n_cjk, {Q.clip('text', 60)} AS head FROM documents")
def cjk_counts(spark, d):
    return _docs(spark, d).select("doc_id", T.cjk_count(F.col("text")).cast("bigint").alias("n_cjk"), T.clip(F.col("text"), 60).alias("head"))


@query(f"SELECT lower(trim(source)) AS source, sum({Q.cjk('text')})::BIGINT AS n_cjk, count(*) FILTER ({Q.cjk('text')} < 200) AS too_short, count(*) FILTER ({Q.cjk('text')} > 2000) AS too_long, sum(CASE WHEN {Q.cjk('text')} < 200 THEN {Q.cjk('text')} - 200 WHEN {Q.cjk('text')} > 2000 THEN {Q.cjk('text')} - 2000 ELSE 0 END)::BIGINT AS distance FROM documents GROUP BY 1")
def char_counts_range(spark, d):
    rows = _docs(spark, d).select(F.lower(F.trim("source")).alias("source"), T.cjk_count(F.col("text")).alias("n"))
    off = C.range_check(F.col("n"), F.lit(200), F.lit(2000))
    return rows.groupBy("source").agg(F.sum("n").alias("n_cjk"), F.count_if(off < 0).alias("too_short"), F.count_if(off > 0).alias("too_long"), F.sum(off).alias("distance"))


@query(f"{Q.KEYWORDS} SELECT risk_id, array_to_string(words, ' ') AS words FROM kw")
def recall_keywords(spark, d):
    return table(spark, d, "risk_items").select("risk_id", F.array_join(T.keywords(F.col("excerpt")), " ").alias("words"))


@query("SELECT kind, count(*) AS n_docs, sum(n)::BIGINT AS n_elements FROM (SELECT doc_id, kind, len(list_distinct(hits)) AS n FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, regexp_extract_all(text, {Q.quote(p)}, {1 if k == 'term' else 0}) AS hits FROM documents" for k, p in T.PROTECTED.items()) + ")) WHERE n > 0 GROUP BY kind")
def rewrite_protected(spark, d):
    found = _docs(spark, d).select("doc_id", F.explode(T.protected_elements(F.col("text"))).alias("e")).groupBy("doc_id", "e.kind").agg(F.count(F.lit(1)).alias("n"))
    return found.groupBy("kind").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_elements"))


@query("SELECT fp_id, length(text) AS n, CASE WHEN length(text) = 0 THEN 1 ELSE 1 - len(regexp_extract_all(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]')) / length(text)::DOUBLE END AS printable, CASE WHEN length(text) = 0 THEN 0 ELSE (length(text) - length(replace(text, chr(65533), ''))) / length(text)::DOUBLE END AS unreadable FROM fingerprinted_texts")
def text_quality(spark, d):
    return table(spark, d, "fingerprinted_texts").select("fp_id", T.quality(F.col("text")).alias("q")).select("fp_id", "q.*")


# overlap


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    # written once: the normal form is referred to many times below
    return materialize(table(spark, d, "eval_items").select(F.col("item_id").alias("corpus_id"), T.normal(F.col("text")).alias("normalised")), "corpus")


def _hits(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    segments, corpus = materialize(_paragraphs(spark, d), "paragraphs"), _corpus(spark, d)
    return segments, corpus, materialize(O.containment_hits(segments, corpus), "hits")


def _best(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    segments, corpus, hits = _hits(spark, d)
    return segments, O.best_hits(hits, segments, corpus)


@query(f"{Q.HITS} SELECT segment_id, corpus_id, common, containment, jaccard FROM hits")
def containment_hits(spark, d):
    return O.containment_hits(_paragraphs(spark, d), _corpus(spark, d))


@query(f"{Q.BEST} SELECT segment_id, corpus_id, score FROM best")
def best_hit(spark, d):
    return _best(spark, d)[1]


@query(f"{Q.BEST}, leveled AS ({Q.LEVELED}) SELECT {Q.SUMMARY} FROM leveled")
def risk_summary(spark, d):
    return O.risk_summary(*_best(spark, d), THRESHOLD)


@query(f"{Q.BEST}, leveled AS ({Q.LEVELED}) SELECT chapter, line_start, line_end, risk_level, score, corpus_id, {Q.clip('raw', 120)} AS excerpt FROM leveled WHERE risk_level <> 'low' ORDER BY score DESC, chapter, line_start")
def top_risks(spark, d):
    segments, best = _best(spark, d)
    return O.top_risks(segments.withColumn("chapter", F.col("doc_id")), best, THRESHOLD)


@query(f"{Q.BEST}, leveled AS ({Q.LEVELED}), before AS (SELECT {Q.SUMMARY} FROM leveled), after AS (SELECT {Q.SUMMARY} FROM leveled JOIN documents d ON d.doc_id = leveled.doc_id WHERE lower(trim(d.source)) = 'chapter') SELECT before.weighted_rate - after.weighted_rate AS rate_drop, CASE WHEN before.weighted_rate = 0 THEN 0 ELSE (before.weighted_rate - after.weighted_rate) / before.weighted_rate END AS rate_drop_ratio, before.high - after.high AS high_drop, before.medium - after.medium AS medium_drop, CASE WHEN after.high > 0 THEN 'high_left' WHEN before.weighted_rate - after.weighted_rate <= 0 AND before.weighted_rate > 0 THEN 'no_drop' WHEN (before.weighted_rate - after.weighted_rate) / before.weighted_rate >= 0.5 THEN 'reached' ELSE 'limited' END AS verdict FROM before, after")
def rate_delta(spark, d):
    segments, best = _best(spark, d)
    best = materialize(best, "best")
    chapters = table(spark, d, "documents").filter(F.lower(F.trim("source")) == "chapter").select("doc_id")
    return O.rate_delta(O.risk_summary(segments, best, THRESHOLD), O.risk_summary(segments.join(chapters, "doc_id"), best, THRESHOLD))


@query(Q.CROSS)
def cross_document_scan(spark, d):
    """Paragraphs of chapters against all other documents of their workspace, by the reference's defaults."""
    docs = _docs(spark, d)
    written = docs.filter(F.lower(F.trim("source")) == "chapter")
    segments = S.paragraphs(written.select(F.struct("doc_id", "workspace").alias("at"), "text"), "at")
    segments = segments.select(F.concat_ws(":", "at.doc_id", "line_start").alias("segment_id"), F.col("at.doc_id").alias("own_id"), "at.workspace", "normalised")
    corpus = docs.select(F.col("doc_id").alias("corpus_id"), "workspace", T.normal(F.col("text")).alias("normalised")).join(written.select("workspace").distinct(), "workspace", "left_semi")
    return O.containment_hits(segments, corpus, least=THRESHOLD, scope="workspace")


@query()
def match_spans(spark, d):
    segments, best = _best(spark, d)
    items = _corpus(spark, d).withColumnRenamed("normalised", "b")
    pairs = best.join(segments.select("segment_id", F.col("normalised").alias("a"), "raw", "line_start"), "segment_id").join(items, "corpus_id")
    return O.match_spans(pairs)


@query(f"SELECT * FROM (VALUES ('full', 120, 30, 4, 6, 0.125), ('no levels', 8, 2, 0, 0, 0.5)) v(name, paragraph_count, matched_count, high, medium, weighted_rate)")
def report_baselines(spark, d):
    """Figures of earlier reports; one that lacks the rate is no baseline."""
    return O.report_baseline(spark.createDataFrame(X.REPORTS, "name string, text string")).select("name", "paragraph_count", "matched_count", "high", "medium", "weighted_rate")


@query("SELECT risk_id, greatest(0, least(1, CASE WHEN score * 100 > 1 THEN score * 100 / 100 ELSE score * 100 END)) AS rate FROM risk_items")
def detected_rates(spark, d):
    return table(spark, d, "risk_items").select("risk_id", O.detected_rate(F.col("score") * 100).alias("rate"))


# style


@query(f"{Q.FINDINGS} SELECT doc_id, rule, level, hit, line FROM findings")
def style_findings(spark, d):
    return Y.style_findings(_with_fixtures(spark, d, X.CHAPTERS), "doc_id")


@query(f"{Q.FINDINGS} SELECT coalesce(doc_id::VARCHAR, 'all') AS doc_id, count(*) AS n_findings, count(*) FILTER (level = 'error') AS n_errors, count(DISTINCT rule) AS n_rules, count(*) FILTER (level = 'error') = 0 AS is_clean FROM findings GROUP BY ROLLUP (doc_id)")
def finding_totals(spark, d):
    totals = Y.finding_totals(Y.style_findings(_with_fixtures(spark, d, X.CHAPTERS), "doc_id"), "doc_id")
    return totals.withColumn("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("all")))


@query(f"{Q.style('documents')} SELECT doc_id, line_start, raw[1:40] AS excerpt FROM style_paragraphs WHERE {Q.cjk('raw')} >= 100 AND NOT regexp_matches(raw, '\\d') AND NOT regexp_matches(raw, {Q.quote(Y.ANCHORS)}) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line_start) <= 5")
def anchorless(spark, d):
    return Y.anchorless(S.style_paragraphs(_docs(spark, d), "doc_id"), "doc_id")


@query(f"{Q.style(Q.plus(X.CHAPTERS))}, o AS (SELECT *, raw[1:6] AS opening FROM style_paragraphs), f AS (SELECT *, CASE WHEN opening = lag(opening) OVER (PARTITION BY doc_id ORDER BY line_start) THEN 0 ELSE 1 END AS fresh FROM o), r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY line_start) AS run FROM f) SELECT doc_id, any_value(opening) AS opening, min(line_start) AS line_start, count(*) AS n_paragraphs FROM r GROUP BY doc_id, run HAVING count(*) >= 3")
def opening_runs(spark, d):
    return S.opening_runs(_with_fixtures(spark, d, X.CHAPTERS), "doc_id")


@query(f"SELECT doc_id, len(h) AS n_hits, array_to_string(list_transform(list_sort(list_transform(list_distinct(h), lambda x: {{'p': list_position(h, x), 'x': x}}))[1:5], lambda s: s.x), '、') AS samples FROM (SELECT doc_id, regexp_extract_all(text, {Q.quote(Y.PLACEHOLDER)}) AS h FROM {Q.plus(X.CHAPTERS)}) WHERE len(h) > 0")
def placeholder_scan(spark, d):
    return Y.placeholders(_with_fixtures(spark, d, X.CHAPTERS), "doc_id").withColumn("n_hits", F.col("n_hits").cast("bigint"))


@query(rf"SELECT doc_id, len(regexp_extract_all(text, '(?m)^[ \t]*- \[x\]')) AS checked, len(regexp_extract_all(text, '(?m)^[ \t]*- \[ \]')) AS unchecked FROM {Q.plus(X.CHAPTERS)}")
def checklist_state(spark, d):
    rows = Y.checklist(_with_fixtures(spark, d, X.CHAPTERS), "doc_id")
    return rows.select("doc_id", F.col("checked").cast("bigint"), F.col("unchecked").cast("bigint"))


@query(rf"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM {Q.plus(X.CHAPTERS)}), h AS (SELECT *, last_value(CASE WHEN regexp_matches(line, '^#{{1,6}} ') THEN trim(regexp_extract(line, '^#{{1,6}} (.*)', 1)) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n) AS section FROM l) SELECT doc_id, coalesce(section, '') AS section, count(*) FILTER (regexp_matches(line, '^[ \t]*- \[x\]')) AS checked, count(*) FILTER (regexp_matches(line, '^[ \t]*- \[ \]')) AS unchecked FROM h GROUP BY 1, 2 HAVING count(*) FILTER (regexp_matches(line, '^[ \t]*- \[[x ]\]')) > 0")
def section_checklists(spark, d):
    return Y.section_checklists(_with_fixtures(spark, d, X.CHAPTERS), "doc_id")


@query("SELECT * FROM (VALUES (-21, 1, '# 一'), (-21, 2, '## 二' || chr(10) || '- 点')) v(doc_id, slide_no, slide)")
def slide_split(spark, d):
    return Y.slides(spark.createDataFrame(X.DECKS, "doc_id bigint, text string"), "doc_id")


@query(f"{Q.SENTENCES} SELECT doc_id, count(*) AS n_sentences, sum(length(sentence))::BIGINT AS n_chars, max(length(sentence)) AS longest FROM sentences GROUP BY doc_id")
def sentence_split(spark, d):
    n = F.char_length("sentence").cast("bigint")
    return Y.sentences(_with_fixtures(spark, d, X.CHAPTERS), "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sentences"), F.sum(n).alias("n_chars"), F.max(n).alias("longest"))


@query(f"{Q.SENTENCES}, hints AS (SELECT doc_id, 'split' AS hint, {Q.clip('sentence', 40)} AS target FROM sentences WHERE length(sentence) >= 40 OR regexp_matches(sentence, {Q.quote(Y.SPLIT_MARKS)}) UNION ALL SELECT doc_id, 'voice', regexp_extract(sentence, '被[^，。；]{{1,20}}(?:用于|采用|实现|提出|设计|完成)') FROM sentences UNION ALL SELECT doc_id, 'parallel', CASE WHEN regexp_extract(sentence, '不仅[^，。]{{1,40}}而且') <> '' THEN regexp_extract(sentence, '不仅[^，。]{{1,40}}而且') ELSE regexp_extract(sentence, '既[^，。]{{1,40}}又') END FROM sentences UNION ALL SELECT doc_id, 'connector', regexp_extract(sentence, {Q.quote(Y.SPLIT_MARKS)}) FROM sentences UNION ALL SELECT doc_id, 'delete', regexp_extract(sentence, {Q.quote(Y.FILLERS)}) FROM sentences UNION ALL SELECT doc_id, 'reorder', regexp_extract(sentence, '^(?:基于|针对|随着|通过)[^，。]{{1,24}}[，,]') FROM sentences) SELECT doc_id, hint, count(*) AS n_hints, min(target) AS least, max(target) AS greatest FROM hints WHERE target <> '' GROUP BY doc_id, hint")
def rewrite_hints(spark, d):
    found = Y.rewrite_hints(Y.sentences(_with_fixtures(spark, d, X.CHAPTERS), "doc_id"))
    return found.groupBy("doc_id", "hint").agg(F.count(F.lit(1)).alias("n_hints"), F.min("target").alias("least"), F.max("target").alias("greatest"))


@query(f"SELECT risk_id, CASE risk_level WHEN 'high' THEN '高' WHEN 'medium' THEN '中' ELSE '低' END AS label, coalesce(regexp_matches(source_label, {Q.quote(Y.EXTERNAL)}), false) AS cite FROM risk_items")
def risk_labels(spark, d):
    return table(spark, d, "risk_items").select("risk_id", Y.level_label(F.col("risk_level")).alias("label"), Y.citation_needed(F.col("source_label")).alias("cite"))


@query("SELECT risk_id, CASE WHEN r > 0 THEN '+' ELSE '' END || CASE WHEN r = round(r) THEN r::INT::VARCHAR ELSE printf('%.1f', r) END AS drop FROM (SELECT risk_id, floor((score - 0.5) * 100 * 10 + 0.5) / 10 AS r FROM risk_items)")
def signed_rates(spark, d):
    return table(spark, d, "risk_items").select("risk_id", T.signed((F.col("score") - 0.5) * 100).alias("drop"))


@query(f"SELECT * FROM {Q.values(X.DATES, 'answer, year, month, day, problem')}")
def date_checks(spark, d):
    rows = spark.createDataFrame([(x[0],) for x in X.DATES], "answer string").withColumn("parts", T.date_parts(F.col("answer")))
    part = lambda name: F.coalesce(F.col("parts")[name], F.lit(0)).alias(name)
    return rows.select("answer", part("year"), part("month"), part("day"), F.coalesce(T.date_problem(F.col("parts"), 2026), F.lit("")).alias("problem"))


@query("SELECT doc_id, regexp_replace(regexp_replace(regexp_extract(file_path, '([^/]*)$', 1), '\\.[^.]*$', ''), '[:*?\"<>|]', '_', 'g') || '.md' AS name FROM documents WHERE file_path IS NOT NULL")
def summary_names(spark, d):
    return _docs(spark, d).filter("file_path IS NOT NULL").select("doc_id", T.summary_name(F.col("file_path")).alias("name"))


@query(f"SELECT * FROM {Q.values(X.COMMANDS, 'command, rule')}")
def command_rules(spark, d):
    rows = spark.createDataFrame([(c,) for c, _ in X.COMMANDS], "command string")
    return rows.select("command", cards.first_rule(F.col("command"), cards.DESTRUCTIVE).alias("rule"))


# citations


@query(f"{Q.CITED} SELECT doc_id, number FROM cited")
def citation_numbers(spark, d):
    return C.cited(_with_fixtures(spark, d, X.CHAPTERS), "doc_id")


@query(f"{Q.CITED}, lib AS (SELECT workspace, unnest(range(1, count(*) + 1)) AS number FROM bib_entries GROUP BY workspace), used AS (SELECT DISTINCT workspace, number FROM cited JOIN documents USING (doc_id)) SELECT workspace, number, CASE WHEN l.there IS NULL THEN 'out_of_range' WHEN u.used IS NULL THEN 'uncited' ELSE 'cited' END AS state FROM (SELECT *, true AS used FROM used) u FULL JOIN (SELECT *, true AS there FROM lib) l USING (workspace, number)")
def citation_reconcile(spark, d):
    """Numbers cited in a workspace's documents against the places of its own reference list."""
    used = _docs(spark, d).select("workspace", F.explode(T.cited_numbers(F.col("text"))).alias("number"))
    library = table(spark, d, "bib_entries").groupBy("workspace").agg(F.count(F.lit(1)).alias("n")).select("workspace", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias("number"))
    return C.reconcile(used, library, "workspace")


@query(f"{Q.CITED}, r AS (SELECT workspace, number, row_number() OVER (PARTITION BY workspace ORDER BY number) AS place FROM (SELECT DISTINCT workspace, number FROM cited JOIN documents USING (doc_id) WHERE number >= 1)) SELECT workspace, min(place) AS first_gap FROM r WHERE number > place GROUP BY workspace")
def citation_first_gap(spark, d):
    used = _docs(spark, d).select("workspace", F.explode(T.cited_numbers(F.col("text"))).alias("number"))
    return C.first_gap(used, "workspace", "number")


@query("WITH r AS (SELECT l_orderkey, n, row_number() OVER (PARTITION BY l_orderkey ORDER BY n) AS place FROM (SELECT DISTINCT l_orderkey, l_linenumber AS n FROM lineitem WHERE l_returnflag <> 'R')) SELECT l_orderkey, min(place) AS first_gap FROM r WHERE n > place GROUP BY l_orderkey")
def line_gap_check(spark, d):
    """A relational analogue of the gap check, over order lines that were not returned."""
    return C.first_gap(table(spark, d, "lineitem").filter("l_returnflag <> 'R'").select("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber")


@query(f"{Q.LINES} SELECT DISTINCT doc_id, regexp_extract(line, '^#{{1,6}}\\s+(\\d+(?:\\.\\d+)*)\\s', 1) AS number FROM lines WHERE regexp_extract(line, '^#{{1,6}}\\s+(\\d+(?:\\.\\d+)*)\\s', 1) <> ''")
def heading_numbers(spark, d):
    return C.heading_numbers(S.text_lines(_docs(spark, d), "doc_id"), "doc_id")


@query(f"{Q.LINES}, have AS (SELECT DISTINCT workspace, regexp_extract(line, '^#{{1,6}}\\s+(\\d+(?:\\.\\d+)*)\\s', 1) AS number FROM lines JOIN documents USING (doc_id)), need AS (SELECT DISTINCT workspace, unnest(['1.1', '1.2', '2.1', '2.2', '3.1']) AS number FROM documents) SELECT workspace, number FROM need ANTI JOIN have USING (workspace, number)")
def outline_missing(spark, d):
    docs = _docs(spark, d)
    have = C.heading_numbers(S.text_lines(docs.select(F.struct("workspace", "doc_id").alias("at"), "text"), "at"), "at").select("at.workspace", "number").distinct()
    need = docs.select("workspace").distinct().select("workspace", F.explode(F.array(*map(F.lit, ["1.1", "1.2", "2.1", "2.2", "3.1"]))).alias("number"))
    return need.join(have, ["workspace", "number"], "left_anti")


@query(Q.OBJECTS)
def numbered_objects(spark, d):
    rows = spark.createDataFrame(X.CHAPTERS, "doc_id bigint, text string").unionByName(table(spark, d, "docx_contents").select(F.col("docx_id").alias("doc_id"), "text"))
    found = C.numbered_objects(rows.withColumn("chapter", F.lit(1)), "doc_id", "chapter", "[图表]")
    return found.select("doc_id", *(F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("n_own", "largest", "first_gap")), "foreign")


@query(Q.TERMS)
def term_order(spark, d):
    chapters = _with_fixtures(spark, d, X.CHAPTERS).join(_docs(spark, d).select("doc_id", "workspace"), "doc_id", "left")
    return C.terms_before_definition(chapters.filter("text IS NOT NULL").withColumn("workspace", F.coalesce("workspace", F.lit("-"))), "workspace", "doc_id")


@query(f"SELECT * FROM (VALUES {', '.join(map(str, X.TABLE_ROWS))}) v(doc_id, line_no, path, note)")
def markdown_tables(spark, d):
    rows = C.table_rows(S.text_lines(spark.createDataFrame(X.CHAPTERS, "doc_id bigint, text string"), "doc_id"), "doc_id")
    with_file = rows.filter(F.exists("cells", lambda c: c.rlike(r"\.[A-Za-z0-9]{1,5}$")))
    return with_file.select("doc_id", F.col("line_no").cast("bigint"), F.get("cells", F.lit(0)).alias("path"), F.get("cells", F.lit(1)).alias("note"))


# facts


def _facts(spark: SparkSession, d: str) -> DataFrame:
    """Scan results as a fact table: the workspace is the namespace."""
    risks = table(spark, d, "risk_items")
    at = F.unix_micros(F.col("scanned_at").cast("timestamp"))
    return risks.select(F.concat_ws(".", "workspace", F.col("risk_id").cast("string")).alias("key"), F.col("excerpt").alias("value"), F.col("risk_level").alias("type"), F.coalesce("source_label", F.lit("")).alias("source"), F.col("score").alias("confidence"), at.alias("created_at"), at.alias("updated_at"))


@query(f"{Q.FACTS} SELECT key, value, type, source, confidence, created_at, updated_at FROM facts WHERE contains(lower(key), 'corpus') OR contains(lower(value), 'corpus') ORDER BY key LIMIT 50")
def fact_search(spark, d):
    return K.search(_facts(spark, d), "corpus")


@query(f"{Q.FACTS} SELECT key, value, updated_at FROM facts WHERE key = 'ws-000007' OR starts_with(key, 'ws-000007.')")
def fact_context(spark, d):
    return K.context(_facts(spark, d), "ws-000007").select("key", "value", "updated_at")


@query(f"{Q.FACTS} SELECT split_part(key, '.', 1) AS namespace, count(*) AS n_facts, min(key) AS first_key, max(updated_at) AS last_updated FROM facts GROUP BY 1")
def fact_namespaces(spark, d):
    return K.namespaces(_facts(spark, d))


@query(f"{Q.FACTS}, k AS (SELECT split_part(key, '.', 1) || '.' || type AS key, value, type, source, confidence, created_at, updated_at FROM facts), b AS (SELECT *, 0 AS c FROM k WHERE updated_at % 2 = 0 UNION ALL SELECT *, 1 FROM k WHERE updated_at % 2 <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY c DESC, updated_at DESC, value DESC) AS last, first_value(created_at) OVER (PARTITION BY key ORDER BY c, created_at) AS born FROM b) SELECT key, value, type, source, confidence, updated_at, born AS created_at FROM r WHERE last = 1")
def fact_upsert(spark, d):
    facts = _facts(spark, d).withColumn("key", F.concat_ws(".", F.substring_index("key", ".", 1), "type"))
    return K.upsert(facts.filter("updated_at % 2 = 0"), facts.filter("updated_at % 2 <> 0"))


@query(f"{Q.FACTS} SELECT count(*) || ':' || max(updated_at) AS fingerprint FROM facts")
def fact_fingerprint(spark, d):
    return K.fingerprint(_facts(spark, d))


@query(f"{Q.FACTS} SELECT type, count(*) AS n, sum(('0x' || sha256(key || '=' || value)[1:15])::BIGINT)::VARCHAR AS fingerprint FROM facts GROUP BY type")
def table_fingerprint(spark, d):
    return K.table_fingerprint(_facts(spark, d), "type", "key", "value")


@query(f"SELECT group_id, sha256(string_agg(rec_id || '=' || coalesce(title, ''), '§' ORDER BY rec_id || '=' || coalesce(title, '')))[1:12] AS fingerprint FROM dup_groups JOIN lit_records USING (rec_id) GROUP BY group_id".replace("'§'", "chr(0)"))
def spec_fingerprint(spark, d):
    members = table(spark, d, "dup_groups").join(_lit(spark, d).select("rec_id", F.coalesce("title", F.lit("")).alias("title")), "rec_id")
    return K.content_fingerprint(members.withColumn("rec", F.col("rec_id").cast("string")), "group_id", "rec", "title", most=1_000_000)


@query(f"{Q.FACTS} SELECT type, problem, count(*) AS n FROM (SELECT type, CASE WHEN trim(key) = '' THEN 'empty_key' WHEN trim(coalesce(value, '')) = '' THEN 'empty_value' WHEN confidence < 0 OR confidence > 1 THEN 'confidence' END AS problem FROM (SELECT * FROM facts UNION ALL SELECT ' ', 'v', 'x', '', 0.5, 0, 0 UNION ALL SELECT 'k', 'v', 'x', '', 1.5, 0, 0 UNION ALL SELECT 'k', ' ', 'x', '', 0.5, 0, 0)) GROUP BY 1, 2")
def fact_checks(spark, d):
    more = spark.createDataFrame([(" ", "v", "x", "", 0.5, 0, 0), ("k", "v", "x", "", 1.5, 0, 0), ("k", " ", "x", "", 0.5, 0, 0)], _facts(spark, d).schema)
    return K.checked_facts(_facts(spark, d).union(more)).groupBy("type", "problem").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT group_id, '{' || string_agg('\"' || rec_id || '\":\"' || lit_type || '\"', ',' ORDER BY rec_id::VARCHAR) || '}' AS json FROM dup_groups JOIN lit_records USING (rec_id) GROUP BY group_id")
def stable_json(spark, d):
    members = table(spark, d, "dup_groups").join(_lit(spark, d).select("rec_id", "lit_type"), "rec_id")
    return K.stable_json(members.withColumn("rec", F.col("rec_id").cast("string")), "group_id", "rec", "lit_type", most=1_000_000)


def _messages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "docx_contents").select(F.col("docx_id").alias("message_id"), "text")


@query(Q.RECALL)
def recall_topk(spark, d):
    facts = _facts(spark, d)
    found = K.recall(facts, _messages(spark, d))
    return found.select("message_id", "key", "score", F.col("place").cast("bigint").alias("place"))


@query(f"{Q.FACTS}, l AS (SELECT split_part(key, '.', 1) AS namespace, key, '- ' || key || ' = ' || value AS line FROM facts), r AS (SELECT *, {len(K.CARD_HEADER)} + sum(length(line) + 1) OVER (PARTITION BY namespace ORDER BY key) AS run, count(*) OVER (PARTITION BY namespace) AS n FROM l) SELECT namespace, count(*) FILTER (run <= 600) AS n_lines, concat_ws(chr(10), {Q.quote(K.CARD_HEADER)}, string_agg(line, chr(10) ORDER BY key) FILTER (run <= 600), CASE WHEN count(*) FILTER (run <= 600) < any_value(n) THEN {Q.quote(K.CUT_MARK)} END)[1:600] AS card FROM r GROUP BY namespace")
def recall_card(spark, d):
    lines = _facts(spark, d).select(F.substring_index("key", ".", 1).alias("namespace"), "key", F.concat(F.lit("- "), "key", F.lit(" = "), "value").alias("line"))
    return K.cards(lines, "namespace", "key")


# literature


def _lit(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lit_records")


@query("SELECT rec_id, id, sha1(lower(trim(coalesce(doi, url, title))))[1:16] AS record_id FROM lit_records")
def lit_id(spark, d):
    return _lit(spark, d).select("rec_id", "id", L.record_id(F.col("doi"), F.col("url"), F.col("title")).alias("record_id"))


@query(f"SELECT rec_id, {Q.strip_tags('title')} AS title, CASE WHEN {Q.strip_tags('abstract')} = '' THEN NULL WHEN length({Q.strip_tags('abstract')}) > 600 THEN {Q.strip_tags('abstract')}[1:600] || '…' ELSE {Q.strip_tags('abstract')} END AS abstract, CASE WHEN regexp_matches(lower(coalesce(venue, '')), '{L.JOURNAL}') THEN 'article' WHEN regexp_matches(lower(coalesce(venue, '')), '{L.CONFERENCE}') THEN 'inproceedings' WHEN lower(trim(coalesce(lit_source, ''))) = 'arxiv' THEN 'misc' ELSE 'article' END AS lit_type, regexp_replace(lower(trim(lit_source)), '\\s+', '-', 'g') AS lit_source FROM lit_records")
def lit_harmonise(spark, d):
    preprint = F.lower(F.trim(F.coalesce("lit_source", F.lit("")))) == "arxiv"
    return _lit(spark, d).select("rec_id", T.strip_tags(F.col("title")).alias("title"), L.clean_abstract(F.col("abstract")).alias("abstract"), L.venue_type(F.col("venue"), preprint).alias("lit_type"), L.source_name(F.col("lit_source")).alias("lit_source"))


@query("SELECT id, rec_id FROM lit_records WHERE id IS NULL OR rec_id IN (SELECT min(rec_id) FROM lit_records GROUP BY id)")
def lit_dedupe(spark, d):
    return L.first_by_id(_lit(spark, d).select("id", "rec_id"), "id", ["rec_id"])


@query("WITH r AS (SELECT workspace, rec_id, list_position(['semantic-scholar', 'dblp', 'arxiv', 'crossref'], regexp_replace(lower(trim(lit_source)), '\\s+', '-', 'g')) AS rank FROM lit_records) SELECT workspace, rec_id FROM r JOIN (SELECT workspace, min(rank) AS rank FROM r WHERE rank > 0 GROUP BY workspace) USING (workspace, rank)")
def lit_fallback(spark, d):
    rows = _lit(spark, d).select("workspace", "rec_id", L.source_name(F.col("lit_source")).alias("source"))
    return L.first_source(rows, "workspace", "source").select("workspace", "rec_id")


@query("SELECT workspace, rec_id, coalesce(citation_count, pub_year, 0) AS score, row_number() OVER (PARTITION BY workspace ORDER BY coalesce(citation_count, pub_year, 0) DESC, rec_id) AS place FROM lit_records QUALIFY place <= 10")
def lit_rank(spark, d):
    ranked = L.rank_records(_lit(spark, d).select("workspace", "rec_id", "citation_count", "pub_year"), "workspace", 10)
    return ranked.select("workspace", "rec_id", "score", F.col("place").cast("bigint").alias("place"))


@query(f"WITH f AS (SELECT rec_id, {Q.doi('doi')} AS doi, lower(trim(lit_source)) AS s FROM lit_records), n AS (SELECT doi, rec_id FROM f WHERE s = 'arxiv' AND (doi IS NULL OR doi NOT IN (SELECT doi FROM f WHERE s = 'crossref' AND doi IS NOT NULL))) SELECT doi, min(rec_id) AS rec_id FROM n WHERE doi IS NOT NULL GROUP BY doi UNION ALL SELECT doi, rec_id FROM n WHERE doi IS NULL")
def bib_save(spark, d):
    """Records of one service that the records of another do not hold yet, by DOI however it is written."""
    rows = _lit(spark, d).select("rec_id", L.plain_doi(F.col("doi")).alias("doi"), F.lower(F.trim("lit_source")).alias("s"))
    fresh = L.new_records(rows.filter("s = 'arxiv'"), rows.filter("s = 'crossref'"), "doi", ["rec_id"])
    return fresh.select("doi", "rec_id")


@query(Q.CITE_KEYS)
def bib_cite_keys(spark, d):
    keys = L.cite_keys(_lit(spark, d))
    return keys


@query("SELECT rec_id, '@' || lit_type || '{' || id || ',' || chr(10) || array_to_string(list_filter(['  author = {' || coalesce(array_to_string(list_filter(list_transform(authors, lambda a: trim(a)), lambda a: a <> ''), ' and '), '') || '}', '  title = {' || coalesce(title, '') || '}', '  ' || CASE lit_type WHEN 'inproceedings' THEN 'booktitle' WHEN 'book' THEN 'publisher' WHEN 'phdthesis' THEN 'school' WHEN 'misc' THEN 'howpublished' ELSE 'journal' END || ' = {' || coalesce(nullif(venue, ''), CASE WHEN lit_type = 'misc' THEN 'Preprint' ELSE 'unknown' END) || '}', '  year = {' || coalesce(pub_year::VARCHAR, '') || '}', CASE WHEN doi <> '' THEN '  doi = {' || doi || '}' END, CASE WHEN url <> '' THEN '  url = {' || url || '}' END], lambda x: x IS NOT NULL), ',' || chr(10)) || chr(10) || '}' AS entry FROM lit_records")
def bibtex_entries(spark, d):
    names = ["lit_type", "authors", "title", "venue", "pub_year", "doi", "url"]
    return _lit(spark, d).select("rec_id", L.bibtex_entry(F.col("id"), *map(F.col, names)).alias("entry"))


# files and code


@query(f"SELECT CASE WHEN e IN ('docx', 'docm') THEN 'docx' WHEN e IN ('md', 'txt') THEN 'text' ELSE 'unsupported' END AS kind, count(*) AS n_files FROM (SELECT regexp_extract(lower(file_path), '\\.([^./]+)$', 1) AS e FROM documents WHERE file_path IS NOT NULL) GROUP BY 1")
def file_kinds(spark, d):
    return _docs(spark, d).filter("file_path IS NOT NULL").groupBy(P.file_kind(F.col("file_path")).alias("kind")).agg(F.count(F.lit(1)).alias("n_files"))


def _code(spark: SparkSession, d: str) -> DataFrame:
    """Fenced code of the documents as Python files, and literal files of other languages."""
    blocks = F.regexp_extract_all("text", F.lit(r"(?s)```[a-z]*\n(.*?)```"), 1)
    fenced = _docs(spark, d).select("doc_id", F.posexplode(blocks).alias("n", "text")).select(F.concat(F.col("doc_id").cast("string"), F.lit("-"), F.col("n").cast("string"), F.lit(".py")).alias("rel"), "text")
    return fenced.unionByName(spark.createDataFrame(X.SOURCES, "rel string, text string"))


_BLOCKS = rf"WITH b AS (SELECT doc_id, regexp_extract_all(text, '(?s)```[a-z]*\n(.*?)```', 1) AS l FROM documents), files AS (SELECT doc_id || '-' || n || '.py' AS rel, text FROM (SELECT doc_id, unnest(l) AS text, unnest(range(0, len(l))) AS n FROM b) UNION ALL SELECT rel, text FROM {Q.values(X.SOURCES, 'rel, text')}), x AS (SELECT rel, regexp_extract(rel, '[^.]+$') AS ext, string_split(text, chr(10)) AS l FROM files), y AS (SELECT *, CASE ext WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'go' THEN 'go' WHEN 'java' THEN 'java' WHEN 'sql' THEN 'sql' END AS language, CASE ext WHEN 'py' THEN '^\s*#' WHEN 'sql' THEN '^\s*--' ELSE '^\s*(//|/\*|\*)' END AS mark FROM x), counts AS (SELECT rel, language, len(l) AS lines, len(list_filter(l, lambda s: regexp_matches(s, '^\s*$'))) AS blank_lines, len(list_filter(l, lambda s: regexp_matches(s, mark))) AS comment_lines FROM y)"


@query(f"{_BLOCKS} SELECT rel, language, lines, blank_lines, comment_lines, lines - blank_lines - comment_lines AS code_lines, false AS truncated FROM counts")
def code_profile(spark, d):
    rows = P.line_counts(_code(spark, d), None)
    return rows.select("rel", "language", *(F.col(c).cast("bigint") for c in ("lines", "blank_lines", "comment_lines", "code_lines")), "truncated")


@query(f"{_BLOCKS} SELECT language, count(*) AS files, sum(lines)::BIGINT AS lines, sum(lines - blank_lines - comment_lines)::BIGINT AS code_lines FROM counts GROUP BY ROLLUP (language)")
def language_rollup(spark, d):
    return P.language_rollup(P.line_counts(_code(spark, d), None))


@query(f"SELECT * FROM {Q.values(X.DECLARED, 'rel, language, kind, name, line')}")
def code_declarations(spark, d):
    """The fenced code of the documents declares nothing: the rows are those of the literal files."""
    return P.declarations(_code(spark, d), None, None).withColumn("line", F.col("line").cast("bigint"))


@query(f"SELECT * FROM {Q.values(X.STACK, 'name, evidence')}")
def tech_stack(spark, d):
    return P.tech_stack(spark.createDataFrame(X.MANIFESTS, "rel string, text string"))


@query(f"{_BLOCKS} SELECT rel, lines, row_number() OVER (ORDER BY lines DESC, rel) AS place FROM counts QUALIFY place <= 20")
def largest_files(spark, d):
    """Listing order of files: by lines, then by name; a top list, so nothing is sorted as a whole."""
    return P.largest(P.line_counts(_code(spark, d), None), 20)


# events and relational analogues


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_counts(spark, d):
    """The streaming aggregate, run over the whole table at once."""
    return cards.windowed_counts(table(spark, d, "events"), "ts", "event_type")


@query("SELECT user_id, event_type AS state, event_id FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL) WHERE before IS DISTINCT FROM event_type")
def stream_changes(spark, d):
    """Events replayed as a stream, by user: only rows that differ from the user's last one."""
    return _replay(spark, d, lambda s: cards.changed_only(s.select("user_id", F.col("event_type").alias("state"), F.col("event_id").alias("seq"), "event_id"), "user_id", "state", ["event_id"]), "append")


@query("SELECT event_id, event_type FROM events WHERE regexp_matches(event_type, 'c') AND NOT regexp_matches(event_type, 'ck')")
def stream_gate(spark, d):
    """A stateless gate over a stream: rows that match a pattern and no bypass pattern."""
    gate = lambda s: cards.matching_messages(s.withColumn("text", F.col("event_type")), ["c"], ["ck"]).select("event_id", "event_type")
    return _replay(spark, d, gate, "append")


@query("SELECT event_id, CASE WHEN regexp_matches(event_type, 'click') THEN 'click' WHEN regexp_matches(event_type, 'e') THEN 'has e' END AS rule FROM events")
def stream_first_rule(spark, d):
    """The first rule that fits each row of a stream."""
    return _replay(spark, d, lambda s: s.select("event_id", cards.first_rule(F.col("event_type"), [("click", "click"), ("has e", "e")]).alias("rule")), "append")


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table as a stream of its files."""
    schema = table(spark, d, name).schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{d}/{name}.parquet*")


def _replay(spark: SparkSession, d: str, build: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """Run a stream over the events until its end, into a table of the shared folder."""
    stream = _stream(spark, d, "events")
    out, state = new_path(spark, "stream"), new_path(spark, "state")
    built = build(stream)
    built.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(built.schema).parquet(out)


@query(f"{Q.keywords('(SELECT * FROM docx_contents WHERE length(trim(text)) >= 8 AND NOT starts_with(trim(text), chr(47)) QUALIFY docx_id = min(docx_id) OVER (PARTITION BY workspace))', 'docx_id', 'text')}, {Q.FACTS[5:]}, hits AS (SELECT docx_id AS message_id, key, any_value(value) AS value, count(*) + 0.01 * coalesce(max(confidence), 0) AS score, max(updated_at) AS updated_at FROM (SELECT docx_id, unnest(words) AS word FROM kw) JOIN facts ON contains(lower(key || chr(10) || value), word) GROUP BY 1, 2), best AS (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY score DESC, updated_at DESC, key) AS place FROM hits QUALIFY place <= 4), r AS (SELECT *, {len(K.CARD_HEADER)} + sum(3 + length(key) + 3 + length(value)) OVER (PARTITION BY message_id ORDER BY place) AS run, count(*) OVER (PARTITION BY message_id) AS n FROM best) SELECT workspace AS agent_id, message_id, count(*) FILTER (run <= 600) AS n_lines, concat_ws(chr(10), {Q.quote(K.CARD_HEADER)}, string_agg('- ' || key || ' = ' || value, chr(10) ORDER BY place) FILTER (run <= 600), CASE WHEN count(*) FILTER (run <= 600) < any_value(n) THEN {Q.quote(K.CUT_MARK)} END)[1:600] AS card FROM r JOIN docx_contents ON docx_id = message_id GROUP BY workspace, message_id")
def stream_recall_cards(spark, d):
    """The first message of each workspace gets a card of the facts it recalls; later ones none until facts change."""
    messages = _stream(spark, d, "docx_contents").select(F.col("workspace").alias("agent_id"), F.col("docx_id").alias("message_id"), F.col("docx_id").alias("seq"), "text")
    out, state = new_path(spark, "cards"), new_path(spark, "state")
    cards.recall_cards(messages, _facts(spark, d), out, state).awaitTermination()
    return spark.read.schema("agent_id string, message_id bigint, fingerprint string, n_lines bigint, card string").parquet(f"{out}/*").select("agent_id", "message_id", "n_lines", "card")


@query("SELECT c_nationkey, c_custkey, c_acctbal FROM customer WHERE contains(c_name, '1') QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 3")
def customer_topk(spark, d):
    """A relational analogue of substring search with a top list per group."""
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey"))
    return table(spark, d, "customer").filter(F.contains("c_name", F.lit("1"))).withColumn("place", place).filter("place <= 3").select("c_nationkey", "c_custkey", "c_acctbal")


@query("SELECT o_orderpriority, count(*) AS n_orders FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1")
def order_reconcile(spark, d):
    """A relational analogue of reconciliation: orders none of whose lines were returned."""
    returned = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(returned, "o_orderkey", "left_anti").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n_orders"))
