"""Fragments of the SQL that says the same as the operators, in the dialect of the comparing engine."""

from __future__ import annotations

from corpusloom.functions import text as T
from corpusloom.operators.style import RULES
from corpusloom.plans import fixtures as X


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def half(x: str) -> str:
    return f"regexp_replace(translate({x}, {quote(T.HALF_FROM)}, {quote(T.HALF_TO)}), '\\r\\n?', chr(10), 'g')"


def norm(x: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({half(x)}, {quote(T.TOKEN)}), lambda w: lower(w)), '')"


def shingles(x: str, n: int) -> str:
    return f"(CASE WHEN length({x}) = 0 THEN [] WHEN length({x}) <= {n} THEN [{x}] ELSE list_distinct(list_transform(range(1, length({x}) - {n} + 2), lambda i: substring({x}, i, {n}))) END)"


def cjk(x: str) -> str:
    return f"length(regexp_replace({x}, '[^一-鿿]', '', 'g'))"


def clip(x: str, most: int) -> str:
    flat = f"trim(regexp_replace({x}, '[\\s\\pZ]+', ' ', 'g'))"
    return f"(CASE WHEN length({flat}) > {most} THEN {flat}[1:{most}] || '…' ELSE {flat} END)"


def decode(x: str) -> str:
    for name, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'")):
        x = f"replace({x}, {quote(name)}, {quote(char)})"
    return x


def strip_tags(x: str) -> str:
    return decode(f"trim(regexp_replace(regexp_replace({decode(x)}, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))")


def values(rows: list[tuple], columns: str) -> str:
    cell = lambda v: "NULL" if v is None else quote(v) if isinstance(v, str) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") v({columns})"


def plus(rows: list[tuple[int, str]]) -> str:
    """The documents and literal texts, as a table."""
    return f"(SELECT doc_id, text FROM documents UNION ALL SELECT doc_id, text FROM {values(rows, 'doc_id, text')}) plus_docs"


def doi(x: str) -> str:
    return f"nullif(regexp_extract(lower(trim({x})), '(10\\.\\d{{4,9}}/\\S+)', 1), '')"


def keywords(table: str, key: str, text: str) -> str:
    """Keywords as a list, longest first, in the CTE ``kw(key, words)``."""
    parts = f"SELECT {key}, list_filter(regexp_extract_all(lower({text}), '[a-z][a-z0-9_.-]{{1,30}}'), lambda w: length(w) >= 2) AS latin, flatten(list_transform(regexp_extract_all({text}, '[一-龥]{{2,}}'), lambda r: CASE WHEN length(r) <= 4 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substring(r, i, 2)) END)) AS grams, [{', '.join(map(quote, T.STOP_WORDS))}] AS stop FROM {table}"
    return f"WITH parts AS ({parts}), kw AS (SELECT {key}, list_transform(list_sort(list_transform(list_filter(list_distinct(list_concat(latin, grams)), lambda w: NOT list_contains(stop, w)), lambda w: {{'n': -length(w), 'w': w}})), lambda s: s.w)[1:24] AS words FROM parts)"


def style(src: str) -> str:
    """Body paragraphs for the style rules: CTE ``style_paragraphs(doc_id, line_start, raw)``."""
    blank = "[\\s\\x0b\\pZ]+"
    return f"""WITH src AS (SELECT doc_id, replace(text, chr(13) || chr(10), chr(10)) AS whole FROM {src}),
line AS (SELECT doc_id, unnest(string_split(whole, chr(10))) AS line, unnest(range(1, len(string_split(whole, chr(10))) + 1)) AS n FROM src),
trimmed AS (SELECT *, regexp_replace(line, '^{blank}|{blank}$', '', 'g') AS t FROM line),
broken AS (SELECT *, t = '' OR regexp_matches(line, '^#{{1,6}}[ \\t]') AS brk FROM trimmed),
island AS (SELECT *, sum(CASE WHEN brk THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS island FROM broken),
style_paragraphs AS (SELECT doc_id, min(n) AS line_start, coalesce(string_agg(t, '' ORDER BY n) FILTER (NOT starts_with(t, '|') AND NOT starts_with(t, '- ')), '') AS raw FROM island WHERE NOT brk GROUP BY doc_id, island HAVING length(raw) > 20)"""


_PACKED = "regexp_replace(line, '\\s', '', 'g')"
_FORMULA = f"(regexp_matches(line, {quote(T.LINE_KINDS['formula'])}) OR (regexp_matches(line, '[$\\\\=]') AND length({_PACKED}) > 0 AND length({_PACKED}) - length(regexp_replace({_PACKED}, {quote(T.MATH_SIGNS)}, '', 'g')) >= length({_PACKED}) * 0.5))"
_KIND = "CASE WHEN regexp_matches(line, '^\\s*$') THEN 'blank' " + " ".join(f"WHEN {_FORMULA if k == 'formula' else f'regexp_matches(line, {quote(p)})'} THEN '{k}'" for k, p in T.LINE_KINDS.items()) + " ELSE 'text' END"
LINES = f"WITH split AS (SELECT doc_id, string_split({half('text')}, chr(10)) AS l FROM documents), lines AS (SELECT doc_id, line_no, line, {_KIND} AS kind FROM (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS line_no FROM split))"
_BODY = "(fences % 2 = 0 AND kind = 'text' AND ended = 0)"
PARAGRAPHS = f"""{LINES}, fenced AS (SELECT *, sum(CASE WHEN kind = 'fence' THEN 1 ELSE 0 END) OVER w AS fences FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
marked AS (SELECT *, max(CASE WHEN fences % 2 = 0 AND kind = 'reference_heading' THEN 1 ELSE 0 END) OVER w AS ended FROM fenced WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
islands AS (SELECT *, sum(CASE WHEN {_BODY} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM marked),
raw_paragraphs AS (SELECT doc_id, min(line_no) AS line_start, max(line_no) AS line_end, string_agg(line, chr(10) ORDER BY line_no) AS raw FROM islands WHERE {_BODY} GROUP BY doc_id, island),
every_paragraph AS MATERIALIZED (SELECT *, length(normalised) AS n_chars FROM (SELECT *, {norm('raw')} AS normalised FROM raw_paragraphs))"""
ALL_PARAGRAPHS = PARAGRAPHS
PARAGRAPHS += ", paragraphs AS (SELECT * FROM every_paragraph WHERE n_chars >= 30)"
HITS = f"""{PARAGRAPHS}, item AS MATERIALIZED (SELECT item_id, {norm('text')} AS n FROM eval_items),
a AS (SELECT segment_id, len(s) AS size, unnest(s) AS shingle FROM (SELECT doc_id || ':' || line_start AS segment_id, {shingles('normalised', 4)} AS s FROM paragraphs)),
b AS (SELECT corpus_id, len(s) AS size, unnest(s) AS shingle FROM (SELECT item_id AS corpus_id, {shingles('n', 4)} AS s FROM item)),
hits AS MATERIALIZED (SELECT segment_id, corpus_id, count(*) AS common, count(*) / any_value(a.size)::DOUBLE AS containment, count(*) / (any_value(a.size) + any_value(b.size) - count(*))::DOUBLE AS jaccard, any_value(a.size) <= any_value(b.size) AS a_narrow FROM a JOIN b USING (shingle) GROUP BY segment_id, corpus_id)"""
# Longest common runs of tied pairs: neighbouring equal shingles on a diagonal, of which one must be the first place of
# its shingle in the text that has fewer.
BEST = f"""{HITS}, top AS (SELECT * FROM hits QUALIFY containment = max(containment) OVER (PARTITION BY segment_id)),
tied AS (SELECT segment_id, corpus_id, a_narrow, normalised AS ta, n AS tb FROM (SELECT * FROM top QUALIFY count(*) OVER (PARTITION BY segment_id) > 1) t JOIN paragraphs p ON t.segment_id = p.doc_id || ':' || p.line_start JOIN item ON item_id = corpus_id),
pa AS (SELECT segment_id, corpus_id, i, substring(ta, i, 4) AS piece FROM (SELECT segment_id, corpus_id, ta, unnest(range(1, length(ta) - 2)) AS i FROM tied)),
pb AS (SELECT segment_id, corpus_id, j, substring(tb, j, 4) AS piece FROM (SELECT segment_id, corpus_id, tb, unnest(range(1, length(tb) - 2)) AS j FROM tied)),
fa AS (SELECT *, i = min(i) OVER (PARTITION BY segment_id, corpus_id, piece) AS first_a FROM pa),
fb AS (SELECT *, j = min(j) OVER (PARTITION BY segment_id, corpus_id, piece) AS first_b FROM pb),
cell AS (SELECT segment_id, corpus_id, i, i - j AS diagonal, CASE WHEN a_narrow THEN first_a ELSE first_b END AS probed FROM fa JOIN fb USING (segment_id, corpus_id, piece) JOIN tied USING (segment_id, corpus_id)),
run_of AS (SELECT *, i - row_number() OVER (PARTITION BY segment_id, corpus_id, diagonal ORDER BY i) AS run FROM cell),
longest AS (SELECT segment_id, corpus_id, max(n) AS longest FROM (SELECT segment_id, corpus_id, count(*) + 3 AS n FROM run_of GROUP BY segment_id, corpus_id, diagonal, run HAVING bool_or(probed)) WHERE n >= 8 GROUP BY 1, 2),
best AS (SELECT segment_id, corpus_id, containment AS score FROM top LEFT JOIN longest USING (segment_id, corpus_id) QUALIFY row_number() OVER (PARTITION BY segment_id ORDER BY coalesce(longest, 0) DESC, corpus_id) = 1)"""
CROSS = f"""{PARAGRAPHS}, whole AS MATERIALIZED (SELECT doc_id, workspace, {norm('text')} AS n FROM documents),
a AS (SELECT segment_id, doc_id, workspace, len(s) AS size, unnest(s) AS shingle FROM (SELECT doc_id || ':' || line_start AS segment_id, doc_id, workspace, {shingles('normalised', 4)} AS s FROM paragraphs JOIN documents USING (doc_id) WHERE lower(trim(source)) = 'chapter')),
b AS (SELECT corpus_id, workspace, len(s) AS size, unnest(s) AS shingle FROM (SELECT doc_id AS corpus_id, workspace, {shingles('n', 4)} AS s FROM whole))
SELECT segment_id, corpus_id, count(*) AS common, count(*) / any_value(a.size)::DOUBLE AS containment, count(*) / (any_value(a.size) + any_value(b.size) - count(*))::DOUBLE AS jaccard FROM a JOIN b USING (workspace, shingle) WHERE doc_id <> corpus_id GROUP BY 1, 2 HAVING count(*) / any_value(a.size)::DOUBLE >= 0.3"""
LEVELED = "SELECT p.doc_id, p.doc_id AS chapter, p.line_start, p.line_end, p.raw, p.n_chars, b.corpus_id, b.score, CASE WHEN b.score >= 0.3 THEN 'high' WHEN b.score >= 0.3 * 0.6 THEN 'medium' ELSE 'low' END AS risk_level FROM paragraphs p LEFT JOIN best b ON b.segment_id = p.doc_id || ':' || p.line_start"
SUMMARY = "count(*) AS paragraph_count, count(score) AS matched_count, count(*) FILTER (risk_level = 'high') AS high, count(*) FILTER (risk_level = 'medium') AS medium, count(*) FILTER (risk_level = 'low') AS low, count(DISTINCT CASE WHEN risk_level <> 'low' THEN corpus_id END) AS source_count, sum(leveled.n_chars)::BIGINT AS total_chars, sum(leveled.n_chars * coalesce(score, 0)) / sum(leveled.n_chars) AS weighted_rate"
KEYWORDS = keywords("risk_items", "risk_id", "excerpt")
CITED = f"WITH marks AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\[(\\d+(?:[-,，]\\d+)*)\\]', 1)) AS m FROM {plus(X.CHAPTERS)}), parts AS (SELECT doc_id, unnest(regexp_split_to_array(m, '[,，]')) AS p FROM marks), ends AS (SELECT doc_id, list_transform(string_split(p, '-'), lambda x: x::BIGINT) AS e FROM parts WHERE regexp_matches(p, '^\\d{{1,18}}(-\\d{{1,18}})?$')), cited AS (SELECT DISTINCT doc_id, unnest(range(e[1], e[-1] + 1)) AS number FROM ends)"
FACTS = "WITH facts AS (SELECT workspace || '.' || risk_id AS key, excerpt AS value, risk_level AS type, coalesce(source_label, '') AS source, score AS confidence, epoch_us(scanned_at) AS created_at, epoch_us(scanned_at) AS updated_at FROM risk_items)"
SENTENCES = f"WITH cut AS (SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(text, '([。！？!?])', '\\1' || chr(1), 'g'), '(\\.\\s)', '\\1' || chr(1), 'g'), chr(1))) AS s FROM {plus(X.CHAPTERS)}), sentences AS (SELECT doc_id, regexp_replace(s, '^\\s+|\\s+$', '', 'g') AS sentence FROM cut WHERE regexp_replace(s, '^\\s+|\\s+$', '', 'g') <> '')"
_RULES = " UNION ALL ".join(f"SELECT doc_id, {quote(rule)} AS rule, {quote(level)} AS level, {k} AS k, regexp_extract_all(body, {quote(p)}) AS h FROM bodies" for rule, (level, patterns) in RULES.items() for k, p in enumerate(patterns))
FINDINGS = f"""{style(plus(X.CHAPTERS))}, bodies AS (SELECT doc_id, string_agg(raw, chr(10) ORDER BY line_start) AS body FROM style_paragraphs GROUP BY doc_id),
every_hit AS (SELECT doc_id, rule, level, unnest(h) AS hit, k * 1000000 + unnest(range(len(h))) AS place FROM ({_RULES})),
first_hits AS (SELECT doc_id, rule, level, hit, min(place) AS place FROM every_hit GROUP BY doc_id, rule, level, hit QUALIFY row_number() OVER (PARTITION BY doc_id, rule ORDER BY min(place)) <= 8),
findings AS (SELECT doc_id, rule, level, hit, CASE WHEN strpos(whole, hit) = 0 THEN 0 ELSE 1 + length(whole[:strpos(whole, hit) - 1]) - length(replace(whole[:strpos(whole, hit) - 1], chr(10), '')) END AS line FROM first_hits JOIN src USING (doc_id))"""
RECALL = f"{keywords('docx_contents', 'docx_id', 'text')}, {FACTS[5:]}, hits AS (SELECT docx_id AS message_id, key, count(*) + 0.01 * coalesce(max(confidence), 0) AS score, max(updated_at) AS updated_at FROM (SELECT docx_id, unnest(words) AS word FROM kw) JOIN facts ON contains(lower(key || chr(10) || value), word) GROUP BY 1, 2) SELECT message_id, key, score, row_number() OVER (PARTITION BY message_id ORDER BY score DESC, updated_at DESC, key) AS place FROM hits QUALIFY place <= 4"
OBJECTS = f"""WITH t AS (SELECT doc_id, text FROM {values(X.CHAPTERS, 'doc_id, text')} UNION ALL SELECT docx_id, text FROM docx_contents),
o AS (SELECT DISTINCT doc_id, split_part(x, '-', 1)::BIGINT AS chapter, split_part(x, '-', 2)::BIGINT AS n FROM (SELECT doc_id, replace(unnest(regexp_extract_all(text, '[图表]\\s*(\\d+[-–]\\d+)', 1)), '–', '-') AS x FROM t)),
own AS (SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS place FROM o WHERE chapter = 1)
SELECT t.doc_id, coalesce(n_own, 0) AS n_own, coalesce(largest, 0) AS largest, coalesce(first_gap, 0) AS first_gap, coalesce(others, '') AS "foreign" FROM t LEFT JOIN (SELECT doc_id, count(*) AS n_own, max(n) AS largest, min(CASE WHEN n > place THEN place END) AS first_gap FROM own GROUP BY doc_id) a USING (doc_id) LEFT JOIN (SELECT doc_id, string_agg(chapter || '-' || n, '、' ORDER BY chapter || '-' || n) AS others FROM o WHERE chapter <> 1 GROUP BY doc_id) b USING (doc_id)"""
TERMS = f"""WITH t AS (SELECT p.doc_id, coalesce(workspace, '-') AS workspace, p.text FROM {plus(X.CHAPTERS)[:-10]} p LEFT JOIN documents d ON d.doc_id = p.doc_id),
defined AS (SELECT workspace, term, min(doc_id) AS defined_at FROM (SELECT workspace, doc_id, unnest(regexp_extract_all(text, '[一-鿿]{{2,20}}（([A-Z]{{2,10}})）', 1)) AS term FROM t) GROUP BY 1, 2),
used AS (SELECT DISTINCT workspace, doc_id AS used_at, term FROM (SELECT workspace, doc_id, unnest(regexp_split_to_array(regexp_replace(text, '（[A-Z]{{2,10}}）', '（）', 'g'), '[^A-Za-z一-鿿]+')) AS term FROM t) WHERE regexp_full_match(term, '[A-Z]{{2,10}}'))
SELECT workspace, term, defined_at, min(used_at) AS used_at FROM defined JOIN used USING (workspace, term) WHERE used_at < defined_at GROUP BY ALL"""
_FOLD = "regexp_replace(strip_accents(lower({})), '[^a-z0-9一-鿿]+', '', 'g')"
CITE_KEYS = f"""WITH r AS (SELECT rec_id, pub_year, trim(coalesce(authors[1], '')) AS author, coalesce(title, '') AS title FROM lit_records),
p AS (SELECT *, {_FOLD.format("list_extract(regexp_split_to_array(author, '\\s+'), -1)")} AS last_word, {_FOLD.format('author')} AS whole, regexp_replace(title, '[^一-鿿]', '', 'g')[1:4] AS han,
list_filter(list_transform(list_filter(regexp_split_to_array(trim(title), '\\s+'), lambda w: NOT list_contains(['a', 'an', 'the', 'on', 'of', 'for', 'and'], lower(w))), lambda w: {_FOLD.format('w')}), lambda w: w <> '') AS words FROM r),
k AS (SELECT rec_id, (CASE WHEN author = '' THEN 'anon' WHEN last_word <> '' THEN last_word ELSE whole END || coalesce(pub_year::VARCHAR, '') || CASE WHEN han <> '' THEN han ELSE coalesce(words[1], 'paper') END)[1:40] AS base_key FROM p),
n AS (SELECT *, row_number() OVER (PARTITION BY base_key ORDER BY rec_id) - 2 AS place FROM k)
SELECT rec_id, base_key, base_key || CASE WHEN place < 0 THEN '' WHEN place < 26 THEN chr((97 + place)::INT) ELSE 'x' || place END AS cite_key FROM n"""
