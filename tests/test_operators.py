"""Operators against brute force and hand-made cases: nulls, empty texts and tables, ties, repeated rows."""

import pytest
from pyspark.sql import functions as F

from corpusloom import runtime as R
from corpusloom.functions import text as T
from corpusloom.operators import citations as C
from corpusloom.operators import facts as K
from corpusloom.operators import literature as L
from corpusloom.operators import overlap as O
from corpusloom.operators import profile as P
from corpusloom.operators import segments as S
from corpusloom.operators import style as Y
from corpusloom.runtime import salted_join
from corpusloom.sources import bibliography as B

LONG = "本研究针对在线查重系统的实现过程进行了详细的设计与分析并给出了完整的测试结果与改进方向"


def test_paragraphs(spark):
    text = f"# 题\n{LONG}\n续行\n\n短\n```\n{LONG}\n```\n- {LONG}\n参考文献\n{LONG}"
    rows = S.paragraphs(spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string"), "id").collect()
    assert [(r.id, r.line_start, r.line_end) for r in rows] == [(1, 2, 3)]
    assert S.paragraphs(spark.createDataFrame([], "id int, text string"), "id").count() == 0


def brute(segments, corpus, n):
    cut = lambda t: {t[i : i + n] for i in range(max(1, len(t) - n + 1))} if t else set()
    out = {}
    for s, a in segments:
        for c, b in corpus:
            common = cut(a or "") & cut(b or "")
            if common:
                out[s, c] = (len(common), len(common) / len(cut(a)), len(common) / len(cut(a) | cut(b)))
    return out


def test_containment_equals_naive(spark, monkeypatch):
    words = ["甲乙丙丁戊己庚辛", "子丑寅卯辰巳午未", "天地玄黄宇宙洪荒", "日月盈昃辰宿列张"]
    segments = [(f"s{i}", words[i % 4] + words[(i * 3 + 1) % 4] + str(i)) for i in range(12)] + [("e", ""), ("n", None)]
    corpus = [(f"c{i}", words[i % 4] * 2) for i in range(6)] + [("e", ""), ("n", None)]
    a, b = spark.createDataFrame(segments, "segment_id string, normalised string"), spark.createDataFrame(corpus, "corpus_id string, normalised string")
    got = {(r.segment_id, r.corpus_id): (r.common, r.containment, r.jaccard) for r in O.containment_hits(a, b, 4).collect()}
    want = brute(segments, corpus, 4)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    assert O.containment_hits(a.limit(0), b, 4).count() == 0 and O.containment_hits(a, b.limit(0), 4).count() == 0
    # the same where the collection is too large to be sent, with every shingle as a flooding one
    monkeypatch.setattr(R.hot_keys, "__defaults__", (0,))
    wide = {(r.segment_id, r.corpus_id): (r.common, r.containment, r.jaccard) for r in O.containment_hits(a, b, 4, most_sent=0).collect()}
    assert wide.keys() == want.keys() and all(wide[k] == pytest.approx(want[k]) for k in want)
    scoped = O.containment_hits(a.withColumn("w", F.substring("segment_id", 2, 1)), b.withColumn("w", F.lit("1")).withColumn("extra", F.lit(0)), 4, scope="w")
    assert {r.segment_id for r in scoped.collect()} <= {"s1", "s10", "s11"}
    own = O.containment_hits(a.withColumn("own_id", F.lit("c0")), b, 4)
    assert {r.corpus_id for r in own.collect()} == {c for _, c in want if c != "c0"}


def test_scoped_pairs_are_counted_in_blocks_and_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(O, "BLOCK_CHARS", 40)
    monkeypatch.setattr(O, "COUNTED", 100)
    words = ["甲乙丙丁戊己庚辛", "子丑寅卯辰巳午未", "天地玄黄宇宙洪荒", "日月盈昃辰宿列张", "abc", ""]
    rows = [(i, None if i == 7 else words[i % 6] + words[(i * 5 + 1) % 6] + words[(i * i) % 5], ("p", "q", None)[i % 7 % 3]) for i in range(40)]
    a = spark.createDataFrame([(f"s{i}", t, w, i) for i, t, w in rows], "segment_id string, normalised string, w string, own_id long")
    b = spark.createDataFrame(rows, "corpus_id long, normalised string, w string")
    hits = O.containment_hits(a, b, 4, least=0.3, scope="w")
    got = {(r.segment_id, r.corpus_id): (r.common, r.containment, r.jaccard) for r in hits.collect()}
    every = brute([(f"s{i}", t) for i, t, _ in rows], [(i, t) for i, t, _ in rows], 4)
    scope = {i: w for i, _, w in rows}
    want = {(s, c): v for (s, c), v in every.items() if scope[c] and scope[int(s[1:])] == scope[c] and int(s[1:]) != c and v[1] >= 0.3}
    assert len(want) > 50 and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan


def test_best_and_levels(spark):
    hits = spark.createDataFrame([("a", "y", 0.5), ("a", "x", 0.5), ("b", "x", 0.2), ("c", "x", 0.1)], "segment_id string, corpus_id string, containment double")
    texts = spark.createDataFrame([("a", "甲乙丙丁戊己庚辛壬癸"), ("b", "t"), ("c", None)], "segment_id string, normalised string")
    corpus = spark.createDataFrame([("x", "零甲乙丙丁"), ("y", "甲乙丙丁戊己庚辛零")], "corpus_id string, normalised string")
    # a tie in containment goes to the longer common run, then to the smaller id
    assert {(r.segment_id, r.corpus_id) for r in O.best_hits(hits, texts, corpus).collect()} == {("a", "y"), ("b", "x"), ("c", "x")}
    best = O.best_hits(hits, texts, corpus.withColumn("normalised", F.lit("别")))
    assert {(r.segment_id, r.corpus_id) for r in best.collect()} == {("a", "x"), ("b", "x"), ("c", "x")}
    segments = spark.createDataFrame([("a", 10), ("b", 10), ("c", 10), ("d", 10)], "segment_id string, n_chars int")
    row = O.risk_summary(segments, best, 0.3).first()
    assert (row.paragraph_count, row.matched_count, row.high, row.medium, row.low, row.source_count) == (4, 3, 1, 1, 2, 1)
    assert row.weighted_rate == pytest.approx(0.2)
    assert O.risk_summary(segments.limit(0), best).first().weighted_rate == 0
    delta = O.rate_delta(O.risk_summary(segments, best, 0.3), O.risk_summary(segments.filter("segment_id <> 'a'"), best, 0.3)).first()
    assert delta.verdict == "reached" and delta.high_drop == 1


def test_spans():
    a, b = "xxabcdefghijyy", "abcdefghijzzzabcdefgh"
    assert O.common_spans(a, b, 4, 8) == [(10, 2, 0), (8, 2, 13)]
    assert O.common_spans("", b) == [] and O.common_spans("abc", "abd") == []


def test_style(spark):
    text = "综上所述，随着信息技术的发展，本方法具有一定的意义。作为AI，被用于测试。"
    rows = Y.style_findings(spark.createDataFrame([(1, "# 题\n\n" + text + "\n\n" + text), (2, None), (3, "")], "id int, text string"), "id").collect()
    assert {r.rule for r in rows} == {"cliche", "empty_conclusion", "self_disclosure", "translationese"}
    assert len(rows) == len({(r.rule, r.hit) for r in rows}) and {r.line for r in rows} == {3}
    many = "，".join(f"对{'甲乙丙丁戊己庚辛壬癸'[k] * 2}进行了说明" for k in range(10))
    first = Y.style_findings(spark.createDataFrame([(1, many)], "id int, text string"), "id").collect()
    assert [r.hit[1] for r in first] == list("甲乙丙丁戊己庚辛")
    totals = {r.id: (r.n_findings, r.n_errors) for r in Y.finding_totals(spark.createDataFrame([(1, "a", "error"), (1, "b", "warn"), (2, "b", "warn")], "id int, rule string, level string"), "id").collect()}
    assert totals == {1: (2, 1), 2: (1, 0), None: (3, 1)}
    plain = spark.createDataFrame([(1, 1, "春" * 120), (1, 2, "春" * 120 + "系统"), (1, 3, "春" * 120 + "3")], "id int, line_start int, raw string")
    assert [r.line_start for r in Y.anchorless(plain, "id").collect()] == [1]
    body = "内容足够长的一段文字，超过二十个字符才算一段。"
    runs = spark.createDataFrame([(1, "\n\n".join(f"首先研究{x}" + body for x in "甲乙丙") + "\n\n其他" + body), (2, None)], "id int, text string")
    assert [(r.opening, r.n_paragraphs, r.line_start) for r in S.opening_runs(runs, "id", prefix=4).collect()] == [("首先研究", 3, 1)]
    mixed = spark.createDataFrame([(1, f"# 题\n| a |\n- 项\n  {body}\n续行\n\n短\n\n- {body}"), (2, None)], "id int, text string")
    assert [(r.line_start, r.raw) for r in S.style_paragraphs(mixed, "id").collect()] == [(2, body + "续行")]
    sections = spark.createDataFrame([(1, "- [x] 零\n# A\n- [x] 一\n- [ ] 二\n## B\n无"), (2, None)], "id int, text string")
    assert {(r.section, r.checked, r.unchecked) for r in Y.section_checklists(sections, "id").collect()} == {("", 1, 0), ("A", 1, 1)}
    deck = spark.createDataFrame([(1, "# 一\n---\n\n---\n二"), (2, None)], "id int, text string")
    assert [(r.slide_no, r.slide) for r in Y.slides(deck, "id").collect()] == [(1, "# 一"), (2, "二")]
    marks = spark.createDataFrame([(1, "TODO 和 TODO（待补）"), (2, "无"), (3, None)], "id int, text string")
    assert [(r.id, r.n_hits, r.samples) for r in Y.placeholders(marks, "id").collect()] == [(1, 3, "TODO、（待补）")]
    boxes = spark.createDataFrame([(1, "- [x] a\n- [ ] b\n- [x] c"), (2, None)], "id int, text string")
    assert [(r.checked, r.unchecked) for r in Y.checklist(boxes, "id").orderBy("id").collect()] == [(2, 1), (0, 0)]
    parts = Y.sentences(spark.createDataFrame([(1, "一。二！Three. four")], "id int, text string"), "id")
    assert [r.sentence for r in parts.orderBy("pos").collect()] == ["一。", "二！", "Three.", "four"]


def test_citations(spark):
    used = spark.createDataFrame([("g", 1), ("g", 9)], "g string, number int")
    library = spark.createDataFrame([("g", 1), ("g", 2)], "g string, number int")
    assert {(r.number, r.state) for r in C.reconcile(used, library, "g").collect()} == {(1, "cited"), (2, "uncited"), (9, "out_of_range")}
    numbers = spark.createDataFrame([("a", 1), ("a", 3), ("b", 1), ("b", 2), ("b", 2), ("c", 2), ("d", None)], "g string, n int")
    assert {(r.g, r.first_gap) for r in C.first_gap(numbers, "g", "n").collect()} == {("a", 2), ("c", 1)}
    objects = spark.createDataFrame([(1, 2, "图 2-1，图2-3，图 3-1"), (2, 2, ""), (3, 2, None)], "id int, chapter int, text string")
    rows = {r.id: r for r in C.numbered_objects(objects, "id", "chapter", "图").collect()}
    assert (rows[1].n_own, rows[1].largest, rows[1].first_gap, rows[1].foreign) == (2, 3, 2, "3-1") and rows[2].n_own == 0
    chapters = spark.createDataFrame([("w", 1, "使用 CNN 模型。"), ("w", 2, "卷积神经网络（CNN）与 CNN。"), ("w", 3, "CNN")], "w string, no int, text string")
    assert [(r.term, r.defined_at, r.used_at) for r in C.terms_before_definition(chapters, "w", "no").collect()] == [("CNN", 2, 1)]
    lines = S.text_lines(spark.createDataFrame([(1, "## 1.1 背景\n# 2 方法\n### 无号")], "id int, text string"), "id")
    heads = C.heading_numbers(lines, "id")
    assert {r.number for r in heads.collect()} == {"1.1", "2"}
    need = spark.createDataFrame([(1, "1.1"), (1, "1.2")], "id int, number string")
    assert [r.number for r in C.missing_headings(need, heads, "id").collect()] == ["1.2"]


FACT = "key string, value string, type string, source string, confidence double, created_at long, updated_at long"


def test_facts(spark):
    facts = spark.createDataFrame([("alpha.a", "查重阈值 0.3", "t", "s", 0.9, 1, 1), ("alpha.b", "50%_x", "t", "s", 0.5, 1, 2), ("alphaX.c", "other", "t", "s", 0.5, 1, 3), ("beta", None, "t", "s", None, 1, 4)], FACT)
    assert [r.key for r in K.search(facts, "%_").collect()] == ["alpha.b"]
    assert [r.key for r in K.search(facts, namespace="alpha").collect()] == ["alpha.a", "alpha.b"]
    with pytest.raises(ValueError, match="namespace"):
        K.search(facts)
    assert K.context(facts, "alpha").count() == 2 and K.context(facts, "").count() == 4 and K.context(facts, "beta").count() == 1
    changes = spark.createDataFrame([("alpha.a", "new", "t", "s", 1.0, 7, 7), ("gamma", "g", "t", "s", 1.0, 8, 8), (None, "x", "t", "s", 1.0, 8, 8)], FACT)
    merged = {r.key: r for r in K.upsert(facts, changes).collect()}
    assert len(merged) == 5 and merged["alpha.a"].value == "new" and merged["alpha.a"].created_at == 1 and merged["gamma"].created_at == 8
    messages = spark.createDataFrame([(1, "请调整查重阈值"), (2, None)], "message_id int, text string")
    assert [(r.message_id, r.key) for r in K.recall(facts, messages).collect()] == [(1, "alpha.a")]
    lines = spark.createDataFrame([("g", 1, "x" * 10), ("g", 2, "y" * 10), ("g", 3, "z")], "g string, k int, line string")
    card = K.cards(lines, "g", "k", 24, "", "…").first()
    assert card.n_lines == 3 and card.card == "\n" + "\n".join(["x" * 10, "y" * 10, "z"])
    assert K.cards(lines, "g", "k", 22, "h", "…").first().card == "h\n" + "x" * 10 + "\n…"
    assert K.table_fingerprint(lines, "g", "k", "line").first() == K.table_fingerprint(lines.orderBy(F.desc("k")), "g", "k", "line").first()
    import hashlib

    assert K.content_fingerprint(lines, "g", "k", "line").first().fingerprint == hashlib.sha256("\0".join(["1=" + "x" * 10, "2=" + "y" * 10, "3=z"]).encode()).hexdigest()[:12]
    with pytest.raises(Exception, match="too many"):
        K.content_fingerprint(lines, "g", "k", "line", most=2).collect()
    assert [r.problem for r in K.checked_facts(spark.createDataFrame([(" ", "v", 0.5), ("k", None, 0.5), ("k", "v", 2.0), ("k", "v", None)], "key string, value string, confidence double")).collect()] == ["empty_key", "empty_value", "confidence", None]
    assert K.stable_json(lines, "g", "k", "line").first().json == '{"1":"xxxxxxxxxx","2":"yyyyyyyyyy","3":"z"}'
    assert K.fingerprint(facts).first()[0] == "4:4"
    assert {r.namespace: r.n_facts for r in K.namespaces(facts).collect()} == {"alpha": 2, "alphaX": 1, "beta": 1}


def test_literature(spark):
    assert L.cite_key("Ezgi Müller", 2020, "The Deep Learning") == "muller2020deep"
    assert L.cite_key(None, None, "基于深度学习的方法") == "anon基于深度"
    rows = spark.createDataFrame([(1, ["A B"], 2020, "Deep x"), (2, ["C B"], 2020, "Deep y"), (3, None, None, None)], "rec_id int, authors array<string>, pub_year int, title string")
    assert {r.rec_id: r.cite_key for r in L.cite_keys(rows).collect()} == {1: "b2020deep", 2: "b2020deepa", 3: "anonpaper"}
    scholar = '{"data":[{"paperId":"p","title":"A &lt;i&gt;x&lt;/i&gt;","authors":[{"name":"N"}],"year":2020,"venue":"Journal of X","abstract":null,"url":"u","citationCount":3,"externalIds":{"DOI":"10.1/x"}}]}'
    row = B.scholar_records(spark.createDataFrame([(scholar,)], "body string")).first()
    assert (row.title, row.lit_type, row.doi, row.citation_count) == ("A x", "article", "10.1/x", 3)
    crossref = '{"message":{"items":[{"DOI":"10.2/y","title":["T"],"author":[{"given":"G","family":"F"}],"issued":{"date-parts":[[2019,1]]},"container-title":["V"],"type":"proceedings-article","URL":"u"},{"title":["no doi"]}]}}'
    rows = B.crossref_records(spark.createDataFrame([(crossref,)], "body string")).collect()
    assert [(r.title, r.authors, r.pub_year, r.lit_type) for r in rows] == [("T", ["G F"], 2019, "inproceedings")]
    dblp = '{"result":{"hits":{"hit":[{"info":{"title":"D","authors":{"author":[{"text":"X Y"},{"text":"0001"}]},"year":"2018","venue":"CoRR","type":"Journal Articles","url":"u"}}]}}}'
    row = B.dblp_records(spark.createDataFrame([(dblp,)], "body string")).first()
    assert (row.authors, row.lit_type, row.pub_year) == (["X Y"], "misc", 2018)
    atom = "<feed><entry><id>http://arxiv.org/abs/2101.00001v2</id><title>T  t</title><summary>S</summary><published>2021-01-01</published><author><name>A</name></author></entry><entry><id>x</id></entry></feed>"
    rows = B.atom_entries(spark.createDataFrame([(atom,)], "text string")).collect()
    assert [(r.title, r.arxiv_id, r.pub_year, r.authors) for r in rows] == [("T t", "2101.00001", 2021, ["A"])]
    bib = spark.createDataFrame([("f", '@article{k1,\n doi = {10.1/A}\n}\n@book{k2,\n}')], "f string, text string")
    assert [(r.number, r.cite_key) for r in B.bib_keys(bib, "f").collect()] == [(1, "k1"), (2, "k2")]
    assert [r.doi for r in B.bib_dois(bib, "f").collect()] == ["10.1/a"]
    state = spark.createDataFrame([("x\n<!-- thesis:state\n{\"a\":1}\n-->",), ("none",)], "text string")
    assert [r.state.a for r in B.embedded_state(state, "thesis:state", "a int").collect()] == [1]


def test_profile(spark):
    paths = ["a/b.PY", "x.docx", "Dockerfile", ".env", "y.doc", "m.md", None]
    kinds = spark.createDataFrame([(p,) for p in paths], "p string").select(P.file_kind(F.col("p")), P.unsupported_reason(F.col("p"))).collect()
    assert [r[0] for r in kinds] == ["code", "docx", "text", "unsupported", "unsupported", "text", "unsupported"] and kinds[4][1] == "legacy_office"
    files = spark.createDataFrame([("a.py", "# c\nclass A:\n    def f(self):\n        pass\n\ndef f():\n    pass"), ("b.ts", "export function g() {}\n// x\nexport const h = (a) => a"), ("c.xyz", "x"), ("d.py", None)], "rel string, text string")
    counts = {r.rel: r for r in P.line_counts(files).collect()}
    assert (counts["a.py"].lines, counts["a.py"].blank_lines, counts["a.py"].comment_lines, counts["a.py"].code_lines) == (7, 1, 1, 5) and counts["d.py"].lines == 1
    assert {(r.rel, r.kind, r.name, r.line) for r in P.declarations(files).collect()} == {("a.py", "class", "A", 2), ("a.py", "function", "f", 3), ("b.ts", "function", "g", 1), ("b.ts", "const", "h", 3)}
    stack = P.tech_stack(spark.createDataFrame([("package.json", '{"dependencies": {"react": "1"}}'), ("requirements.txt", "numpy\nflask")], "rel string, text string"))
    assert {r.name for r in stack.collect()} == {"Node.js / npm", "React", "NumPy", "Flask"}
    assert P.language_rollup(P.line_counts(files)).filter("language IS NULL").first().files == 3


def test_salted_join(spark):
    left = spark.range(5000).select((F.col("id") % 7).alias("k"), "id").union(spark.range(5000).select(F.lit(100).cast("long"), "id")).union(spark.createDataFrame([(None, 1)], "k long, id long"))
    right = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).union(spark.createDataFrame([(100, 1), (None, 2)], "k long, v long"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = salted_join(left, right, "k", how, least=100).groupBy("k").count().collect()
        want = left.join(right, "k", how).groupBy("k").count().collect()
        assert sorted(map(str, got)) == sorted(map(str, want))


def test_numbered(spark):
    rows = [("a", i * 3) for i in range(500)] + [("b", 7), (None, 1), (None, 2)]
    got = {(r.k, r.n): r.place for r in R.numbered(spark.createDataFrame(rows, "k string, n long"), "k", "n", 8).collect()}
    assert got == {**{("a", i * 3): i + 1 for i in range(500)}, ("b", 7): 1, (None, 1): 1, (None, 2): 2}
    assert R.numbered(spark.createDataFrame([], "k string, n long"), "k", "n").count() == 0


def test_first_by_id(spark):
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 3, "z"), (None, 4, None)], "id string, rec_id int, extra string")
    assert sorted(map(str, L.first_by_id(rows, "id", ["rec_id"]).select("rec_id").collect())) == ["Row(rec_id=1)", "Row(rec_id=3)", "Row(rec_id=4)"]


def test_written_and_tables(spark):
    rows = spark.createDataFrame([(1, "春" * 400, 200), (2, "春", 200), (3, "- [x] a", 200), (4, None, 200)], "id int, text string, t int")
    assert [r.state for r in S.written_chapters(rows, "id", "t").orderBy("id").collect()] == ["written", "template", "written", "missing"]
    counts = S.segment_counts(spark.createDataFrame([(1, LONG + "\n\n短"), (2, None)], "id int, text string"), "id")
    assert sorted(map(tuple, counts.collect())) == [(1, 1, 1), (2, 0, 0)]
    lines = S.text_lines(spark.createDataFrame([(1, "| a | b.md |\n|---|:-:|\n| c")], "id int, text string"), "id")
    assert [r.cells for r in C.table_rows(lines, "id").orderBy("line_no").collect()] == [["a", "b.md"], ["c"]]


def test_located_spans(spark):
    raw = "第一行，甲乙丙丁\n戊己庚辛 壬癸"
    pairs = spark.createDataFrame([("s", "c", "第一行甲乙丙丁戊己庚辛壬癸", "零甲乙丙丁戊己庚辛零", raw, 5), ("n", "c", None, "x", None, 1)], "segment_id string, corpus_id string, a string, b string, raw string, line_start int")
    row = O.match_spans(pairs).first()
    assert (row.length, row.a_start, row.b_start, raw[row.raw_start : row.raw_end], row.line) == (8, 3, 1, "甲乙丙丁\n戊己庚辛", 5)


def test_rates(spark):
    text = "正文段落：10 段\n有命中段落：3 段（高风险 1 段）\n全文加权重复率**估算｜**：12.5%"
    rows = O.report_baseline(spark.createDataFrame([(text,), ("无",), (None,)], "text string")).collect()
    assert [(r.paragraph_count, r.high, r.medium, r.weighted_rate) for r in rows] == [(10, 1, 0, 0.125)]
    rates = spark.createDataFrame([(12.5,), (0.3,), (-1.0,), (250.0,), (None,)], "x double").select(O.detected_rate(F.col("x"))).collect()
    assert [r[0] for r in rates[:4]] == [0.125, 0.3, 0.0, 1.0]


def test_clip(spark):
    rows = spark.createDataFrame([("a  b\nc",), (None,)], "x string").select(T.clip(F.col("x"), 3)).collect()
    assert [r[0] for r in rows] == ["a b…", None]


def test_recall_in_blocks_shuffles_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(K, "FACTS_HELD", 7)
    monkeypatch.setattr(K, "MESSAGES_HELD", 3)
    monkeypatch.setattr(K, "CELLS", 20)
    words = ["alpha", "bravo", "carol", "delta", "echos"]
    facts = [(f"k{i:02}", f"{words[i % 5]} {words[i * 3 % 4]}", None if i % 7 == 0 else (i % 4) / 4, None if i % 9 == 0 else i % 3) for i in range(40)]
    messages = [(i, f"{words[i % 5]} and {words[(i + 2) % 5]} with {words[i % 3]}") for i in range(10)]
    found = K.recall(spark.createDataFrame(facts, "key string, value string, confidence double, updated_at long"), spark.createDataFrame(messages, "message_id long, text string"))
    want = set()
    for i, text in messages:
        scored = [(-(sum(w in v for w in {*text.split()} - {"and", "with"}) + 0.01 * (c or 0)), u is None, -(u or 0), k) for k, v, c, u in facts if any(w in v for w in {*text.split()} - {"and", "with"})]
        want |= {(i, k, -s, place) for place, (s, _, _, k) in enumerate(sorted(scored)[:4], 1)}
    assert {tuple(r) for r in found.collect()} == want
    assert "Aggregate" not in found._jdf.queryExecution().executedPlan().toString()
