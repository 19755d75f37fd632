"""Column functions on small literal texts."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.segments import line_kind
from corpusloom.streaming import cards


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("ａｂｃ测试（全角）括号LatinWord", "abc测试全角括号latinword"),
        ("**研究**背景", "研究背景"),
        ("HTTP_Server 与 APIv2 接口", "http_server与apiv2接口"),
        ("共 35 个，1200 次，42%", "共35个1200次42"),
        ("", ""),
        (None, None),
        ("﻿a\r\nb\rc", "abc"),
        ("12。", "12."),
    ],
)
def test_normal(spark, raw, expected):
    assert one(spark, raw, T.normal) == expected


def test_shingles(spark):
    assert one(spark, "abcdef", lambda c: T.shingles(c, 4)) == ["abcd", "bcde", "cdef"]
    assert one(spark, "abc", lambda c: T.shingles(c, 4)) == ["abc"]
    assert one(spark, "", lambda c: T.shingles(c, 4)) == []
    assert one(spark, "aaaaaa", lambda c: T.shingles(c, 4)) == ["aaaa"]


def test_fnv(spark):
    def fnv(text):
        h = 2166136261
        raw = text.encode("utf-16-be")
        for c in (int.from_bytes(raw[i : i + 2], "big") for i in range(0, len(raw), 2)):
            h = ((h ^ c) * 16777619) & 0xFFFFFFFF
        return h

    for text in ("abcd", "研究背景", "a", "a😀b", ""):
        assert one(spark, text, T.fnv1a) == fnv(text)


@pytest.mark.parametrize(
    ("line", "kind"),
    [("# 标题", "heading"), ("```python", "fence"), ("    code", "indented"), ("$$x^2$$", "formula"), ("E = mc", "text"), ("x=(a+b)-(c*d)", "formula"), ("![图](a.png)", "structural"), ("---", "structural"), ("| a | b |", "table"), ("> 引用", "quote"), ("- 项", "list"), ("3) 项", "list"), ("## 参考文献", "heading"), ("参考文献", "reference_heading"), ("[1] 张三", "reference_entry"), ("（待补）", "placeholder"), ("", "blank"), ("正文。", "text")],
)
def test_line_kind(spark, line, kind):
    assert one(spark, line, T.line_kind) == kind and line_kind(line) == kind


def test_html(spark):
    page = "<html><head><style>p{}</style></head><body><!-- x --><h1>题</h1><p>a&nbsp;b &amp; c</p><script>if('</p>')</script><table><tr><td>1</td><td>2</td></tr></table><br/>z</body></html>"
    assert one(spark, page, T.html_to_text) == "题\na\u00a0b & c\n1\t2\n\nz"
    assert one(spark, "&#8212;&#x4e2d;&amp;lt;&#xD800;&nope;", T.html_to_text) == "—中&lt;&#xD800;&nope;"
    assert one(spark, "&amp;lt;b&amp;gt;x&#20013;", T.strip_tags) == "x中"


def test_cited_numbers(spark):
    assert one(spark, "见[1]、[3-5]和[7,9]，[5-4]", T.cited_numbers) == [1, 3, 4, 5, 7, 9]
    assert one(spark, "[3-2] [1-1000]", T.cited_numbers) == list(range(1, 1001))
    assert one(spark, None, T.cited_numbers) is None
    assert one(spark, "无", T.cited_numbers) == []


def test_keywords(spark):
    got = one(spark, "查重阈值怎么设置 config.shingle please", lambda c: T.keywords(c))
    assert got[0] == "config.shingle" and "查重" in got and "please" not in got


def test_protected(spark):
    got = {(r.kind, r.text) for r in one(spark, '在 35ms 内，`run()` 与 get_value，见[2]，称“重要术语”', T.protected_elements)}
    assert {("number", "35ms"), ("citation", "[2]"), ("code", "`run()`"), ("code", "get_value"), ("term", "重要术语")} <= got


def test_scalars(spark):
    parts = [one(spark, x, T.date_parts) for x in ("2026-03-01", "3月1日", "无", None)]
    assert (parts[0].year, parts[0].month, parts[0].day) == (2026, 3, 1) and parts[1].year is None and parts[2] is None and parts[3] is None
    assert [one(spark, x, lambda c: T.date_problem(T.date_parts(c), 2026)) for x in ("2026-03-01", "3月1日", "无", "2026-13-1", "1990-1-1")] == [None, "no_year", "missing", "month_day", "year"]
    assert [one(spark, x, T.summary_name) for x in ("a/b:c.docx", "x", "", ".env", None)] == ["b_c.md", "x.md", "材料.md", "材料.md", "材料.md"]
    assert [spark.range(1).select(T.signed(F.lit(x))).first()[0] for x in (1.25, -0.04, 3.0, -2.55)] == ["+1.3", "0", "+3", "-2.5"]
    q = one(spark, "a\x00\ufffdb", T.quality)
    assert (q.n, q.printable, q.unreadable) == (4, 0.75, 0.25) and one(spark, "", T.quality).printable == 1 and one(spark, None, T.quality).n is None
    assert spark.range(1).select(F.crc32(F.lit(b"123456789"))).first()[0] == 0xCBF43926


def test_messages(spark):
    rows = spark.createDataFrame([(1, "帮我写第三章的正文吧"), (2, "/help me please"), (3, None), (4, "短"), (5, "先不写第三章的正文")], "id int, text string")
    assert {r.id for r in cards.user_messages(rows).collect()} == {1, 5}
    assert {r.id for r in cards.matching_messages(rows, ["写第.章"], ["不写"]).collect()} == {1}
    label = cards.first_rule(F.col("text"), [("a", "第三章"), ("b", "正文")])
    assert [r[0] for r in rows.select(label).collect()] == ["a", None, None, None, "a"]
