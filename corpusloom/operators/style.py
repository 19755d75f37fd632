"""Writing-style findings, placeholders, check lists, sentences and rewriting hints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.segments import style_text

# Phrases and patterns each style rule looks for, in the order in which hits count.
RULES = {
    "cliche": ("warn", ["综上所述", "总而言之", "众所周知", "值得注意的是", "不难发现", "显而易见", "在当今", "近年来", "意义重大", "迫在眉睫", "不可或缺", "日益重要", "突飞猛进", "日新月异", "随着[一-鿿]{2,20}的(?:发展|进步|普及|应用)"]),
    "empty_conclusion": ("warn", ["(?:具有|有着)(?:一定的|重要的|较大的|深远的)?(?:意义|价值|作用)"]),
    "self_disclosure": ("error", [r"(?i)作为\s*AI|人工智能助手|大语言模型|大型语言模型|语言模型生成|ChatGPT|由\s*AI\s*(?:生成|撰写|完成)"]),
    "translationese": ("warn", ["被用于", "对[一-鿿]{2,20}进行了", "进行了[一-鿿]{2,20}的", "一个[一-鿿]{2,10}的过程", "基于[一-鿿]{2,20}的基础(?:之上)?", "进行(?:深入)?的(?:研究|分析|探讨)"]),
}
ANCHORS = "系统|模块|数据|实验|测试|本文|本系统|方法|算法|模型|接口|数据库|页面|功能"
PLACEHOLDER = r"（待补）|待补充|待写|TODO|TBD|FIXME|XXX|此处省略|<[^>]{2,}>|［待[^］]*］"
SPLIT_MARKS = "；|;|，而|,而|，同时|，并且|，进而|，从而"
FILLERS = "综上所述|总而言之|值得注意的是|众所周知|不难发现|显而易见|在当今|近年来"


def _line_of(text: Column, hit: Column) -> Column:
    """Line from 1 in which a text first has ``hit``; 0 where it has none."""
    before = F.call_function("substring_index", text, hit, F.lit(1))
    return F.when(F.contains(text, hit), F.size(F.split(before, "\n"))).otherwise(0).cast("bigint")


def style_findings(docs: DataFrame, key: str, text: str = "text", most: int | None = 8) -> DataFrame:
    """``(key, rule, level, hit, line)``: the first ``most`` distinct hits of each rule in a text's body paragraphs.

    Hits count in the order of a rule's patterns, then of their place. ``line`` is where the whole text first has the
    hit, 0 where it runs over a line end. A text is handled within its row: no shuffle. Null texts have no findings.
    """
    body = style_text(docs, key, text)

    def found(rule: str, level: str, patterns: list[str]) -> Column:
        hits = F.array_distinct(F.concat(*(F.regexp_extract_all("body", F.lit(p), 0) for p in patterns)))
        kept = F.slice(hits, 1, most) if most else hits
        return F.transform(kept, lambda h: F.struct(F.lit(rule).alias("rule"), F.lit(level).alias("level"), h.alias("hit"), _line_of(F.col("whole"), h).alias("line")))

    return body.select(key, F.inline(F.concat(*(found(rule, level, patterns) for rule, (level, patterns) in RULES.items()))))


def finding_totals(findings: DataFrame, key: str) -> DataFrame:
    """``(key, n_findings, n_errors, rules, is_clean)`` per text and in total (null key)."""
    rolled = findings.rollup(key).agg(F.count(F.lit(1)).alias("n_findings"), F.count_if(F.col("level") == "error").alias("n_errors"), F.count_distinct("rule").alias("n_rules"))
    return rolled.withColumn("is_clean", F.col("n_errors") == 0)


def anchorless(paragraphs: DataFrame, key: str, least: int = 100, most: int | None = 5) -> DataFrame:
    """``(key, line_start, excerpt)``: long paragraphs without number, citation, figure or concrete noun, ``most`` a text."""
    raw = F.col("raw")
    bare = (T.cjk_count(raw) >= least) & ~raw.rlike(r"\d") & ~raw.rlike(ANCHORS)
    rows = paragraphs.filter(bare).select(key, "line_start", F.substring(raw, 1, 40).alias("excerpt"))
    return rows if most is None else rows.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy("line_start"))).filter(F.col("place") <= most).drop("place")


def placeholders(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``(key, n_hits, samples)`` of texts with marks of unfinished work; up to five distinct samples in order."""
    hits = F.regexp_extract_all(text, F.lit(PLACEHOLDER), 0)
    return df.select(key, F.size(hits).alias("n_hits"), F.array_join(F.slice(F.array_distinct(hits), 1, 5), "、").alias("samples")).filter("n_hits > 0")


def checklist(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``(key, checked, unchecked)``: ticked and open boxes of each text; null counts as none."""
    count = lambda p: F.coalesce(F.regexp_count(text, F.lit(p)), F.lit(0))
    return df.select(key, count(r"(?m)^[ \t]*- \[x\]").alias("checked"), count(r"(?m)^[ \t]*- \[ \]").alias("unchecked"))


def section_checklists(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``(key, section, checked, unchecked)`` of every section under a heading that has boxes; before any heading it is ""."""
    # a text cut before each heading: one piece a section, in the row
    pieces = F.split(text, r"(?m)^(?=#{1,6} )")
    rows = df.select(key, F.posexplode(pieces).alias("pos", "piece"))
    count = lambda p: F.regexp_count("piece", F.lit(p)).cast("bigint")
    rows = rows.select(key, "pos", F.trim(F.regexp_extract("piece", r"^#{1,6} ([^\n]*)", 1)).alias("section"), count(r"(?m)^[ \t]*- \[x\]").alias("checked"), count(r"(?m)^[ \t]*- \[ \]").alias("unchecked"))
    return rows.filter("checked + unchecked > 0").groupBy(key, "section").agg(F.sum("checked").alias("checked"), F.sum("unchecked").alias("unchecked"))


def slides(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``(key, slide_no, slide)`` from 1: pieces of a deck between lines of three dashes; empty ones are left out."""
    parts = F.filter(F.transform(F.split(text, r"(?m)^---[ \t]*$"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")
    return df.select(key, F.posexplode(parts).alias("pos", "slide")).select(key, (F.col("pos") + 1).cast("bigint").alias("slide_no"), "slide")


def sentences(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``(key, pos, sentence)`` from 0: pieces that end in a full stop, question or exclamation mark."""
    parts = F.filter(F.transform(F.split(text, r"(?<=[。！？!?])|(?<=\.\s)"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")
    return df.select(key, F.posexplode(parts).alias("pos", "sentence"))


def rewrite_hints(df: DataFrame, sentence: str = "sentence") -> DataFrame:
    """Rows with a ``hint`` each: split, voice, connector, delete or reorder, and the ``target`` it is about."""
    s = F.col(sentence)
    first = lambda p, g=0: F.nullif(F.regexp_extract(s, p, g), F.lit(""))
    mark = first(SPLIT_MARKS)
    hint = lambda name, target: F.struct(F.lit(name).alias("hint"), target.alias("target"))
    hints = F.array(
        hint("split", F.when((F.char_length(s) >= 40) | mark.isNotNull(), T.clip(s, 40))),
        hint("voice", first("被[^，。；]{1,20}(?:用于|采用|实现|提出|设计|完成)")),
        hint("parallel", F.coalesce(first("不仅[^，。]{1,40}而且"), first("既[^，。]{1,40}又"))),
        hint("connector", mark),
        hint("delete", first(FILLERS)),
        hint("reorder", first("^(?:基于|针对|随着|通过)[^，。]{1,24}[，,]")),
    )
    return df.select("*", F.inline(F.filter(hints, lambda h: h["target"].isNotNull())))


def level_label(level: Column) -> Column:
    """The Chinese label of a risk level."""
    return F.when(level == "high", "高").when(level == "medium", "中").otherwise("低")


# What names a source outside the thesis.
EXTERNAL = r"(?i)文献|笔记|refs\.bib|\.bib|paper|arxiv|知网|万方|维普|他人|references"


def citation_needed(source: Column) -> Column:
    """Whether a hit in a source of this label must be quoted and cited (it is from outside) or only reworded."""
    return F.coalesce(source.rlike(EXTERNAL), F.lit(False))
