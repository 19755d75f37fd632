"""Column functions over text: width, normal form, shingles, line kinds, markup, clipping and counts.

All are compositions of built-in functions, so they stay in the JVM. Null text gives null unless stated otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Punctuation and its plain counterpart, one for one.
PUNCT_FROM = "，。、；：？！（）【】《》“”‘’—–…～·　"
PUNCT_TO = ",.,;:?!()[]<>\"\"''--.~. "
WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
NARROW = "".join(map(chr, range(0x21, 0x7F)))
BOM = "﻿"
HALF_FROM = WIDE + "".join(c for c in PUNCT_FROM if c not in WIDE) + BOM
HALF_TO = NARROW + "".join(t for c, t in zip(PUNCT_FROM, PUNCT_TO, strict=True) if c not in WIDE)
CJK = r"[一-鿿]"
TOKEN = "[㐀-䶿一-鿿豈-﫿]|[A-Za-zÀ-ɏ][A-Za-z0-9_À-ɏ]*|[0-9][0-9.]*"
# runs of tokens as group 1, or what stands between tokens: one replacement by the group drops all the rest
NOT_TOKEN = "([㐀-䶿一-鿿豈-﫿]+|[A-Za-zÀ-ɏ][A-Za-z0-9_À-ɏ]*|[0-9][0-9.]*)|[^㐀-䶿一-鿿豈-﫿A-Za-zÀ-ɏ0-9]+"

# The kinds of line that are no running text, as patterns both engines read.
LINE_KINDS = {
    "heading": r"^\s{0,3}#{1,6}\s",
    "fence": r"^\s{0,3}(`{3,}|~{3,})",
    "indented": r"^( {4,}|\t)\S",
    "formula": r"^\s*(\$\$|\\[a-zA-Z]*\{?(equation|align|array))",
    "structural": r"^\s*(!\[|<!--|(-{3,}|\*{3,}|_{3,})\s*$)|-->\s*$",
    "table": r"^\s{0,3}\|",
    "quote": r"^\s{0,3}>",
    "list": r"^\s{0,3}([-*+]|\d+[.)])\s",
    "reference_heading": r"^\s*(#{1,6}\s*)?(?i:参考文献|引用文献|references?|bibliography)\s*$",
    "reference_entry": r"^\s{0,3}\[\d{1,3}\]\s*\S",
    "placeholder": r"^\s*[（(]\s*(写作要求|待补|待写|待演练|待填写)|^\s*(TODO|TBD|FIXME)\b",
}
MATH_SIGNS = r"[$\\=+\-*/^_{}()\[\]]"


def half_width(text: Column) -> Column:
    """Full-width forms and CJK punctuation to plain ones, the byte order mark dropped, line ends to LF."""
    return F.regexp_replace(F.translate(text, HALF_FROM, HALF_TO), "\r\n?", "\n")


def tokens(text: Column) -> Column:
    """Ideographs one by one, Latin words in lower case, numbers with their dots; everything else is dropped."""
    return F.transform(F.regexp_extract_all(half_width(text), F.lit(TOKEN), 0), F.lower)


def normal(text: Column) -> Column:
    """The tokens of a text run together: what overlap is measured on. One replacement, no array of tokens."""
    return F.lower(F.regexp_replace(half_width(text), NOT_TOKEN, "$1"))


def bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once: a lambda's argument, not an expression repeated at each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingles(normalised: Column, n: int) -> Column:
    """Distinct substrings of ``n`` characters; a shorter, non-empty text is one shingle, an empty one has none.

    All windows come from one scan for a lookahead, which matches at every character.
    """

    def of(text: Column) -> Column:
        windows = F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), 1))
        return F.when(text == "", F.array().cast("array<string>")).when(F.char_length(text) <= n, F.array(text)).otherwise(windows)

    return bind(normalised, of)


def fnv1a(text: Column) -> Column:
    """The 32-bit FNV-1a hash over the UTF-16 units of a text, as BIGINT."""
    # two bytes a unit: hex digits are cut into fours
    digits = F.hex(F.encode(text, "UTF-16BE"))
    units = F.transform(F.regexp_extract_all(digits, F.lit("[0-9A-F]{4}"), 0), lambda c: F.conv(c, 16, 10).cast("bigint"))
    prime, start = 16777619, 2166136261
    return F.aggregate(units, F.lit(start).cast("bigint"), lambda h, u: (h.bitwiseXOR(u) * prime).bitwiseAND(F.lit(4294967295)))


def is_formula(line: Column) -> Column:
    """A marked formula, or a line at least half of which is mathematical signs."""
    packed = F.regexp_replace(line, r"\s", "")
    signs = F.char_length(packed) - F.char_length(F.regexp_replace(packed, MATH_SIGNS, ""))
    return line.rlike(LINE_KINDS["formula"]) | (line.rlike(r"[$\\=]") & (F.char_length(packed) > 0) & (signs >= F.char_length(packed) * 0.5))


def line_kind(line: Column) -> Column:
    """The first kind that fits: blank, one of ``LINE_KINDS``, or text."""
    kind = F.when(line.rlike(r"^\s*$"), "blank")
    for name, pattern in LINE_KINDS.items():
        kind = kind.when(is_formula(line) if name == "formula" else line.rlike(pattern), name)
    return kind.otherwise("text")


def cjk_count(text: Column) -> Column:
    """Number of ideographs U+4E00 to U+9FFF; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(CJK)), F.lit(0))


def clip(text: Column, most: int) -> Column:
    """White space collapsed and cut to ``most`` characters with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"[\s\p{Z}]+", " "))
    return F.when(F.char_length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("…"))).otherwise(flat)


# Named character references and what they stand for.
ENTITIES = {"&nbsp;": " ", "&mdash;": "—", "&ndash;": "–", "&hellip;": "…", "&middot;": "·", "&bull;": "•", "&copy;": "©", "&reg;": "®", "&trade;": "™", "&ldquo;": "“", "&rdquo;": "”", "&lsquo;": "‘", "&rsquo;": "’", "&times;": "×", "&deg;": "°", "&plusmn;": "±", "&ne;": "≠", "&le;": "≤", "&ge;": "≥", "&rarr;": "→", "&larr;": "←", "&euro;": "€", "&pound;": "£", "&yen;": "¥", "&alpha;": "α", "&beta;": "β", "&gamma;": "γ", "&delta;": "δ", "&mu;": "μ", "&pi;": "π", "&sigma;": "σ", "&omega;": "ω"}
XML_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}


def _by_number(text: Column) -> Column:
    """Decimal and hexadecimal character references replaced; those outside Unicode stay as they are."""
    mark = "&#(?:[0-9]{1,7}|x[0-9a-fA-F]{1,6});"

    def char(ref: Column) -> Column:
        number = F.when(F.substring(ref, 3, 1) == "x", F.conv(F.regexp_extract(ref, "x([0-9a-fA-F]+)", 1), 16, 10)).otherwise(F.regexp_extract(ref, "([0-9]+)", 1)).cast("int")
        # a code point is four bytes of UTF-32
        one = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        return F.when((number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF), one).otherwise(ref)

    pieces = F.split(text, mark)
    found = F.regexp_extract_all(text, F.lit(mark), 0)
    decoded = F.concat(F.get(pieces, F.lit(0)), F.array_join(F.transform(found, lambda ref, i: F.concat(char(ref), F.get(pieces, i + 1))), ""))
    return F.when(F.contains(text, F.lit("&#")), decoded).otherwise(text)


def decode_entities(text: Column, names: dict[str, str] = XML_ENTITIES) -> Column:
    """Character references replaced: the ampersand first, then the other names, then numbers."""
    for name, char in sorted(names.items(), key=lambda x: x[0] != "&amp;"):
        text = F.replace(text, F.lit(name), F.lit(char))
    return _by_number(text)


def strip_tags(text: Column) -> Column:
    """References decoded, tags replaced by blanks, white space collapsed, what is left decoded again."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(decode_entities(text), r"<[^>]+>", " "), r"\s+", " "))
    return decode_entities(plain)


BLOCK_END = "p|div|li|tr|h[1-6]|section|article|blockquote|pre|table|ul|ol|dl|dd|dt|figcaption"


def html_to_text(html: Column) -> Column:
    """Text of an HTML page: no comments, scripts or styles, cells to tabs, block ends to line ends, blank runs short."""
    text = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    text = F.regexp_replace(text, r"(?is)<(script|style|noscript|template)\b[^>]*>.*?</\1\s*>", "")
    for pattern, to in ((r"(?i)</t[dh]\s*>", "\t"), (r"(?i)<br\s*/?>", "\n"), (rf"(?i)</({BLOCK_END})\s*>", "\n"), (r"(?i)<(hr|li)\b[^>]*>", "\n"), (r"(?s)<[^>]*>", "")):
        text = F.regexp_replace(text, pattern, to)
    for name, char in {**ENTITIES, **XML_ENTITIES}.items():
        if name == "&amp;":  # last: what it leaves is not decoded again
            text = _by_number(text)
        text = F.replace(text, F.lit(name), F.lit(char))
    text = F.regexp_replace(F.regexp_replace(text, r"(?m)[ \t]+$", ""), r"(?m)^[ \t]+", "")
    return F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


# Elements of a text that a rewrite must keep.
PROTECTED = {
    "number": r"[0-9]+(?:\.[0-9]+)*(?:%|‰|[万亿千百]?[年月日个次条项分秒人台例篇倍种]|[a-zA-Z]{1,8})?",
    "citation": r"\[\d+(?:\s*[-,]\s*\d+)*\]",
    "code": r"`[^`\n]{1,40}`|\b[A-Za-z][A-Za-z0-9]*_[A-Za-z0-9_]+\b|[a-z]+[A-Z][A-Za-z0-9]*|[A-Za-z][A-Za-z0-9]*\(\)",
    "term": "[\"“”]([^\"“”\n]{2,30})[\"“”]",
}


def protected_elements(text: Column) -> Column:
    """``ARRAY<STRUCT<kind, text>>``: distinct protected elements per kind, in the order of the kinds."""

    def named(kind: str):
        return lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("text"))

    return F.concat(*(F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(p), 1 if k == "term" else 0)), named(k)) for k, p in PROTECTED.items()))


# Words that say nothing about a subject.
STOP_WORDS = [
    "的", "了", "是", "在", "我", "你", "他", "她", "它", "们", "这", "那", "有", "和", "与", "或", "把", "被", "让", "给", "对", "为", "从", "到", "就", "都", "也", "还", "很", "要", "会", "能", "一个", "什么", "怎么", "如何", "可以", "需要", "现在", "我们", "你们", "他们", "这个", "那个", "the", "a", "an", "is", "are", "was", "were", "be", "to", "of", "in", "on", "for", "and", "or", "it", "this", "that", "with", "my", "me", "you", "we", "please", "help",
]


def keywords(text: Column, most: int = 24, least: int = 2) -> Column:
    """Latin words and ideograph runs (up to four whole, longer ones as pairs), no stop words, longest first."""
    latin = F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z][a-z0-9_.-]{1,30}"), 0), lambda w: F.char_length(w) >= least)
    runs = F.regexp_extract_all(text, F.lit("[一-龥]{2,}"), 0)
    grams = lambda r: F.when(F.char_length(r) <= 4, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.char_length(r) - 1), lambda i: F.substring(r, i, F.lit(2))))
    stop = F.array(*map(F.lit, STOP_WORDS))
    words = F.array_except(F.concat(latin, F.flatten(F.transform(runs, grams))), stop)
    keyed = F.array_sort(F.transform(words, lambda w: F.struct((-F.char_length(w)).alias("n"), w.alias("w"))))
    return F.slice(F.transform(keyed, lambda s: s["w"]), 1, most)


def probes(text: Column) -> Column:
    """Every distinct piece of two to four characters within runs of keyword characters, in lower case.

    A keyword stands in a text only if its first four characters (or all of it) are among the text's probes.
    """
    runs = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_.-]{2,}|[一-龥]{2,}"), 0)

    def of(n: int):
        cut = lambda r: F.transform(F.sequence(F.lit(1), F.char_length(r) - n + 1), lambda i: F.substring(r, i, F.lit(n)))
        return F.flatten(F.transform(F.filter(runs, lambda r: F.char_length(r) >= n), cut))

    return F.array_distinct(F.concat(of(2), of(3), of(4)))


def cited_numbers(text: Column, most_range: int = 10_000_000) -> Column:
    """Distinct numbers cited as ``[1]``, ``[2-4]`` or ``[1,3]``, ascending; a reversed range cites nothing.

    A range of more than ``most_range`` numbers fails the query rather than being cut.
    """
    marks = F.regexp_extract_all(text, F.lit(r"\[(\d+(?:[-,，]\d+)*)\]"), 1)
    parts = F.filter(F.flatten(F.transform(marks, lambda m: F.split(m, "[,，]"))), lambda p: p.rlike(r"^\d{1,18}(-\d{1,18})?$"))

    def numbers(p: Column) -> Column:
        ends = F.transform(F.split(p, "-"), lambda x: x.cast("bigint"))
        low, high = F.get(ends, F.lit(0)), F.element_at(ends, -1)
        return F.when(high < low, F.array().cast("array<bigint>")).when(high - low > most_range, F.raise_error(F.concat(F.lit("range too long: "), p)).cast("array<bigint>")).otherwise(F.sequence(low, F.greatest(low, high)))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, numbers))))


# How a date is written, with a year and without.
DATE = r"(\d{4})\s*[-/.年]\s*(\d{1,2})\s*[-/.月]\s*(\d{1,2})\s*日?"
MONTH_DAY = r"(\d{1,2})\s*月\s*(\d{1,2})\s*日?"


def date_parts(text: Column) -> Column:
    """``STRUCT<year, month, day>`` of the first date in a text; a date without year has a null year, no date is null."""
    part = lambda p, n: F.nullif(F.regexp_extract(text, p, n), F.lit("")).cast("int")
    whole = F.struct(part(DATE, 1).alias("year"), part(DATE, 2).alias("month"), part(DATE, 3).alias("day"))
    short = F.struct(F.lit(None).cast("int").alias("year"), part(MONTH_DAY, 1).alias("month"), part(MONTH_DAY, 2).alias("day"))
    return F.when(text.rlike(DATE), whole).when(text.rlike(MONTH_DAY), short)


def date_problem(parts: Column, this_year: int, back: int = 1, ahead: int = 6) -> Column:
    """Why ``date_parts`` cannot be a date near ``this_year``: missing, month_day or year; no_year for one without; else null."""
    wrong = ~parts["month"].between(1, 12) | ~parts["day"].between(1, 31)
    return F.when(parts.isNull(), "missing").when(wrong, "month_day").when(parts["year"].isNull(), "no_year").when(~parts["year"].between(this_year - back, this_year + ahead), "year")


def summary_name(path: Column, fallback: str = "材料") -> Column:
    """A safe file name for notes on a file: its base name without extension and forbidden characters, with ``.md``."""
    base = F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[^.]*$", "")
    safe = F.trim(F.regexp_replace(base, r'[\\/:*?"<>|\x00-\x1f]', "_"))
    return F.concat(F.coalesce(F.nullif(safe, F.lit("")), F.lit(fallback)), F.lit(".md"))


def signed(value: Column) -> Column:
    """A number with one decimal at most and its sign, halves upwards; zero has none."""
    tenth = F.floor(value * 10 + 0.5) / 10
    digits = F.regexp_replace(F.format_string("%.1f", tenth), r"\.0$", "")
    return F.concat(F.when(tenth > 0, "+").otherwise(""), F.regexp_replace(digits, "^-0$", "0"))


def quality(text: Column) -> Column:
    """``STRUCT<n, printable, unreadable>``: characters, the share of them that print, and that of replacement marks; shares of an empty text are 1 and 0."""
    n = F.char_length(text)
    share = lambda p: F.try_divide(F.regexp_count(text, F.lit(p)).cast("double"), n)
    return F.struct(n.cast("bigint").alias("n"), F.coalesce(1 - share(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"), F.lit(1.0)).alias("printable"), F.coalesce(share("\ufffd"), F.lit(0.0)).alias("unreadable"))
