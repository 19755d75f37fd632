"""Visually identical text with different characters: one consistent form for comparisons.

``normal_form`` is compatibility normalisation in composed form with look-alike letters replaced, full case folding,
mapped white space and default-ignorable characters removed. Texts of one normal form are a class. Within a class
``visual_key`` checks what a reader can see: letter case, accents, raised and lowered digits, bold and slanted letters.
Both are computed once per distinct value of an Arrow batch.

Letters of scripts with many look-alikes (Cherokee, Lisu, Coptic) come from Unicode's table of confusable characters, as
the ICU library that Spark ships has it; those of Greek, Cyrillic and Armenian, where that table also lists letters that
merely resemble each other, are fixed values.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.batches import by_size
from corpusloom.runtime import materialize, salted_join, salted_semi_join

# Letters of other scripts that are drawn like a Latin letter, and that letter.
LOOKALIKES = {
    "greek capital": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϺϜͿ", "ABEZHIKMNOPTYXCMFJ"),
    "greek small": ("οϲϳνυ", "ocjvu"),
    "cyrillic capital": ("АВЕЅІЈКМНОРСТУХԌԚԜҮӀ", "ABESIJKMHOPCTYXGQWYI"),
    "cyrillic small": ("аеорсухѕіјԁԛԝӏүѵһ", "aeopcyxsijdqwlyvh"),
    "armenian": ("ՍՏՕօոսցհ", "USOonugh"),
    "latin": ("ɡɑ", "ga"),
}
# Blocks whose letters are looked up among the confusable characters.
BLOCKS = [(0x13A0, 0x13F5), (0xA4D0, 0xA4F7), (0x2C80, 0x2CE3)]
# Styles of mathematical letters that look like plain ones.
PLAIN_STYLES = ("MATHEMATICAL SANS-SERIF CAPITAL", "MATHEMATICAL SANS-SERIF SMALL", "MATHEMATICAL SANS-SERIF DIGIT", "MATHEMATICAL MONOSPACE")
# Default-ignorable code points (Unicode property), as ranges.
IGNORABLE = [(0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF)]
# Compatibility decompositions that keep the look of the character.
SAME_LOOK = {"<wide>", "<narrow>", "<noBreak>", "<compat>"}

_letters = {ord(a): b for sources, targets in LOOKALIKES.values() for a, b in zip(sources, targets, strict=True)}
_ignorable = {c: None for low, high in IGNORABLE for c in range(low, high + 1)}
_hidden = re.compile("[" + "".join(f"{re.escape(chr(low))}-{re.escape(chr(high))}" for low, high in IGNORABLE) + "]")


@lru_cache(maxsize=1)
def confusable_letters(spark: SparkSession) -> dict[int, str]:
    """Letters of ``BLOCKS`` and the capital or small Latin letter each is confusable with; an error without ICU."""
    try:
        checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    except TypeError as error:  # the class is not there; texts would be told apart by letters that look alike
        raise RuntimeError("no table of confusable letters: ICU (com.ibm.icu) is not on the driver's class path") from error
    skeleton = lambda char: str(checker.getSkeleton(char))
    plain: dict[tuple[str, str], str] = {}
    for char in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz":
        plain.setdefault((skeleton(char), unicodedata.category(char)), char)
    found = {}
    for code in (c for low, high in BLOCKS for c in range(low, high + 1)):
        seen = skeleton(chr(code))
        # scripts without case look like capitals
        if char := plain.get((seen, "Ll" if unicodedata.category(chr(code)) == "Ll" else "Lu")):
            found[code] = char
    return found


class Forms:
    """The normal and the visual form of texts, with a table of look-alike letters."""

    def __init__(self, more: dict[int, str] | None = None):
        self.letters = _letters | (more or {})
        self.seen: dict[int, str] = {}

    def _look(self, code: int) -> str:
        """What a reader sees of a code point."""
        char = chr(code)
        kind, _, parts = unicodedata.decomposition(char).partition(" ")
        if code in self.letters:
            return self.letters[code]
        if char in "\r\x0b\x0c\x85\u2028\u2029":
            return "\n"
        if unicodedata.category(char) == "Zs":
            return " "
        if kind in SAME_LOOK or (kind == "<font>" and unicodedata.name(char, "").startswith(PLAIN_STYLES)):
            whole = "".join(chr(int(x, 16)) for x in parts.split())
            # spacing accents decompose to blank plus mark: these stay as they are
            return char if whole.startswith(" ") else "".join(self[ord(x)] for x in whole)
        return char

    def __getitem__(self, code: int) -> str:
        if (seen := self.seen.get(code)) is None:
            seen = self.seen[code] = self._look(code)
        return seen

    def visual(self, text: str) -> str:
        """The text with everything equalised that a reader cannot see."""
        if text.isascii():
            return text.replace("\r\n", "\n").replace("\r", "\n")
        text = _hidden.sub("", text.replace("\r\n", "\n"))
        # letters are replaced while accents stand apart, else a look-alike with an accent would be composed first
        return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(self))

    def normal(self, text: str) -> str:
        """The comparison form: NFKC, look-alikes replaced, full case folding, mapped blanks, no ignorable characters."""
        if text.isascii():
            return _line_ends.sub("\n", text).replace("\t", " ").lower()
        plain = unicodedata.normalize("NFKD", _line_ends.sub("\n", text).translate(_ignorable).translate(self.letters))
        # letters give way while accents stand apart and before case is folded: a capital's look-alike has another small letter
        folded = unicodedata.normalize("NFKC", plain.translate(self.letters)).casefold()
        return _blanks.sub(" ", unicodedata.normalize("NFKC", folded).translate(_ignorable))


_line_ends = re.compile("\r\n|[\r\x0b\x0c\x85\u2028\u2029]")
_blanks = re.compile(r"[^\S\n]")


def _per_distinct(more: dict[int, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms = Forms(more)
        for batch in by_size(batches):
            encoded = batch.column("text").dictionary_encode()
            values = encoded.dictionary.to_pylist()
            made = [pa.array([None if v is None else f(v) for v in values], pa.string()) for f in (forms.normal, forms.visual)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("text_id"), batch.column("text"), *(form.take(encoded.indices) for form in made)],
                names=["text_id", "text", "normal_form", "visual_key"],
            )

    return run


def normalize_lookalikes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(text_id, text, normal_form, visual_key)`` for every row.

    Null text gives null forms, empty text empty forms; repeated rows stay repeated; other columns are dropped, so none
    can clash. No shuffle: one pass over the scan.
    """
    source = df.select(F.col(id_col).cast("bigint").alias("text_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(_per_distinct(confusable_letters(df.sparkSession)), "text_id bigint, text string, normal_form string, visual_key string")


def lookalike_classes(forms: DataFrame) -> DataFrame:
    """``(text_id, class_id, exact)`` of the texts that look like another, different one.

    Texts of one normal form are a class; classes of one text leave by an aggregate that combines before the shuffle,
    so a text repeated without variants costs nothing. The members left are checked: only those whose visual key is also
    borne by a different text stay, and the key parts the class. Only digests are shuffled. Null texts are in no class.
    """
    digests = forms.filter(F.col("text").isNotNull()).select("text_id", F.sha2("normal_form", 256).alias("form"), F.sha2("visual_key", 256).alias("look"), F.sha2("text", 256).alias("exact"))
    digests = materialize(digests, "looks")
    several = lambda df, key: df.groupBy(key).agg(F.min("exact").alias("low"), F.max("exact").alias("high")).filter("low <> high")
    members = salted_semi_join(digests, several(digests, "form"), "form")
    checked = materialize(members.select("text_id", F.sha2(F.concat("form", "look"), 256).alias("class_id"), "exact"), "members")
    return salted_semi_join(checked, several(checked, "class_id"), "class_id").select("text_id", "class_id", "exact")


def class_links(classes: DataFrame) -> DataFrame:
    """``(text_id, class_id, n_links)``: a row per text of a class, with the number of different texts it looks like."""
    sizes = classes.groupBy("class_id", "exact").agg(F.count(F.lit(1)).alias("same"))
    whole = sizes.groupBy("class_id").agg(F.sum("same").alias("n"))
    own = salted_join(materialize(classes.withColumn("of", F.struct("class_id", "exact")), "classes"), sizes.select(F.struct("class_id", "exact").alias("of"), "same"), "of").drop("of")
    return salted_join(materialize(own, "own"), whole, "class_id").select("text_id", "class_id", (F.col("n") - F.col("same")).alias("n_links"))


def lookalike_pairs(forms: DataFrame, cell: int = 500) -> DataFrame:
    """``(text_id_a, text_id_b)``: texts of one class that are not the same string; smaller id first.

    A class is cut into parts of about ``cell`` texts, so that no task pairs off a large class alone. Null texts have no
    pairs; an empty input gives no rows.
    """
    classes = materialize(lookalike_classes(forms), "varied")
    parts = classes.groupBy("class_id").agg(F.ceil(F.count(F.lit(1)) / cell).alias("parts"))
    members = materialize(salted_join(classes, parts, "class_id"), "members")
    a = members.select(F.col("text_id").alias("text_id_a"), "class_id", F.col("exact").alias("exact_a"), F.pmod(F.xxhash64("text_id"), "parts").alias("part"))
    b = members.select(F.col("text_id").alias("text_id_b"), "class_id", F.col("exact").alias("exact_b"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    return a.join(b, ["class_id", "part"]).filter("text_id_a < text_id_b AND exact_a <> exact_b").select("text_id_a", "text_id_b")
