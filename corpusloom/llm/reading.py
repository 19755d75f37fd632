"""Reading level of each document: one smoothed unigram language model per grade level.

Words are runs of letters, and pairs of neighbouring ideographs where the script has no word spaces. Headings, table
rows, list items, reference entries and fenced code are taken out before. The level with the highest posterior is
assigned. Models are trained on the rated documents, each rating adding its share of the document's words to its
level, so disagreement between raters stays in the model.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.batches import by_size
from corpusloom.runtime import spread

LEVELS = 5
MOST_RATED = 50_000  # rated documents a model is trained on at most
SMOOTHING = 2000.0  # words of the common model added to each level's: a word met once decides nothing
ASIDE = re.compile(r"^(?:```.*?(?:^```[^\n]*$|\Z)|~~~.*?(?:^~~~[^\n]*$|\Z)|[ \t]{0,3}#{1,6}[ \t][^\n]*$|[ \t]*\|[^\n]*$|[ \t]*(?:[-*+]|\d{1,3}[.)])[ \t][^\n]*$|\[\d+\][^\n]*$)", re.S | re.M)


def prose(text: str) -> str:
    """The running text of a Markdown document, in lower case."""
    return ASIDE.sub("\n", text).lower()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


_kinds = np.zeros(0x110000, dtype=np.int8)  # 0 other, 1 letter (or a mark that goes with one), 2 written without word spaces
_kinds[[c for c in range(0x110000) if unicodedata.category(chr(c))[0] in "LM"]] = 1
# Scripts without word spaces: ideographs, kana, Thai, Lao, Myanmar, Khmer.
for _low, _high in ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF), (0x3041, 0x30FF), (0x31F0, 0x31FF), (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF)):
    _kinds[_low : _high + 1] = 2


def words(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """64-bit word hashes of all texts (odd for ideographs), and the number of the text each is from."""
    bodies = [prose(t) if t else "" for t in texts]
    ends = np.cumsum([len(b) + 1 for b in bodies])
    codes = np.frombuffer("\n".join(bodies + [""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = _kinds[codes]
    han = np.flatnonzero((kind[:-1] == 2) & (kind[1:] == 2))
    pairs = _mix(_mix(codes[han].astype(np.uint64)) + codes[han + 1].astype(np.uint64)) | np.uint64(1)
    letter = kind == 1
    edge = np.diff(letter.astype(np.int8), prepend=0)
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    at = np.flatnonzero(letter)
    if not len(at):
        return pairs, np.searchsorted(ends, han, side="right")
    sizes = stops - starts  # every text ends in a line feed, so every word stops
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(at)) - np.repeat(first, sizes)
    whole = _mix(np.add.reduceat(_mix(codes[at].astype(np.uint64) + (place.astype(np.uint64) << np.uint64(32))), first)) & ~np.uint64(1)
    return np.concatenate([pairs, whole]), np.concatenate([np.searchsorted(ends, han, side="right"), np.searchsorted(ends, starts, side="right")])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_size(batches):
        word, doc = words(batch.column("text").to_pylist())
        shares = np.array(batch.column("shares").to_pylist(), dtype=np.float64).reshape(-1, LEVELS)
        distinct, inverse = np.unique(word, return_inverse=True)
        table = [np.bincount(inverse, weights=shares[doc, k], minlength=len(distinct)) for k in range(LEVELS)]
        yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), *map(pa.array, table)], names=["word", *(f"n{k + 1}" for k in range(LEVELS))])


class LevelModel:
    """Log-likelihoods per word and level; words outside the vocabulary say nothing."""

    def __init__(self, vocabulary: np.ndarray, counts: np.ndarray, prior: np.ndarray, smoothing: float = SMOOTHING):
        by = np.argsort(vocabulary)
        self.vocabulary, counts = vocabulary[by], counts[by]
        self.likelihood = np.zeros(counts.shape, dtype=np.float32)
        for script in (0, 1):  # each script has its own models: which script a text is in says nothing of its level
            own = (self.vocabulary & np.uint64(1)) == script
            if own.any():
                common = counts[own].sum(axis=1, keepdims=True) / counts[own].sum()
                self.likelihood[own] = np.log((counts[own] + smoothing * common) / (counts[own].sum(axis=0) + smoothing))
        self.prior = np.log(np.maximum(prior, 1e-9))

    def posteriors(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Posterior of each level per text, and the number of known words it rests on."""
        word, doc = words(texts)
        n = len(texts)
        if not len(self.vocabulary):
            return np.tile(np.exp(self.prior) / np.exp(self.prior).sum(), (n, 1)), np.zeros(n, dtype=np.int64)
        place = np.minimum(np.searchsorted(self.vocabulary, word), len(self.vocabulary) - 1)
        known = self.vocabulary[place] == word
        place, doc = place[known], doc[known]
        score = np.stack([np.bincount(doc, weights=self.likelihood[place, k], minlength=n) for k in range(LEVELS)], axis=1) + self.prior
        score = np.exp(score - score.max(axis=1, keepdims=True))
        return score / score.sum(axis=1, keepdims=True), np.bincount(doc, minlength=n)


def fit_levels(docs: DataFrame, ratings: DataFrame, most_rated: int = MOST_RATED) -> LevelModel:
    """Train on the rated documents: at most ``most_rated``, picked by a hash of the id, with all of their words.

    Null ratings and ratings outside 1 to 5 are left out; a document of several raters adds its words in shares. Without ratings the model is empty and every level equally likely.
    """
    rated = ratings.filter(F.col("reading_level").between(1, LEVELS) & F.col("doc_id").isNotNull())
    levels = [F.avg((F.col("reading_level") == k + 1).cast("double")) for k in range(LEVELS)]
    shares = rated.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.array(*levels).alias("shares"))
    shares = shares.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rated)  # bounded, hence the broadcast
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(shares), "doc_id")
    names = [f"n{k + 1}" for k in range(LEVELS)]
    parts = texts.select("text", "shares").mapInArrow(_counts, "word bigint, " + ", ".join(f"{n} double" for n in names))
    counts = parts.groupBy("word").agg(*(F.sum(n).alias(n) for n in names)).toPandas()  # the words of ``most_rated`` documents
    prior = shares.agg(*(F.sum(F.col("shares")[k]).alias(names[k]) for k in range(LEVELS))).first()
    weight = np.array([prior[n] or 0.0 for n in names]) + 1.0
    return LevelModel(counts["word"].to_numpy(np.int64).view(np.uint64), counts[names].to_numpy(np.float64), weight / weight.sum())


def reading_levels(docs: DataFrame, model: LevelModel) -> DataFrame:
    """``(doc_id, reading_level, confidence, demanding, n_words)`` for every document row.

    ``reading_level`` has the highest posterior, ``confidence`` is that posterior, ``demanding`` the posterior of levels
    4 and 5 together. A document without a known word of running text (null, empty, only tables) has null in all three.
    One pass over the scan, no shuffle; the model is broadcast and bounded by its number of words.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches):
            posterior, n = sent.value.posteriors(batch.column("text").to_pylist())
            none = n == 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array((posterior.argmax(axis=1) + 1).astype(np.int32), mask=none),
                    pa.array(posterior.max(axis=1) if len(posterior) else np.zeros(0), mask=none),
                    pa.array(posterior[:, 3:].sum(axis=1), mask=none),
                    pa.array(n.astype(np.int64)),
                ],
                names=["doc_id", "reading_level", "confidence", "demanding", "n_words"],
            )

    source = spread(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return source.mapInArrow(run, "doc_id bigint, reading_level int, confidence double, demanding double, n_words bigint")


def demanding_documents(levels: DataFrame) -> DataFrame:
    """``(doc_id)`` of the documents that were assigned level 4 or 5."""
    return levels.filter(F.col("reading_level") >= 4).select("doc_id").distinct()


def level_profile(levels: DataFrame, docs: DataFrame) -> DataFrame:
    """``(source, reading_level, n_docs, mean_confidence)``: the corpus by source and level; null sources are one group."""
    joined = levels.join(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lower(F.trim("source")).alias("source")), "doc_id")
    return joined.groupBy("source", "reading_level").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("confidence").alias("mean_confidence"))
