"""Overlap of paragraphs with a reference collection: containment, best hit, risk levels, weighted rate, spans.

Both sides are exploded to distinct shingles, as 64-bit hashes, and meet in an equi-join: a pair without a common shingle
has containment 0, so nothing is lost. A collection whose shingles are counted and few is sent to all tasks: then the
shingles of a paragraph stay together, counting combines before the shuffle, and only pairs are moved. Beyond that
size both sides are shuffled by shingle, and shingles that flood either side are spread over cells.

Within scopes, where most pairs have common shingles, no pair is shuffled: both sides of a scope are cut into blocks of
bounded length, and the texts of each two blocks meet in one task, which counts there and gives the hits alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.runtime import fits, hot_keys, materialize, spread

SHINGLE, LEAST_RUN, MOST_SPANS = 4, 8, 5
MOST_SENT = 2_000_000  # shingles of a collection that is sent to all tasks: about 50 MB
BLOCK_CHARS = 2_000_000  # characters of one side of a scope that a task holds; a longer text is held by itself
COUNTED = 4_000_000  # meetings of shingles, and cells of counts, that are held at once
SIDES = 8  # a flooding shingle is met in SIDES x SIDES cells


def fingerprints(df: DataFrame, key: str, normalised: str, n: int) -> DataFrame:
    """``(key, size, shingle)``: a row per distinct shingle, as a hash, with their number. Null and empty texts have none."""
    hashed = F.array_distinct(F.transform(T.shingles(F.col(normalised), n), lambda x: F.xxhash64(x)))
    return df.select(key, hashed.alias("all")).select(key, F.size("all").alias("size"), F.explode("all").alias("shingle"))


def _met(left: DataFrame, right: DataFrame, most_sent: int) -> DataFrame:
    """All pairs of rows with an equal ``shingle``."""
    if fits(right, most_sent):
        return left.join(F.broadcast(right), "shingle")
    left = materialize(left, "left")
    hot = [h for h in (hot_keys(left, "shingle"), hot_keys(right, "shingle")) if h is not None]
    if not hot:
        return left.join(right, "shingle")
    every = hot[0] if len(hot) == 1 else hot[0].union(hot[1]).distinct()  # twice MOST_HOT rows at most
    flagged = lambda df: df.join(F.broadcast(every.withColumn("is_hot", F.lit(True))), "shingle", "left")
    own = lambda df: F.when(F.col("is_hot"), F.pmod(F.xxhash64(*(c for c in df.columns if c != "shingle")), F.lit(SIDES))).otherwise(0)
    other = F.explode(F.when(F.col("is_hot"), F.sequence(F.lit(0).cast("long"), F.lit(SIDES - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long"))))
    a = flagged(left).withColumn("side_a", own(left)).withColumn("side_b", other).drop("is_hot")
    b = flagged(right).withColumn("side_b", own(right)).withColumn("side_a", other).drop("is_hot")
    return a.join(b, ["shingle", "side_a", "side_b"])


def containment_hits(segments: DataFrame, corpus: DataFrame, n: int = SHINGLE, least: float = 0.0, scope: str | None = None, most_sent: int = MOST_SENT) -> DataFrame:
    """``(segment_id, corpus_id, common, containment, jaccard)`` of all pairs with a common shingle.

    ``segments`` has ``(segment_id, normalised)``, ``corpus`` ``(corpus_id, normalised)``. Containment is the share of
    the segment's distinct shingles found in the other text. Pairs below ``least`` are left out. Where ``segments`` has
    ``own_id``, that corpus text is its own and not compared. ``scope``, a column of both, keeps scopes apart.
    """
    own = ["own_id"] if "own_id" in segments.columns else []
    if scope:
        return _scoped_hits(segments.select("segment_id", "normalised", scope, *own), corpus.select("corpus_id", "normalised", scope), n, least, scope)
    key = F.struct("segment_id", *own).alias("at")
    left = fingerprints(spread(segments.select(key, "normalised")), "at", "normalised", n).select("at.*", F.col("size").alias("a_size"), "shingle")
    right = materialize(fingerprints(spread(corpus.select("corpus_id", "normalised")), "corpus_id", "normalised", n).withColumnRenamed("size", "b_size"), "right")
    met = _met(left, right, most_sent)
    if own:
        met = met.filter("corpus_id <> own_id")
    counted = met.groupBy("segment_id", "corpus_id").agg(F.count(F.lit(1)).alias("common"), F.first("a_size").alias("a"), F.first("b_size").alias("b"))
    out = counted.select("segment_id", "corpus_id", "common", (F.col("common") / F.col("a")).alias("containment"), (F.col("common") / (F.col("a") + F.col("b") - F.col("common"))).alias("jaccard"))
    return out.filter(F.col("containment") >= least) if least else out


def _shingle_rows(texts: list, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``(owner, shingle)``: the distinct shingles of each text as 64-bit hashes, in the order of the hash."""
    texts = [t or "" for t in texts]
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(lengths)

    def mixed(places: np.ndarray, width: int) -> np.ndarray:
        out = np.full(len(places), width, dtype=np.uint64)
        for k in range(width):
            out = (out ^ codes[places + k]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
            out *= np.uint64(0xBF58476D1CE4E5B9)
            out ^= out >> np.uint64(32)
        return out

    windows = np.maximum(lengths - n + 1, 0)
    owner = np.repeat(np.arange(len(texts)), windows)
    starts = np.repeat(ends - lengths, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    owners, hashes = [owner], [mixed(starts, n)]
    for width in range(1, n):  # a shorter text is one shingle
        of = np.flatnonzero(lengths == width)
        owners.append(of)
        hashes.append(mixed((ends - lengths)[of], width))
    owner, hashed = np.concatenate(owners), np.concatenate(hashes)
    order = np.argsort(hashed, kind="stable")  # owners stay in order within a hash
    owner, hashed = owner[order], hashed[order]
    fresh = np.ones(len(owner), dtype=bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (hashed[1:] != hashed[:-1])
    return owner[fresh], hashed[fresh]


def common_shingles(segments: list, corpus: list, n: int, least: float) -> Iterator[tuple[np.ndarray, ...]]:
    """``(segment, text, common, size of segment, size of text)`` of the pairs that meet and reach ``least``, by their places."""
    b_owner, b_hash = _shingle_rows(corpus, n)
    a_owner, a_hash = _shingle_rows(segments, n)
    a_size, b_size = np.bincount(a_owner, minlength=len(segments)), np.bincount(b_owner, minlength=len(corpus))
    starts = np.flatnonzero(np.concatenate([[True], b_hash[1:] != b_hash[:-1]])) if len(b_hash) else np.zeros(0, dtype=np.int64)
    held, runs = b_hash[starts], np.diff(np.append(starts, len(b_hash)))
    place = np.searchsorted(held, a_hash)  # both in order
    met = np.flatnonzero(place < len(held))
    met = met[held[place[met]] == a_hash[met]]
    met = met[np.argsort(a_owner[met], kind="stable")]
    a_owner, first, often = a_owner[met], starts[place[met]], runs[place[met]]
    bounds = np.searchsorted(a_owner, np.arange(len(segments) + 1))
    meetings = np.concatenate([[0], np.cumsum(often)])[bounds]  # of all segments before each
    at = 0
    while at < len(segments):
        stop = min(int(np.searchsorted(meetings, meetings[at] + COUNTED, side="right")) - 1, at + max(1, COUNTED // max(1, len(corpus))), len(segments))
        stop = max(at + 1, stop)
        rows = slice(bounds[at], bounds[stop])
        times = often[rows]
        total = int(times.sum())
        places = np.repeat(first[rows] - (np.cumsum(times) - times), times) + np.arange(total)
        counts = np.bincount(np.repeat((a_owner[rows] - at) * len(corpus), times) + b_owner[places], minlength=1)
        cell = np.flatnonzero(counts)
        segment, text, common = cell // len(corpus) + at, cell % len(corpus), counts[cell]
        keep = common / a_size[segment] >= least
        yield segment[keep], text[keep], common[keep], a_size[segment[keep]], b_size[text[keep]]
        at = stop


def _scoped_hits(segments: DataFrame, corpus: DataFrame, n: int, least: float, scope: str) -> DataFrame:
    """``containment_hits`` within each ``scope``; a null one holds nothing."""
    own = "own_id" in segments.columns
    segments, corpus = materialize(segments, "segments"), materialize(corpus, "corpus")
    blocks = lambda df, name: df.filter(F.col(scope).isNotNull()).groupBy(scope).agg(F.greatest(F.lit(1).cast("bigint"), F.ceil(F.sum(F.char_length("normalised")) / BLOCK_CHARS)).alias(name))
    cells = materialize(blocks(segments, "a_blocks").join(blocks(corpus, "b_blocks"), scope), "cells")
    placed = lambda df, key, mine, other, a, b: df.join(cells, scope).select(*df.columns, F.pmod(F.xxhash64(key), mine).alias(a), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other) - 1)).alias(b)).drop("a_blocks", "b_blocks")
    left = placed(segments, "segment_id", "a_blocks", "b_blocks", "a_block", "b_block")
    right = placed(corpus, "corpus_id", "b_blocks", "a_blocks", "b_block", "a_block")

    def count(a: pa.Table, b: pa.Table) -> pa.Table:
        ids = a.column("segment_id").combine_chunks(), b.column("corpus_id").combine_chunks()
        own_ids = a.column("own_id").combine_chunks() if own else None
        found: list[list[pa.Array]] = []
        if len(ids[0]) and len(ids[1]):
            for segment, text, *sizes in common_shingles(a.column("normalised").to_pylist(), b.column("normalised").to_pylist(), n, least):
                names = [ids[0].take(pa.array(segment)), ids[1].take(pa.array(text))]
                batch = pa.table([*names, *(pa.array(x.astype(np.int64)) for x in sizes)], schema=schema)
                if own:
                    batch = batch.filter(pc.not_equal(names[1], own_ids.take(pa.array(segment)).cast(names[1].type)))
                found.append(batch)
        return pa.concat_tables(found) if found else schema.empty_table()

    kinds = dict(segments.dtypes) | dict(corpus.dtypes)
    schema_sql = f"segment_id {kinds['segment_id']}, corpus_id {kinds['corpus_id']}, common bigint, a bigint, b bigint"
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    schema = pa.schema([("segment_id", arrow[kinds["segment_id"]]), ("corpus_id", arrow[kinds["corpus_id"]]), ("common", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
    keys = [scope, "a_block", "b_block"]
    counted = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(count, schema_sql)
    return counted.select("segment_id", "corpus_id", "common", (F.col("common") / F.col("a")).alias("containment"), (F.col("common") / (F.col("a") + F.col("b") - F.col("common"))).alias("jaccard"))


def longest_runs(pairs: DataFrame, shingle: int = SHINGLE, least: int = LEAST_RUN) -> DataFrame:
    """``(segment_id, corpus_id, longest_run)`` of pairs ``(segment_id, corpus_id, a, b)``; 0 for none of ``least`` characters."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            spans = (common_spans(a or "", b or "", shingle, least, 1) for a, b in zip(pdf.a, pdf.b, strict=True))
            yield pdf[["segment_id", "corpus_id"]].assign(longest_run=[s[0][0] if s else 0 for s in spans])

    kinds = dict(pairs.dtypes)
    return pairs.select("segment_id", "corpus_id", "a", "b").mapInPandas(run, f"segment_id {kinds['segment_id']}, corpus_id {kinds['corpus_id']}, longest_run long")


def best_hits(hits: DataFrame, segments: DataFrame, corpus: DataFrame, shingle: int = SHINGLE, least: int = LEAST_RUN) -> DataFrame:
    """``(segment_id, corpus_id, score)``: the highest containment per segment, then the longest run, then the smallest id.

    ``hits`` should be materialised. Runs are looked for where the highest containment is shared only.
    """
    by_score = hits.groupBy("segment_id", "containment").agg(F.count(F.lit(1)).alias("n"), F.min("corpus_id").alias("corpus_id"))
    top = materialize(by_score.groupBy("segment_id").agg(F.max(F.struct("containment", "n", "corpus_id")).alias("top")).select("segment_id", "top.*"), "top")
    tied = hits.join(top.filter("n > 1").select("segment_id", "containment"), ["segment_id", "containment"])
    texts = tied.join(segments.select("segment_id", F.col("normalised").alias("a")), "segment_id").join(corpus.select("corpus_id", F.col("normalised").alias("b")), "corpus_id")
    runs = longest_runs(texts, shingle, least).groupBy("segment_id").agg(F.min_by("corpus_id", F.struct(-F.col("longest_run"), F.col("corpus_id"))).alias("longest"))
    return top.join(runs, "segment_id", "left").select("segment_id", F.coalesce("longest", "corpus_id").alias("corpus_id"), F.col("containment").alias("score"))


def risk_level(score: Column, threshold: float) -> Column:
    """high from the threshold on, medium from 0.6 of it, else low; a segment without hit is low."""
    return F.when(score >= threshold, "high").when(score >= threshold * 0.6, "medium").otherwise("low")


def risk_summary(segments: DataFrame, best: DataFrame, threshold: float = 0.3) -> DataFrame:
    """One row: paragraphs, matched, high, medium, low, sources of medium and high, characters, weighted rate.

    The rate is the sum of characters times best score over all characters, 0 for no characters.
    """
    joined = segments.select("segment_id", "n_chars").join(best, "segment_id", "left")
    level = risk_level(F.col("score"), threshold)
    return joined.agg(
        F.count(F.lit(1)).alias("paragraph_count"),
        F.count("score").alias("matched_count"),
        F.count_if(level == "high").alias("high"),
        F.count_if(level == "medium").alias("medium"),
        F.count_if(level == "low").alias("low"),
        F.count_distinct(F.when(level != "low", F.col("corpus_id"))).alias("source_count"),
        F.coalesce(F.sum("n_chars"), F.lit(0)).alias("total_chars"),
        F.coalesce(F.try_divide(F.sum(F.col("n_chars") * F.coalesce("score", F.lit(0.0))), F.sum("n_chars")), F.lit(0.0)).alias("weighted_rate"),
    )


def rate_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Drop of the weighted rate and of the risk counts between two one-row summaries, with a verdict."""
    names = ["high", "medium", "weighted_rate"]
    a = before.select(F.lit(1).alias("one"), *(F.col(n).alias(f"before_{n}") for n in names))
    b = after.select(F.lit(1).alias("one"), *(F.col(n).alias(f"after_{n}") for n in names))
    drop = F.col("before_weighted_rate") - F.col("after_weighted_rate")
    ratio = F.when(F.col("before_weighted_rate") == 0, 0.0).otherwise(drop / F.col("before_weighted_rate"))
    verdict = F.when(F.col("after_high") > 0, "high_left").when((drop <= 0) & (F.col("before_weighted_rate") > 0), "no_drop").when(ratio >= 0.5, "reached").otherwise("limited")
    return a.join(b, "one").select(drop.alias("rate_drop"), ratio.alias("rate_drop_ratio"), (F.col("before_high") - F.col("after_high")).alias("high_drop"), (F.col("before_medium") - F.col("after_medium")).alias("medium_drop"), verdict.alias("verdict"))


def top_risks(segments: DataFrame, best: DataFrame, threshold: float = 0.3, most: int | None = None, excerpt: int = 120) -> DataFrame:
    """Segments that are not low, highest score first, ties by chapter and line; ``most`` of them if given."""
    level = risk_level(F.col("score"), threshold)
    rows = segments.join(best, "segment_id").withColumn("risk_level", level).filter(level != "low")
    rows = rows.select("chapter", "line_start", "line_end", "risk_level", "score", "corpus_id", T.clip(F.col("raw"), excerpt).alias("excerpt")).orderBy(F.desc("score"), "chapter", "line_start")
    return rows.limit(most) if most else rows


def common_spans(a: str, b: str, shingle: int = SHINGLE, least: int = LEAST_RUN, most: int = MOST_SPANS) -> list[tuple[int, int, int]]:
    """``(length, a_start, b_start)`` of the longest common runs, none inside another on both sides.

    Probes are the first places of the distinct shingles of the text that has fewer.
    """
    def places(text: str) -> dict[str, int]:
        if not text:
            return {}
        out: dict[str, int] = {}
        for i in range(max(1, len(text) - shingle + 1)):
            out.setdefault(text[i : i + shingle], i)
        return out

    first_a, first_b = places(a), places(b)
    swap = len(first_b) < len(first_a)
    narrow, wide, probes = (b, a, first_b) if swap else (a, b, first_a)
    found = set()
    for probe, i in probes.items():
        j = wide.find(probe)
        while j >= 0:
            low = 0
            while low < min(i, j) and narrow[i - low - 1] == wide[j - low - 1]:
                low += 1
            high = 0
            while i + high < len(narrow) and j + high < len(wide) and narrow[i + high] == wide[j + high]:
                high += 1
            if low + high >= least:
                found.add((low + high, j - low, i - low) if swap else (low + high, i - low, j - low))
            j = wide.find(probe, j + 1)
    kept: list[tuple[int, int, int]] = []
    for n, i, j in sorted(found, key=lambda s: (-s[0], s[1], s[2])):
        if len(kept) == most:
            break
        if not any(p <= i and q <= j and p + m >= i + n and q + m >= j + n for m, p, q in kept):
            kept.append((n, i, j))
    return kept


def raw_places(raw: str) -> list[int]:
    """The place in the raw text of every character of its normal form."""
    return [i for m in re.finditer(T.NOT_TOKEN, raw) if m[1] for i in range(*m.span(1))]


def match_spans(pairs: DataFrame, shingle: int = SHINGLE, least: int = LEAST_RUN, most: int = MOST_SPANS) -> DataFrame:
    """``(segment_id, corpus_id, length, a_start, b_start, raw_start, raw_end, line)`` of the common runs of each pair.

    ``pairs`` has ``(segment_id, corpus_id, a, b, raw, line_start)``: ``a`` is the normal form of ``raw``. Offsets in the
    normal forms are led back to ``raw``, of which ``line`` is the line the run begins in. Null texts have no runs.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for s, c, a, b, raw, line in pdf[["segment_id", "corpus_id", "a", "b", "raw", "line_start"]].itertuples(index=False):
                if spans := common_spans(a or "", b or "", shingle, least, most):
                    places = raw_places(raw or "")
                    for n, i, j in spans:
                        first, last = (places[i], places[i + n - 1] + 1) if i + n <= len(places) else (-1, -1)
                        rows.append((s, c, n, i, j, first, last, line + (raw or "").count("\n", 0, max(0, first))))
            yield pd.DataFrame(rows, columns=["segment_id", "corpus_id", "length", "a_start", "b_start", "raw_start", "raw_end", "line"])

    kinds = dict(pairs.dtypes)
    source = pairs.select("segment_id", "corpus_id", "a", "b", "raw", "line_start")
    return source.mapInPandas(run, f"segment_id {kinds['segment_id']}, corpus_id {kinds['corpus_id']}, length long, a_start long, b_start long, raw_start long, raw_end long, line long")


def report_baseline(reports: DataFrame, text: str = "text") -> DataFrame:
    """The summary figures of earlier reports in Markdown, for ``rate_delta``; reports without the needed ones are left out."""
    # How the figures are written in a report.
    figure = {"paragraph_count": r"正文段落：(\d+)\s*段", "matched_count": r"有命中段落：(\d+)\s*段", "high": r"高风险\s*(\d+)\s*段", "medium": r"中风险\s*(\d+)\s*段", "weighted_rate": r"全文加权重复率\*\*估算｜\*\*：([0-9.]+)%"}
    got = {name: F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for name, p in figure.items()}
    rows = reports.select("*", *(F.coalesce(v.cast("bigint"), F.lit(0)).alias(n) if n in ("high", "medium") else (v.cast("double") / 100).alias(n) if n == "weighted_rate" else v.cast("bigint").alias(n) for n, v in got.items()))
    return rows.filter("paragraph_count IS NOT NULL AND matched_count IS NOT NULL AND weighted_rate IS NOT NULL")


def detected_rate(rate: Column) -> Column:
    """A rate of a detection service as a share: above 1 it is in percent; kept within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(rate > 1, rate / 100).otherwise(rate)))
