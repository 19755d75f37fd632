"""Evaluation texts leaking into training text, by one FM-index per shard of documents.

Letters, digits and ideographs are kept, case and width folded. A shard's letters are cut into aligned blocks of
``BLOCK`` letters; a block that occurs in no test phrase becomes the terminator, every other block a symbol. The index
over the symbols is the usual one: suffix array by prefix doubling, Burrows-Wheeler transform in a wavelet matrix with
rank counts, suffix positions sampled. Every test phrase of two blocks (Chinese) or four (English) is searched
backwards at every offset of its item, so any copied stretch of 15 or 25 letters contains a hit, whatever its offset
in the document. Hits on one diagonal are merged, grown letter by letter at both ends, and united over the item.
Documents are never shuffled: a shard is what one task reads, and its memory is bounded by ``SHARD`` letters.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.batches import by_size
from corpusloom.runtime import spread

BLOCK = 5
SHARD = 1 << 22  # letters indexed at once; a longer document is a shard of its own
ITEM_LETTERS = 1 << 23  # letters of test items broadcast at once; more items go through in further passes
HAN = re.compile(r"[㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff]")
SAMPLE = 8


class LetterTable:
    """Code point to folded letters, filled at first use: -1 drops, -2 and less point at several letters."""

    def __init__(self) -> None:
        self.of = np.full(0x110000, -(1 << 30), dtype=np.int32)
        self.several: list[list[int]] = []

    def _fill(self, code: int) -> None:
        folded = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", chr(code)).casefold()) if not 0xD800 <= code < 0xE000 else ""
        kept = [ord(c) for c in folded if c.isalnum()]
        if len(kept) > 1:
            self.several.append(kept)
        self.of[code] = -1 if not kept else kept[0] if len(kept) == 1 else -1 - len(self.several)

    def letters(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Folded letters of a text and the code point offset of each."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        mapped = self.of[codes]
        if len(codes) and mapped.min() == -(1 << 30):
            for code in np.unique(codes[mapped == -(1 << 30)]):
                self._fill(int(code))
            mapped = self.of[codes]
        at = np.flatnonzero(mapped != -1)
        out = mapped[at]
        if len(out) and out.min() < -1:
            wide = [self.several[-2 - int(v)] if v < -1 else [int(v)] for v in out]
            at = np.repeat(at, [len(x) for x in wide])
            out = np.array([c for x in wide for c in x], dtype=np.int32)
        return out, at


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def block_hashes(letters: np.ndarray, starts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(starts), dtype=np.uint64)
    for j in range(BLOCK):
        out = _mix(out * np.uint64(0xC2B2AE3D27D4EB4F) + letters[starts + j].astype(np.uint64) + np.uint64(1))
    return out


class WaveletMatrix:
    """Rank and access over a sequence of integers: one packed bit vector a level, with a count before each word."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.words, self.before, self.zeros = [], [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (seq >> level) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            words = np.zeros(len(seq) // 64 + 1, dtype=np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            self.words.append(words)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]]))
            one = bit.astype(bool)
            self.zeros.append(len(seq) - int(one.sum()))
            seq = np.concatenate([seq[~one], seq[one]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[level][word] + np.bitwise_count(self.words[level][word] & mask)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs before position ``at``."""
        start, at = np.zeros_like(at), at
        for k in range(self.bits):
            one = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            ones_at, ones_start = self._ones(k, at), self._ones(k, start)
            at = np.where(one, self.zeros[k] + ones_at, at - ones_at)
            start = np.where(one, self.zeros[k] + ones_start, start - ones_start)
        return at - start

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(at)
        for k in range(self.bits):
            one = (self.words[k][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
            ones = self._ones(k, at)
            symbol = symbol * 2 + one.astype(at.dtype)
            at = np.where(one == 1, self.zeros[k] + ones, at - ones)
        return symbol


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling; each 0 ends its suffix, and suffixes at a 0 keep their text order."""
    n = len(seq)
    ends = seq == 0
    n_ends = int(ends.sum())
    rank = seq.astype(np.int64) + n_ends
    rank[ends] = np.arange(n_ends)
    order = np.argsort(rank, kind="stable")

    def renumber(order: np.ndarray, keys: np.ndarray, base: np.ndarray) -> None:
        """Equal keys get the place of the first of them; only the given places change."""
        first = np.ones(len(order), dtype=bool)
        first[1:] = keys[1:] != keys[:-1]
        rank[order] = base[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]

    renumber(order, rank[order], np.arange(n))
    step = 1
    while True:
        placed = rank[order]
        tied = np.zeros(n, dtype=bool)
        same = placed[1:] == placed[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        places = np.flatnonzero(tied)
        if not len(places):
            return order
        at = order[places]
        after = at + step
        keys = rank[at] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(keys, kind="stable")
        order[places] = at[by]
        renumber(at[by], keys[by], places)
        step *= 2


class FMIndex:
    """Backward search over a sequence in which 0 is the terminator, and location by sampled suffix positions."""

    def __init__(self, seq: np.ndarray, sigma: int):
        order = suffix_array(seq)
        bwt = seq[order - 1]  # row of suffix 0 wraps to the last symbol, which is a terminator
        counts = np.bincount(seq, minlength=sigma)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.tree = WaveletMatrix(bwt, sigma)
        marked = (order % SAMPLE == 0) | (bwt == 0)
        self.sampled = WaveletMatrix(marked.astype(np.int64), 2)
        self.positions = order[marked]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of ``patterns`` (one a row) that occur, with their first and past-last place in the index."""
        index = np.arange(len(patterns))
        symbol = patterns[:, -1]
        low, high = self.first[symbol], self.first[symbol + 1]
        for k in range(patterns.shape[1] - 2, -1, -1):
            alive = low < high
            index, low, high = index[alive], low[alive], high[alive]
            symbol = patterns[index, k]
            low = self.first[symbol] + self.tree.rank(symbol, low)
            high = self.first[symbol] + self.tree.rank(symbol, high)
        alive = low < high
        return index[alive], low[alive], high[alive]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row: steps back until a sampled one."""
        out = np.zeros(len(rows), dtype=np.int64)
        todo, at, steps = np.arange(len(rows)), rows, 0
        while len(todo):
            marked = self.sampled.access(at) == 1
            spot = self.sampled.rank(np.ones(int(marked.sum()), dtype=np.int64), at[marked])
            out[todo[marked]] = self.positions[spot] + steps
            todo, at = todo[~marked], at[~marked]
            symbol = self.tree.access(at)
            at = self.first[symbol] + self.tree.rank(symbol, at)
            steps += 1
        return out


class Phrases:
    """Test phrases of a bounded set of items: letters, blocks at every offset, distinct phrases by number of blocks."""

    def __init__(self, items: list[tuple[int, str]], least_han: int, least_latin: int):
        table = LetterTable()
        self.ids, letters = [], []
        for item_id, text in items:
            if text and len(x := table.letters(text)[0]):
                self.ids.append(item_id)
                letters.append(x)
        self.size = np.array([len(x) for x in letters], dtype=np.int64)
        self.base = np.concatenate([[0], np.cumsum(self.size)])
        self.letters = np.concatenate([*letters, np.zeros(BLOCK, dtype=np.int32)]) if letters else np.zeros(BLOCK, dtype=np.int32)
        han = np.array([len(HAN.findall("".join(map(chr, x)))) * 2 >= len(x) for x in letters], dtype=bool)
        self.least = np.where(han, least_han, least_latin)
        self.item_of = np.repeat(np.arange(len(letters)), self.size)
        hashes = block_hashes(self.letters, np.arange(len(self.letters) - BLOCK))
        self.known = np.unique(hashes)
        symbol = np.searchsorted(self.known, hashes) + 1
        self.maybe = np.zeros(1 << 22, dtype=bool)
        self.maybe[(self.known & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        self.searches = []
        for least in sorted({least_han, least_latin}):
            m = max(1, (least - BLOCK + 1) // BLOCK)
            offset = np.arange(len(self.item_of))
            ok = (self.least[self.item_of] == least) & (offset - self.base[self.item_of] + m * BLOCK <= self.size[self.item_of])
            if (starts := offset[ok]).size:
                pattern = np.stack([symbol[starts + BLOCK * j] for j in range(m)], axis=1)
                distinct, which = np.unique(pattern, axis=0, return_inverse=True)
                by = np.argsort(which, kind="stable")
                self.searches.append((m, distinct, starts[by], np.searchsorted(which[by], np.arange(len(distinct) + 1))))

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), dtype=np.int64)
        at = np.flatnonzero(self.maybe[(hashes & np.uint64((1 << 22) - 1)).astype(np.int64)])
        place = np.searchsorted(self.known, hashes[at])
        good = self.known[np.minimum(place, len(self.known) - 1)] == hashes[at]
        out[at[good]] = place[good] + 1
        return out


def _expand(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every integer of the ranges, and the range each comes from."""
    n = high - low
    owner = np.repeat(np.arange(len(low)), n)
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + low[owner], owner


def search_shard(phrases: Phrases, docs: list[tuple[int, np.ndarray, np.ndarray]], piece_hits: int = 1 << 20) -> Iterator[tuple]:
    """``(doc number, item number, item start, item end, document start)`` of each maximal copied stretch, in letters."""
    size = np.array([len(x) for _, x, _ in docs], dtype=np.int64)
    base = np.concatenate([[0], np.cumsum(size)])
    letters = np.concatenate([x for _, x, _ in docs])
    n_blocks = size // BLOCK
    block_base = np.concatenate([[0], np.cumsum(n_blocks + 1)])  # one terminator after each document
    seq = np.zeros(int(block_base[-1]), dtype=np.int64)
    inside, owner = _expand(block_base[:-1], block_base[:-1] + n_blocks)
    starts = (inside - block_base[owner]) * BLOCK + base[owner]
    seq[inside] = phrases.symbols(block_hashes(letters, starts))
    if not seq.any():
        return
    index = FMIndex(seq, len(phrases.known) + 1)
    for m, patterns, offsets, bounds in phrases.searches:
        hit, low, high = index.search(patterns)
        if not len(hit):
            continue
        rows, of = _expand(low, high)
        block = index.locate(rows)
        doc = np.searchsorted(block_base, block, side="right") - 1
        at = (block - block_base[doc]) * BLOCK
        uses, source = _expand(bounds[hit][of], bounds[hit + 1][of])  # a phrase can stand in several items
        doc, at, offset = doc[source], at[source], offsets[uses]
        item = phrases.item_of[offset]
        start = offset - phrases.base[item]
        by = np.lexsort((at, at - start, item, doc))
        doc, item, at, start = doc[by], item[by], at[by], start[by]
        new = np.ones(len(doc), dtype=bool)
        new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (at[1:] != at[:-1] + BLOCK) | (start[1:] != start[:-1] + BLOCK)
        first = np.flatnonzero(new)
        last = np.append(first[1:] - 1, len(doc) - 1)
        doc, item, a, s, e = doc[first], item[first], at[first], start[first], start[last] + m * BLOCK
        for side in (-1, 1):
            growing = np.ones(len(doc), dtype=bool)
            for _ in range(BLOCK):
                there = (s - 1 if side < 0 else e)
                here = (a - 1 if side < 0 else a + e - s)
                growing &= (there >= 0) & (there < phrases.size[item]) & (here >= 0) & (here < size[doc])
                g = np.flatnonzero(growing)
                same = phrases.letters[phrases.base[item[g]] + there[g]] == letters[base[doc[g]] + here[g]]
                growing[g[~same]] = False
                g = g[same]
                if side < 0:
                    s[g] -= 1
                    a[g] -= 1
                else:
                    e[g] += 1
        long = e - s >= phrases.least[item]
        yield from zip(*(x[long].tolist() for x in (doc, item, s, e, a)), strict=True)


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [tuple(x) for x in out]


RESULT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("item_letters", pa.int64()), ("leaked_letters", pa.int64()), ("spans", pa.list_(pa.struct([("span_start", pa.int64()), ("span_end", pa.int64())])))])


def _leaks(sent, least_han: int, least_latin: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, table = Phrases(sent.value, least_han, least_latin), LetterTable()

        def shard(docs: list) -> Iterator[pa.RecordBatch]:
            both: dict[tuple[int, int], list] = {}
            for doc, item, s, e, a in search_shard(phrases, docs):
                both.setdefault((doc, item), []).append((s, e, a))
            rows = []
            for (doc, item), runs in both.items():
                doc_id, _, place = docs[doc]
                leaked = sum(high - low for low, high in _merge([(s, e) for s, e, _ in runs]))
                spans = _merge([(int(place[a]), int(place[a + e - s - 1]) + 1) for s, e, a in runs])
                rows.append({"doc_id": doc_id, "item_id": phrases.ids[item], "item_letters": int(phrases.size[item]), "leaked_letters": leaked, "spans": [{"span_start": x, "span_end": y} for x, y in spans]})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=RESULT)

        docs, held = [], 0
        for batch in by_size(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not phrases.ids or not text:
                    continue
                letters, place = table.letters(text)
                if docs and held + len(letters) > SHARD:
                    yield from shard(docs)
                    docs, held = [], 0
                docs.append((doc_id, letters, place.astype(np.int32)))
                held += len(letters)
        if docs:
            yield from shard(docs)

    return run


def leaked_items(docs: DataFrame, items: DataFrame, least_han: int = 15, least_latin: int = 25) -> DataFrame:
    """``(doc_id, item_id, item_letters, leaked_letters, leaked_share, spans)`` of every document and item that share a
    stretch of ``least_han`` letters (items mostly of ideographs) or ``least_latin``.

    ``docs`` has ``(doc_id, text)``, ``items`` has ``(item_id, text)``. ``spans`` are the merged stretches of the
    document to remove, in code points. Null and empty texts leak nothing; a repeated document row gives a row each;
    an empty side gives no rows. Items are broadcast in groups of at most about ``ITEM_LETTERS`` letters, and each group
    is searched in all documents.
    """
    spark = docs.sparkSession
    source = spread(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")))
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    total = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    groups = max(1, math.ceil(total / ITEM_LETTERS))
    parts = []
    for k in range(groups):
        group = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == k).collect()
        sent = spark.sparkContext.broadcast([(r.item_id, r.text) for r in group])
        parts.append(source.mapInArrow(_leaks(sent, least_han, least_latin), "doc_id bigint, item_id bigint, item_letters bigint, leaked_letters bigint, spans array<struct<span_start:bigint,span_end:bigint>>"))
    every = reduce(DataFrame.union, parts)
    return every.withColumn("leaked_share", F.col("leaked_letters") / F.col("item_letters"))


def leaking_documents(leaks: DataFrame, share: float = 0.4) -> DataFrame:
    """``(doc_id, item_id)`` where the document holds at least ``share`` of the item's letters."""
    return leaks.filter(F.col("leaked_letters") >= share * F.col("item_letters")).select("doc_id", "item_id").distinct()
