"""Long exact spans shared between records, over a log-structured fingerprint index.

Every window of ``span`` code points picks the smallest hash among its ``gram``-character pieces (its anchor). Equal
windows pick equal anchors, so a window can be shared only if its anchor occurs in two records. Neighbouring windows of
one anchor form a block; a block, not a position, is a row everywhere below.

The log lives in the shared folder: each batch becomes one immutable run of three tables, the anchors (one row each,
sorted and bucketed), the blocks (sorted and bucketed by anchor and a part of the records, so that no anchor floods one
bucket) and the texts, and a manifest names the runs. A new batch is merge-joined with the runs by anchor. Of the blocks
whose anchor is met, those that are equal as a whole in two records are shared at once, by a 128-bit hash of all their
text; only blocks at the edges of shared passages are opened, once per distinct block, and verified window by window by
a 128-bit hash. Hits of each batch are kept, runs are compacted when there are too many. No step builds pairs of
records: all counting is an aggregate of two record ids a key, combined before the shuffle, so a passage carried by a
third of all records is as cheap as any other.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm.batches import by_size
from corpusloom.runtime import brief_shuffles, intermediates, materialize, new_path, read_bytes, remove, salted_join, spread, write_bytes

SPAN, GRAM = 80, 40
CHUNK = 1 << 21  # code points hashed at once; longer texts go through in overlapping pieces
PARTS = 16  # buckets one anchor's blocks are spread over


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def window_hashes(codes: np.ndarray, width: int, seed: int) -> np.ndarray:
    """A 64-bit hash of every window of ``width`` codes, in ``log2(width)`` passes: a tree of fixed shape."""
    level, size = _mix(codes.astype(np.uint64) + np.uint64(seed)), 1
    out, done, rest = None, 0, width
    while True:
        if rest & 1:
            out = level if out is None else _mix(out[: len(level) - done] * np.uint64(0xD6E8FEB86659FD93) + level[done:]) if len(level) > done else level[:0]
            done += size
        if not (rest := rest >> 1):
            return out[: max(0, len(codes) - width + 1)]
        level = _mix(level[:-size] * np.uint64(0xC2B2AE3D27D4EB4F) + level[size:]) if len(level) > size else level[:0]
        size *= 2


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def _codes(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts, and the offsets at which texts begin (one more than texts)."""
    lengths = np.array([len(t) if t else 0 for t in texts], dtype=np.int64)
    raw = "".join(t for t in texts if t).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(raw, dtype=np.uint32), np.concatenate([[0], np.cumsum(lengths)])


def _windows(codes: np.ndarray, ends: np.ndarray, span: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Per chunk: text index, start, anchor and the two halves of a 128-bit hash of every whole window."""
    for at in range(0, max(0, len(codes) - span + 1), CHUNK):
        piece = codes[at : at + CHUNK + span - 1]
        starts = np.arange(at, at + len(piece) - span + 1)
        owner = np.searchsorted(ends, starts, side="right") - 1
        whole = starts + span <= ends[owner + 1]
        if whole.any():
            anchors = _sliding_min(window_hashes(piece, gram, 11), span - gram + 1)
            low, high = (window_hashes(piece, span, seed)[whole] for seed in (23, 47))
            yield owner[whole], (starts - ends[owner])[whole], anchors[whole], low, high


BLOCK = "anchor bigint, low bigint, high bigint, n int, rec_id bigint, start bigint"


def block_rows(span: int, gram: int):
    """A row per block: windows next to each other with one anchor, at most ``span`` of them.

    The first and the last window cover such a block, so their hashes and its length are a hash of all its text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches):
            ids = batch.column("rec_id").to_numpy(zero_copy_only=False)
            codes, ends = _codes(batch.column("text").to_pylist())
            for owner, start, anchors, low, high in _windows(codes, ends, span, gram):
                fresh = np.ones(len(owner), dtype=bool)
                fresh[1:] = (owner[1:] != owner[:-1]) | (anchors[1:] != anchors[:-1])
                first = np.flatnonzero(fresh)
                # blocks of one anchor that goes on and on (a text that repeats itself) are cut
                sizes = np.diff(np.append(first, len(owner)))
                cuts = (sizes + span - 1) // span
                first = np.repeat(first, cuts) + span * (np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts))
                last = np.append(first[1:], len(owner)) - 1
                n = last - first + 1
                halves = [_mix(_mix(h[first] + n.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93) + h[last]).view(np.int64) for h in (low, high)]
                columns = [anchors[first].view(np.int64), *halves, n.astype(np.int32), ids[owner[first]].astype(np.int64), start[first].astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in BLOCK.split(", ")])

    return run


def window_rows(span: int):
    """A row per window of the wanted blocks ``blocks ARRAY<STRUCT<low, high, n, start, first, last>>`` of each text."""
    names = ["low", "high", "place", "window_low", "window_high", "first", "last"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches):
            texts, wanted = batch.column("text"), batch.column("blocks").flatten()
            owner = np.repeat(np.arange(batch.num_rows), batch.column("blocks").value_lengths().to_numpy(zero_copy_only=False))
            codes, ends = _codes(texts.to_pylist())
            get = lambda name: wanted.field(name).to_numpy(zero_copy_only=False).astype(np.int64)
            n = get("n")
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(ends[owner] + get("start"), n) + place
            rest = [np.repeat(get(c), n) for c in ("low", "high", "first", "last")]
            for begin in range(0, len(codes), CHUNK):
                piece = codes[begin : begin + CHUNK + span - 1]
                here = np.flatnonzero((at >= begin) & (at < begin + CHUNK))
                if len(here):
                    low, high = (window_hashes(piece, span, seed)[at[here] - begin].view(np.int64) for seed in (23, 47))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (rest[0][here], rest[1][here], place[here], low, high, rest[2][here], rest[3][here])], names=names)

    return run


class FingerprintLog:
    """A persistent index of shared spans: ``append`` takes a batch, ``spans`` gives what is shared so far.

    ``append`` reads the batch and the runs, never earlier sources. Opened again at the same ``path``, also by another
    session, the log goes on where it was; without a path it lives as long as other intermediates. A run counts once the
    manifest names it, so an append that fails leaves the log as it was; one writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, span: int = SPAN, gram: int = GRAM, fan_in: int = 4, buckets: int | None = None):
        self.spark, self.path, self.fan_in = spark, path or new_path(spark, "log"), fan_in
        stored = read_bytes(spark, f"{self.path}/manifest.json") or read_bytes(spark, f"{self.path}/manifest.new")
        state = json.loads(stored) if stored else {"span": span, "gram": gram, "buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), "runs": [], "hits": []}
        self.span, self.gram, self.buckets, self.runs, self.hits = (state[k] for k in ("span", "gram", "buckets", "runs", "hits"))

    def _save(self) -> None:
        body = json.dumps({"span": self.span, "gram": self.gram, "buckets": self.buckets, "runs": self.runs, "hits": self.hits}).encode()
        # the new one is whole before the old one goes; a reader that finds no manifest takes the new one
        write_bytes(self.spark, f"{self.path}/manifest.new", body)
        write_bytes(self.spark, f"{self.path}/manifest.json", body)

    def _bucketed(self, run: str, part: str) -> DataFrame:
        """A bucketed table of a run, registered in this session if it is not yet."""
        name, keys = f"log_{run}_{part}", "anchor" if part == "anchors" else "anchor, part"
        columns = "anchor bigint, low_id bigint, high_id bigint" if part == "anchors" else f"{BLOCK}, part int"
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{run}/{part}'")
        return self.spark.table(name)

    def _write(self, rows: DataFrame, run: str, part: str) -> None:
        keys = ["anchor"] if part == "anchors" else ["anchor", "part"]
        name = f"log_{run}_{part}"
        with brief_shuffles(self.spark):
            rows.repartition(self.buckets, *keys).write.bucketBy(self.buckets, *keys).sortBy(*keys).option("path", f"{self.path}/{run}/{part}").saveAsTable(name)

    def _texts(self, runs: list[str]) -> DataFrame:
        return self.spark.read.schema("rec_id bigint, text string").parquet(*(f"{self.path}/{r}/texts" for r in runs))

    def append(self, records: DataFrame) -> DataFrame:
        """Index ``(rec_id, text)``; returns the hits ``(rec_id, span_start, span_end)`` that this batch brings to any record.

        Null texts and those shorter than the span have none; repeated rows of one id count as one record; an empty batch
        adds nothing. The result is stored in the log and can be read until the log is compacted, which happens at the
        beginning of an append when there are ``fan_in`` runs.
        """
        if len(self.runs) >= self.fan_in:
            self.compact()
        run = uuid.uuid4().hex
        texts = records.select(F.col("rec_id").cast("bigint").alias("rec_id"), F.col("text").cast("string").alias("text")).filter(F.char_length("text") >= self.span)
        with brief_shuffles(self.spark):
            spread(texts).write.parquet(f"{self.path}/{run}/texts")
        blocks = spread(self._texts([run])).mapInArrow(block_rows(self.span, self.gram), BLOCK)
        self._write(blocks.withColumn("part", F.pmod(F.xxhash64("rec_id"), F.lit(PARTS)).cast("int")), run, "blocks")
        self._write(self._bucketed(run, "blocks").groupBy("anchor").agg(F.min("rec_id").alias("low_id"), F.max("rec_id").alias("high_id")), run, "anchors")
        with intermediates(), brief_shuffles(self.spark):
            found = self._found(run)
            found.write.parquet(f"{self.path}/{run}/hits")
        self.runs, self.hits = [*self.runs, run], [*self.hits, run]
        self._save()
        return self.spark.read.schema("rec_id bigint, span_start bigint, span_end bigint").parquet(f"{self.path}/{run}/hits")

    def _found(self, run: str) -> DataFrame:
        runs = [*self.runs, run]
        met = self._bucketed(run, "anchors")
        for old in self.runs:  # merge joins of tables that are bucketed alike
            before = self._bucketed(old, "anchors").select("anchor", F.col("low_id").alias("old_low"), F.col("high_id").alias("old_high"))
            met = met.join(before, "anchor", "left").select("anchor", F.least("low_id", "old_low").alias("low_id"), F.greatest("high_id", "old_high").alias("high_id"))
        met = materialize(met.filter("low_id <> high_id").select("anchor"), "met")
        keys = met.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        # sixteen times as many as the planner thinks: it would broadcast them, through the driver
        held = [self._bucketed(r, "blocks").join(keys.hint("merge"), ["anchor", "part"]).select("anchor", F.struct("low", "high").alias("block"), "n", "rec_id", "start") for r in runs]
        every = held[0]
        for more in held[1:]:
            every = every.union(more)
        every = materialize(every, "blocks")
        distinct = every.groupBy("anchor", "block", "n").agg(F.min("rec_id").alias("first"), F.max("rec_id").alias("last"), F.min(F.struct("rec_id", "start")).alias("at"))
        distinct = materialize(distinct, "distinct")
        # blocks to open: those of an anchor that has several, of which one is not shared as a whole
        open_ = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("blocks"), F.bool_or(F.col("first") == F.col("last")).alias("alone")).filter("blocks > 1 AND alone").select("anchor")
        opened = salted_join(distinct, open_, "anchor")
        wanted = opened.groupBy(F.col("at.rec_id").alias("rec_id")).agg(F.collect_list(F.struct("block.low", "block.high", F.col("n").cast("bigint").alias("n"), "at.start", "first", "last")).alias("blocks"))
        sources = self._texts(runs).join(wanted, "rec_id").groupBy("rec_id").agg(F.first("text").alias("text"), F.first("blocks").alias("blocks"))  # no more blocks than the text has
        windows = sources.mapInArrow(window_rows(self.span), "low bigint, high bigint, place bigint, window_low bigint, window_high bigint, first bigint, last bigint")
        windows = materialize(windows.select(F.struct("low", "high").alias("block"), "place", F.struct("window_low", "window_high").alias("window"), "first", "last"), "windows")
        twice = windows.groupBy("window").agg(F.min("first").alias("low_id"), F.max("last").alias("high_id")).filter("low_id <> high_id").select("window")
        places = salted_join(windows, twice, "window", "left_semi").groupBy("block").agg(F.sort_array(F.collect_set("place")).alias("places"))  # at most ``span`` of them
        starts = F.filter("places", lambda p: ~F.array_contains("places", p - 1))
        stops = F.filter("places", lambda p: ~F.array_contains("places", p + 1))
        ranges = lambda low, high: F.struct(low.cast("bigint").alias("low"), high.cast("bigint").alias("high"))
        partly = places.select("block", F.explode(F.zip_with(starts, stops, ranges)).alias("range"))
        whole = distinct.filter("first <> last").select("block", ranges(F.lit(0), F.col("n") - 1).alias("range"))
        hits = salted_join(every.select("block", "rec_id", "start"), whole.union(partly), "block")
        return hits.select("rec_id", (F.col("start") + F.col("range.low")).alias("span_start"), (F.col("start") + F.col("range.high") + self.span).alias("span_end"))

    def compact(self) -> None:
        """Merge all runs into one sorted run and all hits into one table of merged spans; the old ones are removed."""
        run, old, old_hits = uuid.uuid4().hex, self.runs, self.hits
        self._texts(old).write.parquet(f"{self.path}/{run}/texts")
        every = lambda part: [self._bucketed(r, part) for r in old]
        blocks, anchors = every("blocks"), every("anchors")
        for more in blocks[1:]:
            blocks[0] = blocks[0].unionByName(more)
        for more in anchors[1:]:
            anchors[0] = anchors[0].unionByName(more)
        self._write(blocks[0], run, "blocks")
        self._write(anchors[0].groupBy("anchor").agg(F.min("low_id").alias("low_id"), F.max("high_id").alias("high_id")), run, "anchors")
        with brief_shuffles(self.spark):
            self.spans().write.parquet(f"{self.path}/{run}/hits")
        self.runs, self.hits = [run], [run]
        self._save()
        for gone in {*old, *old_hits}:
            for part in ("blocks", "anchors"):
                self.spark.sql(f"DROP TABLE IF EXISTS log_{gone}_{part}")
            remove(self.spark, f"{self.path}/{gone}")

    def spans(self) -> DataFrame:
        """``(rec_id, span_start, span_end)``: maximal runs of shared characters of every record so far."""
        schema = "rec_id bigint, span_start bigint, span_end bigint"
        if not self.hits:
            return self.spark.createDataFrame([], schema)
        hits = self.spark.read.schema(schema).parquet(*(f"{self.path}/{h}/hits" for h in self.hits)).groupBy("rec_id", "span_start").agg(F.max("span_end").alias("span_end"))
        # the hits of one record, which are fewer than its characters
        before = W.partitionBy("rec_id").orderBy("span_start").rowsBetween(W.unboundedPreceding, -1)
        edges = hits.withColumn("fresh", F.coalesce(F.col("span_start") > F.max("span_end").over(before), F.lit(True)).cast("int"))
        islands = edges.withColumn("island", F.sum("fresh").over(W.partitionBy("rec_id").orderBy("span_start").rowsBetween(W.unboundedPreceding, 0)))
        spans = islands.groupBy("rec_id", "island").agg(F.min("span_start").alias("span_start"), F.max("span_end").alias("span_end"))
        return spans.select("rec_id", "span_start", "span_end")


def shared_spans(batches: list[DataFrame], span: int = SPAN, gram: int = GRAM, path: str | None = None) -> DataFrame:
    """``(rec_id, span_start, span_end)``: maximal runs of characters that lie in a shared window of ``span``.

    ``batches`` are DataFrames of ``(rec_id, text)`` in order of arrival, appended to the log at ``path``, if there is
    one, else to a new one. Offsets are code points from 0, the end is exclusive. A window that repeats only inside its
    own record is not shared. Null and short texts have no spans; repeated rows of one id count as one record; an empty
    batch adds nothing.
    """
    log = FingerprintLog(batches[0].sparkSession, path, span, gram)
    for batch in batches:
        log.append(batch)
    return log.spans()


def shared_amount(spans: DataFrame, records: DataFrame) -> DataFrame:
    """``(rec_id, n_spans, shared_chars, n_chars, shared_share)`` for every record, 0 where nothing is shared.

    Null text counts as 0 characters with share 0.
    """
    total = spans.groupBy("rec_id").agg(F.count(F.lit(1)).alias("n_spans"), F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    sized = records.select("rec_id", F.coalesce(F.char_length("text"), F.lit(0)).cast("bigint").alias("n_chars"))
    filled = sized.join(total, "rec_id", "left").na.fill(0, ["n_spans", "shared_chars"])
    return filled.withColumn("shared_share", F.coalesce(F.try_divide(F.col("shared_chars").cast("double"), F.col("n_chars")), F.lit(0.0)))


def record_batches(texts: DataFrame, excerpts: DataFrame) -> list[DataFrame]:
    """Thesis texts first, then the scan excerpts, which arrive after them."""
    return [texts.select(F.col("fp_id").alias("rec_id"), "text"), excerpts.select(F.col("risk_id").alias("rec_id"), F.col("excerpt").alias("text"))]
