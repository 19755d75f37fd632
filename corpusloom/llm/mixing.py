"""Mixing sources to target weights.

A classifier, trained without the typed source among its features, gives every document a posterior over sources: naive
Bayes over its folder, extension, language and shape, and over the tokens of its text, whose weight against the others is
fitted on held-out labelled documents so that posteriors are calibrated. Where a source is typed it is a noisy
observation of the membership: its error rate is the one that explains the held-out labels best. Nonnegative rates per
document are then fitted by projected gradient descent on the squared, scaled differences between expected and wanted
tokens per source: each step is one aggregate over the table. Documents of equal posterior and limit have equal rates, so
the table is first reduced to such classes by an aggregate; no document, rate or class list ever comes to the driver,
only one total per source. Rates become whole numbers of copies by systematic sampling within small groups.
"""

from __future__ import annotations

import base64
import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm.batches import by_size
from corpusloom.runtime import discard, materialize, spread

TOKENIZER = "byte_bpe_multi_50k.tiktoken"
STEPS, TOLERANCE = 60, 1e-4
MOST_LABELLED = 50_000  # labelled documents the classifier is fitted to at most, every fifth of them held out
MOST_CELLS = 20_000_000  # sources times tokens of the vocabulary: about 160 MB a task
GROUP = 2000  # documents per rounding group, about


def default_tokenizer() -> str:
    """Path of a public vocabulary that is installed beside the libraries."""
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    # the pattern of byte-level BPE vocabularies: contractions, letters, numbers, other marks, blanks
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("mixing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def source_key(source: Column) -> Column:
    """A source name in lower case without outer blanks; null where nothing is left."""
    key = F.lower(F.regexp_replace(source, r"^[\s ]+|[\s ]+$", ""))
    return F.when(key != "", key)


N_FEATURES = 4


def features(docs: DataFrame) -> DataFrame:
    """``doc_id, typed, f0..f3, text``: the typed source, and folder, extension, language and shape as strings."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    parts = [
        F.lower(F.regexp_extract("file_path", r"^([^/]+)/", 1)),
        F.lower(F.regexp_extract("file_path", r"\.(\w{1,8})$", 1)),
        F.lower("lang"),
        F.concat(F.floor(F.log2(F.char_length(text) + 1)).cast("string"), F.when(text.rlike(r"(?m)^#{1,6} "), "h").otherwise(""), F.when(text.rlike(r"(?m)^\|"), "t").otherwise("")),
    ]
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), source_key(F.col("source")).alias("typed"), *(F.coalesce(F.nullif(p, F.lit("")), F.lit("?")).alias(f"f{n}") for n, p in enumerate(parts)), F.col("text").cast("string").alias("text"))


class SourceModel:
    """Log-likelihoods of features and tokens per source, the weight of the text, and the error rate of typed sources."""

    def __init__(self, known: list[str], counts: dict[tuple[str, str, int], float], tokens: np.ndarray, prior: np.ndarray, smoothing: float = 0.5):
        self.known = known
        self.prior = np.log((prior + 1.0) / (prior.sum() + len(known)))
        self.fields: list[dict[str, np.ndarray]] = [{} for _ in range(N_FEATURES)]
        for (field, value, k), n in counts.items():
            table = self.fields[int(field[1:])]
            table.setdefault(value, np.zeros(len(known)))[k] += n
        for table in self.fields:
            for value in table:
                table[value] = np.log((table[value] + smoothing) / (prior + smoothing * (len(table) + 1)))
        self.tokens = np.log((tokens + smoothing) / (tokens.sum(axis=1, keepdims=True) + smoothing * tokens.shape[1])).astype(np.float32)
        self.heat, self.error = math.inf, 0.0

    def scores(self, fields: list[list[str]], encoded: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Per document: log-odds by the features, and those by the tokens of its text."""
        none = np.zeros(len(self.known))
        by_field = np.array([sum((t.get(v, none) for t, v in zip(self.fields, values, strict=True)), self.prior) for values in zip(*fields, strict=True)]).reshape(-1, len(self.known))
        sizes = np.array([len(t) for t in encoded], dtype=np.int64)
        flat = np.fromiter(chain.from_iterable(encoded), dtype=np.int64, count=int(sizes.sum()))
        owner = np.repeat(np.arange(len(encoded)), sizes)
        by_text = np.stack([np.bincount(owner, weights=row[flat], minlength=len(encoded)) for row in self.tokens], axis=1)
        return by_field, by_text

    def posteriors(self, by_field: np.ndarray, by_text: np.ndarray, heat: float | None = None) -> np.ndarray:
        score = by_field + (by_text - by_text.max(axis=1, keepdims=True)) / (heat or self.heat)
        score = np.exp(score - score.max(axis=1, keepdims=True))
        return score / score.sum(axis=1, keepdims=True)

    def calibrate(self, by_field: np.ndarray, by_text: np.ndarray, label: np.ndarray) -> None:
        """Heat and error rate under which the held-out labels are likeliest."""
        if not len(label):
            return
        k = max(2, len(self.known))
        best = -math.inf
        for heat in (math.inf, 1000.0, 300.0, 100.0, 30.0, 10.0, 3.0, 1.0):
            p = self.posteriors(by_field, by_text, heat)[np.arange(len(label)), label]
            for error in (0.001, 0.003, 0.01, 0.03, 0.1, 0.3):
                likelihood = np.log(p * (1 - error) + (1 - p) * error / (k - 1)).mean()
                if likelihood > best:
                    best, self.heat, self.error = likelihood, heat, error

    def observed(self, p: np.ndarray, typed: list[str | None]) -> np.ndarray:
        """Posteriors once the typed sources, where there are any, have been seen."""
        place = {s: k for k, s in enumerate(self.known)}
        at = np.array([place.get(t, -1) for t in typed], dtype=np.int64)
        seen = np.flatnonzero(at >= 0)
        q = p.copy()
        q[seen] *= self.error / max(1, len(self.known) - 1)
        q[seen, at[seen]] = p[seen, at[seen]] * (1 - self.error)
        # a class the features rule out is still possible where it is typed
        q += 1e-12
        q[seen, at[seen]] += 1e-9
        return q / q.sum(axis=1, keepdims=True)


def _encode(texts: list, path: str) -> list[list[int]]:
    return _encoding(path).encode_ordinary_batch([t or "" for t in texts], num_threads=1)


def fit_sources(rows: DataFrame, known: list[str], tokenizer: str, most_labelled: int = MOST_LABELLED) -> SourceModel:
    """Fit the classifier to about ``most_labelled`` documents with a typed source at most, picked by a hash of the id.

    Four fifths give the counts, the others calibrate it. The model's size is bounded by sources times vocabulary.
    """
    size = _encoding(tokenizer).n_vocab
    if len(known) * size > MOST_CELLS:
        raise ValueError("too many sources for one classifier")
    place = {s: k for k, s in enumerate(known)}
    labelled = rows.filter(F.col("typed").isin(known))
    # a share of the ids by their hash: no sorting, and the sample stays spread over its partitions
    share = min(1.0, most_labelled / max(1, labelled.count()))
    bucket = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "doc_id"), F.lit(n))
    sample = labelled.filter(bucket("pick", 1_000_000) < int(share * 1_000_000))
    sample = materialize(spread(sample).withColumn("held", bucket("held", 5) == 0), "labelled")

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        table = np.zeros((len(known), size), dtype=np.int64)
        for batch in by_size(batches):
            labels = [place[t] for t in batch.column("typed").to_pylist()]
            for k, tokens in zip(labels, _encode(batch.column("text").to_pylist(), tokenizer), strict=True):
                if tokens:
                    n = np.bincount(np.asarray(tokens, dtype=np.int64))
                    table[k, : len(n)] += n
                total["n", "", k] += 1
            for f in range(N_FEATURES):
                total.update((f"f{f}", v, k) for v, k in zip(batch.column(f"f{f}").to_pylist(), labels, strict=True))
        total.update({("t", str(token), int(k)): int(table[k, token]) for k, token in zip(*np.nonzero(table), strict=True)})
        field, value, k = zip(*total, strict=True) if total else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(field, pa.string()), pa.array(value, pa.string()), pa.array(k, pa.int32()), pa.array(list(total.values()), pa.int64())], names=["field", "value", "k", "n"])

    got = sample.filter("NOT held").mapInArrow(counts, "field string, value string, k int, n bigint").groupBy("field", "value", "k").agg(F.sum("n").alias("n")).toPandas()
    tokens, prior, fields = np.zeros((len(known), size), dtype=np.float32), np.zeros(len(known)), {}
    for field, value, k, n in got.itertuples(index=False):
        if field == "t":
            tokens[k, int(value)] = n
        elif field == "n":
            prior[k] = n
        else:
            fields[field, value, k] = n
    model = SourceModel(known, fields, tokens, prior)
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches):
            a, b = sent.value.scores([batch.column(f"f{f}").to_pylist() for f in range(N_FEATURES)], _encode(batch.column("text").to_pylist(), tokenizer))
            yield pa.RecordBatch.from_arrays([batch.column("typed"), pa.array(a.tolist(), pa.list_(pa.float64())), pa.array(b.tolist(), pa.list_(pa.float64()))], names=["typed", "a", "b"])

    # a fifth of the sample at most
    held = sample.filter("held").mapInArrow(scores, "typed string, a array<double>, b array<double>").toPandas()
    label = np.array([place[t] for t in held.typed], dtype=np.int64)
    a, b = (np.array(held[c].tolist(), dtype=np.float64).reshape(-1, len(known)) for c in "ab")
    model.calibrate(a, b, label)
    model.held_out = (len(label), float((model.posteriors(a, b).argmax(axis=1) == label).mean()) if len(label) else 0.0, float(np.bincount(label).max() / len(label)) if len(label) else 0.0)
    discard(sample)
    sent.unpersist()
    return model


def classify(rows: DataFrame, model: SourceModel | None, tokenizer: str) -> DataFrame:
    """``doc_id, typed, n_tokens, p``: tokens of each text and its posterior over the known sources in hundredths. One pass."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches):
            encoded, model = _encode(batch.column("text").to_pylist(), tokenizer), sent.value
            if model is None:
                p = [[] for _ in encoded]
            else:
                q = model.posteriors(*model.scores([batch.column(f"f{f}").to_pylist() for f in range(N_FEATURES)], encoded))
                q = np.round(model.observed(q, batch.column("typed").to_pylist()), 2)
                p = (q / q.sum(axis=1, keepdims=True)).tolist()
            sizes = pa.array([len(t) for t in encoded], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("typed"), sizes, pa.array(p, pa.list_(pa.float64()))], names=["doc_id", "typed", "n_tokens", "p"])

    return spread(rows).mapInArrow(run, "doc_id bigint, typed string, n_tokens bigint, p array<double>")


def classifier_report(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``(n_held_out, accuracy, most_frequent, text_weight, error_rate)`` of the classifier on held-out labelled documents."""
    rows = features(docs)
    known = sorted(r[0] for r in rows.filter("typed IS NOT NULL").select("typed").distinct().limit(1001).collect())
    model = fit_sources(rows, known, tokenizer or default_tokenizer())
    return docs.sparkSession.createDataFrame([(*model.held_out, 1 / model.heat, model.error)], "n_held_out bigint, accuracy double, most_frequent double, text_weight double, error_rate double")


def _rate(history: list[list[float]], k: int) -> Column:
    """A document's rate after all steps: it follows from its posterior, its limit and the totals' residuals so far."""
    if not history:
        return F.least(F.lit(1.0), F.col("cap"))
    steps = F.array(*(F.array(*map(F.lit, r)) for r in history))
    dot = lambda r: reduce(lambda a, b: a + b, (F.element_at("p", i + 1) * F.element_at(r, i + 1) for i in range(k)))
    return F.aggregate(steps, F.least(F.lit(1.0), F.col("cap")), lambda w, r: F.greatest(F.lit(0.0), F.least(F.col("cap"), w - dot(r))))


def mix(docs: DataFrame, targets: DataFrame, total_tokens: float | None = None, tokenizer: str | None = None, steps: int = STEPS) -> tuple[DataFrame, DataFrame]:
    """Copies per document, and the shares reached.

    First: ``(doc_id, source, n_tokens, rate, copies)`` for every document row, 0 copies where it is not used.
    Second: ``(source, target_share, reachable_share, actual_share, expected_share, n_docs, n_used, tokens, most_copies)``
    for every source of either side. Sources without target get no copies. Targets without documents cannot be
    reached; the reachable share spreads theirs over the others in proportion. ``total_tokens`` defaults to the most
    that can be had at these shares; more than that is reduced to it. Whole copies never exceed ``max_repeats``
    (null: once). Null and empty texts, null sources without other evidence and empty tables are no error. A source or
    target list of more than a thousand names is refused: names are kept on the driver.
    """
    listed = targets.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats").filter("source IS NOT NULL AND target_share > 0")
    listed = listed.groupBy("source").agg(F.sum("target_share").alias("share"), F.max(F.coalesce("max_repeats", F.lit(1.0))).alias("most")).limit(1001).collect()
    tokenizer, rows = tokenizer or default_tokenizer(), features(docs)
    typed = [r[0] for r in rows.filter("typed IS NOT NULL").select("typed").distinct().limit(1001).collect()]
    if max(len(listed), len(typed)) > 1000:
        raise ValueError("more than 1000 sources")
    known = sorted(typed)
    share = {r["source"]: r["share"] for r in listed}
    most = {r["source"]: float(math.floor(r["most"])) for r in listed}
    limits = F.array(*(F.lit(most.get(s, 0.0)) for s in known)) if known else F.array().cast("array<double>")
    scored = classify(rows, fit_sources(rows, known, tokenizer) if known else None, tokenizer)
    # a document belongs to its most likely source when copies are counted and limited
    place = F.array_position("p", F.array_max("p")).cast("int")
    names = F.array(*map(F.lit, known)) if known else F.array().cast("array<string>")
    scored = scored.withColumn("source", F.get(names, place - 1)).withColumn("cap", F.coalesce(F.get(limits, place - 1), F.lit(0.0)))
    scored = materialize(scored, "posteriors")
    classes = materialize(scored.groupBy("p", "cap").agg(F.sum("n_tokens").alias("tokens")), "classes")
    expected = lambda rate: [F.sum(F.col("tokens") * rate * F.element_at("p", i + 1)) for i in range(len(known))]
    history: list[list[float]] = []
    want: dict[str, float] = {}
    if known:
        have = [x or 0.0 for x in classes.agg(*expected(F.lit(1.0))).first()]
        room = [x or 0.0 for x in classes.agg(*expected(F.col("cap"))).first()]
        reach = {s: share[s] for i, s in enumerate(known) if share.get(s) and room[i] > 0.5}
        scale = sum(reach.values()) or 1.0
        want = {s: v / scale for s, v in reach.items()}
        largest = min((room[known.index(s)] / v for s, v in want.items()), default=0.0)
        total = min(largest, total_tokens) if total_tokens else largest
        goal = [want.get(s, 0.0) * total for s in known]
        for _ in range(steps if total else 0):
            now = [x or 0.0 for x in classes.agg(*expected(_rate(history, len(known)))).first()]
            if max(abs(a - g) for a, g in zip(now, goal, strict=True)) <= TOLERANCE * total:
                break
            # the gradient of the squares scaled by what a source has; sources without target do not push others
            history.append([(a - g) / h if g > 0 and h > 0 else 0.0 for a, g, h in zip(now, goal, have, strict=True)])
    rated = scored.withColumn("rate", _rate(history, len(known)) if known and want else F.lit(0.0))
    # whole copies: rates are run up in order of size within groups, and each whole number passed is a copy
    sizes = rated.groupBy("source").agg((F.floor(F.count(F.lit(1)) / GROUP) + 1).alias("groups"))
    # at most a thousand sources: a bounded broadcast
    sizes = F.broadcast(sizes.withColumnRenamed("source", "of_source"))
    spread_out = rated.join(sizes, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")
    spread_out = spread_out.withColumn("group", F.pmod(F.xxhash64("doc_id"), "groups"))
    order = W.partitionBy("source", "group").orderBy("n_tokens", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    run = F.round(F.sum("rate").over(order), 6) + F.pmod(F.xxhash64(F.coalesce("source", F.lit("")), "group"), F.lit(1000)) / 1000.0
    up = spread_out.withColumn("up", run)
    copies = F.least(F.floor("up") - F.floor(F.round(F.col("up") - F.col("rate"), 6)), F.ceil("rate"), F.floor("cap"))
    mixed = up.withColumn("copies", F.greatest(copies, F.lit(0)).cast("bigint")).select("doc_id", "source", "n_tokens", "rate", "copies")
    return mixed, _report(mixed, share, want)


def _report(mixed: DataFrame, share: dict[str, float], want: dict[str, float]) -> DataFrame:
    used = mixed.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.count_if(F.col("copies") > 0).alias("n_used"),
        F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"),
        F.sum(F.col("n_tokens") * F.col("rate")).alias("expected_tokens"),
        F.max("copies").alias("most_copies"),
    )
    spark = mixed.sparkSession
    goals = spark.createDataFrame([(s, float(v), float(want.get(s, 0.0))) for s, v in sorted(share.items())], "source string, target_share double, reachable_share double")
    every = goals.join(used, "source", "full").na.fill(0)
    whole = W.partitionBy(F.lit(0))  # one row a source
    part = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), F.sum(c).over(whole)), F.lit(0.0))
    return every.select("source", "target_share", "reachable_share", part("tokens").alias("actual_share"), part("expected_tokens").alias("expected_share"), "n_docs", "n_used", "tokens", "most_copies")
