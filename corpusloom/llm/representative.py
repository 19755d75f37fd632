"""Best representative of each duplicate group, field by field, by token-level consensus.

Values are pooled per group and field, equal ones once with their weights summed. They are aligned progressively: the
heaviest is the first profile, each further value is aligned with the profile so far and adds its weighted tokens to
its columns, a token a column, or opens new ones. Values of one group are aligned in chunks of bounded size, and the
profiles of chunks are aligned with each other in the same way, level by level, so no group is ever gathered. A value
that merely stops early abstains from the columns it does not reach. The token with most weight in each column makes
the consensus; every value gets its distance from it in tokens, and the existing value closest to it is emitted.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.runtime import materialize, salted_join

CHUNK = 64  # values, or profiles, aligned in one go
CELLS = 1 << 22  # cells of an alignment table that is held at once; larger ones are halved first
TOKEN = re.compile(r"\w+?(?=[㐀-鿿])|[㐀-鿿]|\w+|[^\w\s]")
# What stands in a field that has no value.
PLACEHOLDERS = ["", "-", "--", "n/a", "na", "none", "null", "nil", "pending", "tbd", "unknown", "暂无摘要", "暂无", "无", "no abstract available", "no abstract", "abstract not available"]


FIELDS = ["doi", "abstract", "citation_count", "lit_source"]


def tokens(text: str) -> list[str]:
    """Words, ideographs and marks; dots of omission at the end are none, the text stops there."""
    return TOKEN.findall(re.sub(r"(?:\s*(?:\.\.+|…|\[\s*(?:\.\.+|…)\s*\]))+\s*$", "", text))


def _last_row(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Scores of aligning all of ``a`` with each beginning of ``b``: +2 for equal tokens, -1 for others and for gaps."""
    places = np.arange(len(b) + 1)
    row = -places.astype(np.int64)
    for token in a:
        row = _next_row(row, token, b, places)
    return row


def _next_row(row: np.ndarray, token: int, b: np.ndarray, places: np.ndarray) -> np.ndarray:
    best = row - 1
    best[1:] = np.maximum(best[1:], row[:-1] + np.where(b == token, 2, -1))
    # gaps along the row: a running maximum of scores lifted by their place
    return np.maximum.accumulate(best + places) - places


def _align(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Aligned places ``(i, j)`` of two token sequences, in order; places left out face a gap. Memory is bounded."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    before = [(k, k) for k in range(head)]
    after = [(len(a) - tail + k, len(b) - tail + k) for k in range(tail)]
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    if not len(x) or not len(y):
        return before + after
    if (len(x) + 1) * (len(y) + 1) > CELLS and len(x) > 1:
        middle = len(x) // 2
        cut = int(np.argmax(_last_row(x[:middle], y) + _last_row(x[middle:][::-1], y[::-1])[::-1]))
        inner = _align(x[:middle], y[:cut]) + [(i + middle, j + cut) for i, j in _align(x[middle:], y[cut:])]
        return before + [(i + head, j + head) for i, j in inner] + after
    places = np.arange(len(y) + 1)
    table = np.empty((len(x) + 1, len(y) + 1), dtype=np.int64)
    table[0] = -places
    for k, token in enumerate(x):
        table[k + 1] = _next_row(table[k], token, y, places)
    inner, i, j = [], len(x), len(y)
    while i and j:
        if table[i, j] == table[i - 1, j - 1] + (2 if x[i - 1] == y[j - 1] else -1):
            inner.append((i - 1 + head, j - 1 + head))
            i, j = i - 1, j - 1
        elif table[i, j] == table[i - 1, j] - 1:
            i -= 1
        else:
            j -= 1
    return before + inner[::-1] + after


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """``_align`` of tokens; what needs no table is told at once."""
    if a == b or len(a) == len(b) == 1:
        return [(k, k) for k in range(len(a))]
    numbers: dict[str, int] = {}
    x, y = (np.array([numbers.setdefault(t, len(numbers)) for t in tokens_], dtype=np.int64) for tokens_ in (a, b))
    return _align(x, y)


Profile = list[dict[str, float]]  # per column the weight of each token, "" for a gap


def top_tokens(profile: Profile) -> list[str]:
    return [max(column.items(), key=lambda x: (x[1], x[0]))[0] for column in profile]


def merge(profile: Profile, weight: float, other: Profile, other_weight: float) -> Profile:
    """Both aligned: columns that face each other add up, the rest face gaps; what one side does not reach at its end, it leaves open."""
    pairs = align([t or "\0" for t in top_tokens(profile)], [t or "\1" for t in top_tokens(other)])
    out: Profile = []
    i = j = 0
    for p, q in [*pairs, (len(profile), len(other))]:
        end = p == len(profile) and q == len(other)
        # on neither side does a gap vote beyond its last column
        out += [column if end and j == len(other) else {**column, "": column.get("", 0.0) + other_weight} for column in profile[i:p]]
        out += [column if end and i == len(profile) else {**column, "": column.get("", 0.0) + weight} for column in other[j:q]]
        if not end:
            column = dict(profile[p])
            for token, w in other[q].items():
                column[token] = column.get(token, 0.0) + w
            out.append(column)
        i, j = p + 1, q + 1
    return out


def _progress(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One profile of each list ``parts`` of values or profiles with their weights."""
    for pdf in frames:
        profiles, weights = [], []
        for parts in pdf.parts:
            profile, weight = None, 0.0
            for part in parts:
                new = json.loads(part["profile"]) if part["profile"] is not None else [{t: part["weight"]} for t in tokens(part["value"])]
                profile = new if profile is None else merge(profile, weight, new, part["weight"])
                weight += part["weight"]
            profiles.append(json.dumps(profile, ensure_ascii=False))
            weights.append(weight)
        yield pd.DataFrame({"slot": pdf["slot"], "chunk": pdf["chunk"], "profile": profiles, "weight": weights})


def _agreed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        yield pd.DataFrame({"slot": pdf["slot"], "agreed": [[t for t in top_tokens(json.loads(p)) if t] for p in pdf.profile]})


def _distances(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        far, cut = [], []
        for agreed, value in zip(pdf.agreed, pdf.value, strict=True):
            a, v = list(agreed), tokens(value)
            if a == v:
                far.append(0)
                cut.append(False)
                continue
            pairs = align(a, v)
            same = sum(a[i] == v[j] for i, j in pairs)
            far.append(len(a) + len(v) - len(pairs) - same)
            cut.append(bool(v) and bool(a) and (not pairs or pairs[-1][0] < len(a) - 1))
        yield pdf[["slot", "value"]].assign(distance=pd.array(far, dtype="int64"), is_cut=pd.array(cut, dtype="bool"))


def consensus(values: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``(slot, value, distance, is_cut)`` for every distinct value of every slot.

    ``values`` has ``(slot STRING, value STRING, weight DOUBLE)``, one row per holder; a slot is a group and a field.
    ``distance`` is the number of tokens changed, added or lost against the consensus, ``is_cut`` says that the value
    stops before the consensus does. Null values and slots are left out; ties go to the longer, then the smaller value
    in the order of alignment, and to the greater token in a column.
    """
    pool = values.filter("slot IS NOT NULL AND value IS NOT NULL").groupBy("slot", "value").agg(F.sum("weight").alias("weight"))
    pool = materialize(pool, "pool")
    sizes = pool.groupBy("slot").agg(F.count(F.lit(1)).alias("n"))
    sized = materialize(salted_join(pool, sizes, "slot"), "sized")
    # a slot of one value is its own consensus
    alone = sized.filter("n = 1").select("slot", "value", F.lit(0).cast("bigint").alias("distance"), F.lit(False).alias("is_cut"))
    several = sized.filter("n > 1")
    parts = F.ceil(F.col("n") / chunk)
    level = several.select("slot", F.pmod(F.xxhash64("value"), parts).alias("chunk"), F.lit(None).cast("string").alias("profile"), "value", "weight")
    while True:
        order = F.struct((-F.col("weight")).alias("by"), (-F.char_length(F.coalesce("value", "profile"))).alias("size"), "value", "profile", "weight")
        listed = level.groupBy("slot", "chunk").agg(F.sort_array(F.collect_list(order)).alias("parts"))
        profiles = materialize(listed.select("slot", "chunk", "parts").mapInPandas(_progress, "slot string, chunk bigint, profile string, weight double"), "profiles")
        more = profiles.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        if more.isEmpty():
            break
        # profiles of one slot next to each other, chunk by chunk
        level = profiles.select("slot", F.floor(F.col("chunk") / chunk).alias("chunk"), "profile", F.lit(None).cast("string").alias("value"), "weight")
    agreed = profiles.select("slot", "profile").mapInPandas(_agreed, "slot string, agreed array<string>")
    judged = salted_join(materialize(several.select("slot", "value"), "several"), agreed, "slot").mapInPandas(_distances, "slot string, value string, distance long, is_cut boolean")
    return alone.union(judged)


def clean_doi(doi: Column) -> Column:
    """The DOI in lower case without resolver or label; null unless it has a prefix and a suffix."""
    return F.regexp_extract(F.lower(F.trim(doi)), r"^(?:https?://)?(?:(?:dx\.|www\.)?doi\.org/)?(?:doi:?\s*)?(10\.\d{4,9}(?:\.\d+)*/\S*[^\s/.])$", 1)


def clean_source(source: Column) -> Column:
    """A source name as the trust table writes it: lower case, no outer blanks, hyphens for blanks."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(source, r"^[\s ]+|[\s ]+$", ""))), r"[\s_-]+", "-")


def clean_text(text: Column) -> Column:
    """Text without tags and outer blanks; null where only a placeholder stands."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(text, r"<[^<>]{1,60}>", " "), r"\s+", " "))
    return F.when(F.regexp_replace(F.lower(plain), r"[.\s]+$", "").isin(PLACEHOLDERS), None).otherwise(plain)


def is_whole(text: Column) -> Column:
    """Text that ends as a sentence ends, not with dots of omission or a remark that it was cut."""
    return text.rlike(r"[.。!！?？][\"'”’)）\]]*$") & ~text.rlike(r"(?:\.\.+|…|\[[^\]]*\])[\"'”’)）]*$")


def field_values(records: DataFrame, groups: DataFrame, trust: DataFrame) -> DataFrame:
    """Long form ``(group_id, rec_id, field_name, value, original, score, weight)`` of the four fields.

    ``score`` orders values of a field (null: not eligible); a record of several groups stands in each. Rows delivered
    again count as they stand. Placeholders, nulls and unusable values have a null score.
    """
    members = groups.select(F.col("group_id").cast("bigint"), F.col("rec_id").cast("bigint")).distinct()
    ranks = trust.select(clean_source(F.col("lit_source")).alias("source"), F.col("trust_rank").cast("bigint").alias("rank")).groupBy("source").agg(F.min("rank").alias("rank"))
    rows = records.select(
        F.col("rec_id").cast("bigint"),
        "doi",
        "abstract",
        F.col("citation_count").cast("bigint"),
        "lit_source",
        F.coalesce(F.unix_micros(F.col("retrieved_at").cast("timestamp")), F.lit(-(1 << 62))).alias("at"),
        clean_source(F.col("lit_source")).alias("source"),
    ).join(members, "rec_id").join(ranks, "source", "left")
    doi, abstract = clean_doi(F.col("doi")), clean_text(F.col("abstract"))
    field = lambda name, value, original, score: F.struct(F.lit(name).alias("field_name"), value.alias("value"), original.cast("string").alias("original"), score.cast("bigint").alias("score"))
    fields = F.array(
        field("doi", F.when(doi != "", doi), F.col("doi"), F.when(doi != "", 0)),
        field("abstract", abstract, F.col("abstract"), F.when(is_whole(abstract), 0)),
        field("citation_count", F.col("citation_count").cast("string"), F.col("citation_count"), F.when(F.col("citation_count") >= 0, F.col("at"))),
        field("lit_source", F.col("source"), F.col("lit_source"), -F.col("rank")),
    )
    weight = F.lit(1.0) + F.coalesce(1.0 / F.col("rank"), F.lit(0.0))
    return rows.select("group_id", "rec_id", "at", weight.alias("weight"), F.inline(fields))


def judged_values(records: DataFrame, groups: DataFrame, trust: DataFrame) -> DataFrame:
    """``field_values`` with the distance of each value from its group's consensus; a cut abstract is not eligible."""
    slot = F.concat_ws(":", "group_id", "field_name")
    values = materialize(field_values(records, groups, trust).withColumn("slot", slot), "values")
    judged = consensus(values.filter("value IS NOT NULL").select("slot", "value", "weight"))
    judged = judged.select(F.struct("slot", "value").alias("held"), "distance", "is_cut")
    out = salted_join(values.withColumn("held", F.struct("slot", "value")), judged, "held", "left")
    cut = (F.col("field_name") == "abstract") & F.coalesce("is_cut", F.lit(False))
    return materialize(out.withColumn("score", F.when(~cut, F.col("score"))).drop("held", "slot"), "judged")


def sole_best(values: DataFrame) -> DataFrame:
    """``(group_id, field_name, rec_id)``: the records that survivors are taken from, where no other holds as good a value.

    The survivor of a field comes from the consensus; the check that follows drops it where several records are
    eligible with the same score, or none is.
    """
    survivors = surviving_records(values)
    taken = survivors.select("group_id", F.explode(F.array(*(F.struct(F.lit(n).alias("field_name"), F.col(f"{n}_rec_id").alias("rec_id")) for n in FIELDS))).alias("of")).select("group_id", "of.*").filter("rec_id IS NOT NULL")
    return taken.join(_alone(values), ["group_id", "field_name", "rec_id"], "left_semi")


def _alone(values: DataFrame) -> DataFrame:
    """``(group_id, field_name, rec_id)``: the record that alone has the highest score of its group."""
    by_score = values.filter("score IS NOT NULL").groupBy("group_id", "field_name", "score").agg(F.count(F.lit(1)).alias("n"), F.min("rec_id").alias("rec_id"))
    best = by_score.groupBy("group_id", "field_name").agg(F.max_by(F.struct("n", "rec_id"), "score").alias("best"))
    return best.filter("best.n = 1").select("group_id", "field_name", F.col("best.rec_id").alias("rec_id"))


def surviving_records(values: DataFrame) -> DataFrame:
    """One row per group: each field's surviving value and the record it is taken from.

    Eligible values go first by score, then the one closest to the consensus, the latest, and the smallest record; a
    field without eligible value falls back to the closest value there is, or null.
    """
    order = F.struct(F.col("score").isNotNull(), F.coalesce("score", F.lit(-(1 << 62))), -F.coalesce("distance", F.lit(1 << 40)), F.col("at"), -F.col("rec_id"))
    names = FIELDS
    chosen = [F.max_by(F.when(F.col("value").isNotNull(), F.struct(F.when(F.col("field_name").isin("abstract", "citation_count"), F.col("original")).otherwise(F.col("value")).alias("value"), "rec_id")), F.when((F.col("field_name") == n) & F.col("value").isNotNull(), order)).alias(n) for n in names]
    best = values.groupBy("group_id").agg(*chosen, F.count_distinct("rec_id").alias("n_records"))
    columns = [c for n in names for c in (F.col(f"{n}.value").alias(n), F.col(f"{n}.rec_id").alias(f"{n}_rec_id"))]
    return best.select("group_id", "n_records", *columns)
