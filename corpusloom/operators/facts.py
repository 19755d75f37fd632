"""A keyed fact table: search, context, upsert, recall by keywords, cards and fingerprints."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.runtime import materialize, salted_join, salted_semi_join


def _contains(column: str, query: str) -> Column:
    return F.contains(F.lower(F.col(column)), F.lit(query.lower()))


def search(facts: DataFrame, query: str = "", namespace: str | None = None, limit: int = 50) -> DataFrame:
    """Facts whose key or value contains the query (any case, no wildcards), in a namespace, by key.

    An empty query needs a namespace; the limit is kept within 1 and 500.
    """
    if not query and not namespace:
        raise ValueError("an empty query needs a namespace")
    rows = facts
    if namespace:
        rows = rows.filter(F.startswith("key", F.lit(namespace.rstrip(".") + ".")))
    if query:
        rows = rows.filter(_contains("key", query) | _contains("value", query))
    return rows.orderBy("key").limit(max(1, min(500, limit)))


def context(facts: DataFrame, topic: str = "") -> DataFrame:
    """Facts of a topic: the key itself or keys below it; every fact for an empty topic."""
    key = F.trim(F.lit(topic))
    return facts if not topic.strip() else facts.filter((F.col("key") == key) | F.startswith("key", F.concat(key, F.lit("."))))


def namespaces(facts: DataFrame) -> DataFrame:
    """``(namespace, n_facts, first_key, last_updated)`` by the part of the key before the first dot."""
    return facts.groupBy(F.substring_index("key", ".", 1).alias("namespace")).agg(F.count(F.lit(1)).alias("n_facts"), F.min("key").alias("first_key"), F.max("updated_at").alias("last_updated"))


def upsert(facts: DataFrame, changes: DataFrame) -> DataFrame:
    """One row per key: the latest change wins, a key that was there keeps its ``created_at``.

    Both sides have ``(key, value, type, source, confidence, created_at, updated_at)``. Ties in time go to the greatest
    value. Null keys are left out.
    """
    both = facts.withColumn("is_change", F.lit(0)).unionByName(changes.withColumn("is_change", F.lit(1))).filter("key IS NOT NULL")
    order = F.struct("is_change", "updated_at", "value")
    names = ["value", "type", "source", "confidence", "updated_at"]
    last = both.groupBy("key").agg(F.max_by(F.struct(*names), order).alias("last"), F.min_by("created_at", F.struct("is_change", "created_at")).alias("created_at"))
    return last.select("key", *(F.col(f"last.{n}").alias(n) for n in names), "created_at")


FACTS_HELD, MESSAGES_HELD = 20_000, 4_000  # facts and messages that meet in one task
CELLS = 4_000_000  # counts of a message and a fact that are held at once


def top_facts(words: pa.Table, facts: pa.Table, most: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(message, fact, score)`` of the ``most`` best facts of each message, as places in the two tables.

    ``words`` has ``words``, the keywords of each message, ``facts`` has ``words``, those that a fact holds,
    ``confidence``, ``updated_at`` and ``key``.
    """
    order = pc.sort_indices(facts, [("updated_at", "descending"), ("key", "ascending")])  # nulls last: a tie goes to the first
    facts = facts.take(order)
    flat = lambda t: (np.repeat(np.arange(t.num_rows), pc.list_value_length(t["words"]).to_numpy(zero_copy_only=False)), pc.list_flatten(t["words"]).combine_chunks())
    (m_owner, m_word), (f_owner, f_word) = flat(words), flat(facts)
    known = f_word.unique()
    m_code = pc.fill_null(pc.index_in(m_word, value_set=known), -1).to_numpy(zero_copy_only=False)
    f_code = pc.index_in(f_word, value_set=known).to_numpy(zero_copy_only=False)
    by = np.argsort(f_code, kind="stable")
    f_owner, starts = f_owner[by], np.searchsorted(f_code[by], np.arange(len(known) + 1))
    m_owner, m_code = m_owner[m_code >= 0], m_code[m_code >= 0]
    extra = 0.01 * pc.fill_null(facts["confidence"].cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
    n, out = facts.num_rows, []
    step = max(1, CELLS // n)
    for at in range(0, words.num_rows, step):
        size = min(step, words.num_rows - at)
        low, high = np.searchsorted(m_owner, [at, at + size])
        counts = np.zeros(size * n, dtype=np.int32)
        for owner, code in zip(m_owner[low:high] - at, m_code[low:high], strict=True):
            counts[owner * n + f_owner[starts[code] : starts[code + 1]]] += 1  # a word stands in a fact once
        counts = counts.reshape(size, n)
        scores = np.where(counts > 0, counts + extra, -np.inf)
        rows = np.arange(size)
        for _ in range(min(most, n)):
            best = scores.argmax(axis=1)
            score = scores[rows, best]
            got = counts[rows, best] > 0
            got &= score > -np.inf
            out.append((rows[got] + at, order.to_numpy()[best[got]], score[got]))
            scores[rows, best] = -np.inf
    return out


def recall(facts: DataFrame, messages: DataFrame, most: int = 4) -> DataFrame:
    """``(message_id, key, score, place)``: the facts that share most keywords with each message.

    Score is the number of keywords contained in key or value plus a hundredth of the confidence; ties go to the later
    update, then the key. Keywords meet keys by their first characters in an equi-join that carries no text; each pair
    that is left brings the text in once to look for the whole keyword. Messages and facts then meet in blocks, of which
    each gives a message's best facts alone: no pair of a message and a fact is shuffled. A message without keyword, and a fact without
    hit, give nothing. Fact keys must be unique.
    """
    asked = materialize(messages.select("message_id", F.explode(T.keywords(F.col("text"))).alias("word")).distinct(), "asked")
    hay = F.lower(F.concat_ws("\n", "key", "value"))
    held = materialize(facts.select("key", F.explode(T.probes(F.concat_ws("\n", "key", "value"))).alias("probe")), "probes")
    words = asked.select("word").distinct().withColumn("probe", F.substring("word", 1, 4))
    met = materialize(salted_join(held, words, "probe").select("key", "word").distinct(), "met")
    known = salted_join(met, facts.select("key", hay.alias("hay"), "confidence", "updated_at"), "key").filter(F.contains("hay", "word"))
    found = materialize(known.select("word", "key", "confidence", "updated_at"), "found")
    held = materialize(found.groupBy("key").agg(F.collect_set("word").alias("words"), F.max("confidence").alias("confidence"), F.max("updated_at").alias("updated_at")), "held")
    wanted = materialize(salted_semi_join(asked, found, "word").groupBy("message_id").agg(F.collect_set("word").alias("words")), "wanted")  # a message has few keywords
    n_facts, n_messages = held.count(), wanted.count()
    f_blocks, m_blocks = max(1, -(-n_facts // FACTS_HELD)), max(1, -(-n_messages // MESSAGES_HELD))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    m = wanted.select("*", F.pmod(F.xxhash64("message_id"), F.lit(m_blocks)).alias("m"), every(f_blocks).alias("f"))
    f = held.select("*", F.pmod(F.xxhash64("key"), F.lit(f_blocks)).alias("f"), every(m_blocks).alias("m"))

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        a, b = a.combine_chunks(), b.combine_chunks()
        parts = top_facts(a, b, most) if a.num_rows and b.num_rows else []
        message, fact, score = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
        b = b.select(["key", "updated_at"]).take(pa.array(fact, pa.int64()))
        return pa.table({"message_id": a["message_id"].take(pa.array(message, pa.int64())), "key": b["key"], "score": pa.array(score, pa.float64()), "updated_at": b["updated_at"]})

    kinds = dict(wanted.dtypes) | dict(held.dtypes)
    hits = m.groupBy("m", "f").cogroup(f.groupBy("m", "f")).applyInArrow(best, f"message_id {kinds['message_id']}, key {kinds['key']}, score double, updated_at {kinds['updated_at']}")
    order = W.partitionBy("message_id").orderBy(F.desc("score"), F.desc("updated_at"), "key")  # ``most`` rows of each block
    return hits.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).select("message_id", "key", "score", "place")


# The first line of a card of recalled facts, and the one that says that it was cut.
CARD_HEADER = "【已确认事实】以下是你以前确认过的稳定事实（跨会话记住的，可能过时；与用户当前说法冲突时以用户为准）："
CUT_MARK = "- …（还有更多事实，需要时用 fact_context 查询）"


def cards(lines: DataFrame, group: str, order: str, most_chars: int = 600, header: str = CARD_HEADER, mark: str = CUT_MARK) -> DataFrame:
    """``(group, n_lines, card)``: a header and lines in order while all of it, line ends included, stays in the budget.

    A card that leaves lines out ends with ``mark``, and is cut at the budget. A line takes a character at least, so only
    the first ``most_chars`` lines of a group can stand in a card: the others leave before the shuffle, and a flooding
    group with them.
    """
    by = W.partitionBy(group).orderBy(order)
    seen = lines.withColumn("at", F.row_number().over(by)).filter(F.col("at") <= most_chars)
    seen = seen.withColumn("run", len(header) + F.sum(F.char_length("line") + 1).over(by.rowsBetween(W.unboundedPreceding, 0)))
    kept = F.sort_array(F.collect_list(F.when(F.col("run") <= most_chars, F.struct("at", "line"))))
    card = F.transform("kept", lambda x: x["line"])
    made = seen.groupBy(group).agg(kept.alias("kept"), F.count(F.lit(1)).alias("n_seen"))
    whole = F.concat(F.array(F.lit(header)), F.when(F.size("kept") < F.col("n_seen"), F.concat(card, F.array(F.lit(mark)))).otherwise(card))
    return made.select(group, F.size("kept").cast("bigint").alias("n_lines"), F.substring(F.array_join(whole, "\n"), 1, most_chars).alias("card"))


def fingerprint(facts: DataFrame) -> DataFrame:
    """``(fingerprint)``: count and latest change, enough to see that something changed."""
    return facts.agg(F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.coalesce(F.max("updated_at").cast("string"), F.lit(""))).alias("fingerprint"))


def content_fingerprint(df: DataFrame, group: str, key: str, value: str, digits: int = 12, most: int = 10_000) -> DataFrame:
    """``(group, fingerprint)``: the beginning of a SHA-256 over the group's ``key=value`` entries in key order.

    For the answers of a specification, which are few: a group of more than ``most`` entries fails the query. Use
    ``table_fingerprint`` for groups of any size.
    """
    counted = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    checked = counted.select(F.col(group).alias("of_group"), F.when(F.col("n") > most, F.raise_error(F.lit("too many entries for one fingerprint")).cast("bigint")).otherwise(F.col("n")).alias("n"))
    rows = df.join(checked, F.col(group).eqNullSafe(F.col("of_group"))).filter("n > 0")
    entries = F.sort_array(F.collect_list(F.concat_ws("=", key, value)))
    return rows.groupBy(group).agg(F.substring(F.sha2(F.array_join(entries, "\0"), 256), 1, digits).alias("fingerprint"))


def table_fingerprint(df: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """``(group, n, fingerprint)``: number of rows, and the sum of 60 bits of a SHA-256 of each ``key=value``.

    The order of rows does not matter, repeated rows do, and sums combine before the shuffle: no group is gathered.
    """
    bits = F.conv(F.substring(F.sha2(F.concat_ws("=", key, value), 256), 1, 15), 16, 10).cast("decimal(20,0)")
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(bits).cast("string").alias("fingerprint"))


def checked_facts(facts: DataFrame) -> DataFrame:
    """Facts with trimmed keys and ``problem``: empty_key, empty_value or confidence (outside 0 to 1); null for a good one."""
    key = F.trim(F.coalesce("key", F.lit("")))
    problem = F.when(key == "", "empty_key").when(F.trim(F.coalesce("value", F.lit(""))) == "", "empty_value").when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(True)), "confidence")
    return facts.withColumn("key", key).withColumn("problem", problem)


def stable_json(pairs: DataFrame, group: str, key: str, value: str, most: int = 10_000) -> DataFrame:
    """``(group, json)``: an object a group with its keys in order, the last value of equal keys; for states of few keys."""
    last = pairs.filter(F.col(key).isNotNull()).groupBy(group, key).agg(F.max(value).alias("value"))
    entries = F.sort_array(F.collect_list(F.struct(F.col(key).alias("key"), "value")))
    whole = last.groupBy(group).agg(F.count(F.lit(1)).alias("n"), entries.alias("entries"))
    return whole.select(group, F.when(F.col("n") > most, F.raise_error(F.lit("too many keys for one object"))).otherwise(F.to_json(F.map_from_entries("entries"))).alias("json"))
