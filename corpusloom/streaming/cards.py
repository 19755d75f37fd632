"""Keyed state over streams: emit once per change, recall cards, and stateless message filters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.functions import text as T
from corpusloom.operators import facts as K
from corpusloom.runtime import materialize


def user_messages(messages: DataFrame, least: int = 8) -> DataFrame:
    """Messages that can ask for something: long enough and no command. Null texts are dropped."""
    text = F.trim("text")
    return messages.filter((F.char_length(text) >= least) & ~F.startswith(text, F.lit("/")))


def matching_messages(messages: DataFrame, patterns: list[str], bypass: list[str]) -> DataFrame:
    """Messages that match any pattern and no bypass pattern; a stateless filter, so it works on any stream."""
    any_of = lambda ps: F.lit(False) if not ps else F.coalesce(F.col("text").rlike("|".join(f"(?:{p})" for p in ps)), F.lit(False))
    return messages.filter(any_of(patterns) & ~any_of(bypass))


# Commands that destroy something, by label; the first that fits counts.
DESTRUCTIVE = [
    ("递归删除", r"(?i)\brm\s+-[a-z]*r[a-z]*"),
    ("强制推送 / 硬重置", r"(?i)\bgit\s+(push[^\n]*(--force|-f)|reset\s+(--hard|-f))"),
    ("清除未跟踪文件", r"(?i)\bgit\s+clean\b"),
    ("数据库破坏性语句", r"(?i)\b(drop\s+(table|database|index)|truncate(\s+table)?\b|delete\s+from\b)"),
    ("磁盘分区 / 格式化 / dd 覆写", r"(?i)\b(mkfs\.|fdisk|parted\b|dd\s+if=)"),
    ("写入设备文件", r"(?i)>\s*/dev/\S+"),
    ("管道执行远程脚本", r"(?i)(curl|wget)[^|\n]*\|\s*(sudo\s+)?(ba)?sh\b"),
    ("权限放开", r"(?i)chmod\s+(-R\s+)?(777|a\+rwx)"),
    ("关机 / 重启", r"(?i)\b(shutdown|reboot|poweroff)\b"),
    ("强制覆盖历史", r"(?i)\bgit\s+(push\b[^\n]*\+[^\s]*:|commit\s+--amend\b)"),
]


def first_rule(text, rules: list[tuple[str, str]]):
    """Label of the first rule ``(label, pattern)`` that a text matches, or null."""
    return F.coalesce(*(F.when(text.rlike(p), F.lit(label)) for label, p in rules)) if rules else F.lit(None).cast("string")


def changed_only(stream: DataFrame, key: str, fingerprint: str, carry: list[str] | None = None, ttl: int | None = None) -> DataFrame:
    """``(key, fingerprint, *carry)`` of the rows whose fingerprint differs from the last one seen for their key.

    Within a batch, rows of one key are taken in the order of ``seq``; only the columns named here are held for it, for
    the rows of one key in one micro-batch (limit those by the source's options). State is one string per key; with
    ``ttl`` (milliseconds of processing time) it is forgotten after that long without rows. A stream with ``ttl`` goes
    on until it is stopped, also when its trigger is ``availableNow``. Null keys and fingerprints are dropped.
    """
    carried = [c for c in dict.fromkeys(carry or []) if c not in (key, fingerprint)]
    held = list(dict.fromkeys([fingerprint, "seq", *carried]))

    def update(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat([pdf[held] for pdf in frames]).sort_values("seq", kind="stable")
        before = rows[fingerprint].shift(1)
        before.iloc[0] = state.get[0] if state.exists else None
        fresh = rows[rows[fingerprint] != before]
        state.update((str(rows[fingerprint].iloc[-1]),))
        if ttl:
            state.setTimeoutDuration(ttl)
        if len(fresh):
            yield pd.DataFrame({key: keys[0], fingerprint: fresh[fingerprint].to_numpy(), **{c: fresh[c].to_numpy() for c in carried}})

    kinds = dict(stream.dtypes)
    rows = stream.select(key, F.col(fingerprint).cast("string").alias(fingerprint), *held[1:]).filter(F.col(key).isNotNull() & F.col(fingerprint).isNotNull())
    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl else GroupStateTimeout.NoTimeout
    schema = ", ".join([f"{key} {kinds[key]}", f"{fingerprint} string", *(f"{c} {kinds[c]}" for c in carried)])
    return rows.groupBy(key).applyInPandasWithState(update, schema, "last string", "append", timeout)


def recall_cards(messages: DataFrame, facts: DataFrame, out: str, checkpoint: str, most: int = 4, most_chars: int = 600) -> StreamingQuery:
    """Start a stream that writes ``(agent_id, message_id, fingerprint, n_lines, card)`` to ``out``.

    ``messages`` is a stream of ``(agent_id, message_id, seq, text)``. A message of a user that asks for something gets
    the card of the facts it recalls once per agent and state of the fact table, which is read when the stream starts.
    """
    stamp = K.fingerprint(facts).first()[0]
    asked = user_messages(messages).withColumn("fingerprint", F.lit(stamp))
    first = changed_only(asked, "agent_id", "fingerprint", ["message_id", "text"])

    def write(batch: DataFrame, number: int) -> None:
        batch = materialize(batch, "messages")
        found = K.recall(facts, batch, most).join(facts.select("key", "value"), "key")
        lines = found.select("message_id", "place", F.concat(F.lit("- "), "key", F.lit(" = "), "value").alias("line"))
        made = batch.select("agent_id", "message_id", "fingerprint").join(K.cards(lines, "message_id", "place", most_chars), "message_id")
        # a batch that is run again writes over its own folder
        made.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return first.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def recall_stream(messages: DataFrame, facts: DataFrame) -> DataFrame:
    """``(agent_id, message_id, key, word)``: facts met by the keywords of streamed messages, by a stream-static join."""
    asked = user_messages(messages).select("agent_id", "message_id", F.explode(T.keywords(F.col("text"))).alias("word")).withColumn("probe", F.substring("word", 1, 4))
    whole = F.concat_ws("\n", "key", "value")
    held = facts.select("key", F.lower(whole).alias("hay"), F.explode(T.probes(whole)).alias("probe"))
    return asked.join(held, "probe").filter(F.contains("hay", "word")).select("agent_id", "message_id", "key", "word")


def windowed_counts(stream: DataFrame, ts: str, key: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``(window_start, key, n)`` per tumbling window; rows later than ``late`` behind the watermark are dropped."""
    counted = stream.withWatermark(ts, late).groupBy(F.window(ts, window), key).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), key, "n")
