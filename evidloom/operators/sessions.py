"""Conversations: context, names, counts and changes of state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidloom.functions.text import session_name

# Fixed value: messages of history that a question is asked with.
HISTORY = 6


def last_messages(messages: DataFrame, n: int = HISTORY, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last ``n`` messages of each conversation, with ``recency`` 1 for the newest."""
    newest = Window.partitionBy(key).orderBy(F.desc(order), F.desc("role"), F.desc("text"))
    return messages.withColumn("recency", F.row_number().over(newest)).filter(F.col("recency") <= n)


def context(messages: DataFrame, n: int = HISTORY, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Each conversation's history, oldest first: ``role: text`` lines of at most ``n`` messages."""
    return last_messages(messages, n, key, order).groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("recency", "role", "text")), asc=False), lambda m: F.concat_ws(": ", m["role"], m["text"])), "\n").alias("history"), F.count(F.lit(1)).alias("n_messages"))


def names(messages: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    return messages.groupBy(key).agg(session_name(F.min_by("text", order)).alias("chat_name"))


def counts(messages: DataFrame, evidence: DataFrame | None = None, key: str = "conv_id") -> DataFrame:
    own = messages.groupBy(key).agg(F.count(F.lit(1)).alias("messages_count"))
    if evidence is None:
        return own.withColumn("evidence_count", F.lit(0).cast("bigint"))
    return own.join(evidence.groupBy(key).agg(F.count(F.lit(1)).alias("evidence_count")), key, "left").fillna(0, ["evidence_count"])


def changed(rows: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """Rows whose state isn't the one before; the first of a key is one."""
    before = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("before", F.lag(state).over(before)).withColumn("place", F.row_number().over(before)).filter((F.col("place") == 1) | ~F.col("before").eqNullSafe(F.col(state))).drop("before", "place")


def last_flag(rows: DataFrame, key: str, order: list[str], name: str = "is_last") -> DataFrame:
    later = F.lead(F.lit(1)).over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn(name, later.isNull())


def first_items(items: Column, n: int = 2) -> Column:
    return F.slice(items, 1, n)


def said(tokens: DataFrame, key: str, order: str, delta: str) -> DataFrame:
    """A message from its pieces, in order."""
    return tokens.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, delta))), lambda t: t[delta]), "").alias("message"))


def conversation_prompt(history: Column, prompt: Column) -> Column:
    """A history (array of role and text) with the new prompt as the user's last message; without history, that alone."""
    new = F.array(F.struct(F.lit("user").alias("role"), prompt.alias("text")))
    return F.when(history.isNull(), new).otherwise(F.concat(history, new))


#: What each state of a session leads to once its work is done; Evaluating leads on or back, any failure to FAILED.
NEXT = {"Idle": "Preparing", "Preparing": "Researching", "Researching": "Evaluating", "Strengthening": "Finalizing", "Finalizing": "Idle"}


def next_state(status: Column, proceed: Column, attempts: Column, failed: Column, most: int = 2) -> Column:
    """A session's state after the one it is in: back to Researching while it may not proceed and has attempts left."""
    states = F.create_map(*(F.lit(x) for kv in NEXT.items() for x in kv))
    judged = F.when(F.coalesce(proceed, F.lit(False)) | (attempts >= most), "Strengthening").otherwise("Researching")
    on = F.when(status == "Evaluating", judged).otherwise(F.coalesce(F.try_element_at(states, status), status))
    return F.when(F.coalesce(failed, F.lit(False)) & (status != "Idle"), "FAILED").otherwise(on)


def admitted(requests: DataFrame, running: DataFrame, key: str = "chat_id", order: str = "at") -> DataFrame:
    """The first request of each chat that has no running task; others are refused."""
    free = requests.join(running.select(key), key, "left_anti")
    rest = [c for c in requests.columns if c != key]
    return free.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("row")).select(key, "row.*")


def reset(sessions: DataFrame) -> DataFrame:
    """Sessions as they are read again at a start: idle, but for failed ones."""
    return sessions.withColumn("status", F.when(F.col("status") == "FAILED", F.col("status")).otherwise(F.lit("Idle")))
