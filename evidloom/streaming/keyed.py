"""Streams with state by key: rows are put in order behind the watermark, and folded with timers in event time.

Rows that arrive within the watermark's delay may come in any order: each key holds its rows until the watermark has
passed them. So a stream gives the rows of the batch form, however its files are dealt and however often it is started
again. Rows later than that are left out. A key's waiting rows are what arrived within the delay and no more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from evidloom.streaming.assets import NEXT

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Seconds that a state may last, by the kind of asset where it matters; other states wait as long as it takes.
LIMITS: dict[str, dict[str | None, int]] = {"recognizing": {"pdf": 1200, "video": 1800, None: 3600}, "Cliping": {None: 3600}, "Structuring": {None: 3600}, "Ingesting": {None: 3600}}
FINAL = ("Ready", "Failed")
SECOND = 1_000_000

#: From a key's state (None at first), its next row (None: only time passed) and the watermark to output rows and the new state.
Fold = Callable[[tuple | None, tuple | None, int], tuple[list[tuple], tuple | None]]


def keyed_state(spark: SparkSession) -> None:
    """Sets the session's state store to the one that state by key needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class InOrder(StatefulProcessor):
    """Holds each key's rows until the watermark has passed them, then folds them by time and place.

    Rows have their time in microseconds first and a number that settles ties second. ``wake`` gives the time, in
    microseconds, at which a state has to be looked at again without a row; None for no such time.
    """

    def __init__(self, row: str, state: str, fold: Fold, wake: Callable[[tuple], int | None], out: tuple[str, ...]):
        self.row, self.state, self.fold, self.wake, self.out = row, state, fold, wake, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting, self.now = handle.getListState("waiting", self.row), handle.getValueState("now", self.state)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        new = [tuple(r)[len(key) :] for r in rows]
        self.waiting.appendList(new)
        self._wake_at(min(r[0] for r in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: r[:2]) if self.waiting.exists() else []
        due, rest = [r for r in held if r[0] < passed], [r for r in held if r[0] >= passed]
        state = tuple(self.now.get()) if self.now.exists() else None
        made: list[tuple] = []
        for r in [*due, None]:
            more, state = self.fold(state, r, passed)
            made += more
        if rest:
            self.waiting.put(rest)
            self._wake_at(rest[0][0])
        else:
            self.waiting.clear()
        if state is None:
            self.now.clear()
        else:
            self.now.update(state)
            if (at := self.wake(state)) is not None and at >= passed:
                self._wake_at(at)
        return iter([Row(**dict(zip(self.out, (*key, *m), strict=True))) for m in made])

    def _wake_at(self, micros: int) -> None:
        self.handle.registerTimer(micros // 1000 + 1)

    def close(self) -> None:
        pass


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def _ordered(rows: DataFrame, key: str, at: str, delay: str, columns: list[Column], processor: InOrder, schema: str) -> DataFrame:
    keyed_state(rows.sparkSession)
    timed = rows.withColumn("_at", F.col(at).cast("timestamp")).filter("_at is not null").withWatermark("_at", delay)
    own = timed.select(F.col(key).alias("key"), _micros(F.col("_at")).alias("at"), *columns, "_at")
    return own.groupBy("key").transformWithState(processor, schema, "Append", "EventTime")


# --- Assets -------------------------------------------------------------------------------------------------------


def _limit(limits: dict, status: str, kind: str | None) -> int | None:
    own = limits.get(status)
    return None if own is None else own.get(kind, own.get(None))


def asset_fold(limits: dict) -> Fold:
    """An asset's course: ``done`` leads on, ``failed`` and a state that lasts beyond its limit to Failed, where it ends.

    The state is (status, deadline in microseconds or None). An event exactly at the deadline is in time.
    """

    def fold(state: tuple | None, row: tuple | None, passed: int) -> tuple[list[tuple], tuple | None]:
        if state is None and row is None:
            return [], None
        status, deadline = state or ("Uploading", None)
        if status in FINAL:
            return [], (status, None)
        if deadline is not None and (row[0] if row else passed) > deadline:
            return [("Failed", deadline, "timeout")], ("Failed", None)
        if row is None or row[2] not in ("done", "failed"):
            return [], (status, deadline)
        if row[2] == "failed":
            return [("Failed", row[0], "failed")], ("Failed", None)
        status = NEXT[status]
        seconds = _limit(limits, status, row[3])
        return [(status, row[0], "done")], (status, None if seconds is None else row[0] + seconds * SECOND)

    return fold


def asset_changes(events: DataFrame, delay: str = "10 minutes", limits: dict = LIMITS) -> DataFrame:
    """A stream of ``events`` (asset_id, event_id, event, asset_type, at) as a stream of states: (asset_id, status, at, reason).

    ``reason`` is done, failed or timeout; a timeout comes without any event, once the watermark is past the deadline.
    Events of one time go by event_id. Events without a time are left out, of unknown kinds change nothing, and after
    Ready or Failed nothing does. Sets the session's state store.
    """
    processor = InOrder("at bigint, event_id bigint, event string, asset_type string", "status string, deadline bigint", asset_fold(limits), lambda s: None if s[1] is None else s[1] + 1, ("asset_id", "status", "at", "reason"))
    kind = events.schema["asset_id"].dataType.simpleString()
    columns = [F.col("event_id").cast("bigint"), "event", "asset_type"]
    found = _ordered(events, "asset_id", "at", delay, columns, _without_time(processor), f"asset_id {kind}, status string, at bigint, reason string")
    return found.withColumn("at", F.timestamp_micros("at"))


def _without_time(processor: InOrder) -> InOrder:
    """Rows come with the watermark's column at their end, which the processor's own rows don't have."""
    inner = processor.handleInputRows
    processor.handleInputRows = lambda key, rows, timers: inner(key, (tuple(r)[:-1] for r in rows), timers)
    return processor


def asset_history(events: DataFrame, until: Column | None = None, limits: dict = LIMITS) -> DataFrame:
    """The same from a table, as known at ``until`` (the latest event's time, by default nothing is known beyond events).

    Of each asset only the first six ``done`` and the first ``failed`` event count, so what is folded is bounded.
    """
    own = events.filter("at is not null").select("asset_id", F.col("event_id").cast("bigint").alias("event_id"), "event", "asset_type", _micros(F.col("at")).alias("at"))
    place = F.row_number().over(Window.partitionBy("asset_id", "event").orderBy("at", "event_id"))
    first = own.filter(F.col("event").isin("done", "failed")).withColumn("n", place).filter(F.col("n") <= len(NEXT))
    # Any event after a deadline tells that it has passed.
    last = own.groupBy(F.col("asset_id").alias("of")).agg(F.max("at").alias("latest"))
    known = F.greatest(F.col("latest"), _micros(until)) if until is not None else F.col("latest")
    listed = first.groupBy("asset_id").agg(F.array_sort(F.collect_list(F.struct("at", "event_id", "event", "asset_type"))).alias("events"))
    both = listed.join(last, F.col("asset_id").eqNullSafe(F.col("of"))).withColumn("known", known)
    step = F.create_map(*(F.lit(x) for kv in NEXT.items() for x in kv))

    def seconds(status: Column, kind: Column) -> Column:
        out = F.lit(None).cast("bigint")
        for s, by in limits.items():
            own = F.lit(by.get(None)).cast("bigint")
            for k, v in by.items():
                if k is not None:
                    own = F.when(kind == k, F.lit(v).cast("bigint")).otherwise(own)
            out = F.when(status == s, own).otherwise(out)
        return out

    def one(acc: Column, e: Column) -> Column:
        late, over = F.coalesce(e["at"] > acc["deadline"], F.lit(False)), acc["status"].isin(*FINAL)
        status = F.when(late | (e["event"] == "failed"), "Failed").otherwise(F.try_element_at(step, acc["status"]))
        reason = F.when(late, "timeout").otherwise(e["event"])
        at = F.when(late, acc["deadline"]).otherwise(e["at"])
        added = F.concat(acc["out"], F.array(F.struct(status.alias("status"), at.alias("at"), reason.alias("reason"))))
        moved = F.struct(status.alias("status"), F.when(status != "Failed", e["at"] + seconds(status, e["asset_type"]) * SECOND).alias("deadline"), added.alias("out"))
        return F.when(over, acc).otherwise(moved)

    kind = "struct<status:string,deadline:bigint,out:array<struct<status:string,at:bigint,reason:string>>>"
    begin = F.struct(F.lit("Uploading").alias("status"), F.lit(None).cast("bigint").alias("deadline"), F.array().cast("array<struct<status:string,at:bigint,reason:string>>").alias("out")).cast(kind)
    folded = both.withColumn("end", F.aggregate("events", begin, lambda acc, e: one(acc, e).cast(kind)))
    timeout = F.array(F.struct(F.lit("Failed").alias("status"), F.col("end.deadline").alias("at"), F.lit("timeout").alias("reason")))
    rows = F.when(F.coalesce(F.col("end.deadline") < F.col("known"), F.lit(False)), F.concat("end.out", timeout)).otherwise(F.col("end.out"))
    return folded.select("asset_id", F.inline(rows)).withColumn("at", F.timestamp_micros("at"))


# --- Changes of status --------------------------------------------------------------------------------------------


def change_fold(forget: int | None) -> Fold:
    """Rows whose status isn't the one before; the first of a key is one, and the first after ``forget`` seconds without a row."""

    def fold(state: tuple | None, row: tuple | None, passed: int) -> tuple[list[tuple], tuple | None]:
        if state is not None and forget is not None and (row[0] if row else passed) > state[1] + forget * SECOND:
            state = None
        if row is None:
            return [], state
        changed = state is None or state[0] != row[2]
        return [(row[1], row[0], row[2])] if changed else [], (row[2], row[0])

    return fold


def status_changes(rows: DataFrame, key: str, order: str, status: str, at: str = "ts", delay: str = "10 minutes", forget: int | None = None) -> DataFrame:
    """A stream of statuses as a stream of their changes: (key, order, at, status), as ``sessions.changed`` finds them in a table.

    Rows of one time go by ``order``, a whole number. A null status is a status. A key that has no row for ``forget``
    seconds is forgotten and its state freed; without ``forget`` keys stay. Rows without a time are left out, rows
    later than ``delay`` too. Sets the session's state store.
    """
    processor = InOrder("at bigint, place bigint, status string", "status string, at bigint", change_fold(forget), lambda s: None if forget is None else s[1] + forget * SECOND + 1, (key, order, at, status))
    kind = rows.schema[key].dataType.simpleString()
    columns = [F.col(order).cast("bigint").alias("place"), F.col(status).cast("string").alias("status")]
    found = _ordered(rows, key, at, delay, columns, _without_time(processor), f"{key} {kind}, {order} bigint, {at} bigint, {status} string")
    return found.withColumn(at, F.timestamp_micros(at))
