"""Versions of late and corrected values, in event order, whatever the batches were."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class EventOrder(StatefulProcessor):
    """State of a key: rows that wait for the key's watermark (a list), and the head: the newest
    event time, the value in force and its version.

    The watermark of a key trails its newest event time by the delay. A row that arrives
    behind it is late and is judged at once, against the value in force; any other waits in the list and is
    judged in order of event time once the watermark reaches it. A value that differs from
    the one in force opens the next version.
    """

    def __init__(self, delay_us: int, ttl_ms: int | None):
        self.delay, self.ttl = delay_us, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "newest long, value string, version long", self.ttl)
        self.waiting = handle.getListState("waiting", "at long, seq long, value string", self.ttl)

    def handleInputRows(self, key, rows: Iterator[Row], timer_values) -> Iterator[Row]:
        held = self.head.get() if self.head.exists() else None
        newest, value, version = held if held else (None, None, 0)
        waiting = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        # A batch brings at most what its trigger admits; rows that wait span the delay.
        for r in sorted(rows, key=lambda r: r.seq):
            late = newest is not None and r.at < newest - self.delay
            if late:
                due = [(r.at, r.seq, r.value)]
            else:
                waiting.append((r.at, r.seq, r.value))
                if newest is not None and newest - self.delay < r.at <= newest:
                    continue
                newest = r.at if newest is None else max(r.at, newest)
                waiting.sort(key=lambda w: w[:2])
                n = next((k for k, w in enumerate(waiting) if w[0] > newest - self.delay), len(waiting))
                due, waiting = waiting[:n], waiting[n:]
            for at, seq, new in due:
                if version == 0 or new != value:
                    value, version = new, version + 1
                    yield Row(key=key[0], at=at, seq=seq, value=new, version=version, late=late)
        self.head.update((newest, value, version))
        if waiting:
            self.waiting.put(waiting)
        else:
            self.waiting.clear()

    def close(self) -> None:
        pass


def late_versions(events: DataFrame, key: str, value: str, event_time: str, order: str, delay: str, ttl_ms: int | None = None) -> DataFrame:
    """Versions of `value` per `key`: key, event_time, order, value, version, late.

    `order` is the sequence in which rows arrive (an offset or load number). A row is late if its event
    time lies more than `delay` behind the newest that arrived before it for its key. Rows that are
    not late count in order of event time, so A, B, A gives three versions in any batches. No
    earlier output is read; state per key is one row and what `delay` spans, and goes after
    `ttl_ms` without use. Rows without key, event time or order are left out; a null value is a value.
    Needs the RocksDB state store.
    """
    rows = events.select(
        F.col(key).alias("key"), F.unix_micros(F.col(event_time).cast("timestamp")).alias("at"), F.col(order).cast("long").alias("seq"), F.col(value).cast("string").alias("value")
    ).where("key is not null and at is not null and seq is not null")
    delay_us = events.sparkSession.sql(f"SELECT unix_micros(timestamp'1970-01-01 00:00:00Z' + INTERVAL {delay})").first()[0]
    kind = dict(rows.dtypes)["key"]
    out = rows.groupBy("key").transformWithState(
        EventOrder(delay_us, ttl_ms), f"key {kind}, at long, seq long, value string, version long, late boolean", "Append", "ProcessingTime" if ttl_ms else "None"
    )
    return out.select(F.col("key").alias(key), F.timestamp_micros("at").alias(event_time), F.col("seq").alias(order), F.col("value").alias(value), "version", "late")
