"""Streams with state that ends: a cache whose entries expire, a status machine with time limits.

Both are stateful processors over event time. What an event finds is decided by the times in
the rows, so a replay gives what the live stream gave; timers only end state that no event
asks for again, and send stuck entities on. Rows of a key are taken in order of time inside a
batch and batch after batch; state lives in the RocksDB store of the query's checkpoint.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lexloom.operators.mutate import NEXT, REVERTS
from lexloom.operators.search import TTL

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def needs_rocks(spark: SparkSession) -> None:
    """Processors with timers and lists need this store; it is set where nothing else was chosen."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def in_order(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    rows = [b for b in batches if len(b)]
    return pd.concat(rows).sort_values(["at", "event_id"], kind="stable") if rows else pd.DataFrame()


def timed(out: DataFrame) -> DataFrame:
    """Times travel to and from the processors as microseconds, whatever the session's time zone."""
    return out.withColumn("ts", F.timestamp_micros("at")).drop("at")


def frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])


def only_timer(handle: StatefulProcessorHandle, micros: int | None) -> None:
    """One timer a key, at the first millisecond that is not before the time; None: no timer."""
    for t in list(handle.listTimers()):
        handle.deleteTimer(t[0] if isinstance(t, (tuple, list)) else t)
    if micros is not None:
        handle.registerTimer(-(-micros // 1000))


CACHE_OUT = "cache string, key string, event_id long, at long, hit boolean, value string"


class ExpiringCache(StatefulProcessor):
    """Per (cache, key) one entry (value, when it ends). ``put`` stores or replaces it, ``get`` finds it while it lives,
    ``drop`` removes it. A timer at its end removes an entry that nobody asked for again."""

    def __init__(self, ttl: dict[str, int]):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "value string, until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        cache, out = key[0], []
        entry = tuple(self.entry.get()) if self.entry.exists() else None
        had, now = entry, 1000 * timerValues.getCurrentWatermarkInMs()
        for r in in_order(rows).itertuples(index=False):
            at = r.at
            live = entry is not None and at < entry[1]
            if r.op == "put":
                entry = (r.value, at + 1_000_000 * self.ttl[cache])
            elif r.op == "drop" or not live:
                entry = None
            if r.op == "get":
                out.append((cache, key[1], r.event_id, at, live, entry[0] if live else None))
        if entry is not None and entry[1] <= now:
            entry = None  # late rows: its end is past already
        if entry != had:
            only_timer(self.handle, entry and entry[1])
            self.entry.clear() if entry is None else self.entry.update(entry)
        yield frame(out, CACHE_OUT)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.entry.clear()
        yield frame([], CACHE_OUT)

    def close(self) -> None:
        pass


def cached(stream: DataFrame, late: str = "1 hour", ttl: dict[str, int] | None = None) -> DataFrame:
    """Look-ups of a stream (cache, key, event_id, ts, op, value) of puts, gets and drops, each with whether it hit and what it found.

    ``ttl`` gives seconds by cache, those of the services by default; a cache without any is an error of its task.
    """
    needs_rocks(stream.sparkSession)
    x = stream.select("cache", "key", "event_id", "ts", F.unix_micros("ts").alias("at"), "op", "value").withWatermark("ts", late)
    return timed(x.groupBy("cache", "key").transformWithStateInPandas(ExpiringCache(ttl or TTL), CACHE_OUT, "append", "EventTime"))


#: Seconds that a stage under way may take before its entity goes on without a result.
LIMITS = {"ocr_processing": 3600, "segmentation_processing": 3600, "entity_extraction": 3600, "consolidation": 3600}
#: Statuses that end an entity's state.
FINAL = {"consolidated"}
STATUS_OUT = "entity_id long, at long, before string, status string, outcome string"


class StatusMachine(StatefulProcessor):
    """Per entity its status and since when. A step that the machine allows is taken, others are refused. A stage under way
    that outlasts its limit ends by itself: it goes back to the stage before, or fails, at the limit's time."""

    def __init__(self, limits: dict[str, int], final: set[str]):
        self.limits, self.final = limits, final

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("status", "status string, since long")

    def end(self, now: tuple | None) -> int | None:
        return now[1] + 1_000_000 * self.limits[now[0]] if now is not None and now[0] in self.limits else None

    def expire(self, entity: int, now: tuple) -> tuple[tuple, tuple]:
        """The status after the present one's limit, and the row that says so."""
        end = self.end(now)
        then = (REVERTS[now[0]][0] if now[0] in REVERTS else "failed", end)
        return then, (entity, end, now[0], then[0], "expired")

    def keep(self, now: tuple | None) -> None:
        only_timer(self.handle, self.end(now))
        self.state.clear() if now is None else self.state.update(now)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        now = tuple(self.state.get()) if self.state.exists() else None
        had = now
        for r in in_order(rows).itertuples(index=False):
            while (end := self.end(now)) is not None and end <= r.at:
                now, row = self.expire(key[0], now)
                out.append(row)
            before = None if now is None else now[0]
            allowed = before is None or r.status == "failed" or r.status in NEXT.get(before, [])
            out.append((key[0], r.at, before, r.status, "moved" if allowed else "refused"))
            if allowed:
                now = None if r.status in self.final else (r.status, r.at)
        if now != had:
            self.keep(now)
        yield frame(out, STATUS_OUT)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out, now = [], tuple(self.state.get()) if self.state.exists() else None
        while (end := self.end(now)) is not None and end <= 1000 * expiredTimerInfo.getExpiryTimeInMs():
            now, row = self.expire(key[0], now)
            out.append(row)
        if out:
            self.keep(now)
        yield frame(out, STATUS_OUT)

    def close(self) -> None:
        pass


def status_changes(stream: DataFrame, late: str = "1 hour", limits: dict[str, int] | None = None, final: set[str] | None = None) -> DataFrame:
    """What becomes of every status of a stream (entity_id, event_id, ts, status): moved or refused; and the steps that no row
    asked for, of stages beyond their limit. State is one row an entity under way and ends with a final status."""
    needs_rocks(stream.sparkSession)
    x = stream.select("entity_id", "event_id", "ts", F.unix_micros("ts").alias("at"), "status").withWatermark("ts", late)
    machine = StatusMachine(LIMITS if limits is None else limits, FINAL if final is None else final)
    return timed(x.groupBy("entity_id").transformWithStateInPandas(machine, STATUS_OUT, "append", "EventTime"))


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs what is there now into a Parquet table whose own log of committed files makes reruns agree."""
    query = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
