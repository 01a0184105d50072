"""Streams of files, turns and events (X1-X10, A32): Structured Streaming with state kept by key."""

from __future__ import annotations

import contextlib
import hashlib
import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from memgrid.operators.lifecycle import upserted


def latest(events: DataFrame, key: str = "path", at: str = "ts") -> DataFrame:
    """Of several events of a key in a batch the last."""
    # adds up on the way: a key with many events is no burden
    last = F.max_by(F.struct(*events.columns), F.struct(at, "action"))
    return events.groupBy(F.col(key).alias("__k")).agg(last.alias("e")).select("e.*")


def apply_changes(index: DataFrame, changes: DataFrame, key: str = "path") -> DataFrame:
    """An index after the last change of each key."""
    last = latest(changes, key)
    kept = index.join(last.where("action = 'delete'").select(key), key, "left_anti")
    return upserted(kept, last.where("action = 'upsert'").select(*index.columns), key)


def sync(source: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame], None], checkpoint: str, key: str = "path"):
    """Keeps an index up with a stream of changes; each micro-batch is one merge, so a replay changes nothing."""

    def batch(changes: DataFrame, _: int) -> None:
        write(apply_changes(read(), changes, key))

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# The process that sets state up is neither the driver nor an executor, and may not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: What keeps state that is larger than memory, and knows timers and times to live.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 24 * 3600 * 1000

PENDING = "conv_id long, from_turn long, to_turn long, rescan boolean"


def digest(*parts: str) -> str:
    return hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


class PendingTurns(StatefulProcessor):
    """The turns of a conversation above its mark.

    A conversation's mark is its last turn and a running hash of all turns up to there, of one size
    however long it gets. Digests of its turns are entries of their own, each read and written only
    if that turn comes, and forgotten after `recent` ms. A turn at or below the mark is let pass if it
    has the digest it had, or if the rows at hand hold the whole prefix and give its running hash;
    else the prefix is not what was seen, and all turns are pending again. The mark of a conversation
    that nothing came for in `ended` ms is forgotten.
    """

    def __init__(self, recent: int, ended: int):
        self.recent, self.ended = recent, ended

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mark = handle.getValueState("mark", "last long, turns long, prefix string", self.ended)
        self.turns = handle.getMapState("turns", "number long", "digest string", self.recent)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        got: dict[int, str] = {}
        for pdf in rows:
            for number, body in zip(pdf["number"], pdf["body"], strict=True):
                got[int(number)] = digest("" if body is None else str(body), "" if body is None else "x")
        if not got:
            return
        last, count, prefix = self.mark.get() if self.mark.exists() else (-1, 0, digest())
        below = sorted(n for n in got if n <= last)
        doubtful = [n for n in below if not (self.turns.containsKey((n,)) and self.turns.getValue((n,))[0] == got[n])]
        rescan = bool(doubtful) and not (len(below) == count and self.running(digest(), below, got) == prefix)
        new = sorted(n for n in got if n > last)
        for n in [*new, *doubtful]:
            self.turns.updateValue((n,), (got[n],))
        top = max([last, *new])
        if rescan:
            held = {int(k[0]): v[0] for k, v in self.turns.iterator()}
            whole = sorted(n for n in held if n <= top)
            count = max(count + len(new), len(whole))
            # where a digest has been forgotten the prefix is not known any more
            prefix = self.running(digest(), whole, held) if len(whole) == count else ""
        elif new:
            count += len(new)
            prefix = self.running(prefix, new, got) if prefix else ""
        self.mark.update((top, count, prefix))
        if new or rescan:
            yield pd.DataFrame({"conv_id": [key[0]], "from_turn": [0 if rescan else new[0]], "to_turn": [top], "rescan": [rescan]})

    @staticmethod
    def running(start: str, numbers: list[int], digests: dict[int, str]) -> str:
        for n in numbers:
            start = digest(start, str(n), digests[n])
        return start

    def close(self) -> None:
        pass


def pending_turns(turns: DataFrame, recent: int = 30 * DAY_MS, ended: int = 365 * DAY_MS) -> DataFrame:
    """For each conversation (turns: conv_id, number, body) and micro-batch the turns above its mark; see PendingTurns.

    rescan: a turn below the mark is new or has another text, so all turns are pending again.
    """
    turns.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return turns.select("conv_id", "number", "body").groupBy("conv_id").transformWithStateInPandas(PendingTurns(recent, ended), PENDING, "Update", "ProcessingTime")


def idle_sessions(events: DataFrame, gap: str = "60 minutes", late: str = "1 hour") -> DataFrame:
    """A session ends when nothing came for a while; late events are let in up to the watermark."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("events")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "events")


FIRED = "key string, at timestamp, fired long, reason string"


class Trigger(StatefulProcessor):
    """Adds up by key, and fires at a count or, if something is left by then, at the day's slot.

    Events count in the order of their times. One that comes after a slot finds it done: what was
    left at the slot fires first. A slot that no event passes is caught up with by a timer, once the
    watermark is there; so a run that was missed is made up for, and none is made twice.
    """

    def __init__(self, threshold: int, slot_ms: int):
        self.threshold, self.slot = threshold, slot_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("total", "total long, due long")

    def due(self, ms: int) -> int:
        """The first slot after a time."""
        return ((ms - self.slot) // DAY_MS + 1) * DAY_MS + self.slot

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = sorted((int(ms), int(n)) for pdf in rows for ms, n in zip(pdf["ms"], pdf["n"], strict=True))
        total, due = self.state.get() if self.state.exists() else (0, 0)
        registered, out = due, []
        for ms, n in events:
            if total and ms >= due:
                out.append((key[0], due, total, "time"))
                total = 0
            due = max(due, self.due(ms)) if total else self.due(ms)
            total += n
            if total >= self.threshold:
                out.append((key[0], ms, total, "count"))
                total = 0
        yield from self.told(out)
        if registered and registered != (due if total else 0):
            self.handle.deleteTimer(registered)
        if total and registered != due:
            self.handle.registerTimer(due)
        if total:
            self.state.update((total, due))
        elif registered:
            self.state.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            total, due = self.state.get()
            self.state.clear()
            yield from self.told([(key[0], due, total, "time")])

    def told(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            out = pd.DataFrame(rows, columns=["key", "at", "fired", "reason"])
            out["at"] = pd.to_datetime(out["at"], unit="ms")
            yield out

    def close(self) -> None:
        pass


def threshold_trigger(events: DataFrame, threshold: int = 30, late: str = "0 seconds", slot_hour: int = 3, slot_minute: int = 0) -> DataFrame:
    """Events (key, ts, n) to firings (key, at, fired, reason: count or time); see Trigger. Times are those of the session's zone UTC."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    df = events.select(F.col("key").cast("string").alias("key"), "ts", F.col("n").cast("long").alias("n")).withWatermark("ts", late).withColumn("ms", F.unix_millis("ts"))
    return df.groupBy("key").transformWithStateInPandas(Trigger(threshold, (slot_hour * 60 + slot_minute) * 60_000), FIRED, "Append", "EventTime")


def retained(events: DataFrame, late: str, keys: list[str]) -> DataFrame:
    """Each event once; what is older than the watermark is forgotten."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


@contextlib.contextmanager
def without_idle_batches(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside run batches only for new data. State with times to live asks for another batch for ever, so a run over what there is would not end."""
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drained(spark: SparkSession, df: DataFrame, folder: str, mode: str = "append", rows: str = "rows") -> DataFrame:
    """Runs a stream over what there is, writes its rows as Parquet to a folder that all executors share, and reads them.

    In update mode a batch's rows are those that changed; all of them are kept, and batches run for new data only.
    """
    out, marks = f"{folder}/{rows}", f"{folder}/checkpoint"
    if mode == "append":
        q = df.writeStream.format("parquet").option("path", out)
    else:
        q = df.writeStream.foreachBatch(lambda batch, k: batch.write.mode("overwrite").parquet(f"{out}/batch={k}"))
    q = q.option("checkpointLocation", marks).outputMode(mode).trigger(availableNow=True)
    with without_idle_batches(spark) if mode == "update" else contextlib.nullcontext():
        q = q.start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)
