"""The runtime plane as a stream (Z1-Z4): sessions with duplicates, conflicts, sequences and an explicit close.

State is kept for each session in maps of the state store: the checksum of each accepted observation_id and the highest sequence of each dataset,
which are read and written one by one, and the counters. A session ends by a row with ``closing``, or, by event time, when the watermark passes its first
event by its time to live; either gives its manifest and frees its state.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from weftline.operators.checkpoints import shared_folder

CLOSING = "struct<expected:bigint,drained:boolean,buffered:bigint,dropped:bigint>"
OUT = "session_id bigint, attempted bigint, accepted bigint, duplicates bigint, rejected bigint, last_sequence bigint, outcome string"
COUNTERS = "attempted bigint, accepted bigint, duplicates bigint, rejected bigint, last bigint, expires bigint"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Session(StatefulProcessor):
    """One session's rule; the same as ``operators.runtime.Judge``, against the state store."""

    def __init__(self, ttl_s: int) -> None:
        self.ttl_ms = ttl_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "observation_id string", "checksum string")
        self.high = handle.getMapState("high", "dataset string", "sequence bigint")
        self.counters = handle.getValueState("counters", COUNTERS)

    def _take(self, r: Row, old: bool, seen: dict, high: dict) -> int:
        """1 accepted, 2 duplicate, 3 rejected. seen, high: what these rows added, which the store gets at their end; old: whether it may know more."""
        known = seen.get(r.observation_id)
        if known is None and old:
            known = self.seen.getValue((r.observation_id,))
        if known is not None:
            return 2 if known[0] == r.checksum else 3
        last = high.get(r.dataset)
        if last is None and old:
            last = self.high.getValue((r.dataset,))
        if last is not None and r.sequence <= last[0]:
            return 3
        seen[r.observation_id], high[r.dataset] = (r.checksum,), (r.sequence,)
        return 1

    def _end(self, key: tuple, c: list, outcome: str, old: bool = True) -> Iterator[Row]:
        if old:
            if c[5] >= 0:
                self.handle.deleteTimer(c[5])
            for state in (self.seen, self.high, self.counters):
                state.clear()
        yield Row(session_id=key[0], attempted=c[0], accepted=c[1], duplicates=c[2], rejected=c[3], last_sequence=c[4], outcome=outcome)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        old = self.counters.exists()
        c = list(self.counters.get()) if old else [0, 0, 0, 0, -1, -1]
        seen: dict = {}
        high: dict = {}
        for r in sorted(rows, key=lambda r: (r.closing is not None, r.arrival)):
            if r.closing is not None:
                e = r.closing
                whole = e["drained"] and c[1] == e["expected"] and not c[3] and not e["buffered"] and not e["dropped"]
                yield from self._end(key, c, "COMPLETE" if whole else "INCOMPLETE", old)
                return
            if c[5] < 0:
                c[5] = max(int(r.observed_at.timestamp() * 1000) + self.ttl_ms, timerValues.getCurrentWatermarkInMs() + 1)
            c[0] += 1
            c[self._take(r, old, seen, high)] += 1
            c[4] = max(c[4], r.sequence)
        # what the session goes on with; one that began and ended in these rows has touched no state
        if not old and c[5] >= 0:
            self.handle.registerTimer(c[5])
        for state, added in ((self.seen, seen), (self.high, high)):
            for name, value in added.items():
                state.updateValue((name,), value)
        self.counters.update(tuple(c))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.counters.exists():
            c = list(self.counters.get())
            c[5] = -1  # this timer has gone off
            yield from self._end(key, c, "EXPIRED")

    def close(self) -> None:
        pass


def manifests(observations: DataFrame, delay: str = "1 hour", ttl_s: int = 3600) -> DataFrame:
    """A manifest for each session of a stream (session_id, arrival, sequence, dataset, observation_id, checksum, observed_at, closing).

    outcome is COMPLETE or INCOMPLETE on a close, EXPIRED when the watermark ends the session. The session must keep state in RocksDB.
    """
    if not 1 <= ttl_s <= 3600:
        raise ValueError("a session lives from 1 to 3600 seconds")
    marked = observations.withWatermark("observed_at", delay)
    return marked.groupBy("session_id").transformWithState(Session(ttl_s), OUT, "append", "eventTime")


def replay(rows: DataFrame) -> DataFrame:
    """Streams a table of observations and closings once through ``manifests``, in a folder of its own."""
    spark = rows.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows.write.parquet(f"{folder}/in")
    own = spark.newSession()  # so that the provider of state is set for this stream only
    for name in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        own.conf.set(name, spark.conf.get(name))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    stream = own.readStream.schema(rows.schema).parquet(f"{folder}/in")
    q = manifests(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(OUT).parquet(f"{folder}/out")


def deduplicated(observations: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Z2's simple case: the first of equal observations within the watermark."""
    return observations.withWatermark("observed_at", delay).dropDuplicatesWithinWatermark(["session_id", "observation_id", "checksum"])
