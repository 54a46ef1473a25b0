"""Streaming forms of landing and daily counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: Setting of a session that runs keyed state.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def landing_dedup(payloads: DataFrame, delay: str = "1 day") -> DataFrame:
    """First sighting of each (source, ref, content hash) within the watermark."""
    hashed = payloads.withColumn("content_hash", F.sha2("payload", 256)).withWatermark("fetched_at", delay)
    return hashed.dropDuplicatesWithinWatermark(["source_id", "external_ref", "content_hash"])


def event_daily(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Counts by day and name; rows later than the watermark are dropped."""
    out = events.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), "name").agg(F.count("*").alias("n"))
    return out.select(F.to_date("window.start").alias("day"), "name", "n")


class Liveness(StatefulProcessor):
    """Keyed state of one posting: when it was last proved live and when it expired; a timer expires what stays silent."""

    def __init__(self, silent_ms: int):
        self.silent_ms = silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "verified_us long, expired_us long")

    def _row(self, key: tuple, verified: int | None, expired: int | None) -> pd.DataFrame:
        self.seen.update((verified, expired))
        return pd.DataFrame({"source_id": [key[0]], "external_ref": [key[1]], "verified_us": pd.array([verified], "Int64"), "expired_us": pd.array([expired], "Int64")})

    def _timer(self, at_us: int | None) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if at_us is not None:
            self.handle.registerTimer(at_us // 1000 + self.silent_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        verified, expired = self.seen.get() if self.seen.exists() else (None, None)
        told = pd.concat(list(rows)).sort_values(["at", "observation"])
        told = told[told["observation"] != "UNKNOWN"]
        if told.empty:
            return
        for at, kind in zip(told["at"], told["observation"]):
            micros = at.value // 1000
            verified, expired = (micros, None) if kind == "LIVE" else (verified, micros)
        self._timer(verified if expired is None else None)
        yield self._row(key, verified, expired)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        verified, expired = self.seen.get()
        if expired is None:
            yield self._row(key, verified, expiredTimerInfo.getExpiryTimeInMs() * 1000)

    def close(self) -> None:
        pass


def liveness_state(observed: DataFrame, delay: str = "1 day", silent_days: int = 30) -> DataFrame:
    """Freshness of each (source_id, external_ref) as keyed state, a row per batch that changed it.

    observed: source_id, external_ref, observation, at. LIVE sets
    last_verified and clears expired_at, GONE expires as of the check,
    UNKNOWN changes nothing. Rows of one batch count in order of time. A live
    posting that nothing confirms for silent_days expires then, once the
    watermark has passed that day. The query must be started with the RocksDB
    state store (STATE_STORE).
    """
    source = dict(observed.dtypes)["source_id"]
    out = (
        observed.withWatermark("at", delay)
        .groupBy("source_id", "external_ref")
        .transformWithStateInPandas(
            Liveness(silent_days * 86_400_000), f"source_id {source}, external_ref string, verified_us long, expired_us long", "append", "EventTime"
        )
    )
    return out.select("source_id", "external_ref", F.timestamp_micros("verified_us").alias("last_verified"), F.timestamp_micros("expired_us").alias("expired_at"))


def ingest(postings: DataFrame, checkpoint: str, batch: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Run a batch job over whatever has landed since the last run; the checkpoint remembers what was taken."""
    return postings.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
