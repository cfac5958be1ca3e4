"""The timeout sweep as a stream: documents in process are held in state, and a timer tells when one has taken too long.

Documents are keyed by slots of their id. A slot's state holds only what is in process, so completed documents are never read
again, and a slot is small when there are enough of them. In event time (for replays and tests) the watermark is the clock, in
processing time the machine's. Both timers sweep a slot as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .delivery import STATE_STORE

PROCESSING = "processing"


class Sweep(StatefulProcessor):
    """The documents in process of one slot."""

    def __init__(self, minutes: int, event_time: bool) -> None:
        self.allowed, self.event_time = minutes * 60_000_000, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "doc_id long, since_us long")

    def _now(self, timerValues) -> int:
        return 1000 * (timerValues.getCurrentWatermarkInMs() if self.event_time else timerValues.getCurrentProcessingTimeInMs())

    def _keep(self, open_: dict[int, int]) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if open_:
            self.open.put(list(open_.items()))
            self.handle.registerTimer((min(open_.values()) + self.allowed) // 1000 + 1)
        else:
            self.open.clear()

    def _held(self) -> dict[int, int]:
        return dict(self.open.get()) if self.open.exists() else {}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        open_ = self._held()
        for part in rows:
            for doc_id, status, at in part.sort_values("at_us")[["doc_id", "status", "at_us"]].itertuples(index=False):
                if status == PROCESSING:
                    open_[int(doc_id)] = int(at)
                elif at >= open_.get(int(doc_id), at):
                    open_.pop(int(doc_id), None)
        self._keep(open_)
        yield pd.DataFrame({"doc_id": pd.Series([], dtype="int64"), "since_us": pd.Series([], dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, now = self._held(), self._now(timerValues)
        late = {d: s for d, s in held.items() if s + self.allowed < now}
        self._keep({d: s for d, s in held.items() if d not in late})
        yield pd.DataFrame({"doc_id": pd.Series(list(late), dtype="int64"), "since_us": pd.Series(list(late.values()), dtype="int64")})

    def close(self) -> None:
        pass


def swept(changes: DataFrame, minutes: int, slots: int = 256, event_time: bool = False) -> DataFrame:
    """(doc_id, started_at) of a stream of changes (doc_id, status, at): what was in process for longer than allowed, once each."""
    changes.sparkSession.conf.set(*STATE_STORE)  # timers need it
    if event_time:
        changes = changes.withWatermark("at", "0 seconds")
    keyed = changes.where("doc_id is not null and at is not null").select("doc_id", "status", "at", F.unix_micros("at").alias("at_us"), F.pmod(F.xxhash64("doc_id"), F.lit(slots)).alias("slot"))
    mode = "EventTime" if event_time else "ProcessingTime"
    late = keyed.groupBy("slot").transformWithStateInPandas(Sweep(minutes, event_time), "doc_id long, since_us long", "append", mode)
    return late.select("doc_id", F.timestamp_micros("since_us").alias("started_at"))
