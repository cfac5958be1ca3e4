"""Delivery of events to webhooks as a stream: attempts with growing waits, kept in state and woken by timers.

Events are signed with their webhook's own secret before they enter the state, so no secret is kept there. Deliveries are keyed
by webhook and slot (a hash of the event), so a webhook that gets a third of all events is as many keys as there are slots. A
key's state holds the deliveries that wait: their attempts and when the next one is due, up to TOGETHER in one value, as each value is
a message between Spark and the Python process; new ones come PACKED to a row, for the same reason. Those due are sent when they arrive or when the key's timer rings; one that fails
waits twice as long as before, up to a day, and is given up after `most` attempts. Choose `slots` so that what a receiver misses
in a long outage is many small lists.

State and timers are in the checkpoint: after a restart what was delivered isn't sent again, what waits still is. A batch that fails
half-way is repeated with the same event ids, so a receiver may see an event twice, never zero times; the ledger has each attempt once.
It is stored with a row for all attempts of a key that ended alike at one time, up to OUT of them; `ledger` gives a row for each.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.keys import unseal

DELIVERED, RETRY, FAILED = "delivered", "retry", "failed"
DAY_MS = 86_400_000
LEDGER = "webhook_id string, event_ids array<string>, status string, attempts int, last_error string, wait_ms long, created_at timestamp"
WAITING, TOGETHER = "due_ms long, packed string", 400  # packed: a list of (event_id, url, payload, signature, attempts) as JSON
PACKED, HELD, OUT = 16, 50_000, 10_000  # deliveries of a row, those that are packed at once, and attempts that are made at once
PACKS = "webhook_id string, slot long, url string, event_id array<string>, payload array<string>, signature array<string>"
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

Send = Callable[[str, str, dict[str, str]], str | None]


def signed(events: DataFrame, webhooks: DataFrame, keys: DataFrame, few: int = 10_000) -> DataFrame:
    """(webhook_id, event_id, url, payload, signature): a delivery for each webhook (id, url, events, secret_ciphertext) that asks for an event's type.

    `keys` (key) is one row with the key that the secrets are sealed with; it comes as a table, so that no plan shows it. Events are
    dealt out by their ids before they meet the webhooks, as they are few bytes then and come in as few tasks as there are files.
    """
    import hashlib

    @F.pandas_udf("inner binary, outer binary")
    def pads(secret: pd.Series) -> pd.DataFrame:
        """What HMAC-SHA256 puts before the text and before its digest."""
        keys = [s.encode() for s in secret]
        keys = [(hashlib.sha256(k).digest() if len(k) > 64 else k).ljust(64, b"\0") for k in keys]
        return pd.DataFrame({"inner": [bytes(c ^ 0x36 for c in k) for k in keys], "outer": [bytes(c ^ 0x5C for c in k) for k in keys]})

    one = webhooks.select("id", "url", "events", "secret_ciphertext").crossJoin(F.broadcast(keys.select("key")))  # one row
    known = one.select(F.col("id").alias("webhook_id"), "url", "events", pads(unseal(F.col("secret_ciphertext"), F.col("key"))).alias("pad"))
    asked = known.select("webhook_id", "url", "pad", F.explode("events").alias("event_type"))
    hooks = F.broadcast(asked) if webhooks.select(F.explode("events")).count() <= few else asked
    due = events.repartition("event_id").join(hooks, "event_type").withColumn("payload", F.coalesce("payload", F.lit("")))
    digest = F.sha2(F.concat("pad.outer", F.unhex(F.sha2(F.concat("pad.inner", F.col("payload").cast("binary")), 256))), 256)
    return due.select("webhook_id", F.col("event_id").cast("string").alias("event_id"), "url", "payload", F.concat(F.lit("sha256="), digest).alias("signature"))


class Deliveries(StatefulProcessor):
    """The attempts of one webhook's slot."""

    def __init__(self, send: Send, first_ms: int, most: int, header: str) -> None:
        self.send, self.first_ms, self.most, self.header = send, first_ms, most, header

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)

    def _attempted(self, hook: str, due: list, now: int, open_: dict[int, list]) -> pd.DataFrame:
        """An attempt of each; those that are tried again go to open_, by the time when they are due."""
        send, header = self.send, self.header
        good: dict[int, list[str]] = {}  # by attempts
        ended: dict[tuple[int, str], list] = {}
        for event_id, url, payload, signature, attempts in due:
            attempts += 1
            error = send(url, payload, {header: signature, "x-event-id": event_id, "x-attempt": str(attempts)})
            if error is None:
                good.setdefault(attempts, []).append(event_id)
            else:
                ended.setdefault((attempts, error), []).append((event_id, url, payload, signature, attempts))
        rows = [(hook, ids, DELIVERED, attempts, None, None) for attempts, ids in good.items()]
        for (attempts, error), alike in ended.items():
            wait = None
            if attempts < self.most:
                wait = min(self.first_ms * 2 ** (attempts - 1), DAY_MS)
                open_.setdefault(now + wait, []).extend(alike)
            rows.append((hook, [d[0] for d in alike], FAILED if wait is None else RETRY, attempts, error, wait))
        out = pd.DataFrame(rows, columns=["webhook_id", "event_ids", "status", "attempts", "last_error", "wait_ms"])
        out["created_at"] = pd.Timestamp(now, unit="ms")
        return out.astype({"wait_ms": "Int64", "attempts": "int32", "last_error": "object", "created_at": "datetime64[ns]"})

    def _packed(self, open_: dict[int, list], least: int) -> list[tuple[int, str]]:
        """Values of the state, taken from open_ as long as so many are due together; their timers are set."""
        out = []
        for due in open_:
            while len(open_[due]) >= least:
                out.append((due, json.dumps(open_[due][:TOGETHER])))
                del open_[due][:TOGETHER]
                self.handle.registerTimer(due)
        return out

    def _waiting(self) -> list[tuple[int, str]]:
        return list(self.waiting.get()) if self.waiting.exists() else []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now, open_ = timerValues.getCurrentProcessingTimeInMs(), {}
        known = {d[0] for _, packed in self._waiting() for d in json.loads(packed)}
        step = max(1, OUT // PACKED)
        for part in rows:
            for at in range(0, len(part), step):
                some = part.iloc[at : at + step]
                ids, payloads, signatures = (list(chain.from_iterable(some[n])) for n in ("event_id", "payload", "signature"))
                urls = chain.from_iterable(repeat(u, len(e)) for u, e in zip(some["url"], some["event_id"]))
                new = list(zip(ids, urls, payloads, signatures, repeat(0)))
                fresh = dict.fromkeys(ids)
                if len(fresh) < len(ids) or not known.isdisjoint(fresh):  # some wait already, or came twice
                    first = {d[0]: d for d in reversed(new) if d[0] not in known}
                    new = [first[i] for i in fresh if i in first]
                known.update(fresh)
                yield self._attempted(key[0], new, now, open_)
                if full := self._packed(open_, TOGETHER):
                    self.waiting.appendList(full)
        if rest := self._packed(open_, 1):
            self.waiting.appendList(rest)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, open_, kept, old = timerValues.getCurrentProcessingTimeInMs(), {}, [], []
        for due, packed in self._waiting():
            if due > now:
                kept.append((due, packed))  # it has a timer of its own
                continue
            old += json.loads(packed)
            if len(old) >= OUT:
                yield self._attempted(key[0], old, now, open_)
                kept, old = kept + self._packed(open_, TOGETHER), []
        yield self._attempted(key[0], old, now, open_)
        kept += self._packed(open_, 1)
        if kept:
            self.waiting.put(kept)
        else:
            self.waiting.clear()

    def close(self) -> None:
        pass


def _groups(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Deliveries of one webhook, url and slot together, at most PACKED in a row."""
    rows = pa.Table.from_batches(held).combine_chunks()
    code = rows["slot"].to_numpy().astype(np.int64)
    for name in ("webhook_id", "url"):
        own = pc.dictionary_encode(rows[name].combine_chunks(), null_encoding="encode")
        code = code * max(1, len(own.dictionary)) + own.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    rows, code = rows.take(pa.array(order)).combine_chunks(), code[order]
    heads = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    ends = np.append(heads[1:], len(code))
    starts = np.concatenate([np.arange(a, b, PACKED) for a, b in zip(heads.tolist(), ends.tolist())])
    offsets = pa.array(np.append(starts, len(code)).astype(np.int32))
    first = rows.take(pa.array(starts)).combine_chunks()
    one = [first[n].combine_chunks() for n in ("webhook_id", "slot", "url")]
    many = [pa.ListArray.from_arrays(offsets, rows[n].combine_chunks()) for n in ("event_id", "payload", "signature")]
    return pa.RecordBatch.from_arrays(one + many, names=["webhook_id", "slot", "url", "event_id", "payload", "signature"])


def packs(due: DataFrame, slots: int) -> DataFrame:
    """The deliveries of each task, those of one webhook and slot packed into rows; a row costs the state's Python process far more than a delivery."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= HELD:
                yield _groups(held)
                held, n = [], 0
        if n:
            yield _groups(held)

    keyed = due.select("webhook_id", F.pmod(F.xxhash64("event_id"), F.lit(slots)).cast("long").alias("slot"), "url", "event_id", "payload", "signature")
    return keyed.mapInArrow(run, PACKS)


def start(due: DataFrame, sink: str, checkpoint: str, send: Send, first_ms: int = 30_000, most: int = 8, slots: int = 64, header: str = "x-signature", every: str = "0 seconds") -> StreamingQuery:
    """Deliver a stream of signed deliveries; the ledger grows below `sink`, a directory for each batch, so a repeated one replaces itself."""
    spark = due.sparkSession
    spark.conf.set(*STATE_STORE)  # timers need it

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    attempts = packs(due, slots).groupBy("webhook_id", "slot").transformWithStateInPandas(Deliveries(send, first_ms, most, header), LEDGER, "append", "ProcessingTime")
    return attempts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def stored(spark: SparkSession, sink: str) -> DataFrame:
    """The ledger as it is stored: (webhook_id, event_ids, status, attempts, last_error, wait_ms, created_at)."""
    return spark.read.schema(LEDGER).parquet(sink)


def ledger(spark: SparkSession, sink: str) -> DataFrame:
    """(webhook_id, event_id, status, attempts, last_error, wait_ms, created_at): a row for each attempt."""
    return stored(spark, sink).select("webhook_id", F.explode("event_ids").alias("event_id"), "status", "attempts", "last_error", "wait_ms", "created_at")


def settle(stream: StreamingQuery, spark: SparkSession, sink: str, patience: float = 600) -> None:
    """Wait until all that came is delivered or given up, then stop; give up if nothing happened for `patience` seconds, however long all of
    it takes. A service doesn't wait; it leaves the stream running.
    """
    seen, before, since = None, None, time.time()
    while stream.isActive:
        time.sleep(0.3)
        progress = stream.lastProgress
        if progress is None or progress.timestamp == seen:
            if not stream.status["isTriggerActive"] and time.time() - since > patience:
                break
            continue
        seen = progress.timestamp
        if progress.numInputRows:  # there may be more; a batch without rows has read all
            since = time.time()
            continue
        # each delivery has one first attempt, and one that ended it
        many = F.size("event_ids").cast("long")
        counts = {"begun": F.col("attempts") == 1, "ended": F.col("status") != RETRY, "n": F.lit(True)}
        now = stored(spark, sink).agg(*[F.coalesce(F.sum(F.when(kind, many)), F.lit(0)).alias(name) for name, kind in counts.items()]).first()
        if now["begun"] == now["ended"]:
            stream.stop()
            return
        if now != before:
            before, since = now, time.time()
        elif time.time() - since > patience:
            break
    error = stream.exception()
    stream.stop()
    raise RuntimeError(f"deliveries not settled: {error}")
