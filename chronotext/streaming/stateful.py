"""Keyed streaming state with timers and expiry: retry backoff, the merge grace of a session's siblings, stable files.

Each operator gives the same rows however the stream is cut into micro-batches, as long as the rows of a key come in their order: what
a timer would have told before the next row of its key is told with that row. Times are event time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chronotext.sources.shared import with_conf

# Seconds to wait after the n-th failure, for real errors and for files that are still being written.
BACKOFF, INCOMPLETE_BACKOFF = (30, 60, 120, 300, 600, 1800), (15, 30, 60)

#: transformWithState keeps its state in this store only.
ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class Backoff(StatefulProcessor):
    """One path's failures. A sighting before the time to retry is deferred, unless the file's size or mtime has changed, which clears the state, as
    a success does. A timer tells when the retry is due; FORGET seconds later a path that was not seen again leaves the store."""

    FORGET = 86_400
    SCHEMA = "path string, at_sec long, outcome string, failures int, retry_at long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("backoff", "failures int, retry_at long, size long, mtime long, told boolean, timer long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        kept = self.state.get()
        failures, retry_at, size, mtime, told, timer = kept or (0, None, None, None, False, None)
        told_row = lambda *r: Row(path=key[0], at_sec=r[0], outcome=r[1], failures=r[2], retry_at=r[3])
        for at, s, m, ok, incomplete in sorted((r["at"], r["size"], r["mtime"], r["ok"], r["incomplete"]) for r in rows):
            if failures and not told and retry_at <= at:
                yield told_row(retry_at, "due", failures, retry_at)
                told = True
            if failures and (s, m) != (size, mtime):
                failures, told = 0, False
            if failures and at < retry_at:
                yield told_row(at, "deferred", failures, retry_at)
                continue
            if ok:
                failures, retry_at, told = 0, None, False
                yield told_row(at, "ok", 0, None)
                continue
            table = INCOMPLETE_BACKOFF if incomplete else BACKOFF
            failures, size, mtime, told = failures + 1, s, m, False
            retry_at = at + table[min(failures, len(table)) - 1]
            yield told_row(at, "failed", failures, retry_at)
        due = 1000 * (retry_at + (self.FORGET if told else 0)) if failures else None
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if due is not None:
            if timer != due:
                self.handle.registerTimer(due)
            self.state.update((failures, retry_at, size, mtime, told, due))
        elif kept:
            self.state.clear()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if kept := self.state.get():
            failures, retry_at, size, mtime, told, _ = kept
            if told:  # nothing came of it for a long time
                self.state.clear()
            else:
                due = 1000 * (retry_at + self.FORGET)
                self.handle.registerTimer(due)
                self.state.update((failures, retry_at, size, mtime, True, due))
                yield Row(path=key[0], at_sec=retry_at, outcome="due", failures=failures, retry_at=retry_at)

    def close(self) -> None:
        pass


def backoff_stream(sightings: DataFrame, run, delay: str = "0 seconds"):
    """run(outcomes of each sighting and of each retry that comes due). sightings: path string, seen timestamp, size, mtime (long), ok, incomplete
    (what an attempt would give); null flags are false, null sizes and times 0. State and timers are kept by transformWithState."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    whole = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c)
    rows = sightings.withWatermark("seen", delay).where(F.col("seen").isNotNull()).select("path", "seen", F.unix_seconds("seen").alias("at"), whole("size"), whole("mtime"), flag("ok"), flag("incomplete"))
    out = rows.groupBy("path").transformWithState(Backoff(), Backoff.SCHEMA, "Append", "EventTime")
    return with_conf(sightings.sparkSession, ROCKS, lambda: run(out))


def merge_grace(arrivals: DataFrame, delay: str = "0 seconds", forget_seconds: int = 86_400) -> DataFrame:
    """Sessions held back until no sibling can be expected any more. arrivals: session_id, sibling_key (course and slot), seen (timestamp), deadline
    (timestamp, the slot's end and the grace; null without a slot).

    A row for each session: outcome ``at_once`` (no slot, or it arrives at or after the deadline and is the first of its group), ``late`` (it arrives at or
    after the deadline of siblings that are out already) or ``released`` (held until the deadline), released_at, and parts, the siblings released
    together. Siblings share a deadline. Rows whose ``seen`` is behind the watermark are dropped and counted by Spark
    (numRowsDroppedByWatermark). A released group leaves the store forget_seconds after its deadline."""

    def release(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, out_already, until = state.get if state.exists else ([], 0, None)
        held, out = list(held), []

        def let_go() -> None:
            nonlocal held, out_already
            out.extend((s, "released", until, len(held)) for s in held)
            out_already, held = out_already + len(held), []

        if state.hasTimedOut:
            if not held:
                state.remove()
                return
            let_go()
        else:
            rows = pd.concat(list(batches)).sort_values(["at", "session_id"])
            for s, at, limit in zip(rows["session_id"], rows["at"], rows["until"], strict=True):
                if limit != limit or limit is None:
                    out.append((int(s), "at_once", int(at), 1))
                    continue
                until = int(limit)
                if at < until:
                    held.append(int(s))
                    continue
                if held:
                    let_go()
                out.append((int(s), "late" if out_already else "at_once", int(at), 1))
                out_already += 1
        if until is not None:
            state.update((held, out_already, until))
            due = 1000 * (until if held else until + forget_seconds)
            if due > state.getCurrentWatermarkMs():
                state.setTimeoutTimestamp(due)
            elif held:  # the watermark has passed the deadline already
                let_go()
                state.update((held, out_already, until))
                state.setTimeoutTimestamp(max(1000 * (until + forget_seconds), state.getCurrentWatermarkMs() + 1))
            else:
                state.remove()
        if out:
            yield pd.DataFrame(out, columns=["session_id", "outcome", "released_at", "parts"])

    rows = arrivals.withWatermark("seen", delay).where(F.col("seen").isNotNull()).select("session_id", "sibling_key", "seen", F.unix_seconds("seen").alias("at"), F.unix_seconds("deadline").cast("double").alias("until"))
    # rows without a slot wait for nobody: each is a group of its own, so none of them is hot
    rows = rows.withColumn("sibling_key", F.when(F.col("until").isNull(), F.concat(F.lit("-"), F.col("session_id").cast("string"))).otherwise(F.concat(F.lit("+"), F.col("sibling_key").cast("string"))))
    return rows.groupBy("sibling_key").applyInPandasWithState(release, "session_id long, outcome string, released_at long, parts int", "held array<long>, out_already int, until long", "append", GroupStateTimeout.EventTimeTimeout)


def stable_files(samples: DataFrame, checks: int = 2, quiet_seconds: float = 10.0, forget_seconds: float = 3600.0, delay: str = "0 seconds") -> DataFrame:
    """path, size, mtime, seen (seconds) of each version of a file that is found stable: its last `checks` samples that were taken quiet_seconds or more
    after its mtime agree, and it can be read. samples: path, size, mtime (seconds), seen (timestamp), readable.

    A sample within the quiet time is not counted. A path that is not sampled for forget_seconds has vanished: its state leaves the store, and it starts
    afresh if it comes back. That holds for a gap within a batch as well."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        nothing = (-1, -1.0, 0, False)
        size, mtime, n, told, last = state.get if state.exists else (*nothing, None)
        rows = pd.concat(list(batches)).sort_values(["at", "size", "mtime"])
        out = []
        for s, m, at, readable in zip(rows["size"], rows["mtime"], rows["at"], rows["readable"], strict=True):
            if last is not None and at - last > forget_seconds:
                size, mtime, n, told = nothing
            last = float(at)
            if at - m < quiet_seconds:
                continue
            n, told = (n + 1, told) if (s, m) == (size, mtime) else (1, False)
            size, mtime = int(s), float(m)
            if not told and n >= checks and readable:
                out.append((key[0], size, mtime, float(at)))
                told = True
        state.update((size, mtime, min(n, checks), told, last))
        state.setTimeoutTimestamp(max(int(1000 * (last + forget_seconds)), state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["path", "size", "mtime", "seen"])

    rows = samples.withWatermark("seen", delay).where(F.col("seen").isNotNull()).select("path", "seen", F.col("size").cast("long").alias("size"), F.col("mtime").cast("double").alias("mtime"), F.unix_millis("seen").cast("double").alias("at"), F.coalesce("readable", F.lit(False)).alias("readable"))
    rows = rows.withColumn("at", F.col("at") / 1000).fillna({"size": 0, "mtime": 0.0})
    return rows.groupBy("path").applyInPandasWithState(update, "path string, size long, mtime double, seen double", "size long, mtime double, n int, told boolean, last double", "append", GroupStateTimeout.EventTimeTimeout)
