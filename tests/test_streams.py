"""Stateful streams: the same rows however they are cut, timers, expiry, restarts."""

import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chronotext.sources.shared import file_system, shared_dir, with_conf
from chronotext.streaming import ingest, progress, stateful

ROCKS = stateful.ROCKS


def feed(spark, folder, batches, schema):
    """A stream that takes one of the batches at a time."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{k}")
        for name in os.listdir(f"{folder}/{k}"):
            os.utime(f"{folder}/{k}/{name}", (1_700_000_000 + 10 * k,) * 2)
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(str(folder))


def run(out, folder):
    """(rows, what the last trigger says of the state)"""
    q = out.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    state = q.lastProgress["stateOperators"]
    return sorted(tuple(r) for r in out.sparkSession.read.schema(out.schema).parquet(f"{folder}/rows").collect()), state


def split(rows, n, at=0):
    rows = sorted(rows, key=lambda r: r[at])
    return [rows[k * len(rows) // n : (k + 1) * len(rows) // n] for k in range(n)]


# ---- retry backoff ----

SIGHT = "path string, at_s long, size long, mtime long, ok boolean, incomplete boolean"


def backoff(spark, tmp, batches):
    looks = feed(spark, tmp / "in", batches, SIGHT).withColumn("seen", F.timestamp_seconds("at_s"))
    return stateful.backoff_stream(looks, lambda out: run(out, tmp))


def plain_backoff(sightings, end):
    """Every outcome by a loop over a path's sightings; end: the last watermark."""
    out, state = [], {}
    due = lambda p, f, r: out.append((p, r, "due", f, r))
    for p, at, size, mtime, ok, inc in sorted(sightings, key=lambda r: r[1]):
        fails, retry, sign, told = state.get(p, (0, 0, None, True))
        if fails and not told and retry <= at:
            due(p, fails, retry)
            told = True
        if fails and sign != (size, mtime):
            fails = 0
        if fails and at < retry:
            out.append((p, at, "deferred", fails, retry))
        elif ok:
            fails = 0
            out.append((p, at, "ok", 0, None))
        else:
            table = (15, 30, 60) if inc else (30, 60, 120, 300, 600, 1800)
            fails, told = fails + 1, False
            retry, sign = at + table[min(fails, len(table)) - 1], (size, mtime)
            out.append((p, at, "failed", fails, retry))
        state[p] = (fails, retry, sign, told)
    for p, (fails, retry, _, told) in state.items():
        if fails and not told and retry <= end:
            due(p, fails, retry)
    return sorted(out, key=repr)


def test_backoff_timers_any_cut(spark, tmp_path):
    rng = random.Random(3)
    looks = [(f"f{rng.randint(0, 6)}", 1000 + 13 * k + rng.randint(0, 9), rng.randint(1, 2) if rng.random() < 0.2 else 1, 5, rng.random() < 0.15, rng.random() < 0.4) for k in range(160)]
    want = plain_backoff(looks, max(r[1] for r in looks))
    for n in (1, 4):
        got, _ = backoff(spark, tmp_path / str(n), split(looks, n, 1))
        assert sorted(got, key=repr) == want
    assert {r[2] for r in want} == {"due", "deferred", "ok", "failed"}


def test_backoff_of_attempts_is_backoff_state(spark, tmp_path):
    """Attempts that wait for their time: the stream's last word on each file is the batch fold's."""
    rng = random.Random(4)
    tries = [(f"f{p}", 2000 * k + p, 1 + (k // 3) * (p % 2), 7, rng.random() < 0.2, rng.random() < 0.5) for k in range(9) for p in range(8)]
    got, _ = backoff(spark, tmp_path, split(tries, 2, 1))
    last = {p: (f, r) for p, at, what, f, r in sorted(got, key=lambda r: r[1]) if what in ("ok", "failed")}
    fold = ingest.backoff_state(spark.createDataFrame([(p, at, s, float(m), ok, i) for p, at, s, m, ok, i in tries], "path string, at long, size long, mtime double, ok boolean, incomplete boolean"))
    assert {p: v for p, v in last.items() if v[0]} == {r.path: (r.failures, r.retry_at) for r in fold.collect()}


def test_backoff_forgets_vanished_paths(spark, tmp_path):
    day = stateful.Backoff.FORGET
    looks = [[("gone", 100, 1, 1, False, False)], [("other", 500, 1, 1, True, False)], [("other", 600 + day, 1, 1, True, False)]]
    got, state = backoff(spark, tmp_path, looks)
    assert ("gone", 130, "due", 1, 130) in got
    assert state[0]["numRowsTotal"] == 0


# ---- merge grace ----

ARRIVAL = "session_id long, sibling_key string, seen_s long, deadline_s long, outcome string"


def grace(spark, tmp, batches, **how):
    rows = feed(spark, tmp / "in", batches, ARRIVAL).withColumn("seen", F.timestamp_seconds("seen_s")).withColumn("deadline", F.timestamp_seconds("deadline_s"))
    return run(stateful.merge_grace(rows, **how), tmp)


def test_merge_grace_both_sides_of_the_limit(spark, tmp_path):
    rows = [(1, "a", 100, 900, "x"), (2, "a", 899, 900, "x"), (3, "a", 900, 900, "x"), (4, "b", 950, 900, "x"), (5, "c", 960, None, "x"), (6, None, 970, None, "x"), (7, "d", 980, 5000, "x"), (8, "a", 1500, 900, "x")]
    want = [(1, "released", 900, 2), (2, "released", 900, 2), (3, "late", 900, 1), (4, "at_once", 950, 1), (5, "at_once", 960, 1), (6, "at_once", 970, 1), (8, "late", 1500, 1)]
    for n in (1, 3, 8):  # 7 is held still
        got, state = grace(spark, tmp_path / str(n), split(rows, n, 2))
        assert got == want
        assert state[0]["numRowsTotal"] >= 1


def test_merge_grace_late_rows_and_expiry(spark, tmp_path):
    """A row behind the watermark is dropped and counted; a group leaves the store once it can't have siblings any more."""
    batches = [[(1, "a", 100, 900, "x")], [(2, "z", 2000, None, "x")], [(5, "w", 2100, None, "x")], [(3, "a", 200, 900, "x"), (4, "y", 9000, None, "x")]]
    rows = feed(spark, tmp_path / "in", batches, ARRIVAL).withColumn("seen", F.timestamp_seconds("seen_s")).withColumn("deadline", F.timestamp_seconds("deadline_s"))
    out = stateful.merge_grace(rows, forget_seconds=3600)
    q = out.writeStream.format("parquet").option("path", f"{tmp_path}/rows").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r[0] for r in spark.read.schema(out.schema).parquet(f"{tmp_path}/rows").collect()}
    assert got == {1, 2, 4, 5}
    assert sum(op["numRowsDroppedByWatermark"] for p in q.recentProgress for op in p["stateOperators"]) == 1
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 0


# ---- stable files ----

SAMPLE = "path string, size long, mtime double, seen_s long, readable boolean"


def stable(spark, tmp, batches, **how):
    rows = feed(spark, tmp / "in", batches, SAMPLE).withColumn("seen", F.timestamp_seconds("seen_s"))
    return run(stateful.stable_files(rows, **how), tmp)


def test_stable_files_rules(spark, tmp_path):
    rows = [
        *(("quiet", 5, 0.0, t, True) for t in (3, 9, 10, 20, 30)),  # the first two are within the quiet time: stable at 20
        *(("grows", t, 0.0, t, True) for t in (15, 25, 35)),
        ("locked", 1, 0.0, 15, True), ("locked", 1, 0.0, 25, False), ("locked", 1, 0.0, 35, True),
        ("again", 1, 0.0, 15, True), ("again", 1, 0.0, 25, True), ("again", 2, 20.0, 35, True), ("again", 2, 20.0, 45, True),
        ("unsure", 1, 0.0, 16, None), ("unsure", 1, 0.0, 26, None),
    ]
    want = [("again", 1, 0.0, 25.0), ("again", 2, 20.0, 45.0), ("locked", 1, 0.0, 35.0), ("quiet", 5, 0.0, 20.0)]
    for n in (1, 5):
        assert stable(spark, tmp_path / str(n), split(rows, n, 3))[0] == want


def test_stable_files_state_expires(spark, tmp_path):
    batches = [[("gone", 1, 0.0, 100, True)], [("other", 1, 0.0, 200, True)], [("other", 1, 0.0, 9000, True)], [("far", 1, 0.0, 90_000, True), ("gone", 1, 0.0, 90_000, True)], [("far", 1, 0.0, 200_000, True)]]
    got, state = stable(spark, tmp_path, batches, forget_seconds=3600.0)
    assert got == []  # the looks are too far apart to agree
    assert state[0]["numRowsTotal"] <= 1  # the one that was looked at last


# ---- the inbox ----

PACKAGE = "package long, batch_id long, mtime long"


def plain_inbox(batches, status):
    closed, out = set(), {}
    for rows in batches:
        for p, b, m in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
            s = status.get(b)
            out[p] = "accepted" if s == "open" and b not in closed else "processed" if s in ("open", "done") else "rejected"
            closed |= {b} if out[p] == "accepted" else set()
    return out


@pytest.mark.parametrize("stop_at", [None, 0, 1, 2])
def test_inbox_survives_a_stop(spark, tmp_path, stop_at):
    rng = random.Random(7)
    batches = [[(100 * k + i, rng.randint(0, 9), rng.randint(0, 5)) for i in range(30)] for k in range(3)]
    status = {b: ("open", "done", "other")[b % 3] for b in range(8)}
    known = spark.createDataFrame(list(status.items()), "batch_id long, status string")
    stream = feed(spark, tmp_path / "in", batches, PACKAGE)
    start = lambda **how: ingest.inbox_stream(stream, known, str(tmp_path / "box"), **how).trigger(availableNow=True).start()
    if stop_at is not None:
        q = start(fail_after=lambda number: number == stop_at)
        with pytest.raises(Exception, match="stopped after micro-batch"):
            q.awaitTermination()
        assert {r[0] for r in ingest.inbox_rows(spark, str(tmp_path / "box")).select("micro").distinct().collect()} == set(range(stop_at + 1))
    start().awaitTermination()
    got = ingest.inbox_rows(spark, str(tmp_path / "box")).collect()
    assert len(got) == len({r.package for r in got}) == 90
    assert {r.package: r.outcome for r in got} == plain_inbox(batches, status)
    assert max(Counter(r.batch_id for r in got if r.outcome == "accepted").values()) == 1


def test_inbox_before_the_first_package(spark, tmp_path):
    assert ingest.inbox_rows(spark, str(tmp_path / "nothing")) is None


# ---- the progress channel ----


class Event:
    def __init__(self, **fields):
        self.__dict__.update(fields)


def test_throttle_with_a_fake_clock():
    now = [100.0]
    t = progress.Throttle(2.0, clock=lambda: now[0])
    assert [t.passes("a"), t.passes("a"), t.passes("b"), t.passes("a", force=True)] == [True, False, True, True]
    now[0] += 1.99
    assert not t.passes("a")
    now[0] += 0.01
    assert t.passes("a") and not t.passes("a")


def test_channel_writes_throttled_rows_and_staleness(spark, tmp_path):
    now = [1000.0]
    c = progress.ProgressChannel(spark, f"file://{tmp_path}", progress.Throttle(2.0, lambda: now[0]), lambda: now[0])
    row = lambda at=None: progress.read_progress(spark, f"file://{tmp_path}", at or now[0]).collect()[0]
    c.onQueryStarted(Event(id="q1", name="n"))
    assert (row().state, row().rows, row().batch) == ("running", 0, -1)
    step = lambda b, n: c.onQueryProgress(Event(progress=Event(id="q1", batchId=b, numInputRows=n)))
    now[0] += 1
    step(0, 10)  # too soon to be written
    assert row().rows == 0
    now[0] += 1
    step(1, 5)
    step(1, 5)  # the same micro-batch told twice
    assert (row().rows, row().batch, row().stale) == (15, 1, False)
    assert not row(now[0] + 180).stale and row(now[0] + 180.5).stale and row(now[0] + 180.5).age_sec == 180.5
    c.onQueryTerminated(Event(id="q1", exception=None))
    assert row(now[0] + 9999).state == "done" and not row(now[0] + 9999).stale
    c.onQueryTerminated(Event(id="q1", exception="broken"))
    assert row().state == "failed"


# ---- the shared folder ----


def test_settings_are_put_back(spark):
    key = next(iter(ROCKS))
    before = spark.conf.get(key, None)
    with pytest.raises(ZeroDivisionError):
        with_conf(spark, ROCKS, lambda: 1 / 0)
    assert spark.conf.get(key, None) == before
    fs, at = file_system(spark, shared_dir(spark))
    assert fs.getScheme() == "file"
