"""Queries that run as streams to the end of their source: dedup, stable files, retry timers, merge grace, the inbox, progress."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from chronotext.sources.bindings import table
from chronotext.sources.shared import drained, fresh_path, stream_of
from chronotext.streaming import ingest as G
from chronotext.streaming import progress as P
from chronotext.streaming import stateful as S

from .base import query


@query("SELECT DISTINCT source, sha256(coalesce(text, '')) AS sha256 FROM documents")
def stream_content_dedup(spark, d):
    f = stream_of(spark, f"{d}/documents.parquet").select("source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    return drained(G.dedup_content(f.withColumn("sha256", F.concat_ws(":", "source", "h"))).select("source", F.col("h").alias("sha256")))


#: A conversation is a file, each of its turns a look at it, at least a minute apart; from turn to turn it grows or rests, and now and then it can't be read.
_LOOKS = "SELECT conv_id::VARCHAR AS path, 1704067200 + 7 * (conv_id % 500) + 90 * turn + (conv_id * 7 + turn * 13) % 31 AS at_sec, turn // 3 + conv_id % 3 AS size, 1704067200 + 7 * (conv_id % 500) + 270 * (turn // 3) + CASE WHEN conv_id % 4 = 0 THEN 20 ELSE 0 END AS mtime, turn, conv_id FROM conversations WHERE turn IS NOT NULL AND conv_id IS NOT NULL"


def _looks(spark, d):
    c, t = F.col("conv_id"), F.col("turn")
    start = F.lit(1704067200) + 7 * (c % 500)
    third = F.floor(t / 3)
    rows = stream_of(spark, f"{d}/conversations.parquet").where(t.isNotNull() & c.isNotNull())
    at_sec = start + 90 * t + (c * 7 + t * 13) % 31
    return rows.select(c.cast("string").alias("path"), at_sec.alias("at_sec"), F.timestamp_seconds(at_sec).alias("seen"), (third + c % 3).alias("size"), (start + 270 * third + F.when(c % 4 == 0, 20).otherwise(0)).alias("mtime"), "turn", "conv_id")


@query(f"""WITH lk AS (SELECT DISTINCT *, (conv_id + turn) % 5 <> 0 AS readable FROM ({_LOOKS})), q AS (SELECT * FROM lk WHERE at_sec - mtime >= 10),
n AS (SELECT *, CASE WHEN size = lag(size) OVER w AND mtime = lag(mtime) OVER w THEN 0 ELSE 1 END AS fresh FROM q WINDOW w AS (PARTITION BY path ORDER BY at_sec, size, mtime)),
v AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY at_sec, size, mtime) AS version FROM n), p AS (SELECT *, row_number() OVER (PARTITION BY path, version ORDER BY at_sec) AS place FROM v)
SELECT path, size, mtime::DOUBLE AS mtime, min(at_sec)::DOUBLE AS seen FROM p WHERE place >= 2 AND readable GROUP BY path, version, size, mtime""")
def stream_stability(spark, d):
    looks = _looks(spark, d).withColumn("readable", (F.col("conv_id") + F.col("turn")) % 5 != 0).dropDuplicates(["path", "seen", "size", "mtime", "readable"])
    return drained(S.stable_files(looks, forget_seconds=86_400.0))


_TABLES = "[" + ", ".join(map(str, S.INCOMPLETE_BACKOFF)) + "]", "[" + ", ".join(map(str, S.BACKOFF)) + "]"


@query(f"""WITH lk AS (SELECT path, at_sec, (size // 2)::BIGINT AS size, (conv_id + turn) % 4 = 3 AS ok, turn % 2 = 0 AS inc FROM ({_LOOKS})),
g AS (SELECT path, list({{'at_sec': at_sec, 'size': size, 'ok': ok, 'inc': inc, 'f': 0, 'r': 0::BIGINT, 's': 0::BIGINT, 'told': false, 'out': []::STRUCT(at_sec BIGINT, outcome VARCHAR, failures INTEGER, retry_at BIGINT)[]}} ORDER BY at_sec, size, ok, inc) AS rs FROM lk GROUP BY path),
z AS (SELECT path, list_reduce([{{'at_sec': 0::BIGINT, 'size': 0::BIGINT, 'ok': false, 'inc': false, 'f': 0, 'r': 0::BIGINT, 's': 0::BIGINT, 'told': true, 'out': []::STRUCT(at_sec BIGINT, outcome VARCHAR, failures INTEGER, retry_at BIGINT)[]}}] || rs, lambda a, x:
 {{'at_sec': x.at_sec, 'size': x.size, 'ok': x.ok, 'inc': x.inc,
 'f': CASE WHEN a.f > 0 AND x.size = a.s AND x.at_sec < a.r THEN a.f WHEN x.ok THEN 0 WHEN x.size = a.s THEN a.f + 1 ELSE 1 END,
 'r': CASE WHEN a.f > 0 AND x.size = a.s AND x.at_sec < a.r THEN a.r WHEN x.ok THEN 0 ELSE x.at_sec + CASE WHEN x.inc THEN {_TABLES[0]}[least(CASE WHEN a.f > 0 AND x.size = a.s THEN a.f + 1 ELSE 1 END, {len(S.INCOMPLETE_BACKOFF)})] ELSE {_TABLES[1]}[least(CASE WHEN a.f > 0 AND x.size = a.s THEN a.f + 1 ELSE 1 END, {len(S.BACKOFF)})] END END::BIGINT,
 's': CASE WHEN a.f > 0 AND x.size = a.s AND x.at_sec < a.r THEN a.s ELSE x.size END,
 'told': CASE WHEN a.f > 0 AND x.size = a.s AND x.at_sec < a.r THEN a.told WHEN x.ok THEN true ELSE false END,
 'out': a.out || CASE WHEN a.f > 0 AND NOT a.told AND a.r <= x.at_sec THEN [{{'at_sec': a.r, 'outcome': 'due', 'failures': a.f, 'retry_at': a.r}}] ELSE [] END
 || [{{'at_sec': x.at_sec, 'outcome': CASE WHEN a.f > 0 AND x.size = a.s AND x.at_sec < a.r THEN 'deferred' WHEN x.ok THEN 'ok' ELSE 'failed' END,
 'failures': CASE WHEN a.f > 0 AND x.size = a.s AND x.at_sec < a.r THEN a.f WHEN x.ok THEN 0 WHEN a.f > 0 AND x.size = a.s THEN a.f + 1 ELSE 1 END,
 'retry_at': CASE WHEN a.f > 0 AND x.size = a.s AND x.at_sec < a.r THEN a.r WHEN x.ok THEN NULL ELSE x.at_sec + CASE WHEN x.inc THEN {_TABLES[0]}[least(CASE WHEN a.f > 0 AND x.size = a.s THEN a.f + 1 ELSE 1 END, {len(S.INCOMPLETE_BACKOFF)})] ELSE {_TABLES[1]}[least(CASE WHEN a.f > 0 AND x.size = a.s THEN a.f + 1 ELSE 1 END, {len(S.BACKOFF)})] END END::BIGINT}}]}}) AS e FROM g),
o AS (SELECT path, unnest(e.out, recursive := true) FROM z), l AS (SELECT path, e.r AS at_sec, 'due' AS outcome, e.f AS failures, e.r AS retry_at FROM z WHERE e.f > 0 AND NOT e.told AND e.r <= (SELECT max(at_sec) FROM lk))
SELECT path, at_sec, outcome, failures, retry_at FROM o UNION ALL SELECT path, at_sec, outcome, failures, retry_at FROM l""")
def backoff_timers(spark, d):
    looks = _looks(spark, d)
    rows = looks.select("path", "seen", F.floor(F.col("size") / 2).alias("size"), F.lit(0).alias("mtime"), ((F.col("conv_id") + F.col("turn")) % 4 == 3).alias("ok"), (F.col("turn") % 2 == 0).alias("incomplete"))
    return S.backoff_stream(rows, drained)


_ARRIVE = """SELECT doc_id AS session_id, doc_id % 9973 AS slot, 1704067200 + 600 * (doc_id % 9973) AS base, 1704067200 + 600 * (doc_id % 9973) + (doc_id * 37) % 7000 AS at_sec, CASE WHEN doc_id % 11 <> 0 THEN 1704067200 + 600 * (doc_id % 9973) + 3600 + 1800 END AS until FROM documents WHERE doc_id IS NOT NULL"""


@query(f"""WITH a AS ({_ARRIVE}), g AS (SELECT *, count(*) FILTER (at_sec < until) OVER (PARTITION BY slot, until IS NULL) AS held, row_number() OVER (PARTITION BY slot, until IS NULL, at_sec < until ORDER BY at_sec, session_id) AS nth FROM a)
SELECT session_id, CASE WHEN until IS NULL THEN 'at_once' WHEN at_sec < until THEN 'released' WHEN held > 0 OR nth > 1 THEN 'late' ELSE 'at_once' END AS outcome, CASE WHEN at_sec < until THEN until ELSE at_sec END::BIGINT AS released_at, CASE WHEN at_sec < until THEN held ELSE 1 END::INTEGER AS parts
FROM g WHERE until IS NULL OR at_sec >= until OR until <= (SELECT max(at_sec) FROM a)""")
def merge_grace_timers(spark, d):
    i = F.col("doc_id")
    base = F.lit(1704067200) + 600 * (i % 9973)
    rows = stream_of(spark, f"{d}/documents.parquet").where(i.isNotNull()).select(i.alias("session_id"), (i % 9973).alias("sibling_key"), F.timestamp_seconds(base + (i * 37) % 7000).alias("seen"), F.when(i % 11 != 0, F.timestamp_seconds(base + 5400)).alias("deadline"))
    return drained(S.merge_grace(rows, forget_seconds=10**9))


@query("""WITH p AS (SELECT doc_id AS package, doc_id // 3 AS batch_id, n_chars AS mtime, (doc_id // 3) % 4 AS k FROM documents), f AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY mtime NULLS FIRST, package) AS nth FROM p)
SELECT package, batch_id, CASE WHEN k = 0 AND nth = 1 THEN 'accepted' WHEN k < 2 THEN 'processed' ELSE 'rejected' END AS outcome FROM f""")
def inbox_packages(spark, d):
    batch = F.floor(F.col("doc_id") / 3).alias("batch_id")
    known = table(spark, d, "documents").select(batch).distinct().withColumn("status", F.when(F.col("batch_id") % 4 == 0, "open").when(F.col("batch_id") % 4 == 1, "done").otherwise("other"))
    returned = stream_of(spark, f"{d}/documents.parquet").select(F.col("doc_id").alias("package"), batch, F.col("n_chars").alias("mtime"))
    root = fresh_path(spark, "inbox")
    G.inbox_stream(returned, known, root).trigger(availableNow=True).start().awaitTermination()
    return G.inbox_rows(spark, root).select("package", "batch_id", "outcome")


@query("SELECT 'turns' AS name, 'done' AS state, count(*) AS rows, false AS stale FROM conversations")
def progress_channel(spark, d):
    root = fresh_path(spark, "progress")
    channel = P.ProgressChannel(spark, root)
    spark.streams.addListener(channel)
    try:
        at_sec = fresh_path(spark, "stream")
        q = stream_of(spark, f"{d}/conversations.parquet").select("conv_id", "turn").writeStream.queryName("turns").format("parquet").option("path", f"{at_sec}/rows").option("checkpointLocation", f"{at_sec}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        own, limit = str(q.id), time.monotonic() + 30
        mine = lambda: P.read_progress(spark, root, time.time()).where(F.col("query") == own)
        while time.monotonic() < limit and not mine().where("state = 'done'").take(1):  # listeners hear of the end a little later
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(channel)
    return mine().select("name", "state", "rows", "stale")
