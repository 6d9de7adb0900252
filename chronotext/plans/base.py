"""Registration of queries with their DuckDB SQL, and common table expressions of the driver-table views."""

from __future__ import annotations

from chronotext.functions.text import NON_CONTENT

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


_TIMED = """d AS (SELECT *, CASE WHEN id % 97 = 0 THEN 64 + n::DOUBLE / 8 ELSE greatest(n, 1)::DOUBLE / 8 END AS dur FROM r),
s AS (SELECT session_id, id, text, coalesce(sum(dur) OVER (PARTITION BY session_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS seg_start, dur FROM d),
seg AS (SELECT session_id, id, text, seg_start, seg_start + dur AS seg_end FROM s),
dura AS (SELECT session_id, max(seg_end) AS duration FROM seg GROUP BY session_id)"""
SEG = f"""WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
t AS (SELECT doc_id AS session_id, unnest(range(len(ls))) AS k, ls FROM l),
r AS (SELECT session_id, k::INTEGER AS id, ls[k + 1] AS text, length(ls[k + 1]) AS n FROM t),
{_TIMED}"""
CONV = f"""WITH r AS (SELECT conv_id AS session_id, turn::INTEGER AS id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM conversations),
{_TIMED}"""
KEY = "lower(regexp_replace(text, '" + NON_CONTENT.replace("'", "''") + "', '', 'g'))"
EVENTS = """WITH ev AS (SELECT event_id AS session_id, (user_id % 25)::INTEGER AS course_key, date_trunc('second', ts) AS start_time, floor(epoch(ts))::BIGINT AS start_sec,
 (floor(value) * 30)::DOUBLE AS duration_sec, CASE event_type WHEN 'signup' THEN 'NEW' WHEN 'view' THEN 'AUDIO_READY' WHEN 'click' THEN 'TRANSCRIBED' WHEN 'purchase' THEN 'DONE' WHEN 'error' THEN 'FAILED' END AS state FROM events),
sc AS (SELECT n_nationkey AS slot_course, n_nationkey AS course_ord, 0 AS slot_ord, n_nationkey % 7 + 1 AS weekday, 480 + (n_nationkey % 5) * 110 AS start_min, 580 + (n_nationkey % 5) * 110 AS end_min FROM nation)"""
ORDERS = """WITH pr AS (SELECT o_custkey AS session_id, o_orderpriority AS step, o_orderstatus AS status, o_orderkey AS seq, CASE WHEN o_orderkey % 3 <> 0 THEN 'm' || (o_orderkey % 7) END AS model,
 CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate END AS started_at, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS elapsed FROM orders)"""
FILES = """WITH fd AS (SELECT sha256(coalesce(text, '')) AS sha256, source || '/' || doc_id AS path, octet_length(encode(coalesce(text, '')))::BIGINT AS size, CASE WHEN doc_id % 10 <> 0 THEN doc_id * 60 END AS timestamp, doc_id AS seq, doc_id % 7 AS session_id FROM documents)"""
TOPICS = (
    SEG
    + """,
tp AS (SELECT session_id, (id // 5)::INTEGER AS topic, list(id ORDER BY id) AS src, min(seg_start) AS t_start, max(seg_end) AS te FROM seg GROUP BY ALL),
topics AS (SELECT session_id, topic, t_start, CASE WHEN session_id % 13 = 0 THEN te + 2.0 ELSE te END AS t_end,
 CASE WHEN session_id % 7 = 0 AND topic = 1 THEN src[2:6] WHEN session_id % 11 = 0 AND topic = 0 THEN list_concat(src, src[1:1]) ELSE src END AS sources FROM tp),
items AS (SELECT session_id, id AS item, (id // 5 + CASE WHEN session_id % 17 = 0 THEN 1 ELSE 0 END)::INTEGER AS topic, [id, id + 1] AS sources,
 ((id * 37 + session_id) % 101)::DOUBLE / 128 AS importance, CASE WHEN id % 9 = 0 THEN 'incomplete' ELSE 'complete' END AS status FROM seg WHERE id % 4 <> 3)"""
)
