"""Queries over outlines, knowledge, drafts, names, times, progress, alerts, and the streaming loop."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronotext.functions import names as N

from chronotext.operators import validate as V
from chronotext.sources import files as L
from chronotext.sources.bindings import knowledge_items, outline_topics, seg_docs, sess_events, table
from chronotext.sources.sinks import draft_markdown
from chronotext.streaming import ingest as G

from .base import EVENTS, SEG, TOPICS, query


@query(TOPICS + """, u AS (SELECT session_id, x AS id, count(*) AS n FROM (SELECT session_id, unnest(sources) AS x FROM topics) GROUP BY ALL)
SELECT session_id, 'missing' AS rule, id::VARCHAR AS item_id FROM seg LEFT JOIN u USING (session_id, id) WHERE n IS NULL UNION ALL SELECT session_id, 'duplicate', id::VARCHAR FROM u WHERE n > 1""")
def topic_partition_check(spark, d):
    return V.topic_partition_violations(outline_topics(spark, d), seg_docs(spark, d))


@query(TOPICS + " SELECT session_id, topic, coalesce(sources = range(list_min(sources), list_max(sources) + 1), false) AS contiguous, sources = list_sort(sources) AS ascending FROM topics")
def contiguous_sources(spark, d):
    return outline_topics(spark, d).select("session_id", "topic", V.contiguous(F.col("sources")).alias("contiguous"), V.ascending(F.col("sources")).alias("ascending"))


@query(TOPICS + """, tt AS (SELECT t.*, a.seg_start AS own_start, b.seg_end AS own_end FROM topics t LEFT JOIN seg a ON a.session_id = t.session_id AND a.id = t.sources[1] LEFT JOIN seg b ON b.session_id = t.session_id AND b.id = t.sources[-1]),
td AS (SELECT *, coalesce(lead(own_start) OVER (PARTITION BY session_id ORDER BY topic), own_end) AS due FROM tt)
SELECT session_id, 'wrong_start' AS rule, topic::VARCHAR AS item_id FROM td WHERE abs(t_start - own_start) > 1.5 UNION ALL SELECT session_id, 'wrong_end', topic::VARCHAR FROM td WHERE abs(t_end - due) > 1.5""")
def next_topic_end(spark, d):
    return V.topic_time_violations(outline_topics(spark, d), seg_docs(spark, d))


@query(TOPICS + """ SELECT i.session_id, 'unknown_topic' AS rule, item::VARCHAR AS item_id FROM items i LEFT JOIN topics t ON i.session_id = t.session_id AND i.topic = t.topic WHERE t.topic IS NULL
 UNION ALL SELECT i.session_id, 'outside_topic', item::VARCHAR FROM items i JOIN topics t ON i.session_id = t.session_id AND i.topic = t.topic WHERE NOT list_has_all(t.sources, i.sources)""")
def evidence_in_topic(spark, d):
    return V.evidence_violations(knowledge_items(spark, d), outline_topics(spark, d))


@query(TOPICS + ", mv AS (SELECT session_id, topic AS item, topic AS from_topic, CASE WHEN session_id % 4 = 0 THEN topic ELSE topic + 1 END AS to_topic FROM topics) SELECT mv.session_id, 'unknown_topic' AS rule, item::VARCHAR AS item_id FROM mv LEFT JOIN topics t ON mv.session_id = t.session_id AND to_topic = t.topic WHERE t.topic IS NULL UNION ALL SELECT session_id, 'same_topic', item::VARCHAR FROM mv WHERE from_topic = to_topic")
def transition_check(spark, d):
    t = outline_topics(spark, d)
    moves = t.select("session_id", F.col("topic").alias("item"), F.col("topic").alias("from_topic"), F.when(F.col("session_id") % 4 == 0, F.col("topic")).otherwise(F.col("topic") + 1).alias("to_topic"))
    return V.transition_violations(moves, t)


@query(TOPICS + " SELECT session_id, array_to_string(list_sort(list_distinct(flatten(list(sources)))), ',') AS covered FROM items GROUP BY session_id")
def knowledge_coverage(spark, d):
    return V.coverage(knowledge_items(spark, d)).select("session_id", F.concat_ws(",", F.col("covered").cast("array<string>")).alias("covered"))


@query(TOPICS + " SELECT session_id, id FROM seg WHERE id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM items i WHERE i.session_id = seg.session_id AND i.item % 5 = 0 AND list_contains(i.sources, seg.id))")
def uncovered_cues(spark, d):
    return V.uncovered(seg_docs(spark, d).where("id % 2 = 1"), knowledge_items(spark, d).where("item % 5 = 0"))


@query(TOPICS + """ SELECT session_id, 'importance_low' AS rule, item::VARCHAR AS item_id FROM items WHERE importance < 0.3""")
def knowledge_violations(spark, d):
    return V.knowledge_violations(knowledge_items(spark, d).withColumn("category", F.lit("concepts")))


@query(TOPICS + ", un AS (SELECT session_id, list_distinct(flatten(list(sources))) AS cov FROM items WHERE item % 6 = 0 GROUP BY session_id) SELECT i.session_id, 'unrouted' AS rule, item::VARCHAR AS item_id FROM items i LEFT JOIN un USING (session_id) WHERE status = 'incomplete' AND NOT coalesce(list_has_any(i.sources, cov), false)")
def routing_gaps(spark, d):
    k = knowledge_items(spark, d)
    return V.routing_gaps(k, k.where("item % 6 = 0").select("session_id", "sources"))


@query(TOPICS + " SELECT DISTINCT session_id, topic FROM topics WHERE (session_id, topic) NOT IN (SELECT session_id, topic FROM items)")
def retention_gaps(spark, d):
    return V.retention_gaps(outline_topics(spark, d), knowledge_items(spark, d), ["session_id", "topic"])


@query(TOPICS + ", x AS (SELECT session_id, item, unnest(sources) AS id, generate_subscripts(sources, 1) AS p FROM items) SELECT x.session_id, item, string_agg(text, '' ORDER BY p) AS evidence FROM x JOIN seg USING (session_id, id) GROUP BY ALL")
def evidence_text(spark, d):
    return V.evidence_text(knowledge_items(spark, d), seg_docs(spark, d))


@query(TOPICS + ", x AS (SELECT session_id, item, unnest(sources) AS id FROM items) SELECT x.session_id, item, array_to_string(list_sort(list_distinct(list('l' || (id % 3)))), ',') AS labels FROM x JOIN seg USING (session_id, id) GROUP BY ALL")
def visual_labels_of_items(spark, d):
    labels = seg_docs(spark, d).select("session_id", "id", F.array(F.concat(F.lit("l"), F.col("id") % 3)).alias("labels"))
    return V.referenced_labels(knowledge_items(spark, d), labels).select("session_id", "item", F.concat_ws(",", "labels").alias("labels"))


_BRIDGE = ", br AS (SELECT session_id, topic AS section, CASE WHEN item % 10 = 4 THEN topic + 1 ELSE topic END AS topic, item FROM items WHERE item % 8 <> 1 UNION ALL SELECT session_id, topic, topic, item FROM items WHERE item % 16 = 2)"


@query(TOPICS + _BRIDGE + """, sx AS (SELECT session_id, item, count(*) AS n, min(topic) AS lo, max(topic) AS hi FROM br GROUP BY ALL)
SELECT session_id, 'missing' AS rule, item::VARCHAR AS item_id FROM items LEFT JOIN sx USING (session_id, item) WHERE n IS NULL UNION ALL SELECT session_id, 'duplicate', item::VARCHAR FROM sx WHERE n > 1 UNION ALL SELECT session_id, 'wrong_topic', item::VARCHAR FROM items JOIN sx USING (session_id, item) WHERE lo <> topic OR hi <> topic""")
def draft_schedule_violations(spark, d):
    k = knowledge_items(spark, d)
    b = k.where("item % 8 <> 1").select("session_id", F.col("topic").alias("section"), F.when(F.col("item") % 10 == 4, F.col("topic") + 1).otherwise(F.col("topic")).alias("topic"), "item")
    b = b.unionByName(k.where("item % 16 = 2").select("session_id", F.col("topic").alias("section"), "topic", "item"))
    return V.draft_violations(b, k)


@query(TOPICS + """, ln AS (SELECT i.session_id, topic, item, CASE WHEN status = 'incomplete' THEN '> [!question] ' ELSE '- ' END || replace(text, '[[', '\\[\\[') AS line FROM items i JOIN seg s ON s.session_id = i.session_id AND s.id = i.item),
se AS (SELECT session_id, topic, '## Topic ' || topic || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY item) AS sec FROM ln GROUP BY session_id, topic) SELECT session_id, string_agg(sec, chr(10) || chr(10) ORDER BY topic) AS markdown FROM se GROUP BY session_id""")
def audio_draft_markdown(spark, d):
    k = knowledge_items(spark, d)
    sections = k.groupBy("session_id", F.col("topic").alias("section")).agg(F.sort_array(F.collect_list("item")).alias("ids")).withColumn("heading", F.concat(F.lit("Topic "), "section"))
    texts = k.join(seg_docs(spark, d).select("session_id", F.col("id").alias("item"), "text"), ["session_id", "item"])
    return draft_markdown(sections, texts.select("session_id", "item", "text", "status"))


@query(TOPICS + " SELECT session_id, item, 'left' AS side FROM items WHERE item % 5 = 0 AND item % 7 <> 0 UNION ALL SELECT session_id, item, 'right' FROM items WHERE item % 7 = 0 AND item % 5 <> 0")
def unresolved_drift(spark, d):
    k = knowledge_items(spark, d).select("session_id", "item")
    return V.drift(k.where("item % 7 <> 0").unionByName(k.where("item % 5 = 0")), k.where("item % 7 <> 0").unionByName(k.where("item % 7 = 0")))


@query("SELECT o_orderkey, 'not_returned' AS rule FROM orders WHERE o_orderkey % 17 = 0 UNION ALL SELECT o_orderkey, 'changed_o_orderstatus' FROM orders WHERE o_orderkey % 17 <> 0 AND o_orderkey % 19 = 0 AND o_orderstatus <> 'Z'")
def return_manifest(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("session_id"), "o_orderstatus", "o_orderpriority")
    back = o.where("session_id % 17 <> 0").withColumn("o_orderstatus", F.when(F.col("session_id") % 19 == 0, "Z").otherwise(F.col("o_orderstatus")))
    return V.manifest_violations(o, back, ["session_id"], ["o_orderstatus", "o_orderpriority"]).select(F.col("session_id").alias("o_orderkey"), "rule")


@query("""WITH b AS (SELECT item_id, string_split(text, ' ') AS ws FROM benchmark), l AS (SELECT item_id, generate_subscripts(ws, 1) AS line_no, unnest(ws) AS line FROM b), t AS (SELECT trim(line) AS term, item_id, line_no FROM l WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#')),
f AS (SELECT term, min(item_id * 100000 + line_no) AS o FROM t GROUP BY term) SELECT term, (row_number() OVER (ORDER BY o) - 1)::INTEGER AS ord FROM f""")
def glossary_load(spark, d):
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("file_priority"), F.posexplode(F.split("text", " ")).alias("line_no", "line"))
    return L.glossary(b.withColumn("file", F.col("file_priority").cast("string"))).select("term", "ord")


_SLUG = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim({0}), '[<>:\"/\\|?*\x00-\x1f]', '-', 'g'), '[\s_]+', '-', 'g'), '-{{2,}}', '-', 'g'), '^[-.]+|[-.]+$', '', 'g')"


@query("WITH x AS (SELECT doc_id, " + _SLUG.format("text") + " AS s FROM documents) SELECT doc_id, CASE WHEN regexp_replace(left(lower(s), 40), '-+$', '') = '' THEN 'untitled' ELSE regexp_replace(left(lower(s), 40), '-+$', '') END AS slug, CASE WHEN regexp_replace(left(s, 60), '[-.]+$', '') = '' THEN 'unknown-course' ELSE regexp_replace(left(s, 60), '[-.]+$', '') END AS label FROM x")
def slug_names(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", N.slug(t).alias("slug"), N.course_label(t).alias("label"))


@query(EVENTS + """ SELECT session_id, concat_ws('_', CASE WHEN session_id % 3 = 0 THEN 'unknown-date' ELSE strftime(start_time, '%Y-%m-%d') END, CASE WHEN session_id % 3 = 0 THEN CASE WHEN session_id % 2 = 0 THEN '0930' ELSE 'unknown-time' END ELSE strftime(start_time, '%H%M') END, 'course-' || course_key, CASE WHEN session_id % 2 = 0 THEN '007' ELSE '001' END) AS prefix FROM ev""")
def identity_prefix(spark, d):
    even = F.col("session_id") % 2 == 0
    sid = F.when(even, "2024-01-05_0930_x_007").otherwise("old")
    start = F.when(F.col("session_id") % 3 != 0, F.col("start_time"))
    return sess_events(spark, d).select("session_id", N.identity_prefix(sid, F.lit(None).cast("string"), start, F.concat(F.lit("course "), "course_key")).alias("prefix"))


_NAMES = """WITH n AS (SELECT event_id, ts, value, CASE event_id % 6 WHEN 0 THEN 'rec_' || strftime(ts, '%Y%m%d_%H%M%S') || '.m4a' WHEN 1 THEN strftime(ts, '%Y%m%d-%H%M%S') || '.mp3' WHEN 2 THEN 'REC ' || strftime(ts, '%Y-%m-%d %H.%M.%S') WHEN 3 THEN strftime(ts, '%Y_%m_%d %H_%M') WHEN 4 THEN 'voice_20249931_250000.wav' ELSE 'memo' || event_id END AS name FROM events),
p AS (SELECT *, CASE WHEN event_id % 6 < 3 THEN date_trunc('second', ts) WHEN event_id % 6 = 3 THEN date_trunc('minute', ts) END AS named FROM n)"""


def _names(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    k, f = F.col("event_id") % 6, lambda p: F.date_format("ts", p)
    name = F.when(k == 0, F.concat(F.lit("rec_"), f("yyyyMMdd_HHmmss"), F.lit(".m4a"))).when(k == 1, F.concat(f("yyyyMMdd-HHmmss"), F.lit(".mp3"))).when(k == 2, F.concat(F.lit("REC "), f("yyyy-MM-dd HH.mm.ss"))).when(k == 3, f("yyyy_MM_dd HH_mm")).when(k == 4, "voice_20249931_250000.wav").otherwise(F.concat(F.lit("memo"), "event_id"))
    return e.withColumn("name", name)


@query(_NAMES + " SELECT event_id, name, named FROM p")
def filename_time(spark, d):
    return _names(spark, d).select("event_id", "name", N.name_time(F.col("name")).alias("named"))


@query(_NAMES + """, q AS (SELECT *, floor(value)::BIGINT AS sec, CASE event_id % 4 WHEN 0 THEN date_trunc('second', ts) + to_seconds(floor(value)::BIGINT + 30) WHEN 1 THEN date_trunc('second', ts) + INTERVAL 2 HOUR END AS created, date_trunc('second', ts) + INTERVAL 1 DAY AS modified FROM p),
e AS (SELECT *, coalesce(created > named AND abs(epoch(created) - epoch(named) - sec) <= 600 AND sec > 0, false) AS ended FROM q)
SELECT event_id, CASE WHEN created IS NOT NULL AND ended THEN named WHEN created IS NOT NULL THEN created WHEN named IS NOT NULL THEN named WHEN sec > 0 THEN modified - to_seconds(sec) ELSE modified + INTERVAL 1 MINUTE END AS start,
 CASE WHEN created IS NOT NULL AND ended THEN 'filename' WHEN created IS NOT NULL THEN 'ffprobe' WHEN named IS NOT NULL THEN 'filename' WHEN sec > 0 THEN 'mtime-duration' ELSE 'ctime' END AS source,
 CASE WHEN created IS NOT NULL OR named IS NOT NULL THEN 'high' WHEN sec > 0 THEN 'medium' ELSE 'low' END AS confidence FROM e""")
def start_time_guess(spark, d):
    n = _names(spark, d)
    at, sec = F.date_trunc("second", "ts").cast("timestamp_ntz"), F.floor("value").cast("int")
    plus = lambda **k: at + F.make_dt_interval(**{x: F.lit(v) if isinstance(v, int) else v for x, v in k.items()})
    created = F.when(F.col("event_id") % 4 == 0, plus(secs=sec + 30)).when(F.col("event_id") % 4 == 1, plus(hours=2))
    g = N.start_guess(F.col("name"), sec, created, plus(days=1), plus(days=1, mins=1))
    return n.withColumn("g", g).select("event_id", "g.start", "g.source", "g.confidence")


@query(SEG + r""", x AS (SELECT session_id, id, seg_start AS t, floor(seg_start)::BIGINT AS w, round_even((seg_start - floor(seg_start)) * 1000, 0)::BIGINT AS ms FROM seg)
SELECT session_id, id, lpad((w // 3600)::VARCHAR, greatest(2, length((w // 3600)::VARCHAR))::INTEGER, '0') || ':' || lpad((w % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((w % 60 + CASE WHEN ms = 1000 THEN 1 ELSE 0 END)::VARCHAR, 2, '0') || '.' || lpad((CASE WHEN ms = 1000 THEN 0 ELSE ms END)::VARCHAR, 3, '0') AS clock FROM x""")
def hhmmss_ms_format(spark, d):
    return seg_docs(spark, d).select("session_id", "id", N.hhmmss_ms(F.col("seg_start")).alias("clock"))


@query(EVENTS + " SELECT session_id, CASE session_id % 4 WHEN 0 THEN duration_sec WHEN 1 THEN floor(duration_sec / 60) * 60 + 5.5 WHEN 2 THEN 3725.0 END AS seconds FROM ev")
def parse_timestamps(spark, d):
    k, s = F.col("session_id") % 4, F.col("duration_sec")
    raw = F.when(k == 0, s.cast("string")).when(k == 1, F.concat(F.floor(s / 60).cast("string"), F.lit(":05.5"))).when(k == 2, "01:02:05").otherwise("soon")
    return sess_events(spark, d).select("session_id", N.seconds_of(raw).alias("seconds"))


@query("""WITH p AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 0 ELSE floor(value * 2) END AS total, floor(value * (event_id % 5) / 2) AS done, epoch(TIMESTAMP '2024-01-16 00:00:00') - floor(epoch(ts)) AS age FROM events)
SELECT event_id, CASE WHEN total > 0 THEN least(done / total, 1.0) * 100 END AS percent, greatest(0, age)::BIGINT AS age_sec, greatest(0, age) > 180 AS stale, age <= greatest(90, 3 * 15) AS alive FROM p""")
def progress_status(spark, d):
    e = table(spark, d, "events")
    total, done = F.when(F.col("event_id") % 11 == 0, 0.0).otherwise(F.floor(F.col("value") * 2).cast("double")), F.floor(F.col("value") * (F.col("event_id") % 5) / 2)
    age = F.unix_seconds(F.lit("2024-01-16").cast("timestamp")) - F.unix_seconds(F.col("ts").cast("timestamp"))
    return e.withColumn("total", total).select("event_id", F.when(F.col("total") > 0, F.least(done / F.nullif("total", F.lit(0.0)), F.lit(1.0)) * 100).alias("percent"), F.greatest(F.lit(0), age).alias("age_sec"), (F.greatest(F.lit(0), age) > 180).alias("stale"), (age <= 90).alias("alive"))


@query("""SELECT 'error' AS level, 'watch_down' AS rule, s_suppkey AS item FROM supplier WHERE s_suppkey % 23 = 0 UNION ALL SELECT 'warn', 'device_offline', s_suppkey FROM supplier WHERE s_acctbal < 0
 UNION ALL SELECT 'warn', 'stale_incoming', s_suppkey FROM supplier WHERE s_suppkey % 10 > 6 UNION ALL SELECT 'warn', 'crash_boot', s_suppkey FROM supplier WHERE abs(s_suppkey * 60 - 3000) < 600""")
def alerts(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 23 != 0).alias("running"), (F.col("s_acctbal") >= 0).alias("connected"), (F.col("s_suppkey") % 10).alias("age_hours"), (F.col("s_suppkey") * 60).alias("crash"), F.lit(3000).alias("boot"))
    rules = (("error", "watch_down", ~F.col("running")), ("warn", "device_offline", ~F.col("connected")), ("warn", "stale_incoming", F.col("age_hours") > 6), ("warn", "crash_boot", F.abs(F.col("crash") - F.col("boot")) < 600))
    hit = F.explode(F.filter(F.array(*(F.when(c, F.struct(F.lit(a).alias("level"), F.lit(b).alias("rule"))) for a, b, c in rules)), lambda x: x.isNotNull())).alias("a")
    return s.select("s_suppkey", hit).select("a.level", "a.rule", F.col("s_suppkey").alias("item"))


@query("""WITH a AS (SELECT user_id, event_id, epoch(ts)::BIGINT AS at, event_type = 'purchase' AS ok, event_id % 2 = 0 AS incomplete, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g FROM (SELECT *, date_trunc('second', ts) AS t2 FROM events)),
s AS (SELECT user_id, coalesce(g, 0) AS g, count(*) FILTER (NOT ok) AS failures, max(event_id) AS last, arg_max(incomplete, event_id) AS inc, arg_max(ok, event_id) AS ok FROM a GROUP BY ALL), l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY g DESC) AS rn FROM s)
SELECT user_id::VARCHAR AS path, failures, last + CASE WHEN inc THEN [15, 30, 60][least(greatest(failures, 1), 3)] ELSE [30, 60, 120, 300, 600, 1800][least(greatest(failures, 1), 6)] END AS retry_at FROM l WHERE rn = 1 AND NOT ok""")
def ingest_backoff(spark, d):
    a = table(spark, d, "events").select(F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("at"), F.lit(1).alias("size"), F.lit(1).alias("mtime"), (F.col("event_type") == "purchase").alias("ok"), (F.col("event_id") % 2 == 0).alias("incomplete"))
    return G.backoff_state(a)


@query("SELECT user_id AS session_id, max(epoch(ts)::BIGINT)::BIGINT AS newest FROM (SELECT user_id, date_trunc('second', ts) AS ts FROM events) GROUP BY 1 HAVING max(epoch(ts)::BIGINT) <= 1706572800 - 3600")
def quiet_material(spark, d):
    m = table(spark, d, "events").select(F.col("user_id").alias("session_id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("mtime"))
    return G.quiet_sessions(m, 1706572800, 3600)


@query("SELECT o_orderkey AS batch_id, CASE WHEN o_orderkey % 5 = 0 THEN 'rejected' WHEN o_orderstatus = 'O' THEN 'accepted' WHEN o_orderstatus = 'F' THEN 'processed' ELSE 'rejected' END AS outcome FROM orders")
def inbox_outcomes(spark, d):
    o = table(spark, d, "orders")
    known = o.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("batch_id"), F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "done").otherwise("other").alias("status"))
    return G.inbox(o.select(F.col("o_orderkey").alias("batch_id"), F.col("o_orderdate").alias("mtime")), known).select("batch_id", "outcome")


@query()
def json_document_types(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("session_id"), F.when(F.col("event_id") % 3 == 0, F.lit('{"k": true}')).when(F.col("event_id") % 3 == 1, F.lit('{"k": 1, "x": 2}')).otherwise(F.col("props")).alias("doc"))
    return V.json_type_violations(e, "doc", {"k": "NUMBER"})


@query("SELECT doc_id % 7 AS session_id, count(*) AS n, sum(CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END)::BIGINT AS n_long, max(n_chars) AS longest FROM documents GROUP BY 1")
def session_detail_counts(spark, d):
    return table(spark, d, "documents").groupBy((F.col("doc_id") % 7).alias("session_id")).agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") > 1000).alias("n_long"), F.max("n_chars").alias("longest"))


