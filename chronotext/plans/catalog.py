"""Queries over the relational index: upserts, numbering, timetable matching, recording chains, states."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronotext.config import MergeConfig
from chronotext.operators import catalog as C
from chronotext.operators import incremental as I
from chronotext.operators import sequence as S
from chronotext.operators import validate as V
from chronotext.sources.bindings import files_docs, proc_orders, schedule, sess_events, table

from .base import EVENTS, FILES, ORDERS, query

CFG = MergeConfig()

_COURSES = """WITH up AS (SELECT o_custkey % 40 AS key, o_orderkey AS seq, o_orderpriority AS name, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS teacher, CASE WHEN o_orderkey % 4 = 0 THEN 's' || (o_orderkey % 10) END AS semester FROM orders)"""


def _course_rows(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    return o.select((F.col("o_custkey") % 40).alias("key"), k.alias("seq"), F.col("o_orderpriority").alias("name"), F.when(k % 3 == 0, F.col("o_orderstatus")).alias("teacher"), F.when(k % 4 == 0, F.concat(F.lit("s"), k % 10)).alias("semester"))


@query(_COURSES + " SELECT key, arg_max(name, seq) AS name, arg_max(teacher, seq) FILTER (teacher IS NOT NULL) AS teacher, arg_max(semester, seq) FILTER (semester IS NOT NULL) AS semester, min(seq) AS created FROM up GROUP BY key")
def course_upsert(spark, d):
    rows = _course_rows(spark, d).withColumn("created", F.col("seq"))
    return C.upsert(rows, ["key"], "seq", overwrite=["name"], keep_known=["teacher", "semester"], first=["created"])


@query(_COURSES + ", c AS (SELECT key, arg_max(name, seq) AS name FROM up GROUP BY key) SELECT key, name, row_number() OVER (ORDER BY key)::INTEGER AS place FROM c")
def list_courses(spark, d):
    c = C.upsert(_course_rows(spark, d), ["key"], "seq", overwrite=["name"])
    return c.withColumn("place", F.row_number().over(Window.orderBy("key"))).orderBy("key")  # some dozens of courses


@query("""WITH r AS (SELECT user_id AS id, event_id AS seq, event_type AS state, CASE WHEN event_id % 3 <> 0 THEN value END AS error FROM events), l AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn, min(seq) OVER (PARTITION BY id) AS created FROM r)
SELECT id, state, error, created FROM l WHERE rn = 1""")
def session_upsert(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.col("event_type").alias("state"), F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("error"), F.col("event_id").alias("created"))
    return C.upsert(e, ["id"], "seq", overwrite=["state", "error"], first=["created"])


@query(ORDERS + """, x AS (SELECT *, row_number() OVER (PARTITION BY session_id, step ORDER BY seq DESC) AS rn FROM pr), k AS (SELECT session_id, step, arg_max(model, seq) FILTER (model IS NOT NULL) AS model, arg_max(started_at, seq) FILTER (started_at IS NOT NULL) AS started_at FROM pr GROUP BY session_id, step)
SELECT x.session_id, x.step, x.status, x.elapsed, k.model, k.started_at FROM x JOIN k ON x.session_id = k.session_id AND x.step = k.step WHERE rn = 1""")
def processing_upsert(spark, d):
    return C.upsert(proc_orders(spark, d), ["session_id", "step"], "seq", overwrite=["status", "elapsed"], keep_known=["model", "started_at"])


@query(ORDERS + " SELECT session_id, step, arg_max(status, seq) AS status, arg_max(model, seq) FILTER (model IS NOT NULL) AS provider FROM pr GROUP BY session_id, step")
def step_status_log(spark, d):
    e = proc_orders(spark, d).select("session_id", "step", "seq", "status", F.col("started_at").alias("finished_at"), F.col("elapsed").alias("elapsed_sec"), F.lit(None).cast("string").alias("error"), F.col("model").alias("provider"), "model", "started_at")
    return I.step_status(e).select("session_id", "step", "status", "provider")


@query(ORDERS + " SELECT session_id, step, seq, row_number() OVER (PARTITION BY session_id ORDER BY seq)::INTEGER AS place FROM pr")
def list_processing(spark, d):
    return proc_orders(spark, d).select("session_id", "step", "seq", F.row_number().over(Window.partitionBy("session_id").orderBy("seq")).alias("place"))


@query(FILES + ", o AS (SELECT DISTINCT sha256 FROM fd WHERE seq % 5 = 0), n AS (SELECT sha256, path, size, row_number() OVER (PARTITION BY sha256 ORDER BY seq) AS rn FROM fd WHERE seq % 5 <> 0) SELECT sha256, path, size FROM n WHERE rn = 1 AND sha256 NOT IN (SELECT sha256 FROM o)")
def insert_or_ignore(spark, d):
    f = files_docs(spark, d)
    return C.insert_or_ignore(f.where("seq % 5 = 0"), f.where("seq % 5 <> 0"), "sha256", "seq").select("sha256", "path", "size")


@query(FILES + " SELECT sha256, min(path) AS path, count(*) AS n FROM fd GROUP BY sha256")
def content_dedup(spark, d):
    return files_docs(spark, d).groupBy("sha256").agg(F.min("path").alias("path"), F.count("*").alias("n"))


@query(FILES + " SELECT path FROM fd WHERE sha256 IN (SELECT sha256 FROM fd WHERE seq % 5 = 0)")
def file_exists(spark, d):
    f = files_docs(spark, d)
    return f.join(f.where("seq % 5 = 0").select("sha256").distinct(), "sha256", "left_semi").select("path")


@query(FILES + " SELECT session_id, path, timestamp, row_number() OVER (PARTITION BY session_id ORDER BY timestamp NULLS FIRST, path)::INTEGER AS place FROM fd")
def list_files_nulls_first(spark, d):
    f = files_docs(spark, d).select("session_id", "path", "timestamp")
    return S.numbered(f, ["session_id"], [F.col("timestamp"), F.col("path")], "place", ties=[F.col("path")]).withColumn("place", F.col("place").cast("int"))


@query(FILES + " SELECT session_id, lpad(n, greatest(3, length(n))::INTEGER, '0') AS number, path, sha256, size FROM (SELECT *, (row_number() OVER (PARTITION BY session_id ORDER BY lower(path), path))::VARCHAR AS n FROM fd)")
def export_manifest(spark, d):
    from chronotext.sources.sinks import export_manifest as manifest

    return manifest(files_docs(spark, d))


@query("SELECT CASE event_type WHEN 'signup' THEN 'NEW' WHEN 'view' THEN 'AUDIO_READY' WHEN 'click' THEN 'TRANSCRIBED' WHEN 'purchase' THEN 'DONE' WHEN 'error' THEN 'FAILED' END AS state, count(*) AS n FROM events GROUP BY 1")
def sessions_by_state(spark, d):
    return sess_events(spark, d).groupBy("state").agg(F.count("*").alias("n"))


@query(EVENTS + " SELECT session_id, state, strftime(start_time, '%Y-%m-%d') AS date FROM ev WHERE state = 'DONE' ORDER BY start_time::DATE DESC, session_id DESC LIMIT 100")
def session_topn(spark, d):
    s = sess_events(spark, d).where("state = 'DONE'").select("session_id", "state", F.date_format("start_time", "yyyy-MM-dd").alias("date"))
    return s.orderBy(F.desc("date"), F.desc("session_id")).limit(100)


@query(EVENTS + " SELECT * FROM ev WHERE session_id = 42")
def get_session(spark, d):
    return sess_events(spark, d).where("session_id = 42")


@query(EVENTS + """, e AS (SELECT session_id, course_key, CASE WHEN session_id % 10 <> 0 THEN start_time END AS st FROM ev)
SELECT session_id, course_key, CASE WHEN st IS NULL THEN 1 + count(st) OVER (PARTITION BY course_key) ELSE rank() OVER (PARTITION BY course_key ORDER BY st NULLS LAST) END AS number FROM e""")
def course_sequence(spark, d):
    s = sess_events(spark, d).select("session_id", "course_key", F.when(F.col("session_id") % 10 != 0, F.col("start_time")).alias("st"))
    return C.course_sequence(s, "course_key", "st").select("session_id", "course_key", F.col("number").cast("long").alias("number"))


@query("SELECT c_custkey FROM customer WHERE NOT (c_custkey % 4 = 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders))")
def delete_session_guarded(spark, d):
    return C.guarded_delete(table(spark, d, "customer").select("c_custkey"), "c_custkey", F.col("c_custkey") % 4 == 0, table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")))


@query("SELECT CASE WHEN user_id = 3 THEN 4 ELSE user_id END AS session_id, count(*) AS n FROM events GROUP BY 1")
def rename_session(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("session_id"))
    _, moved = C.rename([e.distinct(), e], "session_id", 3, 4)
    return moved.groupBy("session_id").agg(F.count("*").alias("n"))


@query("SELECT 'files.unique' AS rule, sha256(coalesce(text, '')) AS item FROM documents GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'processing.session_id', o_custkey::VARCHAR FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 50 <> 0)")
def index_constraints(spark, d):
    p = proc_orders(spark, d)
    return C.key_violations(files_docs(spark, d), ["sha256"], "files").unionByName(C.reference_violations(p, table(spark, d, "customer").where("c_custkey % 50 <> 0"), "session_id", "c_custkey", "processing"))


_MATCH = """, m AS (SELECT session_id, slot_course, greatest(0, start_min - mi, mi - end_min) AS dist, course_ord, slot_ord FROM (SELECT *, isodow(start_time) AS wd, hour(start_time) * 60 + minute(start_time) AS mi FROM ev) e JOIN sc ON wd = weekday AND mi BETWEEN start_min - 30 AND end_min + 30),
mm AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY dist, course_ord, slot_ord) AS rn FROM m)"""


@query(EVENTS + _MATCH + " SELECT ev.session_id, coalesce(slot_course, -1)::INTEGER AS matched, dist::INTEGER AS distance FROM ev LEFT JOIN mm ON ev.session_id = mm.session_id AND rn = 1")
def timetable_match(spark, d):
    m = C.match_slots(sess_events(spark, d), schedule(spark, d), CFG.match_tolerance_minutes, default=-1)
    return m.select("session_id", "matched", F.col("distance").cast("int").alias("distance"))


@query(EVENTS + " SELECT ev.session_id, min(slot_ord) AS slot FROM ev LEFT JOIN sc ON course_key = slot_course AND isodow(start_time) = weekday AND hour(start_time) * 60 + minute(start_time) BETWEEN start_min - 30 AND end_min + 30 GROUP BY ev.session_id")
def first_slot(spark, d):
    return C.first_slot(sess_events(spark, d), schedule(spark, d)).select("session_id", "slot")


@query(EVENTS + " SELECT session_id, isodow(start_time)::INTEGER AS weekday, (hour(start_time) * 60 + minute(start_time))::INTEGER AS minutes FROM ev")
def weekday_minutes(spark, d):
    return sess_events(spark, d).select("session_id", (F.weekday("start_time") + 1).alias("weekday"), (F.hour("start_time") * 60 + F.minute("start_time")).alias("minutes"))


_CHAINS = """, sl AS (SELECT ev.*, (SELECT min(slot_ord) FROM sc WHERE course_key = slot_course AND isodow(start_time) = weekday AND hour(start_time) * 60 + minute(start_time) BETWEEN start_min - 30 AND end_min + 30) AS slot FROM ev WHERE state IN ('TRANSCRIBED', 'DONE')),
gp AS (SELECT *, start_sec - lag(start_sec + duration_sec) OVER w AS gap FROM sl WINDOW w AS (PARTITION BY start_time::DATE, course_key, slot ORDER BY start_sec, session_id)),
nb AS (SELECT *, CASE WHEN gap BETWEEN 0 AND CASE WHEN slot IS NULL THEN 300 ELSE 900 END THEN 0 ELSE 1 END AS new FROM gp),
cn AS (SELECT *, sum(new) OVER (PARTITION BY start_time::DATE, course_key, slot ORDER BY start_sec, session_id ROWS UNBOUNDED PRECEDING) - 1 AS chain FROM nb),
chains AS (SELECT *, count(*) OVER (PARTITION BY start_time::DATE, course_key, slot, chain) AS chain_length FROM cn)"""


def _chains(spark, d):
    s = C.first_slot(sess_events(spark, d).where(F.col("state").isin(*C.MERGEABLE)), schedule(spark, d))
    limit = F.when(F.col("slot").isNull(), CFG.unscheduled_gap_seconds).otherwise(CFG.scheduled_gap_seconds)
    return S.gap_chains(s, [F.to_date("start_time"), F.col("course_key"), F.col("slot")], limit)


@query(EVENTS + _CHAINS + " SELECT session_id, course_key, chain::BIGINT AS chain, chain_length, gap FROM chains")
def recording_chains(spark, d):
    return _chains(spark, d).select("session_id", "course_key", "chain", "chain_length", "gap")


_WIDE = """, gp AS (SELECT *, start_sec - lag(start_sec + duration_sec) OVER w AS gap, start_sec - first_value(start_sec) OVER w AS off FROM ev WINDOW w AS (PARTITION BY course_key, start_time::DATE ORDER BY start_sec, session_id))"""


def _day_parts(spark, d):
    w = Window.partitionBy("course_key", F.to_date("start_time")).orderBy("start_sec", "session_id")
    s = sess_events(spark, d)
    return s.withColumn("gap", F.col("start_sec") - F.lag(F.col("start_sec") + F.col("duration_sec")).over(w)).withColumn("off", F.col("start_sec") - F.first("start_sec").over(w))


@query(EVENTS + _WIDE + " SELECT session_id, off AS offset_sec, CASE WHEN greatest(0, coalesce(gap, 0)) >= 20 THEN greatest(0, gap) ELSE 0 END::DOUBLE AS gap_before FROM gp WHERE coalesce(gap, 0) BETWEEN -1 AND 2400")
def merge_offsets(spark, d):
    gap = F.greatest(F.lit(0.0), F.coalesce("gap", F.lit(0.0)))
    p = _day_parts(spark, d).where(F.coalesce("gap", F.lit(0.0)).between(-1, CFG.max_gap_seconds))
    return p.select("session_id", F.col("off").alias("offset_sec"), F.when(gap >= CFG.min_gap_seconds, gap).otherwise(0.0).alias("gap_before"))


@query(EVENTS + _WIDE + " SELECT session_id, 'overlap' AS rule FROM gp WHERE gap < -1 UNION ALL SELECT session_id, 'gap' FROM gp WHERE gap > 2400 UNION ALL SELECT session_id, 'state' FROM gp WHERE state NOT IN ('TRANSCRIBED', 'DONE')")
def merge_violations(spark, d):
    named = (("overlap", F.col("gap") < -1), ("gap", F.col("gap") > CFG.max_gap_seconds), ("state", ~F.col("state").isin(*C.MERGEABLE)))
    return _day_parts(spark, d).select("session_id", F.explode(F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in named)), lambda x: x.isNotNull())).alias("rule"))


@query(EVENTS + _CHAINS + """ SELECT course_key, strftime(start_time, '%Y-%m-%d') AS date, coalesce(slot, -1) AS slot, chain::BIGINT AS chain, session_id, (row_number() OVER (PARTITION BY course_key, start_time::DATE, slot, chain ORDER BY start_sec, session_id) - 1)::INTEGER AS new_id,
 (start_sec - min(start_sec) OVER (PARTITION BY course_key, start_time::DATE, slot, chain))::BIGINT AS shifted FROM chains WHERE chain_length >= 2""")
def merged_timeline(spark, d):
    c = _chains(spark, d).where("chain_length >= 2").withColumn("date", F.date_format("start_time", "yyyy-MM-dd")).withColumn("slot", F.coalesce("slot", F.lit(-1)))
    keys = ["course_key", "date", "slot", "chain"]
    c = c.withColumn("shifted", F.col("start_sec") - F.min("start_sec").over(Window.partitionBy(*keys)))
    return S.reindex(c, keys, "start_sec", "session_id").select(*keys, "session_id", "new_id", "shifted")


@query(EVENTS + " SELECT session_id FROM ev WHERE state IN ('TRANSCRIBED', 'DONE') AND session_id % 8 <> 0 AND duration_sec >= 60")
def merge_eligibility(spark, d):
    s = sess_events(spark, d).withColumn("merged_into", F.when(F.col("session_id") % 8 == 0, "x"))
    return s.where(F.col("state").isin(*C.MERGEABLE) & F.col("start_time").isNotNull() & F.col("merged_into").isNull() & (F.col("duration_sec") >= CFG.min_audio_seconds)).select("session_id")


@query(EVENTS + " SELECT session_id, state IN ('AUDIO_READY', 'TRANSCRIBING') AS pending, duration_sec < 60 AS too_short FROM ev")
def pending_work(spark, d):
    return sess_events(spark, d).select("session_id", F.col("state").isin(*C.PENDING).alias("pending"), (F.col("duration_sec") < CFG.min_audio_seconds).alias("too_short"))


@query(EVENTS + """, w AS (SELECT session_id, start_time::DATE + to_minutes((end_min + 30)::BIGINT) AS until FROM ev JOIN sc ON course_key = slot_course AND isodow(start_time) = weekday AND hour(start_time) * 60 + minute(start_time) BETWEEN start_min - 30 AND end_min + 30)
SELECT ev.session_id, coalesce(TIMESTAMP '2024-01-16 12:00:00' < until, false) AS waiting, state IN ('TRANSCRIBED', 'DONE') AND NOT coalesce(TIMESTAMP '2024-01-16 12:00:00' < until, false) AS eligible FROM ev LEFT JOIN w USING (session_id)""")
def waiting_for_siblings(spark, d):
    now = F.lit("2024-01-16 12:00:00").cast("timestamp")
    sl = schedule(spark, d)
    s = C.first_slot(sess_events(spark, d), sl).join(sl.select(F.col("slot_course").alias("course_key"), F.col("slot_ord").alias("slot"), "end_min"), ["course_key", "slot"], "left")
    until = F.date_trunc("day", "start_time") + F.make_dt_interval(mins=F.col("end_min") + CFG.grace_minutes)
    s = s.withColumn("waiting", F.coalesce(now < until, F.lit(False)))
    return s.select("session_id", "waiting", (F.col("state").isin(*C.AUTOPILOT) & ~F.col("waiting")).alias("eligible"))


_MOVES = ", mv AS (SELECT session_id, lag(state) OVER (PARTITION BY course_key ORDER BY start_time, session_id) AS current, state AS target FROM ev)"
_EDGES = ", ".join(f"('{a}', '{b}')" for a, v in C.TRANSITIONS.items() for b in v.split())


@query(EVENTS + _MOVES + f" SELECT session_id, current, target FROM mv WHERE current IS NOT NULL AND current <> target AND (current, target) NOT IN (VALUES {_EDGES})")
def state_transition_violations(spark, d):
    s = sess_events(spark, d).select("session_id", "course_key", "start_time", "state")
    m = S.followed(s, ["course_key"], [F.col("start_time"), F.col("session_id")], "state", "current").where("current IS NOT NULL")
    return C.illegal_transitions(m.select("session_id", "current", F.col("state").alias("target")))


@query(EVENTS + " SELECT session_id, CASE WHEN state = 'FAILED' THEN CASE WHEN session_id % 2 = 0 THEN 'TRANSCRIBING' ELSE 'AUDIO_READY' END ELSE state END AS state FROM ev")
def failure_restore(spark, d):
    return sess_events(spark, d).select("session_id", I.restored_state(F.col("state"), F.when(F.col("session_id") % 2 == 0, "TRANSCRIBING")).alias("state"))


@query("WITH n AS (SELECT n_nationkey AS device, CASE WHEN n_nationkey % 3 <> 0 THEN n_name END AS name FROM nation) SELECT s_suppkey, coalesce(name, left(s_name, 7)) AS device_name FROM supplier LEFT JOIN n ON s_nationkey = device")
def device_names(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.when(F.col("n_nationkey") % 3 != 0, F.col("n_name")).alias("name"))
    return table(spark, d, "supplier").join(n, "s_nationkey", "left").select("s_suppkey", F.coalesce("name", F.left("s_name", F.lit(7))).alias("device_name"))


@query("SELECT p_partkey FROM part WHERE lower(p_name) NOT IN (SELECT lower(p_name) FROM part WHERE p_partkey % 90 = 0)")
def unassigned_images(spark, d):
    p = table(spark, d, "part").withColumn("k", F.lower("p_name"))
    return p.join(p.where("p_partkey % 90 = 0").select("k").distinct(), "k", "left_anti").select("p_partkey")


@query("SELECT user_id, arg_max(event_id, ts) AS latest, max(ts) AS ts, count(*) FILTER (event_type = 'error' AND ts >= TIMESTAMP '2024-01-31' - INTERVAL 15 DAY) AS crashes FROM events GROUP BY user_id")
def latest_file(spark, d):
    e = table(spark, d, "events")
    since = F.lit("2024-01-31").cast("timestamp") - F.make_dt_interval(days=F.lit(15))
    return e.groupBy("user_id").agg(F.max_by("event_id", "ts").alias("latest"), F.max("ts").alias("ts"), F.count_if((F.col("event_type") == "error") & (F.col("ts") >= since)).alias("crashes"))


@query(FILES + " SELECT sum(size)::BIGINT AS bytes, count(*) AS n FROM fd")
def tree_size(spark, d):
    return files_docs(spark, d).agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))


@query(FILES + """, m AS (SELECT session_id, path, CASE WHEN seq % 97 = 0 AND session_id = 3 THEN 'old' ELSE sha256 END AS sha256 FROM fd WHERE NOT (session_id = 5 AND seq % 61 = 0)),
x AS (SELECT session_id, path, sha256, 1 AS a, NULL AS b FROM fd UNION ALL SELECT session_id, path, sha256, NULL, 1 FROM m), g AS (SELECT session_id, path, sha256, max(a) AS a, max(b) AS b FROM x GROUP BY ALL) SELECT session_id, bool_or(a IS NULL OR b IS NULL) AS rebuild FROM g GROUP BY session_id""")
def package_rebuild(spark, d):
    f = files_docs(spark, d)
    old = f.where(~((F.col("session_id") == 5) & (F.col("seq") % 61 == 0))).withColumn("sha256", F.when((F.col("seq") % 97 == 0) & (F.col("session_id") == 3), "old").otherwise(F.col("sha256")))
    return I.rebuild_needed(f, old)


_LAYERS = FILES + """, la AS (SELECT seq AS session_id, 'raw' AS layer, NULL AS upstream, sha256, NULL AS source_sha256 FROM fd UNION ALL SELECT seq, 'repaired', 'raw', sha256(sha256), CASE WHEN seq % 9 = 0 THEN 'x' ELSE sha256 END FROM fd WHERE seq % 4 <> 1
 UNION ALL SELECT seq, 'cleaned', 'repaired', sha256(sha256 || 'c'), sha256(sha256) FROM fd)"""


def _layers(spark, d):
    f = files_docs(spark, d)
    row = lambda layer, up, sha, src: f.select(F.col("seq").alias("session_id"), F.lit(layer).alias("layer"), F.lit(up).cast("string").alias("upstream"), sha.alias("sha256"), src.alias("source_sha256"), "seq")
    s = F.col("sha256")
    raw = row("raw", None, s, F.lit(None).cast("string"))
    rep = row("repaired", "raw", F.sha2(s, 256), F.when(F.col("seq") % 9 == 0, "x").otherwise(s)).where("seq % 4 <> 1")
    return raw.unionByName(rep).unionByName(row("cleaned", "repaired", F.sha2(F.concat(s, F.lit("c")), 256), F.sha2(s, 256))).drop("seq")


@query(_LAYERS + " SELECT l.session_id, CASE WHEN u.sha256 IS NULL THEN 'missing_upstream' ELSE 'stale' END AS rule, l.layer AS item_id FROM la l LEFT JOIN la u ON l.session_id = u.session_id AND l.upstream = u.layer WHERE l.upstream IS NOT NULL AND (u.sha256 IS NULL OR u.sha256 <> l.source_sha256)")
def provenance_stale(spark, d):
    return V.provenance_violations(_layers(spark, d))


@query(_LAYERS + ", cu AS (SELECT session_id, layer, CASE WHEN session_id % 6 = 0 THEN 'new' ELSE sha256 END AS fp FROM la) SELECT la.session_id, la.layer FROM la LEFT JOIN cu ON la.session_id = cu.session_id AND la.layer = cu.layer AND la.sha256 = cu.fp WHERE la.layer <> 'raw' AND cu.fp IS NULL")
def stale_outputs(spark, d):
    la = _layers(spark, d).withColumn("fingerprint", F.col("sha256"))
    cu = la.withColumn("fingerprint", F.when(F.col("session_id") % 6 == 0, "new").otherwise(F.col("fingerprint"))).select("session_id", "layer", "fingerprint")
    return I.stale_outputs(la, cu).select("session_id", "layer")


@query(_LAYERS + " SELECT session_id, layer, sha256 FROM la WHERE (session_id, layer, sha256) NOT IN (SELECT session_id, layer, sha256 FROM la WHERE session_id % 3 <> 0)")
def output_reuse(spark, d):
    la = _layers(spark, d)
    return I.pending(la, la.where("session_id % 3 <> 0"), ["session_id", "layer", "sha256"]).select("session_id", "layer", "sha256")


@query("WITH c AS (SELECT o_orderkey % 5000 AS k, min(o_totalprice) AS v FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1), n AS (SELECT o_orderkey % 5000 AS k, max(o_totalprice) AS v FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) SELECT coalesce(c.k, n.k) AS cache_key, CASE WHEN c.k IS NOT NULL THEN c.v ELSE n.v END AS response FROM c FULL JOIN n ON c.k = n.k")
def canary_promotion(spark, d):
    o = table(spark, d, "orders").withColumn("cache_key", F.col("o_orderkey") % 5000)
    cache = o.where("o_orderkey % 3 = 0").groupBy("cache_key").agg(F.min("o_totalprice").alias("response"))
    canary = o.where("o_orderkey % 2 = 0").groupBy("cache_key").agg(F.max("o_totalprice").alias("response"))
    return I.promoted(cache, canary)


@query("WITH c AS (SELECT o_orderkey % 5000 AS k, min(o_orderpriority) AS v FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1) SELECT o_orderkey, coalesce(v, upper(o_orderstatus)) AS response, v IS NOT NULL AS cached FROM orders LEFT JOIN c ON o_orderkey % 5000 = k")
def unit_cache(spark, d):
    o = table(spark, d, "orders").withColumn("cache_key", F.col("o_orderkey") % 5000)
    cache = o.where("o_orderkey % 3 = 0").groupBy("cache_key").agg(F.min("o_orderpriority").alias("response"))
    units = o.select("o_orderkey", "o_orderstatus", "cache_key")
    return I.with_cache(units, cache, lambda miss: miss.withColumn("response", F.upper("o_orderstatus"))).select("o_orderkey", "response", "cached")


@query("SELECT o_custkey, 'web-' || left(sha256(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey::VARCHAR)), 16) AS batch FROM orders GROUP BY o_custkey")
def batch_identity(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(I.batch_id(F.collect_list(F.col("o_orderkey").cast("string"))).alias("batch"))


@query("""SELECT l_returnflag AS stage, count(*) FILTER (l_linenumber > 1) AS api_calls, count(*) FILTER (l_linenumber = 1) AS cache_hits, count(*) AS requests, count(*) FILTER (l_linestatus = 'F' AND l_linenumber > 1) AS failures,
 sum(l_quantity) FILTER (l_linenumber > 1) AS input_tokens, sum(l_quantity) FILTER (l_linenumber = 1) AS saved_tokens FROM lineitem GROUP BY l_returnflag""")
def usage_accounting(spark, d):
    li = table(spark, d, "lineitem")
    hit = F.col("l_linenumber") == 1
    return li.groupBy(F.col("l_returnflag").alias("stage")).agg(F.count_if(~hit).alias("api_calls"), F.count_if(hit).alias("cache_hits"), F.count("*").alias("requests"), F.count_if((F.col("l_linestatus") == "F") & ~hit).alias("failures"), F.sum(F.when(~hit, F.col("l_quantity"))).alias("input_tokens"), F.sum(F.when(hit, F.col("l_quantity"))).alias("saved_tokens"))


@query("SELECT l_returnflag AS provider, avg(l_quantity) AS mean_rtf, max(l_quantity) AS best_rtf, 90 / max(l_quantity) AS minutes_for_90 FROM lineitem GROUP BY l_returnflag")
def bench_projection(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupBy(F.col("l_returnflag").alias("provider")).agg(F.avg("l_quantity").alias("mean_rtf"), F.max("l_quantity").alias("best_rtf"), (90 / F.max("l_quantity")).alias("minutes_for_90"))
