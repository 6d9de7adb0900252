"""Queries over pending work, regions, status rows and Markdown."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronotext.functions import markdown as M
from chronotext.operators import work as W
from chronotext.sources.bindings import proc_orders, seg_docs, sess_events, table

from .base import EVENTS, ORDERS, SEG, query

_STAGE = "CASE o_orderkey % 4 WHEN 0 THEN 'clean' WHEN 1 THEN 'structure' WHEN 2 THEN 'knowledge' ELSE 'draft' END"


def _stages(spark, d):
    k = F.col("o_orderkey")
    stage = F.element_at(F.array(*map(F.lit, W.STAGES)), (k % 4 + 1).cast("int"))
    return table(spark, d, "orders").select(F.col("o_custkey").alias("session_id"), stage.alias("stage"), (k % 3 != 0).alias("has_task"), (k % 5 == 0).alias("has_artefact"))


@query(f"WITH t AS (SELECT o_custkey AS session_id, {_STAGE} AS stage, o_orderkey % 4 AS o FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0) SELECT session_id, arg_min(stage, o) AS stage FROM t GROUP BY session_id")
def active_sessions(spark, d):
    return W.active_sessions(_stages(spark, d))


@query(f"WITH t AS (SELECT o_custkey AS session_id, list(DISTINCT {_STAGE}) AS s FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY o_custkey) SELECT session_id, CASE WHEN NOT list_contains(s, 'clean') THEN 'clean' WHEN NOT list_contains(s, 'structure') THEN 'structure' WHEN NOT list_contains(s, 'knowledge') THEN 'knowledge' WHEN NOT list_contains(s, 'draft') THEN 'draft' END AS next FROM t")
def stage_advance(spark, d):
    return W.next_stage(_stages(spark, d).where("NOT has_artefact"))


@query(SEG + ", h AS (SELECT session_id, list(id ORDER BY id) AS ids FROM seg WHERE seg_end > 100 AND seg_start < 130 GROUP BY session_id) SELECT session_id, CASE WHEN session_id % 2 = 0 THEN 7 ELSE -1 END::BIGINT AS region_id, array_to_string(CASE WHEN session_id % 2 = 0 THEN [0] ELSE ids END, ',') AS ids FROM h UNION ALL SELECT session_id, 7, '0' FROM dura WHERE session_id % 2 = 0 AND session_id NOT IN (SELECT session_id FROM h)")
def select_region(spark, d):
    seg = seg_docs(spark, d)
    regions = seg.where("session_id % 2 = 0").select("session_id").distinct().select("session_id", F.lit(7).cast("long").alias("region_id"), F.lit(90.0).alias("seg_start"), F.lit(110.0).alias("seg_end"), F.lit(75.0).alias("window_start"), F.lit(125.0).alias("window_end"), F.array(F.lit(0)).alias("ids"))
    return W.select_region(regions, seg, start=100.0, end=130.0).select("session_id", "region_id", F.concat_ws(",", F.col("ids").cast("array<string>")).alias("ids"))


@query(SEG + ", w AS (SELECT session_id, id, trim(text) AS text, greatest(50.0, seg_start + 50) AS a, least(200.0, seg_end + 50) AS b FROM seg) SELECT session_id, id, a::DOUBLE AS seg_start, b::DOUBLE AS seg_end FROM w WHERE b > a AND text <> ''")
def offset_results(spark, d):
    r = seg_docs(spark, d).withColumn("window_start", F.lit(50.0)).withColumn("window_end", F.lit(200.0))
    return W.offset_results(r).select("session_id", "id", "seg_start", "seg_end")


@query("SELECT DISTINCT c_custkey AS session_id, reason FROM customer JOIN (SELECT o_custkey, 'artefacts' AS reason FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 5 = 0 UNION ALL SELECT o_custkey, 'web_batch' FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 7 = 0) ON c_custkey = o_custkey")
def relabel_guard(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "session_id")
    art = o.where("o_orderkey % 5 = 0").select("session_id", F.when(F.col("o_orderstatus") == "F", "cleaned").otherwise("raw").alias("layer"))
    web = o.where("o_orderkey % 7 = 0").select("session_id", F.when(F.col("o_orderstatus") == "O", "open").otherwise("done").alias("status"))
    return W.relabel_blocked(table(spark, d, "customer").select(F.col("c_custkey").alias("session_id")), art, web)


@query(EVENTS + ", st AS (SELECT DISTINCT user_id * 3 AS session_id, event_type AS step FROM events) SELECT ev.session_id, state, coalesce(string_agg(step, '|' ORDER BY step), '') AS steps FROM ev LEFT JOIN st USING (session_id) GROUP BY ev.session_id, state")
def session_rows(spark, d):
    steps = table(spark, d, "events").select((F.col("user_id") * 3).alias("session_id"), F.col("event_type").alias("step"), F.lit("done").alias("status")).distinct()
    return W.session_rows(sess_events(spark, d), steps).select("session_id", "state", F.coalesce(F.array_join(F.map_keys("steps"), "|"), F.lit("")).alias("steps"))


@query("SELECT doc_id AS session_id, 'raw_changed' AS rule, 'raw' AS item_id FROM documents WHERE doc_id % 31 = 0 OR doc_id % 37 = 0")
def raw_immutability(spark, d):
    f = table(spark, d, "documents").select(F.col("doc_id").alias("session_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    now = f.where("session_id % 37 <> 0").withColumn("sha256", F.when(F.col("session_id") % 31 == 0, "x").otherwise(F.col("sha256")))
    return W.raw_unchanged(f, now)


@query(ORDERS + """ SELECT session_id, seq, CASE WHEN model IS NULL THEN '{"step":"' || step || '"}' ELSE '{"step":"' || step || '","model":"' || model || '"}' END AS audit FROM pr""")
def audit_projection(spark, d):
    p = proc_orders(spark, d)
    return p.select("session_id", "seq", W.audit_fields(F.struct("step", "model"), ["step", "model"]).alias("audit"))


@query(EVENTS + " SELECT session_id, CASE WHEN session_id % 2 = 0 THEN session_id::INTEGER END AS region_id, CASE WHEN session_id % 2 = 1 THEN (session_id % 60)::DOUBLE END AS start_sec, CASE WHEN session_id % 2 = 1 THEN 60.0 + session_id % 60 END::DOUBLE AS end_sec FROM ev")
def parse_regions(spark, d):
    k = F.col("session_id")
    raw = F.when(k % 2 == 0, k.cast("string")).otherwise(F.concat((k % 60).cast("string"), F.lit("-1:"), (k % 60).cast("string")))
    return sess_events(spark, d).select("session_id", W.region_of(raw).alias("r")).select("session_id", "r.region_id", F.col("r.start").alias("start_sec"), F.col("r.end").alias("end_sec"))


@query("SELECT item_id, '---' || chr(10) || 'title: \"' || text || '\"' || chr(10) || 'id: \"' || item_id || '\"' || chr(10) || '---' || chr(10) AS head, text AS body, replace(text, ' the ', ' $x$ ') AS math, 'Ask: ' || text AS prompt FROM benchmark")
def note_texts(spark, d):
    b = table(spark, d, "benchmark")
    t = F.col("text")
    head = M.front_matter(title=t, nothing=F.lit(None).cast("string"), id=F.col("item_id"))
    wrapped = F.concat(F.lit("```markdown\n"), head, t, F.lit("\n```"))
    math = M.dollar_math(F.replace(t, F.lit(" the "), F.lit(r" \( x \) ")))
    return b.select("item_id", head.alias("head"), M.without_front_matter(M.without_fence(wrapped)).alias("body"), math.alias("math"), M.rendered("Ask: {{TEXT}}", TEXT=t).alias("prompt"))
