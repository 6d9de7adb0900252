"""Queries over what neighbouring chunks share, the queue of unresolved visuals, waiting sessions, fenced answers and missing layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronotext.functions import markdown as M
from chronotext.operators import responses as R
from chronotext.operators import validate as V
from chronotext.operators import work as W
from chronotext.sources import files as L
from chronotext.sources.bindings import seg_docs, table

from .base import SEG, query
from .replies import _planted, _topics, knowledge_replies, with_counts

#: Chunks of eight segments and the two behind them; odd chunks add a stop to every third text, and in sessions divisible by 4 they change the ninth.
_CHUNKS = ", ch AS (SELECT session_id, id, text, k FROM seg, LATERAL (SELECT unnest([id // 8, id // 8 - 1]) AS k) WHERE k >= 0 AND (k = id // 8 OR id % 8 < 2)), it AS (SELECT session_id, k AS chunk, id, CASE WHEN k % 2 = 1 AND id % 8 = 1 AND session_id % 4 = 0 THEN text || ' zz' WHEN k % 2 = 1 AND id % 3 = 0 THEN text || '.' ELSE text END AS text, CASE WHEN k % 2 = 0 THEN ['b', ' ', 'a'] ELSE ['c', 'a'] END AS unc, CASE WHEN k % 2 = 0 THEN NULL ELSE ['v'] END AS vis, CASE WHEN k % 2 = 0 THEN 'x' ELSE 'y' END AS fix FROM ch)"
_KEY = r"replace(lower(regexp_replace({0}, '[^\p{{L}}\p{{N}}\p{{M}}_]+', '', 'g')), 'ß', 'ss')"
_PAIRS = f", pr AS (SELECT a.session_id, a.chunk, a.id, trim(a.text) AS l, trim(b.text) AS r, a.unc AS ua, b.unc AS ub, a.vis AS va, b.vis AS vb, a.fix AS fa, b.fix AS fb, max(CASE WHEN {_KEY.format('trim(a.text)')} <> {_KEY.format('trim(b.text)')} THEN 1 ELSE 0 END) OVER (PARTITION BY a.session_id, a.chunk) AS bad FROM it a JOIN it b ON a.session_id = b.session_id AND b.chunk = a.chunk + 1 AND a.id = b.id)"


def _items(spark, d):
    k, i = F.col("chunk"), F.col("id")
    ch = seg_docs(spark, d).withColumn("chunk", F.explode(F.array(F.floor(i / 8), F.floor(i / 8) - 1))).where((k >= 0) & ((k == F.floor(i / 8)) | (i % 8 < 2)))
    odd = k % 2 == 1
    text = F.when(odd & (i % 8 == 1) & (F.col("session_id") % 4 == 0), F.concat("text", F.lit(" zz"))).when(odd & (i % 3 == 0), F.concat("text", F.lit("."))).otherwise(F.col("text"))
    texts = lambda *t: F.array(*map(F.lit, t))
    fix = F.struct(F.when(odd, "y").otherwise("x").alias("original"), F.lit(None).cast("string").alias("corrected"), F.lit("keep").alias("decision"), F.lit("r").alias("reason"))
    return ch.select("session_id", "chunk", "id", text.alias("text"), F.when(odd, texts("c", "a")).otherwise(texts("b", " ", "a")).alias("uncertain"), F.when(odd, texts("v")).alias("visual_references"), F.array(fix, fix).alias("corrections"))


@query(SEG + _CHUNKS + _PAIRS + " SELECT session_id, chunk, id, CASE WHEN length(l) >= length(r) THEN l ELSE r END AS text, 'a|b|c' AS uncertain, 'v' AS visuals, CASE WHEN chunk % 2 = 0 THEN 'x|y' ELSE 'y|x' END AS originals FROM pr WHERE bad = 0")
def boundary_merge(spark, d):
    originals = F.transform("corrections", lambda c: c["original"])
    return V.boundary_merged(_items(spark, d)).select("session_id", "chunk", "id", "text", F.concat_ws("|", "uncertain").alias("uncertain"), F.concat_ws("|", "visual_references").alias("visuals"), F.concat_ws("|", originals).alias("originals"))


@query(SEG + _CHUNKS + _PAIRS + """, own AS (SELECT session_id, id, text FROM it WHERE chunk = id // 8), st AS (SELECT session_id, id, CASE WHEN length(l) >= length(r) THEN l ELSE r END AS text FROM pr WHERE bad = 0)
SELECT own.session_id, own.id, coalesce(st.text, own.text) AS text, CASE WHEN st.text IS NULL THEN 'chunk' ELSE 'boundary' END AS source FROM own LEFT JOIN st ON own.session_id = st.session_id AND own.id = st.id""")
def boundary_overlay(spark, d):
    items = _items(spark, d)
    settled = V.boundary_merged(items).select("session_id", "id", F.col("chunk").alias("boundary"), "text")
    return V.overlay(items.where(F.col("chunk") == F.floor(F.col("id") / 8)).select("session_id", "id", "text"), settled).select("session_id", "id", "text", "source")


QUEUE_FAULTS = {
    0: ('"status":"unresolved"', '"status":"done"', (("items", "status", "w0"),)),
    1: (r'"source_visual_labels":\["x"\]', '"source_visual_labels":[1]', (("items", "labels", "w0"),)),
    2: ('("id":"w0",.*?"context":)"X"', '$1"Y"', (("items", "changed", "w0"),)),
    3: ('("id":"w0",)', '$1"more":1,', (("items", "changed", "w0"),)),
    4: ('"id":"w0"', '"id":"zz"', (("items", "id_unknown", "zz"), ("response", "order", "response"))),
    5: ('("item_count":)', "$19", (("response", "count", "response"),)),
    6: ('("session_id":")', "$1x", (("response", "session", "response"),)),
    7: ('"items":', '"item":', (("response", "keys", "response"),)),
    8: ('"id":"w1"', '"id":"w0"', (("items", "id_repeated", "w0"), ("items", "changed", "w0"), ("response", "order", "response"))),
    9: ('"UNRESOLVED_VISUAL"', '"KNOWLEDGE"', (("response", "session", "response"),)),
}


@query(SEG + ", many AS (SELECT session_id FROM seg GROUP BY session_id HAVING count(*) >= 10), f(j, category, rule, item_id) AS (VALUES " + ", ".join(f"({j}, '{c}', '{r}', '{i}')" for j, (_, _, broken) in QUEUE_FAULTS.items() for c, r, i in broken) + ") SELECT session_id, category, rule, item_id FROM many JOIN f ON session_id % 40 = j")
def unresolved_queue(spark, d):
    seg = with_counts(seg_docs(spark, d))
    ts = F.filter("ts", lambda t: F.size(t["r"]) > 2)
    row = lambda t: F.struct(
        F.concat(F.lit("w"), t["k"].cast("string")).alias("id"), F.concat(F.lit("t"), t["k"].cast("string")).alias("topic_id"), t["r"][2]["seg_start"].alias("timestamp"), F.lit("X").alias("context"), F.lit("board").alias("reference_type"), F.lit(0.5).alias("confidence"),
        F.array(t["r"][2]["id"]).alias("source_segment_ids"), F.array().cast("array<string>").alias("uncertain"), F.lit("unresolved").alias("status"), F.array(F.lit("x")).alias("source_visual_labels"),
    )
    whole = F.struct(F.lit("UNRESOLVED_VISUAL").alias("layer"), F.col("session_id").cast("string").alias("session_id"), F.size(ts).alias("item_count"), F.transform(ts, row).alias("items"))
    queues = _topics(seg).select("session_id", "n", F.to_json(whole).alias("response"))
    once = {j: (f"(?s)^(.*?){p}" if j in (0, 1) else p, f"$1{new}" if j in (0, 1) else new, b) for j, (p, new, b) in QUEUE_FAULTS.items()}
    return R.unresolved_violations(_planted(queues, once), knowledge_replies(seg).select("session_id", "response"))


@query("""WITH t AS (SELECT conv_id AS session_id, turn % 4 AS k, (conv_id + turn) % 3 <> 0 AS task, (conv_id * 5 + turn) % 4 <> 0 AS art FROM conversations)
SELECT session_id FROM t GROUP BY session_id HAVING max(CASE WHEN task AND NOT art THEN 1 ELSE 0 END) = 1 OR (max(CASE WHEN k = 0 AND task THEN 1 ELSE 0 END) = 1 AND max(CASE WHEN k = 3 AND art THEN 1 ELSE 0 END) = 0)""")
def waiting_sessions(spark, d):
    c, t = F.col("conv_id"), F.col("turn")
    stage = F.element_at(F.array(*map(F.lit, W.STAGES)), (t % 4 + 1).cast("int"))
    return W.waiting_sessions(table(spark, d, "conversations").select(c.alias("session_id"), stage.alias("stage"), ((c + t) % 3 != 0).alias("has_task"), ((c * 5 + t) % 4 != 0).alias("has_artefact")))


@query("""WITH x AS (SELECT doc_id, '{"a": ' || doc_id || '}' AS body FROM documents) SELECT doc_id, CASE doc_id % 6 WHEN 4 THEN '```python' || chr(10) || body || chr(10) || '```' WHEN 5 THEN '```json' || chr(10) || body ELSE body END AS answer FROM x""")
def json_answers(spark, d):
    i = F.col("doc_id")
    body = F.concat(F.lit('{"a": '), i.cast("string"), F.lit("}"))
    around = lambda a, b: F.concat(F.lit(a), body, F.lit(b))
    raw = F.when(i % 6 == 0, around(" \n", "\t")).when(i % 6 == 1, around("```json\n", "\n```")).when(i % 6 == 2, around("\n```\n", "\n```  \n")).when(i % 6 == 3, around("```JSON \r\n", "\n  ```")).when(i % 6 == 4, around("```python\n", "\n```")).otherwise(around("```json\n", ""))
    return table(spark, d, "documents").select("doc_id", M.without_json_fence(raw).alias("answer"))


@query("SELECT doc_id AS session_id, CASE WHEN doc_id % 7 = 0 THEN 'no_transcript' WHEN doc_id % 3 = 0 THEN 'repaired' ELSE 'raw' END AS layer FROM documents")
def layer_choice(spark, d):
    i = F.col("session_id")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("session_id"))
    layers = docs.where(i % 7 != 0).withColumn("layer", F.lit("raw")).unionByName(docs.where((i % 7 != 0) & (i % 3 == 0)).withColumn("layer", F.lit("repaired"))).unionByName(docs.withColumn("layer", F.lit("cleaned")))
    layers = layers.withColumn("path", F.concat_ws("/", "layer", i.cast("string")))
    return L.best_layer(layers).select("session_id", "layer").unionByName(L.missing_layers(docs, layers).select("session_id", F.col("rule").alias("layer")))
