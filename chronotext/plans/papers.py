"""Queries over rendered documents, prompts, merges of recordings, usage and returned packages; every rule has rows that break it."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronotext.config import MergeConfig
from chronotext.functions import markdown as M
from chronotext.operators import catalog as C
from chronotext.operators import incremental as I
from chronotext.operators import merge as MG
from chronotext.operators import sequence as S
from chronotext.operators import validate as V
from chronotext.sources import draft as D
from chronotext.sources import sinks as K
from chronotext.sources.bindings import durations, seg_docs, table

from .base import SEG, query
from .replies import draft_replies, knowledge_replies, outline_replies, with_counts


def _clock(x: str) -> str:
    s = f"round_even({x}, 0)::BIGINT"
    return f"(lpad(({s} // 3600)::VARCHAR, greatest(2, length(({s} // 3600)::VARCHAR))::INTEGER, '0') || ':' || lpad(({s} % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad(({s} % 60)::VARCHAR, 2, '0'))"


def _quoted(*lines: str) -> str:
    return " || chr(10) || ".join("'" + x.replace("'", "''") + "'" if x else "''" for x in lines)


_DRAFT = f""", tp AS (SELECT session_id, id // 5 AS k, list(id ORDER BY id) AS ids, list(seg_start ORDER BY id) AS starts, min(seg_start) AS a, max(seg_end) AS b FROM seg GROUP BY ALL),
tl AS (SELECT session_id, k, {_clock('a')} || '–' || {_clock('b')} AS span, ids, starts FROM tp),
sc AS (SELECT session_id, string_agg('- [' || span || '] Topic', chr(10) ORDER BY k) AS frame, string_agg(chr(10) || '## ' || (k + 1) || '. H' || chr(10) || chr(10) || '`{D.AUDIO} ' || span || '` 〔segments: ' || array_to_string(ids, ', ') || '〕' || chr(10) || chr(10) || 'S' || chr(10)
 || chr(10) || '### {D.HEADINGS["concepts"]}' || chr(10) || chr(10) || '- **N**：E 〔segments: ' || ids[1] || '〕' || chr(10) || chr(10) || '### {D.HEADINGS["equations"]}' || chr(10) || chr(10) || '- **N**：$x=1$ 〔segments: ' || ids[1] || '〕' || chr(10)
 || chr(10) || '### {D.HEADINGS["derivations"]}' || chr(10) || chr(10) || '**N** 〔segments: ' || ids[1] || '〕' || chr(10) || chr(10) || '1. a' || chr(10) || '2. b' || chr(10) || chr(10) || '{D.RESULT}Z' || chr(10)
 || CASE WHEN len(ids) > 1 THEN chr(10) || chr(10) || '{D.UNCHECKED_SOUND}' || chr(10) || '> C 〔segments: ' || ids[2] || '〕' || chr(10) || '{D.REASON}R' ELSE '' END
 || CASE WHEN len(ids) > 2 THEN chr(10) || chr(10) || '{D.MISSING_VISUAL}' || chr(10) || '> [' || {_clock('starts[3]')} || '] X' || chr(10) || '{D.KIND}board{D.UNRESOLVED}〔segments: ' || ids[3] || '〕' ELSE '' END, chr(10) ORDER BY k) AS body FROM tl GROUP BY session_id)"""


@query(SEG + _DRAFT + f""" SELECT session_id, CASE WHEN session_id % 50 <> 7 THEN '---' || chr(10) || 'course: "c ' || session_id || '"' || chr(10) || 'date: "2024-01-02"' || chr(10) || 'session_id: "' || session_id || '"' || chr(10) || {_quoted('source_layer: AUDIO_ONLY', 'final: false', '---', '', '# T', '', *D.WARNING, '', D.FRAME, '')} || chr(10) || frame || chr(10) || body || chr(10)
 || {_quoted('', D.CLOSING, '', '- C 〔segments: 0〕', '', *D.FOOTER)} END AS markdown, session_id % 50 = 7 AS refused FROM sc""")
def audio_draft_document(spark, d):
    seg = with_counts(seg_docs(spark, d))
    course = F.concat(F.lit("c "), F.col("session_id").cast("string"), F.when(F.col("session_id") % 50 == 7, " [[x]]").otherwise(""))
    drafts = draft_replies(seg, {"concepts": ("c", 0), "equations": ("e", 0), "derivations": ("v", 0), "uncertain_items": ("u", 1), "visual_references": ("w", 2)}).select("session_id", course.alias("course"), F.lit("2024-01-02").alias("date"), "response")
    return D.audio_draft(drafts, outline_replies(seg), knowledge_replies(seg))


_LINE = "'`[' || " + _clock("seg_start") + " || ']` ' || text"


@query(SEG + f""", b AS (SELECT session_id, string_agg({_LINE} || chr(10), chr(10) ORDER BY id) AS body, string_agg({_LINE} || CASE WHEN id % 4 = 1 THEN '  ⚠ r1；r2' ELSE '' END || chr(10), chr(10) ORDER BY id) AS doubted FROM seg GROUP BY session_id)
SELECT session_id, 'repaired' AS layer, '---' || chr(10) || 'session_id: ' || session_id || chr(10) || 'course: ' || CASE WHEN session_id % 3 <> 0 THEN 'c1' ELSE '' END || chr(10) || 'date: 2024-01-02' || chr(10) || 'type: transcript_repaired' || chr(10) || 'source: transcript_raw.json' || chr(10) || 'repair_fingerprint: f' || session_id || chr(10) || '---' || chr(10) || chr(10)
 || '# 选择性修复转录 · ' || CASE WHEN session_id % 3 <> 0 THEN 'c1' ELSE session_id::VARCHAR END || chr(10) || chr(10) || '> 检测 ' || (session_id % 9) || ' 个可疑 segments，合并为 ' || (session_id % 7) || ' 个窗口；接受 ' || (session_id % 5) || ' 个修复，拒绝 2 个。' || chr(10) || '> RAW 转录未被覆盖；每个决定见 JSON 的 repair_history。' || chr(10) || chr(10) || body AS markdown FROM b
UNION ALL SELECT session_id, 'clean', '---' || chr(10) || 'session_id: ' || session_id || chr(10) || 'course: ' || CASE WHEN session_id % 3 <> 0 THEN 'c1' ELSE '' END || chr(10) || 'date: 2024-01-02' || chr(10) || 'type: transcript_clean' || chr(10) || 'source_layer: REPAIRED' || chr(10) || 'clean_fingerprint: f' || session_id || chr(10) || '---' || chr(10) || chr(10)
 || '# 忠实清洗转录 · ' || CASE WHEN session_id % 3 <> 0 THEN 'c1' ELSE session_id::VARCHAR END || chr(10) || chr(10) || '> 本文件只做 ASR 纠错、标点与断句，不是课堂摘要。' || chr(10) || chr(10) || doubted FROM b""")
def layer_documents(spark, d):
    seg = seg_docs(spark, d)
    i = F.col("session_id")
    told = seg.select("session_id").distinct().select("session_id", F.when(i % 3 != 0, "c1").alias("course"), F.lit("2024-01-02").alias("date"), F.concat(F.lit("f"), i.cast("string")).alias("fingerprint"), (i % 9).alias("regions"), (i % 7).alias("windows"), (i % 5).alias("accepted"), F.lit(2).alias("rejected"), F.lit("REPAIRED").alias("source_layer"))
    doubted = seg.withColumn("uncertain", F.when(F.col("id") % 4 == 1, F.array(F.lit("r1"), F.lit("r2"))).otherwise(F.array().cast("array<string>")))
    return K.layer_markdown(told, seg, "repaired").withColumn("layer", F.lit("repaired")).unionByName(K.layer_markdown(told, doubted, "clean").withColumn("layer", F.lit("clean")))


@query(SEG + f""", pl AS (SELECT session_id, duration, unnest(range(ceil(duration / 480)::BIGINT)) AS chunk FROM dura), pw AS (SELECT session_id, chunk, greatest(0, chunk * 480.0 - 30) AS a, least(duration, least(duration, (chunk + 1) * 480.0) + 30) AS b FROM pl WHERE chunk % 2 = 0),
h AS (SELECT pw.session_id, chunk, a, b, string_agg({_LINE} || CASE WHEN id % 4 = 1 THEN '  ⚠ r1；r2' ELSE '' END || chr(10), chr(10) ORDER BY id) AS doubted, string_agg({_LINE} || chr(10), chr(10) ORDER BY id) AS body, count(*) AS n FROM pw JOIN seg ON seg.session_id = pw.session_id AND seg_end > a AND seg_start < b GROUP BY ALL)
SELECT session_id, chunk, 'RAW' AS layer, '# RAW Canary · chunk ' || lpad(chunk::VARCHAR, 3, '0') || chr(10) || chr(10) || '> window ' || {_clock('a')} || '–' || {_clock('b')} || ' · segments=' || n || chr(10) || chr(10) || body AS markdown FROM h
UNION ALL SELECT session_id, chunk, 'CLEANED', '# CLEANED Canary · chunk ' || lpad(chunk::VARCHAR, 3, '0') || chr(10) || chr(10) || '> provider=p · model=m' || (chunk % 2) || ' · window ' || {_clock('a')} || '–' || {_clock('b')} || chr(10) || chr(10) || doubted FROM h""")
def canary_documents(spark, d):
    seg = seg_docs(spark, d)
    plans = S.chunk_plan(durations(seg)).where("chunk % 2 = 0").select("session_id", "chunk", "window_start", "window_end")
    doubted = seg.withColumn("uncertain", F.when(F.col("id") % 4 == 1, F.array(F.lit("r1"), F.lit("r2"))).otherwise(F.array().cast("array<string>")))
    by = F.concat(F.lit("provider=p · model=m"), (F.col("chunk") % 2).cast("string"))
    return K.canary_markdown(plans, seg, "RAW").withColumn("layer", F.lit("RAW")).unionByName(K.canary_markdown(plans, doubted, "CLEANED", by).withColumn("layer", F.lit("CLEANED")))


_TEMPLATE = "Mode {{mode}} of {{course_name}}.\nTerms: {{glossary}}\n{{segments_json}}\nBefore: {{boundary_context}}"


@query(SEG + """, p AS (SELECT session_id, id // 20 AS chunk, '[' || chr(10) || string_agg('  {' || chr(10) || '    "id": ' || id || ',' || chr(10) || '    "text": ' || to_json(text) || chr(10) || '  }', ',' || chr(10) ORDER BY id) || chr(10) || ']' AS js FROM seg GROUP BY ALL)
SELECT session_id, chunk, CASE WHEN session_id % 10 <> 9 THEN 'Mode clean of c' || (session_id % 4) || '.' || chr(10) || 'Terms: ' || CASE WHEN session_id % 2 = 0 THEN 'a、b' ELSE '（无）' END || chr(10) || js || chr(10) || 'Before: ' || CASE WHEN chunk > 0 THEN 'chunk ' || (chunk - 1) ELSE '无' END END AS prompt FROM p""")
def clean_prompts(spark, d):
    seg = seg_docs(spark, d).groupBy("session_id", F.floor(F.col("id") / 20).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("id", "text"))).alias("rows"))
    i, c = F.col("session_id"), F.col("chunk")
    terms = F.when(i % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    template = F.when(i % 10 == 9, _TEMPLATE + " {{left_over}}").otherwise(_TEMPLATE)
    before = F.when(c > 0, F.concat(F.lit("chunk "), (c - 1).cast("string"))).otherwise("")
    return seg.select("session_id", "chunk", M.clean_prompt(template, F.lit("clean"), F.concat(F.lit("c"), (i % 4).cast("string")), terms, F.col("rows"), ["id", "text"], before).alias("prompt"))


#: Documents as recordings, three to a request: doc 0 of each begins, and remainders of the id break a rule each.
_REC = """WITH s AS (SELECT doc_id AS session_id, doc_id // 3 AS request_id, (doc_id // 3) % 20 AS j, doc_id % 3 AS nth FROM documents WHERE doc_id IS NOT NULL),
se AS (SELECT session_id, CASE WHEN j = 3 AND nth = 1 THEN 'NEW' ELSE 'DONE' END AS state, CASE WHEN j = 4 AND nth = 2 THEN NULL ELSE 600000.0 + nth * CASE j WHEN 5 THEN 590 WHEN 6 THEN 4000 WHEN 11 THEN 610 ELSE 700 END END AS start_sec, 600.0 AS duration_sec, CASE WHEN j = 7 AND nth = 1 THEN 'other' ELSE 'c' END AS course_key, CASE WHEN j = 8 AND nth = 2 THEN 'd2' ELSE 'd1' END AS date, CASE WHEN j = 9 AND nth = 0 THEN 'x' END AS merged_into FROM s WHERE NOT (j = 2 AND nth = 1)),
rq AS (SELECT request_id, session_id FROM s WHERE NOT (j = 0 AND nth > 0) UNION ALL SELECT request_id, session_id FROM s WHERE j = 1 AND nth = 1), sg AS (SELECT session_id, j FROM s WHERE NOT (j = 10 AND nth = 1)),
p AS (SELECT request_id, r.session_id, count(*) AS asked FROM rq r GROUP BY ALL), q AS (SELECT p.*, se.* EXCLUDE (session_id), se.session_id IS NOT NULL AS known, start_sec - lag(start_sec + duration_sec) OVER w AS gap, start_sec - first_value(start_sec) OVER w AS off FROM p LEFT JOIN se USING (session_id) WINDOW w AS (PARTITION BY request_id ORDER BY start_sec NULLS LAST, p.session_id)),
v AS (SELECT request_id, unnest(list_filter([CASE WHEN asked > 1 THEN 'repeated' END, CASE WHEN NOT known THEN 'unknown' END, CASE WHEN merged_into IS NOT NULL THEN 'merged' END, CASE WHEN state = 'NEW' THEN 'state' END, CASE WHEN known AND start_sec IS NULL THEN 'no_start' END, CASE WHEN gap < -1 THEN 'overlap' END, CASE WHEN gap > 2400 THEN 'gap' END,
 CASE WHEN known AND session_id NOT IN (SELECT session_id FROM sg) THEN 'no_segments' END], lambda x: x IS NOT NULL)) AS rule, session_id::VARCHAR AS item_id FROM q
 UNION ALL SELECT request_id, unnest(list_filter([CASE WHEN sum(asked) < 2 THEN 'too_few' END, CASE WHEN count(DISTINCT date) > 1 THEN 'several_dates' END, CASE WHEN count(DISTINCT course_key) > 1 THEN 'several_courses' END], lambda x: x IS NOT NULL)), 'request' FROM q GROUP BY request_id),
pl AS (SELECT request_id, session_id, off AS offset_sec, CASE WHEN coalesce(gap, 0) >= 20 THEN gap ELSE 0.0 END AS gap_before FROM q WHERE request_id NOT IN (SELECT request_id FROM v))"""


def _recordings(spark, d):
    i = F.col("doc_id")
    s = table(spark, d, "documents").where(i.isNotNull()).select(i.alias("session_id"), F.floor(i / 3).alias("request_id"), (F.floor(i / 3) % 20).alias("j"), (i % 3).alias("nth"))
    j, nth = F.col("j"), F.col("nth")
    step = F.when(j == 5, 590.0).when(j == 6, 4000.0).when(j == 11, 610.0).otherwise(700.0)
    sessions = s.where(~((j == 2) & (nth == 1))).select(
        "session_id", F.when((j == 3) & (nth == 1), "NEW").otherwise("DONE").alias("state"), F.when(~((j == 4) & (nth == 2)), 600000.0 + nth * step).alias("start_sec"), F.lit(600.0).alias("duration_sec"),
        F.when((j == 7) & (nth == 1), "other").otherwise("c").alias("course_key"), F.when((j == 8) & (nth == 2), "d2").otherwise("d1").alias("date"), F.when((j == 9) & (nth == 0), "x").alias("merged_into"),
    )
    requests = s.where(~((j == 0) & (nth > 0))).unionByName(s.where((j == 1) & (nth == 1))).select("request_id", "session_id")
    spoken = s.where(~((j == 10) & (nth == 1))).select("session_id", F.explode(F.array(F.struct(F.lit(0.0).alias("a"), F.lit("one").alias("text")), F.struct(F.lit(300.0).alias("a"), F.lit("two").alias("text")))).alias("x"))
    return requests, sessions, spoken.select("session_id", F.col("x.a").alias("seg_start"), (F.col("x.a") + 300).alias("seg_end"), "x.text")


@query(_REC + " SELECT request_id AS session_id, rule, item_id FROM v")
def merge_request_violations(spark, d):
    return MG.merge_violations(*_recordings(spark, d), MergeConfig())


@query(_REC + """ SELECT request_id, 'segment' AS kind, a + offset_sec AS seg_start, a + 300 + offset_sec AS seg_end, text FROM pl, (VALUES (0.0, 'one'), (300.0, 'two')) x(a, text) UNION ALL SELECT request_id, 'gap', offset_sec - gap_before, offset_sec, NULL FROM pl WHERE gap_before > 0""")
def merged_recordings(spark, d):
    requests, sessions, seg = _recordings(spark, d)
    return MG.merged_segments(MG.merge_plan(requests, sessions, seg, MergeConfig()), seg)


@query("""WITH r AS (SELECT conv_id AS session_id, turn % 3 = 0 AS chunk, turn % 4 <> 1 AS asked, (conv_id + turn) % 5 = 0 AS hit, CASE WHEN turn % 2 = 0 THEN 'openai' ELSE 'web' END AS provider, CASE turn % 3 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE 2 END AS attempts, turn % 2 AS failed, length(coalesce(text, '')) AS n FROM conversations),
c AS (SELECT * FROM r WHERE chunk OR asked) SELECT session_id, coalesce(sum(n) FILTER (NOT hit), 0)::BIGINT AS input_tokens, coalesce(sum(n // 2) FILTER (NOT hit), 0)::BIGINT AS output_tokens, coalesce(sum(n + n // 2) FILTER (NOT hit), 0)::BIGINT AS total_tokens, coalesce(sum(4 * n) FILTER (NOT hit), 0)::BIGINT AS input_chars, 0::BIGINT AS output_chars, count(*) FILTER (NOT hit AND provider = 'web') AS web_turns,
 count(*) FILTER (NOT hit) AS llm_calls, count(*) FILTER (NOT hit AND provider = 'openai') AS api_calls, count(*) FILTER (hit) AS cache_hits, coalesce(sum(coalesce(nullif(attempts, 0), 1)) FILTER (NOT hit), 0)::BIGINT AS requests_total, count(*) FILTER (NOT hit) AS successful_requests, coalesce(sum(failed) FILTER (NOT hit), 0)::BIGINT AS failed_requests, coalesce(sum(n + n // 2) FILTER (NOT hit), 0) > 0 AS token_usage_available FROM c GROUP BY session_id""")
def usage_counters(spark, d):
    t, n = F.col("turn"), F.length(F.coalesce("text", F.lit("")))
    web = F.when(t % 2 == 0, "openai").otherwise("web")
    half = F.floor(n / 2)
    rows = table(spark, d, "conversations").select(
        F.col("conv_id").alias("session_id"), F.when(t % 3 == 0, "chunk").otherwise("boundary").alias("stage"), (t % 4 != 1).alias("llm_called"), ((F.col("conv_id") + t) % 5 == 0).alias("cache_hit"), web.alias("provider"), F.when(t % 3 == 1, 0).when(t % 3 == 2, 2).alias("attempt_count"), (t % 2).alias("failed_attempts"),
        n.alias("input_tokens"), half.alias("output_tokens"), (n + half).alias("total_tokens"), (n * 4).alias("input_chars"), F.lit(None).cast("long").alias("output_chars"), (web == "web").cast("int").alias("web_turns"),
    )
    return I.usage(rows)


#: The fields of a task that must come back as they went out.
_TASK = "pipeline artifact stage index prompt_sha256 schema_sha256 source_layer source_sha256 clean_fingerprint clean_schema_version fingerprint schema_version exchange_name prompt_file schema_file response_file".split()


@query("WITH n AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, '{f}')" for k, f in enumerate(_TASK)) + ") f(k, field)) SELECT doc_id AS session_id, 'not_returned' AS rule FROM documents WHERE doc_id % 40 = 39 UNION ALL SELECT doc_id, 'changed_' || field FROM documents JOIN n ON doc_id % 40 = k UNION ALL SELECT doc_id, 'changed_stage' FROM documents WHERE doc_id % 40 = 30")
def returned_tasks(spark, d):
    i = F.col("session_id")
    docs = table(spark, d, "documents").where("doc_id IS NOT NULL").select(F.col("doc_id").alias("session_id"))
    sent = docs.select("session_id", *(F.when((i % 40 == 30) & F.lit(f == "stage"), F.lit(None).cast("string")).otherwise(F.concat(F.lit(f), i.cast("string"))).alias(f) for f in _TASK))
    back = sent.where(i % 40 != 39).select("session_id", *(F.when(i % 40 == k, "changed").when((i % 40 == 30) & F.lit(f == "stage"), "now there").otherwise(F.col(f)).alias(f) for k, f in enumerate(_TASK)))
    return V.manifest_violations(sent, back, ["session_id"], _TASK).select("session_id", "rule")


_SLOTS = """WITH dc AS (SELECT doc_id AS session_id, doc_id % 25 AS course_key, TIMESTAMP '2024-01-01 00:00:00' + to_minutes((doc_id * 37) % 40320) AS start_time FROM documents WHERE doc_id IS NOT NULL),
sl AS (SELECT n_nationkey AS course, o AS slot_ord, n_nationkey % 7 + 1 AS weekday, 400 + o * 120 + (n_nationkey % 3) * 100 AS a, 500 + o * 120 + (n_nationkey % 3) * 100 AS b FROM nation, (VALUES (0), (1), (2)) t(o)),
hit AS (SELECT session_id, course_key, start_time, min(slot_ord) AS slot FROM dc LEFT JOIN sl ON course_key = course AND isodow(start_time) = weekday AND hour(start_time) * 60 + minute(start_time) BETWEEN a - 30 AND b + 30 GROUP BY ALL)"""


@query(_SLOTS + " SELECT session_id, slot::INTEGER AS slot, slot IS NOT NULL AND TIMESTAMP '2024-01-15 12:00:00' < start_time::DATE + to_minutes((b + 30)::BIGINT) AS waiting FROM hit LEFT JOIN sl ON course_key = course AND slot = slot_ord")
def slots_of_courses(spark, d):
    """Three slots a course, so near to each other that a start can lie in the tolerance of two: the first of them counts, and its end sets the grace."""
    i = F.col("doc_id")
    docs = table(spark, d, "documents").where(i.isNotNull()).select(i.alias("session_id"), (i % 25).alias("course_key"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=((i * 37) % 40320).cast("int"))).alias("start_time"))
    k = F.col("n_nationkey")
    slots = table(spark, d, "nation").select(k, F.explode(F.array(*map(F.lit, range(3)))).alias("slot_ord"))
    start = 400 + F.col("slot_ord") * 120 + (k % 3) * 100
    slots = slots.select(k.alias("slot_course"), "slot_ord", (k % 7 + 1).alias("weekday"), start.alias("start_min"), (start + 100).alias("end_min"))
    own = C.first_slot(docs, slots).join(slots.select(F.col("slot_course").alias("course_key"), F.col("slot_ord").alias("slot"), "end_min"), ["course_key", "slot"], "left")
    until = F.date_trunc("day", "start_time") + F.make_dt_interval(mins=F.col("end_min").cast("int") + MergeConfig().grace_minutes)
    return own.select("session_id", "slot", F.coalesce(F.lit("2024-01-15 12:00:00").cast("timestamp") < until, F.lit(False)).alias("waiting"))


@query(SEG + """, c AS (SELECT session_id, id AS place, CASE WHEN session_id % 6 = 1 AND id = 3 THEN 2 ELSE id END AS id, CASE WHEN session_id % 6 = 2 AND id = 2 THEN 99 WHEN session_id % 6 = 3 AND id = 1 THEN NULL WHEN session_id % 6 = 1 AND id = 3 THEN 2 ELSE id END AS src, CASE WHEN session_id % 6 = 4 AND id = 2 THEN seg_start - 1 ELSE seg_start END AS a, CASE WHEN session_id % 6 = 5 AND id = 1 THEN seg_start - 2 ELSE seg_end END AS b FROM seg),
w AS (SELECT *, lag(b) OVER (PARTITION BY session_id ORDER BY place) AS done, min(place) OVER (PARTITION BY session_id, id) AS first FROM c)
SELECT session_id, id AS item_id, 'provenance' AS rule FROM w WHERE src IS DISTINCT FROM id UNION ALL SELECT session_id, id, 'repeated' FROM w WHERE place > first UNION ALL SELECT session_id, id, 'timeline' FROM w WHERE a < coalesce(done, -1) - 0.001 OR b < a""")
def cleaned_segment_rules(spark, d):
    j, i = F.col("session_id") % 6, F.col("id")
    twice = (j == 1) & (i == 3)
    seg = seg_docs(spark, d).select(
        "session_id", i.alias("place"), F.when(twice, 2).otherwise(i).alias("id"), F.when((j == 2) & (i == 2), 99).when((j == 3) & (i == 1), F.lit(None).cast("int")).when(twice, 2).otherwise(i).alias("source_segment_id"),
        F.when((j == 4) & (i == 2), F.col("seg_start") - 1).otherwise(F.col("seg_start")).alias("seg_start"), F.when((j == 5) & (i == 1), F.col("seg_start") - 2).otherwise(F.col("seg_end")).alias("seg_end"),
    )
    return S.cleaned_violations(seg, ["session_id"])
