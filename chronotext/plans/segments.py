"""Queries over timed segments: text measures, runs, windows, interval joins, repairs and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronotext.functions import names as N
from chronotext.functions import text as T
from chronotext.operators import repair as R
from chronotext.operators import sequence as S
from chronotext.operators import validate as V
from chronotext.sources.bindings import durations, seg_conv, seg_docs
from chronotext.sources.sinks import transcript_markdown

from .base import CONV, KEY, SEG, query


@query(SEG + f" SELECT session_id, id, {KEY} AS key, trim(text) = '' AS blank, seg_start, seg_end FROM seg")
def segments_normalize(spark, d):
    return seg_docs(spark, d).select("session_id", "id", T.normalized(F.col("text")).alias("key"), (F.trim("text") == "").alias("blank"), "seg_start", "seg_end")


@query(SEG + f", k AS (SELECT session_id, id, {KEY} AS key FROM seg) SELECT session_id, id, length(key)::INTEGER AS n_chars, octet_length(encode(key))::INTEGER AS n_bytes, len(list_distinct(list_filter(string_split(key, ''), lambda x: x <> '')))::INTEGER AS n_distinct FROM k")
def segments_text_stats(spark, d):
    k = seg_docs(spark, d).withColumn("key", T.normalized(F.col("text")))
    return k.select("session_id", "id", F.length("key").alias("n_chars"), F.octet_length("key").alias("n_bytes"), T.distinct_characters(F.col("key")).alias("n_distinct"))


@query(SEG + f""", k AS (SELECT session_id, id, {KEY} AS key FROM seg),
g AS (SELECT session_id, id, list_transform(range(1, greatest(length(key) - 1, 1)), lambda i: substr(key, i, 3)) AS gs FROM k)
SELECT session_id, id, len(gs)::INTEGER AS n_grams, (len(gs) - len(list_distinct(gs)))::INTEGER AS n_repeated FROM g""")
def char_ngram_stats(spark, d):
    g = seg_docs(spark, d).withColumn("g", T.ngram_counts(T.normalized(F.col("text"))))
    return g.select("session_id", "id", F.col("g.total").alias("n_grams"), F.col("g.repeated").alias("n_repeated"))


@query(SEG + r", x AS (SELECT session_id, id, regexp_extract_all(lower(text), '[a-z]+(?:-[a-z0-9]+)*|\d+|[\x{3400}-\x{9fff}]+') AS ts FROM seg) SELECT session_id, id, len(ts)::INTEGER AS n_tokens, ts[1] AS first_token FROM x")
def token_extract(spark, d):
    t = seg_docs(spark, d).withColumn("ts", T.tokens(F.col("text")))
    return t.select("session_id", "id", F.size("ts").alias("n_tokens"), F.get("ts", F.lit(0)).alias("first_token"))


#: Cues are in Chinese, which the tables don't hold; every third line gets one.
_CUED = "text || CASE id % 6 WHEN 0 THEN '看一下这张图' WHEN 3 THEN '黑板上的公式' ELSE '' END"


def _cued(spark, d):
    return seg_docs(spark, d).withColumn("text", F.concat("text", F.when(F.col("id") % 6 == 0, "看一下这张图").when(F.col("id") % 6 == 3, "黑板上的公式").otherwise("")))


@query(SEG + ", x AS (SELECT session_id, id, " + _CUED + " AS text FROM seg) SELECT session_id, id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{label}' END" for label, p in T.VISUAL_CUES) + "], lambda v: v IS NOT NULL), '|') AS labels FROM x")
def visual_cues(spark, d):
    return _cued(spark, d).select("session_id", "id", F.concat_ws("|", T.visual_labels(F.col("text"))).alias("labels"))


@query(SEG + f", x AS (SELECT session_id, id, CASE WHEN id % 5 = 0 THEN '下面我们进行证明' || text ELSE text END AS text FROM seg) SELECT session_id, id FROM x WHERE regexp_matches(text, '{T.DERIVATION_CUE}')")
def derivation_cues(spark, d):
    s = seg_docs(spark, d).withColumn("text", F.when(F.col("id") % 5 == 0, F.concat(F.lit("下面我们进行证明"), "text")).otherwise(F.col("text")))
    return s.where(T.derivation_cue(F.col("text"))).select("session_id", "id")


_COUNT = "list_reduce([{'l': NULL::VARCHAR, 'r': 0, 'b': 0}] || list_transform(%s, lambda t: {'l': t, 'r': 0, 'b': 0}), lambda a, x: {'l': x.l, 'r': CASE WHEN a.l = x.l THEN a.r + 1 ELSE 1 END, 'b': greatest(a.b, CASE WHEN a.l = x.l THEN a.r + 1 ELSE 1 END)}).b"
_TILES = ", ".join("CASE WHEN length(key) >= %d THEN " % (2 * u) + _COUNT % f"list_transform(range(length(key) // {u}), lambda k: substr(key, k * {u} + 1, {u}))" + " ELSE 0 END" for u in range(1, 13))


@query(SEG + rf", k AS (SELECT session_id, id, {KEY} AS key, regexp_extract_all(lower(text), '[a-z]+(?:-[a-z0-9]+)*|\d+|[\x{{3400}}-\x{{9fff}}]+') AS ts FROM seg) SELECT session_id, id, greatest({_COUNT % 'ts'}, {_TILES})::INTEGER AS longest_run FROM k")
def longest_repeat_run(spark, d):
    return seg_docs(spark, d).select("session_id", "id", T.longest_run(F.col("text")).alias("longest_run"))


@query()
def compression_metrics(spark, d):
    k = seg_docs(spark, d).withColumn("key", T.normalized(F.col("text")))
    return k.select("session_id", "id", F.octet_length("key").alias("n_bytes"), T.deflated_bytes("key").alias("deflated"))


def glossary_terms(spark, d, most: int = 200) -> list[str]:
    """The first terms of the glossary (its prompt takes no more), as normal keys."""
    b = spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", F.posexplode(F.split(F.lower("text"), " ")).alias("pos", "term"))
    first = b.withColumn("term", T.normalized(F.col("term"))).where("length(term) >= 6").groupBy("term").agg(F.min(F.struct("item_id", "pos")).alias("o")).orderBy("o").limit(most)
    return [r[0] for r in first.select("term").collect()]


@query(SEG + f""", gw AS (SELECT item_id, string_split(lower(text), ' ') AS ws FROM benchmark), gl AS (SELECT item_id, generate_subscripts(ws, 1) AS pos, unnest(ws) AS text FROM gw), gn AS (SELECT item_id, pos, {KEY} AS term FROM gl),
g AS (SELECT term FROM gn WHERE length(term) >= 6 GROUP BY term ORDER BY min(item_id * 1000000 + pos) LIMIT 200), k AS (SELECT session_id, id, {KEY} AS key FROM seg),
m AS (SELECT session_id, id, key, term, string_split(key, term) AS ps FROM k JOIN g ON contains(key, term)),
p AS (SELECT session_id, id, key, flatten(list_transform(range(1, len(ps)), lambda i: range(list_sum(list_transform(ps[1:i], lambda x: length(x)))::BIGINT + (i - 1) * length(term), list_sum(list_transform(ps[1:i], lambda x: length(x)))::BIGINT + i * length(term)))) AS at_chars FROM m)
SELECT session_id, id, count(*)::INTEGER AS terms, len(list_distinct(flatten(list(at_chars)))) / greatest(1, length(key)) AS coverage FROM p GROUP BY session_id, id, key""")
def prompt_echo(spark, d):
    e = seg_docs(spark, d).withColumn("e", T.prompt_echo(glossary_terms(spark, d))(T.normalized(F.col("text"))))
    return e.select("session_id", "id", "e.terms", "e.coverage").where("terms > 0")


@query()
def anomaly_score_full(spark, d):
    m = R.measures(seg_docs(spark, d), seconds=F.col("seg_end") - F.col("seg_start"), terms=glossary_terms(spark, d))
    return m.select("session_id", "id", "n_chars", "n_bytes", "ratio", "unique_ratio", "repeat_ratio", "run", "score", F.concat_ws("|", "reasons").alias("reasons"), "suspicious")


_RUN = f""", k AS (SELECT *, {KEY} AS key FROM seg),
n AS (SELECT *, CASE WHEN key <> '' AND key = lag(key) OVER w THEN 0 ELSE 1 END AS new FROM k WINDOW w AS (PARTITION BY session_id ORDER BY id)),
m AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY id) - 1 AS run FROM n),
runs AS (SELECT *, count(*) OVER (PARTITION BY session_id, run) AS run_length, row_number() OVER (PARTITION BY session_id, run ORDER BY id) AS run_place FROM m)"""


@query(SEG + _RUN + " SELECT session_id, run::BIGINT AS run, min(id) AS first_id, max(id) AS last_id, count(*) AS n FROM runs GROUP BY session_id, run HAVING count(*) > 1")
def repeat_runs(spark, d):
    r = S.runs(S.repeat_key(seg_docs(spark, d)), ["session_id"], "id", "key").where("run_length > 1")
    return r.groupBy("session_id", "run").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count("*").alias("n"))


@query(SEG + _RUN + " SELECT session_id, id, CASE WHEN run_length >= 2 AND key <> '' AND run_place > 1 THEN '' ELSE text END AS text, run_length >= 2 AND key <> '' AND run_place > 1 AS removed FROM runs")
def repeat_run_dedup(spark, d):
    r = S.runs(S.repeat_key(seg_docs(spark, d)), ["session_id"], "id", "key")
    gone = (F.col("run_length") >= 2) & (F.col("key") != "") & (F.col("run_place") > 1)
    return r.select("session_id", "id", F.when(gone, "").otherwise(F.col("text")).alias("text"), gone.alias("removed"))


@query(SEG + """, k AS (SELECT session_id, id, CASE WHEN id % 12 < 7 THEN 'uh' ELSE lower(trim(text)) END AS word, CASE WHEN id % 12 < 7 THEN 2.0 ELSE seg_end - seg_start END AS secs FROM seg),
n AS (SELECT *, CASE WHEN word = lag(word) OVER (PARTITION BY session_id ORDER BY id) THEN 0 ELSE 1 END AS new FROM k),
m AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY id) AS run FROM n)
SELECT session_id, id FROM (SELECT *, count(*) OVER w AS c, min(CASE WHEN secs <= 5 THEN 1 ELSE 0 END) OVER w AS short FROM m WINDOW w AS (PARTITION BY session_id, run)) WHERE length(word) <= 4 AND c >= 6 AND short = 1""")
def placeholder_runs(spark, d):
    s = seg_docs(spark, d)
    fill = F.col("id") % 12 < 7
    s = s.withColumn("text", F.when(fill, "uh").otherwise(F.col("text"))).withColumn("seg_end", F.when(fill, F.col("seg_start") + 2.0).otherwise(F.col("seg_end")))
    return R.placeholder_runs(s).where("dropped").select("session_id", "id")


_FLAGS = f""", k0 AS (SELECT *, {KEY} AS key FROM seg),
k1 AS (SELECT *, list_transform(range(1, greatest(length(key) - 1, 1)), lambda i: substr(key, i, 3)) AS gs, list_filter(string_split(key, ''), lambda x: x <> '') AS cs, octet_length(encode(key)) >= 60 AS long FROM k0),
flags AS (SELECT session_id, id, seg_start, seg_end, key, long AND len(list_distinct(cs))::DOUBLE / greatest(1, length(key)) <= 0.16 AS f1,
 seg_end - seg_start >= 45 AND length(key) / (seg_end - seg_start) <= 0.60 AS f2, long AND (len(gs) - len(list_distinct(gs)))::DOUBLE / greatest(1, len(gs)) >= 0.55 AS f3 FROM k1)"""
_CANDIDATES = (
    _FLAGS
    + """, fn AS (SELECT *, CASE WHEN key <> '' AND key = lag(key) OVER (PARTITION BY session_id ORDER BY id) THEN 0 ELSE 1 END AS new FROM flags),
fr AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY id) AS run FROM fn),
cand AS (SELECT session_id, seg_start, seg_end, [id] AS ids, list_filter([CASE WHEN f1 THEN 'low_character_diversity' END, CASE WHEN f2 THEN 'low_text_density' END, CASE WHEN f3 THEN 'repeated_ngrams' END], lambda v: v IS NOT NULL) AS reasons FROM flags WHERE f1 OR f2 OR f3
 UNION ALL SELECT session_id, min(seg_start), max(seg_end), list(id), list_filter(['cross_segment_repetition', CASE WHEN bool_or(f1) THEN 'low_character_diversity' END, CASE WHEN bool_or(f2) THEN 'low_text_density' END, CASE WHEN bool_or(f3) THEN 'repeated_ngrams' END], lambda v: v IS NOT NULL) FROM fr WHERE key <> '' GROUP BY session_id, run HAVING count(*) >= 6),
win AS (SELECT c.*, greatest(0, seg_start - 15) AS window_start, least(duration, seg_end + 15) AS window_end FROM cand c JOIN dura USING (session_id))"""
)
_UNION = (
    _CANDIDATES
    + """, wi AS (SELECT *, CASE WHEN window_start <= max(window_end) OVER (PARTITION BY session_id ORDER BY window_start, window_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM win),
isl AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY window_start, window_end ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS region FROM wi),
reg AS (SELECT session_id, region::BIGINT AS region_id, min(seg_start) AS seg_start, max(seg_end) AS seg_end, min(window_start) AS window_start, max(window_end) AS window_end,
 list_sort(list_distinct(flatten(list(ids)))) AS ids, list_sort(list_distinct(flatten(list(reasons)))) AS reasons FROM isl GROUP BY session_id, region)"""
)


@query(SEG + _CANDIDATES + " SELECT session_id, seg_start, seg_end, window_start::DOUBLE AS window_start, window_end, len(ids)::INTEGER AS n_ids, array_to_string(reasons, '|') AS reasons FROM win")
def suspicious_windows(spark, d):
    seg = seg_docs(spark, d)
    c = R.candidates(seg)
    return c.select("session_id", "seg_start", "seg_end", "window_start", "window_end", F.size("ids").alias("n_ids"), F.concat_ws("|", "reasons").alias("reasons"))


@query(SEG + _UNION + " SELECT session_id, region_id, seg_start, seg_end, window_start::DOUBLE AS window_start, window_end, array_to_string(ids, '|') AS ids, array_to_string(reasons, '|') AS reasons FROM reg")
def window_union(spark, d):
    seg = seg_docs(spark, d)
    u = R.union_windows(R.candidates(seg))
    return u.select("session_id", "region_id", "seg_start", "seg_end", "window_start", "window_end", F.concat_ws("|", F.col("ids").cast("array<string>")).alias("ids"), F.concat_ws("|", "reasons").alias("reasons"))


@query(SEG + _UNION + " SELECT session_id, region_id, max(s.seg_end) - min(s.seg_start) AS seconds, count(*) AS n_segments FROM reg JOIN seg s USING (session_id) WHERE s.seg_end > window_start AND s.seg_start < window_end GROUP BY ALL")
def window_segments(spark, d):
    seg = seg_docs(spark, d)
    return R.window_text(seg, R.union_windows(R.candidates(seg))).drop("text")


_BEFORE_AFTER = "SELECT session_id, id, length(text) AS bc, (id % 7) / 4.0 AS bs, id % 3 <> 0 AS bq, CASE id % 5 WHEN 0 THEN 0 WHEN 1 THEN length(text) // 50 ELSE length(text) END AS ac, (id % 4) / 4.0 AS asc_, id % 2 = 0 AS aq FROM seg"


@query(SEG + f""", x AS ({_BEFORE_AFTER}), y AS (SELECT *, CASE WHEN bs <= 0 THEN CASE WHEN aq THEN 0.0 ELSE 1.0 END ELSE (bs - asc_) / bs END AS gain FROM x)
SELECT session_id, id, reason IN ('suspicion_cleared', 'anomaly_score_improved') AS accepted, reason FROM (SELECT session_id, id, CASE WHEN ac = 0 THEN 'replacement_empty' WHEN ac::DOUBLE / greatest(1, bc) < 0.05 THEN 'replacement_too_short' WHEN asc_ > bs + 1e-9 THEN 'anomaly_score_worse'
 WHEN NOT aq AND bq THEN 'suspicion_cleared' WHEN gain >= 0.2 THEN 'anomaly_score_improved' ELSE 'insufficient_improvement' END AS reason FROM y)""")
def repair_decisions(spark, d):
    i, n = F.col("id"), F.length("text")
    before = F.struct(n.alias("n_chars"), ((i % 7) / 4).alias("score"), (i % 3 != 0).alias("suspicious"))
    after = F.struct(F.when(i % 5 == 0, 0).when(i % 5 == 1, F.floor(n / 50)).otherwise(n).alias("n_chars"), ((i % 4) / 4).alias("score"), (i % 2 == 0).alias("suspicious"))
    x = seg_docs(spark, d).select("session_id", "id", before.alias("b"), after.alias("a")).withColumn("x", R.decision("b", "a"))
    return x.select("session_id", "id", "x.accepted", "x.reason")


@query(SEG + _UNION + " SELECT session_id, region_id, CASE WHEN list_contains(reasons, 'low_text_density') THEN 'sparse_recovery_no_hotwords_no_vad' WHEN list_contains(reasons, 'prompt_echo') THEN 'prompt_echo_recovery_no_hotwords' WHEN session_id % 2 = 0 THEN 'default_hotwords' ELSE 'default_no_hotwords' END AS strategy FROM reg")
def strategy_case(spark, d):
    seg = seg_docs(spark, d)
    return R.union_windows(R.candidates(seg)).select("session_id", "region_id", R.strategy(F.col("reasons"), F.col("session_id") % 2 == 0).alias("strategy"))


@query(SEG + _UNION + " SELECT session_id, count(*) AS n_regions, count(*) FILTER (region_id % 2 = 0) AS n_accepted, count(*) FILTER (region_id % 2 <> 0) AS n_rejected, sum(seg_end - seg_start) AS seconds_before, sum(CASE WHEN region_id % 2 = 0 THEN 0.0 ELSE seg_end - seg_start END) AS seconds_after FROM reg GROUP BY session_id")
def repair_summary(spark, d):
    seg = seg_docs(spark, d)
    return R.summary(R.union_windows(R.candidates(seg)).withColumn("accepted", F.col("region_id") % 2 == 0))


@query(SEG + _UNION + " SELECT session_id, region_id, region_id % 2 = 0 AND list_contains(reasons, CASE session_id % 3 WHEN 0 THEN 'low_text_density' WHEN 1 THEN 'repeated_ngrams' ELSE 'prompt_echo' END) AS accepted FROM reg")
def new_anomaly_veto(spark, d):
    seg = seg_docs(spark, d)
    after = F.array(F.when(F.col("session_id") % 3 == 0, "low_text_density").when(F.col("session_id") % 3 == 1, "repeated_ngrams").otherwise("prompt_echo"))
    u = R.union_windows(R.candidates(seg))
    return u.select("session_id", "region_id", R.veto(F.col("region_id") % 2 == 0, after, F.array().cast("array<string>"), F.col("reasons")).alias("accepted"))


_PLAN = """, ch AS (SELECT session_id, duration, unnest(range(ceil(duration / 480)::BIGINT)) AS chunk FROM dura WHERE duration > 0),
plan AS (SELECT session_id, duration, chunk, chunk * 480.0 AS core_start, least(duration, (chunk + 1) * 480.0) AS core_end, greatest(0.0, chunk * 480.0 - 30) AS window_start, least(duration, least(duration, (chunk + 1) * 480.0) + 30) AS window_end FROM ch)"""
_PLANCOLS = "session_id, chunk, core_start::DOUBLE AS core_start, core_end, window_start::DOUBLE AS window_start, window_end"


@query(SEG + _PLAN + f" SELECT {_PLANCOLS} FROM plan")
def chunk_plan(spark, d):
    return S.chunk_plan(durations(seg_docs(spark, d))).drop("duration")


@query(SEG + _PLAN + " SELECT session_id, chunk, id FROM plan JOIN seg USING (session_id) WHERE seg_end > window_start AND seg_start < window_end")
def chunk_segments(spark, d):
    seg = seg_docs(spark, d)
    plan = S.chunk_plan(durations(seg))
    return S.interval_join(seg, plan, ["session_id"], ("seg_start", "seg_end"), ("window_start", "window_end")).select("session_id", "chunk", "id")


@query(SEG + " SELECT session_id, unnest(range(ceil(duration / 550)::BIGINT)) AS part, unnest(range(ceil(duration / 550)::BIGINT)) * 550.0::DOUBLE AS offset_sec FROM dura WHERE duration > 0")
def split_audio_plan(spark, d):
    return S.split_plan(durations(seg_docs(spark, d)), 600.0, 50.0).select("session_id", "part", F.col("offset").alias("offset_sec"))


_RESULTS = _PLAN + """, res AS (SELECT session_id, chunk, id, core_start, core_end, seg_start, seg_end, CASE WHEN (id + chunk) % 9 = 0 THEN text || '!' WHEN (id + chunk) % 13 = 0 THEN text || ' x' ELSE text END AS ctext FROM plan JOIN seg USING (session_id) WHERE seg_end > window_start AND seg_start < window_end)"""


def _results(spark, d):
    seg = seg_docs(spark, d)
    j = S.interval_join(seg, S.chunk_plan(durations(seg)), ["session_id"], ("seg_start", "seg_end"), ("window_start", "window_end"))
    k = F.col("id") + F.col("chunk")
    return seg, j.select("session_id", "chunk", "id", "core_start", "core_end", F.when(k % 9 == 0, F.concat("text", F.lit("!"))).when(k % 13 == 0, F.concat("text", F.lit(" x"))).otherwise(F.col("text")).alias("text"))


@query(SEG + _RESULTS + """ SELECT session_id, id, chunk, ctext AS text FROM (SELECT *, row_number() OVER (PARTITION BY session_id, id ORDER BY CASE WHEN core_start <= (seg_start + seg_end) / 2 AND (seg_start + seg_end) / 2 < core_end THEN 0 ELSE 1 END, chunk) AS rn FROM res) WHERE rn = 1""")
def chunk_assemble(spark, d):
    seg, res = _results(spark, d)
    return V.assemble(seg.drop("text"), res)


@query(SEG + _RESULTS + r""", bp AS (SELECT a.session_id, a.chunk, a.id, trim(a.ctext) AS l, trim(b.ctext) AS r FROM res a JOIN res b ON a.session_id = b.session_id AND b.chunk = a.chunk + 1 AND a.id = b.id),
bk AS (SELECT *, replace(lower(regexp_replace(l, '[^\p{L}\p{N}\p{M}_]+', '', 'g')), 'ß', 'ss') <> replace(lower(regexp_replace(r, '[^\p{L}\p{N}\p{M}_]+', '', 'g')), 'ß', 'ss') AS c FROM bp)
SELECT session_id, chunk, CASE WHEN bool_or(c) THEN 'llm' ELSE 'deterministic' END AS decision, CASE WHEN bool_or(c) THEN 'overlap_text_conflict' WHEN bool_or(l <> r) THEN 'punctuation_or_whitespace_equivalent' ELSE 'identical_overlap' END AS reason,
 coalesce(string_agg(CASE WHEN c THEN id::VARCHAR END, '|' ORDER BY id), '') AS conflicts, count(*) AS n_shared FROM bk GROUP BY session_id, chunk""")
def boundary_decisions(spark, d):
    return V.boundary_decisions(_results(spark, d)[1]).withColumn("conflicts", F.concat_ws("|", F.col("conflicts").cast("array<string>")))


_ACCEPTED = ", acc AS (SELECT session_id, chunk AS region_id, chunk * 480.0 + 100 AS window_start, chunk * 480.0 + 220 AS window_end FROM ch WHERE chunk % 2 = 0)"


def _accepted(seg):
    p = S.chunk_plan(durations(seg)).where("chunk % 2 = 0")
    return p.select("session_id", F.col("chunk").alias("region_id"), (F.col("core_start") + 100).alias("window_start"), (F.col("core_start") + 220).alias("window_end"))


@query(SEG + _PLAN + _ACCEPTED + " SELECT session_id, id FROM seg s WHERE NOT EXISTS (SELECT 1 FROM acc a WHERE a.session_id = s.session_id AND s.seg_end > window_start AND s.seg_start < window_end)")
def interval_anti_join(spark, d):
    seg = seg_docs(spark, d)
    return S.interval_anti_join(seg, _accepted(seg), ["session_id"], ("seg_start", "seg_end"), ("window_start", "window_end"), ["id"]).select("session_id", "id")


_SHIFTED = ", sh AS (SELECT session_id, id, text, seg_start - (id % 3) * 4 AS a, seg_end + (id % 4) * 2 AS b, duration FROM seg JOIN dura USING (session_id))"


def _shifted(spark, d):
    seg = seg_docs(spark, d)
    s = seg.withColumn("seg_start", F.col("seg_start") - (F.col("id") % 3) * 4).withColumn("seg_end", F.col("seg_end") + (F.col("id") % 4) * 2)
    return s.join(durations(seg), "session_id")


@query(SEG + _SHIFTED + """, cl AS (SELECT session_id, id, trim(text) AS text, greatest(0, a) AS a, least(duration, b) AS b FROM sh WHERE least(duration, b) > greatest(0, a) AND trim(text) <> ''),
cm AS (SELECT *, greatest(a, coalesce(max(b) OVER (PARTITION BY session_id ORDER BY a, b, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS st FROM cl)
SELECT session_id, (row_number() OVER (PARTITION BY session_id ORDER BY st, b) - 1)::INTEGER AS new_id, id, st::DOUBLE AS seg_start, b::DOUBLE AS seg_end FROM cm WHERE b > st""")
def timeline_clamp(spark, d):
    out = S.reindex(S.clamp(_shifted(spark, d), ["session_id"], "duration"), ["session_id"], "seg_start", "seg_end")
    return out.select("session_id", "new_id", "id", "seg_start", "seg_end")


@query(SEG + _SHIFTED + """, tv AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY session_id ORDER BY id), 0) AS done FROM sh)
SELECT session_id, id AS item_id, 'overlap' AS rule FROM tv WHERE a < done - 1e-6 UNION ALL SELECT session_id, id, 'invalid' FROM tv WHERE b < a OR a < 0 UNION ALL SELECT session_id, id, 'beyond_end' FROM tv WHERE duration > 0 AND b > duration + 1e-3""")
def timeline_violations(spark, d):
    return S.timeline_violations(_shifted(spark, d), ["session_id"], "duration").select("session_id", "item_id", "rule")


@query(SEG + _PLAN + ", ac AS (SELECT session_id, chunk AS region_id, core_start + 100 AS window_start, core_start + 500 + (session_id % 3) * 90 AS window_end FROM plan) SELECT session_id, region_id AS item_id, 'windows_overlap' AS rule FROM (SELECT *, lead(window_start) OVER (PARTITION BY session_id ORDER BY window_start, region_id) AS nx FROM ac) WHERE nx < window_end")
def accepted_windows_disjoint(spark, d):
    p = S.chunk_plan(durations(seg_docs(spark, d)))
    w = p.select("session_id", F.col("chunk").alias("region_id"), (F.col("core_start") + 100).alias("window_start"), (F.col("core_start") + 500 + (F.col("session_id") % 3) * 90).alias("window_end"))
    return R.disjoint_violations(w)


@query("""WITH RECURSIVE e AS (SELECT user_id AS session_id, (epoch(ts)::BIGINT // 86400) AS chunk, row_number() OVER (PARTITION BY user_id, epoch(ts)::BIGINT // 86400 ORDER BY event_id) AS place, floor(epoch(ts))::DOUBLE - (event_id % 3) * 20000 AS a, floor(epoch(ts))::DOUBLE + floor(value) * 100 AS b FROM (SELECT event_id, user_id, value, date_trunc('second', ts) AS ts FROM events)),
o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY chunk, place) AS rn FROM e),
f AS (SELECT session_id, rn, chunk, place, a, b, true AS kept, greatest(0.0, b) AS done, true AS some FROM o WHERE rn = 1
 UNION ALL SELECT o.session_id, o.rn, o.chunk, o.place, o.a, o.b, NOT (f.some AND o.a < f.done - 2000), CASE WHEN f.some AND o.a < f.done - 2000 THEN f.done ELSE greatest(f.done, o.b) END, true FROM f JOIN o ON o.session_id = f.session_id AND o.rn = f.rn + 1)
SELECT session_id, chunk, place, a AS seg_start, b AS seg_end FROM f WHERE kept""")
def asr_chunk_dedup_fold(spark, d):
    from pyspark.sql import Window

    e = spark.read.parquet(f"{d}/events.parquet").withColumn("s", F.unix_seconds(F.date_trunc("second", F.col("ts").cast("timestamp"))))
    e = e.withColumn("chunk", F.floor(F.col("s") / 86400)).withColumn("place", F.row_number().over(Window.partitionBy("user_id", "chunk").orderBy("event_id")))
    e = e.select(F.col("user_id").alias("session_id"), "chunk", F.col("place").cast("long").alias("place"), (F.col("s") - (F.col("event_id") % 3) * 20000).cast("double").alias("seg_start"), (F.col("s") + F.floor("value") * 100).cast("double").alias("seg_end"))
    return S.fold_chunks(e, ["session_id"], 4000.0)


@query(SEG + ", x AS (SELECT session_id, length(text) AS a, length(CASE WHEN session_id % 3 = 0 AND id > 0 THEN '' ELSE text END) AS b, CASE WHEN id % 5 = 4 THEN length(text) ELSE 0 END AS ig FROM seg) SELECT session_id, sum(b)::DOUBLE / greatest(1, sum(a) - sum(ig)) AS kept FROM x GROUP BY session_id")
def clean_retention(spark, d):
    s = seg_docs(spark, d).select("session_id", "id", F.length("text").alias("before"), F.when((F.col("session_id") % 3 == 0) & (F.col("id") > 0), 0).otherwise(F.length("text")).alias("after"))
    return V.retention(s, F.when(F.col("id") % 5 == 4, F.col("before")).otherwise(0))


@query(SEG + """, cl AS (SELECT session_id, id, CASE WHEN id % 6 = 1 THEN '' WHEN id % 6 = 2 THEN text || text || text || text || repeat('y', 31) ELSE text END AS new, id % 12 = 1 AS noted FROM seg WHERE NOT (session_id % 5 = 0 AND id % 4 = 3)
 UNION ALL SELECT session_id, id, text, false FROM seg WHERE session_id % 9 = 0 AND id = 0),
g AS (SELECT session_id, id, count(*) AS n, any_value(new) AS new, bool_or(noted) AS noted FROM cl GROUP BY session_id, id), bo AS (SELECT s.session_id, s.id, s.text AS old, n, new, noted FROM seg s LEFT JOIN g USING (session_id, id)),
su AS (SELECT session_id, sum(coalesce(length(new), 0))::DOUBLE / greatest(1, sum(length(old))) AS kept FROM bo GROUP BY session_id)
SELECT session_id, 'missing' AS rule, id::VARCHAR AS item_id FROM bo WHERE n IS NULL UNION ALL SELECT session_id, 'repeated', id::VARCHAR FROM bo WHERE n > 1 UNION ALL SELECT session_id, 'blank', id::VARCHAR FROM bo WHERE trim(new) = '' AND NOT noted
 UNION ALL SELECT session_id, 'expanded', id::VARCHAR FROM bo WHERE length(new) > 3 * length(old) + 30 UNION ALL SELECT session_id, 'retention', 'session' FROM su WHERE kept < 0.45 UNION ALL SELECT session_id, 'expansion', 'session' FROM su WHERE kept > 1.35""")
def clean_violations(spark, d):
    seg = seg_docs(spark, d)
    i, t = F.col("id"), F.col("text")
    new = F.when(i % 6 == 1, "").when(i % 6 == 2, F.concat(t, t, t, t, F.repeat(F.lit("y"), 31))).otherwise(t)
    noted = F.when(i % 12 == 1, F.array(F.lit("noise"))).otherwise(F.array().cast("array<string>"))
    cl = seg.where(~((F.col("session_id") % 5 == 0) & (i % 4 == 3))).select("session_id", "id", new.alias("text"), noted.alias("uncertain"))
    cl = cl.unionByName(seg.where((F.col("session_id") % 9 == 0) & (i == 0)).select("session_id", "id", "text", F.array().cast("array<string>").alias("uncertain")))
    return V.clean_violations(cl, seg)


@query(CONV + """ SELECT session_id, '# Transcript' || chr(10) || chr(10) || string_agg('[' || lpad((s // 3600)::VARCHAR, 2, '0') || ':' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') || '] ' || replace(text, chr(10), ' '), chr(10) ORDER BY id) AS markdown
FROM (SELECT *, round_even(seg_start, 0)::BIGINT AS s FROM seg) GROUP BY session_id""")
def transcript_markdown_lines(spark, d):
    return transcript_markdown(seg_conv(spark, d))


@query(SEG + " SELECT session_id, id, lpad((s // 3600)::VARCHAR, greatest(2, length((s // 3600)::VARCHAR))::INTEGER, '0') || ':' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS clock FROM (SELECT *, round_even(seg_start, 0)::BIGINT AS s FROM seg)")
def hhmmss_format(spark, d):
    return seg_docs(spark, d).select("session_id", "id", N.hhmmss(F.col("seg_start")).alias("clock"))
