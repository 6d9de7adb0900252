"""Queries over gaps in timelines, session ids, stages that go on by themselves, canonical documents, and tables published together."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronotext.functions import names as N
from chronotext.operators import catalog as C
from chronotext.operators import incremental as I
from chronotext.operators import publish as P
from chronotext.operators import sequence as S
from chronotext.operators import work as W
from chronotext.sources.bindings import seg_docs, table
from chronotext.sources.shared import fresh_path

from .base import SEG, query

_LEFT = ", sg AS (SELECT session_id, id, seg_start, CASE WHEN id % 5 = 1 THEN seg_end + 6 ELSE seg_end END AS seg_end FROM seg WHERE (session_id + id) % 4 <> 0)"


@query(SEG + _LEFT + """, b AS (SELECT *, max(seg_end) OVER (PARTITION BY session_id ORDER BY seg_start, seg_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS done FROM sg)
SELECT session_id, 'gap' AS kind, done AS start_sec, seg_start - done AS seconds FROM b WHERE seg_start > done AND seg_start - done >= 4 UNION ALL SELECT session_id, 'segment', seg_start, seg_end - seg_start FROM sg""")
def timeline_gaps(spark, d):
    seg = seg_docs(spark, d).where((F.col("session_id") + F.col("id")) % 4 != 0).withColumn("seg_end", F.when(F.col("id") % 5 == 1, F.col("seg_end") + 6).otherwise(F.col("seg_end")))
    gaps = S.gaps(seg, ["session_id"], ("seg_start", "seg_end"), least=4.0)
    own = seg.select("session_id", F.lit("segment").alias("kind"), F.col("seg_start").alias("start_sec"), (F.col("seg_end") - F.col("seg_start")).alias("seconds"))
    return gaps.select("session_id", F.lit("gap").alias("kind"), F.col("gap_start").alias("start_sec"), F.col("gap").alias("seconds")).unionByName(own)


_IDS = """WITH b AS (SELECT doc_id, '2024-01-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') AS day, coalesce(source, 'none') AS course FROM documents WHERE doc_id IS NOT NULL), a AS (SELECT doc_id, day || '_0930_' || course AS base FROM b),
t AS (SELECT base, list(DISTINCT (doc_id // 28) % 11 + 1) AS taken FROM a WHERE doc_id % 3 = 0 GROUP BY base), w AS (SELECT base, doc_id, (doc_id // 84) % 5 + 1 AS seq FROM a WHERE doc_id % 3 <> 0)"""


@query(_IDS + """, g AS (SELECT w.base, list({'n': 0::BIGINT, 'last': 0::BIGINT, 'seq': seq, 'ids': [doc_id], 'out': []::BIGINT[], 'taken': coalesce(taken, [])} ORDER BY seq, doc_id) AS rs FROM w LEFT JOIN t USING (base) GROUP BY w.base),
z AS (SELECT base, list_reduce([{'n': 0::BIGINT, 'last': 0::BIGINT, 'seq': 0::BIGINT, 'ids': []::BIGINT[], 'out': []::BIGINT[], 'taken': []::BIGINT[]}] || rs, lambda a, x: {'n': a.n + 1, 'last': list_min(list_filter(range(greatest(x.seq, a.last + 1), greatest(x.seq, a.last + 1) + len(x.taken) + 1), lambda v: NOT list_contains(x.taken, v))), 'seq': x.seq, 'ids': a.ids || x.ids,
 'out': a.out || [list_min(list_filter(range(greatest(x.seq, a.last + 1), greatest(x.seq, a.last + 1) + len(x.taken) + 1), lambda v: NOT list_contains(x.taken, v)))], 'taken': x.taken}) AS e FROM g),
o AS (SELECT base, unnest(e.ids) AS doc_id, unnest(e.out) AS suffix FROM z)
SELECT doc_id, base || '_' || CASE WHEN suffix < 1000 THEN lpad(suffix::VARCHAR, 3, '0') ELSE suffix::VARCHAR END AS session_id FROM o""")
def session_id_bumps(spark, d):
    i = F.col("doc_id")
    a = table(spark, d, "documents").where(i.isNotNull()).select(i, F.make_date(F.lit(2024), F.lit(1), (i % 28 + 1).cast("int")).alias("day"), F.coalesce("source", F.lit("none")).alias("course"))
    base = F.concat_ws("\x1f", F.date_format("day", "yyyy-MM-dd"), "course")
    taken = a.where("doc_id % 3 = 0").select(base.alias("base"), (F.floor(i / 28) % 11 + 1).alias("seq"))
    wanted = a.where("doc_id % 3 <> 0").select("*", base.alias("base"), (F.floor(i / 84) % 5 + 1).alias("seq"))
    out = C.free_suffixes(wanted, taken, "base", "seq", "doc_id")
    start = F.col("day").cast("timestamp") + F.make_dt_interval(hours=F.lit(9), mins=F.lit(30))
    return out.select("doc_id", N.session_id(F.date_format("day", "yyyy-MM-dd"), start, F.col("course"), F.col("suffix")).alias("session_id"))


_STAGED = "CASE doc_id % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 1 ELSE 0 END"


@query(f"""WITH RECURSIVE s AS (SELECT doc_id, {_STAGED}::BIGINT AS k, doc_id % 101 AS v FROM documents), r AS (SELECT doc_id, k, v, false AS waits, 0 AS advanced FROM s
 UNION ALL SELECT doc_id, k + 1, (v * 31 + (k + 1) * 7) % 101, (v * 31 + (k + 1) * 7) % 101 % 3 = 0, advanced + 1 FROM r WHERE k BETWEEN 1 AND 3 AND NOT waits), l AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY advanced DESC) AS nth FROM r)
SELECT doc_id AS session_id, CASE k WHEN 1 THEN 'clean' WHEN 2 THEN 'structure' WHEN 3 THEN 'knowledge' WHEN 4 THEN 'draft' ELSE 'none' END AS stage, waits, advanced, v FROM l WHERE nth = 1""")
def stage_fixpoint(spark, d):
    i = F.col("doc_id")
    order = F.array(*map(F.lit, W.STAGES))
    start = F.when(i % 6 == 5, "none").otherwise(F.element_at(order, F.when(i % 6 == 4, 1).otherwise(i % 6 + 1).cast("int")))
    docs = table(spark, d, "documents").select(i.alias("session_id"), start.alias("stage"), (i % 101).alias("v"))

    def prepare(rows):
        now = rows.withColumn("v", (F.col("v") * 31 + F.array_position(order, F.col("stage")) * 7) % 101)
        return now.withColumn("waits", F.col("v") % 3 == 0)

    return W.auto_advance(docs, prepare).select("session_id", "stage", "waits", "advanced", "v")


@query("""WITH x AS (SELECT doc_id, to_json(lang) AS lang, to_json(source) AS source, to_json(text) AS text, n_chars FROM documents)
SELECT doc_id, sha256('{"id":' || coalesce(doc_id::VARCHAR, 'null') || ',"meta":{"chars":' || coalesce(n_chars::VARCHAR, 'null') || ',"half":' || CASE WHEN n_chars % 2 = 0 OR n_chars IS NULL THEN '0' ELSE '0.5' END || ',"lang":' || coalesce(lang, 'null') || ',"list":[3,{"a":true,"b":null},"z"],"source":' || coalesce(source, 'null') || '},"text":' || coalesce(text, 'null') || '}') AS fingerprint FROM x""")
def canonical_fingerprint(spark, d):
    """The same document with its keys in one order or the other, with and without white space."""
    js = lambda c: F.coalesce(F.substring(F.to_json(F.array(c)), 2, 1 << 30), F.lit("null]"))
    quoted = lambda c: F.when(F.col(c).isNull(), "null").otherwise(F.left(js(c), F.length(js(c)) - 1))
    half = F.when(F.col("n_chars") % 2 == 0, "0").when(F.col("n_chars").isNull(), "0").otherwise("0.5")
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    one = F.concat(F.lit('{"text": '), quoted("text"), F.lit(', "meta": {"source": '), quoted("source"), F.lit(', "list": [3, {"b": null, "a": true}, "z"], "lang": '), quoted("lang"), F.lit(',\n "half": '), half, F.lit(', "chars": '), number("n_chars"), F.lit('}, "id": '), number("doc_id"), F.lit("}"))
    other = F.concat(F.lit('{"meta":{"chars":'), number("n_chars"), F.lit(',"lang":'), quoted("lang"), F.lit(',"half":'), half, F.lit(',"source":'), quoted("source"), F.lit(',"list":[3,{"a":true,"b":null},"z"]},"id":'), number("doc_id"), F.lit(',"text":'), quoted("text"), F.lit("}"))
    return table(spark, d, "documents").select("doc_id", I.document_fingerprint(F.when(F.col("doc_id") % 2 == 0, one).otherwise(other)).alias("fingerprint"))


_MOVED = """WITH p AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), m AS (SELECT conv_id AS old, CASE WHEN conv_id % 30 = 13 THEN -1 WHEN conv_id % 30 = 23 THEN conv_id ELSE conv_id + 1 END AS new FROM p WHERE conv_id % 10 = 3 UNION ALL SELECT conv_id, conv_id + 2 FROM p WHERE conv_id % 40 = 3 UNION ALL SELECT conv_id, conv_id + 9 FROM p WHERE conv_id % 10 = 4),
j AS (SELECT m.old, m.new, CASE WHEN old = new THEN 'itself' WHEN new NOT IN (SELECT conv_id FROM p) THEN 'unknown_target' WHEN count(*) OVER (PARTITION BY old) > 1 THEN 'moved_twice' WHEN new IN (SELECT old FROM m) THEN 'target_moves' END AS reason FROM (SELECT DISTINCT * FROM m) m), ok AS (SELECT old, new FROM j WHERE reason IS NULL)"""


@query(_MOVED + """ SELECT 'sessions' AS part, conv_id AS id, 1::BIGINT AS n, NULL AS reason FROM p WHERE conv_id NOT IN (SELECT old FROM ok) UNION ALL SELECT 'turns', coalesce(new, conv_id), count(*), NULL FROM conversations LEFT JOIN ok ON conv_id = old GROUP BY 2 UNION ALL SELECT 'refused', old, new, reason FROM j WHERE reason IS NOT NULL""")
def publish_renames(spark, d):
    """Sessions and their turns, re-pointed and made visible together, read back by the pointer."""
    turns = table(spark, d, "conversations").select("conv_id", "turn")
    sessions = turns.select("conv_id").where("conv_id IS NOT NULL").distinct()
    i = F.col("conv_id")
    moves = sessions.where(i % 10 == 3).select(i.alias("old"), F.when(i % 30 == 13, -1).when(i % 30 == 23, i).otherwise(i + 1).alias("new"))
    moves = moves.unionByName(sessions.where(i % 40 == 3).select(i.alias("old"), (i + 2).alias("new"))).unionByName(sessions.where(i % 10 == 4).select(i.alias("old"), (i + 9).alias("new")))
    parents, (children,), refused = C.rename_all(sessions, [turns], "conv_id", moves)
    root = fresh_path(spark, "index")

    def whole(tables):
        lost = C.reference_violations(tables["turns"], tables["sessions"], "conv_id", "conv_id", "turns").take(1)
        if lost:
            raise ValueError(f"turns without a session: {lost}")

    P.publish(root, {"sessions": parents, "turns": children, "refused": refused}, guards=(whole,))
    now = P.current(spark, root)
    none = F.lit(None).cast("string").alias("reason")
    out = now["sessions"].select(F.lit("sessions").alias("part"), i.alias("id"), F.lit(1).cast("long").alias("n"), none)
    out = out.unionByName(now["turns"].groupBy(i.alias("id")).agg(F.count("*").alias("n")).select(F.lit("turns").alias("part"), "id", "n", none))
    return out.unionByName(now["refused"].select(F.lit("refused").alias("part"), F.col("old").alias("id"), F.col("new").alias("n"), "reason"))
