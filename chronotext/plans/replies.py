"""Queries over model responses: whole ones made from the documents' lines, in every fortieth session with one planted fault.

A fault is a pattern in the response's JSON and what stands for it; beside it are the rules that it must break, which are all that the SQL expects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotext.operators import responses as R
from chronotext.sources.bindings import seg_docs

from .base import SEG, query

EACH = 40
_TEXT = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'  # without a step a character: long texts would overflow the stack

#: remainder of the session's id: (pattern, replacement, ((category, rule, item), ...))
OUTLINE_FAULTS = {
    0: ('("id":"d0",)"topic_id":"t0",', "$1", (("definitions", "fields", "d0"),)),
    1: ('"id":"d0"', '"id":" "', (("definitions", "id", "#0"),)),
    2: ('("id":"d0",.*?"label":)"Def"', '$1" "', (("definitions", "text_empty", "d0"),)),
    3: ('("id":"d0",.*?"label":)"Def"', '$1"<input_json>"', (("definitions", "text_strange", "d0"),)),
    4: (r'("id":"d0",.*?"uncertain":)\[\]', "$1[1]", (("definitions", "uncertain_list", "d0"),)),
    5: (r'("id":"d0",.*?"source_segment_ids":)\[0,1\]', "$1[0,0]", (("definitions", "sources_list", "d0"),)),
    6: (r'("id":"d0",.*?"source_segment_ids":)\[0,1\]', "$1[0,99999]", (("definitions", "sources_unknown", "d0"),)),
    7: (r'("id":"d0",.*?"source_segment_ids":)\[0,1\]', "$1[1,0]", (("definitions", "sources_order", "d0"),)),
    8: ('("id":"d0","topic_id":)"t0"', '$1"zz"', (("definitions", "topic_unknown", "d0"),)),
    9: ('("id":"d0","topic_id":)"t0"', '$1"t1"', (("definitions", "sources_outside_topic", "d0"),)),
    10: ('"id":"d1"', '"id":"d0"', (("definitions", "id_repeated", "d0"),)),
    11: (r'("id":"d0",.*?"start":)0\.0', '$1"0.0"', (("definitions", "start_kind", "d0"),)),
    12: ('("id":"d0",.*?"end":)[0-9.E]+', "$1true", (("definitions", "end_kind", "d0"),)),
    13: (r'("id":"d0",.*?"start":)0\.0', "$11e9", (("definitions", "span", "d0"), ("definitions", "start_time", "d0"))),
    14: (r'("id":"d0",.*?"start":)0\.0', "$12.0", (("definitions", "start_time", "d0"),)),
    15: ('("id":"d0",.*?"end":)([0-9.E]+)', "$19$2", (("definitions", "end_time", "d0"),)),
    16: ('("id":"t0","title":"Topic","type":)"content"', '$1"party"', (("lecture_topics", "type", "t0"),)),
    17: (r'("id":"t0","title":"Topic","type":"content","start":)0\.0', "$12.0", (("lecture_topics", "start_time", "t0"),)),
    18: (r'("id":"t0",.*?"source_segment_ids":)\[0,1,2,3,4\]', "$1[0,1,2,3]", (("lecture_topics", "segment_missing", "4"),)),
    19: (r'("id":"t0",.*?"source_segment_ids":)\[0,1,2,3,4\]', "$1[0,1,2,3,4,5]", (("lecture_topics", "segment_repeated", "5"), ("lecture_topics", "topics_order", "t1"))),
    20: ('"to_topic_id":"t1"', '"to_topic_id":"zz"', (("transitions", "transition_unknown", "m1"),)),
    21: ('"to_topic_id":"t1"', '"to_topic_id":"t0"', (("transitions", "transition_same", "m1"),)),
    22: ("^", "", (("derivations", "derivation_missing", "0"),)),  # the session's first segment announces one
    23: (r"^\{", '{"more":[],', (("response", "keys", "response"),)),
    24: (r'"exam_tips":\[\]', '"exam_tips":5', (("response", "lists", "response"),)),
    25: (".$", "", (("response", "keys", "response"),)),
}
KNOWLEDGE_FAULTS = {
    0: ('("id":"c0",)"topic_id":"t0",', "$1", (("concepts", "fields", "c0"), ("definitions", "outline_lost", "0"))),
    1: (r'("id":"c0",.*?"importance":)0\.9', "$11.5", (("concepts", "importance_range", "c0"),)),
    2: (r'("id":"c0",.*?"importance":)0\.9', "$10.5", (("concepts", "importance_low", "c0"),)),
    3: (r'("id":"c0",.*?"importance":)0\.9', '$1"0.9"', (("concepts", "importance_range", "c0"),)),
    4: ('("id":"e0",.*?"status":)"complete"', '$1"fine"', (("equations", "status", "e0"),)),
    5: ('("id":"e0",.*?"status":)"complete"', '$1"incomplete"', (("equations", "doubt_unsaid", "e0"), ("equations", "unrouted", "e0"))),
    6: ("^", "", (("equations", "no_evidence", "e0"), ("derivations", "no_evidence", "v0"))),  # the first segment has no formula
    7: (r'("id":"v0",.*?"steps":)\["a","b"\]', '$1["a"]', (("derivations", "steps_few", "v0"),)),
    8: (r'("id":"v0",.*?"steps":)\["a","b"\]', '$1["a"," "]', (("derivations", "step_strange", "v0"),)),
    9: ('("id":"w0",.*?"reference_type":)"board"', '$1"wall"', (("visual_references", "reference_type", "w0"),)),
    10: (r'("id":"w0",.*?"confidence":)0\.5', "$12.5", (("visual_references", "confidence_range", "w0"),)),
    11: ('("id":"w0",.*?"timestamp":)', "$19", (("visual_references", "timestamp", "w0"),)),
    12: (r'("id":"u0",.*?"source_segment_ids":)\[1\]', "$1[0]", (("uncertain_items", "doubt_lost", "1"),)),
    13: ("^", "", (("visual_references", "visual_lost", "3"),)),  # one more segment refers to something seen
    14: (r'("id":"c0",.*?"source_segment_ids":)\[0\]', "$1[3]", (("definitions", "outline_lost", "0"),)),
    15: ('("id":"v0",.*?"status":)"complete"', '$1"uncertain"', (("derivations", "doubt_unsaid", "v0"), ("derivations", "unrouted", "v0"))),
    16: ('("id":"u0",.*?"content":)"C"', '$1" "', ()),  # its only source is blank, so it may be
    17: ('("id":"u0",.*?"content":)"C"', '$1" "', (("uncertain_items", "text_empty", "u0"),)),
    18: (r'("id":"c0",.*?"source_segment_ids":)\[0\]', "$1[1,0]", (("concepts", "sources_order", "c0"),)),
    19: (r',"derivations":\[.*\]\}$', "}", ()),  # the first version
    20: ('("id":"c0",.*?"explanation":)"E"', '$1"a<cleaned_json>b"', (("concepts", "text_strange", "c0"),)),
    21: ('"id":"c1"', '"id":"c0"', (("concepts", "id_repeated", "c0"),)),
    22: ('("id":"c0","topic_id":)"t0"', '$1"zz"', (("concepts", "topic_unknown", "c0"),)),
    23: ('("id":"c0","topic_id":)"t0"', '$1"t1"', (("concepts", "sources_outside_topic", "c0"),)),
    24: ('"examples":', '"example":', (("response", "keys", "response"),)),
}
DRAFT_FAULTS = {
    0: ('("id":"s0","topic_id":"t0",)"heading":"H",', "$1", (("sections", "fields", "s0"), ("concepts", "item_missing", "c0"), ("uncertain_items", "item_missing", "u0"))),
    1: ('"id":"s0"', '"id":""', (("sections", "id_text", ""),)),
    2: ('("id":"s0",.*?"heading":)"H"', '$1"a [[b]]"', (("sections", "heading_text", "s0"),)),
    3: ('("id":"s0",.*?"summary":)"S"', r'$1"a\\nb"', (("sections", "summary_text", "s0"),)),
    4: ('("id":"s0","topic_id":)"t0"', '$1"t1"', (("sections", "section_order", "s0"), ("sections", "sources_outside_topic", "s0"), ("concepts", "item_wrong_topic", "c0"), ("uncertain_items", "item_wrong_topic", "u0"))),
    5: (r'("id":"s0",.*?"source_segment_ids":)\[0,', "$1[0,0,", (("sections", "sources_list", "s0"),)),
    6: (r'("id":"s0",.*?"source_segment_ids":)\[0,1,', "$1[1,0,", (("sections", "sources_order", "s0"),)),
    7: (r'"concept_ids":\["c0"\]', '"concept_ids":["c0","c0"]', (("sections", "item_list", "s0"), ("concepts", "item_repeated", "c0"))),
    8: (r'"concept_ids":\["c0"\]', '"concept_ids":["zz"]', (("concepts", "item_unknown", "zz"), ("concepts", "item_missing", "c0"))),
    9: (r'"concept_ids":\["c0"\]', '"concept_ids":["c1"]', (("concepts", "item_wrong_topic", "c1"), ("concepts", "item_repeated", "c1"), ("concepts", "provenance", "c1"), ("concepts", "item_missing", "c0"))),
    10: (r'("id":"s0",.*?"source_segment_ids":)\[0,', "$1[", (("concepts", "provenance", "c0"),)),
    11: ('"title":"T"', '"title":" "', (("response", "title_text", "response"),)),
    12: (r'("closing_summary":\[)(\{.*\})\]', "$1$2,$2,$2,$2,$2,$2]", (("response", "closing_many", "response"),)),
    13: ('"content":"C"', '"content":"> [!note]"', (("closing_summary", "closing_text", "#0"),)),
    14: (r'("content":"C","source_segment_ids":)\[0\]', "$1[-5]", (("closing_summary", "sources_outside_topic", "#0"),)),
    15: ('"content":"C",', "", (("closing_summary", "fields", "#0"),)),
    16: ('"id":"s1"', '"id":"s0"', (("sections", "id_repeated", "s0"),)),
    17: ('"closing_summary":', '"closing":', (("response", "keys", "response"),)),
}
CLEAN_FAULTS = {
    0: ('"id":0,', '"id":77777,', (("segments", "topology", "0"),)),
    1: (r'^(.*?),"corrections":\[\]', "$1", (("segments", "fields", "0"),)),
    2: (f'^(.*?"text":){_TEXT}', "$15", (("segments", "text_kind", "0"),)),
    3: (r'^(.*?"uncertain":)\[[^\]]*\]', "$1[5]", (("segments", "uncertain_list", "0"),)),
    4: (r'^(.*?"visual_references":)\[\]', "$15", (("segments", "visual_list", "0"),)),
    5: (r'^(.*?"corrections":)\[\]', '$1[{"original":"a"}]', (("segments", "corrections", "0"),)),
    6: (r'^(.*?"corrections":)\[\]', '$1[{"original":"a","corrected":"","decision":"delete","reason":"r"}]', ()),
    7: ('"segments":', '"parts":', (("response", "keys", "response"),)),
}


def _expected(faults: dict) -> str:
    rows = ", ".join(f"({j}, '{c}', '{r}', '{i}')" for j, (_, _, broken) in faults.items() for c, r, i in broken)
    return SEG + f", many AS (SELECT session_id FROM seg GROUP BY session_id HAVING count(*) >= 10), f(j, category, rule, item_id) AS (VALUES {rows}) SELECT session_id, category, rule, item_id FROM many JOIN f ON session_id % {EACH} = j"


def _planted(whole: DataFrame, faults: dict) -> DataFrame:
    """whole: session_id, n (segments), response."""
    out, j = F.col("response"), F.when(F.col("n") >= 10, F.col("session_id") % EACH)
    for k, (pattern, new, _) in faults.items():
        out = F.when(j == k, F.regexp_replace("response", f"(?s){pattern}" if k != 12 else pattern, new)).otherwise(out)
    return whole.select("session_id", out.alias("response"))


def _at(seg: DataFrame, remainder: int, place: int) -> Column:
    return (F.col("n") >= 10) & (F.col("session_id") % EACH == remainder) & (F.col("id") == place)


def with_counts(seg: DataFrame) -> DataFrame:
    return seg.join(seg.groupBy("session_id").agg(F.count("*").alias("n")), "session_id")


def _topics(seg: DataFrame) -> DataFrame:
    """session_id, n, ts: topics of five segments each (k, ids, starts, ends, texts), in order."""
    row = F.array_sort(F.collect_list(F.struct("id", "seg_start", "seg_end")))
    per = seg.groupBy("session_id", "n", F.floor(F.col("id") / 5).alias("k")).agg(row.alias("r"))
    return per.groupBy("session_id", "n").agg(F.array_sort(F.collect_list(F.struct("k", "r"))).alias("ts"))


def _none() -> Column:
    return F.array().cast("array<string>")


def _empty() -> Column:
    return F.array().cast("array<struct<id:string>>")


def _ids(t: Column, *places: int) -> Column:
    """The ids of the topic's members at those places (of a short topic, those there are)."""
    return F.transform(F.slice(t["r"], places[0] + 1, len(places)), lambda x: x["id"])


def _span(t: Column, ids: Column) -> list[Column]:
    return [t["r"][0]["seg_start"].alias("start"), F.element_at(F.slice(t["r"], 1, F.size(ids)), -1)["seg_end"].alias("end"), ids.alias("source_segment_ids"), _none().alias("uncertain")]


def _key(letter: str, t: Column, name: str = "id") -> Column:
    return F.concat(F.lit(letter), t["k"].cast("string")).alias(name)


def _text(value: str, name: str) -> Column:
    return F.lit(value).alias(name)


def outline_replies(seg: DataFrame) -> DataFrame:
    ts = F.col("ts")
    every = lambda t: F.transform(t["r"], lambda x: x["id"])
    topics = F.transform(ts, lambda t: F.struct(_key("t", t), _text("Topic", "title"), _text("content", "type"), *_span(t, every(t))))
    definitions = F.transform(ts, lambda t: F.struct(_key("d", t), _key("t", t, "topic_id"), _text("Def", "label"), *_span(t, _ids(t, 0, 1))))
    before = lambda t: F.concat(F.lit("t"), (t["k"] - 1).cast("string")).alias("from_topic_id")
    moves = F.transform(F.slice("ts", 2, F.size("ts")), lambda t: F.struct(_key("m", t), before(t), _key("t", t, "to_topic_id"), _text("Next", "cue"), *_span(t, _ids(t, 0))))
    rest = {c: _empty() for c in ("subtopics", "derivations", "examples", "teacher_emphasis", "exam_tips")}
    whole = F.to_json(F.struct(topics.alias("lecture_topics"), *(v.alias(c) for c, v in rest.items()), definitions.alias("definitions"), moves.alias("transitions")))
    return _topics(seg).select("session_id", "n", whole.alias("response"))


@query(_expected(OUTLINE_FAULTS))
def outline_response_rules(spark, d):
    seg = with_counts(seg_docs(spark, d))
    seg = seg.withColumn("text", F.when(_at(seg, 22, 0), F.concat(F.lit("下面我们进行证明"), "text")).otherwise(F.col("text")))
    return R.outline_response_violations(_planted(outline_replies(seg), OUTLINE_FAULTS), seg.drop("n"))


def knowledge_replies(seg: DataFrame) -> DataFrame:
    own = lambda letter, t: (_key(letter, t), _key("t", t, "topic_id"))
    trace = lambda ids: (ids.alias("source_segment_ids"), _none().alias("uncertain"))
    at = lambda k: F.filter("ts", lambda t: F.size(t["r"]) > k)
    concepts = F.transform("ts", lambda t: F.struct(*own("c", t), _text("N", "name"), _text("E", "explanation"), F.lit(0.9).alias("importance"), *trace(_ids(t, 0))))
    equations = F.transform("ts", lambda t: F.struct(*own("e", t), _text("N", "name"), _text("x=1", "expression"), _text("complete", "status"), *trace(_ids(t, 0))))
    derivations = F.transform("ts", lambda t: F.struct(*own("v", t), _text("N", "name"), F.array(F.lit("a"), F.lit("b")).alias("steps"), _text("Z", "conclusion"), _text("complete", "status"), *trace(_ids(t, 0))))
    doubts = F.transform(at(1), lambda t: F.struct(*own("u", t), _text("C", "content"), _text("R", "reason"), _ids(t, 1).alias("source_segment_ids")))
    visuals = F.transform(at(2), lambda t: F.struct(*own("w", t), t["r"][2]["seg_start"].alias("timestamp"), _text("X", "context"), _text("board", "reference_type"), F.lit(0.5).alias("confidence"), *trace(_ids(t, 2))))
    rest = {c: _empty() for c in ("examples", "teacher_emphasis", "exam_tips", "common_errors", "open_questions")}
    whole = F.struct(concepts.alias("concepts"), equations.alias("equations"), doubts.alias("uncertain_items"), visuals.alias("visual_references"), *(v.alias(c) for c, v in rest.items()), derivations.alias("derivations"))
    return _topics(seg).select("session_id", "n", F.to_json(whole).alias("response"))


@query(_expected(KNOWLEDGE_FAULTS))
def knowledge_response_rules(spark, d):
    seg = with_counts(seg_docs(spark, d))
    text = F.when(_at(seg, 6, 0), "plain words").when(_at(seg, 16, 1), "").otherwise(F.concat("text", F.lit(" =1")))
    seg = seg.withColumn("text", text).withColumn("uncertain", F.col("id") % 5 == 1).withColumn("visual", (F.col("id") % 5 == 2) | _at(seg, 13, 3))
    topics = seg.groupBy("session_id", F.floor(F.col("id") / 5).alias("place")).agg(F.sort_array(F.collect_list(F.col("id").cast("long"))).alias("sources")).withColumn("topic_id", F.concat(F.lit("t"), F.col("place").cast("string")))
    listed = topics.select("session_id", F.explode(F.array(F.lit("definitions"), F.lit("derivations"))).alias("category"), F.slice("sources", 1, 1).alias("sources"))
    return R.knowledge_response_violations(_planted(knowledge_replies(seg), KNOWLEDGE_FAULTS), seg.drop("n"), topics, listed)


def draft_replies(seg: DataFrame, items: dict[str, tuple[str, int]] = {"concepts": ("c", 0), "uncertain_items": ("u", 1)}) -> DataFrame:  # noqa: B006  read only
    """items: of each category the letter of its ids, and the place in a topic that it needs."""
    every = lambda t: F.transform(t["r"], lambda x: x["id"])
    one = lambda letter, t: F.array(F.concat(F.lit(letter), t["k"].cast("string")))

    def section(t: Column) -> Column:
        own = {R.ITEM_LISTS[c]: F.when(F.size(t["r"]) > place, one(letter, t)).otherwise(_none()) for c, (letter, place) in items.items()}
        lists = {f: _none() for f in R.ITEM_LISTS.values()} | own
        return F.struct(_key("s", t), _key("t", t, "topic_id"), _text("H", "heading"), _text("S", "summary"), every(t).alias("source_segment_ids"), *(v.alias(f) for f, v in lists.items()))

    closing = F.array(F.struct(_text("C", "content"), F.array(F.col("ts")[0]["r"][0]["id"]).alias("source_segment_ids")))
    return _topics(seg).select("session_id", "n", F.to_json(F.struct(_text("T", "title"), F.transform("ts", section).alias("sections"), closing.alias("closing_summary"))).alias("response"))


@query(_expected(DRAFT_FAULTS))
def draft_response_rules(spark, d):
    seg = with_counts(seg_docs(spark, d))
    topics = seg.groupBy("session_id", F.floor(F.col("id") / 5).alias("place")).agg(F.sort_array(F.collect_list(F.col("id").cast("long"))).alias("sources")).withColumn("topic_id", F.concat(F.lit("t"), F.col("place").cast("string")))
    item = lambda letter, category, place: topics.where(F.size("sources") >= place).select("session_id", F.lit(category).alias("category"), F.concat(F.lit(letter), F.col("place").cast("string")).alias("item_id"), "topic_id", F.slice("sources", place, 1).alias("sources"))
    items = item("c", "concepts", 1).unionByName(item("u", "uncertain_items", 2))
    return R.draft_response_violations(_planted(draft_replies(seg), DRAFT_FAULTS), topics, items)


def clean_replies(seg: DataFrame) -> DataFrame:
    why = F.when(F.trim("text") == "", F.array(F.lit("blank"))).otherwise(_none())
    row = F.struct("id", F.trim("text").alias("text"), why.alias("uncertain"), _none().alias("visual_references"), F.array().cast("array<struct<original:string>>").alias("corrections"))
    per = seg.groupBy("session_id", "n").agg(F.array_sort(F.collect_list(F.struct("id", row.alias("row")))).alias("rows"))
    return per.select("session_id", "n", F.to_json(F.struct(F.transform("rows", lambda x: x["row"]).alias("segments"))).alias("response"))


@query(_expected(CLEAN_FAULTS))
def clean_response_rules(spark, d):
    seg = with_counts(seg_docs(spark, d))
    return R.clean_response_violations(_planted(clean_replies(seg), CLEAN_FAULTS), seg.drop("n"))
