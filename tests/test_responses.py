"""Rules of model responses: each rule on a small hand-made session, beside a whole response that breaks none."""

import copy
import json

import pytest

from chronotext.operators import responses as R

SEG = "session_id long, id long, seg_start double, seg_end double, text string, uncertain boolean, visual boolean"
SEGMENTS = [(k, 10.0 * k, 10.0 * k + 10, t) for k, t in enumerate(["We set x = 1.", "Then y = 2.", "A picture.", "Silence", "", "The end = 5."])]


def outline():
    span = lambda a, b, ids: {"start": a, "end": b, "source_segment_ids": ids, "uncertain": []}
    return {
        "lecture_topics": [{"id": "t0", "title": "One", "type": "content", **span(0.0, 30, [0, 1, 2])}, {"id": "t1", "title": "Two", "type": "review", **span(30, 60.0, [3, 4, 5])}],
        "subtopics": [], "definitions": [{"id": "d0", "topic_id": "t0", "label": "x", **span(0, 20.5, [0, 1])}], "derivations": [], "examples": [],
        "teacher_emphasis": [], "exam_tips": [], "transitions": [{"id": "m", "from_topic_id": "t0", "to_topic_id": "t1", "cue": "so", **span(30, 40, [3])}],
    }


def knowledge():
    trace = lambda ids: {"source_segment_ids": ids, "uncertain": []}
    return {c: [] for c in R.KNOWLEDGE} | {
        "concepts": [{"id": "c0", "topic_id": "t0", "name": "x", "explanation": "one", "importance": 1, **trace([0, 1])}],
        "equations": [{"id": "e0", "topic_id": "t0", "name": "x", "expression": "x=1", "status": "complete", **trace([0])}],
        "derivations": [{"id": "v0", "topic_id": "t1", "name": "five", "steps": ["a", "b"], "conclusion": "5", "status": "incomplete", **trace([5]), "uncertain": ["why"]}],
        "visual_references": [{"id": "w0", "topic_id": "t0", "timestamp": 20.0, "context": "it", "reference_type": "image", "confidence": 0.5, **trace([2])}],
        "uncertain_items": [{"id": "u0", "topic_id": "t1", "content": " ", "reason": "no sound", "source_segment_ids": [4]}, {"id": "u1", "topic_id": "t1", "content": "five", "reason": "said fast", "source_segment_ids": [5]}],
    }


def draft():
    section = lambda k, ids, **items: {"id": f"s{k}", "topic_id": f"t{k}", "heading": "H", "summary": "S", "source_segment_ids": ids} | {f: [] for f in R.ITEM_LISTS.values()} | items
    return {"title": "T", "sections": [section(0, [0, 1, 2], concept_ids=["c0"]), section(1, [5], derivation_ids=["v0"])], "closing_summary": [{"content": "C", "source_segment_ids": [0, 5]}]}


def clean():
    return {"segments": [{"id": k, "text": t.strip(), "uncertain": [] if t else ["silent"], "visual_references": [], "corrections": []} for k, _, _, t in SEGMENTS]}


MADE = {"outline": outline, "knowledge": knowledge, "draft": draft, "clean": clean}


def broken(spark, kind, *changes):
    """The violations of each changed response, a session each; in session 0 nothing is changed."""
    texts = []
    for change in (lambda r: None, *changes):
        r = copy.deepcopy(MADE[kind]())
        texts.append(change if isinstance(change, str) else json.dumps(change(r) or r))
    n = len(texts)
    responses = spark.createDataFrame(list(enumerate(texts)), "session_id long, response string")
    seg = spark.createDataFrame([(s, k, a, b, t, k in (4, 5), k == 2) for s in range(n) for k, a, b, t in SEGMENTS], SEG)
    topics = spark.createDataFrame([(s, f"t{k}", k, ids) for s in range(n) for k, ids in enumerate(([0, 1, 2], [3, 4, 5]))], "session_id long, topic_id string, place int, sources array<long>")
    if kind == "outline":
        out = R.outline_response_violations(responses, seg)
    elif kind == "knowledge":
        listed = spark.createDataFrame([(s, c, ids) for s in range(n) for c, ids in (("definitions", [0, 1]), ("derivations", [5]))], "session_id long, category string, sources array<long>")
        out = R.knowledge_response_violations(responses, seg, topics, listed)
    elif kind == "draft":
        items = spark.createDataFrame([(s, *i) for s in range(n) for i in (("concepts", "c0", "t0", [0, 1]), ("derivations", "v0", "t1", [5]))], "session_id long, category string, item_id string, topic_id string, sources array<long>")
        out = R.draft_response_violations(responses, topics, items)
    else:
        out = R.clean_response_violations(responses, seg)
    found = [set() for _ in range(n)]
    for r in out.collect():
        assert (r.category, r.rule, r.item_id) not in found[r.session_id]
        found[r.session_id].add((r.category, r.rule, r.item_id))
    assert found[0] == set()
    return found[1:]


def put(*path):
    """A change: the last of path is set at the place that the others name; None deletes it."""

    def change(r):
        *way, last, value = path
        for p in way:
            r = r[p]
        if value is None:
            del r[last]
        else:
            r[last] = value

    return change


def test_outline_rules(spark):
    top, one, move = ("lecture_topics", 0), ("definitions", 0), ("transitions", 0)
    cases = [
        (put(*one, "extra", 1), {("definitions", "fields", "d0")}),
        (put(*one, None), set()),
        (put(*one, "id", 7), {("definitions", "id", "#0")}),
        (put(*one, "label", "x" * 201), {("definitions", "text_strange", "d0")}),
        (put(*one, "label", " \n"), {("definitions", "text_empty", "d0")}),
        (put(*one, "source_segment_ids", []), {("definitions", "sources_list", "d0")}),
        (put(*one, "source_segment_ids", [True]), {("definitions", "sources_list", "d0")}),
        (put(*one, "source_segment_ids", [0, 2]), {("definitions", "sources_order", "d0"), ("definitions", "end_time", "d0")}),
        (put(*one, "end", 22.0), {("definitions", "end_time", "d0")}),
        (put(*top, "end", 33), {("lecture_topics", "end_time", "t0")}),
        (put(*top, "type", 1), {("lecture_topics", "type", "t0")}),
        (put("lecture_topics", []), {("lecture_topics", "no_topics", "response"), ("definitions", "topic_unknown", "d0"), ("transitions", "transition_unknown", "m")} | {("lecture_topics", "segment_missing", str(k)) for k in range(6)}),
        (put(*move, "from_topic_id", "t1"), {("transitions", "transition_same", "m")}),
        (lambda r: [r], {("response", "keys", "response")}),
        ("no json", {("response", "keys", "response")}),
        (put("examples", None), {("response", "keys", "response")}),
        (lambda r: {**r, "lecture_topics": r["lecture_topics"][::-1]}, {("lecture_topics", "topics_order", "t0"), ("lecture_topics", "end_time", "t1")}),
    ]
    for got, (_, want) in zip(broken(spark, "outline", *(c for c, _ in cases)), cases, strict=True):
        assert got == want


def test_knowledge_rules(spark):
    def first_version(r):
        del r["derivations"]
        r["equations"].append({**r["equations"][0], "id": "e5", "topic_id": "t1", "source_segment_ids": [5]})

    cases = [
        (put("concepts", 0, "importance", True), {("concepts", "importance_range", "c0")}),
        (put("concepts", 0, "importance", 0.79), {("concepts", "importance_low", "c0")}),
        (put("concepts", []), {("definitions", "outline_lost", "0"), ("definitions", "outline_lost", "1")}),
        (put("equations", 0, "source_segment_ids", [2]), {("equations", "no_evidence", "e0")}),
        (put("equations", 0, "status", "uncertain"), {("equations", "doubt_unsaid", "e0"), ("equations", "unrouted", "e0")}),
        (put("derivations", 0, "steps", "ab"), {("derivations", "steps_few", "v0")}),
        (put("derivations", 0, "steps", ["a", "b" * 2001]), {("derivations", "step_strange", "v0")}),
        (put("derivations", 0, "steps", ["a", 2]), {("derivations", "step_strange", "v0")}),
        (put("visual_references", 0, "timestamp", 22), {("visual_references", "timestamp", "w0")}),
        (put("visual_references", 0, "confidence", -0.1), {("visual_references", "confidence_range", "w0")}),
        (put("visual_references", []), {("visual_references", "visual_lost", "2")}),
        (put("uncertain_items", 1, None), {("uncertain_items", "doubt_lost", "5"), ("derivations", "unrouted", "v0")}),
        (put("uncertain_items", 1, "content", ""), {("uncertain_items", "text_empty", "u1")}),  # its source speaks
        (put("uncertain_items", 0, "reason", ""), {("uncertain_items", "text_empty", "u0")}),
        (put("concepts", 0, "source_segment_ids", [1, 0]), {("concepts", "sources_order", "c0")}),
        (put("concepts", 0, "source_segment_ids", [0, 1, 2, 5]), {("concepts", "sources_outside_topic", "c0")}),
        (lambda r: r.update(open_questions=[{"id": f"q{k}", "topic_id": "t0", "content": "?", "source_segment_ids": [0], "uncertain": []} for k in range(7)]), {("open_questions", "too_many", "response")}),
        (first_version, set()),
        (put("derivations", None), set()),  # u1 holds the source
        ("[]", {("response", "keys", "response")}),
    ]
    for got, (_, want) in zip(broken(spark, "knowledge", *(c for c, _ in cases)), cases, strict=True):
        assert got == want


def test_draft_rules(spark):
    cases = [
        (put("title", "x" * 201), {("response", "title_text", "response")}),
        (put("sections", 0, "summary", "x" * 5001), {("sections", "summary_text", "s0")}),
        (put("sections", 0, "heading", 3), {("sections", "heading_text", "s0")}),
        (put("sections", 1, None), {("sections", "section_count", "response"), ("derivations", "item_missing", "v0")}),
        (lambda r: {**r, "sections": r["sections"][::-1]}, {("sections", "section_order", "s0"), ("sections", "section_order", "s1")}),
        (put("sections", 0, "source_segment_ids", [0]), {("concepts", "provenance", "c0")}),
        (put("sections", 0, "source_segment_ids", [1, 0]), {("sections", "sources_order", "s0")}),
        (put("sections", 0, "concept_ids", [1]), {("sections", "item_list", "s0"), ("concepts", "item_missing", "c0")}),
        (put("sections", 0, "concept_ids", ["c0", ""]), {("sections", "item_list", "s0"), ("concepts", "item_unknown", "")}),
        (put("sections", 1, "concept_ids", ["c0"]), {("concepts", "item_repeated", "c0"), ("concepts", "item_wrong_topic", "c0"), ("concepts", "provenance", "c0")}),
        (lambda r: {**r, "closing_summary": r["closing_summary"] * 5}, set()),
        (lambda r: {**r, "closing_summary": r["closing_summary"] * 6}, {("response", "closing_many", "response")}),
        (put("closing_summary", 0, "source_segment_ids", [5, 0]), {("closing_summary", "sources_order", "#0")}),
        (put("closing_summary", 0, "content", "a\nb"), {("closing_summary", "closing_text", "#0")}),
        (put("closing_summary", {}), {("response", "lists", "response")}),
        ("{}", {("response", "keys", "response")}),
    ]
    for got, (_, want) in zip(broken(spark, "draft", *(c for c, _ in cases)), cases, strict=True):
        assert got == want


def test_clean_rules(spark):
    cases = [
        (put("segments", 4, "uncertain", []), {("segments", "blank_unsaid", "4")}),
        (put("segments", 3, "text", "x" * 51), {("segments", "expansion", "response")}),
        (put("segments", 3, "text", "x" * 60), {("segments", "expanded", "3"), ("segments", "expansion", "response")}),
        (lambda r: {"segments": [{**s, "text": s["text"][:1]} for s in r["segments"]]}, {("segments", "retention", "response")}),
        (put("segments", 0, "corrections", [{"original": "a", "corrected": "b", "decision": "c", "reason": 1}]), {("segments", "corrections", "0")}),
        (put("segments", 0, "corrections", [{"original": "a", "corrected": "b", "decision": "c", "reason": "d"}]), set()),
        (put("segments", 5, None), {("segments", "topology", "5")}),
        (lambda r: {"segments": r["segments"] + [{**r["segments"][0], "id": 6}]}, {("segments", "topology", "6")}),
        (put("segments", 0, "text", 1), {("segments", "text_kind", "0")}),
        ('{"segments": 1}', {("response", "lists", "response")} | {("segments", "topology", str(k)) for k in range(6)}),
    ]
    for got, (_, want) in zip(broken(spark, "clean", *(c for c, _ in cases)), cases, strict=True):
        assert got == want


def test_clean_counts_copies_once(spark):
    """Six equal segments whose copies are blanked keep all of their text."""
    rows = [(1, k, "So it is.") for k in range(6)] + [(1, 6, "And more of it.")]
    reply = {"segments": [{"id": k, "text": t if k in (0, 6) else "", "uncertain": [] if k in (0, 6) else ["copy"], "visual_references": [], "corrections": []} for _, k, t in rows]}
    seg = spark.createDataFrame(rows, "session_id long, id long, text string")
    out = lambda n: R.clean_response_violations(spark.createDataFrame([(1, json.dumps(reply))], "session_id long, response string"), seg, repeats=n).collect()
    assert out(6) == [] and [r.rule for r in out(7)] == ["retention"]


@pytest.mark.parametrize("kind", sorted(MADE))
def test_empty_tables(spark, kind):
    none = spark.createDataFrame([], "session_id long, response string")
    seg = spark.createDataFrame([], SEG)
    topics = spark.createDataFrame([], "session_id long, topic_id string, place int, sources array<long>")
    items = spark.createDataFrame([], "session_id long, category string, item_id string, topic_id string, sources array<long>")
    out = {"outline": lambda: R.outline_response_violations(none, seg), "knowledge": lambda: R.knowledge_response_violations(none, seg, topics, items), "draft": lambda: R.draft_response_violations(none, topics, items), "clean": lambda: R.clean_response_violations(none, seg)}[kind]()
    assert out.count() == 0 and out.columns == ["session_id", "category", "rule", "item_id"]
