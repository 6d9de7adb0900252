"""Rendered drafts and transcripts, prompts, merges, usage and repair summaries on hand-made sessions."""

import json

import pytest
from pyspark.sql import functions as F

from chronotext.config import MergeConfig
from chronotext.functions import markdown as M
from chronotext.operators import incremental as I
from chronotext.operators import merge as MG
from chronotext.operators import repair as RP
from chronotext.operators import sequence as S
from chronotext.sources import draft as D
from chronotext.sources import sinks as K

# ---- the audio draft ----


def _draft(course="c", **lists):
    from chronotext.operators.responses import ITEM_LISTS, KNOWLEDGE

    knowledge = {c: [] for c in KNOWLEDGE}
    section = {"id": "s", "topic_id": "t", "heading": "H [[x]]", "summary": "two\nlines", "source_segment_ids": [1, 2]} | {f: [] for f in ITEM_LISTS.values()}
    for category, items in lists.items():
        knowledge[category] = [{"id": f"i{k}", "topic_id": "t", "source_segment_ids": [1], "uncertain": [], **x} for k, x in enumerate(items)]
        section[ITEM_LISTS[category]] = [f"i{k}" for k in reversed(range(len(items)))]
    outline = {"lecture_topics": [{"id": "t", "title": "One", "start": 0, "end": 3725.0, "source_segment_ids": [1, 2]}]}
    return {"title": "T", "sections": [section], "closing_summary": []}, outline, knowledge, course


def render(spark, *args, **lists):
    draft, outline, knowledge, course = _draft(*args, **lists)
    one = lambda x: spark.createDataFrame([(1, json.dumps(x))], "session_id long, response string")
    drafts = spark.createDataFrame([(1, course, "2024-01-02", json.dumps(draft))], "session_id long, course string, date string, response string")
    return D.audio_draft(drafts, one(outline), one(knowledge)).collect()[0]


def inside(row, **_):
    """What stands between the section's summary and the footer."""
    return row.markdown.split("two lines")[1].split("\n\n---\n")[0]


def test_draft_frame_and_escapes(spark):
    row = render(spark)
    assert row.markdown.startswith('---\ncourse: "c"\ndate: "2024-01-02"\nsession_id: "1"\nsource_layer: AUDIO_ONLY\nfinal: false\n---\n\n# T\n\n')
    assert "- [00:00:00–01:02:05] One" in row.markdown and r"## 1. H \[\[x\]\]" in row.markdown and "`音频 00:00:00–01:02:05` 〔segments: 1, 2〕" in row.markdown
    assert D.CLOSING not in row.markdown and not row.refused


def test_draft_refuses_wikilinks(spark):
    row = render(spark, "c [[x]]")
    assert row.refused and row.markdown is None
    assert render(spark, 'c "q"').markdown.splitlines()[1] == 'course: "c \\"q\\""'


@pytest.mark.parametrize(
    ("category", "items", "want"),
    [
        ("concepts", [{"name": "n", "explanation": "e", "uncertain": ["u\nv"]}, {"name": "[[m]]", "explanation": "f"}], "\n\n### 核心概念\n\n- **\\[\\[m\\]\\]**：f 〔segments: 1〕\n- **n**：e 〔segments: 1〕\n  - 不确定：u v"),
        ("equations", [{"name": "n", "expression": "x", "status": "complete"}, {"name": "m", "expression": "$y$", "status": "complete"}], "\n\n### 公式与推导\n\n- **m**：$y$ 〔segments: 1〕\n- **n**：$x$ 〔segments: 1〕"),
        ("equations", [{"name": "n", "expression": "x", "status": "uncertain", "uncertain": ["u"]}], "\n\n### 公式与推导\n\n> [!question] 公式尚未核验\n> **n**：x\n> 状态：uncertain；〔segments: 1〕\n> - u"),
        ("derivations", [{"name": "n", "steps": ["a", "b"], "conclusion": "c", "status": "complete", "uncertain": ["u"]}], "\n\n### 推导过程\n\n**n** 〔segments: 1〕\n\n1. a\n2. b\n\n→ **结论**：c\n  - 不确定：u\n"),
        ("derivations", [{"name": "n", "steps": ["a", "b"], "conclusion": "c", "status": "incomplete", "uncertain": ["u"]}], "\n\n### 推导过程\n\n> [!question] 推导尚未核验\n> **n** 〔segments: 1〕\n> 状态：incomplete\n> 1. a\n> 2. b\n> → **结论**：c\n> - u\n"),
        ("examples", [{"title": "n", "content": "e"}], "\n\n### 课堂例题 / 示例\n\n- **n**：e 〔segments: 1〕"),
        ("teacher_emphasis", [{"content": "x"}], "\n\n> [!important] 老师强调\n> x 〔segments: 1〕"),
        ("exam_tips", [{"content": "x", "uncertain": ["u"]}], "\n\n> [!tip] 考试提示\n> x 〔segments: 1〕\n> - 不确定：u"),
        ("common_errors", [{"content": "x"}], "\n\n> [!warning] 常见错误\n> x 〔segments: 1〕"),
        ("open_questions", [{"content": "x"}], "\n\n> [!question] 课堂未决问题\n> x 〔segments: 1〕"),
        ("uncertain_items", [{"content": "x", "reason": "r"}], "\n\n> [!question] 音频内容待核验\n> x 〔segments: 1〕\n> 原因：r"),
        ("visual_references", [{"timestamp": 61.4, "context": "x", "reference_type": "slide", "confidence": 1}], "\n\n> [!question] 待板书 / 课件补充\n> [00:01:01] x\n> 类型：slide；状态：unresolved；〔segments: 1〕"),
    ],
)
def test_draft_items(spark, category, items, want):
    assert inside(render(spark, **{category: items})) == want


# ---- transcripts, prompts ----


def test_layer_markdown(spark):
    told = spark.createDataFrame([(1, "c", "d", "f", 3, 2, 1, 1, "RAW"), (2, None, None, None, 0, 0, 0, 0, "RAW")], "session_id long, course string, date string, fingerprint string, regions int, windows int, accepted int, rejected int, source_layer string")
    seg = spark.createDataFrame([(1, 1, 61.0, "b", ["x", "y"]), (1, 0, 0.0, None, [])], "session_id long, id int, seg_start double, text string, uncertain array<string>")
    got = {r.session_id: r.markdown for r in K.layer_markdown(told, seg, "clean").collect()}
    assert got[1].endswith("不是课堂摘要。\n\n`[00:00:00]` \n\n`[00:01:01]` b  ⚠ x；y\n") and "# 忠实清洗转录 · c\n" in got[1]
    assert got[2].startswith("---\nsession_id: 2\ncourse: \ndate: \n") and "# 忠实清洗转录 · 2\n" in got[2]
    assert "接受 1 个修复，拒绝 1 个" in {r.session_id: r.markdown for r in K.layer_markdown(told, seg, "repaired").collect()}[1]
    with pytest.raises(ValueError, match="no such layer"):
        K.layer_markdown(told, seg, "raw")


def test_clean_prompt_is_pythons_json(spark):
    rows = [{"id": 0, "text": 'a "q"\n'}, {"id": 1, "text": "é"}, {"id": 2, "text": None}]
    df = spark.createDataFrame([(rows, ["x", "y"], ""), ([], [], "before")], "rows array<struct<id:int,text:string>>, terms array<string>, context string")
    out = df.select(M.clean_prompt(F.lit("{{mode}}|{{course_name}}|{{glossary}}|{{segments_json}}|{{boundary_context}}"), F.lit("m"), F.lit("c"), F.col("terms"), F.col("rows"), ["id", "text"], F.col("context")).alias("p")).collect()
    assert out[0].p == "m|c|x、y|" + json.dumps(rows, ensure_ascii=False, indent=2) + "|无" and out[1].p == "m|c|（无）|[]|before"
    assert df.select(M.filled(F.lit("{{left}}")).alias("p")).first().p is None


# ---- merges ----

SESSIONS = "session_id long, state string, start_sec double, duration_sec double, course_key string, date string, merged_into string"


def test_merge_rules_and_gaps(spark):
    sessions = spark.createDataFrame([(1, "DONE", 0.0, 100.0, "a", "d", None), (2, "DONE", 130.0, 50.0, "a", "d", None), (3, "DONE", 185.0, None, "a", "d", None), (4, "NEW", 10.0, 1.0, "a", "d", None), (5, "DONE", None, 1.0, "a", "d", None), (6, "DONE", 50.0, 10.0, "b", "e", "x"), (7, "DONE", 9999.0, 1.0, "a", "d", None), (8, "DONE", 99.5, 1.0, "a", "d", None)], SESSIONS)
    seg = spark.createDataFrame([(k, 0.0, 10.0, f"s{k}") for k in (1, 2, 3, 4, 5, 6, 8)], "session_id long, seg_start double, seg_end double, text string")
    asked = {10: [1, 2, 3], 11: [1], 12: [1, 1, 2], 13: [1, 4], 14: [1, 5], 15: [1, 6], 16: [1, 7], 17: [1, 99], 18: [1, 8]}
    requests = spark.createDataFrame([(q, s) for q, ids in asked.items() for s in ids], "request_id long, session_id long")
    got = {}
    for r in MG.merge_violations(requests, sessions, seg).collect():
        got.setdefault(r.session_id, set()).add((r.rule, r.item_id))
    assert got == {
        11: {("too_few", "request")}, 12: {("repeated", "1")}, 13: {("state", "4"), ("overlap", "4")}, 14: {("no_start", "5")}, 15: {("merged", "6"), ("overlap", "6"), ("several_courses", "request"), ("several_dates", "request")},
        16: {("gap", "7"), ("no_segments", "7")}, 17: {("unknown", "99")},
    }
    plan = MG.merge_plan(requests, sessions, seg)
    assert sorted(tuple(r) for r in plan.collect()) == [(10, 1, 0.0, 0.0), (10, 2, 130.0, 30.0), (10, 3, 185.0, 0.0), (18, 1, 0.0, 0.0), (18, 8, 99.5, 0.0)]  # half a second of overlap is none
    line = MG.merged_segments(plan, seg).where("request_id = 10").orderBy("seg_start").collect()
    assert [tuple(r)[1:] for r in line] == [("segment", 0.0, 10.0, "s1"), ("gap", 100.0, 130.0, None), ("segment", 130.0, 140.0, "s2"), ("segment", 185.0, 195.0, "s3")]
    mixed = spark.createDataFrame([(1, 1), (1, 6)], "request_id long, session_id long")
    assert "several_courses" not in {r.rule for r in MG.merge_violations(mixed, sessions, seg, MergeConfig(), any_course=True).collect()}


def test_cleaned_violations(spark):
    rows = [(1, 0, 0, 0, 0.0, 5.0), (1, 1, 0, 0, 5.0, 6.0), (1, 2, 2, None, 5.9, 7.0), (1, 3, 3, 3, 7.0, 6.0), (2, 0, 5, 5, 0.0, 0.0)]
    got = S.cleaned_violations(spark.createDataFrame(rows, "s int, place int, id int, source_segment_id int, seg_start double, seg_end double"), ["s"]).collect()
    assert {tuple(r) for r in got} == {(1, 0, "repeated"), (1, 2, "provenance"), (1, 2, "timeline"), (1, 3, "timeline")}


# ---- accounts ----


def test_usage_counts_only_real_calls(spark):
    columns = "session_id long, stage string, llm_called boolean, cache_hit boolean, provider string, attempt_count int, failed_attempts int, " + ", ".join(f"{t} long" for t in I.TOKENS)
    row = lambda *a: (1, *a, 10, 5, 15, 100, 50, 2)
    rows = [row("chunk", None, False, "openai", 3, 2), row("chunk", None, True, "openai", 9, 9), row("boundary", True, None, "web", 0, None), row("boundary", False, False, "openai", 1, 1), row("boundary", None, False, "openai", 1, 1)]
    rows.append((2, "chunk", None, True, "web", None, None, *[None] * 6))
    one, two = sorted(I.usage(spark.createDataFrame(rows, columns)).collect())
    assert (one.llm_calls, one.api_calls, one.cache_hits, one.requests_total, one.successful_requests, one.failed_requests) == (2, 1, 1, 4, 2, 2)
    assert (one.input_tokens, one.output_tokens, one.total_tokens, one.input_chars, one.output_chars, one.web_turns, one.token_usage_available) == (20, 10, 30, 200, 100, 4, True)
    assert (two.llm_calls, two.cache_hits, two.total_tokens, two.token_usage_available) == (0, 1, 0, False)


def test_repair_summary_measures(spark):
    schema = "session_id long, id int, seg_start double, seg_end double, text string"
    loop = "again and again " * 20
    before = spark.createDataFrame([(1, 0, 0.0, 10.0, loop), (1, 1, 10.0, 25.5, "A plain sentence about the weather in spring."), (1, 2, 25.5, 30.0, loop), (2, 0, 0.0, 1.0, "ok")], schema)
    after = spark.createDataFrame([(1, 0, 0.0, 10.0, "This was said once."), (1, 1, 10.0, 25.5, "A plain sentence about the weather in spring."), (1, 2, 25.5, 30.0, loop), (1, 3, 30.0, 31.0, "more")], schema)
    history = spark.createDataFrame([(1, 0, [0], True, 2.5), (1, 1, [2, 2], False, None)], "session_id long, region_id int, ids array<int>, accepted boolean, asr_seconds double")
    (r,) = RP.repair_summary(before, after, history).collect()
    assert (r.windows, r.accepted, r.rejected, r.regions_detected, r.asr_seconds) == (2, 1, 1, 2, 2.5)
    assert (r.suspicious_before, r.suspicious_after, r.segments_before, r.segments_after) == (14.5, 4.5, 3, 4)
    assert r.compression_before == r.compression_after > 2.6
