"""The audio draft as Markdown, from the validated JSON of outline, knowledge and draft.

All of it is built by aggregations in the drafts' order: an item is one text, items of a category in a section one block, a session one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotext.functions.names import hhmmss
from chronotext.operators import responses as R

from .sinks import in_order

# Headings, callouts and phrases of a draft.
HEADINGS = {"concepts": "核心概念", "equations": "公式与推导", "derivations": "推导过程", "examples": "课堂例题 / 示例"}
CALLOUTS = {"teacher_emphasis": ("important", "老师强调"), "exam_tips": ("tip", "考试提示"), "common_errors": ("warning", "常见错误"), "open_questions": ("question", "课堂未决问题")}
WARNING = ("> [!warning] Audio-only 草稿", "> 本文仅由已核验的课堂音频文字层生成；板书、课件和教材尚未融合，不能视为最终笔记。")
FRAME, CLOSING = "## 本节框架", "## 本节小结"
FOOTER = ("---", "", "_本文件是 Phase 2D audio-only draft，等待 Phase 3 视觉融合与人工验收。_", "")
UNSURE, UNCHECKED_FORMULA, UNCHECKED_STEPS, UNCHECKED_SOUND, MISSING_VISUAL = "不确定：", "> [!question] 公式尚未核验", "> [!question] 推导尚未核验", "> [!question] 音频内容待核验", "> [!question] 待板书 / 课件补充"
STATUS, REASON, RESULT, KIND, UNRESOLVED, AUDIO = "> 状态：", "> 原因：", "→ **结论**：", "> 类型：", "；状态：unresolved；", "音频"


def plain(text: Column) -> Column:
    """One line, trimmed, with double brackets escaped."""
    one = F.regexp_replace(text, "\r\n|\r|\n", " ")
    one = F.replace(F.replace(one, F.lit("[["), F.lit(r"\[\[")), F.lit("]]"), F.lit(r"\]\]"))
    return F.regexp_replace(one, r"(?U)\A\s+|\s+\z", "")


def quoted(text: Column) -> Column:
    """A JSON string."""
    js = F.to_json(F.array(text))
    return F.substring(js, F.lit(2), F.length(js) - 2)


def segments_of(sources: Column) -> Column:
    return F.concat(F.lit("〔segments: "), F.array_join(sources.cast("array<string>"), ", "), F.lit("〕"))


def _lines(*parts: Column | str) -> Column:
    """The lines that are there; lists of lines are taken apart."""
    return F.concat(*(F.array(F.lit(p)) if isinstance(p, str) else p for p in parts))


def _one(*parts: Column | str) -> Column:
    return F.array(F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)))


def _numbered(steps: Column, before: str) -> Column:
    return F.transform(steps, lambda s, i: F.concat(F.lit(before), (i + 1).cast("string"), F.lit(". "), plain(s)))


def item_text(v: Column) -> Column:
    """The lines of one item, by the column ``category``."""
    s, md = (lambda n: R.string(v, n)), (lambda n: plain(R.string(v, n)))
    src = segments_of(R.whole_numbers(v, "source_segment_ids"))
    doubts = F.coalesce(R.strings(v, "uncertain"), F.array().cast("array<string>"))
    each = lambda before: F.transform(doubts, lambda u: F.concat(F.lit(before), plain(u)))
    bold = lambda n: F.concat(F.lit("**"), md(n), F.lit("**"))
    done = F.coalesce(s("status") == "complete", F.lit(False))
    listed = lambda a, b: _lines(_one("- ", bold(a), "：", md(b), " ", src), each("  - " + UNSURE))
    expression = md("expression")
    formula = F.when(F.contains(expression, F.lit("$")), expression).otherwise(F.concat(F.lit("$"), expression, F.lit("$")))
    equation = F.when(done, _lines(_one("- ", bold("name"), "：", formula, " ", src), each("  - " + UNSURE))).otherwise(_lines(UNCHECKED_FORMULA, _one("> ", bold("name"), "：", expression), _one(STATUS, s("status"), "；", src), each("> - ")))
    steps = F.coalesce(R.strings(v, "steps"), F.array().cast("array<string>"))
    derivation = F.when(done, _lines(_one(bold("name"), " ", src), "", _numbered(steps, ""), "", _one(RESULT, md("conclusion")), each("  - " + UNSURE), "")).otherwise(
        _lines(UNCHECKED_STEPS, _one("> ", bold("name"), " ", src), _one(STATUS, s("status")), _numbered(steps, "> "), _one("> " + RESULT, md("conclusion")), each("> - "), "")
    )
    unsure = _lines("", UNCHECKED_SOUND, _one("> ", md("content"), " ", src), _one(REASON, md("reason")))
    at = F.concat(F.lit("["), hhmmss(R.number(v, "timestamp")), F.lit("]"))
    visual = _lines("", MISSING_VISUAL, _one("> ", at, " ", md("context")), _one(KIND, s("reference_type"), UNRESOLVED, src))
    c = F.col("category")
    out = F.when(c == "concepts", listed("name", "explanation")).when(c == "equations", equation).when(c == "derivations", derivation).when(c == "examples", listed("title", "content"))
    for name, (kind, title) in CALLOUTS.items():
        out = out.when(c == name, _lines("", f"> [!{kind}] {title}", _one("> ", md("content"), " ", src), each("> - " + UNSURE)))
    return F.array_join(out.when(c == "uncertain_items", unsure).when(c == "visual_references", visual), "\n")


def _span(start: Column, end: Column) -> Column:
    return F.concat(hhmmss(start), F.lit("–"), hhmmss(end))


def audio_draft(drafts: DataFrame, outlines: DataFrame, knowledge: DataFrame) -> DataFrame:
    """session_id, markdown, refused. drafts: session_id, course, date, response; outlines, knowledge: session_id, response (all validated JSON, a row a session).

    A document that holds a WikiLink after all, say in the course's name, is refused: its markdown is null. Items that a section names and knowledge
    does not hold are left out; the draft's rules tell them."""
    v = F.col("entry")
    docs = drafts.select("session_id", "course", "date", F.try_parse_json("response").alias("doc"))
    topics = R.entries(R.parsed(outlines), {"lecture_topics": ()}).select("session_id", F.col("place").alias("t_place"), R.string(v, "id").alias("topic_id"), R.string(v, "title").alias("t_title"), R.number(v, "start").alias("t_start"), R.number(v, "end").alias("t_end"))
    frame = topics.groupBy("session_id").agg(in_order("t_place", F.concat(F.lit("- ["), _span(F.col("t_start"), F.col("t_end")), F.lit("] "), plain(F.col("t_title")))).alias("frame"))
    sections = R.entries(docs, {"sections": ()}).select("session_id", F.col("place").alias("s_place"), "entry")
    category = lambda c, n: lambda x, i: F.struct(F.lit(n).alias("rank"), F.lit(c).alias("category"), i.alias("nth"), x.alias("item_id"))
    lists = F.flatten(F.filter(F.array(*(F.transform(R.strings(v, f), category(c, n)) for n, (c, f) in enumerate(R.ITEM_LISTS.items()))), lambda x: x.isNotNull()))
    named = sections.select("session_id", "s_place", F.explode(lists).alias("i")).select("session_id", "s_place", "i.*")
    items = R.entries(R.parsed(knowledge), R.KNOWLEDGE).select("session_id", "category", R.string(v, "id").alias("item_id"), item_text(v).alias("text"))
    met = named.join(items, ["session_id", "category", "item_id"])
    block = met.groupBy("session_id", "s_place", "rank", "category").agg(in_order("nth", F.col("text")).alias("body"))
    heading = F.create_map(*(F.lit(x) for c, h in HEADINGS.items() for x in (c, f"\n### {h}\n\n")))[F.col("category")]
    blocks = block.groupBy("session_id", "s_place").agg(in_order("rank", F.concat(F.coalesce(heading, F.lit("")), F.col("body"))).alias("blocks"))
    s = sections.select("session_id", "s_place", R.string(v, "topic_id").alias("topic_id"), R.string(v, "heading").alias("heading"), R.string(v, "summary").alias("summary"), R.whole_numbers(v, "source_segment_ids").alias("sources"))
    s = s.join(topics.drop("t_place", "t_title"), ["session_id", "topic_id"], "left").join(blocks, ["session_id", "s_place"], "left")
    source = F.concat(F.lit(f"`{AUDIO} "), _span(F.col("t_start"), F.col("t_end")), F.lit("` "), segments_of(F.col("sources")))
    head = F.concat(F.lit("\n## "), (F.col("s_place") + 1).cast("string"), F.lit(". "), plain(F.col("heading")), F.lit("\n\n"), source, F.lit("\n\n"), plain(F.col("summary")))
    body = s.groupBy("session_id").agg(in_order("s_place", F.concat_ws("\n", head, F.col("blocks"))).alias("body"))
    closing = R.entries(docs, {"closing_summary": ()}).groupBy("session_id").agg(in_order("place", F.concat(F.lit("- "), plain(R.string(v, "content")), F.lit(" "), segments_of(R.whole_numbers(v, "source_segment_ids")))).alias("closing"))
    whole = docs.join(frame, "session_id", "left").join(body, "session_id", "left").join(closing, "session_id", "left")
    text = F.concat_ws(
        "\n",
        F.lit("---"), F.concat(F.lit("course: "), quoted(F.col("course"))), F.concat(F.lit("date: "), quoted(F.col("date"))), F.concat(F.lit("session_id: "), quoted(F.col("session_id").cast("string"))),
        F.lit("source_layer: AUDIO_ONLY"), F.lit("final: false"), F.lit("---"), F.lit(""), F.concat(F.lit("# "), plain(R.string(F.col("doc"), "title"))), F.lit(""), *map(F.lit, WARNING), F.lit(""), F.lit(FRAME), F.lit(""),
        F.col("frame"), F.col("body"), F.when(F.col("closing").isNotNull(), F.concat(F.lit(f"\n{CLOSING}\n\n"), F.col("closing"))), F.lit(""), *map(F.lit, FOOTER),
    )
    refused = F.contains(text, F.lit("[["))
    return whole.select("session_id", F.when(~refused, text).alias("markdown"), refused.alias("refused"))
