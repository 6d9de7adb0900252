"""Rules for the JSON that language models return: cleaned segments, outlines, knowledge, drafts.

A response is one JSON text a session. It is parsed as a VARIANT; all rules are column expressions and joins on (session, item), so a response
is never handed to Python. Responses, their items with typed values, and what the rules need of the segments (a few characters, not their texts) are each
written once to the shared folder, as many rules read them. Every rule that an item breaks is a row (session_id, category, rule, item_id); an item whose fields are not those of its category is
told for that only, and values of a wrong kind are told once and break no other rule.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronotext.config import CleanConfig
from chronotext.functions.text import DERIVATION_CUE, normalized
from chronotext.sources.shared import materialized

from .sequence import runs

# The fields of each category, the texts among them, and what they may hold.
_SPAN = ("start", "end", "source_segment_ids", "uncertain")
_TRACE = ("source_segment_ids", "uncertain")
OUTLINE = {
    "lecture_topics": ("id", "title", "type", *_SPAN),
    "subtopics": ("id", "topic_id", "title", *_SPAN),
    "definitions": ("id", "topic_id", "label", *_SPAN),
    "derivations": ("id", "topic_id", "label", *_SPAN),
    "examples": ("id", "topic_id", "label", *_SPAN),
    "teacher_emphasis": ("id", "topic_id", "label", *_SPAN),
    "exam_tips": ("id", "topic_id", "label", *_SPAN),
    "transitions": ("id", "from_topic_id", "to_topic_id", "cue", *_SPAN),
}
KNOWLEDGE = {
    "concepts": ("id", "topic_id", "name", "explanation", "importance", *_TRACE),
    "equations": ("id", "topic_id", "name", "expression", "status", *_TRACE),
    "derivations": ("id", "topic_id", "name", "steps", "conclusion", "status", *_TRACE),
    "examples": ("id", "topic_id", "title", "content", *_TRACE),
    "teacher_emphasis": ("id", "topic_id", "content", *_TRACE),
    "exam_tips": ("id", "topic_id", "content", *_TRACE),
    "common_errors": ("id", "topic_id", "content", *_TRACE),
    "open_questions": ("id", "topic_id", "content", *_TRACE),
    "visual_references": ("id", "topic_id", "timestamp", "context", "reference_type", "confidence", *_TRACE),
    "uncertain_items": ("id", "topic_id", "content", "reason", "source_segment_ids"),
}
LATER_CATEGORY = "derivations"  # responses of the first version have none
DRAFT = ("title", "sections", "closing_summary")
ITEM_LISTS = {
    "concepts": "concept_ids", "equations": "equation_ids", "derivations": "derivation_ids", "examples": "example_ids", "teacher_emphasis": "teacher_emphasis_ids",
    "exam_tips": "exam_tip_ids", "common_errors": "common_error_ids", "open_questions": "open_question_ids", "uncertain_items": "uncertain_item_ids", "visual_references": "visual_reference_ids",
}
SECTION = ("id", "topic_id", "heading", "summary", "source_segment_ids", *ITEM_LISTS.values())
CLEANED = ("id", "text", "uncertain", "visual_references", "corrections")
CORRECTION = ("original", "corrected", "decision", "reason")
TEXTS = ("title", "label", "cue", "name", "explanation", "expression", "conclusion", "content", "reason", "context")
TOPIC_TYPES = ("content", "derivation", "example", "review", "administrative", "break")
STATUSES = ("complete", "incomplete", "uncertain")
REFERENCE_TYPES = ("board", "slide", "image", "diagram", "formula", "other")
FORMULA_CUE = r"\d|[=+\-×÷*/^]|等于|乘以|除以|次方|公式|方程|函数|表达式|进制|幂"
ECHOES = {"outline": ("<input_json>",), "knowledge": ("<cleaned_json>", "<outline_json>"), "draft": ("[[", "<outline_json>", "<knowledge_json>", "<unresolved_visual_json>", "\n", "\r", "> [!")}
TOLERANCE, CONCEPT_THRESHOLD, MOST_CLOSING = 1.5, 0.8, 5
OUTLINE_TEXT, KNOWLEDGE_TEXT, DRAFT_TEXTS, CLOSING_TEXT, TITLE_TEXT = 200, 2000, {"id": 120, "heading": 300, "summary": 5000}, 1000, 200
RETAINED = {"definitions": "concepts", "derivations": "derivations", "examples": "examples", "teacher_emphasis": "teacher_emphasis", "exam_tips": "exam_tips"}


# ---- values of a VARIANT ----


def _part(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _kind(v: Column, name: str) -> Column:
    return F.coalesce(F.schema_of_variant(_part(v, name)), F.lit("NONE"))


def string(v: Column, name: str) -> Column:
    return F.when(_kind(v, name) == "STRING", F.try_variant_get(v, f"$.{name}", "string"))


def number(v: Column, name: str) -> Column:
    kind = _kind(v, name)
    return F.when(kind.isin("BIGINT", "DOUBLE", "FLOAT") | F.startswith(kind, F.lit("DECIMAL")), F.try_variant_get(v, f"$.{name}", "double"))


def whole_numbers(v: Column, name: str) -> Column:
    """A list of one or more whole numbers without repeats; null for anything else."""
    found = F.when(_kind(v, name) == "ARRAY<BIGINT>", F.try_variant_get(v, f"$.{name}", "array<bigint>"))
    return F.when(F.size(found) == F.size(F.array_distinct(found)), found)


def strings(v: Column, name: str) -> Column:
    """A list of strings, which may be empty; null for anything else."""
    kind, found = _kind(v, name), F.try_variant_get(v, f"$.{name}", "array<string>")
    return F.when((kind == "ARRAY<STRING>") | ((kind == "ARRAY<VOID>") & (F.size(found) == 0)), found)


def keys_are(v: Column, *choices: tuple[str, ...]) -> Column:
    """Whether it is an object with the names of one of the choices and no others."""
    keys = F.array_sort(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")))
    same = [keys == F.array(*map(F.lit, sorted(c))) for c in choices]
    return F.coalesce(reduce(lambda a, b: a | b, same), F.lit(False))


def blank(text: Column) -> Column:
    return ~F.rlike(text, F.lit(r"(?U)\S"))


def _broken(df: DataFrame, item: Column, *rules: tuple[str, Column], category: Column | None = None) -> DataFrame:
    rule = F.explode(F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in rules)), lambda x: x.isNotNull()))
    return df.select("session_id", (F.col("category") if category is None else category).alias("category"), rule.alias("rule"), item.cast("string").alias("item_id"))


def _all(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def parsed(responses: DataFrame) -> DataFrame:
    """session_id, doc. responses: session_id (unique), response."""
    return responses.select("session_id", F.try_parse_json("response").alias("doc"))


def entries(docs: DataFrame, categories: dict[str, tuple[str, ...]]) -> DataFrame:
    """session_id, category, place, entry: the members of all lists of the response."""

    def each(c: str) -> Column:
        found = F.try_variant_get("doc", f"$.{c}", "array<variant>")
        return F.when(F.startswith(_kind(F.col("doc"), c), F.lit("ARRAY")), F.transform(found, lambda v, i: F.struct(F.lit(c).alias("category"), i.alias("place"), v.alias("entry"))))

    lists = F.flatten(F.filter(F.array(*map(each, categories)), lambda x: x.isNotNull()))
    return docs.select("session_id", F.explode(lists).alias("e")).select("session_id", "e.*")


def once(responses: DataFrame) -> DataFrame:
    return materialized(responses.select("session_id", "response"), "responses")


def placed(segments: DataFrame) -> DataFrame:
    """Segments with their position in the session, from 0."""
    return segments.withColumn("position", F.row_number().over(Window.partitionBy("session_id").orderBy("id")) - 1)


def slim(segments: DataFrame, *flags: str, hints: bool = True) -> DataFrame:
    """What rules need of placed segments, written once: position, times, announces (a derivation), silent (no text), and hint, which holds a formula's sign where
    the text does: the sign itself, else the text's ends, as no sign is longer than three characters but one may go on in the next segment."""
    t = F.coalesce("text", F.lit(""))
    # what every derivation's cue holds is looked for first, as it is cheaper
    announces = (F.contains(t, F.lit("推导")) | F.contains(t, F.lit("证明"))) & F.rlike(t, F.lit(DERIVATION_CUE))
    hint = F.when(F.rlike(t, F.lit(FORMULA_CUE)), "=").when(F.length(t) <= 4, t).otherwise(F.concat(F.left(t, F.lit(2)), F.lit("\x00"), F.right(t, F.lit(2))))
    return materialized(placed(segments).select("session_id", "id", "position", "seg_start", "seg_end", announces.alias("announces"), blank(t).alias("silent"), (hint if hints else F.lit("")).alias("hint"), *flags), "segments")


def sourced(items: DataFrame, segments: DataFrame, key: list[str]) -> DataFrame:
    """Adds of each item's sources: unknown (how many are no segments), positions (in the item's order), own_start, own_end, evidence (their hints strung
    together), silent (no segment has a text). segments: slim ones."""
    one = items.where(F.col("sources").isNotNull()).select(*key, F.posexplode("sources").alias("nth", "id"))
    met = one.join(segments.select("session_id", "id", "position", "seg_start", "seg_end", "hint", "silent"), ["session_id", "id"], "left")
    rows = F.array_sort(F.collect_list(F.struct("nth", "position", "seg_start", "seg_end", "hint")))
    per = met.groupBy(*key).agg(F.count_if(F.col("position").isNull()).alias("unknown"), rows.alias("_r"), (F.count_if(F.col("silent")) == F.count("*")).alias("silent"))
    of = lambda name: F.transform("_r", lambda x: x[name])
    per = per.select(*key, "unknown", "silent", of("position").alias("positions"), F.col("_r")[0]["seg_start"].alias("own_start"), F.element_at("_r", -1)["seg_end"].alias("own_end"), F.array_join(of("hint"), "").alias("evidence"))
    return items.join(per, key, "left")


def _rising(positions: Column) -> Column:
    return positions == F.array_sort(positions)


def _chosen(fields: dict[str, tuple[str, ...]], name: str) -> Column:
    """Whether the category has a field of that name."""
    return F.col("category").isin([c for c, f in fields.items() if name in f])


def _common(items: DataFrame, fields: dict[str, tuple[str, ...]], topics: DataFrame, segments: DataFrame, echoes: tuple[str, ...], limit: int, contiguous: bool, may_be_blank: tuple[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(the items with their typed values and sources, the rules that all categories share)."""
    v = F.col("entry")
    whole = reduce(lambda a, b: a | b, (F.col("category").eqNullSafe(F.lit(c)) & keys_are(v, f) for c, f in fields.items()))
    texts = [t for t in TEXTS if any(t in f for f in fields.values())]
    typed = items.withColumn("whole", whole).withColumn("item_id", string(v, "id")).withColumn("topic_id", string(v, "topic_id"))
    typed = typed.withColumn("sources", whole_numbers(v, "source_segment_ids")).withColumn("uncertain", strings(v, "uncertain")).withColumns({f"t_{t}": string(v, t) for t in texts})
    typed = sourced(typed, segments, ["session_id", "category", "place"])
    allowed = topics.select("session_id", "topic_id", F.col("sources").alias("allowed"))
    typed = typed.join(allowed, ["session_id", "topic_id"], "left")
    named = F.coalesce(F.trim("item_id"), F.concat(F.lit("#"), F.col("place").cast("string")))
    named = F.when(named == "", F.concat(F.lit("#"), F.col("place").cast("string"))).otherwise(named)
    typed = materialized(typed.withColumn("name", named), "items")
    ok, never = F.col("whole"), F.lit(False)
    bad_text = lambda t: F.col(f"t_{t}").isNull() | blank(F.col(f"t_{t}"))
    excused = lambda t: (F.col("category") == may_be_blank[0]) & F.col("silent") if may_be_blank and may_be_blank[1] == t else never
    empty = reduce(lambda a, b: a | b, (_chosen(fields, t) & bad_text(t) & ~F.coalesce(excused(t), never) for t in texts))
    strange = reduce(lambda a, b: a | b, (_chosen(fields, t) & ((F.length(f"t_{t}") > limit) | reduce(lambda p, q: p | q, (F.contains(F.col(f"t_{t}"), F.lit(e)) for e in echoes))) for t in texts))
    order = F.col("positions") == F.sequence(F.array_min("positions"), F.array_max("positions")) if contiguous else _rising(F.col("positions"))
    rules = _broken(
        typed, F.col("name"),
        ("fields", ~ok),
        ("id", ok & (F.col("item_id").isNull() | blank(F.col("item_id")))),
        ("text_empty", ok & empty),
        ("text_strange", ok & F.coalesce(strange, never)),
        ("uncertain_list", ok & _chosen(fields, "uncertain") & F.col("uncertain").isNull()),
        ("sources_list", ok & F.col("sources").isNull()),
        ("sources_unknown", ok & (F.col("unknown") > 0)),
        ("sources_order", ok & (F.col("unknown") == 0) & ~order),
        ("topic_unknown", ok & _chosen(fields, "topic_id") & F.col("allowed").isNull()),
        ("sources_outside_topic", ok & (F.col("unknown") == 0) & (F.size(F.array_except("sources", "allowed")) > 0)),
    )
    again = typed.where("whole AND item_id IS NOT NULL").groupBy("session_id", "category", "name").agg(F.count("*").alias("n"))
    return typed, _all(rules, _broken(again, F.col("name"), ("id_repeated", F.col("n") > 1)))


def _response_rules(docs: DataFrame, *choices: tuple[str, ...]) -> DataFrame:
    lists = reduce(lambda a, b: a & b, (F.startswith(_kind(F.col("doc"), c), F.lit("ARRAY")) | (_kind(F.col("doc"), c) == "NONE") for c in choices[0]))
    whole = keys_are(F.col("doc"), *choices)
    return _broken(docs, F.lit("response"), ("keys", ~whole), ("lists", whole & ~lists), category=F.lit("response"))


def _wrong_times(start: Column, end: Column, due_start: Column, due_end: Column, tolerance: float) -> tuple[tuple[str, Column], ...]:
    return ("start_time", F.abs(start - due_start) > tolerance), ("end_time", F.abs(end - due_end) > tolerance)


def outline_topics_of(responses: DataFrame) -> DataFrame:
    """session_id, topic_id, place, sources of an outline's topics."""
    e = entries(parsed(responses), {"lecture_topics": ()})
    return e.select("session_id", string(F.col("entry"), "id").alias("topic_id"), "place", whole_numbers(F.col("entry"), "source_segment_ids").alias("sources")).dropDuplicates(["session_id", "topic_id"])


def outline_response_violations(responses: DataFrame, segments: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Outlines: topics that cover the segments once and in order, with their times; items inside their topic, transitions between two of them, and
    every segment that announces a derivation in one. segments: session_id, id, seg_start, seg_end, text."""
    responses, seg = once(responses), slim(segments, hints=False)
    docs = parsed(responses)
    topics = materialized(outline_topics_of(responses), "topics")
    typed, common = _common(entries(docs, OUTLINE), OUTLINE, topics, seg, ECHOES["outline"], OUTLINE_TEXT, contiguous=True)
    v, ok, never = F.col("entry"), F.col("whole"), F.lit(False)
    typed = typed.withColumn("start", number(v, "start")).withColumn("end", number(v, "end"))
    is_topic, is_move = F.col("category") == "lecture_topics", F.col("category") == "transitions"
    own = _broken(
        typed, F.col("name"),
        ("type", ok & is_topic & ~F.coalesce(string(v, "type").isin(*TOPIC_TYPES), never)),
        ("start_kind", ok & F.col("start").isNull()),
        ("end_kind", ok & F.col("end").isNull()),
        ("span", ok & (F.col("start") >= F.col("end"))),
        *((n, ok & ~is_topic & (F.col("unknown") == 0) & _rising(F.col("positions")) & c) for n, c in _wrong_times(F.col("start"), F.col("end"), F.col("own_start"), F.col("own_end"), tolerance)),
    )
    main = typed.where(is_topic & ok).withColumn("due_end", F.coalesce(F.lead("own_start").over(Window.partitionBy("session_id").orderBy("place")), "own_end"))
    before = F.lag(F.array_max("positions")).over(Window.partitionBy("session_id").orderBy("place"))
    main = main.withColumn("follows", before < F.array_min("positions"))
    timed = _broken(main, F.col("name"), *_wrong_times(F.col("start"), F.col("end"), F.col("own_start"), F.col("due_end"), tolerance), ("topics_order", ~F.col("follows")))
    held = typed.where(is_topic).select("session_id", F.explode("sources").alias("id")).groupBy("session_id", "id").agg(F.count("*").alias("n"))
    whole = docs.where(keys_are(F.col("doc"), tuple(OUTLINE))).select("session_id")  # others are told for their shape
    cover = seg.join(whole, "session_id", "left_semi").select("session_id", "id").join(held, ["session_id", "id"], "left")
    cover = _broken(cover, F.col("id"), ("segment_missing", F.col("n").isNull()), ("segment_repeated", F.col("n") > 1), category=F.lit("lecture_topics"))
    none = _broken(docs, F.lit("response"), ("no_topics", F.size(F.try_variant_get("doc", "$.lecture_topics", "array<variant>")) == 0), category=F.lit("lecture_topics"))
    moves = typed.where(is_move & ok).withColumn("a", string(v, "from_topic_id")).withColumn("b", string(v, "to_topic_id"))
    known = topics.select("session_id", F.col("topic_id").alias("k"))
    for side in "ab":
        moves = moves.join(known.select("session_id", F.col("k").alias(side), F.lit(True).alias(f"known_{side}")), ["session_id", side], "left")
    moves = _broken(moves, F.col("name"), ("transition_unknown", F.col("known_a").isNull() | F.col("known_b").isNull()), ("transition_same", F.col("a") == F.col("b")))
    cued = seg.where("announces").join(whole, "session_id", "left_semi").select("session_id", "id")
    told = typed.where("category = 'derivations'").select("session_id", F.explode("sources").alias("id")).distinct()
    missed = _broken(cued.join(told, ["session_id", "id"], "left_anti"), F.col("id"), ("derivation_missing", F.lit(True)), category=F.lit("derivations"))
    return _all(_response_rules(docs, tuple(OUTLINE)), common, own, timed, cover, none, moves, missed)


def knowledge_response_violations(responses: DataFrame, segments: DataFrame, topics: DataFrame, outline_items: DataFrame, threshold: float = CONCEPT_THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """Knowledge: items with evidence inside their topic, and nothing lost on the way: doubts, visuals and what the outline lists are all taken up.
    segments: session_id, id, seg_start, seg_end, text, uncertain, visual (flags); topics: session_id, topic_id, sources; outline_items: session_id,
    category, sources. Responses of the first version, without derivations, are accepted; their equations answer for the outline's derivations."""
    responses, seg = once(responses), slim(segments, "uncertain", "visual")
    docs = parsed(responses)
    typed, common = _common(entries(docs, KNOWLEDGE), KNOWLEDGE, topics, seg, ECHOES["knowledge"], KNOWLEDGE_TEXT, contiguous=False, may_be_blank=("uncertain_items", "content"))
    v, ok, c, never = F.col("entry"), F.col("whole"), F.col("category"), F.lit(False)
    status, steps = string(v, "status"), F.try_variant_get(v, "$.steps", "array<variant>")
    whole_steps, importance, confidence, at = strings(v, "steps"), number(v, "importance"), number(v, "confidence"), number(v, "timestamp")
    argued, doubted = c.isin("equations", "derivations"), status.isin("incomplete", "uncertain")
    strange = lambda s: blank(s) | (F.length(s) > KNOWLEDGE_TEXT) | reduce(lambda a, b: a | b, (F.contains(s, F.lit(e)) for e in ECHOES["knowledge"]))
    many = F.coalesce(F.size(steps) >= 2, never)
    own = _broken(
        typed, F.col("name"),
        ("importance_range", ok & (c == "concepts") & ~F.coalesce(importance.between(0, 1), never)),
        ("importance_low", ok & (c == "concepts") & importance.between(0, 1) & (importance < threshold)),
        ("status", ok & argued & ~F.coalesce(status.isin(*STATUSES), never)),
        ("no_evidence", ok & argued & (F.col("unknown") == 0) & ~F.rlike("evidence", F.lit(FORMULA_CUE))),
        ("doubt_unsaid", ok & argued & doubted & (F.size("uncertain") == 0)),
        ("steps_few", ok & (c == "derivations") & ~many),
        ("step_strange", ok & (c == "derivations") & many & F.coalesce(whole_steps.isNull() | F.exists(whole_steps, strange), F.lit(True))),
        ("reference_type", ok & (c == "visual_references") & ~F.coalesce(string(v, "reference_type").isin(*REFERENCE_TYPES), never)),
        ("confidence_range", ok & (c == "visual_references") & ~F.coalesce(confidence.between(0, 1), never)),
        ("timestamp", ok & (c == "visual_references") & (F.col("unknown") == 0) & ~F.coalesce(F.abs(at - F.col("own_start")) <= tolerance, never)),
    )
    per = seg.groupBy("session_id").agg(F.count("*").alias("n_segments"))
    many_items = typed.groupBy("session_id", "category").agg(F.count("*").alias("n")).join(per, "session_id")
    many_items = _broken(many_items, F.lit("response"), ("too_many", F.col("n") > F.col("n_segments")))
    covered = typed.where("whole").select("session_id", "category", F.explode("sources").alias("id")).distinct()
    doubts = covered.where("category = 'uncertain_items'").select("session_id", "id")
    first_keys = tuple(k for k in KNOWLEDGE if k != LATER_CATEGORY)
    whole = docs.where(keys_are(F.col("doc"), tuple(KNOWLEDGE), first_keys))  # others are told for their shape
    there = seg.join(whole.select("session_id"), "session_id", "left_semi")
    lost = _broken(there.where("uncertain").select("session_id", "id").join(doubts, ["session_id", "id"], "left_anti"), F.col("id"), ("doubt_lost", F.lit(True)), category=F.lit("uncertain_items"))
    seen = covered.where("category = 'visual_references'").select("session_id", "id")
    unseen = _broken(there.where("visual").select("session_id", "id").join(seen, ["session_id", "id"], "left_anti"), F.col("id"), ("visual_lost", F.lit(True)), category=F.lit("visual_references"))
    open_ones = typed.where(ok & argued & doubted).select("session_id", "category", "name", F.explode("sources").alias("id")).join(doubts.withColumn("hit", F.lit(1)), ["session_id", "id"], "left")
    unrouted = open_ones.groupBy("session_id", "category", "name").agg(F.count("hit").alias("hits"))
    first = whole.select("session_id", keys_are(F.col("doc"), first_keys).alias("first_version"))
    mapped = F.create_map(*(F.lit(x) for kv in RETAINED.items() for x in kv))
    due = outline_items.where(F.col("category").isin(*RETAINED)).select("session_id", "category", F.explode("sources").alias("id")).distinct().join(first, "session_id")
    due = due.withColumn("kept_in", F.when(F.col("first_version") & (c == LATER_CATEGORY), "equations").otherwise(mapped[c]))
    kept = covered.select("session_id", F.col("category").alias("kept_in"), "id")
    dropped = due.join(kept, ["session_id", "kept_in", "id"], "left_anti").join(doubts, ["session_id", "id"], "left_anti")
    return _all(
        _response_rules(docs, tuple(KNOWLEDGE), first_keys), common, own, many_items, lost, unseen,
        _broken(unrouted, F.col("name"), ("unrouted", F.col("hits") == 0)), _broken(dropped, F.col("id"), ("outline_lost", F.lit(True))),
    )


def _odd_text(text: Column, limit: Column | int) -> Column:
    """No string, blank, too long, or with something that only a prompt or Markdown has."""
    own = F.trim(text)
    return F.coalesce(blank(text) | (F.length(own) > limit) | reduce(lambda a, b: a | b, (F.contains(own, F.lit(e)) for e in ECHOES["draft"])), F.lit(True))


def draft_response_violations(responses: DataFrame, topics: DataFrame, items: DataFrame, most_closing: int = MOST_CLOSING) -> DataFrame:
    """Drafts: a section a topic in the outline's order, every knowledge item once, in its topic's section, whose sources cover the items'; plain texts
    within their limits. topics: session_id, topic_id, place, sources; items: session_id, category, item_id, topic_id, sources."""
    docs = parsed(once(responses))
    v, ok = F.col("entry"), F.col("whole")
    name = F.coalesce(F.col("section_id"), F.concat(F.lit("#"), F.col("place").cast("string")))
    order = topics.withColumn("due", F.row_number().over(Window.partitionBy("session_id").orderBy("place")) - 1).select("session_id", "topic_id", "due", F.col("sources").alias("allowed"))
    sections = entries(docs, {"sections": SECTION}).withColumn("whole", keys_are(v, SECTION)).withColumn("section_id", string(v, "id")).withColumn("topic_id", string(v, "topic_id")).withColumn("sources", whole_numbers(v, "source_segment_ids"))
    sections = materialized(sections.join(order, ["session_id", "topic_id"], "left").withColumn("name", name), "sections")
    lists = {f: strings(v, f) for f in ITEM_LISTS.values()}
    wrong_list = reduce(lambda a, b: a | b, (F.coalesce((F.size(x) != F.size(F.array_distinct(x))) | F.array_contains(x, ""), x.isNull()) for x in lists.values()))
    per = _broken(
        sections, F.col("name"),
        ("fields", ~ok),
        *((f"{t}_text", ok & _odd_text(string(v, t), limit)) for t, limit in DRAFT_TEXTS.items()),
        ("section_order", ok & ~F.coalesce(F.col("due") == F.col("place"), F.lit(False))),
        ("sources_list", ok & F.col("sources").isNull()),
        ("sources_outside_topic", ok & (F.size(F.array_except("sources", "allowed")) > 0)),
        ("sources_order", ok & (F.size(F.array_except("sources", "allowed")) == 0) & (F.col("sources") != F.filter("allowed", lambda x: F.array_contains("sources", x)))),
        ("item_list", ok & wrong_list),
    )
    again = sections.where("whole AND section_id IS NOT NULL").groupBy("session_id", "category", "name").agg(F.count("*").alias("n"))
    count = docs.select("session_id", F.size(F.try_variant_get("doc", "$.sections", "array<variant>")).alias("n")).join(order.groupBy("session_id").agg(F.count("*").alias("due")), "session_id", "left")
    count = _broken(count, F.lit("response"), ("section_count", F.coalesce(F.col("n") != F.coalesce("due", F.lit(0)), F.lit(False))), category=F.lit("sections"))
    named = lambda c: lambda i: F.struct(F.lit(c).alias("category"), i.alias("item_id"))
    listed = F.flatten(F.filter(F.array(*(F.transform(x, named(c)) for c, x in zip(ITEM_LISTS, lists.values(), strict=True))), lambda x: x.isNotNull()))
    used = sections.where("whole").select("session_id", F.col("name").alias("section"), F.col("topic_id").alias("used_in"), F.col("sources").alias("section_sources"), F.explode(listed).alias("i")).select("session_id", "section", "used_in", "section_sources", "i.*")
    used = materialized(used, "used")
    known = items.join(docs.select("session_id"), "session_id", "left_semi")
    due_items = items.join(docs.where(keys_are(F.col("doc"), DRAFT)).select("session_id"), "session_id", "left_semi")  # others are told for their shape
    met = used.join(known, ["session_id", "category", "item_id"], "left")
    each = _broken(met, F.col("item_id"), ("item_unknown", F.col("topic_id").isNull()), ("item_wrong_topic", F.col("topic_id") != F.col("used_in")), ("provenance", F.size(F.array_except("sources", "section_sources")) > 0))
    often = used.groupBy("session_id", "category", "item_id").agg(F.count("*").alias("n"))
    lost = due_items.join(often, ["session_id", "category", "item_id"], "left_anti")
    closing = entries(docs, {"closing_summary": ()})
    told = topics.groupBy("session_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "sources"))), lambda x: x["sources"])).alias("allowed"))
    closing = closing.join(told, "session_id", "left").withColumn("sources", whole_numbers(v, "source_segment_ids")).withColumn("whole", keys_are(v, ("content", "source_segment_ids")))
    closed = _broken(
        closing, F.concat(F.lit("#"), F.col("place").cast("string")),
        ("fields", ~ok), ("closing_text", ok & _odd_text(string(v, "content"), CLOSING_TEXT)),
        ("sources_list", ok & F.col("sources").isNull()), ("sources_outside_topic", ok & (F.size(F.array_except("sources", "allowed")) > 0)),
        ("sources_order", ok & (F.size(F.array_except("sources", "allowed")) == 0) & (F.col("sources") != F.filter("allowed", lambda x: F.array_contains("sources", x)))),
    )
    d = F.col("doc")
    arrays = F.startswith(_kind(d, "sections"), F.lit("ARRAY")) & F.startswith(_kind(d, "closing_summary"), F.lit("ARRAY"))
    whole = keys_are(d, DRAFT)
    top = _broken(docs, F.lit("response"), ("keys", ~whole), ("lists", whole & ~arrays), ("title_text", whole & _odd_text(string(d, "title"), TITLE_TEXT)), ("closing_many", F.size(F.try_variant_get(d, "$.closing_summary", "array<variant>")) > most_closing), category=F.lit("response"))
    return _all(top, per, _broken(again, F.col("name"), ("id_repeated", F.col("n") > 1)), count, each, _broken(often, F.col("item_id"), ("item_repeated", F.col("n") > 1)), _broken(lost, F.col("item_id"), ("item_missing", F.lit(True))), closed)


def clean_response_violations(responses: DataFrame, segments: DataFrame, cfg: CleanConfig = CleanConfig(), repeats: int = 6) -> DataFrame:
    """Cleaned segments: the same ids in the same order, whole fields, a reason for every blank text, and about as much text as before; runs of `repeats`
    or more equal segments count once. segments: session_id, id, text."""
    docs, v, ok = parsed(once(responses)), F.col("entry"), F.col("whole")
    e = entries(docs, {"segments": CLEANED})
    own_id = F.when(_kind(v, "id") == "BIGINT", F.try_variant_get(v, "$.id", "bigint"))
    fixes = F.try_variant_get(v, "$.corrections", "array<variant>")
    wrong_fix = lambda x: ~(keys_are(x, CORRECTION) & reduce(lambda a, b: a & b, (_kind(x, k) == "STRING" for k in CORRECTION)))
    # texts are measured where they are; only their lengths are shuffled
    e = e.select("session_id", "place", keys_are(v, CLEANED).alias("whole"), own_id.alias("id"), F.length(F.trim(string(v, "text"))).alias("new"), F.size(strings(v, "uncertain")).alias("doubts"), strings(v, "visual_references").isNull().alias("bad_visuals"), F.coalesce(F.exists(fixes, wrong_fix), F.lit(True)).alias("bad_fixes"))
    due = runs(placed(segments).withColumn("key", F.sha2(normalized(F.col("text")), 256)), ["session_id"], "id", "key")
    copy = (F.col("run_length") >= repeats) & (normalized(F.col("text")) != "") & (F.col("run_place") > 1)
    due = due.select("session_id", F.col("position").alias("place"), F.col("id").alias("due_id"), F.length(F.trim(F.coalesce("text", F.lit("")))).alias("old"), copy.alias("copy"))
    due = due.join(docs.where(keys_are(F.col("doc"), ("segments",))).select("session_id"), "session_id", "left_semi")  # others are told for their shape
    both = materialized(due.join(e, ["session_id", "place"], "full").withColumn("category", F.lit("segments")), "cleaned")
    name = F.coalesce("due_id", "id", "place")
    per = _broken(
        both, name,
        ("topology", ~F.coalesce(F.col("due_id") == F.col("id"), F.lit(False))),
        ("fields", ~ok),
        ("text_kind", ok & F.col("new").isNull()),
        ("uncertain_list", ok & (F.coalesce("doubts", F.lit(-1)) < 0)),
        ("visual_list", ok & F.col("bad_visuals")),
        ("corrections", ok & F.col("bad_fixes")),
        ("blank_unsaid", ok & (F.col("new") == 0) & (F.col("doubts") == 0)),
        ("expanded", ok & ~F.col("copy") & (F.col("new") > 3 * F.col("old") + 30)),
    )
    lengths = both.where("due_id IS NOT NULL").groupBy("session_id").agg((F.sum(F.when(~F.col("copy"), F.col("new"))) / F.greatest(F.lit(1), F.sum(F.when(~F.col("copy"), F.col("old"))))).alias("kept"), F.count_if(F.col("due_id").eqNullSafe(F.col("id")) & F.col("new").isNotNull()).alias("n"), F.count("*").alias("all"))
    lengths = lengths.where("n = all")  # a response of another shape is told for that
    sums = _broken(lengths, F.lit("response"), ("retention", F.col("kept") < cfg.min_retention_ratio), ("expansion", F.col("kept") > cfg.max_expansion_ratio), category=F.lit("segments"))
    return _all(_response_rules(docs, ("segments",)), per, sums)


def unresolved_violations(queues: DataFrame, knowledge: DataFrame) -> DataFrame:
    """The queue of visuals still to be resolved against the knowledge it was made from: queues, knowledge: session_id, response. The same items in the same
    order, each with its fields as they were, a status and its labels; rules of the response: keys, session, count, order."""
    knowledge = once(knowledge)
    docs, v = parsed(once(queues)), F.col("entry")
    d = F.col("doc")
    due = entries(parsed(knowledge), {"visual_references": ()}).select("session_id", F.col("place").alias("due"), string(v, "id").alias("item_id"), F.to_json(v).alias("was"))
    got = entries(docs, {"items": ()}).withColumn("item_id", string(v, "id"))
    own = F.map_filter(F.try_variant_get(v, "$", "map<string,variant>"), lambda k, x: ~k.isin("status", "source_visual_labels"))
    got = got.withColumn("now", F.to_json(own)).withColumn("name", F.coalesce("item_id", F.concat(F.lit("#"), F.col("place").cast("string"))))
    met = got.join(due, ["session_id", "item_id"], "left")
    each = _broken(
        met, F.col("name"),
        ("id_unknown", F.col("due").isNull()), ("status", ~F.coalesce(string(v, "status") == "unresolved", F.lit(False))),
        ("labels", strings(v, "source_visual_labels").isNull()), ("changed", F.col("due").isNotNull() & ~F.col("now").eqNullSafe(F.col("was"))),
    )
    again = got.where("item_id IS NOT NULL").groupBy("session_id", "category", "name").agg(F.count("*").alias("n"))
    ids = lambda df, place: df.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(place, "item_id"))), lambda x: x["item_id"]).alias("ids"))
    both = docs.join(ids(got, "place"), "session_id", "left").join(ids(due, "due").withColumnRenamed("ids", "due_ids"), "session_id", "left")
    none = F.array().cast("array<string>")
    whole = _kind(d, "items") == "NONE"
    count = F.when(_kind(d, "item_count") == "BIGINT", F.try_variant_get(d, "$.item_count", "bigint"))
    top = _broken(
        both, F.lit("response"),
        ("keys", whole), ("session", ~whole & ~F.coalesce((string(d, "session_id") == F.col("session_id").cast("string")) & (string(d, "layer") == "UNRESOLVED_VISUAL"), F.lit(False))),
        ("count", ~whole & ~F.coalesce(count == F.size(F.try_variant_get(d, "$.items", "array<variant>")), F.lit(False))), ("order", ~whole & (F.coalesce("ids", none) != F.coalesce("due_ids", none))), category=F.lit("response"),
    )
    return _all(top, each, _broken(again, F.col("name"), ("id_repeated", F.col("n") > 1)))
