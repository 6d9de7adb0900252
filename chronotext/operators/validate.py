"""Quality validators: each returns violations (session_id, rule, item_id) instead of raising on the first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronotext.config import CleanConfig, PrivacyConfig
from chronotext.functions.text import content_key


class ConstraintError(ValueError):
    pass


def strict(violations: DataFrame) -> None:
    """Raises if there is a violation; names the first twenty."""
    if rows := violations.limit(20).collect():
        raise ConstraintError("; ".join(f"{r.session_id}: {r.rule} {r.item_id}" for r in rows))


def _named(df: DataFrame, item: Column, *rules: tuple[str, Column]) -> DataFrame:
    rule = F.explode(F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in rules)), lambda x: x.isNotNull()))
    return df.select("session_id", rule.alias("rule"), item.cast("string").alias("item_id"))


# ---- cleaned segments ----


def clean_violations(cleaned: DataFrame, source: DataFrame, cfg: CleanConfig = CleanConfig()) -> DataFrame:
    """Missing, unknown and repeated ids, blank texts without a reason, texts longer than 3 times their source plus 30, and
    sessions that keep too little or grow too much. cleaned: session_id, id, text, uncertain."""
    got = cleaned.groupBy("session_id", "id").agg(F.count("*").alias("n"), F.first("text").alias("new"), F.first("uncertain").alias("uncertain"))
    both = source.select("session_id", "id", F.col("text").alias("old")).join(got, ["session_id", "id"], "full")
    blank = F.coalesce(F.trim("new") == "", F.lit(False))
    per = _named(both, F.col("id"), ("missing", F.col("n").isNull()), ("unknown", F.col("old").isNull()), ("repeated", F.col("n") > 1), ("blank", blank & (F.coalesce(F.size("uncertain"), F.lit(0)) <= 0)), ("expanded", F.length("new") > 3 * F.length("old") + 30))
    sums = retention(both.select("session_id", F.length("old").alias("before"), F.length("new").alias("after")))
    return per.unionByName(_named(sums, F.lit("session"), ("retention", F.col("kept") < cfg.min_retention_ratio), ("expansion", F.col("kept") > cfg.max_expansion_ratio)))


def retention(lengths: DataFrame, ignored: Column | None = None) -> DataFrame:
    """kept: characters after per character before (less ignored ones)."""
    before = F.sum("before") - (F.sum(ignored) if ignored is not None else F.lit(0))
    return lengths.groupBy("session_id").agg((F.sum(F.coalesce("after", F.lit(0))) / F.greatest(F.lit(1), before)).alias("kept"))


def json_type_violations(df: DataFrame, column: str, types: dict[str, str]) -> DataFrame:
    """Rows whose JSON has other keys than types, or values of other kinds; a boolean is no number."""
    keys = F.array_sort(F.json_object_keys(column))
    bad = [F.when(keys.isNull() | (F.array_sort(F.array(*map(F.lit, types))) != keys), F.lit("keys"))]
    for k, kind in types.items():
        schema = F.schema_of_variant(F.variant_get(F.try_parse_json(column), f"$.{k}", "variant"))
        ok = F.startswith(schema, F.lit(kind)) if kind != "NUMBER" else schema.isin("BIGINT", "DOUBLE") | F.startswith(schema, F.lit("DECIMAL"))
        bad.append(F.when(~F.coalesce(ok, F.lit(False)), F.lit(f"type of {k}")))
    return df.withColumn("rule", F.explode(F.filter(F.array(*bad), lambda x: x.isNotNull()))).select("session_id", "rule", F.lit("document").alias("item_id"))


# ---- boundaries of overlapping chunks ----


def boundary_decisions(items: DataFrame) -> DataFrame:
    """One row a pair of neighbouring chunks with shared ids: deterministic, or llm with the ids whose content differs.
    items: session_id, chunk, id, text."""
    nxt = F.lead("chunk").over(Window.partitionBy("session_id").orderBy("chunk"))
    order = items.select("session_id", "chunk").distinct().withColumn("next", nxt)
    left = items.join(order, ["session_id", "chunk"]).select("session_id", "chunk", "next", "id", F.trim("text").alias("l"))
    right = items.select("session_id", F.col("chunk").alias("next"), "id", F.trim("text").alias("r"))
    pair = left.join(right, ["session_id", "next", "id"]).withColumn("conflict", content_key(F.col("l")) != content_key(F.col("r")))
    out = pair.groupBy("session_id", "chunk").agg(F.sort_array(F.collect_list(F.when(F.col("conflict"), F.col("id")))).alias("conflicts"), F.count("*").alias("n_shared"), F.max(F.col("l") != F.col("r")).alias("differ"))
    reason = F.when(F.size("conflicts") > 0, "overlap_text_conflict").when(F.col("differ"), "punctuation_or_whitespace_equivalent").otherwise("identical_overlap")
    return out.select("session_id", "chunk", F.when(F.size("conflicts") > 0, "llm").otherwise("deterministic").alias("decision"), reason.alias("reason"), "conflicts", "n_shared")


def merged_item(left: str, right: str) -> Column:
    """struct of equal items of two chunks: the longer text (left on a tie), sorted unions without blanks, distinct corrections in order. Null lists are empty."""
    a, b = F.col(left), F.col(right)
    own = lambda x, f: F.coalesce(x[f], F.array().cast("array<string>"))
    union = lambda f: F.array_sort(F.filter(F.array_union(own(a, f), own(b, f)), lambda x: F.trim(x) != "")).alias(f)
    text = F.when(F.length(F.trim(a["text"])) >= F.length(F.trim(b["text"])), F.trim(a["text"])).otherwise(F.trim(b["text"]))
    fields = ("original", "corrected", "decision", "reason")
    whole = lambda x: F.transform(F.coalesce(x["corrections"], F.expr("cast(array() as array<struct<original:string,corrected:string,decision:string,reason:string>>)")), lambda c: F.struct(*(F.coalesce(c[f], F.lit("")).alias(f) for f in fields)))
    return F.struct(text.alias("text"), union("uncertain"), union("visual_references"), F.array_distinct(F.concat(whole(a), whole(b))).alias("corrections"))


def boundary_merged(items: DataFrame) -> DataFrame:
    """session_id, chunk, id and the merged item of every segment that neighbouring chunks share, where no shared segment of the two differs in content.
    items: session_id, chunk, id, text, uncertain, visual_references, corrections."""
    pairs = boundary_decisions(items).where("decision = 'deterministic'").select("session_id", "chunk")
    order = items.select("session_id", "chunk").distinct().withColumn("next", F.lead("chunk").over(Window.partitionBy("session_id").orderBy("chunk")))
    row = F.struct("text", "uncertain", "visual_references", "corrections")
    left = items.join(order.join(pairs, ["session_id", "chunk"]), ["session_id", "chunk"]).select("session_id", "chunk", "next", "id", row.alias("l"))
    right = items.select("session_id", F.col("chunk").alias("next"), "id", row.alias("r"))
    return left.join(right, ["session_id", "next", "id"]).select("session_id", "chunk", "id", merged_item("l", "r").alias("m")).select("session_id", "chunk", "id", "m.*")


def assemble(source: DataFrame, results: DataFrame) -> DataFrame:
    """For each source segment the result of the chunk whose core holds its middle (half open), else of the first chunk.
    source: session_id, id, seg_start, seg_end; results: session_id, id, chunk, core_start, core_end, text."""
    mid = (F.col("seg_start") + F.col("seg_end")) / 2
    both = source.join(results, ["session_id", "id"], "left")
    inside = F.coalesce((F.col("core_start") <= mid) & (mid < F.col("core_end")), F.lit(False))
    return both.groupBy("session_id", "id").agg(F.min_by(F.struct("chunk", "text"), F.when(F.col("chunk").isNotNull(), F.struct((~inside).alias("o"), "chunk"))).alias("r")).select("session_id", "id", "r.*")


def overlay(items: DataFrame, boundary: DataFrame) -> DataFrame:
    """items with the last boundary's text for ids that one has settled."""
    last = boundary.groupBy("session_id", "id").agg(F.max_by("text", "boundary").alias("settled"))
    return items.join(last, ["session_id", "id"], "left").withColumn("text", F.coalesce("settled", "text")).withColumn("source", F.when(F.col("settled").isNotNull(), "boundary").otherwise("chunk")).drop("settled")


# ---- outlines ----


def topic_partition_violations(topics: DataFrame, seg: DataFrame) -> DataFrame:
    """Source ids that no topic, or several places, hold. topics: session_id, topic, sources."""
    used = topics.select("session_id", F.explode("sources").alias("id")).groupBy("session_id", "id").agg(F.count("*").alias("n"))
    both = seg.select("session_id", "id", F.lit(True).alias("there")).join(used, ["session_id", "id"], "full")
    return _named(both, F.col("id"), ("missing", F.col("n").isNull()), ("unknown", F.col("there").isNull()), ("duplicate", F.col("n") > 1))


def contiguous(sources: Column) -> Column:
    """Whether the places are lowest to highest without a gap, in order."""
    return F.when(F.size(sources) > 0, sources == F.sequence(F.array_min(sources), F.array_max(sources))).otherwise(False)


def ascending(sources: Column) -> Column:
    return sources == F.array_sort(sources)


def topic_time_violations(topics: DataFrame, seg: DataFrame, tolerance: float = 1.5) -> DataFrame:
    """A topic starts with its first source and ends where the next topic's first source starts, or with its own last."""
    t = topics.withColumn("first_id", F.get("sources", F.lit(0))).withColumn("last_id", F.try_element_at("sources", F.lit(-1)))
    w = Window.partitionBy("session_id").orderBy("topic")
    times = seg.select("session_id", "id", "seg_start", "seg_end")
    t = t.join(times.select("session_id", F.col("id").alias("first_id"), F.col("seg_start").alias("own_start")), ["session_id", "first_id"], "left").join(times.select("session_id", F.col("id").alias("last_id"), F.col("seg_end").alias("own_end")), ["session_id", "last_id"], "left")
    t = t.withColumn("due_end", F.coalesce(F.lead("own_start").over(w), "own_end"))
    return _named(t, F.col("topic"), ("wrong_start", F.abs(F.col("t_start") - F.col("own_start")) > tolerance), ("wrong_end", F.abs(F.col("t_end") - F.col("due_end")) > tolerance))


def evidence_violations(items: DataFrame, topics: DataFrame) -> DataFrame:
    """Items of unknown topics, or with sources outside theirs. items: session_id, item, topic, sources."""
    t = topics.select("session_id", "topic", F.col("sources").alias("allowed"))
    both = items.join(t, ["session_id", "topic"], "left")
    return _named(both, F.col("item"), ("unknown_topic", F.col("allowed").isNull()), ("outside_topic", F.size(F.array_except("sources", "allowed")) > 0))


def transition_violations(moves: DataFrame, topics: DataFrame) -> DataFrame:
    """Transitions (session_id, item, from_topic, to_topic) to or from unknown topics, or to the same one."""
    known = topics.select("session_id", "topic").distinct()
    a = known.select("session_id", F.col("topic").alias("from_topic"), F.lit(1).alias("a"))
    b = known.select("session_id", F.col("topic").alias("to_topic"), F.lit(1).alias("b"))
    both = moves.join(a, ["session_id", "from_topic"], "left").join(b, ["session_id", "to_topic"], "left")
    return _named(both, F.col("item"), ("unknown_topic", F.col("a").isNull() | F.col("b").isNull()), ("same_topic", F.col("from_topic") == F.col("to_topic")))


def uncovered(required: DataFrame, items: DataFrame) -> DataFrame:
    """session_id, id of required segments (say, with a derivation cue) that no item's sources hold."""
    return required.select("session_id", "id").join(items.select("session_id", F.explode("sources").alias("id")).distinct(), ["session_id", "id"], "left_anti")


# ---- knowledge ----


def knowledge_violations(items: DataFrame, least: float = 0.3) -> DataFrame:
    """importance outside [0, 1] or under the threshold, unknown status, sources out of order, derivations of one step."""
    steps = ("single_step", (F.col("category") == "derivations") & (F.size("steps") < 2)) if "steps" in items.columns else ("single_step", F.lit(False))
    return _named(items, F.col("item"), ("importance_range", ~F.col("importance").between(0, 1)), ("importance_low", F.col("importance") < least), ("status", ~F.col("status").isin("complete", "incomplete")), ("order", ~ascending(F.col("sources"))), steps)


def coverage(items: DataFrame) -> DataFrame:
    """session_id and the sorted distinct source ids of all its items."""
    return items.groupBy("session_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("covered"))


def routing_gaps(items: DataFrame, uncertain: DataFrame) -> DataFrame:
    """Incomplete items whose sources touch nothing that is listed as uncertain (session_id, sources)."""
    c = coverage(uncertain)
    both = items.where("status = 'incomplete'").join(c, "session_id", "left")
    return _named(both, F.col("item"), ("unrouted", ~F.coalesce(F.arrays_overlap("sources", "covered"), F.lit(False))))


def retention_gaps(upstream: DataFrame, downstream: DataFrame, key: list[str]) -> DataFrame:
    return upstream.select(*key).distinct().join(downstream.select(*key).distinct(), key, "left_anti")


def evidence_text(items: DataFrame, seg: DataFrame) -> DataFrame:
    """session_id, item, evidence: the texts of an item's sources in order."""
    s = items.select("session_id", "item", F.posexplode("sources").alias("place", "id")).join(seg.select("session_id", "id", "text"), ["session_id", "id"])
    return s.groupBy("session_id", "item").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "").alias("evidence"))


def referenced_labels(refs: DataFrame, seg_labels: DataFrame) -> DataFrame:
    """session_id, item, labels: sorted distinct labels of the segments that an item refers to."""
    s = refs.select("session_id", "item", F.explode_outer("sources").alias("id")).join(seg_labels, ["session_id", "id"], "left")
    return s.groupBy("session_id", "item").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("labels")))).alias("labels"))


# ---- drafts ----


def draft_violations(bridge: DataFrame, items: DataFrame) -> DataFrame:
    """Each item exactly once, in a section of its own topic. bridge: session_id, section, topic, item."""
    seen = bridge.groupBy("session_id", "item").agg(F.count("*").alias("n"), F.min("topic").alias("lo"), F.max("topic").alias("hi"))
    both = items.select("session_id", "item", F.col("topic").alias("own")).join(seen, ["session_id", "item"], "full")
    return _named(both, F.col("item"), ("missing", F.col("n").isNull()), ("unknown", F.col("own").isNull()), ("duplicate", F.col("n") > 1), ("wrong_topic", (F.col("lo") != F.col("own")) | (F.col("hi") != F.col("own"))))


def drift(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either frame that the other doesn't hold as often, with their side."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


# ---- provenance ----


def provenance_violations(layers: DataFrame) -> DataFrame:
    """Layers whose upstream hash isn't the present hash of that session's upstream layer.
    layers: session_id, layer, upstream, sha256, source_sha256."""
    up = layers.select("session_id", F.col("layer").alias("upstream"), F.col("sha256").alias("now"))
    both = layers.where("upstream IS NOT NULL").join(up, ["session_id", "upstream"], "left")
    return _named(both, F.col("layer"), ("missing_upstream", F.col("now").isNull()), ("stale", F.col("now") != F.col("source_sha256")))


def manifest_violations(sent: DataFrame, returned: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Fields of a request that came back changed, or requests that didn't come back."""
    r = returned.select(*keys, *(F.col(f).alias(f"_{f}") for f in fields), F.lit(1).alias("_there"))
    both = sent.join(r, keys, "left")
    return _named(both, F.concat_ws("|", *keys), ("not_returned", F.col("_there").isNull()), *((f"changed_{f}", F.col("_there").isNotNull() & ~F.col(f).eqNullSafe(F.col(f"_{f}"))) for f in fields))


def require_private(kind: str, provider: str, local: tuple[str, ...], cfg: PrivacyConfig = PrivacyConfig()) -> None:
    """Refuses a remote provider for audio or transcripts where the configuration keeps them here."""
    allowed = cfg.allow_cloud_audio if kind == "audio" else cfg.allow_cloud_transcript
    if provider not in local and not allowed:
        raise ConstraintError(f"{kind} may not be sent to {provider}")
