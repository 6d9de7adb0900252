"""What to work on next: active stages, regions by id or time, clipped results, relabel guards, status rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotext.sources.shared import materialized

# The stages of the chain, in order.
STAGES = ("clean", "structure", "knowledge", "draft")


def active_sessions(tasks: DataFrame) -> DataFrame:
    """session_id and the first stage with an open task and no artefact. tasks: session_id, stage, has_task, has_artefact."""
    order = F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage"))
    return tasks.where("has_task AND NOT has_artefact").groupBy("session_id").agg(F.min_by("stage", order).alias("stage"))


def waiting_sessions(tasks: DataFrame, auto_advance: bool = True) -> DataFrame:
    """session_id of sessions that the loop still has to look at: some stage has a task and no artefact, or, where stages go on by themselves, the first stage
    has a task and the last no artefact. tasks: session_id, stage, has_task, has_artefact."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    at = lambda k, c: F.max(F.when(F.col("stage") == STAGES[k], flag(c)).otherwise(False))
    per = tasks.groupBy("session_id").agg(F.max(F.col("stage").isin(*STAGES) & flag("has_task") & ~flag("has_artefact")).alias("open"), at(0, "has_task").alias("begun"), at(-1, "has_artefact").alias("done"))
    return per.where(F.col("open") | (F.lit(auto_advance) & F.col("begun") & ~F.col("done"))).select("session_id")


def next_stage(done: DataFrame) -> DataFrame:
    """session_id and the stage that comes after all that are finished in a row; null when the chain is through."""
    held = done.groupBy("session_id").agg(F.collect_set("stage").alias("s"))
    out = F.lit(None).cast("string")
    for s in reversed(STAGES):
        out = F.when(F.array_contains("s", s), out).otherwise(s)
    return held.select("session_id", out.alias("next"))


def fixpoint(rows: DataFrame, step: Callable[[DataFrame], DataFrame], rounds: int, goes_on: str = "_goes_on") -> DataFrame:
    """Applies step until nothing moves: it returns the rows with a flag whether they go on, and those that do are all that the next round reads. Each round
    is one table in the shared folder. Rows that still move after the last round are returned as they are."""
    settled, moving = [], rows
    for k in range(rounds):
        now = materialized(step(moving), f"round{k}")
        settled.append(now.where(~F.col(goes_on)).drop(goes_on))
        moving = now.where(F.col(goes_on)).drop(goes_on)
        if moving.isEmpty():
            break
    else:
        settled.append(moving)
    return reduce(DataFrame.unionByName, settled)


def auto_advance(sessions: DataFrame, prepare: Callable[[DataFrame], DataFrame], stages: tuple[str, ...] = STAGES) -> DataFrame:
    """Takes every session on from its last finished stage until a stage waits for an answer, or the last is prepared. sessions: session_id, stage and what
    prepare needs; prepare: adds or replaces columns for the stage now in ``stage`` and says in ``waits`` whether it waits (null: it does not). Sessions
    past the last stage, or in none of them, stay as they are with waits false. Adds ``advanced``, the stages prepared."""
    order = F.array(*map(F.lit, stages))
    place = F.array_position(order, F.col("stage"))

    def step(rows: DataFrame) -> DataFrame:
        ready = rows.withColumn("stage", F.element_at(order, (place + 1).cast("int"))).withColumn("advanced", F.col("advanced") + 1)
        told = prepare(ready).withColumn("waits", F.coalesce("waits", F.lit(False)))
        return told.withColumn("_goes_on", ~F.col("waits") & (place < len(stages)))

    movable = (place > 0) & (place < len(stages))
    start = sessions.withColumn("advanced", F.lit(0))
    there = fixpoint(start.where(F.coalesce(movable, F.lit(False))), step, len(stages) - 1)
    rest = start.where(~F.coalesce(movable, F.lit(False)))
    return there.unionByName(rest.withColumn("waits", F.lit(False)), allowMissingColumns=True)


def select_region(regions: DataFrame, segments: DataFrame, region_id: int | None = None, start: float = 0.0, end: float = 0.0, padding: float = 15.0) -> DataFrame:
    """The region of that id, or those that overlap [start, end); if none does, one made of the segments there."""
    cols = ["session_id", "region_id", "seg_start", "seg_end", "window_start", "window_end", "ids"]
    if region_id is not None:
        return regions.where(F.col("region_id") == region_id).select(*cols)
    hit = regions.where((F.col("seg_end") > start) & (F.col("seg_start") < end)).select(*cols)
    own = segments.where((F.col("seg_end") > start) & (F.col("seg_start") < end)).groupBy("session_id").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    made = own.select("session_id", F.lit(-1).cast("long").alias("region_id"), F.lit(start).alias("seg_start"), F.lit(end).alias("seg_end"), F.lit(max(0.0, start - padding)).alias("window_start"), F.lit(end + padding).alias("window_end"), "ids")
    return hit.unionByName(made.join(hit.select("session_id").distinct(), "session_id", "left_anti"))


def offset_results(results: DataFrame) -> DataFrame:
    """Segments of a window's clip (times from the clip's start) on the session's timeline: shifted, clipped to the window,
    trimmed, empty ones dropped. results: session_id, window_start, window_end, seg_start, seg_end, text."""
    out = results.withColumn("seg_start", F.greatest("window_start", F.col("seg_start") + F.col("window_start"))).withColumn("seg_end", F.least("window_end", F.col("seg_end") + F.col("window_start")))
    return out.withColumn("text", F.trim("text")).where("seg_end > seg_start AND text <> ''")


def relabel_blocked(sessions: DataFrame, artefacts: DataFrame, batches: DataFrame) -> DataFrame:
    """Sessions that can't be relabelled: they have derived artefacts, or an open web batch."""
    held = artefacts.where("layer <> 'raw'").select("session_id", F.lit("artefacts").alias("reason"))
    open_ = batches.where("status = 'open'").select("session_id", F.lit("web_batch").alias("reason"))
    return sessions.select("session_id").join(held.unionByName(open_).distinct(), "session_id")


def session_rows(sessions: DataFrame, steps: DataFrame) -> DataFrame:
    """session_id, state, and a map of step to status, for lists."""
    m = steps.groupBy("session_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("step", "status")))).alias("steps"))
    return sessions.select("session_id", "state").join(m, "session_id", "left")


def raw_unchanged(before: DataFrame, after: DataFrame) -> DataFrame:
    """Violations: sessions whose raw transcript isn't what it was."""
    b = after.select("session_id", F.col("sha256").alias("now"))
    return before.join(b, "session_id", "left").where(~F.col("sha256").eqNullSafe(F.col("now"))).select("session_id", F.lit("raw_changed").alias("rule"), F.lit("raw").alias("item_id"))


def audit_fields(row: Column, fields: list[str]) -> Column:
    """JSON of the fields that aren't null."""
    return F.to_json(F.struct(*(row[f].alias(f) for f in fields)))


def region_of(text: Column) -> Column:
    """struct(region_id, start, end) of "3" or "1:00-2:30"."""
    from chronotext.functions.names import seconds_of

    parts = F.split(text, "-")
    one = F.size(parts) == 1
    return F.struct(F.when(one, F.trim(text).try_cast("int")).alias("region_id"), F.when(~one, seconds_of(parts[0])).alias("start"), F.when(~one, seconds_of(F.get(parts, F.lit(1)))).alias("end"))
