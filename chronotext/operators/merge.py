"""Sessions that are parts of one recording: what forbids a merge, where each part begins, the merged timeline with its gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronotext.config import MergeConfig

from .catalog import MERGEABLE
from .validate import _named


def _parts(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """The requested sessions in the order of their start, with what came before them. A request holds few sessions, so a window over it is small."""
    known = sessions.select("session_id", "state", "start_sec", "duration_sec", "course_key", "date", "merged_into", F.lit(True).alias("known"))
    one = requests.select("request_id", "session_id").distinct().join(known, "session_id", "left")
    w = Window.partitionBy("request_id").orderBy(F.col("start_sec").asc_nulls_last(), "session_id")
    ended = F.lag(F.col("start_sec") + F.coalesce("duration_sec", F.lit(0.0))).over(w)
    return one.withColumn("gap", F.col("start_sec") - ended).withColumn("offset_sec", F.col("start_sec") - F.first("start_sec").over(w))


def merge_violations(requests: DataFrame, sessions: DataFrame, segments: DataFrame, cfg: MergeConfig = MergeConfig(), any_course: bool = False) -> DataFrame:
    """request as session_id, rule, item_id. requests: request_id, session_id (a row for each part asked for); sessions: session_id, state, start_sec, duration_sec,
    course_key, date, merged_into; segments: session_id. Rules of a request: too_few, several_courses, several_dates; of a part: repeated, unknown, merged,
    state, no_start, overlap (with the part before, by more than a second), gap (too wide), no_segments."""
    times = requests.groupBy("request_id", "session_id").agg(F.count("*").alias("asked"))
    parts = _parts(requests, sessions).join(times, ["request_id", "session_id"])
    spoken = segments.select("session_id").distinct().withColumn("spoken", F.lit(True))
    parts = parts.join(spoken, "session_id", "left").withColumn("part", F.col("session_id"))
    has, fine = F.col("known"), F.coalesce(F.col("state").isin(*MERGEABLE), F.lit(False))
    each = _named(
        parts.withColumn("session_id", F.col("request_id")), F.col("part"),
        ("repeated", F.col("asked") > 1), ("unknown", has.isNull()), ("merged", F.col("merged_into").isNotNull()), ("state", has & ~fine), ("no_start", has & F.col("start_sec").isNull()),
        ("overlap", F.col("gap") < -1.0), ("gap", F.col("gap") > cfg.max_gap_seconds), ("no_segments", has & F.col("spoken").isNull()),
    )
    whole = parts.groupBy("request_id").agg(F.sum("asked").alias("n"), F.count_distinct("course_key").alias("courses"), F.count_distinct("date").alias("dates"))
    rules = [("too_few", F.col("n") < 2), ("several_dates", F.col("dates") > 1)] + ([] if any_course else [("several_courses", F.col("courses") > 1)])
    return each.unionByName(_named(whole.withColumn("session_id", F.col("request_id")), F.lit("request"), *rules))


def merge_plan(requests: DataFrame, sessions: DataFrame, segments: DataFrame, cfg: MergeConfig = MergeConfig(), any_course: bool = False) -> DataFrame:
    """request_id, session_id, offset_sec, gap_before of the parts of requests that break no rule. A gap under the least one counts as none."""
    bad = merge_violations(requests, sessions, segments, cfg, any_course).select(F.col("session_id").alias("request_id")).distinct()
    gap = F.greatest(F.lit(0.0), F.coalesce("gap", F.lit(0.0)))
    return _parts(requests, sessions).join(bad, "request_id", "left_anti").select("request_id", "session_id", "offset_sec", F.when(gap >= cfg.min_gap_seconds, gap).otherwise(0.0).alias("gap_before"))


def merged_segments(plan: DataFrame, segments: DataFrame) -> DataFrame:
    """request_id, kind (segment or gap), seg_start, seg_end, text of the parts' segments on the first part's clock, and of the silence between parts."""
    spoken = plan.join(segments, "session_id").select("request_id", F.lit("segment").alias("kind"), (F.col("seg_start") + F.col("offset_sec")).alias("seg_start"), (F.col("seg_end") + F.col("offset_sec")).alias("seg_end"), "text")
    silent = plan.where("gap_before > 0").select("request_id", F.lit("gap").alias("kind"), (F.col("offset_sec") - F.col("gap_before")).alias("seg_start"), F.col("offset_sec").cast("double").alias("seg_end"), F.lit(None).cast("string").alias("text"))
    return spoken.unionByName(silent)
