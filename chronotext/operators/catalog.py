"""Relational index operators on DataFrames: upserts as folds, first-writer-wins inserts, numbering, integrity.

Parquet tables take no MERGE, so an upsert unions the new rows behind the old and folds each key in one
aggregation, with partial aggregation before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronotext.sources.shared import materialized

from .sequence import numbered, running


def upsert(rows: DataFrame, key: list[str], seq: str, overwrite: list[str] = (), keep_known: list[str] = (), first: list[str] = ()) -> DataFrame:
    """One row a key: overwrite takes the last value even if null, keep_known the last that isn't null, first the first."""
    last = [F.max_by(c, seq).alias(c) for c in overwrite]
    known = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in keep_known]
    return rows.groupBy(*key).agg(*last, *known, *(F.min_by(c, seq).alias(c) for c in first))


def insert_or_ignore(old: DataFrame, new: DataFrame, key: str, seq: str) -> DataFrame:
    """Rows of new to insert: the first of each key that old doesn't hold."""
    struct = F.struct(*(c for c in new.columns if c != key))
    fresh = new.groupBy(key).agg(F.min_by(struct, seq).alias("_r")).select(key, "_r.*")
    return fresh.join(old.select(key).distinct(), key, "left_anti").select(*new.columns)


def course_sequence(sessions: DataFrame, course: str, start: str) -> DataFrame:
    """Number in the course: 1 + rows that start strictly earlier; without a start, 1 + all rows with one."""
    known = numbered(sessions.where(F.col(start).isNotNull()), [course], [F.col(start)], "number")
    total = sessions.groupBy(F.col(course).alias("_course")).agg((F.count(start) + 1).alias("number"))
    rest = sessions.where(F.col(start).isNull())
    rest = rest.join(total, rest[course].eqNullSafe(total["_course"])).drop("_course")
    return known.unionByName(rest.withColumn("number", F.col("number").cast(known.schema["number"].dataType)))


def guarded_delete(parents: DataFrame, key: str, gone: Column, *children: DataFrame) -> DataFrame:
    """parents without the rows to delete; rows that have children stay."""
    used = None
    for c in children:
        used = c.select(key) if used is None else used.unionByName(c.select(key))
    held = parents.where(gone).join(used.distinct(), key, "left_semi")
    return parents.where(~gone).unionByName(held)


def free_suffixes(wanted: DataFrame, taken: DataFrame, base: str, seq: str, order: str, name: str = "suffix", rows: int = 1 << 16) -> DataFrame:
    """Gives each wanted (base, seq) the least number from seq on that neither taken (base, seq) nor a wanted row before it has; rows come
    in the order of seq, then order (unique whole numbers). Numbers start at 1.

    Assigned in parallel: among the free numbers of a base, counted from 0, a row stands at p = max(place of its seq, p of the row before + 1), which is its
    rank plus a running maximum; how many taken numbers lie below is a running count both ways. Bases with many rows are split."""
    b, none = F.col(base).alias("_base"), F.lit(None).cast("long")
    held = taken.select(b, F.col(seq).cast("long").alias("_at")).where("_at >= 1").distinct().select("_base", "_at", none.alias("_order"), F.lit(1).alias("_taken"))
    asked = wanted.select(b, F.greatest(F.col(seq).cast("long"), F.lit(1).cast("long")).alias("_at"), F.col(order).cast("long").alias("_order"), F.lit(0).alias("_taken"))
    # _at ascending, a wanted row before the taken number it asks for
    line = [F.struct(F.col("_at"), F.when(F.col("_taken") == 1, F.lit(1 << 62)).otherwise(F.floor(F.col("_order") / rows))), F.floor(F.col("_at") / rows)]
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    both = running(held.unionByName(asked), ["_base"], line, [F.col("_at"), F.col("_taken"), F.col("_order")], F.col("_taken").cast("long"), "_below", F.sum)
    both = materialized(both.withColumn("_below", zero("_below")), "numbers")
    own = running(both.where("_taken = 0"), ["_base"], line, [F.col("_at"), F.col("_order")], F.lit(1).cast("long"), "_rank", F.sum).withColumn("_rank", zero("_rank"))
    own = materialized(own.withColumn("_slack", F.col("_at") - 1 - F.col("_below") - F.col("_rank")), "ranks")
    own = running(own, ["_base"], line, [F.col("_at"), F.col("_order")], F.col("_slack"), "_most").withColumn("_place", F.col("_rank") + F.greatest("_slack", "_most"))
    # a taken number has _at - 1 - _below free ones below it; a row lies beyond all that have no more than its place
    gates = both.where("_taken = 1").groupBy("_base", (F.col("_at") - 1 - F.col("_below")).alias("_place")).agg(none.alias("_order"), F.count("*").alias("_gates"))
    met = gates.unionByName(own.select("_base", "_place", "_order", F.lit(0).cast("long").alias("_gates")))
    met = running(met, ["_base"], [F.floor(F.col("_place") / rows)], [F.col("_place"), F.col("_gates").desc()], F.col("_gates"), "_passed", F.sum)
    found = met.where("_gates = 0").select(F.col("_order").alias("_o"), (F.col("_place") + 1 + zero("_passed")).alias(name))
    return wanted.join(found, F.col(order) == F.col("_o")).drop("_o")


def rename_all(parents: DataFrame, children: list[DataFrame], key: str, moves: DataFrame) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """(parents, children, refused) after moves (old, new): children of old are re-pointed to new and the old parent goes. A move is refused, and
    changes nothing, if its target is no parent, is itself moved away, or old is moved twice; so is one onto itself."""
    asked = moves.select("old", "new").distinct()
    known = parents.select(F.col(key).alias("new")).distinct().withColumn("_known", F.lit(True))
    twice = asked.groupBy("old").agg(F.count("*").alias("_n"))
    leaves = asked.select(F.col("old").alias("new")).distinct().withColumn("_leaves", F.lit(True))
    judged = asked.join(known, "new", "left").join(twice, "old").join(leaves, "new", "left")
    why = F.when(F.col("old").eqNullSafe(F.col("new")), "itself").when(F.col("_known").isNull(), "unknown_target").when(F.col("_n") > 1, "moved_twice").when(F.col("_leaves"), "target_moves")
    judged = judged.withColumn("reason", why)
    done = judged.where("reason IS NULL").select(F.col("old").alias("_old"), F.col("new").alias("_new"))
    moved = [c.join(done, F.col(key) == F.col("_old"), "left").withColumn(key, F.coalesce("_new", key)).select(*c.columns) for c in children]
    return parents.join(done, F.col(key) == F.col("_old"), "left_anti"), moved, judged.where("reason IS NOT NULL").select("old", "new", "reason")


def rename(frames: list[DataFrame], key: str, old: str, new: str) -> list[DataFrame]:
    """Re-points old to new in each frame; the first is the parent, whose old row goes."""
    out = [frames[0].where(F.col(key) != old)]
    return out + [f.withColumn(key, F.when(F.col(key) == old, F.lit(new)).otherwise(F.col(key))) for f in frames[1:]]


def key_violations(df: DataFrame, key: list[str], table: str) -> DataFrame:
    return df.groupBy(*key).count().where("count > 1").select(F.lit(f"{table}.unique").alias("rule"), F.concat_ws("|", *key).alias("item"))


def reference_violations(child: DataFrame, parent: DataFrame, fk: str, pk: str, table: str) -> DataFrame:
    return child.where(F.col(fk).isNotNull()).join(parent.select(F.col(pk).alias(fk)).distinct(), fk, "left_anti").select(F.lit(f"{table}.{fk}").alias("rule"), F.col(fk).cast("string").alias("item"))


# Which state may follow which.
TRANSITIONS = {
    "NEW": "AUDIO_READY FAILED",
    "AUDIO_READY": "TRANSCRIBING FAILED",
    "TRANSCRIBING": "TRANSCRIBED FAILED",
    "TRANSCRIBED": "IMAGES_READY GENERATING_NOTE FAILED",
    "IMAGES_READY": "FUSING FAILED",
    "FUSING": "GENERATING_NOTE FAILED",
    "GENERATING_NOTE": "EXPORTED FAILED",
    "EXPORTED": "DONE FAILED",
}
MERGEABLE = ("TRANSCRIBED", "IMAGES_READY", "GENERATING_NOTE", "EXPORTED", "DONE")
AUTOPILOT = ("TRANSCRIBED", "IMAGES_READY", "FUSING", "GENERATING_NOTE", "EXPORTED", "DONE")
PENDING = ("AUDIO_READY", "TRANSCRIBING")


def illegal_transitions(moves: DataFrame) -> DataFrame:
    """Rows of current and target that no edge allows; staying is allowed."""
    edges = F.create_map(*(F.lit(x) for k, v in TRANSITIONS.items() for x in (k, v)))
    allowed = F.coalesce(F.array_contains(F.split(edges[F.col("current")], " "), F.col("target")), F.lit(False))
    return moves.where((F.col("current") != F.col("target")) & ~allowed)


def match_slots(sessions: DataFrame, slots: DataFrame, tolerance: int = 30, default: str = "unknown") -> DataFrame:
    """matched course of each start: the nearest slot of its weekday within the tolerance, ties to the first course and slot.

    slots is a timetable: a few rows a course. It is joined on the weekday and reduced by min_by, which aggregates
    before the shuffle; Spark broadcasts it while it is under the session's threshold and shuffles it beyond."""
    s = sessions.withColumn("_wd", F.weekday("start_time") + 1).withColumn("_min", F.hour("start_time") * 60 + F.minute("start_time"))
    near = s.join(slots.where(F.col("slot_course") != default), (F.col("_wd") == F.col("weekday")) & F.col("_min").between(F.col("start_min") - tolerance, F.col("end_min") + tolerance))
    distance = F.greatest(F.lit(0), F.col("start_min") - F.col("_min"), F.col("_min") - F.col("end_min"))
    best = near.groupBy("session_id").agg(F.min_by(F.struct("slot_course", distance.alias("distance")), F.struct(distance.alias("d"), "course_ord", "slot_ord")).alias("m"))
    return sessions.join(best, "session_id", "left").withColumn("matched", F.coalesce("m.slot_course", F.lit(default))).withColumn("distance", F.col("m.distance")).drop("m")


def first_slot(sessions: DataFrame, slots: DataFrame, tolerance: int = 30) -> DataFrame:
    """slot_ord of the course's own first slot that holds the start, or null."""
    s = sessions.withColumn("_wd", F.weekday("start_time") + 1).withColumn("_min", F.hour("start_time") * 60 + F.minute("start_time"))
    own = s.join(slots, (F.col("course_key") == F.col("slot_course")) & (F.col("_wd") == F.col("weekday")) & F.col("_min").between(F.col("start_min") - tolerance, F.col("end_min") + tolerance))
    best = own.groupBy("session_id").agg(F.min("slot_ord").alias("slot"))
    return sessions.join(best, "session_id", "left")
