"""Ordered-interval operators: interval joins, islands, runs, chains, clamps, folds and chunk plans.

Everything is keyed by session, so a shuffle deals sessions out and windows run inside one; joins of intervals
become equi-joins on time buckets instead of nested loops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronotext.functions.text import normalized


def _by(keys: list[str], *order: str | Column):
    return Window.partitionBy(*keys).orderBy(*order)


def _before(w):
    return w.rowsBetween(Window.unboundedPreceding, -1)


def interval_join(left: DataFrame, right: DataFrame, on: list[str], left_span: tuple[str, str], right_span: tuple[str, str], bucket: float = 256.0) -> DataFrame:
    """Pairs whose spans overlap strictly. Both sides are dealt to time buckets and equi-joined; a pair that meets in
    several buckets counts in the one where the later start lies, so nothing has to be deduplicated."""

    def dealt(df: DataFrame, span: tuple[str, str], name: str) -> DataFrame:
        lo, hi = F.floor(F.col(span[0]) / bucket), F.floor(F.col(span[1]) / bucket)
        return df.withColumn(name, F.explode(F.sequence(lo, F.greatest(lo, hi))))

    a, b = dealt(left, left_span, "_bucket"), dealt(right, right_span, "_bucket")
    pairs = a.join(b, [*on, "_bucket"])
    (ls, le), (rs, re_) = ((F.col(x) for x in s) for s in (left_span, right_span))
    meet = (le > rs) & (ls < re_) & (F.floor(F.greatest(ls, rs) / bucket) == F.col("_bucket"))
    return pairs.where(meet).drop("_bucket")


def interval_anti_join(left: DataFrame, right: DataFrame, on: list[str], left_span: tuple[str, str], right_span: tuple[str, str], key: list[str], bucket: float = 256.0) -> DataFrame:
    """Rows of left (unique by on and key) that overlap no span of right."""
    hit = interval_join(left.select(*on, *key, *left_span), right.select(*on, *right_span), on, left_span, right_span, bucket).select(*on, *key).distinct()
    return left.join(hit, [*on, *key], "left_anti")


def islands(df: DataFrame, on: list[str], span: tuple[str, str], name: str = "island") -> DataFrame:
    """Numbers groups of overlapping or touching spans: a group starts beyond the running end of all before."""
    w = _by(on, *span)
    new = F.coalesce(F.col(span[0]) > F.max(span[1]).over(_before(w)), F.lit(True))
    return df.withColumn("_new", new.cast("int")).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_new")


def runs(df: DataFrame, on: list[str], order: str, key: str, empty_extends: bool = False) -> DataFrame:
    """run (from 0) and run_length, run_place (from 1) of rows with equal neighbouring keys; an empty key never extends."""
    w = _by(on, order)
    same = F.col(key).eqNullSafe(F.lag(key).over(w))
    same = same & F.lag(F.lit(1)).over(w).isNotNull()
    if not empty_extends:
        same = same & (F.col(key) != "")
    out = df.withColumn("_new", (~F.coalesce(same, F.lit(False))).cast("int")).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_new")
    r = Window.partitionBy(*on, "run")
    return out.withColumn("run_length", F.count("*").over(r)).withColumn("run_place", F.row_number().over(r.orderBy(order)))


def ranges(df: DataFrame, on: list[str], order: list[Column], parts: int = 64, few: int = 1_000_000) -> Column:
    """A number for each row, by its place in the order (nulls first) of on and order: rows that are equal there have the same. Splits keys with
    many rows; a table of few rows is one range. Borders are drawn from about 50 * parts rows, which come to the driver."""
    n = df.count()
    if n <= few:
        return F.lit(0)
    key = F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(on)), *(c.alias(f"o{i}") for i, c in enumerate(order)))
    drawn = df.select(key.alias("k")).sample(min(1.0, 50 * parts / n), seed=1)
    seen = [r[0] for r in drawn.orderBy("k").collect()]
    kinds = drawn.schema["k"].dataType
    borders = {tuple(seen[i]): None for i in range(len(seen) // parts, len(seen), max(1, len(seen) // parts))}
    above = [(key >= F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(b, kinds.fields, strict=True)))).cast("int") for b in borders]
    return sum(above, F.lit(0))


def numbered(df: DataFrame, on: list[str], order: list[Column], name: str, ties: list[Column] = (), **how) -> DataFrame:
    """Adds the place (from 1) of each row among those of on, by order (nulls first), then ties. With no ties, rows that are equal in order have the
    same place, that of the first. No task sorts more than one range of a key; ranges are counted up before."""
    ranged = df.withColumn("_range", ranges(df, on, order, **how))
    w = Window.partitionBy(*on, "_range").orderBy(*(c.asc_nulls_first() for c in (*order, *ties)))
    counts = ranged.groupBy(*on, "_range").agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_before", F.sum("_n").over(_before(Window.partitionBy(*on).orderBy("_range"))))
    counts = counts.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(on)), F.col("_range").alias("_r"), "_before")
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(on)]
    place = (F.row_number() if ties else F.rank()).over(w)
    out = ranged.withColumn("_place", place).join(counts, [*same, F.col("_range") == F.col("_r")])
    return out.select(*df.columns, (F.col("_place") + F.coalesce("_before", F.lit(0))).alias(name))


def followed(df: DataFrame, on: list[str], order: list[Column], value: str, name: str, **how) -> DataFrame:
    """Adds the value of the row before, in the order (nulls first, no two rows equal) of each on. Of the range before, its last row counts."""
    ranged = df.withColumn("_range", ranges(df, on, order, **how))
    w = Window.partitionBy(*on, "_range").orderBy(*(c.asc_nulls_first() for c in order))
    last = ranged.groupBy(*on, "_range").agg(F.max_by(F.struct(value), F.struct(*order)).alias("_last"))
    last = last.withColumn("_last", F.lag("_last").over(Window.partitionBy(*on).orderBy("_range")))
    last = last.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(on)), F.col("_range").alias("_r"), "_last")
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(on)]
    out = ranged.withColumn("_here", F.lag(F.struct(value)).over(w)).join(last, [*same, F.col("_range") == F.col("_r")])
    return out.select(*df.columns, F.coalesce("_here", "_last").getField(value).alias(name))


def running(df: DataFrame, on: list[str], buckets: list[Column], order: list[Column], value: Column, name: str, how=F.max) -> DataFrame:
    """Adds the sum or maximum of value over all rows before, in the order of each on (null for the first). Buckets, from fine to coarse, grow with the
    order: rows are dealt to (on, finest bucket), and what earlier buckets hold is carried over by one row a bucket, which are dealt to the
    next coarser buckets in their turn. So a long key isn't one task's."""
    fine, *coarse = buckets
    at, own, total, carry, inside = (f"_{c}{len(coarse)}" for c in ("bucket", "value", "total", "carry", "inside"))
    up = [f"_coarse{len(coarse)}_{i}" for i in range(len(coarse))]
    dealt = df.withColumn(at, fine).withColumn(own, value)
    before = how(own).over(_before(Window.partitionBy(*on, at).orderBy(*order)))
    totals = dealt.withColumns(dict(zip(up, coarse, strict=True))).groupBy(*on, at).agg(how(own).alias(total), *(F.max(c).alias(c) for c in up))
    if coarse:
        totals = running(totals, on, [F.col(c) for c in up], [F.col(at)], F.col(total), carry, how)
    else:
        totals = totals.withColumn(carry, how(total).over(_before(Window.partitionBy(*on).orderBy(at))))
    totals = totals.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(on)), F.col(at).alias("_b"), carry)
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(on)]
    out = dealt.withColumn(inside, before).join(totals, [*same, F.col(at).eqNullSafe(F.col("_b"))])
    both = F.greatest(inside, carry) if how is F.max else F.coalesce(F.col(inside) + F.col(carry), F.col(inside), F.col(carry))
    return out.select(*df.columns, both.alias(name))


def gaps(df: DataFrame, on: list[str], span: tuple[str, str], least: float = 0.0, most: float | None = None, bucket: float = 4096.0) -> DataFrame:
    """The complement of the spans inside each on: gap_start and gap (its length, over `least`, or at least it where that isn't 0) between all
    that has ended before and the next start. Touching and overlapping spans leave none; spans that end before they start, or have a
    null, are not read. Split by time, so long sessions are no one task's."""
    lo, hi = (F.col(c) for c in span)
    whole = df.where(hi >= lo).select(*on, *span)
    ended = running(whole, on, [F.floor(lo / bucket)], [lo, hi], hi, "gap_start")
    gap = lo - F.col("gap_start")
    wide = (gap > 0) & (gap >= least) & (F.lit(True) if most is None else gap <= most)
    return ended.where(wide).select(*on, "gap_start", gap.alias("gap"))


def clamp(df: DataFrame, on: list[str], duration: str) -> DataFrame:
    """Monotone timeline: spans are cut to [0, duration] and start where all before them have ended; blank or empty ones go."""
    cut = df.withColumn("seg_start", F.greatest(F.lit(0.0), "seg_start")).withColumn("seg_end", F.least(duration, "seg_end"))
    cut = cut.where((F.col("seg_end") > F.col("seg_start")) & (F.trim("text") != ""))
    done = F.max("seg_end").over(_before(_by(on, "seg_start", "seg_end", "id")))
    out = cut.withColumn("seg_start", F.greatest("seg_start", F.coalesce(done, F.lit(0.0)))).where("seg_end > seg_start")
    return out.withColumn("text", F.trim("text"))


def reindex(df: DataFrame, on: list[str], *order: str) -> DataFrame:
    return df.withColumn("new_id", (F.row_number().over(_by(on, *order)) - 1).cast("int"))


def timeline_violations(df: DataFrame, on: list[str], duration: str) -> DataFrame:
    """session, rule, item for spans that overlap, run backwards, start before 0 or end after the duration."""
    seen = df.withColumn("_done", F.coalesce(F.lag("seg_end").over(_by(on, "id")), F.lit(0.0)))
    named = (("overlap", F.col("seg_start") < F.col("_done") - 1e-6), ("invalid", (F.col("seg_end") < F.col("seg_start")) | (F.col("seg_start") < 0)), ("beyond_end", (F.col(duration) > 0) & (F.col("seg_end") > F.col(duration) + 1e-3)))
    rule = F.explode(F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in named)), lambda x: x.isNotNull()))
    return seen.select(*on, F.col("id").alias("item_id"), rule.alias("rule"))


def cleaned_violations(df: DataFrame, on: list[str], order: str = "place") -> DataFrame:
    """on, item_id, rule of cleaned segments that the later layers don't take: an id that stood before (repeated), a source other than the id
    itself (provenance), a start before the end of the segment in front or an end before the start (timeline). df: on, place, id,
    source_segment_id, seg_start, seg_end."""
    before = F.lag("seg_end").over(_by(on, order))
    seen = df.withColumn("_done", F.coalesce(before, F.lit(-1.0)))
    first = df.groupBy(*on, "id").agg(F.min(order).alias("_first"))
    seen = seen.join(first, [*on, "id"])
    named = (("provenance", ~F.col("source_segment_id").eqNullSafe(F.col("id"))), ("repeated", F.col(order) > F.col("_first")), ("timeline", (F.col("seg_start") < F.col("_done") - 1e-3) | (F.col("seg_end") < F.col("seg_start"))))
    rule = F.explode(F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in named)), lambda x: x.isNotNull()))
    return seen.select(*on, F.col("id").alias("item_id"), rule.alias("rule"))


def chunk_plan(sessions: DataFrame, minutes: int = 8, overlap: float = 30.0, duration: str = "duration") -> DataFrame:
    """chunk, core and window spans of every session with a duration; windows reach over their neighbours."""
    step = float(minutes * 60)
    out = sessions.where(F.col(duration) > 0).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(duration) / step) - 1)))
    out = out.withColumn("core_start", F.col("chunk") * step).withColumn("core_end", F.least(duration, (F.col("chunk") + 1) * step))
    return out.withColumn("window_start", F.greatest(F.lit(0.0), F.col("core_start") - overlap)).withColumn("window_end", F.least(duration, F.col("core_end") + overlap))


def split_plan(sessions: DataFrame, chunk: float, overlap: float, duration: str = "duration") -> DataFrame:
    """part and offset of overlapping audio parts."""
    step = max(1.0, chunk - overlap)
    return sessions.where(F.col(duration) > 0).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(duration) / step) - 1))).withColumn("offset", F.col("part") * step)


def fold_chunks(df: DataFrame, on: list[str], overlap: float) -> DataFrame:
    """Sequential fold over a session's chunk results: a row that starts before what the kept rows cover (less half
    the overlap) goes. The cover depends on what was kept, so no window function can say it."""
    state = F.struct(F.lit(0.0).alias("done"), F.expr("cast(array() as array<struct<chunk:bigint,place:bigint,seg_start:double,seg_end:double>>)").alias("kept"))

    def step(a: Column, x: Column) -> Column:
        skip = (F.size(a["kept"]) > 0) & (x["seg_start"] < a["done"] - overlap / 2)
        return F.when(skip, a).otherwise(F.struct(F.greatest(a["done"], x["seg_end"]).alias("done"), F.concat(a["kept"], F.array(x)).alias("kept")))

    row = F.struct(F.col("chunk").cast("long").alias("chunk"), F.col("place").cast("long").alias("place"), "seg_start", "seg_end")
    return df.groupBy(*on).agg(F.array_sort(F.collect_list(row)).alias("rows")).select(*on, F.explode(F.aggregate("rows", state, step, lambda a: a["kept"])).alias("r")).select(*on, "r.*")


def gap_chains(df: DataFrame, bucket: list[Column], limit: Column) -> DataFrame:
    """chain (from 0 in its bucket) and gap of recordings in order: a chain goes on while 0 <= gap <= limit, where the gap
    is measured from the end of the recording just before."""
    named = df
    for k, c in enumerate(bucket):
        named = named.withColumn(f"_b{k}", c)
    keys = [f"_b{k}" for k in range(len(bucket))]
    w = _by(keys, "start_sec", "session_id")
    named = named.withColumn("gap", F.col("start_sec") - F.lag(F.col("start_sec") + F.col("duration_sec")).over(w))
    new = (~F.coalesce(F.col("gap").between(F.lit(0.0), limit), F.lit(False))).cast("int")
    named = named.withColumn("_new", new).withColumn("chain", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return named.withColumn("chain_length", F.count("*").over(Window.partitionBy(*keys, "chain"))).drop("_new")


def repeat_key(df: DataFrame) -> DataFrame:
    return df.withColumn("key", normalized(F.col("text")))


