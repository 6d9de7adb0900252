"""The ingest loop as Structured Streaming: content dedup, ordered stages a batch, the inbox of returned packages; backoff as a batch fold."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .stateful import BACKOFF, INCOMPLETE_BACKOFF


def dedup_content(files: DataFrame, watermark: str | None = None, delay: str = "30 minutes") -> DataFrame:
    """The first row of each content hash. With an event-time column the state is dropped behind the watermark."""
    if watermark:
        return files.withWatermark(watermark, delay).dropDuplicatesWithinWatermark(["sha256"])
    return files.dropDuplicates(["sha256"])


def retry_at(failures, at, incomplete):
    """Column: when a file may be tried again after so many failures."""
    table = lambda t: F.element_at(F.array(*map(F.lit, t)), F.least(F.greatest(failures, F.lit(1)), F.lit(len(t))).cast("int"))
    return at + F.when(incomplete, table(INCOMPLETE_BACKOFF)).otherwise(table(BACKOFF))


def backoff_state(attempts: DataFrame) -> DataFrame:
    """Failures since a file last changed or succeeded, and when to try again. attempts: path, at, size, mtime, ok, incomplete."""
    w = Window.partitionBy("path").orderBy("at")
    changed = ~(F.col("size").eqNullSafe(F.lag("size").over(w)) & F.col("mtime").eqNullSafe(F.lag("mtime").over(w))) | F.coalesce(F.lag("ok").over(w), F.lit(False))
    marked = attempts.withColumn("_g", F.sum(changed.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    group = marked.groupBy("path", "_g").agg(F.count_if(~F.col("ok")).alias("failures"), F.max("at").alias("at"), F.max_by("incomplete", "at").alias("incomplete"), F.max_by("ok", "at").alias("ok"))
    last = group.groupBy("path").agg(F.max_by(F.struct("failures", "at", "incomplete", "ok"), "_g").alias("l")).select("path", "l.*").where(~F.col("ok"))
    return last.select("path", "failures", retry_at(F.col("failures"), F.col("at"), F.col("incomplete")).alias("retry_at"))


def run_loop(files: DataFrame, stages: list[tuple[str, Callable[[DataFrame, int], None]]], checkpoint: str, once: bool = True, seconds: int = 15, log: Callable[[str, str], None] = lambda stage, error: None):
    """A query that hands every micro-batch to the stages in their order; a stage that fails is logged and the rest go on."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for name, stage in stages:
                try:
                    stage(batch, number)
                except Exception as e:  # noqa: BLE001  one stage must not stop the loop
                    log(name, str(e))
        finally:
            batch.unpersist()

    writer = files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


def quiet_sessions(materials: DataFrame, now: float, quiet_seconds: float) -> DataFrame:
    """Sessions whose newest material is old enough. materials: session_id, mtime."""
    return materials.groupBy("session_id").agg(F.max("mtime").alias("newest")).where(F.col("newest") <= now - quiet_seconds)


def inbox(returned: DataFrame, known: DataFrame) -> DataFrame:
    """Returned packages in order of arrival: accepted if their batch is open, processed if done, else rejected."""
    both = returned.join(known.select("batch_id", F.col("status").alias("_s")), "batch_id", "left")
    return both.withColumn("outcome", F.when(F.col("_s") == "open", "accepted").when(F.col("_s") == "done", "processed").otherwise("rejected")).drop("_s").orderBy("mtime", "batch_id")


def inbox_rows(spark: SparkSession, root: str) -> DataFrame | None:
    """What the inbox at root holds: package, batch_id, mtime, outcome, micro (the micro-batch that took it in); None before the first."""
    try:
        return spark.read.parquet(f"{root.rstrip('/')}/outcomes")
    except AnalysisException:
        return None


def inbox_stream(returned: DataFrame, known: DataFrame, root: str, fail_after: Callable[[int], bool] = lambda number: False):
    """A writer that takes returned packages in as they come. returned: package (unique), batch_id, mtime; known: batch_id, status.

    The first package of an open batch, by mtime and package, is ``accepted`` and closes it; later ones of it, and those of a batch that is done, are
    ``processed``; all others are ``rejected``. A micro-batch is one folder, replaced as a whole: whether a batch was closed before is read from the folders
    of smaller numbers only, so a micro-batch that is repeated after a failure gives the same rows and counts no package twice. fail_after is for
    tests: it stops the query after a micro-batch's rows are written and before Spark has noted it."""
    root = root.rstrip("/")

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        state = known.groupBy("batch_id").agg(F.max(F.struct(F.col("status") == "open", F.col("status") == "done")).alias("s"))
        rows = batch.select("package", "batch_id", "mtime").join(state, "batch_id", "left")
        before = inbox_rows(spark, root)
        closed = spark.createDataFrame([], returned.select("batch_id").schema) if before is None else before.where((F.col("micro") < number) & (F.col("outcome") == "accepted")).select("batch_id").distinct()
        rows = rows.join(closed.withColumn("closed", F.lit(True)), "batch_id", "left")
        # one row a batch, combined before the shuffle; no window over the packages of a batch
        first = batch.groupBy("batch_id").agg(F.min(F.struct("mtime", "package")).alias("f"))
        rows = rows.join(first, "batch_id", "left")
        is_open, is_done = (F.coalesce(F.col("s")[c], F.lit(False)) for c in ("col1", "col2"))
        leads = F.struct("mtime", "package").eqNullSafe(F.col("f"))
        outcome = F.when(is_open & F.col("closed").isNull() & leads, "accepted").when(is_open | is_done, "processed").otherwise("rejected")
        rows.select("package", "batch_id", "mtime", outcome.alias("outcome")).write.mode("overwrite").parquet(f"{root}/outcomes/micro={number}")
        if fail_after(number):
            raise RuntimeError(f"stopped after micro-batch {number}")

    return returned.writeStream.foreachBatch(take).option("checkpointLocation", f"{root}/state")
