"""Views of the driver's tables in the library's data model. Times are multiples of 1/8, so sums are exact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _timed(rows: DataFrame) -> DataFrame:
    n = F.length("text")
    rows = rows.withColumn("dur", F.when(F.col("id") % 97 == 0, 64 + n / 8).otherwise(F.greatest(n, F.lit(1)) / 8))
    before = F.sum("dur").over(Window.partitionBy("session_id").orderBy("id").rowsBetween(Window.unboundedPreceding, -1))
    out = rows.withColumn("seg_start", F.coalesce(before, F.lit(0.0))).withColumn("seg_end", F.col("seg_start") + F.col("dur"))
    return out.select("session_id", "id", "text", "seg_start", "seg_end")


def seg_docs(spark: SparkSession, d: str) -> DataFrame:
    """A document is a session, each of its lines a segment."""
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("session_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("id", "text"))
    return _timed(lines)


def seg_conv(spark: SparkSession, d: str) -> DataFrame:
    """A conversation is a session, each turn a segment."""
    return _timed(table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").cast("int").alias("id"), F.coalesce("text", F.lit("")).alias("text")))


def durations(seg: DataFrame) -> DataFrame:
    return seg.groupBy("session_id").agg(F.max("seg_end").alias("duration"))


STATES = {"signup": "NEW", "view": "AUDIO_READY", "click": "TRANSCRIBED", "purchase": "DONE", "error": "FAILED"}


def sess_events(spark: SparkSession, d: str) -> DataFrame:
    """An event is a recording: course, start to the second, duration, state."""
    state = F.create_map(*(F.lit(x) for kv in STATES.items() for x in kv))[F.col("event_type")]
    return table(spark, d, "events").select(
        F.col("event_id").alias("session_id"),
        (F.col("user_id") % 25).cast("int").alias("course_key"),
        F.date_trunc("second", F.col("ts").cast("timestamp")).alias("start_time"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("start_sec"),
        (F.floor("value") * 30).cast("double").alias("duration_sec"),
        state.alias("state"),
    )


def schedule(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    start = 480 + (k % 5) * 110
    return table(spark, d, "nation").select(k.cast("int").alias("slot_course"), k.alias("course_ord"), F.lit(0).alias("slot_ord"), (k % 7 + 1).alias("weekday"), start.alias("start_min"), (start + 100).alias("end_min"))


def proc_orders(spark: SparkSession, d: str) -> DataFrame:
    """An order is a step's status report, in order of its key."""
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("session_id"), F.col("o_orderpriority").alias("step"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("m"), F.col("o_orderkey") % 7)).alias("model"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderdate").cast("timestamp")).alias("started_at"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("elapsed"),
    )


def files_docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), F.concat_ws("/", "source", "doc_id").alias("path"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"), F.when(F.col("doc_id") % 10 != 0, F.col("doc_id") * 60).alias("timestamp"), F.col("doc_id").alias("seq"), (F.col("doc_id") % 7).alias("session_id"))


def outline_topics(spark: SparkSession, d: str) -> DataFrame:
    """Topics of five segments each; every seventh session's second topic loses its first source, every eleventh repeats one."""
    seg = seg_docs(spark, d)
    src = seg.groupBy("session_id", F.floor(F.col("id") / 5).cast("int").alias("topic")).agg(F.sort_array(F.collect_list("id")).alias("sources"), F.min("seg_start").alias("t_start"), F.max("seg_end").alias("t_end"))
    bad = F.when((F.col("session_id") % 7 == 0) & (F.col("topic") == 1), F.slice("sources", 2, 5)).when((F.col("session_id") % 11 == 0) & (F.col("topic") == 0), F.concat("sources", F.slice("sources", 1, 1))).otherwise(F.col("sources"))
    late = F.when(F.col("session_id") % 13 == 0, F.col("t_end") + 2.0).otherwise(F.col("t_end"))
    return src.withColumn("sources", bad).withColumn("t_end", late)


def knowledge_items(spark: SparkSession, d: str) -> DataFrame:
    """An item for each segment whose id isn't 3 modulo 4; some point to a topic that isn't theirs, some weigh too little."""
    seg = seg_docs(spark, d).where("id % 4 <> 3")
    topic = F.when(F.col("session_id") % 17 == 0, F.floor(F.col("id") / 5) + 1).otherwise(F.floor(F.col("id") / 5)).cast("int")
    return seg.select("session_id", F.col("id").alias("item"), topic.alias("topic"), F.array("id", (F.col("id") + 1).cast("int")).alias("sources"), ((F.col("id") * 37 + F.col("session_id")) % 101 / 128).alias("importance"), F.when(F.col("id") % 9 == 0, "incomplete").otherwise("complete").alias("status"))
