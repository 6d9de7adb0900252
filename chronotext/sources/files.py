"""Readers: recordings, transcripts, session metadata, timetables, glossaries, packages and logs."""

from __future__ import annotations

import io
import re
import wave
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import file_system

# Suffixes of recordings.
AUDIO = ("mp3", "m4a", "wav", "flac", "aac", "ogg", "opus")
SEGMENT = "struct<id:int,start:double,end:double,text:string,no_speech_prob:double,avg_logprob:double>"
TRANSCRIPT = f"schema_version int, language string, duration_sec double, provider string, model string, segments array<{SEGMENT}>, _corrupt_record string"
METADATA = "schema_version int, session_id string, date string, state string, failed_from string, error string, start_time string, end_time string, course struct<key:string,name:string,teacher:string,semester:string,glossary:string>, audio struct<path:string,sha256:string,size:bigint,duration_sec:double>, steps map<string,struct<status:string,provider:string,model:string,started_at:string,finished_at:string,elapsed_sec:double,error:string>>, merged_from array<string>, merged_into string, _corrupt_record string"


def scan_recordings(spark: SparkSession, path: str, known: DataFrame, now: str, quiet_seconds: int = 10, streaming: bool = False) -> DataFrame:
    """Stable recordings that no known file equals: path, sha256, length, modificationTime, by path.

    Dot files, other suffixes, files changed within quiet_seconds of now, and known contents are left out. The content
    is hashed where it is read and goes no further."""
    reader = spark.readStream if streaming else spark.read
    files = reader.format("binaryFile").option("recursiveFileLookup", "true").load(path) if not streaming else reader.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    ok = ~F.startswith(name, F.lit(".")) & F.lower(F.element_at(F.split(name, r"\."), -1)).isin(*AUDIO) & (F.col("modificationTime") <= F.to_timestamp(F.lit(now)) - F.make_dt_interval(secs=F.lit(quiet_seconds)))
    out = files.where(ok).select("path", F.sha2("content", 256).alias("sha256"), "length", "modificationTime").join(known.select("sha256").distinct(), "sha256", "left_anti")
    return out if streaming else out.orderBy("path")


@F.pandas_udf(T.StructType([T.StructField("duration_sec", T.DoubleType()), T.StructField("sample_rate", T.IntegerType()), T.StructField("channels", T.IntegerType()), T.StructField("error", T.StringType())]))
def probe_wave(content: pd.Series) -> pd.DataFrame:
    """Length, rate and channels of PCM WAVE bytes; error where they aren't or are empty."""
    rows = []
    for data in content:
        try:
            with wave.open(io.BytesIO(data)) as w:
                seconds = w.getnframes() / w.getframerate()
                rows.append((seconds, w.getframerate(), w.getnchannels(), None) if seconds > 0 else (None, None, None, "no duration"))
        except (wave.Error, EOFError, TypeError) as e:
            rows.append((None, None, None, str(e) or "unreadable"))
    return pd.DataFrame(rows, columns=["duration_sec", "sample_rate", "channels", "error"]).astype({"sample_rate": "Int32", "channels": "Int32"})


def cut_wave(start: float, end: float):
    """Column function: the PCM WAVE bytes of [start, end)."""

    @F.pandas_udf("binary")
    def cut(content: pd.Series) -> pd.Series:
        out = []
        for data in content:
            with wave.open(io.BytesIO(data)) as w:
                a, b = int(start * w.getframerate()), int(end * w.getframerate())
                w.setpos(min(a, w.getnframes()))
                to = io.BytesIO()
                with wave.open(to, "wb") as o:
                    o.setparams(w.getparams())
                    o.writeframes(w.readframes(max(0, min(b, w.getnframes()) - a)))
            out.append(to.getvalue())
        return pd.Series(out)

    return cut


def creation_time(tags: list[str]):
    """First of several tag columns that holds a time."""
    return F.coalesce(*(F.try_to_timestamp(F.col(t)) for t in tags))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """A row a document: path, fields, valid (segments are there and the first has start, end and text)."""
    docs = spark.read.schema(TRANSCRIPT).json(path, multiLine=True, mode="PERMISSIVE").withColumn("path", F.col("_metadata.file_path"))
    first = F.get("segments", F.lit(0))
    return docs.withColumn("valid", F.coalesce(first["start"].isNotNull() & first["end"].isNotNull() & first["text"].isNotNull(), F.lit(False)))


def segments(transcripts: DataFrame, session: str = "path") -> DataFrame:
    """session_id, id (its place where missing), text (trimmed) and times; unreadable documents have none."""
    s = transcripts.select(F.col(session).alias("session_id"), F.posexplode("segments").alias("place", "s"))
    return s.select("session_id", F.coalesce("s.id", "place").alias("id"), F.trim("s.text").alias("text"), F.col("s.start").alias("seg_start"), F.col("s.end").alias("seg_end"), "s.no_speech_prob", "s.avg_logprob")


def missing_layers(sessions: DataFrame, layers: DataFrame) -> DataFrame:
    """Violations: sessions that have neither a repaired nor a raw transcript."""
    held = layers.where(F.col("layer").isin("repaired", "raw")).select("session_id")
    return sessions.select("session_id").distinct().join(held, "session_id", "left_anti").select("session_id", F.lit("no_transcript").alias("rule"), F.lit("session").alias("item_id"))


def best_layer(layers: DataFrame) -> DataFrame:
    """Of each session's layers the repaired one, else the raw one; others don't count."""
    rank = F.when(F.col("layer") == "repaired", 0).otherwise(1)
    return layers.where(F.col("layer").isin("repaired", "raw")).groupBy("session_id").agg(F.min_by(F.struct("layer", "path"), rank).alias("b")).select("session_id", "b.*")


def read_metadata(spark: SparkSession, root: str) -> DataFrame:
    """Session documents under root/*/metadata.json, by directory; unreadable ones are skipped, unknown keys dropped."""
    docs = spark.read.schema(METADATA).json(f"{root}/*/metadata.json", multiLine=True, mode="PERMISSIVE").withColumn("dir", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
    return docs.where("session_id IS NOT NULL").drop("_corrupt_record").orderBy("dir")


def rebuild_index(metadata: DataFrame) -> dict[str, DataFrame]:
    """courses, sessions and files of all readable session documents."""
    m = metadata
    return {
        "courses": m.where("course.key IS NOT NULL").groupBy(F.col("course.key").alias("key")).agg(F.max_by("course", "session_id").alias("c")).select("key", "c.name", "c.teacher", "c.semester", "c.glossary"),
        "sessions": m.select(F.col("session_id").alias("id"), F.col("course.key").alias("course_key"), "date", "start_time", "end_time", "state", "failed_from", "error", "dir"),
        "files": m.where("audio.sha256 IS NOT NULL").groupBy(F.col("audio.sha256").alias("sha256")).agg(F.min_by(F.struct(F.col("audio.path").alias("path"), F.col("audio.size").alias("size"), "session_id"), "session_id").alias("f")).select("sha256", "f.*"),
    }


def courses(spark: SparkSession, entries: list[dict], default: str = "unknown") -> DataFrame:
    """Timetable rows of parsed course entries (key, name, schedule of weekday, start, end); a wrong weekday is an error."""
    rows = []
    for k, e in enumerate(entries):
        for j, s in enumerate(e.get("schedule") or ()):
            if not 1 <= int(s["weekday"]) <= 7:
                raise ValueError(f"weekday of {e['key']} is {s['weekday']}")
            at = [int(h) * 60 + int(m) for h, m in (re.match(r"(\d+):(\d+)", s[x]).groups() for x in ("start", "end"))]
            rows.append((e["key"], k, j, int(s["weekday"]), *at))
    return spark.createDataFrame(rows, "slot_course string, course_ord int, slot_ord int, weekday int, start_min int, end_min int")


def glossary(lines: DataFrame) -> DataFrame:
    """term and ord of lines (file, file_priority, line_no, line): trimmed, no blanks or comments, first occurrence stays."""
    t = lines.withColumn("term", F.trim("line")).where("term <> '' AND NOT startswith(term, '#')")
    first = t.groupBy("term").agg(F.min(F.struct("file_priority", "line_no", "file")).alias("f"))
    return first.select("term", F.col("f.file").alias("file"), (F.row_number().over(Window.orderBy("f.file_priority", "f.line_no")) - 1).alias("ord"))


def package_manifests(files: DataFrame, limit: int = 10 << 20) -> DataFrame:
    """path, manifest, error of zipped packages (path, content): one manifest.json, no member over the limit or outside."""

    @F.pandas_udf("manifest string, error string")
    def read(content: pd.Series) -> pd.DataFrame:
        rows = []
        for data in content:
            try:
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    bad = next((i.filename for i in z.infolist() if i.filename.startswith("/") or ".." in i.filename.split("/") or i.file_size > limit), None)
                    own = [i for i in z.namelist() if i.split("/")[-1] == "manifest.json"]
                    rows.append((None, f"bad member {bad}") if bad else (None, f"{len(own)} manifests") if len(own) != 1 else (z.read(own[0]).decode(), None))
            except (zipfile.BadZipFile, UnicodeDecodeError) as e:
                rows.append((None, str(e)))
        return pd.DataFrame(rows, columns=["manifest", "error"])

    return files.select("path", read("content").alias("r")).select("path", "r.*")


#: Bytes of a log that its tail is looked for in.
TAIL_BYTES = 64 << 10


def log_tail(spark: SparkSession, path: str, n: int, most: int = TAIL_BYTES) -> DataFrame:
    """line_no, value of the last n lines that aren't blank, in order, from the last `most` bytes alone: a log grows without end. The first line of a longer log is
    left out, as it is mostly cut in two. A log that isn't there has none; bytes that are no UTF-8 are replaced."""
    fs, at = file_system(spark, path)
    lines: list[str] = []
    if fs.exists(at):
        size = fs.getFileStatus(at).getLen()
        stream = fs.open(at)
        try:
            stream.seek(max(0, size - most))
            raw = bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()
        lines = [x.rstrip() for x in raw.decode("utf-8", "replace").splitlines() if x.strip()][int(size > most) :][-n:] if n > 0 else []
    return spark.createDataFrame(list(enumerate(lines)), "line_no int, value string")


def segment_schema() -> T.StructType:
    return T._parse_datatype_string("session_id string, id int, seg_start double, seg_end double, text string, no_speech_prob double, avg_logprob double")
