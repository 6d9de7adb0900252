"""Writers: transcripts as JSON and Markdown, drafts, front matter, package manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronotext.functions.names import hhmmss
from chronotext.operators.sequence import interval_join, numbered


def in_order(order: Column | str, value: Column, by: str = "\n") -> Column:
    """Aggregate: values joined in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order) if isinstance(order, str) else order, value.alias("v")))), lambda x: x["v"]), by)


def escaped(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, "\r?\n", " "), F.lit("[["), F.lit(r"\[\["))


def transcript_markdown(seg: DataFrame, title: str = "Transcript") -> DataFrame:
    """session_id and markdown: a header and a line a segment, with a mark where it is uncertain."""
    mark = F.when(F.col("uncertain"), " ⚠").otherwise("") if "uncertain" in seg.columns else F.lit("")
    line = F.concat(F.lit("["), hhmmss(F.col("seg_start")), F.lit("] "), F.regexp_replace("text", "\r?\n", " "), mark)
    return seg.groupBy("session_id").agg(F.concat(F.lit(f"# {title}\n\n"), in_order("id", line)).alias("markdown"))


def _text_or(c: str, other: str = "") -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(other))


def layer_markdown(sessions: DataFrame, seg: DataFrame, layer: str) -> DataFrame:
    """session_id and markdown of a repaired or cleaned transcript: a head that says where it comes from, then a line a segment. sessions: session_id, course, date,
    fingerprint, and of repaired ones regions, windows, accepted, rejected, of cleaned ones source_layer; seg: session_id, id, seg_start, text,
    uncertain (a list of reasons, of cleaned ones). A session without segments has its head only."""
    title = F.coalesce(F.nullif("course", F.lit("")), F.col("session_id").cast("string"))
    field = lambda name, c: F.concat(F.lit(f"{name}: "), c)
    common = [F.lit("---"), field("session_id", _text_or("session_id")), field("course", _text_or("course")), field("date", _text_or("date"))]
    if layer == "repaired":
        count = lambda c: F.col(c).cast("string")
        told = F.concat(F.lit("> 检测 "), count("regions"), F.lit(" 个可疑 segments，合并为 "), count("windows"), F.lit(" 个窗口；接受 "), count("accepted"), F.lit(" 个修复，拒绝 "), count("rejected"), F.lit(" 个。"))
        head = [*common, F.lit("type: transcript_repaired"), F.lit("source: transcript_raw.json"), field("repair_fingerprint", _text_or("fingerprint")), F.lit("---"), F.lit(""), F.concat(F.lit("# 选择性修复转录 · "), title), F.lit(""), told, F.lit("> RAW 转录未被覆盖；每个决定见 JSON 的 repair_history。"), F.lit("")]
        why = F.lit("")
    elif layer == "clean":
        head = [*common, F.lit("type: transcript_clean"), field("source_layer", _text_or("source_layer")), field("clean_fingerprint", _text_or("fingerprint")), F.lit("---"), F.lit(""), F.concat(F.lit("# 忠实清洗转录 · "), title), F.lit(""), F.lit("> 本文件只做 ASR 纠错、标点与断句，不是课堂摘要。"), F.lit("")]
        why = doubts(F.col("uncertain"))
    else:
        raise ValueError(f"no such layer: {layer}")
    body = seg.groupBy("session_id").agg(in_order("id", _spoken(why)).alias("_body"))
    return sessions.join(body, "session_id", "left").select("session_id", F.concat_ws("\n", *head, F.col("_body")).alias("markdown"))


def doubts(reasons: Column) -> Column:
    """A mark with the reasons; nothing where there are none."""
    return F.when(F.size(reasons) > 0, F.concat(F.lit("  ⚠ "), F.array_join(reasons, "；"))).otherwise("")


def _spoken(why: Column) -> Column:
    return F.concat(F.lit("`["), hhmmss(F.col("seg_start")), F.lit("]` "), F.coalesce("text", F.lit("")), why, F.lit("\n"))


def canary_markdown(plans: DataFrame, seg: DataFrame, layer: str, by: Column | None = None) -> DataFrame:
    """session_id, chunk, markdown of trial chunks: the segments that a chunk's window overlaps. plans: session_id, chunk, window_start, window_end. by: who
    made it (of cleaned ones, whose segments have reasons in ``uncertain``)."""
    met = interval_join(seg, plans, ["session_id"], ("seg_start", "seg_end"), ("window_start", "window_end"))
    why = doubts(F.col("uncertain")) if "uncertain" in seg.columns else F.lit("")
    body = met.groupBy("session_id", "chunk").agg(in_order("id", _spoken(why)).alias("_body"), F.count("*").alias("_n"))
    n = F.col("chunk").cast("string")
    window = F.concat(F.lit("window "), hhmmss(F.col("window_start")), F.lit("–"), hhmmss(F.col("window_end")))
    told = F.concat(F.lit("> "), window, F.lit(" · segments="), F.coalesce("_n", F.lit(0)).cast("string")) if by is None else F.concat(F.lit("> "), by, F.lit(" · "), window)
    head = [F.concat(F.lit(f"# {layer} Canary · chunk "), F.lpad(n, F.greatest(F.length(n), F.lit(3)), "0")), F.lit(""), told, F.lit("")]
    return plans.join(body, ["session_id", "chunk"], "left").select("session_id", "chunk", F.concat_ws("\n", *head, F.col("_body")).alias("markdown"))


def transcript_json(seg: DataFrame) -> DataFrame:
    """session_id and json: segments with dense ids, times to 3 and probabilities to 4 places; nulls left out."""
    dense = (F.row_number().over(Window.partitionBy("session_id").orderBy("seg_start", "seg_end", "id")) - 1).alias("id")
    s = seg.select("session_id", F.struct(dense, F.bround("seg_start", 3).alias("start"), F.bround("seg_end", 3).alias("end"), "text").alias("s"))
    return s.groupBy("session_id").agg(F.to_json(F.struct(F.lit(1).alias("schema_version"), F.array_sort(F.collect_list("s")).alias("segments"))).alias("json"))


def draft_markdown(sections: DataFrame, items: DataFrame) -> DataFrame:
    """session_id and markdown of sections (session_id, section, heading, ids) and items (session_id, item, text, status)."""
    bridge = sections.select("session_id", "section", "heading", F.posexplode_outer("ids").alias("place", "item"))
    call = F.when(F.col("status") == "incomplete", F.concat(F.lit("> [!question] "), escaped(F.col("text")))).otherwise(F.concat(F.lit("- "), escaped(F.col("text"))))
    lines = bridge.join(items, ["session_id", "item"], "left").withColumn("line", F.coalesce(call, F.lit("")))
    body = lines.groupBy("session_id", "section").agg(F.first("heading").alias("heading"), in_order("place", F.col("line")).alias("body"))
    return body.groupBy("session_id").agg(in_order("section", F.concat(F.lit("## "), F.col("heading"), F.lit("\n\n"), F.col("body")), "\n\n").alias("markdown"))


def export_manifest(files: DataFrame) -> DataFrame:
    """session_id, number (three digits, by case-insensitive path), name, sha256, size."""
    out = numbered(files, ["session_id"], [F.lower("path"), F.col("path")], "number", ties=[F.col("sha256")])
    n = F.col("number").cast("string")  # three digits at least: lpad would cut longer ones
    return out.select("session_id", F.lpad(n, F.greatest(F.length(n), F.lit(3)), "0").alias("number"), "path", "sha256", "size")


def manifest_json(files: DataFrame) -> DataFrame:
    return export_manifest(files).groupBy("session_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("number", "path", "sha256", "size")))).alias("manifest"))


def write_layer(df: DataFrame, root: str, layer: str) -> None:
    """An immutable layer: appended, partitioned by date where there is one; the commit protocol makes it atomic."""
    w = df.write.mode("append")
    (w.partitionBy("date") if "date" in df.columns else w).parquet(f"{root}/{layer}")
