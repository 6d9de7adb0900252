"""Anomaly detection and repair decisions over transcript segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronotext.config import RepairConfig
from chronotext.functions import text as T

from .sequence import interval_join, islands, runs


def measures(df: DataFrame, text: str = "text", seconds: Column | None = None, terms: list[str] = (), cfg: RepairConfig = RepairConfig()) -> DataFrame:
    """All text measures, score, reasons and suspicious of each row. What takes a text's characters one by one, and the echo, are one Arrow pass."""
    out = df.withColumn("key", T.normalized(F.col(text))).withColumn("n_chars", F.length("key")).withColumn("n_bytes", F.octet_length("key"))
    echo = T.prompt_echo(list(terms))("key") if terms else F.struct(F.lit(0).alias("terms"), F.lit(0.0).alias("coverage"))
    out = out.withColumns({"p": T.profile("key"), "echo": echo})
    out = out.withColumn("ratio", F.col("n_bytes") / F.greatest(F.lit(1), "p.deflated"))
    out = out.withColumn("unique_ratio", F.col("p.distinct") / F.greatest(F.lit(1), "n_chars"))
    out = out.withColumn("repeat_ratio", F.col("p.repeated") / F.greatest(F.lit(1), "p.grams"))
    out = out.withColumn("run", T.longest_run(F.col(text), F.col("p.run")))
    seconds = F.lit(None).cast("double") if seconds is None else seconds
    a = T.anomaly(F.col("n_chars"), F.col("n_bytes"), F.col("ratio"), F.col("unique_ratio"), F.col("repeat_ratio"), F.col("run"), seconds, F.col("echo.terms"), F.col("echo.coverage"), cfg)
    return out.withColumn("a", a).select("*", F.col("a.score").alias("score"), F.col("a.reasons").alias("reasons"), F.col("a.suspicious").alias("suspicious")).drop("a", "p", "echo")


def native_reasons(seg: DataFrame, cfg: RepairConfig = RepairConfig()) -> DataFrame:
    """The reasons that need no compression: diversity, n-grams and density."""
    key = T.normalized(F.col("text"))
    out = seg.withColumn("key", key).withColumn("n", F.length("key")).withColumns({"d": T.distinct_characters("key"), "g": T.ngram_counts("key")})
    long, seconds = F.octet_length("key") >= cfg.min_text_bytes, F.col("seg_end") - F.col("seg_start")
    named = (
        ("low_character_diversity", long & (F.col("d") / F.greatest(F.lit(1), "n") <= cfg.unique_char_ratio_threshold)),
        ("low_text_density", (seconds >= cfg.sparse_segment_min_seconds) & (F.col("n") / seconds <= cfg.sparse_segment_max_chars_per_second)),
        ("repeated_ngrams", long & (F.col("g.repeated") / F.greatest(F.lit(1), "g.total") >= cfg.repeated_ngram_ratio_threshold)),
    )
    return out.withColumn("reasons", F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in named)), lambda x: x.isNotNull())).drop("d", "g", "n")


def candidates(seg: DataFrame, duration: DataFrame | None = None, cfg: RepairConfig = RepairConfig()) -> DataFrame:
    """Suspicious spans with padded windows: single rows with a reason, and runs of equal neighbours. duration: of the
    sessions, else their last end."""
    flagged = native_reasons(seg, cfg)
    all_ = Window.partitionBy("session_id")
    flagged = flagged.withColumn("duration", F.max("seg_end").over(all_)) if duration is None else flagged.join(duration, "session_id")
    pad = cfg.padding_seconds
    flagged = runs(flagged, ["session_id"], "id", "key")
    long = (F.col("key") != "") & (F.col("run_length") >= cfg.longest_run_threshold)
    # one list a run, where its rows already stand together
    rows = F.array_sort(F.collect_list(F.struct("id", "seg_start", "seg_end", "reasons"))).alias("rows")
    flagged = flagged.withColumn("long", long).where("long OR size(reasons) > 0").groupBy("session_id", "run").agg(rows, F.first("duration").alias("duration"), F.first("long").alias("long"))

    def span(lo, hi, ids, reasons):
        return F.struct(lo.alias("seg_start"), hi.alias("seg_end"), F.greatest(F.lit(0.0), lo - pad).alias("window_start"), F.least("duration", hi + pad).alias("window_end"), ids.alias("ids"), reasons.alias("reasons"))

    every = lambda name: F.transform("rows", lambda x: x[name])
    singles = F.transform(F.filter("rows", lambda x: F.size(x["reasons"]) > 0), lambda x: span(x["seg_start"], x["seg_end"], F.array(x["id"]), x["reasons"]))
    cross = F.array_sort(F.array_distinct(F.concat(F.flatten(every("reasons")), F.array(F.lit("cross_segment_repetition")))))
    group = F.when(F.col("long"), F.array(span(F.array_min(every("seg_start")), F.array_max(every("seg_end")), every("id"), cross)))
    return flagged.select("session_id", F.explode(F.concat(singles, F.coalesce(group, F.array()))).alias("c")).select("session_id", "c.*")


def union_windows(spans: DataFrame) -> DataFrame:
    """Regions: overlapping or touching windows become one, with the union of ids and reasons, numbered from 0."""
    grouped = islands(spans, ["session_id"], ("window_start", "window_end"), "region_id").groupBy("session_id", "region_id")
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return grouped.agg(F.min("seg_start").alias("seg_start"), F.max("seg_end").alias("seg_end"), F.min("window_start").alias("window_start"), F.max("window_end").alias("window_end"), union("ids"), union("reasons"))


def window_text(seg: DataFrame, regions: DataFrame) -> DataFrame:
    """Text and seconds of all segments that overlap a region's window, in order."""
    hit = interval_join(seg.select("session_id", "id", "seg_start", "seg_end", "text"), regions.select("session_id", "region_id", "window_start", "window_end"), ["session_id"], ("seg_start", "seg_end"), ("window_start", "window_end"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "text"))), lambda x: x["text"]), " ")
    return hit.groupBy("session_id", "region_id").agg(joined.alias("text"), (F.max("seg_end") - F.min("seg_start")).alias("seconds"), F.count("*").alias("n_segments"))


def decision(before: str, after: str, cfg: RepairConfig = RepairConfig()) -> Column:
    """struct(accepted, reason, improvement) of structs with n_chars, score and suspicious."""
    b, a = (lambda f: F.col(f"{before}.{f}")), (lambda f: F.col(f"{after}.{f}"))
    gain = F.when(b("score") <= 0, F.when(a("suspicious"), 0.0).otherwise(1.0)).otherwise((b("score") - a("score")) / b("score"))
    out = lambda ok, why, g: F.struct(F.lit(ok).alias("accepted"), F.lit(why).alias("reason"), g.cast("double").alias("improvement"))
    return (
        F.when(a("n_chars") == 0, out(False, "replacement_empty", F.lit(0.0)))
        .when(a("n_chars") / F.greatest(F.lit(1), b("n_chars")) < cfg.min_length_ratio, out(False, "replacement_too_short", F.lit(0.0)))
        .when(a("score") > b("score") + 1e-9, out(False, "anomaly_score_worse", F.lit(0.0)))
        .when(~a("suspicious") & b("suspicious"), out(True, "suspicion_cleared", gain))
        .when(gain >= cfg.min_improvement_ratio, out(True, "anomaly_score_improved", gain))
        .otherwise(out(False, "insufficient_improvement", gain))
    )


def veto(accepted: Column, after: Column, before: Column, region: Column) -> Column:
    """Whether an accepted repair stays: it may bring no reason that neither its window nor its region had."""
    return accepted & (F.size(F.array_except(after, F.array_union(before, region))) == 0)


def strategy(reasons: Column, has_terms: Column) -> Column:
    return F.when(F.array_contains(reasons, "low_text_density"), "sparse_recovery_no_hotwords_no_vad").when(F.array_contains(reasons, "prompt_echo"), "prompt_echo_recovery_no_hotwords").when(has_terms, "default_hotwords").otherwise("default_no_hotwords")


def placeholder_runs(seg: DataFrame, least: int = 6, longest: int = 4, seconds: float = 5.0) -> DataFrame:
    """dropped: rows of runs of short equal texts (the trimmed, lower-cased text), all of at most some seconds."""
    r = runs(seg.withColumn("word", F.lower(F.trim("text"))), ["session_id"], "id", "word", empty_extends=True)
    short = F.min((F.col("seg_end") - F.col("seg_start") <= seconds).cast("int")).over(Window.partitionBy("session_id", "run")) == 1
    return r.withColumn("dropped", (F.length("word") <= longest) & (F.col("run_length") >= max(2, least)) & short)


def disjoint_violations(windows: DataFrame) -> DataFrame:
    """Accepted windows that start before the one before has ended."""
    nxt = F.lead("window_start").over(Window.partitionBy("session_id").orderBy("window_start", "region_id"))
    return windows.withColumn("next_start", nxt).where("next_start < window_end").select("session_id", F.col("region_id").alias("item_id"), F.lit("windows_overlap").alias("rule"))


def summary(regions: DataFrame) -> DataFrame:
    """Per session: regions, accepted, rejected, seconds and highest score before and after."""
    return regions.groupBy("session_id").agg(
        F.count("*").alias("n_regions"),
        F.count_if("accepted").alias("n_accepted"),
        F.count_if(~F.col("accepted")).alias("n_rejected"),
        F.sum(F.col("seg_end") - F.col("seg_start")).alias("seconds_before"),
        F.sum(F.when(F.col("accepted"), 0.0).otherwise(F.col("seg_end") - F.col("seg_start"))).alias("seconds_after"),
    )


def suspicious(seg: DataFrame, terms: list[str] = (), cfg: RepairConfig = RepairConfig()) -> DataFrame:
    """session_id, id, seg_start, seg_end, ratio of segments, and whether they are suspicious: by their own measures, or in a long run of equal ones."""
    m = measures(seg, seconds=F.col("seg_end") - F.col("seg_start"), terms=terms, cfg=cfg)
    r = runs(m, ["session_id"], "id", "key")
    long = (F.col("key") != "") & (F.col("run_length") >= cfg.longest_run_threshold)
    return r.select("session_id", "id", "seg_start", "seg_end", "ratio", (F.col("suspicious") | long).alias("suspicious"))


def repair_summary(before: DataFrame, after: DataFrame, history: DataFrame, terms: list[str] = (), cfg: RepairConfig = RepairConfig()) -> DataFrame:
    """Per session of history what a repair did. before, after: session_id, id, seg_start, seg_end, text; history: session_id, region_id, ids (of segments
    before), accepted, asr_seconds.

    regions_detected (segments), windows, accepted, rejected, suspicious_before and suspicious_after (seconds of the segments named in history, and of those that are
    suspicious still), compression_before and compression_after (the highest of a segment), segments_before, segments_after, asr_seconds."""
    per = history.groupBy("session_id").agg(F.count("*").alias("windows"), F.count_if(F.coalesce("accepted", F.lit(False))).alias("accepted"), F.round(F.sum(F.coalesce("asr_seconds", F.lit(0.0))), 2).alias("asr_seconds"))
    per = per.withColumn("rejected", F.col("windows") - F.col("accepted"))
    named = history.select("session_id", F.explode("ids").alias("id")).distinct()
    seconds = lambda c: F.round(F.coalesce(F.sum(F.when(c, F.greatest(F.lit(0.0), F.col("seg_end") - F.col("seg_start")))), F.lit(0.0)), 3)
    n_named = named.groupBy("session_id").agg(F.count("*").alias("regions_detected"))
    old = suspicious(before, terms, cfg).join(named.withColumn("_named", F.lit(True)), ["session_id", "id"], "left")
    old = old.groupBy("session_id").agg(seconds(F.coalesce("_named", F.lit(False))).alias("suspicious_before"), F.round(F.max("ratio"), 4).alias("compression_before"), F.count("*").alias("segments_before"))
    new = suspicious(after, terms, cfg).groupBy("session_id").agg(seconds(F.col("suspicious")).alias("suspicious_after"), F.round(F.max("ratio"), 4).alias("compression_after"), F.count("*").alias("segments_after"))
    out = per.join(n_named, "session_id", "left").join(old, "session_id", "left").join(new, "session_id", "left")
    return out.fillna(0, ["regions_detected", "segments_before", "segments_after"]).fillna(0.0, ["suspicious_before", "suspicious_after", "compression_before", "compression_after"])
