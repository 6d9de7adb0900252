"""Incremental recomputation: fingerprints, reuse, caches, promotion, step logs, and what is stale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import upsert


def fingerprint(*columns: Column | str) -> Column:
    """SHA-256 of the columns as JSON in the order of their names."""
    named = sorted((c if isinstance(c, str) else c._jc.toString(), F.col(c) if isinstance(c, str) else c) for c in columns)
    return F.sha2(F.to_json(F.struct(*(c.alias(n) for n, c in named)), {"ignoreNullFields": "false"}), 256)


def canonical_json(text: Column) -> Column:
    """The JSON document with its keys sorted at every depth and nothing between its parts: a VARIANT keeps an object's fields in the order of their
    names. Equal to json.dumps(..., sort_keys=True, separators=(",", ":"), ensure_ascii=False), but for numbers with a fraction or exponent: a fraction
    of zeros goes (1.0 is 1), powers of ten are written as Spark writes doubles. Names are ordered as UTF-16. Null for what is no JSON, and
    for objects that repeat a name."""
    return F.to_json(F.try_parse_json(text))


def document_fingerprint(text: Column) -> Column:
    """SHA-256 of the canonical form: documents that differ in the order of keys or in white space have the same."""
    return F.sha2(canonical_json(text), 256)


def cache_key(print_: Column, stage: str, index: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", print_, F.lit(stage), index.cast("string"), text), 256)


def batch_id(keys: Column) -> Column:
    """web- and 16 hex digits of the sorted task keys: equal tasks make the same package."""
    return F.concat(F.lit("web-"), F.left(F.sha2(F.array_join(F.array_sort(keys), ","), 256), F.lit(16)))


def pending(work: DataFrame, done: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
    """Work whose keys (session, layer, fingerprint, source hash) no output has; all of it if forced."""
    return work if force else work.join(done.select(*keys).distinct(), keys, "left_anti")


def with_cache(units: DataFrame, cache: DataFrame, compute, key: str = "cache_key") -> DataFrame:
    """Cached results, and compute() over the misses only."""
    hit = units.join(cache.select(key, "response"), key)
    miss = units.join(cache.select(key), key, "left_anti")
    return hit.withColumn("cached", F.lit(True)).unionByName(compute(miss).withColumn("cached", F.lit(False)))


def promoted(cache: DataFrame, canary: DataFrame, key: str = "cache_key") -> DataFrame:
    """One row a key: the cache's own, else the canary's."""
    both = cache.withColumn("_p", F.lit(0)).unionByName(canary.withColumn("_p", F.lit(1)))
    rest = [c for c in cache.columns if c != key]
    return both.groupBy(key).agg(F.min_by(F.struct(*rest), "_p").alias("r")).select(key, "r.*")


def step_status(events: DataFrame) -> DataFrame:
    """State of each step from its log: provider, model and start as last known, the rest as last reported."""
    return upsert(events, ["session_id", "step"], "seq", overwrite=["status", "finished_at", "elapsed_sec", "error"], keep_known=["provider", "model", "started_at"])


def restored_state(state: Column, failed_from: Column) -> Column:
    return F.when(state == "FAILED", F.coalesce(failed_from, F.lit("AUDIO_READY"))).otherwise(state)


def stale_outputs(outputs: DataFrame, current: DataFrame) -> DataFrame:
    """Derived outputs whose fingerprint isn't the session's present one; raw ones never are."""
    return outputs.where("layer <> 'raw'").join(current, ["session_id", "layer", "fingerprint"], "left_anti")


def rebuild_needed(now: DataFrame, manifest: DataFrame) -> DataFrame:
    """session_id and rebuild: whether its files (path, sha256) differ from its manifest's."""
    a = now.select("session_id", "path", "sha256", F.lit(1).alias("a")).distinct()
    b = manifest.select("session_id", "path", "sha256", F.lit(1).alias("b")).distinct()
    return a.join(b, ["session_id", "path", "sha256"], "full").groupBy("session_id").agg((F.count_if(F.col("a").isNull() | F.col("b").isNull()) > 0).alias("rebuild"))


TOKENS = ("input_tokens", "output_tokens", "total_tokens", "input_chars", "output_chars", "web_turns")


def usage(records: DataFrame, cloud: str = "openai") -> DataFrame:
    """Per session what its model calls took. records: session_id, stage, llm_called, cache_hit, provider, attempt_count, failed_attempts and the TOKENS columns.
    Calls are chunks and boundaries for which a model was asked; sums are over those that no cache answered."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    calls = records.where((F.col("stage") == "chunk") | flag("llm_called")).withColumn("_real", ~flag("cache_hit"))
    real = lambda c: F.sum(F.when(F.col("_real"), F.coalesce(c, F.lit(0))).otherwise(0)).cast("long")
    sums = [real(F.col(c).cast("long")).alias(c) for c in TOKENS]
    attempts = F.coalesce(F.nullif("attempt_count", F.lit(0)), F.lit(1))
    out = calls.groupBy("session_id").agg(*sums, F.count_if("_real").alias("llm_calls"), F.count_if(F.col("_real") & (F.col("provider") == cloud)).alias("api_calls"), F.count_if(~F.col("_real")).alias("cache_hits"), real(attempts).alias("requests_total"), F.count_if("_real").alias("successful_requests"), real(F.col("failed_attempts")).alias("failed_requests"))
    return out.withColumn("token_usage_available", F.col("total_tokens") > 0)
