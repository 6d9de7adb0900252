"""Operator 1, importance resampling with hashed n-gram models of target and raw text.

Unigrams and bigrams of lower-cased words are hashed to buckets. One pass counts them over all documents (the
raw model) and over the target, a bounded sample of documents that are labelled good and not toxic. A document's
log weight is the sum over its n-grams of log p_target / p_raw, both smoothed by the same prior. A second pass
scores every document and adds Gumbel noise drawn from its id; the k largest keys are a sample without
replacement by weight. k is what keeps a stated share of held-out target documents.

Null and empty texts have no n-grams and log weight 0; a null id is scored like id 0; repeated rows get the
same key, and all rows that tie with the k-th key are kept; an empty table gives no rows; without good labels
every weight is 0; columns other than the ids, the text and the labels are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

#: log2 of the buckets; the prior's n-grams a bucket; labelled documents in the target model, at most.
BITS, PRIOR, TARGET_ROWS = 20, 10.0, 50_000
#: Share of held-out target documents whose keys are above the cut; every HELD_OUT-th of the sample is held out, as
#: a document that the target model has counted scores too well.
KEEP_TARGET, HELD_OUT = 0.99, 4
BLOCK = 1 << 14
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def features(words: list[bytes], bits: int = BITS) -> np.ndarray:
    """Buckets of a text's unigrams and bigrams."""
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    return (np.concatenate([h * _A, (h[:-1] * _A) ^ (h[1:] * _B)]) >> np.uint64(64 - bits)).astype(np.int64)


def _texts(column: pa.Array) -> Iterator[list[bytes]]:
    for x in column:
        yield x.as_buffer().to_pybytes().lower().split() if x.is_valid else []


def _chunks(column: pa.Array, bits: int, most: int = 1 << 21) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, buckets of several texts in a row, buckets of each text)."""
    first, held, n = 0, [], 0
    for k, words in enumerate(_texts(column)):
        held.append(features(words, bits))
        n += len(held[-1])
        if n >= most or k + 1 == len(column):
            yield first, np.concatenate(held), np.array([len(x) for x in held])
            first, held, n = k + 1, [], 0


def count(docs: DataFrame, target_ids: np.ndarray, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Bucket counts of all documents and of the target's, summed in two steps from a row for each task and block."""
    ids, block = docs.sparkSession.sparkContext.broadcast(np.sort(target_ids)), min(BLOCK, 1 << bits)

    def tally(batches):
        raw, own = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        some = False
        for b in batches:
            is_target = np.isin(b.column(0).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), ids.value)
            for first, found, sizes in _chunks(b.column(1), bits):
                some = True
                raw += np.bincount(found, minlength=1 << bits)
                of = np.repeat(is_target[first : first + len(sizes)], sizes)
                if of.any():
                    own += np.bincount(found[of], minlength=1 << bits)
        if some:
            salt = TaskContext.get().partitionId() % 64
            for i in range(0, 1 << bits, block):
                yield _row(i, salt, raw[i : i + block], own[i : i + block])

    def _row(first, salt, raw, own):
        return pa.RecordBatch.from_arrays([pa.array([first], pa.int32()), pa.array([salt], pa.int32()), *(pa.array([zlib.compress(x.tobytes(), 1)], pa.binary()) for x in (raw, own))], ["block", "salt", "raw", "own"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, own = np.zeros(block, np.int64), np.zeros(block, np.int64)
        for b in batches:
            for r, t in zip(b.column("raw"), b.column("own"), strict=True):
                raw += np.frombuffer(zlib.decompress(r.as_py()), np.int64)
                own += np.frombuffer(zlib.decompress(t.as_py()), np.int64)
        yield _row(key[0].as_py(), key[1].as_py() if len(key) > 1 else 0, raw, own)

    schema = "block int, salt int, raw binary, own binary"
    parts = docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(tally, schema)
    for keys in (["block", "salt"], ["block"]):
        parts = parts.groupBy(*keys).applyInArrow(add, schema)
    raw, own = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
    for r in parts.collect():  # (1 << bits) / block rows
        raw[r.block : r.block + block] = np.frombuffer(zlib.decompress(r.raw), np.int64)
        own[r.block : r.block + block] = np.frombuffer(zlib.decompress(r.own), np.int64)
    return raw, own


def log_ratios(raw: np.ndarray, own: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    if not own.sum():
        return np.zeros(len(raw), np.float32)
    expected = raw * (own.sum() / raw.sum())
    return np.log((own + prior) / (expected + prior)).astype(np.float32)


def gumbel(ids: np.ndarray, seed: int = 0) -> np.ndarray:
    """Standard Gumbel noise, a function of the id: splitmix64 to a uniform."""
    z = ids.astype(np.int64).view(np.uint64) + np.uint64(seed) + _A
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64)
    return -np.log(-np.log((u + 0.5) / (1 << 53)))


def score(docs: DataFrame, ratios: np.ndarray, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, log_weight and key."""
    shared, bits = docs.sparkSession.sparkContext.broadcast(ratios), int(np.log2(len(ratios)))

    def rows(batches):
        for b in batches:
            weight = np.zeros(len(b.column(0)))
            for first, found, sizes in _chunks(b.column(1), bits):
                ends = np.concatenate([[0], np.cumsum(shared.value[found], dtype=np.float64)])
                at = np.concatenate([[0], np.cumsum(sizes)])
                weight[first : first + len(sizes)] = ends[at[1:]] - ends[at[:-1]]
            weight = np.round(weight, 6)
            key = weight + gumbel(b.column(0).fill_null(0).to_numpy(zero_copy_only=False), seed)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(weight), pa.array(key)], [id_col, "log_weight", "key"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(rows, f"{id_col} long, log_weight double, key double")


def kth_largest(scored: DataFrame, k: int, col: str = "key") -> float | None:
    """The k-th largest value, exactly: counts over 65536 buckets, then over those of the bucket that holds it."""
    if k <= 0:
        return None
    e = scored.agg(F.min(col), F.max(col), F.count(col)).collect()[0]
    if not e[2]:
        return None
    lo, hi = e[0], e[1]
    if k >= e[2]:
        return lo
    for _ in range(12):
        width = (hi - lo) / 65536
        if not width or lo + width == lo:
            break
        at = F.least(F.lit(65535), F.floor((F.col(col) - lo) / width)).alias("b")
        rows = scored.where((F.col(col) >= lo) & (F.col(col) <= hi)).groupBy(at).agg(F.count("*").alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi")).collect()
        above = scored.where(F.col(col) > hi).count()
        for b in sorted(rows, key=lambda r: -r.b):
            if above + b.n >= k:
                lo, hi = b.lo, b.hi
                break
            above += b.n
        if lo == hi:
            break
    return lo


def resample(docs: DataFrame, labels: DataFrame, keep_target: float = KEEP_TARGET, k: int | None = None, seed: int = 0) -> DataFrame:
    """doc_id, log_weight, key and kept, for every document. k: rows to sample, else as keep_target has it."""
    good = labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    target = np.array([r[0] for r in good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TARGET_ROWS).collect()], np.int64)
    held = np.arange(len(target)) % HELD_OUT == 0
    scored = materialize(score(docs, log_ratios(*count(docs, target[~held])), seed), "scored")
    if k is None:
        ids = docs.sparkSession.createDataFrame([(int(x),) for x in target[held]], "doc_id long")
        own = scored.join(F.broadcast(ids), "doc_id", "left_semi")  # at most TARGET_ROWS / HELD_OUT ids
        cut = own.agg(F.percentile("key", 1 - keep_target)).collect()[0][0]
        k = scored.where(F.col("key") >= cut).count() if cut is not None else scored.count()
    cut = kth_largest(scored, k)
    return scored.withColumn("kept", F.lit(False) if cut is None else F.col("key") >= cut)


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
