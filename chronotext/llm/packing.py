"""Operator 7, best-fit packing by patterns: non-negative least squares on the histogram of piece lengths.

Only two things leave the executors: a histogram of at most ``max_tokens`` lengths, and one row per piece.
The driver enumerates patterns of a few lengths that (almost) fill a sequence, fits how often each is used to
the histogram, rounds down, and packs the residual histogram largest-first into whatever gap fits best.
All of it is done on counts, so its cost does not depend on the number of documents.

Null texts are empty documents (one end id); rows with a null or repeated id are packed like any other; an
empty table gives no rows; columns other than the id and the text are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import located, materialize, table
from .tokens import BATCH_BYTES, Encoder, default_vocabulary

MAX_TOKENS = 2048
END_ID = 0
#: Patterns given to the fit, and its iterations.
MAX_PATTERNS = 12_000
ITERATIONS = 400
#: Patterns leave at most this share of a sequence empty.
MAX_WASTE = 0.004


def pieces(docs: DataFrame, vocabulary: str, max_tokens: int = MAX_TOKENS, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", most: int = BATCH_BYTES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: only documents of more than max_tokens ids are cut, the remainder first."""

    def cut(batches):
        with Encoder.task(vocabulary) as encoder:
            for b in batches:
                ids, text = b.column(0), b.column(1)
                for first, tokens, off in encoder.batches(text, most):
                    n_docs = len(off) - 1
                    n = np.diff(off) + 1
                    own = np.insert(tokens, off[1:], np.int32(end_id)).astype("<u4")
                    many = -(-n // max_tokens)
                    doc = np.repeat(np.arange(n_docs), many)
                    piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
                    head = (n - (many - 1) * max_tokens)[doc]  # the first piece may be shorter
                    start = np.where(piece, head + (piece - 1) * max_tokens, 0)
                    length = np.where(piece, max_tokens, head)
                    at = (np.cumsum(n) - n)[doc] + start
                    crc = np.fromiter((zlib.crc32(own[i:j]) for i, j in zip(at.tolist(), (at + length).tolist(), strict=True)), np.int64, len(doc))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(first + doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def patterns(lengths: list[int], cap: int, most: int = MAX_PATTERNS, waste: float = MAX_WASTE) -> list[tuple[int, ...]]:
    """Multisets of up to five lengths whose sum is at least (1 - waste) * cap: each length with partners spread
    over the histogram, the last partner being the longest that fits."""
    found: dict[tuple[int, ...], None] = {}
    spread = [lengths[int(q * (len(lengths) - 1))] for q in (0.01, 0.05, 0.1, 0.17, 0.25, 0.33, 0.42, 0.5, 0.6, 0.7, 0.8)]

    def close(given: tuple[int, ...]) -> None:
        gap = cap - sum(given)
        if gap and gap >= lengths[0]:
            given, gap = (*given, (b := lengths[bisect_right(lengths, gap) - 1])), gap - b
        if 0 <= gap <= waste * cap:
            found[tuple(sorted(given))] = None

    steps = [[(a,) for a in lengths]]
    for depth in range(4):
        for given in steps[-1]:
            if len(found) >= most * (depth + 1) // 4:
                break
            close(given)
        seeds = steps[-1][:: max(1, len(steps[-1]) // 1500)]
        steps.append([(*g, s) for g in seeds for s in dict.fromkeys(spread) if sum(g) + s < cap])
    return list(found)


def fit(histogram: dict[int, int], cap: int, columns: list[tuple[int, ...]]) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |Ax - h|: multiplicative updates, A given by its columns' lengths."""
    h = np.zeros(cap + 1)
    h[list(histogram)] = list(histogram.values())
    slots = np.fromiter((v for c in columns for v in c), np.int64)
    of = np.repeat(np.arange(len(columns)), [len(c) for c in columns])
    size = np.bincount(of, minlength=len(columns))
    x = np.minimum.reduceat(h[slots], np.concatenate([[0], np.cumsum(size)[:-1]])) / 4 + 1e-6
    goal = np.bincount(of, h[slots], len(columns))
    for _ in range(ITERATIONS):
        now = np.bincount(slots, x[of], cap + 1)
        x *= goal / np.maximum(np.bincount(of, now[slots], len(columns)), 1e-12)
    return x


def plan(histogram: dict[int, int], cap: int = MAX_TOKENS) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that use up the histogram exactly."""
    left = {k: int(v) for k, v in histogram.items() if v}
    out: list[tuple[tuple[int, ...], int]] = []
    if left.get(cap):
        out.append(((cap,), left.pop(cap)))
    if left and (columns := patterns(sorted(left), cap)):
        x = fit(left, cap, columns)
        for j in np.argsort(-x, kind="stable"):
            uses = Counter(columns[j])
            if (n := min(int(x[j] + 1e-6), *(left[v] // m for v, m in uses.items()))) > 0:
                out.append((tuple(sorted(columns[j], reverse=True)), n))
                for v, m in uses.items():
                    left[v] -= n * m
    there: list[int] = []
    for v in sorted(k for k, n in left.items() if n):
        insort(there, v)
    while there:
        pattern, uses, gap = [], Counter(), cap
        while (i := bisect_right(there, gap)) and gap:
            while i and left[there[i - 1]] <= uses[there[i - 1]]:
                i -= 1
            if not i:
                break
            pattern.append(v := there[i - 1])
            uses[v] += 1
            gap -= v
        n = min(left[v] // m for v, m in uses.items())
        out.append((tuple(pattern), n))
        for v, m in uses.items():
            left[v] -= n * m
            if not left[v]:
                there.remove(v)
    return out


def slots(planned: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, rank after the last, first sequence, offset): which ranks of a length go where."""
    taken: Counter = Counter()
    out, base = [], 0
    for pattern, n in planned:
        offset = 0
        for v in pattern:
            out.append((v, taken[v], taken[v] + n, base, offset))
            taken[v] += n
            offset += v
        base += n
    return out


def place(cut: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Adds sequence_id and offset. Pieces of a length are numbered file by file (a file is what one task wrote), so no task sorts more of them
    than a file holds, and rows that are alike in every column are as far apart as others."""
    spark = cut.sparkSession
    cut, at = located(cut, "pieces")
    histogram = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most max_tokens rows
    where = spark.createDataFrame(slots(plan(histogram, max_tokens)) or [], "w_length long, lo long, hi long, base long, offset long")
    ranked = cut.select("*", at["file"].alias("file"), at["row"].alias("row"))
    before = ranked.groupBy(F.col("length").alias("b_length"), F.col("file").alias("b_file")).count()
    before = before.withColumn("before", F.sum("count").over(Window.partitionBy("b_length").orderBy("b_file")) - F.col("count")).drop("count")
    inside = F.row_number().over(Window.partitionBy("file", "length").orderBy("row")) - 1
    ranked = ranked.withColumn("inside", inside).join(before, (F.col("file") == F.col("b_file")) & (F.col("length") == F.col("b_length"))).withColumn("rank", F.col("inside") + F.col("before"))
    # where has a bounded number of rows: patterns and residual steps, not documents
    placed = ranked.join(F.broadcast(where), (F.col("length") == F.col("w_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")


def pack(docs: DataFrame, vocabulary: str | None = None, max_tokens: int = MAX_TOKENS, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", most: int = BATCH_BYTES) -> DataFrame:
    """A row for each piece, with its sequence and place. A task encodes at most so many bytes of text at once."""
    return place(materialize(pieces(docs, vocabulary or default_vocabulary(), max_tokens, end_id, id_col, text_col, most), "pieces"), max_tokens)


def op7_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
