"""Operator 9, token files compressed by Re-Pair grammars with random access to documents.

Documents are dealt to partitions by ranges of their id and sorted; each partition is cut into shards. In a
shard, rounds replace frequent adjacent id pairs by new symbols (never across documents; of pairs that overlap, the more
frequent) until no pair is found often enough to pay for its rule. Pairs are counted over the whole shard once; from then on only places where a
pair is frequent, or which a replacement has changed, are counted again. The shard
stores its rules round by round, the length that each rule expands to, and where each document starts both
in the grammar's sequence and in the expanded ids, so one document, or a part of one, is decoded from its own slice.

A shard is one binary value in a file that Spark writes, so a lost task is simply run again. Null texts are
empty (only the end id); rows with a null id come first; repeated rows are all written; an empty table gives
no shard; columns other than the id and the text are not read.
"""

from __future__ import annotations

import struct
import zlib
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, table, table_path
from .tokens import Encoder, default_vocabulary

END_ID = 2
#: Ids in a shard, at least, before it is closed.
SHARD_IDS = 1 << 20
#: How often a pair must be replaced: a rule takes 16 bytes, each use of it saves 3.
LEAST = 6
MAGIC = b"RPG1"
_HASH_BITS = 20


def _slots(code: np.ndarray) -> np.ndarray:
    return ((code * np.int64(-7046029254386353131)) >> np.int64(64 - _HASH_BITS)) & ((1 << _HASH_BITS) - 1)


def _counted(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pair codes (not negative) that are there LEAST times, sorted; how often each is there."""
    s = np.sort(code)
    edges = np.concatenate([[0], np.flatnonzero(s[1:] != s[:-1]) + 1, [len(s)]])
    counts = np.diff(edges)
    often = np.flatnonzero((counts >= LEAST) & (s[edges[:-1]] >= 0)) if len(s) else np.zeros(0, np.int64)
    return s[edges[often]], counts[often]


def _found(code: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(indices of codes that are among the sorted pairs, which pair each is)."""
    table = np.full(1 << _HASH_BITS, -1, np.int32)
    table[_slots(pairs)] = np.arange(len(pairs))
    which = table.take(_slots(code))
    near = np.flatnonzero(which >= 0)
    which, own = which.take(near), code.take(near)
    off = np.flatnonzero(pairs.take(which) != own)  # another pair of the slot, or none
    if len(off):
        which[off] = np.minimum(np.searchsorted(pairs, own[off]), len(pairs) - 1)
        wrong = off[pairs[which[off]] != own[off]]
        if len(wrong):
            same = np.ones(len(near), bool)
            same[wrong] = False
            near, which = near[same], which[same]
    return near, which


def compress(ids: np.ndarray, starts: np.ndarray, first_symbol: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(sequence, where documents start in it, rules of each round as rows left, right)."""
    n, rules, symbol = len(ids), [], first_symbol
    seq, starts = ids.astype(np.int32), starts.astype(np.int64)
    if n < 2:
        return seq, starts, rules
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    alone, gone = np.zeros(n, bool), np.zeros(n, bool)  # begins no pair; is the right half of a replaced one
    alone[starts[1:] - 1] = alone[-1] = True
    place = np.flatnonzero(~alone)
    while True:
        left, right = seq.take(place), seq.take(after.take(place))
        code = (left.astype(np.int64) << 32) | right
        # in a run of one id only every second pair can be replaced
        alike = np.flatnonzero(left == right)
        if len(alike):
            new = np.concatenate([[True], after[place[alike[:-1]]] != place[alike[1:]]])
            run_at = np.maximum.accumulate(np.where(new, np.arange(len(alike)), 0))
            code[alike[((np.arange(len(alike)) - run_at) & 1) == 1]] = -1
        pairs, counts = _counted(code)
        if not len(pairs):
            break
        near, rule = _found(code, pairs)
        hit = place = place.take(near)
        rank = np.empty(len(pairs), np.int32)
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(pairs))
        # of pairs that overlap the more frequent are replaced, so the most frequent of all gives way to none
        worth = rank.take(rule)
        apart = np.concatenate([[True], after.take(hit[:-1]) != hit[1:], [True]])
        better = worth[1:] < worth[:-1]
        win = (apart[:-1] | np.concatenate([[False], better])) & (apart[1:] | np.concatenate([~better, [False]]))
        hit, rule = hit[win], rule[win]
        # a pair that overlaps others may be left too few places for its rule to pay
        pays = np.bincount(rule, minlength=len(pairs)) >= LEAST
        own = pays[rule]
        hit, rule, pairs = hit[own], (np.cumsum(pays) - 1)[rule[own]], pairs[pays]
        rules.append(np.stack([pairs >> 32, pairs & 0xFFFFFFFF], 1).astype(np.int32))
        right = after[hit]
        far = after[right]
        seq[hit] = symbol + rule
        symbol += len(pairs)
        alone[hit], alone[right], gone[right] = alone[right], True, True
        after[hit] = far
        inside = far < n
        before[far[inside]] = hit[inside]
        left = before[hit]
        more = np.concatenate([place, hit, left[left >= 0]])
        if len(more) > n // 16:
            mark = np.zeros(n, bool)
            mark[more] = True
            mark[alone] = False
            place = np.flatnonzero(mark)
        else:
            more.sort()
            place = more[np.concatenate([[True], more[1:] != more[:-1]]) & ~alone[more]]
    kept = ~gone
    return seq[kept], (np.cumsum(kept) - kept)[starts], rules


class Grammar:
    """Expands symbols. The stored lengths say where each rule's ids stand in one table of all rules' expansions."""

    def __init__(self, rules: list[np.ndarray], lengths: np.ndarray, first_symbol: int):
        self.first, self.rules = first_symbol, np.concatenate([np.zeros((0, 2), np.int32), *rules])
        self.lens = np.concatenate([np.ones(first_symbol, np.int64), lengths])
        self.at = np.concatenate([np.arange(first_symbol), first_symbol + np.cumsum(lengths) - lengths]).astype(np.int64)
        self.ids = np.zeros(first_symbol + int(lengths.sum()), np.int32)
        self.ids[:first_symbol] = np.arange(first_symbol)
        done = 0
        for rows in rules:
            a = self.at[first_symbol + done]
            out = self.expand(rows.ravel())
            self.ids[a : a + len(out)] = out
            done += len(rows)

    def expand(self, seq: np.ndarray) -> np.ndarray:
        lens = self.lens[seq]
        ends = np.cumsum(lens)
        return self.ids[np.repeat(self.at[seq] - (ends - lens), lens) + np.arange(ends[-1] if len(ends) else 0)]


def expand(seq: np.ndarray, rules: list[np.ndarray], first_symbol: int) -> np.ndarray:
    return Grammar(rules, rule_lengths(rules, first_symbol), first_symbol).expand(seq)


def rule_lengths(rules: list[np.ndarray], first_symbol: int) -> np.ndarray:
    sizes = np.ones(first_symbol, np.int64)
    for rows in rules:
        sizes = np.concatenate([sizes, sizes[rows[:, 0]] + sizes[rows[:, 1]]])
    return sizes[first_symbol:]


def pack_shard(doc_ids: list, ids: np.ndarray, starts: np.ndarray, first_symbol: int) -> bytes:
    """A shard's bytes: header, then document ids, both start tables, rules, their lengths, and the sequence."""
    seq, at, rules = compress(ids, starts, first_symbol)
    null = np.array([x is None for x in doc_ids], np.uint8)
    known = np.array([0 if x is None else x for x in doc_ids], np.int64)
    parts = [null, known, at.astype(np.int64), starts.astype(np.int64), *rules, rule_lengths(rules, first_symbol), (seq & 0xFFFF).astype(np.uint16), (seq >> 16).astype(np.uint8)]
    body = b"".join(np.ascontiguousarray(x).tobytes() for x in parts)
    head = struct.pack("<IIIQQ", first_symbol, len(rules), len(doc_ids), len(ids), len(seq)) + struct.pack(f"<{len(rules)}I", *map(len, rules))
    return MAGIC + head + struct.pack("<I", zlib.crc32(body)) + body


class Shard:
    """Reads pack_shard's bytes; document(k) decodes one document without the others, slice(k, a, b) a part of it."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a shard")
        self.first, n_rounds, self.n_docs, self.n_ids, n_seq = struct.unpack_from("<IIIQQ", data, 4)
        at = 4 + struct.calcsize("<IIIQQ")
        sizes = struct.unpack_from(f"<{n_rounds}I", data, at)
        at += 4 * n_rounds
        (crc,) = struct.unpack_from("<I", data, at)
        at += 4
        if zlib.crc32(data[at:]) != crc:
            raise ValueError("shard is damaged")

        def take(kind, n):
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        null, known = take(np.uint8, self.n_docs), take(np.int64, self.n_docs)
        self.doc_ids = [None if z else int(x) for z, x in zip(null, known, strict=True)]
        self.at, self.starts = take(np.int64, self.n_docs), take(np.int64, self.n_docs)
        self.rules = [take(np.int32, 2 * n).reshape(-1, 2) for n in sizes]
        self.lengths = take(np.int64, sum(sizes))
        low, high = take(np.uint16, n_seq), take(np.uint8, n_seq)
        self.seq = low.astype(np.int32) | (high.astype(np.int32) << 16)

    @cached_property
    def grammar(self) -> Grammar:
        return Grammar(self.rules, self.lengths, self.first)

    def _own(self, k: int) -> np.ndarray:
        return self.seq[self.at[k] : self.at[k + 1] if k + 1 < self.n_docs else len(self.seq)]

    def all(self) -> np.ndarray:
        return self.grammar.expand(self.seq)

    def document(self, k: int) -> np.ndarray:
        return self.grammar.expand(self._own(k))

    def slice(self, k: int, a: int, b: int) -> list[int]:
        """Ids a to b of document k: the stored lengths lead to the symbols at both ends, and down their rules; nothing outside is expanded."""
        own, rules, out = self._own(k), np.concatenate([np.zeros((0, 2), np.int32), *self.rules]), []
        length = lambda s: 1 if s < self.first else int(self.lengths[s - self.first])
        ends = np.cumsum([length(s) for s in own.tolist()])
        i, j = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(ends, b, "left")) + 1
        stack = [(s, int(e) - length(s)) for s, e in zip(own[i:j].tolist(), ends[i:j], strict=True)][::-1]
        while stack:
            s, at = stack.pop()
            if at >= b or at + length(s) <= a:
                continue
            if s < self.first:
                out.append(s)
            else:
                left, right = rules[s - self.first].tolist()
                stack += [(right, at + length(left)), (left, at)]
        return out


def write_shards(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes part, shard, n_docs, n_ids, data in ascending id order: parts are ranges, shards cut a part."""
    vocabulary = vocabulary or default_vocabulary()

    def shards(batches):
        with Encoder.task(vocabulary) as encoder:
            yield from packed(batches, encoder)

    def packed(batches, encoder):
        part, shard = TaskContext.get().partitionId(), 0
        first = len(encoder.id_bytes)
        held: list[tuple[list, np.ndarray, np.ndarray]] = []

        def close():
            ids = np.concatenate([x[1] for x in held])
            lens = np.concatenate([x[2] for x in held])
            data = pack_shard([d for x in held for d in x[0]], ids, np.cumsum(lens) - lens, first)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([len(lens)], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([data], pa.binary())], ["part", "shard", "n_docs", "n_ids", "data"])

        for b in batches:
            for row, tokens, off in encoder.batches(b.column(1)):
                n = len(off) - 1
                lens = np.diff(off) + 1
                ids = np.insert(tokens, off[1:], end_id)
                ends, k = np.cumsum(lens), 0
                while k < n:  # whole documents up to the shard's size
                    room = max(1, SHARD_IDS - sum(len(x[1]) for x in held))
                    done = ends[k - 1] if k else 0
                    j = min(n, int(np.searchsorted(ends, done + room, "left")) + 1)
                    held.append((b.column(0).slice(row + k, j - k).to_pylist(), ids[done : ends[j - 1]], lens[k:j]))
                    k = j
                    if sum(len(x[1]) for x in held) >= SHARD_IDS:
                        yield close()
                        held, shard = [], shard + 1
        if held:
            yield close()

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # the text's hash parts rows of one id, were it a hot one
    dealt = own.repartitionByRange(shuffle_partitions(docs.sparkSession), F.col("id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text"))
    dealt.mapInArrow(shards, "part int, shard int, n_docs long, n_ids long, data binary").write.parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files; start counts the ids of all documents before it."""
    files = spark.read.parquet(path)

    def decode(batches):
        for b in batches:
            for part, shard, data in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                s = Shard(data)
                ids = s.all().astype("<u4")
                ends = np.append(s.starts[1:], s.n_ids)
                crc = [zlib.crc32(ids[i:j]) for i, j in zip(s.starts, ends, strict=True)]
                n = s.n_docs
                yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([shard] * n, pa.int32()), pa.array(s.doc_ids, pa.int64()), pa.array(s.starts, pa.int64()), pa.array(ends - s.starts, pa.int64()), pa.array(crc, pa.int64())], ["part", "shard", "doc_id", "own", "n_tokens", "ids_crc32"])

    rows = files.select("part", "shard", "data").mapInArrow(decode, "part int, shard int, doc_id long, own long, n_tokens long, ids_crc32 long")
    sizes = files.select("part", "shard", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("total"))  # as many rows as write tasks
    parts = parts.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("part_start"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_ids")
    starts = sizes.select("part", "shard", inside.alias("inside")).join(parts, "part").select("part", "shard", (F.col("part_start") + F.col("inside")).alias("base"))
    return rows.join(starts, ["part", "shard"]).select("doc_id", (F.col("base") + F.col("own")).alias("start"), "n_tokens", "ids_crc32")


def op9_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = table_path(spark, "tokens")
    write_shards(table(spark, sf_dir, "documents"), path)
    return read_shards(spark, path)
