"""Operator 3, chat formatting as a prefix tree.

Conversations are put in the order of their turns, so that those which share initial turns stand together in
depth-first order, and dealt by ranges of that order: a very common first turn, or a very common conversation, is
spread over many partitions. A stream over a partition emits each new turn once; a packed sequence holds trees, or parts
of one, in depth-first order, with the position ids each turn has in its own conversation and, for each
turn, the intervals of its ancestors (adjacent ones merged), which is all that it may attend to besides itself. As a
sequence has all that its turns attend to, shared turns are repeated where a sequence ends within a tree: those of one
path for each sequence of MAX_TOKENS, and for each partition.

Turns of a conversation are ordered by turn, role and text, nulls first. Null roles and texts are empty.
Rows of a null id are one conversation; repeated rows are repeated turns; an empty table gives no sequences;
extra columns are not read. A conversation is formatted in one task and never cut.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions, table
from .tokens import Encoder, default_vocabulary

#: Tokens after which a packed sequence is closed at the end of a conversation.
MAX_TOKENS = 32_768

# Control strings of common templates; the first two are this template's own.
CONTROLS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<unk>")
START, END = CONTROLS[:2]
_PLAIN = re.compile("|".join(f"({re.escape(c[0])})(\\\\*)({re.escape(c[1:])})" for c in CONTROLS))
_MARKED = re.compile("|".join(f"({re.escape(c[0])})\\\\(\\\\*)({re.escape(c[1:])})" for c in CONTROLS))
_join = lambda m, mark: "".join((g := [x for x in m.groups() if x is not None])[:1] + [mark] + g[1:])


def escape(text: str) -> str:
    """One more backslash behind the first character of every control string, marked or not."""
    return _PLAIN.sub(lambda m: _join(m, "\\"), text)


def unescape(text: str) -> str:
    return _MARKED.sub(lambda m: _join(m, ""), text)


def header(role: str) -> str:
    return f"{START}{escape(role.replace('\\', '\\\\').replace('\n', '\\n'))}\n"


FOOTER = f"{END}\n"


def parse(piece: str) -> tuple[str, str]:
    """(role, text) of a formatted turn."""
    if not piece.startswith(START) or not piece.endswith(FOOTER):
        raise ValueError("not a formatted turn")
    role, _, text = piece[len(START) : -len(FOOTER)].partition("\n")
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role)), unescape(text)


SCHEMA = "sequence_id long, input_ids array<int>, position_ids array<int>, nodes array<struct<start:int,end:int,parent:int,loss_start:int,loss_end:int,attends:array<struct<start:int,end:int>>>>, conversations array<struct<conv_id:long,node:int>>"
_NAMES = ["sequence_id", "input_ids", "position_ids", "nodes", "conversations"]


def _ints(values) -> pa.Array:
    return pa.array(np.asarray(values, np.int32))


def _one(values: pa.Array) -> pa.Array:
    """A column of one row that is a list."""
    return pa.ListArray.from_arrays(_ints([0, len(values)]), values)


class Packer:
    """Builds packed sequences from conversations in depth-first order."""

    def __init__(self, most: int):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.ids: list[np.ndarray] = []
        self.start, self.end, self.parent, self.loss_start, self.loss_end, self.depth = [], [], [], [], [], []
        self.attends: list[list[tuple[int, int]]] = []
        self.convs: list[int | None] = []
        self.leaves: list[int] = []
        self.size = 0
        self.path: list[tuple[str, str]] = []
        self.stack: list[int] = []

    def add(self, conv_id: int | None, turns: list[tuple[str, str]], tokens: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        shared = 0
        while shared < min(len(turns), len(self.path)) and turns[shared] == self.path[shared]:
            shared += 1
        del self.path[shared:], self.stack[shared:]
        for turn, (head, text, foot) in zip(turns[shared:], tokens[shared:], strict=True):
            parent = self.stack[-1] if self.stack else -1
            depth, attends, at = 0, [], self.size + len(head)
            if parent >= 0:
                a, b, attends = self.start[parent], self.end[parent], self.attends[parent]
                depth = self.depth[parent] + b - a
                attends = [*attends[:-1], (attends[-1][0], b)] if attends and attends[-1][1] == a else [*attends, (a, b)]
            self.start.append(self.size)
            self.size += len(head) + len(text) + len(foot)
            self.end.append(self.size)
            self.parent.append(parent)
            self.depth.append(depth)
            self.loss_start.append(at)
            self.loss_end.append(at + len(text) * (turn[0] == "assistant"))
            self.attends.append(attends)
            self.ids += [head, text, foot]
            self.stack.append(len(self.start) - 1)
            self.path.append(turn)
        self.convs.append(conv_id)
        self.leaves.append(self.stack[-1])

    def full(self) -> bool:
        """Whether a sequence ends before the next conversation."""
        return self.size >= self.most or len(self.convs) >= self.most

    def close(self, sequence_id: int) -> pa.RecordBatch:
        size = np.array(self.end) - np.array(self.start)
        positions = np.arange(self.size) - np.repeat(np.array(self.start) - np.array(self.depth), size)
        flat = np.array([x for own in self.attends for x in own], np.int32).reshape(-1, 2)
        ends = np.cumsum([0, *map(len, self.attends)])
        attends = pa.ListArray.from_arrays(_ints(ends), pa.StructArray.from_arrays([_ints(flat[:, 0]), _ints(flat[:, 1])], ["start", "end"]))
        nodes = pa.StructArray.from_arrays([*(_ints(x) for x in (self.start, self.end, self.parent, self.loss_start, self.loss_end)), attends], ["start", "end", "parent", "loss_start", "loss_end", "attends"])
        convs = pa.StructArray.from_arrays([pa.array(self.convs, pa.int64()), _ints(self.leaves)], ["conv_id", "node"])
        out = [pa.array([sequence_id], pa.int64()), _one(_ints(np.concatenate(self.ids))), _one(_ints(positions)), _one(nodes), _one(convs)]
        self.clear()
        return pa.RecordBatch.from_arrays(out, _NAMES)


def format_conversations(conversations: DataFrame, vocabulary: str | None = None, most: int = MAX_TOKENS) -> DataFrame:
    """Packed sequences (SCHEMA) of conv_id, turn, role, text, written to the shared folder."""
    vocabulary = vocabulary or default_vocabulary()
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    own = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    own = own.withColumn("path", F.transform("turns", lambda t: F.xxhash64(t["role"], t["text"])))
    # the id parts equal conversations, so that a common one is not in one partition
    dealt = own.repartitionByRange(shuffle_partitions(conversations.sparkSession), "path", "conv_id").sortWithinPartitions("path", "conv_id")
    dealt = dealt.select("conv_id", F.transform("turns", lambda t: t["role"]).alias("roles"), F.transform("turns", lambda t: t["text"]).alias("texts"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Encoder.task(vocabulary) as encoder:
            yield from packed(batches, encoder)

    def packed(batches: Iterator[pa.RecordBatch], encoder: Encoder) -> Iterator[pa.RecordBatch]:
        packer, number = Packer(most), TaskContext.get().partitionId() << 32
        fixed: dict[str, np.ndarray] = {}

        def few(s: str) -> np.ndarray:
            if s not in fixed:
                if len(fixed) > 4096:
                    fixed.clear()
                fixed[s] = encoder.encode(pa.array([s]))[0]
            return fixed[s]

        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                roles, texts = part.column(1).to_pylist(), part.column(2).to_pylist()
                flat, ids = pa.array([escape(t) for own in texts for t in own], pa.string()), []
                for _, tokens, off in encoder.batches(flat):
                    ids += [tokens[i:j] for i, j in zip(off[:-1], off[1:], strict=True)]
                ids = iter(ids)
                for conv_id, rs, ts in zip(part.column(0).to_pylist(), roles, texts, strict=True):
                    tokens = [(few(header(r)), next(ids), few(FOOTER)) for r in rs]
                    if packer.full():
                        yield packer.close(number)
                        number += 1
                    packer.add(conv_id, list(zip(rs, ts, strict=True)), tokens)
        if packer.convs:
            yield packer.close(number)

    return materialize(dealt.mapInArrow(rows, SCHEMA), "chats")


def read_conversations(sequences: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, decoded from the sequences."""
    vocabulary = vocabulary or default_vocabulary()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Encoder.of(vocabulary).tokenizer
        edges: dict[tuple[int, ...], int] = {}

        def chars(own: list[int]) -> int:
            """Characters of a turn's head or foot; there are few kinds."""
            if (key := tuple(own)) not in edges:
                if len(edges) > 4096:
                    edges.clear()
                edges[key] = len(tokenizer.decode(own, skip_special_tokens=False))
            return edges[key]

        for b in batches:
            for all_ids, all_nodes, convs in zip(*(b.column(i) for i in range(3)), strict=True):
                ids, nodes, convs = all_ids.values.to_numpy().tolist(), all_nodes.values, convs.values
                start, end, parent, loss_start, loss_end = (nodes.field(i).to_pylist() for i in range(5))
                pieces = tokenizer.decode_batch([ids[i:j] for i, j in zip(start, end, strict=True)], skip_special_tokens=False)
                turns = []
                for k, piece in enumerate(pieces):  # the mask's part of a turn lies between whole characters
                    i, j = loss_start[k], loss_end[k]
                    loss = unescape(piece[chars(ids[start[k] : i]) : len(piece) - chars(ids[j : end[k]])]) if i < j else ""
                    turns.append((*parse(piece), loss, len(piece)))
                digests: dict[int, tuple] = {}
                leaves = convs.field(1).to_pylist()
                for node in leaves:
                    if node not in digests:
                        chain, k = [], node
                        while k >= 0:
                            chain.append(turns[k])
                            k = parent[k]
                        chain.reverse()
                        loss = "".join(x[2] for x in chain)
                        text = "".join(f"{x[0]}\n{x[1]}\n" for x in chain)
                        digests[node] = (len(chain), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(x[3] for x in chain))
                columns = zip(*(digests[node] for node in leaves), strict=True)
                yield pa.RecordBatch.from_arrays([convs.field(0), *(pa.array(c, k) for c, k in zip(columns, kinds[1:], strict=True))], names)

    return sequences.select("input_ids", "nodes", "conversations").mapInArrow(rows, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op3_prefix_tree_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return read_conversations(format_conversations(rows))


OP3_SQL = r"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c),
e AS (SELECT *, regexp_replace(text, '<(\\*(?:\|im_start\|>|\|im_end\|>|\|endoftext\|>|\|startoftext\|>|s>|/s>|<SYS>>|</SYS>>|unk>))|\[(\\*(?:INST\]|/INST\]))', '\0_', 'g') AS x FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  sum(length('<|im_start|>') + length(role) + 1 + length(x) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
