"""Operator 12, hierarchical multi-length packing: several context sizes, each filled without padding.

The context sizes (tiers) are the powers of two up to ``max_tokens``. A document goes to the tier that is the least power of two
not below its length; what exceeds ``max_tokens`` fills whole windows of its own. Tiers are packed from the longest: a
window takes the longest document left, then, for its gap, the longest piece of the shorter tiers that fits, again and
again; when none fits, the shortest longer one is cut, and what is left of it goes to the tier of its length. So every window is
full. What is left at the end of a partition is cut at its binary digits, into windows below the least tier.

Sequences are then dealt to training steps of ``step_tokens``: in descending size each goes to the step with room whose
attention work (the sum of its squared piece lengths) is least. Sizes are powers of two, so all steps of a window of
WINDOW tokens but its last are full.

Documents never leave their partition: there is no shuffle. A task holds the ids of one window of WINDOW tokens, or of one
longer document, and carries over less than two sequences' tokens. Sequence and step numbers hold the partition's number above
bit 40, so they are equal on a rerun.

Null texts are empty documents (one end id); rows with a null or repeated id are packed like any other; an empty table gives no
rows; columns other than the id and the text are not read.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .word_tokens import WordEncoder, word_vocabulary

MAX_TOKENS = 4096
LEAST_TIER = 256
STEP_TOKENS = 65_536
END_ID = 2
#: Tokens packed at once; it bounds a task's memory and the pool that gaps are filled from.
WINDOW = 1 << 21

Piece = tuple[int, int, int]  # document, first token in it, tokens


class Pool:
    """Pieces by length; the longest that fits and the shortest that does not are found by bisection."""

    def __init__(self):
        self.of: dict[int, list[Piece]] = {}
        self.lengths: list[int] = []
        self.total = 0

    def put(self, piece: Piece) -> None:
        n = piece[2]
        if n not in self.of:
            self.of[n] = []
            insort(self.lengths, n)
        self.of[n].append(piece)
        self.total += n

    def _pop(self, i: int) -> Piece:
        n = self.lengths[i]
        piece = self.of[n].pop()
        if not self.of[n]:
            del self.of[n], self.lengths[i]
        self.total -= n
        return piece

    def longest(self) -> int:
        return self.lengths[-1] if self.lengths else 0

    def fill(self, gap: int) -> Piece:
        """The longest piece of at most gap tokens, else the head of the shortest longer one."""
        if i := bisect_right(self.lengths, gap):
            return self._pop(i - 1)
        doc, start, n = self._pop(bisect_left(self.lengths, gap))
        self.put((doc, start + gap, n - gap))
        return doc, start, gap


def windows(pool: Pool, max_tokens: int, least: int, last: bool):
    """Full windows, tier by tier from the longest. Unless it is the last call, what can't fill a window stays in the pool."""
    size = max_tokens
    while size and pool.total:
        if not last and (size < least or pool.longest() > size):
            return
        low = size // 2 if size > least else 0
        while pool.total >= size and pool.longest() > low:
            out, gap = [], size
            while gap:
                out.append(pool.fill(gap))
                gap -= out[-1][2]
            yield out
        size //= 2


def steps(sequences: list[list[Piece]], step_tokens: int) -> list[int]:
    """The step of each sequence: largest first, to the step with room that has the least attention work. All steps but the last are full: the
    rooms of the others are multiples of the size at hand, so what does not fit the last fits one of them."""
    size = [sum(p[2] for p in s) for s in sequences]
    work = [sum(p[2] ** 2 for p in s) for s in sequences]
    total = sum(size)
    open_steps = [(0, k, min(step_tokens, total - k * step_tokens)) for k in range(-(-total // step_tokens))]
    out = [0] * len(sequences)
    for i in sorted(range(len(sequences)), key=lambda i: (-size[i], -work[i], i)):
        done, k, room = heapq.heappop(open_steps)
        if room < size[i]:  # the last step
            done, k, room = heapq.heapreplace(open_steps, (done, k, room))
        out[i] = k
        if room > size[i]:
            heapq.heappush(open_steps, (done + work[i], k, room - size[i]))
    return out


def pack_tiers(docs: DataFrame, vocabulary: str | None = None, max_tokens: int = MAX_TOKENS, least_tier: int = LEAST_TIER, step_tokens: int = STEP_TOKENS, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """A row for each piece: doc_id, start (in its document), length, doc_tokens, sequence_id, offset, tier (the sequence's tokens), step,
    ids (little-endian unsigned 32-bit). max_tokens, least_tier and step_tokens are powers of two."""
    if any(x < 1 or x & (x - 1) for x in (max_tokens, least_tier, step_tokens)) or step_tokens < max_tokens:
        raise ValueError("tiers and steps are powers of two, a step no smaller than the longest tier")
    vocabulary = vocabulary or word_vocabulary()

    def run(batches):
        task = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        pool, n_seq, n_step = Pool(), 0, 0
        docs: list[tuple] = []  # (id as a scalar of one row, tokens)
        held = 0

        def close(last: bool):
            nonlocal pool, docs, held, n_seq, n_step
            full = []
            for d, (_, tokens, whole) in enumerate(docs):
                if whole:  # a carried piece is in the pool already
                    full += [[(d, k * max_tokens, max_tokens)] for k in range(len(tokens) // max_tokens)]
                    if rest := len(tokens) % max_tokens:
                        pool.put((d, len(tokens) - rest, rest))
            full += windows(pool, max_tokens, least_tier, last)
            left = [p for group in pool.of.values() for p in group]
            if full:
                step = steps(full, step_tokens)
                piece = np.array([(d, a, n) for s in full for d, a, n in s], np.int64)
                of = np.repeat(np.arange(len(full)), [len(s) for s in full])
                ends = np.cumsum(piece[:, 2])
                size = np.bincount(of, piece[:, 2]).astype(np.int64)
                offset = ends - piece[:, 2] - (np.cumsum(size) - size)[of]
                ids = np.concatenate([docs[d][1][a : a + n] for d, a, n in piece.tolist()]).astype("<u4")
                binary = pa.Array.from_buffers(pa.large_binary(), len(piece), [None, pa.py_buffer(np.concatenate([[0], 4 * ends]).astype(np.int64)), pa.py_buffer(ids)])
                own = pa.concat_arrays([docs[d][0] for d in range(len(docs))]).take(pa.array(piece[:, 0]))
                tokens = np.array([len(x[1]) for x in docs], np.int64)[piece[:, 0]]
                tier, at_step = size[of], np.array(step, np.int64)[of] + task + n_step
                yield pa.RecordBatch.from_arrays(
                    [own, *(pa.array(x, pa.int64()) for x in (piece[:, 1], piece[:, 2], tokens, of + task + n_seq, offset, tier, at_step)), binary.cast(pa.binary())],
                    ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "tier", "step", "ids"],
                )
                n_seq, n_step = n_seq + len(full), n_step + max(step) + 1
            kept = {d: k for k, d in enumerate(dict.fromkeys(p[0] for p in left))}
            pool = Pool()
            for d, a, n in left:
                pool.put((kept[d], a, n))
            docs = [(docs[d][0], docs[d][1], False) for d in kept]
            held = 0

        with WordEncoder.task(vocabulary) as encoder:
            for b in batches:
                names = b.column(0)
                for first, tokens, off in encoder.batches(b.column(1)):
                    n = len(off) - 1
                    own, ends = np.insert(tokens, off[1:], np.int32(end_id)), off[1:] + np.arange(1, n + 1)
                    for k, (i, j) in enumerate(zip((ends - np.diff(off) - 1).tolist(), ends.tolist(), strict=True)):
                        docs.append((names.slice(first + k, 1), own[i:j].copy(), True))
                        held += j - i
                        if held >= window:
                            yield from close(False)
            yield from close(True)

    kind = docs.schema[id_col].dataType.simpleString()
    out = f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, tier long, step long, ids binary"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, out)


def op12_tier_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_tiers(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step")
