"""Exact batch encoding with a byte-level BPE file of the tokenizers library.

Texts are cut where a single space or line end stands between two non-space characters, and between a letter and a
punctuation mark. There the pre-tokeniser always starts a new piece, so a chunk has the same ids wherever it occurs. Chunks of a batch are dictionary-encoded
by Arrow; only chunks that this task has not met are given to the tokenizer, strung together. What is
remembered is bounded in bytes and released when a task ends, so that idle workers hold none of it.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute

from .common import trim

#: Bytes of chunks and ids kept (an entry takes ENTRY_BYTES besides); beyond it the cache starts afresh. It changes speed only.
CACHE_BYTES, ENTRY_BYTES = 96 << 20, 40
#: Bytes of text encoded at once, one document at least.
BATCH_BYTES = 8 << 20
#: Chunks strung together; the library is fastest on texts of about 2 kB.
STRUNG = 256


_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK[list(b".,;:!?")] = True


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _layout(binary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a large_binary array without nulls; the offsets count in the bytes."""
    if not len(binary):
        return np.zeros(1, np.int64), np.zeros(1, np.uint8)
    off = np.frombuffer(binary.buffers()[1], np.int64)[binary.offset : binary.offset + len(binary) + 1]
    return off - off[0], np.frombuffer(binary.buffers()[2], np.uint8)[off[0] : off[-1]] if off[-1] > off[0] else np.zeros(1, np.uint8)


class Encoder:
    """encode(texts) -> (ids of all texts as one int32 array, offsets of each text in it)."""

    _of: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.id_bytes = np.zeros(size, np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.id_bytes[i] = len(token)  # one character stands for one byte
        self._reset()

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    @classmethod
    @contextmanager
    def task(cls, path: str) -> Iterator[Encoder]:
        """The worker's encoder for the time of a task; what it has learned is released at the end."""
        own = cls.of(path)
        try:
            yield own
        finally:
            own._reset()
            trim()

    def _reset(self) -> None:
        self.known, self.bytes = pa.array([], pa.large_binary()), 0
        self.store, self.used = np.zeros(1 << 16, np.int32), 0
        self.starts, self.lens = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)

    def _add(self, chunks: pa.Array, ids: np.ndarray, lens: np.ndarray) -> None:
        n, k = len(self.known), len(chunks)
        while self.used + len(ids) > len(self.store):
            self.store = np.concatenate([self.store, np.zeros_like(self.store)])
        while n + k > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.lens = np.concatenate([self.lens, np.zeros_like(self.lens)])
        self.store[self.used : self.used + len(ids)] = ids
        self.starts[n : n + k] = self.used + np.cumsum(lens) - lens
        self.lens[n : n + k] = lens
        self.used += len(ids)
        self.bytes += 4 * len(ids) + ENTRY_BYTES * k + _layout(chunks)[1].nbytes
        self.known = pa.concat_arrays([self.known, chunks])

    def _learn(self, missing: pa.Array) -> np.ndarray:
        """The entries of new chunks. Chunks from a space to a letter, digit or mark may be strung together."""
        off, data = _layout(missing)
        size = np.diff(off)
        two = size > 1
        first, second, last, before = (np.where(two, data[np.where(two, at, 0)], 0) for at in (off[:-1], off[:-1] + 1, off[1:] - 1, off[1:] - 2))
        fits = two & ((first == 32) | (first == 10)) & (((last > 32) & (last < 127)) | ((last > 127) & (before >= 0xC3) & (before <= 0xDF))) & (((second > 32) & (second < 127)) | ((second >= 0xC3) & (second <= 0xDF)))
        entry, n = np.zeros(len(missing), np.int64), len(self.known)
        order = np.concatenate([np.flatnonzero(fits), np.flatnonzero(~fits)])
        entry[order] = n + np.arange(len(order))
        if k := int(fits.sum()):
            strung = missing.take(pa.array(order[:k]))
            off, data = _layout(strung)
            view = memoryview(data)
            texts = [str(view[off[i] : off[min(i + STRUNG, k)]], "utf-8") for i in range(0, k, STRUNG)]
            ids = np.concatenate([np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
            at = np.searchsorted(np.cumsum(self.id_bytes[ids]), off[1:] - off[0], "left") + 1
            self._add(strung, ids, np.diff(at, prepend=0))
        if k < len(order):
            alone = missing.take(pa.array(order[k:]))
            found = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast([c.decode() for c in alone.to_pylist()], add_special_tokens=False)]
            self._add(alone, np.concatenate(found), np.array([len(x) for x in found]))
        return entry

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if not len(texts) or off[-1] == off[0]:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[off[0] : off[-1]]
        off = off - off[0]
        # a safe space or line end: something printable before it, and after it
        padded = np.concatenate([np.zeros(2, np.uint8), data, np.zeros(1, np.uint8)])
        before2, before, here, after = padded[:-3], padded[1:-2], padded[2:-1], padded[3:]
        at = np.flatnonzero((here == 32) | (here == 10))
        b, b2, a = before[at], before2[at], after[at]
        at = at[(((b > 32) & (b < 127)) | ((b >= 128) & (b2 >= 0xC3) & (b2 <= 0xDF))) & (((a > 32) & (a < 127)) | ((a >= 0xC3) & (a <= 0xDF)))]
        cut = np.zeros(len(data) + 1, bool)
        marks = np.flatnonzero(_MARK[here])
        cut[marks[_LETTER[before[marks]]]] = True
        cut[at] = cut[off] = True
        cuts = np.flatnonzero(cut)
        chunks = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        coded = chunks.dictionary_encode()
        if self.bytes > CACHE_BYTES:
            self._reset()
        entry = np.array(pa.compute.index_in(coded.dictionary, value_set=self.known).fill_null(-1), np.int64)
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            entry[missing] = self._learn(coded.dictionary.take(pa.array(missing)))
        entry = entry[np.asarray(coded.indices)]
        lens = self.lens[entry].astype(np.int64)
        ends = np.cumsum(lens)
        ids = self.store[np.repeat(self.starts[entry] - (ends - lens), lens) + np.arange(ends[-1])]
        return ids, np.concatenate([[0], ends])[np.searchsorted(cuts, off)]

    def batches(self, texts: pa.Array, most: int = BATCH_BYTES):
        """(first row, ids, offsets) over runs of at most so many bytes."""
        size = np.asarray(pa.compute.binary_length(texts.cast(pa.large_binary())).fill_null(0)).cumsum()
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + most, "right")))
            yield i, *self.encode(texts.slice(i, j - i))
            i = j
