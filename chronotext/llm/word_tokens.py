"""Exact batch encoding with a BPE file whose pre-tokeniser drops white space and lower-cases (word ends marked by ``</w>``).

No token spans white space, and an ASCII letter and one of ``.,;:!?`` after it are never in one token, so texts are cut there.
Each distinct chunk is given to the tokenizers library once a task: those of ASCII and Latin-1 letters strung together
with spaces between (their tokens have as many bytes as they), the others alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute

from .tokens import _LETTER, _MARK, CACHE_BYTES, STRUNG, Encoder, _layout

WORD_END = "</w>"
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder(Encoder):
    """encode(texts) -> (ids of all texts as one int32 array, offsets of each text in it)."""

    _of: dict[str, Encoder] = {}

    def __init__(self, path: str):
        super().__init__(path)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.id_bytes[i] = len(token.removesuffix(WORD_END))

    def _alone(self, chunks: pa.Array) -> None:
        found = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast([c.decode() for c in chunks.to_pylist()], add_special_tokens=False)]
        self._add(chunks, np.concatenate([np.zeros(0, np.int32), *found]), np.array([len(x) for x in found], np.int64))

    def _learn(self, missing: pa.Array) -> np.ndarray:
        off, data = _layout(missing)
        lead = data == 0xC3
        plain = (data < 128) | lead
        plain[1:] |= lead[:-1]
        counts = lambda flag: np.diff(np.concatenate([[0], np.cumsum(flag)])[off])
        fits = counts(plain) == np.diff(off)
        order = np.concatenate([np.flatnonzero(fits), np.flatnonzero(~fits)])
        entry = np.zeros(len(missing), np.int64)
        entry[order] = len(self.known) + np.arange(len(order))
        k = int(fits.sum())
        if k:
            strung = missing.take(pa.array(order[:k]))
            words = [c.decode() for c in strung.to_pylist()]
            texts = [" ".join(words[i : i + STRUNG]) for i in range(0, k, STRUNG)]
            ids = np.concatenate([np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
            ends, due = np.append(0, np.cumsum(self.id_bytes[ids])), np.cumsum(counts(~_SPACE[data])[order[:k]])
            at = np.searchsorted(ends, due, "left")
            if due[-1] == ends[-1] and (ends[at] == due).all():
                self._add(strung, ids, np.diff(at, prepend=0))
            else:  # a letter whose lower case has another length
                self._alone(strung)
        if k < len(order):
            self._alone(missing.take(pa.array(order[k:])))
        return entry

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        off, data = _layout(texts)
        if off[-1] == 0:
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        # a chunk is white space and what follows it, or begins with a mark after a letter
        space = _SPACE[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = (space[1:] & ~space[:-1]) | (_MARK[data[1:]] & _LETTER[data[:-1]])
        cut[off] = True
        cuts = np.flatnonzero(cut)
        chunks = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))])
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
