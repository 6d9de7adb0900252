"""Operator 4, benchmark decontamination by template canonicalisation.

Numbers, names and units of a benchmark item become typed placeholders, and so do those of every document. The
benchmark's windows of canonical words are a hash table (at most MAX_WINDOWS windows, but one item at least; a larger
benchmark is taken in blocks of that size, each over all documents, and only one block is on the executors at a time).
A document's windows are probed against it. Windows that lie on one diagonal of document and item must fill the item's
slots consistently: an item's value has one value in the document wherever it stands (two values may become one). So a
question that is asked again with other numbers is found, and a text that merely shares a turn of phrase is not. Where
no diagonal is enough, neighbouring ones count together, so a word more or less (SHIFT at most) doesn't hide a question.
A capitalised word that starts a sentence may be a name or not; windows that don't match as they stand, where it is
none, are hashed both ways on both sides. Any other capitalised word is read as a name, German nouns too: on both sides
alike, so that exact copies match, but of a German item the verbs and small words are what must agree.

Null and empty texts match nothing; null and repeated ids are returned as they come; empty tables give no rows;
extra columns are kept by decontaminate() and not read by matches(). Items shorter than a window are one window.
Items of fewer than LEAST_ITEM words, and items none of whose windows has enough literal words, match their exact
whole sequence of words (one window); an item of one word matches only a text that is that word.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from .common import materialize, table, trim

#: Words of a window; windows on one diagonal that make a match; words of an item and literal words of a window, at least.
WINDOW, MATCHES, LEAST_ITEM, LITERALS = 8, 3, 5, 4
#: Words that may be put in or left out between windows that count together.
SHIFT = 2
#: Windows in one block of the benchmark (about 40 bytes each), and words a worker remembers.
MAX_WINDOWS, LEXICON = 1_000_000, 400_000

# Words that stand for numbers, and for units of measure.
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half twice".split()
NUMBERS += "null zwei drei vier fünf sechs sieben acht neun zehn elf zwölf zwanzig dreißig hundert tausend deux trois quatre cinq sept huit neuf dix onze douze vingt trente cent mille dos tres cuatro cinco seis siete ocho nueve diez once doce veinte treinta cien mil".split()
UNITS = "mm cm m km inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres g kg mg gram grams kilogram kilograms ton tons tonne tonnes lb lbs pound pounds ounce ounces ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years dollar dollars euro euros cents percent mph kmh volt volts watt watts degree degrees".split()
UNITS += "stunde stunden tag tage tagen jahr jahre jahren kilo gramm heure heures jour jours an ans année années mètre mètres gramme grammes hora horas día días año años metro metros gramo gramos".split()

_PUNCT = ".,;:!?\"'()[]{}<>«»“”‘’…"
_NUMBER = re.compile(r"[+-]?[$€£]?[0-9][0-9.,:/]*(?:%|st|nd|rd|th)?")
_MEASURE = re.compile(r"[+-]?[0-9][0-9.,]*(?:[a-z]+)")
_OPENS = tuple("+-$€£0123456789")
_SPECIAL = {x: "\0NUM" for x in NUMBERS} | {x: "\0UNIT" for x in UNITS}


def forms(word: str) -> tuple[str, str, str]:
    """(canonical form inside a sentence, the same at its start, value); a placeholder begins with a zero character."""
    core = word.strip(_PUNCT) or word
    low = core.lower()
    if (form := _SPECIAL.get(low)) is None and low[:1] in _OPENS:
        if _NUMBER.fullmatch(low):
            form = "\0NUM"
        elif _MEASURE.fullmatch(low) and low.lstrip("+-0123456789.,") in UNITS:
            form = "\0NUM\0UNIT"
    if form is not None:
        return form, form, low
    if core[:1].isupper() and core[1:].islower():
        return "\0NAME", low, low
    return low, low, low


def canonical(word: str, starts: bool) -> tuple[str, str]:
    mid, start, value = forms(word)
    return (start if starts else mid), value


class Lexicon(dict):
    """word -> row of mid (code inside a sentence), start (code at its start), value (code of the word itself), ends (whether it ends one)."""

    def __init__(self) -> None:
        self.mid, self.start, self.value, self.ends = *(np.zeros(LEXICON, np.uint64) for _ in range(3)), np.zeros(LEXICON, bool)

    def __missing__(self, word: bytes) -> int:
        if (n := len(self)) == len(self.mid):
            self.mid, self.start, self.value, self.ends = (np.concatenate([x, np.zeros_like(x)]) for x in (self.mid, self.start, self.value, self.ends))
        text = word.decode()
        mid, start, value = forms(text)
        h = self.value[n] = xxhash.xxh64_intdigest(value)
        self.mid[n] = h if mid is value else xxhash.xxh64_intdigest(mid)
        self.start[n] = h if start is value else xxhash.xxh64_intdigest(start)
        self.ends[n] = text.rstrip("\"')]»”’")[-1:] in (".", "!", "?", ":")
        self[word] = n
        return n

    def codes(self, words: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of several texts' words, strung together; the same with words that start a sentence as inside one; rows."""
        row = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        starts = np.concatenate([[True], self.ends[row[:-1]]])
        first = np.cumsum(sizes) - sizes
        starts[first[(sizes > 0)]] = True
        return np.where(starts, self.start[row], self.mid[row]), self.mid[row], row


_LEXICON = [Lexicon()]


def _lexicon() -> Lexicon:
    if len(_LEXICON[0]) > LEXICON:
        _LEXICON[0] = Lexicon()
    return _LEXICON[0]


def window_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    n = max(0, len(codes) - size + 1)
    out = np.full(n, 0x9E3779B97F4A7C15 * size & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for j in range(size):
        out = out * np.uint64(0x100000001B3) + codes[j : j + n]
        out ^= out >> np.uint64(29)
    return out


def window_readings(plain: np.ndarray, named: np.ndarray, size: int, most: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(places, their windows' hashes, whether as they stand) for each choice of plain or named codes where they differ."""
    h = window_hashes(plain, size)
    yield np.arange(len(h)), h, True
    before = np.concatenate([[0], np.cumsum(plain != named)])
    many = before[size:] - before[: len(before) - size] if len(h) else np.zeros(0, int)
    if len(at := np.flatnonzero(many)):
        yield at, window_hashes(named, size)[at], False
    mixed = np.flatnonzero(many > 1)
    for choice in range(1, (1 << int(many.max(initial=0))) - 1):
        own = many[mixed]
        every = mixed[(own >= choice.bit_length()) & ((1 << own) - 1 != choice)]
        for at in (every[i : i + most] for i in range(0, len(every), most)):
            out = np.full(len(at), 0x9E3779B97F4A7C15 * size & 0xFFFFFFFFFFFFFFFF, np.uint64)
            for j in range(size):
                own = (choice >> (before[at + j] - before[at])) & 1  # where they are the same, either will do
                out = out * np.uint64(0x100000001B3) + np.where(own, named[at + j], plain[at + j])
                out ^= out >> np.uint64(29)
            yield at, out, False


def _values(words: list[bytes]) -> list[tuple[str, str]]:
    out, starts = [], True
    for w in words:
        text = w.decode()
        out.append(canonical(text, starts))
        starts = text.rstrip("\"')]»”’")[-1:] in (".", "!", "?", ":")
    return out


class Block:
    """A part of the benchmark: its windows' hashes, sorted, with the item and place of each."""

    def __init__(self, items: list[tuple]):
        self.items = [(i, (t or "").encode().split()) for i, t in items]
        self.values = [_values(w) for _, w in self.items]
        hashes, where, self.need, self.size, self.names = [], [], [], [], []
        whole, exact = [], []
        for k, (_, words) in enumerate(self.items):
            size = min(WINDOW, len(words))
            lexicon = Lexicon()
            plain, named, row = lexicon.codes(words, np.array([len(words)]))
            literal = np.array([not v[0].startswith("\0") for v in self.values[k]], int)
            fit = [p for p in range(len(words) - size + 1) if len(words) >= LEAST_ITEM and literal[p : p + size].sum() >= min(LITERALS, size - 1)]
            for at, h, stands in window_readings(plain, named, size) if fit else ():
                for p in np.flatnonzero(np.isin(at, fit)):
                    hashes.append(h[p])
                    where.append((k, at[p], stands))
            if words and not fit:
                whole.append(window_hashes(lexicon.value[row[:size]], size)[0])
                exact.append(k)
            self.names.append(set(np.flatnonzero(plain != named).tolist()))
            self.need.append(min(MATCHES, max(1, len(fit))))
            self.size.append(size)
        order = np.argsort(np.array(hashes, np.uint64), kind="stable")
        self.hashes = np.array(hashes, np.uint64)[order]
        self.where = np.array(where, np.int64).reshape(-1, 3)[order]
        self.sizes = sorted({self.size[k] for k, *_ in where})
        order = np.argsort(np.array(whole, np.uint64), kind="stable")
        self.whole, self.exact = np.array(whole, np.uint64)[order], np.array(exact, np.int64)[order]
        self.exact_sizes = sorted({self.size[k] for k in exact})
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.hashes >> np.uint64(42)).astype(np.int64)] = True

    def probe(self, codes: tuple[np.ndarray, np.ndarray, np.ndarray], values: np.ndarray, words: list[bytes], sizes: np.ndarray) -> list[tuple[int, int, int, bool]]:
        """(text, item, windows, whether a slot has another value) of consistent matches. Windows are counted as they
        stand if these are enough, else in all readings."""
        ends = np.cumsum(sizes)
        plain, named, row = codes
        diagonals: dict[tuple[int, int], dict[int, tuple[set[int], set[int]]]] = defaultdict(lambda: defaultdict(lambda: (set(), set())))
        for size in self.sizes:
            for place, h, stands in window_readings(plain, named, size):
                some = np.flatnonzero(self.bits[(h >> np.uint64(42)).astype(np.int64)])
                at, h = place[some], h[some]
                lo, hi = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
                doc = np.searchsorted(ends, at, "right")
                fit = (hi > lo) & (at + size <= ends[np.minimum(doc, len(ends) - 1)])
                for p, d, i, j in zip(at[fit], doc[fit], lo[fit], hi[fit], strict=True):
                    for k, q, own in self.where[i:j]:
                        if self.size[k] == size:
                            as_is, all_ = diagonals[int(d), int(k)][int(p) - int(q)]
                            all_.add(int(q))
                            if own and stands:
                                as_is.add(int(q))
        out: dict[tuple[int, int], tuple[int, bool]] = {}
        for size in self.exact_sizes:
            h = window_hashes(values[row], size)
            lo, hi = np.searchsorted(self.whole, h, "left"), np.searchsorted(self.whole, h, "right")
            for p in np.flatnonzero(hi > lo).tolist():
                d = int(np.searchsorted(ends, p, "right"))
                for k in self.exact[lo[p] : hi[p]].tolist():
                    item = self.values[k]
                    if self.size[k] == size and p + len(item) <= ends[d] and (len(item) > 1 or sizes[d] == 1):
                        if [canonical(w.decode(), True)[1] for w in words[p : p + len(item)]] == [v for _, v in item]:
                            out[d, k] = (1, False)
        for (d, k), of in diagonals.items():
            shifts = sorted(of)
            found = [m for x in shifts if (m := self._match(k, {x: of[x]}, words))]
            if not found and len(shifts) > 1:
                # runs of neighbouring diagonals: words were put in or left out between their windows
                cuts = [0, *(i for i in range(1, len(shifts)) if shifts[i] - shifts[i - 1] > SHIFT), len(shifts)]
                found = [m for i, j in zip(cuts, cuts[1:], strict=False) if j - i > 1 and (m := self._match(k, {x: of[x] for x in shifts[i:j]}, words))]
            if found:
                out[d, k] = max(found)
        return [(d, k, n, other) for (d, k), (n, other) in sorted(out.items())]

    def _match(self, k: int, of: dict[int, tuple[set[int], set[int]]], words: list[bytes]) -> tuple[int, bool] | None:
        """(windows, whether a slot has another value) of item k on these diagonals, if enough windows match and they are consistent."""
        as_is = {x: own for x, (own, _) in of.items()}
        read = len(set().union(*as_is.values())) < self.need[k]
        places = {x: every for x, (_, every) in of.items()} if read else as_is
        n = len(set().union(*places.values()))
        if n < self.need[k]:
            return None
        there: dict[tuple[str, str], str] = {}
        other = False
        for shift, at in places.items():
            for q in sorted({q + j for q in at for j in range(self.size[k])}):
                kind, value = self.values[k][q]
                if read and q in self.names[k]:
                    kind = "\0NAME"
                if kind.startswith("\0"):
                    own = (words[shift + q].decode().strip(_PUNCT) or words[shift + q].decode()).lower()
                    if there.setdefault((kind, value), own) != own:
                        return None
                    other |= own != value
        return n, other

    def scan(self, column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, int, bool]]:
        """probe() over a column of texts, several at once."""
        first, words, sizes = 0, [], []
        for i, x in enumerate(column):
            own = x.as_buffer().to_pybytes().split() if x.is_valid else []
            words += own
            sizes.append(len(own))
            if len(words) >= most or i + 1 == len(column):
                if words:
                    n = np.array(sizes)
                    lexicon = _lexicon()
                    codes = lexicon.codes(words, n)
                    for d, k, w, other in self.probe(codes, lexicon.value, words, n):
                        yield first + d, k, w, other
                first, words, sizes = i + 1, [], []


def blocks(benchmark: DataFrame, most: int = MAX_WINDOWS) -> Iterator[Block]:
    """The benchmark in blocks of at most so many windows (in one reading), read row by row."""
    held, n = [], 0
    for i, t in benchmark.select("item_id", "text").toLocalIterator():
        size = len((t or "").split())
        if held and n + size > most:
            yield Block(held)
            held, n = [], 0
        held.append((i, t))
        n += size
    if held:
        yield Block(held)


def _over_blocks(spark: SparkSession, benchmark: DataFrame, apply: Callable[[DataFrame | None, Broadcast], DataFrame], name: str) -> DataFrame | None:
    """apply(what the blocks before gave, a block) for each block. Of several, each one's result is written before the next is sent out, and the
    block is taken off the executors."""
    out, each = None, blocks(benchmark)
    block = next(each, None)
    while block is not None:
        after = next(each, None)
        shared = spark.sparkContext.broadcast(block)
        several = out is not None or after is not None
        out = apply(out, shared)
        if several:
            out = materialize(out, name)
            shared.destroy()
        block = after
    return out


def _task(of: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The words that a task has met are forgotten at its end."""

    def rows(batches):
        try:
            yield from of(batches)
        finally:
            _LEXICON[0] = Lexicon()
            trim()

    return rows


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, item_id, n_windows and reparameterised: a row for each document and item that it holds."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, item_id long, n_windows int, reparameterised boolean"

    def apply(before: DataFrame | None, shared: Broadcast) -> DataFrame:
        def rows(batches):
            for b in batches:
                if found := list(shared.value.scan(b.column(1))):
                    doc, item, n, other = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), pa.array([shared.value.items[k][0] for k in item], pa.int64()), pa.array(n, pa.int32()), pa.array(other, pa.bool_())], [id_col, "item_id", "n_windows", "reparameterised"])

        part = docs.select(id_col, text_col).mapInArrow(_task(rows), schema)
        return part if before is None else before.unionByName(part)

    out = _over_blocks(spark, benchmark, apply, "matches")
    return spark.createDataFrame([], schema) if out is None else out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without those that hold a benchmark item."""
    at = docs.columns.index(text_col)
    schema = docs.schema

    def apply(before: DataFrame | None, shared: Broadcast) -> DataFrame:
        def rows(batches):
            for b in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):  # what is held of a batch is bounded
                keep = np.ones(b.num_rows, bool)
                keep[[d for d, *_ in shared.value.scan(b.column(at), 1 << 18)]] = False
                yield b.filter(pa.array(keep))

        return (docs if before is None else before).mapInArrow(_task(rows), schema)

    out = _over_blocks(docs.sparkSession, benchmark, apply, "clean")
    return docs if out is None else out


def op4_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
