"""Text measures as columns: normal keys, runs, n-grams, cues, compression, echo of prompt terms."""

from __future__ import annotations

import hashlib
import zlib

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from chronotext.config import RepairConfig

# Characters that carry no content, tokens, cues and their labels.
NON_CONTENT = r"""[\s，。！？、；：,.!?;:'"“”‘’（）()【】\[\]—…·]+"""
TOKEN = r"[A-Za-z]+(?:-[A-Za-z0-9]+)*|\d+|[\x{3400}-\x{9fff}]+"
VISUAL_CUES = (
    ("照片/图像", r"照片|这[张幅个]?图|图[上中]|看(?:一下)?[^，。！？]{0,10}图"),
    ("板书/黑板", r"板书|黑板(?:上)?"),
    ("屏幕/PPT", r"(?i)屏幕(?:上)?|PPT|幻灯片"),
    ("图示内容", r"(?:这|那|上面|下面|左边|右边)[^，。！？]{0,8}(?:波形|电路图|示意图|曲线|表格)"),
    ("公式/板书位置", r"(?:(?:这个|那个|刚才|上面|下面|左边|右边)[^，。！？]{0,10}(?:公式|等式|多项式|算式|竖式|位置|小括号)|(?:列一个|这个)(?:算式|竖式)|写在(?:这个位置|左边|右边|上面|下面)|从(?:底下|下面)往上(?:面)?写)"),
)
DERIVATION_CUE = r"(?:下面|现在|接下来|首先|这里|我们)(?:来)?(?:进行|做|看)?[^。！？]{0,8}(?:推导|证明)|推导过程|证明过程"


def let(value: Column, body) -> Column:
    """Evaluate value once and hand it to body; Catalyst can't inline it twice."""
    return F.transform(F.array(value), body)[0]


def normalized(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "(?U)" + NON_CONTENT, ""))


def content_key(text: Column) -> Column:
    """Word characters only, case folded (the sharp s folds to ss)."""
    return F.replace(F.lower(F.regexp_replace(text, r"(?U)[^\w]+", "")), F.lit("ß"), F.lit("ss"))


def _ints(*names: str) -> StructType:
    return StructType([StructField(n, IntegerType()) for n in names])


#: Characters of texts that are measured at once (one text at least); it bounds a worker's memory.
BLOCK_CHARACTERS = 1 << 21


def _blocks(key: pd.Series):
    """(first row, characters' codes of its texts one after the other, their sizes) of runs of rows."""
    texts = key.fillna("")
    sizes = texts.str.len().to_numpy(np.int64)
    total = np.cumsum(sizes)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + BLOCK_CHARACTERS, "right")))
        yield i, np.frombuffer("".join(texts.iloc[i:j]).encode("utf-32-le", "surrogatepass"), np.uint32), sizes[i:j]
        i = j


def character_counts(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Different characters of each text."""
    text = np.repeat(np.arange(len(sizes)), sizes)
    return np.bincount(np.unique((text << 21) | codes) >> 21, minlength=len(sizes))


def gram_counts(codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(runs of three characters, how many of them are not the first of their kind) of each text. Three codes fill 63 bits, so no two runs are taken
    for one."""
    grams = np.maximum(sizes - 2, 0)
    if not grams.any():
        return grams, grams
    text = np.repeat(np.arange(len(sizes)), sizes)
    inside = text[2:] == text[:-2]
    c = codes.astype(np.int64)
    gram, text = ((c[:-2] << 42) | (c[1:-1] << 21) | c[2:])[inside], text[2:][inside]
    order = np.lexsort((gram, text))
    gram, text = gram[order], text[order]
    again = (gram[1:] == gram[:-1]) & (text[1:] == text[:-1])
    return grams, np.bincount(text[1:][again], minlength=len(sizes))


@F.pandas_udf(IntegerType())
def distinct_characters(key: pd.Series) -> pd.Series:
    return pd.Series(np.concatenate([character_counts(c, n) for _, c, n in _blocks(key)] or [np.zeros(0)]), dtype="int32")


@F.pandas_udf(_ints("total", "repeated"))
def ngram_counts(key: pd.Series) -> pd.DataFrame:
    """repeated is the number of trigrams beyond the first of their kind."""
    found = [np.stack(gram_counts(c, n), 1) for _, c, n in _blocks(key)]
    return pd.DataFrame(np.concatenate(found or [np.zeros((0, 2))]), columns=["total", "repeated"], dtype="int32")


@F.pandas_udf(_ints("distinct", "grams", "repeated", "run", "deflated"))
def profile(key: pd.Series) -> pd.DataFrame:
    """All measures of a normal key that take its characters one by one, in one pass: different characters, trigrams and repeated ones, the longest run of a
    unit, and the bytes that zlib's default compression leaves, which Spark has no function for (0 for an empty text)."""
    found = [np.stack([character_counts(c, n), *gram_counts(c, n), tile_runs(c, n)], 1) for _, c, n in _blocks(key)]
    out = pd.DataFrame(np.concatenate(found or [np.zeros((0, 4))]), columns=["distinct", "grams", "repeated", "run"], dtype="int32")
    out["deflated"] = deflated(key)
    return out


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("(?U)" + TOKEN), F.lit(0))


def tile_runs(codes: np.ndarray, sizes: np.ndarray, most: int = 12) -> np.ndarray:
    """For each text (its characters' codes, one text after the other, of these sizes): how often, at most, a unit of 1 to `most` characters, counted off
    from the text's start, stands in a row. One pass a unit: the text is compared with itself shifted by the unit, and a unit that is equal to the next throughout goes on."""
    starts = np.cumsum(sizes) - sizes
    best = np.minimum(sizes // 2, 1)
    for u in range(1, most + 1):
        n = np.maximum(sizes // u - 1, 0)  # units that have a next one
        if not n.any():
            break
        alike = np.concatenate([[0], np.cumsum(codes[:-u] == codes[u:])])
        own = np.flatnonzero(n)
        n, first = n[own], np.cumsum(n[own]) - n[own]
        at = np.arange(n.sum())
        unit = np.repeat(starts[own], n) + (at - np.repeat(first, n)) * u
        same = alike[unit + u] - alike[unit] == u
        reset = np.where(same, -1, at)
        begins = np.zeros(len(at), bool)
        begins[first] = True
        reset = np.maximum.accumulate(np.where(same & begins, at - 1, reset))
        best[own] = np.maximum(best[own], np.maximum.reduceat(at - reset, first) + 1)
    return best


@F.pandas_udf(IntegerType())
def _longest_tiles(key: pd.Series) -> pd.Series:
    return pd.Series(np.concatenate([tile_runs(c, n) for _, c, n in _blocks(key)] or [np.zeros(0)]), dtype="int32")


def longest_run(text: Column, tiles: Column | None = None) -> Column:
    """Longest run of equal tokens, or of a unit of 1 to 12 characters repeated without a break (tiles, if that is known)."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(a: Column, t: Column) -> Column:
        run = F.when(a["last"].eqNullSafe(t), a["run"] + 1).otherwise(1)
        return F.struct(t.alias("last"), run.alias("run"), F.greatest(a["best"], run).alias("best"))

    return F.greatest(F.aggregate(tokens(text), start, step, lambda a: a["best"]), _longest_tiles(normalized(text)) if tiles is None else tiles)


def visual_labels(text: Column) -> Column:
    return F.filter(F.array(*(F.when(F.rlike(text, F.lit(p)), F.lit(label)) for label, p in VISUAL_CUES)), lambda x: x.isNotNull())


def derivation_cue(text: Column) -> Column:
    return F.rlike(text, F.lit(DERIVATION_CUE))


def deflated(key: pd.Series) -> np.ndarray:
    return np.fromiter((len(zlib.compress(k.encode())) if k else 0 for k in key), np.int32, len(key))


@F.pandas_udf(IntegerType())
def deflated_bytes(key: pd.Series) -> pd.Series:
    """Bytes after zlib's default compression, which Spark has no function for; 0 for an empty text."""
    return pd.Series(deflated(key), dtype="int32")


#: Automata of this worker, by the terms' digest; one is enough for a query.
_AUTOMATA: dict[str, ahocorasick.Automaton] = {}


def automaton(terms: list[str]) -> ahocorasick.Automaton:
    """Finds all terms in one pass over a text, however many there are."""
    out = ahocorasick.Automaton()
    for k, t in enumerate(terms):
        out.add_word(t, (k, len(t)))
    if terms:
        out.make_automaton()
    return out


def echo_spans(found: ahocorasick.Automaton, key: str) -> tuple[int, float]:
    """(terms that occur, share of the text that they cover). A term's occurrences are taken from the left without overlap; those of different
    terms may overlap. A term's occurrences end in rising order, so what it has covered so far is one number a term."""
    if not len(found):
        return 0, 0.0
    until: dict[int, int] = {}
    spans = []
    for last, (k, n) in found.iter(key):
        if last + 1 - n >= until.get(k, 0):
            until[k] = last + 1
            spans.append((last + 1 - n, last + 1))
    covered = end = 0
    for a, b in sorted(spans):
        covered += max(0, b - max(a, end))
        end = max(end, b)
    return len(until), covered / max(1, len(key))


def prompt_echo(terms: list[str]):
    """Column function: struct(terms, coverage) of a normal key. terms: normal keys of a glossary. They are broadcast once; a worker builds its
    automaton from them once."""
    known = list(dict.fromkeys(t for t in terms if len(t) >= 2))
    digest = hashlib.sha256("\n".join(known).encode()).hexdigest()
    shared = SparkSession.active().sparkContext.broadcast(known)

    @F.pandas_udf("terms int, coverage double")
    def echo(key: pd.Series) -> pd.DataFrame:
        if digest not in _AUTOMATA:
            _AUTOMATA.clear()
            _AUTOMATA[digest] = automaton(shared.value)
        return pd.DataFrame([echo_spans(_AUTOMATA[digest], k or "") for k in key], columns=["terms", "coverage"])

    return echo


def half_even(c: Column, digits: int) -> Column:
    return F.bround(c, digits)


def anomaly(characters_: Column, bytes_: Column, ratio: Column, unique: Column, repeated: Column, run: Column, seconds: Column, echo_terms: Column, echo_coverage: Column, cfg: RepairConfig = RepairConfig()) -> Column:
    """struct(score, reasons, suspicious). The first four reasons need a minimum of bytes; their scores don't."""
    long = bytes_ >= cfg.min_text_bytes
    rate = F.when(seconds > 0, characters_ / seconds)
    sparse = F.coalesce((seconds >= cfg.sparse_segment_min_seconds) & (rate <= cfg.sparse_segment_max_chars_per_second), F.lit(False))
    echo = (echo_terms >= cfg.prompt_echo_min_terms) & (echo_coverage >= cfg.prompt_echo_min_coverage)
    named = (
        (long & (ratio >= cfg.compression_ratio_threshold), "high_compression"),
        (long & (unique <= cfg.unique_char_ratio_threshold), "low_character_diversity"),
        (long & (repeated >= cfg.repeated_ngram_ratio_threshold), "repeated_ngrams"),
        (long & (run >= cfg.longest_run_threshold), "consecutive_repetition"),
        (sparse, "low_text_density"),
        (echo, "prompt_echo"),
    )
    reasons = F.filter(F.array(*(F.when(c, F.lit(n)) for c, n in named)), lambda x: x.isNotNull())
    over = lambda c: F.greatest(F.lit(0.0), c)
    score = over(ratio / cfg.compression_ratio_threshold - 1) + over(cfg.unique_char_ratio_threshold - unique) / max(0.01, cfg.unique_char_ratio_threshold)
    score = score + over(repeated / cfg.repeated_ngram_ratio_threshold - 1) + over(run / max(1, cfg.longest_run_threshold) - 1)
    score = score + F.when(sparse, 1 + F.least(F.lit(4.0), over(cfg.sparse_segment_max_chars_per_second / F.greatest(F.lit(0.01), F.coalesce(rate, F.lit(0.0))) - 1))).otherwise(0.0)
    score = score + F.when(echo, 1 + over(echo_coverage / max(0.01, cfg.prompt_echo_min_coverage) - 1)).otherwise(0.0)
    return F.struct(half_even(score, 4).alias("score"), reasons.alias("reasons"), (F.size(reasons) > 0).alias("suspicious"))
