"""Operator 5, quality rules as a short-circuit cascade, with DataFrame functions only.

Each rule is a rejecting predicate over a few measures of the text. On rows drawn from the whole table the operator times
every rule from the text and counts what it rejects, orders the rules by rejections per cost, and compiles them to a
nest of CASE WHEN: a measure is worked out once, where the first rule needs it, and only for rows that no earlier rule
has rejected. The order changes the cost and which rule is named first, never the verdict. Where all measures are asked
for anyway (apply_rules), they are worked out once and the same cascade reads them.

Null and empty texts have no words (so they fail); rows with a null or repeated id are all returned; an empty
table gives no rows; columns other than the text are not read by the rules. A text is measured within one row, so its
memory grows with the longest text.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, materialize, release, table

#: Words of a window, and the base limits: fewest words, percent of words in repeated windows.
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: Rows, about, on which cost and selectivity are estimated, drawn from the whole table; how often a rule is timed (the least counts).
SAMPLE_ROWS, TIMED = 3000, 3


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
ADDED = (*MEASURES, "rejected_by", "kept", "_v")


@dataclass(frozen=True)
class Rule:
    """needs: names of measures; rejects: from a getter of them, true for a row to reject."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[[Callable[[str], Column]], Column]


def rules() -> list[Rule]:
    """The default rules. Their limits leave ordinary prose, tables and lists far inside."""
    few = lambda m: F.greatest(m("n_words"), F.lit(1))
    return [
        Rule("few_words", ("n_words",), lambda m: m("n_words") < LEAST_WORDS),
        Rule("repeated_windows", ("n_words", "n_repeat_words"), lambda m: 100 * m("n_repeat_words") > MOST_REPEATED * m("n_words")),
        Rule("symbols", ("n_words", "n_symbols"), lambda m: m("n_symbols") > few(m)),
        Rule("duplicate_lines", ("lines",), lambda m: (m("lines")["n_dup_lines"] >= 4) & (2 * m("lines")["n_dup_lines"] > m("lines")["n_lines"])),
        Rule("word_length", ("n_words", "word_chars"), lambda m: (m("word_chars") > 20 * few(m)) | (m("word_chars") < 2 * few(m))),
        Rule("letters", ("word_chars", "n_letters"), lambda m: 10 * m("n_letters") < 4 * m("word_chars")),
    ]


def without(text: Column, pattern: str) -> Column:
    """Characters that are left without a pattern's matches."""
    return F.length(F.regexp_replace(text, pattern, "")).cast("long")


def n_words(text: Column) -> Column:
    """Words are counted by their first characters, without an array of them."""
    return F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]*+([^\x20\x09-\x0D])[^\x20\x09-\x0D]*+|[\x20\x09-\x0D]++", "$1")).cast("long")


def _covered(windows: Column) -> Column:
    """Words in windows that occur twice: sort (hash, place), keep those equal to a neighbour, measure the union."""

    def repeated(s: Column) -> Column:
        same = lambda i, j: F.coalesce(F.get(s, i)["h"] == F.get(s, j)["h"], F.lit(False))
        return F.transform(F.filter(F.transform(s, lambda x, i: F.struct(x["i"].alias("i"), (same(i, i - 1) | same(i, i + 1)).alias("twice"))), lambda x: x["twice"]), lambda x: x["i"])

    def union(places: Column) -> Column:
        total = F.aggregate(places, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")), lambda a, p: F.struct((a["n"] + F.least(p - a["last"], F.lit(WINDOW))).alias("n"), p.alias("last")))
        return total["n"]

    ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(ordered, lambda s: let(F.array_sort(repeated(s)), union))


def n_repeat_words(text: Column) -> Column:
    def of(w: Column) -> Column:
        n = F.size(w)
        # a window's hash is made of its halves' hashes: three passes, whatever the window's length
        step = lambda h, k: F.zip_with(h, F.slice(h, k + 1, F.greatest(F.size(h) - k, F.lit(0))), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b)))
        whole = lambda h, k: F.slice(h, 1, F.greatest(F.size(h) - k, F.lit(0)))
        h1 = F.transform(w, lambda x: F.xxhash64(x))
        windows = let(h1, lambda a: let(whole(step(a, 1), 1), lambda b: let(whole(step(b, 2), 2), lambda c: whole(step(c, 4), 4))))
        return F.when(n > WINDOW, let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _covered(h)).otherwise(F.lit(0).cast("long")))).otherwise(F.lit(0).cast("long"))

    return let(F.array_remove(F.split(text, r"[\x20\x09-\x0D]++"), ""), of)


def of_lines(text: Column) -> Column:
    """n_lines (with a word), n_dup_lines."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    return let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))


#: Measures by name, each from a text that isn't null.
MEASURE: dict[str, Callable[[Column], Column]] = {
    "n_words": n_words,
    "n_repeat_words": n_repeat_words,
    "lines": of_lines,
    "word_chars": lambda t: without(t, r"[\x20\x09-\x0D]++"),
    "n_symbols": lambda t: without(t, r"[^#*$%&|<>]++"),
    "n_letters": lambda t: without(t, r"[^\p{L}]++"),
}


def cascade(ordered: list[Rule], text: Column, known: dict[str, Column] | None = None) -> Column:
    """Name of the first rule, in this order, that rejects; null if none does. known: measures that are there already."""
    known = dict(known or {})
    if not ordered:
        return F.lit(None).cast("string")
    rule, rest = ordered[0], ordered[1:]
    missing = [k for k in rule.needs if k not in known]

    def judge(m: Column | None) -> Column:
        have = known | {k: m[k] for k in missing}
        return F.when(F.coalesce(rule.rejects(have.__getitem__), F.lit(False)), F.lit(rule.name)).otherwise(cascade(rest, text, have))

    return let(F.struct(*(MEASURE[k](text).alias(k) for k in missing)), judge) if missing else judge(None)


def rejected_by(text: Column, ordered: list[Rule]) -> Column:
    """The cascade from the text alone."""
    return let(F.coalesce(text, F.lit("")), lambda t: cascade(ordered, t))


def verdict(text: Column, ordered: list[Rule]) -> Column:
    """A struct of MEASURES and rejected_by, as one expression: a filter on it, which Spark moves down, costs it only once."""
    every = [k for k in MEASURE if k != "n_letters"]

    def flat(t: Column) -> Column:
        have = lambda m: {k: m[k] for k in every}
        field = lambda m, k: m["lines"][k] if k.endswith("_lines") else m[k]
        return let(F.struct(*(MEASURE[k](t).alias(k) for k in every)), lambda m: F.struct(*(field(m, k).alias(k) for k in MEASURES), cascade(ordered, t, have(m)).alias("rejected_by")))

    return let(F.coalesce(text, F.lit("")), flat)


def estimates(docs: DataFrame, given: list[Rule], text_col: str = "text", rows: int = SAMPLE_ROWS) -> list[tuple[float, float]]:
    """(seconds a row, share rejected) of each rule, on about so many rows drawn by Spark's Bernoulli sampling from the whole table. They stay in
    the shared folder; only counts come to the driver. (0, 0) for all where nothing was drawn."""
    n = docs.count()
    drawn = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("t")).sample(min(1.0, 1.2 * rows / max(n, 1)), seed=5)
    few = materialize(drawn, "sample")
    size = few.count()

    def timed(c: Column) -> tuple[float, int]:
        began = time.perf_counter()
        hits = few.agg(F.count_if(c)).collect()[0][0]
        return time.perf_counter() - began, hits

    out = [(0.0, 0.0)] * len(given)
    if size:
        # round after round, so that no rule alone pays for the JVM's warming up
        every = [F.length("t") < 0, *(rejected_by(F.col("t"), [r]).isNotNull() for r in given)]
        floor, *found = [min(t) for t in zip(*([timed(c) for c in every] for _ in range(TIMED)), strict=True)]
        out = [(max(1e-3, t - floor[0]) / size, hits / size) for t, hits in found]
    release(few)
    return out


def order_rules(docs: DataFrame, given: list[Rule], text_col: str = "text", rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by rejections per second on the sample, most first. Ratios are compared in powers of four (ties: as given), so that the clock's noise
    doesn't reorder them."""
    found = estimates(docs, given, text_col, rows)
    rank = [-round(math.log(share / seconds, 4)) if share else math.inf for seconds, share in found]
    return [given[k] for k in sorted(range(len(given)), key=lambda k: (rank[k], k))]


def keep(docs: DataFrame, text_col: str = "text", given: list[Rule] | None = None) -> DataFrame:
    """docs without the rows that a rule rejects; no column is added, so none can clash."""
    return docs.where(rejected_by(docs[text_col], order_rules(docs, given or rules(), text_col)).isNull())


def apply_rules(docs: DataFrame, text_col: str = "text", given: list[Rule] | None = None) -> DataFrame:
    """docs with the measures, rejected_by and kept, which take the place of columns of these names."""
    docs = docs.drop(*(c for c in docs.columns if c.lower() in ADDED))
    out = docs.withColumn("_v", verdict(F.col(text_col), order_rules(docs, given or rules(), text_col)))
    return out.select(*docs.columns, "_v.*", F.col("_v.rejected_by").isNull().alias("kept"))


def op5_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept")


OP5_SQL = r"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM base),
m AS (SELECT doc_id, text, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
  length(regexp_replace(text, '[^\p{L}]+', '', 'g')) AS n_letters, words FROM w),
g AS (SELECT doc_id, unnest(range(1, n_words - 6)) AS i, words FROM m WHERE n_words >= 8),
h AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS win FROM g),
d AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM h),
r AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM d WHERE c > 1) GROUP BY doc_id),
a AS (SELECT m.*, coalesce(r.n, 0) AS n_repeat_words FROM m LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM a)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND NOT n_symbols > greatest(n_words, 1) AND NOT (n_dup_lines >= 4 AND 2 * n_dup_lines > n_lines)
  AND NOT (word_chars > 20 * greatest(n_words, 1) OR word_chars < 2 * greatest(n_words, 1)) AND NOT 10 * n_letters < 4 * word_chars AS kept
FROM b
"""
