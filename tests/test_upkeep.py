"""Running aggregates over split keys, gaps, free session ids, renames, stages to a fixpoint, canonical JSON, published tables, echo and runs."""

import json
import random
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronotext.functions import text as T
from chronotext.operators import catalog as C
from chronotext.operators import incremental as I
from chronotext.operators import publish as P
from chronotext.operators import sequence as S
from chronotext.operators import work as W

# ---- running aggregates and gaps ----


@pytest.mark.parametrize("how", [F.max, F.sum])
def test_running_is_the_plain_window(spark, how):
    rng = random.Random(1)
    rows = [(None if k % 50 == 0 else "hot" if k % 3 else f"s{k % 7}", rng.randint(0, 900), k, None if rng.random() < 0.1 else rng.randint(-50, 50)) for k in range(600)]
    df = spark.createDataFrame(rows, "key string, at long, nth long, v long").withColumn("_bucket", F.lit("clash"))
    got = S.running(df, ["key"], [F.floor(F.col("at") / 10), F.floor(F.col("at") / 300)], [F.col("at"), F.col("nth")], F.col("v"), "before", how)
    seen, want = defaultdict(list), {}
    for key, at, nth, v in sorted(rows, key=lambda r: r[1:3]):
        known = [x for x in seen[key] if x is not None]
        want[nth] = (max(known) if how is F.max else sum(known)) if known else None
        seen[key].append(v)
    assert {r.nth: r.before for r in got.collect()} == want


def test_gaps_is_the_complement(spark):
    rng = random.Random(2)
    rows = [("touch", 0.0, 5.0), ("touch", 5.0, 9.0), ("over", 0.0, 50.0), ("over", 3.0, 4.0), ("over", 60.0, 61.0), ("one", 3.0, 4.0), ("bad", 5.0, 2.0), ("bad", None, 2.0), ("bad", 9.0, 9.0), ("bad", 12.0, 13.0), ("point", 1.0, 1.0)]
    for k in range(200):
        a = rng.randint(0, 2000)
        rows.append((f"r{k % 3}", float(a), float(a + rng.randint(0, 9))))
    got = sorted(map(tuple, S.gaps(spark.createDataFrame(rows, "s string, a double, b double"), ["s"], ("a", "b"), bucket=16.0).collect()))
    want = []
    for s in {r[0] for r in rows}:
        spans = sorted((a, b) for t, a, b in rows if t == s and a is not None and b >= a)
        done = spans[0][1]
        for a, b in spans[1:]:
            if a > done:
                want.append((s, done, a - done))
            done = max(done, b)
    assert got == sorted(want)
    assert {r[0] for r in got} >= {"over", "bad", "r0"} and not {r[0] for r in got} & {"touch", "one", "point"}
    few = S.gaps(spark.createDataFrame(rows, "s string, a double, b double"), ["s"], ("a", "b"), least=5.0, most=8.0)
    assert all(5 <= r.gap <= 8 for r in few.collect()) and few.count() == sum(5 <= w[2] <= 8 for w in want)
    assert S.gaps(spark.createDataFrame([], "s string, a double, b double"), ["s"], ("a", "b")).count() == 0


# ---- session ids ----


@pytest.mark.parametrize("seed", range(3))
def test_free_suffixes_one_by_one(spark, seed):
    rng = random.Random(seed)
    bases = ["a", "b", None, "hot"]
    taken = [(rng.choice(bases), rng.choice([None, -1, 0, *range(1, 25)])) for _ in range(60)] + [("full", k) for k in range(1, 30)]
    wanted = [(rng.choice(bases) if k % 2 else "hot", rng.choice([0, 1, 1, 2, 7, 20, 40]), k) for k in range(150)] + [("full", 1, 900), ("full", 5, 901), ("free", 3, 902)]
    got = C.free_suffixes(spark.createDataFrame(wanted, "base string, seq long, nth long"), spark.createDataFrame(taken, "base string, seq long"), "base", "seq", "nth", rows=8)
    used, want = defaultdict(set), {}
    for b, n in taken:
        used[b].add(n)
    for b, n, k in sorted(wanted, key=lambda r: (max(r[1], 1), r[2])):
        n = max(n, 1)
        while n in used[b]:
            n += 1
        used[b].add(n)
        want[k] = n
    assert {r.nth: r.suffix for r in got.collect()} == want
    none = C.free_suffixes(spark.createDataFrame(wanted, "base string, seq long, nth long").limit(0), spark.createDataFrame(taken, "base string, seq long"), "base", "seq", "nth")
    assert none.count() == 0


def test_rename_all_guards_its_targets(spark):
    parents = spark.createDataFrame([(k,) for k in range(1, 9)], "id long")
    children = spark.createDataFrame([(k % 10, k) for k in range(30)] + [(None, 99)], "id long, n long")
    moves = spark.createDataFrame([(1, 2), (3, 77), (4, 4), (5, 6), (5, 7), (8, 1), (9, 2)], "old long, new long")
    left, (moved,), refused = C.rename_all(parents, [children], "id", moves)
    assert sorted(r.id for r in left.collect()) == [2, 3, 4, 5, 6, 7, 8]
    assert {(r.old, r.new): r.reason for r in refused.collect()} == {(3, 77): "unknown_target", (4, 4): "itself", (5, 6): "moved_twice", (5, 7): "moved_twice", (8, 1): "target_moves"}
    want = sorted(((2 if k % 10 in (1, 9) else k % 10), k) for k in range(30))
    assert sorted(tuple(r) for r in moved.where("id IS NOT NULL").collect()) == want and moved.where("id IS NULL").count() == 1


# ---- stages ----


def test_auto_advance_stops_where_it_waits(spark):
    rows = [(1, "clean", None), (2, "clean", "structure"), (3, "structure", "draft"), (4, "draft", None), (5, "none", None), (6, None, None), (7, "clean", "draft")]
    df = spark.createDataFrame(rows, "session_id long, stage string, waits_at string")
    out = W.auto_advance(df, lambda r: r.withColumn("waits", F.col("stage") == F.col("waits_at")))
    assert {r.session_id: (r.stage, r.waits, r.advanced) for r in out.collect()} == {1: ("draft", False, 3), 2: ("structure", True, 1), 3: ("draft", True, 2), 4: ("draft", False, 0), 5: ("none", False, 0), 6: (None, False, 0), 7: ("draft", True, 3)}
    assert W.auto_advance(df.limit(0), lambda r: r.withColumn("waits", F.lit(False))).count() == 0


def test_fixpoint_reads_only_what_moves(spark):
    counts = []

    def step(df):
        counts.append(df.count())
        return df.withColumn("n", F.col("n") - 1).withColumn("_goes_on", F.col("n") > 0)

    out = W.fixpoint(spark.range(10).select(F.col("id").alias("n")), step, 5)
    assert counts == [10, 8, 7, 6, 5] and sorted(r.n for r in out.collect()) == [-1, 0, 0, 0, 0, 0, 1, 2, 3, 4]


# ---- canonical JSON ----


def _document(rng, depth=0):
    kind = rng.choice(["int", "text", "float", "null", "bool"] + ["dict", "list"] * (2 if depth < 4 else 0))
    if kind == "dict":
        return {rng.choice("abcdeéZ_") * rng.randint(1, 3): _document(rng, depth + 1) for _ in range(rng.randint(0, 5))}
    if kind == "list":
        return [_document(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    return {"int": rng.randint(-(10**12), 10**12), "text": "".join(rng.choice('ab"\\/\n\té ') for _ in range(rng.randint(0, 8))), "float": rng.randint(-999, 999) + 0.25, "null": None, "bool": rng.random() < 0.5}[kind]


def _shuffled(v, rng):
    if isinstance(v, dict):
        return {k: _shuffled(v[k], rng) for k in rng.sample(list(v), len(v))}
    return [_shuffled(x, rng) for x in v] if isinstance(v, list) else v


def test_canonical_json_is_pythons(spark):
    rng = random.Random(5)
    docs = [_document(rng) for _ in range(300)]
    rows = [(k, json.dumps(_shuffled(d, rng), indent=rng.choice([None, 2]), ensure_ascii=rng.random() < 0.5)) for k, d in enumerate(docs)]
    rows += [(k + 1000, json.dumps(_shuffled(d, rng))) for k, d in enumerate(docs)]
    df = spark.createDataFrame(rows, "k long, doc string").select("k", I.canonical_json(F.col("doc")).alias("c"), I.document_fingerprint(F.col("doc")).alias("f"))
    got = {r.k: (r.c, r.f) for r in df.collect()}
    for k, d in enumerate(docs):
        assert got[k][0] == json.dumps(d, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        assert got[k] == got[k + 1000]
    odd = spark.createDataFrame([("{",), ("",), (None,), ('{"a":1,"a":2}',), ("1.0",)], "doc string").select(I.canonical_json(F.col("doc")).alias("c"))
    assert [r.c for r in odd.collect()] == [None, None, None, None, "1"]


# ---- tables published together ----


def test_publish_is_all_or_nothing(spark, tmp_path):
    root = f"file://{tmp_path}/index"
    table = lambda n: spark.range(n).withColumn("v", F.lit(n))
    assert P.current(spark, root) == {} and P.version(spark, root) is None
    first = P.publish(root, {"a": table(2), "b": table(3)})
    count = lambda: {t: df.count() for t, df in P.current(spark, root).items()}
    assert count() == {"a": 2, "b": 3}
    broken = table(9).select(F.raise_error(F.lit("lost")).alias("id"))
    with pytest.raises(Exception, match="lost"):  # a is written, b fails: nobody sees the new a
        P.publish(root, {"a": table(5), "b": broken})
    assert count() == {"a": 2, "b": 3} and P.version(spark, root) == first

    def refuse(tables):
        if tables["a"].count() != tables["b"].count():
            raise ValueError("unequal")

    with pytest.raises(ValueError, match="unequal"):
        P.publish(root, {"a": table(7)}, guards=(refuse,))
    assert count() == {"a": 2, "b": 3}
    second = P.publish(root, {"a": table(3)}, guards=(refuse,), expected=first)  # b stays
    assert count() == {"a": 3, "b": 3}
    with pytest.raises(RuntimeError, match="meanwhile"):
        P.publish(root, {"a": table(1)}, expected=first)
    assert P.version(spark, root) == second
    assert P.prune(spark, root) == 3 and count() == {"a": 3, "b": 3}


# ---- echo and runs ----


def plain_echo(terms, key):
    """Covered share by a search a term."""
    spans, hit = [], 0
    for t in dict.fromkeys(t for t in terms if len(t) >= 2):
        at = key.find(t)
        hit += at >= 0
        while at >= 0:
            spans.append((at, at + len(t)))
            at = key.find(t, at + len(t))
    return hit, len({i for a, b in spans for i in range(a, b)}) / max(1, len(key))


def test_echo_equals_a_search_a_term(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abé字") for _ in range(rng.randint(0, 4)))
    for _ in range(300):
        terms, key = [word() for _ in range(rng.randint(0, 12))], "".join(word() for _ in range(rng.randint(0, 20)))
        known = list(dict.fromkeys(t for t in terms if len(t) >= 2))
        assert T.echo_spans(T.automaton(known), key) == plain_echo(terms, key)
    texts = ["aaaa", "", None, "abab字ab"]
    for terms in (["aa", "ab", "b字", "x", "aa"], []):  # another glossary in the same worker
        got = spark.createDataFrame([(t,) for t in texts], "k string").repartition(1).select("k", T.prompt_echo(terms)("k").alias("e")).collect()
        assert {r.k: (r.e.terms, r.e.coverage) for r in got} == {t: plain_echo(terms, t or "") for t in texts}


def test_echo_cost_does_not_grow_with_the_glossary():
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    texts = [word(400) for _ in range(400)]

    def seconds(n: int) -> float:
        found = T.automaton([word(7) for _ in range(n)])
        return min(_timed(lambda: [T.echo_spans(found, t) for t in texts]) for _ in range(3))

    assert seconds(20_000) < 10 * seconds(200)  # a search a term: a hundred times


def _timed(run) -> float:
    began = time.perf_counter()
    run()
    return time.perf_counter() - began


def plain_tiles(key: str) -> int:
    best = 0
    for u in range(1, min(12, len(key) // 2) + 1):
        units = [key[i : i + u] for i in range(0, len(key) - u + 1, u)]
        run = 1
        best = max(best, 1)
        for a, b in zip(units, units[1:]):
            run = run + 1 if a == b else 1
            best = max(best, run)
    return best


def test_tile_runs_by_shifts(spark):
    rng = random.Random(8)
    texts = ["", "a", "aa", "abab", "xabab", "😀😀😀", "abcabcabcabd"] + ["".join(rng.choice("ab") for _ in range(rng.randint(0, 30))) * rng.randint(1, 4) for _ in range(400)]
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    assert T.tile_runs(codes, np.array([len(t) for t in texts])).tolist() == [plain_tiles(t) for t in texts]
    assert T.tile_runs(np.zeros(0, np.uint32), np.zeros(3, np.int64)).tolist() == [0, 0, 0]
    got = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", T.longest_run(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in got if r.t in ("abab", "😀😀😀", "xabab")} == {"abab": 2, "😀😀😀": 3, "xabab": 1}
