"""Operators 11 to 13 against brute force and exact arithmetic."""

import hashlib
import heapq
import math
import random
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows
from pyspark.sql import functions as F

from chronotext.llm import tier_packing, turn_repair, whitening, word_tokens

# ---- 11 ----


def test_product_is_double_double():
    rng = np.random.default_rng(0)
    a, b = (rng.normal(size=s) * 10.0 ** rng.integers(-6, 6, size=s) for s in ((4, 900), (900, 3)))
    high, low = whitening.product(a, b)
    for i in range(4):
        for j in range(3):
            terms = [Fraction(x) * Fraction(y) for x, y in zip(a[i], b[:, j], strict=True)]
            assert abs(Fraction(high[i, j]) + Fraction(low[i, j]) - sum(terms)) <= sum(map(abs, terms)) * Fraction(1, 10**28)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 40, 130])
@pytest.mark.parametrize("kind", ["random", "identity", "low rank", "clustered", "zero", "graded"])
def test_divide_and_conquer(n, kind):
    rng = np.random.default_rng(n)
    r = rng.normal(size=(n, max(1, n // 3)))
    m = {
        "random": lambda: rng.normal(size=(n, n)),
        "identity": lambda: 3 * np.eye(n),
        "low rank": lambda: r @ r.T,
        "clustered": lambda: np.diag(1 + 1e-14 * np.arange(n)) + 1e-9 * np.ones((n, n)),
        "zero": lambda: np.zeros((n, n)),
        "graded": lambda: np.outer(10.0 ** -np.arange(n).clip(0, 12), 10.0 ** -np.arange(n).clip(0, 12)) * rng.normal(size=(n, n)),
    }[kind]()
    m = m + m.T
    values, vectors = whitening.eigen((m, np.zeros_like(m)))
    scale = np.abs(m).max() or 1
    assert (np.diff(values) <= 1e-15 * scale).all()
    assert np.abs(np.linalg.eigvalsh(m)[::-1] - values).max() <= 1e-14 * n * scale
    assert np.abs(vectors.T @ vectors - np.eye(n)).max() <= 1e-13
    assert np.abs(m @ vectors - vectors * values).max() <= 1e-14 * n * scale


def test_secular_and_tridiagonal_parts():
    rng = np.random.default_rng(3)
    d, e = rng.normal(size=30), rng.normal(size=29)
    t = np.diag(d) + np.diag(e, 1) + np.diag(e, -1)
    values, vectors = whitening.divide(d, e)
    assert np.allclose(values, np.linalg.eigvalsh(t), atol=1e-13) and np.allclose(t @ vectors, vectors * values, atol=1e-12)
    a = rng.normal(size=(9, 9))
    a = a + a.T
    d, e, q = whitening.tridiagonal(a)
    assert np.allclose(q @ (np.diag(d) + np.diag(e, 1) + np.diag(e, -1)) @ q.T, a, atol=1e-13)


VECTORS = "vec_id long, embedding array<float>, width string, x string"


def _whole(r) -> bool:
    return bool(r) and all(v is not None and math.isfinite(v) for v in r)


def test_whitening_brute_force(spark):
    rng = random.Random(5)
    vectors = [[rng.gauss(0, 1 + k) for k in range(6)] for _ in range(300)]
    odd = [None, [], [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] * 6, [float("inf")] * 6, [1.0, 2.0], [-0.0] * 6, [0.0] * 6]
    table = [(k, v, "w", "y") for k, v in enumerate(vectors + odd + vectors[:1] * 200)] + [(None, vectors[3], None, None)]
    got = whitening.whiten(spark.createDataFrame(table, VECTORS).repartition(7)).toPandas()
    kept = [(i, v) for i, v, *_ in table if v is not None and _whole(v) and len(v) == 6]
    x = [[math.floor(256 * float(np.float32(c))) for c in v] for _, v in kept]
    fit = sorted(set(map(tuple, x)))
    n, total = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    assert set(got.n) == {n} and len(got) == 4 * len(kept)
    centre = [[Fraction(v) - Fraction(t, n) for v, t in zip(r, total, strict=True)] for r in fit]
    cov = np.array([[float(sum(r[i] * r[j] for r in centre) / n) for j in range(6)] for i in range(6)])
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1], basis[:, ::-1]
    want = defaultdict(list)
    for (i, _), r in zip(kept, x, strict=True):
        want[i].append((sum((n * v - t) ** 2 for v, t in zip(r, total, strict=True)), (np.array(r) - np.array(total) / n) @ basis[:, :4] / np.sqrt(values[:4])))
    sign = None
    for i, g in got.groupby("vec_id", dropna=False):
        dev, y = want[None if i != i else i][0]
        for c, w in enumerate(y, 1):
            mine = g[g.component == c]
            assert set(mine.deviation.map(int)) == {dev}
            sign = sign or {}
            s = sign.setdefault(c, np.sign(mine.whitened.iloc[0] * w))
            assert np.allclose(mine.whitened, s * w, atol=1e-10)
    assert np.allclose(got.drop_duplicates("component").sort_values("component").explained, values[:4] / values.sum(), rtol=1e-12)
    assert got.identity_error.max() < 1e-12 and got.identity_error.nunique() == 1


def test_covariance_is_compensated(spark):
    """A mean far beyond the spread: plain sums of squares lose all digits, the compensated ones none."""
    rng = random.Random(6)
    x = [[(1 << 40) + rng.randint(-3, 3), rng.randint(-3, 3)] for _ in range(5000)]
    fit = spark.createDataFrame([(r,) for r in {tuple(r) for r in x}], "x array<long>").repartition(5)
    n, total = whitening.sums(fit, 2)
    cov = whitening.covariance(fit, 2, n, whitening.mean_of(n, total))
    rows = sorted({tuple(r) for r in x})
    exact = [[sum((Fraction(r[i]) - Fraction(total[i], n)) * (Fraction(r[j]) - Fraction(total[j], n)) for r in rows) / n for j in range(2)] for i in range(2)]
    for i in range(2):
        for j in range(2):
            assert abs(Fraction(cov[0][i, j]) + Fraction(cov[1][i, j]) - exact[i][j]) < Fraction(1, 10**24)


def test_whitening_degenerate(spark):
    make = lambda t: whitening.whiten(spark.createDataFrame(t, VECTORS)).toPandas()
    assert len(make([])) == 0 and len(make([(1, None, "", ""), (2, [], "", "")])) == 0
    one = make([(1, [1.0, 2.0], "", ""), (2, [1.0, 2.0], "", "")])
    assert len(one) == 4 and one.whitened.isna().all() and one.explained.isna().all() and set(one.deviation.map(int)) == {0}
    line = make([(k, [float(k), 0.0], "", "") for k in range(5)])  # one direction only
    assert line[line.component == 1].whitened.notna().all() and line[line.component == 2].whitened.isna().all()
    huge = make([(k, [1e38 * (k - 1), 1.0], "", "") for k in range(3)])
    assert len(huge) == 6 and huge.identity_error.max() < 1e-6


def test_deviations_exact_when_long_overflows():
    x, n, total = np.array([[1 << 40, -5], [3, 7]]), 1 << 20, [-(1 << 59), 12]
    want = [sum((n * v - t) ** 2 for v, t in zip(r, total, strict=True)) for r in x.tolist()]
    assert [int(v) for v in whitening.deviations(x, n, total).to_pylist()] == want
    assert whitening.deviations(np.array([[1 << 61]]), 1 << 20, [0]).to_pylist() == [None]


# ---- 12 ----

PART = ["the", " ", "  ", "\n", "é", "à", ",", "'s", "12", "<|endoftext|>", "　", "Word", " of", "\x1c", "ß", "日本", "İ", "Σ", "É", "é", ".", "?!", "don't", "😀", "́", "\xa0", "×"]


@pytest.fixture(scope="module")
def word_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(word_tokens.word_vocabulary())


def test_word_encoder_equals_tokenizer(word_tokenizer):
    rng = random.Random(0)
    texts = ["".join(rng.choice(PART) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + [None, "", " \n"]
    ids, off = word_tokens.WordEncoder(word_tokens.word_vocabulary()).encode(pa.array(texts))
    for k, t in enumerate(texts):
        assert ids[off[k] : off[k + 1]].tolist() == word_tokenizer.encode(t or "", add_special_tokens=False).ids


def _check_packing(got, texts: list[tuple], tokenizer, max_tokens: int, end_id: int = 2) -> int:
    """Each id in one piece, sequences gapless; the padding to max_tokens."""
    want = defaultdict(list)
    for i, t in texts:
        want[i].append(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, end_id], "<u4").tobytes())
    own = defaultdict(list)
    for r in got:
        own[r.doc_id].append((r.start, r.length, r.doc_tokens, bytes(r.ids)))
        assert len(r.ids) == 4 * r.length > 0
    assert set(own) == set(want)
    for i, parts in own.items():
        left = list(want[i])
        if len(left) == 1:
            assert b"".join(p[3] for p in sorted(parts)) == left[0] and {p[2] for p in parts} == {len(left[0]) // 4}
            assert all(sum(q[1] for q in sorted(parts)[:k]) == p[0] for k, p in enumerate(sorted(parts)))
        else:  # a repeated id
            assert sorted(b"".join(p[3] for p in parts)) == sorted(b"".join(left))
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length, r.tier))
    padding = 0
    for s in sequences.values():
        at = 0
        for offset, n, tier in sorted(s):
            assert offset == at and tier == sum(x[1] for x in s) <= max_tokens
            at += n
        padding += 0 if at & (at - 1) == 0 else max_tokens - at
    return padding


def test_tier_packing_whole(spark, word_tokenizer):
    rng = random.Random(2)
    texts = [None, "", " \n\t", "a", "word " * 9000, "<|endoftext|> é 日本"] + [" ".join(rng.choice(PART) for _ in range(rng.choice([3, 30, 300, 900]))) for _ in range(120)]
    table = [(k, t, "x") for k, t in enumerate(texts)] + [(7, texts[7], "x"), (None, "null id", None)]
    docs = spark.createDataFrame(table, "doc_id long, text string, ids string").repartition(3)
    for kwargs in ({}, {"max_tokens": 512, "least_tier": 64, "step_tokens": 2048, "window": 700}):
        got = tier_packing.pack_tiers(docs, **kwargs).collect()
        assert _check_packing(got, [r[:2] for r in table], word_tokenizer, kwargs.get("max_tokens", 4096)) == 0
        steps = defaultdict(dict)
        for r in got:
            steps[r.step][r.sequence_id] = r.tier
        assert all(sum(s.values()) <= kwargs.get("step_tokens", 65_536) for s in steps.values())
    assert tier_packing.pack_tiers(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        tier_packing.pack_tiers(docs, max_tokens=1000)


def test_windows_fill_long_gaps_from_shorter_tiers():
    rng = random.Random(8)
    pool = tier_packing.Pool()
    lengths = [rng.randint(1, 4096) for _ in range(3000)]
    for k, n in enumerate(lengths):
        pool.put((k, 0, n))
    full = list(tier_packing.windows(pool, 4096, 256, True))
    seen = defaultdict(list)
    for s in full:
        assert sum(p[2] for p in s) in {1 << k for k in range(13)}
        for d, a, n in s:
            seen[d].append((a, n))
    assert pool.total == 0
    for d, parts in seen.items():
        assert sum(n for _, n in parts) == lengths[d] and all(a == sum(n for _, n in sorted(parts)[:k]) for k, (a, _) in enumerate(sorted(parts)))
    long = [s for s in full if s[0][2] > 2048]
    assert len(long) >= 0.9 * sum(n > 2048 for n in lengths)  # long documents stay whole, in windows of their tier
    assert sum(map(len, seen.values())) < 1.6 * len(lengths)


def test_steps_are_full_and_even():
    rng = random.Random(9)
    sequences = [[(0, 0, size // k)] * k for size, k in ((rng.choice([256, 512, 1024, 2048, 4096]), rng.choice([1, 2, 4, 8])) for _ in range(900))]
    step = tier_packing.steps(sequences, 16_384)
    tokens, work = defaultdict(int), defaultdict(int)
    for s, k in zip(sequences, step, strict=True):
        tokens[k] += sum(p[2] for p in s)
        work[k] += sum(p[2] ** 2 for p in s)
    last = max(tokens)
    assert all(v == 16_384 for k, v in tokens.items() if k != last)
    even = [v for k, v in work.items() if k != last]
    assert max(even) < 1.35 * sum(even) / len(even)


def test_op12_query(spark, sf, word_tokenizer):
    got = tier_packing.op12_tier_packing(spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    parts = got.sort_values(["doc_id", "start"]).groupby("doc_id")
    assert len(parts) == len(docs)
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        ids = np.array([*word_tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        g = parts.get_group(i)
        assert [(a, n, c) for a, n, c in zip(g.start, g.length, g.ids_crc32, strict=True)] == [(a, n, zlib.crc32(ids[a : a + n].tobytes())) for a, n in zip(g.start, g.length, strict=True)]
        assert g.length.sum() == len(ids) == g.doc_tokens.iloc[0]


# ---- 13 ----


def cheapest(initials: str, faults: str) -> tuple[int, str]:
    """Least (cost, audit) by a search over whole strings."""
    heap, seen = [(0, "", 0, 0)], set()
    while True:
        cost, s, i, q = heapq.heappop(heap)
        if (i, q) in seen:
            continue
        seen.add((i, q))
        if i == len(initials) and q in (0, 3):
            return cost, s
        then = 3 if q == 2 else 2
        heapq.heappush(heap, (cost + 3, s + "I", i, then))
        if i < len(initials):
            heapq.heappush(heap, (cost + 4, s + "D", i + 1, q))
            if faults[i] in ".t":
                more, x = 3 * (faults[i] == "t"), initials[i]
                if (x, q) == ("s", 0):
                    heapq.heappush(heap, (cost + more, s + "K", i + 1, 1))
                elif x == " ua"[then - 1]:
                    heapq.heappush(heap, (cost + more, s + "K", i + 1, then))
                heapq.heappush(heap, (cost + 3 + more, s + "R", i + 1, then))


def test_audit_is_cheapest_and_least():
    rng = random.Random(1)
    for _ in range(4000):
        n = rng.randint(0, 10)
        initials, faults = "".join(rng.choice("suax-") for _ in range(n)), "".join(rng.choice("...tbd") for _ in range(n))
        assert turn_repair.audit(initials, faults) == cheapest(initials, faults)


def test_distances_do_not_pass_the_start():
    far = turn_repair.distances("uaua" * 50, "." * 200)
    assert far[0] == 0 and max(far.values()) == 0


def plain_repair(turns: list[tuple]) -> dict:
    """conv_id -> the result of op13's contract, row by row."""
    groups = defaultdict(list)
    for c, t, r, x in turns:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        groups[c]
        if k:
            x = "" if k == 1 else x.translate(dict.fromkeys(map(ord, ".!?"))) if k == 2 else x
            groups[c] += [(t, "user" if k == 4 else r, x)] * (1 + (k == 3))
    out = {}
    for c, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen = "", set()
        for _, r, x in own:
            core = x.strip(" \t\n\x0b\x0c\r")
            faults += "b" if not core else "d" if (r, x) in seen else "t" if core[-1] not in ".!?" else "."
            seen.add((r, x))
        initials = "".join(r[:1] or "-" for _, r, _ in own)
        cost, letters = cheapest(initials, faults)
        lines, i, q = [], 0, 0
        for a in letters:
            if a == "I":
                q = 3 if q == 2 else 2
                lines.append(("user:", "assistant:")[q - 2])
                continue
            if a != "D":
                q = 1 if a == "K" and initials[i] == "s" else 3 if q == 2 else 2
                lines.append(f"{own[i][1] if a == 'K' else ('user', 'assistant')[q - 2]}:{own[i][2]}")
            i += 1
        there = [t for t, *_ in own if t is not None]
        gaps = max(there) - min(there) + 1 - len(set(there)) if there else 0
        illegal = sum(initials[k : k + 2] not in ("su", "ua", "au") for k in range(len(initials) - 1))
        out[c] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_turn_repair_odd_rows(spark, tmp_path, duck):
    rng = random.Random(11)
    texts = ["Yes.", "No", "", " ", "Why?\n", "x!\x0b", None, "é.", "long. " * 4000, "Yes."]
    turns = [(rng.choice([None, *range(40)]), rng.choice([None, *range(9)]), rng.choice(["user", "assistant", "system", "tool", "", None, "😀"]), rng.choice(texts)) for _ in range(900)]
    turns += turns[:60] + [(99, 10**12, "user", "Far."), (99, 5, "assistant", "Near.")]
    d = str(tmp_path)
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("flaw", F.lit("clash")).write.parquet(f"{d}/conversations.parquet")
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in turn_repair.op13_turn_repair(spark, d).collect()}
    assert got == plain_repair(turns)
    sql = turn_repair.OP13_SQL.replace("conversations", f"read_parquet('{d}/conversations.parquet/*.parquet')")
    assert rows(duck.sql(sql).df()) == rows(turn_repair.op13_turn_repair(spark, d).toPandas())


def test_turn_repair_clean_and_empty(spark):
    schema = "conv_id string, turn int, role string, text string"
    whole = [("c", 0, "system", "S."), ("c", 1, "user", "Q?"), ("c", 2, "assistant", "A.")]
    (r,) = turn_repair.repair(spark.createDataFrame(whole, schema)).collect()
    assert (r.audit, r.cost) == ("KKK", 0) and [tuple(t) for t in r.turns] == [x[2:] for x in whole]
    assert turn_repair.repair(spark.createDataFrame([], schema)).count() == 0
    (r,) = turn_repair.repair(spark.createDataFrame(whole, schema), present=F.lit(False)).collect()
    assert (r.gaps, r.cost, r.audit, r.turns) == (0, 0, "", [])


def test_op13_sql(spark, sf, duck):
    assert rows(turn_repair.op13_turn_repair(spark, sf).toPandas()) == rows(duck.sql(turn_repair.OP13_SQL).df())
