"""Operator 2, personal data by rules and a skip-chain conditional random field.

Base rules find e-mail and IP addresses, card and phone numbers. The field labels the words that hold a digit
or an at sign. Its factors are a word's features, pairs of neighbouring words, and skip edges between distant
words of the same document with the same or a similar key (equal digits, equal last seven digits, equal local
part); all that are alike are linked to the first. Loopy belief propagation lets a clear mention settle an unclear
one far away. Its spans are added, without the words that base spans touch; base spans stay. Texts without a digit or an at sign have no such words and are not labelled.

The weights are fitted by pseudo-likelihood on sentences made here from a fixed seed, so they depend on no data.

Null and empty texts have no spans; null and repeated ids are returned as they come; an empty table gives no
rows; columns other than the id and the text are not read by the query.
"""

from __future__ import annotations

import hashlib
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
#: The belief that one of a span's words needs (of all it is the likeliest label). A text's messages are passed until
#: none moves by more than STILL; ROUNDS ends it for fields that never rest.
BELIEF, STILL, ROUNDS = 0.9, 1e-6, 500

_DIGIT = re.compile(rb"[0-9@]")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*")
_SPACE = re.compile(r"[\x20\x09-\x0D]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind, then start. Each rule takes time in proportion to the text."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:  # a local part is the run of its characters up to the sign, after the last match
        part = text[done:at]
        start = done + len(part.rstrip(_LOCAL))
        end = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((0, start, end := m.end()))
        done = end
        at = text.find("@", end)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m.group().split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((3, m.start(), m.end()))
    return out


# ---- the field ----

FEATURES = ("bias", "1 digit", "2-3", "4-6", "7-9", "10-12", "13-15", "16-19", "20+", "at", "at and dot", "three dots", "octets", "dots", "plus", "parentheses", "dash", "letters", "slash or colon", "only digits", "luhn", "equals or quote", "next to a number", "run of 10-15", "run of 16-19", "run has luhn")


def _features(words: list[str], near: list[tuple[bool, bool]], runs: list[str]) -> np.ndarray:
    x = np.zeros((len(words), len(FEATURES)), np.float32)
    for i, w in enumerate(words):
        digits = "".join(c for c in w if "0" <= c <= "9")
        n, run = len(digits), runs[i]
        on = [0] + ([1 if n == 1 else 2 if n <= 3 else 3 if n <= 6 else 4 if n <= 9 else 5 if n <= 12 else 6 if n <= 15 else 7 if n <= 19 else 8] if n else [])
        core = w.strip(".,;:!?\"'()[]<>")
        if "@" in core:
            on += [9] + [10] * ("." in core.rpartition("@")[2] and 0 < core.find("@") < len(core) - 3)
        if (dots := core.count(".")) == 3:
            on += [11] + [12] * all(p.isdecimal() and len(p) < 4 and int(p) < 256 for p in core.split("."))
        on += [13] * (dots in (1, 2)) + [14] * core.startswith("+") + [15] * ("(" in w) + [16] * ("-" in core) + [17] * any(c.isalpha() for c in core) + [18] * ("/" in core or ":" in core)
        on += [19] * core.isdecimal() + [20] * (16 <= n <= 19 and luhn(digits)) + [21] * ("=" in w or '"' in w) + [22] * any(near[i])
        on += [23] * (10 <= len(run) <= 15 and n < len(run)) + [24] * (16 <= len(run) <= 19 and n < len(run)) + [25] * (16 <= len(run) <= 19 and n < len(run) and luhn(run))
        x[i, on] = 1
    return x


def _skip_keys(w: str) -> list[str]:
    """Words with a key in common share a potential."""
    core = w.strip(".,;:!?\"'()[]<>").lower()
    digits = "".join(c for c in core if "0" <= c <= "9")
    keys = [f"={core}"] if len(core) > 4 else []
    if len(digits) >= 7:
        keys += [f"#{digits}", f"~{digits[-7:]}"]
    if "@" in core:
        keys.append(f"@{core.partition('@')[0]}")
    return keys


def graph(text: str) -> tuple[list[tuple[int, int]], np.ndarray, list[tuple[int, int]], list[tuple[int, int]]]:
    """Candidate words' places, their features, chain edges and skip edges of a document."""
    places = [m.span() for m in _WORD.finditer(text)]
    words = [text[a:b] for a, b in places]
    joined = [i > 0 and places[i][0] - places[i - 1][1] == 1 and "\n" not in text[places[i - 1][1] : places[i][0]] for i in range(len(words))]
    near = [(joined[i], i + 1 < len(words) and joined[i + 1]) for i in range(len(words))]
    runs: list[str] = []
    start = 0
    for i in range(1, len(words) + 1):
        if i == len(words) or not joined[i]:
            digits = "".join(c for c in text[places[start][0] : places[i - 1][1]] if "0" <= c <= "9") if i - start <= 5 else ""
            runs += [digits] * (i - start)
            start = i
    first: dict[str, int] = {}
    skip = set()
    for i, w in enumerate(words):
        for k in _skip_keys(w):
            if first.setdefault(k, i) != i:
                skip.add((first[k], i))  # to the first: any two that are alike are two steps apart at most
    return places, _features(words, near, runs), [(i - 1, i) for i in range(1, len(words)) if joined[i]], sorted(skip)


def beliefs(x: np.ndarray, chain: np.ndarray, skip: np.ndarray, weights: dict[str, np.ndarray], part: np.ndarray | None = None) -> np.ndarray:
    """Loopy belief propagation (log domain, damped): a row of label probabilities for each word. part numbers the texts
    of the words; a text's messages rest when its own stand still, so other texts don't matter to it."""
    node = x @ weights["node"]
    pair = np.concatenate([np.repeat(weights["chain"][None], len(chain), 0), np.repeat(weights["skip"][None], len(skip), 0)])
    a, b = np.concatenate([chain, skip]).astype(np.int64).reshape(-1, 2).T
    src, dst = np.concatenate([a, b]), np.concatenate([b, a])
    pot = np.concatenate([pair, pair.transpose(0, 2, 1)])
    msg, back = np.zeros((len(src), len(LABELS))), np.roll(np.arange(len(src)), len(a))
    part = np.zeros(len(x), np.int64) if part is None else part
    live = np.arange(len(src))
    for _ in range(ROUNDS):
        if not len(live):
            break
        total = node.astype(np.float64)
        np.add.at(total, dst[live], msg[live])
        new = (total[src[live]] - msg[back[live]])[:, :, None] + pot[live]
        top = new.max(1)
        new = top + np.log(np.exp(new - top[:, None, :]).sum(1))
        new = 0.5 * msg[live] + 0.5 * (new - new.max(1, keepdims=True))
        moved = np.zeros(part[-1] + 1)
        np.maximum.at(moved, part[src[live]], np.abs(new - msg[live]).max(1))
        msg[live] = new
        live = live[moved[part[src[live]]] > STILL]
    total = node.astype(np.float64)
    np.add.at(total, dst, msg)
    p = np.exp(total - total.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def made_document(rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A made text with its true spans: clear and unclear mentions, repeated ones, and numbers that are none."""
    word = lambda: "".join(rng.choice(("an", "the", "or", "ti", "el", "mo", "ra", "sch", "ver", "que")) for _ in range(rng.randint(1, 4)))
    digit = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    parts: list[tuple[str, int | None]] = []
    known: list[tuple[str, int]] = []
    for _ in range(rng.randint(3, 7)):
        parts += [(word(), None) for _ in range(rng.randint(1, 6) if rng.random() < 0.75 else 0)]  # mentions may touch
        r = rng.random()
        if known and r < 0.3:
            s, k = rng.choice(known)
            s = s.replace("+", "") if k == 3 and rng.random() < 0.5 else s
            s = s.replace(" ", ".") if k == 2 and rng.random() < 0.3 else s
            s = f"{s.partition('@')[0]}@{word()}" if k == 0 and rng.random() < 0.4 else s
            parts.append((s, k))
            continue
        kind = rng.choice((0, 1, 2, 3, None, None, None, None))
        if kind == 0:
            s = f"{word()}.{digit(2)}@{word()}{rng.choice('123')}.example.{rng.choice(('com', 'org'))}"
        elif kind == 1:
            s = ".".join(str(rng.randint(1, 255)) for _ in range(4))
        elif kind == 2:
            d = digit(15)
            d += next(c for c in "0123456789" if luhn(d + c))
            s = d if rng.random() < 0.6 else rng.choice(" -").join(d[i : i + 4] for i in range(0, 16, 4))
        elif kind == 3:
            s = f"+{rng.randint(1, 99)} ({digit(3)}) {digit(3)}-{digit(4)}" if rng.random() < 0.7 else f"+{digit(11)}"
        else:
            s = rng.choice((digit(1), f"{digit(1)}.{digit(1)}", f"19{digit(2)}", digit(rng.randint(1, 8)), f"{digit(1)}.{digit(1)}.{digit(1)}", f"password={digit(6)}ab{digit(5)}", f'"{digit(5)}fe{digit(20)}"', f"{digit(2)}:{digit(2)}", f"20{digit(2)}-{digit(2)}-{digit(2)}", digit(rng.randint(20, 26)), f"AK{digit(2)}QX{digit(3)}", f"{digit(3)}.{digit(3)}.{digit(3)}", f"{digit(3)}-{digit(4)}", f"@{word()}", f"{digit(4)} {digit(4)}", f"{digit(9)}", f"{digit(10)}", f"({digit(2)})"))
        if kind is not None:
            known.append((s, kind))
        parts.append((s, kind))
    text, spans = "", []
    for s, k in parts:
        text += " " * bool(text)
        if k is not None:
            spans.append((k, len(text), len(text) + len(s)))
        text += s
    return text, spans


@lru_cache(1)
def trained(documents: int = 1500, seed: int = 7, steps: int = 250) -> dict[str, np.ndarray]:
    """Weights by gradient ascent on the pseudo-likelihood of made documents."""
    rng = random.Random(seed)
    xs, ys, chains, skips, base = [], [], [], [], 0
    for _ in range(documents):
        text, spans = made_document(rng)
        places, x, chain, skip = graph(text)
        xs.append(x)
        ys += [next((k + 1 for k, s, e in spans if a < e and s < b), 0) for a, b in places]
        chains += [(i + base, j + base) for i, j in chain]
        skips += [(i + base, j + base) for i, j in skip]
        base += len(places)
    x, y = np.concatenate(xs).astype(np.float64), np.array(ys)
    one = np.eye(len(LABELS))[y]
    w = {"node": np.zeros((x.shape[1], len(LABELS))), "chain": np.zeros((len(LABELS),) * 2), "skip": np.zeros((len(LABELS),) * 2)}
    edges = {"chain": np.array(chains).reshape(-1, 2), "skip": np.array(skips).reshape(-1, 2)}
    moment = {k: np.zeros_like(v) for k, v in w.items()}
    for _ in range(steps):
        score = x @ w["node"]
        for k, e in edges.items():
            np.add.at(score, e[:, 1], w[k][y[e[:, 0]]])
            np.add.at(score, e[:, 0], w[k].T[y[e[:, 1]]])
        p = np.exp(score - score.max(1, keepdims=True))
        off = one - p / p.sum(1, keepdims=True)
        grad = {"node": x.T @ off}
        for k, e in edges.items():
            g = np.zeros_like(w[k])
            np.add.at(g, y[e[:, 0]], off[e[:, 1]])
            np.add.at(g.T, y[e[:, 1]], off[e[:, 0]])
            grad[k] = (g + g.T) / 2 if k == "skip" else g
        for k in w:
            moment[k] = 0.9 * moment[k] + grad[k] / len(y) - 2e-4 * w[k]
            w[k] = w[k] + 1.5 * moment[k]
    return w


def field_spans(texts: list[str], weights: dict[str, np.ndarray], known: list[list[tuple[int, int, int]]], belief: float = BELIEF) -> list[list[tuple[int, int, int]]]:
    """Spans that the field adds to each text's known ones; the texts are one graph of separate parts."""
    graphs = [graph(t) for t in texts]
    base = np.cumsum([0, *(len(g[0]) for g in graphs)])
    if not base[-1]:
        return [[] for _ in texts]
    p = beliefs(np.concatenate([g[1] for g in graphs]), *(np.array([(i + o, j + o) for g, o in zip(graphs, base, strict=False) for i, j in g[k]]).reshape(-1, 2) for k in (2, 3)), weights, np.repeat(np.arange(len(texts)), np.diff(base)))
    out = []
    for (places, _, chain, _), o, text, have in zip(graphs, base, texts, known, strict=False):
        found, joined = [], {j for _, j in chain}
        for i in range(len(places)):
            k = int(p[o + i].argmax())
            if not k:
                continue
            if found and i in joined and found[-1][0] == k - 1 and found[-1][1][-1] == i - 1:
                found[-1][1].append(i)
                found[-1][2] = max(found[-1][2], p[o + i, k])
            else:
                found.append([k - 1, [i], p[o + i, k]])
        spans = []
        taken = sorted((s, e) for _, s, e in have)
        starts = [s for s, _ in taken]
        far = np.maximum.accumulate([e for _, e in taken]) if taken else np.zeros(0)

        def trimmed(a, b, text=text):
            own = text[a:b]
            return a + len(own) - len(own.lstrip(".,;:!?\"'()[]<>")), b - len(own) + len(own.rstrip(".,;:!?\"'([]<>"))

        for k, run, sure in found:
            if sure < belief:
                continue
            last = None
            for i in run:  # the run's words that no known span touches
                a, b = trimmed(*places[i])
                at = int(np.searchsorted(starts, b, "left"))  # known spans that start before this word's end
                if a < b and at and far[at - 1] > a:
                    continue
                if last == i - 1:
                    spans[-1] = (k, spans[-1][1], places[i][1])
                else:
                    spans.append((k, *places[i]))
                last = i
        spans = [(k, a, b) for k, a, b in ((k, *trimmed(a, b)) for k, a, b in spans) if a < b]
        out.append(spans)
    return out


def _scan(column: pa.Array, weights: dict[str, np.ndarray]) -> tuple[dict[int, str], dict[int, list], dict[int, list]]:
    """Texts with a digit or an at sign, their base spans, and the field's."""
    texts = {i: x.as_py() for i, x in enumerate(column) if x.is_valid and _DIGIT.search(memoryview(x.as_buffer()))}
    base = {i: base_spans(t) for i, t in texts.items()}
    more = field_spans(list(texts.values()), weights, list(base.values()))
    return texts, base, dict(zip(texts, more, strict=True))


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone and base_sha256 of the base rules, spans of rules and field, n_added."""
    weights = trained()
    empty = hashlib.sha256(b"").hexdigest()

    def rows(batches):
        for b in batches:
            _, base, more = _scan(b.column(1), weights)
            n = len(b.column(1))
            counts = np.zeros((5, n), np.int64)
            sha, spans = [empty] * n, [""] * n
            for i, own in base.items():
                for k, _, _ in own:
                    counts[k, i] += 1
                counts[4, i] = len(more[i])
                sha[i] = hashlib.sha256(_joined(own).encode()).hexdigest()
                spans[i] = _joined(own + more[i])
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in counts[:4]), pa.array(sha), pa.array(spans), pa.array(counts[4])], [id_col, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(rows, f"{id_col} {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each run of overlapping spans becomes its first kind's name in brackets."""
    out, done = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"[{KINDS[k].upper()}]"]
        done = max(done, b)
    return "".join(out) + text[done:]


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with spans replaced in the text; other columns stay as they are."""
    weights, names = trained(), docs.columns
    at = names.index(text_col)

    def rows(batches):
        for b in batches:
            texts, base, more = _scan(b.column(at), weights)
            changed = {i: redacted(t, base[i] + more[i]) for i, t in texts.items() if base[i] or more[i]}
            if changed:
                new = b.column(at).to_pylist()
                for i, t in changed.items():
                    new[i] = t
                b = b.set_column(at, b.schema.field(at), pa.array(new, b.column(at).type))
            yield b

    return docs.mapInArrow(rows, docs.schema)


def op2_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
