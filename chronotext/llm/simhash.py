"""Operator 10, near duplicates by SimHash fingerprints and vantage-point trees over Hamming distance.

One pass over the texts leaves 8 bytes a document. Equal fingerprints are one node. A tree of vantage points,
fitted on a bounded sample of fingerprints, cuts the nodes into shards: a point goes to the near or the far
side of a vantage point, and near points within the radius of the boundary go to both (the triangle bound:
two points whose distances to the vantage point differ by more than the radius can't be linked). Each shard
goes on splitting the same way and compares only inside its last blocks; it emits a spanning forest of its
links, never all pairs. Components are joined by large-star and small-star rounds on tables in the shared folder.

Near copies whose fingerprints lie further apart can be asked for too (similar_links): pairs of texts whose word
shingles have a Jaccard similarity of at least a given share, found by prefix filters, which lose none, and confirmed
exactly. A Hamming radius that held them all would reach so far that the tree could not prune.

Null and empty texts (and texts of white space only) have fingerprint zero and are linked like any other. A
null id is kept and never is a component's id unless no other is there; repeated rows are all returned; an
empty table gives no rows; columns that are not asked for are not read.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import located, materialize, picked, release, shuffle_partitions, table, trimmed

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Fingerprints on which the shared tree is fitted, the fingerprints that a shard should have, and the tree's size. A larger table has larger
#: shards (8 bytes a fingerprint), which the search splits further by their own points; nothing is left out.
SAMPLE, SHARD, MAX_SHARDS = 20_000, 16_000, 4096
#: Points compared with each other at the end of a branch.
BLOCK = 1024
#: Words of a shingle and the similarity of texts that a training set should hold once.
COPY_SHINGLE, COPY = 5, 0.8
#: Share of a text's shingles that a similar one of its size must share with it among the first ones.
PREFIX = 0.1
#: Shingles and texts that a task deals at once, and the seat of a shingle that several of them have.
DEALT, SEATS, MARK = 1 << 19, 60_000, 65_535

def fingerprint(text: str | bytes, shingle: int = SHINGLE) -> int:
    """64 bits, each set if it is set in over half of the shingles' XXH64; bytes.lower and split are ASCII only."""
    words = (text.encode() if isinstance(text, str) else text).lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    n = max(1, len(words) - shingle + 1)
    h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, n)
    # eight counters of a byte in a word: 255 rows can be added before one overflows
    bits = np.unpackbits(h.view(np.uint8)).view(np.uint64).reshape(n, 8)
    counts = np.add.reduceat(bits, np.arange(0, n, 255), axis=0).view(np.uint8).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n).view(np.uint64)[0])


def _small(batches):
    return (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000))


def fingerprints(docs: DataFrame, text_col: str, keep: list[str], shingle: int = SHINGLE) -> DataFrame:
    """The columns keep and fp, a signed long."""

    def score(batches):
        for b in batches:
            texts = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in b.column(0)]
            fp = np.fromiter((fingerprint(t, shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(fp.view(np.int64))], [*keep, "fp"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema) + ", fp long"
    return docs.select(F.col(text_col), *keep).mapInArrow(trimmed(lambda batches: score(_small(batches))), schema)


def _distance(points: np.ndarray, to: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ to)


def _vantage(points: np.ndarray, radius: int) -> tuple[np.uint64, int, float]:
    """(vantage point, median distance, share of points that go to both sides): the best of a few candidates."""
    best = None
    for c in points[:: max(1, len(points) // 8)][:8]:
        d = _distance(points[:: max(1, len(points) // 4096)], c)
        for m in {int(np.quantile(d, q)) for q in (0.4, 0.5, 0.6)}:
            near, both = float((d <= m).mean()), float(((d <= m) & (d > m - radius)).mean())
            cost = max(near, 1 - near + both) + both
            if best is None or cost < best[0]:
                best = (cost, c, m, both)
    return best[1], best[2], best[3]


def fit_tree(points: np.ndarray, shards: int, radius: int = RADIUS) -> list:
    """Nested [vantage point, distance, near, far], or the number of a shard."""
    number = iter(range(1 << 30))

    def grow(own: np.ndarray, n: int):
        if n <= 1 or len(own) < 16:
            return next(number)
        v, m, _ = _vantage(own, radius)
        d = _distance(own, v)
        near, far = own[d <= m], own[d > m - radius]
        if max(len(near), len(far)) > 0.95 * len(own):
            return next(number)
        return [int(v), m, grow(near, round(n / 2)), grow(far, n - round(n / 2))]

    return grow(points, shards)


def route(points: np.ndarray, tree, radius: int = RADIUS) -> list[tuple[int, np.ndarray]]:
    """(shard, its points); a point within the radius of a boundary is in the shards of both sides."""
    if isinstance(tree, int):
        return [(tree, points)]
    v, m, near, far = tree
    d = _distance(points, np.uint64(v))
    return route(points[d <= m], near, radius) + route(points[d > m - radius], far, radius)


def links(points: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each distinct point, the index of the first point of its component within these points."""
    label = np.arange(len(points))

    def union(i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = label[i], label[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            low = np.minimum(a, b)
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            while not np.array_equal(nxt := label[label], label):
                label[:] = nxt

    stack = [np.arange(len(points))]
    while stack:
        own = stack.pop()
        if len(own) > BLOCK:
            v, m, both = _vantage(points[own], radius)
            d = _distance(points[own], v)
            near, far = own[d <= m], own[d > m - radius]
            if both < 0.5 and max(len(near), len(far)) < 0.9 * len(own):
                stack += [near, far]
                continue
        p = points[own]
        for s in range(0, len(own), BLOCK):
            for t in range(s, len(own), BLOCK):  # both sides in blocks: memory is bounded where a branch won't split
                i, j = np.nonzero(np.bitwise_count(p[s : s + BLOCK, None] ^ p[None, t : t + BLOCK]) <= radius)
                up = t + j > s + i
                union(own[s + i[up]], own[t + j[up]])
    return label


def fingerprint_links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """u, v with u > v: enough links between distinct fingerprints to join each component."""
    spark = nodes.sparkSession
    n = nodes.count()
    # a bounded sample to fit the tree on; every fingerprint is indexed by it
    sample = np.array([r[0] for r in nodes.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    tree = fit_tree(sample, min(MAX_SHARDS, -(-n // SHARD)), radius) if n > SHARD else 0

    def deal(batches):
        for b in batches:
            for shard, own in route(np.asarray(b.column(0)).view(np.uint64), tree, radius):
                if len(own):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), shard, np.int32)), pa.array(own.view(np.int64))], ["shard", "fp"])

    def search(group: pa.Table) -> pa.Table:
        fp = np.unique(group.column("fp").to_numpy())
        root = fp[links(fp.view(np.uint64), radius)]  # sorted, so the root is the least
        own = root != fp
        return pa.table({"u": fp[own], "v": root[own]})

    return nodes.select("fp").mapInArrow(deal, "shard int, fp long").groupBy("shard").applyInArrow(search, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """u, root for every node that isn't its component's least: large-star and small-star rounds until still."""

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]

    edges = materialize(edges.where("u > v").distinct(), "links")
    before = state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = materialize(large, "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        former, edges = edges, materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        release(former, large)
        if (now := state(edges)) == before:
            break
        before = now
    out = edges.select("u", F.col("v").alias("root"))
    out._chronotext = edges._chronotext
    return out


def shingles(text: bytes, size: int = COPY_SHINGLE) -> np.ndarray:
    """The distinct XXH64 of a text's word shingles, ascending; a text of fewer words is one shingle."""
    words = text.lower().split()
    if len(words) < size:
        grams = [b" ".join(words)] if words else []
    else:
        grams = list(map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams), np.uint64, len(grams)))


def _least_common(n, similar: float):
    """How many of n shingles a text must share with another at that similarity."""
    return np.ceil(n * similar - 1e-9).astype(np.int64)


def _first(b: pa.RecordBatch, similar: float, share: float):
    """For each row (node, text): node, n, its number of distinct shingles, and so many of the least of them that a similar text has share of n
    in common with them; all of them for a share of similar."""
    for node, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
        own = shingles(x.as_buffer().to_pybytes() if x.is_valid else b"")
        n = len(own)
        yield node, n, own[: n - _least_common(n, similar) + _least_common(n, share)] if share < similar else own


def _shared(rows: DataFrame, parts: int, own) -> DataFrame:
    """node, n, shared: how many of the shingles that own tells of a row's text another row's text has too. Rows are distinct texts. Shingles are dealt
    to parts by their hash, 6 bytes each (32 bits of it, and the text's seat in its batch), and counted there; what a part has counted goes back to
    the batch, not to a row for each text and part. Different shingles may be taken for equal, so a text may count more, never less. One that
    several texts of a batch have is settled there: only its mark is sent, so a common shingle costs its part no more than an entry for
    each batch. A part's shingles are held at once."""
    lists = lambda ends, v: pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(v))
    none = lambda rows, kind: pa.array([[]] * rows, pa.list_(kind))

    def cut(held: list) -> pa.RecordBatch:
        nodes, n, firsts = zip(*held, strict=True)
        keys, seats = np.concatenate(firsts), np.repeat(np.arange(len(held)), [len(f) for f in firsts])
        order = np.argsort(keys, kind="stable")
        keys, seats = keys[order], seats[order]
        several = np.zeros(len(keys), bool)
        several[1:] = keys[1:] == keys[:-1]
        several[:-1] |= several[1:].copy()
        settled = np.bincount(seats[several], minlength=len(held)).astype(np.int32)
        marks = np.unique(keys[several])
        keys, seats = np.concatenate([keys[~several], marks]), np.concatenate([seats[~several], np.full(len(marks), MARK)]).astype(np.uint16)
        part = ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % parts
        keys = keys.astype(np.uint32)
        order = np.lexsort((keys, part))
        ends = np.searchsorted(part[order], np.arange(parts + 1))
        home = np.where(np.arange(parts + 1) > nodes[0] % parts, len(held), 0)  # the part that the batch's texts go with
        columns = [lists(ends, keys[order].view(np.int32)), lists(ends, seats[order].view(np.int16)), lists(home, np.array(nodes, np.int64)), lists(home, np.array(n, np.int32)), lists(home, settled)]
        return pa.RecordBatch.from_arrays([pa.array(np.arange(parts), pa.int32()), pa.array(np.full(parts, nodes[0], np.int64)), *columns], ["part", "batch", "keys", "seats", *batch])

    def deal(batches):
        held, size = [], 0
        for b in _small(batches):
            for text in own(b):
                held.append(text)
                size += len(text[2])
                if size >= DEALT or len(held) == SEATS:
                    yield cut(held)
                    held, size = [], 0
        if held:
            yield cut(held)

    def count(batches):
        of, keys, seats, rows = [], [], [], []
        for b in batches:
            lens = np.asarray(pc.list_value_length(b.column("keys")))
            rows.append(np.repeat(np.arange(len(of), len(of) + b.num_rows, dtype=np.int32), lens))
            of += b.column("batch").to_pylist()
            keys.append(b.column("keys").flatten().to_numpy())
            seats.append(b.column("seats").flatten().to_numpy().view(np.uint16))
            home = b.filter(pc.greater(pc.list_value_length(b.column("nodes")), 0))
            yield pa.RecordBatch.from_arrays([home.column("batch"), none(home.num_rows, pa.int16()), none(home.num_rows, pa.int32()), *(home.column(c) for c in batch)], ["batch", "seats", "counts", *batch])
        if sum(map(len, keys)):
            keys, seats, rows = (np.concatenate(v) for v in (keys, seats, rows))
            order = np.argsort(keys, kind="stable")
            keys, seats, rows = keys[order], seats[order], rows[order]
            start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            lens = np.diff(np.append(start, len(keys)))
            found = np.repeat((lens > 1) | np.logical_or.reduceat(seats == MARK, start), lens) & (seats != MARK)
            code, n = np.unique(rows[found].astype(np.int64) << 16 | seats[found], return_counts=True)
            ends = np.searchsorted(code >> 16, np.arange(len(of) + 1))
            out = [pa.array(of, pa.int64()), lists(ends, code.astype(np.uint16).view(np.int16)), lists(ends, n.astype(np.int32)), none(len(of), pa.int64()), none(len(of), pa.int32()), none(len(of), pa.int32())]
            out = pa.RecordBatch.from_arrays(out, ["batch", "seats", "counts", *batch])
            yield out.filter(pa.array(np.diff(ends) > 0))

    def total(group: pa.Table) -> pa.Table:
        seats, counts, nodes, n, settled = (group.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("seats", "counts", *batch))
        shared = settled + np.bincount(seats.view(np.uint16), weights=counts, minlength=len(nodes)).astype(np.int64)
        some = shared > 0
        return pa.table({"node": nodes[some], "n": n[some], "shared": shared[some]})

    batch, kinds = ("nodes", "n", "settled"), "nodes array<long>, n array<int>, settled array<int>"
    dealt = rows.mapInArrow(trimmed(deal), f"part int, batch long, keys array<int>, seats array<smallint>, {kinds}")
    counted = dealt.repartitionById(parts, F.col("part")).mapInArrow(trimmed(count), f"batch long, seats array<smallint>, counts array<int>, {kinds}")
    return counted.groupBy("batch").applyInArrow(total, "node long, n int, shared long")


def shared_counts(rows: DataFrame, parts: int) -> DataFrame:
    """node, shared: how many of the shingles in first another text has (a copy of the text is none). Of a text's copies one row is taken."""
    own = lambda b: ((node, len(x), np.array(x, np.int64).view(np.uint64)) for node, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
    return _shared(rows.select("node", "first").dropDuplicates(["node"]), parts, own).select("node", "shared")


def _suspects(texts: DataFrame, similar: float, share: float) -> DataFrame:
    """node, n of those of the distinct texts (node, text) that have enough of their first shingles, or of all, in common with others."""
    # the other text may be smaller by the factor similar, and then shares so many less of the first; of all there must be as many
    enough = F.ceil(F.col("n") * (share * similar if share < similar else similar) - 1e-9)
    return _shared(texts, shuffle_partitions(texts.sparkSession), lambda b: _first(b, similar, share)).where(F.col("shared") >= enough).select("node", "n")


def similar_links(docs: DataFrame, place: Column, rows: DataFrame, similar: float = COPY) -> DataFrame:
    """u, v with u > v: fingerprints of texts of that similarity. docs: node (which names a text), text, found by their place; rows: node, fp, _at
    (the place). Enough links to join each component: texts that a shared pivot has already joined are not compared again."""

    def explode(batches):
        for b in _small(batches):
            own = [shingles(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in b.column(1)]
            ends = pa.array(np.concatenate([[0], np.cumsum([len(h) for h in own])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.uint64), *own]).view(np.int64)))], ["node", "keys"])

    # one row of each text; then those with enough of the first shingles in common with others, then of all. The texts are read again each time
    nodes = materialize(rows.groupBy("node").agg(F.first("fp").alias("fp"), F.min("_at").alias("_at")), "texts")
    for share in (PREFIX, similar):
        own = picked(docs, place, nodes.select("_at.*")).select("node", "text")
        left = nodes.join(_suspects(own, similar, share).hint("merge"), "node").select("node", "fp", "_at", *(["n"] if share == similar else []))
        former, nodes = nodes, materialize(left, "suspects")
        del own, left
        release(former)
    suspects, nodes = nodes, nodes.drop("_at")
    own = picked(docs, place, suspects.select("_at.*"))
    all_keys = materialize(own.select("node", "text").mapInArrow(trimmed(explode), "node long, keys array<long>"), "shingles")
    every = all_keys.select("node", F.explode("keys").alias("key"))
    twice = every.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    # the rarest shingles first, so that a common passage pairs no texts that are not made of it
    sets = every.join(twice.hint("merge"), "key").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("keys")).join(nodes, "node")
    least = F.ceil(F.col("n") * similar - 1e-9).cast("int")
    sets = sets.where(F.size("keys") >= least).withColumn("take", F.size("keys") - least + 1)
    # a text whose shingles are those of many others is a good pivot: copies are likelier similar to their original than to each other
    sets = materialize(sets.withColumn("score", F.aggregate("keys", F.lit(0.0), lambda a, k: a + k["df"]) / F.col("n")), "sets")
    del every, twice, own
    release(all_keys, suspects)
    places = sets.select("node", "n", "score", F.size("keys").alias("size"), F.posexplode(F.slice("keys", 1, F.col("take"))).alias("pos", "k"))
    prefix = materialize(places.select(F.col("k.key").alias("key"), "node", "n", "score", (F.col("size") - F.col("pos")).alias("left")), "prefixes")
    # of the shingles from this one on, which are left on both sides, there must be enough: true of the first that two similar texts share
    may = "least(n, m) >= greatest(n, m) * {0} - 1e-9 AND least(left, other_left) >= {0} / (1 + {0}) * (n + m) - 1e-9".format(similar)

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Those pairs of node, other that are similar; a and b are their fingerprints."""
        a = sets.select("node", F.col("fp").alias("a"), "n", F.col("keys.key").alias("x"))
        b = sets.select(F.col("node").alias("other"), F.col("fp").alias("b"), F.col("n").alias("m"), F.col("keys.key").alias("y"))
        both = pairs.select("node", "other").distinct().join(a, "node").join(b, "other").withColumn("both", F.size(F.array_intersect("x", "y")))
        return materialize(both.where(F.col("both") >= similar * (F.col("n") + F.col("m") - F.col("both")) - 1e-9).select("node", "other", "a", "b"), "similar")

    def starred(at: DataFrame) -> DataFrame:
        """Texts (key, node, n, score, left, root) against the best text of each key: one partner a text, the most likely one."""
        best = at.groupBy("key").agg(F.max(F.struct("score", F.col("node").alias("other"), F.col("n").alias("m"), F.col("left").alias("other_left"), F.col("root").alias("to"))).alias("p"))
        pairs = at.join(best.select("key", "p.other", "p.m", "p.other_left", "p.to"), "key").where(f"root <> to AND {may}")
        return confirmed(pairs.groupBy("node").agg(F.max_by("other", F.struct(-F.abs(F.col("n") - F.col("m")), F.col("other"))).alias("other")))

    def rooted(found: DataFrame) -> DataFrame:
        """The prefixes with their texts' components, only of keys that are in several."""
        root = components(found.select(F.greatest("node", "other").alias("u"), F.least("node", "other").alias("v")))
        at = prefix.join(root.withColumnRenamed("u", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
        apart = at.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
        out = materialize(at.join(apart, "key", "left_semi"), "rooted")
        release(root)
        return out

    first = starred(prefix.withColumn("root", F.col("node")))
    at = rooted(first)
    # those that their first pivot has not taken have another one
    pivot = at.groupBy("key").agg(F.max_by("root", F.struct("score", "node")).alias("to"))
    second = starred(at.join(pivot, "key").where("root <> to").drop("to"))
    found = materialize(first.unionByName(second), "similar")
    release(first, second, at)
    at = rooted(found)
    # texts of a key that no pivot has joined: each with those of other components
    side = at.select("key", F.col("node").alias("other"), F.col("n").alias("m"), F.col("left").alias("other_left"), F.col("root").alias("to"))
    rest = confirmed(at.join(side, "key").where(f"node > other AND root <> to AND {may}"))
    found = found.unionByName(rest)
    out = found.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    out = materialize(out, "links")
    release(sets, prefix, at, rest)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), shingle: int = SHINGLE, radius: int = RADIUS, similar: float | None = None) -> DataFrame:
    """id, the columns keep, fp, component_id (least id of the component) and component (a fingerprint that names it).
    With similar, texts whose COPY_SHINGLE-word shingles are that similar are linked too."""
    if similar is None:
        rows = materialize(fingerprints(docs, text_col, [id_col, *keep], shingle), "fingerprints")
    else:
        own, place = located(docs.select(id_col, text_col, *keep), "texts")
        own = own.withColumn("_at", place).withColumn("text", F.coalesce(F.col(text_col), F.lit(""))).withColumn("node", F.xxhash64("text"))
        rows = materialize(fingerprints(own, "text", [id_col, *keep, "node", "_at"], shingle), "fingerprints")
    nodes = materialize(rows.groupBy("fp").agg(F.min(id_col).alias("least")), "nodes")
    found = fingerprint_links(nodes, radius)
    if similar is not None:
        more = similar_links(own, own["_at"], rows, similar)
        found = found.unionByName(more)
    of = components(found)
    members = nodes.join(of.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("component"))
    members = materialize(members, "members")
    # only components of several fingerprints need a look at each other
    linked = members.join(of.select(F.col("root").alias("component")).distinct(), "component", "left_semi")
    low = linked.groupBy("component").agg(F.min("least").alias("low"))
    named = members.join(low, "component", "left").select("fp", "component", F.when(F.col("low").isNull(), F.col("least")).otherwise(F.col("low")).alias("component_id"))
    named = materialize(named, "named")
    release(nodes, members, of, *([more] if similar is not None else []))
    return rows.join(named, "fp").select(id_col, *keep, "fp", "component_id", "component")


def op10_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
