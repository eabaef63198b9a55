"""Near duplicates by SimHash fingerprints and covering locality-sensitive hashing.

A fingerprint's bit is set where over half of a text's shingle hashes have it. For radius r every bit position i
gets a nonzero vector f(i) of r + 1 bits, and table v (v = 1 .. 2^(r+1) - 1) keeps the bits i with an odd product
v·f(i). The vectors of r positions span at most r dimensions, so some v is orthogonal to all of them: its table
keeps none of those bits, and two fingerprints that differ just there fall into one bucket of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrowgrid.llm.common import arrow_map, written
from sparrowgrid.llm.components import components

SEED = 42
#: Fingerprints of a bucket that are compared in one block; larger buckets are split by flipped bits.
BUCKET = 512


def masks(bits: int, radius: int) -> list[int]:
    """The covering masks, one a table."""
    n = (1 << radius + 1) - 1
    return [sum(1 << i for i in range(bits) if (v & (1 + i % n)).bit_count() & 1) for v in range(1, n + 1)]


def shingles(text: str | None, words: int) -> list[bytes]:
    """Space-joined runs of words of the text with A-Z lowered; a shorter text is one shingle, one without words none."""
    w = text.encode().lower().split() if text else []  # bytes: only ASCII letters and white space
    if len(w) <= words:
        return [b" ".join(w)] if w else []
    joined = b" ".join(w)
    ends = list(accumulate(len(x) + 1 for x in w))
    starts = [0, *ends]
    return [joined[a : b - 1] for a, b in zip(starts, ends[words - 1 :], strict=False)]


def majority(hashes: np.ndarray) -> np.ndarray:
    """The set bits of each 64-bit lane in over half of the rows; ``hashes`` is (n, lanes)."""
    n, lanes = hashes.shape
    total = np.zeros(64 * lanes, np.int64)
    for k in range(0, n, 255):  # so many sums fit a byte
        bits = np.unpackbits(np.ascontiguousarray(hashes[k : k + 255]).view(np.uint8).reshape(-1, 8 * lanes), axis=1, bitorder="little")
        total += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(2 * total > n, bitorder="little").view(np.uint64) if n else np.zeros(lanes, np.uint64)


def fingerprint(text: str | None, words: int = 3) -> int:
    h = [xxhash.xxh64_intdigest(s, SEED) for s in shingles(text, words)]
    return int(majority(np.array(h, np.uint64).reshape(-1, 1))[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``(doc_id, fp)``, fp a signed 64-bit number; null texts and texts without words have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([fingerprint(t, words) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(got)], ["doc_id", "fp"])

    return arrow_map(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, "doc_id long, fp long")


def _forest(near: np.ndarray) -> np.ndarray:
    """The least member of each member's component, for a symmetric boolean matrix."""
    label = np.arange(len(near))
    while True:
        low = np.where(near, label[None, :], len(near)).min(1)
        low = np.minimum(low, label)
        low = low[low]
        if (low == label).all():
            return label
        label = low


def bucket_links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (t, key): a forest of the links inside each bucket, never all its pairs."""
    key, held = None, []

    def links(fps: list[int]) -> list[tuple[int, int]]:
        x = np.unique(np.array(fps, np.int64))
        near = np.bitwise_count((x[:, None] ^ x[None, :]).view(np.uint64)) <= radius
        label = _forest(near)
        return [(int(x[k]), int(x[m])) for k, m in enumerate(label) if k != m]

    for b in batches:
        out: list[tuple[int, int]] = []
        for t, k, fp in zip(*(b.column(c).to_pylist() for c in ("t", "key", "fp")), strict=True):
            if (t, k) != key:
                if len(held) > 1:
                    out += links(held)
                key, held = (t, k), []
            held.append(fp)
        cols = zip(*out, strict=True) if out else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["u", "v"])
    if len(held) > 1:
        got = links(held)
        cols = zip(*got, strict=True) if got else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["u", "v"])


def links(distinct: DataFrame, radius: int = 2, bucket: int = BUCKET) -> DataFrame:
    """``(u, v)`` edges whose components are those of all pairs of fingerprints within ``radius`` bits.

    Buckets of up to ``bucket`` fingerprints are compared in one block. Fingerprints of a larger one are unfolded to
    all numbers within radius / 2 bits of them: two of them are within the radius just if they share one, so each
    goes to the least that shares one. Those groups hold a ball's numbers at most, however large the bucket was.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    m = masks(64, radius)
    signed = [x - (1 << 64) if x >> 63 else x for x in m]
    table = F.array(*[F.lit(x) for x in signed])
    rows = distinct.select("fp", F.posexplode(table).alias("t", "mask")).select("t", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    counts = rows.groupBy("t", "key").agg(F.count("*").alias("n"))
    shared = written(counts.filter("n > 1"), "buckets")  # a bucket of one has no link
    own = rows.join(shared.filter(F.col("n") <= bucket).select("t", "key"), ["t", "key"])
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = own.repartition(parts, "t", "key").sortWithinPartitions("t", "key")
    cold = arrow_map(dealt, lambda batches: bucket_links(batches, radius), "u long, v long")
    hot = rows.join(shared.filter(F.col("n") > bucket).select("t", "key"), ["t", "key"], "left_semi").select("fp").distinct()
    flips = [0]
    for _ in range(radius // 2):
        flips = sorted({f ^ 1 << i for f in flips for i in range(64)} | set(flips))
    flip = F.explode(F.array(*[F.lit(f - (1 << 64) if f >> 63 else f) for f in flips]))
    balls = hot.select("fp", flip.alias("f")).select("fp", F.col("fp").bitwiseXOR(F.col("f")).alias("ball"))
    least = balls.groupBy("ball").agg(F.min("fp").alias("v"), F.count("*").alias("n")).filter("n > 1").select("ball", "v")
    return cold.unionByName(balls.join(least, "ball").select(F.col("fp").alias("u"), "v").filter("u <> v").distinct())


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """``(doc_id, fp, component_id)`` of every row: the least doc_id of the fingerprint's component.

    Equal fingerprints are one node, so copies are never paired. Rows with a null doc_id count as nodes' members but
    not as a component's id; a component of such rows alone has none.
    """
    prints = written(fingerprints(docs, words), "prints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(nodes.select("fp"), radius))
    of = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = of.groupBy("root").agg(F.min("least").alias("component_id"))
    member = of.join(ids, "root").select("fp", "component_id")
    return prints.join(member, "fp").select("doc_id", "fp", "component_id")


def digest(docs: DataFrame) -> DataFrame:
    got = near_duplicates(docs)
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# -- similarity joins beyond a few bits -------------------------------------------------------------
#: Words of a shingle, and the radius of a part's covering tables.
WORDS, RADIUS = 5, 2
#: Bits of a part and parts of a signature, up to SMALL documents and beyond: a part's tables keep 12 or 16 bits. At a
#: similarity of 0.8 a bit differs with probability 0.15, in texts of a few shingles up to 0.19, so a pair has a part
#: with RADIUS differing bits at most with probability 0.9999, in those texts 0.99 or more (0.98 beyond SMALL).
SMALL, PARTS, MANY_PARTS = 1 << 23, (21, 21), (28, 44)
#: Parts whose tables are dealt at once: bounds the shuffle files.
ROUND = 7
#: Lanes of 64 bits that check a candidate, and how many of their bits may differ, in all and in the first two lanes: at
#: a similarity of 0.8 one in 6.6 does, that is 38.8 of 256 and 19.4 of 128, or up to 49 and 24 in texts of a few
#: shingles, which pass with probability 0.998. Unrelated texts differ in 128 of 256 and so are 7 deviations away; with
#: two lanes alone and 36 bits they were 5, and such pairs tied groups of a corpus of millions together.
CHECKS, DIFFERING, FIRST = 4, 68, 44
#: Members of a bucket that one task compares; a larger bucket is dealt to a triangle of tasks.
MEMBERS = 4096
#: Members of a group of candidates whose shingles one task compares; a larger group is dealt like a large bucket.
MATCHED = 256
#: Rows that are gathered before their buckets are compared, pairs compared at once, and members of a bucket from which
#: on it is compared alone.
GATHER, BLOCK, ALONE = 1 << 17, 1 << 14, 256
#: Edges that are held to be replaced by a forest's.
FOREST = 1 << 20
#: Odd numbers that tell apart a shingle's words, and a hash's lanes.
_ODD = np.random.default_rng(5).integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def _scatter(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Words(dict):
    """Words' hashes, made when they are first asked for; it is emptied when it is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= Signer.CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return h


class Signer:
    """Texts to signatures of ``lanes`` 64-bit numbers, by shingles of words with A-Z lowered."""

    #: Words kept with their hashes.
    CACHE = 100_000

    def __init__(self, words: int, lanes: int) -> None:
        self.n, self.lanes, self.words = words, lanes, _Words()

    def shingles(self, text: str | None) -> np.ndarray:
        """The sorted distinct hashes of a text's shingles."""
        w = text.encode().lower().split() if text else []
        if not w:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(self.words.__getitem__, w), np.uint64, len(w))
        n = min(self.n, len(w))
        each = _scatter(h + _ODD[:n, None]) * _ODD[:n, None]
        s = each[0, : len(w) - n + 1].copy()
        for k in range(1, n):
            s += each[k, k : len(w) - n + 1 + k]
        s.sort()
        return s[np.concatenate([[True], s[1:] != s[:-1]])]

    def signature(self, s: np.ndarray) -> np.ndarray:
        return majority(_scatter(s[:, None] ^ _ODD[None, 32 : 32 + self.lanes]))


def set_node(s: np.ndarray) -> int:
    """A set of shingles as a signed 64-bit number."""
    x = xxhash.xxh64_intdigest(s.tobytes(), SEED)
    return x - (1 << 64) if x >> 63 else x


def _root(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = parent[x]
        if (up == parent[up]).all():
            return up
        parent[x] = parent[up]
        x = up


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while len(a):
        x, y = _root(parent, a), _root(parent, b)
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        if len(a):
            np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) to those of a forest with the same components, or of a few, each of FOREST / 2 edges or more."""
    held: list[np.ndarray] = []
    size = 0

    def solve(edges: np.ndarray) -> np.ndarray:
        nodes, at = np.unique(edges, return_inverse=True)
        a, b = at.reshape(2, -1)
        parent = np.arange(len(nodes))
        _unite(parent, a, b)
        top = _root(parent, np.arange(len(nodes)))
        own = np.flatnonzero(top != np.arange(len(nodes)))
        return np.stack([nodes[own], nodes[top[own]]])

    def rows(edges: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(edges[0]), pa.array(edges[1])], ["u", "v"])

    for b in batches:
        held.append(np.stack([b.column("u").to_numpy(), b.column("v").to_numpy()]))
        size += b.num_rows
        if size >= FOREST:
            got = solve(np.hstack(held))
            held, size = [got], got.shape[1]
            if 2 * size > FOREST:
                yield rows(got)
                held, size = [], 0
    if size:
        yield rows(solve(np.hstack(held)))


def thinned(edges: DataFrame) -> DataFrame:
    """Written edges as a few forests: a node of a large group has an edge in many tables or cells, and components need
    one."""
    return arrow_map(edges.coalesce(1 + edges.count() // FOREST), forest, "u long, v long")


def candidates(batches: Iterator[pa.RecordBatch], differing: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, cell, node, c0, c1, ..) sorted by key and cell: a forest of the links of each bucket's cell.

    All pairs of a bucket are compared by their first two lanes, and those that pass by all: in a large bucket some rows
    with all later ones at once, in small ones neighbours at distance 1, 2, .. of a block of buckets at once. What is
    emitted is one row at most for each of a bucket's members.
    """
    held: list[np.ndarray] = []

    def solve(rows: np.ndarray) -> pa.RecordBatch:
        start = np.flatnonzero(np.concatenate([[True], (rows[:2, 1:] != rows[:2, :-1]).any(0)]))
        size = np.diff(np.append(start, rows.shape[1]))
        order = np.argsort(-size, kind="stable")[: int((size > 1).sum())]  # the largest first: those that a step still has
        start, size = start[order], size[order]
        end = np.cumsum(size)
        n = int(size.sum())
        at = np.repeat(start - end + size, size) + np.arange(n)
        node, lanes = rows[2, at], rows[3:, at].view(np.uint64)
        left = np.repeat(end, size) - np.arange(n)
        parent = np.arange(n)
        first = differing if len(lanes) <= 2 else min(differing, FIRST)

        def off(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            got = np.bitwise_count(a[0] ^ b[0])
            if len(a) > 1:
                got += np.bitwise_count(a[1] ^ b[1])
            return got

        def unite(a: np.ndarray, b: np.ndarray) -> None:
            near = np.bitwise_count(lanes[:, a] ^ lanes[:, b]).sum(0, dtype=np.int64) <= differing
            _unite(parent, a[near], b[near])

        k = 0
        while k < len(size) and size[k] > ALONE:
            a, z = int(end[k] - size[k]), int(end[k])
            while a < z:
                high = min(1 + BLOCK // (z - a), z - a)
                near = np.flatnonzero(off(lanes[:2, a : a + high, None], lanes[:2, None, a:z]) <= first)
                if len(near) > high:  # more than the rows themselves
                    x, y = np.divmod(near, z - a)
                    unite(x[x < y] + a, y[x < y] + a)
                a += high
            k += 1
        while k < len(size):
            low = int(end[k] - size[k])
            then = m = max(k + 1, int(np.searchsorted(end, low + BLOCK, side="right")))
            for step in range(1, int(size[k])):
                while size[m - 1] <= step:
                    m -= 1
                near = np.flatnonzero(off(lanes[:2, low : end[m - 1] - step], lanes[:2, low + step : end[m - 1]]) <= first)
                if len(near):
                    near = near[left[near + low] > step] + low
                    unite(near, near + step)
            k = then
        top = _root(parent, np.arange(n))
        own = np.flatnonzero((top != np.arange(n)) & (node != node[top]))
        return pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(node[top[own]])], ["u", "v"])

    size = 0
    for b in batches:
        rows = np.stack([b.column(c).to_numpy() for c in ("key", "cell", "node", *(x for x in b.schema.names if x[0] == "c" and x[1:].isdigit()))])
        held.append(rows)
        size += rows.shape[1]
        if size >= GATHER:
            rows = np.hstack(held)
            other = np.flatnonzero((rows[:2] != rows[:2, -1:]).any(0))
            cut = int(other[-1]) + 1 if len(other) else 0  # the last bucket may go on
            if cut:
                yield solve(rows[:, :cut])
            held, size = [rows[:, cut:]], rows.shape[1] - cut
            if not cut:
                size = 0  # one bucket fills it: gather as much again before looking
    if held:
        yield solve(np.hstack(held))


def exact_links(nodes: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A forest of the pairs of sets with a Jaccard similarity of 0.8 or more."""
    out, label = [], np.arange(len(sets))
    size = np.array([len(x) for x in sets])
    each, number = np.unique(np.concatenate(sets), return_inverse=True)
    numbers = np.split(number.astype(np.int32), np.cumsum(size)[:-1])
    own = np.zeros(len(each), bool)
    for a in range(len(sets)):
        apart = (label != label[a]) & (5 * np.minimum(size, size[a]) >= 4 * np.maximum(size, size[a]))  # no others can reach 0.8
        others = np.flatnonzero(apart[a + 1 :]) + a + 1
        own[numbers[a]] = True
        for k in range(0, len(others), MATCHED):
            some = others[k : k + MATCHED]
            some = some[label[some] != label[a]]
            if not len(some):
                continue
            shared = np.zeros(len(some), np.int64)
            if size[a]:  # then none of them is empty
                shared = np.add.reduceat(own[np.concatenate([numbers[b] for b in some])], np.cumsum(size[some]) - size[some], dtype=np.int64)
            for b in some[5 * shared >= 4 * (size[a] + size[some] - shared)]:
                if label[b] != label[a]:
                    out.append((nodes[a], nodes[b]))
                    label[label == label[b]] = label[a]
        own[numbers[a]] = False
    return out


def confirmed(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Rows (root, cell, node, text) sorted by root and cell: the exact links inside each cell."""
    signer, key, held = Signer(words, CHECKS), None, {}

    def solve(held: dict[int, np.ndarray]) -> pa.RecordBatch:
        got = exact_links(list(held), list(held.values()))
        return pa.RecordBatch.from_arrays([pa.array([e[k] for e in got], pa.int64()) for k in range(2)], ["u", "v"])

    for b in batches:
        for root, cell, node, text in zip(*(b.column(c).to_pylist() for c in ("root", "cell", "node", "text")), strict=True):
            if (root, cell) != key:
                if len(held) > 1:
                    yield solve(held)
                key, held = (root, cell), {}
            if node not in held and set_node(x := signer.shingles(text)) == node:
                held[node] = x
    if len(held) > 1:
        yield solve(held)


def exact_edges(docs: DataFrame, prints: DataFrame, roots: DataFrame, words: int) -> DataFrame:
    """``(u, v)`` edges between nodes of one group of candidates whose sets of shingles have a Jaccard similarity of
    0.8 or more; their components are those of all such pairs in the group. A node's text comes from one of its rows.
    """
    grouped = prints.join(roots.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"))
    dk = F.coalesce("doc_id", F.lit(0).cast("bigint"))
    row = F.min(F.struct(F.col("doc_id").isNull().alias("z"), dk.alias("dk"), F.col("th").alias("th"))).alias("row")
    members = written(grouped.groupBy("root", "node").agg(row).select("root", "node", "row.*"), "members")
    hot = written(members.groupBy("root").agg(F.count("*").alias("n")).filter(F.col("n") > MATCHED), "hot").withColumnRenamed("root", "_r")
    groups = F.ceil(F.col("n") / MATCHED)
    own = F.pmod(F.xxhash64("node", F.lit(3)), groups)
    cells = F.transform(F.sequence(F.lit(0).cast("bigint"), groups - 1), lambda t: F.least(own, t) * groups + F.greatest(own, t))
    cell = F.explode(F.when(F.col("n").isNull(), F.array(F.lit(0).cast("bigint"))).otherwise(cells)).alias("cell")
    doc = F.col("doc_id").cast("bigint")
    texts = docs.select(doc.isNull().alias("z"), F.coalesce(doc, F.lit(0).cast("bigint")).alias("dk"), _text_hash().alias("th"), "text")
    rows = texts.join(members, ["z", "dk", "th"]).join(hot, F.col("root") == F.col("_r"), "left").select("root", cell, "node", "text")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "root", "cell").sortWithinPartitions("root", "cell")
    return arrow_map(dealt, lambda batches: confirmed(batches, words), "u long, v long")


def part_tables(lanes: list[str], parts: int, bits: int) -> list[Column]:
    """A key for each covering table of each part; a lane of 64 bits holds ``64 // bits`` parts."""
    each, cover = 64 // bits, masks(bits, RADIUS)
    value = [F.shiftrightunsigned(lanes[k // each], k % each * bits) for k in range(parts)]
    return [F.lit(k * len(cover) + t << bits).cast("bigint").bitwiseOR(value[k].bitwiseAND(F.lit(m).cast("bigint"))) for k in range(parts) for t, m in enumerate(cover)]


def candidate_edges(nodes: DataFrame, tables: list[Column], differing: int) -> DataFrame:
    """``(u, v)`` edges of nodes that share a key of ``tables`` and differ in at most ``differing`` checked bits."""
    checks = [c for c in nodes.columns if c[0] == "c" and c[1:].isdigit()]
    rows = nodes.select(F.explode(F.array(*tables)).alias("key"), "node", *checks)
    hot = written(rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > MEMBERS), "hot").withColumnRenamed("key", "_k")
    # a bucket of g groups of MEMBERS has a task for each two groups: a member of group s goes to those of s and any t
    groups = F.ceil(F.col("n") / MEMBERS)
    own = F.pmod(F.xxhash64("node", F.lit(2)), groups)
    cells = F.transform(F.sequence(F.lit(0).cast("bigint"), groups - 1), lambda t: F.least(own, t) * groups + F.greatest(own, t))
    cell = F.explode(F.when(F.col("n").isNull(), F.array(F.lit(0).cast("bigint"))).otherwise(cells)).alias("cell")
    rows = rows.join(hot, F.col("key") == F.col("_k"), "left").select("key", cell, "node", *checks)
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # by node, too: a tree's top is then its least node, so that the tables' edges in a large group are mostly the same
    dealt = rows.repartition(n, "key", "cell").sortWithinPartitions("key", "cell", "node")
    edges = arrow_map(dealt, lambda batches: candidates(batches, differing), "u long, v long")
    return written(edges.distinct(), "edges")


def similar_groups(docs: DataFrame, words: int = WORDS, parts: int | None = None, bits: int | None = None, differing: int = DIFFERING) -> DataFrame:
    """``(doc_id, th, node, root)`` of every row: rows with one root are near copies, by a Jaccard similarity of 0.8 or
    more of their sets of word shingles, or linked by such. Every link is confirmed by the sets themselves.

    A signature has ``parts`` independent SimHash fingerprints of ``bits`` bits, each with the covering tables of radius
    RADIUS: a pair that differs in at most RADIUS bits of some part meets in a bucket for certain, and CHECKS further
    lanes propose those that differ in at most ``differing`` bits: a pair of similarity 0.8 with probability 0.99 or
    more. A bucket of more than MEMBERS is dealt to several tasks, so none holds more than twice as many. Equal sets
    are one node. Null and empty texts are copies of each other.
    """
    if parts is None or bits is None:
        bits, parts = PARTS if docs.count() <= SMALL else MANY_PARTS
    lanes = -(-parts // (64 // bits))
    names = ["doc_id", "th", "node", *[f"c{k}" for k in range(CHECKS)], *[f"p{k}" for k in range(lanes)]]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(words, CHECKS + lanes)
        for b in batches:
            sets = [signer.shingles(t) for t in b.column("text").to_pylist()]
            sig = np.array([signer.signature(s) for s in sets], np.uint64).reshape(-1, CHECKS + lanes).view(np.int64)
            node = np.array([set_node(s) for s in sets], np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(node), *(pa.array(sig[:, k].copy()) for k in range(CHECKS + lanes))], names)

    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _text_hash().alias("th"), "text")
    schema = "doc_id long, th int, " + ", ".join(f"{n} long" for n in names[2:])
    prints = written(arrow_map(keyed, sign, schema), "signatures")
    nodes = written(prints.groupBy("node").agg(*[F.first(n).alias(n) for n in names[3:]]), "nodes")
    tables = part_tables(names[3 + CHECKS :], parts, bits)
    step = ROUND * len(masks(bits, RADIUS))
    edges = reduce(DataFrame.unionByName, [candidate_edges(nodes, tables[k : k + step], differing) for k in range(0, len(tables), step)])
    exact = written(exact_edges(docs, prints, components(thinned(edges)), words), "exact")
    roots = components(thinned(exact))
    got = prints.select("doc_id", "th", "node").join(roots.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left")
    return got.select("doc_id", "th", "node", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame, **options: int) -> DataFrame:
    """``docs`` with one row of each group of near copies: the least doc_id's (nulls last), of repeated rows one."""
    groups = similar_groups(docs, **options)
    doc = F.col("doc_id").cast("bigint")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("z"), F.coalesce("doc_id", F.lit(0).cast("bigint")).alias("dk"), F.col("th").alias("th"))).alias("least")
    first = groups.groupBy("root").agg(least).select("least.*").distinct()
    # keys without nulls, so that the join and the numbering share one deal of the texts
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"), "text", doc.isNull().alias("z"), F.coalesce(doc, F.lit(0).cast("bigint")).alias("dk"), _text_hash().alias("th"))
    order = Window.partitionBy("z", "dk", "th").orderBy("text")
    return rows.join(first, ["z", "dk", "th"]).withColumn("n", F.row_number().over(order)).filter("n = 1").select("r.*")


def _text_hash() -> Column:
    return F.hash(F.coalesce("text", F.lit("")))
