"""Removal of repeated byte strings: a distributed suffix sort compared by prefix hashes.

Every string of LENGTH bytes has an anchor: the start of its KGRAM-byte string with the least hash, the leftmost of
equal ones. Equal strings have their anchors at one place, so only strings of anchors with equal hashes can be equal.
An anchor's context is the bytes of all strings that it anchors. Equal contexts repeat whole, and are counted; where an
anchor's hash has several contexts, one copy of each is fetched and the starts of their strings are sorted as suffixes.
Comparisons find the common extension by binary search over prefix hashes, so one takes about log(LENGTH) steps of a
mergesort; neighbours that agree in LENGTH bytes are repeats, which a comparison of the bytes confirms.

No text can be made to collide. Anchors' hashes only propose. Prefix hashes are polynomials modulo 2^61 - 1 in a base
drawn for each run, and strings that they call equal are compared byte by byte, unequal ones split. Contexts that are
counted, not fetched, are told apart by their anchor's hash and 96 bits of a BLAKE2b digest under a key of the run;
strings of hot anchors by 128 bits.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable, Iterator
from hashlib import blake2b, sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sparrowgrid.llm.common import arrow_map, text_keys, written

LENGTH, KGRAM = 200, 48
#: Strings of a document that are handled at once; a longer one is cut into overlapping parts.
PART = 1 << 20
#: Contexts of one anchor hash beyond which their strings are counted by Spark instead of sorted in one task.
HOT = 4096
#: Bytes of contexts that are sorted at once, but for an anchor's own.
SORTED = 1 << 20

#: The base of the anchors' own hashes, modulo 2^64, which only propose.
BASE = np.uint64(0x5851F42D4C957F2D)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
PLACE = np.uint64((1 << 22) - 1)
#: The modulus of prefix hashes.
PRIME = (1 << 61) - 1
_P, _61, _30, _31, _M30, _M31 = (np.uint64(x) for x in (PRIME, 61, 30, 31, (1 << 30) - 1, (1 << 31) - 1))


class Secret(NamedTuple):
    """What a run draws on the driver and sends to its tasks: the base of prefix hashes, the key of digests."""

    base: int
    key: bytes


def draw() -> Secret:
    return Secret(secrets.randbelow(PRIME - 1000) + 500, secrets.token_bytes(32))


def reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> _61)
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo PRIME of numbers below it, by halves of 31 bits."""
    ah, al, bh, bl = a >> _31, a & _M31, b >> _31, b & _M31
    middle = al * bh + ah * bl
    return reduced((ah * bh << np.uint64(1)) + (middle >> _30) + ((middle & _M30) << _31) + al * bl)


class _Powers:
    """A base's powers and those of its inverse modulo PRIME, as many as were needed so far."""

    def __init__(self, base: int) -> None:
        self.base, self.power, self.inverse = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> None:
        while len(self.power) < n:
            size = len(self.power)
            up = [np.full(size, pow(x, size, PRIME), np.uint64) for x in (self.base, pow(self.base, -1, PRIME))]
            self.power = np.concatenate([self.power, times(self.power, up[0])])
            self.inverse = np.concatenate([self.inverse, times(self.inverse, up[1])])


class PrefixHashes:
    """Sums of the first k bytes' numbers times the base's powers, modulo PRIME, of some bytes."""

    #: The powers of the last base of this process.
    powers = _Powers(2)

    def __init__(self, data: np.ndarray, base: int) -> None:
        if PrefixHashes.powers.base != base:
            PrefixHashes.powers = _Powers(base)
        PrefixHashes.powers.upto(len(data) + 1)
        power, self.inverse = PrefixHashes.powers.power[: len(data)], PrefixHashes.powers.inverse
        letter = data.astype(np.uint64) + np.uint64(1)
        high, low = reduced(np.cumsum((power >> _31) * letter)), np.cumsum((power & _M31) * letter)  # below 2^64 for 2^24 bytes
        self.sums = np.concatenate([np.zeros(1, np.uint64), reduced((high >> _30) + ((high & _M30) << _31) + reduced(low))])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of bytes start..end, the same wherever they stand."""
        a, b = self.sums[start], self.sums[end]
        return times(np.where(b >= a, b - a, b + _P - a), self.inverse[start])


class _Tables:
    """Powers of BASE and of its inverse, and a number for each byte value."""

    def __init__(self) -> None:
        self.power = self.inverse = np.ones(1, np.uint64)
        self.letter = np.random.default_rng(7).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)

    def upto(self, n: int) -> None:
        if len(self.power) < n:
            size = max(n, 2 * len(self.power), 1 << 16)
            self.power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, BASE))])
            self.inverse = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, INVERSE))])


TABLES = _Tables()


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def gram_hashes(data: np.ndarray, kgram: int) -> np.ndarray:
    """A hash of each ``kgram`` bytes in a row, modulo 2^64."""
    TABLES.upto(len(data) + 1)
    s = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(TABLES.letter[data] * TABLES.power[: len(data)], out=s[1:])
    return mixed((s[kgram:] - s[: len(s) - kgram]) * TABLES.inverse[: len(s) - kgram])


def window_minimum(key: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, by doubling."""
    done, low = 1, key
    while 2 * done <= width:
        low = np.minimum(low[:-done], low[done:])
        done *= 2
    return np.minimum(low[: len(key) - width + 1], low[width - done : width - done + len(key) - width + 1]) if done < width else low


def anchors(data: np.ndarray, length: int = LENGTH, kgram: int = KGRAM) -> tuple[np.ndarray, ...]:
    """(place, hash, first string's start, last string's start) of each anchor of some bytes."""
    out = []
    for at in range(0, max(1, len(data) - length + 1), PART):
        part = data[at : at + PART + length - 1]
        if len(part) < length:
            break
        h = gram_hashes(part, kgram)
        key = (h & ~PLACE) | np.arange(len(h), dtype=np.uint64)
        place = (window_minimum(key, length - kgram + 1) & PLACE).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.concatenate([first[1:], [len(place)]]) - 1
        where = place[first]
        out.append((where + at, h[where], first + at, last + at))
    if not out:
        e = np.zeros(0, np.int64)
        return e, e.astype(np.uint64), e, e
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def digests(data: bytes, start: list[int], end: list[int], key: bytes, size: int) -> np.ndarray:
    """Keyed digests of ``size`` bytes of parts of some bytes, a row each."""
    parts = b"".join([blake2b(data[a:b], digest_size=size, key=key).digest() for a, b in zip(start, end, strict=True)])
    return np.frombuffer(parts, np.uint8).reshape(-1, size)


# -- suffix sort ----------------------------------------------------------------------------------
def common(s: PrefixHashes, x: np.ndarray, y: np.ndarray, length: int) -> np.ndarray:
    """How many bytes, up to ``length``, the suffixes at x and y have in common: binary search over prefix hashes."""
    low, high = np.zeros(len(x), np.int64), np.full(len(x), length)
    same = s.of(x, x + length) == s.of(y, y + length)
    low[same] = length
    open_ = np.flatnonzero(~same)
    high[open_] -= 1
    while len(open_):
        mid = (low[open_] + high[open_] + 1) >> 1
        eq = s.of(x[open_], x[open_] + mid) == s.of(y[open_], y[open_] + mid)
        low[open_] = np.where(eq, mid, low[open_])
        high[open_] = np.where(eq, high[open_], mid - 1)
        open_ = open_[low[open_] < high[open_]]
    return low


def compare(data: np.ndarray, s: PrefixHashes, x: np.ndarray, y: np.ndarray, length: int) -> np.ndarray:
    """-1, 0 or 1 as the suffix at x is before, equal to or after that at y in its first ``length`` bytes."""
    n = common(s, x, y, length)
    at = np.minimum(n, length - 1)
    a, b = data[x + at].astype(np.int16), data[y + at].astype(np.int16)
    return np.where(n == length, 0, np.sign(a - b))


def suffix_sort(data: np.ndarray, s: PrefixHashes, starts: np.ndarray, bucket: np.ndarray, length: int) -> np.ndarray:
    """The order of suffixes by (bucket, first ``length`` bytes): a stable mergesort of all buckets at once.

    ``bucket`` is ascending. Each pass doubles the runs: every suffix finds its place in the run beside its own by
    binary search, so a pass over n suffixes takes n log(run) comparisons.
    """
    n = len(starts)
    order = np.arange(n)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if n else order
    sizes = np.diff(np.append(first, n))
    begin, size = np.repeat(first, sizes), np.repeat(sizes, sizes)
    inside = order - begin
    run = 1
    while n and run < sizes.max():
        q = inside // run
        beside = begin + (q ^ 1) * run
        live = np.flatnonzero(beside < begin + size)
        low = beside[live]
        high = np.minimum(low + run, begin[live] + size[live])
        base, mine, right = low.copy(), starts[order[live]], (q[live] & 1) == 1
        open_ = np.flatnonzero(low < high)
        while len(open_):
            mid = (low[open_] + high[open_]) >> 1
            c = compare(data, s, starts[order[mid]], mine[open_], length)
            after = (c < 0) | (c == 0) & right[open_]
            low[open_] = np.where(after, mid + 1, low[open_])
            high[open_] = np.where(after, high[open_], mid)
            open_ = open_[low[open_] < high[open_]]
        to = np.arange(n)
        to[live] = begin[live] + np.minimum(q[live], q[live] ^ 1) * run + inside[live] - q[live] * run + low - base
        merged = np.empty_like(order)
        merged[to] = order
        order, run = merged, 2 * run
    return order


def repeated_strings(data: np.ndarray, starts: np.ndarray, bucket: np.ndarray, length: int, base: int) -> np.ndarray:
    """Which of the strings that start at ``starts`` equal another of their bucket; decided by their bytes.

    Neighbours in the order that have one hash are compared byte by byte. Where two of a run of them differ all the
    same, the run's strings are told apart by their bytes.
    """
    s = PrefixHashes(data, base)
    order = suffix_sort(data, s, starts, bucket, length)
    x = starts[order]
    out = np.zeros(len(starts), bool)
    if len(x) < 2:
        return out
    h = s.of(x, x + length)
    alike = (bucket[order][1:] == bucket[order][:-1]) & (h[1:] == h[:-1])
    pair, span, wrong = np.flatnonzero(alike), np.arange(length), []
    for k in range(0, len(pair), 1 << 14):
        p = pair[k : k + (1 << 14)]
        true = (data[x[p][:, None] + span] == data[x[p + 1][:, None] + span]).all(1)
        out[order[p[true]]] = out[order[p[true] + 1]] = True
        wrong.append(p[~true])
    run = np.concatenate([[0], np.cumsum(~alike)])
    for r in np.unique(run[np.concatenate(wrong)]) if wrong else ():
        groups: dict[bytes, list[int]] = {}
        for k in np.flatnonzero(run == r).tolist():
            groups.setdefault(data[x[k] : x[k] + length].tobytes(), []).append(k)
        for members in groups.values():
            out[order[members]] = len(members) > 1
    return out


# -- distributed parts ----------------------------------------------------------------------------
#: ``at`` is the anchor's place, and in 8 bits each how far before it the first and the last of its strings start;
#: ``cx`` and ``cy`` are 64 and 32 bits of its context's digest.
ANCHOR = "dk long, tk long, ah long, cx long, cy int, at long"


def unpacked(at: Column) -> tuple[Column, Column, Column]:
    """Place, first start and last start."""
    place = F.shiftright(at, 16)
    return place, place - F.shiftright(at, 8).bitwiseAND(F.lit(0xFF)), place - at.bitwiseAND(F.lit(0xFF))


def document_key() -> tuple[Column, Column]:
    """Two columns without nulls that tell apart documents, and texts of rows that share a doc_id or have none: the
    doc_id and 60 bits of the text's digest, or 120 bits of it. A join on them is on plain equality, so documents that
    are dealt by them aren't dealt again."""
    a, b = text_keys(F.col("text"))
    return F.coalesce("doc_id", b).alias("dk"), (a * 2 + F.col("doc_id").isNull().cast("int")).alias("tk")


def anchor_rows(docs: DataFrame, key: bytes | None) -> DataFrame:
    """One row for each anchor of each row of ``docs`` (dk, tk, text); without a key, only its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 64):
                part = b.slice(k, 64)
                texts = [t.encode() for t in part.column("text").to_pylist()]
                got = [anchors(np.frombuffer(t, np.uint8)) for t in texts]
                place, ah, first, last = (np.concatenate(x) for x in zip(*got, strict=True))
                if key is None:
                    yield pa.RecordBatch.from_arrays([pa.array(ah.view(np.int64))], ["ah"])
                    continue
                d = np.concatenate([digests(t, g[2].tolist(), (g[3] + LENGTH).tolist(), key, 12) for t, g in zip(texts, got, strict=True)])
                # the same bytes around another place are another context
                cx = np.ascontiguousarray(d[:, :8]).view(np.uint64).ravel() ^ mixed((last - first).astype(np.uint64) << np.uint64(16) | (place - first).astype(np.uint64))
                cy = np.ascontiguousarray(d[:, 8:]).view(np.int32).ravel()
                who = pa.array(np.repeat(np.arange(len(got)), [len(g[0]) for g in got]))
                at = place << 16 | (place - first) << 8 | (place - last)
                yield pa.RecordBatch.from_arrays(
                    [part.column("dk").take(who), part.column("tk").take(who), pa.array(ah.view(np.int64)), pa.array(cx.view(np.int64)), pa.array(cy), pa.array(at)],
                    ["dk", "tk", "ah", "cx", "cy", "at"],
                )

    return arrow_map(docs.select("dk", "tk", "text"), run, "ah long" if key is None else ANCHOR)


#: A context's bytes: ``ahead`` is the anchor's distance from their start, ``more`` the number of strings less 1.
CONTEXT = "ah long, cx long, cy int, ahead int, more int, bytes binary"


def contexts(docs: DataFrame, wanted: DataFrame, then: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None, schema: str = "") -> DataFrame:
    """The bytes of wanted contexts (dk, tk, ah, cx, cy, at), as CONTEXT, or what ``then`` makes of them in the same
    worker, as ``schema``."""
    joined = docs.join(wanted.groupBy("dk", "tk").agg(F.collect_list(F.struct("ah", "cx", "cy", "at")).alias("w")), ["dk", "tk"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, w in zip(b.column("text").to_pylist(), b.column("w").to_pylist(), strict=True):
                data = text.encode()
                rows = []
                for x in w:
                    place, far, near = x["at"] >> 16, x["at"] >> 8 & 0xFF, x["at"] & 0xFF
                    rows.append((x["ah"], x["cx"], x["cy"], far, far - near, data[place - far : place - near + LENGTH]))
                cols = zip(*rows, strict=True)
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [x.split()[0] for x in CONTEXT.split(", ")])

    return arrow_map(joined.select("text", "w"), lambda batches: then(run(batches)) if then else run(batches), schema or CONTEXT)


FOUND = "ah long, cx long, cy int, far int, near int"


def _rows(b: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(b.column(c).to_pylist() for c in ("ah", "cx", "cy", "ahead", "more", "bytes")), strict=True)


def sorted_contexts(batches: Iterator[pa.RecordBatch], base: int) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by anchor hash: for each with a repeated string, how far before the anchor the first and the
    last such string start."""
    held: list[tuple] = []
    size, last = 0, None

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        data = np.frombuffer(b"".join([r[5] for r in rows]), np.uint8)
        begin = np.concatenate([[0], np.cumsum([len(r[5]) for r in rows])[:-1]]).astype(np.int64)
        more = np.array([r[4] for r in rows], np.int64) + 1
        ahead = np.array([r[3] for r in rows], np.int64)
        owner = np.repeat(np.arange(len(rows)), more)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(more) - more, more)
        before = ahead[owner] - step  # the string starts so far before the anchor
        _, group = np.unique(np.array([r[0] for r in rows], np.int64), return_inverse=True)
        bucket = group[owner] * np.int64(LENGTH + 1) + before
        by = np.argsort(bucket, kind="stable")
        hit = np.zeros(len(owner), bool)
        hit[by] = repeated_strings(data, (begin[owner] + step)[by], bucket[by], LENGTH, base)
        far, near = np.full(len(rows), -1, np.int64), np.full(len(rows), LENGTH, np.int64)
        np.maximum.at(far, owner[hit], before[hit])
        np.minimum.at(near, owner[hit], before[hit])
        got = np.flatnonzero(far >= 0)
        cols = [pa.array([rows[k][c] for k in got], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int32()))]
        return pa.RecordBatch.from_arrays([*cols, pa.array(far[got].astype(np.int32)), pa.array(near[got].astype(np.int32))], ["ah", "cx", "cy", "far", "near"])

    for b in batches:
        for r in _rows(b):
            if r[0] != last and size > SORTED:
                yield solve(held)
                held, size = [], 0
            held.append(r)
            size += len(r[5])
            last = r[0]
    if held:
        yield solve(held)


def counted_contexts(docs: DataFrame, wanted: DataFrame, key: bytes) -> DataFrame:
    """The same for wanted contexts of very common anchors: their strings are told apart by 128 bits of a keyed digest and
    counted by Spark, so that no task holds a common anchor's contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ah, cx, cy, ahead, more, data in _rows(b):
                step = np.arange(more + 1)
                d = digests(data, step.tolist(), (step + LENGTH).tolist(), key, 16).view(np.int64)
                n = len(step)
                cols = [pa.array(np.full(n, ah)), pa.array(np.full(n, cx)), pa.array(np.full(n, cy, np.int32)), pa.array((ahead - step).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy())], ["ah", "cx", "cy", "before", "h", "g"])

    strings = contexts(docs, wanted, run, "ah long, cx long, cy int, before int, h long, g long")
    same = strings.groupBy("ah", "before", "h", "g").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    hits = strings.join(same, ["ah", "before", "h", "g"])
    return hits.groupBy("ah", "cx", "cy").agg(F.max("before").alias("far"), F.min("before").alias("near"))


def covered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents ``(doc_id, dk, tk, text)``, dealt by document, and ``(dk, tk, spans)`` of bytes to remove.

    A null text is empty. Spans are pairs of start and end, in no order and overlapping; a document without one is
    missing. Rows that share doc_id and text have one entry.
    """
    spark, secret = docs.sparkSession, draw()
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.select("doc_id", *document_key(), "text")
    long = docs.filter(F.octet_length("text") >= LENGTH)
    # written, so that the join below reads two plain shuffles, of which a very common anchor's part can be split
    common_ = written(anchor_rows(long, None).groupBy("ah").agg(F.count("*").alias("n")).filter("n > 1").select("ah"), "common")
    candidates = written(anchor_rows(long, secret.key).join(common_, "ah", "left_semi"), "anchors")
    context = ["ah", "cx", "cy"]
    each = candidates.groupBy(*context).agg(F.count("*").alias("n"), F.min(F.struct("dk", "tk", "at")).alias("one"))
    each = written(each, "contexts")
    kinds = written(each.groupBy("ah").agg(F.count("*").alias("kinds")).filter("kinds > 1"), "kinds")
    several = each.join(kinds, "ah").select(*context, "kinds", "one.*")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.repartition(parts, "dk", "tk")
    few = contexts(dealt, several.filter(F.col("kinds") <= HOT)).repartition(parts, "ah").sortWithinPartitions("ah")
    found = arrow_map(few, lambda batches: sorted_contexts(batches, secret.base), FOUND)
    solved = written(found.unionByName(counted_contexts(dealt, several.filter(F.col("kinds") > HOT), secret.key)), "solved")
    whole = each.filter("n > 1").select(*context, F.lit(None).cast("int").alias("far"), F.lit(None).cast("int").alias("near"))
    partly = solved.join(each.filter("n = 1").select(*context), context, "left_semi")
    hit = candidates.join(whole.unionByName(partly), context)
    place, first, last = unpacked(F.col("at"))
    start, end = F.coalesce(place - F.col("far"), first), F.coalesce(place - F.col("near"), last) + LENGTH
    spans = hit.select("dk", "tk", F.struct(start.alias("a"), end.alias("b")).alias("span")).groupBy("dk", "tk").agg(F.collect_set("span").alias("spans"))
    return dealt, spans


def removed(docs: DataFrame, f, schema: str) -> DataFrame:
    """``f(doc_id, bytes, maximal spans)`` of every row, as rows of ``schema``."""
    dealt, spans = covered(docs)
    joined = dealt.join(spans, ["dk", "tk"], "left").select("doc_id", "text", "spans")
    names = [x.split()[0] for x in schema.split(",")]
    pa_schema = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, text, spans_ in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "spans")), strict=True):
                merged: list[list[int]] = []
                for a, e in sorted((x["a"], x["b"]) for x in spans_ or ()):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(e, merged[-1][1])
                    else:
                        merged.append([a, e])
                rows.append(f(doc_id, text.encode(), merged))
            yield pa.RecordBatch.from_pydict(dict(zip(names, (list(c) for c in zip(*rows, strict=True)) if rows else ([] for _ in names), strict=True)), schema=pa_schema)

    return arrow_map(joined, run, schema)


def kept(data: bytes, spans: list[list[int]]) -> bytes:
    at, out = 0, []
    for a, b in spans:
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


def strip(docs: DataFrame) -> DataFrame:
    """``(doc_id, kept)`` of every row: the remaining bytes."""
    return removed(docs, lambda i, data, spans: (i, kept(data, spans)), "doc_id long, kept binary")


def digest(docs: DataFrame) -> DataFrame:
    """Sizes, removed bytes and runs, and the digest of what is kept, of every row.

    Null texts are empty; an empty table gives no rows. Every row counts as a document, so the texts of repeated rows
    are removed, as far as they have LENGTH bytes. Columns other than doc_id and text are ignored.
    """

    def row(doc_id, data, spans):
        return doc_id, len(data), sum(b - a for a, b in spans), len(spans), sha256(kept(data, spans)).hexdigest()

    return removed(docs, row, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
