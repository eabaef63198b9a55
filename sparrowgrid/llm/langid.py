"""Language identification by unigrams of pieces whose segmentation is summed out.

The pieces are those of a public vocabulary. A word's probability in a language is the sum over all its
segmentations of the product of piece probabilities (forward algorithm); a text's is the product over its words.
Piece probabilities are learned by expectation-maximisation: forward-backward gives the expected count of each piece.
"""

from __future__ import annotations

import math
import re
import sys
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowgrid.llm.bpe import category_class, in_one_plane
from sparrowgrid.llm.common import arrow_map, ship, written

UNKNOWN = "und"
START = "▁"
#: Letters of words that are scored whole in one matrix; longer ones are run through in steps of STEP letters.
WIDE, STEP = 24, 4096
#: Probability mass of a letter that is no piece, and what is added to every piece's count.
LETTER, SMOOTH = 1e-7, 0.05
#: Labelled documents a language that the model is fitted on, expected; documented bound of the fit.
FIT_DOCS, ROUNDS = 800, 2
#: Words kept with their scores, and numbers of these at most; the table is emptied when it is full.
CACHE_WORDS, CACHE_NUMBERS = 120_000, 2_000_000
#: Numbers of one matrix of the forward algorithm, about.
MATRIX = 2_000_000
#: Words of a partition counted before they are handed on.
COUNTED = 60_000


def pieces(vocabulary: str) -> list[str]:
    """The vocabulary's pieces of letters, of any length, in lower case, each once, in order."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    out: dict[str, None] = {}
    for k in range(sp.get_piece_size()):
        p = sp.id_to_piece(k).lower()
        body = p.removeprefix(START)
        if body.isalpha() or p == START:
            out.setdefault(p)
    return list(out)


class Words:
    """Texts to words: lower-cased runs of letters, the first part with the start mark."""

    def __init__(self) -> None:
        self.plane, self.all = (re.compile(f"[{category_class('L', last)}]+").findall for last in (0xFFFF, sys.maxunicode))

    def __call__(self, text: str | None) -> list[str]:
        low = text.lower() if text else ""
        return self.plane(low) if in_one_plane(low) else self.all(low)


def reach(table: dict) -> int:
    """Letters of the longest piece."""
    return max(map(len, table), default=1)


def forward(s: str, table: dict[str, tuple[float, ...]], n: int) -> list[float]:
    """The log probability of ``s`` in each of n languages, one at a time: alpha[t] is the sum of alpha[t - k] * p(the k
    letters before t), kept as a log."""
    size, get, far = len(s), table.get, reach(table)
    out = []
    for x in range(n):
        alpha = [0.0]
        for e in range(1, size + 1):
            arcs = [(alpha[t], get(s[t:e])) for t in range(max(0, e - far), e)]
            terms = [a + math.log(LETTER if p is None else p[x]) for k, (a, p) in enumerate(reversed(arcs)) if p is not None or not k]
            alpha.append(_log_sum(terms))
        out.append(alpha[size])
    return out


def _log_sum(terms: list[float]) -> float:
    top = max(terms)
    return top + math.log(sum([math.exp(x - top) for x in terms]))


def expected(s: str, table: dict[str, float], weight: float, out: Counter, far: int | None = None) -> None:
    """Adds ``weight`` times the expected count of each piece of ``s`` under one language's probabilities.

    Words of more than WIDE letters are summed in logs, with two numbers a letter in memory, so none underflows.
    """
    size, get, far = len(s), table.get, far or reach(table)
    if size > WIDE:
        return _expected_long(s, table, weight, out, far)
    arcs: list[tuple[int, int, str, float]] = []
    alpha = [1.0] + [0.0] * size
    for t in range(size):
        for e in range(t + 1, min(size, t + far) + 1):
            p = get(s[t:e])
            if p is None:
                if e > t + 1:
                    continue
                p = LETTER
            arcs.append((t, e, s[t:e], p))
            alpha[e] += alpha[t] * p
    beta = [0.0] * size + [1.0]
    for t, e, piece, p in reversed(arcs):
        beta[t] += p * beta[e]
    scale = weight / alpha[size]
    for t, e, piece, p in arcs:
        if piece in table:
            out[piece] += alpha[t] * p * beta[e] * scale


def _expected_long(s: str, table: dict[str, float], weight: float, out: Counter, far: int) -> None:
    size, get, log = len(s), table.get, math.log

    def arcs(t: int) -> list[tuple[int, str, float]]:
        """The pieces that start at t: their ends and log probabilities."""
        found = [(e, s[t:e], log(p)) for e in range(t + 1, min(size, t + far) + 1) if (p := get(s[t:e]))]
        return found if found and found[0][0] == t + 1 else [(t + 1, s[t], log(LETTER)), *found]

    beta = array("d", bytes(8 * (size + 1)))
    for t in range(size - 1, -1, -1):
        beta[t] = _log_sum([p + beta[e] for e, _, p in arcs(t)])
    ahead: dict[int, list[float]] = {0: [0.0]}  # what has come to places not yet reached
    for t in range(size):
        alpha = _log_sum(ahead.pop(t))
        for e, piece, p in arcs(t):
            ahead.setdefault(e, []).append(alpha + p)
            if piece in table:
                out[piece] += weight * math.exp(alpha + p + beta[e] - beta[0])


class Forward:
    """``forward`` of many words at once, in matrices of words by places, for pieces found by their hashes."""

    BASE = np.uint64(0x9E3779B97F4A7C15)
    SLOTS = 20

    def __init__(self, table: dict[str, tuple[float, ...]], n: int) -> None:
        names = list(table)
        self.n, self.reach = n, reach(table)
        hashes = np.zeros(len(names), np.uint64)
        for size in {len(p) for p in names}:
            which = [k for k, p in enumerate(names) if len(p) == size]
            codes = np.array([[ord(c) for c in names[k]] for k in which], np.uint64)
            h = np.zeros(len(which), np.uint64)
            for t in range(size):
                h = (h + codes[:, t] + np.uint64(1)) * self.BASE
            hashes[which] = h
        order = np.argsort(hashes)
        slots = (hashes[order] >> np.uint64(64 - self.SLOTS)).astype(np.int64)
        self.depth = int(np.bincount(slots, minlength=1).max()) if names else 0
        self.hashes = np.append(hashes[order], np.zeros(self.depth, np.uint64))
        self.found = np.append(order, np.full(self.depth, len(names)))
        self.p = np.zeros((len(names) + 2, n))  # then nothing, and a letter that is no piece
        if names:
            self.p[: len(names)] = [table[x] for x in names]
        self.p[-1] = LETTER
        self.first = np.searchsorted(slots, np.arange(1 << self.SLOTS)).astype(np.int32)

    def logs(self, words: list[str]) -> np.ndarray:
        """(words, languages): log probabilities of words."""
        out = np.zeros((len(words), self.n))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        low = 0
        for width in (5, 8, 11, 15, WIDE):
            which = np.flatnonzero((sizes > low) & (sizes <= width))
            low = width
            rows = min(1 << 13, max(16, MATRIX // ((width + 1) * self.n)))
            for k in range(0, len(which), rows):
                part = which[k : k + rows]
                out[part] = self._block([words[x] for x in part.tolist()], sizes[part], width)
        long = np.flatnonzero(sizes > WIDE)
        long = long[np.argsort(sizes[long], kind="stable")]  # words of like lengths together
        rows = max(1, MATRIX // (STEP * self.reach))
        for k in range(0, len(long), rows):
            out[long[k : k + rows]] = self._stream([words[x] for x in long[k : k + rows].tolist()])
        return out

    def _arcs(self, codes: np.ndarray) -> list[np.ndarray]:
        """For each size from 1, the piece that starts at each place of each row, or nothing's number."""
        none, width = len(self.p) - 2, codes.shape[1]
        h = np.zeros_like(codes)
        arcs = []
        for size in range(1, min(self.reach, width) + 1):
            h = (h[:, : width - size + 1] + codes[:, size - 1 :] + np.uint64(1)) * self.BASE
            at = self.first[(h >> np.uint64(64 - self.SLOTS)).astype(np.int64)]
            got = np.full(h.shape, none)
            for step in range(self.depth):
                got = np.where(self.hashes[at + step] == h, self.found[at + step], got)
            if size == 1:
                got[got == none] = none + 1
            arcs.append(got)
        return arcs

    def _block(self, words: list[str], sizes: np.ndarray, width: int) -> np.ndarray:
        """Words of at most WIDE letters: none of their probabilities underflows."""
        codes = np.frombuffer("".join([w.ljust(width, "\0") for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, width).astype(np.uint64)
        alpha = np.zeros((width + 1, len(words), self.n))
        alpha[0] = 1.0
        arcs = self._arcs(codes)
        for e in range(1, width + 1):
            for size in range(1, min(self.reach, e) + 1):
                piece = arcs[size - 1][:, e - size]
                alpha[e] += alpha[e - size] * self.p[piece]
        return np.log(alpha[sizes, np.arange(len(words))])

    def _stream(self, words: list[str]) -> np.ndarray:
        """Words of any length, STEP letters at a time: the last ``reach`` columns of alpha stay, scaled to 1 at most
        after each step of WIDE letters, and the scale's log is kept. ``words`` are in order of their lengths."""
        sizes = np.array(list(map(len, words)))
        alpha = np.zeros((self.reach, len(words), self.n))  # the oldest first
        alpha[-1] = 1.0
        scale, out, done = np.zeros((len(words), self.n)), np.zeros((len(words), self.n)), 0
        for start in range(0, int(sizes[-1]), STEP):
            done = int(np.searchsorted(sizes, start, "right"))  # words that ended before
            begin = max(0, start - self.reach + 1)  # pieces that end in this step start here at the earliest
            width = start + STEP - begin
            codes = np.frombuffer("".join([w[begin : start + STEP].ljust(width, "\0") for w in words[done:]]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, width).astype(np.uint64)
            arcs = self._arcs(codes)
            live, size = alpha[:, done:], sizes[done:]
            for e in range(start + 1, min(start + STEP, int(sizes[-1])) + 1):
                new = np.zeros(live.shape[1:])
                for k in range(1, min(self.reach, e) + 1):
                    piece = arcs[k - 1][:, e - k - begin]
                    if (piece != len(self.p) - 2).any():
                        new += live[-k] * self.p[piece]
                live = np.concatenate([live[1:], new[None]])
                ending = np.flatnonzero(size == e) + done
                if len(ending):
                    out[ending] = np.log(new[ending - done]) + scale[ending]
                if e % WIDE == 0:
                    top = live.max(0)
                    top[top == 0] = 1.0  # of words that have ended
                    live /= top
                    scale[done:] += np.log(top)
            alpha = np.concatenate([np.zeros((self.reach, done, self.n)), live], 1)
        return out


class Model:
    """Languages in order, and each piece's probability in each."""

    def __init__(self, languages: list[str], table: dict[str, tuple[float, ...]]) -> None:
        self.languages, self.table = languages, table
        self.find: Words | None = None
        self.rows: dict[str, int] = {}

    def __reduce__(self):
        return Model, (self.languages, self.table)

    #: The one model of this process that holds tables; workers outlive a query, and so would each model's.
    active: list[Model] = []

    def ready(self) -> None:
        if self.find is not None:
            return
        for other in Model.active:
            other.find = other.forward = other.scores = None
            other.rows = {}
        Model.active[:] = [self]
        n = max(1, len(self.languages))
        self.room = max(1024, min(CACHE_WORDS, CACHE_NUMBERS // n))
        self.find, self.forward = Words(), Forward(self.table, len(self.languages))
        self.scores = np.zeros((self.room, n))

    def _learn(self, words: set[str]) -> None:
        """Log probabilities of new words."""
        new, at = list(words), len(self.rows)
        self.scores[at : at + len(new)] = self.forward.logs([START + w for w in new])
        self.rows.update(zip(new, range(at, at + len(new)), strict=True))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The likeliest language of each text and its posterior under equal priors; ties go to the first language."""
        self.ready()
        found = [self.find(t) for t in texts]
        if not self.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        total = np.zeros((len(texts), len(self.languages)))
        # parts of the batch with at most half of the table's words, so that it always has room for them
        groups, group, size = [], [], 0
        for k, words in enumerate(found):
            for j in range(0, len(words), self.room // 4):
                piece = words[j : j + self.room // 4]
                if size + len(piece) > self.room // 2:
                    groups.append(group)
                    group, size = [], 0
                group.append((k, piece))
                size += len(piece)
        for group in [*groups, group]:
            if not group:
                continue
            words = set().union(*(w for _, w in group))
            new = words - self.rows.keys()
            if len(self.rows) + len(new) > self.room:
                self.rows.clear()
                new = words
            if new:
                self._learn(new)
            get = self.rows.__getitem__
            for k, w in group:
                at = np.fromiter(map(get, w), np.int64, len(w))
                total[k] += self.scores[at].sum(0)
        best = total.argmax(1)
        z = np.exp(total - total.max(1, keepdims=True))
        share = z[np.arange(len(z)), best] / z.sum(1)
        return [(self.languages[b], float(p)) if w else (UNKNOWN, 0.0) for w, b, p in zip(found, best.tolist(), share.tolist(), strict=True)]


def held_out(doc_id):
    """True for the documents that the model must not see."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(labelled: DataFrame, vocabulary: str, docs: int = FIT_DOCS, rounds: int = ROUNDS) -> Model:
    """A model of the non-null languages of ``labelled`` (doc_id, text, lang).

    At most about ``docs`` documents of a language are used, chosen by a hash of doc_id at a rate that its count
    gives. The driver gets a number for each piece and language, never texts or words.
    """
    spark = labelled.sparkSession
    ship(spark)
    usable = labelled.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang").filter("lang is not null and text is not null")
    counts = {r.lang: r.n for r in usable.select("lang").groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], {})
    vocab = pieces(vocabulary)
    rate = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, docs / counts[k])))])
    u = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(1)), 11) / float(1 << 53)
    sample = usable.filter(u < F.element_at(rate, F.col("lang")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, seen = Words(), Counter()

        def out() -> pa.RecordBatch:
            pairs = list(seen)
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs]), pa.array([p[1] for p in pairs]), pa.array([seen[p] for p in pairs], pa.int64())], ["lang", "word", "n"])

        for b in batches:
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                seen.update((lang, w) for w in find(text))
            if len(seen) > COUNTED:
                yield out()
                seen.clear()
        if seen:
            yield out()

    words = arrow_map(sample.select("text", "lang"), count, "lang string, word string, n long")
    words = written(words.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    start = 1.0 / len(vocab)
    table = {p: (start,) * len(languages) for p in vocab}
    for _ in range(rounds):
        now = table

        def step(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            own = [{p: x[k] for p, x in now.items()} for k in range(len(languages))]
            number, far = {x: k for k, x in enumerate(languages)}, reach(now)
            got = [Counter() for _ in languages]
            for b in batches:
                for lang, word, n in zip(*(b.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
                    k = number[lang]
                    expected(START + word, own[k], n, got[k], far)
            rows = [(languages[k], p, c) for k, g in enumerate(got) for p, c in g.items()]
            cols = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.float64()), strict=True)], ["lang", "piece", "c"])

        found = arrow_map(words, step, "lang string, piece string, c double").groupBy("lang", "piece").agg(F.sum("c").alias("c")).collect()
        counted = {(r.lang, r.piece): r.c for r in found}
        totals = {k: sum(c for (x, _), c in counted.items() if x == k) + SMOOTH * len(vocab) for k in languages}
        table = {p: tuple((counted.get((k, p), 0.0) + SMOOTH) / totals[k] for k in languages) for p in vocab}
    return Model(languages, table)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, lang_pred, score)`` of every row. Null texts and texts without a letter: ``und``, score 0."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            got = m.predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x for x, _ in got], pa.string()), pa.array([y for _, y in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    return arrow_map(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of every row, by a model fitted on the rows that aren't held out.

    Rows without a label or a text aren't learned from. A null text or one without a letter is ``und`` with score 0, as
    is every row where there is no label at all. Rows without a doc_id aren't held out. Repeated rows stay, and count
    each in the fit; an empty table gives no rows; other columns are ignored. Words of any length are scored whole.
    """
    model = fit(docs.filter(~held_out(F.col("doc_id"))), vocabulary)
    got = predict(docs, model)
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, vocabulary: str, least: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose language isn't identified: ``und``, or a posterior below ``least``. A row without
    a ``lang`` gets the one found; a given one stays."""
    model = fit(docs.filter(~held_out(F.col("doc_id"))), vocabulary)
    sent, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            got = m.predict(b.column("text").to_pylist())
            lang = pa.array([old if old is not None else x for old, (x, _) in zip(b.column("lang").to_pylist(), got, strict=True)], b.column("lang").type)
            named = pa.RecordBatch.from_arrays([lang if c == "lang" else b.column(c) for c in names], names)
            yield named.filter(pa.array([x != UNKNOWN and y >= least for x, y in got], pa.bool_()))

    return arrow_map(docs, run, docs.schema)
