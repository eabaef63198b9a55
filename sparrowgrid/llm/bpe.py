"""Byte-pair encoding as a bounded-lookahead streaming transducer, and incremental decoding.

A merge list's sufficient lookahead is the number of bytes to the right of a place that can still change what
happens there. A decision at a place is changed from the right only by a chain of rules: rule ``(a, b)`` may fail
because a token at the right end of ``b``, one of the tokens on b's right edge, is taken earlier by a rule
``(that token, c)`` of lower rank than the one that would have taken it. So each rule reaches
``len(b) + the furthest reach of such a rule`` bytes, and the furthest reach of all rules is enough for any text.
Tokens that end that far before the end of what has been read are stable, and leave the buffer.

Every word goes through the transducer; words met before are looked up. Texts are read in pieces, words are cut off as
soon as nothing to come can change them, and a word that doesn't end is pushed on piece by piece, so besides the text
itself memory is constant: a piece, a window, a table of words of bounded number and length.
"""

from __future__ import annotations

import codecs
import json
import re
import sys
import unicodedata
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from hashlib import sha256
from itertools import chain, repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparrowgrid.llm.common import arrow_map

NEVER = 1 << 62
#: Words kept with their tokens, half of them in each generation: about 180 bytes each, as tokens' numbers are shared.
CACHE_WORDS = 240_000
#: Bytes of a word that is kept.
KEPT_WORD = 64
#: Characters of a text that are read at once, and of a word beyond which it is pushed on before its end is seen.
PIECE, RUN = 1 << 16, 1 << 12
#: What the pattern of byte-level tokenizers calls white space (fixed values).
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the others
    for the letters from 256 on, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


def category_class(kind: str, last_point: int = sys.maxunicode) -> str:
    """The characters of a general category up to a code point as ranges of a character class."""
    out, start, last = [], None, -2
    for c in range(last_point + 2):
        inside = c <= last_point and unicodedata.category(chr(c))[0] == kind
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            last = c - 1
            out.append(f"{re.escape(chr(start))}-{re.escape(chr(last))}" if last > start else re.escape(chr(start)))
            start = None
    return "".join(out)


def in_one_plane(text: str) -> bool:
    """True if no character is beyond U+FFFF."""
    return text.isascii() or len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text)


def word_pattern(last_point: int = sys.maxunicode) -> re.Pattern[str]:
    """The split of text before merging, with explicit classes for letters, numbers and white space.

    Classes that end at U+FFFF are far faster, being one table; they do for texts without later characters.
    """
    letters, numbers = category_class("L", last_point), category_class("N", last_point)
    return re.compile(
        rf"'(?:s|t|re|ve|m|ll|d)| ?[{letters}]+| ?[{numbers}]+| ?[^{SPACES}{letters}{numbers}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
    )


class Splitter:
    """Text to the words that are merged on their own."""

    def __init__(self) -> None:
        self.plane, self.all = word_pattern(0xFFFF).findall, word_pattern().findall
        letters, numbers = category_class("L"), category_class("N")
        #: Characters that go on with a word of a kind.
        self.more = {"L": re.compile(f"[{letters}]*"), "N": re.compile(f"[{numbers}]*"), "S": re.compile(f"[{SPACES}]*"), "O": re.compile(f"[^{SPACES}{letters}{numbers}]*")}

    def __call__(self, text: str) -> list[str]:
        return self.plane(text) if in_one_plane(text) else self.all(text)

    def kind(self, character: str) -> str:
        return next(k for k, p in self.more.items() if p.match(character).end())


class MergeList:
    """A byte-level merge list as the tokenizers library writes it."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        letters = byte_letters()
        back = {v: k for k, v in letters.items()}
        self.byte_id = [vocab[letters[b]] for b in range(256)]
        self.token_bytes: dict[int, bytes] = {i: bytes(back[c] for c in t) for t, i in vocab.items()}
        self.pairs: dict[tuple[int, int], int] = {}  # rank << 20 | token
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs[vocab[a], vocab[b]] = rank << 20 | vocab[a + b]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.token_bytes |= {i: t.encode() for t, i in self.special.items()}
        self.longest_special = max(map(len, self.special), default=1)
        self.special_pattern = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else re.compile(r"(?!)")
        self.lookahead = self._lookahead()

    def _lookahead(self) -> int:
        made: dict[int, tuple[int, int, int]] = {}  # token: rank, left, right of the rule that makes it
        reach: dict[int, tuple[list[int], list[int]]] = {}  # left token: ranks, furthest reach so far
        most = 1
        for (a, b), x in self.pairs.items():  # in rank order
            rank, token = x >> 20, x & 0xFFFFF
            far, node, limit = 0, b, rank
            while True:
                ranks, best = reach.get(node, ((), ()))
                if at := bisect_left(ranks, limit):
                    far = max(far, best[at - 1])
                if node not in made:
                    break
                limit, _, node = made[node]
            far += len(self.token_bytes[b])
            ranks, best = reach.setdefault(a, ([], []))
            ranks.append(rank)
            best.append(max(far, best[-1] if best else 0))
            most = max(most, far)
            made.setdefault(token, (rank, a, b))
        return most

    def ids(self, data: bytes) -> list[int]:
        """Tokens of some bytes: lowest rank first, leftmost first."""
        return self.merge(list(map(self.byte_id.__getitem__, data)))

    def merge(self, ids: list[int]) -> list[int]:
        """Lowest rank first, leftmost first."""
        get = self.pairs.get
        ranks = list(map(get, zip(ids, ids[1:], strict=False), repeat(NEVER)))
        while ranks and (best := min(ranks)) != NEVER:
            at = ranks.index(best)
            ids[at] = token = best & 0xFFFFF
            del ids[at + 1]
            del ranks[at]
            if at:
                ranks[at - 1] = get((ids[at - 1], token), NEVER)
            if at < len(ranks):
                ranks[at] = get((token, ids[at + 1]), NEVER)
        return ids


class Transducer:
    """Bytes of one word in, stable tokens out. The buffer holds at most a window of bytes besides what is pushed."""

    def __init__(self, merges: MergeList, window: int = 128) -> None:
        self.merges, self.held = merges, b""
        self.window = merges.lookahead + window

    def push(self, data: bytes) -> list[int]:
        data, at, out = self.held + data if self.held else data, 0, []
        while len(data) - at > self.window:
            piece = data[at : at + self.window]
            stable, end = len(piece) - self.merges.lookahead, 0
            for token in self.merges.ids(piece):
                end += len(self.merges.token_bytes[token])
                if end > stable:
                    break
                out.append(token)
                at += len(self.merges.token_bytes[token])
        self.held = data[at:] if at else data
        return out

    def finish(self) -> list[int]:
        held, self.held = self.held, b""
        return self.merges.ids(held)

    def whole(self, data: bytes) -> list[int]:
        """A word that is there from its start to its end: one window, if it fits, and pushed otherwise."""
        return self.merges.ids(data) if len(data) <= self.window else [*self.push(data), *self.finish()]


class Words(dict):
    """Words to their tokens, each from a transducer when it is first asked for, in two generations: when the young one
    is full it becomes the old one, whose words come back when they are met again and go with the next one otherwise."""

    def __init__(self, merges: MergeList) -> None:
        super().__init__()
        self.transducer, self.old = Transducer(merges), {}
        #: One object a token, so that words don't keep a number of their own for each.
        self.number = {i: i for i in merges.token_bytes}.__getitem__

    def __missing__(self, word: str) -> tuple[int, ...]:
        got = self.old.get(word)
        if got is None:
            data = word.encode("utf-8", "surrogatepass")
            got = tuple(map(self.number, self.transducer.whole(data)))
            if len(data) > KEPT_WORD:
                return got
        if len(self) >= CACHE_WORDS // 2:
            self.old = self.copy()
            self.clear()
        self[word] = got
        return got


class TextStream:
    """Pieces of a text in, ids out, as soon as nothing to come can change them. Special tokens' strings become their
    ids, wherever the pieces are cut."""

    def __init__(self, encoder: Encoder) -> None:
        self.encoder, self.merges = encoder, encoder.merges
        self.raw = self.held = ""  # not yet searched for special tokens; not yet cut into words
        self.run: Transducer | None = None  # of a word that goes on
        self.kind = ""

    def push(self, piece: str, final: bool = False) -> list[int]:
        self.raw += piece
        out, at, far = [], 0, self.merges.longest_special
        while (m := self.merges.special_pattern.search(self.raw, at)) and (final or m.start() + far <= len(self.raw)):
            out += self._words(self.raw[at : m.start()], True)
            out.append(self.merges.special[m[0]])
            at = m.end()
        end = len(self.raw) if final else max(at, len(self.raw) - far + 1)
        out += self._words(self.raw[at:end], final)
        self.raw = self.raw[end:]
        return out

    def finish(self) -> list[int]:
        return self.push("", True)

    def _words(self, text: str, final: bool) -> list[int]:
        text, self.held = self.held + text, ""
        out: list[int] = []
        if self.run:
            end = self.encoder.split.more[self.kind].match(text).end()
            if end == len(text) and not final:
                return self._go_on(text)
            # of white space before a word, the last character belongs to what follows
            own = end - 1 if self.kind == "S" and end < len(text) else end
            out += self.run.push(text[:own].encode())
            out += self.run.finish()
            text, self.run = text[own:], None
        words = self.encoder.split(text)
        if not final:
            last, tail = "", ""
            # the last word may go on, and three characters are needed to tell a short form after an apostrophe
            while words and len(tail) < 3:
                last = words.pop()
                tail = last + tail
            if tail == last and len(last) > RUN:
                out += self.encoder.ids(words)
                self.run, self.kind = Transducer(self.merges), self.encoder.split.kind(last[-1])
                return out + self._go_on(last)
            self.held = tail
        return out + self.encoder.ids(words)

    def _go_on(self, text: str) -> list[int]:
        if self.kind == "S":
            text, self.held = text[:-1], text[-1:]
        return self.run.push(text.encode())


class Encoder:
    """Whole texts to token ids; special tokens' strings in a text become their ids."""

    def __init__(self, path: str) -> None:
        self.merges = MergeList(path)
        self.words = Words(self.merges)
        self.split = Splitter()

    def ids(self, words: list[str]) -> list[int]:
        return list(chain.from_iterable(map(self.words.__getitem__, words)))

    def stream(self, text: str) -> Iterator[list[int]]:
        """The ids of a text, in parts of bounded length."""
        if len(text) <= PIECE and not any(s in text for s in self.merges.special):
            yield self.ids(self.split(text))
            return
        t = TextStream(self)
        for k in range(0, len(text), PIECE):
            yield t.push(text[k : k + PIECE])
        yield t.finish()

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.stream(text)))


class Decoder:
    """Token ids in, text out as soon as its bytes are complete; malformed bytes become U+FFFD."""

    def __init__(self, merges: MergeList) -> None:
        self.bytes = merges.token_bytes
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join(map(self.bytes.__getitem__, ids)))

    def finish(self) -> str:
        return self.state.decode(b"", True)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One a worker process and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


#: Tokens decoded at once.
DECODE_CHUNK = 1 << 16


def decode(merges: MergeList, ids: list[int]) -> str:
    d = Decoder(merges)
    return "".join([d.push(ids[k : k + DECODE_CHUNK]) for k in range(0, len(ids), DECODE_CHUNK)]) + d.finish()


def encode_column(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the token ids of each text (null: no ids) in a new column that replaces any of that name."""
    kept = [c for c in df.columns if c != ids]

    def run(batches):
        e = encoder(vocabulary)
        for b in batches:
            got = [e.encode(t or "") for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(got, pa.list_(pa.int32()))], [*kept, ids])

    schema = df.select(*kept).schema.add(ids, T.ArrayType(T.IntegerType()))
    return arrow_map(df.select(*kept), run, schema)


def round_trip(df: DataFrame, vocabulary: str) -> DataFrame:
    """Per document: token count, digests of the ids and of the text decoded from them, all streamed.

    Nulls in ``text`` are empty texts (0 tokens); repeated rows stay; an empty table gives no rows; any other column is
    ignored.
    """
    def run(batches):
        e = encoder(vocabulary)
        names = {i: str(i) for i in e.merges.token_bytes}
        for b in batches:
            out = []
            for text in b.column("text").to_pylist():
                n, ids_hash, text_hash, decoder = 0, sha256(), sha256(), Decoder(e.merges)
                for ids in e.stream(text or ""):
                    if ids:
                        ids_hash.update(("," * bool(n) + ",".join(map(names.__getitem__, ids))).encode())
                        text_hash.update(decoder.push(ids).encode())
                        n += len(ids)
                text_hash.update(decoder.finish().encode())
                out.append((n, ids_hash.hexdigest(), text_hash.hexdigest()))
            n, a, d = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return arrow_map(df.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_checked(df: DataFrame, vocabulary: str) -> DataFrame:
    """``(doc_id, lang, source, n_tokens, ids)`` of every row of a documents table; null texts have no ids.

    Each text's ids are decoded again and compared with it; a text that doesn't come back raises.
    """

    def run(batches):
        e = encoder(vocabulary)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            ids = [e.encode(t) for t in texts]
            for t, i in zip(texts, ids, strict=True):
                if decode(e.merges, i) != t:
                    raise ValueError("a text doesn't survive encoding and decoding")
            n = pa.array([len(i) for i in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), b.column("source"), n, pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "lang", "source", "n_tokens", "ids"])

    return arrow_map(df.select("doc_id", "lang", "source", "text"), run, "doc_id long, lang string, source string, n_tokens long, ids array<int>")
