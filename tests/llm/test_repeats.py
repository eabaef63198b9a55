import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from sparrowgrid.llm import repeats
from tests.llm.conftest import ODD


def brute(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[k : k + 200] for d in data for k in range(len(d) - 199))
    out = {}
    for n, d in enumerate(data):
        gone = np.zeros(len(d) + 2, bool)
        for k in range(len(d) - 199):
            if seen[d[k : k + 200]] > 1:
                gone[k + 1 : k + 201] = True
        runs = int((gone[1:] & ~gone[:-1]).sum())
        left = bytes(np.frombuffer(d, np.uint8)[~gone[1 : len(d) + 1]]) if d else b""
        out[n] = (len(d), int(gone.sum()), runs, hashlib.sha256(left).hexdigest())
    return out


def corpus(rng):
    word = lambda: "".join(rng.choices("abcdefé", k=rng.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(60) for _ in range(6)]
    out = [text(rng.choice([1, 20, 40, 300])) for _ in range(30)]
    out += [f"{text(rng.randint(0, 80))} {rng.choice(passages)} {text(rng.randint(0, 80))}" for _ in range(60)]
    near = text(300)
    for _ in range(25):
        w = near.split(" ")
        for _ in range(4):
            w[rng.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    for n in (199, 200, 201, 250):
        edge = "".join(rng.choices("xyz", k=n))
        out += [f"1{edge}2", f"3{edge}4"]
    out += [near, near, "ab" * 300, "q" * 199, "r" * 200, "s" * 201, "tuv" * 90 + "w" + "tuv" * 90]
    return out + ODD


@pytest.mark.parametrize("hot", [4096, 3])
def test_against_brute_force(make, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    texts = corpus(random.Random(hot))
    want = brute(texts)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.digest(make(texts)).collect()}
    assert got == want


def test_parts_of_long_texts_have_all_strings(monkeypatch):
    rng = random.Random(1)
    data = np.frombuffer("".join(rng.choices("abcd", k=5000)).encode(), np.uint8)
    for part in (300, 1000, 1 << 20):
        monkeypatch.setattr(repeats, "PART", part)
        place, _, first, last = repeats.anchors(data)
        owned = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last, strict=True)])
        assert sorted(owned.tolist()) == list(range(5000 - 199))
        assert ((place >= first) & (place >= last) & (place + repeats.KGRAM <= first + 200)).all()


def test_suffix_sort_and_common_extensions():
    rng = random.Random(2)
    text = "".join(rng.choices("ab", k=400)) + "ab" * 200 + "".join(rng.choices("ab", k=100))
    data = np.frombuffer(text.encode(), np.uint8)
    s = repeats.PrefixHashes(data, 123456789)
    starts = np.array(rng.sample(range(len(text) - 60), 500))
    for buckets in (1, 7, 500):
        bucket = np.sort(np.array([rng.randrange(buckets) for _ in starts]))
        order = repeats.suffix_sort(data, s, starts, bucket, 60)
        keys = [(b, text[x : x + 60]) for b, x in zip(bucket, starts, strict=True)]
        assert [keys[k] for k in order] == sorted(keys) and sorted(order.tolist()) == list(range(500))
    x, y = starts[:200], starts[200:400]
    n = repeats.common(s, x, y, 60)
    for a, b, k in zip(x, y, n, strict=True):
        assert text[a : a + k] == text[b : b + k] and (k == 60 or text[a + k] != text[b + k])


def test_strings_of_one_hash_are_split(monkeypatch):
    data = np.frombuffer(b"abcdefgh" * 10 + b"once only", np.uint8)
    monkeypatch.setattr(repeats.PrefixHashes, "of", lambda self, a, b: np.zeros(len(a), np.uint64))
    starts = np.array([0, 80, 1, 8, 2, 17, 81])
    got = repeats.repeated_strings(data, starts, np.zeros(7, np.int64), 8, 5)
    assert got.tolist() == [True, False, True, True, False, True, False]


def test_prefix_hashes_are_polynomials_modulo_a_prime():
    data = np.random.default_rng(3).integers(0, 256, 3000).astype(np.uint8)
    base = repeats.draw().base
    s, want = repeats.PrefixHashes(data, base), 0
    for k in range(3000):
        want = (want + (int(data[k]) + 1) * pow(base, k, repeats.PRIME)) % repeats.PRIME
        assert int(s.sums[k + 1]) == want
    a, b = np.array([0, 7, 2990]), np.array([3000, 1007, 3000])
    got = s.of(a, b)
    for x, y, h in zip(a, b, got, strict=True):
        assert int(h) == sum((int(data[k]) + 1) * pow(base, int(k - x), repeats.PRIME) for k in range(x, y)) % repeats.PRIME


def thue_morse_pair():
    """Two texts whose polynomial hashes modulo 2^64 agree for many bases (given as a case to hold)."""
    pairs = [(50, 122), (39, 122), (119, 113), (60, 34)]
    tail = "bsodabdgsmhtxlajmbqecksgzkxqvggypouzcmopmzjjfspudgzjjjhdjhuhduxziaqqzrfh"
    block = lambda a, b: "".join(chr(b if k.bit_count() & 1 else a) for k in range(32))
    return "".join(block(a, b) for a, b in pairs) + tail, "".join(block(b, a) for a, b in pairs) + tail


@pytest.mark.parametrize("hot", [4096, 0])
def test_texts_of_one_polynomial_hash_stay(make, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    one, two = thue_morse_pair()
    assert len(one) == len(two) == 200 and one != two
    assert [r.n_removed for r in repeats.digest(make([one, two])).collect()] == [0, 0]
    got = {r.doc_id: r.n_removed for r in repeats.digest(make([one, two, "x" + one])).collect()}
    assert got == {0: 200, 1: 0, 2: 200}


def test_many_rows_without_an_id(make):
    rng = random.Random(6)
    texts = ["".join(rng.choices("abcd", k=260)) for _ in range(60)]
    texts += [texts[0][:230], None, ""]
    want = sorted((n, r) for n, r, _, _ in brute(texts).values())
    assert sorted((r.n_bytes, r.n_removed) for r in repeats.digest(make(texts, ids=[None] * 63)).collect()) == want


def test_repeated_rows_null_ids_and_empty_table(make):
    long = " ".join(f"w{k}" for k in range(200))
    got = repeats.digest(make([long, long, "short", None, long + "x"], ids=[1, 1, None, None, 5])).collect()
    assert len(got) == 5 and sorted(r.n_removed for r in got) == [0, 0, len(long), len(long), len(long)]
    alone = repeats.digest(make([long, "short"], ids=[None, None])).collect()
    assert [r.n_removed for r in alone] == [0, 0]
    assert repeats.digest(make(["a"]).limit(0)).count() == 0
    assert {bytes(r.kept) for r in repeats.strip(make([long, long + "x"])).collect()} == {b"", b"x"}
