import random
import re

import numpy as np
import xxhash

from sparrowgrid.llm import simhash
from sparrowgrid.llm.components import components
from tests.llm.conftest import ODD


def brute_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    s = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(prints):
    ids, root = sorted(prints), {}
    for a in ids:
        root[a] = a

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {a: find(a) for a in ids}


def test_masks_cover_every_pair_of_bits():
    for radius in (1, 2, 3):
        m, rng = simhash.masks(64, radius), random.Random(1)
        assert len(m) == 2 ** (radius + 1) - 1
        for _ in range(3000):
            flipped = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(not x & flipped for x in m)


def test_fingerprints_against_brute_force():
    for t in [*ODD, "One two THREE Four\x0bfive\x85six", "É È a", "a b", "a b c", "A B c d e f"]:
        assert simhash.fingerprint(t) == brute_print(t), t


def docs_near(rng, n):
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(300)]
    out = []
    for _ in range(n):
        w = rng.choices(words, k=rng.choice([1, 2, 5, 60, 400]))
        out.append(" ".join(w))
        for _ in range(rng.choice([0, 0, 1, 3])):
            v = list(w)
            v[rng.randrange(len(v))] = "changed"
            out.append(" ".join(v))
    return out


def test_query_against_brute_force(make):
    texts = [*docs_near(random.Random(3), 60), *ODD, *["same text again here"] * 20]
    prints = {k: brute_print(t) for k, t in enumerate(texts)}
    want = brute_components(prints)
    got = {r.doc_id: r for r in simhash.digest(make(texts)).collect()}
    assert {k: int(r.fingerprint, 16) for k, r in got.items()} == prints
    assert {k: r.component_id for k, r in got.items()} == want


def test_large_buckets_are_split_exactly(spark):
    rng = random.Random(9)
    base = rng.getrandbits(64)
    fps = {base}
    while len(fps) < 400:
        fps.add(rng.choice(sorted(fps)) ^ (1 << rng.randrange(64)) ^ (rng.random() < 0.5 and 1 << rng.randrange(64)))
    fps |= {rng.getrandbits(64) for _ in range(50)}
    prints = {k: x for k, x in enumerate(sorted(fps))}
    want = brute_components(prints)
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in prints.values()], "fp long")
    for bucket in (4, 512):
        got = {int(np.int64(r.node).astype(np.uint64)): int(np.int64(r.root).astype(np.uint64)) for r in components(simhash.links(df, 2, bucket)).collect()}
        groups = {}
        for k, x in prints.items():
            groups.setdefault(want[k], set()).add(x)
        for g in groups.values():
            assert len({got.get(x, x) for x in g}) == 1
        assert len({got.get(x, x) for x in prints.values()}) == len(groups)


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 120)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 120)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_nulls_and_empty_table(make):
    got = simhash.digest(make([None, "", "x y z", "x y z"], ids=[3, None, 8, 8])).collect()
    assert sorted((r.fingerprint, r.component_id) for r in got)[:2] == [("0" * 16, 3)] * 2
    assert simhash.digest(make(["a"]).limit(0)).count() == 0
