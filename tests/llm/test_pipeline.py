import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from sparrowgrid.llm import simhash
from sparrowgrid.llm.langid import UNKNOWN
from sparrowgrid.llm.queries import vocabulary_path
from tests.llm.conftest import ODD


def shingles(t, n=5):
    w = (t or "").encode().lower().split()
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def similarity(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def near(rng, text, changes):
    w = text.split(" ")
    for k in rng.sample(range(len(w)), changes):
        w[k] = "".join(rng.choices("klmnop", k=6))
    return " ".join(w)


def test_near_copies_go_and_others_stay(make):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(400)]
    base = [" ".join(rng.choices(words, k=rng.choice([40, 150, 400]))) for _ in range(150)]
    rows, copies = list(base), []
    for k, t in enumerate(base):
        for share in (0, 0.005, 0.02):
            if k % 3:
                copies.append(k)
                rows.append(near(rng, t, int(share * len(t.split()))))
    found = [similarity(rows[150 + n], base[k]) for n, k in enumerate(copies)]
    kept = {r.doc_id for r in simhash.keep_one(make(rows)).collect()}
    assert set(range(150)) <= kept
    close = [n for n, s in enumerate(found) if s >= 0.9]
    assert sum(150 + n not in kept for n in close) >= 0.99 * len(close)
    fair = [n for n, s in enumerate(found) if 0.8 <= s < 0.9]
    assert fair and sum(150 + n not in kept for n in fair) >= 0.75 * len(fair)


def pairs(seed, low, high, n=120):
    """Texts and a changed copy of each, of a similarity from low to high."""
    rng, out = random.Random(seed), []
    while len(out) < 2 * n:
        t = " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(rng.choice([60, 150, 400])))
        u = near(rng, t, max(1, round(len(t.split()) * rng.uniform(0.01, 0.06))))
        if low <= similarity(t, u) < high:
            out += [t, u]
    return out


def test_pairs_just_above_the_threshold_go(make):
    rows = pairs(5, 0.8, 0.84, 200)
    kept = {r.doc_id for r in simhash.keep_one(make(rows)).collect()}
    assert set(range(0, 400, 2)) <= kept and len(kept) <= 200 + 0.01 * 200


@pytest.mark.parametrize("matched", [256, 2])
def test_pairs_below_the_threshold_stay(make, monkeypatch, matched):
    monkeypatch.setattr(simhash, "MATCHED", matched, raising=False)
    rows = pairs(3, 0.7, 0.8)
    # a chain: its ends are linked only through the middle, and a fourth text hangs on by less than 0.8
    w = [f"word{k}" for k in range(104)]
    cut = lambda a, b: " ".join(w[a:b])
    chain = [cut(0, 84), cut(8, 92), cut(16, 100), cut(34, 104)]
    assert [similarity(chain[k], chain[k + 1]) >= 0.8 for k in range(3)] == [True, True, False] and similarity(chain[0], chain[2]) < 0.8
    kept = {r.doc_id for r in simhash.keep_one(make(rows)).collect()}
    assert kept == set(range(len(rows)))
    sets = [simhash.Signer(5, 2).shingles(t) for t in chain]
    assert simhash.exact_links([0, 1, 2, 3], sets) == [(0, 1), (1, 2)]


@pytest.mark.parametrize(("bits", "parts"), [(21, 7), (28, 5)])
def test_fingerprints_within_two_bits_in_a_part_are_proposed(spark, bits, parts):
    rng, each, rows, want = random.Random(bits), 64 // bits, [], set()
    lanes = [f"p{k}" for k in range(-(-parts // each))]
    for n in range(0, 600, 2):
        own = [rng.getrandbits(bits) for _ in range(parts)]
        at = rng.randrange(parts)
        # all other parts differ in many bits, this one in 0 to 2; every bit may be set, the lane's sign too
        other = [x ^ (1 << bits) - 1 for x in own]
        other[at] = own[at] ^ sum(1 << b for b in rng.sample(range(bits), n // 2 % 3))
        for k, values in enumerate((own, other)):
            words = [sum(x << bits * j for j, x in enumerate(values[m : m + each])) | rng.getrandbits(1) << 63 for m in range(0, parts, each)]
            rows.append((n + k, n, 0, *(int(np.uint64(w).astype(np.int64)) for w in words)))
        want.add((n, n + 1))
    nodes = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in ["node", "c0", "c1", *lanes]))
    tables = simhash.part_tables(lanes, parts, bits)
    assert len(tables) == 7 * parts
    got = {tuple(sorted(e)) for e in simhash.candidate_edges(nodes, tables, 0).collect()}
    assert got == want


def test_near_copies_are_proposed_by_fingerprints(make, monkeypatch):
    rows = pairs(9, 0.8, 0.84, 20)
    assert len(simhash.keep_one(make(rows), bits=28, parts=44).collect()) == 20
    # no table, no link: nothing beside the covering tables proposes pairs
    monkeypatch.setattr(simhash, "part_tables", lambda lanes, parts, bits: [simhash.F.col("node")], raising=False)
    assert len(simhash.keep_one(make(rows)).collect()) == 40


@pytest.mark.parametrize("members", [4096, 20])
def test_large_group_is_one_tree(make, monkeypatch, members):
    monkeypatch.setattr(simhash, "MEMBERS", members)
    rng = random.Random(4)
    text = " ".join("".join(rng.choices("abcdefg", k=5)) for _ in range(300))
    rows = [text, *[near(rng, text, 2) for _ in range(300)]]
    assert [r.doc_id for r in simhash.keep_one(make(rows)).collect()] == [0]


@pytest.mark.parametrize("gather", [1, 5, 40, 1000])
def test_buckets_of_any_size_and_batch(monkeypatch, gather):
    monkeypatch.setattr(simhash, "GATHER", gather)
    rng = np.random.default_rng(gather)
    key = np.sort(rng.choice([1, 2, 2, 2, 3, 4, 5], 60) * 10 + rng.integers(0, 2, 60))
    c = (np.int64(1) << rng.integers(0, 12, 60)) * (rng.random(60) < 0.7)
    rows = pa.RecordBatch.from_arrays([pa.array(key), pa.array(key % 2 * 0), pa.array(np.arange(60)), pa.array(c), pa.array(c * 0)], ["key", "cell", "node", "c0", "c1"])
    edges = [e for b in simhash.candidates((rows.slice(k, 7) for k in range(0, 60, 7)), 1) for e in zip(*b.to_pydict().values(), strict=True)]
    assert len(edges) <= 60

    def groups(pairs):
        root = list(range(60))
        for a, b in pairs:
            x, y = root[a], root[b]
            root = [min(x, y) if r in (x, y) else r for r in root]
        return root

    want = [(a, b) for a in range(60) for b in range(a) if key[a] == key[b] and (int(c[a]) ^ int(c[b])).bit_count() <= 1]
    assert groups(edges) == groups(want)


@pytest.mark.parametrize("held", [4, 50, 1 << 20])
def test_forests_keep_the_components(spark, monkeypatch, held):
    monkeypatch.setattr(simhash, "FOREST", held, raising=False)
    rng = random.Random(held)
    # a group whose members have edges to many others, loops, repeats and small groups
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(600)] + [(k, k + 1) for k in range(100, 200, 3)] + [(7, 7), (-5, 300), (-5, 300)]
    e = pa.RecordBatch.from_arrays([pa.array([x[k] for x in edges], pa.int64()) for k in range(2)], ["u", "v"])
    got = [x for b in simhash.forest(e.slice(k, 13) for k in range(0, len(edges), 13)) for x in zip(*b.to_pydict().values(), strict=True)]

    def groups(pairs):
        root = {}
        for a, b in pairs:
            x, y = root.setdefault(a, a), root.setdefault(b, b)
            root |= {k: min(x, y) for k, r in root.items() if r in (x, y)}
        return {k: r for k, r in root.items() if k != r}

    assert groups(got) == groups(edges) and len(got) <= len(edges)
    assert held < 1 << 20 or len(got) == len(groups(edges))
    assert list(simhash.forest(iter([e.slice(0, 0)]))) == []


@pytest.mark.parametrize(("alone", "block"), [(256, 1 << 14), (8, 16), (1, 1 << 14), (40, 3)])
def test_pairs_that_only_the_first_check_bits_hold_for_near_are_not_proposed(monkeypatch, alone, block):
    monkeypatch.setattr(simhash, "ALONE", alone, raising=False)
    monkeypatch.setattr(simhash, "BLOCK", block, raising=False)
    rng = np.random.default_rng(6)
    key = np.sort(rng.choice([1, 2, 2, 2, 2, 3, 4, 5, 6, 7], 200))
    flips = [1 << rng.integers(0, 64, (200, 9)).astype(np.uint64) for _ in range(4)]  # pairs differ in up to 18 bits of a lane
    c = np.stack([np.bitwise_xor.reduce(x, axis=1) for x in flips])
    c[2:, ::2] ^= np.uint64((1 << 64) - 1)  # every second row is far from its neighbours by the last two lanes alone
    names = ["key", "cell", "node", "c0", "c1", "c2", "c3"]
    rows = pa.RecordBatch.from_arrays([pa.array(key), pa.array(key * 0), pa.array(np.arange(200)), *(pa.array(x.view(np.int64)) for x in c)], names)
    edges = [e for b in simhash.candidates(iter([rows]), 58) for e in zip(*b.to_pydict().values(), strict=True)]
    near = [(a, b) for a in range(200) for b in range(a) if key[a] == key[b] and np.bitwise_count(c[:, a] ^ c[:, b]).sum() <= 58]
    first = [(a, b) for a in range(200) for b in range(a) if key[a] == key[b] and np.bitwise_count(c[:2, a] ^ c[:2, b]).sum() <= 36]
    assert near and len(first) > 2 * len(near)

    def groups(pairs):
        root = list(range(200))
        for a, b in pairs:
            x, y = root[a], root[b]
            root = [min(x, y) if r in (x, y) else r for r in root]
        return root

    assert groups(edges) == groups(near) != groups(first)


def test_keep_one_with_odd_rows(make):
    docs = make([*ODD, "same words here", "same words here"], ids=[*range(len(ODD)), 90, 90])
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    kept = [r.doc_id for r in got.collect()]
    # null, empty and blank texts are copies of each other, as are the two of one word and the repeated row
    assert sorted(kept) == [k for k in [*range(len(ODD)), 90] if k not in (1, 2, 7)]
    assert simhash.keep_one(docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, sf_dir).collect()
        out.append((docs, rows))
        docs = spark.createDataFrame(rows, stage(spark, docs, sf_dir).schema)
    return out


def test_stages_pass_on_documents(spark, sf_dir, stages):
    columns = spark.read.parquet(f"{sf_dir}/documents.parquet").columns
    assert all(docs.columns == columns for docs, _ in stages)
    n = [len(rows) for _, rows in stages]
    source = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    # language: every document with a letter stays
    assert n[0] == sum(any(c.isalpha() for c in r.text) for r in source)
    # near copies: what went is a copy or near copy of something kept
    kept, gone = stages[1][1], {r.doc_id for r in stages[0][1]} - {r.doc_id for r in stages[1][1]}
    text = {r.doc_id: r.text for r in stages[0][1]}
    assert len({" ".join(r.text.lower().split()) for r in kept}) == len(kept)
    for d in gone:
        assert max(similarity(text[d], text[o]) for o in text if o != d) > 0.5
    # personal data: no document goes, and no address remains
    assert n[2] == n[1] and not any("@mail" in r.text for r in stages[2][1])
    assert UNKNOWN == "und"


def test_tokens_are_the_librarys(stages):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(vocabulary_path())
    docs, rows = stages[4]
    want = sorted(library.encode(r.text, add_special_tokens=False).ids for r in docs.collect())
    assert sorted(r.ids for r in rows) == want and all(r.n_tokens == len(r.ids) for r in rows)


def test_run_is_registered(spark, sf_dir):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
