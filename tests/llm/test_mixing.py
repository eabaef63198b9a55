import re
from collections import Counter, defaultdict

from sparrowgrid.llm import mixing
from tests.llm.conftest import ODD


def count(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def test_targets_stop_and_reshare():
    got = {s.source: s.target for s in mixing.targets({"a": 100, "b": 100, "c": 1000, None: 50})}
    # a (weight 3) stops at 200, the rest shares 1875 - 200 by 1, 2, 3: the null source stops at 100
    assert got["a"] == 200 and got[None] == 100
    assert abs(got["b"] - 200) < 1e-9 and abs(got["c"] - 1375) < 1e-9
    assert abs(sum(got.values()) - 1.5 * 1250) < 1e-9
    assert [s.source for s in mixing.targets({"b": 1, None: 1, "a": 1, "B": 1})] == ["B", "a", "b", None]
    assert mixing.targets({}) == [] and mixing.targets({"a": 0})[0].target == 0


def test_golden_points_are_evenly_spread(spark):
    from pyspark.sql import functions as F

    u = [r.u for r in spark.range(1000).select(mixing.golden_point(F.col("id")).alias("u")).collect()]
    assert u == [j * mixing.GOLDEN % 2**32 for j in range(1000)]
    far = spark.createDataFrame([(2**32 + 12345,), (2**31 + 7,)], "id long").select(mixing.golden_point(F.col("id")).alias("u")).collect()
    assert [r.u for r in far] == [(2**32 + 12345) * mixing.GOLDEN % 2**32, (2**31 + 7) * mixing.GOLDEN % 2**32]


def test_schedule_is_balanced_and_whole(spark):
    sources = [mixing.Source(0, "a", 10_000, 9_000.0), mixing.Source(1, "b", 5_000, 3_000.0), mixing.Source(2, "c", 9, 0.0)]
    got = mixing.schedule(spark, sources, block=10).orderBy("position").collect()
    ranks = defaultdict(list)
    for r in got:
        ranks[r.sid].append(r["rank"])
    assert ranks == {0: list(range(900)), 1: list(range(300))}
    for n in (100, 400, 1000):
        assert abs(sum(r.sid == 0 for r in got[:n]) - 0.75 * n) < 5


def test_takes_near_targets_and_reruns_agree(spark, make):
    rows = [(" ".join(["w"] * (k % 37)), "en", f"s{min(k % 10, 6)}") for k in range(600)] + [(t, "en", None) for t in ODD]
    docs = make(rows)
    got = mixing.digest(docs, block=16).collect()
    again = mixing.digest(docs.repartition(7), block=16).collect()
    assert sorted(got) == sorted(again) and len(got) == len(rows)
    want = Counter()
    for r in rows:
        want[r[2]] += count(r[0])
    taken, target, by = Counter(), {}, {k: r for k, r in enumerate(rows)}
    for r in got:
        text, _, source = by[r.doc_id]
        assert r.size == count(text) and r.source_size == want[source] and 0 <= r.taken <= 2 * r.size
        taken[source] += r.taken
        target[source] = r.target
    assert target == {s.source: s.target for s in mixing.targets(want)}
    assert all(0 <= target[s] - taken[s] < 1 + 1e-6 for s in target)


def test_pieces_cover_slots_in_order(spark, make):
    docs = make([("a b c d e f g", "en", "x"), ("h i j k", "en", "x"), ("l m n", "en", "y"), ("", "en", "y")])
    m = mixing.mix(docs, block=4)
    pieces = m.pieces.collect()
    by_slot = defaultdict(int)
    for p in pieces:
        by_slot[p.sid, p["rank"]] += p.to_word - p.from_word
    words = {s.sid: s.words for s in m.sources}
    assert all(n == min(4, words[sid] - 4 * rank) for (sid, rank), n in by_slot.items())


def test_apply_keeps_columns_and_repeats(spark, make):
    docs = make([("a b", "en", "x"), ("a b", "en", "x"), ("c d e", "en", "y"), (None, "en", None), ("", None, "x")], ids=[1, 1, 2, 3, 4])
    got = mixing.apply(docs, block=2)
    assert got.columns == docs.columns
    n = Counter(r.doc_id for r in got.collect())
    taken = Counter()
    for r in mixing.digest(docs, block=2).collect():
        taken[r.doc_id] += r.taken
    assert set(n) <= {1, 2} and abs(2 * n[1] - taken[1]) <= 2 and abs(3 * n[2] - taken[2]) <= 3
    assert mixing.apply(docs.limit(0)).count() == 0 and mixing.digest(docs.limit(0)).count() == 0
