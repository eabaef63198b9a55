import numpy as np
import pytest

from sparrowgrid.llm import ann
from sparrowgrid.llm.queries import queries


def table(spark, vectors, ids=None):
    rows = [(ids[k] if ids else k, None if v is None else [None if x is None else float(x) for x in v], "x") for k, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, shard string")


def brute(vectors, ids, k=20):
    x = np.array(vectors, np.float32).astype(np.float64)
    out = {}
    for i, v in zip(ids, x, strict=True):
        if i % 20 == 0:
            s = x @ v
            order = sorted((j for j in range(len(ids)) if ids[j] != i), key=lambda j: (-s[j], ids[j]))[:k]
            out[i] = [(ids[j], s[j]) for j in order]
    return out


def recall(got, want):
    return np.mean([len({r.vec_id for r in got if r.query_id == q} & {i for i, _ in w}) / len(w) for q, w in want.items()])


@pytest.mark.parametrize("shard", [400, 5000])
def test_recall_against_brute_force(spark, shard):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1200, 16)) * rng.uniform(0.2, 3, size=(1200, 1))
    df = table(spark, x)
    got = ann.search(df, df.filter("vec_id % 20 = 0"), shard=shard).collect()
    want = brute(x, list(range(1200)))
    assert recall(got, want) >= 0.95
    exact = np.array(x, np.float32).astype(np.float64)
    for r in got:
        assert r.vec_id != r.query_id and abs(r.score - exact[r.query_id] @ exact[r.vec_id]) < 1e-12
    assert sorted((r.query_id, r["rank"]) for r in got) == [(q, k) for q in sorted(want) for k in range(1, 21)]


@pytest.mark.parametrize("kind", ["gaussian", "outlier", "large", "small", "spread"])
def test_recall_at_any_length(spark, kind):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3000, 64))
    if kind == "outlier":
        x[11] *= 10_000
    elif kind == "spread":
        x *= 10.0 ** rng.integers(-3, 4, (3000, 1))
    else:
        x *= {"gaussian": 1, "large": 1e20, "small": 1e-20}[kind]
    x = x.astype(np.float32)
    df = table(spark, x)
    got = ann.search(df, df.filter("vec_id % 20 = 0")).collect()
    assert len(got) == 3000 and recall(got, brute(x, list(range(3000)))) >= 0.9


def test_a_vector_that_nearly_all_share(spark, monkeypatch):
    monkeypatch.setattr(ann, "MERGED", 2)
    df = spark.range(20_000).selectExpr("id as vec_id", "if(id % 50 = 7, array(float(id), 1f), array(3f, 2f)) as embedding")
    got = ann.distinct_vectors(ann.usable(df), 20_000, 20).collect()
    assert len(got) == 401 and [r.ids for r in got if len(r.ids) > 1] == [[*range(7), *range(8, 22)]]


def test_query_recall(spark, sf_dir):
    got = queries()["op2_nearest_vectors"](spark, sf_dir).collect()
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    assert recall(got, brute([r.embedding for r in rows], [r.vec_id for r in rows])) >= 0.9


def test_pruning_keeps_the_nearest_and_drops_the_hidden():
    angle = np.array([0, 0.1, 0.2, -1.0])
    x = np.stack([np.cos(angle), np.sin(angle)], 1)
    got = ann.robust_prune(x, np.array([0]), np.array([[1, 2, 3, 1, -1, 0]]), 1.0, 4)[0]
    assert set(got[got >= 0]) == {1, 3}


def test_copies_ties_and_rows_that_take_no_part(spark):
    same = [1.0, 2.0]
    vectors = [same] * 60 + [None, [0, 0], [1, None], [float("nan"), 1], [float("inf"), 1], [1.0, 2.0, 3.0], [3.0, 1.0]]
    df = table(spark, vectors)
    got = ann.search(df, df.filter("vec_id % 20 = 0"), shard=8).orderBy("query_id", "rank").collect()
    by = {q: [r.vec_id for r in got if r.query_id == q] for q in (0, 20, 40, 60)}
    assert by[0] == list(range(1, 21)) and by[20] == list(range(20)) and by[40] == list(range(20)) and by[60] == []


def test_fewer_candidates_than_asked_and_empty(spark):
    df = table(spark, [[1, 0], [0, 1], [1, 1]], [0, 20, 40])
    got = ann.search(df, df).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [(0, 1, 40), (0, 2, 20), (20, 1, 40), (20, 2, 0), (40, 1, 0), (40, 2, 20)]
    assert ann.search(df.limit(0), df).count() == 0 and ann.search(df, df.limit(0)).count() == 0
    one = table(spark, [[1.0, 2.0]])
    assert ann.search(one, one).count() == 0
