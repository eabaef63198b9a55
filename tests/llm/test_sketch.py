import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparrowgrid.llm import sketch
from sparrowgrid.llm.queries import op4_fingerprints
from tests.llm.conftest import ODD


def parts(t):
    return re.findall(r"(?:[^ \n]+ *){1,20}\n*|[ \n]+", t)


def brute(rows):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, rows[k][1] or ""))
    out = []
    for at, k in enumerate(order):
        t, nxt = rows[k][1] or "", rows[order[(at + 1) % len(order)]][1] or ""
        q = len(t) // 4
        e = t[: len(t) - q] + nxt[:q]

        def like(a, b):
            x, y = Counter(parts(a)), Counter(parts(b))
            total = sum(x.values()) + sum(y.values())
            return 1 - sum(((x - y) + (y - x)).values()) / total if total else 1.0

        out.append((rows[k][0], len(t), hashlib.sha256(e.encode()).hexdigest(), round(like(t, e), 9), round(like(t, nxt), 9)))
    return sorted(out, key=repr)


def run(make, rows):
    got = sketch.digest(make([t for _, t in rows], [i for i, _ in rows])).collect()
    return got, sorted([(r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got], key=repr)


def texts(rng, n):
    words = ["".join(rng.choices("abcdé", k=4)) for _ in range(500)]
    out = []
    for _ in range(n):
        t = " ".join(rng.choices(words, k=rng.choice([1, 10, 100, 900])))
        out.append(re.sub("a", "\n", t) if rng.random() < 0.5 else t)
        if rng.random() < 0.3:
            out.append(out[-1][: len(out[-1]) // 2] + " same half " + "line\n" * 9)
    return out


@pytest.mark.parametrize("rows", [7, 2048])
def test_against_brute_force(make, monkeypatch, rows):
    monkeypatch.setattr(sketch, "ROWS", rows)
    monkeypatch.setattr(sketch, "BYTES", rows * 1000)
    rng = random.Random(11)
    ts = texts(rng, 40) + ODD
    ids = rng.sample(range(1000), len(ts))
    got, short = run(make, list(zip(ids, ts, strict=True)))
    assert short == brute(list(zip(ids, ts, strict=True)))
    by = {}
    for r, t in ((r, dict(zip(ids, ts, strict=True))[r.doc_id] or "") for r in got):
        assert by.setdefault(t, r.fingerprint) == r.fingerprint
    assert len(set(by.values())) == len(by)


def test_null_and_repeated_ids_one_document_and_none(make):
    rows = [(None, "a b"), (3, "c d e f g h i j"), (3, "c d e f g h i j"), (None, None), (3, "zz")]
    assert run(make, rows)[1] == brute(rows)
    assert run(make, [(9, "the only one here")])[1] == brute([(9, "the only one here")])
    assert sketch.digest(make(["a"]).limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 9, 60, 900])
def test_peeling_grows_until_it_recovers_all(spark, n):
    df = spark.range(1).select(
        F.transform(F.sequence(F.lit(1), F.lit(1000)), lambda x: F.xxhash64(x).bitwiseAND(F.lit(sketch.DIGEST))).alias("a"),
    ).withColumn("b", F.concat(F.slice("a", 1, 1000 - n), F.expr(f"array_repeat(cast(77 as bigint), {n})")))
    assert df.select(sketch.difference(F.col("a"), F.col("b")).alias("d")).first().d == 2 * n
    small = sketch.peel(sketch.subtract(sketch.sketch(F.col("a"), 24), sketch.sketch(F.col("b"), 24)), 24)
    assert df.select(small.alias("d")).first().d == (2 * n if n < 10 else None)


def test_digests_are_counted_where_no_sketch_peels(spark, monkeypatch):
    monkeypatch.setattr(sketch, "WAVES", 0)
    monkeypatch.setattr(sketch, "peel", lambda cells_of, cells, waves=0: F.lit(None).cast("bigint"))
    df = spark.range(1).select(F.expr("array(5L, 5L, 7L, 9L)").alias("a"), F.expr("array(9L, 5L, 8L, 8L)").alias("b"))
    assert df.select(sketch.difference(F.col("a"), F.col("b")).alias("d")).first().d == 4


def test_only_dataframe_operations(make):
    plan = sketch.digest(make(["a b", "c"]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_registered_query_cuts_paragraphs_of_20_words(spark, make, tmp_path):
    text = " ".join(f"w{k}" for k in range(100))
    changed = text.replace("w25 ", "other ")
    make([text, changed]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.near_next for r in op4_fingerprints(spark, str(tmp_path)).collect()}
    assert got == {0: pytest.approx(0.8), 1: pytest.approx(0.8)}  # one of five paragraphs differs
