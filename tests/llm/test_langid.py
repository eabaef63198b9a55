import itertools
import math
import zlib

import pytest

from sparrowgrid.llm import langid
from sparrowgrid.llm.queries import queries, vocabulary_path
from tests.llm.conftest import ODD

pytest.importorskip("sentencepiece")
VOCABULARY = vocabulary_path("piece_bpe_32k.model")


def segmentations(s):
    for cuts in itertools.product([0, 1], repeat=len(s) - 1):
        out, at = [], 0
        for k, c in enumerate([*cuts, 1], 1):
            if c:
                out.append(s[at:k])
                at = k
        yield out


def p_of(x, table, lang):
    return table[x][lang] if x in table else langid.LETTER if len(x) == 1 else 0.0


def test_forward_sums_all_segmentations():
    table = {"a": (0.1, 0.3), "b": (0.2, 0.1), "ab": (0.3, 0.05), "bca": (0.05, 0.2), "▁a": (0.1, 0.1), "▁": (0.2, 0.02)}
    for s in ("▁abcab", "abab", "▁", "zz", "▁bcabca"):
        got = langid.forward(s, table, 2)
        for k in range(2):
            assert math.isclose(math.exp(got[k]), sum(math.prod(p_of(x, table, k) for x in seg) for seg in segmentations(s)))


def test_forward_in_matrices_is_the_same():
    import random

    rng = random.Random(1)
    table = {"".join(rng.choices("abcé▁", k=rng.randint(1, 9))): (rng.random(), rng.random(), rng.random()) for _ in range(400)}
    words = ["".join(rng.choices("abcéx▁\U0001f600", k=rng.choice([rng.randint(1, 48), rng.randint(49, 300)]))) for _ in range(300)]
    for step in (4096, 32):
        langid.STEP, old = step, langid.STEP
        got = langid.Forward(table, 3).logs(words)
        langid.STEP = old
        for w, row in zip(words, got, strict=True):
            assert all(math.isclose(x, y, rel_tol=1e-9) for x, y in zip(row, langid.forward(w, table, 3), strict=True))


def test_expected_counts():
    from collections import Counter

    table = {"a": 0.1, "b": 0.2, "ab": 0.3, "ba": 0.15}
    out, total, want = Counter(), 0.0, Counter()
    langid.expected("abab", table, 2.0, out)
    for seg in segmentations("abab"):
        p = math.prod(table.get(x, 0.0) for x in seg)
        total += p
        for x in seg:
            want[x] += p
    for x in table:
        assert math.isclose(out[x], 2.0 * want[x] / total, abs_tol=1e-12)


def test_expected_counts_of_long_words_are_the_same(monkeypatch):
    from collections import Counter

    table = {"a": 0.1, "ab": 0.3, "bab": 0.15, "c": 0.01}
    for word in ("abxbabcab", "x" * 12, "babbabaab"):
        short, long = Counter(), Counter()
        langid.expected(word, table, 3.0, short)
        monkeypatch.setattr(langid, "WIDE", 2)
        langid.expected(word, table, 3.0, long)
        monkeypatch.undo()
        assert short.keys() == long.keys() and all(math.isclose(short[k], long[k]) for k in short)


def test_all_pieces_are_in_use():
    got = langid.pieces(VOCABULARY)
    assert len(got) == 23948 and langid.reach(dict.fromkeys(got)) == 16


@pytest.mark.parametrize("size", [60, 5000])
def test_long_words_outside_the_vocabulary(make, size):
    rows = [("the house of the king", "en"), ("das haus und der hund", "de")] * 10
    rows += [("ሀ" * size, "en"), ("the king " + "ለ" * size + " of the house", "en"), ("ሐ" * size, None), ("das haus " + "መ" * size + " und der hund", None)]
    got = sorted(langid.identify(make(rows), VOCABULARY).collect())
    assert len(got) == len(rows) and all(r.lang_pred in ("en", "de") and 0 <= r.score <= 1 for r in got)
    assert got[21].lang_pred == "en" and got[23].lang_pred == "de" and got[23].score > 0.9


@pytest.fixture(scope="module")
def got(spark, sf_dir):
    return queries()["op1_language"](spark, sf_dir).collect()


def test_held_out_accuracy(spark, sf_dir, got):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect()}
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_labels_of_held_out_rows_are_unused(spark, make):
    rows = [("the house of the king", "en"), ("das haus und der hund", "de")] * 30
    ids = list(range(60))
    flipped = [(t, "zz" if zlib.crc32(str(i).encode()) % 3 == 1 else x) for i, (t, x) in zip(ids, rows, strict=True)]
    a = langid.identify(make(rows, ids), VOCABULARY).collect()
    b = langid.identify(make(flipped, ids), VOCABULARY).collect()
    assert sorted(a) == sorted(b) and {r.lang_pred for r in a} == {"en", "de"}


def test_odd_rows(spark, make):
    rows = [("the house of the king", "en"), ("das haus und der hund", "de")] * 10 + [(t, None) for t in ODD] + [("123 !! ²", "en"), ("y" * 5000, "de")]
    docs = make(rows)
    got = {r.doc_id: r for r in langid.identify(docs, VOCABULARY).collect()}
    assert len(got) == len(rows)
    for k, r in got.items():
        t = rows[k][0]
        assert (r.lang_pred == "und") == (not t or not any(c.isalpha() for c in t))
    kept = langid.keep_identified(docs, VOCABULARY)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, r in got.items() if r.lang_pred != "und" and r.score >= 0.5}
    assert langid.identify(docs.limit(0), VOCABULARY).count() == 0
    unlabelled = langid.identify(make([("some words", None)]), VOCABULARY).collect()
    assert [(r.lang_pred, r.score) for r in unlabelled] == [("und", 0.0)]
