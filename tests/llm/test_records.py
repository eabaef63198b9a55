import zlib

import numpy as np
import pytest

from sparrowgrid.llm import records
from sparrowgrid.llm.queries import vocabulary_path
from tests.llm.conftest import ODD

tokenizers = pytest.importorskip("tokenizers")


def test_frames_round_trip_and_catch_damage():
    a, b = records.frame(records.payload(7, np.array([1, 2, 70000]))), records.frame(records.payload(None, np.array([], np.uint32)))
    got = list(records.read_file(a + b))
    assert [(d, x.tolist()) for d, x in got] == [(7, [1, 2, 70000]), (None, [])]
    index = np.array([0, len(a)], "<u8").tobytes()
    assert [d for d, _ in records.shuffled(a + b, index, [1, 0, 1])] == [None, 7, None]
    for at in (0, 9, 20, len(a) - 2):
        bad = bytearray(a)
        bad[at] ^= 1
        with pytest.raises(records.CorruptRecord):
            list(records.read_file(bytes(bad)))
    with pytest.raises(records.CorruptRecord):
        list(records.read_file(a[:-1]))


def test_fast_encoder_as_the_library():
    library, fast = tokenizers.Tokenizer.from_file(vocabulary_path()), records.FastEncoder(vocabulary_path())
    points = [chr(c) for c in range(0x20000) if not 0xD800 <= c <= 0xDFFF]
    texts = [f"a{c}1 {c} '{c}!" for c in points] + [t for t in ODD if t is not None]
    for t, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert fast.encode(t).tolist() == want.ids


@pytest.mark.parametrize("unit", [" ", "\n", "x"])
def test_runs_of_a_million(unit):
    library, fast = tokenizers.Tokenizer.from_file(vocabulary_path()), records.FastEncoder(vocabulary_path())
    text = f"begin{unit * 1_100_000}end"
    assert fast.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("size,file", [(500, 300), (20000, 1), (8 << 20, 256 << 20)])
def test_files_against_the_library(spark, make, tmp_path, monkeypatch, size, file):
    monkeypatch.setattr(records, "CHUNK", size)
    library = tokenizers.Tokenizer.from_file(vocabulary_path())
    ids = [5, 3, 9, 1, 0, 100, 50, 51, 2, 7, 6]
    docs = make(ODD, ids)
    folder = f"file://{tmp_path}/out"
    records.write(docs, vocabulary_path(), folder, size=size, file=file)
    got = {r.doc_id: r for r in records.read(spark, folder).collect()}
    files = records.shards(spark, folder).count()
    assert len(list((tmp_path / "out").glob("*.idx"))) == files == len(list((tmp_path / "out").glob("*.rec")))
    assert not list((tmp_path / "out").glob("*tmp")) and (files == 1) == (size > 1 << 20)
    at = 0
    for doc_id, text in sorted(zip(ids, ODD, strict=True)):
        want = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert (got[doc_id].start, got[doc_id].n_tokens, got[doc_id].ids_crc32) == (at, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        at += len(want)


def test_damage_of_files_is_found(spark, make, tmp_path):
    for what in ("rec", "idx"):
        folder = tmp_path / what
        records.write(make(["some words", "more", "and more"]), vocabulary_path(), f"file://{folder}")
        (path,) = folder.glob(f"*.{what}")
        bad = bytearray(path.read_bytes())
        bad[len(bad) // 2] ^= 1
        path.write_bytes(bytes(bad))
        with pytest.raises(Exception, match="CorruptRecord"):
            records.read(spark, f"file://{folder}").collect()


def test_many_rows_of_one_id(spark, make, tmp_path):
    texts = [f"text number {k} " * 20 for k in range(60)]
    folder = f"file://{tmp_path}/hot"
    records.write(make(texts, [None] * 60), vocabulary_path(), folder, size=2000)
    assert records.shards(spark, folder).count() > 3
    got = sorted((r.start, r.n_tokens) for r in records.read(spark, folder).collect())
    assert len(got) == 60 and [a for a, _ in got] == [sum(n for _, n in got[:k]) for k in range(60)]


def test_empty_null_and_repeated_ids(spark, make, tmp_path):
    docs = make(["b", "a", "c", "a"], [4, None, 4, 4])
    got = records.digest(docs, vocabulary_path(), f"file://{tmp_path}/r").collect()
    assert sorted((r.start, r.doc_id) for r in got) == [(0, None), (2, 4), (4, 4), (6, 4)]
    assert records.digest(docs.limit(0), vocabulary_path(), f"file://{tmp_path}/e").count() == 0
