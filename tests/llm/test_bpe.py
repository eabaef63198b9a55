import hashlib
import json
import random

import pytest

from sparrowgrid.llm import bpe
from sparrowgrid.llm.queries import queries, vocabulary_path
from tests.llm.conftest import ODD

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(vocabulary_path())


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(vocabulary_path())


def test_odd_texts_as_the_library(library, encoder):
    for t in ODD:
        if t is not None:
            ids = library.encode(t, add_special_tokens=False).ids
            assert encoder.encode(t) == ids
            assert bpe.decode(encoder.merges, ids) == library.decode(ids, skip_special_tokens=False) == t


def test_random_texts_as_the_library(library, encoder):
    rng = random.Random(5)
    for _ in range(300):
        letters = rng.choice(["ab", "aeiouthsn", "0123456789 ", "=-_ \n", "éèñß thering", "<|endoftext|>'s re", "  \x1c\x85a1"])
        t = "".join(rng.choices(letters, k=rng.choice([3, 40, 700, 3000])))
        assert encoder.encode(t) == library.encode(t, add_special_tokens=False).ids


def test_every_code_point(library, encoder):
    points = [chr(c) for c in range(0x3100) if not 0xD800 <= c <= 0xDFFF]
    texts = [f"a{c}1 {c} '{c}!" for c in points]
    for t, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert encoder.encode(t) == want.ids


@pytest.mark.parametrize("piece,run", [(1, 1), (2, 3), (7, 4), (50, 20)])
def test_texts_in_pieces_of_any_size_as_the_library(library, encoder, monkeypatch, piece, run):
    monkeypatch.setattr(bpe, "PIECE", piece)
    monkeypatch.setattr(bpe, "RUN", run)
    rng = random.Random(piece)
    texts = [t for t in ODD if t is not None and len(t) < 5000]
    for _ in range(150):
        letters = rng.choice([["ab", " ", "'re", "'s", "'"], ["12", " ", "   ", "\n", "\t", "x"], ["<|endoftext|>", "<|end", "a", " "], ["é", "漢", "\U0001f600", " ", "!?", "'ll"], [" "], ["x"], ["7"], ["-"]])
        texts.append("".join(rng.choices(letters, k=rng.choice([1, 2, 5, 40, 200]))))
    for t in texts:
        assert encoder.encode(t) == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_streams_hold_a_bounded_part(encoder):
    for unit in ("ab", " ", "12", "-", "word "):
        t, held = bpe.TextStream(encoder), 0
        for _ in range(40):
            t.push(unit * 5000)
            held = max(held, len(t.raw) + len(t.held) + len(t.run.held if t.run else b""))
        assert held <= bpe.RUN + 500


@pytest.mark.parametrize("unit", [" ", "\n", "x", "\r\n", "ab"])
def test_runs_of_a_million(library, encoder, unit):
    text = f"begin{unit * (1_100_000 // len(unit))}end"
    assert encoder.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_pushes_of_any_size_give_the_same_tokens(encoder):
    rng, data = random.Random(2), "".join(random.Random(1).choices("aetrhins", k=5000)).encode()
    whole = encoder.merges.merge([encoder.merges.byte_id[b] for b in data])
    for size in (1, 7, 300, 5000):
        t, got, at = bpe.Transducer(encoder.merges, window=16), [], 0
        while at < len(data):
            n = rng.randint(1, size)
            got += t.push(data[at : at + n])
            at += n
            assert len(t.held) <= t.window
        assert got + t.finish() == whole


def test_kept_words_share_their_tokens_numbers(encoder, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 8)
    rng, words, number = random.Random(6), bpe.Words(encoder.merges), {}
    for k in range(300):
        w = " " + "".join(rng.choices("abcdeé the", k=rng.choice([1, 5, 12, 64, 300])))
        assert list(words[w]) == encoder.merges.ids(w.encode()), w
        assert all(number.setdefault(i, i) is i for i in words[w])
    assert len(words) + len(words.old) <= 8 and not words.transducer.held


def test_lookahead_bounds_what_follows(encoder):
    """Tokens that end the lookahead before a cut don't depend on what is after the cut."""
    m, rng = encoder.merges, random.Random(3)
    for _ in range(200):
        s = "".join(rng.choices("aetrhinsou", k=400)).encode()
        cut = rng.randint(m.lookahead + 1, 399)

        def ends(data):
            at, out = 0, []
            for t in m.merge([m.byte_id[b] for b in data]):
                at += len(m.token_bytes[t])
                out.append(at)
            return [x for x in out if x <= cut - m.lookahead]

        assert ends(s) == ends(s[:cut])


def test_small_merge_list_lookahead(tmp_path):
    letters = bpe.byte_letters()
    vocab = {letters[b]: b for b in range(256)} | {"ab": 256, "bc": 257, "cd": 258}
    spec = {"model": {"vocab": vocab, "merges": [["c", "d"], ["b", "c"], ["a", "b"]]}}
    p = tmp_path / "m.json"
    p.write_text(json.dumps(spec))
    # a·b waits for b·c, which waits for c·d: three bytes to the right
    assert bpe.MergeList(str(p)).lookahead == 3


def test_split_bytes_decode_when_complete(encoder):
    m = encoder.merges
    d = bpe.Decoder(m)
    got = [d.push([m.byte_id[b]]) for b in "é€\U0001f600".encode()]
    assert "".join(got) == "é€\U0001f600" and got[0] == ""
    d.push([m.byte_id[0xE2]])
    assert d.finish() == "�"


def test_query(spark, make, library, tmp_path):
    make(ODD).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries()["op5_bpe_round_trip"](spark, str(tmp_path)).collect()}
    assert len(got) == len(ODD)
    for k, t in enumerate(ODD):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[k].n_tokens == len(ids)
        assert got[k].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_columns_and_empty_table(spark, make):
    docs = make(ODD)
    got = bpe.encode_column(docs, vocabulary_path())
    assert got.columns == [*docs.columns, "ids"] and got.count() == len(ODD)
    assert bpe.round_trip(docs.limit(0), vocabulary_path()).count() == 0
