import hashlib
import random
import re

from sparrowgrid.llm import pii
from tests.llm.conftest import ODD

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(s):
    return [int(c) for c in s if c in "0123456789"]


def checks(s):
    d = digits(s)[::-1]
    return 13 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def brute(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if checks(m[0])]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return out


CASES = [
    "write to a.b@c.de or x@y, 1.2.3.4.5.6.7.8, 256.1.1.1, 0255.1.1.1 and +1 (974) 555-3436.",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112, 378282246310005; iban DE89 3704 0044 0532 0130 00, DE89 3704 0044 0532 0130 01",
    "a@b.c@d.e a@@b.c @x.y a@b..c ssn 123-45-6789 and 123-45-6788" + " " * 50 + "987-65-4321",
    "٣.٣.٣.٣ ４１１１ 1.1.1.٣ é@ü.de",
]


def test_base_spans_against_plain_patterns():
    rng = random.Random(4)
    texts = [*CASES, *(t for t in ODD if t)]
    for _ in range(3000):
        texts.append("".join(rng.choices(rng.choice(["a1.@-", "0123456789 -", "+()0123456789 .-", "1.25 ", "ab@.c d+%_"]), k=rng.choice([5, 20, 60]))))
    for t in texts:
        assert list(pii.base_spans(t)) == brute(t), t


def test_long_runs_take_linear_time():
    for t in ("1" * 300_000, "a" * 300_000, "a@" * 100_000, "+1" * 100_000, "1." * 100_000, "a." * 100_000 + "@", "A" * 300_000, "AB12" * 60_000):
        pii.find(t)


def test_added_kinds_need_checksum_or_context():
    kinds = [s.kind for s in pii.find(CASES[1])]
    assert kinds.count("iban") == 1
    spans = pii.find(CASES[2])
    assert [CASES[2][s.start : s.end] for s in spans if s.kind == "ssn"] == ["123-45-6789", "123-45-6788"]
    assert all(0 < s.score <= 1 for s in spans)
    assert not [s for s in pii.find("number 123-45-6789") if s.kind == "ssn"]
    near, far = pii.find("card 4111111111111111")[0], pii.find("x 4111111111111111")[0]
    assert near.score > far.score


def test_query_digest(make):
    texts = [*CASES, *ODD]
    got = {r.doc_id: r for r in pii.digest(make(texts)).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        want = brute(t or "")
        assert got[k].base_sha256 == hashlib.sha256(",".join(f"{a}:{b}:{c}" for a, b, c in want).encode()).hexdigest()
        assert (got[k].n_email, got[k].n_ip, got[k].n_card, got[k].n_phone) == tuple(sum(x[0] == kind for x in want) for kind in pii.BASE)
        assert {f"{a}:{b}:{c}" for a, b, c in want} <= set(got[k].spans.split(","))


def test_mask_keeps_columns_and_nulls(make):
    docs = make([CASES[0], None, "clean"])
    got = {r.doc_id: r for r in pii.mask(docs).collect()}
    assert pii.mask(docs).columns == docs.columns
    assert got[0].text.startswith("write to <EMAIL> or x@y, <IP>.<IP>,") and got[0].n_chars == len(got[0].text)
    assert got[1].text is None and got[1].n_chars is None and got[2].text == "clean"
    assert pii.mask(docs.limit(0)).count() == 0


def test_context_words_count_whole():
    ip = "10.1.2.3"
    for text, near in (
        (f"the ip {ip}", True), (f"IP: {ip}", True), (f"a ship {ip}", False), (f"{ip} is a host", True), (f"{ip} hostile", False),
        (f"ip{' ' * 38}{ip}", True), (f"ip{' ' * 39}{ip}", False), (f"ship{' ' * 38}{ip}", False), (f"{ip}{' ' * 38}ip", True), (f"{ip}{' ' * 38}ips", False), (f"{ip}{' ' * 39}ip", False),
    ):
        (span,) = [s for s in pii.find(text) if s.kind == "ip"]
        assert (span.score > pii.PRIOR["ip"]) is near, text
    assert [s.kind for s in pii.find("social 123-45-6789")] == ["ssn"] and not pii.find("antisocially 123-45-6789")


def test_digest_of_nothing_and_of_repeated_rows(spark):
    rows = [(1, "a@b.c"), (1, "a@b.c"), (2, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_email"], r["spans"]) for r in pii.digest(df).collect())
    assert got == [(0, 0, ""), (1, 1, "email:0:5"), (1, 1, "email:0:5"), (2, 0, "")]
    assert pii.digest(df.limit(0)).collect() == []
