from datetime import date

import pytest

from sparrowgrid.llm import urlfilter as u
from sparrowgrid.llm.queries import oracle_sql, queries
from tests.compare import compare, duck


@pytest.fixture
def entries(spark):
    rows = [
        ("ads", "block", "example.com", "add", "2024-01-01"), ("ads", "block", "example.com", "remove", "2024-02-01"),
        ("ads", "block", "example.com", "add", "2024-01-15"), ("ads", "block", "example.com", "add", "2024-03-01"),
        ("own", "allow", "good.example.com", "add", "2024-01-10"), ("own", "allow", "example.com/free/a", "add", "2024-01-01"),
        ("bad", "block", "good.example.com", "add", "2024-06-01"), ("bad", "block", "good.example.com", "remove", "2024-06-01"),
        ("bad", "block", "co", "add", "2024-01-01"), ("bad", "block", "localhost", "add", "2024-01-01"),
        (None, "block", "x.y", "add", "2024-01-01"), ("odd", "block", "x.y", "drop", "2024-01-01"), ("odd", "block", "x.y", "add", None),
    ]
    return spark.createDataFrame(rows, "list string, verdict string, pattern string, action string, entry_date string")


def test_intervals(entries):
    got = {(r.list, r.pattern, str(r.valid_from), str(r.valid_to)) for r in u.intervals(entries).collect()}
    assert ("ads", "example.com", "2024-01-01", "2024-02-01") in got and ("ads", "example.com", "2024-03-01", u.OPEN_END) in got
    assert ("bad", "good.example.com", "2024-06-01", u.OPEN_END) in got
    assert not [x for x in got if x[1] == "x.y"] and len(got) == 7


@pytest.mark.parametrize("url,day,want", [
    ("http://example.com/x", "2024-01-01", (1, True, "ads")), ("http://example.com/x", "2024-01-31", (1, True, "ads")),
    ("http://example.com/x", "2024-02-01", (0, False, None)), ("https://u:p@A.B.Example.COM:80/?q#f", "2024-03-02", (1, True, "ads")),
    ("http://good.example.com/", "2024-01-09", (1, True, "ads")), ("http://good.example.com/", "2024-01-12", (2, False, "own")),
    ("http://good.example.com", "2024-06-02", (3, True, "bad")), ("http://example.com//free/a/b", "2024-01-03", (2, False, "own")),
    ("http://example.com/free/ab", "2024-01-03", (1, True, "ads")), ("http://notexample.com/", "2024-01-03", (0, False, None)),
    ("http://shop.co/", "2024-01-03", (0, False, None)), ("http://localhost/", "2024-01-03", (1, True, "bad")),
    ("/relative", "2024-01-03", (0, False, None)), (None, "2024-01-03", (0, False, None)), ("http://example.com", None, (0, False, None)), ("", "2024-01-03", (0, False, None)),
])
def test_judgements(spark, entries, url, day, want):
    caps = spark.createDataFrame([(1, url, day, "list"), (1, url, day, "pattern")], "page_id long, url string, fetch_date string, list string")
    got = u.judge(caps, entries).collect()
    assert [(r.matches, r.blocked, r.rule_list) for r in got] == [want] * 2


def test_deep_patterns(spark):
    host, way = ".".join("abcdefghijklmnopqrst") + ".org", "/".join(map(str, range(1, 15)))
    labels = host.split(".")
    cases = [(f"x.com/{'/'.join(map(str, range(1, n + 1)))}", 1, f"http://x.com/{way}") for n in (1, 5, 12)] + [(".".join(labels[-n:]), 1, f"http://{host}/") for n in (2, 9, 20, 21)]
    cases += [("x.com/1/2/3/4/5/6", 0, "http://x.com/1/2/3/4/5/7"), ("org", 0, f"http://{host}/"), (f"z.{host}", 0, f"http://{host}/")]
    for pattern, n, url in cases:
        e = spark.createDataFrame([("own", "block", pattern, "add", "2024-01-01")], "list string, verdict string, pattern string, action string, entry_date string")
        c = spark.createDataFrame([(1, url, "2024-01-02")], "page_id long, url string, fetch_date string")
        assert [r.matches for r in u.judge(c, e).collect()] == [n], pattern


def test_query_meets_deep_entries(spark, sf_dir):
    got = queries()["op10_url_filter"](spark, sf_dir).filter("mirror").collect()
    rules = [r.rule_pattern or "" for r in got]
    assert max(x.count("/") for x in rules) == 11 and max(len(x.split(".")) for x in rules if "/" not in x) >= 9


def test_pages_without_urls(spark):
    pages = spark.createDataFrame([(1, None, "a"), (2, "/x", "b"), (2, "/x", "b"), (None, "http://a.b/en", "c")], "page_id long, url string, host string")
    got = u.digest(pages).collect()
    assert len(got) == 8 and all(r.matches == 0 for r in got if r.page_id)
    assert u.digest(pages.limit(0)).count() == 0


def test_empty_tables(spark, entries):
    caps = spark.createDataFrame([(1, "http://example.com", "2024-01-03")], "page_id long, url string, fetch_date string")
    assert u.judge(caps.limit(0), entries).count() == 0
    assert [r.blocked for r in u.judge(caps, entries.limit(0)).collect()] == [False]


def test_oracle(spark, sf_dir):
    assert compare(spark, duck(sf_dir), queries()["op10_url_filter"], oracle_sql()["op10_url_filter"], sf_dir) == ""
