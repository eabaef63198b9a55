"""URL filters by temporal lists: dated entries become validity intervals, and every capture is judged against the
entries active when it was fetched.

An entry names a list, its verdict (block or allow), a pattern and a date on which the pattern is added or removed.
A pattern is a host (it covers the host and all below it) or a host with the start of a path. DataFrame operations
only: a capture's possible patterns are unfolded from its URL, so the as-of join is on equality of pattern and day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: After every date.
OPEN_END = "9999-12-31"


def host_of(url: Column) -> Column:
    """Lower-cased host without user, port or a final dot; empty for what is no absolute URL."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*[^/?#:@.])", 1), F.lit(""))


def path_of(url: Column) -> Column:
    """The path, without query and fragment; ``/`` where there is none."""
    p = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(F.coalesce(p, F.lit("")) == "", "/").otherwise(p)


def folders_of(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def patterns_of(host: Column, path: Column, labels: int, folders: int) -> Column:
    """All patterns that could cover a URL: its host's suffixes of 2 to ``labels`` labels, the whole host, and the
    host with the first 1 to ``folders`` folders of its path."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    from_label = F.sequence(F.greatest(F.lit(1), n - max(labels, 2) + 1), F.greatest(F.lit(1), n - 1))
    suffixes = F.transform(from_label, lambda k: F.array_join(F.slice(parts, k, n), "."))
    way = folders_of(path)
    depth = F.least(F.size(way), F.lit(folders))
    below = F.when(depth > 0, F.transform(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), lambda k: F.concat(host, F.lit("/"), F.array_join(F.slice(way, 1, k), "/"))))
    return F.when(host != "", F.array_distinct(F.concat(suffixes, F.array(host), F.coalesce(below, F.array().cast("array<string>"))))).otherwise(F.array().cast("array<string>"))


def depths(entries: DataFrame) -> tuple[int, int]:
    """The most labels and the most folders of a listed pattern; (0, 0) of no entries."""
    way = F.split("pattern", "/")
    got = entries.select(F.size(F.split(F.get(way, F.lit(0)), r"\.")).alias("labels"), (F.size(way) - 1).alias("folders")).agg(F.max("labels"), F.max("folders")).first()
    return got[0] or 0, got[1] or 0


def intervals(entries: DataFrame) -> DataFrame:
    """``(list, verdict, pattern, valid_from, valid_to)`` with the end exclusive, from dated entries
    ``(list, verdict, pattern, action 'add' or 'remove', entry_date)``.

    Entries with a null among these go. On one date a removal yields to an addition; a repeated addition goes on.
    Each history is one row a date at most, whatever the entries' number.
    """
    e = entries.select("list", "verdict", "pattern", "action", F.col("entry_date").cast("date").alias("d")).dropna().filter(F.col("action").isin("add", "remove"))
    daily = e.groupBy("list", "verdict", "pattern", "d").agg(F.max((F.col("action") == "add").cast("int")).alias("on"))
    history = Window.partitionBy("list", "verdict", "pattern").orderBy("d")
    changed = daily.withColumn("was", F.coalesce(F.lag("on").over(history), F.lit(0))).filter("on <> was")
    spans = changed.withColumn("valid_to", F.coalesce(F.lead("d").over(history), F.lit(OPEN_END).cast("date"))).filter("on = 1")
    return spans.select("list", "verdict", "pattern", F.col("d").alias("valid_from"), "valid_to")


def judge(captures: DataFrame, entries: DataFrame, key: str = "page_id") -> DataFrame:
    """``(key, host, fetch_date, matches, blocked, rule_list, rule_pattern)`` of every capture ``(key, url, fetch_date)``.

    The longest active pattern rules; of equal ones a block does, then the first list. ``matches`` counts active
    entries. A capture without an active entry, a null or relative URL or a null date isn't blocked, and its rule
    is null. Repeated captures stay. URLs are judged once for each distinct (host, path, date), so that a host with
    most of the captures isn't joined row by row; only those distinct cases meet the entries. A URL is unfolded as deep
    as the deepest listed pattern is, however deep: those two numbers reach the driver first.
    """
    labels, deep = depths(entries)
    c = captures.select(key, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("fetch_date").cast("date").alias("fetch_date"))
    c = c.withColumn("top", F.array_join(F.slice(folders_of(F.col("path")), 1, deep), "/")).drop("path")
    # a pattern's captures of one day are judged once
    cases = c.filter("host <> '' and fetch_date is not null").select("host", "top", "fetch_date").distinct()
    wanted = cases.select("host", "top", "fetch_date", F.explode(patterns_of(F.col("host"), F.col("top"), labels, deep)).alias("pattern"))
    on = (F.col("w.pattern") == F.col("e.pattern")) & (F.col("w.fetch_date") >= F.col("e.valid_from")) & (F.col("w.fetch_date") < F.col("e.valid_to"))
    active = wanted.alias("w").join(intervals(entries).alias("e"), on).select("w.host", "w.top", "w.fetch_date", "e.pattern", "e.list", "e.verdict")
    rank = F.struct(F.length("pattern").alias("length"), (F.col("verdict") == "block").alias("block"))
    # the first list of equal rules: the least of (-length, allow, list)
    order = F.struct((-F.length("pattern")).alias("length"), (F.col("verdict") != "block").alias("allow"), F.col("list").alias("list"), F.col("pattern").alias("pattern"))
    best = active.groupBy("host", "top", "fetch_date").agg(F.count("*").alias("matches"), F.max(rank).alias("rank"), F.min(order).alias("rule"))
    best = best.select("host", "top", "fetch_date", "matches", F.col("rank.block").alias("blocked"), F.col("rule.list").alias("rule_list"), F.col("rule.pattern").alias("rule_pattern"))
    out = c.join(best, ["host", "top", "fetch_date"], "left")
    return out.select(key, "host", "fetch_date", F.coalesce("matches", F.lit(0)).cast("bigint").alias("matches"), F.coalesce("blocked", F.lit(False)).alias("blocked"), "rule_list", "rule_pattern")


#: The query's captures are fetched in a year from this day on.
FIRST_DAY = "2024-01-01"


#: A second capture of every page, through a mirror whose host and path are deep.
MIRROR_HOST, MIRROR_PATH = "m1.m2.m3.m4.m5.m6.m7.", "/1/2/3/4/5/6/7/8/9/10"


def page_captures(pages: DataFrame) -> DataFrame:
    """``pages`` as captures: page k was fetched on day 37 k mod 366 of the year, since the table has no dates, and on
    the same day from a mirror, in whose URL the host and the path come after MIRROR_HOST and MIRROR_PATH."""
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int"))
    url, host = F.col("url"), host_of(F.col("url"))
    mirror = F.when(host != "", F.concat(F.lit(f"http://{MIRROR_HOST}"), host, F.lit(MIRROR_PATH), path_of(url)))
    fetched = pages.select("page_id", F.inline(F.array(F.struct(F.lit(False).alias("mirror"), url.alias("url")), F.struct(F.lit(True).alias("mirror"), mirror.alias("url")))), day.alias("fetch_date"))
    return fetched.select(F.struct("page_id", "mirror").alias("id"), "url", "fetch_date")


def page_lists(pages: DataFrame) -> DataFrame:
    """Dated lists over the hosts of ``pages``, since the tables hold none: hosts by a number c from their name's MD5.

    ``ads`` adds a host with c mod 3 = 0 on day c mod 200 and removes it 90 days later; ``malware`` adds one with
    c mod 5 = 0 on day c mod 300, for good; ``trusted`` allows the folder ``en`` of every host from day 100 to 250.
    ``mirrors`` blocks the last 6 labels of the mirror before a host on day c mod 150, allows the mirror's first 5
    folders from day 183 on, and blocks its 10 folders and ``en`` and ``fr`` below them from day 200 to 300.
    """
    hosts = pages.select(host_of(F.col("url")).alias("host")).filter("host <> ''").distinct()
    hosts = hosts.withColumn("c", F.conv(F.substring(F.md5("host"), 1, 6), 16, 10).cast("bigint"))
    day = lambda n: F.date_add(F.lit(FIRST_DAY).cast("date"), n.cast("int"))

    def entry(name, verdict, pattern, action, when):
        return F.struct(F.lit(name).alias("list"), F.lit(verdict).alias("verdict"), pattern.alias("pattern"), F.lit(action).alias("action"), day(when).alias("entry_date"))

    host, c, en = F.col("host"), F.col("c"), F.concat("host", F.lit("/en"))
    mirror = F.concat(F.lit(MIRROR_HOST), host)
    below = [F.concat(mirror, F.lit(f"{MIRROR_PATH}/{x}")) for x in ("en", "fr")]
    rows = F.array(
        F.when(c % 3 == 0, entry("ads", "block", host, "add", c % 200)),
        F.when(c % 3 == 0, entry("ads", "block", host, "remove", c % 200 + 90)),
        F.when(c % 5 == 0, entry("malware", "block", host, "add", c % 300)),
        entry("trusted", "allow", en, "add", F.lit(100)),
        entry("trusted", "allow", en, "remove", F.lit(250)),
        entry("mirrors", "block", F.concat(F.lit(MIRROR_HOST[3:]), host), "add", c % 150),
        entry("mirrors", "allow", F.concat(mirror, F.lit("/1/2/3/4/5")), "add", F.lit(183)),
        *[entry("mirrors", "block", x, "add", F.lit(200)) for x in below],
        *[entry("mirrors", "block", x, "remove", F.lit(300)) for x in below],
    )
    return hosts.select(F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("e")).select("e.*")


def digest(pages: DataFrame) -> DataFrame:
    """The judgements of both captures of every page (see ``page_captures``) against the lists of ``page_lists``.

    Pages without an absolute URL match nothing, nor do mirrors of them, whose host is empty; repeated rows stay; an
    empty table gives no rows; columns other than page_id and url are ignored.
    """
    got = judge(page_captures(pages), page_lists(pages), "id")
    return got.select("id.*", *[c for c in got.columns if c != "id"]).withColumn("fetch_date", F.col("fetch_date").cast("string"))


#: DuckDB for ``digest``: every capture against every entry, without the operator's unfolded patterns.
ORACLE_SQL = r"""
with urls as (select page_id, url, coalesce(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*[^/?#:@.])', 1), '') as host,
  coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '') as path from pages),
fetched as (select page_id, false as mirror, host, path from urls
  union all select page_id, true, case when host <> '' then 'm1.m2.m3.m4.m5.m6.m7.' || host else '' end, '/1/2/3/4/5/6/7/8/9/10' || path from urls),
cap as (select page_id, mirror, date '2024-01-01' + cast(((page_id * 37) % 366 + 366) % 366 as integer) as fetch_date, host,
  array_to_string(list_filter(string_split(path, '/'), lambda x: x <> ''), '/') as folders from fetched),
hosts as (select host, cast('0x' || substr(md5(host), 1, 6) as bigint) as c from (select distinct host from urls where host <> '') z),
entries as (
  select 'ads' as list, 'block' as verdict, host as pattern, 1 as on_, c % 200 as d from hosts where c % 3 = 0
  union all select 'ads', 'block', host, 0, c % 200 + 90 from hosts where c % 3 = 0
  union all select 'malware', 'block', host, 1, c % 300 from hosts where c % 5 = 0
  union all select 'trusted', 'allow', host || '/en', 1, 100 from hosts
  union all select 'trusted', 'allow', host || '/en', 0, 250 from hosts
  union all select 'mirrors', 'block', 'm2.m3.m4.m5.m6.m7.' || host, 1, c % 150 from hosts
  union all select 'mirrors', 'allow', 'm1.m2.m3.m4.m5.m6.m7.' || host || '/1/2/3/4/5', 1, 183 from hosts
  union all select 'mirrors', 'block', 'm1.m2.m3.m4.m5.m6.m7.' || host || '/1/2/3/4/5/6/7/8/9/10/' || f, o, case o when 1 then 200 else 300 end
    from hosts cross join (values ('en'), ('fr')) t(f) cross join (values (0), (1)) u(o)),
dated as (select list, verdict, pattern, on_, date '2024-01-01' + cast(d as integer) as valid_from,
  coalesce(lead(date '2024-01-01' + cast(d as integer)) over (partition by list, verdict, pattern order by d), date '9999-12-31') as valid_to from entries),
active as (select c.page_id, c.mirror, e.* from cap c join dated e on e.on_ = 1 and c.fetch_date >= e.valid_from and c.fetch_date < e.valid_to
  and (c.host = e.pattern or (contains(e.pattern, '.') and ends_with(c.host, '.' || e.pattern)) or starts_with(c.host || '/' || c.folders || '/', e.pattern || '/'))
  where c.host <> ''),
ruled as (select page_id, mirror, verdict, list, pattern, count(*) over (partition by page_id, mirror) as matches,
  row_number() over (partition by page_id, mirror order by length(pattern) desc, case when verdict = 'block' then 0 else 1 end, list, pattern) as rn from active)
select c.page_id, c.mirror, c.host, cast(c.fetch_date as varchar) as fetch_date, coalesce(r.matches, 0) as matches,
  coalesce(r.verdict = 'block', false) as blocked, r.list as rule_list, r.pattern as rule_pattern
from cap c left join ruled r on r.page_id = c.page_id and r.mirror = c.mirror and r.rn = 1
"""
