"""Document fingerprints by invertible Bloom lookup sketches, in DataFrame operations only.

A text is cut into paragraphs: lines, and runs of RUN words of longer lines. Each paragraph's digest goes to one cell
in each of three tables; a cell holds how many digests it has, their sum and the sum of their check values. Sketches
subtract cell by cell. A cell of the difference is pure if its sums are its count times one digest and that digest's
check value; taking a pure cell's digest out of its other cells makes more of them pure (peeling). If cells remain, the
difference was too large for the sketch, and the pair is tried again with one that has room for all its digests; should
that fail, with ones GROWTH times larger.

Sketches are kept as arrays of their nonzero cells in a document's own row, so nothing but texts and their keys is
shuffled. Documents meet the next one by equality of keys, whose order is found without the texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrowgrid.llm.common import text_keys, written

#: Words of a paragraph at most; cells of the published sketch; growth of a retry after the
#: first; tries; waves of peeling of a try.
RUN, CELLS, GROWTH, TRIES, WAVES = 20, 24, 8, 3, 24
#: Digests have 40 bits, so that sums of millions of equal ones fit 63.
BITS = 40
DIGEST, CHECK = (1 << BITS) - 1, (1 << 20) - 1
#: Keys that are put in order in one task, and bytes of texts that a task fingerprints, about.
ROWS, BYTES = 1 << 16, 8 << 20
#: Characters of a text that order rows of one doc_id.
PREFIX = 32


def paragraphs(text: Column, run: int) -> Column:
    """The paragraphs of a text with their trailing space, which together are the text; none of an empty one."""
    return F.regexp_extract_all(text, F.lit(rf"(?:[^ \n]+ *){{1,{run}}}\n*|[ \n]+"), F.lit(0))


def digests(text: Column, run: int) -> Column:
    return F.transform(paragraphs(text, run), lambda p: F.xxhash64(p).bitwiseAND(F.lit(DIGEST)))


#: What tells texts apart, in order; rows that agree in them are copies.
KEY = ["has", "dk", "ta", "tb"]


def next_keys(keyed: DataFrame, rows: int) -> DataFrame:
    """``(KEY, copies, next)`` of each distinct key of ``keyed``: the KEY of the document after its last copy, of the
    last one the first. Ranges of keys are put in order on their own; a range's last key is followed by the next range's
    first, which are one row a range."""
    order = [*KEY[:2], "pre", *KEY[2:]]
    keys = keyed.groupBy(*order).agg(F.count("*").alias("copies"))
    ranges = written(keys.repartitionByRange(max(1, -(-rows // ROWS)), *order).withColumn("p", F.spark_partition_id()), "order")
    whole = F.struct(*order)
    firsts = ranges.groupBy("p").agg(F.min(whole).alias("first"))
    along = Window.orderBy("p")
    after = firsts.select("p", F.coalesce(F.lead("first").over(along), F.first("first").over(along)).alias("after"))
    followed = ranges.withColumn("next", F.lead(whole).over(Window.partitionBy("p").orderBy(*order))).join(after, "p")
    return followed.select(*KEY, "copies", F.coalesce("next", "after").alias("next"))


def edited_with_next(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, edited, next)`` where the last quarter of the code points of each text is replaced by as many
    first ones of the next document's, or all it has; after the last document comes the first.

    Null texts are empty. Documents are in the order of doc_id, nulls first; those of one doc_id in that of their first
    PREFIX characters, then of their digests. Only keys are put in order; texts meet by equality of keys, in tasks of
    about BYTES bytes of them, so neither a bucket of the order nor a doc_id with very many rows is bound to one task.
    """
    ta, tb = text_keys(F.col("text"))
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows, size = docs.agg(F.count("*"), F.sum(F.octet_length("text").cast("bigint"))).first()
    has = F.col("doc_id").isNotNull().cast("int").alias("has")
    keyed = docs.select("doc_id", "text", has, F.coalesce("doc_id", F.lit(0).cast("bigint")).alias("dk"), ta.alias("ta"), tb.alias("tb"))
    order = written(next_keys(keyed.withColumn("pre", F.substring("text", 1, PREFIX)), rows), "next")
    parts = max(1, -(-(size or 0) // BYTES))
    # both sides number the copies of a key in one deal of the texts by key
    dealt = keyed.repartition(parts, *KEY).withColumn("copy", F.row_number().over(Window.partitionBy(*KEY).orderBy("doc_id")))
    left = dealt.join(order, KEY)
    # a copy is followed by the next copy, which is the same text
    to = {c: F.when(F.col("copy") < F.col("copies"), F.col(c)).otherwise(F.col("next")[c]).alias(f"_{c}") for c in KEY}
    left = left.select("doc_id", "text", *to.values()).repartition(parts, *[f"_{c}" for c in KEY])
    right = dealt.filter("copy = 1").select(*KEY, F.col("text").alias("next"), F.col("doc_id").alias("_id"))
    on = [F.col(f"_{c}") == F.col(c) for c in KEY]
    seen = left.join(right, on)
    n = F.length("text")
    q = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - q), F.substring("next", F.lit(1), q))
    return seen.select("doc_id", "text", edited.alias("edited"), "next")


def check_of(x: Column) -> Column:
    return F.xxhash64(x, F.lit(7)).bitwiseAND(F.lit(CHECK))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _cell(i: Column, n: Column, s: Column, c: Column) -> Column:
    return F.struct(i.cast("bigint").alias("i"), n.cast("bigint").alias("n"), s.cast("bigint").alias("s"), c.cast("bigint").alias("c"))


def _merged(cells: Column) -> Column:
    """Cells in order, those of one place summed, without zero cells, in time linear in their number."""

    def groups(x: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(x))
        starts = F.filter(at, lambda k: F.when(k == 1, True).otherwise(F.get(x, k - 1)["i"] != F.get(x, k - 2)["i"]))

        def summed(s: Column) -> Column:
            total = lambda g, name: F.aggregate(g, F.lit(0).cast("bigint"), lambda a, y: a + y[name])

            def one(k: Column, order: Column) -> Column:
                size = F.coalesce(F.get(s, order + 1), F.size(x) + 1) - k
                several = _let(F.slice(x, k, size), lambda g: _cell(F.get(g, F.lit(0))["i"], total(g, "n"), total(g, "s"), total(g, "c")))
                return F.when(size == 1, F.get(x, k - 1)).otherwise(several)

            return F.transform(s, one)

        return F.filter(_let(starts, summed), lambda y: (y["n"] != 0) | (y["s"] != 0) | (y["c"] != 0))

    none = F.array().cast("array<struct<i:bigint,n:bigint,s:bigint,c:bigint>>")
    return _let(cells, lambda x: F.when(F.size(x) == 0, none).otherwise(groups(x)))


def place(x: Column, table: Column | int, cells: Column | int) -> Column:
    """The cell of a digest in one of three tables of a third of ``cells`` each."""
    c, t = (F.lit(v).cast("int") if isinstance(v, int) else v.cast("int") for v in (cells, table))
    width = F.lit(cells // 3) if isinstance(cells, int) else F.floor(c / 3).cast("int")
    return F.pmod(F.xxhash64(x, t, c), width) + t * width


def sketch(digests: Column, cells: Column | int) -> Column:
    """The nonzero cells of an array of digests, in order, as (place i, count n, sum s, check sum c)."""
    put = F.sort_array(F.flatten(F.transform(digests, lambda x: F.array(*[F.shiftleft(place(x, t, cells), BITS) + x for t in range(3)]))))  # place and digest in one number: cheap to sort
    one = F.lit(1)
    return _merged(F.transform(put, lambda y: _cell(F.shiftright(y, BITS), one, y.bitwiseAND(F.lit(DIGEST)), check_of(y.bitwiseAND(F.lit(DIGEST))))))


def subtract(a: Column, b: Column) -> Column:
    """Cell by cell difference of two sketches of one size."""
    return _merged(F.sort_array(F.concat(a, F.transform(b, lambda x: _cell(x["i"], -x["n"], -x["s"], -x["c"])))))


def peel(cells_of: Column, cells: Column | int, waves: int = WAVES) -> Column:
    """How many digests, with multiplicity, a difference holds; null if cells remain that can't be peeled.

    A wave takes the digests of all pure cells out of their three cells.
    """
    width = F.lit(cells // 3) if isinstance(cells, int) else F.floor(cells / 3)

    def pure(x: Column) -> Column:
        k = F.call_function("div", x["s"], x["n"])
        fine = k.between(0, DIGEST) & (F.call_function("mod", x["s"], x["n"]) == 0)
        sums = (x["c"] == x["n"] * check_of(k)) & (place(k, F.floor(x["i"] / width), cells) == x["i"])
        return F.when(x["n"] != 0, F.when(fine, sums).otherwise(False)).otherwise(False)

    def wave(state: Column, _: Column) -> Column:
        def with_found(p: Column) -> Column:
            def without(z: Column) -> Column:
                minus = F.flatten(F.transform(z, lambda q: F.array(*[_cell(place(q["k"], t, cells), -q["n"], -q["n"] * q["k"], -q["n"] * check_of(q["k"])) for t in range(3)])))
                diff = state["diff"] + F.aggregate(z, F.lit(0).cast("bigint"), lambda a, q: a + F.abs(q["n"]))
                return F.struct(_merged(F.sort_array(F.concat(state["cells"], minus))).alias("cells"), diff.alias("diff"), (F.size(z) > 0).alias("go"))

            # a digest that is alone in several cells is taken once
            each = F.sort_array(F.transform(p, lambda x: F.struct(F.call_function("div", x["s"], x["n"]).alias("k"), x["n"].alias("n"))))
            return _let(_let(each, lambda e: F.filter(e, lambda x, k: F.when(k == 0, True).otherwise(x["k"] != F.get(e, k - 1)["k"]))), without)

        return F.when(state["go"] & (F.size(state["cells"]) > 0), _let(F.filter(state["cells"], pure), with_found)).otherwise(state)

    start = F.struct(cells_of.alias("cells"), F.lit(0).cast("bigint").alias("diff"), F.lit(True).alias("go"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(waves)), start, wave, lambda a: F.when(F.size(a["cells"]) == 0, a["diff"]))


def _attempt(cells_of: Column, cells: Column | int) -> Column:
    """The peeled difference; with more than 7/8 of its cells in use it is beyond what peels, so it isn't begun."""
    most = cells - cells // 8 if isinstance(cells, int) else cells - F.floor(cells / 8)
    return _let(cells_of, lambda d: F.when(F.size(d) <= most, peel(d, cells)))


def difference(a: Column, b: Column, first: tuple[Column, Column] | None = None, cells: int = CELLS) -> Column:
    """The number of digests, with multiplicity, in which two arrays differ, found by sketches that grow until one
    peels: a larger one is only made where the last failed. ``first`` are the sketches of ``cells`` if they're there.

    The first retry has at least two cells a digest of both, which peels but for bad luck. After TRIES sizes digests are
    counted one by one instead.
    """
    x, y = first or (sketch(a, cells), sketch(b, cells))
    tries, room = [_attempt(subtract(x, y), cells)], 3 * F.ceil((F.size(a) + F.size(b)) * 2 / 3 + cells)
    for k in range(TRIES - 1):
        tries.append(_let((room * GROWTH**k).cast("int"), lambda c: _attempt(subtract(sketch(a, c), sketch(b, c)), c)))
    signed = lambda x, sign: F.transform(x, lambda y: _cell(y, F.lit(sign), F.lit(0), F.lit(0)))
    counted = F.aggregate(_merged(F.sort_array(F.concat(signed(a, 1), signed(b, -1)))), F.lit(0).cast("bigint"), lambda t, y: t + F.abs(y["n"]))
    return F.coalesce(*tries, counted)


def text_of(cells: Column) -> Column:
    """A sketch as hexadecimal cells; empty for an empty text's."""
    return F.lower(F.array_join(F.transform(cells, lambda x: F.concat_ws("-", F.hex(x["i"]), F.hex(x["n"]), F.hex(x["s"]), F.hex(x["c"]))), "."))


def likeness(diff: Column, one: Column, two: Column) -> Column:
    """1 less the share of differing digests; 1 for two empty texts."""
    total = one + two
    return F.when(total > 0, 1 - diff / total).otherwise(F.lit(1.0))


def digest(docs: DataFrame, run: int = RUN) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and their likenesses (see ``edited_with_next``), by
    paragraphs of ``run`` words at most.

    Null texts are empty, and an empty text has an empty fingerprint. Repeated rows stay, each with the row after it as
    its next document; a single row is its own next. An empty table gives no rows; other columns are ignored.
    """
    texts = edited_with_next(docs)

    def measures(x: Column) -> Column:
        pair = lambda other, cells: F.when(x["own"] == other, F.lit(0).cast("bigint")).otherwise(difference(x["own"], other, (x["own0"], cells)))
        n = {c: F.size(x[c]) for c in ("own", "changed", "following")}
        return F.struct(
            text_of(x["own0"]).alias("fingerprint"), text_of(x["changed0"]).alias("edited_fingerprint"),
            likeness(pair(x["changed"], x["changed0"]), n["own"], n["changed"]).alias("near_edited"),
            likeness(pair(x["following"], x["following0"]), n["own"], n["following"]).alias("near_next"),
        )

    three = F.struct(*[digests(F.col(c), run).alias(name) for c, name in (("text", "own"), ("edited", "changed"), ("next", "following"))])
    arrays = F.transform(F.array(three), lambda d: F.struct(d["own"].alias("own"), d["changed"].alias("changed"), d["following"].alias("following"), *[sketch(d[c], CELLS).alias(f"{c}0") for c in ("own", "changed", "following")]))
    rows = texts.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.explode(F.transform(arrays, measures)).alias("m"))
    return rows.select("doc_id", "n_chars", "edited_sha256", "m.*")
