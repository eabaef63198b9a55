"""Mixing sources to target weights with a low-discrepancy schedule of equal-token blocks.

Each source's documents, in a hashed order, are a cyclic stream of words that is cut into blocks. Slot j of the mix
belongs to the source in whose part of the cumulated target shares the golden-ratio point frac(j * phi) falls; the
slot's rank among its source's slots is the block it takes. A source has just the slots that its target needs; the
last is cut, so the words taken are the target rounded down to whole words.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparrowgrid.llm.common import bucket_of, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE, STOP = 1.5, 2
#: Documents of a chunk of a source's order, were all in one source: a chunk is summed in one task.
CHUNK_ROWS = 1024
#: Words of a block.
BLOCK = 4096
#: frac(j * phi) * 2^32 is j times this, modulo 2^32 (fixed value).
GOLDEN = 2654435769
#: Slots of a chunk in which ranks are counted.
SLOT_CHUNK = 1 << 16


class Source(NamedTuple):
    sid: int
    source: str | None
    size: int
    target: float

    @property
    def words(self) -> int:
        return min(int(self.target + 1e-6), STOP * self.size)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, stop: float = STOP) -> list[Source]:
    """Sources in code point order, null last, with the weights in turn: water is poured by weight until every
    source is at its target or at ``stop`` times its size."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), list(names), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        above = [s for s in open_ if unit * weight[s] > stop * sizes[s]]
        if not above:
            target |= {s: unit * weight[s] for s in open_}
            break
        for s in above:
            target[s] = float(stop * sizes[s])
            left -= target[s]
        open_ = [s for s in open_ if s not in target]
    return [Source(k, s, sizes[s], target[s]) for k, s in enumerate(names)]


def golden_point(j: Column) -> Column:
    """``j * GOLDEN`` modulo 2^32, in two halves so that no product leaves 64 bits."""
    low, high = j.bitwiseAND(F.lit(0xFFFF)), F.shiftright(j, 16).bitwiseAND(F.lit(0xFFFF))
    return F.pmod(low * F.lit(GOLDEN) + F.shiftleft(F.pmod(high * F.lit(GOLDEN), F.lit(1 << 16)), 16), F.lit(1 << 32))


def schedule(spark: SparkSession, sources: list[Source], block: int = BLOCK) -> DataFrame:
    """``(position, sid, rank)``: the slots in order. Ranks come from counts of chunks of slots, so that no window
    holds all slots of a source; slots that discrepancy leaves out are appended."""
    need = [s for s in sources if s.words > 0]
    if not need:
        return spark.createDataFrame([], "position long, sid int, rank long")
    slots = {s.sid: -(-s.words // block) for s in need}
    total, points = sum(s.words for s in need), sum(slots.values())
    starts, at = [], 0
    for s in need[:-1]:
        at += s.words
        starts.append((at << 32) // total)
    which = bucket_of(golden_point(F.col("id")), starts)
    j = spark.range(points).select(F.col("id"), which.cast("int").alias("w"), F.floor(F.col("id") / SLOT_CHUNK).alias("c"))
    table = spark.createDataFrame([(k, s.sid, slots[s.sid]) for k, s in enumerate(need)], "w int, sid int, slots long")
    counts = j.groupBy("w", "c").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("w").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = j.join(counts.select("w", "c", before.alias("before")), ["w", "c"])
    ranked = ranked.withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("w", "c").orderBy("id")) - 1)
    inside = ranked.join(table, "w").filter("rank < slots").select(F.col("id").alias("position"), "sid", F.col("rank").cast("bigint").alias("rank"))
    have = table.join(counts.groupBy("w").agg(F.sum("n").alias("have")), "w", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    rest = have.filter("have < slots").select("sid", F.explode(F.sequence(F.col("have").cast("bigint"), F.col("slots") - 1)).alias("rank"))
    tail = rest.select((F.lit(points) + F.col("rank") * len(need) + F.col("sid")).cast("bigint").alias("position"), "sid", "rank")
    return inside.unionByName(tail)


class Mix(NamedTuple):
    """``sources``; ``docs`` (doc_id, size, sid, chunk, row, first: place in the source's stream);
    ``pieces`` (position, sid, rank, chunk, row, doc_id, turn, from_word, to_word)."""

    sources: list[Source]
    docs: DataFrame
    pieces: DataFrame


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, stop: int = STOP, block: int = BLOCK) -> Mix:
    """The mix of a documents table; one row of ``docs`` for every input row.

    Null texts have size 0, null sources are one source, repeated rows count each; rows of size 0 are in no piece.
    The driver gets one row a source. Results depend on doc_id, source and size only, so reruns agree.
    """
    spark = docs.sparkSession
    sized = written(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", word_count(F.col("text")).alias("size")), "sizes")
    got = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    sources, rows = targets({r.source: r["size"] for r in got}, weights, share, stop), sum(r.n for r in got)
    bits = max(0, (rows // CHUNK_ROWS)).bit_length()
    table = spark.createDataFrame([(s.sid, s.source, s.size, s.words) for s in sources], "sid int, _source string, source_words long, take long")
    h = F.xxhash64("doc_id", F.lit(6))
    dealt = sized.join(table, F.col("source").eqNullSafe(F.col("_source"))).select("doc_id", "size", "sid", "source_words", "take", h.alias("h"))
    dealt = dealt.withColumn("chunk", F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("bigint"))
    sums = dealt.groupBy("sid", "chunk").agg(F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = Window.partitionBy("sid", "chunk").orderBy("h", "doc_id", "size")
    inside = F.coalesce(F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = dealt.withColumn("inside", inside).withColumn("row", F.row_number().over(own))
    placed = placed.join(sums.select("sid", "chunk", before.alias("before")), ["sid", "chunk"])
    placed = placed.select("doc_id", "size", "sid", "chunk", "row", (F.col("before") + F.col("inside")).cast("bigint").alias("first"), "source_words", "take")
    turns = placed.filter("size > 0").withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(stop - 1))))
    turns = turns.withColumn("a", F.col("first") + F.col("turn") * F.col("source_words")).withColumn("b", F.least(F.col("a") + F.col("size"), F.col("take"))).filter("a < b")
    cut = turns.withColumn("rank", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor((F.col("b") - 1) / block))))
    start, end = F.greatest(F.col("a"), F.col("rank") * block), F.least(F.col("b"), (F.col("rank") + 1) * block)
    cut = cut.withColumn("from_word", start - F.col("a")).withColumn("to_word", end - F.col("a"))
    pieces = cut.join(schedule(spark, sources, block), ["sid", "rank"])
    pieces = pieces.select("position", "sid", "rank", "chunk", "row", "doc_id", "turn", "from_word", "to_word")
    return Mix(sources, placed.select("doc_id", "size", "sid", "chunk", "row", "first"), pieces)


def digest(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, block: int = BLOCK) -> DataFrame:
    """Words the mix takes of each document, and its source's size and target."""
    spark = docs.sparkSession
    m = mix(docs, weights, block=block)
    taken = m.pieces.groupBy("sid", "chunk", "row").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    table = spark.createDataFrame([(s.sid, s.size, s.target) for s in m.sources], "sid int, source_size long, target double")
    out = m.docs.join(taken, ["sid", "chunk", "row"], "left").join(table, "sid")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))


def apply(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, block: int = BLOCK) -> DataFrame:
    """``docs`` as mixed: a row for each turn in which at least half of a document's words are taken, whole.

    Documents that the mix doesn't reach, and those without a word, are left out; repeated ones stand twice.
    """
    m = mix(docs, weights, block=block)
    got = m.pieces.groupBy("sid", "chunk", "row", "turn").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"), F.first("doc_id").alias("doc_id"))
    copies = got.join(m.docs.select("sid", "chunk", "row", "size"), ["sid", "chunk", "row"]).filter("2 * taken >= size")
    table = docs.sparkSession.createDataFrame([(s.sid, s.source) for s in m.sources], "sid int, source string")
    # keys without nulls, so that the join and the numbering below share one deal of the texts; rows that agree in
    # doc_id, source and size are told apart by number
    keyed = copies.join(table, "sid").select(*_keys(F.col("size")), "chunk", "row").groupBy(*KEYS, "chunk", "row").agg(F.count("*").alias("copies"))
    keyed = keyed.groupBy(*KEYS).agg(F.array_sort(F.collect_list("copies")).alias("copies"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"), "text", *_keys(word_count(F.col("text"))))
    number = F.row_number().over(Window.partitionBy(*KEYS).orderBy("text"))
    taken = rows.join(keyed, KEYS).withColumn("k", F.get("copies", number - 1)).filter("k is not null")
    return taken.select("r", F.explode(F.sequence(F.lit(1), F.col("k").cast("int"))).alias("turn")).select("r.*")


KEYS = ["dk", "sk", "nulls", "size"]


def _keys(size: Column) -> list[Column]:
    doc, source = F.col("doc_id").cast("bigint"), F.col("source")
    nulls = doc.isNull().cast("int") * 2 + source.isNull().cast("int")
    return [F.coalesce(doc, F.lit(0).cast("bigint")).alias("dk"), F.coalesce(source, F.lit("")).alias("sk"), nulls.alias("nulls"), size.alias("size")]
