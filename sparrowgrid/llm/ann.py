"""Approximate nearest neighbours by inner product: a robust-pruned directed graph in each shard.

A shard's graph is over its vectors' directions, so that lengths don't distort it. A node's candidates come from greedy
beam searches from the shard's longest vector. Pruning keeps the nearest candidate and drops every other that is nearer
to it, by the factor ``alpha``, than to the node, and so on: a few diverse edges stay. A query's beam search runs over
every shard's graph by the inner product itself, and the shards' best are merged. Vectors whose lengths differ by many
powers of two are in different shards, where each is scaled before anything is rounded to 32 bits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparrowgrid.llm.common import ship, written

#: Distinct vectors of a shard, queries of a block: both bound a task's memory. Every query meets every shard.
SHARD, QUERIES = 5000, 1 << 15
#: Powers of two over which the lengths of a shard's vectors may spread, about.
BAND = 16
#: Groups of ids that are merged at once, when one vector has very many.
MERGED = 256
#: Edges of a node, beam of a build search, beam of a query, relaxation of the two build passes.
DEGREE, BUILD_BEAM, BEAM, ALPHAS = 32, 64, 96, (1.0, 1.2)
#: Nodes searched and pruned at once, and nodes expanded at once of each search.
BATCH, EXPAND = 256, 4


def directions(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; components may have any finite size."""
    x = x / np.abs(x).max(1, keepdims=True)
    return (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32)


def scaled(x: np.ndarray) -> np.ndarray:
    """All components divided by the largest."""
    return (x / np.abs(x).max()).astype(np.float32)


def beam_search(x: np.ndarray, graph: np.ndarray, q: np.ndarray, start: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``width`` nodes found with the largest products, best first, for each query: (ids, products); -1 is none."""
    b, n = len(q), len(x)
    rows = np.arange(b)
    ids = np.full((b, width), -1, np.int64)
    sim = np.full((b, width), -np.inf, np.float32)
    open_ = np.zeros((b, width), bool)
    seen = np.zeros((b, n), bool)
    ids[:, 0], sim[:, 0], open_[:, 0], seen[:, start] = start, q @ x[start], True, True
    while True:
        score = np.where(open_, sim, -np.inf)
        pick = np.argpartition(-score, EXPAND - 1, 1)[:, :EXPAND] if width > EXPAND else np.argsort(-score, 1)[:, :EXPAND]
        live = np.take_along_axis(open_, pick, 1)
        busy = np.flatnonzero(live.any(1))
        if not len(busy):
            break
        np.put_along_axis(open_, pick, False, 1)
        from_ = np.where(live[busy], np.take_along_axis(ids[busy], pick[busy], 1), -1)
        near = np.where(from_[:, :, None] >= 0, graph[from_], -1).reshape(len(busy), -1)
        near.sort(1)
        fresh = near >= 0
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        fresh &= ~seen[busy[:, None], near]
        seen[busy[:, None].repeat(near.shape[1], 1)[fresh], near[fresh]] = True
        s = np.einsum("bd,bkd->bk", q[busy], x[near], optimize=False)
        s[~fresh] = -np.inf
        all_ids, all_sim = np.hstack([ids[busy], near]), np.hstack([sim[busy], s])
        all_open = np.hstack([open_[busy], fresh])
        best = np.argpartition(-all_sim, width - 1, 1)[:, :width]
        ids[busy], sim[busy], open_[busy] = (np.take_along_axis(a, best, 1) for a in (all_ids, all_sim, all_open))
    order = np.argsort(-sim, 1, kind="stable")
    ids, sim = np.take_along_axis(ids, order, 1), np.take_along_axis(sim, order, 1)
    ids[~np.isfinite(sim)] = -1
    return ids[rows], sim[rows]


def robust_prune(x: np.ndarray, nodes: np.ndarray, cand: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """Up to ``degree`` diverse edges of each node among its candidates; -1 and the node itself are none. All rows of
    ``x`` have length 1."""
    cand = np.sort(cand, 1)
    ok = (cand >= 0) & (cand != nodes[:, None])
    ok[:, 1:] &= cand[:, 1:] != cand[:, :-1]
    top = 1.0
    v = x[cand]
    far = np.maximum(2 * top - 2 * np.einsum("bd,bcd->bc", x[nodes], v), 0)
    far[~ok] = np.inf
    order = np.argsort(far, 1, kind="stable")
    cand, far, v = np.take_along_axis(cand, order, 1), np.take_along_axis(far, order, 1), np.take_along_axis(v, order[:, :, None], 1)
    alive, out, rows = np.isfinite(far), np.full((len(nodes), degree), -1, np.int64), np.arange(len(nodes))
    for k in range(degree):
        has = alive.any(1)
        if not has.any():
            break
        first = alive.argmax(1)
        out[has, k] = cand[rows, first][has]
        between = np.maximum(2 * top - 2 * np.einsum("bd,bcd->bc", v[rows, first], v), 0)
        alive &= alpha * alpha * between > far
        alive[rows, first] = False
    return out


def build(vectors: np.ndarray, degree: int = DEGREE, width: int = BUILD_BEAM, seed: int = 1) -> tuple[np.ndarray, int]:
    """(graph of neighbour numbers, start) of distinct vectors."""
    x, rng = directions(vectors), np.random.default_rng(seed)
    n = len(x)
    start = int((scaled(vectors).astype(np.float64) ** 2).sum(1).argmax())
    graph = np.full((n, degree), -1, np.int64)
    if n <= degree + 1:
        for k in range(n):
            graph[k, : n - 1] = [j for j in range(n) if j != k]
        return graph, start
    graph[:, : degree // 2] = rng.integers(0, n, (n, degree // 2))
    for alpha in ALPHAS:
        order = rng.permutation(n)
        for k in range(0, n, BATCH):
            nodes = order[k : k + BATCH]
            found, _ = beam_search(x, graph, x[nodes], start, min(width, n))
            graph[nodes] = robust_prune(x, nodes, np.hstack([found, graph[nodes]]), alpha, degree)
            _add_back(x, graph, nodes, alpha, degree)
    return graph, start


def _add_back(x: np.ndarray, graph: np.ndarray, nodes: np.ndarray, alpha: float, degree: int) -> None:
    """The reverse of the nodes' edges; a node whose edges no longer fit is pruned again."""
    to, from_ = graph[nodes].ravel(), np.repeat(nodes, degree)
    to, from_ = to[to >= 0], from_[to >= 0]
    if not len(to):
        return
    by = np.argsort(to, kind="stable")
    to, from_ = to[by], from_[by]
    targets, first, count = np.unique(to, return_index=True, return_counts=True)
    place = np.arange(len(to)) - np.repeat(first, count)
    for width in (32, 128, int(count.max())):  # targets with few new edges first, so that matrices stay narrow
        part = np.flatnonzero((count <= width) & (count > (0 if width == 32 else 32 if width == 128 else 128)))
        for k in range(0, len(part), BATCH):
            p = part[k : k + BATCH]
            new = np.full((len(p), width), -1, np.int64)
            row = np.full(len(targets), -1)
            row[p] = np.arange(len(p))
            of = np.repeat(row, count)
            mine = of >= 0
            new[of[mine], place[mine]] = from_[mine]
            graph[targets[p]] = robust_prune(x, targets[p], np.hstack([graph[targets[p]], new]), alpha, degree)


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(id, v)`` of the rows that take part: an id, and finite components that aren't all zero."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col(key).cast("bigint").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull()).filter(fine)


def distinct_vectors(rows: DataFrame, n: int, k: int) -> DataFrame:
    """``(v, ids)``: each vector once, with its k + 1 least ids, all that a query's k nearest can need of it.

    Ids are gathered in salted groups, and MERGED groups at once, so a vector that most rows share is never one group.
    """
    salts = max(1, n // 4096)
    least = lambda c: F.slice(F.array_sort(c), 1, k + 1)
    some = rows.groupBy("v", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt")).agg(least(F.collect_set("id")).alias("ids"))
    while salts > 1:
        salts = -(-salts // MERGED)
        some = some.groupBy("v", F.pmod("salt", F.lit(salts)).alias("salt")).agg(least(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))
    return some.select("v", "ids")


GRAPH = "d int, band int, shard int, x binary, graph binary, start long, ids binary, sizes binary"


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, shard: int = SHARD, beam: int = BEAM, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's k nearest found among all vectors but its own id.

    Both frames have the id and vector columns; others are ignored. Rows that are null, zero, or hold a null or
    non-finite component take no part; nor does a vector of another length than the query's. Ties go to the smaller id.
    Rows that repeat an id with one vector count once. An empty table of either gives no rows.

    Queries times shards searches are made: with a share of the rows as queries that grows with the square of the rows
    over ``shard``, which is the method's price. A shard's graph is sent once for QUERIES queries.
    """
    spark = vectors.sparkSession
    ship(spark)
    base = usable(vectors, key, vector)
    n = base.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], schema)
    band = F.floor(F.log2(F.array_max(F.transform("v", F.abs))) / BAND).cast("int")
    nodes = written(distinct_vectors(base, n, k).select(F.size("v").alias("d"), band.alias("band"), "v", "ids"), "nodes")
    counts = nodes.groupBy("d", "band").agg(F.ceil(F.count("*") / shard).alias("shards"))
    shards = int(counts.agg(F.sum("shards")).first()[0])
    sharded = nodes.join(counts, ["d", "band"]).withColumn("shard", F.pmod(F.xxhash64("v"), F.col("shards")).cast("int"))

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ids", key=lambda c: c.map(lambda x: x[0]))
        x = np.array(pdf["v"].tolist(), np.float64)
        graph, start = build(x)
        ids = np.concatenate([np.asarray(i, np.int64) for i in pdf["ids"]])
        sizes = np.array([len(i) for i in pdf["ids"]], np.int64)
        key = {c: [pdf[c].iloc[0]] for c in ("d", "band", "shard")}
        return pd.DataFrame(key | {"x": [x.tobytes()], "graph": [graph.astype(np.int32).tobytes()], "start": [start], "ids": [ids.tobytes()], "sizes": [sizes.tobytes()]})

    # a shard a task: ranges of one shard, which adaptive execution leaves as they are
    group = ["d", "band", "shard"]
    graphs = sharded.select(*group, "v", "ids").repartitionByRange(shards, *group).groupBy(*group).applyInPandas(make, GRAPH)
    graphs = written(graphs, "graphs")
    asked = usable(queries, key, vector).select(F.col("id").alias("query_id"), F.col("v").alias("q")).distinct()
    m = asked.count()
    blocks = max(1, -(-m // QUERIES))
    ask = asked.withColumn("d", F.size("q")).withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    ask = ask.join(graphs.select("d", *[(F.col(c) + 0).alias(c) for c in group[1:]]), "d").select("query_id", "q", *group, "block")
    look = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def find(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        g = left.iloc[0]
        x = np.frombuffer(g["x"], np.float64).reshape(-1, g["d"])
        near = scaled(x)
        graph = np.frombuffer(g["graph"], np.int32).reshape(len(x), -1).astype(np.int64)
        ids, sizes = np.frombuffer(g["ids"], np.int64), np.frombuffer(g["sizes"], np.int64)
        first = np.concatenate([[0], sizes.cumsum()])
        q, asks = np.array(right["q"].tolist(), np.float64), right["query_id"].to_numpy()
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for at in range(0, len(q), BATCH):
            part = q[at : at + BATCH]
            found, _ = beam_search(near, graph, directions(part), int(g["start"]), min(max(beam, k + 1), len(x)))
            exact = np.einsum("bd,bkd->bk", part, x[found])
            exact[found < 0] = -np.inf
            for r in range(len(part)):
                mine = found[r][found[r] >= 0]
                rep = np.repeat(exact[r][found[r] >= 0], sizes[mine])
                who = np.concatenate([ids[first[f] : first[f + 1]] for f in mine])
                keep = who != asks[at + r]
                who, rep = who[keep], rep[keep]
                best = np.lexsort((who, -rep))[:k]
                out.append((np.full(len(best), asks[at + r]), who[best], rep[best]))
        a, b, c = (np.concatenate(z) for z in zip(*out, strict=True))
        return pd.DataFrame({"query_id": a, "vec_id": b, "score": c})

    key_ = [*group, "block"]
    hits = look.groupBy(*key_).cogroup(ask.groupBy(*key_)).applyInPandas(find, "query_id long, vec_id long, score double")
    hits = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))  # an id with several vectors counts by its best
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
