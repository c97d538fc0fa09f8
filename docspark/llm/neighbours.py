"""Nearest neighbours by a forest of hash prefixes, in shards that Spark deals out."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from docspark.plans.storage import written

#: Vectors of a shard, and queries of a block; each pair of them is one task's work. Queries descend STEP at a time.
SHARD, BLOCK, STEP = 8192, 4096, 512
BITS = 64
#: Parts of a shard that are tried, in this order, until the probes' recall is reached.
SHARES = [2.0**-i for i in range(7, 0, -1)] + [0.625, 0.75, 0.875]


def _usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


class Forest:
    """Trees of sorted hash strings over some vectors. A tree's hash is BITS signs of random directions."""

    def __init__(self, vectors: np.ndarray, trees: int, seed: int):
        self.vectors, self.middle = vectors, vectors.mean(0)
        random = np.random.default_rng([seed, vectors.shape[1]])
        self.directions = random.normal(size=(trees, vectors.shape[1], BITS))
        self.order, self.sorted = [], []
        for keys in self._keys(vectors):
            order = np.argsort(keys, kind="stable")
            self.order.append(order)
            self.sorted.append(keys[order])

    def _keys(self, vectors: np.ndarray) -> list[np.ndarray]:
        weight = np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64)
        return [(((vectors - self.middle) @ d > 0) * weight).sum(1, dtype=np.uint64) for d in self.directions]

    def candidates(self, queries: np.ndarray, least: int):
        """For each query, the vectors that share the longest prefixes with it: descend every tree to the longest
        match, then ascend all trees together, one bit at a time, until at least ``least`` vectors are found."""
        n = len(self.vectors)
        low = np.empty((BITS + 1, len(self.order), len(queries)), np.int64)
        high = np.empty_like(low)
        for t, keys in enumerate(self._keys(queries)):
            for bits in range(BITS + 1):
                rest = np.uint64((1 << (BITS - bits)) - 1)
                low[bits, t] = np.searchsorted(self.sorted[t], keys & ~rest, "left")
                high[bits, t] = np.searchsorted(self.sorted[t], keys | rest, "right")
        reach = (high - low).sum(1)  # of all trees, with repeats
        for q in range(len(queries)):
            bits = BITS
            while bits and reach[bits, q] < least:
                bits -= 1
            while True:
                found = np.zeros(n, bool)
                for t, order in enumerate(self.order):
                    found[order[low[bits, t, q] : high[bits, t, q]]] = True
                if bits == 0 or found.sum() >= least:
                    break
                bits -= 1
            yield q, np.flatnonzero(found)

    def least(self, k: int, recall: float, probes: int) -> int:
        """How many candidates a query needs, so that ``probes`` of the vectors find ``recall`` of their k exact nearest."""
        n = len(self.vectors)
        asked = self.vectors[:: max(1, n // probes)][:probes]
        squares = (self.vectors**2).sum(1)
        exact = [set(np.argsort(squares - 2 * (self.vectors @ x), kind="stable")[: k + 1]) for x in asked]
        for share in SHARES:
            low = max(k + 1, math.ceil(share * n))
            hits = [len(exact[q].intersection(found)) - 1 for q, found in self.candidates(asked, low)]
            if low >= n or sum(hits) >= recall * sum(len(x) - 1 for x in exact):
                return low
        return n


def _searched(k: int, trees: int, recall: float, probes: int, seed: int):
    def run(data: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(data) and len(asked):
            data, asked = data.sort_values("node"), asked.sort_values("node")
            node, asked_node = data["node"].to_numpy(), asked["node"].to_numpy()
            vectors, queries = (np.stack(list(x["embedding"])).astype(np.float64) for x in (data, asked))
            forest = Forest(vectors, trees, seed)
            least = min(len(node), forest.least(k - 1, recall, probes))
            for start in range(0, len(queries), STEP):
                block, ids = queries[start : start + STEP], asked_node[start : start + STEP]
                for q, found in forest.candidates(block, least):
                    score = np.sqrt(((vectors[found] - block[q]) ** 2).sum(1))
                    best = np.lexsort((node[found], score))[:k]
                    out.append(pd.DataFrame({"asked": ids[q], "node": node[found][best], "score": score[best]}))
        return pd.concat(out) if out else pd.DataFrame({"asked": [], "node": [], "score": []})

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, trees: int = 32, recall: float = 0.97, probes: int = 64, seed: int = 7) -> DataFrame:
    """The ``k`` nearest rows of each query row by Euclidean distance, in double precision.

    ``vectors`` has vec_id (long) and embedding (array of numbers); ``is_query`` tells its query rows. Every row is
    indexed. Returns query_id, rank (from 1), vec_id, score: nearest first, ties to the smaller vec_id; fewer rows if
    there are fewer candidates. Null vec_ids, and null, zero or non-finite vectors and vectors with null
    components take no part; vectors of another length than the query's aren't its candidates. Repeated equal rows
    count once. A query's own vec_id is never its candidate. Equal vectors are one point of the index, so a large
    group of copies costs k + 1 rows.

    Each shard of equal vectors' representatives has a forest of its own; every block of queries visits every shard
    and brings back its k + 1 nearest candidates there. How many candidates a query ascends to is measured in each shard:
    as many as ``probes`` of its vectors need to find ``recall`` of their exact k nearest. Clustered vectors need few,
    vectors without any structure most of the shard (figures in the README); small tables go the same way.
    An empty table, and one without queries, gives no rows.
    """
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), is_query.alias("asks")).where(F.col("vec_id").isNotNull() & _usable(F.col("embedding"))).distinct()
    first = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    kept = usable.withColumn("nth", first).where(F.col("nth") <= k + 1)
    points = written(kept.groupBy("embedding").agg(F.min("vec_id").alias("node"), F.collect_list("vec_id").alias("ids")), "neighbour-points")
    queries = written(usable.where("asks").select("vec_id", "embedding").join(points.select("embedding", "node"), "embedding").select(F.col("vec_id").alias("query_id"), "node"), "neighbour-queries")
    asked = written(points.join(queries.select("node").distinct(), "node", "left_semi").select("node", "embedding"), "neighbour-asked")

    size, n_asked = points.count(), max(1, asked.count())
    shards, blocks = max(1, -(-size // SHARD)), -(-n_asked // BLOCK)
    deal = lambda n, name: F.pmod(F.xxhash64("node", F.lit(name)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dim = F.size("embedding").alias("dim")
    left = points.select("node", "embedding", dim, deal(shards, "shard").alias("shard"), every(blocks).alias("block"))
    right = asked.select("node", "embedding", dim, every(shards).alias("shard"), deal(blocks, "block").alias("block"))
    met = left.groupBy("dim", "shard", "block").cogroup(right.groupBy("dim", "shard", "block")).applyInPandas(_searched(k + 1, trees, recall, probes, seed), "asked long, node long, score double")

    best = F.row_number().over(Window.partitionBy("asked").orderBy("score", "node"))
    met = met.withColumn("nth", best).where(F.col("nth") <= k + 1).select("asked", F.col("node").alias("near"), "score")
    rows = queries.join(met, queries.node == met.asked).join(points.select(F.col("node").alias("near"), "ids"), "near")
    rows = rows.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    # a query given with several vectors: each row counts once, at its smallest distance
    rows = rows.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", rank)
    return rows.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
