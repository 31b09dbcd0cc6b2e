"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table hashes a vector to the cell of a grid over Gaussian (2-stable) projections. A query
visits its own cell and then perturbed ones in the order of their estimated success, from the
distances of its projections to the cell walls; the order of perturbation sets over sorted
distances is made once. Candidates of all tables are merged and ranked by exact inner product
in double precision. Largest inner product becomes nearest distance by the usual lift: vectors
are scaled by the largest norm and get one coordinate that makes their norms equal.

All rows are indexed, in blocks of bounded size and of norms within a band, each lifted by
its own largest norm: under one norm for all, smaller vectors would shrink towards the lifted
pole and out of the probes' reach. The stated queries meet every block. No bucket is capped.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdictlake.llm.rows import join_narrow, table
from verdictlake.scale import write_through


#: Lowest values of bucket keys that are told apart before a search.
FILTER = 1 << 18


@dataclass(frozen=True)
class Plan:
    """Hash functions per table, tables, cell width in units of a unit vector's projections, probes per table.

    Norms in a block differ by less than the factor `band`; blocks of up to `whole` rows are compared whole.
    """

    functions: int = 14
    tables: int = 10
    width: float = 2.8
    probes: int = 800
    block: int = 8_000
    queries: int = 5_000
    seed: int = 7
    band: float = 1.2
    whole: int = 500


def perturbations(functions: int, probes: int) -> np.ndarray:
    """0/1 rows over the 2 * functions wall distances in rising order: sets in rising expected squared distance."""
    m, n = functions, 2 * functions
    j = np.arange(1, n + 1, dtype=float)
    low = j * (j + 1) / (4 * (m + 1) * (m + 2))
    k = n + 1 - j
    cost = np.where(j <= m, low, 1 - k / (m + 1) + k * (k + 1) / (4 * (m + 1) * (m + 2)))
    found, heap = [()], [(cost[0], (0,))]
    while heap and len(found) < probes:
        total, chosen = heapq.heappop(heap)
        # One wall of a dimension at most: ranks r and 2m-1-r are its two walls.
        if len({min(r, n - 1 - r) for r in chosen}) == len(chosen):
            found.append(chosen)
        last = chosen[-1]
        if last + 1 < n:
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*chosen, last + 1)))
    out = np.zeros((len(found), n), np.uint64)
    for row, chosen in enumerate(found):
        out[row, list(chosen)] = 1
    return out


class Tables:
    """The projections of all tables, drawn from the seed alone, so every task has the same."""

    def __init__(self, dimension: int, plan: Plan):
        rng = np.random.default_rng(plan.seed)
        self.plan = plan
        self.project = [rng.normal(size=(dimension, plan.functions)) for _ in range(plan.tables)]
        self.shift = [rng.uniform(0, plan.width, plan.functions) for _ in range(plan.tables)]
        self.mix = [rng.integers(1, 1 << 63, plan.functions, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(plan.tables)]
        self.sets = perturbations(plan.functions, plan.probes).T.astype(float)

    def keys(self, t: int, vectors: np.ndarray) -> np.ndarray:
        cells = np.floor((vectors @ self.project[t] + self.shift[t]) / self.plan.width).astype(np.int64)
        return (cells.view(np.uint64) * self.mix[t]).sum(1, dtype=np.uint64)

    def probes(self, t: int, queries: np.ndarray) -> np.ndarray:
        """Keys to visit, one row per query, in order of estimated success."""
        place = (queries @ self.project[t] + self.shift[t]) / self.plan.width
        cells = np.floor(place)
        inside = place - cells
        key = (cells.astype(np.int64).view(np.uint64) * self.mix[t]).sum(1, dtype=np.uint64)
        walls = np.concatenate([inside, 1 - inside], 1)
        steps = np.concatenate([-self.mix[t], self.mix[t]])  # modulo 2**64
        sorted_steps = steps[np.argsort(walls, 1, kind="stable")]
        # Halves of 32 bits add up exactly in doubles, whose product is many times faster than that of whole numbers.
        low, high = (sorted_steps & np.uint64((1 << 32) - 1)).astype(float), (sorted_steps >> np.uint64(32)).astype(float)
        return key[:, None] + (low @ self.sets).astype(np.uint64) + ((high @ self.sets).astype(np.uint64) << np.uint64(32))


def candidates(tables: Tables, data: np.ndarray, queries: np.ndarray, least: int = 0, at_once: int = 200) -> Iterator[tuple[int, np.ndarray]]:
    """(first query, per query whether a row of `data` is in any visited bucket of any table); all rows for a query that meets under `least`."""
    index, lowest = [], np.uint64(FILTER - 1)
    for t in range(tables.plan.tables):
        keys = tables.keys(t, data)
        order = np.argsort(keys, kind="stable")
        distinct, first = np.unique(keys[order], return_index=True)
        held = np.zeros(FILTER, bool)
        held[(distinct & lowest).astype(np.int64)] = True
        index.append((order, distinct, first, np.append(first[1:], len(order)), held))
    for begin in range(0, len(queries), at_once):
        part = queries[begin:begin + at_once]
        met = np.zeros((len(part), len(data)), bool)
        for t, (order, distinct, first, last, held) in enumerate(index):
            keys = tables.probes(t, part)
            # Most probes visit no bucket: their lowest bits tell, and only the others are searched.
            q, p = np.nonzero(held[(keys & lowest).view(np.int64)])
            keys = keys[q, p]
            bucket = np.minimum(np.searchsorted(distinct, keys), len(distinct) - 1)
            hit = distinct[bucket] == keys
            q, bucket = q[hit], bucket[hit]
            count = last[bucket] - first[bucket]
            at = np.repeat(first[bucket] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            met[np.repeat(q, count), order[at]] = True
        met[met.sum(1) < least] = True
        yield begin, met


def lift(vectors: np.ndarray, most: float, query: bool) -> np.ndarray:
    """Unit vectors whose distances fall as inner products rise."""
    if query:
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        return np.concatenate([unit, np.zeros((len(unit), 1))], 1)
    scaled = vectors / most
    return np.concatenate([scaled, np.sqrt(np.maximum(0, 1 - (scaled ** 2).sum(1, keepdims=True)))], 1)


def search_block(data_ids, data, query_ids, queries, k: int, plan: Plan) -> pd.DataFrame:
    """Best `k` candidates of one block for each query: query_id, vec_id, score. Ties go to smaller ids."""
    if len(data) <= plan.whole:
        met = ((begin, np.ones((min(200, len(queries) - begin), len(data)), bool)) for begin in range(0, len(queries), 200))
    else:
        most = np.linalg.norm(data, axis=1).max() * (1 + 1e-12)
        met = candidates(Tables(data.shape[1] + 1, plan), lift(data, most, False), lift(queries, most, True), k + 1)
    out = []
    for begin, mask in met:
        part = queries[begin:begin + len(mask)]
        mask &= data_ids[None, :] != query_ids[begin:begin + len(mask), None]
        # One product ranks the candidates up to its rounding; those that may be among the best are scored exactly.
        with np.errstate(over="ignore", invalid="ignore"):
            rough = part @ data.T
            slack = 4 * np.finfo(float).eps * data.shape[1] ** 2 * np.abs(part).max(1) * np.abs(data).max() + np.finfo(float).tiny
        for q, rows in ((q, np.flatnonzero(mask[q])) for q in range(len(mask))):
            if not len(rows):
                continue
            near = rough[q, rows]
            if len(rows) > k and np.isfinite(slack[q]) and np.isfinite(near).all():
                rows = rows[near >= np.partition(near, len(rows) - k)[len(rows) - k] - slack[q]]
            score = (data[rows] * part[q]).sum(1)
            if len(rows) > k:
                near = score >= np.partition(score, len(rows) - k)[len(rows) - k]
                rows, score = rows[near], score[near]
            best = np.lexsort((data_ids[rows], -score))[:k]
            out.append((np.full(len(best), query_ids[begin + q]), data_ids[rows[best]], score[best]))
    if not out:
        return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out)))))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector): one row per id, the element-wise smallest vector; unusable vectors and null ids left out."""
    v = F.col("vector")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    cast = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return cast.filter(F.col("vec_id").isNotNull() & v.isNotNull() & fine).groupBy("vec_id").agg(F.min("vector").alias("vector"))


def nearest(vectors: DataFrame, is_query, k: int = 20, plan: Plan = Plan(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the `k` nearest found of every row for which `is_query(id)` holds.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do
    null ids. Rows that repeat an id count once. Only vectors of one length are compared. A
    query never finds its own id; ties go to the smaller id. An empty table has no results.
    """
    rows = write_through(usable(vectors, id_col, vector_col).withColumn("dim", F.size("vector")))
    query = rows.filter(is_query(F.col("vec_id")))
    # Divided by its largest component first, so that no square overflows or vanishes.
    top = F.array_max(F.transform("vector", F.abs))
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + (x / top) * (x / top))
    band = F.floor((F.log(top) + F.log(square) / 2) / F.lit(math.log(plan.band)) + 0.5)
    rows = write_through(rows.withColumn("band", band))
    sizes = write_through(rows.groupBy("dim", "band").agg(F.ceil(F.count(F.lit(1)) / plan.block).alias("blocks")))
    teams = -(-max(query.count(), 1) // plan.queries)
    place = lambda parts: F.pmod(F.xxhash64("vec_id"), parts)
    every = lambda parts: F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))
    teams = F.lit(teams).cast("bigint")
    data = join_narrow(rows, sizes, ["dim", "band"], "inner", 24).withColumn("block", place(F.col("blocks"))).select(
        "vec_id", "vector", "dim", "band", "block").withColumn("team", every(teams))
    asked = join_narrow(query.select("vec_id", "vector", "dim", place(teams).alias("team")), sizes, ["dim"], "inner", 24).select(
        "vec_id", "vector", "dim", "band", "team", every(F.col("blocks")).alias("block"))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        return search_block(left.vec_id.to_numpy(), np.stack(left.vector), right.vec_id.to_numpy(), np.stack(right.vector), k, plan)

    keys = ["dim", "band", "team", "block"]
    found = data.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(search, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest found of each vector whose id is divisible by 20: query_id, rank, vec_id, score."""
    return nearest(table(spark, folder, "embeddings"), lambda vec_id: vec_id % 20 == 0)
