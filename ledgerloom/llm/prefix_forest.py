"""Approximate nearest neighbours by a hash-prefix forest: largest inner product.

* Vectors are dealt into shards of bounded size by a hash of their id. In a shard, each tree gives every vector a long hash string (signs of
  random projections) and keeps the strings in a sorted array.
* A query descends in each tree to its longest-prefix match, then ascends in all trees at once, one bit at a time, until the ranges of its
  prefix hold enough candidates; their union is scored exactly, in double precision on the original vectors.
* A vector is hashed with one more component that gives all vectors the largest norm, so a large inner product is a small angle.
* Equal vectors are one entry of the index and only their smallest ids can be among the nearest, so a group of copies neither fills the
  candidates nor hides others.

Each shard reports its best for every query; the best of all shards are merged by query. The candidates are a share of the shard
(``share``), which decides the recall; vectors without any structure need a large one. All rows are indexed.

Defined cases: vectors that are null, zero, of another length than most, or that hold null, NaN or infinite components take no part, nor do
rows without an id; rows with the query's id are its own; a row that is there more than once is returned once; ties go to the
smaller vec_id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class ForestParams:
    trees: int = 64
    bits: int = 32
    share: float = 0.9  # candidates, counted in every tree, as a share of the shard's distinct vectors
    least: int = 1200  # and so many at least
    shard_rows: int = 16384
    k: int = 20
    seed: int = 7


class Forest:
    """Sorted hash strings of the distinct vectors of a shard."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, norm: float, p: ForestParams):
        self.p = p
        self.planes = np.random.default_rng(p.seed).normal(size=(vectors.shape[1] + 1, p.trees * p.bits))
        order = np.lexsort((ids, *vectors.T))
        ids, vectors = ids[order], vectors[order]
        fresh = np.ones(len(ids), dtype=bool)
        fresh[1:] = (vectors[1:] != vectors[:-1]).any(axis=1)
        self.vectors = np.ascontiguousarray(vectors[fresh])
        self.ids, self.begin = ids, np.append(np.flatnonzero(fresh), len(ids))
        self.norm = norm
        rest = np.sqrt(np.maximum(norm**2 - (self.vectors**2).sum(axis=1), 0.0))
        codes = self.strings(np.concatenate([self.vectors, rest[:, None]], axis=1))
        self.order = np.argsort(codes, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(codes.T, self.order, axis=1)

    def strings(self, points: np.ndarray) -> np.ndarray:
        """(points, trees) hash strings, the first bit being the highest."""
        out = np.empty((len(points), self.p.trees), dtype=np.uint64)
        weights = np.uint64(1) << np.arange(self.p.bits - 1, -1, -1, dtype=np.uint64)
        for t in range(self.p.trees):
            signs = points @ self.planes[:, t * self.p.bits : (t + 1) * self.p.bits] > 0
            out[:, t] = (signs * weights).sum(axis=1, dtype=np.uint64)
        return out

    def ranges(self, codes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query and tree the range of the strings with the query's first ``depth`` bits."""
        rest = np.uint64(self.p.bits - depth)
        low = (codes >> rest) << rest
        high = low + (np.uint64(1) << rest)
        begin, end = (np.empty(codes.shape, dtype=np.int64) for _ in range(2))
        for t in range(self.p.trees):
            begin[:, t] = np.searchsorted(self.sorted[t], low[:, t])
            end[:, t] = np.searchsorted(self.sorted[t], high[:, t])
        return begin, end

    def candidates(self, queries: np.ndarray) -> Iterator[np.ndarray]:
        """The distinct vectors that each query meets: synchronous ascent from the longest prefixes."""
        n = len(self.vectors)
        enough = max(self.p.least, self.p.share * n)
        codes = self.strings(np.concatenate([queries, np.zeros((len(queries), 1))], axis=1))
        begin, end = (np.empty(codes.shape, dtype=np.int64) for _ in range(2))
        open_ = np.arange(len(queries))
        # strings deeper than this are told apart long before, so the longest matches lie at or above it
        for depth in range(min(self.p.bits, n.bit_length() + 3), -1, -1):
            b, e = self.ranges(codes[open_], depth)
            ready = ((e - b).sum(axis=1) >= enough) | (depth == 0)
            begin[open_[ready]], end[open_[ready]] = b[ready], e[ready]
            open_ = open_[~ready]
            if not len(open_):
                break
        for q in range(len(queries)):
            mark = np.zeros(n, dtype=bool)
            for t in range(self.p.trees):
                mark[self.order[t, begin[q, t] : end[q, t]]] = True
            yield np.flatnonzero(mark)

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, vec_id, score): the k best ids of every query."""
        k, out = self.p.k, []
        for own, query, found in zip(query_ids, queries, self.candidates(queries)):
            if len(found) > k + 1:  # one entry may be the query itself
                rough = self.vectors[found] @ query
                least = np.partition(rough, len(rough) - k - 1)[len(rough) - k - 1]
                # the matrix product rounds by where a row stands; what it cannot tell apart stays
                found = found[rough >= least - 1e-12 * self.norm * np.linalg.norm(query)]
            scores = inner_products(self.vectors[found], query)
            ids = [self.ids[self.begin[f] : min(self.begin[f + 1], self.begin[f] + k + 1)] for f in found]
            score = np.repeat(scores, [len(i) for i in ids])
            ids = np.concatenate(ids) if ids else np.empty(0, np.int64)
            score, ids = score[ids != own], ids[ids != own]
            best = np.lexsort((ids, -score))[:k]
            out.append((np.full(len(best), own), ids[best], score[best]))
        return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.empty(0, np.int64),) * 2 + (np.empty(0),)


def inner_products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Summed component by component: equal vectors have equal products, in whatever matrix they stand."""
    out = np.zeros(len(rows))
    for component, factor in zip(rows.T, query):
        out += component * factor
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _searcher(norm: float, p: ForestParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, vectors, forest = None, [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            shards, asks = batch.column("shard").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            number, points = batch.column("vec_id").to_numpy(), _matrix(batch.column("vec"))
            cuts = np.flatnonzero((shards[1:] != shards[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(shards)]):
                if shards[a] != shard:
                    shard, ids, vectors, forest = shards[a], [], [], None
                if not asks[a]:
                    ids.append(number[a:b])
                    vectors.append(points[a:b])
                elif ids:
                    if forest is None:
                        forest = Forest(np.concatenate(ids), np.concatenate(vectors), norm, p)
                    for x in range(a, b, 256):
                        q, v, s = forest.nearest(number[x : min(b, x + 256)], points[x : min(b, x + 256)])
                        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), pa.array(s)], names=["query_id", "vec_id", "score"])

    return run


def _usable(vectors: DataFrame, column: str) -> tuple[DataFrame, int]:
    """Rows that take part, as (vec_id, vec), and the length of their vectors."""
    vec = F.col(column).cast("array<double>")
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(vec, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long"), vec.alias("vec")).filter(F.col("vec_id").isNotNull() & fine)
    sizes = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.filter(F.size("vec") == (sizes["d"] if sizes else 0)), sizes["count"] if sizes else 0


def search(vectors: DataFrame, is_query: Column, p: ForestParams = ForestParams(), column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the nearest of all other rows for each row where ``is_query`` (over vec_id) holds."""
    rows, n = _usable(vectors, column)
    shards = max(1, -(-n // p.shard_rows))
    norm = rows.agg(F.max(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))).first()[0] or 0.0
    place = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    index = rows.dropDuplicates(["vec_id", "vec"]).select(place.alias("shard"), F.lit(False).alias("asks"), "vec_id", "vec")
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    asked = rows.filter(is_query).groupBy("vec_id").agg(F.min("vec").alias("vec")).select(every, F.lit(True).alias("asks"), "vec_id", "vec")
    dealt = index.unionByName(asked).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "asks", "vec_id")
    best = dealt.mapInArrow(_searcher(float(norm) ** 0.5, p), "query_id long, vec_id long, score double")
    once = best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= p.k)
    return ranked.select("query_id", "rank", "vec_id", "score")
