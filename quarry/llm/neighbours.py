"""Nearest neighbours by cosine, as a block matrix join over int8 tiles.

Vectors are scaled to length 1 and rounded to int8 with a scale each. The product of
two rounded vectors differs from the cosine by at most |ex| + |ey| + |ex||ey|, with
ex, ey the rounding remainders, whose lengths are kept. A tile of queries times
candidates gives bounds; pairs whose upper bound reaches the k-th best lower bound
survive, their cosine is taken in double precision from the original vectors, and a
heap of k per query merges tiles, then tasks.

Defined cases: vectors that are null, zero, empty or hold null or non-finite
components, and rows with a null id, take no part; vectors of different length are
not compared; a row of a query's own id is no candidate; repeated query rows give a
result each (``query_row`` tells them apart); equal scores go by smaller id.

Scale: candidates are read once per block of at most ``block`` queries, whose size
is fixed, so it is broadcast; blocks run one after the other, each's result written; a task holds one tile and the heaps. Each task emits k
rows per query, whatever its candidates; no candidates are shuffled.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Work

QUERY_BLOCK, TILE = 4096, 2048


def valid(ids: pa.Array, vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and double vectors of the rows that take part, by length."""
    out: dict[int, tuple[list, list]] = {}
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = np.asarray(vectors.values.cast(pa.float64()).to_numpy(zero_copy_only=False), np.float64) if len(vectors) else np.zeros(0)
    bounds = np.asarray(vectors.offsets)
    there = np.asarray(vectors.is_valid()) & np.asarray(ids.is_valid())
    numbers = np.asarray(ids.fill_null(0)).astype(np.int64)
    sizes = np.diff(bounds)
    for size in np.unique(sizes[there]):
        if size:
            rows = np.flatnonzero(there & (sizes == size))
            v = flat[bounds[:-1][rows][:, None] + np.arange(size)]
            good = np.isfinite(v).all(1) & (v != 0).any(1)
            if good.any():
                out[int(size)] = numbers[rows[good]], v[good]
    return out


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of each row of x with that of y; the same pair gives the same bits wherever it stands."""
    dot, xx, yy = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x))
    for d in range(x.shape[1]):
        a, b = x[:, d], y[:, d]
        dot += a * b
        xx += a * a
        yy += b * b
    return dot / (np.sqrt(xx) * np.sqrt(yy))


class Quantised:
    """Int8 forms of vectors, with the lengths of what rounding left."""

    def __init__(self, v: np.ndarray):
        top = np.abs(v).max(1, keepdims=True)
        unit = v / top  # first to the largest component, so no square overflows
        unit /= np.sqrt((unit * unit).sum(1, keepdims=True))
        self.scale = np.abs(unit).max(1) / 127
        self.codes = np.rint(unit / self.scale[:, None]).astype(np.int8)
        self.left = np.sqrt(((unit - self.codes * self.scale[:, None]) ** 2).sum(1))

    def products(self, other: Quantised) -> tuple[np.ndarray, np.ndarray]:
        """Products of all pairs, and how far the cosine may be from them."""
        kind = np.float32 if self.codes.shape[1] * 127 * 127 < 1 << 24 else np.float64  # sums of int8 products stay exact
        p = (self.codes.astype(kind) @ other.codes.astype(kind).T).astype(np.float64)
        p *= self.scale[:, None] * other.scale[None]
        return p, self.left[:, None] + other.left[None] + self.left[:, None] * other.left[None] + 1e-9


class Search:
    """Queries of one length, with a heap each."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.rows, self.ids, self.vectors, self.k = rows, ids, vectors, k
        self.codes = Quantised(vectors)
        self.heaps: list[list] = [[] for _ in ids]
        self.floor = np.full(len(ids), -np.inf)

    def tile(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        product, off = self.codes.products(Quantised(vectors))
        own = self.ids[:, None] == ids[None]
        low = np.where(own, -np.inf, product - off)
        k = min(self.k, len(ids))
        least = np.maximum(self.floor, np.partition(low, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > self.k else -np.inf)
        q, c = np.nonzero((product + off >= least[:, None]) & ~own)
        for at in range(0, len(q), 200_000):
            self._exact(q[at : at + 200_000], ids[c[at : at + 200_000]], vectors[c[at : at + 200_000]])

    def _exact(self, q: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        score = cosines(self.vectors[q], vectors)
        order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        first = np.searchsorted(q, q)  # place of each query's best
        keep = np.arange(len(q)) - first < self.k
        for i, s, c in zip(q[keep].tolist(), score[keep].tolist(), ids[keep].tolist(), strict=True):
            heap = self.heaps[i]
            if len(heap) < self.k:
                heapq.heappush(heap, (s, -c))
            elif (s, -c) > heap[0]:
                heapq.heapreplace(heap, (s, -c))
            if len(heap) == self.k:
                self.floor[i] = heap[0][0] - 1e-9

    def rows_out(self) -> Iterator[tuple[int, int, int, float]]:
        for row, own, heap in zip(self.rows.tolist(), self.ids.tolist(), self.heaps, strict=True):
            for s, c in heap:
                yield row, own, -c, s


def nearest(vectors: DataFrame, queries: DataFrame, *, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", block: int = QUERY_BLOCK) -> DataFrame:
    """The k nearest rows of ``vectors`` to each row of ``queries``: query_row, query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    pick = [F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding")]
    asked, rows = queries.select(*pick).where("vec_id is not null and embedding is not null"), vectors.select(*pick)
    n = -(-asked.count() // block) or 1
    found, work = [], Work(spark, "neighbours")
    for b in range(n):
        part = asked if n == 1 else asked.where(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(n)) == b)
        shared = spark.sparkContext.broadcast([(r["vec_id"], r["embedding"]) for r in part.collect()])

        def run(batches, shared=shared, b=b):
            table = shared.value
            groups = valid(pa.array([i for i, _ in table], pa.int64()), pa.array([v for _, v in table], pa.list_(pa.float64())))
            at, searches = 0, {}
            for size, (ids, v) in groups.items():
                searches[size] = Search((b << 32) + np.arange(at, at + len(ids)), ids, v, k)
                at += len(ids)
            for batch in batches:
                for size, (ids, v) in valid(batch["vec_id"], batch["embedding"]).items():
                    if size in searches:
                        for t in range(0, len(ids), TILE):
                            searches[size].tile(ids[t : t + TILE], v[t : t + TILE])
            out = [r for s in searches.values() for r in s.rows_out()]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["query_row", "query_id", "vec_id", "score"])

        rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
        best = rows.mapInArrow(run, "query_row long, query_id long, vec_id long, score double").withColumn("rank", rank).where(F.col("rank") <= k)
        if n == 1:
            return best
        # one block after the other: only one is on the driver and the executors at a time
        found.append(work(best))
        shared.destroy()
    return reduce(DataFrame.unionAll, found)


def neighbours_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: the five nearest of every vector whose id is divisible by 50."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(rows, rows.where("vec_id % 50 = 0")).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score
  FROM v q JOIN v c ON len(q.e) = len(c.e) AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
