"""Nearest neighbours by a block matrix join with int8 tiles.

Vectors are rounded to int8 codes with one scale each, and the length of what rounding took
away is kept, so the product of two codes gives a distance with a bound on its error. A tile
is a block of queries times a block of candidates; only pairs whose lower bound is within the
k-th smallest upper bound so far are computed again in double precision, and each task keeps
one heap of k per query. The heaps of all tasks are merged per query, in two steps.

The result is exact: the bounds hold for every pair, so nothing near is lost.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.session import materialized

#: Queries, and numbers in their vectors, that are broadcast at a time.
QUERY_BLOCK, QUERY_NUMBERS = 4_096, 2_000_000
#: Candidates in a tile.
TILE = 2_048


def valid(vector: Column) -> Column:
    """Not null or empty, no null or non-finite component, not all zero."""
    number = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(number, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(number, lambda x: x != 0), F.lit(False))


class Codes:
    """int8 codes of rows, their scales, squared lengths of the codes, and rounding errors."""

    def __init__(self, vectors: np.ndarray):
        top = np.abs(vectors).max(axis=1, initial=0.0)
        self.scale = np.where(top > 0, top / 127, 1.0)
        self.codes = np.rint(vectors / self.scale[:, None]).astype(np.int8)
        wide = self.codes.astype(np.float64)
        self.square = (wide * wide).sum(axis=1)
        with np.errstate(over="ignore", invalid="ignore"):
            lost = vectors - wide * self.scale[:, None]
            # a little more than the error itself, for the arithmetic of the bounds
            length = self.scale * np.sqrt(self.square)
            self.error = np.sqrt((lost * lost).sum(axis=1)) * (1 + 1e-9) + length * 1e-9

    def distances(self, other: Codes) -> tuple[np.ndarray, np.ndarray]:
        """Distances between the rounded rows, whose products are exact, and the error of the sums."""
        product = np.zeros((len(self.codes), len(other.codes)))
        for at in range(0, self.codes.shape[1], 1_024):  # sums of 1,024 products fit a float's 24 bits
            a, b = self.codes[:, at : at + 1_024].astype(np.float32), other.codes[:, at : at + 1_024].astype(np.float32)
            product += a @ b.T
        with np.errstate(over="ignore", invalid="ignore"):
            own, far = self.scale**2 * self.square, other.scale**2 * other.square
            product *= -2 * self.scale[:, None] * other.scale[None]
            product += own[:, None]
            product += far[None]
            # cancellation: what the difference of the large terms can be wrong by
            slack = (np.sqrt(own)[:, None] + np.sqrt(far)[None]) * 3e-8
            return np.sqrt(np.maximum(product, 0)), slack


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of rows, the squares summed from the first component to the last."""
    with np.errstate(over="ignore"):
        squares = ((a - b) ** 2).T
        total = np.zeros(squares.shape[1])
        for part in squares:
            total += part
        return np.sqrt(total)


class Heaps:
    """The k nearest candidates of each query so far; ties to the smaller id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.codes = Codes(vectors)
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in ids]
        self.worst = np.full(len(ids), np.inf)

    def tile(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        codes = Codes(vectors)
        middle, slack = self.codes.distances(codes)
        with np.errstate(invalid="ignore"):
            error = self.codes.error[:, None] + codes.error[None] + slack
            other = ids[None] != self.ids[:, None]
            upper = np.where(other, middle + error, np.inf)
            bound = self.worst
            if upper.shape[1] > self.k:
                bound = np.minimum(bound, np.partition(upper, self.k - 1, axis=1)[:, self.k - 1])
            near = other & ~(middle - error > bound[:, None])
        query, candidate = np.nonzero(near)
        distance = exact(self.vectors[query], vectors[candidate])
        keep = distance <= self.worst[query]
        for q, d, i in zip(query[keep].tolist(), distance[keep].tolist(), ids[candidate[keep]].tolist(), strict=True):
            heap = self.heaps[q]
            if len(heap) < self.k:
                heapq.heappush(heap, (-d, -i))
            elif (-d, -i) > heap[0]:
                heapq.heapreplace(heap, (-d, -i))
            if len(heap) == self.k:
                self.worst[q] = -heap[0][0]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        query = np.repeat(self.ids, [len(h) for h in self.heaps])
        return query, np.array([-i for h in self.heaps for _, i in h], np.int64), np.array([-d for h in self.heaps for d, _ in h])


def _vectors(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and vectors by number of components."""
    sizes = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(sizes)
    return {
        int(n): (own := np.flatnonzero(sizes == n), flat[(ends[own] - n)[:, None] + np.arange(n)]) for n in np.unique(sizes)
    }


_FOUND = "query_id long, vec_id long, score double"


def _near(candidates: DataFrame, ids: np.ndarray, vectors: list[list[float]], k: int) -> DataFrame:
    """The k nearest candidates of a block of queries in each task."""
    by_size: dict[int, list[int]] = {}
    for i, v in enumerate(vectors):
        by_size.setdefault(len(v), []).append(i)
    blocks = {n: (ids[own], np.array([vectors[i] for i in own], np.float64)) for n, own in by_size.items()}
    shared = candidates.sparkSession.sparkContext.broadcast(blocks)

    def search(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = {n: Heaps(i, v, k) for n, (i, v) in shared.value.items()}
        for rows in parts:
            own_ids = rows.column("id").to_numpy()
            for n, (places, own) in _vectors(rows.column("vector")).items():
                for at in range(0, len(places), TILE):
                    if n in heaps:
                        heaps[n].tile(own_ids[places[at : at + TILE]], own[at : at + TILE])
        for found in heaps.values():
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found.rows()], ["query_id", "vec_id", "score"])

    return candidates.mapInArrow(search, _FOUND)


def nearest(
    candidates: DataFrame, queries: DataFrame, k: int = 10, *, key: str = "vec_id", vector: str = "embedding",
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """Each query's ``k`` nearest candidates by Euclidean distance: query_id, rank, vec_id, score.

    Rows with a null id or an invalid vector (:func:`valid`) take no part, and vectors of
    different lengths aren't compared. A query doesn't find rows of its own id; of several
    queries of one id the smallest vector counts. Ties go to the smaller id; repeated
    candidate rows each count. Without queries or candidates there are no rows.
    """
    rows = candidates.where(F.col(key).isNotNull() & valid(F.col(vector))).select(
        F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")
    )
    asked = queries.where(F.col(key).isNotNull() & valid(F.col(vector))).groupBy(F.col(key).cast("long").alias("id"))
    asked = materialized(asked.agg(F.min(F.col(vector).cast("array<double>")).alias("vector")), "nearest-queries")
    n, numbers = asked.agg(F.count("*"), F.sum(F.size("vector"))).head()
    blocks = int(max(n // query_block, (numbers or 0) // QUERY_NUMBERS)) + 1
    found = None
    for block in range(blocks if n else 0):
        own = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).orderBy("id").collect()
        near = _near(rows, np.array([r["id"] for r in own], np.int64), [r["vector"] for r in own], k)
        if blocks > 1:  # each block's broadcast is done with before the next one's
            near = materialized(near, "nearest-found")
        found = near if found is None else found.unionByName(near)
    if found is None:
        found = candidates.sparkSession.createDataFrame([], _FOUND)
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
