"""Exact top-k inner products by block-at-a-time pruning.

Components of the vectors are the terms. Rows are taken in ranges, ordered within a range so that like rows are neighbours, and
cut into blocks; a block keeps the largest and the smallest value of each term, and a forward index of its rows. For each query
the blocks are ordered by the sum of their term maxima (for negative weights: minima), and scored through their forward
indexes until the next sum falls below the k-th score found so far. The k-th score among a bounded sample of rows is a lower
bound that all tasks start from; it only saves work.

Queries are a stated set; they go to the tasks in chunks of at most QUERY_BYTES, each against all rows, and the tasks' own best
rows are merged by query; the results of several chunks are written one after the other, so the driver holds one. Scores are integers and exact: components become floor(scale * x).

Defined results: vectors that are null or hold null or non-finite components, and rows with a null id, take no part; missing
last components of shorter vectors count as 0; ids must be whole numbers (other types are an error); rows that share a query's id count as its own and are no candidates; a repeated
query id is answered once, for its first vector in order of components; other repeated rows each count; scores beyond 64 bits
are cut to the nearest long; an empty table or query set gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import integral, materialized

QUERY_BYTES = 16 << 20
#: Rows of a range and of a block, rows that the first bound is taken from.
RANGE_ROWS, BLOCK_ROWS, SEED_ROWS = 8192, 32, 4096
#: Sums of products are exact in doubles below this.
EXACT = 1 << 53
LONG_MIN, LONG_MAX = -(2**63), 2**63 - 1


def integer_rows(ids: pa.Array, vectors: pa.Array, scale: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ids and integer components (as doubles) of the rows that take part."""
    out_ids, out = [], []
    whole = vectors.is_valid().to_numpy(zero_copy_only=False) & ids.is_valid().to_numpy(zero_copy_only=False)
    offsets = vectors.offsets.to_numpy()
    values = vectors.values.cast(pa.float64())
    missing = values.is_null().to_numpy(zero_copy_only=False)
    flat = values.fill_null(0.0).to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(missing | ~np.isfinite(flat))])
    with np.errstate(all="ignore"):
        flat = np.floor(flat * scale)
    for i, x in enumerate(ids.to_pylist()):
        a, b = offsets[i], offsets[i + 1]
        if whole[i] and bad[a] == bad[b]:
            out_ids.append(x)
            out.append(flat[a:b])
    return np.array(out_ids, np.int64), out


def dense(rows: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : min(len(r), width)] = r[:width]
    return out


def slow_score(a: np.ndarray, b: np.ndarray) -> int:
    """Inner product in whole numbers of any size."""
    n = min(len(a), len(b))
    return max(LONG_MIN, min(LONG_MAX, sum(int(x) * int(y) for x, y in zip(a[:n], b[:n]))))


class Best:
    """The best k (score, id) of a query so far: higher scores first, then smaller ids."""

    def __init__(self, k: int, floor: float):
        self.k, self.floor = k, floor
        self.scores, self.ids = np.zeros(0), np.zeros(0, np.int64)

    @property
    def bar(self) -> float:
        """Rows below it can't be among the best."""
        return max(self.floor, self.scores[-1]) if len(self.scores) == self.k else self.floor

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]


class Queries:
    """A chunk of queries, and the rows that score highest for each."""

    def __init__(self, ids: np.ndarray, rows: list[np.ndarray], k: int):
        self.ids, self.rows, self.k = ids, rows, k
        self.width = max((len(r) for r in rows), default=0) or 1
        # Components below it have products whose sums are exact, however many there are.
        self.limit = math.isqrt(EXACT // self.width)
        self.large = np.array([bool(len(r)) and (np.abs(r).max() >= self.limit) for r in rows], bool)
        self.matrix = dense([np.zeros(0) if big else r for r, big in zip(rows, self.large)], self.width)
        self.floors = np.full(len(rows), -np.inf)

    def seed(self, ids: np.ndarray, rows: list[np.ndarray]) -> None:
        """Lower bounds of the k-th scores from some rows."""
        kept = [i for i, r in enumerate(rows) if not len(r) or np.abs(r).max() < self.limit]
        if len(kept) <= self.k or not len(self.ids):
            return
        ids, rows = ids[kept], dense([rows[i] for i in kept], self.width)
        for a in range(0, len(self.ids), 1024):
            scores = self.matrix[a : a + 1024] @ rows.T
            scores[self.ids[a : a + 1024, None] == ids[None, :]] = -np.inf
            self.floors[a : a + 1024] = np.partition(scores, -self.k, axis=1)[:, -self.k]
        self.floors[self.large] = -np.inf

    def begin(self) -> list[Best]:
        return [Best(self.k, f) for f in self.floors]

    def offer(self, best: list[Best], ids: np.ndarray, rows: list[np.ndarray]) -> None:
        """Scores a range of rows for all queries."""
        if not len(self.ids):
            return
        big = np.array([bool(len(r)) and np.abs(r).max() >= self.limit for r in rows], bool)
        for q in range(len(self.ids)):
            if (which := np.arange(len(ids)) if self.large[q] else np.flatnonzero(big)).size:
                which = which[ids[which] != self.ids[q]]
                best[q].add(np.array([slow_score(self.rows[q], rows[i]) for i in which], object), ids[which])
        ids, rows = ids[~big], dense([r for r, b in zip(rows, big) if not b], self.width)
        if not len(ids):
            return
        # Like rows next to each other: by nearest of some evenly spaced pivot rows.
        pivots = rows[:: max(1, len(rows) // max(1, len(rows) // (2 * BLOCK_ROWS)))]
        nearest = np.argmax(rows @ pivots.T - 0.5 * (pivots**2).sum(1), axis=1)
        order = np.argsort(nearest, kind="stable")
        pad = -len(order) % BLOCK_ROWS
        forward, members = rows[order], ids[order]
        starts = np.arange(0, len(order), BLOCK_ROWS)
        most, least = np.maximum.reduceat(forward, starts), np.minimum.reduceat(forward, starts)
        real = np.concatenate([np.ones(len(order), bool), np.zeros(pad, bool)]).reshape(-1, BLOCK_ROWS)
        forward = np.concatenate([forward, np.zeros((pad, self.width))]).reshape(-1, BLOCK_ROWS, self.width)
        members = np.concatenate([members, np.zeros(pad, np.int64)]).reshape(-1, BLOCK_ROWS)
        bounds = np.maximum(self.matrix, 0) @ most.T + np.minimum(self.matrix, 0) @ least.T
        for q in np.flatnonzero(~self.large):
            b, by, query = best[q], bounds[q], self.matrix[q]
            line = np.argsort(-by)
            at, step = 0, 2
            while at < len(line) and by[line[at]] >= b.bar:
                part = line[at : at + step]
                part = part[by[part] >= b.bar]
                scores = forward[part] @ query
                fit = real[part] & (members[part] != self.ids[q]) & (scores >= float(b.bar))
                if fit.any():
                    b.add(scores[fit], members[part][fit])
                at, step = at + step, step * 2


def search(vectors: DataFrame, is_query: Column, k: int = 10, scale: float = 1024.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k best other rows of every row for which is_query holds: query_id, rank (from 1), id_col, score."""
    key = integral(vectors, id_col)
    rows = vectors.select(key.alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    wanted = vectors.filter(is_query).select(key.alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    n_rows = rows.count()
    size = wanted.agg(F.sum(8 * F.greatest(F.size("v"), F.lit(1)).cast("long"))).first()[0] or 0
    n_chunks = math.ceil(size / QUERY_BYTES) or 1
    seeds = rows.filter(F.pmod(F.xxhash64("id"), F.lit(max(1, math.ceil(n_rows / SEED_ROWS)))) == 0).toArrow()
    taken = lambda t: integer_rows(*(pa.concat_arrays(c.chunks) for c in t.columns), scale) if t.num_rows else (np.zeros(0, np.int64), [])
    seed = taken(seeds)

    def of_chunk(c: int) -> Queries:
        part = wanted if n_chunks == 1 else wanted.filter(F.pmod(F.xxhash64("id"), F.lit(n_chunks)) == c)
        ids, found = taken(part.toArrow())
        first: dict[int, tuple] = {}
        for i, r in zip(ids.tolist(), found):
            if i not in first or tuple(r) < tuple(first[i]):
                first[i] = r
        queries = Queries(np.array(list(first), np.int64), list(first.values()), k)
        queries.seed(*seed)
        return queries

    def kernel_of(queries: Queries):
        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = queries.begin()
            for batch in batches:
                for a in range(0, batch.num_rows, RANGE_ROWS):
                    part = batch.slice(a, RANGE_ROWS)
                    queries.offer(best, *integer_rows(part.column(0), pa.concat_arrays([part.column(1)]), scale))
            ids = np.repeat(queries.ids, [len(b.ids) for b in best])
            if len(ids):
                scores = [int(s) for b in best for s in b.scores]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate([b.ids for b in best])), pa.array(scores, pa.int64())], ["query_id", "id", "score"])

        return kernel

    out = None
    for c in range(n_chunks):
        part = rows.mapInArrow(kernel_of(of_chunk(c)), "query_id long, id long, score long")
        if n_chunks > 1:  # written, so that only one chunk is held at a time
            part = materialized(part, "scores")
        out = part if out is None else out.unionByName(part)
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
