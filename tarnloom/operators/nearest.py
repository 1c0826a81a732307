"""The nearest rows of many queries, compared as matrices in Arrow batches; each task keeps the k best rows of each query.

Matrix products only tell which pairs can be among the k best: their distances are then summed
in the order of the vectors' elements, as the column expressions do, so equal vectors are
equally far and ties go by id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows compared at once with a block of queries; pairs whose distances are summed at once; numbers of the queries that one pass over the rows takes to the executors.
_ROWS, _PAIRS, _NUMBERS = 8192, 1 << 18, 1 << 20
#: Beyond the error of a matrix product of unit vectors.
_MARGIN = 1e-9
#: Where a larger share of the pairs has a common bucket, all of the block are multiplied.
_DENSE = 1 / 16


@dataclass
class Buckets:
    """Cells of ``projections`` planes make a bucket of a table; ``widen`` takes in those so many steps away."""

    planes: np.ndarray
    projections: int
    width: float
    widen: int

    def cells(self, vectors: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        at = vectors @ self.planes.T / lengths[:, None] / self.width
        return np.clip(np.nan_to_num(np.floor(at), nan=0.0), -(2.0**31), 2.0**31 - 1).astype(np.int64)

    def of_rows(self, cells: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each table the distinct buckets of the rows, and which of them is each row's."""
        tables = (cells[:, t : t + self.projections] for t in range(0, cells.shape[1], self.projections))
        return [_distinct(table) for table in tables]

    def shared(self, tables: list[tuple[np.ndarray, np.ndarray]], cells: np.ndarray) -> np.ndarray:
        """Queries by rows: whether they share a bucket in any table. The queries of a bucket are bits of words."""
        n = len(cells)
        words = np.zeros((len(tables[0][1]), -(-n // 64)), np.uint64)
        for t, (distinct, which) in enumerate(tables):
            own = cells[:, t * self.projections : (t + 1) * self.projections]
            near = np.zeros((len(distinct), words.shape[1] * 64), bool)
            if self.widen == 0:
                both, at = _distinct(np.concatenate([distinct, own]))
                place = np.full(len(both), -1)
                place[at[: len(distinct)]] = np.arange(len(distinct))
                row = place[at[len(distinct) :]]
                near[row[row >= 0], np.flatnonzero(row >= 0)] = True
            else:
                near[:, :n] = True
                for p in range(self.projections):
                    near[:, :n] &= np.abs(distinct[:, p, None] - own[None, :, p]) <= self.widen
            words |= np.packbits(near, axis=1).view(np.uint64)[which]
        return np.unpackbits(words.view(np.uint8), axis=1, count=n).T.view(bool)


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows and the place of each row among them."""
    low = rows.min(axis=0)
    spans = [int(x) for x in rows.max(axis=0) - low + 1]
    if math.prod(spans) >= 1 << 62:
        distinct, which = np.unique(rows, axis=0, return_inverse=True)
        return distinct, which.reshape(-1)
    key = np.zeros(len(rows), np.int64)
    for p, span in enumerate(spans):
        key = key * span + (rows[:, p] - low[p])
    _, first, which = np.unique(key, return_index=True, return_inverse=True)
    return rows[first], which


def _summed(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Dot products of the columns ``i`` of ``a`` and ``j`` of ``b``, added up in the order of the elements."""
    out = np.zeros(len(i))
    for x, y in zip(a, b, strict=True):
        out += x[i] * y[j]
    return out


def _vectors(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, vectors and lengths of the rows that have ``size`` elements, no null among them, and a direction."""
    fit = pc.fill_null(pc.equal(pc.list_value_length(column), size), False)
    places = np.flatnonzero(fit.to_numpy(zero_copy_only=False))
    values = column.filter(fit).flatten()
    whole = ~values.is_null().to_numpy(zero_copy_only=False).reshape(-1, size).any(axis=1)
    v = values.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, size)[whole]
    every = np.arange(len(v))
    lengths = np.sqrt(_summed(v.T, v.T, every, every))
    some = ~(lengths == 0)
    return places[whole][some], v[some], lengths[some]


@dataclass
class Search:
    """The ``k`` nearest rows of each of the queries, a block of ``at_once`` of them at a time."""

    ids: pa.Array
    vectors: np.ndarray
    lengths: np.ndarray
    k: int
    at_once: int
    buckets: Buckets | None
    query_cells: np.ndarray | None

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_query = np.ascontiguousarray(self.vectors.T)
        limit = np.full(len(self.ids), np.inf)
        best: dict[int, tuple[np.ndarray, np.ndarray, pa.Array]] = {}
        with np.errstate(all="ignore"):
            for batch in batches:
                for start in range(0, batch.num_rows, _ROWS):
                    part = batch.slice(start, _ROWS)
                    places, v, lengths = _vectors(part.column(1), self.vectors.shape[1])
                    if not len(places):
                        continue
                    of_row = np.ascontiguousarray(v.T)
                    tables = self.buckets and self.buckets.of_rows(self.buckets.cells(v, lengths))
                    for at in range(0, len(self.ids), self.at_once):
                        i, j = self._may_be_near(at, v, lengths, tables, limit)
                        for x in range(0, len(i), _PAIRS):
                            q, r = i[x : x + _PAIRS], j[x : x + _PAIRS]
                            d = 1 - _summed(of_query, of_row, q, r) / (self.lengths[q] * lengths[r])
                            less = ~(d > limit[q])
                            best[at] = self._merged(best.get(at), q[less], d[less], part.column(0).take(pa.array(places[r[less]])))
                            self._limit(best[at], limit)
        for q, d, ids in best.values():
            yield pa.RecordBatch.from_arrays([self.ids.take(pa.array(q)), ids, pa.array(d)], ["query_id", "id", "distance"])

    def _may_be_near(self, at: int, v: np.ndarray, lengths: np.ndarray, tables: list | None, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Query and row of the pairs of a block that may be among the k best."""
        s = slice(at, at + self.at_once)
        shared = self.buckets and self.buckets.shared(tables, self.query_cells[s])
        if shared is None or shared.mean() > _DENSE:
            far = 1 - (self.vectors[s] @ v.T) / (self.lengths[s, None] * lengths)
            far[np.isnan(far)] = np.inf
            if shared is not None:
                far[~shared] = np.inf
            most = limit[s].copy()
            new = np.flatnonzero(np.isinf(most))
            if len(new) and len(v) > self.k:
                most[new] = np.partition(far[new], self.k - 1, axis=1)[:, self.k - 1]
            keep = far <= most[:, None] + _MARGIN
            shared = keep if shared is None else keep & shared
        i, j = np.nonzero(shared)
        return i + at, j

    def _limit(self, best: tuple[np.ndarray, np.ndarray, pa.Array], limit: np.ndarray) -> None:
        """The distance that a row must not exceed, for queries that have k rows already."""
        q, d, _ = best
        last = np.flatnonzero(np.append(q[1:] != q[:-1], True)) if len(q) else np.zeros(0, np.int64)
        full = last[last - np.searchsorted(q, q[last]) == self.k - 1]
        limit[q[full]] = np.where(np.isnan(d[full]), np.inf, d[full])

    def _merged(self, best: tuple[np.ndarray, np.ndarray, pa.Array] | None, q: np.ndarray, d: np.ndarray, ids: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """The k best of each query, by query, distance and id."""
        if best:
            q, d, ids = np.concatenate([best[0], q]), np.concatenate([best[1], d]), pa.concat_arrays([best[2], ids])
        by_id = pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
        order = np.lexsort((by_id, d, q))
        first = np.searchsorted(q[order], q[order])
        order = order[np.arange(len(order)) - first < self.k]
        return q[order], d[order], ids.take(pa.array(order))


def nearest(rows: DataFrame, queries: DataFrame, k: int, at_once: int, buckets: tuple[int, int, float, int, int] | None = None) -> DataFrame:
    """``query_id, id, distance, rank`` for ``rows(id, vector)`` and ``queries(id, vector)``, which reach the driver.

    ``buckets`` are the tables, projections, width, widening and seed of :class:`Buckets`. The
    rows are read once for each 2**20 numbers of the queries.
    """
    import random

    (row_id, _), (query_id, _) = rows.schema.fields, queries.schema.fields
    schema = T.StructType([T.StructField("query_id", query_id.dataType), T.StructField("id", row_id.dataType), T.StructField("distance", T.DoubleType())])
    stated = queries.orderBy(query_id.name).toArrow().combine_chunks()
    ids, column = (c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in stated.columns)
    found: DataFrame | None = None
    for size in sorted(set(pc.list_value_length(column).drop_null().to_pylist()) - {0}):
        places, vectors, _ = _vectors(column, size)
        lengths = np.array([math.sqrt(sum(x * x for x in v)) for v in vectors.tolist()])
        space = None
        if buckets:
            tables, projections, width, widen, seed = buckets
            rng = random.Random(seed)
            space = Buckets(np.array([[rng.gauss(0, 1) for _ in range(size)] for _ in range(tables * projections)]), projections, width, widen)
        for at in range(0, len(places), max(1, _NUMBERS // size)):
            s = slice(at, at + max(1, _NUMBERS // size))
            search = Search(ids.take(pa.array(places[s])), vectors[s], lengths[s], k, at_once, space, space and space.cells(vectors[s], lengths[s]))
            part = rows.mapInArrow(search, schema)
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = rows.sparkSession.createDataFrame([], schema)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))).filter(F.col("rank") <= k)
