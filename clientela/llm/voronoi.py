"""Exact top-k by inner product: a Voronoi join of queries with data.

Vectors go to the cell of their nearest pivot. A summary of each cell (size, radius, the smallest
distances to its pivot) bounds every inner product between two cells. From these bounds each group of
queries gets a score that its k best are sure to reach, and data of a cell are sent to the group only
if the cell may hold a score that high. Groups and cells are cut into blocks of bounded size, each pair
of blocks is solved by itself, and the best of all blocks are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clientela.llm.tables import records_per_batch, ship, stored

SCALE = 64
K = 20
QUERY_STEP = 20
ROWS_PER_PIVOT = 1000
MOST_PIVOTS = 256
DATA_BLOCK = 1000
QUERY_BLOCK = 250
PAIRS_PER_BATCH = 32
_EXACT = 2.0**53
_LONG = 2**63 - 1


def scaled_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, v): floor(64 x) of each component as doubles, in bytes; unusable vectors are left out."""
    for batch in batches:
        ids, vectors = batch.column(0), batch.column(1)
        kept, packed = [], []
        for own, vector in zip(ids.to_pylist(), vectors.to_pylist()):
            if own is None or vector is None or any(x is None for x in vector):
                continue
            v = np.floor(SCALE * np.array(vector, np.float64))
            if np.isfinite(v).all():
                kept.append(own)
                packed.append((v + 0.0).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64()), pa.array(packed, pa.binary())], names=["vec_id", "v"])


def _matrix(raw: list[bytes], width: int) -> np.ndarray:
    """Rows of one width; a shorter vector ends in zeros."""
    out = np.zeros((len(raw), width))
    for row, part in zip(out, raw):
        v = np.frombuffer(part)
        row[: len(v)] = v
    return out


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (x**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1) - 2 * x @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


@dataclass
class Cells:
    """Pivots, and for each cell its radius and the smallest distances to its pivot (at most k + 1, ascending).

    Of each id one row at most counts among the distances of all cells, so only one of them can be the query's own.
    """

    pivots: np.ndarray
    radius: np.ndarray
    nearest: list[np.ndarray]

    def __post_init__(self) -> None:
        self.norm = np.sqrt((self.pivots**2).sum(axis=1))
        self.of = np.repeat(np.arange(len(self.nearest)), [len(near) for near in self.nearest])
        self.near = np.concatenate([*self.nearest, np.zeros(0)])

    def slack(self, size: np.ndarray) -> np.ndarray:
        """Room for rounding in distances and norms: bounds may only be too wide."""
        return 1e-6 * (size * (self.norm.max(initial=0) + self.radius.max(initial=0)) + 1)

    def floors(self, products: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
        """Scores that the k best of each row reach: products with the pivots, less what a distance from the pivot can take."""
        if len(self.near) <= k:  # all are of different ids: one of the k + 1 best may be the query's own
            return np.full(len(products), -np.inf)
        sure = products[:, self.of] - size[:, None] * self.near
        return np.partition(sure, len(self.near) - k - 1, axis=1)[:, len(self.near) - k - 1] - self.slack(size)


def _assign(pivots: np.ndarray, step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1).to_pylist(), pivots.shape[1])
            distance = _distances(x, pivots)
            cell = distance.argmin(axis=1) if len(x) else np.zeros(0, int)
            exact = np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1))
            ids = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cell, pa.int32()), pa.array(exact), pa.array(ids % step == 0)],
                names=["vec_id", "v", "cell", "distance", "query"],
            )

    return run


def _nearest(k: int):
    """The k + 1 smallest distances of each cell, of a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            cell, distance = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for j in np.unique(cell).tolist():
                held[j] = np.sort(np.r_[held.get(j, np.zeros(0)), distance[cell == j]])[: k + 1]
        cells = [j for j, d in held.items() for _ in d]
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(np.concatenate([*held.values(), np.zeros(0)]))], names=["cell", "distance"])

    return run


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of integers: in doubles where these are exact, else in Python's integers, held to the range of a long."""
    if not q.size or not x.size or np.abs(q).max() * np.abs(x).max() * q.shape[1] < _EXACT:
        return (q @ x.T).astype(np.int64)
    whole = [[int(a) for a in row] for row in q], [[int(a) for a in row] for row in x]
    return np.array([[max(-_LONG - 1, min(_LONG, sum(a * b for a, b in zip(u, v)))) for v in whole[1]] for u in whole[0]], np.int64)


def _members(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    values = column.values.slice(column.offsets[0].as_py(), column.offsets[1].as_py() - column.offsets[0].as_py())
    return values.field("vec_id").to_numpy(zero_copy_only=False), _matrix(values.field("v").to_pylist(), width)


def _solve(cells: Cells, k: int):
    width = cells.pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                j = one.column(0)[0].as_py()
                query_ids, q = _members(one.column(1), width)
                data_ids, x = _members(one.column(2), width)
                size = np.sqrt((q**2).sum(axis=1))
                products = q @ cells.pivots.T
                least = cells.floors(products, size, k)
                able = products[:, j] + size * cells.radius[j] + cells.slack(size) >= least
                query_ids, q, least = query_ids[able], q[able], least[able]
                if not len(q):
                    continue
                scores = _products(q, x)
                repeated = len(np.unique(data_ids)) < len(data_ids)
                out: list[list[np.ndarray]] = [[], [], []]
                for own, score, low in zip(query_ids, scores, least):
                    at = np.flatnonzero((data_ids != own) & (score >= low))
                    if repeated:  # an id's equal scores count once, and must not push out others
                        at = at[np.lexsort((data_ids[at], score[at]))]
                        at = at[np.r_[True, (data_ids[at][1:] != data_ids[at][:-1]) | (score[at][1:] != score[at][:-1])][: len(at)]]
                    if len(at) > k:  # all that tie with the k-th stay until they are put in order
                        at = at[score[at] >= np.partition(score[at], len(at) - k)[len(at) - k]]
                    at = at[np.lexsort((data_ids[at], ~score[at]))][:k]
                    for column, part in zip(out, (np.full(len(at), own), data_ids[at], score[at])):
                        column.append(part)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", step: int = QUERY_STEP, k: int = K) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of every query, ties to the smaller vec_id.

    Queries are the rows whose id is divisible by ``step``; candidates are all rows but those of the
    query's id. The score is the inner product of the vectors floor(64 x).

    Rows with a null id or vector, or with a null or non-finite component, take no part. Rows repeated
    in full count once; an id with several vectors is a query and a candidate with each, and equal scores
    of one pair of ids count once. Vectors of different lengths are compared as if the shorter ended in zeros. Scores
    beyond a long are held at its ends. Fewer than k candidates: all. Empty table: no rows. Other
    columns are not read.
    """
    spark = ship(vectors.sparkSession)
    schema = "query_id long, rank int, vec_id long, score long"
    source = vectors.select(F.col(id_column).cast("long"), F.col(vector_column).cast("array<double>"))
    scaled = stored(source.mapInArrow(scaled_vectors, "vec_id long, v binary").distinct(), "vectors")
    n, width = scaled.agg(F.count("*"), F.max(F.octet_length("v"))).first()
    if not n:
        return spark.createDataFrame([], schema)
    width = (width or 0) // 8
    wanted = max(1, min(MOST_PIVOTS, n // ROWS_PER_PIVOT))
    chosen = scaled.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(wanted).collect()
    pivots = _matrix([r.v for r in chosen], width)

    placed = stored(scaled.mapInArrow(_assign(pivots, step), "vec_id long, v binary, cell int, distance double, query boolean"), "cells")
    sizes = {r.cell: r for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("distance").alias("radius"), F.count_if("query").alias("queries"), F.max(F.when(F.col("query"), F.col("distance"))).alias("query_radius")).collect()}
    of_id = placed.groupBy("vec_id").agg(F.min(F.struct("distance", "cell")).alias("d"))  # an id may have many rows: bounds take one
    near = of_id.select("d.cell", "d.distance").mapInArrow(_nearest(k), "cell int, distance double")
    ranked = near.withColumn("place", F.row_number().over(Window.partitionBy("cell").orderBy("distance"))).where(F.col("place") <= k + 1)
    nearest: dict[int, list[float]] = {}
    for r in ranked.collect():
        nearest.setdefault(r.cell, []).append(r.distance)
    cells = Cells(
        pivots, np.array([sizes[j].radius if j in sizes else 0.0 for j in range(len(pivots))]),
        [np.sort(np.array(nearest.get(j, []))) for j in range(len(pivots))],
    )
    pairs = [(i, j) for i in sizes if sizes[i].queries for j in _reached(cells, i, sizes[i].query_radius, k) if j in sizes]
    blocks = spark.createDataFrame(
        [(j, -(-r.n // DATA_BLOCK), -(-r.queries // QUERY_BLOCK)) for j, r in sizes.items()], "cell int, data_blocks int, query_blocks int"
    )
    placed = placed.join(F.broadcast(blocks), "cell")  # a row for each pivot
    member = F.sort_array(F.collect_list(F.struct("vec_id", "v"))).alias("members")

    def packed(rows: DataFrame, count: str) -> DataFrame:
        block = F.pmod(F.xxhash64("vec_id", "v"), F.col(count))
        return rows.select("cell", block.alias("block"), "vec_id", "v").groupBy("cell", "block").agg(member)

    groups = packed(placed.where("query"), "query_blocks").select(F.col("cell").alias("i"), F.col("members").alias("queries"))
    data = packed(placed, "data_blocks").select(F.col("cell").alias("j"), F.col("members").alias("data"))
    sent = F.broadcast(spark.createDataFrame(pairs, "i int, j int"))  # at most the square of the number of pivots
    tasks = groups.join(sent, "i").join(data.hint("merge"), "j").select("j", "queries", "data")
    with records_per_batch(spark, PAIRS_PER_BATCH):
        best = stored(tasks.mapInArrow(_solve(cells, k), "query_id long, vec_id long, score long").distinct(), "best")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _reached(cells: Cells, i: int, query_radius: float, k: int) -> list[int]:
    """Cells that may hold one of the k best of a query in cell i."""
    size = np.array([cells.norm[i] + query_radius])
    products = (cells.pivots[i] @ cells.pivots.T)[None]
    wander = query_radius * cells.norm
    least = cells.floors(products - wander, size, k)
    most = products + wander + size * cells.radius + cells.slack(size)
    return np.flatnonzero(most[0] >= least[0]).tolist()
