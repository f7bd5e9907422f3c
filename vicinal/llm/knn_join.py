"""Exact top-k search by a Voronoi join.

The inner product becomes a distance by one more component: with M the largest norm of all rows, a row v is the point
(v, sqrt(M^2 - |v|^2)) and a query q the point (q, 0), and |q, v|^2 = |q|^2 + M^2 - 2 q.v. Rows and queries both go to their nearest
pivot; a pivot's rows are a cell, its queries a group. Summaries of a cell are its number of rows, its least and largest
distance to the pivot and the distances of its k + 1 nearest ids. From these alone comes a bound that k other rows of each query
surely keep: first for a group, by its radius, then for each query of it. A cell is needed by a query only if no
bound (by the cell's ring around its pivot, by the plane between the two pivots) puts it beyond.

Near cells lie in one bin of a bounded number of rows, and a cell that is too large is cut into several bins. Queries are fewer than
rows, so they travel: each goes to the bins that hold a cell it needs, each row goes to its bin, and only if some query needs it.
A bin is solved by matrix products, and what reaches the query's bound goes on, k rows at most. Where nothing can be pruned, every query
meets every bin, as it must, and each row still moves once.

Scores are whole numbers that must fit into a long, and exact; bounds are computed in floating point and moved outwards by more than their
error, so no row that counts is lost.

Defined results: vectors that are null, empty, or hold a null or a number that isn't finite take no part, nor
do rows with a null id. Ties go to the smaller id. A query's own id is no candidate of its own. Rows that
repeat an id and vector count once; of rows that repeat an id with other vectors each is a candidate. Vectors of other lengths than the query's
have no score. With fewer than k candidates all are returned. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, ship
from .kernels import mix

#: There are as many pivots as the square root of the rows, but no more than this, which bounds what every task is sent (9 MB at 64 components).
MAX_PIVOTS = 16_384
#: Rows of a bin at most, and at least where there are more cores than bins.
BIN, LEAST_BIN = 65_536, 1024
#: Queries that one copy of a bin is asked by.
ASKED = 1_000_000
#: Numbers of a matrix of distances that are held at once.
AT_ONCE = 2_000_000
#: Of the largest norm: more than the error of a distance.
SLACK = 1e-6
#: Scores and norms whose products stay whole numbers in floating point.
EXACT = 2.0**52


def as_matrix(column: pa.Array) -> np.ndarray:
    """A list column of equally long lists as an int64 matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 0), np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def products(a: np.ndarray, b: np.ndarray, b_float: np.ndarray, b_most: float) -> np.ndarray:
    """Exact inner products of the rows of two int64 matrices, the second also given as floating point with its largest number."""
    most = float(np.abs(a).max(initial=0)) * b_most * a.shape[1]
    return (a.astype(np.float64) @ b_float.T).astype(np.int64) if most < EXACT else a @ b.T


def whole_vectors(table: DataFrame, is_query: Column, id_column: str, vector: str, scale: int) -> DataFrame:
    """id, x (array of long) and query: floor(scale * component) of usable vectors, without repeated rows."""
    x = F.col(vector)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    good = x.isNotNull() & (F.size(x) > 0) & F.col(id_column).isNotNull() & finite
    cut = table.select(F.col(id_column).cast("long").alias("id"), F.when(good, F.transform(x, lambda c: F.floor(scale * c.cast("double")))).alias("x"), F.coalesce(is_query, F.lit(False)).alias("query"))
    return cut.where("x is not null").groupBy("id", "x").agg(F.max("query").alias("query"))


def choose_pivots(rows: DataFrame, n: int) -> np.ndarray:
    """At most n distinct vectors of ``rows`` (id, x), the first by hash."""
    some = rows.orderBy(F.xxhash64("id", F.lit(5)), "id", "x").limit(n).select("x").toArrow()
    return np.unique(as_matrix(some.column("x").combine_chunks()), axis=0).astype(np.float64)


def raised(x: np.ndarray, most: float | None) -> np.ndarray:
    """Points with one more component: of rows, which brings all to the norm ``most`` (squared); of queries (None) it is 0."""
    more = np.zeros(len(x)) if most is None else np.sqrt(np.maximum(most - (x**2).sum(1), 0.0))
    return np.column_stack([x, more])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a**2).sum(1)[:, None] - 2 * a @ b.T + (b**2).sum(1)[None], 0.0))


def in_parts(n: int, width: int) -> Iterator[slice]:
    step = max(1, AT_ONCE // max(width, 1))
    return (slice(i, i + step) for i in range(0, n, step))


def bins_of(points: np.ndarray, sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The first bin of each cell and over how many its rows are dealt. Cells are halved along their widest component until a
    part has ``most`` rows or one cell."""
    first, parts = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
    n, todo = 0, [np.arange(len(sizes))] if len(sizes) else []
    while todo:
        cells = todo.pop()
        if len(cells) == 1 or sizes[cells].sum() <= most:
            first[cells] = n
            parts[cells] = 1 if len(cells) > 1 else max(1, -(-int(sizes[cells[0]]) // most))
            n += int(parts[cells[0]])
            continue
        along = points[cells][:, np.ptp(points[cells], axis=0).argmax()]
        cells = cells[np.argsort(along, kind="stable")]
        half = int(np.clip(np.searchsorted(np.cumsum(sizes[cells]), sizes[cells].sum() / 2), 1, len(cells) - 1))
        todo += [cells[half:], cells[:half]]
    return first, parts


@dataclass(frozen=True)
class Cells:
    """Summaries of the cells that have rows, and of the groups of queries."""

    pivots: np.ndarray
    least: np.ndarray
    most: np.ndarray
    #: Distances to the pivot of the nearest k + 1 ids, and those ids, ascending; infinite where there are fewer.
    near: np.ndarray
    ids: np.ndarray
    #: Largest distance of a query to the pivot of its group.
    radius: np.ndarray
    slack: float
    k: int

    def kept(self, reach: np.ndarray, own: np.ndarray | None) -> np.ndarray:
        """For points of distances ``reach`` to all pivots: a distance within which k rows lie, of other ids than ``own``, or (None) than any one id."""
        row = np.arange(len(reach))
        first = np.argsort(reach + self.near[:, 0], axis=1, kind="stable")[:, : self.k + 1]
        far = (reach[row[:, None], first][:, :, None] + self.near[first]).reshape(len(reach), -1)
        ids = self.ids[first].reshape(len(reach), -1)
        if own is None:
            out = np.full(len(reach), np.inf)
            for i in row:
                # the nearest of each id, and one more than k of these, as one may be the query's own
                by = np.argsort(far[i], kind="stable")
                once = by[np.sort(np.unique(ids[i][by], return_index=True)[1])]
                if len(once) > self.k:
                    out[i] = far[i][once[self.k]]
            return out
        far = np.sort(np.where(ids == own[:, None], np.inf, far), axis=1)
        return far[:, self.k - 1] if far.shape[1] >= self.k else np.full(len(reach), np.inf)

    def needed(self, x: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For queries whether each cell may hold one of their k best, and the distance that these keep."""
        reach = distances(x, self.pivots)
        group = reach.argmin(1)
        groups, of = np.unique(group, return_inverse=True)
        between, radius = distances(self.pivots[groups], self.pivots), self.radius[groups][:, None]
        # of the group: every query is within the radius of its pivot
        bound = self.kept(between + radius, None)
        wanted = (between - radius - self.most[None] <= bound[:, None] + self.slack)[of]
        # of the query itself
        bound = np.minimum(self.kept(reach, ids), bound[of])
        nearest = reach[np.arange(len(x)), group][:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = np.where(between[of] > 0, (reach**2 - nearest**2) / (2 * between[of]), 0.0)
        beyond = np.maximum(np.maximum(reach - self.most[None], self.least[None] - reach), plane)
        return wanted & (beyond <= bound[:, None] + self.slack), bound + self.slack


def top_k(table: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows of ``table`` for each of its rows with ``is_query``."""
    spark = table.sparkSession
    ship(spark)
    rows = materialise(whole_vectors(table, is_query, id_column, vector, scale))
    lengths = [r[0] for r in rows.where("query").select(F.size("x")).distinct().collect()]
    parts = [_top_k_of_length(rows.where(F.size("x") == d), k) for d in sorted(lengths)]
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def _place(rows: DataFrame, sent, most: float | None) -> DataFrame:
    """id, g, r of each row of ``rows`` (id, x), as a row or (``most`` None) as a query: its nearest pivot and the distance to it."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, ids = as_matrix(b.column("x")).astype(np.float64), b.column("id").to_numpy()
            for part in in_parts(len(x), len(sent.value)):
                reach = distances(raised(x[part], most), sent.value)
                g = reach.argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(ids[part]), pa.array(g, pa.int32()), pa.array(reach[np.arange(len(g)), g])], names=["id", "g", "r"])

    return rows.select("id", "x").mapInArrow(place, "id long, g int, r double")


def cells_of(rows: DataFrame, k: int) -> tuple[Cells, np.ndarray, float]:
    """The summaries of ``rows`` (id, x, query), the cells' numbers of rows, and the largest squared norm. The driver
    receives k + 4 numbers for each pivot."""
    spark = rows.sparkSession
    squares = F.aggregate("x", F.lit(0.0), lambda total, c: total + c.cast("double") * c.cast("double"))
    about = rows.agg(F.count("*").alias("n"), F.max(squares).alias("most")).first()
    most = about["most"] * (1 + 1e-9)
    pivots = raised(choose_pivots(rows, min(MAX_PIVOTS, max(1, math.isqrt(about["n"])))), most)
    sent = spark.sparkContext.broadcast(pivots)
    placed = materialise(_place(rows, sent, most))
    sizes, radius = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
    ring = np.full((2, len(pivots)), [[np.inf], [-np.inf]])
    for r in placed.groupBy("g").agg(F.count("*").alias("n"), F.min("r").alias("a"), F.max("r").alias("z")).collect():
        sizes[r["g"]], ring[0, r["g"]], ring[1, r["g"]] = r["n"], r["a"], r["z"]
    # of an id that stands in a cell more than once its nearest, so that k others are left whichever id asks
    order = Window.partitionBy("g").orderBy("r", "id")
    ranked = placed.groupBy("g", "id").agg(F.min("r").alias("r")).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1)
    near, ids = np.full((len(pivots), k + 1), np.inf), np.zeros((len(pivots), k + 1), np.int64)
    found = ranked.toPandas()
    near[found["g"], found["_n"] - 1], ids[found["g"], found["_n"] - 1] = found["r"], found["id"]
    for r in _place(rows.where("query"), sent, None).groupBy("g").agg(F.max("r").alias("u")).collect():
        radius[r["g"]] = r["u"]
    return Cells(pivots, ring[0], ring[1], near, ids, radius, SLACK * math.sqrt(most) + SLACK**2 * most + SLACK, k), sizes, most


def routes(rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame, int]:
    """The rows and the queries with the bin of each (a query once for each bin it needs), and the number of places.

    Rows: at, id, x. Queries: at, id, x, least: the score that k others reach.
    """
    spark = rows.sparkSession
    cells, sizes, most = cells_of(rows, k)
    cores = max(spark.sparkContext.defaultParallelism, 1)
    first, parts = bins_of(cells.pivots, sizes, int(np.clip(-(-int(sizes.sum()) // (2 * cores)), LEAST_BIN, BIN)))
    n_bins = int((first + parts).max(initial=0))
    told = spark.sparkContext.broadcast((cells, first, parts))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, first, parts = told.value
        # the bins of each cell, one after the other
        cell = np.repeat(np.arange(len(first)), parts)
        bins = np.concatenate([np.arange(a, a + n) for a, n in zip(first, parts, strict=True)])
        by = np.argsort(bins, kind="stable")
        cell, starts = cell[by], np.searchsorted(bins[by], np.arange(n_bins))
        for b in batches:
            whole, ids = as_matrix(b.column("x")), b.column("id").to_numpy()
            for part in in_parts(len(ids), len(cells.pivots) + n_bins):
                x = whole[part].astype(np.float64)
                needed, bound = cells.needed(raised(x, None), ids[part])
                needed &= np.isfinite(cells.least)[None]
                q, to = np.nonzero(np.logical_or.reduceat(needed[:, cell], starts, axis=1))
                least = ((x**2).sum(1) + most - bound**2) / 2
                least = least - 1e-9 * np.abs(least) - 1.0
                at = pa.array(q + part.start)
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), b.column("id").take(at), b.column("x").take(at), pa.array(least[q])], names=["bin", "id", "x", "least"])

    asked = materialise(rows.where("query").select("id", "x").mapInArrow(ask, "bin int, id long, x array<long>, least double"))
    # a bin that many ask is copied; one that none asks stays where it is
    copies = np.zeros(n_bins, np.int64)
    for r in asked.groupBy("bin").count().collect():
        copies[r["bin"]] = -(-r["count"] // ASKED)
    place = np.concatenate([[0], np.cumsum(copies)])
    at_place = spark.sparkContext.broadcast((place, copies))

    @F.arrow_udf("int")
    def place_of(bins: pa.Array, ids: pa.Array) -> pa.Array:
        place, copies = at_place.value
        b = bins.to_numpy(zero_copy_only=False)
        return pa.array(place[b] + mix(ids.to_numpy(zero_copy_only=False).view(np.uint64)) % copies[b].astype(np.uint64), pa.int32())

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (cells, first, parts), (place, copies) = told.value, at_place.value
        for b in batches:
            x, ids = as_matrix(b.column("x")), b.column("id").to_numpy()
            for part in in_parts(len(ids), len(cells.pivots)):
                g = distances(raised(x[part].astype(np.float64), most), cells.pivots).argmin(1)
                own = first[g] + (mix(ids[part].view(np.uint64)) >> np.uint64(7)).astype(np.int64) % parts[g]
                at = np.repeat(np.arange(len(g)), copies[own])
                turn = np.arange(len(at)) - np.repeat(np.cumsum(copies[own]) - copies[own], copies[own])
                rows_ = pa.array(at + part.start)
                yield pa.RecordBatch.from_arrays([pa.array(place[own[at]] + turn, pa.int32()), b.column("id").take(rows_), b.column("x").take(rows_)], names=["at", "id", "x"])

    sent = rows.select("id", "x").mapInArrow(send, "at int, id long, x array<long>")
    return sent, asked.select(place_of("bin", "id").alias("at"), "id", "x", "least"), int(place[-1])


def _top_k_of_length(rows: DataFrame, k: int) -> DataFrame:
    sent, asked, places = routes(rows, k)
    # a place's rows, then its queries
    both = sent.select("at", F.lit(None).cast("double").alias("least"), "id", "x").unionByName(asked.select("at", "least", "id", "x"))
    both = both.repartitionById(max(places, 1), F.col("at")).sortWithinPartitions("at", F.col("least").asc_nulls_first())

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, here = None, [], None
        for b in batches:
            ids, x, places = b.column("id").to_numpy(), as_matrix(b.column("x")), b.column("at").to_numpy()
            asks, least = b.column("least").is_valid().to_numpy(zero_copy_only=False), b.column("least").to_numpy(zero_copy_only=False)
            edges = (np.flatnonzero((np.diff(places) != 0) | np.diff(asks)) + 1).tolist()
            for i, j in zip([0, *edges], [*edges, len(ids)], strict=True):
                if i < j and places[i] != at:
                    at, held, here = places[i], [], None
                if i < j and not asks[i]:
                    held.append((x[i:j], ids[i:j]))
                elif i < j:
                    if here is None:
                        v, vid = (np.concatenate(z) for z in zip(*held, strict=True)) if held else (np.zeros((0, x.shape[1]), np.int64), np.zeros(0, np.int64))
                        by, held = np.argsort(vid, kind="stable"), []
                        here = (v[by], v[by].astype(np.float64), float(np.abs(v).max(initial=0)), vid[by])
                    yield from best_of(x[i:j], ids[i:j], least[i:j], *here)

    def best_of(q: np.ndarray, qid: np.ndarray, least: np.ndarray, v: np.ndarray, v_float: np.ndarray, v_most: float, vid: np.ndarray) -> Iterator[pa.RecordBatch]:
        for part in in_parts(len(q), len(v)):
            query, row, score = [], [], []
            for own, me, floor in zip(products(q[part], v, v_float, v_most), qid[part], least[part], strict=True):
                there = np.flatnonzero((own >= floor) & (vid != me))
                if len(there) > k:  # rows are in the order of their ids
                    found = own[there]
                    edge = np.partition(found, len(found) - k)[len(found) - k]
                    over, ties = there[found > edge], there[found == edge]
                    there = np.concatenate([over, ties[: k - len(over)]])
                query.append(np.full(len(there), me)), row.append(vid[there]), score.append(own[there])
            join = lambda z: pa.array(np.concatenate(z), pa.int64())
            yield pa.RecordBatch.from_arrays([join(query), join(row), join(score)], names=["query_id", "vec_id", "score"])

    local = both.mapInArrow(solve, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
