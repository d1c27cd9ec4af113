"""The query surface: 1-NN, k-NN and axis-split k-NN joins, open or periodic."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinity import errors as E
from vicinity.functions.geometry import finish
from vicinity.operators.strategies import STRATEGIES, fits_broadcast, keep_k
from vicinity.sources.points import PointSet, bad, bad_array, from_numpy, normalised

BAD_QUERY = "InvalidInputData: a query coordinate is null, NaN or infinite"
#: A periodic query has 2**D images.
MOST_PERIODIC_DIMENSIONS = 10


class KnnEngine:
    """Exact nearest neighbours of a query table in a point set.

    Ties go to smaller ids; a query equal to a point finds it. Query ids are unique: rows of one id rank as one query's.
    """

    def __init__(self, points: PointSet, strategy: str = "auto", box: Sequence[float] | None = None) -> None:
        if strategy != "auto" and strategy not in STRATEGIES:
            raise ValueError(f"no strategy {strategy}")
        self.points, self.strategy, self.box = points, strategy, box

    def with_boxsize(self, box: Sequence[float]) -> KnnEngine:
        """The same points in a periodic box from 0 to the given lengths."""
        p = self.points
        if len(box) != p.dim or p.dim > MOST_PERIODIC_DIMENSIONS:
            raise E.InvalidBoxsize(f"{len(box)} lengths for {p.dim} dimensions; periodic ones are {MOST_PERIODIC_DIMENSIONS} at most")
        if any(math.copysign(1.0, float(lo)) < 0 for lo in p.lower):
            raise E.NegativeDataPeriodic("periodic data must not be negative")
        for side, up in zip(box, p.upper, strict=True):
            if float(up) > side:
                raise E.SmallBoxsize(f"data up to {up} in a box of {side}")
            if not math.isfinite(side):
                raise E.InvalidBoxsize(f"a box length is {side}")
        return KnnEngine(p, self.strategy, [float(x) for x in box])

    def _queries(self, df: DataFrame, id_col: str, coords) -> DataFrame:
        """(qid, c0, ...): a bad coordinate fails the job that reads it."""
        if isinstance(coords, str):  # an array is checked as a whole
            c, kind = F.col(coords), df.schema[coords].dataType
            wrong = F.when(F.size(c) != self.points.dim, F.raise_error("DimensionMismatch: a query of other dimensions").cast(kind))
            df = df.withColumn(coords, wrong.when(bad_array(c.cast(f"array<{self.points.dtype}>")), F.raise_error(BAD_QUERY).cast(kind)).otherwise(c))
        q, dim = normalised(df, id_col, coords, self.points.dtype, self.points.dim if isinstance(coords, str) else None, "qid")
        if dim != self.points.dim:
            raise E.DimensionMismatch(f"queries of {dim} dimensions, points of {self.points.dim}")
        for i in range(dim):
            c = F.col(f"c{i}")
            if isinstance(coords, str) and self.box is None:
                continue
            guarded = F.when(bad(c), F.raise_error(BAD_QUERY).cast(self.points.dtype))
            if self.box is not None:
                guarded = guarded.when((c < 0) | (c > self.box[i]), F.raise_error("QueryOutsideBox: a query lies beyond the periodic box").cast(self.points.dtype))
            q = q.withColumn(f"c{i}", guarded.otherwise(c))
        return q

    def _plan(self):
        if self.strategy != "auto":
            return STRATEGIES[self.strategy]
        p = self.points
        return STRATEGIES["arrow" if fits_broadcast(p) else "kdpart" if p.dim <= 8 else "blocked"]

    def _ranked(self, df, id_col, coords, k, axis=None) -> DataFrame:
        if k < 1:
            raise E.InvalidK("k is 1 at least")
        queries = self._queries(df, id_col, self.points.coords if coords is None else coords)
        pairs = self._plan()(self.points, queries, k, self.box, axis)
        if "rank" in pairs.columns:
            return pairs
        # a periodic join ranks (point, image) pairs: an id can repeat, and min(k, n) pairs are kept
        return keep_k(pairs, min(k, self.points.n))

    def _positions(self, out: DataFrame, by: str = "neighbor_id") -> DataFrame:
        p = self.points
        pos = p.frame.select(F.col("id").alias(by), F.array(*p.cols).alias("position"))
        return out.join(pos, by)

    def query_nearest(self, queries: DataFrame, id_col: str = "qid", coords=None, squared: bool = False, with_position: bool = False) -> DataFrame:
        """qid, neighbor_id, distance[, position] of each query's nearest point."""
        out = self.query_nearest_k(queries, 1, id_col, coords, squared, with_position)
        return out.drop("rank")

    def query_nearest_k(self, queries: DataFrame, k: int, id_col: str = "qid", coords=None, squared: bool = False, with_position: bool = False) -> DataFrame:
        """qid, rank, neighbor_id, distance[, position] of each query's min(k, n) nearest points."""
        near = self._ranked(queries, id_col, coords, k)
        out = near.select("qid", "rank", F.col("nid").alias("neighbor_id"), finish(F.col("d2"), squared, self.points.dtype).alias("distance"))
        return self._positions(out) if with_position else out

    query_nearest_k_parallel = query_nearest_k_parallel_with = query_nearest_k

    def query_nearest_k_axis(self, queries: DataFrame, k: int, axis: int, id_col: str = "qid", coords=None, squared: bool = False, with_index: bool = False, with_position: bool = False) -> DataFrame:
        """qid, rank, axis_distance, nonaxis_distance[, neighbor_id, position], ranked by full distance."""
        if not 0 <= axis < self.points.dim:
            raise E.InvalidAxis(f"axis {axis} of {self.points.dim}")
        near = self._ranked(queries, id_col, coords, k, axis)
        part = lambda c, name: finish(F.col(c), squared, self.points.dtype).alias(name)
        out = near.select("qid", "rank", part("ax", "axis_distance"), part("nonax", "nonaxis_distance"), F.col("nid").alias("neighbor_id"))
        out = self._positions(out) if with_position else out
        return out if with_index else out.drop("neighbor_id")

    query_nearest_k_parallel_axis = query_nearest_k_axis

    def query(self, queries: DataFrame, k: int | None = None, axis: int | None = None, id_col: str = "qid", coords=None) -> DataFrame:
        """k-NN, or axis-split k-NN if an axis is given."""
        if axis is not None:
            return self.query_nearest_k_axis(queries, 1 if k is None else k, axis, id_col, coords)
        return self.query_nearest_k(queries, 1 if k is None else k, id_col, coords)


def pack(result: DataFrame, cols: Sequence[str] = ("rank", "distance", "neighbor_id")) -> DataFrame:
    """qid and neighbors, an array of structs in order of rank."""
    return result.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("neighbors"))


class Tree:
    """Points of a numpy array with the query method of an in-memory index; results are numpy arrays in order of the queries."""

    dtype = "double"

    def __init__(self, spark: SparkSession, data: np.ndarray, leafsize: int = 32, par_split_level: int | None = None, boxsize: Sequence[float] | None = None, strategy: str = "auto") -> None:
        del par_split_level  # advisory: Spark's tasks are the threads
        self.spark, self.data, self.leafsize = spark, data, leafsize
        self.points = PointSet(from_numpy(spark, np.asarray(data)), "id", [f"c{i}" for i in range(np.asarray(data).shape[1])], self.dtype)
        self.engine = KnnEngine(self.points, strategy)
        if boxsize is not None:
            self.engine = self.engine.with_boxsize(boxsize)

    def size(self) -> int:
        return self.points.describe(self.leafsize)["tree_size"]

    def get_data(self) -> np.ndarray:
        return self.data

    def query(self, query: np.ndarray, k: int | None = None, axis: int | None = None):
        """(distances, ids), or (along the axis, across it): of shape (n,) for k of None or 1, else (n, k)."""
        q = from_numpy(self.spark, np.asarray(query)).withColumnRenamed("id", "qid")
        out = self.engine.query(q, k, axis, "qid", [f"c{i}" for i in range(np.asarray(query).shape[1])])
        rows = out.toPandas().sort_values(["qid", "rank"])
        width = min(1 if k is None else k, self.points.n)
        names = ("axis_distance", "nonaxis_distance") if axis is not None else ("distance", "neighbor_id")
        a, b = (rows[c].to_numpy().reshape(len(query), width) for c in names)
        return (a[:, 0], b[:, 0]) if axis is None and (k is None or k == 1) else (a, b)


class TreeF32(Tree):
    dtype = "float"


class TreeF64(Tree):
    dtype = "double"
