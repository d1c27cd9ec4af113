"""Point sets: data frames, numpy arrays and .npy files as validated points."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinity.errors import DimensionMismatch, InvalidInputData, ZeroLengthInput


def bad(c) -> object:
    """Whether a coordinate is null, NaN or infinite."""
    return c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))


def bad_array(c) -> object:
    """Whether an array of coordinates is null or holds a bad one."""
    return c.isNull() | F.exists(c, bad)


def normalised(df: DataFrame, id_col: str, coords: str | Sequence[str], dtype: str, dim: int | None = None, name: str = "id") -> tuple[DataFrame, int]:
    """(name, c0, c1, ...) of the given type, and the number of dimensions. coords: columns, or one array column."""
    if isinstance(coords, str):
        if dim is None:
            sizes = df.agg(F.min(F.size(coords)), F.max(F.size(coords))).first()
            if sizes[0] is None:
                raise ZeroLengthInput("no points")
            if sizes[0] != sizes[1] or sizes[0] < 1:
                raise DimensionMismatch(f"arrays of {sizes[0]} to {sizes[1]} elements")
            dim = sizes[0]
        cols = [F.get(F.col(coords), F.lit(i)).cast(dtype) for i in range(dim)]
    else:
        cols = [F.col(c).cast(dtype) for c in coords]
        dim = dim or len(cols)
        if len(cols) != dim:
            raise DimensionMismatch(f"{len(cols)} coordinates for {dim} dimensions")
    return df.select(F.col(id_col).alias(name), *[c.alias(f"c{i}") for i, c in enumerate(cols)]), dim


class PointSet:
    """Immutable points with explicit ids. One eager job checks them and gives their number and bounding box."""

    def __init__(self, df: DataFrame, id_col: str, coords: str | Sequence[str], dtype: str = "double") -> None:
        if dtype not in ("double", "float"):
            raise InvalidInputData(f"coordinates are double or float, not {dtype}")
        self.source, self.id_col, self.coords, self.dtype = df, id_col, coords, dtype
        self._bounds = None
        if isinstance(coords, str):
            c = F.col(coords)
            n, wrong, least, most = df.agg(F.count("*"), F.count_if(bad_array(c.cast(f"array<{dtype}>"))), F.min(F.size(c)), F.max(F.size(c))).first()
            if not n or most is None:
                raise ZeroLengthInput("no points")
            if least != most or least < 1:
                raise DimensionMismatch(f"arrays of {least} to {most} elements")
            self.frame, self.dim = normalised(df, id_col, coords, dtype, most)
            self.cols = [f"c{i}" for i in range(self.dim)]
        else:
            self.frame, self.dim = normalised(df, id_col, coords, dtype)
            self.cols = [f"c{i}" for i in range(self.dim)]
            any_bad = reduce(lambda x, y: x | y, [bad(F.col(c)) for c in self.cols])
            n, wrong, *bounds = self.frame.agg(F.count("*"), F.count_if(any_bad), *[f(c) for c in self.cols for f in (F.min, F.max)]).first()
            if not n:
                raise ZeroLengthInput("no points")
            self._bounds = bounds[::2], bounds[1::2]
        if wrong:
            raise InvalidInputData(f"{wrong} points have null, NaN or infinite coordinates")
        self.n = n

    def _box(self) -> tuple[list, list]:
        """Least and largest coordinates; those of an array column are found when asked for."""
        if self._bounds is None:
            found = self.source.select(F.posexplode(F.col(self.coords).cast(f"array<{self.dtype}>")).alias("i", "c")).groupBy("i").agg(F.min("c"), F.max("c")).collect()  # a row a dimension
            self._bounds = tuple([r[k] for r in sorted(found)] for k in (1, 2))
        return self._bounds

    @property
    def lower(self) -> list:
        return list(self._box()[0])

    @property
    def upper(self) -> list:
        return list(self._box()[1])

    def describe(self, leafsize: int = 32) -> dict:
        """Number, dimensions, bounds, and the size of the balanced tree over so many points."""
        return {"n": self.n, "dim": self.dim, "dtype": self.dtype, "lower": self.lower, "upper": self.upper, "height_hint": self.n.bit_length() - 1, "tree_size": tree_size(self.n, leafsize)}


def tree_size(n: int, leafsize: int) -> int:
    """Nodes of a tree that splits at the middle element until a leaf holds leafsize points or fewer."""
    return 1 if n <= leafsize else 1 + tree_size(n // 2, leafsize) + tree_size(n - n // 2 - 1, leafsize)


def from_numpy(spark: SparkSession, data: np.ndarray) -> DataFrame:
    """id (row number) and c0, c1, ... of a two-dimensional array of float32 or float64."""
    import pyarrow as pa

    if data.ndim != 2:
        raise DimensionMismatch("the array must have two dimensions")
    cols = {"id": pa.array(np.arange(len(data)))} | {f"c{i}": pa.array(np.ascontiguousarray(data[:, i])) for i in range(data.shape[1])}
    return spark.createDataFrame(pa.table(cols))


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """An .npy file of points, through Spark's reader, so any store that it reads will do."""
    import io

    (raw,) = spark.read.format("binaryFile").load(path).select("content").first()
    return from_numpy(spark, np.load(io.BytesIO(raw), allow_pickle=False))


def write_npy(result: DataFrame, path: str, cols: Sequence[str], order: Sequence[str]) -> None:
    """Small results as an .npy file on the driver's machine; larger ones belong in Parquet."""
    rows = result.orderBy(*order).select(*cols).toPandas()
    np.save(path, rows.to_numpy())
