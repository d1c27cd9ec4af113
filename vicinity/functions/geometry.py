"""Distances and boxes as Spark column expressions. Sums run over the dimensions in order, so results are reproducible to the bit."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _cols(p: Sequence) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in p]


def _square(x: Column) -> Column:
    return x * x


def squared_euclidean(a: Sequence, b: Sequence) -> Column:
    """Sum of squared differences of scalar columns."""
    return reduce(lambda s, t: s + t, [_square(x - y) for x, y in zip(_cols(a), _cols(b), strict=True)])


def squared_euclidean_axis(a: Sequence, b: Sequence, axis: int) -> tuple[Column, Column, Column]:
    """Total, share along the axis, share of the other dimensions."""
    parts = [_square(x - y) for x, y in zip(_cols(a), _cols(b), strict=True)]
    rest = [p for i, p in enumerate(parts) if i != axis]
    other = reduce(lambda s, t: s + t, rest) if rest else parts[0] * 0
    return parts[axis] + other, parts[axis], other


def squared_distance_to_box(q: Sequence, lower: Sequence, upper: Sequence) -> Column:
    """0 inside; else to the nearest point of the box."""
    near = [F.greatest(F.least(x, u), lo) for x, lo, u in zip(_cols(q), _cols(lower), _cols(upper), strict=True)]
    return squared_euclidean(q, near)


def nearest_side_squared(q: Sequence, box: Sequence[float]) -> list[Column]:
    """Squared distance to the nearer side of a periodic box, by dimension."""
    return [_square(F.least(F.lit(side) - x, x)) for x, side in zip(_cols(q), box, strict=True)]


def shifted(q: Column, side: float) -> Column:
    """The image of a coordinate beyond the nearer side."""
    side = F.lit(side)
    return F.when(q < side / 2, q + side).otherwise(q - side)


def finish(d2: Column, squared: bool = False, dtype: str = "double") -> Column:
    """Distance of a squared distance, in its own type."""
    return d2 if squared else F.sqrt(d2).cast(dtype)


def bounds(coords: Sequence[str]) -> list[Column]:
    """Aggregates of a bounding box: lower_i and upper_i."""
    return [f(c).alias(f"{n}_{i}") for i, c in enumerate(coords) for f, n in ((F.min, "lower"), (F.max, "upper"))]
