"""The exact top-k kernels over blocks of points, in numpy: brute force, and a tree that many queries descend at a time."""

from __future__ import annotations

import itertools
import sys
import types

import numpy as np
import pyarrow as pa

#: Elements of one distance matrix.
CELLS = 1 << 21
#: Points of a leaf at most, queries that descend together, and dimensions from which no tree is built.
LEAF_POINTS = 16
QUERIES = 1 << 13
TREE_DIMENSIONS = 12


def worker_store() -> dict:
    """A dictionary that lives as long as the Python worker, across its tasks."""
    mod = sys.modules.setdefault("_vicinity_core_store", types.ModuleType("_vicinity_core_store"))
    return mod.__dict__.setdefault("store", {})


def image_shifts(q: np.ndarray, box: list[float]) -> list[np.ndarray]:
    """The queries and their 2**D - 1 images beyond nearer sides."""
    side = np.array(box, q.dtype)
    moved = np.where(q < side / 2, q + side, q - side)
    return [np.where(np.array(mask), moved, q) for mask in itertools.product((False, True), repeat=q.shape[1])]


def squared(q: np.ndarray, p: np.ndarray, axis: int | None):
    """Squared distances, summed by dimension in order; with an axis also its share and the rest's."""
    total = ax = None
    for i in range(q.shape[1]):
        d = q[:, i, None] - p[None, :, i]
        d *= d
        if i == axis:
            ax = d
        else:
            total = d if total is None else total + d
    if axis is None:
        return total, None, None
    total = np.zeros_like(ax) if total is None else total
    return ax + total, ax, total


def top_k(q: np.ndarray, p: np.ndarray, ids: np.ndarray, k: int, axis: int | None = None):
    """Rows (query index, point index, d2, axis part, other part): the k least by (d2, id) of each query, in order."""
    out = []
    step = max(1, CELLS // max(1, len(p)))
    for a in range(0, len(q), step):
        d2, ax, rest = squared(q[a : a + step], p, axis)
        if len(p) > k:
            kth = np.partition(d2, k - 1, axis=1)[:, k - 1 : k]
            x, y = np.nonzero(d2 <= kth)
        else:
            x, y = (v.reshape(-1) for v in np.indices(d2.shape))
        by = np.lexsort((ids[y], d2[x, y], x))
        x, y = x[by], y[by]
        place = np.arange(len(x)) - np.searchsorted(x, x)
        x, y = x[place < k], y[place < k]
        out.append((x + a, y, d2[x, y], ax[x, y] if ax is not None else None, rest[x, y] if rest is not None else None))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, p.dtype), None, None
    return tuple(np.concatenate(v) if v[0] is not None else None for v in zip(*out, strict=True))


def _rows_squared(q: np.ndarray, p: np.ndarray, axis: int | None):
    """squared() of each query (n, D) with its own points (n, w, D)."""
    total = ax = None
    for i in range(q.shape[1]):
        d = q[:, i, None] - p[:, :, i]
        d *= d
        if i == axis:
            ax = d
        else:
            total = d if total is None else total + d
    if axis is None:
        return total, None, None
    total = np.zeros_like(ax) if total is None else total
    return ax + total, ax, total


class LocalTree:
    """A balanced tree over a block of points with tight boxes, for k neighbours of many queries at a time.

    Of points at one place only the k of smallest ids are kept, as no result shows more.
    """

    def __init__(self, p: np.ndarray, ids: np.ndarray, k: int) -> None:
        by = np.lexsort((ids, *p.T))
        p, ids = p[by], ids[by]
        if len(p) > k:
            new = np.concatenate([[True], (p[1:] != p[:-1]).any(1)])
            start = np.flatnonzero(new)
            keep = np.arange(len(p)) - np.repeat(start, np.diff(np.append(start, len(p)))) < k
            p, ids = p[keep], ids[keep]
        n = len(p)
        x = p.astype(float)
        self.depth = max(0, int(np.ceil(np.log2(max(n, 1) / LEAF_POINTS))))
        order, starts = np.arange(n), np.array([0, n])
        for _ in range(self.depth):
            here, count = x[order], np.diff(starts)
            dim = np.argmax(np.maximum.reduceat(here, starts[:-1]) - np.minimum.reduceat(here, starts[:-1]), axis=1)
            group = np.repeat(np.arange(len(count)), count)
            order = order[np.lexsort((here[np.arange(n), dim[group]], group))]
            starts = np.sort(np.concatenate([starts, starts[:-1] + count // 2]))
        self.points, self.ids, self.starts, self.k = p[order], ids[order], starts, min(k, n)
        x = x[order]
        self.boxes = [(np.minimum.reduceat(x, starts[:-1]), np.maximum.reduceat(x, starts[:-1]))] if n else []
        for _ in range(self.depth):
            lo, hi = self.boxes[0]
            self.boxes.insert(0, (np.minimum(lo[::2], lo[1::2]), np.maximum(hi[::2], hi[1::2])))

    def _near(self, level: int, node: np.ndarray, q: np.ndarray) -> np.ndarray:
        lo, hi = self.boxes[level]
        out = np.zeros(len(node))
        for i in range(q.shape[1]):
            d = np.maximum(np.maximum(lo[node, i] - q[:, i], q[:, i] - hi[node, i]), 0)
            out += d * d
        return out

    def _gather(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of the points under nodes of a level, side by side, and which of them count."""
        shift = self.depth - level
        a, z = self.starts[node << shift], self.starts[(node + 1) << shift]
        at = a[:, None] + np.arange(int((z - a).max()))
        return np.minimum(at, len(self.points) - 1), at < z[:, None]

    def bounds(self, q: np.ndarray, axis: int | None) -> np.ndarray:
        """Of each query the squared distance of the kth of the points nearby: the kth of all is no farther."""
        level = self.depth
        while level and (len(self.points) >> level) < self.k:
            level -= 1
        node, x = np.zeros(len(q), np.int64), q.astype(float)
        for i in range(1, level + 1):
            left, right = 2 * node, 2 * node + 1
            node = np.where(self._near(i, right, x) < self._near(i, left, x), right, left)
        out = np.zeros(len(q), q.dtype)
        step = max(1, CELLS // max(1, self.k + LEAF_POINTS) // 4)
        for a in range(0, len(q), step):
            at, some = self._gather(level, node[a : a + step])
            d2 = _rows_squared(q[a : a + step], self.points[at], axis)[0]
            d2[~some] = np.inf
            out[a : a + step] = np.partition(d2, self.k - 1, axis=1)[:, self.k - 1]
        return out

    def query(self, q: np.ndarray, axis: int | None = None, images: list[np.ndarray] | None = None, bound: np.ndarray | None = None):
        """top_k() of the points; images: further places of each query, whose pairs rank with its own; bound: known squared distances of the kth."""
        out = []
        for a in range(0, len(q), QUERIES):
            part = slice(a, a + QUERIES)
            reach = self.bounds(q[part], axis)
            if bound is not None:
                reach = np.minimum(reach, bound[part])
            rows = [self._within(x[part], reach, axis) for x in [q, *(images or [])]]
            x, y, d2, ax, rest = (np.concatenate(c) if c[0] is not None else None for c in zip(*rows, strict=True))
            by = np.lexsort((self.ids[y], d2, x))
            by = by[np.arange(len(by)) - np.searchsorted(x[by], x[by]) < self.k]
            out.append((x[by] + a, self.ids[y[by]], d2[by], ax[by] if axis is not None else None, rest[by] if axis is not None else None))
        return tuple(np.concatenate(c) if c[0] is not None else None for c in zip(*out, strict=True))

    def _within(self, q: np.ndarray, reach: np.ndarray, axis: int | None):
        x = q.astype(float)
        slack = reach.astype(float) * (1 + (1e-5 if q.dtype == np.float32 else 1e-9))
        of, node = np.arange(len(q)), np.zeros(len(q), np.int64)
        for level in range(self.depth + 1):
            if level:
                of, node = np.repeat(of, 2), np.repeat(2 * node, 2)
                node[1::2] += 1
            ok = self._near(level, node, x[of]) <= slack[of]
            of, node = of[ok], node[ok]
        out = []
        step = max(1, CELLS // (LEAF_POINTS * 2))
        for a in range(0, max(1, len(of)), step):
            i = of[a : a + step]
            if not len(i):
                none = np.zeros(0, q.dtype)
                out.append((np.zeros(0, np.int64), np.zeros(0, np.int64), none, none if axis is not None else None, none if axis is not None else None))
                continue
            at, some = self._gather(self.depth, node[a : a + step])
            d2, ax, rest = _rows_squared(q[i], self.points[at], axis)
            r, c = np.nonzero(some & (d2 <= reach[i][:, None]))
            out.append((i[r], at[r, c], d2[r, c], ax[r, c] if axis is not None else None, rest[r, c] if axis is not None else None))
        return tuple(np.concatenate(c) if c[0] is not None else None for c in zip(*out, strict=True))


def neighbours(q: np.ndarray, p: np.ndarray, ids: np.ndarray, k: int, axis: int | None = None, box: list[float] | None = None, tree: LocalTree | None = None):
    """Rows (query index, id, d2, axis part, other part): the min(k, n) least by (d2, id) of each query, over its images too if there is a box, in order."""
    images = image_shifts(q, box)[1:] if box is not None else []
    if len(q) and len(p) > 4 * LEAF_POINTS and p.shape[1] <= TREE_DIMENSIONS:
        return (tree or LocalTree(p, ids, k)).query(q, axis, images)
    rows = [(i, ids[y], *d) for i, y, *d in (top_k(x, p, ids, k, axis) for x in [q, *images])]
    if not images:
        return rows[0]
    x, nid, *d = (np.concatenate(c) if c[0] is not None else None for c in zip(*rows, strict=True))
    by = np.lexsort((nid, d[0], x))
    by = by[np.arange(len(by)) - np.searchsorted(x[by], x[by]) < min(k, len(p))]
    return x[by], nid[by], *(c[by] if c is not None else None for c in d)


def coordinates(table, dim: int, dtype: str) -> np.ndarray:
    """A row-major matrix of the columns c0, c1, ..."""
    kind = np.float32 if dtype == "float" else np.float64
    cols = [np.asarray(table.column(table.schema.get_field_index(f"c{i}")), kind) for i in range(dim)]
    return np.stack(cols, 1) if len(table) else np.zeros((0, dim), kind)


def as_arrow(qid, nid, d2, ax, rest) -> dict:
    cols = {"qid": pa.array(qid), "nid": pa.array(nid), "d2": pa.array(d2)}
    if ax is not None:
        cols |= {"ax": pa.array(ax), "nonax": pa.array(rest)}
    return cols
