"""Physical strategies. All are exact and give (qid, nid, d2[, ax, nonax]): at least the k least of each query by (d2, nid).

One that gives rank too has exactly those.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vicinity.functions import geometry as G
from vicinity.operators.kernel import TREE_DIMENSIONS, LocalTree, as_arrow, coordinates, image_shifts, neighbours, top_k, worker_store

#: Points, or queries, that are broadcast at most, in bytes of coordinates and ids.
BROADCAST_BYTES = 32 << 20
#: Points that a nested loop compares with every query, at most.
LOOP_POINTS = 4096
#: Points of a cell on average, and points and queries that meet in one task at most; larger cells are split.
CELL_POINTS = 32_768
BLOCK_POINTS = 262_144
#: The cuts of kd cells come from so many points at most; beyond so many cells they grow with the data.
SAMPLE_POINTS = 200_000
MOST_CELLS = 65_536


def _schema(points, axis) -> str:
    t = points.dtype
    kind = points.frame.schema["id"].dataType.simpleString()
    return "qid {q}, nid " + kind + f", d2 {t}" + (f", ax {t}, nonax {t}" if axis is not None else "")


def images(queries: DataFrame, dim: int, box) -> DataFrame:
    """Queries with their 2**D - 1 images, by one explode a dimension."""
    if box is None:
        return queries
    for i in range(dim):
        c = F.col(f"c{i}")
        queries = queries.withColumn(f"c{i}", F.explode(F.array(c, G.shifted(c, box[i]).cast(queries.schema[f"c{i}"].dataType))))
    return queries


def keep_k(pairs: DataFrame, k: int) -> DataFrame:
    """The k least by (d2, nid) of each query, with their rank; partial limits run before the shuffle."""
    w = Window.partitionBy("qid").orderBy("d2", "nid")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _columns(points, axis):
    q, p = [F.col(f"q{i}") for i in range(points.dim)], [F.col(c) for c in points.cols]
    if axis is None:
        return [G.squared_euclidean(q, p).alias("d2")]
    return [c.alias(n) for c, n in zip(G.squared_euclidean_axis(q, p, axis), ("d2", "ax", "nonax"), strict=True)]


def _renamed(queries: DataFrame, dim: int) -> DataFrame:
    return queries.select("qid", *[F.col(f"c{i}").alias(f"q{i}") for i in range(dim)])


def fits_broadcast(points) -> bool:
    return points.n * (points.dim * (4 if points.dtype == "float" else 8) + 8) <= BROADCAST_BYTES


def sql(points, queries: DataFrame, k: int, box, axis) -> DataFrame:
    """Nested loop over broadcast points, whole in generated code; beyond LOOP_POINTS a tree of broadcast points, beyond the broadcast bound kd cells.

    All pairs of a loop grow with the square of a table that asks for its own neighbours, and are sorted.
    """
    if points.n > LOOP_POINTS or not fits_broadcast(points):
        return arrow(points, queries, k, box, axis)
    q = _renamed(images(queries, points.dim, box), points.dim)
    p = F.broadcast(points.frame.withColumnRenamed("id", "nid"))
    return q.join(p, F.lit(True)).select("qid", "nid", *_columns(points, axis))


def arrow(points, queries: DataFrame, k: int, box, axis) -> DataFrame:
    """Each task ranks its queries against broadcast points, by a tree or in few points or many dimensions one by one; beyond the bound, kd cells.

    No row moves: all images of a query are ranked where it is.
    """
    if not fits_broadcast(points):
        return kdpart(points, queries, k, box, axis)
    table = points.frame.orderBy("id").toArrow()  # within BROADCAST_BYTES
    sent = queries.sparkSession.sparkContext.broadcast((coordinates(table, points.dim, points.dtype), table.column("id").to_numpy()))
    dim, dtype, key = points.dim, points.dtype, uuid.uuid4().hex

    def work(batches):
        p, ids = sent.value
        tree = None
        if dim <= TREE_DIMENSIONS:
            store = worker_store()
            if store.get("key") != key:  # one tree a worker
                store |= {"key": key, "tree": LocalTree(p, ids, k)}
            tree = store["tree"]
        for b in batches:
            at, nid, *d = neighbours(coordinates(b, dim, dtype), p, ids, k, axis, box, tree)
            place = np.arange(len(at)) - np.searchsorted(at, at) + 1
            yield pa.RecordBatch.from_pydict(as_arrow(np.asarray(b.column(0))[at], nid, *d) | {"rank": pa.array(place.astype(np.int32))})

    kind = queries.schema["qid"].dataType.simpleString()
    return queries.mapInArrow(work, _schema(points, axis).format(q=kind) + ", rank int")


def blocked(points, queries: DataFrame, k: int, box, axis) -> DataFrame:
    """All queries against all points, for many dimensions, where nothing can be pruned.

    Queries are broadcast in blocks within the broadcast bound; each task passes its points by them and keeps k a query. No point moves.
    """
    q = images(queries, points.dim, box)
    dim, dtype = points.dim, points.dtype
    size = dim * (4 if dtype == "float" else 8) + 8
    blocks = max(1, -(-q.count() * size // BROADCAST_BYTES))
    none = np.zeros(0, np.float32 if dtype == "float" else np.float64)
    kind = queries.schema["qid"].dataType.simpleString()
    out = None
    for block in range(blocks):
        part = q if blocks == 1 else q.where(F.pmod(F.xxhash64(*[f"c{i}" for i in range(dim)]), F.lit(blocks)) == block)
        table = part.toArrow()  # about BROADCAST_BYTES
        sent = queries.sparkSession.sparkContext.broadcast((coordinates(table, dim, dtype), np.asarray(table.column("qid"))))

        def work(batches, sent=sent):
            asked, qid = sent.value
            best = (np.zeros(0, np.int64), np.zeros(0, np.int64), none, *((none, none) if axis is not None else (None, None)))
            for b in batches:
                if not len(b) or not len(asked):
                    continue
                ids = b.column(b.schema.get_field_index("id")).to_numpy()
                at, y, *d = top_k(asked, coordinates(b, dim, dtype), ids, k, axis)
                best = [np.concatenate(c) if c[0] is not None else None for c in zip(best, (at, ids[y], *d), strict=True)]
                by = np.lexsort((best[1], best[2], best[0]))
                by = by[np.arange(len(by)) - np.searchsorted(best[0][by], best[0][by]) < k]
                best = [c[by] if c is not None else None for c in best]
            if len(best[0]):
                yield pa.RecordBatch.from_pydict(as_arrow(qid[best[0]], *best[1:]))

        found = points.frame.mapInArrow(work, _schema(points, axis).format(q=kind))
        out = found if out is None else out.unionByName(found)
    return out


def _met(pt, qt, bound: np.ndarray, dim: int, dtype: str, k: int, axis):
    """Each query of a table with its k least of a table of points, within its bound: row of the query, id, d2, axis part, other part."""
    q, held = coordinates(qt, dim, dtype), coordinates(pt, dim, dtype)
    ids = pt.column("id").to_numpy() if pt.num_rows else np.zeros(0, np.int64)
    none = np.zeros(0, q.dtype)
    if not len(q) or not len(held):
        return np.zeros(0, np.int64), ids[:0], none, none, none
    if len(held) > 64 and dim <= TREE_DIMENSIONS:
        at, nid, d2, ax, rest = LocalTree(held, ids, k).query(q, axis, bound=bound)
    else:
        at, y, d2, ax, rest = top_k(q, held, ids, k, axis)
        nid = ids[y]
    ok = d2 <= bound[at]
    none = np.zeros(int(ok.sum()), q.dtype)
    return at[ok], nid[ok], d2[ok], none if ax is None else ax[ok], none if rest is None else rest[ok]


def grid(points, queries: DataFrame, k: int, box, axis, side: float | None = None) -> DataFrame:
    """Equal tiles, dealt in the JVM: a query meets the tiles within a reach of it, by a tree in every tile, and is done if k points are nearer than the reach.

    A tile gives k rows a query at most. Queries that aren't done, and data with tiles of more than BLOCK_POINTS points or queries at sides
    of twice the reach, go to broadcast points or kd cells. For few dimensions and even data.
    """
    rest = arrow if fits_broadcast(points) else kdpart
    dim, dtype, cols, n = points.dim, points.dtype, points.cols, points.n
    span = [max(float(u) - float(lo), 1e-300) for lo, u in zip(points.lower, points.upper, strict=True)]
    lower = [float(x) for x in points.lower]
    h = side or max(max(span) * 1e-6, float(np.prod(span) * 2 * k / n) ** (1 / dim))
    share = min(CELL_POINTS, max(CELL_POINTS // 16, n // (4 * queries.sparkSession.sparkContext.defaultParallelism))) / n
    wide = sorted(span, reverse=True)  # narrow data are cut along their long sides
    tile = max(2 * h, *[float(np.prod(wide[:i]) * share) ** (1 / i) for i in range(1, dim + 1)])
    names = [f"g{i}" for i in range(dim)]

    def place(c: str, i: int, shift: float):
        """The tile of a coordinate; beyond the data there is one on each side."""
        x = (F.col(c).cast("double") - lower[i] + shift) / tile
        return F.floor(F.least(F.greatest(x, F.lit(-1.0)), F.lit(span[i] / tile + 1))).cast("int")

    while True:
        p = points.frame.withColumns({names[i]: place(c, i, 0.0) for i, c in enumerate(cols)})
        most = p.groupBy(*names).count().agg(F.max("count")).first()[0]
        if most <= BLOCK_POINTS:
            break
        tile /= 2 ** max(1, int(np.log2(most / BLOCK_POINTS) / dim))
        if tile < 2 * h:
            return rest(points, queries, k, box, axis)
    asked = images(queries, dim, box)
    for i, c in enumerate(cols):
        asked = asked.withColumn(names[i], F.explode(F.sequence(place(c, i, -h), place(c, i, h))))
    if (asked.groupBy(*names).count().agg(F.max("count")).first()[0] or 0) > BLOCK_POINTS:
        return rest(points, queries, k, box, axis)
    keep, near = min(k, n), (h * (1 - (1e-5 if dtype == "float" else 1e-6))) ** 2

    def meet(pt, qt):
        at, *d = _met(pt, qt, np.full(qt.num_rows, near, np.float32 if dtype == "float" else np.float64), dim, dtype, k, axis)
        return pa.table(as_arrow(np.zeros(0), *d[:2], *(d[2:] if axis is not None else (None, None))) | {"qid": qt.column("qid").take(pa.array(at))})

    kind = queries.schema["qid"].dataType.simpleString()
    pairs = p.groupBy(*names).cogroup(asked.groupBy(*names)).applyInArrow(meet, _schema(points, axis).format(q=kind))
    found = keep_k(pairs, keep).withColumn("found", F.max("rank").over(Window.partitionBy("qid")))
    done = found.where(F.col("found") == keep).drop("found")
    left = queries.join(done.where(F.col("rank") == 1).select(F.col("qid").alias("sure")), F.col("qid").eqNullSafe(F.col("sure")), "left_anti")
    more = rest(points, left, k, box, axis)
    return done.unionByName(more if "rank" in more.columns else keep_k(more, keep))


class Cells:
    """Cuts at sampled medians, dimension by dimension, in heap order."""

    def __init__(self, sample: np.ndarray, depth: int) -> None:
        self.depth = depth
        self.cut = np.zeros(2**depth - 1)
        self.dim = np.zeros(2**depth - 1, np.int64)
        groups = [sample]
        for node in range(2**depth - 1):
            g = groups[node]
            d = int(np.argmax(g.max(0) - g.min(0))) if len(g) else 0
            self.dim[node] = d
            self.cut[node] = c = np.median(g[:, d]) if len(g) else 0.0
            groups += [g[g[:, d] < c], g[g[:, d] >= c]]

    def of(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[np.arange(len(x)), self.dim[node]] >= self.cut[node])
        return node - (2**self.depth - 1)


class CellBoxes:
    """Tight boxes of the cells and of the nodes above them; an empty cell is nowhere."""

    def __init__(self, depth: int, cell: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        low, high = np.full((2**depth, lo.shape[1]), np.inf), np.full((2**depth, lo.shape[1]), -np.inf)
        low[cell], high[cell] = lo, hi
        self.levels = [(low, high)]
        while len(low) > 1:
            low, high = np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2])
            self.levels.insert(0, (low, high))

    @staticmethod
    def _near(lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        return (np.maximum(np.maximum(lo - x, x - hi), 0) ** 2).sum(1)

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """A cell with points near each place."""
        node = np.zeros(len(x), np.int64)
        for lo, hi in self.levels[1:]:
            left, right = 2 * node, 2 * node + 1
            node = np.where(self._near(lo[right], hi[right], x) < self._near(lo[left], hi[left], x), right, left)
        return node

    def within(self, x: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and cells whose squared distance is reach at most."""
        of, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        for k, (lo, hi) in enumerate(self.levels):
            if k:
                of, node = np.repeat(of, 2), np.repeat(2 * node, 2)
                node[1::2] += 1
            near = self._near(lo[node], hi[node], x[of])
            ok = (near <= reach[of]) & np.isfinite(near)
            of, node = of[ok], node[ok]
        return of, node


def _mixed(x: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """A part below parts for each value, the same wherever it is computed."""
    h = np.array([zlib.crc32(repr(v).encode()) for v in x.tolist()], np.int64) if (parts > 1).any() else np.zeros(len(x), np.int64)
    return h % parts


def kdpart(points, queries: DataFrame, k: int, box, axis) -> DataFrame:
    """Balanced kd cells with tight boxes and a tree in every task.

    A query first meets the cell nearest to it; the kth distance found there tells which other cells, of which of its images, hold
    nearer points, and only those are visited. Cells with more than BLOCK_POINTS points or queries are split, so coincident ones
    don't make one task.
    """
    dim, dtype, cols, n = points.dim, points.dtype, points.cols, points.n
    depth, tasks = 0, 4 * queries.sparkSession.sparkContext.defaultParallelism
    while (n / 2**depth > CELL_POINTS or 2**depth < tasks and n / 2**depth > CELL_POINTS // 16) and 2 ** (depth + 1) <= MOST_CELLS:
        depth += 1
    sample = points.frame.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_POINTS) if n > SAMPLE_POINTS else points.frame
    cells = Cells(coordinates(sample.toArrow(), dim, "double"), depth)
    kinds, q_kind = points.frame.schema, queries.schema["qid"].dataType.simpleString()

    def assign(batches):
        for b in batches:
            at = cells.of(coordinates(b, dim, dtype).astype(float))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32))], names=[*b.schema.names, "cell"])

    described = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kinds)
    p = points.frame.mapInArrow(assign, described + ", cell int")
    found = sorted(p.groupBy("cell").agg(F.count("*"), *[f(c) for c in cols for f in (F.min, F.max)]).collect())  # MOST_CELLS rows at most
    number = np.array([b[0] for b in found], np.int64)
    boxes = CellBoxes(depth, number, np.array([b[2::2] for b in found], float), np.array([b[3::2] for b in found], float))
    p_parts = np.ones(2**depth, np.int64)
    p_parts[number] = [-(-b[1] // BLOCK_POINTS) for b in found]

    def home(batches):
        for b in batches:
            if len(b):
                at = boxes.nearest(coordinates(b, dim, dtype).astype(float))
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32))], names=["cell"])

    q_parts = np.ones(2**depth, np.int64)
    for r in queries.mapInArrow(home, "cell int").groupBy("cell").count().where(F.col("count") > BLOCK_POINTS).collect():
        q_parts[r["cell"]] = -(-r["count"] // BLOCK_POINTS)
    sent = queries.sparkSession.sparkContext.broadcast((p_parts, q_parts))

    def spread(at: np.ndarray, cell: np.ndarray, own: np.ndarray, parts: np.ndarray, others: np.ndarray):
        """Rows once for each part of the other side: row, its own part, the other's."""
        times = others[cell]
        row = np.repeat(np.arange(len(cell)), times)
        other = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        return at[row], cell[row], _mixed(own, parts[cell])[row], other

    def deal(batches):
        p_parts, q_parts = sent.value
        for b in batches:
            cell = b.column(b.schema.get_field_index("cell")).to_numpy().astype(np.int64)
            row, cell, x, y = spread(np.arange(len(b)), cell, b.column(0).to_numpy(zero_copy_only=False), p_parts, q_parts)
            yield pa.RecordBatch.from_arrays([*[c.take(pa.array(row)) for c in b.columns[:-1]], *[pa.array(v.astype(np.int32)) for v in (cell, x, y)]], names=[*b.schema.names[:-1], "cell", "x", "y"])

    dealt = p.mapInArrow(deal, described + ", cell int, x int, y int")
    # what travels to a cell: places that ask, with the squared distance that counts (kind 0: what is at the place itself; 1: beyond), or what was found (kind 2)
    some = f"qid {q_kind}, {', '.join(f'{c} {dtype}' for c in cols)}, bound {dtype}, cell int, x int, y int"

    def ask(qid, x: np.ndarray, bound: np.ndarray, cell: np.ndarray):
        p_parts, q_parts = sent.value
        row, cell, own, other = spread(np.arange(len(x)), cell, np.asarray(qid), q_parts, p_parts)
        return pa.RecordBatch.from_arrays([qid.take(pa.array(row)), *[pa.array(x[row, i]) for i in range(dim)], pa.array(bound[row]), *[pa.array(v.astype(np.int32)) for v in (cell, other, own)]], names=["qid", *cols, "bound", "cell", "x", "y"])

    kind = np.float32 if dtype == "float" else np.float64

    def first(batches):
        for b in batches:
            if len(b):
                x = coordinates(b, dim, dtype)
                yield ask(b.column(0), x, np.full(len(x), np.inf, kind), boxes.nearest(x.astype(float)))

    values = f"nid {kinds['id'].dataType.simpleString()}, d2 {dtype}, ax {dtype}, nonax {dtype}"
    first_schema = some + ", done array<struct<" + values.replace(" ", ":").replace(",:", ", ") + ">>"

    def meet(pt, qt):
        """Each query with what its cell holds for it."""
        return _met(pt, qt, np.asarray(qt.column("bound")), dim, dtype, k, axis)

    def nearby(pt, qt):
        """The queries of a cell with their neighbours there, in order."""
        at, *d = meet(pt, qt)
        cut = np.searchsorted(at, np.arange(qt.num_rows + 1))
        done = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.StructArray.from_arrays([pa.array(c) for c in d], ["nid", "d2", "ax", "nonax"]))
        return qt.append_column("done", done)

    asked = queries.mapInArrow(first, some)
    met = dealt.groupBy("cell", "x", "y").cogroup(asked.groupBy("cell", "x", "y")).applyInArrow(nearby, first_schema)
    keep = min(k, n)

    def route(batches):
        """What was found, and the visits to other cells."""
        for b in batches:
            if not len(b):
                continue
            x, done = coordinates(b, dim, dtype), b.column(b.schema.get_field_index("done"))
            size = np.diff(done.offsets.to_numpy())
            v = done.flatten()
            d2 = v.field(1).to_numpy()
            bound = np.full(len(x), np.inf, kind)
            ends = np.cumsum(size)
            bound[size >= keep] = d2[ends[size >= keep] - 1]
            home_cell = b.column(b.schema.get_field_index("cell")).to_numpy()
            # a query of a split cell was sent to all its parts; one of them sends it on
            lead = b.column(b.schema.get_field_index("x")).to_numpy() == 0
            row = np.repeat(np.arange(len(x)), size)
            yield rows_of(b.column(0).take(pa.array(row)), v)
            slack = bound.astype(float) * (1 + (1e-5 if dtype == "float" else 1e-9))
            for m, place in enumerate(image_shifts(x, box) if box is not None else [x]):
                at, cell = boxes.within(place.astype(float), slack)
                ok = lead[at] & ((cell != home_cell[at]) | (m > 0))
                at, cell = at[ok], cell[ok]
                if len(at):
                    visits = ask(b.column(0).take(pa.array(at)), place[at], bound[at], cell)
                    yield pa.RecordBatch.from_arrays([*visits.columns, *[pa.nulls(len(visits), f.type) for f in v.type]], names=[*visits.schema.names, *row_names])

    row_names = ["nid", "d2", "ax", "nonax"]

    def rows_of(qid, v):
        n = len(qid)
        where = 1 + np.arange(n, dtype=np.int32) % 4096  # anywhere but at a cell
        nulls = [pa.nulls(n, v.type[1].type)] * (dim + 1)
        return pa.RecordBatch.from_arrays([qid, *nulls, pa.array(-where), pa.array(np.zeros(n, np.int32)), pa.array(np.zeros(n, np.int32)), *[v.field(i) for i in range(4)]], names=["qid", *cols, "bound", "cell", "x", "y", *row_names])

    routed = met.mapInArrow(route, some + ", " + values)

    def finish(pt, qt):
        names = ["qid", *row_names]
        if not pt.num_rows or not qt.num_rows:
            return qt.select(names).filter(pc.is_valid(qt.column("nid")))
        at, *d = meet(pt, qt)
        return pa.table([qt.column("qid").take(pa.array(at)), *[pa.array(c, qt.schema.field(f).type) for c, f in zip(d, row_names, strict=True)]], names=names)

    out = dealt.groupBy("cell", "x", "y").cogroup(routed.groupBy("cell", "x", "y")).applyInArrow(finish, f"qid {q_kind}, " + values)
    return out if axis is not None else out.drop("ax", "nonax")


STRATEGIES = {"sql": sql, "arrow": arrow, "grid": grid, "kdpart": kdpart, "blocked": blocked}
