"""Nearest neighbours by a forest of random-projection trees with one priority queue, and exact reranking.

Every tree splits a bounded sample at medians of random projections, each
the direction between two sampled points, so its shape doesn't grow with the
table. All vectors are filed under one leaf a tree. A query descends all trees
with one priority queue over their branches, nearest splitting planes first,
until the leaves it has taken hold as many vectors as its budget; these are
ranked by exact distance in double precision.

The budget comes from the table: of CALIBRATE queries the true neighbours are
found by a pass over all vectors, and how far down its queue a query meets each
of them gives the recall of every budget; the least that reaches the wanted
recall is taken, whatever the size of the table, up to all of it.

Without a wanted recall the result is exact: the kth vector met within the
given budget bounds the true kth distance, and a scan compares every vector
with blocks of queries and keeps what lies within their bounds; its time
grows with the product of queries and vectors.

Equal vectors are indexed once, with the smallest ids a result can show, and
ask once, so a hot vector is one entry and one query. Vectors null, of another
length than most, zero, or holding null or non-finite components take no part:
neither as query nor as candidate. Ties go to smaller ids; of rows with one id
the least vector counts. With fewer other vectors than k all
are returned. An empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vicinity.llm.text import Scratch, shipped

#: The trees are fitted on so many vectors at most, the first by hash.
SAMPLE = 100_000
TREES = 16
#: Queries, the first by hash, on which the recall of budgets is measured; what a budget measured so is raised by.
CALIBRATE, MARGIN = 64, 1.1
#: Vectors that a query's leaves hold in sum, over all trees, copies included, before an exact search takes its bound.
SEARCH = 28_000
#: The distance of a query's BOUND_RANK * (k + 1)th neighbour among so many vectors of the sample bounds what its leaves pass on;
#: a query that gets too few so is searched exactly.
BOUND_SAMPLE, BOUND_RANK = 20_000, 3
#: Vectors a leaf holds on average.
LEAF = 128
#: Query vectors ranked against a leaf at a time.
QUERY_BLOCK = 256
#: Queries sent out for one scan of all vectors.
SCAN_QUERIES = 10_000


def rows_of(q: np.ndarray, p: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, vector and distance of the keep nearest of each query, ties beyond them too."""
    norm, out = (p * p).sum(1), []
    keep = min(keep, len(p))
    for i in range(0, len(q), QUERY_BLOCK):
        block = q[i : i + QUERY_BLOCK]
        rough = norm[None] - 2 * block @ p.T
        kth = np.partition(rough, keep - 1, axis=1)[:, keep - 1]
        slack = 1e-9 * (1 + np.abs(norm).max() + (block * block).sum(1))
        x, y = np.nonzero(rough <= (kth + slack)[:, None])
        out.append((i + x, y, np.sqrt(((block[x] - p[y]) ** 2).sum(1))))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


class Forest:
    """Splits of all trees: normals and offsets in heap order, and leaf counts."""

    def __init__(self, sample: np.ndarray, n: int, trees: int = TREES, leaf: int = LEAF, seed: int = 3) -> None:
        depth = 0
        while n / 2**depth > leaf and len(sample) / 2**depth > 8:
            depth += 1
        self.depth, self.trees = depth, trees
        rng = np.random.default_rng(seed)
        d = sample.shape[1]
        self.normal = np.zeros((trees, 2**depth - 1, d))
        self.offset = np.zeros((trees, 2**depth - 1))
        for t in range(trees):
            groups = [np.arange(len(sample))]
            for node in range(2**depth - 1):
                g = groups[node]
                v = rng.standard_normal(d)
                if len(g) >= 2:
                    a, b = sample[g[rng.choice(len(g), 2, replace=False)]]
                    if (a != b).any():
                        v = a - b
                v /= np.linalg.norm(v)
                x = sample[g] @ v
                self.normal[t, node] = v
                self.offset[t, node] = c = np.median(x) if len(g) else 0.0
                groups += [g[x < c], g[x >= c]]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf of every vector in every tree."""
        out = np.zeros((len(x), self.trees), np.int64)
        for i in range(0, len(x), 1024):
            part = x[i : i + 1024]
            for t in range(self.trees):
                node = np.zeros(len(part), np.int64)
                for _ in range(self.depth):
                    node = 2 * node + 1 + (np.einsum("nd,nd->n", self.normal[t, node], part) >= self.offset[t, node])
                out[i : i + 1024, t] = node - (2**self.depth - 1)
        return out

    def visit(self, q: np.ndarray, held: np.ndarray, search: int, wanted: np.ndarray | None = None) -> list[tuple[int, int]]:
        """The leaves (tree, leaf) a query takes. held: vectors of each tree's leaves.

        wanted: the leaves (vectors by trees) of certain vectors; then what the leaves hold up to the first of each, in its order.
        """
        inner = 2**self.depth - 1
        margin = (np.einsum("tnd,d->tn", self.normal, q) - self.offset).tolist()
        queue = [(0.0, t, 0) for t in range(self.trees)]  # distance to the farthest plane crossed
        heapq.heapify(queue)
        out, total, missing = [], 0, set(range(len(wanted))) if wanted is not None else set()
        while queue and total < search and (wanted is None or missing):
            far, t, node = heapq.heappop(queue)
            while node < inner:
                m = margin[t][node]
                near = 2 * node + 1 + (m >= 0)
                other = 4 * node + 3 - near
                heapq.heappush(queue, (max(far, abs(m)), t, other))
                node = near
            total += int(held[t, node - inner])
            if wanted is None:
                out.append((t, node - inner))
            else:
                met = [i for i in missing if wanted[i, t] == node - inner]
                out += [total] * len(met)
                missing.difference_update(met)
        return out


def within(q: np.ndarray, bound: np.ndarray, p: np.ndarray, reps: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, vector and distance of each query's nearest vectors up to its bound, keep at most; lowers bounds where keep are known."""
    norm = (p * p).sum(1)
    out = []
    for i in range(0, len(q), QUERY_BLOCK):
        block = q[i : i + QUERY_BLOCK]
        own = (block * block).sum(1)
        slack = 1e-9 * (1 + norm.max() + own)
        x, y = np.nonzero(norm[None] - 2 * block @ p.T <= (bound[i : i + QUERY_BLOCK] ** 2 - own + slack)[:, None])
        score = np.sqrt(((block[x] - p[y]) ** 2).sum(1))
        order = np.lexsort((reps[y], score, x))
        x, y, score = x[order], y[order], score[order]
        place = np.arange(len(x)) - np.searchsorted(x, x)
        last = place == keep - 1
        bound[i + x[last]] = np.minimum(bound[i + x[last]], score[last])
        ok = (place < keep) & (score <= bound[i + x])
        out.append((i + x[ok], y[ok], score[ok]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def valid_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id and v of the rows that take part, once an id."""
    kind = df.schema[vec_col].dataType.simpleString()
    v = F.col(vec_col) if kind in ("array<float>", "array<double>") else F.col(vec_col).cast("array<double>")
    ok = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = df.where(ok).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (sizes["d"] if sizes else 0)).groupBy("id").agg(F.min("v").alias("v"))


def _matrix(col) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False) if not isinstance(col, pa.ChunkedArray) else col.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1).astype(float)


def nearest(
    df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 100, k: int = 10, trees: int = TREES, search: int = SEARCH, leaf: int = LEAF, recall: float | None = None
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows of every row whose id is divisible by every.

    recall: the share of true neighbours wanted, measured on the table itself; None: all of them. search is the budget of an exact search.
    """
    with Scratch(df.sparkSession, "ann") as scratch:
        return _nearest(scratch, df, id_col, vec_col, every, k, trees, search, leaf, recall)


def _nearest(scratch: Scratch, df: DataFrame, id_col: str, vec_col: str, every: int, k: int, trees: int, search: int, leaf: int, recall: float | None) -> DataFrame:
    spark = df.sparkSession
    rows = scratch.save(valid_vectors(df, id_col, vec_col), "rows")
    # one entry for equal vectors: its k + 1 smallest ids answer any query
    first = Window.partitionBy("v").orderBy("id")
    ids = rows.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    points = scratch.save(ids.groupBy("v").agg(F.min("id").alias("rep"), F.sort_array(F.collect_list("id")).alias("ids")), "points", keep=True)
    n = points.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = _matrix(points.select("v").orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).toArrow().column("v"))
    forest = Forest(sample, n, trees, leaf)
    sent = shipped(spark, forest)
    kind = points.schema["v"].dataType.simpleString()

    def file(whole: bool):
        def work(batches):
            f = sent()
            for b in batches:
                if len(b):
                    at = f.leaves(_matrix(b.column(1)))
                    for t in range(f.trees):
                        cols = {"tree": pa.array(np.full(len(b), t), pa.int32()), "leaf": pa.array(at[:, t])} | ({"rep": b.column(0), "v": b.column(1)} if whole else {})
                        yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

        return points.select("rep", "v").mapInArrow(work, "tree int, leaf long" + f", rep long, v {kind}" * whole)

    held = np.zeros((trees, 2**forest.depth), np.int64)
    for r in file(False).groupBy("tree", "leaf").count().collect():  # trees times leaves, whatever n
        held[r["tree"], r["leaf"]] = r["count"]
    counts = spark.sparkContext.broadcast(held)
    # equal vectors ask once: the entries that hold a query
    asking = rows.where(F.col("id") % every == 0)
    queries = scratch.save(points.select("rep", "v").join(asking.select("v").distinct(), "v", "left_semi").select(F.col("rep").alias("q"), "v"), "queries")
    best = Window.partitionBy("q").orderBy("score", "rep")

    def scan(part: DataFrame, over: DataFrame, keep: int) -> DataFrame:
        """q, rep, score of the keep nearest vectors of some queries in every task, within their bounds."""
        ask = part.toArrow()
        asked = spark.sparkContext.broadcast((ask.column("q").to_numpy(), _matrix(ask.column("v")), ask.column("bound").to_numpy()))

        def work(batches):
            of, q, bound = asked.value
            bound = bound.copy()
            for b in batches:
                if len(b) and len(q):
                    reps = b.column(0).to_numpy()
                    x, y, score = within(q, bound, _matrix(b.column(1)), reps, keep)
                    yield pa.RecordBatch.from_arrays([pa.array(of[x]), pa.array(reps[y]), pa.array(score)], names=["q", "rep", "score"])

        return over.select("rep", "v").mapInArrow(work, "q long, rep long, score double")

    open_bound = F.lit(float("inf")).alias("bound")
    if recall is not None:
        some = queries.orderBy(F.xxhash64("q"), "q").limit(CALIBRATE).select("q", "v", open_bound)
        true = scan(some, points, k + 1).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).where("q != rep").select("q", "rep").join(points.select("rep", "v"), "rep").toArrow()
        asked = some.toArrow()
        needs: list[int] = []
        for i, v in zip(asked.column("q").to_pylist(), _matrix(asked.column("v")), strict=True):
            mine = true.filter(pc.equal(true.column("q"), i))
            if mine.num_rows:
                needs += forest.visit(v, held, trees * n, forest.leaves(_matrix(mine.column("v"))))
        needs.sort()
        search = int(MARGIN * needs[min(len(needs) - 1, int(len(needs) * recall))]) + 1 if needs else trees * n

    some_points = spark.sparkContext.broadcast(sample[:BOUND_SAMPLE])

    def route(batches):
        """The leaves of each query, and a bound of what they pass on."""
        near, nth = some_points.value, BOUND_RANK * (k + 1)
        for b in batches:
            q = _matrix(b.column(1)) if len(b) else []
            bound = np.full(len(q), np.inf)
            if len(q) and len(near) > nth:
                x, _, score = rows_of(q, near, nth)
                order = np.lexsort((score, x))
                bound = score[order][np.searchsorted(x[order], np.arange(len(q))) + nth - 1] * (1 + 1e-12)
            for i, v, far in zip(b.column(0), q, bound.tolist(), strict=True):
                got = sent().visit(v, counts.value, search)
                m = len(got)
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in got], pa.int32()), pa.array([x for _, x in got], pa.int64()), pa.array([i.as_py()] * m, pa.int64()), pa.array([far] * m)], names=["tree", "leaf", "q", "bound"])

    spread = max(8, spark.sparkContext.defaultParallelism)
    routed = scratch.save(queries.repartition(spread, "q").mapInArrow(route, "tree int, leaf long, q long, bound double"), "routed")
    ask = routed.join(queries, "q").select("tree", "leaf", "q", "bound", "v")

    def rank(of, to):
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if of.num_rows and to.num_rows:
            reps, asked = of.column("rep").to_numpy(), to.column("q").to_numpy()
            x, y, score = rows_of(_matrix(to.column("v")), _matrix(of.column("v")), k + 1)
            ok = score <= to.column("bound").to_numpy()[x]
            out = [asked[x[ok]], reps[y[ok]], score[ok]]
        return pa.table({"q": pa.array(out[0]), "rep": pa.array(out[1]), "score": pa.array(out[2])})

    near = file(True).groupBy("tree", "leaf").cogroup(ask.groupBy("tree", "leaf")).applyInArrow(rank, "q long, rep long, score double").distinct()
    near = near.withColumn("r", F.row_number().over(best))
    if recall is not None:
        near = scratch.save(near.where(F.col("r") <= k + 1).select("q", "rep", "score"), "near", keep=True)
        got = near.groupBy("q").count().where(F.col("count") >= min(k + 1, n)).select("q")
        short = scratch.save(queries.join(got, "q", "left_anti").withColumn("bound", open_bound), "short", keep=True)
        blocks = -(-short.count() // SCAN_QUERIES)
        for block in range(blocks):
            more = scan(short.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block), points, k + 1).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
            near = near if block else near.join(short.select("q"), "q", "left_anti")
            near = near.unionByName(scratch.save(more.select("q", "rep", "score"), "more", keep=True))
    else:
        seen = near.where(F.col("r") == k + 1).select("q", F.col("score").alias("bound"))
        bounded = scratch.save(queries.join(seen, "q", "left").withColumn("bound", F.coalesce("bound", open_bound)), "bounds")
        blocks = max(1, -(-bounded.count() // SCAN_QUERIES))
        over = points.select("rep", "v").repartition(spread, "rep")
        over = over if blocks == 1 else scratch.save(over, "spread")
        near = scan(bounded if blocks == 1 else bounded.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == 0), over, k + 1)
        for block in range(1, blocks):
            near = near.unionByName(scan(bounded.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block), over, k + 1))
        near = scratch.save(near.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).select("q", "rep", "score"), "near", keep=True)
    # each id of an asking entry gets the ids of the entries near it, less itself
    own = scratch.save(asking.join(points.select(F.col("rep").alias("q"), "v"), "v").select("q", F.col("id").alias("query_id")), "own", keep=True)
    pairs = near.join(points.select("rep", "ids"), "rep").groupBy("q").agg(F.sort_array(F.collect_list(F.struct("score", "rep", "ids"))).alias("near"))  # k + 1 entries
    flat = F.flatten(F.transform("near", lambda e: F.transform(e["ids"], lambda i: F.struct(e["score"].alias("score"), i.alias("vec_id")))))
    found = F.slice(F.filter(F.sort_array(flat), lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = own.join(pairs, "q").select("query_id", F.posexplode(found).alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), "x.vec_id", "x.score")
