"""Every strategy against brute force, errors, and the registered queries against DuckDB."""

import itertools
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinity import errors as E
from vicinity.engine import KnnEngine, Tree, TreeF32, TreeF64, pack
from vicinity.operators import strategies
from vicinity.plans import knn_queries
from vicinity.sources.points import PointSet, from_numpy, read_npy, tree_size, write_npy

SF = "/root/testdata/sf0.01"


def frames(spark, p, q):
    return from_numpy(spark, p), from_numpy(spark, q).withColumnRenamed("id", "qid")


def brute(p, q, k, box=None, axis=None):
    """(qid, rank, id, d2) with ties to smaller ids; every image counts."""
    out = []
    for i, x in enumerate(q):
        images = [x] if box is None else [np.array([(a + s if a < s / 2 else a - s) if m else a for a, s, m in zip(x, box, mask)], x.dtype) for mask in itertools.product((0, 1), repeat=len(x))]
        cand = []
        for y in images:
            for j, z in enumerate(p):
                parts = [(a - b) * (a - b) for a, b in zip(y, z)]
                if axis is None:
                    d = parts[0]
                    for t in parts[1:]:
                        d = d + t
                else:
                    rest = [t for n, t in enumerate(parts) if n != axis]
                    d = parts[axis] + (sum(rest[1:], rest[0]) if rest else 0)
                cand.append((d, j))
        out += [(i, r + 1, j, d) for r, (d, j) in enumerate(sorted(cand)[: min(k, len(p))])]
    return out


@pytest.mark.parametrize("strategy", ["sql", "arrow", "grid", "kdpart", "blocked"])
@pytest.mark.parametrize(("dim", "dtype", "periodic"), [(3, "double", False), (2, "double", True), (1, "double", False), (3, "float", True), (8, "double", False)])
def test_strategies_equal_brute_force(spark, strategy, dim, dtype, periodic, monkeypatch):
    if strategy == "grid" and dim > 3:
        pytest.skip("3**8 cells")
    monkeypatch.setattr(strategies, "CELL_POINTS", 16)
    monkeypatch.setattr(strategies, "BLOCK_POINTS", 24)
    rng = np.random.default_rng(dim + periodic)
    kind = np.float32 if dtype == "float" else np.float64
    p, q = rng.random((90, dim)).astype(kind), rng.random((25, dim)).astype(kind)
    p[40:50] = p[0]  # ties
    a, b = frames(spark, p, q)
    engine = KnnEngine(PointSet(a, "id", [f"c{i}" for i in range(dim)], dtype), strategy)
    box = [1.0, 1.25, 1.5][:dim] if periodic else None
    if box:
        engine = engine.with_boxsize(box)
    for k in (1, 7, 60) if dim < 3 else (7,):
        got = engine.query_nearest_k(b, k, "qid", [f"c{i}" for i in range(dim)], squared=True).collect()
        want = brute(p, q, k, box)
        assert sorted((r["qid"], r["rank"], r["neighbor_id"], r["distance"]) for r in got) == [(i, r, j, d) for i, r, j, d in want]


def test_axis_split(spark):
    rng = np.random.default_rng(4)
    p, q = rng.random((60, 3)), rng.random((10, 3))
    a, b = frames(spark, p, q)
    points = PointSet(a, "id", ["c0", "c1", "c2"])
    for strategy in ("sql", "arrow", "kdpart", "grid"):
        got = KnnEngine(points, strategy).query_nearest_k_axis(b, 5, 1, "qid", ["c0", "c1", "c2"], with_index=True).collect()
        assert len(got) == 50
        for r in got:
            x, y = q[r["qid"]], p[r["neighbor_id"]]
            assert abs(r["axis_distance"] - abs(x[1] - y[1])) < 1e-12
            assert abs(r["nonaxis_distance"] - np.hypot(x[0] - y[0], x[2] - y[2])) < 1e-12
        assert [(r["qid"], r["rank"], r["neighbor_id"]) for r in sorted(got, key=lambda r: (r["qid"], r["rank"]))] == [t[:3] for t in brute(p, q, 5, axis=1)]


def test_tree_like_facade(spark):
    p = np.array([[0.5, 0.1], [0.1, 0.3], [0.1, 0.3], [0.1, 0.3], [0.1, 0.3], [0.3, 0.4], [0.2, 0.9]])
    d, i = TreeF64(spark, p).query(np.array([[0.6, 0.1]]))
    assert i.tolist() == [0] and abs(d[0] - 0.1) < 1e-12
    d, i = TreeF32(spark, p.astype(np.float32)).query(np.array([[0.6, 0.1]], np.float32), k=9)
    assert d.shape == (1, 7) and d.dtype == np.float32
    t = Tree(spark, p, boxsize=[1.0, 1.0])
    a, b = t.query(np.array([[0.95, 0.5], [0.0, 0.0]]), k=2, axis=0)
    assert a.shape == b.shape == (2, 2) and t.get_data() is p


def test_tree_size():
    assert tree_size(65, 32) == 3 and tree_size(16, 16) == 1


def test_errors(spark):
    cols = ["c0", "c1"]
    p, q = frames(spark, np.random.default_rng(0).random((20, 2)), np.random.default_rng(1).random((5, 2)))
    engine = KnnEngine(PointSet(p, "id", cols))
    with pytest.raises(E.ZeroLengthInput):
        PointSet(p.limit(0), "id", cols)
    for x in (float("nan"), float("inf"), None):
        with pytest.raises(E.InvalidInputData):
            PointSet(p.withColumn("c1", F.when(F.col("id") == 3, F.lit(x)).otherwise(F.col("c1"))), "id", cols)
    with pytest.raises(E.SmallBoxsize):
        engine.with_boxsize([0.5, 1.0])
    with pytest.raises(E.InvalidBoxsize):
        engine.with_boxsize([float("inf"), 1.0])
    with pytest.raises(E.InvalidBoxsize):
        engine.with_boxsize([1.0])
    with pytest.raises(E.NegativeDataPeriodic):
        KnnEngine(PointSet(p.withColumn("c0", F.lit(-0.0)), "id", cols)).with_boxsize([1.0, 1.0])
    with pytest.raises(E.InvalidAxis):
        engine.query_nearest_k_axis(q, 1, 2, "qid", cols)
    with pytest.raises(E.InvalidK):
        engine.query_nearest_k(q, 0, "qid", cols)
    with pytest.raises(E.DimensionMismatch):
        engine.query_nearest_k(q, 1, "qid", ["c0"])
    for strategy in ("sql", "arrow", "kdpart", "grid"):
        bad = q.withColumn("c0", F.when(F.col("qid") == 2, F.lit(float("nan"))).otherwise(F.col("c0")))
        with pytest.raises(Exception, match="InvalidInputData"):
            KnnEngine(PointSet(p, "id", cols), strategy).query_nearest_k(bad, 1, "qid", cols).collect()
        with pytest.raises(Exception, match="QueryOutsideBox"):
            KnnEngine(PointSet(p, "id", cols), strategy).with_boxsize([1.0, 1.0]).query_nearest_k(q.withColumn("c0", F.lit(1.5)), 1, "qid", cols).collect()


def test_empty_queries_and_pack(spark):
    cols = ["c0", "c1"]
    p, q = frames(spark, np.random.default_rng(0).random((20, 2)), np.random.default_rng(1).random((5, 2)))
    for strategy in strategies.STRATEGIES:
        assert KnnEngine(PointSet(p, "id", cols), strategy).query_nearest_k(q.limit(0), 3, "qid", cols).count() == 0
    packed = pack(KnnEngine(PointSet(p, "id", cols)).query_nearest_k(q, 3, "qid", cols)).collect()
    assert len(packed) == 5 and all([n["rank"] for n in r["neighbors"]] == [1, 2, 3] for r in packed)


def test_streaming_queries(spark, tmp_path):
    from vicinity.streaming.knn import stream_nearest_k

    p, q = frames(spark, np.random.default_rng(0).random((50, 2)), np.random.default_rng(1).random((9, 2)))
    q.write.parquet(str(tmp_path / "in"))
    engine = KnnEngine(PointSet(p, "id", ["c0", "c1"]))
    got = []
    stream = stream_nearest_k(engine, spark.readStream.schema(q.schema).parquet(str(tmp_path / "in")), 2, lambda df, _: got.extend(df.collect()), "qid", ["c0", "c1"])
    run = stream.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted(got) == sorted(engine.query_nearest_k(q, 2, "qid", ["c0", "c1"]).collect())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", list(knn_queries.QUERIES))
def test_registered_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "events", "part", "nation"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = knn_queries.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = con.sql(f'SELECT {", ".join(cols)} FROM ({knn_queries.ORACLES[name]})').fetchall()
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_large_k_periodic_queries_are_over_all_rows(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    asked = events.where("event_id % 50 = 0").count()
    for name in ("knn_periodic_k80_2d", "knn_periodic_k80_3d"):
        got = knn_queries.QUERIES[name](spark, SF).collect()
        assert events.count() > 200 and len(got) == asked * 80
        assert max(r["neighbor_id"] for r in got) >= 200
    few = knn_queries.QUERIES["knn_periodic_large_k_images"](spark, SF).collect()
    assert len(few) == 25 * 25 and len({(r["qid"], r["neighbor_id"]) for r in few}) < len(few)


def test_image_pairs_repeat_ids(spark):
    """100 points, k of 80, three dimensions: the unit box."""
    rng = np.random.default_rng(21)
    p, q = rng.random((100, 3)), rng.random((40, 3))
    a, b = frames(spark, p, q)
    cols = ["c0", "c1", "c2"]
    want = brute(p, q, 80, [1.0, 1.0, 1.0])
    for strategy in ("arrow", "kdpart", "grid", "blocked"):
        got = KnnEngine(PointSet(a, "id", cols), strategy).with_boxsize([1.0, 1.0, 1.0]).query_nearest_k(b, 80, "qid", cols, squared=True).collect()
        assert sorted((r["qid"], r["rank"], r["neighbor_id"], r["distance"]) for r in got) == want
    assert len({(i, j) for i, _, j, _ in want}) < len(want)


@pytest.mark.parametrize("dim", [2, 3])
def test_split_cells_and_clustered_points(spark, dim, monkeypatch):
    """Most points in one place, many at one point, hot queries: cells are split on both sides, nothing is lost."""
    monkeypatch.setattr(strategies, "CELL_POINTS", 200)
    monkeypatch.setattr(strategies, "BLOCK_POINTS", 300)
    rng = np.random.default_rng(dim)
    p = np.concatenate([rng.normal(0.5, 0.001, (1500, dim)), rng.random((500, dim)), np.full((900, dim), 0.25)])
    q = np.concatenate([np.repeat(rng.random((1, dim)), 700, 0), rng.random((60, dim)), np.full((3, dim), 0.25)])
    a, b = frames(spark, p, q)
    cols = [f"c{i}" for i in range(dim)]
    for strategy in ("kdpart", "grid"):
        got = KnnEngine(PointSet(a, "id", cols), strategy).query_nearest_k(b, 4, "qid", cols, squared=True).toPandas().sort_values(["qid", "rank"])
        d2 = sum((q[:, None, i] - p[None, :, i]) ** 2 for i in range(dim))
        near = np.argsort(d2, axis=1, kind="stable")[:, :4]
        assert (got["neighbor_id"].to_numpy().reshape(-1, 4) == near).all()
        assert (got["distance"].to_numpy().reshape(-1, 4) == np.take_along_axis(d2, near, 1)).all()


def test_points_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(strategies, "BROADCAST_BYTES", 100)
    rng = np.random.default_rng(5)
    for dim in (2, 14):
        p, q = rng.random((120, dim)), rng.random((9, dim))
        a, b = frames(spark, p, q)
        cols = [f"c{i}" for i in range(dim)]
        want = [t[:3] for t in brute(p, q, 3)]
        for strategy in ("auto", "sql", "arrow", "blocked"):
            got = KnnEngine(PointSet(a, "id", cols), strategy).query_nearest_k(b, 3, "qid", cols)
            assert sorted((r["qid"], r["rank"], r["neighbor_id"]) for r in got.collect()) == want
            assert not any(x in got._jdf.queryExecution().toString() for x in ("CartesianProduct", "BroadcastNestedLoopJoin"))


def test_nested_loop_is_bounded(spark, monkeypatch):
    """Points beyond the loop's bound meet no query one by one, and the rows are the same."""
    rng = np.random.default_rng(41)
    p, q = rng.random((120, 3)), rng.random((9, 3))
    p[40:60] = p[0]
    a, b = frames(spark, p, q)
    cols = ["c0", "c1", "c2"]
    for most, loops in ((120, True), (119, False)):
        monkeypatch.setattr(strategies, "LOOP_POINTS", most, raising=False)
        got = KnnEngine(PointSet(a, "id", cols), "sql").query_nearest_k(b, 7, "qid", cols, squared=True)
        assert ("BroadcastNestedLoopJoin" in got._jdf.queryExecution().toString()) == loops
        assert sorted((r["qid"], r["rank"], r["neighbor_id"], r["distance"]) for r in got.collect()) == brute(p, q, 7)


def most_rows(df):
    """The rows of a query, and the most that a step of its plan gave."""
    rows, most, todo = df.collect(), 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if kind.endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        metric = node.metrics().get("numOutputRows")
        most = max(most, metric.get().value() if metric.isDefined() else 0)
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return rows, most


@pytest.mark.parametrize("dim", [2, 3])
def test_grid_makes_no_row_a_pair(spark, dim):
    """Dense points in a wide box: candidates are ranked where they are, a tile passes on k a query."""
    rng = np.random.default_rng(43)
    p = np.concatenate([rng.normal(0.5, 0.01, (3000, dim)), np.zeros((1, dim)), np.ones((1, dim))])
    p[100:200] = p[0]  # ties
    q = np.concatenate([p[:1], rng.normal(0.5, 0.01, (198, dim)), np.full((1, dim), 0.9)])
    a, b = frames(spark, p, q)
    cols = [f"c{i}" for i in range(dim)]
    got, most = most_rows(KnnEngine(PointSet(a, "id", cols), "grid").query_nearest_k(b, 5, "qid", cols, squared=True))
    d2 = sum((q[:, None, i] - p[None, :, i]) ** 2 for i in range(dim))
    near = np.argsort(d2, axis=1, kind="stable")[:, :5]
    assert sorted((r["qid"], r["rank"], r["neighbor_id"], r["distance"]) for r in got) == [(i, j + 1, n, d2[i, n]) for i, x in enumerate(near.tolist()) for j, n in enumerate(x)]
    assert most <= len(p) + 2**dim * 5 * len(q)


@pytest.mark.parametrize("periodic", [False, True])
def test_grid_of_tiles(spark, monkeypatch, periodic):
    """Many tiles, none too full: queries at their borders, beyond the data and in empty places find what brute force finds."""
    monkeypatch.setattr(strategies, "CELL_POINTS", 16)
    monkeypatch.setattr(strategies, "BLOCK_POINTS", 100)
    rng = np.random.default_rng(44)
    p, q = rng.random((400, 2)), rng.random((40, 2))
    p[:, 0] = np.where((p[:, 0] > 0.4) & (p[:, 0] < 0.6), p[:, 0] + 0.3, p[:, 0])
    q[:3] = p[:3]
    q = q if periodic else np.concatenate([q, [[-3.0, 0.5], [0.5, 1e300], [1.0, 1.0], [0.0, 0.0]]])
    a, b = frames(spark, p, q)
    engine = KnnEngine(PointSet(a, "id", ["c0", "c1"]), "grid")
    box = [1.0, 1.0] if periodic else None
    got = (engine.with_boxsize(box) if box else engine).query_nearest_k(b, 6, "qid", ["c0", "c1"], squared=True)
    assert "FlatMapCoGroupsInArrow" in got._jdf.queryExecution().toString()
    assert sorted((r["qid"], r["rank"], r["neighbor_id"], r["distance"]) for r in got.collect()) == brute(p, q, 6, box)


def test_npy_files_and_description(spark, tmp_path):
    p = np.random.default_rng(6).random((70, 2)).astype(np.float32)
    np.save(tmp_path / "p.npy", p)
    points = PointSet(read_npy(spark, str(tmp_path / "p.npy")), "id", ["c0", "c1"], "float")
    told = points.describe(32)
    assert (told["n"], told["dim"], told["dtype"], told["tree_size"]) == (70, 2, "float", tree_size(70, 32))
    assert np.allclose(told["lower"], p.min(0)) and np.allclose(told["upper"], p.max(0))
    out = KnnEngine(points).query_nearest_k(from_numpy(spark, p[:5]).withColumnRenamed("id", "qid"), 2, "qid", ["c0", "c1"])
    write_npy(out, str(tmp_path / "out.npy"), ["distance", "neighbor_id"], ["qid", "rank"])
    got = np.load(tmp_path / "out.npy")
    assert got.shape == (10, 2) and got[::2, 0].tolist() == [0.0] * 5 and got[::2, 1].tolist() == [0, 1, 2, 3, 4]
    with pytest.raises(E.DimensionMismatch):
        from_numpy(spark, p[0])


def test_array_columns(spark):
    """One array column as coordinates: checked whole, its box found when asked for."""
    rng = np.random.default_rng(31)
    p, q = rng.random((80, 5)), rng.random((6, 5))
    array = lambda x, name: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{name} long, v array<double>")
    points = PointSet(array(p, "id"), "id", "v")
    assert np.allclose(points.lower, p.min(0)) and np.allclose(points.upper, p.max(0))
    for box in (None, [1.0] * 5):
        engine = KnnEngine(points) if box is None else KnnEngine(points).with_boxsize(box)
        got = engine.query_nearest_k(array(q, "qid"), 3, squared=True).collect()
        assert sorted((r["qid"], r["rank"], r["neighbor_id"], r["distance"]) for r in got) == brute(p, q, 3, box)
    for wrong, error in (([1.0] * 4, "DimensionMismatch"), ([1.0] * 4 + [None], "InvalidInputData"), ([1.0] * 4 + [float("nan")], "InvalidInputData"), (None, "InvalidInputData")):
        bad = spark.createDataFrame([(0, wrong)], "qid long, v array<double>")
        with pytest.raises(Exception, match=error):
            KnnEngine(points).query_nearest_k(bad, 1).collect()
        with pytest.raises(E.DimensionMismatch if error == "DimensionMismatch" else E.InvalidInputData):
            PointSet(array(p, "id").unionByName(bad.withColumnRenamed("qid", "id")), "id", "v")
    with pytest.raises(E.InvalidInputData):  # too large for float
        PointSet(spark.createDataFrame([(0, [1e300, 1.0])], "id long, v array<double>"), "id", "v", "float")


def test_axis_query_needs_a_k(spark):
    a, b = frames(spark, np.random.default_rng(0).random((20, 2)), np.random.default_rng(1).random((5, 2)))
    engine = KnnEngine(PointSet(a, "id", ["c0", "c1"]))
    with pytest.raises(E.InvalidK):
        engine.query(b, 0, 1, "qid", ["c0", "c1"])
    assert engine.query(b, None, 1, "qid", ["c0", "c1"]).count() == 5


def test_plans(spark):
    """Narrow scans and partial limits."""
    plan = knn_queries.QUERIES["knn_sql_3d"](spark, SF)._jdf.queryExecution().toString() if os.path.isdir(SF) else "WindowGroupLimit"
    assert "WindowGroupLimit" in plan
