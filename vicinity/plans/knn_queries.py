"""Registered nearest-neighbour queries over the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinity.engine import KnnEngine, pack
from vicinity.functions import geometry as G
from vicinity.sources.points import PointSet

DAY = 86_400_000_000
BOX2 = [86_400.0, 1000.0]
BOX3 = [86_400.0, 1000.0, 1_000_000.0]
BOXN = [30.0, 6.0]
XYZ = ["x", "y", "z"]
XY = ["x", "y"]
#: Searches ask with every row whose id this divides, against all rows.
EVERY = 50


def _emb3(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e.select("vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(XYZ)])


def _ev3(spark: SparkSession, d: str) -> DataFrame:
    """Events by time of day, value (a negative zero counts as zero) and user."""
    e = spark.read.parquet(f"{d}/events.parquet")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select("event_id", ((micros % DAY) / F.lit(1e6)).alias("x"), (F.col("value") + F.lit(0.0)).alias("y"), F.col("user_id").cast("double").alias("z"))


def _ev2(spark: SparkSession, d: str) -> DataFrame:
    return _ev3(spark, d).drop("z")


def _nation(spark: SparkSession, d: str) -> DataFrame:
    n = spark.read.parquet(f"{d}/nation.parquet")
    return n.select("n_nationkey", F.col("n_nationkey").cast("double").alias("x"), F.col("n_regionkey").cast("double").alias("y"))


def _asking(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key) % EVERY == 0)


def _emb_engine(spark, d, strategy="auto"):
    p = _emb3(spark, d)
    return KnnEngine(PointSet(p, "vec_id", XYZ), strategy), _asking(p, "vec_id")


def _ev_engine(spark, d, strategy="auto", periodic=False):
    p = _ev2(spark, d)
    engine = KnnEngine(PointSet(p, "event_id", XY), strategy)
    return (engine.with_boxsize(BOX2) if periodic else engine), _asking(p, "event_id")


def nn1_3d(spark, d):
    e, q = _emb_engine(spark, d)
    return e.query_nearest(q, "vec_id")


def nn1_3d_squared(spark, d):
    e, q = _emb_engine(spark, d)
    return e.query_nearest(q, "vec_id", squared=True)


def nn1_position(spark, d):
    e, q = _emb_engine(spark, d)
    out = e.query_nearest(q, "vec_id", with_position=True)
    return out.select("qid", "neighbor_id", "distance", *[F.get("position", F.lit(i)).alias(f"position_{c}") for i, c in enumerate(XYZ)])


def nn1_periodic_2d(spark, d):
    e, q = _ev_engine(spark, d, periodic=True)
    return e.query_nearest(q, "event_id")


def _knn3(strategy):
    def run(spark, d):
        e, q = _emb_engine(spark, d, strategy)
        return e.query_nearest_k(q, 10, "vec_id")

    return run


def _knn2(strategy):
    def run(spark, d):
        e, q = _ev_engine(spark, d, strategy)
        return e.query_nearest_k(q, 10, "event_id")

    return run


def knn_f32_64d(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    engine = KnnEngine(PointSet(e, "vec_id", "embedding", "float"))
    return engine.query_nearest_k(_asking(e, "vec_id"), 5, "vec_id")


def knn_blocked_64d(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    engine = KnnEngine(PointSet(e, "vec_id", "embedding", "float"), "blocked")
    return engine.query_nearest_k(_asking(e, "vec_id"), 5, "vec_id")


def knn_k_gt_n(spark, d):
    p = _nation(spark, d)
    return KnnEngine(PointSet(p, "n_nationkey", XY)).query_nearest_k(p, 50, "n_nationkey")


def knn_packed(spark, d):
    e, q = _emb_engine(spark, d)
    packed = pack(e.query_nearest_k(q, 10, "vec_id"))
    return packed.select("qid", F.posexplode("neighbors").alias("position", "n")).select("qid", (F.col("position") + 1).alias("rank"), "n.neighbor_id", "n.distance")


def knn_ties_2d(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    return KnnEngine(PointSet(p, "p_partkey", XY)).query_nearest_k(_asking(p, "p_partkey"), 10, "p_partkey")


def knn_periodic_2d(spark, d):
    e, q = _ev_engine(spark, d, periodic=True)
    return e.query_nearest_k(q, 10, "event_id")


def knn_periodic_k80_2d(spark, d):
    e, q = _ev_engine(spark, d, periodic=True)
    return e.query_nearest_k(q, 80, "event_id")


def _ev3_periodic(k, strategy="auto"):
    def run(spark, d):
        p = _ev3(spark, d)
        engine = KnnEngine(PointSet(p, "event_id", XYZ), strategy).with_boxsize(BOX3)
        return engine.query_nearest_k(_asking(p, "event_id"), k, "event_id")

    return run


def knn_periodic_large_k_images(spark, d):
    """As many neighbours as points: images of near points come before far points, so ids repeat."""
    p = _nation(spark, d)
    return KnnEngine(PointSet(p, "n_nationkey", XY)).with_boxsize(BOXN).query_nearest_k(p, 80, "n_nationkey")


def knn_axis_3d(spark, d):
    e, q = _emb_engine(spark, d)
    return e.query_nearest_k_axis(q, 10, 2, "vec_id")


def knn_axis_periodic_2d(spark, d):
    e, q = _ev_engine(spark, d, periodic=True)
    return e.query_nearest_k_axis(q, 10, 0, "event_id")


def knn_axis_with_index(spark, d):
    e, q = _emb_engine(spark, d)
    return e.query_nearest_k_axis(q, 10, 0, "vec_id", with_index=True)


def _next_vector(spark, d):
    a = _emb3(spark, d)
    return a.join(a.select((F.col("vec_id") - 1).alias("vec_id"), *[F.col(c).alias(f"{c}2") for c in XYZ]), "vec_id")


def pairwise_sqdist(spark, d):
    return _next_vector(spark, d).select("vec_id", G.squared_euclidean(XYZ, [f"{c}2" for c in XYZ]).alias("d2"))


def pairwise_sqdist_axis(spark, d):
    # apart from the plain sum: Spark takes sums of one set of terms in two orders for the same expression
    total, ax, nonax = G.squared_euclidean_axis(XYZ, [f"{c}2" for c in XYZ], 1)
    return _next_vector(spark, d).select("vec_id", total.alias("d2"), ax.alias("axis_d2"), nonax.alias("nonaxis_d2"))


def dist_to_box(spark, d):
    lower, upper = [F.lit(x) for x in (-0.1, 0.0, 0.05)], [F.lit(x) for x in (0.1, 0.1, 0.2)]
    return _emb3(spark, d).select("vec_id", G.squared_distance_to_box(XYZ, lower, upper).alias("d2"))


def bounding_box(spark, d):
    return _emb3(spark, d).agg(*G.bounds(XYZ), F.count("*").alias("n"))


def periodic_images(spark, d):
    from vicinity.operators.strategies import images

    q = _ev2(spark, d).select(F.col("event_id").alias("qid"), F.col("x").alias("c0"), F.col("y").alias("c1"))
    return images(q, 2, BOX2)


def nearest_side_dist(spark, d):
    s = G.nearest_side_squared(XY, BOX2)
    return _ev2(spark, d).select("event_id", s[0].alias("side_x"), s[1].alias("side_y"))


QUERIES = {
    "nn1_3d": nn1_3d,
    "nn1_3d_squared": nn1_3d_squared,
    "nn1_position": nn1_position,
    "nn1_periodic_2d": nn1_periodic_2d,
    "knn_k10_3d": _knn3("auto"),
    "knn_sql_3d": _knn3("sql"),
    "knn_arrow_3d": _knn3("arrow"),
    "knn_grid_3d": _knn3("grid"),
    "knn_grid_2d": _knn2("grid"),
    "knn_kdpart_2d": _knn2("kdpart"),
    "knn_f32_64d": knn_f32_64d,
    "knn_blocked_64d": knn_blocked_64d,
    "knn_k_gt_n": knn_k_gt_n,
    "knn_packed": knn_packed,
    "knn_ties_2d": knn_ties_2d,
    "knn_periodic_2d": knn_periodic_2d,
    "knn_periodic_k80_2d": knn_periodic_k80_2d,
    "knn_periodic_k80_3d": _ev3_periodic(80),
    "knn_periodic_kdpart_3d": _ev3_periodic(10, "kdpart"),
    "knn_periodic_large_k_images": knn_periodic_large_k_images,
    "knn_axis_3d": knn_axis_3d,
    "knn_axis_periodic_2d": knn_axis_periodic_2d,
    "knn_axis_with_index": knn_axis_with_index,
    "pairwise_sqdist": pairwise_sqdist,
    "pairwise_sqdist_axis": pairwise_sqdist_axis,
    "dist_to_box": dist_to_box,
    "bounding_box": bounding_box,
    "periodic_images": periodic_images,
    "nearest_side_dist": nearest_side_dist,
}

_E3 = "SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings"
_EV = "SELECT event_id AS id, (epoch_us(ts) % 86400000000) / 1e6 AS x, value AS y FROM events"
_EV3 = "SELECT event_id AS id, (epoch_us(ts) % 86400000000) / 1e6 AS x, value AS y, user_id::DOUBLE AS z FROM events"
_NATION = "SELECT n_nationkey AS id, n_nationkey::DOUBLE AS x, n_regionkey::DOUBLE AS y FROM nation"
_D3 = "(q.x-p.x)*(q.x-p.x) + (q.y-p.y)*(q.y-p.y) + (q.z-p.z)*(q.z-p.z)"
_D2 = "(q.x-p.x)*(q.x-p.x) + (q.y-p.y)*(q.y-p.y)"


def _knn_sql(base: str, d2: str, k: int, cols: str, where_q: str = f"id % {EVERY} = 0", extra: str = "", box: list[float] | None = None) -> str:
    """box: the 2**D images of each query rank with it, and as many pairs are kept as there are points."""
    image, q = "", f"(SELECT * FROM base WHERE {where_q}) q"
    if box:
        names, last = "xyz"[: len(box)], f"(SELECT * FROM base WHERE {where_q})"
        for i, (c, side) in enumerate(zip(names, box, strict=True)):
            both = ", ".join(f"unnest([{c}, CASE WHEN {c} < {side}/2 THEN {c} + {side} ELSE {c} - {side} END]) AS {c}" if c == n else n for n in names)
            image += f", q{i} AS (SELECT id, {both} FROM {last})"
            last = f"q{i}"
        q = f"{last} q"
    most = f"least({k}, (SELECT count(*) FROM base))"
    return f"""WITH base AS ({base}){image}
  , pairs AS (SELECT q.id AS qid, p.id AS neighbor_id, {d2} AS d2 {extra} FROM {q}, base p)
  , ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, neighbor_id) AS rank FROM pairs)
SELECT {cols} FROM ranked WHERE rank <= {most}"""


_KNN = "qid, rank::INTEGER AS rank, neighbor_id, sqrt(d2) AS distance"
_POS = ", p.x AS position_x, p.y AS position_y, p.z AS position_z"
_AXIS = "qid, rank::INTEGER AS rank, sqrt(ax) AS axis_distance, sqrt(nonax) AS nonaxis_distance"
_Z = ", (q.z-p.z)*(q.z-p.z) AS ax, (q.x-p.x)*(q.x-p.x) + (q.y-p.y)*(q.y-p.y) AS nonax"
_X3 = ", (q.x-p.x)*(q.x-p.x) AS ax, (q.y-p.y)*(q.y-p.y) + (q.z-p.z)*(q.z-p.z) AS nonax"
_X2 = ", (q.x-p.x)*(q.x-p.x) AS ax, (q.y-p.y)*(q.y-p.y) AS nonax"
_KNN3 = _knn_sql(_E3, _D3, 10, _KNN)
_KNN2 = _knn_sql(_EV, _D2, 10, _KNN)
_F32 = f"""WITH pairs AS (SELECT q.vec_id AS qid, p.vec_id AS neighbor_id,
    list_reduce(list_transform(list_zip(q.embedding, p.embedding), lambda t: (t[1]-t[2])*(t[1]-t[2])), lambda a, x: a+x) AS d2
  FROM (SELECT * FROM embeddings WHERE vec_id % {EVERY} = 0) q, embeddings p)
  , ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, neighbor_id) AS rank FROM pairs)
SELECT qid, rank::INTEGER AS rank, neighbor_id, sqrt(d2)::FLOAT AS distance FROM ranked WHERE rank <= 5"""

ORACLES = {
    "nn1_3d": _knn_sql(_E3, _D3, 1, "qid, neighbor_id, sqrt(d2) AS distance"),
    "nn1_3d_squared": _knn_sql(_E3, _D3, 1, "qid, neighbor_id, d2 AS distance"),
    "nn1_position": _knn_sql(_E3, _D3, 1, "qid, neighbor_id, sqrt(d2) AS distance, position_x, position_y, position_z", extra=_POS),
    "nn1_periodic_2d": _knn_sql(_EV, _D2, 1, "qid, neighbor_id, sqrt(d2) AS distance", box=BOX2),
    "knn_k10_3d": _KNN3,
    "knn_sql_3d": _KNN3,
    "knn_arrow_3d": _KNN3,
    "knn_grid_3d": _KNN3,
    "knn_grid_2d": _KNN2,
    "knn_kdpart_2d": _KNN2,
    "knn_f32_64d": _F32,
    "knn_blocked_64d": _F32,
    "knn_k_gt_n": _knn_sql(_NATION, _D2, 50, _KNN, "TRUE"),
    "knn_packed": _KNN3,
    "knn_ties_2d": _knn_sql("SELECT p_partkey AS id, p_size::DOUBLE AS x, p_retailprice AS y FROM part", _D2, 10, _KNN),
    "knn_periodic_2d": _knn_sql(_EV, _D2, 10, _KNN, box=BOX2),
    "knn_periodic_k80_2d": _knn_sql(_EV, _D2, 80, _KNN, box=BOX2),
    "knn_periodic_k80_3d": _knn_sql(_EV3, _D3, 80, _KNN, box=BOX3),
    "knn_periodic_kdpart_3d": _knn_sql(_EV3, _D3, 10, _KNN, box=BOX3),
    "knn_periodic_large_k_images": _knn_sql(_NATION, _D2, 80, _KNN, "TRUE", box=BOXN),
    "knn_axis_3d": _knn_sql(_E3, "(q.z-p.z)*(q.z-p.z) + ((q.x-p.x)*(q.x-p.x) + (q.y-p.y)*(q.y-p.y))", 10, _AXIS, extra=_Z),
    "knn_axis_periodic_2d": _knn_sql(_EV, _D2, 10, _AXIS, extra=_X2, box=BOX2),
    "knn_axis_with_index": _knn_sql(_E3, "(q.x-p.x)*(q.x-p.x) + ((q.y-p.y)*(q.y-p.y) + (q.z-p.z)*(q.z-p.z))", 10, _AXIS + ", neighbor_id", extra=_X3),
    "pairwise_sqdist": f"WITH base AS ({_E3}) SELECT q.id AS vec_id, {_D3} AS d2 FROM base q JOIN base p ON p.id = q.id + 1",
    "pairwise_sqdist_axis": f"""WITH base AS ({_E3})
SELECT q.id AS vec_id, (q.y-p.y)*(q.y-p.y) + ((q.x-p.x)*(q.x-p.x) + (q.z-p.z)*(q.z-p.z)) AS d2,
  (q.y-p.y)*(q.y-p.y) AS axis_d2, (q.x-p.x)*(q.x-p.x) + (q.z-p.z)*(q.z-p.z) AS nonaxis_d2
FROM base q JOIN base p ON p.id = q.id + 1""",
    "dist_to_box": f"""WITH base AS ({_E3}), b AS (SELECT *, greatest(least(x, 0.1::DOUBLE), -0.1::DOUBLE) AS cx, greatest(least(y, 0.1::DOUBLE), 0.0::DOUBLE) AS cy, greatest(least(z, 0.2::DOUBLE), 0.05::DOUBLE) AS cz FROM base)
SELECT id AS vec_id, (x-cx)*(x-cx) + (y-cy)*(y-cy) + (z-cz)*(z-cz) AS d2 FROM b""",
    "bounding_box": f"WITH base AS ({_E3}) SELECT min(x) AS lower_0, max(x) AS upper_0, min(y) AS lower_1, max(y) AS upper_1, min(z) AS lower_2, max(z) AS upper_2, count(*) AS n FROM base",
    "periodic_images": f"""WITH base AS ({_EV}), q0 AS (SELECT id, unnest([x, CASE WHEN x < {BOX2[0]}/2 THEN x + {BOX2[0]} ELSE x - {BOX2[0]} END]) AS x, y FROM base)
SELECT id AS qid, x AS c0, unnest([y, CASE WHEN y < {BOX2[1]}/2 THEN y + {BOX2[1]} ELSE y - {BOX2[1]} END]) AS c1 FROM q0""",
    "nearest_side_dist": f"WITH base AS ({_EV}) SELECT id AS event_id, least({BOX2[0]}-x, x)*least({BOX2[0]}-x, x) AS side_x, least({BOX2[1]}-y, y)*least({BOX2[1]}-y, y) AS side_y FROM base",
}
