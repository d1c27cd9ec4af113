"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

import json
import os
import time

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from vicinity.engine import KnnEngine
from vicinity.plans import knn_queries
from vicinity.sources.points import PointSet

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ["nn1_3d", "knn_k10_3d", "knn_f32_64d", "knn_periodic_2d", "knn_periodic_k80_3d", "knn_axis_3d", "knn_grid_2d", "knn_kdpart_2d"]


def uniform(spark, n: int, seed: int):
    """n uniform points of the unit cube."""
    return spark.range(n).select("id", *[F.rand(seed + i).alias(f"c{i}") for i in range(3)])


def noop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    noop(knn_queries.QUERIES["knn_k10_3d"](spark, SF))  # starts workers
    out, rate = {}, {}
    for name in HEADLINE:
        began = time.time()
        noop(knn_queries.QUERIES[name](spark, SF))
        out[name] = round(time.time() - began, 3)
    # the published workload, whole: 1e5 uniform points, 1e6 queries; then 4e6 queries, and ten neighbours of each
    cols = ["c0", "c1", "c2"]
    points = uniform(spark, 100_000, 1).cache()
    points.count()
    for name, n, k, strategy in (("uniform_1e5_nn1_1e6_auto", 10**6, 1, "auto"), ("uniform_1e5_nn1_1e6_kdpart", 10**6, 1, "kdpart"), ("uniform_1e5_nn1_4e6_auto", 4 * 10**6, 1, "auto"), ("uniform_1e5_k10_1e6_auto", 10**6, 10, "auto")):
        queries = uniform(spark, n, 9).withColumnRenamed("id", "qid").cache()
        queries.count()
        began = time.time()
        engine = KnnEngine(PointSet(points, "id", cols), strategy)
        noop(engine.query_nearest_k(queries, k, "qid", cols))
        out[name] = round(time.time() - began, 3)
        rate[name] = round(n / out[name])
        queries.unpersist()
    total = round(float(np.sum(list(out.values()))), 3)
    print(json.dumps({"metric": "knn_headline_total", "value": total, "unit": "sec", "queries": out, "queries_per_second": rate, "sf": SF}))


if __name__ == "__main__":
    main()
