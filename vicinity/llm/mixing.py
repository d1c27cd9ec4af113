"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source starts with the same fractional number of copies,
its source's target over its source's size. Two fractions meet at a time:
words move from one document to the other, in a direction drawn so that both
expectations hold, until one of the two is a whole number. The sum of words
stays as it was at each meeting, so what a source takes differs from its
target by less than one document. Blocks of a source's documents work
independently and leave at most one fraction each; these meet in a reduction
tree of a fixed fan-in; the last fraction of a source goes to the nearer whole
number. Draws are seeded by source, level and block, and blocks
are formed by hashes of the rows, so reruns agree whatever the partitions.

Null and empty texts have size 0 and take 0. A null source is a source of its
own, the last. Repeated rows are documents of their own. An empty table gives
an empty result. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vicinity.llm.text import saved

WORD = r"[^\x20\x09-\x0D]+"
#: Rows a block holds on average.
BLOCK_ROWS = 8192
#: Residuals that meet in one task of the tree, as a power of two.
FAN_BITS = 5
#: A source table of more rows is joined by shuffle.
BROADCAST_SOURCES = 100_000


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size, n_docs, target: shares by weight, none above cap times its source's size.

    A level L gives every source min(weight * L, cap * size). Raising L to what
    the uncapped sources can still share, until no more are capped, is the
    repeated resharing of the excess.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    # ranks by code point without one task for all sources: range partitions and their offsets
    ranged = saved(by_source.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "mix-sources")
    parts = sorted((r["part"], r["n"]) for r in ranged.groupBy("part").agg(F.count("*").alias("n")).collect())
    if not parts:
        return ranged.select("source", "source_size", "n_docs", F.lit(0.0).alias("target"))
    offsets = dict(zip([p for p, _ in parts], np.cumsum([0] + [n for _, n in parts[:-1]]).tolist(), strict=True))
    at = F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv])
    rank = at[F.col("part")] + F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights) + 1).cast("int"))
    ranked = saved(ranged.select("source", "source_size", "n_docs", w.alias("weight")), "mix-ranked")
    total = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:
        over = F.col("weight") * level > cap * F.col("source_size")
        n, fixed, free = ranked.agg(F.count_if(over), F.sum(F.when(over, cap * F.col("source_size"))), F.sum(F.when(~over, F.col("weight")))).first()
        if n == capped:
            break
        capped = n
        if not free:
            level = math.inf
            break
        level = max(0.0, total - (fixed or 0.0)) / free
    return ranked.select("source", "source_size", "n_docs", F.least(F.col("weight") * F.lit(level), cap * F.col("source_size")).alias("target"))


def pivot(frac: list[float], size: list[int], draw) -> tuple[list[float], int]:
    """Rounds the fractions but one at most; gives them back and the index of that one, or -1."""
    held = -1
    for i, f in enumerate(frac):
        if f <= 0.0 or f >= 1.0:
            continue
        if held < 0:
            held = i
            continue
        a, b, sa, sb = frac[held], f, size[held], size[i]
        up, down = min((1 - a) * sa, b * sb), min(a * sa, (1 - b) * sb)
        if draw() * (up + down) < down:  # words go from i to the held one
            if (1 - a) * sa <= b * sb:
                frac[held], frac[i] = 1.0, b - up / sb
            else:
                frac[held], frac[i] = a + up / sa, 0.0
        else:
            if a * sa <= (1 - b) * sb:
                frac[held], frac[i] = 0.0, b + down / sb
            else:
                frac[held], frac[i] = a - down / sa, 1.0
        inside = [j for j in (held, i) if 1e-12 < frac[j] < 1 - 1e-12]
        for j in (held, i):
            if j not in inside:
                frac[j] = float(round(frac[j]))
        held = inside[0] if inside else -1
    return frac, held


COLUMNS = "doc_id {id}, source string, size long, source_size long, target double, base int, frac double, row_hash long, block long, done boolean"


def _round_block(level: int, bits: int, seed: int, last: bool):
    def work(key, t):
        source, block = (x.as_py() for x in key)
        t = t.sort_by([("size", "descending"), ("row_hash", "ascending")])
        rng = np.random.default_rng([seed, level, block, zlib.crc32(repr(source).encode())])
        frac, held = pivot(t.column("frac").to_pylist(), t.column("size").to_pylist(), rng.random)
        if last and held >= 0:
            frac[held], held = float(round(frac[held])), -1
        done = np.ones(len(frac), bool)
        if held >= 0:
            done[held] = False
        for name, x in (("frac", pa.array(frac, pa.float64())), ("done", pa.array(done)), ("block", pa.array(np.full(len(frac), block >> bits, np.int64)))):
            t = t.set_column(t.schema.get_field_index(name), name, x)
        return t

    return work


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 17) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every document."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    sizes = saved(
        docs.select(
            "doc_id",
            F.col("source").cast("string").alias("source"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.xxhash64("doc_id", "source", "text").alias("row_hash"),
        ),
        "mix-sizes",
    )
    targets = saved(source_targets(sizes, weights, share, cap), "mix-targets")
    n_sources = targets.count()
    n = sizes.count()
    bits = max(0, math.ceil(math.log2(max(1, n / BLOCK_ROWS))))
    t = targets.withColumnRenamed("source", "of")
    t = F.broadcast(t) if n_sources <= BROADCAST_SOURCES else t
    p = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    schema = COLUMNS.format(id=id_type)
    rows = sizes.join(t, F.col("source").eqNullSafe(F.col("of"))).select(
        "doc_id", "source", "size", "source_size", "target", F.floor(p).cast("int").alias("base"),
        F.when(F.col("size") > 0, p - F.floor(p)).otherwise(0.0).alias("frac"), "row_hash",
        F.shiftrightunsigned("row_hash", 64 - bits).alias("block") if bits else F.lit(0).cast("long").alias("block"), F.lit(False).alias("done"),
    )
    level, out = 0, []
    while True:
        last = bits == 0
        rows = saved(rows.groupBy("source", "block").applyInArrow(_round_block(level, min(bits, FAN_BITS), seed, last), schema), f"mix-level{level}")
        out.append(rows.where("done"))
        if last:
            break
        rows, bits, level = rows.where("not done"), max(0, bits - FAN_BITS), level + 1
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    copies = (F.col("base") + F.col("frac").cast("int")).alias("copies")
    return whole.select("doc_id", "source", "size", "source_size", "target", copies).withColumn("taken", F.col("copies") * F.col("size"))
