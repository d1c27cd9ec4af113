"""Shared byte-level helpers: Arrow text buffers, vectorised hashes, shared storage."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import pickle
import re
import sys
import threading
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

U = np.uint64
#: Odd 64-bit constants of the hashes (fixed values).
BASE = 0x9E3779B97F4A7C15
MIX1 = 0xBF58476D1CE4E5B9
MIX2 = 0x94D049BB133111EB
BASE2 = 0xD6E8FEB86659FD93
#: Bytes that one vectorised step works on; its temporaries are about 100 times that.
STEP_BYTES = 1 << 19


def worker_store() -> dict:
    """A dictionary that lives as long as the Python worker, across its tasks."""
    mod = sys.modules.setdefault("_vicinity_worker_store", types.ModuleType("_vicinity_worker_store"))
    return mod.__dict__.setdefault("store", {})


def tidy() -> None:
    """Gives a worker's free memory back to the system at the end of a task, as the worker stays for others."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def shipped(spark: SparkSession, thing):
    """A function that gives thing on executors, once a worker; its classes travel by value, as the subpackage's functions do."""
    sent, key = spark.sparkContext.broadcast(cloudpickle.dumps(thing)), uuid.uuid4().hex

    def get():
        held = worker_store().setdefault("shipped", {})
        if key not in held:
            while len(held) >= 4:
                del held[next(iter(held))]
            held[key] = pickle.loads(sent.value)
        return held[key]

    return get


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder of spark.checkpoint.dir, which all executors share. Only a local master may leave it unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "/tmp/vicinity-checkpoints"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: While tables are written: shuffle files go as their query ends, and batches for Python are bounded by bytes, as texts differ in length.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SETTINGS = {_CLEANUP: "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
_writers: dict = {"lock": threading.Lock(), "n": 0, "before": {}}


@contextlib.contextmanager
def _settings(spark: SparkSession) -> Iterator[None]:
    """_SETTINGS hold while any thread writes."""
    with _writers["lock"]:
        if not _writers["n"]:
            _writers["before"] = {k: spark.conf.get(k, None) for k in _SETTINGS}
            for k, v in _SETTINGS.items():
                spark.conf.set(k, v)
        _writers["n"] += 1
    try:
        yield
    finally:
        with _writers["lock"]:
            _writers["n"] -= 1
            if not _writers["n"]:
                for k, v in _writers["before"].items():
                    spark.conf.unset(k) if v is None else spark.conf.set(k, v)


_scope: contextvars.ContextVar = contextvars.ContextVar("vicinity_scratch", default=None)


class Scratch:
    """The tables that one run of an operator writes to the shared folder.

    Each is Parquet, read back, which cuts its lineage. Superseded ones go by
    drop(), the others when the run ends, but for those that its result reads
    (keep), which go with the run around it, if there is one.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root = spark, shared_dir(spark, name)
        self.tables: list[list] = []  # of each: data frame, path, whether it is kept
        self.number = 0

    def __enter__(self) -> Scratch:
        self.around = _scope.get()
        self.token = _scope.set(self)
        return self

    def __exit__(self, kind, *_) -> None:
        _scope.reset(self.token)
        for table in self.tables:
            if table[2] and kind is None:
                if self.around is not None:
                    self.around.tables.append([None, table[1], False])
            else:
                self._delete(table[1])

    def save(self, df: DataFrame, name: str, keep: bool = False) -> DataFrame:
        path = f"{self.root}/{self.number}-{name}"
        self.number += 1
        self.tables.append([None, path, keep])
        with _settings(self.spark):
            df.write.parquet(path)
        self.tables[-1][0] = out = self.spark.read.schema(df.schema).parquet(path)
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        for table in [t for t in self.tables if any(t[0] is f for f in frames)]:
            self._delete(table[1])
            self.tables.remove(table)

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def saved(df: DataFrame, name: str) -> DataFrame:
    """One table of a Scratch of its own that stays until the run around it ends."""
    with Scratch(df.sparkSession, name) as s:
        return s.save(df, name, keep=True)


def row_of(docs: DataFrame, *without: str):
    """The columns of docs as one struct, so that none clashes with an operator's own."""
    from pyspark.sql import functions as F

    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in without])


def by_table(rows: DataFrame, key: str, table, yes: bool) -> DataFrame:
    """The rows whose 64-bit key is in a broadcast repeat table, or those whose key isn't; no shuffle."""
    at = rows.columns.index(key)

    def work(batches):
        for b in batches:
            hit = in_table(table.value, b.column(at).to_numpy().view(U))
            yield b.filter(pa.array(hit if yes else ~hit))

    return rows.mapInArrow(work, rows.schema)


def flat(col) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array, laid end to end, and the n + 1 offsets; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_binary()), b"")
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1] if offs else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def steps(offs: np.ndarray, size: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about so many bytes each; a longer text stands alone."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (at least); kept by the worker."""
    store = worker_store()
    have = store.get(("pow", base))
    if have is None or len(have[0]) < n:
        n = 1 << max(16, int(n - 1).bit_length())
        inv = pow(base, -1, 1 << 64)
        out = []
        for b in (base, inv):
            p = np.full(n, b, U)
            p[0] = 1
            with np.errstate(over="ignore"):
                out.append(np.multiply.accumulate(p))
        have = store["pow", base] = tuple(out)
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that scatters them."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> U(30))
        h *= U(MIX1)
        h ^= h >> U(27)
        h *= U(MIX2)
    h ^= h >> U(31)
    return h


def prefix_sums(data: np.ndarray, base: int) -> np.ndarray:
    """S with S[i] the sum of (data[j] + 1) * base**j for j < i."""
    s = np.zeros(len(data) + 1, U)
    x = data.astype(U)
    x += U(1)
    x *= powers(base, len(data) + 1)[0][: len(data)]
    np.cumsum(x, out=s[1:])
    return s


def range_hashes(s: np.ndarray, lo: np.ndarray, hi: np.ndarray, base: int) -> np.ndarray:
    """Hashes of the byte ranges [lo, hi), equal wherever the bytes are."""
    return mix((s[hi] - s[lo]) * powers(base, len(s))[1][lo] ^ ((hi - lo).astype(U) * U(MIX2)))


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_bounds(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes other than space and 9 to 13), and each text's first word."""
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:-1]
    stop = solid.copy()
    stop[:-1] &= ~solid[1:] | edge[1:-1]
    lo = np.flatnonzero(start)
    return lo, np.flatnonzero(stop) + 1, np.searchsorted(lo, offs)


_PART = np.zeros(256, bool)
_PART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def letter_runs(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and each text's first of the runs of letters, digits and bytes above 127."""
    part = _PART[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    a, z = part.copy(), part.copy()
    a[1:] &= ~part[:-1] | edge[1:-1]
    z[:-1] &= ~part[1:] | edge[1:-1]
    lo = np.flatnonzero(a)
    return lo, np.flatnonzero(z) + 1, np.searchsorted(lo, offs)


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words with A-Z lowered, and each text's first word."""
    low = _LOWER[data]
    lo, hi, first = word_bounds(low, offs)
    return range_hashes(prefix_sums(low, BASE), lo, hi, BASE), first


def shingle_hashes(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of n words (all its words, if fewer), and their first indexes by text."""
    s = np.zeros(len(words) + 1, U)
    np.cumsum(words * powers(BASE2, len(words) + 1)[0][: len(words)], out=s[1:])
    count = np.diff(first)
    k = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    begin = np.concatenate([[0], np.cumsum(k)]).astype(np.int64)
    text = np.repeat(np.arange(len(count)), k)
    lo = first[text] + np.arange(len(text)) - begin[text]
    hi = np.minimum(lo + n, first[text + 1])
    return range_hashes(s, lo, hi, BASE2), begin


#: Bits of a repeat table at least and at most: 128 KB and 32 MB.
LEAST_BITS, MOST_BITS = 20, 28


def repeat_table(hashes: DataFrame, col: str = "h") -> np.ndarray:
    """A bit table of distinct 64-bit hashes: it lets through all that are in it, and few others.

    Eight bits a hash, up to MOST_BITS, from where it lets through more others; so it is for filters ahead of exact decisions.
    """
    from pyspark.sql import functions as F

    n = hashes.count()
    bits = min(MOST_BITS, max(LEAST_BITS, (8 * n).bit_length()))
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned({col}, {64 - bits}) % 64 as int))")
    words = hashes.groupBy(F.shiftrightunsigned(col, 64 - bits + 6).alias("w")).agg(F.bit_or(bit).alias("bits")).toArrow()
    table = np.zeros(1 << (bits - 6), np.int64)
    table[words.column("w").to_numpy()] = words.column("bits").to_numpy()
    return table.view(U)


def in_table(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = h >> U(64 - (len(table).bit_length() - 1) - 6)
    return ((table[(slot >> U(6)).astype(np.int64)] >> (slot & U(63))) & U(1)).astype(bool)
