"""Removal of repeated byte strings by a distributed merge sort of suffixes.

A string of min_len bytes is judged at its anchor, the k-gram of least hash in
it. Equal strings have equal anchors, so only suffixes at anchors are sorted,
and of these only such that can hold a repeated string:

1. copies: of texts that occur twice or more every byte goes, and one of them
   stands for all in what follows (a bit table of the rows that stand; one row
   too many only costs work).
2. count: a string that starts up to half a window before its anchor holds a
   certain range of bytes from it on, one that starts earlier a range that ends
   with the k-gram. Both are counted over all texts; a bit table keeps which
   repeat (a bit too many only costs work, never a match).
3. runs: each task sorts the suffixes at anchors with a repeating range, as far
   as strings judged there reach, collapses equal ones, and sends sorted runs,
   front-coded, to ranges of suffixes.
4. merge: each range merges its runs with a loser tree. A run's front code is
   the common prefix with what was put out last, so a game between different
   known prefixes needs no bytes, and one between equal ones starts after them.
5. decide: the merged common-prefix lengths, with those of the bytes to the
   left of each anchor, tell for every alignment which strings are equal.
6. The decisions go back to the runs' texts as byte ranges. Only texts that
   have some (by a bit table, so a few others too) move to meet them.

Nothing is cut or capped: one string with a third of all rows is one entry in
each run that holds it. A null text is empty. Texts shorter than
min_len lose nothing; matches don't cross texts. Repeated rows are occurrences
of their own, so both lose all bytes that min_len-byte strings cover. An empty
table gives an empty result; other columns, whatever their names, are passed on or not read.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from vicinity.llm.text import BASE, MIX1, Scratch, by_table, flat, in_table, powers, prefix_sums, range_hashes, repeat_table, row_of, steps, tidy

#: Bytes of a suffix that choose its range, at most a k-gram: suffixes that share one must meet.
HEAD = 48
#: Suffixes of a run, and of a range on average (more beyond MOST_RANGES ranges, whose borders every task holds).
RUN_ENTRIES = 60_000
RANGE_ENTRIES = 40_000
MOST_RANGES = 1 << 18
#: Sampled heads a range from which the borders are drawn.
HEADS_EACH = 4
#: Bytes that one vectorised step works on, so few that its temporaries stay in a core's cache; and of the steps whose grams are counted at once.
STEP_BYTES = 1 << 16
COUNT_BYTES = 1 << 20
_POS = (1 << 28) - 1


def gram_size(min_len: int) -> int:
    return max(4, min_len // 4)


def anchors(data: np.ndarray, offs: np.ndarray, min_len: int, use: np.ndarray):
    """Of the texts to use: position of each anchor, first and last start of the strings judged there, its text, and the hashes of two ranges.

    The one is in all strings that start up to half a window before the anchor, the other in those that start that far or earlier;
    0 where there are no such strings.
    """
    n, k = len(data), gram_size(min_len)
    w = min_len - k + 1
    lens = np.diff(offs)
    none = np.zeros(0, np.int64)
    ok = (lens >= min_len) & use
    if not ok.any():
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    s = prefix_sums(data, BASE)
    key = s[k:] - s[:-k]
    key *= powers(BASE, n + 1)[1][: n - k + 1]
    key ^= key >> np.uint64(32)
    key *= np.uint64(MIX1)
    key &= ~np.uint64(_POS)
    m = len(key)
    key |= np.arange(m, dtype=np.uint64)
    least, have = key, 1  # of every have k-grams in a row, in the end of every string start
    while 2 * have <= w:
        least, have = np.minimum(least[:-have], least[have:]), 2 * have
    least = np.minimum(least[: m - w + 1], least[w - have :])
    edge = np.zeros(n + 1, np.int8)
    edge[offs[:-1][ok]] += 1
    edge[offs[:-1][ok] + lens[ok] - min_len + 1] -= 1
    start = np.cumsum(edge[: n - min_len + 1], dtype=np.int8).view(bool)  # whether a string starts there
    cut = np.ones(len(start) + 1, bool)
    cut[1:-1] = (least[1:] != least[:-1]) | (edge[1 : len(start)] != 0)
    lo, hi = np.flatnonzero(start & cut[:-1]), np.flatnonzero(start & cut[1:])
    p = (least[lo] & np.uint64(_POS)).astype(np.int64)
    text = np.searchsorted(offs, lo, side="right") - 1
    half = (w - 1) // 2
    late, early = hi >= p - half, lo <= p - half
    right, left = np.zeros(len(p), np.uint64), np.zeros(len(p), np.uint64)
    right[late] = range_hashes(s, p[late], p[late] + min_len - half, BASE)
    left[early] = ~range_hashes(s, p[early] - half, p[early] + k, BASE)
    return p, lo, hi, text, right, left


def stretches(offs: np.ndarray, min_len: int) -> Iterator[tuple[int, int, int, int]]:
    """First text, last text plus one, first byte and last byte plus one of each step; a longer text comes in stretches that hold every string once."""
    for i, j in steps(offs, STEP_BYTES):
        n = int(offs[j] - offs[i])
        if j > i + 1 or n <= 2 * STEP_BYTES:
            yield i, j, int(offs[i]), int(offs[j])
        else:
            for at in range(0, n - min_len + 1, STEP_BYTES):
                yield i, j, int(offs[i]) + at, int(offs[i]) + min(n, at + STEP_BYTES + min_len - 1)


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which known bytes are known."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    z = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
    return n - (z.bit_length() + 7) // 8


def pack(*parts: bytes) -> bytes:
    return np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(parts)


def unpack(b: bytes, n: int) -> list[bytes]:
    at = np.concatenate([[8 * n], 8 * n + np.cumsum(np.frombuffer(b, np.int64, n))]).tolist()
    return [b[i:j] for i, j in zip(at, at[1:], strict=False)]


def encode_run(entries: list[tuple[bytes, bytes, int]]) -> bytes:
    """Front code of sorted (suffix, left bytes, count): prefix shared with the entry before, then the rest."""
    shared, rest, last = [], [], b""
    for r, _, _ in entries:
        c = common(last, r)
        shared.append(c)
        rest.append(r[c:])
        last = r
    ints = lambda x: np.array(x, np.int32).tobytes()
    code = pack(ints(shared), ints([len(x) for x in rest]), b"".join(rest), ints([len(x) for _, x, _ in entries]), b"".join(x for _, x, _ in entries), ints([n for _, _, n in entries]))
    return zstandard.ZstdCompressor(level=3).compress(code)


def decode_run(b: bytes) -> Iterator[tuple[bytes, int, bytes, int]]:
    """Suffix, prefix shared with the one before, left bytes and count of each entry."""
    shared, n_rest, rest, n_left, left, count = unpack(zstandard.ZstdDecompressor().decompress(b), 6)
    i = j = 0
    last = b""
    ints = lambda x: np.frombuffer(x, np.int32).tolist()
    for c, k, m, n in zip(ints(shared), ints(n_rest), ints(n_left), ints(count), strict=True):
        last = last[:c] + rest[i : i + k]
        yield last, c, left[j : j + m], n
        i, j = i + k, j + m


def merge_runs(runs: list[Iterator]) -> Iterator[tuple[int, tuple, int]]:
    """Run, entry and prefix shared with the entry put out before, in order of the suffixes.

    A loser tree: nodes keep the losers of their games and what each shares
    with the winner. Of two that share different lengths with the last output
    the longer wins unseen; of two that share equal ones the bytes after decide.
    """
    k = 1
    while k < len(runs):
        k *= 2
    head: list = [next(r, None) for r in runs] + [None] * (k - len(runs))
    lcp = [0 if x is not None else -1 for x in head]
    tree = [0] * k

    def play(i: int, j: int) -> tuple[int, int]:
        if lcp[i] != lcp[j]:
            return (i, j) if lcp[i] > lcp[j] else (j, i)
        if lcp[i] < 0:
            return i, j
        a, b = head[i][0], head[j][0]
        c = common(a, b, lcp[i])
        if a[c : c + 1] > b[c : c + 1] or (len(a) == c == len(b) and j < i):
            i, j = j, i
        lcp[j] = c
        return i, j

    def build(node: int) -> int:
        if node >= k:
            return node - k
        i, tree[node] = play(build(2 * node), build(2 * node + 1))
        return i

    win = build(1) if k > 1 else 0
    while lcp[win] >= 0:
        yield win, head[win], lcp[win]
        head[win] = x = next(runs[win], None)
        lcp[win] = x[1] if x is not None else -1
        node = (win + k) // 2
        while node:
            win, tree[node] = play(win, tree[node])
            node //= 2


def classes(shared: np.ndarray, depth: int) -> np.ndarray:
    """Numbers of the classes that share depth bytes, along a sorted order."""
    return np.cumsum(shared < depth)


def repeated_alignments(right_len, right_shared, lefts, count, min_len: int) -> np.ndarray:
    """Whether the string that starts d bytes left of its anchor occurs twice, by entry and d."""
    n = len(right_len)
    back = [x[::-1] for x in lefts]
    order = sorted(range(n), key=back.__getitem__)
    shared = np.zeros(n, np.int64)
    for i in range(1, n):
        shared[i] = common(back[order[i - 1]], back[order[i]])
    order = np.array(order, np.int64)
    left_len = np.array([len(x) for x in lefts], np.int64)
    out = np.zeros((n, int(left_len.max(initial=0)) + 1), bool)
    for d in range(out.shape[1]):
        at = np.flatnonzero((left_len >= d) & (right_len >= min_len - d))
        if not len(at):
            continue
        left = np.empty(n, np.int64)
        left[order] = classes(shared, d)
        key = classes(right_shared, min_len - d)[at] * (n + 1) + left[at]
        by = np.argsort(key, kind="stable")
        start = np.flatnonzero(np.concatenate([[True], np.diff(key[by]) != 0]))
        total = np.add.reduceat(count[at][by], start)
        out[at[by], d] = np.repeat(total >= 2, np.diff(np.append(start, len(by))))
    return out


def repeated_spans(texts: DataFrame, scratch: Scratch, min_len: int = 200) -> DataFrame:
    """t1, t2 and spans (array of from, to in bytes, in no order; they may overlap) of the texts with repeated strings. texts has text, its keys t1 and t2, and a row's own key r."""
    spark = texts.sparkSession
    texts = texts.where(F.octet_length("text") >= min_len)
    copies = scratch.save(texts.groupBy("t1", "t2").agg(F.count("*").alias("n"), F.min("r").alias("r"), F.min(F.octet_length("text")).alias("size")), "copies")
    standing = spark.sparkContext.broadcast(repeat_table(copies, "r"))

    def stands(b) -> np.ndarray:
        """Which rows no other one stands for."""
        return in_table(standing.value, b.column(3).to_numpy().view(np.uint64))

    def count_grams(batches):
        size = min(HEAD, gram_size(min_len))

        def counted(data, places, grams):
            kg, at, n = np.unique(np.concatenate(grams), return_index=True, return_counts=True)
            at = np.concatenate(places)[at]
            head = [None] * len(kg)
            for i in np.flatnonzero(kg & np.uint64(63) == 0).tolist():
                head[i] = data[at[i] : at[i] + size].tobytes()
            return pa.RecordBatch.from_arrays([pa.array(kg.view(np.int64)), pa.array(n), pa.array(head, pa.binary())], names=["kg", "n", "head"])

        for b in batches:
            data, offs = flat(b.column(0))
            use = stands(b)
            places, grams, since = [], [], 0
            for i, j, x, z in stretches(offs, min_len):
                p, _, _, _, right, left = anchors(data[x:z], np.clip(offs[i : j + 1], x, z) - x, min_len, use[i:j])
                for kg in (right, left):
                    places.append(p[kg != 0] + x)
                    grams.append(kg[kg != 0])
                if z - since >= COUNT_BYTES:
                    yield counted(data, places, grams)
                    places, grams, since = [], [], z
            if grams:
                yield counted(data, places, grams)
        tidy()

    texts = texts.select("text", "t1", "t2", "r")
    grams = texts.mapInArrow(count_grams, "kg long, n long, head binary")
    grams = scratch.save(grams.groupBy("kg").agg(F.sum("n").alias("n"), F.first("head").alias("head")).where("n > 1"), "grams")
    total = grams.agg(F.sum("n")).first()[0] or 0
    ranges = max(1, min(MOST_RANGES, -(-total // (2 * RANGE_ENTRIES))))
    heads = sorted(bytes(r["head"]) for r in grams.where("head is not null").orderBy("kg").limit(HEADS_EACH * ranges).select("head").collect())
    borders = sorted({heads[len(heads) * i // ranges] for i in range(1, ranges)}) if heads else []
    sent = spark.sparkContext.broadcast((repeat_table(grams, "kg"), borders))
    scratch.drop(grams)

    def make_runs(batches):
        bits, borders = sent.value
        part = TaskContext.get().partitionId()
        entries: list[tuple[bytes, bytes, int, int]] = []
        keys: list[tuple[int, int]] = []
        flushed = 0
        names = ["range", "run", "idx", "code", "refs"]
        one = lambda t, v: pa.array([v], t)

        def flush():
            nonlocal entries, keys, flushed
            run = (part << 20) + flushed
            flushed += 1
            entries.sort(key=lambda e: (e[0], e[1]))
            whole: list[tuple[bytes, bytes, int]] = []
            idx = []
            for r, left, *_ in entries:
                if whole and whole[-1][0] == r and whole[-1][1] == left:
                    whole[-1] = (r, left, whole[-1][2] + 1)
                else:
                    whole.append((r, left, 1))
                idx.append(len(whole) - 1)
            if idx:
                doc = np.array([e[2] for e in entries], np.int32)
                used, doc = np.unique(doc, return_inverse=True)
                k = np.array(keys, np.int64)[used]
                refs = pack(np.array(idx, np.int32).tobytes(), doc.astype(np.int32).tobytes(), np.array([e[3] for e in entries], np.int64).tobytes(), k[:, 0].tobytes(), k[:, 1].tobytes())
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int32()), one(pa.int64(), run), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), one(pa.binary(), zstandard.ZstdCompressor(level=3).compress(refs))], names=names)
            suffixes = [e[0] for e in whole]
            at = [0] + [bisect.bisect_left(suffixes, x) for x in borders] + [len(whole)]
            parts = [(i, a, z) for i, (a, z) in enumerate(zip(at, at[1:], strict=False)) if a < z]
            for c in range(0, len(parts), 256):
                some = parts[c : c + 256]
                codes = pa.array([encode_run(whole[a:z]) for _, a, z in some], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _, _ in some], pa.int32()), pa.array([run] * len(some), pa.int64()), pa.array([a for _, a, _ in some], pa.int32()), codes, pa.nulls(len(some), pa.binary())], names=names)
            entries, keys = [], []

        half = (min_len - gram_size(min_len)) // 2
        for b in batches:
            data, offs = flat(b.column(0))
            use = stands(b)
            k1, k2 = b.column(1).to_numpy(), b.column(2).to_numpy()
            for i, j, x0, z0 in stretches(offs, min_len):
                d, o = data[x0:z0], offs[i : j + 1] - x0
                p, lo, hi, doc, right, left = anchors(d, np.clip(o, 0, z0 - x0), min_len, use[i:j])
                late, early = (right != 0) & in_table(bits, right), (left != 0) & in_table(bits, left)
                lo = np.where(early, lo, np.maximum(lo, p - half + 1))
                hi = np.where(late, hi, np.minimum(hi, p - half - 1))
                late &= lo <= hi
                early &= lo <= hi
                keep = np.flatnonzero(late | early)
                raw = d.tobytes()
                base = len(keys)
                keys += zip(k1[i:j].tolist(), k2[i:j].tolist(), strict=True)
                for x, f, z, t, f0 in zip(p[keep].tolist(), lo[keep].tolist(), hi[keep].tolist(), (doc[keep] + base).tolist(), (lo[keep] - o[doc[keep]]).tolist(), strict=True):
                    entries.append((raw[x : z + min_len], raw[f:x], t, f0))
                if len(entries) >= RUN_ENTRIES:
                    yield from flush()
        yield from flush()
        tidy()

    runs = scratch.save(texts.mapInArrow(make_runs, "range int, run long, idx int, code binary, refs binary"), "runs")

    def decide(t):
        """Marks of one range's entries: from and to, relative to the first string start."""
        run_of, first, code = t.column("run").to_pylist(), t.column("idx").to_pylist(), t.column("code").to_pylist()
        source, right_len, shared, lefts, count = [], [], [], [], []
        seen = [0] * len(code)
        for i, (r, _, left, n), c in merge_runs([decode_run(x) for x in code]):
            source.append((i, seen[i]))
            seen[i] += 1
            right_len.append(len(r))
            shared.append(c)
            lefts.append(left)
            count.append(n)
        flags = repeated_alignments(np.array(right_len, np.int64), np.array(shared, np.int64), lefts, np.array(count, np.int64), min_len)
        edge = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        entry, d0 = np.nonzero(edge == 1)
        _, d1 = np.nonzero(edge == -1)
        d_max = np.array([len(x) for x in lefts], np.int64)[entry] if len(entry) else np.zeros(0, np.int64)
        src = np.array(source, np.int64).reshape(-1, 2)[entry]
        return pa.table(
            {
                "run": pa.array(np.array(run_of, np.int64)[src[:, 0]]),
                "idx": pa.array((np.array(first, np.int64)[src[:, 0]] + src[:, 1]).astype(np.int32)),
                "a": pa.array(d_max - (d1 - 1)),
                "z": pa.array(d_max - d0 + min_len),
            }
        )

    def settle(marks, refs):
        """Spans of one run's texts: the marks of its entries at the places of their texts, united."""
        out = {"k1": pa.array([], pa.int64()), "k2": pa.array([], pa.int64()), "spans": pa.array([], pa.list_(pa.struct([("a", pa.int64()), ("z", pa.int64())])))}
        if not marks.num_rows or not refs.num_rows:
            return pa.table(out)
        idx, doc, lo, k1, k2 = unpack(zstandard.ZstdDecompressor().decompress(refs.column("refs")[0].as_py()), 5)
        idx, doc, lo, k1, k2 = np.frombuffer(idx, np.int32), np.frombuffer(doc, np.int32).astype(np.int64), np.frombuffer(lo, np.int64), np.frombuffer(k1, np.int64), np.frombuffer(k2, np.int64)
        marks = marks.sort_by("idx")
        m, a, z = (marks.column(c).to_numpy() for c in ("idx", "a", "z"))
        first = np.searchsorted(m, idx)
        n = np.searchsorted(m, idx, side="right") - first
        ref = np.repeat(np.arange(len(idx)), n)
        mark = np.repeat(first, n) + np.arange(len(ref)) - np.repeat(np.cumsum(n) - n, n)
        d, a, z = doc[ref], lo[ref] + a[mark], lo[ref] + z[mark]
        by = np.lexsort((a, d))
        d, a, z = d[by], a[by], z[by]
        far = int(z.max(initial=0)) + 1
        top = np.maximum.accumulate(d * far + z)
        new = np.flatnonzero(np.concatenate([[True], (d * far + a)[1:] > top[:-1]]))
        end = top[np.append(new[1:], len(d)) - 1] - d[new] * far
        docs_at = np.flatnonzero(np.concatenate([[True], np.diff(d[new]) != 0]))
        spans = pa.StructArray.from_arrays([pa.array(a[new]), pa.array(end)], ["a", "z"])
        of = d[new][docs_at]
        offsets = pa.array(np.append(docs_at, len(new)).astype(np.int32))
        return pa.table({"k1": pa.array(k1[of]), "k2": pa.array(k2[of]), "spans": pa.ListArray.from_arrays(offsets, spans)})

    marks = runs.where("code is not null").select("range", "run", "idx", "code").groupBy("range").applyInArrow(decide, "run long, idx int, a long, z long")
    refs = runs.where("refs is not null").select("run", "refs")
    spans = marks.groupBy("run").cogroup(refs.groupBy("run")).applyInArrow(settle, "k1 long, k2 long, spans array<struct<a:long,z:long>>")
    spans = spans.select(F.col("k1").alias("t1"), F.col("k2").alias("t2"), "spans")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("size").cast("long").alias("z")))
    every = spans.unionByName(copies.where("n > 1").select("t1", "t2", whole.alias("spans")))
    # a long text has spans of several runs; equal ones, of rows with equal texts, count once
    out = scratch.save(every.groupBy("t1", "t2").agg(F.flatten(F.collect_set("spans")).alias("spans")), "spans", keep=True)
    scratch.drop(runs, copies)
    return out


def union_spans(spans) -> list[tuple[int, int]]:
    """Sorted, disjoint and not touching."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def remove_repeats(docs: DataFrame, min_len: int = 200, digest: bool = False) -> DataFrame:
    """docs with each text less its repeated strings, all other columns, whatever their names, as they were.

    digest: instead doc_id, n_bytes, n_removed, n_spans, and kept_sha256 of all remaining bytes. A removed range can end inside a
    character; what remains of such a character is dropped from the text, not from the digest.
    """
    with Scratch(docs.sparkSession, "suffix") as scratch:
        if digest:
            out = _less_repeats(scratch, docs, F.struct("doc_id"), min_len, lambda raw, kept, spans: hashlib.sha256(kept).hexdigest(), null="")
            return out.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.col("rest").alias("kept_sha256"))
        out = _less_repeats(scratch, docs, row_of(docs, "text"), min_len, lambda raw, kept, spans: kept.decode("utf-8", "ignore") if spans else raw.decode())
        return out.select(*[F.col("rest").alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def _less_repeats(scratch: Scratch, docs: DataFrame, row, min_len: int, rest, null: str | None = None) -> DataFrame:
    """row, n_bytes, n_removed, n_spans and rest: what rest() makes of a text, its remaining bytes and the removed ranges; null stands for a null text."""
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    keys = [F.xxhash64(text).alias("t1"), F.xxhash64(text, F.lit(1)).alias("t2")]
    spans = repeated_spans(docs.select(text.alias("text"), *keys, F.xxhash64("doc_id", text).alias("r")), scratch, min_len)
    table = spark.sparkContext.broadcast(repeat_table(spans, "t1"))
    rows = docs.select(row.alias("row"), text.alias("text"), *keys)

    def cut(apart: bool):
        """Over texts with their spans; apart: over all rows, for those that can't have any, so that no second worker filters them."""

        def work(batches):
            for b in batches:
                if apart:
                    b = b.filter(pa.array(~in_table(table.value, b.column(2).to_numpy().view(np.uint64))))
                size, gone, count, left = [], [], [], []
                spans = [None] * len(b) if apart else b.column(2)
                for t, m in zip(b.column(1), spans, strict=True):
                    t = t.as_py() if t.is_valid else null
                    raw = (t or "").encode()
                    s = union_spans((x["a"], x["z"]) for x in m.as_py()) if not apart and m.is_valid else []
                    at = [0] + [y for x in s for y in x] + [len(raw)]
                    kept = b"".join(raw[x:y] for x, y in zip(at[::2], at[1::2], strict=True)) if s else raw
                    size.append(len(raw))
                    gone.append(len(raw) - len(kept))
                    count.append(len(s))
                    left.append(None if t is None else rest(raw, kept, s))
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, pa.int64()) for x in (size, gone, count)], pa.array(left, pa.string())], names=["row", "n_bytes", "n_removed", "n_spans", "rest"])
            tidy()

        return work

    kind = rows.schema["row"].dataType
    joined = by_table(rows, "t1", table, True).join(spans, ["t1", "t2"], "left").select("row", "text", "spans")
    schema = StructType([StructField("row", kind)] + [StructField(c, LongType()) for c in ("n_bytes", "n_removed", "n_spans")] + [StructField("rest", StringType())])
    return rows.mapInArrow(cut(True), schema).unionByName(joined.mapInArrow(cut(False), schema))
