"""Benchmark decontamination by latent semantic retrieval, then common subsequences and answers.

1. Words of the documents become numbers in the vocabulary of the benchmark;
   words outside it can't be part of a match. Passages are windows of words
   a quarter of their size apart, in sizes that grow by half, so an item lies
   whole in a window of about twice its length at most (or of WINDOW words).
2. Document frequencies over all passages give the weights of a TF-IDF matrix
   of passages and vocabulary; a distributed randomised SVD (a random start,
   its product with the Gram matrix as a sum over all passages in a tree, the
   vectors from both by Nyström's formula) gives the latent space.
3. A passage and an item are candidates if their cosine reaches a threshold,
   in the latent space or in what is left of it without its leading
   directions. No
   pair is looked at that can't pass the check below because the passage holds
   too few of the item's words, each as often as the item has it at most.
4. A candidate is a leak if the longest common subsequence of words holds most
   of the item, or much of it and half of its answer, its last third.

Null and empty texts match nothing, nor do items without words. Whole texts
are searched, however long. Equal rows give equal rows; of passages that hold
an item the one of the largest share, then of the largest share of the answer,
then of the largest cosine counts. Empty tables give an
empty result; other columns are not read. The benchmark's vocabulary and
latent vectors are broadcast: some 300 bytes a distinct word and 4 a word. So
many as ITEM_BLOCK items share one space; larger benchmarks are taken in blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinity.llm.text import _LOWER, BASE, Scratch, flat, letter_runs, prefix_sums, range_hashes, shipped, steps, tidy

#: Items of one space; each block of so many has its own vocabulary and space.
ITEM_BLOCK = 500_000
#: Latent dimensions, and random ones beyond them in the range finder.
RANK, OVER = 64, 8
#: Leading dimensions that the second cosine leaves out: they tell languages and common words, which any two passages share.
COMMON = 16
#: The least cosine of a candidate.
COSINE = 0.3
#: Shares of an item's words in order of a verbatim leak and of a paraphrase; share of its answer.
VERBATIM, PARAPHRASE, ANSWER = 0.75, 0.55, 0.5
#: The smallest window, in words.
WINDOW = 24
STEP_WORDS = 1 << 16
#: Items counted together, such groups that a worker keeps ready, and candidates whose words are counted together.
ITEM_GROUP, READY, CANDIDATES = 512, 16, 1 << 13
#: Matrices that one task of the sum's tree adds.
FAN = 8


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lowered words, and each text's first."""
    lo, hi, first = letter_runs(data, offs)
    return range_hashes(prefix_sums(_LOWER[data], BASE), lo, hi, BASE), first


def lookup(vocab: np.ndarray, sieve: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places in the sorted vocabulary; -1 for words outside it."""
    out = np.full(len(h), -1, np.int32)
    at = np.flatnonzero(sieve[(h >> np.uint64(44)).astype(np.int64)])
    k = np.minimum(np.searchsorted(vocab, h[at]), len(vocab) - 1)
    ok = vocab[k] == h[at]
    out[at[ok]] = k[ok]
    return out


def windows(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text of the windows of each text with words, a quarter of their size apart."""
    n = np.diff(first)
    step = size // 4
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - size) // step)), 0)
    text = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    lo = first[text] + k * step
    return lo, np.minimum(lo + size, first[text + 1]), text


def common_subsequence(masks: dict[int, int], m: int, passage: list[int]) -> int:
    """Bits of the item's words that a longest common subsequence holds, as a mask (bit-parallel)."""
    full = v = (1 << m) - 1
    for w in passage:
        u = v & masks.get(w, 0)
        if u:
            v = ((v + u) | (v - u)) & full
    return full & ~v


class Space:
    """A block of items, its vocabulary, and what the passes over the documents have given so far."""

    def __init__(self, ids: list, texts: list[str | None]) -> None:
        data, offs = flat(pa.array(texts, pa.string()))
        h, first = words(data, offs)
        self.vocab = np.unique(h)
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.vocab >> np.uint64(44)).astype(np.int64)] = True
        k = np.searchsorted(self.vocab, h)
        self.items = [(i, k[a:b].tolist()) for i, a, b in zip(ids, first.tolist(), first[1:].tolist(), strict=False) if b > a]
        self.idf = np.ones(len(self.vocab))
        self.basis = np.zeros((len(self.vocab), 0))
        self.common = 0

    def scale(self, m: int) -> int:
        w = WINDOW
        while 3 * w < 4 * m:
            w = (w + w // 2) // 4 * 4
        return w


def _batches(batches, keys: int):
    """Key columns, word numbers and firsts of encoded documents, some at a time."""
    for b in batches:
        raw = b.column(keys)
        n = np.array([len(x.as_py()) // 4 for x in raw], np.int64)
        at = np.concatenate([[0], np.cumsum(n)])
        for i, j in steps(at, STEP_WORDS):
            ids = np.frombuffer(b"".join(x.as_py() for x in raw.slice(i, j - i)), np.int32)
            yield [b.column(c).slice(i, j - i) for c in range(keys)], ids, at[i : j + 1] - at[i]


def _sum_matrices(enc: DataFrame, fn, shape: tuple[int, int]) -> np.ndarray:
    """The sum over all partitions of a matrix of the vocabulary's size, by a tree that leaves FAN matrices at most."""

    def part(batches):
        out = np.zeros(shape)
        for _, ids, first in _batches(batches, 0):
            out += fn(ids, first)
        tidy()
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([out.astype(np.float32).tobytes()], pa.binary())], names=["g", "m"])

    def add(key, t):
        out = np.zeros(shape[0] * shape[1])
        for x in t.column("m"):
            out += np.frombuffer(x.as_buffer(), np.float32)
        return pa.table({"g": pa.array([key[0].as_py()], pa.int32()), "m": pa.array([out.astype(np.float32).tobytes()], pa.binary())})

    rows, n = enc.select("words").mapInArrow(part, "g int, m binary"), enc.rdd.getNumPartitions()
    while n > FAN:
        n = -(-n // FAN)
        rows = rows.select((F.col("g") % n).alias("g"), "m").groupBy("g").applyInArrow(add, "g int, m binary")
    out = np.zeros(shape[0] * shape[1])
    for r in rows.toLocalIterator():
        out += np.frombuffer(r["m"], np.float32)
    return out.reshape(shape)


def _statistics_windows(ids: np.ndarray, first: np.ndarray):
    """Words of the vocabulary and the number of the passage they are in: windows side by side."""
    n = np.diff(first)
    text = np.repeat(np.arange(len(n)), n)
    at = np.flatnonzero(ids >= 0)
    count = -(-n // (2 * WINDOW))
    base = np.cumsum(count) - count
    return ids[at], base[text[at]] + (at - first[text[at]]) // (2 * WINDOW)


def frequencies(ids: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    w, p = _statistics_windows(ids, first)
    out = np.zeros((size + 1, 1))
    key = np.unique(p.astype(np.int64) * size + w)
    out[:size, 0] = np.bincount(key % size, minlength=size)
    out[size, 0] = len(np.unique(p))
    return out


def gram_product(ids: np.ndarray, first: np.ndarray, scaled: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The share of these passages in A'(A X); scaled: idf times X."""
    out = np.zeros(scaled.shape)
    w, p = _statistics_windows(ids, first)
    if not len(w):
        return out
    start = np.flatnonzero(np.concatenate([[True], np.diff(p) != 0]))
    y = np.add.reduceat(scaled[w], start, axis=0)
    of = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(w))))
    by = np.argsort(w, kind="stable")
    cut = np.flatnonzero(np.concatenate([[True], np.diff(w[by]) != 0]))
    out[w[by][cut]] = np.add.reduceat(y[of[by]], cut, axis=0) * idf[w[by][cut]][:, None]
    return out


def singular_vectors(start: np.ndarray, product: np.ndarray, rank: int) -> np.ndarray:
    """Leading right singular vectors of A from A'A times an orthonormal start (Nyström), in one pass over A."""
    shift = 1e-7 * np.linalg.norm(product)
    shifted = product + shift * start
    core = start.T @ shifted
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    keep = values > 1e-9 * max(values.max(initial=0.0), 1e-30)
    factor = shifted @ (vectors[:, keep] / np.sqrt(values[keep]))
    return np.linalg.svd(factor, full_matrices=False)[0][:, :rank]


def fit_space(enc: DataFrame, space: Space, rank: int = RANK, passes: int = 1, seed: int = 5) -> None:
    """Weights and latent basis from all passages."""
    n = len(space.vocab)
    df = _sum_matrices(enc, lambda i, f: frequencies(i, f, n), (n + 1, 1))[:, 0]
    space.idf = idf = np.log((1 + df[n]) / (1 + df[:n])) + 0.1
    wide = min(n, rank + OVER)
    start = product = np.random.default_rng(seed).standard_normal((n, wide))
    for _ in range(passes):  # subspace iteration
        start = np.linalg.qr(product)[0]
        scaled = (idf[:, None] * start).astype(np.float32)
        product = _sum_matrices(enc, lambda i, f, x=scaled: gram_product(i, f, x, idf), (n, wide))
    space.basis = singular_vectors(start, product, rank)
    space.common = min(COMMON, n // 32)


class Search:
    """Candidate search and checks of encoded documents."""

    def __init__(self, space: Space, cosine: float) -> None:
        self.common, self.cosine = space.common, cosine
        f = (space.idf[:, None] * space.basis).astype(np.float32)
        self.features = np.vstack([f, np.zeros((1, f.shape[1]), np.float32)])  # -1 is the last row
        self.items = [(i, np.array(w, np.int32)) for i, w in space.items]
        by: dict[int, list[int]] = {}
        for k, (_, w) in enumerate(self.items):
            by.setdefault(space.scale(len(w)), []).append(k)
        self.groups = [(size, every[g : g + ITEM_GROUP]) for size, every in by.items() for g in range(0, len(every), ITEM_GROUP)]
        self.ready: dict = {}

    def group(self, number: int) -> tuple:
        """Words' places in the group's own vocabulary, how often each item has each, masks of their places in it, the least words of a leak, unit vectors without and with the leading dimensions."""
        if number not in self.ready:
            while len(self.ready) >= READY:
                del self.ready[next(iter(self.ready))]
            size, items = self.groups[number]
            held = [self.items[k][1] for k in items]
            own = np.unique(np.concatenate(held))
            place = np.full(len(self.features), len(own), np.int32)  # the last: of no item here
            place[own] = np.arange(len(own))
            times = np.zeros((len(own) + 1, len(items)), np.uint8 if size < 256 else np.int32)
            masks: list[dict[int, int]] = []
            for c, w in enumerate(held):
                np.add.at(times[:, c], place[w], 1)
                masks.append({})
                for i, x in enumerate(w.tolist()):
                    masks[-1][x] = masks[-1].get(x, 0) | 1 << i
            least = np.array([-int(-(len(w) * PARAPHRASE - 1e-9) // 1) for w in held])
            whole = np.stack([self.features[w].sum(0) for w in held])
            rest = whole[:, self.common :]
            unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
            self.ready[number] = place, times, masks, least, unit(rest), unit(whole)
        return self.ready[number]

    def cosines(self, passages: np.ndarray, items: np.ndarray, rest: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """The larger cosine of each passage (rows of words, -1 for none) and item."""
        x = self.features[passages].sum(1)
        norm = lambda v: np.maximum(np.linalg.norm(v, axis=1), 1e-6)
        less = x[:, self.common :]
        return np.maximum((less * rest[items]).sum(1) / norm(less), (x * whole[items]).sum(1) / norm(x))

    def leaks(self, ids: np.ndarray, first: np.ndarray):
        """text, item, cosine, share in order and share of the answer of the best passage of each leak."""
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        hits = np.concatenate([[0], np.cumsum(ids >= 0)])
        n = np.diff(first)
        for number, (size, items) in enumerate(self.groups):
            place, times, masks, least, rest, whole = self.group(number)
            # a window is four blocks of a quarter of its size, fewer at a text's end
            step = size // 4
            lo, hi, text = windows(first, size)
            some = hits[hi] - hits[lo] >= least.min()
            lo, hi, text = lo[some], hi[some], text[some]
            if not len(lo):
                continue
            base = np.concatenate([[0], np.cumsum(-(-n // step))])
            words_at = np.full(base[-1] * step, len(times) - 1, np.int32)
            words_at[np.arange(len(ids)) + np.repeat(base[:-1] * step - first[:-1], n)] = place[ids]
            member = (times > 0).view(np.uint8)
            held = np.zeros((base[-1], len(items)), times.dtype)
            for column in words_at.reshape(-1, step).T:
                held += member[column]
            block = base[text] + (lo - first[text]) // step
            count = held[block]
            for i in range(1, 4):
                inside = np.flatnonzero(lo + i * step < hi)
                count[inside] += held[block[inside] + i]
            p, q = np.nonzero(count >= least)
            for x0 in range(0, len(p), CANDIDATES):
                pc, qc = p[x0 : x0 + CANDIDATES], q[x0 : x0 + CANDIDATES]
                at = lo[pc][:, None] + np.arange(size)
                words_of = np.where(at < hi[pc][:, None], ids[np.minimum(at, len(ids) - 1)], -1)
                w = np.sort(words_of, axis=1)
                start = np.where(np.diff(w, axis=1, prepend=-2) != 0, np.arange(size), 0)
                nth = np.arange(size) - np.maximum.accumulate(start, axis=1)  # of its word in the window
                ok = np.flatnonzero((nth < times[place[w], qc[:, None]]).sum(1) >= least[qc])
                if not len(ok):
                    continue
                cosine = self.cosines(words_of[ok], qc[ok], rest, whole)
                near = cosine >= self.cosine
                for i, j, c in zip(pc[ok[near]].tolist(), qc[ok[near]].tolist(), cosine[near].tolist(), strict=True):
                    m = len(self.items[items[j]][1])
                    got = common_subsequence(masks[j], m, [x for x in ids[lo[i] : hi[i]].tolist() if x in masks[j]])
                    share = got.bit_count() / m
                    third = m - m // 3 if m >= 3 else 0
                    answer = (got >> third).bit_count() / (m - third)
                    if share >= VERBATIM or (share >= PARAPHRASE and answer >= ANSWER):
                        key = (int(text[i]), items[j])
                        best[key] = max(best.get(key, (0.0, 0.0, -1.0)), (share, answer, c))
        return [(t, self.items[k][0], c, s, a) for (t, k), (s, a, c) in sorted(best.items())]


def find_leaks(docs: DataFrame, benchmark: DataFrame, keys: tuple[str, ...] = ("doc_id",), cosine: float = -1.0) -> DataFrame:
    """keys, item_id, cosine, lcs_share, answer_share of every document and item it leaks.

    cosine is the least of a candidate. With COSINE the latent space retrieves the candidates; with -1 every pair that holds enough
    words is one, also such as share only words that all texts have.
    """
    with Scratch(docs.sparkSession, "decontam") as scratch:
        spark = docs.sparkSession
        items = scratch.save(benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null"), "items")
        blocks = max(1, -(-items.count() // ITEM_BLOCK))
        kinds = dict(docs.dtypes)
        item_type = dict(benchmark.dtypes)["item_id"]
        head = ", ".join(f"`{c}` {kinds[c]}" for c in keys)
        out = None
        for block in range(blocks):
            part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
            rows = part.orderBy("item_id", "text").collect()  # about ITEM_BLOCK items
            space = Space([r["item_id"] for r in rows], [r["text"] for r in rows])
            if not space.items:
                continue
            sent = spark.sparkContext.broadcast((space.vocab, space.sieve))

            def encode(batches, sent=sent):
                for b in batches:
                    data, offs = flat(b.column(len(keys)))
                    for i, j in steps(offs):
                        h, first = words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                        raw = lookup(*sent.value, h).tobytes()
                        at = (4 * first).tolist()
                        yield pa.RecordBatch.from_arrays([b.column(c).slice(i, j - i) for c in range(len(keys))] + [pa.array([raw[x:y] for x, y in zip(at, at[1:], strict=False)], pa.binary())], names=[*keys, "words"])
                tidy()

            enc = scratch.save(docs.select(*keys, F.col("text").cast("string")).mapInArrow(encode, f"{head}, words binary"), "words")
            fit_space(enc, space)
            search = shipped(spark, Search(space, cosine))

            def look(batches, search=search):
                for cols, ids, first in _batches(batches, len(keys)):
                    found = search().leaks(ids, first)
                    if found:
                        at = pa.array([x[0] for x in found])
                        yield pa.RecordBatch.from_arrays([c.take(at) for c in cols] + [pa.array(v) for v in list(zip(*found, strict=True))[1:]], names=[*keys, "item_id", "cosine", "lcs_share", "answer_share"])
                tidy()

            hits = scratch.save(enc.mapInArrow(look, f"{head}, item_id {item_type}, cosine double, lcs_share double, answer_share double"), "leaks", keep=True)
            scratch.drop(enc)
            out = hits if out is None else out.unionByName(hits)
        if out is None:
            return docs.select(*keys).limit(0).withColumns({"item_id": F.lit(None).cast(item_type), "cosine": F.lit(0.0), "lcs_share": F.lit(0.0), "answer_share": F.lit(0.0)})
        return out
