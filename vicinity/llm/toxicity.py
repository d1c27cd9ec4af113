"""Toxicity: a linear-chain conditional random field that tags toxic tokens.

Token labels come from the labelled documents of a bounded sample: words and
word beginnings that only toxic documents hold are picked greedily until they
cover those documents twice, and their occurrences in toxic documents are the
toxic tokens. The field (two states, those features, their neighbours,
transitions) is trained by gradient ascent on the likelihood of windows of the
sample's texts, those about picked features and some others, so many of each at
most; forward-backward marginals
of every token of a text add up to its score through a logistic curve fitted
on the same sample, and tokens likelier toxic than not are its spans.

Null and empty texts, and texts without tokens, get the score of no evidence
and no spans. Very long texts are scored whole. Rows, ties and repeated rows
pass one to one; of the texts of one labelled id the least is learned from. An
empty table or a sample without both labels scores 0; further columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinity.llm.crf import chain_expectations, chain_marginals
from vicinity.llm.text import _LOWER, BASE, flat, letter_runs, mix, prefix_sums, range_hashes, row_of, shipped, steps, tidy

#: Sizes of the word beginnings that serve as features, in bytes; 0 is the whole word.
PREFIXES = (0, 3, 4, 5, 6, 7)
#: The fit uses so many labelled documents of each label at most, the first by hash of their id.
SAMPLE_DOCS = 1500
#: Features picked at most.
FEATURES = 400
#: The field is trained on so many windows of WINDOW tokens that hold a picked feature, and so many that don't, at most, drawn at random.
WINDOW = 16
WINDOWS_WITH, WINDOWS_WITHOUT = 25_000, 6_000


def _kind(s: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int) -> np.ndarray:
    h = range_hashes(s, lo, np.minimum(lo + k, hi) if k else hi, BASE) ^ np.uint64(k)
    h[hi - lo <= k] = 0
    return h


def token_features(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[np.ndarray]:
    """For each of PREFIXES, a hash of every token; 0 where the token is no longer than the beginning."""
    s = prefix_sums(_LOWER[data], BASE)
    for k in PREFIXES:
        yield _kind(s, lo, hi, k)


def _parts(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of some texts at a time: the first one's number, their bytes, tokens' starts and ends, and each text's first token."""
    for i, j in steps(offs):
        d = data[offs[i] : offs[j]]
        yield i, d, *letter_runs(d, offs[i : j + 1] - offs[i])


def _held(data: np.ndarray, offs: np.ndarray, k: int, keys: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of a feature of kind k, one of the sorted keys if given, and a text that holds it; temporaries are of some texts only."""
    found = [(np.zeros(0, np.uint64), np.zeros(0, np.int32))]
    for i, d, lo, hi, first in _parts(data, offs):
        h = _kind(prefix_sums(_LOWER[d], BASE), lo, hi, k)
        t = np.repeat(np.arange(i, i + len(first) - 1, dtype=np.int32), np.diff(first))
        ok = h != 0 if keys is None else keys[np.minimum(np.searchsorted(keys, h), len(keys) - 1)] == h
        h, t = h[ok], t[ok]
        _, at = np.unique(mix(h) ^ mix(t.astype(np.uint64)), return_index=True)
        found.append((h[at], t[at]))
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


class Model:
    """Picked features and their weights, transitions, and the curve from marginals to a score."""

    def __init__(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.weight = np.zeros(0)
        self.bias, self.near = -8.0, 0.0
        self.trans = np.zeros((2, 2))
        self.curve = None
        self.sieve = np.zeros(1 << 16, bool)

    def pick(self, feats: Iterable[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each kind of feature, the tokens that have a picked one and its index."""
        out = []
        for h in feats:
            at = np.flatnonzero(self.sieve[h & np.uint64(0xFFFF)])
            k = np.searchsorted(self.keys, h[at])
            ok = (k < len(self.keys)) & (self.keys[np.minimum(k, len(self.keys) - 1)] == h[at]) if len(self.keys) else np.zeros(0, bool)
            out.append((at[ok], k[ok]))
        return out

    def design(self, n: int, first: np.ndarray, picked) -> tuple[np.ndarray, np.ndarray]:
        """Each token's summed weights, and whether a neighbour has a picked feature."""
        u, has = np.zeros(n), np.zeros(n, bool)
        for at, k in picked:
            np.add.at(u, at, self.weight[k])
            has[at] = True
        near = np.zeros(n, bool)
        near[1:] |= has[:-1]
        near[:-1] |= has[1:]
        starts = first[:-1][np.diff(first) > 0]
        ends = first[1:][np.diff(first) > 0] - 1
        # no neighbour over a text's border
        s = starts[starts > 0]
        near[s] = np.where(s + 1 < n, has[np.minimum(s + 1, n - 1)], False)
        e = ends[ends < n - 1]
        near[e] = np.where(e > 0, has[np.maximum(e - 1, 0)], False)
        return u, near

    def marginals(self, data: np.ndarray, offs: np.ndarray):
        lo, hi, first = letter_runs(data, offs)
        u, near = self.design(len(lo), first, self.pick(token_features(data, lo, hi)))
        return lo, hi, first, chain_marginals(u + self.bias + self.near * near, first, self.trans)

    def evidence(self, first: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Of each text: 1, log of 1 + expected toxic tokens, the largest marginal, expected share times 100 (1 at most)."""
        n = np.diff(first)
        total = np.concatenate([[0.0], np.cumsum(p)])
        mass = total[first[1:]] - total[first[:-1]]
        top = np.zeros(len(n))
        if (n > 0).any():
            top[n > 0] = np.maximum.reduceat(p, first[:-1][n > 0])
        return np.stack([np.ones(len(n)), np.log1p(mass), top, np.minimum(1.0, 100 * mass / np.maximum(n, 1))], 1)

    def scores(self, first: np.ndarray, p: np.ndarray) -> np.ndarray:
        if self.curve is None:
            return np.zeros(len(first) - 1)
        return 1 / (1 + np.exp(-np.clip(self.evidence(first, p) @ self.curve, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> np.ndarray:
    """Newton's method on the penalised log likelihood."""
    b = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (weight * (y - p)) - keep * b
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(keep) + 1e-9 * np.eye(len(b))
        d = np.linalg.solve(h, g)
        b = b + d * min(1.0, 5.0 / max(1e-9, np.abs(d).max()))
        if np.abs(d).max() < 1e-8:
            break
    return b


def fit(texts: list[str | None], toxic: list[int], prior: float | None = None) -> Model:
    """The model of labelled texts; one without both labels scores 0. prior: share of label 1 among all."""
    model = Model()
    uniq = dict(zip(((t or "") for t in texts), toxic, strict=True))  # copies would count as independent evidence
    texts, y = list(uniq), np.array(list(uniq.values()), np.int64)
    if not (y == 1).any() or not (y == 0).any():
        return model
    n1 = int(y.sum())
    # documents of each feature that toxic documents hold, one kind at a time, by label
    toxic_rows = np.flatnonzero(y == 1)
    of_label = [flat(pa.array([texts[i] for i in np.flatnonzero(y == k)], pa.string())) for k in (0, 1)]
    clean_each = max(1, int((y == 0).sum())) / n1
    able: list[tuple[int, int, float, np.ndarray]] = []  # key, documents, cost, toxic documents
    for kind in PREFIXES:
        h1, t1 = _held(*of_label[1], kind)
        order = np.argsort(h1, kind="stable")
        h1, t1 = h1[order], t1[order]
        k1, start, df1 = np.unique(h1, return_index=True, return_counts=True)
        k1, start, df1 = k1[df1 >= 2], start[df1 >= 2], df1[df1 >= 2]
        if not len(k1):
            continue
        df0 = np.bincount(np.searchsorted(k1, _held(*of_label[0], kind, k1)[0]), minlength=len(k1))
        for k in np.flatnonzero(df0 <= 0.02 * df1 * clean_each).tolist():
            able.append((int(k1[k]), int(df1[k]), 2.0 * df0[k] / clean_each, toxic_rows[t1[start[k] : start[k] + df1[k]]]))
    able.sort(key=lambda x: x[0])
    key, df1 = np.array([x[0] for x in able], np.uint64), [x[1] for x in able]
    cost = {k: x[2] for k, x in enumerate(able)}
    docs_of = {k: x[3] for k, x in enumerate(able)}
    del able, of_label
    chosen: list[int] = []
    cover = np.zeros(len(y), np.int64)
    for depth, least in ((1, 2.0), (2, max(3.0, 0.01 * n1))):
        while len(chosen) < FEATURES and docs_of:
            gain = {k: float((cover[d] < depth).sum()) - cost[k] for k, d in docs_of.items()}
            docs_of = {k: d for k, d in docs_of.items() if gain[k] >= min(least, 2.0)}
            best = max(docs_of, key=lambda k: (gain[k], df1[k], -int(key[k]) % (1 << 32)), default=None)
            if best is None or gain[best] < least:
                break
            chosen.append(best)
            cover[docs_of.pop(best)] += 1
    model.keys = np.sort(key[chosen])
    model.sieve[(model.keys & np.uint64(0xFFFF)).astype(np.int64)] = True
    model.weight = np.zeros(len(model.keys))
    # each text's first token, and of each kind the tokens that have a picked feature
    data, offs = flat(pa.array(texts, pa.string()))
    first, hits = np.zeros(len(y) + 1, np.int64), [[] for _ in PREFIXES]
    for i, d, lo, hi, f in _parts(data, offs):
        first[i + 1 : i + len(f)] = first[i] + f[1:]
        for (at, k), out in zip(model.pick(token_features(d, lo, hi)), hits, strict=True):
            out.append((at + first[i], k))
    picked = [tuple(np.concatenate(x) for x in zip(*out, strict=True)) for out in hits]
    del data
    # token labels, and the windows to train on; windows don't cross texts
    begin = np.concatenate([[0], np.cumsum(-(-np.diff(first) // WINDOW))])
    with_some = np.zeros(begin[-1], bool)
    for at, _ in picked:
        t = np.searchsorted(first, at, side="right") - 1
        with_some[begin[t] + (at - first[t]) // WINDOW] = True
    rng = np.random.default_rng(7)
    use = np.zeros(len(with_some), bool)
    for kind, most in ((with_some, WINDOWS_WITH), (~with_some, WINDOWS_WITHOUT)):
        use[rng.permutation(np.flatnonzero(kind))[:most]] = True
    use = np.flatnonzero(use)
    t = np.searchsorted(begin, use, side="right") - 1
    lo = first[t] + (use - begin[t]) * WINDOW
    size = np.minimum(WINDOW, first[t + 1] - lo)
    text = np.repeat(t, size)
    keep = np.arange(len(text)) + np.repeat(lo - np.cumsum(size) + size, size)
    # a sequence ends where a gap or a text ends
    cut = np.flatnonzero((np.diff(keep) != 1) | (np.diff(text) != 0)) + 1
    seq = np.concatenate([[0], cut, [len(keep)]])
    sub, z = [], np.zeros(len(keep))
    for at, k in picked:
        to = np.searchsorted(keep, at)
        ok = keep[np.minimum(to, len(keep) - 1)] == at if len(keep) else np.zeros(0, bool)
        sub.append((to[ok], k[ok]))
        z[to[ok][y[text[to[ok]]] == 1]] = 1.0
    begins = np.zeros(len(keep), bool)
    begins[seq[:-1]] = True
    inner = np.flatnonzero(~begins)
    gold = np.zeros((2, 2))
    np.add.at(gold, (z[inner - 1].astype(int), z[inner].astype(int)), 1)
    moment: dict = {}
    _, near = model.design(len(keep), seq, sub)
    for it in range(1, 61):  # Adam on the penalised log likelihood
        u, _ = model.design(len(keep), seq, sub)
        p, both = chain_expectations(u + model.bias + model.near * near, seq, model.trans)
        r = z - p
        g_w = np.zeros(len(model.keys))
        for at, k in sub:
            np.add.at(g_w, k, r[at])
        for name, g in (("weight", g_w - 0.01 * model.weight), ("bias", np.float64(r.sum())), ("near", np.float64((r * near).sum() - 0.01 * model.near)), ("trans", gold - both - 0.5 * model.trans)):
            m, v = moment.get(name, (0.0, 0.0))
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            moment[name] = m, v
            setattr(model, name, getattr(model, name) + 0.4 * (m / (1 - 0.9**it)) / (np.sqrt(v / (1 - 0.99**it)) + 1e-6))
    evidence = []
    for i, j in steps(offs):
        part = [(at[slice(*(r := np.searchsorted(at, [first[i], first[j]])))] - first[i], k[slice(*r)]) for at, k in picked]
        f = first[i : j + 1] - first[i]
        u, near = model.design(f[-1], f, part)
        evidence.append(model.evidence(f, chain_marginals(u + model.bias + model.near * near, f, model.trans)))
    share = n1 / len(y)
    prior = share if prior is None else min(max(prior, 1e-4), 1 - 1e-4)
    model.curve = logistic(np.concatenate(evidence), y, np.where(y == 1, prior / share, (1 - prior) / (1 - share)))
    return model


def fit_on_labels(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fits on labelled rows whose crc32(doc_id as text) mod 5 is not 0: the first sample_docs by hash of each label."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return Model()
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    part = [known.where(F.col("toxic") == k).orderBy(*order).limit(sample_docs) for k in (0, 1)]
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(part[0].unionByName(part[1])), "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # of an id's texts the least
    prior = n.get(1, 0) / (n.get(0, 0) + n.get(1, 0))

    def fit_sample(batches):
        t = [b for b in batches]
        if t:
            t = pa.Table.from_batches(t).sort_by([("doc_id", "ascending"), ("text", "ascending")])
            texts, toxic = t.column("text").to_pylist(), t.column("toxic").to_pylist()
            del t
            tidy()
            m = fit(texts, toxic, prior)
            del texts
            tidy()
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(m.__dict__)], pa.binary())], names=["model"])

    # one task fits on the bounded sample, in an executor's memory
    fitted = rows.repartition(1).mapInArrow(fit_sample, "model binary").first()
    model = Model()
    if fitted:
        model.__dict__.update(pickle.loads(fitted["model"]))
    return model


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, score, predicted and spans (code points from and to) of every text; no shuffle."""
    sent = shipped(docs.sparkSession, model)  # a few hundred features
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int, spans array<struct<from:int,to:int>>"

    def work(batches):
        m = sent()
        for batch in batches:
            data, offs = flat(batch.column(1))
            score, spans = np.zeros(len(offs) - 1), [[] for _ in range(len(offs) - 1)]
            for i, j in steps(offs):
                d, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                lo, hi, first, p = m.marginals(d, o)
                score[i:j] = m.scores(first, p)
                hit = np.flatnonzero(p >= 0.5)
                if len(hit):
                    points = np.concatenate([[0], np.cumsum((d & 0xC0) != 0x80)])
                    of = np.searchsorted(first, hit, side="right") - 1
                    for k, x in zip(of.tolist(), hit.tolist(), strict=True):
                        base = points[o[k]]
                        spans[i + k].append({"from": int(points[lo[x]] - base), "to": int(points[hi[x]] - base)})
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(spans, pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())])))],
                names=["doc_id", "score", "predicted", "spans"],
            )

    return docs.select("doc_id", "text").mapInArrow(work, schema)


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, whatever their columns, whose texts score below the threshold; no shuffle."""
    sent = shipped(docs.sparkSession, model)
    rows = docs.select(row_of(docs).alias("row"))
    at = docs.columns.index("text")

    def work(batches):
        m = sent()
        for batch in batches:
            data, offs = flat(pc.struct_field(batch.column(0), [at]))
            keep = np.ones(len(offs) - 1, bool)
            for i, j in steps(offs):
                _, _, first, p = m.marginals(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                keep[i:j] = m.scores(first, p) < threshold
            yield batch.filter(pa.array(keep))
        tidy()

    return rows.mapInArrow(work, rows.schema).select(*[F.col("row")[c].alias(c) for c in docs.columns])
