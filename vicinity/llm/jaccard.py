"""Similarity join of word shingle sets by signature trees; components of its links.

Sets that reach the threshold share one of the first n - ceil(t * n) + 1 of
their shingles in any common order, and more of some more; here those frequent in a sample of the
documents come last and hashes order the rest, so common lines don't make
groups. Shingles repeated among these prefixes group the candidates; equal sets
are one candidate, a group is cut where its members' sizes leave too wide a gap,
and groups of the same members are one group. Each group is searched by a dual
traversal of a signature tree: nodes hold OR-combined bitmaps and size ranges,
and a pair of nodes whose largest possible overlap is too small, or that is of
one component, is left with all below it. Signatures travel once to the task of
all groups with one least member. First the nearest pairs that connect
what signatures connect are verified on the whole sets; then all other pairs
between components that are still different. Only documents of such pairs have
their sets computed again and moved.

Groups of more than BLOCK members are split into blocks, each searched on its own
together with a few leaders of the whole group; then only members that are
outside of the group's largest component meet the other blocks.

No link between different components is lost, so components are exact.

Null and empty texts and such without words have an empty set and link with
nothing. Texts of fewer words are one shingle. Equal rows link as equal texts.
A null doc_id takes part, and gets the smallest doc_id of its component, null
if it has none. An empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vicinity.llm.components import components
from vicinity.llm.text import MIX2, Scratch, U, by_table, flat, in_table, mix, repeat_table, row_of, shingle_hashes, steps, tidy, word_hashes

#: Documents whose shingles decide which are frequent, and the frequent ones kept; both only order shingles.
SAMPLE_DOCS = 4096
SAMPLE_LEAST = 4
FREQUENT = 1 << 16
#: Percent of a set that a prefix goes beyond the least, so that a candidate must share more than one shingle.
BEYOND = 5
#: Members of a block; larger groups are split.
BLOCK = 2048
#: Members of a split group that every block of it holds.
LEADERS = 4
#: Leaders that members are compared with before the tree; share of the largest difference within which they join at once.
NEAR = 8
SURE = 0.8
#: Bytes of signatures a task gets at a time, about.
CALL_BYTES = 16 << 20
#: Bits of a signature at least, members of a leaf, and nodes of a tree node.
SIGNATURE_BITS = 2048
LEAF = 32
FAN = 8


def shingle_sets(data: np.ndarray, offs: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    h, begin = shingle_hashes(*word_hashes(data, offs), n)
    return [np.unique(h[i:j]) for i, j in zip(begin.tolist(), begin[1:].tolist(), strict=False)]


def prefix(s: np.ndarray, frequent: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The first shingles of a set, of which any set that reaches percent shares one among the first k, and k.

    Of all that are given it shares one and as many as go beyond k.
    """
    k = len(s) - -(-percent * len(s) // 100) + 1
    if len(frequent) and len(s):
        often = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s
        s = np.concatenate([s[~often], s[often]])
    return s[: k + len(s) * BEYOND // 100], k


def digest(s: np.ndarray) -> tuple[int, int]:
    return int(mix(s).sum().view(np.int64)), int(mix(s ^ U(MIX2)).sum().view(np.int64))


def signature(s: np.ndarray) -> np.ndarray:
    """The set as a bitmap of at least eight bits a shingle, in 64-bit words: SIGNATURE_BITS or a power of two times that."""
    bits = SIGNATURE_BITS
    while bits < 8 * len(s):
        bits *= 2
    out = np.zeros(bits // 64, U)
    at = mix(s) % U(bits)
    np.bitwise_or.at(out, (at >> U(6)).astype(np.int64), U(1) << (at & U(63)))
    return out


def folded(sig: np.ndarray, words: int) -> np.ndarray:
    """The bitmap of the same set in fewer words."""
    return sig if len(sig) == words else np.bitwise_or.reduce(sig.reshape(-1, words), axis=0)


def group_pairs(size: np.ndarray, sigs: list[np.ndarray], comp: np.ndarray, percent: int, cross: np.ndarray | None) -> list[tuple[int, int, int]]:
    """close_pairs of members whose bitmaps differ in width: those of a width meet the wider ones that a link can reach, folded to it."""
    width = np.array([len(x) for x in sigs])
    out = []
    for w in np.unique(width).tolist():
        own = width == w
        at = np.flatnonzero(own | ((width > w) & (percent * size <= 100 * size[own].max())))
        m = np.stack([folded(sigs[i], w) for i in at])
        for p, q, d in close_pairs(size[at], m, comp[at], percent, None if cross is None else cross[at]):
            if own[at[p]] or own[at[q]]:
                out.append((int(at[p]), int(at[q]), d))
    return out


def close_pairs(size: np.ndarray, sig: np.ndarray, comp: np.ndarray, percent: int, cross: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Pairs of different components that signatures don't exclude and the bits they differ in, by dual traversal of the signature tree.

    cross: sides of the members (0 or 1), to pair members of different sides only.
    """
    order = np.lexsort((sig[:, 0], size))
    extra = size - np.bitwise_count(sig).sum(1).astype(np.int64)  # shingles that share a bit with another
    one = lambda x: int(x[0]) if (x == x[0]).all() else -1
    # nodes: members, OR of bitmaps, least and largest size, most extra shingles, component and side if all have one
    leaves = [order[i : i + LEAF] for i in range(0, len(order), LEAF)]
    levels = [[(x, np.bitwise_or.reduce(sig[x]), int(size[x].min()), int(size[x].max()), int(extra[x].max()), one(comp[x]), -1 if cross is None else one(cross[x])) for x in leaves]]
    while len(levels[-1]) > 1:
        below = levels[-1]
        same = lambda g, k: g[0][k] if all(x[k] == g[0][k] for x in g) else -1
        levels.append([(None, np.bitwise_or.reduce([x[1] for x in g]), min(x[2] for x in g), max(x[3] for x in g), max(x[4] for x in g), same(g, 5), same(g, 6)) for g in (below[i : i + FAN] for i in range(0, len(below), FAN))])

    def possible(a, b) -> bool:
        lo, hi = (a, b) if a[3] <= b[3] else (b, a)
        if 100 * lo[3] < percent * hi[2] or (a[5] == b[5] != -1) or (a[6] == b[6] != -1):
            return False
        overlap = int(np.bitwise_count(a[1] & b[1]).sum()) + min(a[4], b[4])
        return (100 + percent) * overlap >= percent * (a[2] + b[2])

    out: list[tuple[int, int, int]] = []
    stack = [(len(levels) - 1, 0, 0)]
    while stack:
        level, i, j = stack.pop()
        a, b = levels[level][i], levels[level][j]
        if not possible(a, b):
            continue
        if not level:  # members, side by side
            x, y = a[0], b[0]
            keep = comp[x][:, None] != comp[y][None]
            if i == j:
                keep &= np.arange(len(x))[:, None] < np.arange(len(y))[None]
            if cross is not None:
                keep &= cross[x][:, None] != cross[y][None]
            keep &= (100 * size[x][:, None] >= percent * size[y][None]) & (100 * size[y][None] >= percent * size[x][:, None])
            p, q = np.nonzero(keep)
            p, q = x[p], y[q]
            for k in range(0, len(p), 1 << 12):
                u, v = p[k : k + (1 << 12)], q[k : k + (1 << 12)]
                apart = np.bitwise_count(sig[u] ^ sig[v]).sum(1).astype(np.int64)
                ok = (100 + percent) * apart <= (100 - percent) * (size[u] + size[v])
                out += zip(u[ok].tolist(), v[ok].tolist(), apart[ok].tolist(), strict=True)
            continue
        kids = lambda k: range(k * FAN, min((k + 1) * FAN, len(levels[level - 1])))
        stack += [(level - 1, x, y) for x in kids(i) for y in kids(j) if i != j or x <= y]
    return out


class Forest:
    """Which members are joined, and the pairs that joined them."""

    def __init__(self, comp: np.ndarray) -> None:
        first: dict[int, int] = {}
        self.up = [first.setdefault(int(c), i) for i, c in enumerate(comp)]
        self.pairs: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.pairs.append((i, j))
            self.up[a] = b


def search_group(at: np.ndarray, size: np.ndarray, sigs: list[np.ndarray], forest: Forest, percent: int, side: np.ndarray | None) -> None:
    """Joins the members of a group (of different sides, if given) that signatures don't exclude, nearest first."""
    roots = np.array([forest.root(i) for i in at.tolist()])
    if (roots == roots[0]).all():
        return
    if side is None and len(at) > LEAF:  # members near a leader, the largest of those that are left, are joined with it
        left = at[np.argsort(-size[at], kind="stable")]
        for _ in range(NEAR):
            if len(left) < 2:
                break
            lead, rest, apart = int(left[0]), left[1:], []
            for j in rest.tolist():
                w = min(len(sigs[lead]), len(sigs[j]))
                apart.append(int(np.bitwise_count(folded(sigs[lead], w) ^ folded(sigs[j], w)).sum()))
            close = (100 + percent) * np.array(apart) <= SURE * (100 - percent) * (size[lead] + size[rest])
            for j in rest[close].tolist():
                forest.join(lead, j)
            left = rest[~close]
        roots = np.array([forest.root(i) for i in at.tolist()])
    pairs = group_pairs(size[at], [sigs[i] for i in at.tolist()], roots, percent, side)
    for p, q, _ in sorted(pairs, key=lambda x: x[2]):
        forest.join(int(at[p]), int(at[q]))


def search_groups(percent: int, every: bool):
    """Pairs of different components within a task's groups that signatures don't exclude: all (every), or such that connect what all would.

    Both sides' columns: groups (unit, cid, side, comp), signatures (cid, n, sig).
    """

    def work(t, held):
        a, b = [], []
        if t.num_rows:
            held = held.sort_by("cid")
            names, size = held.column("cid").to_numpy(), held.column("n").to_numpy()
            sigs = [np.frombuffer(x.as_py(), U) for x in held.column("sig")]
            t = t.sort_by([("unit", "ascending"), ("side", "ascending"), ("cid", "ascending")])
            unit, side = t.column("unit").to_numpy(), t.column("side").to_numpy()
            at = np.searchsorted(names, t.column("cid").to_numpy())
            comp = names.copy()
            comp[at] = t.column("comp").to_numpy()
            forest, found = Forest(comp), set()
            cut = np.concatenate([[0], np.flatnonzero(np.diff(unit) != 0) + 1, [len(unit)]])
            for k in np.argsort(-np.diff(cut), kind="stable").tolist():  # large groups first: small ones are often within them
                i, j = int(cut[k]), int(cut[k + 1])
                x, sides = at[i:j], side[i:j] if side[j - 1] else None
                if every:
                    for p, q, _ in group_pairs(size[x], [sigs[y] for y in x.tolist()], comp[x], percent, sides):
                        found.add((int(min(x[p], x[q])), int(max(x[p], x[q]))))
                else:
                    search_group(x, size, sigs, forest, percent, sides)
            if found or forest.pairs:
                u, v = np.array(list(found) if every else forest.pairs).T
                a, b = np.minimum(names[u], names[v]), np.maximum(names[u], names[v])
        tidy()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return work


def _searched(units: DataFrame, signs: DataFrame, percent: int, every: bool) -> DataFrame:
    """Pairs of groups: units has call, unit, cid, n, side and comp; a call's signatures travel to its task once."""
    total = units.agg(F.sum("n")).first()[0] or 0
    units = units.withColumn("call", F.pmod(F.xxhash64("call"), F.lit(max(1, total // CALL_BYTES))))
    here = units.select(F.col("call").alias("of"), F.col("cid").alias("who")).distinct()
    here = here.join(signs, F.col("who") == F.col("cid")).select("of", "cid", "n", "sig")
    return units.select("call", "unit", "cid", "side", "comp").groupBy("call").cogroup(here.groupBy("of")).applyInArrow(search_groups(percent, every), "a long, b long").distinct()


def _verified(scratch: Scratch, pairs: DataFrame, docs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs that reach percent by their whole sets. texts: the text hash of each node (cid)."""
    ends = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct()
    ends = scratch.save(ends.join(texts, "cid"), "ends")  # a node's documents differ in text at most in case and spaces
    wanted = docs.sparkSession.sparkContext.broadcast(repeat_table(ends.select("text_hash"), "text_hash"))

    def sets(batches):
        seen = set()
        for b in batches:
            b = b.filter(pa.array(in_table(wanted.value, b.column(1).to_numpy().view(U))))
            data, offs = flat(b.column(0))
            for i, j in steps(offs):
                out = shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], n)
                hashes = b.column(1).slice(i, j - i).to_pylist()
                new = [k for k, h in enumerate(hashes) if h not in seen and not seen.add(h)]
                yield pa.RecordBatch.from_arrays([pa.array([hashes[k] for k in new], pa.int64()), pa.array([out[k].view(np.int64) for k in new], pa.list_(pa.int64()))], names=["h", "set"])
        tidy()

    whole = docs.select("text", F.xxhash64("text")).mapInArrow(sets, "h long, set array<long>")
    whole = scratch.save(whole.join(ends, F.col("h") == F.col("text_hash")).groupBy("cid").agg(F.first("set").alias("set")), "wanted")
    x = whole.select(F.col("cid").alias("a"), F.col("set").alias("sa"))
    y = whole.select(F.col("cid").alias("b"), F.col("set").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    links = scratch.save(pairs.join(x, "a").join(y, "b").where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b"), "links")
    scratch.drop(ends, whole)
    return links


def shingle_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row, for sets of n-word shingles that reach percent."""
    return _components(docs, n, percent).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component: that of the smallest doc_id (null last), then of the smallest hash of its text. Rows without words stay.

    Only documents with near copies (by a bit table of their texts, so a few others too) are joined with the decision; the rest don't move.
    """
    with Scratch(docs.sparkSession, "keep-one") as scratch:
        parts = _components(docs, n, percent).where("n_shingles > 0")
        least = F.min(F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id").alias("doc_id"), F.col("text_hash").alias("text_hash")))
        kept = parts.groupBy("component").agg(F.count("*").alias("rows"), least.alias("k"))
        several = scratch.save(parts.join(kept.where("rows > 1").select("component"), "component").select("text_hash").distinct(), "several")
        table = docs.sparkSession.sparkContext.broadcast(repeat_table(several, "text_hash"))
        key = F.xxhash64("doc_id", "h")
        kept = kept.select(F.col("k.doc_id").alias("doc_id"), F.col("k.text_hash").alias("h")).select(F.col("h").alias("kept_h"), key.alias("kept_k"))
        kept = scratch.save(kept, "kept", keep=True)
        text = F.col("text").cast("string")
        rows = docs.select(row_of(docs).alias("row"), F.xxhash64(text).alias("h"), "doc_id")
        maybe = by_table(rows, "h", table, True).withColumn("k", key)
        words = F.coalesce(F.regexp_count(F.col("row.text").cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
        one = maybe.join(kept, (F.col("h") == F.col("kept_h")) & (F.col("k") == F.col("kept_k")), "left_semi").groupBy("h", "k").agg(F.first("row").alias("row"))  # equal rows
        out = by_table(rows, "h", table, False).select("row").unionByName(one.where(words > 0).select("row")).unionByName(maybe.where(words == 0).select("row"))
        return out.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def _components(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, component (a set's node) and component_id of every row."""
    with Scratch(docs.sparkSession, "jaccard") as scratch:
        return _components_in(scratch, docs, n, percent)


def _components_in(scratch: Scratch, docs: DataFrame, n: int, percent: int) -> DataFrame:
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = docs.count()
    mod = max(1, rows // SAMPLE_DOCS)

    def sample(batches):
        for b in batches:
            data, offs = flat(b.column(0))
            for i, j in steps(offs):
                s = shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], n)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, U), *s]).view(np.int64))], names=["h"])

    often = docs.where(F.pmod(F.xxhash64("text"), F.lit(mod)) == 0).select("text").distinct().mapInArrow(sample, "h long").groupBy("h").count().where(f"count >= {SAMPLE_LEAST}")
    frequent = np.sort(often.orderBy(F.desc("count"), "h").limit(FREQUENT).select("h").toArrow().column("h").to_numpy().view(U))
    sent = spark.sparkContext.broadcast(frequent)

    def prefixes(batches):
        seen = set()
        for b in batches:
            data, offs = flat(b.column(0))
            for i, j in steps(offs):
                out = []
                for s in shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], n):
                    if len(s) and (k := digest(s)) not in seen:
                        seen.add(k)
                        out.append(prefix(s, sent.value, percent)[0])
                if out:
                    h, c = np.unique(np.concatenate(out), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], names=["h", "c"])
        tidy()

    repeated = scratch.save(docs.select("text").mapInArrow(prefixes, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where("c > 1").select("h"), "repeated")
    table = spark.sparkContext.broadcast(repeat_table(repeated))
    scratch.drop(repeated)

    def candidates(batches):
        seen = set()
        names = ["doc_id", "text_hash", "n", "s1", "s2", "sig", "toks"]
        kinds = [None, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
        for b in batches:
            data, offs = flat(b.column(1))
            kinds[0] = b.column(0).type
            for i, j in steps(offs):
                cols: list[list] = [b.column(0).slice(i, j - i).to_pylist(), b.column(2).slice(i, j - i).to_pylist(), [], [], [], [], []]
                for s in shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], n):
                    k = digest(s)
                    toks = np.zeros(0, U)
                    if len(s) and k not in seen:
                        seen.add(k)
                        toks, least = prefix(s, sent.value, percent)
                        again = in_table(table.value, toks)
                        toks = toks[:least][again[:least]] if again.sum() > len(toks) - least else toks[:0]
                    some = len(toks) > 0
                    for c, v in zip(cols[2:], (len(s), *k, signature(s).tobytes() if some else None, toks.view(np.int64) if some else None), strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, kinds, strict=True)], names=names)
        tidy()

    cand = scratch.save(docs.select("doc_id", "text", F.xxhash64("text")).mapInArrow(candidates, f"doc_id {id_type}, text_hash long, n long, s1 long, s2 long, sig binary, toks array<long>"), "candidates")
    classes = scratch.save(cand.where("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("least")), "classes", keep=True)
    # a set's node is the first half of its digest; the few sets that share one get another
    shared = [r["s1"] for r in classes.groupBy("s1").count().where("count > 1").select("s1").collect()]
    node = F.when(F.col("s1").isin(shared), F.xxhash64("s2", "s1")).otherwise(F.col("s1")) if shared else F.col("s1")
    met = cand.where("toks is not null").select(node.alias("cid"), "n", "text_hash", "sig", "toks")  # copies in other partitions repeat
    met = scratch.save(met.groupBy("cid").agg(*[F.first(c).alias(c) for c in ("n", "text_hash", "sig", "toks")]), "met")
    signs, texts = met.select("cid", "n", "sig"), met.select("cid", "text_hash")
    tokens = met.select("cid", "n", F.explode("toks").alias("unit"))
    # groups of the same members are one: two hashes of the members tell them
    bits = [F.bit_xor(F.xxhash64("cid", F.lit(i))).alias(f"x{i}") for i in (1, 2)]

    def distinct_groups(rows: DataFrame) -> DataFrame:
        groups = rows.groupBy("unit").agg(F.count("*").alias("m"), F.min("cid").alias("root"), *bits).where("m > 1")
        groups = groups.groupBy("m", "root", "x1", "x2").agg(F.min("unit").alias("unit")).select("unit", "m", "root")
        return rows.select("unit", "cid", "n").join(groups, "unit")

    members = scratch.save(distinct_groups(tokens), "members")
    large = F.col("m") > BLOCK
    # small groups are cut where sizes leave a gap that no link bridges
    by_size = Window.partitionBy("unit").orderBy("n", "cid")
    gap = F.coalesce((100 * F.lag("n").over(by_size) < percent * F.col("n")).cast("int"), F.lit(0))
    cut = members.where(~large).withColumn("gap", gap).withColumn("unit", F.xxhash64("unit", F.sum("gap").over(by_size)))
    small = scratch.save(distinct_groups(cut).select(F.col("root").alias("call"), "unit", "cid", "n"), "small")
    # large ones go in blocks that each hold the group's leaders
    split = members.where(large).withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")))
    some_split = not split.isEmpty()
    alone = lambda rows: rows.select("call", "unit", "cid", "n", F.lit(0).alias("side"), F.col("cid").alias("comp"))
    units = alone(small)
    if some_split:
        all_blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1))
        lead = split.withColumn("r", F.row_number().over(Window.partitionBy("unit").orderBy("cid"))).where(F.col("r") <= LEADERS).withColumn("block", all_blocks)
        parts = split.select("unit", "block", "cid", "n").unionByName(lead.select("unit", "block", "cid", "n")).distinct()
        key = F.xxhash64("unit", "block")
        units = units.unionByName(alone(parts.select(key.alias("call"), key.alias("unit"), "cid", "n")))
    pairs = scratch.save(_searched(scratch.save(units, "units"), signs, percent, False), "pairs")
    links = _verified(scratch, pairs, docs, texts, n, percent)
    final = scratch.save(components(links), "components", keep=True)
    # all other pairs of different components: within small groups, and of a large one's members outside of its largest component
    comp = F.coalesce("component", "cid").alias("comp")
    placed = small.join(final, F.col("node") == F.col("cid"), "left").select("call", "unit", "cid", "n", comp)
    mixed = placed.groupBy("unit").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 != c1").select("unit")
    units = placed.join(mixed, "unit").select("call", "unit", "cid", "n", F.lit(0).alias("side"), "comp")
    if some_split:
        placed = split.join(final, F.col("node") == F.col("cid"), "left").select("unit", "blocks", "block", "cid", "n", comp)
        most = placed.groupBy("unit", "comp").count().groupBy("unit").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"))
        placed = placed.join(most, "unit").withColumn("out", F.col("comp") != F.col("main"))
        count = placed.groupBy("unit").agg(F.count_if("out").alias("left")).where("left > 0").select("unit", F.ceil(F.col("left") / BLOCK).cast("int").alias("outs"))
        placed = placed.join(count, "unit")
        one = placed.where("out").withColumn("other", F.pmod(F.xxhash64("cid", F.lit(1)), F.col("outs"))).withColumn("block", all_blocks).withColumn("side", F.lit(0))
        two = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("outs").cast("long") - 1))).withColumn("side", F.lit(1))
        key = F.xxhash64("unit", "block", "other")
        units = units.unionByName(one.unionByName(two).select(key.alias("call"), key.alias("unit"), "cid", "n", "side", "comp"))
    others = scratch.save(_searched(scratch.save(units, "others"), signs, percent, True), "pairs")
    if not others.isEmpty():
        more = _verified(scratch, others, docs, texts, n, percent)
        if not more.isEmpty():
            final = scratch.save(components(links.unionByName(more)), "joined", keep=True)
    at = classes.join(final, final["node"] == node, "left").select("s1", "s2", "least", F.coalesce("component", node).alias("component"))
    named = at.groupBy("component").agg(F.min("least").cast("long").alias("component_id"))
    at = at.join(named, "component").select("s1", "s2", "component", "component_id")
    narrow = scratch.save(cand.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "s1", "s2"), "rows", keep=True)
    out = narrow.join(at, ["s1", "s2"], "left")
    label = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id").cast("long"))
    return out.select("doc_id", "text_hash", "n_shingles", "component", label.alias("component_id"))
