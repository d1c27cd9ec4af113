"""The training-data operators against brute force, on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import itertools
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinity.llm import ann, chat, crf, decontam, html_text, jaccard, licenses, mixing, queries, suffix_dedup, tokens, toxicity
from vicinity.llm.components import components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(r, n=12):
    return " ".join("".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(n))


def documents(spark, texts, extra=False):
    rows = [(i, t, "en", ["b", "a", None, "c"][(i or 0) % 4], len(t or "")) for i, t in texts]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({"score": F.lit(1), "spans": F.lit("x"), "k1": F.lit(2), "size": F.lit(3)}) if extra else df


def awkward(seed):
    """Texts with nulls, empty and long ones, exact and near copies, repeated rows and a null id."""
    r = random.Random(seed)
    out = [(0, None), (1, ""), (2, " \n\t"), (3, "one"), (4, "One two"), (5, "a" * 700)]
    pool = [sentence(r, r.randint(5, 60)) for _ in range(8)]
    for i in range(6, 70):
        t = " ".join(r.choice(pool) if r.random() < 0.5 else sentence(r, r.randint(1, 40)) for _ in range(r.randint(1, 5)))
        out.append((i, t))
    base = sentence(r, 200).split()
    for i in range(70, 90):
        w = list(base)
        for _ in range(r.randint(0, 8)):
            w[r.randrange(len(w))] = "changed"
        out.append((i, " ".join(w)))
    out += [(90, out[10][1]), (91, " ".join(base * 20)), out[12], (None, out[20][1])]
    return out


# 1 chat formatting


def test_chat_links_orders_and_validates(spark):
    call = lambda i, n, a: f'<tool_call>{{"id":"{i}","name":"{n}","arguments":{a}}}</tool_call>'
    rows = [
        (1, 0, "user", "hi"),
        (1, 1, "assistant", call("b", "search", '{"query":"x $ref:a","limit":3}') + call("a", "lookup", '{"id":7}') + call("a", "run", "{}")),
        (1, 2, "tool", '<tool_result>{"id":"a","content":"r1"}</tool_result><tool_result>{"id":"a","content":"later"}</tool_result>'),
        (2, 0, "assistant", call("c1", "run", '{"code":"$ref:c2"}') + call("c2", "none", '{"z":{"b":1,"a":2},"code":"$ref:c1"}') + "<tool_call>{bad</tool_call>"),
        (2, 1, "assistant", call("c3", "lookup", '{"id":"7"}') + call("c4", "search", '{"limit":1}')),
        (None, 0, None, None),
        (3, None, "user", ""),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    schemas = spark.createDataFrame(queries.TOOLS, chat.SCHEMA_ROWS)
    got = {(r["conv_id"], r["id"]): r for r in chat.link_calls(df, schemas).collect()}
    assert {k: v["level"] for k, v in got.items()} == {(1, "a"): 0, (1, "b"): 1, (2, "c1"): -1, (2, "c2"): -1, (2, "c3"): 0, (2, "c4"): 0}
    assert {k: v["validity"] for k, v in got.items()} == {(1, "a"): "valid", (1, "b"): "valid", (2, "c1"): "valid", (2, "c2"): "unknown", (2, "c3"): "invalid", (2, "c4"): "invalid"}
    assert got[1, "a"]["content"] == "r1" and got[1, "a"]["result_turn"] == 2 and got[1, "b"]["content"] is None
    assert got[1, "b"]["arguments"] == '{"limit":3,"query":"x $ref:a"}' and got[2, "c2"]["arguments"] == '{"code":"$ref:c1","z":{"a":2,"b":1}}'
    out = chat.format_chat(df, schemas)
    assert out.count() == len(rows) and chat.format_chat(df.limit(0), schemas).count() == 0
    assert {r["json"] for r in out.collect()} >= {'{"content":"hi","role":"user"}', '{"content":"","role":"unknown"}'}


def test_chat_messages_carry_their_calls(spark):
    call = lambda i, n, a: f'<tool_call>{{"id":"{i}","name":"{n}","arguments":{a}}}</tool_call>'
    text = call("b", "search", '{"query":"$ref:a","limit":3}') + call("a", "lookup", '{"id":7}') + call("a", "run", "{}") + "<tool_call>{bad</tool_call>"
    rows = [(1, 1, "assistant", text), (1, 2, "tool", '<tool_result>{"id":"a","content":"r \\"1\\""}</tool_result>'), (None, 5, "assistant", call("c", "run", "{}"))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["turn"]: r for r in chat.format_chat(df, spark.createDataFrame(queries.TOOLS, chat.SCHEMA_ROWS)).collect()}
    assert {k: (r["n_calls"], r["n_linked"], r["max_level"]) for k, r in got.items()} == {1: (4, 1, 1), 2: (0, 0, None), 5: (1, 0, None)}
    calls = '[{"arguments":{"limit":3,"query":"$ref:a"},"id":"b","level":1,"name":"search"},{"arguments":{"id":7},"id":"a","level":0,"name":"lookup","result":"r \\"1\\""},{"arguments":{},"id":"a","name":"run"},{}]'
    assert got[1]["json"].startswith('{"calls":' + calls + ',"content":"') and got[2]["json"].startswith('{"content":')
    assert got[5]["json"].startswith('{"calls":[{"arguments":{},"id":"c","name":"run"}],"content":')


# 2 token counts


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts_equal_whole_texts(spark, name):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = awkward(1) + [(100, "  a  b\n\n c <|endoftext|> d\t\x1c x y 12,3 's"), (101, "word " * 5000), (102, "é" * 3000), (103, "\n a\n")]
    got = {r["doc_id"]: r for r in tokens.count_tokens(documents(spark, texts, True), name=name, step_bytes=2000).collect()}
    if name.endswith(".json"):
        t = Tokenizer.from_file(public_tokenizers.path(name))
        count = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    else:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        count = lambda x: len(p.encode(x))
    for i, x in texts:
        r = got[i]
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((x or "").encode()), n := count(x or ""), n > 512)
    assert tokens.count_tokens(documents(spark, []), name=name).count() == 0


# 3 nearest neighbours


def test_nearest_vectors(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((600, 8)).astype(np.float32)
    v[100:160] = v[7]  # a hot vector
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] + [1.0] * 7), (1003, [None] + [1.0] * 7), (1004, [1.0]), (None, [1.0] * 8), (5, v[5].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1))
    got = defaultdict(list)
    for r in ann.nearest(df, every=20, k=10, trees=8, search=700, leaf=32).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hit = 0
    for q in range(0, 600, 20):
        d = np.sqrt(((v.astype(float) - v[q].astype(float)) ** 2).sum(1))
        want = [int(i) for i in np.lexsort((np.arange(600), d)) if i != q][:10]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 11)) and all(abs(d[i] - s) < 1e-12 for _, i, s in mine)
        assert [(s, i) for _, i, s in mine] == sorted((s, i) for _, i, s in mine)
        hit += len(set(want) & {m[1] for m in mine})
    assert hit >= 0.9 * 300 and [i for _, i, _ in sorted(got[100])] == [7, 101, 102, 103, 104, 105, 106, 107, 108, 109]
    assert ann.nearest(df.limit(0)).count() == 0
    few = ann.nearest(df.where("vec_id in (0, 1, 2)"), every=2, k=10).collect()
    assert Counter(r["query_id"] for r in few) == {0: 2, 2: 2}


@pytest.mark.parametrize("block", [10_000, 7])
def test_nearest_vectors_are_exact_whatever_the_forest_saw(spark, block, monkeypatch):
    monkeypatch.setattr(ann, "SCAN_QUERIES", block)
    v = np.random.default_rng(12).standard_normal((900, 32)).astype(np.float32)
    v[300:330] = v[10]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in ann.nearest(df, every=30, k=10, trees=2, search=40, leaf=16).collect()}
    want = {}
    for q in range(0, 900, 30):
        d = np.sqrt(((v.astype(float) - v[q].astype(float)) ** 2).sum(1))
        near = [i for i in np.lexsort((np.arange(900), d)).tolist() if i != q][:10]
        want |= {(q, r + 1): (i, d[i]) for r, i in enumerate(near)}
    assert {x: i for x, (i, _) in got.items()} == {x: i for x, (i, _) in want.items()}
    assert all(abs(got[x][1] - d) < 1e-12 for x, (_, d) in want.items())


# 4 licenses


def test_license_scan_equals_sql(spark):
    r = random.Random(3)
    notes = dict(licenses.TEMPLATES)
    texts = awkward(3) + [(200, f"{sentence(r)} {notes['mit']} {sentence(r)}"), (201, notes["mit-line"].upper()), (202, f"{sentence(r, 300)}\n{notes['apache-2.0'].replace('software', 'works', 1)}\n{sentence(r, 40)}"), (203, "Released under the"), (204, " ".join([notes["bsd"]] * 3))]
    docs = documents(spark, texts)
    got = licenses.scan_licenses(docs, licenses.default_templates(spark))
    cols = sorted(got.columns)
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({queries.ORACLES['op4_license_scan']})").fetchall()
    mine = sorted(map(tuple, got.select(*cols).collect()), key=str)
    assert mine == sorted(want, key=str) and {x[cols.index("doc_id")] for x in want} == {200, 201, 202, 204}
    assert licenses.scan_licenses(docs.limit(0), licenses.default_templates(spark)).count() == 0
    assert licenses.scan_licenses(docs, licenses.default_templates(spark).limit(0)).count() == 0


def test_short_templates_are_found_inside_longer_texts(spark):
    r = random.Random(8)
    texts = [(1, f"{sentence(r, 30)} MIT-licensed, {sentence(r, 50)}"), (2, "mit licensed"), (3, "mit not licensed at all here"), (4, None), (5, f"{sentence(r, 9)} All rights reserved"), (6, "PD"), (7, f"{sentence(r, 5)} pd {dict(licenses.TEMPLATES)['mit-line']}")]
    extra = spark.createDataFrame([("mit-2", "MIT licensed"), ("all", "all rights reserved"), ("pd", "PD"), ("none", "")], "template string, text string")
    got = licenses.scan_licenses(documents(spark, [*texts, texts[0]]), licenses.default_templates(spark).unionByName(extra)).collect()
    assert sorted((x["doc_id"], x["template"], x["n_shingles"], x["matched"], x["containment"]) for x in got) == [
        (1, "mit-2", 1, 1, 1.0), (2, "mit-2", 1, 1, 1.0), (5, "all", 1, 1, 1.0), (6, "pd", 1, 1, 1.0), (7, "mit-line", 1, 1, 1.0), (7, "pd", 1, 1, 1.0)
    ]
    assert {x["doc_id"]: (x["n_windows"], x["first_shingle"]) for x in got if x["template"] == "mit-2"} == {1: (2, 24), 2: (1, 0)}


# 5 decontamination


def test_common_subsequence():
    r = random.Random(4)
    for _ in range(200):
        a, b = [r.randrange(5) for _ in range(r.randint(1, 12))], [r.randrange(5) for _ in range(r.randint(0, 20))]
        masks = defaultdict(int)
        for i, x in enumerate(a):
            masks[x] |= 1 << i
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        assert decontam.common_subsequence(masks, len(a), b).bit_count() == table[-1][-1]


def test_leaks_are_found(spark):
    r = random.Random(5)
    sentence = lambda r, n: " ".join("".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.randint(3, 8))) for _ in range(n))
    items = [(i, sentence(r, r.randint(15, 50)) + ".") for i in range(12)] + [(90, None), (91, "")]
    texts = awkward(5)
    planted = {}
    for i in range(12):
        w = items[i][1].split()
        if i % 3 == 1:  # a paraphrase: some words changed, none of the last third
            for k in range(0, len(w) * 2 // 3, 4):
                w[k] = "other"
        texts.append((300 + i, f"{sentence(r, r.randint(0, 200))} {' '.join(w)} {sentence(r, 80)}"))
        planted[300 + i] = i
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("cosine", F.lit(0))
    got = decontam.find_leaks(documents(spark, texts, True), bench).collect()
    assert {(x["doc_id"], x["item_id"]) for x in got} == set(planted.items())
    assert decontam.find_leaks(documents(spark, []), bench).count() == 0
    assert decontam.find_leaks(documents(spark, texts), bench.where("text is null")).count() == 0


def test_leaks_equal_brute_force_over_all_windows(spark):
    """Items of common words in texts of common words: no gate but the shares of words may decide."""
    r = random.Random(200)
    draw = lambda n: ["".join("abcdefghij"[int(c)] for c in str(100 + min(int(r.paretovariate(0.6)), 200))) for _ in range(n)]
    items = [draw(r.randint(15, 60)) for _ in range(30)]
    docs = [draw(r.randint(100, 300)) for _ in range(60)]
    for i, item in enumerate(items):
        w = list(item)
        if i % 2:  # a paraphrase
            w[0 : len(w) * 2 // 3 : 3] = ["other"] * len(w[0 : len(w) * 2 // 3 : 3])
        docs[i][40:40] = w
    want = set()
    for k, item in enumerate(items):
        m, masks = len(item), {}
        for i, w in enumerate(item):
            masks[w] = masks.get(w, 0) | 1 << i
        size = decontam.Space([0], [" ".join(item)]).scale(m)
        for d, text in enumerate(docs):
            for a in range(0, max(1, len(text) - size + size // 4), size // 4):
                got = decontam.common_subsequence(masks, m, text[a : a + size])
                third = m - m // 3
                if got.bit_count() / m >= 0.75 or (got.bit_count() / m >= 0.55 and (got >> third).bit_count() / (m - third) >= 0.5):
                    want.add((d, k))
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = decontam.find_leaks(documents(spark, [(d, " ".join(x)) for d, x in enumerate(docs)]), bench).collect()
    assert {(x["doc_id"], x["item_id"]) for x in got} == want and want >= {(i, i) for i in range(30)}


# 6 suffix dedup


@pytest.mark.parametrize(("seed", "min_len", "run"), [(0, 200, 10_000), (1, 16, 7), (2, 40, 50), (3, 21, 10_000)])
def test_repeated_strings_equal_brute_force(spark, seed, min_len, run, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "RUN_ENTRIES", run)
    monkeypatch.setattr(suffix_dedup, "RANGE_ENTRIES", 30)
    texts = awkward(seed)
    count = Counter(b[a : a + min_len] for _, t in texts for b in [(t or "").encode()] for a in range(len(b) - min_len + 1))
    want = []
    for i, t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for a in range(len(b) - min_len + 1):
            if count[b[a : a + min_len]] > 1:
                gone[a : a + min_len] = b"\1" * min_len
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        want.append((i, len(b), sum(gone), sum(1 for j, y in enumerate(gone) if y and not (j and gone[j - 1])), hashlib.sha256(kept).hexdigest()))
    got = suffix_dedup.remove_repeats(documents(spark, texts, True), min_len, digest=True)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert suffix_dedup.remove_repeats(documents(spark, []), min_len, digest=True).count() == 0


def test_merge_runs_sorts_and_knows_common_prefixes():
    r = random.Random(6)
    for k in (1, 2, 3, 7):
        runs = [sorted(("".join(r.choice("ab") for _ in range(r.randint(0, 9))).encode(), b"", 1) for _ in range(r.randint(0, 30))) for _ in range(k)]
        out = list(suffix_dedup.merge_runs([suffix_dedup.decode_run(suffix_dedup.encode_run(x)) for x in runs]))
        text = [e[0] for _, e, _ in out]
        assert text == sorted(x[0] for y in runs for x in y)
        assert all(c == suffix_dedup.common(a, b) for a, b, (_, _, c) in zip(text, text[1:], out[1:], strict=False))


# 7 Jaccard join


def brute_components(texts, n, percent):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in texts:
        w = (t or "").translate(low).encode().split()
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    part = list(range(len(texts)))

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            part[root(j)] = root(i)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(texts):
        if d is not None:
            ids[root(i)].append(d)
    return sorted(((d, len(sets[i]), min(ids[root(i)], default=None) if sets[i] else d) for i, (d, _) in enumerate(texts)), key=str)


@pytest.mark.parametrize(("n", "percent", "block"), [(4, 85, 2048), (5, 80, 3), (2, 60, 4)])
def test_shingle_components_equal_brute_force(spark, n, percent, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "SAMPLE_LEAST", 2)
    texts = awkward(n)
    got = jaccard.shingle_components(documents(spark, texts, True), n, percent)
    assert sorted(map(tuple, got.collect()), key=str) == brute_components(texts, n, percent)
    assert jaccard.shingle_components(documents(spark, []), n, percent).count() == 0


def test_keep_one(spark):
    texts = awkward(7)
    kept = jaccard.keep_one(documents(spark, texts), 5, 80)
    want = {c for _, n, c in brute_components(texts, 5, 80) if n} | {0, 1, 2}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want) and kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_signature_tree_loses_no_pair():
    rng = np.random.default_rng(8)
    base = [rng.integers(0, 2**63, 60).astype(np.uint64) for _ in range(5)]
    sets = [np.unique(np.concatenate([b[: 60 - k], rng.integers(0, 2**63, k).astype(np.uint64)])) for b in base for k in range(0, 20, 2)]
    size, sig = np.array([len(s) for s in sets]), np.stack([jaccard.signature(s) for s in sets])
    got = {tuple(sorted(p[:2])) for p in jaccard.close_pairs(size, sig, np.arange(len(sets)), 80)}
    for i, j in itertools.combinations(range(len(sets)), 2):
        both = len(np.intersect1d(sets[i], sets[j]))
        if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            assert (i, j) in got


def test_signatures_of_several_widths(monkeypatch):
    monkeypatch.setattr(jaccard, "SIGNATURE_BITS", 64)
    rng = np.random.default_rng(13)
    base = rng.integers(0, 2**63, 70).astype(np.uint64)
    sets = [np.unique(base[:k]) for k in range(2, 71)]
    got = {tuple(sorted(p[:2])) for p in jaccard.group_pairs(np.array([len(s) for s in sets]), [jaccard.signature(s) for s in sets], np.arange(len(sets)), 85, None)}
    want = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if 100 * len(sets[i]) >= 85 * len(sets[j])}
    assert want <= got


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 105), (105, 101), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100, 105: 100}


# 8 mixing


def test_mix_meets_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 16)
    r = random.Random(9)
    rows = [(i, sentence(r, r.randint(1, 30)), "en", r.choice(["b", "a", "é", None, "z"]), 0) for i in range(400)] + [(500, None, "en", "a", 0), (501, "", "en", None, 0), (7, "x y", "en", "b", 0), (7, "x y", "en", "b", 0), (None, "q", "en", "only", 0)]
    df = spark.createDataFrame(rows, DOCS).withColumn("target", F.lit(0))
    got = mixing.mix_sources(df).collect()
    again = mixing.mix_sources(df.repartition(7)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str) and len(got) == len(rows)
    size = Counter()
    for _, t, _, s, _ in rows:
        size[s] += len((t or "").split())
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(size.values()), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * size[s]}
        for s in over or open_:
            target[s] = min(weight[s] * level, 2 * size[s])
        left -= sum(target[s] for s in over)
        open_ = open_ - over if over else set()
    taken = Counter()
    for x in got:
        assert x["taken"] == x["copies"] * x["size"] <= 2 * x["size"] and x["source_size"] == size[x["source"]]
        assert abs(x["target"] - target[x["source"]]) < 1e-6
        taken[x["source"]] += x["taken"]
    assert all(abs(taken[s] - target[s]) <= 30 for s in names)
    assert mixing.mix_sources(df.limit(0)).count() == 0


def test_pivot_keeps_sums():
    rng = np.random.default_rng(10)
    for _ in range(100):
        n = int(rng.integers(1, 30))
        f, s = rng.random(n).tolist(), rng.integers(1, 50, n).tolist()
        before = sum(a * b for a, b in zip(f, s, strict=True))
        out, held = mixing.pivot(list(f), s, rng.random)
        assert abs(sum(a * b for a, b in zip(out, s, strict=True)) - before) < 1e-6
        assert all(x in (0.0, 1.0) for i, x in enumerate(out) if i != held)


# 9 toxicity


def test_chain_marginals_and_best_path_equal_enumeration():
    rng = np.random.default_rng(11)
    first = np.array([0, 1, 5, 5, 12, 13])
    u, trans = rng.normal(0, 1, 13), rng.normal(0, 1, (2, 2))
    got = crf.chain_marginals(u, first, trans, seg=4)
    for a, z in zip(first, first[1:], strict=False):
        paths = list(itertools.product((0, 1), repeat=int(z - a)))
        score = [sum(u[a + i] for i, y in enumerate(p) if y) + sum(trans[x, y] for x, y in zip(p, p[1:], strict=False)) for p in paths]
        w = np.exp(score)
        for i in range(z - a):
            assert abs(got[a + i] - sum(w[k] for k, p in enumerate(paths) if p[i]) / w.sum()) < 1e-9
        if z > a:
            assert crf.best_path(u[a:z].tolist(), trans) == list(paths[int(np.argmax(score))])


def test_toxicity_held_out(spark):
    r = random.Random(12)
    texts, labels = [(900, None), (901, ""), (902, "...")], []
    for i in range(400):
        w = sentence(r, 40).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                w[r.randrange(40)] = r.choice(["Grumpf", "vilex,", "BLARGO"])
        texts.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    docs = documents(spark, texts + [(10, texts[13][1])], True)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit_on_labels(docs, lab)
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs, model).collect()}
    held = [i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i]["predicted"] == int(i % 4 == 0) for i in held]) > 0.97
    for i, t in texts[3:]:
        assert all(t[s["from"] : s["to"]].lower() in ("grumpf", "vilex", "blargo") for s in got[i]["spans"])
    assert 0 <= got[900]["score"] == got[901]["score"] == got[902]["score"] < 0.5
    kept = toxicity.drop_toxic(docs, model)
    assert kept.schema == docs.schema and kept.count() == sum(1 - x["predicted"] for x in toxicity.score_documents(docs, model).collect())
    assert toxicity.score_documents(docs.limit(0), model).count() == 0
    assert {x["score"] for x in toxicity.score_documents(docs, toxicity.fit_on_labels(docs, lab.limit(0))).collect()} == {0.0}


def test_toxicity_fit_holds_a_few_texts_at_a_time(monkeypatch):
    r = random.Random(3)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(3000)]
    text = lambda n, toxic: " ".join([*r.choices(words, k=n), *["grobian"] * toxic, *r.choices(words, k=9)])
    labels = [i % 3 == 0 for i in range(1200)]
    texts = [text(1100, x) for x in labels]
    size = sum(map(len, texts))
    tracemalloc.start()
    toxicity.fit(texts, [int(x) for x in labels])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 * size, (peak, size)
    # where texts are cut into parts changes nothing
    texts = [None, "", " - ", *[text(r.randint(0, 60), x) for x in labels[:200]], "", "one"]
    labels = [0, 1, 0, *map(int, labels[:200]), 0, 1]
    whole = toxicity.fit(texts, labels)
    monkeypatch.setattr(toxicity, "steps", lambda offs, steps=toxicity.steps: steps(offs, 300))
    parts = toxicity.fit(texts, labels)
    assert len(whole.keys) and (whole.keys == parts.keys).all()
    for name in ("weight", "trans", "curve", "bias", "near"):
        assert np.allclose(getattr(whole, name), getattr(parts, name), rtol=1e-6, atol=1e-9), name


# 10 HTML


def test_html_extraction(spark):
    page = "<html><head><title>T</title><script>var a='<p>no</p>'</script></head><body><nav><ul><li><a href=/>Menu</a></ul></nav><div class=cookie-notice>We use cookies to make this site better.</div><article><h1>Head &amp; line</h1><p>First para-\n graph has <b>bold</b> words.<br><p>Second &lt;one&gt; &nbsp; is here, with words.</article><div id='comments'><p>I like this very much. Me too.</p></div><footer>&copy; me</footer>"
    rows = [(1, "u1", page), (2, None, None), (3, "u3", ""), (4, "u4", "<p>unclosed <a href='x"), (5, "u5", "<!-- only a comment"), (1, "u1", page)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x"))
    got = html_text.extract(df).collect()
    want = "Head & line\n\nFirst para- graph has bold words.\n\nSecond <one> is here, with words."
    assert [r["text"] for r in got if r["page_id"] == 1] == [want, want]
    assert all(r["n_chars"] == len(r["text"]) for r in got) and {r["text"] for r in got if r["page_id"] in (2, 3, 5)} == {""}
    assert html_text.extract(df.limit(0)).count() == 0


def test_html_blocks_keep_formulas_and_fallbacks():
    page = "<body><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold.</p><p>See<object data='a'>the table</object>or<video><source src='b'>the film</video></p><p>A<svg><style>.a{}</style><text>label</text></svg><noscript>plain</noscript><script>no()</script></p></body>"
    assert [b[0] for b in html_text.leaf_blocks(page)] == ["Let x=2 hold.", "See the table or the film", "A label plain"]


def test_html_held_out_layouts():
    number, w, trans = html_text.train(400, 21)
    model = ({f: float(w[k]) for f, k in number.items()}, trans)
    maker = html_text._Maker(77)
    good = 0
    for _ in range(100):
        page = maker.page()
        want = [b[0].replace(html_text.MARK, "") for b in html_text.leaf_blocks(page) if html_text.MARK in b[0]]
        good += html_text.main_text(page.replace(html_text.MARK, ""), model) == "\n\n".join(want)
    assert good >= 90


# pipeline


def test_pipeline_stages_keep_the_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns or name == "mixing"
        docs = docs.sparkSession.createDataFrame(out.toArrow())
    assert docs.count() > 100
