"""Hard cases of the training-data operators: clashing names, hot groups, broken pages, written tables that go, gradients."""

import contextlib
import hashlib
import itertools
import json
import os
import random
import re
import time
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_ops import SF, awkward, brute_components, documents, sentence

from vicinity.llm import ann, chat, crf, decontam, html_text, jaccard, licenses, queries, suffix_dedup, text, toxicity

CLASHING = ["k1", "k2", "t1", "t2", "r", "h", "k", "row", "spans", "n_bytes", "n_removed", "n_spans", "rest", "_hash", "_id", "component", "cid", "words", "item_id", "cosine", "size", "toxic", "score", "a.b"]


def clashing(df):
    return df.withColumns({c: F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in CLASHING})


# written tables


def own_folder(monkeypatch, path):
    monkeypatch.setattr(text, "shared_dir", lambda _, name, n=itertools.count(): f"{path}/{name}_{next(n)}")


def written(path):
    """The tables in a folder, without the number of each."""
    return {d.split("-", 1)[1] for p in path.iterdir() for d in os.listdir(p)}


def test_tables_go_with_their_run(spark, tmp_path, monkeypatch):
    own_folder(monkeypatch, tmp_path)
    with text.Scratch(spark, "outer"):
        with text.Scratch(spark, "inner") as inner:
            a = inner.save(spark.range(3), "a")
            b = inner.save(a.withColumn("x", F.lit(1)), "b", keep=True)
            inner.drop(a)
            inner.save(spark.range(2), "c")
            assert written(tmp_path) == {"b", "c"}
        assert b.count() == 3 and written(tmp_path) == {"b"}
    assert not written(tmp_path)
    with pytest.raises(ZeroDivisionError), text.Scratch(spark, "broken") as s:
        s.save(spark.range(1), "d", keep=True)
        raise ZeroDivisionError
    assert not written(tmp_path) and spark.conf.get(text._CLEANUP, None) in (None, "false")


def test_repeat_tables_hold_all_hashes(spark):
    h = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 400_000)
    some = spark.createDataFrame([(int(x),) for x in h[:200_000:20]], "h long")
    table = text.repeat_table(some)
    hit = text.in_table(table, h.view(np.uint64))
    assert hit[:200_000:20].all() and hit.mean() < 0.2


# 1 chat formatting


def test_chat_results_come_after_calls_and_names_clash(spark):
    call = lambda i, n, a: f'<tool_call>{{"id":"{i}","name":"{n}","arguments":{a}}}</tool_call>'
    result = lambda i, c: f'<tool_result>{{"id":"{i}","content":"{c}"}}</tool_result>'
    long = "word " * 50_000
    rows = [
        (1, 0, "tool", result("a", "early")), (1, 1, "assistant", call("a", "run", '{"code":"x"}')), (1, 2, "tool", result("a", "late")), (1, 3, "tool", result("a", "later")),
        (2, 0, "assistant", call("a", "run", '{"code":"y"}')), (2, 0, "assistant", call("a", "run", '{"code":"y"}')), (2, 1, "tool", result("b", "of nothing")),
        (3, 0, "user", long), (3, 1, "assistant", ""),
    ]
    rows += [(4, i, "assistant", call(f"c{i}", "run", f'{{"code":"$ref:c{i - 1}"}}')) for i in range(5, 0, -1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.withColumns({c: F.lit("x") for c in ("id", "name", "arguments", "level", "content", "place", "position", "json", "calls", "after")})
    schemas = spark.createDataFrame(queries.TOOLS, chat.SCHEMA_ROWS)
    got = {(r["conv_id"], r["id"]): r for r in chat.link_calls(df, schemas).collect()}
    assert (got[1, "a"]["content"], got[1, "a"]["result_turn"]) == ("late", 2) and got[2, "a"]["content"] is None
    assert {k: r["level"] for k, r in got.items() if k[0] == 4} == {(4, f"c{i}"): i - 1 for i in range(1, 6)}
    out = chat.format_chat(df, schemas).collect()
    assert len(out) == len(rows) and sum(r["json"] == f'{{"content":"{long}","role":"user"}}' for r in out) == 1


def plain_links(rows):
    """What link_calls gives: the first call of each identifier, its first result from its turn on, Kahn levels, validity."""
    tools = {}
    for name, parameter, kind, required in queries.TOOLS:
        tools.setdefault(name, {})[parameter] = (kind, required)
    calls, results = {}, {}
    for conv, turn, _, body in sorted(rows, key=lambda r: (r[0], r[1])):
        for place, j in enumerate(re.findall(r"(?s)<tool_call>(.*?)</tool_call>", body)):
            with contextlib.suppress(ValueError):
                c = json.loads(j)
                calls.setdefault((conv, c["id"]), (turn, place, c))
        for j in re.findall(r"(?s)<tool_result>(.*?)</tool_result>", body):
            r = json.loads(j)
            results.setdefault((conv, r["id"]), []).append((turn, r["content"]))
    needs = {k: {(k[0], x) for x in re.findall(r"\$ref:([A-Za-z0-9_.\-]+)", json.dumps(c["arguments"])) if (k[0], x) in calls} for k, (_, _, c) in calls.items()}
    levels, level = {}, 0
    while ready := [k for k in calls if k not in levels and needs[k] <= levels.keys()]:
        levels |= dict.fromkeys(ready, level)
        level += 1
    kinds = {"string": str, "integer": int, "number": (int, float)}
    out = {}
    for k, (turn, place, c) in calls.items():
        a, schema = c["arguments"], tools.get(c["name"])
        fine = schema is not None and a.keys() <= schema.keys() and all(isinstance(a[p], kinds[t]) if p in a else not need for p, (t, need) in schema.items())
        answer = next(((t, x) for t, x in results.get(k, []) if t >= turn), (None, None))
        out[k] = (c["name"], json.dumps(a, sort_keys=True, separators=(",", ":")), turn, place, levels.get(k, -1), "unknown" if schema is None else "valid" if fine else "invalid", *answer)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_chat_links_equal_plain_python(spark, seed):
    r = random.Random(seed)
    rows = []
    for conv in range(40):
        for turn in range(r.randint(1, 9)):
            body = "text "
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                a = {r.choice(["query", "limit", "id", "code", "timeout"]): r.choice([3, "x", f"$ref:c{r.randint(0, 6)}", f"a $ref:c{r.randint(0, 6)} $ref:c{r.randint(0, 6)}"]) for _ in range(r.randint(0, 2))}
                call = json.dumps({"id": f"c{r.randint(0, 6)}", "name": r.choice(["search", "lookup", "run", "none"]), "arguments": a})
                body += f"<tool_call>{call if r.random() < 0.9 else '{broken'}</tool_call>"
            for _ in range(r.choice([0, 0, 1, 2])):
                body += f"<tool_result>{json.dumps({'id': f'c{r.randint(0, 6)}', 'content': f'r{r.random()}'})}</tool_result>"
            rows += [(conv, turn, r.choice(["assistant", "tool"]), body)] * r.choice([1, 1, 1, 2])
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = chat.link_calls(df, spark.createDataFrame(queries.TOOLS, chat.SCHEMA_ROWS)).collect()
    mine = {(x["conv_id"], x["id"]): (x["name"], x["arguments"], x["call_turn"], x["place"], x["level"], x["validity"], x["result_turn"], x["content"]) for x in got}
    want = plain_links(rows)
    assert len(got) == len(mine) and mine == want and {-1, 0, 1} <= {x[4] for x in want.values()}


# 3 nearest neighbours


@pytest.mark.parametrize(("n", "kind"), [(30, "even"), (3000, "even"), (3000, "clustered"), (25_000, "even")])
def test_forest_reaches_its_recall_at_any_size(spark, n, kind):
    rng = np.random.default_rng(n)
    v = rng.standard_normal((n, 24)).astype(np.float32)
    if kind == "clustered":
        v = (rng.standard_normal((20, 24))[rng.integers(0, 20, n)] + 0.05 * v).astype(np.float32)
    v[n // 2 : n // 2 + n // 20] = v[0]
    df = spark.createDataFrame(pa.table({"vec_id": pa.array(np.arange(n)), "embedding": pa.array(list(v), pa.list_(pa.float32()))}))
    every = max(1, n // 60)
    got = ann.nearest(df, every=every, k=10, recall=0.96).toPandas().sort_values(["query_id", "rank"])
    asked = np.arange(0, n, every)
    assert (got.groupby("query_id").size() == min(10, n - 1)).all() and got["query_id"].nunique() == len(asked)
    x, hit = v.astype(float), 0
    for q, rows in got.groupby("query_id"):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(n), d)).tolist() if i != q][:10]
        assert np.allclose(d[rows["vec_id"]], rows["score"], rtol=0, atol=1e-12) and rows["score"].is_monotonic_increasing
        hit += len(set(want) & set(rows["vec_id"]))
    assert hit >= 0.9 * min(10, n - 1) * len(asked)


# 4 licenses


def test_many_templates_take_several_scans(spark, monkeypatch):
    r = random.Random(9)
    monkeypatch.setattr(licenses, "MOST_SHINGLES", 40)
    docs = clashing(documents(spark, [(i, f"{sentence(r)} {t} {sentence(r)}") for i, (_, t) in enumerate(licenses.TEMPLATES)] + [(90, None), (91, ""), (92, "pd here")]))
    templates = licenses.default_templates(spark).unionByName(spark.createDataFrame([("pd", "PD")], "template string, text string"))
    got = licenses.scan_licenses(docs, templates).collect()
    assert {(x["doc_id"], x["template"]) for x in got} >= {(i, n) for i, (n, _) in enumerate(licenses.TEMPLATES)} | {(92, "pd")}
    monkeypatch.undo()
    want = licenses.scan_licenses(docs, templates).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


# 5 decontamination


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_latent_retrieval_loses_no_leak_of_the_tables(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    near = decontam.find_leaks(docs, bench, cosine=decontam.COSINE)
    every = decontam.find_leaks(docs, bench)
    pairs = lambda df: sorted((r["doc_id"], r["item_id"]) for r in df.collect())
    assert pairs(near) == pairs(every) and len(pairs(every)) > 10


def test_matrices_sum_over_many_partitions(spark):
    rng = np.random.default_rng(3)
    rows = [(rng.integers(-1, 9, 40).astype(np.int32).tobytes(),) for _ in range(60)]
    enc = spark.createDataFrame(rows, "words binary").repartition(23)
    got = decontam._sum_matrices(enc, lambda ids, first, count=decontam.frequencies: count(ids, first, 9), (10, 1))
    ids = [np.frombuffer(r[0], np.int32) for r in rows]
    size = 2 * decontam.WINDOW
    passages = [set(x[i : i + size][x[i : i + size] >= 0].tolist()) for x in ids for i in range(0, 40, size)]
    assert got[:9, 0].tolist() == [sum(k in p for p in passages) for k in range(9)]


def test_singular_vectors_of_one_pass():
    rng = np.random.default_rng(4)
    u, v = np.linalg.qr(rng.standard_normal((300, 40)))[0], np.linalg.qr(rng.standard_normal((50, 40)))[0]
    a = (u * 0.5 ** np.arange(40)) @ v.T
    start = np.linalg.qr(rng.standard_normal((50, 24)))[0]
    got = decontam.singular_vectors(start, a.T @ (a @ start), 8)
    assert np.allclose(got.T @ got, np.eye(8)) and np.abs(np.abs((got * v[:, :8]).sum(0)) - 1).max() < 1e-4


# 7 Jaccard join


def test_sets_of_very_different_sizes_link(spark):
    r = random.Random(3)
    w = [f"w{i}" for i in range(1253)]
    texts = [(1, " ".join(w[:513])), (2, " ".join(w)), (3, sentence(r, 40))]
    got = jaccard.shingle_components(clashing(documents(spark, texts)), 4, 40).collect()
    assert {x["doc_id"]: x["component_id"] for x in got} == {1: 1, 2: 1, 3: 3}


@pytest.mark.parametrize(("edits", "block"), [(3, 64), (6, 50), (9, 2048)])
def test_a_large_group_of_near_copies(spark, edits, block, monkeypatch):
    """Copies of one base around the threshold, some exact, and texts that share a passage with all of them."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "LEADERS", 2)
    r = random.Random(edits)
    base = sentence(r, 300).split()
    texts = []
    for i in range(260):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        texts.append((i, " ".join(w)))
    texts += [(300 + i, " ".join(base[100:140] + sentence(r, 260).split())) for i in range(120)]
    got = jaccard.shingle_components(documents(spark, texts), 4, 85)
    assert sorted(map(tuple, got.collect()), key=str) == brute_components(texts, 4, 85)


# 9 toxicity, 10 HTML: the random fields


def test_expected_pairs_are_the_gradient_of_the_partition_function():
    rng = np.random.default_rng(14)
    first = np.array([0, 4, 4, 9, 10])
    u, trans = rng.normal(0, 1, 10), rng.normal(0, 2, (2, 2))

    def log_z(t):
        out = 0.0
        for a, z in zip(first, first[1:], strict=False):
            paths = itertools.product((0, 1), repeat=int(z - a))
            out += np.log(sum(np.exp(sum(u[a + i] for i, y in enumerate(p) if y) + sum(t[x, y] for x, y in itertools.pairwise(p))) for p in paths))
        return out

    p, both = crf.chain_expectations(u, first, trans, seg=3)
    assert np.allclose(p, crf.chain_marginals(u, first, trans)) and abs(both.sum() - 7) < 1e-9
    for i, j in itertools.product((0, 1), repeat=2):
        d = np.zeros((2, 2))
        d[i, j] = 1e-5
        assert abs((log_z(trans + d) - log_z(trans - d)) / 2e-5 - both[i, j]) < 1e-6


def test_fit_chain_finds_the_likeliest_transitions():
    rng = np.random.default_rng(15)
    labels = [0]
    for _ in range(5999):
        labels.append(labels[-1] if rng.random() < 0.9 else 1 - labels[-1])
    first = np.arange(0, 6001, 20)
    w, trans = crf.fit_chain([[0]] * 6000, np.array(labels), first, 1, rounds=400, ridge=0.0)
    _, both = crf.chain_expectations(np.full(6000, w[0]), first, trans)
    stay = both[[0, 1], [0, 1]].sum() / both.sum()
    assert abs(stay - 0.9) < 0.02


def test_toxicity_of_many_equal_windows_is_bounded(monkeypatch):
    monkeypatch.setattr(toxicity, "WINDOWS_WITH", 40)
    monkeypatch.setattr(toxicity, "WINDOWS_WITHOUT", 10)
    r = random.Random(2)
    texts = [sentence(r, 60) + (" blargo" * 40 if i % 3 == 0 else "") for i in range(90)]
    model = toxicity.fit(texts, [int(i % 3 == 0) for i in range(90)])
    data, offs = text.flat(pa.array(texts))
    _, _, first, p = model.marginals(data, offs)
    assert ((model.scores(first, p) >= 0.5) == [i % 3 == 0 for i in range(90)]).all()


def test_broken_pages_take_linear_time():
    def took(page):
        began = time.perf_counter()
        html_text.leaf_blocks(page)
        return time.perf_counter() - began

    for make in (lambda n: "<p title=\"x>text " * n, lambda n: "<p a='x\">b " * n, lambda n: "<div>" * n + "deep text", lambda n: "<div>a" * n + "</p></b></section>" * n, lambda n: "<!-- a" * n, lambda n: "<" * n, lambda n: "<ul><li>x" * n):
        assert took(make(20_000)) < 3.0


def test_hidden_elements():
    names = html_text._names
    assert "hidden" not in names(' style="text-decoration:none"') and "hidden" in names(' style="color:red; display : none"') and "hidden" in names(" hidden")


#: Pages written by hand, with layouts, names and languages that the generated ones don't have; ## stands before blocks of the main text.
PAGES = [
    """<html><body><div id=wrapper><div class=kopf><a href=/>Zeitung</a><ul><li><a href=/p>Politik</a><li><a href=/k>Kultur</a></ul></div>
    <div class=artikel><h1>##Der Fluss steigt weiter an</h1><p>##Am Montag stieg der Pegel erneut, wie die Behörde mitteilte. Die Anwohner sichern ihre Keller.</p>
    <p>##Für Dienstag werden weitere Regenfälle erwartet; die Feuerwehr ist in Bereitschaft.</p></div>
    <div class=impressum>Impressum | <a href=/d>Datenschutz</a> | © 2024 Verlag</div></div></body></html>""",
    """<body><table><tr><td><a href=1>Home</a> <a href=2>Links</a> <a href=3>Guestbook</a></td></tr><tr><td><h2>##How to bind a book</h2>
    <p>##First, fold every sheet once and press the fold with a bone folder. Collect the sheets in signatures of four.</p>
    <p>##Then punch holes along the fold, and sew the signatures together with waxed thread. Let the glue dry overnight.</p></td></tr></table>
    <footer>Copyright 1999 by the webmaster</footer></body>""",
    """<body><nav class=x1><a href=a>Docs</a><a href=b>Blog</a><a href=c>Pricing</a></nav><main><h1>##Installing the tool</h1>
    <p>##Download the archive for your platform and unpack it. The tool has no dependencies, so nothing else is needed.</p><pre>##tar xf tool.tar.gz</pre>
    <ul><li>##Linux on x86 and ARM is supported.<li>##Older kernels need the compatibility build.</ul></main>
    <aside><h4>On this page</h4><ul><li><a href=#1>Install</a><li><a href=#2>Update</a></ul></aside><footer><p>Made by people. <a href=/t>Terms</a></p></footer></body>""",
    """<body><header><p>The Daily Cook</p></header><article><h1>##Soup for cold days</h1><p>##Chop the onions and let them sweat in butter until they are soft, which takes ten minutes.</p>
    <p>##Add the stock, the potatoes and a bay leaf; simmer until the potatoes fall apart.</p></article>
    <section class=comments><h3>3 comments</h3><div>I made this yesterday, and it was great!</div><div>Mine was too salty. Less stock next time.</div></section>
    <form><label>Your mail</label><input><p>Get new recipes every week.</p></form></body>""",
]


def test_pages_written_by_hand():
    number, w, trans = html_text.train()
    model = ({f: float(w[k]) for f, k in number.items()}, trans)
    right = found = given = 0
    for page in PAGES:
        want = [b[0][2:] for b in html_text.leaf_blocks(page) if b[0].startswith("##")]
        got = html_text.main_text(page.replace("##", ""), model).split("\n\n")
        right += len(set(want) & set(got))
        found += len(got)
        given += len(want)
    assert right / found >= 0.85 and right / given >= 0.85


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, got.select(*cols).collect()), key=str) == sorted(want, key=str) and want


# pipeline stages


@pytest.fixture(scope="module")
def stage_docs(spark):
    texts = awkward(11)
    r = random.Random(1)
    texts += [(400 + i, f"{sentence(r, 30)} {'grumpf ' * (i % 2) * 4}{sentence(r, 30)}") for i in range(60)]
    return texts


def test_stages_keep_clashing_columns(spark, stage_docs, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(400 + i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, stage_docs[80][1]), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    plain = documents(spark, stage_docs)
    wide = clashing(plain)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, str(tmp_path))
        assert out.columns == wide.columns
        rows = out.collect()
        for x in rows:
            assert all(x[c] == f"{c}:{x['doc_id'] if x['doc_id'] is not None else 'none'}" for c in CLASHING)
        own = ["doc_id", "text", "lang", "source", "n_chars"]
        key = lambda x: str([x[c] for c in own])
        assert sorted(map(key, rows)) == sorted(map(key, stage(spark, plain, str(tmp_path)).collect()))
        empty = stage(spark, wide.limit(0), str(tmp_path))
        assert empty.columns == wide.columns and empty.count() == 0
        ids = {x["doc_id"] for x in rows}
        assert {0, 1, 2} <= ids  # null, empty and blank texts stay
        if name == "toxicity":
            assert 401 not in ids and 400 in ids
        if name == "suffix_dedup":
            assert len(rows) == len(stage_docs) and all(x["n_chars"] == (len(x["text"]) if x["text"] is not None else None) for x in rows)
    mixed = corpus_pipeline.STAGES[-1][1](spark, wide, str(tmp_path))
    assert mixed.count() == len(stage_docs)


def test_stages_equal_brute_force(spark, stage_docs, tmp_path):
    """Near copies and repeated strings of the stages against plain Python."""
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    docs = documents(spark, stage_docs)
    kept = stages["ngram_jaccard"](spark, docs, "")
    least = {c for _, n, c in brute_components(stage_docs, 5, 80) if n}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(least | {0, 1, 2})
    raw = [(t or "").encode() for _, t in stage_docs]
    count = {}
    for b in raw:
        for a in range(len(b) - 199):
            count[b[a : a + 200]] = count.get(b[a : a + 200], 0) + 1
    want = []
    for (i, t), b in zip(stage_docs, raw, strict=True):
        gone = bytearray(len(b))
        for a in range(len(b) - 199):
            if count[b[a : a + 200]] > 1:
                gone[a : a + 200] = b"\1" * 200
        rest = bytes(x for x, y in zip(b, gone, strict=True) if not y).decode("utf-8", "ignore")
        want.append((i, None if t is None else rest))
    got = [(r["doc_id"], r["text"]) for r in stages["suffix_dedup"](spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_run_leaves_only_its_result(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    own_folder(monkeypatch, tmp_path)
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 100 and written(tmp_path) == {"mixing"}


# texts longer than a step, in every operator that reads whole texts


def test_very_long_texts(spark, monkeypatch):
    monkeypatch.setattr(text, "STEP_BYTES", 1000)
    r = random.Random(4)
    passage = sentence(r, 120)
    texts = [(1, f"{sentence(r, 3000)} {passage} {sentence(r, 3000)}"), (2, passage), (3, f"{passage} {sentence(r, 9000)}")]
    cut = {x["doc_id"]: x for x in suffix_dedup.remove_repeats(documents(spark, texts), 200, digest=True).collect()}
    assert cut[2]["n_removed"] == len(passage.encode()) and all(cut[i]["n_spans"] == 1 and cut[i]["n_removed"] >= len(passage.encode()) for i in (1, 3))
    bench = spark.createDataFrame([(7, " ".join(passage.split()[:30]))], "item_id long, text string")
    assert sorted(x["doc_id"] for x in decontam.find_leaks(documents(spark, texts), bench, cosine=decontam.COSINE).collect()) == [1, 2, 3]


def test_spans_of_a_long_text_come_from_all_its_runs(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "STEP_BYTES", 1000)
    monkeypatch.setattr(suffix_dedup, "RUN_ENTRIES", 3)
    r = random.Random(8)
    passages = [sentence(r, 120) for _ in range(6)]
    long, other = (" # ".join(x for p in ps for x in (sentence(r, 600), f"{c}{p}{c}")) for ps, c in ((passages, "<"), (passages[::-1], ">")))
    texts = [(i, f"{i}{p}{i}") for i, p in enumerate(passages)] + [(6, long), (7, other), (8, sentence(r, 3000)), (9, None)]
    texts += [(10, texts[8][1])] * 2
    count = Counter(b[a : a + 200] for _, t in texts for b in [(t or "").encode()] for a in range(len(b) - 199))
    want = []
    for i, t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for a in range(len(b) - 199):
            if count[b[a : a + 200]] > 1:
                gone[a : a + 200] = b"\1" * 200
        want.append((i, len(b), sum(gone), sum(1 for x in bytes(gone).split(b"\0") if x), hashlib.sha256(bytes(x for x, y in zip(b, gone, strict=True) if not y)).hexdigest()))
    got = suffix_dedup.remove_repeats(documents(spark, texts), 200, digest=True)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_steps_of_suffixes_are_small_and_hold_every_string():
    offs = np.cumsum([0, 3_000_000, 10, *[5000] * 400, 200, 70_000])
    starts = []
    for i, j, x, z in suffix_dedup.stretches(offs, 200):
        assert z - x <= 1 << 18
        at = np.clip(offs[i : j + 1], x, z)
        starts += [a for f, t in itertools.pairwise(at.tolist()) for a in range(f, t - 199)]
    assert starts == [a for f, t in itertools.pairwise(offs.tolist()) for a in range(f, t - 199)]


def test_least_vector_of_a_repeated_id(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 1.0]), (1, [1.0, 0.0]), (2, [5.0, 5.0])]
    for order in (rows, rows[::-1]):
        got = ann.nearest(spark.createDataFrame(order, "vec_id long, embedding array<float>"), every=100, k=1).collect()
        assert [(x["query_id"], x["vec_id"], x["score"]) for x in got] == [(0, 1, 1.0)]
