"""Hand-computed cases of the retrieval operators."""

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from loomseek.functions import text as T
from loomseek.functions.vector import cosine, hash_embed, l2_normalise
from loomseek.operators import chunking, dense, families, fusion, graph, metrics, ranks, rerank, sparse
from loomseek.plans import planner
from loomseek.sources import files as src


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, want",
    [
        ("utils.handleDeeplink_v2", {"utils.handledeeplink_v2", "utils", "handledeeplink_v2", "handledeeplink", "handle", "deeplink", "v2"}),
        ("XMLHttpRequest", {"xmlhttprequest", "xml", "http", "request"}),
        ("v2", {"v2"}),
        ("", set()),
        (None, set()),
        ("naïve-Straße", {"naïve-straße", "naïve", "straße"}),
    ],
)
def test_code_terms(spark, text, want):
    assert set(one(spark, T.code_terms(F.col("t")), t=text)) == want


def test_terms_repeat_across_atoms(spark):
    assert one(spark, T.code_terms(F.col("t")), t="tool tool") == ["tool", "tool"]
    assert one(spark, T.terms_or_words(F.col("t")), t="+++ ???") == ["+++", "???"]


def test_normalised_text_and_digest(spark):
    assert one(spark, T.normalised_text(F.col("t")), t="a \r\n\r\n\r\n b\n\n") == "a\n\n b"
    a, b = one(spark, T.content_hash(F.col("t")), t="x \r\ny"), one(spark, T.content_hash(F.col("t")), t="x\ny\n")
    assert a == b and len(a) == 32


def test_callee_parts_and_bare_identifier(spark):
    name, receiver = T.callee_parts(F.col("t"))
    assert one(spark, name, t="a.b.c") == "c" and one(spark, receiver, t="a.b.c") == "a.b" and one(spark, receiver, t="c") is None
    assert one(spark, T.bare_identifier(F.col("t")), t="`resolveTool()`,") in ("resolveTool", "resolveTool()`,".strip("`,()"))


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, z array<double>")
    r = df.select(l2_normalise(F.col("a")).alias("u"), l2_normalise(F.col("z")).alias("e"), cosine(F.col("a"), F.col("z")).alias("c")).first()
    assert np.allclose(r["u"], [0.6, 0.8]) and r["e"] == [1.0, 0.0] and r["c"] == 0.0
    h = {r["k"]: r["vec"] for r in hash_embed(spark.createDataFrame([("a", "getUser"), ("b", ""), ("c", None)], "k string, t string"), "k", "t").collect()}
    assert abs(sum(x * x for x in h["a"]) - 1) < 1e-9 and h["b"] == h["c"] and h["b"][0] == 1.0


def test_dense_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    m = np.round(rng.normal(size=(300, 8)), 1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(900, None), (901, [1.0])] + [(5, m[5].tolist())], "id int, vec array<double>")
    got = rows(dense.dense_topk(df, df.filter("id < 10").withColumnRenamed("id", "query_id"), 7), "query_id", "rank", "id")
    want = []
    for q in range(10):
        order = sorted(range(300), key=lambda i: (-round(float(m[i] @ m[q]), 9), i))[:7]
        want += [(q, n + 1, i) for n, i in enumerate(order)]
    assert sorted(got) == sorted(want)
    assert dense.dense_topk(df.limit(0), df.withColumnRenamed("id", "query_id"), 3).count() == 0


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "apple apple pear"), (2, "pear"), (3, None), (4, "")], "id int, t string")
    index = sparse.build_index(docs, "id", T.terms_or_words(F.col("t")))
    q = spark.createDataFrame([(7, "apple"), (7, "apple"), (7, "missing")], "query_id int, term string")
    r = sparse.bm25_topk(index, q, 5).collect()
    idf = np.log(1 + (2 - 1 + 0.5) / (1 + 0.5))
    assert len(r) == 1 and abs(r[0]["score"] - 2 * idf * 2 / (2 + 1.2 * (0.25 + 0.75 * 3 / 2))) < 1e-8


def _padded(lists):
    out = []
    for signal, placed in lists.items():
        at = {v: k for k, v in placed.items()}
        out += [("q", signal, at.get(r, f"{signal}-{r}"), 0.0, r) for r in range(1, 12)]
    return out


def test_rrf_worked_example(spark):
    lists = {"dense": {"A": 5, "B": 1, "C": 10}, "sparse": {"A": 5, "B": 1}, "structural": {"A": 5, "C": 1}}
    df = spark.createDataFrame(_padded(lists), "query_id string, signal string, chunk_id string, score double, rank int")
    r = {x["chunk_id"]: x for x in fusion.rrf(df, {"dense": 1, "sparse": 1, "structural": 1}).collect()}
    assert [round(3 * r[k]["rrf_score"], 6) for k in "ABC"] == [0.046154, 0.032787, 0.030679]
    assert [r[k]["rank"] for k in "ABC"] == [1, 2, 3] and r["A"]["dominant_signal"] == "dense" and r["C"]["contributions"] == {"dense": 10, "structural": 1}


def test_rrf_renormalises_over_present_signals(spark):
    df = spark.createDataFrame([("q", "dense", "a", 1.0, 1), ("q", "sparse", "b", 1.0, 1), ("q", "dense", "a", 1.0, 3), ("q", "odd", "z", 1.0, 1), (None, "dense", "a", 1.0, 1)], "query_id string, signal string, chunk_id string, score double, rank int")
    w = {r["signal"]: round(r["w"], 6) for r in fusion.present_weights(fusion.best_ranks(df), {"dense": 0.6, "sparse": 0.3, "structural": 0.1}).collect()}
    assert w == {"dense": round(0.6 / 0.9, 6), "sparse": round(0.3 / 0.9, 6)}
    zero = fusion.rrf(df, {"dense": 1.0, "sparse": 0.0}).collect()
    assert [r["chunk_id"] for r in zero] == ["a"] and zero[0]["contributions"] == {"dense": 1}


def test_one_list_keeps_its_scores(spark):
    s = "query_id string, signal string, list_id int, chunk_id string, score double, rank int"
    single = fusion.merge_lists(spark.createDataFrame([("q", "d", 0, "a", 0.9, 1)], s)).first()
    assert single["score"] == 0.9
    two = fusion.merge_lists(spark.createDataFrame([("q", "d", 0, "a", 0.9, 1), ("q", "d", 1, "a", 0.1, 2)], s)).first()
    assert two["score"] == round(1 / 61 + 1 / 62, 9)


def test_metrics_by_hand(spark):
    qrels = spark.createDataFrame([("q1", "d1", 3.0), ("q1", "d2", 2.0), ("q1", "d3", 0.0), ("q1", "d4", 1.0), ("q2", "dA", 1.0)], "query_id string, doc_id string, grade double")
    run = spark.createDataFrame([("q1", "d3", 0.9), ("q1", "d1", 0.8), ("q1", "d5", 0.7), ("q1", "d2", 0.6), ("q9", "d1", 1.0), ("q1", "d1", float("nan"))], "query_id string, doc_id string, score double")
    r = {x["query_id"]: x for x in metrics.query_metrics(run, qrels, [3, 0]).collect()}
    assert set(r) == {"q1", "q2"} and r["q2"]["ndcg"] == 0
    assert [round(r["q1"][k], 6) for k in ("ndcg", "mrr", "recall", "map")] == [0.397490, 0.5, 0.333333, 0.166667]
    assert metrics.macro_metrics(run, qrels, [3]).first()["ndcg"] == round(0.39748952 / 2, 6)
    assert round(metrics.query_metrics(run, qrels, [3], True).filter("query_id = 'q1'").first()["ndcg"], 6) == 0.470202


def test_percentiles_and_rank_correlation(spark):
    df = spark.createDataFrame([("a", float(x)) for x in range(1, 21)] + [("a", None)], "g string, v double")
    assert rows(metrics.percentiles(df, ["g"], "v", {"p50": 0.5, "p95": 0.95}), "p50", "p95") == [(10.0, 19.0)]
    xy = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (2.0, 2.0), (4.0, 9.0)], "x double, y double")
    assert metrics.spearman(xy, "x", "y").first()["rho"] == 1.0


def _graph(spark):
    symbols = spark.createDataFrame(
        [(1, "r", "c1", "main", "function", "a.js", 1), (2, "r", "c2", "send", "function", "b.js", 1), (3, "r", "c3", None, "module", "c.js", 1), (4, "r", "c4", "handle_tap", "function", "c.js", 9)],
        "symbol_id int, repo string, chunk_id string, symbol string, kind string, file_path string, start_line int",
    )
    calls = spark.createDataFrame(
        [(1, "r", 1, "connect", None, 0), (2, "r", 1, "send", 2, 1), (3, "r", 1, "connect", None, 2)], "call_id int, repo string, caller_id int, callee_name string, callee_id int, call_order int"
    )
    return symbols, calls


@pytest.mark.parametrize("x, y, found", [("connect", "send", True), ("send", "connect", True), ("connect", "connect", True), ("send", "send", False)])
def test_ordered_pairs(spark, x, y, found):
    symbols, calls = _graph(spark)
    ids = spark.createDataFrame([("q", 0, x), ("q", 1, y)], "query_id string, pos int, identifier string")
    assert (graph.ordered_pairs(ids, calls, symbols).count() == 1) == found


def test_substrings_mean_themselves(spark):
    symbols, _ = _graph(spark)
    ids = spark.createDataFrame([("q", 0, "HANDLE_"), ("p", 0, "h%p"), ("o", 0, "e"), ("n", 0, "handleXtap")], "query_id string, pos int, identifier string")
    assert rows(graph.substring_hits(ids, symbols), "query_id", "chunk_id") == [("o", "c2"), ("o", "c4"), ("q", "c4")]


def test_evidence_score(spark):
    hits = spark.createDataFrame([("q", "c", "caller", "calls x"), ("q", "c", "definition", "defines x"), ("q", "c", "caller", "calls x"), ("u", "c", "ordered_pair", "no")], "query_id string, chunk_id string, evidence string, detail string")
    r = graph.fold_evidence(hits, spark.createDataFrame([("q", "structural"), ("u", "usage")], "query_id string, query_type string"), 5).collect()
    assert len(r) == 1 and round(r[0]["score"], 6) == 0.84 and r[0]["reason"] == "calls x; defines x"


def test_popular_identifiers_keep_all_their_evidence(spark):
    # the last of 9 callers by id is also a definition; with k = 2, 8 chunks were looked at
    symbols = spark.createDataFrame([(i, "r", f"c{i}", "hot" if i == 9 else f"f{i}", "function", "a.js", i) for i in range(1, 10)], "symbol_id int, repo string, chunk_id string, symbol string, kind string, file_path string, start_line int")
    calls = spark.createDataFrame([("r", i, "hot", 1, None) for i in range(1, 10)], "repo string, caller_id int, callee_name string, call_order int, callee_id int")
    imports = spark.createDataFrame([], "repo string, file_path string, module_spec string, imported_name string")
    exports = spark.createDataFrame([], "repo string, exported_name string, file_path string, symbol_id int")
    plans = spark.createDataFrame([("q", "usage", ["hot"])], "query_id string, query_type string, identifiers array<string>")
    assert [r["chunk_id"] for r in graph.structural_search(plans, symbols, calls, imports, exports, 2).orderBy("rank").collect()] == ["c9", "c1"]
    assert [r["chunk_id"] for r in graph.structural_search(plans, symbols, calls, imports, exports, 2, 8).orderBy("rank").collect()] == ["c1", "c2"]


def test_callee_resolution(spark):
    symbols = spark.createDataFrame([(1, "r", "a.js", "x"), (2, "r", "b.js", "x"), (3, "r", "b.js", "y"), (4, "r", "a.js", "z"), (5, "r", "b.js", "z"), (6, "r", "a.js", "z")], "symbol_id int, repo string, file_path string, symbol string")
    calls = spark.createDataFrame([("r", "c.js", "x"), ("r", "c.js", "y"), ("r", "a.js", "z"), ("r", "c.js", None)], "repo string, file_path string, callee_name string")
    assert rows(graph.resolved(calls, symbols), "callee_name", "callee_id") == [("x", None), ("y", 3), ("z", 4), (None, None)]


def test_module_resolution(spark):
    files = spark.createDataFrame([("r", "src/a.js"), ("r", "src/b/index.ts"), ("r", "src/c.mjs"), ("r", "src/c.ts")], "repo string, file_path string")
    specs = spark.createDataFrame([("r", "x", "a", "src/a"), ("r", "x", "b", "src/b"), ("r", "x", "c", "src/c"), ("r", "x", "d", "src/d")], "repo string, file_path string, module_spec string, target string")
    assert rows(graph.resolved_modules(specs, files), "module_spec", "resolved") == [("a", "src/a.js"), ("b", "src/b/index.ts"), ("c", "src/c.mjs"), ("d", None)]


def test_lexical_rerank_by_hand(spark):
    df = spark.createDataFrame([("a b", "a a c"), ("", "x"), ("a b", "x a b"), (None, None)], "query_text string, text string")
    r = [x["rerank_score"] for x in rerank.lexical_rerank(df).collect()]
    assert round(r[0], 5) == 0.09535 and r[1] < 0.003 and r[2] > r[0]


def test_rerank_reads_whole_documents(spark):
    df = spark.createDataFrame([("1", "alpha beta", "x " * 4000 + "alpha beta"), ("1", "alpha beta", "x " * 4000)], "query_id string, query_text string, text string")
    late, never = [x["rerank_score"] for x in rerank.lexical_rerank(df).collect()]
    assert late > never and rerank.lexical_rerank(df, longest=4096).select("rerank_score").distinct().count() == 1
    sizes = lambda **k: [x["rerank_score"] for x in rerank.model_rerank(df, lambda q, d: (d.str.len() > 4096) * 1.0, **k).collect()]
    assert min(sizes()) > 0.5 and max(sizes(longest=4096)) == 0.5


def test_model_rerank_discards_a_batch_with_nan(spark):
    df = spark.createDataFrame([("1", "q", "a"), ("1", "q", "bad"), ("2", "q", "a")], "query_id string, query_text string, text string")
    r = rerank.model_rerank(df, lambda q, d: d.map(lambda t: float("nan") if t == "bad" else 0.0))
    assert rows(r, "query_id", "rerank_score") == [("1", None), ("1", None), ("2", 0.5)]


@pytest.mark.parametrize("scores, want", [([0.36, 0.21, 0.21], True), ([0.36, 0.21, 0.20], False), ([0.34, 0.3, 0.3], False), ([], False)])
def test_sufficiency(spark, scores, want):
    df = spark.createDataFrame([("q", s, 0.01) for s in scores], "query_id string, rerank_score double, rrf_score double")
    q = spark.createDataFrame([("q",)], "query_id string")
    assert rerank.sufficiency(df, q, True).first()["sufficient"] == want
    assert rerank.sufficiency(df, q, False).first()["sufficient"] == bool(scores)


def test_ranked_list_contract(spark):
    df = spark.createDataFrame([("q", "b", 1.0), ("q", "a", 1.0), ("q", "c", float("nan")), ("q", "d", None), ("q", "e", 2.0)], "query_id string, chunk_id string, score double")
    assert rows(ranks.top_ranked(df, 2, ["query_id"]), "rank", "chunk_id") == [(1, "e"), (2, "a")]
    plan = ranks.top_ranked(df, 2, ["query_id"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_families_complete_linkage(spark):
    def vec(deg):
        return [float(np.cos(np.radians(deg))), float(np.sin(np.radians(deg)))]

    # A-B and B-C are close, A-C are not: C stays alone
    data = [("s", "f", "v3", "A", 1, 0, vec(0)), ("s", "f", "v2", "B", 1, 1, vec(16)), ("s", "f", "v1", "C", 1, 2, vec(32)), (None, "f", "v1", "D", 1, 2, None), ("s", "f", "v3", "A", 1, 0, vec(0))]
    df = spark.createDataFrame(data, "symbol string, file_path string, version_id string, chunk_id string, start_line int, version_order int, vec array<double>")
    t = families.family_table(families.build_families(df), 3)
    assert rows(t, "representative", "members", "stability") == [("A", ["A", "B"], round(2 / 3, 9)), ("C", ["C"], round(1 / 3, 9)), ("D", ["D"], round(1 / 3, 9))]


def test_stability_bonus(spark):
    df = spark.createDataFrame([(0.95, ["a", "b", "c"], 1.0), (0.5, ["a"], 0.33), (0.5, ["a", "b"], 0.5)], "base double, versions array<string>, s double")
    got = [r["x"] for r in df.select(families.stability_bonus(F.col("base"), F.col("versions"), F.col("s")).alias("x")).collect()]
    assert got == [1.0, 0.5, 0.525]


def test_diff_carry_and_blobs(spark):
    p, c = (spark.createDataFrame(d, "path string, hash string") for d in ([("a", "1"), ("b", "2"), ("c", "3")], [("a", "1"), ("b", "9"), ("d", "4")]))
    assert rows(families.diff_by_hash(p, c), "path", "status") == [("b", "modified"), ("c", "deleted"), ("d", "added")]
    d = spark.createDataFrame([("n", "R", "o"), ("k", "C", "x"), ("m", "M", None), ("z", "D", None)], "path string, status string, old_path string")
    a = families.paths_to_process(d)
    assert rows(a, "path", "action") == [("k", "chunk"), ("m", "chunk"), ("m", "drop"), ("n", "chunk"), ("o", "drop"), ("z", "drop")]
    chunks = spark.createDataFrame([("o", "1", "v1"), ("q", "2", "v1")], "file_path string, content_hash string, version_id string")
    assert rows(families.carried_over(chunks, a, "v2"), "file_path", "version_id") == [("q", "v2")]
    blobs = spark.createDataFrame([("1", "m"), ("7", "m"), ("2", "other")], "content_hash string, model_id string")
    assert rows(families.embedding_misses(chunks, blobs, "m"), "content_hash") == [("2",)]
    assert rows(families.unreferenced_blobs(blobs, chunks), "content_hash") == [("7",)]


def test_unified_diff(spark):
    df = spark.createDataFrame([("a\nb\n", "a\nc\n")], "o string, n string")
    d = df.select(families.unified_diff("o", "n").alias("d")).first()["d"]
    assert "-b" in d and "+c" in d


PLANS = [
    ("How is the input preprocessed before going to the main function?", "semantic"),
    ("Which files call preprocessInput before resolveTool?", "structural"),
    ('Where is the "bluetooth-settings" deeplink used?', "usage"),
    ("", "hybrid"),
    (None, "hybrid"),
]


def test_plans(spark):
    q = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(PLANS)], "query_id int, text string")
    p = {r["query_id"]: r for r in planner.plan_queries(q).collect()}
    assert [p[i]["query_type"] for i in range(len(PLANS))] == [k for _, k in PLANS]
    assert p[1]["identifiers"] == ["preprocessInput", "resolveTool"]
    assert p[1]["sub_queries"] == ["Which files call preprocessInput", "Which files call resolveTool", "preprocessInput before resolveTool"]
    assert p[2]["identifiers"] == ["bluetooth-settings", "bluetooth", "settings"] and "normalize" in p[0]["expansion_terms"]
    assert abs(sum(p[0]["weights"].values()) - 1) < 1e-9


def test_identifiers_claim_their_span():
    assert planner.find_identifiers("use utils.normalize and handle_tap, e.g. FOO_BAR or run (x)") == ["utils.normalize", "handle_tap", "FOO_BAR", "run"]
    assert planner.mine("where is getUser in a" + "b" * 200 + "C") == ["getUser"]


def test_chunk_text_covers_the_file():
    text = "// head\nconst a = compute(one, two, three, four, five, six);\n\n/** Doc. */\nexport function first(x) {\n  return second(x) + obj.third(x);\n}\n\nclass Box {\n  get(y) {\n    return y;\n  }\n}\n" + "function big() {\n" + "  work(alpha, beta, gamma, delta);\n" * 200 + "}\n"
    got = chunking.chunk_text(text, "a.js")
    data = text.encode()
    for c in got:
        assert data[c["start_byte"] : c["end_byte"]].decode() == c["text"]
        assert chunking.token_cost(c["text"]) <= chunking.TARGET_TOKENS
    covered = set()
    for c in got:
        covered |= set(range(c["start_line"], c["end_line"] + 1))
    assert {i + 1 for i, line in enumerate(text.split("\n")) if line.strip()} <= covered
    first = next(c for c in got if c["symbol"] == "first")
    assert first["docstring"] == "Doc." and first["is_exported"] and first["calls"] == ["second", "third"]
    assert chunking.chunk_text("", "a.js") == [] and chunking.chunk_text("   \n", "a.js") == []
    bundle = chunking.chunk_text("x=1;" * 3000, "b.js")
    assert len(bundle) > 1 and "".join(c["text"] for c in bundle) == "x=1;" * 3000


def test_chunk_files_edges(spark):
    df = spark.createDataFrame([("r", "a.js", "function f() {\n  return 1;\n}\n"), ("r", "a.js", "function f() {\n  return 1;\n}\n"), ("r", "b.js", None), ("r", "c.js", ""), (None, "d.js", "é = 1;")], "repo string, file_path string, content string")
    assert rows(chunking.chunk_files(df), "file_path", "symbol") == [("a.js", "f"), ("d.js", None)]


def test_source_tree_and_task(spark, tmp_path):
    for p in ("src/a.js", "src/b.min.js", "node_modules/c.js", "src/d.ts", "src/e.mjs"):
        (tmp_path / "repo" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "repo" / p).write_text("let x;")
    (tmp_path / "repo/src/bad.js").write_bytes(b"\xff\xfe\x00")
    got = rows(src.read_source_tree(spark, str(tmp_path / "repo"), "r"), "file_path")
    assert got == [("src/a.js",), ("src/e.mjs",)]
    task = tmp_path / "task"
    (task / "qrels").mkdir(parents=True)
    (task / "corpus.jsonl").write_text('{"_id": "1", "title": "T", "text": "x"}\n{"_id": "2", "title": "", "text": ""}\nnot json\n')
    (task / "queries.jsonl").write_text('{"_id": "q", "text": "x"}\n')
    (task / "qrels/test.tsv").write_text("query-id\tcorpus-id\tscore\nq\t1\t2\nq\t2\tx\nq\n")
    corpus, queries, qrels = src.load_task(spark, str(task))
    assert rows(corpus, "doc_id") == [("1",), ("2",)] and rows(qrels, "query_id", "doc_id", "grade") == [("q", "1", 2.0)] and queries.count() == 1
    assert rows(src.corpus_chunks(corpus), "doc_id", "text") == [("1", "T\n\nx")]
    small = src.limited_task(corpus, queries, qrels, 1)
    assert small[0].count() == 2 and small[2].count() == 1


def test_blobs_are_written_once(spark, tmp_path):
    b = spark.createDataFrame([("h", "m", 2, [1.0, 0.0]), ("bad", "m", 2, [1.0, 1.0])], "content_hash string, model_id string, dim int, vec array<double>")
    src.add_blobs(str(tmp_path / "b"), b)
    src.add_blobs(str(tmp_path / "b"), b)
    assert spark.read.parquet(str(tmp_path / "b")).count() == 1


def test_streaming_embeds_only_what_is_new(spark, tmp_path):
    from loomseek.streaming.ingest import embed_new_chunks

    chunks = spark.createDataFrame([("1", "h1", "r", "v", "let alpha"), ("2", "h1", "r", "v", "let alpha"), ("3", "h2", "r", "v", "let beta")], "chunk_id string, content_hash string, repo string, version_id string, text string")
    paths = [str(tmp_path / n) for n in ("chunks", "blobs", "checkpoint")]
    full = chunks.select(*[F.col(c.split()[0]) if c.split()[0] in chunks.columns else F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in src.CHUNK_SCHEMA.split(", ")])
    full.write.parquet(paths[0])
    embed_new_chunks(spark, *paths).awaitTermination()
    assert spark.read.parquet(paths[1]).count() == 2
    full.limit(1).withColumn("content_hash", F.lit("h3")).write.mode("append").parquet(paths[0])
    embed_new_chunks(spark, *paths).awaitTermination()
    assert spark.read.parquet(paths[1]).count() == 3


def test_pipeline_results_obey_the_contract(spark):
    from conftest import DATA

    from loomseek.reference_queries import QUERIES

    got = QUERIES["hybrid_topk"](spark, DATA).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r)
    for rs in by.values():
        rs.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rs] == list(range(1, len(rs) + 1)) and len({r["chunk_id"] for r in rs}) == len(rs)
        assert all(a["rrf_score"] >= b["rrf_score"] for a, b in zip(rs, rs[1:]))


def test_cell_index_recall(spark):
    from conftest import DATA

    from loomseek.operators import ann
    from loomseek.reference_queries import QUERIES

    assert QUERIES["ann_recall"](spark, DATA).first()["recall"] >= 0.9
    df = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(9)] + [(50, None), (51, [1.0])], "id int, vec array<double>")
    c = ann.fit_centres(df, 3)
    assert ann.cell_topk(df, df.filter("id < 2").withColumnRenamed("id", "query_id"), c, 2, 3).count() == 4


def test_registry(spark, tmp_path):
    from loomseek.plans.registry import Registry

    r = Registry(spark, str(tmp_path / "m"))
    assert r.active() is None
    with pytest.raises(LookupError):
        r.resolve()
    one = spark.createDataFrame([("v1", "h1"), ("v2", "h2")], "version_id string, content_hash string")
    r.publish("v1", one.filter("version_id = 'v1'"))
    r.publish("v2", one.filter("version_id = 'v2'"), "v1")
    assert r.active() == "v2" and r.resolve("v1") == "v1"
    r.use("v1")
    assert r.active() == "v1" and r.versions().count() == 2
    r.remove("v1")
    assert r.active() == "v2"
    blobs = spark.createDataFrame([("h1",), ("h2",)], "content_hash string")
    assert rows(r.garbage(blobs, one), "content_hash") == [("h1",)]


def test_engine(spark):
    from conftest import DATA

    from loomseek.api import Engine
    from loomseek.session import table

    e = Engine(*[table(spark, DATA, t) for t in ("chunks", "symbols", "calls", "imports", "exports")])
    name = e.index.chunks.filter("symbol IS NOT NULL").orderBy("chunk_id").first()["symbol"]
    got = e.query(f"which functions call {name}", 5, refine=False).collect()
    assert 0 < len(got) <= 5 and all(0 <= r["score"] <= 1 and r["match_reason"] for r in got)
    with pytest.raises(ValueError):
        e.query(" ")
    with pytest.raises(ValueError):
        e.query("x", 0)


def test_reindex_counts_avoided_work(spark):
    from loomseek.plans.reindex import file_hashes, reindex

    def files(d):
        return spark.createDataFrame([("r", p, c) for p, c in d.items()], "repo string, file_path string, content string")

    def body(name):
        return f"function {name}(input, options) {{\n  const value = input.items.map((x) => x.price);\n  return options.owner || value;\n}}\n"

    v1 = files({"a.js": body("alpha"), "b.js": body("beta"), "c.js": body("gamma")})
    empty_chunks = spark.createDataFrame([], "repo string, chunk_id string, content_hash string, text string, file_path string, version_id string")
    blobs = spark.createDataFrame([], "content_hash string, model_id string, dim int, vec array<double>")
    none = spark.createDataFrame([], "path string, hash string")
    one = reindex(empty_chunks, none, v1, blobs, "v1")
    assert one.report == {"chunk_count": 3, "chunks_carried": 0, "chunks_rebuilt": 3, "embed_calls": 3, "blobs_reused": 0}
    # b changes, c is renamed, a only changes its line ends
    v2 = files({"a.js": body("alpha").replace("\n", "\r\n"), "b.js": body("delta"), "moved.js": body("gamma")})
    two = reindex(one.chunks, file_hashes(v1), v2, one.new_blobs, "v2")
    assert two.report == {"chunk_count": 3, "chunks_carried": 1, "chunks_rebuilt": 2, "embed_calls": 1, "blobs_reused": 2}
    assert rows(two.chunks, "file_path", "version_id") == [("a.js", "v2"), ("b.js", "v2"), ("moved.js", "v2")]
    same = reindex(two.chunks, file_hashes(v2), v2, two.new_blobs.unionByName(one.new_blobs), "v3")
    assert same.report["embed_calls"] == 0 and same.report["chunks_carried"] == 3


def test_name_status():
    assert src.parse_name_status("A\tx.js\nR100\told.js\tnew.js\nD\tz.js\n") == [("x.js", "A", None), ("new.js", "R", "old.js"), ("z.js", "D", None)]
    assert src.parse_name_status("M\x00a b.js\x00C75\x00p\x00q\x00") == [("a b.js", "M", None), ("q", "C", "p")] and src.parse_name_status("") == []


def test_run_fence_and_restriction(spark):
    run = spark.createDataFrame([("q", "1", 1.0), ("q", "9", 0.5)], "query_id string, doc_id string, score double")
    corpus = spark.createDataFrame([("1",)], "doc_id string")
    assert rows(metrics.unknown_ids(run, corpus), "doc_id") == [("9",)]
    assert metrics.restricted(run, spark.createDataFrame([("q", "1")], "query_id string, doc_id string")).count() == 1


def test_refined_plans_differ(spark):
    q = spark.createDataFrame([("a", "how is fetchUser validated"), ("b", "plain words only")], "query_id string, text string")
    p = planner.plan_queries(q)
    r = planner.refine_plans(p, spark.createDataFrame([("a", 5)], "query_id string, n_results int"))
    got = {x["query_id"]: x for x in r.collect()}
    assert got["a"]["sub_queries"] == ["fetchUser"] and got["b"]["sub_queries"] == []
    assert {x["query_id"]: x["differs"] for x in planner.plans_differ(p, r).collect()}["a"]


# --- definitions, answers, indexes ------------------------------------------------------------------------------


def test_definitions_have_kinds_and_parents():
    text = """import {a} from './a.js';
// greets
export class Greeter extends Base {
  constructor(name) { super(); this.name = name; this.items = new Map(); this.count = 0; }
  async hello(x, y = {a: 1}) { const t = `x ${x ? `n ${y}` : '}'} /`; return /[/}]/.test(t) ? this.say(t, x, y) : null; }
  say = (t) => { console.log(t, this.name, this.count + 1, 'this is what is said'); return t.length; };
}
const util = async (q) => { function inner(z) { return z + q + call(z, q, other(z), more(q)); } return inner(q) + 1; };
export { util };
"""
    got = [(c["kind"], c["symbol"], c["parent_symbol"], c["is_exported"]) for c in chunking.chunk_text(text, "x.ts")]
    assert ("class", "Greeter", None, True) in got and ("method", "hello", "Greeter", False) in got and ("method", "say", "Greeter", False) in got
    assert ("function", "util", None, True) in got and ("function", "inner", "util", False) in got
    assert next(c for c in chunking.chunk_text(text, "x.ts") if c["symbol"] == "Greeter")["docstring"] == "greets"
    # brackets that do not match: by lines; no definition at all: one module
    broken = chunking.chunk_text(text + "function half(a) {\n  return work(a, a, a, a, a, a, a, a, a, a);\n", "x.ts")
    assert {c["kind"] for c in broken} == {"block"} and "half" in {c["symbol"] for c in broken}
    assert [c["kind"] for c in chunking.chunk_text("a = 1;\nb = 2;\n", "x.js")] == ["module"]


def test_large_definitions_are_split():
    body = "".join(f"  work{i}(alpha, beta, gamma, delta);\n" for i in range(300))
    big = chunking.chunk_text("function big(a) {\n" + body + "}\n", "x.js")
    assert [c["symbol"] for c in big] == [f"big#{n}" for n in range(1, len(big) + 1)] and {c["parent_symbol"] for c in big} == {"big"} and len(big) > 2
    assert all(chunking.token_cost(c["text"]) <= chunking.TARGET_TOKENS for c in big)
    methods = "".join(f"  /* about {i} */\n  m{i}(x) {{\n    return this.f(x, {i}, alpha, beta, gamma, delta, epsilon);\n  }}\n" for i in range(80))
    text = "class Wide {\n  field = 1;\n" + methods + "}\n"
    wide = chunking.chunk_text(text, "x.js")
    covered = set()
    for c in wide:
        covered |= set(range(c["start_byte"], c["end_byte"]))
    assert all(text[i].isspace() for i in set(range(len(text))) - covered) and wide[0]["kind"] == "class"
    many = chunking.chunk_text("".join(f"function f{i}(a, b) {{\n  return call{i}(a, b, a + b, a * b, {i});\n}}\n" for i in range(2500)), "x.js")
    assert len(many) == 2500  # no file has too many chunks


def test_imports_and_calls():
    text = """import a from './a.js';
import * as b from "b";
import './side.js';
export { c, d as e } from './c.js';
const f = require('f'), g = import('./g.js'), h = x.require('no');
// import z from 'z'
const s = "from 'not'"; from('nor');
class K { run(q) { return this.go(q, `t ${inner(1)}`); } static make(r) { } }
if (a) { b.c(d)(e); } new Thing(1); function decl(x) { } const l = async (y) => y;
"""
    words = chunking.words_of(text)
    assert chunking.imports_in(words) == ["./a.js", "b", "./side.js", "./c.js", "f", "./g.js"]
    assert chunking.calls_in(words) == ["require", "require", "from", "go", "inner", "c", "Thing"]
    assert chunking.calls_in(chunking.words_of("open(1, 'half")) == ["open"] and chunking.imports_in(chunking.words_of("")) == []


def test_definition_lines():
    for line, want in [("export default async function* go(a) {", "go"), ("class A extends B {", "A"), ("export const f = async (x) => {", "f"), ("  run(a, b) {", "run"), ("let g = y => y", "g"), ("function (", None)]:
        assert chunking.definition_of_line(line) == (True, want), line
    for line in ("if (a) {", "const a = 1;", "call(a, b);", "x.y(a) {", "functional(a);", "return function () {"):
        assert not chunking.definition_of_line(line)[0], line


CODE = [
    ("r", "v1", "c1", "h1", "export function parseToken(x) { return readStream(x); }", "src/parse.js", 1, 9, 0, 60, "parseToken", "function", None, True, ["./read.js", "lodash"], ["readStream", "", "util.trim"], "javascript"),
    ("r", "v1", "c2", "h2", "function readStream(x) { return x.length; }", "src/read.js", 1, 3, 0, 40, "readStream", "function", None, False, [], [], "javascript"),
    ("r", "v1", "c3", "h3", "const banner = 'nothing here about anything';", "src/banner.js", 1, 1, 0, 40, None, "module", None, False, ["../up/gone.js"], None, "javascript"),
]
CHUNKS = "repo string, version_id string, chunk_id string, content_hash string, text string, file_path string, start_line int, end_line int, start_byte int, end_byte int, symbol string, kind string, parent_symbol string, is_exported boolean, imports array<string>, calls array<string>, language string"


def test_relations_from_chunks(spark):
    from loomseek.operators import graph

    symbols, calls, imports, exports = graph.relations_of(spark.createDataFrame(CODE + CODE[:1], CHUNKS))
    ids = {r["chunk_id"]: r["symbol_id"] for r in symbols.collect()}
    assert len(ids) == 3 and len(set(ids.values())) == 3
    assert rows(calls, "callee_name", "call_order", "is_method", "receiver") == [("readStream", 0, False, None), ("trim", 2, True, "util")]
    assert {r["callee_id"] for r in calls.collect()} == {ids["c2"], None}
    assert rows(imports, "module_spec", "resolved_path") == [("../up/gone.js", None), ("./read.js", "src/read.js"), ("lodash", None)]
    assert rows(exports, "exported_name", "symbol_id") == [("parseToken", ids["c1"])]
    empty = graph.relations_of(spark.createDataFrame([], CHUNKS))
    assert [d.count() for d in empty] == [0, 0, 0, 0]


def test_answers_and_their_reasons(spark, tmp_path, monkeypatch):
    from loomseek.api import Engine, QueryError, format_ranked_lines
    from loomseek.plans import pipeline

    index = pipeline.Index.build(spark.createDataFrame(CODE, CHUNKS))
    index.write(spark, str(tmp_path / "i"))
    with pytest.raises(LookupError):
        pipeline.Index.open(spark, str(tmp_path / "none"))
    index = pipeline.Index.open(spark, str(tmp_path / "i"))
    queries = spark.createDataFrame([("a", "which files call readStream"), ("b", "  "), ("c", None)], "query_id string, text string")
    got = pipeline.answer(index, queries)
    assert rows(got.outcome, "query_id", "passes", "stop_reason") == [("a", 1, "sufficient"), ("b", 0, "empty_query"), ("c", 0, "empty_query")]
    best = got.results.filter("query_id = 'a'").collect()
    assert any(r["reason"] and "calls readStream" in r["reason"] for r in best) and {"plan", "pass 1", "total"} <= set(got.timings)

    low = lambda q, d: d.map(lambda _: -9.0)
    again = pipeline.answer(index, queries.filter("query_id = 'a'"), scorer=low)
    assert rows(again.outcome, "passes", "winning_pass", "stop_reason") == [(2, 1, "max_passes")]
    assert rows(pipeline.answer(index, queries.filter("query_id = 'a'"), scorer=low, seconds=0.0).outcome, "passes", "stop_reason") == [(1, "budget_exhausted")]
    with monkeypatch.context() as m:
        m.setattr(pipeline, "refine_plans", lambda plans, counts, settings: plans)
        assert rows(pipeline.answer(index, queries.filter("query_id = 'a'"), scorer=low).outcome, "passes", "stop_reason") == [(1, "no_new_query")]
    with monkeypatch.context() as m:
        real, calls = pipeline.one_pass, []

        def failing(*a, **k):
            calls.append(1)
            if len(calls) > 1:
                raise RuntimeError("lost")
            return real(*a, **k)

        m.setattr(pipeline, "one_pass", failing)
        failed = pipeline.answer(index, queries.filter("query_id = 'a'"), scorer=low)
        assert rows(failed.outcome, "passes", "stop_reason") == [(1, "pass_failed")] and failed.degradations and failed.results.count() > 0

    engine = Engine.over(index)
    reply = engine.ask("which files call readStream").envelope()
    assert reply["stop_reason"] == "sufficient" and reply["score_field"] == "rerank_score" and reply["plan"]["query_type"] == "structural"
    assert any("calls readStream" in r["match_reason"] for r in reply["results"])
    assert format_ranked_lines(engine.query("readStream"))[0].startswith("  1. ")
    for bad in ("", "   "):
        with pytest.raises(QueryError):
            engine.ask(bad)
    with pytest.raises(QueryError):
        engine.query("x", top_k=0)


def test_several_versions_are_asked_at_once(spark):
    from loomseek.api import Engine, by_family

    newer = [(r[0], "v2", r[2] + "n", r[3], *r[4:]) for r in CODE]
    engine = Engine(spark.createDataFrame(CODE + newer, CHUNKS), versions=["v1", "v2"])
    found = engine.query("readStream")
    assert {r["chunk_id"] for r in found.collect()} >= {"c1", "c2", "c1n", "c2n"}
    fam = spark.createDataFrame([(c, c[:2], ["v1", "v2"], 1.0) for c in ("c1", "c2", "c1n", "c2n")], "chunk_id string, family_id string, versions array<string>, stability double")
    one = by_family(found, fam).collect()
    assert len({r["family_id"] for r in one}) == len(one) and any(len(r["members"]) == 2 for r in one)
    vectors = engine.index["v1"].vectors.limit(0).select(F.lit("h").alias("content_hash"), "vec")
    reports = spark.createDataFrame([("r", "v1", 1), ("r", "v2", 2)], "repo string, version_id string, started_at int")
    page, total = engine.families(reports, vectors, limit=2)
    assert page.count() == 2 and total == 6


def test_search_keeps_ties_by_id(spark):
    from loomseek.operators import dense

    df = spark.createDataFrame([(f"d{i:03d}", [1.0, 0.0] if i % 2 else [0.5, 0.5]) for i in range(300)] + [("d001", [1.0, 0.0]), (None, [1.0, 0.0]), ("x", None), ("y", [1.0])], "id string, vec array<double>").repartition(3)
    q = spark.createDataFrame([("q", [1.0, 0.0]), ("p", [0.0, 1.0]), ("o", [1.0])], "query_id string, vec array<double>")
    got = rows(dense.dense_topk(df, q, 5), "query_id", "rank", "id")
    assert [g[2] for g in got if g[0] == "q"] == ["d001", "d003", "d005", "d007", "d009"] and [g[2] for g in got if g[0] == "p"] == ["d000", "d002", "d004", "d006", "d008"]
    assert [g[2] for g in got if g[0] == "o"] == ["y"]
