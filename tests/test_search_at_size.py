"""Search whose disk does not grow with the matches of a query, and what it must agree with."""

import numpy as np
from conftest import DATA, rows
from pyspark.sql import functions as F

from loomseek.functions import text as T
from loomseek.functions.vector import hash_embed, l2_normalise
from loomseek.operators import sparse

ODD = [
    ("a", "parseHTTPResponse v2Beta a.b-c_d.. __init__ X _ HTTPServer9Up", "get_URLPath", ["util.readFile", None, ""]),
    ("b", "Größe übergrößeÄnderung naïveCase ΑΒγ x", None, None),
    ("c", "!!! ??? (+)", "", []),
    ("d", "", None, ["a-b.cD"]),
    ("e", None, "camelCase", None),
    ("f", "A1B2c3 $jq_ext$ a$b 12ab34 .-. -x-", "Ünï", ["été.run"]),
    ("g", "\x1c \x0b ~  ", None, None),
]
SCHEMA = "chunk_id string, text string, symbol string, calls array<string>"


def test_terms_in_workers_are_those_of_the_expressions(spark):
    files = spark.read.parquet(f"{DATA}/chunks.parquet").groupBy("chunk_id").agg(F.min("text").alias("text"), F.min("symbol").alias("symbol"), F.min("calls").alias("calls"))
    for chunks in (spark.createDataFrame(ODD, SCHEMA), files):
        got = sparse.chunk_rows(chunks)
        want = sparse.build_index(chunks, "chunk_id", sparse.chunk_stream(F.col("text"), F.col("symbol"), F.col("calls")))
        index = sparse.SparseIndex.by_document(got, want.terms, want.corpus)
        assert rows(index.postings, "id", "term", "tf") == rows(want.postings, "id", "term", "tf")
        assert rows(index.docs, "id", "dl") == rows(want.docs, "id", "dl")


def test_hashed_vectors_are_those_of_the_expressions(spark):
    d = spark.createDataFrame(ODD, SCHEMA)
    vecs = {r["chunk_id"]: r["vec"] for r in hash_embed(d, "chunk_id", "text").collect()}
    terms = {r["chunk_id"]: r["t"] for r in d.select("chunk_id", T.hash_terms(F.col("text")).alias("t")).collect()}
    from loomseek.functions.vector import _places

    for k, t in terms.items():
        raw = np.zeros(64)
        for term in set(t or []):
            for at, sign in zip(*_places(term, 64)):
                raw[at] += sign * (1 + np.log(t.count(term)))
        want = raw / np.linalg.norm(raw) if np.linalg.norm(raw) > 1e-12 else np.eye(1, 64)[0]
        assert np.allclose(vecs[k], want)
    assert hash_embed(d, "chunk_id", "text").select(F.max(F.abs(F.element_at(l2_normalise("vec"), 1) - F.element_at("vec", 1)))).first()[0] < 1e-12


def test_bm25_by_document_is_bm25_by_term(spark, monkeypatch):
    chunks = spark.read.parquet(f"{DATA}/chunks.parquet").groupBy("chunk_id").agg(F.min("text").alias("text"), F.min("symbol").alias("symbol"), F.min("calls").alias("calls"))
    chunks = chunks.unionByName(chunks.withColumn("chunk_id", F.concat("chunk_id", F.lit("-again"))))  # every score is a tie
    plain = sparse.build_index(chunks, "chunk_id", sparse.chunk_stream(F.col("text"), F.col("symbol"), F.col("calls")))
    index = sparse.SparseIndex.by_document(plain.by_documents(), plain.terms, plain.corpus)
    terms = spark.read.parquet(f"{DATA}/documents.parquet").filter("title IS NOT NULL").limit(60).select(F.col("doc_id").alias("query_id"), F.explode(T.terms_or_words(F.concat_ws(" ", "title", "title", F.lit("return"))))).withColumnRenamed("col", "term")
    for k in (1, 7, 100_000):
        want = rows(sparse.bm25_topk(plain, terms, k), "query_id", "rank", "id", "score")
        assert want and rows(sparse.bm25_topk(index, terms, k), "query_id", "rank", "id", "score") == want
    monkeypatch.setattr(sparse, "BLOCK_BYTES", 4096)  # many blocks of queries
    assert rows(sparse.bm25_topk(index, terms, 7), "query_id", "rank", "id", "score") == rows(sparse.bm25_topk(plain, terms, 7), "query_id", "rank", "id", "score")
    assert sparse.bm25_topk(index, terms.filter("term = 'no such term'"), 5).count() == 0


def _plans(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_matches_are_not_shuffled(spark):
    """Of an index by document no join of queries and postings is left: its rows would be as many as the matches."""
    chunks = spark.createDataFrame(ODD, SCHEMA)
    index = sparse.SparseIndex.by_document(sparse.chunk_rows(chunks), *[getattr(sparse.build_index(chunks, "chunk_id", sparse.chunk_stream(F.col("text"), F.col("symbol"), F.col("calls"))), n) for n in ("terms", "corpus")])
    q = spark.createDataFrame([(1, "x")], "query_id int, term string")
    assert "Join" not in _plans(sparse.bm25_topk(index, q, 5)) and sparse.bm25_topk(index, q, 5).count() == 3


def test_an_index_is_written_once(spark, tmp_path, monkeypatch):
    from loomseek.plans import pipeline
    from loomseek.reference_queries import _graph

    twice = []
    monkeypatch.setattr(pipeline, "staged", lambda df, *a: twice.append(df))
    tables = [spark.read.parquet(f"{DATA}/chunks.parquet"), *_graph(spark, DATA)]
    pipeline.Index.create(spark, str(tmp_path / "i"), *tables)
    assert not twice
    monkeypatch.undo()
    pipeline.Index.build(*tables).write(spark, str(tmp_path / "j"))
    a, b = (pipeline.Index.open(spark, str(tmp_path / x)) for x in "ij")
    for x, y in ((a.chunks, b.chunks), (a.vectors, b.vectors), (a.sparse.postings, b.sparse.postings), (a.sparse.terms, b.sparse.terms), (a.sparse.corpus, b.sparse.corpus), (a.calls, b.calls)):
        assert x.exceptAll(y).count() == 0 and y.exceptAll(x).count() == 0


def test_equal_titles_are_one_query(spark, tmp_path):
    """The answers of documents with one title are the same rows, and nobody's are lost."""
    from loomseek.reference_queries import QUERIES, _asked

    docs = spark.createDataFrame([(20, "Parse header"), (40, "Parse header"), (60, "Merge cache"), (60, "Parse header"), (21, "not asked"), (80, None)], "doc_id bigint, title string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for t in ("chunks", "symbols", "calls", "imports", "exports"):
        spark.read.parquet(f"{DATA}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    texts, who = _asked(spark, str(tmp_path))
    assert texts.select("query_id").distinct().count() == 2 and rows(who, "asked_id") == [(20,), (40,), (60,), (60,)]
    for name in ("hybrid_topk", "agent_two_pass"):
        got = {}
        for r in QUERIES[name](spark, str(tmp_path)).collect():
            got.setdefault(r["query_id"], []).append(tuple(r)[1:])
        assert set(got) == {20, 40, 60} and sorted(got[20]) == sorted(got[40]) and len(got[20]) == 10 and len(got[60]) == 20


def test_the_second_pass_changes_answers(spark):
    """Weak first answers are asked again with another question, and the better answer counts."""
    from loomseek.operators.graph import relations_of
    from loomseek.plans import pipeline, planner

    schema = "repo string, version_id string, chunk_id string, content_hash string, file_path string, start_line int, start_byte int, end_line int, end_byte int, kind string, symbol string, parent_symbol string, language string, is_exported boolean, imports array<string>, calls array<string>, text string"
    # of many chunks with one word of the query only the expanded question brings the one with both words among the first
    words = [f"merge {'other ' * 40}{i}" for i in range(60)] + [f"merge cache combine concat assign memoize store lru {'filler ' * 400}"]
    chunks = spark.createDataFrame([("r", "v", f"c{i:03d}", f"h{i}", f"f{i}.js", 1, 0, 2, 9, "function", None, None, "js", False, [], [], w) for i, w in enumerate(words)], schema)
    index = pipeline.Index.build(chunks, *relations_of(chunks))
    queries = spark.createDataFrame([("a", "merge zzz yyy xxx"), ("b", "zzz yyy xxx www")], "query_id string, text string")
    plans = planner.plan_queries(queries)
    assert {r["query_id"]: r["sub_queries"] for r in planner.refine_plans(plans, spark.createDataFrame([("a", 9), ("b", 9)], "query_id string, n_results int")).collect()} == {"a": ["merge zzz yyy xxx combine concat assign", "merge zzz yyy xxx"], "b": []}
    assert rows(pipeline.answer(index, queries).outcome, "query_id", "passes", "stop_reason") == [("a", 1, "sufficient"), ("b", 1, "sufficient")]
    assert rows(pipeline.answer(index, queries, judge_terms=True).outcome, "query_id", "passes", "stop_reason") == [("a", 2, "max_passes"), ("b", 1, "no_new_query")]


def test_agent_asks_again(spark, tmp_path):
    from loomseek.reference_queries import QUERIES

    spark.createDataFrame([(20, "merge zzz yyy xxx qqq")], "doc_id bigint, title string").write.parquet(str(tmp_path / "documents.parquet"))
    for t in ("chunks", "symbols", "calls", "imports", "exports"):
        spark.read.parquet(f"{DATA}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    got = QUERIES["agent_two_pass"](spark, str(tmp_path)).select("query_id", "passes", "stop_reason").distinct().collect()
    assert [tuple(r) for r in got] == [(20, 2, "max_passes")]
