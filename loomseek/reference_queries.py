"""Queries of the retrieval engine's own operators over the test tables, and their SQL.

Text queries are the titles of the documents whose id is divisible by 20; identifiers to look up are the names of
the symbols whose id is. Both are searched against all rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomseek.functions import text as T
from loomseek.functions.paths import canonical_path
from loomseek.functions.vector import cosine, hash_embed, l2_normalise, norm
from loomseek.operators import ann, dense, families, fusion, graph, metrics, ranks, rerank, sparse
from loomseek.operators.chunking import chunk_files as cut_files
from loomseek.operators.lineage import nearest_ancestor
from loomseek.plans import pipeline, planner
from loomseek.plans.reindex import file_hashes, reindex
from loomseek.session import shared_dir, staged, table
from loomseek.settings import DEFAULT
from loomseek.sources.generations import Generations
from loomseek.streaming import ingest

Q: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query by its name, with its SQL if it has one."""

    def add(f):
        Q[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- SQL pieces ------------------------------------------------------------------------------------------------


def _camel(x: str) -> str:
    return rf"string_split(regexp_replace(regexp_replace({x}, '([\p{{Ll}}\p{{N}}])(\p{{Lu}})', '\1 \2', 'g'), '(\p{{Lu}})(\p{{Lu}}\p{{Ll}})', '\1 \2', 'g'), ' ')"


def _code_terms(x: str) -> str:
    atoms = rf"list_filter(list_transform(regexp_extract_all(coalesce({x}, ''), '[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_.\-]*'), lambda a: regexp_replace(a, '[.\-]+$', '')), lambda a: a <> '')"
    parts = f"flatten(list_transform(list_filter(regexp_split_to_array(s, '[_-]'), lambda p: p <> ''), lambda p: list_concat([p], {_camel('p')})))"
    segs = f"flatten(list_transform(list_filter(string_split(a, '.'), lambda s: s <> ''), lambda s: list_concat([s], {parts})))"
    return f"flatten(list_transform({atoms}, lambda a: list_distinct(list_transform(list_concat([a], {segs}), lambda t: lower(t)))))"


def _eval_terms(x: str) -> str:
    return f"flatten(list_transform(regexp_extract_all(coalesce({x}, ''), '[A-Za-z0-9]+'), lambda r: CASE WHEN len({_camel('r')}) > 1 THEN list_concat(list_transform({_camel('r')}, lambda p: lower(p)), [lower(r)]) ELSE list_transform({_camel('r')}, lambda p: lower(p)) END))"


def _lexical_terms(x: str) -> str:
    return f"list_transform(flatten(list_transform(regexp_extract_all(coalesce({x}, ''), '[A-Za-z0-9]+'), lambda r: {_camel('r')})), lambda t: lower(t))"


def _hash_terms(x: str) -> str:
    parts = f"flatten(list_transform(list_filter(regexp_split_to_array(r, '[_$]+'), lambda p: p <> ''), lambda p: flatten(list_transform({_camel('p')}, lambda c: regexp_extract_all(c, '[0-9]+|[^0-9]+')))))"
    return f"flatten(list_transform(regexp_extract_all(coalesce({x}, ''), '[0-9A-Za-z_$]+'), lambda r: list_transform(CASE WHEN len({parts}) > 1 THEN list_concat([r], {parts}) ELSE [r] END, lambda t: lower(t))))"


def _words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '\s+'), lambda s: s <> '')"


def _terms_or_words(x: str) -> str:
    return f"CASE WHEN len({_code_terms(x)}) > 0 THEN {_code_terms(x)} ELSE {_words(x)} END"


_TITLES = "queries AS (SELECT DISTINCT doc_id AS query_id, title AS text FROM documents WHERE doc_id % 20 = 0 AND title IS NOT NULL)"
_DOCS = "docs0 AS (SELECT doc_id, max(text) AS text FROM documents WHERE text IS NOT NULL GROUP BY doc_id)"


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("doc_id % 20 = 0 AND title IS NOT NULL").select(F.col("doc_id").alias("query_id"), F.col("title").alias("text")).distinct()


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("text").alias("text"))


# --- tokenizers and hashing ------------------------------------------------------------------------------------


# DuckDB's list_distinct keeps no order
_ORDERED = {"code": "list_sort({})"}
_TOKENIZERS = {"code": (_code_terms, T.code_terms), "words": (_words, T.whitespace_terms), "hashed": (_hash_terms, T.hash_terms), "eval": (_eval_terms, T.eval_terms), "lexical": (_lexical_terms, T.lexical_terms)}


@query(f"""SELECT doc_id, {', '.join(f"len({sql('text')}) AS {n}, md5(array_to_string({_ORDERED.get(n, '{}').format(sql('text'))}, ' ')) AS {n}_terms" for n, (sql, _) in _TOKENIZERS.items())}
FROM (SELECT doc_id, max(text) AS text FROM documents WHERE text IS NOT NULL GROUP BY doc_id)""")
def tokenizers(spark, sf_dir):
    """How many terms each of the five tokenizers finds, and a digest of the terms in their order."""
    out = ["doc_id"]
    for name, (_, terms) in _TOKENIZERS.items():
        out += [F.size(terms(F.col("text"))).alias(name), F.md5(F.array_join(F.sort_array(terms(F.col("text"))) if name in _ORDERED else terms(F.col("text")), " ")).alias(f"{name}_terms")]
    return _docs(spark, sf_dir).select(*out)


_INDEX = f"""{_DOCS},
tf AS (SELECT doc_id AS id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_terms_or_words('text')}) AS term FROM docs0) GROUP BY ALL),
dl AS (SELECT id, sum(tf)::BIGINT AS dl FROM tf GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl)"""


def _index(spark, sf_dir):
    return sparse.build_index(_docs(spark, sf_dir), "doc_id", T.terms_or_words(F.col("text")))


@query(f"WITH {_INDEX} SELECT df.term AS term, df, sum(tf)::BIGINT AS cf FROM df JOIN tf USING (term) GROUP BY ALL")
def term_stats(spark, sf_dir):
    i = _index(spark, sf_dir)
    return i.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


@query(f"WITH {_INDEX} SELECT id AS doc_id, dl FROM dl")
def doc_stats(spark, sf_dir):
    return _index(spark, sf_dir).docs.select(F.col("id").alias("doc_id"), "dl")


@query(f"WITH {_INDEX} SELECT n, round(avgdl, 6) AS avgdl FROM st")
def corpus_stats(spark, sf_dir):
    return _index(spark, sf_dir).corpus.select("n", F.round("avgdl", 6).alias("avgdl"))


_NORMAL = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t\f\v]+(\n|$)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g')"


@query(f"SELECT DISTINCT chunk_id, substr(sha256({_NORMAL}), 1, 32) AS content_hash, substr(sha256(text || chr(0) || file_path || chr(0) || start_line), 1, 32) AS own_id, substr(sha256(coalesce(symbol, '') || chr(0) || file_path), 1, 32) AS family_id FROM chunks")
def identity_hashes(spark, sf_dir):
    c = table(spark, sf_dir, "chunks")
    return c.select("chunk_id", T.content_hash(F.col("text")).alias("content_hash"), T.chunk_id(F.col("text"), F.col("file_path"), F.col("start_line")).alias("own_id"), T.family_id(F.col("symbol"), F.col("file_path")).alias("family_id")).distinct()


@query("""WITH d AS (SELECT DISTINCT repo, version_id, chunk_id, file_path, start_line, start_byte, end_byte, kind, symbol FROM chunks)
SELECT repo, version_id, chunk_id, file_path, start_line, kind, symbol FROM (SELECT *, row_number() OVER (PARTITION BY repo, version_id, chunk_id ORDER BY file_path, start_line, start_byte, end_byte, coalesce(kind, ''), coalesce(symbol, '')) AS n FROM d) WHERE n = 1""")
def canonical_order(spark, sf_dir):
    return ranks.canonical_chunks(table(spark, sf_dir, "chunks")).select("repo", "version_id", "chunk_id", "file_path", "start_line", "kind", "symbol")


# --- sparse and dense search -----------------------------------------------------------------------------------


def _bm25_sql(terms: str, k1: float, boost: bool, index: str) -> str:
    part = f"ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + {k1} * (0.25 + 0.75 * dl / avgdl))" + (" * qtf" if boost else f" * ({k1} + 1)")
    return f"""WITH {_TITLES}, {index},
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({terms}) AS term FROM queries) GROUP BY ALL),
s AS (SELECT query_id, id, round(sum({part}), 9) AS score FROM q JOIN df USING (term) JOIN tf USING (term) JOIN dl USING (id), st GROUP BY ALL)
SELECT query_id, id AS doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE score > 0) WHERE rank <= 100"""


@query(_bm25_sql(_terms_or_words("text"), 1.2, True, _INDEX))
def bm25_topk(spark, sf_dir):
    terms = _titles(spark, sf_dir).select("query_id", F.explode(T.terms_or_words(F.col("text"))).alias("term"))
    return sparse.bm25_topk(_index(spark, sf_dir), terms, 100).select("query_id", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@query(_bm25_sql(_eval_terms("text"), 1.5, False, _INDEX.replace(_terms_or_words("text"), _eval_terms("text"))))
def bm25_eval_topk(spark, sf_dir):
    index = sparse.build_index(_docs(spark, sf_dir), "doc_id", T.eval_terms(F.col("text")))
    terms = _titles(spark, sf_dir).select("query_id", F.explode(T.eval_terms(F.col("text"))).alias("term"))
    return sparse.bm25_eval_topk(index, terms, 100).select("query_id", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


_DENSE = """WITH v AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_inner_product(q.e, v.e), 9) AS score FROM v q, v WHERE q.vec_id % 20 = 0)"""


@query(_DENSE + " SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 100")
def dense_topk(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return dense.dense_topk(v, v.filter("id % 20 = 0").withColumnRenamed("id", "query_id"), 100).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(_DENSE + " SELECT query_id, id, round(score, 6) AS score FROM s WHERE score >= 0.3 AND query_id <> id")
def dense_pairs(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return dense.pairs_above(v, v.filter("id % 20 = 0").withColumnRenamed("id", "query_id"), 0.3).select("query_id", "id", F.round("score", 6).alias("score"))


@query()
def ann_recall(spark, sf_dir):
    """Recall at 10 of the cell index: 32 cells, 20 probes for vectors without clusters."""
    v = _vectors(spark, sf_dir)
    qs = v.filter("id % 20 = 0").withColumnRenamed("id", "query_id")
    return ann.recall(ann.cell_topk(v, qs, ann.fit_centres(v, 32), 10, 20), v, qs, 10)


@query("""SELECT DISTINCT vec_id, round(sqrt(list_inner_product(e, e)), 6) AS norm, round(e[1] / sqrt(list_inner_product(e, e)), 6) AS first, 1.0::DOUBLE AS self_cosine
FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL)""")
def l2_normalised(spark, sf_dir):
    v = _vectors(spark, sf_dir).filter("vec IS NOT NULL").withColumn("u", l2_normalise(F.col("vec")))
    return v.select(F.col("id").alias("vec_id"), F.round(norm(F.col("vec")), 6).alias("norm"), F.round(F.element_at("u", 1), 6).alias("first"), F.round(cosine(F.col("u"), F.col("vec")), 6).alias("self_cosine")).distinct()


def _hash_sql() -> str:
    spots = ", ".join(f"struct_pack(i := ('0x' || substr(md5(term), {8 * j + 1}, 7))::BIGINT % 64, w := CASE WHEN ('0x' || substr(md5(term), {8 * j + 8}, 1))::BIGINT >= 8 THEN 1 ELSE -1 END * (1 + ln(tf)))" for j in range(4))
    return f"""WITH {_TITLES}, tf AS (SELECT query_id, term, count(*) AS tf FROM (SELECT query_id, unnest({_hash_terms('text')}) AS term FROM queries) GROUP BY ALL),
s AS (SELECT query_id, unnest([{spots}]) AS s FROM tf), w AS (SELECT query_id, s.i AS i, sum(s.w) AS w FROM s GROUP BY ALL),
n AS (SELECT query_id, sqrt(sum(w * w)) AS n FROM w GROUP BY ALL)
SELECT query_id, i, round(w / n, 6) AS w FROM w JOIN n USING (query_id) WHERE abs(w / n) > 1e-9"""


@query(_hash_sql())
def hash_embeddings(spark, sf_dir):
    """The places of the hashed titles that are not zero."""
    v = hash_embed(_titles(spark, sf_dir), "query_id", "text")
    return v.select("query_id", F.posexplode("vec").alias("i", "x")).filter(F.abs("x") > 1e-9).select("query_id", F.col("i").cast("bigint").alias("i"), F.round("x", 6).alias("w"))


# --- fusion ----------------------------------------------------------------------------------------------------

_RANKED = """r0 AS (SELECT query_id, signal, chunk_id, max(score) AS score FROM ranked WHERE score IS NOT NULL AND lower(CAST(score AS VARCHAR)) NOT LIKE '%nan%' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, signal ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM r0)"""
_HYBRID = f"""{_RANKED}, b AS (SELECT query_id, signal, chunk_id, rank, CASE signal WHEN 'dense' THEN 0.34 ELSE 0.33 END AS w0, CASE signal WHEN 'dense' THEN 0 WHEN 'sparse' THEN 1 ELSE 2 END AS o FROM r WHERE signal IN ('dense', 'sparse', 'structural')),
tot AS (SELECT query_id, sum(w0) AS tot FROM (SELECT DISTINCT query_id, signal, w0 FROM b) GROUP BY ALL),
t AS (SELECT query_id, chunk_id, signal, rank, o, w0 / tot AS w, w0 / tot / (60 + rank) AS term FROM b JOIN tot USING (query_id))"""


def _ranked(spark, sf_dir):
    return fusion.reranked(table(spark, sf_dir, "ranked"))


@query(f"""WITH {_HYBRID}, f AS (SELECT query_id, chunk_id, round(sum(term), 9) AS rrf_score, count(*) AS n_signals, arg_max(signal, struct_pack(a := round(term, 12), b := -o)) AS dominant_signal FROM t GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, chunk_id) AS rank FROM f""")
def rrf_fuse(spark, sf_dir):
    f = fusion.rrf(_ranked(spark, sf_dir), DEFAULT.weights["hybrid"])
    return f.select("query_id", "chunk_id", "rrf_score", F.size("contributions").cast("bigint").alias("n_signals"), "dominant_signal", "rank")


@query(f"WITH {_HYBRID} SELECT query_id, chunk_id, signal, rank, round(w, 9) AS weight, round(term, 9) AS term FROM t")
def rrf_contributions(spark, sf_dir):
    return fusion.rrf_terms(_ranked(spark, sf_dir), DEFAULT.weights["hybrid"])


@query(f"""WITH {_RANKED}, f AS (SELECT query_id, chunk_id, round(sum(CASE signal WHEN 'dense' THEN 0.85 ELSE 0.15 END / (60 + rank)), 9) AS rrf_score FROM r WHERE signal IN ('dense', 'sparse') GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, chunk_id) AS rank FROM f""")
def rrf_eval(spark, sf_dir):
    """The evaluation fusion: fixed weights of two signals."""
    return fusion.rrf(_ranked(spark, sf_dir), DEFAULT.eval_weights, renormalise=False, signals=["dense", "sparse"]).select("query_id", "chunk_id", "rrf_score", "rank")


@query(f"""WITH {_RANKED}, l AS (SELECT *, count(DISTINCT signal) OVER (PARTITION BY query_id) AS n FROM r WHERE signal <> 'rerank'),
m AS (SELECT query_id, chunk_id, round(CASE WHEN max(n) = 1 THEN max(score) ELSE sum(1 / (60.0 + rank)) END, 9) AS score FROM l GROUP BY ALL)
SELECT query_id, 'merged' AS signal, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM m""")
def subquery_merge(spark, sf_dir):
    """The signals of a query merged as if they were the lists of its sub-queries."""
    lists = _ranked(spark, sf_dir).filter("signal <> 'rerank'").select("query_id", F.lit("merged").alias("signal"), F.col("signal").alias("list_id"), "chunk_id", "score", "rank")
    return fusion.merge_lists(lists)


# --- graph -----------------------------------------------------------------------------------------------------

_IDS = "ids AS (SELECT DISTINCT symbol AS query_id, 0 AS pos, symbol AS identifier FROM symbols WHERE symbol_id % 20 = 0 AND symbol IS NOT NULL)"
_STEM = r"regexp_replace(string_split({x}, '/')[-1], '\.(js|mjs|cjs|jsx|ts|tsx)$', '')"
_REPS = "reps AS (SELECT repo, file_path, chunk_id FROM (SELECT repo, file_path, chunk_id, row_number() OVER (PARTITION BY repo, file_path ORDER BY (coalesce(kind, '') <> 'module')::INT, start_line, chunk_id) AS n FROM symbols) WHERE n = 1)"
_SHAPES = {
    "definitions": "SELECT DISTINCT query_id, identifier, repo, chunk_id, 'definition' AS evidence, 'defines ' || identifier AS detail FROM ids JOIN symbols ON identifier = symbol",
    "callers": "SELECT DISTINCT query_id, identifier, c.repo, s.chunk_id, 'caller' AS evidence, 'calls ' || identifier AS detail FROM ids JOIN calls c ON identifier = callee_name JOIN symbols s ON s.symbol_id = c.caller_id",
    "callees": "SELECT DISTINCT query_id, identifier, c.repo, e.chunk_id, 'callee' AS evidence, 'called by ' || identifier AS detail FROM ids JOIN symbols s ON identifier = s.symbol JOIN calls c ON c.caller_id = s.symbol_id JOIN symbols e ON e.symbol_id = c.callee_id",
    "exporters": f"SELECT DISTINCT query_id, identifier, x.repo, s.chunk_id, 'export' AS evidence, 'exports ' || identifier AS detail FROM ids JOIN exports x ON identifier = exported_name OR {_STEM.format(x='identifier')} = {_STEM.format(x='x.file_path')} JOIN symbols s ON s.symbol_id = x.symbol_id",
    "importers": f"SELECT query_id, identifier, i.repo, r.chunk_id, 'import' AS evidence, 'imports ' || min(module_spec) AS detail FROM ids JOIN imports i ON (identifier IN (module_spec, {_STEM.format(x='module_spec')}, imported_name) OR {_STEM.format(x='identifier')} IN (module_spec, {_STEM.format(x='module_spec')}, imported_name)) JOIN reps r ON r.repo = i.repo AND r.file_path = i.file_path GROUP BY ALL",
}


def _ids(spark, sf_dir):
    return table(spark, sf_dir, "symbols").filter("symbol_id % 20 = 0 AND symbol IS NOT NULL").select(F.col("symbol").alias("query_id"), F.lit(0).alias("pos"), F.col("symbol").alias("identifier")).distinct()


def _graph(spark, sf_dir):
    return [table(spark, sf_dir, t) for t in ("symbols", "calls", "imports", "exports")]


@query(f"WITH {_IDS} {_SHAPES['definitions']}")
def graph_definitions(spark, sf_dir):
    return graph.definitions(_ids(spark, sf_dir), _graph(spark, sf_dir)[0])


@query(f"WITH {_IDS} {_SHAPES['callers']}")
def graph_callers(spark, sf_dir):
    s, c, _, _ = _graph(spark, sf_dir)
    return graph.callers(_ids(spark, sf_dir), c, s)


@query(f"WITH {_IDS} {_SHAPES['callees']}")
def graph_callees(spark, sf_dir):
    s, c, _, _ = _graph(spark, sf_dir)
    return graph.callees(_ids(spark, sf_dir), c, s)


@query(f"WITH {_IDS} {_SHAPES['exporters']}")
def graph_exporters(spark, sf_dir):
    s, _, _, x = _graph(spark, sf_dir)
    return graph.exporters(_ids(spark, sf_dir), x, s)


@query(f"WITH {_IDS}, {_REPS} {_SHAPES['importers']}")
def graph_importers(spark, sf_dir):
    s, _, i, _ = _graph(spark, sf_dir)
    return graph.importers(_ids(spark, sf_dir), i, s)


_PAIRS = "pairs AS (SELECT DISTINCT symbol || ' recordSpan' AS query_id, symbol AS x, 'recordSpan' AS y FROM symbols WHERE symbol_id % 20 = 0 AND symbol IS NOT NULL)"


@query(f"""WITH {_PAIRS}, hit AS (
  SELECT query_id, x, y, c.repo, caller_id FROM pairs JOIN calls c ON callee_name IN (x, y) GROUP BY ALL
  HAVING min(CASE WHEN callee_name = x THEN call_order END) < max(CASE WHEN callee_name = y THEN call_order END))
SELECT DISTINCT query_id, x AS identifier, hit.repo, chunk_id, 'ordered_pair' AS evidence, 'calls ' || x || ' before ' || y AS detail FROM hit JOIN symbols ON symbol_id = caller_id""")
def graph_ordered_pairs(spark, sf_dir):
    s, c, _, _ = _graph(spark, sf_dir)
    one = _ids(spark, sf_dir).select(F.concat("identifier", F.lit(" recordSpan")).alias("query_id"), F.posexplode(F.array("identifier", F.lit("recordSpan"))).alias("pos", "identifier"))
    return graph.ordered_pairs(one, c, s)


@query("""WITH ids AS (SELECT DISTINCT symbol AS query_id, substr(symbol, 3, 6) AS identifier FROM symbols WHERE symbol_id % 20 = 0 AND length(symbol) >= 8)
SELECT DISTINCT query_id, identifier, repo, chunk_id, 'substring' AS evidence, 'name contains ' || identifier AS detail FROM ids JOIN symbols ON contains(lower(symbol), lower(identifier))""")
def graph_substrings(spark, sf_dir):
    ids = _ids(spark, sf_dir).filter(F.length("identifier") >= 8).select("query_id", F.lit(0).alias("pos"), F.substring("identifier", 3, 6).alias("identifier"))
    return graph.substring_hits(ids, _graph(spark, sf_dir)[0])


def _tiers() -> str:
    rows = [f"('{t}', '{e}', {0.95 - 0.12 * i:.2f})" for t, kinds in graph.PRIORITY.items() for i, e in enumerate(kinds)]
    return "tiers(query_type, evidence, tier) AS (VALUES " + ", ".join(rows) + ")"


_WHY = "why AS (SELECT query_id, chunk_id, string_agg(detail, '; ' ORDER BY tier DESC, detail) AS reason FROM (SELECT DISTINCT query_id, chunk_id, tier, detail FROM {}) GROUP BY ALL)"
_TYPE = "CASE length(query_id) % 4 WHEN 0 THEN 'structural' WHEN 1 THEN 'semantic' WHEN 2 THEN 'usage' ELSE 'hybrid' END"


def _typed_plans(spark, sf_dir):
    kind = F.element_at(F.array(*[F.lit(t) for t in ("structural", "semantic", "usage", "hybrid")]), (F.length("query_id") % 4 + 1).cast("int"))
    return _ids(spark, sf_dir).select("query_id", kind.alias("query_type"), F.array("identifier").alias("identifiers"))


@query(f"""WITH {_IDS}, {_REPS}, {_tiers()}, hits AS ({' UNION ALL '.join('SELECT * FROM (' + s + ')' for s in _SHAPES.values())}),
routed AS (SELECT * FROM (SELECT h.*, tier, row_number() OVER (PARTITION BY query_id, h.evidence, identifier ORDER BY chunk_id) AS n FROM hits h JOIN tiers t ON t.evidence = h.evidence AND t.query_type = {_TYPE}) WHERE n <= 200),
f AS (SELECT query_id, chunk_id, round(max(tier)::DOUBLE + 0.01 * least(count(DISTINCT evidence) - 1, 5), 9) AS score FROM routed GROUP BY ALL), {_WHY.format('routed')}
SELECT query_id, chunk_id, score, rank, reason FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM f) JOIN why USING (query_id, chunk_id) WHERE rank <= 50""")
def structural_topk(spark, sf_dir):
    """The reference's way: 200 chunks at most per query, kind of evidence and identifier; structural_exact drops none."""
    return graph.structural_search(_typed_plans(spark, sf_dir), *_graph(spark, sf_dir), 50, 50 * graph.OVERSAMPLE).select("query_id", "chunk_id", "score", "rank", "reason")


@query(f"""WITH {_IDS}, {_REPS}, {_tiers()}, hits AS ({' UNION ALL '.join('SELECT * FROM (' + s + ')' for s in _SHAPES.values())}),
routed AS (SELECT h.*, tier FROM hits h JOIN tiers t ON t.evidence = h.evidence AND t.query_type = {_TYPE}),
f AS (SELECT query_id, chunk_id, round(max(tier)::DOUBLE + 0.01 * least(count(DISTINCT evidence) - 1, 5), 9) AS score FROM routed GROUP BY ALL), {_WHY.format('routed')}
SELECT query_id, chunk_id, score, rank, reason FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM f) JOIN why USING (query_id, chunk_id) WHERE rank <= 50""")
def structural_exact(spark, sf_dir):
    return graph.structural_search(_typed_plans(spark, sf_dir), *_graph(spark, sf_dir), 50).select("query_id", "chunk_id", "score", "rank", "reason")


@query("""WITH c AS (SELECT DISTINCT call_id, callee_id FROM calls)
SELECT (SELECT count(DISTINCT symbol_id) FROM symbols) AS symbols, (SELECT count(*) FROM c) AS calls, (SELECT round(avg((callee_id IS NOT NULL)::INT), 6) FROM c) AS resolved_share,
  (SELECT count(DISTINCT import_id) FROM imports) AS imports, (SELECT count(DISTINCT export_id) FROM exports) AS exports""")
def structural_stats(spark, sf_dir):
    return graph.structural_stats(*_graph(spark, sf_dir))


@query(f"WITH {_REPS} SELECT repo, file_path, chunk_id FROM reps")
def file_representatives(spark, sf_dir):
    return graph.file_representatives(_graph(spark, sf_dir)[0])


@query("""WITH one AS (SELECT DISTINCT ON (repo, chunk_id) repo, chunk_id, symbol, file_path, start_line, calls FROM chunks),
s AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY file_path, start_line, chunk_id) AS symbol_id FROM one),
c AS (SELECT repo, file_path, symbol_id AS caller_id, unnest(calls) AS callee, unnest(range(len(calls))) AS call_order FROM s),
own AS (SELECT repo, file_path, symbol, min(symbol_id) AS own_id FROM s WHERE symbol IS NOT NULL GROUP BY ALL),
lone AS (SELECT repo, symbol, min(symbol_id) AS only_id FROM s WHERE symbol IS NOT NULL GROUP BY ALL HAVING count(DISTINCT symbol_id) = 1)
SELECT c.repo, caller_id, string_split(callee, '.')[-1] AS callee_name, call_order, coalesce(own_id, only_id) AS callee_id
FROM c LEFT JOIN own ON own.repo = c.repo AND own.file_path = c.file_path AND own.symbol = string_split(callee, '.')[-1] LEFT JOIN lone ON lone.repo = c.repo AND lone.symbol = string_split(callee, '.')[-1]""")
def callee_resolution(spark, sf_dir):
    c = table(spark, sf_dir, "chunks")
    return graph.calls_of(c, graph.symbols_of(c)).select("repo", "caller_id", "callee_name", "call_order", "callee_id")


_TRIES = ", ".join(f"({i}, '{t}')" for i, t in enumerate(["", *graph.EXTENSIONS, *[f"/index{e}" for e in graph.EXTENSIONS]]))


@query(f"""WITH RECURSIVE sp AS (SELECT DISTINCT repo, file_path, module_spec, regexp_replace(file_path, '[^/]+$', '') || module_spec AS path FROM imports WHERE starts_with(module_spec, '.')),
walk AS (
  SELECT DISTINCT path, list_filter(string_split(replace(path, chr(92), '/'), '/'), lambda s: s NOT IN ('', '.')) AS steps, 1 AS i, []::VARCHAR[] AS acc FROM sp
  UNION ALL
  SELECT path, steps, i + 1, CASE WHEN steps[i] = '..' AND len(acc) > 0 AND acc[-1] <> '..' THEN acc[:len(acc) - 1] ELSE list_append(acc, steps[i]) END FROM walk WHERE i <= len(steps)
),
canon AS (SELECT path, array_to_string(acc, '/') AS cpath FROM walk WHERE i = len(steps) + 1), tries(n, t) AS (VALUES {_TRIES}), known AS (SELECT DISTINCT repo, file_path AS candidate FROM source_files),
hits AS (SELECT sp.repo, sp.file_path, sp.module_spec, arg_min(candidate, n) AS resolved FROM sp JOIN canon USING (path) CROSS JOIN tries JOIN known ON known.repo = sp.repo AND candidate = cpath || t GROUP BY ALL)
SELECT sp.repo, sp.file_path, sp.module_spec, resolved FROM sp LEFT JOIN hits ON hits.repo = sp.repo AND hits.file_path = sp.file_path AND hits.module_spec = sp.module_spec""")
def module_resolution(spark, sf_dir):
    """Relative module specifiers resolved to known files by extension and index."""
    i = table(spark, sf_dir, "imports").filter(F.startswith("module_spec", F.lit(".")))
    folder = F.regexp_replace("file_path", "[^/]+$", "")
    specs = i.select("repo", "file_path", "module_spec", canonical_path(F.concat(folder, "module_spec")).alias("target")).distinct()
    return graph.resolved_modules(specs, table(spark, sf_dir, "source_files"))


# --- evaluation ------------------------------------------------------------------------------------------------


def _eval_sql(ks: list[int]) -> str:
    return f"""WITH {_RANKED}, k(k) AS (VALUES {', '.join(f'({k})' for k in ks)}),
j AS (SELECT query_id, chunk_id AS doc_id, max(grade) AS grade FROM qrels GROUP BY ALL),
runs AS (SELECT query_id, signal, chunk_id AS doc_id, row_number() OVER (PARTITION BY query_id, signal ORDER BY score DESC, chunk_id) AS rank FROM r0),
h AS (SELECT signal, runs.query_id, rank, grade, sum(1) OVER (PARTITION BY signal, runs.query_id ORDER BY rank) AS so_far FROM runs JOIN j USING (query_id, doc_id) WHERE grade > 0),
g AS (SELECT signal, query_id, k, sum(grade / log2(rank + 1)) AS dcg, min(rank) AS first, count(*) AS found, sum(so_far / rank) AS prec FROM h JOIN k ON rank <= k GROUP BY ALL),
i AS (SELECT query_id, k, sum(grade / log2(n + 1)) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS n FROM j WHERE grade > 0) JOIN k ON n <= k GROUP BY ALL),
p AS (SELECT query_id, count(*) FILTER (WHERE grade > 0) AS positives FROM j GROUP BY ALL), sig AS (SELECT DISTINCT signal FROM r0),
m AS (SELECT sig.signal, i.query_id, i.k, round(coalesce(dcg / idcg, 0), 8) AS ndcg, round(coalesce(1.0 / first, 0), 8) AS mrr, round(coalesce(found / positives, 0), 8) AS recall, round(coalesce(prec / positives, 0), 8) AS map
  FROM i JOIN p USING (query_id) CROSS JOIN sig LEFT JOIN g ON g.query_id = i.query_id AND g.k = i.k AND g.signal = sig.signal)"""


def _runs(spark, sf_dir):
    return table(spark, sf_dir, "ranked").filter(F.col("score").isNotNull() & ~F.isnan("score")).select("signal", "query_id", F.col("chunk_id").alias("doc_id"), "score")


def _qrels(spark, sf_dir):
    return table(spark, sf_dir, "qrels").withColumnRenamed("chunk_id", "doc_id")


@query(_eval_sql([1, 3, 5, 10, 100]) + " SELECT signal, query_id, k, ndcg, mrr, recall, map FROM m")
def metrics_per_query(spark, sf_dir):
    return metrics.query_metrics(_runs(spark, sf_dir), _qrels(spark, sf_dir), [1, 3, 5, 10, 100], by="signal")


@query(_eval_sql([1, 3, 5, 10, 100]) + " SELECT signal, k, round(avg(ndcg), 6) AS ndcg, round(avg(mrr), 6) AS mrr, round(avg(recall), 6) AS recall, round(avg(map), 6) AS map, count(*) AS queries FROM m GROUP BY ALL")
def metrics_macro(spark, sf_dir):
    return metrics.macro_metrics(_runs(spark, sf_dir), _qrels(spark, sf_dir), [1, 3, 5, 10, 100], by="signal")


@query("""WITH run AS (SELECT DISTINCT query_id, chunk_id FROM ranked WHERE score IS NOT NULL AND lower(CAST(score AS VARCHAR)) NOT LIKE '%nan%' AND signal = 'structural'),
j AS (SELECT query_id, chunk_id, max(grade) AS grade FROM qrels GROUP BY ALL), jq AS (SELECT DISTINCT query_id FROM j), rq AS (SELECT DISTINCT query_id FROM run)
SELECT (SELECT count(*) FROM jq) AS judged_queries, (SELECT count(*) FROM jq JOIN rq USING (query_id)) AS answered_queries, (SELECT count(*) FROM jq ANTI JOIN rq USING (query_id)) AS empty_queries,
  (SELECT count(*) FROM rq ANTI JOIN jq USING (query_id)) AS unjudged_queries, (SELECT count(*) FROM run) AS retrieved, (SELECT count(*) FROM run JOIN j USING (query_id, chunk_id) WHERE grade > 0) AS retrieved_relevant""")
def run_coverage(spark, sf_dir):
    """Coverage of the structural run, the one that leaves queries without an answer."""
    return metrics.run_coverage(_runs(spark, sf_dir).filter("signal = 'structural'"), _qrels(spark, sf_dir))


@query("""WITH r AS (SELECT DISTINCT run_id, strategy, elapsed_ms FROM reindex_reports WHERE elapsed_ms IS NOT NULL), o AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY elapsed_ms) AS k, count(*) OVER (PARTITION BY strategy) AS n FROM r)
SELECT strategy, max(elapsed_ms) FILTER (WHERE k = greatest(1, ceil(0.5 * n))) AS p50, max(elapsed_ms) FILTER (WHERE k = greatest(1, ceil(0.95 * n))) AS p95 FROM o GROUP BY ALL""")
def latency_percentiles(spark, sf_dir):
    r = table(spark, sf_dir, "reindex_reports").select("run_id", "strategy", "elapsed_ms").distinct()
    return metrics.percentiles(r, ["strategy"], "elapsed_ms", {"p50": 0.5, "p95": 0.95})


@query("""WITH r AS (SELECT DISTINCT run_id, elapsed_ms, embed_calls FROM reindex_reports WHERE elapsed_ms IS NOT NULL AND embed_calls IS NOT NULL),
k AS (SELECT rank() OVER (ORDER BY elapsed_ms) + (count(*) OVER (PARTITION BY elapsed_ms) - 1) / 2.0 AS a, rank() OVER (ORDER BY embed_calls) + (count(*) OVER (PARTITION BY embed_calls) - 1) / 2.0 AS b FROM r)
SELECT round(corr(a, b), 6) AS rho FROM k""")
def rank_correlation(spark, sf_dir):
    return metrics.spearman(table(spark, sf_dir, "reindex_reports").select("run_id", "elapsed_ms", "embed_calls").distinct(), "elapsed_ms", "embed_calls")


@query(f"""WITH {_RANKED}, w(w) AS (VALUES (0.0::DOUBLE), (0.05), (0.1), (0.15), (0.2), (0.3), (0.4), (0.5)), j AS (SELECT query_id, chunk_id, max(grade) AS grade FROM qrels GROUP BY ALL),
f AS (SELECT w, query_id, chunk_id, round(sum(CASE signal WHEN 'dense' THEN 1 - w ELSE w END / (60 + rank)), 9) AS s FROM r, w WHERE signal IN ('dense', 'sparse') AND CASE signal WHEN 'dense' THEN 1 - w ELSE w END > 0 GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY w, query_id ORDER BY s DESC, chunk_id) AS n FROM f),
g AS (SELECT w, query_id, sum(grade / log2(n + 1)) AS dcg FROM k JOIN j USING (query_id, chunk_id) WHERE n <= 10 GROUP BY ALL),
i AS (SELECT query_id, sum(grade / log2(n + 1)) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, chunk_id) AS n FROM j) WHERE n <= 10 GROUP BY ALL)
SELECT w.w AS sparse_weight, round(avg(coalesce(dcg / idcg, 0)), 6) AS ndcg FROM i CROSS JOIN w LEFT JOIN g ON g.query_id = i.query_id AND g.w = w.w GROUP BY ALL""")
def weight_sweep(spark, sf_dir):
    """NDCG at 10 of the two-signal fusion for eight sparse weights."""
    return fusion.weight_sweep(_ranked(spark, sf_dir), _qrels(spark, sf_dir), [0.0, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5])


# --- reranking -------------------------------------------------------------------------------------------------

_TOP25 = _bm25_sql(_terms_or_words("text"), 1.2, True, _INDEX).replace("rank <= 100", "rank <= 25")
_LEXICAL = f"""WITH top AS ({_TOP25}), {_TITLES}, {_DOCS},
p AS (SELECT top.query_id, top.doc_id, top.score, top.rank, {_lexical_terms('q.text')} AS q, {_lexical_terms('substr(d.text, 1, 4096)')} AS d FROM top JOIN queries q USING (query_id) JOIN docs0 d USING (doc_id)),
c AS (SELECT *, list_sum(list_transform(list_distinct(q), lambda t: len(list_filter(d, lambda x: x = t)) / (len(list_filter(d, lambda x: x = t)) + 1.2))) / len(list_distinct(q)) AS cover FROM p),
s AS (SELECT *, least(1.0, CASE WHEN contains(array_to_string(d, ' '), array_to_string(q, ' ')) THEN cover + (1 - cover) * 0.35 ELSE cover END) AS sim FROM c),
l AS (SELECT query_id, doc_id, rank AS first_rank, round(1 / (1 + exp(-(6 * (2 * sim - 1)))), 9) AS rerank_score FROM s)"""


_WHOLE = _LEXICAL.replace("substr(d.text, 1, 4096)", "d.text")


def _reranked(spark, sf_dir, longest=None):
    terms = _titles(spark, sf_dir).select("query_id", F.explode(T.terms_or_words(F.col("text"))).alias("term"))
    top = sparse.bm25_topk(_index(spark, sf_dir), terms, 25).withColumnsRenamed({"id": "chunk_id", "rank": "first_rank", "score": "rrf_score"})
    pairs = top.join(_docs(spark, sf_dir).withColumnRenamed("doc_id", "chunk_id"), "chunk_id").join(_titles(spark, sf_dir).withColumnRenamed("text", "query_text"), "query_id")
    return rerank.lexical_rerank(pairs, longest=longest)


_BEST = " SELECT query_id, doc_id, round(rerank_score, 6) AS rerank_score, rank, first_rank, first_rank - rank AS moved FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, doc_id) AS rank FROM l) WHERE rank <= 10"
_ENOUGH = ", v AS (SELECT query_id, max(rerank_score) AS top1, count(*) FILTER (WHERE rerank_score > 0.2) AS above FROM l GROUP BY ALL) SELECT q.query_id, round(top1, 6) AS top1, coalesce(above, 0) AS above_floor, coalesce(top1 >= 0.35 AND above >= 3, false) AS sufficient FROM queries q LEFT JOIN v USING (query_id)"


def _best(reranked):
    out = rerank.final_order(reranked, 10)
    return out.select("query_id", F.col("chunk_id").alias("doc_id"), F.round("rerank_score", 6).alias("rerank_score"), "rank", "first_rank", (F.col("first_rank") - F.col("rank")).alias("moved"))


def _enough(spark, sf_dir, reranked):
    v = rerank.sufficiency(reranked.withColumn("rrf_score", F.lit(0.0)), _titles(spark, sf_dir), True)
    return v.select("query_id", F.round("top1", 6).alias("top1"), "above_floor", "sufficient")


@query(_LEXICAL + _BEST)
def lexical_rerank(spark, sf_dir):
    """The best ten of the first 25 after reranking, and how far they moved, of the documents' beginnings as in the reference."""
    return _best(_reranked(spark, sf_dir, rerank.LONGEST))


@query(_WHOLE + _BEST)
def lexical_exact(spark, sf_dir):
    """The same of whole documents."""
    return _best(_reranked(spark, sf_dir))


@query(_LEXICAL + _ENOUGH)
def sufficiency(spark, sf_dir):
    return _enough(spark, sf_dir, _reranked(spark, sf_dir, rerank.LONGEST))


@query(_WHOLE + _ENOUGH)
def sufficiency_exact(spark, sf_dir):
    return _enough(spark, sf_dir, _reranked(spark, sf_dir))


# --- planning --------------------------------------------------------------------------------------------------


def _synonym_sql() -> str:
    keys = ", ".join(f"('{k}', '{t}')" for k, v in planner.SYNONYMS.items() for t in v)
    suffixes = ", ".join(f"({i}, '{s}')" for i, s in enumerate(["", *planner.SUFFIXES]))
    return f"""WITH {_TITLES}, syn(key, term) AS (VALUES {keys}), suf(o, s) AS (VALUES {suffixes}), keys AS (SELECT DISTINCT key FROM syn),
w AS (SELECT DISTINCT query_id, unnest(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9]*'), lambda x: lower(x))) AS word FROM queries),
k AS (SELECT query_id, word, arg_min(key, o) AS key FROM w, suf JOIN keys ON word = key || s AND (s = '' OR length(key) >= 3) GROUP BY ALL)
SELECT DISTINCT k.query_id, term FROM k JOIN syn USING (key) ANTI JOIN w x ON x.query_id = k.query_id AND x.word = syn.term"""


@query(_synonym_sql())
def expand_terms(spark, sf_dir):
    none = F.array().cast("array<string>")
    return _titles(spark, sf_dir).select("query_id", F.explode(planner.expansions(F.col("text"), none, 12)).alias("term")).distinct()


@query()
def plan_queries(spark, sf_dir):
    """Plans of all evaluation texts: type, identifiers, expansions, sub-queries."""
    q = table(spark, sf_dir, "eval_items").select(F.col("item_id").alias("query_id"), "text").distinct()
    return planner.plan_queries(q).select("query_id", "query_type", F.size("identifiers").alias("n_identifiers"), F.size("expansion_terms").alias("n_expansions"), F.size("sub_queries").alias("n_sub_queries"))


# --- versions and families -------------------------------------------------------------------------------------


@query("""WITH RECURSIVE r AS (SELECT DISTINCT repo, version_id, parent_version, manifest_path FROM reindex_reports),
up AS (SELECT repo, version_id, parent_version AS anc, 1 AS hops FROM r UNION ALL SELECT u.repo, u.version_id, p.parent_version, hops + 1 FROM up u JOIN r p ON p.repo = u.repo AND p.version_id = u.anc WHERE p.manifest_path IS NULL)
SELECT r.repo, r.version_id, u.anc AS ancestor, u.hops FROM r LEFT JOIN (SELECT u.* FROM up u JOIN r p ON p.repo = u.repo AND p.version_id = u.anc AND p.manifest_path IS NOT NULL) u ON u.repo = r.repo AND u.version_id = r.version_id""")
def version_ancestors(spark, sf_dir):
    return nearest_ancestor(table(spark, sf_dir, "reindex_reports"), F.col("manifest_path").isNotNull())


@query("SELECT repo, arg_max(version_id, started_at) AS version_id FROM reindex_reports WHERE manifest_path IS NOT NULL GROUP BY ALL")
def active_versions(spark, sf_dir):
    return families.active_versions(table(spark, sf_dir, "reindex_reports"))


@query("SELECT DISTINCT content_hash FROM chunks WHERE content_hash IS NOT NULL AND content_hash NOT IN (SELECT content_hash FROM chunk_feed WHERE content_hash IS NOT NULL)")
def embedding_misses(spark, sf_dir):
    """Contents of the chunks for which the feed (taken as a vector store) has nothing."""
    blobs = table(spark, sf_dir, "chunk_feed").select("content_hash", F.lit("m").alias("model_id"))
    return families.embedding_misses(table(spark, sf_dir, "chunks"), blobs, "m")


@query("SELECT content_hash, count(*) AS n FROM chunk_feed WHERE content_hash NOT IN (SELECT content_hash FROM chunks WHERE content_hash IS NOT NULL) GROUP BY ALL")
def unreferenced_blobs(spark, sf_dir):
    blobs = table(spark, sf_dir, "chunk_feed").filter("content_hash IS NOT NULL")
    return families.unreferenced_blobs(blobs, table(spark, sf_dir, "chunks").filter("content_hash IS NOT NULL")).groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH v AS (SELECT repo, min(version_id) AS a, max(version_id) AS b FROM file_snapshots GROUP BY ALL HAVING min(version_id) <> max(version_id)),
x AS (SELECT DISTINCT v.repo, file_path, lower(file_hash) AS h FROM v JOIN file_snapshots f ON f.repo = v.repo AND f.version_id = v.a), y AS (SELECT DISTINCT v.repo, file_path, lower(file_hash) AS h FROM v JOIN file_snapshots f ON f.repo = v.repo AND f.version_id = v.b),
d AS (SELECT coalesce(x.repo, y.repo) || '/' || coalesce(x.file_path, y.file_path) AS path, CASE WHEN x.repo IS NULL THEN 'added' WHEN y.repo IS NULL THEN 'deleted' WHEN x.h IS DISTINCT FROM y.h THEN 'modified' END AS status FROM x FULL JOIN y ON x.repo = y.repo AND x.file_path = y.file_path)
SELECT status, count(*) AS n FROM d WHERE status IS NOT NULL GROUP BY ALL""")
def diff_summary(spark, sf_dir):
    """Changes between the least and the greatest version of each repository, by hash alone."""
    f = table(spark, sf_dir, "file_snapshots")
    ends = f.groupBy("repo").agg(F.min("version_id").alias("a"), F.max("version_id").alias("b")).filter("a <> b")
    side = lambda c: f.join(ends.select("repo", F.col(c).alias("version_id")), ["repo", "version_id"], "left_semi").select(F.concat_ws("/", "repo", "file_path").alias("path"), F.lower("file_hash").alias("hash"))
    return families.diff_by_hash(side("a"), side("b")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query()
def snippet_families(spark, sf_dir):
    """Families of all snippets of one symbol and path across the versions of a repository, by vectors of their contents."""
    chunks = table(spark, sf_dir, "chunks").filter("file_path IS NOT NULL AND text IS NOT NULL")
    ages = families.newest_first(table(spark, sf_dir, "reindex_reports")).select("repo", "version_id", F.col("age").alias("version_order"))
    vecs = staged(hash_embed(chunks.groupBy("content_hash").agg(F.min("text").alias("text")), "content_hash", "text"))
    rows = chunks.withColumn("file_path", F.concat_ws("/", "repo", "file_path")).join(ages, ["repo", "version_id"]).join(vecs, "content_hash")
    members = families.build_families(rows.select("symbol", "file_path", "version_id", "chunk_id", "start_line", "version_order", "vec"))
    total = ages.groupBy("repo").count().agg(F.max("count").alias("n")).first()["n"] or 0
    return families.family_table(members, total).select("family_id", "family_no", "representative", F.size("members").alias("n_members"), "stability")


@query()
def reindex_step(spark, sf_dir):
    """One incremental step over all repositories: from the files that were live before the last deletion of each to those live now."""
    f = table(spark, sf_dir, "source_files").filter(F.col("file_path").rlike(r"\.(js|mjs|cjs|jsx|ts)$")).withColumn("file_path", F.concat_ws("/", "repo", "file_path"))
    one = f.groupBy("file_path").agg(F.max_by("content", "loaded_at").alias("content"), F.max_by("repo", "loaded_at").alias("repo"), F.max(F.coalesce("deleted_at", F.lit("9999-01-01").cast("timestamp"))).alias("until"), F.min("loaded_at").alias("since"))
    one = staged(one)
    middle = one.agg(F.percentile_approx("since", 0.9)).first()[0]
    old = one.filter(F.col("since") <= F.lit(middle)).select("repo", "file_path", "content")
    now = one.filter("until > timestamp'9998-01-01'").select("repo", "file_path", "content")
    none = spark.createDataFrame([], "content_hash string, model_id string, dim int, vec array<double>")
    first = reindex(cut_files(old.limit(0)).withColumn("version_id", F.lit("0")), file_hashes(old.limit(0)), old, none, "1")
    then = reindex(first.chunks, file_hashes(old), now, first.new_blobs, "2")
    rows = [(v, k, int(n)) for v, r in (("1", first), ("2", then)) for k, n in r.report.items()]
    return spark.createDataFrame(rows, "version_id string, counter string, n bigint")


@query(f"""WITH {_RANKED}, b AS (SELECT query_id, chunk_id, max(CASE WHEN signal = 'dense' THEN score END) AS base, count(DISTINCT signal) AS n FROM r GROUP BY ALL HAVING base IS NOT NULL),
s AS (SELECT query_id, chunk_id, round(greatest(0.0, least(1.0, CASE WHEN n >= 2 THEN base * (1 + 0.1 * n / 4) ELSE base END)), 9) AS score FROM b)
SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s""")
def stability_rank(spark, sf_dir):
    """The stability bonus on the dense score, with the signals of a chunk as its versions."""
    b = _ranked(spark, sf_dir).groupBy("query_id", "chunk_id").agg(F.max(F.when(F.col("signal") == "dense", F.col("score"))).alias("base"), F.collect_set("signal").alias("versions")).filter("base IS NOT NULL")
    s = b.withColumn("score", families.stability_bonus(F.col("base"), F.col("versions"), F.size("versions") / 4.0))
    return ranks.top_ranked(s, 1 << 30, ["query_id"]).select("query_id", "chunk_id", "score", "rank")


@query(f"""WITH {_RANKED}, c AS (SELECT chunk_id, min(file_path) AS family_id FROM chunks GROUP BY ALL), d AS (SELECT query_id, family_id, chunk_id, score FROM r JOIN c USING (chunk_id) WHERE signal = 'dense')
SELECT query_id, family_id, max(score) AS score, (list(chunk_id ORDER BY score DESC, chunk_id))[1] AS chunk_id, count(*) AS n FROM d GROUP BY ALL""")
def collapse_families(spark, sf_dir):
    """The best result per query and file."""
    files = table(spark, sf_dir, "chunks").groupBy("chunk_id").agg(F.min("file_path").alias("family_id"))
    d = _ranked(spark, sf_dir).filter("signal = 'dense'").join(files, "chunk_id")
    return families.collapse(d).select("query_id", "family_id", "score", "chunk_id", F.size("members").cast("bigint").alias("n"))


# --- chunking, explanation, end to end -------------------------------------------------------------------------


@query()
def chunk_files(spark, sf_dir):
    """Chunks of all JavaScript and TypeScript files."""
    files = table(spark, sf_dir, "source_files").filter(F.col("file_path").rlike(r"\.(js|mjs|cjs|jsx|ts)$"))
    return cut_files(files).select("repo", "file_path", "chunk_id", "start_line", "end_line", "symbol", "kind", F.size("calls").alias("n_calls"))


@query(f"""SELECT DISTINCT chunk_id, CASE WHEN contains(lower(text), 'await') AND (contains(lower(text), 'for (') OR contains(lower(text), 'for(')) THEN '{pipeline.AWAIT_IN_LOOP}'
  WHEN contains(lower(text), '.foreach(') AND contains(lower(text), 'async') THEN '{pipeline.ASYNC_FOR_EACH}' END AS hint FROM chunks
WHERE (contains(lower(text), 'await') AND (contains(lower(text), 'for (') OR contains(lower(text), 'for('))) OR (contains(lower(text), '.foreach(') AND contains(lower(text), 'async'))""")
def optimization_hints(spark, sf_dir):
    return table(spark, sf_dir, "chunks").select("chunk_id", pipeline.optimization_hint(F.col("text")).alias("hint")).filter("hint IS NOT NULL").distinct()


_INDEXES: dict[tuple[str, str], str] = {}


def _build_index(spark, sf_dir) -> str:
    """Builds and writes the index of the chunks, once more whenever it is called."""
    path = _INDEXES.get((spark.sparkContext.applicationId, sf_dir)) or f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    pipeline.Index.create(spark, path, table(spark, sf_dir, "chunks"), *_graph(spark, sf_dir))
    _INDEXES[spark.sparkContext.applicationId, sf_dir] = path
    return path


def _chunk_index(spark, sf_dir):
    """The index of the chunks, opened; built by the first query of the session that asks for it."""
    path = _INDEXES.get((spark.sparkContext.applicationId, sf_dir)) or _build_index(spark, sf_dir)
    return pipeline.Index.open(spark, path)


@query("""WITH one AS (SELECT chunk_id, content_hash FROM chunks WHERE chunk_id IS NOT NULL AND text IS NOT NULL GROUP BY ALL)
SELECT count(DISTINCT chunk_id) AS chunk_count, count(DISTINCT content_hash) AS contents, 64 AS dim, count(DISTINCT chunk_id) AS vectors, 'hash-64' AS model_id, 'flat' AS index_kind FROM one""")
def index_build(spark, sf_dir):
    """The index of all chunks, built and written; its manifest."""
    path = _build_index(spark, sf_dir)
    store = Generations(spark, path)
    return spark.read.parquet(store.at(store.generation(), "manifest")).drop("built_at")


def _asked(spark, sf_dir):
    """``query_id, text`` of the titles, equal ones once, and who asks them: ``asked_id, query_id``."""
    asked = staged(_titles(spark, sf_dir).select(F.col("query_id").alias("asked_id"), F.sha2("text", 256).alias("query_id"), "text"))
    return asked.select("query_id", "text").distinct(), asked.select("asked_id", "query_id")


@query()
def hybrid_topk(spark, sf_dir):
    """Three signals over the chunks, fused by query type, ten results a query with their reasons. Equal titles are searched once."""
    texts, who = _asked(spark, sf_dir)
    index, plans = _chunk_index(spark, sf_dir), staged(planner.plan_queries(texts))
    out = pipeline.one_pass(index, plans, rerank=False)
    named = out.join(index.chunks.select("chunk_id", "kind", "symbol", "text"), "chunk_id").join(plans.select("query_id", F.concat("identifiers", "expansion_terms").alias("terms")), "query_id")
    row = {c: F.col(c) for c in ("dominant_signal", "contributions", "kind", "symbol")} | {"detail": F.col("reason")}
    named = named.join(who, "query_id").withColumn("query_id", F.col("asked_id"))
    return named.select("query_id", "chunk_id", F.round("rrf_score", 6).alias("rrf_score"), "rank", "dominant_signal", pipeline.match_reason(row, pipeline.matched_terms(F.col("symbol"), F.col("text"), F.col("terms"))).alias("match_reason"))


@query()
def agent_two_pass(spark, sf_dir):
    """Reranked answers, with a second pass for the queries whose first was not enough by its scores of terms. Equal titles are searched once."""
    texts, who = _asked(spark, sf_dir)
    out = pipeline.answer(_chunk_index(spark, sf_dir), texts, judge_terms=True).results.join(who, "query_id").withColumn("query_id", F.col("asked_id"))
    return out.select("query_id", "chunk_id", F.round("final_score", 6).alias("final_score"), "rank", "passes", "stop_reason")


@query()
def eval_search(spark, sf_dir):
    """The benchmark's search: every title against all documents, two signals, 100 results each.

    Vectors of hashed terms and the evaluation BM25, fused with fixed weights. Equal titles are searched once.
    """
    asked = table(spark, sf_dir, "documents").filter("title IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").alias("asked_id"), F.col("title").alias("text")).distinct()
    texts = asked.select("text").distinct().select(F.md5("text").alias("query_id"), "text")
    docs = _docs(spark, sf_dir)
    terms = texts.select("query_id", F.explode(T.eval_terms(F.col("text"))).alias("term"))
    lexical = sparse.bm25_eval_topk(sparse.build_index(docs, "doc_id", T.eval_terms(F.col("text"))), terms, 100).select("query_id", F.lit("sparse").alias("signal"), F.col("id").alias("chunk_id"), "rank")
    vectors = staged(hash_embed(docs, "doc_id", "text")).withColumnRenamed("doc_id", "id")
    near = dense.dense_topk(vectors, staged(hash_embed(texts, "query_id", "text")), 100).select("query_id", F.lit("dense").alias("signal"), F.col("id").alias("chunk_id"), "rank")
    fused = fusion.rrf(lexical.unionByName(near), DEFAULT.eval_weights, renormalise=False, signals=["dense", "sparse"]).filter("rank <= 100")
    return asked.withColumn("query_id", F.md5("text")).join(fused, "query_id").select(F.col("asked_id").alias("query_id"), F.col("chunk_id").alias("doc_id"), "rrf_score", "rank")


# --- relations from chunks, and single functions ------------------------------------------------------------------

_ONE = """one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, chunk_id ORDER BY coalesce(file_path, ''), coalesce(start_line, 0), coalesce(version_id, '')) AS n FROM chunks WHERE chunk_id IS NOT NULL) WHERE n = 1),
sym AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY file_path, start_line, chunk_id) AS symbol_id FROM one)"""


@query(f"WITH {_ONE} SELECT repo, chunk_id, symbol_id, symbol, kind, file_path, start_line, is_exported FROM sym")
def relation_symbols(spark, sf_dir):
    return graph.symbols_of(table(spark, sf_dir, "chunks")).select("repo", "chunk_id", "symbol_id", "symbol", "kind", "file_path", "start_line", "is_exported")


@query(f"""WITH {_ONE}, e AS (SELECT *, row_number() OVER (PARTITION BY repo, file_path, symbol ORDER BY symbol_id) AS k FROM sym WHERE is_exported AND symbol <> '')
SELECT repo, file_path, symbol AS exported_name, symbol AS local_name, symbol_id, 'named' AS export_kind, start_line AS export_line FROM e WHERE k = 1""")
def relation_exports(spark, sf_dir):
    return graph.exports_of(graph.symbols_of(table(spark, sf_dir, "chunks"))).select("repo", "file_path", "exported_name", "local_name", "symbol_id", "export_kind", "export_line")


@query(f"""WITH RECURSIVE {_ONE}, s AS (SELECT DISTINCT repo, file_path, trim(unnest(imports)) AS module_spec FROM one WHERE file_path IS NOT NULL), sp AS (SELECT * FROM s WHERE module_spec <> ''),
raw AS (SELECT DISTINCT regexp_replace(file_path, '[^/]+$', '') || module_spec AS path FROM sp WHERE module_spec LIKE '.%'),
walk AS (SELECT path, list_filter(string_split(path, '/'), lambda x: x NOT IN ('', '.')) AS steps, 1 AS i, []::VARCHAR[] AS acc FROM raw
  UNION ALL SELECT path, steps, i + 1, CASE WHEN steps[i] = '..' AND len(acc) > 0 AND acc[-1] <> '..' THEN acc[:len(acc) - 1] ELSE list_append(acc, steps[i]) END FROM walk WHERE i <= len(steps)),
canon AS (SELECT path, array_to_string(acc, '/') AS cpath FROM walk WHERE i = len(steps) + 1 AND array_to_string(acc, '/') NOT LIKE '..%'),
tries(n, t) AS (VALUES {', '.join(f"({n}, '{t}')" for n, t in enumerate(["", *graph.EXTENSIONS, *[f"/index{e}" for e in graph.EXTENSIONS]]))}), known AS (SELECT DISTINCT repo, file_path AS candidate FROM one),
hits AS (SELECT sp.repo, sp.file_path, sp.module_spec, arg_min(candidate, n) AS resolved FROM sp JOIN canon ON canon.path = regexp_replace(sp.file_path, '[^/]+$', '') || sp.module_spec AND sp.module_spec LIKE '.%' CROSS JOIN tries JOIN known ON known.repo = sp.repo AND candidate = cpath || t GROUP BY ALL)
SELECT sp.repo, sp.file_path, sp.module_spec, resolved AS resolved_path, 'esm_namespace' AS import_kind FROM sp LEFT JOIN hits ON hits.repo = sp.repo AND hits.file_path = sp.file_path AND hits.module_spec = sp.module_spec""")
def relation_imports(spark, sf_dir):
    return graph.imports_of(table(spark, sf_dir, "chunks")).select("repo", "file_path", "module_spec", "resolved_path", "import_kind")


@query(f"""WITH {_RANKED}, a AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM r WHERE signal = 'sparse'), b AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM r WHERE signal = 'dense')
SELECT b.query_id, b.chunk_id, a.rank AS first_rank, b.rank AS final_rank, a.rank - b.rank AS moved FROM b LEFT JOIN a USING (query_id, chunk_id)""")
def rank_movement(spark, sf_dir):
    """How the sparse order changes to the dense one."""
    order = fusion.reranked(_ranked(spark, sf_dir))
    return ranks.rank_movement(order.filter("signal = 'sparse'"), order.filter("signal = 'dense'"), ["query_id"]).select("query_id", "chunk_id", "first_rank", "final_rank", "moved")


@query(r"SELECT DISTINCT title, trim(regexp_replace(trim(regexp_replace(title, '\s+', ' ', 'g'))[:2048], ' +$', '')) AS normalised FROM documents WHERE title IS NOT NULL")
def normalised_queries(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("title IS NOT NULL").select("title", T.normalise_query(F.col("title")).alias("normalised")).distinct()


@query(r"""WITH p AS (SELECT resolved_path AS path FROM imports UNION SELECT file_path FROM source_files) SELECT path, regexp_replace(regexp_replace(replace(path, chr(92), '/'), '^[A-Za-z]:', ''), '^(\./|/)+', '') AS normalised,
  regexp_replace(string_split(path, '/')[-1], '\.(js|mjs|cjs|jsx|ts|tsx)$', '') AS stem, regexp_replace(path, '([!%_])', '!\1', 'g') AS escaped FROM p WHERE path IS NOT NULL""")
def path_functions(spark, sf_dir):
    """Normal form, module stem and LIKE pattern of all paths."""
    p = table(spark, sf_dir, "imports").select(F.col("resolved_path").alias("path")).unionByName(table(spark, sf_dir, "source_files").select(F.col("file_path").alias("path"))).filter("path IS NOT NULL").distinct()
    return p.select("path", T.normalise_file_path(F.col("path")).alias("normalised"), T.module_stem(F.col("path")).alias("stem"), T.like_escaped(F.col("path")).alias("escaped"))


@query("""WITH c AS (SELECT DISTINCT unnest(calls) AS callee FROM chunks UNION SELECT DISTINCT receiver || '.' || callee_name FROM calls WHERE receiver IS NOT NULL)
SELECT callee, string_split(callee, '.')[-1] AS name, CASE WHEN contains(callee, '.') THEN array_to_string(string_split(callee, '.')[:-2], '.') END AS receiver FROM c WHERE callee IS NOT NULL""")
def callee_splits(spark, sf_dir):
    """Name and receiver of every callee."""
    chunks, calls = table(spark, sf_dir, "chunks"), table(spark, sf_dir, "calls")
    every = chunks.select(F.explode("calls").alias("callee")).unionByName(calls.filter("receiver IS NOT NULL").select(F.concat_ws(".", "receiver", "callee_name").alias("callee"))).filter("callee IS NOT NULL").distinct()
    name, receiver = T.callee_parts(F.col("callee"))
    return every.select("callee", name.alias("name"), receiver.alias("receiver"))


@query("""WITH v AS (SELECT repo, min(version_id) AS a, max(version_id) AS b FROM file_snapshots GROUP BY ALL HAVING min(version_id) <> max(version_id)),
x AS (SELECT DISTINCT v.repo || '/' || file_path AS path, lower(file_hash) AS h FROM v JOIN file_snapshots f ON f.repo = v.repo AND f.version_id = v.a), y AS (SELECT DISTINCT v.repo || '/' || file_path AS path, lower(file_hash) AS h FROM v JOIN file_snapshots f ON f.repo = v.repo AND f.version_id = v.b),
gone AS (SELECT coalesce(x.path, y.path) AS path FROM x FULL JOIN y USING (path) WHERE x.h IS DISTINCT FROM y.h OR x.path IS NULL OR y.path IS NULL)
SELECT DISTINCT chunk_id, 'next' AS version_id FROM chunks WHERE chunk_id IS NOT NULL AND repo || '/' || file_path NOT IN (SELECT path FROM gone)""")
def carried_chunks(spark, sf_dir):
    """Chunks whose file did not change between the first and the last snapshot of its repository."""
    f = table(spark, sf_dir, "file_snapshots")
    ends = f.groupBy("repo").agg(F.min("version_id").alias("a"), F.max("version_id").alias("b")).filter("a <> b")
    side = lambda c: f.join(ends.select("repo", F.col(c).alias("version_id")), ["repo", "version_id"], "left_semi").select(F.concat_ws("/", "repo", "file_path").alias("path"), F.lower("file_hash").alias("hash"))
    status = F.when(F.col("status") == "added", "A").when(F.col("status") == "deleted", "D").otherwise("M")
    actions = families.paths_to_process(families.diff_by_hash(side("a"), side("b")).select("path", status.alias("status"), F.lit(None).cast("string").alias("old_path")))
    chunks = table(spark, sf_dir, "chunks").filter("chunk_id IS NOT NULL AND file_path IS NOT NULL AND repo IS NOT NULL").withColumn("file_path", F.concat_ws("/", "repo", "file_path"))
    return families.carried_over(chunks, actions, "next").select("chunk_id", "version_id").distinct()


@query(f"WITH {_RANKED} SELECT query_id, signal, chunk_id, round(score, 9) AS score FROM r0 WHERE signal = 'sparse' ORDER BY round(score, 9) DESC, chunk_id LIMIT 100")
def global_top(spark, sf_dir):
    """The hundred best sparse results of all queries."""
    return ranks.global_top(fusion.reranked(_ranked(spark, sf_dir)).filter("signal = 'sparse'").drop("rank"), 100).select("query_id", "signal", "chunk_id", "score")


@query("SELECT DISTINCT symbol, file_path, version_id, chunk_id, 0 AS member_no FROM chunks")
def identity_families(spark, sf_dir):
    """One family for each snippet, as without vectors."""
    return families.identity_families(table(spark, sf_dir, "chunks")).select("symbol", "file_path", "version_id", "chunk_id", F.col("member_no").cast("int").alias("member_no"))


@query(f"""WITH {_RANKED}, j AS (SELECT query_id, chunk_id FROM qrels GROUP BY ALL) SELECT query_id, signal, chunk_id, score FROM r JOIN j USING (query_id, chunk_id)""")
def restricted_run(spark, sf_dir):
    """The results that are among the judged chunks of their query."""
    allowed = table(spark, sf_dir, "qrels").select("query_id", F.col("chunk_id").alias("doc_id"))
    run = fusion.reranked(_ranked(spark, sf_dir)).withColumnRenamed("chunk_id", "doc_id")
    return metrics.restricted(run, allowed).select("query_id", "signal", F.col("doc_id").alias("chunk_id"), "score")


@query(f"WITH {_RANKED} SELECT DISTINCT chunk_id AS doc_id FROM r WHERE chunk_id NOT IN (SELECT chunk_id FROM chunks WHERE chunk_id IS NOT NULL)")
def unknown_results(spark, sf_dir):
    """Results that are no chunk: the fence of a sound run."""
    run = _ranked(spark, sf_dir).select(F.col("chunk_id").alias("doc_id"))
    return metrics.unknown_ids(run, table(spark, sf_dir, "chunks").filter("chunk_id IS NOT NULL").select(F.col("chunk_id").alias("doc_id")))


# --- extensions ------------------------------------------------------------------------------------------------


@query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    return ingest.event_windows(table(spark, sf_dir, "events"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 WHEN lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, s""")
def event_sessions(spark, sf_dir):
    return ingest.sessions(table(spark, sf_dir, "events"))


QUERIES = Q
