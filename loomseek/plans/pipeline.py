"""From queries to ranked results: fan-out, fusion, reranking, one refinement at most."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomseek import errors
from loomseek.errors import NotFound
from loomseek.functions.text import code_terms, terms_or_words
from loomseek.functions.vector import hash_embed
from loomseek.operators.dense import dense_topk
from loomseek.operators.fusion import merge_lists, rrf
from loomseek.operators.graph import relations_of, structural_search
from loomseek.operators.rerank import final_order, lexical_rerank, model_rerank, sufficiency
from loomseek.operators.sparse import SparseIndex, bm25_topk, chunk_rows
from loomseek.plans.planner import effective_queries, mined_identifiers, plan_queries, plans_differ, refine_plans
from loomseek.session import staged, written
from loomseek.settings import DEFAULT, Settings
from loomseek.sources.generations import Generations

#: ``embed(rows, key, text)`` gives ``key, vec``.
Embed = Callable[[DataFrame, str, str], DataFrame]
#: ``keep(table, name)`` writes a table of an index and reads it again.
Keep = Callable[[DataFrame, str], DataFrame]
_TABLES = ("chunks", "vectors", "symbols", "calls", "imports", "exports")


def _staged(df: DataFrame, name: str) -> DataFrame:
    return staged(df)


@dataclass
class Index:
    """What a query is answered from. ``chunks`` has one row per chunk id."""

    chunks: DataFrame
    vectors: DataFrame
    sparse: SparseIndex
    symbols: DataFrame
    calls: DataFrame
    imports: DataFrame
    exports: DataFrame
    embed: Embed = hash_embed
    #: How queries are embedded, where that differs from contents: see ``vector.with_instruction``.
    embed_query: Embed | None = None

    @staticmethod
    def build(chunks: DataFrame, symbols: DataFrame | None = None, calls: DataFrame | None = None, imports: DataFrame | None = None, exports: DataFrame | None = None, embed: Embed = hash_embed, keep: Keep = _staged) -> Index:
        """Chunks count once per id; vectors are made once per content. Without ``symbols`` the relations are made from the chunks.

        ``keep`` says where the tables are written.
        """
        place = F.struct("repo", "version_id", "file_path", "start_byte", F.coalesce("kind", F.lit("")), F.coalesce("symbol", F.lit("")))
        one = chunks.filter(F.col("chunk_id").isNotNull() & F.col("text").isNotNull()).groupBy("chunk_id").agg(*[F.min_by(c, place).alias(c) for c in ("content_hash", "text", "symbol", "kind", "calls", "file_path")])
        one = keep(one, "chunks")
        contents = one.groupBy("content_hash").agg(F.min("text").alias("text"))
        vectors = keep(one.select(F.col("chunk_id").alias("id"), "content_hash").join(embed(contents, "content_hash", "text"), "content_hash").select("id", "vec"), "vectors")
        rows = keep(chunk_rows(one), "sparse/rows")
        terms = keep(rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")), "sparse/terms")
        corpus = keep(rows.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")), "sparse/corpus")
        relations = relations_of(chunks) if symbols is None else (symbols, calls, imports, exports)
        return Index(one, vectors, SparseIndex.by_document(rows, terms, corpus), *relations, embed)

    def write(self, spark: SparkSession, path: str, model_id: str = "hash-64") -> str:
        """Writes all tables as one generation and publishes it: a reader sees the index before or after, never between."""
        store = Generations(spark, path)
        store.vacuum()
        done, g = store.commits(), store.new()
        for name in _TABLES:
            getattr(self, name).write.parquet(store.at(g, name))
        self.sparse.write(store.at(g, "sparse"))
        self._publish(store, g, len(done), model_id)
        return g

    @staticmethod
    def create(spark: SparkSession, path: str, *tables: DataFrame, model_id: str = "hash-64", embed: Embed = hash_embed) -> str:
        """Builds an index of the ``tables`` of ``build`` as a generation at ``path`` and publishes it; nothing is written twice."""
        store = Generations(spark, path)
        store.vacuum()
        done, g = store.commits(), store.new()
        index = Index.build(*tables, embed=embed, keep=lambda d, name: written(d, store.at(g, name)))
        for name in _TABLES[2:]:
            written(getattr(index, name), store.at(g, name))
        index._publish(store, g, len(done), model_id)
        return g

    def _publish(self, store: Generations, g: str, number: int, model_id: str) -> None:
        dim = self.vectors.agg(F.max(F.size("vec")).alias("dim"), F.count(F.lit(1)).alias("vectors"))
        manifest = self.chunks.agg(F.count(F.lit(1)).alias("chunk_count"), F.countDistinct("content_hash").alias("contents")).crossJoin(dim)  # one row each
        manifest.select("*", F.lit(model_id).alias("model_id"), F.lit("flat").alias("index_kind"), F.current_timestamp().alias("built_at")).coalesce(1).write.parquet(store.at(g, "manifest"))
        store.publish(g, number)

    @staticmethod
    def open(spark: SparkSession, path: str, embed: Embed = hash_embed, generation: str | None = None) -> Index:
        """The published index at ``path``; an unknown one is an error."""
        store = Generations(spark, path)
        g = generation or store.generation()
        if g is None:
            raise NotFound(errors.INDEX_UNAVAILABLE, f"no index at {path}")
        t = {name: spark.read.parquet(store.at(g, name)) for name in _TABLES}
        return Index(t["chunks"], t["vectors"], SparseIndex.read(spark, store.at(g, "sparse")), t["symbols"], t["calls"], t["imports"], t["exports"], embed)


def _lists(index: Index, plans: DataFrame, settings: Settings) -> DataFrame:
    """``query_id, signal, list_id, chunk_id, score, rank, reason``: the lists of all sub-queries and signals of some weight."""
    used = {s for w in settings.weights.values() for s, v in w.items() if v > 0}
    subs = effective_queries(plans).withColumn("sub_id", F.concat_ws("#", "query_id", "list_id"))
    of_sub = subs.select(F.col("sub_id"), "query_id", "list_id")
    none = F.lit(None).cast("string")
    out = []
    named = lambda d, name: d.withColumnsRenamed({"query_id": "sub_id", "id": "chunk_id"}).join(of_sub, "sub_id").select("query_id", F.lit(name).alias("signal"), F.col("list_id").cast("string").alias("list_id"), "chunk_id", "score", "rank", none.alias("reason"))
    if "dense" in used:
        vec = staged((index.embed_query or index.embed)(subs, "sub_id", "text")).withColumnRenamed("sub_id", "query_id")
        out.append(named(dense_topk(index.vectors, vec, settings.dense_width), "dense"))
    if "sparse" in used:
        words = subs.join(plans.select("query_id", F.concat(F.col("identifiers"), F.col("expansion_terms")).alias("more")), "query_id")
        terms = words.select(F.col("sub_id").alias("query_id"), F.explode(F.concat(terms_or_words(F.col("text")), F.flatten(F.transform("more", lambda t: code_terms(t))))).alias("term"))
        out.append(named(bm25_topk(index.sparse, terms, settings.sparse_width), "sparse"))
    if "structural" in used:
        # a plan without identifiers looks up what its text has of code-like tokens
        looked = plans.withColumn("identifiers", F.when(F.size("identifiers") > 0, F.col("identifiers")).otherwise(mined_identifiers("original_query")))
        looked = staged(looked)
        # where no plan has anything to look up the graph has no evidence: its joins, and their plans in the driver, are left out
        if not out or not looked.filter(F.exists("identifiers", lambda i: i != "")).isEmpty():
            graph = structural_search(looked, index.symbols, index.calls, index.imports, index.exports, settings.structural_width)
            out.append(graph.select("query_id", F.lit("structural").alias("signal"), F.lit("0").alias("list_id"), "chunk_id", "score", "rank", "reason"))
    if not out:
        raise ValueError("no signal has a weight")
    lists = out[0]
    for d in out[1:]:
        lists = lists.unionByName(d)
    return lists


def fan_out(index: Index | dict[str, Index], plans: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """``query_id, signal, chunk_id, score, rank, reason``: every signal for every sub-query, merged per query.

    Of several indexes by version, every version is asked, and a list is one of a version's.
    """
    if isinstance(index, Index):
        return merge_lists(_lists(index, plans, settings), settings.rrf_k)
    every = None
    for version, one in index.items():
        lists = _lists(one, plans, settings).withColumn("list_id", F.concat(F.lit(version + "/"), "list_id"))
        every = lists if every is None else every.unionByName(lists)
    return merge_lists(every, settings.rrf_k)


def fuse_by_type(ranked: DataFrame, plans: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Fusion with each query type's weights, in one plan."""
    table = F.create_map(*[x for t, w in settings.weights.items() for x in (F.lit(t), F.create_map(*[y for k, v in w.items() for y in (F.lit(k), F.lit(float(v)))]))])
    weights = plans.select("query_id", F.explode(F.element_at(table, F.col("query_type"))).alias("signal", "w"))
    return rrf(ranked, weights, settings.rrf_k)


def one_pass(index: Index | dict[str, Index], plans: DataFrame, settings: Settings = DEFAULT, rerank: bool = True, scorer: Callable | None = None) -> DataFrame:
    """``query_id, chunk_id, rrf_score, rerank_score, final_score, rank, contributions, dominant_signal, reason``.

    Reranking is by terms, or by ``scorer``, a batch scorer of logits. ``reason`` is the graph's evidence, if it has any.
    """
    ranked = staged(fan_out(index, plans, settings))
    fused = fuse_by_type(ranked, plans, settings).filter(F.col("rank") <= settings.fusion_top_n).drop("rank")
    why = ranked.filter(F.col("reason").isNotNull()).select("query_id", "chunk_id", "reason")
    texts = all_chunks(index).select("chunk_id", "text")
    full = fused.join(why, ["query_id", "chunk_id"], "left").join(texts, "chunk_id", "left").join(plans.select("query_id", F.col("original_query").alias("query_text")), "query_id")
    if not rerank:
        scored = full.withColumn("rerank_score", F.lit(None).cast("double"))
    else:
        scored = (lexical_rerank(full) if scorer is None else model_rerank(full, scorer)).withColumn("rerank_score", F.when(F.col("text").isNotNull(), F.col("rerank_score")))
    # an unknown chunk is cut with the others and dropped after, so it takes its place
    ordered = final_order(scored, settings.top_k).filter(F.col("text").isNotNull())
    return ordered.select("query_id", "chunk_id", "rrf_score", "rerank_score", "final_score", "rank", "contributions", "dominant_signal", "reason")


def all_chunks(index: Index | dict[str, Index]) -> DataFrame:
    """The chunks of one index, or of all versions, one row per chunk id."""
    if isinstance(index, Index):
        return index.chunks
    every = None
    for one in index.values():
        every = one.chunks if every is None else every.unionByName(one.chunks)
    return every.groupBy("chunk_id").agg(*[F.min(c).alias(c) for c in every.columns if c != "chunk_id"])


# Why a query is finished.
SUFFICIENT, MAX_PASSES, BUDGET, NO_NEW_QUERY, EMPTY_QUERY, PASS_FAILED = "sufficient", "max_passes", "budget_exhausted", "no_new_query", "empty_query", "pass_failed"


@dataclass
class Answer:
    """``results`` as of ``one_pass`` with ``passes, stop_reason``; ``outcome`` has ``query_id, passes, winning_pass, stop_reason, n_results`` of every query."""

    results: DataFrame
    outcome: DataFrame
    plans: DataFrame
    score_field: str
    timings: dict[str, float] = field(default_factory=dict)
    degradations: list[str] = field(default_factory=list)


def answer(index: Index | dict[str, Index], queries: DataFrame, settings: Settings = DEFAULT, scorer: Callable | None = None, seconds: float | None = None, refine: bool = True, judge_terms: bool = False) -> Answer:
    """Answers a table of queries in at most two passes: the second for those whose first result is not enough.

    Scores of terms are no calibrated ones: without a ``scorer`` any result is enough, and only queries without one are asked again,
    unless ``judge_terms`` holds them against the thresholds all the same. A query is asked again if its refined plan differs, and if ``seconds`` have not passed; of two passes the better by its
    best score counts, the first on ties. A second pass that fails leaves the first.
    """
    began, timings, degradations = time.monotonic(), {}, []

    def timed(stage: str, df: DataFrame) -> DataFrame:
        start = time.monotonic()
        out = staged(df)
        timings[stage] = round(1000 * (time.monotonic() - start), 3)
        return out

    plans = timed("plan", plan_queries(queries, settings))
    asked = plans.filter(F.col("original_query") != "")
    first = timed("pass 1", one_pass(index, asked, settings, scorer=scorer))
    verdict = timed("sufficiency", sufficiency(first, asked, scorer is not None or judge_terms, settings))
    weak = verdict.filter(~F.col("sufficient")).select("query_id")
    nothing = first.limit(0)
    second, again, why = nothing, None, MAX_PASSES
    if refine and not weak.isEmpty():
        counts = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_results"))
        old = asked.join(weak, "query_id", "left_semi")
        refined = refine_plans(old, counts, settings)
        new = plans_differ(old, refined).filter("differs").select("query_id")
        again = timed("refine", refined.join(new, "query_id", "left_semi"))
        if seconds is not None and time.monotonic() - began > seconds:
            why = BUDGET
            degradations.append("no time left before pass 2")
        elif not again.isEmpty():
            try:
                second = timed("pass 2", one_pass(index, again, settings, scorer=scorer))
            except Exception as e:
                second, why = nothing, PASS_FAILED
                degradations.append(f"pass 2 raised {type(e).__name__}")
    top = lambda d, name: d.groupBy("query_id").agg(F.max("final_score").alias(name), F.count(F.lit(1)).alias(f"n_{name}"))
    base = plans.select("query_id", (F.col("original_query") == "").alias("blank")).distinct().join(verdict.select("query_id", "sufficient"), "query_id", "left")
    base = base.join(top(first, "t1"), "query_id", "left").join(top(second, "t2"), "query_id", "left")
    twice = F.lit(False)
    if again is not None:
        base = base.join(again.select("query_id", F.lit(True).alias("again")).distinct(), "query_id", "left")
        twice = F.coalesce("again", F.lit(False))
    ran = twice & F.lit(why == MAX_PASSES)
    wins = ran & (F.coalesce("t2", F.lit(0.0)) > F.coalesce("t1", F.lit(0.0)))
    stop = F.when(F.col("blank"), EMPTY_QUERY).when(F.col("sufficient"), SUFFICIENT).when(twice, why).when(F.lit(refine), NO_NEW_QUERY).otherwise(MAX_PASSES)
    passes = F.when(F.col("blank"), 0).when(ran, 2).otherwise(1)
    outcome = staged(
        base.select("query_id", passes.alias("passes"), F.when(~F.col("blank"), F.when(wins, 2).otherwise(1)).alias("winning_pass"), stop.alias("stop_reason"), F.coalesce(F.when(wins, F.col("n_t2")).otherwise(F.col("n_t1")), F.lit(0)).cast("bigint").alias("n_results"))
    )
    both = first.withColumn("winning_pass", F.lit(1)).unionByName(second.withColumn("winning_pass", F.lit(2)))
    results = both.join(outcome.select("query_id", "winning_pass", "passes", "stop_reason"), ["query_id", "winning_pass"]).drop("winning_pass")
    timings["total"] = round(1000 * (time.monotonic() - began), 3)
    return Answer(results, outcome, plans, "rerank_score", timings, degradations)


# The sentences of ``match_reason`` and ``optimization_hint``.


def match_reason(row: dict[str, Column], terms: Column) -> Column:
    """One sentence of evidence. row: dominant_signal, contributions, kind, symbol, detail."""
    rank = F.element_at(row["contributions"], row["dominant_signal"]).cast("string")
    where = F.concat_ws(" ", row["kind"], row["symbol"])
    named = F.when(F.size(terms) > 0, F.array_join(F.slice(terms, 1, 4), ", ")).otherwise(F.lit("the query terms"))
    head = (
        F.when(row["dominant_signal"] == "structural", F.concat(F.lit("structural: "), F.coalesce(row["detail"], F.lit("call-graph match for the query identifiers")), F.lit(" (rank "), rank, F.lit(" in the call graph)")))
        .when(row["dominant_signal"] == "sparse", F.concat(F.lit("sparse: "), where, F.lit(" matches "), named, F.lit(" lexically (BM25 rank "), rank, F.lit(")")))
        .otherwise(F.concat(F.lit("dense: "), where, F.lit(" is a nearest neighbour of the query embedding (rank "), rank, F.lit(")")))
    )
    others = F.filter(F.array(*[F.struct(F.lit(s).alias("s"), F.element_at(row["contributions"], F.lit(s)).alias("r")) for s in ("dense", "sparse", "structural")]), lambda x: x["r"].isNotNull() & (x["s"] != row["dominant_signal"]))
    more = F.array_join(F.transform(others, lambda x: F.concat(x["s"], F.lit(" rank "), x["r"].cast("string"))), " and ")
    return F.when(F.size(others) > 0, F.concat(head, F.lit("; corroborated at "), more)).otherwise(head)


def matched_terms(symbol: Column, text: Column, terms: Column) -> Column:
    """Up to four of the plan's terms that the symbol or text contains, in any case."""
    hay = F.lower(F.concat_ws(" ", F.coalesce(symbol, F.lit("")), text))
    return F.slice(F.filter(F.array_distinct(terms), lambda t: (t != "") & F.contains(hay, F.lower(t))), 1, 4)


AWAIT_IN_LOOP = "awaits inside a for-loop; consider Promise.all for independent calls"
ASYNC_FOR_EACH = "async callback inside forEach; the loop does not await it"


def optimization_hint(text: Column) -> Column:
    """A note about awaits inside loops, or null."""
    low = F.lower(text)
    loop = F.contains(low, F.lit("for (")) | F.contains(low, F.lit("for("))
    return F.when(F.contains(low, F.lit("await")) & loop, AWAIT_IN_LOOP).when(F.contains(low, F.lit(".foreach(")) & F.contains(low, F.lit("async")), ASYNC_FOR_EACH)
