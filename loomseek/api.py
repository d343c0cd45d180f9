"""What callers ask: an engine over the tables of an index."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomseek import errors
from loomseek.errors import NotFound, QueryError
from loomseek.functions.text import family_id
from loomseek.functions.vector import hash_embed
from loomseek.operators.families import build_families, collapse, family_table, newest_first, stability_bonus
from loomseek.plans.pipeline import Answer, Embed, Index, all_chunks, answer, match_reason, matched_terms, optimization_hint
from loomseek.plans.planner import plan_queries
from loomseek.session import staged
from loomseek.settings import DEFAULT, Settings

#: Seconds after which one query is not asked again.
QUERY_SECONDS = 5.0


@dataclass
class Reply:
    """Results and what is to be known of them."""

    results: DataFrame
    answer: Answer

    def envelope(self) -> dict:
        """Everything of one query as plain values."""
        plan = self.answer.plans.first()
        out = self.answer.outcome.first()
        rows = [r.asDict(True) for r in self.results.orderBy("rank").collect()]
        warnings = [] if rows else ["no results"]
        return {
            "results": rows,
            "plan": plan.asDict(True) if plan else None,
            "passes": out["passes"],
            "stop_reason": out["stop_reason"],
            "score_field": self.answer.score_field,
            "timings": self.answer.timings,
            "warnings": warnings,
            "degradations": self.answer.degradations,
        }


def format_ranked_lines(results: DataFrame) -> list[str]:
    """One line a result, in order: rank, score, place and symbol."""
    rows = results.orderBy("query_id", "rank").select("rank", "score", "file_path", "symbol").collect()
    return [f"{r['rank']:>3}. {r['score']:.4f}  {r['file_path']}" + (f"  {r['symbol']}" if r["symbol"] else "") for r in rows]


class Engine:
    """Answers tables of queries, and single ones, from ``chunks`` and, if given, ``symbols, calls, imports, exports``.

    ``versions`` asks several versions at once: their lists are merged, results of one family collapse, and those that
    live in more than one version gain the stability bonus if ``families`` (``version_id, chunk_id, family_id, versions, stability``) is given.
    """

    def __init__(self, chunks: DataFrame, symbols: DataFrame | None = None, calls: DataFrame | None = None, imports: DataFrame | None = None, exports: DataFrame | None = None, settings: Settings = DEFAULT, version_id: str | None = None, versions: list[str] | None = None, embed: Embed = hash_embed, scorer: Callable | None = None):
        self.settings, self.all_chunks, self.scorer = settings, chunks, scorer
        of_version = lambda d, v: d if d is None or v is None else d.filter(F.col("version_id") == v)
        build = lambda v: Index.build(*[of_version(d, v) for d in (chunks, symbols, calls, imports, exports)], embed=embed)
        self.index: Index | dict[str, Index] = {v: build(v) for v in versions} if versions else build(version_id)

    @classmethod
    def over(cls, index: Index, settings: Settings = DEFAULT, scorer: Callable | None = None) -> Engine:
        """An engine over an index that is built or opened already."""
        out = cls.__new__(cls)
        out.settings, out.all_chunks, out.scorer, out.index = settings, index.chunks, scorer, index
        return out

    @property
    def spark(self) -> SparkSession:
        return self.all_chunks.sparkSession

    def query(self, text: str, top_k: int | None = None, refine: bool = True) -> DataFrame:
        return self.ask(text, top_k, refine).results

    def ask(self, text: str, top_k: int | None = None, refine: bool = True) -> Reply:
        """One query with all that is to be known of its answer."""
        if not text or not text.strip():
            raise QueryError(errors.VALIDATION_ERROR, "the query is blank")
        return self.reply(self.spark.createDataFrame([("0", text)], "query_id string, text string"), top_k, refine, QUERY_SECONDS)

    def query_table(self, queries: DataFrame, top_k: int | None = None, refine: bool = True) -> DataFrame:
        """``query_id, rank, score, chunk_id, file_path, kind, symbol, match_reason, optimization_hint`` of ``query_id, text``."""
        return self.reply(queries, top_k, refine).results

    def reply(self, queries: DataFrame, top_k: int | None = None, refine: bool = True, seconds: float | None = None, families: DataFrame | None = None) -> Reply:
        s = self.settings
        if top_k is not None:
            if not 1 <= top_k <= s.fusion_top_n:
                raise QueryError(errors.VALIDATION_ERROR, f"top_k must be from 1 to {s.fusion_top_n}")
            s = replace(s, top_k=top_k)
        got = answer(self.index, queries, s, self.scorer, seconds, refine)
        about = all_chunks(self.index).select("chunk_id", "file_path", "kind", "symbol", "text")
        named = got.results.join(about, "chunk_id").join(got.plans.select("query_id", F.concat("identifiers", "expansion_terms").alias("terms")), "query_id")
        row = {c: F.col(c) for c in ("dominant_signal", "contributions", "kind", "symbol")} | {"detail": F.col("reason")}
        results = named.select(
            "query_id", "rank", F.round("final_score", 6).alias("score"), "chunk_id", "file_path", "kind", "symbol",
            match_reason(row, matched_terms(F.col("symbol"), F.col("text"), F.col("terms"))).alias("match_reason"), optimization_hint(F.col("text")).alias("optimization_hint"),
        )
        return Reply(results if families is None else by_family(results, families, s), got)

    def classify(self, queries: DataFrame) -> DataFrame:
        return plan_queries(queries, self.settings).select("query_id", "query_type", "identifiers")

    def families(self, reports: DataFrame, vectors: DataFrame, multi_only: bool = False, limit: int | None = None, offset: int = 0) -> tuple[DataFrame, int]:
        """A page of the snippet families over all versions, and their number; vectors are ``content_hash, vec``."""
        order = newest_first(reports).select("version_id", F.col("age").alias("version_order")).groupBy("version_id").agg(F.min("version_order").alias("version_order"))
        rows = self.all_chunks.join(order, "version_id").join(vectors, "content_hash", "left")
        table = staged(family_table(build_families(rows, self.settings.dedupe_cosine), order.count()))
        table = table.filter(F.size("versions") >= 2) if multi_only else table
        page = table.orderBy(F.desc(F.size("members")), "family_id", "family_no")
        page = page.offset(offset) if offset else page
        return (page.limit(limit) if limit is not None else page), table.count()

    def chunk(self, version_id: str, chunk_id: str) -> DataFrame:
        return self.all_chunks.filter((F.col("version_id") == version_id) & (F.col("chunk_id") == chunk_id))

    def chunk_row(self, version_id: str, chunk_id: str) -> dict:
        """The chunk as plain values; an unknown one is an error."""
        found = self.chunk(version_id, chunk_id).first()
        if found is None:
            raise NotFound(errors.CHUNK_NOT_FOUND, f"no chunk {chunk_id} in {version_id}")
        return found.asDict(True)


def by_family(results: DataFrame, families: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Results with the bonus of their family, best one of each family, ranked anew, with ``members``: the family's results.

    families: ``chunk_id, family_id, versions, stability``. A chunk without one is a family of its own.
    """
    of = families.groupBy("chunk_id").agg(F.min("family_id").alias("family_id"), F.max_by("versions", F.size("versions")).alias("versions"), F.max("stability").alias("stability"))
    f = results.join(of, "chunk_id", "left").withColumn("family_id", F.coalesce("family_id", "chunk_id"))
    score = F.round(stability_bonus(F.col("score"), F.coalesce("versions", F.array().cast("array<string>")), F.coalesce("stability", F.lit(0.0)), settings.stability_bonus), 6)
    f = f.withColumn("score", score).drop("versions", "stability")
    from loomseek.operators.ranks import top_ranked

    kept = collapse(f.select("query_id", "family_id", "chunk_id", "score")).select("query_id", "family_id", "chunk_id", "members")
    return top_ranked(f.drop("rank").join(kept, ["query_id", "family_id", "chunk_id"]), settings.top_k, ["query_id"])


__all__ = ["Engine", "NotFound", "QueryError", "Reply", "by_family", "family_id", "format_ranked_lines"]
