"""Queries of the language-model data problems over the test tables, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomseek.llm import leakage, origin, packing, ranking, splitting, syntax, textstats
from loomseek.session import staged, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = origin.file_origins(table(spark, sf_dir, "chunks"))
    return files.filter(F.col("origin") != "hand-written").select("repo", "file_path").distinct()


def p1_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files per language and origin."""
    return origin.file_origins(table(spark, sf_dir, "chunks")).groupBy("language", "origin").agg(F.count(F.lit(1)).alias("files"), F.sum("visible").alias("visible_bytes"))


def p4_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.fused_ranking(table(spark, sf_dir, "ranked"))


def p4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NDCG at 10 of the fused ranking, of each signal alone, and of the plain sum of the raw scores."""
    scores, qrels = table(spark, sf_dir, "ranked"), table(spark, sf_dir, "qrels")
    runs = {"fused": ranking.fused_ranking(scores)}
    clean = ranking.standardised(scores)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    for signal in ("dense", "sparse", "structural", "rerank"):
        runs[signal] = clean.filter(F.col("signal") == signal).withColumn("rank", F.row_number().over(order))
    runs["raw sum"] = clean.groupBy("query_id", "chunk_id").agg(F.sum("score").alias("score")).withColumn("rank", F.row_number().over(order))
    out = [ranking.ndcg(run, qrels).withColumn("ranking", F.lit(name)) for name, run in runs.items()]
    return reduce(DataFrame.unionByName, out)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = splitting.split_chunks(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "chunk_limits"), with_text=False)
    return out.select("chunk_id").distinct()


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces with their text."""
    return splitting.split_chunks(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "chunk_limits"))


def p5_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per oversized chunk what must hold of its pieces: bytes covered, lines, and that limits and seams are kept."""
    limits = table(spark, sf_dir, "chunk_limits").select("kind", "max_bytes").distinct()
    chunks = table(spark, sf_dir, "chunks")
    places = chunks.select("chunk_id", "kind", F.coalesce("start_line", F.lit(1)).alias("line0"), F.coalesce("start_byte", F.lit(0)).alias("byte0")).distinct().join(limits, "kind")
    pieces = splitting.split_chunks(chunks, table(spark, sf_dir, "chunk_limits"))
    piece = pieces.select("chunk_id", "piece", "start_line", "end_line", "start_byte", "end_byte", F.octet_length("text").alias("text_bytes"), (F.length("text") - F.length(F.translate("text", "\n", ""))).alias("line_ends"), F.col("text").endswith("\n").cast("int").alias("whole")).distinct()
    in_order = Window.partitionBy("chunk_id").orderBy("piece")
    p = piece.withColumn("before", F.lag("end_byte").over(in_order)).join(places, "chunk_id")
    width = F.col("end_byte") - F.col("start_byte")
    return p.groupBy("chunk_id").agg(
        F.sum(F.col("end_byte") - F.coalesce("before", "byte0")).alias("n_bytes"),
        (F.max("end_line") - F.min("line0")).cast("bigint").alias("last_line"),
        F.every((width <= F.col("max_bytes")) & (width > 0) & (width == F.col("text_bytes"))).alias("within"),
        F.every((F.col("start_byte") <= F.coalesce("before", "byte0")) & (F.col("end_byte") > F.coalesce("before", "byte0"))).alias("gapless"),
        F.every(F.col("end_line") - F.col("start_line") == F.col("line_ends") - F.col("whole")).alias("lines_agree"),
        (F.count(F.lit(1)) == F.max("piece") + 1).alias("numbered"),
    )


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.parsed_files(table(spark, sf_dir, "symbols"), table(spark, sf_dir, "source_files"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).filter(~F.col("valid")).select("repo", "file_path").distinct()


def p7_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.parse_rates(_parsed(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.split_items(packing.pack(table(spark, sf_dir, "documents"))).select(F.col("id").alias("doc_id"))


def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def p8_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document what must hold of its parts: bytes packed, whether it was split, and that no container is over full."""
    p = packing.pack(table(spark, sf_dir, "documents"))
    used = p.groupBy("container").agg(F.sum(F.col("end") - F.col("start")).alias("used")).agg(F.max("used").alias("most")).first()["most"] or 0
    return p.groupBy(F.col("id").alias("doc_id")).agg(F.sum(F.col("end") - F.col("start")).cast("bigint").alias("n_bytes"), (F.count(F.lit(1)) > 1).alias("split"), F.every((F.col("end") - F.col("start") <= 4096) & F.lit(used <= 4096)).alias("fits"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers and unused share, of mixed batches and of batches of one bucket each."""
    docs = table(spark, sf_dir, "documents")
    return packing.fill(packing.pack(docs)).withColumn("batches", F.lit("mixed")).unionByName(packing.fill(packing.pack(docs, mix=False)).withColumn("batches", F.lit("within buckets")))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id").distinct()


def p9_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which evaluation items leaked, into how many documents."""
    out = leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    n = out.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max("held").alias("most_held"))
    return table(spark, sf_dir, "eval_items").select("item_id", "split").distinct().join(n, "item_id")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = staged(textstats.text_statistics(table(spark, sf_dir, "documents")))
    return textstats.text_types(stats).filter(F.col("p_prose") < 0.5).select(F.col("id").alias("doc_id")).distinct()


def p10_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics as shares, text type and posterior of each document."""
    typed = textstats.text_types(staged(textstats.text_statistics(table(spark, sf_dir, "documents")).distinct()))
    solid = F.col("n_bytes") - F.col("spaces")
    return typed.select(
        F.col("id").alias("doc_id"),
        F.col("words").alias("word_count"),
        F.round(solid / F.greatest(F.col("words"), F.lit(1)), 4).alias("mean_word_bytes"),
        F.round(F.col("symbols") / F.greatest(solid, F.lit(1)), 4).alias("symbol_ratio"),
        F.round(F.col("ended") / F.greatest(F.col("lines"), F.lit(1)), 4).alias("lines_ended"),
        F.round(F.col("common") / F.greatest(F.col("words"), F.lit(1)), 4).alias("common_words"),
        "text_type",
        F.round("p_prose", 4).alias("p_prose"),
    )


def p10_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain counts of each document."""
    stats = textstats.text_statistics(table(spark, sf_dir, "documents")).distinct()
    return stats.select(F.col("id").alias("doc_id"), "n_bytes", "words", "digits", "symbols", "spaces")


QUERIES = {f.__name__: f for f in (p1_found, p1_origins, p4_ranking, p4_quality, p7_found, p7_rates, p5_found, p5_pieces, p5_cover, p8_found, p8_pack, p8_cover, p8_fill, p9_found, p9_items, p10_found, p10_types, p10_counts)}

_FUSED = """
WITH s AS (SELECT query_id, signal, chunk_id, max(score) AS score FROM ranked WHERE score IS NOT NULL AND lower(CAST(score AS VARCHAR)) NOT LIKE '%nan%' GROUP BY ALL),
m AS (SELECT query_id, signal, median(score) AS mid FROM s GROUP BY ALL),
o AS (SELECT s.*, mid, abs(score - mid) AS off FROM s JOIN m USING (query_id, signal)),
d AS (SELECT query_id, signal, median(off) AS mad, avg(off) AS mean_off FROM o GROUP BY ALL),
z AS (SELECT query_id, signal, chunk_id, CASE WHEN mad > 0 THEN (score - mid) / (1.4826 * mad) WHEN mean_off > 0 THEN (score - mid) / (1.2533 * mean_off) ELSE 0 END AS z,
  CASE signal WHEN 'sparse' THEN 0.5 WHEN 'structural' THEN 0.25 ELSE 1.0 END AS w FROM o JOIN d USING (query_id, signal)),
b AS (SELECT *, 1 / (1 + exp(-greatest(-30.0, least(30.0, z)))) AS bounded FROM z),
f AS (SELECT query_id, chunk_id, round(exp((sum(w * ln(bounded)) + ln(0.5)) / (sum(w) + 1.0)), 9) AS final_score, count(*) AS n_signals FROM b GROUP BY ALL)
"""

ORACLES = {
    "p4_ranking": _FUSED
    + """
SELECT query_id, chunk_id, final_score, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, chunk_id) AS rank, n_signals FROM f""",
    "p4_quality": _FUSED
    + """,
runs AS (
  SELECT 'fused' AS ranking, query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, chunk_id) AS rank FROM f
  UNION ALL SELECT signal, query_id, chunk_id, row_number() OVER (PARTITION BY query_id, signal ORDER BY score DESC, chunk_id) FROM s
  UNION ALL SELECT 'raw sum', query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, chunk_id) FROM (SELECT query_id, chunk_id, sum(score) AS total FROM s GROUP BY ALL)
),
j AS (SELECT query_id, chunk_id, max(grade) AS grade FROM qrels WHERE grade > 0 GROUP BY ALL),
i AS (SELECT query_id, sum(grade / log2(n + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, chunk_id) AS n FROM j) WHERE n <= 10 GROUP BY ALL),
g AS (SELECT ranking, query_id, sum(grade / log2(rank + 1)) AS gain FROM runs JOIN j USING (query_id, chunk_id) WHERE rank <= 10 GROUP BY ALL)
SELECT k.ranking, round(avg(coalesce(gain, 0) / ideal), 6) AS ndcg, count(*) AS queries FROM i CROSS JOIN (SELECT DISTINCT ranking FROM runs) k LEFT JOIN g ON g.query_id = i.query_id AND g.ranking = k.ranking GROUP BY ALL""",
    "p5_found": "SELECT DISTINCT chunk_id FROM chunks JOIN chunk_limits USING (kind) WHERE strlen(text) > max_bytes",
    "p5_cover": r"""
SELECT DISTINCT chunk_id, strlen(text) AS n_bytes, len(regexp_replace(regexp_replace(text, '\n$', ''), '[^\n]', '', 'g')) AS last_line, true AS within, true AS gapless, true AS lines_agree, true AS numbered
FROM chunks JOIN chunk_limits USING (kind) WHERE strlen(text) > max_bytes""",
    "p8_found": "SELECT DISTINCT doc_id FROM documents WHERE strlen(text) > 4096",
    "p8_cover": "SELECT doc_id, max(strlen(text)) AS n_bytes, max(strlen(text)) > 4096 AS split, true AS fits FROM documents WHERE strlen(text) > 0 AND doc_id IS NOT NULL GROUP BY doc_id",
    "p10_counts": r"""
SELECT DISTINCT doc_id, strlen(text) AS n_bytes, len(regexp_extract_all(text, '[^\t\n\v\f\r ]+')) AS words, len(regexp_extract_all(text, '[0-9]')) AS digits,
  len(regexp_extract_all(text, '[^\t\n\v\f\r a-zA-Z0-9.,!?;:''"()\x00-\x1f\x7f-\x{10ffff}-]')) AS symbols, len(regexp_extract_all(text, '[\t\n\v\f\r ]')) AS spaces
FROM documents WHERE regexp_matches(text, '[^\s\pZ]')""",
}
