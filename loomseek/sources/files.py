"""Readers and writers: source trees, chunks, retrieval tasks, vectors, registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomseek import errors
from loomseek.errors import NotFound

# What a walk over a source tree takes and leaves out.
EXTENSIONS = [".js", ".mjs", ".cjs", ".jsx"]
IGNORED_FOLDERS = ".git .hg .next .nuxt .svn .venv __pycache__ bower_components build coverage dist node_modules out target vendor".split()
IGNORED_SUFFIXES = [".min.js", ".min.mjs", ".min.cjs", ".bundle.js", ".map"]

CHUNK_SCHEMA = (
    "chunk_id string, content_hash string, repo string, version_id string, text string, file_path string, start_line int, end_line int, start_byte int, end_byte int, symbol string, "
    "kind string, parent_symbol string, is_exported boolean, imports array<string>, calls array<string>, docstring string, language string, commit_sha string, last_modified date"
)


def wanted(path):
    """Whether a relative path is a source file to index."""
    name = F.element_at(F.split(path, "/"), -1)
    take = F.lit(False)
    for e in EXTENSIONS:
        take = take | F.endswith(F.lower(name), F.lit(e))
    for s in IGNORED_SUFFIXES:
        take = take & ~F.endswith(F.lower(name), F.lit(s))
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return take & ~F.arrays_overlap(folders, F.array(*[F.lit(f) for f in IGNORED_FOLDERS]))


def read_source_tree(spark: SparkSession, root: str, repo: str) -> DataFrame:
    """``repo, file_path, content`` of the source files below ``root``; files that are not UTF-8 have no row."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/") + "/"), "^file:/*", "/")
    path = F.replace(F.regexp_replace("path", "^file:/*", "/"), base, F.lit(""))
    text = F.try_validate_utf8(F.col("content").cast("string")) if hasattr(F, "try_validate_utf8") else F.col("content").cast("string")
    return raw.select(F.lit(repo).alias("repo"), path.alias("file_path"), text.alias("content")).filter(wanted(F.col("file_path")) & F.col("content").isNotNull())


def write_chunks(chunks: DataFrame, path: str) -> None:
    """One folder per version, replaced as a whole."""
    chunks.write.mode("overwrite").partitionBy("version_id").parquet(path)


def read_chunk_lines(spark: SparkSession, path: str) -> DataFrame:
    """Chunks from JSON lines; lines that are no chunk are skipped."""
    return spark.read.schema(CHUNK_SCHEMA).option("mode", "DROPMALFORMED").json(path).filter(F.col("chunk_id").isNotNull() & F.col("text").isNotNull())


def get_chunk(chunks: DataFrame, version_id: str, chunk_id: str) -> DataFrame:
    """One chunk of one version: the version prunes folders, the id row groups."""
    return chunks.filter((F.col("version_id") == version_id) & (F.col("chunk_id") == chunk_id))


def _id(df: DataFrame, *names: str):
    return F.coalesce(*[F.col(n).cast("string") for n in names if n in df.columns])


def normalise_corpus(corpus: DataFrame) -> DataFrame:
    """``doc_id, title, text`` from records whose id is called id, _id or doc_id; rows without id are dropped."""
    title = F.col("title") if "title" in corpus.columns else F.lit(None).cast("string")
    return corpus.select(_id(corpus, "id", "_id", "doc_id").alias("doc_id"), title.alias("title"), F.col("text")).filter("doc_id IS NOT NULL")


def normalise_queries(queries: DataFrame) -> DataFrame:
    return queries.select(_id(queries, "id", "_id", "query_id").alias("query_id"), F.col("text")).filter("query_id IS NOT NULL")


def normalise_qrels(qrels: DataFrame) -> DataFrame:
    """``query_id, doc_id, grade``; rows without ids or with a grade that is no number are dropped."""
    q, d, g = [qrels.columns[i] for i in range(3)]
    return qrels.select(F.col(f"`{q}`").cast("string").alias("query_id"), F.col(f"`{d}`").cast("string").alias("doc_id"), F.expr(f"try_cast(`{g}` AS double)").alias("grade")).filter("query_id IS NOT NULL AND doc_id IS NOT NULL AND grade IS NOT NULL")


def load_task(spark: SparkSession, folder: str, split: str = "test") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Corpus, queries and judgements of a task folder: corpus.jsonl, queries.jsonl, qrels/<split>.tsv with a header."""
    corpus = spark.read.schema("_id string, title string, text string").json(f"{folder}/corpus.jsonl")
    queries = spark.read.schema("_id string, text string").json(f"{folder}/queries.jsonl")
    qrels = spark.read.option("sep", "\t").option("header", True).schema("q string, d string, s string").csv(f"{folder}/qrels/{split}.tsv")
    return normalise_corpus(corpus), normalise_queries(queries), normalise_qrels(qrels)


def resolve_task(spark: SparkSession, name: str, split: str = "test", local: str | None = None, root: str = "data/datasets") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The task in the folder named, else in that of its name below ``root``; if neither is there an error names both."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    tried = [p for p in (local, f"{root}/{name}") if p]
    for folder in tried:
        path = hadoop(f"{folder}/corpus.jsonl")
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return load_task(spark, folder, split)
    raise NotFound(errors.INDEX_UNAVAILABLE, f"no task {name} in {', '.join(tried)}")


def document_text(title, text):
    """Title, blank line and text, of what there is."""
    return F.concat_ws("\n\n", F.nullif(F.trim(F.coalesce(title, F.lit(""))), F.lit("")), F.nullif(F.coalesce(text, F.lit("")), F.lit("")))


def corpus_chunks(corpus: DataFrame) -> DataFrame:
    """One module chunk per document with visible text: ``doc_id, text, kind``."""
    rows = corpus.select("doc_id", document_text(F.col("title"), F.col("text")).alias("text"), F.lit("module").alias("kind"))
    return rows.filter(F.col("text").rlike(r"\S"))


def limited_task(corpus: DataFrame, queries: DataFrame, qrels: DataFrame, n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A small task: the first ``n`` queries, their judged documents and ``n`` further ones. (Taking few is the feature.)"""
    q = queries.orderBy("query_id").limit(n)
    r = qrels.join(q.select("query_id"), "query_id", "left_semi")
    judged = corpus.join(r.select("doc_id").distinct(), "doc_id", "left_semi")
    padding = corpus.join(r.select("doc_id").distinct(), "doc_id", "left_anti").orderBy("doc_id").limit(n)
    return judged.unionByName(padding), q, r


def add_blobs(blobs_path: str, new: DataFrame) -> None:
    """Appends vectors ``content_hash, model_id, dim, vec`` that the store lacks; stored ones never change."""
    spark = new.sparkSession
    try:
        have = spark.read.parquet(blobs_path).select("content_hash", "model_id")
        new = new.join(have, ["content_hash", "model_id"], "left_anti")
    except Exception as e:  # the first append finds no store
        if "PATH_NOT_FOUND" not in str(e):
            raise
    unit = F.abs(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x)) - 1) <= 1e-5
    new.filter(unit & (F.size("vec") == F.col("dim"))).dropDuplicates(["content_hash", "model_id"]).write.mode("append").parquet(blobs_path)


def write_results(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)


def parse_name_status(output: str) -> list[tuple[str, str, str | None]]:
    """``(path, status, old_path)`` of a version control system's name-status listing, tab- or NUL-separated.

    Statuses are their first letters; renames and copies have two paths, of which the second is the new one.
    """
    fields = [f for f in output.replace("\n", "\x00").replace("\t", "\x00").split("\x00") if f]
    rows, at = [], 0
    while at < len(fields):
        status = fields[at][:1]
        width = 2 if status in "RC" else 1
        paths = fields[at + 1 : at + 1 + width]
        if status not in "AMDRCTU" or len(paths) < width:
            break
        rows.append((paths[-1], status, paths[0] if width == 2 else None))
        at += 1 + width
    return rows
