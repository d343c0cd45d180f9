"""Problem 7: source files that do not parse.

Method: every file is parsed by all grammars, in the order of a token-based ranking. A file that its own
grammar refuses and a foreign one accepts has a wrong extension; a file that all refuse is corrupt.

Python files are held against the grammar of the interpreter that runs the workers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomseek.llm import grammars


def verdict(language: str, text: str) -> tuple[bool, str, str | None, list[str]]:
    """Whether the text is valid; ``valid``, ``wrong extension`` or ``corrupt``; the language it is; and all that accept it, likeliest first."""
    accepted = [la for la in grammars.ranked(text) if grammars.valid(la, text)]
    if language in accepted:
        return True, "valid", language, accepted
    # nearly everything without a statement is some language: a foreign parse must have tokens of its own
    if accepted and text.strip():
        return False, "wrong extension", accepted[0], accepted
    return False, "corrupt", None, accepted


_PARSED = "repo string, file_path string, language string, valid boolean, verdict string, parses_as string, accepted array<string>"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [verdict(la, t) for la, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
        types = (pa.bool_(), pa.string(), pa.string(), pa.list_(pa.string()))
        columns = [pa.array([g[k] for g in got], t) for k, t in enumerate(types)]
        yield pa.record_batch([b.column(0), b.column(1), b.column(2), *columns], names=[c.split()[0] for c in _PARSED.split(", ")])


def parsed_files(symbols: DataFrame, source_files: DataFrame) -> DataFrame:
    """``repo, file_path, language, valid, verdict, parses_as, accepted`` of the files of ``symbols``.

    The language is that of the extension; files of other extensions have no row, nor have files without text in
    ``source_files``. The empty text is valid but as JSON. Repeated rows count once; of two texts of one
    path each is parsed, and the file is valid only if both are.
    """
    ext = F.lower(F.regexp_extract("file_path", r"(\.[A-Za-z0-9]+)$", 1))
    language = F.element_at(F.create_map(*[F.lit(x) for kv in grammars.EXTENSIONS.items() for x in kv]), F.when(ext.isin(*grammars.EXTENSIONS), ext))
    texts = source_files.filter(F.col("content").isNotNull() & F.col("file_path").isNotNull()).select("repo", "file_path", language.alias("language"), "content").filter(F.col("language").isNotNull())
    parsed = texts.mapInArrow(_parse, _PARSED)
    files = parsed.groupBy("repo", "file_path", "language").agg(F.min(F.struct("valid", "verdict", "parses_as", "accepted")).alias("v")).select("repo", "file_path", "language", "v.*")
    named = symbols.select(F.col("repo").alias("s_repo"), F.col("file_path").alias("s_path")).distinct()
    return files.join(named, files["repo"].eqNullSafe(named["s_repo"]) & (files["file_path"] == named["s_path"]), "left_semi")


def parse_rates(parsed: DataFrame) -> DataFrame:
    """Per repository and language: files, invalid files, their rate, and how many have a wrong extension."""
    return parsed.groupBy("repo", "language").agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(~F.col("valid")).alias("invalid"),
        F.round(F.count_if(~F.col("valid")) / F.count(F.lit(1)), 6).alias("invalid_rate"),
        F.count_if(F.col("verdict") == "wrong extension").alias("wrong_extension"),
    )
