"""Tokenizers, normalisers and digests as column functions, all native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"


def _extract(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), F.array().cast("array<string>"))


def _parts(text: Column, pattern: str) -> Column:
    return F.filter(F.split(text, pattern), lambda s: s != "")


def _camel_spaced(text: Column) -> Column:
    spaced = F.regexp_replace(text, r"([\p{Ll}\p{N}])(\p{Lu})", "$1 $2")
    return F.regexp_replace(spaced, r"(\p{Lu})(\p{Lu}\p{Ll})", "$1 $2")


def split_camel(word: Column) -> Column:
    """Parts at lower-or-digit to upper case, and before the last capital of a run; digits do not split."""
    return F.split(_camel_spaced(word), " ")


def atoms(text: Column) -> Column:
    """Runs of word characters, dots and hyphens that start with a word character, without trailing marks."""
    return F.filter(F.transform(_extract(text, WORD + r"[\p{L}\p{N}_.\-]*"), lambda a: F.regexp_replace(a, r"[.\-]+$", "")), lambda a: a != "")


def code_terms(text: Column) -> Column:
    """Every atom in its forms, lower case: whole, dot segments, snake and kebab parts, camel parts.

    Forms repeat across atoms, not within one. Null gives the empty array.
    """

    def forms(atom: Column) -> Column:
        segments = _parts(atom, r"\.")
        delimited = F.flatten(F.transform(segments, lambda s: F.concat(F.array(s), F.flatten(F.transform(_parts(s, "[_-]"), lambda p: F.concat(F.array(p), split_camel(p)))))))
        every = F.array_distinct(F.transform(F.concat(F.array(atom), delimited), lambda t: F.lower(t)))
        # most atoms are plain words: one form
        return F.when(atom.rlike(r"^\p{Lu}?[^\p{Lu}._\-]*$"), F.array(F.lower(atom))).otherwise(every)

    return F.flatten(F.transform(atoms(text), forms))


def whitespace_terms(text: Column) -> Column:
    """The fallback rung: lower case, split at white space."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda s: s != "")


def terms_or_words(text: Column) -> Column:
    """Code terms, or white-space words where there are none."""
    either = F.filter(F.array(code_terms(text), whitespace_terms(text)), lambda t: F.size(t) > 0)
    return F.coalesce(F.get(either, F.lit(0)), F.array().cast("array<string>"))


def hash_terms(text: Column) -> Column:
    """Terms of the hash embedder: runs of ``[0-9A-Za-z_$]``, each whole and in its parts, lower case."""

    def forms(run: Column) -> Column:
        parts = F.flatten(F.transform(_parts(run, "[_$]+"), lambda p: F.flatten(F.transform(split_camel(p), lambda c: _extract(c, r"[0-9]+|[^0-9]+")))))
        return F.transform(F.when(F.size(parts) > 1, F.concat(F.array(run), parts)).otherwise(F.array(run)), lambda t: F.lower(t))

    return F.flatten(F.transform(_extract(text, "[0-9A-Za-z_$]+"), forms))


def eval_terms(text: Column) -> Column:
    """Terms of the evaluation ranker: alphanumeric runs; camel parts first, then the run when it differs."""

    def forms(run: Column) -> Column:
        parts = F.transform(split_camel(run), lambda p: F.lower(p))
        return F.when(F.size(parts) > 1, F.concat(parts, F.array(F.lower(run)))).otherwise(parts)

    return F.flatten(F.transform(_extract(text, "[A-Za-z0-9]+"), forms))


def lexical_terms(text: Column) -> Column:
    """Terms of the lexical reranker: split at what is not alphanumeric and at changes of case, lower case."""
    return F.transform(_extract(_camel_spaced(text), "[A-Za-z0-9]+"), lambda t: F.lower(t))


def normalised_text(text: Column) -> Column:
    """Line ends to LF, no white space at line ends, one blank line at most, none at either end."""
    lf = F.regexp_replace(text, r"\r\n?", "\n")
    bare = F.regexp_replace(lf, r"[ \t\f\x0B]+(?=\n|$)", "")
    return F.regexp_replace(F.regexp_replace(bare, r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")


def digest(*parts: Column) -> Column:
    """32 hexadecimal digits over NUL-separated parts."""
    return F.substring(F.sha2(F.concat_ws("\x00", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 32)


def content_hash(text: Column) -> Column:
    return digest(normalised_text(text))


def chunk_id(text: Column, file_path: Column, start_line: Column) -> Column:
    return digest(text, file_path, start_line)


def family_id(symbol: Column, file_path: Column) -> Column:
    return digest(F.coalesce(symbol, F.lit("")), file_path)


def normalise_query(text: Column, longest: int = 2048) -> Column:
    """Without control characters, white space collapsed, at most ``longest`` characters."""
    clean = F.regexp_replace(text, r"[\p{C}&&[^\t\n\r]]", "")
    return F.rtrim(F.substring(F.trim(F.regexp_replace(clean, r"\s+", " ")), 1, longest))


def like_escaped(text: Column) -> Column:
    """The text with ``! % _`` escaped by ``!`` for a LIKE pattern."""
    return F.regexp_replace(text, "([!%_])", "!$1")


def module_stem(spec: Column) -> Column:
    """The last step of a module path without its extension."""
    return F.regexp_replace(F.element_at(F.split(spec, "/"), -1), r"\.(js|mjs|cjs|jsx|ts|tsx)$", "")


def normalise_file_path(path: Column) -> Column:
    r"""Forward slashes, no drive letter, no leading slash or ``./``."""
    return F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^[A-Za-z]:", ""), r"^(\./|/)+", "")


def bare_identifier(raw: Column) -> Column:
    """An identifier without quotes, call parentheses and punctuation around it."""
    inner = F.regexp_replace(F.regexp_replace(F.trim(raw), r"^[`'\"]+|[`'\"]+$", ""), r"\(\)$", "")
    return F.regexp_replace(F.trim(inner), r"""^[,;:.()\[\]{}"'`]+|[,;:.()\[\]{}"'`]+$""", "")


def callee_parts(callee: Column) -> tuple[Column, Column]:
    """The called name and its receiver (null without one)."""
    steps = F.split(callee, r"\.")
    receiver = F.array_join(F.slice(steps, 1, F.greatest(F.size(steps) - 1, F.lit(0))), ".")
    return F.element_at(steps, -1), F.when(F.size(steps) > 1, receiver)
