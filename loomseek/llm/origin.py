"""Problem 1: generated, minified or vendored source files.

Method: character n-gram models of identifiers, one per language, trained on the declared names of the
whole corpus without the files that the first models find strange. Names of high cross-entropy are mangled: minified. Names made
of few parts, by the entropy of their parts, follow a template: generated. Names whose style costs many bits under the style
model of the rest of the repository, but none under a style of their own, are foreign: vendored. Files that are literals
with hardly a name are data.

Beside the names three facts count: a third party's folder, and the marks of tools, third parties and bundlers. ``evidence``
tells which of the two named a file.

One pass over the chunks extracts names and counts, which are folded into one row per file; the models (at most ALPHABET**3
counts per language) and the scores are computed from those alone.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomseek.session import staged

# The language of a file extension; other extensions are no source.
LANGUAGES = {"js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "py": "python"}

ALPHABET = "^$0_abcdefghijklmnopqrstuvwxyz?"
#: A file is mangled if its names cost so many robust deviations more than is usual for the language's files and than a natural name
#: that the model has not seen costs, nearly as many bits a character as random letters do (this share of the logarithm of the
#: alphabet's size), and in all so many bits more than usual: one odd name is none.
MANGLED_DEVIATIONS = 8.0
MANGLED_RANDOM = 0.9
MANGLED_EVIDENCE = 100.0
#: Files that cost so many deviations more than usual do not train the models.
UNUSUAL = 4.0
#: Entropy of the parts of the defined names, as a share of what as many different parts would have, below which they follow a
#: template; and from so many parts on.
TEMPLATE = 0.65
TEMPLATE_PARTS = 12
#: Bits a name, and bits in all, by which a style is foreign to its repository.
FOREIGN_BITS = 2.0
FOREIGN_EVIDENCE = 24.0
#: Share of visible bytes in literals that makes data, and from so many visible bytes on.
LITERAL = 0.6
DATA_BYTES = 200
#: Marks of a bundler that make a bundle.
BUNDLE_MARKS = 3

# Folders that hold third-party copies by convention.
THIRD_PARTY = ["vendor", "_vendor", "third_party", "thirdparty", "node_modules", "deps", "external", "site-packages", "bower_components"]

_STRING = re.compile(r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`(?:[^`\\]|\\.)*`')
# strings are kept as group 1: a comment mark inside one is none
_COMMENT = {
    "c": re.compile(rf"({_STRING.pattern})" + r"|/\*[\s\S]*?(?:\*/|\Z)|//[^\n]*"),
    "python": re.compile(r'"""[\s\S]*?(?:"""|\Z)|\'\'\'[\s\S]*?(?:\'\'\'|\Z)|(' + r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'' + r")|#[^\n]*"),
}
_NUMBER = re.compile(r"(?<![\w$])-?(?:0[xX][\da-fA-F]+|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)")
# Each pattern begins with a literal, which the engine finds without trying every position.
_DEFINED = {
    "c": [re.compile(r"function\s*\*?\s*([A-Za-z_$][\w$]*)"), re.compile(r"exports\.([A-Za-z_$][\w$]*)\s*="), re.compile(r"class\s+([A-Za-z_$][\w$]*)"), re.compile(r"interface\s+([A-Za-z_$][\w$]*)"), re.compile(r"enum\s+([A-Za-z_$][\w$]*)")],
    "python": [re.compile(r"def\s+(\w+)\("), re.compile(r"class\s+(\w+)")],
}
_METHOD = re.compile(r"\s*(?:(?:static|async|get|set|public|private|protected) )*([A-Za-z_$][\w$]*)\([^()]*\)(?:: [\w<>\[\], ]+)? \{$")
_NAMED = {
    "c": [re.compile(r"var\s+([A-Za-z_$][\w$]*)"), re.compile(r"let\s+([A-Za-z_$][\w$]*)"), re.compile(r"const\s+([A-Za-z_$][\w$]*)"), re.compile(r"function\s*[\w$]*\(([\w$, ]*)\)"), re.compile(r"catch\s*\((\w+)\)")],
    "python": [re.compile(r"def\s+\w+\(([\w, ]*)"), re.compile(r"for\s+(\w+)\s+in\b"), re.compile(r"\n[ \t]*(\w+)\s*=[^=]")],
}
_ARROW = re.compile(r"(?:\(([\w$, ]*)\)|([A-Za-z_$][\w$]*))\s*$")
_IMPORTS = re.compile(r"^\s*(?:import\b|from\s+[\w.]+\s+import\b|export\s.*\bfrom\b)|\brequire\(['\"]", re.M)
_BUNDLE = re.compile(r"/\*\*\*/|\b__\w*req\w*__\b|\bfunction ?\(modules?\b", re.I)
# How third-party copies and tools mark their files.
_FOREIGN = re.compile(r"(?im)copied from \S+@\d|unmodified upstream release|\bv?\d+\.\d+\.\d+ (?:\||- \d{4})|^[\s/*#!]*[@\w./-]+ v?\d+\.\d+\.\d+[ \t\r]*$|upstream license|\blicensed (?:mit|isc|bsd|apache)")
_TOOL = re.compile(
    r"(?i)^[\s/*#<!-]*(?:@generated\b|code generated by .*do not edit|<auto-generated>|autogenerated file|this file was automatically generated|generated on \d.*do not modify|this is a generated source|machine written|diese datei wurde von .* erzeugt)", re.M
)


def name_features(text: str, language: str, first: bool) -> tuple:
    """Of one chunk: defined names, all declared names, and counts of visible, literal and marker bytes."""
    family = "python" if language == "python" else "c"
    # the leading comment only: marks further down belong to something else
    lead = _LEAD.match(text).group() if first else ""
    bare = _COMMENT[family].sub(r"\1 ", text)
    visible = len("".join(bare.split()))
    code = _STRING.sub('""', bare)
    defined = [n for p in _DEFINED[family] for n in p.findall(code)]
    lists = [n for p in _NAMED[family] for n in p.findall(code)]
    if family == "c":
        if ") {\n" in code or "> {\n" in code:
            for line in code.split("\n"):
                if line.endswith("{"):
                    m = _METHOD.match(line)
                    if m and m.group(1) not in _KEYWORDS:
                        defined.append(m.group(1))
        if "=>" in code:
            for before in code.split("=>")[:-1]:
                before = before.rstrip()
                m = _ARROW.search(before[before.rfind("(") if before.endswith(")") else -200 :])
                if m:
                    lists.append(m.group(1) or m.group(2) or "")
    others = [n for part in lists for n in _SEPARATOR.split(part) if n]
    # only a file without definitions can be data: elsewhere the literals need no count
    literal = 0 if defined else max(0, visible - len("".join(code.split()))) + 2 * code.count('""') + sum(map(len, _NUMBER.findall(code)))
    return (
        defined,
        sorted({*defined, *others}),
        visible,
        literal,
        len(_IMPORTS.findall(code)) if "import" in code or "require(" in code else 0,
        len(_BUNDLE.findall(text)) if "/***/" in text or "__" in text or "modules" in text else 0,
        int(bool(_FOREIGN.search(lead))),
        int(bool(_TOOL.search(lead))),
    )


_LEAD = re.compile(r"(?:\ufeff?#![^\n]*\n)?\s*(?:(?:/\*[\s\S]*?\*/|//[^\n]*\n?|#[^\n]*\n?)\s*)*")
_SEPARATOR = re.compile(r"[\s,]+")
_KEYWORDS = frozenset("if for while switch catch function return with else do try constructor super".split())


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols = {k: [] for k in ("defined", "names", *_COUNTS)}
        for text, language, line in zip(b.column(3).to_pylist(), b.column(2).to_pylist(), b.column(4).to_pylist()):
            got = name_features(text or "", language, line in (None, 1))
            cols["defined"].append(sorted(set(got[0])))
            cols["names"].append(got[1])
            for k, v in zip(_COUNTS, got[2:]):
                cols[k].append(v)
        arrays = [b.column(0), b.column(1), b.column(2), b.column(5)]
        for k in cols:
            arrays.append(pa.array(cols[k], type=pa.list_(pa.string()) if k in ("names", "defined") else pa.int64()))
        yield pa.record_batch(arrays, names=["repo", "file_path", "language", "chunk_id", *cols])


_COUNTS = ("visible", "literal", "imports", "bundle", "foreign", "tool")


def file_features(chunks: DataFrame) -> DataFrame:
    """One row per source file: its distinct names, and the sums of its chunks' counts (repeated rows once)."""
    ext = F.lower(F.regexp_extract("file_path", r"\.([A-Za-z0-9]+)$", 1))
    language = F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), F.when(ext.isin(*LANGUAGES), ext))
    rows = chunks.filter(F.col("file_path").isNotNull() & F.col("text").isNotNull()).select("repo", "file_path", language.alias("language"), "text", "start_line", "chunk_id").filter(F.col("language").isNotNull())
    schema = "repo string, file_path string, language string, chunk_id string, defined array<string>, names array<string>, " + ", ".join(f"{c} bigint" for c in _COUNTS)
    found = rows.mapInArrow(_extract, schema)
    union = lambda c: F.array_distinct(F.flatten(F.collect_set(c))).alias(c)
    files = found.groupBy("repo", "file_path", "language").agg(union("defined"), union("names"), F.collect_set(F.struct("chunk_id", *_COUNTS)).alias("parts"))
    total = lambda c: F.aggregate(F.col(f"parts.{c}"), F.lit(0).cast("bigint"), lambda a, x: a + x).alias(c)
    return files.select("repo", "file_path", "language", "defined", "names", *[total(c) for c in _COUNTS])


_SEAM = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


def _letters(name: str) -> str:
    """The name as the models see it: the parts of every style joined alike, digits as one."""
    name = re.sub(r"\d+", "0", _SEAM.sub("_", name).lower())
    return "^^" + "".join(c if c in ALPHABET else "?" for c in name) + "$"


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts: dict[str, Counter] = {}
        for language, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            s = _letters(n)
            counts.setdefault(language, Counter()).update(s[i : i + 3] for i in range(len(s) - 2))
        rows = [(la, g, n) for la, c in counts.items() for g, n in c.items()]
        yield pa.record_batch([pa.array([r[k] for r in rows], type=t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["language", "gram", "n"])


def distinct_names(files: DataFrame) -> DataFrame:
    """``language, name``: each name once, however many files declare it."""
    return files.select("language", F.explode("names").alias("name")).distinct()


def train(names: DataFrame) -> dict[str, np.ndarray]:
    """Per language the counts of the character trigrams of the names."""
    grams = names.mapInArrow(_count_grams, "language string, gram string, n bigint").groupBy("language", "gram").agg(F.sum("n").alias("n"))
    size, index = len(ALPHABET), {c: i for i, c in enumerate(ALPHABET)}
    counts: dict[str, np.ndarray] = {}
    for r in grams.collect():
        a, b, c = (index[x] for x in r["gram"])
        counts.setdefault(r["language"], np.zeros((size, size, size)))[a, b, c] = r["n"]
    return counts


def _costs(n: np.ndarray, held_out: int = 0) -> np.ndarray:
    """``-log2 p(c | a, b)``, smoothed by bigrams; ``held_out`` occurrences of each trigram do not count."""
    by_two = n.sum(axis=0) + 0.1
    back = by_two / by_two.sum(axis=1, keepdims=True)
    return -np.log2((np.maximum(n - held_out, 0) + 4 * back[None]) / (np.maximum(n.sum(axis=2, keepdims=True) - held_out, 0) + 4))


def _new_name_costs(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    models = {k: _costs(v, 1).tolist() for k, v in shared.value.items()}
    index = {c: i for i, c in enumerate(ALPHABET)}
    for b in batches:
        out = []
        for language, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            m, s = models[language], [index[c] for c in _letters(n)]
            out.append(sum(m[s[i]][s[i + 1]][s[i + 2]] for i in range(len(s) - 2)) / (len(s) - 2))
        yield pa.record_batch([b.column(0), pa.array(out, pa.float64())], names=["language", "bits"])


def new_name_cost(names: DataFrame, models: dict[str, np.ndarray]) -> DataFrame:
    """``language, new_name``: the median bits a character of a name that the model has not seen (each is left out in turn)."""
    shared = names.sparkSession.sparkContext.broadcast(models)
    return names.mapInArrow(partial(_new_name_costs, shared=shared), "language string, bits double").groupBy("language").agg(F.expr("percentile_approx(bits, 0.5, 1000)").alias("new_name"))


_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def part_entropy(defined: list[str]) -> tuple[float, int]:
    """Entropy of the parts of the names, as a share of the greatest possible, and the number of parts. Numbers are no parts."""
    parts = Counter(p.lower() for n in defined for p in _PART.findall(n))
    total = sum(parts.values())
    if total < 2:
        return 1.0, total
    return -sum(c / total * math.log2(c / total) for c in parts.values()) / math.log2(total), total


STYLES = ("snake", "camel", "mixed")


def style(name: str) -> str | None:
    """The style of a function's name; names that fit every style, types and constants have none."""
    name = name.strip("_$0123456789")
    lower, upper, joined = any(c.islower() for c in name), any(c.isupper() for c in name), "_" in name
    if joined and lower:
        return "mixed" if upper else "snake"
    return "camel" if lower and upper and name[:1].islower() else None


def _score(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    models = {k: _costs(v).tolist() for k, v in shared.value.items()}
    index = {c: i for i, c in enumerate(ALPHABET)}
    cache: dict[tuple[str, str], tuple[float, int]] = {}
    for b in batches:
        bits, chars, entropy, parts, styles = [], [], [], [], []
        for language, defined, names in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()):
            total, length = 0.0, 0
            for n in names if language in models else ():
                key = (language, n)
                if key not in cache:
                    if len(cache) > 200_000:
                        cache.clear()
                    m, s = models[language], [index[c] for c in _letters(n)]
                    cache[key] = (sum(m[s[i]][s[i + 1]][s[i + 2]] for i in range(len(s) - 2)), len(s) - 2)
                x, y = cache[key]
                total += x
                length += y
            bits.append(total)
            chars.append(length)
            e, k = part_entropy(defined)
            entropy.append(e)
            parts.append(k)
            styles.append(Counter(style(n) for n in defined))
        keep = [k for k in range(b.num_columns) if k not in (3, 4)]
        more = {"n_defined": pa.array([len(d or ()) for d in b.column(3).to_pylist()], pa.int64()), "bits": pa.array(bits, pa.float64()), "chars": pa.array(chars, pa.int64()), "entropy": pa.array(entropy, pa.float64()), "parts": pa.array(parts, pa.int64())}
        more |= {s: pa.array([c[s] for c in styles], pa.int64()) for s in STYLES}
        yield pa.record_batch([*[b.column(k) for k in keep], *more.values()], names=[*[b.schema[k].name for k in keep], *more])


_SCORED = (
    "repo string, file_path string, language string, " + ", ".join(f"{c} bigint" for c in _COUNTS) + ", n_defined bigint, bits double, chars bigint, entropy double, parts bigint, " + ", ".join(f"{s} bigint" for s in STYLES)
)


def _scored(files: DataFrame, models: dict[str, np.ndarray]) -> DataFrame:
    shared = files.sparkSession.sparkContext.broadcast(models)
    return files.mapInArrow(partial(_score, shared=shared), _SCORED).withColumn("bits_per_char", F.when(F.col("chars") > 0, F.col("bits") / F.col("chars")))


def _usual(scored: DataFrame) -> DataFrame:
    """``language, usual, deviation`` of the files' bits a character: median and scaled median absolute deviation."""
    middle = lambda c: F.expr(f"percentile_approx({c}, 0.5, 1000)")
    usual = scored.filter(F.col("bits_per_char").isNotNull()).groupBy("language").agg(middle("bits_per_char").alias("usual"))
    off = scored.join(F.broadcast(usual), "language").withColumn("off", F.abs(F.col("bits_per_char") - F.col("usual")))
    return usual.join(off.groupBy("language").agg((1.4826 * middle("off")).alias("deviation")), "language")


def file_scores(chunks: DataFrame) -> DataFrame:
    """One row per source file with its counts, ``bits_per_char`` of its names under the language's model, what is ``usual`` there, the
    ``entropy`` of its names' parts, and ``foreign_bits``: what its style costs a name more under the rest of the repository than under
    its own."""
    files = staged(file_features(chunks))
    first = _scored(files, train(distinct_names(files)))
    # names of files that are strange under the first models do not train the second
    by = _usual(first)
    plain = first.join(F.broadcast(by), "language").filter(F.col("bits_per_char") <= F.col("usual") + UNUSUAL * F.col("deviation")).select("repo", "file_path", "language")
    same = [files[c].eqNullSafe(plain[c]) for c in ("repo", "file_path", "language")]
    names = staged(distinct_names(files.join(plain, same[0] & same[1] & same[2], "left_semi")))
    models = train(names)
    scored = staged(_scored(files, models))
    all_of = scored.groupBy(F.col("repo").alias("of_repo"), F.col("language").alias("of_language")).agg(*[F.sum(s).alias(f"all_{s}") for s in STYLES])
    f = scored.join(F.broadcast(_usual(scored).join(new_name_cost(names, models), "language", "left")), "language", "left")
    f = f.join(all_of, f["repo"].eqNullSafe(all_of["of_repo"]) & (f["language"] == all_of["of_language"])).drop("of_repo", "of_language")
    styled = sum(F.col(s) for s in STYLES)
    others = sum(F.col(f"all_{s}") for s in STYLES) - styled
    # cross-entropy under the other files' styles less the entropy of the file's own
    cost = sum(F.when(F.col(s) > 0, F.col(s) * (F.log2(F.col(s) / styled) - F.log2((F.col(f"all_{s}") - F.col(s) + 0.5) / (others + 0.5 * len(STYLES))))).otherwise(0.0) for s in STYLES)
    return f.withColumn("styled", styled).withColumn("foreign_bits", F.when(styled > 0, cost / styled).otherwise(0.0))


def file_origins(chunks: DataFrame) -> DataFrame:
    """Every source file with ``origin``: minified, bundled, generated, vendored, data or hand-written, and ``evidence``: ``names``
    where the models of its names (or, for data, their absence) decide, else ``mark``.

    Files without a known source extension (JSON among them) have no row. Null texts count for nothing,
    a null repository is one of its own, repeated rows count once. A file without names is data if
    it is literals, else hand-written.
    """
    f = file_scores(chunks)
    # more than is usual, and more than a natural name costs that the model has not seen
    excess = F.coalesce(F.col("bits_per_char") - F.greatest("usual", "new_name"), F.lit(0.0))
    random_letters = F.col("bits_per_char") >= MANGLED_RANDOM * math.log2(len(ALPHABET))
    mangled = random_letters & (excess >= MANGLED_DEVIATIONS * F.col("deviation")) & (excess * F.col("chars") >= MANGLED_EVIDENCE)
    template = (F.col("parts") >= TEMPLATE_PARTS) & (F.col("entropy") < TEMPLATE)
    # a style alone may be that of one author: the file must have no tie to the repository
    foreign_style = (F.col("foreign_bits") >= FOREIGN_BITS) & (F.col("foreign_bits") * F.col("styled") >= FOREIGN_EVIDENCE) & (F.col("imports") == 0)
    data = (F.col("literal") >= LITERAL * F.col("visible")) & (F.col("n_defined") == 0) & (F.col("visible") >= DATA_BYTES)
    third_party = F.arrays_overlap(F.split("file_path", "/"), F.array(*[F.lit(x) for x in THIRD_PARTY])) | (F.col("foreign") > 0)
    by_names = F.when(template, "generated").when(foreign_style, "vendored").when(mangled, "minified").when(data, "data")
    by_marks = F.when(F.col("bundle") >= BUNDLE_MARKS, "bundled").when(third_party, "vendored").when(F.col("tool") > 0, "generated")
    return f.withColumn("origin", F.coalesce(by_names, by_marks, F.lit("hand-written"))).withColumn("evidence", F.when(by_names.isNotNull(), "names").when(by_marks.isNotNull(), "mark"))
