"""The structural index and its evidence: definitions, callers, callees, exports, imports, call order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomseek.functions.paths import canonical_path
from loomseek.functions.text import callee_parts, module_stem
from loomseek.operators.ranks import top_ranked
from loomseek.operators.spread import spread_rank

# The order in which evidence counts, per type of query.
PRIORITY = {
    "structural": ["ordered_pair", "caller", "definition", "callee", "export", "import"],
    "semantic": ["definition", "ordered_pair", "callee", "caller", "export", "import"],
    "usage": ["caller", "export", "import", "definition", "callee"],
    "hybrid": ["ordered_pair", "definition", "caller", "callee", "export", "import"],
}
# Scores of the tiers.
TIER_TOP, TIER_STEP, SUBSTRING, CORROBORATION, MOST_CORROBORATION = 0.95, 0.12, 0.20, 0.01, 5
PAIR_IDENTIFIERS = 6
OVERSAMPLE = 4
EXTENSIONS = [".js", ".mjs", ".cjs", ".jsx", ".ts", ".tsx"]


# What relations from chunks say where chunks say nothing.
IMPORT_KIND, IMPORT_LINE, EXPORT_KIND = "esm_namespace", 1, "named"


def _one_a_chunk(chunks: DataFrame) -> DataFrame:
    """One row per repository and chunk, the same in every relation."""
    place = F.struct(F.coalesce("file_path", F.lit("")), F.coalesce("start_line", F.lit(0)), F.coalesce("version_id", F.lit("")))
    cols = [c for c in ("symbol", "kind", "parent_symbol", "file_path", "start_line", "end_line", "start_byte", "end_byte", "is_exported", "language", "version_id", "imports", "calls") if c in chunks.columns]
    return chunks.filter(F.col("chunk_id").isNotNull()).groupBy(F.coalesce("repo", F.lit("")).alias("repo"), "chunk_id").agg(*[F.min_by(c, place).alias(c) for c in cols])


def symbols_of(chunks: DataFrame) -> DataFrame:
    """One symbol row per chunk; ids are dense per repository in the order of path, line and chunk id, in repositories of any size."""
    one = _one_a_chunk(chunks).drop("imports", "calls").withColumn("file_path", F.coalesce("file_path", F.lit("")))
    return spread_rank(one, ["repo"], [F.col("file_path"), F.col("start_line"), F.col("chunk_id")], "symbol_id").drop("symbol_id_of")


def calls_of(chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """Call rows in source order with resolved callees. Repeats are kept, a blank name leaves a gap in the order; the line is that of the chunk."""
    ids = symbols.select("repo", "chunk_id", F.col("symbol_id").alias("caller_id"))
    raw = _one_a_chunk(chunks).select("repo", "chunk_id", "file_path", "version_id", F.col("start_line").alias("call_line"), F.posexplode("calls").alias("call_order", "callee"))
    name, receiver = callee_parts(F.trim("callee"))
    rows = raw.join(ids, ["repo", "chunk_id"]).select("repo", "file_path", "version_id", "caller_id", name.alias("callee_name"), "call_order", "call_line", receiver.isNotNull().alias("is_method"), receiver.alias("receiver"))
    return resolved(rows.filter(F.col("callee_name") != ""), symbols)


def imports_of(chunks: DataFrame) -> DataFrame:
    """Import rows, one per file and specifier, with the path a relative one resolves to among the files of the chunks.

    A bare specifier, and one that leaves the repository, stays unresolved.
    """
    one = _one_a_chunk(chunks)
    rows = one.select("repo", "file_path", "version_id", F.explode(F.transform("imports", lambda m: F.trim(m))).alias("module_spec")).filter((F.col("module_spec") != "") & F.col("file_path").isNotNull())
    specs = rows.groupBy("repo", "file_path", "module_spec").agg(F.min("version_id").alias("version_id"))
    target = canonical_path(F.concat(F.regexp_replace("file_path", "[^/]+$", ""), "module_spec"))
    inside = specs.filter(F.startswith("module_spec", F.lit("."))).select("repo", "file_path", "module_spec", target.alias("target")).filter(~F.startswith("target", F.lit("..")))
    found = resolved_modules(inside, one.select("repo", "file_path").distinct())
    none = F.lit(None).cast("string")
    return specs.join(found, ["repo", "file_path", "module_spec"], "left").select(
        "repo", "file_path", "module_spec", F.col("resolved").alias("resolved_path"), none.alias("imported_name"), none.alias("local_alias"), F.lit(IMPORT_KIND).alias("import_kind"), F.lit(IMPORT_LINE).alias("import_line"), "version_id"
    )


def exports_of(symbols: DataFrame) -> DataFrame:
    """Export rows of exported symbols, one per file and name: the first in the order of ids."""
    rows = symbols.filter(F.col("is_exported") & F.col("symbol").isNotNull() & (F.col("symbol") != ""))
    first = rows.groupBy("repo", "file_path", F.col("symbol").alias("exported_name")).agg(F.min(F.struct("symbol_id", F.col("start_line").alias("export_line"), "version_id")).alias("f"))
    return first.select("repo", "file_path", "exported_name", F.col("exported_name").alias("local_name"), "f.symbol_id", F.lit(EXPORT_KIND).alias("export_kind"), "f.export_line", "f.version_id")


def relations_of(chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Symbols, calls, imports and exports of a table of chunks, symbol ids made unique over all repositories."""
    symbols = symbols_of(chunks)
    every = symbols.withColumn("symbol_id", F.xxhash64("repo", "symbol_id"))
    return every, calls_of(chunks, every), imports_of(chunks), exports_of(every)


def resolved(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """``callee_id``: the first definition in the caller's file, else the only definition in the repository, else null."""
    named = symbols.filter(F.col("symbol").isNotNull())
    own = named.groupBy("repo", "file_path", F.col("symbol").alias("callee_name")).agg(F.min("symbol_id").alias("own_id"))
    only = named.groupBy("repo", F.col("symbol").alias("callee_name")).agg(F.min("symbol_id").alias("only_id"), F.countDistinct("symbol_id").alias("n")).filter("n = 1").drop("n")
    return calls.join(own, ["repo", "file_path", "callee_name"], "left").join(only, ["repo", "callee_name"], "left").withColumn("callee_id", F.coalesce("own_id", "only_id")).drop("own_id", "only_id")


def resolved_modules(specs: DataFrame, files: DataFrame) -> DataFrame:
    """``repo, file_path, module_spec, resolved``: the first candidate of a relative path that is a known file.

    specs: ``repo, file_path, module_spec, target`` (target without spelling variants); candidates are the path itself,
    with an extension, and as a folder's index with one.
    """
    tries = ["", *EXTENSIONS, *[f"/index{e}" for e in EXTENSIONS]]
    every = specs.select("*", F.posexplode(F.array(*[F.concat("target", F.lit(t)) for t in tries])).alias("n", "candidate"))
    known = files.select(F.col("repo"), F.col("file_path").alias("candidate")).distinct()
    hits = every.join(known, ["repo", "candidate"]).groupBy("repo", "file_path", "module_spec").agg(F.min_by("candidate", "n").alias("resolved"))
    return specs.select("repo", "file_path", "module_spec").distinct().join(hits, ["repo", "file_path", "module_spec"], "left")


def file_representatives(symbols: DataFrame) -> DataFrame:
    """``repo, file_path, chunk_id``: one chunk for a file, its module chunk first, then by line and id."""
    order = Window.partitionBy("repo", "file_path").orderBy((F.coalesce("kind", F.lit("")) != "module").cast("int"), "start_line", "chunk_id")
    return symbols.withColumn("_n", F.row_number().over(order)).filter("_n = 1").select("repo", "file_path", "chunk_id")


def definitions(identifiers: DataFrame, symbols: DataFrame) -> DataFrame:
    """identifiers: ``query_id, pos, identifier``. Chunks that define one of them."""
    return identifiers.join(symbols, F.col("identifier") == F.col("symbol")).select("query_id", "identifier", "repo", "chunk_id", F.lit("definition").alias("evidence"), F.concat(F.lit("defines "), "identifier").alias("detail")).distinct()


def callers(identifiers: DataFrame, calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Chunks that call one of the identifiers by name."""
    by = symbols.select(F.col("symbol_id").alias("caller_id"), "chunk_id").distinct()
    edges = calls.select("repo", "caller_id", "callee_name").distinct()
    return identifiers.join(edges, F.col("identifier") == F.col("callee_name")).join(by, "caller_id").select("query_id", "identifier", "repo", "chunk_id", F.lit("caller").alias("evidence"), F.concat(F.lit("calls "), "identifier").alias("detail")).distinct()


def callees(identifiers: DataFrame, calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Chunks that a definition of one of the identifiers calls, by resolved id."""
    start = symbols.select(F.col("symbol_id").alias("caller_id"), F.col("symbol")).distinct()
    end = symbols.select(F.col("symbol_id").alias("callee_id"), "chunk_id").distinct()
    edges = calls.filter(F.col("callee_id").isNotNull()).select("repo", "caller_id", "callee_id").distinct()
    return (
        identifiers.join(start, F.col("identifier") == F.col("symbol")).join(edges, "caller_id").join(end, "callee_id")
        .select("query_id", "identifier", "repo", "chunk_id", F.lit("callee").alias("evidence"), F.concat(F.lit("called by "), "identifier").alias("detail")).distinct()
    )


def exporters(identifiers: DataFrame, exports: DataFrame, symbols: DataFrame) -> DataFrame:
    """Chunks whose export has the identifier's name, and all exports of the module it names."""
    chunk = symbols.select("symbol_id", "chunk_id").distinct()
    rows = exports.filter(F.col("symbol_id").isNotNull()).select("repo", "exported_name", "file_path", "symbol_id").distinct()
    by_name = identifiers.join(rows, F.col("identifier") == F.col("exported_name"))
    stem = identifiers.withColumn("stem", module_stem(F.col("identifier")))
    by_module = stem.join(rows.withColumn("file_stem", module_stem(F.col("file_path"))), F.col("stem") == F.col("file_stem"))
    every = by_name.select("query_id", "identifier", "repo", "symbol_id").unionByName(by_module.select("query_id", "identifier", "repo", "symbol_id"))
    return every.join(chunk, "symbol_id").select("query_id", "identifier", "repo", "chunk_id", F.lit("export").alias("evidence"), F.concat(F.lit("exports "), "identifier").alias("detail")).distinct()


def importers(identifiers: DataFrame, imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """The representative chunk of each file that imports the identifier's module (or that name), with the least specifier."""
    rows = imports.select("repo", "file_path", "module_spec", F.explode(F.array_distinct(F.array(module_stem(F.col("module_spec")), F.col("module_spec"), F.coalesce("imported_name", F.lit(""))))).alias("key")).filter("key <> ''").distinct()
    keys = identifiers.select("query_id", "identifier", F.explode(F.array_distinct(F.array("identifier", module_stem(F.col("identifier"))))).alias("key"))
    files = keys.join(rows, "key").groupBy("query_id", "identifier", "repo", "file_path").agg(F.min("module_spec").alias("spec"))
    return files.join(file_representatives(symbols), ["repo", "file_path"]).select("query_id", "identifier", "repo", "chunk_id", F.lit("import").alias("evidence"), F.concat(F.lit("imports "), "spec").alias("detail")).distinct()


def ordered_pairs(identifiers: DataFrame, calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Chunks that call one identifier before a later one of the query: the least place of the first precedes the greatest of the second.

    Calls are first reduced to their first and last place per caller and name, and both sides join those by key, so a
    frequent name meets only the callers of the other. A pair of one name asks for two calls of it.
    """
    a = identifiers.filter(F.col("pos") < PAIR_IDENTIFIERS)
    pairs = a.select("query_id", F.col("pos").alias("p1"), F.col("identifier").alias("x")).join(a.select("query_id", F.col("pos").alias("p2"), F.col("identifier").alias("y")), "query_id").filter("p1 < p2").drop("p1", "p2").distinct()
    places = calls.groupBy("repo", "caller_id", "callee_name").agg(F.min("call_order").alias("lo"), F.max("call_order").alias("hi"))
    first = pairs.join(places.select("repo", "caller_id", F.col("callee_name").alias("x"), "lo"), "x")
    hit = first.join(places.select("repo", "caller_id", F.col("callee_name").alias("y"), "hi"), ["repo", "caller_id", "y"]).filter("lo < hi")
    by = symbols.select(F.col("symbol_id").alias("caller_id"), "chunk_id").distinct()
    return hit.join(by, "caller_id").select("query_id", F.col("x").alias("identifier"), "repo", "chunk_id", F.lit("ordered_pair").alias("evidence"), F.concat(F.lit("calls "), "x", F.lit(" before "), "y").alias("detail")).distinct()


def substring_hits(identifiers: DataFrame, symbols: DataFrame) -> DataFrame:
    """The last rung: symbols that contain an identifier in any case; wildcards in it mean themselves.

    A containment test has no key: pairs meet by the identifier's first (up to) three characters among the character
    grams of the distinct symbol names, and are then tested.
    """
    names = symbols.filter(F.col("symbol").isNotNull()).select("symbol", F.lower("symbol").alias("low")).distinct()

    def grams(n: int):
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length("low") - n + 1, F.lit(1))), lambda i: F.substring(F.col("low"), i, F.lit(n)))

    q = identifiers.withColumn("want", F.lower("identifier")).withColumn("gram", F.substring("want", 1, 3))
    s = names.withColumn("gram", F.explode(F.array_distinct(F.concat(grams(1), grams(2), grams(3)))))
    pairs = q.join(s, "gram").filter(F.contains("low", F.col("want"))).select("query_id", "identifier", "symbol").distinct()
    return pairs.join(symbols.select("repo", "chunk_id", "symbol").distinct(), "symbol").select("query_id", "identifier", "repo", "chunk_id", F.lit("substring").alias("evidence"), F.concat(F.lit("name contains "), "identifier").alias("detail")).distinct()


def routing(spark) -> DataFrame:
    """``query_type, evidence, tier``."""
    rows = [(t, e, round(TIER_TOP - TIER_STEP * i, 9)) for t, kinds in PRIORITY.items() for i, e in enumerate(kinds)]
    rows += [(t, "substring", SUBSTRING) for t in PRIORITY]
    return spark.createDataFrame(rows, "query_type string, evidence string, tier double")


def fold_evidence(hits: DataFrame, query_types: DataFrame, k: int) -> DataFrame:
    """``query_id, chunk_id, score, rank, reason``: best tier plus a capped bonus per further kind of evidence.

    hits: ``query_id, chunk_id, evidence, detail``; query_types: ``query_id, query_type``. Evidence that the
    query's type does not use is dropped; details are joined in the order of their tiers.
    """
    tiers = routing(hits.sparkSession)  # 27 rows
    rows = hits.join(query_types, "query_id").join(F.broadcast(tiers), ["query_type", "evidence"])
    folded = rows.groupBy("query_id", "chunk_id").agg(
        F.max("tier").alias("tier"), F.countDistinct("evidence").alias("kinds"), F.sort_array(F.collect_set(F.struct((-F.col("tier")).alias("t"), F.col("detail").alias("d")))).alias("details")
    )
    score = F.col("tier") + F.lit(CORROBORATION) * F.least(F.col("kinds") - 1, F.lit(MOST_CORROBORATION))
    return top_ranked(folded.withColumn("score", score), k, ["query_id"]).select("query_id", "chunk_id", "score", "rank", F.array_join(F.transform("details", lambda d: d["d"]), "; ").alias("reason"))


def structural_search(plans: DataFrame, symbols: DataFrame, calls: DataFrame, imports: DataFrame, exports: DataFrame, k: int, widest: int | None = None) -> DataFrame:
    """plans: ``query_id, query_type, identifiers``. Graph evidence, and substrings for queries without any.

    All evidence is folded before the best ``k`` are taken. With ``widest``, the reference's way, only so many chunks of least
    id count per query, kind and identifier; what lies beyond is lost whatever its score.
    """
    ids = plans.select("query_id", F.posexplode("identifiers").alias("pos", "identifier")).filter(F.col("identifier") != "")
    exact = reduce(DataFrame.unionByName, [definitions(ids, symbols), callers(ids, calls, symbols), callees(ids, calls, symbols), exporters(ids, exports, symbols), importers(ids, imports, symbols), ordered_pairs(ids, calls, symbols)])
    routed = exact.join(plans.select("query_id", "query_type"), "query_id").join(F.broadcast(routing(exact.sparkSession).drop("tier")), ["query_type", "evidence"], "left_semi")
    if widest is not None:
        capped = Window.partitionBy("query_id", "evidence", "identifier").orderBy("chunk_id")
        routed = routed.withColumn("_n", F.row_number().over(capped)).filter(F.col("_n") <= widest).drop("_n")
    routed = routed.drop("query_type")
    lost = ids.join(routed.select("query_id").distinct(), "query_id", "left_anti")
    hits = routed.unionByName(substring_hits(lost, symbols))
    return fold_evidence(hits, plans.select("query_id", "query_type"), k)


def structural_stats(symbols: DataFrame, calls: DataFrame, imports: DataFrame, exports: DataFrame) -> DataFrame:
    """One row: sizes of the four relations and the share of calls that are resolved."""
    one = lambda df, *c: df.agg(*c)
    a = one(symbols, F.countDistinct("symbol_id").alias("symbols"))
    b = one(calls.dropDuplicates(["call_id"]), F.count(F.lit(1)).alias("calls"), F.round(F.avg(F.col("callee_id").isNotNull().cast("double")), 6).alias("resolved_share"))
    c = one(imports, F.countDistinct("import_id").alias("imports"))
    d = one(exports, F.countDistinct("export_id").alias("exports"))
    return a.crossJoin(b).crossJoin(c).crossJoin(d)  # one row each
