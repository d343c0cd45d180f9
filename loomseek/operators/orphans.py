"""Problem 3: references to records that do not exist.

Method: keys are dictionary-encoded as integers and kept as compressed bitmaps per key range and period. Per
period the bitmap of referenced keys AND NOT the bitmap of keys that surely lived through the whole
period leaves the suspects; their bits are decoded, and only their references are held exactly
against the lives of the target. A suspect is a key that is unknown, was born in or after the
period, or had died by its end.

All keys are encoded, integers too: a code is dense whatever the ids are, so a bitmap of a range holds as many keys as it has bits for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from loomseek.functions.paths import canonical_path
from loomseek.session import staged

#: Keys of one bitmap: the size Spark's bitmap functions fix.
RANGE = 32768
#: Average keys that the dictionary puts into one range; a hash range stays well below RANGE.
DICTIONARY_FILL = 16384
#: Parts into which the references of one suspect key are spread.
SALTS = 32


def dictionary(marks: DataFrame, n_keys: int) -> DataFrame:
    """``marks`` (with ``space, key``) with ``range``, a hash range of keys, ``sub`` and ``bit``: the key's place in the range's bitmaps.

    Equal keys get one place. The number of ranges follows the number of keys, so the window of a range is bounded. A
    range that overflows (never seen: its size is Poisson) goes on in bitmaps of its own, ``sub``.
    """
    ranges = n_keys // DICTIONARY_FILL + 1
    within = Window.partitionBy("space", "range").orderBy("key")
    ranked = marks.withColumn("range", F.pmod(F.xxhash64("key"), F.lit(ranges))).withColumn("_rank", F.dense_rank().over(within) - 1)
    return ranked.withColumn("sub", (F.col("_rank") / RANGE).cast("int")).withColumn("bit", (F.col("_rank") % RANGE).cast("int")).drop("_rank")


def pack(bits: np.ndarray) -> bytes:
    """A bitmap of RANGE bits as the smallest of: its positions, its runs, the bits themselves."""
    at = np.flatnonzero(np.unpackbits(bits, bitorder="little")).astype(np.uint16)
    breaks = np.flatnonzero(np.diff(at.astype(np.int32)) != 1)
    if 4 * (len(breaks) + 1) < min(2 * len(at), len(bits)):
        first, last = at[np.concatenate([[0], breaks + 1])], at[np.concatenate([breaks, [len(at) - 1]])]
        return b"r" + np.stack([first, last], axis=1).tobytes()
    return b"a" + at.tobytes() if 2 * len(at) < len(bits) else b"b" + bits.tobytes()


def unpack(packed: bytes) -> np.ndarray:
    """The bits of ``pack``."""
    if packed[:1] == b"b":
        return np.frombuffer(packed, dtype=np.uint8, offset=1)
    at = np.frombuffer(packed, dtype=np.uint16, offset=1)
    out = np.zeros(RANGE, dtype=np.uint8)
    if packed[:1] == b"a":
        out[at] = 1
    else:
        for first, last in at.reshape(-1, 2).astype(int):
            out[first : last + 1] = 1
    return np.packbits(out, bitorder="little")


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        pdf["bits"] = [pack(np.frombuffer(bytes(b), dtype=np.uint8)) for b in pdf["bits"]]
        yield pdf


_SUSPECTS = "space string, range bigint, sub int, period int, bit int"


def _suspects(pdf: pd.DataFrame) -> pd.DataFrame:
    """AND NOT over the periods of one key range: three bitmaps of 4 kB at a time."""
    zero = np.zeros(RANGE // 8, dtype=np.uint8)
    born, dead, out = zero.copy(), zero.copy(), []
    of = {k: {} for k in ("ref", "born", "dead")}
    for period, kind, bits in zip(pdf["period"], pdf["kind"], pdf["bits"]):
        of[kind][period] = bits
    for period in sorted(pdf["period"].unique()):
        if period in of["dead"]:
            dead |= unpack(of["dead"][period])
        if period in of["ref"]:
            left = unpack(of["ref"][period]) & ~(born & ~dead)
            out += [(period, int(bit)) for bit in np.flatnonzero(np.unpackbits(left, bitorder="little"))]
        if period in of["born"]:
            born |= unpack(of["born"][period])
    head = pdf[["space", "range", "sub"]].iloc[0]
    return pd.DataFrame({"space": head["space"], "range": head["range"], "sub": head["sub"], "period": [p for p, _ in out], "bit": [b for _, b in out]}, columns=["space", "range", "sub", "period", "bit"])


def suspects(refs: DataFrame, lives: DataFrame) -> DataFrame:
    """``space, key, period`` of the referenced keys that may lack a live target, from the bitmaps.

    refs: ``space, key, period``; lives: ``space, key, born, dead`` (periods as int, dead nullable).
    """
    mark = lambda d, period, kind: d.select("space", "key", F.col(period).alias("period"), F.lit(kind).alias("kind"))
    # one row per key, period and kind: references of a hot key are combined before they move
    marks = staged(mark(refs, "period", "ref").unionByName(mark(lives, "born", "born")).unionByName(mark(lives.filter(F.col("dead").isNotNull()), "dead", "dead")).distinct())
    n_keys = marks.agg(F.approx_count_distinct(F.xxhash64("space", "key"))).first()[0]
    coded = dictionary(marks, n_keys)
    # the rows of a range are together already, so its bitmaps are made in place
    maps = coded.groupBy("space", "range", "sub", "period", "kind").agg(F.bitmap_construct_agg(F.col("bit").cast("bigint")).alias("bits"))
    found = maps.mapInPandas(_packed, maps.schema).groupBy("space", "range", "sub").applyInPandas(_suspects, _SUSPECTS)
    return coded.filter(F.col("kind") == "ref").join(found, ["space", "range", "sub", "period", "bit"]).select("space", "key", "period")


def _period(ts: Column) -> Column:
    return (F.year(ts) * 12 + F.month(ts) - 1).cast("int")


def _path_key(repo: Column, path: Column) -> Column:
    """Repository and canonical path as one key; no target has the key of a null repository."""
    return F.concat(F.coalesce(F.concat(F.lit("="), repo), F.lit("-")), F.lit("\u0000"), path)


def references(calls: DataFrame, imports: DataFrame, exports: DataFrame) -> DataFrame:
    """All references: ``ref_table, ref_id, repo, space, key, loaded_at``. Null targets are none."""
    of = lambda d, name, ref, space, key: d.select(F.lit(name).alias("ref_table"), F.col(ref).alias("ref_id"), "repo", F.lit(space).alias("space"), key.alias("key"), "loaded_at").filter(F.col("key").isNotNull())
    return (
        of(calls, "calls", "call_id", "symbol", F.col("callee_id").cast("string"))
        .unionByName(of(imports, "imports", "import_id", "path", _path_key(F.col("repo"), canonical_path(F.col("resolved_path")))))
        .unionByName(of(exports, "exports", "export_id", "symbol", F.col("symbol_id").cast("string")))
    )


def targets(symbols: DataFrame, source_files: DataFrame) -> DataFrame:
    """The lives of all targets: ``space, key, loaded_at, deleted_at``, distinct."""
    of = lambda d, space, key: d.select(F.lit(space).alias("space"), key.alias("key"), "loaded_at", "deleted_at")
    files = source_files.filter(F.col("repo").isNotNull())
    every = of(symbols, "symbol", F.col("symbol_id").cast("string")).unionByName(of(files, "path", _path_key(F.col("repo"), canonical_path(F.col("file_path")))))
    return every.filter(F.col("loaded_at").isNotNull() & F.col("key").isNotNull()).distinct()


def orphan_references(calls: DataFrame, imports: DataFrame, exports: DataFrame, symbols: DataFrame, source_files: DataFrame) -> DataFrame:
    """References without a live target when they were loaded: ``ref_table, ref_id, repo, period``.

    A target is live from ``loaded_at`` (inclusive) to ``deleted_at`` (exclusive, null = for ever).
    Symbols are found by id, files by repository and path whatever its spelling. Repeated rows count
    once; a reference or target without ``loaded_at`` is never live, so such a reference is an orphan
    of period null; a path reference of a null repository has no target.
    """
    refs = references(calls, imports, exports).withColumn("period", _period(F.col("loaded_at")))
    dated = refs.filter(F.col("period").isNotNull())
    lives = staged(targets(symbols, source_files))
    periods = lives.select("space", "key", _period(F.col("loaded_at")).alias("born"), _period(F.col("deleted_at")).alias("dead"))
    doubtful = staged(suspects(dated.select("space", "key", "period"), periods))
    open_refs = dated.join(doubtful, ["space", "key", "period"], "left_semi")
    # references of one key are spread over salts, its lives are copied to each
    life = lives.join(doubtful.select("space", "key").distinct(), ["space", "key"], "left_semi")
    life = life.select(F.col("space").alias("l_space"), F.col("key").alias("l_key"), F.col("loaded_at").alias("l_from"), F.col("deleted_at").alias("l_to"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("l_salt"))
    salted = open_refs.withColumn("salt", F.pmod(F.xxhash64("ref_table", "ref_id"), F.lit(SALTS)).cast("int"))
    covered = (F.col("space") == F.col("l_space")) & (F.col("key") == F.col("l_key")) & (F.col("salt") == F.col("l_salt")) & (F.col("loaded_at") >= F.col("l_from")) & (F.col("l_to").isNull() | (F.col("loaded_at") < F.col("l_to")))
    found = salted.join(life, covered, "left_anti").select("ref_table", "ref_id", "repo", "period")
    undated = refs.filter(F.col("period").isNull()).select("ref_table", "ref_id", "repo", "period")
    return found.unionByName(undated).distinct()


def orphan_report(calls: DataFrame, imports: DataFrame, exports: DataFrame, symbols: DataFrame, source_files: DataFrame) -> DataFrame:
    """Per referring table and month: ``ref_table, month, refs, orphans``."""
    orphans = orphan_references(calls, imports, exports, symbols, source_files).groupBy("ref_table", "period").agg(F.count(F.lit(1)).alias("orphans"))
    refs = references(calls, imports, exports).select("ref_table", "ref_id", _period(F.col("loaded_at")).alias("period")).distinct().groupBy("ref_table", "period").agg(F.count(F.lit(1)).alias("refs"))
    o = orphans.withColumnsRenamed({"ref_table": "o_table", "period": "o_period"})
    both = refs.join(o, (refs["ref_table"] == o["o_table"]) & refs["period"].eqNullSafe(o["o_period"]), "left")
    month = F.concat_ws("-", F.format_string("%04d", (F.col("period") / 12).cast("int")), F.format_string("%02d", F.col("period") % 12 + 1))
    return both.select("ref_table", F.when(F.col("period").isNotNull(), month).alias("month"), "refs", F.coalesce("orphans", F.lit(0)).cast("bigint").alias("orphans"))
