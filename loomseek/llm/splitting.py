"""Problem 5: splitting oversized items at natural boundaries.

Method: byte ranges with halos. A worker sees one range of an item and a halo on both sides, finds the boundaries in it, and
cuts. Cutting restarts at the first line start of every cell of GRID limits, a point that the range before finds too, in its halo.
Cells are fixed by the limit, so the pieces do not depend on the size of the ranges. The counts of lines and pieces of the ranges are
stitched by a prefix sum, which turns positions in a range into lines of the item and numbers of its pieces.

``split_files`` splits files of any size: ranges are read by offset wherever a worker is free, once to count and once to cut, only
counts are shuffled, and no worker holds a whole file. ``split_chunks`` splits texts of a table: their ranges are cut from the row
where it is scanned and come to the worker one after the other, which sums as they come; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomseek.session import staged

#: Limits of one cell.
GRID = 64
#: Bytes of one range, rounded up to whole cells; a Python batch holds as many ranges as Arrow's batch has rows.
RANGE_BYTES = 1 << 18
#: Ranges of one block of the prefix sum.
BLOCK = 4096


def _char_start(b: bytes, at: int) -> int:
    """The last character start at or before ``at``."""
    while 0 < at < len(b) and b[at] & 0xC0 == 0x80:
        at -= 1
    return at


def _sync(b: bytes, at: int, limit: int, at_end: bool) -> int:
    """The first line start at or after ``at``, within ``limit`` bytes; else the character start at ``at``."""
    if at == 0 or b[at - 1 : at] == b"\n":
        return at
    nl = b.find(b"\n", at, at + limit)
    if nl >= 0:
        return nl + 1
    if at_end and len(b) - at <= limit:
        return len(b)
    return _char_start(b, at)


def _cut(b: bytes, start: int, stop: int, limit: int) -> int:
    """Where the piece that begins at ``start`` ends: at most ``limit`` bytes on, at the best boundary.

    After a blank line in the second half of the room, after a line, after a statement (``;``, ``}``),
    after white space, else between characters. What goes into less than two pieces is shared about evenly, so that no small
    rest remains.
    """
    rest = stop - start
    if rest <= limit:
        return stop
    room = limit if rest > limit + limit // 2 else min(limit, rest // 2 + limit // 8)
    far, half = start + room, start + room // 2
    for mark in (b"\n\n", b"\n\r\n"):
        at = b.rfind(mark, half, far)
        if at >= 0:
            return at + len(mark)
    at = b.rfind(b"\n", start, far)
    if at >= 0:
        return at + 1
    at = max(b.rfind(b";", half, far), b.rfind(b"}", half, far))
    if at < 0:
        at = max(b.rfind(b" ", half, far), b.rfind(b"\t", half, far))
    if at >= 0:
        return at + 1
    cut = _char_start(b, far)
    return cut if cut > start else far


def _overlap(b: bytes, start: int, cut: int, stop: int, limit: int, lines: int) -> int:
    """Where the next piece begins: up to ``lines`` whole lines before ``cut``, as far as they fit.

    They fit if the next line goes into the piece beside them, and if the piece begins after the last one.
    """
    if lines <= 0 or b[cut - 1 : cut] != b"\n":
        return cut
    nl = b.find(b"\n", cut, stop)
    new = (nl + 1 if nl >= 0 else stop) - cut
    begin = cut
    for _ in range(lines):
        prev = b.rfind(b"\n", 0, begin - 1) + 1
        if prev <= start or cut - prev + new > limit:
            break
        begin = prev
    return begin


def pieces_of_cell(b: bytes, low: int, high: int, limit: int, lines: int, at_end: bool) -> list[tuple[int, int]]:
    """Pieces ``(start, end)`` of the share of the cell ``low..high`` inside the bytes ``b`` (a range and its halos)."""
    share = _sync(b, low, limit, at_end)
    stop = len(b) if at_end and high >= len(b) else _sync(b, high, limit, at_end)
    out, new = [], share
    start = _overlap(b, 0, share, stop, limit, lines) if share > 0 else share
    while new < stop:
        cut = _cut(b, start, stop, limit)
        if cut <= new:  # the overlap left no room
            start = new
            cut = _cut(b, start, stop, limit)
        out.append((start, cut))
        new, start = cut, _overlap(b, start, cut, stop, limit, lines)
    return out


def pieces_of_range(b: bytes, begin: int, halo_begin: int, range_bytes: int, n_bytes: int, limit: int, lines: int) -> tuple[int, list[tuple[int, int, int, int]]]:
    """Line ends in the range, and its pieces: offsets in the item, and lines of their first and last bytes from the range's first."""
    low, high = begin - halo_begin, min(begin + range_bytes, n_bytes) - halo_begin
    at_end = halo_begin + len(b) >= n_bytes
    cell = GRID * limit
    newlines = np.flatnonzero(np.frombuffer(b, dtype=np.uint8) == 10)
    before = int(np.searchsorted(newlines, low))
    out = []
    for c in range(low, high, cell):
        for s, e in pieces_of_cell(b, c, min(c + cell, high), limit, lines, at_end):
            first, last = np.searchsorted(newlines, (s, e - 1))
            out.append((halo_begin + s, halo_begin + e, int(first) - before, int(last) - before))
    return int(np.searchsorted(newlines, high)) - before, out


_RANGE = "range_no bigint, range_bytes bigint, begin bigint, halo_begin bigint, halo_end bigint, n_bytes bigint, max_bytes bigint, overlap_lines bigint"
_PIECES = "piece bigint, offset bigint, end_offset bigint, line bigint, end_line bigint, piece_text string"


def _rows_of(r, b: bytes, key: tuple, lines_before: int, pieces_before: int, with_text: bool) -> tuple[int, list[tuple]]:
    newlines, got = pieces_of_range(b, r.begin, r.halo_begin, r.range_bytes, r.n_bytes, r.max_bytes, r.overlap_lines)
    text = lambda s, e: b[s - r.halo_begin : e - r.halo_begin].decode("utf-8", "replace") if with_text else None
    return newlines, [(*key, pieces_before + n, s, e, lines_before + first, lines_before + last, text(s, e)) for n, (s, e, first, last) in enumerate(got)]


_PIECE_NAMES = ["piece", "offset", "end_offset", "line", "end_line", "piece_text"]


def _in_order(batches: Iterator[pd.DataFrame], keys: list[str], with_text: bool) -> Iterator[pd.DataFrame]:
    """Ranges of an item come one after the other: the sums run along."""
    lines = pieces = 0
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            if r.range_no == 0:
                lines = pieces = 0
            newlines, got = _rows_of(r, bytes(r.bytes), tuple(getattr(r, k) for k in keys), lines, pieces, with_text)
            rows += got
            lines, pieces = lines + newlines, pieces + len(got)
        yield pd.DataFrame(rows, columns=[*keys, *_PIECE_NAMES])


def _read(path: str, begin: int, end: int) -> bytes:
    """Bytes of a file by offset, wherever it lies."""
    if path.startswith("file:") or "://" not in path:
        from urllib.parse import unquote, urlparse

        with open(unquote(urlparse(path).path) if path.startswith("file:") else path, "rb") as f:
            f.seek(begin)
            return f.read(end - begin)
    from pyarrow.fs import FileSystem

    fs, inner = FileSystem.from_uri(path)
    with fs.open_input_file(inner) as f:
        return f.read_at(end - begin, begin)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            newlines, got = pieces_of_range(_read(r.path, r.halo_begin, r.halo_end), r.begin, r.halo_begin, r.range_bytes, r.n_bytes, r.max_bytes, r.overlap_lines)
            rows.append((r.path, r.range_no, newlines, len(got)))
        yield pd.DataFrame(rows, columns=["path", "range_no", "newlines", "pieces"])


def _cut_files(batches: Iterator[pd.DataFrame], with_text: bool) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            _, got = _rows_of(r, _read(r.path, r.halo_begin, r.halo_end), (r.path,), r.lines_before, r.pieces_before, with_text)
            yield pd.DataFrame(got, columns=["path", *_PIECE_NAMES])


def oversized(items: DataFrame, limits: DataFrame, text: str = "text", kind: str = "kind") -> DataFrame:
    """Rows whose text has more UTF-8 bytes than the limit of their kind, with ``n_bytes, max_bytes, overlap_lines``."""
    items = items.drop("n_bytes", "max_bytes", "overlap_lines", "limit_kind")
    lim = limits.groupBy(F.col("kind").alias("limit_kind")).agg(F.min("max_bytes").alias("max_bytes"), F.min("overlap_lines").alias("overlap_lines")).filter(F.col("max_bytes") > 0)
    rows = items.withColumn("n_bytes", F.octet_length(text).cast("bigint"))
    return rows.join(lim, rows[kind] == lim["limit_kind"]).drop("limit_kind").filter(F.col("n_bytes") > F.col("max_bytes"))


def ranges(items: DataFrame, keys: list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The byte ranges of items with ``n_bytes, max_bytes, overlap_lines``, with halos of ``max_bytes`` behind and twice that ahead."""
    cell = F.col("max_bytes").cast("bigint") * GRID
    rows = items.withColumn("range_bytes", (F.ceil(F.lit(range_bytes) / cell) * cell).cast("bigint"))
    rows = rows.withColumn("range_no", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n_bytes") - 1) / F.col("range_bytes")))))
    begin = F.col("range_no") * F.col("range_bytes")
    rows = rows.withColumn("begin", begin).withColumn("halo_begin", F.greatest(F.lit(0).cast("bigint"), begin - F.col("max_bytes")))
    rows = rows.withColumn("halo_end", F.least(F.col("n_bytes"), begin + F.col("range_bytes") + 2 * F.col("max_bytes")))
    return rows.withColumns({c: F.col(c).cast("bigint") for c in ("n_bytes", "max_bytes", "overlap_lines")})


_RANGE_NAMES = [c.split()[0] for c in _RANGE.split(", ")]


def split_files(files: DataFrame, max_bytes: int, overlap_lines: int = 0, range_bytes: int = RANGE_BYTES, with_text: bool = True) -> DataFrame:
    """``path, piece, offset, end_offset, line, end_line, piece_text`` of the files ``path, length`` (of ``list_files``).

    A file within ``max_bytes`` is one piece, an empty one none. Lines and pieces count from 0. All workers must be able to open the paths.
    """
    if max_bytes < 8:
        raise ValueError("max_bytes must have room for a character and its halo")
    items = files.filter(F.col("path").isNotNull() & (F.col("length") > 0)).groupBy("path").agg(F.max("length").alias("n_bytes"))
    items = items.withColumns({"max_bytes": F.lit(max_bytes), "overlap_lines": F.lit(overlap_lines)})
    parts = ranges(items, ["path"], range_bytes).select("path", *_RANGE_NAMES).repartition("path", "range_no")
    counts = parts.mapInPandas(_count, "path string, range_no bigint, newlines bigint, pieces bigint").withColumn("block", F.floor(F.col("range_no") / BLOCK))
    # a prefix sum in two levels: no task holds the counts of a whole file
    counts = staged(counts)
    of_block = counts.groupBy("path", "block").agg(F.sum("newlines").alias("newlines"), F.sum("pieces").alias("pieces"))
    up_to = lambda w: {f"{c}_so_far": F.sum(c).over(w) - F.col(c) for c in ("newlines", "pieces")}
    blocks = of_block.withColumns(up_to(Window.partitionBy("path").orderBy("block"))).select("path", "block", F.col("newlines_so_far").alias("lines0"), F.col("pieces_so_far").alias("pieces0"))
    inside = counts.withColumns(up_to(Window.partitionBy("path", "block").orderBy("range_no")))
    starts = inside.join(blocks, ["path", "block"]).select("path", "range_no", (F.col("lines0") + F.col("newlines_so_far")).alias("lines_before"), (F.col("pieces0") + F.col("pieces_so_far")).alias("pieces_before"))
    return parts.join(starts, ["path", "range_no"]).mapInPandas(partial(_cut_files, with_text=with_text), "path string, " + _PIECES)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, length`` of the files at a path or pattern; their content is not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")


def split_chunks(chunks: DataFrame, limits: DataFrame, range_bytes: int = RANGE_BYTES, with_text: bool = True) -> DataFrame:
    """The pieces of oversized chunks: ``chunk_id, start_line, piece, end_line, start_byte, end_byte, text``.

    Pieces have at most the ``max_bytes`` of their kind, cover the chunk and share ``overlap_lines`` lines where
    those fit. Lines and bytes are those of the file, from the chunk's start (its ``end_byte`` is not used). A null
    text or kind, or a kind without limit, is never oversized; a repeated row has its pieces again; a null start counts as
    line 1 and byte 0.
    """
    big = oversized(chunks, limits).withColumn("line0", F.coalesce("start_line", F.lit(1))).withColumn("byte0", F.coalesce("start_byte", F.lit(0)))
    keys = ["repo", "version_id", "file_path", "chunk_id", "line0", "byte0"]
    parts = ranges(big.withColumn("item_text", F.col("text")), keys, range_bytes)
    sliced = F.substring(F.col("item_text").cast("binary"), (F.col("halo_begin") + 1).cast("int"), (F.col("halo_end") - F.col("halo_begin")).cast("int"))
    types = dict(parts.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", " + _PIECES
    pieces = parts.select(*keys, *_RANGE_NAMES, sliced.alias("bytes")).mapInPandas(partial(_in_order, keys=keys, with_text=with_text), schema)
    return pieces.select(
        "repo",
        "version_id",
        "file_path",
        "chunk_id",
        F.col("piece").cast("int").alias("piece"),
        (F.col("line0") + F.col("line")).cast("int").alias("start_line"),
        (F.col("line0") + F.col("end_line")).cast("int").alias("end_line"),
        (F.col("byte0") + F.col("offset")).alias("start_byte"),
        (F.col("byte0") + F.col("end_offset")).alias("end_byte"),
        F.col("piece_text").alias("text"),
    )
