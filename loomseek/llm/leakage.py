"""Problem 9: evaluation texts leaking into training text.

Method: winnowing. Texts are reduced to lower-case letters and digits; of every window of WINDOW
consecutive hashes of K characters the least is kept, so any shared span of ``K + WINDOW - 1``
characters shares a fingerprint. Fingerprints of corpus and evaluation items are joined, and the
hits are extended to an in-order alignment of words that measures how much of the item a document
holds.

Corpus fingerprints are tested against a Bloom filter of the items' fingerprints before they leave the scan. Its size follows
the number of fingerprints, up to a bound beyond which it lets more through; the join after it is exact. Items too short
for a fingerprint are looked for whole, by the hash of all their letters and digits.
"""

from __future__ import annotations

import bisect
import html
import unicodedata
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomseek.session import staged

K = 16
WINDOW = 8
#: Bits of the filter for each fingerprint, probes of each, and the bound of the whole: 128 MB.
BITS_PER_PRINT = 32
PROBES = 3
MOST_BITS = 1 << 30
RANGE = 32768
STEP_BYTES = 2 << 20
#: Share of an item's fingerprints that a document must hit to be aligned; one hit is enough for items of few.
HIT_SHARE = 0.08
#: Pairs of equal word runs from which on an alignment is computed by rows, in memory of the item's length.
MANY_PAIRS = 500_000
#: Share of an item's words that must align.
HELD = 0.5

_BASE = np.uint64(0x5851F42D4C957F2D)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_WORD = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]|[^\W_]+")


def normalised(texts: pa.Array) -> pa.Array:
    """Lower-case letters and digits only; markup tags and escapes of line ends vanish."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    texts = pc.replace_substring_regex(texts, r"\\[nrt]", "")
    texts = pc.utf8_normalize(pc.replace_substring_regex(texts, r"</?[A-Za-z][A-Za-z0-9]{0,9}>", ""), "NFKC")
    return pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\pL\pN]+", "")


def winnow(data: np.ndarray, offsets: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, position and hash of the fingerprints of ``data[offsets[i]:offsets[i+1]]``.

    The hash of a k-gram comes from prefix sums of ``byte * BASE^position``, and the least of a window by
    doubling: all array operations. A text shorter than a window keeps its least hash.
    """
    n = len(data) - k + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64)
    power = np.full(len(data) + 1, _BASE, dtype=np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    pre = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64)])
    inverse = np.full(n, _INVERSE, dtype=np.uint64)
    inverse[0] = 1
    np.multiply.accumulate(inverse, out=inverse)
    h = (pre[k:] - pre[:-k]) * inverse
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    text = np.searchsorted(offsets, np.arange(n), side="right") - 1
    valid = np.arange(n) + k <= offsets[text + 1]
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    h[~valid] = top
    # least hash of the window that starts at each position; a window ends with its text
    least, width = h.copy(), 1
    while width < window:
        step = min(width, window - width)
        least[:-step] = np.minimum(least[:-step], least[step:])
        width += step
    grams = offsets[1:] - offsets[:-1] - k + 1
    start_of = np.arange(n) - offsets[text]
    is_start = valid & (start_of <= np.maximum(grams[text] - window, 0))
    # keep positions that are the least of some window: the nearest window starts behind them
    keep = np.zeros(n, dtype=bool)
    for back in range(window):
        keep[back:] |= is_start[: n - back] & (least[: n - back] == h[back:])
    keep &= valid
    at = np.flatnonzero(keep)
    return text[at], at - offsets[text[at]], h[at]


def _bytes_of(norm: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    ends = np.frombuffer(norm.buffers()[1], dtype=np.int64)[norm.offset : norm.offset + len(norm) + 1]
    if norm.buffers()[2] is None or ends[-1] == ends[0]:
        return np.zeros(0, np.uint8), np.zeros(len(norm) + 1, np.int64)
    return np.frombuffer(norm.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def _segments(data: np.ndarray, offsets: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``winnow`` of texts of any length: a very long one is taken in segments that overlap by what one window sees."""
    parts, at = [winnow(np.zeros(0, np.uint8), np.zeros(1, np.int64))], 0
    while at < len(data):
        segment = data[at : at + STEP_BYTES + k + window]
        parts.append(winnow(segment, np.clip(offsets - at, 0, len(segment)), k, window))
        at += STEP_BYTES
    return tuple(np.concatenate(c) for c in zip(*parts))


def _fingerprints(texts: pa.Array, short: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, position and hash of the fingerprints; of all runs of the lengths ``short`` too."""
    data, offsets = _bytes_of(normalised(texts))
    parts = [_segments(data, offsets, K, WINDOW)] + [_segments(data, offsets, k, 1) for k in short]
    return tuple(np.concatenate(c) for c in zip(*parts))


def _item_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        data, offsets = _bytes_of(normalised(b.column(1)))
        t, _, h = _segments(data, offsets, K, WINDOW)
        lengths, whole = np.diff(offsets), np.zeros(len(t), np.int64)
        for k in np.unique(lengths[(lengths > 0) & (lengths < K)]):
            st, _, sh = _segments(data, offsets, int(k), 1)
            mine = lengths[st] == k
            t, h, whole = np.concatenate([t, st[mine]]), np.concatenate([h, sh[mine]]), np.concatenate([whole, np.full(int(mine.sum()), k)])
        yield pa.record_batch([b.column(0).take(pa.array(t)), pa.array(h.view(np.int64)), pa.array(whole)], names=["item_id", "h", "whole"])


def item_fingerprints(items: DataFrame) -> DataFrame:
    """``item_id, h, whole`` of the evaluation items, distinct; ``whole`` is the length of an item that is one fingerprint, else 0."""
    rows = items.filter(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(F.col("item_id").cast("bigint").alias("item_id"), "text").distinct()
    return rows.mapInArrow(_item_batches, "item_id bigint, h bigint, whole bigint").distinct()


def _probes(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    for i in range(PROBES):
        x = h * np.uint64(0x9E3779B97F4A7C15 + 2 * i)
        yield ((x >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64)


def _bit_batches(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        h = b.column(0).to_numpy().view(np.uint64)
        yield pa.record_batch([pa.array(np.unique(np.concatenate(list(_probes(h, bits)))))], names=["bit"])


def bloom(hashes: DataFrame, n: int) -> tuple[int, bytes]:
    """The filter's number of bits and the bits, compressed, of ``n`` fingerprints: at most MOST_BITS."""
    import zlib

    bits = min(MOST_BITS, 1 << max(15, (n * BITS_PER_PRINT - 1).bit_length()))
    at = hashes.mapInArrow(partial(_bit_batches, bits=bits), "bit bigint")
    parts = at.groupBy(F.floor(F.col("bit") / RANGE).alias("r")).agg(F.bitmap_construct_agg(F.col("bit") % RANGE).alias("bits"))
    out = bytearray(bits // 8)
    for r in parts.toLocalIterator():
        out[r["r"] * RANGE // 8 : (r["r"] + 1) * RANGE // 8] = r["bits"]
    return bits, zlib.compress(bytes(out), 1)


_FILTERS: dict[bytes, np.ndarray] = {}


def _in_filter(h: np.ndarray, filter_: tuple[int, bytes]) -> np.ndarray:
    import zlib

    bits, packed = filter_
    if packed not in _FILTERS:
        if len(_FILTERS) >= 2:
            _FILTERS.clear()
        _FILTERS[packed] = np.frombuffer(zlib.decompress(packed), dtype=np.uint8)
    table, hit = _FILTERS[packed], np.ones(len(h), dtype=bool)
    for bit in _probes(h, bits):
        hit &= (table[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
    return hit


def _corpus_batches(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    every, single, short = shared.value
    for b in batches:
        ends, at = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False)), 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP_BYTES, side="right")))
            part = b.slice(at, to - at)
            at = to
            t, _, h = _fingerprints(part.column(1), short)
            hit = _in_filter(h, every)
            t, h = t[hit], h[hit]
            order = np.argsort(t, kind="stable")
            t, h = t[order], h[order]
            if not len(t):
                continue
            rows, first, n = np.unique(t, return_index=True, return_counts=True)
            # one hit is enough if it may be that of an item of few fingerprints
            enough = (n >= 2) | (np.add.reduceat(_in_filter(h, single).astype(np.int64), first) > 0)
            lists = [np.unique(h[f : f + c]).view(np.int64) for f, c in zip(first[enough], n[enough])]
            take = pa.array(rows[enough])
            yield pa.record_batch([part.column(0).take(take), part.column(1).take(take).cast(pa.string()), pa.array(lists, type=pa.list_(pa.int64()))], names=["doc_id", "text", "hs"])


def corpus_hits(documents: DataFrame, prints: DataFrame) -> DataFrame:
    """``doc_id, text, hs``: documents with at least two fingerprints in the filter, or one of an item for which one is enough.

    ``prints`` has ``h, whole, needed``.
    """
    n = prints.agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("needed") <= 1).alias("single"), F.collect_set("whole").alias("whole")).first()
    filters = bloom(prints.select("h"), n["all"]), bloom(prints.filter(F.col("needed") <= 1).select("h"), n["single"])
    shared = documents.sparkSession.sparkContext.broadcast((*filters, tuple(sorted(k for k in n["whole"] if k))))
    rows = documents.filter(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(partial(_corpus_batches, shared=shared), "doc_id bigint, text string, hs array<bigint>")


_TAG = regex.compile(r"</?[A-Za-z][A-Za-z0-9]{0,9}>")
_HIDDEN = regex.compile(r"\p{Cf}")


def words(text: str) -> list[str]:
    """Lower-case words without tags, invisible characters (soft hyphens among them) and escapes of line ends."""
    if "\\" in text:
        text = regex.sub(r"\\[nrt]", " ", text)
    if "&" in text:
        text = html.unescape(text)
    return _WORD.findall(_HIDDEN.sub("", unicodedata.normalize("NFKC", _TAG.sub("", text))).lower())


def held_share(item: list[str], doc: list[str], run: int = 3) -> float:
    """The share of the item's characters that the document holds in order.

    Shared runs of ``run`` words (of all words of a shorter item) are chained over the whole document so that both positions rise:
    at each item position the longest chain by distinct item words covered.
    """
    total, run = sum(map(len, item)), min(run, len(item))
    if not total:
        return 0.0
    where: dict[tuple[str, ...], list[int]] = {}
    for i in range(len(item) - run + 1):
        where.setdefault(tuple(item[i : i + run]), []).append(i)
    at = [where.get(tuple(doc[d : d + run]), ()) for d in range(len(doc) - run + 1)]
    n_pairs = sum(map(len, at))
    if not n_pairs:
        return 0.0
    size = [0]
    for w in item:
        size.append(size[-1] + len(w))
    if n_pairs > MANY_PAIRS:
        return _chain_by_rows(at, size, run) / total
    return _chain([(d, i) for d, positions in enumerate(at) for i in positions], size, run) / total


def _chain_by_rows(at: list, size: list[int], run: int) -> int:
    """What ``_chain`` computes, one document position after the other, with arrays over the item's positions."""
    size_ = np.array(size, dtype=np.int64)
    n, none = len(size) - 1, np.int64(-(1 << 40))
    whole, step = size_[run:] - size_[: n - run + 1], size_[run:] - size_[run - 1 : n]
    front = np.zeros(n + 1, dtype=np.int64)  # best gain of chains that end at or before each item position
    before = np.full(n - run + 1, none)
    pending: list[np.ndarray] = []
    best = np.int64(0)
    for positions in at:
        now = np.full(n - run + 1, none)
        if positions:
            p = np.array(positions)
            now[p] = front[p] + whole[p]
            on = p[p > 0]
            now[on] = np.maximum(now[on], before[on - 1] + step[on])
            best = max(best, now.max())
        pending.append(now)
        if len(pending) == run:
            ready = pending.pop(0)
            if ready.max() > 0:
                front[run:] = np.maximum(front[run:], np.maximum.accumulate(ready))
        before = now
    return int(best)


def _chain(pairs: list[tuple[int, int]], size: list[int], run: int) -> int:
    """Most item characters that runs at rising positions in both texts cover.

    ``tail`` holds item positions where chains end and their growing gains: a Pareto front.
    """
    ends: list[int] = []
    gains: list[int] = []

    def put(end: int, gain: int) -> None:
        k = bisect.bisect_right(ends, end)
        if k and gains[k - 1] >= gain:
            return
        while k < len(ends) and gains[k] <= gain:
            del ends[k], gains[k]
        if k and ends[k - 1] == end:
            ends[k - 1], gains[k - 1] = end, gain
        else:
            ends.insert(k, end)
            gains.insert(k, gain)

    along: dict[int, tuple[int, int]] = {}  # diagonal -> (document position, gain) of the run that goes on
    waiting: list[tuple[int, int, int]] = []
    at = 0
    for d, i in pairs:
        while at < len(waiting) and waiting[at][0] <= d:
            put(waiting[at][1], waiting[at][2])
            at += 1
        k = bisect.bisect_right(ends, i)
        gain = (gains[k - 1] if k else 0) + size[i + run] - size[i]
        before = along.get(i - d)
        if before and before[0] == d - 1:
            gain = max(gain, before[1] + size[i + run] - size[i + run - 1])
        along[i - d] = (d, gain)
        waiting.append((d + run, i + run, gain))
    return max(max(w[2] for w in waiting), max(gains, default=0))


def _align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        cache: dict[str, list[str]] = {}
        split = lambda t: cache.setdefault(t, words(t)) if t not in cache else cache[t]
        pdf["held"] = [held_share(split(i), split(d)) for i, d in zip(pdf["item_text"], pdf["text"])]
        yield pdf[["text_key", "item_id", "held"]]


def leaks(documents: DataFrame, items: DataFrame, held: float = HELD) -> DataFrame:
    """``doc_id, item_id, held``: documents that hold at least ``held`` of an item's text in its order.

    Case, punctuation, layout and tags do not count. Equal texts are aligned once. Null texts hold nothing
    and leak nowhere, nor do items without letters or digits; repeated rows count once. An item too short for a fingerprint (below K
    bytes of letters and digits) leaks where it stands as a whole.
    """
    prints = staged(item_fingerprints(items))
    of_item = prints.groupBy("item_id").agg(F.ceil(HIT_SHARE * F.countDistinct("h")).alias("needed"))
    needed = staged(prints.join(of_item, "item_id").groupBy("h").agg(F.max("whole").alias("whole"), F.min("needed").alias("needed")))
    hits = staged(corpus_hits(documents, needed).withColumn("text_key", F.sha2(F.col("text"), 256)))
    texts = hits.groupBy("text_key").agg(F.first("text").alias("text"), F.first("hs").alias("hs"))
    counted = (
        texts.select("text_key", F.explode("hs").alias("h"))
        .join(prints.select("item_id", "h").distinct(), "h")
        .groupBy("text_key", "item_id")
        .agg(F.count(F.lit(1)).alias("n_hits"))
        .join(of_item, "item_id")
        .filter(F.col("n_hits") >= F.col("needed"))
        .select("text_key", "item_id")
    )
    item_text = items.filter(F.col("text").isNotNull()).select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").alias("item_text")).distinct()
    pairs = counted.join(texts.select("text_key", "text"), "text_key").join(item_text, "item_id")
    aligned = pairs.select("text_key", "item_id", "item_text", "text").mapInPandas(_align, "text_key string, item_id bigint, held double")
    best = aligned.filter(F.col("held") >= held).groupBy("text_key", "item_id").agg(F.max("held").alias("held"))
    return hits.select("doc_id", "text_key").distinct().join(best, "text_key").groupBy("doc_id", "item_id").agg(F.max("held").alias("held"))
