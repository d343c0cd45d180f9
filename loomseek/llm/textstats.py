"""Problem 10: per-document text quality statistics and text types.

Method: thresholds on statistics are noisy labelling functions; expectation-maximization on their
agreements learns how often each fires for each text type (Dawid and Skene's model), and the
posterior over the types is the result. Statistics are computed over Arrow batches with
vectorised byte operations; the model sees only the counts of distinct vote patterns.

No word list of any language is used. Common words are the head of the corpus' own distribution, one head
per script; all other statistics are of form: lengths of words and lines, marks, digits, columns, stamps.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A common word has at most this many characters and stands in at least this share of its script's documents.
COMMON_CHARS = 4
COMMON_SHARE = 0.01

_MIX, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Masks of the first bytes of a little-endian word.
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype="<u8")
#: Bytes of text that one vectorised step handles.
STEP_BYTES = 4 << 20


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS = {name: np.zeros(256, dtype=bool) for name in ("space", "digit", "letter", "symbol", "end", "high", "bullet")}
_IS["space"][[9, 10, 11, 12, 13, 32]] = True
_IS["digit"][48:58] = True
_IS["letter"][[*range(65, 91), *range(97, 123)]] = True
_IS["letter"][128:] = True
_IS["high"][128:] = True
_IS["end"][[ord(c) for c in '.!?:;"\')…'.encode("latin-1", "ignore").decode("latin-1")]] = True
_IS["symbol"][[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,!?;:'\"()-"]] = True
_IS["bullet"][[ord(c) for c in "-*+|#=~_<>{}[]$@%&/\\^`"]] = True


# script of a word by the lead byte of its first letter: Latin, Greek, Cyrillic, Armenian and Hebrew, Arabic and Syriac, Indic and
# Thai, other scripts of three bytes, Hangul, others
_SCRIPT = np.zeros(256, dtype=np.int64)
for _n, (_low, _high) in enumerate([(0xCD, 0xCF), (0xD0, 0xD3), (0xD4, 0xD7), (0xD8, 0xDF), (0xE0, 0xE0), (0xE1, 0xE2), (0xEA, 0xEF), (0xF0, 0xFF)], 1):
    _SCRIPT[_low : _high + 1] = _n
#: Characters of scripts without spaces are words of their own, of this script.
WIDE = 9


def _wide_characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of characters of the scripts without spaces (Kana, Han, Thai, Lao, Khmer, Burmese), and their code bytes."""
    cut = max(len(data) - 2, 0)
    lead, second = data[:cut], data[1 : cut + 1]
    kana_han = ((lead >= 0xE3) & (lead <= 0xE9)) & ~((lead == 0xE3) & (second == 0x80))
    wide = kana_han | ((lead == 0xE0) & (second >= 0xB8) & (second <= 0xBB)) | ((lead == 0xE1) & (((second >= 0x80) & (second <= 0x81)) | (second == 0x9E)))
    at = np.flatnonzero(wide)
    return at, (data[at].astype(np.int64) << 16) | (data[at + 1].astype(np.int64) << 8) | data[at + 2]


def _high_marks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of punctuation beyond ASCII, starts of such ends of sentences, and of such separators of items."""
    n = len(data)
    marks, ends, splits = (np.zeros(n, dtype=bool) for _ in range(3))
    at = np.flatnonzero(data >= 0xC2)
    at = at[at < n - 1]
    lead, second = data[at], data[at + 1]
    third = data[np.minimum(at + 2, n - 1)]
    two = at[(lead == 0xC2) & (second >= 0xA0)]
    east = (lead == 0xEF) & ((second == 0xBC) | (second == 0xBD))
    is_mark = ((lead == 0xE2) & (second >= 0x80) & (second <= 0xAF)) | ((lead == 0xE3) & (second == 0x80)) | east
    three = at[is_mark & (at < n - 2)]
    for where, width in ((two, 2), (three, 3)):
        for k in range(width):
            marks[where + k] = True
    # ideographic and full-width stops, danda, Arabic question mark and full stop
    stop = ((lead == 0xE3) & (second == 0x80) & (third == 0x82)) | ((lead == 0xEF) & (second == 0xBC) & ((third == 0x81) | (third == 0x9F)))
    stop |= ((lead == 0xE0) & (second == 0xA5) & ((third == 0xA4) | (third == 0xA5))) | ((lead == 0xD8) & (second == 0x9F)) | ((lead == 0xDB) & (second == 0x94))
    ends[at[stop]] = True
    # ideographic and full-width commas, semicolons and bars
    comma = ((lead == 0xE3) & (second == 0x80) & (third == 0x81)) | ((lead == 0xEF) & (second == 0xBC) & ((third == 0x8C) | (third == 0x9B))) | ((lead == 0xEF) & (second == 0xBD) & (third == 0x9C))
    splits[at[comma]] = True
    return marks, ends, splits


class _Words:
    """The words of documents: runs without white space, and their cores without marks at the ends."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        low = _LOWER[data]
        self.space = _IS["space"][data]
        solid = ~self.space
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        # a document starts a new word
        inner = offsets[1:-1]
        inner = inner[inner < n]
        first[inner] = solid[inner]
        inner = inner[inner > 0]
        last[inner - 1] = solid[inner - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.marks, self.stops, self.splits = _high_marks(data)
        self.letter = _IS["letter"][data] & ~self.marks
        self.core = self.letter | _IS["digit"][data]
        s, e = self.start.copy(), self.end.copy()
        for _ in range(4):
            s += (s < e) & ~self.core[np.minimum(s, max(n - 1, 0))] if n else False
            e -= (e > s) & ~self.core[np.maximum(e - 1, 0)] if n else False
        self.s, self.e = s, e
        count = lambda mask: np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        self.letters_before, self.chars_before = count(self.letter), count((data & 0xC0) != 0x80)
        self.chars = self.chars_before[e] - self.chars_before[s]
        # nearly all bytes of the core are letters
        self.alpha = (self.letters_before[e] - self.letters_before[s] >= np.maximum(1, (e - s) - 1)) & (e > s)
        self.wide_at, self.wide_code = _wide_characters(data)
        wide_before = np.zeros(n + 1, dtype=np.int64)
        wide_before[self.wide_at + 1] = 1
        self.wide_before = np.cumsum(wide_before)
        self.has_wide = self.wide_before[e] > self.wide_before[s]
        self.short = np.flatnonzero(self.alpha & (self.chars <= COMMON_CHARS) & ~self.has_wide)
        # the first and the last eight bytes of a core, packed: exact for words of up to sixteen bytes
        padded = np.concatenate([np.zeros(8, np.uint8), low, np.zeros(8, np.uint8)])
        eight = np.lib.stride_tricks.as_strided(padded, shape=(n + 9, 8), strides=(1, 1))
        length = np.minimum(e - s, 8)
        first = eight[s + 8].view(np.uint64)[:, 0] & _MASKS[length]
        last = eight[e].view(np.uint64)[:, 0] & ~_MASKS[8 - length]
        whole = first * _MIX ^ (last * _MIX2 + (e - s).astype(np.uint64))
        whole ^= whole >> np.uint64(29)
        whole *= _MIX
        # a word that says the one before it again
        self.echo = np.zeros(len(s), dtype=bool)
        self.echo[1:] = self.alpha[1:] & (whole[1:] == whole[:-1])
        if len(s):
            heads = np.searchsorted(self.start, offsets[:-1])
            self.echo[heads[heads < len(s)]] = False
        self.script = _SCRIPT[data[s[self.short]]]
        self.hashes = ((whole[self.short] >> np.uint64(2)).view(np.int64) & ~np.int64(15)) | self.script


def _common_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``word, n``: in how many documents each short word stands; word ``-1 - script`` counts the script's documents."""
    for batch in batches:
        for _, data, offsets in _steps(batch):
            w = _Words(data, offsets)
            doc = np.concatenate([np.searchsorted(offsets, w.s[w.short], side="right") - 1, np.searchsorted(offsets, w.wide_at, side="right") - 1])
            word = np.concatenate([w.hashes, (w.wide_code << 4) | WIDE])
            script = word & 15
            doc, word = np.concatenate([doc, doc]), np.concatenate([word, -1 - script])
            # each word once a document
            _, at = np.unique(word.view(np.uint64) * _MIX2 + doc.astype(np.uint64) * _MIX, return_index=True)
            words, n = np.unique(word[at], return_counts=True)
            yield pa.record_batch([pa.array(words), pa.array(n.astype(np.int64))], names=["word", "n"])


def common_words(documents: DataFrame, text: str = "text", share: float = COMMON_SHARE) -> np.ndarray:
    """The head of the corpus' word distribution: sorted hashes of the words of at most COMMON_CHARS characters that stand
    in at least ``share`` of the documents of their script.

    All documents are counted; their number of such words is bounded by the short words of one document over ``share``.
    """
    counts = documents.select(F.lit(0).alias("id"), F.col(text).alias("text")).mapInArrow(_common_batches, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    script = F.when(F.col("word") < 0, -1 - F.col("word")).otherwise(F.col("word").bitwiseAND(F.lit(15)))
    counts = counts.withColumn("script", script)
    of = counts.filter(F.col("word") < 0).select("script", F.col("n").alias("of"))
    head = counts.filter(F.col("word") >= 0).join(F.broadcast(of), "script").filter(F.col("n") >= F.lit(share) * F.col("of"))
    return np.array(sorted(r["word"] for r in head.select("word").collect()), dtype=np.int64)


def _member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), dtype=bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


STATS = (
    "n_bytes words letters digits symbols spaces high units common short_words long_words echoes lines ended bullet_lines prose_bytes list_bytes "
    "row_bytes code_bytes stamped_bytes sentence_ends short_lines repeats"
).split()


def _sums(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``mask`` between consecutive bounds."""
    low, high = bounds[:-1], bounds[1:]
    if not len(mask) or not len(low):
        return np.zeros(len(low), dtype=np.int64)
    filled = np.flatnonzero(high > low)
    out = np.zeros(len(low), dtype=np.int64)
    out[filled] = np.add.reduceat(mask.view(np.uint8) if mask.dtype == bool else mask, low[filled], dtype=np.int32)
    return out


def _stamps(data: np.ndarray, w: _Words) -> np.ndarray:
    """Words with a time or date: two digits with a colon between, or a number with two dashes, slashes or dots between digits."""
    n = len(data)
    digit = _IS["digit"][data]
    between = np.zeros(n, dtype=bool)
    between[1:-1] = digit[:-2] & digit[2:]
    before = lambda mask: np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    colon, other = before(between & (data == ord(":"))), before(between & ((data == ord("-")) | (data == ord("/")) | (data == ord("."))))
    return (colon[w.e] > colon[w.s]) | (other[w.e] - other[w.s] >= 2)


def byte_statistics(data: np.ndarray, offsets: np.ndarray, common: np.ndarray) -> dict[str, np.ndarray]:
    """The STATS of the documents ``data[offsets[i]:offsets[i+1]]`` (UTF-8 bytes), ``common`` being the hashes of common words."""
    n_docs, n = len(offsets) - 1, len(data)
    w = _Words(data, offsets)
    ws, we = w.start, w.end
    is_ = {k: _IS[k][data] for k in ("digit", "symbol", "high")}
    letter, core, space = w.letter, w.core, w.space
    solid = ~space
    # lines: after each newline and at each document start
    starts = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(data == 10) + 1]))
    starts = starts[starts < n]
    edges = np.append(starts, n)
    doc_of_line = np.searchsorted(offsets, starts, side="right") - 1
    is_common = np.zeros(len(ws), dtype=bool)
    is_common[w.short] = _member(w.hashes, common)
    common_wide = w.wide_at[_member((w.wide_code << 4) | WIDE, common)]
    spelled = w.alpha & ~w.has_wide
    short_word = spelled & (w.chars <= 3)
    long_word = (we - ws > 40) & (w.letters_before[we] - w.letters_before[ws] > 0) & ~is_["high"][ws]
    # per line
    w_line = np.searchsorted(starts, ws, side="right") - 1
    n_lines = len(starts)
    count = lambda sel: np.bincount(w_line[sel], minlength=n_lines)
    l_words, l_short, l_alpha, l_echo = np.bincount(w_line, minlength=n_lines), count(short_word), count(w.alpha), count(w.echo)
    # the marks of tags around words say nothing against the words
    tag = np.zeros(n, dtype=bool)
    tag[:-1] = (data[:-1] == ord("<")) & (letter[1:] | (data[1:] == ord("/")))
    tag[1:] |= (data[1:] == ord(">")) & (letter[:-1] | (data[:-1] == ord('"')) | (data[:-1] == ord("/")))
    tag[1:] |= (data[1:] == ord("/")) & (data[:-1] == ord("<"))
    # nor do the marks of emphasis: a star or underscore between a letter and none, and its double
    star = (data == ord("*")) | (data == ord("_"))
    before, after = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    before[1:], after[:-1] = core[:-1], core[1:]
    mark = star & (before ^ after)
    outer = np.zeros(n, dtype=bool)
    outer[1:] |= mark[:-1]
    outer[:-1] |= mark[1:]
    tag |= mark | (star & outer)
    l_tags = _sums(tag, edges)
    l_digits, l_symbols = _sums(is_["digit"], edges), _sums(is_["symbol"], edges) - l_tags
    l_solid = _sums(solid, edges)
    l_commas = _sums((data == ord(",")) | (data == ord("|")) | (data == 9) | (data == ord(";")) | w.splits, edges)
    # first and last visible byte of the line
    has = l_words > 0
    first_w = np.searchsorted(ws, starts)
    at_most = max(len(ws) - 1, 0)
    word_at = lambda k: np.minimum(first_w + k, at_most)
    fb = np.where(has, data[ws[word_at(0)]] if len(ws) else 0, 0)
    last_w = np.minimum(np.maximum(first_w + l_words - 1, 0), at_most)
    lb = np.where(has, data[we[last_w] - 1] if len(ws) else 0, 0)
    ended = has & (_IS["end"][lb] | (lb >= 128))
    # a quotation mark of mail before the line does not count as its beginning
    quoted = has & (fb == ord(">")) & (l_words > 1)
    fb = np.where(quoted, data[ws[word_at(1)]] if len(ws) else 0, fb)
    fw_len = np.where(has, (we - ws)[word_at(0)] if len(ws) else 0, 0)
    numbered = has & _IS["digit"][fb]
    tagged = has & (fb == ord("<")) & (l_tags >= 2)
    tagged |= has & ((fb == ord("*")) | (fb == ord("_"))) & (fw_len > 1)
    bullet = has & ~tagged & (_IS["bullet"][fb] | (numbered & (fw_len <= 5)))
    # a stamp among the first four words of the line
    stamp = _stamps(data, w)
    stamped = np.zeros(n_lines, dtype=bool)
    for k in range(4):
        stamped |= (l_words > k) & (stamp[word_at(k)] if len(ws) else False)
    visible = np.maximum(l_solid, 1)
    wide = np.zeros(n, dtype=bool)
    wide[w.wide_at] = True
    l_wide, stops = _sums(wide, edges), _sums(w.stops, edges) > 0
    no_spaces = 3 * l_wide > 0.5 * visible
    dots = np.zeros(n, dtype=bool)
    dots[1:] = (data[1:] == ord(".")) & (data[:-1] == ord("."))
    dots[starts] = False
    leader = _sums(dots, edges) >= 3
    separated = (l_commas >= 3) & (l_commas > 0.3 * l_words)
    listed = bullet & (l_words <= 12) & ~ended
    alpha_share, short_share = l_alpha / np.maximum(l_words, 1), l_short / np.maximum(l_words, 1)
    # a line of prose: words, short ones among them, that fill the line or end with a mark
    words_flow = (l_words >= 4) & (ended | (l_words >= 8)) & (alpha_share >= 0.6) & (short_share >= 0.08) & (5 * l_echo < l_words) & (l_symbols < 0.06 * visible)
    prose = has & ~stamped & ((~no_spaces & words_flow & ~leader & ~separated & ~listed) | (no_spaces & (l_wide >= 6) & (5 * l_commas < l_wide) & (stops | (l_wide >= 12))))
    rows = has & ~prose & ((l_commas >= 2) | (l_digits > 0.25 * visible))
    code = has & ~prose & (l_symbols + _sums((data == ord("(")) | (data == ord(")")) | (data == ord(";")), edges) > 0.08 * visible)
    lists = has & ~prose & (bullet | (l_words <= 8))
    by_doc = lambda v: np.bincount(doc_of_line, weights=v, minlength=n_docs).astype(np.int64)
    w_doc = np.searchsorted(offsets, ws, side="right") - 1
    per_word = lambda sel: np.bincount(w_doc[sel], minlength=n_docs)
    per_wide = lambda at: np.bincount(np.searchsorted(offsets, at, side="right") - 1, minlength=n_docs)
    ends = space.copy()
    ends[1:] &= (data[:-1] == ord(".")) | (data[:-1] == ord("?")) | (data[:-1] == ord("!"))
    same = np.zeros(n, dtype=bool)
    same[1:] = (data[1:] == data[:-1]) & solid[1:] & ~letter[1:]
    # nothing comes before the first byte of a document
    heads = offsets[:-1][offsets[:-1] < n]
    ends[heads] = same[heads] = False
    return {
        "n_bytes": np.diff(offsets),
        "words": np.bincount(w_doc, minlength=n_docs),
        "letters": _sums(letter, offsets),
        "digits": _sums(is_["digit"], offsets),
        "symbols": _sums(is_["symbol"], offsets),
        "spaces": _sums(space, offsets),
        "high": _sums(is_["high"], offsets),
        "units": per_word(spelled) + per_wide(w.wide_at),
        "common": per_word(is_common) + per_wide(common_wide),
        "short_words": per_word(short_word),
        "long_words": per_word(long_word),
        "echoes": per_word(w.echo),
        "lines": by_doc(has),
        "ended": by_doc(ended),
        "bullet_lines": by_doc(bullet),
        "prose_bytes": by_doc(l_solid * prose),
        "list_bytes": by_doc(l_solid * lists),
        "row_bytes": by_doc(l_solid * rows),
        "code_bytes": by_doc(l_solid * code),
        "stamped_bytes": by_doc(l_solid * stamped),
        "sentence_ends": _sums(ends | w.stops, offsets),
        "short_lines": by_doc(has & (l_words <= 3) & (l_wide < 6)),
        "repeats": _sums(same, offsets),
    }


def _steps(batch: pa.RecordBatch) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Documents of column 1 in steps of about STEP_BYTES: rows, bytes, offsets. A longer document comes alone, in
    parts that end with a line, else with a word; only its last part has ``rows.step`` unset."""
    texts = batch.column(1).cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    at, buf = 0, texts.buffers()[2]
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + STEP_BYTES, side="right")) - 1)
        data = np.frombuffer(buf, dtype=np.uint8)[ends[at] : ends[to]] if buf is not None else np.zeros(0, np.uint8)
        if len(data) <= 2 * STEP_BYTES:
            yield slice(at, to), data, ends[at : to + 1] - ends[at]
        else:
            begin = 0
            while begin < len(data):
                end = min(len(data), begin + STEP_BYTES)
                if end < len(data):
                    for mark in (10, 32):
                        hit = np.flatnonzero(data[begin:end] == mark)
                        if len(hit):
                            end = begin + int(hit[-1]) + 1
                            break
                    else:
                        while end > begin + 1 and data[end] & 0xC0 == 0x80:
                            end -= 1
                yield slice(at, to, None if end == len(data) else 1), data[begin:end], np.array([0, end - begin])
                begin = end
        at = to


def _stat_batches(batches: Iterator[pa.RecordBatch], id_type: pa.DataType, shared) -> Iterator[pa.RecordBatch]:
    common = shared.value
    for batch in batches:
        part = None
        for rows, data, offsets in _steps(batch):
            stats = byte_statistics(data, offsets, common)
            if part is not None:
                stats = {k: stats[k] + part[k] for k in STATS}
            part = stats if rows.step else None
            if part is None:
                ids = batch.column(0).slice(rows.start, rows.stop - rows.start)
                yield pa.record_batch([ids.cast(id_type), *[pa.array(stats[k].astype(np.int64)) for k in STATS]], names=["id", *STATS])


def text_statistics(documents: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``id`` and the STATS, as counts, of every row with a text that is not blank.

    Null, empty and blank texts have no statistics and get no row. Rows are not de-duplicated: a repeated
    row has its statistics again. The common words are those of these documents.
    """
    rows = documents.filter(F.col(id_column).isNotNull() & F.col(text).rlike(r"[^\s\p{Z}]")).select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["id"]
    id_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    shared = rows.sparkSession.sparkContext.broadcast(common_words(rows))
    return rows.mapInArrow(partial(_stat_batches, id_type=id_type, shared=shared), f"id {kind}, " + ", ".join(f"{k} bigint" for k in STATS))


TYPES = ["prose", "list", "table", "log", "code", "junk"]


def _share(a: str, b: str, over: float):
    return F.col(a) > over * F.col(b)


def labelling_functions() -> dict:
    """Name -> (fires, first guess of how often it fires for each of TYPES). Each has a statistic of its own; none implies another."""
    solid = F.col("n_bytes") - F.col("spaces")
    of = lambda c, over: F.col(c) > over * solid
    return {
        "prose_lines": (of("prose_bytes", 0.42), [0.96, 0.06, 0.05, 0.1, 0.07, 0.05]),
        "common_words": (_share("common", "units", 0.2), [0.9, 0.3, 0.2, 0.4, 0.2, 0.2]),
        "word_mix": (_share("short_words", "units", 0.12) | (F.col("high") * 2 > solid), [0.93, 0.3, 0.3, 0.4, 0.4, 0.2]),
        "lines_ended": (_share("ended", "lines", 0.4), [0.7, 0.1, 0.2, 0.4, 0.4, 0.2]),
        "sentences": (F.col("sentence_ends") * 40 > F.col("units"), [0.85, 0.05, 0.05, 0.3, 0.05, 0.05]),
        "symbols": (of("symbols", 0.06), [0.05, 0.2, 0.5, 0.5, 0.9, 0.5]),
        "digits": (of("digits", 0.12), [0.05, 0.1, 0.6, 0.9, 0.1, 0.3]),
        "bullets": (_share("bullet_lines", "lines", 0.5), [0.05, 0.8, 0.5, 0.3, 0.2, 0.2]),
        "short_items": (of("list_bytes", 0.5), [0.03, 0.9, 0.4, 0.2, 0.3, 0.5]),
        "rows": (of("row_bytes", 0.5), [0.03, 0.1, 0.9, 0.5, 0.3, 0.2]),
        "code_lines": (of("code_bytes", 0.5), [0.03, 0.1, 0.3, 0.3, 0.9, 0.3]),
        "stamps": (of("stamped_bytes", 0.5), [0.02, 0.02, 0.1, 0.95, 0.02, 0.02]),
        "short_lines": (_share("short_lines", "lines", 0.5), [0.1, 0.7, 0.4, 0.1, 0.3, 0.5]),
        "long_words": (F.col("long_words") > 0, [0.03, 0.05, 0.2, 0.2, 0.2, 0.6]),
        "echoes": (F.col("echoes") * 6 > F.col("units"), [0.01, 0.03, 0.03, 0.01, 0.02, 0.5]),
        "repeats": (of("repeats", 0.1), [0.02, 0.1, 0.1, 0.05, 0.1, 0.4]),
    }


def fit_types(patterns: np.ndarray, counts: np.ndarray, guess: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Posterior over TYPES of each vote pattern, by expectation-maximization.

    ``patterns`` is patterns x functions of 0/1, ``guess`` functions x types. The guess counts as
    a prior of one percent of the rows, so a type without rows keeps its meaning.
    """
    v, c = patterns.astype(float), counts.astype(float)
    rate, weight = guess.copy(), np.full(guess.shape[1], 1 / guess.shape[1])
    prior = max(1.0, 0.01 * c.sum())
    post = np.zeros((len(v), guess.shape[1]))
    for _ in range(rounds):
        log = v @ np.log(rate) + (1 - v) @ np.log(1 - rate) + np.log(weight)
        post = np.exp(log - log.max(axis=1, keepdims=True))
        post /= post.sum(axis=1, keepdims=True)
        mass = post * c[:, None]
        total = mass.sum(axis=0)
        rate = np.clip((v.T @ mass + prior * guess) / (total + prior), 1e-4, 1 - 1e-4)
        weight = (total + prior) / (total + prior).sum()
    return post


def text_types(stats: DataFrame) -> DataFrame:
    """``stats`` with ``votes`` (bits of the labelling functions), ``text_type`` and ``p_prose``.

    The model is fitted on the counts of all vote patterns: at most two to the number of
    functions, whatever the number of documents.
    """
    lfs = labelling_functions()
    votes = sum((F.when(fires, F.lit(1 << i)).otherwise(F.lit(0)) for i, (fires, _) in enumerate(lfs.values())), F.lit(0))
    voted = stats.withColumn("votes", votes)
    rows = sorted((r["votes"], r["count"]) for r in voted.groupBy("votes").count().collect())
    bits = np.array([[(p >> i) & 1 for i in range(len(lfs))] for p, _ in rows]).reshape(len(rows), len(lfs))
    post = fit_types(bits, np.array([n for _, n in rows]), np.array([g for _, g in lfs.values()])) if rows else np.zeros((0, len(TYPES)))
    table = [(p, TYPES[int(q.argmax())], float(q[0])) for (p, _), q in zip(rows, post)]
    model = stats.sparkSession.createDataFrame(table, "votes int, text_type string, p_prose double")
    return voted.join(F.broadcast(model), "votes")
