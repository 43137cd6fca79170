"""Quality rules from repeated substrings: suffix arrays over the words of each text.

Texts are handled many at a time: prefix doubling sorts the suffixes of a whole piece, with words of different
texts kept apart, and resolved suffixes leave the sort. The longest common prefix of neighbouring suffixes gives,
for every word, the longest repeat that starts there, i.e. the deepest LCP interval that holds its suffix. Spans
of maximal repeats are united; the share of words they cover and the longest repeat decide.
Memory follows the piece (about 4 bytes per word and doubling), or the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import SPACE, Words, mix, pieces, span_hashes, words_of

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


def suffix_order(hashes: np.ndarray, text: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array over words, and the ranks by prefixes of 1, 2, 4, ... words.

    ``text`` is the text of each word, ``stop`` the index behind that text's last word.
    """
    n = len(hashes)
    keys = mix(hashes + mix(text.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keys, kind="stable")
    new = np.ones(n, bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    starts = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(starts, np.diff(np.append(starts, n))) + 1
    levels, step = [rank.astype(np.int32)], 1
    size = np.repeat(np.diff(np.append(starts, n)), np.diff(np.append(starts, n)))
    open_ = order[size > 1]
    while len(open_):
        beyond = open_ + step
        inside = beyond < stop[open_]
        second = np.where(inside, rank[np.where(inside, beyond, 0)], 0)
        key = rank[open_] * (n + 1) + second
        by = np.argsort(key, kind="stable")
        open_, key = open_[by], key[by]
        old = rank[open_]
        group = np.ones(len(open_), bool)
        group[1:] = old[1:] != old[:-1]
        part = np.ones(len(open_), bool)
        part[1:] = key[1:] != key[:-1]
        at = np.arange(len(open_))
        group_at = np.maximum.accumulate(np.where(group, at, 0))
        part_at = np.maximum.accumulate(np.where(part, at, 0))
        rank[open_] = old + part_at - group_at
        levels.append(rank.astype(np.int32))
        sizes = np.diff(np.append(np.flatnonzero(part), len(open_)))
        open_ = open_[np.repeat(sizes, sizes) > 1]
        step *= 2
    suffixes = np.empty(n, np.int64)
    suffixes[rank - 1] = np.arange(n)
    return suffixes, levels


def neighbour_prefixes(suffixes: np.ndarray, levels: list[np.ndarray], stop: np.ndarray) -> np.ndarray:
    """LCP of each suffix with the next one in order (one fewer than suffixes), by halving steps over the ranks."""
    lcp = np.zeros(max(len(suffixes) - 1, 0), np.int64)
    one = levels[0]
    pair = np.flatnonzero(one[suffixes[:-1]] == one[suffixes[1:]]) if len(lcp) else np.zeros(0, np.int64)
    a, b = suffixes[pair].copy(), suffixes[pair + 1].copy()
    end_a, end_b = stop[a], stop[b]
    length = np.zeros(len(pair), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = (a < end_a) & (b < end_b)
        equal = inside & (levels[k][np.where(inside, a, 0)] == levels[k][np.where(inside, b, 0)])
        length += equal * (1 << k)
        a += equal * (1 << k)
        b += equal * (1 << k)
    lcp[pair] = length
    return lcp


def longest_repeats(words: Words) -> np.ndarray:
    """For each word, how many words the longest repeat has that starts there (0: the word is unique in its text)."""
    n = len(words.start)
    if n < 2:
        return np.zeros(n, np.int64)
    stop = np.repeat(words.first[1:], words.counts)
    suffixes, levels = suffix_order(words.hashes(), words.text, stop)
    lcp = neighbour_prefixes(suffixes, levels, stop)
    repeat = np.zeros(n, np.int64)
    repeat[suffixes[1:]] = lcp
    repeat[suffixes[:-1]] = np.maximum(repeat[suffixes[:-1]], lcp)
    return repeat


def covered(repeat: np.ndarray, least: int) -> np.ndarray:
    """Words inside the union of all repeats of ``least`` words or more."""
    at = np.arange(len(repeat))
    return np.maximum.accumulate(np.where(repeat >= least, at + repeat, 0)) > at if len(at) else np.zeros(0, bool)


def repeated_lines(data: np.ndarray, text_at: np.ndarray) -> np.ndarray:
    """Per text, lines with a word that equal an earlier line."""
    n = len(text_at) - 1
    out = np.zeros(n, np.int64)
    if not len(data):
        return out
    breaks = np.flatnonzero(data == 10)
    start = np.unique(np.concatenate((text_at[:-1], breaks + 1)))
    start = start[start < len(data)]
    end = np.append(start[1:], len(data))
    end = end - (data[end - 1] == 10)  # the newline itself; a text's last line may have none
    solid = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~SPACE[data], out=solid[1:])
    keep = solid[end] > solid[start]
    start, end = start[keep], end[keep]
    text = np.searchsorted(text_at, start, "right") - 1
    key = mix(span_hashes(data, start, end) + mix(text.astype(np.uint64) + np.uint64(1)))
    first = np.unique(key, return_index=True)[1]
    again = np.ones(len(key), bool)
    again[first] = False
    return np.bincount(text[again], minlength=n)


def per_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat")


def _piece_measures(texts: pa.Array, window: int, min_words: int) -> list[np.ndarray]:
    words = words_of(texts)
    data, at = words.data, words.text_at
    repeat = longest_repeats(words)
    longest = np.zeros(len(at) - 1, np.int64)
    full = words.counts > 0
    if full.any():
        longest[full] = np.maximum.reduceat(repeat, words.first[:-1][full])
    return [
        words.counts,
        per_text(~SPACE[data] & ((data & 0xC0) != 0x80), at),
        per_text(SYMBOLS[data], at),
        repeated_lines(data, at),
        per_text(covered(repeat, window), words.first),
        per_text(covered(repeat, min_words), words.first),
        longest,
    ]


def quality(
    docs: DataFrame,
    text: str = "text",
    *,
    window: int = 8,
    min_words: int = 4,
    max_covered: float = 0.4,
    max_repeat: int = 60,
    base_words: int = 20,
    base_percent: int = 30,
    into: str = "_quality",
) -> DataFrame:
    """``docs`` with a struct column ``into`` (replacing one of that name): measures, ``base_failed`` and ``kept``.

    ``n_words``, ``word_chars`` (code points in words), ``n_symbols``, ``n_dup_lines``, ``n_repeat_words`` (words
    in repeats of ``window`` words or more), ``n_covered`` (the same from ``min_words`` on), ``longest_repeat``
    (words). ``base_failed``: fewer than ``base_words`` words, or ``n_repeat_words`` above ``base_percent`` per
    cent. ``kept``: not that, at most the share ``max_covered`` of words covered by repeats, and no repeat
    longer than ``max_repeat`` words.

    A null or empty text has no words and fails the base rule. Repeated rows are judged one by one; an empty
    table gives an empty result; other columns pass through. Texts are judged whole. There is no shuffle.
    """
    measured = T.StructType([T.StructField(m, T.LongType()) for m in MEASURES])
    docs = docs.drop(into)
    schema = T.StructType([*docs.schema.fields, T.StructField(into, measured)])
    kind = pa.struct([(m, pa.int64()) for m in MEASURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text):
                found = [pa.array(m, pa.int64()) for m in _piece_measures(part.column(text), window, min_words)]
                yield part.append_column(into, pa.StructArray.from_arrays(found, fields=list(kind)))

    q = {m: F.col(f"`{into}`.{m}") for m in MEASURES}
    failed = (q["n_words"] < base_words) | (100 * q["n_repeat_words"] > base_percent * q["n_words"])
    good = (q["n_covered"] <= max_covered * q["n_words"]) & (q["longest_repeat"] <= max_repeat)
    verdict = F.struct(*[q[m].alias(m) for m in MEASURES], failed.alias("base_failed"), (~failed & good).alias("kept"))
    return docs.mapInArrow(run, schema).withColumn(into, verdict)
