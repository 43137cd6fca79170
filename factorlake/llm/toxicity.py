"""Toxicity after noisy-channel deobfuscation.

A character language model (trigrams, counted over all texts) and a channel of typical disguises (digits and
symbols for letters, repeated letters, separators and spaces inside a word) form a lattice for each suspicious
token; Viterbi decoding restores the likeliest letters. Restored texts are then scored: each word and each of its
prefixes may carry a weight learned from labelled texts, and a logistic function of the largest weight and of
their sum gives the score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stored
from .words import LOWER, SPACE, flat, pieces, prefix_hasher, words_of

# ---- character language model ------------------------------------------------------------------

LETTERS = "abcdefghijklmnopqrstuvwxyzàáâäçèéêëíîïñóôöùúûüß"
SYMBOLS = len(LETTERS) + 1  # 0 is the edge of a word
ADD = 0.1  # added to every trigram count


def _letter_table() -> np.ndarray:
    """Number of each code point below 0x250: a letter (either case) or the edge."""
    table = np.zeros(0x250, np.int64)
    for code in range(0x250):
        at = LETTERS.find(chr(code).lower()) if chr(code).isalpha() and len(chr(code).lower()) == 1 else -1
        table[code] = at + 1
    return table


def trigram_counts(docs: DataFrame, text: str) -> DataFrame:
    """``gram`` and ``n``: letter trigrams of all texts. At most SYMBOLS ** 3 rows, summed per task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _letter_table()
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for part in pieces(batch, "text"):
                joined = " ".join(t for t in part.column("text").to_pylist() if t)
                codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
                numbers = np.concatenate(([0, 0], table[np.where(codes < 0x250, codes, 0)], [0]))
                grams = (numbers[:-2] * SYMBOLS + numbers[1:-1]) * SYMBOLS + numbers[2:]
                total += np.bincount(grams, minlength=SYMBOLS**3)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], ["gram", "n"])

    counted = docs.select(F.col(text).alias("text")).mapInArrow(run, "gram int, n bigint")
    return counted.groupBy("gram").agg(F.sum("n").alias("n"))


def language_model(docs: DataFrame, text: str) -> np.ndarray:
    """Log probability of a letter after two others, from all of ``docs``: SYMBOLS ** 3 numbers."""
    counts = np.full(SYMBOLS**3, ADD)
    for row in trigram_counts(docs, text).collect():  # bounded by the alphabet
        counts[row["gram"]] += row["n"]
    cube = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    return np.log(cube / cube.sum(axis=2, keepdims=True)).astype(np.float32)


# ---- channel and decoding ----------------------------------------------------------------------

# What a disguise may stand for.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e",
}
BETWEEN = " .-_*~/·​"
SUBSTITUTED, SKIPPED, PARTED = 0.5, 0.3, 0.5  # channel costs (negative log)
DROPPED_PAIR, DROPPED_RUN = 4.0, 0.1  # of a repeated character: doubles are mostly meant, longer runs are not
LONGEST = 40  # a longer token, repetitions aside, is more than one word: its parts are judged
CACHED = 160  # longer tokens and runs are decoded each time


def decode_token(token: str, model: np.ndarray, spaced: bool) -> str:
    """Likeliest letters behind ``token``: Viterbi over its lattice, with the last two letters as state.

    A character may be itself, a letter it stands for, a repetition (dropped) or a separator (skipped); in a
    spaced run a word may also end before any letter.
    """
    # Texts are chains of (chain before, letters), so that a step costs the same wherever in the token it is.
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    before, token = "", token.lower()
    in_run = {i for m in _TRIPLE.finditer(token) for i in range(*m.span())}
    for i, c in enumerate(token):
        dropped = DROPPED_RUN if i in in_run else DROPPED_PAIR
        own = LETTERS.find(c)
        options = [(own, 0.0)] if own >= 0 else [(LETTERS.index(x), SUBSTITUTED) for x in STANDS_FOR.get(c, "")]
        moved: dict[tuple[int, int], tuple[float, tuple | None]] = {}

        def put(state: tuple[int, int], cost: float, text: tuple | None) -> None:
            if state not in moved or cost < moved[state][0]:
                moved[state] = (cost, text)

        for (a, b), (cost, text) in states.items():
            if c == before and text:
                put((a, b), cost + dropped, text)
            if c in BETWEEN or not options:
                put((a, b), cost + SKIPPED, text)
            for letter, price in options:
                n = letter + 1
                put((b, n), cost + price - float(model[a, b, n]), (text, LETTERS[letter]))
                if spaced and text:
                    end = cost + price + PARTED - float(model[a, b, 0]) - float(model[b, 0, n])
                    put((0, n), end, (text, " " + LETTERS[letter]))
        states, before = moved or states, c
    ends = [(cost - float(model[a, b, 0]), text) for (a, b), (cost, text) in states.items()]
    least = min(cost for cost, _ in ends)
    return min(_spelled(text) for cost, text in ends if cost == least)


def _spelled(chain: tuple | None) -> str:
    out = []
    while chain:
        chain, letters = chain
        out.append(letters)
    return "".join(reversed(out))


_BETWEEN_LETTERS = ".-_*~/·\u200b"
_IN_WORD = re.compile(r"[^\W\d_]", re.UNICODE)
_EDGES = re.compile(r"^[^\w@$!|+(]+|[^\w]+$|^([^\w])\1+")
_SPACED = re.compile(r"(?<![^\W_])[^\W_](?:[ .\-_*~/·\u200b]{1,2}[^\W_]){3,}(?![^\W_])")
_LEET = re.compile(r"[0-9@$!|+(€]")
_REPEATED = re.compile(r"(.)\1+")
_TRIPLE = re.compile(r"(.)\1\1+")
_PART = re.compile(r"(?:(?!\d{4})[^.\-_*~/·\u200b])+")
_ADDRESS = re.compile(r"://|^www\.|\w@\w+\.\w")
_SPLIT = re.compile(r"(?:[^\W\d_][.\-_*~/·​]){2,}[^\W\d_]")


def _odd(core: str, most: int | None = None) -> bool:
    """Whether ``core`` looks like a disguised word: two letters, a third of it letters, and something odd."""
    letters = len(_IN_WORD.findall(core))
    if not 2 <= letters or not 3 <= len(core) or most and len(core) > most and len(_REPEATED.sub(r"\1", core)) > most:
        return False
    return bool(_LEET.search(core) or _TRIPLE.search(core) or _SPLIT.search(core)) and 3 * letters >= len(core)


def disguised(word: str) -> list[tuple[int, int]]:
    """Where the parts of a word are that look like disguised ones, each to be decoded by itself.

    Mostly that is the word without its edges. A longer one, or one with few letters, is judged by its parts between
    separators and long numbers; a part may be of any length.
    """
    edge = _EDGES.match(word)
    start = edge.end() if edge and edge.group(0) else 0
    core = _EDGES.sub("", word)
    start = word.find(core, start) if core else 0
    if _ADDRESS.search(core):
        return []
    if _odd(core, LONGEST):
        return [(start, start + len(core))]
    parts = [m.span() for m in _PART.finditer(core)]
    if len(parts) < 2 and len(core) <= LONGEST:
        return []
    return [(start + a, start + b) for a, b in parts if _odd(core[a:b])]


class Restorer:
    """Restores texts with one language model; all but very long tokens are decoded once per worker."""

    def __init__(self, model: np.ndarray):
        self.model = model
        self._one = lru_cache(maxsize=100_000)(lambda token: decode_token(token, model, False))
        self._run = lru_cache(maxsize=10_000)(lambda token: decode_token(token, model, True))

    def one(self, token: str) -> str:
        return self._one(token) if len(token) <= CACHED else decode_token(token, self.model, False)

    def run(self, token: str) -> str:
        return self._run(token) if len(token) <= CACHED else decode_token(token, self.model, True)

    def text(self, text: str, at: list[tuple[int, int]]) -> str:
        """``text`` with the words at the given places restored, and with spaced runs joined."""
        out, done = [], 0
        for start, end in at:
            for a, b in disguised(text[start:end]):
                out += [text[done : start + a], self.one(text[start + a : start + b])]
                done = start + b
        text = "".join([*out, text[done:]])
        return _SPACED.sub(lambda m: self.run(m[0]) if _IN_WORD.search(m[0]) else m[0], text)


def _mask(chars: str) -> np.ndarray:
    mask = np.zeros(256, bool)
    mask[[ord(c) for c in chars]] = True
    return mask


_LETTER = _mask("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") | (np.arange(256) >= 0x80)


def _among(codes: np.ndarray, chars: str) -> np.ndarray:
    table = np.zeros(128, bool)
    table[[ord(c) for c in chars if ord(c) < 128]] = True
    found = table[np.minimum(codes, 127)] & (codes < 128)
    for c in chars:
        if ord(c) >= 128:
            found |= codes == ord(c)
    return found


def _suspects(words, points: np.ndarray) -> np.ndarray:
    """Words (indexes) worth a closer look: every word that ``disguised`` accepts, and the singles of spaced runs.

    Works on code points; ``points`` has the code points before each byte. A word needs two letters and an odd
    character anywhere, a triple, or two separators that each have one character on either side.
    """
    codes = np.frombuffer(words.data.tobytes().decode().encode("utf-32-le"), np.uint32)
    n, start, end = len(codes), points[words.start], points[words.end]
    if n < 3 or not len(start):
        return np.zeros(0, np.int64)
    digit = (codes >= 48) & (codes <= 57)
    separator = _among(codes, _BETWEEN_LETTERS)
    odd = _among(codes, "@$!|+(€") | digit
    letter = (_among(codes, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") | (codes >= 128)) & ~separator & ~odd

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(n + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[end] - total[start]

    mark = odd.copy()
    mark[:-2] |= (codes[:-2] == codes[1:-1]) & (codes[1:-1] == codes[2:])
    mark[1:-3] |= letter[:-4] & separator[1:-3] & letter[2:-2] & separator[3:-1] & letter[4:]
    letters = count(letter)
    hit = (count(mark) > 0) & (letters >= 2)
    # Single letters or digits, four or more in a row with one or two separators between them.
    member = letter | digit
    edge = np.zeros(n + 1, bool)
    edge[points[words.text_at]] = True
    open_before = np.concatenate(([True], ~member[:-1])) | edge[:-1]
    open_after = np.concatenate((~member[1:], [True])) | edge[1:]
    single = np.flatnonzero(member & open_before & open_after)
    if len(single) >= 4:
        between = separator | (codes == 32)
        gap = np.diff(single)
        near = between[single[:-1] + 1] & ((gap == 2) | (gap == 3) & between[single[1:] - 1])
        row = single[:-3][near[:-2] & near[1:-1] & near[2:]]
        hit[np.searchsorted(start, row, "right") - 1] = True
    return np.flatnonzero(hit)


def restored(column: pa.Array, restorer: Restorer) -> pa.Array:
    """Texts with disguised words restored; most texts have none and are not touched (null becomes empty)."""
    words = words_of(column)
    points = np.zeros(len(words.data) + 1, np.int64)
    np.cumsum((words.data & 0xC0) != 0x80, out=points[1:])
    suspects = _suspects(words, points)
    if not len(suspects):
        return column.fill_null("")
    out = column.fill_null("").to_pylist()
    for i in np.unique(words.text[suspects]).tolist():
        own = suspects[words.text[suspects] == i]
        base = points[words.text_at[i]]
        places = zip((points[words.start[own]] - base).tolist(), (points[words.end[own]] - base).tolist())
        out[i] = restorer.text(out[i], list(places))
    return pa.array(out, column.type)


# ---- features ----------------------------------------------------------------------------------

PREFIXES = (3, 4, 5, 6, 7)  # bytes; whole words count as well


def letter_runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and start, end and text of each run of letters."""
    data, at = flat(texts)
    data = LOWER[data]
    member = _LETTER[data] & ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    if not len(data):
        none = np.zeros(0, np.int64)
        return data, none, none, none
    start = np.flatnonzero(member & np.concatenate(([True], ~member[:-1] | edge[1:-1])))
    end = np.flatnonzero(member & np.concatenate((~member[1:] | edge[1:-1], [True]))) + 1
    return data, start, end, np.searchsorted(at, start, "right") - 1


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, hash) of every word and of its prefixes."""
    data, start, end, text = letter_runs(texts)
    hashes = prefix_hasher(data)
    long = end - start >= 3
    yield text[long], hashes(start[long], end[long], 0)
    for size in PREFIXES:
        long = end - start >= size
        yield text[long], hashes(start[long], start[long] + size, size)


def _pairs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs."""
    found = [np.unique(np.stack([t.astype(np.uint64), h]), axis=1) if len(t) else np.zeros((2, 0), np.uint64) for t, h in features(texts)]
    both = np.concatenate(found, axis=1)
    return both[0].astype(np.int64), both[1]


class Weights:
    """Feature hashes (sorted) with their weights; the largest weight and the sum of each text."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.weights = hashes[order], weights[order]

    def evidence(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        n = len(texts)
        top, total = np.zeros(n), np.zeros(n)
        if not len(self.hashes):
            return top, total
        seen: list[np.ndarray] = []
        for text, h in features(texts):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            hit = self.hashes[at] == h
            seen.append(np.unique(text[hit] * len(self.hashes) + at[hit]))
        pairs = np.concatenate(seen)
        text, weight = pairs // len(self.hashes), self.weights[pairs % len(self.hashes)]
        np.maximum.at(top, text, weight)
        np.add.at(total, text, weight)
        return top, total


# ---- fitting and scoring -----------------------------------------------------------------------

FIT_ROWS = 20_000  # labelled rows that the classifier is fitted on, at most
FIT_FEATURES = 50_000  # features with a weight, at most
LEAST_TEXTS = 4  # toxic texts that must hold a feature
LEAST_WEIGHT = 2.0  # log odds


def _fit_rows(docs: DataFrame, labels: DataFrame, id: str, text: str, label: str, rows: int) -> DataFrame:
    """Texts of the sample (id, text, toxic, half): labelled rows with the smallest hash of their id."""
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col(id).isNotNull())
        .groupBy(F.col(id).cast("bigint").alias("label_id"))
        .agg(F.max(F.col(label).cast("int")).alias("toxic"))
        .where(~held_out(F.col("label_id")))
        .orderBy(F.xxhash64("label_id"), "label_id")
        .limit(rows)
    )
    half = F.pmod(F.xxhash64("label_id", F.lit("half")), F.lit(2)).cast("int").alias("half")
    # At most ``rows`` small rows, so they may go to every task, and no text is shuffled.
    chosen = F.broadcast(chosen.select("label_id", "toxic", half))
    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")).join(chosen, F.col("id") == F.col("label_id")).select("text", "toxic", "half")


def held_out(id):
    """Rows that no label is learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _weigh(sample: DataFrame, model: np.ndarray, features_at_most: int = FIT_FEATURES) -> Weights:
    """Log odds of features over the first half of the sample; equal texts count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model)
        for batch in batches:
            for part in pieces(batch, "text"):
                text, feature = _pairs(restored(part.column("text"), restorer))
                toxic = np.asarray(part.column("toxic"))[text]
                names, place = np.unique(feature, return_inverse=True)
                bad = np.bincount(place, toxic, len(names)).astype(np.int64)
                all_ = np.bincount(place, minlength=len(names))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names.view(np.int64)), pa.array(bad), pa.array(all_ - bad)], ["feature", "bad", "good"]
                )

    first = sample.where("half = 0").dropDuplicates(["text"])
    size = first.agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")).first()
    bad, good = float(size["bad"] or 0), float(size["good"] or 0)
    counted = first.select("text", "toxic").mapInArrow(run, "feature bigint, bad bigint, good bigint")
    weight = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    rows = (
        counted.groupBy("feature")
        .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        .where(F.col("bad") >= LEAST_TEXTS)
        .withColumn("weight", weight)
        .where(F.col("weight") >= LEAST_WEIGHT)
        .orderBy(F.desc("weight"), "feature")
        .limit(features_at_most)
        .select("feature", "weight")
        .collect()
    )
    return Weights(
        np.array([r["feature"] for r in rows], np.int64).view(np.uint64), np.array([r["weight"] for r in rows], np.float64)
    )


def _inputs(top: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(top)), top, np.log1p(total)], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps; the constant is not penalised."""
    beta = np.zeros(x.shape[1])
    ridge = np.diag([1e-6, *[penalty] * (x.shape[1] - 1)])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _calibrate(sample: DataFrame, weights: Weights, model: np.ndarray) -> np.ndarray:
    """Coefficients of the score, from the second half of the sample (three numbers per row reach the driver)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model)
        for batch in batches:
            for part in pieces(batch, "text"):
                top, total = weights.evidence(restored(part.column("text"), restorer))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(top), pa.array(total), part.column("toxic")], ["top", "total", "toxic"]
                )

    rows = sample.where("half = 1").select("text", "toxic").mapInArrow(run, "top double, total double, toxic int")
    got = np.array([(r["top"], r["total"], r["toxic"]) for r in rows.collect()], np.float64).reshape(-1, 3)
    if not len(got):
        return np.array([-1.0, 0.0, 0.0])  # nothing is known to be toxic
    return _logistic(_inputs(got[:, 0], got[:, 1]), got[:, 2])


def restore_texts(docs: DataFrame, text: str = "text", into: str = "restored") -> DataFrame:
    """``docs`` (rows of ``text`` only) with the restored text in ``into``; the language model is that of ``docs``."""
    model = language_model(docs, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model)
        for batch in batches:
            for part in pieces(batch, text):
                yield pa.RecordBatch.from_arrays([part.column(text), restored(part.column(text), restorer)], [text, into])

    return docs.select(text).mapInArrow(run, f"`{text}` string, `{into}` string")


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    *,
    fit_rows: int = FIT_ROWS,
    fit_features: int = FIT_FEATURES,
) -> DataFrame:
    """Per row of ``docs``: ``id``, ``held_out``, ``score`` (0 to 1), ``predicted`` (1 from 0.5 on).

    The language model is counted over all texts. The classifier is fitted on at most ``fit_rows`` labelled rows, none
    of them held out; scores use the text alone. A null or empty text has no evidence and gets the lowest score.
    Rows with a null id are scored and not held out. Several labels of one id count as toxic if one is. Without
    labels every score is the same and below 0.5; an empty table gives an empty result. Texts of any length are
    restored and scored whole, a piece at a time. ``fit_features`` bounds the features with a weight: those with the
    highest, which reach the driver.
    """
    model = language_model(docs, text)
    sample = stored(_fit_rows(docs, labels, id, text, label, fit_rows), "labelled")
    weights = _weigh(sample, model, fit_features)
    beta = _calibrate(sample, weights, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model)
        for batch in batches:
            for part in pieces(batch, "text"):
                x = _inputs(*weights.evidence(restored(part.column("text"), restorer)))
                score = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(score)], ["id", "score"])

    rows = docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "id bigint, score double").select(
        F.col("id").alias(id),
        held_out(F.col("id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
