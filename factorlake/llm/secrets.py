"""Secret scan: fixed patterns, and strings that a BPE vocabulary splits into very short tokens.

Ordinary words and names cost few tokens for their length, random strings many. A run of at least ``MIN_RUN``
characters of ``[A-Za-z0-9+/_=-]`` with fewer than ``max_ratio`` characters per token is taken for random,
after known digests (hex of a usual length), UUIDs, dates and times and plain numbers are excluded.

If a whole run is not, its parts of that length between ``/ = - _`` are judged one by one; what a fixed pattern leaves
of a run is a run of its own.

Byte-wide passes over whole pieces find the runs and the texts that need the pattern with keywords; only those
reach Python's regular expressions. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vocab import BYTE_BPE, encoding
from .words import LOWER, flat, pieces

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
KEYWORDS = (b"passw", b"secret", b"token", b"api")  # every match of ASSIGN holds one of these, lower-cased
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX_RUN, MIN_RUN = 24, 20
DIGEST_LENGTHS = frozenset((32, 40, 48, 56, 64, 96, 128))
HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+", re.ASCII)
UUID = re.compile(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.ASCII | re.IGNORECASE)
PART = re.compile(rf"(?<![A-Za-z0-9]){UUID.pattern}(?![A-Za-z0-9])|[^=/_-]+", re.ASCII | re.IGNORECASE)
DATED = re.compile(r"\d{4}-\d{2}-\d{2}([T_-]?\d{2}[-_]?\d{2}([-_]?\d{2})?)?", re.ASCII)
ENCODE_AT_ONCE = 1024


def _mask(chars: str) -> np.ndarray:
    mask = np.zeros(256, bool)
    mask[[ord(c) for c in chars]] = True
    return mask


_ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_IS_HEX = _mask("0123456789abcdef")
_IS_RUN = _mask(_ALNUM + "+/_=-")


def _long_runs(member: np.ndarray, edges: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of set bytes with ``least`` bytes or more, cut at text edges."""
    if not len(member):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(member) + 1, bool)
    edge[edges] = True
    start = np.flatnonzero(member & np.concatenate(([True], ~member[:-1] | edge[1:-1])))
    end = np.flatnonzero(member & np.concatenate((~member[1:] | edge[1:-1], [True]))) + 1
    keep = end - start >= least
    return start[keep], end[keep]


def looks_random(run: str, max_ratio: float, vocabulary: str) -> bool:
    bare = run.strip("=-_/+")
    if HEX.fullmatch(bare) and len(bare) in DIGEST_LENGTHS or UUID.fullmatch(bare):
        return False
    rest = DATED.sub("", bare)
    letters = sum(c.isalpha() for c in rest)
    if len(rest) < MIN_RUN or not letters:
        return False
    encode = encoding(vocabulary).encode_ordinary
    tokens = sum(len(encode(rest[i : i + ENCODE_AT_ONCE])) for i in range(0, len(rest), ENCODE_AT_ONCE))
    return len(rest) < max_ratio * tokens


def random_spans(run: str, max_ratio: float, vocabulary: str) -> list[tuple[int, int]]:
    """Where ``run`` looks random: all of it, or else its parts between separators, which readable parts cannot dilute.

    Neighbouring parts that each cost many tokens are one part, as random strings may hold separators. A part of the
    form of a UUID stands for itself.
    """
    if looks_random(run, max_ratio, vocabulary):
        return [(0, len(run))]
    encode = encoding(vocabulary).encode_ordinary
    spans, start, end = [], 0, 0

    def close() -> None:
        if end - start >= MIN_RUN and looks_random(run[start:end], max_ratio, vocabulary):
            spans.append((start, end))

    for m in PART.finditer(run):
        a, b = m.span()
        if b - a >= MIN_RUN or UUID.fullmatch(m[0]):
            dense = looks_random(m[0], max_ratio, vocabulary)
        else:
            dense = b - a < max_ratio * len(encode(m[0]))
        if not dense:
            close()
            start = end = b
        elif end > start and a - end == 1:
            end = b
        else:
            close()
            start, end = a, b
    close()
    return spans


def _merged(spans: list[tuple[int, int, int]]) -> list[list[int]]:
    """The union of spans, as sorted intervals that do not touch."""
    out: list[list[int]] = []
    for a, _, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


class _Outside:
    """Parts of intervals, asked in order of their starts, that no span covers: both lists are walked once."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.covered, self.at = _merged(spans), 0

    def parts(self, start: int, end: int) -> Iterator[tuple[int, int]]:
        while self.at < len(self.covered) and self.covered[self.at][1] <= start:
            self.at += 1
        k = self.at
        while start < end:
            a, b = self.covered[k] if k < len(self.covered) else (end, end)
            if start < min(a, end):
                yield start, min(a, end)
            start, k = max(start, b), k + 1
            if a >= end:
                return


def piece_spans(texts: pa.Array, max_ratio: float, vocabulary: str) -> list[list[tuple[int, int, int]]]:
    """Spans (start, kind, end) of each text, sorted; kinds index ``KINDS``."""
    data, at = flat(texts)
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(at) - 1)]
    if not len(data):
        return found
    whole = data.tobytes()
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])

    def text_of(position: int) -> int:
        return int(np.searchsorted(at, position, "right")) - 1

    def add(kind: int, start: int, end: int) -> None:
        i = text_of(start)
        found[i].append((int(points[start] - points[at[i]]), kind, int(points[end] - points[at[i]])))

    lowered = LOWER[data].tobytes()
    flagged: set[int] = set()
    for word in KEYWORDS:
        position = lowered.find(word)
        while position >= 0:
            i = text_of(position)
            flagged.add(i)
            position = lowered.find(word, int(at[i + 1]))
    for i in flagged:
        text = whole[at[i] : at[i + 1]].decode()
        found[i].extend((m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6)
    position, seen = whole.find(b"AKIA"), -1
    while position >= 0:
        i = text_of(position)
        if i != seen:
            seen = i
            text = whole[at[i] : at[i + 1]].decode()
            found[i].extend((m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20)
        position = whole.find(b"AKIA", int(at[i + 1]))
    for start, end in zip(*_long_runs(_IS_HEX[data], at, HEX_RUN)):
        add(2, start, end)
    outside: dict[int, _Outside] = {}
    for start, end in zip(*_long_runs(_IS_RUN[data], at, MIN_RUN)):
        i = text_of(start)
        a, b = int(points[start] - points[at[i]]), int(points[end] - points[at[i]])
        run = whole[start:end].decode()
        if i not in outside:  # runs come text by text; what they add is no base span
            outside[i] = _Outside(found[i])
        for x, y in outside[i].parts(a, b):
            if y - x >= MIN_RUN:
                found[i].extend((x + p, 3, x + q) for p, q in random_spans(run[x - a : y - a], max_ratio, vocabulary))
    for spans in found:
        spans.sort()
    return found


def secret_spans(
    docs: DataFrame, id: str = "doc_id", text: str = "text", *, max_ratio: float = 2.0, vocabulary: str = BYTE_BPE
) -> DataFrame:
    """Per row of ``docs``: ``id``, ``spans`` (array of kind, start, end; sorted by start, then kind as listed).

    A null or empty text has an empty array. Repeated rows and rows with null ids are scanned one by one; an
    empty table gives an empty result. Texts are scanned whole. There is no shuffle. ``vocabulary`` is the
    path of a tiktoken rank file that every executor can read.
    """
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                spans = [
                    [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in s]
                    for s in piece_spans(part.column("text"), max_ratio, vocabulary)
                ]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(spans, pa.list_(kind))], ["id", "spans"])

    schema = "id bigint, spans array<struct<kind:string,start:int,end:int>>"
    return (
        docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text"))
        .mapInArrow(run, schema)
        .withColumnRenamed("id", id)
    )


def span_digests(spans: DataFrame) -> DataFrame:
    """Counts of the pattern kinds, a checksum over them, and all spans as one string, in place of ``spans``."""

    def of(kind: str):
        return F.filter("spans", lambda s: s["kind"] == kind)

    def text(s):
        return F.concat_ws(":", s["kind"], s["start"], s["end"])

    base = F.filter("spans", lambda s: s["kind"] != "random")
    return spans.withColumns(
        {f"n_{k}": F.size(of(k)).cast("bigint") for k in ("assign", "access", "hex", "random")}
        | {
            "base_sha256": F.sha2(F.array_join(F.transform(base, text), ","), 256),
            "spans": F.array_join(F.transform("spans", text), ","),
        }
    )


def redact(
    docs: DataFrame,
    text: str = "text",
    *,
    mark: str = "[SECRET]",
    max_ratio: float = 2.0,
    vocabulary: str = BYTE_BPE,
) -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mark`` (overlapping spans by one); nulls stay null."""
    names = docs.columns
    others = [F.col(f"`{c}`") for c in names if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text):
                column = part.column(text)
                out = column.to_pylist()
                for i, spans in enumerate(piece_spans(column, max_ratio, vocabulary)):
                    if not spans:
                        continue
                    kept, at = [], 0
                    for start, _, end in spans:
                        if start >= at:
                            kept += [out[i][at:start], mark]
                        at = max(at, end)
                    out[i] = "".join([*kept, out[i][at:]])
                yield part.set_column(part.schema.get_field_index(text), text, pa.array(out, column.type))

    return docs.select(*others, F.col(text)).mapInArrow(run, docs.select(*others, F.col(text)).schema).select(*names)

