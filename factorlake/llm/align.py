"""Tokens of two tokenizers linked through the bytes they share, with sparse matrices built by hand.

A text's tokens, written as bytes, cut the same byte string twice. Which token holds which byte is an incidence matrix
in CSR form: tokens by bytes. The product A·Bᵀ of both has an entry wherever a token of A and one of B hold bytes in
common: these are the links, and the entry says how many bytes. The product is formed row by row (Gustavson): a row gathers
the rows of the right factor that its entries name and adds up equal columns. Bytes at which tokens of both end cut
the tokens into groups; the incidence of tokens and groups, multiplied likewise, links what shares a group. Such products can
be as dense as a group is long, so their row sums come from the factors, and the links themselves stay factored.

Counts of linked id pairs are corpus-wide. A task collects the texts of a chunk, keeps their links as indexes into the
chunk's distinct pairs, and sends each distinct pair once. Spark adds the pairs up, finds each B id's highest count and
joins both back to the chunks, where links look them up.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import packed, unpacked
from .store import stored
from .vocab import PATTERN
from .words import pieces

BYTE_BPE_JSON = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
PIECE_BYTES = 1 << 20
CHUNK_BYTES = 4 << 20


@dataclass
class Csr:
    """A sparse matrix of counts: row i has columns ``col[at[i]:at[i+1]]``, with ``value`` (ones if None)."""

    at: np.ndarray
    col: np.ndarray
    width: int
    value: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.at) - 1

    def rows(self) -> np.ndarray:
        """Row of each entry."""
        return np.repeat(np.arange(len(self)), np.diff(self.at))

    def T(self) -> Csr:
        """The transpose, its rows sorted by column."""
        order = np.argsort(self.col, kind="stable")
        at = np.append(0, np.cumsum(np.bincount(self.col, minlength=self.width)))
        return Csr(at, self.rows()[order], len(self), None if self.value is None else self.value[order])

    def row_sums(self, of: np.ndarray) -> np.ndarray:
        """The product with a vector."""
        total = np.append(0, np.cumsum(of[self.col] if self.value is None else of[self.col] * self.value))
        return total[self.at[1:]] - total[self.at[:-1]]


def incidence(at: np.ndarray) -> Csr:
    """Tokens by bytes, of tokens that hold the bytes from ``at[i]`` to ``at[i+1]``."""
    return Csr(at, np.arange(at[-1]), int(at[-1]))


def membership(at: np.ndarray) -> Csr:
    """Bytes by tokens: the transpose of ``incidence``, whose rows have one entry each."""
    return Csr(np.arange(at[-1] + 1), np.repeat(np.arange(len(at) - 1), np.diff(at)), len(at) - 1)


def product(a: Csr, b: Csr) -> Csr:
    """``a`` times ``b`` by rows: each entry of a row of ``a`` brings a row of ``b``; equal columns are added up."""
    size = np.diff(b.at)[a.col]
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    if total == len(a.col) and (size == 1).all():  # every entry brings one: nothing to spread
        take, entry = b.at[a.col], slice(None)
    else:
        take = np.repeat(b.at[a.col] - (ends - size), size) + np.arange(total)
        entry = np.repeat(np.arange(len(a.col)), size)
    key = a.rows()[entry] * np.int64(max(b.width, 1)) + b.col[take]
    value = None
    if a.value is not None or b.value is not None:
        value = (1 if a.value is None else a.value[entry]) * (1 if b.value is None else b.value[take])
    if total > 1 and (key[1:] < key[:-1]).any():
        order = np.argsort(key, kind="stable")
        key, value = key[order], None if value is None else value[order]
    head = np.flatnonzero(np.diff(key, prepend=-1))
    added = np.diff(np.append(head, total)) if value is None else np.add.reduceat(value, head) if len(head) else value
    row, col = np.divmod(key[head], max(b.width, 1))
    return Csr(np.append(0, np.cumsum(np.bincount(row, minlength=len(a)))), col, b.width, added)


# A regular expression may need a step back for each character of a run, and libraries limit those.
RANKED_CHARS = 500_000


def _by_ranks(path: str, table: list[bytes]):
    """The same encoder by merge ranks, or None if the file's rules are not exactly those that ranks express.

    Merges must be numbered in order behind the 256 bytes, and words split by the pattern of ``vocab`` with nothing changed
    before. Both libraries then give the same ids, as a test over all characters shows; ranks take a fifth of the time.
    """
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    model, split = rules["model"], rules["pre_tokenizer"] or {}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", ())]
    ordered = all(model["vocab"].get(left + right) == 256 + i for i, (left, right) in enumerate(pairs))
    plain = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    extra = [model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")]
    if model["type"] != "BPE" or not ordered or not plain or rules["normalizer"] or any(extra):
        return None
    ranks = {token: i for i, token in enumerate(table[: 256 + len(pairs)])}
    if len(ranks) != 256 + len(pairs):
        return None
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@lru_cache(maxsize=2)
def byte_bpe(path: str):
    """Tokenizer A: an encoder of many texts, and the bytes of its ids."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    # Byte-level vocabularies write printable bytes as themselves and the others as code points from 256 on.
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in shown}
    byte |= {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(shown))}
    table = [b""] * tokenizer.get_vocab_size(with_added_tokens=True)
    for token, i in tokenizer.get_vocab(with_added_tokens=True).items():
        table[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
    ranked = _by_ranks(path, table)

    def encode(texts: list[str]) -> list[list[int]]:
        slow = [i for i, t in enumerate(texts) if ranked is None or len(t) > RANKED_CHARS]
        out = [ranked(t) if ranked is not None and len(t) <= RANKED_CHARS else [] for t in texts]
        for i, e in zip(slow, tokenizer.encode_batch_fast([texts[i] for i in slow], add_special_tokens=False)):
            out[i] = e.ids
        return out

    return encode, table


@lru_cache(maxsize=2)
def piece_bpe(path: str):
    """Tokenizer B: an encoder of many texts, and the bytes of its ids."""
    import sentencepiece

    tokenizer = sentencepiece.SentencePieceProcessor(model_file=path)
    table = []
    for i in range(tokenizer.get_piece_size()):
        piece = tokenizer.id_to_piece(i)
        table.append(bytes([int(piece[3:5], 16)]) if tokenizer.is_byte(i) else piece.replace("▁", " ").encode())
    return lambda texts: tokenizer.encode(texts, num_threads=1), table


@dataclass
class Side:
    """Tokens of one tokenizer over many texts, one after the other."""

    ids: np.ndarray
    first: np.ndarray  # of each text: index of its first token, with the total at the end
    at: np.ndarray  # byte at which each token starts, with the total at the end


@dataclass
class Aligned:
    a: Side
    b: Side
    links: Csr  # tokens of A by tokens of B; values are common bytes
    group_at: np.ndarray  # byte at which each group starts, with the total at the end
    group_first: np.ndarray  # of each text: index of its first group, with the total at the end

    def groups(self, side: Side) -> Csr:
        """Tokens by groups: one entry a token."""
        n = len(side.ids)
        return Csr(np.arange(n + 1), np.searchsorted(self.group_at, side.at[:-1], "right") - 1, len(self.group_at) - 1)

    def shared(self) -> np.ndarray:
        """Row sums of the group product: how many tokens of B share a group with each token of A."""
        a, b = self.groups(self.a), self.groups(self.b)
        return a.row_sums(b.T().row_sums(np.ones(len(b), np.int64)))

    def shared_links(self) -> Csr:
        """The group product itself: tokens of A by tokens of B that share a group. As large as groups are dense."""
        return product(self.groups(self.a), self.groups(self.b).T())


def _side(ids: list[list[int]], lengths: np.ndarray) -> Side:
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.fromiter((t for one in ids for t in one), np.int32, int(sizes.sum()))
    return Side(flat, np.append(0, np.cumsum(sizes)), np.append(0, np.cumsum(lengths[flat])))


@lru_cache(maxsize=4)
def _tables(path_a: str, path_b: str):
    def lengths(table):
        return np.fromiter(map(len, table), np.int64, len(table))

    ta, tb = byte_bpe(path_a)[1], piece_bpe(path_b)[1]
    ends = np.array([f"{i},".encode() for i in range(len(ta))] + [f"{i}|".encode() for i in range(len(ta))]
                    + [f"{i},".encode() for i in range(len(tb))] + [f"{i};".encode() for i in range(len(tb))], object)
    return ta, tb, lengths(ta), lengths(tb), ends


def align(texts: list[str | None], path_a: str = BYTE_BPE_JSON, path_b: str = PIECE_BPE) -> Aligned:
    """Align the tokens of each text with a space before it. Texts that are null or empty, or whose tokens do not spell it
    byte for byte, have none."""
    ta, tb, la, lb, _ = _tables(path_a, path_b)
    some = [i for i, t in enumerate(texts) if t]
    spaced = [" " + texts[i] for i in some]
    a: list[list[int]] = [[]] * len(texts)
    b: list[list[int]] = [[]] * len(texts)
    for i, text, ia, ib in zip(some, spaced, byte_bpe(path_a)[0](spaced), piece_bpe(path_b)[0]([texts[i] for i in some])):
        whole = text.encode()
        if b"".join(map(ta.__getitem__, ia)) == whole and b"".join(map(tb.__getitem__, ib)) == whole:
            a[i], b[i] = ia, ib
    sa, sb = _side(a, la), _side(b, lb)
    both = np.zeros(int(sa.at[-1]) + 1, np.int8)
    both[sa.at] = 1
    both[sb.at] += 1
    group_at = np.flatnonzero(both == 2)
    return Aligned(sa, sb, product(incidence(sa.at), membership(sb.at)), group_at, np.searchsorted(group_at, sa.at[sa.first]))


def group_texts(found: Aligned, path_a: str = BYTE_BPE_JSON, path_b: str = PIECE_BPE) -> list[bytes]:
    """Ids of both sides by group, for each text: ``a1,a2|b1;a3|b2,b3``."""
    ta, tb, _, _, ends = _tables(path_a, path_b)
    ga, gb = found.groups(found.a).col, found.groups(found.b).col
    groups = len(found.group_at) - 1
    na, nb = np.bincount(ga, minlength=groups), np.bincount(gb, minlength=groups)
    out = np.empty(len(ga) + len(gb), np.int64)
    before_b = np.cumsum(nb) - nb  # tokens of B in earlier groups
    last_a = np.append(ga[1:] != ga[:-1], True) if len(ga) else np.zeros(0, bool)
    last_b = np.append(gb[1:] != gb[:-1], True) if len(gb) else np.zeros(0, bool)
    out[np.arange(len(ga)) + before_b[ga]] = found.a.ids + last_a * len(ta)
    out[np.arange(len(gb)) + np.cumsum(na)[gb]] = 2 * len(ta) + found.b.ids + last_b * len(tb)
    first = found.a.first + found.b.first
    words = ends[out].tolist()
    return [b"".join(words[s:e])[:-1] for s, e in zip(first[:-1].tolist(), first[1:].tolist())]


def alignments(docs: DataFrame, id: str = "doc_id", text: str = "text", *, path_a: str = BYTE_BPE_JSON, path_b: str = PIECE_BPE) -> DataFrame:
    """Per row of ``docs``: ``id``, ``a_ids``, ``b_ids``, ``groups`` (how many tokens of either side each has), ``links``
    (token of A and of B by position, and the bytes in common) and ``shared`` (tokens of B in the group of each token of A).

    Null, empty and unspellable texts have empty arrays; repeated rows and null ids are rows like others.
    """
    out = "a_ids array<int>, b_ids array<int>, groups array<struct<a:bigint,b:bigint>>, links array<struct<a:bigint,b:bigint,bytes:bigint>>, shared array<bigint>"

    def lists(first: np.ndarray, values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), values)

    def struct(**columns: np.ndarray) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns.values()], list(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", PIECE_BYTES):
                f = align(piece.column("text").to_pylist(), path_a, path_b)
                n, at = len(f.group_at) - 1, f.links.at[f.a.first]
                sizes = struct(a=np.bincount(f.groups(f.a).col, minlength=n), b=np.bincount(f.groups(f.b).col, minlength=n))
                row = f.links.rows()
                text_of = np.repeat(np.arange(len(piece)), np.diff(f.a.first))[row]
                links = struct(a=row - f.a.first[text_of], b=f.links.col - f.b.first[text_of], bytes=f.links.value)
                columns = [
                    lists(f.a.first, pa.array(f.a.ids)),
                    lists(f.b.first, pa.array(f.b.ids)),
                    lists(f.group_first, sizes),
                    lists(at, links),
                    lists(f.a.first, pa.array(f.shared())),
                ]
                yield pa.RecordBatch.from_arrays([piece.column("id"), *columns], ["id", "a_ids", "b_ids", "groups", "links", "shared"])

    rows = docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id bigint, {out}").withColumnRenamed("id", id)


def _chunks(path_a: str, path_b: str, chunk_bytes: int):
    """Rows (chunk, docs, pairs): the documents of a chunk packed, with links as counted indexes into its distinct pairs."""

    def close(chunk: int, tables: list[pa.Table], codes: list[np.ndarray], texts: list[np.ndarray], width: int) -> pa.RecordBatch:
        code, text = np.concatenate(codes), np.concatenate(texts)
        pairs, place, n = np.unique(code, return_inverse=True, return_counts=True)
        whole = pa.concat_tables(tables)
        key, times = np.unique(text * np.int64(max(len(pairs), 1)) + place, return_counts=True)
        of, place = np.divmod(key, max(len(pairs), 1))
        first = pa.array(np.searchsorted(of, np.arange(whole.num_rows + 1)).astype(np.int32))
        step = np.diff(place, prepend=0)  # small numbers pack well; sums give the places back
        for name, values in (("place", step), ("times", times)):
            whole = whole.append_column(name, pa.ListArray.from_arrays(first, pa.array(values.astype(np.int32))))
        a, b = np.divmod(pairs, width)
        pair = pa.StructArray.from_arrays([pa.array(a), pa.array(b), pa.array(n)], ["a", "b", "n"])
        return pa.RecordBatch.from_arrays(
            [pa.array([chunk], pa.int64()), pa.array([packed(whole.combine_chunks())], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(pair)], pa.int32()), pair)],
            ["chunk", "docs", "pairs"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 33
        width = len(piece_bpe(path_b)[1])
        tables, codes, texts, held, rows = [], [], [], 0, 0
        for batch in batches:
            for piece in pieces(batch, "text", PIECE_BYTES):
                f = align(piece.column("text").to_pylist(), path_a, path_b)
                row = f.links.rows()
                n_links = np.diff(f.links.at[f.a.first])
                shared = np.append(0, np.cumsum(f.shared()))[f.a.first]
                names = group_texts(f, path_a, path_b)
                tables.append(
                    pa.table(
                        {
                            "id": piece.column("id"),
                            "n_a": np.diff(f.a.first),
                            "n_b": np.diff(f.b.first),
                            "n_groups": np.diff(f.group_first),
                            "n_links": n_links,
                            "n_shared": np.diff(shared),
                            "groups_sha256": [hashlib.sha256(g).hexdigest() if g else "" for g in names],
                        }
                    )
                )
                codes.append(f.a.ids[row].astype(np.int64) * width + f.b.ids[f.links.col])
                texts.append(np.repeat(np.arange(rows, rows + len(piece)), n_links))
                rows += len(piece)
                held += int(f.a.at[-1]) + 64 * len(piece)
                if held >= chunk_bytes:
                    yield close(chunk, tables, codes, texts, width)
                    chunk, tables, codes, texts, held, rows = chunk + 1, [], [], [], 0, 0
        if tables:
            yield close(chunk, tables, codes, texts, width)

    return run


COUNTED = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string, n_shared bigint"


def _look_up(docs: pa.Table, answers: pa.Table) -> pa.Table:
    answers = answers.take(pc.sort_indices(answers, sort_keys=[("place", "ascending")]))
    count, best = np.asarray(answers["count"], np.int64), np.asarray(answers["best"], np.int64)
    out = []
    for blob in docs["docs"]:
        whole = unpacked(blob)
        place, times = whole["place"].combine_chunks(), np.asarray(whole["times"].combine_chunks().flatten(), np.int64)
        first = np.asarray(place.offsets, np.int64)
        at = np.cumsum(np.asarray(place.flatten(), np.int64))
        sums = [np.append(0, np.cumsum(times * of[at]))[first] if len(at) else np.zeros(len(first), np.int64) for of in (best, count)]
        whole = whole.append_column("n_best", pa.array(np.diff(sums[0]))).append_column("count_sum", pa.array(np.diff(sums[1])))
        out.append(whole.select(["id", *[c.split()[0] for c in COUNTED.split(", ")]]))
    return pa.concat_tables(out)


def alignment_counts(
    docs: DataFrame, id: str = "doc_id", text: str = "text", *, path_a: str = BYTE_BPE_JSON, path_b: str = PIECE_BPE, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """Per row of ``docs``: id, n_a, n_b, n_groups, n_links, ``n_best`` (links whose id pair is linked as often, over all rows,
    as any pair with that id of B), ``count_sum`` (how often each link's id pair is linked, summed up), groups_sha256
    and ``n_shared`` (pairs of tokens that share a group).

    Null, empty and unspellable texts have zeros and an empty groups_sha256. Repeated rows and rows with null ids
    are rows like others and count in full. An empty table gives an empty result; other columns are not read. Texts stay in
    the scan's task, a megabyte at a time or one longer text; what is shuffled is a row per chunk, and a row per chunk
    and distinct pair in it, so a pair that is everywhere has one row per chunk and no group grows beyond a chunk.
    """
    rows = docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    pair = "array<struct<a:bigint,b:bigint,n:bigint>>"
    chunks = stored(rows.mapInArrow(_chunks(path_a, path_b, chunk_bytes), f"chunk bigint, docs binary, pairs {pair}"), "chunks")
    pairs = chunks.select("chunk", F.posexplode("pairs").alias("place", "pair")).select("chunk", "place", "pair.*")
    counts = stored(pairs.groupBy("a", "b").agg(F.sum("n").alias("count")), "pair-counts")
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    judged = counts.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))
    answers = pairs.join(judged, ["a", "b"]).select(F.col("chunk").alias("asked"), "place", "count", "best")
    sides = chunks.select("chunk", "docs").groupBy("chunk"), answers.groupBy("asked")
    return sides[0].cogroup(sides[1]).applyInArrow(_look_up, f"id bigint, {COUNTED}").withColumnRenamed("id", id)
