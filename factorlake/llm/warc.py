"""WARC archives from pages, and their capture index by an external merge.

Writing: equal payloads are found by digest; each task streams its rows into archives of gzip members, one record
each, in a shared folder. A file counts only once its task's result row is stored, so files of lost or repeated
attempts are ignored. Reading: tasks stream whole archives, check every digest, and sort the captures of each
archive by URL key and time: the runs. Merging: runs are cut at common range bounds, and each task merges its part of
all runs with a loser tree, which gives one index in global order, each URL's captures in sequence.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorlake.operators.skew import shared_dir

from .store import stored

REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIRST_CAPTURE = datetime(2024, 1, 1, tzinfo=timezone.utc)
MAX_RECORDS, MAX_BYTES = 50_000, 1 << 28  # of one archive, and so of one run
READ_BYTES = 1 << 20
READ_TASKS = 10_000  # most tasks that read archives; each streams one archive after the other
LEVEL = 3

CAPTURES = (
    "page_id bigint, url string, url_key string, captured string, record_type string, payload_digest string, "
    "payload_bytes bigint, refers_to bigint, archive string, at bigint, length bigint"
)


# ---- records -----------------------------------------------------------------------------------


def url_key(url: str) -> str:
    """Sort key of a URL: host labels reversed, then path and query, in lower case."""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return url.strip().lower()
    tail = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return f"{','.join(reversed(host.split('.')))}){tail.lower()}"


def capture_time(page_id: int | None) -> str:
    """WARC date; pages carry none, so it counts seconds by id."""
    return (FIRST_CAPTURE + timedelta(seconds=(page_id or 0) % 10**9)).strftime("%Y-%m-%dT%H:%M:%SZ")


def sha1_label(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, response_id: int | None) -> bytes:
    """One record; with ``response_id`` it revisits that page and has no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if response_id is not None else http + payload
    name = f"page:{page_id}" if page_id is not None else f"uuid:{uuid.uuid4()}"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if response_id is None else 'revisit'}",
        f"WARC-Record-ID: <urn:{name}>",
        f"WARC-Date: {capture_time(page_id)}",
        f"WARC-Payload-Digest: {sha1_label(digest)}",
        f"WARC-Block-Digest: {sha1_label(hashlib.sha1(block).digest())}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe='!#$%&()*+,/:;=?@[]~\x27')}")
    if response_id is not None:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{response_id}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a record: {lines[0][:40]!r}")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if sha1_label(hashlib.sha1(block).digest()) != headers["WARC-Block-Digest"]:
        raise ValueError(f"block digest of {headers['WARC-Record-ID']} does not match")
    return headers, block


def page_number(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def members(path: str) -> Iterator[tuple[int, int, bytes]]:
    """Offset, compressed length and content of each gzip member of a file, read as a stream."""
    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_stream(name, compression=None) as source:
        at, held = 0, b""
        inflate, parts, used = zlib.decompressobj(31), [], 0
        while True:
            if not held:
                held = source.read(READ_BYTES)
                if not held:
                    break
            parts.append(inflate.decompress(held))
            used += len(held) - len(inflate.unused_data)
            held = inflate.unused_data
            if inflate.eof:
                yield at, used, b"".join(parts)
                at += used
                inflate, parts, used = zlib.decompressobj(31), [], 0
        if used:
            raise ValueError(f"{path} ends inside a record")


# ---- writing and reading -----------------------------------------------------------------------


def marked(pages: DataFrame, page_id: str, url: str, html: str, least_bytes: int) -> DataFrame:
    """Pages with their payload digest and, for a repeated payload, the page that holds it (``response_id``)."""
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col(page_id).cast("bigint").alias("page_id"), F.col(url).alias("url"), payload.alias("payload")
    ).withColumn("digest", F.sha1("payload"))
    large = rows.where(F.octet_length("payload") >= least_bytes)
    repeated = (
        large.groupBy("digest")
        .agg(F.max("page_id").alias("response_id"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 and response_id is not null")
        .drop("n")
    )
    joined = rows.join(repeated, "digest", "left")
    return joined.withColumn(
        "response_id", F.when(~F.col("page_id").eqNullSafe(F.col("response_id")), F.col("response_id"))
    )


def write_archives(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", *, least_bytes: int = 1000
) -> DataFrame:
    """Write one WARC record per row and return the archives: ``archive`` (path), ``records``, ``bytes``.

    The payload is the html in UTF-8, empty for null. Of equal payloads of at least ``least_bytes``, the row with
    the largest id is the response and the others revisit it; repeated rows of that id are responses, too. Rows
    with null ids are written under a random record name. Other columns are not read; an empty table gives none.
    """
    folder = f"{shared_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, name = fs.FileSystem.from_uri(folder)
        store.create_dir(name, recursive=True)
        done: list[tuple[str, int, int]] = []
        out, path, count, size = None, "", 0, 0
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "response_id"))
            payloads = batch.column("payload")
            for i, (number, address, digest, response) in enumerate(zip(*columns)):
                if out is None:
                    path, count, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(fs.FileSystem.from_uri(path)[1], compression=None)
                gzip = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                raw = record(number, address, payloads[i].as_py(), bytes.fromhex(digest), response)
                packed = gzip.compress(raw) + gzip.flush()
                out.write(packed)
                count, size = count + 1, size + len(packed)
                if count >= MAX_RECORDS or size >= MAX_BYTES:
                    out.close()
                    done, out = [*done, (path, count, size)], None
        if out is not None:
            out.close()
            done.append((path, count, size))
        columns = [list(c) for c in zip(*done)] or [[], [], []]
        kinds = (pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], ["archive", "records", "bytes"]
        )

    rows = marked(pages, page_id, url, html, least_bytes)
    return stored(rows.mapInArrow(run, "archive string, records bigint, bytes bigint"), "archives")


def read_runs(archives: DataFrame) -> DataFrame:
    """The captures of each archive, sorted by URL key, time and page: one run per archive.

    Responses have the digest and length of the payload that was read, after comparison with their header; revisits
    those of the page that they refer to.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("archive").to_pylist():
                rows = []
                for at, length, raw in members(path):
                    headers, block = parse(raw)
                    kind = headers["WARC-Type"]
                    digest, size = headers["WARC-Payload-Digest"], None
                    if kind == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        size = len(payload)
                        if sha1_label(hashlib.sha1(payload).digest()) != digest:
                            raise ValueError(f"payload digest of {headers['WARC-Record-ID']} does not match")
                    url = headers.get("WARC-Target-URI")
                    rows.append(
                        (
                            page_number(headers["WARC-Record-ID"]),
                            url,
                            url_key(url) if url is not None else "",
                            re.sub(r"\D", "", headers["WARC-Date"]),
                            kind,
                            base64.b32decode(digest.removeprefix("sha1:")).hex(),
                            size,
                            page_number(headers.get("WARC-Refers-To")),
                            path,
                            at,
                            length,
                        )
                    )
                rows.sort(key=_order)
                yield _capture_batch(rows)

    spread = archives.select("archive").repartition(max(1, min(archives.count(), READ_TASKS)))
    read = stored(spread.mapInArrow(run, CAPTURES), "runs")
    held = (
        read.where("record_type = 'response' and page_id is not null")
        .select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload_bytes").alias("held_bytes"))
        .distinct()
    )
    names = [c.split()[0] for c in CAPTURES.split(", ")]
    full = read.join(held, ["refers_to", "payload_digest"], "left").withColumn(
        "payload_bytes", F.coalesce("payload_bytes", "held_bytes")
    )
    return full.select(*names)


def _order(row: tuple) -> tuple:
    return row[2], row[3], row[0] is not None, row[0] or 0


def _capture_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "string": pa.string()}
    names, types = zip(*(c.split() for c in CAPTURES.split(", ")))
    columns = [list(c) for c in zip(*rows)] or [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types)], list(names))


# ---- merging -----------------------------------------------------------------------------------


def loser_tree(runs: list[list[tuple]], key) -> Iterator[tuple]:
    """Merge sorted runs: each inner node keeps the loser of its match, the winner moves up to the root."""
    k = len(runs)
    if k == 0:
        return
    last = (True,)  # an exhausted run loses against everyone
    streams = [iter(r) for r in runs]
    heads: list[tuple | None] = [next(s, None) for s in streams]
    keys = [(False, key(h), i) if h is not None else last for i, h in enumerate(heads)]
    losers = [-1] * k

    def play(i: int) -> int:
        """Carry run ``i`` from its leaf to the root; the winner comes out (or waits for its first rival)."""
        node = (i + k) // 2
        while node:
            if losers[node] < 0:
                losers[node] = i
                return -1
            if keys[losers[node]] < keys[i]:
                losers[node], i = i, losers[node]
            node //= 2
        return i

    winner = max([play(i) for i in range(k)])  # only the last match has a winner
    while heads[winner] is not None:
        yield heads[winner]
        heads[winner] = next(streams[winner], None)
        keys[winner] = (False, key(heads[winner]), winner) if heads[winner] is not None else last
        winner = play(winner)


def merge_runs(runs: DataFrame) -> DataFrame:
    """One index in global order: (``part``, ``nth``) order all captures by URL key, time and page.

    Range bounds take in time and page, so that a URL with most of the captures is spread over tasks as well.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[str, list[tuple]] = {}
        numbers = set()
        for batch in batches:
            numbers.update(batch.column("part").unique().to_pylist())
            for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns - 1))):
                parts.setdefault(row[8], []).append(row)
        merged = list(loser_tree(list(parts.values()), _order))
        if merged:
            out = _capture_batch(merged)
            out = out.append_column("part", pa.array([max(numbers)] * len(merged), pa.int32()))
            yield out.append_column("nth", pa.array(range(len(merged)), pa.int64()))

    bounds = ["url_key", "captured", "page_id"]
    cut = runs.repartitionByRange(*bounds).sortWithinPartitions("archive", *bounds)
    return cut.withColumn("part", F.spark_partition_id()).mapInArrow(run, f"{CAPTURES}, part int, nth bigint")


def capture_index(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", *, least_bytes: int = 1000) -> DataFrame:
    """Write ``pages`` into archives, read them back, and return the merged capture index (see the parts).

    A null or empty page is an empty payload, a null url an empty key; repeated rows are captures of their own. Payloads of
    any length are written whole, one at a time. An empty table gives an empty result; other columns are not read.
    """
    archives = write_archives(pages, page_id, url, html, least_bytes=least_bytes)
    return merge_runs(stored(read_runs(archives), "captures"))
