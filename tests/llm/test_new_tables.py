"""Alignment, top-k and manifest against plain versions, on test tables and on edge cases."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter

import brute
import duckdb
import edge
import numpy as np
import pytest
from pyspark.sql import functions as F

from factorlake.llm import merkle
from factorlake.llm.align import Csr, alignment_counts, alignments, product
from factorlake.llm.merkle import audit, content_digest, folded, manifest, proofs
from factorlake.llm.topk import top_k

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    own = edge.documents(spark).withColumn("doc_id", F.col("doc_id") + 100_000)
    odd = [(200_000, "▁ in a text"), (200_001, "<|endoftext|> </s> <0x41> <unk>"), (200_002, "  two  spaces \n\n"), (200_003, "한국어 ไทย 🙂🙂")]
    more = spark.createDataFrame(odd, "doc_id bigint, text string")
    whole = spark.read.parquet(f"{SMALL}/documents.parquet").unionByName(own, allowMissingColumns=True)
    return whole.unionByName(more, allowMissingColumns=True).cache()


@pytest.mark.parametrize("chunk_bytes", [4 << 20, 10_000])
def test_alignment(docs, chunk_bytes):
    got = alignment_counts(docs, chunk_bytes=chunk_bytes).collect()
    want = brute.alignment([tuple(r) for r in docs.select("doc_id", "text").collect()])
    digest = lambda names: hashlib.sha256(names.encode()).hexdigest() if names else ""
    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert Counter(tuple(r[c] for c in columns) for r in got) == Counter((*w[:7], digest(w[7])) for w in want)
    assert any(w[1] == 0 and w[0] == 200_000 for w in want)  # U+2581 does not survive


def test_alignments_hold_what_is_counted(docs):
    long = docs.where("length(text) < 20000")
    counted = {r["doc_id"]: r for r in alignment_counts(long).where("doc_id is not null").collect()}
    for r in alignments(long).where("doc_id is not null").collect():
        c = counted[r["doc_id"]]
        assert (len(r["a_ids"]), len(r["b_ids"]), len(r["groups"]), len(r["links"])) == (c["n_a"], c["n_b"], c["n_groups"], c["n_links"])
        assert sum(g["a"] for g in r["groups"]) == c["n_a"] and sum(g["a"] * g["b"] for g in r["groups"]) == c["n_shared"] == sum(r["shared"])
        assert all(x["bytes"] > 0 and x["a"] < c["n_a"] and x["b"] < c["n_b"] for x in r["links"])


def test_ranks_give_the_ids_of_the_vocabulary_file():
    """Every character between letters, digits, signs and spaces, and runs of one character."""
    from tokenizers import Tokenizer

    from factorlake.llm import align

    slow = Tokenizer.from_file(align.BYTE_BPE_JSON)
    slow.encode_special_tokens = True
    assert align._by_ranks(align.BYTE_BPE_JSON, align.byte_bpe(align.BYTE_BPE_JSON)[1]) is not None
    texts = [f"a{chr(c)}a1{chr(c)}1.{chr(c)}. {chr(c)}  {chr(c)}{chr(c)}" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts += [c * n for c in " a.\n" for n in (2, 7, 5000)] + ["x" + " " * 5000 + "y", "<|endoftext|>'LL 'll", "a" * 600_000]
    for i in range(0, len(texts), 20_000):
        part = texts[i : i + 20_000]
        assert align.byte_bpe(align.BYTE_BPE_JSON)[0](part) == [e.ids for e in slow.encode_batch_fast(part, add_special_tokens=False)]


def test_alignment_of_no_rows(docs):
    assert alignment_counts(docs.where("false")).count() == 0 and alignments(docs.where("false")).count() == 0


def test_sparse_product():
    rng = np.random.default_rng(3)
    for _ in range(20):
        n, m, k = rng.integers(1, 9, 3)
        a, b = (rng.integers(0, 4, s) * (rng.random(s) < 0.4) for s in ((n, m), (m, k)))

        def csr(x):
            return Csr(np.append(0, np.cumsum((x != 0).sum(1))), np.nonzero(x)[1], x.shape[1], x[x != 0])

        got = product(csr(a), csr(b))
        dense = np.zeros((n, k), int)
        dense[got.rows(), got.col] = got.value if got.value is not None else 1
        assert (dense == a @ b).all()
        assert (csr(a).row_sums(np.arange(m)) == a @ np.arange(m)).all()
        t = csr(a).T()
        back = np.zeros((m, n), int)
        back[t.rows(), t.col] = t.value
        assert (back == a.T).all()


def plain_top_k(rows, k=5, scale=256):
    good = [(n, i, [math.floor(scale * float(x)) for x in v]) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    limit = 2**63 - 1
    clip = lambda s: max(-limit, min(limit, s))
    out = Counter()
    for n, i, v in good:
        if i is not None and i % 50 == 0:
            all_ = [(-clip(sum(x * y for x, y in zip(v, w))), j is None, j or 0, j) for m, j, w in good if m != n]
            for rank, (s, _, _, j) in enumerate(sorted(all_)[:k], 1):
                out[i, rank, j, -s] += 1
    return out


@pytest.mark.parametrize("shape", [{}, {"shard_rows": 64, "block_rows": 8, "slice_queries": 7}])
def test_top_k(spark, shape):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 0.2, 16).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)]  # copies, ties among them
    rows += [(50, rows[0][1]), (50, rows[0][1]), (None, rows[3][1]), (None, None), (150, None), (200, [1.0, None]), (250, [float("nan")] * 16)]
    rows += [(5000, [float("inf")] + [0.0] * 15), (5050, []), (5100, [0.5, -0.5]), (5150, [3e9] * 16), (5200, [-3e9] * 16), (5250, [0.0] * 16)]
    df = spark.createDataFrame([(i, v, 1, "s") for i, v in rows], "vec_id bigint, embedding array<double>, score int, shard string").repartition(5)
    got = top_k(df, F.col("vec_id") % 50 == 0, **shape).collect()
    assert Counter(tuple(r) for r in got) == plain_top_k(rows)
    assert top_k(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0
    few = top_k(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") % 50 == 0).collect()
    assert [r["rank"] for r in few] == [1, 2]


def test_most_blocks_of_clusters_are_left_out():
    from factorlake.llm.topk import NONE, Shard, search

    rng = np.random.default_rng(6)
    centers = rng.integers(-200, 200, (32, 24))
    rows = (centers[:, None] + rng.integers(-9, 10, (32, 64, 24))).reshape(-1, 24)
    parts = [rows[i : i + 64] for i in range(0, len(rows), 64)]
    n = np.arange(len(rows))
    shard = Shard(parts, np.array([p.max(0) for p in parts]), np.array([p.min(0) for p in parts]), np.arange(0, len(rows) + 1, 64), n, n, n < 0, n < 0)
    q, d, s, scored = search(shard, rows[::50], n[::50], np.full(len(rows[::50]), NONE), 5)
    every = rows[::50] @ rows.T
    every[np.arange(len(every)), n[::50]] = -(2**40)
    assert (s.reshape(-1, 5) == -np.sort(-every, axis=1)[:, :5]).all()
    assert scored < len(rows[::50]) * 6  # of 32 blocks


@pytest.mark.parametrize(("fan", "leaves"), [(2, 1024), (2, 4), (3, 9)])
def test_manifest(spark, docs, monkeypatch, fan, leaves):
    monkeypatch.setattr(merkle, "SEGMENT_LEAVES", leaves)
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def leaf(r):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    def tree(level):
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i : i + fan])) for i in range(0, len(levels[-1]), fan)])
        return levels

    def siblings(levels, i):
        out = []
        for level in levels[:-1]:
            run = level[i // fan * fan : i // fan * fan + fan]
            out.append((run[: i % fan], run[i % fan + 1 :]))
            i //= fan
        return out

    key = lambda v: (v is not None, v if v is not None else 0)
    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    own = {g: sorted((r for r in rows if r[2] == g), key=lambda r: (key(r[0]), leaf(r))) for g in langs}
    trees = {g: tree([leaf(r) for r in own[g]]) for g in langs}
    top = tree([trees[g][-1][0] for g in langs])
    want = Counter()
    for at, g in enumerate(langs):
        for i, r in enumerate(own[g]):
            way = siblings(trees[g], i) + siblings(top, at)
            now = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
                now = (*r[:3], r[3] + 1, r[4])
            up = leaf(now)
            for left, right in way:
                up = sha("".join(left) + up + "".join(right))
            proof = sha("".join(s for left, right in way for s in left + right))
            want[r[0], leaf(r), trees[g][-1][0], top[-1][0], proof, up, up == top[-1][0]] += 1
    assert Counter(tuple(r) for r in audit(docs, fan=fan).collect()) == want


def test_manifest_of_few_rows(spark):
    schema = "doc_id bigint, source string, lang string, n_chars bigint, text string, tree string, digest int"
    assert audit(spark.createDataFrame([], schema)).count() == 0
    one = spark.createDataFrame([(1, "s", None, None, None, "x", 1)], schema)
    (r,) = audit(one).collect()
    assert r["leaf"] == r["subroot"] == r["root"] == r["folded_root"] and r["verified"]
    assert r["proof_sha256"] == hashlib.sha256(b"").hexdigest()


def test_records_and_single_requests(spark):
    rows = spark.createDataFrame([(i % 90, "t", "g" if i < 70 else "h") for i in range(100)], "doc_id int, text string, lang string")
    m = manifest(rows, ["doc_id", "text"], "lang", "doc_id", keep={"doc_id": F.col("doc_id")})
    records = {r["digest"]: r["children"] for r in m.records().collect()}
    assert all(hashlib.sha256("".join(c).encode()).hexdigest() == d for d, c in records.items())
    found = proofs(m, F.col("kept.doc_id") == 50).withColumn("up", folded(F.col("leaf")))
    (want,) = rows.where("doc_id = 50").limit(1).select(content_digest(["doc_id", "text"])).first()
    got = found.collect()
    assert len(got) == 1 and got[0]["leaf"] == want and got[0]["up"] == got[0]["root"]


def test_new_sql_gives_the_same_rows(spark):
    from factorlake.llm.queries import QUERIES, SQL

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    for name in ("op12_block_top_k", "op13_merkle_manifest"):
        got = QUERIES[name](spark, SMALL)
        want = con.sql(SQL[name]).df()[got.columns]
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.itertuples(index=False)))
