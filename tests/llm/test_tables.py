"""Archives, mixing, vectors, toxicity and the pipeline against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import brute
import duckdb
import edge
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factorlake.llm import neighbours
from factorlake.llm.bpe import decode, encode
from factorlake.llm.mixing import divide, mix, mix_sql
from factorlake.llm.neighbours import near_vectors
from factorlake.llm.queries import QUERIES, SQL
from factorlake.llm.toxicity import LETTERS, SYMBOLS, Restorer, disguised, restored, toxicity
from factorlake.llm.vocab import encoding
from factorlake.llm.warc import capture_index, loser_tree, url_key

SMALL = "/root/testdata/sf0.001"


# ---- archives ----------------------------------------------------------------------------------


def captures(rows):
    """page -> length, digest, type, refers_to"""
    top: dict = {}
    for i, html in rows:
        b = (html or "").encode()
        if len(b) >= 1000 and i is not None:
            top[b] = max(top.get(b, i), i)
    out = Counter()
    for i, html in rows:
        b = (html or "").encode()
        first = top.get(b, i)
        kind = ("response", None) if first == i else ("revisit", first)
        out[(i, len(b), hashlib.sha1(b).hexdigest(), *kind)] += 1
    return out


def test_archives(spark):
    big = "<p>é" + "x" * 2000
    extra = [(9001, "http://b.example/?q=1 2\nX: y", big), (9002, None, big), (9003, "not a url [", big), (9003, "http://r.example/", big)]
    extra += [(9004, "http://s.example/", "small"), (9005, "http://s.example/", "small"), (9006, "", None), (9007, "http://e.example", "")]
    extra += [(None, "http://n.example", big), (None, None, None)]
    more = spark.createDataFrame([(*r, "x", 1) for r in extra], "page_id bigint, url string, html string, digest string, payload int")
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").unionByName(more, allowMissingColumns=True)
    got = capture_index(pages).collect()
    assert Counter(
        (r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got
    ) == captures([(r["page_id"], r["html"]) for r in pages.collect()])
    order = [(r["url_key"], r["captured"], r["page_id"] or 0) for r in sorted(got, key=lambda r: (r["part"], r["nth"]))]
    assert order == sorted(order)
    assert capture_index(pages.where("false")).count() == 0


def test_loser_tree_and_keys():
    pick = random.Random(3)
    for k in range(12):
        runs = [sorted((pick.randrange(20),) for _ in range(pick.randrange(9))) for _ in range(k)]
        assert list(loser_tree(runs, lambda r: r)) == sorted(sum(runs, []))
    assert url_key("https://www.Example.org:8080/A/b?C=d") == "org,example)/a/b?c=d"


# ---- mixing ------------------------------------------------------------------------------------


def test_mixing_matches_sql(spark):
    levels = {"lang": "lang", "source": "source"}
    weights = {"lang": {"en": 5, "de": 3}, "source": {"src1": 4}}
    docs = edge.documents(spark).unionByName(spark.read.parquet(f"{SMALL}/documents.parquet"), allowMissingColumns=True)
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "lang", "source").toArrow())
    for budget in (None, 5_000, 0, 10**9):
        got = mix(docs, {k: F.col(k) for k in levels}, weights, budget=budget, seed=3).where("_mix.copies > 0")
        got = got.select("doc_id", *[F.coalesce(k, F.lit("(none)")) for k in levels], "_mix.*")
        want = con.execute(mix_sql("documents", levels, weights, budget=budget, seed=3)).fetchall()
        assert Counter(map(tuple, got.collect())) == Counter(want)
    assert mix(edge.empty(spark), {"lang": F.col("lang")}, {}).count() == 0


def test_shortage_goes_to_siblings(spark):
    rows = [("p", "a", 10, 100), ("p", "b", 1000, 100), ("p", "c", 1000, 100), ("q", "a", 3, 50)]
    df = spark.createDataFrame(rows, "parent string, node string, capacity bigint, amount bigint")
    got = {(r["parent"], r["node"]): r["share"] for r in divide(df, ["parent"], "node", {"b": 2}, 1).collect()}
    assert got == {("p", "a"): 10, ("p", "b"): 60, ("p", "c"): 30, ("q", "a"): 3}


# ---- vectors -----------------------------------------------------------------------------------


def vectors_brute(rows, threshold):
    good = {}
    for n, (i, v) in enumerate(rows):
        if i is not None and v is not None and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and any(v):
            unit = np.array(v) / np.abs(v).max()
            good[n] = unit / np.linalg.norm(unit)
    links, degree = [], Counter()
    keys = list(good)
    for a, x in enumerate(keys):
        for y in keys[a + 1 :]:
            if float(good[x] @ good[y]) >= threshold:
                links.append((rows[x][0], rows[y][0]))
                degree[x] += 1
                degree[y] += 1
    ids = {i for i, _ in rows if i is not None}
    root = brute.roots(ids, links)
    most = Counter()
    for n, d in degree.items():
        most[rows[n][0]] = max(most[rows[n][0]], d)
    return Counter((i, most[i] if i is not None else 0, root.get(i)) for i, _ in rows)


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    pick = np.random.default_rng(5)
    rows = [(i, pick.standard_normal(8).tolist()) for i in range(150)]
    for group, size in ((1000, 90), (2000, 5), (3000, 2)):  # the first is larger than any neighbour list
        centre = pick.standard_normal(8)
        rows += [(group + k, (centre + 0.12 * pick.standard_normal(8)).tolist()) for k in range(size)]
    same = pick.standard_normal(8).tolist()
    rows += [(4000 + k, same) for k in range(30)] + [(4100, [2.0 * x for x in same]), (4100, [2.0 * x for x in same])]
    rows += [(5000, None), (5001, [0.0] * 8), (5002, [float("nan")] * 8), (5003, [None] * 8), (5004, [1.0] * 3), (5005, [])]
    rows += [(5006, [float("inf")] * 8), (None, same), (5007, [1e300 * x for x in same]), (5008, [-0.0] * 7 + [1.0])]
    df = spark.createDataFrame([(i, v, 1, 2, "u") for i, v in rows], "vec_id bigint, embedding array<double>, label int, id int, unit string")
    got = near_vectors(df, threshold=0.9, k=5, tables=8).collect()
    assert Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == vectors_brute(rows, 0.9)
    assert all(r["kept"] == (r["vec_id"] is None or r["vec_id"] == r["component_id"]) for r in got)
    assert all(r["audit_recall"] >= 0.9 for r in got)
    assert near_vectors(df.where("false")).count() == 0


def test_bridge_between_full_lists(spark):
    # Two dense groups on a circle, each larger than a list, and one pair at cosine 0.956 between their outposts.
    pick = np.random.default_rng(3)
    rows = []
    for base, degrees, size in ((100, 0, 30), (200, 5, 1), (300, 22, 1), (400, 27, 30)):
        for n in range(size):
            turn = math.radians(degrees)
            rows.append((base + n, [math.cos(turn), math.sin(turn), *(0.01 * pick.standard_normal(6) * (size > 1)).tolist()]))
    want = vectors_brute(rows, 0.95)
    assert {c for _, _, c in want} == {100}
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = near_vectors(df, threshold=0.95, k=10).collect()
    assert Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == want


def test_forest_edges_reach_the_threshold():
    chain = np.array([[1, 0.96, 0.93], [0.96, 1, 0.96], [0.93, 0.96, 1]], np.float32)
    a, b = [], []
    neighbours._forest_of(chain, 0.95, neighbours.ROUNDED, np.array([7, 8, 9]), a, b)
    assert list(zip(a[0].tolist(), b[0].tolist())) == [(7, 8), (8, 9)]
    a, b = [], []  # pairs that 8-bit codes leave in doubt are all sent
    neighbours._forest_of(chain, 0.95, neighbours.QUANTISED, np.array([7, 8, 9]), a, b)
    assert list(zip(a[0].tolist(), b[0].tolist())) == [(7, 8), (7, 9), (8, 9)]


def test_audit_sees_lost_links_of_small_groups(spark):
    # One group of 300 with all its links, and 30 pairs of which none was found.
    at = [(i, 0) for i in range(300)] + [(1000 + 2 * p + n, p + 1) for p in range(30) for n in range(2)]
    pick = np.random.default_rng(1)
    centres = pick.standard_normal((31, 64))
    units = [centres[c] + 0.01 * pick.standard_normal(64) for _, c in at]
    rows = [(i, 1, bytearray((u / np.linalg.norm(u)).tobytes())) for (i, _), u in zip(at, units)]
    classes = spark.createDataFrame(rows, "id bigint, copies bigint, unit binary")
    found = spark.createDataFrame([(i, 299 if i < 1000 else 0, i < 300) for i, _ in at], "id bigint, links bigint, saturated boolean")
    assert neighbours.audit(classes, found, 64, 0.95) == 0.0
    assert neighbours.audit(classes, found.withColumn("links", F.when(F.col("saturated"), 299).otherwise(1)), 64, 0.95) == 1.0
    assert neighbours.audit(classes.where("id % 2 = 0 and id >= 1000"), found.where("id % 2 = 0 and id >= 1000"), 64, 0.95) is None
    lists = spark.createDataFrame([(1, 2, 0.99), (1, 3, 0.99), (4, 5, 0.5)], "src bigint, dst bigint, sim float")
    more = spark.createDataFrame([(1, 2, 0.99), (1, 6, 0.99), (4, 7, 0.97)], "src bigint, dst bigint, sim float")
    assert neighbours.gains(lists, more, 2, 0.95) == (1, 1)


def test_low_recall_is_not_returned(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "audit", lambda *_: 0.5)
    df = spark.createDataFrame([(i, [1.0, 0.1 * i]) for i in range(4)], "vec_id bigint, embedding array<double>")
    with pytest.raises(RuntimeError, match="recall"):
        near_vectors(df, attempts=1, rounds=1).count()


# ---- toxicity ----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def restorer():
    counts = np.full((SYMBOLS,) * 3, 0.1)
    for word in "idiot stupid pathetic loser scum moron trash the and you are an what a worthless clown".split() * 50:
        at = [0, 0, *[LETTERS.index(c) + 1 for c in word], 0]
        for a, b, c in zip(at, at[1:], at[2:]):
            counts[a, b, c] += 1
    return Restorer(np.log(counts / counts.sum(axis=2, keepdims=True)).astype(np.float32))


def parts(word):
    return [word[a:b] for a, b in disguised(word)]


@pytest.mark.parametrize(
    ("shown", "meant"),
    [("1d10t", "idiot"), ("$tup1d", "stupid"), ("p.a.t.h.e.t.i.c", "pathetic"), ("loooser", "loser"), ("tr@sh", "trash"),
     ("m-o-r-o-n", "moron"), ("cl0wn", "clown")],
)
def test_restored_words(restorer, shown, meant):
    assert parts(shown) == [shown] and restorer.one(shown) == meant


def test_spaced_words_and_clean_text(restorer):
    assert restorer.text("so s c u m it is", []) == "so scum it is"
    assert not any(map(disguised, ("plain", "2024-01-02", "jo@mail.example.com", "well-known", "")))


def test_every_disguised_word_is_restored(restorer):
    shown = ["sh17", "whor3", "slu7", "idi07", "s\u200bc\u200bu\u200bm", "s·c·u·m", "€diot", "tr€sh", "a.1.b", "ééé", "lóóóser", "a---b", "4é", "é4é",
             "x1", "2024-01-02", "(idi0t)", "jo@mail.example.com", "plain", "m-o-r-o-n", "ß.ß.ß", "cl0wn!"]
    pick = random.Random(4)
    shown += ["".join(pick.choices("abé1€.-·\u200b@(o", k=pick.randint(1, 9))) for _ in range(3000)]
    shown += ["-".join(["1d10t", "m0r0n", "plain"] * 8), "id1ot2024010203040506", "20240102030405", "http://x.org/1d10t-m0r0n"]
    assert sum(bool(disguised(w)) for w in shown) > 500
    for word in shown:
        want, done = "", 0
        for a, b in disguised(word):
            want, done = want + word[done:a] + restorer.one(word[a:b]), b
        want += word[done:]
        assert restored(pa.array([f"es gibt {word} hier"]), restorer)[0].as_py() == restorer.text(f"es gibt {want} hier", []), word
    assert restored(pa.array(["rows 1 2 3 4 5 of 6"]), restorer)[0].as_py() == "rows 1 2 3 4 5 of 6"
    texts = ["so s c u m it", None, "é. c. u. m. x", "", "ab", *shown]
    assert restored(pa.array(texts), restorer).to_pylist()[5:] == [restored(pa.array([w]), restorer)[0].as_py() for w in shown]
    assert restored(pa.array(texts), restorer)[0].as_py() == "so scum it"


def test_long_runs_and_stretched_words(restorer):
    def of(text):
        return restored(pa.array([text]), restorer)[0].as_py()

    words = "you are a worthless clown and the moron and pathetic trash and an idiot what a loser " * 3
    for mark in (" ", ".", "·", "\u200b"):
        spelled = mark.join(words.replace(" ", ""))
        assert len(spelled) > 400 and all(w in of(spelled) for w in ("worthless", "clown", "moron", "pathetic", "trash", "idiot"))
    assert of("st" + "u" * 200 + "pid it is") == "stupid it is"
    assert of("-".join(["1d10t", "m0r0n"] * 9)) == "-".join(["idiot", "moron"] * 9)
    assert of("id1ot2024010203040506") == "idiot2024010203040506"
    long = " ".join("idiot" * 4000)
    assert of(long).replace(" ", "") == long.replace(" ", "")


def test_the_lattice_is_searched_whole(restorer):
    """Viterbi against all ways to read a short token."""
    from itertools import product

    from factorlake.llm import toxicity as tox

    def cheapest(token):
        triple = {i for m in tox._TRIPLE.finditer(token) for i in range(*m.span())}
        best = []
        ways = []
        for c in token:
            own = [(c, 0.0)] if c in LETTERS else [(x, tox.SUBSTITUTED) for x in tox.STANDS_FOR.get(c, "")]
            ways.append([*own, ("drop", None), *([("skip", tox.SKIPPED)] if c in tox.BETWEEN or not own else [])])
        for way in product(*ways):
            text, cost, at = "", 0.0, (0, 0)
            for i, (c, (letter, price)) in enumerate(zip(token, way)):
                if letter == "drop":
                    if not (i and token[i - 1] == c and text):
                        break
                    cost += tox.DROPPED_RUN if i in triple else tox.DROPPED_PAIR
                elif letter == "skip":
                    cost += price
                else:
                    n = LETTERS.index(letter) + 1
                    cost, text, at = cost + price - float(restorer.model[at[0], at[1], n]), text + letter, (at[1], n)
            else:
                best.append((cost - float(restorer.model[at[0], at[1], 0]), text))
        return min(best)

    pick = random.Random(9)
    for token in ["1d10t", "m0r0n", "tr@sh", "$cum", *("".join(pick.choices("aios01$!.-", k=pick.randint(3, 7))) for _ in range(150))]:
        cost, text = cheapest(token)
        got = restorer.one(token)
        assert got == text, (token, got, text, cost)


def test_toxicity(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    own = edge.documents(spark).withColumn("doc_id", F.col("doc_id") + 100_000)
    insult = docs.join(labels.where("toxic = 1"), "doc_id").select((F.col("doc_id") + 200_000).alias("doc_id"), F.translate("text", "ioe", "103").alias("text"))
    every = docs.unionByName(own, allowMissingColumns=True).unionByName(insult, allowMissingColumns=True)
    got = toxicity(every, labels.unionByName(labels.limit(5)))
    rows = got.join(labels.dropDuplicates(["doc_id"]), "doc_id").collect()
    assert got.count() == every.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    right = sum(r["predicted"] == r["toxic"] for r in rows) / len(rows)
    caught = [r["predicted"] for r in rows if r["toxic"]]
    assert right > 0.93 and sum(caught) / len(caught) > 0.5
    assert sum(r["predicted"] for r in got.where("doc_id between 100000 and 150000").collect()) == 0
    assert toxicity(every.where("false"), labels).count() == 0
    (blind,) = {(r["score"], r["predicted"]) for r in toxicity(own, labels.where("false")).collect()}
    assert blind[0] < 0.5 and blind[1] == 0


# ---- pipeline and registry ---------------------------------------------------------------------


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    good = corpus_pipeline.quality_rules(spark, docs, SMALL)
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {i: t for i, t in rows.items() if brute.quality(t)["kept"]}
    assert good.columns == columns and {r["doc_id"] for r in good.collect()} == set(kept)
    single = corpus_pipeline.near_dedup(spark, good, SMALL).cache()
    place = brute.near_duplicates(list(kept.items()), 80)
    assert single.columns == columns and sorted(r["doc_id"] for r in single.collect()) == sorted(i for i in kept if place[i][1] == i)
    clean = corpus_pipeline.secret_scan(spark, single, SMALL).cache()
    assert clean.columns == columns and clean.count() == single.count()
    assert not any(brute.base_secrets(r["text"]) for r in clean.collect())
    con = duckdb.connect()
    con.register("documents", clean.toArrow())
    want = Counter({r[0]: r[1] for r in con.execute(f"SELECT doc_id, copies FROM ({SQL['op4_hierarchical_mixing']})").fetchall()})
    drawn = corpus_pipeline.mixing(spark, clean, SMALL).cache()
    assert drawn.columns == columns and Counter(r["doc_id"] for r in drawn.collect()) == want
    texts = {r["doc_id"]: r["text"] for r in drawn.collect()}
    final = corpus_pipeline.run(spark, SMALL).collect()
    assert Counter(r["doc_id"] for r in final) == want
    for r in final:
        assert r["ids"] == encoding().encode_ordinary(texts[r["doc_id"]]) and r["n_tokens"] == len(r["ids"])
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_pipeline_takes_edge_cases(spark):
    docs = edge.documents(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    assert docs.count() > 0
    docs = edge.empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    assert docs.count() == 0


def test_registry():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(names) and set(SQL) <= set(entry.oracle_sql())


def test_decode_keeps_columns(spark):
    df = encode(spark.createDataFrame([(1, "ab"), (2, None)], "doc_id bigint, text string")).withColumn("decoded", F.lit("x"))
    assert {r["doc_id"]: bytes(r["decoded"]) for r in decode(df).collect()} == {1: b"ab", 2: b""}
