"""The numbered operators as queries over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .align import alignment_counts
from .bpe import encode
from .merkle import audit, audit_sql
from .mixing import mix, mix_sql
from .near_dedup import near_duplicates
from .neighbours import near_vectors
from .quality import quality
from .secrets import secret_spans, span_digests
from .shards import ring_shards
from .substrings import remove_repeats
from .topk import top_k, top_k_sql
from .toxicity import toxicity
from .warc import capture_index

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


@query
def op9_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring_shards(table(spark, sf_dir, "documents"), shards=40)


@query
def op5_token_efficiency_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digests(secret_spans(table(spark, sf_dir, "documents")))


@query
def op2_suffix_array_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality(docs).select("doc_id", "_quality.*")


@query
def op3_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = capture_index(table(spark, sf_dir, "pages"))
    return index.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "part", "nth"
    )


@query
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents"), window=13)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op8_distinct_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = encode(table(spark, sf_dir, "documents"), decoded="decoded")
    return tokens.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op7_nn_descent_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.95)


@query
def op10_deobfuscated_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


MIX_WEIGHTS = {
    "domain": {"crawl": 50, "reference": 30, "forum": 20},
    "lang": {"en": 70, "de": 10, "fr": 10, "es": 10},
}
# A table of sources has no domains, so they follow the number in the source's name.
MIX_DOMAIN = (
    "CASE WHEN source = 'src0' THEN 'crawl' WHEN right(source, 1) IN ('0', '2', '4', '6', '8') THEN 'reference' "
    "ELSE 'forum' END"
)
MIX_LEVELS = {"domain": MIX_DOMAIN, "lang": "lang", "source": "source"}
MIX_SEED = 7


def mixed(docs: DataFrame, into: str = "_mix") -> DataFrame:
    return mix(docs, {k: F.expr(e) for k, e in MIX_LEVELS.items()}, MIX_WEIGHTS, seed=MIX_SEED, into=into)


@query
def op4_hierarchical_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    levels = [F.coalesce(F.expr(e), F.lit("(none)")).alias(k) for k, e in MIX_LEVELS.items()]
    return mixed(docs).where("_mix.copies > 0").select("doc_id", *levels, "_mix.*")


SQL["op4_hierarchical_mixing"] = mix_sql("documents", MIX_LEVELS, MIX_WEIGHTS, seed=MIX_SEED)


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


SQL["op13_merkle_manifest"] = audit_sql("documents")


@query
def op12_block_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), queries=F.col("vec_id") % 50 == 0, k=5)


SQL["op12_block_top_k"] = top_k_sql("embeddings", "vec_id % 50 = 0")


@query
def op11_token_byte_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_counts(table(spark, sf_dir, "documents"))
