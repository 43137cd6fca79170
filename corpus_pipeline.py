"""From raw documents to token ids: quality, near duplicates, secrets, mixture, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``. All but the last keep the columns of ``documents``, and any further columns, whatever their names. An
empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorlake.llm.bpe import encode
from factorlake.llm.near_dedup import near_duplicates
from factorlake.llm.quality import quality
from factorlake.llm.queries import mixed
from factorlake.llm.secrets import redact
from factorlake.llm.store import free, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go.

    Null, empty and short texts fail the rules; repeated rows and null ids are judged like others; texts of any length whole.
    """
    verdict = free(docs, "_quality")
    return quality(docs, into=verdict).where(f"{verdict}.kept").drop(verdict)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id, once if rows repeat it.

    Texts without words are no duplicates of each other. Rows with null ids stay, as they cannot be told apart.
    """
    gone = near_duplicates(docs.select("doc_id", "text"), percent=80).where("not kept").select("doc_id").distinct()
    # Of rows with equal ids and texts one stays, the same in every run.
    same = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("n_chars", "source", "lang")
    nth = free(docs, "_nth")
    left = docs.join(gone, "doc_id", "left_anti").withColumn(nth, F.row_number().over(same))
    return left.where(f"{nth} = 1 or doc_id is null").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of the texts; every document stays. Null and empty texts stay as they are."""
    return redact(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their domain, language and source draw them.

    Null languages and sources are groups of their own; null ids and repeated rows are drawn like others.
    """
    found, copy = free(docs, "_mix"), free(docs, "_copy")
    drawn = mixed(docs, into=found).where(f"{found}.copies > 0")
    return drawn.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(f"{found}.copies")))).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and a digest of what they decode to. Null and empty texts have no ids."""
    coded = encode(docs, decoded="decoded")
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("secret scan", secret_scan),
    ("mixing", mixing),
    ("encoding", tokens),
]

#: Quality measures, near duplicates and BPE have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
