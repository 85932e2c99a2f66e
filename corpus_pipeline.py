"""From raw documents to packed sequences: quality rules, near-dedup, secret redaction, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last keep the columns of documents; each stage's
result is written and read again before the next, so that a lost executor costs at most one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgate.llm.minhash import near_duplicates
from sparkgate.llm.mixing import mixed_documents
from sparkgate.llm.packing import pack
from sparkgate.llm.quality import quality_rules
from sparkgate.llm.secrets import redact
from sparkgate.session import drop_materialized, settled


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules(docs, labels).where("kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Rows that repeat an id with another text are documents of their own; of rows that repeat id and text one stays. Rows with a null id are in no
    group and stay. Texts are shuffled once here and once for their full sets, at any size.
    """
    text = F.when(F.col("text").isNull(), "-").otherwise(F.concat(F.lit(":"), "text"))
    keyed = docs.withColumn("_key", F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), text), 256))
    chosen = settled(lambda: near_duplicates(keyed, carried=("_key",)).where("chosen").select("_key"), spark, "chosen")
    one = keyed.where("doc_id is not null").join(chosen.hint("merge"), "_key", "left_semi").dropDuplicates(["_key"])
    return one.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Owner-specific live-looking credentials are masked in the texts; widely copied examples and clean texts stay as they are."""
    clean = redact(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks: none, one or two rows each."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenized pieces in windows of several lengths; a document taken twice is packed twice."""
    return pack(docs)


STAGES = [("quality rules", quality), ("near dedup", near_dedup), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]

#: Hash-bucketed log-ratios, tokenization and packing have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other. What a stage wrote on its way goes when its result is written, and that when the next one's is: the last stage's input is all that stays, as it is read with the result."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), spark, f"stage-{name.replace(' ', '-')}")
        if before is not None:
            drop_materialized(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
