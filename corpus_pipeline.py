"""From raw documents to packed training sequences: five stages, each on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.llm.common import materialize
from sondage.llm.decontaminate import drop_contaminated
from sondage.llm.near_dup import first_of_classes
from sondage.llm.packing import pack_documents
from sondage.llm.quality_model import classify
from sondage.llm.queries import _tokenizer
from sondage.llm.secret_scan import redact_secrets

MARK = "[SECRET]"


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal quality model selects. Null and empty texts are scored as texts without words; repeated rows are judged alike; other columns are kept, whatever their names."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, labels).filter("selected").select(*docs.columns)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each near-duplicate class; null ids come last. Rows with null or equal ids and different texts are documents of their own."""
    return first_of_classes(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages to speak of. Null and empty texts have none; repeated rows are judged each; other columns are kept."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark; n_chars, where there is one, is counted anew for these. Null texts stay null; repeated rows and other columns stay as they are."""
    clean = redact_secrets(docs, mark=MARK)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.when(F.col("text").contains(MARK), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens. Null texts are empty ones; repeated rows are packed each."""
    return pack_documents(docs, _tokenizer("word_bpe_49k.json")).drop("ids")


STAGES = [("quality_classifier", quality_classifier), ("minhash_near_dedup", minhash_near_dedup), ("benchmark_decontamination", benchmark_decontamination), ("secret_scans", secret_scans), ("best_fit_packing", best_fit_packing)]

#: SQL can neither fit a model nor tokenise; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
