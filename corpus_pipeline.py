"""A corpus pipeline of five stages, each an operator of weftline.llm.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all
but the last return the columns of docs.  ``run`` writes each stage as Parquet in the shared
folder and reads it again, so a lost executor costs at most the stage under way; what a stage
wrote on its way, and the result of the stage before, are removed once its own is written.

1. language: documents whose language cannot be told, or is none of those learned, go.
2. near_duplicates: of each class of documents linked by five-word shingles at a similarity
   of 0.8 or more, that with the smallest id stays.
3. decontaminate: documents with a passage of the benchmark go.
4. personal_data: personal data in texts is replaced by its kind, and n_chars follows.
5. mix: documents and copies that meet the target weights of the budget.

Null texts have no language and go in the first stage; null ids are kept by all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import decontaminate, jaccard, language, mixing, pii
from weftline.llm.spill import Scope, release, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_known(docs, language.train(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_affected(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("mix", mix_sources),
]

#: SQL expresses neither the learned stages nor the exact similarity join; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scope(spark) as made:
        for _, stage in STAGES:
            docs = table(stage(spark, docs, sf_dir))
            made.keep_last()
            release(spark)
    return docs
