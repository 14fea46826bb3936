"""A training corpus from documents: language, near duplicates, personal data, mixture, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import langid, mixing, packing, pii, simhash
from millrace.llm.common import drop_stored, stored, stored_so_far


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; lang becomes that language.

    Null, empty and letterless texts and rows of no clear language go; repeats stay; any columns stay.
    """
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word-shingle similarity 0.8 or more, the one of smallest doc_id.

    Null and empty texts are one group of equal texts; a null doc_id stays only where its group has no
    other; of rows alike in doc_id and text one stays; columns are unchanged.
    """
    return simhash.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and terms that disclose it replaced; n_chars follows the text.

    A null text stays null (n_chars null); repeated rows are changed alike; other columns are unchanged.
    """
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    A null source is a source of its own, a null text has size 0; repeated rows are taken one by one.
    """
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The batch and place of every document, repeats and null ids included; null texts have length 0."""
    return packing.pack(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("packing", packed),
]

#: Learned language models and similarity groups aren't expressed in SQL; the tests hold run()
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again as the next one's input.

    What a stage left in the shared folder is deleted as soon as its result is written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    since = stored_so_far()
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs)
            drop_stored(spark, since, stored_so_far() - 1)
            since = stored_so_far() - 1
    return docs
