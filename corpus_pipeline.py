"""A training corpus from the documents table: quality, near duplicates, personal data, mixture, sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. run() writes each stage to the shared folder and reads it again as the next one's docs. Stages are tested one by one against plain versions: tokenizers and the classifier can't be stated in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import jaccard, mixing, packing, pii, quality
from quillon.llm.common import cut_lineage, remove, table


def _with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier scores 0.7 or more."""
    model = quality.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return quality.accept(docs, model, 0.7)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group that shingles of five words link at a similarity of 0.8."""
    return jaccard.keep_one(docs, k=5, num=80, den=100)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    return _with_length(pii.scrub(docs))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as there are, dealt by the weights of domains, languages and sources; a document comes once an epoch that takes it."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", accept_quality),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("personal data", redact_personal_data),
    ("mixing to target weights", mix_to_weights),
    ("best-fit packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        docs = cut_lineage(out, name.replace(" ", "-"))
        remove(out)  # with what the stage read of the shared folder, the table before it included
    return docs
