"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

language: documents whose language is rejected go. lines: repeated passages go from the texts, and documents
that are nothing else. near_duplicates: one document of each group stays, that of the least doc_id. personal_data:
spans are replaced by their kinds. packing: the texts' tokens in sequences, a row a piece.

Every stage but the last returns the columns of its input, in their order. Null texts have no letter, so the first stage
drops them; an empty table passes through every stage as an empty table; extra columns, whatever their names, pass through all stages but
the last. Rows of equal doc_id and text become one in near_duplicates. Ties: of documents that are near one another the least doc_id stays.
Very long texts are rows like others in every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.lineage import given, release, scratch, trim_if_due
from tidemark.llm.bpe import default_vocabulary
from tidemark.llm.common import documents
from tidemark.llm.langid import accept, train
from tidemark.llm.linededup import dedup_lines
from tidemark.llm.minhash import keep_first
from tidemark.llm.packing import pack_documents
from tidemark.llm.pii import redact

#: Near duplicates have this percentage of their five-word runs in common.
PERCENT = 80


def fresh(name: str, taken: list[str]) -> str:
    """``name``, made longer until no column has it."""
    while name in taken:
        name += "_"
    return name


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return accept(docs, train(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    trim_if_due(spark)  # the stages before and after this one do so whenever they cut lineage
    counted, removed = (fresh(name, docs.columns) for name in ("n_lines", "n_removed"))
    found = dedup_lines(docs, counted, removed).where((F.col(removed) == 0) | (F.trim("text") != ""))
    n_chars = F.when(F.col(removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", n_chars).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_first(docs, PERCENT)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    trim_if_due(spark)
    return pack_documents(docs, default_vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: Trained models and tokenizers are beyond SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, by way of tables in the shared folder, of which only the last one is left."""
    docs, since = documents(spark, sf_dir), given()
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        release(spark, since, but=(path,))  # what the stages before have written
    return STAGES[-1][1](spark, docs, sf_dir)
