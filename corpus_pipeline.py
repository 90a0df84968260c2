"""A corpus from raw documents: language, near copies, personal data, packing.

Each stage is written as Parquet and read again as the next one's documents. All but the last return
the columns of their documents.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clientela.llm import jaccard_join, language, packing, pii
from clientela.llm.queries import WORD_VOCABULARY
from clientela.llm.tables import stored
from clientela.operators.joins import join_unique

#: Units and words whose ids a worker keeps. The same workers run all stages, and hold what each of them has kept.
KEPT_UNITS = 50_000
KEPT_WORDS = 100_000


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language can't be told (null, empty or without a letter); a missing ``lang`` becomes the predicted one."""
    model = language.train(docs)
    if model is None:  # no label to learn from: a letter is all that can be asked for
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return language.keep_determined(docs, model, fill_column="lang")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies, the row with the smallest id stays, then hash of its text; of repeated rows, one.

    Rows are decided one by one: where an id has several texts, a copy goes and the others stay. Rows without
    an id take no part, and stay.
    """
    row = next(name for name in itertools.accumulate(itertools.repeat("_"), initial="_row") if name not in docs.columns)
    known = docs.where("doc_id IS NOT NULL").withColumn(row, F.xxhash64("doc_id", "text"))
    found = jaccard_join.jaccard_components(known, id_column=row).select(F.col("doc_id").alias(row), "component_id").distinct()
    placed = join_unique(known.select(row, "doc_id"), found, [row])
    first = placed.groupBy("component_id").agg(F.min(F.struct("doc_id", row)).alias("first")).select(f"first.{row}")
    kept = join_unique(known, first, [row], "left_semi").drop(row).dropDuplicates(["doc_id", "text"])
    return kept.select(docs.columns).unionByName(docs.where("doc_id IS NULL"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind; ``n_chars`` follows the text."""
    masked = pii.mask_personal_data(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of a power of two of token ids, each a sequence of its own."""
    return packing.pack_documents(docs, WORD_VOCABULARY, kept_units=KEPT_UNITS, kept_words=KEPT_WORDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_known_languages),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("pii", mask_personal_data),
    ("packing", pack),
]

#: Training and tokenization have no SQL form; tests/llm holds the run against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
