"""A training corpus from ``documents``: quality, language, near copies, benchmark passages, token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but the last hand on the columns of
``documents``. ``run`` writes each stage's rows to the shared folder and reads them again, so that a lost executor never costs more
than the stage it was in.

Defined cases, for every stage: null and empty texts fail the base rules of the first stage (a stage that gets one all the same drops it
where it asks for a language, and keeps it otherwise: alone, uncontaminated, without ids); very long texts are read whole, in pieces; null
languages are a stratum of their own and become the predicted language; rows with a null id are rows like any other; of rows that repeat an id
and a text one stays, of copies under several ids the smallest; ties are decided by id, then hash of the text, then hash of the row; an
empty table stays empty; further columns are handed on unchanged, whatever their names (they travel in one struct).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm import decontaminate, jaccard_join, language_id, piece_codec, quality
from emberlog.llm.runtime import materialize, ship, tokenizer_path

#: A document stays if its language is told with at least this probability.
SURE = 0.5
#: Documents are near copies if their sets of so many words in a row are alike to this percentage.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the base rules or a certified level reject."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or without a clear language; a null language becomes the predicted one."""
    ship(spark)
    net = language_id.fit(docs, F.lit(True))
    # the columns of docs travel in one struct, so none of their names can clash
    told = language_id.predict(docs.select(F.struct(*docs.columns).alias("_doc")), net, text="_doc.text", keep=["_doc"])
    kept = told.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= SURE))
    return kept.select(*[F.coalesce("_doc.lang", "lang_pred").alias("lang") if c == "lang" else F.col("_doc")[c].alias(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of linked documents."""
    ship(spark)
    return jaccard_join.one_of_each(docs, k=NEAR_WORDS, percent=NEAR_PERCENT)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a benchmark item occurs."""
    ship(spark)
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and checks of every document that is left."""
    ship(spark)
    return piece_codec.encode_documents(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("language_id", language),
    ("ngram_jaccard_join", near_copies),
    ("benchmark_decontamination", benchmark_passages),
    ("sentencepiece", token_ids),
]

#: The language model and the tokenizer cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
