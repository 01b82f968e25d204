"""A training-data pipeline over ``documents``; each stage applies one operator of ``tidemark.llm``.

Every stage reads all that its predecessor kept, as a stored table; what the predecessor pinned on its way is deleted first. The
first four return the columns of ``documents``, the last one row per encoded document. All stages take empty tables, null
columns, repeated rows and texts of any length as their operators do. Columns that a stage adds for itself have names of their own, which
begin with ``_pipeline``.
"""

from __future__ import annotations

import uuid
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.decontamination import contaminated
from tidemark.llm.language_id import UNKNOWN, fit, held_out, identify
from tidemark.llm.mixing import mix, mixed_rows
from tidemark.llm.near_dedup import near_duplicates, text_key
from tidemark.llm.token_files import stored_documents, write_token_files
from tidemark.session import Pins, pin, shared_folder

#: No SQL expresses learned languages, sketches and sub-word tokens; tests/llm compare the stages with direct loops.
ORACLE_SQL = None

_PINNED = Pins()


def stage(function):
    """A stage of the pipeline: deletes what the stage before pinned, as its result is stored by now, and owns what it pins itself."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _PINNED.clear(spark)
        with _PINNED:
            return function(spark, docs, sf_dir)

    return run_stage


@stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language was recognised; texts that are null or have no letter go."""
    model = fit(docs.where(~held_out()).select("text", "lang"))
    found = identify(docs.select(F.struct(*docs.columns).alias("_pipeline_doc"), "text"), model)
    # Where no row is labelled, nothing was learned and nothing can be rejected.
    return (found.where(F.col("lang_pred") != UNKNOWN) if model.languages else found).select("_pipeline_doc.*")


@stage
def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of copies and near copies: the one with the smallest id."""
    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("_pipeline_id"), F.col("text_key").alias("_pipeline_kept")).distinct()
    keyed = docs.withColumn("_pipeline_key", text_key(F.col("text")))
    mine = keyed.join(kept, F.col("doc_id").eqNullSafe(F.col("_pipeline_id")) & (F.col("_pipeline_key") == F.col("_pipeline_kept")), "left_semi")
    return mine.dropDuplicates(["doc_id", "_pipeline_key"]).drop("_pipeline_key")


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy or paraphrase of a benchmark item."""
    keyed = docs.withColumn("_pipeline_key", text_key(F.col("text")))
    found = contaminated(docs.select(F.struct("doc_id", text_key(F.col("text")).alias("k")).alias("doc"), "text"),
                         spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="doc")
    bad = found.where("contaminated").select(F.col("doc.doc_id").alias("_pipeline_id"), F.col("doc.k").alias("_pipeline_bad")).distinct()
    return keyed.join(bad, F.col("doc_id").eqNullSafe(F.col("_pipeline_id")) & (F.col("_pipeline_key") == F.col("_pipeline_bad")), "left_anti").drop("_pipeline_key")


@stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: documents as often as it takes them, in the order of the output shards."""
    return mixed_rows(mix(docs)).select("row.*")


@stage
def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, and what they hold per document."""
    import public_tokenizers  # needed by this stage alone

    path = f"{shared_folder(spark)}/tokens/{uuid.uuid4().hex}"
    return stored_documents(write_token_files(docs, path, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("language_id", language),
    ("near_dedup", near_duplicate),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_files", token_files),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES[:-1]:
        docs = pin(apply(spark, docs, sf_dir), name, keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
