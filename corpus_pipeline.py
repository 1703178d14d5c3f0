"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.langid import keep_identified, not_held_out, train_languages
from kinfold.llm.line_dedup import dedup_lines
from kinfold.llm.mixing import mix_sources, training_order, with_row_key
from kinfold.llm.packing import pack_documents
from kinfold.llm.setsketch import near_duplicates
from kinfold.plans.staging import scratch, stage, stage_path, staged, unstage

#: Documents are near-duplicates if they share 80 of 100 shingles of five words.
PERCENT = 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; others, and those without a letter, go.

    Where ``lang`` is null it becomes the language found.
    """
    names, params = train_languages(not_held_out(docs))
    return keep_identified(docs, names, params)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the long lines that five or more of them share."""
    out = dedup_lines(docs, min_chars=40, min_docs=5).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def _one_row_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each repeated id, the same in every run; null ids are no repeats."""
    repeated = stage(
        docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated"
    )
    if repeated.isEmpty():
        return docs
    # rows are chosen in the tasks first, so a hot id isn't gathered
    chosen = (
        docs.join(repeated, "doc_id", "left_semi").groupBy("doc_id")
        .agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("__one"))
        .select("__one.*")
    )
    return stage(docs.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(chosen), "single")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near-duplicates, and all documents like no other.

    Of the rows that repeat an id one stays; rows with a null id all stay.
    """
    docs = _one_row_each(docs)
    copies = near_duplicates(docs, percent=PERCENT).where("NOT kept").select("doc_id")
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source mixture takes them, in training order."""
    keyed, key = with_row_key(docs)
    return training_order(keyed, mix_sources(keyed, row_col=key), row_col=key)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document and the place it has in a sequence of 2048 tokens."""
    return pack_documents(docs, capacity=2048)


STAGES = [
    ("language id", identify_language),
    ("line dedup", drop_shared_lines),
    ("near-duplicates", drop_near_duplicates),
    ("mixing", mix),
    ("packing", pack),
]

#: The network of the first stage has no form in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of the documents in ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        with scratch(spark):  # what a stage has staged for itself goes when its result is written
            after = step(spark, docs, sf_dir)
            kept = stage_path(spark, name.replace(" ", "-"), keep=True)
            after.write.parquet(kept)
        unstage(docs)
        docs = staged(spark, kept, after.schema)
    return STAGES[-1][1](spark, docs, sf_dir)
