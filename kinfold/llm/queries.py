"""The registered queries of the training-data operators."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.ann import nearest_neighbours
from kinfold.llm.cluster import cluster_vectors
from kinfold.llm.decontaminate import decontaminate
from kinfold.llm.langid import language_labels
from kinfold.llm.line_dedup import dedup_lines
from kinfold.llm.lm import backoff_scores
from kinfold.llm.media import media_columns
from kinfold.llm.mixing import mix_sources
from kinfold.llm.packing import pack_documents
from kinfold.llm.quality import quality_scores
from kinfold.llm.repair import damaged, repair_conversations, turn_digests
from kinfold.llm.setsketch import near_duplicates
from kinfold.llm.sharding import shard_by_bytes
from kinfold.plans.staging import stage


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), capacity=2048)


def op3_graph_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest_neighbours(vectors, F.col("vec_id") % 100 == 0, k=10)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        F.col("mix_taken").alias("taken"),
        F.col("mix_position").alias("position"),
    ).orderBy("position", "doc_id")


def op5_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op6_shard_by_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = shard_by_bytes(_table(spark, sf_dir, "documents"), n_shards=8)
    return sharded.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_labels(_table(spark, sf_dir, "documents"))


def op8_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = backoff_scores(_table(spark, sf_dir, "documents"))
    # sums in another order differ in the last digits
    return scored.withColumns({"log_score": F.round("log_score", 4), "mean_log_score": F.round("mean_log_score", 6)})


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(_table(spark, sf_dir, "documents")).drop("digest")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, min_chars=40, min_docs=5).select(
        "doc_id",
        F.col("line_total").alias("n_lines"),
        F.col("line_dropped").alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op12_bisector_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, centroids = cluster_vectors(_table(spark, sf_dir, "embeddings"), k=8, rounds=10, width=64, scale=1024, seed=3)
    placed = stage(placed.withColumnRenamed("id", "vec_id"), "clusters")
    sums = placed.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"), F.count("*").alias("n"), F.count("distance").alias("known")
    )
    rows = {r["cluster"]: r for r in sums.collect()}  # one a centroid
    total = lambda own: sum(int(r["total"]) for r in own) if all(r["n"] == r["known"] for r in own) else None
    fits = lambda v: v if v is not None and v < 2**63 else None
    every = fits(total(rows.values()))
    found = [
        (c, fits(total([rows[c]])), every, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c in rows
    ]
    table = spark.createDataFrame(found, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(table), "cluster").select(  # a row a centroid
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def op13_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, times = damaged(_table(spark, sf_dir, "conversations"))
    found, repaired = repair_conversations(turns, times=times)
    digests = turn_digests(repaired).withColumnRenamed("conv", "own")
    return found.join(digests, F.col("conv").eqNullSafe(F.col("own")), "left").select(
        F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


QUERIES = {
    "op1_quality": op1_quality,
    "op2_pack": op2_pack,
    "op3_graph_ann": op3_graph_ann,
    "op4_mix_sources": op4_mix_sources,
    "op5_setsketch_dedup": op5_setsketch_dedup,
    "op6_shard_by_bytes": op6_shard_by_bytes,
    "op7_language_id": op7_language_id,
    "op8_stupid_backoff": op8_stupid_backoff,
    "op9_media_columns": op9_media_columns,
    "op10_line_dedup": op10_line_dedup,
    "op11_decontaminate": op11_decontaminate,
    "op12_bisector_clusters": op12_bisector_clusters,
    "op13_repair_conversations": op13_repair_conversations,
}
