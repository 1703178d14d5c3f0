"""Learned search radii, their tuning, and audits of what they miss.

Calibration rows are (qid, nearest_pivot_dist, kth_dist), one a query.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions.metrics import Metric
from kinfold.operators.pivots import pivot_table
from kinfold.plans.pruned import knn_approx, knn_indexed, query_cells, ring_holds
from kinfold.plans.staging import stage


def nearest_pivot(queries: DataFrame, pivots: DataFrame, metric: str | Metric = "l2") -> DataFrame:
    """(qid, nearest_pivot_dist)."""
    table = pivot_table(queries.select("qid", F.col("qobj").alias("obj")), pivots, metric)
    return table.select("qid", F.array_min("pdists").alias("nearest_pivot_dist"))


def calibration(data: DataFrame, pivots: DataFrame, queries: DataFrame, k: int, metric: str | Metric = "l2", exclude_self: bool = False) -> DataFrame:
    """(qid, nearest_pivot_dist, kth_dist), staged, from exact lists, for queries with k neighbours."""
    kth = knn_indexed(data, queries, k, metric, exclude_self).where(F.col("rank") == k)
    return stage(nearest_pivot(queries, pivots, metric).join(kth.select("qid", F.col("dist").alias("kth_dist")), "qid"), "calibration")


def fit_radius(calib: DataFrame) -> DataFrame:
    """One row (slope, intercept, scale, worst): a line through the k-th distances and its residuals.

    ``scale`` is the residuals' root mean square, ``worst`` the largest.
    """
    line = calib.agg(
        F.regr_slope("kth_dist", "nearest_pivot_dist").alias("slope"),
        F.regr_intercept("kth_dist", "nearest_pivot_dist").alias("intercept"),
    )
    residual = F.col("kth_dist") - (F.col("intercept") + F.col("slope") * F.col("nearest_pivot_dist"))
    return (
        calib.crossJoin(F.broadcast(line))  # one row
        .withColumn("residual", residual).groupBy("slope", "intercept")
        .agg(F.sqrt(F.avg(F.col("residual") * F.col("residual"))).alias("scale"), F.max("residual").alias("worst"))
    )


def predict_radius(nearest: DataFrame, model: DataFrame, scales: float) -> DataFrame:
    """(qid, radius): the line plus ``scales`` times the residuals' scale, 0 at least."""
    r = F.col("intercept") + F.col("slope") * F.col("nearest_pivot_dist") + F.lit(scales) * F.col("scale")
    return nearest.crossJoin(F.broadcast(model)).select("qid", F.greatest(r, F.lit(0.0)).alias("radius"))


@dataclass
class RadiusModel:
    """A perceptron over buckets of radii: its pipeline, the upper end of each bucket, and the margin that calibration adds."""

    pipeline: PipelineModel
    tops: list[float]
    margin: float


def pivot_features(queries: DataFrame, pivots: DataFrame, metric: str | Metric = "l2") -> DataFrame:
    """(qid, pdists): the distances to all pivots."""
    table = pivot_table(queries.select("qid", F.col("qobj").alias("obj")), pivots, metric)
    return table.select("qid", "pdists")


def _bucket_tops(rows: DataFrame, model: PipelineModel, tops: list[float]) -> DataFrame:
    """``rows`` with the upper end of the bucket that the model tells."""
    told = model.transform(rows.withColumn("features", array_to_vector("pdists")))
    return told.withColumn("told", F.get(F.array(*[F.lit(t) for t in tops]), F.col("prediction").cast("int"))).select(*rows.columns, "told")


def fit_radius_ml(calib: DataFrame, share: float = 0.95, buckets: int = 8, hidden: int = 16, rounds: int = 60, seed: int = 7) -> RadiusModel:
    """A model from (qid, pdists, kth_dist), whose radii hold the k-th neighbour of ``share`` of the queries or more.

    One half of the rows, by a hash of their ids, teaches a multilayer perceptron the
    bucket of the k-th distance.  By how much the other half's distances exceed what
    it tells gives the margin (split conformal calibration): its ceil((n + 1) share)-th
    smallest excess, so a further query from the same source is covered with that
    probability.  With too few rows for such a promise the margin is infinite, and
    a search reads everything.
    """
    half = F.pmod(F.xxhash64("qid"), F.lit(2))
    taught, held = calib.where(half == 0), calib.where(half == 1)
    if taught.isEmpty():
        return RadiusModel(None, [], float("inf"))
    steps = [(i + 1) / buckets for i in range(buckets)]
    found = taught.agg(F.percentile("kth_dist", F.array(*[F.lit(x) for x in steps])).alias("tops"), F.max(F.size("pdists")).alias("m")).first()
    tops = sorted(set(found["tops"]))
    label = sum(((F.col("kth_dist") > t).cast("double") for t in tops[:-1]), F.lit(0.0))
    layers = [found["m"], hidden, max(2, len(tops))]
    steps = [
        StandardScaler(inputCol="features", outputCol="scaled", withMean=True),
        MultilayerPerceptronClassifier(featuresCol="scaled", labelCol="label", layers=layers, maxIter=rounds, seed=seed),
    ]
    model = Pipeline(stages=steps).fit(taught.withColumn("features", array_to_vector("pdists")).withColumn("label", label))
    tops += [tops[-1]] * (layers[-1] - len(tops))
    excess = stage(_bucket_tops(held, model, tops).select((F.col("kth_dist") - F.col("told")).alias("excess")), "excess")
    n = excess.count()
    rank = math.ceil((n + 1) * share)
    margin = excess.orderBy("excess").offset(rank - 1).limit(1).first()["excess"] if rank <= n else float("inf")
    return RadiusModel(model, tops, margin)


def predict_radius_ml(features: DataFrame, model: RadiusModel) -> DataFrame:
    """(qid, radius) from (qid, pdists) by a model of fit_radius_ml()."""
    if math.isinf(model.margin):
        return features.select("qid", F.lit(float("inf")).alias("radius"))
    return _bucket_tops(features, model.pipeline, model.tops).select("qid", F.greatest(F.col("told") + model.margin, F.lit(0.0)).alias("radius"))


def tune_radius(calib: DataFrame, model: DataFrame, grid: list[float], cells: DataFrame, queries: DataFrame, metric: str | Metric = "l2") -> DataFrame:
    """(scales, queries, coverage, mean_candidates) for every number of scales in ``grid``.

    Coverage: share of queries whose k-th distance is within the radius.
    Candidates: objects in cells whose ring the radius touches.
    """
    tried = calib.select("qid", "nearest_pivot_dist", "kth_dist").crossJoin(F.broadcast(model))  # one row
    r = lambda g: F.greatest(F.col("intercept") + F.col("slope") * F.col("nearest_pivot_dist") + F.lit(float(g)) * F.col("scale"), F.lit(0.0))
    tried = tried.select("qid", "kth_dist", *[r(g).alias(f"r{i}") for i, g in enumerate(grid)])
    # a query and a cell meet once for the whole grid
    own = ["kth_dist", *[f"r{i}" for i in range(len(grid))]]
    sums = [F.sum(F.when(ring_holds(F.col(f"r{i}")), F.col("cnt")).otherwise(0)).alias(f"c{i}") for i in range(len(grid))]
    per_query = query_cells(cells, queries.join(tried, "qid"), metric, *own).groupBy("qid", *own).agg(*sums)
    each = [
        F.struct(F.lit(float(g)).alias("scales"), (F.col("kth_dist") <= F.col(f"r{i}")).cast("int").alias("covered"), F.col(f"c{i}").alias("candidates"))
        for i, g in enumerate(grid)
    ]
    met = per_query.select(F.inline(F.array(*each)))
    return met.groupBy("scales").agg(
        F.count("*").alias("queries"), F.avg("covered").alias("coverage"), F.avg("candidates").alias("mean_candidates")
    )


def recall_by_scale(
    assigned: DataFrame, cells: DataFrame, queries: DataFrame, nearest: DataFrame, model: DataFrame, grid: list[float],
    exact: DataFrame, k: int, metric: str | Metric = "l2", exclude_self: bool = False,
) -> DataFrame:
    """(scales, queries, recall): the mean recall of the search with the radius of each number of scales in ``grid``."""
    exact, out = stage(exact, "exact"), None
    for scales in grid:
        approx = knn_approx(assigned, cells, queries, predict_radius(nearest, model, scales), k, metric, exclude_self)
        part = recall_at_k(approx, exact).agg(
            F.lit(float(scales)).alias("scales"), F.count("*").alias("queries"), F.avg("recall").alias("recall")
        )
        out = part if out is None else out.unionByName(part)
    return out


def recall_at_k(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """(qid, wanted, found, recall) against an exact result; one of knn_exact() owes nothing to the search that is audited."""
    hit = approx.select("qid", "id", F.lit(1).alias("hit"))
    return (
        exact.join(hit, ["qid", "id"], "left").groupBy("qid")
        .agg(F.count("*").alias("wanted"), F.count("hit").alias("found"))
        .withColumn("recall", F.col("found") / F.col("wanted"))
    )


def prune_violations(exact: DataFrame, kept: DataFrame) -> DataFrame:
    """(qid, id, rank, dist) of true neighbours that the kept candidates (qid, id) lack."""
    return exact.join(kept.select("qid", "id").distinct(), ["qid", "id"], "left_anti").select("qid", "id", "rank", "dist")
