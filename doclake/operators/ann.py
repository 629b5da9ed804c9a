"""Approximate vector retrieval: k-means cells, of which the nearest few are read."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclake.operators.vector_search import LIMIT, MIN_SIMILARITY, vector_hits


def _usable(items: DataFrame, dim: int | None) -> DataFrame:
    """Rows with a non-zero vector of ``dim`` numbers, by default of the largest size that occurs."""
    if dim is None:
        dim = items.agg(F.max(F.size("embedding")).alias("d")).first()["d"]
    return items.where((F.size("embedding") == dim) & F.exists("embedding", lambda x: x != 0))


def train_cells(
    items: DataFrame, cells: int, seed: int = 7, iterations: int = 10, fraction: float = 1.0, dim: int | None = None
) -> KMeansModel:
    """Cell centres by cosine k-means. ``fraction`` below 1 trains on part of the vectors; all of them are indexed."""
    vectors = _usable(items, dim).select(array_to_vector("embedding").alias("features"))
    if fraction < 1.0:
        vectors = vectors.sample(fraction=fraction, seed=seed)
    return KMeans(k=cells, seed=seed, maxIter=iterations, distanceMeasure="cosine").fit(vectors)


def assign_cells(items: DataFrame, model: KMeansModel) -> DataFrame:
    """Every row with a usable vector and its ``cell``."""
    featured = _usable(items, len(model.clusterCenters()[0])).withColumn("features", array_to_vector("embedding"))
    return model.transform(featured).drop("features").withColumnRenamed("prediction", "cell")


def write_index(assigned: DataFrame, path: str) -> None:
    """Partitioned by cell; a crowded cell is spread over several files by the rebalance."""
    assigned.hint("rebalance", F.col("cell")).write.mode("overwrite").partitionBy("cell").parquet(path)


def build_ivf(items: DataFrame, path: str, cells: int, **training) -> KMeansModel:
    model = train_cells(items, cells, **training)
    write_index(assign_cells(items, model), path)
    return model


def nearest_cells(model: KMeansModel, query: Sequence[float], probes: int) -> list[int]:
    centres = np.asarray(model.clusterCenters(), dtype=np.float64)
    q = np.asarray(query, dtype=np.float64)
    norms = np.linalg.norm(centres, axis=1)
    scores = centres @ q / np.where(norms == 0, 1.0, norms)
    return [int(c) for c in np.argsort(-scores, kind="stable")[:probes]]


def ivf_search(
    index: DataFrame,
    model: KMeansModel,
    query: Sequence[float],
    probes: int,
    limit: int = LIMIT,
    min_similarity: float = MIN_SIMILARITY,
    id_col: str = "chunk_id",
) -> DataFrame:
    """Best rows of the nearest cells; the cell filter prunes partitions, so the other cells are not read."""
    chosen = index.where(F.col("cell").isin(nearest_cells(model, query, probes)))
    return vector_hits(chosen, query, limit, min_similarity, id_col)
