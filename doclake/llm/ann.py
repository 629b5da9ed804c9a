"""Approximate nearest neighbours with randomly rotated one-bit codes.

Each vector, less the mean of all, is rotated at random and kept as the signs of its components, packed into bits, with three
scalars: its distance from the mean, the inner product of code and vector that corrects the estimate, and its inner product
with the mean. A query is rotated likewise and rounded to QUERY_BITS bits per component, so that an inner product with a
code is a few population counts. The estimate comes with an error bound; only vectors whose upper bound reaches the running
20th best exact score are compared exactly, in double precision, on the original vectors.

Queries are a stated set, searched against all vectors in blocks: vectors are dealt over tasks by hash, each query block is
sent to each group of vectors once, and a task answers one block against one group. It returns the best ``k`` of the group
for each query, which a top-k per query merges.

Vectors that are NULL, empty, all zero, or hold NULL or non-finite components take no part, nor do rows without an id. Only
vectors with equally many components are compared. Ties go to the smaller id. Rows that repeat an id are candidates each,
never for a query with that id. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doclake.llm.common import stored

#: Width of the error bound in standard deviations of the estimate.
EPSILON = 1.9
#: Bits per component of a rounded query.
QUERY_BITS = 6
#: Queries in a block, vectors in a group, and vectors estimated at a time inside a task.
QUERY_BLOCK, GROUP_ROWS, STEP = 1024, 16384, 2048
SEED = 20240229

_INDEX = (
    "vec_id long, dim int, code binary, away double, fit double, with_mean double, vector array<double>, is_query boolean"
)
_FOUND = "query_id long, vec_id long, score double"


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def valid_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, dim and vector (array of doubles) of the rows that take part."""
    v = F.col("vector")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
        .where(F.col("vec_id").isNotNull() & v.isNotNull())
        .where(~bad & F.exists(v, lambda x: x != 0))
        .select("vec_id", F.size("vector").alias("dim"), "vector")
    )


def means(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Mean vector for each number of components; one row per number comes to the driver."""
    summed = vectors.select("dim", F.posexplode("vector").alias("at", "x")).groupBy("dim", "at").agg(F.avg("x").alias("m"))
    rows = summed.groupBy("dim").agg(F.array_sort(F.collect_list(F.struct("at", "m"))).alias("m")).collect()
    return {r["dim"]: np.array([x["m"] for x in r["m"]]) for r in rows}


def _encode(centres: dict[int, np.ndarray], query_of):
    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turned: dict[int, np.ndarray] = {}
        for frame in frames:
            for dim, part in frame.groupby("dim", sort=False):
                dim = int(dim)
                turn = turned.setdefault(dim, rotation(dim))
                x = np.stack(part["vector"].to_numpy())
                centre = centres[dim]
                rest = x - centre
                away = np.linalg.norm(rest, axis=1)
                unit = (rest / np.where(away > 0, away, 1)[:, None]) @ turn
                bits = np.zeros((len(x), -(-dim // 64) * 64), bool)
                bits[:, :dim] = unit >= 0
                fit = np.abs(unit).sum(axis=1) / np.sqrt(dim)
                yield pd.DataFrame(
                    {
                        "vec_id": part["vec_id"].to_numpy(),
                        "dim": np.int32(dim),
                        "code": [c.tobytes() for c in np.packbits(bits, axis=1, bitorder="little")],
                        "away": away,
                        "fit": np.where(fit > 0, fit, 1.0),
                        "with_mean": x @ centre,
                        "vector": list(x),
                        "is_query": query_of(part["vec_id"].to_numpy()),
                    }
                )

    return encode


def build_index(df: DataFrame, id_col: str, vector_col: str, query_of) -> DataFrame:
    """A row per vector: code, correction scalars, the vector, and whether ``query_of`` (ids to booleans) names it."""
    vectors = valid_vectors(df, id_col, vector_col)
    return stored(vectors.mapInPandas(_encode(means(vectors), query_of), _INDEX), "ann-index")


class Estimator:
    """Estimates and bounds of the inner products of queries with coded vectors."""

    def __init__(self, codes: np.ndarray, away, fit, with_mean, dim: int):
        self.codes, self.dim = codes, dim
        self.away, self.with_mean = away, with_mean
        self.scale = away / fit / np.sqrt(dim)
        # The code's part that is orthogonal to the vector meets the query at random.
        self.spread = away * np.sqrt(np.maximum(1 - fit * fit, 0)) / fit / np.sqrt(max(dim - 1, 1))
        self.ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)

    def upper(self, turned: np.ndarray, low: float, width: float, planes: np.ndarray, norm: float) -> tuple:
        """Estimates and error bounds for one query: ``turned`` was rounded to low + width * (bits of ``planes``)."""
        dot = np.zeros(len(self.codes), np.int64)
        for j, plane in enumerate(planes):
            dot += np.bitwise_count(self.codes & plane).sum(axis=1, dtype=np.int64) << j
        # Sum over components of sign * value = 2 * (sum where the bit is set) - sum of all values.
        signed = 2 * (low * self.ones + width * dot) - turned.sum()
        rounding = width * np.sqrt(self.dim / 12) * self.away / np.sqrt(self.dim)
        return self.with_mean + self.scale * signed, EPSILON * (self.spread * norm + rounding)


def _planes(values: np.ndarray, words: int) -> np.ndarray:
    """Bit planes of small integers, packed like the codes."""
    bits = np.zeros((QUERY_BITS, words * 64), bool)
    bits[:, : len(values)] = (values[None, :] >> np.arange(QUERY_BITS)[:, None]) & 1
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def exact(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision; equal vectors get equal values, wherever they stand."""
    return (vectors * query).sum(axis=1)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def search_group(data: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best ``k`` of a group of vectors for each query of a block."""
    if data.empty or queries.empty:
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": int, "vec_id": int})
    dim = int(data["dim"].iloc[0])
    words = -(-dim // 64)
    codes = np.frombuffer(b"".join(data["code"]), np.uint64).reshape(len(data), words)
    vectors, ids = np.stack(data["vector"].to_numpy()), data["vec_id"].to_numpy()
    scalars = [data[c].to_numpy() for c in ("away", "fit", "with_mean")]
    steps = [slice(a, a + STEP) for a in range(0, len(ids), STEP)]
    estimators = [Estimator(codes[s], *(x[s] for x in scalars), dim) for s in steps]
    turn = rotation(dim)
    out = []
    for query_id, query in zip(queries["vec_id"].to_numpy(), queries["vector"].to_numpy()):
        turned = query @ turn
        low, norm = turned.min(), np.linalg.norm(query)
        width = max((turned.max() - low) / (2**QUERY_BITS - 1), 1e-300)
        rounded = np.rint((turned - low) / width).astype(np.int64)
        planes = _planes(rounded, words)
        best_ids, best = np.zeros(0, np.int64), np.zeros(0)
        for step, estimator in zip(steps, estimators):
            estimate, error = estimator.upper(low + width * rounded, low, width, planes, norm)
            others = ids[step] != query_id
            if len(best) < k:
                first = np.argsort(-np.where(others, estimate, -np.inf))[: 2 * k]
                first = first[others[first]]
                sure = np.sort(exact(vectors[step][first], query))[::-1]
                floor = sure[k - 1] if len(sure) >= k else -np.inf
            else:
                floor = best[-1]
            near = np.flatnonzero(others & (estimate + error >= floor))
            near_ids = np.concatenate([best_ids, ids[step][near]])
            best_ids, best = _best(near_ids, np.concatenate([best, exact(vectors[step][near], query)]), k)
        out.append(pd.DataFrame({"query_id": query_id, "vec_id": best_ids, "score": best}))
    return pd.concat(out, ignore_index=True)


def nearest(df: DataFrame, query_of, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` vectors with the largest inner product for each query."""
    index = build_index(df, id_col, vector_col, query_of)
    counts = index.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("is_query").alias("q")).collect()
    if not counts:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    groups = max(1, -(-max(r["n"] for r in counts) // GROUP_ROWS))
    blocks = max(1, -(-max(r["q"] for r in counts) // QUERY_BLOCK))
    by_hash = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    data = index.select("*", by_hash(groups, 1).alias("g"), every(blocks, "b"))
    asked = index.where("is_query").select("vec_id", "dim", "vector", by_hash(blocks, 2).alias("b"), every(groups, "g"))
    key = ["dim", "g", "b"]
    found = (
        data.groupBy(*key)
        .cogroup(asked.groupBy(*key))
        .applyInPandas(lambda left, right: search_group(left, right, k), _FOUND)
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def by_twenty(ids: np.ndarray) -> np.ndarray:
    """The stated query set: ids divisible by 20."""
    return ids % 20 == 0
