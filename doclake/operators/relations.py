"""Small relational building blocks shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row of every key in the given order.

    Spark prunes a ``row_number() <= 1`` window before the shuffle (WindowGroupLimit), so each task sends one row per
    key and a key that holds a third of the table costs one row per task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= 1).drop("_rank")


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Existing rows without a newer version, plus the incoming rows (already one per key).

    ``keep`` names columns whose existing value survives. Untouched rows pass through an anti-join, which AQE turns
    into a broadcast when the batch is small, so they are not shuffled.
    """
    fresh = incoming
    if keep:
        old = existing.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in keep])
        fresh = fresh.join(old, keys, "left")
        for c in keep:
            fresh = fresh.withColumn(c, F.coalesce(f"_old_{c}", c))
    untouched = existing.join(incoming.select(*keys), keys, "left_anti")
    return untouched.select(*existing.columns).unionByName(fresh.select(*existing.columns))


def with_ids(spark_df: DataFrame, ids, name: str) -> DataFrame:
    """Rows whose ``name`` is among ``ids``: a list becomes a pushed-down filter, a frame a semi-join."""
    if isinstance(ids, DataFrame):
        return spark_df.join(ids.select(F.col(ids.columns[0]).alias(name)), name, "left_semi")
    return spark_df.where(F.col(name).isin(list(ids)))
