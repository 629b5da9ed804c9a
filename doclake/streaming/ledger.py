"""The job ledger over a stream of events.

State is kept as one row per job and field with the time it was last set. Folding is a maximum over (time, event), so
late events cannot set a job back and folding a batch twice changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from doclake.operators.ledger import FOLDED, job_state
from doclake.session import shared_dir

STATE_BUCKETS = 16


def _event_schema(events: DataFrame) -> list[str]:
    return [c for c in ("job_id", "event_id", "ts", *FOLDED) if c in events.columns]


def compact_events(events: DataFrame) -> DataFrame:
    """The few events of each job that still matter: the last that set each field, the first, the last, the last end.

    Folding these gives the same state as folding all events.
    """
    cols = _event_schema(events)
    order = F.struct("ts", "event_id")
    whole = F.struct(*[F.col(c) for c in cols])
    last = [F.max_by(whole, F.when(F.col(f).isNotNull(), order)) for f in FOLDED if f in cols]
    ended = F.max_by(whole, F.when(F.col("status").isin("completed", "failed"), order))
    ends = [F.min_by(whole, order), F.max_by(whole, order), ended]
    kept = events.groupBy("job_id").agg(F.array_distinct(F.array(*last, *ends)).alias("_kept"))
    rows = kept.select(F.explode("_kept").alias("_e")).where(F.col("_e").isNotNull())
    return rows.select("_e.*")


def _bucket(df: DataFrame, buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64("job_id"), F.lit(buckets)).cast("int"))


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """Job states from the stored events."""
    return job_state(spark.read.parquet(path).drop("bucket"))


def fold_batch(spark: SparkSession, batch: DataFrame, path: str, buckets: int = STATE_BUCKETS) -> None:
    """Fold a batch into the stored events; only the buckets of the batch's jobs are rewritten."""
    cols = _event_schema(batch)
    fresh = _bucket(batch.select(*cols), buckets)
    touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]
    if not touched:
        return
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        stored = spark.read.parquet(path).where(F.col("bucket").isin(touched))
        fresh = fresh.unionByName(stored.select(*fresh.columns))
    folded = _bucket(compact_events(fresh), buckets)
    # Dynamic overwrite stages the new partitions and replaces the old ones only when the whole job has succeeded.
    folded.hint("rebalance", F.col("bucket")).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("bucket").parquet(path)


def ledger_stream(
    spark: SparkSession,
    events: DataFrame,
    path: str,
    checkpoint: str | None = None,
    once: bool = True,
    interval: str = "10 seconds",
    buckets: int = STATE_BUCKETS,
) -> StreamingQuery:
    """Fold a stream of events (job_id, event_id, ts timestamp, ...) into ``path``.

    Late and repeated events need no bound: folding an event again, or after newer ones, gives the same state.
    """
    writer = events.writeStream.foreachBatch(lambda batch, _: fold_batch(spark, batch, path, buckets)).option(
        "checkpointLocation", checkpoint or shared_dir(spark, "ledger-stream")
    )
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()
