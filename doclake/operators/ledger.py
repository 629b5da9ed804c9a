"""Ingest ledger: an append-only table of job events folded into job states, progress and phases.

Per-job windows are prefix scans over ranges of (job, time, event) with about equal numbers of rows, so a job that holds a
third of all events, or has all of them in one minute, is still many small sorts; values that cross a border come from a
summary with one row per job and range. Events without a time come first, those without a job form one.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from doclake.session import stored

FINAL = ("completed", "failed")
FOLDED = ("type", "context_id", "status", "progress", "metadata", "error_message", "result_data")
RETENTION_DAYS = 7


def _order() -> Column:
    return F.struct("ts", "event_id")


def job_state(events: DataFrame) -> DataFrame:
    """Latest state per job: the last non-NULL value of every field, first and last event time, completion time.

    A plain aggregation with partial results per task; ``max_by`` skips rows without an ordering value.
    """
    fields = [f for f in FOLDED if f in events.columns]
    last = [F.max_by(f, F.when(F.col(f).isNotNull(), _order())).alias(f) for f in fields]
    ended = F.when(F.col("status").isin(*FINAL), F.col("ts"))
    return events.groupBy("job_id").agg(
        *last,
        F.min("ts").alias("started_at"),
        F.max("ts").alias("updated_at"),
        F.max(ended).alias("completed_at"),
    )


def complete_jobs(events: DataFrame) -> DataFrame:
    """Completion events: failed with an error message, else completed; progress is 1."""
    failed = F.col("error_message").isNotNull() & (F.col("error_message") != "")
    return events.withColumn("status", F.when(failed, "failed").otherwise("completed")).withColumn("progress", F.lit(1.0))


def active_jobs(state: DataFrame, context_id: str | None = None) -> DataFrame:
    """Jobs that have not ended, newest first."""
    running = state.where(~F.col("status").isin(*FINAL))
    if context_id is not None:
        running = running.where(F.col("context_id") == context_id)
    return running.orderBy(F.desc("started_at"), "job_id")


def _expired(now: datetime | Column, days: int) -> Column:
    now = now if isinstance(now, Column) else F.lit(now)
    old = F.col("completed_at") < now - F.make_interval(days=F.lit(days))
    return F.coalesce(F.col("status").isin(*FINAL) & old, F.lit(False))


def purge_jobs(state: DataFrame, now: datetime | Column, days: int = RETENTION_DAYS) -> DataFrame:
    """Job states without those that ended more than ``days`` days before ``now``."""
    return state.where(~_expired(now, days))


def purged_count(state: DataFrame, now: datetime | Column, days: int = RETENTION_DAYS) -> DataFrame:
    return state.where(_expired(now, days)).agg(F.count("*").alias("deleted"))


def run_summary(results: DataFrame) -> DataFrame:
    """Totals over per-document results (status, chunks, snippets); the failures are ``failed_documents``."""
    ok = F.col("status") == "processed"
    return results.agg(
        F.count_if(ok).alias("documents_processed"),
        F.count_if(~ok).alias("documents_failed"),
        F.coalesce(F.sum(F.when(ok, F.col("chunks"))), F.lit(0)).alias("total_chunks"),
        F.coalesce(F.sum(F.when(ok, F.col("snippets"))), F.lit(0)).alias("total_code_snippets"),
    )


def failed_documents(results: DataFrame) -> DataFrame:
    return results.where(F.col("status") != "processed").select("url", "title", "error")


def ranged(df: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """``df`` cut into ranges of (key, time, event), numbered by ``_part``; by default as many as shuffle partitions.

    Written once, as summaries and rows have to see the same borders.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(parts, key, "ts", "event_id").withColumn("_part", F.spark_partition_id())
    return stored(cut, "ranges")


def _with_border(rows: DataFrame, borders: DataFrame, key: str) -> DataFrame:
    renamed = borders.withColumnsRenamed({key: "_key", "_part": "_in"})
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_in"))
    return rows.join(renamed, same).drop("_key", "_in")


def _inside(key: str) -> WindowSpec:
    return Window.partitionBy(key, "_part").orderBy("ts", "event_id")


def running_count(df: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """Adds ``done`` (position of the event within its key) and ``total`` (events of the key)."""
    cut = ranged(df, key, parts)
    sizes = cut.groupBy(key, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        key,
        "_part",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(key)).alias("total"),
    )
    counted = _with_border(cut.withColumn("_at", F.row_number().over(_inside(key))), offsets, key)
    return counted.withColumn("done", F.col("_before") + F.col("_at")).drop("_part", "_before", "_at")


def progress(events: DataFrame, key: str = "job_id", stage: str = "processing", parts: int | None = None) -> DataFrame:
    """Progress after each event: 0.1 to 0.8 while processing, 0.8 to 1.0 while storing."""
    base, span = {"processing": (0.1, 0.7), "storing": (0.8, 0.2)}[stage]
    counted = running_count(events, key, parts)
    return counted.withColumn("progress", F.lit(base) + F.lit(span) * F.col("done") / F.col("total"))


def previous_value(cut: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Adds to ``ranged`` rows the value of the previous event of the key (NULL for its first), across borders too."""
    last = cut.groupBy(key, "_part").agg(F.max_by(value, _order()).alias("_last"))
    border = last.select(key, "_part", F.lag("_last").over(Window.partitionBy(key).orderBy("_part")).alias("_border"))
    near = cut.withColumn("_at", F.row_number().over(_inside(key))).withColumn(name, F.lag(value).over(_inside(key)))
    joined = _with_border(near, border, key)
    return joined.withColumn(name, F.when(F.col("_at") == 1, F.col("_border")).otherwise(F.col(name))).drop("_at", "_border")


def next_time(cut: DataFrame, key: str, name: str) -> DataFrame:
    """Adds to ``ranged`` rows the time of the next event of the key (NULL for its last), across borders too."""
    first = cut.groupBy(key, "_part").agg(F.min("ts").alias("_first"))
    border = first.select(key, "_part", F.lead("_first").over(Window.partitionBy(key).orderBy("_part")).alias("_border"))
    joined = _with_border(cut.withColumn(name, F.lead("ts").over(_inside(key))), border, key)
    return joined.withColumn(name, F.coalesce(name, "_border")).drop("_border")


def phase_timeline(events: DataFrame, key: str = "job_id", phase: str = "phase", parts: int | None = None) -> DataFrame:
    """One row per stretch of equal phases: its phase, start, end (start of the next) and seconds elapsed."""
    cut = ranged(events.select(key, phase, "ts", "event_id"), key, parts)
    compared = previous_value(cut, key, phase, "_previous")
    starts = compared.where(F.col("_previous").isNull() | (F.col("_previous") != F.col(phase)))
    timed = next_time(starts.select(key, F.col(phase).alias("phase"), "ts", "event_id", "_part"), key, "ended_at")
    elapsed = (F.unix_micros(F.col("ended_at")) - F.unix_micros(F.col("ts"))) / 1_000_000
    return timed.select(
        key, "phase", F.col("ts").alias("started_at"), "ended_at", "event_id", elapsed.alias("elapsed_seconds")
    )


def current_phase(events: DataFrame, key: str = "job_id", phase: str = "phase") -> DataFrame:
    """Latest phase of every key, the number of events, and the seconds from its first to its last event."""
    elapsed = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1_000_000
    return events.groupBy(key).agg(
        F.max_by(phase, _order()).alias("phase"),
        F.count("*").alias("events"),
        elapsed.alias("elapsed_seconds"),
    )
