from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from doclake.operators import ledger as L
from doclake.streaming.ledger import compact_events, fold_batch, ledger_stream, read_state

START = datetime(2024, 1, 1)
KINDS = ["fetch", "fetch", "clean", "chunk", "chunk", "store"]


@pytest.fixture(scope="module")
def events(spark):
    rows = []
    for i in range(240):
        # Job "hot" holds most of the events; several events share a time.
        job = "hot" if i % 4 else f"j{i % 7}"
        status = {0: "completed", 5: "failed"}.get(i % 11, None if i % 3 else "processing")
        rows.append((f"{i:04d}", job, status, i / 240 if i % 2 else None, START + timedelta(minutes=(i // 2) * 7), KINDS[(i // 3) % 6]))
    return spark.createDataFrame(rows, "event_id string, job_id string, status string, progress double, ts timestamp, phase string")


def by_job(events):
    rows = sorted(events.collect(), key=lambda r: (r["ts"], r["event_id"]))
    jobs = {}
    for r in rows:
        jobs.setdefault(r["job_id"], []).append(r)
    return jobs


def test_fold(events):
    got = {r["job_id"]: r for r in L.job_state(events).collect()}
    for job, rows in by_job(events).items():
        last = lambda f, rows=rows: next((r[f] for r in reversed(rows) if r[f] is not None), None)
        ends = [r["ts"] for r in rows if r["status"] in L.FINAL]
        assert (got[job]["status"], got[job]["progress"]) == (last("status"), last("progress"))
        assert got[job]["completed_at"] == (max(ends) if ends else None)
        assert (got[job]["started_at"], got[job]["updated_at"]) == (rows[0]["ts"], rows[-1]["ts"])


@pytest.mark.parametrize("parts", [1, 7, 60])
def test_progress_across_ranges(events, parts):
    got = {r["event_id"]: r for r in L.running_count(events, "job_id", parts).collect()}
    for rows in by_job(events).values():
        for n, r in enumerate(rows, 1):
            assert (got[r["event_id"]]["done"], got[r["event_id"]]["total"]) == (n, len(rows))
    assert {round(r["progress"], 9) for r in L.progress(events, stage="storing", parts=parts).collect()} <= {
        round(0.8 + 0.2 * n / len(rows), 9) for rows in by_job(events).values() for n in range(1, len(rows) + 1)
    }


@pytest.mark.parametrize("parts", [1, 7, 60])
def test_phases_across_ranges(events, parts):
    got = {r["event_id"]: r for r in L.phase_timeline(events, parts=parts).collect()}
    want = {}
    for rows in by_job(events).values():
        starts = [r for p, r in zip([None, *rows], rows) if p is None or p["phase"] != r["phase"]]
        for r, following in zip(starts, [*starts[1:], None]):
            want[r["event_id"]] = (r["phase"], following["ts"] if following else None)
    assert {k: (r["phase"], r["ended_at"]) for k, r in got.items()} == want


def test_one_job_in_one_minute_is_cut(spark):
    hot = F.when(F.col("id") % 3 == 0, None).otherwise("hot")
    phase = F.format_string("p%s", F.floor(F.col("id") / 700) % 2)
    df = spark.range(9000).select(
        F.format_string("%06d", "id").alias("event_id"), hot.alias("job_id"), F.lit(START).alias("ts"), phase.alias("phase")
    )
    sizes = [r["count"] for r in L.ranged(df, "job_id", 9).groupBy("_part").count().collect()]
    assert len(sizes) == 9 and max(sizes) < 2000
    done = [r for r in L.running_count(df, "job_id", 9).orderBy("event_id").collect()]
    assert [r["done"] for r in done if r["job_id"] == "hot"] == list(range(1, 6001))
    assert [r["done"] for r in done if r["job_id"] is None] == list(range(1, 3001))
    assert L.phase_timeline(df, parts=9).where("job_id = 'hot'").count() == 13


def test_retention(spark):
    rows = [("a", "completed", START), ("b", "failed", START + timedelta(days=9)), ("c", "processing", None), ("d", None, None)]
    state = spark.createDataFrame(rows, "job_id string, status string, completed_at timestamp")
    now = START + timedelta(days=10)
    assert {r["job_id"] for r in L.purge_jobs(state, now).collect()} == {"b", "c", "d"}
    assert L.purged_count(state, now).first()["deleted"] == 1


def test_compaction_keeps_the_state(events):
    small = compact_events(events)
    assert small.count() < events.count() / 2
    assert sorted(map(tuple, L.job_state(small).collect())) == sorted(map(tuple, L.job_state(events).collect()))


def test_late_and_repeated_batches(spark, events, tmp_path):
    path = str(tmp_path / "state")
    late = events.where(F.col("event_id") < "0100")
    rest = events.where(F.col("event_id") >= "0100")
    for batch in (rest, late, late, rest):
        fold_batch(spark, batch, path, 3)
    assert sorted(map(tuple, read_state(spark, path).collect())) == sorted(map(tuple, L.job_state(events).collect()))


def test_stream_equals_batch(spark, events, tmp_path):
    twice = events.repartition(3).select(F.explode(F.array_repeat(F.struct("*"), 2)).alias("e")).select("e.*")
    twice.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = ledger_stream(spark, source, str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination()
    got = read_state(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, L.job_state(events).collect()))
