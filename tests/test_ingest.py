"""Incremental ingest: replayed batches, failures between two writes, and verification of touched jobs only."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from postledger.operators import incremental
from postledger.streaming import ingest
from postledger.streaming.ingest import JOB, LANDED, RECORD, Versions, run_batch

T = datetime(2026, 9, 1)
LAND = (
    "source_id long, external_ref string, payload string, fetched_at timestamp, title string, employer_name string, location_text string, workplace_text string, "
    "employment_text string, description string, url string, apply_url string"
)


@pytest.fixture(autouse=True)
def _few_parts(monkeypatch):
    monkeypatch.setattr(ingest, "BUCKETS", 3)


def _landed(spark, *rows):
    full = [(s, r, f"{s}{r}{title}", T + timedelta(hours=h), title, "Acme", "Toronto, ON", None, None, "Good work.", f"https://x.ca/{r}", None) for s, r, h, title in rows]
    return spark.createDataFrame(full, LAND)


def _sources(spark):
    return spark.createDataFrame([(1, True), (2, False)], "source_id long, owned boolean")


def _state(tables):
    out = {}
    for name, schema in (("records", RECORD), ("jobs", JOB), ("landed", LANDED)):
        out[name] = sorted(map(str, tables.read(name, schema).collect()))
    return out


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    tables = Versions(spark, str(tmp_path / "t"))
    one = _landed(spark, (1, "a", 0, "Nurse"), (1, "b", 0, "Plumber"), (2, "c", 0, "x"), (2, "d", 0, "Cook"))
    two = _landed(spark, (1, "a", 5, "Nurse"), (2, "e", 6, "Baker"), (2, "d", 7, "Head cook"), (2, "d", 6, "Cook"))
    run_batch(tables, one, 0, _sources(spark))
    run_batch(tables, two, 1, _sources(spark))
    state = _state(tables)
    got = {(r["source_id"], r["external_ref"]): r for r in tables.read("records", RECORD).collect()}
    assert set(got) == {(1, "a"), (1, "b"), (2, "d"), (2, "e")}  # "x" is too short a title
    assert got[1, "a"]["first_seen"] == T and got[1, "a"]["last_verified"] == T + timedelta(hours=5)
    assert got[2, "d"]["last_seen"] == T + timedelta(hours=7) and got[2, "d"]["last_verified"] is None
    assert tables.read("jobs", JOB).count() == 4 and tables.read("landed", LANDED).count() == 6
    run_batch(tables, two, 1, _sources(spark))
    run_batch(tables, one, 0, _sources(spark))
    assert _state(tables) == state


@pytest.mark.parametrize("at", [1])
def test_a_failure_between_two_writes_is_not_seen(spark, tmp_path, monkeypatch, at):
    plain, broken = Versions(spark, str(tmp_path / "plain")), Versions(spark, str(tmp_path / "broken"))
    one, two = _landed(spark, (1, "a", 0, "Nurse"), (2, "b", 0, "Cook")), _landed(spark, (1, "a", 3, "Nurse"), (2, "c", 3, "Baker"))
    for tables in (plain, broken):
        run_batch(tables, one, 0, _sources(spark))
    before, calls = _state(broken), []

    def fail(self, *args, f=Versions.write):
        calls.append(1)
        if len(calls) > at:
            raise RuntimeError("lost")
        f(self, *args)

    with monkeypatch.context() as m:
        m.setattr(Versions, "write", fail)
        if at == 3:
            m.setattr(Versions, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            run_batch(broken, two, 1, _sources(spark))
    assert _state(broken) == before  # readers still see the last committed batch
    for tables in (plain, broken):
        run_batch(tables, two, 1, _sources(spark))
    assert _state(broken) == _state(plain) != before


def test_as_a_stream(spark, tmp_path):
    tables, seen = Versions(spark, str(tmp_path / "t")), []
    verify = lambda touched, records, batch: seen.append((batch, touched.count(), records.count()))
    for k, rows in enumerate((((1, "a", 0, "Nurse"),), ((1, "b", 1, "Cook"), (1, "a", 1, "Nurse")))):
        _landed(spark, *rows).write.mode("append").parquet(str(tmp_path / "in"))
        ingest.start(spark.readStream.schema(LAND).parquet(str(tmp_path / "in")), tables, str(tmp_path / "c"), _sources(spark), verify).awaitTermination()
    assert seen == [(0, 1, 1), (1, 2, 2)]
    assert tables.read("records", RECORD).count() == 2


def test_an_empty_batch_is_committed(spark, tmp_path):
    tables = Versions(spark, str(tmp_path / "t"))
    run_batch(tables, spark.createDataFrame([], LAND), 4, _sources(spark))
    assert tables.committed(4) and tables.read("records", RECORD).count() == 0


def test_touched_jobs_without_fresh_signals_are_closed(spark):
    current = spark.createDataFrame([(1, "A", None), (2, "A", None), (3, "A", T)], "job_id long, code string, superseded_at timestamp")
    touched = spark.createDataFrame([(1,), (3,)], "job_id long")
    now = F.lit(T + timedelta(days=1)).cast("timestamp")
    got = {(r["job_id"], r["superseded_at"]) for r in incremental.supersede(current, spark.createDataFrame([], "job_id long, code string"), touched, now).collect()}
    assert got == {(1, T + timedelta(days=1)), (2, None), (3, T)}


def test_parts_without_touched_jobs_are_not_scanned(spark, tmp_path):
    path = str(tmp_path / "child")
    rows = spark.range(400).select(F.col("id").alias("job_id"), ingest.bucket(F.col("id")).alias("bucket"))
    rows.write.partitionBy("bucket").parquet(path)
    touched = rows.where("job_id = 7")
    touched.write.parquet(str(tmp_path / "touched"))
    got = incremental.of_touched(spark.read.parquet(path), spark.read.parquet(str(tmp_path / "touched")).where("job_id = 7"))
    assert got.count() == 1
    assert "dynamicpruning" in got._jdf.queryExecution().toString().lower()
