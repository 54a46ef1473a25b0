"""The data source of landed pages, and what a partial fetch proves."""

import json

import pytest
from pyspark.sql import functions as F

from postledger.operators import freshness
from postledger.sources import boards, pages
from postledger.streaming import events


def _write(folder, name, rows):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(rows), encoding="utf-8")


def _posting(k):
    return {"id": f"p{k}", "text": f" Baker {k} ", "categories": {"location": "Laval", "commitment": "Full-time"}, "country": "CA", "createdAt": 0, "descriptionPlain": "Good."}


def test_pages_and_their_postings(spark, tmp_path):
    _write(tmp_path, "acme/0.json", [_posting(k) for k in range(100)])
    _write(tmp_path, "acme/1.json", [_posting(k) for k in range(100, 130)])
    _write(tmp_path, "cut/0.json", [_posting(k) for k in range(100)])  # the next page was not fetched
    _write(tmp_path, "gap/1.json", [_posting(1)])
    _write(tmp_path, "even/0.json", [_posting(k) for k in range(100)])
    _write(tmp_path, "even/1.json", [])
    found = pages.read(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == 6
    assert {r["source"] for r in pages.whole(found).collect()} == {"acme", "even"}
    got = pages.postings(found.where("source = 'acme'"), "paged", "Acme").orderBy("external_ref").collect()
    assert len(got) == 130 and (got[0]["source"], got[0]["title"], got[0]["location_text"], got[0]["employer_name"]) == ("acme", "Baker 0", "Laval, Canada", "Acme")


def test_a_document_gives_what_the_reader_gives(spark, tmp_path):
    jobs = [{"id": 7, "title": "Née ", "absolute_url": "https://x.ca/7", "location": {"name": "Laval"}, "content": "&lt;p&gt;Good&lt;/p&gt;", "metadata": [{"name": "Job Type", "value": "Contract"}]}]
    _write(tmp_path, "one.json", {"jobs": jobs})
    got = pages.postings(pages.read(spark, str(tmp_path)), "board", "Acme").drop("source")
    assert got.collect() == boards.board(spark, str(tmp_path / "one.json"), "Acme").collect()
    flat = [{"jobId": "9", "title": "Cook", "city": "Laval", "province": "QC", "salaryText": "$20", "description": "Good"}]
    _write(tmp_path / "flat", "bank/0.json", flat)
    got = pages.postings(pages.read(spark, str(tmp_path / "flat")), "extract").drop("source")
    assert got.collect() == boards.extract(spark, str(tmp_path / "flat/bank/0.json")).collect()


def test_a_path_is_needed(spark):
    spark.dataSource.register(pages.BoardPages)
    with pytest.raises(Exception, match="needs a path"):
        spark.read.format("board_pages").load().collect()


def test_a_partial_fetch_proves_no_absence(spark):
    records = spark.createDataFrame([(1, 10, None), (2, 10, None), (3, 11, None)], "job_id long, source_id long, expired_at timestamp")
    sources = spark.createDataFrame([(10, True), (11, True)], "source_id long, owned boolean")
    seen = spark.createDataFrame([(1, 10)], "job_id long, source_id long")
    missing = lambda *whole: {r["job_id"] for r in freshness.missing_from_board(records, sources, seen, *whole).collect()}
    assert missing() == {2, 3} and missing(sources.where("source_id = 10")) == {2} and missing(sources.limit(0)) == set()


def test_events_are_appended_once(spark, tmp_path):
    path = str(tmp_path / "events")
    rows = spark.createDataFrame([(1, "view", 5, "2024-01-01 10:00:00"), (2, "view", None, "2024-01-02 10:00:00"), (2, "view", None, "2024-01-02 10:00:00")], "event_id long, name string, user_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    events.append(rows.limit(0), path)
    assert events.read(spark, path).count() == 0
    for _ in range(2):
        events.append(rows, path)
    assert sorted(r["event_id"] for r in events.read(spark, path).collect()) == [1, 2]
    rows.withColumn("event_id", F.col("event_id") + 1).write.parquet(str(tmp_path / "in"))
    events.start(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), path, str(tmp_path / "c")).awaitTermination()
    # 2 was there, though on another day: an event is known by its day and id
    assert sorted((r["event_id"], str(r["day"])) for r in events.read(spark, path).collect()) == [(1, "2024-01-01"), (2, "2024-01-01"), (2, "2024-01-02"), (3, "2024-01-02")]
