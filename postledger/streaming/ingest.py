"""Incremental ingest: batches of landed postings become records and jobs, in versions of tables that appear at once.

A table lies in parts by a bucket of its job. A batch writes the parts that it
touches under its own number, and last of all a row that commits it; readers
take the newest committed version of each part. A batch that is run again
starts from what was committed before it and overwrites its own parts, and one
that is committed does nothing, so a failure between two writes changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from postledger.operators import freshness, intake, upsert

BUCKETS = 32
RECORD = "source_id long, external_ref string, job_id long, title_stem string, first_seen timestamp, last_seen timestamp, last_verified timestamp, expired_at timestamp, bucket int"
JOB = "job_id long, last_verified timestamp, last_seen timestamp, active_sources long, all_sources long, expired_at timestamp, bucket int"
LANDED = "source_id long, external_ref string, content_hash string, fetched_at timestamp, sightings long, bucket int"
_COMMIT = "batch long, table string, bucket int"


def bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


@dataclass
class Versions:
    """Committed versions of parted tables below a folder that all executors share."""

    spark: SparkSession
    root: str

    def commits(self, before: int | None = None) -> DataFrame:
        try:
            rows = self.spark.read.schema(_COMMIT).parquet(f"{self.root}/commits")
        except AnalysisException:  # nothing is committed yet
            rows = self.spark.createDataFrame([], _COMMIT)
        return rows if before is None else rows.where(F.col("batch") < before)

    def committed(self, batch: int) -> bool:
        return not self.commits().where(F.col("batch") == batch).isEmpty()

    def read(self, table: str, schema: str, before: int | None = None) -> DataFrame:
        """The newest version of each part, of batches before one."""
        newest = self.commits(before).where((F.col("table") == table) & (F.col("bucket") >= 0)).groupBy("bucket").agg(F.max("batch").alias("batch"))
        parts = newest.collect()  # a row a bucket
        if not parts:
            return self.spark.createDataFrame([], schema)
        base = f"{self.root}/{table}"
        found = self.spark.read.schema(schema).option("basePath", base).parquet(*(f"{base}/batch={r['batch']}/bucket={r['bucket']}" for r in parts))
        return found.select(*self.spark.createDataFrame([], schema).columns)

    def write(self, table: str, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{table}/batch={batch}")

    def commit(self, batch: int, tables: dict[str, list[int]]) -> None:
        rows = [(batch, t, b) for t, found in tables.items() for b in found]
        # also a batch that touched nothing is done; one file, so that all its rows appear at once
        self.spark.createDataFrame([*rows, (batch, "", -1)], _COMMIT).coalesce(1).write.mode("append").parquet(f"{self.root}/commits")


def _buckets(rows: DataFrame) -> list[int]:
    return sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())  # BUCKETS at most


def run_batch(tables: Versions, landed: DataFrame, batch: int, sources: DataFrame, verify: Callable[[DataFrame, DataFrame, int], None] | None = None) -> None:
    """Land, project, link and upsert one batch, verify what it touched, commit.

    landed: source_id, external_ref, payload, fetched_at and the columns of a
    parsed posting; sources: source_id, owned. A posting of a known record
    keeps its job, another's job is the hash of its source and reference.
    verify(touched jobs, records, batch) must be repeatable too.
    """
    if tables.committed(batch):
        return
    key = ["source_id", "external_ref"]
    part = bucket(F.xxhash64(*key))  # of a record and what landed for it
    raw = upsert.latest(landed, key, F.desc("fetched_at"), F.desc(F.sha2("payload", 256))).withColumn("bucket", part)
    within = lambda rows, found: rows.where(F.col("bucket").isin(*found))  # noqa: E731  other parts are not read
    parts = {"landed": _buckets(raw)}
    if parts["landed"]:
        old = within(tables.read("landed", LANDED, batch), parts["landed"]).drop("bucket")
        tables.write("landed", upsert.land(landed, old).withColumn("bucket", part), batch)

    valid = intake.split(raw.drop("payload", "fetched_at", "bucket"))[0].select(*key, "title_stem")
    seen = valid.join(raw.select(*key, "bucket", F.col("fetched_at").alias("seen_at")), key)
    owned = seen.join(sources.select("source_id", F.col("owned").alias("owned_source")), "source_id", "left").fillna(False, ["owned_source"])
    staged = owned.withColumn("job_id", F.xxhash64(*key))
    parts["records"] = _buckets(staged)
    if parts["records"]:
        earlier = tables.read("records", RECORD, batch)
        tables.write("records", upsert.merge_records(within(earlier, parts["records"]), staged, ["title_stem"]).withColumn("bucket", part), batch)
        written = tables.spark.read.schema(RECORD).parquet(f"{tables.root}/records/batch={batch}")
        records = earlier.where(~F.col("bucket").isin(*parts["records"])).unionByName(written)
        touched = written.join(staged.select(*key), key, "left_semi").select("job_id").distinct().withColumn("bucket", bucket(F.col("job_id")))
        # all records of a touched job count, in whichever part they lie
        fresh = freshness.rollup(records.join(touched.select("job_id"), "job_id", "left_semi")).withColumn("bucket", bucket(F.col("job_id")))
        parts["jobs"] = _buckets(touched)
        kept = within(tables.read("jobs", JOB, batch), parts["jobs"]).join(touched.select("job_id"), "job_id", "left_anti")
        tables.write("jobs", kept.unionByName(fresh.select(*kept.columns)), batch)
        if verify is not None:
            verify(touched, records, batch)
    tables.commit(batch, parts)


def start(landed: DataFrame, tables: Versions, checkpoint: str, sources: DataFrame, verify: Callable[[DataFrame, DataFrame, int], None] | None = None) -> StreamingQuery:
    """Run a batch over whatever has landed since the last run; the checkpoint remembers what was taken."""
    job = lambda rows, batch: run_batch(tables, rows, batch, sources, verify)
    return landed.writeStream.foreachBatch(job).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
