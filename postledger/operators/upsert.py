"""Keyed upserts as set operations: the last version of a key wins, with precedence where sources differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The first row of each key in a total order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def land(payloads: DataFrame, landed: DataFrame | None = None) -> DataFrame:
    """Raw landing: one row per (source, ref, content hash) with its last sighting and how often it was seen, in this batch and in what landed before."""
    key = ["source_id", "external_ref", "content_hash"]
    rows = payloads.select("source_id", "external_ref", F.sha2("payload", 256).alias("content_hash"), "fetched_at", F.lit(1).cast("long").alias("sightings"))
    if landed is not None:
        rows = rows.unionByName(landed.select(*key, "fetched_at", "sightings"))
    return rows.groupBy(*key).agg(F.max("fetched_at").alias("fetched_at"), F.sum("sightings").alias("sightings"))


def owned_jobs(records: DataFrame, sources: DataFrame) -> DataFrame:
    """Jobs that an active record of an owned source backs."""
    return records.where("expired_at IS NULL").join(sources.where("owned"), "source_id", "left_semi").select("job_id").distinct()


def merge_jobs(current: DataFrame, staged: DataFrame, backed: DataFrame, columns: list[str]) -> DataFrame:
    """Canonical upsert: an owned source overwrites and clears expiry; another does so only for its own known record of a job that no active owned record backs.

    staged: one row per job with decision, owned_source, last_seen and
    columns; current: job_id, last_seen, expired_at and columns; backed:
    job_id of jobs with an active owned record. Whatever does not overwrite
    still moves last_seen.
    """
    c = current.join(backed.select("job_id", F.lit(True).alias("backed")), "job_id", "left").alias("c")
    s = staged.alias("s")
    there, known = F.col("c.job_id").isNotNull(), F.col("s.job_id").isNotNull()
    own = (F.col("s.decision") == "SAME_SOURCE_RECORD") & F.col("c.backed").isNull()
    overwrite = F.coalesce(known & (~there | F.col("s.owned_source") | own), F.lit(False))
    pick = lambda n: F.when(overwrite, F.col(f"s.{n}")).otherwise(F.col(f"c.{n}")).alias(n)
    return c.join(s, F.col("c.job_id") == F.col("s.job_id"), "full").select(
        F.coalesce("c.job_id", "s.job_id").alias("job_id"),
        *(pick(n) for n in columns),
        F.greatest("c.last_seen", "s.last_seen").alias("last_seen"),
        F.when(~overwrite, F.col("c.expired_at")).alias("expired_at"),
        F.when(~there, "NEW").when(overwrite, "OVERWRITTEN").when(known, "SEEN").otherwise("KEPT").alias("change"),
    )


def merge_records(current: DataFrame, staged: DataFrame, columns: list[str]) -> DataFrame:
    """Source records by (source_id, external_ref): a new sighting moves what it says, last_seen and expiry; the job link and first_seen stay.

    staged: one row per key with job_id, seen_at, owned_source and columns.
    Being on an owned board is proof, so only owned sightings move last_verified.
    """
    key = ["source_id", "external_ref"]
    c, s = current.alias("c"), staged.alias("s")
    seen = F.col("s.seen_at").isNotNull()
    proof = F.when(F.col("s.owned_source"), F.col("s.seen_at"))
    return c.join(s, [F.col(f"c.{k}") == F.col(f"s.{k}") for k in key], "full").select(
        *(F.coalesce(f"c.{k}", f"s.{k}").alias(k) for k in key),
        F.coalesce("c.job_id", "s.job_id").alias("job_id"),
        *(F.when(seen, F.col(f"s.{n}")).otherwise(F.col(f"c.{n}")).alias(n) for n in columns),
        F.coalesce("c.first_seen", "s.seen_at").alias("first_seen"),
        F.coalesce("s.seen_at", "c.last_seen").alias("last_seen"),
        F.coalesce(proof, F.col("c.last_verified")).alias("last_verified"),
        F.when(~seen, F.col("c.expired_at")).alias("expired_at"),
    )


def replace_children(current: DataFrame, touched: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """Children of touched keys are replaced, even by nothing."""
    return current.join(touched.select(*key).distinct(), key, "left_anti").unionByName(fresh)
