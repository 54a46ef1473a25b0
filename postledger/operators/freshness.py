"""Freshness: rollup, rechecks and liveness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rollup(records: DataFrame) -> DataFrame:
    """One row per job: latest proof and sighting, active and all records, expiry only when no record is active."""
    active = F.count_if(F.col("expired_at").isNull())
    return records.groupBy("job_id").agg(
        F.max("last_verified").alias("last_verified"),
        F.max("last_seen").alias("last_seen"),
        active.alias("active_sources"),
        F.count("*").alias("all_sources"),
        F.when(active == 0, F.max("expired_at")).alias("expired_at"),
    )


def roll_up(jobs: DataFrame, records: DataFrame) -> DataFrame:
    """Jobs with the freshness of their records: the later sighting stays, and so does an earlier expiry while no record is active.

    Jobs without records stay as they are.
    """
    r = rollup(records).select("job_id", *(F.col(c).alias(f"r_{c}") for c in ("last_verified", "last_seen", "active_sources", "expired_at")))
    known = F.col("r_active_sources").isNotNull()
    return jobs.join(r, "job_id", "left").withColumns(
        {
            "last_verified": F.when(known, F.col("r_last_verified")).otherwise(F.col("last_verified")),
            "last_seen": F.greatest("last_seen", "r_last_seen"),
            "expired_at": F.when(F.col("r_active_sources") > 0, None).when(known, F.coalesce("expired_at", "r_expired_at")).otherwise(F.col("expired_at")),
        }
    ).select(*jobs.columns)


def _due(first_seen: Column, last_verified: Column, now: Column) -> Column:
    young = first_seen > now - F.expr("INTERVAL 7 DAYS")
    half, day = F.expr("INTERVAL 12 HOURS"), F.expr("INTERVAL 24 HOURS")
    return last_verified.isNull() | F.when(young, last_verified + half <= now).otherwise(last_verified + day <= now)


def recheck_due(records: DataFrame, sources: DataFrame, now: Column, limit: int = 500) -> DataFrame:
    """Active records of enabled sources whose interval has passed; never verified ones first, then the oldest."""
    return (
        records.where("expired_at IS NULL")
        .join(sources.where("enabled"), "source_id", "left_semi")
        .where(_due(F.col("first_seen"), F.col("last_verified"), now))
        .orderBy(F.asc_nulls_first("last_verified"), "job_id", "source_id")
        .limit(limit)
    )


def missing_from_board(records: DataFrame, sources: DataFrame, seen: DataFrame, whole: DataFrame | None = None) -> DataFrame:
    """Active records of owned boards that the latest fetch did not bring. whole: source_id of the fetches that came in full; the others prove no absence."""
    if whole is not None:
        sources = sources.join(whole.select("source_id").distinct(), "source_id", "left_semi")
    return records.where("expired_at IS NULL").join(sources.where("owned"), "source_id", "left_semi").join(seen, ["job_id", "source_id"], "left_anti")


def apply_liveness(records: DataFrame, observed: DataFrame, now: Column) -> DataFrame:
    """LIVE refreshes proof and sighting, GONE expires as of the check, UNKNOWN and no observation change nothing."""
    kept = records.join(observed, ["job_id", "source_id"], "left")
    live, gone = F.col("observation") == "LIVE", F.col("observation") == "GONE"
    return kept.withColumns(
        {
            "last_verified": F.when(live, now).otherwise(F.col("last_verified")),
            "last_seen": F.when(live, now).otherwise(F.col("last_seen")),
            "expired_at": F.when(gone, now).when(live, None).otherwise(F.col("expired_at")),
            "touched": F.coalesce(live | gone, F.lit(False)),
        }
    ).drop("observation")


def reverify_due(jobs: DataFrame, now: Column) -> DataFrame:
    last = F.col("last_verified_run")
    return jobs.where(F.col("expired_at").isNull() & (last.isNull() | (last < now - F.expr("INTERVAL 6 HOURS"))))
