"""Verification of the jobs that a run touched, equal to a run over all jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postledger.operators import signals


def of_touched(rows: DataFrame, touched: DataFrame) -> DataFrame:
    """Rows of touched jobs. Tables parted by a bucket of the job are met by both columns, so that whole parts are left out of the scan."""
    keys = [c for c in ("bucket", "job_id") if c in rows.columns and c in touched.columns]
    return rows.join(touched.select(*keys).distinct(), keys, "left_semi")


def verify(
    touched: DataFrame, jobs: DataFrame, records: DataFrame, sources: DataFrame, salaries: DataFrame, reports: DataFrame, domains: DataFrame, now: Column
) -> DataFrame:
    """Fresh signals of touched jobs (job_id): every child table is cut to them below its aggregate. Other columns as in signals.compute."""
    part = lambda rows: of_touched(rows, touched)
    return signals.compute(part(jobs), part(records), sources, part(salaries), part(reports), domains, now)


def supersede(current: DataFrame, fresh: DataFrame, touched: DataFrame, at: Column) -> DataFrame:
    """All signals with superseded_at: open ones of touched jobs are closed, also where nothing fresh was found, and fresh ones appended."""
    mark = touched.select("job_id").distinct().withColumn("__touched", F.lit(True))
    closing = F.col("superseded_at").isNull() & F.col("__touched")
    closed = current.join(mark, "job_id", "left").withColumn("superseded_at", F.when(closing, at).otherwise(F.col("superseded_at"))).drop("__touched")
    return closed.unionByName(fresh.withColumn("superseded_at", F.lit(None).cast("timestamp")), allowMissingColumns=True)


def statuses(before: DataFrame, fresh: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """Status of all jobs after a run over some of them, and a history row for each that is new or has changed. before, fresh: job_id, status, rule."""
    kept = before.join(fresh.select("job_id"), "job_id", "left_anti").unionByName(fresh)
    return kept, signals.history(before, fresh, at)
