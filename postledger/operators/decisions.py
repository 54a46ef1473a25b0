"""Staff decisions applied as a batch: the latest of each entity counts, and every applied one leaves an audit row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postledger.operators.upsert import latest
from postledger.sources import store

NOTE = 500


def _last(decisions: DataFrame, key: str) -> DataFrame:
    return latest(decisions, [key], F.desc("decided_at"), F.desc("decision_id"))


def override_status(jobs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Set or clear the override of jobs. decisions: decision_id, job_id, status (CLEAR clears), note, decided_at."""
    d = _last(decisions, "job_id").select("job_id", F.col("status").alias("__status"), F.col("note").alias("__note"))
    note = F.trim(F.substring(F.trim("__note"), 1, NOTE))
    clear, set_ = F.col("__status") == "CLEAR", F.col("__status") != "CLEAR"
    pick = lambda new, old: F.when(clear, F.lit(None)).when(set_, new).otherwise(F.col(old))
    return (
        jobs.join(d, "job_id", "left")
        .withColumns({"override_note": pick(F.when(note != "", note), "override_note"), "override_status": pick(F.col("__status"), "override_status")})
        .drop("__status", "__note")
    )


def final_moves(moves: DataFrame) -> DataFrame:
    """job_id, to: where each moved job ends, by pointer jumping. moves: job_id (once), to.

    Every round doubles how far each job looks ahead, so rounds follow the
    logarithm of the longest way, not of the moves. Who still meets a moved job
    then is in a circle or leads into one; the smallest job that it passes
    there is kept and moves nowhere.

    A job whose next stretch has the same smallest job as the one after it has
    met a job twice, so it reaches its circle within one stretch, which goes
    all round it. Rounds end once that holds for every job in sight.
    """
    ahead = store.write(
        moves.where("job_id <> to").select("job_id", "to", F.col("to").alias("least"), F.lit(False).alias("done"), F.lit(False).alias("round"), F.lit(True).alias("open"))
    )
    while not ahead.where("open").isEmpty():
        on = ahead.select(F.col("job_id").alias("to"), F.col("to").alias("next"), F.col("least").alias("further"), F.col("round").alias("seen"))
        moved = F.col("next").isNotNull()
        ahead = store.write(
            ahead.join(on, "to", "left").select(
                "job_id",
                F.coalesce("next", "to").alias("to"),
                F.least("least", "further").alias("least"),
                (~moved).alias("done"),
                F.coalesce(F.col("least") == F.col("further"), F.lit(False)).alias("round"),
                (moved & ~F.coalesce("seen", F.lit(False))).alias("open"),
            )
        )
    # the job in sight lies on the circle, and what it has passed is all of it
    circle = ahead.where("NOT done").select(F.col("job_id").alias("to"), F.col("least").alias("kept"))
    out = ahead.join(circle, "to", "left").select("job_id", F.coalesce("kept", "to").alias("to"))
    return out.where("job_id <> to")


def resolve_clusters(clusters: DataFrame, records: DataFrame, decisions: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """clusters, records and expired losers (job_id, expired_at) after merging or keeping apart clusters that await review.

    A merge moves the loser's records to the kept job, and where that is merged
    in the same batch, on to the job that is kept last; of merges in a circle
    the smallest job is kept. Keeping apart detaches the records from the
    cluster. Decisions on other clusters do nothing.
    """
    d = _last(decisions, "cluster_id").join(clusters.where("status = 'REVIEW_REQUIRED'"), "cluster_id", "left_semi")
    closed = d.select("cluster_id", F.lit("RESOLVED").alias("__status"))
    after = clusters.join(closed, "cluster_id", "left").withColumn("status", F.coalesce("__status", "status")).drop("__status")
    merged = d.where("action = 'MERGE'")
    moves = final_moves(merged.groupBy(F.col("drop_job_id").alias("job_id")).agg(F.min("keep_job_id").alias("to"))).withColumnRenamed("to", "__to")
    apart = d.where("action = 'KEEP_SEPARATE'").select("cluster_id", F.lit(True).alias("__apart"))
    moved = (
        records.join(moves, "job_id", "left")
        .join(apart, "cluster_id", "left")
        .withColumns({"job_id": F.coalesce("__to", "job_id"), "cluster_id": F.when(F.col("__apart").isNull(), F.col("cluster_id"))})
        .select(*records.columns)
    )
    return after, moved, moves.select("job_id", now.alias("expired_at"))


def resolve_reports(reports: DataFrame, decisions: DataFrame) -> DataFrame:
    """Pending reports become UPHELD or DISMISSED; decisions on others do nothing."""
    d = _last(decisions, "report_id").select("report_id", F.col("decision").alias("__decision"))
    open_ = F.col("status") == "PENDING"
    return reports.join(d, "report_id", "left").withColumn("status", F.when(open_, F.coalesce("__decision", "status")).otherwise(F.col("status"))).drop("__decision")


def audit(before: DataFrame, after: DataFrame, key: str, column: str, action: str, now: Column) -> DataFrame:
    """A row for every entity whose column changed, with both values."""
    b = before.select(key, F.col(column).cast("string").alias("before"))
    a = after.select(key, F.col(column).cast("string").alias("after"))
    changed = a.join(b, key).where(~F.col("before").eqNullSafe(F.col("after")))
    return changed.select(F.lit(action).alias("action"), F.col(key).cast("string").alias("entity_id"), "before", "after", now.alias("at"))
