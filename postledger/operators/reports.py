"""Readable forms of jobs, job reports, and exports of a person's rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns that an export never holds.
PRIVATE = ("text",)
MAY_BE_CLOSED_DAYS = 7


def money(n: Column) -> Column:
    """Whole amounts with thousands separators, others with two decimals."""
    return F.concat(F.lit("$"), F.when(n == F.floor(n), F.format_number(n, 0)).otherwise(F.replace(F.format_number(n, 2), F.lit(","), F.lit(""))))


def pay_text(low: Column, high: Column, period: Column) -> Column:
    """A range, or the one amount that is there, and its period."""
    low, high = F.nullif(low, F.lit(0)), F.nullif(high, F.lit(0))
    span = F.when(low != high, F.concat(money(low), F.lit("–"), money(high))).otherwise(money(F.coalesce(high, low)))
    return F.when(span.isNull(), "Salary not disclosed").otherwise(F.concat(span, F.coalesce(F.concat(F.lit(" / "), F.lower(period)), F.lit(""))))


def days_ago(at: Column, now: Column) -> Column:
    days = F.floor((now.cast("double") - at.cast("double")) / 86_400)
    return F.when(days <= 0, "today").when(days == 1, "1 day ago").when(days > 1, F.concat(days.cast("string"), F.lit(" days ago")))


def may_be_closed(last_verified: Column, now: Column) -> Column:
    return F.coalesce(last_verified < now - F.expr(f"INTERVAL {MAY_BE_CLOSED_DAYS} DAYS"), F.lit(False))


def found_on(sources: Column) -> Column:
    return F.concat(F.lit("Found on "), sources.cast("string"), F.when(sources == 1, " source").otherwise(" sources"))


def cards(jobs: DataFrame, salaries: DataFrame, signals: DataFrame, now: Column) -> DataFrame:
    """One card a job: pay, age of the last confirmation, sources, caution at the apply link. salaries has one row a job."""
    bad = F.col("code").isin("LOOKALIKE_DOMAIN", "APPLY_URL_MISMATCH")
    counts = signals.groupBy("job_id").agg(
        F.max(bad).alias("caution"), F.count_if(F.col("weight") > 0).alias("n_positive"), F.count_if(F.col("weight") < 0).alias("n_negative")
    )
    j = jobs.join(salaries.select("job_id", "low", "high", "period"), "job_id", "left").join(counts, "job_id", "left")
    return j.select(
        "job_id",
        pay_text(F.col("low"), F.col("high"), F.col("period")).alias("pay"),
        F.coalesce(days_ago(F.col("last_verified"), now), F.lit("never")).alias("confirmed"),
        may_be_closed(F.col("last_verified"), now).alias("may_be_closed"),
        found_on(F.col("active_sources")).alias("found_on"),
        F.coalesce("caution", F.lit(False)).alias("caution"),
        F.coalesce("n_positive", F.lit(0)).alias("n_positive"),
        F.coalesce("n_negative", F.lit(0)).alias("n_negative"),
    )


def export(sections: dict[str, DataFrame]) -> DataFrame:
    """user_id, section, item (JSON without private columns): a row an item, so a person with very many rows is no single row."""

    def one(name: str, df: DataFrame) -> DataFrame:
        kept = [c for c in df.columns if c != "user_id" and c not in PRIVATE]
        return df.where("user_id IS NOT NULL").select("user_id", F.lit(name).alias("section"), F.to_json(F.struct(*kept)).alias("item"))

    return reduce(DataFrame.unionByName, (one(n, df) for n, df in sections.items()))


def job_report(jobs: DataFrame, signals: DataFrame, records: DataFrame, sources: DataFrame, salaries: DataFrame, status: DataFrame) -> DataFrame:
    """One row a job with its status and sorted arrays of signals, sources and pay.

    A job has at most fifteen signals and as many records and pay rows as
    sources list it, so the arrays are bounded by the number of sources.
    """
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("rank"), "code", "evidence_text")))
    s = signals.groupBy("job_id").agg(F.transform(ranked, lambda x: F.struct(x["code"].alias("code"), x["evidence_text"].alias("evidence_text"))).alias("signals"))
    r = records.join(sources.select("source_id", "source_name"), "source_id")
    r = r.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("source_id", "source_name", F.col("expired_at").isNull().alias("active")))).alias("sources"))
    p = salaries.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("source_id", pay_text(F.floor("low"), F.floor("high"), F.col("period")).alias("pay")))).alias("salaries"))
    return jobs.join(status, "job_id").join(s, "job_id", "left").join(r, "job_id", "left").join(p, "job_id", "left")


def polarity_counts(signals: DataFrame) -> DataFrame:
    n = lambda p: F.count_if(F.col("polarity") == p)
    return signals.groupBy("job_id").agg(n("POSITIVE").alias("n_positive"), n("NEGATIVE").alias("n_negative"), n("NEUTRAL").alias("n_neutral"))
