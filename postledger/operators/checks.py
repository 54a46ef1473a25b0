"""Checks of pasted text: fields, the best matching job, outcome and storage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postledger.functions import normalize, pasted, pay, text
from postledger.operators import signals
from postledger.operators.dedup import MERGE
from postledger.operators.upsert import latest


def fields(checks: DataFrame) -> DataFrame:
    """checks (check_id, text, employer_hint) with what their texts say."""
    t = F.col("text")
    return checks.withColumns(
        {
            "title": pasted.title(t),
            "employer_name": pasted.employer(t, F.col("employer_hint")),
            "place": pasted.place(t),
            "apply_url": pasted.apply_url(t),
            "vacancy_statement": text.vacancy_statement(t),
            "off_platform": F.size(text.off_platform_contact(t)) > 0,
            "upfront_payment": F.size(text.upfront_payment(t)) > 0,
        }
    )


def structured_score(a: str, b: str) -> Column:
    """Agreement of title, city and annual pay range between 0 and 1; other titles score 0."""
    ca, cb = F.lower(F.nullif(F.col(f"{a}.city"), F.lit(""))), F.lower(F.nullif(F.col(f"{b}.city"), F.lit("")))
    city = F.when(ca == cb, 0.25).when(ca.isNotNull() & cb.isNotNull(), -0.3).when(ca.isNull() & cb.isNull(), 0.1).otherwise(0.0)
    shared = F.when(F.col(f"{a}.currency") == F.col(f"{b}.currency"), pay.overlap(*(F.col(f"{s}.{c}") for s in (a, b) for c in ("lo", "hi"))))
    worth = F.when(shared.isNull(), 0.0).when(shared >= 0.9, 0.25).when(shared >= 0.5, 0.1).otherwise(-0.3)
    score = F.least(F.greatest(F.lit(0.6) + city + worth, F.lit(0.0)), F.lit(1.0))
    return F.when(F.col(f"{a}.title_normalized") == F.col(f"{b}.title_normalized"), score).otherwise(0.0)


def match(checks: DataFrame, jobs: DataFrame, *, scorer: Callable[[str, str], Column] | None = None) -> DataFrame:
    """Best active job of the check's employer and title stem: check_id, job_id, score, is_strong.

    Both sides hold employer_id, title_stem, title_normalized, city, lo, hi
    (annual pay) and currency; a scorer (dedup.lexical, with the columns that
    it reads) is a further score, of which the larger counts. Ties go to the
    smaller job.
    """
    c, j = checks.alias("c"), jobs.where("expired_at IS NULL").alias("j")
    score = structured_score("c", "j")
    score = F.floor((score if scorer is None else F.greatest(score, scorer("c", "j"))) * 10_000 + 0.5) / 10_000
    pairs = c.join(j, (F.col("c.employer_id") == F.col("j.employer_id")) & (F.col("c.title_stem") == F.col("j.title_stem")))
    # the best of a check is one aggregate with map-side combine
    best = pairs.groupBy("c.check_id").agg(F.min(F.struct((-score).alias("s"), F.col("j.job_id").alias("job_id"))).alias("best"))
    return best.select("check_id", "best.job_id", (-F.col("best.s")).alias("score")).withColumn("is_strong", F.col("score") >= MERGE)


def borrowed(matches: DataFrame, jobs: DataFrame, records: DataFrame) -> DataFrame:
    """Records and freshness that a check may show: those of a strong match only."""
    strong = matches.where("is_strong").select("check_id", "job_id")
    fresh = jobs.select("job_id", F.col("last_verified").alias("job_last_verified"))
    return strong.join(fresh, "job_id").join(records, "job_id", "left")


def verify(checks: DataFrame, matches: DataFrame, jobs: DataFrame, records: DataFrame, sources: DataFrame, domains: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Signals and status of pasted checks, by the rules of jobs; only a strong match lends its records, freshness and hosting.

    checks: check_id, text, apply_url, employer_id, employer_name, identity
    and the pasted pay low, high, period, currency, pay_text (null where none);
    matches: check_id, job_id, is_strong; jobs: job_id, last_verified.
    """
    strong = matches.where("is_strong").join(jobs.select("job_id", "last_verified"), "job_id").select("check_id", "job_id", "last_verified")
    case = checks.join(strong.select("check_id", "last_verified", F.lit(True).alias("strong")), "check_id", "left")
    none = F.lit(None)
    subject = case.select(
        F.col("check_id").alias("job_id"), "employer_id", "employer_name", "identity", "apply_url", "text", "last_verified", now.alias("first_seen"), none.cast("timestamp").alias("expired_at"),
        none.cast("string").alias("identity_text"), none.cast("string").alias("identity_url"), none.cast("timestamp").alias("identity_at"),
    )
    lent = strong.select("check_id", "job_id").join(records, "job_id").drop("job_id").withColumnRenamed("check_id", "job_id")
    # pasted pay counts as hosted by the employer only where a strong match says the same posting
    pasted_pay = case.where("pay_text IS NOT NULL").select(
        F.col("check_id").alias("job_id"), F.when(F.col("strong"), -1).otherwise(-2).cast("long").alias("source_id"), "low", "high", "period", "currency", F.col("pay_text").alias("evidence")
    )
    extra = checks.sparkSession.createDataFrame([(-1, "pasted", True), (-2, "pasted", False)], "source_id long, source_name string, owned boolean")
    known = sources.select(F.col("source_id").cast("long").alias("source_id"), "source_name", "owned").unionByName(extra)
    nobody = subject.select(none.cast("long").alias("report_id"), none.cast("long").alias("user_id"), "job_id", F.lit("DISMISSED").alias("status"))
    board = strong.select(F.col("check_id").alias("job_id"), F.col("last_verified").alias("checked_at"))
    found = signals.compute(subject, lent, known, pasted_pay, nobody, domains, now, board)
    return found.withColumnRenamed("job_id", "check_id"), signals.status(subject, found, records=lent).withColumnRenamed("job_id", "check_id")


def outcome(checks: DataFrame, pages: DataFrame) -> DataFrame:
    """Outcome and text of each check: pasted text and the text of the fetched page.

    A disallowed host without text is BLOCKED, no input at all is EMPTY, a
    link without text whose page is missing is UNREADABLE.
    """
    seen = pages.select("url", text.html_to_text(F.col("html")).alias("page_text"))
    seen = latest(seen, ["url"], F.col("page_text"))
    c = checks.join(seen, "url", "left")
    page = F.when(~F.coalesce("disallowed", F.lit(False)), F.col("page_text"))
    has_text = F.coalesce(F.trim("text") != "", F.lit(False))
    kind = (
        F.when(~has_text & F.col("url").isNull(), "EMPTY")
        .when(~has_text & F.col("disallowed"), "BLOCKED")
        .when(~has_text & page.isNull(), "UNREADABLE")
        .otherwise("CHECKED")
    )
    return c.select("check_id", kind.alias("outcome"), F.concat_ws("\n\n", F.when(has_text, F.col("text")), page).alias("input_text"))


def stored(checks: DataFrame, key: Column, now: Column, days: int = 30) -> DataFrame:
    """Checks as they are kept: encrypted text and an expiry."""
    return checks.withColumns({"text": F.base64(F.aes_encrypt("text", key, F.lit("GCM"))), "expires_at": now + F.expr(f"INTERVAL {days} DAYS")})


def normalized(checks: DataFrame) -> DataFrame:
    """Match keys of pasted titles."""
    t = normalize.title_normalized(F.col("title"))
    return checks.withColumn("title_normalized", t).withColumn("title_stem", normalize.title_stem(F.col("title_normalized")))
