"""Checks of pasted text by the rules of jobs, their outcome, and evidence precedence."""

from __future__ import annotations

from pyspark.sql import functions as F

from postledger.operators import checks, evidence
from postledger.plans.binding import view, with_views
from postledger.plans.registry import SQL, TS, now, query
from postledger.plans.signal_queries import _SIGNALS, STATUS, cases

# The tables that a check stands for: its own text and link, and what a strong match (every third) lends it.
_TABLES = f"""
c_case AS (SELECT job_id, employer_id, identity, CASE WHEN job_id % 3 = 0 THEN last_verified END AS last_verified, {TS} AS first_seen, CAST(NULL AS TIMESTAMP) AS expired_at, employer_name,
    CAST(NULL AS VARCHAR) AS identity_text, CAST(NULL AS VARCHAR) AS identity_url, CAST(NULL AS TIMESTAMP) AS identity_at, apply_url, text FROM b_case),
c_record AS (SELECT * FROM b_record WHERE job_id % 3 = 0),
c_salary AS (SELECT job_id, CASE WHEN job_id % 3 = 0 THEN -1 ELSE -2 END AS source_id, 50000.0 AS low, 60000.0 AS high, 'YEAR' AS period, 'CAD' AS currency, '50 to 60K' AS evidence FROM b_case WHERE job_id % 5 = 0),
c_source AS (SELECT source_id, source_name, owned, employer_id, last_success_at FROM b_source UNION ALL SELECT -1, 'pasted', true, NULL, NULL UNION ALL SELECT -2, 'pasted', false, NULL, NULL),
c_report AS (SELECT * FROM b_report WHERE false),
"""


def _for_checks(sql: str) -> str:
    for name in ("case", "record", "salary", "source", "report"):
        sql = sql.replace(f"b_{name}", f"c_{name}")
    sql = sql.replace("board AS (SELECT employer_id, max(last_success_at) AS checked_at FROM c_source WHERE owned GROUP BY employer_id HAVING max(last_success_at) IS NOT NULL)", "board AS (SELECT job_id, last_verified AS checked_at FROM c_case WHERE last_verified IS NOT NULL)")
    sql = sql.replace("c_case JOIN board USING (employer_id)", "c_case JOIN board USING (job_id)")
    return sql.replace("j.job_id IN (SELECT job_id FROM b_open)", "false").replace("LEFT JOIN b_override v", "LEFT JOIN (SELECT * FROM b_override WHERE false) v")


def _with_checks(sql: str) -> str:
    head = with_views("SELECT 1 FROM b_record, b_source, b_salary, b_case, b_report, b_firm_domain, b_override, b_open")
    return head[: head.rindex("SELECT 1")].rstrip() + ", " + _TABLES.strip() + " " + _for_checks(_SIGNALS.strip() + sql)


def _verified(spark, sf):
    known = cases(spark, sf)
    paid = F.col("job_id") % 5 == 0
    asked = known.select(
        F.col("job_id").alias("check_id"), "text", "apply_url", "employer_id", "employer_name", "identity", F.when(paid, 50000.0).alias("low"), F.when(paid, 60000.0).alias("high"),
        F.when(paid, "YEAR").alias("period"), F.when(paid, "CAD").alias("currency"), F.when(paid, "50 to 60K").alias("pay_text"),
    )
    matches = known.where("job_id % 3 < 2").select(F.col("job_id").alias("check_id"), "job_id", (F.col("job_id") % 3 == 0).alias("is_strong"))
    return checks.verify(asked, matches, known, view(spark, sf, "b_record"), view(spark, sf, "b_source"), view(spark, sf, "b_firm_domain"), now())


@query()
def check_signals(spark, sf):
    return _verified(spark, sf)[0].select("check_id", "code", "polarity", "weight", "evidence_text")


SQL["check_signals"] = _with_checks(" SELECT job_id AS check_id, code, polarity, weight, evidence_text FROM kept")


@query()
def check_status(spark, sf):
    return _verified(spark, sf)[1]


SQL["check_status"] = _with_checks(STATUS + " SELECT job_id AS check_id, rule, status FROM status")


@query(
    """SELECT page_id AS check_id, CASE WHEN NOT t AND url IS NULL THEN 'EMPTY' WHEN NOT t AND page_id % 5 = 0 THEN 'BLOCKED' WHEN NOT t AND page_id % 3 = 0 THEN 'UNREADABLE' ELSE 'CHECKED' END AS outcome
    FROM (SELECT page_id, page_id % 4 = 1 AS t, CASE WHEN page_id % 7 > 0 THEN url END AS url FROM pages)"""
)
def check_outcome(spark, sf):
    p = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html")
    n = F.col("page_id")
    link = F.concat(F.lit("https://p.example/"), n.cast("string"))
    asked = p.select(n.alias("check_id"), F.when(n % 4 == 1, "pasted").alias("text"), F.when(n % 7 > 0, link).alias("url"), (n % 5 == 0).alias("disallowed"))
    return checks.outcome(asked, p.where("page_id % 3 > 0").select(link.alias("url"), "html")).select("check_id", "outcome")


@query(
    """SELECT job_id AS posting_id, CASE WHEN job_id % 2 = 0 THEN price WHEN job_id % 3 = 0 THEN price + 1 ELSE price + 2 END AS low, CASE WHEN job_id % 2 = 0 THEN 'STATED' WHEN job_id % 3 = 0 THEN 'PARSED' ELSE 'DERIVED' END AS origin FROM b_order"""
)
def salary_precedence(spark, sf):
    o = view(spark, sf, "b_order")
    rows = lambda plus: o.select(F.col("job_id").alias("posting_id"), (F.col("price") + plus).alias("low"), F.lit(None).cast("double").alias("high"), F.lit("YEAR").alias("period"))
    unset = rows(0).withColumn("low", F.when(F.col("posting_id") % 2 == 0, F.col("low")))
    return evidence.salaries(unset, rows(1).where("posting_id % 3 = 0"), rows(2)).select("posting_id", "low", "origin")
