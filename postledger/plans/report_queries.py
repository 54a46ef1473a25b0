"""Job reports, staff lists, health, saved jobs and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from postledger.functions import text, urls
from postledger.operators import accounts, dedup, freshness, intake, reports, search, signals, upsert
from postledger.plans.binding import dealt, view
from postledger.plans.registry import SQL, TS, day, now, query
from postledger.plans.signal_queries import STATUS, case_signals, with_signals
from postledger.sources import store


@query()
def signal_polarity(spark, sf):
    return reports.polarity_counts(case_signals(spark, sf)[1])


SQL["signal_polarity"] = with_signals(
    " SELECT job_id, count(*) FILTER (WHERE polarity = 'POSITIVE') AS n_positive, count(*) FILTER (WHERE polarity = 'NEGATIVE') AS n_negative, count(*) FILTER (WHERE polarity = 'NEUTRAL') AS n_neutral FROM kept GROUP BY job_id"
)


@query()
def job_reports(spark, sf):
    """Reports with their arrays as text, so that any engine can compare them."""
    # records are read three times and pay twice: lineitem is dealt and sorted once for each
    lines = dealt(spark.read.parquet(f"{sf}/lineitem.parquet"), "l_orderkey")
    given = {name: store.write(view(spark, sf, name, lineitem=lines)) for name in ("b_record", "b_salary")}
    jobs, found = case_signals(spark, sf, **given)
    found = store.write(found)  # read twice
    status = signals.status(jobs, found, view(spark, sf, "b_override"), view(spark, sf, "b_open"))
    out = reports.job_report(jobs.select("job_id", "employer_name"), found, given["b_record"], view(spark, sf, "b_source"), given["b_salary"], status)
    list_ = lambda c, f: F.coalesce(F.array_join(F.transform(c, f), "; "), F.lit(""))
    return out.select(
        "job_id", "employer_name", "status",
        list_("signals", lambda x: F.concat_ws("=", x["code"], x["evidence_text"])).alias("signals"),
        list_("sources", lambda x: F.concat(x["source_name"], F.when(x["active"], "+").otherwise("-"))).alias("sources"),
        list_("salaries", lambda x: F.concat_ws("=", x["source_id"].cast("string"), x["pay"])).alias("salaries"),
    )


SQL["job_reports"] = with_signals(
    STATUS
    + """, sg AS (SELECT job_id, string_agg(code || '=' || evidence_text, '; ' ORDER BY weight DESC, code, evidence_text) AS signals FROM kept GROUP BY job_id),
    so AS (SELECT job_id, string_agg(source_name || CASE WHEN expired_at IS NULL THEN '+' ELSE '-' END, '; ' ORDER BY source_id) AS sources FROM b_record JOIN b_source USING (source_id) GROUP BY job_id),
    sa AS (SELECT job_id, string_agg(source_id || '=' || '$' || CASE WHEN lo <> hi THEN format('{:,}', lo) || '–$' ELSE '' END || format('{:,}', hi) || coalesce(' / ' || lower(period), ''), '; ' ORDER BY source_id) AS salaries
    FROM (SELECT job_id, source_id, period, CAST(floor(low) AS BIGINT) AS lo, CAST(floor(high) AS BIGINT) AS hi FROM b_salary) GROUP BY job_id)
    SELECT c.job_id, employer_name, status, coalesce(signals, '') AS signals, coalesce(sources, '') AS sources, coalesce(salaries, '') AS salaries
    FROM b_case c JOIN status s ON s.job_id = c.job_id LEFT JOIN sg ON sg.job_id = c.job_id LEFT JOIN so ON so.job_id = c.job_id LEFT JOIN sa ON sa.job_id = c.job_id"""
)


@query(
    f"""SELECT jobs, round(confirmed, 9) AS confirmed_rate, round(paid, 9) AS pay_rate, round(dedup, 9) AS dedup_rate, round(err, 9) AS error_rate FROM
    (SELECT count(*) AS jobs, avg(CASE WHEN last_verified >= {TS} - INTERVAL 72 HOUR THEN 1.0 ELSE 0.0 END) AS confirmed, avg(CASE WHEN job_id IN (SELECT job_id FROM b_salary) THEN 1.0 ELSE 0.0 END) AS paid FROM b_job),
    (SELECT sum(n - 1) / sum(n) AS dedup FROM (SELECT count(*) AS n FROM b_record GROUP BY job_id)), (SELECT avg(CASE WHEN job_id % 10 = 0 THEN 1.0 ELSE 0.0 END) AS err FROM b_record)"""
)
def pipeline_health(spark, sf):
    records = view(spark, sf, "b_record")
    outcomes = records.select(F.when(F.col("job_id") % 10 == 0, "ERRORED").otherwise("UPSERTED").alias("outcome"))
    out = accounts.health(view(spark, sf, "b_job"), records, view(spark, sf, "b_salary"), outcomes, now())
    return out.select("jobs", *(F.round(c, 9).alias(c) for c in ("confirmed_rate", "pay_rate", "dedup_rate", "error_rate")))


@query("SELECT job_id, count(*) AS records FROM b_record GROUP BY job_id HAVING count(*) > 1")
def merged_jobs(spark, sf):
    return accounts.merged_jobs(view(spark, sf, "b_record"))


@query("SELECT user_id, count(*) FILTER (WHERE event_id % 3 > 0) AS unread FROM events WHERE event_type = 'purchase' GROUP BY user_id")
def unread_notices(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").where("event_type = 'purchase'")
    return accounts.unread(e.select("user_id", F.when(F.col("event_id") % 3 == 0, now()).alias("read_at")))


_SAVED = "(SELECT user_id, event_id % 500 AS job_id FROM events WHERE event_type = 'click' GROUP BY 1, 2 HAVING count(*) % 2 = 1)"


def _saved(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").where("event_type = 'click'")
    return accounts.saved_state(e.select("user_id", (F.col("event_id") % 500).alias("job_id")))


@query(
    f"""SELECT s.user_id, s.job_id, employer_name, city, low, high, active_sources FROM {_SAVED} s JOIN b_case c ON c.job_id = s.job_id
    LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY high DESC NULLS LAST, low DESC NULLS LAST, source_id) AS n FROM b_salary) p ON p.job_id = s.job_id AND n = 1
    LEFT JOIN b_rollup r ON r.job_id = s.job_id"""
)
def saved_jobs(spark, sf):
    return accounts.saved_page(_saved(spark, sf), view(spark, sf, "b_case"), view(spark, sf, "b_salary"), view(spark, sf, "b_rollup"))


@query(
    f"""SELECT e.user_id, e.event_id % 500 AS job_id, e.event_id AS event_id, s.job_id IS NOT NULL AS saved FROM events e LEFT JOIN {_SAVED} s ON s.user_id = e.user_id AND s.job_id = e.event_id % 500 WHERE event_type = 'view'"""
)
def saved_flags(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").where("event_type = 'view'")
    return accounts.saved_flag(e.select("user_id", (F.col("event_id") % 500).alias("job_id"), "event_id"), _saved(spark, sf))


@query(
    """SELECT s.source_id, s.source_name, f.employer_name FROM b_source s LEFT JOIN b_firm f ON f.employer_id = s.employer_id AND s.owned"""
)
def source_list(spark, sf):
    """All sources with the employer that owns them, where one does."""
    firms = view(spark, sf, "b_firm").select("employer_id", "employer_name")
    s = view(spark, sf, "b_source").withColumn("employer_id", F.when(F.col("owned"), F.col("employer_id")))
    return s.join(firms, "employer_id", "left").select("source_id", "source_name", "employer_name")


@query("SELECT report_id, r.job_id, city FROM b_report r LEFT JOIN b_job j ON j.job_id = r.job_id WHERE status = 'PENDING'")
def report_list(spark, sf):
    jobs = view(spark, sf, "b_job").select("job_id", "city")
    return view(spark, sf, "b_report").where("status = 'PENDING'").join(jobs, "job_id", "left").select("report_id", "job_id", "city")


@query("SELECT job_id, strftime(last_seen, '%Y-%m-%d') AS last_seen FROM b_job ORDER BY b_job.last_seen DESC NULLS LAST, job_id LIMIT 500")
def recent_jobs(spark, sf):
    return accounts.recent(view(spark, sf, "b_job"), "last_seen", 500, "job_id").select("job_id", day("last_seen"))


@query(
    f"""SELECT job_id FROM b_job WHERE job_id % 5 = 0 UNION SELECT job_id FROM b_record WHERE expired_at IS NULL AND source_id % 4 = 0
    UNION SELECT job_id FROM b_job WHERE expired_at IS NULL AND (job_id % 3 = 0 OR first_seen < {TS} - INTERVAL 6 HOUR)"""
)
def touched_jobs(spark, sf):
    """Jobs to verify anew: stored ones, those of rechecked records, and those whose last verification is long ago."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    seen = view(spark, sf, "b_record", lineitem=dealt(lines, "l_orderkey"))
    records = store.write(seen.select("job_id", "source_id", "last_seen", "last_verified", "expired_at"))  # read twice
    jobs = store.write(view(spark, sf, "b_job", b_record=records).select("job_id", "first_seen", "expired_at"))
    jobs = jobs.withColumn("last_verified_run", F.when(F.col("job_id") % 3 > 0, F.col("first_seen")))
    rechecked = records.where("expired_at IS NULL AND source_id % 4 = 0")
    return accounts.touched(jobs.where("job_id % 5 = 0"), rechecked, freshness.reverify_due(jobs, now()))


@query(
    """SELECT source_id AS cluster_id, job_id, job_id % 2 = 0 AS owned, row_number() OVER (PARTITION BY source_id ORDER BY job_id % 2, job_id) AS place
    FROM (SELECT DISTINCT source_id, job_id FROM b_record)"""
)
def review_queue(spark, sf):
    m = view(spark, sf, "b_record").select(F.col("source_id").alias("cluster_id"), "job_id", (F.col("job_id") % 2 == 0).alias("owned"))
    return accounts.review_queue(m)


@query(
    """SELECT page_id, CASE WHEN page_id % 7 = 0 OR html IS NULL OR page_id % 5 = 0 THEN NULL ELSE page_id % 2 = 0 END AS linked FROM pages"""
)
def board_probe(spark, sf):
    """Careers pages that link the employer's board, another's, a host that only ends alike, that lie elsewhere (every seventh) or were not read (every fifth)."""
    p = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html")
    n = F.col("page_id")
    name = n.cast("string")
    domain = F.concat(F.lit("firm"), name, F.lit(".example"))
    at = F.concat(F.lit("https://www."), F.when(n % 7 == 0, F.concat(F.lit("other"), name, F.lit(".example"))).otherwise(domain), F.lit("/careers"))
    token = F.concat(F.lit("firm-"), name)
    board = F.when(n % 3 == 0, "lever").otherwise("greenhouse")
    employers = p.select(n.alias("employer_id"), domain.alias("domain"), at.alias("careers_url"), board.alias("board"), token.alias("board_token"))
    host = F.when(board == "lever", "https://jobs.lever.co/").when(n % 4 == 0, "https://boards-api.greenhouse.io/v1/boards/").otherwise("https://job-boards.greenhouse.io/")
    wrong = F.when(n % 3 == 1, F.concat(F.lit("https://notboards.greenhouse.io/"), token)).otherwise(F.concat(host, token, F.lit("7")))
    link = F.concat(F.lit("<a href='"), F.when(n % 2 == 0, F.concat(host, token)).otherwise(wrong), F.lit("'>"))
    pages = p.select(at.alias("url"), F.when(n % 5 != 0, F.concat("html", link)).alias("html"))
    return intake.board_probe(employers, pages).select(F.col("employer_id").alias("page_id"), "linked")


@query("SELECT job_id FROM b_job WHERE expired_at IS NULL AND job_id IN (SELECT job_id FROM b_record JOIN b_source USING (source_id) WHERE source_type = 'GOVERNMENT_OPEN_DATA')")
def source_type_semi(spark, sf):
    records, sources = view(spark, sf, "b_record"), view(spark, sf, "b_source")
    return search.find(view(spark, sf, "b_job"), records=records, sources=sources, source_type="GOVERNMENT_OPEN_DATA").select("job_id")


@query(
    """SELECT posting_id, candidate_id, round(score, 6) AS score FROM (SELECT a.posting_id, b.posting_id AS candidate_id,
    list_cosine_similarity(CAST(a.vector AS DOUBLE[]), CAST(b.vector AS DOUBLE[])) AS score FROM b_vector a JOIN b_vector b ON a.block = b.block AND b.posting_id < a.posting_id) WHERE score >= 0.25"""
)
def scored_by_vectors(spark, sf):
    """Another scorer on the block join of duplicates: cosine of embeddings."""
    pairs = dedup.cosine_pairs(view(spark, sf, "b_vector"), 0.25)
    return pairs.withColumn("score", F.round("score", 6))


@query(
    "SELECT url, regexp_replace(regexp_replace(lower(regexp_replace(url, '[?#].*$', '')), '^[a-z]+://(www[.])?', ''), '/+$', '') AS comparable FROM pages WHERE url IS NOT NULL"
)
def comparable_urls(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet").where("url IS NOT NULL").select("url", urls.comparable_url(F.col("url")).alias("comparable"))


@query(
    """SELECT job_id, source_id, low FROM b_salary WHERE source_id % 5 > 0 UNION ALL SELECT job_id, source_id, low + 1 FROM b_salary WHERE source_id % 5 = 0 AND job_id % 2 = 0"""
)
def salary_replace(spark, sf):
    """Pay of touched (job, source) pairs is replaced, even by nothing."""
    s = view(spark, sf, "b_salary").select("job_id", "source_id", "low")
    touched = s.where("source_id % 5 = 0")
    return upsert.replace_children(s, touched, touched.where("job_id % 2 = 0").withColumn("low", F.col("low") + 1), ["job_id", "source_id"])


def _html_sql() -> str:
    steps = [
        (r"(?is)<script[^>]*>.*?</script>", ""), (r"(?is)<style[^>]*>.*?</style>", ""), (r"(?i)<br\s*/?>", "\n"), (r"(?i)<li[^>]*>", "\n• "),
        (r"(?i)</(p|div|h[1-6]|li|ul|ol|tr|section)>", "\n"), (r"<[^>]+>", ""),
    ]
    ends = [("[ \t ]+", " "), (r" *\n *", "\n"), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", "")]
    out = "html"
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    for p, by in steps:
        out = f"regexp_replace({out}, {quote(p)}, {quote(by)}, 'g')"
    for name, value in text.ENTITIES.items():
        out = f"regexp_replace({out}, '(?i)&{name};', {quote(value)}, 'g')"
    out = f"regexp_replace({out}, '(?i)&amp;', '&', 'g')"
    for p, by in ends:
        out = f"regexp_replace({out}, {quote(p)}, {quote(by)}, 'g')"
    return f"SELECT page_id, sha256({out}) AS text_sha256 FROM pages"


@query(_html_sql())
def html_to_text(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", F.sha2(text.html_to_text(F.col("html")), 256).alias("text_sha256"))
