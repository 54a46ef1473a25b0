"""Registered queries over the domain tables, each with the SQL that DuckDB answers it by."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from postledger.functions import normalize, pay, text, urls
from postledger.operators import accounts, checks, decisions, dedup, evidence, freshness, identity, reports, robots, search, signals, upsert
from postledger.plans.binding import view
from postledger.plans.registry import TS as _TS
from postledger.plans.registry import day as _day
from postledger.plans.registry import now as _now
from postledger.plans.registry import query as _query
from postledger.sources import store
from postledger.streaming import events

@_query(
    "SELECT job_id, strftime(last_verified, '%Y-%m-%d') AS last_verified, strftime(last_seen, '%Y-%m-%d') AS last_seen, active_sources, all_sources, "
    "strftime(expired_at, '%Y-%m-%d') AS expired_at FROM b_rollup"
)
def freshness_rollup(spark, sf):
    return freshness.rollup(view(spark, sf, "b_record")).select(
        "job_id", _day("last_verified"), _day("last_seen"), "active_sources", "all_sources", _day("expired_at")
    )


@_query(
    f"""SELECT job_id, source_id FROM b_record r WHERE expired_at IS NULL AND source_id IN (SELECT source_id FROM b_source WHERE enabled)
    AND (last_verified IS NULL OR CASE WHEN first_seen > {_TS} - INTERVAL 7 DAY THEN last_verified + INTERVAL 12 HOUR ELSE last_verified + INTERVAL 24 HOUR END <= {_TS})
    ORDER BY last_verified ASC NULLS FIRST, job_id, source_id LIMIT 500"""
)
def recheck_due(spark, sf):
    return freshness.recheck_due(view(spark, sf, "b_record"), view(spark, sf, "b_source"), _now()).select("job_id", "source_id")


@_query(
    """SELECT job_id, source_id FROM b_record WHERE expired_at IS NULL AND source_id IN (SELECT source_id FROM b_source WHERE owned) AND (job_id + source_id) % 3 <> 0"""
)
def missing_from_board(spark, sf):
    records = view(spark, sf, "b_record")
    seen = records.where("(job_id + source_id) % 3 = 0").select("job_id", "source_id")
    return freshness.missing_from_board(records, view(spark, sf, "b_source"), seen).select("job_id", "source_id")


@_query(
    f"""SELECT job_id, source_id, strftime(CASE job_id % 4 WHEN 0 THEN {_TS} ELSE last_verified END, '%Y-%m-%d') AS last_verified,
    strftime(CASE job_id % 4 WHEN 0 THEN {_TS} ELSE last_seen END, '%Y-%m-%d') AS last_seen,
    strftime(CASE job_id % 4 WHEN 0 THEN NULL WHEN 1 THEN {_TS} ELSE expired_at END, '%Y-%m-%d') AS expired_at, job_id % 4 < 2 AS touched FROM b_record"""
)
def liveness_apply(spark, sf):
    records = view(spark, sf, "b_record")
    kind = F.when(F.col("job_id") % 4 == 0, "LIVE").when(F.col("job_id") % 4 == 1, "GONE").otherwise("UNKNOWN")
    observed = records.where("job_id % 4 < 3").select("job_id", "source_id", kind.alias("observation"))
    out = freshness.apply_liveness(records, observed, _now())
    return out.select("job_id", "source_id", _day("last_verified"), _day("last_seen"), _day("expired_at"), "touched")


@_query(
    "SELECT job_id, source_id, low, high FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY high DESC NULLS LAST, low DESC NULLS LAST, source_id) AS r FROM b_salary) WHERE r = 1"
)
def best_salary(spark, sf):
    return search.best_salary(view(spark, sf, "b_salary")).select("job_id", "source_id", "low", "high")


@_query(
    """SELECT job_id, city FROM b_job WHERE expired_at IS NULL AND contains(lower(city), 'ion_1') AND remote_type = 'REMOTE'
    AND job_id IN (SELECT job_id FROM b_salary WHERE coalesce(high, low) * CASE period WHEN 'MONTH' THEN 12.0 ELSE 1.0 END >= 60000)"""
)
def salary_filter_semi(spark, sf):
    return search.find(view(spark, sf, "b_job"), salaries=view(spark, sf, "b_salary"), city="ION_1", remote="REMOTE", least_pay=60000.0).select("job_id", "city")


@_query("SELECT job_id, province FROM b_job WHERE expired_at IS NULL AND job_id IN (SELECT job_id FROM b_record JOIN b_source USING (source_id) WHERE owned)")
def source_type_semi(spark, sf):
    found = search.find(view(spark, sf, "b_job"), records=view(spark, sf, "b_record"), sources=view(spark, sf, "b_source"), owned=True)
    return found.select("job_id", "province")


@_query("SELECT job_id, price FROM b_job WHERE expired_at IS NULL AND province = 'ASIA' ORDER BY price DESC NULLS LAST, job_id LIMIT 20 OFFSET 20")
def search_sorted_page(spark, sf):
    found = search.find(view(spark, sf, "b_job"), province="ASIA")
    return search.page(found, F.desc_nulls_last("price"), number=2).select("job_id", "price")


@_query("SELECT province, count(*) AS total FROM b_job WHERE expired_at IS NULL GROUP BY province")
def search_total(spark, sf):
    return search.find(view(spark, sf, "b_job")).groupBy("province").agg(F.count("*").alias("total"))


@_query("SELECT job_id, count(DISTINCT coalesce(CAST(user_id AS VARCHAR), '#' || report_id)) AS reporters FROM b_report WHERE status = 'PENDING' GROUP BY job_id")
def reporters_distinct(spark, sf):
    return signals.distinct_reporters(view(spark, sf, "b_report"))


@_query("SELECT employer_id, strftime(max(last_success_at), '%Y-%m-%d') AS checked_at, count(*) AS boards FROM b_source WHERE owned GROUP BY employer_id")
def board_last_check(spark, sf):
    return signals.last_board_check(view(spark, sf, "b_source")).select("employer_id", _day("checked_at"), "boards")


@_query("SELECT job_id FROM b_record WHERE expired_at IS NULL GROUP BY job_id HAVING count(*) >= 2 AND count(DISTINCT title_stem) = 1 AND count(DISTINCT location_key) = 1")
def consistency(spark, sf):
    return signals.consistent(view(spark, sf, "b_record"))


@_query(
    """SELECT a.job_id, a.source_id AS source_a, b.source_id AS source_b FROM (SELECT *, low * f AS lo, high * f AS hi FROM (SELECT *, CASE period WHEN 'YEAR' THEN 1.0 WHEN 'MONTH' THEN 12.0 END AS f FROM b_salary)) a
    JOIN (SELECT *, low * f AS lo, high * f AS hi FROM (SELECT *, CASE period WHEN 'YEAR' THEN 1.0 WHEN 'MONTH' THEN 12.0 END AS f FROM b_salary)) b
    ON a.job_id = b.job_id AND a.currency = b.currency AND a.source_id < b.source_id
    WHERE a.lo * CAST(0.9 AS DOUBLE) > b.hi * CAST(1.1 AS DOUBLE) OR b.lo * CAST(0.9 AS DOUBLE) > a.hi * CAST(1.1 AS DOUBLE)"""
)
def salary_conflict(spark, sf):
    return signals.salary_conflicts(view(spark, sf, "b_salary"))


@_query(
    "SELECT job_id, source_id, low * f AS annual_low, high * f AS annual_high FROM (SELECT *, CASE period WHEN 'YEAR' THEN 1.0 WHEN 'MONTH' THEN 12.0 END AS f FROM b_salary) WHERE f IS NOT NULL"
)
def salary_annualized(spark, sf):
    low, high, period = F.col("low"), F.col("high"), F.col("period")
    s = view(spark, sf, "b_salary").where("period IS NOT NULL")
    return s.select("job_id", "source_id", pay.annual_low(low, high, period).alias("annual_low"), pay.annual_high(low, high, period).alias("annual_high"))


@_query("SELECT strftime(ts, '%Y-%m-%d') AS day, name, count(*) AS n, count(DISTINCT user_id) AS users FROM b_event GROUP BY 1, 2")
def event_daily(spark, sf):
    return accounts.daily_events(view(spark, sf, "b_event")).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@_query(
    """SELECT source_id, count(*) AS fetched, count(*) FILTER (WHERE job_id % 10 > 1) AS upserted, count(*) FILTER (WHERE job_id % 10 = 1) AS skipped,
    count(*) FILTER (WHERE job_id % 10 = 0) AS errored, CASE WHEN count(*) FILTER (WHERE job_id % 10 = 0) = 0 THEN 'SUCCEEDED'
    WHEN count(*) FILTER (WHERE job_id % 10 > 0) > 0 THEN 'PARTIAL' ELSE 'FAILED' END AS status FROM b_record GROUP BY source_id"""
)
def run_summary(spark, sf):
    outcome = F.when(F.col("job_id") % 10 == 0, "ERRORED").when(F.col("job_id") % 10 == 1, "SKIPPED").otherwise("UPSERTED")
    return accounts.run_summary(view(spark, sf, "b_record").withColumn("outcome", outcome))


@_query(
    "SELECT l_suppkey AS source_id, sha256(l_returnflag || ':' || l_linestatus || ':' || CAST(l_linenumber AS VARCHAR)) AS content_hash, count(*) AS sightings, strftime(max(l_shipdate), '%Y-%m-%d') AS fetched_at FROM lineitem GROUP BY 1, 2"
)
def landing_dedup(spark, sf):
    raw = spark.read.parquet(f"{sf}/lineitem.parquet").select(
        F.col("l_suppkey").alias("source_id"),
        F.lit("feed").alias("external_ref"),
        F.concat_ws(":", "l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("payload"),
        F.col("l_shipdate").cast("timestamp").alias("fetched_at"),
    )
    return upsert.land(raw).select("source_id", "content_hash", "sightings", _day("fetched_at"))


@_query(
    """SELECT coalesce(c.job_id, s.job_id) AS job_id, CASE WHEN w THEN s.priority ELSE c.priority END AS priority,
    CASE WHEN c.job_id IS NULL THEN 'NEW' WHEN w THEN 'OVERWRITTEN' WHEN s.job_id IS NOT NULL THEN 'SEEN' ELSE 'KEPT' END AS change, strftime(CASE WHEN w THEN NULL ELSE c.expired_at END, '%Y-%m-%d') AS expired_at
    FROM (SELECT *, s_id IS NOT NULL AND (c_id IS NULL OR owned_source OR (known AND c_id NOT IN (SELECT job_id FROM b_record JOIN b_source USING (source_id) WHERE owned AND expired_at IS NULL))) AS w
    FROM (SELECT job_id AS c_id FROM b_job WHERE job_id % 5 <> 0) FULL JOIN (SELECT job_id AS s_id, job_id % 3 = 0 AS owned_source, job_id % 7 < 4 AS known FROM b_job WHERE job_id % 4 <> 1) ON c_id = s_id)
    LEFT JOIN (SELECT job_id, priority, expired_at FROM b_job) c ON c.job_id = c_id LEFT JOIN (SELECT job_id, 'staged ' || priority AS priority FROM b_job) s ON s.job_id = s_id"""
)
def canonical_precedence(spark, sf):
    jobs = view(spark, sf, "b_job").select("job_id", "priority", "last_seen", "expired_at")
    kind = F.when(F.col("job_id") % 7 < 4, "SAME_SOURCE_RECORD").otherwise("MERGE")
    staged = jobs.where("job_id % 4 <> 1").withColumns({"priority": F.concat(F.lit("staged "), "priority"), "owned_source": F.col("job_id") % 3 == 0, "decision": kind})
    backed = upsert.owned_jobs(view(spark, sf, "b_record"), view(spark, sf, "b_source"))
    return upsert.merge_jobs(jobs.where("job_id % 5 <> 0"), staged, backed, ["priority"]).select("job_id", "priority", "change", _day("expired_at"))


@_query(
    """SELECT host, CASE WHEN host IN ('jobbank.gc.ca', 'guichetemplois.gc.ca') THEN 'PUBLIC' ELSE 'OTHER' END AS kind, count(*) AS pages
    FROM (SELECT regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)', 1)), '^www[.]', '') AS host FROM pages) GROUP BY 1, 2"""
)
def host_pages(spark, sf):
    host = urls.hostname(F.col("url"))
    kind = F.when(urls.is_hiring_system(F.col("host")), "HIRING").when(urls.is_public_board(F.col("host")), "PUBLIC").otherwise("OTHER")
    return spark.read.parquet(f"{sf}/pages.parquet").select(host.alias("host")).groupBy("host", kind.alias("kind")).agg(F.count("*").alias("pages"))


@_query(
    """SELECT id, CASE WHEN regexp_matches(s, 'intern(ship)?|co-?op\\b|student') THEN 'INTERNSHIP' WHEN regexp_matches(s, 'seasonal|summer') THEN 'SEASONAL'
    WHEN regexp_matches(s, 'contract|contractor|freelance|fixed[- ]term') THEN 'CONTRACT' WHEN regexp_matches(s, 'temp(orary)?\\b') THEN 'TEMPORARY'
    WHEN regexp_matches(s, 'part[- ]?time') THEN 'PART_TIME' WHEN regexp_matches(s, 'full[- ]?time|permanent|regular') THEN 'FULL_TIME' ELSE 'UNKNOWN' END AS employment
    FROM (SELECT id, lower(coalesce(kind, '') || ' ' || title) AS s FROM b_title)"""
)
def employment_type(spark, sf):
    return view(spark, sf, "b_title").select("id", normalize.employment_type(F.col("kind"), F.col("title")).alias("employment"))


@_query("SELECT user_id, event_id % 50 AS job_id, count(*) % 2 = 1 AS saved FROM events WHERE event_type = 'click' GROUP BY 1, 2")
def saved_state(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").where("event_type = 'click'")
    return accounts.saved_state(e.select("user_id", (F.col("event_id") % 50).alias("job_id")))


@_query(
    """SELECT report_id, user_id FROM b_report WHERE report_id % 6 <> 0 AND coalesce(user_id % 9 <> 0, true)"""
)
def purge_and_erasure(spark, sf):
    reports = view(spark, sf, "b_report").withColumn("check_id", F.col("report_id") % 6)
    checks = spark.range(6).select(F.col("id").alias("check_id"), F.when(F.col("id") == 0, _now() - F.expr("INTERVAL 1 DAY")).otherwise(_now()).alias("expires_at"))
    kept = accounts.purge_expired(checks, reports, _now())[1]
    erased = reports.where("user_id % 9 = 0").select("user_id").distinct()
    return accounts.erase(kept, erased, cascade=True).select("report_id", "user_id")


@_query(
    f"""SELECT employer_id, after AS identity, after <> identity AS changed FROM (SELECT *, CASE WHEN NOT counts THEN CASE WHEN identity = 'UNKNOWN' THEN 'PROBABLE' ELSE identity END
    WHEN employer_id % 4 = 0 THEN 'CONFIRMED' WHEN employer_id % 4 = 1 THEN 'PROBABLE'
    WHEN identity = 'CONFIRMED' AND coalesce(proof_at > {_TS} - INTERVAL 30 DAY, false) THEN 'CONFIRMED' ELSE 'PROBABLE' END AS after
    FROM (SELECT *, employer_id % 4 <> 3 AND (identity_checked_at IS NULL OR identity_checked_at < {_TS} - INTERVAL 24 HOUR) AS counts FROM b_employer))"""
)
def identity_transition(spark, sf):
    employers = view(spark, sf, "b_employer")
    kind = F.col("employer_id") % 4
    probes = employers.where(kind != 3).select("employer_id", F.when(kind == 0, True).when(kind == 1, False).alias("linked"))
    return identity.transition(employers, probes, _now()).select("employer_id", "identity", "changed")


@_query(
    """SELECT lower(replace(substr(name, 1, length(name) - 5), '#', '-')) AS slug, name AS display_name, 'UNKNOWN' AS identity FROM b_employer WHERE identity <> 'CONFIRMED'"""
)
def employer_create(spark, sf):
    employers = view(spark, sf, "b_employer")
    aliases = employers.where("identity = 'CONFIRMED'").select("employer_id", normalize.employer_key(F.col("name")).alias("alias_normalized"))
    return identity.new_employers(employers.select("name"), aliases)


@_query(
    """SELECT posting_id, CASE WHEN score >= 0.6 THEN candidate_id END AS candidate_id, score,
    CASE WHEN score < 0.6 THEN 'NEW' WHEN score >= 0.85 AND why = '' THEN 'MERGE' ELSE 'REVIEW' END AS decision,
    CASE WHEN score < 0.6 OR (score >= 0.85 AND why = '') THEN NULL WHEN why = '' THEN 'alike, but not enough to merge' ELSE why END AS reason
    FROM (SELECT *, concat_ws('; ', CASE WHEN same_source THEN 'this source lists a posting like it, perhaps another opening' END,
    CASE WHEN NOT employer_owned AND posting_id % 4 > 1 THEN 'link host ' || coalesce(apply_host, 'none') || ' is not known for the employer or the other posting' END,
    CASE WHEN NOT employer_owned AND posting_id % 6 = 0 THEN 'text asks for payment or contact elsewhere' END) AS why FROM b_scored)"""
)
def dedup_guards(spark, sf):
    return dedup.guard(view(spark, sf, "b_scored").withColumn("trusted_hosts", F.array(F.lit("acmecorp.com"))))


@_query(
    """SELECT CAST(candidate_id AS VARCHAR) || '-' || CAST(posting_id AS VARCHAR) AS cluster_id, CASE WHEN score >= 0.85 THEN 'AUTO_MERGED' ELSE 'REVIEW_REQUIRED' END AS status, score,
    unnest([posting_id, candidate_id]) AS posting_id FROM b_scored WHERE score >= 0.6"""
)
def cluster_members(spark, sf):
    kind = F.when(F.col("score") >= dedup.MERGE, "MERGE").when(F.col("score") >= dedup.REVIEW, "REVIEW").otherwise("NEW")
    return dedup.cluster_members(view(spark, sf, "b_scored").withColumn("decision", kind))


@_query(
    """SELECT job_id, CASE job_id % 6 WHEN 0 THEN NULL WHEN 3 THEN 'HIGH_RISK' ELSE CASE WHEN job_id % 4 = 0 THEN 'VERIFIED' END END AS override_status,
    CASE WHEN job_id % 6 = 3 THEN 'seen twice' END AS override_note FROM b_order"""
)
def override_apply(spark, sf):
    jobs = view(spark, sf, "b_order").select("job_id", F.when(F.col("job_id") % 4 == 0, "VERIFIED").alias("override_status"), F.lit(None).cast("string").alias("override_note"))
    chosen = jobs.where("job_id % 3 = 0").select("job_id")
    old = chosen.select((F.col("job_id") * 2).alias("decision_id"), "job_id", F.lit("STALE").alias("status"), F.lit("old").alias("note"), _now().alias("decided_at"))
    kind = F.when(F.col("job_id") % 2 == 0, "CLEAR").otherwise("HIGH_RISK")
    new = chosen.select((F.col("job_id") * 2 + 1).alias("decision_id"), "job_id", kind.alias("status"), F.lit(" seen twice ").alias("note"), _now().alias("decided_at"))
    return decisions.override_status(jobs, old.unionByName(new))


@_query(
    """SELECT CASE WHEN job_id IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey % 3 <> 0) THEN job_id + 1000000000 ELSE job_id END AS job_id, source_id,
    CASE WHEN source_id % 2 = 0 OR source_id % 3 = 0 THEN source_id END AS cluster_id FROM b_record"""
)
def clusters_resolve(spark, sf):
    records = view(spark, sf, "b_record").select("job_id", "source_id", F.col("source_id").alias("cluster_id"))
    n = F.col("source_id")
    sources = view(spark, sf, "b_source")
    clusters = sources.select(n.alias("cluster_id"), F.when(n % 3 == 0, "RESOLVED").otherwise("REVIEW_REQUIRED").alias("status"))
    made = sources.select(
        n.alias("decision_id"), n.alias("cluster_id"), F.when(n % 2 == 0, "MERGE").otherwise("KEEP_SEPARATE").alias("action"),
        n.cast("long").alias("drop_job_id"), (n.cast("long") + 1_000_000_000).alias("keep_job_id"), _now().alias("decided_at"),
    )
    return decisions.resolve_clusters(clusters, records, made, _now())[1]


@_query(
    "SELECT report_id, status AS before, CASE report_id % 8 WHEN 0 THEN 'UPHELD' WHEN 4 THEN 'DISMISSED' END AS after, 'RESOLVE_REPORT' AS action FROM b_report WHERE status = 'PENDING' AND report_id % 4 = 0"
)
def reports_resolve(spark, sf):
    reports_ = view(spark, sf, "b_report")
    kind = F.when(F.col("report_id") % 8 == 0, "UPHELD").otherwise("DISMISSED")
    made = reports_.where("report_id % 4 = 0").select(F.col("report_id").alias("decision_id"), "report_id", kind.alias("decision"), _now().alias("decided_at"))
    trail = decisions.audit(reports_, decisions.resolve_reports(reports_, made), "report_id", "status", "RESOLVE_REPORT", _now())
    return trail.select(F.col("entity_id").cast("long").alias("report_id"), "before", "after", "action")


@_query(
    """SELECT check_id, regexp_extract(text, '(?im)^title: (.+)$|^Job title: (.+)$', 2) AS title, CASE WHEN check_id % 4 = 0 THEN 'Acme' ELSE regexp_extract(text, '(?m)^Company - (.+)$', 1) END AS employer_name,
    'Toronto' AS place, 'https://apply.example.com/' || CAST(check_id AS VARCHAR) AS apply_url FROM b_pasted"""
)
def pasted_fields(spark, sf):
    return checks.fields(view(spark, sf, "b_pasted")).select("check_id", "title", "employer_name", "place", "apply_url")


@_query(
    """SELECT check_id, job_id, score, score >= 0.85 AS is_strong FROM (SELECT *, row_number() OVER (PARTITION BY check_id ORDER BY score DESC, job_id) AS r FROM (
    SELECT c.job_id AS check_id, j.job_id, floor(least(greatest(0.6::DOUBLE + CASE WHEN c.city = j.city THEN 0.25::DOUBLE WHEN c.city IS NULL AND j.city IS NULL THEN 0.1::DOUBLE
    WHEN c.city IS NOT NULL AND j.city IS NOT NULL THEN -0.3::DOUBLE ELSE 0 END
    + CASE WHEN o >= 0.9 THEN 0.25::DOUBLE WHEN o >= 0.5 THEN 0.1::DOUBLE ELSE -0.3::DOUBLE END, 0), 1) * 10000 + 0.5) / 10000 AS score
    FROM (SELECT c.job_id AS c_id, j.job_id AS j_id, greatest(least(c.hi + 1000, j.hi) - greatest(c.lo + 1000, j.lo), 0) / (greatest(c.hi + 1000, j.hi) - least(c.lo + 1000, j.lo)) AS o
    FROM b_listing c JOIN b_listing j ON c.employer_id = j.employer_id AND c.title_stem = j.title_stem AND j.expired_at IS NULL) p
    JOIN b_listing c ON c.job_id = c_id JOIN b_listing j ON j.job_id = j_id)) WHERE r = 1"""
)
def check_match(spark, sf):
    listings = view(spark, sf, "b_listing")
    asked = listings.withColumnRenamed("job_id", "check_id").withColumns({"lo": F.col("lo") + 1000, "hi": F.col("hi") + 1000}).drop("expired_at")
    return checks.match(asked, listings)


@_query(
    """SELECT job_id AS posting_id, CASE job_id % 5 WHEN 2 THEN 'This is an existing vacancy.' WHEN 3 THEN 'Join our talent pool.' WHEN 4 THEN 'Good team.' END AS vacancy_statement,
    job_id % 5 = 4 AS derived, CASE WHEN job_id % 5 = 4 THEN 'm1' END AS model FROM b_text"""
)
def vacancy_evidence(spark, sf):
    postings = view(spark, sf, "b_text").withColumnRenamed("job_id", "posting_id")
    return evidence.vacancies(postings, postings.select("posting_id", F.lit("Good team.").alias("value"), F.lit("m1").alias("model")))


@_query(
    """SELECT page_id AS link_id, NOT starts_with(path, '/en/') OR starts_with(path, '/en/1') AS allowed
    FROM (SELECT page_id, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+(/[^?#]*)?', 1) AS path FROM pages)"""
)
def robots_allowed(spark, sf):
    links = spark.read.parquet(f"{sf}/pages.parquet").select(F.col("page_id").alias("link_id"), urls.hostname(F.col("url")).alias("host"), F.try_parse_url("url", F.lit("PATH")).alias("path"))
    body = "# rules\nUser-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /en/\nAllow: /en/1*\n"
    files = links.where("host IS NOT NULL").select("host").distinct().withColumn("body", F.lit(body))
    return robots.allowed(links, robots.rules(files, "postledger/1.0"))


@_query(
    f"""SELECT r.job_id, CASE WHEN s.job_id IS NULL THEN 'Salary not disclosed' ELSE '$' || CASE WHEN low <> high THEN format('{{:,}}', low) || '–$' ELSE '' END || format('{{:,}}', high)
    || coalesce(' / ' || lower(period), '') END AS pay, CASE WHEN last_verified IS NULL THEN 'never' WHEN date_diff('day', last_verified, {_TS}) <= 0 THEN 'today'
    WHEN date_diff('day', last_verified, {_TS}) = 1 THEN '1 day ago' ELSE date_diff('day', last_verified, {_TS}) || ' days ago' END AS confirmed,
    coalesce(last_verified < {_TS} - INTERVAL 7 DAY, false) AS may_be_closed, 'Found on ' || active_sources || CASE WHEN active_sources = 1 THEN ' source' ELSE ' sources' END AS found_on,
    coalesce(t.caution, false) AS caution
    FROM b_rollup r LEFT JOIN (SELECT job_id, CAST(floor(low) AS BIGINT) AS low, CAST(floor(high) AS BIGINT) AS high, period, row_number() OVER
    (PARTITION BY job_id ORDER BY b_salary.high DESC NULLS LAST, b_salary.low DESC NULLS LAST, source_id) AS n FROM b_salary) s ON r.job_id = s.job_id AND n = 1
    LEFT JOIN (SELECT job_id, job_id % 6 = 2 OR (job_id % 6 = 3 AND employer_id IN (SELECT employer_id FROM b_domain)) AS caution FROM b_text) t ON r.job_id = t.job_id"""
)
def job_cards(spark, sf):
    best = search.best_salary(view(spark, sf, "b_salary")).withColumns({"low": F.floor("low"), "high": F.floor("high")})
    said = signals.text_signals(view(spark, sf, "b_text").withColumn("employer_name", F.lit("Acme")), view(spark, sf, "b_domain"), _now())
    return reports.cards(view(spark, sf, "b_rollup"), best, said, _now()).drop("n_positive", "n_negative")


@_query(
    """SELECT user_id, 'saved' AS section, '{"job_id":' || event_id % 50 || '}' AS item FROM events WHERE event_type = 'click' AND user_id IS NOT NULL
    UNION ALL SELECT user_id, 'reports', '{"report_id":' || report_id || ',"status":"' || status || '"}' FROM b_report WHERE user_id IS NOT NULL"""
)
def user_export(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").where("event_type = 'click'").select("user_id", (F.col("event_id") % 50).alias("job_id"))
    told = view(spark, sf, "b_report").select("user_id", "report_id", "status", F.lit("kept private").alias("text"))
    return reports.export({"saved": e, "reports": told})


_MOVES = """SELECT job_id, CASE WHEN job_id % 10 IN (1, 2, 3, 6) THEN job_id + 1 WHEN job_id % 10 IN (7, 8) THEN job_id - 1 END AS onto FROM b_order WHERE job_id % 10 IN (1, 2, 3, 6, 7, 8) AND employer_id % 5 <> 0"""


@_query(
    f"""SELECT job_id, onto FROM (SELECT w.job_id, CASE WHEN m.job_id IS NULL THEN here ELSE list_min(path[list_position(path, here):]) END AS onto FROM walk w LEFT JOIN moves m ON m.job_id = w.here
    WHERE m.job_id IS NULL OR list_contains(path, here)) WHERE job_id <> onto""",
    tables=f"""moves AS ({_MOVES}), walk AS (WITH RECURSIVE go AS (SELECT job_id, onto AS here, [job_id] AS path FROM moves
    UNION ALL SELECT go.job_id, m.onto, list_append(path, here) FROM go JOIN moves m ON m.job_id = go.here WHERE NOT list_contains(path, here)) SELECT * FROM go)""",
)
def merge_chains(spark, sf):
    """Where merged jobs end: chains of three, circles of two and jobs that lead into a circle."""
    last = F.col("job_id") % 10
    onto = F.when(last.isin(1, 2, 3, 6), F.col("job_id") + 1).when(last.isin(7, 8), F.col("job_id") - 1)
    moves = view(spark, sf, "b_order").where("job_id % 10 IN (1, 2, 3, 6, 7, 8) AND employer_id % 5 <> 0").select("job_id", onto.alias("to"))
    return decisions.final_moves(moves).withColumnRenamed("to", "onto")


@_query("SELECT event_id, name, user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, strftime(ts, '%Y-%m-%d') AS day FROM b_track")
def events_append(spark, sf):
    """Events appended in two overlapping batches, the first of them twice."""
    path = f"{store.shared_dir(spark)}/events-{uuid.uuid4().hex}"
    found = view(spark, sf, "b_track")
    for part in ("event_id % 3 < 2", "event_id % 3 < 2", "event_id % 3 > 0"):
        events.append(found.where(part), path)
    return events.read(spark, path).select("event_id", "name", "user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), _day("day"))


_DERIVED = """SELECT a.job_id AS posting_id, m.model, m.preference, m.version, CASE m.model WHEN 'm1' THEN split_part(description, '.', 1) WHEN 'm2' THEN CASE WHEN a.job_id % 2 = 0 THEN split_part(description, '.', 2)
    ELSE upper(split_part(description, '.', 1)) || '!' END ELSE split_part(description, ' ', 1) END AS value, description
    FROM b_advert a CROSS JOIN (VALUES ('m1', 2, 1), ('m1', 2, 2), ('m2', 1, 1), ('m3', 9, 1)) m(model, preference, version)"""


@_query(
    f"""SELECT posting_id, 'vacancy' AS kind, value, model, version FROM (SELECT *, row_number() OVER (PARTITION BY posting_id ORDER BY preference, version DESC, value) AS r FROM ({_DERIVED})
    WHERE model <> 'm3' AND value <> '' AND contains(description, value)) WHERE r = 1"""
)
def derived_statements(spark, sf):
    """Statements of two models over whole adverts: the preferred one is refused where the text does not contain its words; a third model is not listed."""
    text_ = F.col("text")
    part = lambda sep, n: F.split_part(text_, F.lit(sep), F.lit(n))
    ads = view(spark, sf, "b_advert").select(F.col("job_id").alias("posting_id"), F.col("description").alias("text"))
    second = F.when(F.col("posting_id") % 2 == 0, part(".", 2)).otherwise(F.concat(F.upper(part(".", 1)), F.lit("!")))
    made = F.array(*(F.struct(F.lit(m).alias("model"), F.lit(v).alias("version"), c.alias("value")) for m, v, c in (("m1", 1, part(".", 1)), ("m1", 2, part(".", 1)), ("m2", 1, second), ("m3", 1, part(" ", 1)))))
    derived = ads.select("posting_id", F.lit("vacancy").alias("kind"), _now().alias("derived_at"), F.explode(made).alias("d")).select("posting_id", "kind", "derived_at", "d.*")
    models = spark.createDataFrame([("m1", 2), ("m2", 1)], "model string, preference int")
    return evidence.chosen(ads, derived, models)
