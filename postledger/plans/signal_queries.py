"""Signals with their evidence, the status rules over all fifteen, and duplicate decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from postledger.functions import text, urls
from postledger.operators import dedup, freshness, incremental, signals
from postledger.plans.binding import view, with_views
from postledger.plans.registry import SQL, TS, day, now, query, re2
from postledger.sources import store


def _first_sentence(risky: str) -> str:
    """SQL: the first sentence of t that is risky and denies nothing."""
    cut = r"string_split(regexp_replace(replace(regexp_replace(t, '\s+', ' ', 'g'), '•', chr(1)), '([.!?]) +', '\1' || chr(1), 'g'), chr(1))"
    return f"list_filter(list_transform({cut}, lambda s: trim(s)), lambda s: s <> '' AND NOT regexp_matches(s, {re2(text.NEGATION)}) AND ({risky}))[1]"


_OFF = f"regexp_matches(s, {re2(text._WORD.format('|'.join(text.OFF_PLATFORM)))}) OR regexp_matches(s, {re2(text.PERSONAL_EMAIL)})"
_PAYS = " OR ".join(f"regexp_matches(s, {re2(text._WORD.format(p))})" for p in text.PAYMENT)
_ATS = ", ".join(f"'{h}'" for h in urls.HIRING_SYSTEMS)


def _ago(then: str) -> str:
    h = f"floor(date_diff('second', {then}, {TS}) / 3600.0 + 0.5)"
    return (
        f"(CASE WHEN {h} < 1 THEN 'less than an hour ago' WHEN {h} = 1 THEN '1 hour ago' WHEN {h} < 48 THEN CAST(CAST({h} AS BIGINT) AS VARCHAR) || ' hours ago' "
        f"ELSE CAST(CAST(floor({h} / 24.0 + 0.5) AS BIGINT) AS VARCHAR) || ' days ago' END)"
    )


def _row(code: str, says: str, at: str = TS, url: str = "NULL", source: str = "NULL", weight: str | None = None) -> str:
    weight = weight or str(signals.WEIGHTS[code])
    return f"SELECT job_id, '{code}' AS code, {weight} AS weight, {says} AS evidence_text, CAST({url} AS VARCHAR) AS evidence_url, {at} AS observed_at, CAST({source} AS BIGINT) AS source_id FROM"


_SIGNALS = f"""
own AS (SELECT * FROM (SELECT job_id, source_id, source_name, url, last_verified, row_number() OVER (PARTITION BY job_id ORDER BY source_id) AS n
    FROM b_record JOIN b_source USING (source_id) WHERE expired_at IS NULL AND owned) WHERE n = 1),
board AS (SELECT employer_id, max(last_success_at) AS checked_at FROM b_source WHERE owned GROUP BY employer_id HAVING max(last_success_at) IS NOT NULL),
ann AS (SELECT *, low * f AS lo, high * f AS hi FROM (SELECT *, CASE period WHEN 'YEAR' THEN 1.0 WHEN 'MONTH' THEN 12.0 END AS f FROM b_salary) WHERE f IS NOT NULL),
pairs AS (SELECT a.job_id, a.currency, a.evidence AS one, b.evidence AS other, row_number() OVER (PARTITION BY a.job_id ORDER BY a.currency, a.hi, a.source_id, b.lo DESC, b.source_id DESC) AS n
    FROM ann a JOIN ann b ON a.job_id = b.job_id AND a.currency = b.currency AND a.source_id <> b.source_id AND b.lo * CAST(0.9 AS DOUBLE) > a.hi * CAST(1.1 AS DOUBLE)),
clash AS (SELECT * FROM pairs WHERE n = 1),
hosted AS (SELECT * FROM (SELECT job_id, source_id, evidence, row_number() OVER (PARTITION BY job_id ORDER BY source_id) AS n FROM b_salary JOIN b_source USING (source_id) WHERE owned) WHERE n = 1),
same AS (SELECT job_id, count(*) AS n FROM b_record WHERE expired_at IS NULL GROUP BY job_id HAVING count(*) >= 2 AND count(DISTINCT title_stem) = 1 AND count(DISTINCT location_key) = 1),
rep AS (SELECT job_id, count(DISTINCT coalesce(CAST(user_id AS VARCHAR), '#' || report_id)) AS n FROM b_report WHERE status = 'PENDING' GROUP BY job_id HAVING n >= 3),
link AS (SELECT job_id, employer_id, employer_name, apply_url, regexp_replace(lower(regexp_extract(apply_url, '^[a-z]+://([^/:?#]+)', 1)), '^www[.]', '') AS host FROM b_case WHERE apply_url IS NOT NULL),
site AS (SELECT DISTINCT host, regexp_extract(host, '[^.]+[.][^.]+$') AS reg, replace(regexp_extract(host, '([^.]+)[.][^.]+$', 1), '-', '') AS brand FROM link
    WHERE regexp_extract(host, '[^.]+[.][^.]+$') NOT IN ({_ATS}) AND host NOT IN ('jobbank.gc.ca', 'guichetemplois.gc.ca')),
like_ AS (SELECT host, domain FROM (SELECT host, domain, row_number() OVER (PARTITION BY host ORDER BY levenshtein(brand, b), domain) AS n
    FROM site JOIN (SELECT DISTINCT domain, replace(split_part(domain, '.', 1), '-', '') AS b FROM b_firm_domain) ON length(b) >= 5 AND (levenshtein(brand, b) <= 2 OR contains(brand, b))
    WHERE reg NOT IN (SELECT domain FROM b_firm_domain)) WHERE n = 1),
led AS (SELECT l.*, i.domain AS imitates, EXISTS (SELECT 1 FROM b_firm_domain d WHERE d.employer_id = l.employer_id) AS has_domain,
    EXISTS (SELECT 1 FROM b_firm_domain d WHERE d.employer_id = l.employer_id AND (l.host = d.domain OR ends_with(l.host, '.' || d.domain))) AS own,
    regexp_extract(l.host, '[^.]+[.][^.]+$') IN ({_ATS}) AS ats, l.host IN ('jobbank.gc.ca', 'guichetemplois.gc.ca') AS public FROM link l LEFT JOIN like_ i ON l.host = i.host),
said AS (SELECT job_id, {_first_sentence(_OFF)} AS off, {_first_sentence(_PAYS)} AS pays, trim(regexp_replace(regexp_extract(t, {re2(text.VACANCY)}), '\\s+', ' ', 'g')) AS vacancy
    FROM (SELECT job_id, text AS t FROM b_case)),
sig AS (
{_row("ON_EMPLOYER_ATS", "'The employer board ' || source_name || ' lists it.'", f"coalesce(last_verified, {TS})", "url", "source_id")} own
UNION ALL {_row("NOT_FOUND_ON_EMPLOYER_SITE", "'The board of ' || employer_name || ' was read ' || " + _ago("checked_at") + " || ' and does not list it.'", "checked_at")} b_case JOIN board USING (employer_id) WHERE job_id NOT IN (SELECT job_id FROM own)
UNION ALL {_row("EMPLOYER_IDENTITY_CONFIRMED", "coalesce(identity_text, 'The site of ' || employer_name || ' points to this board.')", f"coalesce(identity_at, {TS})", "identity_url")} b_case
    WHERE identity = 'CONFIRMED' AND (job_id IN (SELECT job_id FROM own) OR job_id IN (SELECT job_id FROM led WHERE own))
UNION ALL {_row("LOOKALIKE_DOMAIN", "'Applications go to ' || host || ', which resembles ' || imitates || '.'", url="apply_url")} led WHERE imitates IS NOT NULL
UNION ALL {_row("APPLY_URL_ON_EMPLOYER_OR_KNOWN_ATS", "'Applications go to ' || host || CASE WHEN own THEN ', a domain of the employer.' WHEN ats THEN ', a common hiring system.' ELSE ', a public job board.' END", url="apply_url")} led
    WHERE imitates IS NULL AND (own OR ats OR public)
UNION ALL {_row("APPLY_URL_MISMATCH", "'Applications go to ' || host || ', neither a domain of ' || employer_name || ' nor a known hiring system.'", url="apply_url")} led WHERE imitates IS NULL AND NOT (own OR ats OR public) AND has_domain
UNION ALL {_row("OFF_PLATFORM_CONTACT", "'“' || off || '”'")} said WHERE off IS NOT NULL
UNION ALL {_row("UPFRONT_PAYMENT_REQUEST", "'“' || pays || '”'")} said WHERE pays IS NOT NULL
UNION ALL {_row("VACANCY_STATUS_DISCLOSED", "'“' || vacancy || '”'")} said WHERE vacancy <> ''
UNION ALL {_row("RECENTLY_CONFIRMED_LIVE", "'Confirmed ' || " + _ago("last_verified") + " || '.'", "last_verified")} b_case WHERE last_verified >= {TS} - INTERVAL 72 HOUR
UNION ALL {_row("STALE", "CASE WHEN last_verified IS NOT NULL THEN 'Confirmed ' || " + _ago("last_verified") + " || '.' ELSE 'Seen first ' || " + _ago("first_seen") + " || ' and not confirmed since.' END")} b_case
    WHERE expired_at IS NULL AND coalesce(last_verified, first_seen) < {TS} - INTERVAL 14 DAY
UNION ALL {_row("SALARY_STATED_BY_EMPLOYER", "'“' || evidence || '”'", source="source_id")} hosted
UNION ALL {_row("SALARY_CONFLICT", "'“' || one || '” against “' || other || '”'")} clash
UNION ALL {_row("CONSISTENT_ACROSS_SOURCES", "'Title and place agree on ' || n || ' sources.'")} same WHERE job_id NOT IN (SELECT job_id FROM clash)
UNION ALL {_row("USER_REPORTS", "n || ' people reported it; staff have yet to decide.'")} rep),
kept AS (SELECT *, CASE WHEN code = 'VACANCY_STATUS_DISCLOSED' AND (regexp_matches(evidence_text, '(?i)\\b(pool|future (openings|opportunities|vacancies))\\b')
    OR regexp_matches(evidence_text, '(?i)\\bnot\\b.{{0,20}}\\bexisting vacancy\\b') OR regexp_matches(evidence_text, '(?i)\\bn[''’]est pas\\b.{{0,30}}\\bvacant\\b')) THEN 'NEUTRAL'
    WHEN weight > 0 THEN 'POSITIVE' ELSE 'NEGATIVE' END AS polarity FROM sig WHERE job_id IN (SELECT job_id FROM b_case))
"""


def with_signals(sql: str) -> str:
    """SQL over `kept`, the signals of b_case, as a further common table expression."""
    head = with_views("SELECT 1 FROM b_record, b_source, b_salary, b_case, b_report, b_firm_domain, b_override, b_open")
    return head[: head.rindex("SELECT 1")].rstrip() + ", " + _SIGNALS.strip() + sql


def cases(spark, sf, **given):
    """b_case, written once: signals read it twice, and what follows them once more."""
    return store.write(view(spark, sf, "b_case", **given))


def case_signals(spark, sf, **given):
    """b_case and its signals; given: views that are written already."""
    names = ("b_record", "b_source", "b_salary", "b_report", "b_firm_domain")
    jobs, (records, sources, salaries, reports, domains) = cases(spark, sf, **given), (view(spark, sf, n, **given) for n in names)
    return jobs, signals.compute(jobs, records, sources, salaries, reports, domains, now())


def _minute(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm").alias(c)


@query()
def signals_long(spark, sf):
    found = case_signals(spark, sf)[1]
    return found.select("job_id", "code", "polarity", "weight", "evidence_text", "evidence_url", _minute("observed_at"), "source_id")


SQL["signals_long"] = with_signals(" SELECT job_id, code, polarity, weight, evidence_text, evidence_url, strftime(observed_at, '%Y-%m-%d %H:%M') AS observed_at, source_id FROM kept")


@query()
def job_status(spark, sf):
    jobs, found = case_signals(spark, sf)
    # every other job does not know that its records are gone
    told = jobs.withColumn("expired_at", F.expr("CASE WHEN job_id % 2 = 1 THEN expired_at END"))
    return signals.status(told, found, view(spark, sf, "b_override"), view(spark, sf, "b_open"), view(spark, sf, "b_record"))


def _two_runs(spark, sf):
    """Jobs touched by records seen since June, and all signals after a full run without those records and a run over the touched jobs."""
    jobs, (records, sources, salaries, reports, domains) = cases(spark, sf), (view(spark, sf, n) for n in ("b_record", "b_source", "b_salary", "b_report", "b_firm_domain"))
    late = F.col("last_seen") >= F.lit("1998-05-01").cast("timestamp")
    touched = records.where(late).select("job_id").distinct()
    before = signals.compute(jobs, records.where(~late), sources, salaries, reports, domains, now())
    fresh = incremental.verify(touched, jobs, records, sources, salaries, reports, domains, now())
    return touched, incremental.supersede(before.withColumn("superseded_at", F.lit(None).cast("timestamp")), fresh, touched, now())


@query()
def verify_touched(spark, sf):
    found = signals.current(_two_runs(spark, sf)[1])
    return found.select("job_id", "code", "polarity", "weight", "evidence_text", "evidence_url", _minute("observed_at"), "source_id")


# two runs end where one full run ends
SQL["verify_touched"] = SQL["signals_long"]


STATUS = """, w AS (SELECT job_id, count(*) FILTER (WHERE weight < 0) AS neg, count(*) FILTER (WHERE code IN ('UPFRONT_PAYMENT_REQUEST', 'OFF_PLATFORM_CONTACT', 'LOOKALIKE_DOMAIN', 'APPLY_URL_MISMATCH')) AS scam,
    bool_or(code = 'USER_REPORTS') AS u, bool_or(code = 'SALARY_CONFLICT') AS c, bool_or(code = 'STALE') AS s,
    bool_or(code = 'ON_EMPLOYER_ATS') AS o, bool_or(code = 'EMPLOYER_IDENTITY_CONFIRMED') AS i, bool_or(code = 'RECENTLY_CONFIRMED_LIVE') AS l FROM kept GROUP BY job_id),
    d AS (SELECT j.job_id, override_status, CASE WHEN override_status IS NOT NULL THEN 'R0' WHEN expired_at IS NOT NULL OR j.job_id IN (SELECT job_id FROM b_record GROUP BY job_id HAVING bool_and(expired_at IS NOT NULL)) THEN 'R1' WHEN scam >= 2 THEN 'R2'
    WHEN scam = 1 OR u OR c OR j.job_id IN (SELECT job_id FROM b_open) THEN 'R3' WHEN s THEN 'R4' WHEN coalesce(neg, 0) = 0 AND o AND i AND l THEN 'R5'
    WHEN coalesce(neg, 0) = 0 AND (o OR i) THEN 'R6' ELSE 'R7' END AS rule FROM b_case j LEFT JOIN w ON j.job_id = w.job_id LEFT JOIN b_override v ON v.job_id = j.job_id),
    status AS (SELECT job_id, rule, CASE rule WHEN 'R0' THEN override_status WHEN 'R1' THEN 'EXPIRED' WHEN 'R2' THEN 'HIGH_RISK' WHEN 'R3' THEN 'REVIEW_REQUIRED' WHEN 'R4' THEN 'STALE' WHEN 'R5' THEN 'VERIFIED'
    WHEN 'R6' THEN 'PARTIALLY_VERIFIED' ELSE 'UNVERIFIED' END AS status FROM d)"""
SQL["job_status"] = with_signals(STATUS + " SELECT job_id, rule, status FROM status")


@query()
def apply_text_signals(spark, sf):
    found = signals.text_signals(view(spark, sf, "b_case"), view(spark, sf, "b_firm_domain"), now())
    return found.select("job_id", "code", "polarity", "weight", "evidence_text", "evidence_url")


SQL["apply_text_signals"] = with_signals(
    " SELECT job_id, code, polarity, weight, evidence_text, evidence_url FROM kept WHERE code IN ('LOOKALIKE_DOMAIN', 'APPLY_URL_ON_EMPLOYER_OR_KNOWN_ATS', 'APPLY_URL_MISMATCH', "
    "'OFF_PLATFORM_CONTACT', 'UPFRONT_PAYMENT_REQUEST', 'VACANCY_STATUS_DISCLOSED')"
)


@query()
def status_history(spark, sf):
    """The change log of a run over jobs of which every third had been checked before, as UNVERIFIED."""
    jobs, found = case_signals(spark, sf)
    current = signals.status(jobs, found, view(spark, sf, "b_override"), view(spark, sf, "b_open"))
    before = jobs.where("job_id % 3 = 0").select("job_id", F.lit("UNVERIFIED").alias("status"))
    return signals.history(before, current, now()).select("job_id", "from_status", "to_status", day("at"))


SQL["status_history"] = with_signals(
    STATUS + f" SELECT job_id, CASE WHEN job_id % 3 = 0 THEN 'UNVERIFIED' END AS from_status, status AS to_status, strftime({TS}, '%Y-%m-%d') AS at FROM status WHERE job_id % 3 <> 0 OR status <> 'UNVERIFIED'"
)


@query()
def signals_current(spark, sf):
    """Signals after a second run that touched every other job: the open ones, weightiest first."""
    found = store.write(case_signals(spark, sf)[1])  # read twice
    old = found.withColumn("superseded_at", F.lit(None).cast("timestamp"))
    both = signals.supersede(old, found.where("job_id % 2 = 0"), now())
    return signals.ordered(signals.current(both)).select("job_id", "code", "position")


SQL["signals_current"] = with_signals(" SELECT job_id, code, CAST(row_number() OVER (PARTITION BY job_id ORDER BY weight DESC, code) AS INTEGER) AS position FROM kept")


@query(
    """SELECT o.job_id, strftime(r.last_verified, '%Y-%m-%d') AS last_verified, strftime(greatest(o.first_seen, r.last_seen), '%Y-%m-%d') AS last_seen,
    strftime(CASE WHEN active_sources > 0 THEN NULL WHEN o.job_id % 2 = 0 THEN o.first_seen ELSE r.expired_at END, '%Y-%m-%d') AS expired_at
    FROM b_order o LEFT JOIN b_rollup r ON o.job_id = r.job_id WHERE r.job_id IS NOT NULL
    UNION ALL SELECT job_id, NULL, strftime(first_seen, '%Y-%m-%d'), CASE WHEN job_id % 2 = 0 THEN strftime(first_seen, '%Y-%m-%d') END FROM b_order WHERE job_id NOT IN (SELECT job_id FROM b_rollup)"""
)
def freshness_of_jobs(spark, sf):
    jobs = view(spark, sf, "b_order").select(
        "job_id", F.lit(None).cast("timestamp").alias("last_verified"), F.col("first_seen").alias("last_seen"), F.when(F.col("job_id") % 2 == 0, F.col("first_seen")).alias("expired_at")
    )
    return freshness.roll_up(jobs, view(spark, sf, "b_record")).select("job_id", day("last_verified"), day("last_seen"), day("expired_at"))


_TOKENS = "list_filter(string_split(regexp_replace(lower({}), '[^a-z0-9$]+', ' ', 'g'), ' '), lambda w: w <> '')"


def _runs(words: str) -> str:
    return f"list_distinct(list_transform(range(1, greatest(len({words}) - 2, 2)), lambda i: array_to_string({words}[i:i + 3], ' ')))"


def _share(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b})))"


_DECISIONS = f""", w AS (SELECT *, list_distinct({_TOKENS.format("title_normalized")}) AS t, {_TOKENS.format("description")} AS d,
        regexp_replace(regexp_replace(lower(url), '^https?://(www[.])?', ''), '/+$', '') AS u FROM b_posting),
    p AS (SELECT *, {_runs("d")} AS r FROM w),
    f AS (SELECT a.posting_id, b.posting_id AS candidate_id, {_share("a.t", "b.t")} AS title, {_share("a.r", "b.r")} AS description,
        CASE WHEN a.city IS NOT NULL THEN 1::DOUBLE ELSE CASE WHEN a.remote_type = b.remote_type THEN 1::DOUBLE ELSE 0.5::DOUBLE END END AS place,
        CASE WHEN a.currency = b.currency AND a.lo IS NOT NULL AND b.lo IS NOT NULL THEN greatest(least(a.hi, b.hi) - greatest(a.lo, b.lo), 0) / (greatest(a.hi, b.hi) - least(a.lo, b.lo)) END AS pay,
        CASE WHEN a.u = b.u THEN 1::DOUBLE END AS url FROM p a JOIN p b ON a.employer_id = b.employer_id AND a.title_stem = b.title_stem AND b.posting_id < a.posting_id
        AND (lower(a.city) = lower(b.city) OR (a.city IS NULL AND b.city IS NULL AND a.remote_type = b.remote_type))),
    m AS (SELECT *, (title * 0.25::DOUBLE + description * 0.35::DOUBLE + place * 0.15::DOUBLE + coalesce(pay, 0) * 0.10::DOUBLE + coalesce(url, 0) * 0.10::DOUBLE)
        / (0.75::DOUBLE + CASE WHEN pay IS NULL THEN 0 ELSE 0.10::DOUBLE END + CASE WHEN url IS NULL THEN 0 ELSE 0.10::DOUBLE END) AS raw FROM f),
    s AS (SELECT posting_id, candidate_id, floor(CASE WHEN url = 1 THEN greatest(raw, 0.95) ELSE raw END * 10000 + 0.5) / 10000 AS score FROM m),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY posting_id ORDER BY score DESC, candidate_id) AS n FROM s WHERE score >= 0.6) WHERE n = 1)
    SELECT p.posting_id, CASE WHEN p.posting_id % 11 = 0 THEN p.posting_id + 1000000000 ELSE candidate_id END AS candidate_id, CASE WHEN p.posting_id % 11 <> 0 THEN score END AS score,
    CASE WHEN p.posting_id % 11 = 0 THEN 'SAME_SOURCE_RECORD' WHEN score >= 0.85 THEN 'MERGE' WHEN score IS NOT NULL THEN 'REVIEW' ELSE 'NEW' END AS decision
    FROM b_posting p LEFT JOIN best ON p.posting_id = best.posting_id"""


@query()
def dedup_decisions(spark, sf):
    p = view(spark, sf, "b_posting")
    ready = dedup.prepare(p.withColumns({"skills": F.array().cast("array<string>"), "urls": F.array("url")}))
    known = p.where("posting_id % 11 = 0").select("source_id", "external_ref", (F.col("posting_id") + 1_000_000_000).alias("job_id"))
    return dedup.decide(dedup.scored_pairs(ready), p, known)


_HEAD = with_views("SELECT 1 FROM b_posting")
SQL["dedup_decisions"] = _HEAD[: _HEAD.rindex("SELECT 1")].rstrip() + _DECISIONS
