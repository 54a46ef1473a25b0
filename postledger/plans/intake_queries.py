"""Intake: titles, places, validation, quarantine, records and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from postledger.functions import normalize, pay, urls
from postledger.operators import accounts, intake, upsert
from postledger.plans.binding import view
from postledger.plans.registry import TS, day, now, query
from postledger.sources import store

_q = lambda values: ", ".join("'" + v.replace("'", "''") + "'" for v in values)
_SMALL = _q([*normalize.NOISE, *(p.lower() for p in normalize.PROVINCES), "nights", "days", "weekends"])
_PLACE = (
    "(k = '' OR len(list_filter(string_split(k, ' '), lambda w: w NOT IN (" + _SMALL + "))) = 0 OR k IN (" + _q([*normalize.CITIES, *normalize._NAME]) + r") OR regexp_matches(k, '^(remote|hybrid|on-?site)\b'))"
)


def _squeezed(t: str) -> str:
    return rf"trim(regexp_replace({t}, '\s+', ' ', 'g'))"


def _title_sql(source: str, key: str) -> str:
    """key, normalized and stem of the titles of a table, step by step."""
    words = "t"
    for pattern, by in normalize.ABBREVIATIONS.items():
        ended = pattern.endswith(r"(?=\s|$)")
        words = f"regexp_replace({words}, '{pattern.replace(r'(?=\s|$)', r'(\s|$)')}', '{by}{chr(92) + '1' if ended else ''}', 'g')"
    stop = _q([*normalize.SENIORITY, *normalize.NOISE])
    return (
        rf"WITH a AS (SELECT {key}, string_split_regex(regexp_replace(regexp_replace(lower(strip_accents(title)), '\([^)]*\)|\[[^\]]*\]', ' ', 'g'), '[–—]', '-', 'g'), '\s+[-|/]\s+|,\s*') AS p FROM {source}), "
        rf"b AS (SELECT {key}, p[1] AS head, unnest(CASE WHEN len(p) > 1 THEN list_transform(range(2, len(p) + 1), lambda i: {{'i': i, 'q': p[i]}}) ELSE [{{'i': 0, 'q': ''}}] END, recursive := true) FROM a), "
        rf"c AS (SELECT {key}, head, i, q, {_squeezed("regexp_replace(lower(strip_accents(q)), '[^a-z\\s.''-]', ' ', 'g')")} AS k FROM b), "
        rf"d AS (SELECT {key}, any_value(head) AS head, string_agg(q, ' ' ORDER BY i) FILTER (WHERE i > 0 AND NOT {_PLACE}) AS kept FROM c GROUP BY {key}), "
        rf"e AS (SELECT {key}, regexp_replace(concat_ws(' ', head, kept), '[^a-z0-9+#.\s-]', ' ', 'g') AS t FROM d), "
        rf"f AS (SELECT {key}, {_squeezed("regexp_replace(" + words + ", '[.-]', ' ', 'g')")} AS normalized FROM e) "
        rf"SELECT {key}, normalized, coalesce(nullif(array_to_string(list_filter(string_split(normalized, ' '), lambda w: w <> '' AND w NOT IN ({stop})), ' '), ''), normalized) AS stem FROM f"
    )


def _after_views(sql: str) -> str:
    """A statement with its own WITH, as a subquery that further views can stand before."""
    return f"SELECT * FROM ({sql})"


@query(_after_views(_title_sql("b_title", "id")))
def title_normalized(spark, sf):
    t = view(spark, sf, "b_title")
    return t.select("id", normalize.title_normalized(F.col("title")).alias("normalized")).withColumn("stem", normalize.title_stem(F.col("normalized")))


# What the nine place texts of b_parsed say: city, province, country.
_PLACES = """CASE m WHEN 0 THEN 'Toronto' WHEN 2 THEN 'Austin' WHEN 3 THEN 'Surrey' WHEN 4 THEN 'Halifax' WHEN 5 THEN 'Paris' WHEN 6 THEN 'London' END AS city,
    CASE m WHEN 0 THEN 'ON' WHEN 3 THEN 'BC' WHEN 4 THEN 'NS' END AS province, CASE WHEN m IN (0, 1, 3, 4) THEN 'CA' WHEN m IN (2, 5) THEN 'OTHER' ELSE 'UNKNOWN' END AS country"""


@query(
    f"""SELECT external_ref, city, province, country, CASE CAST(substr(external_ref, 2) AS BIGINT) % 4 WHEN 0 THEN 'HYBRID' WHEN 1 THEN 'ONSITE' ELSE CASE m WHEN 1 THEN 'REMOTE' WHEN 6 THEN 'HYBRID'
    ELSE CASE WHEN city IS NOT NULL THEN 'ONSITE' ELSE 'UNKNOWN' END END END AS remote_type,
    lower(coalesce(city, '')) || '|' || coalesce(province, '') || '|' || CASE WHEN city IS NULL THEN CASE CAST(substr(external_ref, 2) AS BIGINT) % 4 WHEN 0 THEN 'HYBRID' WHEN 1 THEN 'ONSITE' ELSE CASE m WHEN 1 THEN 'REMOTE' ELSE 'UNKNOWN' END END ELSE '' END AS location_key
    FROM (SELECT external_ref, m, {_PLACES} FROM (SELECT external_ref, CAST(substr(external_ref, 2) AS BIGINT) % 9 AS m FROM b_parsed))"""
)
def place_parse(spark, sf):
    p = normalize.posting(view(spark, sf, "b_parsed"))
    return p.select("external_ref", "city", "province", "country", "remote_type", normalize.location_key(F.col("city"), F.col("province"), F.col("remote_type")).alias("location_key"))


_OUTCOME = r"""SELECT source_id, external_ref, concat_ws('; ', CASE WHEN length(trim(regexp_replace(title, '\s+', ' ', 'g'))) < 2 THEN 'title' END, CASE WHEN trim(employer_name) = '' THEN 'employer_name' END,
    CASE WHEN NOT starts_with(url, 'http') THEN 'url' END, CASE WHEN NOT starts_with(coalesce(apply_url, url), 'http') THEN 'apply_url' END) AS failed, CAST(substr(external_ref, 2) AS BIGINT) % 9 IN (2, 5) AS abroad FROM b_parsed"""


@query(
    f"""SELECT source_id, external_ref, CASE WHEN failed <> '' THEN 'INVALID' WHEN abroad THEN 'SKIPPED' ELSE 'VALID' END AS outcome,
    CASE WHEN failed <> '' THEN failed WHEN abroad THEN 'outside the country' END AS reason FROM ({_OUTCOME})"""
)
def validation_split(spark, sf):
    return normalize.checked(normalize.posting(view(spark, sf, "b_parsed"))).select("source_id", "external_ref", "outcome", "reason")


@query(f"SELECT source_id, 'VALIDATE' AS stage, failed AS message, external_ref AS payload_ref, 0 AS retry_count, strftime({TS}, '%Y-%m-%d') AS dead_lettered_at FROM ({_OUTCOME}) WHERE failed <> ''")
def quarantine(spark, sf):
    invalid = intake.split(view(spark, sf, "b_parsed"))[2]
    return intake.errors(invalid, "VALIDATE", now()).select("source_id", "stage", "message", "payload_ref", "retry_count", day("dead_lettered_at"))


@query(f"SELECT source_id, count(*) FILTER (WHERE CAST(substr(external_ref, 2) AS BIGINT) % 3 > 0) AS open FROM ({_OUTCOME}) WHERE failed <> '' GROUP BY source_id")
def dead_letters(spark, sf):
    found = store.write(intake.errors(intake.split(view(spark, sf, "b_parsed"))[2], "VALIDATE", now()))  # read twice
    done = found.where(F.substring("payload_ref", 2, 20).cast("long") % 3 == 0).select("source_id", "payload_ref", now().alias("decided_at"))
    return accounts.dead_letters(intake.resolve_errors(found, done))


@query("SELECT source_id, external_ref, CASE WHEN n % 4 = 0 THEN n + 7 END AS job_id FROM (SELECT source_id, external_ref, CAST(substr(external_ref, 2) AS BIGINT) AS n FROM b_parsed)")
def known_records(spark, sf):
    p = view(spark, sf, "b_parsed").select("source_id", "external_ref")
    n = F.substring("external_ref", 2, 20).cast("long")
    return intake.known_jobs(p, p.where(n % 4 == 0).withColumn("job_id", n + 7))


@query(
    f"""SELECT source_id, external_ref, CASE WHEN old THEN n + 7 ELSE n + 9 END AS job_id, CASE WHEN seen THEN title ELSE 'old' END AS title,
    strftime(CASE WHEN old THEN {TS} - INTERVAL 9 DAY ELSE {TS} END, '%Y-%m-%d') AS first_seen, strftime(CASE WHEN seen THEN {TS} ELSE {TS} - INTERVAL 5 DAY END, '%Y-%m-%d') AS last_seen,
    strftime(CASE WHEN seen AND source_id % 2 = 0 THEN {TS} WHEN old THEN {TS} - INTERVAL 7 DAY END, '%Y-%m-%d') AS last_verified, strftime(CASE WHEN NOT seen THEN {TS} - INTERVAL 1 DAY END, '%Y-%m-%d') AS expired_at
    FROM (SELECT source_id, external_ref, title, CAST(substr(external_ref, 2) AS BIGINT) AS n, CAST(substr(external_ref, 2) AS BIGINT) % 4 <> 0 AS old, CAST(substr(external_ref, 2) AS BIGINT) % 3 <> 0 AS seen FROM b_parsed)
    WHERE old OR seen"""
)
def records_upsert(spark, sf):
    p = view(spark, sf, "b_parsed").select("source_id", "external_ref", "title", F.substring("external_ref", 2, 20).cast("long").alias("n"))
    ago = lambda d: now() - F.expr(f"INTERVAL {d} DAYS")
    old = p.where("n % 4 <> 0").select(
        "source_id", "external_ref", (F.col("n") + 7).alias("job_id"), F.lit("old").alias("title"), ago(9).alias("first_seen"), ago(5).alias("last_seen"), ago(7).alias("last_verified"), ago(1).alias("expired_at")
    )
    new = p.where("n % 3 <> 0").select("source_id", "external_ref", (F.col("n") + 9).alias("job_id"), "title", now().alias("seen_at"), (F.col("source_id") % 2 == 0).alias("owned_source"))
    out = upsert.merge_records(old, new, ["title"])
    return out.select("source_id", "external_ref", "job_id", "title", *(day(c) for c in ("first_seen", "last_seen", "last_verified", "expired_at")))


@query(
    """SELECT key, name AS source_name, owned, enabled, id IS NULL AS is_new FROM (SELECT 'k' || s_suppkey AS key, CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey END AS id,
    CASE WHEN s_suppkey % 4 <> 0 THEN 'now ' || s_name ELSE s_name END AS name, s_suppkey % 2 = 0 AS owned, CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey % 5 <> 0 ELSE true END AS enabled, s_suppkey FROM supplier)
    WHERE s_suppkey % 3 <> 0 OR s_suppkey % 4 <> 0"""
)
def sources_upsert(spark, sf):
    s = spark.read.parquet(f"{sf}/supplier.parquet").withColumn("key", F.concat(F.lit("k"), F.col("s_suppkey").cast("string")))
    owned, firm = (F.col("s_suppkey") % 2 == 0).alias("owned"), F.lit(None).cast("long").alias("employer_id")
    current = s.where("s_suppkey % 3 <> 0").select(
        "key", F.col("s_suppkey").cast("long").alias("source_id"), F.col("s_name").alias("source_name"), owned, firm, (F.col("s_suppkey") % 5 != 0).alias("enabled"), F.lit(None).cast("timestamp").alias("last_success_at")
    )
    described = s.where("s_suppkey % 4 <> 0").select("key", F.concat(F.lit("now "), "s_name").alias("source_name"), owned, firm)
    out = intake.upsert_sources(current, described)
    return out.select("key", "source_name", "owned", "enabled", (F.col("source_id") == F.xxhash64("key")).alias("is_new"))


@query(
    f"""SELECT source_id, strftime(CASE WHEN source_id % 3 = 0 THEN last_success_at WHEN last_success_at IS NULL THEN {TS} ELSE greatest(last_success_at, {TS}) END, '%Y-%m-%d') AS last_success_at FROM b_source"""
)
def source_watermark(spark, sf):
    s = view(spark, sf, "b_source")
    kind = F.when(F.col("source_id") % 3 == 0, "FAILED").when(F.col("source_id") % 3 == 1, "PARTIAL").otherwise("SUCCEEDED")
    return intake.last_success(s, s.select("source_id", kind.alias("status"), now().alias("finished_at"))).select("source_id", day("last_success_at"))


@query(
    """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'www.linkedin.com' WHEN 1 THEN 'ca.indeed.com' ELSE regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)', 1)), '^www[.]', '') END AS host,
    page_id % 4 < 2 AS disallowed FROM pages"""
)
def disallowed_hosts(spark, sf):
    kind = F.col("page_id") % 4
    host = F.when(kind == 0, "www.linkedin.com").when(kind == 1, "ca.indeed.com").otherwise(urls.hostname(F.col("url")))
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", host.alias("host"))
    return pages.withColumn("disallowed", F.coalesce(urls.is_disallowed(F.col("host")), F.lit(False)))


@query(
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 3 THEN NULL WHEN o_orderkey % 5 = 2 THEN 20.5 + n % 9 ELSE 60000 + n END AS low, CASE WHEN o_orderkey % 5 = 3 THEN NULL WHEN o_orderkey % 5 = 1 THEN NULL WHEN o_orderkey % 5 = 2 THEN 20.5 + n % 9 ELSE 80000 + n END AS high,
    CASE o_orderkey % 5 WHEN 3 THEN NULL WHEN 2 THEN 'HOUR' ELSE 'YEAR' END AS period, CASE WHEN o_orderkey % 5 = 3 THEN NULL WHEN o_orderkey % 5 = 4 THEN 'USD' ELSE 'CAD' END AS currency,
    CASE o_orderkey % 5 WHEN 0 THEN 'Salary: $' || format('{:,}', 60000 + n) || ' - $' || format('{:,}', 80000 + n) || ' per year.' WHEN 1 THEN 'The pay is from $' || (60000 + n) || ' a year.'
    WHEN 2 THEN 'Wage $' || format('{:.2f}', 20.5 + n % 9) || ' an hour' WHEN 4 THEN 'Annual base US$' || (60000 + n) || ' to US$' || (80000 + n) || '.' END AS evidence
    FROM (SELECT o_orderkey, o_orderkey % 1000 AS n FROM orders)"""
)
def salary_extract(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 1000).alias("n"))
    low, high, hour = F.col("n") + 60000, F.col("n") + 80000, (F.col("n") % 9 + 20.5)
    money = lambda c: F.concat(F.lit("$"), F.format_number(c, 0))
    kind = F.col("id") % 5
    body = (
        F.when(kind == 0, F.concat(F.lit("We are a team of 12.\nGood people. Salary: "), money(low), F.lit(" - "), money(high), F.lit(" per year. Apply soon.")))
        .when(kind == 1, F.concat(F.lit("We raised $5 in total for cake.\nThe pay is from $"), low.cast("string"), F.lit(" a year.")))
        .when(kind == 2, F.concat(F.lit("Wage $"), F.format_number(hour, 2), F.lit(" an hour\nBonus $100 in pay")))
        .when(kind == 3, F.lit("Funding of $5,000,000 was raised. Nothing said of money here."))
        .otherwise(F.concat(F.lit("Annual base US$"), low.cast("string"), F.lit(" to US$"), high.cast("string"), F.lit(".")))
    )
    found = o.select("id", pay.extract_salary(body).alias("s"))
    return found.select("id", "s.low", "s.high", "s.period", "s.currency", "s.evidence")
