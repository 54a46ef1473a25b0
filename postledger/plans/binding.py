"""Domain tables over the supplied tables, as SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

NOW = "1998-07-01 00:00:00"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "conversations")
_TS = f"TIMESTAMP '{NOW}'"

VIEWS = {
    "b_source": """SELECT s_suppkey AS source_id, s_name AS source_name, s_suppkey % 3 = 0 AS owned, s_suppkey % 10 <> 9 AS enabled,
        s_suppkey * 7 % 50 AS employer_id,
        CASE WHEN s_suppkey % 3 = 0 THEN 'EMPLOYER_CAREER_PAGE' WHEN s_suppkey % 5 = 1 THEN 'GOVERNMENT_OPEN_DATA' ELSE 'ATS_PUBLIC_BOARD' END AS source_type, CASE WHEN s_suppkey % 4 <> 1 THEN CAST(TIMESTAMP '1998-06-01 00:00:00' AS TIMESTAMP) END AS last_success_at
        FROM supplier""",
    "b_record": f"""SELECT job_id, source_id, last_seen, last_verified, expired_at, first_seen, title_stem, location_key,
        'https://board' || CAST(source_id AS STRING) || '.example.net/' || CAST(job_id AS STRING) AS url FROM (
        SELECT l_orderkey AS job_id, l_suppkey AS source_id, CAST(l_shipdate AS TIMESTAMP) AS last_seen,
            CASE WHEN l_linestatus = 'F' THEN CAST(l_shipdate AS TIMESTAMP) END AS last_verified,
            CASE WHEN l_returnflag = 'R' THEN CAST(l_shipdate AS TIMESTAMP) + INTERVAL 10 DAY END AS expired_at,
            CAST(l_shipdate AS TIMESTAMP) - INTERVAL 5 DAY AS first_seen,
            'stem' || CAST(l_linenumber % 2 AS STRING) AS title_stem, 'place' || CAST(l_partkey % 2 AS STRING) AS location_key,
            row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC) AS rn
        FROM lineitem WHERE l_shipdate <= {_TS}) t WHERE rn = 1""",
    "b_salary": f"""SELECT job_id, source_id, low, high, period, currency,
        'Pay from ' || CAST(CAST(floor(low) AS BIGINT) AS STRING) || ' to ' || CAST(CAST(floor(high) AS BIGINT) AS STRING) AS evidence FROM (
        SELECT l_orderkey AS job_id, l_suppkey AS source_id, l_extendedprice * (1 - l_discount) AS low, l_extendedprice AS high,
            CASE l_linenumber % 3 WHEN 0 THEN 'YEAR' WHEN 1 THEN 'MONTH' END AS period,
            CASE WHEN l_partkey % 4 = 0 THEN 'USD' ELSE 'CAD' END AS currency,
            row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC) AS rn
        FROM lineitem WHERE l_shipdate <= {_TS}) t WHERE rn = 1""",
    "b_rollup": """SELECT job_id, max(last_verified) AS last_verified, max(last_seen) AS last_seen,
        sum(CASE WHEN expired_at IS NULL THEN 1 ELSE 0 END) AS active_sources, count(*) AS all_sources,
        CASE WHEN sum(CASE WHEN expired_at IS NULL THEN 1 ELSE 0 END) = 0 THEN max(expired_at) END AS expired_at FROM b_record GROUP BY job_id""",
    "b_order": """SELECT o_orderkey AS job_id, o_custkey % 50 AS employer_id, n_name AS city, r_name AS province, CAST(o_orderdate AS TIMESTAMP) AS first_seen,
        o_totalprice AS price, CASE WHEN o_custkey % 2 = 0 THEN 'CONFIRMED' ELSE 'PROBABLE' END AS identity,
        CASE o_orderkey % 3 WHEN 0 THEN 'REMOTE' WHEN 1 THEN 'HYBRID' ELSE 'ONSITE' END AS remote_type, o_orderpriority AS priority
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "b_job": """SELECT o.job_id, o.employer_id, o.city, o.province, o.first_seen, o.price, o.identity, o.remote_type, o.priority,
        r.last_verified, r.last_seen, r.expired_at FROM b_order o JOIN b_rollup r ON o.job_id = r.job_id""",
    "b_report": """SELECT event_id AS report_id, CASE WHEN event_id % 7 <> 0 THEN user_id END AS user_id, event_id % 200 AS job_id,
        CASE WHEN event_id % 5 = 0 THEN 'DISMISSED' ELSE 'PENDING' END AS status FROM events WHERE event_type = 'error'""",
    "b_event": "SELECT event_type AS name, user_id, CAST(ts AS TIMESTAMP) AS ts FROM events",
    "b_track": "SELECT event_id, event_type AS name, user_id, CAST(ts AS TIMESTAMP) AS ts FROM events",
    "b_vector": "SELECT vec_id AS posting_id, label AS block, embedding AS vector FROM embeddings",
    "b_firm": f"""SELECT employer_id, 'Firm ' || CAST(employer_id AS STRING) AS employer_name, CASE WHEN employer_id % 5 <> 0 THEN 'acmefirm' || CAST(employer_id AS STRING) || '.com' END AS domain,
        CASE WHEN employer_id % 3 = 0 THEN 'Board linked from the careers page of firm ' || CAST(employer_id AS STRING) END AS identity_text,
        CASE WHEN employer_id % 3 = 0 THEN 'https://acmefirm' || CAST(employer_id AS STRING) || '.com/careers' END AS identity_url,
        CASE WHEN employer_id % 3 = 0 THEN {_TS} - INTERVAL 3 DAY END AS identity_at FROM (SELECT DISTINCT o_custkey % 50 AS employer_id FROM orders) t""",
    "b_firm_domain": "SELECT employer_id, domain FROM b_firm WHERE domain IS NOT NULL",
    "b_ad": """SELECT o_orderkey AS job_id, CASE o_orderkey % 8 WHEN 0 THEN 'https://boards.greenhouse.io/x/1' WHEN 1 THEN 'https://www.acmefirm' || CAST(o_custkey % 50 AS STRING) || '.com/jobs'
        WHEN 2 THEN 'https://acnefirm' || CAST(o_custkey % 50 AS STRING) || '.com/jobs' WHEN 3 THEN 'https://elsewhere-jobs.net/x' WHEN 5 THEN 'https://www.jobbank.gc.ca/j'
        WHEN 7 THEN 'https://my-acmefirm' || CAST(o_custkey % 50 AS STRING) || '.com' END AS apply_url,
        CASE o_orderkey % 7 WHEN 0 THEN 'Great team of ' || CAST(o_orderkey % 100 AS STRING) || '. Message us on Telegram to start.' WHEN 1 THEN 'You pay a training fee first. Good hours.'
        WHEN 2 THEN 'For ' || o_orderpriority || ' work this is an existing vacancy. Apply now.' WHEN 3 THEN 'We never ask you to message us on Telegram. Join our talent pool of ' || CAST(o_orderkey % 100 AS STRING) || '.'
        WHEN 4 THEN 'Text me at once! Buy a starter kit before day ' || CAST(o_orderkey % 100 AS STRING) || '.' WHEN 5 THEN 'Good team.  E-transfer the deposit today • write to hr' || CAST(o_orderkey % 100 AS STRING) || '@gmail.com'
        ELSE 'Good team of ' || CAST(o_orderkey % 100 AS STRING) || '.' END AS text FROM orders""",
    "b_case": """SELECT j.job_id, j.employer_id, j.city, j.province, j.first_seen, j.price, j.identity, j.remote_type, j.priority, j.last_verified, j.last_seen, j.expired_at,
        f.employer_name, f.identity_text, f.identity_url, f.identity_at, a.apply_url, a.text
        FROM b_job j JOIN b_firm f ON j.employer_id = f.employer_id JOIN b_ad a ON j.job_id = a.job_id""",
    "b_advert": """SELECT a.job_id, substring(o_orderpriority, 3) || ' ' || coalesce(p_type, '') AS title, p_name AS skills, n_name AS city, r_name AS province, coalesce(d.text, a.text) AS description
        FROM b_ad a JOIN orders ON o_orderkey = a.job_id JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        LEFT JOIN documents d ON d.doc_id = a.job_id LEFT JOIN part ON p_partkey = a.job_id""",
    "b_override": "SELECT job_id, CASE WHEN job_id % 2 = 0 THEN 'VERIFIED' ELSE 'HIGH_RISK' END AS override_status FROM b_order WHERE job_id % 97 = 0",
    "b_open": "SELECT job_id FROM b_order WHERE job_id % 41 = 1",
    "b_posting": """SELECT o_orderkey AS posting_id, o_custkey AS employer_id, o_orderkey % 7 AS source_id, 'r' || CAST(o_orderkey AS STRING) AS external_ref,
        substring(o_orderpriority, 3) AS title_stem, lower(substring(o_orderpriority, 3)) || CASE WHEN o_orderkey % 4 = 0 THEN ' lead' ELSE '' END AS title_normalized,
        'We hire for work in ' || n_name || ' on shift ' || CAST(o_orderkey % 3 AS STRING) || ' with crew ' || CAST(o_custkey % 9 AS STRING) || ' of the ' || lower(substring(o_orderpriority, 3))
        || ' team and offer good hours to all ' || CASE WHEN o_orderkey % 5 = 0 THEN 'who join us early in the year' ELSE 'our people' END AS description,
        CASE WHEN o_orderkey % 6 <> 0 THEN n_name END AS city, r_name AS province, CASE o_orderkey % 2 WHEN 0 THEN 'REMOTE' ELSE 'UNKNOWN' END AS remote_type,
        CASE WHEN o_orderkey % 3 <> 0 THEN CAST(50000 + o_orderkey % 5 * 10000 AS DOUBLE) END AS lo, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(70000 + o_orderkey % 5 * 10000 AS DOUBLE) END AS hi,
        CASE WHEN o_orderkey % 8 = 0 THEN 'USD' ELSE 'CAD' END AS currency, CASE WHEN o_orderkey % 10 = 0 THEN 'https://www.board.example/' || CAST(o_custkey AS STRING) || '/' ELSE 'https://board.example/j' || CAST(o_orderkey AS STRING) END AS url
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "b_title": """SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'Sr. ' || p_name || ' Dev - Toronto' WHEN 1 THEN p_name || ' Mgr (Remote)'
        WHEN 2 THEN 'Jr ' || p_name || ', Platform' WHEN 3 THEN p_name || ' | Full Time' WHEN 4 THEN 'Lead QA ' || p_name ELSE p_name || ' II, Contract' END AS title,
        CASE p_partkey % 4 WHEN 0 THEN 'Contract' WHEN 1 THEN 'Permanent' WHEN 2 THEN 'Part-time' END AS kind FROM part""",
    "b_parsed": """SELECT p_partkey % 10 AS source_id, 'p' || CAST(p_partkey AS STRING) AS external_ref,
        CASE p_partkey % 6 WHEN 0 THEN 'Sr. ' || p_name || ' Dev - Toronto' WHEN 1 THEN p_name || '  Mgr (Remote)' WHEN 2 THEN 'Jr ' || p_name || ', Platform' WHEN 3 THEN p_name || ' | Full Time'
            WHEN 4 THEN 'Lead QA ' || p_name ELSE CASE WHEN p_partkey % 5 = 0 THEN 'x' ELSE p_name || ' II, Contract' END END AS title,
        CASE WHEN p_partkey % 17 = 0 THEN ' ' ELSE ' ' || p_brand || ' Ltd ' END AS employer_name,
        CASE p_partkey % 9 WHEN 0 THEN 'Toronto, ON' WHEN 1 THEN 'Remote - Canada' WHEN 2 THEN 'Austin, TX' WHEN 3 THEN 'Surrey, British Columbia; Laval' WHEN 4 THEN 'Halifax'
            WHEN 5 THEN 'Paris, France' WHEN 6 THEN 'Hybrid (London)' WHEN 7 THEN '' END AS location_text,
        CASE p_partkey % 4 WHEN 0 THEN 'Hybrid' WHEN 1 THEN 'In office' END AS workplace_text,
        CASE p_partkey % 4 WHEN 0 THEN 'Contract' WHEN 1 THEN 'Permanent' WHEN 2 THEN 'Part-time' END AS employment_text,
        p_type || ' made by ' || p_brand AS description, CASE WHEN p_partkey % 13 = 0 THEN 'ftp://x/' ELSE 'https://x.example/' || CAST(p_partkey AS STRING) END AS url,
        CASE WHEN p_partkey % 2 = 0 THEN 'https://apply.example/' || CAST(p_partkey AS STRING) END AS apply_url FROM part""",
    "b_search": """SELECT c_custkey AS search_id, c_custkey % 40 AS user_id, 'Search ' || CAST(c_custkey AS STRING) AS name,
        CASE WHEN c_custkey % 40 = 3 THEN NULL WHEN c_custkey % 3 = 0 THEN 'ion_' || CAST(c_nationkey AS STRING) WHEN c_custkey % 3 = 1 THEN n_name ELSE upper(n_name) END AS f_city,
        CASE WHEN c_custkey % 5 < 2 THEN substring(r_name, 1, 2) END AS f_province, CASE WHEN c_custkey % 3 = 0 THEN 'REMOTE' WHEN c_custkey % 11 = 1 THEN 'MARS' END AS f_remote,
        CASE WHEN c_custkey % 6 = 0 THEN 'Firm ' || CAST(c_custkey % 5 AS STRING) END AS f_employer, CASE WHEN c_custkey % 7 = 0 THEN CAST(c_custkey % 60 AS STRING) END AS f_posted,
        CASE WHEN c_custkey % 9 = 0 THEN CAST(100000 + c_custkey AS STRING) END AS f_salary,
        CASE c_custkey % 8 WHEN 0 THEN 'messaging Telegrams' WHEN 1 THEN '"training fees" or deposits -' || split_part(d.text, ' ', 4) WHEN 2 THEN split_part(d.text, ' ', 2) || ' or ' || split_part(d.text, ' ', 5)
            WHEN 3 THEN '"' || split_part(d.text, ' ', 3) || ' ' || split_part(d.text, ' ', 4) || ' ' || split_part(d.text, ' ', 5) || '" or "good teams" -telegram or widget'
            WHEN 4 THEN '-team -the' WHEN 5 THEN 'the and of' WHEN 6 THEN p_name || ' or starter-kit' END AS f_q,
        CASE WHEN c_custkey % 2 = 0 THEN TIMESTAMP '1998-06-20 00:00:00' END AS last_notified_at, TIMESTAMP '1998-06-10 00:00:00' AS created_at
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN documents d ON d.doc_id = c_custkey LEFT JOIN part ON p_partkey = c_custkey""",
    "b_employer": f"""SELECT c_custkey AS employer_id, c_name || ' Inc.' AS name, CASE c_custkey % 3 WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'PROBABLE' ELSE 'CONFIRMED' END AS identity,
        CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 7 < 4 THEN {_TS} - INTERVAL 6 HOUR ELSE {_TS} - INTERVAL 2 DAY END AS identity_checked_at,
        CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 5 = 1 THEN {_TS} - INTERVAL 40 DAY ELSE {_TS} - INTERVAL 10 DAY END AS proof_at FROM customer""",
    "b_domain": "SELECT c_custkey AS employer_id, 'acmecorp.com' AS domain FROM customer WHERE c_mktsegment <> 'MACHINERY'",
    "b_listing": """SELECT o_orderkey AS job_id, o_custkey AS employer_id, o_orderpriority AS title_stem, o_orderpriority AS title_normalized,
        CASE WHEN o_orderkey % 3 <> 0 THEN n_name END AS city, CAST(o_totalprice AS DOUBLE) AS lo, CAST(o_totalprice AS DOUBLE) + 40000 AS hi, 'CAD' AS currency,
        CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS TIMESTAMP) END AS expired_at
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "b_text": """SELECT o_orderkey AS job_id, o_custkey AS employer_id, CASE o_orderkey % 6 WHEN 0 THEN 'https://boards.greenhouse.io/x/1' WHEN 1 THEN 'https://www.acmecorp.com/jobs'
        WHEN 2 THEN 'https://acmec0rp.com/jobs' WHEN 3 THEN 'https://elsewhere-jobs.net/x' WHEN 5 THEN 'https://www.jobbank.gc.ca/j' END AS apply_url,
        CASE o_orderkey % 5 WHEN 0 THEN 'Great team. Message us on Telegram to start.' WHEN 1 THEN 'You pay a training fee first. Good hours.'
        WHEN 2 THEN 'This is an existing vacancy. Apply now.' WHEN 3 THEN 'We never ask you to message us on Telegram. Join our talent pool.' ELSE 'Good team.' END AS text FROM orders""",
    "b_scored": """SELECT o_orderkey AS posting_id, o_custkey AS candidate_id, CAST(40 + o_orderkey % 60 AS DOUBLE) / 100 AS score, o_orderkey % 5 = 0 AS same_source,
        o_orderkey % 7 = 0 AS employer_owned, CASE o_orderkey % 4 WHEN 0 THEN 'jobs.lever.co' WHEN 1 THEN 'www.acmecorp.com' WHEN 2 THEN 'evil.example.net' END AS apply_host,
        CASE WHEN o_orderkey % 6 = 0 THEN 'Good pay. Message us on Telegram.' ELSE 'We never ask you to message us on Telegram. Good team.' END AS text FROM orders""",
    "b_pasted": """SELECT o_orderkey AS check_id, 'Job title: ' || o_orderpriority || chr(10) || 'Company - ' || 'Firm ' || CAST(o_custkey AS STRING) || chr(10) || 'Location:  Toronto ' || chr(10)
        || 'See https://www.example.org/about. Apply at https://apply.example.com/' || CAST(o_orderkey AS STRING) || '.' AS text,
        CASE WHEN o_orderkey % 4 = 0 THEN ' Acme ' END AS employer_hint FROM orders""",
}


def _needs(name: str) -> list[str]:
    return [v for v in VIEWS if v != name and re.search(rf"\b{v}\b", VIEWS[name])]


#: Rows of a task, about, where a table is dealt by key before a view sorts it.
TASK_ROWS = 1_000_000


def view(spark: SparkSession, sf_dir: str, name: str, **given: DataFrame) -> DataFrame:
    """A domain table; its inputs are passed to the statement, no temporary view stays behind. given: tables or views to take as they are."""
    if name in given:
        return given[name]
    args: dict[str, DataFrame] = {v: view(spark, sf_dir, v, **given) for v in _needs(name)}
    args |= {t: given[t] if t in given else spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"(FROM|JOIN) {t}\b", VIEWS[name])}
    sql = VIEWS[name]
    for a in args:
        sql = re.sub(rf"\b(FROM|JOIN) {a}\b", rf"\1 {{{a}}}", sql)
    return spark.sql(sql, **args)


def dealt(table: DataFrame, key: str) -> DataFrame:
    """The table dealt by a key into tasks of about TASK_ROWS rows, so that a task holds no more of a larger table."""
    least = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return table.repartition(max(least, -(-table.count() // TASK_ROWS)), key)


def with_views(sql: str, tables: str = "") -> str:
    """The same tables as common table expressions before further ones and a DuckDB statement."""
    need: list[str] = []

    def add(text: str) -> None:
        for v in VIEWS:
            if re.search(rf"\b{v}\b", text) and v not in need:
                add(VIEWS[v])
                if v not in need:
                    need.append(v)

    add(f"{sql} {tables}")
    parts = [f"{v} AS ({VIEWS[v]})" for v in need] + [tables] * bool(tables)
    return ("WITH " + ", ".join(parts) + " " if parts else "") + sql
