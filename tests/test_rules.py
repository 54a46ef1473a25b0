"""Rules over literal rows: signals and status, checks, upserts, freshness, similarity, readers, streams."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from postledger.functions import normalize, pay, text
from postledger.operators import checks, dedup, freshness, intake, search, signals, upsert
from postledger.sources import boards

NOW = datetime(2026, 9, 26, 12)


def _now():
    return F.lit(NOW).cast("timestamp")


H, D = timedelta(hours=1), timedelta(days=1)


def _tables(spark, **change):
    """One job that is VERIFIED, with changes: (records, job columns, pay, reports)."""
    job = {"apply_url": "https://acmefirm.ca/jobs/1", "text": "Good team.", "identity": "CONFIRMED", "last_verified": NOW - 5 * H, "first_seen": NOW - 20 * D, "expired_at": None} | change.get("job", {})
    jobs = spark.createDataFrame(
        [(1, 7, "Acme", job["identity"], "linked", "https://acmefirm.ca", NOW - D, job["apply_url"], job["text"], job["first_seen"], job["last_verified"], job["expired_at"])],
        "job_id long, employer_id long, employer_name string, identity string, identity_text string, identity_url string, identity_at timestamp, apply_url string, text string, first_seen timestamp, last_verified timestamp, expired_at timestamp",
    )
    records = spark.createDataFrame(
        change.get("records", [(1, 10, "https://board/1", NOW - 5 * H, None, "engineer", "toronto")]),
        "job_id long, source_id long, url string, last_verified timestamp, expired_at timestamp, title_stem string, location_key string",
    )
    sources = spark.createDataFrame([(10, "Own board", True, 7, NOW - 2 * H), (11, "Board B", False, None, NOW), (12, "Board C", False, None, NOW)], "source_id long, source_name string, owned boolean, employer_id long, last_success_at timestamp")
    salaries = spark.createDataFrame(change.get("pay", []), "job_id long, source_id long, low double, high double, period string, currency string, evidence string")
    reports = spark.createDataFrame(change.get("reports", []), "report_id long, user_id long, job_id long, status string")
    domains = spark.createDataFrame([(7, "acmefirm.ca"), (8, "otherhouse.com")], "employer_id long, domain string")
    return jobs, records, sources, salaries, reports, domains


def _verdict(spark, overrides=None, clusters=None, **change):
    t = _tables(spark, **change)
    found = signals.compute(*t, _now())
    status = signals.status(t[0], found, overrides, clusters).collect()[0]
    return {r["code"]: r for r in found.collect()}, (status["status"], status["rule"])


BOARD_ONLY = [(1, 11, "https://b/1", None, None, "engineer", "toronto")]


def test_verified(spark):
    found, verdict = _verdict(spark)
    assert verdict == ("VERIFIED", "R5")
    assert set(found) == {"ON_EMPLOYER_ATS", "EMPLOYER_IDENTITY_CONFIRMED", "APPLY_URL_ON_EMPLOYER_OR_KNOWN_ATS", "RECENTLY_CONFIRMED_LIVE"}
    own = found["ON_EMPLOYER_ATS"]
    assert (own["polarity"], own["weight"], own["evidence_url"], own["source_id"], own["observed_at"]) == ("POSITIVE", 50, "https://board/1", 10, NOW - 5 * H)
    assert "5 hours ago" in found["RECENTLY_CONFIRMED_LIVE"]["evidence_text"] and found["EMPLOYER_IDENTITY_CONFIRMED"]["evidence_text"] == "linked"


@pytest.mark.parametrize(
    ("change", "codes", "verdict"),
    [
        ({"job": {"expired_at": NOW}}, set(), ("EXPIRED", "R1")),
        ({"job": {"text": "Text us to apply. Pay a training fee first."}}, {"OFF_PLATFORM_CONTACT", "UPFRONT_PAYMENT_REQUEST"}, ("HIGH_RISK", "R2")),
        ({"job": {"text": "Text us to apply."}}, {"OFF_PLATFORM_CONTACT"}, ("REVIEW_REQUIRED", "R3")),
        ({"job": {"apply_url": "https://acmefrim.ca/x"}}, {"LOOKALIKE_DOMAIN"}, ("REVIEW_REQUIRED", "R3")),
        ({"job": {"apply_url": "https://forms.example.net/x"}}, {"APPLY_URL_MISMATCH"}, ("REVIEW_REQUIRED", "R3")),
        ({"reports": [(1, 5, 1, "PENDING"), (2, None, 1, "PENDING"), (3, 6, 1, "PENDING"), (4, 6, 1, "PENDING")]}, {"USER_REPORTS"}, ("REVIEW_REQUIRED", "R3")),
        ({"reports": [(1, 5, 1, "PENDING"), (3, 6, 1, "PENDING"), (4, 6, 1, "DISMISSED")]}, set(), ("VERIFIED", "R5")),
        ({"job": {"last_verified": NOW - 15 * D}}, {"STALE"}, ("STALE", "R4")),
        ({"job": {"last_verified": NOW - 14 * D}}, set(), ("PARTIALLY_VERIFIED", "R6")),
        ({"job": {"last_verified": NOW - 72 * H}}, {"RECENTLY_CONFIRMED_LIVE"}, ("VERIFIED", "R5")),
        ({"job": {"identity": "PROBABLE"}}, set(), ("PARTIALLY_VERIFIED", "R6")),
        ({"records": BOARD_ONLY, "job": {"apply_url": None, "last_verified": None, "first_seen": NOW - D}}, {"NOT_FOUND_ON_EMPLOYER_SITE"}, ("UNVERIFIED", "R7")),
        ({"records": BOARD_ONLY}, {"NOT_FOUND_ON_EMPLOYER_SITE", "EMPLOYER_IDENTITY_CONFIRMED"}, ("UNVERIFIED", "R7")),
    ],
)
def test_status_rules(spark, change, codes, verdict):
    found, got = _verdict(spark, **change)
    assert got == verdict and codes <= set(found)
    assert not {"LOOKALIKE_DOMAIN", "APPLY_URL_MISMATCH", "OFF_PLATFORM_CONTACT", "STALE", "USER_REPORTS"} & set(found) - codes


def test_override_and_open_cluster(spark):
    chosen = spark.createDataFrame([(1, "HIGH_RISK")], "job_id long, override_status string")
    assert _verdict(spark, overrides=chosen, job={"expired_at": NOW})[1] == ("HIGH_RISK", "R0")
    assert _verdict(spark, clusters=spark.createDataFrame([(1,)], "job_id long"))[1] == ("REVIEW_REQUIRED", "R3")


def test_pay_evidence(spark):
    yearly, hourly = (1, 11, 100000.0, 110000.0, "YEAR", "CAD", "100-110K a year"), (1, 12, 20.0, 25.0, "HOUR", "CAD", "20-25 an hour")
    own = (1, 10, 100000.0, 110000.0, "YEAR", "CAD", "own words")
    found, verdict = _verdict(spark, pay=[yearly, hourly, own])
    assert verdict == ("REVIEW_REQUIRED", "R3") and "own words" in found["SALARY_STATED_BY_EMPLOYER"]["evidence_text"]
    assert "20-25 an hour" in found["SALARY_CONFLICT"]["evidence_text"]
    found, _ = _verdict(spark, pay=[yearly, (*hourly[:5], "USD", "x"), (1, 10, None, 120000.0, "YEAR", "CAD", "y"), (1, 12, 5.0, 6.0, None, "CAD", "z")])
    assert "SALARY_CONFLICT" not in found  # other currency, within tolerance, no period


def test_agreement_of_sources(spark):
    same = [(1, 10, "u", NOW, None, "engineer", "toronto"), (1, 11, "u", None, None, "engineer", "toronto"), (1, 12, "u", None, NOW, "cook", "halifax")]
    found, _ = _verdict(spark, records=same)
    assert "2 sources" in found["CONSISTENT_ACROSS_SOURCES"]["evidence_text"]
    found, _ = _verdict(spark, records=[*same[:2], (1, 12, "u", None, None, "engineer", "halifax")])
    assert "CONSISTENT_ACROSS_SOURCES" not in found


def test_checks_borrow_only_from_strong_matches(spark):
    jobs, records, sources, _, _, domains = _tables(spark)
    rows = [(1, "Good team.", "https://acmefirm.ca/jobs/1"), (2, "Good team.", "https://acmefirm.ca/jobs/1"), (3, "Message me on Telegram and pay the registration fee.", None)]
    asked = spark.createDataFrame(
        [(i, t, u, 7, "Acme", "CONFIRMED", 100000.0, 110000.0, "YEAR", "CAD", "100-110K") for i, t, u in rows],
        "check_id long, text string, apply_url string, employer_id long, employer_name string, identity string, low double, high double, period string, currency string, pay_text string",
    )
    matches = spark.createDataFrame([(1, 1, 1.0, True), (2, 1, 0.7, False)], "check_id long, job_id long, score double, is_strong boolean")
    found, status = checks.verify(asked, matches, jobs, records, sources, domains, _now())
    codes = {}
    for r in found.collect():
        codes.setdefault(r["check_id"], set()).add(r["code"])
    assert codes[1] == {"ON_EMPLOYER_ATS", "EMPLOYER_IDENTITY_CONFIRMED", "APPLY_URL_ON_EMPLOYER_OR_KNOWN_ATS", "RECENTLY_CONFIRMED_LIVE", "SALARY_STATED_BY_EMPLOYER"}
    assert codes[2] == {"EMPLOYER_IDENTITY_CONFIRMED", "APPLY_URL_ON_EMPLOYER_OR_KNOWN_ATS"}
    assert {r["check_id"]: r["rule"] for r in status.collect()} == {1: "R5", 2: "R6", 3: "R2"}


def test_similarity(spark):
    schema = "posting_id long, employer_id long, title_stem string, title_normalized string, description string, city string, province string, remote_type string, lo double, hi double, currency string, skills array<string>, urls array<string>"
    about = "we need a person who builds the pages that our customers see every day and who talks with them about it"
    base = (1, 7, "engineer", "senior engineer", about, "Toronto", "ON", "HYBRID", 120000.0, 145000.0, "CAD", ["ts", "sql"], ["https://a.example/1"])

    def score(**change):
        names = [c.split()[0] for c in schema.split(", ")]
        other = {**dict(zip(names, base)), "posting_id": 2, "urls": ["https://b.example/2"], **change}
        pair = dedup.prepare(spark.createDataFrame([base, tuple(other[n] for n in names)], schema))
        rows = dedup.scored_pairs(pair).collect()
        return rows[0]["score"] if rows else 0.0

    assert score(description=about.upper() + " Posted via board (demo).", skills=[]) >= 0.85
    assert score(urls=["https://www.a.example/1/"], description="short", lo=None, hi=None) >= 0.85
    assert score(lo=57.69 * 2080, hi=69.71 * 2080) > 0.95
    assert score(description="quite another text of a team that paints and repairs old houses by the sea all year", lo=1000.0, hi=2000.0, skills=["paint"], title_normalized="senior engineer paint") < 0.60
    assert 0.60 <= score(description=about.replace("and who talks with them about it", "but never talks with any of them at all"), lo=90000.0, hi=121000.0) < 0.85


def test_shingles_of_a_long_text_are_linear(spark):
    row = spark.range(1).select(text.shingles(F.lit("one two three")).alias("few"), F.size(text.shingles(F.lit(" ".join(f"w{i}" for i in range(20000))))).alias("n")).collect()[0]
    assert len(row["few"]) == 1 and row["n"] == 19997


def test_canonical_upsert(spark):
    old = spark.createDataFrame([(i, "old", NOW - 9 * D, NOW - D) for i in (1, 2, 3, 4)], "job_id long, title string, last_seen timestamp, expired_at timestamp")
    staged = spark.createDataFrame(
        [(1, "new", NOW, True, "MERGE"), (2, "new", NOW, False, "SAME_SOURCE_RECORD"), (3, "new", NOW, False, "MERGE"), (4, "new", NOW, False, "SAME_SOURCE_RECORD"), (5, "new", NOW, False, "NEW")],
        "job_id long, title string, last_seen timestamp, owned_source boolean, decision string",
    )
    backed = spark.createDataFrame([(1,), (4,)], "job_id long")
    got = {r["job_id"]: (r["title"], r["change"], r["expired_at"] is None) for r in upsert.merge_jobs(old, staged, backed, ["title"]).collect()}
    assert got == {1: ("new", "OVERWRITTEN", True), 2: ("new", "OVERWRITTEN", True), 3: ("old", "SEEN", False), 4: ("old", "SEEN", False), 5: ("new", "NEW", True)}


def test_liveness_and_rollup(spark):
    records = spark.createDataFrame([(1, 10, NOW - 9 * D, NOW - 9 * D, None), (1, 11, None, NOW - 5 * D, NOW - 3 * D), (2, 10, None, NOW - 5 * D, NOW - 3 * D)], "job_id long, source_id long, last_verified timestamp, last_seen timestamp, expired_at timestamp")
    seen = spark.createDataFrame([(1, 10, "GONE"), (1, 11, "UNKNOWN"), (2, 10, "GONE")], "job_id long, source_id long, observation string")
    after = freshness.apply_liveness(records, seen, _now())
    assert {(r["job_id"], r["source_id"]): r["expired_at"] for r in after.collect()} == {(1, 10): NOW, (1, 11): NOW - 3 * D, (2, 10): NOW}
    jobs = spark.createDataFrame([(1, None, NOW - D, None), (2, None, NOW - 9 * D, NOW - 4 * D), (3, NOW, NOW, NOW)], "job_id long, last_verified timestamp, last_seen timestamp, expired_at timestamp")
    got = {r["job_id"]: tuple(r)[1:] for r in freshness.roll_up(jobs, after).collect()}
    assert got == {1: (NOW - 9 * D, NOW - D, NOW), 2: (None, NOW - 5 * D, NOW - 4 * D), 3: (NOW, NOW, NOW)}
    live = freshness.apply_liveness(records, seen.withColumn("observation", F.lit("LIVE")), _now())
    assert {r["last_seen"] for r in live.collect()} == {NOW} and freshness.rollup(live).where("expired_at IS NULL").count() == 2


def test_pay_of_lines(spark):
    texts = [
        "Join us. Salary: $85–105K per year. Apply now.",
        "We raised $5 today. The pay is $41,50 an hour",  # the first amount of a line decides
        "Up to $30 per hour, great wage",
        "Salary $120,000 to $145,000 for " + "very " * 60 + "good people",
        "Le salaire est de 85 000 $ à 105 000 $ par an",
    ]
    got = [r["s"] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(pay.extract_salary(F.col("t")).alias("s")).collect()]
    assert (got[0]["low"], got[0]["high"], got[0]["period"], got[0]["evidence"]) == (85000, 105000, "YEAR", "Salary: $85–105K per year.")
    assert got[1] is None and (got[2]["low"], got[2]["high"]) == (None, 30) and got[4]["low"] == 85000
    assert len(got[3]["evidence"]) == 200 and got[3]["evidence"].endswith("…")


def test_employer_keys(spark):
    names = ["Acme ULC", "Acme Incorporated", "Acme (Demo) Ltd.", "Acme Ltée", "Acme"]
    assert {r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(normalize.employer_key(F.col("n"))).collect()} == {"acme"}


def test_readers_to_outcomes(spark, tmp_path):
    page = {
        "jobs": [
            {"id": 1, "title": " Sr. Engineer, Platform (Hybrid) ", "absolute_url": "https://b.example/1", "company_name": " ", "location": {"name": "Toronto, Ontario, Canada"},
             "content": "&lt;p&gt;Pay: $100,000 to $120,000 a year.&lt;/p&gt;", "metadata": [{"name": "Job Type", "value": "Full-time"}, {"name": "Location Type", "value": "Hybrid"}], "first_published": "2026-09-01T00:00:00Z"},
            {"id": 2, "title": "Account Executive", "absolute_url": "https://b.example/2", "location": {"name": " "}, "offices": [{"name": "A", "location": "Austin, TX"}]},
            {"id": 3, "title": "", "absolute_url": "https://b.example/3", "location": {"name": "Ottawa, ON"}},
        ]
    }
    (tmp_path / "b.json").write_text(json.dumps(page))
    parsed = boards.board(spark, str(tmp_path / "b.json"), "Acme")
    valid, skipped, invalid = intake.split(parsed)
    row = valid.collect()[0]
    assert (row["employer_name"], row["city"], row["province"], row["remote_type"], row["employment_type"], row["title_stem"]) == ("Acme", "Toronto", "ON", "HYBRID", "FULL_TIME", "engineer platform")
    assert row["description"] == "Pay: $100,000 to $120,000 a year." and valid.count() == 1
    assert [r["external_ref"] for r in skipped.collect()] == ["2"]
    bad = intake.errors(invalid.withColumn("source_id", F.lit(4)), "VALIDATE", _now()).collect()
    assert [(r["payload_ref"], r["dead_lettered_at"]) for r in bad] == [("3", NOW)] and bad[0]["message"].startswith("title")


def test_flat_and_paged_readers(spark, tmp_path):
    rows = [{"jobId": "9", "title": " Cook ", "employerName": "Inn", "city": "Halifax", "province": "NS", "salaryText": "$20 an hour", "description": "Cook.", "datePosted": "2026-09-01"}]
    (tmp_path / "x.json").write_text(json.dumps(rows))
    r = boards.extract(spark, str(tmp_path / "x.json")).collect()[0]
    assert (r["external_ref"], r["title"], r["location_text"], r["description"]) == ("9", "Cook", "Halifax, NS", "Cook.\n$20 an hour")
    rows = [{"id": "a", "text": "Lead", "categories": {"location": "Surrey", "commitment": "Full-time"}, "country": "CA", "hostedUrl": "https://l/1", "salaryRange": {"min": 1, "max": 2, "currency": "CAD", "interval": "per-hour-wage"}, "descriptionPlain": "D"}]
    (tmp_path / "p.json").write_text(json.dumps(rows))
    r = boards.paged(spark, str(tmp_path / "p.json"), "Acme").collect()[0]
    assert (r["location_text"], r["period"], r["employment_text"]) == ("Surrey, Canada", "HOUR", "Full-time")
    pages = spark.createDataFrame([(1, 0, 100), (1, 1, 7), (2, 0, 100), (3, 0, 50), (3, 1, 20), (4, 1, 3)], "source_id int, page int, rows int")
    assert {x["source_id"]: x["complete"] for x in boards.complete_pages(pages).collect()} == {1: True, 2: False, 3: False, 4: False}


def test_filter_sets(spark):
    rows = [(1, '{"city":" Toronto ","sort":"relevance"}'), (2, '{"province":"Ontario"}'), (3, '{"salaryMin":"-3"}'), (4, "no json"), (5, '{"postedWithinDays":7,"q":"a b"}'), (6, None), (7, "{}")]
    got = {r["id"]: (r["valid"], r["city"], r["link"]) for r in search.parse_filters(spark.createDataFrame(rows, "id int, filters string")).withColumn("link", search.canonical_query()).collect()}
    assert got == {1: (True, "Toronto", "?city=Toronto"), 2: (False, None, ""), 3: (False, None, ""), 4: (False, None, ""), 5: (True, None, "?q=a+b&postedWithinDays=7"), 6: (False, None, ""), 7: (True, None, "")}


@pytest.mark.parametrize(
    ("said", "polarity"),
    [
        ("This is an existing vacancy.", "POSITIVE"),
        ("Ce poste est un poste vacant.", "POSITIVE"),
        ("This is not a currently existing vacancy.", "NEUTRAL"),
        ("Ce poste n'est pas un poste vacant.", "NEUTRAL"),
        ("Ce poste n’est pas un poste vacant.", "NEUTRAL"),
        ("We keep a talent pool.", "NEUTRAL"),
        ("For future openings only.", "NEUTRAL"),
        ("Join our talent community.", "POSITIVE"),
    ],
)
def test_vacancy_wording(spark, said, polarity):
    found, _ = _verdict(spark, job={"text": f"Good team. {said}"})
    got = found["VACANCY_STATUS_DISCLOSED"]
    assert (got["polarity"], got["weight"]) == (polarity, 20)


def test_all_records_expired_is_expired(spark):
    t = _tables(spark, records=[(1, 10, "https://b/1", None, NOW - H, "e", "t"), (1, 11, "https://b/2", None, NOW - H, "e", "t")])
    found = signals.compute(*t, _now())
    one = lambda records: signals.status(t[0], found, records=records).collect()[0]["rule"]
    assert one(t[1]) == "R1"
    assert one(t[1].withColumn("expired_at", F.when(F.col("source_id") == 10, F.col("expired_at")))) != "R1"
    assert one(t[1].limit(0)) != "R1"  # no record: not all are gone


def test_status_follows_the_rule_table(spark):
    t = _tables(spark)
    found = signals.compute(*t, _now())
    rules = spark.createDataFrame([(0, "X1", "OWN", [["ON_EMPLOYER_ATS"], ["STALE", "NOTHING_NEGATIVE"]]), (1, "X2", "OTHER", [])], "place int, rule string, status string, all_of array<array<string>>")
    assert tuple(signals.status(t[0], found, rules=rules).collect()[0])[1:] == ("OWN", "X1")
    assert signals.rule_catalog(spark).count() == 8 and signals.signal_catalog(spark).where("scam").count() == 4 and signals.threshold_catalog(spark).count() == 3
