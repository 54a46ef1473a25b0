"""Scalar operators against literal cases."""

import time

import pytest
from pyspark.sql import functions as F

from postledger.functions import normalize, pay, text, urls
from postledger.operators import dedup


def _one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "title, normalized, stem",
    [
        ("Sr. Software Engineer, Platform (Hybrid)", "senior software engineer platform", "software engineer platform"),
        ("Software Developer - Toronto", "software developer", "software developer"),
        ("Jr Dev | Remote", "junior developer", "developer"),
        ("Ingénieur Logiciel", "ingenieur logiciel", "ingenieur logiciel"),
    ],
)
def test_titles(spark, title, normalized, stem):
    assert _one(spark, title, normalize.title_normalized) == normalized
    assert _one(spark, normalized, normalize.title_stem) == stem


@pytest.mark.parametrize(
    "place, city, province, country, hint",
    [
        ("Toronto, Ontario, Canada", "Toronto", "ON", "CA", "UNKNOWN"),
        ("Remote - Canada", None, None, "CA", "REMOTE"),
        ("Austin, TX", "Austin", None, "OTHER", "UNKNOWN"),
        ("London, UK", "London", None, "OTHER", "UNKNOWN"),
        ("Montréal", "Montréal", "QC", "CA", "UNKNOWN"),
        ("Surrey", "Surrey", None, "UNKNOWN", "UNKNOWN"),
        (None, None, None, "UNKNOWN", "UNKNOWN"),
    ],
)
def test_places(spark, place, city, province, country, hint):
    assert tuple(_one(spark, place, normalize.location)) == (city, province, country, hint)


@pytest.mark.parametrize(
    "line, low, high, currency, period",
    [
        ("The salary range is $120,000 - $145,000 per year.", 120000, 145000, "CAD", "YEAR"),
        ("Pay: $27.50 to $31.00 per hour", 27.5, 31.0, "CAD", "HOUR"),
        ("Base salary USD 85K", 85000, 85000, "USD", "YEAR"),
        ("Compensation up to $90,000 a year", None, 90000, "CAD", "YEAR"),
    ],
)
def test_pay(spark, line, low, high, currency, period):
    got = _one(spark, line, pay.extract_salary)
    assert (got["low"], got["high"], got["currency"], got["period"]) == (low, high, currency, period)


def test_no_pay(spark):
    assert _one(spark, "We raised $5M in funding.", pay.extract_salary) is None


def test_risky_text(spark):
    assert len(_one(spark, "Contact us on WhatsApp. We are nice.", text.off_platform_contact)) == 1
    assert _one(spark, "We never use WhatsApp for hiring.", text.off_platform_contact) == []
    assert len(_one(spark, "You must pay a fee for the training kit.", text.upfront_payment)) == 1
    assert _one(spark, "This is for an existing vacancy. Apply now.", text.vacancy_statement) == "This is for an existing vacancy."


def test_html(spark):
    assert _one(spark, "<p>A &amp; B</p><ul><li>x</li></ul>&#233; &copy;", text.html_to_text) == "A & B\n\n• x\n\né &copy;"


def test_hosts(spark):
    assert _one(spark, "https://www.jobs.example.co.uk/x", urls.hostname) == "jobs.example.co.uk"
    assert _one(spark, "jobs.example.co.uk", urls.registrable) == "example.co.uk"
    assert _one(spark, "not a url", urls.hostname) is None


def test_lookalikes(spark):
    known = spark.createDataFrame([("northwindlabs.example",)], "domain string")
    hosts = spark.createDataFrame([("northwindlabs-careers.test",), ("northwindlab.example",), ("jobs.northwindlabs.example",), ("other.example",), ("boards.greenhouse.io",)], "host string")
    got = {r["host"] for r in dedup.lookalikes(hosts, known).collect()}
    assert got == {"northwindlabs-careers.test", "northwindlab.example"}


def test_vacancy_of_a_long_text_takes_no_square_of_its_length(spark):
    long_ = "word " * 16_000
    rows = spark.createDataFrame([(1, long_), (2, "Good team. Join our talent pool now. More."), (3, long_ + ". This is an existing vacancy.")], "id long, t string")
    begun = time.time()
    got = {r["id"]: r["v"] for r in rows.select("id", text.vacancy_statement(F.col("t")).alias("v")).collect()}
    assert got == {1: None, 2: "Join our talent pool now.", 3: "This is an existing vacancy."}
    assert time.time() - begun < 20


def test_lengths_of_vectors_are_taken_once_a_row(spark):
    rows = spark.createDataFrame([(1, 1, [3.0, 4.0]), (2, 1, [4.0, 3.0]), (3, 1, [0.0, 0.0]), (4, 1, None), (5, 1, [1.0, None])], "posting_id long, block int, vector array<float>")
    ready = dedup.measured(rows)
    assert {r["posting_id"]: r["norm"] for r in ready.collect()} == {1: 5.0, 2: 5.0, 3: 0.0, 4: None, 5: None}
    assert [tuple(r) for r in dedup.block_pairs(ready, dedup.cosine, 0.25).collect()] == [(2, 1, 0.96)]
