"""Readers of landed board files: explicit schemas, one row per posting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postledger.functions import text

BOARD = """jobs array<struct<id bigint, title string, updated_at string, first_published string, absolute_url string, company_name string,
    location struct<name string>, content string, metadata array<struct<name string, value string>>, offices array<struct<name string, location string>>>>"""
PAGED = """id string, text string, categories struct<commitment string, location string, team string, allLocations array<string>>, createdAt bigint,
    hostedUrl string, applyUrl string, descriptionPlain string, additionalPlain string, lists array<struct<text string, content string>>, workplaceType string,
    country string, salaryRange struct<min double, max double, currency string, interval string>"""
EXTRACT = "jobId string, title string, employerName string, city string, province string, workplace string, employmentType string, salaryText string, datePosted string, description string"
# Interval names of the paged board.
INTERVALS = {"per-year-salary": "YEAR", "per-month-salary": "MONTH", "per-week-salary": "WEEK", "per-day-wage": "DAY", "per-hour-wage": "HOUR"}


# Names of a board's metadata, and the size of a full page.
WORKPLACE, EMPLOYMENT = r"(?i)workplace|remote|location type", r"(?i)employment|job type|commitment"
PAGE = 100


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def board(spark: SparkSession, path: str, employer: str | None = None) -> DataFrame:
    """One document that holds all open jobs."""
    return board_postings(_json(spark, path, BOARD).select(F.explode("jobs").alias("j")).select("j.*"), employer)


def board_postings(j: DataFrame, employer: str | None = None, *keep: str) -> DataFrame:
    """Postings of jobs of a board document, with further columns to keep."""
    offices = F.array_join(F.transform("offices", lambda o: F.coalesce(o["location"], o["name"])), "; ")
    meta = lambda p: F.get(F.filter("metadata", lambda m: m["name"].rlike(p)), F.lit(0))["value"]
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    return j.select(
        *keep,
        F.col("id").cast("string").alias("external_ref"),
        F.trim("title").alias("title"),
        F.coalesce(filled(F.col("company_name")), F.lit(employer)).alias("employer_name"),
        F.coalesce(filled(F.col("location.name")), F.nullif(offices, F.lit(""))).alias("location_text"),
        meta(WORKPLACE).alias("workplace_text"),
        meta(EMPLOYMENT).alias("employment_text"),
        F.coalesce(text.html_to_text(text.decode_entities(F.col("content"))), F.lit("")).alias("description"),
        F.col("absolute_url").alias("url"),
        F.col("absolute_url").alias("apply_url"),
        F.col("first_published").try_cast("timestamp").alias("posted_at"),
    )


def paged(spark: SparkSession, path: str, employer: str) -> DataFrame:
    """A folder of pages, each an array of postings."""
    return paged_postings(_json(spark, path, PAGED), employer)


def paged_postings(j: DataFrame, employer: str | None = None, *keep: str) -> DataFrame:
    """Postings of the rows of a paged board, with further columns to keep."""
    sections = F.transform("lists", lambda s: F.concat_ws("\n", s["text"], text.html_to_text(s["content"])))
    place = F.coalesce("categories.location", F.get("categories.allLocations", F.lit(0)))
    period = F.lit(None).cast("string")
    for name, p in INTERVALS.items():
        period = F.when(F.col("salaryRange.interval") == name, p).otherwise(period)
    return j.select(
        *keep,
        F.col("id").alias("external_ref"),
        F.trim("text").alias("title"),
        F.lit(employer).alias("employer_name"),
        F.when((F.col("country") == "CA") & ~place.rlike("(?i)canada"), F.concat(place, F.lit(", Canada"))).otherwise(place).alias("location_text"),
        F.col("workplaceType").alias("workplace_text"),
        F.col("categories.commitment").alias("employment_text"),
        F.concat_ws("\n\n", "descriptionPlain", F.array_join(sections, "\n\n"), "additionalPlain").alias("description"),
        F.col("hostedUrl").alias("url"),
        F.col("applyUrl").alias("apply_url"),
        F.timestamp_millis("createdAt").alias("posted_at"),
        F.col("salaryRange.min").alias("low"),
        F.col("salaryRange.max").alias("high"),
        F.col("salaryRange.currency").alias("currency"),
        period.alias("period"),
    )


def complete_pages(pages: DataFrame) -> DataFrame:
    """Sources whose landed pages are whole: the last page, and only it, has fewer than PAGE rows.

    pages: source_id, page (from 0), rows.
    """
    last = F.max_by("rows", "page")
    return pages.groupBy("source_id").agg(
        ((F.count("*") == F.max("page") + 1) & (last < PAGE) & (F.count_if(F.col("rows") < PAGE) == 1)).alias("complete"), F.sum("rows").alias("rows")
    )


def extract(spark: SparkSession, path: str) -> DataFrame:
    """A file with an array of flat records; pay text joins the description."""
    return extract_postings(_json(spark, path, EXTRACT))


def extract_postings(j: DataFrame, employer: str | None = None, *keep: str) -> DataFrame:
    """Postings of flat records, with further columns to keep."""
    return j.select(
        *keep,
        F.col("jobId").alias("external_ref"),
        F.trim("title").alias("title"),
        F.col("employerName").alias("employer_name"),
        F.concat_ws(", ", "city", "province").alias("location_text"),
        F.col("workplace").alias("workplace_text"),
        F.col("employmentType").alias("employment_text"),
        F.concat_ws("\n", "description", "salaryText").alias("description"),
        F.col("datePosted").try_cast("timestamp").alias("posted_at"),
    )
