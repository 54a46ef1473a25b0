"""From parsed postings to records: projection, validation, quarantine, known records, sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postledger.functions import normalize, urls
from postledger.functions.steps import spread

MESSAGE, ATTEMPTS = 2000, 3
# What stands before a board's own token in links to it.
BOARD_LINKS = {
    "greenhouse": r"(?<![A-Za-z0-9-])(?:job-)?boards(?:-api)?[.]greenhouse[.]io/(?:v1/boards/)?|greenhouse[.]io/embed/job_board(?:/js)?[?]for=",
    "lever": r"(?<![A-Za-z0-9-])jobs[.]lever[.]co/|(?<![A-Za-z0-9-])api[.]lever[.]co/v0/postings/",
}


def split(parsed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Normalised postings that are valid, those left out on purpose, and malformed ones, the last two with reason.

    The three parts are filters of one projection; write it once if more than one is read.
    """
    rows = normalize.checked(normalize.posting(spread(parsed)))
    part = lambda o: rows.where(F.col("outcome") == o)
    return part("VALID").drop("outcome", "reason"), part("SKIPPED").drop("outcome"), part("INVALID").drop("outcome")


def errors(failed: DataFrame, stage: str, now: Column) -> DataFrame:
    """Error rows of failed postings: where, why, and by which reference, never the content.

    A permanent failure, or one that has used up its attempts, is a dead letter at once.
    failed: source_id, external_ref, reason, and optionally permanent and retry_count.
    """
    permanent = F.col("permanent") if "permanent" in failed.columns else F.lit(True)
    retries = F.col("retry_count") if "retry_count" in failed.columns else F.lit(0)
    return failed.select(
        "source_id",
        F.lit(stage).alias("stage"),
        F.left("reason", F.lit(MESSAGE)).alias("message"),
        F.col("external_ref").alias("payload_ref"),
        retries.alias("retry_count"),
        F.when(permanent | (retries >= ATTEMPTS), now).alias("dead_lettered_at"),
        F.lit(None).cast("timestamp").alias("resolved_at"),
    )


def resolve_errors(found: DataFrame, decisions: DataFrame) -> DataFrame:
    """Errors with the time of their resolution, where staff resolved an open one. decisions: source_id, payload_ref, decided_at."""
    made = decisions.groupBy("source_id", "payload_ref").agg(F.min("decided_at").alias("decided_at"))
    out = found.join(made, ["source_id", "payload_ref"], "left")
    return out.withColumn("resolved_at", F.coalesce("resolved_at", "decided_at")).drop("decided_at")


def known_jobs(postings: DataFrame, records: DataFrame) -> DataFrame:
    """Postings with the job of the record that (source_id, external_ref) already has, null where there is none."""
    return postings.join(records.select("source_id", "external_ref", "job_id"), ["source_id", "external_ref"], "left")


def upsert_sources(current: DataFrame, described: DataFrame) -> DataFrame:
    """Sources by key: what the description says now, with id, enabled and last success of the one that is there.

    described: key, source_name, owned, employer_id; a new source's id is the hash of its key, so runs agree.
    """
    c, d = current.alias("c"), described.dropDuplicates(["key"]).alias("d")
    there = F.col("d.key").isNotNull()
    pick = lambda n: F.when(there, F.col(f"d.{n}")).otherwise(F.col(f"c.{n}")).alias(n)
    return c.join(d, F.col("c.key") == F.col("d.key"), "full").select(
        F.coalesce("c.key", "d.key").alias("key"),
        F.coalesce("c.source_id", F.xxhash64("d.key")).alias("source_id"),
        *(pick(n) for n in ("source_name", "owned", "employer_id")),
        F.coalesce("c.enabled", F.lit(True)).alias("enabled"),
        F.col("c.last_success_at").alias("last_success_at"),
    )


def last_success(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """Sources with their last success moved on by runs (source_id, status, finished_at) that did not fail."""
    good = runs.where("status <> 'FAILED'").groupBy("source_id").agg(F.max("finished_at").alias("finished_at"))
    return sources.join(good, "source_id", "left").withColumn("last_success_at", F.greatest("last_success_at", "finished_at")).drop("finished_at")


def board_probe(employers: DataFrame, pages: DataFrame) -> DataFrame:
    """employer_id, linked: whether the careers page of the employer links its board; null where none counts or it was not read.

    employers: employer_id, domain, careers_url, board (a key of BOARD_LINKS),
    board_token; pages: url, html or null. A careers page counts only on the
    employer's own domain.
    """
    own = urls.registrable(urls.hostname(F.col("careers_url"))) == urls.registrable(F.col("domain"))
    token = F.regexp_replace("board_token", r"([^A-Za-z0-9_])", r"\\$1")
    link = F.lit(None).cast("string")
    for board, before in BOARD_LINKS.items():
        link = F.when(F.col("board") == board, F.concat(F.lit(f"(?i)(?:{before})"), token, F.lit(r"(?![A-Za-z0-9_])"))).otherwise(link)
    p = pages.where("html IS NOT NULL").select(F.col("url").alias("careers_url"), "html")
    found = employers.where(own).withColumn("pattern", link).join(p, "careers_url").select("employer_id", F.regexp_like("html", F.col("pattern")).alias("hit"))
    return employers.select("employer_id").join(found.groupBy("employer_id").agg(F.bool_or("hit").alias("linked")), "employer_id", "left")
