"""Employers: lookup by alias key, creation, domains, and the identity state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postledger.functions import normalize

# Hours between probes of one employer, and days for which an old proof still counts.
PROBE_HOURS, GRACE_DAYS = 24, 30


def posting_employer(postings: DataFrame) -> DataFrame:
    """Key of each posting's employer: the configured one of an owned board, else the name in the posting."""
    name = F.when(F.col("employer_owned"), F.coalesce("hint_name", "employer_name")).otherwise(F.col("employer_name"))
    return postings.withColumn("alias_normalized", normalize.employer_key(name))


def by_alias(postings: DataFrame, aliases: DataFrame) -> DataFrame:
    """employer_id of each posting's key, null where the key is not known; of several the smallest."""
    one = aliases.groupBy("alias_normalized").agg(F.min("employer_id").alias("employer_id"))
    return postings.join(one, "alias_normalized", "left")


def new_employers(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row for each key that no alias has: slug, display name (the first in order) and UNKNOWN identity."""
    keyed = names.select("name", normalize.employer_key(F.col("name")).alias("alias_normalized")).where("alias_normalized <> ''")
    return (
        keyed.join(aliases.select("alias_normalized"), "alias_normalized", "left_anti")
        .groupBy("alias_normalized")
        .agg(F.min("name").alias("display_name"))
        .select(F.col("alias_normalized").alias("slug"), "display_name", F.lit("UNKNOWN").alias("identity"))
    )


def attach_domains(current: DataFrame, hinted: DataFrame) -> DataFrame:
    """Domains that an employer's own board configuration names join those already there."""
    key = ["employer_id", "domain", "kind"]
    return current.unionByName(hinted.select(*key).distinct().join(current, key, "left_anti"), allowMissingColumns=True)


def transition(employers: DataFrame, probes: DataFrame, now: Column) -> DataFrame:
    """Next identity of each employer and whether it changed.

    A probe counts when the last check is missing or over PROBE_HOURS old. A
    link confirms, a missing link makes PROBABLE, an unknown outcome keeps
    CONFIRMED while the last proof is younger than GRACE_DAYS.
    """
    p = probes.select("employer_id", "linked", F.lit(True).alias("probed"))
    hours = F.col("identity_checked_at") < now - F.expr(f"INTERVAL {PROBE_HOURS} HOURS")
    counts = F.coalesce("probed", F.lit(False)) & F.coalesce(hours, F.lit(True))
    fresh = F.coalesce((F.col("identity") == "CONFIRMED") & (F.col("proof_at") > now - F.expr(f"INTERVAL {GRACE_DAYS} DAYS")), F.lit(False))
    after = (
        F.when(~counts, F.when(F.col("identity") == "UNKNOWN", "PROBABLE").otherwise(F.col("identity")))
        .when(F.col("linked"), "CONFIRMED")
        .when(~F.col("linked"), "PROBABLE")
        .otherwise(F.when(fresh, "CONFIRMED").otherwise("PROBABLE"))
    )
    renewed = counts & (F.col("linked").isNotNull() | ~fresh)
    return employers.join(p, "employer_id", "left").select(
        "employer_id",
        after.alias("identity"),
        (after != F.col("identity")).alias("changed"),
        F.when(counts, now).otherwise(F.col("identity_checked_at")).alias("identity_checked_at"),
        F.when(renewed, now).otherwise(F.col("proof_at")).alias("proof_at"),
    )
