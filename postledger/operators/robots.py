"""Crawling permission: rules of each host applied to links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rules(files: DataFrame, agent: str) -> DataFrame:
    """host, pattern, allow: the lines of each host's file (host, body) that hold for an agent.

    Consecutive user-agent lines head one group; the first group that names
    the agent counts, else the first for all agents.
    """
    token = agent.split("/")[0].lower()
    line = F.trim(F.regexp_replace("line", "#.*$", ""))
    lines = (
        files.select("host", F.posexplode(F.split("body", r"\r?\n")).alias("at", "line"))
        .select("host", "at", F.lower(F.regexp_extract(line, r"^([A-Za-z-]+)\s*:", 1)).alias("field"), F.trim(F.regexp_extract(line, r"^[A-Za-z-]+\s*:\s*(.*)$", 1)).alias("value"))
        .where("field <> ''")
        .groupBy("host")  # a file of rules is one small row as it came
        .agg(F.array_sort(F.collect_list(F.struct("at", "field", "value"))).alias("rows"))
    )
    # number the groups: a user-agent line after another kind of line begins one
    begins = lambda r, i: (r["field"] == "user-agent") & ((i == 0) | (F.get("rows", i - 1)["field"] != "user-agent"))
    starts = F.filter(F.transform("rows", lambda r, i: F.when(begins(r, i), i)), lambda x: x.isNotNull())
    rows = lines.withColumn("starts", starts).select(
        "host", F.explode(F.transform("rows", lambda r, i: F.struct(F.size(F.filter("starts", lambda s: s <= i)).alias("g"), r["field"].alias("field"), r["value"].alias("value")))).alias("r")
    )
    rows = rows.select("host", "r.*").where("g > 0")
    name = F.lower("value")
    named = rows.where("field = 'user-agent'").groupBy("host").agg(
        F.coalesce(F.min(F.when((name != "*") & F.contains(F.lit(token), name), F.col("g"))), F.min(F.when(name == "*", F.col("g")))).alias("g")
    )
    told = rows.where("field IN ('allow', 'disallow') AND value <> ''").join(named, ["host", "g"])
    return told.select("host", F.col("value").alias("pattern"), (F.col("field") == "allow").alias("allow"))


def to_regex(pattern: Column) -> Column:
    """Prefix patterns with * for anything and a closing $ for the end."""
    body = F.regexp_replace(F.regexp_replace(pattern, r"\$$", ""), r"([.+?^${}()|\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(body, F.lit("*"), F.lit(".*")), F.when(pattern.endswith("$"), "$").otherwise(""))


def allowed(links: DataFrame, told: DataFrame) -> DataFrame:
    """links (link_id, host, path) with allowed: the longest matching pattern wins, allowing wins ties, no match allows."""
    r = told.select("host", "pattern", "allow", to_regex(F.col("pattern")).alias("regex"))
    best = F.max(F.when(F.rlike(F.col("path"), F.col("regex")), F.struct(F.length("pattern"), "allow")))
    return links.join(r, "host", "left").groupBy("link_id").agg(F.coalesce(best["allow"], F.lit(True)).alias("allowed"))
