"""Host operators as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hiring systems, government boards and suffixes of two labels.
HIRING_SYSTEMS = (
    "greenhouse.io", "lever.co", "ashbyhq.com", "myworkdayjobs.com", "myworkdaysite.com", "smartrecruiters.com", "icims.com",
    "bamboohr.com", "workable.com", "jobvite.com", "taleo.net", "successfactors.com", "successfactors.eu", "recruitee.com",
    "breezy.hr", "jazzhr.com", "applytojob.com", "ultipro.com", "dayforcehcm.com",
)
PUBLIC_BOARDS = ("jobbank.gc.ca", "guichetemplois.gc.ca")
TWO_LABELS = (
    "co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.in", "com.br",
    "gc.ca", "on.ca", "qc.ca", "bc.ca", "ab.ca", "mb.ca", "sk.ca", "ns.ca", "nb.ca", "nl.ca", "pe.ca",
)

# Sites whose terms forbid automated reading.
DISALLOWED = ("linkedin.com", "indeed.com", "ca.indeed.com", "glassdoor.com", "glassdoor.ca", "ziprecruiter.com", "monster.com", "monster.ca", "facebook.com")


def hostname(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def _labels(host: Column) -> Column:
    return F.split(F.regexp_replace(F.lower(host), r"\.$", ""), r"\.")


def _suffix_labels(labels: Column) -> Column:
    return F.when(F.array_join(F.slice(labels, -2, 2), ".").isin(*TWO_LABELS), 2).otherwise(1)


def registrable(host: Column) -> Column:
    labels = _labels(host)
    n = F.size(labels)
    return F.when(n <= 2, F.array_join(labels, ".")).otherwise(
        F.when(_suffix_labels(labels) == 2, F.array_join(F.slice(labels, -3, 3), ".")).otherwise(F.array_join(F.slice(labels, -2, 2), "."))
    )


def brand(host: Column) -> Column:
    """Registrable domain without its suffix and hyphens."""
    labels = _labels(registrable(host))
    keep = F.greatest(F.size(labels) - _suffix_labels(labels), F.lit(0))
    return F.replace(F.array_join(F.slice(labels, F.lit(1), keep), "."), F.lit("-"), F.lit(""))


def is_hiring_system(host: Column) -> Column:
    return registrable(host).isin(*HIRING_SYSTEMS)


def is_public_board(host: Column) -> Column:
    h = F.regexp_replace(F.lower(host), r"^www\.", "")
    out = h.isin(*PUBLIC_BOARDS)
    for b in PUBLIC_BOARDS:
        out = out | h.endswith("." + b)
    return out


def comparable_url(url: Column) -> Column:
    """Host without www and path without a last slash, lower case; the text itself where it is no URL."""
    path = F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/+$", "")
    return F.coalesce(F.lower(F.concat(hostname(url), path)), F.lower(url))


def is_disallowed(host: Column) -> Column:
    return registrable(host).isin(*DISALLOWED)
