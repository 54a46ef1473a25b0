"""Fields of pasted text as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postledger.functions.text import bind

# Labels of lines, and the patterns of links and of words around them.
TITLE_LABELS = "job title|position|role|title"
PLACE_LABELS = "location|based in|city"
EMPLOYER_LABELS = "company|employer|organization|organisation"
LINK = r"https?://[^\s<>\"')]+"
APPLY = r"(?<![A-Za-z0-9_])(?:apply|application)(?![A-Za-z0-9_])"


def _labelled(text: Column, labels: str) -> Column:
    value = F.trim(F.regexp_extract(text, rf"(?im)^(?:{labels})\s*[:\-]\s*(.+)$", 1))
    return F.when(value != "", value)


def first_line(text: Column) -> Column:
    """First line of 3 to 149 characters, without outer spaces."""
    lines = F.transform(F.split(text, r"\r?\n"), lambda s: F.trim(s))
    return F.get(F.filter(lines, lambda s: F.length(s).between(3, 149)), F.lit(0))


def title(text: Column) -> Column:
    return F.coalesce(_labelled(text, TITLE_LABELS), first_line(text))


def employer(text: Column, hint: Column) -> Column:
    return F.coalesce(F.when(F.trim(hint) != "", F.trim(hint)), _labelled(text, EMPLOYER_LABELS))


def place(text: Column) -> Column:
    return _labelled(text, PLACE_LABELS)


def _starts(text: Column, pattern: str) -> Column:
    """Places and texts of all matches: the pieces between matches give the places."""
    found = F.regexp_extract_all(text, F.lit(f"(?i){pattern}"), F.lit(0))
    between = F.split(text, f"(?i){pattern}")
    pairs = F.zip_with(found, F.transform(F.slice(between, F.lit(1), F.size(found)), lambda s: F.length(s)), lambda s, n: F.struct(n.alias("n"), s.alias("s")))
    length = lambda p, n: F.aggregate(F.slice(p, 1, n), F.lit(0), lambda acc, q: acc + q["n"] + F.length(q["s"]))
    return bind(pairs, lambda p: F.transform(p, lambda q, i: F.struct((length(p, i) + q["n"]).alias("at"), q["s"].alias("s"))))


def apply_url(text: Column) -> Column:
    """The link nearest to a word of applying, else the first; closing punctuation is no part of it."""
    both = F.struct(_starts(text, LINK).alias("links"), _starts(text, APPLY).alias("words"))

    def nearest(b: Column) -> Column:
        near = lambda u: F.array_min(F.transform(b["words"], lambda w: F.abs(u["at"] - w["at"])))
        return F.array_min(F.transform(b["links"], lambda u: F.struct(F.coalesce(near(u), F.lit(0)).alias("d"), u["at"].alias("at"), u["s"].alias("s"))))["s"]

    return F.regexp_replace(bind(both, nearest), "[.,;]+$", "")
