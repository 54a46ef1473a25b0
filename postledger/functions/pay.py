"""Pay operators as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postledger.functions import text

# Parts of a year by period.
ANNUAL = {"HOUR": 2080, "DAY": 260, "WEEK": 52, "MONTH": 12, "YEAR": 1}
# Wording of pay, its periods and its currencies.
_SPACE = r"[,\s  ]"
NUMBER = rf"(\d{{1,3}}(?:{_SPACE}\d{{3}})+(?:\.\d{{1,2}})?|\d+(?:[.,]\d{{1,2}})?)\s?([kK])?"
_PLAIN_NUMBER = NUMBER.replace("(\\d{1,3}", "(?:\\d{1,3}", 1).replace("([kK])?", "[kK]?")
AMOUNT = rf"(?:(?:(?:CAD|CA\$|C\$|USD|US\$)\s?|\$\s?){_PLAIN_NUMBER}|{_PLAIN_NUMBER}(?:\s?\$|\s?(?:CAD|USD)))"
RANGE = rf"(?iu){AMOUNT}\s*(?:-|–|—|to|and|à|et)\s*(?:{AMOUNT}|{_PLAIN_NUMBER})"
QUALIFIER = r"up to|maximum of|max\.?|starting (?:at|from)|from|minimum of|at least|jusqu'à|à partir de"
SINGLE = rf"(?iu)(?:(?:{QUALIFIER})\s*)?{AMOUNT}"
CONTEXT = (
    r"(?iu)(?<![A-Za-z0-9_])(salary|salaire|pay|wage|compensation|rémunération|remuneration|rate|taux|base|range|fourchette|per (hour|year|annum)"
    r"|an hour|a year|hourly|annual|starting at)(?![A-Za-z0-9_])|/\s?(hr|hour|h|year|yr)(?![A-Za-z0-9_])"
)
PERIODS = [
    (r"(?iu)\b(per|an|a|/)\s*(hour|hr|h)\b|\bhourly\b|\bde l['’]heure\b|\bpar heure\b|/\s?h\b", "HOUR"),
    (r"(?iu)\b(per|a|/)\s*(year|yr|annum)\b|\bannual(ly)?\b|\bpar (année|an)\b|\bannuel(lement)?\b|/\s?an\b", "YEAR"),
    (r"(?iu)\b(per|a|/)\s*month\b|\bmonthly\b|\bpar mois\b", "MONTH"),
    (r"(?iu)\b(per|a|/)\s*week\b|\bweekly\b|\bpar semaine\b", "WEEK"),
    (r"(?iu)\b(per|a|/)\s*day\b|\bdaily\b|\bpar jour\b", "DAY"),
]


def factor(period: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, f in ANNUAL.items():
        out = F.when(period == name, F.lit(float(f))).otherwise(out)
    return out


def parse_number(raw: Column) -> Column:
    """A number with separators, a decimal comma or a K."""
    digits = F.regexp_replace(raw, r"[\s  kK]", "")
    plain = F.when(digits.rlike(r"^\d+,\d{1,2}$"), F.replace(digits, F.lit(","), F.lit("."))).otherwise(F.replace(digits, F.lit(","), F.lit("")))
    return plain.try_cast("double") * F.when(raw.rlike("[kK]"), 1000.0).otherwise(1.0)


def infer_period(context: Column, top: Column) -> Column:
    out = F.when(top < 200, "HOUR").when(top >= 10_000, "YEAR")
    for pattern, name in reversed(PERIODS):
        out = F.when(context.rlike(pattern), name).otherwise(out)
    return out


def _around(line: Column, at: Column, hit: Column) -> Column:
    """The sentence of a line that holds a hit, at most 200 characters."""
    before = F.regexp_replace(F.substring(line, F.lit(1), at - 1), r"(?s)^.*\. ", "")
    rest = F.substring(line, at + F.length(hit), F.length(line))
    after = F.regexp_extract(rest, r"(?s)^(.*?\.) ", 1)
    return text.clip(F.regexp_replace(F.concat(before, hit, F.when(after != "", after).otherwise(rest)), r"^\s+|\s+$", ""), 200)


def salary_of(line: Column) -> Column:
    """Struct of low, high, currency, period, evidence of one line: its first amount decides; null if that is no pay."""
    ranged = F.regexp_extract(line, RANGE, 0)
    hit = F.when(ranged != "", ranged).otherwise(F.regexp_extract(line, SINGLE, 0))
    at = F.when(ranged != "", F.regexp_instr(line, F.lit(RANGE))).otherwise(F.regexp_instr(line, F.lit(SINGLE)))
    found = F.struct(line.alias("line"), hit.alias("hit"), at.alias("at"), (ranged != "").alias("is_range"))

    def parts(f: Column) -> Column:
        numbers = F.transform(F.regexp_extract_all(f["hit"], F.lit(f"(?iu){_PLAIN_NUMBER}"), F.lit(0)), parse_number)
        word = F.lower(F.regexp_extract(f["hit"], rf"(?iu)^({QUALIFIER})", 1))
        after = F.substring(f["line"], f["at"] + F.length(f["hit"]), F.lit(40))
        return F.struct(
            f["hit"].alias("hit"), numbers.alias("numbers"), f["is_range"].alias("is_range"), word.alias("word"), after.alias("after"),
            _around(f["line"], f["at"], f["hit"]).alias("evidence"),
        )

    def read(p: Column) -> Column:
        a, b = F.get(p["numbers"], F.lit(0)), F.get(p["numbers"], F.lit(1))
        two = p["is_range"] & (F.size(p["numbers"]) >= 2)
        low0, high0 = F.least(a, b), F.greatest(a, b)
        low0 = F.when((low0 < 1000) & (high0 >= 1000) & p["hit"].rlike("[kK]") & (high0 / low0 > 100), low0 * 1000).otherwise(low0)
        most = p["word"].rlike("up to|max|jusqu")
        low = F.when(two, low0).when(~most, a)
        high = F.when(two, high0).when((p["word"] == "") | most, a)
        top = F.coalesce(high, low)
        fine = (p["hit"] != "") & p["evidence"].rlike(CONTEXT) & F.forall(p["numbers"], lambda n: n.isNotNull() & (n > 0)) & top.between(10, 1_000_000)
        return F.when(
            fine,
            F.struct(
                low.alias("low"), high.alias("high"), F.when(p["hit"].rlike(r"(?i)USD|US\$"), "USD").otherwise("CAD").alias("currency"),
                infer_period(F.concat_ws(" ", p["after"], p["evidence"]), top).alias("period"), p["evidence"].alias("evidence"),
            ),
        )

    return text.bind(text.bind(found, parts), read)


def extract_salary(body: Column) -> Column:
    """Pay of the first line that states it."""
    return F.get(F.filter(F.transform(F.split(body, "\n+"), salary_of), lambda s: s.isNotNull()), F.lit(0))


def annual_low(low: Column, high: Column, period: Column) -> Column:
    return F.coalesce(low, high) * factor(period)


def annual_high(low: Column, high: Column, period: Column) -> Column:
    return F.coalesce(high, low) * factor(period)


def overlap(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    """Shared part of two annual ranges; equal points 1."""
    width = F.greatest(hi1, hi2) - F.least(lo1, lo2)
    shared = F.greatest(F.least(hi1, hi2) - F.greatest(lo1, lo2), F.lit(0.0))
    return F.when(lo1.isNull() | lo2.isNull(), None).when(width == 0, 1.0).otherwise(shared / width)


def conflict(lo1: Column, hi1: Column, lo2: Column, hi2: Column, tolerance: float = 0.10) -> Column:
    """Whether two annual ranges stay apart after both are widened."""
    return (lo1 * (1 - tolerance) > hi2 * (1 + tolerance)) | (lo2 * (1 - tolerance) > hi1 * (1 + tolerance))
