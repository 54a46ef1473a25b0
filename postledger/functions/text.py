"""Text operators as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters with accents and their base letters.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"
# Named entities; other names stay as they are.
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}
# Patterns of risky wording, and of sentences that deny it.
NEGATION = r"(?iu)(?<![A-Za-z0-9_])(never|not|n't|no one|will not|won't|don't|do not|reimburse[sd]?|we (will )?provide|provided by us|at our cost|we cover|covered by)(?![A-Za-z0-9_])"
OFF_PLATFORM = [
    r"whats\s?app",
    r"telegram",
    r"wechat",
    r"signal (app|messenger)",
    r"(text|sms|message) (me|us)",
    r"send (me |us )?a text",
    r"(google )?hangouts?",
]
PERSONAL_EMAIL = r"(?iu)[A-Z0-9._%+-]+@(gmail|yahoo|hotmail|outlook|live|icloud|aol|proton(mail)?|gmx)\.[a-z.]+"
PAYMENT = [
    r"(pay|paying|payment|fee|fees|deposit|purchase|buy)\b.{0,50}\b(training|equipment|starter kit|kit|background check|application|registration|onboarding|laptop|software|certification|visa|work permit)",
    r"(training|equipment|starter kit|background check|application|registration|onboarding)\b.{0,30}\b(fee|cost|payment)",
    r"(bitcoin|btc|crypto(currency)?|usdt|ethereum|gift ?cards?)",
    r"(deposit|cash|mobile deposit)\b.{0,30}\b(cheque|check)",
    r"(cheque|check)\b.{0,40}\b(deposit|send (back|the difference)|refund the (difference|excess))",
    r"e-?transfer\b.{0,40}\b(fee|deposit|payment)",
]
VACANCY = (
    r"(?iu)[^.\n]*(?<![A-Za-z0-9_])(existing vacancy|existing position|current vacancy|currently vacant|pool of (candidates|applicants)"
    r"|future (openings|opportunities|vacancies)|talent (pool|community)|poste vacant|vacance existante|poste existant)(?![A-Za-z0-9_])[^.\n]*\.?"
)
# The first match starts a text or follows the end of a sentence; tried nowhere else, the search takes time by the length of a text, not its square.
_VACANCY_AT_START = VACANCY.replace("(?iu)", r"(?iu)(?<![^.\n])", 1)
# Fixed value: a vacancy statement that speaks of no existing vacancy.
NOT_EXISTING = (
    r"(?iu)(?<![A-Za-z0-9_])(not(?![A-Za-z0-9_]).{0,20}(?<![A-Za-z0-9_])existing vacancy|pool|future (openings|opportunities|vacancies)"
    r"|n['’]est pas(?![A-Za-z0-9_]).{0,30}(?<![A-Za-z0-9_])vacant)(?![A-Za-z0-9_])"
)
# Fixed value: sentences of boards that say nothing of the job.
BOILERPLATE = r"(?i)this is a fictional demo posting\.?|posted via [^.\n]+\(demo\)\.?"
# \b knows letters of any script in Java's Unicode mode, so word ends are written out.
_WORD = r"(?iu)(?<![A-Za-z0-9_])({})(?![A-Za-z0-9_])"


def strip_accents(c: Column) -> Column:
    return F.translate(F.regexp_replace(c, r"\p{Mn}+", ""), ACCENTED, PLAIN)


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[\s  ]+", " "))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(strip_accents(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def clip(c: Column, most: int) -> Column:
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.rtrim(F.substring(c, 1, most - 1)), F.lit("…")))


def decode_entities(c: Column) -> Column:
    """Numeric references and the known names; each reference is read once, &amp; last."""
    numeric = F.array_distinct(F.regexp_extract_all(c, F.lit(r"&#(?:[xX][0-9a-fA-F]{1,6}|[0-9]{1,7});"), F.lit(0)))

    def char(ref: Column) -> Column:
        code = F.when(ref.rlike("^&#[xX]"), F.conv(F.regexp_extract(ref, "[0-9a-fA-F]+(?=;)", 0), 16, 10)).otherwise(F.regexp_extract(ref, "[0-9]+", 0))
        code = code.cast("int")
        hex_ = F.lpad(F.hex(code), 8, "0")
        return F.when((code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF), F.decode(F.unhex(hex_), "UTF-32")).otherwise(ref)

    out = F.aggregate(numeric, c, lambda acc, ref: F.replace(acc, ref, char(ref)))
    for name, value in ENTITIES.items():
        out = F.regexp_replace(out, f"(?i)&{name};", value)
    return F.regexp_replace(out, "(?i)&amp;", "&")


def html_to_text(c: Column) -> Column:
    steps = [
        (r"(?is)<(script|style)[^>]*>.*?</\1>", ""),
        (r"(?i)<br\s*/?>", "\n"),
        (r"(?i)<li[^>]*>", "\n• "),
        (r"(?i)</(p|div|h[1-6]|li|ul|ol|tr|section)>", "\n"),
        (r"<[^>]+>", ""),
    ]
    out = reduce(lambda acc, s: F.regexp_replace(acc, *s), steps, c)
    out = decode_entities(out)
    for pattern, by in ((r"[ \t ]+", " "), (r" *\n *", "\n"), (r"\n{3,}", "\n\n")):
        out = F.regexp_replace(out, pattern, by)
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def sentences(c: Column) -> Column:
    parts = F.split(F.regexp_replace(c, r"[\s  ]+", " "), r"(?<=[.!?])\s+|•")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def _risky(found: Column, test) -> Column:
    # few sentences are risky, so the denial is looked for last
    return F.transform(F.filter(found, lambda s: test(s) & ~s.rlike(NEGATION)), lambda s: clip(s, 180))


def off_platform_contact(c: Column, split: bool = False) -> Column:
    """Sentences that ask for contact elsewhere; split: whether c is an array of sentences."""
    any_ = _WORD.format("|".join(OFF_PLATFORM))
    return _risky(c if split else sentences(c), lambda s: s.rlike(any_) | s.rlike(PERSONAL_EMAIL))


def upfront_payment(c: Column, split: bool = False) -> Column:
    """Sentences that ask the applicant to pay; split: whether c is an array of sentences."""
    any_ = _WORD.format("|".join(f"(?:{p})" for p in PAYMENT))
    return _risky(c if split else sentences(c), lambda s: s.rlike(any_))


def vacancy_statement(c: Column) -> Column:
    s = squeeze(F.regexp_extract(c, _VACANCY_AT_START, 0))
    return F.when(F.length(s) > 300, F.concat(F.substring(s, 1, 299), F.lit("…"))).when(s != "", s)


def bind(value: Column, use) -> Column:
    """use(value), with the value computed once a row: a lambda that names an expression computes it anew for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tokens(c: Column) -> Column:
    plain = F.regexp_replace(F.lower(strip_accents(c)), BOILERPLATE, " ")
    return F.filter(F.split(plain, "[^a-z0-9$]+"), lambda w: w != "")


def shingles(c: Column, k: int = 4) -> Column:
    """Distinct hashes of k-word runs; a shorter text is one run."""

    def runs(w: Column) -> Column:
        last = F.greatest(F.size(w) - k + 1, F.lit(1))
        return F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(w, i, k)))).otherwise(F.array().cast("array<bigint>"))

    return F.array_distinct(bind(tokens(c), runs))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)
