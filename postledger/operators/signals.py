"""Evidence signals and the first-match status rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postledger.functions import pay, text, urls
from postledger.functions.steps import once
from postledger.operators.dedup import lookalikes

# Weight of each signal (order of output, and polarity).
WEIGHTS = {
    "ON_EMPLOYER_ATS": 50, "NOT_FOUND_ON_EMPLOYER_SITE": -60, "EMPLOYER_IDENTITY_CONFIRMED": 45, "LOOKALIKE_DOMAIN": -90,
    "APPLY_URL_ON_EMPLOYER_OR_KNOWN_ATS": 35, "APPLY_URL_MISMATCH": -85, "OFF_PLATFORM_CONTACT": -95, "UPFRONT_PAYMENT_REQUEST": -100,
    "RECENTLY_CONFIRMED_LIVE": 40, "STALE": -55, "SALARY_STATED_BY_EMPLOYER": 30, "SALARY_CONFLICT": -70,
    "VACANCY_STATUS_DISCLOSED": 20, "CONSISTENT_ACROSS_SOURCES": 25, "USER_REPORTS": -65,
}
SCAM = ("UPFRONT_PAYMENT_REQUEST", "OFF_PLATFORM_CONTACT", "LOOKALIKE_DOMAIN", "APPLY_URL_MISMATCH")
CONFIRMED_HOURS, STALE_DAYS, REPORTERS = 72, 14, 3
# The status rules in their order; of each group of facts one must hold.
RULES = [
    ("R0", None, [["OVERRIDDEN"]]),
    ("R1", "EXPIRED", [["JOB_EXPIRED", "ALL_RECORDS_EXPIRED"]]),
    ("R2", "HIGH_RISK", [["TWO_SCAM_SIGNALS"]]),
    ("R3", "REVIEW_REQUIRED", [["ONE_SCAM_SIGNAL", "USER_REPORTS", "SALARY_CONFLICT", "OPEN_CLUSTER"]]),
    ("R4", "STALE", [["STALE"]]),
    ("R5", "VERIFIED", [["NOTHING_NEGATIVE"], ["ON_EMPLOYER_ATS"], ["EMPLOYER_IDENTITY_CONFIRMED"], ["RECENTLY_CONFIRMED_LIVE"]]),
    ("R6", "PARTIALLY_VERIFIED", [["NOTHING_NEGATIVE"], ["ON_EMPLOYER_ATS", "EMPLOYER_IDENTITY_CONFIRMED"]]),
    ("R7", "UNVERIFIED", []),
]


def distinct_reporters(reports: DataFrame) -> DataFrame:
    """Pending reporters by job; anonymous reports count one by one."""
    who = F.coalesce(F.col("user_id").cast("string"), F.concat(F.lit("#"), F.col("report_id").cast("string")))
    return reports.where("status = 'PENDING'").groupBy("job_id").agg(F.count_distinct(who).alias("reporters"))


def salary_conflicts(salaries: DataFrame) -> DataFrame:
    """Pairs of stated annual ranges of one job and currency, from different sources, apart by more than the tolerance."""
    s = salaries.withColumns(
        {"lo": pay.annual_low(F.col("low"), F.col("high"), F.col("period")), "hi": pay.annual_high(F.col("low"), F.col("high"), F.col("period"))}
    ).where("lo IS NOT NULL")
    a, b = s.alias("a"), s.alias("b")
    return a.join(
        b,
        (F.col("a.job_id") == F.col("b.job_id"))
        & (F.col("a.currency") == F.col("b.currency"))
        & (F.col("a.source_id") < F.col("b.source_id"))
        & pay.conflict(F.col("a.lo"), F.col("a.hi"), F.col("b.lo"), F.col("b.hi")),
    ).select("a.job_id", F.col("a.source_id").alias("source_a"), F.col("b.source_id").alias("source_b"))


def consistent(records: DataFrame) -> DataFrame:
    """Jobs whose active records, two or more, agree in title stem and place."""
    return (
        records.where("expired_at IS NULL")
        .groupBy("job_id")
        .agg(F.count("*").alias("n"), F.count_distinct("title_stem").alias("stems"), F.count_distinct("location_key").alias("places"))
        .where("n >= 2 AND stems = 1 AND places = 1")
        .select("job_id")
    )


def last_board_check(sources: DataFrame) -> DataFrame:
    """Boards of each employer and their last successful check."""
    return sources.where("owned").groupBy("employer_id").agg(F.max("last_success_at").alias("checked_at"), F.count("*").alias("boards"))


def relative(now: Column, then: Column) -> Column:
    """How long ago, in words (fixed values)."""
    hours = F.floor((F.unix_timestamp(now) - F.unix_timestamp(then)) / 3600 + 0.5)
    return (
        F.when(hours < 1, "less than an hour ago")
        .when(hours == 1, "1 hour ago")
        .when(hours < 48, F.concat(hours.cast("string"), F.lit(" hours ago")))
        .otherwise(F.concat(F.floor(hours / 24 + 0.5).cast("string"), F.lit(" days ago")))
    )


def record_facts(records: DataFrame, sources: DataFrame) -> DataFrame:
    """One row a job: records, active ones, the first active owned one, and whether active ones agree."""
    r = records.join(sources.select("source_id", "source_name", "owned"), "source_id")
    active = F.col("expired_at").isNull()
    only = lambda c: F.when(active, F.col(c))
    own = F.when(active & F.col("owned"), F.struct("source_id", "source_name", "url", "last_verified"))
    agree = [F.min(only(c)).eqNullSafe(F.max(only(c))) for c in ("title_stem", "location_key")]
    return r.groupBy("job_id").agg(
        F.count("*").alias("n_records"), F.count_if(active).alias("n_active"), F.min(own).alias("own"), (agree[0] & agree[1]).alias("agree")
    )


def pay_facts(salaries: DataFrame, sources: DataFrame) -> DataFrame:
    """One row a job: the first pay that an owned source states, and the two statements furthest apart where they conflict.

    Within a currency some two ranges are apart by more than the tolerance
    exactly where the highest low bound and the lowest high bound are, so no
    pairs are made. Rows are dealt by job once for both steps.
    """
    low, high, period = F.col("low"), F.col("high"), F.col("period")
    s = salaries.join(sources.select("source_id", "owned"), "source_id").repartition("job_id")
    lo, hi = pay.annual_low(low, high, period), pay.annual_high(low, high, period)
    by_currency = s.groupBy("job_id", "currency").agg(
        F.min(F.when(F.col("owned"), F.struct("source_id", "evidence"))).alias("hosted"),
        F.max(F.when(lo.isNotNull(), F.struct(lo.alias("at"), F.col("source_id"), F.col("evidence")))).alias("top"),
        F.min(F.when(hi.isNotNull(), F.struct(hi.alias("at"), F.col("source_id"), F.col("evidence")))).alias("bottom"),
    )
    apart = pay.conflict(F.col("top.at"), F.col("top.at"), F.col("bottom.at"), F.col("bottom.at")) & (F.col("top.at") > F.col("bottom.at"))
    clash = F.when(apart, F.struct("currency", F.col("bottom.evidence").alias("one"), F.col("top.evidence").alias("other")))
    return by_currency.groupBy("job_id").agg(F.min("hosted").alias("hosted"), F.min(clash).alias("clash"))


def link_facts(jobs: DataFrame, domains: DataFrame) -> DataFrame:
    """job_id, host of the apply link, whether it is a domain of the employer, whether there are any, what it imitates, and whether it is a hiring system or a public board."""
    own = domains.select("employer_id", urls.registrable(F.col("domain")).alias("reg"), F.lit(True).alias("own_domain")).distinct()
    having = domains.select("employer_id", F.lit(True).alias("has_domain")).distinct()
    linked = jobs.select("job_id", "employer_id", urls.hostname(F.col("apply_url")).alias("host")).where("host IS NOT NULL")
    linked = linked.withColumn("reg", urls.registrable(F.col("host"))).join(own, ["employer_id", "reg"], "left").join(having, "employer_id", "left")
    # columns, so that no signal computes them again
    kind = {"hiring_system": urls.is_hiring_system(F.col("host")), "public_board": urls.is_public_board(F.col("host"))}
    hosts = once(linked.select("host").distinct(), kind)
    hosts = hosts.join(lookalikes(hosts.select("host"), domains), "host", "left")
    return linked.join(hosts, "host").select("job_id", "host", "own_domain", "has_domain", "imitates", *kind)


def _signal(code: str, when: Column, says: Column, at: Column, url: Column | None = None, source: Column | None = None, polarity: Column | None = None) -> Column:
    """Struct of one signal where its condition holds, else null; its weight's sign is its polarity unless one is given."""
    value = F.lit(WEIGHTS[code])
    polarity = F.lit("POSITIVE" if WEIGHTS[code] > 0 else "NEGATIVE") if polarity is None else polarity
    none = F.lit(None).cast("string")
    return F.when(
        when,
        F.struct(
            F.lit(code).alias("code"), polarity.alias("polarity"), value.alias("weight"), says.alias("evidence_text"),
            (none if url is None else url).alias("evidence_url"), at.alias("observed_at"), (F.lit(None) if source is None else source).cast("long").alias("source_id"),
        ),
    )


def _said(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def text_facts(jobs: DataFrame) -> DataFrame:
    """Jobs with elsewhere, money and vacancy, what their texts say first of each; columns, so that no signal computes them again."""
    split = jobs.withColumn("sentences", text.sentences(F.col("text")))
    first = lambda c: F.get(c, F.lit(0))
    return split.withColumns(
        {
            "elsewhere": first(text.off_platform_contact(F.col("sentences"), split=True)),
            "money": first(text.upfront_payment(F.col("sentences"), split=True)),
            "vacancy": text.vacancy_statement(F.col("text")),
        }
    ).drop("sentences")


def text_parts(now: Column) -> list[Column]:
    """Signals of the link and the text of a row with the columns of link_facts and text_facts, apply_url and employer_name."""
    host, linked = F.col("host"), F.col("host").isNotNull()
    fake, own = F.col("imitates").isNotNull(), F.col("own_domain").isNotNull()
    known = F.col("hiring_system") | F.col("public_board")
    kind = F.when(own, ", a domain of the employer.").when(F.col("hiring_system"), ", a common hiring system.").otherwise(", a public job board.")
    to, url = _said("Applications go to ", host), F.col("apply_url")
    elsewhere, money, vacancy = F.col("elsewhere"), F.col("money"), F.col("vacancy")
    existing = F.when(~vacancy.rlike(text.NOT_EXISTING), "POSITIVE").otherwise("NEUTRAL")
    return [
        _signal("LOOKALIKE_DOMAIN", linked & fake, _said(to, ", which resembles ", F.col("imitates"), "."), now, url),
        _signal("APPLY_URL_ON_EMPLOYER_OR_KNOWN_ATS", linked & ~fake & (own | known), _said(to, kind), now, url),
        _signal("APPLY_URL_MISMATCH", linked & ~fake & ~own & ~known & F.col("has_domain").isNotNull(), _said(to, ", neither a domain of ", F.col("employer_name"), " nor a known hiring system."), now, url),
        _signal("OFF_PLATFORM_CONTACT", elsewhere.isNotNull(), _said("“", elsewhere, "”"), now),
        _signal("UPFRONT_PAYMENT_REQUEST", money.isNotNull(), _said("“", money, "”"), now),
        _signal("VACANCY_STATUS_DISCLOSED", vacancy.isNotNull(), _said("“", vacancy, "”"), now, polarity=existing),
    ]


def _long(parts: list[Column], wide: DataFrame, key: str = "job_id") -> DataFrame:
    # nulls go after the generator: array_compact would keep the signals' columns from being compiled
    return wide.select(key, F.explode(F.array(*parts)).alias("s")).where("s IS NOT NULL").select(key, "s.*")


def text_signals(jobs: DataFrame, domains: DataFrame, now: Column) -> DataFrame:
    """Signals that apply links and texts give. jobs: job_id, employer_id, employer_name, apply_url, text; domains: employer_id, domain."""
    return _long(text_parts(now), text_facts(jobs).join(link_facts(jobs, domains), "job_id", "left"))


def compute(jobs: DataFrame, records: DataFrame, sources: DataFrame, salaries: DataFrame, reports: DataFrame, domains: DataFrame, now: Column, boards: DataFrame | None = None) -> DataFrame:
    """job_id, code, polarity, weight, evidence_text, evidence_url, observed_at, source_id: all fifteen signals.

    One aggregate a job over each child table, joined to the jobs once; the
    signals are columns of that row until they are exploded. boards (a key
    and checked_at) stands in for the employers' own last checks.
    """
    boards = last_board_check(sources).select("employer_id", "checked_at") if boards is None else boards
    wide = (
        text_facts(jobs).join(record_facts(records, sources), "job_id", "left")
        .join(pay_facts(salaries, sources), "job_id", "left")
        .join(distinct_reporters(reports), "job_id", "left")
        .join(link_facts(jobs, domains), "job_id", "left")
        .join(boards, [c for c in boards.columns if c != "checked_at"], "left")
    )
    own, name = F.col("own"), F.col("employer_name")
    proof, first, checked = F.col("last_verified"), F.col("first_seen"), F.col("checked_at")
    tied = own.isNotNull() | F.col("own_domain").isNotNull()
    stale = F.col("expired_at").isNull() & (F.coalesce(proof, first) < now - F.expr(f"INTERVAL {STALE_DAYS} DAYS"))
    since = F.when(proof.isNotNull(), _said("Confirmed ", relative(now, proof), ".")).otherwise(_said("Seen first ", relative(now, first), " and not confirmed since."))
    parts = [
        _signal("ON_EMPLOYER_ATS", own.isNotNull(), _said("The employer board ", own["source_name"], " lists it."), F.coalesce(own["last_verified"], now), own["url"], own["source_id"]),
        _signal("NOT_FOUND_ON_EMPLOYER_SITE", own.isNull() & checked.isNotNull(), _said("The board of ", name, " was read ", relative(now, checked), " and does not list it."), checked),
        _signal(
            "EMPLOYER_IDENTITY_CONFIRMED", (F.col("identity") == "CONFIRMED") & tied,
            F.coalesce("identity_text", _said("The site of ", name, " points to this board.")), F.coalesce("identity_at", now), F.col("identity_url"),
        ),
        *text_parts(now),
        _signal("RECENTLY_CONFIRMED_LIVE", proof >= now - F.expr(f"INTERVAL {CONFIRMED_HOURS} HOURS"), _said("Confirmed ", relative(now, proof), "."), proof),
        _signal("STALE", stale, since, now),
        _signal("SALARY_STATED_BY_EMPLOYER", F.col("hosted").isNotNull(), _said("“", F.col("hosted.evidence"), "”"), now, source=F.col("hosted.source_id")),
        _signal("SALARY_CONFLICT", F.col("clash").isNotNull(), _said("“", F.col("clash.one"), "” against “", F.col("clash.other"), "”"), now),
        _signal(
            "CONSISTENT_ACROSS_SOURCES", (F.col("n_active") >= 2) & F.col("agree") & F.col("clash").isNull(),
            _said("Title and place agree on ", F.col("n_active").cast("string"), " sources."), now,
        ),
        _signal("USER_REPORTS", F.col("reporters") >= REPORTERS, _said(F.col("reporters").cast("string"), " people reported it; staff have yet to decide."), now),
    ]
    return _long(parts, wide)


def signal_catalog(spark: SparkSession) -> DataFrame:
    """code, weight, polarity, scam: the fifteen signals as rows."""
    rows = [(c, w, "POSITIVE" if w > 0 else "NEGATIVE", c in SCAM) for c, w in WEIGHTS.items()]
    return spark.createDataFrame(rows, "code string, weight int, polarity string, scam boolean")


def rule_catalog(spark: SparkSession) -> DataFrame:
    """place, rule, status (null: as overridden), all_of: groups of facts, of each of which one must hold."""
    return spark.createDataFrame([(i, r, s, groups) for i, (r, s, groups) in enumerate(RULES)], "place int, rule string, status string, all_of array<array<string>>")


def threshold_catalog(spark: SparkSession) -> DataFrame:
    """name, value of each threshold."""
    return spark.createDataFrame([("confirmed_hours", CONFIRMED_HOURS), ("stale_days", STALE_DAYS), ("reporters", REPORTERS)], "name string, value int")


def facts(jobs: DataFrame, signals: DataFrame, overrides: DataFrame | None = None, clusters: DataFrame | None = None, records: DataFrame | None = None) -> DataFrame:
    """job_id, override_status, facts: what rules may ask of a job, as the codes of its signals and a few more names.

    jobs: job_id, expired_at; overrides: job_id, override_status; clusters:
    job_id of jobs with an open duplicate cluster; records: job_id, expired_at.
    """
    told = signals.groupBy("job_id").agg(
        F.collect_set("code").alias("codes"), F.count_if(F.col("code").isin(*SCAM)).alias("scam"), F.count_if(F.col("polarity") == "NEGATIVE").alias("negative")
    )
    j = jobs.select("job_id", "expired_at").join(told, "job_id", "left")
    nothing = F.lit(None).cast("string")
    j = j.withColumn("override_status", nothing) if overrides is None else j.join(overrides.where("override_status IS NOT NULL").select("job_id", "override_status"), "job_id", "left")
    j = j.withColumn("open_cluster", F.lit(None).cast("boolean")) if clusters is None else j.join(clusters.select("job_id").distinct().withColumn("open_cluster", F.lit(True)), "job_id", "left")
    gone = None if records is None else records.groupBy("job_id").agg(F.every(F.col("expired_at").isNotNull()).alias("gone"))
    j = j.withColumn("gone", F.lit(None).cast("boolean")) if gone is None else j.join(gone, "job_id", "left")
    named = {
        "OVERRIDDEN": F.col("override_status").isNotNull(),
        "JOB_EXPIRED": F.col("expired_at").isNotNull(),
        "ALL_RECORDS_EXPIRED": F.col("gone"),
        "TWO_SCAM_SIGNALS": F.col("scam") >= 2,
        "ONE_SCAM_SIGNAL": F.col("scam") == 1,
        "OPEN_CLUSTER": F.col("open_cluster"),
        "NOTHING_NEGATIVE": F.coalesce("negative", F.lit(0)) == 0,
    }
    held = F.array_compact(F.array(*(F.when(c, n) for n, c in named.items())))
    return j.select("job_id", "override_status", F.concat(F.coalesce("codes", F.array().cast("array<string>")), held).alias("facts"))


def status(
    jobs: DataFrame, signals: DataFrame, overrides: DataFrame | None = None, clusters: DataFrame | None = None, records: DataFrame | None = None, rules: DataFrame | None = None
) -> DataFrame:
    """job_id, status, rule: the first rule that matches. rules: a table like rule_catalog, of which a handful of rows is compiled; others as in facts."""
    rules = rule_catalog(jobs.sparkSession) if rules is None else rules
    told = facts(jobs, signals, overrides, clusters, records)
    rule, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in rules.orderBy(F.desc("place")).collect():  # a catalog: a row a rule
        holds = F.lit(True)
        for group in r["all_of"]:
            holds = holds & F.arrays_overlap("facts", F.array(*map(F.lit, group)))
        rule = F.when(holds, r["rule"]).otherwise(rule)
        name = F.when(holds, F.col("override_status") if r["status"] is None else F.lit(r["status"])).otherwise(name)
    return told.select("job_id", name.alias("status"), rule.alias("rule"))


def history(previous: DataFrame, current: DataFrame, at: Column) -> DataFrame:
    """A row for each job whose status is new or has changed."""
    p = previous.select("job_id", F.col("status").alias("from_status"))
    return current.join(p, "job_id", "left").where(~F.col("from_status").eqNullSafe(F.col("status"))).select("job_id", "from_status", F.col("status").alias("to_status"), at.alias("at"))


def supersede(current: DataFrame, fresh: DataFrame, at: Column) -> DataFrame:
    """Close the open signals of touched jobs and append the fresh ones."""
    touched = fresh.select("job_id").distinct().withColumn("touched", F.lit(True))
    closed = current.join(touched, "job_id", "left").withColumn(
        "superseded_at", F.when(F.col("superseded_at").isNull() & F.col("touched"), at).otherwise(F.col("superseded_at"))
    )
    return closed.drop("touched").unionByName(fresh.withColumn("superseded_at", F.lit(None).cast("timestamp")), allowMissingColumns=True)


def ordered(signals: DataFrame) -> DataFrame:
    """Signals of each job, the weightiest first."""
    w = Window.partitionBy("job_id").orderBy(F.desc("weight"), "code")
    return signals.withColumn("position", F.row_number().over(w))


def current(signals: DataFrame) -> DataFrame:
    """Signals that none has superseded."""
    return signals.where("superseded_at IS NULL")


def known_domains(domains: DataFrame) -> DataFrame:
    """Registrable domains of all employers, each once."""
    return domains.select(urls.registrable(F.col("domain")).alias("domain")).where("domain <> ''").distinct()
