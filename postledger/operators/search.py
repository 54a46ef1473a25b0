"""Filtered and ranked search over jobs, stored filter sets, and the text index."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postledger.functions import pay, stems
from postledger.functions.steps import spread
from postledger.sources import store

PAGE = 20
# Allowed values of a filter set.
REMOTE = ("ONSITE", "HYBRID", "REMOTE")
EMPLOYMENT = ("FULL_TIME", "PART_TIME", "CONTRACT", "TEMPORARY", "INTERNSHIP", "SEASONAL")
STATUS = ("VERIFIED", "PARTIALLY_VERIFIED", "UNVERIFIED", "STALE", "REVIEW_REQUIRED", "HIGH_RISK")
SOURCE_TYPES = ("ATS_PUBLIC_BOARD", "EMPLOYER_CAREER_PAGE", "GOVERNMENT_OPEN_DATA", "LICENSED_FEED", "EMPLOYER_SUBMITTED", "DEMO")
SORTS = ("relevance", "newest", "confirmed", "salary")
# Names of the filters as stored, in their order, by column.
FILTERS = {
    "q": "q", "employer": "employer", "city": "city", "province": "province", "remote_type": "remoteType", "employment_type": "employmentType",
    "salary_min": "salaryMin", "status": "status", "source_type": "sourceType", "posted_within_days": "postedWithinDays",
    "confirmed_within_days": "confirmedWithinDays", "sort": "sort",
}


def best_salary(salaries: DataFrame) -> DataFrame:
    """The stated pay of each job with the highest bounds as written."""
    w = Window.partitionBy("job_id").orderBy(F.desc_nulls_last("high"), F.desc_nulls_last("low"), "source_id")
    return salaries.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def _like(c: str, value: str) -> Column:
    return F.contains(F.lower(F.col(c)), F.lit(value.lower()))


def find(
    jobs: DataFrame,
    *,
    records: DataFrame | None = None,
    sources: DataFrame | None = None,
    salaries: DataFrame | None = None,
    employer: str | None = None,
    city: str | None = None,
    province: str | None = None,
    remote: str | None = None,
    employment: str | None = None,
    status: str | None = None,
    posted_after: Column | None = None,
    confirmed_after: Column | None = None,
    owned: bool | None = None,
    source_type: str | None = None,
    least_pay: float | None = None,
) -> DataFrame:
    """Jobs that are not expired and meet every given filter."""
    out = jobs.where("expired_at IS NULL")
    for name, value in (("employer_name", employer), ("city", city)):
        if value:
            out = out.where(_like(name, value))
    for name, value in (("province", province), ("remote_type", remote), ("employment_type", employment), ("status", status)):
        if value:
            out = out.where(F.col(name) == value)
    for name, since in (("first_seen", posted_after), ("last_verified", confirmed_after)):
        if since is not None:
            out = out.where(F.col(name) >= since)
    if owned is not None:
        out = out.join(records.join(sources.where(F.col("owned") == owned), "source_id", "left_semi"), "job_id", "left_semi")
    if source_type is not None:
        out = out.join(records.join(sources.where(F.col("source_type") == source_type), "source_id", "left_semi"), "job_id", "left_semi")
    if least_pay is not None:
        top = F.coalesce("high", "low") * F.coalesce(pay.factor(F.col("period")), F.lit(1.0))
        out = out.join(salaries.where(top >= least_pay), "job_id", "left_semi")
    return out


def with_salary_key(jobs: DataFrame, salaries: DataFrame) -> DataFrame:
    """Jobs with salary_key, the upper bound (else the lower) of their best pay as written."""
    return jobs.join(best_salary(salaries).select("job_id", F.coalesce("high", "low").alias("salary_key")), "job_id", "left")


def order(sort: str) -> list[Column]:
    """Columns of a sort order; rows need salary_key for salary and score for relevance."""
    by = {"newest": "first_seen", "confirmed": "last_verified", "salary": "salary_key", "relevance": "score"}[sort]
    return [F.desc_nulls_last(by), *([F.desc_nulls_last("last_verified")] if sort == "relevance" else [])]


def page(found: DataFrame, *order: Column, number: int = 1, size: int = PAGE) -> DataFrame:
    return found.orderBy(*order, "job_id").offset((number - 1) * size).limit(size)


def parse_filters(rows: DataFrame, column: str = "filters") -> DataFrame:
    """Rows with one typed column a filter, null where it is not set, and valid: whether the JSON text is a filter set.

    An invalid set has null filters; search falls back to defaults, alerts skip it.
    """
    get = lambda n: F.trim(F.try_element_at(F.col("m"), F.lit(FILTERS[n])))
    up_to = lambda n, most: F.when(get(n).rlike(r"^\d{1,9}$") & get(n).try_cast("int").between(1, most), get(n).try_cast("int"))
    typed = {n: F.when(F.length(get(n)) <= most, get(n)) for n, most in (("q", 200), ("employer", 200), ("city", 120))}
    typed["province"] = F.when(F.length(get("province")) == 2, get("province"))
    chosen = (("remote_type", REMOTE), ("employment_type", EMPLOYMENT), ("status", STATUS), ("source_type", SOURCE_TYPES), ("sort", SORTS))
    typed |= {n: F.when(get(n).isin(*values), get(n)) for n, values in chosen}
    typed |= {"salary_min": up_to("salary_min", 999_999_999), "posted_within_days": up_to("posted_within_days", 365), "confirmed_within_days": up_to("confirmed_within_days", 365)}
    bad = F.lit(False)
    for n in FILTERS:
        bad = bad | (get(n).isNotNull() & typed[n].isNull())
    valid = F.coalesce(F.col("m").isNotNull() & ~bad, F.lit(False))
    out = rows.withColumn("m", F.from_json(column, "map<string,string>")).withColumn("valid", valid)
    return out.withColumns({n: F.when(F.col("valid"), F.nullif(typed[n], F.lit("")) if n in ("q", "employer", "city") else typed[n]) for n in FILTERS}).drop("m")


def canonical_query() -> Column:
    """The set filters as ?name=value&..., in one order, the default order left out: equal sets give equal text."""
    parts = [
        F.when(F.col(n).isNotNull() & ~((F.lit(n) == "sort") & (F.col(n).cast("string") == "relevance")), F.concat(F.lit(f"{name}="), F.url_encode(F.col(n).cast("string"))))
        for n, name in FILTERS.items()
    ]
    joined = F.concat_ws("&", *parts)
    return F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise("")


def _grams(c: Column) -> Column:
    """Runs of three characters of a lower-case text; a shorter text is one."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substring(c, i, F.lit(3))))


def matching_cities(needles: DataFrame, cities: DataFrame) -> DataFrame:
    """needle, city where the city contains the needle, in any case. They meet by the needle's first three characters.

    needles: needle; cities: city. Needles of one or two characters meet by runs of that length.
    """
    low = lambda c: F.lower(F.col(c))
    n = needles.where("needle IS NOT NULL").select("needle").distinct().withColumn("key", F.substring(low("needle"), 1, 3))
    short = lambda m: F.transform(F.sequence(F.lit(1), F.greatest(F.length("city") - m + 1, F.lit(1))), lambda i: F.substring(low("city"), i, F.lit(m)))
    c = cities.where("city IS NOT NULL").select("city").distinct().withColumn("key", F.explode(F.array_distinct(F.concat(_grams(low("city")), short(1), short(2)))))
    return n.join(c, "key").where(F.contains(low("city"), low("needle"))).select("needle", "city").distinct()


# --- text index ---------------------------------------------------------------

CLASS_WEIGHT = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
#: Characters of a description that alerts read; the index holds whole descriptions.
DESCRIPTION_CHARACTERS = 20_000
#: Parts of a written index; a query reads those of its own terms.
BUCKETS = 64
#: Files of a part, by hash of the job.
DEALS = 4
DEALT = ("bucket", "deal")
WORD = r"[\p{L}\p{N}]+"


def words(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def terms(docs: DataFrame, fields: dict[str, Column], only: list[str] | None = None) -> DataFrame:
    """Stems of a job's fields, by class A to D: bucket, deal (where write_index puts a row), term, job_id, class, positions (array, ascending).

    Stop words have a place but no row. The places of a class follow the last
    kept word of the class before it, so that a phrase may run on from field to
    field, as it does in one weighted document. only: terms that are wanted;
    all texts are read, but words of other terms are never moved.
    """
    last = lambda k: F.coalesce(F.array_max(F.transform(k, lambda w, i: F.when(stems.is_stop(w), 0).otherwise(i + 1))), F.lit(0)).alias(f"{k}_last")

    # read twice; many files, as many short texts are a single task otherwise
    texts = store.write(spread(docs.select("job_id", *(c.alias(k) for k, c in fields.items()))))
    rows = texts.select("job_id", *(F.coalesce(words(F.col(k)), F.array().cast("array<string>")).alias(k) for k in fields))
    *before, _ = fields
    rows = rows.select("job_id", *fields, *(last(k) for k in before))
    start, placed = F.lit(0), []
    for k in fields:
        placed.append(F.struct(F.lit(k).alias("class"), F.col(k).alias("said"), start.alias("start")))
        start = start + F.col(f"{k}_last")
    runs = rows.select("job_id", F.inline(F.array(*placed)))
    words_of = runs.select("job_id", "class", "start", F.posexplode("said").alias("i", "word")).select("job_id", "class", "word", (F.col("i") + F.col("start")).alias("at"))
    # every different word that is kept is stemmed once, and written, so that Spark knows the size of the vocabulary and sends it to the words where it is small
    every = texts.select(F.explode(F.flatten(F.array(*(F.coalesce(words(F.col(k)), F.array().cast("array<string>")) for k in fields)))).alias("word"))
    vocabulary = stems.stems_of(every.where(~stems.is_stop(F.col("word"))))
    stemmed = words_of.join(store.write(vocabulary if only is None else vocabulary.where(F.col("term").isin(*only))), "word")
    dealt = _dealt(stemmed) if only is None else _keyed(stemmed)
    return dealt.groupBy("bucket", "term", "job_id", "class", "deal").agg(F.sort_array(F.collect_list("at")).alias("positions"))


def bucket(term: Column) -> Column:
    return (F.crc32(term.cast("binary")) % BUCKETS).cast("int")


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"bucket": bucket(F.col("term")), "deal": F.pmod(F.xxhash64("job_id"), F.lit(DEALS)).cast("int")})


def _dealt(rows: DataFrame) -> DataFrame:
    """rows by hash of their term, and of their job, as a very frequent term is several files: what groups or sorts them by term moves none again."""
    return _keyed(rows).repartition(max(BUCKETS * DEALS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *DEALT)


def write_index(found: DataFrame) -> DataFrame:
    """The inverted index of terms, written in BUCKETS parts by hash of the term, rows of a term together; read again lazily."""
    dealt = found if set(DEALT) <= set(found.columns) else _dealt(found)
    placed = dealt.select("bucket", "term", "job_id", "class", "positions", F.size("positions").cast("long").alias("tf"))
    return store.write(placed.sortWithinPartitions("bucket", "term", "job_id"), "bucket")


def of_terms(index: DataFrame, wanted: list[str]) -> DataFrame:
    """Rows of some terms; only their parts of a written index are read."""
    parts = sorted({zlib.crc32(t.encode()) % BUCKETS for t in wanted})
    return index.where(F.col("bucket").isin(*parts) & F.col("term").isin(*wanted))


def query_terms(queries: DataFrame, *keys: str) -> DataFrame:
    """Terms of web-style queries (column q): keys, conj, run, need, neg, i, term.

    Words and "phrases" are runs; - before a run asks that it be absent; `or`
    between runs parts conjunctions, of which one must hold. Stop words keep
    their place within a run but are not asked for; what is left empty goes.
    """
    pattern = F.lit('(-?)(?:"([^"]*)"|(\\S+))')
    part = lambda k: F.regexp_extract_all(F.lower("q"), pattern, F.lit(k))
    items = F.arrays_zip(part(1).alias("sign"), part(2).alias("quoted"), part(3).alias("plain"))
    one = queries.where("q IS NOT NULL").select(*keys, F.posexplode(items).alias("run", "x"))
    either = (F.col("x.plain") == "or") & (F.col("x.sign") == "")
    before = Window.partitionBy(*keys).orderBy("run")  # a query has 200 characters at most
    conj = one.withColumn("conj", F.sum(either.cast("int")).over(before)).where(~either)
    runs = conj.select(*keys, "conj", "run", (F.col("x.sign") == "-").alias("neg"), F.posexplode(words(F.concat("x.quoted", "x.plain"))).alias("i", "word"))
    kept = runs.where(~stems.is_stop(F.col("word")))
    return kept.join(stems.stems_of(kept), "word").withColumn("need", F.count("*").over(Window.partitionBy(*keys, "run"))).select(*keys, "conj", "run", "need", "neg", "i", "term")


def conjunctions(asked: DataFrame, *keys: str) -> DataFrame:
    """keys, conj, wanted: how many runs each conjunction wants; 0 where it only asks that runs be absent."""
    return asked.groupBy(*keys, "conj").agg(F.count_distinct(F.when(~F.col("neg"), F.col("run"))).alias("wanted"))


def whole_runs(met: DataFrame, *keys: str) -> DataFrame:
    """keys, conj, has (wanted runs found), unwanted (how many of the others): of rows with run, need, neg, i and positions."""
    begins = met.select(*keys, "conj", "run", "need", "neg", "i", F.explode("positions").alias("at")).withColumn("at", F.col("at") - F.col("i"))
    whole = begins.groupBy(*keys, "conj", "run", "need", "neg", "at").agg(F.count_distinct("i").alias("n")).where("n = need")
    return whole.groupBy(*keys, "conj").agg(F.count_distinct(F.when(~F.col("neg"), F.col("run"))).alias("has"), F.count_if("neg").alias("unwanted"))


def _one(spark: SparkSession, query: str) -> tuple[DataFrame, list[str], list[int]]:
    """Terms of a single query, the same as a list, and its conjunctions that want nothing."""
    asked = query_terms(spark.createDataFrame([(query,)], "q string"))
    rows = asked.collect()  # at most 200 characters' words
    wanting = {r["conj"] for r in rows if not r["neg"]}
    return spark.createDataFrame(rows, asked.schema), sorted({r["term"] for r in rows}), sorted({r["conj"] for r in rows} - wanting)


def asked_terms(spark: SparkSession, query: str) -> list[str]:
    """Terms that a web-style query names, wanted or not: rows of other terms are not needed to match or rank it."""
    return _one(spark, query)[1]


def match(index: DataFrame, query: str, jobs: DataFrame | None = None) -> DataFrame:
    """job_id of the jobs that a web-style query matches, by the rows of its own terms.

    jobs (job_id) is needed for queries of which one side only asks that words be absent.
    """
    asked, wanted, absent_only = _one(index.sparkSession, query)
    met = of_terms(index, wanted).join(F.broadcast(asked), "term")  # the terms of one query
    runs = whole_runs(met, "job_id")
    need = F.broadcast(conjunctions(asked))
    out = runs.join(need, "conj").where("has = wanted AND wanted > 0 AND unwanted = 0").select("job_id")
    for conj in absent_only:
        if jobs is None:
            raise ValueError(f"{query!r} asks for jobs without some words: hand in all jobs")
        out = out.unionByName(jobs.select("job_id").join(runs.where((F.col("conj") == conj) & (F.col("unwanted") > 0)), "job_id", "left_anti"))
    return out.distinct()


def matching_pairs(pairs: DataFrame, asked: DataFrame, found: DataFrame) -> DataFrame:
    """Of pairs (search_id, job_id), each once, those where the job meets the search's text query."""
    sides = pairs.join(conjunctions(asked, "search_id"), "search_id")
    met = pairs.join(asked, "search_id").join(found.select("job_id", "term", "positions"), ["job_id", "term"])
    runs = whole_runs(met, "search_id", "job_id")
    held = F.coalesce("has", F.lit(0)) == F.col("wanted")
    return sides.join(runs, ["search_id", "job_id", "conj"], "left").where(held & (F.coalesce("unwanted", F.lit(0)) == 0)).select("search_id", "job_id").distinct()


def rarest_terms(asked: DataFrame, found: DataFrame) -> DataFrame:
    """search_id, term: of each conjunction its wanted term that the fewest jobs hold; term is null where it wants none."""
    held = found.join(asked.where("NOT neg").select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count_distinct("job_id").alias("jobs"))
    known = asked.join(held, "term", "left").withColumn("jobs", F.coalesce("jobs", F.lit(0)))
    least = F.min(F.when(~F.col("neg"), F.struct("jobs", "term")))
    return known.groupBy("search_id", "conj").agg(least.alias("least")).select("search_id", F.col("least.term").alias("term")).distinct()


def rank(index: DataFrame, query: str) -> DataFrame:
    """Jobs that the query matches, by the sum of class weight times tf / (tf + 1) of its wanted terms."""
    asked, wanted, _ = _one(index.sparkSession, query)
    terms_wanted = asked.where("NOT neg").select("term").distinct()
    weight = F.lit(0.0)
    for k, v in CLASS_WEIGHT.items():
        weight = F.when(F.col("class") == k, v).otherwise(weight)
    score = F.sum(weight * F.col("tf") / (F.col("tf") + 1)).alias("score")
    rows = of_terms(index, wanted).join(F.broadcast(terms_wanted), "term")  # the terms of one query
    return rows.groupBy("job_id").agg(score).join(match(index, query), "job_id", "left_semi")
