"""Retention, erasure, saved jobs, alerts, review queues and health metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postledger.operators import search
from postledger.sources import store


def purge_expired(checks: DataFrame, reports: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Checks that are not expired, and reports whose check stays."""
    kept = checks.where(F.col("expires_at") >= now)
    return kept, reports.join(checks.where(F.col("expires_at") < now), "check_id", "left_anti")


def erase(rows: DataFrame, erased: DataFrame, cascade: bool) -> DataFrame:
    """Rows of erased users go, or only lose their user."""
    if cascade:
        return rows.join(erased, "user_id", "left_anti")
    gone = erased.select(F.col("user_id").alias("__gone")).distinct()
    return rows.join(gone, rows.user_id == F.col("__gone"), "left").withColumn("user_id", F.when(F.col("__gone").isNull(), F.col("user_id"))).drop("__gone")


def saved_state(toggles: DataFrame) -> DataFrame:
    """A job is saved after an odd number of toggles."""
    return toggles.groupBy("user_id", "job_id").agg((F.count("*") % 2 == 1).alias("saved"))


def run_summary(outcomes: DataFrame) -> DataFrame:
    """Counts by source and whether its run succeeded, in part or not at all."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    out = outcomes.groupBy("source_id").agg(
        F.count("*").alias("fetched"), n("UPSERTED").alias("upserted"), n("SKIPPED").alias("skipped"), n("ERRORED").alias("errored")
    )
    kind = F.when(F.col("errored") == 0, "SUCCEEDED").when(F.col("upserted") + F.col("skipped") > 0, "PARTIAL").otherwise("FAILED")
    return out.withColumn("status", kind)


def daily_events(events: DataFrame) -> DataFrame:
    return events.groupBy(F.to_date("ts").alias("day"), "name").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


#: Filters that decide which jobs a saved search meets.
FILTERED = tuple(n for n in search.FILTERS if n != "sort")
#: Searches that go through the join as one row.
SHARING = 256
#: Their columns, as a pair of a set and a job reads them.
_HELD = ("since", "province", "remote_type", "employment_type", "status", "source_type", "salary_min", "low_employer", "low_city", "posted_from", "confirmed_from")


def _since(searches: DataFrame) -> DataFrame:
    return searches.where("valid").withColumn("since", F.coalesce("last_notified_at", "created_at"))


def fresh_jobs(searches: DataFrame, jobs: DataFrame) -> DataFrame:
    """Open jobs since the first notice that a valid search waits for, written: terms are needed of these alone."""
    first = _since(searches).agg(F.min("since").alias("first"))  # one row
    return store.write(jobs.where("expired_at IS NULL").join(F.broadcast(first), F.col("first_seen") >= F.col("first"), "left_semi"))


def filter_sets(searches: DataFrame) -> DataFrame:
    """Valid searches, written, with set_id: the smallest search_id of those with equal filters and an equal last notice."""
    alike = F.to_json(F.struct(F.unix_micros("since").alias("since"), *FILTERED))
    open_ = store.write(_since(searches).withColumn("__alike", alike))
    first = open_.groupBy("__alike").agg(F.min("search_id").alias("set_id"))
    return store.write(open_.join(first, "__alike").drop("__alike"))


def _together(members: DataFrame, carried: tuple[str, ...]) -> DataFrame:
    """set_id, members (array of search_id and carried columns): the searches of a set, SHARING a row at most or so, as a set may have very many."""
    many = members.groupBy("set_id").agg(F.ceil(F.count("*") / SHARING).alias("rows"))
    part = F.pmod(F.xxhash64("search_id"), F.col("rows")).alias("part")
    dealt = members.join(many, "set_id").select("set_id", part, F.struct("search_id", *carried).alias("member"))
    return dealt.groupBy("set_id", "part").agg(F.collect_list("member").alias("members")).drop("part")


def _placed_sets(sets: DataFrame, fresh: DataFrame, now: Column) -> DataFrame:
    """members, q_id, what its filters ask, key: by which a set meets jobs, one for each day since its last notice."""
    days = F.sequence(F.to_date("since"), F.greatest(F.to_date(now), F.to_date("since")))
    key = lambda kind, c: F.concat(F.lit(kind), c)
    places = search.matching_cities(sets.select(F.col("city").alias("needle")), fresh)
    by_city = sets.where("city IS NOT NULL").join(places.select(F.col("needle").alias("city"), F.col("city").alias("place")), "city").withColumn("kind", key("c", F.col("place")))
    other = F.coalesce(key("p", F.col("province")), key("r", F.col("remote_type")), F.lit("d"))
    by_other = sets.where("city IS NULL").withColumns({"kind": other, "place": F.lit(None).cast("string")})
    back = lambda n: F.when(F.col(n).isNotNull(), now - F.make_dt_interval(F.col(n)))
    asks = {"low_employer": F.lower("employer"), "low_city": F.lower("city"), "posted_from": back("posted_within_days"), "confirmed_from": back("confirmed_within_days")}
    placed = by_city.unionByName(by_other).withColumns(asks)
    return placed.select("members", "q_id", *_HELD, F.explode(F.transform(days, lambda d: F.concat_ws("|", "kind", d.cast("string")))).alias("key"))


def _placed_jobs(fresh: DataFrame, now: Column, carried: tuple[str, ...]) -> DataFrame:
    """Fresh jobs by city, province, arrangement and day: key, what filters ask of a job, job (the columns to carry)."""
    day = F.least(F.to_date("first_seen"), F.to_date(now)).cast("string")
    key = lambda kind, c: F.concat_ws("|", F.concat(F.lit(kind), c), day)
    own = F.array(*(F.when(F.col(c).isNotNull(), key(k, F.col(c))) for k, c in (("c", "city"), ("p", "province"), ("r", "remote_type"))), key("d", F.lit("")))
    read = ("first_seen", "last_verified", "province", "remote_type", "employment_type", "status", "source_types", "salary_top")
    job = [F.struct(*carried).alias("job")] if carried else []
    return fresh.select("job_id", *read, F.lower("employer_name").alias("low_employer"), F.lower("city").alias("low_city"), *job, F.explode(F.array_compact(own)).alias("key"))


def _meet(sets: DataFrame, jobs: DataFrame, *keys: str) -> DataFrame:
    """members, q_id, job_id, job: pairs of equal keys in which the job meets the set's filters, held within the join."""
    free = lambda n, test: F.col(f"s.{n}").isNull() | test
    equal = lambda n: free(n, F.col(f"s.{n}") == F.col(f"j.{n}"))
    within = lambda n, at: free(n, F.col(f"j.{at}") >= F.col(f"s.{n}"))
    holds = (
        (F.col("j.first_seen") >= F.col("s.since"))
        & equal("province") & equal("remote_type") & equal("employment_type") & equal("status")
        & within("posted_from", "first_seen") & within("confirmed_from", "last_verified") & within("salary_min", "salary_top")
        & free("low_employer", F.contains("j.low_employer", "s.low_employer")) & free("low_city", F.contains("j.low_city", "s.low_city"))
        & free("source_type", F.array_contains("j.source_types", F.col("s.source_type")))
    )
    for k in keys:
        holds = (F.col(f"s.{k}") == F.col(f"j.{k}")) & holds
    return sets.alias("s").join(jobs.alias("j"), holds).select("s.members", "s.q_id", "j.job_id", *(["j.job"] if "job" in jobs.columns else []))


def alerts(searches: DataFrame, jobs: DataFrame, found: DataFrame, now: Column, of_search: tuple[str, ...] = (), of_job: tuple[str, ...] = ()) -> DataFrame:
    """search_id, job_id, columns of either side: the new jobs of each valid saved search; a filter that is not set holds for every job.

    searches: search_id (each once), valid, last_notified_at, created_at and the columns
    of search.parse_filters; jobs: job_id, first_seen, last_verified,
    expired_at, employer_name, city, province, remote_type, employment_type,
    status, source_types (array) and salary_top (annual); found: terms of
    (at least) the fresh jobs (search.terms).

    Searches with equal filters are one set, and equal text queries one query,
    until the result: each is held against a job once. A query meets jobs by
    the rarest wanted term of each of its conjunctions. Sets meet jobs, of
    their query where it wants a term, by the cities that contain their own,
    else province, else arrangement, and by day, so that only jobs since the
    last notice meet a set; whole filters are held within that join.
    """
    # what several steps below read is written once
    members = filter_sets(searches)
    sets = store.write(members.where("search_id = set_id").join(_together(members, of_search), "set_id"))
    fresh = fresh_jobs(searches, jobs)
    places = F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions")
    found = store.write(found.join(fresh.select("job_id"), "job_id", "left_semi").groupBy("job_id", "term").agg(places))
    queries = store.write(sets.where("q IS NOT NULL").groupBy("q").agg(F.min("set_id").alias("search_id"), F.min("since").alias("since")))
    asked = store.write(search.query_terms(queries, "search_id"))
    rare = store.write(search.rarest_terms(asked, found))
    by_word = rare.where("term IS NOT NULL").join(queries.select("search_id", "since"), "search_id")
    dated = found.select("job_id", "term").join(fresh.select("job_id", "first_seen"), "job_id")
    wanted = store.write(dated.join(by_word, "term").where("first_seen >= since").select("search_id", "job_id").distinct())
    held = store.write(search.matching_pairs(wanted, asked, found).select(F.col("search_id").alias("q_id"), "job_id"))

    known = sets.join(queries.select("q", F.col("search_id").alias("q_id")), "q", "left")
    of_kind = lambda term: rare.where(term).select(F.col("search_id").alias("q_id")).distinct()
    keyed = lambda rows: _placed_sets(rows, fresh, now)
    of_jobs = _placed_jobs(fresh, now, of_job)
    free = _meet(keyed(known.where("q IS NULL")), of_jobs, "key")
    worded = _meet(keyed(known.join(of_kind("term IS NOT NULL"), "q_id", "left_semi")), of_jobs.join(held, "job_id"), "key", "q_id")
    # queries of which a side wants no word: jobs that meet the filters are held against them
    absent = store.write(_meet(keyed(known.join(of_kind("term IS NULL"), "q_id", "left_semi")), of_jobs, "key"))
    others = store.write(absent.select("q_id", "job_id").distinct().join(held, ["q_id", "job_id"], "left_anti").withColumnRenamed("q_id", "search_id"))
    without = absent.join(search.matching_pairs(others, asked, found).withColumnRenamed("search_id", "q_id"), ["q_id", "job_id"], "left_semi")
    met = free.unionByName(worded).unionByName(without).drop("q_id")
    # each pair becomes its searches where it was found: pairs are not moved once more
    return met.select(F.inline("members"), *met.drop("members").columns).select("search_id", "job_id", *of_search, *(f"job.{c}" for c in of_job))


def notifications(searches: DataFrame, found: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """A notice for each new match, and the searches with their last notice moved on where they were valid.

    searches: those of alerts; found: what alerts returns with user_id and name
    of the search, and title, employer_name and city of the job.
    """
    # the wording of notices is a fixed value
    made = found.select(
        "user_id", "search_id", "job_id",
        F.concat(F.lit("New match for “"), "name", F.lit("”")).alias("title"),
        F.concat("title", F.lit(" at "), "employer_name", F.coalesce(F.concat(F.lit(" · "), "city"), F.lit(""))).alias("body"),
        F.concat(F.lit("/jobs/"), F.col("job_id").cast("string")).alias("link"),
    )
    return made, advance(searches, now)


def advance(searches: DataFrame, now: Column) -> DataFrame:
    """Searches with their last notice moved on where they were valid, whether or not a job met them."""
    return searches.withColumn("last_notified_at", F.when(F.col("valid"), now).otherwise(F.col("last_notified_at")))


def health(jobs: DataFrame, records: DataFrame, salaries: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """One row of pipeline health: jobs, share confirmed in 72 hours, share of records merged into another's job, share with stated pay, share of fetched postings in error."""
    recent = F.col("last_verified") >= now - F.expr("INTERVAL 72 HOURS")
    paid = jobs.join(salaries.select("job_id").distinct().withColumn("paid", F.lit(1)), "job_id", "left")
    j = paid.agg(F.count("*").alias("jobs"), F.avg(F.coalesce(recent, F.lit(False)).cast("int")).alias("confirmed_rate"), F.avg(F.coalesce("paid", F.lit(0))).alias("pay_rate"))
    r = records.groupBy("job_id").agg(F.count("*").alias("n")).agg((F.sum(F.col("n") - 1) / F.sum("n")).alias("dedup_rate"))
    e = outcomes.agg(F.avg((F.col("outcome") == "ERRORED").cast("int")).alias("error_rate"))
    one = lambda df: df.withColumn("k", F.lit(1))  # noqa: E731  each side is one row
    return one(j).join(one(r), "k").join(one(e), "k").drop("k")


def merged_jobs(records: DataFrame) -> DataFrame:
    """Jobs with more than one source record, and how many."""
    return records.groupBy("job_id").agg(F.count("*").alias("records")).where("records > 1")


def dead_letters(errors: DataFrame) -> DataFrame:
    """Open dead letters by source."""
    return errors.groupBy("source_id").agg(F.count_if(F.col("dead_lettered_at").isNotNull() & F.col("resolved_at").isNull()).alias("open"))


def unread(notices: DataFrame) -> DataFrame:
    """Unread notices by user."""
    return notices.groupBy("user_id").agg(F.count_if(F.col("read_at").isNull()).alias("unread"))


def saved_page(saved: DataFrame, jobs: DataFrame, salaries: DataFrame, rollup: DataFrame) -> DataFrame:
    """Saved jobs of every user with employer, best pay and active sources."""
    best = search.best_salary(salaries).select("job_id", "low", "high")
    return (
        saved.where("saved").select("user_id", "job_id").join(jobs.select("job_id", "employer_name", "city"), "job_id")
        .join(best, "job_id", "left").join(rollup.select("job_id", "active_sources"), "job_id", "left")
    )


def saved_flag(found: DataFrame, saved: DataFrame) -> DataFrame:
    """Result rows (user_id, job_id) with whether that user has saved them."""
    mine = saved.where("saved").select("user_id", "job_id", F.lit(True).alias("mine"))
    return found.join(mine, ["user_id", "job_id"], "left").withColumn("saved", F.col("mine").isNotNull()).drop("mine")


def recent(rows: DataFrame, at: str, n: int, *ties: str) -> DataFrame:
    """The latest rows."""
    return rows.orderBy(F.desc_nulls_last(at), *ties).limit(n)


def touched(*parts: DataFrame) -> DataFrame:
    """Jobs that any part names, each once."""
    out = parts[0].select("job_id")
    for p in parts[1:]:
        out = out.unionByName(p.select("job_id"))
    return out.distinct()


def review_queue(members: DataFrame) -> DataFrame:
    """Members of open clusters, a row each, with their place: owned ones first, then by job."""
    order = Window.partitionBy("cluster_id").orderBy(F.desc("owned"), "job_id")
    return members.distinct().withColumn("place", F.row_number().over(order))
