"""Stems, text queries and the written index over literal rows."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from postledger.functions.stems import stems_of
from postledger.operators import accounts, search
from postledger.plans import catalog, search_queries

# Pairs of the public vocabulary of the Porter2 stemmer, word and stem in turn.
KNOWN = """consign consign consigned consign consignment consign consistency consist consolation consol consolatory consolatori consolingly consol
    conspicuously conspicu conspiracy conspiraci conspirators conspir constable constabl constancy constanc knackeries knackeri knavish knavish kneading knead
    knightly knight knitted knit knives knive knocker knocker generates generat generously generous general general communication communic arsenal arsenal
    flies fli dies die tied tie ties tie cries cri happy happi say say enjoy enjoy by by hopping hop hoping hope falling fall agreed agre relational relat
    rational ration vietnamization vietnam hopefulness hope electrical electr formalize formal triplicate triplic adoption adopt controlling control roll roll
    succeed succeed news news dying die skies sky inning inning maintenance mainten nursing nurs vacancies vacanc yellow yellow boyish boyish bed bed
    gas gas this this kiwis kiwi gaps gap yes yes youth youth b2bs b2bs été été is is""".split()

ADS = [
    (1, "Senior Nurse", "first aid, triage", "Halifax", "NS", "We nurse the sick and train nurses. Apply to the ward of mercy."),
    (2, "Plumber", None, "Laval", "QC", "Fix pipes; train apprentices in fixing of taps."),
    (3, "Train driver", "trains", None, "ON", "Drive trains. No nursing."),
    (4, None, None, None, None, None),
]


@pytest.fixture(scope="module")
def index(spark):
    ads = spark.createDataFrame(ADS, "job_id long, title string, skills string, city string, province string, description string")
    fields = {"A": F.col("title"), "B": F.col("skills"), "C": F.concat_ws(" ", "city", "province"), "D": F.col("description")}
    return search.write_index(search.terms(ads, fields))


def test_stems(spark):
    pairs = list(zip(KNOWN[::2], KNOWN[1::2]))
    known = spark.createDataFrame(pairs, "word string, want string")
    assert stems_of(known).join(known, "word").where("NOT term <=> want").collect() == []


def test_classes_places_and_stop_words(index):
    rows = {(r["job_id"], r["class"], r["term"]): r["positions"] for r in index.collect()}
    # places run on from field to field; stop words have one but no row
    assert rows[1, "A", "senior"] == [0] and rows[1, "A", "nurs"] == [1] and rows[1, "B", "first"] == [2] and rows[1, "C", "halifax"] == [5]
    assert rows[1, "D", "nurs"] == [8, 13] and rows[1, "D", "ward"] == [17] and rows[1, "D", "merci"] == [19]
    assert not any(k[2] in ("we", "the", "and") for k in rows) and not any(k[0] == 4 for k in rows)


@pytest.mark.parametrize(
    ("query", "jobs"),
    [
        ("nursing", {1, 3}),
        ("train nurses", {1, 3}),  # words by and, in any order
        ("drive -nurse", set()),
        ("plumber or driver", {2, 3}),
        ("nurse halifax or plumber laval", {1, 2}),  # and binds closer than or
        ('"train nurses"', {1}),
        ('"ward of mercy"', {1}),  # a stop word holds a place
        ('"ward mercy"', set()),
        ('"nurse first"', {1}),  # from the title on into the skills
        ("the of", set()),  # stop words alone ask for nothing
        ("the plumber", {2}),
        ("or plumber or", {2}),
        ('-"fixing of taps" train', {1, 3}),
        ("first-aid", {1}),
        ("", set()),
    ],
)
def test_queries(index, query, jobs):
    assert {r["job_id"] for r in search.match(index, query).collect()} == jobs


def test_queries_for_absence_need_all_jobs(spark, index):
    jobs = spark.createDataFrame([(a[0],) for a in ADS], "job_id long")
    assert {r["job_id"] for r in search.match(index, "-train", jobs).collect()} == {4}
    assert {r["job_id"] for r in search.match(index, "-nurse or driver", jobs).collect()} == {2, 3, 4}
    with pytest.raises(ValueError):
        search.match(index, "-train")


def test_only_parts_of_the_terms_are_read(index):
    plan = search.of_terms(index, ["nurs", "train"])._jdf.queryExecution().toString()
    parts = sorted({r["bucket"] for r in index.where(F.col("term").isin("nurs", "train")).select("bucket").collect()})
    assert f"PartitionFilters: [isnotnull(bucket" in plan.replace("#", " ").replace("  ", " ") or "PartitionFilters: [bucket" in plan
    assert str(parts[0]) in plan.split("PartitionFilters")[1].split("]")[0]


def test_stored_queries_meet_jobs_by_a_wanted_word(spark, index):
    queries = [(1, "nursing"), (2, '"train nurses" or taps'), (3, "-train"), (4, "the"), (5, "train -apprentice"), (6, "absent train"), (7, None)]
    asked = search.query_terms(spark.createDataFrame(queries, "search_id long, q string"), "search_id")
    found = index.groupBy("job_id", "term").agg(F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))
    keys = {(r["search_id"], r["term"]) for r in search.rarest_terms(asked, found).collect()}
    assert keys == {(1, "nurs"), (2, "nurs"), (2, "tap"), (3, None), (5, "train"), (6, "absent")}
    pairs = spark.createDataFrame([(s, j) for s in range(1, 8) for j in range(1, 5)], "search_id long, job_id long")
    got = {(r["search_id"], r["job_id"]) for r in search.matching_pairs(pairs, asked, found).collect()}
    assert got == {(1, 1), (1, 3), (2, 1), (2, 2), (3, 4), (5, 1), (5, 3)}


def test_rank_counts_wanted_terms_by_class(index):
    got = {r["job_id"]: round(r["score"], 6) for r in search.rank(index, "nurse -driver").collect()}
    assert got == {1: round(1.0 * 1 / 2 + 0.1 * 2 / 3, 6)}


def test_words_are_dealt_once(spark):
    ads = spark.createDataFrame(ADS, "job_id long, title string, skills string, city string, province string, description string")
    found = search.terms(ads, {"A": F.col("title"), "D": F.col("description")})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_equal_searches_are_held_against_a_job_once(spark, index, monkeypatch):
    day = "1998-06-{:02d} 00:00:00".format
    rows = [
        (1, "nursing", None, None, day(1)), (2, "nursing", None, None, day(1)), (3, "nursing", None, None, day(9)), (4, None, "hal", None, day(1)), (5, None, "HAL", None, day(1)),
        (6, "-train", None, None, day(1)), (7, "-train or nursing", None, None, day(1)), (8, "-train or nursing", None, None, day(1)), (9, None, None, 50, day(1)), (10, "the", None, None, day(1)),
    ]
    searches = spark.createDataFrame(rows, "search_id long, q string, city string, salary_min int, created_at string").selectExpr(
        "search_id", "q", "city", "salary_min", "CAST(created_at AS timestamp) AS created_at", "CAST(NULL AS timestamp) AS last_notified_at", "true AS valid", "CAST(NULL AS int) AS posted_within_days",
        "CAST(NULL AS int) AS confirmed_within_days", *(f"CAST(NULL AS string) AS {c}" for c in ("employer", "province", "remote_type", "employment_type", "status", "source_type")),
    )
    jobs = spark.createDataFrame([(1, "Halifax", 40, day(5)), (2, "Laval", 60, day(6)), (3, None, 70, day(10)), (4, None, None, day(11))], "job_id long, city string, salary_top int, at string").selectExpr(
        "job_id", "city", "salary_top", "CAST(at AS timestamp) AS first_seen", "CAST(NULL AS timestamp) AS last_verified", "CAST(NULL AS timestamp) AS expired_at", "'Acme' AS employer_name", "'T' AS title",
        "array('x') AS source_types", *(f"CAST(NULL AS string) AS {c}" for c in ("province", "remote_type", "employment_type", "status")),
    )
    asked, held = [], search.matching_pairs
    monkeypatch.setattr(search, "matching_pairs", lambda pairs, *rest: asked.append(pairs) or held(pairs, *rest))
    found = accounts.alerts(searches, jobs, index, F.lit(day(30)).cast("timestamp"), of_job=("title",))
    got = {(r["search_id"], r["job_id"]) for r in found.collect()}
    nurse, no_train = {1, 3}, {4}
    assert got == {(s, j) for s, js in ((1, nurse), (2, nurse), (3, {3}), (4, {1}), (5, {1}), (6, no_train), (7, nurse | no_train), (8, nurse | no_train), (9, {2, 3})) for j in js}
    assert found.count() == len(got) and found.columns == ["search_id", "job_id", "title"]
    assert {r["search_id"] for p in asked for r in p.collect()} == {1, 6, 7}


@pytest.fixture(scope="module")
def long_texts(spark, tmp_path_factory):
    """The small tables, in which long texts end in words that queries ask for."""
    sf, folder = "/root/testdata/sf0.001", tmp_path_factory.mktemp("long")
    for name in os.listdir(sf):
        if name != "documents.parquet":
            os.symlink(f"{sf}/{name}", folder / name)
    end = "or messages urgent starters zebrafish training fees first promo rings"
    known = f"SELECT * REPLACE (CASE WHEN doc_id % 3 = 0 THEN repeat('ordinary text of teams ', 1000) || '{end}' ELSE text END AS text) FROM '{sf}/documents.parquet'"
    duckdb.connect().execute(f"COPY ({known}) TO '{folder / 'documents.parquet'}' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", ["term_index", "search_words", "search_without_words", "search_ranked", "search_by_relevance"])
def test_whole_descriptions_are_searched(spark, long_texts, name):
    """Words past the 20,000th character count, in the query and in its SQL."""
    duck = duckdb.connect()
    for table in os.listdir(long_texts):
        duck.execute(f"CREATE VIEW {table[:-8]} AS SELECT * FROM '{long_texts}/{table}'")
    got = catalog.QUERIES[name](spark, long_texts)
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    rows = order(got.collect())
    assert rows == order(duck.sql(catalog.SQL[name]).project(", ".join(got.columns)).fetchall())
    long = {r["job_id"] for r in search_queries.view(spark, long_texts, "b_advert").where("length(description) > 20000").select("job_id").collect()}
    assert len(long) > 5
    if name == "term_index":
        assert {r["job_id"] for r in got.where("term = 'zebrafish'").collect()} == long
    elif name == "search_by_relevance":
        assert {r["job_id"] for r in got.collect()} & long
    else:
        assert {r["job_id"] for r in got.collect()} >= long


def test_a_search_moves_words_of_its_own_terms_alone(spark, index):
    ads = spark.createDataFrame(ADS, "job_id long, title string, skills string, city string, province string, description string")
    fields = {"A": F.col("title"), "B": F.col("skills"), "C": F.concat_ws(" ", "city", "province"), "D": F.col("description")}
    for query in ("nurse halifax or plumber laval", '"ward of mercy" -absent', "the of"):
        only = search.asked_terms(spark, query)
        part = search.write_index(search.terms(ads, fields, only))
        row = lambda r: (r["bucket"], r["term"], r["job_id"], r["class"], r["positions"], r["tf"])
        assert sorted(map(row, part.collect())) == sorted(map(row, index.where(F.col("term").isin(*only)).collect()))


def test_searches_write_no_whole_index(spark, monkeypatch):
    written, write = [], search.write_index
    monkeypatch.setattr(search, "write_index", lambda found: written.append(write(found)) or written[-1])
    for name in ("search_words", "search_without_words", "search_ranked", "search_by_relevance"):
        catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    got = [{r["term"] for r in w.select("term").distinct().collect()} for w in written]
    assert got[0] <= {"messag", "urgent", "train", "fee", "first", "widget", "good", "team", "medium"} and got[1] <= {"team", "starter"}
    assert got[2] == got[3] <= {"promo", "ring", "urgent", "telegram"}


def test_searches_of_a_set_may_go_in_several_rows(spark, index, monkeypatch):
    monkeypatch.setattr(accounts, "SHARING", 1)
    test_equal_searches_are_held_against_a_job_once(spark, index, monkeypatch)
