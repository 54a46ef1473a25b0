"""Literal cases: pasted fields, robots rules, guards, readable forms, streams, connectors."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from postledger.functions import pasted
from postledger.operators import checks, decisions, dedup, identity, intake, reports, robots
from postledger.plans import binding
from postledger.sources import registry
from postledger.streaming import jobs as streams


def now():
    return F.lit("2024-01-31 00:00:00").cast("timestamp")


def test_pasted(spark):
    rows = [
        ("Role: Welder\nBased in: Laval\nsee https://a.ca/x, or https://b.ca/y) application", None),
        ("  Night cook  \nno labels", " Diner "),
        ("", None),
        (None, None),
    ]
    t = F.col("t")
    df = spark.createDataFrame(rows, "t string, h string").select(pasted.title(t), pasted.employer(t, F.col("h")), pasted.place(t), pasted.apply_url(t))
    assert [tuple(r) for r in df.collect()] == [
        ("Welder", None, "Laval", "https://b.ca/y"),
        ("Night cook", "Diner", None, None),
        (None, None, None, None),
        (None, None, None, None),
    ]


def test_robots(spark):
    body = "User-agent: a\nUser-agent: postbot\nDisallow: /x # no\nAllow: /x/ok$\n\nUser-agent: *\nDisallow: /\nUser-agent: postbot\nDisallow: /late"
    told = robots.rules(spark.createDataFrame([("h", body)], "host string, body string"), "PostBot/2.0")
    assert {(r.pattern, r.allow) for r in told.collect()} == {("/x", False), ("/x/ok$", True)}
    links = spark.createDataFrame([(1, "h", "/x/1"), (2, "h", "/x/ok"), (3, "h", "/x/okay"), (4, "h", "/y"), (5, "k", None)], "link_id int, host string, path string")
    assert {r.link_id: r.allowed for r in robots.allowed(links, told).collect()} == {1: False, 2: True, 3: False, 4: True, 5: True}


def test_display(spark):
    rows = [(50000.0, 60000.0, "YEAR"), (None, 21.5, "HOUR"), (30.0, 30.0, None), (None, None, "YEAR")]
    df = spark.createDataFrame(rows, "a double, b double, p string").select(reports.pay_text(F.col("a"), F.col("b"), F.col("p")))
    assert [r[0] for r in df.collect()] == ["$50,000–$60,000 / year", "$21.50 / hour", "$30", "Salary not disclosed"]
    times = spark.createDataFrame([(dt.datetime(2024, 1, 30, 12),), (dt.datetime(2024, 1, 29, 12),), (dt.datetime(2024, 1, 1),), (None,)], "t timestamp")
    got = times.select(reports.days_ago(F.col("t"), now()), reports.may_be_closed(F.col("t"), now())).collect()
    assert [tuple(r) for r in got] == [("today", False), ("1 day ago", False), ("30 days ago", True), (None, False)]


def test_outcome_and_store(spark):
    c = spark.createDataFrame([(1, None, None, None), (2, None, "u", True), (3, None, "u", False), (4, "hi", "u", True), (5, None, "v", False)], "check_id int, text string, url string, disallowed boolean")
    pages = spark.createDataFrame([("u", "<p>page</p>")], "url string, html string")
    got = {r.check_id: (r.outcome, r.input_text) for r in checks.outcome(c, pages).collect()}
    assert got == {1: ("EMPTY", ""), 2: ("BLOCKED", ""), 3: ("CHECKED", "page"), 4: ("CHECKED", "hi"), 5: ("UNREADABLE", "")}
    key = F.lit("0123456789abcdef")
    kept = checks.stored(c.where("check_id = 4"), key, now())
    row = kept.select("text", F.aes_decrypt(F.unbase64("text"), key, F.lit("GCM")).cast("string").alias("plain"), "expires_at").first()
    assert row.text != "hi" and row.plain == "hi" and row.expires_at == dt.datetime(2024, 3, 1)


def test_domains_and_alias(spark):
    cur = spark.createDataFrame([(1, "a.ca", "PRIMARY")], "employer_id int, domain string, kind string")
    hint = spark.createDataFrame([(1, "a.ca", "PRIMARY"), (1, "b.ca", "CAREERS"), (1, "b.ca", "CAREERS")], cur.schema)
    assert identity.attach_domains(cur, hint).count() == 2
    p = spark.createDataFrame([(1, "Foo Ltd.", True, "Bar Inc"), (2, "Foo Ltd.", False, "Bar Inc")], "id int, employer_name string, employer_owned boolean, hint_name string")
    keyed = identity.posting_employer(p)
    al = spark.createDataFrame([("foo", 9), ("foo", 7)], "alias_normalized string, employer_id int")
    assert {r.id: (r.alias_normalized, r.employer_id) for r in identity.by_alias(keyed, al).collect()} == {1: ("bar", None), 2: ("foo", 7)}


def test_connectors(spark):
    with pytest.raises(ValueError):
        registry.register("board", lambda *a: None)
    s = spark.createDataFrame([("b:x",), ("b:y",), ("c:z",)], "key string")
    assert [r.key for r in registry.enabled(s, s.where("key <> 'b:y'"), "b:").collect()] == ["b:x"]


def _files(path, name, rows):
    path.mkdir(exist_ok=True)
    (path / name).write_text("\n".join(json.dumps(r) for r in rows))


@pytest.fixture
def keyed_state(spark):
    for k, v in streams.STATE_STORE.items():
        spark.conf.set(k, v)
    yield
    for k in streams.STATE_STORE:
        spark.conf.unset(k)


def test_streams(spark, tmp_path, keyed_state):
    land, seen = tmp_path / "land", []
    schema = "source_id int, external_ref string, observation string, at timestamp"
    row = lambda ref, kind, day: {"source_id": 1, "external_ref": ref, "observation": kind, "at": f"2024-01-{day:02}T00:00:00Z"}
    stream = lambda: streams.liveness_state(spark.readStream.schema(schema).json(str(land)))

    def run():
        streams.ingest(stream(), str(tmp_path / "ckpt"), lambda df, _: seen.extend(df.collect())).awaitTermination()

    _files(land, "1.json", [row("a", "LIVE", 1), row("a", "GONE", 2), row("b", "UNKNOWN", 1)])
    run()
    assert [(r.external_ref, r.last_verified.day, r.expired_at.day) for r in seen] == [("a", 1, 2)]
    _files(land, "2.json", [row("a", "GONE", 5), row("b", "LIVE", 6)])
    run()
    assert sorted((r.external_ref, r.last_verified.day, r.expired_at and r.expired_at.day) for r in seen[1:]) == [("a", 1, 5), ("b", 6, None)]
    # started again from the checkpoint; what stays silent for thirty days expires then, once
    seen.clear()
    _files(land, "3.json", [{"source_id": 1, "external_ref": "c", "observation": "LIVE", "at": "2024-03-20T00:00:00Z"}])
    run()
    assert sorted((r.external_ref, str(r.expired_at)[:10]) for r in seen) == [("b", "2024-02-05"), ("c", "None")]
    seen.clear()
    _files(land, "4.json", [{"source_id": 1, "external_ref": "b", "observation": "LIVE", "at": "2024-03-21T00:00:00Z"}])
    run()
    assert [(r.external_ref, r.last_verified.day, r.expired_at) for r in seen] == [("b", 21, None)]


def test_stream_landing(spark, tmp_path):
    land, got = tmp_path / "land", []
    row = lambda p, h: {"source_id": 1, "external_ref": "r", "payload": p, "fetched_at": f"2024-01-01T{h:02}:00:00Z"}
    _files(land, "1.json", [row("x", 1), row("x", 2), row("y", 3)])
    df = spark.readStream.schema("source_id int, external_ref string, payload string, fetched_at timestamp").json(str(land))
    streams.ingest(streams.landing_dedup(df), str(tmp_path / "c"), lambda b, _: got.extend(b.collect())).awaitTermination()
    assert sorted(r.payload for r in got) == ["x", "y"]


def test_stream_daily_counts(spark, tmp_path):
    land, got = tmp_path / "land", []
    row = lambda name, day, h: {"name": name, "ts": f"2024-01-{day:02}T{h:02}:00:00Z"}
    stream = lambda: streams.event_daily(spark.readStream.schema("name string, ts timestamp").json(str(land)))

    def run():
        streams.ingest(stream(), str(tmp_path / "c"), lambda b, _: got.extend(b.collect())).awaitTermination()

    _files(land, "1.json", [row("view", 1, 1), row("view", 1, 23), row("click", 1, 2), row("view", 2, 1)])
    run()
    _files(land, "2.json", [row("view", 5, 1)])  # the watermark passes the first days
    run()
    _files(land, "3.json", [row("view", 1, 5), row("view", 5, 2)])  # too late, and in time
    run()
    assert {(r.day.day, r.name, r.n) for r in got} == {(1, "view", 2), (1, "click", 1), (2, "view", 1)}


def test_chains_and_circles_of_merges(spark):
    moves = {1: 2, 2: 3, 3: 4, 10: 11, 11: 12, 12: 10, 13: 12, 14: 13, 20: 21, 21: 20, 30: 30, **{k: k + 1 for k in range(100, 137)}}
    df = spark.createDataFrame(list(moves.items()), "job_id long, to long")
    got = {r["job_id"]: r["to"] for r in decisions.final_moves(df).collect()}
    assert got == {1: 4, 2: 4, 3: 4, 11: 10, 12: 10, 13: 10, 14: 10, 21: 20, **{k: 137 for k in range(100, 137)}}
    assert decisions.final_moves(df.limit(0)).count() == 0


def test_records_follow_a_chain_of_merges(spark):
    clusters = spark.createDataFrame([("x", "REVIEW_REQUIRED"), ("y", "REVIEW_REQUIRED"), ("z", "RESOLVED")], "cluster_id string, status string")
    records = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "job_id long, cluster_id string")
    now = F.lit("2026-01-01").cast("timestamp")
    made = spark.createDataFrame(
        [(1, "x", "MERGE", 1, 2, "2026-01-01"), (2, "y", "MERGE", 2, 3, "2026-01-02"), (3, "z", "MERGE", 3, 4, "2026-01-02")],
        "decision_id long, cluster_id string, action string, drop_job_id long, keep_job_id long, decided_at string",
    )
    after, moved, lost = decisions.resolve_clusters(clusters, records, made, now)
    assert {r["job_id"] for r in moved.collect()} == {3} and {r["job_id"] for r in lost.collect()} == {1, 2}


def test_both_sides_of_a_cluster_are_stamped(spark):
    made = spark.createDataFrame([(1, 2, 0.95, "MERGE"), (3, 2, 0.7, "REVIEW"), (4, None, 0.0, "NEW")], "posting_id long, candidate_id long, score double, decision string")
    records = spark.createDataFrame([(1, None), (2, None), (3, "old"), (4, "old")], "posting_id long, cluster_id string")
    got = {r["posting_id"]: r["cluster_id"] for r in dedup.stamp(records, dedup.cluster_members(made)).collect()}
    assert got == {1: "2-1", 2: "2-1", 3: "2-3", 4: "old"}


def test_a_check_takes_the_larger_of_both_scores(spark):
    side = "employer_id long, title_stem string, title_normalized string, city string, lo double, hi double, currency string"
    text_ = "the baker bakes bread and cakes for the whole town every day of the week but monday"
    more = lambda df, t: dedup.prepare(
        df.select(
            F.col(df.columns[0]).alias("posting_id"), "employer_id", "title_stem", "title_normalized", F.lit(t).alias("description"), "city", F.lit(None).cast("string").alias("province"),
            F.lit("UNKNOWN").alias("remote_type"), "lo", "hi", "currency", F.array().cast("array<string>").alias("skills"), F.array().cast("array<string>").alias("urls"),
        )
    ).select(F.col("posting_id").alias(df.columns[0]), "province", "remote_type", "title", "shingles", "skills", "links")
    checks_ = spark.createDataFrame([(1, 7, "baker", "baker", "Laval", None, None, None)], f"check_id long, {side}")
    jobs = spark.createDataFrame([(5, 7, "baker", "head baker", "Laval", None, None, None, None)], f"job_id long, {side}, expired_at timestamp")
    plain = checks.match(checks_, jobs).collect()[0]
    both = checks.match(checks_.join(more(checks_, text_), "check_id"), jobs.join(more(jobs, text_), "job_id"), scorer=dedup.lexical).collect()[0]
    assert plain["score"] == 0 and not plain["is_strong"]  # other titles score 0
    assert both["score"] > 0.6  # the texts are the same


def test_errors_become_dead_letters(spark):
    failed = spark.createDataFrame([(1, "a", "timeout", False, 0), (1, "b", "timeout", False, 3), (1, "c", "bad", True, 0)], "source_id long, external_ref string, reason string, permanent boolean, retry_count int")
    got = {r["payload_ref"]: r["dead_lettered_at"] is not None for r in intake.errors(failed, "FETCH", now()).collect()}
    assert got == {"a": False, "b": True, "c": True}


@pytest.mark.parametrize(
    ("board", "careers", "html", "linked"),
    [
        ("greenhouse", "https://www.firm.com/careers", "<a href='https://boards.greenhouse.io/firm'>", True),
        ("greenhouse", "https://jobs.firm.com/", "greenhouse.io/embed/job_board/js?for=firm\"", True),
        ("greenhouse", "https://firm.com/c", "<a href='https://boards.greenhouse.io/firmware'>", False),
        ("greenhouse", "https://firm.com/c", "<a href='https://notgreenhouse.io/firm'>", False),
        ("lever", "https://firm.com/c", "https://api.lever.co/v0/postings/firm?mode=json", True),
        ("lever", "https://firm.com/c", "https://boards.greenhouse.io/firm", False),
        ("lever", "https://elsewhere.com/c", "https://jobs.lever.co/firm", None),
        ("lever", None, "https://jobs.lever.co/firm", None),
        ("lever", "https://firm.com/c", None, None),
    ],
)
def test_board_links(spark, board, careers, html, linked):
    employers = spark.createDataFrame([(1, "firm.com", careers, board, "firm")], "employer_id long, domain string, careers_url string, board string, board_token string")
    pages = spark.createDataFrame([(careers or "https://firm.com/c", html)], "url string, html string")
    assert intake.board_probe(employers, pages).collect()[0]["linked"] is linked


def test_cosines_by_tiles_are_those_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(dedup, "TILE", 7)
    monkeypatch.setattr(dedup, "STRIP", 3)
    rows = [(i, i % 2, [float(i * k % 11 - 5) for k in range(1, 5)]) for i in range(60)]
    rows += [(100, 0, None), (101, 0, [0.0] * 4), (102, 0, [1.0, 2.0]), (103, 0, [2.0, 4.0]), (104, 0, [1.0, None, 2.0, 3.0]), (105, 0, []), (106, None, [1.0] * 4), (107, 0, [float("nan")] * 4)]
    for kind in ("float", "double"):
        table = spark.createDataFrame(rows, f"posting_id long, block int, vector array<{kind}>")
        pairs = lambda df: sorted(map(repr, df.collect()))
        want = pairs(dedup.block_pairs(dedup.measured(table), dedup.cosine, 0.25))
        assert pairs(dedup.cosine_pairs(table, 0.25)) == want and len(want) > 200
    assert dedup.cosine_pairs(table.limit(0), 0.25).count() == 0


def _ends(moves):
    """Where each job ends, one step after another; of a circle the smallest job."""
    out = {}
    for j in moves:
        path, here = [j], moves[j]
        while here in moves and here not in path:
            path.append(here)
            here = moves[here]
        end = min(path[path.index(here) :]) if here in path else here
        if end != j:
            out[j] = end
    return out


def test_rounds_follow_the_longest_way(spark, monkeypatch):
    """circles of two among many moves take a few rounds, not as many as the moves have bits; any ways end right."""
    written = []
    write = decisions.store.write
    monkeypatch.setattr(decisions.store, "write", lambda *a, **b: written.append(1) or write(*a, **b))
    moves = {k + a: k + b for k in range(0, 600, 10) for a, b in ((1, 2), (2, 3), (3, 4), (6, 7), (7, 6), (8, 7))}
    got = decisions.final_moves(spark.createDataFrame(list(moves.items()), "job_id long, to long"))
    assert {r["job_id"]: r["to"] for r in got.collect()} == _ends(moves) and len(written) <= 6
    rng = np.random.default_rng(5)
    moves = {i: int(rng.integers(0, 60)) for i in range(50)}  # tails of any length into circles, and open ends
    moves |= {100 + i: 101 + i for i in range(40)} | {140: 120, 90: 91, 91: 92, 92: 93, 93: 99, 99: 95, 95: 97, 97: 99}
    moves = {k: v for k, v in moves.items() if k != v}
    got = decisions.final_moves(spark.createDataFrame(list(moves.items()), "job_id long, to long"))
    assert {r["job_id"]: r["to"] for r in got.collect()} == _ends(moves)


def test_postings_are_cut_into_words_once(spark):
    """scored_pairs reads its postings four times and computes them once."""
    n = spark.sparkContext.accumulator(0)

    def runs(i):
        n.add(1)
        return [i % 2, 7]

    rows = [(i, "Toronto", "ON", "REMOTE", 1.0, 2.0, "CAD", "b", ["dev"], None, ["u"]) for i in range(6)]
    df = spark.createDataFrame(rows, "posting_id long, city string, province string, remote_type string, lo double, hi double, currency string, block string, title array<string>, skills array<string>, links array<string>")
    found = dedup.scored_pairs(df.withColumn("shingles", F.udf(runs, "array<bigint>")("posting_id"))).collect()
    assert len(found) == 15 and n.value == 6


def test_larger_tables_are_more_tasks(spark, monkeypatch):
    """what a task of touched_jobs sorts does not grow with the table."""
    monkeypatch.setattr(binding, "TASK_ROWS", 100)
    found = binding.dealt(spark.range(1501), "id")
    sizes = found.groupBy(F.spark_partition_id()).count().collect()
    assert found.rdd.getNumPartitions() == 16 and max(r["count"] for r in sizes) < 200
