"""The trie against a plain one, and odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict
from functools import partial

import pytest
from pyspark.sql import functions as F

from postledger.llm import prefix_trie
from postledger.llm.prefix_trie import ends_digest, rebuilt_paths, turn_mark
from postledger.llm.prefix_trie import prefix_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string"


def _key(row):
    by, said = row[2] or "", row[3] or ""
    digest = hashlib.sha256(f"{len(by.encode())}:{by}{said}".encode()).hexdigest()[:32]
    return (row[1] is not None, row[1] or 0, digest, len(said.encode()))


def _brute(rows):
    own = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            own[r[0]].append(r)
    own = {c: [(r[2] or "", r[3] or "") for r in sorted(x, key=_key)] for c, x in own.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        path = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
        ends[path].append(c)
    out = []
    for path, at in members.items():
        under = [p for p in members if p[: len(path)] == path]
        kids = lambda p: [q for q in members if len(q) == len(p) + 1 and q[: len(p)] == p]
        out.append(
            (
                min(at),
                len(path),
                min(members[path[:-1]]) if path else None,
                len(at),
                len(kids(path)),
                sum(not kids(p) for p in under),
                sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in under if p),
                hashlib.sha256(",".join(map(str, ends[path])).encode()).hexdigest(),
            )
        )
    return sorted(out, key=repr)


def _got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def _many():
    rng = random.Random(3)
    said = ["", "ja", "né", "no " * 30, None, "x"]
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(said)) for c in range(70) for t in range(rng.randint(1, 6))]
    rows += [(c, t, "user", "same") for c in range(100, 160) for t in range(3)]  # a large group of copies
    rows += [(-7, None, "user", "first"), (-7, 1, "user", "a"), (-7, 1, "user", "b"), (-7, 1, "user", "b"), (203, 0, "user", "no base"), (None, 0, "user", "nobody's")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("chunk", [3, 40, 100_000])
def test_equals_a_plain_trie(spark, monkeypatch, chunk):
    rows = _many()
    monkeypatch.setattr(prefix_trie, "nodes_of", partial(prefix_trie.nodes_of, chunk=chunk))  # in many rounds, a few, one
    df = spark.createDataFrame([(*r, "other", 1) for r in rows], SCHEMA + ", path string, base int").repartition(5)
    assert _got(trie(rebuilt_paths(df))) == _brute(rows)


def test_no_rows_no_root(spark):
    assert _got(trie(rebuilt_paths(spark.createDataFrame([], SCHEMA)))) == []
    assert _got(trie(rebuilt_paths(spark.createDataFrame([(None, 1, "user", "a")], SCHEMA)))) == []


def test_turnless_conversations_end_at_the_root(spark):
    # the base of 9 is absent and 9 has fewer turns than it gives up
    lone = next(c for c in range(1, 500) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    rows = [(lone, 0, "user", "a"), (lone, 1, "user", "b")]
    assert _got(trie(rebuilt_paths(spark.createDataFrame(rows, SCHEMA)))) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]


def test_role_and_text_do_not_run_together(spark):
    got = spark.createDataFrame([("ab", "c"), ("a", "bc"), (None, "abc"), ("abc", None)], "role string, text string").select(
        turn_mark(F.col("role"), F.col("text")).alias("m")
    )
    marks = [r["m"] for r in got.collect()]
    assert len(set(marks)) == 4 and {len(m) for m in marks} == {40}


def test_ids_of_one_end_are_hashed_as_a_stream(spark):
    rows = spark.range(0, 30000).selectExpr("id * 7 - 50000 AS conv_id", "cast('same path, twenty b.' AS binary) AS path").repartition(9)
    got = ends_digest(rows).collect()
    want = hashlib.sha256(",".join(str(i * 7 - 50000) for i in range(30000)).encode()).hexdigest()
    assert [r["sha"] for r in got] == [want]


def test_deep_conversations_take_few_rounds(spark, monkeypatch):
    rows = [(5, t, "user", f"turn {t}") for t in range(900)] + [(10, t, "user", f"turn {t}") for t in range(700)] + [(c, 0, "user", "turn 0") for c in range(11, 90)]
    cuts = []
    monkeypatch.setattr(prefix_trie, "cut", lambda df, f=prefix_trie.cut: cuts.append(1) or f(df))
    got = trie(rebuilt_paths(spark.createDataFrame(rows, SCHEMA))).orderBy("depth", "conv_id").collect()
    assert len(cuts) < 6 and max(r["depth"] for r in got) >= 890
    assert sum(r["n_convs"] for r in got if r["depth"] == 0) == 81
